"""Compiles documents to a bundle, grades a bundle again, reports on one, or validates one.

compile PATH... --provider MODULE:NAME (--out FOLDER | --target claude|agents) [--force] [--no-gate]
eval FOLDER --provider MODULE:NAME [--source PATH...]
report FOLDER
validate FOLDER

A provider is any object with complete(role, prompt), named by its module and a function that makes it from the settings. Exit code 0: the bundle
may be used; 1: it may not, or nothing was made; 2: the command was wrong.
"""

from __future__ import annotations

import argparse
import importlib
import sys


def _arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser("python -m quillgate", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    compile_ = commands.add_parser("compile")
    compile_.add_argument("paths", nargs="+")
    place = compile_.add_mutually_exclusive_group(required=True)
    place.add_argument("--out")
    place.add_argument("--target", choices=("claude", "agents"))
    compile_.add_argument("--force", action="store_true")
    compile_.add_argument("--no-gate", action="store_true")
    eval_ = commands.add_parser("eval")
    eval_.add_argument("folder")
    eval_.add_argument("--source", nargs="+")
    for command in (compile_, eval_):
        command.add_argument("--provider", required=True)
        command.add_argument("--env-file", default=".env")
    for name in ("report", "validate"):
        commands.add_parser(name).add_argument("folder")
    return parser.parse_args(given)


def _compile(spark, given, calls, config) -> int:
    from .plans import compiling, reports
    from .sinks import bundle

    made = compiling.compile_documents(spark, given.paths, calls, config, gated=not given.no_gate)
    refused = made.passed is False
    folder = bundle.rejected_folder(made.slug) if refused else given.out or bundle.target_folder(given.target, made.slug)
    bundle.publish(made.files, made.manifest, folder, force=given.force)
    print(f"{'Refused by its gate, kept at' if refused else 'Compiled:'} {folder} ({calls.made} calls, about {calls.tokens} tokens)")
    print(reports.gate_report(made.tables) if made.tables else reports.skipped_gate())
    if made.issues.limit(1).count():
        print(reports.validation_report(made.issues)[1])
    return 1 if refused else 0


def _evaluate(spark, given, calls, config) -> int:
    from .plans import compiling, reports
    from .sinks import bundle
    from .sources import files as source_files
    from .sources.documents import read_documents

    files, tables = bundle.read_bundle(spark, given.folder), bundle.manifest_tables(spark, given.folder)
    broken = compiling.stored_problems(tables).limit(5).collect()
    if broken:
        print("The manifest is not consistent: " + "; ".join(f"{r.rule}: {r.subject}" for r in broken))
        return 1
    sections = None
    if given.source:
        listing = read_documents(spark, *source_files.list_files(*given.source))
        sections = compiling.named_sections(source_files.extract(listing).select("path", "text"))
        found = compiling.gate.difference(tables["sections"], sections, "id", "sha256")
        print(reports.source_report(found) or reports.changed_note(found))
    made = compiling.evaluate_again(tables, files, calls, config, sections)
    print(reports.gate_report(made))
    return 0 if made["summary"].first().passed else 1


def main(arguments: list[str]) -> int:
    given = _arguments(arguments)
    from pyspark.sql import SparkSession

    from . import config as settings
    from .plans import compiling, questions, reports
    from .sinks import bundle
    from .sources.files import ListingError

    spark = SparkSession.builder.getOrCreate()
    if given.command in ("compile", "eval"):
        calls = None
        try:
            config = settings.load(env_file=given.env_file)
            module, _, name = given.provider.partition(":")
            calls = questions.Calls(getattr(importlib.import_module(module), name or "provider")(config), config.most_calls)
            return (_compile if given.command == "compile" else _evaluate)(spark, given, calls, config)
        except compiling.CompileError as e:
            print(reports.compile_failure(e))
        except (settings.ConfigError, bundle.PublishError, ListingError, questions.CallCap, OSError) as e:
            print(f"{given.command} failed: {e}")
        return 1
    files = bundle.read_bundle(spark, given.folder)
    if given.command == "validate":
        passed, text = reports.validation_report(compiling.validate(files))
        print(text)
        return 0 if passed else 1
    tables = bundle.manifest_tables(spark, given.folder)
    broken = compiling.stored_problems(tables).limit(5).collect()
    if broken:
        print("The manifest is not consistent: " + "; ".join(f"{r.rule}: {r.subject}" for r in broken))
        return 1
    status, text = reports.integrity_report(compiling.integrity(tables, files))
    print(text or reports.gate_report(tables))
    return 0 if status == "ok" else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
