"""Bundles on disk: publishing as a whole or not at all, reading back, and the folders they go to.

Files are written by the tasks that hold their rows and put in place by the driver, which sees their names alone.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..sources.documents import read_documents
from .paths import MANIFEST, PublishError, relative_path  # noqa: F401
from .staged import Bundle, checked_target, cleared, manifest_text

# Where agents look for bundles, below the home folder.
TARGETS = {"claude": ".claude/skills", "agents": ".agents/skills"}
SLUG = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")


def safe_slug(slug: str) -> str:
    if not SLUG.fullmatch(slug) or len(slug) > 64:
        raise PublishError("unsafe_slug", f"{slug!r}: at most 64 lower-case letters, digits and single hyphens")
    return slug


def target_folder(kind: str, slug: str, home: str | None = None) -> Path:
    return Path(home or Path.home()) / TARGETS[kind] / safe_slug(slug)


def rejected_folder(slug: str, parent: str | None = None) -> Path:
    """A fresh folder for a bundle that its gate refused."""
    return Path(tempfile.mkdtemp(prefix=f"quillgate-{safe_slug(slug)}-", dir=parent))


def publish(files: DataFrame, manifest: dict, folder: str | Path, force: bool = False) -> Path:
    """files(path, content) and the manifest as the folder's whole content, or the folder as it was: `staged` says how.

    Without `force`, a folder that holds anything is refused. With it the previous content goes as a whole, and comes back if the renaming fails.
    """
    target = checked_target(folder, force)
    files.sparkSession.dataSource.register(Bundle)
    token = uuid.uuid4().hex[:12]
    writer = files.select("path", "content").write.format(Bundle.name()).option("manifest", manifest_text(manifest)).option("token", token)
    try:
        writer.mode("overwrite" if force else "append").save(str(target))
    except PySparkException as e:
        told = re.search(r"PublishError: \[(\w+)\] (.*)", str(e))
        if not told:
            raise
        raise PublishError(told[1], told[2]) from e
    finally:
        cleared(target, token)  # a sink is not always told that its job has failed
    return target


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a bundle's files, paths relative to it, the manifest left out. On a local disk all files are read, empty and hidden ones too; other
    stores are read by Spark's own listing, which leaves those out."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder))
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    if full.startswith("file:"):
        found = read_documents(spark, re.sub("^file:/+", "/", full), mostFiles=1 << 20, mostEach=1 << 30, mostTotal=1 << 40)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(full)
    shown = found.selectExpr("regexp_replace(path, '^[a-z]+:/+', '/') AS at", "decode(content, 'UTF-8') AS content")
    start = len(os.path.realpath(re.sub("^file:/+", "/", full)) if full.startswith("file:") else re.sub("^[a-z]+:/+", "/", full)) + 2
    return shown.selectExpr(f"substring(at, {start}) AS path", "content").where(f"path <> '{MANIFEST}'")


_HASH = {"path": str, "sha256": str}
# The parts of a manifest and their types; a list holds any number of its one entry, and a part in brackets may be absent.
SHAPE = {
    "version": int, "createdAt": str, "sourceFiles": [_HASH], "sections": [{"id": str, "sha256": str, "chapterFile": str}], "outputs": [str], "outputHashes": [_HASH],
    "goldenQa": [{"id": str, "sectionId": str, "question": str, "refAnswer": str, "anchorQuote": str}],
}
GATE_SHAPE = {
    "passRate": float, "threshold": float, "passed": bool, "perChapter": [{"file": str, "asked": int, "correct": int}], "coverage": [{"sectionId": str, "requested": int, "generated": int}],
    "failures": [{"qaId": str, "reason": str}], "loadHistory": [{"qaId": str}],
}


def faults(value, shape, where: str = "") -> list[str]:
    """Where a JSON value departs from a shape, in order."""
    at = where or "manifest"
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{at}: must be an object"]
        return [f for k, part in shape.items() for f in ([f"{where}{'.' * bool(where)}{k}: is missing"] if k not in value else faults(value[k], part, f"{where}{'.' * bool(where)}{k}"))]
    if isinstance(shape, list):
        return [f for i, x in enumerate(value) for f in faults(x, shape[0], f"{where}.{i}")] if isinstance(value, list) else [f"{at}: must be a list"]
    fits = isinstance(value, (int, float) if shape is float else shape) and (shape is bool or not isinstance(value, bool))
    return [] if fits else [f"{at}: must be {dict(((str, 'text'), (int, 'a whole number'), (float, 'a number'), (bool, 'true or false')))[shape]}"]


def manifest_faults(raw) -> list[str]:
    found = faults(raw, SHAPE)
    gate = raw.get("gate") if isinstance(raw, dict) else None
    if isinstance(raw, dict) and not (isinstance(gate, dict) and gate.get("skipped") is True):
        found += faults(gate, GATE_SHAPE, "gate")
    return found


def told(found: list[str], most: int = 5) -> str:
    """The first faults, and how many more there are."""
    return "; ".join(found[:most]) + (f"; +{len(found) - most} more" if len(found) > most else "")


def manifest_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The manifest's parts as tables: outputs, hashes, sections, questions, per_chapter, coverage, failures, history, summary.

    Text that isn't JSON, and a manifest with a part missing or of another type, raise ValueError with the first faults. A link is not read.
    """
    place = Path(folder) / MANIFEST
    if place.is_symlink():
        raise PublishError("link", f"{place} is a link")
    raw = json.loads(place.read_text("utf-8"))
    found = manifest_faults(raw)
    if found:
        raise ValueError(f"the manifest is not well formed: {told(found)}")
    gate = raw.get("gate") if isinstance(raw.get("gate"), dict) else {}
    pick = lambda rows, *keys: [tuple(r.get(k) for k in keys) for r in rows or []]
    make = spark.createDataFrame
    judged = [] if gate.get("skipped") or "passed" not in gate else [(float(gate["passRate"]), float(gate["threshold"]), bool(gate["passed"]))]
    return {
        "outputs": make([(p,) for p in raw.get("outputs") or []], "path string"),
        "hashes": make(pick(raw.get("outputHashes"), "path", "sha256"), "path string, sha256 string"),
        "sections": make([(i, *r) for i, r in enumerate(pick(raw.get("sections"), "id", "sha256", "chapterFile"))], "pos int, id string, sha256 string, chapter_file string"),
        "questions": make(pick(raw.get("goldenQa"), "id", "sectionId", "question", "refAnswer", "anchorQuote"), "qa_id string, section_id string, question string, ref_answer string, anchor_quote string"),
        "per_chapter": make(pick(gate.get("perChapter"), "file", "asked", "correct"), "file string, asked long, correct long"),
        "coverage": make(pick(gate.get("coverage"), "sectionId", "requested", "generated"), "section_id string, requested long, generated long"),
        "failures": make(pick(gate.get("failures"), "qaId", "reason"), "qa_id string, reason string"),
        "history": make(pick(gate.get("loadHistory"), "qaId"), "qa_id string"),
        "summary": make(judged, "pass_rate double, threshold double, passed boolean"),
    }
