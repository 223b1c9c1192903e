"""Frontmatter, manifests and their consistency, and the call bounds known before any call."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a bundle's frontmatter may have, the first two of which it must have.
KNOWN_FIELDS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")
REQUIRED = KNOWN_FIELDS[:2]
MOST_NAME, MOST_DESCRIPTION = 64, 1024
_SLUG = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")


def _fault(field: str, value) -> str | None:
    """What is wrong with a required field, if anything."""
    if not isinstance(value, str):
        return "must be text"
    if field == "name":
        return None if _SLUG.fullmatch(value) and len(value) <= MOST_NAME else "must be a slug: lower-case letters, digits and single hyphens, at most 64"
    if not value.strip():
        return "must not be blank"
    if len(value.encode("utf-16-le")) // 2 > MOST_DESCRIPTION:
        return f"must have at most {MOST_DESCRIPTION} characters"
    return "must not have control characters" if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", value) else None


# YAML 1.2's core types of plain words; all others are text.
CORE = [
    ("null", r"\A(?:~|null|Null|NULL|)\Z", ["~", "n", "N", ""]), ("bool", r"\A(?:true|True|TRUE|false|False|FALSE)\Z", list("tTfF")),
    ("int", r"\A(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\Z", list("-+0123456789")),
    ("float", r"\A(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z", list("-+0123456789.")),
]
_loaders: dict[str, type] = {}


def _loader():
    """A YAML loader by version 1.2's core types that refuses a key given twice; made once a process."""
    import yaml

    if "core" not in _loaders:

        class Loader(yaml.SafeLoader):
            yaml_implicit_resolvers: dict = {}

            def construct_mapping(self, node, deep=False):
                seen = set()
                for key, _ in node.value:
                    name = (key.tag, str(self.construct_object(key, deep=True)))
                    if name in seen:
                        raise yaml.constructor.ConstructorError(None, None, "map keys must be unique", key.start_mark)
                    seen.add(name)
                return super().construct_mapping(node, deep)

            def flatten_mapping(self, node):
                """A key << is a key like others."""

        number = lambda kind: lambda loader, node: kind(loader.construct_scalar(node).lower())
        Loader.add_constructor("tag:yaml.org,2002:int", number(lambda t: int(t, 0) if t[:2] in ("0o", "0x") else int(t)))
        Loader.add_constructor("tag:yaml.org,2002:float", number(lambda t: float(t.replace(".inf", "inf").replace(".nan", "nan"))))
        for name, pattern, first in CORE:
            Loader.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(pattern), first)
        _loaders["core"] = Loader
    return _loaders["core"]


def frontmatter(content: str) -> dict:
    """{problem, detail, unknown, name, description, body} of a file's leading --- block. problem is null, or one of missing_block,
    syntax, not_a_map, missing_field, invalid_field."""
    out = dict.fromkeys(("problem", "detail", "name", "description", "body")) | {"unknown": []}
    lines = (content or "").split("\n")
    marks = [i for i, line in enumerate(lines) if line.removesuffix("\r") == "---"]
    if len(marks) < 2 or marks[0] != 0:
        return out | {"problem": "missing_block"}
    out["body"] = "\n".join(lines[marks[1] + 1 :])
    told = _told("\n".join(lines[1 : marks[1]]))
    return out | told | {"unknown": list(told.get("unknown", ()))}


@functools.lru_cache(1024)
def _told(block: str) -> dict:
    """What `frontmatter` says of the text between its marks; blocks that come again are parsed once."""
    import yaml

    try:
        fields = yaml.load(block, _loader())
    except yaml.YAMLError as e:
        return {"problem": "syntax", "detail": str(e).split("\n")[0][:200]}
    if not isinstance(fields, dict):
        return {"problem": "not_a_map"}
    missing = [k for k in REQUIRED if k not in fields]
    if missing:
        return {"problem": "missing_field", "detail": ", ".join(missing)}
    for name in REQUIRED:
        fault = _fault(name, fields[name])
        if fault:
            return {"problem": "invalid_field", "detail": f"{name} {fault}"}
    return {name: fields[name] for name in REQUIRED} | {"unknown": [str(k) for k in fields if k not in KNOWN_FIELDS]}


def parse_frontmatter(c: Column) -> Column:
    kind = "struct<problem:string,detail:string,name:string,description:string,body:string,unknown:array<string>>"
    order = ("problem", "detail", "name", "description", "body", "unknown")
    return F.udf(lambda t: tuple(frontmatter(t)[k] for k in order), kind, useArrow=True)(c)


def write_frontmatter(fields: dict[str, str]) -> str:
    """Always double-quoted, never folded, so that any title is read back as it was."""
    return "\n".join(["---", *(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in fields.items()), "---"])


def frontmatter_issues(files: DataFrame) -> DataFrame:
    """(severity, code, file, message) of the index file SKILL.md among files(path, content)."""
    rows = files.where("path = 'SKILL.md'").select("path", parse_frontmatter(F.col("content")).alias("x"))
    issue = lambda severity, code, message: F.struct(F.lit(severity).alias("severity"), code.alias("code"), message.alias("message"))
    code = F.when(F.col("x.problem").isin("missing_block", "missing_field"), "missing_frontmatter").otherwise("invalid_frontmatter")
    error = F.when(F.col("x.problem").isNotNull(), F.array(issue("error", code, F.concat_ws(": ", "x.problem", "x.detail"))))
    odd = F.transform("x.unknown", lambda k: issue("warning", F.lit("invalid_frontmatter"), F.concat(F.lit("unknown field "), k)))
    found = rows.select("path", F.explode_outer(F.coalesce(error, odd)).alias("i")).where("i is not null")  # a plain explode would have each file parsed again to see whether it has any
    found = found.select("i.severity", "i.code", F.col("path").alias("file"), "i.message")
    absent = files.agg(F.count_if(F.col("path") == "SKILL.md").alias("n")).where("n = 0").select(F.lit("error").alias("severity"), F.lit("missing_frontmatter").alias("code"), F.lit("SKILL.md").alias("file"), F.lit("no such file").alias("message"))
    return found.unionByName(absent)


def manifest_violations(outputs: DataFrame, hashes: DataFrame, sections: DataFrame, questions: DataFrame) -> DataFrame:
    """(rule, subject) for each breach among outputs(path), hashes(path, sha256), sections(id, chapter_file) and questions(qa_id, section_id)."""

    def again(df: DataFrame, key: str, rule: str) -> DataFrame:
        return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("subject"))

    def stray(df: DataFrame, key: str, other: DataFrame, other_key: str, rule: str) -> DataFrame:
        found = df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").select(F.col(key).alias("subject")).distinct()
        return found.select(F.lit(rule).alias("rule"), "subject")

    out = again(outputs, "path", "output listed twice")
    for part in (
        again(sections, "id", "section listed twice"), again(questions, "qa_id", "question listed twice"),
        stray(outputs, "path", hashes, "path", "output without hash"), stray(hashes, "path", outputs, "path", "hash without output"),
        stray(sections.select(F.col("chapter_file").alias("path")), "path", outputs, "path", "chapter not among outputs"), stray(questions.select(F.col("section_id").alias("id")), "id", sections, "id", "question of no section"),
        hashes.where("not sha256 rlike '^[0-9a-f]{64}$'").select(F.lit("malformed hash").alias("rule"), F.col("path").alias("subject")),
    ):
        out = out.unionByName(part)
    return out


def chapters_of(sections: DataFrame) -> DataFrame:
    """(chapter_file, section_ids) of sections(pos, id, chapter_file): ids in input order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return sections.groupBy("chapter_file").agg(ids.alias("section_ids"))


# The bounds are plain arithmetic, on numbers and on columns alike.
def gate_call_bound(sections: int, per_section: int) -> int:
    return sections * 2 + sections * per_section * 3


def evaluation_call_bound(questions: int) -> int:
    return 3 * questions


def compile_call_bound(chapters: int, sections: int, per_section: int) -> int:
    return 1 + chapters + gate_call_bound(sections, per_section)
