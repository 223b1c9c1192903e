"""Documents to a verified bundle: outline, distillation, assembly, question gate, manifest.

One compile is bounded by its input budget (30,000 estimated tokens), so its plan and manifest pass through the driver; sections, bodies,
questions and outcomes stay tables. Every request to a provider is counted before it is made.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import gate, manifest, markers, rules, segment
from ..sources import files as source_files
from ..sources.documents import read_documents
from .questions import Calls, data_block, evaluate
from .reports import outline_report

EXCERPT = 400
QUESTION_KIND = "array<struct<question:string,refAnswer:string,anchorQuote:string>>"


class CompileError(RuntimeError):
    """A compile that can't go on; `stage` names where. A provider's failure comes with its kind, whether it is retryable and the calls made so far; a
    failed validation with its issues."""

    def __init__(self, stage: str, message: str, kind: str | None = None, retryable: bool = False, calls: int = 0, issues: DataFrame | None = None):
        super().__init__(f"{stage}: {message}")
        self.stage, self.message, self.kind, self.retryable, self.calls, self.issues = stage, message, kind, retryable, calls, issues


@dataclass
class Result:
    slug: str
    title: str
    passed: bool | None
    files: DataFrame
    issues: DataFrame
    tables: dict[str, DataFrame]
    manifest: dict
    calls: int = 0
    notes: list[str] = field(default_factory=list)


def named_sections(extracted: DataFrame) -> DataFrame:
    """(path, pos, id, heading, level, text, sha256) of extracted(path, text): sections with a body, ids prefixed per file where there are
    several, numbered in the order of paths and sections. Two equal ids are an error."""
    prefixes = segment.name_spaces(extracted.select("path").distinct())
    rows = segment.population(segment.identified_sections(extracted, "path"))
    rows = rows.join(prefixes, "path").withColumn("id", segment.namespaced(F.col("prefix"), F.col("id")))
    twice = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise CompileError("sources", f"two sections are called {twice[0].id}")
    return rows.select("path", F.struct("path", "sec_pos").alias("pos"), "id", "heading", "level", "text", F.sha2("text", 256).alias("sha256"))


def _shown(limit: int | None = None):
    body = F.col("text") if limit is None else F.when(X.utf16_length(F.col("text")) > limit, F.concat(F.substring("text", 1, limit), F.lit("…"))).otherwise(F.col("text"))
    head = F.when(F.col("heading") == "", "(untitled)").otherwise(F.col("heading"))
    return F.concat(F.lit("[§"), F.col("id"), F.lit("] (level "), F.col("level").cast("string"), F.lit(") "), head, F.lit("\n"), body)


def _ordered(value, *order: str, glue: str = "\n\n"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), glue)


def parse_plan(answer: str) -> tuple[dict | None, str]:
    """(plan, problem) of an outline's answer: JSON, bare or fenced or within other text, of the shape slug, title, chapters."""
    start = min((i for i in (answer.find("{"), answer.find("[")) if i >= 0), default=-1)
    end = max(answer.rfind("}"), answer.rfind("]"))
    try:
        plan = json.loads(answer[start : end + 1]) if start >= 0 else None
    except ValueError as e:
        return None, f"not JSON: {e}"
    text = lambda x: isinstance(x, str)
    if not isinstance(plan, dict) or not text(plan.get("slug")) or not text(plan.get("title")) or not isinstance(plan.get("chapters"), list):
        return None, "slug, title or chapters missing"
    for i, c in enumerate(plan["chapters"]):
        ids = c.get("sectionIds") if isinstance(c, dict) else None
        if not isinstance(ids, list) or not all(map(text, ids)) or not text(c.get("id")) or not text(c.get("title")):
            return None, f"chapter {i + 1} lacks an id, a title or section ids"
    return plan, ""


def outline(sections: DataFrame, calls: Calls) -> tuple[str, str, DataFrame]:
    """(slug, title, chapters(chapter_pos, id, title, section_ids)); each section stands in exactly one chapter."""
    spark = sections.sparkSession
    ask = sections.agg(_ordered(_shown(EXCERPT), "pos").alias("t")).select(F.lit("outline").alias("request_id"), F.lit("outline").alias("role"), data_block("sections", F.col("t")).alias("prompt"))
    said = calls.answer(ask).first()
    if said.error is not None:
        raise CompileError("outline", said.error, said.kind, said.retryable, calls.made)
    plan, problem = parse_plan(said.answer)
    if plan is None:
        raise CompileError("outline", problem)
    head = spark.createDataFrame([(plan["slug"], plan["title"])], "slug string, title string")
    given = [(i + 1, c["id"], c["title"], c["sectionIds"]) for i, c in enumerate(plan["chapters"])]
    chapters = spark.createDataFrame(given, "chapter_pos int, id string, title string, section_ids array<string>").withColumn("section_ids", F.transform("section_ids", X.section_ref))
    broken = rules.plan_violations(head, chapters).limit(5).collect()
    if broken:
        raise CompileError("outline", "; ".join(f"{r.rule}: {r.subject}" for r in broken))
    apart = outline_report(gate.outline_issues(sections.select("id"), chapters.select(F.explode("section_ids").alias("id"))))
    if apart:
        raise CompileError("outline", apart)
    return plan["slug"], plan["title"], chapters


def chapter_sections(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """(chapter_pos, k, *sections): each chapter's sections in the chapter's order."""
    return chapters.select("chapter_pos", F.posexplode("section_ids").alias("k", "id")).join(sections, "id")


def distil(chapters: DataFrame, sections: DataFrame, calls: Calls) -> DataFrame:
    """chapters with `body`: each from the whole text of its sections."""
    given = chapter_sections(chapters, sections).groupBy("chapter_pos").agg(_ordered(_shown(), "k").alias("t")).join(chapters, "chapter_pos")
    ask = given.select(F.col("chapter_pos").cast("string").alias("request_id"), F.lit("distill").alias("role"), F.concat(data_block("chapter-title", F.col("title")), F.lit("\n\n"), data_block("sections", F.col("t"))).alias("prompt"))
    said = calls.answer(ask)
    bad = said.where("answer is null").orderBy("request_id").limit(1).collect()
    if bad:
        raise CompileError("distill", f"chapter {bad[0].request_id}: {bad[0].error}", bad[0].kind, bool(bad[0].retryable), calls.made)
    bodies = said.select(F.col("request_id").cast("int").alias("chapter_pos"), F.col("answer").alias("body"))
    if chapters.join(bodies, "chapter_pos", "left_anti").limit(1).count():
        raise CompileError("distill", "a chapter has no body")
    return gate.with_bodies(chapters, bodies)


ITEM = ("question", "refAnswer", "anchorQuote")


def question_items(answer: str | None) -> list[tuple[str, str, str]]:
    """The items of an answer {"items": [...]}; one malformed item, unknown keys and control characters among them, makes the whole answer worthless."""
    import re

    text = answer or ""
    try:
        told = json.loads(text[text.index("{") : text.rindex("}") + 1])
        items = told["items"]
        found = [tuple(i[k] for k in ITEM) for i in items]
        strange = set(told) != {"items"} or any(set(i) != set(ITEM) for i in items)
    except (ValueError, KeyError, TypeError):
        return []
    bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    fit = lambda v: isinstance(v, str) and 0 < len(v.encode("utf-16-le", "surrogatepass")) // 2 <= rules.MOST_FIELD and not bad.search(v)
    return found if not strange and all(fit(v) for i in found for v in i) else []


def make_questions(sections: DataFrame, calls: Calls, each: int) -> DataFrame:
    """(qa_id, section_id, question, ref_answer, anchor_quote): up to `each` a section whose quote stands in it; a second request goes
    only to sections that are short of it."""
    parse = F.udf(question_items, QUESTION_KIND, useArrow=True)
    base = sections.select("id", "text", _shown().alias("shown"))
    found = None
    need = base.withColumn("need", F.lit(each))
    for attempt in (0, 1):
        prompt = F.concat(F.lit("Questions: "), F.col("need").cast("string"), F.lit("\n"), data_block("section", F.col("shown")))
        said = calls.answer(need.select(F.col("id").alias("request_id"), F.lit("qaGen").alias("role"), prompt.alias("prompt")))
        items = said.select(F.col("request_id").alias("id"), F.posexplode(parse("answer")).alias("k", "item")).join(base, "id").where(F.contains("text", F.col("item.anchorQuote")))
        items = items.select("id", F.lit(attempt).alias("attempt"), "k", "item.*")
        found = items if found is None else found.unionByName(items)
        have = found.groupBy("id").count()
        need = base.join(have, "id", "left").withColumn("need", F.lit(each) - F.coalesce("count", F.lit(0))).where("need > 0").drop("count")
        if attempt == 0 and not need.limit(1).count():
            break
    rows = gate.first_of_each(found, "id", each, "attempt", "k")
    return rows.select(F.concat("id", F.lit("-q"), F.col("n").cast("string")).alias("qa_id"), F.col("id").alias("section_id"), "question", F.col("refAnswer").alias("ref_answer"), F.col("anchorQuote").alias("anchor_quote"))


def run_gate(sections: DataFrame, chapter_of: DataFrame, files: DataFrame, calls: Calls, config: Config, questions: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(gate tables, questions): chapter_of(section_id, chapter_file), files(path, content); questions are made unless they are given."""
    if questions is None:
        questions = make_questions(sections, calls, config.questions_per_section)
    asked = gate.placed_questions(questions, chapter_of)
    index = files.where("path = 'SKILL.md'").first().content
    outcomes = evaluate(asked, index, files, calls).cache()  # at most some thousand rows, of which five tables are made
    return rules.gate_tables(sections, chapter_of, questions, outcomes, config.questions_per_section, config.threshold), questions


def manifest_of(sections: DataFrame, chapter_of: DataFrame, sources: DataFrame, files: DataFrame, questions: DataFrame | None, tables: dict[str, DataFrame] | None, now: datetime | None = None) -> dict:
    """The manifest as one JSON object; sources(path, sha256). All of it is bounded by the compile's input."""
    rows = lambda df, *order: [r.asDict(True) for r in df.orderBy(*order).collect()]
    hashed = rows(files.select("path", F.sha2("content", 256).alias("sha256")), "path")
    placed = sections.select("pos", "id", "sha256").join(chapter_of.withColumnRenamed("section_id", "id"), "id").select("pos", "id", "sha256", F.col("chapter_file").alias("chapterFile"))
    out = {
        "version": 1, "createdAt": (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "sourceFiles": rows(sources.select("path", "sha256"), "path"),
        "sections": [{k: v for k, v in r.items() if k != "pos"} for r in rows(placed, "pos")], "outputs": [r["path"] for r in hashed], "outputHashes": hashed,
    }
    if tables is None or questions is None:
        return out | {"gate": {"skipped": True}, "goldenQa": []}
    judged = tables["summary"].first()
    report = {
        "passRate": judged.pass_rate, "threshold": judged.threshold, "passed": judged.passed, "perChapter": rows(tables["per_chapter"], "file"),
        "coverage": rows(tables["coverage"].select(F.col("section_id").alias("sectionId"), "requested", "generated"), "sectionId"),
        "failures": rows(tables["failures"].select(F.col("qa_id").alias("qaId"), "reason"), "qaId"), "loadHistory": rows(tables["history"].select(F.col("qa_id").alias("qaId")), "qaId"),
    }
    listed = questions.select(F.col("qa_id").alias("id"), F.col("section_id").alias("sectionId"), "question", F.col("ref_answer").alias("refAnswer"), F.col("anchor_quote").alias("anchorQuote"))
    return out | {"gate": report, "goldenQa": rows(listed, "id")}


def validate(files: DataFrame) -> DataFrame:
    return markers.issues(files).unionByName(manifest.frontmatter_issues(files))


def compile_documents(spark: SparkSession, paths: list[str], calls: Calls, config: Config = Config(), gated: bool = True) -> Result:
    """From files to a Result; nothing is published. The stages stop at the first that fails."""
    if any("://" in p for p in paths):
        listing = source_files.read_files(spark, *paths)
        breach = source_files.limit_breaches(listing).first()
        if breach is not None:
            raise CompileError("sources", f"{breach.path}: {breach.breach}")
    else:
        try:
            listed = source_files.list_files(*paths)
        except source_files.ListingError as e:
            raise CompileError("sources", str(e)) from e
        if not listed:
            raise CompileError("sources", f"no files at {', '.join(paths)}")
        listing = read_documents(spark, *listed, taskBytes=1 << 22)
    extracted = source_files.extract(listing).cache()  # at most MOST_TOTAL bytes; parsed once
    failed = source_files.first_error(extracted).first()
    if failed is not None:
        raise CompileError("sources", f"{failed.path}: {failed.error}")
    sections = named_sections(extracted.select("path", "text")).cache()
    tokens = gate.token_totals(sections, config.most_tokens).first()
    if tokens.n == 0:
        raise CompileError("sources", "no section has a text")
    if tokens.over:
        raise CompileError("sources", f"{tokens.tokens} tokens, {config.most_tokens} allowed")
    slug, title, chapters = outline(sections, calls)
    count = chapters.count()
    bound = manifest.compile_call_bound(count, tokens.n, config.questions_per_section) if gated else 1 + count
    if bound > calls.most:
        raise CompileError("calls", f"up to {bound} calls, {calls.most} allowed")
    bodies = distil(chapters, sections, calls)
    chapter_of = bodies.select(F.explode("section_ids").alias("section_id"), X.chapter_path(F.col("chapter_pos"), F.col("title")).alias("chapter_file"))
    files = markers.assemble(markers.Bundle(slug, title, verified=False), bodies)
    tables = questions = passed = None
    broken = validate(files).where("severity = 'error'").limit(5).collect()
    if broken:
        raise CompileError("validation", "; ".join(f"{r.file}: {r.code}" for r in broken), issues=validate(files))
    if gated:
        tables, questions = run_gate(sections, chapter_of, files, calls, config)
        passed = tables["summary"].first().passed
        files = markers.assemble(markers.Bundle(slug, title, verified=passed), bodies)
    sources = listing.select("path", F.sha2("content", 256).alias("sha256"))
    return Result(slug, title, passed, files, validate(files), tables or {}, manifest_of(sections, chapter_of, sources, files, questions, tables), calls.made)


def stored_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, subject): every rule that a manifest read back from disk breaks."""
    t = tables
    out = manifest.manifest_violations(t["outputs"], t["hashes"], t["sections"], t["questions"]).unionByName(rules.question_violations(t["questions"]))
    if t["summary"].limit(1).count():
        out = out.unionByName(rules.gate_violations(t["per_chapter"], t["coverage"], t["failures"], t["history"], t["summary"]))
        out = out.unionByName(rules.manifest_gate_violations(t["sections"], t["questions"], t["per_chapter"], t["coverage"], t["history"]))
    return out


def integrity(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(path, state) between a manifest's hashes and files(path, content). Hidden files are nobody's concern."""
    here = files.where("not path rlike '(^|/)[.][^/]*$'").select("path", F.sha2("content", 256).alias("sha256"))
    return gate.difference(tables["hashes"], here, "path", "sha256")


def evaluate_again(tables: dict[str, DataFrame], files: DataFrame, calls: Calls, config: Config = Config(), sections: DataFrame | None = None) -> dict[str, DataFrame]:
    """The gate of a stored bundle once more: with its own questions, or with new ones from the sections given."""
    if integrity(tables, files).limit(1).count():
        raise CompileError("integrity", "the files are not those of the manifest")
    chapter_of = tables["sections"].select(F.col("id").alias("section_id"), "chapter_file")
    if sections is not None:
        apart = gate.difference(tables["sections"], sections, "id", "sha256").where("state <> 'changed'").limit(1).collect()
        if apart:
            raise CompileError("sources", f"{apart[0].state} section {apart[0].id}")
        count, bound = sections.count(), manifest.gate_call_bound
        need = bound(count, config.questions_per_section)
    else:
        need = manifest.evaluation_call_bound(tables["questions"].count())
    if need > calls.most - calls.made:
        raise CompileError("calls", f"up to {need} calls, {calls.most - calls.made} left")
    made, _ = run_gate(tables["sections"] if sections is None else sections, chapter_of, files, calls, config, None if sections is not None else tables["questions"])
    return made
