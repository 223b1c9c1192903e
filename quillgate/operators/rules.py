"""Consistency rules of plans, question sets and gate reports, each a query for the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .gate import EPSILON, pass_rate, verdict

MOST_TITLE, MOST_ID, MOST_FIELD, MOST_QUESTIONS = 200, 200, 2000, 1000


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _broken(df: DataFrame, when, rule: str, subject: str) -> DataFrame:
    """A null condition breaks its rule too."""
    return df.where(F.coalesce(when, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _again(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("subject"))


def _apart(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Values of two one-column tables (subject) that stand in one of them only; one shuffle for both directions."""
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    return both.groupBy("subject").agg(F.count_distinct("side").alias("n")).where("n = 1").select(F.lit(rule).alias("rule"), "subject")


def _line(c, most: int):
    return (X.utf16_length(c).between(1, most)) & X.is_single_line(c)


def plan_violations(plan: DataFrame, chapters: DataFrame) -> DataFrame:
    """(rule, subject) of plan(slug, title), one row, and chapters(chapter_pos, id, title, section_ids)."""
    return _all(
        _broken(plan, ~X.is_slug(F.col("slug")), "malformed slug", "slug"),
        _broken(plan, ~_line(F.col("title"), MOST_TITLE), "title is no short single line", "title"),
        _broken(chapters, ~_line(F.col("id"), MOST_ID), "chapter id is no short single line", "chapter_pos"),
        _broken(chapters, ~_line(F.col("title"), MOST_TITLE), "chapter title is no short single line", "chapter_pos"),
        _broken(chapters, F.size("section_ids") < 1, "chapter without sections", "chapter_pos"),
        _broken(chapters, F.exists("section_ids", lambda s: F.coalesce(~_line(s, MOST_ID), F.lit(True))), "section id is no short single line", "chapter_pos"),
        _again(chapters, "id", "chapter listed twice"),
        chapters.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no chapters").alias("rule"), F.lit(None).cast("string").alias("subject")),
    )


def _facts(df: DataFrame, space: str, key, **measures) -> DataFrame:
    """(space, key, measures): what the rows of a table say about their key and, as space 'all', about the whole; read once for both."""
    rows = df.select(key.cast("string").alias("key"), *[m.alias(n) for n, m in measures.items()])
    at = F.explode(F.array(F.struct(F.lit(space).alias("space"), F.col("key").alias("key")), F.struct(F.lit("all").alias("space"), F.lit("all").alias("key"))))
    return rows.select(at.alias("at"), *measures).select("at.*", *measures)


def _judged(facts: list[DataFrame], rules: list[tuple], maxima: tuple[str, ...] = ()) -> DataFrame:
    """(rule, subject) by one aggregate of the union of keyed facts. A rule is (space, name, how many rows it gives for a key as a column of the summed facts[, what they
    name as their subject instead of the key])."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    sums = [(F.max(c) if c in maxima else F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in union.columns if c not in ("space", "key")]
    total = union.groupBy("space", "key").agg(*sums)
    broken = F.array(*[F.when(F.col("space") == space, F.struct(F.lit(name).alias("rule"), F.coalesce(count, F.lit(1)).cast("long").alias("n"), (subject[0] if subject else F.col("key")).alias("subject"))) for space, name, count, *subject in rules])
    found = total.select(F.explode(F.filter(broken, lambda r: r.isNotNull() & (r["n"] > 0))).alias("r"))
    return found.select("r.rule", "r.subject", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.n")))).select("rule", "subject")


def _flag(condition):
    """1 where a condition holds or can't be told, else 0."""
    return F.coalesce(condition, F.lit(True)).cast("long")


def question_violations(questions: DataFrame) -> DataFrame:
    """(rule, subject) of questions(qa_id, section_id, question, ref_answer, anchor_quote); the table is read once."""
    fields = ("question", "ref_answer", "anchor_quote")
    bad = {c: _flag(~(X.utf16_length(F.col(c)).between(1, MOST_FIELD) & X.is_multi_line(F.col(c)))) for c in fields}
    per_key = [("qa", f"{c} empty, long or with control characters", F.col(c)) for c in fields]
    many = ("all", "too many questions", (F.col("n") > MOST_QUESTIONS).cast("long"), F.col("n").cast("string"))
    return _judged([_facts(questions, "qa", F.col("qa_id"), n=F.lit(1).cast("long"), **bad)], [*per_key, ("qa", "question listed twice", (F.col("n") > 1).cast("long")), many])


def gate_violations(per_chapter: DataFrame, coverage: DataFrame, failures: DataFrame, history: DataFrame, summary: DataFrame) -> DataFrame:
    """(rule, subject) of a gate's tables: per_chapter(file, asked, correct), coverage(section_id, requested, generated),
    failures(qa_id, reason), history(qa_id) and summary(pass_rate, threshold, passed), one row.

    Each table is read once: its rows say what they say about their key and about the whole, and one aggregate of all these facts answers every rule.
    """
    one, whole = F.lit(1).cast("long"), lambda c: F.col(c).cast("long")
    ungenerated = F.coalesce(F.col("reason") == "qa_generation_failed", F.lit(False)).cast("long")
    open_ = (F.col("generated") == 0).cast("long")
    at = lambda space, key: F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"))
    spots = F.array(at("section", F.col("section_id")), at("qa", F.when(open_ == 1, F.concat("section_id", F.lit("-q0")))), at("all", F.lit("all")))
    sections = coverage.select(F.explode(spots).alias("at"), "requested", "generated")
    sections = sections.select("at.*", (F.col("at.space") == "section").cast("long").alias("covered"), F.when(F.col("at.space") == "section", _flag(F.col("generated") > F.col("requested"))).otherwise(0).alias("beyond"), open_.alias("uncovered"))
    facts = [
        _facts(per_chapter, "chapter", F.col("file"), chapters=one, excess=_flag(F.col("correct") > F.col("asked")), asked=whole("asked"), correct=whole("correct")),
        _facts(failures, "qa", F.col("qa_id"), failed=one, graded=1 - ungenerated, ungenerated=ungenerated),
        _facts(history, "qa", F.col("qa_id"), loads=one),
        sections.where("space <> 'qa' or key is not null"),
        _facts(summary, "summary", F.lit("all"), judged=one, pass_rate=F.col("pass_rate"), threshold=F.col("threshold"), passed=whole("passed")),
    ]
    there = lambda condition: F.when((F.col("judged") > 0) & F.col("passed").isNotNull(), _flag(condition)).otherwise(0)
    rate = pass_rate(F.col("correct"), F.col("asked"))
    said = (F.col("asked") > 0) & (F.col("pass_rate") >= F.col("threshold") - EPSILON) & (F.col("uncovered") == 0)
    more = lambda c: (F.col(c) > 1).cast("long")
    rules = [
        ("chapter", "more correct than asked", F.col("excess")), ("chapter", "chapter counted twice", more("chapters")), ("qa", "question loaded twice", more("loads")),
        ("qa", "failure listed twice", more("failed")), ("section", "section covered twice", more("covered")), ("section", "more generated than requested", F.col("beyond")),
        ("qa", "failure never loaded", F.when(F.col("loads") == 0, F.col("graded")).otherwise(0)),
        ("qa", "sections without questions and their failures differ", ((F.col("uncovered") > 0) != (F.col("ungenerated") > 0)).cast("long")),
        ("all", "asked differs from loads", there(F.col("asked") != F.col("loads"))), ("all", "correct differs from asked less failures", there(F.col("correct") != F.col("asked") - F.col("graded"))),
        ("all", "pass rate differs from the counts", there(F.abs(F.col("pass_rate") - rate) > EPSILON)), ("all", "threshold outside 0.5 to 1", there(~F.col("threshold").between(0.5, 1.0))),
        ("all", "verdict contradicts the counts", there((F.col("passed") == 1) != said)),
    ]
    return _judged(facts, rules, maxima=("pass_rate", "threshold", "passed"))


def manifest_gate_violations(sections: DataFrame, questions: DataFrame, per_chapter: DataFrame, coverage: DataFrame, history: DataFrame) -> DataFrame:
    """(rule, subject) where a manifest and its gate tables do not point at each other."""
    return _all(
        history.join(questions.select("qa_id"), "qa_id", "left_anti").select(F.lit("loaded question not listed").alias("rule"), F.col("qa_id").alias("subject")),
        _apart(sections.select(F.col("id").alias("subject")), coverage.select(F.col("section_id").alias("subject")), "coverage and sections differ"),
        _apart(sections.select(F.col("chapter_file").alias("subject")).distinct(), per_chapter.select(F.col("file").alias("subject")), "counted chapters and chapter files differ"),
    )


def gate_tables(population: DataFrame, chapter_of: DataFrame, questions: DataFrame, outcomes: DataFrame, requested: int, threshold: float) -> dict[str, DataFrame]:
    """The tables of a gate report: population(id), chapter_of(section_id, chapter_file), questions(qa_id, section_id), outcomes(qa_id,
    chapter_file, correct, failure_reason)."""
    from .gate import coverage, per_chapter

    chapters = per_chapter(chapter_of.select(F.col("chapter_file").alias("file")), outcomes.select(F.col("chapter_file").alias("file"), "correct"))
    covered = coverage(population.select(F.col("id").alias("section_id")), questions, requested)
    graded = outcomes.where("not correct").select("qa_id", F.col("failure_reason").alias("reason"))
    failures = graded.unionByName(covered.where("generated = 0").select(F.concat("section_id", F.lit("-q0")).alias("qa_id"), F.lit("qa_generation_failed").alias("reason")))
    counts = chapters.select("asked", "correct").unionByName(covered.where("generated = 0").select(F.lit(1).alias("open")), allowMissingColumns=True)
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "correct", "open")])
    summary = total.select(pass_rate(F.col("correct"), F.col("asked")).alias("pass_rate"), F.lit(float(threshold)).alias("threshold"), verdict(F.col("asked"), F.col("correct"), F.col("open"), threshold).alias("passed"))
    return {"per_chapter": chapters, "coverage": covered, "failures": failures, "history": outcomes.select("qa_id"), "summary": summary}
