"""Coverage, outcomes and verdicts of a question gate, and table differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

EPSILON = 1e-9


def per_chapter(chapters: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(file, asked, correct): chapters(file) with no question are kept with zeros; outcomes(file, correct)."""
    counts = outcomes.groupBy("file").agg(F.count("*").alias("asked"), F.count_if("correct").alias("correct"))
    return chapters.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("correct", F.lit(0)).alias("correct"))


def placed_questions(questions: DataFrame, chapter_of: DataFrame) -> DataFrame:
    """questions(section_id, ...) with the chapter_file of their section, of chapter_of(section_id, chapter_file); '' where no chapter has it. Of several
    rows of a section the last by name counts, so that no question is asked twice."""
    last = chapter_of.groupBy("section_id").agg(F.max("chapter_file").alias("chapter_file"))
    return questions.join(last, "section_id", "left").withColumn("chapter_file", F.coalesce("chapter_file", F.lit("")))


def missing_files(listed: DataFrame, there: DataFrame) -> DataFrame:
    """The rows of listed(path, ...) whose path is not in there(path)."""
    return listed.join(there.select("path"), "path", "left_anti")


def outcome_reason(selected, quoted, right):
    """Why a question failed, null if it didn't: no such chapter, no such quote in it, or a wrong answer, whichever came first."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(selected), "not_found").when(no(quoted), "anchor_missing").when(no(right), "wrong")


def first_of_each(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """rows with n, their place within their key in the given order, up to `most`."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= most)


def pass_rate(correct, asked):
    return F.coalesce(F.try_divide(correct.cast("double"), asked.cast("double")), F.lit(0.0))


def verdict(asked, correct, uncovered, threshold: float = 0.9):
    if not 0.5 <= threshold <= 1:
        raise ValueError("a gate's threshold lies between 0.5 and 1")
    return (asked > 0) & (pass_rate(correct, asked) >= threshold - EPSILON) & (uncovered == 0)


def coverage(population: DataFrame, questions: DataFrame, requested: int) -> DataFrame:
    """(section_id, requested, generated), zero-filled from the population."""
    counts = questions.groupBy("section_id").agg(F.count("*").alias("generated"))
    return population.select("section_id").join(counts, "section_id", "left").select("section_id", F.lit(requested).alias("requested"), F.coalesce("generated", F.lit(0)).alias("generated"))


def outline_issues(population: DataFrame, assigned: DataFrame) -> DataFrame:
    """(issue, id): missing, unknown and repeated ids of assigned(id) against population(id)."""
    missing = population.join(assigned, "id", "left_anti").select(F.lit("missing").alias("issue"), "id")
    unknown = assigned.join(population, "id", "left_anti").select(F.lit("unknown").alias("issue"), "id").distinct()
    again = assigned.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("issue"), "id")
    return missing.unionByName(unknown).unionByName(again)


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, unknown or changed between two tables of (key, value)."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(1).alias("in_old")), after.select(key, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    state = F.when(F.col("in_new").isNull(), "missing").when(F.col("in_old").isNull(), "unknown").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def integrity_status(unexpected, missing, modified):
    return F.when(unexpected > 0, "tampered").when(missing + modified > 0, "stale").otherwise("ok")


def token_totals(texts: DataFrame, most: int, *by: str) -> DataFrame:
    """(*by, tokens, n, over): estimated tokens of texts(*by, text), how many texts there are, and whether the tokens are more than `most`."""
    total = texts.groupBy(*by).agg(F.coalesce(F.sum(X.estimate_tokens(F.col("text"))), F.lit(0)).alias("tokens"), F.count("*").alias("n"))
    return total.withColumn("over", F.col("tokens") > most)


def with_bodies(chapters: DataFrame, bodies: DataFrame, key: str = "chapter_pos") -> DataFrame:
    """chapters with the body of bodies(key, body); a chapter without one fails the query that reads it."""
    said = F.when(F.col("body").isNotNull(), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("no body for chapter "), F.col(key).cast("string"))))
    return chapters.join(bodies.select(key, "body"), key, "left").withColumn("body", said)


def loaded(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """chosen(selected_file, ...) with the content of the chapter file that was selected, null where files(path, content) hold none of that name or the
    name is no chapter's: an index or a listing counts as not found."""
    listed = files.where(X.is_chapter_path(F.col("path"))).select(F.col("path").alias("selected_file"), "content")
    return chosen.join(listed, "selected_file", "left")


def first_limit_breach(files: DataFrame, order: str, size: str, most_files: int, most_each: int, most_total: int) -> DataFrame:
    """files with their running total and the limit that each breaks, if any. The order of a listing is global, so the running total is
    summed per range of `order` first; only one row a range goes through a single window. Ranges are cut at quantiles of `order` that are computed once and
    stand in the plan as values, so every branch sees the same ones."""
    cuts = _cuts(files, order)
    ranged = files.withColumn("_part", F.aggregate(F.array(*cuts), F.lit(0), lambda n, c: n + F.coalesce((c <= F.col(order)).cast("int"), F.lit(0)))) if cuts else files.withColumn("_part", F.lit(0))
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("s"), F.count("*").alias("c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    here = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("*", F.sum(size).over(here).alias("s1"), F.row_number().over(Window.partitionBy("_part").orderBy(order)).alias("c1")).join(F.broadcast(sums), "_part")
    total, count = F.col("s0") + F.col("s1"), F.col("c0") + F.col("c1")
    breach = F.when(count > most_files, "too_many").when(F.col(size) > most_each, "too_large").when(total > most_total, "total_too_large")
    return rows.select(*files.columns, total.alias("running"), breach.alias("breach"))


def _cuts(files: DataFrame, order: str) -> list:
    """Values of `order` that cut the table into ranges of about equal counts, as many as the session shuffles into; taken from its distinct values with the
    smallest hashes, 64 a range, so they are the same in every run."""
    ranges = max(1, min(1000, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = files.select(order).distinct().orderBy(F.xxhash64(order), order).limit(64 * ranges)
    values = [r[0] for r in some.orderBy(order).collect() if r[0] is not None]
    kind = files.schema[order].dataType
    return [F.lit(values[i]).cast(kind) for i in sorted({len(values) * k // ranges for k in range(1, ranges)}) if 0 < i < len(values)]
