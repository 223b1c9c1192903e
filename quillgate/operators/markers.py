"""Marker lines of chapter bodies, and the files assembled from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import gate


# The forms of marker lines.
TERM_LINE = r"\A\*\*(.+?)\*\*\s*—\s*(.+)\z"
KIND_LINE = r"(?i)\A-\s*\[(PATTERN|ANTI-PATTERN|PROCEDURE|RULE)\]\s*(.+)\z"


def _bundle(df: DataFrame) -> list[str]:
    """The key that tells bundles apart, where a table has one."""
    return [c for c in ("bundle",) if c in df.columns]


def marker_lines(chapters: DataFrame) -> DataFrame:
    """(chapter_pos, line_pos, kind, term, text, chapter_file) of chapters(chapter_pos, chapter_file, body); a column `bundle` stays."""
    mark = lambda kind, term, text: F.struct(kind.alias("kind"), term.alias("term"), X.trim(text).alias("text"))

    def told(x):
        """What a line marks, or null. Its first characters tell which of the two forms it may have."""
        term = X.let(F.regexp_extract(x, TERM_LINE, 1), lambda t: F.when(t != "", mark(F.lit("GLOSSARY"), X.trim(t), F.regexp_extract(x, TERM_LINE, 2))))
        kind = X.let(F.upper(F.regexp_extract(x, KIND_LINE, 1)), lambda k: F.when(k != "", mark(k, F.lit(None).cast("string"), F.regexp_extract(x, KIND_LINE, 2))))
        return F.when(x.startswith("**"), term).when(x.startswith("-"), kind)

    found = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("line_pos"), X.let(X.trim(x), told).alias("mark")))
    found = F.filter(found, lambda x: x["mark"].isNotNull())
    lines = chapters.select(*_bundle(chapters), "chapter_pos", "chapter_file", F.explode_outer(found).alias("x")).where("x is not null")
    return lines.select(*_bundle(chapters), "chapter_pos", "x.line_pos", "x.mark.kind", "x.mark.term", "x.mark.text", "chapter_file")


def glossary(markers: DataFrame) -> DataFrame:
    """(term, definition, chapters): the first definition of each term, its chapters in first-seen order; by `bundle` where there is one."""
    rows = markers.where("kind = 'GLOSSARY'").withColumn("pos", F.struct("chapter_pos", "line_pos"))
    seen = F.transform(F.array_sort(F.collect_set(F.struct("chapter_pos", "chapter_file"))), lambda x: x["chapter_file"])
    return rows.groupBy(*_bundle(markers), "term").agg(F.min_by("text", "pos").alias("definition"), F.array_distinct(seen).alias("chapters"))


def grouped(markers: DataFrame, entry, kinds: tuple[str, ...] = ("PATTERN", "PROCEDURE", "ANTI-PATTERN")) -> DataFrame:
    """(rank, kind, n, text): per kind in the given order its entries (a column) as lines in order of the markers; kinds without any are left out. By `bundle`
    where there is one."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chapter_pos", "line_pos", entry.alias("v")))), lambda x: x["v"])
    return markers.where(F.col("kind").isin(*kinds)).groupBy(*_bundle(markers), rank.alias("rank"), "kind").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("text"))


@dataclass(frozen=True)
class Bundle:
    slug: str
    title: str
    verified: bool = True


def assemble(bundle: Bundle, chapters: DataFrame) -> DataFrame:
    """(rank, chapter_pos, path, content, est_tokens) of one bundle's chapters(chapter_pos, title, section_ids, body): `assemble_many` for a single key."""
    one = chapters.sparkSession.range(1).select(F.lit(0).alias("bundle"), F.lit(bundle.slug).alias("slug"), F.lit(bundle.title).alias("title"), F.lit(bundle.verified).alias("verified"))
    return assemble_many(one, chapters.withColumn("bundle", F.lit(0))).drop("bundle")


# What stands in the files of a bundle besides its chapters.
UNVERIFIED = "> ⚠️ **unverified** — this bundle did not pass the question gate. Its accuracy has not been verified.\n\n"
REFERENCES = "\n## Reference files\n\n- `glossary.md` — key terms\n- `patterns.md` — techniques, procedures, anti-patterns\n- `cheatsheet.md` — decision tables and quick rules"
LISTINGS = {"glossary.md": (2, "Glossary", "no terms extracted."), "patterns.md": (3, "Patterns", "no patterns extracted."), "cheatsheet.md": (4, "Cheatsheet", "no rules extracted.")}
KIND_TITLES = {"PATTERN": "Patterns", "PROCEDURE": "Procedures", "ANTI-PATTERN": "Anti-patterns"}


def assemble_many(bundles: DataFrame, chapters: DataFrame) -> DataFrame:
    """(bundle, rank, chapter_pos, path, content, est_tokens): all files of all bundles(bundle, slug, title, verified) from
    chapters(bundle, chapter_pos, title, section_ids, body): index, chapters, glossary, patterns, rules.

    Any number of bundles go through one plan: markers are grouped by bundle, so what one task holds is one bundle's listing. A bundle without chapters
    has the index and empty listings.
    """
    rows = chapters.select("*", X.chapter_path(F.col("chapter_pos"), F.col("title")).alias("chapter_file"))
    found = marker_lines(rows)
    joined = lambda value, *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), "\n")
    ticks = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", "$1")
    entry = F.concat(F.lit("- "), ticks(F.col("chapter_file")), F.lit(" — "), F.col("title"), F.lit(" (source sections: "), F.array_join("section_ids", ", "), F.lit(")"))
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" ("), ticks(F.col("chapter_file")), F.lit(")"))
    term = F.concat(F.lit("**"), F.col("term"), F.lit("** — "), F.col("definition"), F.lit(" ("), F.array_join(F.transform("chapters", ticks), ", "), F.lit(")\n"))
    said = found.where("kind != 'GLOSSARY'").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", "line_pos", "kind", line.alias("v")))).alias("said"))
    of_kind = lambda said, kind: F.array_join(F.transform(F.filter(said, lambda x: x["kind"] == kind), lambda x: x["v"]), "\n")
    groups = lambda said: F.filter(F.array(*[F.when(F.exists(said, lambda x: x["kind"] == k), F.concat(F.lit(f"## {name}\n\n"), of_kind(said, k))) for k, name in KIND_TITLES.items()]), lambda v: v.isNotNull())
    terms = glossary(found).withColumn("o", F.collate("term", "UNICODE")).groupBy("bundle").agg(X.trim(joined(term, "o", "term")).alias("text"))
    listed = {"patterns.md": lambda said: F.array_join(groups(said), "\n\n"), "cheatsheet.md": lambda said: of_kind(said, "RULE")}
    file = lambda rank, path, content: (F.lit(rank).alias("rank"), F.lit(0).alias("chapter_pos"), F.lit(path).alias("path"), content.alias("content"))
    head = F.concat(
        F.lit("---\nname: "), quoted(F.col("slug")), F.lit("\ndescription: "), quoted(F.col("title")), F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n"),
        F.when(F.col("verified"), F.lit("")).otherwise(F.lit(UNVERIFIED)), F.lit("## Chapter index\n\n"), F.coalesce("entries", F.lit("")), F.lit("\n" + REFERENCES),
    )
    index = bundles.join(rows.groupBy("bundle").agg(joined(entry, "chapter_pos").alias("entries")), "bundle", "left").select("bundle", *file(0, "SKILL.md", head))
    files = index.unionByName(rows.select("bundle", F.lit(1).alias("rank"), "chapter_pos", F.col("chapter_file").alias("path"), F.col("body").alias("content")))
    body = lambda path, text: F.concat(F.lit(f"# {LISTINGS[path][1]}\n\n"), X.let(F.coalesce(text, F.lit("")), lambda x: F.when(x == "", F.lit(f"({LISTINGS[path][2]})")).otherwise(x)))
    files = files.unionByName(bundles.select("bundle").join(terms, "bundle", "left").select("bundle", *file(LISTINGS["glossary.md"][0], "glossary.md", body("glossary.md", F.col("text")))))
    both = F.array(*[F.struct(*file(LISTINGS[path][0], path, body(path, text(F.col("said"))))) for path, text in listed.items()])
    files = files.unionByName(bundles.select("bundle").join(said, "bundle", "left").select("bundle", F.explode_outer(both).alias("x")).select("bundle", "x.*"))
    content = F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    return files.select("bundle", "rank", "chapter_pos", "path", content.alias("content")).withColumn("est_tokens", X.estimate_tokens(F.col("content")))


def over_budget(files: DataFrame) -> DataFrame:
    """(path, n, most) of the files(path, content) with more tokens than their class allows; other columns stay."""
    return files.withColumn("n", X.estimate_tokens(F.col("content"))).withColumn("most", X.budget(F.col("path"))).where("n > most")


def links(pages: DataFrame, pattern: str = r"(chapters/[\p{L}\p{N}-]+\.md)") -> DataFrame:
    """(*, path): a row for each distinct link, the first group of `pattern`, of pages(..., content), whose content is left out."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c != "content"]
    return pages.select(*kept, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).alias("path"))


def anchor_ratio(files: DataFrame, mark: str = "[§") -> DataFrame:
    """(path, ratio): the share of a file's lines of substance that hold `mark`; files without such lines are left out."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).where(X.substantive_line(F.col("line")))
    return lines.groupBy("path").agg((F.count_if(F.contains("line", F.lit(mark))) / F.count("*")).alias("ratio"))


def issues(files: DataFrame) -> DataFrame:
    """(severity, code, file, message): budgets, broken chapter links and chapters with few anchored lines, of files(path, content)."""
    over = over_budget(files).select(F.lit("error").alias("severity"), F.lit("budget_exceeded").alias("code"), F.col("path").alias("file"), F.format_string("%d tokens, %d allowed", "n", "most").alias("message"))
    broken = gate.missing_files(links(files.where("path = 'SKILL.md'").select("content")), files).select(F.lit("error").alias("severity"), F.lit("broken_link").alias("code"), F.col("path").alias("file"), F.lit("no such chapter").alias("message"))
    low = anchor_ratio(files.where(F.col("path").startswith("chapters/"))).where("ratio < 0.5")
    low = low.select(F.lit("warning").alias("severity"), F.lit("low_anchor_ratio").alias("code"), F.col("path").alias("file"), F.format_string("%.2f of the lines", "ratio").alias("message"))
    return over.unionByName(broken).unionByName(low)
