"""How the plan of many bundles reads their chapters."""

from pyspark.sql import functions as F

from quillgate.operators import markers


def test_listings_share_a_pass(spark):
    """Patterns and rules come of one pass over the chapters, and chapters dealt by bundle aren't dealt again."""
    body = F.concat(F.lit("**Hive**  — home\n- [RULE] Knock "), F.col("id").cast("string"), F.lit(".\n- [pattern] wait\n* no mark\n - [Anti-Pattern] shout — 벌"))
    chapters = spark.range(40).select((F.col("id") % 7).alias("bundle"), F.col("id").cast("int").alias("chapter_pos"), F.concat(F.lit("On bees "), F.col("id").cast("string")).alias("title"), F.array(F.lit("s")).alias("section_ids"), body.alias("body"))
    bundles = spark.createDataFrame([(k, f"b-{k}", f"B {k}", True) for k in range(9)], "bundle long, slug string, title string, verified boolean")
    files = markers.assemble_many(bundles, chapters)
    assert files._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 4
    found = {(x.bundle, x.path): x for x in files.collect()}
    assert len(found) == 40 + 9 * 4
    for k in range(7):
        lines = lambda what: "\n".join(f"- {what.format(i)} (`chapters/ch{i:02d}-on-bees-{i}.md`)" for i in range(k, 40, 7))
        assert found[k, "cheatsheet.md"].content == f"# Cheatsheet\n\n{lines('Knock {}.')}\n"
        text = f"# Patterns\n\n## Patterns\n\n{lines('wait')}\n\n## Anti-patterns\n\n{lines('shout — 벌')}\n"
        assert found[k, "patterns.md"].content == text
        cjk = text.count("벌")
        assert found[k, "patterns.md"].est_tokens == cjk + -(-(len(text) - cjk) // 4)
    assert found[8, "patterns.md"].content == "# Patterns\n\n(no patterns extracted.)\n" and found[8, "cheatsheet.md"].content == "# Cheatsheet\n\n(no rules extracted.)\n"
