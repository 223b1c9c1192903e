"""Changes of sections in a stream, over batches and a restart."""

from quillgate.streaming.incremental import section_changes

FIELDS = "path string, seq long, text string"


def test_section_changes_over_a_restart(spark, tmp_path):
    """Three batches, the query stopped and started again between them; a version that comes late, and one that comes twice, change nothing."""
    batches = [
        [("a.md", 1, "# Hive\n\nOld words.\n\n## Wax\n\nSame."), ("b.md", 1, "Only a start."), ("c.md", 1, None), (None, 1, "x")],
        [("a.md", 3, "# Hive\n\nNew words.\n\n## Comb\n\nMade."), ("a.md", 2, "# Hive\n\nBetween.\n\n## Wax\n\nSame."), ("b.md", 1, "late words here")],
        [("a.md", 2, "# Gone\n\nLate."), ("b.md", 2, None), ("c.md", 2, "# C\n\nFirst body.\n\n# C\n\nSecond body."), ("a.md", 3, "# Again\n\nTwice.")],
    ]
    want = [
        {("a.md", 1, "hive", "added"), ("a.md", 1, "hive/wax", "added")} | {("b.md", 1, "section", "added")},
        {("a.md", 2, "hive", "changed"), ("a.md", 3, "hive", "changed"), ("a.md", 3, "hive/wax", "removed"), ("a.md", 3, "hive/comb", "added")},
        {("b.md", 2, "section", "removed"), ("c.md", 2, "c", "added"), ("c.md", 2, "c-2", "added")},
    ]
    batches[0][1] = ("b.md", 1, "Only a start.\nAnd more of it.")
    source, out, kept = (str(tmp_path / name) for name in ("in", "out", "kept"))
    seen: set = set()
    for batch, changes in zip(batches, want):
        spark.createDataFrame(batch, FIELDS).coalesce(1).write.mode("append").json(source)
        arriving = spark.readStream.schema(FIELDS).json(source)
        query = section_changes(arriving).writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        assert query.exception() is None
        rows = {(r.path, r.version, r.id, r.change) for r in spark.read.parquet(out).collect()}
        assert rows - seen == changes
        seen = rows
    hashes = {(r.id, r.version): r.sha256 for r in spark.read.parquet(out).where("path = 'a.md'").collect()}
    assert hashes["hive", 1] != hashes["hive", 2] and hashes["hive/wax", 3] is None
