"""The data source for files and the sink for bundles."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillgate.sinks import bundle
from quillgate.sources.documents import Share, read_documents, register


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("a.md", "# A\n\nBody."), ("b.txt", "x" * 100), ("deep/c.md", "é"), ("deep/.hidden", "")):
        (tmp_path / "in" / name).write_text(text)
    return str((tmp_path / "in").resolve())


def test_contents_are_read_only_when_asked_for(spark, folder):
    """A file that nobody may open is listed all the same, and fails once its content is wanted; filters that leave it out spare it. Access times tell the rest."""
    whole = {r.path.removeprefix(folder): (r.length, bytes(r.content)) for r in read_documents(spark, folder).collect()}
    assert whole == {"/a.md": (10, b"# A\n\nBody."), "/b.txt": (100, b"x" * 100), "/deep/c.md": (2, "é".encode()), "/deep/.hidden": (0, b"")}
    gone = os.path.join(folder, "z.md")
    os.mkfifo(os.path.join(os.path.dirname(folder), "pipe"))
    with open(gone, "w") as f:
        f.write("grows")
    listing = read_documents(spark, folder, contents=False)
    assert {r.path.removeprefix(folder): r.length for r in listing.collect()} == {k: n for k, (n, _) in whole.items()} | {"/z.md": 5}
    df = read_documents(spark, folder, mostEach=100)
    some = df.where((F.col("length") < 50) & F.col("path").endswith(".md") & ~F.col("path").contains("z"))
    assert sorted(r.path.removeprefix(folder) for r in some.collect()) == ["/a.md", "/deep/c.md"]
    assert [r.length for r in df.where(F.col("path") == gone).collect()] == [5]


def test_a_listing_opens_nothing(spark, folder, monkeypatch):
    from quillgate.sources import documents

    opened = []
    monkeypatch.setattr(documents, "content_of", lambda path, most: opened.append(path) or b"")
    reader = documents.FilesReader(spark.createDataFrame([], "path string, length long").schema, {"path": folder})
    assert len([row for share in reader.partitions() for row in reader.read(share)]) == 4 and not opened
    reader = documents.FilesReader(spark.createDataFrame([], documents.COLUMNS).schema, {"path": folder, "taskBytes": "20"})
    from pyspark.sql import datasource as D

    left = list(reader.pushFilters([D.GreaterThan(("length",), 50), D.IsNotNull(("path",)), D.EqualTo(("content",), b"")]))
    shares = reader.partitions()
    assert [type(f) for f in left] == [D.EqualTo] and [[os.path.basename(p) for p, _ in s.files] for s in shares] == [["b.txt"]]
    assert isinstance(shares[0], Share) and [r[1] for r in reader.read(shares[0])] == [0] and len(opened) == 1


def test_shares_and_limits(spark, folder):
    assert read_documents(spark, folder, taskBytes=1).rdd.getNumPartitions() == 4 and read_documents(spark, folder).rdd.getNumPartitions() == 1
    for option, kind in (("mostFiles", "too_many"), ("mostEach", "too_large"), ("mostTotal", "total_too_large")):
        with pytest.raises(PySparkException) as e:
            read_documents(spark, folder, contents=False, **{option: 2}).count()
        assert kind in str(e.value)
    os.symlink(folder, os.path.join(folder, "link"))
    with pytest.raises(PySparkException) as e:
        read_documents(spark, folder).count()
    assert ": link" in str(e.value)
    register(spark)
    assert spark.read.format("quillgate_files").load(os.path.join(folder, "a.md")).first().length == 10


def test_a_bundle_is_written_by_its_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"chapters/ch{k:02}.md", f"text {k} é") for k in range(40)] + [("SKILL.md", None)], "path string, content string").repartition(6)
    out = bundle.publish(files, {"version": 1}, tmp_path / "b")
    assert {r.path: r.content for r in bundle.read_bundle(spark, str(out)).collect()} == {r.path: r.content or "" for r in files.collect()}
    assert (out / "manifest.json").read_text() == '{\n  "version": 1\n}\n' and sorted(os.listdir(tmp_path)) == ["b"]
    with pytest.raises(bundle.PublishError) as e:
        bundle.publish(files, {}, out)
    assert e.value.kind == "already_exists"
    bundle.publish(files.where("path = 'SKILL.md'"), {}, out, force=True)
    assert sorted(os.listdir(out)) == ["SKILL.md", "manifest.json"]


@pytest.mark.parametrize("bad,kind", [("../x.md", "escapes"), ("chapters/ch01.md", "twice"), ("manifest.json", "twice")])
def test_refused_rows_leave_the_old_bundle(spark, tmp_path, bad, kind):
    files = spark.createDataFrame([(f"chapters/ch{k:02}.md", "t") for k in range(9)], "path string, content string").repartition(3)
    out = bundle.publish(files, {"n": 1}, tmp_path / "b")
    with pytest.raises(bundle.PublishError) as e:
        bundle.publish(files.unionByName(spark.createDataFrame([(bad, "new")], "path string, content string")), {"n": 2}, out, force=True)
    assert e.value.kind == kind and '"n": 1' in (out / "manifest.json").read_text() and len(os.listdir(out / "chapters")) == 9 and sorted(os.listdir(tmp_path)) == ["b"]


def test_a_failing_task_leaves_the_old_bundle(spark, tmp_path):
    files = spark.range(20).selectExpr("concat('f', id, '.md') AS path", "'old' AS content").repartition(4)
    out = bundle.publish(files, {}, tmp_path / "b")
    broken = files.select("path", F.when(F.col("path") == "f7.md", F.raise_error(F.lit("no such text"))).otherwise(F.lit("new")).alias("content"))
    with pytest.raises(Exception, match="no such text"):
        bundle.publish(broken, {}, out, force=True)
    assert {(out / f"f{k}.md").read_text() for k in range(20)} == {"old"} and sorted(os.listdir(tmp_path)) == ["b"]
