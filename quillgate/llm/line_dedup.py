"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key, n): in how many documents of its batches a line's 128-bit hash was seen. It is dealt by key into a store's buckets, one
file each, sorted by key, so that a batch dealt and sorted alike meets the runs in sort-merge anti-joins that neither move nor sort
a run: keys that are closed already (their count has reached the threshold in some run) go, and the rest becomes a run of level 0. `fanout` runs of a level
are merged into one of the next, counts summed, which deals their keys anew. Which runs there are stands in the store's folder, so a later
session opens it and goes on. At no time does a task hold more than a bounded buffer of keys.
"""

from __future__ import annotations

import json
import uuid
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, column, filesystem, noted, released, shared_folder, small_batches

WHITE = b" \t\n\x0b\x0c\r"
FLUSH_KEYS = 400_000
BROADCAST_KEYS = 200_000
BUCKET_KEYS = 4_000_000


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lowered; empty for a blank line."""
    return line.strip(WHITE).lower()


def _hash(key: bytes) -> bytes:
    return md5(key, usedforsecurity=False).digest()


def _texts(batch: pa.RecordBatch, step: int = 1000):
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield lo, part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def line_counts(docs: DataFrame, least_points: int = 1, batches: int = 1) -> DataFrame:
    """(batch, key, n): per line hash, the number of rows of docs(text, ...) that hold it; counted in the tasks, then summed. Rows are dealt to
    batches by a hash of doc_id and text."""

    def run(batches_):
        counts: dict[tuple[int, bytes], int] = {}

        def flush():
            keys = list(counts)
            for lo in range(0, len(keys), 50_000):
                part = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([k for _, k in part], pa.binary()), pa.array([counts[k] for k in part], pa.int64())], ["batch", "key", "n"])

        for whole in batches_:
            for _, part, texts in _texts(whole):
                for batch, text in zip(part.column("batch").to_pylist(), texts):
                    for key in {line_key(x) for x in text.split(b"\n")}:
                        if key and (least_points == 1 or len(key.decode("utf-8", "replace")) >= least_points):
                            at = batch, _hash(key)
                            counts[at] = counts.get(at, 0) + 1
                    if len(counts) >= FLUSH_KEYS:
                        yield from flush()
                        counts.clear()
        yield from flush()

    small_batches(docs.sparkSession)
    batch = F.pmod(F.xxhash64(column(docs, "doc_id", "bigint"), column(docs, "text", "string"), F.lit("lines")), F.lit(batches)).cast("int")
    rows = docs.select(batch.alias("batch"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(released(run), "batch int, key binary, n long").groupBy("batch", "key").agg(F.sum("n").alias("n"))


class LineRuns:
    """A store of runs below one shared folder. `buckets` stays as it is for the store's life: about one per BUCKET_KEYS distinct lines
    expected in it."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 4, folder: str | None = None, buckets: int = 8):
        self.spark, self.threshold, self.fanout, self.buckets = spark, threshold, fanout, buckets
        self.folder = folder or noted(shared_folder(spark, "lines"))
        self.levels: dict[int, list[str]] = {}
        self.tables: dict[str, str] = {}  # names in this session, by run
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one file a bucket, so its order is the bucket's

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "LineRuns":
        """The store that an earlier session left in a folder."""
        store, root = filesystem(folder)
        with store.open_input_file(f"{root}/store.json") as file:
            said = json.loads(file.read())
        out = cls(spark, said["threshold"], said["fanout"], folder, said["buckets"])
        out.levels = {int(level): runs for level, runs in said["levels"].items()}
        return out

    def _save(self) -> None:
        """The list of runs, put in place as a whole, after the runs it names."""
        store, root = filesystem(self.folder)
        store.create_dir(root, recursive=True)
        fresh = f"{root}/store.json.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as file:
            file.write(json.dumps({"threshold": self.threshold, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels}).encode())
        store.move(fresh, f"{root}/store.json")

    def _dealt(self, counts: DataFrame) -> DataFrame:
        return counts.select("key", "n").repartition(self.buckets, "key").sortWithinPartitions("key")

    def _write(self, dealt: DataFrame, level: int) -> None:
        run = f"run_{level}_{uuid.uuid4().hex}"
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{run}").format("parquet").saveAsTable(f"quillgate_{run}")
        self.tables[run] = f"quillgate_{run}"
        self.levels.setdefault(level, []).append(run)

    def _read(self, run: str) -> DataFrame:
        if run not in self.tables:  # made by another session
            name = f"quillgate_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (key BINARY, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def runs(self) -> list[str]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def fresh(self, counts: DataFrame) -> DataFrame:
        """The keys of a batch (key, n) that no run has closed, dealt and sorted as the runs are."""
        dealt = self._dealt(counts)
        for run in self.runs():
            dealt = dealt.join(self._read(run).where(F.col("n") >= self.threshold).hint("merge"), "key", "left_anti")
        return dealt

    def merged(self, runs: list[str]) -> DataFrame:
        """(key, n) of several runs, counts summed, dealt and sorted as runs are. Runs are read as plain files here, so the deal is made anew: a
        union of bucketed tables counts as dealt by key but does not bring their buckets together."""
        out = self.spark.read.schema("key binary, n long").parquet(*[f"{self.folder}/{run}" for run in runs])
        return out.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key")

    def add(self, counts: DataFrame) -> None:
        """One batch of (key, n)."""
        self._write(self.fresh(counts), 0)
        level, old = 0, []
        while len(self.levels.get(level, [])) >= self.fanout:
            old += (runs := self.levels.pop(level))
            self._write(self.merged(runs), level + 1)
            level += 1
        self._save()
        self._forget(old)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            if name := self.tables.pop(run, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs' names out of the session; the store stays in its folder."""
        self._forget(list(self.tables))

    def frequent(self) -> DataFrame:
        """(key): the lines found in at least `threshold` documents so far."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary")
        return self.merged(self.runs()).where(F.col("n") >= self.threshold).select("key")


def drop_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row of docs, without the lines whose hash is in frequent(key).

    Up to BROADCAST_KEYS keys go to the tasks; more are joined to the documents that hold them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    small = frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    shared = spark.sparkContext.broadcast({bytes(r["key"]) for r in frequent.collect()}) if small else None

    def run(batches):
        for batch in batches:
            for lo, part, texts in _texts(batch):
                own = part.column("bad").to_pylist() if not small else [shared.value] * len(texts)
                kept, counts, dropped = [], [], []
                for text, bad in zip(texts, own):
                    lines = text.split(b"\n")
                    bad = bad if small else set(bad or ())
                    rest = [x for x in lines if not ((k := line_key(x)) and _hash(k) in bad)]
                    kept.append(b"\n".join(rest))
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(rest))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                    ["doc_id", "text", "n_lines", "n_dropped"],
                )

    if not small:
        rows = rows.withColumn("at", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

        def held(batches):
            for batch in batches:
                for lo, part, texts in _texts(batch):
                    at = part.column("at").to_pylist()
                    found = [(a, _hash(k)) for a, t in zip(at, texts) for k in {line_key(x) for x in t.split(b"\n")} if k]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["at", "key"])

        bad = rows.select("at", "text").mapInArrow(released(held), "at binary, key binary").join(frequent, "key", "left_semi").groupBy("at").agg(F.collect_set("key").alias("bad"))
        rows = rows.join(bad, "at", "left").select("doc_id", "text", "bad")
    return rows.mapInArrow(released(run), "doc_id long, text string, n_lines long, n_dropped long")


def deduplicate_lines(docs: DataFrame, threshold: int = 10, least_points: int = 1, batches: int = 4) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row of docs(doc_id, text, ...): lines whose key stands in at least `threshold`
    documents lose all their copies everywhere; the other lines stay, joined by \\n.

    A key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lowered; keys shorter than `least_points` code points (and
    blank lines) always stay. Null or empty text is one empty line. Each row counts as a document, repeated rows and null doc_ids
    too. An empty table gives an empty result. The table goes in by `batches` batches of documents, as a growing
    corpus would.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counts = stored_by_batch(line_counts(docs, least_points, batches))
        keys = counts.count()
        runs = LineRuns(spark, threshold, buckets=min(1 << 16, max(8, -(-keys // BUCKET_KEYS))))
        for b in range(batches):
            runs.add(counts.where(F.col("batch") == b))
        frequent = scratch.keep(runs.frequent(), "frequent")
        runs.close()
    return drop_lines(docs, frequent)


def stored_by_batch(counts: DataFrame) -> DataFrame:
    """The counts of all batches from one pass over the documents, a folder a batch."""
    path = noted(shared_folder(counts.sparkSession, "counts"))
    counts.write.partitionBy("batch").parquet(path)
    return counts.sparkSession.read.schema("key binary, n long, batch int").parquet(path)
