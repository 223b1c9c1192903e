"""Shared-folder tables and Arrow helpers used by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a folder of our own is chosen for the life of this process, but only where driver and
    executors are one process; elsewhere each machine would have its own, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if "root" not in _own:
            _own["root"] = tempfile.mkdtemp(prefix="quillgate-")
        root = _own["root"]
    return f"{root.rstrip('/')}/quillgate/{label}-{uuid.uuid4().hex}"


_own: dict[str, str] = {}
_scopes: list["Scratch"] = []


class Scratch:
    """While open, notes the folders that `stored` and others make, and deletes them at its end; what is given to `keep` outlives it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], None

    def __enter__(self) -> "Scratch":
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)
        for path in self.made:
            remove(self.spark, path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """The frame stored in the scope around this one; `kept` names its folder."""
        inner = _scopes[_scopes.index(self) :]
        del _scopes[-len(inner) :]
        try:
            self.kept = shared_folder(self.spark, label)
            return _written(df, noted(self.kept))
        finally:
            _scopes.extend(inner)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark itself writes it with."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def noted(path: str) -> str:
    """The path, which the innermost open Scratch will delete."""
    if _scopes:
        _scopes[-1].made.append(path)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: its lineage ends there."""
    return _written(df, noted(shared_folder(df.sparkSession, label)))


def filesystem(uri: str):
    """(file system, path) of a folder on any store that Arrow can write."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Bounds what goes to a Python worker at once by bytes; by default only rows are counted, so long texts make batches of any size.
    A limit that the session already has stays. Every operator that sends texts to Python calls this first."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, limit)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of finished queries now, not at the driver's next collection: a
    driver with little to do may not collect for long, and the files stay as long as the plans do. What the driver has freed goes back to the
    system: the collection shrinks the Java heap, and the C library's free lists of both processes are trimmed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str):
    """A named column, or a typed null where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def trim() -> None:
    """Gives the memory that this process has freed, in Arrow's pool or the C library's, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def _trim_jvm(spark: SparkSession) -> None:
    """`trim` for the driver's JVM: what its compiler, collector and buffers took from the C library and have freed. Hundreds of queries leave hundreds
    of MB there. The JVM offers it as a management operation; one without it is left alone."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    args = gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = gateway.new_array(jvm.Object, 0), gateway.new_array(jvm.String, 0)
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def released(run):
    """A mapInArrow function that gives freed memory back to the system at its end, as workers live on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def judged(run):
    """A boolean column function from `run`, which makes one array of booleans from each array of texts. Rows stay in the JVM, so that Python
    sees one column and answers with flags, however wide or long the rows are."""

    def wrapped(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)
        trim()

    return F.arrow_udf(wrapped, "boolean")


def text_buffers(column_, step: int = 1 << 20):
    """Yield (first row, row count, bytes, offsets) over slices of an Arrow string column of about `step` bytes.

    Slicing bounds the temporary arrays of the numpy kernels; a single longer text forms a slice of its own.
    """
    chunks = column_.chunks if hasattr(column_, "chunks") else [column_]
    row = 0
    for chunk in chunks:
        n = len(chunk)
        if n:
            validity, offset_buffer, data_buffer = chunk.buffers()
            wide = np.int64 if str(chunk.type).startswith("large") else np.int32
            offsets = np.frombuffer(offset_buffer, wide)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
            data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
            if chunk.null_count:  # the bytes behind a null are not defined
                lengths = np.where(np.asarray(chunk.is_valid()), np.diff(offsets), 0)
                if int(lengths.sum()) != int(offsets[-1] - offsets[0]):
                    data = np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], lengths)] or [data[:0]])
                    offsets = np.concatenate([[0], np.cumsum(lengths)])
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
                hi = min(hi, n)
                yield row + lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lo = hi
        row += n
