"""Files and folders as a data source: spark.read.format("quillgate_files").

`register(spark)` makes the format known. Options: path, or paths (a JSON list); mostFiles, mostEach, mostTotal (limits of a listing, held by sizes before any file is
opened); taskBytes (what a task reads, about). Columns: path, length, content; a schema without content makes a listing, for which no file is opened.
Filters on path and length are applied to the listing, so that files they refuse aren't opened either.
"""

from __future__ import annotations

import json
import os
from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .files import MOST_EACH, MOST_FILES, MOST_TOTAL, ListingError, listed_files

COLUMNS = "path string, length long, content binary"
TASK_BYTES = 32 << 20
_TESTS = {
    D.EqualTo: lambda v, x: v == x, D.In: lambda v, x: v in x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x,
    D.LessThanOrEqual: lambda v, x: v <= x, D.StringStartsWith: lambda v, x: v.startswith(x), D.StringEndsWith: lambda v, x: v.endswith(x), D.StringContains: lambda v, x: x in v,
}


class Share(D.InputPartition):
    """The files of one task: (path, size in the listing)."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def content_of(path: str, most: int) -> bytes:
    """A plain file's bytes, no link followed; more than `most` of them are an error, whatever its listing said."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(handle, "rb") as f:
        content = f.read(most + 1)
    if len(content) > most:
        raise ListingError("too_large", path)
    return content


class FilesReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        unknown = set(self.columns) - {"path", "length", "content"}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.most = {k: int(options.get(o, d)) for k, o, d in (("most_files", "mostFiles", MOST_FILES), ("most_each", "mostEach", MOST_EACH), ("most_total", "mostTotal", MOST_TOTAL))}
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("path",), ("length",)) and type(f) in _TESTS:
                self.tests.append((column[0], type(f), f.value))
            elif not (column in (("path",), ("length",)) and isinstance(f, D.IsNotNull)):  # neither is ever null
                yield f

    def partitions(self) -> Sequence[D.InputPartition]:
        """The listing in shares of about `task_bytes`, in its order. Limits hold for the whole listing, filters then choose from it."""
        shares: list[list[tuple[str, int]]] = []
        held = 0
        for path, size in listed_files(*self.paths, **self.most):
            row = {"path": path, "length": size}
            if all(_TESTS[kind](row[c], v) for c, kind, v in self.tests):
                if not shares or held + size > self.task_bytes:
                    shares.append([])
                    held = 0
                shares[-1].append((path, size))
                held += size
        return [Share(s) for s in shares] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, size in partition.files:
            row = {"path": path, "length": size}
            if "content" in self.columns:
                row["content"] = content_of(path, self.most["most_each"])
                row["length"] = len(row["content"])
            yield tuple(row[c] for c in self.columns)


class Files(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillgate_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_documents(spark: SparkSession, *paths: str, contents: bool = True, **options) -> DataFrame:
    """(path, length, content) of local files and folders, or the listing alone."""
    register(spark)
    reader = spark.read.format(Files.name()).option("paths", json.dumps(list(paths))).options(**options)
    return (reader if contents else reader.schema("path string, length long")).load()
