"""Files as rows: listing, routing, limits, strict decoding and extraction, each failure kept as a row."""

from __future__ import annotations

from functools import reduce
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reflow import reflow
from ..operators.gate import first_limit_breach
from .parsers import PAGE
from .parsing import MEMORY, Child, Extractor

MOST_FILES, MOST_EACH, MOST_TOTAL = 500, 25 << 20, 100 << 20
DEADLINE = 60.0


# Folders that a listing passes over.
PASSED_OVER = {".git", "node_modules"}


class ListingError(ValueError):
    """A path that isn't read; `kind` is link, not_a_file, or a limit's name."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{path}: {kind}")
        self.kind, self.path = kind, path


def listed_files(*paths: str, most_files: int = MOST_FILES, most_each: int = MOST_EACH, most_total: int = MOST_TOTAL) -> Iterator[tuple[str, int]]:
    """(real path, size) of the files given and of all below the folders given, folder by folder. A given path may be a link; below it links and whatever is no plain
    file are refused. Limits are held by the sizes in the listing, before any file is opened."""
    import os
    import stat

    count = total = 0
    for given in paths:
        waiting = [os.path.realpath(given, strict=True)]
        while waiting:
            path = waiting.pop()
            found = os.lstat(path)
            if stat.S_ISLNK(found.st_mode):
                raise ListingError("link", path)
            if stat.S_ISDIR(found.st_mode):
                waiting += [os.path.join(path, name) for name in sorted(os.listdir(path), reverse=True) if name not in PASSED_OVER]
                continue
            if not stat.S_ISREG(found.st_mode):
                raise ListingError("not_a_file", path)
            count, total = count + 1, total + found.st_size
            for kind, over in (("too_many", count > most_files), ("too_large", found.st_size > most_each), ("total_too_large", total > most_total)):
                if over:
                    raise ListingError(kind, path)
            yield path, found.st_size


def list_files(*paths: str, **limits: int) -> list[str]:
    """The paths of `listed_files`, all of them or an error."""
    return [path for path, _ in listed_files(*paths, **limits)]


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, content): files and folders on any store that Spark reads, walked. Spark leaves out names that begin with . or _; on a local
    disk the data source in `documents` holds the whole policy for listings."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "content")


def limit_breaches(files: DataFrame) -> DataFrame:
    """The files over a limit, first in path order; reads lengths, not contents."""
    return first_limit_breach(files.select("path", "length"), "path", "length", MOST_FILES, MOST_EACH, MOST_TOTAL).where("breach is not null").orderBy("path").limit(1)


# The kinds of files that are read, in the order in which they are tried; `functions.text.route` states the same types and endings as a column.
EXTRACTORS = (
    Extractor("pdf", "quillgate.sources.parsers:pdf_text", ("application/pdf",), (".pdf",)),
    Extractor("docx", "quillgate.sources.parsers:docx_text", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (".docx",)),
    Extractor("text", "quillgate.sources.parsers:plain_text", ("text/plain", "text/markdown", "text/x-markdown"), (".txt", ".md", ".markdown")),
    Extractor("html", "quillgate.sources.parsers:html_text", ("text/html", "application/xhtml+xml"), (".html", ".htm")),
)


def routed(path: Column, mime: Column | None, extractors: Sequence[Extractor]) -> Column:
    """The kind of the first extractor that supports a file's type or its name's ending."""
    name, kind = F.lower(path), F.lower(mime) if mime is not None else F.lit("")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for e in extractors:
        fits = reduce(lambda a, b: a | b, [name.endswith(x.lower()) for x in e.endings], kind.isin(*e.types) if e.types else F.lit(False))
        out = out.when(fits, F.lit(e.kind))
    return out


def extract(files: DataFrame, extractors: Sequence[Extractor] = EXTRACTORS, seconds: float = DEADLINE, memory: int = MEMORY) -> DataFrame:
    """(path, kind, text, error) of files(path, content) or files(path, mime, content): exactly one of text and error is set.

    Further kinds of files are read by further extractors; those named first are tried first. Each task parses in a child process, so a parser that never ends, or takes
    all memory, costs its own file and no other.
    """
    parsers = {e.kind: e.parser for e in extractors}

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        child = Child(seconds, memory)
        try:
            for kinds, contents in pairs:
                found = [(None, "unsupported") if k is None else child.parse(parsers[k], c if c is not None else b"") for k, c in zip(kinds, contents)]
                yield pd.DataFrame(found, columns=["text", "error"])
        finally:
            child.stop()

    parse = F.pandas_udf(run, "text string, error string")
    kind = routed(F.col("path"), F.col("mime") if "mime" in files.columns else None, extractors)
    rows = files.select("path", kind.alias("kind"), "content").select("path", "kind", parse("kind", "content").alias("x"))
    return rows.select("path", "kind", F.when(F.col("kind") == "pdf", reflow(F.split("x.text", PAGE))).otherwise(F.col("x.text")).alias("text"), "x.error")


def first_error(extracted: DataFrame) -> DataFrame:
    """The first failing file in path order: it decides the outcome, whatever ran first."""
    return extracted.where("error is not null").orderBy("path").limit(1)
