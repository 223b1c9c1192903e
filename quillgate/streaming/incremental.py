"""Incremental recompiling: arriving files compared with what is known of them, in a table or in a stream's own state."""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.gate import difference
from ..operators.segment import keyed_sections


def changed_rows(known: DataFrame, arriving: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state) of the arriving rows that are unknown or changed against known(key, sha256)."""
    now = arriving.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"))
    return difference(known, now, key, "sha256").where("state <> 'missing'")


CHANGES = "path string, version long, id string, change string, sha256 string"


def _compared(known: dict[str, str], now: dict[str, str]) -> Iterator[tuple[str, str, str | None]]:
    """(id, change, sha256) in the order of ids: added, changed or removed."""
    for name in sorted(known.keys() | now.keys()):
        if name not in known:
            yield name, "added", now[name]
        elif name not in now:
            yield name, "removed", None
        elif known[name] != now[name]:
            yield name, "changed", now[name]


def section_changes(arriving: DataFrame) -> DataFrame:
    """A stream of (path, version, id, change, sha256) from a stream of arriving(path, seq, text): the sections that each version of a file adds, changes or removes.

    The state of a file is its latest version: the number of versions so far, the greatest `seq`, and its sections' ids and hashes, no texts. Versions of one batch are taken in the order of
    seq; one that isn't newer than what is known is late and changes nothing, so a batch that is run again after a restart says the same. A null text removes
    the file's sections. Texts are cut into sections before the shuffle, which carries ids and hashes alone.
    """
    rows = arriving.where("path is not null and seq is not null").select("path", F.col("seq").cast("bigint").alias("seq"), F.to_json(keyed_sections(F.col("text"))).alias("sections"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, last, known = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (0, None, {})
        out = []
        for seq, text in sorted(pair for frame in frames for pair in zip(frame["seq"], frame["sections"])):
            if last is not None and seq <= last:
                continue
            now = {s["id"]: s["sha256"] for s in json.loads(text or "[]")}
            version, last = version + 1, int(seq)
            out += [(key[0], version, *change) for change in _compared(known, now)]
            known = now
        state.update((version, last if last is not None else -1, json.dumps(known)))
        yield pd.DataFrame(out, columns=["path", "version", "id", "change", "sha256"])

    return rows.groupBy("path").applyInPandasWithState(run, CHANGES, "version long, seq long, sections string", "append", GroupStateTimeout.NoTimeout)


def event_rates(spark: SparkSession, folder: str, schema, pattern: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """A stream of (start, event_type, n, total) per window of a Parquet event stream."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
