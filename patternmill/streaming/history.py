"""Histories that arrive in batches: additive folds and keyed state that end where one pass over everything ends.

Renames change a path's name, not its state: state is keyed by lineage, so rename events are resolved before (see
``operators.timeline.lineage``). Events of a key may not arrive before older ones of it; a history that diverged is
folded anew from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

LIFE = "key string, first timestamp, last timestamp, mods long, fixes long, churn boolean, v string"
CHANGE = "key string, ts timestamp, was string, v string"
LIVES = "first long, last long, until long, mods long, fixes long, churn boolean, v string"
#: Events of one key that follow each other: times of the first event, the first and last one with a time (microseconds),
#: until when a change counts as churn, the first change, how many changes and fixes, the values at both ends. Events without
#: a time are older than those of their batch.
STRETCH = "bucket int, key string, start long, first long, last long, until long, moved long, mods long, fixes long, was string, v string"


def stretches(events: pa.Table, fix: str) -> pa.Table:
    """Events (bucket, key, at, until, ord, v) of whole keys -> a stretch for each key, in passes over all keys at once."""
    events = events.take(pc.sort_indices(events, [(c, "ascending") for c in ("key", "at", "ord")], null_placement="at_start"))
    codes = lambda c: pc.dictionary_encode(events[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
    key, v, none = codes("key"), codes("v"), np.iinfo(np.int64).max
    at = pc.fill_null(events["at"], none).to_numpy()
    born = np.r_[True, key[1:] != key[:-1]]
    changed = ~born & np.r_[False, v[1:] != v[:-1]]
    starts = np.flatnonzero(born)
    ends = np.r_[starts[1:], len(key)] - 1
    total = lambda marks: np.add.reduceat(marks.astype(np.int64), starts)
    moved = np.minimum.reduceat(np.where(changed, at, none), starts)
    head, tail, timed = events.take(starts), events.take(ends), events.take(np.minimum(starts + total(at == none), ends))
    return pa.table({
        "bucket": head["bucket"], "key": head["key"], "start": head["at"], "first": timed["at"], "last": tail["at"], "until": timed["until"], "moved": pa.array(moved, mask=moved == none),
        "mods": total(changed), "fixes": total(pc.fill_null(pc.equal(events["v"], fix), False).to_numpy()), "was": head["v"], "v": tail["v"],
    })


class Lifecycle(StatefulProcessor):
    """State of the keys of a bucket: first and last time, value, how often it changed, how many fixes, changes after birth."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("lives", "key string", LIVES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:  # noqa: N802
        known = self.state.exists()
        for r in rows:
            old = self.state.getValue((r.key,)) if known else None
            first, last, until, mods, fixes, churn, v = old or (None, None, None, 0, 0, False, r.was)
            if first is None:
                first, until = r.first, r.until
            early = lambda ts: ts is not None and until is not None and ts <= until  # noqa: B023, E731
            churn = churn or early(r.moved) or (r.was != v and early(r.start))
            life = (first, last if r.last is None else r.last, until, mods + r.mods + (r.was != v), fixes + r.fixes, churn, r.v)
            self.state.updateValue((r.key,), life)
            yield Row(key=r.key, first=life[0], last=life[1], mods=life[3], fixes=life[4], churn=churn, v=r.v)

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, fix: str = "error", churn_days: int = 14, buckets: int = 4096) -> DataFrame:
    """A stream of (key, ts, ord, v) -> the state of each key that a batch touched, in update mode.

    Keys are dealt into buckets, as many for all batches of a checkpoint. A batch's events are joined to one stretch for
    each key, all keys of a bucket at once; state then has a key's stretch for its events. A task holds one bucket's
    events of one batch. Needs the RocksDB state store, which keeps state on disk: it may grow beyond memory.
    """
    ts, bucket = F.col("ts").cast("timestamp"), F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")
    rows = events.withColumn("key", F.col("key").cast("string")).select(bucket, "key", F.unix_micros(ts).alias("at"), F.unix_micros(ts + F.expr(f"INTERVAL {churn_days} DAYS")).alias("until"), "ord", "v")
    joined = rows.groupBy("bucket").applyInArrow(lambda table: stretches(table, fix), STRETCH)
    lives = joined.groupBy("bucket").transformWithState(Lifecycle(), LIFE.replace("timestamp", "long"), "Update", "None")
    return lives.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def fold(events: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a table of additive aggregates. ``merge(old or None, batch)`` gives the new table.

    Every version is written beside the last one under the batch's number and named by what a reader reads last, so a
    batch that is run again after a failure overwrites its own version and starts from the same one as before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, folder, below=number)
        merge(old, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version of a folded table, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [n for n in found if below is None or n < below]
    return spark.read.parquet(f"{folder}/v{max(found)}") if found else None


def merge_counts(keys: list[str], sums: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for additive counters: rows of both are added up by key."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch if old is None else old.select(*keys, *sums).unionByName(batch.select(*keys, *sums))
        return new.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    return merge


def pair_counts(low: int = 2, high: int = 30) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for pair support: each batch of whole baskets (sha, unit) adds its pairs."""
    from patternmill.operators import cochange

    add = merge_counts(["a", "b"], ["sup"])

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return add(old, cochange.pair_support(cochange.bounded_baskets(batch.distinct(), low, high), 1))

    return merge


def resume_mode(stored: dict | None, head: str, is_ancestor: Callable[[str, str], bool], version: int) -> str:
    """What a new run must do with stored state: ``unchanged``, ``incremental`` from its head, or ``full``."""
    if not stored or stored.get("version") != version or not stored.get("head"):
        return "full"
    if stored["head"] == head:
        return "unchanged"
    return "incremental" if is_ancestor(stored["head"], head) else "full"


def once_in(events: DataFrame, minutes: int = 15) -> DataFrame:
    """A stream of (key, ts): each key once in ``minutes`` of event time; later repeats are let through again."""
    every = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", f"{minutes} minutes").withColumn("slot", every.start).dropDuplicatesWithinWatermark(["key", "slot"]).drop("slot")
