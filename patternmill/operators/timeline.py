"""Ordered operations per key: lifecycles, value changes, repairs, change points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.functions import cells
from patternmill.operators.ordered import running_sums


def _ordered(key: str = "key") -> Window:
    return Window.partitionBy(key).orderBy("ts", "ord")


def changes(values: DataFrame) -> DataFrame:
    """Rows where a key's value differs from the one before; the first counts."""
    before = F.lag("v").over(_ordered())
    return values.withColumn("was", before).where(F.col("was").isNull() | (F.col("was") != F.col("v"))).select("key", "ord", "was", "v")


def lifecycle(values: DataFrame, churn_days: int = 14, fix: str = "error") -> DataFrame:
    """(key, first, last, mods, churn, fixes) per key."""
    w = Window.partitionBy("key")
    rows = values.withColumn("born", F.min("ts").over(w)).withColumn("was", F.lag("v").over(_ordered()))
    early = F.col("ts") <= F.col("born") + F.expr(f"INTERVAL {churn_days} DAYS")
    moved = F.col("was").isNotNull() & (F.col("was") != F.col("v"))
    return rows.groupBy("key").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(moved.cast("long")).alias("mods"), F.max((moved & early).cast("int")).alias("churn"), F.sum((F.col("v") == fix).cast("long")).alias("fixes"))


def held(values: DataFrame, expected: str) -> DataFrame:
    """Departures from and repairs to the expected value, per key."""
    rows = values.withColumn("was", F.lag("v").over(_ordered()))
    left = (F.col("was") == expected) & (F.col("v") != expected)
    back = (F.col("was") != expected) & (F.col("v") == expected)
    return rows.groupBy("key").agg(F.sum(F.coalesce(left, F.lit(False)).cast("long")).alias("departures"), F.sum(F.coalesce(back, F.lit(False)).cast("long")).alias("repairs"))


def rejected(values: DataFrame, expected: str, least: int = 5) -> DataFrame:
    """Other values than the expected one that enough keys tried, and at least two thirds of them gave up."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("ord")))
    final = values.withColumn("r", last).where("r = 1").select("key", F.col("v").alias("final"))
    tried = values.where(F.col("v") != expected).select("key", "v").distinct().join(final, "key")
    out = tried.groupBy("v").agg(F.count(F.lit(1)).alias("tried"), F.sum((F.col("v") != F.col("final")).cast("long")).alias("reverted"))
    return out.withColumn("rejected", (F.col("tried") >= least) & (F.col("reverted") * 3 >= F.col("tried") * 2))


def births(values: DataFrame) -> DataFrame:
    """(key, ts, v): the first value of each key."""
    return values.groupBy("key").agg(F.min(F.struct("ts", "ord", "v")).alias("b")).select("key", "b.ts", "b.v")


def change_point(values: DataFrame) -> DataFrame:
    """rows (ts, v): the best single cut of each value's sequence of observations, coded with the KT sequence code.

    An observation is a distinct (time, value); a cut never splits a time, and ``at`` is the first time after it. What
    two codes save over one pays for naming the cut. Fading: the value was the rule before and is it no longer.
    """
    obs = values.select("ts", "v").distinct()
    m = obs.groupBy("ts").agg(F.count(F.lit(1)).alias("m"))
    every = m.crossJoin(obs.select(F.col("v").alias("exp")).distinct())  # the result's grain: a cut for each value and time
    seq = every.join(obs.withColumnRenamed("v", "exp").withColumn("x", F.lit(1)), ["ts", "exp"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
    seq = running_sums(seq, "ts", {"a": "x", "n": "m"}, ("exp",))
    whole = seq.groupBy("exp").agg(F.sum("x").alias("all_a"), F.sum("m").alias("all_n"))
    cut = seq.where(F.col("n") > 0).join(whole, "exp")
    rest_a, rest_n = F.col("all_a") - F.col("a"), F.col("all_n") - F.col("n")
    two = cells.sequence_bits(F.col("a"), F.col("n")) + cells.sequence_bits(rest_a, rest_n)
    best = F.min(F.struct(F.round(two, 6).alias("bits"), "ts", "a", "n")).alias("best")
    cuts = cut.groupBy("exp").agg(F.count(F.lit(1)).alias("cuts"), F.max("all_a").alias("all_a"), F.max("all_n").alias("all_n"), best)
    gain = cells.sequence_bits(F.col("all_a"), F.col("all_n")) - F.col("best.bits") - F.log2(F.col("cuts").cast("double"))
    before, after = F.col("best.a") / F.col("best.n"), (F.col("all_a") - F.col("best.a")) / (F.col("all_n") - F.col("best.n"))
    still = cells.clears_loss(F.col("all_a") - F.col("best.a"), F.col("all_n") - F.col("best.n"))
    return cuts.select("exp", "cuts", F.col("best.ts").alias("at"), F.round(gain, 4).alias("gain"), (gain > 0).alias("moved"), ((gain > 0) & (after < before) & ~still).alias("fading"))


def author_concentration(rows: DataFrame, expected: str, least: int = 5) -> DataFrame:
    """rows (key, ts, ord, v, author): who last wrote the expected value, where it is still held."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("ord")))
    held = rows.withColumn("r", last).where((F.col("r") == 1) & (F.col("v") == expected))
    by = held.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("credited"))
    return by.crossJoin(F.broadcast(total)).select("author", "n", "credited", ((F.col("credited") >= least) & (3 * F.col("n") >= 2 * F.col("credited"))).alias("concentrated"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest rows by (ts, ord); a top-k, which Spark takes from each partition first."""
    return rows.orderBy(F.desc("ts"), F.desc("ord")).limit(n)


def ordinals(rows: DataFrame, by: list[str]) -> DataFrame:
    """The position of each row among those with the same ``by``, from 0."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "ord")) - 1)


def lineage(renames: DataFrame, paths: DataFrame, scratch: str, hops: int = 20) -> DataFrame:
    """paths (path) -> (path, current): follows renames (old, new) at most ``hops`` times, the last rename of a name first.

    Each hop is a join; names that have arrived drop out, and each hop's rest is written under ``scratch`` so that the
    plan stays short. A circle of renames ends at the hop limit.
    """
    spark = paths.sparkSession
    move = renames.groupBy("old").agg(F.max(F.struct("ts", "new")).alias("r")).select("old", F.col("r.new").alias("new"))
    here = paths.select("path", F.col("path").alias("current"))
    done = None
    for k in range(hops):
        step = here.join(move, here["current"] == move["old"], "left").select("path", F.coalesce("new", "current").alias("current"), F.col("new").isNotNull().alias("moved"))
        step.write.mode("overwrite").parquet(f"{scratch}/hop{k}")
        step = spark.read.parquet(f"{scratch}/hop{k}")
        ended = step.where("not moved").select("path", "current")
        done = ended if done is None else done.unionByName(ended)
        here = step.where("moved").select("path", "current")
        if here.isEmpty():
            return done
    return done.unionByName(here)
