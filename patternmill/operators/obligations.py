"""Birth obligations: what else changes when an entity of a class is born, and how well the past foretells it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.functions import cells


def birth_obligations(touches: DataFrame, births: DataFrame, live: DataFrame | None = None, least: int = 5) -> DataFrame:
    """touches (sha, unit, cls) and births (sha, unit, cls) -> scored (cls, unit) pairs.

    A birth event is a change that brings a class something new; it counts once however many it brings. Every unit of
    another class in the same change is a candidate, coded against its own rate over all changes. Rules save bits and
    clear the loss bound; what fails but is in nearly every change anyway is ambient.
    """
    touches = touches.select("sha", "unit", "cls").distinct()
    events = births.select("sha", "cls").distinct()
    n = events.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    every = touches.agg(F.countDistinct("sha").alias("changes"))
    rate = touches.select("sha", "unit").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("gp"))
    other = touches.select("sha", "unit", F.col("cls").alias("own"))
    co = events.join(other, "sha").where(F.col("own") != F.col("cls")).groupBy("cls", "unit").agg(F.count(F.lit(1)).alias("k"))
    idx = co.agg(cells.index_cost(F.count(F.lit(1))).alias("idx"))
    if live is not None:
        co = co.join(live.select("unit").distinct(), "unit", "left_semi")
    rows = co.join(n, "cls").where(F.col("n") >= least).join(rate, "unit").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(idx))
    bits = cells.binary_bits(F.col("k"), F.col("n"), cells.kt(F.col("gp"), F.col("changes")), F.col("idx"))
    rule = (bits > 0) & cells.clears_loss(F.col("k"), F.col("n"))
    return rows.select("cls", "unit", "k", "n", "gp", F.round(bits, 6).alias("bits"), rule.alias("rule"), (~rule & cells.clears_loss(F.col("gp"), F.col("changes"))).alias("ambient"))


def first_touches(touches: DataFrame) -> DataFrame:
    """touches (sha, ts, unit, cls): the change in which each unit first appears, by time and sha."""
    first = F.min(F.struct("ts", "sha")).alias("f")
    return touches.groupBy("unit", "cls").agg(first).select(F.col("f.sha").alias("sha"), "unit", "cls")


def split_by_time(baskets: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """baskets (sha, ts, unit) -> the first ``share`` of the changes, and the rest; ordered by time and sha.

    The cut is found from counts of times, so no task orders all changes: only those of one time are numbered.
    """
    from patternmill.operators.ordered import running_sums

    shas = baskets.select("sha", "ts").distinct()
    at = running_sums(shas.groupBy("ts").agg(F.count(F.lit(1)).alias("m")), "ts", {"before": "m"}).select("ts", "before")
    place = F.col("before") + F.row_number().over(Window.partitionBy("ts").orderBy("sha")) - 1
    total = shas.agg(F.count(F.lit(1)).alias("N"))
    placed = shas.join(at, "ts").withColumn("place", place).crossJoin(F.broadcast(total)).withColumn("train", F.col("place") < F.floor(F.col("N") * share)).select("sha", "train")
    rows = baskets.join(placed, "sha")
    return rows.where("train").drop("train"), rows.where("not train").drop("train")


def prospective(named: DataFrame, later: DataFrame, hottest: DataFrame, k: int = 3, low: int = 2, high: int = 40) -> DataFrame:
    """named (a, b, rank): partners foretold from the past; later (sha, unit): changes that came; hottest (unit, hot).

    A case is a unit of a later change of ``low`` to ``high`` units; it is a hit if one of the first k partners is in
    the change too, and not obvious if that one isn't among the ten units touched most.
    """
    fit = later.select("sha", "unit").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("breadth")).where(F.col("breadth").between(low, high))
    rows = later.select("sha", "unit").distinct().join(fit, "sha")
    top = named.where(F.col("rank") <= k).join(hottest.select(F.col("unit").alias("b"), "hot"), "b", "left")
    asked = rows.join(top, rows["unit"] == top["a"], "left")
    there = rows.select("sha", F.col("unit").alias("b")).withColumn("there", F.lit(1))
    asked = asked.join(there, ["sha", "b"], "left")
    hit = F.max(F.coalesce("there", F.lit(0)))
    case = asked.groupBy("sha", "unit").agg(F.max(F.col("b").isNotNull().cast("int")).alias("named"), hit.alias("hit"), F.max(F.when(F.col("rank") == 1, F.coalesce("there", F.lit(0)))).alias("first"),
                                            F.max(F.when(F.coalesce("hot", F.lit(99)) > 10, F.coalesce("there", F.lit(0))).otherwise(0)).alias("subtle"))
    return case.agg(F.count(F.lit(1)).alias("cases"), F.sum("named").alias("named"), F.sum("hit").alias("hits"), F.sum(F.coalesce("first", F.lit(0))).alias("first_hits"), F.sum("subtle").alias("subtle_hits"))
