"""The plain convention cube: unweighted counts at every level of context (see ``facts`` for weights and acceptance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.functions import cells

FALLBACK = ["other", "none", "mixed", "?"]


def contexts(scopes: DataFrame) -> DataFrame:
    """scopes with one row per context the scope counts in: all, its role, its directories."""
    ctx = F.array(
        F.struct(F.lit("_all").alias("cid"), F.lit("all").alias("level"), F.lit("").alias("up")),
        F.struct(F.concat(F.lit("r["), "role", F.lit("]")).alias("cid"), F.lit("role").alias("level"), F.lit("_all").alias("up")),
        F.struct(F.concat(F.lit("d["), "dir1", F.lit("]")).alias("cid"), F.lit("dir").alias("level"), F.lit("_all").alias("up")),
        F.struct(F.concat(F.lit("d["), "dir2", F.lit("]")).alias("cid"), F.lit("dir").alias("level"), F.lit("_all").alias("up")),
    )
    return scopes.select("scope", "kind", "pid", "v", F.explode(ctx).alias("c")).select("scope", "kind", "pid", "v", "c.cid", "c.level", "c.up")


def cube(scopes: DataFrame) -> DataFrame:
    """(cid, level, kind, pid, v, n): sparse counts; partial aggregation leaves few rows to shuffle."""
    return contexts(scopes).groupBy("cid", "level", "up", "kind", "pid", "v").agg(F.count(F.lit(1)).alias("n"))


def score(counts: DataFrame, least: int = 5) -> DataFrame:
    """Each cell's best value, the bits it saves, and whether both tests accept it.

    ``_all`` is coded against a uniform code over the alphabet; other contexts against the counts of what contains
    them. K counts the alphabet plus one unseen value.
    """
    cell = ["cid", "kind", "pid"]
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*cell)))
    alphabet = counts.select("pid", "v").distinct().groupBy("pid").agg(F.count(F.lit(1)).alias("B"))
    candidates = total.where(F.col("total") >= least).select(*cell).distinct().agg(F.count(F.lit(1)).alias("cells"))
    ref = total.where(F.col("level") == "all").select("kind", "pid", "v", F.col("n").alias("rn"), F.col("total").alias("rt"))
    rows = total.join(alphabet, "pid").join(ref, ["kind", "pid", "v"], "left")
    k = F.col("B") + 1
    own = cells.kt(F.col("n"), F.col("total"), k)
    against = F.when(F.col("level") == "all", 1 / F.greatest(F.col("B"), F.lit(2))).otherwise(cells.kt(F.col("rn"), F.col("rt"), k))
    rows = rows.withColumn("gain", F.col("n") * F.log2(own / against)).withColumn("K", k)
    best = F.struct((-F.col("n")).alias("o"), F.col("v").alias("v"))
    out = rows.groupBy(*cell, "level").agg(F.sum("gain").alias("data"), F.max("total").alias("total"), F.max("K").alias("K"), F.min(best).alias("b")).where(F.col("total") >= least)
    bits = F.col("data") - cells.penalty(F.col("total"), F.col("K")) - cells.index_cost(F.col("cells"))
    out = out.crossJoin(F.broadcast(candidates)).withColumn("bits", bits).withColumn("n", -F.col("b.o")).withColumn("v", F.col("b.v"))
    clears = cells.clears_loss(F.col("n"), F.col("total"), F.col("K"))
    return out.select(*cell, "level", F.col("v").alias("expected"), "n", "total", F.round("bits", 6).alias("bits"), clears.alias("clears"), ((F.col("bits") > 0) & clears & ~F.col("v").isin(FALLBACK)).alias("certified"))


def governing(scopes: DataFrame, counts: DataFrame) -> DataFrame:
    """How many scopes each context governs, by property."""
    total = counts.groupBy("cid", "level", "kind", "pid").agg(F.sum("n").alias("total"))
    order = F.when(F.col("level") == "role", 0).when(F.col("level") == "dir", 1).otherwise(2)
    seen = contexts(scopes).drop("level", "up").join(total, ["cid", "kind", "pid"])
    rank = F.row_number().over(Window.partitionBy("scope", "pid").orderBy("total", order, "cid"))
    return seen.withColumn("rank", rank).where(F.col("rank") == 1).groupBy("cid", "pid").agg(F.count(F.lit(1)).alias("governed"))
