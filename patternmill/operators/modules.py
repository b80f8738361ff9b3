"""Module graphs: edges between groups, and norms of who reaches whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.functions import cells


def module_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges (src, dst, n), members (unit, module) -> (a, b, n, kinds): weight and distinct unit pairs between modules."""
    left = members.select(F.col("unit").alias("src"), F.col("module").alias("a"))
    right = members.select(F.col("unit").alias("dst"), F.col("module").alias("b"))
    joined = edges.join(left, "src").join(right, "dst")
    return joined.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))


def partition_score(edges: DataFrame, members: DataFrame) -> DataFrame:
    """How much of the weight stays inside a module."""
    graph = module_graph(edges, members)
    inside = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    return graph.agg(F.sum(inside).alias("inside"), F.sum("n").alias("total")).withColumn("share", F.round(F.col("inside") / F.col("total"), 6))


def norms(reach: DataFrame, members: DataFrame, least: int = 5) -> DataFrame:
    """reach (src, target): is reaching a target, or not reaching it, the rule inside a module and not outside?

    One row per module and target with ``least`` members on each side; every pair with enough outside it pays for the
    index. A norm saves bits, clears the loss bound, and its value is on the side the contrast points to.
    """
    reach = reach.select("src", "target").distinct()
    able = reach.select(F.col("src").alias("unit")).distinct().join(members, "unit")
    targets = reach.groupBy("target").agg(F.count(F.lit(1)).alias("all_k")).where(F.col("all_k") >= least)
    size = able.groupBy("module").agg(F.count(F.lit(1)).alias("na"))
    every = able.agg(F.count(F.lit(1)).alias("all_n"))
    hits = reach.join(members.withColumnRenamed("unit", "src"), "src").groupBy("module", "target").agg(F.count(F.lit(1)).alias("ka"))
    # a row for each module and target is the result's own grain
    rows = size.crossJoin(targets).crossJoin(F.broadcast(every)).join(hits, ["module", "target"], "left").withColumn("ka", F.coalesce("ka", F.lit(0)))
    rows = rows.withColumn("ko", F.col("all_k") - F.col("ka")).withColumn("no", F.col("all_n") - F.col("na")).where(F.col("no") >= least)
    rows = rows.crossJoin(F.broadcast(rows.agg(cells.index_cost(F.count(F.lit(1))).alias("idx")))).where(F.col("na") >= least)
    bits = cells.binary_bits(F.col("ka"), F.col("na"), cells.kt(F.col("ko"), F.col("no")), F.col("idx"))
    yes = F.col("ka") > F.col("na") - F.col("ka")
    more, less = F.col("ka") * F.col("no") > F.col("ko") * F.col("na"), F.col("ka") * F.col("no") < F.col("ko") * F.col("na")
    certified = (bits > 0) & cells.clears_loss(F.greatest(F.col("ka"), F.col("na") - F.col("ka")), F.col("na")) & F.when(yes, more).otherwise(less)
    return rows.select("module", "target", "ka", "na", "ko", "no", F.round(bits, 6).alias("bits"), F.when(yes, "true").otherwise("false").alias("expected"), certified.alias("certified"))
