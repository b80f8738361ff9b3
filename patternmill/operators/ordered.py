"""Running sums over an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: str, values: dict[str, str], by: tuple[str, ...] = (), pieces: int = 1024) -> DataFrame:
    """rows with, for each ``values`` entry (name of the sum -> column), the sum over strictly smaller ``order``.

    One row per (by, order) is expected. The range of ``order`` (a number or a time) is cut into at most ``pieces`` equal
    pieces; sums of whole pieces are few and are summed first, the rest is a window within one piece.
    """
    x = F.col(order).cast("double") if dict(rows.dtypes)[order] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    rows = rows.withColumn("_x", x)
    ends = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * pieces), F.lit(pieces - 1))).otherwise(0)
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("_piece", at.cast("int")).drop("_lo", "_hi")  # one row of two numbers
    keys = [*by, "_piece"]
    whole = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"_{name}") for name, c in values.items()))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
    whole = whole.select(*keys, *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in values))
    within = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in values.items()}).join(whole, keys)
    rows = rows.withColumns({name: F.col(f"_{name}") + F.col(f"_in_{name}") for name in values})
    return rows.drop("_x", "_piece", *(f"_{n}" for n in values), *(f"_in_{n}" for n in values))
