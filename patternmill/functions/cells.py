"""Certification cells as Columns: a pattern is spoken of only where stating it shortens the description of the data.

Counts are coded with the Krichevsky-Trofimov estimator, a candidate pays half a BIC unit per parameter and one index
cost for its family, and a claim must also clear the loss bound.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LOSS = 8.0


def kt(count: Column, total: Column, kinds: Column | float = 2.0) -> Column:
    """Estimated rate of an outcome seen count times of total, with so many kinds of outcome."""
    k = F.lit(kinds) if isinstance(kinds, (int, float)) else kinds
    return (count + 0.5) / (total + k / 2)


def index_cost(candidates: Column) -> Column:
    return F.ceil(F.log2(F.greatest(candidates, F.lit(2)).cast("double")))


def clears_loss(count: Column, total: Column, kinds: Column | float = 2.0, loss: float = LOSS) -> Column:
    return kt(count, total, kinds) >= 1 - 1 / loss


def penalty(total: Column, kinds: Column | float = 2.0) -> Column:
    k = F.lit(kinds) if isinstance(kinds, (int, float)) else kinds
    return 0.5 * (k - 1) * F.log2(F.greatest(total, F.lit(2)).cast("double"))


def binary_gain(hits: Column, total: Column, base: Column) -> Column:
    """Bits saved on a binary sequence by its own rate against a given base rate."""
    own = kt(hits, total)
    return hits * F.log2(own / base) + (total - hits) * F.log2((1 - own) / (1 - base))


def binary_bits(hits: Column, total: Column, base: Column, index: Column) -> Column:
    return binary_gain(hits, total, base) - penalty(total) - index


def partner_base(partner_touches: Column, n: Column, others: Column, touches: Column) -> tuple[Column, Column]:
    """(smoothed, observed) chance that a basket of the unit's mean breadth holds the partner anyway."""
    slots, breadth = touches - n, others / n
    return 1 - F.pow(1 - (partner_touches + 0.5) / (slots + 1), breadth), 1 - F.pow(1 - partner_touches / slots, breadth)


def wilson_low(hits: Column, total: Column, z: float = 1.96) -> Column:
    p = hits / total
    return (p + z * z / (2 * total) - z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def log_bin(x: Column) -> Column:
    return F.floor(F.log2(1 + x))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, to about 1e-12: Stirling's series eight steps up, and the steps back."""
    x = x.cast("double")
    y = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(steps)


def sequence_bits(ones: Column, total: Column) -> Column:
    """Code length of one binary sequence with so many ones, by the sequential KT code."""
    ln = log_gamma(ones + 0.5) + log_gamma(total - ones + 0.5) - 1.1447298858494002 - log_gamma(total + 1)
    return -ln / 0.6931471805599453


def cluster_bits(n: Column, counts: Column) -> Column:
    """Description length of a cluster of n bags: an entropy code and half a log for each feature (array of counts)."""

    def entropy(c: Column) -> Column:
        p = c / n
        return F.when((c <= 0) | (c >= n), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))

    return F.aggregate(counts, F.lit(0.0), lambda s, c: s + n * entropy(c) + 0.5 * F.log2(n.cast("double")))


def percent(hits: Column, total: Column) -> Column:
    """A whole percentage that says 100 only of everything."""
    r = F.round(100 * hits / total).cast("long")
    return F.when((hits < total) & (r >= 100), 99).otherwise(r)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function, by Lentz's continued fraction over Arrow batches."""
    return F.pandas_udf(_beta_cdf, DoubleType())(x.cast("double"), a.cast("double"), b.cast("double"))


def _beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([incomplete_beta(p, q, r) for p, q, r in zip(x, a, b)], dtype=float)


def incomplete_beta(x: float, a: float, b: float) -> float:
    if not x > 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def all_given_most(rates: Column, least: Column) -> Column:
    """Chance that independent events of these rates (array) all happen, given that at least ``least`` of them do."""
    start = F.array(F.lit(1.0))
    # one step of the distribution of the number of events: p moves a case up, 1 - p keeps it
    step = lambda d, p: F.zip_with(F.concat(F.transform(d, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(d, lambda x: x * p)), lambda x, y: x + y)
    number = F.aggregate(rates, start, step)
    tail = F.aggregate(F.slice(number, least + 1, F.size(number)), F.lit(0.0), lambda x, y: x + y)
    return F.element_at(number, -1) / tail


def register(spark: SparkSession) -> None:
    """Make the cells callable from SQL: ``kt``, ``clears_loss``, ``partner_base``, ``wilson_low``, ``beta_cdf``."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("beta_cdf", F.pandas_udf(_beta_cdf, DoubleType()))


SQL_FUNCTIONS = {
    "kt": "(c DOUBLE, n DOUBLE, kinds DOUBLE) RETURNS DOUBLE RETURN (c + 0.5D) / (n + kinds / 2)",
    "clears_loss": "(c DOUBLE, n DOUBLE, kinds DOUBLE) RETURNS BOOLEAN RETURN (c + 0.5D) / (n + kinds / 2) >= 0.875D",
    "cell_bits": "(hits DOUBLE, n DOUBLE, base DOUBLE, idx DOUBLE) RETURNS DOUBLE RETURN hits * log2((hits + 0.5D) / (n + 1) / base) + (n - hits) * log2((1 - (hits + 0.5D) / (n + 1)) / (1 - base)) - 0.5D * log2(greatest(n, 2D)) - idx",
    "wilson_low": "(hits DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN (hits / n + 3.8416D / (2 * n) - 1.96D * sqrt(hits / n * (1 - hits / n) / n + 3.8416D / (4 * n * n))) / (1 + 3.8416D / n)",
}
