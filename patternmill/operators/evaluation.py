"""Evaluation: rank measures with ties, partition comparison, association of marks, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.functions import cells
from patternmill.operators.ordered import running_sums


def auc(rows: DataFrame) -> DataFrame:
    """rows (score, y in 0/1) -> area under the ROC curve, ties at half. Scores are counted first."""
    by = rows.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    part = running_sums(by, "score", {"below": "q"}).withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2))
    out = part.agg(F.sum("won").alias("won"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return out.select("positives", "negatives", F.round(F.col("won") / (F.col("positives") * F.col("negatives")), 6).alias("auc"))


def precision_at(rows: DataFrame, share: float, order: str = "id") -> DataFrame:
    """rows (score, y, id): the rate of y among the highest ``share`` of scores, ties by id; at least one row counts."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    by = rows.groupBy("score").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"))
    by = running_sums(by.withColumn("down", -F.col("score").cast("double")), "down", {"above": "m"}).crossJoin(F.broadcast(total))
    take = F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1))
    whole = by.where(F.col("above") + F.col("m") <= take).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("taken"), F.coalesce(F.sum("s"), F.lit(0)).alias("hits"))
    cut = by.where((F.col("above") < take) & (F.col("above") + F.col("m") > take)).select("score", (take - F.col("above")).alias("rest"))  # one score at most
    edge = rows.join(F.broadcast(cut), "score").withColumn("k", F.row_number().over(Window.partitionBy("score").orderBy(order))).where(F.col("k") <= F.col("rest"))
    edge = edge.agg(F.count(F.lit(1)).alias("more"), F.coalesce(F.sum("y"), F.lit(0)).alias("more_hits"))
    return whole.crossJoin(edge).select((F.col("taken") + F.col("more")).alias("taken"), (F.col("hits") + F.col("more_hits")).alias("hits")).withColumn("precision", F.round(F.col("hits") / F.col("taken"), 6))


def contingency(rows: DataFrame) -> DataFrame:
    """rows (a, b) -> (a, b, n, na, nb, total)."""
    n = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    na, nb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    return n.join(na, "a").join(nb, "b").crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))


def partition_metrics(rows: DataFrame) -> DataFrame:
    """Conditional entropies both ways, variation of information, mutual information and purity of two partitions."""
    c = contingency(rows)
    p = F.col("n") / F.col("total")
    h = c.agg(F.sum(-p * F.log2(F.col("n") / F.col("na"))).alias("b_given_a"), F.sum(-p * F.log2(F.col("n") / F.col("nb"))).alias("a_given_b"),
              F.sum(p * F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mutual"))
    purity = c.groupBy("a").agg(F.max("n").alias("top"), F.max("total").alias("total")).agg((F.sum("top") / F.max("total")).alias("purity"))
    r = lambda x: F.round(x, 6)
    return h.crossJoin(purity).select(r("b_given_a").alias("b_given_a"), r("a_given_b").alias("a_given_b"), r(F.col("b_given_a") + F.col("a_given_b")).alias("vi"), r("mutual").alias("mutual"), r("purity").alias("purity"))


def partition_agreement(rows: DataFrame) -> DataFrame:
    """Normalised mutual information (geometric mean) and the adjusted Rand index of two partitions."""
    c = contingency(rows)
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    p = F.col("n") / F.col("total")
    both = c.agg(F.sum(p * F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mutual"), F.sum(pairs("n")).alias("nij"), F.max("total").alias("total"))
    side = lambda k, m, h, s: c.select(k, m, "total").distinct().agg(F.sum(-(F.col(m) / F.col("total")) * F.log2(F.col(m) / F.col("total"))).alias(h), F.sum(pairs(m)).alias(s))
    out = both.crossJoin(side("a", "na", "ha", "sa")).crossJoin(side("b", "nb", "hb", "sb"))
    chance = F.col("sa") * F.col("sb") / pairs("total")
    ari = (F.col("nij") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance)
    return out.select(F.round(F.col("mutual") / F.sqrt(F.col("ha") * F.col("hb")), 6).alias("nmi"), F.round(ari, 6).alias("ari"))


def odds_ratio(rows: DataFrame) -> DataFrame:
    """rows (x, y booleans) -> the four counts and the odds ratio with half a count added to each."""
    n = lambda x, y: F.sum(F.when((F.col("x") == x) & (F.col("y") == y), 1).otherwise(0))
    c = rows.agg(n(True, True).alias("tt"), n(True, False).alias("tf"), n(False, True).alias("ft"), n(False, False).alias("ff"))
    return c.withColumn("ratio", F.round((F.col("tt") + 0.5) * (F.col("ff") + 0.5) / ((F.col("tf") + 0.5) * (F.col("ft") + 0.5)), 6))


def spearman(rows: DataFrame) -> DataFrame:
    """rows (x, y) -> rank correlation with mean ranks for ties. Ranks come from counts of distinct values."""

    def ranks(c: str) -> DataFrame:
        n = running_sums(rows.groupBy(c).agg(F.count(F.lit(1)).alias("m")), c, {"before": "m"})
        return n.select(c, (F.col("before") + (F.col("m") + 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def partial_correlation(rows: DataFrame) -> DataFrame:
    """rows (x, y, z): correlation of x and y without what z explains of both."""
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"))
    r = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return c.select("n", F.round("xy", 6).alias("plain"), F.round(r, 6).alias("partial"))


def residuals(rows: DataFrame) -> DataFrame:
    """rows (id, x, y): y less its least-squares line on ln(1 + x)."""
    rows = rows.withColumn("lx", F.log1p("x"))
    line = rows.agg(F.regr_slope("y", "lx").alias("slope"), F.regr_intercept("y", "lx").alias("base"))
    return rows.crossJoin(F.broadcast(line)).select("id", F.round(F.col("y") - F.col("base") - F.col("slope") * F.col("lx"), 6).alias("residual"))


def excess_bits(rows: DataFrame, least: int = 5) -> DataFrame:
    """rows (grp, x): what each logarithmic bin of x costs a group against the other groups' rate of that bin."""
    c = rows.withColumn("bin", cells.log_bin(F.col("x")).cast("long")).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("k"))
    own, every = c.groupBy("grp").agg(F.sum("k").alias("n")), c.groupBy("bin").agg(F.sum("k").alias("all_k"))
    c = c.join(own, "grp").join(every, "bin").crossJoin(F.broadcast(c.agg(F.sum("k").alias("all_n")))).where(F.col("n") >= least)
    base = cells.kt(F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n"))
    return c.select("grp", "bin", "k", "n", F.round(cells.binary_gain(F.col("k"), F.col("n"), base) - cells.penalty(F.col("n")), 6).alias("bits"))


def calibration(rows: DataFrame) -> DataFrame:
    """rows (grp, hit boolean) -> hits, total and the lower Wilson bound of their rate."""
    c = rows.groupBy("grp").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("total"))
    return c.withColumn("low", F.round(cells.wilson_low(F.col("hits"), F.col("total")), 6))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found, truth (q, item) -> mean precision, recall and F1 over queries that have either."""
    both = found.distinct().withColumn("f", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["q", "item"], "full")
    q = both.groupBy("q").agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hit"))
    p = F.when(F.col("nf") > 0, F.col("hit") / F.col("nf")).otherwise(0.0)
    r = F.when(F.col("nt") > 0, F.col("hit") / F.col("nt")).otherwise(0.0)
    return q.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"), F.round(F.avg(2 * F.col("hit") / (F.col("nf") + F.col("nt"))), 6).alias("f1"))


def repaired_later(values: DataFrame, expected: str, horizon_days: int = 365, settle_days: int = 30) -> DataFrame:
    """values (key, ts, ord, v): departures from the expected value in the horizon, and how many were repaired since.

    Departures of the last ``settle_days`` don't count yet. One row with the Wilson bound of the rate.
    """
    w = Window.partitionBy("key").orderBy("ts", "ord")
    later = Window.partitionBy("key").orderBy("ts", "ord").rowsBetween(1, Window.unboundedFollowing)
    rows = values.withColumn("was", F.lag("v").over(w)).withColumn("back", F.max((F.col("v") == expected).cast("int")).over(later))
    now = values.agg(F.max("ts").alias("now"))
    left = rows.where((F.col("was") == expected) & (F.col("v") != expected)).crossJoin(F.broadcast(now))
    inside = (F.col("ts") > F.col("now") - F.expr(f"INTERVAL {horizon_days} DAYS")) & (F.col("ts") <= F.col("now") - F.expr(f"INTERVAL {settle_days} DAYS"))
    c = left.where(inside).agg(F.count(F.lit(1)).alias("departures"), F.coalesce(F.sum(F.coalesce("back", F.lit(0))), F.lit(0)).alias("repaired"))
    low = F.when(F.col("departures") > 0, cells.wilson_low(F.col("repaired"), F.col("departures")))
    return c.select("departures", "repaired", F.round(low, 6).alias("low"), ((F.col("departures") >= 35) & (F.coalesce(low, F.lit(0.0)) >= 0.9)).alias("may_deny"))


def hit_rates(ranked: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """ranked (q, item, rank), truth (q, item): share of queries with a true item in the first k, and mean reciprocal rank."""
    first = ranked.join(truth.distinct(), ["q", "item"]).groupBy("q").agg(F.min("rank").alias("first"))
    q = truth.select("q").distinct().join(first, "q", "left")
    return q.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.coalesce("first", F.lit(k + 1)) <= k).cast("double")), 6).alias("hit"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def matched_control(rows: DataFrame) -> DataFrame:
    """rows (id, size, marked, y): odds of y among marked rows and among the unmarked rows of the same size.

    Each marked size is weighted alike on both sides, so popularity doesn't explain the difference.
    """
    rows = rows.withColumn("bin", cells.log_bin(F.col("size")))
    c = rows.groupBy("bin").agg(*(F.sum(F.when(F.col("marked") == m, F.lit(1)).otherwise(0)).alias(f"n{int(m)}") for m in (True, False)), *(F.sum(F.when(F.col("marked") == m, F.col("y")).otherwise(0)).alias(f"y{int(m)}") for m in (True, False)))
    c = c.where((F.col("n0") > 0) & (F.col("n1") > 0))
    out = c.agg(F.sum("n1").alias("marked"), F.sum("y1").alias("hits"), F.sum(F.col("n1") * F.col("y0") / F.col("n0")).alias("expected"))
    return out.select("marked", "hits", F.round("expected", 6).alias("expected"), F.round((F.col("hits") + 0.5) / (F.col("expected") + 0.5), 6).alias("lift"))
