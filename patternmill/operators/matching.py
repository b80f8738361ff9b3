"""Sets compared with sets: best matches, ledgers of what stays and goes, purity of splits, matching prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right (id, item) -> (a, b, shared, na, nb) for sets that share an item; an equality join on the items."""
    left, right = left.distinct(), right.distinct()
    na = left.groupBy(F.col("id").alias("a")).agg(F.count(F.lit(1)).alias("na"))
    nb = right.groupBy(F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("nb"))
    both = left.select(F.col("id").alias("a"), "item").join(right.select(F.col("id").alias("b"), "item"), "item").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(na, "a").join(nb, "b")


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    rows = shared(left, right).withColumn("j", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6))
    return rows.where(F.col("j") > least).select("a", "b", "shared", "j")


def best_matches(left: DataFrame, right: DataFrame, hit: float = 0.5) -> DataFrame:
    """Each set of ``left`` with the most alike set of ``right``, ties by name; null where none shares an item."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("j"), "b"))
    best = jaccard_pairs(left, right).withColumn("r", rank).where("r = 1").select("a", "b", "j")
    every = left.select(F.col("id").alias("a")).distinct()
    return every.join(best, "a", "left").select("a", "b", F.coalesce("j", F.lit(0.0)).alias("j"), (F.coalesce("j", F.lit(0.0)) >= hit).alias("hit"))


def ledger(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What both have, what only one has: the keys with ``kept``, ``dropped`` or ``added``."""
    a, b = before.select(*keys).distinct().withColumn("_a", F.lit(1)), after.select(*keys).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "dropped").otherwise("kept")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def fates(before: DataFrame, after: DataFrame, hit: float = 0.5) -> DataFrame:
    """What became of each set: kept under its name, renamed, merged with others, split, or gone."""
    fwd = best_matches(before, after, hit).where("hit").select("a", "b")
    back = best_matches(after, before, hit).where("hit").select(F.col("b").alias("a"), F.col("a").alias("b"))
    into = fwd.groupBy("b").agg(F.count(F.lit(1)).alias("into"))
    out = back.groupBy("a").agg(F.count(F.lit(1)).alias("out"))
    rows = before.select(F.col("id").alias("a")).distinct().join(fwd, "a", "left").join(into, "b", "left").join(out, "a", "left")
    state = F.when(F.col("out") > 1, "split").when(F.col("b").isNull(), "gone").when(F.col("into") > 1, "merged").when(F.col("a") == F.col("b"), "kept").otherwise("renamed")
    return rows.select("a", "b", state.alias("state"))


def split_purity(rows: DataFrame) -> DataFrame:
    """rows (parent, part, v): how pure each part is beside its parent, and whether it is strictly purer."""
    n = rows.groupBy("parent", "part", "v").agg(F.count(F.lit(1)).alias("n"))
    part = n.groupBy("parent", "part").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    whole = n.groupBy("parent", "v").agg(F.sum("n").alias("m")).groupBy("parent").agg(F.sum("m").alias("pn"), F.max("m").alias("ptop"))
    own, up = F.col("top") / F.col("n"), F.col("ptop") / F.col("pn")
    return part.join(whole, "parent").select("parent", "part", "n", F.round(own, 6).alias("purity"), F.round(up, 6).alias("parent_purity"), (F.col("top") * F.col("pn") > F.col("ptop") * F.col("n")).alias("purer"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """paths (path), prefixes (prefix, part) -> each path's part by its longest directory prefix, or null."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = paths.distinct().select("path", F.explode(up).alias("prefix")).join(prefixes, "prefix")
    best = rows.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("o"), "prefix", "part")).alias("b"))
    return paths.distinct().join(best, "path", "left").select("path", F.col("b.prefix").alias("prefix"), F.col("b.part").alias("part"))


def range_counts(rows: DataFrame, begin, end) -> DataFrame:
    """rows (ts, grp): how often each group comes in [begin, end) and in the window of the same length before it."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = F.unix_micros(F.lit(begin).cast("timestamp")), F.unix_micros(F.lit(end).cast("timestamp"))
    inside, before = (t >= lo) & (t < hi), (t >= lo - (hi - lo)) & (t < lo)
    by = rows.where(inside | before).groupBy("grp").agg(F.sum(inside.cast("long")).alias("now"), F.sum(before.cast("long")).alias("base"))
    return by.withColumn("ratio", F.round((F.col("now") + 0.5) / (F.col("base") + 0.5), 6))


def relation_witness(edges: DataFrame, top: str = "n") -> DataFrame:
    """edges (a, b, src, dst, n) -> each pair of groups with its total and its strongest edge, ties by name."""
    by = edges.groupBy("a", "b").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col(top)).alias("o"), "src", "dst")).alias("w"))
    return by.select("a", "b", "total", F.col("w.src").alias("src"), F.col("w.dst").alias("dst"))


def value_concordance(rows: DataFrame, least: int = 5) -> DataFrame:
    """rows (container, file, member): do the files of a container list its core members all together?

    The core are members that two thirds of the declaring files have (two at least). Among files with ``t`` or more
    core members, having all is coded against the rate that independent members would give.
    """
    from patternmill.functions import cells

    rows = rows.select("container", "file", "member").distinct()
    files = rows.groupBy("container").agg(F.countDistinct("file").alias("files"))
    by = rows.groupBy("container", "member").agg(F.count(F.lit(1)).alias("carriers")).join(files, "container")
    core = by.where(3 * F.col("carriers") >= 2 * F.col("files"))
    shape = core.groupBy("container").agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list(F.col("carriers") / F.col("files"))).alias("rates")).where(F.col("m") >= 2)  # a container's members are few
    shape = shape.withColumn("t", F.least(F.ceil(2 * F.col("m") / 3), F.col("m") - 1))
    held = rows.join(core.select("container", "member"), ["container", "member"]).groupBy("container", "file").agg(F.count(F.lit(1)).alias("k")).join(shape, "container")
    n = held.where(F.col("k") >= F.col("t")).groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("k") == F.col("m")).cast("long")).alias("complete"), F.max("m").alias("m"), F.max("t").alias("t"), F.first("rates").alias("rates"))
    n = n.where(F.col("n") >= least).withColumn("q", F.least(cells.all_given_most(F.col("rates"), F.col("t").cast("int")), F.lit(1 - 1e-12)))
    idx = n.agg(cells.index_cost(F.count(F.lit(1))).alias("idx"))
    n = n.crossJoin(F.broadcast(idx))
    bits = cells.binary_bits(F.col("complete"), F.col("n"), F.col("q"), F.col("idx"))
    norm = (bits > 0) & (F.col("complete") / F.col("n") > F.col("q")) & cells.clears_loss(F.col("complete"), F.col("n"))
    return n.select("container", "m", "t", "n", "complete", F.round("q", 6).alias("q"), F.round(bits, 6).alias("bits"), norm.alias("norm"))
