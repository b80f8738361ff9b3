"""Retrieval over cards and past changes: lexical ranking, placement of a new name, existence of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_weights(cards: DataFrame, words: DataFrame) -> DataFrame:
    """cards (card, tok, w), words (q, tok) -> (q, tok, idf): rare words count more, words no card has count most."""
    size = cards.agg(F.countDistinct("card").alias("N"))
    df = cards.join(words.select("tok").distinct(), "tok", "left_semi").select("card", "tok").distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rows = words.select("q", "tok").distinct().join(df, "tok", "left").crossJoin(F.broadcast(size))
    return rows.select("q", "tok", F.log2(1 + F.coalesce(F.col("N") / F.col("df"), F.col("N"))).alias("idf"))


def bags(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words (q, tok) -> (q, bag), and each bag of words once with its words: (bag, tok). Equal questions are one bag."""
    asked = words.where("q is not null").select("q", "tok").distinct().groupBy("q").agg(F.sort_array(F.collect_list(F.struct("tok"))).alias("bag"))
    return asked, asked.select("bag").distinct().select("bag", F.explode("bag.tok").alias("tok"))


def alike(rows: DataFrame, shape: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each shape: of rows that answer every question alike no others can be in an answer."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*shape).orderBy(*order))).where(F.col("_r") <= top).drop("_r")


def rank_cards(cards: DataFrame, words: DataFrame, names: DataFrame | None = None, top: int = 5) -> DataFrame:
    """cards (card, tok, w) and words (q, tok) -> the ``top`` cards of each query by the idf share they answer.

    names (card, name): a query word that is a card's whole name pins it: half the query's words or more make its
    score one, fewer add a quarter. Cards with the same words, weights and names are one shape and are scored once
    against each bag of words; of the ``top`` best shapes the first cards are ranked.
    """
    asked, kinds = bags(words)
    idf = word_weights(cards, kinds.withColumnRenamed("bag", "q")).withColumnRenamed("q", "bag")
    total = idf.groupBy("bag").agg(F.sum("idf").alias("total"), F.count(F.lit(1)).alias("words"))
    heard = kinds.select("tok").distinct()
    rows = cards.join(heard, "tok", "left_semi").groupBy("card", "tok").agg(F.max("w").alias("w")).groupBy("card").agg(F.sort_array(F.collect_list(F.struct("tok", "w"))).alias("toks"))
    if names is not None:
        named = names.select("card", F.col("name").alias("tok")).join(heard, "tok", "left_semi").groupBy("card").agg(F.sort_array(F.collect_set("tok")).alias("names"))
        rows = rows.join(named, "card", "full")
    else:
        rows = rows.withColumn("names", F.lit(None).cast("array<string>"))
    shape = ["toks", "names"]
    rows = alike(rows, shape, ["card"], top).groupBy(*shape).agg(F.sort_array(F.collect_list(F.struct("card"))).alias("cards")).withColumn("shape", F.struct(*shape))
    hits = rows.select("shape", F.explode("toks").alias("t")).select("shape", "t.*").join(idf, "tok").groupBy("bag", "shape").agg(F.sum(F.col("w") * F.col("idf")).alias("s"))
    pins = rows.select("shape", F.explode("names").alias("tok")).join(idf.select("bag", "tok"), "tok").groupBy("bag", "shape").agg(F.count(F.lit(1)).alias("pins"))
    hits = hits.join(pins, ["bag", "shape"], "full").join(total, "bag").withColumn("score", F.coalesce("s", F.lit(0.0)) / F.col("total"))
    cover = F.col("pins") / F.col("words")
    score = F.when(cover >= 0.5, F.lit(1.0)).when(F.col("pins") > 0, F.col("score") + 0.25).otherwise(F.col("score"))
    hits = hits.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6)).where(F.col("score") > 0)
    best = [F.desc("score"), (F.coalesce("pins", F.lit(0)) == 0).cast("int")]
    hits = hits.join(rows.select("shape", "cards"), "shape").drop("shape")
    hits = alike(hits, ["bag"], [*best, "cards"], top).select("bag", "score", "pins", F.explode("cards.card").alias("card"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("bag").orderBy(*best, "card"))).where(F.col("rank") <= top)
    return asked.join(hits, "bag").select("q", "card", "score", (F.coalesce("pins", F.lit(0)) > 0).alias("exact"), (F.col("score") < 0.34).alias("weak"), "rank")


def rank_changes(changes: DataFrame, words: DataFrame, floor: float = 0.34, top: int = 5) -> DataFrame:
    """changes (sha, ts, tok) and words (q, tok) -> past changes that speak of a query: score, then newest, then sha.

    Changes that say the same of all words asked for are one shape, scored once against each bag of words by its first
    change; of the ``top`` best shapes the first changes are ranked.
    """
    asked, kinds = bags(words)
    idf = word_weights(changes.select(F.col("sha").alias("card"), "tok"), kinds.withColumnRenamed("bag", "q")).withColumnRenamed("q", "bag")
    total = idf.groupBy("bag").agg(F.sum("idf").alias("total"))
    order = [F.desc("ts"), "sha"]
    rows = changes.select("sha", "ts", "tok").join(kinds.select("tok").distinct(), "tok", "left_semi").groupBy("sha", "ts").agg(F.sort_array(F.collect_set("tok")).alias("toks"))
    rows = alike(rows, ["toks"], order, top)
    first = alike(rows, ["toks"], order, 1)
    hits = first.withColumn("tok", F.explode("toks")).join(idf, "tok").groupBy("bag", "toks", "sha", "ts").agg(F.sum("idf").alias("s"))
    hits = hits.join(total, "bag").withColumn("score", F.round(F.col("s") / F.col("total"), 6)).where(F.col("score") >= floor)
    hits = alike(hits, ["bag"], [F.desc("score"), *order], top).select("bag", "score", "toks").join(rows, "toks")
    rank = F.row_number().over(Window.partitionBy("bag").orderBy(F.desc("score"), *order))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= top)
    return asked.join(hits, "bag").select("q", "sha", "score", "rank")


def places(matches: DataFrame, files: DataFrame, live: DataFrame, top: int = 10) -> DataFrame:
    """matches (q, sha, score), files (sha, path): living paths that the matching changes touched, by weight.

    A path of two matches or more goes first.
    """
    touched = files.select("sha", "path").join(matches.select("sha").distinct(), "sha", "left_semi").distinct()
    rows = matches.join(touched, "sha").join(live.select("path").distinct(), "path", "left_semi")
    by = rows.groupBy("q", "path").agg(F.count(F.lit(1)).alias("k"), F.round(F.sum("score"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy((F.col("k") < 2).cast("int"), F.desc("weight"), "path"))
    return by.withColumn("rank", rank).where(F.col("rank") <= top)


def unspoken(words: DataFrame, cards: DataFrame, bridge: DataFrame) -> DataFrame:
    """Query words that no card has, with what the language bridge says of them: (q, tok, grp or null)."""
    gone = words.join(cards.select("tok").distinct(), "tok", "left_anti")
    return gone.join(bridge.select("tok", "grp"), "tok", "left").select("q", "tok", "grp")


def placement(files: DataFrame, asked: DataFrame, least: int = 3) -> DataFrame:
    """files (path, dir, suffix, toks) and asked paths of the same shape: where names like this one live.

    A token of the name that two to half of the files with its suffix have, none of them in the chosen directory, and
    two thirds of them (two at least) in one: that directory. One row for each asked path with a finding.
    """
    n = files.groupBy("suffix").agg(F.count(F.lit(1)).alias("of_suffix"))
    kin = files.select("path", "dir", "suffix", F.explode(F.array_distinct("toks")).alias("tok"))
    by = kin.groupBy("suffix", "tok", "dir").agg(F.count(F.lit(1)).alias("n"))
    sums = by.groupBy("suffix", "tok").agg(F.sum("n").alias("of"), F.min(F.struct((-F.col("n")).alias("o"), "dir")).alias("b"))
    fit = sums.join(n, "suffix").where((F.col("of_suffix") >= least) & (F.col("of") >= 2) & (F.col("of") <= 0.5 * F.col("of_suffix")))
    fit = fit.select("suffix", "tok", "of", F.col("b.dir").alias("top"), (-F.col("b.o")).alias("n")).where((F.col("n") >= 2) & (3 * F.col("n") >= 2 * F.col("of")))
    want = asked.select("path", "dir", "suffix", F.explode(F.array_distinct("toks")).alias("tok"))
    held = by.select("suffix", "tok", "dir")
    rows = want.join(held, ["suffix", "tok", "dir"], "left_anti").join(fit, ["suffix", "tok"])
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), F.desc(F.col("n") / F.col("of")), "tok"))
    return rows.withColumn("r", rank).where("r = 1").select("path", "tok", F.col("top").alias("dir"), "n", "of")


def subtrees(files: DataFrame, share: float = 0.8, least: int = 5) -> DataFrame:
    """files (path, suffix): the deepest directory that holds ``share`` of the files of a suffix."""
    total = files.groupBy("suffix").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= least)
    parts = F.split("path", "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    by = files.select("suffix", F.explode(up).alias("dir")).groupBy("suffix", "dir").agg(F.count(F.lit(1)).alias("n"))
    rows = by.join(total, "suffix").where(F.col("n") >= share * F.col("of"))
    rank = F.row_number().over(Window.partitionBy("suffix").orderBy(F.desc(F.length("dir")), "dir"))
    return rows.withColumn("r", rank).where("r = 1").select("suffix", "dir", "n", "of")


def companions(files: DataFrame, groups: DataFrame, share: float = 0.6, least: int = 4, crowd: int = 6) -> DataFrame:
    """files (path, stem, suffix), groups (grp, path): what a group's members come with, by the same stem.

    Stems of more than ``crowd`` files pair everything with everything and are no evidence.
    """
    few = files.groupBy("stem").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= crowd).select("stem")
    member = groups.select("grp", "path").distinct().join(files.select("path", "stem", F.col("suffix").alias("own")), "path")
    size = member.groupBy("grp").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= least)
    other = files.join(few, "stem", "left_semi").select("stem", F.col("path").alias("sib"), "suffix")
    pair = member.join(other, "stem").where((F.col("sib") != F.col("path")) & (F.col("suffix") != F.col("own")))
    inside = groups.select("grp", F.col("path").alias("sib")).distinct()
    pair = pair.join(inside, ["grp", "sib"], "left_anti").select("grp", "path", "suffix").distinct()
    n = pair.groupBy("grp", "suffix").agg(F.count(F.lit(1)).alias("n"))
    return n.join(size, "grp").withColumn("implied", F.col("n") >= share * F.col("of")).select("grp", "suffix", "n", "of", "implied")
