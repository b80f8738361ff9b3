"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Items are partitioned by the power of two that bounds their number of shingles. An item's sketch is the bottom of its
shingle hashes: of a partition with at most u shingles, ``floor((1 - t) * u) + 1`` minima. A document that contains a
share t of an item's shingles misses at most ``(1 - t) * n`` of them, so it holds at least one of the sketch: the
search has no false negatives at any document length, where a whole-document signature would have to resolve Jaccard
similarities near zero. Every rolling shingle of every whole document probes the sketch index; the pairs found are
verified with all of the item's shingles, exactly.

The sketch index is broadcast only if its counted rows stay below ``broadcast_rows``; beyond, the join shuffles both
sides. Words are runs of letters and digits, lower case. A shingle is five words; an item of fewer is one shingle of
all its words, and is sought in the documents' windows of as many words (only the lengths that items have are made).

Defined results: null and empty texts match nothing; a null id of a document or an item is an id of its own. Repeated rows of a document give the same pair once per id. An empty table gives an empty one. Other columns
are not read, or pass through ``without_leaks`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import Scratch


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(text: Column, width: int = 5, short: tuple[int, ...] = (), whole: bool = False) -> Column:
    """64-bit hashes of every ``width`` consecutive words, and of every n for each n of ``short``.

    A text of fewer words has none of that length; with ``whole``, all its words are one shingle.
    The words are bound as a lambda's variable: written out in the inner function they would be split for every shingle.
    """

    def windows(ws: Column, n: int) -> Column:
        at = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(ws, i, F.lit(n))))

    def rolling(ws: Column) -> Column:
        out = windows(ws, width)
        if short:
            out = F.concat(out, *(windows(ws, n) for n in short))
        return F.when((F.size(ws) > 0) & (F.size(ws) < width), F.array(F.xxhash64(ws))).otherwise(out) if whole else out

    return F.flatten(F.transform(F.array(words_of(text)), rolling))


def item_sketches(items: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (a key that is never null), sh (all distinct shingles), n, n_words, size_class, sketch (the smallest hashes)."""
    sh = items.select(items[id_col].alias("item_id"), F.xxhash64(items[id_col], items[text_col]).alias("item"), F.size(words_of(items[text_col])).alias("n_words"), F.array_sort(F.array_distinct(shingle_hashes(items[text_col], width, whole=True))).alias("sh"))
    sh = sh.withColumn("n", F.size("sh")).where(F.col("n") > 0)
    sh = sh.withColumn("size_class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    upper = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    minima = F.least(F.floor(upper * F.lit(1 - threshold) + 1e-9) + 1, F.col("n")).cast("int")
    return sh.withColumn("sketch", F.slice("sh", F.lit(1), minima))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per (doc_id, item_id) whose share of the item's shingles in the document is at least ``threshold``."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    sketches = scratch.save(item_sketches(items, threshold, width, item_col, item_text), "items")
    # fewer than ``width`` numbers reach the driver, however many items there are
    short = tuple(sorted(r.n_words for r in sketches.where(F.col("n_words") < width).select("n_words").distinct().collect()))
    index = sketches.select("item", F.explode("sketch").alias("h"))
    if index.count() <= broadcast_rows:
        index = F.broadcast(index)
    own = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("t"), docs[text_col].alias("body"))
    probes = own.select("doc_id", "t", F.explode(shingle_hashes(F.col("body"), width, short)).alias("h"))
    pairs = scratch.save(probes.join(index, "h").select("doc_id", "t", "item").distinct(), "pairs")
    holders = pairs.select(F.col("doc_id").alias("d"), F.col("t").alias("u")).distinct()
    if holders.count() <= broadcast_rows:
        holders = F.broadcast(holders)
    held = own.join(holders, own["doc_id"].eqNullSafe(F.col("d")) & (own["t"] == F.col("u")), "left_semi")
    held = held.dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), F.array_distinct(shingle_hashes(F.col("body"), width, short)).alias("all"))
    both = pairs.join(held, pairs["doc_id"].eqNullSafe(F.col("d")) & (pairs["t"] == F.col("u"))).join(sketches.select("item", "item_id", "sh", "n"), "item")
    found = F.size(F.array_intersect("sh", "all"))
    out = both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), found.cast("long").alias("n_found"))
    out = out.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item."""
    scratch = Scratch(docs.sparkSession, "leaks")
    leaks = scratch.save(find_leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__leak")).distinct(), "found")
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["__leak"]), "left_anti")
