"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches. A batch's line keys, each with the number of its documents that hold it, are merge-anti-
joined with the runs: a key that a run already shows in ``limit`` documents is settled and isn't counted again, so the
most frequent lines of the corpus cost one entry and not one for each batch. What is left becomes a run of its own at
level 0; ``fanout`` runs of a level are merged into one of the next, so n batches leave O(fanout * log n) runs to read.
All runs are bucketed and sorted alike, so joins and merges of runs move no row between tasks. After the last batch
the runs are merged, keys at or above the limit are frequent, and every document loses its lines with such a key. Only
hashes are sorted, merged and joined; the text is moved once, to meet its own hits.

Defined results: null and empty texts are one empty line, and an empty key is never dropped. Rows that share an id
count as one document, whatever their texts; rows without an id count by their text. An empty table gives an empty
one. Other columns pass through ``without_frequent_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.llm.common import MOST_BUCKETS, Scratch, ascii_lower, blocks_for, text_bytes, trim_blanks

KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    return ascii_lower(trim_blanks(line))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Runs ``(h long, g int, n long)`` in ``buckets`` buckets, each sorted by (h, g), in levels.

    A merge is a full outer merge join of two runs: equal buckets meet where they lie. (Not a union with a grouping:
    Spark 4.1 trusts a union of bucketed tables to be bucketed even where it then reads them otherwise, and leaves
    rows of one key apart.)
    """

    def __init__(self, spark: SparkSession, limit: int, buckets: int, fanout: int = 2):
        self.scratch, self.limit, self.buckets, self.fanout = Scratch(spark, "lineruns"), limit, min(buckets, MOST_BUCKETS), fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m").hint("merge"), KEY, "full")
            return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return functools.reduce(two, runs)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys (h, g, ..) of a batch that no run settles."""
        for r in self.runs():
            keys = keys.join(r.where(F.col("n") >= self.limit).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, counts: DataFrame) -> None:
        """Take in a batch's (h, g, n): what is unseen becomes a run; full levels are merged."""
        dealt = counts.repartition(self.buckets, *KEY)
        carried, level = self.scratch.sorted_buckets(self.unseen(dealt), "run", self.buckets, KEY, deal=False), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(carried)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            # two runs leave their rows in their buckets, more are dealt anew
            carried = self.scratch.sorted_buckets(self.merge(full), "run", self.buckets, KEY, deal=len(full) > 2)
            self.scratch.drop_tables(keep=[*self.runs(), carried])
            level += 1

    def frequent(self) -> DataFrame:
        return self.merge(self.runs()).where(F.col("n") >= self.limit).select(*KEY)


def frequent_hits(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, limit: int, min_key: int, batches: int, batch_bytes: int, run_bytes: int) -> DataFrame:
    """(id, t: hash of the text, hits: the document's frequent key hashes), for documents that have any."""
    spark = docs.sparkSession
    _, size = text_bytes(docs, text_col)
    batches = max(batches, -(-size // batch_bytes))
    # h alone names a key within one document; (h, g) names it in the corpus
    keys = F.array_distinct(F.filter(F.transform(lines_of(docs[text_col]), line_key), lambda k: F.length(k) >= min_key))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("t"), F.explode(keys).alias("k"))
    rows = rows.select("id", "t", F.xxhash64("k").alias("h"), F.hash("k").alias("g"), F.pmod(F.xxhash64(F.coalesce("id", "t")), F.lit(batches)).cast("int").alias("batch"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("batch").parquet(scratch.path("lines"))
    lines = spark.read.schema("id long, t long, h long, g int, batch int").parquet(scratch.path("lines"))
    runs = LineRuns(spark, limit, blocks_for(spark, size, run_bytes))
    for b in range(batches):
        doc = F.when(F.col("id").isNull(), F.col("t")).alias("u")
        one = lines.where(F.col("batch") == b).select(*KEY, "id", doc).distinct()  # by key and document: a hot line spreads
        runs.add(one.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    frequent = scratch.save(runs.frequent(), "frequent")
    runs.scratch.drop_tables()
    return lines.join(frequent, KEY).groupBy("id", "t").agg(F.collect_set("h").alias("hits"))


def kept_lines(docs: DataFrame, id_col: str, text_col: str, limit: int = 10, min_key: int = 1, batches: int = 8, batch_bytes: int = 8 << 40, run_bytes: int = 64 << 20) -> DataFrame:
    """(row: all columns of docs, id, body, n_lines, left: the lines that stay), one for each row of docs."""
    scratch = Scratch(docs.sparkSession, "linededup")
    hits = scratch.save(frequent_hits(docs, scratch, id_col, text_col, limit, min_key, batches, batch_bytes, run_bytes), "hits")
    scratch.drop("lines", "frequent")
    hits = hits.select(F.col("id").alias("d"), F.col("t").alias("u"), "hits")
    text = docs[text_col]
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), text.alias("body"), F.xxhash64(text).alias("t"))
    # one plan at every size: a broadcast of the hits would grow with the input
    joined = own.join(hits.hint("merge"), own["id"].eqNullSafe(hits["d"]) & (own["t"] == hits["u"]), "left")
    lines = lines_of(F.col("body"))
    left = F.when(F.col("hits").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("hits"), F.xxhash64(line_key(x)))))
    return joined.select("row", "id", "body", F.size(lines).cast("long").alias("n_lines"), left.alias("left"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = kept_lines(docs.select(docs[id_col], docs[text_col]), id_col, text_col, **options)
    return out.select(F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"), F.sha2(F.array_join("left", "\n").cast("binary"), 256).alias("kept_sha256"))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their texts rewritten; a text that loses nothing stays as it is (null too)."""
    out = kept_lines(docs, id_col, text_col, **options)
    text = F.when(F.size("left") == F.col("n_lines"), F.col("body")).otherwise(F.array_join("left", "\n"))
    return out.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
