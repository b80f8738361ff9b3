"""Quality rules: text measures of one document, and lines that are too frequent across a host's documents.

One pass over the texts measures each document and hashes its normalised lines (trimmed, lower case); only hashes go
on. A line's distinct documents are counted per host (exact copies of a text are one document), a line above the
host's limit is boilerplate, and a document that loses nearly everything to boilerplate is rejected. The limit is
``min_docs`` documents or ``share`` of the host's documents, whichever is more, so a host of any size keeps its
ordinary lines. Counting is two partial aggregations keyed by (host, line, text), so a host with a third of all rows,
or a line that they all share, spreads over all tasks. ``keep_good`` takes the lines above the limit out of the texts
it keeps; ``quality_rules`` returns what was measured and judged.

Defined results: a null or empty text has no words and fails the base rule (fewer than ``min_words``). A null host is
a host. Rows that repeat a doc_id are judged one by one. An empty table gives an empty one. Other columns are not
read, or pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from patternmill.llm.common import Scratch
from patternmill.llm.vectors import U, WordHashes, batched, kept, mix, tidy, windows

MEASURES = "doc_id long, host string, row long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<long>"
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SYMBOLS = b"#*$%&|<>"


def repeat_words(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For texts laid end to end (``starts``: where each begins, and the end): words in windows found twice or more in their text."""
    n_docs, n = len(starts) - 1, len(hashes)
    if n < width:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    inside = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    keys = mix(windows(hashes, width)[inside] + mix(doc[inside].astype(U)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = inside[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 5) -> DataFrame:
    @tidy("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, memo = TaskContext.get().partitionId() << 36, kept("quality", WordHashes)
        for batch in batches:
            for at, texts in batched(batch.column(0), batch.column(1)):
                words = [t.split() for t in texts]
                starts = np.cumsum([0, *map(len, words)])
                repeats = repeat_words(memo.of([w for ws in words for w in ws]), starts, window)
                chars, symbols, dups, hashes, counts = [], [], [], [], []
                for t in texts:
                    # code points: all bytes but UTF-8's continuation bytes, without white space
                    b = np.frombuffer(t, np.uint8)
                    chars.append(len(t) - int(np.count_nonzero((b & 0xC0) == 0x80)) - sum(t.count(c) for c in _SPACE))
                    symbols.append(sum(t.count(c) for c in _SYMBOLS))
                    seen: dict[bytes, int] = {}
                    dup, found = 0, {}
                    for line in t.split(b"\n"):
                        if line in seen:
                            dup += 1
                            n = seen[line]
                        else:
                            n = seen[line] = len(line.split())
                            if not n:
                                del seen[line]
                                continue
                        h = xxhash.xxh3_64_intdigest(line.strip(_SPACE).translate(_LOWER))
                        found[h] = found.get(h, 0) + n
                    dups.append(dup)
                    hashes.append(found.keys())
                    counts.append(found.values())
                k = len(texts)
                flat = np.fromiter((h for x in hashes for h in x), U).view(np.int64)
                ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                longs = lambda x: pa.array(np.asarray(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k).cast(pa.int64()), batch.column(2).slice(at, k).cast(pa.string()), longs(np.arange(row, row + k)), longs(np.fromiter(map(xxhash.xxh3_64_intdigest, texts), U, k).view(np.int64)),
                     longs(np.diff(starts)), longs(chars), longs(symbols), longs(dups), longs(repeats),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(ends), longs(np.fromiter((n for x in counts for n in x), np.int64)))],
                    ["doc_id", "host", "row", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"],
                )
                row += k

    return docs.select(docs[id_col], docs[text_col], docs[host_col]).mapInArrow(run, MEASURES)


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int = 10, max_repeat_percent: int = 20, min_docs: int = 20, share: float = 0.1, least_left: float = 0.3) -> tuple[DataFrame, Scratch]:
    """One row per document: the measures, ``boilerplate`` (its lines above the limit), ``base_failed`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    m = scratch.save(measure(docs, id_col, text_col, host_col), "measures")
    lines = m.select("host", "row", "text_hash", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")).select("host", "row", "text_hash", F.col("x.line_hashes").alias("line"), F.col("x.line_words").alias("words"))
    hosts = m.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    seen = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    frequent = seen.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host"))).where(F.col("n_docs") > F.col("host_docs") * share).select("s.host", "s.line")
    frequent = scratch.save(frequent, "frequent")
    lost = (lines.alias("l").join(frequent.alias("f"), (F.col("l.line") == F.col("f.line")) & F.col("l.host").eqNullSafe(F.col("f.host")))
            .groupBy("l.row").agg(F.sum("l.words").alias("boilerplate_words"), F.collect_set("l.line").alias("boilerplate")))
    out = m.drop("line_hashes", "line_words").join(lost, "row", "left").withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)))
    left = F.col("n_words") - F.col("boilerplate_words")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    depleted = (F.col("boilerplate_words") > 0) & ((left < min_words) | (left < least_left * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row"), scratch


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """One row per document: the measures, ``boilerplate_words``, ``base_failed`` and ``kept``."""
    return judged(docs, id_col, text_col, host_col, **rules)[0].drop("boilerplate")


@F.arrow_udf(StringType())
def without_lines(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """The texts without the lines whose hashes are listed; a null list leaves a text as it is."""
    out = []
    for text, gone in zip(texts.cast(pa.large_binary()).to_pylist(), hits.to_pylist()):
        if gone is not None and text is not None:
            found = {h & 0xFFFFFFFFFFFFFFFF for h in gone}
            text = b"\n".join(x for x in text.split(b"\n") if not x.strip(_SPACE) or xxhash.xxh3_64_intdigest(x.strip(_SPACE).translate(_LOWER)) not in found)
        out.append(text)
    return pa.array(out, pa.large_binary()).cast(pa.string())


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """The documents that the rules keep, with all their columns, and without their lines above the host's limit."""
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].alias("body"), docs[host_col].cast("string").alias("host"), F.xxhash64(docs[text_col]).alias("t"))
    out, scratch = judged(own.select("t", "body", "host"), "t", "body", "host", **rules)
    # one entry for each text and host: copies are judged alike
    found = out.where(~F.col("kept") | F.col("boilerplate").isNotNull()).groupBy("doc_id", "host").agg(F.min("kept").alias("kept"), F.first("boilerplate").alias("gone"))
    found = scratch.save(found.select(F.col("doc_id").alias("u"), F.col("host").alias("h"), "kept", "gone"), "found")
    scratch.drop("measures", "frequent")
    joined = own.join(found.hint("merge"), (own["t"] == found["u"]) & own["host"].eqNullSafe(found["h"]), "left").where(F.coalesce("kept", F.lit(True)))
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(without_lines("body", "gone"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
