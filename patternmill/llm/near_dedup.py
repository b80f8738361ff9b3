"""Near duplicates by BagMinHash signatures, banding, and exact multiset overlap.

1. Each text becomes the multiset of its five-word shingles (letters and digits, lower case). Texts with the same
   words are one node from the start (a digest), so a group of copies is one node from here on, whatever its size.
2. BagMinHash: a shingle of weight w (its count) owns the levels 1..w. The levels are split into dyadic blocks, each
   with its own Poisson process of (time, component, level) points seeded by shingle and block; the weights' binary
   hierarchy decides which points of the topmost block lie below w. Only points before a time bound are generated, so
   a text costs one draw per shingle and block and a few hundred points, whatever its length. The earliest point of
   each of the ``bands * rows`` components is the signature; two signatures agree in a component with probability
   exactly the weighted Jaccard similarity.
3. Bands deal the nodes into buckets. Pairs are never expanded inside a bucket. First come rounds of pivots: the most
   central node of a bucket (the one whose buckets are fullest) is compared with the nodes not yet linked to it, and
   leaves the bucket; that links a crowd of copies of one text in as many comparisons as it has members. What several
   pivots leave unlinked meets by a prefix filter over its shingles, rarest first: two multisets that overlap by the
   threshold share one of their few rarest shingles, early enough in both. That is exact: no such pair is lost.
4. Before texts are compared, bounds that hold always rule pairs out: the weights, and the parity of 1,024 hashed bits
   (each differing bit is a shingle that only one of both has). No estimate decides.
5. A comparison is exact: sum of minimum counts over sum of maximum counts of the two multisets, at least 0.8.
6. Classes are the connected components of the links (iterated minimum labels over shuffles, never on the driver).

Defined results: a text of fewer than five words is one shingle of all its words; texts without words are alike only
if they are equal (null is empty). Repeated rows are copies of each other. Each row is judged by its own text, so rows
that share an id but not a text may have different classes. ``class_id`` is the smallest id of the class, null where
no row of the class has an id; a row without an id keeps its null. An empty table gives an empty one. Other columns
are not read, or pass through ``one_of_each`` untouched, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternmill.llm.common import Scratch
from patternmill.llm.vectors import U, WordHashes, kept, mix, tidy, windows

WORD = re.compile(r"[^\W_]+")
BANDS, ROWS, WIDTH = 25, 5, 5
BITS = 1024
LONGS = BITS // 64
PARITY = [f"s{i}" for i in range(LONGS)]
SKETCH = "node long, doc_id long, t long, digest binary, bands array<long>, w long, parity array<long>"
_TO_UNIT = 2.0**-53
_TURN = 0xD6E8FEB86659FD93


def shingles(text: str | None, memo: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(distinct shingle hashes, their counts, digest of the words)."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").lower())]
    if not words:
        return np.empty(0, U), np.empty(0, np.int64), xxhash.xxh3_128_digest(b"\0" + (text or "").encode("utf-8", "surrogatepass"))
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    h = memo.of(words)
    h = windows(h, min(width, len(h)))
    values, counts = np.unique(h, return_counts=True)
    return values, counts, digest


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * _TO_UNIT


def bag_min_hash(values: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The signature: 32 bits of the identity of each component's earliest point; empty bags have none (zeros)."""
    if not len(values):
        return np.zeros(m, np.uint32)
    weight = float(counts.sum())
    bound = (np.log(m) + 7.0) / (weight * 1.0)
    top = (int(counts.max()) - 1).bit_length() + 1  # the last block reaches the largest count
    while True:
        best, who = np.full(m, np.inf), np.zeros(m, np.uint64)
        for j in range(top):
            # block j has the levels (2**(j-1), 2**j], block 0 the first level
            size = 1 if j == 0 else 1 << (j - 1)
            low = 0 if j == 0 else 1 << (j - 1)
            chosen = counts > low
            if not chosen.any():
                break
            v, c = values[chosen], counts[chosen]
            seed, t, k = mix(v ^ U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)), np.zeros(len(v)), 1
            expected, step = bound * size * m, 1
            while len(seed):
                turns = np.arange(k, k + step, dtype=U) * U(0xD1342543DE82EF95)
                r = mix(seed[:, None] + turns[None, :])
                times = t[:, None] + np.cumsum(-np.log(_unit(r)) / (size * m), axis=1)
                live = times <= bound
                place, time = mix(r[live]), times[live]
                level = low + 1 + (place >> U(32)).astype(np.int64) % size  # the binary digits are the hierarchy's turns
                below = level <= np.repeat(c, live.sum(axis=1))
                place, time = place[below], time[below]
                order = np.argsort(-time, kind="stable")
                place, time = place[order], time[order]
                comp = (place & U(0xFFFFFFFF)).astype(np.int64) % m
                sooner = time < best[comp]
                best[comp[sooner]], who[comp[sooner]] = time[sooner], place[sooner]  # the last write, of the earliest point, stays
                more = live[:, -1]
                seed, t, c = seed[more], times[more, -1], c[more]
                k, step = k + step, int(expected + 4 * expected**0.5) + 4
        if np.isfinite(best).all():
            return (mix(who) >> U(32)).astype(np.uint32)
        bound *= 2


def elements(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: one hash for each occurrence of each shingle. Overlap of sets is overlap of multisets."""
    if not len(values) or counts.max() == 1:
        return mix(values)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(values, counts) + turn.astype(U) * U(_TURN))


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of BITS places, whether an odd number of the hashes falls there."""
    odd = np.bincount((hashes & U(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def may_overlap(threshold: float, p: str, q: str) -> Column:
    """False only where the overlap (columns ``{p}w``, ``{p}s0``..) is certainly below the threshold.

    The sizes bound it from above, and so do the parities: at least as many elements as bits differ.
    """
    differ = functools.reduce(lambda x, y: x + y, (F.bit_count(F.col(p + c).bitwiseXOR(F.col(q + c))) for c in PARITY))
    total = F.col(f"{p}w") + F.col(f"{q}w")
    slack = (1 - threshold) / (1 + threshold)
    return (F.least(f"{p}w", f"{q}w") >= F.greatest(f"{p}w", f"{q}w") * threshold - 1e-6) & (differ <= total * slack + 1e-6)


def sketch(docs: DataFrame) -> DataFrame:
    """docs (doc_id, body, t) -> one row each, with a number of its own as ``node``."""

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, memo = TaskContext.get().partitionId() << 36, kept("near", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                digests, bands, weights, odd = [], [], [], []
                for text in part.column(1).to_pylist():
                    values, counts, digest = shingles(text, memo)
                    digests.append(digest)
                    weights.append(int(counts.sum()))
                    odd.append(parity(elements(values, counts)))
                    if not len(values):
                        bands.append([])
                        continue
                    grid = bag_min_hash(values, counts, BANDS * ROWS).reshape(BANDS, ROWS)
                    bands.append([xxhash.xxh3_64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(grid)])
                n, longs = part.num_rows, pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column(0).cast(pa.int64()), part.column(2), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(weights, pa.int64()), pa.array(odd, longs)],
                    ["node", "doc_id", "t", "digest", "bands", "w", "parity"],
                )
                row += n

    return docs.mapInArrow(run, SKETCH)


def overlap(x: tuple, y: tuple) -> float:
    (va, ca, da), (vb, cb, db) = x, y
    if not len(va) or not len(vb):
        return float(da == db)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    least = np.minimum(ca[ia], cb[ib]).sum()
    return least / (ca.sum() + cb.sum() - least)


def verify(edges: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The edges (a, b) whose texts overlap enough. texts: (node, body)."""

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("near", WordHashes)
        bag = functools.lru_cache(16)(lambda text: shingles(text, memo))  # the rows of a pivot lie side by side
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                good = pa.array([overlap(bag(x), bag(y)) >= threshold for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("body").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("tb"))
    # the many second texts first; a pivot with many edges is then one skewed key of a plain join, which is split
    paired = edges.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return paired.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): the smallest node of the component, for nodes with edges (a, b). Minimum labels, pointer jumping."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = scratch.save(both.distinct(), f"{name}-links")
    label = scratch.save(linked.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = linked.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = scratch.save(step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"), f"{name}-{k}")
        changed = step.where(F.col("comp") != F.col("was")).limit(1).count()
        scratch.drop(f"{name}-{k - 1}")
        label = step.select("node", "comp")
        if not changed:
            scratch.drop(f"{name}-links")
            return label


def rare_pairs(comp: DataFrame, texts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of different components that may reach the threshold, by a prefix filter.

    Elements are ordered by how many of these texts have them, rarest first. With t the threshold, a pair at t has a
    common element among the first ``w - ceil(t w) + 1`` of the larger and ``w - ceil(2 t / (1 + t) w) + 1`` of the
    smaller, and its first common element leaves enough elements behind it in both.
    """

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("near", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [elements(*shingles(text, memo)[:2]).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "e"])

    own = texts.join(comp.select("node"), "node", "left_semi").select("node", "body")
    rows = own.mapInArrow(run, "node long, e array<long>").select("node", F.explode("e").alias("e"))
    often = rows.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "e")) - 1
    rows = rows.join(often, "e").withColumn("i", place).where(F.col("df") > 1)
    rows = rows.join(comp, "node").join(nodes, "node")
    share = 2 * threshold / (1 + threshold)
    wide = rows.where(F.col("i") <= F.col("w") - F.ceil(F.col("w") * threshold - 1e-6))
    narrow = rows.where(F.col("i") <= F.col("w") - F.ceil(F.col("w") * share - 1e-6))
    names = ["node", "comp", "i", "w", *PARITY]
    one = narrow.select("e", *(F.col(c).alias(f"x{c}") for c in names))
    other = wide.select("e", *(F.col(c).alias(f"y{c}") for c in names))
    smaller = (F.col("xw") < F.col("yw")) | ((F.col("xw") == F.col("yw")) & (F.col("xnode") < F.col("ynode")))
    least = F.ceil((F.col("xw") + F.col("yw")) * (threshold / (1 + threshold)) - 1e-6)
    enough = (F.col("xw") - F.col("xi") >= least) & (F.col("yw") - F.col("yi") >= least)
    # all bounds are part of the join's condition: pairs they rule out are never made
    both = one.join(other, "e").where(smaller & (F.col("xcomp") != F.col("ycomp")) & enough & may_overlap(threshold, "x", "y"))
    return both.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def text_classes(docs: DataFrame, threshold: float, pivots: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """((doc_id, t, digest) of each row, (digest, comp) of each distinct text, the scratch tables)."""
    scratch = Scratch(docs.sparkSession, "neardedup")
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("body"), F.xxhash64(docs[text_col]).alias("t"))
    sk = scratch.save(sketch(own), "sketches")
    reps = scratch.save(sk.dropDuplicates(["digest"]), "reps")
    rows = reps.select("node", F.explode("bands").alias("key"))
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = scratch.save(rows.join(crowded, "key"), "buckets")
    central = rows.groupBy("node").agg(F.sum(F.col("n") - 1).alias("central"))
    nodes = scratch.save(reps.join(central, "node").select("node", "doc_id", "t", "central", "w", *(F.col("parity")[i].alias(c) for i, c in enumerate(PARITY))), "nodes")
    wanted = nodes.select(F.col("node").alias("n"), F.col("doc_id").alias("d"), F.col("t").alias("u"))
    texts = own.join(wanted.hint("merge"), own["doc_id"].eqNullSafe(wanted["d"]) & (own["t"] == wanted["u"]))
    texts = scratch.save(texts.select(F.col("n").alias("node"), "body").dropDuplicates(["node"]), "texts")
    size = nodes.select("node", "w", *PARITY)

    def bounded(p: str, node: str) -> DataFrame:
        return size.select(F.col("node").alias(node), *(F.col(c).alias(p + c) for c in size.columns[1:]))

    comp = nodes.select("node", F.col("node").alias("comp"))

    def link(comp: DataFrame, edges: DataFrame, k: int) -> DataFrame:
        """comp after the edges that hold are links. Only components are joined on, so each round's graph is small."""
        edges = scratch.save(edges, f"edges{k}")
        if edges.isEmpty():
            return comp
        good = scratch.save(verify(edges, texts, threshold), f"links{k}")
        if good.isEmpty():
            return comp
        to = comp.withColumnRenamed("comp", "ca").withColumnRenamed("node", "a")
        fro = comp.withColumnRenamed("comp", "cb").withColumnRenamed("node", "b")
        between = good.join(to, "a").join(fro, "b").where(F.col("ca") != F.col("cb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = components(between, scratch, f"cc{k}").select(F.col("node").alias("comp"), F.col("comp").alias("now"))
        return scratch.save(comp.join(moved, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), f"comp{k}")

    rows, k = rows.select("key", "node"), 0
    while k < pivots:
        at = rows.join(comp, "node").join(nodes.select("node", "central"), "node")
        best = F.max(F.struct("central", (-F.col("node")).alias("o"), F.struct("node", "comp").alias("at")))
        mixed = at.groupBy("key").agg(best.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
        mixed = mixed.select("key", F.col("p.at.node").alias("pivot"), F.col("p.at.comp").alias("pc"))
        rest = scratch.save(at.join(mixed, "key").where(F.col("node") != F.col("pivot")).select("key", "node", "comp", "pivot", "pc"), f"rest{k}")
        rows, k = rest.select("key", "node"), k + 1
        if rest.isEmpty():
            break
        edges = rest.where(F.col("comp") != F.col("pc")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        edges = edges.join(bounded("x", "a"), "a").join(bounded("y", "b"), "b").where(may_overlap(threshold, "x", "y")).select("a", "b")
        comp = link(comp, edges, k)
    else:
        at = rows.join(comp, "node")
        mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
        left = scratch.save(at.join(mixed, "key", "left_semi").select("node", "comp").distinct(), "left")
        if not left.isEmpty():
            comp = link(comp, rare_pairs(left, texts, size, threshold), k + 1)
    out = scratch.save(reps.select("node", "digest").join(comp, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp")), "classes")
    own = scratch.save(sk.select("doc_id", "t", "digest"), "rows")
    scratch.drop("texts", "sketches", "buckets", "reps", "nodes", "left", *(f"{x}{i}" for x in ("edges", "links", "rest", "comp") for i in range(pivots + 3)))
    return own, out, scratch


def near_duplicates(docs: DataFrame, threshold: float = 0.8, pivots: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and class_id, the smallest doc_id of its class."""
    rows, classes, _ = text_classes(docs, threshold, pivots, id_col, text_col)
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least")).join(classes, "digest")
    names = least.groupBy("comp").agg(F.min("least").alias("class_id"))
    of = least.select("digest", "comp").join(names, "comp").select("digest", "class_id")
    return rows.join(of.hint("merge"), "digest").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, threshold: float = 0.8, pivots: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class (one without an id only where none has one).

    Rows that repeat both an id and a text are one document and stay together.
    """
    rows, classes, scratch = text_classes(docs, threshold, pivots, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "t"))
    least = rows.groupBy("digest").agg(first.alias("f")).join(classes, "digest").groupBy("comp").agg(F.min("f").alias("f"))
    keep = scratch.save(least.select(F.col("f.doc_id").alias("d"), F.col("f.t").alias("u")).distinct(), "keep")
    return docs.join(keep.hint("merge"), docs[id_col].eqNullSafe(keep["d"]) & (F.xxhash64(docs[text_col]) == keep["u"]), "left_semi")
