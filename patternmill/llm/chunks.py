"""Corpus-wide lookups without a row per position.

Texts are dealt once, by document, into a bucketed table of chunks; every later pass over a chunk reads it where it
lies. A pass hashes all positions of a chunk, sorts the distinct hashes once, and sends each bucket of the hash space
one packed row of them. A bucket sees the whole corpus's hashes of its range, decides, and answers each chunk with one
packed row. So a hash that a third of all documents share reaches its bucket at most once per chunk, and no task's work
grows with the most frequent passage. A slice is only sent where it holds a hash: with more buckets than hashes in a
chunk there are as many rows as hashes, as in any shuffle, not chunks times buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import Scratch, blocks_for, text_bytes
from patternmill.llm.vectors import U

SLICE = "bucket long, chunk long, payload binary"
REPLY = "chunk long, payload binary"


def chunk_table(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, body, chunk) bucketed by chunk, and the bits that number the buckets of the hash space.

    Dealt by id and text, so rows without an id, or that repeat one, spread as well.
    """
    _, size = text_bytes(docs, text_col)
    n = blocks_for(docs.sparkSession, size, chunk_bytes)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("body")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "body"), F.lit(n)))
    table = scratch.bucketed(own, "chunks", n, "chunk")
    scratch.drop("nothing")  # frees the shuffle that dealt the texts
    return table, max(1, (n - 1).bit_length())


def ordered_chunks(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Like ``chunk_table``, but an earlier chunk's ids are never greater than a later chunk's; null ids come first.

    An id may go on from one chunk into the next ones. Ranges of ids are dealt by rows and then cut by bytes, so that a
    chunk stays near ``chunk_bytes`` however long the texts of a range are.
    """
    _, size = text_bytes(docs, text_col)
    n = blocks_for(docs.sparkSession, size, chunk_bytes)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("body"))
    dealt = own.repartitionByRange(n, F.col("doc_id"), F.xxhash64("body")).sortWithinPartitions("doc_id")
    piece = max(1, size // n)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
            ends = done + np.cumsum(sizes)
            chunk = pa.array(base + (ends - sizes) // (2 * piece))
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), chunk], ["doc_id", "body", "chunk"])

    table = scratch.bucketed(dealt.mapInArrow(number, "doc_id long, body string, chunk long"), "chunks", n, "chunk", deal=False)
    scratch.drop("nothing")
    return table, max(1, (n - 1).bit_length())


def pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def slices(chunk: int, keys: np.ndarray, bits: int, shift: int, width: int, tail: np.ndarray | None = None) -> pa.Table:
    """One row per bucket of sorted ``keys``; a bucket is a range of their top bits (below bit ``shift``)."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(shift - bits))
    ends = [0, *edges.tolist(), len(keys)]
    rows = [(b, pack(keys[i:j], width) + (b"" if tail is None else tail[i:j].tobytes())) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})


def replies(chunks: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "payload": pa.array(payloads, pa.binary())})


def member(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``found``; a bitmap of hashed keys answers for most."""
    if not len(found):
        return np.zeros(len(keys), bool)
    bits = min(24, max(16, len(found).bit_length() + 4))
    mask = U((1 << bits) - 1)
    seen = np.zeros(1 << bits, bool)
    seen[(found & mask).astype(np.int64)] = True
    out = seen[(keys & mask).astype(np.int64)]
    maybe = np.flatnonzero(out)
    probe = keys[maybe]
    at = np.minimum(np.searchsorted(found, probe), len(found) - 1)
    out[maybe] = found[at] == probe
    return out


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts keys, where each distinct key begins in it)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)


def any_within(hit: np.ndarray, reach: int) -> np.ndarray:
    """For each position i: is there a hit in [i, i + reach)?"""
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.minimum(np.arange(len(hit)) + reach, len(hit))
    return total[ends] > total[:-1]


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Positions that lie in a window of ``width`` beginning at a set position."""
    n = len(starts)
    step = np.zeros(n + width + 1, np.int64)
    step[:n] += starts
    step[width : width + n] -= starts
    return np.cumsum(step)[:n] > 0
