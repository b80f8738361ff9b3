"""Substring dedup with fixed-block anchors.

Reference blocks are the non-overlapping runs of ``block`` words at multiples of ``block`` in every document; with
``2 * block - 1 <= window`` any window of ``window`` words contains a whole one. Every rolling run of ``block`` words of
every document probes the index. Only where a block is found twice can a window repeat: there, hits are extended
window by window, by hashing each ``window`` words that hold a hit and counting them over the corpus, which yields the
maximal repeats; a window seen twice is removed, wherever else it starts, and all windows are judged on the input.

Index and probes meet by hash range (see ``chunks``): 46 bits of a hash select candidates, 63 bits of another decide.

Defined results: null and empty texts have no words and nothing is removed. Rows that repeat an id and text repeat
each other's windows. A text of any length is hashed whole. An empty table gives an empty one. Other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patternmill.llm.chunks import REPLY, SLICE, any_within, chunk_table, covered, groups, member, replies, slices, unpack
from patternmill.llm.common import Scratch
from patternmill.llm.vectors import U, WordHashes, kept, mix, windows

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_M2 = 0xC2B2AE3D27D4EB4F


def chunk_words(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, word hashes end to end, where each document begins and the end)."""
    texts = [t or b"" for t in table.column("body").cast(pa.large_binary()).to_pylist()]
    memo = kept("substring", WordHashes)
    parts = [memo.of(t.split()) for t in texts]
    return texts, np.concatenate(parts) if parts else np.empty(0, U), np.cumsum([0, *map(len, parts)])


def inside(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which positions begin a run of ``width`` words within one document."""
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(starts[-1])
    return (left >= width)[:n]


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    block = (window + 1) // 2
    scratch = Scratch(docs.sparkSession, "substring")
    table, bits = chunk_table(docs, scratch, id_col, text_col, chunk_bytes)

    def anchors(starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix(windows(h, block)) >> U(18)  # 46 bits
        return keys, inside(starts, block, len(keys))

    def index_and_probe(key: tuple, t: pa.Table) -> pa.Table:
        _, h, starts = chunk_words(t)
        keys, ok = anchors(starts, h)
        at = np.flatnonzero(ok)
        aligned = ((at - np.repeat(starts[:-1], np.diff(starts))[at]) % block == 0).astype(np.uint8)
        order, first = groups(keys[at])
        if not len(order):
            return slices(key[0].as_py(), np.empty(0, U), bits, 48, 6)
        many = np.diff(np.append(first, len(order))) > 1
        flags = np.maximum.reduceat(aligned[order], first).astype(U) | (many.astype(U) << U(1))
        return slices(key[0].as_py(), (keys[at][order[first]] << U(2)) | flags, bits, 48, 6)

    def found_twice(key: tuple, t: pa.Table) -> pa.Table:
        parts = [unpack(p, 6) for p in t.column("payload").to_pylist()]
        every = np.concatenate(parts)
        order, first = groups(every >> U(2))
        both = np.bitwise_or.reduceat((every & U(3)).astype(np.uint8)[order], first)
        good = ((both & 1) > 0) & ((np.diff(np.append(first, len(order))) > 1) | ((both & 2) > 0))
        mark = np.empty(len(every), bool)
        mark[order] = np.repeat(good, np.diff(np.append(first, len(order))))
        out, lo = [], 0
        for p in parts:
            out.append(((p >> U(2))[mark[lo : lo + len(p)]]).tobytes())
            lo += len(p)
        return replies(t.column("chunk").to_pylist(), out)

    def wide(h: np.ndarray) -> np.ndarray:
        return mix(windows(h, window, _M2)) & ~U(1)

    def extend(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        _, h, starts = chunk_words(t)
        keys, ok = anchors(starts, h)
        hit = member(keys, np.sort(np.concatenate([np.frombuffer(p, U) for p in found.column("payload").to_pylist()]))) & ok if found.num_rows else np.zeros(len(keys), bool)
        k = wide(h)
        at = np.flatnonzero(any_within(hit, window - block + 1)[: len(k)] & inside(starts, window, len(k)))
        order, first = groups(k[at])
        if not len(order):
            return slices(key[0].as_py(), np.empty(0, U), bits, 64, 8)
        many = np.diff(np.append(first, len(order))) > 1
        return slices(key[0].as_py(), k[at][order[first]] | many.astype(U), bits, 64, 8)

    def repeated(key: tuple, t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, U) for p in t.column("payload").to_pylist()]
        every = np.concatenate(parts)
        order, first = groups(every & ~U(1))
        good = (np.diff(np.append(first, len(order))) > 1) | (np.bitwise_or.reduceat((every & U(1)).astype(np.uint8)[order], first) > 0)
        mark = np.empty(len(every), bool)
        mark[order] = np.repeat(good, np.diff(np.append(first, len(order))))
        out, lo = [], 0
        for p in parts:
            out.append((p & ~U(1))[mark[lo : lo + len(p)]].tobytes())
            lo += len(p)
        return replies(t.column("chunk").to_pylist(), out)

    def remove(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        texts, h, starts = chunk_words(t)
        gone = np.zeros(len(h), bool)
        if found.num_rows:
            k = wide(h)
            begins = np.zeros(len(h), bool)
            begins[: len(k)] = member(k, np.sort(np.concatenate([np.frombuffer(p, U) for p in found.column("payload").to_pylist()]))) & inside(starts, window, len(k))
            gone = covered(begins, window)
        lost, sha = [], []
        for i, text in enumerate(texts):
            words, g = text.split(), gone[starts[i] : starts[i + 1]]
            lost.append(int(g.sum()))
            if lost[-1]:
                words = [words[j] for j in np.flatnonzero(~g).tolist()]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": t.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(starts)), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    anchor = scratch.save(table.groupBy("chunk").applyInArrow(index_and_probe, SLICE).groupBy("bucket").applyInArrow(found_twice, REPLY), "anchors")
    scratch.drop("nothing")
    candidates = table.groupBy("chunk").cogroup(anchor.groupBy("chunk")).applyInArrow(extend, SLICE)
    twice = scratch.save(candidates.groupBy("bucket").applyInArrow(repeated, REPLY), "repeats")
    scratch.drop("anchors")
    out = scratch.save(table.groupBy("chunk").cogroup(twice.groupBy("chunk")).applyInArrow(remove, OUT), "result")
    scratch.drop("repeats")
    scratch.drop_tables()
    return out
