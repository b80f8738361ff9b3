"""Exact byte-substring dedup by parsing with content triggers.

Each text is parsed as in prefix-free parsing: a rolling hash of ``gram`` bytes picks triggers, here the minimum of
every ``window - gram + 1`` consecutive hashes, so that each string of ``window`` bytes holds a whole trigger, and the
same triggers wherever it occurs. Triggers cut a text into phrases; the distinct phrases of the corpus are the
dictionary, each with the smallest doc_id that has it. In corpus order, strings that share their first ``window``
bytes are neighbours; only that depth matters, so the suffixes are ordered to that depth and no deeper, by hashes in
place of the bytes: first the triggers over the whole corpus, then, where a trigger is in two documents, the phrases,
and last the suffixes of each dictionary phrase, taken only from the document that has the phrase first. So highly
repetitive text is one phrase for each chunk and its suffixes meet once; the rest of the corpus sends only its
triggers, about one in ten bytes.

Chunks of texts lie in the order of ids, so a key of a phrase or a window travels without the id of its document.
Candidates are chosen with 46 bits of a hash and decided with 62 bits of another.

Defined results: null and empty texts have no bytes. Texts shorter than ``window`` lose nothing. Rows of one doc_id
never remove each other's bytes; a null doc_id counts as smaller than all others. A text is parsed whole. An empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.chunks import REPLY, SLICE, any_within, covered, groups, member, ordered_chunks, replies, slices, unpack
from patternmill.llm.common import Scratch
from patternmill.llm.vectors import U, mix, windows

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_M2 = 0xC2B2AE3D27D4EB4F
#: Keys of phrases and windows have 62 bits; the two lowest say whose they are.
_KEY = ~U(3)


def runs(table: pa.Table, limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """(first document, texts, their bytes end to end, where each begins and the end) of about ``limit`` bytes."""
    lo, total, part = 0, 0, []
    for i, t in enumerate(table.column("body").cast(pa.large_binary()).to_pylist()):
        part.append(t or b"")
        total += len(part[-1])
        if total >= limit:
            yield lo, part, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
            lo, total, part = i + 1, 0, []
    if part:
        yield lo, part, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive numbers, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


def triggers(data: np.ndarray, starts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of triggers, their 46-bit keys, which positions begin a whole window)."""
    n = len(data)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)
    whole = (left >= window)[: max(0, n - window + 1)]
    if not whole.any():
        return np.empty(0, np.int64), np.empty(0, U), whole
    h = mix(windows(_BYTES[data], gram))
    span = window - gram + 1
    least = sliding(h, span, np.minimum)[: len(whole)]
    least = np.where(whole, least, U(0))  # a window across texts picks nothing
    padded = np.concatenate((np.zeros(span - 1, U), least, np.zeros(max(0, len(h) - len(least)), U)))
    most = sliding(padded, span, np.maximum)[: len(h)]
    at = np.flatnonzero(most == h)
    return at, mix(h[at]) >> U(18), whole  # minima lie near zero; mixed again, they fill the buckets evenly


def remove_substrings(docs: DataFrame, window: int = 50, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    scratch = Scratch(docs.sparkSession, "suffix")
    table, bits = ordered_chunks(docs, scratch, id_col, text_col, chunk_bytes)

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The chunk by doc_id, and each row's rank (equal ids have one)."""
        t = t.sort_by([("doc_id", "ascending")])
        ids = t.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(pa.array(order)), ids[order]
        return t, np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)

    def parse(key: tuple, t: pa.Table) -> pa.Table:
        t, rank = ordered(t)
        keys, docs_ = [], []
        for lo, part, data, starts in runs(t):
            at, k, _ = triggers(data, starts, gram, window)
            d = rank[lo + np.searchsorted(starts, at, side="right") - 1]
            # one per document and trigger
            order = np.lexsort((d, k))
            fresh = np.concatenate(([True], (k[order][1:] != k[order][:-1]) | (d[order][1:] != d[order][:-1]))) if len(k) else np.empty(0, bool)
            keys.append(k[order][fresh])
            docs_.append(d[order][fresh].astype(np.int32))
        k, d = (np.concatenate(keys), np.concatenate(docs_)) if keys else (np.empty(0, U), np.empty(0, np.int32))
        order, first = groups(k)
        if not len(order):
            return slices(key[0].as_py(), np.empty(0, U), bits, 48, 6)
        last = np.append(first[1:], len(order)) - 1
        many = d[order[first]] != d[order[last]]  # the order is stable, so a group's documents ascend
        return slices(key[0].as_py(), (k[order[first]] << U(2)) | many.astype(U), bits, 48, 6)

    def shared(key: tuple, t: pa.Table) -> pa.Table:
        parts = [unpack(p, 6) for p in t.column("payload").to_pylist()]
        every = np.concatenate(parts)
        order, first = groups(every >> U(2))
        size = np.diff(np.append(first, len(order)))
        good = (size > 1) | (np.bitwise_or.reduceat((every & U(1)).astype(np.uint8)[order], first) > 0)
        mark = np.empty(len(every), bool)
        mark[order] = np.repeat(good, size)
        out, lo = [], 0
        for p in parts:
            out.append((p >> U(2))[mark[lo : lo + len(p)]].tobytes())
            lo += len(p)
        return replies(t.column("chunk").to_pylist(), out)

    def kept_of(found: pa.Table, which: str) -> np.ndarray:
        """The sorted keys of one kind of reply."""
        rows = zip(found.column("kind").to_pylist(), found.column("payload").to_pylist()) if found.num_rows else ()
        return np.sort(np.concatenate([np.empty(0, U), *(np.frombuffer(p, U) for k, p in rows if k == which)]))

    def phrases(lo: int, data: np.ndarray, starts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """The phrases of a run of texts that may hold a shared string.

        A phrase belongs to a trigger: the windows that begin behind the trigger before and not behind this one. Its
        key comes from its first and its last window, which cover it. Returns first and last window, key and document
        of each phrase, and of each candidate window its place, key and phrase.
        """
        at, k, whole = triggers(data, starts, gram, window)
        hit = np.zeros(len(data), bool)
        hit[at[member(k, known)]] = True
        candidate = any_within(hit, window - gram + 1)[: len(whole)] & whole
        doc = np.searchsorted(starts, at, side="right") - 1
        low = np.maximum(np.maximum(np.concatenate(([-1], at[:-1])) + 1 if len(at) else at, starts[doc]), at - (window - gram))
        high = np.minimum(at, starts[doc + 1] - window)
        total = np.concatenate(([0], np.cumsum(candidate)))
        some = high >= low
        some[some] = total[high[some] + 1] > total[low[some]]
        low, high, doc = low[some], high[some], doc[some]
        if not len(low):
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, U), none, none, np.empty(0, U), none
        w = mix(windows(_BYTES[data], window, _M2)) & _KEY
        key = mix(w[low] + mix(w[high] + (high - low).astype(U))) & _KEY
        size = high - low + 1
        which = np.repeat(np.arange(len(low)), size)
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        wanted = candidate[place]
        place, which = place[wanted], which[wanted]
        return low, high, key, lo + doc, place, w[place], which

    def dictionary(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        """Each phrase of the chunk once, with the smallest id that has it."""
        t, _ = ordered(t)
        ids = t.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        known, keys, owner = kept_of(found, "trigger"), [np.empty(0, U)], [np.empty(0, np.int64)]
        for lo, _, data, starts in runs(t):
            _, _, k, d, *_ = phrases(lo, data, starts, known)
            order, first = groups(k)
            keys.append(k[order[first]])
            owner.append(d[order[first]])
        k, d = np.concatenate(keys), np.concatenate(owner)
        order, first = groups(k)  # stable: the first of a group has the smallest id
        return owned(key[0].as_py(), k[order[first]], ids[d[order[first]]], ids)

    def owned(chunk: int, keys: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> pa.Table:
        """The chunk's keys with two bits each: is the owner the chunk's first id, is it the last? Chunks lie in the
        order of ids, so nothing else is needed to tell which of two owners is smaller; each slice begins with both ids."""
        if not len(keys):
            return slices(chunk, keys, bits, 64, 8)
        ends = np.array([ids[0], ids[-1]], "<i8")
        out = slices(chunk, keys | (owner == ends[0]).astype(U) | ((owner == ends[1]).astype(U) << U(1)), bits, 64, 8)
        head = ends.tobytes()
        return out.set_column(2, "payload", pa.array([head + p for p in out.column("payload").to_pylist()], pa.binary()))

    def smallest(key: tuple, t: pa.Table) -> pa.Table:
        """For each chunk, the keys that a document with a smaller id than any of its own has."""
        t = t.sort_by("chunk")
        data = t.column("payload").to_pylist()
        ends = np.array([np.frombuffer(p, "<i8", 2) for p in data])
        parts = [np.frombuffer(p, U, offset=16) for p in data]
        every = np.concatenate(parts)
        at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order, first = groups(every & _KEY)  # stable: a group begins in its earliest chunk
        begin = np.empty(len(every), np.int64)
        begin[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
        # the same document in two chunks: it ends the one and begins the other
        same = (ends[at[begin], 1] == ends[at, 0]) & ((every[begin] & U(2)) > 0) & ((every & U(1)) > 0)
        earlier = (at[begin] != at) & ~same
        out, lo = [], 0
        for p in parts:
            out.append((p & _KEY)[earlier[lo : lo + len(p)]].tobytes())
            lo += len(p)
        return replies(t.column("chunk").to_pylist(), out)

    def first_holders(t: pa.Table, rank: np.ndarray, found: pa.Table) -> tuple[list[tuple], np.ndarray]:
        """The phrases of each run, and which of all of them no smaller document has."""
        known = kept_of(found, "trigger")
        every = [phrases(lo, data, starts, known) for lo, _, data, starts in runs(t)]
        k = np.concatenate([np.empty(0, U), *(x[2] for x in every)])
        d = rank[np.concatenate([np.empty(0, np.int64), *(x[3] for x in every)])]
        order, first = groups(k)
        own = ~member(k, kept_of(found, "phrase"))
        if len(k):
            least = np.empty(len(k), d.dtype)
            least[order] = np.repeat(d[order[first]], np.diff(np.append(first, len(order))))
            own &= d == least
        return every, own

    def own_windows(every: list[tuple], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each run: which phrases are first held here; place, key and document of their candidate windows."""
        at = 0
        for _, _, k, d, place, w, which in every:
            mine = own[at : at + len(k)]
            at += len(k)
            good = mine[which]
            yield mine, place[good], w[good], d[which[good]]

    def refine(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        t, rank = ordered(t)
        ids = t.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        keys, owner = [np.empty(0, U)], [np.empty(0, np.int64)]
        for _, _, w, d in own_windows(*first_holders(t, rank, found)):
            order, first = groups(w)
            keys.append(w[order[first]])
            owner.append(d[order[first]])
        k, d = np.concatenate(keys), np.concatenate(owner)
        order, first = groups(k)
        return owned(key[0].as_py(), k[order[first]], ids[d[order[first]]], ids)

    def remove(key: tuple, t: pa.Table, found: pa.Table) -> pa.Table:
        t, rank = ordered(t)
        every, own = first_holders(t, rank, found)
        spots = list(own_windows(every, own))
        w = np.concatenate([np.empty(0, U), *(x[2] for x in spots)])
        owner = rank[np.concatenate([np.empty(0, np.int64), *(x[3] for x in spots)])]
        gone = member(w, kept_of(found, "window"))
        order, first = groups(w)
        if len(order):
            begin = np.empty(len(w), owner.dtype)
            begin[order] = np.repeat(owner[order[first]], np.diff(np.append(first, len(order))))
            gone |= owner > begin
        lost, spans, sizes, sha, at = [], [], [], [], 0
        for (_, part, data, starts), (low, high, *_), (mine, place, _, _) in zip(runs(t), every, spots):
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, low[~mine], 1)
            np.add.at(step, high[~mine] + 1, -1)
            begins = np.cumsum(step[:-1]) > 0
            begins[place[gone[at : at + len(place)]]] = True
            at += len(place)
            cover = covered(begins, window) if begins.any() else begins
            for i, text in enumerate(part):
                g = cover[starts[i] : starts[i + 1]]
                n = int(np.count_nonzero(g))
                sizes.append(len(text))
                lost.append(n)
                spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(bool(n) and bool(g[0])))
                sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~g].tobytes() if n else text).hexdigest())
        longs = [pa.array(x, pa.int64()) for x in (sizes, lost, spans)]
        return pa.table({"doc_id": t.column("doc_id").cast(pa.int64()), "n_bytes": longs[0], "n_removed": longs[1], "n_spans": longs[2], "kept_sha256": pa.array(sha, pa.string())})

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("kind", F.lit(name))

    trigger = kind(scratch.save(table.groupBy("chunk").applyInArrow(parse, SLICE).groupBy("bucket").applyInArrow(shared, REPLY), "triggers"), "trigger")
    scratch.drop("nothing")
    seen = table.groupBy("chunk").cogroup(trigger.groupBy("chunk")).applyInArrow(dictionary, SLICE)
    known = trigger.unionByName(kind(scratch.save(seen.groupBy("bucket").applyInArrow(smallest, REPLY), "phrases"), "phrase"))
    scratch.drop("nothing")
    refined = table.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(refine, SLICE)
    known = known.unionByName(kind(scratch.save(refined.groupBy("bucket").applyInArrow(smallest, REPLY), "windows"), "window"))
    scratch.drop("nothing")
    out = scratch.save(table.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(remove, OUT), "result")
    scratch.drop("triggers", "phrases", "windows")
    scratch.drop_tables()
    return out
