"""Packing token pieces into fixed-length sequences.

Documents are tokenised where they lie; only (doc_id, start, length, checksum, total) of each piece is shuffled. A
document is cut into full pieces of ``capacity`` ids and one tail. Pieces are dealt by a hash of number, place and
content (so rows without a number spread too) into randomised groups of about ``group_docs`` documents and each group is packed on its own by first-fit decreasing; a tournament tree over the
bins' free capacities finds the first bin that fits in logarithmic time. Groups are independent, so a lost executor
costs only its groups, and the work of a task doesn't grow with the input.

Defined results: null and empty texts are documents of one id (the end id). Rows that repeat a doc_id are packed as
documents of their own. A text of any length is tokenised whole. An empty table gives an empty one. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.vectors import kept, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


#: Marks that the tokenizer's splitter keeps together as a token of their own after letters; without the apostrophe
#: (it begins endings of words) and the opening angle bracket (it begins special tokens).
MARKS = '.,;:!?&$*#%|>()[]{}"-_/+=~^@'
#: The first character that isn't Latin-1; beyond it, a mark may combine with the letter before.
BEYOND = "\u0100"


class WordMemo(dict):
    """Ids of blank-separated words as little-endian bytes. Ids never depend on what stands beyond a blank.

    One memo serves all packing tasks of a Python worker. It has two generations of at most ``LIMIT`` words each (some
    80 MB in all): words met again move to the younger one, which becomes the older when it is full. A word of letters
    with marks behind is two tokens to the tokenizer's splitter, so only its letters are encoded anew, many words in
    one call.
    """

    LIMIT, LONGEST = 200_000, 40

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    @classmethod
    def of(cls, path: str) -> WordMemo:
        memos = kept("packing", dict)
        if path not in memos:
            memos[path] = cls(path)
        return memos[path]

    def _encode(self, words: list[str], each: int = 4096) -> None:
        for at in range(0, len(words), each):
            part = words[at : at + each]
            for w, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                self[w] = np.asarray(e.ids, "<u4").tobytes()

    def _encode_letters(self, words: list[str], each: int = 4096) -> None:
        """Words that the splitter leaves whole, as one text: the splitter's word numbers tell them apart."""
        for at in range(0, len(words), each):
            part = words[at : at + each]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.asarray(e.ids, "<u4"), np.asarray(e.word_ids)
            ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)) * 4
            if len(ends) != len(part):
                self._encode(part)
                continue
            data, lo = ids.tobytes(), 0
            for w, hi in zip(part, ends.tolist()):
                self[w] = data[lo:hi]
                lo = hi

    def learn(self, words: list[str]) -> None:
        """Afterwards each of the words is a key; until the next call."""
        for w in self.long:
            self.pop(w, None)
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        older, new = self.older, []
        for w in words:
            if w not in self:
                if w in older:
                    self[w] = older[w]
                else:
                    new.append(w)
        letters, rest, marked = [], [], []
        for w in new:
            head = w.rstrip(MARKS)
            if not head.isalpha() or not (head.isascii() or max(head) < BEYOND):
                rest.append(w)
            elif len(head) == len(w):
                letters.append(w)
            else:
                marked.append((w, head, w[len(head) :]))
        known = {*letters, *rest}
        letters += {h for _, h, _ in marked if h not in self and h not in known}
        rest += {t for _, _, t in marked if t not in self and t not in known}
        self._encode_letters(letters)
        self._encode(rest)
        self.long = [w for w in (*new, *letters, *rest) if len(w) > self.LONGEST]
        for w, head, tail in marked:
            self[w] = self[head] + self[tail]


def encode(texts: pa.Array, memo: WordMemo, limit: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids end to end, where each text begins and the end) of runs of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        done = int(sizes[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + limit)))
        split = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
        words = split.flatten().dictionary_encode()
        distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        memo.learn(distinct)
        parts = list(map(memo.__getitem__, distinct))
        flat, size = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(size) - size
        length = size[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[at] - (ends - length), length) + np.arange(total)]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        yield lo, ids, np.concatenate(([0], ends))[offsets]
        lo = hi


class TournamentTree:
    """Free capacity of bins; ``first_fit`` finds the lowest bin with room for a piece."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> tuple[int, int]:
        """(bin, free space before the piece is put in)."""
        tree, at = self.tree, 1
        while at < self.size:
            at += at
            if tree[at] < need:
                at += 1
        free = tree[at]
        found, left = at - self.size, free - need
        tree[at] = left
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            best = a if a > b else b
            if tree[at] == best:
                break
            tree[at] = best
        return found, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ties go by position."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        b, free = tree.first_fit(need)
        bins[i], offsets[i] = b, capacity - free
    return bins, offsets


def pack_documents(docs: DataFrame, tokenizer_path: Callable[[], str] | str, capacity: int = 2048, end_id: int = 1, group_docs: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place; ``tokenizer_path`` is a path or a function that gives it on the executor."""

    @tidy("packing")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo.of(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for lo, ids, begins in encode(batch.column(1), memo):
                rows: list[list] = [[], [], [], [], []]
                data, begins = memoryview(ids.tobytes()), begins.tolist()
                for doc, a, b in zip(docs_[lo:], begins, begins[1:]):
                    total = b - a + 1
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * min(b, a + start + length)])
                        if start + length == total:
                            crc = zlib.crc32(end, crc)
                        for column, value in zip(rows, (doc, start, length, crc, total)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = key[0].as_py()
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.select(docs[id_col], docs[text_col]).mapInArrow(cut, PIECES)
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("grp").applyInArrow(pack, PACKED)
