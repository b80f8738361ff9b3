"""Plain versions of the corpus operators, and frames with the hard cases."""

import hashlib
import re
from collections import Counter

from pyspark.sql import types as T

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\W_]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *(T.StructField(x, T.StringType()) for x in ("t", "h", "g", "k", "rep", "body", "chunk", "bucket", "grp", "key", "band", "row", "host", "digest", "line", "words", "comp", "shard", "id", "b", "a", "n")),
])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def tokens(text):
    return WORD.findall((text or "").lower())


def shingles(text, width=5):
    w = tokens(text)
    k = min(width, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    if not x or not y:
        return float((a or "") == (b or "") and not x and not y)
    return sum((x & y).values()) / sum((x | y).values())


def classes(rows, threshold=0.8):
    """doc_id -> smallest doc_id of its class, over all pairs."""
    up = {d: d for d, _ in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    bags = [(d, t, shingles(t)) for d, t in rows]
    for i, (d, t, x) in enumerate(bags):
        for e, u, y in bags[:i]:
            small, large = sorted((x.total(), y.total()))
            if small < threshold * large:
                continue
            if alike(t, u) >= threshold:
                p, q = sorted((top(d), top(e)))
                up[q] = p
    return {d: top(d) for d, _ in rows}


def drop_lines(rows, limit=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter()
    documents = {}
    for d, t in rows:
        documents.setdefault(("t", t) if d is None else d, set()).update(key(x) for x in (t or "").split("\n"))
    for keys in documents.values():
        seen.update(keys)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not key(x) or seen[key(x)] < limit]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def remove_words(rows, window=35):
    at = Counter()
    split = [(d, words(t)) for d, t in rows]
    for _, w in split:
        at.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if at[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def remove_bytes(rows, window=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    low = lambda d: -(1 << 63) if d is None else d
    for d, b in data:
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            first[s] = min(first.get(s, low(d)), low(d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < low(d):
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def leaks(rows, items, threshold=0.8):
    out = []
    bags = [(i, set(shingles(t))) for i, t in items if len(tokens(t)) >= 5]
    for d, t in rows:
        own = set(shingles(t)) if len(tokens(t)) >= 5 else set()
        out += [(d, i, len(s), len(s & own)) for i, s in bags if len(s & own) >= threshold * len(s)]
    return out


def frame(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows with columns whose names clash with those used inside."""
    full = [(d, t, "en", *(s or ["src"]), None, *["clash"] * 22) for d, t, *s in rows]
    return spark.createDataFrame(full, SCHEMA)


def hard_rows():
    base = " ".join(f"w{i % 97}x{i * i % 89}" for i in range(300))
    near = base.replace("w5x25", "other", 1)
    return [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n \t\n"), (7, "short"), (8, "short"), (9, "one two three four"), (None, "a text without a number of its own"), (None, None),
        (10, "line a\nLINE A \n\nline b"), (11, "x" * 120_000), (12, "z" * 60 + "é" * 200 + " \u0130\u00df \U0001f600 " + "z" * 60), (13, " ".join(["same"] * 30_000)), (14, "tail " + base[:700]), (15, "\r\n".join(["windows", "lines"])),
        (-3, base[200:900] + "\n" + base[:400]), (16, "<|endoftext|> don't. A--b 12,5 " + base[:50]),
    ]
