"""URL filter over a sorted digest array.

The rule list becomes one read-only file: a sorted array of 64-bit xxhash keys, the verdicts, and the full rule
strings. Spark brings the file from the shared folder to every executor once (``addFile``; a replaced executor fetches it again), each Python
worker memory-maps it, and all workers of a machine share its pages. A batch of urls is judged with a vectorised binary
search: first every suffix of every distinct host, then, for hosts that have rules, the few path lengths those rules
have. A key that is found counts only if the stored string is the same, so a hash collision can't change a verdict.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, so no rule fits and the
verdict is the default. Repeated rows each give a row. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from patternmill.llm.common import write_file

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class DigestArray:
    """Strings with a number each, sorted by 64-bit digest; built once, then memory-mapped."""

    @staticmethod
    def build(rows: Iterable[tuple[str, int]]) -> Iterator[bytes]:
        """The file's content, in parts."""
        found = dict(rows)
        order = sorted(found, key=lambda s: (key(s), s))
        data = [s.encode("utf-8", "surrogatepass") for s in order]
        ends = np.cumsum([0, *map(len, data)], dtype=np.int64)
        for part in (np.array([len(order)], np.int64), np.array([key(s) for s in order], np.uint64), ends, np.array([found[s] for s in order], np.int64)):
            yield part.tobytes()
        yield b"".join(data) or b"\0"

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        cut = [8 + 8 * n, 8 + 8 * n + 8 * (n + 1), 8 + 8 * n + 8 * (n + 1) + 8 * n]
        self.keys, self.ends, self.values = raw[8 : cut[0]].view(np.uint64), raw[cut[0] : cut[1]].view(np.int64), raw[cut[1] : cut[2]].view(np.int64)
        self.blob = raw[cut[2] :]

    def find(self, texts: list[str]) -> list[int | None]:
        """The number stored for each text, or None."""
        if not texts or not len(self.keys):
            return [None] * len(texts)
        probe = np.fromiter(map(key, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, probe)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == probe[hit]
        out: list[int | None] = [None] * len(texts)
        for i in np.flatnonzero(hit):
            want, j = texts[i].encode("utf-8", "surrogatepass"), int(at[i])
            while j < len(self.keys) and self.keys[j] == probe[i]:  # strings that share a digest lie side by side
                if bytes(self.blob[self.ends[j] : self.ends[j + 1]]) == want:
                    out[i] = int(self.values[j])
                    break
                j += 1
        return out


class UrlRules:
    """Rules ``(verdict, 'host/path-prefix')`` and plainly listed hosts, as two digest arrays."""

    def __init__(self, rules: Iterable[tuple[str, str]], listed_hosts: Iterable[str] = ()):
        full: dict[str, int] = {}
        lengths: dict[str, set[int]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            host = host.translate(_LOWER)
            full[host + slash + path] = int(verdict == "block")
            lengths.setdefault(host, set()).add(len(slash + path))
        self.full = full
        self.lists = sorted({tuple(sorted(x)) for x in lengths.values()})
        number = {x: i for i, x in enumerate(self.lists)}
        self.hosts = {h: number[tuple(sorted(x))] for h, x in lengths.items()}
        self.listed = {h.translate(_LOWER): 1 for h in listed_hosts}

    def ship(self, spark: SparkSession) -> dict:
        """Write the arrays to the shared folder, from where executors fetch them; returns what a task needs to open them."""
        names = {}
        for label, rows in (("full", self.full), ("hosts", self.hosts), ("listed", self.listed)):
            names[label] = f"urlrules-{label}-{uuid.uuid4().hex}.bin"
            spark.sparkContext.addFile(write_file(spark, names[label], DigestArray.build(rows.items())))
        return names | {"lists": self.lists}


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(urls: list[str | None], full: DigestArray, hosts: DigestArray, listed: DigestArray, lists: list, default: str) -> tuple[list, list, list, list]:
    parts = [split_url(u) for u in urls]
    names = sorted({h for h, _ in parts if h})
    flat = [(n, s) for n in names for s in _suffixes(n)]
    strings = [s for _, s in flat]
    ruled: dict[str, list[tuple[str, tuple]]] = {}
    bad: set[str] = set()
    for (n, s), which, on_list in zip(flat, hosts.find(strings), listed.find(strings)):
        if which is not None:
            ruled.setdefault(n, []).append((s, lists[which]))
        if on_list is not None:
            bad.add(n)
    owner, probes = [], []
    for i, (h, p) in enumerate(parts):
        for s, lengths in ruled.get(h, ()):
            for size in lengths:
                if size <= len(p):
                    owner.append(i)
                    probes.append(s + p[:size])
    rule: list[str | None] = [None] * len(parts)
    verdict = ["block" if h in bad else default for h, _ in parts]
    for i, text, value in zip(owner, probes, full.find(probes)):
        if value is not None and (rule[i] is None or len(text) > len(rule[i])):
            rule[i], verdict[i] = text, "block" if value else "allow"
    return [h for h, _ in parts], [p for _, p in parts], rule, verdict


def filter_urls(pages: DataFrame, rules: UrlRules, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest rule that fits (or null) and the verdict.

    No shuffle: a rule list is shipped, the pages stay where they are. A host that is only listed (no path rule fits)
    is blocked with a null rule.
    """
    spec = rules.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, hosts, listed = (DigestArray(SparkFiles.get(spec[x])) for x in ("full", "hosts", "listed"))
        for batch in batches:
            host, path, rule, verdict = judge(batch.column(1).to_pylist(), full, hosts, listed, spec["lists"], default)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(pages[id_col], pages[url_col]).mapInArrow(run, SCHEMA)
