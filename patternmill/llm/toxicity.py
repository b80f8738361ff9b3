"""Toxicity scored by a weighted finite-state grammar over clauses.

A lexicon gives each word its class (insult, threat, or one that steers) and a weight. Four small transducers are
composed into one deterministic machine that reads the classes of a clause's words:

* target: after a word for the addressee, insults are *aimed*;
* negation: the next few words after "not", "never", "no" are *denied*;
* reported speech: after "said", "called", "quoted", up to the clause's end, words are *reported*;
* threat: an announcing word ("will", "gonna") arms the threat verbs that follow.

The machine is run over the whole clause, so a weight counts as its matched pattern says, not as an isolated word:
aimed patterns count more, denied and reported ones less. A document's clause scores give a few numbers, and a
logistic function of them is the score.

Learning takes at most ``sample`` labelled rows (lowest hashes first). They give the lexicon its weights, the log ratio
of a word's or word beginning's rate in toxic and in other texts. The logistic function is cross-fitted: the rows of
one half are read with the weights that the other half gives, so no row is read with what it taught itself. Only
bounded results reach the driver: ``lexicon`` entries and a few numbers for each sampled row. Nothing but the text is
an input of a score.

Defined results: null and empty texts get the score of a text without any pattern. Repeated rows are scored alike. A
text is read whole. Without labels of both classes the seeds' weights and a fixed logistic function serve. An empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, INSULT, THREAT, TARGET, NEG, REPORT, WILL, STOP = range(8)
SEEDS = {
    INSULT: "idiot idiots moron stupid dumb loser scum trash pathetic worthless disgusting clown fool imbecile vermin filth ugly coward".split(),
    THREAT: "kill hurt destroy beat crush burn stab shoot hunt bury".split(),
    TARGET: "you your yours yourself u ur they them he she tu vous toi du dich ihr sie usted ustedes".split(),
    NEG: "not never no isn't aren't wasn't don't doesn't nicht kein keine pas jamais nunca".split(),
    REPORT: "said says called quoted wrote claimed reported according allegedly sagte dit dijo".split(),
    WILL: "will gonna shall going i'll we'll".split(),
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[a-z]+)?|[.!?;\n]")
PREFIXES = range(4, 10)


class Transducer:
    """Arcs (state, symbol) -> (state, symbol, factor); a missing arc copies the symbol and keeps the state."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state: object, symbol: object) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: Transducer, symbols: list) -> Transducer:
        """What other makes of this one's output, as one machine over the states that can be reached."""
        arcs, todo, seen = {}, [(0, 0)], {(0, 0): 0}
        while todo:
            here = todo.pop()
            for s in symbols:
                a, out, x = self.step(here[0], s)
                b, out, y = other.step(here[1], out)
                if (a, b) not in seen:
                    seen[a, b] = len(seen)
                    todo.append((a, b))
                arcs[seen[here], s] = (seen[a, b], out, x * y)
        return Transducer(arcs)


def grammar(denied: float = 0.2, reported: float = 0.4, aimed: float = 1.5, armed: float = 2.0, unarmed: float = 0.3, reach: int = 3) -> Transducer:
    plain = [OTHER, INSULT, THREAT, TARGET, NEG, REPORT, WILL]
    target = Transducer({(0, TARGET): (1, TARGET, 1.0), (1, INSULT): (1, INSULT, aimed), (1, THREAT): (1, THREAT, aimed)})
    negation = {(0, NEG): (reach, NEG, 1.0)}
    for n in range(1, reach + 1):
        negation |= {(n, s): (n - 1, s, denied if s in (INSULT, THREAT) else 1.0) for s in plain} | {(n, NEG): (reach, NEG, 1.0)}
    report = Transducer({(0, REPORT): (1, REPORT, 1.0), (1, INSULT): (1, INSULT, reported), (1, THREAT): (1, THREAT, reported)})
    threat = Transducer({(0, WILL): (1, WILL, 1.0), (1, THREAT): (0, THREAT, armed), (0, THREAT): (0, THREAT, unarmed)})
    machine = target
    for other in (Transducer(negation), report, threat):
        machine = machine.compose(other, plain)
    return machine


class Lexicon(dict):
    """word -> (class, weight); beginnings of words count where the whole word isn't listed, the longest first."""

    LIMIT = 300_000

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        super().__init__()
        self.words, self.beginnings = words, beginnings
        self.fixed = {w: (c, 1.0) for c, ws in SEEDS.items() if c > THREAT for w in ws} | {m: (STOP, 0.0) for m in ".!?;\n"}
        self.threats = set(SEEDS[THREAT])

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.LIMIT:
            self.clear()
        if word in self.fixed:
            out = self.fixed[word]
        elif word in self.words:
            out = (THREAT if word in self.threats else INSULT, self.words[word])
        else:
            weight = next((self.beginnings[word[:n]] for n in reversed(PREFIXES) if word[:n] in self.beginnings and len(word) >= n), 0.0)
            out = (INSULT, weight) if weight else (OTHER, 0.0)
        self[word] = out
        return out


def clause_scores(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], int]:
    """The scores of the clauses in which a pattern matched, and the number of words."""
    found = list(map(lexicon.__getitem__, TOKEN.findall(text.lower())))
    scores: list[float] = []
    n = sum(1 for c, _ in found if c != STOP)
    hits = [i for i, (c, _) in enumerate(found) if c == INSULT or c == THREAT]
    if not hits:
        return scores, n
    at, end = 0, -1
    for i in hits:
        if i <= end:
            continue
        at, end = i, i
        while at and found[at - 1][0] != STOP:
            at -= 1
        state, total = 0, 0.0
        for end in range(at, len(found)):  # noqa: B007
            symbol, weight = found[end]
            if symbol == STOP:
                break
            state, out, factor = machine.step(state, symbol)
            if out == INSULT or out == THREAT:
                total += weight * factor
        scores.append(total)
    return scores, n


def features(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    scores, n = clause_scores(text, lexicon, machine)
    total = sum(scores)
    return [1.0, math.log1p(total), max(scores, default=0.0), 100 * total / (n + 20), math.log1p(len(scores)), math.log1p(n) / 10]


#: Used where nothing can be learned.
PRIOR = np.array([-4.0, 2.0, 0.5, 0.5, 0.5, 0.0])


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x, w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: F.Column, parts: int = 4, part: int = 2) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % parts == part


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, kind, half, documents and occurrences in toxic and other texts); word '' has the totals of words."""
    seen: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for batch in batches:
        for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = Counter(w for w in TOKEN.findall((text or "").lower()) if len(w) > 2)
            begun: Counter = Counter()
            for w, n in words.items():
                for k in PREFIXES:
                    if len(w) >= k:
                        begun[w[:k]] += n
            side = 0 if toxic == 1 else 2
            for kind, found in ((0, words), (1, begun)):
                for w, n in found.items():
                    c = seen[w, kind, half]
                    c[side] += 1
                    c[side + 1] += n
            c = seen["", 0, half]
            c[side] += 1
            c[side + 1] += words.total()
    rows = [(w, k, h, *c) for (w, k, h), c in seen.items()]
    for at in range(0, len(rows), 50_000):
        part = list(zip(*rows[at : at + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), *(pa.array(x, pa.int64()) for x in part[3:])], ["f", "kind", "half", "td", "to", "od", "oo"])


def weigh(rows: list[tuple[str, int, tuple]], least: int) -> tuple[dict, dict] | None:
    """(weights of words, weights of word beginnings) from (feature, kind, counts); None without texts of both classes."""
    totals = next((c for f, _, c in rows if f == ""), None)
    if not totals or not totals[0] or not totals[2]:
        return None
    out: tuple[dict, dict] = ({}, {})
    for f, kind, (td, to, od, oo) in rows:
        weight = math.log((to + 0.5) / (oo + 0.5)) - math.log((totals[1] + 1) / (totals[3] + 1))
        rate = math.log((td + 0.5) / (od + 0.5)) - math.log((totals[0] + 1) / (totals[2] + 1))
        if f and td >= least and weight > 2.0 and rate > 1.5:
            out[kind][f] = min(weight, 6.0) / 2
    for w in SEEDS[INSULT] + SEEDS[THREAT]:
        out[0].setdefault(w, 1.0)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, lexicon: int = 3000, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, dict, np.ndarray]:
    """Weights of words, weights of word beginnings, and the logistic function's."""
    key = labels[id_col]
    rows = labels.where(key.isNotNull() & labels["toxic"].isin(0, 1) & ~held_out(key)).select(key.alias("__id"), F.xxhash64(key).alias("__h"), labels["toxic"].alias("__toxic"))
    rows = F.broadcast(rows.orderBy("__h", "__toxic").limit(sample))  # at most `sample` rows of three numbers
    texts = docs.select(docs[id_col].alias("__doc"), docs[text_col].alias("__text")).join(rows, F.col("__doc") == F.col("__id"))
    texts = texts.select("__text", "__toxic", F.pmod(F.col("__h"), F.lit(2)).cast("int").alias("__half"))
    names = ("td", "to", "od", "oo")
    counts = texts.mapInArrow(_counts, "f string, kind int, half int, td long, to long, od long, oo long").groupBy("f", "kind")
    counts = counts.agg(*(F.sum(c).alias(c) for c in names), *(F.sum(F.when(F.col("half") == 0, F.col(c)).otherwise(0)).alias(f"{c}0") for c in names))
    top = counts.where((F.col("f") == "") | (F.col("td") >= least)).withColumn("lift", (F.col("td") + 0.1) * F.log((F.col("to") + 0.5) / (F.col("oo") + 0.5)))
    got = top.orderBy((F.col("f") != "").cast("int"), F.desc("lift"), "f", "kind").limit(lexicon + 1).collect()
    whole = [(r["f"], r["kind"], tuple(r[c] for c in names)) for r in got]
    first = [(r["f"], r["kind"], tuple(r[f"{c}0"] for c in names)) for r in got]
    second = [(f, k, tuple(a - b for a, b in zip(x, y))) for (f, k, x), (_, _, y) in zip(whole, first)]
    model, halves = weigh(whole, least), (weigh(second, least - 1), weigh(first, least - 1))  # each half is read with the other's
    if not model:
        return {w: 1.0 for w in SEEDS[INSULT] + SEEDS[THREAT]}, {}, PRIOR
    if not all(halves):
        return *model, PRIOR
    machine = grammar()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Lexicon(*h) for h in halves]
        for batch in batches:
            x = [features(t or "", known[h], machine) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "y"])

    rest = texts.mapInArrow(numbers, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rest], float)
    if not len(y) or y.min() == y.max():
        return *model, PRIOR
    return *model, fit_logistic(np.array([r["x"] for r in rest]), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    words, beginnings, w = learn(docs, labels, id_col=id_col, text_col=text_col, **learning)
    model = docs.sparkSession.sparkContext.broadcast((words, beginnings, w, grammar()))  # `lexicon` entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, beginnings, w, machine = model.value
        known = Lexicon(words, beginnings)
        for batch in batches:
            x = np.array([features(t or "", known, machine) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(w))
            score = logistic(x, w)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(docs[id_col], docs[text_col], held_out(docs[id_col]).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
