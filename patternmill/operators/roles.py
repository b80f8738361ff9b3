"""Roles: groups of entities with like features, induced where they shorten the description, and who belongs to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.functions.text import weighted_jaccard

HEAVY = ("dec:", "sup:", "ret:")


def bags(items: DataFrame) -> DataFrame:
    """items (part, item, feats) -> distinct feature bags (part, feats, w: items with it, item: the smallest)."""
    return items.withColumn("feats", F.array_sort(F.array_distinct("feats"))).groupBy("part", "feats").agg(F.count(F.lit(1)).alias("w"), F.min("item").alias("item"))


def distances(features: list[list[str]]) -> np.ndarray:
    """Weighted Jaccard distance of every two bags."""
    names = sorted({f for bag in features for f in bag})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(features), max(1, len(names))))
    for row, bag in enumerate(features):
        x[row, [at[f] for f in bag]] = 1
    weight = np.array([3.0 if f.startswith(HEAVY) else 1.0 for f in names] or [1.0])
    shared = (x * weight) @ x.T
    size = (x * weight).sum(axis=1)
    union = size[:, None] + size[None, :] - shared
    return 1 - np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def description(members: np.ndarray, x: np.ndarray, w: np.ndarray) -> float:
    """Bits to code the features of a cluster's bags, each feature by its own rate, and the rates."""
    n = w[members].sum()
    counts = (x[members] * w[members, None]).sum(axis=0)
    p = counts[counts > 0] / n
    mixed = p[p < 1]
    entropy = -(mixed * np.log2(mixed) + (1 - mixed) * np.log2(1 - mixed)).sum()
    return float(n * entropy + len(p) * 0.5 * np.log2(max(n, 2)))


def agglomerate(features: list[list[str]], w: np.ndarray) -> list[list[int]]:
    """Average linkage; of all the levels, the partition whose description is shortest."""
    n = len(features)
    names = sorted({f for bag in features for f in bag})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((n, max(1, len(names))))
    for row, bag in enumerate(features):
        x[row, [at[f] for f in bag]] = 1
    d = distances(features)
    d[np.tril_indices(n)] = np.inf  # each pair once; the first of equal distances in row order is taken
    size, members = w.astype(float).copy(), {i: [i] for i in range(n)}
    bits = {i: description(np.array([i]), x, w) for i in range(n)}
    total = sum(bits.values())
    name = np.log2(max(n, 1))
    least, best = total + n * name, [list(m) for m in members.values()]
    while len(members) > 1:
        a, b = np.unravel_index(np.argmin(d), d.shape)
        a, b = int(a), int(b)
        row = lambda k: np.minimum(d[k, :], d[:, k])  # noqa: E731, B023
        merged = (size[a] * row(a) + size[b] * row(b)) / (size[a] + size[b])
        d[b, :] = d[:, b] = np.inf
        others = np.array([k for k in members if k not in (a, b)], int)
        d[a, others[others > a]] = merged[others[others > a]]
        d[others[others < a], a] = merged[others[others < a]]
        members[a] += members.pop(b)
        size[a] += size[b]
        total -= bits[a] + bits.pop(b)
        bits[a] = description(np.array(members[a]), x, w)
        total += bits[a]
        if total + len(members) * name < least:
            least, best = total + len(members) * name, [list(m) for m in members.values()]
    return best


def induce(items: DataFrame, most: int = 700, least_weight: float = 12, least_cluster: float = 3) -> DataFrame:
    """items (part, item, feats) -> medoids (part, role, feats, weight, label).

    Each part's distinct bags are clustered in one task; a systematic sample of ``most`` bags bounds its size. Parts
    lighter than ``least_weight`` have no roles, clusters lighter than ``least_cluster`` are none.
    """
    by = bags(items)
    order = Window.partitionBy("part").orderBy("feats")
    total = by.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    by = by.withColumn("r", F.row_number().over(order) - 1).join(total, "part")
    step = F.greatest(F.col("n") / most, F.lit(1.0))
    # every step-th bag in order: the r for which floor(k * step) = r has a solution
    by = by.where(F.floor(F.ceil(F.col("r") / step) * step) == F.col("r"))

    shape = pa.schema([("part", pa.string()), ("role", pa.int32()), ("feats", pa.list_(pa.string())), ("weight", pa.float64()), ("label", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        features, w, part = table.column("feats").to_pylist(), table.column("w").to_numpy().astype(float), table.column("part")[0].as_py()
        rows = []
        if w.sum() >= least_weight:
            d = distances(features)
            for cluster in agglomerate(features, w):
                weight = w[cluster].sum()
                if weight < least_cluster:
                    continue
                cost = d[np.ix_(cluster, cluster)] @ w[cluster]
                medoid = cluster[int(np.argmin(cost))]
                count: dict[str, float] = {}
                for i in cluster:
                    for f in features[i]:
                        count[f] = count.get(f, 0) + w[i]
                said = sorted((f for f, c in count.items() if 2 * c >= weight), key=lambda f: (-count[f], f))[:3]  # noqa: B023
                rows.append((features[medoid], weight, "+".join(f.split(":", 1)[-1] for f in said) or "group"))
        rows.sort(key=lambda r: (-r[1], r[0]))
        found = [{"part": part, "role": i, "feats": f, "weight": x, "label": y} for i, (f, x, y) in enumerate(rows)]
        return pa.Table.from_pylist(found, shape)

    return by.select("part", "r", "feats", "w").groupBy("part").applyInArrow(run, "part string, role int, feats array<string>, weight double, label string")


def assign(items: DataFrame, medoids: DataFrame, least: float = 0.35, gap: float = 0.15, same: float = 0.6) -> DataFrame:
    """Nearest medoid of each item, and whether it is ambiguous: too far, or not clearly nearer than another role.

    Medoids are a few per part; those that are nearly the best one's twin are no other role. Items that share nothing
    with any medoid have no role.
    """
    m = medoids.select("part", "role", F.col("feats").alias("mf"))
    rows = items.join(m, "part").withColumn("near", weighted_jaccard(F.col("feats"), F.col("mf")))
    rank = F.row_number().over(Window.partitionBy("part", "item").orderBy(F.desc("near"), "role"))
    best = rows.withColumn("r", rank).where("r = 1").select("part", "item", F.col("role").alias("best"), F.col("near").alias("m1"), F.col("mf").alias("bf"))
    twin = weighted_jaccard(F.col("mf"), F.col("bf")) >= same
    second = rows.join(best, ["part", "item"]).where((F.col("role") != F.col("best")) & ~twin).groupBy("part", "item").agg(F.max("near").alias("m2"))
    out = best.join(second, ["part", "item"], "left").withColumn("m2", F.coalesce("m2", F.lit(-1.0))).where(F.col("m1") > 0)
    return out.select("part", "item", F.col("best").alias("role"), F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), ((F.col("m1") < least) | (F.col("m1") - F.col("m2") < gap)).alias("ambiguous"))


def directory_cuts(files: DataFrame, categories: list[str]) -> DataFrame:
    """files (path, categories..) -> regions: directories whose files are coded together, where cutting saves bits.

    Counts of every directory prefix are aggregated by Spark; the tree of directories that is left is small and is
    decided bottom-up in one task.
    """
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    rows = files.select(chain.alias("dirs"), *categories)
    counts = rows.select(F.explode(F.transform("dirs", lambda d: F.struct(d.alias("dir"), (d == F.element_at("dirs", -1)).alias("own")))).alias("d"), *categories).select("d.dir", "d.own", *categories)
    long = counts.unpivot(["dir", "own"], categories, "c", "v").groupBy("dir", "c", "v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("own"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches), ignore_index=True)
        if not len(table):
            return
        every, own = {}, {}
        for d, c, v, n, o in table[["dir", "c", "v", "n", "own"]].itertuples(index=False):
            every.setdefault(d, {}).setdefault(c, []).append(n)
            if o:
                own.setdefault(d, {}).setdefault(c, []).append(o)
        cut = np.log2(max(2, len(every)))

        def bits(cells: dict) -> float:
            cost = 0.0
            for counts in cells.values():
                n = np.array(counts, float)
                cost += float((n * np.log2(n.sum() / n)).sum() + 0.5 * (len(n) - 1) * np.log2(max(n.sum(), 2)))
            return cost

        below: dict[str, list[str]] = {}
        for d in every:
            if d != ".":
                below.setdefault(d.rsplit("/", 1)[0] if "/" in d else ".", []).append(d)
        cost, regions = {}, {}
        for d in sorted(every, key=lambda x: (x == ".", -x.count("/"), x)):  # deepest first, the root last
            inner = sorted(below.get(d, []))
            apart = bits(own.get(d, {})) + (cut if d in own else 0) + sum(cost[c] + cut for c in inner)
            together = bits(every[d])
            if inner and apart < together:
                cost[d], regions[d] = apart, ([d] if d in own else []) + [r for c in inner for r in regions[c]]
            else:
                cost[d], regions[d] = together + cut, [d]
        found = sorted(r for r in regions["."] if r != ".")
        if found:
            yield pd.DataFrame({"dir": found})

    return long.coalesce(1).mapInPandas(decide, "dir string")
