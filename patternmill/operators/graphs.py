"""Directed graphs as tables: reachability, components, layers, cuts of circles, ownership in a tree of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Steps:
    """Tables of an iteration, each written and read again, so that the plan of a step never holds the steps before."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.n = spark, folder, 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/step{self.n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def strong_components(edges: DataFrame, folder: str, most: int = 200) -> DataFrame:
    """edges (src, dst) -> (node, comp), comp the smallest node that it reaches and that reaches it, for circles.

    Colouring: the smallest colour that reaches a node spreads forwards; the nodes of a colour that reach its root
    backwards are its component and leave. Nodes that have no way in or out are trimmed first. A node outside every
    circle is its own component.
    """
    steps = Steps(edges.sparkSession, folder)
    edges = steps.save(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = steps.save(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    found = None
    live = edges
    for _ in range(most):
        while True:  # trim
            inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            inner = steps.save(inner)
            before, live = live.count(), inner
            if live.count() == before:
                break
        if live.isEmpty():
            break
        colour = live.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node"))
        while True:  # forwards
            push = live.join(colour, live["src"] == colour["node"]).groupBy("dst").agg(F.min("colour").alias("push"))
            new = colour.join(push, colour["node"] == push["dst"], "left").select("node", F.least("colour", F.coalesce("push", "colour")).alias("new"), "colour")
            new = steps.save(new)
            changed = not new.where("new <> colour").isEmpty()
            colour = new.select("node", F.col("new").alias("colour"))
            if not changed:
                break
        inside = live.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2").select("src", "dst", "colour")
        inside = steps.save(inside)
        back = steps.save(colour.where("node = colour"))
        while True:  # backwards, within the colour
            more = inside.join(back.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")
            grown = steps.save(back.unionByName(more).distinct())
            done = grown.count() == back.count()
            back = grown
            if done:
                break
        part = back.select("node", F.col("colour").alias("comp"))
        found = part if found is None else found.unionByName(part)
        gone = back.select("node")
        live = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        live = steps.save(live)
    if found is None:
        return nodes.select("node", F.col("node").alias("comp"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def layers(edges: DataFrame, components: DataFrame, folder: str) -> DataFrame:
    """(node, layer): the longest way from a node to a leaf of the condensed graph; leaves have layer 0."""
    steps = Steps(edges.sparkSession, folder)
    a = components.select(F.col("node").alias("src"), F.col("comp").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("comp").alias("b"))
    dag = steps.save(edges.join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct())
    level = steps.save(components.select(F.col("comp").alias("a")).distinct().withColumn("layer", F.lit(0)))
    while True:
        up = dag.join(level.select(F.col("a").alias("b"), F.col("layer").alias("lb")), "b").groupBy("a").agg((F.max("lb") + 1).alias("up"))
        new = steps.save(level.join(up, "a", "left").select("a", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), F.col("layer").alias("was")))
        if new.where("layer <> was").isEmpty():
            break
        level = new.select("a", "layer")
    return components.join(level.select(F.col("a").alias("comp"), "layer"), "comp").select("node", "comp", "layer")


def reach(edges: DataFrame, sources: DataFrame, folder: str, hops: int = 64) -> DataFrame:
    """sources (src) -> (src, node, hops) for every node within ``hops`` steps, by the shortest way."""
    steps = Steps(edges.sparkSession, folder)
    edges = steps.save(edges.select("src", "dst").distinct())
    seen = steps.save(sources.select("src", F.col("src").alias("node"), F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, hops + 1):
        step = front.select(F.col("src").alias("s"), F.col("node").alias("src")).join(edges, "src").select(F.col("s").alias("src"), F.col("dst").alias("node")).distinct()
        front = steps.save(step.join(seen, ["src", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = steps.save(seen.unionByName(front))
    return seen


def cheapest_order(nodes: list, weight: dict[tuple, float], exact: int = 16) -> tuple[list, bool]:
    """An order of the nodes with the least weight of edges that point backwards, and whether it is the least for sure.

    Up to ``exact`` nodes by dynamic programming over sets; beyond, nodes without weight in or out go to the ends, then
    the one with the largest surplus, and single nodes are moved while that helps.
    """
    n = len(nodes)
    at = {v: i for i, v in enumerate(nodes)}
    out = [[0.0] * n for _ in range(n)]
    for (a, b), w in weight.items():
        out[at[a]][at[b]] += w
    if n <= exact:
        best, last = [float("inf")] * (1 << n), [-1] * (1 << n)
        best[0] = 0.0
        for chosen in range(1 << n):
            base = best[chosen]
            for v in range(n):
                if chosen >> v & 1:
                    continue
                cost = base + sum(w for u, w in enumerate(out[v]) if w and chosen >> u & 1)
                if cost < best[chosen | 1 << v]:
                    best[chosen | 1 << v], last[chosen | 1 << v] = cost, v
        order, left = [], (1 << n) - 1
        while left:
            order.append(last[left])
            left ^= 1 << last[left]
        return [nodes[v] for v in reversed(order)], True
    rest, front, end = set(range(n)), [], []
    while rest:
        flow = {v: (sum(out[v][u] for u in rest), sum(out[u][v] for u in rest)) for v in rest}
        sinks = sorted(v for v in rest if not flow[v][0])
        starts = sorted(v for v in rest if not flow[v][1] and flow[v][0])
        if sinks:
            end = sinks + end
            rest -= set(sinks)
        elif starts:
            front += starts
            rest -= set(starts)
        else:
            v = min(rest, key=lambda x: (flow[x][1] - flow[x][0], x))
            front.append(v)
            rest.discard(v)
    order = front + end
    moved = True
    while moved:
        moved = False
        for v in range(n):
            i = order.index(v)
            others = order[:i] + order[i + 1 :]
            # backward weight of v at each place: its edges to those before it, and edges to it from those behind
            cost = sum(out[u][v] for u in others)
            costs = [cost]
            for u in others:
                cost += out[v][u] - out[u][v]
                costs.append(cost)
            j = min(range(n), key=lambda k: (costs[k], abs(k - i), k))
            if costs[j] < costs[i] - 1e-12:
                order = others[:j] + [v] + others[j:]
                moved = True
    return [nodes[v] for v in order], False


def feedback_arcs(edges: DataFrame, components: DataFrame, exact: int = 16) -> DataFrame:
    """edges (src, dst, n) inside components -> the edges to cut so that no circle is left: (comp, src, dst, n, exact).

    One task per component; components of circles are what is small in a layered graph.
    """
    a = components.select(F.col("node").alias("src"), "comp")
    b = components.select(F.col("node").alias("dst"), F.col("comp").alias("c2"))
    inner = edges.where("src <> dst").join(a, "src").join(b, "dst").where("comp = c2").groupBy("comp", "src", "dst").agg(F.sum("n").alias("n"))
    kind = dict(inner.dtypes)["src"]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf["src"], *pdf["dst"]})
        order, sure = cheapest_order(nodes, {(s, d): n for s, d, n in pdf[["src", "dst", "n"]].itertuples(index=False)}, exact)
        place = {v: i for i, v in enumerate(order)}
        back = pdf[[place[s] > place[d] for s, d in zip(pdf["src"], pdf["dst"])]].copy()
        back["exact"] = sure
        return back[["comp", "src", "dst", "n", "exact"]]

    return inner.groupBy("comp").applyInPandas(cut, f"comp {kind}, src {kind}, dst {kind}, n long, exact boolean")


def deepest_owner(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files (path), nodes (id, dir, size) -> each file's owner: the deepest directory, then the smaller node, then id.

    The prefix join is an equality join on the prefixes of a path.
    """
    parts = F.split("path", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    rows = files.select("path", F.explode(up).alias("dir")).join(nodes, "dir")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.length("dir")), "size", "id"))
    return rows.withColumn("r", rank).where("r = 1").select("path", "id")


def majority_projection(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """edges (src, dst, n) between units, owner (unit, grp) -> edges between groups, by the group most of a unit's rows name."""
    n = owner.groupBy("unit", "grp").agg(F.count(F.lit(1)).alias("m"))
    top = n.groupBy("unit").agg(F.min(F.struct((-F.col("m")).alias("o"), "grp")).alias("b")).select("unit", F.col("b.grp").alias("grp"))
    a, b = top.select(F.col("unit").alias("src"), F.col("grp").alias("a")), top.select(F.col("unit").alias("dst"), F.col("grp").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fan_in_spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gini coefficient of how many different nodes point at a node."""
    degree = nodes.join(edges.where("src <> dst").select("src", F.col("dst").alias("node")).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("d")), "node", "left")
    by = degree.groupBy(F.coalesce("d", F.lit(0)).alias("d")).agg(F.count(F.lit(1)).alias("m"))
    from patternmill.operators.ordered import running_sums

    rows = running_sums(by, "d", {"before": "m"})
    # the ranks of m equal degrees after ``before`` others add up to m * before + m (m + 1) / 2
    ranked = F.sum(F.col("d") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    t = rows.agg(ranked.alias("r"), F.sum(F.col("d") * F.col("m")).alias("s"), F.sum("m").alias("n"))
    return t.select("n", F.round(F.when(F.col("s") > 0, 2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"))
