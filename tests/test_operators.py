"""Operators on small planted frames, against plain versions and properties."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternmill.functions import cells
from patternmill.functions import text as T
from patternmill.operators import facts, graphs, matching, nulls, retrieval, roles, timeline, vocabulary
from patternmill.operators import evaluation as E
from patternmill.operators.ordered import running_sums
from patternmill.streaming import history


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_stems_and_shapes(spark):
    stems = column(spark, ["classes", "class", "entities", "entity", "routing", "router", "route", "extraction", "ab", "Handlers"], T.norm_tok)
    assert stems[0] == stems[1] and stems[2] == stems[3] and stems[4] == stems[5] == stems[6]
    assert stems[7] == "extract" and stems[8] == "ab" and stems[9] == "handl"
    shapes = column(spark, ["Crlf", "BaseDto", "_id", "a__b", "x-y-z", "A.b", "", None, "é", "_Ab", "HTTPServer2"], T.name_shape)
    assert shapes == ["(Ua)+", "(Ua)+", "(_a)+", "a(_)+a", "a(-a)+", "U(.a)+", "?", "?", "?", "(_U)+a", "(Ua)+"]


def test_paths(spark):
    rows = spark.createDataFrame([("../b/c.ts", "src/a/x.ts"), ("./y.js", "src/a/x.ts"), ("react", "a.ts")], "s string, p string")
    assert [r.o for r in rows.select(T.resolve_import(F.col("s"), F.col("p")).alias("o")).collect()] == ["~/src/b/c", "~/src/a/y", "react"]
    paths = ["src/a.ts", "src/x/a.ts", "a.ts", "src/x/b.js", "lib/q.spec.ts"]
    hits = lambda g: [p for p, y in zip(paths, column(spark, paths, lambda c: T.matches_glob(c, g))) if y]
    assert hits("src/**/*.ts") == ["src/a.ts", "src/x/a.ts"] and hits("*.ts") == ["a.ts"] and hits("**/*.{js,spec.ts}") == ["src/x/b.js", "lib/q.spec.ts"]


def test_cells(spark):
    xs = [0.5, 1.0, 3.5, 20.0, 1e6]
    assert np.allclose(column(spark, xs, cells.log_gamma, "double"), [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-11)
    assert abs(cells.incomplete_beta(0.3, 2, 5) - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2, 7))) < 1e-12
    p = [0.2, 0.5, 0.9]
    number = Counter()
    for bits in itertools.product((0, 1), repeat=3):
        number[sum(bits)] += math.prod(q if b else 1 - q for b, q in zip(bits, p))
    got = spark.createDataFrame([(p,)], "p array<double>").select(cells.all_given_most(F.col("p"), F.lit(2)).alias("x")).first().x
    assert abs(got - number[3] / (number[2] + number[3])) < 1e-12
    cells.register(spark)
    assert spark.sql("SELECT kt(3, 4, 2) AS a, clears_loss(20, 20, 2) AS b, beta_cdf(0.5D, 2D, 2D) AS c").first()[:] == (0.7, True, pytest.approx(0.5))


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), int(n)) for g in "ab" for x, n in zip(rng.permutation(300) ** 2, rng.integers(0, 9, 300))]
    out = running_sums(spark.createDataFrame(rows, "g string, x double, n long"), "x", {"before": "n"}, ("g",), 7).collect()
    assert len(out) == len(rows) and all(r.before == sum(n for g, x, n in rows if g == r.g and x < r.x) for r in out)


def scopes(spark, rows):
    """(scope, role, dirs, v) with one boolean property each, all of weight one and old enough."""
    return spark.createDataFrame([(s, "file", role, False, dirs, "has:guard", v, 1.0, True) for s, role, dirs, v in rows], "scope long, kind string, role string, ambiguous boolean, dirs array<string>, pid string, v string, w double, survived boolean")


def test_conventions_deviants_and_silence(spark):
    rows = [(i, "handler", ["src", "src/h"], "true") for i in range(60)] + [(60, "handler", ["src", "src/h"], "false")]
    rows += [(100 + i, "view", ["src", "src/v"], "true" if i % 2 else "false") for i in range(60)]
    ctx = facts.contexts(scopes(spark, rows))
    counts = facts.cube(ctx)
    found = facts.scored(counts)
    said = {(r.cid, r.expected) for r in facts.spoken(found).collect()}
    assert said == {("r[handler]", "true"), ("d[src/h]", "true")}
    dev = facts.deviations(ctx, counts, facts.spoken(found)).collect()
    assert [(r.scope, r.expected) for r in dev] == [(60, "true")]
    even = facts.contexts(scopes(spark, [(i, "r" + str(i % 2), ["s"], "true" if i // 2 % 2 else "false") for i in range(120)]))
    assert facts.spoken(facts.scored(facts.cube(even))).count() == 0, "no convention, nothing said"
    young = scopes(spark, rows).withColumn("survived", F.lit(False))
    assert facts.spoken(facts.scored(facts.cube(facts.contexts(young)))).count() == 0, "without history nothing is stated"


def test_absence_needs_a_contrast(spark):
    rows = [(i, "view", ["v"], "false") for i in range(80)] + [(100 + i, "handler", ["h"], "true") for i in range(80)]
    said = {(r.cid, r.expected) for r in facts.spoken(facts.scored(facts.cube(facts.contexts(scopes(spark, rows))))).collect()}
    assert ("r[view]", "false") in said and ("d[v]", "false") in said
    never = [(i, "view" if i % 2 else "handler", ["v" if i % 2 else "h"], "false") for i in range(160)]
    assert facts.spoken(facts.scored(facts.cube(facts.contexts(scopes(spark, never))))).count() == 0, "what nobody has is no rule"


def strong(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_layers_and_cuts(spark, tmp_path):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 24, (30, 2)) if a != b})
    df = spark.createDataFrame([(a, b, 1 + (a * 7 + b) % 5) for a, b in edges], "src long, dst long, n long")
    comp = graphs.strong_components(df, str(tmp_path / "c"))
    got = {r.node: r.comp for r in comp.collect()}
    assert got == strong(edges)
    layer = {r.node: r.layer for r in graphs.layers(df, comp, str(tmp_path / "l")).collect()}
    assert all(layer[a] > layer[b] for a, b in edges if got[a] != got[b]) and min(layer.values()) == 0
    cut = {(r.src, r.dst) for r in graphs.feedback_arcs(df, comp).collect()}
    assert set(strong([e for e in edges if e not in cut]).values()) == {x for e in edges for x in e if x in strong([e for e in edges if e not in cut])}


def test_cheapest_order():
    rng = np.random.default_rng(2)
    for n in (3, 5, 6):
        w = {(a, b): float(x) for (a, b), x in zip(itertools.permutations(range(n), 2), rng.integers(0, 6, n * n)) if x}
        cost = lambda o, w=w: sum(x for (a, b), x in w.items() if o.index(a) > o.index(b))
        best = min(cost(list(o)) for o in itertools.permutations(range(n)))
        order, sure = graphs.cheapest_order(list(range(n)), w)
        assert sure and cost(order) == best
        rough, sure = graphs.cheapest_order(list(range(n)), w, exact=1)
        assert not sure and best <= cost(rough) <= sum(w.values()) / 2


def test_curveball_keeps_both_margins(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(u)) for s in range(200) for u in set(rng.integers(0, 30, 6))]
    df = spark.createDataFrame(rows, "sha long, unit long")
    out = [tuple(r) for r in nulls.curveball(df, 4, block=60).collect()]
    assert Counter(s for s, _ in out) == Counter(s for s, _ in rows) and Counter(u for _, u in out) == Counter(u for _, u in rows)
    assert len(set(out)) == len(out) and len(set(out) & set(rows)) < 0.9 * len(rows)
    kept = nulls.permuted(spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, v long"), "v", 1)
    assert Counter(r.v for r in kept.collect()) == Counter(i % 7 for i in range(100))


def test_roles(spark):
    kind = "part string, item long, feats array<string>"
    rows = [("p", i, ["tok:order", "sup:handler"]) for i in range(30)] + [("p", 100 + i, ["tok:view", "sup:page"]) for i in range(30)] + [("q", 1, ["tok:alone"])]
    medoids = roles.induce(spark.createDataFrame(rows, kind))
    got = {r.role: (set(r.feats), r.label) for r in medoids.collect()}
    assert sorted(label for _, label in got.values()) == ["handler+order", "page+view"]
    more = [("p", 1, ["tok:order", "sup:handler", "tok:new"]), ("p", 2, ["tok:view", "sup:page"]), ("p", 3, ["tok:order", "tok:view"]), ("p", 4, ["tok:else"])]
    where = {r.item: (got[r.role][1], r.ambiguous) for r in roles.assign(spark.createDataFrame(more, kind), medoids).collect()}
    assert where[1] == ("handler+order", False) and where[2] == ("page+view", False) and where[3][1] and 4 not in where


def test_agglomeration_takes_the_shortest_description():
    bags = [[f"f{k}" for k in range(12)]] * 2 + [[f"f{k}" for k in range(11)] + ["g"]] + [[f"h{k}" for k in range(12)]]
    parts = roles.agglomerate(bags, np.array([8.0, 8.0, 1.0, 9.0]))
    assert sorted(map(sorted, parts))[-1] == [3] and [0, 1] in [sorted(p)[:2] for p in parts]


def test_directory_cuts(spark):
    rows = [(f"a/x{i}.ts", "ts") for i in range(40)] + [(f"b/y{i}.py", "py") for i in range(40)]
    cuts = roles.directory_cuts(spark.createDataFrame(rows, "path string, g string"), ["g"])
    assert {r.dir for r in cuts.collect()} == {"a", "b"}
    same = roles.directory_cuts(spark.createDataFrame([(p, "ts") for p, _ in rows], "path string, g string"), ["g"])
    assert same.count() == 0


def test_lineage_and_prefixes(spark, tmp_path):
    moves = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "y", 1), ("y", "x", 2)], "old string, new string, ts long")
    paths = spark.createDataFrame([("a",), ("b",), ("q",), ("x",)], "path string")
    out = {r.path: r.current for r in timeline.lineage(moves, paths, str(tmp_path / "l")).collect()}
    assert out["a"] == out["b"] == "c" and out["q"] == "q" and out["x"] in ("x", "y")
    parts = spark.createDataFrame([("s", 1), ("s/t", 2)], "prefix string, part int")
    found = {r.path: r.part for r in matching.longest_prefix(spark.createDataFrame([("s/t/u",), ("s/v",), ("w",)], "path string"), parts).collect()}
    assert found == {"s/t/u": 2, "s/v": 1, "w": None}


def test_change_points(spark):
    rows = [(i, "old") for i in range(40)] + [(40 + i, "new") for i in range(40)]
    out = {r.exp: r for r in timeline.change_point(spark.createDataFrame(rows, "ts long, v string")).collect()}
    assert out["old"].moved and out["old"].at == 40 and out["old"].fading and not out["new"].fading
    mixed = timeline.change_point(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(80)], "ts long, v string")).collect()
    assert not any(r.moved for r in mixed)


def test_value_concordance(spark):
    rows = [("together", f, m) for f in range(40) for m in "abcd" if f % 2 or m == "a"]
    rows += [("always", f, m) for f in range(40) for m in "abc" if not (m == "c" and f == 0)]
    out = {r.container: r for r in matching.value_concordance(spark.createDataFrame(rows, "container string, file long, member string")).collect()}
    assert not out["always"].norm, "members nearly everyone has agree by chance"


def test_placement(spark):
    files = [(f"admin/user_{i}.ts", "admin", "ts", ["user"]) for i in range(5)] + [(f"core/x{i}.ts", "core", "ts", [f"x{i}"]) for i in range(20)]
    kind = "path string, dir string, suffix string, toks array<string>"
    out = retrieval.placement(spark.createDataFrame(files, kind), spark.createDataFrame([("core/user_new.ts", "core", "ts", ["user", "new"]), ("admin/user_z.ts", "admin", "ts", ["user"])], kind)).collect()
    assert [(r.path, r.dir, r.n) for r in out] == [("core/user_new.ts", "admin", 5)]


def test_measures(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(y)) for s, y in zip(rng.integers(0, 20, 200), rng.integers(0, 2, 200))]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    assert abs(E.auc(spark.createDataFrame(rows, "score long, y int")).first().auc - want) < 1e-6
    pairs = [(i % 3, i % 3 if i % 5 else (i + 1) % 3) for i in range(90)]
    r = E.partition_agreement(spark.createDataFrame(pairs, "a int, b int")).first()
    assert 0 < r.nmi < 1 and 0 < r.ari < 1
    same = E.partition_agreement(spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "a int, b int")).first()
    assert (same.nmi, same.ari) == (1.0, 1.0)


def test_vocabulary(spark):
    sizes = spark.createDataFrame([("big", 200), ("s1", 20), ("s2", 15)], "part string, n long")
    assert {r.part: r.into for r in vocabulary.pooled(sizes).collect()} == {"big": "big", "s1": "(rest)", "s2": "(rest)"}
    runs = vocabulary.run_lengths(spark.createDataFrame([(1, i, k) for i, k in enumerate("ffmmfc")], "id long, ord long, kind string"))
    assert runs.first().order == "f>m>f>c"


def plain_life(events, fix="error"):
    out = {}
    by = defaultdict(list)
    for key, ts, order, v in events:
        by[key].append((ts, order, v))
    for key, rows in by.items():
        rows.sort()
        values = [v for _, _, v in rows]
        out[key] = (sum(a != b for a, b in zip(values, values[1:])), values.count(fix), values[-1])
    return out


def test_stream_ends_where_one_pass_ends(spark, tmp_path):
    """State folded over three batches equals one pass over everything, and so do additive counts."""
    from datetime import datetime, timedelta

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(6)
    kind = "key string, ts timestamp, ord long, v string"
    events = [(f"k{rng.integers(0, 5)}", datetime(2024, 1, 1) + timedelta(hours=int(i)), i, str(rng.choice(["a", "b", "error"]))) for i in range(90)]
    for part in range(3):
        spark.createDataFrame(events[30 * part : 30 * part + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = history.lifecycles(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len({s[0] for s in seen}) == 3
    last = {}
    for n, key, _, _, mods, fixes, _, v in sorted(seen):
        last[key] = (mods, fixes, v)
    # the files may come in any order of batches only if their events do; they were written in the order of time
    assert last == plain_life(events)
    counts = stream.select("key", F.lit(1).cast("long").alias("n"))
    history.fold(counts, history.merge_counts(["key"], ["n"]), str(tmp_path / "fold"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.key: r.n for r in history.latest(spark, str(tmp_path / "fold")).collect()} == Counter(e[0] for e in events)


def test_resume():
    older = lambda a, b: a < b
    mode = lambda stored, head: history.resume_mode(stored, head, older, 2)
    assert mode(None, "5") == mode({"version": 1, "head": "5"}, "5") == mode({"version": 2, "head": "9"}, "5") == "full"
    assert mode({"version": 2, "head": "5"}, "5") == "unchanged" and mode({"version": 2, "head": "4"}, "5") == "incremental"
