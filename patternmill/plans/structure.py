"""Queries over graphs, sets, roles, null models and streams. What SQL can't say is tested against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternmill.functions import text as T
from patternmill.operators import cochange, graphs, matching, nulls, roles, timeline
from patternmill.operators import evaluation as E
from patternmill.sources import tables as S
from patternmill.streaming import history


# graphs: parts point at parts of a lower size in the same order


def _arrows(s: SparkSession, d: str) -> DataFrame:
    """Edges (src, dst, n) from the part kinds that open an order to the kinds that follow at once, when frequent enough."""
    l, p = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), S.table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("unit"))  # noqa: E741
    rows = l.join(p, l.l_partkey == p.p_partkey)
    rows = rows.withColumn("dst", F.lead("unit").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "unit"))).where("dst is not null and unit <> dst")
    total = rows.groupBy(F.col("unit").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return S.saved(total.withColumn("r", rank).where("r = 1").select("src", "dst", "n"))


_ARROWS = """l AS (SELECT l_orderkey, l_linenumber, p_brand || '/' || p_type AS unit FROM lineitem JOIN part ON l_partkey = p_partkey), e AS (SELECT unit AS src, lead(unit) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, unit) AS dst FROM l),
n AS (SELECT src, dst, count(*) AS n FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2), arrows AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM n) WHERE r = 1)"""
_REACH = f"WITH RECURSIVE {_ARROWS}, reach(src, node) AS (SELECT src, dst FROM arrows UNION SELECT r.src, a.dst FROM reach r JOIN arrows a ON r.node = a.src)"
_COMP = f"{_REACH}, nodes AS (SELECT src AS node FROM arrows UNION SELECT dst FROM arrows), comp AS (SELECT n.node, least(n.node, coalesce(min(a.node), n.node)) AS comp FROM nodes n LEFT JOIN reach a ON a.src = n.node AND EXISTS (SELECT 1 FROM reach b WHERE b.src = a.node AND b.node = n.node) GROUP BY n.node)"


def scc(s, d):
    return graphs.strong_components(_arrows(s, d), S.folder(s))


def layers(s, d):
    edges = _arrows(s, d)
    return graphs.layers(edges, graphs.strong_components(edges, S.folder(s)), S.folder(s))


def layers_reach(s, d):
    edges = _arrows(s, d)
    out = graphs.reach(edges, edges.select("src").distinct(), S.folder(s))
    return out.where("hops > 0").groupBy("src").agg(F.count(F.lit(1)).alias("reached"), F.max("hops").alias("far"))


def _dense(s, d):
    return S.edges(s, d)


def feedback_arc_set(s, d):
    edges = _dense(s, d)
    return graphs.feedback_arcs(edges, graphs.strong_components(edges, S.folder(s)))


def fan_in_gini(s, d):
    edges = _arrows(s, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graphs.fan_in_spread(edges, nodes)


def _path():
    return F.regexp_replace("url", "^[a-z]+://|[?#].*$", "")


def deepest_owner(s, d):
    files = S.table(s, d, "pages").select(_path().alias("path")).distinct()
    nodes = files.select(F.explode(T.prefixes(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    return graphs.deepest_owner(files, nodes.select(F.concat(F.lit("n:"), "dir").alias("id"), "dir", "size"))


def majority_projection(s, d):
    l = S.table(s, d, "lineitem")  # noqa: E741
    owner = l.select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("grp"))
    edges = l.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return graphs.majority_projection(edges, owner)


def relation_witness(s, d):
    n = S.table(s, d, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("m"))
    e = S.edges(s, d).join(n.select(F.col("u").alias("src"), F.col("m").alias("a")), "src").join(n.select(F.col("u").alias("dst"), F.col("m").alias("b")), "dst")
    return matching.relation_witness(e)


# sets


def _sets(s, d):
    p = S.table(s, d, "part")
    return p.select(F.col("p_brand").alias("id"), F.col("p_name").alias("item")), p.select((F.col("p_size") % 10).cast("string").alias("id"), F.col("p_name").alias("item"))


_SETS = "a AS (SELECT DISTINCT p_brand AS id, p_name AS item FROM part), b AS (SELECT DISTINCT CAST(p_size % 10 AS VARCHAR) AS id, p_name AS item FROM part), j AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, round(count(*) / ((SELECT count(*) FROM a x WHERE x.id = a.id) + (SELECT count(*) FROM b y WHERE y.id = b.id) - count(*)), 6) AS j FROM a JOIN b USING (item) GROUP BY a.id, b.id)"


def jaccard_pairs(s, d):
    return matching.jaccard_pairs(*_sets(s, d))


def best_jaccard_match(s, d):
    return matching.best_matches(*_sets(s, d))


def fates(s, d):
    p = S.table(s, d, "part")
    old, new = p.where("p_size <= 40"), p.where("p_size > 10")
    return matching.fates(*(x.select(F.col("p_brand").alias("id"), F.col("p_name").alias("item")) for x in (old, new)))


_FATES = """a AS (SELECT DISTINCT p_brand AS id, p_name AS item FROM part WHERE p_size <= 40), b AS (SELECT DISTINCT p_brand AS id, p_name AS item FROM part WHERE p_size > 10),
j AS (SELECT a.id AS a, b.id AS b, round(count(*) / ((SELECT count(*) FROM a x WHERE x.id = a.id) + (SELECT count(*) FROM b y WHERE y.id = b.id) - count(*)), 6) AS j FROM a JOIN b USING (item) GROUP BY a.id, b.id),
f AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS r FROM j) WHERE r = 1 AND j >= 0.5), g AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY j DESC, a) AS r FROM j) WHERE r = 1 AND j >= 0.5),
x AS (SELECT i.id AS a, f.b, (SELECT count(*) FROM f y WHERE y.b = f.b) AS into_, (SELECT count(*) FROM g WHERE g.a = i.id) AS out_ FROM (SELECT DISTINCT id FROM a) i LEFT JOIN f ON f.a = i.id)
SELECT a, b, CASE WHEN out_ > 1 THEN 'split' WHEN b IS NULL THEN 'gone' WHEN into_ > 1 THEN 'merged' WHEN a = b THEN 'kept' ELSE 'renamed' END AS state FROM x"""


def ledger_full_outer(s, d):
    p = S.table(s, d, "part")
    return matching.ledger(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand", "p_name"])


def split_purity(s, d):
    rows = S.table(s, d, "orders").select(F.col("o_orderpriority").alias("parent"), F.year("o_orderdate").alias("part"), F.col("o_orderstatus").alias("v"))
    return matching.split_purity(rows)


def longest_prefix(s, d):
    paths = S.table(s, d, "pages").select(_path().alias("path"))
    known = paths.select(F.explode(T.prefixes(F.col("path"))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return matching.longest_prefix(paths, known.select("prefix", F.col("n").cast("string").alias("part")))


def range_baseline(s, d):
    return matching.range_counts(S.table(s, d, "events").select("ts", F.col("event_type").alias("grp")), "2024-01-16 00:00:00", "2024-01-26 00:00:00")


def value_concordance(s, d):
    l, p = S.table(s, d, "lineitem").select("l_orderkey", "l_partkey"), S.table(s, d, "part").select("p_partkey", "p_type")  # noqa: E741
    o, c = S.table(s, d, "orders").select("o_orderkey", "o_custkey"), S.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    rows = l.join(p, l.l_partkey == p.p_partkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return matching.value_concordance(rows.select(F.col("c_mktsegment").alias("container"), F.col("o_custkey").alias("file"), F.col("p_type").alias("member")))


# roles


def _items(s, d):
    """Parts with the features of their names, by brand."""
    p = S.table(s, d, "part")
    feats = F.concat(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("tok:"), w)), F.array(F.concat(F.lit("sup:"), F.col("p_type"))))
    return p.select(F.col("p_brand").alias("part"), F.col("p_partkey").alias("item"), feats.alias("feats"))


def induce_clusters(s, d):
    return roles.induce(_items(s, d)).select("part", "role", F.array_join("feats", " ").alias("feats"), "weight", "label")


def nearest_medoid(s, d):
    """Every part beside three fixed medoids of its brand: the parts of the brand with the smallest numbers."""
    items = _items(s, d)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("item"))
    medoids = items.withColumn("role", rank - 1).where("role < 3")
    return roles.assign(items, medoids)


_MEDOID = """i AS (SELECT p_brand AS part, p_partkey AS item, list_distinct(list_concat(list_transform(string_split(p_name, ' '), lambda w: 'tok:' || w), ['sup:' || p_type])) AS f FROM part), m AS (SELECT * FROM (SELECT part, f AS mf, row_number() OVER (PARTITION BY part ORDER BY item) - 1 AS role FROM i) WHERE role < 3),
w AS (SELECT i.part, i.item, m.role, mf, f, list_sum(list_transform(list_intersect(f, mf), lambda x: CASE WHEN starts_with(x, 'sup:') THEN 3.0 ELSE 1.0 END)) AS s, list_sum(list_transform(list_distinct(list_concat(f, mf)), lambda x: CASE WHEN starts_with(x, 'sup:') THEN 3.0 ELSE 1.0 END)) AS u FROM i JOIN m USING (part)),
n AS (SELECT *, coalesce(s, 0) / u AS near FROM w), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, item ORDER BY near DESC, role) AS r FROM n) WHERE r = 1),
twin AS (SELECT a.part, a.role AS a, b.role AS b, coalesce(list_sum(list_transform(list_intersect(a.mf, b.mf), lambda x: CASE WHEN starts_with(x, 'sup:') THEN 3.0 ELSE 1.0 END)), 0) / list_sum(list_transform(list_distinct(list_concat(a.mf, b.mf)), lambda x: CASE WHEN starts_with(x, 'sup:') THEN 3.0 ELSE 1.0 END)) AS j FROM m a JOIN m b USING (part)),
sec AS (SELECT n.part, n.item, max(n.near) AS m2 FROM n JOIN best USING (part, item) JOIN twin t ON t.part = n.part AND t.a = n.role AND t.b = best.role WHERE n.role <> best.role AND t.j < 0.6 GROUP BY 1, 2)
SELECT part, item, role, round(near, 6) AS m1, round(coalesce(m2, -1), 6)::DOUBLE AS m2, near < 0.35 OR near - coalesce(m2, -1) < 0.15 AS ambiguous FROM best LEFT JOIN sec USING (part, item) WHERE near > 0"""


def mdl_cuts(s, d):
    files = S.table(s, d, "pages").select(_path().alias("path"), F.regexp_extract("url", "^([a-z]+)", 1).alias("scheme"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"))
    return roles.directory_cuts(files, ["scheme", "lang"])


# null models


def curveball_null(s, d):
    """Certified pairs on the real baskets and on three randomised tables with the same margins."""
    real = S.saved(S.baskets(s, d, "p_type"))
    return nulls.null_counts(real, lambda b, seed: S.saved(nulls.curveball(b, seed)), lambda b: cochange.partners(b).where("certified"))


def random_cuts(s, d):
    units = S.table(s, d, "part").select(F.col("p_partkey").alias("unit"))
    sizes = S.table(s, d, "part").groupBy(F.col("p_type").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return nulls.random_cuts(units, sizes).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ordered histories


def lineage(s, d):
    """Customers' chains of orders as renames: each order's key becomes the key of the next one."""
    o = S.table(s, d, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    moves = o.select(F.col("o_orderkey").alias("old"), nxt.alias("new"), F.col("o_orderdate").alias("ts")).where("new is not null and old % 5 <> 0")
    return timeline.lineage(moves, o.select(F.col("o_orderkey").alias("path")), S.folder(s))


def _writers(s, d):
    return S.table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("v"), (F.col("event_id") % 3).alias("author"))


def author_concentration(s, d):
    return timeline.author_concentration(_writers(s, d), "click")


def repaired_later(s, d):
    return E.repaired_later(S.values(s, d), "click", 365, 5)


def newest_capped(s, d):
    return timeline.newest(S.values(s, d), 500).select("key", "ord", "v")


def ordinals(s, d):
    rows = S.values(s, d)
    return timeline.ordinals(rows, ["key", "v"]).select("key", "ord", "ordinal")


# measures


def _marks(s, d):
    return S.table(s, d, "labels").select("doc_id", "quality", "toxic").join(S.table(s, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


def precision_at_frac(s, d):
    return E.precision_at(_marks(s, d).select(F.col("n_chars").alias("score"), F.col("quality").alias("y"), F.col("doc_id").alias("id")), 0.1)


def residualize(s, d):
    return E.residuals(_marks(s, d).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("x"), F.col("quality").cast("double").alias("y")))


def partial_correlation(s, d):
    l = S.table(s, d, "lineitem")  # noqa: E741
    return E.partial_correlation(l.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z")))


def partition_agreement(s, d):
    return E.partition_agreement(S.table(s, d, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b")))


def matched_control(s, d):
    m = _marks(s, d)
    return E.matched_control(m.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), (F.col("toxic") == 1).alias("marked"), F.col("quality").alias("y")))


# streams


def streaming_lifecycle(s, d):
    """The state of every user after a stream of all events, folded batch by batch in keyed state."""
    out = S.folder(s)
    provider = "spark.sql.streaming.stateStore.providerClass"
    s.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = S.table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.col("event_type").alias("v"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    query = history.lifecycles(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = s.read.parquet(f"{out}/states")
    last = states.groupBy("key").agg(F.max_by(F.struct("first", "last", "mods", "fixes", "churn", "v"), "batch").alias("s"))
    return last.select(F.col("key").cast("long").alias("key"), "s.*")


def streaming_pairs(s, d):
    """Pair support after folding the baskets as a stream."""
    out = S.folder(s)
    S.baskets(s, d, "p_brand").write.parquet(f"{out}/baskets")
    stream = s.readStream.schema("sha long, unit string").parquet(f"{out}/baskets")
    history.fold(stream, history.pair_counts(), f"{out}/pairs", f"{out}/checkpoint").awaitTermination()
    return history.latest(s, f"{out}/pairs").where("sup >= 8").select("a", "b", "sup")


_MARKS = "m AS (SELECT labels.doc_id, quality, toxic, n_chars, lang, source FROM labels JOIN documents USING (doc_id))"
_EVENTS = "e AS (SELECT user_id AS key, ts, event_id AS ord, event_type AS v FROM events)"
_PAGES = "p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)"

QUERIES = {
    "scc": (scc, f"{_COMP} SELECT node, comp FROM comp"),
    "layers": (layers, f"""{_COMP}, dag AS (SELECT DISTINCT a.comp AS a, b.comp AS b FROM arrows JOIN comp a ON src = a.node JOIN comp b ON dst = b.node WHERE a.comp <> b.comp),
walk(a, b, k) AS (SELECT a, b, 1 FROM dag UNION SELECT w.a, d.b, k + 1 FROM walk w JOIN dag d ON d.a = w.b) SELECT node, comp, coalesce((SELECT max(k) FROM walk WHERE walk.a = comp.comp), 0)::INT AS layer FROM comp"""),
    "layers_reach": (layers_reach, f"WITH RECURSIVE {_ARROWS}, r(src, node, hops) AS (SELECT src, dst, 1 FROM arrows UNION SELECT r.src, a.dst, hops + 1 FROM r JOIN arrows a ON r.node = a.src WHERE hops < 200), f AS (SELECT src, node, min(hops) AS hops FROM r WHERE node <> src GROUP BY 1, 2) SELECT src, count(*) AS reached, max(hops)::INT AS far FROM f GROUP BY src"),
    "feedback_arc_set": (feedback_arc_set, None),
    "fan_in_gini": (fan_in_gini, f"WITH {_ARROWS}, nodes AS (SELECT src AS node FROM arrows UNION SELECT dst FROM arrows), g AS (SELECT node, count(DISTINCT src) AS d FROM nodes LEFT JOIN arrows ON dst = node AND src <> dst GROUP BY node), r AS (SELECT d, row_number() OVER (ORDER BY d, node) AS i, count(*) OVER () AS n, sum(d) OVER () AS s FROM g) SELECT any_value(n) AS n, round(2 * sum(i * d) / (any_value(n) * any_value(s)) - (any_value(n) + 1) / any_value(n), 6) AS gini FROM r"),
    "deepest_owner": (deepest_owner, f"WITH {_PAGES}, x AS (SELECT path, string_split(path, '/') AS s FROM p), up AS (SELECT path, array_to_string(list_slice(s, 1, i), '/') AS dir, i < len(s) AS proper FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM x)), nodes AS (SELECT dir, count(*) AS size FROM up WHERE proper GROUP BY dir HAVING count(*) >= 3) SELECT path, 'n:' || dir AS id FROM (SELECT path, dir, row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC, size, dir) AS r FROM up JOIN nodes USING (dir)) WHERE r = 1"),
    "majority_projection": (majority_projection, "WITH t AS (SELECT l_suppkey AS unit, l_returnflag AS grp, count(*) AS m FROM lineitem GROUP BY 1, 2), o AS (SELECT unit, arg_min(grp, (-m, grp)) AS grp FROM t GROUP BY 1), e AS (SELECT l_suppkey AS src, l_partkey % 100 + 1 AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.grp AS a, b.grp AS b, sum(n)::BIGINT AS n FROM e JOIN o a ON src = a.unit JOIN o b ON dst = b.unit WHERE a.grp <> b.grp GROUP BY 1, 2"),
    "relation_witness": (relation_witness, """WITH e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)
SELECT x.n_regionkey AS a, y.n_regionkey AS b, sum(n)::BIGINT AS total, arg_min(src, (-n, src, dst)) AS src, arg_min(dst, (-n, src, dst)) AS dst FROM e JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey GROUP BY 1, 2"""),
    "jaccard_pairs": (jaccard_pairs, f"WITH {_SETS} SELECT * FROM j"),
    "best_jaccard_match": (best_jaccard_match, f"WITH {_SETS} SELECT a, b, j, j >= 0.5 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS r FROM j) WHERE r = 1"),
    "fates": (fates, f"WITH {_FATES}"),
    "ledger_full_outer": (ledger_full_outer, "SELECT p_brand, p_name, CASE WHEN count(*) FILTER (p_partkey % 2 = 0) = 0 THEN 'added' WHEN count(*) FILTER (p_partkey % 2 = 1) = 0 THEN 'dropped' ELSE 'kept' END AS state FROM part GROUP BY 1, 2"),
    "split_purity": (split_purity, "WITH n AS (SELECT o_orderpriority AS parent, year(o_orderdate)::INT AS part, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1, 2, 3), a AS (SELECT parent, part, sum(n)::BIGINT AS n, max(n) AS top FROM n GROUP BY 1, 2), w AS (SELECT parent, sum(m) AS pn, max(m) AS ptop FROM (SELECT parent, v, sum(n) AS m FROM n GROUP BY 1, 2) GROUP BY 1) SELECT parent, part, n, round(top / n, 6) AS purity, round(ptop / pn, 6) AS parent_purity, top / n > ptop / pn AS purer FROM a JOIN w USING (parent)"),
    "longest_prefix": (longest_prefix, "WITH p AS (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), x AS (SELECT path, string_split(path, '/') AS s FROM p), up AS (SELECT path, array_to_string(list_slice(s, 1, i), '/') AS prefix, i < len(s) AS proper FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM x)), k AS (SELECT prefix, count(*) AS n FROM up WHERE proper GROUP BY 1 HAVING count(*) % 2 = 1), b AS (SELECT DISTINCT path, prefix, n FROM up JOIN k USING (prefix)), t AS (SELECT path, arg_max(prefix, length(prefix)) AS prefix, arg_max(n, length(prefix)) AS n FROM b GROUP BY path) SELECT path, prefix, CAST(n AS VARCHAR) AS part FROM (SELECT DISTINCT path FROM p) LEFT JOIN t USING (path)"),
    "range_baseline": (range_baseline, "WITH c AS (SELECT event_type AS grp, count(*) FILTER (ts >= '2024-01-16' AND ts < '2024-01-26') AS now, count(*) FILTER (ts >= '2024-01-06' AND ts < '2024-01-16') AS base FROM events WHERE ts >= '2024-01-06' AND ts < '2024-01-26' GROUP BY 1) SELECT *, round((now + 0.5) / (base + 0.5), 6) AS ratio FROM c"),
    "value_concordance": (value_concordance, None),
    "induce_clusters": (induce_clusters, None),
    "nearest_medoid": (nearest_medoid, f"WITH {_MEDOID}"),
    "mdl_cuts": (mdl_cuts, None),
    "curveball_null": (curveball_null, None),
    "random_cuts": (random_cuts, "SELECT p_type AS part, count(*) AS n FROM part GROUP BY 1"),
    "lineage": (lineage, "WITH RECURSIVE m AS (SELECT * FROM (SELECT o_orderkey AS old, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new FROM orders) WHERE new IS NOT NULL AND old % 5 <> 0), r(path, cur, k) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION ALL SELECT path, new, k + 1 FROM r JOIN m ON cur = old WHERE k < 20) SELECT path, arg_max(cur, k) AS current FROM r GROUP BY path"),
    "author_concentration": (author_concentration, "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v, arg_max(event_id % 3, (ts, event_id)) AS author FROM events GROUP BY 1), n AS (SELECT author, count(*) AS n FROM l WHERE v = 'click' GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS credited FROM n) SELECT author, n, credited, credited >= 5 AND n / credited >= 2 / 3 AS concentrated FROM n, t"),
    "repaired_later": (repaired_later, f"""WITH {_EVENTS}, l AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY ts, ord) AS was FROM e), x AS (SELECT *, EXISTS (SELECT 1 FROM e b WHERE b.key = l.key AND (b.ts, b.ord) > (l.ts, l.ord) AND b.v = 'click') AS back FROM l WHERE was = 'click' AND v <> 'click' AND ts > (SELECT max(ts) FROM e) - INTERVAL 365 DAY AND ts <= (SELECT max(ts) FROM e) - INTERVAL 5 DAY),
c AS (SELECT count(*) AS n, count(*) FILTER (back) AS k FROM x), w AS (SELECT *, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low FROM c) SELECT n AS departures, k AS repaired, round(low, 6) AS low, n >= 35 AND low >= 0.9 AS may_deny FROM w"""),
    "newest_capped": (newest_capped, f"WITH {_EVENTS} SELECT key, ord, v FROM e ORDER BY ts DESC, ord DESC LIMIT 500"),
    "ordinals": (ordinals, f"WITH {_EVENTS} SELECT key, ord, (row_number() OVER (PARTITION BY key, v ORDER BY ts, ord) - 1)::INT AS ordinal FROM e"),
    "precision_at_frac": (precision_at_frac, f"WITH {_MARKS}, r AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n FROM m) SELECT count(*) AS taken, sum(quality)::BIGINT AS hits, round(avg(quality), 6) AS precision FROM r WHERE r <= greatest(floor(n * 0.1), 1)"),
    "residualize": (residualize, f"WITH {_MARKS}, x AS (SELECT doc_id AS id, ln(1 + n_chars) AS lx, quality::DOUBLE AS y FROM m), l AS (SELECT regr_slope(y, lx) AS s, regr_intercept(y, lx) AS b FROM x) SELECT id, round(y - b - s * lx, 6) AS residual FROM x, l"),
    "partial_correlation": (partial_correlation, "WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem) SELECT n, round(xy, 6) AS plain, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c"),
    "partition_agreement": (partition_agreement, """WITH n AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT a, sum(n) AS n FROM n GROUP BY 1), b AS (SELECT b, sum(n) AS n FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
m AS (SELECT sum(n.n / t * log2(n.n * t / (a.n * b.n))) AS mi, sum(n.n * (n.n - 1) / 2) AS ij FROM n JOIN a USING (a) JOIN b USING (b), t), ha AS (SELECT -sum(n / t * log2(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM a, t), hb AS (SELECT -sum(n / t * log2(n / t)) AS h, sum(n * (n - 1) / 2) AS s FROM b, t)
SELECT round(mi / sqrt(ha.h * hb.h), 6) AS nmi, round((ij - ha.s * hb.s / (t * (t - 1) / 2)) / ((ha.s + hb.s) / 2 - ha.s * hb.s / (t * (t - 1) / 2)), 6) AS ari FROM m, ha, hb, t"""),
    "matched_control": (matched_control, f"WITH {_MARKS}, c AS (SELECT floor(log2(1 + n_chars)) AS bin, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, coalesce(sum(quality) FILTER (toxic = 1), 0) AS y1, coalesce(sum(quality) FILTER (toxic = 0), 0) AS y0 FROM m GROUP BY 1), t AS (SELECT sum(n1)::BIGINT AS marked, sum(y1)::BIGINT AS hits, sum(n1 * y0 / n0) AS expected FROM c WHERE n0 > 0 AND n1 > 0) SELECT marked, hits, round(expected, 6) AS expected, round((hits + 0.5) / (expected + 0.5), 6) AS lift FROM t"),
    "streaming_lifecycle": (streaming_lifecycle, None),
    "streaming_pairs": (streaming_pairs, "WITH b AS (SELECT DISTINCT l_orderkey AS sha, p_brand AS unit FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT * FROM b WHERE sha IN (SELECT sha FROM b GROUP BY sha HAVING count(*) BETWEEN 2 AND 30)) SELECT l.unit AS a, r.unit AS b, count(*) AS sup FROM x l JOIN x r ON l.sha = r.sha AND l.unit < r.unit GROUP BY 1, 2 HAVING count(*) >= 8"),
}
