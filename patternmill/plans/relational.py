"""Queries over module graphs and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from patternmill.operators import evaluation as E
from patternmill.operators import modules as M
from patternmill.sources import tables as S


def _nations(s, d):
    n, r = S.table(s, d, "nation"), S.table(s, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("unit"), F.col("r_name").alias("module"))


def _types(s, d):
    """(src, target): suppliers and the part types they deliver."""
    l, p = S.table(s, d, "lineitem").select("l_partkey", "l_suppkey"), S.table(s, d, "part").select("p_partkey", "p_brand")  # noqa: E741
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("src"), F.col("p_brand").alias("target")).distinct()


def _suppliers(s, d):
    n = _nations(s, d).withColumnRenamed("unit", "s_nationkey")
    return S.table(s, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("unit"), "module")


def _marks(s, d):
    y = S.table(s, d, "labels").select("doc_id", "quality", "toxic")
    return y.join(S.table(s, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


_MEM = "mem AS (SELECT n_nationkey AS unit, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"
_EDGES = """edges AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
_GRAPH = f"WITH {_MEM}, {_EDGES}, graph AS (SELECT a.module AS a, b.module AS b, sum(n)::BIGINT AS n, count(*) AS pairs FROM edges JOIN mem a ON src = a.unit JOIN mem b ON dst = b.unit GROUP BY 1, 2)"
_NORMS = f"""WITH {_MEM}, sup AS (SELECT s_suppkey AS unit, module FROM supplier JOIN mem ON s_nationkey = mem.unit),
reach AS (SELECT DISTINCT l_suppkey AS src, p_brand AS target FROM lineitem JOIN part ON l_partkey = p_partkey),
cap AS (SELECT DISTINCT unit, module FROM reach JOIN sup ON src = unit), tgt AS (SELECT target, count(*) AS all_k FROM reach GROUP BY 1 HAVING count(*) >= 5),
sz AS (SELECT module, count(*) AS na FROM cap GROUP BY 1), hits AS (SELECT module, target, count(*) AS ka FROM reach JOIN sup ON src = unit GROUP BY 1, 2),
x AS (SELECT sz.module, tgt.target, coalesce(ka, 0) AS ka, na, all_k - coalesce(ka, 0) AS ko, (SELECT count(*) FROM cap) - na AS no
      FROM sz CROSS JOIN tgt LEFT JOIN hits ON hits.module = sz.module AND hits.target = tgt.target),
w AS (SELECT *, ceil(log2(greatest(count(*) OVER (), 2))) AS idx FROM x WHERE no >= 5), v AS (SELECT *, CASE WHEN ka > na - ka THEN 'true' ELSE 'false' END AS expected, greatest(ka, na - ka) AS ne FROM w WHERE na >= 5),
z AS (SELECT *, ka * log2(((ka + 0.5) / (na + 1.0)) / ((ko + 0.5) / (no + 1.0))) + (na - ka) * log2((1 - (ka + 0.5) / (na + 1.0)) / (1 - (ko + 0.5) / (no + 1.0))) - 0.5 * log2(greatest(na, 2)) - idx AS bits FROM v)
SELECT module, target, ka, na, ko, no, round(bits, 6) AS bits, expected, bits > 0 AND (ne + 0.5) / (na + 1.0) >= 0.875 AND CASE WHEN expected = 'true' THEN ka * no > ko * na ELSE ka * no < ko * na END AS certified FROM z"""
_MARKS = "m AS (SELECT labels.doc_id, quality, toxic, n_chars, lang, source FROM labels JOIN documents USING (doc_id))"
_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"

QUERIES = {
    "edge_dedupe": (lambda s, d: S.edges(s, d), f"WITH {_EDGES} SELECT * FROM edges"),
    "module_graph": (lambda s, d: M.module_graph(S.edges(s, d), _nations(s, d)), _GRAPH + " SELECT * FROM graph"),
    "partition_score": (lambda s, d: M.partition_score(S.edges(s, d), _nations(s, d)), _GRAPH + ", t AS (SELECT sum(CASE WHEN a = b THEN n ELSE 0 END)::BIGINT AS inside, sum(n)::BIGINT AS total FROM graph) SELECT inside, total, round(inside / total, 6) AS share FROM t"),
    "arch_norms": (lambda s, d: M.norms(_types(s, d), _suppliers(s, d)), _NORMS),
    "auc_ties": (lambda s, d: E.auc(_marks(s, d).select(F.col("n_chars").alias("score"), F.col("quality").alias("y"))),
                 f"WITH {_MARKS}, r AS (SELECT quality, {_RANK.format(c='n_chars')} AS r FROM m), t AS (SELECT sum(quality)::BIGINT AS positives, sum(1 - quality)::BIGINT AS negatives, sum(r) FILTER (quality = 1) AS s FROM r) SELECT positives, negatives, round((s - positives * (positives + 1) / 2) / (positives * negatives), 6) AS auc FROM t"),
    "partition_metrics": (lambda s, d: E.partition_metrics(S.table(s, d, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b"))),
                          """WITH n AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM n),
h AS (SELECT sum(-n / total * log2(n / na)) AS x, sum(-n / total * log2(n / nb)) AS y, sum(n / total * log2(n * total / (na * nb))) AS mutual, any_value(total) AS total FROM c), p AS (SELECT sum(top) AS top FROM (SELECT max(n) AS top FROM c GROUP BY a))
SELECT round(x, 6) AS b_given_a, round(y, 6) AS a_given_b, round(x + y, 6) AS vi, round(mutual, 6) AS mutual, round(top / total, 6) AS purity FROM h, p"""),
    "odds_ratio": (lambda s, d: E.odds_ratio(_marks(s, d).select((F.col("toxic") == 1).alias("x"), (F.col("quality") == 1).alias("y"))),
                   f"WITH {_MARKS}, c AS (SELECT sum(toxic * quality)::BIGINT AS tt, sum(toxic * (1 - quality))::BIGINT AS tf, sum((1 - toxic) * quality)::BIGINT AS ft, sum((1 - toxic) * (1 - quality))::BIGINT AS ff FROM m) SELECT *, round((tt + 0.5) * (ff + 0.5) / ((tf + 0.5) * (ft + 0.5)), 6) AS ratio FROM c"),
    "spearman": (lambda s, d: E.spearman(S.table(s, d, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))),
                 f"WITH r AS (SELECT {_RANK.format(c='p_size')} AS rx, {_RANK.format(c='p_retailprice')} AS ry FROM part) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r"),
    "excess_bits": (lambda s, d: E.excess_bits(S.table(s, d, "documents").select(F.col("source").alias("grp"), F.col("n_chars").alias("x"))),
                    """WITH c AS (SELECT source AS grp, floor(log2(1 + n_chars))::BIGINT AS bin, count(*) AS k FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(k) OVER (PARTITION BY grp) AS n, sum(k) OVER (PARTITION BY bin) AS ak, sum(k) OVER () AS an FROM c),
b AS (SELECT grp, bin, k, n::BIGINT AS n, (k + 0.5) / (n + 1.0) AS own, (ak - k + 0.5) / (an - n + 1.0) AS base FROM t WHERE n >= 5)
SELECT grp, bin, k, n, round(k * log2(own / base) + (n - k) * log2((1 - own) / (1 - base)) - 0.5 * log2(greatest(n, 2)), 6) AS bits FROM b"""),
    "calibration_wilson": (lambda s, d: E.calibration(S.table(s, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_returnflag") == "R").alias("hit"))),
                           """WITH c AS (SELECT l_suppkey AS grp, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY 1)
SELECT *, round((hits / total + 3.8416 / (2 * total) - 1.96 * sqrt(hits / total * (1 - hits / total) / total + 3.8416 / (4 * total * total))) / (1 + 3.8416 / total), 6) AS low FROM c"""),
    "prf_f1": (lambda s, d: E.precision_recall(_brand(s, d, "l_returnflag = 'R'"), _brand(s, d, "l_quantity > 40")),
               """WITH b AS (SELECT l_suppkey AS q, p_brand AS item, l_returnflag, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT DISTINCT q, item FROM b WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT q, item FROM b WHERE l_quantity > 40),
c AS (SELECT coalesce(f.q, t.q) AS q, count(f.q) AS nf, count(t.q) AS nt, count(*) FILTER (f.q IS NOT NULL AND t.q IS NOT NULL) AS hit FROM f FULL JOIN t ON f.q = t.q AND f.item = t.item GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN nf > 0 THEN hit / nf ELSE 0 END), 6) AS precision, round(avg(CASE WHEN nt > 0 THEN hit / nt ELSE 0 END), 6) AS recall, round(avg(2 * hit / (nf + nt)), 6) AS f1 FROM c"""),
}


def _brand(s, d, condition):
    l, p = S.table(s, d, "lineitem").where(condition).select("l_partkey", F.col("l_suppkey").alias("q")), S.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("item"))  # noqa: E741
    return l.join(p, l.l_partkey == p.p_partkey).select("q", "item").distinct()
