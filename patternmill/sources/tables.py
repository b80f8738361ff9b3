"""Parquet tables, and the adapters that present them as baskets, scopes, tokens, edges and value events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where everything is on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="patternmill-")
    return f"{shared.rstrip('/')}/patternmill-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read again: what several branches of a plan read is computed once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions of at most some ``rows`` rows each: given to repartition, a task's memory doesn't grow with the input."""
    return max(1, -(-df.count() // rows))


def baskets(spark: SparkSession, sf_dir: str, unit: str = "p_brand") -> DataFrame:
    """(sha, unit): the distinct units of each order."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey", "l_suppkey")  # noqa: E741
    if unit in l.columns:
        return l.select("sha", F.col(unit).cast("string").alias("unit")).distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(unit).alias("unit"))
    return l.join(p, "l_partkey").select("sha", "unit").distinct()


def words(text: F.Column) -> F.Column:
    """The distinct lower-case ASCII words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))


def tokens(spark: SparkSession, sf_dir: str, group: str = "lang") -> DataFrame:
    """(doc_id, grp, tok): distinct lower-case ASCII words of three letters or more."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col(group).alias("grp"), F.explode(words(F.col("text"))).alias("tok"))


def item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card, tok): the words of each benchmark item, by the rule of ``tokens``."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("card"), F.explode(words(F.col("text"))).alias("tok"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, kind, role, dir1, dir2, pid, v): an order's categorical facts, in the place of its customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wide = (o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("o_orderkey").alias("scope"), F.lit("order").alias("kind"), F.col("c_mktsegment").alias("role"), F.col("r_name").alias("dir1"), F.concat_ws("/", "r_name", "n_name").alias("dir2"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(9)).cast("string").alias("price")))
    return wide.unpivot(["scope", "kind", "role", "dir1", "dir2"], ["status", "priority", "price"], "pid", "v")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): lineitems from a supplier's nation to a customer's, without self edges."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")  # noqa: E741
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = (l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey")))
    return joined.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts, ord, v): a user's events as the values of one key over time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("v"))
