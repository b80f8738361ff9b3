"""Shared plumbing of the corpus operators: scratch tables, hashing, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine gets a temporary one where it names
    none: executors elsewhere would write to disks that nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="patternmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_file(spark: SparkSession, name: str, parts: Iterable[bytes], piece: int = 8 << 20) -> str:
    """Write one file into the shared folder through Spark's file systems; returns its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    for part in parts:
        for at in range(0, len(part), piece):
            out.write(bytearray(part[at : at + piece]))
    out.close()
    return fs.makeQualified(path).toString()


#: Spark refuses tables of more than 100,000 buckets; beyond this number buckets grow instead.
MOST_BUCKETS = 50_000


class Scratch:
    """Tables under the shared folder that cut lineage and survive the loss of an executor.

    ``save`` writes a frame and reads it back; ``drop`` deletes what is no longer needed, with the shuffle
    files of finished jobs, so that the disk holds one generation of intermediate data at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root = spark, name, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[str, DataFrame]] = []

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path, schema = self.path(label), df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, label: str, n: int, key: str, deal: bool = True) -> DataFrame:
        """Write a table dealt into n buckets by key; later groupings by that key read it without a shuffle.

        Without ``deal`` the rows of a key must lie in few partitions already: each partition writes its own files.
        """
        table, n = f"{self.name}_{label}_{uuid.uuid4().hex}", min(n, MOST_BUCKETS)
        ((df.repartition(n, key) if deal else df).write.mode("overwrite").format("parquet").option("compression", "zstd")
         .bucketBy(n, key).saveAsTable(table))
        return self._keep(table)

    def sorted_buckets(self, df: DataFrame, label: str, n: int, keys: list[str], deal: bool = True) -> DataFrame:
        """Write a table in n buckets by its keys, each sorted by them; joins of such tables move no rows.

        Without ``deal`` the rows must lie in their buckets' partitions already, or each task writes to many buckets.
        """
        table, n = f"{self.name}_{label}_{uuid.uuid4().hex}", min(n, MOST_BUCKETS)
        ((df.repartition(n, *keys) if deal else df).write.mode("overwrite").format("parquet").option("compression", "zstd")
         .bucketBy(n, *keys).sortBy(*keys).saveAsTable(table))
        return self._keep(table)

    def _keep(self, table: str) -> DataFrame:
        self.tables.append((table, self.spark.table(table)))
        return self.tables[-1][1]

    def drop(self, *labels: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.path(label))
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of what is done

    def drop_tables(self, keep: list[DataFrame] = ()) -> None:
        stay = [(name, df) for name, df in self.tables if any(df is k for k in keep)]
        for name, df in self.tables:
            if not any(df is k for k in keep):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = stay
        self.drop()


def blocks_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """How many blocks of about ``each`` bytes hold n_bytes; at least one for each core the session has."""
    return max(int(spark.sparkContext.defaultParallelism), -(-int(n_bytes) // each), 1)


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the texts): two sums, the only thing that reaches the driver."""
    n, b = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)))).first()
    return int(n), int(b or 0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))
