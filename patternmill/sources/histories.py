"""Readers of repositories and their logs as tables: file trees, texts, commit logs, manifests, JSON lines.

All reading is done by Spark's own sources, so a path may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.functions import text as T

#: Folders that hold no work of the people who keep the tree.
EXCLUDED = r"(^|/)(\.git|node_modules|vendor|dist|build|target|\.venv|__pycache__)(/|$)"
EVENT = "array<struct<st:string,path:string,old:string>>"


def tree(spark: SparkSession, root: str, excluded: str = EXCLUDED, content: bool = False, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, modified[, content]) of every file below ``root``; paths are relative. Contents only of files up to ``most_bytes``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    whole = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.expr("substring(_whole, instr(_whole, _base) + length(_base) + 1)")
    rows = files.withColumn("_whole", whole).withColumn("_base", base).withColumn("path", rel)
    rows = rows.where(~F.col("path").rlike(excluded)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if content:
        rows = rows.withColumn("content", F.when(F.col("size") <= most_bytes, F.decode("content", "UTF-8")))
    return rows


def commit_log(spark: SparkSession, path: str, record: str = "\x1e") -> DataFrame:
    """Commits from the text of ``git log --name-status --format='%x1e%H%x09%at%x09%ae%x09%s'``.

    (sha, ts, author, msg, fix, events: the files with their states, and for renames the old name; files, added.)
    """
    raw = spark.read.option("lineSep", record).text(path).where(F.length(F.trim("value")) > 0)
    lines = F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0)
    head = F.split(F.element_at("lines", 1), "\t", 4)
    rows = raw.select(lines.alias("lines")).withColumn("h", head)

    def event(line):
        part = F.split(line, "\t")
        st = F.substring(part[0], 1, 1)
        moved = st.isin("R", "C")
        return F.struct(st.alias("st"), F.when(moved, F.get(part, 2)).otherwise(F.get(part, 1)).alias("path"), F.when(moved, F.get(part, 1)).alias("old"))

    events = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), event).cast(EVENT)
    rows = rows.select(F.col("h")[0].alias("sha"), F.col("h")[1].cast("long").alias("ts"), F.col("h")[2].alias("author"), F.get("h", 3).alias("msg"), events.alias("events"))
    live = F.filter("events", lambda e: e["st"] != "D")
    return rows.withColumns({"fix": T.is_fix(F.col("msg")), "files": F.array_distinct(F.transform("events", lambda e: e["path"])), "added": F.transform(F.filter(live, lambda e: e["st"] == "A"), lambda e: e["path"])})


def footprints(commits: DataFrame, most: int = 30) -> DataFrame:
    """(sha, ts, unit): one row per file of each commit of 1 to ``most`` files."""
    return commits.where(F.size("files").between(1, most)).select("sha", "ts", F.explode("files").alias("unit"))


def renames(commits: DataFrame) -> DataFrame:
    """(old, new, ts) of every rename."""
    return commits.select("ts", F.explode(F.filter("events", lambda e: e["st"] == "R")).alias("e")).select(F.col("e.old").alias("old"), F.col("e.path").alias("new"), "ts")


def package_manifest(texts: DataFrame) -> DataFrame:
    """texts (path, content) of ``package.json`` files -> (path, section, name, version) of their dependencies."""
    found = texts.where(F.col("path").rlike(r"(^|/)package\.json$"))
    parts = [found.select("path", F.lit(s).alias("section"), F.explode(F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>")).alias("name", "version")) for s in ("dependencies", "devDependencies", "peerDependencies")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def key_paths(texts: DataFrame, at: str = "$.scripts") -> DataFrame:
    """texts (path, content) of JSON files -> (path, container, key): the keys of the object at ``at``."""
    keys = F.json_object_keys(F.get_json_object("content", at))
    return texts.select("path", F.lit(at).alias("container"), F.explode(keys).alias("key"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Facts kept as JSON lines, by a given schema; lines that don't fit come back as nulls in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Export as JSON lines, null fields left out; overwritten whole."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_decision(spark: SparkSession, path: str, **fields: str) -> None:
    """Add one decision (a waiver, a steer, a boundary) to a folder of JSON lines."""
    spark.createDataFrame([fields]).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
