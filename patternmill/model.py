"""What a body of records does, learned once and asked often: the command surface as functions over tables.

``learn`` writes the tables of a model into a folder that Spark reads; ``Model`` reads them. Every answer is a
DataFrame with a total order in its rank columns where it has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.operators import bridge, cochange, facts, graphs, matching, obligations, retrieval


def learn(folder: str, scopes: DataFrame, touches: DataFrame, messages: DataFrame, cards: DataFrame, edges: DataFrame | None = None, dir_min: int = 25) -> Model:
    """Build all tables of a model.

    scopes as in ``facts``; touches (sha, ts, unit, cls); messages (sha, ts, tok); cards (card, tok, w); edges
    (src, dst, n). Each table is written before the next one is computed from it.
    """
    spark = scopes.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ctx = save(facts.contexts(scopes, dir_min), "contexts")
    counts = save(facts.cube(ctx), "cells")
    scored = save(facts.scored(counts), "scored")
    spoken = save(facts.spoken(scored), "facts")
    save(facts.deviations(ctx, counts, spoken), "deviations")
    touches = save(touches, "touches")
    save(cochange.partners(touches.select("sha", "unit").distinct()), "partners")
    save(obligations.birth_obligations(touches, obligations.first_touches(touches)), "obligations")
    messages = save(messages, "messages")
    save(cards, "cards")
    said = messages.join(touches.select("sha", F.col("cls").alias("grp")), "sha").select(F.col("sha").alias("doc_id"), "grp", "tok").distinct()
    save(bridge.language_bridge(said), "bridge")
    if edges is not None:
        edges = save(edges, "edges")
        comp = save(graphs.strong_components(edges, f"{folder}/_scc"), "components")
        save(graphs.layers(edges, comp, f"{folder}/_layers"), "layers")
        save(graphs.feedback_arcs(edges, comp), "cuts")
    return Model(spark, folder)


class Model:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def check(self, scopes: list | None = None, waivers: DataFrame | None = None) -> DataFrame:
        """Deviations, of all scopes or of some; those with a waiver (scope, pid) say so and stay in the list."""
        found = self.table("deviations")
        if scopes is not None:
            found = found.where(F.col("scope").isin(scopes))
        if waivers is None:
            return found.withColumn("waived", F.lit(False))
        w = waivers.select("scope", "pid").distinct().withColumn("waived", F.lit(True))
        return found.join(w, ["scope", "pid"], "left").withColumn("waived", F.coalesce("waived", F.lit(False)))

    def grouped(self) -> DataFrame:
        """Deviations by fact and observed value, the commonest first."""
        d = self.table("deviations")
        return d.groupBy("cid", "pid", "expected", "v").agg(F.count(F.lit(1)).alias("n"), F.min("scope").alias("example")).orderBy(F.desc("n"), "cid", "pid", "v")

    def rules(self) -> DataFrame:
        """The facts that are spoken, strongest first."""
        return self.table("facts").select("cid", "kind", "pid", "expected", "shown", "sraw", "bits").orderBy(F.desc("bits"), "cid", "pid")

    def explain(self, pid: str) -> DataFrame:
        """Every cell of a property with the test that it fails, if any."""
        why = F.when(F.col("accepted"), "accepted").when(F.col("bits") <= 0, "saves no bits").when(~F.col("clears"), "rate below the loss bound").when(~F.col("shows"), "too little old evidence").when(~F.col("holds"), "absence without a contrast").otherwise("fallback value")
        return self.table("scored").where(F.col("pid") == pid).select("cid", "expected", "n", "neff", "bits", why.alias("verdict"))

    def where(self, words: DataFrame, top: int = 5) -> DataFrame:
        return retrieval.rank_cards(self.table("cards"), words, top=top)

    def how(self, words: DataFrame, top: int = 5) -> DataFrame:
        return retrieval.rank_changes(self.table("messages"), words, top=top)

    def places(self, words: DataFrame, top: int = 10) -> DataFrame:
        """Where changes that speak of the words went."""
        files = self.table("touches").select("sha", F.col("unit").alias("path"))
        return retrieval.places(self.how(words), files, files.select("path"), top)

    def what(self, words: DataFrame) -> DataFrame:
        """For each word: how many cards have it, how many changes say it, and what it stands for if no card has it."""
        cards = self.table("cards").groupBy("tok").agg(F.countDistinct("card").alias("cards"))
        said = self.table("messages").groupBy("tok").agg(F.countDistinct("sha").alias("changes"))
        stands = self.table("bridge").groupBy("tok").agg(F.sort_array(F.collect_list("grp")).alias("stands_for"))  # six at most
        return words.select("q", "tok").distinct().join(cards, "tok", "left").join(said, "tok", "left").join(stands, "tok", "left").fillna(0, ["cards", "changes"])

    def cochange(self, unit: str | None = None) -> DataFrame:
        p = self.table("partners")
        return (p if unit is None else p.where(F.col("a") == unit)).orderBy(F.desc("certified"), F.desc("bits"), "a", "b")

    def missing(self, changed: DataFrame) -> DataFrame:
        """changed (unit): certified partners and obligations of what changed that didn't change: (unit, partner, why)."""
        pairs = self.table("partners").where("certified").select(F.col("a").alias("unit"), F.col("b").alias("partner")).join(changed, "unit").withColumn("why", F.lit("changes with"))
        cls = self.table("touches").select("unit", "cls").distinct().join(changed, "unit")
        born = self.table("obligations").where("rule").select("cls", F.col("unit").alias("partner")).join(cls, "cls").select("unit", "partner").withColumn("why", F.lit("comes with"))
        return pairs.unionByName(born).distinct().join(changed.select(F.col("unit").alias("partner")), "partner", "left_anti")

    def obligation(self, cls: str) -> DataFrame:
        return self.table("obligations").where(F.col("cls") == cls).orderBy(F.desc("rule"), F.desc("bits"), "unit")

    def map(self) -> DataFrame:
        """Layers of the graph with their sizes and the edges that would have to go."""
        cuts = self.table("cuts").groupBy("comp").agg(F.count(F.lit(1)).alias("cuts"))
        return self.table("layers").join(cuts, "comp", "left").groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.coalesce("cuts", F.lit(0))).alias("cuts")).orderBy(F.desc("layer"))

    def status(self) -> DataFrame:
        """Rows of each table."""
        out = None
        for name in ("contexts", "cells", "scored", "facts", "deviations", "touches", "partners", "obligations", "messages", "cards", "bridge"):
            one = self.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def compare(self, other: Model) -> DataFrame:
        """Facts that another state of the model keeps, drops or adds."""
        return matching.ledger(self.table("facts"), other.table("facts"), ["cid", "kind", "pid", "expected"])

    def export(self, path: str) -> None:
        """All spoken facts as JSON lines."""
        self.rules().write.mode("overwrite").json(path)
