"""Word-level co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Graph


#: Terms of a chat that are paired with all others in one part.
PART = 256


def pmi(both: Column, a: Column, b: Column, total: Column) -> Column:
    """log2(p(a,b) / (p(a) p(b))); null where any count is zero (minus infinity)."""
    ok = (both > 0) & (a > 0) & (b > 0) & (total > 0)
    return F.when(ok, F.log2((both / total) / ((a / total) * (b / total))))


def pmi_boost(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(p, F.lit(0.0)))


def pairs(keywords: DataFrame, kept: DataFrame) -> DataFrame:
    """(term_a, term_b, cooccurrence), term_a < term_b, of kept terms; rare terms leave before pairs are made.

    A chat of many terms is cut into parts: its terms stand on the left in one part each and on the right in all, so no task
    makes the pairs of a whole large chat.
    """
    k = keywords.select("chat_id", "term").distinct().join(kept.select("term"), "term", "left_semi")
    parts = k.groupBy("chat_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    k = k.join(parts, "chat_id")
    a = k.select("chat_id", F.col("term").alias("term_a"), F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"))
    b = k.select("chat_id", F.col("term").alias("term_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    j = a.join(b, ["chat_id", "part"]).where(F.col("term_a") < F.col("term_b"))
    return j.groupBy("term_a", "term_b").agg(F.count("*").alias("cooccurrence"))


def weighted(keywords: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs with pmi, pmi_boost and weight."""
    total = keywords.agg(F.countDistinct("chat_id").alias("n")).scalar()
    c = kept.select(F.col("term").alias("t"), F.col("chat_count").alias("n"))
    j = pairs(keywords, kept).join(c.select(F.col("t").alias("term_a"), F.col("n").alias("na")), "term_a").join(c.select(F.col("t").alias("term_b"), F.col("n").alias("nb")), "term_b")
    j = j.withColumn("pmi", pmi(F.col("cooccurrence"), F.col("na"), F.col("nb"), total)).withColumn("pmi_boost", pmi_boost(F.col("pmi")))
    return j.withColumn("weight", F.col("cooccurrence") + F.col("pmi_boost")).select("term_a", "term_b", "cooccurrence", "pmi", "pmi_boost", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge once from each end: (node, other, weight, term_a, term_b)."""
    ends = F.array(F.struct(F.col("term_a").alias("node"), F.col("term_b").alias("other")), F.struct(F.col("term_b").alias("node"), F.col("term_a").alias("other")))
    return edges.select("term_a", "term_b", "weight", F.inline(ends))


def top_per_node(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the ``k`` heaviest of at least one of their ends."""
    order = Window.partitionBy("node").orderBy(F.desc(F.round("weight", 9)), "term_a", "term_b")
    keep = both_ways(edges).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("term_a", "term_b").distinct()
    return edges.join(keep, ["term_a", "term_b"], "left_semi")


def neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc(F.round("weight", 9)), "other")
    return both_ways(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("node", "rank", "other")


def cooccurrence_graph(keywords: DataFrame, c: Graph = Graph()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): kept terms with their chats, weighted edges pruned per node."""
    from gistmap.operators.terms import kept_terms

    kept = kept_terms(keywords, c.min_chat_count)
    return kept, top_per_node(weighted(keywords, kept), c.max_edges_per_node)
