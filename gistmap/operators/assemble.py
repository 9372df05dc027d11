"""The published tables of a map, their constraints, and the viewer's drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.functions.text import slugify
from gistmap.operators.layout import dedupe


def slugs(labels: DataFrame) -> DataFrame:
    """(label, id): unique slugs of distinct labels, in the order of the labels."""
    one = labels.select("label").distinct().withColumn("slug", slugify(F.col("label")))
    return dedupe(one, "slug", ["label"], "-{}").select("label", F.col("unique").alias("id"))


def v3_tables(segments: DataFrame, tops: DataFrame, platforms: DataFrame, placed: DataFrame) -> dict[str, DataFrame]:
    """segments, conversation_concepts and macro_domains of the payload.

    ``placed``: segment_id, x, y, z, concept, domain of segments with a position; others are left out.
    A concept's domain is the one most of its segments have (ties: first by segment id).
    """
    from gistmap.operators.vectors import majority

    concept_ids = slugs(placed.where("concept is not null").select(F.col("concept").alias("label")))
    domain_ids = slugs(placed.where("domain is not null").select(F.col("domain").alias("label")))
    cid = concept_ids.select(F.col("label").alias("concept"), F.col("id").alias("concept_id"))
    did = domain_ids.select(F.col("label").alias("domain"), F.col("id").alias("domain_id"))
    rows = segments.join(placed, "segment_id").join(tops, "segment_id", "left").join(platforms, "chat_id", "left").join(cid, "concept", "left").join(did, "domain", "left")
    segs = rows.select(
        F.col("segment_id").alias("id"), F.coalesce("top", F.lit("")).alias("label"), "chat_id", F.coalesce("platform", F.lit("unknown")).alias("platform"), "x", "y", "z",
        "word_count", (F.col("label") == "tangent").alias("is_tangent"), F.col("concept_id").alias("conversation_concept_id"), F.col("domain_id").alias("macro_domain_id"),
    )
    vote = majority(placed.where("concept is not null and domain is not null").select("concept", "domain", "segment_id")).join(did, "domain", "left").select("concept", F.col("domain_id").alias("macro_domain_id"))
    mean = [F.avg(c).alias(c) for c in ("x", "y", "z")]
    concepts = placed.where("concept is not null").groupBy("concept").agg(*mean, F.count("*").alias("segment_count"))
    concepts = concepts.join(cid, "concept").join(vote, "concept", "left").select(F.col("concept_id").alias("id"), F.col("concept").alias("label"), "x", "y", "z", "segment_count", "macro_domain_id")
    domains = placed.where("domain is not null").groupBy("domain").agg(*mean, F.count("*").alias("segment_count"))
    domains = domains.join(did, "domain").select(F.col("domain_id").alias("id"), F.col("domain").alias("label"), "x", "y", "z", "segment_count")
    return {"segments": segs, "conversation_concepts": concepts, "macro_domains": domains}


def _repeated(df: DataFrame, table: str) -> DataFrame:
    return df.groupBy("id").count().where("count > 1").select(F.lit(table).alias("table"), F.lit("duplicate id").alias("rule"), F.col("id").alias("at"))


def _null(df: DataFrame, table: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNull()).select(F.lit(table).alias("table"), F.lit(f"null {column}").alias("rule"), F.col("id").alias("at"))


def _dangling(df: DataFrame, table: str, column: str, parent: DataFrame) -> DataFrame:
    keys = parent.select(F.col("id").alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti").select(F.lit(table).alias("table"), F.lit(f"unknown {column}").alias("rule"), F.col("id").alias("at"))


def v3_violations(segments: DataFrame, concepts: DataFrame, domains: DataFrame) -> DataFrame:
    """(table, rule, at): one row per broken constraint. A segment's domain may be null; its concept and a
    concept's domain may not where the parent table has rows. Labels of concepts and domains are not empty."""
    out = [_repeated(t, n) for n, t in (("segments", segments), ("conversation_concepts", concepts), ("macro_domains", domains))]
    out += [_dangling(segments, "segments", "conversation_concept_id", concepts), _dangling(segments, "segments", "macro_domain_id", domains), _dangling(concepts, "conversation_concepts", "macro_domain_id", domains)]
    some = lambda p: p.limit(1).select(F.lit(1).alias("__one"))
    out.append(_null(segments, "segments", "conversation_concept_id").withColumn("__one", F.lit(1)).join(some(concepts), "__one", "left_semi").drop("__one"))
    out.append(_null(concepts, "conversation_concepts", "macro_domain_id").withColumn("__one", F.lit(1)).join(some(domains), "__one", "left_semi").drop("__one"))
    for n, t in (("conversation_concepts", concepts), ("macro_domains", domains)):
        out.append(t.where("coalesce(label, '') = ''").select(F.lit(n).alias("table"), F.lit("empty label").alias("rule"), F.col("id").alias("at")))
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    return result


def v2_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, rule, at): repeated node ids, edges with an unknown end, edges from a node to itself."""
    known = nodes.select("id").distinct()
    out = _repeated(nodes, "nodes")
    for c in ("source", "target"):
        k = known.select(F.col("id").alias(c))
        out = out.unionByName(edges.join(k, c, "left_anti").select(F.lit("edges").alias("table"), F.lit(f"unknown {c}").alias("rule"), F.concat_ws("|", "source", "target").alias("at")))
    return out.unionByName(edges.where("source = target").select(F.lit("edges").alias("table"), F.lit("loop").alias("rule"), F.col("source").alias("at")))


def payload(tables: dict[str, DataFrame], version: int = 3) -> DataFrame:
    """(section, json): each row of every table as JSON, to be written as one document per section."""
    out = None
    for name, t in sorted(tables.items()):
        rows = t.select(F.lit(name).alias("section"), F.to_json(F.struct(*t.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("version", F.lit(version))
