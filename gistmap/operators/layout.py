"""Positions, heights and groups on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Layout


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale a column to 0..1 over the whole frame; no spread gives 0. One aggregate row is broadcast."""
    r = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    j = df.join(F.broadcast(r))
    x = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return j.withColumn(out, x).drop("__lo", "__hi")


def weighted_heights(raw: DataFrame, weights: dict[str, float], z_range: float = 50.0) -> DataFrame:
    """Add ``z``: weighted mean of the log-scaled columns, times ``z_range``."""
    df = raw
    for c in weights:
        df = minmax(df.withColumn(f"__{c}", F.log1p(F.col(c))), f"__{c}", f"__s_{c}")
    total = sum(weights.values())
    z: Column = F.lit(0.0)
    for c, w in weights.items():
        z = z + F.lit(w / total) * F.col(f"__s_{c}")
    return df.withColumn("z", z * z_range).select(*raw.columns, "z")


def segment_heights(segments: DataFrame, z_range: float = 50.0) -> DataFrame:
    """(segment_id, z) over all segments, positioned or not."""
    s = segments.select("segment_id", F.log1p("word_count").alias("l"))
    return minmax(s, "l", "s").select("segment_id", (F.col("s") * z_range).alias("z"))


def normalize(positions: DataFrame, coordinate_range: float = 100.0) -> DataFrame:
    """Centre x, y on the middle of their range and scale both alike into +-``coordinate_range``; no extent gives the origin."""
    r = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    j = positions.join(F.broadcast(r))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    at = lambda c: F.when(half > 0, (F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) / half * coordinate_range).otherwise(0.0)
    return j.withColumn("__x", at("x")).withColumn("__y", at("y")).drop("x", "y", "x0", "x1", "y0", "y1").withColumnsRenamed({"__x": "x", "__y": "y"})


def tangent_pull(positions: DataFrame, alpha: float = Layout().alpha) -> DataFrame:
    """Move tangent segments (chat_id, label, x, y) towards the mean of their chat's core segments."""
    chat = Window.partitionBy("chat_id")
    core = lambda c: F.avg(F.when(F.col("label") == "core", F.col(c))).over(chat)
    p = positions.withColumn("__cx", core("x")).withColumn("__cy", core("y"))
    pull = (F.col("label") == "tangent") & F.col("__cx").isNotNull() & F.lit(alpha > 0)
    move = lambda c: F.when(pull, (1 - alpha) * F.col(c) + alpha * F.col(f"__c{c}")).otherwise(F.col(c))
    return p.withColumn("__x", move("x")).withColumn("__y", move("y")).drop("x", "y", "__cx", "__cy").withColumnsRenamed({"__x": "x", "__y": "y"})


def centroids(members: DataFrame, group: str) -> DataFrame:
    """Mean position and height of every group with a positioned member."""
    return members.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("segment_count"))


def dedupe(labels: DataFrame, by: str, order: list, suffix: str) -> DataFrame:
    """Make the values of ``by`` unique: the k-th holder gets ``suffix`` formatted with k; a suffixed value that
    meets one that is there by nature takes the next free number (checked by an equi-join, repeated until none meets)."""
    w = Window.partitionBy(by).orderBy(*order)
    name = lambda k: F.when(k == 1, F.col(by)).otherwise(F.concat(F.col(by), F.lit(suffix.split("{}")[0]), k.cast("string"), F.lit(suffix.split("{}")[1])))
    out = labels.withColumn("__k", F.row_number().over(w))
    natural = labels.select(F.col(by).alias("__n")).distinct()
    for _ in range(8):
        out = out.withColumn("unique", name(F.col("__k")))
        clash = out.where("__k > 1").join(natural, F.col("unique") == F.col("__n"), "left_semi")
        if clash.isEmpty():
            break
        hit = clash.select(*[F.col(c) for c in labels.columns], F.lit(True).alias("__hit"))
        out = out.drop("unique").join(hit, labels.columns, "left").withColumn("__k", F.when(F.col("__hit"), F.col("__k") + 1).otherwise(F.col("__k"))).drop("__hit")
    return out.withColumn("unique", name(F.col("__k"))).drop("__k")
