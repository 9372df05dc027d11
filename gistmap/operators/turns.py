"""Conversations, turns, segments and keywords as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.runtime import table


def turns(conversations: DataFrame) -> DataFrame:
    """(chat_id, turn_index, role, text): the last export of a chat counts; chats without id are skipped."""
    last = conversations.where(F.col("chat_id").isNotNull()).groupBy("chat_id").agg(F.max_by("turns", "export_id").alias("turns"))
    return last.select("chat_id", F.inline("turns")).select("chat_id", "turn_index", "role", "text")


def segments(raw: DataFrame) -> DataFrame:
    return raw.distinct()


def segment_terms(raw: DataFrame) -> DataFrame:
    """(segment_id, chat_id, label, pos, term, score, entity_label); repeated rows of a segment count once, blank terms not."""
    one = raw.groupBy("segment_id").agg(F.min(F.struct("chat_id", "label", "keywords")).alias("r")).select("segment_id", "r.*")
    flat = one.select("segment_id", "chat_id", "label", F.posexplode("keywords").alias("pos", "k"))
    return flat.select("segment_id", "chat_id", "label", "pos", F.lower(F.trim("k.term")).alias("term"), "k.score", "k.entity_label").where("term <> ''")


def vectors(raw: DataFrame) -> DataFrame:
    """(segment_id, v): unit vectors in double precision; null and zero vectors are left out."""
    one = raw.where(F.size("embedding") > 0).groupBy("segment_id").agg(F.min("embedding").alias("e"))
    sq = F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    one = one.withColumn("n", F.sqrt(sq)).where("n > 0")
    return one.select("segment_id", F.transform("e", lambda x: F.try_divide(x.cast("double"), F.col("n"))).alias("v"))


def load(spark, d: str) -> dict[str, DataFrame]:
    return {
        "turns": turns(table(spark, d, "conversations")),
        "segments": segments(table(spark, d, "segments")),
        "terms": segment_terms(table(spark, d, "segment_keywords")),
        "map": table(spark, d, "map_segments").distinct(),
    }


# The same tables for DuckDB, as common table expressions.
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQL = f"""
last AS (SELECT chat_id, arg_max(turns, export_id) AS turns FROM conversations WHERE chat_id IS NOT NULL GROUP BY chat_id),
turns AS (SELECT chat_id, t.turn_index AS turn_index, t.role AS role, t.text AS text, len(list_filter(regexp_split_to_array(coalesce(t.text, ''), '{WS}'), lambda x: x <> '')) AS words FROM last, unnest(turns) AS u(t)),
segs AS (SELECT DISTINCT * FROM segments),
kw AS (SELECT segment_id, min(struct_pack(chat_id := chat_id, label := label, keywords := keywords)) AS r FROM segment_keywords GROUP BY segment_id),
kx AS (SELECT segment_id, r.chat_id AS chat_id, r.label AS label, unnest(range(len(r.keywords))) AS pos, unnest(r.keywords) AS k FROM kw),
terms AS (SELECT segment_id, chat_id, label, pos, lower(trim(k.term, ' ')) AS term, k.score AS score, k.entity_label AS entity_label FROM kx WHERE lower(trim(k.term, ' ')) <> ''),
maps AS (SELECT DISTINCT * FROM map_segments)
"""
