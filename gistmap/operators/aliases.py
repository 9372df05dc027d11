"""Alias configuration: which written forms stand for which name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AliasConflict(ValueError):
    """An alias that two names claim, or that is itself a name."""


def alias_rows(groups: DataFrame) -> DataFrame:
    """(source, target, kind) of groups (canonical, aliases), trimmed and in lower case: ``word`` where one word stands for
    one word, else ``term``. Blank aliases, null groups and an alias equal to its own name are left out."""
    norm = lambda c: F.nullif(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))
    rows = groups.select(norm(F.col("canonical")).alias("target"), F.explode("aliases").alias("a")).select(norm(F.col("a")).alias("source"), "target")
    rows = rows.where("source is not null and target is not null and source <> target").distinct()
    one = lambda c: ~F.col(c).contains(" ")
    return rows.withColumn("kind", F.when(one("source") & one("target"), "word").otherwise("term"))


def conflicts(groups: DataFrame) -> DataFrame:
    """(source, rule): aliases claimed by more than one name (``claimed twice``) or that are names (``is a name``)."""
    rows = alias_rows(groups)
    names = groups.select(F.nullif(F.lower(F.regexp_replace(F.trim("canonical"), r"\s+", " ")), F.lit("")).alias("source")).where("source is not null").distinct()
    twice = rows.groupBy("source").agg(F.countDistinct("target").alias("n")).where("n > 1").select("source", F.lit("claimed twice").alias("rule"))
    return twice.unionByName(rows.select("source").distinct().join(names, "source", "left_semi").select("source", F.lit("is a name").alias("rule")))


def checked_aliases(groups: DataFrame) -> DataFrame:
    """The alias rows, or an ``AliasConflict`` that names some of what is wrong."""
    bad = conflicts(groups).orderBy("source", "rule").limit(20).collect()
    if bad:
        raise AliasConflict("; ".join(f"{r.source!r} {r.rule}" for r in bad))
    return alias_rows(groups)
