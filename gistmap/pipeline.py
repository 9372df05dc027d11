"""From export files to the published tables: named stages that read and write artefacts of one folder.

A stage declares what it needs, what it can do without and what it writes. Needed artefacts that are not there raise
``MissingStage`` with the name of the stage that makes them; those it can do without come as null. Every
artefact is a Parquet table; the published sections are written as JSON besides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmap.config import Concepts, Density, Domains
from gistmap.functions import text as X
from gistmap.operators import assemble, layout, sources
from gistmap.operators import segmentation as S
from gistmap.operators import terms as K
from gistmap.operators import vectors as V
from gistmap.operators.embedding import embed_texts


class MissingStage(RuntimeError):
    """An artefact is needed that no stage has written yet."""


class Store:
    """The artefacts of one run, by name, below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, kind: str = "parquet") -> str:
        return f"{self.root}/{name}.{kind}"

    def write(self, name: str, df: DataFrame, kind: str = "parquet", mode: str = "overwrite") -> DataFrame:
        """Write an artefact and read it back."""
        df.write.mode(mode).format(kind).save(self.path(name, kind))
        return self.read(name, kind)

    def optional(self, name: str, kind: str = "parquet") -> DataFrame | None:
        """The artefact, or null if it was never written."""
        try:
            return self.spark.read.format(kind).load(self.path(name, kind))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def read(self, name: str, kind: str = "parquet") -> DataFrame:
        df = self.optional(name, kind)
        if df is None:
            raise MissingStage(f"{self.path(name, kind)} is not there; {needed_from(name)}")
        return df


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., dict[str, DataFrame]]
    needs: tuple[str, ...] = ()
    may_use: tuple[str, ...] = ()
    writes: tuple[str, ...] = field(default=())


def ingest(store: Store, exports: str, pattern: str = "*.json", platform: str = "unknown") -> dict[str, DataFrame]:
    """Turns, platforms and rejects of an export folder; of a chat in several files the first file counts."""
    files = sources.read_exports(store.spark, exports, pattern)
    parsed = sources.parse_exports(files)
    entries = store.write("entries", sources.with_instants(sources.typed_entries(parsed)))
    built = sources.build_conversations(entries.where("missing = ''"))
    first = built.groupBy("chat_id").agg(F.min("source_file").alias("source_file"))
    turns = built.join(first, ["chat_id", "source_file"], "left_semi").select("chat_id", "turn_index", "role", "text")
    rejects = parsed.where("reason is not null").select(sources.file_of(F.col("path")).alias("source_file"), F.lit(None).cast("bigint").alias("entry_id"), "reason")
    rejects = rejects.unionByName(entries.where("missing <> ''").select("source_file", "entry_id", F.concat(F.lit("missing "), "missing").alias("reason")))
    return {"turns": turns, "rejects": rejects, "platforms": turns.select("chat_id").distinct().withColumn("platform", F.lit(platform))}


def segment(store: Store, turns: DataFrame) -> dict[str, DataFrame]:
    windows = store.write("windows", embed_texts(S.sliding_texts(turns, 2), "text").select("chat_id", "i", "v"))
    return {"segments": S.segment_chats(turns, windows)}


def segment_texts(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, text) in the order of the turns."""
    j = segments.select("segment_id", "chat_id", "start_turn", "end_turn").join(turns, "chat_id").where("turn_index >= start_turn and turn_index < end_turn")
    a = j.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", F.coalesce("text", F.lit("")).alias("text")))).alias("a"))
    return a.select("segment_id", F.concat_ws("\n", F.transform("a", lambda x: x["text"])).alias("text"))


def keywords(store: Store, turns: DataFrame, segments: DataFrame, aliases: DataFrame | None) -> dict[str, DataFrame]:
    """segment_keywords and segment_embeddings; names are replaced by what ``aliases`` (source, target) says, if there is any."""
    texts = store.write("segment_texts", segment_texts(turns, segments))
    cand = K.candidates(texts)
    vec = embed_texts(cand.select("term").distinct(), "term", "v")
    seg = store.write("segment_embeddings", embed_texts(texts, "text", "embedding").select("segment_id", "embedding"))
    from pyspark.sql import Window

    j = cand.join(vec, "term").join(seg.withColumnRenamed("embedding", "u"), "segment_id")
    j = j.select("segment_id", "term", "v", F.round(X.dot(F.col("u"), F.col("v")), 9).alias("relevance"), F.row_number().over(Window.partitionBy("segment_id").orderBy("term")).alias("pos"))
    ranked = K.prune_substrings(K.rank_by_mmr(j)).select("segment_id", "pos", "term", "score")
    if aliases is not None:
        ranked = K.apply_map(ranked, aliases)
    best = ranked.groupBy("segment_id", "term").agg(F.max("score").alias("score"), F.min("pos").alias("pos")).join(cand.select("segment_id", "term", "entity_label"), ["segment_id", "term"], "left")
    lists = best.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "score", "entity_label"))), lambda k: F.struct(k["term"].alias("term"), k["score"].alias("score"), k["entity_label"].alias("entity_label"))).alias("keywords"))
    return {"segment_keywords": segments.select("segment_id", "chat_id", "label").join(lists, "segment_id", "left")}


def _units(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("segment_id").alias("id"), F.col("embedding").alias("v")).where(F.exists("embedding", lambda x: x != 0))


def concepts(store: Store, segment_embeddings: DataFrame) -> dict[str, DataFrame]:
    found = V.hdbscan_labels(_units(segment_embeddings), Concepts()).select(F.col("id").alias("segment_id"), F.concat(F.lit("concept "), "cluster").alias("concept"))
    return {"conversation_concepts": found.groupBy("concept").agg(F.array_sort(F.collect_list("segment_id")).alias("segments"))}


def domains(store: Store, segment_embeddings: DataFrame) -> dict[str, DataFrame]:
    v = _units(segment_embeddings)
    found = V.leiden_labels(v.select("id"), V.mutual(V.knn(v, Domains().k)))
    routed = V.route(V.intra_similarity(v.join(found, "id"), "community"))
    return {"macro_domains": routed.groupBy("domain").agg(F.array_sort(F.collect_list("id")).alias("segments"))}


def place(store: Store, segments: DataFrame, segment_embeddings: DataFrame) -> dict[str, DataFrame]:
    """Positions: neighbour layout, tangents pulled to their core, heights."""
    xy = layout.normalize(V.positions(_units(segment_embeddings))).withColumnRenamed("id", "segment_id").join(segments.select("segment_id", "chat_id", "label"), "segment_id")
    z = layout.segment_heights(segments)
    return {"layout": layout.tangent_pull(xy).join(z, "segment_id").select("segment_id", "x", "y", "z")}


def density(store: Store, layout_: DataFrame) -> dict[str, DataFrame]:
    """The mixture fitted to the positions, and its density on the grid."""
    c = Density()
    parts = store.write("mixture", V.mixture(layout_, c.components))
    return {"density_field": V.density_grid(V.grid(store.spark, 100.0, c.grid), parts)}


def publish(store: Store, segments: DataFrame, segment_keywords: DataFrame, layout_: DataFrame, platforms: DataFrame | None, conversation_concepts: DataFrame | None, macro_domains: DataFrame | None, density_field: DataFrame | None) -> dict[str, DataFrame]:
    """The sections of the map, checked; missing concepts, domains, platforms or density leave their columns or section out."""
    members = lambda df, name: None if df is None else df.select(F.explode("segments").alias("segment_id"), name)
    placed = layout_
    for name, df in (("concept", members(conversation_concepts, "concept")), ("domain", members(macro_domains, "domain"))):
        placed = placed.withColumn(name, F.lit(None).cast("string")) if df is None else placed.join(df, "segment_id", "left")
    from gistmap.operators.turns import segment_terms

    tops = K.segment_labels(segment_terms(segment_keywords))
    if platforms is None:
        platforms = segments.select("chat_id").distinct().withColumn("platform", F.lit("unknown"))
    out = assemble.v3_tables(segments, tops, platforms, placed)
    if density_field is not None:
        out["density_field"] = density_field
    for name, df in out.items():
        store.write(name + "_v3", df)
        store.write(name + "_v3", df, "json")
    bad = assemble.v3_violations(store.read("segments_v3"), store.read("conversation_concepts_v3"), store.read("macro_domains_v3"))
    return {"violations": bad}


STAGES = {
    s.name: s
    for s in (
        Stage("ingest", ingest, writes=("turns", "rejects", "platforms", "entries")),
        Stage("segment", segment, ("turns",), writes=("segments", "windows")),
        Stage("keywords", keywords, ("turns", "segments"), ("aliases",), ("segment_keywords", "segment_embeddings", "segment_texts")),
        Stage("concepts", concepts, ("segment_embeddings",), writes=("conversation_concepts",)),
        Stage("domains", domains, ("segment_embeddings",), writes=("macro_domains",)),
        Stage("place", place, ("segments", "segment_embeddings"), writes=("layout",)),
        Stage("density", density, ("layout",), writes=("density_field", "mixture")),
        Stage("publish", publish, ("segments", "segment_keywords", "layout"), ("platforms", "conversation_concepts", "macro_domains", "density_field"), ("segments_v3", "conversation_concepts_v3", "macro_domains_v3", "density_field_v3", "violations")),
    )
}


def needed_from(artefact: str) -> str:
    maker = next((s.name for s in STAGES.values() if artefact in s.writes), None)
    return f"run stage {maker!r} first" if maker else "no stage writes it"


def run(store: Store, names: list[str] | None = None, **settings) -> dict[str, DataFrame]:
    """Run the stages of these names (all) in their order; the artefacts they wrote. ``settings`` go to ``ingest``."""
    out: dict[str, DataFrame] = {}
    unknown = set(names or ()) - set(STAGES)
    if unknown:
        raise ValueError(f"no stage {', '.join(sorted(unknown))}; there are {', '.join(STAGES)}")
    for stage in STAGES.values():
        if names is not None and stage.name not in names:
            continue
        given = [store.read(n) for n in stage.needs] + [store.optional(n) for n in stage.may_use]
        made = stage.run(store, *given, **(settings if stage.name == "ingest" else {}))
        for name, df in made.items():
            out[name] = store.write(name, df)
    return out
