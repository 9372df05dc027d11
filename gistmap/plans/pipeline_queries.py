"""Queries of exports, artefacts, configuration and sinks, with their SQL twins.

Every sink writes its artefact into the shared folder and reads it back, so the twin checks what arrived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.functions import text as X
from gistmap.operators import aliases as AL
from gistmap.operators import assemble as A
from gistmap.operators import graph as G
from gistmap.operators import layout as L
from gistmap.operators import sources as SRC
from gistmap.operators import terms as K
from gistmap.operators import vectors as V
from gistmap.operators.turns import SQL, load
from gistmap.operators.turns import vectors as unit_vectors
from gistmap.pipeline import STAGES, Store
from gistmap.plans import term_queries as TQ
from gistmap.plans import vector_queries as VQ
from gistmap.runtime import checkpoint_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.startswith("WITH") else f"WITH {SQL} {sql}"
        return f

    return keep


def _store(spark) -> Store:
    """A folder of its own below the shared one."""
    return Store(spark, f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}")


# --- exports ------------------------------------------------------------------------------------


def _exports(spark, d) -> DataFrame:
    """The rows of raw_entries as an export tree, read back as files."""
    root = f"{checkpoint_dir(spark)}/exports-{uuid.uuid4().hex}"
    SRC.write_exports(table(spark, d, "raw_entries"), root)
    return SRC.read_exports(spark, root, "*.txt").withColumn("file", SRC.file_of(F.col("path")))


@query("SELECT DISTINCT source_file AS file FROM raw_entries")
def src_export_scan(spark, d):
    """Files of an export tree."""
    return _exports(spark, d).select("file")


@query("SELECT source_file AS file, (row_number() OVER (PARTITION BY source_file ORDER BY entry_index, entry_id) - 1)::INT AS entry_index, title, time, len(safeHtmlItem)::INT AS items, details[1].url AS url FROM raw_entries")
def src_export_parse(spark, d):
    """Entries of all files of an export tree."""
    e = SRC.typed_entries(SRC.parse_exports(_exports(spark, d)))
    return e.select(F.col("source_file").alias("file"), "entry_index", "title", "time", F.when(F.col("safeHtmlItem").isNotNull(), F.size("safeHtmlItem")).alias("items"), F.try_element_at("details", F.lit(1))["url"].alias("url"))


@query()
def src_schema_infer(spark, d):
    """The schema of every export file."""
    return SRC.infer_schemas(_exports(spark, d)).select(SRC.file_of(F.col("path")).alias("file"), "schema")


@query("SELECT source_file AS file, 'root' AS collection, count(*)::INT AS length FROM raw_entries GROUP BY source_file")
def src_collection_pick(spark, d):
    """The list of each file that most likely holds the conversations."""
    return SRC.pick_collections(_exports(spark, d)).select(SRC.file_of(F.col("path")).alias("file"), "collection", "length")


# --- artefacts and configuration ----------------------------------------------------------------


@query("SELECT segment_id, chat_id, word_count FROM segs")
def src_artifacts(spark, d):
    """An artefact as the next stage reads it."""
    s = _store(spark)
    s.write("segments", load(spark, d)["segments"])
    return s.read("segments").select("segment_id", "chat_id", "word_count")


@query("SELECT id AS term, round(min(x), 4) AS x, round(min(y), 4) AS y FROM map_segments WHERE id IS NOT NULL GROUP BY id")
def src_layout_json(spark, d):
    """Positions from a layout written as JSON."""
    s = _store(spark)
    s.write("layout", table(spark, d, "map_segments").where("id is not null").groupBy(F.col("id").alias("term")).agg(F.min("x").alias("x"), F.min("y").alias("y")), "json")
    return s.read("layout", "json").select("term", F.round(F.col("x").cast("double"), 4).alias("x"), F.round(F.col("y").cast("double"), 4).alias("y"))


@query(VQ._V2 + " SELECT source, target, cooccurrence FROM e2")
def src_graph_pickle(spark, d):
    """A stored graph: its edges, from the nodes and edges tables that stand for a pickled object."""
    nodes, edges = VQ._v2(spark, d)
    s = _store(spark)
    s.write("graph_nodes", nodes)
    return s.write("graph_edges", edges).join(s.read("graph_nodes").select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "cooccurrence")


_NORM = r"nullif(lower(regexp_replace(trim({}, ' '), '\s+', ' ', 'g')), '')"
_GROUPS = f"g AS (SELECT {_NORM.format('a')} AS source, {_NORM.format('canonical')} AS target FROM {{0}})"


@query(f", {_GROUPS.format('(SELECT canonical, unnest(aliases) AS a FROM canonical_terms)')} SELECT DISTINCT source, target, CASE WHEN contains(source, ' ') OR contains(target, ' ') THEN 'term' ELSE 'word' END AS kind FROM g WHERE source <> target")
def src_alias_config(spark, d):
    """Aliases of one word and of terms; an alias that is claimed twice or is a name is an error."""
    return AL.checked_aliases(table(spark, d, "canonical_terms"))


@query(
    f", {_GROUPS.format(chr(40) + 'SELECT list_last(string_split(canonical, chr(32))) AS canonical, string_split(canonical, chr(32))[1] AS a FROM canonical_terms' + chr(41))}"
    " SELECT source, 'claimed twice' AS rule FROM g WHERE source <> target GROUP BY source HAVING count(DISTINCT target) > 1 UNION ALL SELECT DISTINCT source, 'is a name' FROM g WHERE source <> target AND source IN (SELECT target FROM g)"
)
def set_alias_conflict(spark, d):
    """Conflicts of an alias list that has some: the first word of every canonical as alias of its last."""
    w = F.split("canonical", " ")
    groups = table(spark, d, "canonical_terms").select(F.element_at(w, -1).alias("canonical"), F.array(F.element_at(w, 1)).alias("aliases"))
    return AL.conflicts(groups)


def _sql_list(words) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in sorted(words))


@query(f"WITH w AS (SELECT * FROM (VALUES {_sql_list(set(X.STOPWORDS) | set(X.MODIFIER_NOUNS))}) AS t(word) UNION ALL SELECT given_name FROM given_names) SELECT DISTINCT lower(trim(word)) AS word FROM w WHERE trim(word) <> ''")
def src_stopwords(spark, d):
    """The union of three sources of words, in lower case; the list from a table is never gathered."""
    built_in = spark.createDataFrame([(w,) for w in sorted(X.stopwords(X.STOPWORDS, X.MODIFIER_NOUNS))], "word string")
    listed = table(spark, d, "given_names").select(F.lower(F.trim("given_name")).alias("word")).where("word <> ''")
    return built_in.unionByName(listed).distinct()


@query("SELECT segment_id, NULL::VARCHAR AS domain FROM segs")
def src_optional(spark, d):
    """Segments with the domains of an artefact that was never written."""
    domains = _store(spark).optional("macro_domains")
    segs = load(spark, d)["segments"].select("segment_id")
    return segs.withColumn("domain", F.lit(None).cast("string")) if domains is None else segs.join(domains, "segment_id", "left")


_NEEDS = [(s.name, n, next(m.name for m in STAGES.values() if n in m.writes)) for s in STAGES.values() for n in s.needs]


@query("WITH n(stage, artefact, maker) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _NEEDS) + ") SELECT * FROM n")
def src_prereq(spark, d):
    """What every stage misses in an empty folder, and the stage that makes it."""
    store = _store(spark)
    rows = [(s.name, n, next(m.name for m in STAGES.values() if n in m.writes)) for s in STAGES.values() for n in s.needs if store.optional(n) is None]
    return spark.createDataFrame(rows, "stage string, artefact string, maker string")


@query("SELECT DISTINCT term, string_split(term, ' ') AS words FROM terms")
def fn_words_of(spark, d):
    """The words of every term, merged phrases included."""
    return load(spark, d)["terms"].select("term", F.split("term", " ").alias("words")).distinct()


@query("SELECT 1 AS loads")
def fn_model_cache(spark, d):
    """How often a worker loaded the text encoder over many batches."""
    from gistmap.operators.embedding import cached_provider, loads

    @F.pandas_udf("int")
    def use(s):
        encode = cached_provider("hashed")
        encode(s.head(1))
        return s.map(lambda _: loads("hashed"))

    return load(spark, d)["terms"].select(use("term").alias("loads")).agg(F.max("loads").alias("loads"))


# --- sinks --------------------------------------------------------------------------------------


@query("SELECT chat_id, turn_index, role, text FROM turns")
def snk_conversations(spark, d):
    return _store(spark).write("turns", load(spark, d)["turns"])


@query("SELECT segment_id, chat_id, start_turn, end_turn, word_count, label FROM segs")
def snk_segments(spark, d):
    return _store(spark).write("segments", load(spark, d)["segments"]).select("segment_id", "chat_id", "start_turn", "end_turn", "word_count", "label")


@query("SELECT segment_id, count(*) AS terms, max(score) AS best FROM terms GROUP BY segment_id")
def snk_keywords(spark, d):
    """Keyword lists per segment, one row each."""
    lists = load(spark, d)["terms"].groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "score", "entity_label"))).alias("keywords"))
    back = _store(spark).write("segment_keywords", lists)
    return back.select("segment_id", F.size("keywords").cast("bigint").alias("terms"), F.array_max(F.transform("keywords", lambda k: k["score"])).alias("best"))


@query("SELECT segment_id, len(e) AS dim FROM (SELECT segment_id, min(embedding)::DOUBLE[] AS e FROM segment_embeddings WHERE len(embedding) > 0 GROUP BY segment_id) WHERE list_dot_product(e, e) > 0")
def snk_npz(spark, d):
    """Vectors in single precision."""
    v = unit_vectors(table(spark, d, "segment_embeddings")).select("segment_id", F.col("v").cast("array<float>").alias("embedding"))
    return _store(spark).write("segment_embeddings", v).select("segment_id", F.size("embedding").alias("dim"))


def _members(spark, d, column: str, name: str) -> DataFrame:
    m = table(spark, d, "map_segments").where(F.col(column).isNotNull() & F.col("id").isNotNull()).select(F.col(column).alias(name), "id").distinct()
    groups = m.groupBy(name).agg(F.array_sort(F.collect_list("id")).alias("segments"))
    return _store(spark).write(name, groups).select(name, F.size("segments").cast("bigint").alias("size"), F.array_join("segments", " ").alias("segments"))


_MEMBERS = "SELECT {0} AS {1}, count(*) AS size, string_agg(id, ' ' ORDER BY id) AS segments FROM (SELECT DISTINCT {0}, id FROM map_segments WHERE id IS NOT NULL) WHERE {0} IS NOT NULL GROUP BY {0}"


@query(_MEMBERS.format("conversation_concept_id", "concept"))
def snk_concepts(spark, d):
    """Concepts with their sorted segments."""
    return _members(spark, d, "conversation_concept_id", "concept")


@query(_MEMBERS.format("macro_domain_id", "domain"))
def snk_domains(spark, d):
    return _members(spark, d, "macro_domain_id", "domain")


@query("SELECT id AS segment_id, round(min(x), 6) AS x, round(min(y), 6) AS y, round(min(z), 6) AS z FROM map_segments WHERE id IS NOT NULL GROUP BY id")
def snk_layout(spark, d):
    m = table(spark, d, "map_segments").where("id is not null").groupBy(F.col("id").alias("segment_id")).agg(*[F.min(c).alias(c) for c in "xyz"])
    return _store(spark).write("layout", m).select("segment_id", *[F.round(c, 6).alias(c) for c in "xyz"])


# the density of the placed segments: one normal component per domain, from the moments of its segments
_FIT = """WITH p AS (SELECT id, min(x) AS x, min(y) AS y, coalesce(min(macro_domain_id), 'none') AS g FROM map_segments WHERE id IS NOT NULL GROUP BY id HAVING min(x) IS NOT NULL AND min(y) IS NOT NULL),
m AS (SELECT row_number() OVER (ORDER BY g) - 1 AS component, count(*) / (SELECT count(*) FROM p) AS weight, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) + 25 AS cxx, avg(x * y) - avg(x) * avg(y) AS cxy, avg(y * y) - avg(y) * avg(y) + 25 AS cyy FROM p GROUP BY g),
cells AS (SELECT j, i, i * 200.0 / 149 - 100 AS x, j * 200.0 / 149 - 100 AS y FROM range(150) a(j), range(150) b(i)),
lp AS (SELECT j, i, """ + VQ._LP + """ AS lp FROM cells, m),
ld AS (SELECT j, i, t + ln(s) AS log_density FROM (SELECT l.j, l.i, t, sum(exp(lp - t)) AS s FROM lp l JOIN (SELECT j, i, max(lp) AS t FROM lp GROUP BY ALL) USING (j, i) GROUP BY ALL))"""
#: Least variance of a component.
_FLOOR = 25.0


def fitted_components(points: DataFrame) -> DataFrame:
    """One normal component per group of (x, y, g): its share, mean and covariance, with a floor for the variances."""
    n = points.count()
    moment = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
    parts = points.groupBy("g").agg(
        (F.count("*") / F.lit(max(1, n))).alias("weight"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (moment("x", "x") + _FLOOR).alias("cxx"), moment("x", "y").alias("cxy"), (moment("y", "y") + _FLOOR).alias("cyy")
    )
    return parts.withColumn("component", F.row_number().over(Window.orderBy("g")) - 1).drop("g")


def _density(spark, d) -> DataFrame:
    m = table(spark, d, "map_segments").where("id is not null").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.coalesce(F.min("macro_domain_id"), F.lit("none")).alias("g"))
    return V.density_grid(V.grid(spark, 100.0, 150), fitted_components(m.where("x is not null and y is not null")))


@query(_FIT + " SELECT j, i, round(log_density, 5) AS log_density FROM ld")
def out_v3_density(spark, d):
    """The published density of the placed segments."""
    return _density(spark, d).select("j", "i", F.round("log_density", 5).alias("log_density"))


@query(_FIT + " SELECT j, i, round(log_density, 5) AS log_density FROM ld")
def snk_density(spark, d):
    return _store(spark).write("density_field", _density(spark, d)).select("j", "i", F.round("log_density", 5).alias("log_density"))


@query(VQ._OUT + " SELECT 'segments' AS section, count(*) AS rows FROM o_seg UNION ALL SELECT 'conversation_concepts', count(*) FROM o_con UNION ALL SELECT 'macro_domains', count(*) FROM o_dom")
def snk_v3(spark, d):
    """The payload written as JSON per section, as it is read back."""
    s = _store(spark)
    out = None
    for name, df in VQ._v3(spark, d).items():
        n = s.write(f"{name}_v3", df, "json").agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


# --- the word-level map -------------------------------------------------------------------------

_N2 = f"""{TQ._PMI}, {TQ._PLAT}, {TQ._CON},
cw AS (SELECT chat_id, sum(words) AS w FROM turns GROUP BY chat_id), hr AS (SELECT term, count(*) AS freq, sum(coalesce(w, 0)) AS depth, max(coalesce(w, 0)) AS focus FROM ck LEFT JOIN cw USING (chat_id) GROUP BY term){TQ._H2.split('GROUP BY term)', 2)[-1]},
tp AS (SELECT term, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM terms JOIN pl USING (chat_id) GROUP BY term),
dg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([term_a, term_b]) AS id FROM top) GROUP BY id),
n2 AS (SELECT k.term AS id, k.chat_count AS chats, round(z, 6) AS z, coalesce(platforms, '') AS platforms, concept, substr(concept, 1, 1) AS supertopic, coalesce(degree, 0) AS degree FROM kept k JOIN h2 USING (term) LEFT JOIN tp USING (term) JOIN cn USING (term) LEFT JOIN dg ON dg.id = k.term)"""


def _nodes(spark, d) -> DataFrame:
    kept, edges = G.cooccurrence_graph(TQ._ck(spark, d))
    deg = edges.select(F.explode(F.array("term_a", "term_b")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))
    plat = TQ._t(spark, d).join(TQ._platforms(spark, d), "chat_id").groupBy("term").agg(F.concat_ws(",", F.array_sort(F.collect_set("platform"))).alias("platforms"))
    n = kept.join(TQ._scaled_heights(spark, d).select("term", "z"), "term").join(plat, "term", "left").join(TQ._concepts(spark, d), "term").join(deg, "term", "left")
    return n.select(
        F.col("term").alias("id"), F.col("chat_count").alias("chats"), F.round("z", 6).alias("z"), F.coalesce("platforms", F.lit("")).alias("platforms"), "concept", F.substring("concept", 1, 1).alias("supertopic"), F.coalesce("degree", F.lit(0)).alias("degree"),
    )


@query(_N2 + " SELECT * FROM n2")
def out_v2(spark, d):
    """Nodes of the word-level map: chats, height, platforms, concept, supertopic and degree."""
    return _nodes(spark, d)


@query(f"{TQ._PMI} SELECT term_a AS source, term_b AS target, round(weight, 6) AS weight FROM wt JOIN top USING (term_a, term_b)")
def out_v2_edges(spark, d):
    return TQ._edges(spark, d).select(F.col("term_a").alias("source"), F.col("term_b").alias("target"), F.round("weight", 6).alias("weight"))


@query(_N2 + " SELECT supertopic AS id, count(*) AS nodes, sum(chats) AS chats, round(avg(z), 5) AS z FROM n2 GROUP BY supertopic")
def out_v2_supertopics(spark, d):
    return _nodes(spark, d).groupBy(F.col("supertopic").alias("id")).agg(F.count("*").alias("nodes"), F.sum("chats").alias("chats"), F.round(F.avg("z"), 5).alias("z"))


@query(VQ._V2 + ", bad AS (SELECT id FROM n2 WHERE chats >= 5) SELECT 'edges' AS tab, 'unknown source' AS rule, source || '|' || target AS at FROM e2 WHERE source NOT IN (SELECT id FROM bad) UNION ALL SELECT 'edges', 'unknown target', source || '|' || target FROM e2 WHERE target NOT IN (SELECT id FROM bad)")
def chk_v2(spark, d):
    """Broken constraints of a map whose nodes of few chats were lost."""
    n, e = VQ._v2(spark, d)
    return A.v2_violations(n.where("chats >= 5"), e).withColumnRenamed("table", "tab")


@query(_N2 + " SELECT 'nodes' AS section, count(*) AS rows FROM n2 UNION ALL SELECT 'edges', count(*) FROM top")
def snk_v2(spark, d):
    """Nodes and edges written as JSON, as they are read back."""
    s = _store(spark)
    n = s.write("nodes_v2", _nodes(spark, d), "json").agg(F.count("*").alias("rows")).select(F.lit("nodes").alias("section"), "rows")
    e = s.write("edges_v2", TQ._edges(spark, d), "json").agg(F.count("*").alias("rows")).select(F.lit("edges").alias("section"), "rows")
    return n.unionByName(e)


_PH1 = "ph AS (SELECT term AS phrase, count(*) AS count FROM terms GROUP BY term)"


@query(
    f"{TQ._PMI}, {_PH1}, {TQ._CON} SELECT 'chat_keywords' AS artefact, count(*) AS rows FROM ck UNION ALL SELECT 'phrases', count(*) FROM ph WHERE contains(phrase, ' ') UNION ALL SELECT 'concepts', count(DISTINCT concept) FROM cn"
    " UNION ALL SELECT 'chat_concepts', count(*) FROM (SELECT DISTINCT chat_id, concept FROM terms JOIN cn USING (term)) UNION ALL SELECT 'segment_concepts', count(*) FROM (SELECT DISTINCT segment_id, concept FROM terms JOIN cn USING (term))"
    " UNION ALL SELECT 'supertopics', count(DISTINCT substr(concept, 1, 1)) FROM cn UNION ALL SELECT 'graph_nodes', count(*) FROM kept UNION ALL SELECT 'graph_edges', count(*) FROM top UNION ALL SELECT 'height_scores', count(DISTINCT term) FROM ck"
)
def snk_legacy(spark, d):
    """The artefacts of the word-level map, written and read back: rows of each."""
    t, s = TQ._t(spark, d), _store(spark)
    concepts = TQ._concepts(spark, d)
    kept, edges = G.cooccurrence_graph(TQ._ck(spark, d))
    of = t.join(concepts, "term")
    made = {
        "chat_keywords": TQ._ck(spark, d), "phrases": TQ._phrases(spark, d).where(F.col("phrase").contains(" ")), "concepts": concepts.groupBy("concept").agg(F.array_sort(F.collect_list("term")).alias("terms")),
        "chat_concepts": of.select("chat_id", "concept").distinct(), "segment_concepts": of.select("segment_id", "concept").distinct(), "supertopics": concepts.select(F.substring("concept", 1, 1).alias("supertopic")).distinct(),
        "graph_nodes": kept, "graph_edges": edges, "height_scores": TQ._scaled_heights(spark, d),
    }
    out = None
    for name, df in made.items():
        n = s.write(name, df).agg(F.count("*").alias("rows")).select(F.lit(name).alias("artefact"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    f"{TQ._SNAP}, again AS (SELECT coalesce(s.target, w.word) AS word, sum(freq) AS freq FROM wf w LEFT JOIN snap s ON s.word = w.word GROUP BY 1),"
    " p2 AS (SELECT a.word AS source, arg_min(b.word, (-b.freq, b.word)) AS target FROM again a JOIN again b ON a.word <> b.word AND a.word[1] = b.word[1] AND b.freq >= 3 * a.freq WHERE jaro_winkler_similarity(a.word, b.word) >= 0.88 GROUP BY a.word)"
    " SELECT s.word AS source, coalesce(p.target, s.target) AS target FROM snap s LEFT JOIN p2 p ON p.source = s.target UNION ALL SELECT source, target FROM p2 WHERE source NOT IN (SELECT word FROM snap)"
)
def ml_canonical_map(spark, d):
    """Dictionary snap, new counts, frequency snap, composed: (source, target) of every word that changes."""
    return TQ.ml_canonical_map(spark, d)
