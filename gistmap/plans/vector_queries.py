"""Queries of vectors, concepts, domains, layout, density and the published tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Concepts, Domains
from gistmap.functions import text as X
from gistmap.operators import assemble as A
from gistmap.operators import layout as L
from gistmap.operators import vectors as V
from gistmap.operators.terms import segment_labels
from gistmap.operators.turns import SQL, load
from gistmap.operators.turns import vectors as unit_vectors
from gistmap.plans.term_queries import _PLAT, _platforms
from gistmap.runtime import table

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


# --- neighbours ---------------------------------------------------------------------------------

_E = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS community FROM embeddings),
x AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 9) AS sim, a.community AS ca, b.community AS cb FROM e a JOIN e b ON a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM x) WHERE rank <= 15),
intra AS (SELECT id, community, coalesce((SELECT avg(sim) FROM x WHERE x.a = e.id AND x.ca = x.cb), 0) AS intra FROM e)"""


def _vec(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("community"))


@query("SELECT segment_id, len(e) AS dim, round(list_dot_product(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS norm FROM (SELECT segment_id, min(embedding)::DOUBLE[] AS e FROM segment_embeddings WHERE len(embedding) > 0 GROUP BY segment_id) WHERE list_dot_product(e, e) > 0")
def src_npz(spark, d):
    """Usable unit vectors of the segments."""
    v = unit_vectors(table(spark, d, "segment_embeddings"))
    return v.select("segment_id", F.size("v").alias("dim"), F.round(X.dot(F.col("v"), F.col("v")), 6).alias("norm"))


@query(_E + " SELECT a, b, round(sim, 6) AS sim FROM nn WHERE rank = 1")
def jn_knn_cross(spark, d):
    """The nearest neighbour of every vector."""
    return V.knn(_vec(spark, d).select("id", "v"), 1).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_E + " SELECT a, b, rank FROM nn")
def win_knn_rank(spark, d):
    return V.knn(_vec(spark, d).select("id", "v"), 15).select("a", "b", "rank")


@query(_E + " SELECT a.a, a.b FROM nn a JOIN nn b ON a.a = b.b AND a.b = b.a WHERE a.a < a.b")
def gr_mutual_knn(spark, d):
    return V.mutual(V.knn(_vec(spark, d).select("id", "v"), 15))


@query(_E + " SELECT a, count(*) AS partners FROM (SELECT a.a FROM nn a JOIN nn b ON a.a = b.b AND a.b = b.a WHERE a.a < a.b) GROUP BY a")
def jn_mutual(spark, d):
    return gr_mutual_knn(spark, d).groupBy("a").agg(F.count("*").alias("partners"))


@query(_E + " SELECT id, round(intra, 6) AS intra FROM intra")
def gr_intra_sim(spark, d):
    return V.intra_similarity(_vec(spark, d), "community").select("id", F.round("intra", 6).alias("intra"))


@query(_E + " SELECT community, round(avg(intra), 6) AS intra FROM intra GROUP BY community")
def jn_intra_community(spark, d):
    return V.intra_similarity(_vec(spark, d), "community").groupBy("community").agg(F.round(F.avg("intra"), 6).alias("intra"))


@query(_E + ", c AS (SELECT community, list(s ORDER BY k) AS s FROM (SELECT community, k, sum(x) AS s FROM (SELECT community, unnest(v) AS x, unnest(range(len(v))) AS k FROM e) GROUP BY ALL) GROUP BY community) SELECT community, id AS medoid FROM (SELECT e.community, id, row_number() OVER (PARTITION BY e.community ORDER BY (id % 3 = 0)::INT DESC, round(list_dot_product(v, s), 9) DESC, id) AS k FROM e JOIN c USING (community)) WHERE k = 1")
def top1_medoid(spark, d):
    """The most central member of each group; every third row counts as having a keyword."""
    m = _vec(spark, d).withColumn("has_kw", (F.col("id") % 3 == 0).cast("int"))
    return V.medoids(m, "community")


_R = _E + ", bad AS (SELECT *, round(intra, 9) < 0.0 AS bad FROM intra), sv AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY community) AS surviving FROM bad)"


def _routed(spark, d) -> DataFrame:
    return V.route(V.intra_similarity(_vec(spark, d), "community"), Domains(min_similarity=0.0, min_size=25))


@query(_R + " SELECT id, CASE WHEN bad OR surviving < 25 THEN 'Background / Minor Orbit' ELSE community::VARCHAR END AS domain FROM sv")
def flt_too_dissimilar(spark, d):
    return _routed(spark, d)


@query(_R + " SELECT CASE WHEN bad OR surviving < 25 THEN 'Background / Minor Orbit' ELSE community::VARCHAR END AS domain, count(*) AS n FROM sv GROUP BY 1")
def flt_too_small(spark, d):
    return _routed(spark, d).groupBy("domain").agg(F.count("*").alias("n"))


@query(_R + " SELECT DISTINCT community, surviving FROM sv")
def agg_surviving_size(spark, d):
    m = V.intra_similarity(_vec(spark, d), "community")
    return m.groupBy("community").agg(F.count_if(~(F.round("intra", 9) < 0.0)).alias("surviving"))


# --- domain labels ------------------------------------------------------------------------------

_DM = ", dm AS (SELECT id AS segment_id, min(macro_domain_id) AS community FROM maps WHERE macro_domain_id IS NOT NULL GROUP BY id), dt AS (SELECT community, segment_id, term FROM dm JOIN (SELECT DISTINCT segment_id, term FROM terms) USING (segment_id)), ps AS (SELECT *, count(*) OVER (PARTITION BY term) AS cf FROM (SELECT community, term, count(*) AS tf FROM dt GROUP BY ALL)), nc AS (SELECT count(DISTINCT community) AS n FROM dt)"


def _domain_terms(spark, d) -> DataFrame:
    t = load(spark, d)
    dom = t["map"].where("macro_domain_id is not null").groupBy(F.col("id").alias("segment_id")).agg(F.min("macro_domain_id").alias("community"))
    return dom.join(t["terms"].select("segment_id", "term").distinct(), "segment_id")


@query(_DM + " SELECT * FROM ps")
def agg_community_presence(spark, d):
    return V.presence(_domain_terms(spark, d))


@query(_DM + " SELECT DISTINCT term, round(ln((n + 1) / (cf + 1)) + 1.0, 6) AS icf FROM ps, nc")
def fn_icf(spark, d):
    r = _domain_terms(spark, d)
    n = r.agg(F.countDistinct("community").alias("n")).scalar()
    return V.presence(r).select("term", F.round(V.icf(F.col("cf"), n), 6).alias("icf")).distinct()


_TI = _DM + ", sc AS (SELECT community, term, row_number() OVER (PARTITION BY community ORDER BY (len(string_split(term, ' ')) <= 3)::INT DESC, round(tf * (ln((n + 1) / (cf + 1)) + 1.0), 9) DESC, term) AS k FROM ps, nc)"


@query(_TI + " SELECT community, CASE WHEN len(string_split(term, ' ')) <= 3 THEN term ELSE array_to_string(string_split(term, ' ')[1:3], ' ') END AS label FROM sc WHERE k = 1")
def gr_tf_icf(spark, d):
    return V.community_labels(_domain_terms(spark, d))


@query(_TI + " SELECT community, term AS best FROM sc WHERE k = 1")
def top1_tf_icf(spark, d):
    return V.community_labels(_domain_terms(spark, d), 99).select("community", F.col("label").alias("best"))


_CM = ", cm AS (SELECT conversation_concept_id AS concept, id AS segment_id, min(macro_domain_id) AS domain FROM maps WHERE conversation_concept_id IS NOT NULL GROUP BY ALL)"


def _concept_members(spark, d) -> DataFrame:
    m = load(spark, d)["map"].where("conversation_concept_id is not null")
    return m.groupBy(F.col("conversation_concept_id").alias("concept"), F.col("id").alias("segment_id")).agg(F.min("macro_domain_id").alias("domain"))


@query(_CM + " SELECT concept, domain FROM (SELECT concept, domain, row_number() OVER (PARTITION BY concept ORDER BY n DESC, f) AS k FROM (SELECT concept, coalesce(domain, 'Background / Minor Orbit') AS domain, count(*) AS n, min(segment_id) AS f FROM cm GROUP BY 1, 2)) WHERE k = 1")
def agg_majority_vote(spark, d):
    return V.majority(_concept_members(spark, d))


@query(_CM + " SELECT domain, count(*) AS segments, count(DISTINCT concept) AS concepts FROM cm WHERE domain IS NOT NULL GROUP BY domain ORDER BY segments DESC, domain LIMIT 40")
def topk_domains(spark, d):
    return _concept_members(spark, d).where("domain is not null").groupBy("domain").agg(F.count("*").alias("segments"), F.countDistinct("concept").alias("concepts")).orderBy(F.desc("segments"), "domain").limit(40)


@query(_CM + " SELECT min(n) AS smallest, max(n) AS largest, list(n ORDER BY n DESC)[len(list(n)) // 2 + 1] AS middle FROM (SELECT count(*) AS n FROM cm WHERE domain IS NOT NULL GROUP BY domain)")
def agg_domain_sizes(spark, d):
    n = _concept_members(spark, d).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))
    k = Window.orderBy(F.desc("n"), "domain")
    r = n.withColumn("k", F.row_number().over(k)).withColumn("m", F.count("*").over(Window.partitionBy()))
    return r.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max(F.when(F.col("k") == F.floor(F.col("m") / 2) + 1, F.col("n"))).alias("middle"))


@query("SELECT label, k, CASE WHEN k = 1 THEN label ELSE label || ' (' || k || ')' END AS name FROM (SELECT label, segment_id, row_number() OVER (PARTITION BY label ORDER BY segment_id) AS k FROM (SELECT segment_id, arg_max(term, (score, -pos)) AS label FROM terms GROUP BY segment_id))")
def win_dedupe_suffix(spark, d):
    """Top keywords as labels, repeated ones numbered."""
    t = segment_labels(load(spark, d)["terms"]).withColumnRenamed("top", "label")
    u = L.dedupe(t, "label", ["segment_id"], " ({})")
    return u.select("label", F.row_number().over(Window.partitionBy("label").orderBy("segment_id")).alias("k"), F.col("unique").alias("name"))


@query("SELECT label, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM (SELECT label, slug, row_number() OVER (PARTITION BY slug ORDER BY label) AS k FROM (SELECT DISTINCT term AS label, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(term, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'topic') AS slug FROM terms))")
def jn_slug(spark, d):
    return A.slugs(load(spark, d)["terms"].select(F.col("term").alias("label")))


# --- clustering and layout ----------------------------------------------------------------------


@query()
def ml_hdbscan_segments(spark, d):
    """Conversation concepts by density; noise rows are concepts of their own."""
    v = unit_vectors(table(spark, d, "segment_embeddings")).withColumnRenamed("segment_id", "id")
    return V.hdbscan_labels(v, Concepts())


@query()
def ml_hdbscan_terms(spark, d):
    """Concepts of the hashed vectors of all distinct terms; noise terms are concepts of their own."""
    from gistmap.operators.embedding import embed_texts

    t = load(spark, d)["terms"].select(F.col("term").alias("id")).distinct()
    return V.hdbscan_labels(embed_texts(t, "id", "v"), Concepts(2, 3))


@query()
def ml_ward(spark, d):
    return V.ward_labels(_vec(spark, d), 80)


@query()
def gr_leiden_cpm(spark, d):
    v = _vec(spark, d).select("id", "v")
    return V.leiden_labels(v.select("id"), V.mutual(V.knn(v, 15)))


@query()
def gr_domains(spark, d):
    """Domains of the segments: communities of the neighbour graph, weak members to the background."""
    v = unit_vectors(table(spark, d, "segment_embeddings")).withColumnRenamed("segment_id", "id")
    found = V.leiden_labels(v.select("id"), V.mutual(V.knn(v, 15)))
    return V.route(V.intra_similarity(v.join(found, "id"), "community"))


@query()
def ml_umap(spark, d):
    v = _vec(spark, d).select("id", "v")
    return L.normalize(V.positions(v)).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def gr_spring_layout(spark, d):
    from gistmap.operators.graph import cooccurrence_graph
    from gistmap.operators.terms import chat_keywords

    nodes, edges = cooccurrence_graph(chat_keywords(load(spark, d)["terms"]))
    return L.normalize(V.spring_positions(nodes, edges)).select("term", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_XY = """WITH p AS (SELECT vec_id AS id, vec_id // 20 AS chat_id, CASE WHEN vec_id % 4 = 0 THEN 'core' ELSE 'tangent' END AS label, label AS grp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, vec_id % 17 AS word_count FROM embeddings),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
n AS (SELECT id, chat_id, label, grp, (x - (x0 + x1) / 2) / (greatest(x1 - x0, y1 - y0) / 2) * 100 AS x, (y - (y0 + y1) / 2) / (greatest(x1 - x0, y1 - y0) / 2) * 100 AS y FROM p, r),
c AS (SELECT chat_id, avg(x) AS cx, avg(y) AS cy FROM n WHERE label = 'core' GROUP BY chat_id),
t AS (SELECT n.*, CASE WHEN label = 'tangent' AND cx IS NOT NULL THEN 0.85 * x + 0.15 * cx ELSE x END AS px, CASE WHEN label = 'tangent' AND cx IS NOT NULL THEN 0.85 * y + 0.15 * cy ELSE y END AS py FROM n LEFT JOIN c USING (chat_id)),
h AS (SELECT id, 50 * (ln(1 + word_count) - lo) / (hi - lo) AS z FROM p, (SELECT min(ln(1 + word_count)) AS lo, max(ln(1 + word_count)) AS hi FROM p))"""


def _points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("vec_id div 20").alias("chat_id"), F.when(F.col("vec_id") % 4 == 0, "core").otherwise("tangent").alias("label"), F.col("label").alias("grp"),
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("vec_id") % 17).alias("word_count"),
    )


def _r6(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c for c in keep if c not in "xyz"], *[F.round(c, 6).alias(c) for c in keep if c in "xyz"])


@query(_XY + " SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM n")
def fn_normalize_positions(spark, d):
    return _r6(L.normalize(_points(spark, d)), "id", "x", "y")


@query(_XY + " SELECT round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM r")
def agg_minmax_extent(spark, d):
    return _points(spark, d).agg(*[F.round(f(c), 6).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])


@query(_XY + " SELECT id, round(px, 6) AS x, round(py, 6) AS y FROM t")
def fn_tangent_pull(spark, d):
    return _r6(L.tangent_pull(L.normalize(_points(spark, d))), "id", "x", "y")


@query(_XY + " SELECT chat_id, round(cx, 6) AS x, round(cy, 6) AS y FROM c")
def agg_core_centroid(spark, d):
    p = L.normalize(_points(spark, d)).where("label = 'core'")
    return p.groupBy("chat_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(_XY + " SELECT id, round(z, 6) AS z FROM h")
def win_minmax(spark, d):
    return _r6(L.segment_heights(_points(spark, d).withColumnRenamed("id", "segment_id")).withColumnRenamed("segment_id", "id"), "id", "z")


@query(_XY + " SELECT grp, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM n GROUP BY grp")
def agg_group_centroid(spark, d):
    return L.normalize(_points(spark, d)).groupBy("grp").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(_XY + " SELECT grp, round(avg(z), 6) AS z FROM n JOIN h USING (id) GROUP BY grp")
def agg_group_z(spark, d):
    p = _points(spark, d)
    h = L.segment_heights(p.withColumnRenamed("id", "segment_id")).withColumnRenamed("segment_id", "id")
    return p.join(h, "id").groupBy("grp").agg(F.round(F.coalesce(F.avg("z"), F.lit(0.0)), 6).alias("z"))


@query(_XY + ", pg AS (SELECT grp, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS segment_count FROM n JOIN h USING (id) GROUP BY grp) SELECT grp, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, segment_count FROM pg")
def agg_supertopic_centroid(spark, d):
    p = L.normalize(_points(spark, d))
    h = L.segment_heights(_points(spark, d).withColumnRenamed("id", "segment_id")).withColumnRenamed("segment_id", "id")
    return _r6(L.centroids(p.join(h, "id"), "grp"), "grp", "segment_count", "x", "y", "z")


@query("SELECT segment_id, round(50 * CASE WHEN hi > lo THEN (ln(1 + word_count) - lo) / (hi - lo) ELSE 0 END, 6) AS z FROM segs, (SELECT min(ln(1 + word_count)) AS lo, max(ln(1 + word_count)) AS hi FROM segs)")
def fn_height_v3(spark, d):
    """Heights of all segments: log word count, scaled over all of them."""
    return L.segment_heights(load(spark, d)["segments"]).select("segment_id", F.round("z", 6).alias("z"))


# --- density ------------------------------------------------------------------------------------

_MIX = "m AS (SELECT * FROM (VALUES (0, 0.5, -20.0, 10.0, 300.0, 40.0, 200.0), (1, 0.3, 30.0, -15.0, 150.0, -20.0, 250.0), (2, 0.1995, 0.0, 50.0, 80.0, 0.0, 60.0), (3, 0.0005, 90.0, 90.0, 20.0, 0.0, 20.0)) AS t(component, weight, mx, my, cxx, cxy, cyy))"
_LP = "ln(weight) - ln(2 * pi()) - 0.5 * ln(cxx * cyy - cxy * cxy) - 0.5 * ((cyy * (x - mx) * (x - mx) - 2 * cxy * (x - mx) * (y - my) + cxx * (y - my) * (y - my)) / (cxx * cyy - cxy * cxy))"
_GRID = f"WITH {_MIX}, cells AS (SELECT j, i, i * 200.0 / 39 - 100 AS x, j * 200.0 / 39 - 100 AS y FROM range(40) a(j), range(40) b(i)), lp AS (SELECT j, i, {_LP} AS lp FROM cells, m), ld AS (SELECT j, i, t + ln(s) AS log_density FROM (SELECT l.j, l.i, t, sum(exp(lp - t)) AS s FROM lp l JOIN (SELECT j, i, max(lp) AS t FROM lp GROUP BY ALL) USING (j, i) GROUP BY ALL))"


def _mix(spark) -> DataFrame:
    """A fixed mixture."""
    rows = [(0, 0.5, -20.0, 10.0, 300.0, 40.0, 200.0), (1, 0.3, 30.0, -15.0, 150.0, -20.0, 250.0), (2, 0.1995, 0.0, 50.0, 80.0, 0.0, 60.0), (3, 0.0005, 90.0, 90.0, 20.0, 0.0, 20.0)]
    return spark.createDataFrame(rows, "component int, weight double, mx double, my double, cxx double, cxy double, cyy double")


@query(f"{_GRID} SELECT j, i, round(x, 6) AS x, round(y, 6) AS y FROM cells")
def jn_grid_cross(spark, d):
    return V.grid(spark, 100.0, 40).select("j", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"{_GRID} SELECT j, i, round(log_density, 6) AS log_density FROM ld")
def ml_density_grid(spark, d):
    return V.density_grid(V.grid(spark, 100.0, 40), _mix(spark)).select("j", "i", F.round("log_density", 6).alias("log_density"))


@query(f"{_GRID} SELECT j, i, round((row_number() OVER (ORDER BY round(log_density, 9), j, i) - 1) / (count(*) OVER () - 1), 6) AS normalized_density FROM ld")
def win_percentile_rank(spark, d):
    return V.density_grid(V.grid(spark, 100.0, 40), _mix(spark)).select("j", "i", F.round("normalized_density", 6).alias("normalized_density"))


@query(f"WITH {_MIX} SELECT count(*) FILTER (WHERE weight > 0.001) AS effective FROM m")
def flt_effective_components(spark, d):
    return _mix(spark).agg(F.count_if(F.col("weight") > 1e-3).alias("effective"))


@query(_XY + f", {_MIX}, lq AS (SELECT id, component, {_LP} AS lp FROM n, m) SELECT id, component, round(exp(lp - t) / sum(exp(lp - t)) OVER (PARTITION BY id), 6) AS p FROM lq JOIN (SELECT id, max(lp) AS t FROM lq GROUP BY id) USING (id)")
def ml_responsibilities(spark, d):
    p = L.normalize(_points(spark, d)).select("id", "x", "y")
    return V.responsibilities(p, _mix(spark)).select("id", "component", F.round("p", 6).alias("p"))


@query()
def ml_dpgmm(spark, d):
    m = V.mixture(L.normalize(_points(spark, d)), 20)
    return m.select("component", F.round("weight", 4).alias("weight"), F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"))


@query(f"{_GRID} SELECT 39 - j AS j, i, round(40.0 * (row_number() OVER (ORDER BY round(log_density, 9), j, i) - 1) / (count(*) OVER () - 1), 6) AS z FROM ld")
def vw_terrain_flip(spark, d):
    """Terrain heights with the rows turned round."""
    g = V.density_grid(V.grid(spark, 100.0, 40), _mix(spark))
    return g.select((39 - F.col("j")).alias("j"), "i", F.round(F.col("normalized_density") * 40.0, 6).alias("z"))


@query(f"{_GRID}, p AS (SELECT j, i, (row_number() OVER (ORDER BY round(log_density, 9), j, i) - 1) / (count(*) OVER () - 1) AS v FROM ld) SELECT j, i, least(3, floor(v * 4))::INT AS stop, round(v * 4 - least(3, floor(v * 4)), 6) AS share FROM p")
def fn_color_ramp(spark, d):
    """Place of each cell on a ramp of five colours: lower stop and share of the way to the next."""
    g = V.density_grid(V.grid(spark, 100.0, 40), _mix(spark))
    v = F.col("normalized_density") * 4
    stop = F.least(F.lit(3), F.floor(v))
    return g.select("j", "i", stop.cast("int").alias("stop"), F.round(v - stop, 6).alias("share"))


# --- published tables ---------------------------------------------------------------------------

_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0}, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'topic')"
_OUT = f""", {_PLAT}, lay AS (SELECT id AS segment_id, min(x) AS x, min(y) AS y, min(z) AS z, min(conversation_concept_id) AS concept, min(macro_domain_id) AS domain FROM maps GROUP BY id),
top AS (SELECT segment_id, arg_max(term, (score, -pos)) AS top FROM terms GROUP BY segment_id),
cid AS (SELECT label, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY label) AS k FROM (SELECT DISTINCT concept AS label, {_SLUG.format('concept')} AS slug FROM lay WHERE concept IS NOT NULL))),
did AS (SELECT label, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY label) AS k FROM (SELECT DISTINCT domain AS label, {_SLUG.format('domain')} AS slug FROM lay WHERE domain IS NOT NULL))),
o_seg AS (SELECT s.segment_id AS id, coalesce(top, '') AS label, s.chat_id, coalesce(platform, 'unknown') AS platform, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, s.word_count, s.label = 'tangent' AS is_tangent, c.id AS conversation_concept_id, d.id AS macro_domain_id
  FROM segs s JOIN lay USING (segment_id) LEFT JOIN top USING (segment_id) LEFT JOIN pl ON pl.chat_id = s.chat_id LEFT JOIN cid c ON c.label = concept LEFT JOIN did d ON d.label = domain),
vote AS (SELECT concept, domain FROM (SELECT concept, domain, row_number() OVER (PARTITION BY concept ORDER BY n DESC, f) AS k FROM (SELECT concept, domain, count(*) AS n, min(segment_id) AS f FROM lay WHERE concept IS NOT NULL AND domain IS NOT NULL GROUP BY ALL)) WHERE k = 1),
o_con AS (SELECT c.id, concept AS label, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, segment_count, d.id AS macro_domain_id FROM (SELECT concept, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS segment_count FROM lay WHERE concept IS NOT NULL GROUP BY concept) g JOIN cid c ON c.label = concept LEFT JOIN vote USING (concept) LEFT JOIN did d ON d.label = domain),
o_dom AS (SELECT d.id, domain AS label, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, segment_count FROM (SELECT domain, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS segment_count FROM lay WHERE domain IS NOT NULL GROUP BY domain) g JOIN did d ON d.label = domain)"""


def _placed(spark, d) -> DataFrame:
    m = load(spark, d)["map"].groupBy(F.col("id").alias("segment_id"))
    return m.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"), F.min("conversation_concept_id").alias("concept"), F.min("macro_domain_id").alias("domain"))


def _v3(spark, d) -> dict[str, DataFrame]:
    t = load(spark, d)
    out = A.v3_tables(t["segments"], segment_labels(t["terms"]), _platforms(spark, d), _placed(spark, d))
    return {k: v.withColumns({c: F.round(c, 3) for c in "xyz"}) for k, v in out.items()}


@query(_OUT + " SELECT * FROM o_seg")
def out_v3_segments(spark, d):
    return _v3(spark, d)["segments"]


@query(_OUT + " SELECT * FROM o_con")
def out_v3_concepts(spark, d):
    return _v3(spark, d)["conversation_concepts"]


@query(_OUT + " SELECT * FROM o_dom")
def out_v3_domains(spark, d):
    return _v3(spark, d)["macro_domains"]


@query(_OUT + " SELECT id, conversation_concept_id FROM o_seg")
def jn_segment_concept(spark, d):
    return _v3(spark, d)["segments"].select("id", "conversation_concept_id")


@query(_OUT + " SELECT id, macro_domain_id FROM o_seg")
def jn_segment_domain(spark, d):
    return _v3(spark, d)["segments"].select("id", "macro_domain_id")


@query(_OUT + " SELECT id, macro_domain_id FROM o_con")
def jn_concept_domain(spark, d):
    return _v3(spark, d)["conversation_concepts"].select("id", "macro_domain_id")


@query(_OUT + " SELECT s.segment_id, round(x, 6) AS x, round(y, 6) AS y FROM segs s JOIN lay USING (segment_id)")
def jn_layout(spark, d):
    s = load(spark, d)["segments"].select("segment_id").join(_placed(spark, d), "segment_id")
    return _r6(s, "segment_id", "x", "y")


@query(_OUT + " SELECT segment_id FROM segs WHERE segment_id IN (SELECT segment_id FROM lay)")
def flt_positioned(spark, d):
    return load(spark, d)["segments"].select("segment_id").join(_placed(spark, d).select("segment_id"), "segment_id", "left_semi")


@query(_OUT + """ SELECT 'segments' AS tab, 'duplicate id' AS rule, id AS at FROM o_seg GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'segments', 'null conversation_concept_id', id FROM o_seg WHERE conversation_concept_id IS NULL
UNION ALL SELECT 'conversation_concepts', 'null macro_domain_id', id FROM o_con WHERE macro_domain_id IS NULL
UNION ALL SELECT 'segments', 'unknown conversation_concept_id', id FROM o_seg WHERE conversation_concept_id NOT IN (SELECT id FROM o_con)
UNION ALL SELECT 'segments', 'unknown macro_domain_id', id FROM o_seg WHERE macro_domain_id NOT IN (SELECT id FROM o_dom)""")
def chk_v3(spark, d):
    """Broken constraints of the published tables (the older map lacks some concepts and domains)."""
    t = _v3(spark, d)
    return A.v3_violations(t["segments"], t["conversation_concepts"], t["macro_domains"]).withColumnRenamed("table", "tab")


_V2 = ", n2 AS (SELECT term AS id, count(DISTINCT chat_id) AS chats FROM terms GROUP BY term HAVING count(DISTINCT chat_id) >= 3), k2 AS (SELECT DISTINCT chat_id, term FROM terms WHERE term IN (SELECT id FROM n2)), e2 AS (SELECT a.term AS source, b.term AS target, count(*) AS cooccurrence FROM k2 a JOIN k2 b ON a.chat_id = b.chat_id AND a.term < b.term GROUP BY ALL)"


def _v2(spark, d):
    from gistmap.operators import graph as G
    from gistmap.operators.terms import chat_keywords, kept_terms

    ck = chat_keywords(load(spark, d)["terms"])
    kept = kept_terms(ck, 3)
    e = G.pairs(ck, kept).select(F.col("term_a").alias("source"), F.col("term_b").alias("target"), "cooccurrence")
    return kept.select(F.col("term").alias("id"), F.col("chat_count").alias("chats")), e


@query(_OUT + " SELECT id, label, segment_count AS size FROM o_dom")
def vw_macro(spark, d):
    return _v3(spark, d)["macro_domains"].select("id", "label", F.col("segment_count").alias("size"))


@query(_OUT + " SELECT id, label, segment_count AS size FROM o_con WHERE macro_domain_id = 'travel'")
def vw_concepts_in_domain(spark, d):
    return _v3(spark, d)["conversation_concepts"].where("macro_domain_id = 'travel'").select("id", "label", F.col("segment_count").alias("size"))


@query(_OUT + " SELECT id, CASE WHEN label = '' THEN '(untitled segment · ' || chat_id || ')' ELSE label END AS title, word_count AS size FROM o_seg WHERE conversation_concept_id IN (SELECT min(id) FROM o_con WHERE macro_domain_id = 'travel')")
def vw_segments_in_concept(spark, d):
    t = _v3(spark, d)
    first = t["conversation_concepts"].where("macro_domain_id = 'travel'").agg(F.min("id").alias("conversation_concept_id"))
    s = t["segments"].join(F.broadcast(first), "conversation_concept_id", "left_semi")
    title = F.when(F.col("label") == "", F.concat(F.lit("(untitled segment · "), "chat_id", F.lit(")"))).otherwise(F.col("label"))
    return s.select("id", title.alias("title"), F.col("word_count").alias("size"))


@query(_OUT + " SELECT * FROM o_dom WHERE id = 'travel'")
def vw_find(spark, d):
    return _v3(spark, d)["macro_domains"].where("id = 'travel'")


@query(_OUT + " SELECT 'segments' AS tier, count(*) AS n FROM o_seg UNION ALL SELECT 'conversation_concepts', count(*) FROM o_con UNION ALL SELECT 'macro_domains', count(*) FROM o_dom")
def vw_legend_count(spark, d):
    t = _v3(spark, d)
    out = None
    for k in ("segments", "conversation_concepts", "macro_domains"):
        c = t[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("tier"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query(_OUT + " SELECT id, label FROM o_seg UNION ALL SELECT id, label FROM o_con UNION ALL SELECT id, label FROM o_dom")
def vw_nodes_by_id(spark, d):
    t = _v3(spark, d)
    return t["segments"].select("id", "label").unionByName(t["conversation_concepts"].select("id", "label")).unionByName(t["macro_domains"].select("id", "label"))


@query(_OUT + " SELECT a.id, b.id AS sibling FROM o_seg a JOIN o_seg b ON a.chat_id = b.chat_id AND a.id <> b.id")
def jn_same_chat(spark, d):
    """Other segments of the same conversation (a conversation has few)."""
    s = _v3(spark, d)["segments"].select("id", "chat_id")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.chat_id") == F.col("b.chat_id")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("sibling"))


@query(_OUT + " SELECT id, round(0.7 + 0.03 * sqrt(segment_count), 6) AS radius FROM o_dom")
def fn_radius(spark, d):
    return _v3(spark, d)["macro_domains"].select("id", F.round(0.7 + 0.03 * F.sqrt("segment_count"), 6).alias("radius"))
