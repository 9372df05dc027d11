"""Queries of keywords, phrases, the co-occurrence graph and concepts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Graph
from gistmap.functions import text as X
from gistmap.operators import graph as G
from gistmap.operators import terms as K
from gistmap.operators.turns import SQL, load
from gistmap.runtime import scratch_table, table, width

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL} {sql}" if not sql.startswith("WITH") else sql
        return f

    return keep


def _t(spark, d) -> DataFrame:
    return load(spark, d)["terms"]


def _ck(spark, d) -> DataFrame:
    return K.chat_keywords(_t(spark, d))


@query("SELECT term, count(DISTINCT segment_id) AS freq FROM terms GROUP BY term")
def agg_global_freq(spark, d):
    return K.frequencies(_t(spark, d), "segment_id", "freq")


@query("SELECT term, count(DISTINCT segment_id) AS segments FROM terms GROUP BY term HAVING count(DISTINCT segment_id) >= 2")
def agg_segment_freq(spark, d):
    return K.frequencies(_t(spark, d), "segment_id", "segments").where("segments >= 2")


@query("SELECT term, count(DISTINCT chat_id) AS chats FROM terms GROUP BY term")
def agg_distinct_chat_seg(spark, d):
    return K.frequencies(_t(spark, d), "chat_id", "chats")


@query("SELECT term, count(DISTINCT chat_id) AS chat_count, count(*) AS count FROM terms GROUP BY term")
def agg_chat_counts(spark, d):
    return _ck(spark, d).groupBy("term").agg(F.count("*").alias("chat_count"), F.sum("count").alias("count"))


@query("SELECT chat_id, term, count(*) AS count FROM terms GROUP BY ALL")
def agg_keyword_count(spark, d):
    return _ck(spark, d)


@query("SELECT term, arg_min_null(entity_label, (segment_id, pos)) AS entity_label FROM terms GROUP BY term")
def agg_entity_label(spark, d):
    return K.first_labels(_t(spark, d))


@query("SELECT segment_id, arg_max(term, (score, -pos)) AS top FROM terms GROUP BY segment_id")
def top1_segment_label(spark, d):
    return K.segment_labels(_t(spark, d))


@query("SELECT s.segment_id, coalesce(t.top, '') AS label FROM segs s LEFT JOIN (SELECT segment_id, arg_max(term, (score, -pos)) AS top FROM terms GROUP BY segment_id) t USING (segment_id)")
def jn_segment_label(spark, d):
    t = load(spark, d)
    return t["segments"].join(K.segment_labels(t["terms"]), "segment_id", "left").select("segment_id", F.coalesce("top", F.lit("")).alias("label"))


@query("SELECT segment_id, term, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, pos) AS place FROM terms")
def srt_keywords_score(spark, d):
    w = Window.partitionBy("segment_id").orderBy(F.desc("score"), "pos")
    return _t(spark, d).select("segment_id", "term", F.row_number().over(w).alias("place"))


@query("SELECT chat_id, term, row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, term) AS place FROM (SELECT chat_id, term, count(*) AS count FROM terms GROUP BY ALL)")
def srt_ranked_hits(spark, d):
    return _ck(spark, d).select("chat_id", "term", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("count"), "term")).alias("place"))


@query("SELECT term, sum(n) AS count FROM (SELECT chat_id, term, count(*) AS n FROM terms GROUP BY ALL) GROUP BY term ORDER BY count DESC, term LIMIT 30")
def topk_keywords_chats(spark, d):
    return _ck(spark, d).groupBy("term").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "term").limit(30)


@query("SELECT term, count(DISTINCT chat_id) AS chat_count FROM terms GROUP BY term ORDER BY chat_count DESC, term LIMIT 20")
def topk_terms_chat_count(spark, d):
    return K.frequencies(_t(spark, d), "chat_id", "chat_count").orderBy(F.desc("chat_count"), "term").limit(20)


@query("SELECT DISTINCT term FROM terms")
def set_distinct_terms(spark, d):
    return _t(spark, d).select("term").distinct()


@query("SELECT count(*) AS segments, count(*) FILTER (WHERE n = 0) AS empty_segments, (SELECT count(DISTINCT term) FROM terms) AS unique_terms FROM (SELECT k.segment_id, count(t.term) AS n FROM kw k LEFT JOIN terms t USING (segment_id) GROUP BY 1)")
def agg_extraction_summary(spark, d):
    t = _t(spark, d)
    ids = table(spark, d, "segment_keywords").select("segment_id").distinct()
    n = ids.join(t.groupBy("segment_id").agg(F.count("*").alias("n")), "segment_id", "left")
    unique = t.agg(F.countDistinct("term").alias("n")).scalar()
    return n.agg(F.count("*").alias("segments"), F.count(F.when(F.col("n").isNull(), 1)).alias("empty_segments"), F.first(unique).alias("unique_terms"))


@query("SELECT segment_id, term, count(*) AS streams, min(entity_label) AS entity_label FROM (SELECT segment_id, term, entity_label FROM terms WHERE entity_label IS NOT NULL UNION ALL SELECT segment_id, term, NULL FROM terms WHERE score >= 0.5) GROUP BY ALL")
def set_candidate_union(spark, d):
    """Entities and high-scored terms as two streams, joined to one row per term with a label that is not null."""
    t = _t(spark, d)
    both = t.where("entity_label is not null").select("segment_id", "term", "entity_label").unionByName(t.where("score >= 0.5").select("segment_id", "term", F.lit(None).cast("string").alias("entity_label")))
    return both.groupBy("segment_id", "term").agg(F.count("*").alias("streams"), F.min("entity_label").alias("entity_label"))


@query("SELECT t.segment_id, t.term FROM terms t WHERE NOT EXISTS (SELECT 1 FROM terms b WHERE b.segment_id = t.segment_id AND b.term <> t.term AND contains(b.term, t.term))")
def jn_substring_anti(spark, d):
    return K.prune_substrings(_t(spark, d)).select("segment_id", "term")


# --- aliases and canonical forms ----------------------------------------------------------------

_ALIAS = "al AS (SELECT a AS source, min(canonical) AS target FROM (SELECT unnest(aliases) AS a, canonical FROM canonical_terms) GROUP BY a)"


def _aliases(spark, d) -> DataFrame:
    return table(spark, d, "canonical_terms").select(F.explode("aliases").alias("source"), F.col("canonical").alias("target")).groupBy("source").agg(F.min("target").alias("target"))


@query(f", {_ALIAS} SELECT t.segment_id, t.pos, coalesce(a.target, t.term) AS term FROM terms t LEFT JOIN al a ON a.source = t.term")
def jn_alias(spark, d):
    return K.apply_map(_t(spark, d), _aliases(spark, d)).select("segment_id", "pos", "term")


@query(f", {_ALIAS} SELECT t.chat_id, coalesce(a.target, t.term) AS term, count(*) AS count FROM terms t LEFT JOIN al a ON a.source = t.term GROUP BY ALL")
def agg_term_alias(spark, d):
    return K.apply_map(_ck(spark, d), _aliases(spark, d)).groupBy("chat_id", "term").agg(F.sum("count").alias("count"))


@query("SELECT DISTINCT term FROM terms WHERE term NOT IN (SELECT canonical FROM canonical_terms)")
def set_unmapped(spark, d):
    return _t(spark, d).select("term").distinct().join(table(spark, d, "canonical_terms").select(F.col("canonical").alias("term")), "term", "left_anti")


_CKSQL = "ck AS (SELECT chat_id, term, count(*) AS count FROM terms GROUP BY ALL)"
_W = "CASE WHEN contains(term, ' ') THEN term WHEN regexp_matches(term, '^.{2,}ies$') THEN regexp_replace(term, 'ies$', 'y') WHEN regexp_matches(term, '(?:ss|us|is)$') THEN term WHEN regexp_matches(term, '^.{3,}s$') THEN regexp_replace(term, 's$', '') ELSE term END"
_MERGED = f"SELECT arg_min(term, ((term <> lemma)::INT, length(term), term)) AS term, sum(count) AS count FROM (SELECT term, count, {_W} AS lemma FROM (SELECT term, sum(count) AS count FROM ck GROUP BY term)) GROUP BY lemma"


def _global(spark, d) -> DataFrame:
    return _ck(spark, d).groupBy("term").agg(F.sum("count").alias("count"))


@query(f", {_CKSQL} {_MERGED}")
def agg_lemma_merge(spark, d):
    return K.merge_lemmas(_global(spark, d), [])


_MODS = ", ".join(repr(w) for w in X.MODIFIER_NOUNS)


@query(f", {_CKSQL} SELECT term, sum(count) AS count FROM ck GROUP BY term HAVING NOT (term IN ({_MODS}) AND sum(count) <= 1)")
def flt_modifier_singletons(spark, d):
    return K.drop_modifier_singletons(_global(spark, d))


@query(f", {_CKSQL} SELECT term FROM ck WHERE term NOT IN ({_MODS}) GROUP BY term")
def flt_skip_modifier_chunk(spark, d):
    return _global(spark, d).where(~F.col("term").isin(X.MODIFIER_NOUNS)).select("term")


@query(f", {_CKSQL} SELECT * FROM ({_MERGED}) WHERE NOT (term IN ({_MODS}) AND count <= 1)")
def ml_condense(spark, d):
    return K.drop_modifier_singletons(K.merge_lemmas(_global(spark, d), []))


_WORDS = "wf AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest(string_split(term, ' ')) AS w FROM terms) WHERE regexp_matches(w, '^[a-z]{3,}$') GROUP BY w)"


def _word_freqs(spark, d) -> DataFrame:
    w = _t(spark, d).select(F.explode(F.split("term", " ")).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    return w.groupBy("word").agg(F.count("*").alias("freq"))


@query(f", {_WORDS} SELECT word FROM wf WHERE freq <= 2")
def flt_low_freq_snap(spark, d):
    return _word_freqs(spark, d).where("freq <= 2").select("word")


_SNAP = f", {_WORDS}, snap AS (SELECT a.word, arg_min(b.word, (-b.freq, b.word)) AS target FROM wf a JOIN wf b ON levenshtein(a.word, b.word) = 1 WHERE a.freq <= 2 AND b.freq >= 8 GROUP BY a.word)"


def _snap(spark, d):
    w = _word_freqs(spark, d)
    return w, K.dictionary_snap(w.where("freq <= 2").select("word"), w.where("freq >= 8"))


@query(f"{_SNAP} SELECT * FROM snap")
def fn_dictionary_snap(spark, d):
    """Rare words one edit away from a frequent one (the corpus is its own dictionary)."""
    return _snap(spark, d)[1]


@query(f"{_SNAP} SELECT coalesce(s.target, w.word) AS word, sum(freq) AS freq FROM wf w LEFT JOIN snap s ON s.word = w.word GROUP BY 1")
def agg_post_dict_freq(spark, d):
    w, s = _snap(spark, d)
    return K.apply_map(w, s.select(F.col("word").alias("source"), "target"), "word").groupBy("word").agg(F.sum("freq").alias("freq"))


_TYPO = f", {_WORDS}, pairs AS (SELECT a.word AS term, b.word AS target, b.freq AS target_freq FROM wf a JOIN wf b ON a.word <> b.word AND a.word[1] = b.word[1] AND b.freq >= 3 * a.freq WHERE jaro_winkler_similarity(a.word, b.word) >= 0.88)"


def _typo_freqs(spark, d) -> DataFrame:
    return _word_freqs(spark, d).select(F.col("word").alias("term"), "freq")


@query(f"{_TYPO} SELECT * FROM pairs")
def jn_typo_theta(spark, d):
    return K.typo_pairs(_typo_freqs(spark, d))


@query(f"{_TYPO} SELECT term, target FROM pairs")
def fn_jaro_winkler(spark, d):
    """Pairs of words that the string similarity takes for the same (the predicate, not the raw score)."""
    return K.typo_pairs(_typo_freqs(spark, d)).select("term", "target")


@query(f"{_TYPO} SELECT term AS source, arg_min(target, (-target_freq, target)) AS target FROM pairs GROUP BY term")
def top1_typo_target(spark, d):
    return K.typo_targets(_typo_freqs(spark, d))


def ml_canonical_map(spark, d):
    """Dictionary snap, new counts, frequency snap, composed: (source, target) of every word that changes."""
    w, s = _snap(spark, d)
    first = s.select(F.col("word").alias("source"), "target")
    again = K.apply_map(w, first, "word").groupBy("word").agg(F.sum("freq").alias("freq"))
    second = K.typo_targets(again.select(F.col("word").alias("term"), "freq"))
    both = K.apply_map(first.withColumnRenamed("target", "word"), second, "word").select("source", F.col("word").alias("target"))
    return both.unionByName(second.join(first.select("source"), "source", "left_anti"))


@query(f", {_ALIAS} SELECT segment_id, chat_id, term, max(score) AS score, min(pos) AS pos, arg_min(entity_label, pos) FILTER (WHERE entity_label IS NOT NULL) AS entity_label FROM (SELECT t.* REPLACE (coalesce(a.target, t.term) AS term) FROM terms t LEFT JOIN al a ON a.source = t.term) GROUP BY segment_id, chat_id, term")
def jn_canonical(spark, d):
    """Terms under their canonical names, one row per segment and name."""
    return K.regroup(K.apply_map(_t(spark, d), _aliases(spark, d)))


@query("SELECT b.term, array_to_string(list_filter(l.al, lambda x: x <> b.term)[1:4], ', ') AS context FROM (SELECT segment_id, term, row_number() OVER (PARTITION BY term ORDER BY score DESC, segment_id, pos) AS k FROM terms) b JOIN (SELECT segment_id, list(term ORDER BY pos) AS al FROM terms GROUP BY segment_id) l USING (segment_id) WHERE b.k = 1")
def win_best_segment_ctx(spark, d):
    return K.best_contexts(_t(spark, d))


# --- co-occurrence graph ------------------------------------------------------------------------

_PMI = f""", {_CKSQL}, kept AS (SELECT term, count(*) AS chat_count FROM ck GROUP BY term HAVING count(*) >= 3),
kk AS (SELECT chat_id, term FROM ck WHERE term IN (SELECT term FROM kept)),
pr AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS cooccurrence FROM kk a JOIN kk b ON a.chat_id = b.chat_id AND a.term < b.term GROUP BY ALL),
wt AS (SELECT *, cooccurrence + pmi_boost AS weight FROM (SELECT *, greatest(0.0, pmi) AS pmi_boost FROM (SELECT pr.*, log2((cooccurrence / n) / ((a.chat_count / n) * (b.chat_count / n))) AS pmi FROM pr JOIN kept a ON a.term = term_a JOIN kept b ON b.term = term_b, (SELECT count(DISTINCT chat_id) AS n FROM ck)))),
bw AS (SELECT term_a AS node, term_b AS other, * FROM wt UNION ALL SELECT term_b, term_a, * FROM wt),
top AS (SELECT DISTINCT term_a, term_b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9) DESC, term_a, term_b) AS k FROM bw) WHERE k <= 40)"""


def _graph(spark, d):
    ck = _ck(spark, d)
    kept = K.kept_terms(ck, Graph().min_chat_count)
    return ck, kept


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("term_a", "term_b", "cooccurrence", *[F.round(c, 6).alias(c) for c in ("pmi", "pmi_boost", "weight")])


@query(f"{_PMI} SELECT * FROM kept")
def flt_min_chat_count(spark, d):
    return _graph(spark, d)[1]


@query(f"{_PMI} SELECT * FROM kk")
def jn_semi_kept(spark, d):
    ck, kept = _graph(spark, d)
    return ck.select("chat_id", "term").join(kept.select("term"), "term", "left_semi").select("chat_id", "term")


@query(f"{_PMI} SELECT chat_id, count(*) AS kept_terms FROM kk GROUP BY chat_id")
def set_intersect_terms(spark, d):
    return jn_semi_kept(spark, d).groupBy("chat_id").agg(F.count("*").alias("kept_terms"))


@query(f"{_PMI} SELECT * FROM pr")
def jn_cooccur_self(spark, d):
    return G.pairs(*_graph(spark, d))


@query(f"{_PMI} SELECT cooccurrence, count(*) AS pairs FROM pr GROUP BY cooccurrence")
def agg_cooccurrence(spark, d):
    return G.pairs(*_graph(spark, d)).groupBy("cooccurrence").agg(F.count("*").alias("pairs"))


@query(f"{_PMI} SELECT term_a, term_b, round(pmi, 6) AS pmi FROM wt")
def fn_pmi(spark, d):
    return _rounded(G.weighted(*_graph(spark, d))).select("term_a", "term_b", "pmi")


@query(f"{_PMI} SELECT term_a, term_b, round(pmi_boost, 6) AS pmi_boost FROM wt")
def fn_pmi_boost(spark, d):
    return _rounded(G.weighted(*_graph(spark, d))).select("term_a", "term_b", "pmi_boost")


@query(f"{_PMI} SELECT term_a, term_b, round(weight, 6) AS weight FROM wt")
def fn_edge_weight(spark, d):
    return _rounded(G.weighted(*_graph(spark, d))).select("term_a", "term_b", "weight")


@query(f"{_PMI} SELECT term_a, term_b, round(pmi, 6) AS pmi FROM wt WHERE cooccurrence >= 3 AND term_a IN (SELECT canonical FROM canonical_terms)")
def agg_pmi_pair(spark, d):
    """PMI of chosen pairs only."""
    e = _rounded(G.weighted(*_graph(spark, d))).where("cooccurrence >= 3").join(table(spark, d, "canonical_terms").select(F.col("canonical").alias("term_a")).distinct(), "term_a", "left_semi")
    return e.select("term_a", "term_b", "pmi")


def _edges(spark, d) -> DataFrame:
    return G.cooccurrence_graph(_ck(spark, d))[1]


@query(f"{_PMI} SELECT * FROM top")
def win_top_edges_per_node(spark, d):
    return _edges(spark, d).select("term_a", "term_b")


@query(f"{_PMI} SELECT term_a, term_b, cooccurrence, round(pmi, 6) AS pmi, round(pmi_boost, 6) AS pmi_boost, round(weight, 6) AS weight FROM wt JOIN top USING (term_a, term_b)")
def gr_cooccurrence(spark, d):
    return _rounded(_edges(spark, d))


@query(f"{_PMI} SELECT term_a, term_b, round(weight, 6) AS weight FROM wt JOIN top USING (term_a, term_b) ORDER BY round(weight, 9) DESC, term_a, term_b LIMIT 10")
def topk_edges(spark, d):
    return _edges(spark, d).orderBy(F.desc(F.round("weight", 9)), "term_a", "term_b").limit(10).select("term_a", "term_b", F.round("weight", 6).alias("weight"))


@query(f"{_PMI} SELECT term_a, term_b, round(weight, 6) AS weight FROM wt JOIN top USING (term_a, term_b) ORDER BY round(weight, 9) DESC, term_a, term_b LIMIT 500")
def topk_frontend_edges(spark, d):
    return _edges(spark, d).orderBy(F.desc(F.round("weight", 9)), "term_a", "term_b").limit(500).select("term_a", "term_b", F.round("weight", 6).alias("weight"))


@query(f"{_PMI} SELECT node, rank, other FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9) DESC, other) AS rank FROM bw JOIN top USING (term_a, term_b)) WHERE rank <= 5")
def topk_neighbors(spark, d):
    return G.neighbours(_edges(spark, d), 5)


@query(f"{_PMI} SELECT term, round(CASE WHEN hi > lo THEN 4 + 18 * (ln(1 + chat_count) - lo) / (hi - lo) ELSE 4 END, 6) AS size FROM kept, (SELECT min(ln(1 + chat_count)) AS lo, max(ln(1 + chat_count)) AS hi FROM kept)")
def fn_marker_size(spark, d):
    n = _graph(spark, d)[1]
    x = F.log1p("chat_count")
    r = n.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    j = n.join(F.broadcast(r))
    return j.select("term", F.round(F.when(F.col("hi") > F.col("lo"), 4 + 18 * (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(4.0), 6).alias("size"))


@query(f"{_PMI} SELECT term_a, term_b, round(CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 0.5 END, 6) AS strength FROM wt, (SELECT min(weight) AS lo, max(weight) AS hi FROM wt)")
def fn_edge_style(spark, d):
    """Weights scaled to 0..1 over all edges (0.5 where there is no spread)."""
    e = G.weighted(*_graph(spark, d))
    r = e.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    j = e.join(F.broadcast(r))
    return j.select("term_a", "term_b", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5), 6).alias("strength"))


# --- phrases ------------------------------------------------------------------------------------

STOP = sorted(set(X.STOPWORDS) | set(X.MODIFIER_NOUNS) | set("the a an and or of to in is are it for with on as at by be can if not but from about there would should have has its more most only so than den der die das und ist es la el de que en los las un una le les des et du".split()))
_TOK = f"""WITH {SQL}, tk AS (SELECT chat_id, turn_index, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT chat_id, turn_index, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS w FROM turns WHERE text IS NOT NULL)),
toks AS (SELECT * FROM tk WHERE length(token) >= 2 AND token NOT IN ({", ".join(repr(w) for w in STOP)})),
bg AS (SELECT b.chat_id, b.turn_index, b.pos, a.token AS prev, b.token FROM toks a JOIN toks b ON a.chat_id = b.chat_id AND a.turn_index = b.turn_index AND b.pos = a.pos + 1),
un AS (SELECT token, count(*) AS c FROM toks GROUP BY token), pc AS (SELECT prev AS a, token AS b, count(*) AS n FROM bg GROUP BY ALL),
sc AS (SELECT a, b, n, CASE WHEN n / t >= 1 THEN 1.0 ELSE log2((n / t) / ((x.c / t) * (y.c / t))) / -log2(n / t) END AS npmi FROM pc JOIN un x ON x.token = a JOIN un y ON y.token = b, (SELECT count(*) AS t FROM toks))"""


def _toks(spark, d) -> DataFrame:
    return K.tokens(load(spark, d)["turns"].dropDuplicates(["chat_id", "turn_index"]), STOP)


@query(f"{_TOK} SELECT prev, token, count(*) AS n FROM bg GROUP BY ALL")
def win_lag_bigram(spark, d):
    return K.bigrams(_toks(spark, d)).groupBy("prev", "token").agg(F.count("*").alias("n"))


@query(f"{_TOK} SELECT a AS token, '' AS nxt, c AS n FROM (SELECT token AS a, c FROM un) UNION ALL SELECT a, b, n FROM pc")
def agg_unigram_bigram(spark, d):
    t = _toks(spark, d)
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", F.lit("").alias("nxt"), "n").unionByName(K.bigrams(t).groupBy(F.col("prev").alias("token"), F.col("token").alias("nxt")).agg(F.count("*").alias("n")))


@query(f"{_TOK} SELECT a, b, n, round(npmi, 6) AS npmi FROM sc")
def fn_npmi(spark, d):
    return K.scored_bigrams(_toks(spark, d)).withColumn("npmi", F.round("npmi", 6))


@query(f"{_TOK} SELECT a || ' ' || b AS phrase, n AS count FROM sc WHERE n >= 5 AND round(npmi, 9) >= 0.55")
def flt_min_npmi(spark, d):
    """Pairs accepted as phrases in the first pass."""
    return K.scored_bigrams(_toks(spark, d)).where((F.col("n") >= 5) & (F.round("npmi", 9) >= 0.55)).select(F.concat_ws(" ", "a", "b").alias("phrase"), F.col("n").alias("count"))


@query(f"{_TOK} SELECT a, b, n FROM sc WHERE n >= 5")
def flt_min_pair(spark, d):
    return K.scored_bigrams(_toks(spark, d)).where("n >= 5").select("a", "b", "n")


@query(f"{_TOK} SELECT a || ' ' || b AS phrase FROM sc WHERE n >= 5 AND len(string_split(a || ' ' || b, ' ')) <= 3")
def flt_max_words(spark, d):
    p = K.scored_bigrams(_toks(spark, d)).where("n >= 5").select(F.concat_ws(" ", "a", "b").alias("phrase"))
    return p.where(F.size(F.split("phrase", " ")) <= 3)


_PH = "ph AS (SELECT term AS phrase, count(*) AS count FROM terms GROUP BY term)"
_KEPTPH = "SELECT p.phrase, p.count FROM ph p WHERE NOT EXISTS (SELECT 1 FROM ph l WHERE l.phrase <> p.phrase AND contains(' ' || l.phrase || ' ', ' ' || p.phrase || ' ') AND l.count >= 0.85 * p.count)"


def _phrases(spark, d) -> DataFrame:
    return _t(spark, d).groupBy(F.col("term").alias("phrase")).agg(F.count("*").alias("count"))


@query(f", {_PH} {_KEPTPH}")
def jn_subsequence_anti(spark, d):
    return K.prune_redundant(_phrases(spark, d))


@query(f", {_PH} SELECT phrase, count, row_number() OVER (ORDER BY count DESC, phrase) AS place FROM ({_KEPTPH}) ORDER BY place LIMIT 100")
def srt_phrases(spark, d):
    p = K.prune_redundant(_phrases(spark, d)).orderBy(F.desc("count"), "phrase").limit(100)
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "phrase")))


@query(f", {_PH} SELECT len(string_split(phrase, ' ')) AS words, count(*) AS phrases FROM ph GROUP BY words")
def agg_phrase_by_len(spark, d):
    return _phrases(spark, d).groupBy(F.size(F.split("phrase", " ")).alias("words")).agg(F.count("*").alias("phrases"))


@query(f", {_PH} SELECT phrase, string_split(phrase, ' ') AS words FROM ph WHERE contains(phrase, ' ')")
def src_phrase_lookup(spark, d):
    return _phrases(spark, d).where(F.col("phrase").contains(" ")).select("phrase", F.split("phrase", " ").alias("words"))


@query()
def ml_phrases(spark, d):
    return K.detect_phrases(load(spark, d)["turns"].dropDuplicates(["chat_id", "turn_index"]), STOP).select("phrase", "count", F.round("npmi", 4).alias("npmi"))


# --- concepts -----------------------------------------------------------------------------------

# concept of a term: its last word; supertopic of a concept: its first letter
_CON = "cn AS (SELECT term, list_last(string_split(term, ' ')) AS concept FROM terms GROUP BY term)"


def _concepts(spark, d) -> DataFrame:
    return _t(spark, d).select("term").distinct().select("term", F.element_at(F.split("term", " "), -1).alias("concept"))


@query(f", {_CON} SELECT t.segment_id, t.pos, coalesce(c.concept, t.term) AS concept FROM terms t LEFT JOIN cn c ON c.term = t.term AND length(c.concept) > 6")
def jn_term_concept(spark, d):
    m = _concepts(spark, d).where(F.length("concept") > 6).select(F.col("term").alias("source"), F.col("concept").alias("target"))
    return K.apply_map(_t(spark, d), m).select("segment_id", "pos", F.col("term").alias("concept"))


@query(f", {_CON} SELECT segment_id, concept, max(score) AS score FROM terms JOIN cn USING (term) GROUP BY ALL")
def agg_segment_concepts(spark, d):
    return _t(spark, d).join(_concepts(spark, d), "term").groupBy("segment_id", "concept").agg(F.max("score").alias("score"))


@query(f", {_CON} SELECT chat_id, concept, count(*) AS count, row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, concept) AS place FROM terms JOIN cn USING (term) GROUP BY chat_id, concept")
def agg_chat_concepts(spark, d):
    c = _ck(spark, d).join(_concepts(spark, d), "term").groupBy("chat_id", "concept").agg(F.sum("count").alias("count"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("count"), "concept")))


@query(f", {_CON} SELECT concept, count(DISTINCT chat_id) AS chats FROM terms JOIN cn USING (term) GROUP BY concept")
def agg_concept_chat_counts(spark, d):
    return _ck(spark, d).join(_concepts(spark, d), "term").select("concept", "chat_id").distinct().groupBy("concept").agg(F.count("*").alias("chats"))


@query(f", {_CON} SELECT concept, arg_max(term, (n, term)) AS label FROM cn JOIN (SELECT term, count(DISTINCT chat_id) AS n FROM terms GROUP BY term) USING (term) GROUP BY concept")
def top1_concept_label_freq(spark, d):
    c = _concepts(spark, d).join(K.frequencies(_t(spark, d), "chat_id", "n"), "term")
    return c.groupBy("concept").agg(F.max_by("term", F.struct("n", "term")).alias("label"))


_MEM = f""", {_CON}, mem AS (SELECT concept, term, max(score) AS centrality, count(DISTINCT segment_id) AS segment_freq, arg_min_null(entity_label, (segment_id, pos)) AS entity_label FROM terms JOIN cn USING (term) GROUP BY ALL),
rk AS (SELECT concept, term, segment_freq, row_number() OVER (PARTITION BY concept ORDER BY (segment_freq >= 2)::INT DESC, round(centrality * ln((s + 1) / (segment_freq + 1)) * CASE WHEN entity_label IN ('WORK_OF_ART', 'PERSON', 'ORG', 'GPE') THEN 1.3 ELSE 1.0 END, 9) DESC, term) AS k FROM mem, (SELECT count(DISTINCT segment_id) AS s FROM terms))"""


def _members(spark, d) -> DataFrame:
    t = _t(spark, d)
    m = t.groupBy("term").agg(F.max("score").alias("centrality"), F.countDistinct("segment_id").alias("segment_freq")).join(K.first_labels(t), "term")
    return m.join(_concepts(spark, d), "term")


@query(f"{_MEM.replace('GROUP BY ALL)', 'GROUP BY concept, term)')} SELECT concept, term AS label FROM rk WHERE k = 1")
def top1_specificity(spark, d):
    total = _t(spark, d).agg(F.countDistinct("segment_id").alias("n")).scalar()
    m = _members(spark, d).withColumn("total", total)
    return K.specific_labels(m, F.col("total"))


@query(f"{_MEM.replace('GROUP BY ALL)', 'GROUP BY concept, term)')} SELECT concept, term FROM (SELECT *, max((segment_freq >= 2)::INT) OVER (PARTITION BY concept) AS any_fit FROM mem) WHERE segment_freq >= 2 OR any_fit = 0")
def flt_label_eligible(spark, d):
    m = _members(spark, d).withColumn("any_fit", F.max((F.col("segment_freq") >= 2).cast("int")).over(Window.partitionBy("concept")))
    return m.where("segment_freq >= 2 or any_fit = 0").select("concept", "term")


@query(f", {_CON} SELECT count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 1) AS grouped, max(n) AS largest FROM (SELECT concept, count(*) AS n FROM cn GROUP BY concept)")
def agg_cluster_summary(spark, d):
    n = _concepts(spark, d).groupBy("concept").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("grouped"), F.max("n").alias("largest"))


@query(f", {_CON} SELECT concept, count(DISTINCT chat_id) AS chats FROM terms JOIN cn USING (term) GROUP BY concept ORDER BY chats DESC, concept LIMIT 25")
def topk_concepts(spark, d):
    return agg_concept_chat_counts(spark, d).orderBy(F.desc("chats"), "concept").limit(25)


@query(f", {_CON} SELECT substr(concept, 1, 1) AS supertopic, count(DISTINCT chat_id) AS chats FROM terms JOIN cn USING (term) GROUP BY 1")
def agg_supertopic_chats(spark, d):
    c = _ck(spark, d).join(_concepts(spark, d), "term")
    return c.select(F.substring("concept", 1, 1).alias("supertopic"), "chat_id").distinct().groupBy("supertopic").agg(F.count("*").alias("chats"))


@query(f", {_CON} SELECT substr(concept, 1, 1) AS supertopic, count(DISTINCT concept) AS members, sum(chats) AS chat_count FROM (SELECT concept, count(DISTINCT chat_id) AS chats FROM terms JOIN cn USING (term) GROUP BY concept) GROUP BY 1 ORDER BY chat_count DESC, supertopic LIMIT 40")
def topk_supertopics(spark, d):
    c = agg_concept_chat_counts(spark, d).groupBy(F.substring("concept", 1, 1).alias("supertopic")).agg(F.count("*").alias("members"), F.sum("chats").alias("chat_count"))
    return c.orderBy(F.desc("chat_count"), "supertopic").limit(40)


_SUPER = f"{_PMI}, se AS (SELECT least(a, b) AS super_a, greatest(a, b) AS super_b, weight FROM (SELECT substr(list_last(string_split(term_a, ' ')), 1, 1) AS a, substr(list_last(string_split(term_b, ' ')), 1, 1) AS b, weight FROM wt JOIN top USING (term_a, term_b)) WHERE a <> b)"


def _super_edges(spark, d) -> DataFrame:
    m = _concepts(spark, d).select("term", F.substring("concept", 1, 1).alias("s"))
    e = _edges(spark, d).join(m.select(F.col("term").alias("term_a"), F.col("s").alias("a")), "term_a").join(m.select(F.col("term").alias("term_b"), F.col("s").alias("b")), "term_b")
    return e.where("a <> b").select(F.least("a", "b").alias("super_a"), F.greatest("a", "b").alias("super_b"), "weight")


@query(f"{_SUPER} SELECT super_a, super_b, count(*) AS edges FROM se GROUP BY ALL")
def jn_superedges(spark, d):
    return _super_edges(spark, d).groupBy("super_a", "super_b").agg(F.count("*").alias("edges"))


@query(f"{_SUPER} SELECT super_a, super_b, round(sum(weight), 4) AS weight FROM se GROUP BY ALL")
def agg_superedge(spark, d):
    return _super_edges(spark, d).groupBy("super_a", "super_b").agg(F.round(F.sum("weight"), 4).alias("weight"))


# --- platforms and heights ----------------------------------------------------------------------

_PLAT = "pl AS (SELECT chat_id, arg_max(lower(trim(platform)), export_id) AS platform FROM conversations WHERE chat_id IS NOT NULL AND platform IS NOT NULL GROUP BY chat_id)"


def _platforms(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").where("chat_id is not null and platform is not null")
    return c.groupBy("chat_id").agg(F.max_by(F.lower(F.trim("platform")), "export_id").alias("platform"))


@query(f", {_PLAT} SELECT DISTINCT term, platform FROM terms JOIN pl USING (chat_id)")
def jn_term_platforms(spark, d):
    return _t(spark, d).join(_platforms(spark, d), "chat_id").select("term", "platform").distinct()


@query(f", {_PLAT}, {_CON} SELECT concept, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM terms JOIN cn USING (term) JOIN pl USING (chat_id) GROUP BY concept")
def set_platform_union(spark, d):
    j = _t(spark, d).join(_concepts(spark, d), "term").join(_platforms(spark, d), "chat_id")
    return j.groupBy("concept").agg(F.concat_ws(",", F.array_sort(F.collect_set("platform"))).alias("platforms"))


@query(f", {_PLAT} SELECT s.segment_id, coalesce(p.platform, 'unknown') AS platform FROM segs s LEFT JOIN pl p USING (chat_id)")
def jn_platform(spark, d):
    return load(spark, d)["segments"].join(_platforms(spark, d), "chat_id", "left").select("segment_id", F.coalesce("platform", F.lit("unknown")).alias("platform"))


_HR = f", {_CKSQL}, cw AS (SELECT chat_id, sum(words) AS w FROM turns GROUP BY chat_id), hr AS (SELECT term, count(*) AS freq, sum(coalesce(w, 0)) AS depth, max(coalesce(w, 0)) AS focus FROM ck LEFT JOIN cw USING (chat_id) GROUP BY term)"


def _heights(spark, d) -> DataFrame:
    from gistmap.operators.segmentation import word_counts

    t = load(spark, d)
    w = word_counts(t["turns"], ["chat_id"])
    j = K.chat_keywords(t["terms"]).join(w, "chat_id", "left").withColumn("w", F.coalesce("word_count", F.lit(0)))
    return j.groupBy("term").agg(F.count("*").alias("freq"), F.sum("w").alias("depth"), F.max("w").alias("focus"))


@query(f"{_HR} SELECT ck.chat_id, ck.term, coalesce(w, 0) AS word_count FROM ck LEFT JOIN cw USING (chat_id)")
def jn_term_chat_words(spark, d):
    from gistmap.operators.segmentation import word_counts

    t = load(spark, d)
    return K.chat_keywords(t["terms"]).join(word_counts(t["turns"], ["chat_id"]), "chat_id", "left").select("chat_id", "term", F.coalesce("word_count", F.lit(0)).alias("word_count"))


@query(f"{_HR} SELECT * FROM hr")
def agg_height_raw(spark, d):
    return _heights(spark, d)


_SC = "CASE WHEN {h} > {l} THEN (ln(1 + {c}) - {l}) / ({h} - {l}) ELSE 0 END"
_H2 = f"""{_HR}, rg AS (SELECT min(ln(1 + freq)) AS f0, max(ln(1 + freq)) AS f1, min(ln(1 + depth)) AS d0, max(ln(1 + depth)) AS d1, min(ln(1 + focus)) AS u0, max(ln(1 + focus)) AS u1 FROM hr),
h2 AS (SELECT term, 50 * (0.4 * {_SC.format(h='f1', l='f0', c='freq')} + 0.3 * {_SC.format(h='d1', l='d0', c='depth')} + 0.3 * {_SC.format(h='u1', l='u0', c='focus')}) AS z FROM hr, rg)"""


def _scaled_heights(spark, d) -> DataFrame:
    from gistmap.operators.layout import weighted_heights

    return weighted_heights(_heights(spark, d), {"freq": 0.4, "depth": 0.3, "focus": 0.3})


@query(f"{_H2} SELECT term, round(z, 6) AS z FROM h2")
def fn_height_v2(spark, d):
    return _scaled_heights(spark, d).select("term", F.round("z", 6).alias("z"))


@query(f"{_H2} SELECT term, round(z, 6) AS z FROM h2 ORDER BY round(z, 6) DESC, term LIMIT 15")
def topk_heights(spark, d):
    return fn_height_v2(spark, d).orderBy(F.desc("z"), "term").limit(15)


# --- extraction ---------------------------------------------------------------------------------


def _segment_texts(spark, d) -> DataFrame:
    from gistmap.plans.map_queries import agg_segment_text

    return agg_segment_text(spark, d).repartition(width(spark), "segment_id")


@query()
def ml_candidates(spark, d):
    return K.candidates(_segment_texts(spark, d))


def _ranked(spark, d, prune: bool = False) -> DataFrame:
    # candidates read the written texts, which have no partitioning: a union of two parts shuffled alike may fail when one is coalesced
    texts = scratch_table(_segment_texts(spark, d), "segment_texts")
    return K.rank_texts(texts.repartition(width(spark), "segment_id"), K.candidates(texts), prune=prune)


@query()
def ml_rank(spark, d):
    """Keywords of every segment: candidates, diverse choice, contained terms dropped, by score."""
    return _ranked(spark, d, prune=True).select("segment_id", "pos", "term", F.round("score", 6).alias("score"))


@query()
def ml_mmr(spark, d):
    return _ranked(spark, d).select("segment_id", "pos", "term", F.round("score", 6).alias("score"))


@query()
def smp_seeded(spark, d):
    """Ten segments for review, chosen by seeded hash."""
    return load(spark, d)["segments"].select("segment_id").orderBy(F.xxhash64("segment_id", F.lit(42)), "segment_id").limit(10)




@query()
def fn_embed_terms(spark, d):
    """Each distinct term encoded once (number of components that are not zero)."""
    from gistmap.operators.embedding import embed_texts

    v = embed_texts(_t(spark, d).select("term").distinct(), "term")
    return v.select("term", F.size(F.filter("v", lambda x: x != 0)).alias("active"))


@query()
def fn_merge_sequence(spark, d):
    """Turns after the first merge pass: how many tokens are merged pairs."""
    toks = _toks(spark, d)
    ok = K.listed(K.scored_bigrams(toks).where((F.col("n") >= 5) & (F.col("npmi") >= 0.55)).select("a", "b"))
    accepted = spark.sparkContext.broadcast({(r[0], r[1]) for r in ok})
    seq = toks.groupBy("chat_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    merged = seq.withColumn("s", K._merger(accepted)("s"))
    return merged.select("chat_id", "turn_index", F.size("s").alias("tokens"), F.size(F.filter("s", lambda x: x["token"].contains(" "))).alias("merged"))


@query()
def fn_segment_with_phrases(spark, d):
    """Turns with runs of words replaced by known phrases, longest first."""
    phrases = [r[0] for r in K.listed(ml_phrases(spark, d).select("phrase"))]
    toks = _toks(spark, d)
    seq = toks.groupBy("chat_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return seq.select("chat_id", "turn_index", K.phrase_segmenter(spark.sparkContext.broadcast(frozenset(phrases)))("s").alias("units"))


@query(f"{_TOK} SELECT DISTINCT token, {_W.replace('term', 'token')} AS lemma FROM toks")
def fn_normalize_lemma(spark, d):
    """Rule-based lemmas of the content words."""
    return _toks(spark, d).select("token", X.singular(F.col("token")).alias("lemma")).distinct()


@query("SELECT DISTINCT term, array_to_string(list_transform(string_split(regexp_replace(term, '^(?:the|a|an) ', ''), ' '), lambda w: CASE WHEN regexp_matches(w, '^.{2,}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:ss|us|is)$') THEN w WHEN regexp_matches(w, '^.{3,}s$') THEN regexp_replace(w, 's$', '') ELSE w END), ' ') AS phrase FROM terms")
def fn_normalize_phrase(spark, d):
    """Terms without a leading article, every word as its lemma."""
    t = _t(spark, d).select("term").distinct()
    return t.select("term", F.array_join(F.transform(F.split(F.regexp_replace("term", "^(?:the|a|an) ", ""), " "), X.singular), " ").alias("phrase"))


@query(f"SELECT DISTINCT term, w AS noun FROM (SELECT term, unnest(string_split(term, ' ')) AS w FROM terms) WHERE w NOT IN ({', '.join(repr(w) for w in STOP)}) AND length(w) >= 2")
def fn_content_nouns(spark, d):
    t = _t(spark, d).select("term", F.explode(F.split("term", " ")).alias("noun"))
    return t.where(~F.col("noun").isin(STOP) & (F.length("noun") >= 2)).distinct()


@query()
def ml_extract_keywords(spark, d):
    """Word-level keywords of every chat: content words and phrases, condensed and ranked."""
    toks = _toks(spark, d).select("chat_id", F.col("token").alias("term"))
    c = toks.groupBy("chat_id", "term").agg(F.count("*").alias("count"))
    c = K.drop_modifier_singletons(K.merge_lemmas(c, ["chat_id"]))
    w = Window.partitionBy("chat_id").orderBy(F.desc("count"), "term")
    return c.withColumn("place", F.row_number().over(w)).select("chat_id", "place", "term", "count")


@query()
def ml_extract_corpus(spark, d):
    """Keywords of all segments under corpus-wide canonical names."""
    m = ml_canonical_map(spark, d)
    ranked = ml_rank(spark, d)
    return K.apply_map(ranked, m).groupBy("segment_id", "term").agg(F.max("score").alias("score"))
