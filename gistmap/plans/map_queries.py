"""Queries of ingest, text functions and segmentation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.functions import text as X
from gistmap.functions import timestamps
from gistmap.operators import segmentation as S
from gistmap.operators import sources as SRC
from gistmap.operators.turns import SQL, WS, load
from gistmap.runtime import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def q(body: str) -> str:
    return f"WITH {SQL} {body}"


def _re(p: str) -> str:
    return p.replace("'", "''")


# --- ingest -------------------------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', chr(160)), '&#160;', chr(160)), '&#xA0;', chr(160)), '&ndash;', chr(8211)), '&mdash;', chr(8212)), '&#8203;', chr(8203)), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TEXT = "trim(regexp_replace(" + _UNESCAPE.format("regexp_replace(i.html, '<[^>]+>', ' ', 'g')") + f", '{WS}', ' ', 'g'), ' ')"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_E = rf"""
parts AS (SELECT entry_id, list_transform(list_filter(safeHtmlItem, lambda i: trim(regexp_replace(coalesce(i.html, ''), '{WS}', '', 'g')) <> ''), lambda i: {_TEXT}) AS p FROM raw_entries),
urls AS (SELECT entry_id, trim(coalesce(nullif(trim(details[1].url), ''), details[1].name)) AS url FROM raw_entries),
ids AS (SELECT entry_id, nullif(CASE WHEN contains(url, '/app/') THEN trim(split_part(list_last(string_split(url, '/app/')), '?', 1)) ELSE url END, '') AS chat_id FROM urls),
users AS (SELECT entry_id, nullif(regexp_replace(regexp_replace(regexp_replace(title, '^{WS}|{WS}$', '', 'g'), '(?i)^Prompted{WS}', ''), '^{WS}|{WS}$', '', 'g'), '') AS user_text FROM raw_entries),
entries AS (SELECT e.entry_id, e.source_file, e.entry_index, i.chat_id, u.user_text, nullif(list_aggregate(list_filter(p.p, lambda x: x <> ''), 'string_agg', chr(10) || chr(10)), '') AS assistant_text, e.time
  FROM raw_entries e JOIN ids i USING (entry_id) JOIN users u USING (entry_id) JOIN parts p USING (entry_id))
"""


@query("SELECT entry_id, pos, text FROM (SELECT entry_id, unnest(range(len(safeHtmlItem))) AS pos, unnest(list_transform(safeHtmlItem, lambda i: " + _TEXT + ")) AS text FROM raw_entries) WHERE text IS NOT NULL")
def fn_html_to_text(spark, d):
    rows = spread(table(spark, d, "raw_entries").select("entry_id", F.posexplode("safeHtmlItem").alias("pos", "i")))
    return rows.select("entry_id", "pos", X.html_to_text(F.col("i.html")).alias("text")).where("text is not null")


@query(f"WITH {_E.strip()} SELECT entry_id, chat_id FROM ids")
def fn_chat_id(spark, d):
    return table(spark, d, "raw_entries").select("entry_id", X.chat_id(F.col("details")).alias("chat_id"))


@query(f"WITH {_E.strip()} SELECT entry_id, user_text FROM users")
def fn_user_text(spark, d):
    return table(spark, d, "raw_entries").select("entry_id", X.user_text(F.col("title")).alias("user_text"))


def _entries(spark, d) -> DataFrame:
    return SRC.parse_entries(spread(table(spark, d, "raw_entries")))


@query(f"WITH {_E.strip()} SELECT entry_id, assistant_text FROM entries")
def fn_assistant_text(spark, d):
    return _entries(spark, d).select("entry_id", "assistant_text")


def _iso(spark, d) -> DataFrame:
    rows = table(spark, d, "raw_entries").select("entry_id", F.trim("time").alias("t"))
    rows = rows.withColumn("t", F.when(F.col("t").rlike(_ISO), F.col("t")))
    return timestamps.utc_micros(rows, "t", None, None, "micros")


_ISO_SQL = f"SELECT entry_id, CASE WHEN regexp_matches(trim(time), '{_ISO}') THEN epoch_us(try_cast(regexp_replace(trim(time), '(\\.\\d{{6}})\\d+', '\\1') AS TIMESTAMPTZ)) END AS micros FROM raw_entries"


@query(_ISO_SQL)
def fn_parse_ts(spark, d):
    """Instants of ISO stamps (no zone: UTC), in microseconds; anything else null."""
    return _iso(spark, d).select("entry_id", "micros")


@query(f"SELECT entry_id, CASE WHEN micros % 1000000 = 0 THEN strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%fZ') END AS utc FROM ({_ISO_SQL})")
def fn_normalize_ts(spark, d):
    """ISO stamps as UTC text, microseconds only where they are not zero."""
    t = timestamps.utc_text(F.col("micros"))
    return _iso(spark, d).select("entry_id", F.when(F.col("micros") % 1000000 == 0, F.concat(F.substring(t, 1, 19), F.lit("Z"))).otherwise(t).alias("utc"))


_MISSING = "concat_ws(',', CASE WHEN chat_id IS NULL THEN 'chat_id' END, CASE WHEN micros IS NULL THEN 'timestamp' END, CASE WHEN user_text IS NULL THEN 'user_text' END, CASE WHEN assistant_text IS NULL THEN 'assistant_text' END)"
_PARSED = f"WITH {_E.strip()}, ts AS ({_ISO_SQL}), parsed AS (SELECT e.*, t.micros, {_MISSING} AS missing FROM entries e JOIN ts t USING (entry_id))"


def _parsed(spark, d) -> DataFrame:
    e = SRC.with_instants(spread(table(spark, d, "raw_entries")))
    return e


@query(f"{_PARSED} SELECT entry_id, missing FROM parsed WHERE missing <> ''")
def src_entry_parse(spark, d):
    """Entries left out, with everything they lack."""
    return _parsed(spark, d).where("missing <> ''").select("entry_id", "missing")


@query(f"{_PARSED} SELECT entry_id, chat_id, micros, user_text, assistant_text FROM parsed WHERE missing = ''")
def flt_required_fields(spark, d):
    return _parsed(spark, d).where("missing = ''").select("entry_id", "chat_id", "micros", "user_text", "assistant_text")


_CONV = f"""{_PARSED}, ordered AS (SELECT *, row_number() OVER (PARTITION BY source_file, chat_id ORDER BY micros, entry_index, entry_id) - 1 AS k FROM parsed WHERE missing = ''),
conv AS (SELECT source_file, chat_id, 2 * k AS turn_index, 'user' AS role, user_text AS text FROM ordered UNION ALL SELECT source_file, chat_id, 2 * k + 1, 'assistant', assistant_text FROM ordered)"""


@query(f"{_CONV} SELECT * FROM conv")
def agg_build_conversations(spark, d):
    """Turns of the conversations of each export file."""
    return SRC.build_conversations(_parsed(spark, d).where("missing = ''"))


@query(f"{_PARSED} SELECT 'gemini' AS platform, count(DISTINCT CASE WHEN missing = '' THEN source_file || '|' || chat_id END) AS loaded, count(CASE WHEN missing <> '' THEN 1 END) AS skipped FROM parsed")
def agg_ingest_stats(spark, d):
    p = _parsed(spark, d)
    good = F.col("missing") == ""
    return p.select(F.lit("gemini").alias("platform"), "*").groupBy("platform").agg(
        F.countDistinct(F.when(good, F.concat_ws("|", "source_file", "chat_id"))).alias("loaded"), F.count(F.when(~good, 1)).alias("skipped")
    )


@query(f"{_PARSED} SELECT min(micros) AS first_micros, max(micros) AS last_micros FROM parsed WHERE missing = ''")
def agg_date_range(spark, d):
    return _parsed(spark, d).where("missing = ''").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))


@query(f"{_PARSED} SELECT source_file, chat_id, CASE WHEN m % 1000000 = 0 THEN strftime(make_timestamp(m), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(m), '%Y-%m-%dT%H:%M:%S.%fZ') END AS stamp, row_number() OVER (PARTITION BY source_file ORDER BY stamp, chat_id) AS place FROM (SELECT source_file, chat_id, min(micros) AS m FROM parsed WHERE missing = '' GROUP BY ALL)")
def srt_conversations(spark, d):
    """Conversations of a file in the order of their stamp as text."""
    t = timestamps.utc_text(F.col("m"))
    c = _parsed(spark, d).where("missing = ''").groupBy("source_file", "chat_id").agg(F.min("micros").alias("m"))
    c = c.withColumn("stamp", F.when(F.col("m") % 1000000 == 0, F.concat(F.substring(t, 1, 19), F.lit("Z"))).otherwise(t))
    return c.select("source_file", "chat_id", "stamp", F.row_number().over(Window.partitionBy("source_file").orderBy("stamp", "chat_id")).alias("place"))


@query("SELECT chat_id, count(*) AS exports FROM conversations GROUP BY chat_id")
def set_union_files(spark, d):
    """Exports per chat in the concatenation of all files (repeated chats are kept)."""
    return table(spark, d, "conversations").groupBy("chat_id").agg(F.count("*").alias("exports"))


# --- text functions -----------------------------------------------------------------------------

_DOCS = "documents WHERE text IS NOT NULL"


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$\n]+\$', ' ', 'g'), '(^|[^\pL\pN\pM_])([\pL\pN\pM_]+)" + WS[:-1] + r"*=" + WS[:-1] + r"*[^" + WS[1:-2] + r"]+', '\1 ', 'g'), '(^|[^\pL\pN\pM_])--?[A-Za-z][\pL\pN\pM_-]*', '\1 ', 'g') AS stripped FROM " + _DOCS)
def fn_strip_non_discursive(spark, d):
    return spread(table(spark, d, "documents")).where("text is not null").select("doc_id", X.strip_non_discursive(F.col("text")).alias("stripped"))


_T = "(SELECT DISTINCT term FROM terms)"


def _terms(spark, d) -> DataFrame:
    return load(spark, d)["terms"].select("term").distinct()


@query(q(rf"SELECT term, CASE WHEN length(c) >= 2 THEN c ELSE term END AS stripped FROM (SELECT term, regexp_replace(term, '^(?:{'|'.join(X.DETERMINERS)})\s+', '') AS c FROM {_T})"))
def fn_strip_determiner(spark, d):
    return _terms(spark, d).select("term", X.strip_determiner(F.col("term")).alias("stripped"))


@query(q(rf"SELECT term, CASE WHEN lower(term) IN ({', '.join(repr(c) for c in X.COMPOUNDS)}) THEN term WHEN length(c) >= 2 THEN c END AS repaired FROM (SELECT term, trim(regexp_replace(term, '^[-_~+=/]+|[-_~+=/]+$', '', 'g'), ' ') AS c FROM {_T})"))
def fn_repair_boundary(spark, d):
    return _terms(spark, d).select("term", X.repair_boundary(F.col("term")).alias("repaired"))


@query(q(rf"SELECT term FROM {_T} WHERE length(list_last(regexp_split_to_array(trim(term, ' '), '\s+'))) >= 2"))
def flt_fragment_tail(spark, d):
    return _terms(spark, d).where(~X.ends_with_fragment(F.col("term")))


@query(q(rf"SELECT term FROM {_T} WHERE len(string_split(term, ' ')) <= 3"))
def flt_phrase_len(spark, d):
    return _terms(spark, d).where(F.size(F.split("term", " ")) <= 3)


# RE2 knows word boundaries of ASCII only
_RE2 = [p.replace(r"\b(?:am|pm)\b", r"(?:^|[^\pL\pN_])(?:am|pm)(?:$|[^\pL\pN_])").replace(r"kph)\b", r"kph)(?:$|[^\pL\pN_])") for p in X.SPECIFIC]
_SPECIFIC_SQL = "(regexp_matches(term, '" + _re("|".join(f"(?:{p})" for p in _RE2)) + r"') OR length(regexp_replace(term, '\D', '', 'g')) > 0.35 * length(term) OR regexp_matches(term, '^\d+$'))"


@query(q(f"SELECT term, {_SPECIFIC_SQL} AS specific FROM {_T}"))
def flt_is_too_specific(spark, d):
    return _terms(spark, d).select("term", X.is_too_specific(F.col("term")).alias("specific"))


_STOPS = ", ".join(repr(w) for w in sorted(set(X.STOPWORDS) | set(X.MODIFIER_NOUNS)))


@query(q(f"SELECT term FROM {_T} WHERE length(term) >= 2 AND term NOT IN ({_STOPS}) AND NOT {_SPECIFIC_SQL}"))
def flt_is_valid_term(spark, d):
    return _terms(spark, d).where(X.is_valid_term(F.col("term")))


@query(q(rf"SELECT term, regexp_replace(regexp_replace(lower(trim(regexp_replace(term, '{WS}', ' ', 'g'), ' ')), '(?:''s)$|''$', ''), '^(?:the|a|an) ', '') AS normal FROM {_T}"))
def fn_add_count_norm(spark, d):
    return _terms(spark, d).select("term", X.count_norm(F.col("term")).alias("normal"))


@query(q(f"SELECT term, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(term, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'topic') AS slug FROM {_T}"))
def fn_slugify(spark, d):
    return _terms(spark, d).select("term", X.slugify(F.col("term")).alias("slug"))


@query(f"SELECT doc_id, CASE WHEN length(f) > 120 THEN substr(f, 1, 120) || '…' ELSE f END AS snippet FROM (SELECT doc_id, replace(text, chr(10), ' ') AS f FROM {_DOCS})")
def fn_snippet(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.snippet(F.col("text"), 120).alias("snippet"))


@query(q(f"SELECT a.segment_id, a.term AS term_a, b.term AS term_b, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS jaccard FROM (SELECT *, list_filter(regexp_split_to_array(term, '{WS}'), lambda w: w <> '') AS x FROM terms) a JOIN (SELECT *, list_filter(regexp_split_to_array(term, '{WS}'), lambda w: w <> '') AS y FROM terms) b ON a.segment_id = b.segment_id AND a.pos < b.pos"))
def set_jaccard(spark, d):
    """Word overlap of the terms of one segment (a segment holds at most a handful)."""
    t = load(spark, d)["terms"].select("segment_id", "pos", "term")
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.segment_id") == F.col("b.segment_id")) & (F.col("a.pos") < F.col("b.pos"))).select(
        "a.segment_id", F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b"), F.round(X.jaccard(F.col("a.term"), F.col("b.term")), 6).alias("jaccard")
    )


_SING = "CASE WHEN regexp_matches(w, '^.{2,}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:ss|us|is)$') THEN w WHEN regexp_matches(w, '^.{3,}s$') THEN regexp_replace(w, 's$', '') ELSE w END"
_ROOT = f"trim(regexp_replace(array_to_string(list_transform(list_filter(regexp_split_to_array(term, '{WS}'), lambda w: w <> ''), lambda w: {_SING}), ' '), '(?:(?:^| )(?:{'|'.join(X.TRAILING)}))+$', ''), ' ')"


@query(q(f"SELECT term, {_ROOT} AS root FROM {_T}"))
def fn_root_tuple(spark, d):
    return _terms(spark, d).select("term", X.root(F.col("term")).alias("root"))


@query(q(f"SELECT root, arg_min(term, (len(string_split(term, ' ')), length(term), term)) AS term FROM (SELECT term, {_ROOT} AS root FROM {_T}) WHERE root <> '' GROUP BY root"))
def op_collapse_variants(spark, d):
    """One representative of all surface forms with the same root: fewest words, then shortest, then first."""
    t = _terms(spark, d).select("term", X.root(F.col("term")).alias("root")).where("root <> ''")
    return t.groupBy("root").agg(F.min_by("term", F.struct(F.size(F.split("term", " ")), F.length("term"), "term")).alias("term"))


@query()
def fn_split_chunks(spark, d):
    rows = spread(table(spark, d, "documents")).where("text is not null")
    return rows.select("doc_id", F.posexplode(X.split_chunks(384)(F.col("text"))).alias("chunk", "text"))


# --- segmentation -------------------------------------------------------------------------------


@query(q("SELECT chat_id, sum(words) AS word_count FROM turns GROUP BY chat_id"))
def agg_word_count(spark, d):
    return S.word_counts(load(spark, d)["turns"], ["chat_id"])


@query(q(rf"SELECT chat_id, string_agg(t, chr(10) ORDER BY turn_index) AS text FROM (SELECT chat_id, turn_index, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS t FROM turns) WHERE t <> '' GROUP BY chat_id"))
def agg_chat_text(spark, d):
    """Trimmed turn texts in order, one per line; blank ones are left out."""
    t = load(spark, d)["turns"].withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    return t.groupBy("chat_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "text"))), lambda s: s["text"])).alias("text"))


@query(q("SELECT s.segment_id, t.turn_index, t.role FROM segs s JOIN turns t ON t.chat_id = s.chat_id AND t.turn_index >= s.start_turn AND t.turn_index < s.end_turn"))
def jn_range_segment_turns(spark, d):
    """Turns of each segment: an equi-join on the chat with a range condition."""
    t = load(spark, d)
    s, u = t["segments"].alias("s"), t["turns"].alias("t")
    return s.join(u, (F.col("s.chat_id") == F.col("t.chat_id")) & (F.col("t.turn_index") >= F.col("s.start_turn")) & (F.col("t.turn_index") < F.col("s.end_turn"))).select("segment_id", "turn_index", "role")


@query(q("SELECT s.segment_id, string_agg(coalesce(t.text, ''), chr(10) ORDER BY t.turn_index) AS text FROM segs s JOIN turns t ON t.chat_id = s.chat_id AND t.turn_index >= s.start_turn AND t.turn_index < s.end_turn GROUP BY s.segment_id"))
def agg_segment_text(spark, d):
    t = load(spark, d)
    s, u = t["segments"].alias("s"), t["turns"].alias("t")
    j = s.join(u, (F.col("s.chat_id") == F.col("t.chat_id")) & (F.col("t.turn_index") >= F.col("s.start_turn")) & (F.col("t.turn_index") < F.col("s.end_turn")))
    j = j.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", F.coalesce("text", F.lit("")).alias("text")))).alias("a"))
    return j.select("segment_id", F.concat_ws("\n", F.transform("a", lambda x: x["text"])).alias("text"))


@query(q("SELECT chat_id, i, text FROM (SELECT chat_id, row_number() OVER w - 1 AS i, coalesce(text, '') || chr(10) || lead(coalesce(text, '')) OVER w AS text FROM turns WINDOW w AS (PARTITION BY chat_id ORDER BY turn_index)) WHERE text IS NOT NULL"))
def win_sliding_text(spark, d):
    return S.sliding_texts(load(spark, d)["turns"], 2)


@query(q("SELECT chat_id, count(*) AS n_turns, count(*) >= 8 AS segmented FROM turns GROUP BY chat_id"))
def flt_min_turns(spark, d):
    return load(spark, d)["turns"].groupBy("chat_id").agg(F.count("*").alias("n_turns"), (F.count("*") >= 8).alias("segmented"))


@query("SELECT export_id FROM conversations WHERE chat_id IS NOT NULL")
def flt_valid_chat(spark, d):
    return table(spark, d, "conversations").where("chat_id is not null").select("export_id")


_V = """WITH win AS (SELECT vec_id // 20 AS chat_id, vec_id % 20 AS i, embedding::DOUBLE[] AS v FROM embeddings),
traj AS (SELECT a.chat_id, a.i AS b, list_dot_product(a.v, b.v) AS sim FROM win a JOIN win b ON a.chat_id = b.chat_id AND b.i = a.i + 1),
peaks AS (SELECT *, coalesce(max(sim) OVER (PARTITION BY chat_id ORDER BY b ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), sim) AS l, coalesce(max(sim) OVER (PARTITION BY chat_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), sim) AS r FROM traj),
deep AS (SELECT *, l + r - 2 * sim AS depth FROM peaks),
thr AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chat_id) >= 3 THEN avg(depth) OVER (PARTITION BY chat_id) + stddev_pop(depth) OVER (PARTITION BY chat_id) END AS threshold FROM deep),
hard AS (SELECT chat_id, b + 1 AS turn FROM thr WHERE round(depth - threshold, 12) > 0 AND round(depth, 12) > 0 AND sim < 0.4),
first3 AS (SELECT chat_id, k, avg(x) AS x FROM (SELECT chat_id, unnest(v) AS x, unnest(range(len(v))) AS k FROM win WHERE i < 3) GROUP BY ALL),
anchor AS (SELECT chat_id, list(x ORDER BY k) AS a FROM first3 GROUP BY chat_id),
dsim AS (SELECT w.chat_id, w.i, list_dot_product(w.v, a.a) / sqrt(list_dot_product(a.a, a.a)) AS sim FROM win w JOIN anchor a USING (chat_id) WHERE w.chat_id IN (SELECT chat_id FROM win GROUP BY chat_id HAVING count(*) > 3)),
nturn AS (SELECT chat_id, count(*) AS n_turns FROM win GROUP BY chat_id)
"""


def _windows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr("vec_id div 20").alias("chat_id"), (F.col("vec_id") % 20).alias("i"), F.col("embedding").alias("v"))


@query(_V + "SELECT chat_id, b, round(sim, 6) AS sim FROM traj")
def win_trajectory(spark, d):
    return S.trajectory(_windows(spark, d)).withColumn("sim", F.round("sim", 6))


@query(_V + "SELECT chat_id, b, round(sim, 6) AS sim FROM traj")
def jn_adjacent_windows(spark, d):
    """The same similarities by a self-join on neighbouring positions."""
    w = _windows(spark, d)
    nxt = w.select("chat_id", (F.col("i") - 1).alias("i"), F.col("v").alias("u"))
    return w.join(nxt, ["chat_id", "i"]).select("chat_id", F.col("i").alias("b"), F.round(X.dot(F.col("v"), F.col("u")), 6).alias("sim"))


@query(_V + "SELECT chat_id, b, round(l, 6) AS left_peak, round(r, 6) AS right_peak, round(depth, 6) AS depth FROM deep")
def win_local_peaks(spark, d):
    r = S.depths(S.trajectory(_windows(spark, d)))
    return r.select("chat_id", "b", *[F.round(k, 6).alias(k) for k in ("left_peak", "right_peak", "depth")])


@query(_V + "SELECT DISTINCT chat_id, round(threshold, 6) AS threshold FROM thr")
def win_depth_threshold(spark, d):
    return S.thresholds(S.depths(S.trajectory(_windows(spark, d)))).select("chat_id", F.round("threshold", 6).alias("threshold")).distinct()


@query(_V + "SELECT chat_id, turn FROM hard")
def flt_hard_shift(spark, d):
    return S.hard_shifts(_windows(spark, d))


def _drift(tol: float) -> str:
    return f"SELECT chat_id, min(i) - 2 AS turn FROM (SELECT *, min(CASE WHEN sim < {1 - tol!r} THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = 3 AS hit FROM dsim WINDOW w AS (PARTITION BY chat_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE hit GROUP BY chat_id"


@query(_V + f"SELECT 0.15 AS tolerance, * FROM ({_drift(0.15)}) UNION ALL SELECT 0.9, * FROM ({_drift(0.9)})")
def win_drift_run(spark, d):
    w = _windows(spark, d)
    return S.drift_starts(w, 0.15).select(F.lit(0.15).alias("tolerance"), "*").unionByName(S.drift_starts(w, 0.9).select(F.lit(0.9).alias("tolerance"), "*"))


_CUTS = _V + f""", cuts AS (SELECT chat_id, turn, max(bt) AS boundary_type FROM (SELECT *, 'hard_shift' AS bt FROM hard UNION ALL SELECT *, 'drift' FROM ({_drift(0.9)})) GROUP BY ALL),
inner_cuts AS (SELECT c.* FROM cuts c JOIN nturn n USING (chat_id) WHERE turn > 0 AND turn < n_turns),
starts AS (SELECT chat_id, 0 AS start_turn, NULL AS boundary_type FROM nturn UNION ALL SELECT chat_id, turn, boundary_type FROM inner_cuts),
bnd AS (SELECT chat_id, row_number() OVER w - 1 AS seg_index, start_turn, coalesce(lead(start_turn) OVER w, n_turns) AS end_turn, boundary_type FROM starts JOIN nturn USING (chat_id) WINDOW w AS (PARTITION BY chat_id ORDER BY start_turn))"""


def _cuts(spark, d):
    from gistmap.config import Segmentation

    w = _windows(spark, d)
    n = w.groupBy("chat_id").agg(F.count("*").alias("n_turns"))
    return S.boundaries(w, n, Segmentation(drift_tolerance=0.9)), n


@query(_CUTS + "SELECT * FROM inner_cuts")
def flt_boundary_range(spark, d):
    return _cuts(spark, d)[0]


@query(_CUTS + "SELECT * FROM bnd")
def win_segment_bounds(spark, d):
    return S.bounds(*_cuts(spark, d))


@query(_CUTS + "SELECT *, CASE WHEN row_number() OVER (PARTITION BY chat_id ORDER BY word_count DESC, seg_index) = 1 THEN 'core' ELSE 'tangent' END AS label FROM (SELECT chat_id, seg_index, (end_turn - start_turn) * 7 % 11 AS word_count FROM bnd)")
def win_core_label(spark, d):
    b = S.bounds(*_cuts(spark, d))
    return S.core_labels(b.select("chat_id", "seg_index", ((F.col("end_turn") - F.col("start_turn")) * 7 % 11).alias("word_count")))


@query()
def ml_segment_all(spark, d):
    """Segments of all conversations, with hashed text vectors of the windows."""
    from gistmap.operators.embedding import hashed_vector

    return S.segment_turns(load(spark, d)["turns"], hashed_vector)


@query("SELECT label, k, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY ALL")
def agg_mean_pool(spark, d):
    """Component-wise means of the vectors of a group."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return e.groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(q("SELECT n AS segments, count(*) AS chats FROM (SELECT chat_id, count(*) AS n FROM segs GROUP BY chat_id) GROUP BY n"))
def agg_seg_distribution(spark, d):
    s = load(spark, d)["segments"].groupBy("chat_id").agg(F.count("*").alias("segments"))
    return s.groupBy("segments").agg(F.count("*").alias("chats"))


@query(q("SELECT segment_id, label = 'tangent' AS is_tangent FROM segs"))
def prj_is_tangent(spark, d):
    return load(spark, d)["segments"].select("segment_id", (F.col("label") == "tangent").alias("is_tangent"))


@query(q("SELECT boundary_type, label, count(*) AS segments, sum(word_count) AS words FROM segs GROUP BY ALL"))
def snk_report(spark, d):
    """Review figures of the segmentation."""
    return load(spark, d)["segments"].groupBy("boundary_type", "label").agg(F.count("*").alias("segments"), F.sum("word_count").alias("words"))


@query(_CUTS + "SELECT chat_id || '::seg' || seg_index AS segment_id, start_turn, end_turn, end_turn - start_turn AS turn_count, coalesce(boundary_type, 'none') AS boundary_type FROM bnd")
def ml_segment_chat(spark, d):
    """Segments of the pseudo-chats made of embeddings, with ids."""
    b = S.bounds(*_cuts(spark, d))
    return b.select(
        F.concat(F.col("chat_id").cast("string"), F.lit("::seg"), "seg_index").alias("segment_id"), "start_turn", "end_turn",
        (F.col("end_turn") - F.col("start_turn")).alias("turn_count"), F.coalesce("boundary_type", F.lit("none")).alias("boundary_type"),
    )


@query(q("SELECT segment_id FROM segs WHERE label = 'core'"))
def prj_tangent_core(spark, d):
    return load(spark, d)["segments"].where("label = 'core'").select("segment_id")


@query()
def fn_embed_long_text(spark, d):
    """Mean of the chunk vectors of each document, normalised (norm and largest component)."""
    from gistmap.operators.embedding import embed_texts

    chunks = fn_split_chunks(spark, d)
    v = embed_texts(chunks, "text").select("doc_id", F.posexplode("v").alias("k", "x")).groupBy("doc_id", "k").agg(F.avg("x").alias("x"))
    return v.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.max_by("k", F.abs("x")).alias("largest"))


@query()
def fn_embed_window(spark, d):
    """Vectors of the windows of two turns (number of components that are not zero)."""
    from gistmap.operators.embedding import embed_texts

    w = embed_texts(S.sliding_texts(load(spark, d)["turns"], 2), "text")
    return w.select("chat_id", "i", F.size(F.filter("v", lambda x: x != 0)).alias("active"))
