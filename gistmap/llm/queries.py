"""Queries of the training-data operators: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmap.llm import canonical, conversations, density, markup, packing, pairs, pii, termfreq, tokenizer
from gistmap.runtime import table


def p1_found(spark, d):
    return pairs.found_defects(table(spark, d, "raw_entries"), table(spark, d, "conversations"))


def p2_found(spark, d):
    return canonical.found_terms(table(spark, d, "segment_keywords"), table(spark, d, "canonical_terms"))


def p3_found(spark, d):
    return markup.found_kinds(table(spark, d, "raw_entries"), table(spark, d, "conversations"))


def p3_clean(spark, d):
    """Clean text of every html item and turn."""
    rows = markup.cleaned(markup.source_texts(table(spark, d, "raw_entries"), table(spark, d, "conversations")))
    return rows.select("origin", "record_key", "item", "clean").distinct()


def p5_found(spark, d):
    return conversations.dropped_chats(table(spark, d, "chat_messages"))


def p5_turns(spark, d):
    """Turns of the usable conversations, numbered from 0, with uniform roles."""
    return conversations.rebuilt_turns(table(spark, d, "chat_messages"))


def p6_found(spark, d):
    return termfreq.marked_terms(table(spark, d, "segment_keywords")).where("mark is not null").select("term", "mark")


def p6_terms(spark, d):
    """Occurrences, chats and mark of every distinct term."""
    return termfreq.marked_terms(table(spark, d, "segment_keywords"))


def p7_found(spark, d):
    return density.sealed_groups(density.density_peaks(table(spark, d, "segment_embeddings")))


def p7_clusters(spark, d):
    """Clusters of segments with size and most typical members."""
    return density.clusters(density.density_peaks(table(spark, d, "segment_embeddings"))).select("first_segment_id", "size", F.concat_ws(" ", "typical").alias("typical"))


def p8_ids(spark, d):
    return tokenizer.encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def p8_roundtrip(spark, d):
    """Texts decoded from their ids (null and empty texts come back empty)."""
    return tokenizer.decode_ids(p8_ids(spark, d))


def p9_windows(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p9_report(spark, d):
    """Windows used against the least possible number."""
    return packing.packing_report(p9_windows(spark, d), table(spark, d, "context_windows"))


def p10_found(spark, d):
    return pii.found_spans(table(spark, d, "documents"), table(spark, d, "given_names"))


def p10_redacted(spark, d):
    """Documents with placeholders for personal information."""
    return pii.redacted_texts(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "given_names"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_clean, p5_found, p5_turns, p6_found, p6_terms, p7_found, p7_clusters, p8_ids, p8_roundtrip, p9_windows, p9_report, p10_found, p10_redacted)}

_P6 = """
WITH one AS (SELECT segment_id, min(struct_pack(chat_id := chat_id, keywords := keywords)) AS r FROM segment_keywords GROUP BY segment_id),
terms AS (SELECT r.chat_id AS chat_id, lower(trim(k.term, ' ')) AS term FROM one, unnest(r.keywords) AS u(k)),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT chat_id) AS records FROM terms WHERE term <> '' GROUP BY term),
total AS (SELECT count(DISTINCT chat_id) AS n FROM segment_keywords)
SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > n THEN 'common' END AS mark FROM counted, total
"""

_P5_PLACED = r"""
WITH raw AS (
  SELECT chat_id, turn_index, text, sent_at, first(message_id ORDER BY arrived_at NULLS FIRST, message_id) AS message_id,
    CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'model', 'ai') THEN 'assistant' WHEN r = 'system' THEN 'system' ELSE '?' || coalesce(role, '') END AS role
  FROM (SELECT *, lower(regexp_replace(role, '\s', '', 'g')) AS r FROM chat_messages) WHERE chat_id IS NOT NULL GROUP BY ALL),
known AS (SELECT * FROM raw WHERE turn_index IS NOT NULL),
span AS (SELECT chat_id, min(turn_index) AS lo FROM known GROUP BY chat_id),
asks AS (SELECT l.*, (SELECT max(k.turn_index) FROM known k WHERE k.chat_id = l.chat_id AND k.sent_at <= l.sent_at) AS prev FROM raw l WHERE l.turn_index IS NULL),
placed AS (
  SELECT chat_id, turn_index, text, role, message_id FROM known
  UNION ALL
  SELECT a.chat_id, CASE WHEN prev IS NOT NULL THEN prev + row_number() OVER (PARTITION BY a.chat_id, prev ORDER BY a.sent_at, a.message_id)
    ELSE coalesce(s.lo, count(*) OVER (PARTITION BY a.chat_id, prev)) - row_number() OVER (PARTITION BY a.chat_id, prev ORDER BY a.sent_at DESC, a.message_id DESC) END, text, role, message_id
  FROM asks a LEFT JOIN span s ON s.chat_id = a.chat_id),
said AS (SELECT *, coalesce(regexp_replace(text, '[\s\x{00A0}]', '', 'g'), '') <> '' AS spoken FROM placed),
facts AS (SELECT chat_id, bool_or(spoken) AS texts, count(*) AS n, count(DISTINCT turn_index) AS places, max(turn_index) - min(turn_index) + 1 AS span, bool_or(role LIKE '?%') AS odd FROM said GROUP BY chat_id),
steps AS (SELECT chat_id, turn_index, role, lead(role) OVER w AS nxt, row_number() OVER w AS k FROM said WHERE spoken AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY chat_id ORDER BY turn_index)),
talk AS (SELECT chat_id, bool_or(k = 1 AND role = 'assistant') AS early, bool_or(role = 'user' AND coalesce(nxt, 'user') = 'user') AS waits FROM steps GROUP BY chat_id)
"""

ORACLES = {
    "p6_terms": _P6,
    "p6_found": f"SELECT term, mark FROM ({_P6}) WHERE mark IS NOT NULL",
    "p5_found": _P5_PLACED
    + """SELECT * FROM (SELECT f.chat_id, CASE WHEN NOT texts THEN 'empty' WHEN n > places OR places <> span OR odd OR coalesce(early, false) THEN 'broken' WHEN waits THEN 'missing_reply' END AS reason
FROM facts f LEFT JOIN talk t ON t.chat_id = f.chat_id) WHERE reason IS NOT NULL""",
    "p5_turns": _P5_PLACED
    + """SELECT s.chat_id, s.turn_index - f.lo AS turn_index, s.role, s.text, s.message_id
FROM said s JOIN (SELECT f.chat_id, (SELECT min(turn_index) FROM said x WHERE x.chat_id = f.chat_id) AS lo FROM facts f LEFT JOIN talk t ON t.chat_id = f.chat_id
  WHERE texts AND NOT (n > places OR places <> span OR odd OR coalesce(early, false)) AND NOT coalesce(waits, false)) f ON f.chat_id = s.chat_id""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_clusters": """
WITH RECURSIVE u AS (SELECT segment_id, min(embedding)::DOUBLE[] AS e FROM segment_embeddings WHERE len(embedding) = 128 GROUP BY segment_id),
v AS (SELECT segment_id, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))::FLOAT) AS e FROM u WHERE list_dot_product(e, e) > 0),
r AS (SELECT e, min(segment_id) AS rep, count(*) AS weight FROM v GROUP BY e),
s AS (SELECT a.rep AS a, b.rep AS b, b.weight AS w, CASE WHEN a.rep = b.rep THEN 1.0 ELSE list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) END AS c FROM r a JOIN r b ON a.rep = b.rep OR list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.70),
dn AS (SELECT a AS rep, sum(w) FILTER (WHERE c >= 0.75) AS dense FROM s GROUP BY a),
up AS (SELECT a AS rep, b AS parent FROM (SELECT s.a, s.b, row_number() OVER (PARTITION BY s.a ORDER BY round(s.c, 4) DESC, y.dense DESC, s.b) AS k FROM s JOIN dn x ON x.rep = s.a JOIN dn y ON y.rep = s.b WHERE y.dense > x.dense OR (y.dense = x.dense AND s.b < s.a)) WHERE k = 1),
walk(rep, here) AS (SELECT rep, rep FROM r UNION ALL SELECT w.rep, up.parent FROM walk w JOIN up ON up.rep = w.here),
top AS (SELECT w.rep, w.here AS peak FROM walk w WHERE w.here NOT IN (SELECT rep FROM up)),
lab AS (SELECT v.segment_id, t.peak, d.dense FROM v JOIN r ON r.e = v.e JOIN top t ON t.rep = r.rep JOIN dn d ON d.rep = r.rep)
SELECT min(segment_id) AS first_segment_id, count(*) AS size, string_agg(segment_id, ' ' ORDER BY k) FILTER (WHERE k <= 3) AS typical
FROM (SELECT *, row_number() OVER (PARTITION BY peak ORDER BY dense DESC, segment_id) AS k FROM lab) GROUP BY peak
""",
    "p7_found": """
WITH u AS (SELECT segment_id, min(embedding)::DOUBLE[] AS e FROM segment_embeddings WHERE len(embedding) = 128 GROUP BY segment_id),
v AS (SELECT segment_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u WHERE list_dot_product(e, e) > 0),
s AS (SELECT a.segment_id AS a, b.segment_id AS b, list_dot_product(a.e, b.e) AS c FROM v a JOIN v b ON list_dot_product(a.e, b.e) >= 0.70 OR a.segment_id = b.segment_id),
n AS (SELECT a, list_sort(list(b)) AS near, bool_and(c >= 0.75 OR a = b) AS tight, count(*) AS n FROM s GROUP BY a)
SELECT x.a AS segment_id, x.near[1] AS first_segment_id FROM n x JOIN (SELECT near, count(*) AS m FROM n WHERE tight AND n >= 3 GROUP BY near) g ON g.near = x.near AND g.m = x.n WHERE x.tight
""",
}
