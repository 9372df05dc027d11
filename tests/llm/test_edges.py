"""Null columns, empty tables, repeated rows, very long texts, ties and extra columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from gistmap.llm import canonical, conversations, density, markup, packing, pairs, pii, termfreq, tokenizer

TABLES = ("raw_entries", "conversations", "chat_messages", "segment_keywords", "segment_embeddings", "documents", "canonical_terms", "given_names", "context_windows")
CALLS = {
    "p1": lambda t: pairs.found_defects(t["raw_entries"], t["conversations"]),
    "p2": lambda t: canonical.found_terms(t["segment_keywords"], t["canonical_terms"]),
    "p3": lambda t: markup.found_kinds(t["raw_entries"], t["conversations"]),
    "p3_clean": lambda t: markup.cleaned(markup.source_texts(t["raw_entries"], t["conversations"])).select("origin", "record_key", "item", "clean").distinct(),
    "p5": lambda t: conversations.dropped_chats(t["chat_messages"]),
    "p5_turns": lambda t: conversations.rebuilt_turns(t["chat_messages"]),
    "p6": lambda t: termfreq.marked_terms(t["segment_keywords"]),
    "p7": lambda t: density.clusters(density.density_peaks(t["segment_embeddings"])),
    "p8": lambda t: tokenizer.encode_texts(t["documents"].select("doc_id", "text")),
    "p9": lambda t: packing.pack_documents(t["documents"], t["context_windows"]),
    "p10": lambda t: pii.found_spans(t["documents"], t["given_names"]),
}
#: Columns of every table that operators could use inside.
EXTRA = ("term", "clean", "block", "cell", "unit", "defect", "share", "rank", "window", "at", "n", "kind")


@pytest.fixture(scope="module")
def tables(spark, small):
    return {n: spark.read.parquet(f"{small}/{n}.parquet") for n in TABLES}


def result(df):
    return sorted(repr(sorted(r.asDict(recursive=True).items())) for r in df.collect())


@pytest.fixture(scope="module")
def plain(tables):
    return {k: result(f(tables)) for k, f in CALLS.items()}


@pytest.mark.parametrize("name", CALLS)
def test_rows_of_nulls_and_extra_columns_change_nothing(spark, tables, plain, name):
    def spoilt(t):
        nulls = spark.createDataFrame([tuple([None] * len(t.columns))], t.schema)
        t = t.unionByName(nulls)
        return t.withColumns({c: F.lit("x") for c in EXTRA if c not in t.columns})

    got = result(CALLS[name]({k: spoilt(v) for k, v in tables.items()}))
    if name == "p8":
        # a null text of a null document has no tokens
        got.remove("[('doc_id', None), ('ids', [])]")
    assert got == plain[name]


@pytest.mark.parametrize("name", [n for n in CALLS if n not in ("p8", "p9")])
def test_repeated_rows_change_nothing(tables, plain, name):
    assert result(CALLS[name]({k: v.unionByName(v) for k, v in tables.items()})) == plain[name]


@pytest.mark.parametrize("name", CALLS)
def test_empty_tables_give_no_rows(tables, name):
    assert result(CALLS[name]({k: v.limit(0) for k, v in tables.items()})) == []


@pytest.mark.parametrize("name", ["p1", "p3", "p8", "p9", "p10"])
def test_very_long_texts(spark, tables, name):
    long = "All is well here, and *nothing* is <b>lost</b> in 2024. " * 4_000
    t = dict(tables)
    t["documents"] = tables["documents"].where("doc_id is not null").orderBy("doc_id").limit(1).withColumn("text", F.lit(long))
    t["raw_entries"] = tables["raw_entries"].limit(1).withColumn("title", F.lit("Prompted " + long)).withColumn("safeHtmlItem", F.array(F.struct(F.lit(long).alias("html"))))
    t["conversations"] = tables["conversations"].limit(0)
    rows = CALLS[name](t).collect()
    if name == "p1":
        assert [r.defect for r in rows] == ["copy"]
    if name == "p3":
        assert {r.kind for r in rows} == {"html", "markdown"}


def test_history_of_messages(spark):
    kind = "message_id bigint, chat_id string, turn_index int, role string, text string, sent_at timestamp, arrived_at timestamp, version int, event string"
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [
        (1, "c", 0, "user", "q", at, at, 1, "create"), (1, "c", 0, "user", "q!", at, at, 2, "edit"), (2, "c", 1, "assistant", "a", at, at, 1, "create"), (3, "c", 2, "user", "oops", at, at, 1, "create"), (3, "c", 2, "user", None, at, at, 2, "delete"),
        (4, "d", 0, "user", "q", at, at, 1, "create"), (5, "d", 1, "assistant", "a", at, at, 1, "create"), (5, "d", 1, "assistant", "a", at, at, 2, "delete"),
    ]
    df = spark.createDataFrame(rows, kind)
    assert {r.chat_id: r.reason for r in conversations.dropped_chats(df).collect()} == {"d": "missing_reply"}
    folded = conversations.fold_versions(df)
    assert sorted((r.message_id, r.text) for r in folded.collect()) == [(1, "q!"), (2, "a"), (4, "q")]
