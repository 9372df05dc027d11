"""From exports to published tables, aliases, stopwords, missing and optional artefacts."""

import json

import pytest
from pyspark.sql import functions as F

from gistmap import pipeline as P
from gistmap.functions import text as X
from gistmap.operators import aliases as A
from gistmap.operators import sources as SRC


def test_exports_to_published_tables(spark, small, tmp_path):
    entries = spark.read.parquet(f"{small}/raw_entries.parquet")
    SRC.write_exports(entries, str(tmp_path / "exports"))
    bad = tmp_path / "exports" / "source_file=broken.json"
    bad.mkdir()
    (bad / "part-0.txt").write_text("{not json")
    store = P.Store(spark, str(tmp_path / "run"))
    out = P.run(store, exports=str(tmp_path / "exports"), pattern="*.txt", platform="gemini")
    assert out["rejects"].where("source_file = 'broken.json'").first().reason == "unreadable"
    segments = store.read("segments_v3")
    assert segments.count() == store.read("segments").join(store.read("layout"), "segment_id").count() > 0
    assert segments.where("platform <> 'gemini' or x is null or conversation_concept_id is null").count() == 0
    assert out["violations"].count() == 0
    lines = spark.read.json(store.path("segments_v3", "json"))
    assert lines.count() == segments.count() and set(lines.columns) <= set(segments.columns)
    # the same chats as from the rows themselves
    direct = SRC.build_conversations(SRC.with_instants(entries).where("missing = ''")).select("chat_id").distinct()
    assert store.read("turns").select("chat_id").distinct().exceptAll(direct).count() == 0 and store.read("turns").select("chat_id").distinct().count() == direct.count()


def test_missing_and_optional_artefacts(spark, tmp_path):
    store = P.Store(spark, str(tmp_path))
    with pytest.raises(P.MissingStage, match="run stage 'ingest' first"):
        P.run(store, ["segment"])
    with pytest.raises(ValueError, match="no stage"):
        P.run(store, ["fly"])
    assert store.optional("macro_domains") is None
    segs = spark.createDataFrame([("a::seg0", "a", 0, 2, 2, 7, None, "core")], "segment_id string, chat_id string, start_turn int, end_turn int, turn_count int, word_count bigint, boundary_type string, label string")
    store.write("segments", segs)
    store.write("segment_keywords", segs.select("segment_id", "chat_id", "label", F.expr("array(named_struct('term', 'x y', 'score', 0.5D, 'entity_label', cast(null as string))) as keywords")))
    store.write("layout", segs.select("segment_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")))
    out = P.run(store, ["publish"])
    row = store.read("segments_v3").first()
    assert (row.label, row.platform, row.macro_domain_id, row.conversation_concept_id) == ("x y", "unknown", None, None)
    assert out["violations"].count() == 0 and store.optional("density_field_v3") is None


def test_export_reader_takes_any_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = [{"title": "Prompted Hello", "details": [{"url": "https://h/app/abc"}]}, {"title": 5, "details": "odd"}]
    for name, body in (("a/x.json", json.dumps(good)), ("y.json", json.dumps({"chats": good})), ("z.json", "{"), ("n.txt", "[]")):
        (tmp_path / name).write_text(body)
    parsed = SRC.parse_exports(SRC.read_exports(spark, str(tmp_path)))
    assert sorted(r.reason for r in parsed.where("reason is not null").collect()) == ["not an array", "unreadable"]
    rows = SRC.typed_entries(parsed).orderBy("entry_index").collect()
    assert [(r.title, r.source_file) for r in rows] == [("Prompted Hello", "x.json"), ("5", "x.json")] and rows[1].details is None


def test_aliases(spark):
    kind = "canonical string, aliases array<string>"
    good = spark.createDataFrame([("Deep  Learning", ["dl", " Deep learning", "deep nets"]), ("kafka", ["kfk", None, " "]), (None, ["x"]), ("none", None)], kind)
    assert {tuple(r) for r in A.checked_aliases(good).collect()} == {("dl", "deep learning", "term"), ("deep nets", "deep learning", "term"), ("kfk", "kafka", "word")}
    bad = spark.createDataFrame([("a", ["x", "b"]), ("b", ["x"])], kind)
    assert {tuple(r) for r in A.conflicts(bad).collect()} == {("x", "claimed twice"), ("b", "is a name")}
    with pytest.raises(A.AliasConflict, match="'x' claimed twice"):
        A.checked_aliases(bad)


def test_words_and_stopwords():
    assert X.words_of("deep learning") == ("deep", "learning") and X.words_of(None) == ()
    assert X.stopwords(["The ", None, ""], None, ["a"]) == {"the", "a"} and "the" in X.stopwords() | {"the"}


def test_neighbours_by_cells_equal_brute_force(spark):
    import numpy as np

    from gistmap.operators import vectors as V

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([centres[r.integers(0, 12, 400)] + 0.3 * r.normal(size=(400, 16)), np.repeat(centres[:1], 30, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = sorted((n.a, n.rank, n.b) for n in V.knn(df, 5, block=40).collect())
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = sorted((a, k + 1, int(b)) for a in range(len(x)) for k, b in enumerate(sorted(range(len(x)), key=lambda j: (-s[a, j], j))[:5]))
    assert got == want
    assert V.knn(df.limit(0), 5).count() == 0


def test_pairs_of_a_large_chat_are_made_in_parts(spark, monkeypatch):
    from gistmap.operators import graph as G

    rows = [("big", f"t{i:03d}") for i in range(60)] + [("small", "t001"), ("small", "t002")]
    k = spark.createDataFrame(rows, "chat_id string, term string")
    kept = k.select("term").distinct()
    monkeypatch.setattr(G, "PART", 7)
    got = {(r.term_a, r.term_b): r.cooccurrence for r in G.pairs(k, kept).collect()}
    assert len(got) == 60 * 59 // 2 and got["t001", "t002"] == 2


def test_names_in_texts(spark):
    from gistmap.operators import terms as K

    t = spark.createDataFrame([("s", "We met Dr. Ada Lovelace at the Turing Institute and read “The Long Way Home”. A new soil test."), ("n", None)], "segment_id string, text string")
    got = {r.term: r.entity_label for r in K.candidates(t).collect()}
    assert got["ada lovelace"] == "PERSON" and got["turing institute"] == "ORG" and got["the long way home"] == "WORK_OF_ART"
    assert any(v is None for v in got.values())
