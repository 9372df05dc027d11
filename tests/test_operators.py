"""Hand-worked cases and invariants of the topic-map operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmap.functions import text as X
from gistmap.operators import algos
from gistmap.operators import assemble as A
from gistmap.operators import graph as G
from gistmap.operators import layout as L
from gistmap.operators import segmentation as S
from gistmap.operators import terms as K
from gistmap.operators import vectors as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, X.html_to_text, "a<b>x</b>&amp;&nbsp;y  z") == "a x & y z"
    assert one(spark, X.html_to_text, "&lt;b&gt;") == "<b>"
    assert one(spark, X.user_text, "prompted  Hello") == "Hello"
    assert one(spark, X.user_text, "Prompted") == "Prompted"
    assert one(spark, X.strip_non_discursive, "use $x^2$ with foo=bar --flag on well-known").split() == ["use", "with", "on", "well-known"]
    assert one(spark, X.strip_determiner, "that malloc") == "malloc"
    assert one(spark, X.strip_determiner, "my c") == "my c"
    assert one(spark, X.repair_boundary, "little-") == "little"
    assert one(spark, X.repair_boundary, "-x") is None
    assert one(spark, X.repair_boundary, "big-o") == "big-o"
    assert [one(spark, X.is_valid_term, t) for t in ("pish(stdin", "12:30", "a1b2c3", "heap allocator")] == [False, False, False, True]
    assert one(spark, X.slugify, "++") == "topic"
    assert one(spark, X.root, "greedy algorithms explain") == "greedy algorithm"


def test_chat_ids(spark):
    schema = "details array<struct<url:string,name:string>>"
    rows = [([("https://h/app/abc?x=1", None)],), ([("https://h/z", None)],), ([("https://h/app/", None)],), ([(None, "https://h/app/q")],), (None,), ([],)]
    assert [r[0] for r in spark.createDataFrame(rows, schema).select(X.chat_id(F.col("details"))).collect()] == ["abc", "https://h/z", None, "q", None, None]


def test_jaro_winkler_and_chunks():
    assert abs(X._jaro_winkler("abcd", "axyz") - 0.55) < 1e-9
    assert X._jaro_winkler("thrifte", "thrifted") >= 0.88
    assert X._chunks("One two. Three four five. Six.", 4) == ["One two.", "Three four five. Six."]
    assert X._chunks("a b c d e", 2) == ["a b", "c d", "e"]
    assert X._chunks(None, 3) == [""]


def traj(spark, sims):
    return spark.createDataFrame([("c", i, float(s)) for i, s in enumerate(sims)], "chat_id string, b int, sim double")


def test_hard_shift_thresholds(spark):
    r = S.thresholds(S.depths(traj(spark, [0.9, 0.9, 0.2, 0.9, 0.9]))).orderBy("b").collect()
    assert [round(x.depth, 6) for x in r] == [0, 0, 1.4, 0, 0]
    assert abs(r[0].threshold - 0.84) < 1e-6
    assert S.thresholds(S.depths(traj(spark, [0.1, 0.9]))).first().threshold is None


def test_core_tie_is_first(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 1, 5)], "chat_id string, seg_index int, word_count int")
    assert {r.seg_index: r.label for r in S.core_labels(df).collect()} == {0: "core", 1: "tangent"}


def test_substring_prune_and_redundancy(spark):
    t = spark.createDataFrame([("s", "art"), ("s", "party"), ("s", "heap"), ("z", "art")], "segment_id string, term string")
    assert {(r.segment_id, r.term) for r in K.prune_substrings(t).collect()} == {("s", "party"), ("s", "heap"), ("z", "art")}
    p = spark.createDataFrame([("alpha beta", 10), ("alpha beta gamma", 9), ("beta gamma", 30)], "phrase string, count bigint")
    assert {r.phrase for r in K.prune_redundant(p).collect()} == {"alpha beta gamma", "beta gamma"}


def test_pmi_and_npmi(spark):
    row = spark.createDataFrame([(2, 2, 2, 4), (0, 2, 2, 4)], "ab int, a int, b int, n int")
    got = row.select(G.pmi(F.col("ab"), F.col("a"), F.col("b"), F.col("n")).alias("p")).collect()
    assert got[0].p == 1.0 and got[1].p is None
    n = spark.createDataFrame([(2, 2, 2, 8)], "ab int, a int, b int, n int").select(K.npmi(F.col("ab"), F.col("a"), F.col("b"), F.col("n")).alias("p")).first().p
    assert abs(n - 1.0) < 1e-9


def test_edge_pruning_keeps_leaves(spark):
    e = spark.createDataFrame([("hub", x, 1.0) for x in ("l1", "l2", "l3")], "term_a string, term_b string, weight double")
    assert G.top_per_node(e, 1).count() == 3


def test_routing_votes_and_labels(spark):
    m = spark.createDataFrame([(i, "c", 0.9 if i == 0 else 0.1) for i in range(6)], "id int, community string, intra double")
    assert {r.domain for r in V.route(m).collect()} == {"Background / Minor Orbit"}
    v = spark.createDataFrame([("k", "A", "c::seg10"), ("k", "B", "c::seg2")], "concept string, domain string, segment_id string")
    assert V.majority(v).first().domain == "A"
    d = L.dedupe(spark.createDataFrame([("abg", 1), ("abg", 2), ("x", 3)], "label string, n int"), "label", ["n"], " ({})")
    assert [r.unique for r in d.orderBy("n").collect()] == ["abg", "abg (2)", "x"]
    s = A.slugs(spark.createDataFrame([("T",), ("t ",), ("T-2",)], "label string"))
    assert len({r.id for r in s.collect()}) == 3


def test_layout(spark):
    p = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0)], "x double, y double")
    assert {(r.x, r.y) for r in L.normalize(p).collect()} == {(-100.0, -50.0), (100.0, 50.0)}
    q = spark.createDataFrame([("c", "core", 0.0, 0.0), ("c", "tangent", 10.0, 0.0)], "chat_id string, label string, x double, y double")
    assert {r.label: r.x for r in L.tangent_pull(q).collect()} == {"core": 0.0, "tangent": 8.5}
    same = spark.createDataFrame([(3,), (3,)], "v int")
    assert {r.s for r in L.minmax(same, "v", "s").collect()} == {0.0}


def test_constraints(spark):
    seg = "id string, conversation_concept_id string, macro_domain_id string"
    con = "id string, label string, macro_domain_id string"
    c, d = spark.createDataFrame([("k", "K", "d")], con), spark.createDataFrame([("d", "D")], "id string, label string")
    good = spark.createDataFrame([("a", "k", None)], seg)
    assert A.v3_violations(good, c, d).count() == 0
    bad = spark.createDataFrame([("a", "k", None), ("a", "zz", "d"), ("b", None, "d")], seg)
    assert {r.rule for r in A.v3_violations(bad, c, d).collect()} == {"duplicate id", "unknown conversation_concept_id", "null conversation_concept_id"}
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z"), ("b", "b")], "source string, target string")
    assert {r.rule for r in A.v2_violations(nodes, edges).collect()} == {"unknown target", "loop"}


def blobs(n=30, seed=0):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, 0.05, (n, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0))])


def test_clusterings_find_blobs():
    x = blobs()
    for label in (algos.hdbscan(x, 5, 4), algos.ward(x, 3)):
        groups = [set(label[i * 30 : (i + 1) * 30]) - {-1} for i in range(3)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_leiden_partition_is_connected_and_good():
    clique = lambda at: [(at + i, at + j) for i in range(6) for j in range(i)]
    edges = clique(0) + clique(6) + [(0, 6)]
    label = algos.leiden_cpm(13, edges, 0.2)
    assert len(set(label[:6])) == 1 and len(set(label[6:12])) == 1 and label[0] != label[6] and label[12] not in label[:12]
    assert (algos.connected_labels(13, edges, label) == label).all() or len(set(algos.connected_labels(13, edges, label))) == len(set(label))


def test_mixture_and_layouts():
    w, m, c = algos.dp_mixture(blobs()[:, :2], 12, covariance_scale=0.05)
    assert abs(w.sum() - 1) < 1e-9 and (np.linalg.eigvalsh(c) > 0).all() and 2 <= (w > 0.02).sum() <= 6
    assert algos.neighbour_layout(blobs()).shape == (90, 2) and np.isfinite(algos.neighbour_layout(blobs())).all()
    assert algos.neighbour_layout(np.zeros((0, 3))).shape == (0, 2)
    assert algos.spring_layout(1, []).tolist() == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        algos.check(algos.MAX_ROWS + 1)


def test_mmr_takes_diverse_terms():
    v = np.array([[1, 0], [0.99, 0.14], [0, 1]], float)
    assert K.mmr_order(["heap a", "heap a b", "stack"], np.array([0.9, 0.89, 0.5]), v, 2, 0.6, 0.5) == [0, 2]


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {(q.a, q.rank): q.b for q in V.knn(df, 5, block=17).collect()}
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    want = {(i, k + 1): int(b) for i in range(60) for k, b in enumerate(np.argsort(-s[i], kind="stable")[:5])}
    assert got == want


def test_density_ranks_are_a_permutation(spark):
    parts = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 100.0, 0.0, 100.0)], "component int, weight double, mx double, my double, cxx double, cxy double, cyy double")
    g = V.density_grid(V.grid(spark, 100.0, 10), parts).collect()
    assert sorted(round(r.normalized_density * 99) for r in g) == list(range(100))
    assert math.isclose(max(r.log_density for r in g), -math.log(2 * math.pi * 100) - 0.5 * 2 * (100 / 9) ** 2 / 100, abs_tol=1e-6)


def test_every_term_gets_a_concept(spark, small):
    from gistmap.operators.turns import load
    from gistmap.plans.vector_queries import ml_hdbscan_terms

    got = [r.id for r in ml_hdbscan_terms(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.term for r in load(spark, small)["terms"].select("term").distinct().collect()}


def test_density_clustering_needs_no_matrix():
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(3_000, 4))
    tracemalloc.start()
    algos.hdbscan(x, 2, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(x) ** 2 / 2


@pytest.mark.parametrize("name", ["fn_merge_sequence", "fn_segment_with_phrases"])
def test_too_many_pairs_are_refused(spark, small, monkeypatch, name):
    from gistmap.plans import term_queries as Q

    pair = spark.createDataFrame([("a", "b", 9, 0.9, "a b"), ("b", "c", 9, 0.9, "b c")], "a string, b string, n bigint, npmi double, phrase string")
    monkeypatch.setattr(Q.K, "scored_bigrams", lambda toks: pair)
    monkeypatch.setattr(Q, "ml_phrases", lambda spark, d: pair)
    assert Q.QUERIES[name](spark, small).columns[:2] == ["chat_id", "turn_index"]
    monkeypatch.setattr(Q.K, "MAX_PAIRS", 1)
    with pytest.raises(ValueError):
        Q.QUERIES[name](spark, small)


def test_every_component_of_a_mixture_counts(spark):
    parts = spark.createDataFrame([(i, 1 / 130, float(i), 0.0, 9.0, 0.0, 9.0) for i in range(130)], "component int, weight double, mx double, my double, cxx double, cxy double, cyy double")
    point = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert V.responsibilities(point, parts).count() == 130


def test_segments_of_texts_store_no_vectors(spark, small):
    from gistmap.operators.embedding import embed_texts, hashed_vector
    from gistmap.operators.turns import load
    from gistmap.plans.map_queries import ml_segment_all

    t = load(spark, small)["turns"]
    windows = embed_texts(S.sliding_texts(t, 2), "text").select("chat_id", "i", "v")
    got = S.segment_turns(t, hashed_vector)
    assert sorted(got.collect(), key=str) == sorted(S.segment_chats(t, windows).collect(), key=str)
    # many shuffles by one key in one plan let adaptive execution join parts of different numbers
    assert str(ml_segment_all(spark, small)._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") <= 6


def test_communities_have_no_row_limit():
    n = algos.MAX_ROWS + 1_000
    edges = [(at + i, at + j) for at in range(0, n, 4) for i in range(4) for j in range(i)]
    label = algos.leiden_cpm(n, edges, 0.2)
    assert (np.bincount(label) == 4).all() and (label.reshape(-1, 4) == label.reshape(-1, 4)[:, :1]).all()


def test_spring_layout_needs_no_matrix():
    import tracemalloc

    r = np.random.default_rng(3)
    n, edges = 1_500, [(i, (i * 7 + 1) % 1_500, 1.5) for i in range(1_499)]
    tracemalloc.start()
    got = algos.spring_layout(n, edges, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n / 2
    pos = np.random.default_rng(42).random((n, 2))
    adj = np.zeros((n, n))
    for a, b, w in edges:
        adj[a, b] = adj[b, a] = w
    for i in r.integers(0, n, 20):
        d = np.maximum(0.01, np.hypot(*(pos[i] - pos).T))
        force = ((pos[i] - pos) * (1 / n / d**2 - adj[i] * d * math.sqrt(n))[:, None]).sum(0)
        assert np.allclose(got[i], pos[i] + force * 0.1 / max(0.01, np.hypot(*force)))


def test_ranking_shuffles_no_vectors(spark, small):
    from pyspark.sql import Window

    from gistmap.operators.embedding import embed_texts
    from gistmap.plans.term_queries import ml_rank

    texts = spark.createDataFrame([("a", "heap sort and heap memory of a sorted list"), ("b", "party time, birthday party")], "segment_id string, text string")
    found = spark.createDataFrame([("a", t) for t in ("heap", "heap sort", "sorted list", "memory", "tea")] + [("b", "party"), ("b", "birthday party"), ("b", "art")], "segment_id string, term string")
    j = embed_texts(found, "term", "v").join(embed_texts(texts, "text", "u"), "segment_id")
    j = j.select("segment_id", "term", "v", F.round(X.dot(F.col("u"), F.col("v")), 9).alias("relevance"), F.row_number().over(Window.partitionBy("segment_id").orderBy("term")).alias("pos"))
    want = K.rank_by_mmr(j)
    assert sorted(K.rank_texts(texts, found).collect()) == sorted(want.collect())
    assert sorted(K.rank_texts(texts, found, prune=True).collect()) == sorted(K.prune_substrings(want).collect())
    plan = str(ml_rank(spark, small)._jdf.queryExecution().executedPlan())
    assert plan.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" not in plan
