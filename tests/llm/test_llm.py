"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmap.llm import canonical, conversations, density, markup, packing, pairs, termfreq, tokenizer


# --- tokenizer ---


def brute_bpe(ranks, word):
    parts = [bytes((b,)) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_transducer_equals_merging():
    enc = tokenizer.encoder(tokenizer.vocabulary_path(), tokenizer.default_pattern())
    r = random.Random(3)
    for _ in range(400):
        w = "".join(r.choice("abcdeinrst éß漢🙂\n") for _ in range(r.randint(1, 24)))
        assert enc.decode(enc.encode(w)) == w
        b = w.encode()
        assert list(enc.transducer.encode(b)) == brute_bpe(enc.transducer.ranks, b)


def test_utf8_machine():
    m = tokenizer.Utf8Machine()
    data = "aé漢🙂".encode()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.close() == "aé漢🙂"
    bad = tokenizer.Utf8Machine()
    assert bad.feed(b"\xe6\xbca\xff") + bad.close() == "�a�"


def test_encode_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a" * 20_000, "k"), (4, "<|endoftext|>", "k")], "doc_id bigint, text string, ids_old string")
    out = {r.doc_id: r for r in tokenizer.encode_texts(df).collect()}
    assert out[1].ids == [] and out[2].ids == [] and len(out[3].ids) == 5_000 and 50256 not in out[4].ids
    back = {r.doc_id: r.text for r in tokenizer.decode_ids(tokenizer.encode_texts(df)).collect()}
    assert back == {1: "", 2: "", 3: "a" * 20_000, 4: "<|endoftext|>"}
    assert tokenizer.encode_texts(df.limit(0)).count() == 0


# --- terms ---


def test_trie_counts_like_a_dict():
    r = random.Random(1)
    trie, want = termfreq.BurstTrie(4), {}
    for _ in range(3_000):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        trie.add(t, 1, 1)
        want[t] = want.get(t, 0) + 1
    assert {p + s: o for p, es in trie.containers() for s, o, _ in es} == want


KW = "segment_id string, chat_id string, label string, keywords array<struct<term:string,score:double,entity_label:string>>"


def test_term_counts(spark):
    k = lambda *ts: [(t, 0.5, None) for t in ts]
    rows = [("s1", "c1", "x", k("A", "a ", " ", None, "b")), ("s1", "c1", "x", k("A", "a ", " ", None, "b")), ("s2", "c2", "x", k("a")), ("s3", None, "x", None), ("s4", None, "x", k("a"))]
    got = {r.term: (r.occurrences, r.records) for r in termfreq.marked_terms(spark.createDataFrame(rows, KW)).collect()}
    assert got == {"a": (4, 2), "b": (1, 1)}
    assert termfreq.marked_terms(spark.createDataFrame([], KW)).count() == 0


# --- canonical ---

REF = [(1, "syntax serialization", ["synser"]), (2, "packet inverted trajectory", []), (3, "browser boundary", None), (4, None, None)]


@pytest.mark.parametrize(
    "term, want",
    [
        ("Syntax  Serialisation", 1), ("serialization, syntax", 1), ("serialization of syntax", 1), ("syntaxserialization", 1), ("SYNSER", 1), ("#syntax_serialization", 1), ("ｓｙｎｔａｘ　serialization", 1), ("syntax seri.", 1),
        ("sýntax serializations", 1), ("my packet inverted trajectory", 2), ("pcaket inverted trajectory", 2), ("browser boundaries", 3), ("browser velvet", -1), ("syntax boundary", -1), ("synthesis", -1),
    ],
)
def test_matching(term, want):
    assert canonical.Matcher(REF).find(term)[1] == want


def test_bk_tree_equals_brute_force():
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(300)]
    tree = canonical.BKTree()
    for w in words:
        tree.add(w)
    for q in words[:40]:
        q = q[1:] + "a"
        assert sorted(tree.within(q, 2)) == sorted({(canonical.levenshtein(q, w), w) for w in words if canonical.levenshtein(q, w) <= 2})
    assert canonical.levenshtein("kitten", "sitting") == 3 and canonical.typo_distance("ab", "ba") == 1


def test_aliases_may_be_misspelt():
    m = canonical.Matcher([(1, "kubernetes", ["container orchestration", "kube"]), (2, "kafka", []), (3, "redis", []), (4, "binary search tree", []), (5, "binary star", []), (6, "corn starch", [])])
    assert m.find("container orchestrtion")[1] == 1 and m.find("orchestration, container")[1] == 1 and m.find("kubs")[1] == -1
    assert m.find("kafca")[1] == 2 and m.find("redsi")[1] == 3 and m.find("binary serch tree")[1] == 4
    assert m.find("binary starch tree")[1] == -1


@pytest.mark.parametrize("seed", range(4))
def test_any_number_of_shards_gives_the_same(spark, seed):
    r = random.Random(seed)
    words = ["syntax", "packet", "binary", "search", "starch", "tree", "budget", "signal", "filter", "matrix", "kernel", "session", "sessions", "session-id", "star"]
    ref = [(i, " ".join(r.sample(words, r.randint(1, 3))), [" ".join(r.sample(words, 2))] if r.random() < 0.3 else None) for i in range(40)]

    def spoilt(t: str) -> str:
        t = list(t)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(t))
            x = r.random()
            if x < 0.3:
                t[k] = r.choice("aest")
            elif x < 0.6:
                t.insert(k, r.choice("aest"))
            elif x < 0.8 and k:
                t[k - 1], t[k] = t[k], t[k - 1]
            elif len(t) > 3:
                del t[k]
        return "".join(t)

    terms = [spoilt(r.choice(ref)[1]) for _ in range(150)] + [spoilt(" ".join(r.sample(words, 2))) for _ in range(80)] + [None, " ", "binary starch tree", "packet ses."]
    rows = spark.createDataFrame(list(enumerate(terms)), "n int, term string")
    frame = spark.createDataFrame(ref, "term_id bigint, canonical string, aliases array<string>")
    got = [{x.n: x.term_id for x in canonical.match_terms(rows, frame, max_broadcast=most).collect()} for most in (1_000, r.randint(5, 20), 3)]
    assert got[0] == got[1] == got[2]


def test_a_search_is_spared_only_where_nothing_can_be_found():
    r = random.Random(9)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(4, 8))) for _ in range(40)]
    ref = [(i, " ".join(r.sample(words, r.randint(1, 2))), None) for i in range(60)]
    m, full = canonical.Matcher(ref), canonical.Matcher(ref)
    full._plausible = lambda words: True
    for _ in range(400):
        t = list(r.choice(ref)[1])
        for _ in range(2):
            t[r.randrange(len(t))] = r.choice("abcde ")
        assert m.find("".join(t)) == full.find("".join(t))


# --- conversations ---

MSG = "message_id bigint, chat_id string, turn_index int, role string, text string, sent_at timestamp, arrived_at timestamp"


def messages(spark, chats):
    from datetime import datetime, timedelta

    t0, rows = datetime(2024, 1, 1), []
    for chat, turns in chats.items():
        for k, (turn, role, text, minute) in enumerate(turns):
            at = None if minute is None else t0 + timedelta(minutes=minute)
            rows.append((len(rows) + 1, chat, turn, role, text, at, t0 + timedelta(hours=k)))
    return spark.createDataFrame(rows, MSG)


def test_dropped_chats(spark):
    chats = {
        "good": [(0, "User", "q", 0), (1, "AI", "a", 1), (0, "User", "q", 0)],
        "placed": [(0, "user", "q", 0), (None, "assistant", "a", 1), (2, "user", "r", 2), (3, "model", "b", 3)],
        "blank_reply": [(0, "user", "q", 0), (1, "assistant", " ", 1)],
        "gap": [(0, "user", "q", 0), (2, "assistant", "a", 1)],
        "clash": [(0, "user", "q", 0), (0, "user", "r", 0), (1, "assistant", "a", 1)],
        "odd": [(0, "user", "q", 0), (1, "narrator", "a", 1)],
        "norole": [(0, "user", "q", 0), (1, None, "a", 1)],
        "early": [(0, "assistant", "a", 0), (1, "user", "q", 1), (2, "assistant", "a", 2)],
        "waits": [(0, "user", "q", 0), (1, "user", "r", 1), (2, "assistant", "a", 2)],
        "silent": [(0, "user", None, 0), (1, "assistant", "\u00a0", 1)],
        "long": [(i, "user" if i % 2 == 0 else "assistant", "t", i) for i in range(1_400)],
        "long_bad": [(i, "user" if i % 2 == 0 or i == 513 else "assistant", "t", i) for i in range(1_400)],
        "loose": [(None, "user", "q", 0), (None, "assistant", "a", 1)],
    }
    m = messages(spark, chats)
    got = {r.chat_id: r.reason for r in conversations.dropped_chats(m).collect()}
    assert got == {"blank_reply": "missing_reply", "gap": "broken", "clash": "broken", "odd": "broken", "norole": "broken", "early": "broken", "waits": "missing_reply", "silent": "empty", "long_bad": "missing_reply"}
    turns = conversations.rebuilt_turns(m).where("chat_id = 'placed'").orderBy("turn_index").collect()
    assert [(t.turn_index, t.role, t.text) for t in turns] == [(0, "user", "q"), (1, "assistant", "a"), (2, "user", "r"), (3, "assistant", "b")]
    assert conversations.dropped_chats(m.limit(0)).count() == 0


def test_blocks_of_time_do_not_change_places(spark, monkeypatch):
    r = random.Random(6)
    chats = {
        f"c{k}": [(None if r.random() < 0.6 else i, "user" if i % 2 == 0 else "assistant", f"t{i}", i * r.choice([1, 1, 7]) if k % 2 else i) for i in range(n)]
        for k, n in enumerate((40, 300, 1, 90))
    }
    chats["loose"] = [(None, "user" if i % 2 == 0 else "assistant", f"t{i}", i // 3) for i in range(200)]
    m = messages(spark, chats).cache()
    got = []
    for events in (1_000_000, 7):
        monkeypatch.setattr(conversations, "EVENTS", events)
        placed = conversations.place_unnumbered(conversations.folded_table(m))
        got.append(sorted((x.message_id, x.turn_index) for x in placed.collect()))
    assert got[0] == got[1] and len(got[0]) == m.count()
    # one gap of loose messages only is numbered by time
    own = {x.message_id: x.turn_index for x in conversations.place_unnumbered(conversations.folded_table(m.where("chat_id = 'loose'"))).collect()}
    assert [own[x.message_id] for x in m.where("chat_id = 'loose'").orderBy("sent_at", "message_id").collect()] == list(range(200))


# --- density ---


def test_sealed_groups_and_peaks(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for g, n in enumerate((3, 5, 2, 40)):
        c = r.normal(size=128)
        ids = [f"g{g}-{i:02d}" for i in range(n)]
        rows += [(i, ((c + r.normal(size=128) * 0.2) * (1 + k)).astype(float).tolist()) for k, i in enumerate(ids)]
        if n >= 3:
            want |= {i: ids[0] for i in ids}
    same = r.normal(size=128).tolist()
    rows += [(f"same-{i}", same) for i in range(4)] + [("zero", [0.0] * 128), ("null", None), ("short", [1.0, 2.0]), rows[0]]
    want |= {f"same-{i}": "same-0" for i in range(4)}
    df = spark.createDataFrame(rows, "segment_id string, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    lab = density.density_peaks(df)
    assert {x.segment_id: x.first_segment_id for x in density.sealed_groups(lab).collect()} == want
    sizes = {x.first_segment_id: x["size"] for x in density.clusters(lab).collect()}
    assert sizes["g3-00"] == 40 and sizes["g2-00"] == 2
    assert density.sealed_groups(density.density_peaks(df.limit(0))).count() == 0


def test_shuffles_of_clusters_do_not_grow_with_the_pairs_of_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    centres = r.normal(size=(700, 128))
    vectors = np.concatenate([r.normal(size=(1_900, 128)), (centres[:, None] + r.normal(size=(700, 3, 128)) * 0.4).reshape(-1, 128)]).astype(np.float32)
    rows = [(f"s{i:04d}", v.tolist()) for i, v in enumerate(vectors)] + [(f"t{i:04d}", vectors[i * 7].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "segment_id string, embedding array<float>")

    def written():
        every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    got = []
    for block in (density.BLOCK, 100):
        monkeypatch.setattr(density, "BLOCK", block)
        before = written()
        got.append(sorted(map(tuple, density.density_peaks(df).collect())))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert written() - before < 6 * vectors.nbytes
    assert got[0] == got[1] and len(got[0]) == len(rows)


# --- packing ---


def test_windows_are_full_and_whole():
    r = random.Random(7)
    items = [(r.randint(1, 90), i, r.choice("abc")) for i in range(600)]
    windows, _ = packing.fill_windows(items, 100, {})
    assert sorted(m for w in windows for m in w) == list(range(600))
    assert all(sum(items[m][0] for m in w) <= 100 for w in windows)
    assert len(windows) <= 1.05 * sum(s for s, _, _ in items) / 100 + 1


def test_what_a_source_is_owed_stays_bounded():
    r = random.Random(5)
    items = [(r.randint(5, 160), i, r.choices("abc", (66, 25, 9))[0]) for i in range(9_000)]
    windows, _ = packing.fill_windows(items, 2_048, {})
    total = sum(s for s, _, _ in items)
    share = {x: sum(s for s, _, y in items if y == x) / total for x in "abc"}
    given, all_, owed, off = dict.fromkeys("abc", 0), 0, 0.0, []
    for w in windows:
        mine = dict.fromkeys("abc", 0)
        for m in w:
            mine[items[m][2]] += items[m][0]
        for x in "abc":
            given[x] += mine[x]
        all_ += sum(mine.values())
        owed = max(owed, *(abs(given[x] - share[x] * all_) for x in "abc"))
        off.append(sum(abs(mine[x] / sum(mine.values()) - share[x]) for x in "abc") / 2)
    # at no time is a source owed more than one window, every whole window is near the mixture, and nearly nothing is wasted
    assert owed <= 2_048 and max(off[:-3]) < 0.25 and sum(off) / len(off) < 0.06 and total / (len(windows) * 2_048) > 0.98


def test_pack_rounds_and_splits(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), r.choice(["x", "y", None])) for i in range(300)] + [(900, "word " * 500, "x"), (901, None, "x"), (902, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kinds = spark.createDataFrame([("w", 64), ("none", None)], "window_name string, capacity_tokens int")
    sizes = {x.doc_id: x.n for x in tokenizer.encode_texts(docs.select("doc_id", "text"), ids="n", counts_only=True).collect()}
    for shard in (10_000, 60):
        got = packing.pack_documents(docs, kinds, shard=shard).collect()
        per, load = {}, {}
        for x in got:
            per[x.doc_id] = per.get(x.doc_id, 0) + x.n_tokens
            load[x.window_id] = load.get(x.window_id, 0) + x.n_tokens
        assert per == {k: v for k, v in sizes.items() if v}
        assert max(load.values()) <= 64 and len({(x.doc_id, x.part) for x in got}) == len(got)
        assert all(x.part == 0 for x in got if sizes[x.doc_id] <= 64)
        assert len(load) <= 1.06 * sum(sizes.values()) / 64 + 1


# --- markup ---


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<p>a</p>", ["html"]), ("a &amp; b", ["html"]), ("&lt;b&gt;x&lt;/b&gt;", ["html"]), ("# Head\n\ntext", ["markdown"]), ("a **b** c", ["markdown"]), ("[[a|b]] c", ["wiki"]), ("'''a''' b", ["wiki"]),
        ("\\textbf{a} $x_1 = 2$", ["latex"]), ("$5 or $16 a month", []), ("2 * 3 * 4", []), ("max_2_items and a_b_c", []), ("Vec<T> and a < b", []), ("x == y or row[4] {name}", []), ("C# or F#, #3, R&D", []),
        ("```python\n# x\n<b>**y**</b>\n```", ["markdown"]), ("<pre><code># a\n**b**</code></pre>", ["html"]), ("", []), (None, []),
    ],
)
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_clean_text():
    assert markup.clean_text("<h2>T</h2><p>a&nbsp;b</p><ul><li>x</li><li>y</li></ul>") == "## T\n\na b\n\n- x\n- y"
    assert markup.clean_text("**a** [b](http://c) `d`") == "a b `d`"
    assert markup.clean_text("[[x|y]] {{t|1}}'''z'''") == "y z"
    assert markup.clean_text("<pre><code>if (a &lt; b) {}</code></pre>") == "```\nif (a < b) {}\n```"
    assert markup.clean_text(None) is None


# --- pairs ---


@pytest.mark.parametrize(
    "answer, state",
    [("All is done.", "closed"), ("```python\nx = 1", "broken"), ("```\nf(x)\n```", "closed"), ("It is known, see fig.", "broken"), ("and so on (", "broken"), ("Have fun", "open"), ("Good luck 🙂", "closed"), ("\\begin{itemize}\n- a", "broken"), ("a\n- one\n- two", "listed"), ("- It is so.\n\ntext\n- one\n- two", "listed"), ("More at https://a.example/b", "closed"), ("this is z. B.", "broken")],
)
def test_last_unit(answer, state):
    assert pairs.last_unit(answer)[0] == state


def test_pair_rules():
    assert pairs.is_copy("How do I choose a drip line?", "HOW DO I CHOOSE A DRIP LINE!")
    assert pairs.is_copy("Why does my mutex behave differently after 45 attempts?", "Why does my mutex behave after 45 attempts?")
    assert not pairs.is_copy("How do I choose?", "How do I choose? Start small and look at it.")
    assert pairs.is_refusal("I'm sorry, but I can't help with that request. Feel free to ask about another topic.")
    assert not pairs.is_refusal("I can't see your screen, but I can tell you how to check it. Look at the log.")
    assert pairs.wrong_language("How do I choose a drip line when it changes?", "Das Wichtigste ist, dass es von der Länge abhängt und nicht von der Farbe.")
    assert not pairs.wrong_language("Please answer in German: how do I choose it?", "Das Wichtigste ist, dass es von der Länge abhängt.")
    assert not pairs.readable("\u200b \ufeff") and pairs.readable("🙂")


def test_found_defects(spark):
    entries = spark.createDataFrame(
        [(1, "Prompted What is it?", [("<p></p>",)]), (2, "Prompted What is it?", [("<p>What is it</p>",)]), (3, None, [("<p>x</p>",)]), (4, "Tell me", [("<p>It is the best of all and you should keep</p>",)]), (5, "Tell me", [("<p>It is the best of all and you should keep it.</p>",)]), (6, "Tell me", None)],
        "entry_id bigint, title string, safeHtmlItem array<struct<html:string>>",
    )
    conv = spark.createDataFrame([("c", [("user", "Tell me", 0), ("assistant", "Sorry, I can't help with that request.", 1)])] * 2, "chat_id string, turns array<struct<role:string,text:string,turn_index:int>>")
    got = {(r.record_key, r.defect) for r in pairs.found_defects(entries, conv).collect()}
    assert got == {("1", "empty"), ("2", "copy"), ("4", "truncated"), ("6", "empty"), ("c", "refusal")}
    assert pairs.found_defects(entries.limit(0), conv.limit(0)).count() == 0


def entry_defects(spark, answers):
    entries = spark.createDataFrame([(i, f"Prompted How do I use tool {i}?", [(a,)]) for i, a in enumerate(answers)], "entry_id bigint, title string, safeHtmlItem array<struct<html:string>>")
    conv = spark.createDataFrame([], "chat_id string, turns array<struct<turn_index:int,role:string,text:string>>")
    return {(int(r.record_key), r.defect) for r in pairs.found_defects(entries, conv).collect()}


def test_copies_do_not_vouch_for_each_other(spark):
    broken = "Start small. Then look at the pressure of the"
    assert entry_defects(spark, [broken] * 4) == {(i, "truncated") for i in range(4)}
    # different answers that end alike still make a set phrase
    assert entry_defects(spark, [f"Use number {i}. Have fun with it" for i in ("one", "two", "three")]) == set()


def test_copies_make_no_length_limit(spark):
    assert entry_defects(spark, ["Take the small one. Good luck"] * 12 + ["Take the large one. Good luck"]) == set()


def test_item_cut_inside_a_word_is_truncated_however_often(spark):
    cut = [f"Take {w}:\n- Sow seeds\n- Wat" for w in ("one", "two", "three")]
    assert entry_defects(spark, [*cut, "Do this:\n- Dig\n- Water the bed"]) == {(i, "truncated") for i in range(3)}


def test_queries_registered():
    from gistmap.llm.queries import ORACLES, QUERIES

    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 7, 10)} <= set(QUERIES) and set(ORACLES) <= set(QUERIES)
