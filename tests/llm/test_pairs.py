"""Broken pairs: sentences written by hand apart from the test tables, corpus size, prefix counts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gistmap.llm import languages, pairs

REFUSALS = [
    "As an AI language model, I'm unable to provide that information.", "I'll have to pass on this one.", "I'm declining this request.", "Das geht leider nicht.", "It isn't something I'm willing to discuss.",
    "Dazu möchte ich mich nicht äußern.", "Ich fürchte, da kann ich nicht weiterhelfen.", "Je regrette, mais je ne peux accéder à ta demande.", "No me está permitido hablar de eso.", "That topic is closed to me.",
    "I'm afraid I can't help you with your tax return. You may want to ask an accountant.", "Diese Anfrage kann ich nicht bearbeiten. Bitte wende dich an jemand anderen.", "Désolé, je ne peux pas répondre à cela.", "Lo siento, pero no puedo ayudarte con este asunto.",
    "I won't answer questions about private people. " * 30,
]
ANSWERS = [
    "I don't know.", "I will not be late.", "I can't see your screen, but I can tell you how to check it.", "The shop does not open on Sundays.", "Der Drucker kann das Papier nicht einziehen.", "Je ne peux pas dormir quand il fait chaud.",
    "No puedo dormir cuando hace calor.", "You can't go wrong with the blue one. It lasts for years and is easy to clean.", "Leider ist der Zug ausgefallen, der nächste fährt um neun.", "The court refused the request in May, and the city had to pay.",
    "I can't help you with the form itself. The fee is twelve euros and you pay it at the counter.", "That is not possible before June, because the road is closed.",
]


def test_refusals_written_by_hand():
    assert [t for t in REFUSALS if not pairs.is_refusal(t)] == []
    assert [t for t in ANSWERS if pairs.is_refusal(t)] == []


@pytest.mark.parametrize(
    "text, code",
    [
        ("What time does the library open on Sundays?", "en"), ("Kannst du mir sagen, wo der Schlüssel liegt?", "de"), ("Où se trouve la boulangerie la plus proche ?", "fr"), ("¿Dónde está la panadería más cercana?", "es"),
        ("Vorrei sapere dove si trova la stazione più vicina.", "it"), ("Gostaria de saber onde fica a estação mais próxima.", "pt"), ("Ik zou graag willen weten waar het station is.", "nl"), ("Jag skulle vilja veta var stationen ligger.", "sv"),
        ("Jeg vil gerne vide, hvor stationen ligger.", "da"), ("Chciałbym wiedzieć, gdzie jest najbliższa stacja.", "pl"), ("En yakın istasyonun nerede olduğunu bilmek istiyorum.", "tr"), ("Haluaisin tietää, missä lähin asema on.", "fi"),
        ("Я хотел бы знать, где ближайшая станция.", "ru"), ("最寄りの駅はどこですか。", "ja"), ("最近的车站在哪里？", "zh"), ("가장 가까운 역이 어디인지 알고 싶습니다.", "ko"), ("", None), (None, None), ("12 34", None),
    ],
)
def test_languages(text, code):
    assert languages.language(text)[0] == code


@pytest.mark.parametrize(
    "answer, wrong",
    [
        ("Il tempo sarà bello domani e potrai andare al mare con gli amici.", True), ("明日は天気がいいので、海に行けます。", True), ("Завтра будет хорошая погода, и можно поехать на море.", True), ("Tomorrow the weather will be fine, so you can go to the sea.", False),
        ("Tomorrow it will be fine. In German one says: morgen wird es schön sein. Take a hat with you.", False), ("```\nder die das und nicht wenn\n```\nThis prints six words.", False),
    ],
)
def test_answers_in_another_language(answer, wrong):
    assert pairs.wrong_language("Will the weather be good enough for the beach tomorrow?", answer) is wrong
    assert not pairs.wrong_language("Please answer in Italian, Russian or Japanese: will the weather be good tomorrow?", answer)


def test_long_answers_are_no_copies_whatever_their_length():
    assert not pairs.is_copy("Why is it so?", "Why is it so? " * 500)
    assert pairs.is_copy("Why is it so? " * 200, "WHY IS IT SO! " * 200)


def full_table(p, a, lost):
    prev = list(range(len(a) + 1))
    for i, x in enumerate(p, 1):
        row = [i]
        for j, y in enumerate(a, 1):
            same = x == y or (len(x) > 3 and pairs._close(x, y))
            row.append(min(prev[j] + 1, row[-1] + 3, prev[j - 1] + (0 if same else 3)))
        prev = row
    return prev[-1] <= lost


def test_copies_are_told_by_one_rule_at_any_length():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(6, 10)))
    text = [word() for _ in range(800)]
    assert pairs.is_copy(" ".join(text), " ".join(text[:300] + text[370:]))
    assert pairs.is_copy(" ".join(text), " ".join(text[100:]))
    assert not pairs.is_copy(" ".join(text), " ".join(text[101:]))
    assert not pairs.is_copy(" ".join(text), " ".join(r.sample(text, 800)))
    assert pairs.is_copy("Add ½ cup, ½ spoon, ½ tin, ½ jar and ½ bag.", "Add 1/2 cup, 1/2 spoon, 1/2 tin, 1/2 jar and 1/2 bag.".replace("/", "⁄"))


def test_alignment_equals_the_full_table():
    r = random.Random(9)
    few = ["the", "a", "lamp", "lamps", "clamp", "tree", "three", "is", "it", "plum"]
    seen = {True: 0, False: 0}
    for n in [r.randint(0, 40) for _ in range(1_500)] + [320, 330, 340, 350] * 3:
        p = [r.choice(few) for _ in range(n)]
        a = [w for w in p if r.random() > r.choice((0, 0.05, 0.15))]
        for _ in range(r.randint(0, 1 + n // 20)):
            at = r.randint(0, len(a))
            a[at : at + r.randint(0, 1)] = [r.choice(few)]
        lost = max(1, n // 8)
        if a and len(p) - lost - 1 <= len(a) <= len(p) + 1:
            want = full_table(p, a, lost)
            seen[want] += 1
            assert pairs._aligned(p, a, lost) == want, (p, a)
    assert min(seen.values()) > 100


def test_prefix_counts_equal_brute_force(spark):
    r = random.Random(4)
    words = ["sun", "sunny", "sand", "on", "only", "x", "9", "éa"]
    counts = {}
    for _ in range(600):
        u = " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
        counts[u] = counts.get(u, 0) + r.randint(1, 3)
    ends = r.sample(sorted(counts), 60) + ["su", "sunn", "nothing", "sun on"]
    df = spark.createDataFrame(sorted(counts.items()), "unit string, n bigint").repartition(5)
    got = {x.unit: (x.longer, x.inside) for x in pairs.continuations(df, spark.createDataFrame([(e,) for e in ends], "unit string")).collect()}
    want = {}
    for e in set(ends):
        longer = {u: n for u, n in counts.items() if u.startswith(e) and u != e}
        want[e] = (sum(longer.values()), sum(n for u, n in longer.items() if u[len(e)].isalnum()))
    assert got == want


def test_repeating_the_corpus_repeats_every_defect(spark, small):
    entries, conv = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("raw_entries", "conversations"))
    k = 4
    many = entries.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("entry_id", F.col("entry_id") * 10 + F.col("k"))
    more = conv.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("chat_id", F.concat("chat_id", F.lit("#"), F.col("k")))
    count = lambda df: {r.defect: r["count"] for r in df.groupBy("defect").count().collect()}
    one, all_ = count(pairs.found_defects(entries, conv)), count(pairs.found_defects(many, more))
    assert all_ == {d: n * k for d, n in one.items()}


def entry_defects(spark, answers):
    entries = spark.createDataFrame([(i, f"Prompted How do I use tool {i}?", [(a,)]) for i, a in enumerate(answers)], "entry_id bigint, title string, safeHtmlItem array<struct<html:string>>")
    conv = spark.createDataFrame([], "chat_id string, turns array<struct<turn_index:int,role:string,text:string>>")
    return {(int(r.record_key), r.defect) for r in pairs.found_defects(entries, conv).collect()}


def test_a_cut_seen_in_many_different_answers_is_no_set_phrase(spark):
    cut = [f"Take tool {w}. Then look at the pressure" for w in ("one", "two", "three", "four")]
    whole = [f"Use {w}. Then look at the pressure of the left tyre." for w in ("five", "six", "seven", "eight", "nine")]
    assert entry_defects(spark, cut + whole) == {(i, "truncated") for i in range(4)}


def test_a_unit_known_to_be_whole_needs_no_full_stop(spark):
    assert entry_defects(spark, ["First wait. Then clean the old brush", "Then clean the old brush. Wait.", "Look here. Then clean the old brush"]) == set()
