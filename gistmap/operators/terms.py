"""Keywords: frequencies, canonical forms, phrases, concepts, ranking."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Keywords, Phrases
from gistmap.functions import text as X

#: Accepted pairs that may be sent to all tasks in one merge pass.
MAX_PAIRS = 500_000


def listed(rows: DataFrame) -> list:
    """The rows on the driver, at most ``MAX_PAIRS``; more are refused."""
    got = rows.limit(MAX_PAIRS + 1).collect()
    if len(got) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} accepted pairs or phrases for one merge pass")
    return got


def chat_keywords(terms: DataFrame) -> DataFrame:
    """(chat_id, term, count) from segment terms."""
    return terms.groupBy("chat_id", "term").agg(F.count("*").alias("count"))


def frequencies(terms: DataFrame, of: str, name: str) -> DataFrame:
    """(term, ``name``): distinct values of ``of`` per term."""
    return terms.select("term", of).distinct().groupBy("term").agg(F.count("*").alias(name))


def kept_terms(keywords: DataFrame, at_least: int) -> DataFrame:
    return keywords.groupBy("term").agg(F.count("*").alias("chat_count")).where(F.col("chat_count") >= at_least)


def first_labels(terms: DataFrame) -> DataFrame:
    """(term, entity_label): the label a term has where it is first seen."""
    return terms.groupBy("term").agg(F.min_by("entity_label", F.struct("segment_id", "pos")).alias("entity_label"))


def segment_labels(terms: DataFrame) -> DataFrame:
    """(segment_id, top): the best scored term, the first of equals."""
    return terms.groupBy("segment_id").agg(F.max_by("term", F.struct("score", -F.col("pos"))).alias("top"))


def prune_substrings(terms: DataFrame) -> DataFrame:
    """Drop terms contained in another, different term of the same segment."""
    a, b = terms.alias("a"), terms.select("segment_id", "term").alias("b")
    inside = (F.col("a.segment_id") == F.col("b.segment_id")) & (F.col("a.term") != F.col("b.term")) & F.col("b.term").contains(F.col("a.term"))
    return a.join(b, inside, "left_anti")


def merge_lemmas(counts: DataFrame, by: list[str]) -> DataFrame:
    """Single words with the same lemma become one term: the lemma if it occurs, else the shortest form."""
    lemma = F.when(F.col("term").contains(" "), F.col("term")).otherwise(X.singular(F.col("term")))
    rows = counts.withColumn("lemma", lemma)
    name = F.min_by("term", F.struct((F.col("term") != F.col("lemma")).cast("int"), F.length("term"), "term"))
    return rows.groupBy(*by, "lemma").agg(name.alias("term"), F.sum("count").alias("count")).drop("lemma")


def drop_modifier_singletons(counts: DataFrame) -> DataFrame:
    return counts.where(~(F.col("term").isin(X.MODIFIER_NOUNS) & (F.col("count") <= 1)))


#: Targets of one first letter that one share of a block compares.
TARGETS = 2_000


def apply_map(terms: DataFrame, mapping: DataFrame, column: str = "term") -> DataFrame:
    """Replace terms by ``mapping`` (source, target); terms without an entry stay."""
    m = mapping.select(F.col("source").alias(column), F.col("target").alias("__target"))
    return terms.join(m, column, "left").withColumn(column, F.coalesce("__target", column)).drop("__target")


def regroup(terms: DataFrame) -> DataFrame:
    """One row per (segment, term) after mapping: best score, first position, first label that is not null."""
    label = F.min_by("entity_label", F.when(F.col("entity_label").isNotNull(), F.col("pos")))
    return terms.groupBy("segment_id", "chat_id", "term").agg(F.max("score").alias("score"), F.min("pos").alias("pos"), label.alias("entity_label"))


def _shapes(c: Column) -> Column:
    """A word and all forms of it with one letter less: words one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), cut))


def dictionary_snap(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, target): the most frequent lexicon word one edit away (ties: first), for words not in the lexicon."""
    a = words.join(lexicon.select("word"), "word", "left_anti").select("word", F.explode(_shapes(F.col("word"))).alias("shape"))
    b = lexicon.select(F.col("word").alias("target"), "freq", F.explode(_shapes(F.col("word"))).alias("shape"))
    near = a.join(b, "shape").select("word", "target", "freq").distinct().where(F.levenshtein("word", "target") == 1)
    return near.groupBy("word").agg(F.min_by("target", F.struct(-F.col("freq"), "target")).alias("target"))


def _letters(c: Column) -> Column:
    """The letters of a word as bits (26 for a to z, 6 shared by all others)."""
    bit = lambda ch: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.when(F.ascii(ch).between(97, 122), F.ascii(ch) - 97).otherwise(26 + F.pmod(F.ascii(ch), F.lit(6))).cast("int"))
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda acc, ch: F.when(ch == "", acc).otherwise(acc.bitwiseOR(bit(ch))))


def typo_pairs(freqs: DataFrame, c: Keywords = Keywords()) -> DataFrame:
    """(term, target, target_freq): single words that look like a much more frequent word with the same first letter.

    Words meet by first letter, length and a share of the longer blocks; a bound from the letters that only one of them has
    leaves the string similarity few pairs. The bound is exact: with k letters of a word missing in the other at most length - k
    letters match.
    """
    single = freqs.where(F.col("term").rlike(r"^\p{L}+$")).withColumn("letter", F.substring("term", 1, 1)).withColumn("size", F.length("term"))
    single = single.withColumn("letters", _letters(F.lower("term")))
    # a target is as many times more frequent as its source, so at least that frequent
    targets = single.where(F.col("freq") >= c.freq_ratio).select(F.col("term").alias("target"), F.col("freq").alias("target_freq"), "letter", F.col("size").alias("target_size"), F.col("letters").alias("target_letters"))
    # a length ratio below 0.4 cannot reach 0.88: jaro is at most (1 + ratio + 1) / 3, the prefix gives at most 0.4 of the rest
    lengths = F.sequence(F.ceil(F.col("target_size") * 0.4).cast("int"), F.floor(F.col("target_size") * 2.5).cast("int"))
    # blocks of many targets are shared out: each source goes to every share, each target to one
    blocks = targets.groupBy("letter").agg(F.ceil(F.count("*") / TARGETS).cast("int").alias("shares"))
    a = single.join(F.broadcast(blocks), "letter").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    b = targets.join(F.broadcast(blocks), "letter").withColumn("share", F.pmod(F.xxhash64("target"), F.col("shares")).cast("int")).withColumn("size", F.explode(lengths))
    j = a.join(b.drop("shares"), ["letter", "size", "share"]).where((F.col("term") != F.col("target")) & (F.col("target_freq") >= c.freq_ratio * F.col("freq")))
    only = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    most = F.least(F.col("size") - only("letters", "target_letters"), F.col("target_size") - only("target_letters", "letters"))
    jaro = (most / F.col("size") + most / F.col("target_size") + 1) / 3
    same = lambda k: F.substring("term", 1, k) == F.substring("target", 1, k)
    prefix = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).otherwise(1)
    j = j.where((most > 0) & (jaro + prefix * 0.1 * (1 - jaro) >= c.jaro_winkler - 1e-9))
    return j.select("term", "target", "target_freq").where(X.jaro_winkler("term", "target") >= c.jaro_winkler)


def typo_targets(freqs: DataFrame, c: Keywords = Keywords()) -> DataFrame:
    """(source, target): the most frequent word each term is a likely typo of."""
    best = F.min_by("target", F.struct(-F.col("target_freq"), "target"))
    return typo_pairs(freqs, c).groupBy(F.col("term").alias("source")).agg(best.alias("target"))


def best_contexts(terms: DataFrame, size: int = 4) -> DataFrame:
    """(term, context): in a term's best scored segment, up to ``size`` other terms in their order."""
    order = Window.partitionBy("term").orderBy(F.desc("score"), "segment_id", "pos")
    best = terms.withColumn("k", F.row_number().over(order)).where("k = 1").select("segment_id", "term")
    lists = terms.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]).alias("all"))
    j = best.join(lists, "segment_id")
    return j.select("term", F.concat_ws(", ", F.slice(F.filter("all", lambda x: x != F.col("term")), 1, size)).alias("context"))


def specific_labels(members: DataFrame, total_segments: Column | int, *, boost: float = 1.3, least: int = 2) -> DataFrame:
    """(concept, label): of a concept's members (term, centrality, segment_freq, entity_label) the most central and
    specific one; members in fewer than ``least`` segments count only if there is no other."""
    entity = F.col("entity_label").isin("WORK_OF_ART", "PERSON", "ORG", "GPE")
    weight = F.col("centrality") * F.log((F.lit(total_segments) + 1) / (F.col("segment_freq") + 1)) * F.when(entity, boost).otherwise(1.0)
    m = members.withColumn("fit", (F.col("segment_freq") >= least).cast("int"))
    order = Window.partitionBy("concept").orderBy(F.desc("fit"), F.desc(F.round(weight, 9)), "term")
    return m.withColumn("k", F.row_number().over(order)).where("k = 1").select("concept", F.col("term").alias("label"))


# --- phrases ------------------------------------------------------------------------------------


def tokens(turns: DataFrame, stop: list[str]) -> DataFrame:
    """(chat_id, turn_index, pos, token): lower-case words; stopwords leave a gap in ``pos``."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    rows = turns.where("text is not null").select("chat_id", "turn_index", F.posexplode(ws).alias("pos", "token"))
    return rows.where(~F.col("token").isin(stop) & (F.length("token") >= 2))


def bigrams(toks: DataFrame) -> DataFrame:
    """(chat_id, turn_index, pos, prev, token) of neighbouring tokens."""
    order = Window.partitionBy("chat_id", "turn_index").orderBy("pos")
    r = toks.withColumn("prev", F.lag("token").over(order)).withColumn("at", F.lag("pos").over(order))
    return r.where(F.col("at") == F.col("pos") - 1).select("chat_id", "turn_index", "pos", "prev", "token")


def npmi(pair: Column, a: Column, b: Column, total: Column) -> Column:
    p = pair / total
    value = F.log2(p / ((a / total) * (b / total))) / -F.log2(p)
    return F.when((pair == 0) | (a == 0) | (b == 0), -1.0).when(p >= 1, 1.0).otherwise(value)


def scored_bigrams(toks: DataFrame) -> DataFrame:
    """(a, b, n, npmi) of all neighbouring pairs."""
    uni = toks.groupBy("token").agg(F.count("*").alias("c"))
    pairs = bigrams(toks).groupBy(F.col("prev").alias("a"), F.col("token").alias("b")).agg(F.count("*").alias("n"))
    total = toks.agg(F.count("*").alias("n")).scalar()
    j = pairs.join(uni.select(F.col("token").alias("a"), F.col("c").alias("ca")), "a").join(uni.select(F.col("token").alias("b"), F.col("c").alias("cb")), "b")
    return j.select("a", "b", "n", npmi(F.col("n"), F.col("ca"), F.col("cb"), total).alias("npmi"))


def prune_redundant(phrases: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Drop a phrase contained, word by word, in a longer one that is nearly as frequent."""
    ws = F.split("phrase", " ")
    n = F.size("w")
    longer = phrases.select(F.col("phrase").alias("longer"), F.col("count").alias("lc"), ws.alias("w")).where(n >= 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("w", i, k), " "))))
    parts = longer.select("longer", "lc", F.explode(F.array_distinct(spans)).alias("phrase")).where(F.col("phrase") != F.col("longer"))
    return phrases.join(parts, "phrase", "left").groupBy("phrase", "count").agg(F.max(F.coalesce(F.col("lc") >= ratio * F.col("count"), F.lit(False))).alias("gone")).where("not gone").drop("gone")


def _merger(accepted):
    """Greedy left-to-right merging of accepted neighbouring pairs in one sequence."""

    def one(items, pairs):
        out, i = [], 0
        while i < len(items):
            pos, tok = items[i]["pos"], items[i]["token"]
            if i + 1 < len(items) and items[i + 1]["pos"] == pos + tok.count(" ") + 1 and (tok, items[i + 1]["token"]) in pairs:
                out.append({"pos": pos, "token": f"{tok} {items[i + 1]['token']}"})
                i += 2
            else:
                out.append({"pos": pos, "token": tok})
                i += 1
        return out

    @F.pandas_udf("array<struct<pos:int,token:string>>")
    def merge(s: pd.Series) -> pd.Series:
        pairs = accepted.value
        return s.map(lambda items: one(items, pairs))

    return merge


def phrase_segmenter(phrases, longest: int = 3):
    """Replace runs of neighbouring words by known phrases, the longest first, left to right."""

    def one(items, known):
        out, i = [], 0
        while i < len(items):
            for k in range(min(longest, len(items) - i), 1, -1):
                run = items[i : i + k]
                if all(run[j]["pos"] == run[0]["pos"] + j for j in range(k)) and " ".join(r["token"] for r in run) in known:
                    out.append(" ".join(r["token"] for r in run))
                    i += k
                    break
            else:
                out.append(items[i]["token"])
                i += 1
        return out

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        known = phrases.value
        return s.map(lambda items: one(items, known))

    return run


def detect_phrases(turns: DataFrame, stop: list[str], c: Phrases = Phrases()) -> DataFrame:
    """(phrase, count, npmi): pairs that occur together, merged greedily and counted again up to ``max_words`` words."""
    toks = tokens(turns, stop)
    seq = toks.groupBy("chat_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    hits = None
    for _ in range(max(c.max_words - 1, 1)):
        flat = seq.select("chat_id", "turn_index", F.inline("s"))
        flat = flat.withColumn("width", F.size(F.split("token", " ")))
        order = Window.partitionBy("chat_id", "turn_index").orderBy("pos")
        pair = flat.withColumn("nxt", F.lead("token").over(order)).withColumn("np", F.lead("pos").over(order)).where(F.col("np") == F.col("pos") + F.col("width"))
        pairs = pair.groupBy(F.col("token").alias("a"), F.col("nxt").alias("b")).agg(F.count("*").alias("n"))
        uni = flat.groupBy("token").agg(F.count("*").alias("c"))
        total = flat.agg(F.count("*").alias("n")).scalar()
        j = pairs.join(uni.select(F.col("token").alias("a"), F.col("c").alias("ca")), "a").join(uni.select(F.col("token").alias("b"), F.col("c").alias("cb")), "b")
        ok = j.select("a", "b", "n", npmi(F.col("n"), F.col("ca"), F.col("cb"), total).alias("npmi")).where((F.col("n") >= c.min_pair) & (F.col("npmi") >= c.min_npmi))
        ok = ok.where(F.size(F.split("a", " ")) + F.size(F.split("b", " ")) <= c.max_words)
        found = ok.select(F.concat_ws(" ", "a", "b").alias("phrase"), F.col("n").alias("count"), "npmi")
        hits = found if hits is None else hits.unionByName(found)
        listed = ok.select("a", "b").limit(MAX_PAIRS + 1).collect()
        if len(listed) > MAX_PAIRS:
            raise ValueError("too many accepted pairs for one merge pass")
        if not listed:
            break
        accepted = turns.sparkSession.sparkContext.broadcast({(r[0], r[1]) for r in listed})

        seq = seq.withColumn("s", _merger(accepted)("s"))
    hits = hits.groupBy("phrase").agg(F.max("count").alias("count"), F.max("npmi").alias("npmi"))
    return prune_redundant(hits.select("phrase", "count"), c.redundancy).join(hits.select("phrase", "npmi"), "phrase")


# --- ranking ------------------------------------------------------------------------------------


def mmr_order(terms: list[str], relevance: np.ndarray, vectors: np.ndarray, k: int, lam: float, hard: float) -> list[int]:
    """Greedy maximal marginal relevance; terms sharing half their words exclude each other as far as possible."""
    bags = [set(t.lower().split()) for t in terms]
    of: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            of.setdefault(w, []).append(i)
    chosen: list[int] = []
    penalty = np.zeros(len(terms))
    while len(chosen) < min(k, len(terms)):
        score = relevance.astype(float) if not chosen else lam * relevance - (1 - lam) * penalty
        score[chosen] = -np.inf
        at = int(score.argmax())
        chosen.append(at)
        # only terms with a word in common share any (without words: nothing)
        near = vectors @ vectors[at]
        if hard <= 0:
            near[:] = 1.0
        for i in {i for w in bags[at] for i in of[w]}:
            share = len(bags[i] & bags[at]) / len(bags[i] | bags[at])
            near[i] = 1.0 if share >= hard else max(float(near[i]), share)
        near = np.maximum(near, 0.0)
        penalty = np.maximum(penalty, near)
    return chosen


def rank_by_mmr(candidates: DataFrame, c: Keywords = Keywords()) -> DataFrame:
    """(segment_id, pos, term, score) of the chosen terms; ``candidates``: segment_id, term, relevance, v, pos. One segment per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        picked = mmr_order(pdf["term"].tolist(), pdf["relevance"].to_numpy(), np.stack(pdf["v"].to_list()), c.top_k, c.mmr_lambda, c.jaccard_hard)
        out = pdf.loc[picked, ["segment_id", "term", "relevance"]].reset_index(drop=True)
        out["step"] = np.arange(len(out))
        out = out.sort_values(["relevance", "step"], ascending=[False, True], ignore_index=True)
        out["pos"] = np.arange(len(out))
        return out.rename(columns={"relevance": "score"})[["segment_id", "pos", "term", "score"]]

    return candidates.select("segment_id", "term", "relevance", "v", "pos").groupBy("segment_id").applyInPandas(run, "segment_id string, pos int, term string, score double")


def rank_texts(texts: DataFrame, found: DataFrame, c: Keywords = Keywords(), prune: bool = False) -> DataFrame:
    """(segment_id, pos, term, score): ``rank_by_mmr`` of the candidates ``found`` (segment_id, term) by their likeness to the text of their segment,
    with hashed vectors; with ``prune`` without terms contained in another chosen one. Vectors are made where they are used: only texts and terms are shuffled."""
    from gistmap.operators.embedding import hashed_vector

    def run(batches):
        memory = lru_cache(maxsize=20_000)(lambda t: np.array(hashed_vector(t)))
        for pdf in batches:
            out = []
            for segment, text, terms in zip(pdf["segment_id"], pdf["text"], pdf["terms"]):
                terms = list(terms)
                v = np.stack([memory(t) for t in terms])
                # added in the order of the components, as ``dot`` does
                relevance = np.round(np.cumsum(np.array(hashed_vector(text)) * v, axis=1)[:, -1], 9)
                picked = mmr_order(terms, relevance, v, c.top_k, c.mmr_lambda, c.jaccard_hard)
                picked.sort(key=lambda i: -relevance[i])
                chosen = [terms[i] for i in picked]
                out += [(segment, at, terms[i], float(relevance[i])) for at, i in enumerate(picked) if not (prune and any(terms[i] != t and terms[i] in t for t in chosen))]
            yield pd.DataFrame(out, columns=["segment_id", "pos", "term", "score"])

    lists = found.groupBy("segment_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return texts.join(lists, "segment_id").select("segment_id", "text", "terms").mapInPandas(run, "segment_id string, pos int, term string, score double")


# Marks of names of people and organisations.
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?"
_KIND = r"(?:Inc|Ltd|LLC|Corp|GmbH|AG|University|Institute|Foundation|Company|Group|Bank|Museum|Council)"
_CAPS = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*"


def entities(segment_texts: DataFrame) -> DataFrame:
    """(segment_id, term, entity_label) of names that their form tells: people after a title, organisations
    before a word for one, quoted titles. Terms are in lower case, of two words or more."""
    found = lambda pattern, label: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lower(t).alias("term"), F.lit(label).alias("entity_label")))
    all_ = F.concat(
        found(rf"{_TITLE} ({_CAPS})", "PERSON"), found(rf"({_CAPS} {_KIND})(?!\p{{L}})", "ORG"), found(r"[\"“„«]\s?(\p{Lu}[\p{L}'-]+(?: [\p{L}'-]+){1,7})\s?[\"”»]", "WORK_OF_ART")
    )
    rows = segment_texts.where("text is not null").select("segment_id", F.inline(all_)).where(F.col("term").contains(" "))
    return rows.groupBy("segment_id", "term").agg(F.min("entity_label").alias("entity_label"))


def candidates(segment_texts: DataFrame, most_words: int = 3) -> DataFrame:
    """(segment_id, term, entity_label): names that their form tells, and runs of content words between stopwords and punctuation.
    A run of more than ``most_words`` words is no term. ``segment_texts``: one row per segment_id."""
    from pyspark.ml.feature import StopWordsRemover

    stop = sorted({w for lang in ("english", "german", "spanish", "french") for w in StopWordsRemover.loadDefaultStopWords(lang)} | set(X.STOPWORDS) | set(X.MODIFIER_NOUNS))
    clean = X.strip_non_discursive(F.col("text"))
    parts = segment_texts.select("segment_id", F.posexplode(F.split(F.lower(clean), r"(?U)[^\p{L}\p{N}' -]+")).alias("run", "part"))
    flat = parts.select("segment_id", "run", F.posexplode(X.words(F.col("part"))).alias("i", "w"))
    flat = flat.withColumn("stop", F.col("w").isin(stop) | (F.length("w") < 2))
    order = Window.partitionBy("segment_id", "run").orderBy("i")
    flat = flat.withColumn("g", F.sum(F.col("stop").cast("int")).over(order)).where("not stop")
    runs = flat.groupBy("segment_id", "run", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("ws")).where(F.size("ws") <= most_words)
    term = X.repair_boundary(X.strip_determiner(F.array_join("ws", " ")))
    out = runs.select("segment_id", term.alias("term")).where(X.is_valid_term(F.col("term")) & ~X.ends_with_fragment(F.col("term")))
    both = out.select("segment_id", "term", F.lit(None).cast("string").alias("entity_label")).unionByName(entities(segment_texts))
    return both.groupBy("segment_id", "term").agg(F.min("entity_label").alias("entity_label"))
