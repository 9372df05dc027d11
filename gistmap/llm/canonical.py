"""Free-entered terms mapped to a reference list with a BK-tree under the Levenshtein metric.

The trees hold the normalised reference entries and their aliases. A search returns every entry within the radius:
by the triangle inequality only children whose edge lies within the radius of the parent's distance are
visited. Among these candidates a term is taken for an entry only where the differences look like
ways of writing (typos, swaps of neighbouring letters, a lost space), word by word, and no differing word of
the term is another word of the reference vocabulary. A search is spared where no entry has words near those of the
term in the same places (a table of words with letters left out tells that exactly).

The reference list is collected only after its size (entries and characters) is checked. A larger list is split by
hash into shards of at most that size; the distinct terms are searched in each, and a shard tells its
candidates, the words they differ in and which of the term's words it knows. The rule about other words
is applied when the shards are merged, to the words of all, so any number of shards gives the same result.

With one shard the rows are mapped where they are, in Arrow batches, with a memory of terms per Python worker: no
shuffle, so a term that holds a third of all rows costs one search per worker.

Defined results: null and blank terms have no match (null id); a term that names no entry gets
``UNMATCHED``; of several entries equally near the lowest id is taken; an empty reference list
matches nothing; null canonicals and aliases are ignored, repeated ones keep the lowest id.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.runtime import scratch_table, spread, width

UNMATCHED = -1
#: Entries and characters of a list (or shard) that is broadcast.
MAX_BROADCAST, MAX_CHARACTERS = 100_000, 8_000_000
MAX_MEMORY = 500_000
#: Length from which a name may have so many typos.
TYPOS = ((20, 3), (9, 2), (5, 1))
#: Letters from which an alias of one word may have typos.
SHORT_ALIAS = 8
#: Letters an abbreviated word must keep.
STEM = 3

# Words put in front of a term that name nothing.
DETERMINERS = {"the", "a", "an", "this", "that", "these", "those", "my", "our", "your", "some"}


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("ches", "shes", "xes", "sses", "zes")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def plain(text: str) -> str:
    """Compatibility forms folded, marks removed, case folded; decoration and separators become spaces."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c if c.isalnum() or c in ".,'" else "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " " for c in text)


def forms(text: str) -> list[list[tuple[str, bool]]]:
    """The word orders a written term can stand for; each word with a mark whether it was cut short by a full stop."""
    text = plain(text).replace("'", " ").strip(" ,")
    orders = [text.replace(",", " ")]
    if "," in text:
        head, _, tail = text.partition(",")
        orders.insert(0, f"{tail.replace(',', ' ')} {head}")
    m = re.fullmatch(r"\s*(.+?)\s+of\s+(?:the\s+)?(.+?)\s*", text)
    if m:
        orders.append(f"{m[2]} {m[1]}".replace(",", " "))
    out = []
    for o in orders:
        words = []
        raw = o.split()
        for k, w in enumerate(raw):
            core = w.strip(".")
            # a full stop at the very end may close a sentence; elsewhere it cuts a word
            words += [(x, w.endswith(".")) if x == core.split(".")[-1] else (x, False) for x in core.split(".") if x]
        while len(words) > 1 and words[0][0] in DETERMINERS:
            words = words[1:]
        if words and words not in out:
            out.append(words)
    return out


class Pattern:
    """One string prepared for bit-parallel edit distances (insertions, deletions, replacements) to many."""

    __slots__ = ("mask", "peq", "size", "top")

    def __init__(self, a: str):
        self.size = len(a)
        self.peq: dict[str, int] = {}
        for i, ch in enumerate(a):
            self.peq[ch] = self.peq.get(ch, 0) | 1 << i
        self.mask, self.top = (1 << len(a)) - 1, 1 << len(a) >> 1

    def distance(self, b: str) -> int:
        score = self.size
        if not score or not b:
            return score + len(b)
        mask, top, get = self.mask, self.top, self.peq.get
        vp, vn = mask, 0
        for ch in b:
            eq = get(ch, 0)
            x = eq | vn
            d = ((x & vp) + vp ^ vp) | x
            hp = vn | ~(d | vp) & mask
            hn = vp & d
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = hp << 1 | 1
            vp = (hn << 1 | ~(d | hp)) & mask
            vn = hp & d & mask
        return score


def levenshtein(a: str, b: str) -> int:
    return Pattern(a).distance(b)


def typo_distance(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbouring letters counts once."""
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, prev = prev, row
    return prev[-1]


class BKTree:
    """Strings under the Levenshtein metric; ``within`` returns every string at most ``radius`` away."""

    def __init__(self) -> None:
        self.root, self.visited = None, 0

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        distance, node = Pattern(key).distance, self.root
        while True:
            d = distance(node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        distance = Pattern(key).distance
        found, stack = [], [self.root] if self.root else []
        while stack:
            name, children = stack.pop()
            self.visited += 1
            d = distance(name)
            if d <= radius:
                found.append((d, name))
            low, high = d - radius, d + radius
            stack += [child for edge, child in children.items() if low <= edge <= high]
        return found


def left_out(word: str, letters: int) -> set[str]:
    """The word with up to ``letters`` letters left out. Two words with that many typos or fewer share one."""
    out, last = {word}, {word}
    for _ in range(letters):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


#: Rank of a hit: equal spelling (by word order), the same words, then ways of writing by their number.
EQUAL, SAME_WORDS, WRITTEN = 0, 10, 20


class Matcher:
    """Terms to ids of one (shard of the) reference list: [(id, canonical, aliases)]."""

    def __init__(self, entries: list[tuple[int, str | None, list[str] | None]]):
        self.exact: dict[str, int] = {}
        self.sets: dict[str, int] = {}
        self.words: set[str] = set()
        #: Entries by number of words, place and word.
        self.by_word: dict[tuple[int, int, str], list[tuple[list[str], int]]] = {}
        # one tree per length: a term is never further from an entry in length than in edits
        self.trees: dict[int, BKTree] = {}
        self.ids: dict[str, int] = {}
        self.memory: dict[str, tuple[int, int]] = {}
        self.near_words: dict[str, set[str]] = {}
        self.near_joined: set[str] = set()
        self.word_memory: dict[str, set[str]] = {}
        for id_, canonical, aliases in sorted(entries, key=lambda e: e[0]):
            for name in [canonical, *(aliases or [])]:
                if not name or not forms(name):
                    continue
                words = [singular(w) for w, _ in forms(name)[-1]]
                key, joined = " ".join(words), "".join(words)
                self.exact.setdefault(key, id_)
                self.exact.setdefault(joined, id_)
                self.sets.setdefault(" ".join(sorted(words)), id_)
                self.words |= set(words)
                for k, w in enumerate(words):
                    self.by_word.setdefault((len(words), k, w), []).append((words, id_))
                # a short alias of one word is an abbreviation: with another letter it is another one
                if name is not canonical and len(words) == 1 and len(key) < SHORT_ALIAS:
                    continue
                if key not in self.ids:
                    self.ids[key] = id_
                    self.trees.setdefault(len(key), BKTree()).add(key)
                    self.near_joined |= left_out(joined, 1)
        for w in self.words:
            for x in left_out(w, 2):
                self.near_words.setdefault(x, set()).add(w)

    def near(self, word: str) -> set[str]:
        """Words of the list that may be at most two typos away (and all that are)."""
        hit = self.word_memory.get(word)
        if hit is None:
            if len(self.word_memory) > MAX_MEMORY:
                self.word_memory.clear()
            hit = self.word_memory[word] = set().union(*(self.near_words.get(x, ()) for x in left_out(word, 2)))
        return hit

    def find(self, term: str) -> tuple[int, int]:
        """(rank, id) of the best entry, or (99, UNMATCHED)."""
        hit = self.memory.get(term)
        if hit is None:
            if len(self.memory) > MAX_MEMORY:
                self.memory.clear()
            hits, _ = self.hits(term)
            hit = self.memory[term] = min(((r, i) for r, i, differ in hits if not self.words.intersection(differ)), default=(99, UNMATCHED))
        return hit

    def hits(self, term: str) -> tuple[list[tuple[int, int, list[str]]], list[str]]:
        """([(rank, id, words of the term that differ)], words of the term that the list has)."""
        out: list[tuple[int, int, list[str]]] = []
        orders = forms(term)
        singulars = [[singular(w) for w, _ in o] for o in orders]
        for k, words in enumerate(singulars):
            for j, key in enumerate((" ".join(words), "".join(words))):
                if key in self.exact:
                    out.append((EQUAL + 2 * k + j, self.exact[key], []))
            key = " ".join(sorted(words))
            if key in self.sets:
                out.append((SAME_WORDS + k, self.sets[key], []))
        if not out:
            for order, words in zip(orders, singulars):
                out += self._shortened(order)
                out += self._written(words)
        return out, sorted({w for o in singulars for w in o if w in self.words})

    def _shortened(self, order: list[tuple[str, bool]]) -> list[tuple[int, int, list[str]]]:
        """Entries of which one word is cut short by a full stop, the others as they are (or with a typo)."""
        hits = []
        for k, (w, cut) in enumerate(order):
            if not cut or len(w) < STEM or len(order) < 2:
                continue
            words = [singular(x) for x, _ in order]
            other = 0 if k else 1
            for near in self.near(words[other]):
                for full, id_ in self.by_word.get((len(order), other, near), []):
                    if full[k].startswith(w) and all(i == k or typo_distance(a, b) <= 1 for i, (a, b) in enumerate(zip(words, full))):
                        typos = sum(i != k and a != b for i, (a, b) in enumerate(zip(words, full)))
                        hits.append((WRITTEN + 1 + min(typos, 1), id_, []))
        return hits

    def _plausible(self, words: list[str]) -> bool:
        """Whether an entry has words near these in the same places."""
        nears = [self.near(w) for w in words]
        k = min(range(len(words)), key=lambda i: len(nears[i]))
        return any(all(f in near for f, near in zip(full, nears)) for w in nears[k] for full, _ in self.by_word.get((len(words), k, w), ()))

    def _written(self, words: list[str]) -> list[tuple[int, int, list[str]]]:
        """Entries that the words name with typos."""
        key = " ".join(words)
        edits = next((n for length, n in TYPOS if len(key) >= length), 0)
        if not edits:
            return []
        spaced = any(x in self.near_joined for x in left_out("".join(words), 1))
        if not spaced and not self._plausible(words):
            return []
        hits = []
        trees = [self.trees[n] for n in range(len(key) - edits, len(key) + edits + 1) if n in self.trees]
        for _, name in (hit for tree in trees for hit in tree.within(key, min(2 * edits, 4))):
            d = typo_distance(key, name)
            if d <= edits and (differ := _same_words(key, name)) is not None:
                hits.append((WRITTEN + d, self.ids[name], differ))
        return hits


def _same_words(key: str, name: str) -> list[str] | None:
    """The words of ``key`` that are written otherwise in ``name``; null where they are not the same words."""
    a, b = key.split(), name.split()
    if len(a) != len(b):
        # a lost or added space: all words of the longer one must be found in the other
        return [] if abs(len(a) - len(b)) == 1 and typo_distance("".join(a), "".join(b)) <= 1 else None
    differ = []
    for x, y in zip(a, b):
        if x == y:
            continue
        if typo_distance(x, y) > (1 if len(y) < 6 else 2):
            return None
        differ.append(x)
    return differ


#: The matcher of the list broadcast last, kept by a worker with its memory.
_KEPT: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    if shared.id not in _KEPT:
        _KEPT.clear()
        _KEPT[shared.id] = Matcher(shared.value)
    return _KEPT[shared.id]


class _Shared:
    """A broadcast list with a name of its own, by which workers know it again."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def match_terms(rows: DataFrame, reference: DataFrame, *, term: str = "term", out: str = "term_id", max_broadcast: int = MAX_BROADCAST, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """Add ``out`` to ``rows``: the term_id of the entry that ``term`` names, -1 where it names none."""
    spark = rows.sparkSession
    entries = reference.select(F.col("term_id").cast("bigint").alias("term_id"), "canonical", "aliases").where(F.col("term_id").isNotNull())
    letters = F.coalesce(F.length("canonical"), F.lit(0)) + F.coalesce(F.length(F.array_join("aliases", "")), F.lit(0))
    size, characters = entries.agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
    shards = max(1, -(-size // max_broadcast), -(-characters // max_characters))
    names = rows.columns
    at = names.index(term)

    def shared_list(part: DataFrame) -> _Shared:
        return _Shared(spark.sparkContext.broadcast([(r[0], r[1], list(r[2]) if r[2] is not None else None) for r in part.collect()]))

    if shards == 1:
        shared = shared_list(entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for b in batches:
                hits = [None if t is None or not t.strip() else matcher.find(t)[1] for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.int64())], names=[*names, out])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return spread(rows).mapInArrow(run, f"{schema}, `{out}` bigint")

    terms = scratch_table(rows.select(F.col(f"`{term}`").alias("term")).where(F.length(F.trim("term")) > 0).distinct(), "terms")
    hit = pa.struct([("rank", pa.int32()), ("id", pa.int64()), ("differ", pa.list_(pa.string()))])
    found = None
    for k in range(shards):
        shared = shared_list(entries.where(F.pmod(F.xxhash64("term_id"), F.lit(shards)) == k))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for b in batches:
                told = [matcher.hits(t) if t.strip() else ([], []) for t in b.column(0).to_pylist()]
                hits = pa.array([[{"rank": r, "id": i, "differ": d} for r, i, d in h] for h, _ in told], pa.list_(hit))
                yield pa.RecordBatch.from_arrays([b.column(0), hits, pa.array([v for _, v in told], pa.list_(pa.string()))], names=["term", "hits", "has"])

        part = terms.mapInArrow(search, "term string, hits array<struct<rank: int, id: bigint, differ: array<string>>>, has array<string>")
        found = part if found is None else found.unionByName(part)
    told = found.groupBy("term").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("has")).alias("has"))
    # an equal entry of any shard comes before what others take for a way of writing
    allowed = F.filter("hits", lambda h: ~F.arrays_overlap(h["differ"], F.col("has")))
    best = F.array_min(F.transform(allowed, lambda h: F.struct(h["rank"].alias("rank"), h["id"].alias("id"))))["id"]
    matched = told.select(F.col("term").alias("__term"), F.coalesce(best, F.lit(UNMATCHED).cast("bigint")).alias("__id"))
    joined = rows.join(matched, F.col(f"`{term}`") == F.col("__term"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], F.col("__id").alias(out))


def found_terms(keywords: DataFrame, reference: DataFrame) -> DataFrame:
    """(segment_id, term, term_id): one row per segment and term as written that is neither blank nor
    exactly a canonical."""
    rows = keywords.select("segment_id", F.explode(F.transform("keywords", lambda k: k["term"])).alias("term"))
    rows = rows.where(F.regexp_replace("term", r"[\s\p{Z}\p{C}]+", "") != "")
    # one shuffle serves the distinct rows and the search
    rows = rows.repartition(width(rows.sparkSession), "segment_id", "term").distinct()
    matched = match_terms(rows, reference)
    exact = reference.select(F.col("canonical").alias("term")).where(F.col("term").isNotNull()).distinct()
    return matched.join(exact, "term", "left_anti").select("segment_id", "term", "term_id")
