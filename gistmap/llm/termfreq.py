"""Occurrences and record counts of every distinct term, by burst tries.

Rows are first folded to (record, term) pairs with their number of occurrences: the key holds both,
so neither a frequent term nor a record with very many rows gathers in one task. Each task then
counts its pairs in a burst trie, whose containers turn into inner nodes when they hold too many
suffixes, and sends every subtree on as one compact row per route. Routes are the leaf prefixes of
a trie over a bounded sample of terms, so busy beginnings get longer prefixes. How many routes there are, into how many
shares the terms of a route are divided, and how many tasks merge them grows with an estimate of the distinct terms; all this
steers balance only, never results. The receiving task merges matching subtrees and lists the totals. A trie that
has grown to ``TRIE_TERMS`` is sent on and begun anew, so no task holds more than it can.

Defined results: a term is lower-cased and loses spaces (U+0020) at its ends, nothing else; null
and empty terms and null arrays count nowhere; every segment_id counts once, also where its row is
repeated (rows without segment_id are each their own segment); a null record id is no record, so such
occurrences count but add no record. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmap.runtime import scratch_table, spread, width

#: Terms (at most) sampled for the routes, terms of a route, and terms that one task merges.
ROUTE_SAMPLE, ROUTE_TERMS, TASK_TERMS = 100_000, 2_000, 200_000
#: Terms a trie counts before its subtrees are sent on.
TRIE_TERMS = 500_000
#: Suffixes a container holds before it bursts.
CONTAINER = 64
#: Entries in one row sent between tasks.
ROW_ENTRIES = 4_096


class BurstTrie:
    """Strings with two counters each. Inner nodes map a character to a subtree; containers are
    dicts of suffixes that burst into an inner node beyond ``limit``."""

    __slots__ = ("limit", "root", "terms")

    def __init__(self, limit: int = CONTAINER):
        self.limit = limit
        self.root: tuple | dict = {}
        self.terms = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        parent, node, at = None, self.root, 0
        while isinstance(node, list):  # [children, own counters]
            if at == len(term):
                own = node[1]
                own[0] += occurrences
                own[1] += records
                return
            parent, node = node, node[0].setdefault(term[at], {})
            at += 1
        rest = term[at:]
        had = node.get(rest)
        if had is not None:
            had[0] += occurrences
            had[1] += records
            return
        node[rest] = [occurrences, records]
        self.terms += 1
        if len(node) > self.limit:
            grown = self._burst(node)
            if parent is None:
                self.root = grown
            else:
                parent[0][term[at - 1]] = grown

    def _burst(self, container: dict) -> list:
        children: dict[str, dict] = {}
        own = [0, 0]
        for rest, count in container.items():
            if rest:
                children.setdefault(rest[0], {})[rest[1:]] = count
            else:
                own = count
        return [children, own]

    def containers(self) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(prefix, [(suffix, occurrences, records)]) of every container, in no particular order."""
        stack: list[tuple[str, dict | list]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, list):
                if node[1][0]:
                    yield prefix, [("", *node[1])]
                stack += [(prefix + ch, child) for ch, child in node[0].items()]
            elif node:
                yield prefix, [(s, c[0], c[1]) for s, c in node.items()]

    def absorb(self, prefix: str, entries) -> None:
        """Merge a subtree that another worker counted under ``prefix``."""
        for suffix, occurrences, records in entries:
            self.add(prefix + suffix, occurrences, records)


def normal_term(term: Column) -> Column:
    return F.nullif(F.lower(F.trim(term)), F.lit(""))


def segment_terms(keywords: DataFrame) -> DataFrame:
    """(segment_id, chat_id, term) of each keyword, every segment once."""
    rows = keywords.select("segment_id", "chat_id", F.transform("keywords", lambda k: k["term"]).alias("terms"))
    known = rows.where(F.col("segment_id").isNotNull()).groupBy("segment_id").agg(F.min(F.struct("chat_id", "terms")).alias("r"))
    known = known.select("segment_id", "r.chat_id", "r.terms")
    rows = known.unionByName(rows.where(F.col("segment_id").isNull()))
    return rows.select("segment_id", "chat_id", F.explode("terms").alias("term"))


def _routes(terms: DataFrame, rows: int, distinct: int) -> tuple[list[str], int]:
    """(routes, shares of a route) for about ``distinct`` terms."""
    wanted = max(256, distinct // ROUTE_TERMS)
    routes = min(wanted, ROUTE_SAMPLE // 8)
    sample = [r[0] for r in terms.sample(min(1.0, 1.5 * 16 * routes / max(1, rows)), seed=7).limit(ROUTE_SAMPLE).collect()]
    trie = BurstTrie(max(1, len(sample) // routes))
    for t in sample:
        trie.add(t, 1, 1)
    return sorted({p for p, _ in trie.containers() if p}), max(1, -(-wanted // routes))


def count_terms(rows: DataFrame, term: str = "term", record: str = "chat_id") -> DataFrame:
    """(term, occurrences, records) of every distinct non-null value of ``term``."""
    rows = rows.select(F.col(term).alias("term"), F.col(record).alias("record")).where(F.col("term").isNotNull())
    pairs = scratch_table(rows.groupBy("record", "term").agg(F.count("*").alias("n")), "pairs")
    total, distinct = pairs.agg(F.count("*"), F.approx_count_distinct("term")).first()
    routes, shares = _routes(pairs.select("term"), total, distinct)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(routes)
        depth = max(map(len, routes), default=0)
        trie = BurstTrie()
        for b in batches:
            for rec, t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                trie.add(t, n, rec is not None)
            if trie.terms >= TRIE_TERMS:
                yield from sent(trie, known, depth)
                trie = BurstTrie()
        yield from sent(trie, known, depth)

    def sent(trie: BurstTrie, known: frozenset[str], depth: int) -> Iterator[pa.RecordBatch]:
        subtrees: dict[tuple[str, int], list] = {}
        for prefix, entries in trie.containers():
            for suffix, occ, rec in entries:
                t = prefix + suffix
                route = next((t[:k] for k in range(min(depth, len(t)), 0, -1) if t[:k] in known), t[:1])
                share = zlib.crc32(t.encode("utf-8", "surrogatepass")) % shares if shares > 1 else 0
                subtrees.setdefault((route, share), []).append((t[len(route) :], occ, int(rec)))
        for (route, share), entries in subtrees.items():
            for i in range(0, len(entries), ROW_ENTRIES):
                part = entries[i : i + ROW_ENTRIES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([route]), pa.array([share], pa.int32()), pa.array([[e[0] for e in part]]), pa.array([[e[1] for e in part]], pa.list_(pa.int64())), pa.array([[e[2] for e in part]], pa.list_(pa.int64()))],
                    names=["route", "share", "suffixes", "occurrences", "records"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            for route, suffixes, occ, rec in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                trie.absorb(route, zip(suffixes, occ, rec))
        for prefix, entries in trie.containers():
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + e[0] for e in entries]), pa.array([e[1] for e in entries], pa.int64()), pa.array([e[2] for e in entries], pa.int64())],
                names=["term", "occurrences", "records"],
            )

    subtrees = spread(pairs).mapInArrow(build, "route string, share int, suffixes array<string>, occurrences array<bigint>, records array<bigint>")
    # a task for so many terms; small tables are left to the session's width
    tasks = max(width(rows.sparkSession), -(-distinct // TASK_TERMS))
    return subtrees.repartition(tasks, "route", "share").mapInArrow(merge, "term string, occurrences bigint, records bigint")


def marked_terms(keywords: DataFrame, *, rare_below: int = 3, common_share: int = 20) -> DataFrame:
    """(term, occurrences, records, mark): mark is ``rare`` below ``rare_below`` chats, ``common`` in more than
    one ``common_share``-th of all chats of the table, else null."""
    terms = segment_terms(keywords).withColumn("term", normal_term(F.col("term")))
    counted = count_terms(terms)
    total = keywords.agg(F.countDistinct("chat_id").alias("n")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share > total, "common")
    return counted.withColumn("mark", mark)
