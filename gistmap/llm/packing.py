"""Filling windows of fixed capacity with texts, under control of the mixture of sources.

Items are sized in tokens of a public tokenizer. An item above the capacity is cut into full windows and
a rest (only such items are cut); everything else is placed whole. Windows are filled by deficit
round-robin: every source has a queue and earns, per window, its share of all tokens that are packed; the
source owed most is served, with the item that leaves least room for others to waste. Only the last part of a window
goes to whichever source closes it well. Every token given is paid with credit, and credit stays
with the source for the next windows, shards and rounds, so a window that one large item fills is made up for.

Items are spread by hash over shards of bounded size, packed shard by shard; what a shard could not fill well
(and the credit its sources are still owed) is carried to a second round, and so on, until one shard
holds the rest. So at most the windows of the last, bounded round stay loose.

Defined results: null and empty texts have no tokens and no row; a null source is a source of its own (``''``);
windows of null or non-positive capacity take nothing.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.llm.tokenizer import encode_texts
from gistmap.runtime import scratch_table

#: Items per shard, the fill from which a window is final before the last round, and candidates tried per pick.
SHARD, FULL, TRIED = 20_000, 0.985, 12
#: Share of a window up to which fit decides between sources; before, their credit does.
LATE = 0.2
#: Kinds of windows that can be filled in one run.
MAX_WINDOWS = 200

PLACED = "window_name string, round int, shard int, window int, slot int, source string, size int, doc_id bigint, part int, start bigint, final boolean, credit double"


class Queues:
    """One queue per source, sorted by size."""

    def __init__(self, items: list[tuple[int, int, str]], credit: dict[str, float], shares: dict[str, float] | None = None):
        self.by: dict[str, list[tuple[int, int]]] = {}
        for size, at, source in items:
            self.by.setdefault(source, []).append((size, at))
        for q in self.by.values():
            q.sort()
        total = sum(s for s, _, _ in items) or 1
        self.share = {k: sum(s for s, _ in q) / total if shares is None else shares[k] for k, q in self.by.items()}
        self.credit = {k: credit.get(k, 0.0) for k in self.by}
        self.sizes = sorted(s for s, _, _ in items)

    def largest(self, room: int) -> int:
        """Size of the largest waiting item that fits, 0 if none does."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, source: str, size: int) -> int:
        q = self.by[source]
        at = bisect.bisect_right(q, (size, 1 << 60)) - 1
        item = q.pop(at)
        self.sizes.pop(bisect.bisect_left(self.sizes, size))
        self.credit[source] -= size
        return item[1]

    def fitting(self, source: str, room: int) -> list[int]:
        """Up to TRIED sizes of the source that fit, the largest first, then spread over the rest."""
        q = self.by[source]
        hi = bisect.bisect_right(q, (room, 1 << 60))
        if not hi:
            return []
        step = max(1, hi // TRIED)
        return sorted({q[i][0] for i in range(hi - 1, max(-1, hi - 5), -1)} | {q[i][0] for i in range(hi - 1, -1, -step)}, reverse=True)


def fill_windows(items: list[tuple[int, int, str]], capacity: int, credit: dict[str, float], shares: dict[str, float] | None = None) -> tuple[list[list[int]], dict[str, float]]:
    """Windows (lists of item numbers) and the credit left, for items (size, number, source) that fit.
    ``shares``: of each source among all tokens; those of the items if null.

    While much of a window is free the source that is owed most is served; its item is the one after which two more items (of any
    source) can leave least room. In the last part of the window, where few sizes fit, sources are tried in the order of what
    they are owed until one closes the window well. What a source is given too much or too little is its credit in the next windows.
    """
    q = Queues(items, credit, shares)
    windows: list[list[int]] = []
    good = max(1, capacity // 256)
    while q.sizes:
        for s, share in q.share.items():
            q.credit[s] += share * capacity
        room, window = capacity, []
        while room and q.sizes and q.sizes[0] <= room:
            order = sorted((s for s, x in q.by.items() if x and x[0][0] <= room), key=lambda s: (-q.credit[s], s))
            if not window:
                # its largest item opens the window: it is the hardest to place later
                s = order[0]
                size = q.fitting(s, room)[0]
                window.append(q.take(s, size))
                room -= size
                continue
            free = room > LATE * capacity
            best = None
            for rank, s in enumerate(order[:1] if free else order):
                for size in q.fitting(s, room):
                    left = room - size
                    after = q.largest(left) if left else 0
                    # one copy of the picked item is no longer there to follow
                    if after == size and bisect.bisect_right(q.sizes, size) - bisect.bisect_left(q.sizes, size) < 2:
                        i = bisect.bisect_left(q.sizes, size)
                        after = q.sizes[i - 1] if i else 0
                    rest = left - after
                    third = q.largest(rest) if rest and after else 0
                    score = (max(0, rest - third - good), rank, -size)
                    if best is None or score < best[0]:
                        best = (score, s, size)
                if best is not None and best[0][0] == 0:
                    break
            _, s, size = best
            window.append(q.take(s, size))
            room -= size
        windows.append(window)
    return windows, q.credit


def _pack(round_: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owed = pdf[pdf["doc_id"].isna()]
        pdf = pdf[pdf["doc_id"].notna()].reset_index(drop=True)
        name = (pdf if len(pdf) else owed)["window_name"].iat[0]
        capacity, shard = int((pdf if len(pdf) else owed)["capacity"].iat[0]), int((pdf if len(pdf) else owed)["shard"].iat[0])
        credit = owed.groupby("source")["start"].sum().to_dict() if len(owed) else {}
        pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True)
        shares = dict(zip(pdf["source"], pdf["share"].astype(float)))
        windows, left = fill_windows(list(zip(pdf["size"].tolist(), range(len(pdf)), pdf["source"].tolist())), capacity, credit, shares)
        left = credit | left
        sizes = pdf["size"].to_numpy()
        rows, flags = [], []
        for w, members in enumerate(windows):
            final = last or int(sizes[members].sum()) >= FULL * capacity
            for slot, m in enumerate(members):
                rows.append((w, slot, m))
                flags.append(final)
        take = lambda c: pdf[c].tolist()
        source, doc, part, start = take("source"), take("doc_id"), take("part"), take("start")
        table = [(w, slot, source[m], int(sizes[m]), int(doc[m]), part[m], start[m], f, None) for (w, slot, m), f in zip(rows, flags)]
        if not last:
            table += [(-1, -1, s, capacity, None, 0, 0, False, float(c)) for s, c in sorted(left.items())]
        out = pd.DataFrame(table, columns=["window", "slot", "source", "size", "doc_id", "part", "start", "final", "credit"])
        out.insert(0, "shard", shard)
        out.insert(0, "round", round_)
        out.insert(0, "window_name", name)
        out["credit"] = out["credit"].astype(float)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack_documents(documents: DataFrame, windows: DataFrame, *, path: str | None = None, pattern: str | None = None, shard: int = SHARD) -> DataFrame:
    """(window_name, window_id, slot, doc_id, part, start_token, n_tokens, source) of every placed piece."""
    sized = encode_texts(documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where(F.length("text") > 0), ids="tokens", counts_only=True, path=path, pattern=pattern)
    sized = scratch_table(sized.where("tokens > 0 and doc_id is not null"), "sized")
    kinds = windows.select("window_name", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0 and window_name is not null").distinct()
    listed = sorted((r[0], r[1]) for r in kinds.limit(MAX_WINDOWS + 1).collect())
    if len(listed) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} kinds of window")
    if not listed:
        return sized.select(F.lit("").alias("window_name"), F.lit("").alias("window_id"), F.lit(0).alias("slot"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).alias("n_tokens"), "source").where(F.lit(False))
    each = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("capacity")) for n, c in listed])
    items = sized.select("*", F.inline(each)).withColumn("pieces", F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    items = items.select("window_name", "capacity", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
    start = F.col("part").cast("bigint") * F.col("capacity")
    items = items.select("window_name", "capacity", "source", "doc_id", "part", start.alias("start"), F.least(F.col("capacity").cast("bigint"), F.col("tokens") - start).cast("int").alias("size"))
    columns = ["window_name", "window_id", "slot", "doc_id", "part", "start_token", "n_tokens", "source"]
    whole = items.where(F.col("size") == F.col("capacity")).select(
        "window_name", F.concat(F.lit("full-"), F.col("doc_id"), F.lit("-"), F.col("part")).alias("window_id"), F.lit(0).alias("slot"), "doc_id", "part",
        F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "source",
    )
    rest = items.where(F.col("size") < F.col("capacity"))
    waiting = rest.select("window_name", "capacity", F.lit(0).alias("shard"), "source", "size", "doc_id", "part", "start")
    result, round_ = whole, 0
    n = sized.count()
    # the target: each source's part of the tokens that are still to be placed in windows of a kind
    shares = rest.groupBy("window_name", "source").agg(F.sum("size").alias("all"))
    shares = scratch_table(shares.select("window_name", "source", (F.col("all") / F.sum("all").over(Window.partitionBy("window_name"))).alias("share")), "shares")
    while True:
        shards = max(1, math.ceil(n / shard))
        last = shards == 1
        waiting = waiting.withColumn("shard", F.when(F.col("doc_id").isNull(), F.col("shard") % shards).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(round_)), F.lit(shards))).cast("int"))
        placed = waiting.join(shares, ["window_name", "source"]).groupBy("window_name", "shard").applyInPandas(_pack(round_, last), PLACED)
        placed = scratch_table(placed, "packed")
        done = placed.where(F.col("final")).select(
            "window_name", F.concat_ws("-", F.col("round"), F.col("shard"), F.col("window")).alias("window_id"), "slot", "doc_id", "part",
            F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "source",
        )
        result = result.unionByName(done)
        if last:
            return result.select(columns)
        left = placed.where(~F.col("final"))
        waiting = left.join(F.broadcast(kinds), "window_name").select(
            "window_name", "capacity", "shard", "source", "size", "doc_id", "part", F.when(F.col("doc_id").isNull(), F.col("credit").cast("bigint")).otherwise(F.col("start")).alias("start")
        )
        m = left.where("doc_id is not null").groupBy("window_name").count().agg(F.max("count")).first()[0] or 0
        # each round halves at least what it carries, or is the last
        n, round_ = (m if m < 0.5 * n else min(m, n // 2)), round_ + 1


def packing_report(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, windows, tokens, least_windows, fill, mean_deviation, worst_deviation, large_share, bare_deviation): how far packing is from
    the bound of the token sum, and windows from the mixture of all tokens.

    The deviation of a window is half the sum of the differences of its sources' shares from the target. ``large_share`` is the
    share of windows of which one item fills more than half; no order can bring these near the target.
    ``bare_deviation`` is the mean deviation of the others.
    """
    whole = placed.groupBy("window_name", "source").agg(F.sum("n_tokens").alias("all"))
    whole = whole.select("window_name", "source", (F.col("all") / F.sum("all").over(Window.partitionBy("window_name"))).alias("target"))
    got = placed.groupBy("window_name", "window_id", "source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("largest"))
    size = F.sum("n").over(Window.partitionBy("window_name", "window_id"))
    got = got.withColumn("size", size).join(F.broadcast(windows.select("window_name", F.col("capacity_tokens").alias("capacity"))), "window_name").join(whole, ["window_name", "source"])
    # a source that is not in the window is off by its whole target
    near = (F.sum(F.abs(F.col("n") / F.col("size") - F.col("target"))) + 1 - F.sum("target")) / 2
    per = got.groupBy("window_name", "window_id", "capacity").agg(near.alias("deviation"), F.first("size").alias("size"), F.max("largest").alias("largest"))
    large = F.col("largest") * 2 > F.col("capacity")
    out = per.groupBy("window_name", "capacity").agg(
        F.count("*").alias("windows"), F.sum("size").alias("tokens"), F.avg("deviation").alias("mean"), F.max("deviation").alias("worst"), F.avg(large.cast("int")).alias("large"), F.avg(F.when(~large, F.col("deviation"))).alias("bare")
    )
    return out.select(
        "window_name", "windows", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_windows"), F.round(F.col("tokens") / (F.col("windows") * F.col("capacity")), 4).alias("fill"),
        F.round("mean", 4).alias("mean_deviation"), F.round("worst", 4).alias("worst_deviation"), F.round("large", 4).alias("large_share"), F.round("bare", 4).alias("bare_deviation"),
    )
