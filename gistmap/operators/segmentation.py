"""Topic-cohesive segments of conversations: windows, similarity trajectories, boundaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Segmentation
from gistmap.functions.text import dot, words
from gistmap.runtime import scratch_table, width


def sliding_texts(turns: DataFrame, w: int = 2) -> DataFrame:
    """(chat_id, i, text) of overlapping windows of ``w`` turns; a chat of fewer turns has none."""
    order = Window.partitionBy("chat_id").orderBy("turn_index")
    frame = order.rowsBetween(0, w - 1)
    rows = turns.select(
        "chat_id", (F.row_number().over(order) - 1).alias("i"), F.collect_list(F.coalesce("text", F.lit(""))).over(frame).alias("t")
    )
    return rows.where(F.size("t") == w).select("chat_id", "i", F.concat_ws("\n", "t").alias("text"))


def trajectory(windows: DataFrame) -> DataFrame:
    """(chat_id, b, sim): similarity of neighbouring window vectors (chat_id, i, v)."""
    order = Window.partitionBy("chat_id").orderBy("i")
    nxt = F.lead("v").over(order)
    return windows.select("chat_id", F.col("i").alias("b"), F.when(nxt.isNotNull(), dot(F.col("v"), nxt)).alias("sim")).where("sim is not null")


def depths(sims: DataFrame, lookback: int = 3) -> DataFrame:
    """Add the peaks on both sides, and the depth of each point below them."""
    order = Window.partitionBy("chat_id").orderBy("b")
    left = F.coalesce(F.max("sim").over(order.rowsBetween(-lookback, -1)), F.col("sim"))
    right = F.coalesce(F.max("sim").over(order.rowsBetween(1, lookback)), F.col("sim"))
    return sims.withColumn("left_peak", left).withColumn("right_peak", right).withColumn("depth", F.col("left_peak") + F.col("right_peak") - 2 * F.col("sim"))


def thresholds(deep: DataFrame, z: float = 1.0) -> DataFrame:
    """Add the chat's depth threshold: mean plus z population deviations; null below three points."""
    chat = Window.partitionBy("chat_id")
    enough = F.count("*").over(chat) >= 3
    return deep.withColumn("threshold", F.when(enough, F.avg("depth").over(chat) + z * F.stddev_pop("depth").over(chat)))


def hard_shifts(windows: DataFrame, c: Segmentation = Segmentation()) -> DataFrame:
    """(chat_id, turn): boundaries where similarity dips deep and low."""
    return hard_of(trajectory(windows), c)


def hard_of(sims: DataFrame, c: Segmentation = Segmentation()) -> DataFrame:
    t = thresholds(depths(sims, c.lookback), c.z)
    hit = (F.round(F.col("depth") - F.col("threshold"), 12) > 0) & (F.round("depth", 12) > 0) & (F.col("sim") < c.max_similarity)
    return t.where(hit).select("chat_id", (F.col("b") + 1).alias("turn"))


def drift_sims(windows: DataFrame, anchors: int = 3) -> DataFrame:
    """(chat_id, i, sim): similarity to the mean of the first ``anchors`` windows, for chats of more windows."""
    first = windows.where(F.col("i") < anchors).select("chat_id", F.posexplode("v").alias("k", "x"))
    mean = first.groupBy("chat_id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a")).select("chat_id", F.transform("a", lambda s: s["x"]).alias("a"))
    norm = F.sqrt(dot(F.col("a"), F.col("a")))
    mean = mean.select("chat_id", F.when(norm > 0, F.transform("a", lambda x: x / norm)).otherwise(F.col("a")).alias("a"))
    many = windows.groupBy("chat_id").agg(F.count("*").alias("n")).where(F.col("n") > anchors).select("chat_id")
    return windows.join(many, "chat_id", "left_semi").join(mean, "chat_id").select("chat_id", "i", dot(F.col("v"), F.col("a")).alias("sim"))


def drift_starts(windows: DataFrame, tolerance: float = 0.15, run: int = 3) -> DataFrame:
    """(chat_id, turn): start of the first run of ``run`` windows away from the beginning."""
    return drift_of(drift_sims(windows), tolerance, run)


def drift_of(sims: DataFrame, tolerance: float = 0.15, run: int = 3) -> DataFrame:
    order = Window.partitionBy("chat_id").orderBy("i").rowsBetween(-(run - 1), 0)
    below = F.when(F.col("sim") < 1 - tolerance, 1).otherwise(0)
    r = sims.withColumn("below", below).withColumn("all_below", (F.min("below").over(order) == 1) & (F.count("*").over(order) == run))
    return r.where("all_below").groupBy("chat_id").agg((F.min("i") - (run - 1)).alias("turn"))


def boundaries(windows: DataFrame, n_turns: DataFrame, c: Segmentation = Segmentation()) -> DataFrame:
    """(chat_id, turn, boundary_type) strictly inside each chat; a hard shift wins over drift."""
    return boundaries_of(trajectory(windows), drift_sims(windows), n_turns, c)


def boundaries_of(sims: DataFrame, drifts: DataFrame, n_turns: DataFrame, c: Segmentation = Segmentation()) -> DataFrame:
    hard = hard_of(sims, c).withColumn("boundary_type", F.lit("hard_shift"))
    drift = drift_of(drifts, c.drift_tolerance, c.drift_min_consecutive).withColumn("boundary_type", F.lit("drift"))
    # the parts of a union may be coalesced differently: what is joined to it needs a shuffle of its own
    both = hard.unionByName(drift).repartition("chat_id").groupBy("chat_id", "turn").agg(F.max("boundary_type").alias("boundary_type"))
    return both.join(n_turns, "chat_id").where((F.col("turn") > 0) & (F.col("turn") < F.col("n_turns"))).select("chat_id", "turn", "boundary_type")


def bounds(cuts: DataFrame, n_turns: DataFrame) -> DataFrame:
    """(chat_id, seg_index, start_turn, end_turn, boundary_type): one segment more than boundaries."""
    begin = n_turns.select("chat_id", F.lit(0).cast("bigint").alias("start_turn"), F.lit(None).cast("string").alias("boundary_type"))
    starts = begin.unionByName(cuts.select("chat_id", F.col("turn").cast("bigint").alias("start_turn"), "boundary_type")).repartition("chat_id").join(n_turns, "chat_id")
    order = Window.partitionBy("chat_id").orderBy("start_turn")
    return starts.select(
        "chat_id", (F.row_number().over(order) - 1).alias("seg_index"), "start_turn", F.coalesce(F.lead("start_turn").over(order), F.col("n_turns")).alias("end_turn"), "boundary_type"
    )


def word_counts(turns: DataFrame, by: list[str]) -> DataFrame:
    return turns.groupBy(*by).agg(F.sum(F.size(words(F.coalesce("text", F.lit(""))))).alias("word_count"))


def core_labels(segs: DataFrame) -> DataFrame:
    """Label the longest segment of a chat (the first of equals) core, the others tangent."""
    order = Window.partitionBy("chat_id").orderBy(F.desc("word_count"), "seg_index")
    return segs.withColumn("label", F.when(F.row_number().over(order) == 1, "core").otherwise("tangent"))


def numbered(turns: DataFrame) -> DataFrame:
    """(chat_id, at, words): the turns of a chat counted from 0, with their number of words."""
    counted = turns.select("chat_id", "turn_index", F.size(words(F.coalesce("text", F.lit("")))).alias("words"))
    order = Window.partitionBy("chat_id").orderBy("turn_index")
    return counted.select("chat_id", (F.row_number().over(order) - 1).alias("at"), "words")


def similarities(turns: DataFrame, encode: Callable[[str], list[float]], w: int = 2, anchors: int = 3) -> DataFrame:
    """(chat_id, at, words, sim, drifts) of every turn. The window that ends at the turn gives ``sim``, its similarity to the window before, and
    ``drifts``, that to the mean of the first ``anchors`` windows; the last of these gives theirs too. Rows pass in the order of the chat, so
    a task holds the vectors of a few windows, however long a chat is, and no vector is stored."""

    def run(batches):
        chat, at, texts, before, first, mean = None, -1, [], None, [], None
        for pdf in batches:
            sims, drifts, places = [], [], []
            for c, text in zip(pdf["chat_id"], pdf["text"]):
                if c != chat:
                    chat, at, texts, before, first, mean = c, -1, [], None, [], None
                at, sim, drift = at + 1, None, []
                texts = [*texts, text][-w:]
                if len(texts) == w:
                    v = np.array(encode("\n".join(texts)))
                    if before is not None:
                        sim = along(before, v)
                    if mean is not None:
                        drift = [along(v, mean)]
                    elif len(first) < anchors:
                        first.append(v)
                        if len(first) == anchors:
                            mean = sum(first[1:], first[0]) / anchors
                            norm = np.sqrt(along(mean, mean))
                            mean = mean / norm if norm > 0 else mean
                            drift = [along(x, mean) for x in first]
                    before = v
                sims.append(sim)
                drifts.append(drift)
                places.append(at)
            yield pd.DataFrame({"chat_id": pdf["chat_id"], "at": places, "words": pdf["words"], "sim": pd.array(sims, "Float64"), "drifts": drifts})

    rows = turns.select("chat_id", "turn_index", F.coalesce("text", F.lit("")).alias("text"), F.size(words(F.coalesce("text", F.lit("")))).alias("words"))
    rows = rows.repartition(width(turns.sparkSession), "chat_id").sortWithinPartitions("chat_id", "turn_index")
    return rows.mapInPandas(run, "chat_id string, at int, words int, sim double, drifts array<double>")


def along(a: np.ndarray, b: np.ndarray) -> float:
    """Dot product, added in the order of the components as ``dot`` does."""
    return float(np.cumsum(a * b)[-1])


def segment_turns(turns: DataFrame, encode: Callable[[str], list[float]], c: Segmentation = Segmentation(), w: int = 2, anchors: int = 3) -> DataFrame:
    """``segment_chats`` from the texts of the turns; only numbers are written."""
    t = scratch_table(similarities(turns, encode, w, anchors), "similarities")
    sims = t.where("sim is not null").select("chat_id", (F.col("at") - w).alias("b"), "sim")
    drifts = t.select("chat_id", (F.col("at") - w + 2 - F.size("drifts")).alias("i0"), F.posexplode("drifts").alias("k", "sim"))
    many = t.groupBy("chat_id").agg(F.count("*").alias("n")).where(F.col("n") - w + 1 > anchors).select("chat_id")
    drifts = drifts.join(many, "chat_id", "left_semi").select("chat_id", (F.col("i0") + F.col("k")).alias("i"), "sim")
    return _segments(t.select("chat_id", "at", "words"), sims, drifts, c)


def segment_chats(turns: DataFrame, windows: DataFrame, c: Segmentation = Segmentation()) -> DataFrame:
    """The segments of all chats: short chats are one core segment, the others are cut at their boundaries."""
    return _segments(numbered(turns), trajectory(windows), drift_sims(windows), c)


def _segments(rows: DataFrame, sims: DataFrame, drifts: DataFrame, c: Segmentation) -> DataFrame:
    """Segments of numbered turns (chat_id, at, words), cut where similarities say. What is read more than once is written first: one plan of all
    of it has so many shuffles of the same key that adaptive execution may join parts of different numbers."""
    n = scratch_table(rows.groupBy("chat_id").agg(F.count("*").alias("n_turns")), "lengths")
    long_chats = n.where(F.col("n_turns") >= c.min_turns)
    here = long_chats.select("chat_id")
    cuts = boundaries_of(sims.join(here, "chat_id", "left_semi"), drifts.join(here, "chat_id", "left_semi"), long_chats, c)
    segs = scratch_table(bounds(scratch_table(cuts, "cuts"), n), "bounds")
    order = Window.partitionBy("chat_id").orderBy("at")
    # a turn is in the segment that started last: starts are marked and counted along the chat
    starts = segs.select("chat_id", F.col("start_turn").alias("at"), F.lit(1).alias("start"))
    along_chat = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.join(starts, ["chat_id", "at"], "left").withColumn("seg_index", F.count("start").over(along_chat).cast("int") - 1)
    counts = inside.groupBy("chat_id", "seg_index").agg(F.sum("words").alias("word_count"))
    segs = core_labels(segs.join(counts, ["chat_id", "seg_index"]))
    return segs.select(
        F.concat("chat_id", F.lit("::seg"), "seg_index").alias("segment_id"), "chat_id", "start_turn", "end_turn", (F.col("end_turn") - F.col("start_turn")).alias("turn_count"),
        "word_count", "boundary_type", "label",
    )
