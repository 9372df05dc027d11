"""Nearest neighbours, concepts and domains of segment vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmap.config import Concepts, Domains
from gistmap.functions.text import dot
from gistmap.operators import algos
from gistmap.runtime import files_by, read_files, scratch_table, width

#: Rows of a part of a cell, pivots of the cells, and rows they are taken from.
BLOCK, PIVOTS, SAMPLE = 4_096, 512, 4_096


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in column])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def knn(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(a, b, sim, rank) of the ``k`` most similar other rows (ties: smaller b); ``vectors``: (id, v), unit length.

    Exact. Rows go to the cell of the nearest of a bounded sample of pivots; a cell of more than ``block`` rows is cut by hash.
    These blocks are written once into the shared folder and no vector is shuffled to a partner: a task takes some blocks, finds
    the best among its own rows, and reads those other blocks that, by the triangle inequality, can hold something nearer than the
    k-th best found so far (their ball, the largest angle to the pivot, comes within that angle).
    """
    vectors = vectors.select("id", "v")
    kind = dict(vectors.dtypes)["id"]
    sample = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()
    if not len(sample):
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("sim"), F.lit(1).alias("rank")).where(F.lit(False))
    x = _unit(sample["v"])
    # farthest first: each pivot is the sampled row least like those before
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, max(1, math.isqrt(len(x)) * 2)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    shared = vectors.sparkSession.sparkContext.broadcast(x[chosen])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                s = _unit(pdf["v"]) @ shared.value.T
                cell = s.argmax(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1)))

    element, spark = dict(vectors.dtypes)["v"], vectors.sparkSession
    # ``no`` is in the order of the ids: ties go by it
    ordered = vectors.orderBy("id").withColumn("no", F.monotonically_increasing_id())
    cells = scratch_table(ordered.mapInPandas(place, f"id {kind}, v {element}, no bigint, cell int, angle double"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).orderBy("cell").collect()
    plan, balls = [], []
    for r in sizes:
        parts = math.ceil(r["n"] / block)
        plan.append((r["cell"], parts, len(balls)))
        balls += [(r["cell"], r["far"], r["n"] / parts)] * parts
    cuts = spark.createDataFrame(plan, "cell int, parts int, first int")
    rows = cells.join(F.broadcast(cuts), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    files = files_by(scratch_table(rows.select("id", "no", "v", "block").repartition(min(len(balls), width(spark)), "block"), "blocks", by="block"), "block")
    # shares of blocks, at least two for a core where the rows are enough
    goal = min(block, math.ceil(sum(r["n"] for r in sizes) / (2 * spark.sparkContext.defaultParallelism)))
    shares: list[list[int]] = [[]]
    held = 0.0
    for at in sorted(files):
        if shares[-1] and held + balls[at][2] / 2 > goal:
            shares.append([])
            held = 0.0
        shares[-1].append(at)
        held += balls[at][2]

    def read(blocks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = read_files([f for at in blocks for f in files[at]], ["id", "no", "v"]).combine_chunks()
        return t["id"].to_numpy(), t["no"].to_numpy(), np.asarray(pa.chunked_array(t["v"].chunks).combine_chunks().flatten(), float).reshape(len(t), -1)

    def nearest(share: list[int]) -> pd.DataFrame:
        ids, no, x = read(share)
        unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        angles = np.arccos(np.clip(unit @ shared.value.T, -1, 1))
        codes, names = pd.factorize(ids)
        names, kth = pd.Index(names), np.full(len(x), -np.inf)
        row, b, b_no, sim = np.zeros(0, int), ids[:0], no[:0], np.zeros(0)

        def meet(reach: np.ndarray, ids_b: np.ndarray, no_b: np.ndarray, y: np.ndarray) -> None:
            nonlocal row, b, b_no, sim
            known = names.get_indexer(ids_b)
            found = [(row, b, b_no, sim)]
            for at in range(0, len(reach), 1024):
                here = reach[at : at + 1024]
                s = x[here] @ y.T
                for j in np.flatnonzero(known >= 0):
                    s[codes[here] == known[j], j] = -np.inf
                least = kth[here]
                if k < s.shape[1] and np.isinf(least).any():
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                # what may reach the k-th best once rounded
                i, j = np.nonzero((s >= least[:, None] - 2e-9) & np.isfinite(s))
                found.append((here[i], ids_b[j], no_b[j], np.round(s[i, j], 9)))
            row, b, b_no, sim = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((b_no, -sim, row))
            ahead = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            order = order[ahead < k]
            row, b, b_no, sim = row[order], b[order], b_no[order], sim[order]
            full = ahead[ahead < k] == k - 1
            kth[row[full]] = sim[full]

        meet(np.arange(len(x)), ids, no, x)
        mine = set(share)
        middle = shared.value @ unit.mean(axis=0)
        for at in sorted(set(files) - mine, key=lambda at: -middle[balls[at][0]]):
            cell, far, _ = balls[at]
            limit = np.where(np.isinf(kth), math.pi, np.arccos(np.clip(kth, -1, 1)))
            reach = np.flatnonzero(angles[:, cell] - far <= limit + 1e-6)
            if len(reach):
                meet(reach, *read([at]))
        return pd.DataFrame({"a": ids[row], "b": b, "sim": sim})

    def run(batches):
        for pdf in batches:
            for share in pdf["id"]:
                yield nearest(shares[share])

    # written once: callers read it from both ends
    near = scratch_table(spark.range(0, len(shares), 1, len(shares)).mapInPandas(run, f"a {kind}, b {kind}, sim double"), "nearest")
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual(near: DataFrame) -> DataFrame:
    """(a, b), a < b, of pairs that are among each other's neighbours."""
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.select("a", "b").join(back, ["a", "b"], "left_semi").where("a < b")


def group_sums(members: DataFrame, by: str) -> DataFrame:
    """(``by``, sum vector ``s``, ``n``) of groups of (id, v, ``by``)."""
    flat = members.select(by, F.posexplode("v").alias("k", "x")).groupBy(by, "k").agg(F.sum(F.col("x").cast("double")).alias("x"))
    s = flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("s"))
    return s.join(members.groupBy(by).agg(F.count("*").alias("n")), by)


def intra_similarity(members: DataFrame, by: str) -> DataFrame:
    """Add ``intra``: mean similarity to the other members of the group, in closed form; alone: 0."""
    j = members.join(group_sums(members, by), by)
    return j.withColumn("intra", F.coalesce(F.try_divide(dot(F.col("v"), F.col("s")) - dot(F.col("v"), F.col("v")), F.col("n") - 1), F.lit(0.0))).drop("s")


def medoids(members: DataFrame, by: str) -> DataFrame:
    """(``by``, medoid): most similar to the group's centroid, members with a keyword (``has_kw``) first."""
    order = Window.partitionBy(by).orderBy(F.desc("has_kw"), F.desc(F.round("sim", 9)), "id")
    j = members.join(group_sums(members, by), by).withColumn("sim", dot(F.col("v"), F.col("s")))
    return j.withColumn("k", F.row_number().over(order)).where("k = 1").select(by, F.col("id").alias("medoid"))


def icf(cf: Column, communities: Column) -> Column:
    return F.log((communities + 1) / (cf + 1)) + 1.0


def presence(rows: DataFrame) -> DataFrame:
    """(community, term, tf, cf): segments of the community with the term, communities with the term."""
    tf = rows.select("community", "segment_id", "term").distinct().groupBy("community", "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("cf", F.count("*").over(Window.partitionBy("term")))


def community_labels(rows: DataFrame, words: int = 3) -> DataFrame:
    """(community, label): the best term by tf times icf with few enough words, else the best one cut short."""
    p = presence(rows)
    n = rows.agg(F.countDistinct("community").alias("n")).scalar()
    p = p.withColumn("score", F.round(F.col("tf") * icf(F.col("cf"), n), 9)).withColumn("short", (F.size(F.split("term", " ")) <= words).cast("int"))
    order = Window.partitionBy("community").orderBy(F.desc("short"), F.desc("score"), "term")
    best = p.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("community", F.when(F.col("short") == 1, F.col("term")).otherwise(F.array_join(F.slice(F.split("term", " "), 1, words), " ")).alias("label"))


def route(members: DataFrame, c: Domains = Domains()) -> DataFrame:
    """(id, domain): too dissimilar members, and those of communities that are then too small, go to the background."""
    bad = F.round("intra", 9) < c.min_similarity
    m = members.withColumn("surviving", F.count_if(~bad).over(Window.partitionBy("community")))
    return m.select("id", F.when(bad | (F.col("surviving") < c.min_size), c.background).otherwise(F.col("community").cast("string")).alias("domain"))


def majority(members: DataFrame, background: str = Domains().background) -> DataFrame:
    """(concept, domain): the most frequent domain of a concept's segments; ties: the one met first in text order."""
    g = members.withColumn("domain", F.coalesce("domain", F.lit(background))).groupBy("concept", "domain").agg(F.count("*").alias("n"), F.min("segment_id").alias("first"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "first"))).where("k = 1").select("concept", "domain")


def _in_one_task(rows: DataFrame, run, schema: str, most: int = algos.MAX_ROWS) -> DataFrame:
    """Run ``run`` over all rows in one task, after checking that they are few enough."""
    algos.check(rows.count(), most)
    return rows.groupBy(F.lit(0).alias("__one")).applyInPandas(run, schema)


def hdbscan_labels(vectors: DataFrame, c: Concepts = Concepts()) -> DataFrame:
    """(id, cluster): clusters by density, every noise row its own cluster (negative numbers)."""
    kind = dict(vectors.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        label = algos.hdbscan(np.stack(pdf["v"].to_list()).astype(float), c.min_cluster_size, c.min_samples)
        alone = -1 - np.arange(len(label))
        return pd.DataFrame({"id": pdf["id"], "cluster": np.where(label < 0, alone, label)})

    return _in_one_task(vectors.select("id", "v"), run, f"id {kind}, cluster bigint", algos.MAX_DENSITY_ROWS)


def ward_labels(vectors: DataFrame, clusters: int) -> DataFrame:
    kind = dict(vectors.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        return pd.DataFrame({"id": pdf["id"], "cluster": algos.ward(np.stack(pdf["v"].to_list()).astype(float), clusters)})

    return _in_one_task(vectors.select("id", "v"), run, f"id {kind}, cluster bigint")


def leiden_labels(ids: DataFrame, edges: DataFrame, gamma: float = Domains().gamma, seed: int = 42) -> DataFrame:
    """(id, community) of the graph on ``ids`` with ``edges`` (a, b); isolated ids stay alone."""
    kind = dict(ids.dtypes)["id"]
    rows = ids.select("id", F.lit(None).cast(kind).alias("b")).unionByName(edges.select(F.col("a").alias("id"), "b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["id"]) | set(pdf["b"].dropna()))
        at = {v: i for i, v in enumerate(nodes)}
        pairs = sorted((at[a], at[b]) for a, b in zip(pdf["id"], pdf["b"]) if not pd.isna(b))
        return pd.DataFrame({"id": nodes, "community": algos.leiden_cpm(len(nodes), pairs, gamma, seed)})

    # written once: the similarities within communities read it several times
    return scratch_table(rows.groupBy(F.lit(0).alias("__one")).applyInPandas(run, f"id {kind}, community bigint"), "communities")


def positions(vectors: DataFrame, n_neighbors: int = 10, min_dist: float = 0.05) -> DataFrame:
    """(id, x, y) of the neighbour layout."""
    kind = dict(vectors.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        y = algos.neighbour_layout(np.stack(pdf["v"].to_list()).astype(float), n_neighbors, min_dist)
        return pd.DataFrame({"id": pdf["id"], "x": y[:, 0], "y": y[:, 1]})

    return _in_one_task(vectors.select("id", "v"), run, f"id {kind}, x double, y double")


def spring_positions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, x, y) of the force-directed layout of the co-occurrence graph."""
    rows = nodes.select("term", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("w")).unionByName(edges.select(F.col("term_a").alias("term"), F.col("term_b").alias("other"), F.col("weight").alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["term"].unique())
        at = {v: i for i, v in enumerate(names)}
        es = sorted((at[a], at[b], w) for a, b, w in zip(pdf["term"], pdf["other"], pdf["w"]) if b is not None and b in at)
        p = algos.spring_layout(len(names), es)
        return pd.DataFrame({"term": names, "x": p[:, 0], "y": p[:, 1]})

    return rows.groupBy(F.lit(0).alias("__one")).applyInPandas(run, "term string, x double, y double")


def mixture(points: DataFrame, components: int = 60) -> DataFrame:
    """(component, weight, mx, my, cxx, cxy, cyy) of the variational mixture of (x, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, m, c = algos.dp_mixture(pdf.sort_values(["x", "y"])[["x", "y"]].to_numpy(float), components)
        return pd.DataFrame({"component": np.arange(len(w)), "weight": w, "mx": m[:, 0], "my": m[:, 1], "cxx": c[:, 0, 0], "cxy": c[:, 0, 1], "cyy": c[:, 1, 1]})

    return _in_one_task(points.select("x", "y"), run, "component int, weight double, mx double, my double, cxx double, cxy double, cyy double")


def grid(spark, coordinate_range: float, n: int) -> DataFrame:
    """(j, i, x, y) of a square grid, row-major in y."""
    step = 2 * coordinate_range / (n - 1)
    at = spark.range(n * n).select(F.floor(F.col("id") / n).alias("j"), (F.col("id") % n).alias("i"))
    return at.select("j", "i", (F.col("i") * step - coordinate_range).alias("x"), (F.col("j") * step - coordinate_range).alias("y"))


def log_joint(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Points with every component of a mixture (broadcast) and the log of weight times density."""
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    quad = (F.col("cyy") * dx * dx - 2 * F.col("cxy") * dx * dy + F.col("cxx") * dy * dy) / det
    j = points.join(F.broadcast(parts), F.col("weight") > 0)
    return j.withColumn("lp", F.log("weight") - math.log(2 * math.pi) - 0.5 * F.log(det) - 0.5 * quad)


def density_grid(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(j, i, log_density, normalized_density): log-sum-exp over the components, ordinal percentile over the grid."""
    j = log_joint(cells, parts)
    g = j.groupBy("j", "i").agg(F.max("lp").alias("top"), F.collect_list("lp").alias("all"))
    g = g.select("j", "i", (F.col("top") + F.log(F.aggregate(F.transform("all", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda s, v: s + v))).alias("log_density"))
    order = Window.orderBy(F.round("log_density", 9), "j", "i")
    return g.withColumn("normalized_density", (F.row_number().over(order) - 1) / (F.count("*").over(Window.partitionBy()) - 1))


def responsibilities(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, component, p): share of each component in a point's density."""
    j = log_joint(points, parts)
    top = F.max("lp").over(Window.partitionBy("id"))
    e = F.exp(F.col("lp") - top)
    return j.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("id"))).select("id", "component", "p")
