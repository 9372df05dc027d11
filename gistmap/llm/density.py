"""Similarity clusters of segment vectors by density peaks.

1. Usable vectors (right length, finite, not zero) are normalised; equal vectors (by a 128-bit key) become one
   representative with a weight. Later steps carry the key, not the vector.
2. Blocks: a bounded sample gives pivots; vectors go to the nearest pivot's cell and an angle band, and
   cells are packed into blocks of bounded size (a crowded cell is split by hash). By the triangle
   inequality of angles a pair of blocks is compared only if two of its vectors can be within the link
   angle; every link is found, nothing is sampled or capped. The number of blocks is bounded by
   ``MAX_BLOCKS``: beyond, blocks grow and are multiplied tile by tile. Every block is written once, to the shared
   folder, and tasks read the blocks they compare from there: disk does not grow with the pairs of blocks.
3. First join of blocks: weighted neighbour counts (local density), an XOR fingerprint of the closed
   neighbourhood and the blocks that hold neighbours. Pairs never leave the task, only sums per vector do.
4. Second join, of the vectors that have neighbours in each other's block: the most similar denser neighbour of each
   vector (to four decimals; ties: the denser, then the smaller id). A vector without one is a peak. Pointers are
   followed by doubling, each round cut with a checkpoint.

Defined results: null, zero, non-finite vectors and such of another length are in no cluster; a repeated
segment_id counts once (its smallest vector); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmap.runtime import cut, discard, files_by, read_files, scratch_table

DIM = 128
LINK, DENSE = 0.70, 0.75
PIVOT_SAMPLE, MAX_PIVOTS = 4_096, 1_024
#: A block is read once for each partner: large blocks have few, and a pair of them is still small for a task.
BLOCK, MAX_BLOCKS, TILE = 16_384, 4_096, 1_024
#: Partners that one task compares its block with, and tasks of a join, at most.
AT_ONCE, MAX_TASKS = 64, 10_000
#: Similarities this close to a threshold are computed again in double precision.
SLACK = 1e-5


def _unit_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(segment_id, key, vec): unit vectors as float32 bytes with their key; rows without one are left out."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            size = np.sqrt((flat * flat).sum(axis=1))
            ok = np.isfinite(size) & (size > 0)
            unit = (flat[ok] / size[ok, None]).astype(np.float32)
            flat_bytes = [v.tobytes() for v in unit]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in flat_bytes]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(keys, pa.binary()), pa.array(flat_bytes, pa.binary())], names=["segment_id", "key", "vec"])

    return rows.mapInArrow(norm, "segment_id string, key binary, vec binary")


def _right_length(embeddings: DataFrame, dim: int) -> DataFrame:
    return embeddings.where(F.col("segment_id").isNotNull() & (F.size("embedding") == dim)).select("segment_id", "embedding")


def usable_vectors(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(segment_id, key, vec): unit vectors as float32 bytes with their key, one per segment."""
    return _unit_vectors(_right_length(embeddings, dim).groupBy("segment_id").agg(F.min("embedding").alias("embedding")), dim)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1)


def _pivots(embeddings: DataFrame, dim: int) -> np.ndarray:
    """Leaders of a bounded sample: vectors less than DENSE similar to all leaders before."""
    rows = _unit_vectors(_right_length(embeddings, dim), dim)
    sample = rows.orderBy(F.xxhash64("segment_id"), "segment_id", "key").limit(PIVOT_SAMPLE).select("vec").toPandas()["vec"]
    if not len(sample):
        return np.zeros((0, DIM), np.float32)
    x = _matrix(sample)
    chosen = [0]
    best = x @ x[0]
    for i in range(1, len(x)):
        if best[i] < DENSE and len(chosen) < MAX_PIVOTS:
            chosen.append(i)
            best = np.maximum(best, x @ x[i])
    return x[chosen]


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot, the angle to it and its band of 10 degrees: the same for equal vectors, whatever rows are beside them."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(names.index("vec")).to_pylist())
            sims = x @ p.T
            cell, best = sims.argmax(axis=1), sims.max(axis=1)
            # the product of matrices may differ in the last bits with their shape; where that matters, row by row
            for r in np.flatnonzero((sims >= best[:, None] - SLACK).sum(axis=1) > 1):
                near = np.flatnonzero(sims[r] >= best[r] - SLACK)
                cell[r] = near[_dots(np.broadcast_to(x[r], (len(near), x.shape[1])), p[near]).argmax()]
            angle = np.degrees(np.arccos(np.clip(_dots(x, p[cell]), -1, 1))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array((angle // 10).astype(np.int32))], names=[*names, "cell", "angle", "band"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, cell int, angle float, band int")


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products row by row in double precision."""
    return np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))


def _plan(sizes: list, pivots: np.ndarray, link: float) -> tuple[dict, list[list[int]]]:
    """Blocks from (cell, band, count, largest angle): {(cell, band): (first, parts)} and, for each block, its partners."""
    total = sum(r["n"] for r in sizes)
    block = max(BLOCK, math.ceil(total / MAX_BLOCKS))
    near = (pivots @ pivots[:: max(1, len(pivots) // 32)].T).argmax(axis=1)
    where, members, fill = {}, [], block
    for r in sorted(sizes, key=lambda r: (r["band"] >= 5, near[r["cell"]], r["cell"], r["band"])):
        if r["n"] > block // 2:
            parts = math.ceil(r["n"] / block)
            where[r["cell"], r["band"]] = (len(members), parts)
            members += [[r]] * parts
            fill = block
            continue
        if fill + r["n"] > block:
            members.append([])
            fill = 0
        where[r["cell"], r["band"]] = (len(members) - 1, 1)
        members[-1].append(r)
        fill += r["n"]
    centres, radii = [], []
    for m in members:
        p = pivots[[r["cell"] for r in m]].astype(np.float64)
        c = p.mean(axis=0)
        c /= max(np.linalg.norm(c), 1e-12)
        radii.append(max(math.degrees(math.acos(min(1, max(-1, float(v @ c))))) + r["far"] for v, r in zip(p, m)))
        centres.append(c)
    c = np.array(centres)
    gap = np.degrees(np.arccos(np.clip(c @ c.T, -1, 1)))
    reach = np.add.outer(radii, radii) + math.degrees(math.acos(link)) + 0.1
    meets = np.triu(gap <= reach) | np.eye(len(members), dtype=bool)
    return where, [[int(j) for j in np.flatnonzero(meets[i] | meets[:, i])] for i in range(len(members))]


def _blocks(rows: DataFrame, where: dict) -> DataFrame:
    """(block, key, rep, weight, mark, vec): equal vectors in one row; a scratch table with a folder for each block."""
    shared = rows.sparkSession.sparkContext.broadcast(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            ids, keys, marks, cells, bands = (b.column(c).to_pylist() for c in ("segment_id", "key", "mark", "cell", "band"))
            copies: dict[bytes, list[int]] = {}
            for k, key in enumerate(keys):
                copies.setdefault(key, []).append(k)
            out = []
            for key, of in copies.items():
                first, parts = at[cells[of[0]], bands[of[0]]]
                out.append((first + int.from_bytes(key[:6]) % parts, key, min(ids[k] for k in of), len(of), functools.reduce(operator.xor, (marks[k] for k in of))))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, b.column("vec").take(pa.array([of[0] for of in copies.values()], pa.int64()))], names=["block", "key", "rep", "weight", "mark", "vec"])

    folded = rows.select("segment_id", "key", "mark", "vec", "cell", "band").mapInArrow(run, "block int, key binary, rep string, weight bigint, mark bigint, vec binary")
    folded = folded.repartition("block").groupBy("block", "key").agg(F.min("rep").alias("rep"), F.sum("weight").alias("weight"), F.bit_xor("mark").alias("mark"), F.first("vec").alias("vec"))
    return scratch_table(folded, "blocks", by="block")


def _join(spark: SparkSession, partners: list[list[int]], work: Callable, schema: str) -> DataFrame:
    """What ``work`` (block, partners) gives for every pair of blocks, each pair once; tasks read the blocks themselves."""
    later = [[j for j in js if j >= i] for i, js in enumerate(partners)]
    step = max(1, min(AT_ONCE, sum(map(len, later)) // (8 * spark.sparkContext.defaultParallelism)))
    units = [(i, js[k : k + step]) for i, js in enumerate(later) for k in range(0, len(js), step)]
    shared = spark.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                for pdf in filter(len, work(*shared.value[k])):
                    yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return spark.range(0, len(units), 1, min(len(units), MAX_TASKS)).mapInArrow(run, schema)


def _links(x: np.ndarray, n: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, similarities) of the linked pairs between the first ``n`` rows and the others, tile by tile and both ways
    round; of all rows if it is the ``same`` block."""
    left = np.arange(n)
    right = left if same else np.arange(n, len(x))
    for at in range(0, len(left), TILE):
        a = left[at : at + TILE]
        for to in range(0, len(right), TILE * 4):
            b = right[to : to + TILE * 4]
            s = x[a] @ x[b].T
            u, v = np.nonzero(s >= LINK - SLACK)
            sim = s[u, v]
            p, q = a[u], b[v]
            for t in (LINK, DENSE):
                close = np.flatnonzero(np.abs(sim - t) < SLACK)
                exact = _dots(x[p[close]], x[q[close]])
                sim[close] = np.where(exact >= t, t + 2 * SLACK, t - 2 * SLACK)
            linked = sim >= LINK
            p, q, sim = p[linked], q[linked], sim[linked]
            yield p, q, sim
            if not same:
                yield q, p, sim


def _densities(i: int, partners: list[int], blocks: dict[int, list[str]]) -> Iterator[pd.DataFrame]:
    def read(k: int) -> dict[str, np.ndarray]:
        t = read_files(blocks[k], ["rep", "weight", "mark", "vec"])
        return {c: t[c].to_numpy() for c in ("rep", "weight", "mark")} | {"x": _matrix(t["vec"].to_pylist()), "block": np.full(len(t), k, np.int32)}

    own = read(i)
    for j in partners:
        both = own
        if j != i:
            other = read(j)
            both = {c: np.concatenate([own[c], other[c]]) for c in own}
        n, weight, mark = len(both["rep"]), both["weight"], both["mark"]
        linked, dense, seal = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for p, q, sim in _links(both["x"], len(own["rep"]), i == j):
            close = sim >= DENSE
            np.add.at(linked, p, weight[q])
            np.add.at(dense, p[close], weight[q[close]])
            np.bitwise_xor.at(seal, p, mark[q])
        keep = linked > 0
        # the block that holds neighbours; a vector and its copies are none
        at = pd.array(np.where(both["block"] == i, j, i)[keep], "Int32")
        if j == i:
            at[linked[keep] == weight[keep]] = None
        yield pd.DataFrame({"block": both["block"][keep], "rep": both["rep"][keep], "linked": linked[keep], "dense": dense[keep], "seal": seal[keep], "at": at})


def _denser(i: int, partners: list[int], blocks: dict[int, list[str]], densities: dict[int, list[str]]) -> Iterator[pd.DataFrame]:
    def read(k: int) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
        """Columns, and the rows that have neighbours in each block."""
        t, d = read_files(blocks[k], ["rep", "vec"]), read_files(densities[k], ["rep", "dense", "places"])
        d = d.take(pc.index_in(t["rep"].combine_chunks(), d["rep"].combine_chunks()))
        places = d["places"].combine_chunks()
        rows, place = np.repeat(np.arange(len(d)), pc.list_value_length(places).to_numpy()), places.flatten().to_numpy()
        by = np.argsort(place, kind="stable")
        rows, place = rows[by], place[by]
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, int)
        return {"rep": t["rep"].to_numpy(), "dense": d["dense"].to_numpy(), "x": _matrix(t["vec"].to_pylist())}, dict(zip(place[cuts].tolist(), np.split(rows, cuts[1:])))

    own, own_rows = read(i)
    for j in partners:
        if j not in own_rows:
            continue
        both = {c: v[own_rows[j]] for c, v in own.items()}
        if j != i:
            other, other_rows = read(j)
            both = {c: np.concatenate([v, other[c][other_rows[i]]]) for c, v in both.items()}
        reps, dense = both["rep"], both["dense"]
        # rank of density within the pair: larger density first, then smaller id
        order = np.lexsort((reps.astype(str), -dense))
        rank = np.empty(len(reps), np.int64)
        rank[order] = np.arange(len(reps))
        best, who = np.full(len(reps), -2.0), np.full(len(reps), -1)
        for p, q, sim in _links(both["x"], len(own_rows[j]), i == j):
            up = rank[q] < rank[p]
            # four decimals are the same whatever the shape of a tile
            p, q, sim = p[up], q[up], np.round(sim[up].astype(np.float64), 4)
            by = np.lexsort((rank[q], -sim, p))
            p, q, sim = p[by], q[by], sim[by]
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, int)
            p, q, sim = p[first], q[first], sim[first]
            better = (sim > best[p]) | ((sim == best[p]) & (who[p] >= 0) & (rank[q] < rank[who[p]]))
            best[p[better]], who[p[better]] = sim[better], q[better]
        keep = who >= 0
        yield pd.DataFrame({"rep": reps[keep], "sim": best[keep], "to_dense": dense[who[keep]], "to": reps[who[keep]]})


def density_peaks(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(segment_id, peak, rep, linked, dense, seal, mark) of every usable segment.

    ``peak`` is the representative at the end of the denser-neighbour pointers; ``linked`` and ``dense`` count the
    segments (itself included) at LINK and DENSE similarity, ``seal`` is the XOR of the marks of the linked.
    """
    spark, mark = embeddings.sparkSession, F.xxhash64("segment_id").alias("mark")
    pivots = _pivots(embeddings, dim)
    if not len(pivots):
        return usable_vectors(embeddings, dim).select("segment_id", F.lit("").alias("peak"), F.lit("").alias("rep"), *[F.lit(0).cast("bigint").alias(k) for k in ("linked", "dense", "seal")], mark)
    placed = scratch_table(_cells(usable_vectors(embeddings, dim).select("*", mark), pivots), "vectors")
    segments = scratch_table(placed.select("segment_id", "key", "mark"), "segments")
    sizes = placed.groupBy("key", "cell", "band").agg(F.max("angle").alias("angle")).groupBy("cell", "band").agg(F.count("*").alias("n"), F.max("angle").cast("double").alias("far")).collect()
    where, partners = _plan(sizes, pivots, LINK)
    reps = _blocks(placed, where)
    discard(placed)
    blocks = files_by(reps, "block")
    part = _join(spark, partners, lambda i, js: _densities(i, js, blocks), "block int, rep string, linked bigint, dense bigint, seal bigint, at int")
    part = part.repartition("block").groupBy("block", "rep").agg(F.sum("linked").alias("linked"), F.sum("dense").alias("dense"), F.bit_xor("seal").alias("seal"), F.collect_set("at").alias("places"))
    dens = scratch_table(part, "densities", by="block")
    densities = files_by(dens, "block")
    # only vectors with a neighbour other than their own copies can point anywhere
    up = _join(spark, partners, lambda i, js: _denser(i, js, blocks, densities), "rep string, sim double, to_dense bigint, to string")
    up = up.groupBy("rep").agg(F.min(F.struct((-F.col("sim")).alias("s"), (-F.col("to_dense")).alias("d"), "to"))["to"].alias("to"))
    dens = dens.select("rep", "linked", "dense", "seal")
    links = cut(dens.join(up, "rep", "left").select("rep", F.coalesce("to", "rep").alias("to")))
    while True:
        nxt = links.alias("l").join(links.select(F.col("rep").alias("via"), F.col("to").alias("beyond")), F.col("to") == F.col("via"))
        nxt = cut(nxt.select("rep", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        links = nxt.select("rep", "to")
        if not moved:
            break
    labelled = reps.select("key", "rep").join(dens, "rep").join(links.withColumnRenamed("to", "peak"), "rep")
    return segments.select("segment_id", "key", "mark").join(labelled, "key").select("segment_id", "peak", "rep", "linked", "dense", "seal", "mark")


def clusters(labelled: DataFrame, *, typical: int = 3, at_least: int = 1) -> DataFrame:
    """(first_segment_id, size, typical): clusters with their densest members (ties: smaller id)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("peak").orderBy(F.desc("dense"), "segment_id"))
    top = labelled.select("peak", "segment_id", "dense").withColumn("k", rank).where(F.col("k") <= typical)
    top = top.groupBy("peak").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "segment_id"))), lambda s: s["segment_id"]).alias("typical"))
    size = labelled.groupBy("peak").agg(F.min("segment_id").alias("first_segment_id"), F.count("*").alias("size"))
    return size.where(F.col("size") >= at_least).join(top, "peak").select("first_segment_id", "size", "typical")


def sealed_groups(labelled: DataFrame) -> DataFrame:
    """(segment_id, first_segment_id) of clusters of three or more whose members are pairwise DENSE and
    below LINK to every other segment.

    Exact: every member must count exactly the cluster's size at both thresholds, and the XOR of the
    marks it is linked to must be that of the cluster's members.
    """
    groups = labelled.groupBy("peak").agg(
        F.min("segment_id").alias("first_segment_id"), F.count("*").alias("n"), F.bit_xor("mark").alias("all_marks"),
        F.min("dense").alias("d0"), F.max("linked").alias("l1"), F.min("seal").alias("s0"), F.max("seal").alias("s1"),
    )
    whole = (F.col("n") >= 3) & (F.col("d0") == F.col("n")) & (F.col("l1") == F.col("n")) & (F.col("s0") == F.col("all_marks")) & (F.col("s1") == F.col("all_marks"))
    return labelled.select("peak", "segment_id").join(groups.where(whole).select("peak", "first_segment_id"), "peak").select("segment_id", "first_segment_id")
