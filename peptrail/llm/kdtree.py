"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt to shards of about `shard` rows (of 64 components; fewer of longer ones) by a hash. Each shard is
split at medians of its widest dimension down to leaves of `leaf` rows with tight bounding boxes, and stored as one row.
A query visits leaves best first, by the largest inner product that a leaf's box allows, and stops at the first leaf
whose bound is below its kth score so far. Each query's first pass visits one shard only (that of its own hash); the kth
score found there travels with the query to all other shards, where it prunes from the start, and a task that holds
several shards carries it, as it rises, from one to the next and sends on only its k best.

Queries go to the shards in blocks of at most `block` at a time, as a broadcast of bounded size; shards never move. So
neither vectors nor queries are shuffled more than once, whatever the table's size.

Components are floor(256 * x) with x as double, which a double holds exactly however large it is (beyond the largest
double it stays at that); scores are exact integers (products that could pass 2^53 are computed as Python integers;
scores beyond a long are clipped to it).

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors
meet only vectors of their own length (an empty one scores 0 with another); fully repeated rows count
once; rows that share a vec_id but differ each count and none is a candidate of its own id; a null
vec_id takes no part; ties go to the smaller vec_id; fewer candidates give fewer rows; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import Scratch, small_enough

SAFE, LARGEST, LOWEST = 2**53, float(np.finfo(np.float64).max), -(2**63)


def clean(table: DataFrame) -> DataFrame:
    """vec_id, dim, v: distinct usable vectors as floor(256 * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.where("vec_id is not null and embedding is not null").where(finite)

    def whole(c):
        y = c.cast("double") * 256  # only the exponent changes; from 2^53 on a double is whole, and floor() would stop at a long's end
        return F.when(F.abs(y) < SAFE, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST)))

    return rows.select("vec_id", F.size(x).alias("dim"), F.transform(x, whole).alias("v")).distinct()


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dim)


def leaves(points: np.ndarray, leaf: int) -> np.ndarray:
    """Leaf numbers of a KD-tree with median splits of the widest dimension."""
    out, pending, n = np.zeros(len(points), dtype=np.int64), [np.arange(len(points))], 0
    while pending:
        at = pending.pop()
        with np.errstate(over="ignore"):
            widths = np.ptp(points[at], axis=0) if len(at) > leaf and points.shape[1] else np.zeros(1)
        if widths.max() == 0:
            out[at], n = n, n + 1
            continue
        half = len(at) // 2
        order = np.argpartition(points[at, int(widths.argmax())], half)
        pending += [at[order[:half]], at[order[half:]]]
    return out


def grow(leaf: int):
    """A shard's tree as one row: ids and points in order of leaves, and where each leaf begins."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        rows = rows.sort_values("vec_id", kind="stable")
        points = matrix(rows["v"], dim)
        at = leaves(points, leaf)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        return pd.DataFrame({"dim": [dim], "shard": [int(rows["shard"].iloc[0])], "ids": [rows["vec_id"].to_numpy()[order].tobytes()], "points": [points[order].tobytes()], "cuts": [cuts.astype(np.int64).tobytes()]})

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers."""
    with np.errstate(over="ignore"):
        exact = not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < SAFE
    if exact and a.size and b.size:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    top = 2**63 - 1
    rows = [[max(-top - 1, min(top, sum(p * q for p, q in zip(map(int, x), y)))) for y in whole] for x in a.tolist()]
    return np.array(rows, dtype=np.int64).reshape(len(a), len(b))


@dataclass
class Best:
    """The k best of some queries so far: scores and ids in rows, unused places at the end of the scale."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), LOWEST, dtype=np.int64), np.full((n, k), -1, dtype=np.int64))


def search(ids: np.ndarray, points: np.ndarray, cuts: np.ndarray, asked: np.ndarray, queries: np.ndarray, floor: np.ndarray, best: Best, used: np.ndarray, wanted: np.ndarray) -> None:
    """Add a shard's rows to the k best of the wanted queries (their places).

    floor: kth scores known beforehand; used: how many places of a query's best are taken. Leaves are taken best first by
    box bound; one below the kth score ends a query's search.
    """
    ends, k = np.r_[cuts[1:], len(ids)], best.scores.shape[1]
    mine = queries[wanted]
    if points.shape[1]:
        low, high = np.minimum.reduceat(points, cuts, axis=0), np.maximum.reduceat(points, cuts, axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            plus, minus = np.maximum(mine, 0), np.minimum(mine, 0)
            slack = (plus @ np.abs(high).T - minus @ np.abs(low).T) * 1e-12  # rounding never hides a leaf
            bounds = np.nan_to_num(plus @ high.T + minus @ low.T + slack, nan=np.inf)
    else:
        bounds = np.zeros((len(mine), len(cuts)))
    for row in np.flatnonzero(bounds.max(axis=1) >= floor[wanted]).tolist():
        q, bound = int(wanted[row]), bounds[row]
        n = int(used[q])
        kth = max(int(floor[q]), int(best.scores[q].min())) if n == k else int(floor[q])
        order = np.argsort(-bound, kind="stable")
        step, at = 1, 0
        while at < len(order) and bound[order[at]] >= kth:
            take = [b for b in order[at : at + step].tolist() if bound[b] >= kth]
            at, step = at + step, min(step * 2, 16)
            where = np.concatenate([np.arange(cuts[b], ends[b]) for b in take])
            scores = products(mine[row : row + 1], points[where])[0]
            keep = (scores >= kth) & (ids[where] != asked[q])
            if not keep.any():
                continue
            found, score = np.r_[best.ids[q, :n], ids[where][keep]], np.r_[best.scores[q, :n], scores[keep]]
            top = np.lexsort((found, ~score))[:k]  # ~ turns the order round and, unlike -, can not overflow
            n = len(top)
            best.ids[q, :n], best.scores[q, :n] = found[top], score[top]
            if n == k:
                kth = max(kth, int(best.scores[q].min()))
        used[q] = n


def meet(block, k: int, own: bool):
    """Search trees (rows of shards) for a broadcast block of queries: by dim (vec_id, number, own shard, floor, vectors); in their own shard only, or in all others."""

    def run(batches):
        import pyarrow as pa

        state = {}
        for batch in batches:
            for dim, shard, ids, points, cuts in zip(*(batch.column(i) for i in range(5))):
                if (dim := dim.as_py()) not in block.value:
                    continue
                asked, _, home, floor, queries = block.value[dim]
                wanted = np.flatnonzero((home == shard.as_py()) == own)
                if not len(wanted):
                    continue
                best, used = state.setdefault(dim, (Best.none(len(asked), k), np.zeros(len(asked), dtype=np.int64)))
                ids, cuts = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (ids, cuts))
                search(ids, np.frombuffer(points.as_buffer()).reshape(len(ids), dim), cuts, asked, queries, floor, best, used, wanted)
        for dim, (best, used) in state.items():
            asked, number = block.value[dim][:2]
            row, place = np.nonzero(np.arange(k) < used[:, None])
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[row], number[row], best.ids[row, place], best.scores[row, place])], names=["query_id", "q", "vec_id", "score"])

    return run


def top_k(table: DataFrame, every: int = 50, k: int = 5, shard: int = 8192, leaf: int = 64, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(clean(table), "vectors")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    size = F.greatest(F.lit(leaf), F.floor(F.lit(64 * shard) / F.greatest("dim", F.lit(64))))  # a shard's row stays within some MB
    dims = scratch.keep(dims.select("dim", F.ceil(F.col("n") / size).alias("shards"), F.ceil(F.col("asked") * F.greatest("dim", F.lit(64)) / (64 * block)).alias("blocks")), "dims")
    rows = rows.join(F.broadcast(dims) if small_enough(dims, 100_000) else dims, "dim")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards"))
    trees = rows.select("vec_id", "dim", "v", "shard").groupBy("dim", "shard").applyInPandas(grow(leaf), "dim int, shard long, ids binary, points binary, cuts binary")
    trees = scratch.keep(trees, "trees")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.greatest("blocks", F.lit(1))))
    asked = scratch.keep(asked.select("vec_id", "dim", "v", "shard", "block"), "queries")
    out, found = "query_id long, q long, vec_id long, score long", []
    for number in range(max(dims.agg(F.max("blocks")).first()[0] or 0, 0)):
        queries = numbered(asked.where(F.col("block") == number).drop("block").toArrow())
        sent = spark.sparkContext.broadcast(queries)
        first = scratch.keep(trees.mapInArrow(meet(sent, k, True), out), "first")
        bars = first.groupBy("q").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).select("q", "bar").toArrow()
        known = dict(zip(bars.column("q").to_pylist(), bars.column("bar").to_pylist()))
        raised = {dim: (ids, q, home, np.array([known.get(x, LOWEST) for x in q.tolist()], dtype=np.int64), v) for dim, (ids, q, home, _, v) in queries.items()}
        sent = spark.sparkContext.broadcast(raised)
        others = scratch.keep(trees.mapInArrow(meet(sent, k, False), out), "others")
        found.append(first.unionByName(others).withColumn("block", F.lit(number)))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("block", "query_id", "q").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def numbered(rows) -> dict[int, tuple]:
    """A block of queries by dim: vec_ids, numbers (that tell rows of one vec_id apart), own shards, no floors yet, vectors."""
    dims, out = rows.column("dim").to_numpy(), {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        mine = rows.take(at)
        vectors = np.array(mine.column("v").to_pylist(), dtype=np.float64).reshape(len(at), dim)
        out[dim] = mine.column("vec_id").to_numpy(), at.astype(np.int64), mine.column("shard").to_numpy(), np.full(len(at), LOWEST, dtype=np.int64), vectors
    return out
