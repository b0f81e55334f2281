"""Hard negatives by ball trees with bounds on both sides.

Rows are dealt to shards of about `shard` rows (of 64 components; fewer of longer ones) by a hash. A shard is one row: a
ball tree for each label in it (nodes split at the median along the line between two points far apart, down to `leaf`
rows; a node keeps its centre and radius). A ball bounds a query's inner products from both sides: |q| times the radius
above and below the product with the centre.

An anchor first looks for its positives, the `positives` best other rows of its label. Each positive's score gives a
window of scores, and for each window the anchor then looks for the `negatives` best rows of other labels inside it. All
windows of an anchor go down a tree together, best bound first. A node is passed over if each window rules it out: its
upper bound is below the window or strictly below the window's kth score so far, or its lower bound is above the window.
The walk ends when the best bound left is below every window's bar.

Anchors go to the shards in blocks of at most about `block`, as a broadcast of bounded size, over all vector lengths
together; shards never move. In each search the anchor's own shard comes first; the kth scores found there travel with
the anchor to all others, and a task that holds several shards carries them on and sends only its k best a window.

Components are floor(256 * x) with x as double and scores exact integers, clipped to a long, as in kdtree.py.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors meet
only vectors of their own length (an empty one scores 0 with another); fully repeated rows count once; rows that share a
vec_id but differ each count, and none is a positive or negative of its own id; an anchor without positives, and a
positive without negatives in its window (as where its score is below 0), give no rows; ties go to the smaller vec_id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import Scratch, small_enough
from peptrail.llm.kdtree import LARGEST, LOWEST, SAFE, matrix, products

HIGHEST = 2**63 - 1


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label, dim, v: distinct rows that take part, components as floor(256 * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def whole(c):
        y = c.cast("double") * 256  # from 2^53 on a double is whole
        return F.when(F.abs(y) < SAFE, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST)))

    rows = table.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.size(x).alias("dim"), F.transform(x, whole).alias("v")).distinct()


def balls(points: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows, and the nodes of a tree for each label: rows low to high of that order, left child (-1: a leaf), centre, radius, label.

    The right child stands behind the left one.
    """
    order = np.argsort(labels, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(labels[order]) != 0])
    span = [[int(a), int(b)] for a, b in zip(starts, np.r_[starts[1:], len(order)])]
    child, centre, radius, at = [-1] * len(span), [], [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        while at < len(span):
            low, high = span[at]
            mine = points[order[low:high]]
            middle = mine.mean(axis=0)
            away = np.sqrt(((mine - middle) ** 2).sum(axis=1))
            centre.append(middle)
            radius.append(away.max())
            if high - low > leaf and radius[-1] > 0:
                far = mine[int(np.nan_to_num(away, nan=0.0).argmax())]
                line = mine[int(np.nan_to_num(((mine - far) ** 2).sum(axis=1), nan=0.0).argmax())] - far
                half = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(np.nan_to_num(mine @ line), half)]
                child[at] = len(span)
                span += [[low, low + half], [low + half, high]]
                child += [-1, -1]
            at += 1
    low, high = np.array(span, dtype=np.int64).T
    return order, {"low": low, "high": high, "child": np.array(child, dtype=np.int64), "centre": np.array(centre), "radius": np.array(radius), "label": labels[order[low]]}


PARTS = {"low": np.int64, "high": np.int64, "child": np.int64, "centre": np.float64, "radius": np.float64, "label": np.int64}


def grow(leaf: int):
    """A shard's trees as one row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        rows = rows.sort_values("vec_id", kind="stable")
        points = matrix(rows["v"], dim)
        order, nodes = balls(points, rows["label"].to_numpy(dtype=np.int64), leaf)
        parts = {k: [np.ascontiguousarray(v).tobytes()] for k, v in nodes.items()}
        return pd.DataFrame({"dim": [dim], "shard": [int(rows["shard"].iloc[0])], "ids": [rows["vec_id"].to_numpy(dtype=np.int64)[order].tobytes()], "points": [points[order].tobytes()], **parts})

    return run


class Found:
    """The k best of each window of some anchors so far."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.scores = np.full((anchors, windows, k), LOWEST, dtype=np.int64)
        self.ids = np.full((anchors, windows, k), -1, dtype=np.int64)
        self.used = np.zeros((anchors, windows), dtype=np.int64)

    def add(self, q: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.used[q, w]
        scores, ids = np.r_[self.scores[q, w, :n], scores], np.r_[self.ids[q, w, :n], ids]
        top = np.lexsort((ids, ~scores))[: self.scores.shape[2]]
        n = self.used[q, w] = len(top)
        self.scores[q, w, :n], self.ids[q, w, :n] = scores[top], ids[top]

    def bar(self, q: int, w: int) -> int:
        """The kth score; below all others while there are fewer."""
        return int(self.scores[q, w, -1]) if self.used[q, w] == self.scores.shape[2] else LOWEST


def walk(shard: dict, asked: dict, wanted: np.ndarray, same: bool, found: Found) -> None:
    """Add a shard's rows to what the wanted anchors (their places) have found."""
    with np.errstate(over="ignore", invalid="ignore"):
        queries = asked["vectors"][wanted]
        norm = np.sqrt((queries**2).sum(axis=1))[:, None]
        middle, reach = queries @ shard["centre"].T, norm * shard["radius"]
        slack = norm * (np.sqrt((shard["centre"] ** 2).sum(axis=1)) + shard["radius"]) * 1e-9 + 1e-9  # rounding never hides a node
        upper, lower = np.nan_to_num(middle + reach + slack, nan=np.inf), np.nan_to_num(middle - reach - slack, nan=-np.inf)
        small = not queries.size or not shard["points"].size or np.abs(queries).max() * np.abs(shard["points"]).max() * queries.shape[1] < SAFE
    child, low, high = shard["child"], shard["low"], shard["high"]
    roots = np.setdiff1d(np.arange(len(child)), np.r_[child[child >= 0], child[child >= 0] + 1])
    for row, q in enumerate(wanted.tolist()):
        above, below = upper[row], lower[row]
        windows = [(w, int(a), int(b)) for w, (a, b) in enumerate(zip(asked["low"][q].tolist(), asked["high"][q].tolist())) if a <= b]
        bars = {w: max(a, int(asked["floor"][q, w]), found.bar(q, w)) for w, a, _ in windows}
        mine = shard["label"][roots] == asked["label"][q]
        pending = [(-above[n], n) for n in roots[mine if same else ~mine].tolist()]
        heapify(pending)

        def score(taken: list[int]) -> None:
            spans = [slice(low[n], high[n]) for n in taken]
            ids = np.concatenate([shard["ids"][s] for s in spans])
            scores = np.concatenate([(shard["points"][s] @ queries[row]).astype(np.int64) if small else products(queries[row : row + 1], shard["points"][s])[0] for s in spans])  # noqa: B023
            some = np.flatnonzero((scores >= min(bars.values())) & (ids != asked["ids"][q]))  # noqa: B023
            scores, ids = scores[some], ids[some]
            for w, _, b in windows:  # noqa: B023
                good = (scores >= bars[w]) & (scores <= b)  # noqa: B023
                if good.any():
                    found.add(q, w, scores[good], ids[good])  # noqa: B023
                    bars[w] = max(bars[w], found.bar(q, w))  # noqa: B023

        taken, step = [], 1
        while pending and windows:
            bound, n = heappop(pending)
            if -bound < min(bars.values()):
                break
            if not any(above[n] >= bars[w] and below[n] <= b for w, _, b in windows):
                continue
            if child[n] >= 0:
                for c in (int(child[n]), int(child[n]) + 1):
                    heappush(pending, (-above[c], c))
                continue
            taken.append(n)
            if len(taken) == step:
                score(taken)
                taken, step = [], min(2 * step, 16)
        if taken:
            score(taken)


def meet(block, k: int, same: bool, own: bool):
    """Walk trees (rows of shards) for a broadcast block of anchors by dim; in their own shard only, or in all others."""

    def run(batches):
        import pyarrow as pa

        state: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, home = batch.column("dim")[i].as_py(), batch.column("shard")[i].as_py()
                if dim not in block.value:
                    continue
                asked = block.value[dim]
                wanted = np.flatnonzero((asked["home"] == home) == own)
                if not len(wanted):
                    continue
                shard = {name: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind) for name, kind in (PARTS | {"ids": np.int64, "points": np.float64}).items()}
                shard["centre"], shard["points"] = shard["centre"].reshape(len(shard["low"]), dim), shard["points"].reshape(len(shard["ids"]), dim)
                walk(shard, asked, wanted, same, state.setdefault(dim, Found(*asked["low"].shape, k)))
        for dim, found in state.items():
            q, w, place = np.nonzero(np.arange(k) < found.used[:, :, None])
            if len(q):
                number = block.value[dim]["number"][q]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, w, found.ids[q, w, place], found.scores[q, w, place])], names=["q", "w", "vec_id", "score"])

    return run


def best(trees: DataFrame, block: dict, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """q, w, rank, vec_id, score: the k best rows of each window of a block's anchors."""
    spark, schema = trees.sparkSession, "q long, w long, vec_id long, score long"
    first = scratch.keep(trees.mapInArrow(meet(spark.sparkContext.broadcast(block), k, same, True), schema), "first")
    known = first.groupBy("q", "w").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).toArrow()
    bars = dict(zip(zip(known.column("q").to_pylist(), known.column("w").to_pylist()), known.column("bar").to_pylist()))
    for asked in block.values():
        asked["floor"] = np.array([[bars.get((q, w), LOWEST) for w in range(asked["low"].shape[1])] for q in asked["number"].tolist()], dtype=np.int64).reshape(asked["low"].shape)
    others = scratch.keep(trees.mapInArrow(meet(spark.sparkContext.broadcast(block), k, same, False), schema), "others")
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered(rows) -> dict[int, dict]:
    """A block of anchors by dim, with a number each and one window that holds all scores."""
    dims, out = rows.column("dim").to_numpy(), {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        mine, every = rows.take(at), np.zeros((len(at), 1), dtype=np.int64)
        vectors = np.array(mine.column("v").to_pylist(), dtype=np.float64).reshape(len(at), dim)
        names = {"ids": "vec_id", "label": "label", "home": "shard"}
        out[dim] = {"number": at.astype(np.int64), "vectors": vectors, "low": every + LOWEST, "high": every + HIGHEST, "floor": every + LOWEST} | {k: mine.column(c).to_numpy() for k, c in names.items()}
    return out


def windows(block: dict, found, low: int, high: int, positives: int) -> dict[int, dict]:
    """The block with a window for each positive of found(q, rank, score): low * score <= 100 * s <= high * score."""
    scores = {(q, r): s for q, r, s in zip(*(found.column(c).to_pylist() for c in ("q", "rank", "score")))}
    out = {}
    for dim, asked in block.items():
        mine = [[scores.get((q, r + 1)) for r in range(positives)] for q in asked["number"].tolist()]
        least = [[HIGHEST if s is None else -(-low * s // 100) for s in row] for row in mine]
        most = [[LOWEST if s is None else high * s // 100 for s in row] for row in mine]
        shape = (len(mine), positives)
        out[dim] = asked | {"low": np.array(least, dtype=np.int64).reshape(shape), "high": np.array(most, dtype=np.int64).reshape(shape), "floor": np.full(shape, LOWEST, dtype=np.int64)}
    return out


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard: int = 8192, leaf: int = 256, block: int = 8192, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of table(vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`; low and high, in hundredths (0 to 100), set the window.
    """
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    rows = scratch.keep(usable(table), "vectors")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    size = F.greatest(F.lit(leaf), F.floor(F.lit(64 * shard) / F.greatest("dim", F.lit(64))))  # a shard's row stays within some MB
    dims = scratch.keep(dims.select("dim", "asked", F.ceil(F.col("n") / size).alias("shards")), "dims")
    rows = rows.join(F.broadcast(dims) if small_enough(dims, 100_000) else dims, "dim")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "label", "v"), "shards"))
    schema = "dim int, shard long, ids binary, points binary, " + ", ".join(f"{k} binary" for k in PARTS)
    trees = scratch.keep(rows.select("vec_id", "label", "dim", "v", "shard").groupBy("dim", "shard").applyInPandas(grow(leaf), schema), "trees")
    weight = dims.agg(F.sum(F.col("asked") * F.greatest("dim", F.lit(64)))).first()[0] or 0
    blocks = -(-weight // (64 * block))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "label", "v"), F.lit(max(blocks, 1))))
    asked = scratch.keep(asked.select("vec_id", "label", "dim", "v", "shard", "block"), "anchors")
    out = []
    for number in range(blocks):
        rows = asked.where(F.col("block") == number).drop("block").toArrow()
        anchors = numbered(rows)
        found = scratch.keep(best(trees, anchors, positives, True, scratch), "positives")
        near = best(trees, windows(anchors, found.toArrow(), low, high, positives), negatives, False, scratch)
        names = spark.createDataFrame(pd.DataFrame({"q": np.arange(rows.num_rows), "anchor_id": rows.column("vec_id").to_numpy()}), "q long, anchor_id long")
        known = found.select("q", (F.col("rank") - 1).cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "q")
        out.append(near.join(known, ["q", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
