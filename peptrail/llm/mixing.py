"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all get the expected copies target / source size. The whole part is taken as
it is; the fractions are rounded in pairs: words of expectation move at random from one document of
a pair to the other, keeping the pair's expected words and each document's expectation, until one
of them has a whole count. The documents of a source are dealt by a hash into groups of about
`group` rows; each group leaves at most one fractional document, and these meet in a reduction
tree of fan-in `group`, so no task sees more than a few thousand rows however large a source is. The
last fraction of a source is rounded at random; so a source misses its target by under one document.

Pairs are made within classes of size (a power of two each), from the longest documents on. A long document is not taken
up by much smaller ones, one by one (pairs walk at random, by steps of the smaller document). So what a class leaves open is
paired with several smaller documents of the group at once, the longest that have room for it, whose fractions change
together; if all smaller ones have none, it goes on to the next class. What a group leaves open is thus small. All of this depends on the source's own documents only.
All randomness comes from hashes of doc_id and `seed`: reruns agree.

Defined cases: null or wordless text has size 0 and takes 0; a null source is a source of its own,
last in order; very long texts are counted whole; repeated rows are documents of their own, told apart by a running number, as are rows
without a doc_id; a doc_id of any type comes back as it is; a table without words gives targets of 0;
an empty table an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import WORD, Scratch, small_enough

WEIGHTS = (5.0, 2.0, 1.0)
#: Running numbers that are dealt at a time.
RANGE = 1 << 14


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of the whole text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds place, from 0 by code point with null last. A task numbers one range of sources; the ranges' counts add up in a window."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("inside", inside).join(F.broadcast(parts), "part").withColumn("place", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside")


def targets(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target. Targets are capped at `most` times the source; the excess is reshared by weight.

    The only rows here are the sources. Each round caps those above their cap, until none is.
    """
    totals = in_order(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.keep(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).drop("place"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, F.lit(False)
    while total:
        taken, weight_left = table.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not weight_left:
            break
        rate = (total - (taken or 0.0)) / weight_left
        above = capped | (F.col("weight") * rate > F.col("cap"))
        if table.where(above & ~capped).isEmpty():
            break
        capped = above
    return table.select("source", "source_size", "n_docs", F.when(capped, F.col("cap")).otherwise(F.col("weight") * rate).cast("double").alias("target"))


def pivot(keys: list, sizes: np.ndarray, shares: np.ndarray, seed: int) -> tuple[np.ndarray, int | None]:
    """Round fractional shares in the given order; returns them and the place of the one left, if any."""
    shares, open_ = shares.astype(float).copy(), None
    for i in range(len(shares)):
        if shares[i] <= 0 or shares[i] >= 1 or sizes[i] == 0:
            shares[i] = float(shares[i] >= 1)
            continue
        if open_ is None:
            open_ = i
            continue
        a, b = open_, i
        wa, wb = float(sizes[a]), float(sizes[b])
        up = min((1 - shares[a]) * wa, shares[b] * wb)  # words that may move from b to a
        down = min(shares[a] * wa, (1 - shares[b]) * wb)  # and from a to b
        coin = xxhash.xxh64_intdigest(f"{seed}/{keys[a]}/{keys[b]}") / 2.0**64
        moved = up if coin * (up + down) < down else -down
        shares[a] += moved / wa
        shares[b] -= moved / wb
        for j in (a, b):
            if abs(shares[j] - round(shares[j])) < 1e-12:
                shares[j] = round(shares[j])
        rest = [j for j in (a, b) if 0 < shares[j] < 1]
        open_ = rest[0] if rest else None
    return shares, open_


def give_to_pool(keys: list, sizes: np.ndarray, shares: np.ndarray, i: int, pool: np.ndarray, seed: int) -> bool:
    """Make document i whole or nothing, paired with as many of a pool of others (longest first) as its fraction needs, in place; False if the pool has no room.

    It becomes whole with probability equal to its share; each member of the pool gives or takes words in proportion to
    what it has room for in both cases, so every expectation and the sum of words are kept.
    """
    pool = pool[(shares[pool] > 0) & (shares[pool] < 1) & (sizes[pool] > 0)]
    w, rest = float(sizes[i]), sizes[pool].astype(float)
    gives, takes = (1 - shares[i]) * w, shares[i] * w  # words that the pool gives if the document is taken, takes if not
    room = np.minimum(shares[pool] * rest / gives, (1 - shares[pool]) * rest / takes)
    enough = int(np.searchsorted(np.cumsum(room), 1.0)) + 1  # the longest ones that have the room together
    if enough > len(pool):
        return False
    pool, rest, part = pool[:enough], rest[:enough], room[:enough] / room[:enough].sum()
    up = xxhash.xxh64_intdigest(f"{seed}/pool/{keys[i]}") / 2.0**64 < shares[i]
    shares[i] = float(up)
    moved = shares[pool] - part * gives / rest if up else shares[pool] + part * takes / rest
    shares[pool] = np.where(np.abs(moved - np.round(moved)) < 1e-12, np.round(moved), moved)
    return True


def settle(keys: list, sizes: np.ndarray, shares: np.ndarray, seed: int) -> tuple[np.ndarray, int | None]:
    """Round fractional shares of documents in order of falling size; returns them and the place of the one left, if any.

    Documents are paired within classes of size, a power of two each, from the longest on. The one that a class leaves open
    is paired with a pool of smaller documents; if they have no room for its fraction, it goes on to the next class.
    """
    shares = shares.astype(float).copy()
    kind = np.log2(np.maximum(sizes, 1)).astype(np.int64)
    open_ = None
    for k in np.unique(kind)[::-1].tolist():
        mine = np.flatnonzero(kind == k)
        mine = mine if open_ is None else np.r_[open_, mine]
        shares[mine], left = pivot([keys[i] for i in mine.tolist()], sizes[mine], shares[mine], seed)
        open_ = None if left is None else int(mine[left])
        if open_ is not None and give_to_pool(keys, sizes, shares, open_, np.flatnonzero(kind < k), seed):
            open_ = None
    return shares, open_


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, group: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(sizes(docs), "sizes")
    goal = scratch.keep(targets(sized, scratch, weights, most), "targets")
    deepest = goal.agg(F.max("n_docs")).first()[0] or 0
    goal_side = F.broadcast(goal) if small_enough(goal, 100_000) else goal
    # rows that repeat a document's id, source and size differ in nothing that matters here but a running number
    alike = sized.groupBy("doc_id", "source", "size").count()
    alike = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / RANGE))))  # no array is longer than RANGE for up to RANGE^2 rows
    alike = alike.withColumn("copy", F.explode(F.sequence(F.col("part") * RANGE + 1, F.least((F.col("part") + 1) * RANGE, F.col("count"))))).drop("part")
    rows = alike.join(goal_side, alike["source"].eqNullSafe(goal_side["source"])).drop(goal_side["source"])
    expected = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(expected + 1e-12)).withColumn("share", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string"))
    rows = rows.withColumn("key", key)
    deal = F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n_docs") / group))
    level = rows.select("doc_id", "key", "source", "size", "source_size", "target", "whole", "share", deal.alias("bucket"), F.lit(False).alias("left"), F.col("n_docs").alias("rest"))
    schema, done, depth = level.schema, [], 0
    while True:
        kept = scratch.keep(level.groupBy("source", "bucket").applyInArrow(rounding(seed + depth, group), schema), "rounded")
        done.append(kept.where("not left"))
        if deepest <= group:
            break
        depth, deepest = depth + 1, -(-deepest // group)
        level = kept.where("left").withColumn("bucket", F.floor(F.col("bucket") / group)).withColumn("left", F.lit(False))
        level = level.withColumn("rest", F.ceil(F.col("rest") / group))
    out = reduce(DataFrame.unionByName, done)
    copies = (F.col("whole") + F.col("share")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def rounding(seed: int, group: int) -> Callable:
    """Round one group; its last fraction is marked as left, or rounded at random at the root of its source's tree.

    A source's group is the root if at most `group` of the source's documents are left (rest), whatever other sources have.
    Only keys, sizes and shares become Python values; all other columns stay as they are.
    """

    def run(rows):
        import pyarrow as pa

        key, size = rows.column("key").to_pylist(), rows.column("size").to_pylist()
        order = np.array(sorted(range(len(key)), key=lambda i: (-size[i], key[i])), dtype=np.int64)  # so a small document is left
        keys = [key[i] for i in order]
        sizes, shares = (rows.column(c).to_numpy()[order] for c in ("size", "share"))
        last = rows.column("rest")[0].as_py() <= group
        shares, open_ = settle(keys, sizes, shares, seed)
        left = np.zeros(len(key), dtype=bool)
        if open_ is not None and last:
            shares[open_] = float(xxhash.xxh64_intdigest(f"{seed}/last/{keys[open_]}") / 2.0**64 < shares[open_])
        elif open_ is not None:
            left[order[open_]] = True
        back = np.empty(len(key))
        back[order] = shares
        rows = rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(back))
        return rows.set_column(rows.schema.get_field_index("left"), "left", pa.array(left))

    return run
