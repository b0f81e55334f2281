"""MinHash near-duplicate detection: one-permutation sketches, banded buckets, star-shaped candidates.

A document's set holds its distinct `width`-word shingles (A-Z in lower case). Documents with equal
sets form one class; only classes are compared. Each class has one sketch of `bands * rows` bins by
one-permutation hashing, empty bins filled by optimal densification. Every band is a bucket; the
smallest class in a bucket is the centre of a star of candidate edges, so a bucket of n classes
gives n - 1 candidates. Candidates are confirmed on the full sets and joined to components.

Buckets that still hold several components are then compared within, without emitting pairs: first
the eight members with the smallest hashes as centres, so that most components merge; then, where
components are left, each member with those of other components. A comparison is of sizes, of one
bit of each bin of a finer sketch (sets of 64 shingles or more; over 4.5 binomial deviations beyond
the disagreement expected at the similarity rule a pair out), and of the full sets. Only small sets travel to the buckets
with their items; pairs of larger ones that the bits leave get their sets outside, once each. In buckets of more than 32
members all sets are compared in the join's condition, so that only links come out. So no link of a bucket is lost to its star shape. What is left are the
sketches' own miss rates, (1 - 0.8^rows)^bands = 5e-6 and about 3e-5 (3 of 96,211 pairs), both at
the default and a similarity of exactly 0.8, and less above.

Defined cases: null or wordless text has an empty set (n_shingles 0), is linked with nothing and
is its own component; fewer than `width` words make one shingle; rows repeated or with a repeated
doc_id are compared by their own texts, and each row is returned; a null doc_id never is a
component's name unless all of its rows have none; an empty table gives an empty result; further
columns are ignored. Sets are held as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import Scratch, arrow_map, blocks, column_words, in_arrow, mix, semi_by_size, shingle_hashes, signed, text_words
from peptrail.llm.components import components


@lru_cache(8)
def donors(bins: int, attempts: int = 64) -> np.ndarray:
    """For each attempt and bin, the bin that an empty one borrows from: a 2-universal choice shared by all sets."""
    grid = np.arange(attempts * bins, dtype=np.uint64) + np.uint64(0x51ED2701)
    return (mix(grid) % np.uint64(bins)).astype(np.int64).reshape(attempts, bins)


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of sorted distinct hashes, densified. Equal bins have probability Jaccard."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    at = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    full = np.zeros(bins, dtype=bool)
    value = np.zeros(bins, dtype=np.uint64)
    full[at[first]] = True
    value[at[first]] = shingles[first]
    empty = np.flatnonzero(~full)
    for row in donors(bins):
        if not len(empty):
            break
        source = row[empty]
        hit = full[source]
        value[empty[hit]] = value[source[hit]]
        empty = empty[~hit]
    if len(empty):  # what no attempt has filled borrows from the next full bin
        filled = np.flatnonzero(full)
        value[empty] = value[filled[np.searchsorted(filled, empty) % len(filled)]]
    return value


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each sketch (a row of values)."""
    grid = values.reshape(len(values), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(values), 1))
    for j in range(rows):
        out = mix(out + grid[:, :, j])
    return out


def one_bits(values: np.ndarray) -> np.ndarray:
    """One bit of each bin as longs, mixed with the bin's number so that bins holding one value stay independent."""
    mixed = mix(values ^ (np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.packbits((mixed & np.uint64(1)).astype(np.uint8)).view(np.int64)


def text_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text_words(text), width))


def text_sets(column, width: int) -> list[np.ndarray]:
    """text_set of each row of a string column."""
    words, offsets = column_words(column)
    shingles = shingle_hashes(words, width) if len(words) >= width else words[:0]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(shingles[a : b - width + 1] if b - a >= width else shingle_hashes(words[a:b], width)))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set that isn't empty."""
    if not sets:
        return np.zeros(0, dtype=np.int64)
    size = np.array([len(s) for s in sets])
    sums = np.add.reduceat(mix(mix(np.concatenate(sets)) + np.repeat(size, size).astype(np.uint64)), np.r_[0, np.cumsum(size)[:-1]])
    return signed(mix(sums))


def set_id(shingles: np.ndarray) -> int:
    return int(set_ids([shingles])[0])


#: Bins of the finer sketch whose bits rule pairs out.
FINE = 1024
#: Shingles from which on they do: the bins of smaller sets depend too much on each other, and such sets are soon compared in full.
DENSE = 64


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n_shingles, cid (64-bit hash of the set, null if empty), bands."""

    def run(batches):
        import pyarrow as pa

        for batch in blocks(batches, 1):
            sets = text_sets(batch.column(1), width)
            some = [s for s in sets if len(s)]
            keys = band_keys(np.stack([sketch(s, bands * rows) for s in some]), bands, rows) if some else np.zeros((0, bands), dtype=np.uint64)
            size = np.array([len(s) for s in sets])
            cid = np.zeros(len(sets), dtype=np.int64)
            cid[size > 0] = set_ids(some)
            ends = np.r_[0, np.cumsum(np.where(size > 0, bands, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(keys).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(cid, mask=size == 0), lists], names=["doc_id", "n_shingles", "cid", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, cid long, bands array<long>")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """cid, items (the set's hashes) and bits of each class of equal sets."""

    def run(batches):
        import pyarrow as pa

        lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)), pa.array(np.concatenate(rows)))
        for batch in blocks(batches, 1):
            sets = [s for s in text_sets(batch.column(1), width) if len(s)]
            if sets:
                cid, at = np.unique(set_ids(sets), return_index=True)
                sets = [sets[i] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(cid), lists([signed(s) for s in sets]), lists([one_bits(sketch(s, FINE)) for s in sets])], names=["cid", "items", "bits"])

    rows = in_arrow(texts.select("doc_id", "text"), run, "cid long, items array<long>, bits array<long>")
    return rows.dropDuplicates(["cid"])


def near_duplicates(docs: DataFrame, width: int = 4, similarity: float = 0.8, bands: int = 40, rows: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, cid, component, component_id, kept (doc_id = component_id).

    Components whose smallest doc_ids are equal (of texts that share a doc_id) differ in component, a cid of theirs.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    num, den = round(similarity * 100), 100
    base = scratch.keep(sketches(docs, width, bands, rows), "sketches")

    # a row for each class of equal sets, however many rows it has; its bands are the same in all of them
    classes = base.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")
    spread = classes.select("cid", F.explode("bands").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min("cid").alias("centre"), F.max("cid").alias("other")).where("centre <> other").select("bucket", "centre")
    shared = scratch.keep(spread.join(centres, "bucket").select("bucket", "centre", "cid").distinct(), "shared")
    edges = shared.where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    known = scratch.keep(classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", "least", "n"), "known")
    x, y = known.alias("x"), known.alias("y")
    near = (F.col("x.n") * num <= F.col("y.n") * den) & (F.col("y.n") * num <= F.col("x.n") * den)
    edges = edges.join(x, F.col("a") == F.col("x.cid")).join(y, (F.col("b") == F.col("y.cid")) & near).select("a", "b")

    tested = scratch.keep(edges, "edges")
    if tested.isEmpty():
        return finish(base, classes, None, scratch)
    wanted = scratch.keep(known.select(F.col("least").alias("doc_id")).distinct(), "wanted")
    texts = semi_by_size(docs.select("doc_id", "text").where("doc_id is not null"), wanted.where("doc_id is not null"), "doc_id")
    if not wanted.where("doc_id is null").isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id is null"))

    sets = scratch.keep(full_sets(texts, width), "sets")
    links = scratch.keep(confirm(tested, sets, num, den), "links")
    groups = components(links, scratch)

    for most in (8, None):
        inside = shared.select("bucket", "cid").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        torn = inside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2").select("bucket")
        left = scratch.keep(inside.join(torn, "bucket"), "torn")
        if left.isEmpty():
            break
        found = scratch.keep(links_inside(left, sets, similarity, num, den, most), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            groups = components(links, scratch)
        scratch.drop(left)
    scratch.drop(shared, known, tested, wanted, sets)
    return finish(base, classes, groups, scratch)


#: Members of a bucket up to which its pairs are written out to be compared: so many for each member at most.
CROWD = 32


def links_inside(members: DataFrame, sets: DataFrame, similarity: float, num: int, den: int, centres: int | None) -> DataFrame:
    """Links (a, b) between different components within buckets of members(bucket, cid, component).

    A member stands in many buckets, so it goes there with its size and bits only, and with its items if it is small; pairs
    that these don't rule out get their sets once each. To buckets of more than CROWD members the sets go, and only links come out.
    """
    crowded = members.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket")
    once = pairs_inside(members.join(crowded, "bucket", "left_anti"), brief(sets, num, den), similarity, num, den, centres).distinct()
    found = confirm(once, sets, num, den)
    if crowded.isEmpty():
        return found
    return found.unionByName(pairs_inside(members.join(crowded, "bucket", "left_semi"), sets.withColumn("n", F.size("items")), similarity, num, den, centres)).distinct()


def brief(sets: DataFrame, num: int, den: int) -> DataFrame:
    """cid, n, bits and items of sets; items only where a set with less than DENSE shingles may be near."""
    n = F.size("items")
    return sets.select("cid", n.alias("n"), "bits", F.when(n * num < DENSE * den, F.col("items")).alias("items"))


def pairs_inside(members: DataFrame, sets: DataFrame, similarity: float, num: int, den: int, centres: int | None) -> DataFrame:
    """Pairs (a, b) of links_inside() that sizes, bits and the items that both have do not rule out."""
    full = members.join(sets, "cid")
    first = full
    if centres:
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("cid", "bucket"), "cid"))
        first = members.withColumn("turn", turn).where(F.col("turn") <= centres).drop("turn").join(sets, "cid")
    x, y = first.alias("x"), full.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    off = (1 - similarity) / 2
    most_off = int(FINE * off + 4.5 * (FINE * off * (1 - off)) ** 0.5)
    apart = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(FINE // 64)), F.lit(0))
    common = F.size(F.array_intersect("x.items", "y.items"))
    once = F.lit(True) if centres else F.col("x.cid") < F.col("y.cid")
    could = once & (n * num <= m * den) & (m * num <= n * den) & ((n < DENSE) | (m < DENSE) | (apart <= most_off))
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
    unknown = F.col("x.items").isNull() | F.col("y.items").isNull()
    close = x.join(y, same & could & (unknown | (common * (den + num) >= num * (n + m))))
    return close.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))


def confirm(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges with den * intersection >= num * union on the full sets."""
    for k in "ab":
        edges = edges.join(sets.select(F.col("cid").alias(k), F.col("items").alias(f"items_{k}")), k)

    def close(a, b, left, right):
        common = len(np.intersect1d(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), assume_unique=True))
        if den * common >= num * (len(left) + len(right) - common):
            yield a, b

    return arrow_map(edges, ["a", "b", "items_a", "items_b"], close, "a long, b long")


#: A key with more than one row in so many is looked up in a broadcast table, which therefore has no more rows than this.
HOT = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """rows joined with table(key, size, ...) on key; size is the number of rows with it.

    The few largest keys are joined without a shuffle, so that a key of a third of all rows is spread like the rest.
    """
    table = scratch.keep(table, "names")
    total = table.agg(F.sum("size")).first()[0] or 0
    large = F.broadcast(table.where(F.col("size") * HOT > total).drop("size"))
    rest = rows.join(large.select(key), key, "left_anti").join(table.where(F.col("size") * HOT <= total).drop("size"), key)
    return rows.join(large, key).unionByName(rest)


def finish(base: DataFrame, classes: DataFrame, groups: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Name each class's component by its smallest doc_id and give each row its component."""
    rows = base.select("doc_id", "n_shingles", "cid")
    alone = rows.where("cid is null").withColumn("component_id", F.col("doc_id"))
    named = classes.select("cid", "size", F.col("cid").alias("component"), F.col("least").alias("component_id"))
    if groups is not None:
        groups = groups.withColumnRenamed("node", "cid")
        linked = scratch.keep(classes.select("cid", F.col("size").alias("rows"), "least").join(groups, "cid"), "linked")
        names = linked.groupBy("component").agg(F.count("*").alias("size"), F.min("least").alias("component_id"))
        linked = look_up(linked, names, "component", scratch).select("cid", F.col("rows").alias("size"), "component", "component_id")
        named = named.join(groups, "cid", "left_anti").unionByName(linked)
    out = look_up(rows.where("cid is not null"), named, "cid", scratch).unionByName(alone, allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "cid", "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
