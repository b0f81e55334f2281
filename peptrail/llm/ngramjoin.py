"""N-gram Jaccard join with prefix trees.

A document's set holds its distinct `width`-word shingles (A-Z in lower case); documents with equal sets form one class,
and only classes are joined. Shingles have one global order: by a rarity level, from the counts of their words over all
documents (of the `VOCABULARY` most frequent words, a table of bounded size; others count as one), then by hash. A
shingle's number holds its level in its highest bits, so a sorted array of numbers is a set in global order.

Of two sets of n and m shingles that link, the prefixes (the first n - ceil(similarity * n) + 1 shingles in global
order) share one. So classes meet by the shingles of their prefixes that several classes have; these are few, since
prefixes hold the rarest. Shingles that the same classes have count once.

Where they meet, the sets are stored in a prefix tree and all of them run down it together: a node holds, for each set
still running, how many shingles it shares with the path, so sets with a common path are compared along it once. A set
leaves a subtree when what it shares and the smaller rest of both sides can't reach the overlap that the sizes ask for,
when sizes are too far apart, or when all sets below are connected with it already. First only prefixes are sent and
stored, with the length of what lies behind them as rest; sets that the tree then leaves open are sent whole into a
second tree, at whose leaves the overlap is exact.

Only connections are returned, so a group of n near copies gives n - 1 links, never all pairs. They are found in two
rounds. First each class joins by one shared shingle, in cells of bounded weight; a shingle with several cells sends
eight centres to each. Then shingles whose classes still lie in several components are joined in full: in one cell, or,
above a cell's weight, in cells of pairs of blocks, without pairs of blocks of one component; a pair of sets is taken at
its first common shingle only. No link is lost.

Defined cases: null or wordless text has an empty set (n_shingles 0), is linked with nothing and is its own component;
fewer than `width` words make one shingle; very long texts are sets like any other, and the cell of one is as large as
the set; rows repeated or with a repeated doc_id are compared by their own texts, and each row is returned; a null
doc_id never is a component's name unless all of its rows have none; ties of size or rarity change nothing in the
result; an empty table gives an empty result; further columns are ignored. Sets are held as 63-bit numbers of their
shingles (58 bits of hash), classes as 128-bit digests of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import Scratch, blocks, column_words, in_arrow, semi_by_size, shingle_hashes, signed, whole_groups
from peptrail.llm.components import components
from peptrail.llm.minhash import finish

#: Words whose counts make rarity levels: a table of 1 MB.
VOCABULARY = 65_536
#: Weight of a cell: each set counts its shingles and 256 more, so that a cell holds 512 sets at most.
CELL, EACH = 131_072, 256
CENTRES = 8


def frequent_words(docs: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the most frequent words of docs(text), and levels: 4 * log2 of their counts."""

    def run(batches):
        import pyarrow as pa

        for batch in blocks(batches, 0):
            values, counts = np.unique(column_words(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["word", "n"])

    counts = in_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], np.floor(4 * np.log2(top.column("n").to_numpy()[order])).astype(np.int64)


def numbers(words: np.ndarray, width: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for each run of `width` words, or for the whole sequence if it is shorter: 5 bits of level, 58 of hash."""
    known, levels = frequent
    shingles = shingle_hashes(words, width)
    rarity = np.zeros(len(words), dtype=np.int64)
    if len(known) and len(words):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        rarity = np.where(known[at] == words, levels[at], 0)
    sums = np.r_[0, np.cumsum(rarity)]
    width = min(width, len(words))
    total = sums[width : width + len(shingles)] - sums[: len(shingles)]
    top = max(1, width * int(levels.max(initial=0)))
    return ((total * 31 // top).astype(np.uint64) << np.uint64(58) | shingles >> np.uint64(6)).view(np.int64)


def text_sets(column, width: int, frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Each row's set in global order."""
    words, offsets = column_words(column)
    shingles = numbers(words, width, frequent) if len(words) >= width else np.zeros(0, dtype=np.int64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(shingles[a : b - width + 1] if b - a >= width else numbers(words[a:b], width, frequent)))
    return out


def digest(items: np.ndarray) -> bytes:
    return blake2b(items.tobytes(), digest_size=16).digest()


def prefix_size(n: int, num: int, den: int) -> int:
    """How many of n shingles in global order meet any set that links, other than an equal one; none if no other can link."""
    return 0 if n * den < num * (n + 1) else n - -(-num * n // den) + 1


def lists(arrays: list[np.ndarray]):
    """Arrays of longs as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def prefixes(docs: DataFrame, width: int, num: int, den: int, frequent) -> DataFrame:
    """Per row: doc_id, n_shingles, cid (null if the set is empty), prefix."""

    def run(batches):
        import pyarrow as pa

        for batch in blocks(batches, 1):
            sets = text_sets(batch.column(1), width, frequent.value)
            cid = pa.array([digest(s) if len(s) else None for s in sets], pa.binary())
            heads = lists([s[: prefix_size(len(s), num, den)] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), cid, heads], names=["doc_id", "n_shingles", "cid", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles long, cid binary, prefix array<long>")


def full_sets(texts: DataFrame, width: int, frequent) -> DataFrame:
    """cid and items (the whole set in global order) of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in blocks(batches, 1):
            found = {digest(s): s for s in text_sets(batch.column(1), width, frequent.value) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), lists(list(found.values()))], names=["cid", "items"])

    return in_arrow(texts.select("doc_id", "text"), run, "cid binary, items array<long>")


class Tree:
    """The sets of a cell in a prefix tree, as rows in the tree's order and the length of each row's common path with the row before.

    sets: whole sets, or their first shingles in global order; size: how many shingles the whole sets have. Of whole sets,
    shingles of one set only are left out: no other set shares them.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray):
        length = np.array([len(s) for s in sets])
        _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), length)
        if (length == size).all():
            shared = count[rank] > 1
            rank, owner = rank[shared], owner[shared]
        ends = np.searchsorted(owner, np.arange(len(sets) + 1))
        paths = [rank[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i8").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.size = size[self.order]
        self.length = np.array([len(p) for p in self.paths])
        self.reach = self.length + (size - length)[self.order]  # shingles that another set may share
        self.last = np.array([p[-1] if len(p) else -1 for p in self.paths])
        self.wide = len(count) + 1
        self.begin = np.r_[0, np.cumsum(self.length)]
        tokens = np.concatenate(self.paths)
        self.flat = tokens + np.repeat(np.arange(len(sets)), self.length) * self.wide  # sorted: by row, then in global order
        self.common = np.zeros(len(sets), dtype=np.int64)
        for i in range(1, len(sets)):
            a, b = self.paths[i - 1], self.paths[i]
            n = min(len(a), len(b))
            other = a[:n] != b[:n]
            self.common[i] = int(other.argmax()) if other.any() else n
        by = np.argsort(tokens, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.length)[by]  # rows that hold a shingle, by shingle
        self.places = np.searchsorted(tokens[by], np.arange(self.wide + 1))

    def shares(self, tokens: np.ndarray) -> np.ndarray:
        """For each row how many of the tokens it holds."""
        rows = [self.holders[self.places[t] : self.places[t + 1]] for t in tokens.tolist()]
        return np.bincount(np.concatenate(rows), minlength=len(self.paths)) if rows else np.zeros(len(self.paths), dtype=np.int64)

    def leaves(self, component: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, later rows) that may link by all that the tree holds of them; of whole sets those that do.

        component and side are in the tree's order. Rows of one component, or of one side other than 0, don't meet; the
        caller may unite components as it goes.
        """
        n = len(self.paths)
        pending = [(0, n, 0, np.arange(n), np.zeros(n, dtype=np.int64))]
        while pending:
            low, high, depth, running, held = pending.pop()
            below = component[low:high]
            keep = running > low  # each pair once, at the earlier row
            if below.min() == below.max():
                keep &= component[running] != below[0]
            running, held = running[keep], held[keep]
            if not len(running):
                continue
            end = int(self.common[low + 1 : high].min()) if high - low > 1 else int(self.length[low])
            path = self.paths[low][:end]
            held = held + self.shares(path[depth:])[running]
            mine, theirs = self.size[running], self.size[low:high]
            least, most = int(theirs.min()), int(theirs.max())
            # up to the last shingle that both sides show, all they share is counted; beyond, the smaller rest bounds it
            seen = np.searchsorted(self.flat, running * self.wide + path[-1], "right") - self.begin[running] if end else 0
            passed = np.searchsorted(path, self.last[running], "right")
            rest = np.minimum(self.reach[running] - seen, int(self.reach[low:high].max()) - passed)
            partner = np.maximum(least, -(-num * mine // den))
            need = -(-num * (mine + partner) // (num + den))
            keep = (held + rest >= need) & (most * den >= num * mine) & (least * num <= den * mine)
            running, held = running[keep], held[keep]
            if not len(running):
                continue
            if high - low == 1:
                running = running[(component[running] != component[low]) & ((side[running] == 0) | (side[running] != side[low]))]
                if len(running):
                    yield low, running
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1 : high] == end)).tolist(), high]
            pending += [(a, b, end, running, held) for a, b in zip(cuts[:-1], cuts[1:])][::-1]

    def links(self, component: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        """Pairs of whole sets that link, enough of them to connect all that do."""
        component, side, out = component[self.order].copy(), side[self.order], []
        for low, rows in self.leaves(component, side, num, den):
            for row in rows.tolist():
                if component[row] != component[low]:
                    out.append((self.order[low], self.order[row]))
                    component[component == component[row]] = component[low]
        return out

    def candidates(self, component: np.ndarray, side: np.ndarray, num: int, den: int, first: int | None = None) -> list[int]:
        """Sets that may link with another one here; with `first` (a shingle's place among the cell's), pairs whose first common shingle it is."""
        component, side, out = component[self.order], side[self.order], set()
        for low, rows in self.leaves(component, side, num, den):
            mine = self.paths[low]
            for row in rows.tolist():
                if row in out and low in out:
                    continue
                if first is None or mine[np.isin(mine, self.paths[row], assume_unique=True)][:1].tolist() == [first]:
                    out |= {low, row}
        return [self.order[i] for i in out]


def cells_of(batches) -> Iterator[tuple]:
    """(batch, cells as (start, stop), items by row, sizes, components, sides) of batches sorted by cell; cells without two sets near in size are left out."""
    for batch in whole_groups(batches, CELL_KEYS):
        keys = np.stack([batch.column(k).to_numpy() for k in CELL_KEYS])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        items = batch.column("items")
        ends, values = items.offsets.to_numpy(), items.values.to_numpy()
        component = np.unique(batch.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        cells = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
        yield batch, cells, lambda i: values[ends[i] : ends[i + 1]], batch.column("n").to_numpy(), component, batch.column("side").to_numpy()  # noqa: B023


def partnered(n: np.ndarray, place: np.ndarray | None, component: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows of a cell that sizes, components and sides leave a partner; with the cell's shingle's places in the prefixes, as the first that a pair shares, by what is left behind it too."""
    need = -(-num * (n[:, None] + n) // (num + den))
    rest = n if place is None else n - place
    good = (np.minimum(rest[:, None], rest) >= need) & (n[:, None] * num <= n * den) & (n[:, None] >= n)
    good &= (component[:, None] != component) & ((side[:, None] == 0) | (side[:, None] != side))
    return np.flatnonzero((good | good.T).any(axis=1))


def possible(num: int, den: int, once: bool):
    """Rows of cells whose prefixes leave open that they link with another row; with `once`, by pairs whose first common shingle is the cell's."""

    def run(batches):
        import pyarrow as pa

        for batch, cells, item, size, component, side in cells_of(batches):
            good, tokens = [], batch.column("token").to_numpy()
            for a, b in cells:
                place = np.array([np.searchsorted(item(i), tokens[a]) for i in range(a, b)]) if once else None
                rows = a + partnered(size[a:b], place, component[a:b], side[a:b], num, den)
                if len(rows):
                    sets = [item(i) for i in rows.tolist()]
                    first = int(np.searchsorted(np.unique(np.concatenate(sets)), tokens[a])) if once else None
                    good += rows[Tree(sets, size[rows]).candidates(component[rows], side[rows], num, den, first)].tolist()
            if good:
                yield batch.take(pa.array(sorted(good))).select([*CELL_KEYS, "cid", "component", "side", "n"])

    return run


def linked(num: int, den: int):
    """Links within cells of whole sets."""

    def run(batches):
        import pyarrow as pa

        for batch, cells, item, size, component, side in cells_of(batches):
            found = []
            for a, b in cells:
                rows = [i for i in range(a, b) if i == a or batch.column("cid")[i] != batch.column("cid")[i - 1]]  # a set read twice, where doc_ids repeat
                if len(rows) > 1:
                    tree = Tree([item(i) for i in rows], size[rows])
                    found += [(rows[i], rows[j]) for i, j in tree.links(component[rows], side[rows], num, den)]
            if found:
                left, right = (pa.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(left), batch.column("cid").take(right)], names=["a", "b"])

    return run


CELL_KEYS = ["token", "one", "two"]
CELL_ROW = "token long, one long, two long, cid binary, component binary, side int, n long"


def by_cell(rows: DataFrame, run, schema: str) -> DataFrame:
    rows = rows.repartition(*CELL_KEYS).sortWithinPartitions(*CELL_KEYS, "cid")
    return in_arrow(rows.select(*CELL_KEYS, "cid", "component", "side", "n", "items"), run, schema)


WEIGHT = f"n + {EACH}"


def first_cells(posts: DataFrame, scratch: Scratch) -> DataFrame:
    """Each class by one of its shingles; where these classes need several cells, eight of them go to each."""
    chosen = posts.groupBy("cid").agg(F.min_by("token", F.xxhash64("token")).alias("token"), F.first("n").alias("n"))
    chosen = scratch.keep(chosen, "chosen")
    sizes = chosen.groupBy("token").agg(F.count("*").alias("members"), F.sum(F.expr(WEIGHT)).alias("weight")).where("members > 1")
    parts = sizes.select("token", F.ceil(F.col("weight") / CELL).alias("parts"))
    rows = chosen.join(parts, "token").withColumn("one", F.pmod(F.xxhash64("cid"), "parts"))
    several = rows.where("parts > 1")
    centres = several.groupBy("token", "parts", F.pmod(F.xxhash64(F.lit(1), "cid"), F.lit(CENTRES))).agg(F.min("cid").alias("cid"))
    centres = centres.select("token", "cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("one"))
    rows = rows.select("token", "cid", "one").unionByName(centres).distinct()
    return rows.select("token", "one", F.lit(0).cast("long").alias("two"), "cid", F.col("cid").alias("component"), F.lit(0).alias("side"))


def torn_cells(posts: DataFrame, groups: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """All classes of each shingle whose classes lie in several components: in one cell, or in cells of two blocks each.

    The smaller set of a pair has the shingle, if it is the first that both share, among its first n - ceil(2 * similarity /
    (1 + similarity) * n) + 1; classes whose size is near that of no such set at this shingle stay out. A component of more than half a cell has blocks of its own; smaller ones are dealt to common blocks whole.
    """
    rows = posts.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    early = (F.col("n") - F.col("pos")) * (num + den) >= 2 * num * F.col("n")
    torn = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.expr(WEIGHT)).alias("weight"), F.min(F.when(early, F.col("n"))).alias("least"), F.max(F.when(early, F.col("n"))).alias("most"))
    near = early | ((F.col("n") >= F.col("least")) & (F.col("n") * num <= F.col("most") * den))
    rows = rows.join(torn.where("lo <> hi and least is not null").select("token", "weight", "least", "most"), "token").where(near)
    rows = scratch.keep(rows.select("token", "cid", "n", "component", "weight"), "torn")
    cell = F.lit(0).cast("long")
    small = rows.where(F.col("weight") <= CELL).select("token", cell.alias("one"), cell.alias("two"), "cid", "component", F.lit(0).alias("side"))
    large = rows.where(F.col("weight") > CELL)
    if large.isEmpty():
        return small
    half = CELL // 2
    weights = large.groupBy("token", "component").agg(F.sum(F.expr(WEIGHT)).alias("own"))
    rest = weights.groupBy("token").agg(F.sum(F.when(F.col("own") <= half, F.col("own")).otherwise(0)).alias("rest"))
    weights = weights.join(rest, "token").withColumn("alone", F.col("own") > half)
    # a block's number: of a large component its hash and a part; of small ones their common hash
    mine = F.xxhash64("component", F.pmod(F.xxhash64("cid"), F.ceil(F.col("own") / half)))
    common = F.pmod(F.xxhash64("component"), F.greatest(F.ceil(F.col("rest") / half), F.lit(1)))
    large = large.join(weights, ["token", "component"]).withColumn("block", F.when(F.col("alone"), mine).otherwise(common))
    large = scratch.keep(large.select("token", "cid", "component", "block", F.when(F.col("alone"), F.xxhash64("component")).alias("whole")), "blocks")
    each = large.select("token", "block", "whole").distinct()
    x, y = each.alias("x"), each.alias("y")
    apart = F.col("x.whole").isNull() | F.col("y.whole").isNull() | (F.col("x.whole") != F.col("y.whole"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) & apart)
    pairs = scratch.keep(pairs.select("x.token", F.col("x.block").alias("one"), F.col("y.block").alias("two")), "pairs")
    left = large.join(pairs.withColumn("block", F.col("one")), ["token", "block"]).withColumn("side", F.when(F.col("one") == F.col("two"), 0).otherwise(1))
    right = large.join(pairs.where("one < two").withColumn("block", F.col("two")), ["token", "block"]).withColumn("side", F.lit(2))
    names = ["token", "one", "two", "cid", "component", "side"]
    return small.unionByName(left.select(*names)).unionByName(right.select(*names))


def jaccard_join(docs: DataFrame, width: int = 3, similarity: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, cid, component, component_id, kept (doc_id = component_id)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngrams")
    num, den = round(similarity * 100), 100
    frequent = spark.sparkContext.broadcast(frequent_words(docs))
    rows = scratch.keep(prefixes(docs, width, num, den, frequent), "prefixes")
    heads = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min("n_shingles").alias("n"), F.first("prefix").alias("items"))
    heads = scratch.keep(heads, "classes")
    base = scratch.keep(rows.drop("prefix"), "rows")
    scratch.drop(rows)
    classes = scratch.keep(heads.select("cid", "least", "size", "n"), "names")

    spread = heads.select("cid", "n", F.posexplode("items").alias("pos", "token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"mark{i}") for i in range(2)]
    shared = spread.groupBy("token").agg(F.count("*").alias("members"), *marks).where("members > 1")
    shared = shared.groupBy("members", "mark0", "mark1").agg(F.min("token").alias("token")).select("token")
    posts = scratch.keep(spread.join(shared, "token"), "posts")

    def found(cells: DataFrame, once: bool) -> DataFrame:
        """Links of cells: by prefixes first, then, of rows that these leave open, by whole sets."""
        some = by_cell(cells.join(heads.select("cid", "n", "items"), "cid"), possible(num, den, once), CELL_ROW)
        some = scratch.keep(some, "possible")
        ids = scratch.keep(classes.join(some.select("cid").distinct(), "cid", "left_semi").select(F.col("least").alias("doc_id")).distinct(), "wanted")
        texts = semi_by_size(docs.select("doc_id", "text").where("doc_id is not null"), ids.where("doc_id is not null"), "doc_id")
        if not ids.where("doc_id is null").isEmpty():
            texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
        sets = full_sets(texts, width, frequent)
        if not base.join(ids, base["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").groupBy("doc_id").count().where("count > 1").isEmpty():
            sets = sets.dropDuplicates(["cid"])  # many rows may share a doc_id
        return scratch.keep(by_cell(some.join(sets, "cid"), linked(num, den), "a binary, b binary"), "links")

    links = found(first_cells(posts, scratch), False)
    groups = components(links, scratch)
    more = found(torn_cells(posts, groups, num, den, scratch), True)
    if not more.isEmpty():
        groups = components(links.unionByName(more), scratch)
    scratch.drop(posts, heads)
    return finish(base, classes, groups, scratch)
