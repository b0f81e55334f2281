"""Ranked lexical search by scoring windows of documents.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. One pass over the texts keeps, of
each document, its number of terms and what it has of the items' terms (with their occurrences). Document counts are
summed over tasks, and give each term its weight.

The kept rows are sorted by doc_id over all tasks. A task takes them in windows of `window` documents: the window's
postings are grouped by term with the score that each adds, and the documents of a posting list as words of a bitset. For
each item the scores of its terms are scattered into one array of the window's size, which fits a CPU's cache, and the
lists' words are put into the occupancy bitset. Only documents whose bit is set are harvested: those that reach the item's
kth score so far go into its heap, which the task carries from window to window. A task sends on `most` documents an item.

The score of a document with n terms for an item: the sum over the item's distinct terms of
w * ((10^9 * tf) div (1000 * tf + 20 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 100 - b + (b * n * N) div L with
b = 50, N documents with a term and L terms in them; BM25 with k1 = 2 and b = 1/2 in whole numbers.

Items go to the documents in blocks of about `block` terms, as a broadcast of bounded size: one pass over the texts each.

Defined cases: null or termless texts are no documents and match nothing; items without text or terms get no rows; wholly
repeated items count once, items that share an item_id but differ each get their own; rows that repeat a doc_id are
documents each, ties between them go by a hash of their texts; a null doc_id ranks behind the others of its score; very
long texts are read whole; an empty table gives an empty result; further columns are ignored. Terms are 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce
from heapq import heappush, heappushpop

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import Scratch, blocks, column_words, in_arrow, signed, solid_bytes

TERM = solid_bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, mark (a hash of the item) and its distinct terms, of distinct items that have some."""

    def run(batches):
        import pyarrow as pa

        for batch in blocks(batches, 2):
            terms, offsets = column_words(batch.column(2), TERM)
            sets = [np.unique(terms[a:b]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["item_id", "mark", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.xxhash64("item_id", "text").alias("mark"), "text").distinct()
    return in_arrow(rows, run, f"item_id {kind}, mark long, terms array<long>").where(F.size("terms") > 0)


def matches(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, mark (a hash of the text), n, terms (places in the broadcast sorted vocabulary) and tf of each document with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known = vocabulary.value
        for batch in blocks(batches, 2):
            words, offsets = column_words(batch.column(2), TERM)
            n = np.diff(offsets)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = np.flatnonzero(known[at] == words)
            owner = np.searchsorted(offsets, hit, "right") - 1
            pair, tf = np.unique(owner * len(known) + at[hit], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(n) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % len(known), tf)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *lists], names=["doc_id", "mark", "n", "terms", "tf"])
            yield rows.filter(pa.array(n > 0))

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return in_arrow(rows, run, f"doc_id {kind}, mark long, n long, terms array<int>, tf array<int>")


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it; a task sums its own first."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    counts = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    return out


class Heaps:
    """The `most` best documents of each item so far: (score, -doc_id, -mark), a null doc_id below all others."""

    def __init__(self, items: int, most: int):
        self.heaps: list[list] = [[] for _ in range(items)]
        self.most = most

    def bar(self, item: int) -> int:
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.most else 1

    def add(self, item: int, scores: np.ndarray, ids: list, marks: np.ndarray) -> None:
        heap = self.heaps[item]
        for score, i, mark in zip(scores.tolist(), ids, marks.tolist()):
            entry = (score, -math.inf if i is None else -i, -mark)
            if len(heap) < self.most:
                heappush(heap, entry)
            elif entry > heap[0]:
                heappushpop(heap, entry)


class Postings:
    """A window's posting lists: by term the documents' places and what they score, and the places as words of a bitset."""

    def __init__(self, terms: np.ndarray, tf: np.ndarray, place: np.ndarray, m: np.ndarray, weight: np.ndarray):
        order = np.argsort(terms, kind="stable")
        terms, tf, self.place = terms[order], tf[order].astype(np.int64), place[order]
        self.score = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.place]))
        self.begin = np.searchsorted(terms, np.arange(len(weight) + 1))
        word = self.place >> 6
        start = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (word[1:] != word[:-1])]) if len(terms) else np.zeros(0, dtype=np.int64)
        bit = np.uint64(1) << (self.place & 63).astype(np.uint64)
        self.bits = np.bitwise_or.reduceat(bit, start) if len(start) else bit
        self.word = word[start]
        self.word_begin = np.searchsorted(terms[start], np.arange(len(weight) + 1))

    def scatter(self, terms: np.ndarray, scores: np.ndarray, occupied: np.ndarray) -> None:
        """Add the terms' scores to the array and their documents to the bitset. A list holds each place once."""
        for t in terms.tolist():
            a, b = self.begin[t], self.begin[t + 1]
            if a < b:
                scores[self.place[a:b]] += self.score[a:b]
                a, b = self.word_begin[t], self.word_begin[t + 1]
                occupied[self.word[a:b]] |= self.bits[a:b]


def harvest(scores: np.ndarray, occupied: np.ndarray, bar: int) -> np.ndarray:
    """Places of occupied documents that score `bar` or more; empties both arrays where they were occupied."""
    words = np.flatnonzero(occupied)
    bits = np.unpackbits(occupied[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
    row, bit = np.nonzero(bits)
    places = words[row] * 64 + bit
    good = places[scores[places] >= bar]
    occupied[words] = 0
    return good


def scoring(sent, most: int, window: int):
    """Score batches sorted by doc_id for a broadcast (items' term lists, weights, N, L)."""

    def run(batches):
        import pyarrow as pa

        items, weight, documents, length = sent.value
        heaps, pending, rows = Heaps(len(items), most), [], 0
        scores, occupied = np.zeros(-(-window // 64) * 64, dtype=np.int64), np.zeros(-(-window // 64), dtype=np.uint64)

        def score(now):
            terms, tf = (now.column(c).combine_chunks() for c in ("terms", "tf"))
            size = np.diff(terms.offsets.to_numpy())
            m = np.array([50 + 50 * n * documents // length for n in now.column("n").to_pylist()], dtype=np.int64)
            postings = Postings(terms.flatten().to_numpy(), tf.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), m, weight)
            ids, marks = now.column("doc_id").to_pylist(), now.column("mark").to_numpy()
            for i, mine in enumerate(items):
                postings.scatter(mine, scores, occupied)
                touched = np.flatnonzero(occupied)
                good = harvest(scores, occupied, heaps.bar(i))
                if len(good) > most:  # of equal scores the first places stay: rows come in order of doc_id
                    good = good[np.lexsort((good, -scores[good]))[:most]]
                heaps.add(i, scores[good], [ids[p] for p in good.tolist()], marks[good])
                scores.reshape(-1, 64)[touched] = 0

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, window - rows)
                pending.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == window:
                    score(pa.Table.from_batches(pending))
                    pending, rows = [], 0
        if pending:
            score(pa.Table.from_batches(pending))
        out = [(i, score, None if key == -math.inf else -key, -mark) for i, heap in enumerate(heaps.heaps) for score, key, mark in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["q", "score", "doc_id", "mark"])

    return run


def search(docs: DataFrame, items: DataFrame, most: int = 50, window: int = 16_384, block: int = 2_000_000, scratch: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best of docs(doc_id, text) for each of items(item_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    asked = scratch.keep(item_terms(items), "items")
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    number, out = -(-terms // block), []
    kind = items.schema["item_id"].dataType.simpleString()
    for part in range(number):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(1), "mark"), F.lit(number)) == part).toArrow()
        if not mine.num_rows:
            continue
        lists = [np.array(x, dtype=np.int64).view(np.uint64) for x in mine.column("terms").to_pylist()]
        vocabulary = np.unique(np.concatenate(lists))
        found = scratch.keep(matches(docs, spark.sparkContext.broadcast(vocabulary)), "matches")
        documents, length = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = document_counts(found, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        sent = spark.sparkContext.broadcast(([np.searchsorted(vocabulary, x) for x in lists], weight, documents, length))
        rows = found.where(F.size("terms") > 0).repartitionByRange("doc_id", "mark").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "mark")
        best = in_arrow(rows, scoring(sent, most, window), "q long, score long, doc_id long, mark long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "mark")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(mine.column("item_id").to_pylist())], f"q long, item_id {kind}")
        out.append(best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, out)
