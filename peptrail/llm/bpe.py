"""Byte-level BPE by merge replay over the distinct words of a corpus slice.

A task takes its texts a block at a time, collects the words (matches of the pattern) that it
has not met yet and encodes them together: an inverted index from the rank of a token pair to the
positions that hold such a pair is replayed in rank order, and each merge touches only its two
neighbours. A word's ids are kept as decimal text for the next block, for up to `REMEMBER` words; bytes
are decoded from a text's ids token by token. The cost of merging so follows the distinct words, not the text.

Defined cases: null text counts as empty and gives no ids; texts of any length are encoded whole;
rows are independent, so repeated rows repeat their result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from peptrail.llm.common import hold, in_arrow

#: Words remembered by a Python worker, and characters of text in a block.
REMEMBER, BLOCK = 400_000, 2 << 20


class Vocabulary:
    """Ranks of a tiktoken file: a token's id is its rank."""

    def __init__(self, lines: Iterable[bytes]):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.by_text = {str(rank): token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.pairs: dict[int, int] = {}  # a << 32 | b to the rank of the token that a and b make, -1 if there is none

    def pair(self, key: int) -> int:
        """The rank for a key of `pairs` that isn't there yet."""
        if len(self.pairs) > 250_000:
            self.pairs.clear()
        rank = self.pairs[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        return rank

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, as merging the pair of lowest rank, leftmost first, gives them."""
        if not words:
            return []
        flat = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        inside = np.ones(len(flat), dtype=bool)
        inside[ends] = False
        rank = np.full(len(flat), -1, dtype=np.int64)
        both = inside[:-1] & inside[1:]
        rank[:-1][both] = self.first[flat[:-1][both], flat[1:][both]]
        token = np.where(inside, np.array(self.single, dtype=np.int64)[flat], -1).tolist()
        order = np.flatnonzero(rank >= 0)
        order = order[np.argsort(rank[order], kind="stable")]
        held, cuts = np.unique(rank[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(held.tolist(), np.split(order, cuts[1:]))} if len(order) else {}
        self.replay(token, rank.tolist(), index)
        out, start = [], 0
        for end in ends.tolist():
            out.append([t for t in token[start:end] if t >= 0])
            start = end + 1
        return out

    def replay(self, token: list[int], rank: list[int], index: dict[int, list[int]]) -> None:
        """Merge in place. token: id at the token's first position, -1 elsewhere; rank: of the pair that begins there."""
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        pending, pair, pairs = list(index), self.pair, self.pairs
        heapq.heapify(pending)
        while pending:
            r = heapq.heappop(pending)
            places = sorted(index.pop(r, ()))
            for i, p in enumerate(places):
                if rank[p] != r:
                    continue
                q = after[p]
                n = after[q]
                token[p], token[q], rank[q], after[p], before[n] = r, -1, -1, n, p
                lower = False
                t = token[n]
                if t < 0:
                    rank[p] = -1
                else:
                    key = r << 32 | t
                    new = rank[p] = pairs[key] if key in pairs else pair(key)
                    if new >= 0:
                        lower = new < r
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(pending, new)
                b = before[p]
                if b >= 0 and token[b] >= 0:
                    key = token[b] << 32 | r
                    new = rank[b] = pairs[key] if key in pairs else pair(key)
                    if new >= 0:
                        lower |= new < r
                        if new in index:
                            index[new].append(b)
                        else:
                            index[new] = [b]
                            heapq.heappush(pending, new)
                if lower:  # a pair of lower rank goes first; the rest of this rank waits
                    index[r] = places[i + 1 :] + index.get(r, [])
                    heapq.heappush(pending, r)
                    break


class Encoder:
    """Encodes texts block by block; remembers the decimal text of each word's ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.forget = self.clear  # one bound method, so that hold() knows it again
        self.texts: dict[str, str] = {}

    def clear(self) -> None:
        self.texts.clear()
        self.vocabulary.pairs.clear()

    def block(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them remembered."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.texts) > REMEMBER:
            self.clear()
        fresh = [w for w in set().union(*split) if w not in self.texts]
        encoded = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
        self.texts.update(zip(fresh, [" ".join(map(str, ids)) for ids in encoded]))
        return split


@lru_cache(2)
def encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(lines.split(b"\n")), pattern)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's lines; a vocabulary is a few MB at most."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    ranks: path of a tiktoken rank file on the driver; its content (under 1 MB) goes out as a broadcast variable.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = spark.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, enc = to_arrow_schema(out), encoder(content.value, pattern)
        hold(enc.forget)

        def rows(keys, texts):
            columns = [keys, [], [], [], []]
            split = enc.block(texts)
            text, token = enc.texts.__getitem__, enc.vocabulary.by_text.__getitem__
            for words in split:
                decimal = " ".join(map(text, words))
                ids = decimal.split()
                columns[1].append(len(ids))
                columns[2].append(hashlib.sha256(decimal.encode()).hexdigest())
                columns[3].append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
                if with_ids:
                    columns[4].append(np.fromstring(decimal, dtype=np.int32, sep=" "))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts)

    return in_arrow(docs.select("doc_id", "text"), run, out)
