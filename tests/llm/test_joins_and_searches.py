"""The n-gram join, hard negatives and ranked lexical search, and what verbatim passages and the mix promise."""

import math
import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptrail.llm import balltree, lexical, mixing, ngramjoin, queries, substring

RNG = random.Random(23)
VOCABULARY = ["".join(RNG.choice("abcdefghijk") for _ in range(5)) for _ in range(2000)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
    return words


def frame(spark, rows):
    """doc_id and text, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, cid string, token string")


# ---- n-gram Jaccard join


def slow_join(rows, width, num):
    sets = []
    for _, t in rows:
        words = [w.lower() for w in (t or "").encode().split()]
        sets.append({tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(doc_id), len(sets[i]), str(least.get(find(i))) if sets[i] else str(doc_id)) for i, (doc_id, _) in enumerate(rows))


def joined(docs, **how):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngramjoin.jaccard_join(docs, **how).collect())


def texts_for_joins():
    texts = []
    for n in (12, 30, 31, 80, 200):
        base = prose(n)
        for k in (0, 0, 1, 1, 2, 3, 6):
            texts.append(" ".join(edited(base, k)))
    base = prose(70)
    texts += [" ".join(base[:-k] if k else base) for k in range(12)]  # a chain: ends are not linked
    line = prose(40)
    texts += [" ".join(line + prose(RNG.choice([5, 40]))) for _ in range(20)]
    texts += ["", None, "  \n\t", "one", "ONE", "one two", "one two three", "one  two\tTHREE", "word " * 5000, "word " * 400, " ".join(prose(6000))]
    RNG.shuffle(texts)
    return texts


@pytest.mark.parametrize("cell", [131_072, 700])
def test_join_against_all_pairs(spark, monkeypatch, cell):
    """Small cells: shingles of several cells, centres and pairs of blocks."""
    monkeypatch.setattr(ngramjoin, "CELL", cell)
    monkeypatch.setattr(ngramjoin, "EACH", 100)
    monkeypatch.setattr(ngramjoin, "WEIGHT", "n + 100")
    rows = list(enumerate(texts_for_joins()))
    rows += [(3, rows[9][1]), (3, rows[10][1]), rows[5], rows[5], (None, rows[7][1]), (None, "null ids " * 9), (None, "null ids " * 9), (None, None)]
    got = joined(frame(spark, rows))
    assert got == slow_join(rows, 3, 90)


def test_join_of_a_large_group(spark, monkeypatch):
    """Two groups of hundreds of different near copies, whose shingles need many cells."""
    monkeypatch.setattr(ngramjoin, "CELL", 6000)
    rows = []
    for _ in range(2):
        base = prose(90)
        rows += [(len(rows) + i, " ".join(edited(base, 1))) for i in range(250)]
    assert joined(frame(spark, rows)) == slow_join(rows, 3, 90)


def test_join_of_nothing(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)])
    assert joined(docs.where("false")) == []
    assert joined(docs) == [("1", 1, "1"), ("2", 0, "2")]


def test_numbers_keep_one_order():
    """Equal shingles have equal numbers in whatever text, and rare words come first."""
    frequent = ngramjoin.np.sort(np.array([7, 9], dtype=np.uint64)), np.array([40, 40])
    a = ngramjoin.numbers(np.array([7, 9, 7, 1, 2, 3], dtype=np.uint64), 3, frequent)
    b = ngramjoin.numbers(np.array([1, 2, 3, 7, 9, 7], dtype=np.uint64), 3, frequent)
    assert a[0] == b[3] and a[3] == b[0] and a[3] < a[0] and (a >= 0).all()


# ---- hard negatives


def slow_negatives(rows, every=100, positives=5, negatives=10):
    usable = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        near = [(-sum(map(lambda a, b: a * b, v, w)), j, m) for j, m, w in usable if j != i and len(w) == len(v)]
        for s, j, _ in sorted((s, j, 0) for s, j, m in near if m == label)[:positives]:
            inside = sorted((t, k) for t, k, m in near if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf", "block"), [(8192, 256, 8192), (60, 5, 4)])
def test_hard_negatives(spark, shard, leaf, block):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(420):
        v = rng.normal(0, 0.1, 8) + 0.15
        rows.append((i * 10, int(rng.integers(0, 4)), [float(x) for x in v]))
    rows += [(100, 1, rows[3][2]), rows[7], rows[7], (5, 2, [float("nan")] * 8), (6, 2, [None] + [0.1] * 7), (7, None, [0.1] * 8), (8, 1, None), (None, 1, [0.2] * 8)]
    rows += [(200 + i, i % 3, [0.5, 0.25]) for i in range(0, 300, 50)]  # ties, and another length
    rows += [(900, 0, []), (1, 1, []), (2, 0, [])]
    rows += [(10_000, 0, [1e150] * 3), (10_001, 0, [1e150] * 3), (10_003, 1, [4e149] * 3), (20_000, 0, [3e6] * 3), (20_001, 0, [3e6] * 3), (20_003, 1, [1e6] * 3)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, label int, embedding array<double>, score int, dim int")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r[n] for n in names) for r in balltree.hard_negatives(table, shard=shard, leaf=leaf, block=block).collect())
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    small = [r for r in rows if r[0] is None or not 10_000 <= r[0] < 20_000]
    assert [g for g in got if not 10_000 <= g[0] < 20_000] == [(*w[:4], clip(w[4]), clip(w[5])) for w in slow_negatives(small)]
    assert balltree.hard_negatives(table.where("false")).count() == 0
    assert balltree.hard_negatives(table.where("label = 1")).count() == 0


def test_balls_hold_their_points():
    rng = np.random.default_rng(4)
    points, labels = rng.normal(size=(500, 6)), rng.integers(0, 3, 500)
    order, nodes = balltree.balls(points, labels, 20)
    assert sorted(order.tolist()) == list(range(500))
    for low, high, child, centre, radius, label in zip(*(nodes[k] for k in ("low", "high", "child", "centre", "radius", "label"))):
        mine = points[order[low:high]]
        assert (labels[order[low:high]] == label).all() and np.sqrt(((mine - centre) ** 2).sum(axis=1)).max() <= radius + 1e-12
        assert child >= 0 or high - low <= 20
        if child >= 0:
            assert (nodes["low"][child], nodes["high"][child], nodes["low"][child + 1], nodes["high"][child + 1]) == (low, nodes["low"][child + 1], nodes["high"][child], high)


# ---- ranked lexical search


def slow_search(docs, items, most=50):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n, length = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, w in bags:
            m = 50 + (50 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) if t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "block"), [(16_384, 2_000_000), (64, 8), (7, 30)])
def test_lexical_search(spark, window, block):
    words = VOCABULARY[:40] + ["Été", "naïve", "x1", "2024", "日本"]
    text = lambda n: "".join(RNG.choice(words) + RNG.choice([" ", "-", ".\n", "_", "  "]) for _ in range(n))
    docs = [(i * 3, text(RNG.choice([1, 5, 40]))) for i in range(300)]
    docs += [(1, None), (2, ""), (4, "!!! ..."), (None, text(30)), (None, docs[5][1]), (9, docs[5][1]), docs[6], docs[6], (10**12, text(3000)), (-5, docs[5][1].upper())]
    items = [(i, text(RNG.choice([1, 3, 10]))) for i in range(12)] + [(50, None), (51, "---"), (52, "nothing-here-matches"), (3, text(2)), (4, docs[5][1])]
    items += [items[0], items[0]]
    d = spark.createDataFrame([(*r, 0, "s") for r in docs], "doc_id long, text string, score int, item_id string")
    q = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id int")
    found = lexical.search(d, q, window=window, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_search(docs, items)
    assert lexical.search(d.where("false"), q).count() == lexical.search(d, q.where("false")).count() == 0
    assert lexical.search(d.where("text = ''"), q).count() == 0


def test_queries_have_sql():
    for n in (11, 12, 13):
        assert [k for k in queries.ORACLE_SQL if k.startswith(f"op{n}_")]


# ---- verbatim passages, from both sides


def test_no_word_is_marked_that_is_not_in_a_repeated_passage(spark):
    """Runs of exactly 50 words are marked to the word, and runs of 49 not at all."""
    rows, want = [], {}
    for i in range(700):
        n = 50 if i % 2 else 49
        shared, i = prose(n), len(rows)
        head = RNG.randrange(3, 40)
        beside = [[f"{side}{i}{k}" for k in "xy"] for side in "ab"]  # the words at both ends differ
        rows += [(i + k, " ".join(prose(before) + [beside[0][k]] + shared + [beside[1][k]] + prose(25))) for k, before in enumerate((20, head))]
        if n == 50:
            want[i + 1] = [(head + 1, head + 50)]
    got = {}
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"]))
    assert {k: substring.merge(v) for k, v in got.items()} == want


# ---- mixing


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_each_source_comes_near_its_target(spark):
    """Sources of 50 documents of 1 to 5000 words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("size").alias("least"))
    for r in rows.collect():
        assert abs(r["taken"] - r["target"]) <= max(0.01 * r["target"], r["least"])
