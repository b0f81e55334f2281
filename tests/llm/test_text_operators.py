"""Operators on single texts: BPE, quality, toxicity, language ID."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from peptrail.llm import bpe, langid, quality, toxicity
from peptrail.llm.queries import held_out

LONG = "word " * 200_000
ODD = [None, "", "  \n\t", "a", "aaaa aaaaaaaaaaa", "naïve café 数学 🙂🙂  x", "x" * 50_000, "1234567890 !!!??? 'll 're", LONG, "\x1c\x85 a b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(1, "", "en", 0), (None, "null id", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_bpe_is_tiktoken(spark, odd, ranks):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode(odd, *args, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    texts = dict(enumerate(ODD)) | {None: "null id"}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = want.encode_ordinary(text)
        assert (list(r["ids"]), r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty(spark), *args).count() == 0


def test_bpe_random_vocabularies():
    """Vocabularies in which a later merge may have a lower rank, against merging word by word."""
    rng = random.Random(5)
    for _ in range(150):
        tokens = [bytes([i]) for i in range(256)]
        pool = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        order = tokens + rng.sample(sorted(pool), len(pool))
        v = bpe.Vocabulary(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(20)]
        assert v.encode_words(words) == [slow_merge(w, v.ranks) for w in words]


def slow_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c#", "<d>"]) + rng.choice(["", "\n", "\n\n"]) for _ in range(n)) for n in (0, 7, 8, 9, 40, 300)]
    for text in texts + [t for t in ODD if t is not None]:
        assert quality.measure(text)[:5] == slow_statistics(text)


def test_quality_bounds():
    for k, n in ((0, 50), (3, 100), (100, 100), (20, 2000)):
        p = quality.upper_bound(k, n, 0.01)
        assert p == 1.0 if k == n else abs(sum(np.exp(np.cumsum(np.log(np.r_[1, (n - np.arange(k)) / np.arange(1, k + 1)])) + np.arange(k + 1) * np.log(p) + (n - np.arange(k + 1)) * np.log1p(-p))) - 0.01) < 1e-6
    # no step where counts grow: the bound moves by about one part in k
    bounds = [quality.upper_bound(k, 2_000_000, 1e-4) for k in range(99_998, 100_004)]
    assert all(0 < b - a < 1e-6 for a, b in zip(bounds, bounds[1:]))
    assert abs(quality.upper_bound(200_000, 10_000_000, 0.01) - 0.0201033) < 1e-6
    assert abs(quality.beta_share(0.3, 2, 3) - 0.3483) < 1e-12


def slow_kept(rows, labels, risk=0.1, delta=0.05, steps=5):
    """The verdict on rows(doc_id, text) by definition, with binomial sums in whole numbers."""
    import struct
    from fractions import Fraction

    import xxhash

    def at_most(k, n, p):  # P(X <= k)
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    facts = {}
    for key, text in rows:
        n_words, chars, symbols, dup, again, lines, capitals, marks = quality.measure(text)
        band = max(i for i, low in enumerate(quality.BANDS) if n_words >= low)
        facts[key] = band, dict(zip(quality.SIGNALS, (symbols / max(n_words, 1), again / max(n_words, 1), dup / max(lines, 1), capitals / max(chars, 1), marks / max(n_words, 1)))), n_words < 20 or 100 * again > 30 * n_words
    known = {}
    for key, q in labels:
        if key is not None and q in (0, 1):
            known.setdefault(key, set()).add(q)
    known = {k: min(q) for k, q in known.items() if len(q) == 1 and k in facts}
    half = {k: xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % 2 for k in known}
    share, trust, cut = Fraction(risk) / 5, delta / (5 * 5 * steps), {}
    for band in range(5):
        for signal in quality.SIGNALS:
            mine = [(facts[k][1][signal], q, half[k]) for k, q in known.items() if facts[k][0] == band]
            gain = [sum(1 if q == 0 else -2 for v, q, h in mine if h == 0 and v >= g) for g in quality.GRID]
            best = max(range(len(gain)), key=lambda i: (gain[i], i))
            good = [v for v, q, h in mine if q == 1 and h == 1]
            for i in range(best, min(best + steps, len(gain))) if gain[best] > 0 and good else ():
                k = sum(v >= quality.GRID[i] for v in good)
                if k < len(good) and at_most(k, len(good), float(share)) <= trust:  # the bound is within the share
                    cut[band, signal] = quality.GRID[i]
                    break
    return {k: not failed and not any((band, s) in cut and v >= cut[band, s] for s, v in values.items()) for k, (band, values, failed) in facts.items()}, cut


def test_quality_verdict_by_definition(spark):
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(6000):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([10, 90, 90, 200, 200]))]
        bad = rng.random() < 0.4
        if rng.random() < (0.8 if bad else 0.003):
            words = [w + rng.choice(["", "$", "#$"]) for w in words]
        if rng.random() < (0.5 if bad else 0.002):
            words = [w.upper() if rng.random() < 0.4 else w for w in words]
        rows.append((i, " ".join(words)))
        labels += [(i, int(not bad))] * rng.choice([1, 1, 1, 0, 9])
        if i % 97 == 0:
            labels.append((i, rng.choice([0, 1, 3, None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.filter_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want, cut = slow_kept(rows, labels)
    assert got == want and len(cut) >= 3


def test_quality_repeated_labels_are_one_trial(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefgh") * 3 + ("$$" if i >= 4 else "") for _ in range(70))) for i in range(8)]
    docs = spark.createDataFrame(texts * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)] * 300 + [(1, 0)], "doc_id long, quality int")
    measured = quality.statistics(docs)
    assert quality.trials(measured, labels).count() == 7 and quality.thresholds(measured, labels) == {}


def test_quality_filter(spark, odd):
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80))
    rows = [(i, prose(), 1) if i % 3 else (i, " ".join(w + "$$$" for w in prose().split()), 0) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 7) for i, _, q in rows] + [(None, 1, 7), (5, None, 7)], "doc_id long, quality int, n_words int")
    got = {r["doc_id"]: r for r in quality.filter_quality(docs, labels).collect()}
    good = [got[i]["kept"] for i, _, q in rows if q]
    assert sum(not k for k in good) <= 0.1 * len(good)
    assert not any(got[i]["kept"] for i, _, q in rows if not q)
    none = labels.where("false")
    edge = quality.filter_quality(odd, none).collect()
    assert len(edge) == len(ODD) + 2 and all(r["kept"] != r["base_failed"] for r in edge)
    assert quality.filter_quality(empty(spark), none).count() == 0


def test_toxicity(spark, odd):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        bad, toxic = i % 4 == 0, i % 6 == 0
        words += ["zzjunk!"] * bad + [rng.choice(["Nasty,", "VILE"])] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:900]] + [(None, 1, 1), (3, None, 5)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    assert len(chain.models[1].links) == 1
    got = {r["doc_id"]: r for r in toxicity.classify(docs, chain).collect()}
    held = rows[900:]
    assert sum(got[r[0]]["toxic"] != bool(r[3]) for r in held) <= 6
    assert toxicity.classify(odd, chain).count() == len(ODD) + 2
    assert toxicity.classify(empty(spark), chain).count() == 0
    blank = toxicity.train(docs, labels.where("false"), ["low_quality", "toxic"])
    assert not any(r["toxic"] for r in toxicity.classify(odd, blank).collect())


def test_toxicity_later_models_see_out_of_fold_odds():
    rng = np.random.default_rng(0)
    y0 = rng.integers(0, 2, 400)
    texts = [[b"first"] if v else [b"other"] for v in y0]
    chain = toxicity.fit_chain(texts, np.c_[y0, y0], rng.integers(0, 5, 400), ["a", "b"], 10, 5)
    assert chain.models[1].links[0] > 0 and chain.score("first")[1] > 0.9 > 0.1 > chain.score("other")[1]


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_random_labels_teach_nothing():
    """Out-of-fold odds for labels that have nothing to do with the texts are no better than chance."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        texts = toxicity.Texts([np.unique(rng.integers(0, 8000, 60)) for _ in range(1500)], [b"%d" % i for i in range(8000)])
        y, fold = rng.integers(0, 2, (1500, 2)), rng.integers(0, 5, 1500)
        odds = toxicity.out_of_fold(texts, y, fold, 1000, 5)
        assert all(0.45 < auc(odds[:, c], y[:, c]) < 0.55 for c in (0, 1))


def slow_model(x, earlier, y, ridge=2.0):
    """The ridge logistic model by Newton's steps on dense rows; weights, links and bias."""
    scale = np.abs(earlier).max(axis=0, initial=1.0)
    z = np.c_[x, earlier, np.ones(len(y))]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w = np.r_[np.zeros(z.shape[1] - 1), np.log(prior / (1 - prior))]
    if 0 < y.sum() < len(y):
        damp = np.r_[np.full(x.shape[1], ridge), ridge * scale**2 * np.ones(earlier.shape[1]), 1e-9]
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(damp), z.T @ (p - y) + damp * w)
    return w


def slow_chain(texts, y, fold, vocabulary, folds):
    """The chain by definition, on word sets: (words, model of each category), and the out-of-fold odds."""

    def choose(at):
        names = sorted(set().union(*(texts[i] for i in at)))
        worth = {}
        for w in names:
            has = np.array([w in texts[i] for i in at])
            if has.sum() >= 4:
                for c in range(y.shape[1]):
                    v = y[at, c]
                    total, share = (v >= 0).sum(), (v == 1).sum()
                    if 0 < share < total:
                        expect = has.sum() * share / total
                        worth[w] = max(worth.get(w, 0), abs(has[v == 1].sum() - expect) / np.sqrt(expect * (1 - share / total) + 0.5))
        return sorted((w for w in worth if worth[w] > 0), key=lambda w: (-worth[w], w))[:vocabulary]

    def dense(at, words):
        return np.array([[float(w in texts[i]) for w in words] for i in at]).reshape(len(at), len(words))

    every, odds = np.arange(len(texts)), np.zeros(y.shape)
    chosen = [choose(every[fold != f]) for f in range(folds)]
    words = choose(every)
    models = []
    for c in range(y.shape[1]):
        for f in range(folds):
            inside, outside = every[(fold != f) & (y[:, c] >= 0)], every[fold == f]
            w = slow_model(dense(inside, chosen[f]), odds[inside, :c], y[inside, c])
            odds[outside, c] = np.c_[dense(outside, chosen[f]), odds[outside, :c], np.ones(len(outside))] @ w
        odds = np.clip(odds, -30, 30)
        at = every[y[:, c] >= 0]
        models.append(slow_model(dense(at, words), odds[at, :c], y[at, c]))
    return words, models, odds


def test_toxicity_is_the_chain_by_definition(spark):
    rng = random.Random(21)
    vocabulary = [b"w%d" % i for i in range(60)]
    texts, y = [], []
    for i in range(300):
        bad = rng.random() < 0.4
        toxic = rng.random() < (0.6 if bad else 0.1)
        words = set(rng.sample(vocabulary, 12)) | ({b"junk"} if bad and rng.random() < 0.8 else set()) | ({b"vile"} if toxic and rng.random() < 0.7 else set())
        texts.append(words)
        y.append([int(bad) if i % 11 else -1, int(toxic)])
    y, fold = np.array(y), np.array([rng.randrange(5) for _ in texts])
    chain = toxicity.fit_chain([sorted(t) for t in texts], y, fold, ["low_quality", "toxic"], 40, 5)
    words, models, _ = slow_chain(texts, y, fold, 40, 5)
    assert sorted(chain.vocabulary) == sorted(words)
    docs = spark.createDataFrame([(i, b" ".join(sorted(t)).decode()) for i, t in enumerate(texts)] + [(900, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, chain).collect()}
    for i, t in [*enumerate(texts), (900, set())]:
        odds = []
        for c, w in enumerate(models):
            odds.append(float(np.clip(np.r_[[float(x in t) for x in words], odds, 1.0] @ w, -30, 30)))
        p = [1 / (1 + np.exp(-o)) for o in odds]
        assert abs(got[i]["p_low_quality"] - p[0]) < 0.06 and abs(got[i]["p_toxic"] - p[1]) < 0.06  # the fit stops after its fixed number of steps
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= chain.cutoffs[1])


def test_toxicity_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i} x", "c") for i in range(50)] * 4 + [(3, "other text", "c"), (7, " ".join(map(str, range(300))), "c")], "doc_id long, text string, words string")
    labels = spark.createDataFrame([(i, i % 2, 0, "c") for i in range(40)] * 30 + [(4, 1, 0, "c"), (5, None, 7, "c"), (None, 1, 1, "c"), (99, 1, 1, "c")], "doc_id long, low_quality int, toxic int, text string")
    rows = {r["doc_id"]: r for r in toxicity.sample(docs, labels, ["low_quality", "toxic"], 6000, 100, 5).collect()}
    assert len(rows) == 40 and rows[4]["y"] == [-1, 0] and rows[5]["y"] == [1, 0] and rows[3]["words"] == [b"other", b"text"] and rows[7]["words"] == [b"word7", b"x"]
    few = toxicity.sample(docs, labels, ["low_quality", "toxic"], 10, 100, 5).count()
    assert 0 < few < 25


def slow_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[:, None] - penalty * (1 - np.eye(len(row)))
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi():
    rng = np.random.default_rng(1)
    worth = lambda s, path, pen: sum(s[i][p] for i, p in enumerate(path)) - pen * sum(a != b for a, b in zip(path, path[1:]))
    for n in (1, 2, 5, 60):
        for _ in range(200):
            s = rng.normal(0, 3, (n, 3)) + rng.choice([0, 2], (n, 3))
            pen = float(rng.choice([1, 5, 12]))
            assert abs(worth(s, langid.viterbi(s, pen), pen) - worth(s, slow_viterbi(s, pen), pen)) < 1e-9


def test_langid(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.where(~held_out(docs["doc_id"])))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = docs.where(held_out(docs["doc_id"]) & docs["lang"].isNotNull()).collect()
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    by = {r["lang"]: r["text"] for r in docs.collect() if len(r["text"]) > 400}
    a, b = sorted(by)[:2]
    tag = langid.Tagger(model)
    words, path, _ = tag.spans(by[a][:300] + " " + by[b][:300])
    half = len(by[a][:300].split())
    assert np.mean(path[:half] == model.languages.index(a)) > 0.8 and np.mean(path[half:] == model.languages.index(b)) > 0.8
    edge = langid.identify(odd, model).collect()
    assert len(edge) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in edge)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in edge if r["doc_id"] in (0, 1, 2))
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
