"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Each model is a logistic regression on the words that a text
holds, and on the log odds of all earlier categories. In training these log odds are out of fold:
documents are dealt to folds by a hash of doc_id, and a fold's come from a model of the other folds,
whose words were chosen on the other folds too, so that later models see earlier predictions as good
as they will be on new text. The cutoff of a category is that of the best F1 out of fold.

Models are fitted on a sample of about `most` labelled documents, chosen by a hash of doc_id (all, if
there are fewer), of which those with more than `widest` different words are left out: so much the
driver holds at most. Each model has the `vocabulary` words that tell the categories apart best;
scoring covers every whole text.

Defined cases: null or wordless text has no features and gets the prior; labels that are null, or
neither 0 nor 1, are left out for their category, as are those of a doc_id that contradict each other;
a doc_id counts once however often its label is repeated; where documents repeat a doc_id, the least
set of words counts; a category without both classes predicts its share, and its cutoff is above 1;
without labels all is 0; repeated documents repeat their row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import arrow_map, small_enough

#: Bytes that aren't part of a word become spaces: ASCII except letters, digits and the apostrophe.
_plain = bytes(i if i >= 128 or chr(i).isalnum() or i == 39 else 32 for i in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_plain).split()) if text else set()


@dataclass
class Rows:
    """Sparse 0/1 rows: columns of row i are index[start[i]:start[i + 1]]."""

    index: np.ndarray
    start: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(w[self.index])]
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(r, np.diff(self.start)), minlength=size)

    def take(self, at: np.ndarray) -> Rows:
        parts = [self.index[self.start[i] : self.start[i + 1]] for i in at]
        return Rows(np.concatenate(parts) if parts else self.index[:0], np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64))


@dataclass
class Linear:
    """A logistic model on words and on earlier log odds."""

    words: np.ndarray
    links: np.ndarray
    bias: float

    def odds(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return rows.dot(self.words) + earlier @ self.links + self.bias


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, size: int, ridge: float = 2.0, steps: int = 120) -> Linear:
    """Ridge logistic regression by accelerated gradient steps with per-feature step sizes."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Linear(np.zeros(size), np.zeros(earlier.shape[1]), float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    # the curvature bound of a feature, times the features a row has at most together: a safe diagonal step
    longest = np.diff(rows.start) + earlier.shape[1] + 1.0
    curve = rows.back(longest / 4, size) * min(1.0, 8 * prior * (1 - prior) + 0.1) + ridge
    scale = np.abs(earlier).max(axis=0, initial=1.0)
    curve_links = (longest[:, None] * earlier**2).sum(axis=0) / 4 + ridge * scale**2
    curve_bias = longest.sum() / 4 + 1e-9
    w, u, b = model.words, model.links, model.bias
    w0, u0, b0 = w, u, b
    for t in range(steps):
        m = t / (t + 3.0)
        wm, um, bm = w + m * (w - w0), u + m * (u - u0), b + m * (b - b0)
        r = 1 / (1 + np.exp(-np.clip(rows.dot(wm) + earlier @ um + bm, -30, 30))) - y
        w0, u0, b0 = w, u, b
        w = wm - (rows.back(r, size) + ridge * wm) / curve
        u = um - (earlier.T @ r + ridge * um) / curve_links
        b = bm - r.sum() / curve_bias
    return Linear(w, u, float(b))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)
    cutoffs: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> list[float]:
        """The probability of each category, each fed the log odds of those before it."""
        found = [self.vocabulary[w] for w in words_of(text) if w in self.vocabulary]
        odds: list[float] = []
        for m in self.models:
            odds.append(float(np.clip(m.words[found].sum() + np.dot(m.links, odds) + m.bias, -30, 30)))
        return [1 / (1 + float(np.exp(-o))) for o in odds]


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff of the best F1; between the last probability taken and the next."""
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    distinct = np.r_[p[order][1:] < p[order][:-1], True]
    i = int(np.argmax(np.where(distinct, f1, -1)))
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0.0)) / 2)


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], most: int, widest: int, folds: int) -> DataFrame:
    """doc_id, words, y (a list; -1 for none) and fold of about `most` labelled documents, one row for each doc_id."""
    ys = [f"y{i}" for i in range(len(categories))]
    clean = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).cast("int")
    known = labels.where("doc_id is not null").select("doc_id", *(clean(c).alias(y) for c, y in zip(categories, ys)))
    one = lambda y: F.when(F.min(y) == F.max(y), F.min(y)).otherwise(-1).alias(y)
    known = known.groupBy("doc_id").agg(*map(one, ys))
    share = min(1.0, most / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), 1_000_003) < share * 1_000_003)
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(known) if small_enough(known, 4 * most) else known, "doc_id")

    def features(key, text, *y):
        words = words_of(text)
        if len(words) <= widest:
            yield key, sorted(words), y

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(rows, ["doc_id", "text", *ys], features, f"doc_id {kind}, words array<binary>, y array<int>")
    rows = rows.groupBy("doc_id").agg(F.min("words").alias("words"), F.min("y").alias("y"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(folds)))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = 6000, vocabulary: int = 4000, folds: int = 5, widest: int = 20_000) -> Chain:
    """A chain from docs(doc_id, text) and labels(doc_id, categories...)."""
    rows = sample(docs, labels, categories, most, widest, folds).orderBy("doc_id").toArrow()
    y = np.array(rows.column("y").to_pylist(), dtype=int).reshape(rows.num_rows, len(categories))
    fold = np.array(rows.column("fold").to_pylist(), dtype=int)
    return fit_chain((w.as_py() for chunk in rows.column("words").chunks for w in chunk), y, fold, categories, vocabulary, folds)


def choose_words(at: list[np.ndarray], names: list[bytes], y: np.ndarray, size: int, least: int = 4) -> list[int]:
    """The words of at least `least` texts that tell some category apart best, by a standardised difference. at: word numbers of each text."""
    n = np.bincount(np.concatenate(at) if at else np.zeros(0, dtype=np.int64), minlength=len(names)).astype(float)
    worth = np.zeros(len(names))
    for c in range(y.shape[1]):
        pos = [a for a, v in zip(at, y[:, c]) if v == 1]
        total, share = (y[:, c] >= 0).sum(), (y[:, c] == 1).sum()
        if 0 < share < total:
            hits = np.bincount(np.concatenate(pos), minlength=len(names)).astype(float)
            expect = n * share / total
            worth = np.maximum(worth, np.abs(hits - expect) / np.sqrt(expect * (1 - share / total) + 0.5))
    worth[n < least] = 0
    return sorted(np.flatnonzero(worth > 0).tolist(), key=lambda i: (-worth[i], names[i]))[:size]


@dataclass
class Texts:
    """Texts as lists of word numbers, and the words by number."""

    at: list[np.ndarray]
    names: list[bytes]

    def rows(self, chosen: list[int]) -> Rows:
        """Rows whose columns are the chosen words, in their order."""
        place = np.full(len(self.names) + 1, -1, dtype=np.int64)
        place[chosen] = np.arange(len(chosen))
        found = [place[a][place[a] >= 0] for a in self.at]
        return Rows(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64))


def out_of_fold(texts: Texts, y: np.ndarray, fold: np.ndarray, vocabulary: int, folds: int) -> np.ndarray:
    """Log odds of each text and category by models that have seen nothing of the text's fold, nor chosen words by it."""
    odds = np.zeros(y.shape)
    made = []
    for f in range(folds):
        others = np.flatnonzero(fold != f)
        made.append(texts.rows(choose_words([texts.at[i] for i in others], texts.names, y[others], vocabulary)))
    for c in range(y.shape[1]):
        for f, rows in enumerate(made):
            inside, outside = np.flatnonzero((y[:, c] >= 0) & (fold != f)), np.flatnonzero(fold == f)
            model = fit(rows.take(inside), odds[inside, :c], y[inside, c], vocabulary)
            odds[outside, c] = model.odds(rows.take(outside), odds[outside, :c])
        odds[:, c] = np.clip(odds[:, c], -30, 30)
    return odds


def fit_chain(words: Iterable[list[bytes]], y: np.ndarray, fold: np.ndarray, categories: list[str], vocabulary: int, folds: int) -> Chain:
    """Fit the chain on word lists, which are turned into numbers one by one."""
    index: dict[bytes, int] = {}
    at = [np.array([index.setdefault(w, len(index)) for w in t], dtype=np.int32) for t in words]
    texts = Texts(at, list(index))
    odds = out_of_fold(texts, y, fold, vocabulary, folds)
    chosen = choose_words(texts.at, texts.names, y, vocabulary)
    chain, rows = Chain(categories, {texts.names[i]: j for j, i in enumerate(chosen)}), texts.rows(chosen)
    for c in range(len(categories)):
        at = np.flatnonzero(y[:, c] >= 0)
        chain.models.append(fit(rows.take(at), odds[at, :c], y[at, c], len(chosen)))
        chain.cutoffs.append(best_cutoff(1 / (1 + np.exp(-odds[at, c])), y[at, c]))
    return chain


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, p_<category> for each category, and <last category> (whether it reaches its cutoff)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    last = chain.categories[-1]

    def one(key, text):
        p = shared.value.score(text)
        yield key, *p, p[-1] >= shared.value.cutoffs[-1]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, ["doc_id", "text"], one, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in chain.categories) + f", {last} boolean")
