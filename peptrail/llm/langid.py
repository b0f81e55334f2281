"""Language identification of mixed-language text.

A word's script, from ranges of code points, narrows the languages that it may have; each of those
scores it by smoothed character-trigram log odds. Viterbi over the words of a text, with a penalty
for each switch, labels its spans; the language of most letters is the text's, and its share of the
letters the score. Texts without a profitable switch are recognised by a bound and skip the search.

Defined cases: null text or text without a letter is `und` with score 0; equal shares go to the
language first by code point; words without a letter take the language of their span; languages
are those met in training (a null lang teaches nothing); without any, all is `und`; repeated rows
repeat their result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import arrow_map, hold, in_arrow

UND = "und"
#: First code points of ranges and the scripts that begin there (fixed values, from the Unicode blocks).
RANGES = ((0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"))
SCRIPTS = tuple(sorted({name for _, name in RANGES}))
_starts = np.array([start for start, _ in RANGES])
_script = np.array([SCRIPTS.index(name) for _, name in RANGES])
_letters: dict[int, np.ndarray] = {}
BUCKETS = 1 << 16
PENALTY, FLOOR, NARROW = 12.0, -30.0, 0.001


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; looked up in pages of 256."""
    out = np.zeros(len(codes), dtype=bool)
    pages = codes >> 8
    for page in np.unique(pages).tolist():
        if page not in _letters:
            _letters[page] = np.array([chr(page << 8 | i).isalpha() for i in range(256)])
        at = pages == page
        out[at] = _letters[page][codes[at] & 255]
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, each word's first bucket, its letters and its script (of the first letter)."""
    text = "  ".join(words) + "  "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    letter = is_letter(codes)
    plain = np.where(letter, codes, 32)
    p, q = np.r_[32, plain[:-1]], np.r_[plain[1:], 32]
    mixed = (p * 0x9E3779B1 + plain * 0x85EBCA77 + q * 0xC2B2AE3D) & 0xFFFFFFFF
    grams = (mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 7 & (BUCKETS - 1)
    grams[~letter] = BUCKETS  # a trigram counts at its middle letter
    counts = np.add.reduceat(letter.astype(np.int64), starts)
    first = np.minimum(np.searchsorted(np.flatnonzero(letter), starts), max(int(letter.sum()) - 1, 0))
    where = np.flatnonzero(letter)[first] if letter.any() else np.zeros(len(words), dtype=np.int64)
    scripts = _script[np.searchsorted(_starts, codes[where], side="right") - 1]
    return grams, starts, counts, scripts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1) x languages, log odds against the mean; 0 for no trigram
    allowed: np.ndarray  # scripts x languages

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and letters of each word."""
        grams, starts, counts, scripts = word_features(words)
        scores = np.add.reduceat(self.weights[grams], starts, axis=0)
        barred = ~self.allowed[scripts] & self.allowed[scripts].any(axis=1, keepdims=True)
        return np.where(counts[:, None] > 0, np.where(barred, FLOOR, scores), 0.0), counts


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path; staying and the lower index win ties."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, [best]], axis=0)])
    if gain.max() <= penalty / 2 and (gain[-1] - gain).max() <= penalty / 2 and (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        # against the best single language, a first or last segment gains at most half a penalty and any other at most
        # one; s segments gain at most the s - 1 penalties of their switches, so none is worth while
        return np.full(len(scores), best)
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(value)
        source, bar = value.index(top), top - penalty
        back.append([j if v >= bar else source for j, v in enumerate(value)])
        value = [e + (v if v >= bar else bar) for e, v in zip(row, value)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


class Tagger:
    """Labels texts, remembering the scores of up to `limit` words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.forget = self.clear  # one bound method, so that hold() knows it again
        self.model, self.limit, self.index = model, limit, {}
        self.scores, self.counts = np.zeros((0, len(model.languages))), np.zeros(0, dtype=np.int64)

    def clear(self) -> None:
        self.index, self.scores, self.counts = {}, np.zeros((0, len(self.model.languages))), np.zeros(0, dtype=np.int64)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fresh = [w for w in set(words) if w not in self.index]  # a set less dict.keys() would walk through the whole index
        if fresh:
            if len(self.index) + len(fresh) > self.limit:
                self.clear()
                fresh = list(set(words))
            base = len(self.index)
            self.index.update((w, base + i) for i, w in enumerate(fresh))
            scores, counts = self.model.score(fresh)
            need = len(self.index)
            if need > len(self.scores):
                grown = np.zeros((max(2 * need, 4096), len(self.model.languages)))
                grown[: need - len(fresh)] = self.scores[: need - len(fresh)]
                more = np.zeros(len(grown), dtype=np.int64)
                more[: need - len(fresh)] = self.counts[: need - len(fresh)]
                self.scores, self.counts = grown, more
            self.scores[need - len(fresh) : need], self.counts[need - len(fresh) : need] = scores, counts
        at = np.array(list(map(self.index.__getitem__, words)), dtype=np.int64)
        return self.scores[at], self.counts[at]

    def spans(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, the index of each word's language and its letters."""
        words = text.lower().split() if text else []
        if not words or not self.model.languages:
            return words, np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        scores, counts = self.lookup(words)
        return words, viterbi(scores), counts

    def predict(self, text: str | None) -> tuple[str, float]:
        _, path, counts = self.spans(text)
        if not counts.sum():
            return UND, 0.0
        share = np.bincount(path, weights=counts, minlength=len(self.model.languages)) / counts.sum()
        return self.model.languages[int(share.argmax())], float(share.max())


def train(docs: DataFrame, per_language: int = 2000, smoothing: float = 0.5) -> Model:
    """A model from docs(doc_id, text, lang) with a lang, from about `per_language` texts of each (a hash of doc_id chooses).

    The sample bounds what is read closely; the driver gets counts for at most BUCKETS trigrams a language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.ones((len(SCRIPTS), 0), dtype=bool))
    share = F.element_at(F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n)))), F.col("lang"))
    known = known.where(F.pmod(F.xxhash64("doc_id"), 1_000_003) < share * 1_000_003)

    def count(batches):
        import pyarrow as pa

        grams, scripts = {}, {}
        for batch in batches:
            for text, lang in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if words := text.lower().split():
                    g, _, letters, s = word_features(words)
                    if lang not in grams:
                        grams[lang], scripts[lang] = np.zeros(BUCKETS + 1), np.zeros(len(SCRIPTS))
                    grams[lang] += np.bincount(g, minlength=BUCKETS + 1)
                    scripts[lang] += np.bincount(s, weights=letters, minlength=len(SCRIPTS))
        for lang in grams:
            both = np.r_[grams[lang][:BUCKETS], scripts[lang]].astype(np.int64)
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], names=["lang", "feature", "n"])

    found = in_arrow(known.select("text", "lang"), count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS + 1, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    column = found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    feature, n = found["feature"].to_numpy(), found["n"].to_numpy()
    low = feature < BUCKETS
    np.add.at(grams, (feature[low], column[low]), n[low])
    np.add.at(scripts, (feature[~low] - BUCKETS, column[~low]), n[~low])
    logs = np.log((grams[:BUCKETS] + smoothing) / (grams[:BUCKETS].sum(axis=0) + smoothing * BUCKETS))
    weights = np.vstack([logs - logs.mean(axis=1, keepdims=True), np.zeros(len(languages))])
    return Model(languages, weights, scripts >= NARROW * np.maximum(scripts.sum(axis=0), 1.0))


_taggers: dict[str, Tagger] = {}


def tagger(model: Model) -> Tagger:
    """A worker's tagger for a model, kept between tasks."""
    key = hashlib.sha256(model.weights.tobytes() + repr(model.languages).encode()).hexdigest()
    if key not in _taggers:
        _taggers.clear()
        _taggers[key] = Tagger(model)
    hold(_taggers[key].forget)
    return _taggers[key]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: list[Tagger] = []

    def one(key, text):
        if not state:
            state.append(tagger(shared.value))
        yield key, *state[0].predict(text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, ["doc_id", "text"], one, f"doc_id {kind}, lang_pred string, score double")
