"""Quality rules with risk-controlled thresholds.

Each text has base statistics and signals, all "more is worse". A cutoff of a signal is chosen per
stratum (a band of text length, a fixed list) from labelled documents: half of them, by a hash of
doc_id, propose the cutoff on a fixed grid that rejects most bad documents net of good ones; the
other half certify it. A cutoff holds only if the exact (Clopper-Pearson) upper bound on the share
of good documents it rejects stays within risk / number of signals, at a confidence that is
Bonferroni-corrected over all strata and signals. Cutoffs that fail step back to laxer proposals
in a fixed sequence, each tested at its own share of the error. So the union of all rules rejects
more than `risk` of a stratum's good documents with probability under `delta`.

Defined cases: null or wordless text has zero statistics and fails the base rules; a stratum or
signal without enough labels gets no cutoff and rejects nothing; labels may be empty or null. A doc_id
is one trial however often its label or its document is repeated; it is none where its labels contradict
each other, or its texts differ in what is measured. Repeated documents repeat their row; further columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import Scratch, arrow_map, small_enough

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
SIGNALS = ("symbols", "repeats", "dup_lines", "capitals", "marks")
BANDS = (0, 50, 150, 500, 1500)
GRID = tuple(round(0.01 * 1.15**i, 6) for i in range(40))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur more than once; exact, by doubling ranks."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    span = 1
    while span < width:
        _, ids = np.unique(ids[:-span] * (len(words) + 1) + ids[span:], return_inverse=True)
        span *= 2
    if span != width:
        raise ValueError("width must be a power of two")
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + width, -1)
    return int((np.cumsum(mark) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals, exclamation marks."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), capitals, raw.count(b"!")


def statistics(docs: DataFrame) -> DataFrame:
    def one(key, text):
        yield key, *measure(text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_marks".split()
    out = arrow_map(docs, ["doc_id", "text"], one, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    per = lambda top, below: F.col(top) / F.greatest(F.col(below), F.lit(1))
    signals = (per("n_symbols", "n_words"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("n_capitals", "word_chars"), per("n_marks", "n_words"))
    band = F.lit(0)
    for i, low in enumerate(BANDS[1:], 1):
        band = F.when(F.col("n_words") >= low, i).otherwise(band)
    return out.select("*", *(s.alias(n) for n, s in zip(SIGNALS, signals)), band.alias("stratum"))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's way)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + even * d or tiny), 1 + even / c or tiny
        out *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + odd * d or tiny), 1 + odd / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            return front * out
        m += 1


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound (Clopper and Pearson) on a binomial share: the largest p with P(X <= k) >= delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if beta_share(1 - p, n - k, k + 1) >= delta else (low, p)
    return high


def certify(counts: dict[tuple[int, str, int, int], list[int]], risk: float, delta: float, steps: int = 5) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, signal) from counts[stratum, signal, half, quality][level]: documents whose value reaches GRID[level - 1] but not GRID[level]."""
    share, trust, out = risk / len(SIGNALS), delta / (len(SIGNALS) * len(BANDS) * steps), {}
    zero = [0] * (len(GRID) + 1)
    for stratum in range(len(BANDS)):
        for signal in SIGNALS:
            above = {(h, q): np.cumsum(counts.get((stratum, signal, h, q), zero)[::-1])[::-1] for h in (0, 1) for q in (0, 1)}
            gain = [int(above[0, 0][i + 1]) - 2 * int(above[0, 1][i + 1]) for i in range(len(GRID))]
            best = max(range(len(GRID)), key=lambda i: (gain[i], i))
            if gain[best] <= 0:
                continue
            good = int(above[1, 1][0])
            for i in range(best, min(best + steps, len(GRID))):
                if good and upper_bound(int(above[1, 1][i + 1]), good, trust) <= share:
                    out[stratum, signal] = GRID[i]
                    break
    return out


def trials(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, stratum and the levels of all signals: one row for each labelled document."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("__most")).where("quality = __most").drop("__most")
    known = F.broadcast(known) if small_enough(known, 200_000) else known
    level = lambda s: sum((F.when(F.col(s) >= g, 1).otherwise(0) for g in GRID), F.lit(0))
    rows = measured.select("doc_id", F.struct("stratum", *(level(s).alias(s) for s in SIGNALS)).alias("m")).join(known, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("m").alias("m"), F.max("m").alias("__most")).where("m = __most").select("doc_id", "quality", "m.*")


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.1, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """Certified cutoffs from all labelled documents; only counts (strata x signals x halves x levels) reach the driver."""
    half = (F.xxhash64("doc_id") % 2 != 0).cast("int").alias("half")
    rows = trials(measured, labels).select("stratum", "quality", half, F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("level")) for s in SIGNALS))).alias("s"))
    counts: dict = {}
    for r in rows.groupBy("stratum", "quality", "half", "s.signal", "s.level").count().collect():
        counts.setdefault((r["stratum"], r["signal"], r["half"], r["quality"]), [0] * (len(GRID) + 1))[r["level"]] += r["count"]
    return certify(counts, risk, delta)


def filter_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.1, delta: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, base statistics, base_failed, kept."""
    measured = Scratch(docs.sparkSession, "quality").keep(statistics(docs), "measured")
    rejected = F.lit(False)
    for (stratum, signal), cutoff in sorted(thresholds(measured, labels, risk, delta).items()):
        rejected = rejected | ((F.col("stratum") == stratum) & (F.col(signal) >= cutoff))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
