"""Query peptides, their tags, and the lookup of anchors in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.functions.mass import delta, peptide_mass
from peptrail.functions.sequence import il_normalize, is_peptide
from peptrail.operators.bands import band_join
from peptrail.operators.translate import FRAME


def windows(queries: DataFrame, icfg: IndexConfig, scfg: SearchConfig) -> DataFrame:
    """Adds the precursor mass (computed where none is given) and its inclusive window lo..hi; null for invalid peptides."""
    mass = F.coalesce(F.col("precursor_mass"), peptide_mass("peptide", icfg.mass_precision))
    rows = queries.select("query_id", "peptide", mass.alias("query_mass"))
    off = delta("query_mass", scfg.mass_accuracy)
    return rows.withColumns({"lo": F.col("query_mass") - off, "hi": F.col("query_mass") + off})


def query_hmst(queries: DataFrame, icfg: IndexConfig = IndexConfig(), scfg: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, tag, is_right, half_mass of every tag of queries(query_id, peptide); only the outermost two for exact search."""
    k = icfg.tag_size
    last = F.length("peptide") - k if scfg.similarity_search else F.lit(0)
    places = F.explode(F.when(F.length("peptide") >= k, F.sequence(F.lit(0), last)))
    rows = queries.select("query_id", "peptide").distinct().select("query_id", "peptide", places.alias("i"))
    n = F.length("peptide")
    side = lambda right, tag_at, rest: F.struct(F.substring("peptide", tag_at + 1, F.lit(k)).alias("tag"), F.lit(right).alias("is_right"), rest.alias("rest"))
    left = side(False, F.col("i"), F.substring("peptide", F.lit(1), F.col("i")))
    right = side(True, n - k - F.col("i"), F.substring("peptide", n - F.col("i") + 1, F.col("i")))
    both = rows.select("query_id", F.explode(F.array(left, right)).alias("h"))
    half = F.when(F.col("h.rest") == "", F.lit(0).cast("long")).otherwise(peptide_mass("h.rest", icfg.mass_precision) - icfg.water)
    out = both.where(is_peptide("h.tag")).select("query_id", il_normalize("h.tag").alias("tag"), F.col("h.is_right").alias("is_right"), half.alias("half_mass"))
    return out.where(F.col("half_mass") <= icfg.max_mass)


def tag_lookup(tags: DataFrame, postings: DataFrame, scfg: SearchConfig = SearchConfig(), icfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Postings with a query's tag and direction whose half mass lies in the query's window.

    A bin of half mass, as wide as the widest window, is part of the key: a tag that is frequent in the genome and in the
    queries meets only what is near in mass.
    """
    off = delta("q_mass", scfg.mass_accuracy)
    width = max(1 << 14, 2 * int(scfg.mass_accuracy * icfg.max_mass / 1e6) + 1)
    q = tags.select("query_id", "tag", "is_right", F.col("half_mass").alias("q_mass"))
    found = band_join(q, postings, ["tag", "is_right"], F.col("q_mass") - off, F.col("q_mass") + off, F.col("half_mass"), width)
    return found.drop("q_mass")


def anchors(hits: DataFrame) -> DataFrame:
    """One row per query, anchor and direction, with the smallest half mass and its number of residues."""
    keys = ["query_id", *FRAME, "anchor_idx", "is_right"]
    least = F.min(F.struct("half_mass", "steps"))
    return hits.groupBy(*keys).agg(least.alias("m"), F.first("anchor_cum").alias("anchor_cum"), F.first("anchor_bad").alias("anchor_bad")).select(*keys, "m.half_mass", "m.steps", "anchor_cum", "anchor_bad")
