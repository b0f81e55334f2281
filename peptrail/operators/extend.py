"""Contiguous alignments: anchors extended by mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.functions.sequence import il_normalize
from peptrail.functions.text import assembly, outer_start
from peptrail.operators.bands import band_join
from peptrail.operators.translate import FRAME, block_of

#: Bin of running mass: a fraction of the lightest residue, so that a bin holds one residue of a frame at most.
MASS_BIN = 1 << 18


def prefix_rows(rows: DataFrame) -> DataFrame:
    """What extension needs of residues: place, running sums before and behind it."""
    spoiled = F.col("bad") + (~F.col("valid")).cast("long")
    return rows.select(*FRAME, "idx", "cum_mass", (F.col("cum_mass") + F.col("mass")).alias("cum_end"), "bad", spoiled.alias("spoiled"))


def immediate_hits(found: DataFrame, windows: DataFrame, prefixes: DataFrame, icfg: IndexConfig) -> DataFrame:
    """query_id, FRAME, first_idx, last_idx and hit_mass of all stretches from an anchor whose mass lies in the window.

    A stretch holds the anchor's half mass and a whole tag behind it, and only valid residues.
    """
    k, water = icfg.tag_size, icfg.water
    rows = found.join(windows.select("query_id", "lo", "hi"), "query_id").where("lo is not null")
    rows = rows.withColumnsRenamed({"anchor_idx": "at", "anchor_cum": "at_cum", "anchor_bad": "at_bad"}).drop("half_mass")
    left = band_join(rows.where("not is_right"), prefixes, FRAME, F.col("at_cum") + F.col("lo") - water, F.col("at_cum") + F.col("hi") - water, F.col("cum_end"), MASS_BIN)
    left = left.where((F.col("spoiled") == F.col("at_bad")) & (F.col("idx") - F.col("at") + 1 >= F.col("steps") + k))
    left = left.select("query_id", *FRAME, F.col("at").alias("first_idx"), F.col("idx").alias("last_idx"), (F.col("cum_end") - F.col("at_cum") + water).alias("hit_mass"))
    right = band_join(rows.where("is_right"), prefixes, FRAME, F.col("at_cum") + water - F.col("hi"), F.col("at_cum") + water - F.col("lo"), F.col("cum_mass"), MASS_BIN)
    right = right.where((F.col("bad") == F.col("at_bad")) & (F.col("at") - F.col("idx") + 1 >= F.col("steps") + k))
    right = right.select("query_id", *FRAME, F.col("idx").alias("first_idx"), F.col("at").alias("last_idx"), (F.col("at_cum") - F.col("cum_mass") + water).alias("hit_mass"))
    return left.unionByName(right).distinct()


def read_residues(wanted: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """wanted(keys, part, FRAME, length, lo, hi) with `text`: residues lo to hi of a frame, as far as it goes; a row for each key and part.

    frames: frame_blocks. A stretch meets the blocks that hold its ends and those between, and takes only its share of each.
    """
    first, last = (block_of(F.col("strand"), F.col("length"), F.least(F.greatest(F.col("frame") + 3 * F.col(c), F.lit(0)), F.col("length") - 1)) for c in ("lo", "hi"))
    rows = wanted.where("lo <= hi").withColumn("block", F.explode(F.sequence(F.least(first, last), F.greatest(first, last))))
    rows = rows.join(frames.select(*FRAME, "block", "first_idx", F.col("text").alias("residues")), [*FRAME, "block"])
    start = F.greatest(F.col("lo"), F.col("first_idx"))
    piece = F.substring("residues", (start - F.col("first_idx") + 1).cast("int"), F.greatest(F.col("hi") - start + 1, F.lit(0)).cast("int"))
    rows = rows.select(*keys, "part", F.struct("first_idx", piece.alias("piece")).alias("p"))
    return rows.groupBy(*keys, "part").agg(F.array_join(F.array_sort(F.collect_list("p"))["piece"], "").alias("text"))


def with_texts(rows: DataFrame, frames: DataFrame, keys: list[str], **parts: tuple) -> DataFrame:
    """Adds a column for each of parts, name=(frame, lo, hi): the residues lo to hi of a frame of the row's strand; empty where there are none.

    keys tell the rows apart. Only stretches of residues are joined back, never blocks.
    """
    named = F.array(*(F.struct(F.lit(name).alias("part"), frame.cast("int").alias("frame"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for name, (frame, lo, hi) in parts.items()))
    wanted = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], "scaffold_id", "strand", "length", F.explode(named).alias("w"))
    wanted = wanted.select(*[f"__{k}" for k in keys], "scaffold_id", "strand", "length", "w.*").withColumn("lo", F.greatest("lo", F.lit(0)))
    found = read_residues(wanted, frames, [f"__{k}" for k in keys])
    wide = found.groupBy(*[f"__{k}" for k in keys]).agg(*(F.max(F.when(F.col("part") == name, F.col("text"))).alias(name) for name in parts))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    out = rows.join(wide, same, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumns({name: F.coalesce(name, F.lit("")) for name in parts})


def common_residues(found: DataFrame, queries: DataFrame, scaffolds: DataFrame, frames: DataFrame) -> DataFrame:
    """anchors() with the query's residues (I as L) as `wanted`, and how many residues from the anchor on are those of the query's end, as `same`."""
    keys = ["query_id", *FRAME, "anchor_idx", "is_right"]
    rows = found.join(scaffolds.select("scaffold_id", "length"), "scaffold_id").join(queries.select("query_id", il_normalize("peptide").alias("wanted")), "query_id")
    n, at = F.length("wanted"), F.col("anchor_idx")
    rows = with_texts(rows, frames, keys, residues=(F.col("frame"), F.when(F.col("is_right"), at - n + 1).otherwise(at), F.when(F.col("is_right"), at).otherwise(at + n - 1)))
    inward = lambda c: F.when(F.col("is_right"), F.reverse(c)).otherwise(c)
    mine, theirs = inward(F.col("wanted")), inward(il_normalize("residues"))
    most = F.least(F.length("wanted"), F.length("residues"))
    same = F.size(F.filter(F.sequence(F.lit(0), most), lambda i: F.left(mine, i) == F.left(theirs, i))) - 1
    return rows.withColumn("same", same.cast("long")).drop("length", "residues")


def immediate_alignments(hits: DataFrame, scaffolds: DataFrame, frames: DataFrame, index_id: str, flank: int = 5) -> DataFrame:
    """Peptide, flanks and assembly of immediate_hits(); flanks end at the scaffold's bounds."""
    rows = hits.join(scaffolds.select("scaffold_id", "label", "length"), "scaffold_id")
    first, last, frame = F.col("first_idx"), F.col("last_idx"), F.col("frame")
    rows = with_texts(rows, frames, ["query_id", *FRAME, "first_idx", "last_idx"], aa_n_term=(frame, first - flank, first - 1), peptide=(frame, first, last), aa_c_term=(frame, last + 1, last + flank))
    n = last - first + 1
    start = (frame + 3 * first).cast("long")
    exon = outer_start(F.col("strand"), start, F.col("length")), (3 * n).cast("long")
    return rows.select(
        "query_id", *FRAME, start.alias("exon_start"), "hit_mass", "aa_n_term", "peptide", "aa_c_term",
        assembly(index_id, F.col("label"), F.col("strand"), exon).alias("assembly"), F.lit(None).cast("long").alias("intron_length"), F.lit(None).cast("string").alias("splice_site"),
    )


def accept(alignments: DataFrame, queries: DataFrame, scfg: SearchConfig) -> DataFrame:
    """Distinct alignments of a query; for exact search those that equal its peptide, with I as L unless told apart."""
    rows = alignments.join(queries.select("query_id", F.col("peptide").alias("query")), "query_id")
    if not scfg.similarity_search:
        same = F.col("peptide") == F.col("query") if scfg.distinguish_il else il_normalize("peptide") == il_normalize("query")
        rows = rows.where(same)
    return rows.dropDuplicates(["query_id", "assembly"])
