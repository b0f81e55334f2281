"""Alignments split by one intron."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.functions.mass import min_residue_mass, residue_mass
from peptrail.functions.sequence import il_normalize, orf, overlapping, translate_codon
from peptrail.functions.text import assembly, outer_start
from peptrail.operators import blockwise as B
from peptrail.operators import translate
from peptrail.operators.bands import band_join
from peptrail.operators.extend import MASS_BIN, with_texts
from peptrail.operators.translate import FRAME, nt_blocks, strand_blocks

STRAND = ["scaffold_id", "strand"]


#: Nucleotides beside a motif that exact search looks at: the rest of a split codon and two codons.
BESIDE = 8


def motif_sites(scaffolds: DataFrame, motifs: list[str], beside: int = 2, tag_size: int = IndexConfig.tag_size) -> DataFrame:
    """scaffold_id, strand, pos, motif, and the `beside` nucleotides before and behind; one pass over the blocks for each motif length."""
    both, out = strand_blocks(nt_blocks(scaffolds, IndexConfig(tag_size=tag_size))), []
    for size in sorted({len(m) for m in motifs}):
        ahead = F.lpad(F.right("ahead", F.lit(beside)), beside, "N")
        behind = F.concat(F.left("behind", F.lit(size - 1 + beside)), F.lit("N" * beside))
        text = F.left(F.concat(ahead, F.col("seq"), behind), F.length("seq") + size - 1 + 2 * beside)  # a motif begins in its block and ends in the scaffold
        rows = both.select(*STRAND, "at", F.posexplode(overlapping(text, size + 2 * beside)).alias("pos", "w")).where(F.substring("w", beside + 1, size).isin(*[m for m in motifs if len(m) == size]))
        out.append(rows.select(*STRAND, (F.col("at") + F.col("pos")).cast("long").alias("pos"), F.substring("w", beside + 1, size).alias("motif"), F.substring("w", 1, beside).alias("ahead"), F.substring("w", beside + size + 1, beside).alias("behind")))
    return reduce(DataFrame.unionByName, out)


def donors_and_acceptors(scaffolds: DataFrame, scfg: SearchConfig, tag_size: int = IndexConfig.tag_size) -> tuple[DataFrame, DataFrame]:
    """Donor and acceptor sites as separate tables with their own column names: the two nucleotides before a donor and behind an acceptor
    (d_ahead, a_behind), and, for exact search, BESIDE of them (d_wide, a_wide)."""
    sites = motif_sites(scaffolds, sorted({m for pair in scfg.sites for m in pair}), 2 if scfg.similarity_search else BESIDE, tag_size)
    wide = [] if scfg.similarity_search else [F.col("ahead").alias("d_wide")], [] if scfg.similarity_search else [F.col("behind").alias("a_wide")]
    sites = sites.withColumns({"two": F.right("ahead", F.lit(2)), "next_two": F.left("behind", F.lit(2))})
    donors = sites.where(F.col("motif").isin(*{d for d, _ in scfg.sites})).select(*STRAND, F.col("pos").alias("d_pos"), F.col("motif").alias("d_motif"), F.col("two").alias("d_ahead"), F.col("next_two").alias("d_behind"), *wide[0])
    acceptors = sites.where(F.col("motif").isin(*{a for _, a in scfg.sites})).select(*STRAND, F.col("pos").alias("a_pos"), F.col("motif").alias("a_motif"), F.col("two").alias("a_ahead"), F.col("next_two").alias("a_behind"), *wide[1])
    return donors, acceptors


def listed(scfg: SearchConfig) -> Column:
    return reduce(lambda x, y: x | y, [(F.col("d_motif") == d) & (F.col("a_motif") == a) for d, a in scfg.sites])


def intron_candidates(scaffolds: DataFrame, scfg: SearchConfig = SearchConfig()) -> DataFrame:
    """scaffold_id, strand, donor and acceptor positions and intron length of all listed pairs within the length limit (clean codons)."""
    donors, acceptors = donors_and_acceptors(scaffolds, scfg)
    pairs = band_join(donors, acceptors, STRAND, F.col("d_pos"), F.col("d_pos") + scfg.max_intron_length - 1, F.col("a_pos"), scfg.max_intron_length)
    pairs = pairs.where(listed(scfg))
    return pairs.select(*STRAND, "d_pos", "a_pos", "d_motif", "a_motif", (F.col("a_pos") + F.length("a_motif") - F.col("d_pos")).alias("intron_length"))


def reachable(scaffolds: DataFrame, most: int = SearchConfig.max_intron_length) -> DataFrame:
    """intron_candidates() of the default motifs by donor: scaffold_id, strand, d_pos, d_motif, n, length_sum, first_acceptor, last_acceptor.

    A block keeps as many nucleotides of the next as an intron may reach, so pairs are counted where the donor lies and
    no site is shuffled. Blocks are no shorter than that.
    """
    if most > translate.NT:
        raise ValueError("introns must not be longer than a block")
    wide = IndexConfig(tag_size=-(-(most + 2) // 3))
    return translate.by_strand(scaffolds, B.donor_rows(translate.NT, most), "d_pos long, d_motif string", "n long, length_sum long, first_acceptor long, last_acceptor long", wide)


def exon_ends(found: DataFrame, windows: DataFrame, prefixes: DataFrame, icfg: IndexConfig) -> DataFrame:
    """Stretches from an anchor after which an intron may come: the tag is complete and at least one residue is still missing.

    query_id, FRAME, is_right, first_idx, last_idx, exon_mass, edge (the nucleotide bound facing the intron), lo, hi, split (0 to 2).
    Where found has `same` and `wanted` (exact search), a stretch goes no further than the query's own residues do; wanted is kept.
    """
    exact = ["wanted"] if "same" in found.columns else []
    k, light = icfg.tag_size, min_residue_mass(icfg.mass_precision)
    rows = found.join(windows.select("query_id", "lo", "hi"), "query_id").where("lo is not null")
    most = F.floor((F.col("hi") - icfg.water) / light) - 1
    if exact:
        most = F.least(most, F.col("same"), F.length("wanted") - 1)
    rows = rows.where(most >= F.col("steps") + k).withColumn("n", F.explode(F.sequence((F.col("steps") + k).cast("long"), most.cast("long"))))
    far = F.when(F.col("is_right"), F.col("anchor_idx") - F.col("n") + 1).otherwise(F.col("anchor_idx") + F.col("n") - 1)
    rows = rows.withColumn("idx", far).where("idx >= 0").join(prefixes, [*FRAME, "idx"])
    clean = F.when(F.col("is_right"), F.col("bad") == F.col("anchor_bad")).otherwise(F.col("spoiled") == F.col("anchor_bad"))
    mass = F.when(F.col("is_right"), F.col("anchor_cum") - F.col("cum_mass")).otherwise(F.col("cum_end") - F.col("anchor_cum"))
    rows = rows.where(clean).withColumn("exon_mass", mass).where(F.col("exon_mass") + icfg.water + light <= F.col("hi"))
    edge = F.col("frame") + 3 * (F.col("idx") + F.when(F.col("is_right"), 0).otherwise(1))
    return rows.select("query_id", *FRAME, "is_right", F.least("idx", "anchor_idx").alias("first_idx"), F.greatest("idx", "anchor_idx").alias("last_idx"), "exon_mass", edge.alias("edge"), "lo", "hi", *exact, F.explode(F.array(*map(F.lit, range(3)))).alias("split"))


def with_introns(ends: DataFrame, donors: DataFrame, acceptors: DataFrame, scfg: SearchConfig, code: int = 1) -> DataFrame:
    """exon_ends() joined with each listed pair of motifs: intron (start, end) bounds and the codon that it splits.

    In exact search only those where the split codon and the two residues beyond it are the query's.
    """
    exact = "wanted" in ends.columns
    reach = scfg.max_intron_length - F.col("split") - 1
    s = F.col("split")
    left = ends.where("not is_right").withColumn("d_pos", F.col("edge") + s).join(donors, [*STRAND, "d_pos"])
    left = band_join(left, acceptors, STRAND, F.col("d_pos"), F.col("d_pos") + reach, F.col("a_pos"), scfg.max_intron_length)
    left = left.withColumn("codon", F.concat(F.substring("d_ahead", 3 - s, s), F.substring("a_behind", F.lit(1), 3 - s)))
    starts = reduce(DataFrame.unionByName, [ends.where("is_right").withColumn("a_pos", F.col("edge") - s - n).withColumn("size", F.lit(n)) for n in sorted({len(a) for _, a in scfg.sites})])
    right = starts.join(acceptors, [*STRAND, "a_pos"]).where(F.length("a_motif") == F.col("size")).drop("size")
    stop = F.col("d_pos") + F.length("d_motif")
    right = band_join(right, donors, STRAND, F.col("edge") - s - reach, F.col("edge") - s, stop, scfg.max_intron_length)
    right = right.withColumn("codon", F.concat(F.substring("d_ahead", s, 3 - s), F.substring("a_behind", F.lit(1), s)))
    if exact:
        n, mid, rest = F.col("last_idx") - F.col("first_idx") + 1, (s > 0).cast("int"), ((3 - s) % 3).cast("int")
        residue = il_normalize(translate_codon("codon", code))
        size = F.length("wanted")
        beyond = F.substring("wanted", (n + mid + 1).cast("int"), F.lit(2))
        seen = il_normalize(orf(F.substring("a_wide", rest + 1, F.lit(6)), 0, code))
        left = left.where(((s == 0) | (residue == F.substring("wanted", (n + 1).cast("int"), F.lit(1)))) & (F.left(seen, F.length(beyond)) == beyond)).drop("a_wide", "d_wide", "wanted")
        beyond = F.right(F.left("wanted", (size - n - mid).cast("int")), F.lit(2))
        seen = il_normalize(orf(F.substring("d_wide", F.lit(BESIDE - 6 + 1) - rest, F.lit(6)), 0, code))
        right = right.where(((s == 0) | (residue == F.substring("wanted", (size - n).cast("int"), F.lit(1)))) & (F.right(seen, F.length(beyond)) == beyond)).drop("a_wide", "d_wide", "wanted")
    both = left.unionByName(right).where(listed(scfg))
    return both.withColumns({"codon": F.when(s > 0, F.col("codon")), "gap_start": F.col("d_pos"), "gap_end": F.col("a_pos") + F.length("a_motif")})


def split_hits(pairs: DataFrame, prefixes: DataFrame, icfg: IndexConfig) -> DataFrame:
    """Second exons by mass: adds split_aa, frame2, first2, last2 (null if the second exon is a split codon only) and hit_mass."""
    rest = (3 - F.col("split")) % 3
    rows = pairs.withColumn("split_aa", F.when(F.col("split") > 0, translate_codon("codon", icfg.genetic_code)))
    gained = F.when(F.col("split") > 0, residue_mass("split_aa", icfg.mass_precision)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("gained", gained).where("gained is not null").withColumn("so_far", F.col("exon_mass") + F.col("gained") + icfg.water)
    none = F.lit(None).cast("long")
    alone = rows.where((F.col("split") > 0) & F.col("so_far").between(F.col("lo"), F.col("hi"))).select("*", F.col("frame").cast("int").alias("frame2"), none.alias("first2"), none.alias("last2"), F.col("so_far").alias("hit_mass"))
    begin = F.when(F.col("is_right"), F.col("gap_start") - rest).otherwise(F.col("gap_end") + rest)
    rows = rows.where("so_far < hi").withColumn("begin", begin).where("begin >= 0")
    rows = rows.withColumns({"frame2": (F.col("begin") % 3).cast("int"), "idx2": F.floor(F.col("begin") / 3) - F.when(F.col("is_right"), 1).otherwise(0)})
    p = prefixes.withColumnsRenamed({"frame": "frame2"})
    near = p.select(*STRAND, "frame2", F.col("idx").alias("idx2"), F.col("cum_mass").alias("cum2"), F.col("cum_end").alias("cum_end2"), F.col("bad").alias("bad2"), F.col("spoiled").alias("spoiled2"))
    rows = rows.where("idx2 >= 0").join(near, [*STRAND, "frame2", "idx2"])
    need_lo, need_hi = F.greatest(F.col("lo") - F.col("so_far"), F.lit(1)), F.col("hi") - F.col("so_far")
    left = band_join(rows.where("not is_right"), p, [*STRAND, "frame2"], F.col("cum2") + need_lo, F.col("cum2") + need_hi, F.col("cum_end"), MASS_BIN)
    left = left.where("spoiled = bad2 and idx >= idx2").select("*", F.col("idx2").alias("first2"), F.col("idx").alias("last2"), (F.col("so_far") + F.col("cum_end") - F.col("cum2")).alias("hit_mass"))
    right = band_join(rows.where("is_right"), p, [*STRAND, "frame2"], F.col("cum_end2") - need_hi, F.col("cum_end2") - need_lo, F.col("cum_mass"), MASS_BIN)
    right = right.where("bad = spoiled2 and idx <= idx2").select("*", F.col("idx").alias("first2"), F.col("idx2").alias("last2"), (F.col("so_far") + F.col("cum_end2") - F.col("cum_mass")).alias("hit_mass"))
    keep = alone.columns
    return alone.unionByName(left.select(*keep)).unionByName(right.select(*keep))


def split_alignments(hits: DataFrame, scaffolds: DataFrame, frames: DataFrame, index_id: str, flank: int = 5) -> DataFrame:
    """Peptide, flanks, assembly, intron length and splice site of split_hits(); one row for each query and assembly. Rows need a number of their own, `hit`."""
    rows = hits.join(scaffolds.select("scaffold_id", "label", "length"), "scaffold_id")
    n1 = F.col("last_idx") - F.col("first_idx") + 1
    n2 = F.coalesce(F.col("last2") - F.col("first2") + 1, F.lit(0))
    right, s, rest = F.col("is_right"), F.col("split"), (3 - F.col("split")) % 3
    size1, size2 = F.when(right, 3 * n2 + rest).otherwise(3 * n1 + s), F.when(right, 3 * n1 + s).otherwise(3 * n2 + rest)
    start1, start2 = F.col("gap_start") - size1, F.col("gap_end")
    rows = rows.withColumns({"size1": size1.cast("long"), "size2": size2.cast("long"), "start1": start1.cast("long"), "start2": start2.cast("long")})
    rows = rows.withColumn("order", F.row_number().over(Window.partitionBy("query_id", *STRAND, "start1", "size1", "start2", "size2").orderBy(F.length("d_motif").desc(), F.length("a_motif").desc(), "d_motif", "a_motif", "is_right"))).where("order = 1")
    # flanks are read in the frames of the peptide's two ends
    stop = F.col("start2") + F.col("size2")
    i1, i2 = F.floor(F.col("start1") / 3), F.floor(stop / 3)
    rows = with_texts(
        rows, frames, ["hit"], anchor=(F.col("frame"), F.col("first_idx"), F.col("last_idx")), other=(F.col("frame2"), F.col("first2"), F.col("last2")),
        aa_n_term=(F.col("start1") % 3, i1 - flank, i1 - 1), aa_c_term=(stop % 3, i2, i2 + flank - 1),
    )
    middle = F.coalesce(F.col("split_aa"), F.lit(""))
    peptide = F.when(right, F.concat("other", middle, "anchor")).otherwise(F.concat("anchor", middle, "other"))
    exons = [(outer_start(F.col("strand"), F.col(f"start{i}"), F.col("length")), F.col(f"size{i}")) for i in (1, 2)]
    return rows.select(
        "query_id", *FRAME, F.col("start1").alias("exon_start"), "hit_mass", "aa_n_term", peptide.alias("peptide"), "aa_c_term",
        assembly(index_id, F.col("label"), F.col("strand"), *exons).alias("assembly"), (F.col("start2") - F.col("gap_start")).cast("long").alias("intron_length"), F.concat_ws("|", "d_motif", "a_motif").alias("splice_site"),
    )
