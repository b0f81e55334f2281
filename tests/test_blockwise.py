"""Sums by block against rows per residue and per place, for scaffolds of one block and of many."""

import random

import pytest
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig
from peptrail.functions.sequence import overlapping
from peptrail.operators import blockwise as B
from peptrail.operators import introns, translate
from peptrail.operators.translate import FRAME


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ACGTN", (8, 8, 8, 8, 1), k=n)) for n in (0, 1, 2, 3, 7, 45, 46, 100, 400, 900)] + ["GTAG" * 30, "TAATAG" * 20]
    return spark.createDataFrame([(i, f"s{i}", len(t), t) for i, t in enumerate(texts)], "scaffold_id long, label string, length long, seq string").cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("nt", [45, 24_576])
def test_sums_by_frame(monkeypatch, genome, nt):
    each = translate.residues(genome).cache()
    monkeypatch.setattr(translate, "NT", nt)
    want = each.groupBy(*FRAME, "span_id").agg(F.count("*").alias("n"), F.min("cum_mass").alias("least"), F.max("cum_mass").alias("most"), F.sum("cum_mass").alias("total"))
    assert rows(translate.by_frame(genome, B.span_masses, "span_id long", "n long, least long, most long, total long")) == rows(want)
    want = each.where("valid").groupBy(*FRAME, F.col("bad").alias("run_id")).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("residues"), F.sum("mass").alias("mass"))
    assert rows(translate.by_frame(genome, B.run_sums, "run_id long", "first_idx long, last_idx long, residues long, mass long")) == rows(want)
    first = each.groupBy(*FRAME, "span_id").agg(F.min("idx").alias("site")).groupBy(*FRAME).agg(F.count("*").alias("n_sites"), F.sum("site").alias("site_sum"), F.max("site").alias("last_site"))
    assert rows(translate.by_frame(genome, B.site_sums, "", "n_sites long, site_sum long, last_site long", sums=False)) == rows(first)
    size = F.col("last_idx") - F.col("first_idx") + 1
    want = translate.spans(each).groupBy(*FRAME).agg(F.count("*").alias("n_spans"), F.sum(size).alias("residues"), F.max(size).alias("longest"))
    assert rows(translate.by_frame(genome, B.span_sizes, "", "n_spans long, residues long, longest long")) == rows(want)
    blocks = translate.all_blocks(genome)
    tags = translate.hmst(blocks).cache()
    assert rows(translate.tag_histogram(blocks)) == rows(translate.histogram(tags))
    want = tags.groupBy(*FRAME, "is_right", "anchor_idx", "anchor_pos").agg(F.count("*").alias("n"), F.min("tag").alias("first_tag"), F.max("tag").alias("last_tag"), F.sum("half_mass").alias("mass_sum"))
    assert rows(translate.by_frame(genome, B.anchor_sums, "is_right boolean, anchor_idx long, anchor_pos long", "n long, first_tag string, last_tag string, mass_sum long")) == rows(want)
    assert rows(translate.distinct_tags(genome)) == rows(each.where("tag is not null").select("tag").distinct())
    each_residue = translate.all_blocks(genome).mapInArrow(B.residue_sums(IndexConfig()), "scaffold_id long, strand string, frame int, idx long, cum_mass long, cum_end long, bad long, spoiled long")
    assert rows(each_residue.select(*FRAME, "idx", "cum_mass", "bad")) == rows(each.select(*FRAME, "idx", "cum_mass", "bad"))


@pytest.mark.parametrize("nt", [45, 24_576])
def test_sums_by_strand(monkeypatch, genome, nt):
    whole = translate.strands(genome).cache()
    monkeypatch.setattr(translate, "NT", nt)
    want = whole.select("scaffold_id", "strand", F.posexplode(overlapping(F.col("seq"), 3)).alias("pos", "codon")).groupBy("scaffold_id", "strand", "codon").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))
    assert rows(translate.by_strand(genome, B.triplet_sums(nt), "codon string", "n long, pos_sum long")) == rows(want)
    sites = introns.motif_sites(genome, ["GT", "GC", "AG"]).cache()
    want = sites.groupBy("scaffold_id", "strand", "motif").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.min(F.concat("ahead", "behind")).alias("least"))
    assert rows(translate.by_strand(genome, B.motif_sums(nt), "motif string", "n long, pos_sum long, least string")) == rows(want)
    valid = translate.residues(genome).where("valid").withColumn("split", F.explode(F.array(*map(F.lit, range(3)))))
    donors = sites.where("motif <> 'AG'").select("scaffold_id", "strand", F.col("pos").alias("d_pos"), "motif")
    near = valid.withColumn("d_pos", F.col("frame") + 3 * F.col("idx") + 3 + F.col("split")).join(donors, ["scaffold_id", "strand", "d_pos"])
    want = near.groupBy(*FRAME, "split", "motif").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"))
    assert rows(translate.by_strand(genome, B.start_sums(nt, IndexConfig()), "frame int, split int, motif string", "n long, idx_sum long")) == rows(want)


def test_one_block_scaffolds_are_not_shuffled_by_span(genome):
    """No exchange by span: only the deal of blocks, and the merge of longer scaffolds."""
    short = genome.where("length < 100")
    plan = translate.by_frame(short, B.span_masses, "span_id long", "n long, least long, most long, total long")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Union") < plan.index("Aggregate")


@pytest.mark.parametrize("nt", [45, 24_576])
def test_a_translated_genome_gives_what_an_index_gives(spark, monkeypatch, tmp_path, genome, nt):
    from peptrail.functions.config import SearchConfig
    from peptrail.plans import engine

    monkeypatch.setattr(translate, "NT", nt)
    index, ready = engine.build_index(genome, str(tmp_path / "index")), engine.translated(genome, str(tmp_path / "ready"))
    first = translate.six_frame(genome).where("length > 300").selectExpr("explode(regexp_extract_all(orf, '([ACDEFGHILMNPQSTVWY]{8,20})', 1)) as peptide").distinct().limit(12)
    queries = first.selectExpr("row_number() over (order by peptide) as query_id", "peptide", "cast(null as long) as precursor_mass")
    cfg = SearchConfig()
    want = rows(engine.find_hits(index, queries, cfg))
    assert want and rows(engine.find_hits(ready, queries, cfg)) == want
    monkeypatch.setattr(engine, "SMALL", 7)  # several passes
    assert rows(engine.find_hits(ready, queries, cfg)) == want


@pytest.mark.parametrize("nt", [45, 24_576])
def test_pairs_by_donor(monkeypatch, genome, nt):
    from peptrail.functions.config import SearchConfig

    pairs = introns.intron_candidates(genome, SearchConfig(max_intron_length=40)).groupBy("scaffold_id", "strand", "d_pos", "d_motif")
    want = rows(pairs.agg(F.count("*").alias("n"), F.sum("intron_length").alias("length_sum"), F.min("a_pos").alias("first_acceptor"), F.max("a_pos").alias("last_acceptor")))
    monkeypatch.setattr(translate, "NT", nt)
    assert rows(introns.reachable(genome, 40)) == want
