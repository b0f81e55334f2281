"""The stored index: what a lookup reads, its directory, spans of any length, counts, orders, and FASTA by byte ranges."""

import io
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.functions.tables import GENETIC_CODES, codon_string, fixed_masses
from peptrail.operators import translate
from peptrail.operators.translate import all_blocks, hmst
from peptrail.plans import engine
from peptrail.sources import fasta, ranges, sinks
from peptrail.sources.fasta import inline_peptides, numbered_lines
from peptrail.sources.scratch import Scratch

EXACT = SearchConfig(similarity_search=False, search_intron_split="no")


def scaffolds(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", len(t), t) for i, t in enumerate(texts)], "scaffold_id long, label string, length long, seq string")


def random_genome(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    return engine.build_index(scaffolds(spark, *random_genome(5, 6, 20_000)), path, buckets=256)


def tag_queries(spark, index, n):
    """n peptides that are tags of the index themselves."""
    rows = index.directory.select("tag").distinct().orderBy(F.xxhash64("tag")).limit(n).collect()
    return spark.createDataFrame([(i, r["tag"], None) for i, r in enumerate(rows)], "query_id long, peptide string, precursor_mass long")


def scans(plan):
    """The file scans of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        return [plan]
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return scans(plan.executedPlan() if kind.startswith("Adaptive") else plan.plan())
    children = plan.children()
    return [s for i in range(children.size()) for s in scans(children.apply(i))]


def scanned(hits):
    """Files and bytes of postings that a lookup reads, as Spark counts them."""
    hits.collect()
    found = [s for s in scans(hits._jdf.queryExecution().executedPlan()) if "/postings" in s.relation().location().rootPaths().toString()]
    return tuple(sum(s.metrics().apply(name).value() for s in found) for name in ("numFiles", "filesSize"))


def test_bytes_read_grow_with_the_tags(spark, stored):
    """Lookups of 1, 49 and 5000 tags open no bucket without one of their tags; answers are those of a join with all postings."""
    read = {}
    for n in (1, 49, 5000):
        queries = tag_queries(spark, stored, n)
        hits = engine.find_hits(stored, queries, EXACT)
        tags = queries.select(F.col("peptide").alias("tag")).distinct()
        wanted = {r[0] for r in tags.select(sinks.tag_bucket(stored.buckets)).distinct().collect()}
        files = [f.removeprefix("file://") for f in stored.postings.inputFiles()]
        most = [os.path.getsize(f) for f in files if int(f.split("bucket=")[1].split("/")[0]) in wanted]
        read[n] = scanned(hits)
        assert 0 < read[n][0] <= len(most) and read[n][1] <= sum(most)
        assert hits.count() == stored.postings.join(tags, "tag", "left_semi").where("half_mass = 0").count() > (0 if n > 1 else -1)
    total = sum(map(os.path.getsize, files))
    assert read[1][1] <= total / 100 and read[1][1] < read[49][1] <= total / 4 and read[49][1] < read[5000][1] <= total


def test_postings_are_never_shuffled(spark, stored, monkeypatch):
    """Beyond the limit query tags go in several parts; no part reads another's buckets, and none shuffles postings."""
    queries = tag_queries(spark, stored, 400)
    want = sorted(map(str, engine.find_hits(stored, queries, EXACT).collect()))
    monkeypatch.setattr(engine, "SMALL", 90)
    hits = engine.find_hits(stored, queries, EXACT)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") > 3 and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert scanned(hits)[0] == scanned(engine.bucket_postings(stored, [r[0] for r in queries.select(F.col("peptide").alias("tag")).select(sinks.tag_bucket(stored.buckets)).distinct().collect()]))[0]
    assert sorted(map(str, hits.collect())) == want
    monkeypatch.setattr(engine, "SMALL", 1)  # most buckets have more tags than that: each is read once for a share
    assert sorted(map(str, engine.find_hits(stored, tag_queries(spark, stored, 12), EXACT).collect())) == sorted(map(str, stored.postings.where("half_mass = 0").join(tag_queries(spark, stored, 12).select("query_id", F.col("peptide").alias("tag")), "tag").select(hits.columns).collect()))


def test_buckets_are_dealt_in_parts():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [(b, rng.choice([1, 2, 5, 30])) for b in rng.sample(range(100), rng.randrange(0, 20))]
        parts = engine.dealt(sizes, 10)
        seen = [(b, share, shares) for buckets, share, shares in parts for b in buckets]
        assert sorted(b for b, share, _ in seen if share == 0) == sorted(b for b, _ in sizes)
        for b, n in sizes:
            mine = [(share, shares) for c, share, shares in seen if c == b]
            assert mine == [(i, -(-n // 10) if n > 10 else 1) for i in range(-(-n // 10) if n > 10 else 1)]
        known = dict(sizes)
        assert all(shares > 1 or sum(known[b] for b in buckets) <= 10 for buckets, _, shares in parts)


def test_directory_and_totals(spark, stored):
    assert engine.verify_directory(stored).count() == engine.verify_index(stored).count() == 0
    counts = {(r["tag"], r["is_right"]): r["n"] for r in translate.histogram(stored.postings).collect()}
    rows = stored.directory.orderBy("tag", "is_right").collect()
    assert {(r["tag"], r["is_right"]): r["n"] for r in rows} == counts
    place = 0
    for r in rows:
        assert r["offset"] == place
        place += r["n"]
    assert stored.totals == {"scaffolds": 6, "nucleotides": 120_000, "longest": 20_000, "postings": place, "largest_list": max(counts.values()), "offset_bits": 18}
    one = stored.postings.where("is_right").limit(1).collect()[0]
    lost = stored.postings.where((F.col("tag") != one["tag"]) | ~F.col("is_right"))
    wrong = engine.verify_directory(replace(stored, postings=lost)).collect()
    assert [tuple(r) for r in wrong] == [(one["tag"], True, counts[one["tag"], True], 0)]


def test_offset_bits():
    assert [engine.offset_bits(n) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [2, 2, 2, 3, 3, 4, 11, 12]
    assert [engine.buckets_for(n) for n in (0, 65_535, 65_536, 131_072, 10**12)] == [1, 1, 2, 4, 65_536]


def test_an_index_keeps_its_genetic_code_to_itself(spark, tmp_path):
    """An index whose code 1 is another one than here is read by its own, and code 1 stays what it is."""
    genome = scaffolds(spark, "ATGGCAGCAGCAGCAGCAAAA")
    title, aas = before = GENETIC_CODES[1]
    try:
        GENETIC_CODES[1] = title, aas.replace("A", "G")
        codon_string.cache_clear()
        engine.build_index(genome, str(tmp_path / "ix"))
    finally:
        GENETIC_CODES[1] = before
        codon_string.cache_clear()
    index = engine.open_index(spark, str(tmp_path / "ix"))
    assert GENETIC_CODES[1] == before and GENETIC_CODES[index.config.genetic_code] == (title, aas.replace("A", "G"))
    assert engine.open_index(spark, str(tmp_path / "ix")).config == index.config
    assert index.postings.where("tag = 'GGGGG'").count() and not engine.make_index(genome).postings.where("tag = 'GGGGG'").count()


def test_empty_genome(spark, tmp_path):
    index = engine.build_index(scaffolds(spark, "", "AC"), str(tmp_path / "ix"))
    assert index.totals["postings"] == 0 and engine.verify_directory(index).count() == 0
    scratch = Scratch(spark, "t")
    assert engine.search(index, inline_peptides(spark, ["PEPTIDE"]), SearchConfig(), scratch).count() == 0
    assert (scratch.rows["listed"], scratch.rows["hits"], scratch.rows["anchors"], scratch.rows["contiguous"]) == (0, 0, 0, 0) and scratch.rows["tags"] > 0


def test_a_span_of_any_length_is_the_work_of_many_tasks(spark, monkeypatch):
    """400,000 nucleotides that code one residue: no cleavage site, one anchor at each end, tags as far as the mass reaches."""
    monkeypatch.setattr(translate, "NT", 3000)
    n = 400_000 // 3
    blocks = all_blocks(scaffolds(spark, "GCA" * n))
    rows = hmst(blocks).where("strand = '+' and frame = 0").collect()
    mass = fixed_masses()["A"]
    steps = IndexConfig().max_mass // mass
    for right, anchor in ((False, 0), (True, n - 1)):
        mine = sorted((r["steps"], r["half_mass"]) for r in rows if r["is_right"] == right)
        assert mine == [(i, i * mass) for i in range(steps + 1)] and {r["anchor_idx"] for r in rows if r["is_right"] == right} == {anchor}
    assert blocks.groupBy("strand", "frame").count().agg(F.min("count")).first()[0] >= n // 1000


def test_blocks_of_any_size_give_the_same_tags(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTACGTN") for _ in range(n)) for n in (0, 3, 14, 16, 500, 1501)] + ["GCAGCATAA" * 40 + "AAATGA" + "GCA" * 50, "NNN" * 60 + "GCA" * 9]
    genome, key = scaffolds(spark, *texts), lambda df: sorted(map(str, df.collect()))
    for cfg in (IndexConfig(), IndexConfig(tag_size=1), IndexConfig(tag_size=3, enzyme="K|AD", mass_bits=22)):
        monkeypatch.setattr(translate, "NT", 24_576)
        want = key(hmst(all_blocks(genome, cfg), cfg))
        assert want == key(by_definition(spark, genome, cfg))
        for size in (24, 33):
            monkeypatch.setattr(translate, "NT", size)
            assert key(hmst(all_blocks(genome, cfg), cfg)) == want


def by_definition(spark, genome, cfg):
    """Tags of residue rows, span by span."""
    rows, k, out = {}, cfg.tag_size, []
    for r in translate.residues(genome, cfg).collect():
        rows.setdefault((r["scaffold_id"], r["strand"], r["frame"]), []).append(r)
    for (scaffold, strand, frame), mine in rows.items():
        mine.sort(key=lambda r: r["idx"])
        text = "".join(r["aa"] for r in mine)
        good = lambda a, b: a >= 0 and b <= len(text) and all(mine[i]["valid"] for i in range(a, b))  # noqa: B023, E731
        spans = {}
        for r in mine:
            if r["aa"] != "*":
                spans.setdefault(r["span_id"], []).append(r["idx"])
        for inside in spans.values():
            a, b = inside[0], inside[-1]
            for i in inside:
                half = mine[i]["cum_mass"] - mine[a]["cum_mass"]
                if good(a, i + k) and half <= cfg.max_mass:
                    out.append((text[i : i + k].replace("I", "L"), False, half, scaffold, strand, frame, a, frame + 3 * a, i - a, mine[a]["cum_mass"], mine[a]["bad"]))
                end = mine[b]["cum_mass"] + mine[b]["mass"]
                half = end - mine[i]["cum_mass"] - mine[i]["mass"]
                if good(i - k + 1, b + 1) and half <= cfg.max_mass:
                    out.append((text[i - k + 1 : i + 1].replace("I", "L"), True, half, scaffold, strand, frame, b, frame + 3 * b + 2, b - i, end, mine[b]["bad"]))
    return spark.createDataFrame(out, hmst(all_blocks(genome, cfg), cfg).schema)


def test_counts_of_a_search(spark, stored):
    queries, scratch = tag_queries(spark, stored, 30).unionByName(inline_peptides(spark, ["WWWWWWWWWW"]).withColumn("query_id", F.lit(99).cast("long"))), Scratch(spark, "t")
    found = engine.search(stored, queries, SearchConfig(similarity_search=False, search_intron_split="yes"), scratch)
    n = scratch.rows
    hits = engine.find_hits(stored, queries, EXACT)
    assert (n["queries"], n["hits"], n["anchors"]) == (31, hits.count(), engine.find_anchors(stored, queries, EXACT).count())
    assert n["tags"] >= n["listed"] and n["contiguous"] == found.where("intron_length is null").count() and n["split"] == found.where("intron_length is not null").count()


def test_exact_search_compares_residues_before_motifs(spark, stored):
    """What exact search pairs is a small part of what a search by mass pairs, and the answers that equal their query are the same."""
    rng, genome = random.Random(4), random_genome(5, 6, 20_000)
    from peptrail.functions.tables import codon_table

    table = codon_table()
    peptides = []
    for text in genome:
        parts = "".join(table[text[i : i + 3]] for i in range(0, len(text) - 2, 3)).replace("*", "K").replace("R", "K").split("K")
        peptides += rng.sample([p for p in parts if 10 <= len(p) <= 20], 4)
    # and peptides that an intron splits
    for text in genome[:3]:
        for at in rng.sample(range(3000, 9000, 3), 300):
            donor, acceptor = text.find("GT", at + 15), text.find("AG", at + 60)
            joined = text[at:donor] + text[acceptor + 2 : acceptor + 60]
            aa = "".join(table[joined[i : i + 3]] for i in range(0, 36, 3))
            before = table[text[at - 3 : at]]
            if before in "KR*" and set(aa) <= set(fixed_masses()) and donor - at < 30:
                peptides.append(aa)
    queries = spark.createDataFrame([(i, p, None) for i, p in enumerate(peptides)], "query_id long, peptide string, precursor_mass long")
    cfg = SearchConfig(similarity_search=False, search_immediate=False, search_intron_split="yes")
    few, many = Scratch(spark, "t"), Scratch(spark, "t")
    got = engine.search(stored, queries, cfg, few).collect()
    outermost = engine.find_anchors(stored, queries, cfg)
    # the same anchors without the query's residues: every pair of motifs within reach
    work = engine.Work.of(stored, queries, cfg, many)
    by_mass = replace(cfg, similarity_search=True)
    work.found = outermost
    want = engine.search_introns(stored, queries, by_mass, many, work).where(F.translate("peptide", "I", "L") == F.translate("query", "I", "L"))
    key = lambda rows: sorted((r["query_id"], r["assembly"], r["peptide"], r["intron_length"], r["splice_site"]) for r in rows)
    assert got and key(got) == key(want.collect())
    assert 50 * few.rows["pairs"] <= many.rows["pairs"]


def test_display_order_and_first_seen_peptides(spark, tmp_path):
    """Contiguous alignments first, then + before -, by scaffold and number, not by text; peptides as they come first."""
    body = "AAATGG" + "GCAGATGAAGCA" + "AAATAA"
    text = "TAA" * 7 + body + "TAA" * 40 + body
    index = engine.build_index(scaffolds(spark, text, text[::-1].translate(str.maketrans("ACGT", "TGCA")), text), str(tmp_path / "ix"), IndexConfig(tag_size=3), index_id="x")
    queries = inline_peptides(spark, ["WADEAK", "ADEA"])
    found = engine.ordered(engine.search(index, queries, SearchConfig(similarity_search=False, search_intron_split="no"), placed=True))
    rows = [(r["query_id"], r["assembly"]) for r in found.collect()]
    place = lambda a: (a[a.index("}") + 1] == "-", int(a[a.index("/s") + 2 : a.index("}")]), int(a[a.index("}") + 2 : a.index(":")]))
    assert len(rows) >= 6 and rows == sorted(rows, key=lambda r: (r[0], place(r[1]))) and rows != sorted(rows)
    peptides, seen = [r["peptide"] for r in found.collect()], []
    for p in peptides:
        if p not in seen:
            seen.append(p)
    sinks.write_peptides(found, str(tmp_path / "peptides"))
    assert [r["peptide"] for r in sinks.distinct_peptides(found).collect()] == seen
    assert [r["value"] for r in spark.read.text(str(tmp_path / "peptides")).collect()] == seen


def test_lines_are_numbered_by_splits(spark, tmp_path):
    lines = [f"PEPTIDE{'A' * (i % 7)}" + ("" if i % 3 else f" {i}.5") for i in range(500)] + ["", "LAST bad"]
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("\n".join(lines[i * 200 : (i + 1) * 200]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        numbered = numbered_lines(spark, str(tmp_path))
        assert {r["line_no"]: r["value"] for r in numbered.collect()} == dict(enumerate(lines, 1))
        assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(Exception, match="invalid mass in line 502"):
            fasta.read_peptides(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fasta_by_byte_ranges(spark, tmp_path):
    """A record on one line is read by many tasks in bounded pieces, and comes out as by lines."""
    rng = random.Random(1)
    path = tmp_path / "genome.fasta"
    path.write_text(">first one\nACGT\n\nacgtn\r\n>empty\n>long\n" + "".join(rng.choices("ACGTacgtRN", k=3_000_000)) + "\n>last\nTTT")
    read = spark.read.format("fasta_ranges")
    spark.dataSource.register(ranges.FastaSource)
    pieces = read.options(size=24_576, bytes=100_000).load(str(path))
    assert pieces.rdd.getNumPartitions() >= 30 and pieces.agg(F.max(F.length("seq"))).first()[0] <= 24_576
    assert pieces.where("label is null and record = 0").select("split").distinct().count() >= 28
    key = lambda df: sorted((r["scaffold_id"], r["label"], r["length"], r["block"], r["seq"]) for r in df.collect())
    assert key(fasta.read_blocks(spark, str(path), ranges=100_000)) == key(fasta.read_blocks(spark, str(path)))
    (tmp_path / "wrong.fasta").write_text("ACGT\n>late\nA\n")
    with pytest.raises(Exception, match="before the first >"):
        fasta.read_blocks(spark, str(tmp_path / "wrong.fasta"), ranges=4)


def test_ranges_of_any_size(monkeypatch):
    rng = random.Random(1)

    def by_lines(text):
        out = []
        for line in text.split("\n"):
            if line.startswith(">"):
                out.append([line[1:].strip(), ""])
            elif line.split():
                out[-1][1] += "".join(c if c in "ACGT" else "N" for c in "".join(line.split()).upper())
        return out

    for _ in range(600):
        text = "".join(">" + rng.choice(["", "a", "lab el", "x>y"]) + rng.choice(["\n", "\r\n"]) + "".join("".join(rng.choice("acgtNACGT ") for _ in range(rng.randrange(40))) + rng.choice(["\n", "\n\n"]) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 5)))
        data = text.encode() if rng.random() < 0.7 else text.encode().rstrip(b"\n")
        step, size = rng.choice([1, 2, 3, 5, 8, 13, 1000]), rng.choice([4, 7, 100])
        monkeypatch.setattr(ranges, "CHUNK", rng.choice([1, 3, 7, 1 << 20]))
        got = []
        for at in range(0, len(data), step):
            for _, _, _, _, label, seq in ranges.pieces_of(io.BytesIO(data), ranges.Range("f", at, min(at + step, len(data))), size):
                assert len(seq) <= size
                if label is not None:
                    got.append([label, seq])
                else:
                    got[-1][1] += seq
        assert got == by_lines(data.decode())
