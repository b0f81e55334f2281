"""Single operators on small inputs."""

import random
import re
import subprocess
import sys
from itertools import product
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from peptrail.functions import mass, sequence, tables, text
from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.operators import dump, introns, translate
from peptrail.operators.bands import band_join, scaffold_lookup
from peptrail.operators.translate import residues, spans
from peptrail.plans import engine
from peptrail.sources import fasta, sinks
from peptrail.sources.scratch import shared_folder
from peptrail.streaming.search import search_stream


def scaffolds(spark, *seqs):
    rows = [(i, f"s{i}", len(s), s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "scaffold_id long, label string, length long, seq string")


@given(st.text("ACGTN", max_size=12))
@settings(max_examples=200, deadline=None)
def test_codon_tables(seq):
    table = tables.codon_table(1)
    for codon in (seq[i : i + 3] for i in range(0, len(seq) - 2, 3)):
        if "N" not in codon:
            assert table[codon] in tables.GENETIC_CODES[1][1]
    assert {c for c, a in table.items() if "N" in c and a != "X"} == {"ACN", "CCN", "CGN", "CTN", "GCN", "GGN", "GTN", "TCN"}


def test_scalars(spark):
    df = spark.createDataFrame([("acguNRYT",), ("",), ("GATTACA",)], "s string")
    got = df.select(sequence.nt_normalize("s").alias("n"), sequence.revcomp(sequence.nt_normalize("s")).alias("r"), sequence.revcomp(sequence.revcomp(sequence.nt_normalize("s"))).alias("b")).collect()
    assert [r["n"] for r in got] == ["ACGNNNNT", "", "GATTACA"] and got[2]["r"] == "TGTAATC" and all(r["b"] == r["n"] for r in got)
    tags = spark.createDataFrame([("PEPTI",), ("GGGGG",), ("WWWWW",), ("PE*TI",), ("",)], "t string").select("t", sequence.tag_code("t").alias("c"))
    rows = {r["t"]: r["c"] for r in tags.collect()}
    assert rows["GGGGG"] == 0 and rows["WWWWW"] == 19**5 - 1 and rows["PE*TI"] == rows[""] == -1
    assert {r["t"]: r["d"] for r in tags.where("c >= 0").select("t", sequence.tag_decode("c", 5).alias("d")).collect()}["PEPTI"] == "PEPTL"


def test_masses(spark):
    df = spark.createDataFrame([("QAQHRFS",), ("AXA",), ("",)], "p string")
    assert [r[0] for r in df.select(mass.peptide_mass("p")).collect()] == [8724250, None, None]
    assert mass.min_residue_mass() == 570214 and mass.mass_digits(10000) == 4 and mass.mass_digits(500) == 3
    row = spark.range(1).select(mass.delta(F.lit(8724250), 10.0), mass.mass_format(F.lit(8724250)), mass.precursor_mass(F.lit(872.42509))).first()
    assert tuple(row) == (87, "872.4250", 8724250)


def test_config():
    for bad in ({"tag_size": 0}, {"enzyme": "RK"}, {"enzyme": "R|K|"}, {"enzyme": "R1|"}, {"genetic_code": 99}, {"mass_bits": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    for bad in ({"splice_sites": "GT"}, {"splice_sites": "GT|AGX"}, {"splice_sites": "GTACGTACGTA|AG"}, {"search_intron_split": "maybe"}, {"mass_accuracy": -1}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert IndexConfig(enzyme="rk|").cut_after == "RK"


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text("\n>one a\nacgt\n\nNNu\n>two\n>three\r\nAC\r\nGT\r\n")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(path)).orderBy("scaffold_id").select("scaffold_id", "label", "length", "start", "seq").collect()]
    assert got == [(0, "one a", 7, 0, "ACGTNNN"), (1, "two", 0, 7, ""), (2, "three", 4, 7, "ACGT")]
    bad = tmp_path / "y.fasta"
    bad.write_text("ACGT\n>one\nAC\n")
    with pytest.raises(PySparkException, match="before the first"):
        fasta.read_fasta(spark, str(bad)).collect()


def test_peptides(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("pepTIDE\n\nAAA, 12.5\nBBB;0\n")
    got = [tuple(r) for r in fasta.read_peptides(spark, str(path)).orderBy("line_no").collect()]
    assert got == [(1, "PEPTIDE", None, 1), (3, "AAA", 125000, 3), (4, "BBB", None, 4)]
    path.write_text("AAA x1\n")
    with pytest.raises(PySparkException, match="line 1"):
        fasta.read_peptides(spark, str(path)).collect()
    assert [tuple(r) for r in fasta.inline_peptides(spark, ["AAA", "2.5", "CCC"]).collect()] == [(1, "AAA", 25000), (2, "CCC", None)]


def test_enzymes_and_stops(spark):
    # frame 0: M D K * * D A R G (ATG GAT AAA TAA TAG GAT GCT CGT GGT)
    seq = "ATGGATAAATAATAGGATGCTCGTGGT"
    for enzyme, want in (("RK|", [(0, 2), (5, 7), (8, 8)]), ("|D", [(0, 0), (1, 2), (5, 8)]), ("K|D", [(0, 0), (1, 2), (5, 8)])):
        rows = spans(residues(scaffolds(spark, seq), IndexConfig(enzyme=enzyme))).where("strand = '+' and frame = 0").collect()
        assert sorted((r["first_idx"], r["last_idx"]) for r in rows) == want
    assert residues(scaffolds(spark, "", "A", "ACG", "ACGTAC")).groupBy("scaffold_id").count().count() == 2


def test_two_level_sums(spark, monkeypatch):
    rng = random.Random(3)
    genome = scaffolds(spark, "".join(rng.choice("ACGTN") for _ in range(500)))
    rows = lambda: sorted(map(tuple, residues(genome).drop("label", "inner").collect()), key=str)
    want = rows()
    for size in (15, 21, 60):
        monkeypatch.setattr(translate, "NT", size)
        assert rows() == want


def test_fasta_blocks(spark, tmp_path):
    """Several files, splits and block sizes; records without sequence, of one long line, and lines of any length."""
    rng, want = random.Random(4), []
    for name in ("a", "b", "c"):
        text = ""
        for i in range(rng.choice([1, 4, 9])):
            seq = "".join(rng.choice("ACGTNacgtu-") for _ in range(rng.choice([0, 1, 50, 700])))
            want.append((f"{name}{i} x", re.sub("[^ACGT]", "N", seq.upper())))
            width = rng.choice([7, 60, 1000])
            text += f">{name}{i} x\n" + "".join(seq[j : j + width] + rng.choice(["\n", "\r\n", "\n\n", " \n"]) for j in range(0, len(seq), width))
        (tmp_path / f"{name}.fasta").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = fasta.read_fasta(spark, str(tmp_path)).orderBy("scaffold_id").collect()
        assert [(r["label"], r["seq"]) for r in whole] == want and [r["scaffold_id"] for r in whole] == list(range(len(want)))
        assert all(r["length"] == len(r["seq"]) and r["start"] == sum(len(s) for _, s in want[: r["scaffold_id"]]) for r in whole)
        for size in (16, 64):
            rows = fasta.read_blocks(spark, str(tmp_path), size).orderBy("scaffold_id", "block").collect()
            got = {}
            for r in rows:
                assert r["block"] == len(got.setdefault(r["scaffold_id"], [])) and len(r["seq"]) <= size
                got[r["scaffold_id"]].append(r["seq"])
            assert ["".join(got[i]) for i in range(len(want))] == [s for _, s in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_from_fasta_are_those_of_whole_scaffolds(spark, monkeypatch):
    monkeypatch.setattr(translate, "NT", 45)
    genome = scaffolds(spark, "".join(random.Random(2).choice("ACGT") for _ in range(200)), "", "ACG", "A" * 45)
    whole = translate.nt_blocks(genome)
    apart = translate.nt_blocks(whole.drop("ahead", "behind"))
    key = lambda df: sorted(map(tuple, df.select("scaffold_id", "block", "seq", "ahead", "behind", "length").collect()))
    assert key(whole) == key(apart) and len(key(whole)) == 8


def test_band_join(spark):
    rng = random.Random(1)
    a = [(i, rng.randint(-50, 50), rng.randint(0, 30)) for i in range(60)]
    b = [(i, rng.randint(-60, 90)) for i in range(80)]
    left = spark.createDataFrame(a, "i long, x long, w long").withColumn("k", F.col("i") % 2)
    right = spark.createDataFrame(b, "j long, y long").withColumn("k", F.col("j") % 2)
    got = {(r["i"], r["j"]) for r in band_join(left, right, ["k"], F.col("x"), F.col("x") + F.col("w"), F.col("y"), 16).collect()}
    assert got == {(i, j) for i, x, w in a for j, y in b if i % 2 == j % 2 and x <= y <= x + w}
    offsets = fasta.scaffold_offsets(scaffolds(spark, "A" * 10, "", "C" * 5))
    found = scaffold_lookup(spark.createDataFrame([(0,), (9,), (10,), (14,), (15,)], "gno long"), offsets, 4)
    assert sorted((r["gno"], r["scaffold_id"], r["local_pos"]) for r in found.collect()) == [(0, 0, 0), (9, 0, 9), (10, 2, 0), (14, 2, 4)]


def test_intron_limits(spark):
    cfg = SearchConfig(max_intron_length=6)
    got = introns.intron_candidates(scaffolds(spark, "GTAAAAGAAG"), cfg).where("strand = '+'").collect()
    assert [(r["d_pos"], r["a_pos"], r["intron_length"]) for r in got] == [(0, 5, 7)]
    uneven = SearchConfig(splice_sites="GTA|AG,GT|CAG")
    pairs = introns.intron_candidates(scaffolds(spark, "GTACCCAG"), uneven).where("strand = '+'").collect()
    assert sorted((r["d_motif"], r["a_motif"], r["intron_length"]) for r in pairs) == [("GT", "CAG", 8), ("GTA", "AG", 8)]


def test_sinks_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([("Q", "N", "PEP", "C", 12.5, "{a/b}+0:9", None, None)], "query string, aa_n_term string, peptide string, aa_c_term string, mass double, assembly string, intron_length long, splice_site string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    lines = max((p.read_text() for p in (tmp_path / "csv").glob("part*")), key=len).splitlines()
    assert lines[0].startswith("Query,AA N-term,Peptide") and lines[1] == 'Q,N,PEP,C,12.5000,"{a/b}+0:9",,'
    sinks.write_peptides(rows.union(rows), str(tmp_path / "pep"))
    assert "".join(p.read_text() for p in (tmp_path / "pep").glob("part*")) == "PEP\n"
    assert text.short_id("/x/y:z.gz.idx") == "yz" and text.bytes_text(2048) == "2.00 KiB" and text.time_text(75) == "1 min 15.0 s"


def test_stream(spark, tmp_path):
    index = engine.make_index(scaffolds(spark, "ATGAAACCGGAACCGACCATTGATGAACGTGGTGGT"))
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "PEPTIDER", None)], "query_id long, peptide string, precursor_mass long").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("query_id long, peptide string, precursor_mass long").parquet(str(tmp_path / "in" / "a"))
    q = search_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), SearchConfig(similarity_search=False, search_intron_split="no"))
    q.awaitTermination()
    assert [r["peptide"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["PEPTIDER"]
    assert not list(Path(shared_folder(spark).removeprefix("file://")).glob("stream-*"))  # a batch's tables go with it


def test_genetic_code_file(spark, tmp_path):
    bases = ["".join(c) for c in zip(*("".join(x) for x in product("TCAG", repeat=3)))]
    block = lambda i, aas: f"# a comment\n{i}. Code {i} (transl_table={i})\n\nAAs = {aas}\nStarts={'-' * 64}\n" + "".join(f"Base{j + 1}  = {b}\n" for j, b in enumerate(bases))
    aas = tables.GENETIC_CODES[1][1]
    (tmp_path / "codes").write_text(block(1, aas) + "\n" + block(77, "G" * 60 + aas[60:]))
    tables.load_genetic_codes(str(tmp_path / "codes"))
    assert tables.GENETIC_CODES[77] == ("Code 77", "G" * 60 + aas[60:]) and tables.codon_table(77)["TTT"] == "G" and tables.codon_table(1)["TTT"] == "F"
    for bad in (block(1, aas[:-1]), block(1, aas) + block(1, aas), block(1, aas).replace("Base3", "Base4"), "x"):
        with pytest.raises(ValueError, match="genetic code"):
            tables.parse_genetic_codes(bad)
    index = engine.build_index(scaffolds(spark, "TTTTTTTTTAAATTTTTT"), str(tmp_path / "ix"), IndexConfig(genetic_code=77, tag_size=2))
    del tables.GENETIC_CODES[77]
    assert engine.open_index(spark, str(tmp_path / "ix")).config == index.config and tables.GENETIC_CODES.pop(77)[0] == "Code 77"


def test_genome_dump(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(translate, "NT", 33)
    monkeypatch.setattr(dump, "NT", 33)
    genome, table = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (100, 12, 0, 2)], tables.codon_table()
    got = dump.genome_dump(scaffolds(spark, *genome), width=12).collect()
    assert [(r["scaffold_id"], r["offset"]) for r in got] == [(i, at) for i, seq in enumerate(genome) for at in range(0, len(seq), 12)]
    for r in got:
        seq, at = genome[r["scaffold_id"]], r["offset"]
        lines = r["text"].split("\n")
        part = seq[at : at + 12]
        turned = part.translate(str.maketrans("ACGT", "TGCA"))
        assert lines[:3] == [f"{at:<9}.{at + 10:<9}.", part, turned]
        for row in range(3):
            places = [p for p in range(at, min(at + 12, len(seq) - 2)) if p % 3 == row]
            for line, letter in ((lines[3 + row], lambda c: table[c]), (lines[6 + row], lambda c: table[c[::-1].translate(str.maketrans("ACGT", "TGCA"))])):
                assert line == "".join(letter(seq[p : p + 3]) if p in places else " " for p in range(at, at + 12)).rstrip()
    page = "\n".join(dump.html(dump.genome_dump(scaffolds(spark, "ACGT"))))
    assert "<h1>s0</h1>" in page and page.endswith("</html>")


def test_command_line():
    out = subprocess.run([sys.executable, "-m", "peptrail", "codes"], capture_output=True, text=True, check=True).stdout
    assert out.startswith("1\tThe Standard Code") and "Vertebrate" in out


def test_entry(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).columns == ["query", "aa_n_term", "peptide", "aa_c_term", "mass", "assembly"]
