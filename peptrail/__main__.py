"""Command line: build an index, search it, check it, list genetic codes, dump frames."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from peptrail.functions import tables
from peptrail.functions.config import IndexConfig, SearchConfig
from peptrail.functions.text import short_id, time_text
from peptrail.operators.dump import genome_dump, html
from peptrail.plans import engine
from peptrail.sources import fasta, sinks
from peptrail.sources.scratch import Scratch

log = logging.getLogger("peptrail")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peptrail", description=__doc__)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--genetic-codes", help="a file of genetic codes, in addition to those known")
    sub = p.add_subparsers(dest="command", required=True)
    ix = sub.add_parser("index", help="index a FASTA file")
    ix.add_argument("genome")
    ix.add_argument("index")
    ix.add_argument("--byte-ranges", type=int, metavar="MB", help="read the file in ranges of so many MB, for sequence on long lines")
    ix.add_argument("--title", default="")
    ix.add_argument("--tag-size", type=int, default=5)
    ix.add_argument("--enzyme", default="RK|")
    ix.add_argument("--mass-precision", type=int, default=10000)
    ix.add_argument("--mass-bits", type=int, default=27)
    ix.add_argument("--genetic-code", type=int, default=1)
    q = sub.add_parser("search", help="search peptides: pep [mass] pep [mass] ...")
    q.add_argument("index")
    q.add_argument("peptides", nargs="*")
    q.add_argument("--peptides-file", action="append", default=[])
    q.add_argument("--mass-accuracy", type=float, default=10.0)
    for name, default in (("similarity-search", "yes"), ("distinguish-il", "no"), ("search-immediate", "yes")):
        q.add_argument(f"--{name}", choices=("yes", "no"), default=default)
    q.add_argument("--search-intron-split", choices=("yes", "no", "conditional"), default="conditional")
    q.add_argument("--max-intron-length", type=int, default=2100)
    q.add_argument("--splice-sites", default="GT|AG,GC|AG")
    q.add_argument("--flanking-residues", type=int, default=5)
    q.add_argument("--csv-output")
    q.add_argument("--peptides-output")
    c = sub.add_parser("check", help="check that a stored index is sorted and whole")
    c.add_argument("index")
    k = sub.add_parser("codes", help="list the genetic codes, or the codons of one as CSV")
    k.add_argument("--codons", type=int, metavar="CODE")
    d = sub.add_parser("dump", help="print both strands and all frames of a FASTA file under a ruler")
    d.add_argument("--html", action="store_true")
    d.add_argument("genome")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if args.quiet else logging.INFO, format="%(message)s")
    if args.genetic_codes:
        tables.load_genetic_codes(args.genetic_codes)
    if args.command == "codes":
        if args.codons is not None:
            for codon, aa in tables.codon_table(args.codons).items():
                print(f"{codon.replace('T', 'U')};{aa.replace('*', '$')}")
            return 0
        for code, (title, _) in sorted(tables.GENETIC_CODES.items()):
            print(f"{code}\t{title}")
        return 0
    spark, began = SparkSession.builder.appName("peptrail").getOrCreate(), time.time()
    if args.command == "index":
        cfg = IndexConfig(args.tag_size, args.enzyme, args.mass_precision, args.mass_bits, args.genetic_code, args.title or short_id(args.genome))
        engine.build_index(fasta.read_blocks(spark, args.genome, ranges=args.byte_ranges and args.byte_ranges << 20), args.index, cfg, short_id(args.index))
    elif args.command == "check":
        index = engine.open_index(spark, args.index)
        bad, wrong = engine.verify_index(index).count(), engine.verify_directory(index).count()
        print("index is sorted" if not bad else f"{bad} lists of tags are not sorted")
        print("directory is right" if not wrong else f"{wrong} lists of tags differ from the directory in number")
        return int(bad + wrong > 0)
    elif args.command == "dump":
        dump = genome_dump(fasta.read_blocks(spark, args.genome))
        for line in html(dump) if args.html else (r["text"] for r in dump.toLocalIterator()):
            print(line)
        return 0
    else:
        search(spark, args)
    log.info("took %s", time_text(time.time() - began))
    return 0


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    index = engine.open_index(spark, args.index)
    precision = index.config.mass_precision
    cfg = SearchConfig(args.mass_accuracy, args.similarity_search == "yes", args.distinguish_il == "yes", args.search_immediate == "yes", args.search_intron_split, args.max_intron_length, args.splice_sites, args.flanking_residues)
    parts = [fasta.read_peptides(spark, path, precision).drop("line_no") for path in args.peptides_file]
    if args.peptides:
        parts.append(fasta.inline_peptides(spark, args.peptides, precision))
    if not parts:
        raise SystemExit("no peptides")
    queries = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        queries = queries.unionByName(p.withColumn("part", F.lit(i)))
    queries = queries.select((F.col("part").cast("long") * 2**40 + F.col("query_id")).alias("query_id"), "peptide", "precursor_mass")
    scratch = Scratch(spark, "search")
    try:
        found = engine.ordered(engine.search(index, queries, cfg, scratch, placed=True))
        if args.csv_output:
            sinks.write_csv(found, args.csv_output, precision, cfg.flanking_residues > 0)
        else:
            header, rows = sinks.csv_lines(found, precision, cfg.flanking_residues > 0)
            print(header)
            for r in rows.toLocalIterator():
                print(r["value"])
        if args.peptides_output:
            sinks.write_peptides(found, args.peptides_output)
    finally:
        scratch.close()


if __name__ == "__main__":
    raise SystemExit(main())
