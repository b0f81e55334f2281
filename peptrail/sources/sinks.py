"""Sinks for results and index tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig
from peptrail.functions.mass import mass_digits
from peptrail.operators import packing as P
from peptrail.operators.translate import FRAME, hmst, in_bytes, passed_over, tasks


def csv_rows(alignments: DataFrame, precision: int = 10000, flanks: bool = True) -> DataFrame:
    """The result columns as the CSV has them, named by its header."""
    names = [("Query", "query"), ("AA N-term", "aa_n_term"), ("Peptide", "peptide"), ("AA C-term", "aa_c_term"), ("Mass", "mass"), ("Assembly", "assembly"), ("Intron length", "intron_length"), ("Splice site", "splice_site")]
    if not flanks:
        names = [n for n in names if not n[1].startswith("aa_")]
    mass = F.format_string(f"%.{mass_digits(precision)}f", F.col("mass"))
    return alignments.select(*((mass if c == "mass" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for n, c in names))


def csv_lines(alignments: DataFrame, precision: int = 10000, flanks: bool = True) -> tuple[str, DataFrame]:
    """The header, and rows as CSV lines(value): the assembly is always quoted, other columns hold neither commas nor quotes."""
    rows = csv_rows(alignments, precision, flanks)
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.col("Assembly"), '"', '""'), F.lit('"'))
    return ",".join(rows.columns), rows.select(F.concat_ws(",", *(quoted if c == "Assembly" else F.col(f"`{c}`") for c in rows.columns)).alias("value"))


def write_csv(alignments: DataFrame, path: str, precision: int = 10000, flanks: bool = True) -> None:
    """CSV files, each with a header."""
    header, rows = csv_lines(alignments, precision, flanks)
    # the header's "line" is put before a part's first row; parts without rows have none
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    first = F.col("n") == F.shiftleft(F.col("part").cast("long"), 33)
    rows.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode("error").text(path)


def distinct_peptides(alignments: DataFrame) -> DataFrame:
    """Each peptide once, in the order of its first row of ordered alignments."""
    placed = alignments.select("peptide", F.monotonically_increasing_id().alias("at"))  # grows from partition to partition, and these follow the order
    return placed.groupBy("peptide").agg(F.min("at").alias("at")).orderBy("at").select("peptide")


def write_peptides(alignments: DataFrame, path: str) -> None:
    distinct_peptides(alignments).write.mode("error").text(path)


#: Bytes of a row group of index tables: what a search reads at least of a file.
GROUP = 8 << 20


def tag_bucket(buckets: int) -> Column:
    """The bucket that holds a tag's postings."""
    return F.pmod(F.crc32(F.col("tag").cast("binary")), F.lit(buckets)).cast("int")


#: Nucleotides to a part of the postings, which one task sorts and stores (about two million).
NT_PER_PART = 400_000
#: Bucket files that a task may have open; their rows come in order, and Spark need not sort them by folder first.
OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def write_index(frames: DataFrame, path: str, buckets: int, nucleotides: int, cfg: IndexConfig) -> None:
    """The postings of frames with their sums in a folder for each bucket of tags, sorted by tag, direction and mass over a bucket's files: lookups pass over folders, and row groups then prune by tag and half mass.

    A row holds the postings of a list, or a stretch of a long one (packing.LISTS). Tasks take ranges of that order, so a tag of
    any frequency is the work of as many tasks as its postings ask for. Tags of more letters than a number holds are dealt row by row.
    """
    dealt = frames.repartition(tasks(frames), *FRAME, "block")
    parts = nucleotides // NT_PER_PART + 1
    if cfg.tag_size > P.LETTERS:
        order = ["bucket", "tag", "is_right", "half_mass"]
        rows = hmst(dealt, cfg).withColumn("bucket", tag_bucket(buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
        rows = rows.mapInArrow(P.lists_of_rows, P.LISTS + ", bucket int")
    else:
        some = dealt.where(F.pmod(F.xxhash64(*FRAME, "block"), F.lit(P.BLOCKS)) == 0).mapInArrow(P.sampled(cfg, buckets), "key long, mass long").toPandas() if parts > 1 else None
        marks = P.marks_of(*(some[c].to_numpy(dtype="int64") if parts > 1 else np.zeros(0, dtype=np.int64) for c in ("key", "mass")), parts)
        runs = dealt.mapInArrow(P.runs(cfg, buckets, marks), "part int, n int, data binary")
        rows = in_bytes(runs.repartitionById(parts, "part")).mapInArrow(P.lists_of(cfg), P.LISTS + ", bucket int")
    write_lists(rows, path, -(-buckets // parts))


def write_slice(scaffolds: DataFrame, linked: DataFrame | None, path: str, buckets: int, nucleotides: int, cfg: IndexConfig, marks, slice: int, slices: int) -> None:
    """One slice of the postings that write_index() writes: those of whole scaffolds, made in a pass over them, and of frames with their sums (linked)."""
    parts = len(marks[0]) + 1
    runs = passed_over(scaffolds, P.runs(cfg, buckets, marks, P.whole_tags(cfg, buckets, slice, slices)), "part int, n int, data binary")
    if linked is not None:
        runs = runs.unionByName(linked.mapInArrow(P.runs(cfg, buckets, marks, P.sliced(cfg, buckets, slice, slices)), "part int, n int, data binary"))
    rows = in_bytes(runs.repartitionById(parts, "part")).mapInArrow(P.lists_of(cfg), P.LISTS + ", bucket int")
    write_lists(rows, path, -(-buckets // (parts * slices)))


def marks_of_slice(scaffolds: DataFrame, buckets: int, nucleotides: int, cfg: IndexConfig, slice: int, slices: int):
    """Marks of a slice's parts, from a sample of the scaffolds."""
    parts = nucleotides // slices // NT_PER_PART + 1
    if parts == 1:
        return P.marks_of(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1)
    whole = P.whole_tags(cfg, buckets, slice, slices)
    some = passed_over(scaffolds, lambda batches: P.sampled(cfg, buckets, whole)(b.slice(0, -(-b.num_rows // P.BLOCKS)) for b in batches), "key long, mass long").toPandas()
    return P.marks_of(*(some[c].to_numpy(dtype="int64") for c in ("key", "mass")), parts)


def write_lists(rows: DataFrame, path: str, open_files: int) -> None:
    """Lists of postings in folders of buckets; a task has about so many of these."""
    spark = rows.sparkSession
    before = spark.conf.get(OPEN, None)
    spark.conf.set(OPEN, str(max(16, 4 * open_files)))
    try:
        rows.write.partitionBy("bucket").option("parquet.block.size", GROUP).option("compression", "zstd").mode("error").parquet(path)
    finally:
        spark.conf.unset(OPEN) if before is None else spark.conf.set(OPEN, before)


def write_directory(counts: DataFrame, path: str, buckets: int) -> None:
    """tag, is_right, n and offset of each list of postings, in the postings' folders."""
    rows = counts.withColumn("bucket", tag_bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "tag", "is_right")
    rows.write.partitionBy("bucket").mode("error").parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks of scaffolds or frames by ranges of scaffold and block: row groups then prune by both."""
    blocks.repartitionByRange("scaffold_id", "block").sortWithinPartitions("scaffold_id", "block").write.option("parquet.block.size", GROUP).mode("error").parquet(path)
