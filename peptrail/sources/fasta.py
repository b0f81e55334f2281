"""FASTA and peptide sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.functions.mass import precursor_mass
from peptrail.operators import translate
from peptrail.sources.ranges import FastaSource
from peptrail.sources.scratch import Scratch


def pieces(spark: SparkSession, path: str, size: int) -> DataFrame:
    """file, split, piece, record, label, seq: the files' sequence in pieces of at most `size` nucleotides, upper case, all but A, C, G and T as N.

    A task streams the lines of its splits and holds one piece. piece counts within a split, record the headers met in it
    so far (0: a record that an earlier split began); label is set where a record begins. Blank lines are allowed.
    """

    def cut(batches):
        import pyarrow as pa

        here, out, parts, held, state = None, [], [], 0, [0, 0, None]  # pieces, headers, label

        def flush(to: int) -> None:
            """Emit what is held in pieces of `size`, and a rest if `to` is 0 or a record's first piece is pending."""
            nonlocal parts, held
            text = "".join(parts)
            at = 0
            while len(text) - at >= size or (not to and (len(text) > at or state[2] is not None)):
                out.append((*here, state[0], state[1], state[2], re.sub("[^ACGT]", "N", text[at : at + size])))
                state[0], state[2], at = state[0] + 1, None, at + size
            parts = [text[at:]] if len(text) > at else []
            held = max(len(text) - at, 0)

        def batch():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            found = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=["file", "split", "piece", "record", "label", "seq"])
            out.clear()
            return found

        for rows in batches:
            for line, file, split in zip(*(rows.column(i) for i in range(3))):
                line, key = line.as_py(), (file.as_py(), split.as_py())
                if key != here:
                    if here is not None:
                        flush(0)
                    here, state[:] = key, [0, 0, None]
                if line.startswith(">"):
                    flush(0)
                    state[1:] = state[1] + 1, line[1:].strip()
                    continue
                line = "".join(line.split()).upper()
                if line and not state[1] and here[1] == 0:
                    raise ValueError(f"sequence before the first > in {here[0]}")
                if line:
                    parts.append(line)
                    held += len(line)
                    if held >= size:
                        flush(1)
                if len(out) >= 64:
                    yield batch()
        if here is not None:
            flush(0)
        if out:
            yield batch()

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return lines.mapInArrow(cut, "file string, split long, piece long, record long, label string, seq string")


def placed(found: DataFrame) -> DataFrame:
    """file, split, piece, scaffold_id and at (its place in its scaffold) of pieces(): running sums inside a split, and over the splits' totals.

    No sequence takes part, and only the splits' totals are ordered as a whole.
    """
    zero = F.lit(0).cast("long")
    rows = found.select("file", "split", "piece", "record", F.col("label").isNotNull().cast("long").alias("head"), F.length("seq").cast("long").alias("nt"))
    place, line = Window.partitionBy("file", "split").orderBy("piece"), Window.orderBy("file", "split")
    records = rows.groupBy("file", "split", "record").agg(F.sum("nt").alias("nt"))
    splits = records.groupBy("file", "split").agg(F.max("record").alias("heads"), F.max_by("nt", "record").alias("open"))
    # what a split leaves open goes on in the splits behind it, up to the next with a header
    splits = splits.withColumns({"before": F.coalesce(F.sum("heads").over(line.rowsBetween(Window.unboundedPreceding, -1)), zero), "group": F.sum((F.col("heads") > 0).cast("long")).over(line)})
    so_far = F.sum("open").over(Window.partitionBy("group").orderBy("file", "split"))
    splits = splits.withColumn("so_far", so_far).withColumn("carry", F.coalesce(F.lag("so_far").over(line), zero)).select("file", "split", "before", "carry")
    inside = F.coalesce(F.sum("nt").over(Window.partitionBy("file", "split", "record").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), zero)
    rows = rows.withColumn("inside", inside).join(splits, ["file", "split"])
    at = F.col("inside") + F.when(F.col("record") == 0, F.col("carry")).otherwise(zero)
    return rows.select("file", "split", "piece", (F.col("before") + F.col("record") - 1).alias("scaffold_id"), at.alias("at"), "nt")


def read_blocks(spark: SparkSession, path: str, size: int | None = None, ranges: int | None = None) -> DataFrame:
    """scaffold_id, label, length, block, seq of FASTA files: scaffolds in blocks, as an index is built from; no row holds more than a block.

    Scaffolds are numbered in order of file and place. Files are read by lines, or in byte ranges of so many bytes, for
    lines of any length (see ranges.py).
    """
    size, scratch = size or translate.NT, Scratch(spark, "fasta")
    if ranges:
        spark.dataSource.register(FastaSource)
    found = spark.read.format("fasta_ranges").options(size=size, bytes=ranges).load(path) if ranges else pieces(spark, path, size)
    found = scratch.keep(found, "pieces")
    where = scratch.keep(placed(found), "places")
    rows = found.join(where, ["file", "split", "piece"])
    names = rows.groupBy("scaffold_id").agg(F.max("label").alias("label"), F.sum("nt").alias("length"))
    last = F.col("at") + F.greatest(F.col("nt"), F.lit(1)) - 1
    parts = rows.select("scaffold_id", "at", "seq", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(last / size))).alias("block"))
    start = F.greatest(F.col("block") * size, F.col("at"))
    share = F.substring("seq", (start - F.col("at") + 1).cast("int"), ((F.col("block") + 1) * size - start).cast("int"))
    parts = parts.groupBy("scaffold_id", "block").agg(F.array_sort(F.collect_list(F.struct(start.alias("start"), share.alias("share")))).alias("parts"))
    blocks = parts.select("scaffold_id", "block", F.array_join("parts.share", "").alias("seq"))
    return blocks.join(names, "scaffold_id").select("scaffold_id", "label", "length", "block", "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """scaffold_id, label, length, start and seq: whole scaffolds, put together from read_blocks(). Text before the first > is an error."""
    rows = read_blocks(spark, path).groupBy("scaffold_id", "label", "length").agg(F.array_sort(F.collect_list(F.struct("block", "seq"))).alias("parts"))
    rows = rows.select("scaffold_id", "label", "length", F.array_join("parts.seq", "").alias("seq"))
    return rows.join(scaffold_offsets(rows).select("scaffold_id", "start"), "scaffold_id").select("scaffold_id", "label", "length", "start", "seq")


def running_total(rows: DataFrame, key: str, value: str, out: str, block: int = 65536) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows with a smaller integer `key`; keys are unique.

    Two levels: inside blocks of keys, and over the blocks' totals, so that no task gets all rows.
    """
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("__block", F.floor(F.col(key) / block))
    totals = rows.groupBy("__block").agg(F.sum(value).alias("__total"))
    over = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", F.coalesce(F.sum("__total").over(over), zero).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(value).over(inside), zero))
    return local.join(totals, "__block").withColumn(out, (F.col("__local") + F.col("__before")).cast("long")).drop("__block", "__local", "__before")


def scaffold_offsets(scaffolds: DataFrame) -> DataFrame:
    """scaffold_id, length and global start: a running total over scaffolds."""
    return running_total(scaffolds.select("scaffold_id", "length"), "scaffold_id", "length", "start")


def scaffold_stats(scaffolds: DataFrame) -> DataFrame:
    return scaffolds.agg(F.count("*").alias("n_scaffolds"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_nt"), F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest"))


LETTERS, NUCLEOTIDES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "TTAGGCCGCCGCTTTGCGCGCAGAAN"


def as_dna(batches):
    """Deterministic nucleotide sequences from prose: letters of either case map to A, C, G, T and N, all else goes. Of batches(scaffold_id, label, text)."""
    import numpy as np
    import pyarrow as pa

    table = np.zeros(256, dtype=np.uint8)
    for letters in (LETTERS, LETTERS.lower()):
        table[[ord(c) for c in letters]] = [ord(c) for c in NUCLEOTIDES]
    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        found = table[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] if data is not None and len(text) else table[:0]
        before = np.r_[0, np.cumsum(found != 0)][ends - ends[0]] if len(text) else np.zeros(1, dtype=np.int64)
        seq = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(before.astype(np.int64).tobytes()), pa.py_buffer(found[found != 0].tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("scaffold_id"), batch.column("label"), pa.array(np.diff(before)), seq.cast(pa.string())], names=["scaffold_id", "label", "length", "seq"])


def scaffolds_from_text(table: DataFrame, key: str, label: Column) -> DataFrame:
    """Scaffolds (scaffold_id, label, length, seq) from a table of texts."""
    rows = table.select(F.col(key).alias("scaffold_id"), label.alias("label"), "text")
    out = rows.mapInArrow(as_dna, f"scaffold_id {rows.schema['scaffold_id'].dataType.simpleString()}, label string, length long, seq string")
    out.made_by = rows, as_dna
    return out


def parse_peptides(lines: DataFrame, precision: int = 10000) -> DataFrame:
    """query_id, peptide and precursor_mass (fixed point, null if not given) from lines(value, line_no).

    A line holds a peptide and, after white space, comma or semicolon, an uncharged mass; a bad mass is an error with its line number.
    """
    parts = F.split(F.trim("value"), r"[\s,;]+")
    mass_text = F.nullif(F.try_element_at(parts, F.lit(2)), F.lit(""))
    number = mass_text.try_cast("double")
    checked = F.when(mass_text.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("invalid mass in line "), F.col("line_no").cast("string"))))
    rows = lines.where(F.trim("value") != "").select(F.col("line_no").cast("long").alias("query_id"), F.upper(F.element_at(parts, 1)).alias("peptide"), checked.alias("mass"), F.col("line_no").cast("long").alias("line_no"))
    return rows.select("query_id", "peptide", F.nullif(precursor_mass("mass", precision), F.lit(0).cast("long")).alias("precursor_mass"), "line_no")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no of text files, counted through all of them from 1.

    Each split numbers its own lines; the splits' line counts, a row for each, are added up on the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    before, known = 0, []
    for file, split, n in sorted(tuple(r) for r in lines.groupBy("file", "split").count().collect()):
        known.append((file, split, before))
        before += n
    starts = spark.createDataFrame(known, "file string, split long, before long")
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    return lines.withColumn("inside", inside).join(F.broadcast(starts), ["file", "split"]).select("value", (F.col("before") + F.col("inside")).alias("line_no"))


def read_peptides(spark: SparkSession, path: str, precision: int = 10000) -> DataFrame:
    """Peptides of text files, numbered by line."""
    return parse_peptides(numbered_lines(spark, path), precision)


def inline_peptides(spark: SparkSession, items: list[str], precision: int = 10000) -> DataFrame:
    """Peptides given as `pep [mass] pep [mass] ...`: a number is the mass of the peptide before it."""
    rows: list[list] = []
    for item in items:
        try:
            mass = int(float(item) * precision)
        except ValueError:
            rows.append([len(rows) + 1, item.upper(), None])
        else:
            if not rows:
                raise ValueError("a mass without a peptide")
            rows[-1][2] = mass or None
    return spark.createDataFrame([tuple(r) for r in rows], "query_id long, peptide string, precursor_mass long")
