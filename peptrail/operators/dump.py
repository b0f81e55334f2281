"""A genome as text: under a ruler both strands and all frames, for reading by eye."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.config import IndexConfig
from peptrail.functions.sequence import complement, overlapping, revcomp, translate_codon
from peptrail.operators.translate import NT, nt_blocks

WIDTH = 120


def genome_dump(scaffolds: DataFrame, cfg: IndexConfig = IndexConfig(), width: int = WIDTH) -> DataFrame:
    """scaffold_id, label, offset, text: sections of `width` nucleotides in order. scaffolds as nt_blocks() takes them.

    A section has a ruler (every tenth place), the plus strand, its complement, the three forward frames and the three
    reverse ones. A residue stands below the first nucleotide of its codon, in the row of that place modulo 3.
    """
    blocks = nt_blocks(scaffolds, cfg)
    # sections that begin in a block; those at its end take what they lack from the block behind it
    first = F.ceil(F.col("block") * NT / width) * width
    last = F.least((F.col("block") + 1) * NT, F.col("length")) - 1
    rows = blocks.where("length > 0").withColumn("offset", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(width).cast("long")))))
    nearby = blocks.select("scaffold_id", (F.col("block") - 1).alias("block"), F.left("seq", F.lit(width + 2)).alias("more"))
    rows = rows.join(nearby, ["scaffold_id", "block"], "left")
    text = F.concat("seq", F.coalesce("more", F.lit("")))
    at = (F.col("offset") - F.col("block") * NT + 1).cast("int")
    rows = rows.select("scaffold_id", "label", "offset", F.substring(text, at, F.lit(width)).alias("plus"), F.substring(text, at, F.lit(width + 2)).alias("wide"))
    codons = overlapping(F.col("wide"), 3)
    letters = {"forward": F.transform(codons, lambda c: translate_codon(c, cfg.genetic_code)), "reverse": F.transform(codons, lambda c: translate_codon(revcomp(c), cfg.genetic_code))}
    rows = rows.withColumns({name: F.array_join(column, "") for name, column in letters.items()})

    def frame(letters: str, row: int):
        """The letters whose places are `row` modulo 3, blanks elsewhere."""
        own = lambda c, i: F.when(F.pmod(F.col("offset") + i, F.lit(3)) == row, c).otherwise(F.lit(" "))
        return F.rtrim(F.array_join(F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), own), ""))

    marks = F.transform(F.sequence(F.col("offset"), F.col("offset") + (width - 1), F.lit(10).cast("long")), lambda n: F.concat(F.rpad(n.cast("string"), 9, " "), F.lit(".")))
    lines = [F.array_join(marks, ""), F.col("plus"), complement("plus"), *(frame(name, row) for name in letters for row in range(3))]
    return rows.select("scaffold_id", "label", "offset", F.concat_ws("\n", *lines).alias("text")).orderBy("scaffold_id", "offset")


def html(dump: DataFrame) -> Iterator[str]:
    """The dump as an HTML page, a heading for each scaffold; sections come to the driver one by one."""
    yield "<!DOCTYPE html>\n<html>\n<body>"
    here = None
    for r in dump.toLocalIterator():
        if r["scaffold_id"] != here:
            if here is not None:
                yield "</pre>"
            here = r["scaffold_id"]
            yield f"<h1>{escape(r['label'])}</h1>\n<pre>"
        yield escape(r["text"]) + "\n"
    if here is not None:
        yield "</pre>"
    yield "</body>\n</html>"
