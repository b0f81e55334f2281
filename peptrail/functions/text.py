"""Display texts: assemblies, sizes, times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(path: str) -> str:
    """A file's base name up to its first dot, without : and ;."""
    return re.sub("[:;]", "", re.split(r"[\\/]", path)[-1].split(".")[0])


def assembly(index_id: str, label: Column, strand: Column, *exons: tuple[Column, Column]) -> Column:
    """{id/label}, strand and start:length of each exon in amino-acid order."""
    parts = [F.concat(start.cast("string"), F.lit(":"), length.cast("string")) for start, length in exons]
    return F.concat(F.lit("{" + index_id + "/"), label, F.lit("}"), strand, F.concat_ws(",", *parts))


def outer_start(strand: Column, start: Column, scaffold_length: Column) -> Column:
    """Strand-local start to scaffold position: on - the highest position, that of the first nucleotide read."""
    return F.when(strand == "+", start).otherwise(scaffold_length - 1 - start)


def bytes_text(n: int) -> str:
    value, units = float(n), ["bytes", "KiB", "MiB", "GiB", "TiB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{n} bytes" if units[0] == "bytes" else f"{value:.2f} {units[0]}"


def time_text(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.0f} ms"
    minutes, rest = divmod(seconds, 60)
    return f"{int(minutes)} min {rest:.1f} s" if minutes else f"{rest:.1f} s"
