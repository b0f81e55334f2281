"""Masses in fixed point (long) as Column expressions: truncate each residue, then add."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from peptrail.functions.sequence import col, is_peptide
from peptrail.functions.tables import WATER, fixed_masses, fixed_water


def residue_mass(aa: Column | str, precision: int = 10000) -> Column:
    """A residue's mass; null if it is none."""
    by_mass: dict[int, str] = {}
    for letter, mass in fixed_masses(precision).items():
        by_mass[mass] = by_mass.get(mass, "") + letter
    out = None
    for mass, letters in by_mass.items():
        test = col(aa).isin(*letters)
        out = F.when(test, F.lit(mass).cast("long")) if out is None else out.when(test, F.lit(mass).cast("long"))
    return out


def peptide_mass(peptide: Column | str, precision: int = 10000) -> Column:
    """Water and all residues; null if a letter is no residue. Counts letters, so it never explodes."""
    p = col(peptide)
    total = F.lit(fixed_water(precision)).cast("long")
    for letter, mass in fixed_masses(precision).items():
        total = total + (F.length(p) - F.length(F.translate(p, letter, ""))).cast("long") * mass
    return F.when(is_peptide(p), total)


def min_residue_mass(precision: int = 10000) -> int:
    return min(fixed_masses(precision).values())


def delta(mass: Column | str, ppm: float) -> Column:
    """Half the width of the inclusive window around a mass, truncated."""
    return (F.lit(float(ppm)) * col(mass) / F.lit(1e6)).cast("long")


def precursor_mass(dalton: Column | str, precision: int = 10000) -> Column:
    return (col(dalton) * precision).cast("long")


def mass_digits(precision: int) -> int:
    return math.ceil(math.log(precision) / math.log(10) - 1e-12)


def mass_format(mass: Column | str, precision: int = 10000) -> Column:
    return F.format_string(f"%.{mass_digits(precision)}f", col(mass) / F.lit(float(precision)))


__all__ = ["WATER", "delta", "mass_digits", "mass_format", "min_residue_mass", "peptide_mass", "precursor_mass", "residue_mass"]
