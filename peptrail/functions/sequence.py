"""Sequence and tag scalars as Column expressions, all inside code generation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from peptrail.functions.tables import MASSES, TAG_LETTERS, codon_string

RESIDUES = "".join(sorted(MASSES))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nt_normalize(seq: Column | str) -> Column:
    """Upper case; everything but A, C, G and T (also U) becomes N."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGT", "TGCA")


def revcomp(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def codon_at(seq: Column | str, pos: Column | int) -> Column:
    """The codon that begins at a 0-based position."""
    return F.substring(col(seq), (F.lit(pos) if isinstance(pos, int) else pos) + 1, 3)


def codon_letters(code: int) -> Column:
    """The amino acids by the number that a codon's digits (A, C, G, T, N as 0 to 4) read as in base 10: an array, for a lookup by place."""
    by = dict(zip(("".join(c) for c in product("01234", repeat=3)), codon_string(code)))
    return F.array(*(F.lit(by.get(f"{i:03d}", "")) for i in range(445)))


def translate_codon(codon: Column | str, code: int = 1) -> Column:
    """The amino acid of a codon over ACGTN: * for a stop, X where it isn't determined; null unless 3 long."""
    return F.when(F.length(col(codon)) == 3, F.get(codon_letters(code), F.translate(col(codon), "ACGTN", "01234").cast("int")))


def codons(seq: Column, frame: Column | int) -> Column:
    """The whole codons from a 0-based frame on, in one pass over the sequence."""
    start = (F.lit(frame) if isinstance(frame, int) else frame) + 1
    return F.regexp_extract_all(F.substring(seq, start, F.length(seq)), F.lit("[ACGTN]{3}"), 0)


def orf(seq: Column, frame: Column | int, code: int = 1) -> Column:
    """The translation of a frame, stops and unknowns included."""
    start = (F.lit(frame) if isinstance(frame, int) else frame) + 1
    digits = F.substring(F.translate(seq, "ACGTN", "01234"), start, F.length(seq))
    numbers = F.regexp_extract_all(digits, F.lit("[0-4]{3}"), 0)
    return F.array_join(F.transform(numbers, lambda c: F.get(codon_letters(code), c.cast("int"))), "")


def il_normalize(peptide: Column | str) -> Column:
    return F.translate(col(peptide), "I", "L")


def tag_code(tag: Column | str) -> Column:
    """The tag as a number of base 19, -1 if a letter is no residue."""
    t = il_normalize(tag)
    letters = F.filter(F.split(t, ""), lambda c: c != "")
    value = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc * 19 + F.instr(F.lit(TAG_LETTERS), c) - 1)
    return F.when(t.rlike(f"^[{TAG_LETTERS}]+$"), value).otherwise(F.lit(-1).cast("long"))


def tag_decode(code: Column | str, size: int) -> Column:
    digits = [F.floor(col(code) / 19 ** (size - 1 - i)) % 19 for i in range(size)]
    return F.concat(*(F.substring(F.lit(TAG_LETTERS), d.cast("int") + 1, F.lit(1)) for d in digits))


def is_peptide(peptide: Column | str) -> Column:
    return col(peptide).rlike(f"^[{RESIDUES}]+$")


def overlapping(text: Column, size: int) -> Column:
    """All substrings of `size` characters, by place."""
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{size}}}))"), 1)
