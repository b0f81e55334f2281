"""Static tables: NCBI genetic codes and monoisotopic residue masses."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

#: NCBI translation tables, amino acids in base order TCAG, first base slowest.
GENETIC_CODES = {
    1: ("The Standard Code", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    2: ("The Vertebrate Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"),
    3: ("The Yeast Mitochondrial Code", "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    4: ("The Mold, Protozoan, and Coelenterate Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    5: ("The Invertebrate Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG"),
    6: ("The Ciliate, Dasycladacean and Hexamita Nuclear Code", "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    9: ("The Echinoderm and Flatworm Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    10: ("The Euplotid Nuclear Code", "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    11: ("The Bacterial, Archaeal and Plant Plastid Code", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    12: ("The Alternative Yeast Nuclear Code", "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    13: ("The Ascidian Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG"),
    14: ("The Alternative Flatworm Mitochondrial Code", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    16: ("Chlorophycean Mitochondrial Code", "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    21: ("Trematode Mitochondrial Code", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG"),
    22: ("Scenedesmus obliquus Mitochondrial Code", "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
    23: ("Thraustochytrium Mitochondrial Code", "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"),
}
#: Monoisotopic residue masses in Da. Ascending mass gives the tag codes; L and I share one.
MASSES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919,
    "L": 113.08406, "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259,
    "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER = 18.01057
TAG_LETTERS = "GASPVTCLNDQKEMHFRYW"
BASES = "TCAG"
INDEX_BASES = "ACGTN"


def parse_genetic_codes(text: str) -> dict[int, tuple[str, str]]:
    """Genetic codes by id, as (title, amino acids in base order TCAG), from text.

    A code is a title line `id. title`, then lines `key = 64 characters` for AAs, Starts, Base1, Base2 and Base3 in any
    order; # begins a comment line. Base1 to Base3 tell which codon each column is.
    """
    out, lines = {}, [line.strip() for line in text.splitlines()]
    lines = [line for line in lines if line and not line.startswith("#")]
    for at in range(0, len(lines), 6):
        title = re.match(r"(\d+)\.\s*(.*)", lines[at])
        rows = dict(re.split(r"\s*=\s*", line, maxsplit=1) for line in lines[at + 1 : at + 6] if "=" in line)
        if not title or set(rows) != {"AAs", "Starts", "Base1", "Base2", "Base3"} or any(len(r) != 64 for r in rows.values()):
            raise ValueError(f"no genetic code at {lines[at]!r}: a title and five lines of 64 characters are needed")
        by = {"".join(c): aa for *c, aa in zip(rows["Base1"].upper(), rows["Base2"].upper(), rows["Base3"].upper(), rows["AAs"].upper())}
        order = list(map("".join, product(BASES, repeat=3)))
        if set(by) != set(order) or int(title[1]) in out:
            raise ValueError(f"the genetic code {title[1]} is given twice, or its bases do not make the 64 codons")
        out[int(title[1])] = title[2].split(" (transl_table")[0], "".join(by[c] for c in order)
    return out


def load_genetic_codes(path: str) -> None:
    """Add a file's genetic codes, in place of those with the same id."""
    with open(path, encoding="utf-8") as f:
        add_genetic_codes(parse_genetic_codes(f.read()))


def add_genetic_codes(codes: dict[int, tuple[str, str]]) -> None:
    GENETIC_CODES.update(codes)
    codon_string.cache_clear()


def code_of(definition: tuple[str, str], code: int) -> int:
    """The id that (title, amino acids) has here: `code` if that is free or means the same, else another, so that no known code changes."""
    if GENETIC_CODES.get(code) == definition:
        return code
    known = [k for k, d in GENETIC_CODES.items() if d == definition]
    if not known:
        known = [code if code not in GENETIC_CODES else max(GENETIC_CODES) + 1]
        add_genetic_codes({known[0]: definition})
    return known[0]


def codon_table(code: int = 1) -> dict[str, str]:
    """Codon to amino acid for all 125 codons over ACGTN; N is a residue only where all completions agree, else X."""
    if code not in GENETIC_CODES:
        raise ValueError(f"no genetic code {code}")
    known = {"".join(c): aa for c, aa in zip(product(BASES, repeat=3), GENETIC_CODES[code][1])}
    out = {}
    for codon in map("".join, product(INDEX_BASES, repeat=3)):
        found = {known["".join(c)] for c in product(*(BASES if b == "N" else b for b in codon))}
        out[codon] = found.pop() if len(found) == 1 else "X"
    return out


@lru_cache(32)
def codon_string(code: int = 1) -> str:
    """The 125 amino acids in order of the codon read as a number of base 5 with A, C, G, T, N = 0..4."""
    return "".join(codon_table(code).values())


def fixed_masses(precision: int = 10000) -> dict[str, int]:
    """Residue masses in fixed point, each truncated."""
    return {aa: int(mass * precision) for aa, mass in MASSES.items()}


def fixed_water(precision: int = 10000) -> int:
    return int(WATER * precision)


def amino_acids(spark: SparkSession) -> DataFrame:
    """aa, mono_mass and code (its place in TAG_LETTERS; I as L)."""
    rows = [(aa, mass, TAG_LETTERS.index("L" if aa == "I" else aa)) for aa, mass in MASSES.items()]
    return spark.createDataFrame(rows, "aa string, mono_mass double, code int")


def genetic_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, title, aas) for k, (title, aas) in GENETIC_CODES.items()], "code_id int, title string, aas string")
