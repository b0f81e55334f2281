"""Options of index and search, checked on construction."""

from __future__ import annotations

import re
from dataclasses import dataclass

from peptrail.functions.tables import GENETIC_CODES, fixed_masses, fixed_water


@dataclass(frozen=True)
class IndexConfig:
    tag_size: int = 5
    enzyme: str = "RK|"
    mass_precision: int = 10000
    mass_bits: int = 27
    genetic_code: int = 1
    title: str = "index"

    def __post_init__(self) -> None:
        object.__setattr__(self, "enzyme", self.enzyme.upper())
        if self.tag_size < 1:
            raise ValueError("tag_size must be positive")
        if self.enzyme.count("|") != 1 or not set(self.enzyme) <= set("ACDEFGHIKLMNPQRSTVWY|"):
            raise ValueError("enzyme needs exactly one | between residue letters")
        if self.mass_precision < 1 or not 1 <= self.mass_bits <= 62:
            raise ValueError("mass_precision must be positive and mass_bits within 1 to 62")
        if self.genetic_code not in GENETIC_CODES:
            raise ValueError(f"no genetic code {self.genetic_code}")

    @property
    def cut_after(self) -> str:
        """Residues after which the enzyme cuts."""
        return self.enzyme.split("|")[0]

    @property
    def cut_before(self) -> str:
        return self.enzyme.split("|")[1]

    @property
    def max_mass(self) -> int:
        return 2**self.mass_bits - 1

    @property
    def water(self) -> int:
        return fixed_water(self.mass_precision)

    @property
    def masses(self) -> dict[str, int]:
        return fixed_masses(self.mass_precision)


@dataclass(frozen=True)
class SearchConfig:
    mass_accuracy: float = 10.0
    similarity_search: bool = True
    distinguish_il: bool = False
    search_immediate: bool = True
    search_intron_split: str = "conditional"
    max_intron_length: int = 2100
    splice_sites: str = "GT|AG,GC|AG"
    flanking_residues: int = 5

    def __post_init__(self) -> None:
        if self.mass_accuracy < 0 or self.max_intron_length < 1 or self.flanking_residues < 0:
            raise ValueError("mass_accuracy, max_intron_length and flanking_residues must not be negative")
        if self.search_intron_split not in ("yes", "no", "conditional"):
            raise ValueError("search_intron_split is yes, no or conditional")
        self.sites  # noqa: B018

    @property
    def sites(self) -> list[tuple[str, str]]:
        """(donor, acceptor) pairs; longest first."""
        out = []
        for pair in filter(None, self.splice_sites.upper().replace(" ", "").split(",")):
            if not re.fullmatch(r"[ACGT]{1,10}\|[ACGT]{1,10}", pair):
                raise ValueError(f"bad splice site {pair!r}: two motifs of at most 10 nucleotides ACGT with one | between")
            out.append(tuple(pair.split("|")))
        return sorted(set(out), key=lambda p: (-len(p[0]), -len(p[1]), p))
