"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

from peptrail.functions.tables import GENETIC_CODES, MASSES, TAG_LETTERS, codon_string, codon_table, fixed_masses, fixed_water

DNA = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'TTAGGCCGCCGCTTTGCGCGCAGAAN')"
WATER, MAX = fixed_water(), 2**27 - 1
MASS_ROWS = ", ".join(f"('{aa}', {m})" for aa, m in fixed_masses().items())
CODON_ROWS = ", ".join(f"('{c}', '{aa}')" for c, aa in codon_table().items())
RESIDUES = "".join(sorted(MASSES))


def codon_aa(codon: str) -> str:
    """The amino acid of a codon over ACGTN as a lookup in the 125 letters."""
    digit = lambda i: f"(strpos('ACGTN', substr({codon}, {i}, 1)) - 1)"
    return f"substr('{codon_string()}', CAST(25 * {digit(1)} + 5 * {digit(2)} + {digit(3)} + 1 AS BIGINT), 1)"


def mass_of(text: str) -> str:
    """Residue masses of a text, without water."""
    return "(" + " + ".join(f"{m} * (length({text}) - length(replace({text}, '{aa}', '')))" for aa, m in fixed_masses().items()) + ")"


def scaffolds(table: str) -> str:
    key, label = ("doc_id", "coalesce(source, '') || '-' || doc_id") if table == "documents" else ("item_id", "'item-' || item_id")
    return f"scaffolds AS (SELECT {key} AS scaffold_id, {label} AS label, {DNA} AS seq FROM {table})"


STRANDS = """strands AS (
    SELECT scaffold_id, label, '+' AS strand, seq FROM scaffolds
    UNION ALL SELECT scaffold_id, label, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM scaffolds)"""
CODES = f"codons(codon, aa) AS (VALUES {CODON_ROWS}), masses(aa, m) AS (VALUES {MASS_ROWS})"
#: Residues by place; running sums are exclusive.
RESIDUE_ROWS = """places AS (
    SELECT scaffold_id, label, length(seq) AS length, strand, frame, i AS idx, substr(seq, frame + 3 * i + 1, 3) AS codon
    FROM strands, range(3) f(frame), LATERAL (SELECT unnest(range(CAST(greatest((length(seq) - frame) // 3, 0) AS BIGINT))) AS i)
), typed AS (
    SELECT p.scaffold_id, p.label, p.length, p.strand, p.frame, p.idx, c.aa, coalesce(m.m, 0) AS mass, m.m IS NOT NULL AS valid
    FROM places p JOIN codons c USING (codon) LEFT JOIN masses m ON m.aa = c.aa
), flagged AS (
    SELECT *, coalesce(lag(aa) OVER w IN ('*', 'R', 'K'), false) AS cut FROM typed
    WINDOW w AS (PARTITION BY scaffold_id, strand, frame ORDER BY idx)
), residues AS (
    SELECT *, CAST(sum(mass) OVER w - mass AS BIGINT) AS cum_mass,
           CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER w - CASE WHEN valid THEN 0 ELSE 1 END AS BIGINT) AS bad,
           CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER w AS BIGINT) AS span_id
    FROM flagged WINDOW w AS (PARTITION BY scaffold_id, strand, frame ORDER BY idx)
)"""
ORFS = """orfs AS (
    SELECT scaffold_id, any_value(label) AS label, any_value(length) AS length, strand, frame, string_agg(aa, '' ORDER BY idx) AS orf
    FROM typed GROUP BY scaffold_id, strand, frame)"""
SPANS = """spans AS (
    SELECT scaffold_id, strand, frame, span_id, min(idx) AS first_idx, max(idx) AS last_idx
    FROM residues WHERE aa <> '*' GROUP BY ALL)"""
HMST = f"""tagged AS (
    SELECT r.*, s.first_idx AS a, s.last_idx AS b,
           r.aa || lead(r.aa, 1) OVER w || lead(r.aa, 2) OVER w || lead(r.aa, 3) OVER w || lead(r.aa, 4) OVER w AS tag,
           lag(r.aa, 4) OVER w || lag(r.aa, 3) OVER w || lag(r.aa, 2) OVER w || lag(r.aa, 1) OVER w || r.aa AS tag_back
    FROM residues r LEFT JOIN spans s ON r.scaffold_id = s.scaffold_id AND r.strand = s.strand AND r.frame = s.frame AND r.span_id = s.span_id
    WINDOW w AS (PARTITION BY r.scaffold_id, r.strand, r.frame ORDER BY r.idx)
), ends AS (
    SELECT scaffold_id, strand, frame, idx, cum_mass, cum_mass + mass AS cum_end, bad, bad + CASE WHEN valid THEN 0 ELSE 1 END AS spoiled FROM residues
), hmst AS (
    SELECT replace(t.tag, 'I', 'L') AS tag, false AS is_right, t.cum_mass - e.cum_mass AS half_mass, t.scaffold_id, t.strand, t.frame, t.a AS anchor_idx,
           t.frame + 3 * t.a AS anchor_pos, t.idx - t.a AS steps, e.cum_mass AS anchor_cum, e.bad AS anchor_bad
    FROM tagged t JOIN ends e ON e.scaffold_id = t.scaffold_id AND e.strand = t.strand AND e.frame = t.frame AND e.idx = t.a
    WHERE t.idx BETWEEN t.a AND t.b AND regexp_full_match(t.tag, '[{RESIDUES}]{{5}}') AND t.bad = e.bad AND t.cum_mass - e.cum_mass <= {MAX}
    UNION ALL
    SELECT replace(t.tag_back, 'I', 'L'), true, e.cum_end - t.cum_mass - t.mass, t.scaffold_id, t.strand, t.frame, t.b,
           t.frame + 3 * t.b + 2, t.b - t.idx, e.cum_end, e.spoiled
    FROM tagged t JOIN ends e ON e.scaffold_id = t.scaffold_id AND e.strand = t.strand AND e.frame = t.frame AND e.idx = t.b
    WHERE t.idx BETWEEN t.a AND t.b AND regexp_full_match(t.tag_back, '[{RESIDUES}]{{5}}') AND t.bad + CASE WHEN t.valid THEN 0 ELSE 1 END = e.spoiled
      AND e.cum_end - t.cum_mass - t.mass <= {MAX}
)"""


def chain(table: str, *parts: str, last: str) -> str:
    return "WITH " + ", ".join([CODES, scaffolds(table), STRANDS, *parts]) + " " + last


#: Query peptides: runs between cleavage sites of 8 residues or more in the forward frames of benchmark texts.
PEPTIDES = f"""peptides AS (
    SELECT DISTINCT peptide FROM (
        SELECT string_agg(aa, '' ORDER BY idx) AS peptide FROM p_residues WHERE strand = '+' AND span_id > 0 GROUP BY scaffold_id, frame, span_id
    ) WHERE regexp_full_match(peptide, '[{RESIDUES}]{{8,}}')
), windowed AS (
    SELECT peptide, m AS query_mass, m - CAST(trunc(10.0 * m / 1e6) AS BIGINT) AS lo, m + CAST(trunc(10.0 * m / 1e6) AS BIGINT) AS hi
    FROM (SELECT peptide, CAST({WATER} + {mass_of("peptide")} AS BIGINT) AS m FROM peptides)
)"""


def query_tags(exact: bool) -> str:
    places = "range(1)" if exact else "range(length(peptide) - 4)"
    return f"""query_tags AS (
    SELECT peptide, replace(substr(peptide, i + 1, 5), 'I', 'L') AS tag, false AS is_right, CAST({mass_of("substr(peptide, 1, i)")} AS BIGINT) AS half_mass
    FROM peptides, LATERAL (SELECT CAST(unnest({places}) AS INTEGER) AS i)
    UNION ALL
    SELECT peptide, replace(substr(peptide, length(peptide) - 4 - i, 5), 'I', 'L'), true, CAST({mass_of("substr(peptide, length(peptide) - i + 1, i)")} AS BIGINT)
    FROM peptides, LATERAL (SELECT CAST(unnest({places}) AS INTEGER) AS i)
)"""


HITS = """hits AS (
    SELECT q.peptide, h.* FROM query_tags q JOIN hmst h ON q.tag = h.tag AND q.is_right = h.is_right
    AND h.half_mass BETWEEN q.half_mass - CAST(trunc(10.0 * q.half_mass / 1e6) AS BIGINT) AND q.half_mass + CAST(trunc(10.0 * q.half_mass / 1e6) AS BIGINT)
), anchors AS (
    SELECT peptide, scaffold_id, strand, frame, anchor_idx, is_right, min(half_mass) AS half_mass, arg_min(steps, half_mass) AS steps,
           any_value(anchor_cum) AS anchor_cum, any_value(anchor_bad) AS anchor_bad
    FROM hits GROUP BY ALL
)"""
IMMEDIATE = f"""extended AS (
    SELECT w.peptide AS query, a.scaffold_id, a.strand, a.frame, a.anchor_idx AS first_idx, e.idx AS last_idx, e.cum_end - a.anchor_cum + {WATER} AS hit_mass
    FROM anchors a JOIN windowed w USING (peptide) JOIN ends e ON e.scaffold_id = a.scaffold_id AND e.strand = a.strand AND e.frame = a.frame
    WHERE NOT a.is_right AND e.cum_end - a.anchor_cum + {WATER} BETWEEN w.lo AND w.hi AND e.spoiled = a.anchor_bad AND e.idx - a.anchor_idx + 1 >= a.steps + 5
    UNION
    SELECT w.peptide, a.scaffold_id, a.strand, a.frame, e.idx, a.anchor_idx, a.anchor_cum - e.cum_mass + {WATER}
    FROM anchors a JOIN windowed w USING (peptide) JOIN ends e ON e.scaffold_id = a.scaffold_id AND e.strand = a.strand AND e.frame = a.frame
    WHERE a.is_right AND a.anchor_cum - e.cum_mass + {WATER} BETWEEN w.lo AND w.hi AND e.bad = a.anchor_bad AND a.anchor_idx - e.idx + 1 >= a.steps + 5
), alignments AS (
    SELECT x.query, substr(o.orf, CAST(greatest(first_idx - 5, 0) + 1 AS BIGINT), CAST(first_idx - greatest(first_idx - 5, 0) AS BIGINT)) AS aa_n_term,
           substr(o.orf, CAST(first_idx + 1 AS BIGINT), CAST(last_idx - first_idx + 1 AS BIGINT)) AS peptide,
           substr(o.orf, CAST(last_idx + 2 AS BIGINT), 5) AS aa_c_term, round(hit_mass / 10000.0, 4) AS mass,
           '{{index/' || o.label || '}}' || x.strand || CASE WHEN x.strand = '+' THEN x.frame + 3 * first_idx ELSE o.length - 1 - x.frame - 3 * first_idx END
             || ':' || 3 * (last_idx - first_idx + 1) AS assembly
    FROM extended x JOIN orfs o ON o.scaffold_id = x.scaffold_id AND o.strand = x.strand AND o.frame = x.frame
)"""
SITES = """sites AS (SELECT scaffold_id, strand, i AS pos, substr(seq, i + 1, 2) AS motif, substr('NN' || seq, i + 1, 2) AS ahead, substr(seq || 'NN', i + 3, 2) AS behind
    FROM strands, LATERAL (SELECT unnest(range(CAST(greatest(length(seq) - 1, 0) AS BIGINT))) AS i) WHERE substr(seq, i + 1, 2) IN ('GT', 'GC', 'AG'))"""
LIGHT = min(fixed_masses().values())
_CODON = codon_aa("codon")
#: Split alignments of the queries in `wanted(peptide)`: exons from anchors, introns of the default motifs, second exons by mass.
INTRONS = f"""exons AS (
    SELECT w.peptide AS query, a.scaffold_id, a.strand, a.frame, a.is_right, least(a.anchor_idx, e.idx) AS first_idx, greatest(a.anchor_idx, e.idx) AS last_idx,
           CASE WHEN a.is_right THEN a.anchor_cum - e.cum_mass ELSE e.cum_end - a.anchor_cum END AS exon_mass,
           a.frame + 3 * (e.idx + CASE WHEN a.is_right THEN 0 ELSE 1 END) AS edge, w.lo, w.hi, s.split
    FROM anchors a JOIN wanted USING (peptide) JOIN windowed w USING (peptide) JOIN ends e ON e.scaffold_id = a.scaffold_id AND e.strand = a.strand AND e.frame = a.frame, (VALUES (0), (1), (2)) s(split)
    WHERE CASE WHEN a.is_right THEN e.idx <= a.anchor_idx - a.steps - 4 AND e.bad = a.anchor_bad AND a.anchor_cum - e.cum_mass + {WATER} + {LIGHT} <= w.hi
               ELSE e.idx >= a.anchor_idx + a.steps + 4 AND e.spoiled = a.anchor_bad AND e.cum_end - a.anchor_cum + {WATER} + {LIGHT} <= w.hi END
), gaps AS (
    SELECT x.*, d.pos AS gap_start, a.pos + 2 AS gap_end, d.motif || '|' || a.motif AS splice_site
    FROM exons x JOIN sites d ON d.scaffold_id = x.scaffold_id AND d.strand = x.strand AND d.motif IN ('GT', 'GC') AND d.pos = x.edge + x.split
    JOIN sites a ON a.scaffold_id = x.scaffold_id AND a.strand = x.strand AND a.motif = 'AG' AND a.pos BETWEEN d.pos AND d.pos + 2099 - x.split
    WHERE NOT x.is_right
    UNION ALL
    SELECT x.*, d.pos, a.pos + 2, d.motif || '|' || a.motif
    FROM exons x JOIN sites a ON a.scaffold_id = x.scaffold_id AND a.strand = x.strand AND a.motif = 'AG' AND a.pos = x.edge - x.split - 2
    JOIN sites d ON d.scaffold_id = x.scaffold_id AND d.strand = x.strand AND d.motif IN ('GT', 'GC') AND d.pos + 2 BETWEEN x.edge - x.split - 2099 + x.split AND x.edge - x.split
    WHERE x.is_right
), coded AS (
    SELECT g.*, CASE WHEN split = 0 THEN '' WHEN is_right THEN substr(t.seq, gap_start - 2 + split, 3 - split) || substr(t.seq, gap_end + 1, split)
                     ELSE substr(t.seq, edge + 1, split) || substr(t.seq, gap_end + 1, 3 - split) END AS codon
    FROM gaps g JOIN strands t ON t.scaffold_id = g.scaffold_id AND t.strand = g.strand
    WHERE split = 0 OR NOT is_right OR gap_start >= 3 - split
), joined AS (
    SELECT c.*, CASE WHEN split > 0 THEN {_CODON} ELSE '' END AS split_aa, exon_mass + coalesce(m.m, 0) + {WATER} AS so_far,
           CASE WHEN is_right THEN gap_start - (3 - split) % 3 ELSE gap_end + (3 - split) % 3 END AS start
    FROM coded c LEFT JOIN masses m ON split > 0 AND m.aa = {_CODON}
    WHERE split = 0 OR length(codon) = 3 AND m.m IS NOT NULL
), both_exons AS (
    SELECT j.*, NULL AS first2, NULL AS last2, 0 AS frame2, so_far AS hit_mass FROM joined j WHERE split > 0 AND so_far BETWEEN lo AND hi
    UNION ALL
    SELECT j.*, n.idx, e.idx, n.frame, so_far + e.cum_end - n.cum_mass
    FROM joined j JOIN ends n ON n.scaffold_id = j.scaffold_id AND n.strand = j.strand AND n.frame = j.start % 3 AND n.idx = j.start // 3
    JOIN ends e ON e.scaffold_id = j.scaffold_id AND e.strand = j.strand AND e.frame = n.frame AND e.idx >= n.idx AND e.spoiled = n.bad AND so_far + e.cum_end - n.cum_mass BETWEEN lo AND hi
    WHERE NOT is_right AND so_far < hi
    UNION ALL
    SELECT j.*, e.idx, n.idx, n.frame, so_far + n.cum_end - e.cum_mass
    FROM joined j JOIN ends n ON n.scaffold_id = j.scaffold_id AND n.strand = j.strand AND n.frame = j.start % 3 AND n.idx = j.start // 3 - 1
    JOIN ends e ON e.scaffold_id = j.scaffold_id AND e.strand = j.strand AND e.frame = n.frame AND e.idx <= n.idx AND e.bad = n.spoiled AND so_far + n.cum_end - e.cum_mass BETWEEN lo AND hi
    WHERE is_right AND so_far < hi AND start >= 0
), sized AS (
    SELECT b.*, 3 * (last_idx - first_idx + 1) + split AS anchor_nt,
           3 * coalesce(last2 - first2 + 1, 0) + (3 - split) % 3 AS other_nt
    FROM both_exons b
), stretched AS (
    SELECT z.*, CASE WHEN is_right THEN other_nt ELSE anchor_nt END AS size1, CASE WHEN is_right THEN anchor_nt ELSE other_nt END AS size2 FROM sized z
), split_texts AS (
    SELECT z.*, gap_start - size1 AS start1, gap_end + size2 AS stop, o.label, o.length,
           substr(o.orf, CAST(first_idx + 1 AS BIGINT), CAST(last_idx - first_idx + 1 AS BIGINT)) AS mine,
           coalesce(substr(p.orf, CAST(first2 + 1 AS BIGINT), CAST(last2 - first2 + 1 AS BIGINT)), '') AS other
    FROM stretched z JOIN orfs o ON o.scaffold_id = z.scaffold_id AND o.strand = z.strand AND o.frame = z.frame
    LEFT JOIN orfs p ON p.scaffold_id = z.scaffold_id AND p.strand = z.strand AND p.frame = z.frame2
), split_alignments AS (
    SELECT DISTINCT x.query, coalesce(substr(n.orf, CAST(greatest(start1 // 3 - 5, 0) + 1 AS BIGINT), CAST(start1 // 3 - greatest(start1 // 3 - 5, 0) AS BIGINT)), '') AS aa_n_term,
           CASE WHEN is_right THEN other || split_aa || mine ELSE mine || split_aa || other END AS peptide,
           coalesce(substr(c.orf, CAST(stop // 3 + 1 AS BIGINT), 5), '') AS aa_c_term, round(hit_mass / 10000.0, 4) AS mass,
           '{{index/' || x.label || '}}' || x.strand || CASE WHEN x.strand = '+' THEN start1 ELSE x.length - 1 - start1 END || ':' || size1
             || ',' || CASE WHEN x.strand = '+' THEN gap_end ELSE x.length - 1 - gap_end END || ':' || size2 AS assembly,
           CAST(gap_end - gap_start AS BIGINT) AS intron_length, splice_site
    FROM split_texts x LEFT JOIN orfs n ON n.scaffold_id = x.scaffold_id AND n.strand = x.strand AND n.frame = start1 % 3
    LEFT JOIN orfs c ON c.scaffold_id = x.scaffold_id AND c.strand = x.strand AND c.frame = stop % 3
    WHERE replace(CASE WHEN is_right THEN other || split_aa || mine ELSE mine || split_aa || other END, 'I', 'L') = replace(x.query, 'I', 'L')
), numbered AS (SELECT peptide, row_number() OVER (ORDER BY peptide) AS query_id FROM peptides)"""
_OWN = ("scaffolds", "strands", "places", "typed", "flagged", "residues")


def search_chain(*parts: str, last: str, genome: str = "documents") -> str:
    """Queries from benchmark against a table as the genome."""
    import re

    mine = ", ".join([scaffolds("benchmark"), STRANDS, RESIDUE_ROWS])
    mine = re.sub(r"\b(" + "|".join(_OWN) + r")\b", r"p_\1", mine)
    theirs = ", ".join([scaffolds(genome), STRANDS, RESIDUE_ROWS, ORFS, SPANS, HMST])
    return "WITH " + ", ".join([CODES, mine, PEPTIDES, theirs, *parts]) + " " + last
