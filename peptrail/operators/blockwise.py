"""Block-wise sums: what a block of a scaffold or of a frame has to say, as array arithmetic on one block.

A row per place would be many times the text; these kernels send on sums by span, run, anchor, tag, motif or triplet.
Scaffolds of one block need nothing of others and their sums are whole; those of longer ones are merged by groupBy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from peptrail.functions.config import IndexConfig
from peptrail.functions.tables import INDEX_BASES, codon_string
from peptrail.operators.tags import STOP, Letters, as_bytes, block_tags, tags_of

#: Rows that leave a task together, about, and codes of tags that a task holds before it counts them.
ROWS, HELD = 1 << 16, 1 << 21
DIGITS = np.full(256, 4, dtype=np.int64)
DIGITS[[ord(c) for c in INDEX_BASES]] = np.arange(5)
OTHER = np.array([3, 2, 1, 0, 4])  # complements of A, C, G, T, N
NT_BLOCK = ["scaffold_id", "label", "length", "block", "seq", "ahead", "behind"]
SUMS = ["base_mass", "base_bad", "base_cuts", "in_idx", "in_mass", "in_bad", "out_idx", "out_mass", "out_bad"]


class Rows:
    """Rows found for the rows of an Arrow batch: arrays by column, each with the number of its row; keys are taken from the batch."""

    def __init__(self, keys: list[str], names: list[str]):
        self.keys, self.names, self.at, self.columns, self.size = keys, names, [], [], 0

    def add(self, row: int, *columns) -> None:
        n = len(columns[0])
        self.at.append(np.full(n, row))
        self.columns.append(columns)
        self.size += n

    def batches(self, batch, least: int = 1) -> Iterator:
        import pyarrow as pa

        if self.size < least:
            return
        at = pa.array(np.concatenate(self.at))
        keys = [batch.column(c).take(at) for c in self.keys]
        rest = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else pa.array(np.concatenate(c)) for c in zip(*self.columns)]
        self.at, self.columns, self.size = [], [], 0
        yield pa.RecordBatch.from_arrays([*keys, *rest], names=[*self.keys, *self.names])


def each(batches, keys: list[str], names: list[str], columns: list[str], work: Callable) -> Iterator:
    """work(*values of columns) gives the arrays of a row, or None; rows leave about ROWS at a time."""
    for batch in batches:
        rows = Rows(keys, names)
        for i, values in enumerate(zip(*(batch.column(c) for c in columns))):
            found = work(*(v.as_py() for v in values))
            if found is not None and len(found[0]):
                rows.add(i, *found)
                yield from rows.batches(batch, ROWS)
        yield from rows.batches(batch)


def letters_to_arrow(letters: np.ndarray):
    """Rows of letters (bytes) as an Arrow array of strings."""
    import pyarrow as pa

    n, k = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * np.int32(k)).tobytes()), pa.py_buffer(np.ascontiguousarray(letters).tobytes()))


def both_strands(nt: int, length: int, block: int, seq: str, ahead: str, behind: str) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """strand, strand-local place, and the digits ahead, in and behind a block as read on each strand."""
    a, s, b = (DIGITS[as_bytes(t)] for t in (ahead, seq, behind))
    yield "+", block * nt, a, s, b
    yield "-", length - block * nt - len(s), OTHER[b[::-1]], OTHER[s[::-1]], OTHER[a[::-1]]


def own_sums(letters: Letters, t: np.ndarray) -> tuple[int, ...]:
    """SUMS of a frame of one block: nothing lies before, and its last span ends with it."""
    star = int(t[-1] == STOP)
    return 0, 0, 0, 0, 0, 0, len(t) - 1 - star, int(letters.mass[t].sum()), int((~letters.valid[t]).sum()) - star


def block_frames(cfg: IndexConfig, nt: int, sums: bool) -> Callable:
    """Blocks of residues of the six frames of batches of nt_blocks; sums: with SUMS, of scaffolds of one block each."""
    letters, k, wide = Letters(cfg), cfg.tag_size, max(cfg.tag_size - 1, 1)
    table = np.frombuffer(codon_string(cfg.genetic_code).encode("ascii"), dtype=np.uint8)
    names = ["scaffold_id", "strand", "frame", "label", "length", "block", "first_idx", "text", "ahead", "behind", *(SUMS if sums else [])]

    def run(batches):
        import pyarrow as pa

        def batch_of(batch, rows):
            at, *columns = zip(*rows)
            at = pa.array(at)
            taken = {c: batch.column(c).take(at) for c in ("scaffold_id", "label", "length", "block")}
            strand, frame, first, text, ahead, behind, *more = columns
            made = {"strand": pa.array(strand), "frame": pa.array(frame, pa.int32()), "first_idx": pa.array(first, pa.int64()), "text": pa.array(text), "ahead": pa.array(ahead), "behind": pa.array(behind)}
            made |= {c: pa.array(v, pa.int64()) for c, v in zip(SUMS, more)}
            return pa.RecordBatch.from_arrays([(taken | made)[c] for c in names], names=names)

        for batch in batches:
            rows, held = [], 0
            for i, values in enumerate(zip(*(batch.column(c) for c in ("length", "block", "seq", "ahead", "behind")))):
                length, block, seq, ahead, behind = (v.as_py() for v in values)
                for strand, at, a, s, b in both_strands(nt, length, block, seq, ahead, behind):
                    d = np.r_[a, s, b]
                    aa = table[25 * d[:-2] + 5 * d[1:-1] + d[2:]] if len(d) > 2 else table[:0]
                    for frame in range(3):
                        skip = (frame - at) % 3
                        first = (at + skip - frame) // 3
                        n = min(-((skip - len(s)) // 3), (length - frame) // 3 - first)
                        if n > 0:
                            lead = min(wide, (len(a) + skip) // 3)
                            found = aa[len(a) + skip - 3 * lead :: 3][: lead + n + k - 1]
                            text = found[lead : lead + n]
                            rows.append((i, strand, frame, first, text.tobytes().decode(), found[:lead].tobytes().decode(), found[lead + n :].tobytes().decode(), *(own_sums(letters, text) if sums else ())))
                held += 2 * len(seq)
                if held > 1 << 21:
                    yield batch_of(batch, rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(batch, rows)

    return run


FRAME_ROW = ["scaffold_id", "strand", "frame"]


def site_sums(cfg: IndexConfig) -> Callable:
    """Of frame_blocks: number, sum of places and last of the first residues of spans."""
    letters = Letters(cfg)

    def work(text, ahead, first):
        cuts = letters.block(as_bytes(text), as_bytes(ahead[-1:]))[2] + first
        cuts = np.r_[0, cuts] if first == 0 else cuts
        if len(cuts):
            return np.array([len(cuts)]), np.array([cuts.sum()]), cuts[-1:].astype(np.int64)

    return lambda batches: each(batches, FRAME_ROW, ["n_sites", "site_sum", "last_site"], ["text", "ahead", "first_idx"], work)


def span_sizes(cfg: IndexConfig) -> Callable:
    """Of with_sums: number, residues and longest of the spans that end in a block, stops left out."""
    letters = Letters(cfg)

    def work(text, ahead, first, frame, length, begin):
        t, before = as_bytes(text), as_bytes(ahead[-1:])
        cuts = letters.block(t, before)[2]
        last = first + len(t) == (length - frame) // 3
        starts = np.r_[begin, first + cuts]
        ends = np.r_[cuts, len(t)] if last else cuts
        closed = np.r_[before, t][ends - 1 + len(before)] == STOP
        size = first + ends - closed - starts[: len(ends)]
        size = size[size > 0]
        if len(size):
            return np.array([len(size)]), np.array([size.sum()]), np.array([size.max()])

    return lambda batches: each(batches, FRAME_ROW, ["n_spans", "residues", "longest"], ["text", "ahead", "first_idx", "frame", "length", "in_idx"], work)


def span_masses(cfg: IndexConfig) -> Callable:
    """Of with_sums: number, least, largest and sum of the running masses of each span's residues in a block."""
    letters = Letters(cfg)

    def work(text, ahead, mass, cuts_before):
        t = as_bytes(text)
        cum, _, cuts = letters.block(t, as_bytes(ahead[-1:]))
        starts = np.unique(np.r_[0, cuts])
        stops = np.r_[starts[1:], len(t)]
        cum = cum[:-1] + mass
        span = cuts_before + np.searchsorted(cuts, starts, "right")
        return span, stops - starts, cum[starts], cum[stops - 1], np.add.reduceat(cum, starts)

    return lambda batches: each(batches, FRAME_ROW, ["span_id", "n", "least", "most", "total"], ["text", "ahead", "base_mass", "base_cuts"], work)


def run_sums(cfg: IndexConfig) -> Callable:
    """Of with_sums: first, last, number and mass of each run of valid residues in a block."""
    letters = Letters(cfg)

    def work(text, first, bad_before):
        t = as_bytes(text)
        valid = letters.valid[t]
        edge = np.diff(np.r_[0, valid.astype(np.int8), 0])
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            cum = np.r_[0, np.cumsum(letters.mass[t])]
            bad = np.r_[0, np.cumsum(~valid)]
            return bad_before + bad[starts], first + starts, first + stops - 1, stops - starts, cum[stops] - cum[starts]

    return lambda batches: each(batches, FRAME_ROW, ["run_id", "first_idx", "last_idx", "residues", "mass"], ["text", "first_idx", "base_bad"], work)


def residue_sums(cfg: IndexConfig) -> Callable:
    """Of with_sums: a row per residue with the running sums of mass and of invalid residues before and behind it."""
    letters = Letters(cfg)

    def work(text, first, mass, bad_before):
        t = as_bytes(text)
        cum, bad, _ = letters.block(t, t[:0])
        cum, bad = cum + mass, bad + bad_before
        return first + np.arange(len(t)), cum[:-1], cum[1:], bad[:-1], bad[1:]

    return lambda batches: each(batches, FRAME_ROW, ["idx", "cum_mass", "cum_end", "bad", "spoiled"], ["text", "first_idx", "base_mass", "base_bad"], work)


TAGS = ["text", "ahead", "behind", "first_idx", *[c for c in SUMS if c != "base_cuts"]]


def tags_in(letters: Letters, cfg: IndexConfig, text, ahead, behind, first, mass, bad, *ends) -> list[tuple]:
    return tags_of(letters, cfg.tag_size, cfg.max_mass, text, ahead, behind, first, (mass, bad), ends[:3], ends[3:])


def anchor_sums(cfg: IndexConfig) -> Callable:
    """Of with_sums: number, least and largest tag and sum of half masses by direction and anchor."""
    letters, k = Letters(cfg), cfg.tag_size

    def work(frame, *values):
        out = []
        for right, (tag, half, anchor, *_) in enumerate(tags_in(letters, cfg, *values)):
            if len(half):  # anchors of a direction stand together
                start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                word = np.ascontiguousarray(tag).view(f"S{k}").ravel()
                group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(half)]))
                order = np.lexsort((word, group))
                least, most = tag[order[start]], tag[order[np.r_[start[1:], len(half)] - 1]]
                a = anchor[start]
                out.append((np.full(len(start), bool(right)), a, frame + 3 * a + 2 * right, np.diff(np.r_[start, len(half)]), letters_to_arrow(least), letters_to_arrow(most), np.add.reduceat(half, start)))
        return out

    def run(batches):
        for batch in batches:
            rows = Rows(FRAME_ROW, ["is_right", "anchor_idx", "anchor_pos", "n", "first_tag", "last_tag", "mass_sum"])
            for i, values in enumerate(zip(*(batch.column(c) for c in ["frame", *TAGS]))):
                for found in work(*(v.as_py() for v in values)):
                    rows.add(i, *found)
                yield from rows.batches(batch, ROWS)
            yield from rows.batches(batch)

    return run


class Counts:
    """Numbers of the words of k letters seen by a task; each is kept once, so the table is bounded by the words there are."""

    def __init__(self, k: int):
        self.k, self.kind, self.packed = k, f"S{k}", 5 * k <= 63
        self.words, self.counts = np.zeros(0, dtype=np.int64 if self.packed else self.kind), np.zeros(0, dtype=np.int64)
        self.held, self.size = [], 0

    def add(self, letters: np.ndarray) -> None:
        if len(letters):
            if self.packed:
                code = np.zeros(len(letters), dtype=np.int64)
                for j in range(self.k):
                    code = (code << 5) | (letters[:, j] & 31)
            else:
                code = np.ascontiguousarray(letters).view(self.kind).ravel()
            self.held.append(code)
            self.size += len(code)
            if self.size >= HELD + len(self.words):
                self.settle()

    def settle(self) -> None:
        if self.held:
            words, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            both = np.r_[self.words, words]
            self.words, back = np.unique(both, return_inverse=True)
            self.counts = np.bincount(back, weights=np.r_[self.counts, counts], minlength=len(self.words)).astype(np.int64)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Letters and numbers, ROWS at a time. Five bits tell the letters A to Z, and * from them."""
        self.settle()
        for at in range(0, len(self.words), ROWS):
            words, counts = self.words[at : at + ROWS], self.counts[at : at + ROWS]
            if self.packed:
                digits = (words[:, None] >> (5 * np.arange(self.k - 1, -1, -1))) & 31
                letters = np.where(digits == (STOP & 31), STOP, digits + 64).astype(np.uint8)
            else:
                letters = np.frombuffer(words.tobytes(), dtype=np.uint8).reshape(-1, self.k)
            yield letters, counts


def tag_counts(cfg: IndexConfig) -> Callable:
    """Of with_sums: tag, is_right and number of a task's half-mass tags."""
    letters = Letters(cfg)

    def run(batches):
        import pyarrow as pa

        seen = Counts(cfg.tag_size), Counts(cfg.tag_size)
        for batch in batches:
            for values in zip(*(batch.column(c) for c in TAGS)):
                for side, found in zip(seen, tags_in(letters, cfg, *(v.as_py() for v in values))):
                    side.add(found[0])
        for right, side in enumerate(seen):
            for tags, n in side.rows():
                yield pa.RecordBatch.from_arrays([letters_to_arrow(tags), pa.array(np.full(len(n), bool(right))), pa.array(n)], names=["tag", "is_right", "n"])

    return run


def distinct_windows(cfg: IndexConfig) -> Callable:
    """Of frame_blocks: the windows of tag_size residues of a task, each once, whatever their letters."""
    k = cfg.tag_size

    def run(batches):
        import pyarrow as pa

        seen = Counts(k)
        for batch in batches:
            for text, behind in zip(batch.column("text"), batch.column("behind")):
                t = as_bytes(text.as_py() + behind.as_py()[: k - 1])
                if len(t) >= k:
                    seen.add(np.lib.stride_tricks.sliding_window_view(t, k))
        for tags, _ in seen.rows():
            yield pa.RecordBatch.from_arrays([letters_to_arrow(tags)], names=["tag"])

    return run


def strand_rows(names: list[str], nt: int, work: Callable) -> Callable:
    """work(strand, at, ahead, seq, behind) gives the arrays of a block's strand, or None; scaffold_id and strand come first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = Rows(["scaffold_id"], ["strand", *names])
            for i, values in enumerate(zip(*(batch.column(c) for c in ("length", "block", "seq", "ahead", "behind")))):
                for strand, *block in both_strands(nt, *(v.as_py() for v in values)):
                    found = work(*block)
                    if found is not None and len(found[0]):
                        rows.add(i, pa.array([strand] * len(found[0])), *found)
                yield from rows.batches(batch, ROWS)
            yield from rows.batches(batch)

    return run


BASES = np.frombuffer(INDEX_BASES.encode("ascii"), dtype=np.uint8)


def triplet_sums(nt: int) -> Callable:
    """Of nt_blocks: number and sum of places of the triplets that begin in a block, by strand and codon."""
    names = np.stack([BASES[np.arange(125) // 25], BASES[np.arange(125) // 5 % 5], BASES[np.arange(125) % 5]], axis=1)

    def work(at, ahead, seq, behind):
        d = np.r_[seq, behind[:2]]
        if len(d) < 3:
            return None
        code = 25 * d[:-2] + 5 * d[1:-1] + d[2:]
        n = np.bincount(code, minlength=125)
        place = np.bincount(code, weights=np.arange(len(code)), minlength=125).astype(np.int64)  # whole numbers below 2^53: exact
        seen = np.flatnonzero(n)
        return letters_to_arrow(names[seen]), n[seen], place[seen] + at * n[seen]

    return strand_rows(["codon", "n", "pos_sum"], nt, work)


#: GT, GC and AG as digits of base 5.
MOTIFS = {"GT": 13, "GC": 11, "AG": 2}


def motif_places(ahead: np.ndarray, seq: np.ndarray, behind: np.ndarray, motif: str) -> np.ndarray:
    """Places in seq where a motif of two nucleotides begins."""
    d = np.r_[seq, behind[:1]]
    return np.flatnonzero(5 * d[:-1] + d[1:] == MOTIFS[motif])


def motif_sums(nt: int) -> Callable:
    """Of nt_blocks: number and sum of places of GT, GC and AG by strand, and the least of the two nucleotides before and behind together (N beyond the bounds)."""

    def work(at, ahead, seq, behind):
        import pyarrow as pa

        none = np.full(2, 4)
        around = np.r_[np.r_[none, ahead][-2:], seq, behind[:3], none]
        rows = []
        for motif in MOTIFS:
            p = motif_places(ahead, seq, behind, motif)
            if len(p):
                # letters sort A, C, G, N, T: not as their digits do
                beside = BASES[np.stack([around[p], around[p + 1], around[p + 4], around[p + 5]], axis=1)].astype(np.int64)
                least = int((beside @ np.array([1 << 24, 1 << 16, 1 << 8, 1])).min())
                rows.append((motif, len(p), int(p.sum()) + at * len(p), least.to_bytes(4, "big").decode()))
        if rows:
            motif, n, total, least = zip(*rows)
            return pa.array(motif), np.array(n), np.array(total), pa.array(least)

    return strand_rows(["motif", "n", "pos_sum", "least"], nt, work)


def start_sums(nt: int, cfg: IndexConfig) -> Callable:
    """Of nt_blocks: valid residues up to two nucleotides before GT or GC, by frame, split and motif: number and sum of their places in their frame."""
    table = np.frombuffer(codon_string(cfg.genetic_code).encode("ascii"), dtype=np.uint8)
    valid = Letters(cfg).valid[table]

    def work(at, ahead, seq, behind):
        import pyarrow as pa

        d, rows = np.r_[ahead, seq], []
        for motif in ("GT", "GC"):
            p = motif_places(ahead, seq, behind, motif) + len(ahead)
            for split in range(3):
                q = p - split - 3  # where the residue's codon begins
                q = q[q >= 0]
                q = q[valid[25 * d[q] + 5 * d[q + 1] + d[q + 2]]] + (at - len(ahead))
                for frame in range(3):
                    mine = q[q % 3 == frame]
                    if len(mine):
                        rows.append((frame, split, motif, len(mine), int(((mine - frame) // 3).sum())))
        if rows:
            frame, split, motif, n, total = zip(*rows)
            return pa.array(frame, pa.int32()), pa.array(split, pa.int32()), pa.array(motif), np.array(n), np.array(total)

    return strand_rows(["frame", "split", "motif", "n", "idx_sum"], nt, work)


def donor_rows(nt: int, reach: int) -> Callable:
    """Of nt_blocks with `reach` nucleotides behind: a row per donor GT or GC with an acceptor AG from its own place to reach - 1 on:
    number, sum of intron lengths, first and last of these."""

    def work(at, ahead, seq, behind):
        import pyarrow as pa

        acceptors = motif_places(ahead, np.r_[seq, behind], behind[:0], "AG")
        sums = np.r_[0, np.cumsum(acceptors)]
        out = []
        for motif in ("GT", "GC"):
            d = motif_places(ahead, seq, behind, motif)
            lo, hi = np.searchsorted(acceptors, d), np.searchsorted(acceptors, d + reach)
            some = hi > lo
            d, lo, hi = d[some], lo[some], hi[some]
            out.append((d + at, pa.array([motif] * len(d), pa.string()), hi - lo, sums[hi] - sums[lo] + (2 - d) * (hi - lo), acceptors[lo] + at, acceptors[hi - 1] + at))
        place, motif, n, total, first, last = zip(*out)
        return np.concatenate(place), pa.concat_arrays(motif), *(np.concatenate(c) for c in (n, total, first, last))

    return strand_rows(["d_pos", "d_motif", "n", "length_sum", "first_acceptor", "last_acceptor"], nt, work)


def wanted_tags(cfg: IndexConfig, wanted: list[str]) -> Callable:
    """Postings of batches of with_sums whose tag is one of `wanted`; others never leave the block."""
    make = block_tags(cfg, np.unique(np.array([t.encode("ascii") for t in wanted], dtype=f"S{cfg.tag_size}")))
    return make
