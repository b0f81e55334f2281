"""Block-wise kernels: what the blocks of a frame tell their neighbours, and the tags in a block.

Running sums inside a block, the span bounds around each residue and windows of tag_size residues are array arithmetic
on one block of at most 8192 residues; Spark deals the blocks, adds up the blocks' facts and shuffles what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from peptrail.functions.config import IndexConfig

#: Blocks whose tags leave a task together.
TOGETHER = 8


class Letters:
    """Masses, validity and cleavage by byte."""

    def __init__(self, cfg: IndexConfig):
        self.mass, self.valid, self.after, self.before = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        for aa, mass in cfg.masses.items():
            self.mass[ord(aa)], self.valid[ord(aa)] = mass, True
        self.after[[ord(c) for c in "*" + cfg.cut_after]] = True
        self.before[[ord(c) for c in cfg.cut_before]] = True
        self.leucine = np.arange(256, dtype=np.uint8)
        self.leucine[ord("I")] = ord("L")

    def block(self, text: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of mass and of invalid residues before each place and behind the last, and the places that a cleavage site precedes. before: the residue ahead, if any."""
        zero = np.zeros(1, dtype=np.int64)
        cut = self.before[text].copy()
        cut[1:] |= self.after[text[:-1]]
        cut[:1] = len(before) > 0 and (cut[0] or self.after[before[-1]])
        return np.r_[zero, np.cumsum(self.mass[text])], np.r_[zero, np.cumsum(~self.valid[text])], np.flatnonzero(cut)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), dtype=np.uint8)


STOP = ord("*")
FACTS = "block long, first_idx long, mass long, bad long, cuts long, s_at long, s_mass long, s_bad long, e_at long, e_mass long, e_bad long, z_at long, z_mass long, z_bad long"


def block_facts(cfg: IndexConfig) -> Callable:
    """For batches(scaffold_id, strand, frame, block, first_idx, text, before): the block's sums; where its last span begins (s), and where
    the span that is open at its first residue ends (e), if it has a cleavage site; and where the frame's last span ends if the block is the last (z)."""
    letters = Letters(cfg)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 14
        names = [f.split()[0] for f in FACTS.split(", ")]
        for batch in batches:
            rows = []
            for block, first, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("block", "first_idx", "text", "before"))):
                t, before = as_bytes(text), as_bytes(ahead)
                cum, bad, cuts = letters.block(t, before)
                start = end = (None, None, None)
                star = int(t[-1] == STOP)
                if len(cuts):
                    s, e = int(cuts[-1]), int(cuts[0])
                    closed = int((t[e - 1] if e else before[-1]) == STOP)
                    start, end = (first + s, cum[s], bad[s]), (first + e - 1 - closed, cum[e], bad[e] - closed)
                rows.append((block, first, cum[-1], bad[-1], len(cuts), *start, *end, first + len(t) - 1 - star, cum[-1], bad[-1] - star))
            if rows:
                facts = [pa.array([None if x is None else int(x) for x in c], k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scaffold_id", "strand", "frame")), *facts], names=["scaffold_id", "strand", "frame", *names])

    return run


def tags_of(letters: Letters, k: int, most: int, text: str, ahead: str, behind: str, first: int, base: tuple[int, int], begin: tuple[int, int, int], end: tuple[int, int, int]) -> list[tuple]:
    """(tag bytes, half masses, anchors, steps, anchor sums of mass and of invalid residues) of a block's left tags, and of its right ones.

    base: the sums before the block; begin: place and sums of the anchor of the span that is open at its first residue;
    end: of the one open at its last.
    """
    t = as_bytes(text)
    n, place = len(t), np.arange(len(t))
    front, back = as_bytes(ahead[len(ahead) - (k - 1) :] if k > 1 else ""), as_bytes(behind[: k - 1])
    before = as_bytes(ahead[-1:])
    cum, bad, cuts = letters.block(t, before)
    cum, bad = cum + base[0], bad + base[1]
    around = np.r_[front, t, back]
    wrong = np.r_[0, np.cumsum(~letters.valid[around])]
    whole = np.zeros(len(around) + k, dtype=bool)
    windows = max(0, len(around) - k + 1)
    whole[:windows] = wrong[k : k + windows] == wrong[:windows]
    seen = letters.leucine[around]
    # the span of each place: since the last cleavage site, up to the next
    number = np.searchsorted(cuts, place, "right")
    starts, stops = np.r_[0, cuts], np.r_[cuts, n]
    closed = np.r_[(np.r_[before, t][cuts - 1 + len(before)] == STOP).astype(np.int64), 0]
    anchors = np.stack([np.r_[begin[0], first + cuts], np.r_[begin[1], cum[cuts]], np.r_[begin[2], bad[cuts]]])
    finals = np.stack([first + stops - 1 - closed, cum[stops], bad[stops] - closed])
    finals[:, -1] = end
    out = []
    for right in (False, True):
        a, a_cum, a_bad = (finals if right else anchors)[:, number]
        at = place + len(front) - (k - 1 if right else 0)
        half = a_cum - cum[1:] if right else cum[:-1] - a_cum
        ok = whole[np.maximum(at, 0)] & (at >= 0) & ((bad[1:] if right else bad[:-1]) == a_bad) & (half <= most)
        i = np.flatnonzero(ok)
        letters_at = seen[at[i][:, None] + np.arange(k)] if len(i) else np.zeros((0, k), dtype=np.uint8)
        steps = a[i] - (first + i) if right else first + i - a[i]
        out.append((letters_at, half[i], a[i], steps, a_cum[i], a_bad[i]))
    return out



def block_tags(cfg: IndexConfig, wanted: np.ndarray | None = None) -> Callable:
    """Postings of batches of frame blocks with their sums; wanted (sorted bytes): only those of these tags."""
    letters, k, most = Letters(cfg), cfg.tag_size, cfg.max_mass
    columns = ["text", "ahead", "behind", "first_idx", "frame", "base_mass", "base_bad", "in_idx", "in_mass", "in_bad", "out_idx", "out_mass", "out_bad"]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in range(0, whole.num_rows, TOGETHER):
                batch, found, rows, sides = whole.slice(part, TOGETHER), [], [], []
                for row, (text, ahead, behind, first, frame, mass, bad, *ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                    for right, (tag, half, anchor, steps, cum, spoiled) in enumerate(tags_of(letters, k, most, text, ahead, behind, first, (mass, bad), ends[:3], ends[3:])):
                        if wanted is not None:
                            words = np.ascontiguousarray(tag).view(f"S{k}").ravel()
                            some = wanted[np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)] == words if len(wanted) else np.zeros(len(words), dtype=bool)
                            tag, half, anchor, steps, cum, spoiled = (x[some] for x in (tag, half, anchor, steps, cum, spoiled))
                        found.append((tag, half, anchor, frame + 3 * anchor + 2 * right, steps, cum, spoiled))
                        rows.append(np.full(len(half), row))
                        sides.append(np.full(len(half), bool(right)))
                if not found:
                    continue
                tag, half, anchor, position, steps, cum, spoiled = (np.concatenate(c) for c in zip(*found))
                at = pa.array(np.concatenate(rows))
                ends = np.arange(len(tag) + 1, dtype=np.int32) * np.int32(k)
                text = pa.StringArray.from_buffers(len(tag), pa.py_buffer(ends.tobytes()), pa.py_buffer(tag.tobytes()))
                keys = [batch.column(c).take(at) for c in ("scaffold_id", "strand", "frame")]
                rest = [pa.array(x.astype(np.int64)) for x in (anchor, position, steps, cum, spoiled)]
                names = ["tag", "is_right", "half_mass", "scaffold_id", "strand", "frame", "anchor_idx", "anchor_pos", "steps", "anchor_cum", "anchor_bad"]
                yield pa.RecordBatch.from_arrays([text, pa.array(np.concatenate(sides)), pa.array(half.astype(np.int64)), *keys, *rest], names=names)

    return run
