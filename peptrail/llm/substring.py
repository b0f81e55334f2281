"""Near-duplicate passages by compact windows.

Tokens are a text's `width`-word shingles (A-Z in lower case). For each of `hashes` hash functions
a Cartesian tree over the tokens' hashes gives compact windows (l, c, r): every subsequence that
begins in [l, c] and ends in [c, r] has its min-hash at c. Only windows that hold a passage of
`least` words are made; in number they are about 2 n / least for each function. Windows with equal
signatures (function and min-hash) form a group; each is tied to the group's first window, in order
of doc_id and place, so a group of n gives n - 1 ties, never all pairs.

A task ties the windows of a block of texts among themselves first and sends on only the first of each
group, so a group found in every text is thinned before the shuffle. Where a block has a key more than once (a frequent
line), its windows are grouped a second time, by the key and 15 or 17 tokens to one side of the centre, and tied to the
first of these too, in their block and in all: two near copies made of frequent lines meet there.

Ties of one text to one earlier text are joined as intervals: passages of the later text where at least `agree` ties
(of different functions or centres) with nearly one shift between the two texts overlap are candidates. These are verified on the texts: the
matched stretch is trimmed to common shingles and must hold `least` words with a Jaccard similarity
of `similarity` or more. What is left is repeated: the words of a verified passage in the later text.

A text's windows may tie to different first windows, so texts are tied to several earlier ones, and
the union of their passages counts. The first occurrence of a passage is never marked.

Where a frequent line holds the minima, two copies of a passage are tied to some text with that line and never to
each other. So word-for-word copies have a way of their own (`verbatim`): every run of `span` tokens has its minimum in
one window of one function, and reaches half a span from it to the left or to the right. The half is the key of a
group, and the runs of a group are told apart by a byte for each further token: the first text with a run is the
first for all others with it, however many texts share the half. So no verbatim copy is lost to a group's first window.
What is found this way is verified too: both texts' tokens are compared, and a run that is a token too long is cut.

Defined cases: null text and texts under `least` words have no passages; rows that repeat a doc_id are
told apart by their texts, and rows wholly repeated share their result; null doc_ids take no part;
a text is compared with itself too, so a passage repeated inside one text is marked from its second
place on; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import BASE, Scratch, arrow_map, blocks, column_words, in_arrow, mix, powers, semi_by_size, shingle_hashes, signed, text_words, to_batch, whole_groups, word_count

WIDTH, LEAST, SIMILARITY, HASHES, AGREE, GAP = 5, 50, 0.8, 5, 2, 12


def minima(keys: np.ndarray, span: int) -> np.ndarray:
    """The least key of each run of `span` keys in each row: block-wise running minima from both sides."""
    rows, size = keys.shape
    blocks = -(-size // span)
    pad = np.full((rows, blocks * span), np.uint64(2**64 - 1), dtype=np.uint64)
    pad[:, :size] = keys
    pad = pad.reshape(rows, blocks, span)
    ahead = np.minimum.accumulate(pad, axis=2).reshape(rows, -1)
    back = np.minimum.accumulate(pad[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    return np.minimum(back[:, : size - span + 1], ahead[:, span - 1 : size])


@dataclass
class Tokens:
    """The shingles of several texts one behind the other; text i has those at begin[i] to begin[i] + size[i]."""

    values: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, offsets: np.ndarray, width: int) -> Tokens:
        values = shingle_hashes(words, width) if len(words) >= width else np.zeros(0, dtype=np.uint64)
        return cls(values, offsets[:-1], np.maximum(np.diff(offsets) - width + 1, 0))

    @cached_property
    def text(self) -> np.ndarray:
        """For each value the text whose words it begins in."""
        return np.searchsorted(self.begin, np.arange(len(self.values)), "right") - 1

    @cached_property
    def at(self) -> np.ndarray:
        """For each value its place in that text."""
        return np.arange(len(self.values)) - self.begin[self.text] if len(self.values) else np.zeros(0, dtype=np.int64)


def smaller(keys: np.ndarray, step: int) -> np.ndarray:
    """For each key the nearest place before (step -1) or behind it (1) that holds no larger key; places at the ends point to themselves.

    All places jump at once, over what the place that they have reached has jumped over.
    """
    n = len(keys)
    to = np.clip(np.arange(n) + step, 0, n - 1)
    open_ = np.flatnonzero(keys[to] > keys)
    while len(open_):
        to[open_] = to[to[open_]]
        open_ = open_[keys[to[open_]] > keys[open_]]
    return to


def windows(tokens: Tokens, hashes: int | range, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, function, l, c and r of the compact windows of at least `span` tokens: the Cartesian trees' nodes with that many below them.

    Such a node is the minimum of some run of `span` tokens, and its ancestors are such nodes too; so a tree is
    built over these nodes only: a node's subtree ends before the next smaller node on each side. Equal hashes rank by place.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(tokens.values) < span:
        return none, none, none, none, none
    at, text = tokens.at, tokens.text
    mask = np.uint64((1 << max(24, int(at.max()).bit_length())) - 1)  # the low bits of a key hold its place
    good = np.flatnonzero((at + span <= tokens.size[text])[: len(at) - span + 1])  # runs that end in their text
    owner, parts = text[good], []
    functions = range(hashes) if isinstance(hashes, int) else hashes
    for f, seed in zip(functions, mix(np.array(functions, dtype=np.uint64) + np.uint64(1))):
        keys = (mix(tokens.values ^ seed) & ~mask) | at.astype(np.uint64)
        least = minima(keys[None], span)[0][good]
        change = np.ones(len(good), dtype=bool)
        change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        parts.append((owner[change], np.full(int(change.sum()), f), least[change]))
    owner, function, key = (np.concatenate(x) for x in zip(*parts))
    if not len(owner):
        return none, none, none, none, none
    # a key below all others stands between two trees and at both ends
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (function[1:] != function[:-1])
    place = np.arange(len(owner)) + np.cumsum(new)
    fenced = np.zeros(place[-1] + 2, dtype=np.uint64)
    fenced[place] = np.maximum(key, np.uint64(1))
    centre = np.full(len(fenced), -1, dtype=np.int64)
    centre[place] = (key & mask).astype(np.int64)
    left = centre[smaller(fenced, -1)[place]] + 1
    right = centre[smaller(fenced, 1)[place]] - 1
    right = np.where(right == -2, tokens.size[owner] - 1, right)
    return owner, function, left, centre[place], right


def tokens_of(text: str | None, width: int) -> tuple[np.ndarray, int]:
    """Shingle hashes and the number of words."""
    words = text_words(text)
    return (shingle_hashes(words, width) if len(words) >= width else np.zeros(0, dtype=np.uint64)), len(words)


def tokens_in(batches, width: int) -> Iterator[tuple]:
    """(batch, tokens) for blocks of batches(doc_id, text); rows without a doc_id have no tokens."""
    for batch in blocks(batches, 1):
        tokens = Tokens.of(*column_words(batch.column(1)), width)
        if batch.column(0).null_count:
            tokens.size[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
        yield batch, tokens


#: Bits of a place or an extent in a window packed into one long, and tokens of a text from which on it takes two.
BITS = 20


def pack(function: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(info, more) of windows in texts of so many tokens: two longs, the second 0 but for very long texts, so that few bytes are shuffled.

    Within a text infos sort by c.
    """
    small = (size < 1 << BITS) & (function < 8)
    info = np.where(small, c << (2 * BITS + 3) | function << 2 * BITS | (c - l) << BITS | (r - c), c << 8 | function)
    return info, np.where(small, 0, (l << 31 | r) + 1)


def unpack(info: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """function, l, c and r of pack()."""
    small, low = more == 0, (1 << BITS) - 1
    c = np.where(small, info >> (2 * BITS + 3), info >> 8)
    l = np.where(small, c - (info >> BITS & low), more - 1 >> 31)
    r = np.where(small, c + (info & low), more - 1 & (1 << 31) - 1)
    return np.where(small, info >> 2 * BITS & 7, info & 255), l, c, r


#: Tokens to one side of a centre that tell windows of a frequent key apart: the key chooses the side and one of these numbers.
BESIDE = 15, 17


def beside(tokens: Tokens, text: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each window's group and the tokens to one side of its centre, and whether the text has that many there."""
    out, inside = np.zeros(len(c), dtype=np.uint64), np.zeros(len(c), dtype=bool)
    choice = (group >> np.uint64(40)) % np.uint64(2 * len(BESIDE))
    for i, n in enumerate(BESIDE):
        if len(tokens.values) < n:
            continue
        runs = run_hashes(tokens.values, n)
        for side in (0, 1):
            start = c if side else c - n + 1
            at = np.flatnonzero((choice == 2 * i + side) & (start >= 0) & (start + n <= tokens.size[text]))
            out[at] = mix(group[at] + mix(runs[tokens.begin[text[at]] + start[at]] + np.uint64(side + 1)))
            inside[at] = True
    return out, inside


def all_windows(docs: DataFrame, width: int, least: int, hashes: int | range) -> DataFrame:
    """doc_id and pack() of each compact window, its key (function and min-hash), and the first window of its group where its block has an earlier one."""
    span = least - width + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        parts, sources, total, rows = [], [], 0, 0
        names = ["key", "doc_id", "info", "more", "first_id", "first_info", "first_more"]

        def emit():
            grp, row, info, more, sub, inside = (np.concatenate(x) for x in zip(*parts))
            source = pa.chunked_array(sources).combine_chunks()
            source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
            rank = np.unique(source.fill_null(source.drop_null()[0]).to_numpy(zero_copy_only=False), return_inverse=True)[1]

            def leads(key: np.ndarray, at: np.ndarray) -> np.ndarray:
                """For each of the windows `at` the first one with its key."""
                _, group, count = np.unique(key[at], return_inverse=True, return_counts=True)
                out, several = at.copy(), np.flatnonzero(count[group] > 1)
                mine, group = at[several], group[several]
                order = np.lexsort((info[mine], rank[row[mine]], group))
                start = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else order
                out[several[order]] = mine[order[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]]
                return out

            # map-side combine: a window whose group has an earlier one in this block is tied to it here, and needs no
            # place in its group; its key for the shuffle is its own, so that a group in every block can't flood a task
            first = leads(grp, np.arange(len(grp)))
            own = first == np.arange(len(grp))
            key = np.where(own, grp, signed(mix(grp.view(np.uint64) + np.arange(1, len(grp) + 1, dtype=np.uint64))))
            # where a block has a key twice, its windows meet once more by the tokens beside them; a tie to the first with
            # these is made here too, and the first goes on under the key of both: in its own row, if it has no other use for it
            common = np.zeros(len(grp), dtype=bool)
            common[first[~own]] = True
            near = np.flatnonzero((common | ~own) & inside)
            other = leads(sub, near) if len(near) else near
            new = near[other == near]
            key[new] = np.where(own[new], key[new], sub[new])
            new, tied = new[own[new]], (other != near) & (other != first[near])
            at = np.r_[np.arange(len(grp)), new, near[tied]]
            to, alone = np.r_[first, new, other[tied]], np.r_[own, np.ones(len(new), dtype=bool), np.zeros(int(tied.sum()), dtype=bool)]
            key = np.r_[key, sub[new], signed(mix(sub[near[tied]].view(np.uint64) + np.arange(1, int(tied.sum()) + 1, dtype=np.uint64)))]
            ids = source.take(pa.array(row))
            kept = [ids.take(pa.array(to, mask=alone)), *(pa.array(x[to], mask=alone) for x in (info, more))]
            return pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(at)), pa.array(info[at]), pa.array(more[at]), *kept], names=names)

        for batch, tokens in tokens_in(batches, width):
            text, f, left, c, right = windows(tokens, hashes, span)
            if not len(text):
                continue
            group = mix(tokens.values[tokens.begin[text] + c] + f.astype(np.uint64) + np.uint64(1))
            sub, inside = beside(tokens, text, c, group)
            parts.append((signed(group), text + rows, *pack(f, left, c, right, tokens.size[text]), signed(sub), inside))
            sources.append(batch.column(0))
            total, rows = total + len(c), rows + batch.num_rows
            if total > 100_000:
                yield emit()
                parts, sources, total, rows = [], [], 0, 0
        if parts:
            yield emit()

    return in_arrow(docs.select("doc_id", "text"), run, f"key long, doc_id {kind}, info long, more long, first_id {kind}, first_info long, first_more long")


def ties(found: DataFrame) -> DataFrame:
    """Each window tied to its group's first one, and to its block's: doc_id, info, more and first_id, first_info, first_more."""
    first = F.first(F.struct("doc_id", "info", "more")).over(Window.partitionBy("key").orderBy("doc_id", "info").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("lead", first)
    firsts = F.struct(F.col("first_id").alias("doc_id"), F.col("first_info").alias("info"), F.col("first_more").alias("more"))
    moved = (F.col("lead.doc_id") != F.col("doc_id")) | (F.col("lead.info") != F.col("info"))
    new = moved & (F.col("first_id").isNull() | (F.col("lead.doc_id") != F.col("first_id")) | (F.col("lead.info") != F.col("first_info")))
    rows = rows.where(moved | F.col("first_id").isNotNull())
    rows = rows.select("doc_id", "info", "more", F.explode(F.array(F.when(F.col("first_id").isNotNull(), firsts), F.when(new, F.col("lead")))).alias("to")).where("to is not null")
    return rows.select("doc_id", "info", "more", F.col("to.doc_id").alias("first_id"), F.col("to.info").alias("first_info"), F.col("to.more").alias("first_more"))


def first_runs(key: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each place j of a run in its row (valid from low to high): rows that have a run j, and the first row with the same run."""
    reach = around.shape[1] // 2
    before, after = np.zeros((reach + 1, len(key)), dtype=np.uint64), np.zeros((reach + 1, len(key)), dtype=np.uint64)
    for i in range(reach):
        before[reach - 1 - i] = mix(before[reach - i] + around[:, reach - 1 - i].astype(np.uint64) + np.uint64(1))
        after[i + 1] = mix(after[i] + around[:, reach + i].astype(np.uint64) + np.uint64(257))
    for j in range(reach + 1):
        rows = np.flatnonzero((low <= j) & (j <= high))
        if len(rows):
            _, at, back = np.unique(mix(key[rows] + mix(before[j, rows] ^ mix(after[j, rows] + np.uint64(j)))), return_index=True, return_inverse=True)
            yield rows, rows[at[back]], j


def repeats(key: np.ndarray, ids: np.ndarray, texts: np.ndarray, place: np.ndarray, around: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of doc_id, text and place: (row, first row, a, b) of the runs of tokens a to b that an earlier row has, and which rows have a run of their own."""
    fresh = np.ones(len(key), dtype=bool)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[back] > 1)
    none = np.zeros(0, dtype=np.int64)
    if not len(shared):
        return none, none, none, none, fresh
    fresh[shared] = False
    reach, found = around.shape[1] // 2 - 1, []
    for rows, first, j in first_runs(key[shared], around[shared, 2:], around[shared, 0], around[shared, 1]):
        rows, first = shared[rows], shared[first]
        fresh[rows[rows == first]] = True
        other = (ids[rows] != ids[first]) | (texts[rows] != texts[first]) | (place[rows] != place[first])
        found.append((rows[other], first[other], np.full(int(other.sum()), j)))
    rows, first, j = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((j, rows))
    rows, first, j = rows[order], first[order], j[order]
    if not len(rows):
        return none, none, none, none, fresh
    start = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (first[1:] != first[:-1]) | (j[1:] != j[:-1] + 1)])
    stop = np.r_[start[1:], len(rows)] - 1
    a = place[rows[start]] - reach + j[start]
    return rows[start], first[start], a, place[rows[start]] - reach + j[stop] + span - 1, fresh


def run_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` tokens: a polynomial, as a difference of running sums."""
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    n = 1 << max(16, len(tokens).bit_length())  # so that few tables are made
    np.cumsum(tokens * powers(BASE, n)[: len(tokens)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(BASE, -1, 1 << 64), n)[: max(0, len(tokens) - width + 1)])


def verbatim(docs: DataFrame, width: int, least: int) -> DataFrame:
    """doc_id, text_key, a, b, first_id, first_key, shift: all runs of tokens a to b, of `least` words or more, that seem to be in an
    earlier text or place word for word, `shift` tokens on from their own place.

    A row is a half run of tokens beside a window's centre, with a byte for each of the tokens around it. Rows whose
    runs all have an earlier row in their block are settled there, so a group in every block can't flood a task.
    """
    span = least - width + 1
    half, kind = span // 2 + 1, docs.schema["doc_id"].dataType.simpleString()
    reach = span - half
    names = ["key", "doc_id", "text_key", "place", "around", "first_id", "a", "b", "first_key", "shift"]
    beside = np.r_[np.arange(reach), np.arange(reach) + reach + half] - reach

    def halves(batches):
        import pyarrow as pa

        parts, sources, total, rows = [], [], 0, 0

        def emit():
            key, row, text, place, around = (np.concatenate(x) for x in zip(*parts))
            source = pa.chunked_array(sources).combine_chunks()
            source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
            rank = np.unique(source.fill_null(source.drop_null()[0]).to_numpy(zero_copy_only=False), return_inverse=True)[1][row]
            order = np.lexsort((place, text, rank))
            key, row, text, place, around, rank = (x[order] for x in (key, row, text, place, around, rank))
            tied, first, a, b, fresh = repeats(key, rank, text, place, around, span)
            sent, n, m = np.flatnonzero(fresh), int(fresh.sum()), len(tied)
            spread = signed(mix(key[tied] + np.arange(1, m + 1, dtype=np.uint64)))
            gone = np.r_[np.ones(n, dtype=bool), np.zeros(m, dtype=bool)]
            ids = source.take(pa.array(row[np.r_[sent, tied]]))
            firsts = source.take(pa.array(np.r_[np.zeros(n, dtype=np.int64), row[first]], mask=gone))
            ends = [pa.array(np.r_[np.zeros(n, dtype=np.int64), x].astype(kind), mask=gone) for x, kind in ((a, np.int32), (b, np.int32), (text[first], np.int64), (place[first] - place[tied], np.int32))]
            whole = np.r_[sent, tied]
            columns = [pa.array(np.r_[signed(key[sent]), spread]), ids, pa.array(text[whole]), pa.array(place[whole].astype(np.int32)), binary(around[sent], m), firsts, *ends]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def binary(table: np.ndarray, nulls: int):
            """The table's rows as binary values, and nulls behind them."""
            size = table.shape[1]
            ends = np.minimum(np.arange(len(table) + nulls + 1), len(table)).astype(np.int32) * np.int32(size)
            valid = np.packbits(np.arange(len(table) + nulls) < len(table), bitorder="little")
            return pa.Array.from_buffers(pa.binary(), len(table) + nulls, [pa.py_buffer(valid.tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(table).tobytes())])

        for batch, tokens in tokens_in(batches, width):
            text, _, l, c, r = windows(tokens, 1, span)
            if not len(text):
                continue
            runs, small = run_hashes(tokens.values, half), mix(tokens.values).astype(np.uint8)
            text, l, r, place = np.r_[text, text], np.r_[l, l], np.r_[r, r], np.r_[c - half + 1, c]
            low = np.maximum(0, l - place + reach)
            high = np.minimum(reach, r - span + 1 - place + reach)
            text, place, low, high = (x[low <= high] for x in (text, place, low, high))
            here = tokens.begin[text] + place
            near = small[np.clip(here[:, None] + beside, 0, len(small) - 1)]  # what lies beyond the text is in no run of low to high
            around = np.column_stack([low.astype(np.uint8), high.astype(np.uint8), near])
            used, back = np.unique(text, return_inverse=True)
            keys = np.array([text_key(batch.column(1)[i].as_py()) for i in used.tolist()], dtype=np.int64)
            parts.append((runs[here], text + rows, keys[back], place, around))
            sources.append(batch.column(0))
            total, rows = total + len(place), rows + batch.num_rows
            if total > 50_000:
                yield emit()
                parts, sources, total, rows = [], [], 0, 0
        if parts:
            yield emit()

    def settle(batches):
        import pyarrow as pa

        for now in whole_groups(batches, ["key"]):
            done = now.filter(now.column("around").is_null())
            if done.num_rows:
                yield done.select(found)
            now = now.filter(now.column("around").is_valid())
            if not now.num_rows:
                continue
            _, ends, data = now.column("around").buffers()
            ends = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_binary(now.column("around").type) else np.int32)[now.column("around").offset :]
            around = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[now.num_rows]].reshape(now.num_rows, -1)
            ids = np.unique(now.column("doc_id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            place = now.column("place").to_numpy().astype(np.int64)
            rows, first, a, b, _ = repeats(now.column("key").to_numpy().view(np.uint64), ids, now.column("text_key").to_numpy(), place, around, span)
            if len(rows):
                mine, theirs = pa.array(rows), pa.array(first)
                ends = [pa.array(x.astype(np.int32)) for x in (a, b, place[first] - place[rows])]
                columns = [now.column("doc_id").take(mine), now.column("text_key").take(mine), ends[0], ends[1], now.column("doc_id").take(theirs), now.column("text_key").take(theirs), ends[2]]
                yield pa.RecordBatch.from_arrays(columns, names=found)

    found = ["doc_id", "text_key", "a", "b", "first_id", "first_key", "shift"]
    rows = in_arrow(docs.select("doc_id", "text"), halves, f"key long, doc_id {kind}, text_key long, place int, around binary, first_id {kind}, a int, b int, first_key long, shift int")
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "text_key", "place")
    return in_arrow(rows, settle, f"doc_id {kind}, text_key long, a int, b int, first_id {kind}, first_key long, shift int")


#: Tokens at each end of a verbatim run that are compared one by one; those between are compared by one hash.
ENDS = 4


def verified(runs: DataFrame, docs: DataFrame, width: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of verbatim(): passages as in repeated_passages(), compared token by token with what the earlier text has there; and what is left
    for the near way, as candidates(), since the inner tokens differ.

    A run's halves are found by a 64-bit hash and the tokens around by a byte each, so one in 256 runs seems a token longer
    than it is. Runs are merged, then both texts are asked once for each stretch's tokens at its ends and for a hash of the
    others: a text never travels, and a stretch of the earlier text that many later ones have is asked for once.
    """
    span, key = least - width + 1, ["doc_id", "text_key"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    pair = [*key, "first_id", "first_key", "shift"]
    whole = (F.col("text_key") == F.col("first_key")) & (F.col("shift") == 0) & (F.col("doc_id") != F.col("first_id"))

    def joined(*row):
        for a, b in merge([(s["a"], s["b"]) for s in row[-1]]):
            yield *row[:-1], a, b

    stretches = runs.groupBy(*pair).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    stretches = arrow_map(stretches, [*pair, "spans"], joined, f"doc_id {kind}, text_key long, first_id {kind}, first_key long, shift int, a int, b int")
    stretches = scratch.keep(stretches.select("*", (F.col("a") + F.col("shift")).alias("at"), (F.col("b") - F.col("a") + 1).alias("n")), "stretches")
    same = stretches.where(whole)  # copies of a whole text
    rest = stretches.where(~whole)
    asked = rest.select(*key, F.col("a").alias("at"), "n").unionByName(rest.select(F.col("first_id").alias("doc_id"), F.col("first_key").alias("text_key"), "at", "n")).distinct()
    asked = scratch.keep(asked.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("asked")), "asked")
    texts = semi_by_size(docs.select("doc_id", "text"), asked.select("doc_id").distinct(), "doc_id").withColumn("text_key", F.xxhash64("text"))
    texts = texts.join(asked, key).dropDuplicates(key)

    def answer(batches):
        """All stretches that a text is asked for together."""
        import pyarrow as pa

        for batch in blocks(batches, 2):
            words, offsets = column_words(batch.column(2))
            tokens = Tokens.of(words, offsets, width)
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            row, wanted = np.repeat(np.arange(batch.num_rows), size), lists.flatten()
            at, n = (wanted.field(i).to_numpy().astype(np.int64) for i in range(2))
            begin = tokens.begin[row] + at
            m = 1 << max(16, len(tokens.values).bit_length())  # so that few tables are made
            sums = np.zeros(len(tokens.values) + 1, dtype=np.uint64)
            np.cumsum(tokens.values * powers(BASE, m)[: len(tokens.values)], out=sums[1:])
            inner = mix((sums[begin + n - ENDS] - sums[begin + ENDS]) * powers(pow(BASE, -1, 1 << 64), m)[begin + ENDS])
            ends = [tokens.values[begin + i] for i in range(ENDS)] + [tokens.values[begin + n - ENDS + i] for i in range(ENDS)]
            seen = [pa.array(signed(x)) for x in (*ends, inner)]
            keys = [batch.column(i).take(pa.array(row)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), *seen], names=[*key, "at", "n", *facts])

    facts = [f"t{i}" for i in range(2 * ENDS)] + ["inner"]
    known = in_arrow(texts.select(*key, "text", "asked"), answer, f"doc_id {kind}, text_key long, at int, n int, " + ", ".join(f"{f} long" for f in facts))
    known = scratch.keep(known, "answers")
    mine = known.select(*key, F.col("at").alias("a"), "n", F.struct(*facts).alias("mine"))
    theirs = known.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), "at", "n", F.struct(*facts).alias("theirs"))
    both = rest.join(mine, [*key, "a", "n"]).join(theirs, ["first_id", "first_key", "at", "n"])
    differs = lambda i: F.col(f"mine.{facts[i]}") != F.col(f"theirs.{facts[i]}")
    lead = F.greatest(*(F.when(differs(i), i + 1).otherwise(0) for i in range(ENDS)))
    trail = F.greatest(*(F.when(differs(2 * ENDS - 1 - i), i + 1).otherwise(0) for i in range(ENDS)))
    both = scratch.keep(both.select(*pair, "a", "b", "at", "n", lead.alias("lead"), trail.alias("trail"), differs(2 * ENDS).alias("inner")), "compared")
    good = both.where(~F.col("inner") & (F.col("n") - F.col("lead") - F.col("trail") >= span)).withColumns({"a": F.col("a") + F.col("lead"), "b": F.col("b") - F.col("trail")})
    passages = same.select(*key, "a", "b", "first_id").unionByName(good.select(*key, "a", "b", "first_id"))
    passages = passages.select(*key, F.col("a").alias("first_word"), (F.col("b") + width - 1).alias("last_word"), "first_id")
    left = both.where("inner").select("doc_id", "first_id", F.col("a").alias("l"), F.col("b").alias("r"), F.col("at").alias("fl"), (F.col("at") + F.col("n") - 1).alias("fr"), "shift")
    return passages, left


def candidates(pair: np.ndarray, ties: np.ndarray, span: int, agree: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Rows (pair, l, r, fl, fr, shift) of intervals in which at least `agree` ties of a pair of texts overlap.

    pair: a number for each tie; ties: rows l, c, r, fl, fc, fr and function. Ties overlap if one subsequence can lie in
    all: c is within reach of those before. They are taken by the shift between the two centres, then by place: those of
    one passage have nearly one shift, edits apart. A block of words that only one text has changes the shift by its
    length, which may be as much as similarity leaves room for in the ties' windows; so ties are taken twice, with shifts
    close to each other and with shifts as far apart as that. Ties count by function and centre.
    """
    shift = ties[4] - ties[1]
    order = np.lexsort((ties[1], shift, pair))
    pair, shift, (l, c, r, fl, _, fr, f) = pair[order], shift[order], ties[:, order]
    new, step = pair[1:] != pair[:-1], np.diff(shift)
    size = np.minimum(r - l, fr - fl)
    room = (1 / similarity - 1) * np.maximum(size[1:], size[:-1])
    out = []
    for most in (GAP, np.maximum(GAP, room)):
        group = np.r_[0, np.cumsum(new | (step > most))]
        place = np.lexsort((f, c, group))
        g, a, b = group[place], c[place], f[place]
        wide = int(r.max()) + 2
        reach = np.maximum.accumulate(r[place] + g * wide) - g * wide
        fresh = np.r_[True, (g[1:] != g[:-1]) | (a[1:] > reach[:-1])]
        start = np.flatnonzero(fresh)
        count = np.add.reduceat(np.r_[True, fresh[1:] | (a[1:] != a[:-1]) | (b[1:] != b[:-1])].astype(np.int64), start)
        low, flow = (np.minimum.reduceat(x[place], start) for x in (l, fl))
        high, fhigh = (np.maximum.reduceat(x[place], start) for x in (r, fr))
        run = np.cumsum(fresh) - 1
        middle = start + np.diff(np.r_[start, len(place)]) // 2
        mean = shift[place][np.lexsort((shift[place], run))][middle]
        rows = np.stack([pair[place][start], low, high, flow, fhigh, mean])
        out.append(rows[:, (count >= agree) & (high - low + 1 >= span)])
    return np.unique(np.concatenate(out, axis=1), axis=1)


class Matcher:
    """Finds a text's tokens in an earlier one; the earlier text's order can be used again."""

    def __init__(self, theirs: np.ndarray):
        self.theirs = theirs
        self.order = np.argsort(theirs, kind="stable")
        self.ranked = theirs[self.order]
        self.wide = len(theirs) + 1
        self.run = np.searchsorted(self.ranked, self.ranked, "left") * self.wide + self.order  # sorted: by token, then by place

    def take(self, mine: np.ndarray) -> None:
        self.mine = mine
        self.lo, self.hi = (np.searchsorted(self.ranked, mine, side) for side in ("left", "right"))

    def stretches(self, l: int, r: int, fl: int, fr: int, shift: int, own: bool, span: int, similarity: float) -> Iterator[tuple[int, int]]:
        """Stretches [a, b] of tokens in l to r that repeat a stretch of fl to fr: both ends common, and similar enough.

        A common token is matched with the place nearest to its own plus the shift. Within one text (`own`) only
        earlier places count. A stretch is tested whole. If it fails it is parted at all gaps that no similar stretch
        of it can have, since they hold too many tokens that are not common; or else at its widest.
        """
        if r - l + 1 < span:
            return
        here, lo, hi = np.arange(l, r + 1), self.lo[l : r + 1], self.hi[l : r + 1]
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        here, lo, hi = here[found], lo[found], hi[found]
        aim = np.minimum(here + shift, here - 1) if own else here + shift
        goal = np.clip(aim, fl, fr)
        at = np.searchsorted(self.run, lo * self.wide + goal, "right") - 1
        p, q = self.order[np.maximum(at, 0)], self.order[np.minimum(at + 1, len(self.order) - 1)]
        below = (at >= lo) & (p >= fl)
        above = (at + 1 < hi) & (q <= fr)
        if own:
            above &= q < here
            below &= p < here
        closer = above & (~below | (np.abs(q - aim) < np.abs(p - aim)))
        hit, where = here, np.where(closer, q, p)
        good = below | above
        hit, where = hit[good], where[good]
        if not len(hit):
            return
        pending, between = [np.arange(len(hit))], None
        while pending:
            part = pending.pop()
            a, b = int(hit[part[0]]), int(hit[part[-1]])
            if b - a + 1 < span:
                continue
            x, y = set(self.mine[a : b + 1].tolist()), set(self.theirs[where[part].min() : where[part].max() + 1].tolist())
            common = len(x & y)
            if common >= similarity * (len(x) + len(y) - common):
                yield a, b
            elif len(part) > 1:
                if between is None:
                    mine, theirs = self.mine[l : r + 1], self.theirs[fl : fr + 1]
                    alone = [np.r_[0, np.cumsum(z)] for z in only_in(mine, theirs)]
                    between = np.maximum(np.diff(alone[0][hit - l]), np.abs(np.diff(alone[1][where - fl])))
                    width = np.diff(hit) + np.abs(np.diff(where))
                cut = np.flatnonzero(between[part[:-1]] > (1 / similarity - 1) * len(part)) + 1
                cut = cut if len(cut) else [int(np.argmax(width[part[:-1]])) + 1]
                pending += np.split(part, cut)[::-1]


def only_in(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each: whether a token is not in the other and is its first occurrence."""
    n, both = len(mine), np.r_[mine, theirs]
    order = np.argsort(both, kind="stable")
    if not n or n == len(both):  # one is empty
        return tuple(np.isin(np.arange(len(x)), np.unique(x, return_index=True)[1]) for x in (mine, theirs))
    start = np.flatnonzero(np.r_[True, both[order[1:]] != both[order[:-1]]])
    first, last = order[start], order[np.r_[start[1:], len(both)] - 1]
    alone = np.zeros(len(both), dtype=bool)
    alone[first[(first >= n) | (last < n)]] = True
    return alone[:n], alone[n:]


def meeting(span: int, agree: int, similarity: float):
    """Candidates of ties sorted by the two texts, some pairs at a time: most have fewer than `agree` ties and are passed over."""

    def run(batches):
        import pyarrow as pa

        for batch in whole_groups(batches, ["doc_id", "first_id"]):
            ids, firsts = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "first_id"))
            pair = np.r_[0, np.cumsum((ids[1:] != ids[:-1]) | (firsts[1:] != firsts[:-1]))]
            many = np.bincount(pair)[pair] >= agree
            info, more, first_info, first_more = (batch.column(n).to_numpy()[many] for n in ("info", "more", "first_info", "first_more"))
            if not len(info):
                continue
            function, *mine = unpack(info, more)
            ties = np.stack([*mine, *unpack(first_info, first_more)[1:], function])
            number, *found = candidates(pair[many], ties, span, agree, similarity)
            at = pa.array(np.searchsorted(pair, number))
            columns = [batch.column("doc_id").take(at), batch.column("first_id").take(at), *(pa.array(x.astype(np.int32)) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first_id", "l", "r", "fl", "fr", "shift"])

    return run


def checking(width: int, span: int, similarity: float, schema):
    """Passages of candidates, verified on the texts. The texts of a block of pairs are hashed together; rows come in order of the earlier text."""

    def of_pair(key, first, found, text, first_text, mine, matcher):
        if key == first and text_key(text) < text_key(first_text):
            return
        own, marked = key == first and text == first_text, []
        matcher.take(mine)
        for h in sorted(found, key=lambda h: h["l"] - h["r"]):
            l, r, fl, fr = h["l"], min(h["r"], len(mine) - 1), h["fl"], min(h["fr"], len(matcher.theirs) - 1)
            if l <= r and fl <= fr and not any(a <= l and r <= b for a, b in marked):
                marked = merge([*marked, *matcher.stretches(l, r, fl, fr, h["shift"], own, span, similarity)])
        for a, b in marked:
            yield key, text_key(text), a, b + width - 1, first

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, last = to_arrow_schema(schema), [None, None]
        for batch in blocks(batches, 3):
            (keys, ids), texts, firsts = (batch.column(c).to_pylist() for c in range(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            rest, new, out = [], [], []
            for i, (key, first, text) in enumerate(zip(keys, ids, texts)):
                if key != first and text == firsts[i]:  # a whole copy
                    out.append((key, text_key(text), 0, word_count(text) - 1, first))
                else:
                    if firsts[i] != (firsts[rest[-1]] if rest else last[0]):
                        new.append(i)
                    rest.append(i)
            tokens, theirs = (Tokens.of(*column_words(batch.column(c).take(pa.array(at, pa.int64()))), width) for c, at in ((3, rest), (4, new)))
            fresh = iter(range(len(new)))
            for n, (i, found) in enumerate(zip(rest, batch.column(2).take(pa.array(rest, pa.int64())).to_pylist())):
                if firsts[i] != last[0]:
                    j = next(fresh)
                    last[:] = firsts[i], Matcher(theirs.values[theirs.begin[j] : theirs.begin[j] + theirs.size[j]])
                mine = tokens.values[tokens.begin[n] : tokens.begin[n] + tokens.size[n]]
                out += of_pair(keys[i], ids[i], found, texts[i], firsts[i], mine, last[1])
            if out:
                yield to_batch(out, target)

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, least: int = LEAST, similarity: float = SIMILARITY, hashes: int = HASHES, agree: int = AGREE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_key, first_word, last_word (of docs(doc_id, text), from 0) and first_id: passages that repeat an earlier one.

    Earlier means a smaller doc_id, or a smaller place in one text. text_key is a hash that tells rows of one doc_id apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    exact, left = verified(scratch.keep(verbatim(docs, width, least), "verbatim"), docs, width, least, scratch)
    span = least - width + 1
    # one half of the functions after the other: the windows of both are never on disk together
    halves = [h for h in (range(hashes // 2), range(hashes // 2, hashes)) if len(h)]
    halves = [scratch.keep(ties(all_windows(docs, width, least, h)), "ties") for h in halves]
    tied = reduce(DataFrame.unionByName, halves)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = in_arrow(tied.repartition("doc_id").sortWithinPartitions("doc_id", "first_id"), meeting(span, agree, similarity), f"doc_id {kind}, first_id {kind}, l int, r int, fl int, fr int, shift int")
    hits = scratch.keep(hits.unionByName(left), "candidates")
    scratch.drop(*halves)
    ids = hits.select("doc_id").unionByName(hits.select(F.col("first_id").alias("doc_id"))).distinct()
    texts = scratch.keep(semi_by_size(docs.select("doc_id", "text"), scratch.keep(ids, "ids"), "doc_id").distinct(), "texts")
    ranges = hits.groupBy("doc_id", "first_id").agg(F.collect_list(F.struct("l", "r", "fl", "fr", "shift")).alias("hits"))
    pairs = ranges.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first_text")), "first_id")

    schema = f"doc_id {kind}, text_key long, first_word int, last_word int, first_id {kind}"
    pairs = pairs.select("doc_id", "first_id", "hits", "text", "first_text")
    near = in_arrow(pairs, checking(width, span, similarity, pairs.sparkSession.createDataFrame([], schema).schema), schema)
    found = near.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_word", "last_word", "first_id", "exact")).alias("spans"))

    def tidy(key, text, spans):
        """Passages by first text; verbatim ones only where they add words."""
        by: dict = {}
        for s in spans:
            by.setdefault((s["exact"], s["first_id"]), []).append((s["first_word"], s["last_word"]))
        known: list[tuple[int, int]] = []
        for exact, first in sorted(by):
            for a, b in merge(by[exact, first]) if exact else sorted(by[exact, first]):
                if exact and any(x <= a and b <= y for x, y in known):
                    continue
                yield key, text, a, b, first
            known = merge(known + by[exact, first])

    return arrow_map(found, ["doc_id", "text_key", "spans"], tidy, schema)


def text_key(text: str) -> int:
    """What Spark's xxhash64(text) gives."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)).astype(np.int64))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of closed intervals as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of closed spans and the white space behind each span."""
    import re

    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    for a, b in merge(spans):
        if a >= len(words):
            break
        stop = words[b + 1][0] if b + 1 < len(words) else len(raw)
        out.append(raw[at : words[a][0]])
        at = stop
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
