"""Shared folder handling, Arrow helpers and hashing used by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.sources.scratch import Scratch, delete, shared_folder, small_enough

__all__ = ["Scratch", "delete", "shared_folder", "small_enough"]

WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


#: Bytes of a batch of rows on its way to Python, where the session does not set them: Spark's own limit is 10,000 rows of any length.
BATCH = "4m"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches bounded in bytes, so that long texts take no more memory than short ones, outside the heap and in Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH)
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, columns: list[str], rows: Callable[..., Iterator[tuple]], schema: str, flush: int = 4096, flush_bytes: int = 8 << 20) -> DataFrame:
    """Run rows(*values) -> tuples for each row of df, in Arrow batches of bounded size.

    Reads only the named columns. Emits a batch after `flush` output rows or about
    `flush_bytes` of output, so one very long text can't grow a batch without bound.
    """
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, buffer, weight = to_arrow_schema(out), [], 0
        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                for row in rows(*values):
                    buffer.append(row)
                    weight += 64 + sum(len(v) * (1 if isinstance(v, (str, bytes)) else 8) for v in row if hasattr(v, "__len__"))
                    if len(buffer) >= flush or weight >= flush_bytes:
                        yield to_batch(buffer, target)
                        buffer, weight = [], 0
        if buffer:
            yield to_batch(buffer, target)

    return in_arrow(df.select(*columns), run, out)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_holder: list[Callable[[], None]] = []


def _nothing() -> None:
    """The cache of a stage that has none."""


def hold(clear: Callable[[], None]) -> None:
    """Workers are used again by other stages: whoever fills a cache in one first empties the cache of the stage before."""
    if not _holder or _holder[0] is not clear:
        if _holder:
            _holder.pop()()
        _holder.append(clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (the splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of `width` words; of the whole sequence if it is shorter."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(out) + i]
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(width))


#: The base of polynomials modulo 2^64 (a fixed value).
BASE = 0x5851F42D4C957F2D


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def solid_bytes(gaps) -> np.ndarray:
    """Which bytes of UTF-8 make words: all but the given ones."""
    out = np.ones(256, dtype=bool)
    out[list(gaps)] = False
    return out


WHITE = solid_bytes([0x20, *range(0x09, 0x0E)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words hashed at once, and bytes of a word from which on it is hashed by itself.
SLICE, LONG = 1 << 16, 512


def hash_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + size] (data has 8 bytes more at its end): eight bytes at a time are mixed into what the bytes before have given.

    Slices of up to eight bytes differ in hash if they differ and are of one size; those of over LONG bytes get a BLAKE2 digest.
    """

    data = np.ascontiguousarray(data)
    loads = np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data.data, strides=(1,))  # eight bytes from each place on

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return loads[at].astype(np.uint64, copy=False) & _KEEP[np.minimum(left, 8)]

    out = mix(mix(eight(start, size)) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, done = np.flatnonzero(size > 8), 8
    while len(more) and done < LONG:
        before = out[more]
        out[more] = mix((before << np.uint64(23) | before >> np.uint64(41)) + mix(eight(start[more] + done, size[more] - done)))
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of texts' words (runs of solid bytes, A-Z in lower case), and where each text's words begin, and the end.

    data: the texts' bytes one behind the other; offsets: where each begins, and the end.
    """
    inside = solid[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    inside[:-1] &= ~inside[1:] | first[1:]  # now the last byte of each word
    size = np.flatnonzero(inside) + 1 - start
    folded = np.r_[_FOLD[data], np.zeros(8, dtype=np.uint8)]
    out = np.empty(len(start), dtype=np.uint64)
    for at in range(0, len(start), SLICE):
        out[at : at + SLICE] = hash_slices(folded, start[at : at + SLICE], size[at : at + SLICE])
    return out, np.searchsorted(start, offsets)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts (null: none) one behind the other, and where each begins, and the end."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def column_words(column: pa.Array, solid: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """hash_words of a string column: the hashes of all words, and where each row's begin, and the end."""
    return hash_words(*column_bytes(column), solid)


def word_count(text: str) -> int:
    """How many words text_words() gives."""
    inside = WHITE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def text_words(text: str | None, solid: np.ndarray = WHITE) -> np.ndarray:
    """hash_words of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return hash_words(raw, np.array([0, len(raw)]), solid)[0]


def blocks(batches: Iterable[pa.RecordBatch], at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of about `size` bytes of the text column at `at`, so that a batch of long texts needs no more memory than others."""
    hold(_nothing)
    for batch in batches:
        _, ends = column_bytes(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by keys, dealt anew so that no group of equal keys is torn."""
    pending: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pending[0] if len(pending) == 1 else pa.Table.from_batches(pending).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        same = pending and all(pending[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut or not same:
            if cut:
                pending.append(batch.slice(0, cut))
            if pending:
                yield joined()
            pending = []
        pending.append(batch.slice(cut))
    if pending:
        yield joined()


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def semi_by_size(df: DataFrame, ids: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """Rows of df whose key is in ids: a broadcast up to `rows` ids (8 bytes each), a shuffled join beyond."""
    return df.join(F.broadcast(ids) if small_enough(ids, rows) else ids, key, "left_semi")
