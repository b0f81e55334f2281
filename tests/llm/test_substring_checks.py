"""Candidate pairs of op3: whole copies are told by their words' number, and gaps by one sort of both texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql.types import IntegerType, LongType, StructType

from peptrail.llm import substring as S
from peptrail.llm.common import text_words, word_count


def test_whole_copies_are_not_hashed(monkeypatch):
    monkeypatch.setattr(S, "Matcher", None)
    monkeypatch.setattr(S, "column_words", lambda c: (_ for _ in ()).throw(AssertionError) if len(c) else (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)))
    schema = StructType()
    for name, kind in (("doc_id", LongType()), ("text_key", LongType()), ("first_word", IntegerType()), ("last_word", IntegerType()), ("first_id", LongType())):
        schema = schema.add(name, kind)
    text = " ".join(f"w{i}" for i in range(70))
    hit = [{"l": 0, "r": 65, "fl": 0, "fr": 65, "shift": 0}]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([1, 1]), pa.array([hit, hit]), pa.array([text] * 2), pa.array([text] * 2)], names=["doc_id", "first_id", "hits", "text", "first_text"])
    (out,) = S.checking(5, 46, 0.8, schema)([batch])
    assert [tuple(r.values()) for r in out.to_pylist()] == [(i, S.text_key(text), 0, 69, 1) for i in (7, 8)]


def test_only_in_is_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        mine, theirs = (rng.integers(0, 12, rng.integers(0, 15)).astype(np.uint64) for _ in range(2))
        for got, a, b in zip(S.only_in(mine, theirs), (mine, theirs), (theirs, mine)):
            assert got.tolist() == [x not in b and x not in a[:i] for i, x in enumerate(a)]


def test_words_are_counted_as_they_are_hashed():
    for text in ("", " ", "a", " a\tb\n", "é\x0bü ", "x" * 600 + " y"):
        assert word_count(text) == len(text_words(text))
