"""The pipeline against a brute-force version of each stage on planted documents."""

import base64
import hashlib
import random
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline

RNG = random.Random(21)
SYLLABLES = {"en": ["the", "ing", "and", "tion", "her", "wh"], "fr": ["eau", "oui", "ell", "ment", "ière", "que"]}


def prose(lang, n):
    return ["".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rows, i = [], 0
    for lang in ("en", "fr"):
        for _ in range(60):
            rows.append((i, prose(lang, RNG.choice([60, 130])), lang, "hot" if i % 3 else f"s{i % 4}"))
            i += 1
    passage = prose("en", 70)
    near = list(rows[5][1])
    near[10] = "other"
    more = [list(rows[3][1]), near, prose("en", 30) + passage + prose("en", 30), prose("en", 40) + passage, passage, ["12", "!?", "$"], []]
    for words in more:
        rows.append((i, words, "en", "s1"))
        i += 1
    out = [(k, " ".join(w), lang, source, len(" ".join(w))) for k, w, lang, source in rows]
    return out + [(i, None, "en", None, None), (i + 1, out[20][1].upper(), None, None, 0), out[7]]


def test_stages(spark, planted, tmp_path):
    docs = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "near duplicates", "repeated passages", "mixing", "encoding"]

    kept = stages["language ID"](spark, docs, str(tmp_path)).cache()
    lost = {r[0] for r in planted} - {r["doc_id"] for r in kept.collect()}
    assert lost == {r[0] for r in planted if not any(c.isalpha() for c in r[1] or "")}

    unique = stages["near duplicates"](spark, kept, str(tmp_path)).cache()
    assert unique.columns == names
    want = {r["doc_id"]: r["text"] for r in kept.collect()}
    sets = {k: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in want.items()}
    for a, b in sorted(combinations(sorted(sets), 2)):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            want.pop(b, None)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(want)

    cut = stages["repeated passages"](spark, unique, str(tmp_path)).cache()
    assert cut.columns == names
    seen, left = set(), {}
    for k in sorted(want):
        words = want[k].split()
        grams = [tuple(w.lower() for w in words[j : j + 50]) for j in range(len(words) - 49)]
        gone = {j + d for j, g in enumerate(grams) if g in seen for d in range(50)}
        seen.update(grams)
        if rest := [w for j, w in enumerate(words) if j not in gone]:
            left[k] = " ".join(rest)
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in cut.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] != want[r["doc_id"]])

    mixed = stages["mixing"](spark, cut, str(tmp_path)).cache()
    assert mixed.columns == names
    from peptrail.llm import mixing

    times = {r["doc_id"]: r["copies"] for r in mixing.mix(cut).collect()}
    got = {}
    for r in mixed.collect():
        assert r["text"].split() == left[r["doc_id"]].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in times.items() if v}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    encoded = stages["encoding"](spark, mixed, str(tmp_path)).collect()
    assert len(encoded) == mixed.count()
    for r in encoded:
        assert list(r["ids"]) == bpe.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)


def test_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(4)
    a, b, c, d, e = ([rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(90)] for _ in range(5))
    near = lambda words: [*words[:-1], "other"]
    texts = [(1, a), (1, b), (1, a), (1, near(a)), (2, near(b)), (2, c), (3, near(c)), (3, c), (4, d), (None, near(d)), (None, e), (None, near(e)), (None, e), (None, []), (5, []), (5, [])]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"][:40]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted([(i or 0, " ".join(w)[:40]) for i, w in ((1, a), (1, b), (2, c), (4, d), (None, e), (None, []), (5, []))])  # one row of each group: a row without a doc_id goes where another has one


def test_odd_tables(spark, tmp_path):
    extra = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, cid int, component_id int"
    rows = [(1, "some words here to keep", "en", None, 1, "a", "b", 2, 3), (1, "some words here to keep", "en", None, 1, "a", "b", 2, 3), (None, "null id text", "en", "s", 1, None, None, None, None), (2, None, None, None, None, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, extra)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(str(tmp_path / f"{len(data)}-{i}"))
            docs = stage(spark, spark.read.schema(docs.schema).parquet(str(tmp_path / f"{len(data)}-{i}")), str(tmp_path))
            if i < 4:
                assert docs.columns == [c.split()[0] for c in extra.split(", ")]
        # the null text goes, one of two equal rows stays, and the two sources' documents are taken 0 or 1, and 1 or 2 times
        found = [(r["doc_id"], r["n_tokens"]) for r in docs.collect()]
        assert set(found) <= {(1, 5), (None, 3)} and (1 <= found.count((None, 3)) <= 2 and found.count((1, 5)) <= 1 if data else not found)
