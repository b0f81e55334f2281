"""The opN_ queries, each applying one operator to its whole table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import balltree, bpe, chat, kdtree, langid, lexical, minhash, mixing, ngramjoin, quality, substring, toxicity, warc
from peptrail.llm.common import WORD, Scratch

CATEGORIES = ["low_quality", "toxic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of low_quality (quality = 0), then toxic, trained on labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.classify(docs, toxicity.train(docs, labels, CATEGORIES))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("cid", "component")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.digests(rows.unionByName(planted))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, scratch)
    back = warc.read_archives(spark, path, scratch)
    return back.select(
        F.expr("try_cast(regexp_extract(id, '^<urn:page:(-?[0-9]+|null):', 1) AS bigint)").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr("try_cast(regexp_extract(refers, '^<urn:page:(-?[0-9]+|null):', 1) AS bigint)").alias("refers_to"),
    )


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return balltree.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_substring_dedup, op4_byte_bpe, op5_minhash_near_dedup, op6_mixing, op7_exact_top_k,
        op8_language_id, op9_chat_format, op10_warc, op11_ngram_jaccard_join, op12_hard_negatives, op13_lexical_search,
    )
}

#: Capitals of ASCII and their small letters, for translate().
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GUARDED = "length(replace({0}, '\\', '\\\\'))" + "".join(f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
_OK = "'</s>[INST] ok [/INST]'"
_DIGIT = "substr('{}', CAST((v // {}) % 32 + 1 AS BIGINT), 1)"
_BASE32 = "list_aggregate(list_transform(range(8), lambda i: list_extract(list_transform([('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT], lambda v: " + " || ".join(_DIGIT.format(warc.BASE32, 32**k) for k in (3, 2, 1, 0)) + "), 1)), 'string_agg', '')"


def _linked(width: int, percent: int, more: str = "") -> str:
    """Documents linked by a Jaccard similarity of their sets of shingles, and what they reach."""
    return f"""
        WITH RECURSIVE listed AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{WORD}') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END AS s
            FROM listed
        ), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
        ), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reached AS (
            SELECT DISTINCT a AS node, a AS other FROM links
            UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
        ), least AS (SELECT node, min(other) AS other FROM reached GROUP BY node)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(other, doc_id) AS component_id{more}
        FROM sets LEFT JOIN least ON node = doc_id
    """


#: What DuckDB can express. The others (1 to 4, 6 and 8) are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": _linked(4, 80, ", coalesce(other, doc_id) = doc_id AS kept"),
    "op11_ngram_jaccard_join": _linked(3, 90),
    "op9_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', {_OK} UNION ALL SELECT -7, 1, 'assistant', {_OK}
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(13 + CASE WHEN role = 'user' THEN 13 ELSE 0 END + {_GUARDED.format("role")} + {_GUARDED.format("text")}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op10_warc": f"""
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), placed AS (
            SELECT page_id, h, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY h) AS most, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS r FROM payloads
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN most END AS refers_to
        FROM placed
    """,
    "op7_exact_top_k": """
        WITH usable AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same)
            WHERE r <= 5
        ), negatives AS (
            SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS r
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
            WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        )
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE r <= 10
    """,
    "op13_lexical_search": f"""
        WITH listed AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_TERM}') AS terms FROM documents
        ), docs AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM listed WHERE len(terms) > 0
        ), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs
        ), held AS (SELECT doc_id, n, unnest(terms) AS term FROM docs
        ), counts AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term
        ), items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_TERM}')) AS term FROM benchmark
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
            FROM items JOIN counts USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0
        )
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50
    """,
}
