"""The corpus pipeline: language ID, near-duplicate removal, passage removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
`documents`. run() writes each stage's result to the shared folder and reads it again, so a lost executor never
costs more than one stage.

Defined cases: rows without a doc_id take part in every stage (in that of repeated passages they neither give nor lose any);
texts are judged whole, however long; an empty table gives an empty result; further columns pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from peptrail.llm import bpe, langid, minhash, mixing, substring
from peptrail.llm.common import Scratch, arrow_map, blocks, in_arrow, small_enough
from peptrail.llm.queries import held_out

#: Least share of a text's letters that its language must have.
LEAST_SHARE = 0.5
WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts of one main language; null texts, texts without letters and mixtures without a main language go.

    One pass: the text is labelled and filtered where it is read, so nothing is shuffled.
    """
    model = spark.sparkContext.broadcast(langid.train(docs.where(~held_out(F.col("doc_id")))))
    names = docs.columns
    at = names.index("text")

    def keep(batches):
        import pyarrow as pa

        tag = langid.tagger(model.value)
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                lang, share = tag.predict(text)
                good.append(lang != langid.UND and share >= LEAST_SHARE)
            yield batch.filter(pa.array(good, pa.bool_()))

    return in_arrow(docs, keep, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8); wordless texts stay.

    Rows that repeat a doc_id are judged by their own texts: of each group one row stays. Rows without a doc_id go if their
    group has one; of a group of such rows only, one stays.
    """
    scratch, inner = Scratch(spark, "pipeline"), Scratch(spark, "minhash")
    found = scratch.keep(minhash.near_duplicates(docs, width=WORDS, scratch=inner).select("doc_id", "cid", "component", "component_id", "kept"), "judged")
    inner.close()
    again = scratch.keep(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__again")), "again")
    gone = scratch.keep(found.where("not kept").select(F.col("doc_id").alias("__gone")).unionByName(again.select(F.col("__again").alias("__gone"))).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    once = docs.join(few, docs["doc_id"] == few["__gone"], "left_anti").select(*docs.columns)
    if not found.where("doc_id is null").isEmpty():
        alone = found.where("doc_id is null and component_id is null and cid is not null").select("doc_id", "cid", "component", F.lit(True).alias("kept"))
        once = once.where("doc_id is not null").unionByName(one_of_each(docs.where("doc_id is null"), alone))  # wordless ones count as one text
    if again.isEmpty():
        return once
    return once.unionByName(one_of_each(docs.join(again, docs["doc_id"] == again["__again"], "left_semi").select(*docs.columns), found.join(again, F.col("doc_id") == F.col("__again"), "left_semi")))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows that repeat a doc_id (or have none), one for each kept group of near duplicates, and one for each wordless text."""
    least = found.where("kept and cid is not null").groupBy(F.col("doc_id").alias("__id"), "component").agg(F.min("cid").alias("__class"))
    names = docs.columns
    at = names.index("text")

    def classes(batches):
        import pyarrow as pa

        for batch in blocks(batches, at):
            sets = minhash.text_sets(batch.column(at), WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([minhash.set_id(s) if len(s) else None for s in sets], pa.int64())], names=[*names, "__cid"])

    rows = in_arrow(docs, classes, StructType([*docs.schema.fields, StructField("__cid", LongType())]))
    # the least text of each group; a group is reduced where its rows are, so that one of any size floods no task
    rest = [c for c in names if c not in ("doc_id", "text")]
    rows = rows.groupBy("doc_id", "__cid", F.when(F.col("__cid").isNull(), F.col("text")).alias("__text")).agg(F.min(F.struct("text", *rest)).alias("__row"))
    rows = rows.select("doc_id", "__cid", "__row.*")
    same = rows["doc_id"].eqNullSafe(least["__id"]) & (rows["__cid"] == least["__class"])
    return rows.where("__cid is null").select(*docs.columns).unionByName(rows.join(least, same, "left_semi").select(*docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that repeat an earlier text's; n_chars follows, texts without a word left go."""
    scratch, inner = Scratch(spark, "pipeline"), Scratch(spark, "passages")
    found = substring.repeated_passages(docs, scratch=inner).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("__spans"))
    found = scratch.keep(found, "cuts")
    inner.close()
    keys = found.select("__id", "__key")
    keys = F.broadcast(keys) if small_enough(keys, 500_000) else keys  # 16 bytes each
    same = (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    touched = docs.join(keys, same, "left_semi")
    touched = touched.join(found, (touched["doc_id"] == F.col("__id")) & (F.xxhash64(touched["text"]) == F.col("__key")))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]

    def cut(text, spans, *rest):
        text = substring.without(text, [(s["first_word"], s["last_word"]) for s in spans])
        if text.encode("utf-8", "surrogatepass").split():
            yield text, len(text), *rest

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields.get(c, 'bigint')}" for c in ("text", "n_chars", *others))
    changed = arrow_map(touched, ["text", "__spans", *others], cut, schema)
    return docs.join(keys, same, "left_anti").unionByName(changed.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; documents that it takes no time go."""
    scratch, inner = Scratch(spark, "pipeline"), Scratch(spark, "mixing")
    copies = mixing.mix(docs, scratch=inner).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    # rows that repeat a doc_id within a source share the sum of their copies, dealt by a running number
    copies = scratch.keep(copies.groupBy("__id", "__source", "__size").agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows")).where("__sum > 0"), "copies")
    inner.close()
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    sized = docs.withColumn("__words", size)
    match = sized["doc_id"].eqNullSafe(copies["__id"]) & sized["source"].eqNullSafe(copies["__source"]) & (F.col("__words") == F.col("__size"))
    taken = sized.join(copies.hint("merge"), match)  # one plan at every size: the copies grow with the documents
    single = taken.where("__rows = 1").withColumn("__times", F.col("__sum"))
    if not copies.where("__rows > 1").isEmpty():
        order = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("text"))
        several = taken.where("__rows > 1").withColumn("__times", F.floor((F.col("__sum") + F.col("__rows") - order) / F.col("__rows")))
        single = single.unionByName(several)
    return single.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the text that they decode to, and the ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: No stage can be expressed in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
