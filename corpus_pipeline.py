"""A corpus pipeline of five stages: language, near-duplicates, decontamination, mixture, token output.

Every stage takes all documents its predecessor kept and returns those it keeps, with the columns of ``documents``; the
mixture returns a document as often as it takes it; the last stage writes the token shards and returns what they hold.

Defined results: rows are judged one by one, whatever their numbers, and null numbers like any other. Null, empty or wordless
texts have no language and go in the first stage; stages by themselves keep them (near-duplicates), or take none of them
(mixture). Equal rows are copies of each other: one stays. An empty table passes through every stage. All columns are
kept; those that begin with ``__`` are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import decontam, langid, mixture, neardup, wavelet
from granary.llm.common import cut, drop_scratch, put, table, written
from granary.llm.queries import tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, no letter, or nothing in it that speaks for one of several languages); one without a label gets the predicted."""
    own = docs.columns
    keyed = docs.withColumn("__fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
    model = langid.fit(keyed.select("doc_id", "text", "lang", "__fold"), F.coalesce(F.col("__fold") != 2, F.lit(False)), F.col("doc_id"))
    seen = langid.predict(docs, model)
    # letters that occur in no language leave all of them with the same score
    chance = 1 / len(model["langs"]) if len(model["langs"]) > 1 else 0.0
    kept = seen.where((F.col("lang_pred") != langid.NONE) & (F.col("score") > chance + 1e-9))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*own)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, a hash of the number and all else of a row: rows that share it are equal in every column."""
    return docs.withColumn("__key", F.xxhash64(F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in docs.columns])))


def _nth() -> Column:
    """The number of a row among those equal to it, from 1."""
    return F.row_number().over(Window.partitionBy("__key").orderBy("__key"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest number (none comes last; then by a hash of the row)."""
    own, docs = docs.columns, _keyed(docs)
    judged = neardup.near_duplicates(docs.select(F.col("__key").alias("doc_id"), "text"), k=5, threshold=80)
    judged = cut(judged.select(F.col("doc_id").alias("__key"), "n_shingles", "component_id").distinct(), "judged")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    ranked = docs.select("doc_id", "__key").join(judged.where("n_shingles > 0"), "__key")
    least = ranked.groupBy("component_id").agg(F.min(rank)["__key"].alias("__key")).select("__key", F.lit(False).alias("__blank"))
    kept = least.unionByName(judged.where("n_shingles = 0").select("__key", F.lit(True).alias("__blank")))
    return docs.join(kept, "__key").withColumn("__nth", _nth()).where((F.col("__nth") == 1) | F.col("__blank")).select(*own)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; what it takes of equal rows is dealt evenly among them."""
    own, docs = docs.columns, _keyed(docs)
    taken = mixture.mix(docs.select(F.col("__key").alias("doc_id"), "text", "source")).where(F.col("size") > 0)
    copies = taken.groupBy(F.col("doc_id").alias("__key")).agg((F.sum("taken") / F.max("size")).cast("bigint").alias("__t"), F.count("*").alias("__n")).where("__t > 0")
    mine = F.floor((F.col("__t") + F.col("__n") - F.col("__nth")) / F.col("__n")).cast("int")
    joined = docs.join(copies, "__key").withColumn("__nth", _nth()).withColumn("__copies", mine).where("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*own)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document written, read back from the shards."""
    return wavelet.token_output(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("token_output", token_stage),
]
#: Language models, MinHash and tokenizers are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again, and what a stage wrote for itself is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        path = put(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, before, but=(path,))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
