"""The corpus pipeline: quality rules, line dedup, near-duplicate groups, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they were given,
whatever other columns there are. run() writes each stage's rows to the shared folder and reads them again as the next
stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, group_matrix, line_spread, perplexity, positional_index
from folioscope.llm.shared import new_path, small_or_shuffled, stored


def _except(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key (a hash, never null) is not among the column ``key`` of ``gone``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(small_or_shuffled(stored(gone.distinct(), "gone")), "key", "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; null ids are judged like others; rows that repeat id and text stay or go together;
    an empty table stays empty.
    """
    verdicts = perplexity.quality(docs, with_hash=True)
    lang = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    key = F.xxhash64(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"].cast("string")), lang)
    return _except(docs, key, verdicts.where("not kept").select(F.xxhash64("doc_id", "text_hash", "lang").alias("key")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars, where there is one, follows the text.

    Null texts and null ids stay null; repeated rows are treated alike; an empty table stays empty.
    """
    out = line_spread.remove_boilerplate(docs)
    chars = {"n_chars": F.length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Texts without words all stay; null ids come last in their group; of rows that repeat id and text one stays; an
    empty table stays empty.
    """
    return group_matrix.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's phrases don't contaminate.

    Null and empty texts and null ids stay unless contaminated; rows that repeat id and text stay or go together; an
    empty table, or an empty benchmark, takes nothing away.
    """
    key = F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    keyed = docs.select(key.alias("doc_id"), docs["text"])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = positional_index.contamination(keyed, benchmark).where("contaminated").select(F.col("doc_id").alias("key"))
    return _except(docs, key, found)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; null and empty texts have no tokens, every row gives one row."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the perplexity verdict of the first stage; a test holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
