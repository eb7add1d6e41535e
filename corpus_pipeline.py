"""A corpus pipeline over ``documents``: each stage reads what the one before wrote.

Every stage but the last returns the columns of ``documents``:

1. quality rules: documents that the base filter or the weak supervision rejects go;
2. n-gram Jaccard join on five words at 0.8: the least ``doc_id`` of each component stays;
3. suffix-array dedup: bytes of repeated 100-byte strings leave the texts, and
   ``n_chars`` follows; a document stays even if nothing is left of its text;
4. mixing: rows come in the order of the mix, as range-partitioned files;
5. packing: one row for each piece of a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed
from larkspur.llm.jaccard_join import jaccard_join
from larkspur.llm.mixing import mixed_order
from larkspur.llm.packing import pack
from larkspur.llm.quality import quality_filter
from larkspur.llm.suffix_dedup import suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that repeat id and whole text are one document given twice
    stay = jaccard_join(docs, k=5, percent=80).where("stays").withColumn("whole", F.sha2("row.text", 256))
    return stay.dropDuplicates(["d", "tag", "whole"]).select("row.*")


def exact_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return suffix_dedup(docs, whole_characters=True).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", exact_substrings),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]
#: Components, suffix arrays and schedules aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are checkpointed, as the next reads them more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
