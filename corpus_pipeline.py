"""The corpus pipeline: operators applied one after the other, each stage written and read again.

Quality classifier (rejected documents go), n-gram Jaccard join (one document of
each group stays), benchmark decontamination (documents with benchmark passages
go), best-fit packing (the result: one row per piece with its sequence).

Rows are told apart by a 64-bit hash of id and text, so ids may repeat or be null;
rows equal in both count as copies of each other in the second stage. Whatever stays
is never changed by a filtering stage, and keeps all columns of ``documents``.

Defined cases: a null or empty text is scored as the classifier scores no words, is
a near copy of nothing (but rows equal in id and text are one), holds no benchmark
passage, and is packed as its end id; without labels every score is 0.5, so all
documents go; an empty table gives an empty table at every stage; extra columns stay,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination, jaccard, packing, quality
from brindle.llm.common import materialize, unused_name
from brindle.llm.filters import key_filter, split_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _row_key() -> Column:
    """Tells rows apart even if ids repeat or are null: two rows that differ share a key with a probability of 2^-64."""
    return F.xxhash64("doc_id", "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (a null one is last), of each group of near copies."""
    found = materialize(jaccard.jaccard_components(docs.select(_row_key().alias("doc_id"), "text")), "components")
    keys = found.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("group"), F.count(F.lit(1)).alias("n"))
    copies = keys.where("row <> group or n > 1").select("row", "group")
    # Only rows of groups, or that are equal to another, are moved.
    touched = materialize(copies.union(copies.select("group", "group")).distinct(), "copies")
    key = unused_name(docs)
    sure, rest = split_rows(docs.withColumn(key, _row_key()), F.col(key), key_filter(touched, "row"))
    named = rest.select(F.col("doc_id").alias("id"), F.col(key).alias("row")).join(touched, "row")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    stay = named.groupBy("group").agg(F.min(order)["row"].alias("row"))
    gone = materialize(touched.join(stay, "row", "left_anti").select(F.col("row").alias(key)), "gone")
    # Of rows equal in id and text one stays; each task keeps one before the shuffle.
    kept, others = rest.join(gone, key, "left_anti"), [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.groupBy(key).agg(*[F.first(f"`{c}`").alias(c) for c in ("doc_id", "text")], F.first(F.struct(*[F.col(f"`{c}`") for c in others])).alias(f"{key}_rest"))
    columns = [F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"{key}_rest").getField(c).alias(c) for c in docs.columns]
    return sure.drop(key).union(one.select(*columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; DataFrame functions only. Spark broadcasts the keys of those that
    go if the written table is small, else it shuffles."""
    found = decontamination.decontaminate(docs.select(_row_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = unused_name(docs)
    dropped = materialize(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, _row_key()).join(dropped, key, "left_anti").drop(key)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
