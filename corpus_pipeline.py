"""From documents to packed sequences: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnet_spark.llm import mixing, near_dedup, packing, pii, quality
from graphnet_spark.llm.common import packed_texts, scratch, unpacked_texts


def carried(docs: DataFrame, *own: str | Column) -> DataFrame:
    """docs with its columns under neutral names, and the named ones, which a stage works on, under their own."""
    return docs.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)), *own)


def returned(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, with new values for some of them."""
    return out.select(*(new.get(c, F.col(f"_c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return returned(quality.quality(carried(docs, "lang", "text"), names).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id. Of rows that repeat it, one stays."""
    firsts = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("representative")
    keys = firsts.groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_other")).agg(F.count(F.lit(1)).alias("_n"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = carried(docs, "doc_id", F.col("text").isNull().alias("_null"), text.alias("text")).withColumn("_node", F.unhex(F.md5("text")))
    at = f"_c{docs.columns.index('text')}"
    kept = packed_texts(known.drop(at)).join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_other")))
    whole = kept.filter("_n = 1").unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_node"]))
    out = unpacked_texts(whole.select(*(c for c in whole.columns if c.startswith("_c")), "_null", "packed"))
    return returned(out.withColumn(at, F.when(F.col("_null"), F.lit(None)).otherwise(F.col("text"))), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.with_spans(carried(docs, "doc_id", "text"))
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return returned(out, docs, **new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's rate and their draw say."""
    return returned(mixing.emit(mixing.mix(carried(docs, "doc_id", "source", "text"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return packing.pack(packing.stored(packing.token_pieces(docs), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL has no counterpart of the perplexity model, the sampling and the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
