"""The corpus pipeline: five stages over ``documents``, each stored as Parquet and read again by the next.

Quality rules reject documents, near-duplicate groups keep one document each, documents that overlap with the
benchmark go, the rest is sampled towards the target mix, and what stays is put into shards along a Hilbert curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, hilbert_sharding, ipf_mixing, minhash_dedup, quality_llr
from ledgerlens.llm.storage import discard, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_llr.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return minhash_dedup.deduplicated(docs, k=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics approach their target weights."""
    return ipf_mixing.mixed(docs).where("sampled").select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that came so far, with ``size, text_crc32, hilbert_index, shard, slot``."""
    return hilbert_sharding.document_shards(docs.select(*COLUMNS), 16)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: MinHash and hashed n-grams have no SQL twin; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # the next stage reads this one's rows alone
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
