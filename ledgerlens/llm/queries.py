"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_repair, decontam, exact_dedup, hilbert_sharding, host_words, ipf_mixing, minhash_dedup, pii_weak, quality_llr, secret_ledger, token_alignment, token_rollup, warc_store

from .oracles import ORACLES  # noqa: F401
from .storage import discard, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = hilbert_sharding.document_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return slim.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert_index"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_sum"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return ipf_mixing.mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.digest_columns(pii_weak.personal_data(table(spark, sf_dir, "documents")))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two visits: a first one under former rules, then the current ones, which scan known blobs only by what is new."""
    docs, ledger = table(spark, sf_dir, "documents"), secret_ledger.BlobLedger(spark)
    ledger.scan(docs, secret_ledger.FORMER_RULES)
    return secret_ledger.digest_columns(secret_ledger.secret_findings(docs, ledger))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions, then counts anew without runs of blanks, then exact copies taken out.

    Of equal texts the row with the least doc_id stays (rows without one come last): all
    rows are taken out again and one for each digest is put back, so nothing is joined by a key that copies share.
    """
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    docs = docs.withColumn("plain", F.when(plain != F.col("text"), plain)).withColumn("changed", F.col("plain").isNotNull())
    versions = {"byte_bpe_50k": token_rollup.TOKENIZER, "byte_bpe_multi_50k": token_rollup.TOKENIZER_MULTI}
    counts = token_rollup.with_token_counts(docs, versions).withColumnRenamed("plain", "text")
    counts = materialise(token_rollup.with_token_counts(counts, {f"new_{v}": path for v, path in versions.items()}), "counts")
    rollup = token_rollup.TokenRollup(spark)
    for v in versions:
        now = counts.withColumn("now", F.when(F.col("changed"), F.col(f"new_{v}")).otherwise(F.col(v)))
        first = now.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang", "now")).alias("f")).select("f.*")
        batches = {
            "load": token_rollup.inserts(counts, v, v), "recount": token_rollup.revisions(now.where("changed"), v, v, "now"),
            "drop-copies": token_rollup.deletes(now, v, "now").unionByName(token_rollup.inserts(first, v, "now")),
        }
        for name, events in batches.items():
            rollup.commit(f"{name}-{v}", events)
    discard(counts)
    return rollup.totals()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field comes from the bytes of the archive's records; one that isn't what it says ends the query."""
    archive = warc_store.write_archive(table(spark, sf_dir, "pages"))
    records = warc_store.read_archive(spark, archive)
    return records.select("page_id", "payload_bytes", warc_store.demanded("payload_digest").alias("payload_digest"), "record_type", "refers_to")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_words.judged(table(spark, sf_dir, "pages")).withColumn("host_words", F.concat_ws(" ", "host_words"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("key")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.summaries(conversation_repair.damaged(table(spark, sf_dir, "conversations")), "copies")


QUERIES = {
    "op3_decontamination": op3_decontamination,
    "op4_token_rollup": op4_token_rollup,
    "op7_warc": op7_warc,
    "op9_url_filter": op9_url_filter,
    "op2_personal_data": op2_personal_data,
    "op8_secret_ledger": op8_secret_ledger,
    "op1_hilbert_shards": op1_hilbert_shards,
    "op5_quality_rules": op5_quality_rules,
    "op10_mixing": op10_mixing,
    "op6_near_duplicates": op6_near_duplicates,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
