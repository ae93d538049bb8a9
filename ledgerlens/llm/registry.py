"""The queries of the training-data operators over the given tables, and their SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import (
    decontamination,
    divergence,
    embedding_dedup,
    language_id,
    license_scan,
    packing,
    pii,
    resampling,
    sharding,
    simhash,
    substring_dedup,
    token_orc,
    warc,
)
from ledgerlens.llm.support import ready, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.fill_table(sharding.shard_names()))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(ready(spark), sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    digest = F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.spans_text(F.col("spans")).alias("spans"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.records(table(ready(spark), sf_dir, "pages"))
    folder = f"{shared_folder(spark)}/llm/warc-{uuid.uuid4().hex}"
    warc.write_warc(archive, f"{folder}/ours", *warc.layout(archive))
    warc.copy_warc(spark, f"{folder}/ours", f"{folder}/theirs", warc.damage)
    return warc.audit(warc.read_manifest(spark, f"{folder}/ours"), warc.read_manifest(spark, f"{folder}/theirs"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(ready(spark))}/llm/orc-{uuid.uuid4().hex}"
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, token_orc.tokenizer_path(), end_id=2)
    return token_orc.with_crc32(token_orc.read_tokens(spark, path))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ready(spark), sf_dir, "documents"), token_orc.tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.matches(docs, benchmark)


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(ready(spark), sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(ready(spark), sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(ready(spark), sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(ready(spark), sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_sharding,
        op3_pii,
        op4_warc_fixity,
        op5_token_orc,
        op6_packing,
        op7_decontamination,
        op8_simhash_near_duplicates,
        op9_embedding_near_duplicates,
        op10_language_id,
        op11_substring_dedup,
        op12_source_divergence,
        op13_importance_resampling,
    )
} | {"pipeline": corpus_pipeline.run}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    sql = {
        "op1_license_scan": license_scan.oracle(),
        "op2_sharding": sharding.oracle(),
        "op4_warc_fixity": warc.oracle(),
        "op11_substring_dedup": substring_dedup.oracle(),
        "op12_source_divergence": divergence.oracle(),
        "op13_importance_resampling": resampling.oracle(),
    }
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
