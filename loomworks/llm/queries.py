"""The ten operators as queries over whole tables, and what SQL says of those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .curves_ann import NEAREST_SQL, nearest
from .exact_topk import TOPK_SQL, exact_topk
from .mixing import MIX_SQL, document_mix
from .ngram_join import JOIN_SQL, ngram_jaccard_join
from .packing import pack_documents
from .secret_scan import SCAN_SQL, scan_documents
from .sharding import document_shards
from .substring_dedup import DEDUP_SQL, substring_digest
from .toxicity import toxicity
from .warc import ARCHIVE_SQL, archive_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_read(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(_read(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_mix(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_read(spark, sf_dir, "documents"))


def op10_curves_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ngram_jaccard_join, op2_exact_topk, op3_sharding, op4_secret_scan, op5_source_mixing, op6_toxicity, op7_packing, op8_warc, op9_substring_dedup, op10_curves_ann, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": JOIN_SQL,
        "op2_exact_topk": TOPK_SQL,
        "op4_secret_scan": SCAN_SQL,
        "op5_source_mixing": MIX_SQL,
        "op8_warc": ARCHIVE_SQL,
        "op9_substring_dedup": DEDUP_SQL,
        "op10_curves_ann": NEAREST_SQL,
    }
