"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.divergence import DIVERGENCE_SQL, divergence
from lexigrid.llm.embedding_dedup import near_duplicates
from lexigrid.llm.language_model import score_texts
from lexigrid.llm.licenses import license_sql, scan_licenses
from lexigrid.llm.media import add_media, media_features
from lexigrid.llm.mixing import MIX_SQL, mix_report
from lexigrid.llm.ngram_join import ngram_groups
from lexigrid.llm.packing import pack
from lexigrid.llm.quality import quality_scores
from lexigrid.llm.repeats import repeat_digest
from lexigrid.llm.shared import written
from lexigrid.llm.simple8b import token_report
from lexigrid.llm.token_alignment import align_tokens
from lexigrid.llm.url_filter import URL_SQL, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(add_media(_table(spark, sf_dir, "documents")), "media"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(_table(spark, sf_dir, "documents"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": URL_SQL, "op5_source_mixing": MIX_SQL, "op12_license_scan": license_sql(), "op13_source_divergence": DIVERGENCE_SQL}
