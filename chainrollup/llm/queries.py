"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, class_lm, clustering, common, exact_dedup, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, vector_codes


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(common.documents(spark, sf_dir))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.lm_scores(common.documents(spark, sf_dir))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are read in which epoch, for a budget of all tokens: weights halfway to equal ones by entropy, with no source
    read over twice."""
    return mixing.mixing_plan(common.documents(spark, sf_dir), flatten=0.5, max_epochs=2.0)


def op4_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(common.documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), carry=("crc32(ids) AS ids_crc32",))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(common.documents(spark, sf_dir), stats=True)


def op7_bwt_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(common.documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return got.select("doc_id", (F.octet_length("kept").cast("long") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_gbt_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(common.documents(spark, sf_dir))


def op11_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = vector_codes.product_codes(common.embeddings(spark, sf_dir))
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    return rows.select("vec_id", vector_codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.centroid_clusters(common.embeddings(spark, sf_dir))
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op13_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_collinear_chaining, op2_class_lm, op3_temperature_mixing, op4_setsketch_near_dedup, op5_best_fit_packing, op6_quality_cascade, op7_bwt_suffix_dedup, op8_gbt_toxicity, op9_pairwise_quality, op10_exact_dedup, op11_slice_codes, op12_equal_average_clusters, op13_naive_bayes_language)
}
