"""A corpus pipeline over `documents`: quality rules, exact deduplication, near-duplicate removal, source mixing,
packing. Each stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainrollup.llm import common, exact_dedup, mixing, near_dedup, packing, quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule rejects, null and empty texts among them."""
    return quality_rules.quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, by the smallest doc_id; another text under the same doc_id stays, and so do rows with a null doc_id."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.75 or more; texts without words and rows with a null doc_id stay."""
    return near_dedup.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as they are read, in the order of the permutation; a null source is one source."""
    return mixing.mix(docs, flatten=0.5, max_epochs=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row in their sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("temperature_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Token ids come from a tokenizer that SQL doesn't have; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences (see packing.pack) of what the stages keep. What a stage stores for
    itself is deleted with it; its output stays, as every stage's result is worth keeping. Columns beside those of documents pass through all
    stages but the last; an empty table gives no rows."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with common.scratch(spark):
            docs = common.stored(stage(spark, docs, sf_dir), name, keep=True)
