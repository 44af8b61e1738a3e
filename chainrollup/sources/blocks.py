"""Landing files of blocks with their results, and the rows within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<type: string, attributes: array<struct<key: string, value: string>>>"
TX = "struct<raw: string, messages: array<struct<type_url: string, body: string>>, signers: array<string>, fee_granter: string, fee_payer: string>"
RESULT = f"struct<code: int, gas_used: string, gas_wanted: string, events: array<{EVENT}>>"
BLOCK = f"height bigint, time timestamp, txs array<{TX}>, txs_results array<{RESULT}>, finalize_block_events array<{EVENT}>, end_block_events array<{EVENT}>, max_gas string"


def read_blocks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The schema is given, never inferred: one pass, and the same types for every file."""
    return spark.read.schema(BLOCK).format(fmt).load(path)


def archive_blocks(blocks: DataFrame, path: str, span: int = 10_000) -> None:
    """Stores blocks by ranges of `span` heights, a folder each, sorted by height within files, and beside them the least and the greatest
    height of each day."""
    part = F.expr(f"height div {span}")
    rows = blocks.withColumn("part", part)
    rows.hint("rebalance", "part").sortWithinPartitions("part", "height").write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    stored = blocks.sparkSession.read.schema("height bigint, time timestamp").parquet(f"{path}/blocks")
    days = stored.groupBy(F.to_date("time").alias("day")).agg(F.min("height").alias("low"), F.max("height").alias("high"), F.count(F.lit(1)).alias("blocks"))
    days.coalesce(1).write.mode("overwrite").parquet(f"{path}/days")


def read_archived_day(spark: SparkSession, path: str, day, span: int = 10_000) -> DataFrame:
    """The blocks of a day: its heights are looked up, and only the folders of their ranges are read."""
    at = spark.read.parquet(f"{path}/days").where(F.col("day") == F.lit(day)).select("low", "high").first()
    rows = spark.read.schema(f"{BLOCK}, part bigint").parquet(f"{path}/blocks")
    if at is None:
        return rows.where("false").drop("part")
    inside = F.col("part").between(at["low"] // span, at["high"] // span) & F.col("height").between(at["low"], at["high"])
    return rows.where(inside & (F.to_date("time") == F.lit(day))).drop("part")


def pair_txs(blocks: DataFrame) -> DataFrame:
    """height, time, tx_i, tx, result: transaction i with result i, as far as both lists go. No join, no shuffle."""
    n = F.least(F.size(F.coalesce("txs", F.array().cast(f"array<{TX}>"))), F.size(F.coalesce("txs_results", F.array().cast(f"array<{RESULT}>"))))
    pairs = F.arrays_zip(F.slice("txs", F.lit(1), n).alias("tx"), F.slice("txs_results", F.lit(1), n).alias("result"))
    return blocks.select("height", "time", F.posexplode(pairs).alias("tx_i", "p")).select("height", "time", "tx_i", F.col("p")["tx"].alias("tx"), F.col("p")["result"].alias("result"))


def pairing_mismatches(blocks: DataFrame) -> DataFrame:
    a, b = (F.coalesce(F.size(c), F.lit(0)) for c in ("txs", "txs_results"))
    a, b = F.greatest(a, F.lit(0)), F.greatest(b, F.lit(0))
    return blocks.select("height", F.greatest(a - b, F.lit(0)).alias("extra_txs"), F.greatest(b - a, F.lit(0)).alias("extra_results")).where("extra_txs <> extra_results")


def explode_tx_events(txs: DataFrame) -> DataFrame:
    return txs.select("height", "time", "tx_i", F.posexplode("result.events").alias("ev_i", "event"))


def block_events():
    """The finalize events, or the end-block events where the first list is absent."""
    return F.coalesce("finalize_block_events", "end_block_events")


def explode_block_events(blocks: DataFrame) -> DataFrame:
    return blocks.select("height", "time", F.posexplode(block_events()).alias("ev_i", "event"))


def tx_hash(raw):
    return F.upper(F.sha2(F.unbase64(raw), 256))
