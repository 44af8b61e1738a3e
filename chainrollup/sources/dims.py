"""Dimension tables out of curated JSON registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "denoms array<struct<denom: string, symbol: string, decimals: int, priceId: string>>, instances map<string,string>, brands map<string,string>, modules array<string>"


def dims_of(texts: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """denoms (denom, symbol, decimals, price_id), instances (board_id, name), brands (board_id, denom), modules (address) and price_ids
    (price_id) from registries as JSON texts. Malformed texts and entries without a key are dropped, repeats count once; a denomination in
    several registries gets the entry of the smallest text."""
    j = texts.select(F.col(text).alias("t"), F.from_json(text, REGISTRY).alias("j"))
    d = j.select("t", F.posexplode("j.denoms").alias("pos", "d")).where("coalesce(d.denom, '') <> ''")
    denoms = d.groupBy("d.denom").agg(F.min_by("d", F.struct("t", "pos")).alias("d")).select("denom", "d.symbol", "d.decimals", F.nullif("d.priceId", F.lit("")).alias("price_id"))

    def pairs(name: str, value: str) -> DataFrame:
        rows = j.select("t", F.explode(f"j.{name}").alias("board_id", value)).where("board_id <> ''")
        return rows.groupBy("board_id").agg(F.min_by(value, "t").alias(value))

    modules = j.select(F.explode("j.modules").alias("address")).where("address <> ''").distinct()
    return {"denoms": denoms, "instances": pairs("instances", "name"), "brands": pairs("brands", "denom"), "modules": modules, "price_ids": denoms.where("price_id IS NOT NULL").select("price_id").distinct()}


def load_dims(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """dims_of the JSON files at `path`, each a whole text."""
    return dims_of(spark.read.text(path, wholetext=True))
