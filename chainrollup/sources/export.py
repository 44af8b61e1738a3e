"""Long exports: sorted rows with values as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DECIMALS, Decimals


def export_long(df: DataFrame, bucket: str, amounts: Decimals = DECIMALS) -> DataFrame:
    """(bucket, series, dimension, value) in order; the sort is a range shuffle, not one task."""
    return df.select(F.col(bucket).cast("string").alias("bucket"), "series", "dimension", amounts.text(F.col("value")).alias("value")).orderBy("bucket", "series", "dimension")


def write_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180: fields quoted where needed, quotes doubled, lines ended by CR LF."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
