"""Rollups and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DECIMALS, Decimals, pct_change, ratio


def rollup_hours(deltas: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """(hour, series, dimension, value): sums of deltas, zero deltas left out. Partial sums are made before the shuffle,
    so a series without dimension is no hot key."""
    return deltas.where(amounts.nonzero(F.col("delta"))).groupBy("hour", "series", "dimension").agg(amounts.sum(F.col("delta")).alias("value"))


def rollup_days(hours: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """Days from hours: the blocks are not read twice."""
    return hours.groupBy(F.to_date("hour").alias("day"), "series", "dimension").agg(amounts.sum(F.col("value")).alias("value"))


def window_sum(value: Column, day: Column, start, end, when: Column | None = None) -> Column:
    inside = day.between(F.lit(start), F.lit(end))
    return F.coalesce(F.sum(F.when(inside if when is None else inside & when, value)), F.lit(0))


def kpis(df: DataFrame, figures: dict[str, Column], now: tuple, before: tuple, day: str = "day") -> DataFrame:
    """(kpi, current, previous, pct_change): every figure is a condition on the rows; both windows in one scan."""
    d, v = F.col(day), F.col("value")
    sums = [window_sum(v, d, *w, when=c).cast("decimal(38,0)").alias(f"{k}__{n}") for k, c in figures.items() for n, w in enumerate((now, before))]
    one = df.where(d.between(F.lit(min(before[0], now[0])), F.lit(max(now[1], before[1])))).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(f"{k}__0").alias("current"), F.col(f"{k}__1").alias("previous")) for k in figures])).alias("r")
    out = one.select(rows).select("r.*")
    return out.withColumn("pct_change", pct_change(F.col("current"), F.col("previous")))


def sum_series(df: DataFrame, series: str, dimension: str | None = None) -> DataFrame:
    rows = df.where(F.col("series") == series)
    return (rows if dimension is None else rows.where(F.col("dimension") == dimension)).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def dimension_totals(df: DataFrame, series: list[str], positive: bool = False) -> DataFrame:
    """(dimension, total) over one or more series."""
    out = df.where(F.col("series").isin(series)).groupBy("dimension").agg(F.sum("value").alias("total"))
    return out.where("total > 0") if positive else out


def day_denom_amounts(df: DataFrame, series: list[str], day: str = "day") -> DataFrame:
    """(day, denom, amount) over a list of series; only positive parts count."""
    return df.where(F.col("series").isin(series) & (F.col("value") > 0)).groupBy(day, F.col("dimension").alias("denom")).agg(F.sum("value").alias("amount"))


def rank_series(df: DataFrame, series: str) -> DataFrame:
    """Dimensions with a positive total by rank; ties by name. The ranking runs over totals, not rows."""
    return dimension_totals(df, [series], True).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(series)).orderBy(F.desc("total"), "dimension")))


def display_in(df: DataFrame, prefer: str, other: str, bucket: str = "bucket") -> DataFrame:
    """By bucket the preferred series if it has a row there, even one of 0, else the other."""
    mine = F.col("series") == prefer
    return df.where(F.col("series").isin(prefer, other)).groupBy(bucket).agg(
        F.coalesce(F.when(F.max(mine.cast("int")) == 1, F.sum(F.when(mine, F.col("value")))).otherwise(F.sum(F.when(~mine, F.col("value")))), F.lit(0)).alias("value"))


def ratios(totals: DataFrame, wanted: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Adds columns name: numerator / denominator * factor; null on a zero denominator, not clamped."""
    return totals.withColumns({k: ratio(F.col(a), F.col(b), t) for k, (a, b, t) in wanted.items()})


def top_day_share(df: DataFrame, by: str = "series", value: str = "value") -> DataFrame:
    """Largest absolute daily value over the sum of absolute values."""
    a = F.abs(F.col(value))
    return df.groupBy(by).agg(ratio(F.max(a), F.sum(a)).alias("top_day_share"))
