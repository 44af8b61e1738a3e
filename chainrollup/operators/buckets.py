"""Buckets of time: filters, dense days, coverage, aligned series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import small
from ..functions.time import bucket_end, bucket_of


def range_filter(df: DataFrame, start, end, col: str = "day") -> DataFrame:
    """Both ends belong to the range. On a table partitioned by `col`, other partitions are not read."""
    return df.where(F.col(col).between(F.lit(start), F.lit(end)))


def aggregate_buckets(df: DataFrame, grain: str, ts: str = "hour") -> DataFrame:
    """(bucket, series, dimension, value) sums at a grain."""
    return df.groupBy(bucket_of(grain, F.col(ts)).alias("bucket"), "series", "dimension").agg(F.sum("value").alias("value"))


def dense_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day from start to end; none if the range is inverted."""
    if start > end:
        return spark.createDataFrame([], "day date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def before_coverage(bucket: Column, grain: str, floor: Column) -> Column:
    """True if the bucket ends at or before the floor. Without a floor, or with a bucket that doesn't parse, it is covered."""
    return F.coalesce(bucket_end(grain, bucket.try_cast("timestamp")) <= floor.cast("timestamp"), F.lit(False))


def with_coverage(df: DataFrame, floors: DataFrame, grain: str, bucket: str = "bucket") -> DataFrame:
    """Adds `uncovered`. floors: (series, floor), one row a series: the declared list, tens of rows."""
    joined = df.join(small(floors), "series", "left")
    return joined.withColumn("uncovered", before_coverage(F.col(bucket), grain, F.col("floor"))).drop("floor")


def densify(df: DataFrame, days: DataFrame, floors: DataFrame | None = None, day: str = "day") -> DataFrame:
    """(day, series, value) for every day and series of df: 0 where covered and nothing happened, null before coverage."""
    series = df.select("series").distinct()
    grid = days.crossJoin(F.broadcast(series))  # days of a range by the names of series
    sums = df.groupBy(day, "series").agg(F.sum("value").alias("value"))
    full = grid.join(sums, [day, "series"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    if floors is None:
        return full
    return with_coverage(full, floors, "day", day).withColumn("value", F.when(~F.col("uncovered"), F.col("value"))).drop("uncovered")


def series_align(df: DataFrame, names: list[str], bucket: str = "bucket") -> DataFrame:
    """One column per series: 0 where the series has no row in the bucket, null where it has one with a null value."""
    aggs = []
    for n in names:
        mine = F.col("series") == n
        aggs += [F.sum(F.when(mine, F.col("value"))).alias(f"__s_{n}"), F.count(F.when(mine, F.lit(1))).alias(f"__n_{n}")]
    wide = df.where(F.col("series").isin(names)).groupBy(bucket).agg(*aggs)
    return wide.select(bucket, *[F.when(F.col(f"__n_{n}") == 0, F.lit(0)).otherwise(F.col(f"__s_{n}")).alias(n) for n in names])


def series_over_time(df: DataFrame, series: str, dimension: str | None, days: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """One series by day, dense, null before coverage, in order."""
    rows = df.where(F.col("series") == series)
    if dimension is not None:
        rows = rows.where(F.col("dimension") == dimension)
    sums = rows.groupBy("day").agg(F.sum("value").alias("value"))
    out = days.join(sums, "day", "left").select("day", F.lit(series).alias("series"), F.coalesce("value", F.lit(0)).alias("value"))
    if floors is not None:
        out = with_coverage(out, floors, "day", "day").withColumn("value", F.when(~F.col("uncovered"), F.col("value"))).drop("uncovered")
    return out.orderBy("day")


def hour_fallback(hourly: DataFrame, daily: DataFrame) -> tuple[DataFrame, str]:
    """The hourly rows of a range, or its daily rows if there are only those, and the grain that they have."""
    if hourly.isEmpty() and not daily.isEmpty():
        return daily, "day"
    return hourly, "hour"


def combined_series(df: DataFrame, names: list[str], bucket: str = "bucket", out: str = "value") -> DataFrame:
    """Sum of several series by bucket."""
    return df.where(F.col("series").isin(names)).groupBy(bucket).agg(F.sum("value").alias(out))


def share_rows(df: DataFrame, top: str, bottom: list[str], out: str = "pct", bucket: str = "bucket") -> DataFrame:
    """Aligned series with top / sum(bottom) in percent; null if an operand is null or the sum is 0."""
    names = list(dict.fromkeys([top, *bottom]))
    rows = series_align(df, names, bucket)
    total = sum((F.col(n) for n in bottom[1:]), F.col(bottom[0]))
    return rows.withColumn(out, F.when(total != 0, F.col(top) / total * 100))


def class_rows(df: DataFrame, classes: list[str], cls: str = "class", bucket: str = "bucket") -> DataFrame:
    """One column per class and bucket; buckets where all are 0 stay."""
    return df.groupBy(bucket).agg(*[F.coalesce(F.sum(F.when(F.col(cls) == c, F.col("value"))), F.lit(0)).alias(c) for c in classes])


def values_over_time(df: DataFrame, days: DataFrame, by: str) -> DataFrame:
    """(day, by, value, total) for every day and every `by` that occurs."""
    present = df.select(by).distinct()
    sums = df.groupBy("day", by).agg(F.sum("value").alias("value"))
    grid = days.crossJoin(F.broadcast(present)).join(sums, ["day", by], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    totals = df.groupBy("day").agg(F.sum("value").alias("total"))
    return grid.join(totals, "day", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def prior_has_data(df: DataFrame, prior_start, first_day: Column, cols: list[str]) -> DataFrame:
    """Blanks comparison columns where the prior window starts before indexed history."""
    ok = F.lit(prior_start) >= first_day
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})
