"""Sets of block heights as intervals (low, high), both ends included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import small

SPAN = 1 << 16  # heights that are looked at together


def intervals_of(heights: DataFrame) -> DataFrame:
    """low, high of the runs of consecutive heights; repeated ones count once. Runs are cut at multiples of SPAN."""
    span = F.expr(f"height div {SPAN}")
    place = F.row_number().over(Window.partitionBy("span").orderBy("height"))
    runs = heights.select("height").distinct().withColumn("span", span).withColumn("run", F.col("height") - place)
    return runs.groupBy("span", "run").agg(F.min("height").alias("low"), F.max("height").alias("high")).select("low", "high")


def joined(intervals: DataFrame) -> DataFrame:
    """The same set with intervals that overlap or adjoin as one. All in one task: they are as many as there are gaps, and one for each SPAN heights."""
    order = Window.partitionBy(F.lit(0)).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("start", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("start").over(order)).groupBy("island").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("low", "high")


def outside(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose height is in no interval. An interval meets rows by the multiples of SPAN that it covers, so the join is one by equality."""
    covered = intervals.select("low", "high", F.explode(F.expr(f"sequence(low div {SPAN}, high div {SPAN})")).alias("__span"))
    on = (F.expr(f"height div {SPAN}") == F.col("__span")) & F.col("height").between(F.col("low"), F.col("high"))
    return rows.join(small(covered), on, "left_anti")


def gaps(intervals: DataFrame) -> DataFrame:
    """low, high of what is missing between joined intervals."""
    order = Window.partitionBy(F.lit(0)).orderBy("low")
    return intervals.select((F.col("high") + 1).alias("low"), (F.lead("low").over(order) - 1).alias("high")).where("low <= high")
