"""Window computations over aggregated series: scores, trends, differences of snapshots, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_zscore(df: DataFrame, flag_from=None, flag_before=None, rows: int = 30, least: int = 7, limit: float = 2.5, by: str = "series", day: str = "day", value: str = "value") -> DataFrame:
    """Adds z and flagged: the distance from the mean of the `rows` rows before (without the row itself), in population
    standard deviations; null with fewer than `least` values among them or a deviation of at most 1e-9. Only days in
    [flag_from, flag_before) are flagged. df has one row a series and day."""
    w = Window.partitionBy(by).orderBy(day).rowsBetween(-rows, -1)
    v = F.col(value).cast("double")
    scored = df.withColumns({"__m": F.avg(v).over(w), "__sd": F.stddev_pop(v).over(w), "__n": F.count(v).over(w)})
    z = F.when((F.col("__n") >= least) & (F.col("__sd") > 1e-9), (v - F.col("__m")) / F.col("__sd"))
    ok = F.lit(True)
    if flag_from is not None:
        ok = ok & (F.col(day) >= F.lit(flag_from))
    if flag_before is not None:
        ok = ok & (F.col(day) < F.lit(flag_before))
    return scored.withColumn("z", z).withColumn("flagged", F.coalesce(ok & (F.abs("z") >= limit), F.lit(False))).drop("__m", "__sd", "__n")


def latest_row(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row per key by `order`, an aggregate that is combined before the shuffle, not a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def snapshot_diff(df: DataFrame, fee: int, by: str | None = None, day: str = "day", count: str = "wallets", total: str = "minted", within: float = 0.01) -> DataFrame:
    """Differences of cumulative counters to the snapshot before (not the day before): n_new, n_minted, rate per new, whether it is
    within 1 % of the fee, days without a snapshot. Null in the first row and where a counter goes backwards."""
    w = Window.partitionBy(by if by else F.lit(0)).orderBy(day)
    a, b = F.col(count) - F.lag(count).over(w), F.col(total) - F.lag(total).over(w)
    out = df.withColumns({"__a": a, "__b": b, "__d": F.lag(day).over(w)})
    ok = (F.col("__a") >= 0) & (F.col("__b") >= 0)
    rate = F.when(ok & (F.col("__a") > 0), F.col("__b").cast("double") / F.col("__a").cast("double"))
    return out.select(*df.columns, F.when(ok, F.col("__a")).alias("n_new"), F.when(ok, F.col("__b")).alias("n_minted"), rate.alias("rate"),
                      F.when(rate.isNotNull(), F.abs(rate - fee) <= within * fee).alias("matches_fee"), (F.datediff(day, "__d") - 1).alias("gap_days"))


def linear_trend(df: DataFrame, by: str = "series", order: str = "day", value: str = "value") -> DataFrame:
    """Adds trend: least squares over the positions 0..n-1. Null values are left out and stay null; NaN values are left out and get
    an ordinate. No points give 0, one point a constant; a series of nulls only keeps nulls."""
    seq = Window.partitionBy(by).orderBy(order)
    whole = Window.partitionBy(by)
    v = F.col(value).cast("double")
    x = (F.row_number().over(seq) - 1).cast("double")
    df = df.withColumn("__x", x).withColumn("__y", F.when(~F.isnan(v), v)).withColumn("__px", F.when(F.col("__y").isNotNull(), F.col("__x")))
    s = {"n": F.count("__y"), "sx": F.sum("__px"), "sy": F.sum("__y"), "sxx": F.sum(F.col("__px") * F.col("__px")), "sxy": F.sum(F.col("__px") * F.col("__y"))}
    df = df.withColumns({f"__{k}": c.over(whole) for k, c in s.items()})
    n, sx, sy, sxx, sxy = (F.col(f"__{k}") for k in s)
    d = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / d
    fitted = F.when(n == 0, F.lit(0.0)).when((n == 1) | (d == 0), sy / n).otherwise((sy - slope * sx) / n + slope * F.col("__x"))
    return df.withColumn("trend", F.when(v.isNotNull(), fitted)).drop("__x", "__y", "__px", *[f"__{k}" for k in s])


def movers(scored: DataFrame, questions: Column, change: DataFrame, top: int = 3) -> DataFrame:
    """What stood out: per question the largest absolute z and absolute percent change, the `top` by both in that order.
    change: (question, pct)."""
    best = scored.withColumn("question", questions).groupBy("question").agg(F.max(F.abs("z")).alias("max_z"))
    return best.join(change, "question", "left").withColumn("abs_pct", F.abs("pct")).orderBy(F.desc_nulls_last("max_z"), F.desc_nulls_last("abs_pct"), "question").limit(top).select("question", "max_z", "abs_pct")
