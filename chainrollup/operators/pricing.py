"""Day-priced amounts. Sums are exact integers by day and denomination; the price is applied once to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, small

def enrich_denom(df: DataFrame, denoms: DataFrame) -> DataFrame:
    """Adds symbol and decimals; null where the denomination is not known."""
    return df.join(small(denoms.select("denom", "symbol", "decimals")), "denom", "left")


def price_legs(legs: DataFrame, denoms: DataFrame, prices: DataFrame, spot: DataFrame) -> DataFrame:
    """Adds usd and basis to rows (denom, day, amount): the day's price, else the spot price, else null. An amount of 0 is
    worth 0 and is unpriced. denoms: denom, decimals, price_id; prices: price_id, day, usd; spot: price_id, usd."""
    rows = legs.join(small(denoms.select("denom", "decimals", "price_id")), "denom", "left")
    rows = rows.join(small(prices.select("price_id", "day", F.col("usd").alias("__day"))), ["price_id", "day"], "left").join(small(spot.select("price_id", F.col("usd").alias("__spot"))), "price_id", "left")
    units = F.col("amount").cast("double") / F.pow(F.lit(10.0), F.col("decimals").cast("double"))
    price = F.coalesce("__day", "__spot").cast("double")
    zero = F.col("amount") == 0
    basis = F.when(zero | F.col("decimals").isNull(), F.lit("unpriced")).when(F.col("__day").isNotNull(), F.lit("day")).when(F.col("__spot").isNotNull(), F.lit("spot")).otherwise(F.lit("unpriced"))
    return rows.withColumn("usd", F.when(zero, F.lit(0.0)).otherwise(units * price)).withColumn("basis", basis).drop("__day", "__spot")


def usd_by(priced: DataFrame, *keys: str) -> DataFrame:
    """(keys, amount, usd): usd is null only if no row of the key has a price."""
    return priced.groupBy(*keys).agg(F.sum("amount").alias("amount"), F.sum("usd").alias("usd"))


def pricing_meta(priced: DataFrame) -> DataFrame:
    """One row: distinct legs by basis, and the overall basis."""
    legs = priced.select("denom", "day", "basis").distinct()
    c = lambda b: F.count(F.when(F.col("basis") == b, F.lit(1)))
    one = legs.agg(c("day").alias("by_day"), c("spot").alias("by_spot"), c("unpriced").alias("unpriced"))
    d, s = F.col("by_day") > 0, F.col("by_spot") > 0
    return one.withColumn("basis", F.when(d & s, "mixed").when(d, "daily-close").when(s, "spot-fallback").otherwise("none"))


def missing_price_ids(ids: DataFrame, days: DataFrame, prices: DataFrame) -> DataFrame:
    """Ids (column price_id, the configured list) that lack a price on some day."""
    return ids.crossJoin(F.broadcast(days)).join(prices.select("price_id", "day"), ["price_id", "day"], "left_anti").select("price_id").distinct()


def strict_usd(priced: DataFrame, *keys: str) -> DataFrame:
    """(keys, usd): null unless every row has a price."""
    return priced.groupBy(*keys).agg(F.when(F.count("usd") == F.count(F.lit(1)), F.sum("usd")).alias("usd"))


def valid_prices(df: DataFrame) -> DataFrame:
    """Rows with a day in ISO form, an id, and a finite price of at least 0."""
    day = F.col("day").cast("string")
    return df.where(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.try_cast("date").isNotNull() & (F.coalesce("price_id", F.lit("")) != "") & ~F.isnan("usd") & (F.col("usd") >= 0) & (F.col("usd") < float("inf")))


def bucket_price_points(points: DataFrame) -> DataFrame:
    """(price_id, day, usd): the earliest valid point of each UTC day. points: price_id, ms, usd."""
    ok = points.where(F.col("usd").isNotNull() & ~F.isnan("usd") & (F.col("usd") >= 0) & (F.col("usd") < float("inf")))
    return ok.groupBy("price_id", F.to_date(F.timestamp_millis("ms")).alias("day")).agg(F.min_by("usd", "ms").alias("usd"))


# --- concentration


def hhi(df: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Sum of squared shares and its inverse, in one pass; null on a zero total."""
    w = F.col(weight)
    out = df.groupBy(*keys) if keys else df
    return out.agg(ratio(F.sum(w * w), F.pow(F.sum(w), F.lit(2.0))).alias("hhi")).withColumn("effective_n", ratio(F.lit(1.0), F.col("hhi")))


def top_n_share(df: DataFrame, weight: str, n: int) -> DataFrame:
    """One row: share of the n largest. The n largest come from a distributed top-n, not from one sorted partition."""
    top = df.orderBy(F.desc(weight)).limit(n).agg(F.sum(weight).alias("__t"))
    return df.agg(F.sum(weight).alias("__all")).crossJoin(top).select(ratio(F.col("__t"), F.col("__all")).alias("top_share"))


def top_n_share_by(df: DataFrame, weight: str, n: int, key: str, tie: str) -> DataFrame:
    """(key, top_share). Ranks are taken within salted parts of a key first, so that a day with very many addresses is not sorted in one task."""
    part = F.pmod(F.xxhash64(tie), F.lit(64))
    w = Window.partitionBy(key, part).orderBy(F.desc(weight), tie)
    heads = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    top = heads.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(weight), tie))).where(F.col("__r") <= n).groupBy(key).agg(F.sum(weight).alias("__t"))
    return df.groupBy(key).agg(F.sum(weight).alias("__all")).join(top, key, "left").select(key, ratio(F.col("__t"), F.col("__all")).alias("top_share"))


def address_usd(priced: DataFrame) -> DataFrame:
    """(address, usd) over the range: positive day sums only."""
    return priced.groupBy("day", "address").agg(F.sum("usd").alias("usd")).where("usd > 0").groupBy("address").agg(F.sum("usd").alias("usd"))


def concentration_over_time(priced: DataFrame, days: DataFrame, n: int = 10) -> DataFrame:
    """(day, hhi, top_share), dense; null on days without priced activity."""
    each = priced.groupBy("day", "address").agg(F.sum("usd").alias("usd")).where("usd > 0")
    return days.join(hhi(each, "usd", "day").drop("effective_n"), "day", "left").join(top_n_share_by(each, "usd", n, "day", "address"), "day", "left")


# --- net flow


def net_flow_by_asset(priced: DataFrame) -> DataFrame:
    """(denom, in, out, net and their USD). priced: direction in/out, denom, day, amount, usd. Order: priced by absolute net,
    then the others by the larger amount."""
    d = lambda k, c: F.coalesce(F.sum(F.when(F.col("direction") == k, F.col(c))), F.lit(0)) if c == "amount" else F.sum(F.when(F.col("direction") == k, F.col(c)))
    out = priced.groupBy("denom").agg(d("in", "amount").alias("amount_in"), d("out", "amount").alias("amount_out"), d("in", "usd").alias("usd_in"), d("out", "usd").alias("usd_out"))
    net = F.when(F.col("usd_in").isNull() & F.col("usd_out").isNull(), F.lit(None).cast("double")).otherwise(F.coalesce("usd_in", F.lit(0.0)) - F.coalesce("usd_out", F.lit(0.0)))
    return out.withColumn("net", F.col("amount_in") - F.col("amount_out")).withColumn("net_usd", net)


def order_assets(assets: DataFrame) -> DataFrame:
    return assets.orderBy(F.abs("net_usd").desc_nulls_last(), F.greatest("amount_in", "amount_out").desc(), "denom")


def net_flow_headline(assets: DataFrame) -> DataFrame:
    return assets.agg(F.sum("net_usd").alias("net_usd"), F.sum("usd_in").alias("usd_in"), F.sum("usd_out").alias("usd_out"), F.count(F.lit(1)).alias("assets"), F.count("net_usd").alias("priced"))


def net_flow_daily(priced: DataFrame, days: DataFrame) -> DataFrame:
    """(day, net_usd): 0 without legs, null if there are legs and none has a price."""
    signed = F.when(F.col("direction") == "in", F.col("usd")).otherwise(-F.col("usd"))
    sums = priced.groupBy("day").agg(F.sum(signed).alias("net_usd"), F.count(F.lit(1)).alias("__n"))
    return days.join(sums, "day", "left").select("day", F.when(F.coalesce("__n", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("net_usd")).alias("net_usd"))


def top_assets_series(priced: DataFrame, assets: DataFrame, n: int = 5) -> DataFrame:
    """(day, denom, in, out, net) of the n first assets."""
    top = order_assets(assets).limit(n).select("denom")
    d = lambda k: F.coalesce(F.sum(F.when(F.col("direction") == k, F.col("amount"))), F.lit(0))
    return priced.join(F.broadcast(top), "denom", "left_semi").groupBy("day", "denom").agg(d("in").alias("amount_in"), d("out").alias("amount_out")).withColumn("net", F.col("amount_in") - F.col("amount_out"))
