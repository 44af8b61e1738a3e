"""Latest-state tables: positions, flows, landings, provisioning; and checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DECIMALS, Decimals, ratio

STALE_BLOCKS = 250_000


def counted_positions(df: DataFrame) -> DataFrame:
    """Positions that didn't give out more than they took."""
    return df.where("total_in >= total_out")


def principal_by_venue(df: DataFrame) -> DataFrame:
    return counted_positions(df).groupBy("contract", "protocol", "chain", "denom").agg(
        F.sum(F.col("total_in") - F.col("total_out")).alias("principal"), F.count(F.lit(1)).alias("positions"), F.countDistinct("portfolio").alias("portfolios"), F.max("height").alias("height"))


def portfolio_counts(positions: DataFrame, portfolios: DataFrame) -> DataFrame:
    """One row: portfolios with positions, with a positive sum, and all."""
    each = positions.groupBy("contract", "portfolio").agg(F.sum(F.when(F.col("total_in") >= F.col("total_out"), F.col("total_in") - F.col("total_out")).otherwise(0)).alias("s"))
    one = each.agg(F.count(F.lit(1)).alias("with_positions"), F.count(F.when(F.col("s") > 0, F.lit(1))).alias("active"))
    return one.crossJoin(portfolios.agg(F.count(F.lit(1)).alias("total")))


def quarantined_positions(df: DataFrame) -> DataFrame:
    return df.where("total_out > total_in").groupBy("denom").agg(F.sum(F.col("total_out") - F.col("total_in")).alias("excess"), F.count(F.lit(1)).alias("positions"))


def stale_rows(df: DataFrame, blocks: int = STALE_BLOCKS) -> DataFrame:
    """Rows more than `blocks` below the greatest height (one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(F.max("height").alias("__top")))).where(F.col("height") < F.col("__top") - blocks).drop("__top")


def flows_in_range(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col("day").between(F.lit(start), F.lit(end))).groupBy("flow_type", "denom").agg(F.count(F.lit(1)).alias("flows"), F.sum("amount").alias("amount"))


def net_deposits_usd(priced: DataFrame) -> DataFrame:
    """Priced deposits less priced withdrawals; null if none has a price."""
    s = F.when(F.col("flow_type") == "deposit", F.col("usd")).when(F.col("flow_type") == "withdraw", -F.col("usd"))
    return priced.agg(F.sum(s).alias("net_usd"))


def contract_split(venues: DataFrame) -> DataFrame:
    """(contract, positions, usd, share_pct, unpriced): shares of the priced total; venues without principal are dropped."""
    each = venues.where("principal > 0").groupBy("contract").agg(F.sum("positions").alias("positions"), F.sum("usd").alias("usd"), F.count(F.when(F.col("usd").isNull(), F.lit(1))).alias("unpriced"))
    total = F.broadcast(each.agg(F.sum("usd").alias("__t")))
    return each.crossJoin(total).withColumn("share_pct", ratio(F.col("usd"), F.col("__t"), 100)).drop("__t")


def top_two_venue_share(venues: DataFrame) -> DataFrame:
    """Share of the two largest venues; null with fewer than three or if any has no price."""
    top = venues.orderBy(F.desc("usd")).limit(2).agg(F.sum("usd").alias("__t"))
    one = venues.agg(F.count(F.lit(1)).alias("__n"), F.count("usd").alias("__p"), F.sum("usd").alias("__all")).crossJoin(top)
    return one.select(F.when((F.col("__n") >= 3) & (F.col("__p") == F.col("__n")), ratio(F.col("__t"), F.col("__all"))).alias("top_two_share"))


def landings_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("installs"), F.coalesce(F.sum("storage_fee"), F.lit(0)).alias("storage_fee"), F.sum("gas_fee").alias("gas_fee"), F.count(F.when(F.col("storage_fee").isNull(), F.lit(1))).alias("ambiguous"))


def landings_summary(df: DataFrame, recorded_fees: int) -> DataFrame:
    """One row: installs, fees, installers, days, and storage as a share of recorded and storage fees."""
    one = df.agg(F.count(F.lit(1)).alias("installs"), F.coalesce(F.sum("storage_fee"), F.lit(0)).alias("storage_fee"), F.coalesce(F.sum("gas_fee"), F.lit(0)).alias("gas_fee"), F.countDistinct("installer").alias("installers"), F.countDistinct("day").alias("days"))
    return one.withColumn("storage_share_pct", ratio(F.col("storage_fee"), F.col("storage_fee") + F.lit(recorded_fees), 100))


def provisioning_summary(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"), F.coalesce(F.sum("n_minted"), F.lit(0)).alias("n_minted"), F.count(F.when(~F.col("matches_fee"), F.lit(1))).alias("days_off_fee"), F.count("matches_fee").alias("days_checked"), F.max_by("wallets", "day").alias("wallets"), F.max_by("minted", "day").alias("minted"))


def with_prior_snapshot(df: DataFrame, start, end) -> DataFrame:
    """The rows of the range and the newest one before it."""
    before = df.where(F.col("day") < F.lit(start)).orderBy(F.desc("day")).limit(1)
    return before.unionByName(df.where(F.col("day").between(F.lit(start), F.lit(end))))


def covered_through(snapshots: DataFrame, control: DataFrame, job: str) -> DataFrame:
    """Latest snapshot day with a height up to the job's. control: job, last_height (one row per job)."""
    mine = F.broadcast(control.where(F.col("job") == job).select("last_height"))
    return snapshots.join(mine, F.col("height") <= F.col("last_height")).agg(F.max("day").alias("covered_through"))


def availability(covered: DataFrame, end) -> DataFrame:
    c = F.col("covered_through")
    return covered.withColumn("status", F.when(c.isNull(), "not-backfilled").when(c < F.lit(end), "range-exceeds-coverage").otherwise("available"))


def coverage_cutoff(df: DataFrame) -> DataFrame:
    """First unanswered day after the first answered one. df: day, answered."""
    first = F.broadcast(df.agg(F.min(F.when(F.col("answered"), F.col("day"))).alias("__f")))
    return df.crossJoin(first).agg(F.min(F.when(~F.col("answered") & (F.col("day") > F.col("__f")), F.col("day"))).alias("cutoff"))


def parity_check(hourly: DataFrame, daily: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """(series, dimension, hourly, daily) where the sums differ; a missing side is 0."""
    h = hourly.groupBy("series", "dimension").agg(amounts.sum(F.col("value")).alias("hourly"))
    d = daily.groupBy("series", "dimension").agg(amounts.sum(F.col("value")).alias("daily"))
    z = amounts.or_zero
    return h.join(d, ["series", "dimension"], "full_outer").select("series", "dimension", z(F.col("hourly")).alias("hourly"), z(F.col("daily")).alias("daily")).where("hourly <> daily")


def registry_drift(local: DataFrame, chain: DataFrame) -> DataFrame:
    """(denom, status): decimals-differ, missing-locally, agreed or unknown (no decimals on chain). local: denom, decimals, pos,
    of which the first entry wins; chain: denom, decimals."""
    mine = local.groupBy("denom").agg(F.min_by(F.struct("decimals"), "pos").alias("__l"))
    j = chain.join(mine, "denom", "left")
    s = F.when(F.col("__l").isNull(), "missing-locally").when(F.col("decimals").isNull(), "unknown").when(F.col("__l.decimals") == F.col("decimals"), "agreed").otherwise("decimals-differ")
    return j.select("denom", s.alias("status"))


def first_seen(df: DataFrame, key: str = "type_url") -> DataFrame:
    """(key, height, tx_i) of the first occurrence."""
    return df.groupBy(key).agg(F.min(F.struct("height", "tx_i")).alias("__f")).select(key, "__f.height", "__f.tx_i")
