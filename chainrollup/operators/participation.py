"""Participation: who was active, retention, per-address totals. Addresses are grouped first and counted after, so that no
query needs several distinct counts over the raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio, small


def exclude_accounts(df: DataFrame, accounts: DataFrame, address: str = "address") -> DataFrame:
    """Without the listed accounts (column address; a curated list of tens). Null addresses stay."""
    return df.join(small(accounts.select(F.col("address").alias("__x"))), F.col(address) == F.col("__x"), "left_anti")


def participation_range(df: DataFrame) -> DataFrame:
    """One row: signers, payers, accounts, single_day, multi_day. df: day, address, role."""
    each = df.groupBy("address").agg(F.max((F.col("role") == "signer").cast("int")).alias("s"), F.max((F.col("role") == "fee_payer").cast("int")).alias("p"), F.min("day").alias("a"), F.max("day").alias("b"))
    c = lambda cond: F.count(F.when(cond, F.lit(1)))
    return each.agg(c(F.col("s") == 1).alias("signers"), c(F.col("p") == 1).alias("payers"), F.count(F.lit(1)).alias("accounts"), c(F.col("a") == F.col("b")).alias("single_day"), c(F.col("a") < F.col("b")).alias("multi_day"))


def distinct_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(F.countDistinct("address").alias("accounts"))


def dense_distinct(df: DataFrame, days: DataFrame) -> DataFrame:
    return days.join(distinct_per_day(df), "day", "left").withColumn("accounts", F.coalesce("accounts", F.lit(0)))


def retention_counts(df: DataFrame, now: tuple, before: tuple) -> DataFrame:
    """One row: active, retained (also active in the window before), new (never seen before the range). One pass over the
    history, grouped by address; a first-seen table in place of the history gives the same."""
    d = F.col("day")
    flag = lambda cond: F.max(cond.cast("int"))
    each = df.where(d <= F.lit(now[1])).groupBy("address").agg(flag(d.between(F.lit(now[0]), F.lit(now[1]))).alias("n"), flag(d.between(F.lit(before[0]), F.lit(before[1]))).alias("b"), flag(d < F.lit(now[0])).alias("e"))
    c = lambda cond: F.count(F.when(cond, F.lit(1)))
    return each.where("n = 1").agg(F.count(F.lit(1)).alias("active"), c(F.col("b") == 1).alias("retained"), c(F.col("e") == 0).alias("new"))


def first_seen_index(df: DataFrame) -> DataFrame:
    """(address, first_day). Merged with that of later rows by the least day, so it is kept without reading history."""
    return df.groupBy("address").agg(F.min("day").alias("first_day"))


def retention_by_index(df: DataFrame, index: DataFrame, now: tuple, before: tuple) -> DataFrame:
    """retention_counts from a first-seen index: of df only the days of both windows are read, of the index one row an address."""
    d = F.col("day")
    inside, prior = d.between(F.lit(now[0]), F.lit(now[1])), d.between(F.lit(before[0]), F.lit(before[1]))
    flag = lambda cond: F.max(cond.cast("int"))
    each = df.where(inside | prior).groupBy("address").agg(flag(inside).alias("n"), flag(prior).alias("b")).where("n = 1")
    met = each.join(index, "address", "left")
    c = lambda cond: F.count(F.when(cond, F.lit(1)))
    return met.agg(F.count(F.lit(1)).alias("active"), c(F.col("b") == 1).alias("retained"), c(F.coalesce(F.col("first_day") >= F.lit(now[0]), F.lit(True))).alias("new"))


def retention_shares(counts: DataFrame, prior: DataFrame) -> DataFrame:
    """retained_pct, new_pct, delta_points against the prior window; null where nobody was active. Both are one row."""
    p = prior.select(ratio(F.col("retained"), F.col("active"), 100).alias("__p"))
    out = counts.crossJoin(p).withColumn("retained_pct", ratio(F.col("retained"), F.col("active"), 100)).withColumn("new_pct", ratio(F.col("new"), F.col("active"), 100))
    return out.withColumn("delta_points", F.col("retained_pct") - F.col("__p")).drop("__p")


def address_totals(df: DataFrame, amount: str = "amount", daily: bool = False) -> DataFrame:
    return df.groupBy(*(["day"] if daily else []), "address", "denom").agg(F.sum(amount).alias(amount))


def distinct_senders(df: DataFrame) -> DataFrame:
    """(denom, senders): addresses whose range total is positive."""
    return address_totals(df).where("amount > 0").groupBy("denom").agg(F.count(F.lit(1)).alias("senders"))


def offer_wallets(df: DataFrame) -> DataFrame:
    """(kind, wallets) with a row 'all'. df: owner, kind."""
    one = df.select("owner", "kind").distinct()
    kinds = one.groupBy("kind").agg(F.count(F.lit(1)).alias("wallets"))
    return kinds.unionByName(one.agg(F.countDistinct("owner").alias("wallets")).select(F.lit("all").alias("kind"), "wallets"))


def category_wallets(df: DataFrame) -> DataFrame:
    """One row: wallets with interactive, automated, any, both. df: owner, class."""
    flag = lambda c: F.max((F.col("class") == c).cast("int"))
    each = df.groupBy("owner").agg(flag("interactive").alias("i"), flag("automated").alias("a"))
    c = lambda cond: F.count(F.when(cond, F.lit(1)))
    return each.agg(c(F.col("i") == 1).alias("interactive"), c(F.col("a") == 1).alias("automated"), F.count(F.lit(1)).alias("any"), c((F.col("i") == 1) & (F.col("a") == 1)).alias("both"))
