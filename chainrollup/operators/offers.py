"""Wallet offers and invocations: categories, outcomes, engagement."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

# Categories, classes, outcomes and the names that decide them.
CATEGORIES = ["oracle", "governance", "vaults", "psm", "auction", "fast_usdc", "orchestration", "ymax", "other"]
AUTOMATED = ["orchestration", "oracle", "fast_usdc"]
INTERACTIVE = ["vaults", "psm", "auction", "governance", "ymax"]
OUTCOMES = ["wants_satisfied", "wants_unsatisfied", "errored"]
NAMED = [  # patterns of a contract's name, the first that fits decides
    ("(?i)price feed$", "oracle"), ("(?i)^scaledPriceAuthority", "oracle"), ("(Committee|Governor|Charter)$", "governance"), ("^VaultFactory$", "vaults"),
    ("(?i)^psm-", "psm"), ("^(auctioneer|reserve)$", "auction"), ("^fastUsdc$", "fast_usdc"), ("(?i)^ymax", "ymax"),
]
MAKERS = {"SettleTransaction": "fast_usdc", "SubmitEvidence": "fast_usdc", "SimpleRebalance": "ymax"}
USER_TARGETS = ["evmWalletHandler"]
MAX_DIM = 512


class Rules(NamedTuple):
    """What decides a category; another instance may be applied to stored actions."""

    named: list[tuple[str, str]]
    makers: dict[str, str]
    user_targets: list[str]


RULES = Rules(NAMED, MAKERS, USER_TARGETS)


def offer_category(kind: Column, instance: Column, maker: Column, target: Column, rules: Rules = RULES) -> Column:
    """Exactly one category. An invocation goes by its target; an offer by its contract's name, else by its maker."""
    named = F.lit("other")
    for pattern, category in reversed(rules.named):
        named = F.when(instance.rlike(pattern), category).otherwise(named)
    by_maker = F.when(maker.rlike("(?i)pushprice"), "oracle")
    for name, category in rules.makers.items():
        by_maker = by_maker.when(maker == name, category)
    invoked = F.when(target.isin(rules.user_targets), "ymax").otherwise("orchestration")
    return F.when(kind == "wallet_invocation", invoked).when(F.coalesce(instance, F.lit("")) != "", named).otherwise(by_maker.otherwise("other"))


def classified(facts: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Facts (kind, instance_path, maker, target) with their category."""
    return facts.withColumn("category", offer_category(F.col("kind"), F.col("instance_path"), F.col("maker"), F.col("target"), rules))


def automation_class(category: Column) -> Column:
    return F.when(category.isin(AUTOMATED), "automated").when(category.isin(INTERACTIVE), "interactive").otherwise("unknown")


def outcome_dim(category: Column, outcome: Column) -> Column:
    return F.concat_ws("|", category, outcome)


def parse_outcome_dim(dim: Column) -> Column:
    """struct(category, outcome); null if either is none that is known."""
    c, o = F.substring_index(dim, "|", 1), F.substring_index(dim, "|", -1)
    ok = dim.contains("|") & c.isin([*CATEGORIES, "unclassified"]) & o.isin(OUTCOMES) & (F.concat_ws("|", c, o) == dim)
    return F.when(ok, F.struct(c.alias("category"), o.alias("outcome")))


def clamp_dim(dim: Column) -> Column:
    return F.substring(dim, 1, MAX_DIM)


def outcomes_by_category(dims: DataFrame) -> DataFrame:
    """(category, settled, satisfied, unsatisfied, errored, rate_pct) from (dimension, value); bad dimensions are dropped."""
    rows = dims.withColumn("__p", parse_outcome_dim(F.col("dimension"))).where("__p IS NOT NULL").select("__p.*", "value")
    c = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("value"))), F.lit(0))
    out = rows.groupBy("category").agg(F.sum("value").alias("settled"), c(OUTCOMES[0]).alias("satisfied"), c(OUTCOMES[1]).alias("unsatisfied"), c(OUTCOMES[2]).alias("errored"))
    return out.where("settled > 0").withColumn("rate_pct", ratio(F.col("satisfied"), F.col("settled"), 100))


def offers_section(df: DataFrame) -> DataFrame:
    """One row of totals from (series, dimension, value) of wallet_actions, offer_category, offer_outcome."""
    s, d, v = F.col("series"), F.col("dimension"), F.col("value")
    c = lambda cond: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    cls = automation_class(d)
    one = df.agg(
        c(s == "wallet_actions").alias("actions"), c((s == "wallet_actions") & (d == "zoe_offer")).alias("offers"), c((s == "wallet_actions") & (d == "wallet_invocation")).alias("invocations"),
        c((s == "offer_category") & (cls == "automated")).alias("automated"), c((s == "offer_category") & (cls == "interactive")).alias("interactive"),
        c(s == "offer_outcome").alias("settled"), *[c((s == "offer_outcome") & (d == o)).alias(o) for o in OUTCOMES],
    )
    return one.withColumn("unresolved", F.col("offers") - F.col("settled")).withColumn("rate_pct", ratio(F.col("wants_satisfied"), F.col("settled"), 100))


def organic_activity(df: DataFrame, now: tuple, before: tuple) -> DataFrame:
    """One row per window: counts by class, the interactive share of the classified in percent, the unclassified share of all."""
    cls, v = automation_class(F.col("dimension")), F.col("value")
    window = F.when(F.col("day").between(*map(F.lit, now)), "range").when(F.col("day").between(*map(F.lit, before)), "prior")
    c = lambda k: F.coalesce(F.sum(F.when(cls == k, v)), F.lit(0)).alias(k)
    out = df.where("series = 'offer_category'").withColumn("period", window).where("period IS NOT NULL").groupBy("period").agg(c("automated"), c("interactive"), c("unknown"))
    known = F.col("automated") + F.col("interactive")
    return out.withColumn("organic_pct", ratio(F.col("interactive"), known + F.col("unknown"), 100)).withColumn("unknown_pct", ratio(F.col("unknown"), known + F.col("unknown"), 100))


def engagement(df: DataFrame) -> DataFrame:
    """One row: continuing, fresh, unknown offers; the continuing share leaves the unknown out and is cut to two decimals."""
    d, v = F.col("dimension"), F.col("value")
    c = lambda cond: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    one = df.where("series = 'offer_source'").agg(c(d == "continuing").alias("continuing"), c(d.isin("contract", "agoricContract", "purse")).alias("fresh"), c(~d.isin("continuing", "contract", "agoricContract", "purse")).alias("unknown"))
    total = F.col("continuing") + F.col("fresh")
    return one.withColumn("continuing_pct", F.when(total > 0, F.call_function("div", F.col("continuing") * 10000, total) / 100.0))


def resolution_audit(df: DataFrame, n: int = 20) -> DataFrame:
    """(problem, key, times): contracts without a name and makers without a category, the n most frequent. df: instance_id,
    instance, maker, category."""
    p = F.explode(F.array_compact(F.array(
        F.when(F.col("instance_id").isNotNull() & F.col("instance").isNull(), F.struct(F.lit("instance").alias("problem"), F.col("instance_id").alias("key"))),
        F.when(F.col("maker").isNotNull() & (F.col("category") == "other"), F.struct(F.lit("maker").alias("problem"), F.col("maker").alias("key")))))).alias("p")
    return df.select(p).select("p.*").groupBy("problem", "key").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "problem", "key").limit(n)
