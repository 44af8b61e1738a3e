"""Queries over addresses and amounts: participation, pricing, concentration, net flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import buckets, participation, pricing, windows
from . import jobs
from . import proxy as P
from .registry import registry

QUERIES, ORACLES, query = registry()
A, B = P.NOW
C, D = P.BEFORE
LA, LB = P.LEGS
IN_NOW, IN_BEFORE = f"day BETWEEN DATE '{A}' AND DATE '{B}'", f"day BETWEEN DATE '{C}' AND DATE '{D}'"
IN_LEGS = f"day BETWEEN DATE '{LA}' AND DATE '{LB}'"
LDAYS = f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{LA}', TIMESTAMP '{LB}', INTERVAL 1 DAY)) AS DATE) AS day)"
EXCLUDED = ["3", "17", "42"]


def now(df):
    return buckets.range_filter(df, A, B)


def in_legs(df):
    return buckets.range_filter(df, LA, LB)


def leg_days(spark):
    return buckets.dense_days(spark, LA, LB)


def excluded(spark):
    return spark.createDataFrame([(x,) for x in EXCLUDED], "address string")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def priced(spark, d, ranged=True):
    """Legs summed by day, address, denomination and direction, with prices."""
    legs = P.legs(spark, d)
    sums = (in_legs(legs) if ranged else legs).groupBy("day", "address", "denom", "direction").agg(F.sum("amount").alias("amount"))
    return pricing.price_legs(sums, P.denoms(spark), P.prices(spark, d), P.spot(spark, d))


# --- participation


@query("SELECT * FROM p_legs WHERE address NOT IN ('3', '17', '42')")
def exclude_accounts(spark, d):
    return participation.exclude_accounts(P.legs(spark, d), excluded(spark))


@query(f"""SELECT count(DISTINCT address) FILTER (role = 'signer') AS signers, count(DISTINCT address) FILTER (role = 'fee_payer') AS payers, count(DISTINCT address) AS accounts,
(SELECT count(*) FROM (SELECT address FROM p_part WHERE {IN_NOW} GROUP BY 1 HAVING count(DISTINCT day) = 1)) AS single_day, (SELECT count(*) FROM (SELECT address FROM p_part WHERE {IN_NOW} GROUP BY 1 HAVING count(DISTINCT day) > 1)) AS multi_day
FROM p_part WHERE {IN_NOW}""")
def participation_range(spark, d):
    return participation.participation_range(now(P.participant(spark, d)))


@query("SELECT day, count(DISTINCT address) AS accounts FROM p_part GROUP BY 1")
def distinct_per_day(spark, d):
    return participation.distinct_per_day(P.participant(spark, d))


@query(f"SELECT day, coalesce(n, 0) AS accounts FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{A}', TIMESTAMP '{B}', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN (SELECT day, count(DISTINCT address) AS n FROM p_part GROUP BY 1) USING (day)")
def dense_distinct(spark, d):
    return participation.dense_distinct(now(P.participant(spark, d)), buckets.dense_days(spark, A, B))


_RET = f"""SELECT count(*) AS active, count(*) FILTER (address IN (SELECT address FROM p_part WHERE {IN_BEFORE})) AS retained, count(*) FILTER (address NOT IN (SELECT address FROM p_part WHERE day < DATE '{A}')) AS new
FROM (SELECT DISTINCT address FROM p_part WHERE {IN_NOW})"""


@query(_RET)
def retention_counts(spark, d):
    return participation.retention_counts(P.participant(spark, d), P.NOW, P.BEFORE)


@query(f"""WITH c AS ({_RET}), e AS (SELECT count(*) AS active, count(*) FILTER (address IN (SELECT address FROM p_part WHERE day < DATE '{C}')) AS retained FROM (SELECT DISTINCT address FROM p_part WHERE {IN_BEFORE}))
SELECT c.active, c.retained, c.new, round(c.retained * 100.0 / c.active, 6) AS retained_pct, round(c.new * 100.0 / c.active, 6) AS new_pct, round(c.retained * 100.0 / c.active - e.retained * 100.0 / e.active, 6) AS delta_points FROM c, e""")
def retention_shares(spark, d):
    from ..functions.time import prior_window

    p = P.participant(spark, d)
    now_, prior = participation.retention_counts(p, P.NOW, P.BEFORE), participation.retention_counts(p, P.BEFORE, prior_window(C, D))
    return r6(participation.retention_shares(now_, prior), "retained_pct", "new_pct", "delta_points")


@query(f"SELECT address, denom, CAST(sum(amount) AS BIGINT) AS amount FROM p_legs WHERE {IN_LEGS} AND address NOT IN ('3', '17', '42') GROUP BY ALL")
def address_totals(spark, d):
    return participation.address_totals(participation.exclude_accounts(in_legs(P.legs(spark, d)), excluded(spark)))


@query("SELECT day, address, denom, CAST(sum(amount) AS BIGINT) AS amount FROM p_legs GROUP BY ALL")
def address_volume_day(spark, d):
    return participation.address_totals(P.legs(spark, d), daily=True)


@query("SELECT day, signer AS address, denom, CAST(sum(fee) AS BIGINT) AS fee FROM p_tx GROUP BY ALL")
def address_fee_day(spark, d):
    return P.tx(spark, d).groupBy("day", F.col("signer").alias("address"), "denom").agg(F.sum("fee").alias("fee"))


@query("SELECT DISTINCT day, address, role FROM p_part")
def participant_day(spark, d):
    return P.participant(spark, d).dropDuplicates(["day", "address", "role"])


@query(f"SELECT denom, count(DISTINCT address) AS senders FROM p_legs WHERE {IN_LEGS} GROUP BY 1")
def distinct_senders(spark, d):
    return participation.distinct_senders(in_legs(P.legs(spark, d)))


@query("SELECT kind, count(DISTINCT owner) AS wallets FROM p_action GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT owner) FROM p_action")
def offer_wallets(spark, d):
    return participation.offer_wallets(P.action(spark, d))


_CLS = "CASE WHEN category IN ('orchestration', 'oracle', 'fast_usdc') THEN 'automated' WHEN category = 'other' THEN 'unknown' ELSE 'interactive' END"
_CW = f"(SELECT count(DISTINCT owner) FILTER (c = 'interactive') AS interactive, count(DISTINCT owner) FILTER (c = 'automated') AS automated, count(DISTINCT owner) AS \"any\", (SELECT count(*) FROM (SELECT owner FROM (SELECT owner, {_CLS} AS c FROM p_action) WHERE c IN ('interactive', 'automated') GROUP BY 1 HAVING count(DISTINCT c) = 2)) AS both FROM (SELECT owner, {_CLS} AS c FROM p_action))"


def _category_wallets(spark, d):
    from ..operators.offers import automation_class

    return participation.category_wallets(P.action(spark, d).withColumn("class", automation_class(F.col("category"))))


@query(f"SELECT * FROM {_CW}")
def category_wallets(spark, d):
    return _category_wallets(spark, d)


@query(f'SELECT round(interactive * 100.0 / "any", 6) AS organic_wallet_pct FROM {_CW}')
def wallet_weighted_organic(spark, d):
    return _category_wallets(spark, d).select(F.round(numbers.ratio(F.col("interactive"), F.col("any"), 100), 6).alias("organic_wallet_pct"))


# --- pricing


@query("SELECT l.address, l.denom, d.symbol, d.decimals, CAST(sum(amount) AS BIGINT) AS amount FROM p_legs l LEFT JOIN p_denom d USING (denom) GROUP BY ALL")
def enrich_denom(spark, d):
    return pricing.enrich_denom(participation.address_totals(P.legs(spark, d)), P.denoms(spark)).select("address", "denom", "symbol", "decimals", "amount")


@query("SELECT contract, denom, coalesce(symbol, denom) AS label FROM (SELECT DISTINCT contract, denom || '?' AS x, denom FROM p_position) LEFT JOIN (SELECT denom, symbol FROM p_denom WHERE symbol <> 'REO') USING (denom)")
def resolve_instance(spark, d):
    names = P.denoms(spark).where("symbol <> 'REO'").select("denom", "symbol")
    return P.position(spark, d).select("contract", "denom").distinct().join(pricing.small(names), "denom", "left").select("contract", "denom", F.coalesce("symbol", "denom").alias("label"))


@query("SELECT day, address, denom, direction, amount, decimals, price_id, round(usd, 8) AS usd, basis FROM p_priced")
def price_legs(spark, d):
    return priced(spark, d, ranged=False).select("day", "address", "denom", "direction", "amount", "decimals", "price_id", F.round("usd", 8).alias("usd"), "basis")


@query(f"SELECT count(*) FILTER (basis = 'day') AS by_day, count(*) FILTER (basis = 'spot') AS by_spot, count(*) FILTER (basis = 'unpriced') AS unpriced, CASE WHEN by_day > 0 AND by_spot > 0 THEN 'mixed' WHEN by_day > 0 THEN 'daily-close' WHEN by_spot > 0 THEN 'spot-fallback' ELSE 'none' END AS basis FROM (SELECT DISTINCT denom, day, basis FROM p_priced WHERE {IN_LEGS})")
def pricing_meta(spark, d):
    return pricing.pricing_meta(priced(spark, d))


@query(f"SELECT denom, CAST(sum(amount) AS BIGINT) AS amount, round(sum(usd), 2) AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY 1")
def usd_by_denom(spark, d):
    return pricing.usd_by(priced(spark, d), "denom").withColumn("usd", F.round("usd", 2))


@query(f"SELECT direction AS leg, denom, CAST(sum(amount) AS BIGINT) AS amount, round(sum(usd), 2) AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY ALL")
def offer_value_usd(spark, d):
    return pricing.usd_by(priced(spark, d), "direction", "denom").select(F.col("direction").alias("leg"), "denom", "amount", F.round("usd", 2).alias("usd"))


@query(f"SELECT denom, CASE WHEN count(usd) = count(*) THEN round(sum(usd), 2) END AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY 1")
def strict_usd_sum(spark, d):
    return pricing.strict_usd(priced(spark, d), "denom").withColumn("usd", F.round("usd", 2))


@query(f"SELECT DISTINCT i.price_id FROM (SELECT DISTINCT price_id FROM p_denom WHERE price_id IS NOT NULL) i, {LDAYS} d WHERE NOT EXISTS (SELECT 1 FROM p_price p WHERE p.price_id = i.price_id AND p.day = d.day)")
def missing_price_ids(spark, d):
    ids = P.denoms(spark).where("price_id IS NOT NULL").select("price_id").distinct()
    return pricing.missing_price_ids(ids, leg_days(spark), P.prices(spark, d))


@query("SELECT CAST(o_custkey % 5 AS VARCHAR) AS price_id, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS usd FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def bucket_price_points(spark, d):
    o = P.table(spark, d, "orders")
    usd = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan"))).otherwise(-1.0))
    ms = F.unix_millis(F.to_date("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400_000
    return pricing.bucket_price_points(o.select((F.col("o_custkey") % 5).cast("string").alias("price_id"), ms.alias("ms"), usd.alias("usd")))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'id' || CAST(o_custkey % 9 AS VARCHAR) END AS price_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS usd FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'")
def price_rows_valid(spark, d):
    o = P.table(spark, d, "orders")
    bad = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(-F.col("o_totalprice"))).otherwise(F.col("o_totalprice"))
    rows = o.select(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("id"), (F.col("o_custkey") % 9).cast("string"))).alias("price_id"), F.to_date("o_orderdate").alias("day"), bad.alias("usd"))
    return pricing.valid_prices(rows)


@query("SELECT DISTINCT price_id FROM p_denom WHERE coalesce(price_id, '') <> '' AND denom IN (SELECT denom FROM p_tx UNION SELECT denom FROM p_legs) ORDER BY 1")
def configured_price_ids(spark, d):
    used = P.tx(spark, d).select("denom").union(P.legs(spark, d).select("denom")).distinct()
    return P.denoms(spark).join(used, "denom", "left_semi").where("coalesce(price_id, '') <> ''").select("price_id").distinct().orderBy("price_id")


@query(f"SELECT denom, round(sum(usd), 2) AS usd, CAST(row_number() OVER (ORDER BY sum(usd) DESC NULLS LAST, denom) AS INTEGER) AS rank FROM p_priced WHERE {IN_LEGS} GROUP BY 1")
def usd_sort_key(spark, d):
    from pyspark.sql import Window

    each = pricing.usd_by(priced(spark, d), "denom")
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("usd").desc_nulls_last(), "denom")
    return each.select("denom", F.round("usd", 2).alias("usd"), F.row_number().over(w).alias("rank"))


# --- concentration

_ADDR = f"(SELECT address, sum(usd) AS usd FROM (SELECT day, address, sum(usd) AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY ALL HAVING sum(usd) > 0) GROUP BY 1)"
_FEES = "(SELECT signer AS address, CAST(sum(fee) AS DOUBLE) AS usd FROM p_tx GROUP BY 1)"


def fees(spark, d):
    return P.tx(spark, d).groupBy(F.col("signer").alias("address")).agg(F.sum("fee").cast("double").alias("usd"))


@query(f"SELECT address, round(usd, 2) AS usd FROM {_ADDR}")
def address_usd(spark, d):
    return pricing.address_usd(priced(spark, d)).withColumn("usd", F.round("usd", 2))


@query(f"SELECT round(sum(s * s), 8) AS hhi FROM (SELECT usd / sum(usd) OVER () AS s FROM {_ADDR})")
def hhi(spark, d):
    return pricing.hhi(pricing.address_usd(priced(spark, d)), "usd").select(F.round("hhi", 8).alias("hhi"))


@query(f"SELECT round(1 / sum(s * s), 6) AS effective_n FROM (SELECT usd / sum(usd) OVER () AS s FROM {_ADDR})")
def effective_n(spark, d):
    return pricing.hhi(pricing.address_usd(priced(spark, d)), "usd").select(F.round("effective_n", 6).alias("effective_n"))


_TOP = "(SELECT sum(usd) FROM (SELECT usd FROM {0} ORDER BY usd DESC LIMIT 10)) / (SELECT sum(usd) FROM {0})"


@query(f"SELECT round({_TOP.format(_ADDR)}, 8) AS top_share")
def top_n_share(spark, d):
    return pricing.top_n_share(pricing.address_usd(priced(spark, d)), "usd", 10).withColumn("top_share", F.round("top_share", 8))


@query(f"SELECT 'gross' AS basis, round((SELECT sum(s * s) FROM (SELECT usd / sum(usd) OVER () AS s FROM {_ADDR})), 8) AS hhi, round({_TOP.format(_ADDR)}, 8) AS top_share UNION ALL SELECT 'fee', round((SELECT sum(s * s) FROM (SELECT usd / sum(usd) OVER () AS s FROM {_FEES})), 8), round({_TOP.format(_FEES)}, 8)")
def concentration_summary(spark, d):
    def one(basis, df):
        return pricing.hhi(df, "usd").crossJoin(pricing.top_n_share(df, "usd", 10)).select(F.lit(basis).alias("basis"), F.round("hhi", 8).alias("hhi"), F.round("top_share", 8).alias("top_share"))

    return one("gross", pricing.address_usd(priced(spark, d))).unionByName(one("fee", fees(spark, d)))


_DAYADDR = f"(SELECT day, address, sum(usd) AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY ALL HAVING sum(usd) > 0)"


@query(f"""WITH e AS (SELECT day, usd, usd / sum(usd) OVER (PARTITION BY day) AS s, row_number() OVER (PARTITION BY day ORDER BY usd DESC, address) AS r FROM {_DAYADDR})
SELECT g.day, round(sum(s * s), 8) AS hhi, round(sum(s) FILTER (r <= 10), 8) AS top_share FROM {LDAYS} g LEFT JOIN e USING (day) GROUP BY 1""")
def concentration_over_time(spark, d):
    return r8(pricing.concentration_over_time(priced(spark, d), leg_days(spark)), "hhi", "top_share")


def r8(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


@query("SELECT day, round(1 / sum(s * s), 6) AS effective_n FROM (SELECT day, fee / sum(fee) OVER (PARTITION BY day) AS s FROM (SELECT day, signer, CAST(sum(fee) AS DOUBLE) AS fee FROM p_tx GROUP BY ALL)) GROUP BY 1")
def effective_n_daily(spark, d):
    each = P.tx(spark, d).groupBy("day", "signer").agg(F.sum("fee").cast("double").alias("fee"))
    return pricing.hhi(each, "fee", "day").select("day", F.round("effective_n", 6).alias("effective_n"))


# --- net flow

_ASSETS = f"""(SELECT denom, CAST(coalesce(sum(amount) FILTER (direction = 'in'), 0) AS BIGINT) AS amount_in, CAST(coalesce(sum(amount) FILTER (direction = 'out'), 0) AS BIGINT) AS amount_out, sum(usd) FILTER (direction = 'in') AS usd_in, sum(usd) FILTER (direction = 'out') AS usd_out,
CASE WHEN count(usd) > 0 THEN coalesce(sum(usd) FILTER (direction = 'in'), 0) - coalesce(sum(usd) FILTER (direction = 'out'), 0) END AS net_usd FROM p_priced WHERE {IN_LEGS} GROUP BY 1)"""


@query(f"SELECT denom, amount_in, amount_out, amount_in - amount_out AS net, round(usd_in, 2) AS usd_in, round(usd_out, 2) AS usd_out, round(net_usd, 2) AS net_usd FROM {_ASSETS}")
def net_flow_by_asset(spark, d):
    out = pricing.order_assets(pricing.net_flow_by_asset(priced(spark, d)))
    return out.withColumns({c: F.round(c, 2) for c in ("usd_in", "usd_out", "net_usd")})


@query(f"SELECT round(sum(net_usd), 2) AS net_usd, round(sum(usd_in), 2) AS usd_in, round(sum(usd_out), 2) AS usd_out, count(*) AS assets, count(net_usd) AS priced FROM {_ASSETS}")
def net_flow_headline(spark, d):
    return pricing.net_flow_headline(pricing.net_flow_by_asset(priced(spark, d))).withColumns({c: F.round(c, 2) for c in ("net_usd", "usd_in", "usd_out")})


@query(f"SELECT g.day, round(CASE WHEN count(p.day) = 0 THEN 0.0 ELSE sum(CASE WHEN direction = 'in' THEN usd ELSE -usd END) END) AS net_usd FROM {LDAYS} g LEFT JOIN p_priced p USING (day) GROUP BY 1")
def net_flow_daily(spark, d):
    return pricing.net_flow_daily(priced(spark, d), leg_days(spark)).withColumn("net_usd", F.round("net_usd"))


@query(f"""SELECT day, denom, CAST(coalesce(sum(amount) FILTER (direction = 'in'), 0) AS BIGINT) AS amount_in, CAST(coalesce(sum(amount) FILTER (direction = 'out'), 0) AS BIGINT) AS amount_out, amount_in - amount_out AS net
FROM p_priced WHERE {IN_LEGS} AND denom IN (SELECT denom FROM {_ASSETS} ORDER BY abs(net_usd) DESC NULLS LAST, greatest(amount_in, amount_out) DESC, denom LIMIT 5) GROUP BY ALL""")
def top_assets_series(spark, d):
    p = priced(spark, d)
    return pricing.top_assets_series(p, pricing.net_flow_by_asset(p))


@query(f"SELECT address, denom, round(usd, 2) AS usd FROM (SELECT address, denom, sum(usd) AS usd FROM p_priced WHERE {IN_LEGS} GROUP BY ALL) WHERE usd IS NOT NULL ORDER BY p_rank(usd) LIMIT 10".replace("ORDER BY p_rank(usd)", "ORDER BY usd DESC, address, denom"))
def top_k(spark, d):
    each = priced(spark, d).groupBy("address", "denom").agg(F.sum("usd").alias("usd")).where("usd IS NOT NULL")
    return each.orderBy(F.desc("usd"), "address", "denom").limit(10).withColumn("usd", F.round("usd", 2))


@query(f"SELECT day, accounts, round(CASE WHEN n >= 7 AND sd > 1e-9 THEN (accounts - m) / sd END, 6) AS z FROM (SELECT *, avg(accounts) OVER w AS m, stddev_pop(accounts) OVER w AS sd, count(accounts) OVER w AS n FROM (SELECT day, count(DISTINCT address) AS accounts FROM p_part GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))")
def job_q1_busier(spark, d):
    """Accounts per day with the score of each day."""
    each = participation.distinct_per_day(P.participant(spark, d)).withColumn("series", F.lit("accounts"))
    return windows.trailing_zscore(each, value="accounts").select("day", "accounts", F.round("z", 6).alias("z"))


@query(f"""WITH a AS (SELECT address, count(DISTINCT day) AS days FROM p_part WHERE {IN_NOW} GROUP BY 1), r AS ({_RET})
SELECT 'accounts' AS part, 'all' AS key, count(*) AS n FROM a UNION ALL SELECT 'accounts', 'single_day', count(*) FROM a WHERE days = 1 UNION ALL SELECT 'daily', CAST(day AS VARCHAR), count(DISTINCT address) FROM p_part WHERE {IN_NOW} GROUP BY day
UNION ALL SELECT 'retention', 'retained', retained FROM r UNION ALL SELECT 'retention', 'new', new FROM r""")
def job_participation(spark, d):
    parts = jobs.participation_report(P.participant(spark, d), priced(spark, d, ranged=False), A, B)
    long = lambda part, key, n: parts[part].select(F.lit(part).alias("part"), key.alias("key"), n.alias("n"))
    rows = [long("accounts", F.lit("all"), F.col("accounts")), long("accounts", F.lit("single_day"), F.col("single_day")), long("daily", F.col("day").cast("string"), F.col("accounts")), long("retention", F.lit("retained"), F.col("retained")), long("retention", F.lit("new"), F.col("new"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
