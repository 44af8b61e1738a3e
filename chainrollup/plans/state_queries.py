"""Queries over offers, latest-state tables, landings, provisioning, and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import kpis, offers, pricing, state, windows
from ..sources import store
from . import jobs
from . import proxy as P
from .people_queries import _ASSETS
from .registry import registry

QUERIES, ORACLES, query = registry()
A, B = P.NOW
C, D = P.BEFORE
LA, LB = P.LEGS
IN_NOW, IN_BEFORE = f"day BETWEEN DATE '{A}' AND DATE '{B}'", f"day BETWEEN DATE '{C}' AND DATE '{D}'"
IN_LEGS = f"day BETWEEN DATE '{LA}' AND DATE '{LB}'"
_CLS = "CASE WHEN category IN ('orchestration', 'oracle', 'fast_usdc') THEN 'automated' WHEN category = 'other' THEN 'unknown' ELSE 'interactive' END"
NAMES = ["ATOM-USD price feed", "scaledPriceAuthority-x", "economicCommittee", "VaultFactory", "psm-IST-USDC", "auctioneer", "fastUsdc", "ymax0", "Crabble", None]
MAKERS = ["PushPrice", "SettleTransaction", "SimpleRebalance", "constructor", "__proto__", None, "SubmitEvidence"]


def _pick(names, k):
    return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), k.cast("int") + 1)


def _case(names, k):
    return "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n is not None) + " END"


def named_actions(spark, d):
    a = P.action(spark, d)
    k = F.col("k")
    return a.select("event_id", "day", "owner", "kind", _pick(NAMES, k % 10).alias("instance"), _pick(MAKERS, k % 7).alias("maker"), F.when(k % 4 == 0, "evmWalletHandler").otherwise("planner").alias("target"), F.concat(F.lit("board"), (k % 10).cast("string")).alias("instance_id"))


_NAMED = f"(SELECT event_id, day, owner, kind, {_case(NAMES, 'k % 10')} AS instance, {_case(MAKERS, 'k % 7')} AS maker, CASE WHEN k % 4 = 0 THEN 'evmWalletHandler' ELSE 'planner' END AS target, 'board' || CAST(k % 10 AS VARCHAR) AS instance_id FROM p_action)"
_BYNAME = "CASE k % 10 WHEN 0 THEN 'oracle' WHEN 1 THEN 'oracle' WHEN 2 THEN 'governance' WHEN 3 THEN 'vaults' WHEN 4 THEN 'psm' WHEN 5 THEN 'auction' WHEN 6 THEN 'fast_usdc' WHEN 7 THEN 'ymax' WHEN 8 THEN 'other' ELSE CASE k % 7 WHEN 0 THEN 'oracle' WHEN 1 THEN 'fast_usdc' WHEN 2 THEN 'ymax' WHEN 6 THEN 'fast_usdc' ELSE 'other' END END"
_CATEGORY = f"CASE WHEN kind = 'wallet_invocation' THEN CASE WHEN k % 4 = 0 THEN 'ymax' ELSE 'orchestration' END ELSE {_BYNAME} END"


@query(f"SELECT event_id, {_CATEGORY} AS category FROM p_action")
def offer_category(spark, d):
    a = named_actions(spark, d)
    return a.select("event_id", offers.offer_category(F.col("kind"), F.col("instance"), F.col("maker"), F.col("target")).alias("category"))


@query(f"SELECT event_id, {_CLS} AS class FROM p_action")
def automation_class(spark, d):
    return P.action(spark, d).select("event_id", offers.automation_class(F.col("category")).alias("class"))


@query("SELECT event_id, category || '|' || outcome AS dim, CASE WHEN k % 5 <> 0 THEN category END AS category, CASE WHEN k % 5 <> 0 THEN outcome END AS outcome FROM p_action")
def outcome_dim(spark, d):
    a = P.action(spark, d).withColumn("dim", offers.outcome_dim(F.col("category"), F.col("outcome")))
    parsed = offers.parse_outcome_dim(F.when(F.col("k") % 5 == 0, F.concat(F.lit("x"), F.col("dim"))).otherwise(F.col("dim")))
    return a.withColumn("p", parsed).select("event_id", "dim", "p.category", "p.outcome")


@query("SELECT event_id, left(repeat(category, 80), 512) AS dim FROM p_action")
def clamp_dim(spark, d):
    return P.action(spark, d).select("event_id", offers.clamp_dim(F.repeat("category", 80)).alias("dim"))


@query("SELECT DISTINCT day, owner, kind FROM p_action UNION SELECT DISTINCT day, owner, category FROM p_action")
def offer_participant_day(spark, d):
    a = P.action(spark, d)
    both = a.select("day", "owner", F.explode(F.array("kind", "category")).alias("kind"))
    return both.dropDuplicates(["day", "owner", "kind"])


def series_rows(spark, d):
    """(day, series, dimension, value) of actions, categories, sources and outcomes, each action read once."""
    a = P.action(spark, d)
    src = _pick(["continuing", "contract", "agoricContract", "odd"], F.col("k") % 4)
    settled = F.col("k") % 4 != 0
    rows = a.select("day", F.explode(F.array_compact(F.array(
        F.struct(F.lit("wallet_actions").alias("series"), F.col("kind").alias("dimension")), F.struct(F.lit("offer_category").alias("series"), F.col("category").alias("dimension")),
        F.when(F.col("kind") == "zoe_offer", F.struct(F.lit("offer_source").alias("series"), src.alias("dimension"))), F.when((F.col("kind") == "zoe_offer") & settled, F.struct(F.lit("offer_outcome").alias("series"), F.col("outcome").alias("dimension"))),
        F.when(settled, F.struct(F.lit("offer_outcome_category").alias("series"), F.concat_ws("|", "category", "outcome").alias("dimension")))))).alias("m"))
    return rows.groupBy("day", "m.series", "m.dimension").agg(F.count(F.lit(1)).alias("value"))


_SRC = _case(["continuing", "contract", "agoricContract", "odd"], "k % 4")
_OFF = "kind = 'zoe_offer'"


@query(f"""SELECT count(*) AS actions, count(*) FILTER ({_OFF}) AS offers, count(*) FILTER (kind = 'wallet_invocation') AS invocations, count(*) FILTER ({_CLS} = 'automated') AS automated, count(*) FILTER ({_CLS} = 'interactive') AS interactive,
count(*) FILTER ({_OFF} AND k % 4 <> 0) AS settled, {", ".join(f"count(*) FILTER ({_OFF} AND k % 4 <> 0 AND outcome = '{o}') AS {o}" for o in P.OUTS)}, offers - settled AS unresolved, round(wants_satisfied * 100.0 / settled, 6) AS rate_pct FROM p_action""")
def offers_section(spark, d):
    return offers.offers_section(series_rows(spark, d)).withColumn("rate_pct", F.round("rate_pct", 6))


@query(f"""SELECT 'offer_category' AS series, category AS dimension, count(*) AS value, {_CLS} AS class FROM p_action GROUP BY ALL UNION ALL SELECT 'offer_source', {_SRC}, count(*), NULL FROM p_action WHERE {_OFF} GROUP BY ALL""")
def offer_breakdowns(spark, d):
    rows = series_rows(spark, d).where("series IN ('offer_category', 'offer_source')").groupBy("series", "dimension").agg(F.sum("value").alias("value")).where("value > 0")
    cls = F.when(F.col("series") == "offer_category", offers.automation_class(F.col("dimension")))
    return rows.withColumn("class", cls).orderBy("series", F.desc("value"), "dimension")


@query(f"SELECT count(*) FILTER (k % 4 = 0) AS continuing, count(*) FILTER (k % 4 IN (1, 2)) AS fresh, count(*) FILTER (k % 4 = 3) AS unknown, (continuing * 10000 // (continuing + fresh)) / 100.0 AS continuing_pct FROM p_action WHERE {_OFF}")
def offer_engagement(spark, d):
    return offers.engagement(series_rows(spark, d))


@query("SELECT category, count(*) AS settled, count(*) FILTER (outcome = 'wants_satisfied') AS satisfied, count(*) FILTER (outcome = 'wants_unsatisfied') AS unsatisfied, count(*) FILTER (outcome = 'errored') AS errored, round(satisfied * 100.0 / settled, 6) AS rate_pct FROM p_action WHERE k % 4 <> 0 GROUP BY 1")
def outcomes_by_category(spark, d):
    dims = kpis.dimension_totals(series_rows(spark, d), ["offer_outcome_category"]).withColumnRenamed("total", "value")
    return offers.outcomes_by_category(dims).withColumn("rate_pct", F.round("rate_pct", 6))


_ORG = f"""(SELECT period, count(*) FILTER (c = 'automated') AS automated, count(*) FILTER (c = 'interactive') AS interactive, count(*) FILTER (c = 'unknown') AS unknown, count(*) AS n
FROM (SELECT {_CLS} AS c, CASE WHEN {IN_NOW} THEN 'range' WHEN {IN_BEFORE} THEN 'prior' END AS period FROM p_action) WHERE period IS NOT NULL GROUP BY 1)"""


@query(f"SELECT period, automated, interactive, unknown, round(interactive * 100.0 / n, 6) AS organic_pct, round(unknown * 100.0 / n, 6) AS unknown_pct FROM {_ORG}")
def organic_activity(spark, d):
    return offers.organic_activity(series_rows(spark, d), P.NOW, P.BEFORE).withColumns({c: F.round(c, 6) for c in ("organic_pct", "unknown_pct")})


@query(f"SELECT period, round((interactive + unknown) * 100.0 / n, 6) AS upper_pct FROM {_ORG}")
def organic_bound(spark, d):
    return offers.organic_activity(series_rows(spark, d), P.NOW, P.BEFORE).select("period", F.round(F.col("organic_pct") + F.col("unknown_pct"), 6).alias("upper_pct"))


_AUDIT = f"""SELECT problem, key, count(*) AS times FROM (SELECT 'instance' AS problem, instance_id AS key FROM {_NAMED} WHERE instance IS NULL UNION ALL
SELECT 'maker', maker FROM {_NAMED} n JOIN (SELECT event_id, {_CATEGORY} AS category FROM p_action) c USING (event_id) WHERE maker IS NOT NULL AND category = 'other') GROUP BY ALL ORDER BY times DESC, problem, key LIMIT 20"""


@query(_AUDIT)
def resolution_audit(spark, d):
    a = named_actions(spark, d)
    return offers.resolution_audit(a.withColumn("category", offers.offer_category(F.col("kind"), F.col("instance"), F.col("maker"), F.col("target"))))


@query("SELECT * FROM (SELECT owner, n, CAST(rank() OVER (ORDER BY n DESC, owner) AS INTEGER) AS place FROM (SELECT owner, count(*) AS n FROM p_action GROUP BY 1)) WHERE place <= 10")
def limits_top_owners(spark, d):
    from pyspark.sql import Window

    top = P.action(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "owner").limit(10)
    return top.withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "owner")))


# --- positions and flows


@query("SELECT contract, protocol, chain, denom, CAST(sum(total_in - total_out) AS BIGINT) AS principal, count(*) AS positions, count(DISTINCT portfolio) AS portfolios, max(height) AS height FROM p_position WHERE total_in >= total_out GROUP BY ALL")
def principal_by_venue(spark, d):
    return state.principal_by_venue(P.position(spark, d))


@query("SELECT count(*) AS with_positions, count(*) FILTER (s > 0) AS active, (SELECT count(*) FROM (SELECT DISTINCT contract, portfolio FROM p_pos_rows)) AS total FROM (SELECT contract, portfolio, sum(CASE WHEN total_in >= total_out THEN total_in - total_out ELSE 0 END) AS s FROM p_position GROUP BY ALL)")
def portfolio_counts(spark, d):
    return state.portfolio_counts(P.position(spark, d), P.position_rows(spark, d).select("contract", "portfolio").distinct())


@query("SELECT denom, CAST(sum(total_out - total_in) AS BIGINT) AS excess, count(*) AS positions FROM p_position WHERE total_out > total_in GROUP BY 1")
def quarantined_positions(spark, d):
    return state.quarantined_positions(P.position(spark, d))


@query("SELECT * FROM p_position WHERE height < (SELECT max(height) FROM p_position) - 500")
def stale_rows(spark, d):
    return state.stale_rows(P.position(spark, d), 500)


@query("SELECT denom, count(*) AS positions, CAST(sum(total_in - total_out) AS BIGINT) AS principal FROM p_position WHERE total_in >= total_out AND height < (SELECT max(height) FROM p_position WHERE total_in >= total_out) - 500 GROUP BY 1")
def stale_positions(spark, d):
    rows = state.stale_rows(state.counted_positions(P.position(spark, d)), 500)
    return rows.groupBy("denom").agg(F.count(F.lit(1)).alias("positions"), F.sum(F.col("total_in") - F.col("total_out")).alias("principal"))


_FLOW = "(SELECT flow_id, coalesce(arg_min(flow_type, height) FILTER (flow_type IS NOT NULL), 'unknown') AS flow_type, arg_min(denom, height) FILTER (denom IS NOT NULL) AS denom, arg_min(amount, height) FILTER (amount IS NOT NULL) AS amount, min(day) AS day FROM p_flow_rows GROUP BY 1)"


def _flows(spark, d):
    return store.merge_flow(P.flow_rows(spark, d), ["flow_id"])


@query(f"SELECT flow_type, denom, count(*) AS flows, CAST(sum(amount) AS BIGINT) AS amount FROM {_FLOW} WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' GROUP BY ALL")
def flows_in_range(spark, d):
    from datetime import date

    return state.flows_in_range(_flows(spark, d), date(1995, 1, 1), date(1995, 6, 30))


@query(f"SELECT flow_id, flow_type, day FROM {_FLOW}")
def flow_state(spark, d):
    return _flows(spark, d).select("flow_id", "flow_type", "day")


@query(f"""SELECT round(sum(CASE flow_type WHEN 'deposit' THEN usd WHEN 'withdraw' THEN -usd END), 2) AS net_usd FROM (SELECT f.*, f.amount / pow(10, n.decimals) * coalesce(p.usd, s.usd) AS usd FROM {_FLOW} f LEFT JOIN p_denom n USING (denom) LEFT JOIN p_price p ON p.price_id = n.price_id AND p.day = f.day LEFT JOIN p_spot s ON s.price_id = n.price_id)""")
def net_deposits_usd(spark, d):
    priced = pricing.price_legs(_flows(spark, d), P.denoms(spark), P.prices(spark, d), P.spot(spark, d))
    return state.net_deposits_usd(priced).withColumn("net_usd", F.round("net_usd", 2))


_VENUE = "(SELECT v.*, principal / pow(10, n.decimals) * s.usd AS usd FROM (SELECT contract, protocol, chain, denom, sum(total_in - total_out) AS principal, count(*) AS positions FROM p_position WHERE total_in >= total_out GROUP BY ALL) v LEFT JOIN p_denom n USING (denom) LEFT JOIN p_spot s ON s.price_id = n.price_id)"


def venues(spark, d):
    v = state.principal_by_venue(P.position(spark, d)).withColumn("amount", F.col("principal")).withColumn("day", F.lit(None).cast("date"))
    return pricing.price_legs(v, P.denoms(spark), P.prices(spark, d), P.spot(spark, d))


@query(f"SELECT contract, CAST(sum(positions) AS BIGINT) AS positions, round(sum(usd), 2) AS usd, count(*) FILTER (usd IS NULL) AS unpriced, round(sum(usd) * 100.0 / (SELECT sum(usd) FROM {_VENUE} WHERE principal > 0), 6) AS share_pct FROM {_VENUE} WHERE principal > 0 GROUP BY 1")
def contract_split(spark, d):
    return state.contract_split(venues(spark, d)).withColumns({"usd": F.round("usd", 2), "share_pct": F.round("share_pct", 6)})


@query(f"SELECT CASE WHEN count(*) >= 3 AND count(usd) = count(*) THEN round((SELECT sum(usd) FROM (SELECT usd FROM {_VENUE} ORDER BY usd DESC LIMIT 2)) / sum(usd), 8) END AS top_two_share FROM {_VENUE}")
def top_two_venue_share(spark, d):
    return state.top_two_venue_share(venues(spark, d)).withColumn("top_two_share", F.round("top_two_share", 8))


# --- landings and provisioning


@query("SELECT day, count(*) AS installs, CAST(coalesce(sum(storage_fee), 0) AS BIGINT) AS storage_fee, CAST(sum(gas_fee) AS BIGINT) AS gas_fee, count(*) FILTER (storage_fee IS NULL) AS ambiguous FROM p_landing GROUP BY 1")
def landings_daily(spark, d):
    return state.landings_daily(P.landing(spark, d))


@query("SELECT count(*) AS installs, CAST(sum(storage_fee) AS BIGINT) AS storage_fee, CAST(sum(gas_fee) AS BIGINT) AS gas_fee, count(DISTINCT installer) AS installers, count(DISTINCT day) AS days, round(sum(storage_fee) * 100.0 / (sum(storage_fee) + 123456789), 6) AS storage_share_pct FROM p_landing")
def landings_summary(spark, d):
    return state.landings_summary(P.landing(spark, d), 123_456_789).withColumn("storage_share_pct", F.round("storage_share_pct", 6))


@query("SELECT CAST(sum(n_new) AS BIGINT) AS n_new, CAST(sum(n_minted) AS BIGINT) AS n_minted, count(*) FILTER (abs(rate - 10000000) > 100000) AS days_off_fee, count(rate) AS days_checked, max(wallets) AS wallets, max(minted) AS minted FROM p_diff")
def provisioning_summary(spark, d):
    return state.provisioning_summary(windows.snapshot_diff(P.snapshot(spark, d), 10_000_000))


@query(f"SELECT * FROM p_snap WHERE {IN_LEGS} OR day = (SELECT max(day) FROM p_snap WHERE day < DATE '{LA}')")
def prior_snapshot(spark, d):
    return state.with_prior_snapshot(P.snapshot(spark, d), LA, LB)


def _control(spark):
    return spark.createDataFrame([("pool", 700), ("other", 10)], "job string, last_height long")


@query("SELECT max(day) AS covered_through FROM p_snap WHERE height <= 700")
def covered_through_height(spark, d):
    return state.covered_through(P.snapshot(spark, d), _control(spark), "pool")


@query("SELECT max(day) AS covered_through, CASE WHEN max(day) IS NULL THEN 'not-backfilled' WHEN max(day) < DATE '1999-01-01' THEN 'range-exceeds-coverage' ELSE 'available' END AS status FROM p_snap WHERE height <= 700")
def availability(spark, d):
    from datetime import date

    return state.availability(state.covered_through(P.snapshot(spark, d), _control(spark), "pool"), date(1999, 1, 1))


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, bool_or(o_orderstatus = 'F') AS answered FROM orders GROUP BY 1) SELECT min(day) AS cutoff FROM a WHERE NOT answered AND day > (SELECT min(day) FROM a WHERE answered)")
def coverage_cutoff(spark, d):
    rows = P.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("answered"))
    return state.coverage_cutoff(rows)


@query("SELECT height, code FROM p_tx WHERE height > 700")
def resume_guard(spark, d):
    return store.resume_guard(P.tx(spark, d), _control(spark), "pool").select("height", "code")


@query("SELECT 'P' || CAST(p_partkey % 200 AS VARCHAR) AS denom, CASE WHEN min(p_partkey) % 3 = 0 THEN 'missing-locally' WHEN min(p_partkey) % 5 = 0 THEN 'unknown' WHEN min(p_partkey) % 4 = 0 THEN 'agreed' ELSE 'decimals-differ' END AS status FROM part GROUP BY 1")
def registry_drift(spark, d):
    return state.registry_drift(*registries(spark, d))


def registries(spark, d):
    """(local, chain) entries of denominations."""
    p = P.table(spark, d, "part")
    name = F.concat(F.lit("P"), (F.col("p_partkey") % 200).cast("string"))
    first = p.groupBy(name.alias("denom")).agg(F.min("p_partkey").alias("k"))
    chain = first.select("denom", F.when(F.col("k") % 5 != 0, F.lit(6)).alias("decimals"))
    local = first.where("k % 3 <> 0").select("denom", F.explode(F.array(F.struct(F.when(F.col("k") % 4 == 0, 6).otherwise(8).alias("decimals"), F.lit(0).alias("pos")), F.struct(F.lit(6).alias("decimals"), F.lit(1).alias("pos")))).alias("e")).select("denom", "e.decimals", "e.pos")
    return local, chain


@query("SELECT height, code, fee FROM p_tx WHERE code = 0")
def success_only(spark, d):
    return P.tx(spark, d).where("code = 0").select("height", "code", "fee")


@query(f"SELECT * FROM (VALUES (DATE '2024-01-18', 'fees'), (DATE '2024-01-25', 'ibc')) AS v(day, rule) WHERE {IN_NOW} AND day <= (SELECT max(CAST(ts AS DATE)) FROM events)")
def methodology_changes_in_range(spark, d):
    from datetime import date

    rules = spark.createDataFrame([(date(2024, 1, 3), "gas"), (date(2024, 1, 18), "fees"), (date(2024, 1, 25), "ibc")], "day date, rule string")
    last = P.table(spark, d, "events").agg(F.max(F.to_date("ts")).alias("last"))
    return rules.where(F.col("day").between(F.lit(A), F.lit(B))).crossJoin(F.broadcast(last)).where("day <= last").select("day", "rule")


@query("SELECT denom, symbol, CASE WHEN n > 1 THEN symbol || ' (' || origin || ')' ELSE symbol END AS label FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT CAST(p_partkey % 40 AS VARCHAR) AS denom, 'S' || CAST(p_partkey % 40 % 25 AS VARCHAR) AS symbol, CASE WHEN p_partkey % 40 < 25 THEN 'Hub' ELSE 'Bridge' END AS origin FROM part))")
def disambiguate_labels(spark, d):
    from ..functions.denoms import disambiguate_labels as labels

    k = F.col("p_partkey") % 40
    rows = P.table(spark, d, "part").select(k.cast("string").alias("denom"), F.concat(F.lit("S"), (k % 25).cast("string")).alias("symbol"), F.when(k < 25, "Hub").otherwise("Bridge").alias("origin")).distinct()
    return labels(rows).select("denom", "symbol", "label")


@query(f"SELECT count(*) AS actions, round(count(*) FILTER ({_CLS} = 'interactive') * 100.0 / count(*), 6) AS organic_pct, round(count(*) FILTER (k % 4 <> 0 AND outcome = 'wants_satisfied') * 100.0 / count(*) FILTER (k % 4 <> 0), 6) AS satisfied_pct FROM p_action WHERE {IN_NOW}")
def job_q2_organic(spark, d):
    rows = series_rows(spark, d).where(F.col("day").between(F.lit(A), F.lit(B)))
    n = kpis.sum_series(rows, "wallet_actions").withColumnRenamed("total", "actions")
    o = offers.organic_activity(rows, P.NOW, P.BEFORE).select(F.round("organic_pct", 6).alias("organic_pct"))
    s = offers.outcomes_by_category(kpis.dimension_totals(rows, ["offer_outcome_category"]).withColumnRenamed("total", "value")).agg(F.round(numbers.ratio(F.sum("satisfied"), F.sum("settled"), 100), 6).alias("satisfied_pct"))
    return n.crossJoin(o).crossJoin(s)


_CHECKS = f"""SELECT 'parity' AS "check", 'click/3' AS key, CAST(sum(value) AS VARCHAR) AS expected, CAST(sum(value) + count(DISTINCT day) AS VARCHAR) AS found FROM p_day WHERE series = 'click' AND dimension = '3'
UNION ALL SELECT 'registry', denom, 'agreed', status FROM (SELECT 'P' || CAST(p_partkey % 200 AS VARCHAR) AS denom, CASE WHEN min(p_partkey) % 3 = 0 THEN 'missing-locally' WHEN min(p_partkey) % 5 = 0 THEN 'unknown' WHEN min(p_partkey) % 4 = 0 THEN 'agreed' ELSE 'decimals-differ' END AS status FROM part GROUP BY 1) WHERE status <> 'agreed'
UNION ALL SELECT 'unresolved ' || problem, key, '0', CAST(times AS VARCHAR) FROM ({_AUDIT})"""


@query(_CHECKS)
def job_verify(spark, d):
    """Over a daily table in which one is added to each day of a dimension; the replay agrees with it but there."""
    days = P.metric_day(spark, d)
    planted = days.withColumn("value", F.col("value") + ((F.col("series") == "click") & (F.col("dimension") == "3")).cast("long"))
    local, chain = registries(spark, d)
    a = named_actions(spark, d)
    a = a.withColumn("category", offers.offer_category(F.col("kind"), F.col("instance"), F.col("maker"), F.col("target")))
    return jobs.verify(P.metric_hour(spark, d), planted, planted, local, chain, a)


_LANDED = f"(SELECT * FROM p_landing WHERE {IN_LEGS})"
_PRIOR_LEGS = f"day BETWEEN DATE '{P.LEGS_BEFORE[0]}' AND DATE '{P.LEGS_BEFORE[1]}'"


def _period(where):
    return f"(SELECT DISTINCT signer FROM p_tx WHERE {where})"


@query(f"""SELECT round(1 / (SELECT sum(s * s) FROM (SELECT fee / sum(fee) OVER () AS s FROM (SELECT signer, CAST(sum(fee) AS DOUBLE) AS fee FROM p_tx WHERE {IN_LEGS} GROUP BY 1))), 6) AS effective_n,
(SELECT count(*) FROM {_period(IN_LEGS)}) AS active, (SELECT count(*) FROM {_period(IN_LEGS)} WHERE signer IN (SELECT signer FROM p_tx WHERE {_PRIOR_LEGS})) AS retained, (SELECT count(*) FROM {_period(IN_LEGS)} WHERE signer NOT IN (SELECT signer FROM p_tx WHERE day < DATE '{LA}')) AS new,
(SELECT CAST(coalesce(sum(n_new), 0) AS BIGINT) FROM p_diff WHERE {IN_LEGS}) AS n_new, (SELECT CAST(coalesce(sum(n_minted), 0) AS BIGINT) FROM p_diff WHERE {IN_LEGS}) AS n_minted, (SELECT max(wallets) FROM p_snap WHERE {IN_LEGS}) AS wallets,
(SELECT count(*) FROM {_LANDED}) AS installs, (SELECT CAST(coalesce(sum(storage_fee), 0) AS BIGINT) FROM {_LANDED}) AS install_storage_fee, (SELECT count(DISTINCT installer) FROM {_LANDED}) AS installers""")
def job_q4_base(spark, d):
    t = P.tx(spark, d)
    people = t.select("day", F.col("signer").alias("address"), F.lit("fee_payer").alias("role"))
    fees = t.select("day", F.col("signer").alias("address"), F.col("fee").cast("double").alias("usd"))
    return jobs.base(people, fees, P.snapshot(spark, d), P.landing(spark, d), LA, LB, 10_000_000).withColumn("effective_n", F.round("effective_n", 6))


_FLOWS_NOW = f"(SELECT f.*, f.amount / pow(10, n.decimals) * coalesce(p.usd, s.usd) AS usd FROM {_FLOW} f LEFT JOIN p_denom n USING (denom) LEFT JOIN p_price p ON p.price_id = n.price_id AND p.day = f.day LEFT JOIN p_spot s ON s.price_id = n.price_id WHERE f.day BETWEEN DATE '{LA}' AND DATE '{LB}')"


@query(f"""SELECT (SELECT round(sum(net_usd)) FROM {_ASSETS}) AS net_flow_usd, (SELECT count(net_usd) FROM {_ASSETS}) AS priced_assets, count(*) AS venues, round(sum(usd)) AS principal_usd,
CASE WHEN count(*) >= 3 AND count(usd) = count(*) THEN round((SELECT sum(usd) FROM (SELECT usd FROM {_VENUE} ORDER BY usd DESC LIMIT 2)) / sum(usd), 8) END AS top_two_share,
(SELECT count(*) FROM {_FLOWS_NOW}) AS flows, (SELECT round(sum(CASE flow_type WHEN 'deposit' THEN usd WHEN 'withdraw' THEN -usd END)) FROM {_FLOWS_NOW}) AS net_deposits_usd,
(SELECT count(*) FROM p_position WHERE total_out > total_in) AS quarantined, (SELECT count(*) FROM p_position WHERE height < (SELECT max(height) FROM p_position) - 500) AS stale FROM {_VENUE}""")
def job_q3_value_flow(spark, d):
    from .people_queries import priced

    flows = pricing.price_legs(_flows(spark, d), P.denoms(spark), P.prices(spark, d), P.spot(spark, d))
    out = jobs.value_flow(priced(spark, d), venues(spark, d), P.position(spark, d), flows, LA, LB, 500)
    return out.withColumns({c: F.round(c) for c in ("net_flow_usd", "principal_usd", "net_deposits_usd")} | {"top_two_share": F.round("top_two_share", 8)})
