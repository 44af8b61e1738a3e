"""Queries over rolled-up metrics: buckets, key figures, dense and aligned series, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, time
from ..operators import buckets, kpis, offers, state, windows
from ..sources import export, store
from . import jobs
from . import proxy as P
from .registry import registry

QUERIES, ORACLES, query = registry()
A, B = P.NOW
C, D = P.BEFORE
IN_NOW, IN_BEFORE = f"day BETWEEN DATE '{A}' AND DATE '{B}'", f"day BETWEEN DATE '{C}' AND DATE '{D}'"
DAYS = f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{A}', TIMESTAMP '{B}', INTERVAL 1 DAY)) AS DATE) AS day)"
H = "strftime(hour, '%Y-%m-%d %H:00')"


def now(df):
    return buckets.range_filter(df, A, B)


def days(spark):
    return buckets.dense_days(spark, A, B)


def floors(spark):
    return spark.createDataFrame(list(P.FLOORS.items()), "series string, floor timestamp")


def hour_text(c="hour"):
    return F.date_format(c, "yyyy-MM-dd HH:00")


def big(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query(f"SELECT {H} AS hour, series, dimension, CAST(sum(delta) AS BIGINT) AS value FROM p_delta WHERE delta <> 0 GROUP BY ALL")
def rollup(spark, d):
    return kpis.rollup_hours(P.deltas(spark, d)).withColumn("hour", hour_text())


@query("SELECT day, series, dimension, CAST(sum(delta) AS BIGINT) AS value FROM p_delta GROUP BY ALL")
def rollup_days(spark, d):
    return kpis.rollup_days(kpis.rollup_hours(P.deltas(spark, d)))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def day_utc(spark, d):
    return P.table(spark, d, "events").select("event_id", time.day_utc(F.col("ts")).alias("day"))


@query("SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour FROM events")
def hour_utc(spark, d):
    return P.table(spark, d, "events").select("event_id", hour_text(time.hour_utc(F.col("ts"))).alias("hour"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) AS week FROM orders")
def week_bucket(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", time.week_bucket(F.col("o_orderdate")).alias("week"))


@query("SELECT CAST(date_trunc('week', hour) AS DATE) AS bucket, series, dimension, CAST(sum(value) AS BIGINT) AS value FROM p_hour GROUP BY ALL")
def aggregate_buckets(spark, d):
    return buckets.aggregate_buckets(P.metric_hour(spark, d), "week")


@query(f"SELECT * FROM p_day WHERE {IN_NOW}")
def range_filter(spark, d):
    return now(P.metric_day(spark, d))


@query(f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM p_day WHERE series = 'click' AND dimension = '3' AND {IN_NOW}")
def sum_series(spark, d):
    return kpis.sum_series(now(P.metric_day(spark, d)), "click", "3")


@query(f"SELECT dimension, CAST(sum(value) AS BIGINT) AS total FROM p_day WHERE series = 'purchase' AND {IN_NOW} GROUP BY 1")
def denom_totals(spark, d):
    return kpis.dimension_totals(now(P.metric_day(spark, d)), ["purchase"])


@query(f"SELECT dimension AS denom, CAST(sum(value) AS BIGINT) AS amount FROM p_day WHERE series IN ('purchase', 'view') AND {IN_NOW} GROUP BY 1 HAVING sum(value) > 0")
def transfer_table(spark, d):
    return kpis.dimension_totals(now(P.metric_day(spark, d)), ["purchase", "view"], True).select(F.col("dimension").alias("denom"), F.col("total").alias("amount"))


@query(f"SELECT dimension AS denom, CAST(sum(value) AS BIGINT) AS amount FROM p_day WHERE series = 'signup' AND {IN_NOW} GROUP BY 1 HAVING sum(value) > 0")
def bank_credits_table(spark, d):
    return kpis.dimension_totals(now(P.metric_day(spark, d)), ["signup"], True).select(F.col("dimension").alias("denom"), F.col("total").alias("amount"))


@query(f"SELECT day, dimension AS denom, CAST(sum(greatest(value, 0)) AS BIGINT) AS amount FROM p_day WHERE series IN ('purchase', 'signup') AND value > 0 AND {IN_NOW} GROUP BY ALL")
def day_denom_amounts(spark, d):
    return kpis.day_denom_amounts(now(P.metric_day(spark, d)), ["purchase", "signup"])


KPI_NAMES = {"txs": "click", "failed": "error", "fees": "purchase", "missing": "none"}
KPI_SQL = """
WITH w AS (SELECT k.kpi, {cur} AS current, {prev} AS previous FROM (VALUES {names}) AS k(kpi, series) LEFT JOIN p_day d ON d.series = k.series GROUP BY 1)
SELECT kpi, current, previous, CASE WHEN previous = 0 AND current = 0 THEN 0.0 WHEN previous = 0 THEN NULL ELSE CAST((current - previous) * 10000 // previous AS DOUBLE) / 100 END AS pct_change FROM w
""".format(cur=f"CAST(coalesce(sum(value) FILTER ({IN_NOW}), 0) AS BIGINT)", prev=f"CAST(coalesce(sum(value) FILTER ({IN_BEFORE}), 0) AS BIGINT)", names=", ".join(f"('{k}', '{v}')" for k, v in KPI_NAMES.items()))


@query(KPI_SQL)
def kpi(spark, d):
    out = kpis.kpis(P.metric_day(spark, d), {k: F.col("series") == v for k, v in KPI_NAMES.items()}, P.NOW, P.BEFORE)
    return big(out, "current", "previous")


@query("""WITH k AS (SELECT unnest(['success', 'failed', 'fees', 'fees_main', 'all']) AS kpi),
v AS (SELECT k.kpi, CAST(coalesce(sum(CASE WHEN day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' THEN x END), 0) AS BIGINT) AS current, CAST(coalesce(sum(CASE WHEN day BETWEEN DATE '1996-10-03' AND DATE '1996-12-31' THEN x END), 0) AS BIGINT) AS previous
FROM k, LATERAL (SELECT day, CASE kpi WHEN 'success' THEN 1 - code WHEN 'failed' THEN code WHEN 'fees' THEN fee WHEN 'fees_main' THEN CASE WHEN denom = '5-LOW' THEN fee ELSE 0 END ELSE 1 END AS x FROM p_tx) GROUP BY 1)
SELECT kpi, current, previous, CASE WHEN previous = 0 AND current = 0 THEN 0.0 WHEN previous = 0 THEN NULL ELSE CAST((current - previous) * 10000 // previous AS DOUBLE) / 100 END AS pct_change FROM v""")
def kpi_table(spark, d):
    t = P.tx(spark, d)
    rows = t.select("day", F.explode(F.array(
        F.struct(F.when(F.col("code") == 0, "success").otherwise("failed").alias("series"), F.lit("").alias("dimension"), F.lit(1).cast("long").alias("value")),
        F.struct(F.lit("fee_paid").alias("series"), F.col("denom").alias("dimension"), F.col("fee").alias("value")))).alias("m")).select("day", "m.*")
    s, dim = F.col("series"), F.col("dimension")
    figures = {"success": s == "success", "failed": s == "failed", "fees": s == "fee_paid", "fees_main": (s == "fee_paid") & (dim == "5-LOW"), "all": s.isin("success", "failed")}
    return big(kpis.kpis(rows, figures, P.LEGS, P.LEGS_BEFORE), "current", "previous")


@query("SELECT day, round(count(*) FILTER (code = 0) * 100.0 / count(*), 6) AS success_rate FROM p_tx GROUP BY 1")
def success_rate(spark, d):
    t = P.tx(spark, d).groupBy("day").agg(F.sum((F.col("code") == 0).cast("long")).alias("ok"), F.count(F.lit(1)).alias("n"))
    return kpis.ratios(t, {"success_rate": ("ok", "n", 100)}).select("day", F.round("success_rate", 6).alias("success_rate"))


def _totals(spark, d):
    s = lambda n: F.sum(F.when(F.col("series") == n, F.col("value")))
    return P.metric_day(spark, d).groupBy("day").agg(s("click").alias("used"), s("view").alias("wanted"), s("purchase").alias("cap"))


_TOT = "(SELECT day, sum(value) FILTER (series = 'click') AS used, sum(value) FILTER (series = 'view') AS wanted, sum(value) FILTER (series = 'purchase') AS cap FROM p_day GROUP BY 1)"


@query(f"SELECT day, round(used * 100.0 / nullif(wanted, 0), 6) AS gas_efficiency FROM {_TOT}")
def gas_efficiency(spark, d):
    return kpis.ratios(_totals(spark, d), {"r": ("used", "wanted", 100)}).select("day", F.round("r", 6).alias("gas_efficiency"))


@query(f"SELECT day, round(used * 100.0 / nullif(cap, 0), 6) AS block_utilization FROM {_TOT}")
def block_utilization(spark, d):
    return kpis.ratios(_totals(spark, d), {"r": ("used", "cap", 100)}).select("day", F.round("r", 6).alias("block_utilization"))


@query("SELECT round(sum(fee) * 1.0 / count(*), 6) AS fee_per_tx, round(sum(fee) * 1.0 / count(*) FILTER (code = 0), 6) AS fee_per_success, round(count(*) * 1.0 / count(DISTINCT signer), 6) AS tx_per_account FROM p_tx")
def normalized_ratios(spark, d):
    each = P.tx(spark, d).groupBy("signer").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("code") == 0).cast("long")).alias("ok"), F.sum("fee").alias("fee"))
    one = each.agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("fee").alias("fee"), F.count(F.lit(1)).alias("accounts"))
    out = kpis.ratios(one, {"fee_per_tx": ("fee", "n", 1), "fee_per_success": ("fee", "ok", 1), "tx_per_account": ("n", "accounts", 1)})
    return out.select(*[F.round(c, 6).alias(c) for c in ("fee_per_tx", "fee_per_success", "tx_per_account")])


_PREFER = "series = 'signup' AND dimension = '1'"


@query(f"""WITH x AS (SELECT hour, CASE WHEN {_PREFER} THEN 'flow' WHEN series = 'error' THEN 'count' END AS s, value FROM p_hour),
y AS (SELECT hour, sum(value) FILTER (s = 'flow') AS f, sum(value) FILTER (s = 'count') AS c, bool_or(s = 'flow') AS has FROM x WHERE s IS NOT NULL GROUP BY 1)
SELECT {H} AS bucket, CAST(CASE WHEN has THEN f ELSE c END AS BIGINT) AS value FROM y""")
def ibc_in_display(spark, d):
    m = P.metric_hour(spark, d)
    s = F.when((F.col("series") == "signup") & (F.col("dimension") == "1"), "flow").when(F.col("series") == "error", "count")
    rows = m.withColumn("series", s).where("series IS NOT NULL").withColumn("bucket", hour_text())
    return kpis.display_in(rows, "flow", "count")


@query(f"SELECT dimension, CAST(sum(value) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY sum(value) DESC, dimension) AS INTEGER) AS rank FROM p_day WHERE series = 'view' AND {IN_NOW} GROUP BY 1 HAVING sum(value) > 0")
def rank_series(spark, d):
    return kpis.rank_series(now(P.metric_day(spark, d)), "view")


@query(f"SELECT day FROM {DAYS}")
def dense_days(spark, d):
    first = now(P.metric_day(spark, d)).agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return buckets.dense_days(spark, first["a"], first["b"])


_S6 = f"(SELECT DISTINCT series FROM p_day WHERE {IN_NOW})"


@query(f"""SELECT g.day, g.series, CASE WHEN f.floor IS NOT NULL AND g.day + INTERVAL 1 DAY <= f.floor THEN NULL ELSE coalesce(v.value, 0) END AS value
FROM (SELECT * FROM {DAYS}, {_S6}) g LEFT JOIN p_floor f USING (series) LEFT JOIN (SELECT day, series, CAST(sum(value) AS BIGINT) AS value FROM p_day GROUP BY ALL) v USING (day, series)""")
def densify(spark, d):
    return buckets.densify(now(P.metric_day(spark, d)), days(spark), floors(spark))


@query(f"SELECT {H} AS hour, series, dimension, coalesce(hour + INTERVAL 1 HOUR <= floor, false) AS uncovered FROM p_hour LEFT JOIN p_floor USING (series)")
def is_before_coverage(spark, d):
    return buckets.with_coverage(P.metric_hour(spark, d), floors(spark), "hour", "hour").select(hour_text().alias("hour"), "series", "dimension", "uncovered")


@query(f"""SELECT day, 'purchase' AS series, CASE WHEN day + INTERVAL 1 DAY <= TIMESTAMP '{P.FLOORS["purchase"]}' THEN NULL ELSE coalesce(value, 0) END AS value
FROM {DAYS} LEFT JOIN (SELECT day, value FROM p_day WHERE series = 'purchase' AND dimension = '2') USING (day)""")
def series_over_time(spark, d):
    return buckets.series_over_time(now(P.metric_day(spark, d)), "purchase", "2", days(spark), floors(spark))


_PIV = "SELECT day AS bucket, CAST(coalesce(sum(value) FILTER (series = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(value) FILTER (series = 'view'), 0) AS BIGINT) AS view FROM p_day WHERE series IN ('click', 'view') GROUP BY 1"


def _aligned(spark, d):
    return P.metric_day(spark, d).withColumnRenamed("day", "bucket")


@query(_PIV)
def series_align(spark, d):
    return buckets.series_align(_aligned(spark, d), ["click", "view"])


@query(_PIV.replace("click", "error").replace("'view'", "'signup'").replace("AS view", "AS signup"))
def series_union_keys(spark, d):
    return buckets.series_align(_aligned(spark, d), ["error", "signup"])


@query("SELECT day AS bucket, CAST(sum(value) AS BIGINT) AS value FROM p_day WHERE series IN ('purchase', 'signup') GROUP BY 1")
def transfer_plus_in_series(spark, d):
    return buckets.combined_series(P.metric_day(spark, d).withColumnRenamed("day", "bucket"), ["purchase", "signup"])


@query(f"""WITH x AS (SELECT hour, CASE WHEN {_PREFER} THEN 'flow' WHEN series = 'error' THEN 'count' WHEN series = 'view' THEN 'out' END AS s, value FROM p_hour),
y AS (SELECT hour, sum(value) FILTER (s = 'flow') AS f, sum(value) FILTER (s = 'count') AS c, sum(value) FILTER (s = 'out') AS o FROM x WHERE s IS NOT NULL GROUP BY 1)
SELECT {H} AS bucket, CAST(coalesce(o, 0) + coalesce(f, c, 0) AS BIGINT) AS value FROM y""")
def ibc_combined_series(spark, d):
    m = P.metric_hour(spark, d).withColumn("bucket", hour_text())
    s = F.when((F.col("series") == "signup") & (F.col("dimension") == "1"), "flow").when(F.col("series") == "error", "count").when(F.col("series") == "view", "out")
    rows = m.withColumn("series", s).where("series IS NOT NULL")
    shown = kpis.display_in(rows, "flow", "count").unionByName(rows.where("series = 'out'").select("bucket", "value"))
    return shown.groupBy("bucket").agg(F.sum("value").alias("value"))


@query("SELECT bucket, ok, failed, round(ok * 100.0 / (ok + failed), 6) AS pct FROM (SELECT day AS bucket, count(*) FILTER (code = 0) AS ok, count(*) FILTER (code = 1) AS failed FROM p_tx GROUP BY 1)")
def success_rate_rows(spark, d):
    rows = P.tx(spark, d).groupBy(F.col("day").alias("bucket"), F.when(F.col("code") == 0, "ok").otherwise("failed").alias("series")).agg(F.count(F.lit(1)).alias("value"))
    return buckets.share_rows(rows, "ok", ["ok", "failed"]).withColumn("pct", F.round("pct", 6))


@query("SELECT day AS bucket, CAST(coalesce(sum(value) FILTER (series = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(value) FILTER (series = 'view'), 0) AS BIGINT) AS view, round(click * 100.0 / nullif(view, 0), 6) AS pct FROM p_day WHERE series IN ('click', 'view') GROUP BY 1")
def gas_utilization_rows(spark, d):
    return buckets.share_rows(P.metric_day(spark, d).withColumnRenamed("day", "bucket"), "click", ["view"]).withColumn("pct", F.round("pct", 6))


@query("SELECT day AS bucket, " + ", ".join(f"CAST(coalesce(sum(value) FILTER (series = '{s}'), 0) AS BIGINT) AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM p_day GROUP BY 1")
def staking_gov_rows(spark, d):
    return buckets.series_align(P.metric_day(spark, d).withColumnRenamed("day", "bucket"), ["click", "error", "purchase", "signup", "view"])


_CLS = "CASE WHEN category IN ('orchestration', 'oracle', 'fast_usdc') THEN 'automated' WHEN category = 'other' THEN 'unknown' ELSE 'interactive' END"


@query(f"SELECT day AS bucket, count(*) FILTER ({_CLS} = 'automated') AS automated, count(*) FILTER ({_CLS} = 'interactive') AS interactive, count(*) FILTER ({_CLS} = 'unknown') AS unknown FROM p_action GROUP BY 1")
def offers_activity_rows(spark, d):
    a = P.action(spark, d).groupBy(F.col("day").alias("bucket"), offers.automation_class(F.col("category")).alias("class")).agg(F.count(F.lit(1)).alias("value"))
    return buckets.class_rows(a, ["automated", "interactive", "unknown"])


def _over_time(by):
    return f"SELECT g.day, g.{by}, coalesce(v.n, 0) AS value, coalesce(t.n, 0) AS total FROM (SELECT * FROM {DAYS}, (SELECT DISTINCT {by} FROM p_action WHERE {IN_NOW})) g LEFT JOIN (SELECT day, {by}, count(*) AS n FROM p_action GROUP BY ALL) v USING (day, {by}) LEFT JOIN (SELECT day, count(*) AS n FROM p_action GROUP BY 1) t USING (day)"


def _counts(spark, d, by):
    return now(P.action(spark, d)).groupBy("day", by).agg(F.count(F.lit(1)).alias("value"))


@query(_over_time("category"))
def category_over_time(spark, d):
    return buckets.values_over_time(_counts(spark, d, "category"), days(spark), "category")


@query(_over_time("outcome"))
def outcome_over_time(spark, d):
    return buckets.values_over_time(_counts(spark, d, "outcome"), days(spark), "outcome")


@query(f"SELECT {H} AS bucket, series, dimension, value, 'hour' AS grain FROM p_hour WHERE {IN_NOW}")
def hour_fallback(spark, d):
    got, grain = buckets.hour_fallback(now(P.metric_hour(spark, d)), now(P.metric_day(spark, d)))
    bucket = hour_text() if grain == "hour" else F.col("day").cast("string")
    return got.select(bucket.alias("bucket"), "series", "dimension", "value", F.lit(grain).alias("grain"))


@query(f"SELECT series, CAST(sum(value) FILTER ({IN_NOW}) AS BIGINT) AS current, CASE WHEN first <= DATE '{C}' THEN CAST(sum(value) FILTER ({IN_BEFORE}) AS BIGINT) END AS previous FROM p_day, (SELECT min(day) AS first FROM p_day) GROUP BY series, first")
def prior_has_data(spark, d):
    m = P.metric_day(spark, d)
    first = m.agg(F.min("day").alias("first"))
    s = m.groupBy("series").agg(kpis.window_sum(F.col("value"), F.col("day"), A, B).alias("current"), kpis.window_sum(F.col("value"), F.col("day"), C, D).alias("previous"))
    return buckets.prior_has_data(s.crossJoin(F.broadcast(first)), C, F.col("first"), ["previous"]).drop("first")


# --- windows

_DAILY = "(SELECT day, series, CAST(sum(value) AS BIGINT) AS value FROM p_day GROUP BY ALL)"


def _daily(spark, d):
    return P.metric_day(spark, d).groupBy("day", "series").agg(F.sum("value").alias("value"))


_Z = f"""(SELECT *, CASE WHEN n >= 7 AND sd > 1e-9 THEN (value - m) / sd END AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n
FROM {_DAILY} WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))"""


@query(f"SELECT day, series, value, round(z, 6) AS z, coalesce(abs(z) >= 2.5 AND day >= DATE '{A}' AND day < DATE '{B}', false) AS flagged FROM {_Z}")
def trailing_zscore(spark, d):
    return windows.trailing_zscore(_daily(spark, d), A, B).withColumn("z", F.round("z", 6))


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i FROM {_DAILY}), r AS (SELECT series, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM x GROUP BY 1)
SELECT day, series, value, round(a * i + b, 4) AS trend FROM x JOIN r USING (series)""")
def linear_trend(spark, d):
    return windows.linear_trend(_daily(spark, d)).withColumn("trend", F.round("trend", 4))


@query("SELECT day, wallets, minted, height, n_new, n_minted, round(rate, 6) AS rate, abs(rate - 10000000) <= 100000 AS matches_fee, CAST(gap_days AS INTEGER) AS gap_days FROM p_diff")
def snapshot_diff(spark, d):
    return windows.snapshot_diff(P.snapshot(spark, d), 10_000_000).withColumn("rate", F.round("rate", 6))


@query(f"SELECT series, round(max(abs(value)) * 1.0 / sum(abs(value)), 6) AS top_day_share FROM {_DAILY} GROUP BY 1")
def top_day_share(spark, d):
    return kpis.top_day_share(_daily(spark, d)).withColumn("top_day_share", F.round("top_day_share", 6))


@query(f"""WITH q AS (SELECT CASE WHEN series IN ('click', 'error') THEN 'busier' WHEN series = 'view' THEN 'organic' ELSE 'value' END AS question, * FROM {_Z}),
p AS (SELECT question, (sum(value) FILTER ({IN_NOW}) - sum(value) FILTER ({IN_BEFORE})) * 100.0 / sum(value) FILTER ({IN_BEFORE}) AS pct FROM q GROUP BY 1),
m AS (SELECT question, max(abs(z)) AS max_z FROM q GROUP BY 1)
SELECT question, round(max_z, 6) AS max_z, round(abs(pct), 6) AS abs_pct FROM m JOIN p USING (question) ORDER BY m.max_z DESC, abs(pct) DESC LIMIT 3""")
def anomaly_movers(spark, d):
    daily = _daily(spark, d)
    q = F.when(F.col("series").isin("click", "error"), "busier").when(F.col("series") == "view", "organic").otherwise("value")
    s = daily.withColumn("question", q).groupBy("question").agg(kpis.window_sum(F.col("value"), F.col("day"), A, B).alias("a"), kpis.window_sum(F.col("value"), F.col("day"), C, D).alias("b"))
    got = windows.movers(windows.trailing_zscore(daily), q, s.select("question", numbers.pct_change_double(F.col("a"), F.col("b")).alias("pct")))
    return got.select("question", F.round("max_z", 6).alias("max_z"), F.round("abs_pct", 6).alias("abs_pct"))


# --- merges, exports, checks

_BASE, _NEW = f"SELECT day, series, dimension, value FROM p_day WHERE day < DATE '{A}'", f"SELECT day, series, dimension, value FROM p_day WHERE day >= DATE '{C}'"


def _split(spark, d):
    m = P.metric_day(spark, d)
    return m.where(F.col("day") < F.lit(A)), m.where(F.col("day") >= F.lit(C))


@query(f"SELECT day, series, dimension, CAST(sum(value) AS BIGINT) AS value FROM ({_BASE} UNION ALL {_NEW}) GROUP BY ALL")
def merge_additive(spark, d):
    return store.merge_additive(*_split(spark, d), ["day", "series", "dimension"])


@query("SELECT DISTINCT day, address, role FROM p_part")
def merge_set(spark, d):
    p = P.participant(spark, d)
    return store.merge_set(p.where(F.col("day") < F.lit(A)).distinct(), p.where(F.col("day") >= F.lit(C)), ["day", "address", "role"])


@query("SELECT * FROM p_position")
def merge_latest(spark, d):
    rows = P.position_rows(spark, d)
    key, order = ["contract", "portfolio", "position_key"], ["height", "seq", "total_in", "total_out"]
    base = windows.latest_row(rows.where("height % 2 = 0"), key, order)
    return store.merge_latest(base, rows.where("height % 2 = 1"), key, order)


@query("SELECT * FROM p_position")
def latest_row(spark, d):
    return P.position(spark, d)


@query("SELECT tx_hash, day, installer, gas_fee, CASE WHEN CAST(tx_hash AS BIGINT) % 5 = 0 THEN 0 ELSE storage_fee END AS storage_fee FROM p_landing")
def merge_by_key(spark, d):
    rows = P.landing(spark, d)
    return store.merge_by_key(rows, rows.where("tx_hash % 5 = 0").withColumn("storage_fee", F.lit(0).cast("long")), ["tx_hash"])


@query("""SELECT flow_id, coalesce(arg_min(flow_type, height) FILTER (flow_type IS NOT NULL), 'unknown') AS flow_type, arg_min(denom, height) FILTER (denom IS NOT NULL) AS denom, arg_min(amount, height) FILTER (amount IS NOT NULL) AS amount,
min(day) AS day, min(height) AS first_height, arg_max(state, height) AS last_state, max(height) AS last_height FROM p_flow_rows GROUP BY 1""")
def merge_flow(spark, d):
    return store.merge_flow(P.flow_rows(spark, d), ["flow_id"])


@query("SELECT day, series, dimension, CASE WHEN series = 'view' THEN value * 2 ELSE value END AS value FROM p_day")
def rebuild_series(spark, d):
    m = P.metric_day(spark, d)
    return store.rebuild_series(m, m.withColumn("value", F.col("value") * 2), "view")


@query(f"SELECT CAST(day AS VARCHAR) AS bucket, series, dimension, CAST(value AS VARCHAR) AS value FROM p_day WHERE {IN_NOW}")
def export_long(spark, d):
    return export.export_long(now(P.metric_day(spark, d)), "day")


@query("SELECT series, dimension, CAST(h AS BIGINT) AS hourly, CAST(v AS BIGINT) AS daily FROM (SELECT series, dimension, sum(value) AS h, sum(CASE WHEN series = 'click' AND dimension = '2' THEN 0 WHEN series = 'view' THEN value + 1 ELSE value END) AS v FROM p_hour GROUP BY ALL) WHERE h <> v")
def parity_check(spark, d):
    h = P.metric_hour(spark, d)
    daily = h.withColumn("value", F.when(F.col("series") == "view", F.col("value") + 1).otherwise(F.col("value"))).where("NOT (series = 'click' AND dimension = '2')")
    return state.parity_check(h, daily)


@query("SELECT event_type AS type_url, event_id AS height, 0 AS tx_i FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1")
def first_seen_type_urls(spark, d):
    return state.first_seen(P.table(spark, d, "events").select(F.col("event_type").alias("type_url"), F.col("event_id").alias("height"), F.lit(0).alias("tx_i")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 10000 AS VARCHAR) || CASE WHEN CAST(round(l_extendedprice * 100) AS BIGINT) % 10000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 10000 AS VARCHAR), 4, '0'), '0') END AS decimal FROM lineitem")
def atomic_to_decimal(spark, d):
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.atomic_to_decimal(P.cents("l_extendedprice"), F.lit(4)).alias("decimal"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(round(l_extendedprice * 100) AS BIGINT) / 10000.0, 6) AS value FROM lineitem")
def atomic_to_double(spark, d):
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(numbers.atomic_to_double(P.cents("l_extendedprice"), F.lit(4)), 6).alias("value"))


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_hour(spark, d):
    e = P.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(hour_text("w.start").alias("hour"), "event_type", "n")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_day(spark, d):
    e = P.table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.to_date("w.start").alias("day"), "event_type", "n")


@query("SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS HUGEINT) * CAST('1000000000000000000000000' AS HUGEINT)) AS VARCHAR) AS total FROM lineitem")
def wide_sum(spark, d):
    wide = P.table(spark, d, "lineitem").select(F.concat(P.cents("l_extendedprice").cast("string"), F.lit("0" * 24)).alias("v"))
    return wide.agg(*[c.alias(n) for c, n in zip(numbers.wide_sum(F.col("v")), ("hi", "lo"))]).select(numbers.wide_join(F.col("hi"), F.col("lo")).alias("total"))


@query("SELECT CAST(day AS VARCHAR) AS bucket, series, dimension, CAST(v AS VARCHAR) || lpad(CAST(v AS VARCHAR), 30, '0') AS value FROM (SELECT day, series, dimension, sum(delta) AS v FROM p_delta WHERE delta <> 0 GROUP BY ALL)")
def wide_rollup(spark, d):
    """Amounts d * 10^30 + d summed by hour, added up by hour's half and day, and put out as text."""
    digits = F.col("delta").cast("string")
    wide = P.deltas(spark, d).withColumn("delta", numbers.LIMBS.of(F.concat(digits, F.lpad(digits, 30, "0"))))
    hours = kpis.rollup_hours(wide, numbers.LIMBS)
    half = lambda k: kpis.rollup_days(hours.where(F.hour("hour") % 2 == k), numbers.LIMBS)
    return export.export_long(store.merge_additive(half(0), half(1), ["day", "series", "dimension"], amounts=numbers.LIMBS), "day", numbers.LIMBS)


@query(f"""WITH k AS ({KPI_SQL}) SELECT 'kpi' AS part, kpi AS key, CAST(current AS DOUBLE) AS value FROM k
UNION ALL SELECT 'total', series || '/' || dimension, CAST(sum(value) AS DOUBLE) FROM p_day WHERE {IN_NOW} GROUP BY series, dimension
UNION ALL SELECT 'series', CAST(day AS VARCHAR) || '/' || series, CAST(CASE WHEN f.floor IS NOT NULL AND g.day + INTERVAL 1 DAY <= f.floor THEN NULL ELSE coalesce(v.value, 0) END AS DOUBLE)
FROM (SELECT * FROM {DAYS}, {_S6}) g LEFT JOIN p_floor f USING (series) LEFT JOIN (SELECT day, series, sum(value) AS value FROM p_day GROUP BY ALL) v USING (day, series)""")
def job_metrics(spark, d):
    parts = jobs.metrics(P.metric_day(spark, d), {k: F.col("series") == v for k, v in KPI_NAMES.items()}, floors(spark), A, B)
    keys = {"kpis": ("kpi", F.col("kpi"), "current"), "totals": ("total", F.concat_ws("/", "series", "dimension"), "total"), "series": ("series", F.concat_ws("/", F.col("day").cast("string"), "series"), "value")}
    rows = [parts[p].select(F.lit(n).alias("part"), k.alias("key"), F.col(v).cast("double").alias("value")) for p, (n, k, v) in keys.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
