"""Queries over blocks made from the events table: pairing, parsing, and the rollup of every extracted series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import denoms, events
from ..operators import extract, kpis, state
from ..sources import blocks as B
from . import jobs
from . import proxy as P
from .registry import registry

QUERIES, ORACLES, query = registry()
SENT = "k % 3 <> 0"
INBOUND = "k % 3 = 0 AND k % 2 = 0"
TRACE = "CASE WHEN k % 2 = 0 THEN 'ibc/' || upper(sha256('transfer/channel-' || k)) ELSE 'ubld' END"
# per transaction: which events may count as received, by message position
_IN = f"""(WITH m AS (SELECT tx, list(i) AS places FROM p_x WHERE {INBOUND} AND NOT failed GROUP BY 1),
e AS (SELECT x.day, x.tx, x.height, 'den' || CAST(k % 3 AS VARCHAR) AS denom, t, c, list_contains(places, event_id % 3) AS mine FROM p_x x JOIN m USING (tx) WHERE t IN ('click', 'view')),
u AS (SELECT tx, bool_or(mine) AS used FROM e GROUP BY 1),
s AS (SELECT day, height, tx, denom, used, coalesce(sum(c) FILTER (t = 'click'), 0) AS r, coalesce(sum(c) FILTER (t = 'view'), 0) AS v FROM e JOIN u USING (tx) WHERE mine OR NOT used GROUP BY ALL)
SELECT *, greatest(r, v) AS amount FROM s)"""
SERIES_SQL = {
    "tx_outcome": "SELECT day, CASE WHEN failed THEN 'tx_failed' ELSE 'tx_success' END AS series, '' AS dimension, count(*) AS value FROM p_x WHERE i = 0 GROUP BY ALL",
    "gas": "SELECT day, 'gas_used' AS series, '' AS dimension, CAST(sum(c) AS BIGINT) AS value FROM p_x GROUP BY 1 UNION ALL SELECT day, 'gas_wanted', '', CAST(sum(c) * 2 AS BIGINT) FROM p_x GROUP BY 1",
    "block_gas_limit": "SELECT day, 'block_gas_limit' AS series, '' AS dimension, count(DISTINCT height) * 1000000 AS value FROM p_x WHERE height % 10 <> 0 GROUP BY 1",
    "fee_paid": "SELECT day, 'fee_paid' AS series, 'ubld' AS dimension, CAST(sum(c) AS BIGINT) AS value FROM p_x WHERE t = 'purchase' GROUP BY 1",
    "transfer_volume": f"SELECT day, 'transfer_volume' AS series, 'den' || CAST(k % 3 AS VARCHAR) AS dimension, CAST(sum(c) AS BIGINT) AS value FROM p_x WHERE {SENT} AND NOT failed GROUP BY ALL",
    "bank_credits_volume": "SELECT day, 'bank_credits_volume' AS series, 'den' || CAST(k % 3 AS VARCHAR) AS dimension, CAST(sum(c) AS BIGINT) AS value FROM p_x WHERE t = 'click' AND NOT failed AND u NOT IN ('3', '5') GROUP BY ALL",
    "ibc_in_count": f"SELECT day, 'ibc_transfer_in_count' AS series, '' AS dimension, count(*) AS value FROM p_x WHERE {INBOUND} AND NOT failed GROUP BY 1",
    "ibc_flow_in": f"SELECT day, 'ibc_transfer_flow_in' AS series, '' AS dimension, count(*) AS value FROM p_x WHERE {INBOUND} AND NOT failed GROUP BY 1",
    "ibc_amount_in": f"SELECT day, 'ibc_transfer_amount_in' AS series, denom AS dimension, CAST(sum(amount) AS BIGINT) AS value FROM {_IN} GROUP BY ALL HAVING sum(amount) <> 0",
    "staking_gov_counts": "SELECT day, 'gov_votes' AS series, '' AS dimension, count(*) AS value FROM p_x WHERE k % 3 = 0 AND k % 2 = 1 AND NOT failed GROUP BY 1",
    "ibc_out_orch": f"SELECT day, 'ibc_transfer_amount_out_orch' AS series, {TRACE} AS dimension, CAST(sum(c) AS BIGINT) AS value FROM p_x WHERE t = 'error' AND event_id % 2 = 0 AND c > 0 GROUP BY ALL UNION ALL SELECT day, 'ibc_transfer_out_count_orch', '', count(*) FROM p_x WHERE t = 'error' AND event_id % 2 = 0 AND c > 0 GROUP BY 1",
}
NAMES = {
    "tx_outcome": ["tx_success", "tx_failed"], "gas": ["gas_used", "gas_wanted"], "ibc_in_count": ["ibc_transfer_in_count"], "ibc_flow_in": ["ibc_transfer_flow_in"],
    "ibc_amount_in": ["ibc_transfer_amount_in"], "staking_gov_counts": ["gov_votes", "gov_proposals", "staking_delegations"], "ibc_out_orch": ["ibc_transfer_amount_out_orch", "ibc_transfer_out_count_orch"],
}
MODULES = ["3", "5"]


def daily(spark, d, deltas=extract.all_deltas):
    days = kpis.rollup_days(kpis.rollup_hours(deltas(P.blocks(spark, d), MODULES)))
    return days.withColumn("value", F.col("value").cast("long"))


def _series(key):
    names = NAMES.get(key, [key])
    return lambda spark, d: daily(spark, d).where(F.col("series").isin(names))


for _key, _sql in SERIES_SQL.items():
    query(_sql, _key)(_series(_key))


@query(" UNION ALL ".join(f"SELECT * FROM ({s})" for s in SERIES_SQL.values()))
def job_rollup(spark, d):
    """All series of the blocks."""
    return daily(spark, d, extract.rollup_deltas)


@query("SELECT height, CAST(tx % 4 AS INTEGER) AS tx_i, CAST(failed AS INTEGER) AS code, CAST(sum(c) AS VARCHAR) AS gas_used FROM p_x GROUP BY ALL")
def pair_txs(spark, d):
    return B.pair_txs(P.blocks(spark, d)).select("height", "tx_i", F.col("result.code").alias("code"), F.col("result.gas_used").alias("gas_used"))


@query("SELECT height, CAST(0 AS INTEGER) AS extra_txs, CAST(1 AS INTEGER) AS extra_results FROM p_x WHERE height % 7 = 0 GROUP BY 1")
def pairing_mismatches(spark, d):
    b = P.blocks(spark, d)
    return B.pairing_mismatches(b.withColumn("txs", F.when(F.col("height") % 7 == 0, F.slice("txs", F.lit(1), F.size("txs") - 1)).otherwise(F.col("txs"))))


@query("SELECT height, CAST(tx % 4 AS INTEGER) AS tx_i, CAST(i AS INTEGER) AS ev_i, CASE t WHEN 'click' THEN 'coin_received' WHEN 'view' THEN 'transfer' WHEN 'purchase' THEN 'tx' WHEN 'signup' THEN 'message' ELSE 'coin_spent' END AS type FROM p_x")
def explode_tx_events(spark, d):
    return B.explode_tx_events(B.pair_txs(P.blocks(spark, d))).select("height", "tx_i", "ev_i", "event.type")


@query("SELECT height, CAST(row_number() OVER (PARTITION BY height ORDER BY event_id) - 1 AS INTEGER) AS ev_i, CAST(c AS VARCHAR) AS amount FROM p_x WHERE t = 'error'")
def explode_block_events(spark, d):
    rows = B.explode_block_events(P.blocks(spark, d))
    return rows.select("height", "ev_i", F.get_json_object(events.packet_json(F.col("event")), "$.amount").alias("amount"))


@query("SELECT height, CAST(tx % 4 AS INTEGER) AS tx_i, upper(sha256(CAST(tx AS VARCHAR))) AS tx_hash FROM p_x WHERE i = 0")
def tx_hash(spark, d):
    return B.pair_txs(P.blocks(spark, d)).select("height", "tx_i", B.tx_hash(F.col("tx.raw")).alias("tx_hash"))


def _events(spark, d):
    return B.explode_tx_events(B.pair_txs(P.blocks(spark, d)))


@query("SELECT event_id, 'den' || CAST(k % 3 AS VARCHAR) AS denom, c AS amount FROM p_x WHERE t IN ('click', 'view')")
def parse_coins(spark, d):
    e = _events(spark, d).where("event.type IN ('coin_received', 'transfer')")
    coins = events.parse_coins(events.attr_last(F.col("event"), "amount"))
    return e.select((F.col("height") * 32 + F.col("tx_i") * 8 + F.col("ev_i")).alias("event_id"), F.inline(coins)).withColumn("amount", F.col("amount").cast("long"))


@query("SELECT event_id, u AS receiver FROM p_x WHERE t = 'click'")
def attr(spark, d):
    e = _events(spark, d).where("event.type = 'coin_received'")
    return e.select((F.col("height") * 32 + F.col("tx_i") * 8 + F.col("ev_i")).alias("event_id"), events.attr_first(F.col("event"), "receiver").alias("receiver"))


@query("SELECT event_id, CASE WHEN t IN ('click', 'view') THEN CAST(event_id % 3 AS INTEGER) END AS msg_index FROM p_x")
def msg_index(spark, d):
    return _events(spark, d).select((F.col("height") * 32 + F.col("tx_i") * 8 + F.col("ev_i")).alias("event_id"), events.msg_index(F.col("event")).alias("msg_index"))


@query(f"SELECT tx, CAST(i AS INTEGER) AS message FROM p_x WHERE {INBOUND}")
def msg_indices_of(spark, d):
    t = B.pair_txs(P.blocks(spark, d))
    return t.select((F.col("height") * 4 + F.col("tx_i")).alias("tx"), F.explode(events.msg_indices_of(F.col("tx.messages"), extract.IBC_IN)).alias("message"))


@query("SELECT height, CASE WHEN height % 10 <> 0 THEN 1000000 END AS max_gas FROM p_x GROUP BY 1")
def max_gas(spark, d):
    return P.blocks(spark, d).select("height", events.max_gas(F.col("max_gas")).alias("max_gas"))


@query(f"SELECT event_id, {TRACE} AS denom FROM p_x")
def ibc_denom(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    trace = F.when(k % 2 == 0, F.concat(F.lit("transfer/channel-"), k.cast("string"))).otherwise("ubld")
    return P.table(spark, d, "events").select("event_id", denoms.ibc_denom(trace).alias("denom"))


@query("SELECT event_id, CAST(c AS VARCHAR) AS amount FROM p_x WHERE t = 'error'")
def packet_json(spark, d):
    """From packet data in hexadecimal."""
    e = P.table(spark, d, "events").where("event_type = 'error'")
    data = F.hex(F.to_json(F.struct(P.cents("value").cast("string").alias("amount"))).cast("binary"))
    event = F.struct(F.lit("send_packet").alias("type"), F.array(F.struct(F.lit("packet_data_hex").alias("key"), data.alias("value"))).alias("attributes"))
    return e.select("event_id", F.get_json_object(events.packet_json(event), "$.amount").alias("amount"))


@query(f"SELECT height, {TRACE} AS denom, c AS amount FROM p_x WHERE t = 'error' AND event_id % 2 = 0 AND c > 0")
def send_packet_filter(spark, d):
    sends = extract.send_packets(B.block_events())
    return P.blocks(spark, d).select("height", F.inline(sends)).select("height", "denom", F.col("amount").cast("long").alias("amount"))


@query("SELECT height, CAST(tx % 4 AS INTEGER) AS tx_i, CASE WHEN failed THEN arg_min(u, i) FILTER (t = 'purchase') ELSE arg_min(u, i) END AS payer FROM p_x GROUP BY height, tx, failed")
def fee_payer(spark, d):
    return extract.tx_rows(P.blocks(spark, d)).select("height", "tx_i", "payer")


@query(f"SELECT height, tx, denom, CAST(amount AS BIGINT) AS amount, CAST(r AS BIGINT) AS from_received, CAST(v AS BIGINT) AS from_transfer, used AS used_filter, NOT used AS used_fallback FROM {_IN}")
def ibc_amount_diagnose(spark, d):
    t = extract.tx_rows(P.blocks(spark, d)).where(F.col("ok") & (F.size(events.msg_indices_of(F.col("messages"), extract.IBC_IN)) > 0))
    got = extract.with_ibc_in(t).select("height", (F.col("height") * 4 + F.col("tx_i")).alias("tx"), F.inline("ibc_in"))
    return got.withColumns({c: F.col(c).cast("long") for c in ("amount", "from_received", "from_transfer")})


@query(f"SELECT height, upper(sha256(CAST(tx AS VARCHAR))) AS tx_hash, denom, CAST(amount AS BIGINT) AS amount FROM {_IN} WHERE denom IN ('den0', 'den1')")
def ibc_recv_hits(spark, d):
    return extract.recv_hits(extract.tx_rows(P.blocks(spark, d)), ["den0", "den1"]).withColumn("amount", F.col("amount").cast("long"))


@query("SELECT tx, CAST(count(*) AS INTEGER) AS urls, CAST(count(*) FILTER (k % 2 = 0) AS INTEGER) AS installs FROM p_x WHERE t = 'signup' GROUP BY 1")
def type_urls_from_events(spark, d):
    urls = events.type_urls_from_events(F.col("events"))
    t = extract.tx_rows(P.blocks(spark, d)).select((F.col("height") * 4 + F.col("tx_i")).alias("tx"), urls.alias("urls")).where("size(urls) > 0")
    return t.select("tx", F.size("urls").alias("urls"), F.size(F.filter("urls", lambda x: x == extract.INSTALL)).alias("installs"))


@query("""WITH p AS (SELECT tx, arg_max(u, i) FILTER (t = 'purchase') AS payer, coalesce(sum(c) FILTER (t = 'purchase'), 0) AS fee, bool_or(t = 'signup' AND k % 2 = 0) AS installs, bool_or(t = 'signup' AND k % 2 = 1) AS other FROM p_x WHERE NOT failed GROUP BY 1),
s AS (SELECT tx, sum(c) AS spent FROM p_x JOIN p USING (tx) WHERE t = 'error' AND u = payer GROUP BY 1)
SELECT upper(sha256(CAST(tx AS VARCHAR))) AS tx_hash, payer AS installer, CAST(fee AS BIGINT) AS gas_fee, CASE WHEN NOT other AND coalesce(spent, 0) > fee THEN CAST(spent - fee AS BIGINT) END AS storage_fee FROM p LEFT JOIN s USING (tx) WHERE installs""")
def bundle_installs(spark, d):
    got = extract.bundle_installs(extract.tx_rows(P.blocks(spark, d)))
    return got.select("tx_hash", "installer", F.col("gas_fee").cast("long").alias("gas_fee"), F.col("storage_fee").cast("long").alias("storage_fee"))


@query(f"SELECT day, u AS address, 'den' || CAST(k % 3 AS VARCHAR) AS denom, CAST(sum(c) AS BIGINT) AS volume FROM p_x WHERE {SENT} AND NOT failed GROUP BY ALL")
def address_volumes(spark, d):
    return extract.address_volumes(extract.tx_rows(P.blocks(spark, d))).withColumn("volume", F.col("volume").cast("long"))


@query("SELECT DISTINCT day, u AS address, unnest(['signer', 'fee_payer']) AS role FROM p_x WHERE i = 0 AND NOT failed")
def participants(spark, d):
    return extract.participants(extract.tx_rows(P.blocks(spark, d)))


_FAILED = "SELECT 'tx_failed' AS series, '' AS dimension, count(*) AS hourly, count(*) + count(DISTINCT day) AS daily FROM p_x WHERE i = 0 AND failed HAVING count(*) > 0"


@query(f"{_FAILED} UNION ALL SELECT 'ghost', 'x', CAST(0 AS BIGINT), CAST(7 AS BIGINT)")
def replay_parity(spark, d):
    """The rollup of the blocks against a stored one in which one is added to each day of a series and a series is made up."""
    replayed = daily(spark, d)
    stored = replayed.withColumn("value", F.col("value") + (F.col("series") == "tx_failed").cast("long"))
    ghost = spark.createDataFrame([("ghost", "x", 7)], "series string, dimension string, value long")
    return state.parity_check(replayed, stored.select("series", "dimension", "value").unionByName(ghost))


@query(SERIES_SQL["tx_outcome"])
def job_backfill_series(spark, d):
    """The two outcome series, stored up to a height in the middle, after a backfill of the blocks above it."""
    blocks = P.blocks(spark, d)
    middle = P.table(spark, d, "events").agg(F.expr("max(event_id) div 64").alias("h")).first()["h"]
    control = spark.createDataFrame([("j", middle)], "job string, last_height long")
    held = kpis.rollup_hours(extract.rollup_deltas(blocks.where(F.col("height") <= middle), MODULES))
    rows = [jobs.backfilled(held, blocks, control, "j", name, MODULES) for name in NAMES["tx_outcome"]]
    return kpis.rollup_days(rows[0].unionByName(rows[1])).withColumn("value", F.col("value").cast("long"))
