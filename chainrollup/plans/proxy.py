"""Views in the shape of chain tables over the star-schema tables, in Spark and, for the oracles, as SQL of the other engine."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.offers import CATEGORIES, OUTCOMES

NOW, BEFORE = (date(2024, 1, 16), date(2024, 1, 25)), (date(2024, 1, 6), date(2024, 1, 15))
LEGS, LEGS_BEFORE = (date(1997, 1, 1), date(1997, 3, 31)), (date(1996, 10, 3), date(1996, 12, 31))
FLOORS = {"click": datetime(2024, 1, 5, 6, 51, 13), "view": datetime(2024, 1, 1), "purchase": datetime(2024, 1, 19, 1, 52)}
CATS, OUTS = CATEGORIES, OUTCOMES
DENOMS = [  # (denom, symbol, decimals, price_id): one without an id, one without decimals
    ("AF", "ALF", 2, "alpha"), ("AO", "ALO", 2, "alpha-o"), ("NF", "NEF", 3, "nu"), ("NO", "NEO", 2, None), ("RF", "REF", None, "rho"), ("RO", "REO", 4, "rho-o"),
    ("1-URGENT", "URG", 2, "alpha"), ("2-HIGH", "HIG", 2, "nu"), ("3-MEDIUM", "MED", 2, "rho"), ("4-NOT SPECIFIED", "NOT", 2, "gone"), ("5-LOW", "LOW", 2, "rho-o"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def deltas(spark, d):
    e = table(spark, d, "events")
    return e.select(F.date_trunc("hour", "ts").alias("hour"), F.to_date("ts").alias("day"), F.col("event_type").alias("series"), (_k() % 5).cast("string").alias("dimension"), cents("value").alias("delta"))


def metric_hour(spark, d):
    return deltas(spark, d).groupBy("hour", "day", "series", "dimension").agg(F.sum("delta").alias("value"))


def metric_day(spark, d):
    return deltas(spark, d).groupBy("day", "series", "dimension").agg(F.sum("delta").alias("value"))


def tx(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("height"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("string").alias("signer"), (F.col("o_orderstatus") == "F").cast("int").alias("code"), cents("o_totalprice").alias("fee"), F.col("o_orderpriority").alias("denom"))


def legs(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").cast("string").alias("address"), F.concat("l_returnflag", "l_linestatus").alias("denom"), cents("l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") % 2 == 0, "in").otherwise("out").alias("direction"))


def participant(spark, d):
    return table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("address"), F.when(F.col("event_type").isin("click", "view"), "signer").otherwise("fee_payer").alias("role"))


def action(spark, d):
    e = table(spark, d, "events")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), k + 1)
    kind = F.when(F.col("event_type").isin("click", "view"), "zoe_offer").when(F.col("event_type") == "purchase", "wallet_invocation").otherwise("unknown")
    return e.select("event_id", F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("owner"), kind.alias("kind"), pick(CATS, _k() % 9).alias("category"), pick(OUTS, _k() % 3).alias("outcome"), _k().alias("k"))


def denoms(spark, d=None):
    return spark.createDataFrame(DENOMS, "denom string, symbol string, decimals int, price_id string")


def prices(spark, d):
    ids = denoms(spark).where("price_id IS NOT NULL").groupBy("denom").agg(F.first("price_id").alias("price_id"))
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("denom"), "o_totalprice")
    rows = o.where(F.dayofmonth("day") % 3 != 0).join(F.broadcast(ids), "denom")
    return rows.groupBy("price_id", "day").agg((F.round(F.max("o_totalprice")) / 1000).alias("usd"))


def spot(spark, d):
    p = table(spark, d, "part").groupBy(F.expr("element_at(array('alpha', 'alpha-o', 'nu', 'gone-too', 'rho-o'), cast(p_partkey % 5 as int) + 1)").alias("price_id"))
    return p.agg((F.round(F.max("p_retailprice")) / 100).alias("usd"))


def position_rows(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey") % 50
    return li.select(F.col("l_linestatus").alias("contract"), F.col("l_suppkey").cast("string").alias("portfolio"), k.cast("string").alias("position_key"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("protocol"), F.concat(F.lit("C"), (k % 4).cast("string")).alias("chain"), F.concat("l_returnflag", "l_linestatus").alias("denom"), cents("l_extendedprice").alias("total_in"), (F.col("l_quantity") * 100000).cast("long").alias("total_out"), F.col("l_orderkey").alias("height"), F.col("l_linenumber").cast("long").alias("seq"))


def position(spark, d):
    from ..operators.windows import latest_row

    return latest_row(position_rows(spark, d), ["contract", "portfolio", "position_key"], ["height", "seq", "total_in", "total_out"])


def flow_rows(spark, d):
    o = table(spark, d, "orders")
    t = F.when(F.col("o_orderpriority") == "1-URGENT", "deposit").when(F.col("o_orderpriority") == "2-HIGH", "withdraw").when(F.col("o_orderpriority") == "3-MEDIUM", "rebalance")
    paid = F.col("o_orderstatus") != "P"
    return o.select((F.col("o_custkey") % 500).cast("string").alias("flow_id"), t.alias("flow_type"), F.when(paid, F.col("o_orderpriority")).alias("denom"), F.when(paid, cents("o_totalprice")).alias("amount"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("height"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 2).alias("progress"), F.lit(0).alias("seq"))


def landing(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("tx_hash"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 50).cast("string").alias("installer"), cents("o_totalprice").alias("gas_fee"), F.when(F.col("o_orderstatus") != "P", cents("o_totalprice") * 3).alias("storage_fee"))


def snapshot(spark, d):
    """Cumulative counters by day; the running sums go over days (one row each), not over orders."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(10_000_000 + (F.col("o_orderkey") % 7) * 30_000).alias("m"), F.max("o_orderkey").alias("height"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    return o.select("day", F.sum("n").over(w).alias("wallets"), F.sum("m").over(w).alias("minted"), "height")


def _values(rows, cols):
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"TIMESTAMP '{v}'" if isinstance(v, datetime) else f"'{v}'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({cols})"


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_PICK = lambda names, k: "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
SQL = {
    "p_delta": f"SELECT date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day, event_type AS series, CAST({_K} % 5 AS VARCHAR) AS dimension, CAST(round(value * 100) AS BIGINT) AS delta FROM events",
    "p_hour": "SELECT hour, day, series, dimension, CAST(sum(delta) AS BIGINT) AS value FROM p_delta GROUP BY ALL",
    "p_day": "SELECT day, series, dimension, CAST(sum(delta) AS BIGINT) AS value FROM p_delta GROUP BY ALL",
    "p_floor": _values([(k, v) for k, v in FLOORS.items()], "series, floor"),
    "p_tx": "SELECT o_orderkey AS height, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey AS VARCHAR) AS signer, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS code, CAST(round(o_totalprice * 100) AS BIGINT) AS fee, o_orderpriority AS denom FROM orders",
    "p_legs": "SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey AS VARCHAR) AS address, l_returnflag || l_linestatus AS denom, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END AS direction FROM lineitem",
    "p_part": "SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS address, CASE WHEN event_type IN ('click', 'view') THEN 'signer' ELSE 'fee_payer' END AS role FROM events",
    "p_action": f"SELECT event_id, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS owner, CASE WHEN event_type IN ('click', 'view') THEN 'zoe_offer' WHEN event_type = 'purchase' THEN 'wallet_invocation' ELSE 'unknown' END AS kind, {_PICK(CATS, f'{_K} % 9')} AS category, {_PICK(OUTS, f'{_K} % 3')} AS outcome, {_K} AS k FROM events",
    "p_denom": _values(DENOMS, "denom, symbol, decimals, price_id"),
    "p_price": "SELECT d.price_id, CAST(o_orderdate AS DATE) AS day, round(max(o_totalprice)) / 1000 AS usd FROM orders JOIN p_denom d ON d.denom = o_orderpriority WHERE day(o_orderdate) % 3 <> 0 AND d.price_id IS NOT NULL GROUP BY 1, 2",
    "p_spot": "SELECT ['alpha', 'alpha-o', 'nu', 'gone-too', 'rho-o'][CAST(p_partkey % 5 AS INTEGER) + 1] AS price_id, round(max(p_retailprice)) / 100 AS usd FROM part GROUP BY 1",
    "p_priced": "SELECT l.*, d.decimals, d.price_id, CASE WHEN amount = 0 THEN 0.0 ELSE amount / pow(10, d.decimals) * coalesce(p.usd, s.usd) END AS usd, CASE WHEN amount = 0 OR d.decimals IS NULL THEN 'unpriced' WHEN p.usd IS NOT NULL THEN 'day' WHEN s.usd IS NOT NULL THEN 'spot' ELSE 'unpriced' END AS basis FROM (SELECT day, address, denom, direction, CAST(sum(amount) AS BIGINT) AS amount FROM p_legs GROUP BY ALL) l LEFT JOIN p_denom d USING (denom) LEFT JOIN p_price p ON p.price_id = d.price_id AND p.day = l.day LEFT JOIN p_spot s ON s.price_id = d.price_id",
    "p_pos_rows": "SELECT l_linestatus AS contract, CAST(l_suppkey AS VARCHAR) AS portfolio, CAST(l_partkey % 50 AS VARCHAR) AS position_key, 'P' || CAST(l_partkey % 50 % 3 AS VARCHAR) AS protocol, 'C' || CAST(l_partkey % 50 % 4 AS VARCHAR) AS chain, l_returnflag || l_linestatus AS denom, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_in, CAST(l_quantity * 100000 AS BIGINT) AS total_out, l_orderkey AS height, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem",
    "p_position": "SELECT * FROM p_pos_rows QUALIFY row_number() OVER (PARTITION BY contract, portfolio, position_key ORDER BY height DESC, seq DESC, total_in DESC, total_out DESC) = 1",
    "p_flow_rows": "SELECT CAST(o_custkey % 500 AS VARCHAR) AS flow_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'deposit' WHEN '2-HIGH' THEN 'withdraw' WHEN '3-MEDIUM' THEN 'rebalance' END AS flow_type, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS denom, CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount, CAST(o_orderdate AS DATE) AS day, o_orderkey AS height, o_orderstatus AS state, o_orderkey % 2 AS progress FROM orders",
    "p_landing": "SELECT CAST(o_orderkey AS VARCHAR) AS tx_hash, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 50 AS VARCHAR) AS installer, CAST(round(o_totalprice * 100) AS BIGINT) AS gas_fee, CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) * 3 END AS storage_fee FROM orders",
    "p_snap": "SELECT day, CAST(sum(n) OVER w AS BIGINT) AS wallets, CAST(sum(m) OVER w AS BIGINT) AS minted, height FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(10000000 + (o_orderkey % 7) * 30000) AS m, max(o_orderkey) AS height FROM orders GROUP BY 1) WINDOW w AS (ORDER BY day)",
    "p_diff": "SELECT day, wallets, minted, height, CASE WHEN ok THEN a END AS n_new, CASE WHEN ok THEN b END AS n_minted, CASE WHEN ok AND a > 0 THEN b / a END AS rate, gap_days FROM (SELECT *, wallets - lag(wallets) OVER (ORDER BY day) AS a, minted - lag(minted) OVER (ORDER BY day) AS b, a >= 0 AND b >= 0 AS ok, date_diff('day', lag(day) OVER (ORDER BY day), day) - 1 AS gap_days FROM p_snap)",
}


def oracle(sql: str) -> str:
    """The query with the views it names before it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(SQL[name])
                used.append(name)

    need(sql)
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


SQL["p_x"] = f"SELECT event_id, event_id // 8 AS tx, event_id // 32 AS height, event_id % 8 AS i, event_type AS t, CAST(user_id AS VARCHAR) AS u, CAST(round(value * 100) AS BIGINT) AS c, {_K} AS k, CAST(min(ts) OVER (PARTITION BY event_id // 32) AS DATE) AS day, (event_id // 8) % 5 = 0 AS failed FROM events"


def blocks(spark, d):
    """Blocks with results out of `events`: eight consecutive events are a transaction, four transactions a block."""
    from ..sources.blocks import EVENT

    e = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("t"), F.col("user_id").cast("string").alias("u"), cents("value").cast("string").alias("c"), _k().alias("k"))
    kv = lambda **a: F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in a.items()])
    coin, bld = F.concat("c", F.lit("den"), (F.col("k") % 3).cast("string")), F.concat("c", F.lit("ubld"))
    at = F.col("event_id") % 3
    kinds = {
        "click": ("coin_received", kv(receiver=F.col("u"), amount=coin, msg_index=at)), "view": ("transfer", kv(recipient=F.col("u"), amount=coin, msg_index=at)), "purchase": ("tx", kv(fee=bld, fee_payer=F.col("u"))),
        "signup": ("message", kv(action=F.when(F.col("k") % 2 == 0, "/agoric.swingset.MsgInstallBundle").otherwise("/x"))), "error": ("coin_spent", kv(spender=F.col("u"), amount=bld)),
    }
    event = F.coalesce(*[F.when(F.col("t") == t, F.struct(F.lit(n).alias("type"), a.alias("attributes"))) for t, (n, a) in kinds.items()])
    send = F.to_json(F.struct(F.col("u").alias("fromAddress"), F.array(F.struct(F.concat(F.lit("den"), (F.col("k") % 3).cast("string")).alias("denom"), F.col("c").alias("amount"))).alias("amount")))
    other = F.col("k") % 3 == 0
    url = F.when(other, F.when(F.col("k") % 2 == 0, "/ibc.core.channel.v1.MsgRecvPacket").otherwise("/cosmos.gov.v1.MsgVote")).otherwise("/cosmos.bank.v1beta1.MsgSend")
    trace = F.when(F.col("k") % 2 == 0, F.concat(F.lit("transfer/channel-"), F.col("k").cast("string"))).otherwise("ubld")
    packet = F.struct(F.lit("send_packet").alias("type"), kv(packet_src_port=F.lit("transfer"), mode=F.when(F.col("event_id") % 2 == 0, "EndBlock").otherwise("DeliverTx"), packet_data=F.to_json(F.struct(trace.alias("denom"), F.col("c").alias("amount")))).alias("attributes"))
    e = e.select("event_id", "ts", "u", F.col("c").cast("long").alias("n"), event.alias("event"), F.struct(url.alias("type_url"), F.when(other, "{}").otherwise(send).alias("body")).alias("message"), F.when(F.col("t") == "error", packet).alias("packet"))
    row = F.sort_array(F.collect_list(F.struct("event_id", "u", "n", "event", "message", "packet")))  # eight rows
    txs = e.groupBy(F.expr("event_id div 8").alias("tx_id")).agg(row.alias("r"), F.sum("n").alias("gas"), F.min("ts").alias("ts"))
    tx_ = F.struct(F.base64(F.col("tx_id").cast("string").cast("binary")).alias("raw"), F.col("r.message").alias("messages"), F.slice(F.col("r.u"), 1, 1).alias("signers"), F.lit(None).cast("string").alias("fee_granter"), F.lit(None).cast("string").alias("fee_payer"))
    result = F.struct((F.col("tx_id") % 5 == 0).cast("int").alias("code"), F.col("gas").cast("string").alias("gas_used"), (F.col("gas") * 2).cast("string").alias("gas_wanted"), F.col("r.event").alias("events"))
    txs = txs.select("tx_id", "ts", tx_.alias("tx"), result.alias("result"), F.array_compact(F.col("r.packet")).alias("packets"))
    each = F.sort_array(F.collect_list(F.struct("tx_id", F.struct("tx", "result", "packets").alias("p"))))  # four rows
    b = txs.groupBy(F.expr("tx_id div 4").alias("height")).agg(F.min("ts").alias("time"), each.alias("e"))
    return b.select("height", "time", F.col("e.p.tx").alias("txs"), F.col("e.p.result").alias("txs_results"), F.lit(None).cast(f"array<{EVENT}>").alias("finalize_block_events"), F.flatten(F.col("e.p.packets")).alias("end_block_events"), F.when(F.col("height") % 10 == 0, "-1").otherwise("1000000").alias("max_gas"))
