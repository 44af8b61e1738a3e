"""Queries over state changes and wallet messages made from the orders table: parsing, latest-state tables, and the series of
offers and outbound transfers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import capdata, denoms, events, time
from ..operators import extract, kpis, offers, windows
from ..sources import blocks as B
from ..sources import dims, store
from ..sources.files import new_folder
from . import proxy as P
from .registry import registry

QUERIES, ORACLES, query = registry()
P.SQL["p_c"] = (
    "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS m, o_orderpriority AS pri, CAST(o_orderdate AS DATE) AS d, o_orderkey // 16 AS height, "
    "DATE '2024-01-01' + CAST(o_orderkey // 16 % 90 AS INTEGER) AS day, row_number() OVER (PARTITION BY o_orderkey // 16 ORDER BY o_orderkey) - 1 AS ev_i, o_orderkey % 9 <> 0 AS ok FROM orders"
)
FLOW_TYPE = {"F": "deposit", "O": "withdraw", "P": "rebalance"}
FLOW_STATE = {"F": "done", "O": "run", "P": "fail"}
INSTANCES = ["ymax0", "VaultFactory", "psm-x"]


def fill(template: str, **values: Column) -> Column:
    """The template with each <name> replaced by a column's value."""
    parts = re.split(r"<(\w+)>", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _choose(of: Column, names: dict | list) -> Column:
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return F.coalesce(*[F.when(of == k, F.lit(v)) for k, v in pairs])


def _cells(spark, d, parts=None):
    """k, c, s, m, height, time, path, json, slots, url, body: one published value and one message of each order. parts: deals the orders by height, before anything is made of them."""
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), P.cents("o_totalprice").alias("m"), F.col("o_orderpriority").alias("pri"), F.to_date("o_orderdate").alias("d")).withColumn("height", F.expr("k div 16"))
    o = o.repartition(parts, "height") if parts else o
    k, c, s, m = (F.col(x) for x in "kcsm")
    v = {"k": k, "c": c, "m": m, "k2": k % 2, "k3": k % 3, "k4": k % 4, "k7": k % 7, "k11": k % 11, "c3": c % 3, "c100": c % 100, "ft": _choose(s, FLOW_TYPE), "st": _choose(s, FLOW_STATE), "inst": _choose(c % 3, INSTANCES)}
    even = c % 2 == 0
    wallet = fill('{"updated":"offerStatus","status":{"id":"o<k>","payouts":{"P":{"brand":"den<c3>","value":"+<m>"}},"numWantsSatisfied":<k2><err><spec>}}', **v, err=F.when(s == "P", ',"error":"boom"').otherwise(""), spec=F.when(even, ',"invitationSpec":{"source":"contract","instancePath":["ymax0"],"publicInvitationMaker":"M"}').otherwise(""))
    portfolio = fill('{"accountIdByChain":{"agoric":"cosmos:agoric-3:agoric<c>"},"accountStateByChain":{"Base":{"chainId":"eip155:8453","address":"0x<c>"}},"depositAddress":"dep<c>","flowCount":"+<k7>","policyVersion":<k4>,"flowsRunning":{"flow<k11>":{"type":"<ft>","amount":{"brand":"$0.Alleged: x","value":"+<m>"}}}}', **v)
    position = fill('{"accountId":"eip155:<id>:0x<c>","protocol":"P<c3>","totalIn":{"brand":"$0.Alleged: x","value":"+<m>"},"totalOut":{"brand":"$0.Alleged: x","value":"+<k>"},"netTransfers":{"brand":"$0.Alleged: x","value":"+<c>"}}', **v, id=F.when(even, "8453").otherwise("1"))
    flow, pool = fill('{"state":"<st>","step":<k3>,"how":"h<k2>"}', **v), fill('{"walletsProvisioned":"+<k>","totalMintedProvided":{"brand":"$0.x","value":"+<m>"},"totalMintedConverted":{"brand":"$0.x","value":"+<c>"}}', **v)
    home = [F.lit("ymax0"), F.lit("portfolios"), fill("portfolio<c100>", **v)]
    paths = [[F.lit("wallet"), fill("agoric<c>", **v)], home, [*home, F.lit("positions"), F.when(even, "Aave_Base").otherwise("Comp")], [*home, F.lit("flows"), fill("flow<k11>", **v)], [F.lit("provisionPool"), F.lit("metrics")]]
    offer = fill('{"owner":"agoric<c>","method":"executeOffer","offer":{"id":"o<k>","invitationSpec":{"source":"<src>","instancePath":["<inst>"],"publicInvitationMaker":"M<k3>"},"proposal":{"give":{"G":{"brand":"den<c3>","value":"+<m>"}},"want":{"W":{"brand":"den<k3>","value":"+<c>"}}}}}', **v, src=F.when(even, "contract").otherwise("agoricContract"))
    bodies = [offer, fill('{"owner":"agoric<c>","method":"invokeEntry","message":{"targetName":"<t>","id":"x<k>"}}', **v, t=F.when(even, "evmWalletHandler").otherwise("planner")), fill('{"sender":"agoric<c>","token":{"denom":"den<c3>","amount":"<m>"}}', **v), fill('{"owner":"agoric<c>","method":"tryExitOffer","offer":{}}', **v)]
    urls = [extract.WALLET[1], extract.WALLET[1], extract.IBC_OUT, extract.WALLET[0]]
    pick = lambda of, n, values: F.coalesce(*[F.when(of % n == i, x) for i, x in enumerate(values)])
    path = pick(k, 5, [F.array(F.lit("published"), *p) for p in paths])
    return o.select("k", "c", "s", "m", "pri", "d", "height", F.expr("timestamp'2024-01-01 05:30:00' + make_interval(0, 0, 0, cast(height % 90 as int))").alias("time"), path.alias("path"), pick(k, 5, [wallet, portfolio, position, flow, pool]).alias("json"), F.array(fill("board<c3>", **v)).alias("slots"), pick(k, 4, [F.lit(u) for u in urls]).alias("url"), pick(k, 4, bodies).alias("body"))


def _kv(**a: Column):
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in a.items()])


def _cell_value() -> Column:
    inner = F.to_json(F.struct(F.concat(F.lit("#"), F.col("json")).alias("body"), F.col("slots").alias("slots")))
    return F.to_json(F.struct(F.col("height").cast("string").alias("blockHeight"), F.array(inner).alias("values")))


def _key() -> Column:
    return F.concat(F.lit("3\u0000"), F.array_join("path", "\u0000"))


def chain_blocks(spark, d, parts=None):
    """Blocks of up to sixteen orders, each a transaction and a state change; dealt into `parts` by a hash of the height, if given."""
    event = F.struct(F.lit("state_change").alias("type"), _kv(key=_key(), value=_cell_value()).alias("attributes"))
    tx = F.struct(F.base64(F.col("k").cast("string").cast("binary")).alias("raw"), F.array(F.struct(F.col("url").alias("type_url"), F.col("body"))).alias("messages"), F.array(F.concat(F.lit("agoric"), F.col("c").cast("string"))).alias("signers"), F.lit(None).cast("string").alias("fee_granter"), F.lit(None).cast("string").alias("fee_payer"))
    result = F.struct((F.col("k") % 9 == 0).cast("int").alias("code"), F.lit("1").alias("gas_used"), F.lit("2").alias("gas_wanted"), F.array().cast(f"array<{B.EVENT}>").alias("events"))
    rows = _cells(spark, d, parts).select("height", "time", "k", event.alias("event"), tx.alias("tx"), result.alias("result"))
    b = rows.groupBy("height").agg(F.min("time").alias("time"), F.sort_array(F.collect_list(F.struct("k", "event", "tx", "result"))).alias("e"))  # sixteen rows
    return b.select("height", "time", F.col("e.tx").alias("txs"), F.col("e.result").alias("txs_results"), F.lit(None).cast(f"array<{B.EVENT}>").alias("finalize_block_events"), F.col("e.event").alias("end_block_events"), F.lit("-1").alias("max_gas"))


# --- functions


def _twice():
    """An event that has the key "a" twice."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))
    return F.struct(F.lit("x").alias("type"), F.array(pair("a", "s"), pair("b", "pri"), pair("a", "pri")).alias("attributes"))


@query("SELECT k, s AS value FROM p_c")
def attr_first(spark, d):
    return _cells(spark, d).select("k", events.attr_first(_twice(), "a").alias("value"))


@query("SELECT k, pri AS value FROM p_c")
def attr_last(spark, d):
    return _cells(spark, d).select("k", events.attr_last(_twice(), "a").alias("value"))


HOME = "'published.ymax0.portfolios.portfolio' || (c % 100)"
PATH = f"CASE k % 5 WHEN 0 THEN 'published.wallet.agoric' || c WHEN 1 THEN {HOME} WHEN 2 THEN {HOME} || '.positions.' || CASE WHEN c % 2 = 0 THEN 'Aave_Base' ELSE 'Comp' END WHEN 3 THEN {HOME} || '.flows.flow' || (k % 11) ELSE 'published.provisionPool.metrics' END"


@query(f"SELECT k, {PATH} AS path FROM p_c")
def vstorage_path(spark, d):
    return _cells(spark, d).select("k", F.array_join(capdata.vstorage_path(_key()), ".").alias("path"))


@query("SELECT k, CASE WHEN c % 7 = 0 THEN 'other' ELSE ['wallet', 'portfolio', 'position', 'flow', 'pool'][CAST(k % 5 + 1 AS INTEGER)] END AS kind FROM p_c")
def classify_state_path(spark, d):
    path = F.when(F.col("c") % 7 == 0, F.concat("path", F.array(F.lit("more"), F.lit("parts")))).otherwise(F.col("path"))
    return _cells(spark, d).select("k", capdata.classify_state_path(path).alias("kind"))


@query("SELECT k, CAST(CASE WHEN c % 3 = 0 THEN NULL ELSE 2 END AS INTEGER) AS entries, CASE WHEN c % 3 > 0 THEN s END AS last FROM p_c")
def stream_values(spark, d):
    cell = F.when(F.col("c") % 3 == 0, "no json").otherwise(F.to_json(F.struct(F.array(F.col("pri"), F.col("s")).alias("values"))))
    v = capdata.stream_values(cell)
    return _cells(spark, d).select("k", F.when(v.isNotNull(), F.size(v)).alias("entries"), F.try_element_at(v, F.lit(-1)).alias("last"))


@query("SELECT k, 'board' || (c % 3) AS brand, CAST(m AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS missing FROM p_c WHERE k % 5 = 2")
def capdata_fields(spark, d):
    f = capdata.capdata_fields(F.concat(F.lit("#"), F.col("json")), F.col("slots"), {"brand": "$.totalIn.brand", "value": "$.totalIn.value", "missing": "$.none"})
    return _cells(spark, d).where("k % 5 = 2").select("k", f.alias("f")).select("k", "f.*")


@query("SELECT k, CASE k % 4 WHEN 1 THEN 'wallet_invocation' ELSE 'zoe_offer' END AS kind, CASE WHEN k % 4 = 0 THEN CASE WHEN c % 2 = 0 THEN 'contract' ELSE 'agoricContract' END ELSE 'unknown' END AS source, CASE WHEN k % 4 = 0 THEN ['ymax0', 'VaultFactory', 'psm-x'][CAST(c % 3 + 1 AS INTEGER)] END AS instance_path, CASE WHEN k % 4 = 0 THEN 'M' || (k % 3) END AS maker, CASE WHEN k % 4 = 1 THEN CASE WHEN c % 2 = 0 THEN 'evmWalletHandler' ELSE 'planner' END END AS target, CASE k % 4 WHEN 0 THEN 'o' || k WHEN 1 THEN 'x' || k END AS offer_id FROM p_c WHERE k % 4 <> 2")
def wallet_action_fields(spark, d):
    f = _cells(spark, d).where("k % 4 <> 2").select("k", capdata.wallet_action_fields(F.col("body")).alias("f"))
    return f.select("k", "f.kind", "f.source", "f.instance_path", "f.maker", "f.target", "f.offer_id")


@query("SELECT k, keyword, brand, CAST(value AS BIGINT) AS value FROM (SELECT k, 'A' AS keyword, 'den' || (c % 3) AS brand, m AS value FROM p_c UNION ALL SELECT k, 'B', 'den' || (k % 3), c FROM p_c WHERE s <> 'P')")
def amount_legs(spark, d):
    bad = F.when(F.col("s") == "P", "-1").otherwise(F.concat(F.lit("+"), F.col("c").cast("string")))
    text = fill('{"A":{"brand":"den<a>","value":"+<m>"},"B":{"brand":"den<b>","value":"<v>"}}', a=F.col("c") % 3, m=F.col("m"), b=F.col("k") % 3, v=bad)
    return _cells(spark, d).select("k", F.inline(capdata.amount_legs(text))).withColumn("value", F.col("value").cast("long"))


OUTCOME = "CASE WHEN s = 'P' THEN 'errored' WHEN k % 2 = 0 THEN 'wants_unsatisfied' ELSE 'wants_satisfied' END"


@query(f"SELECT k, CASE WHEN k % 5 = 0 THEN {OUTCOME} END AS outcome FROM p_c")
def offer_status_fact(spark, d):
    return _cells(spark, d).select("k", capdata.offer_outcome(F.col("json")).alias("outcome"))


@query(f"SELECT k, CASE WHEN c % 4 > 0 THEN 'ymax' END AS category, CASE WHEN c % 4 > 0 THEN {OUTCOME} END AS outcome FROM p_c")
def parse_outcome_dim(spark, d):
    outcome = F.when(F.col("s") == "P", "errored").when(F.col("k") % 2 == 0, "wants_unsatisfied").otherwise("wants_satisfied")
    dim = offers.outcome_dim(F.when(F.col("c") % 4 == 0, "no such").otherwise("ymax"), outcome)
    return _cells(spark, d).select("k", offers.parse_outcome_dim(dim).alias("p")).select("k", "p.category", "p.outcome")


@query("SELECT k, CAST(CASE WHEN c % 3 = 0 THEN m + c ELSE 0 END AS BIGINT) AS amount FROM p_c")
def amount_of(spark, d):
    coins = events.sum_coins(events.parse_coins(fill("<m>den<a>, <c>den<a>,bad", m=F.col("m"), c=F.col("c"), a=F.col("c") % 3)))
    return _cells(spark, d).select("k", events.amount_of(coins, F.lit("den0")).cast("long").alias("amount"))


@query("SELECT k, CASE WHEN s <> 'P' THEN m END AS n FROM p_c")
def nat_of(spark, d):
    text = F.when(F.col("s") == "F", F.concat(F.lit("+"), F.col("m").cast("string"))).when(F.col("s") == "O", F.col("m").cast("string")).otherwise(F.concat(F.lit("-"), F.col("m").cast("string")))
    return _cells(spark, d).select("k", capdata.nat_of(text).cast("long").alias("n"))


@query("SELECT k, CASE WHEN c % 2 = 0 THEN 'cosmos:noble-1' END AS chain_id, CASE WHEN c % 2 = 0 THEN 'a:' || k ELSE 'plain' || k END AS address FROM p_c")
def split_account(spark, d):
    account = F.when(F.col("c") % 2 == 0, fill("cosmos:noble-1:a:<k>", k=F.col("k"))).otherwise(fill("plain<k>", k=F.col("k")))
    return _cells(spark, d).select("k", capdata.split_account(account).alias("a")).select("k", "a.chain_id", "a.address")


@query("SELECT k, 'P' || (c % 3) AS protocol, CASE WHEN c % 2 = 0 THEN 'Base' ELSE 'Ethereum' END AS chain, m AS total_in, k AS total_out, c AS net FROM p_c WHERE k % 5 = 2")
def position_fields(spark, d):
    f = _cells(spark, d).where("k % 5 = 2").select("k", capdata.position_fields(F.col("json"), F.element_at("path", -1)).alias("f"))
    return f.select("k", "f.protocol", "f.chain", *[F.col(f"f.{x}").cast("long").alias(x) for x in ("total_in", "total_out", "net")])


@query("SELECT k, 'cosmos:agoric-3:agoric' || c AS agoric, 'eip155:8453:0x' || c AS base, 'dep' || c AS deposit, k % 7 AS flow_count, 'flow' || (k % 11) AS flow FROM p_c WHERE k % 5 = 1")
def portfolio_fields(spark, d):
    f = _cells(spark, d).where("k % 5 = 1").select("k", capdata.portfolio_fields(F.col("json")).alias("f"))
    return f.select("k", F.col("f.accounts")["agoric"].alias("agoric"), F.col("f.accounts")["Base"].alias("base"), "f.deposit", "f.flow_count", F.map_keys("f.flows")[0].alias("flow"))


@query("SELECT k, 'h' || (k % 2) AS how, CASE s WHEN 'F' THEN 'done' WHEN 'O' THEN 'run' ELSE 'fail' END AS state, CAST(k % 3 AS INTEGER) AS step, s <> 'O' AS terminal FROM p_c WHERE k % 5 = 3")
def flow_fields(spark, d):
    return _cells(spark, d).where("k % 5 = 3").select("k", capdata.flow_fields(F.col("json")).alias("f")).select("k", "f.*")


@query("SELECT k, CASE k % 5 WHEN 0 THEN 'Gravity Bridge' WHEN 1 THEN 'Axelar' WHEN 2 THEN 'maker' || c WHEN 3 THEN 'Injective' ELSE CASE WHEN c % 2 = 0 THEN 'Hub' END END AS origin FROM p_c")
def origin_label(spark, d):
    base = _choose(F.col("k") % 5, ["gravity0xab", "eth-wei", "", "peggy0xab", "uatom"])
    base = F.when(F.col("k") % 5 == 2, fill("factory/maker<c>/x", c=F.col("c"))).otherwise(base)
    hop = F.when(F.col("c") % 2 == 0, "channel-1").otherwise("channel-9")
    return _cells(spark, d).select("k", denoms.origin_label(base, hop, {"channel-1": "Hub"}).alias("origin"))


@query("SELECT k, CASE k % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'atom-id' WHEN 2 THEN 'atom-id' END AS price_id FROM p_c")
def price_id_of(spark, d):
    o = _cells(spark, d).select("k", fill("d<x>", x=F.col("k") % 4).alias("denom"), _choose(F.col("k") % 4, ["ATOM", "ATOM", "ATOM (Hub) (old)", "none"]).alias("label"))
    overrides = spark.createDataFrame([("d0", "fixed"), ("d1", "")], "denom string, id string")
    symbols = spark.createDataFrame([("ATOM", "atom-id"), ("none", "")], "symbol string, id string")
    return denoms.price_id_of(o, overrides, symbols).select("k", "price_id")


@query("SELECT 'den' || (c % 50) AS denom, 'first' || min(k) AS name, CASE WHEN min(k) % 2 = 0 THEN 6 END AS decimals FROM p_c GROUP BY c % 50")
def registry_entries(spark, d):
    """A published list for each denomination, in the order of keys; the pair of the smallest key is the first."""
    first = _cells(spark, d).groupBy((F.col("c") % 50).alias("n")).agg(F.min("k").alias("k"))
    places = F.when(F.col("k") % 2 == 0, "6").otherwise("99")
    text = fill('[["den<n>",{"issuerName":"first<k>","displayInfo":{"decimalPlaces":<p>}}],["den<n>",{"issuerName":"later","displayInfo":{"decimalPlaces":2}}],["broken"],["",{}]]', n=F.col("n"), k=F.col("k"), p=places)
    return denoms.registry_entries(first.select(text.alias("text")))


def _window(spark, d, f, bounds=("1997-01-01", "1997-03-31")):
    """The orders in the window that a function of dates gives for a range, by day."""
    from datetime import date

    a, b = f(*(date.fromisoformat(x) for x in bounds))
    return _cells(spark, d).where(F.col("d").between(F.lit(a), F.lit(b))).groupBy("d").agg(F.count(F.lit(1)).alias("orders"))


def _in_window(a: str, b: str) -> str:
    return f"SELECT d, count(*) AS orders FROM p_c WHERE d BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1"


@query(_in_window("1996-10-03", "1996-12-31"))
def prior_window(spark, d):
    return _window(spark, d, time.prior_window)


@query(_in_window("1996-07-05", "1996-10-02"))
def prior_prior_window(spark, d):
    return _window(spark, d, time.prior_prior_window)


@query(_in_window("1996-12-02", "1996-12-31"))
def context_window(spark, d):
    """Of a range shorter than the look-back."""
    return _window(spark, d, time.context_window, ("1997-01-01", "1997-01-05"))


@query("SELECT d, count(*) AS orders FROM p_c WHERE d BETWEEN (SELECT min(d) FROM p_c) AND greatest(DATE '1995-06-30', (SELECT min(d) FROM p_c)) GROUP BY 1")
def clamp_range(spark, d):
    """A range that begins before the first day of the table."""
    first = _cells(spark, d).agg(F.min("d").alias("d")).first()["d"]
    return _window(spark, d, lambda a, b: time.clamp_range(a, b, first), ("1990-01-01", "1995-06-30"))


@query(_in_window("1995-01-01", "1995-12-31"))
def validate_range(spark, d):
    return _window(spark, d, lambda a, b: time.validate_range(a.isoformat(), b.isoformat(), "day"), ("1995-01-01", "1995-12-31"))


@query("SELECT 'den' || (c % 50) AS denom, 'S' || min(k) AS symbol, CAST(c % 50 % 19 AS INTEGER) AS decimals, CASE WHEN c % 50 % 4 > 0 THEN 'id' || (c % 50 % 7) END AS price_id FROM p_c GROUP BY c % 50")
def load_dims(spark, d):
    """The denominations of registries, one JSON text each."""
    first = _cells(spark, d).groupBy((F.col("c") % 50).alias("n")).agg(F.min("k").alias("k"))
    n = F.col("n")
    text = fill('{"denoms":[{"denom":"den<n>","symbol":"S<k>","decimals":<p>,"priceId":"<i>"},{"denom":"","symbol":"x"},{"denom":"den<n>","symbol":"later"}],"instances":{"board<n>":"name"},"brands":{},"modules":["m<n>"]}', n=n, k=F.col("k"), p=n % 19, i=F.when(n % 4 > 0, fill("id<x>", x=n % 7)).otherwise(""))
    return dims.dims_of(first.select(text.alias("value")))["denoms"]


@query("SELECT height, count(*) AS txs, CAST(count(*) FILTER (ok) AS BIGINT) AS succeeded FROM p_c GROUP BY 1")
def read_blocks(spark, d):
    """Blocks written as landing files of JSON and read back by their fixed schema."""
    path = new_folder(spark, "landing")
    chain_blocks(spark, d).write.json(path)
    b = B.read_blocks(spark, path)
    return b.select("height", F.size("txs").cast("long").alias("txs"), F.size(F.filter("txs_results", lambda r: r["code"] == 0)).cast("long").alias("succeeded"))


# --- series


def _series(names, days=None):
    def run(spark, d):
        rows = kpis.rollup_days(kpis.rollup_hours(extract.rollup_deltas(chain_blocks(spark, d))))
        return rows.where(F.col("series").isin(names)).withColumn("value", F.col("value").cast("long"))

    return run


def _sum(series, dim, value, where):
    v = "count(*)" if value == "1" else f"CAST(sum({value}) AS BIGINT)"
    return f"SELECT day, '{series}' AS series, {dim} AS dimension, {v} AS value FROM p_c WHERE {where} GROUP BY ALL HAVING {v} <> 0"


_OFFER, _CALL = "ok AND k % 4 IN (0, 3)", "ok AND k % 4 = 1"
_BY_INST = "CASE WHEN k % 4 = 3 THEN 'other' ELSE ['ymax', 'vaults', 'psm'][CAST(c % 3 + 1 AS INTEGER)] END"
_TARGET = "CASE WHEN c % 2 = 0 THEN 'evmWalletHandler' ELSE 'planner' END"
_ACTION = "CASE WHEN k % 4 = 1 THEN 'wallet_invocation' ELSE 'zoe_offer' END"
_CATEGORY = f"CASE WHEN k % 4 = 1 THEN CASE WHEN c % 2 = 0 THEN 'ymax' ELSE 'orchestration' END ELSE {_BY_INST} END"
SERIES = {
    "ibc_out": (["ibc_transfer_amount_out", "ibc_transfer_out_count"], [_sum("ibc_transfer_amount_out", "'den' || (c % 3)", "m", "ok AND k % 4 = 2"), _sum("ibc_transfer_out_count", "''", "1", "ok AND k % 4 = 2")]),
    "wallet_action_deltas": (
        ["wallet_actions", "offer_category", "offer_source", "offer_maker", "invoke_target"],
        [_sum("wallet_actions", _ACTION, "1", "ok AND k % 4 <> 2"), _sum("offer_category", _CATEGORY, "1", "ok AND k % 4 <> 2"), _sum("offer_source", "CASE WHEN k % 4 = 3 THEN 'unknown' WHEN c % 2 = 0 THEN 'contract' ELSE 'agoricContract' END", "1", _OFFER), _sum("offer_maker", "'M' || (k % 3)", "1", "ok AND k % 4 = 0"), _sum("invoke_target", _TARGET, "1", _CALL)],
    ),
    "offer_leg_volume": (["offer_give_volume", "offer_want_volume"], [_sum("offer_give_volume", "'den' || (c % 3)", "m", "ok AND k % 4 = 0"), _sum("offer_want_volume", "'den' || (k % 3)", "c", "ok AND k % 4 = 0")]),
    "offer_outcomes": (
        ["offer_outcome", "offer_outcome_category", "offer_payout_volume"],
        [_sum("offer_outcome", OUTCOME, "1", "k % 5 = 0"), _sum("offer_outcome_category", f"CASE WHEN c % 2 = 0 THEN 'ymax|' ELSE 'unclassified|' END || {OUTCOME}", "1", "k % 5 = 0"), _sum("offer_payout_volume", "'den' || (c % 3)", "m", "k % 5 = 0")],
    ),
}
for _name, (_names, _sqls) in SERIES.items():
    query(" UNION ALL ".join(_sqls), _name)(_series(_names))


# --- latest state

_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY height DESC, ev_i DESC) = 1"


@query(f"SELECT day, k AS wallets, m AS minted, c AS converted, height FROM p_c WHERE k % 5 = 4 {_LAST.format('day')}")
def pool_snapshots(spark, d):
    rows = extract.pool_snapshots(chain_blocks(spark, d))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("minted", "converted")})


@query(f"SELECT 'ymax0' AS contract, 'portfolio' || (c % 100) AS portfolio, 'dep' || c AS deposit, 'agoric' || c AS agoric_account, k % 4 AS policy_version, k % 7 AS flow_count, height FROM p_c WHERE k % 5 = 1 {_LAST.format('c % 100')}")
def portfolio_latest(spark, d):
    rows = windows.latest_row(extract.portfolio_rows(extract.state_cells(chain_blocks(spark, d))), ["contract", "portfolio"], ["height", "seq"])
    return rows.select("contract", "portfolio", "deposit", "agoric_account", "policy_version", "flow_count", "height")


@query(f"SELECT 'portfolio' || (c % 100) AS portfolio, CASE WHEN c % 2 = 0 THEN 'Aave_Base' ELSE 'Comp' END AS position_key, 'P' || (c % 3) AS protocol, CASE WHEN c % 2 = 0 THEN 'Base' ELSE 'Ethereum' END AS chain, CASE c % 3 WHEN 0 THEN 'uusdc' WHEN 1 THEN 'ubld' END AS denom, m AS total_in, k AS total_out, height FROM p_c WHERE k % 5 = 2 {_LAST.format('c % 100, c % 2')}")
def position_latest(spark, d):
    rows = extract.position_rows(extract.state_cells(chain_blocks(spark, d)), {"board0": "uusdc", "board1": "ubld"})
    rows = windows.latest_row(rows, ["contract", "portfolio", "position_key"], ["height", "seq"])
    return rows.select("portfolio", "position_key", "protocol", "chain", "denom", F.col("total_in").cast("long").alias("total_in"), F.col("total_out").cast("long").alias("total_out"), "height")


_AT = "height * 1000 + ev_i * 2"
FLOWS_SQL = f"""WITH r AS (SELECT c % 100 AS p, k % 11 AS f, CASE s WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdraw' ELSE 'rebalance' END AS flow_type, 'board' || (c % 3) AS denom, m AS amount, day, height, {_AT} AS o, height * 100000 + ev_i AS w, 'run' AS state FROM p_c WHERE k % 5 = 1
UNION ALL SELECT c % 100, k % 11, NULL, NULL, NULL, day, height, {_AT}, height * 100000 + 50000 + ev_i, CASE s WHEN 'F' THEN 'done' WHEN 'O' THEN 'run' ELSE 'fail' END FROM p_c WHERE k % 5 = 3)
SELECT 'portfolio' || p AS portfolio, 'flow' || f AS flow_id, coalesce(arg_min(flow_type, o) FILTER (flow_type IS NOT NULL), 'unknown') AS flow_type, arg_min(denom, o) FILTER (denom IS NOT NULL) AS denom, arg_min(amount, o) FILTER (amount IS NOT NULL) AS amount, min(day) AS day, min(height) AS first_height, arg_max(state, w) AS last_state, max(height) AS last_height FROM r GROUP BY p, f"""


@query(FLOWS_SQL)
def flow_latest(spark, d):
    rows = store.merge_flow(extract.flow_rows(extract.state_cells(chain_blocks(spark, d))), ["contract", "portfolio", "flow_id"])
    return rows.drop("contract").withColumn("amount", F.col("amount").cast("long"))


@query(f"SELECT DISTINCT day, 'agoric' || c AS address, {_ACTION} AS kind, {_CATEGORY} AS category FROM p_c WHERE ok AND k % 4 <> 2")
def offer_actions(spark, d):
    return extract.offer_actions(extract.tx_rows(chain_blocks(spark, d))).distinct()
