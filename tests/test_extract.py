"""Parsing and extraction on hand-made blocks."""

import json

import pytest
from pyspark.sql import functions as F

from chainrollup.functions import capdata, denoms, events
from chainrollup.operators import extract, kpis, offers
from chainrollup.sources.blocks import BLOCK, explode_tx_events, pair_txs, pairing_mismatches, read_blocks

BLOCK_A = {
    "height": 100, "time": "2026-05-30T06:59:57Z", "max_gas": "120000000",
    "txs": [
        {"raw": "AA==", "signers": ["a1"], "messages": [{"type_url": "/cosmos.bank.v1beta1.MsgSend", "body": json.dumps({"fromAddress": "a1", "amount": [{"denom": "ubld", "amount": "7"}]})}]},
        {"raw": "AQ==", "signers": ["a2"], "messages": []},
    ],
    "txs_results": [
        {"code": 0, "gas_used": "10", "gas_wanted": "20", "events": [
            {"type": "tx", "attributes": [{"key": "fee", "value": "5ubld"}, {"key": "fee_payer", "value": "a1"}]},
            {"type": "coin_received", "attributes": [{"key": "receiver", "value": "a3"}, {"key": "amount", "value": "7ubld"}]}]},
        {"code": 5, "gas_used": "3", "gas_wanted": "4", "events": [{"type": "tx", "attributes": [{"key": "fee", "value": "2ubld"}, {"key": "fee_payer", "value": "a2"}]}]},
    ],
    "finalize_block_events": [],
}


def ev(kind, **attrs):
    return {"type": kind, "attributes": [{"key": k, "value": str(v)} for k, v in attrs.items()]}


@pytest.fixture()
def blocks(spark, tmp_path):
    def make(*rows):
        path = tmp_path / f"b{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        return read_blocks(spark, str(path))

    return make


def one_tx(evs, messages=(), code=0, signers=("s",), raw="AA=="):
    return {"height": 1, "time": "2026-01-02T03:04:05Z", "txs": [{"raw": raw, "signers": list(signers), "messages": [{"type_url": t, "body": b} for t, b in messages]}], "txs_results": [{"code": code, "gas_used": "1", "gas_wanted": "1", "events": evs}]}


def test_block_to_rollups(blocks):
    b = blocks(BLOCK_A)
    days = kpis.rollup_days(kpis.rollup_hours(extract.all_deltas(b)))
    got = {(r.series, r.dimension): int(r.value) for r in days.collect()}
    assert got == {("tx_success", ""): 1, ("tx_failed", ""): 1, ("gas_used", ""): 13, ("gas_wanted", ""): 24, ("block_gas_limit", ""): 120000000, ("fee_paid", "ubld"): 7, ("transfer_volume", "ubld"): 7, ("bank_credits_volume", "ubld"): 7}
    txs = extract.tx_rows(b)
    assert {(r.address, r.role) for r in extract.participants(txs).collect()} == {("a1", "signer"), ("a1", "fee_payer")}
    assert {(r.address, int(r.fee)) for r in extract.address_fees(txs).collect()} == {("a1", 5), ("a2", 2)}
    assert {(r.address, int(r.volume)) for r in extract.address_volumes(txs).collect()} == {("a1", 7)}


def test_module_accounts_are_no_credits_and_mismatches_are_reported(blocks):
    b = blocks(BLOCK_A, dict(BLOCK_A, height=101, txs_results=BLOCK_A["txs_results"][:1]), {"height": 102, "time": "2026-05-30T07:00:00Z"})
    assert extract.tx_deltas(extract.tx_rows(b), ["a3"]).select(F.inline("deltas")).where("series = 'bank_credits_volume'").count() == 0
    assert [tuple(r) for r in pairing_mismatches(b).collect()] == [(101, 1, 0)]
    assert pair_txs(b).count() == 3
    assert explode_tx_events(pair_txs(b)).count() == 5


@pytest.mark.parametrize(("evs", "messages", "want"), [
    ([ev("coin_received", amount="1000ubld")], 1, {"ubld": 1000}),
    ([ev("coin_received", amount="100ubld", msg_index=0), ev("coin_received", amount="999uist", msg_index=1)], 1, {"ubld": 100}),
    ([ev("coin_received", amount="50ubld")], 1, {"ubld": 50}),
    ([ev("coin_received", amount="50ubld", msg_index=7)], 1, {"ubld": 50}),
    ([ev("coin_received", amount="4700000000uist"), ev("transfer", amount="4700000000uist")], 1, {"uist": 4700000000}),
    ([ev("coin_received", amount="70ubld"), ev("transfer", amount="100ubld")], 1, {"ubld": 100}),
])
def test_inbound_amounts(blocks, evs, messages, want):
    b = blocks(one_tx(evs, [(extract.IBC_IN, "{}")] * messages))
    got = extract.with_ibc_in(extract.tx_rows(b)).select(F.inline("ibc_in")).collect()
    assert {r.denom: int(r.amount) for r in got} == want


def test_flows_in_and_hits(blocks):
    packets = [ev("recv_packet", packet_dst_port="transfer", packet_dst_channel="c1", packet_sequence=s) for s in (1, 1, 2)]
    b = blocks(one_tx([*packets, ev("coin_received", amount="5uist")], [(extract.IBC_IN, "{}")] * 3))
    got = {r.series: int(r.delta) for r in extract.all_deltas(b).collect()}
    assert (got["ibc_transfer_in_count"], got["ibc_transfer_flow_in"]) == (3, 2)
    hits = extract.recv_hits(extract.tx_rows(b), ["uist"]).collect()
    assert [(h.denom, int(h.amount), len(h.tx_hash)) for h in hits] == [("uist", 5, 64)]


def test_fees_of_failed_transactions(blocks):
    rows = lambda evs: extract.tx_rows(blocks(one_tx(evs, code=1))).select("payer", "fees").first()
    r = rows([ev("tx", fee="2000ubld", fee_payer="p")])
    assert (r.payer, [(f.denom, int(f.amount)) for f in r.fees]) == ("p", [("ubld", 2000)])
    r = rows([ev("tx", acc_seq="x/1")])
    assert (r.payer, r.fees) == (None, [])
    assert rows([ev("tx", fee_payer="p")]).payer is None


def test_block_sends(spark, blocks):
    send = lambda data, **a: ev("send_packet", packet_src_port=a.pop("port", "transfer"), packet_data=json.dumps(data), **a)
    d = {"denom": "transfer/channel-62/uusdc", "amount": "5000000"}
    b = blocks({"height": 5, "time": "2026-01-01T00:00:00Z", "finalize_block_events": [send(d, mode="EndBlock"), send(dict(d, amount="7"), mode="DeliverTx"), send(dict(d, amount="9"), port="icahost"), send(dict(d, amount="0")), ev("other"), send(dict(d, amount="1.5"))]})
    got = {(r.series, r.dimension): int(r.delta) for r in extract.all_deltas(b).collect()}
    usdc = "ibc/FE98AAD68F02F03565E9FA39A5E627946699B2B07115889ED812D8BA639576A9"
    assert got == {("ibc_transfer_amount_out_orch", usdc): 5000000, ("ibc_transfer_out_count_orch", ""): 1}
    row = spark.createDataFrame([("zz", json.dumps(d).encode().hex())], "bad string, good string")
    e = lambda c: F.struct(F.lit("send_packet").alias("type"), F.array(F.struct(F.lit("packet_data_hex").alias("key"), F.col(c).alias("value"))).alias("attributes"))
    r = row.select(events.packet_json(e("bad")).alias("bad"), events.packet_json(e("good")).alias("good")).first()
    assert r.bad is None and json.loads(r.good) == d


def test_bundle_installs(blocks):
    install = ev("message", action=extract.INSTALL)
    spend = ev("coin_spent", spender="p", amount="121169053ubld")
    fee, other = ev("tx", fee="1169053ubld", fee_payer="p"), ev("coin_spent", spender="q", amount="999ubld")
    get = lambda *evs: extract.bundle_installs(extract.tx_rows(blocks(one_tx(list(evs))))).first()
    r = get(spend, install, other, fee)
    assert (r.installer, int(r.gas_fee), int(r.storage_fee)) == ("p", 1169053, 120000000)
    assert get(install, fee, ev("coin_spent", spender="p", amount="1169053ubld")).storage_fee is None
    assert get(spend, install, fee, ev("message", action="/x")).storage_fee is None
    assert get(fee, spend) is None


def test_counts_and_legs(blocks):
    multi = json.dumps({"inputs": [{"address": "i", "coins": [{"denom": "d", "amount": "9"}]}], "outputs": [{"address": "o", "coins": [{"denom": "d", "amount": "4"}]}, {"address": "p", "coins": [{"denom": "d", "amount": "5"}]}]})
    out = json.dumps({"sender": "z", "token": {"denom": "d", "amount": "3"}})
    b = blocks(one_tx([], [(extract.MULTI_SEND, multi), (extract.IBC_OUT, out), ("/cosmos.gov.v1.MsgVote", "{}"), ("/cosmos.gov.v1beta1.MsgVote", "{}"), ("/cosmos.staking.v1beta1.MsgDelegate", "{}")]))
    got = kpis.rollup_hours(extract.all_deltas(b)).collect()
    assert {(r.series, r.dimension): int(r.value) for r in got if r.series not in ("gas_used", "gas_wanted", "tx_success")} == {("transfer_volume", "d"): 12, ("ibc_transfer_amount_out", "d"): 3, ("ibc_transfer_out_count", ""): 1, ("gov_votes", ""): 2, ("staking_delegations", ""): 1}
    assert {(r.address, int(r.volume)) for r in extract.address_volumes(extract.tx_rows(b)).collect()} == {("i", 9), ("z", 3)}


def test_wallet_actions(blocks):
    offer = {"method": "executeOffer", "offer": {"id": 1, "invitationSpec": {"source": "continuing", "invitationMakerName": "SettleTransaction", "previousOffer": "x"}, "proposal": {"give": {"In": {"brand": "ubld", "value": "+100"}}, "want": {"Out": {"brand": "uist", "value": "1.5"}}}}}
    invoke = {"method": "invokeEntry", "message": {"targetName": "planner", "method": "m"}}
    b = blocks(one_tx([], [(extract.WALLET[0], json.dumps(x)) for x in (offer, invoke, {"method": "odd"})] + [(extract.WALLET[1], "not json")]))
    got = {(r.series, r.dimension): int(r.value) for r in kpis.rollup_hours(extract.all_deltas(b)).collect()}
    assert got[("wallet_actions", "zoe_offer")] == got[("wallet_actions", "wallet_invocation")] == 1 and got[("wallet_actions", "unknown")] == 2
    assert got[("offer_category", "fast_usdc")] == 1 and got[("offer_category", "orchestration")] == 1 and got[("offer_category", "other")] == 2
    assert got[("offer_source", "continuing")] == 1 and got[("offer_maker", "SettleTransaction")] == 1 and got[("invoke_target", "planner")] == 1
    assert got[("offer_give_volume", "ubld")] == 100 and not any(s == "offer_want_volume" for s, _ in got)


def test_state_cells(spark, blocks):
    cell = lambda path, *bodies: ev("state_change", key="\0".join(path), value=json.dumps({"blockHeight": "1", "values": [json.dumps({"body": "#" + json.dumps(b), "slots": []}) for b in bodies]}))
    pool = ["3", "published", "provisionPool", "metrics"]
    m = lambda w, t: {"walletsProvisioned": f"+{w}", "totalMintedProvided": {"brand": "$0.Alleged: BLD brand", "value": f"+{t}"}}
    blk = lambda h, *evs: {"height": h, "time": "2026-09-01T00:00:00Z", "end_block_events": list(evs)}
    b = blocks(blk(7, cell(pool, m(1, 1), m(1453, 3710000000))), blk(6, cell(pool, m(1452, 1))), blk(5, cell(["3", "published", "wallet", "agoric1abc"], {"updated": "offerStatus", "status": {"id": "a", "payouts": {"P": {"brand": "ubld", "value": "+5"}}, "numWantsSatisfied": 0}}), ev("state_change", key="3\0other\0x", value="{}"), ev("state_change", key="3\0published\0wallet\0y", value="bad")))
    r = extract.pool_snapshots(b).first()
    assert (r.wallets, int(r.minted), r.height) == (1453, 3710000000, 7)
    got = {(x.series, x.dimension): int(x.delta) for x in extract.offer_outcome_deltas(b).collect()}
    assert got == {("offer_outcome", "wants_unsatisfied"): 1, ("offer_outcome_category", "unclassified|wants_unsatisfied"): 1, ("offer_payout_volume", "ubld"): 5}
    s = lambda d: json.dumps({"updated": "offerStatus", "status": d})
    rows = spark.createDataFrame([(s(d),) for d in ({"result": "x"}, {"numWantsSatisfied": 1}, {"payouts": {}, "numWantsSatisfied": 1}, {"payouts": {}, "numWantsSatisfied": 0}, {"payouts": {}, "error": "e"}, {"payouts": {}})], "j string")
    assert [r[0] for r in rows.select(capdata.offer_outcome(F.col("j"))).collect()] == [None, None, "wants_satisfied", "wants_unsatisfied", "errored", "wants_satisfied"]


def test_position_portfolio_and_flow_fields(spark):
    pos = json.dumps({"protocol": "Aave", "accountId": "eip155:43114:0xabc", "totalIn": {"value": "+10"}, "totalOut": {"value": "3"}})
    bare = json.dumps({"accountId": "eip155:1:0x1", "totalOut": {"value": "3"}})
    port = json.dumps({"depositAddress": "agoric1", "flowCount": "+3", "accountIdByChain": {"agoric": "cosmos:agoric-3:agoric1x"}, "accountStateByChain": {"agoric": {"address": "no", "chainId": "no"}, "Base": {"address": "0x9", "chainId": "eip155:8453"}}, "flowsRunning": {"flow1": {"type": "deposit"}}})
    df = spark.createDataFrame([(pos, bare, port, '{"how":"x","state":"done","step":2}', "a:b:c:d")], "pos string, bare string, port string, flow string, acc string")
    k = lambda s: F.lit(s)
    r = df.select(capdata.position_fields(F.col("pos"), k("Aave_Avalanche")).alias("p"), capdata.position_fields(F.col("bare"), k("USDN")).alias("b"), capdata.position_fields(k("{}"), k("x")).alias("none"), capdata.portfolio_fields(F.col("port")).alias("f"), capdata.flow_fields(F.col("flow")).alias("w"), capdata.split_account(F.col("acc")).alias("a")).first()
    assert (r.p.protocol, r.p.chain, int(r.p.total_in), int(r.p.total_out), int(r.p.net)) == ("Aave", "Avalanche", 10, 3, 0)
    assert (r.b.protocol, r.b.chain, r.none) == (None, "Ethereum", None)
    assert r.f.accounts == {"agoric": "cosmos:agoric-3:agoric1x", "Base": "eip155:8453:0x9"} and (r.f.deposit, r.f.flow_count) == ("agoric1", 3) and list(r.f.flows) == ["flow1"]
    assert (r.w.state, r.w.step, r.w.terminal) == ("done", 2, True) and (r.a.chain_id, r.a.address) == ("a:b", "c:d")


def test_categories_and_denoms(spark):
    rows = spark.createDataFrame([(m,) for m in ("constructor", "toString", "__proto__", "hasOwnProperty")], "m string")
    got = rows.select(offers.offer_category(F.lit("zoe_offer"), F.lit(None).cast("string"), F.col("m"), F.lit(None).cast("string")).alias("c")).collect()
    assert {r.c for r in got} == {"other"}
    labels = spark.createDataFrame([("a", "USDC (eth) (axl)"), ("b", "USDC (x)"), ("c", "BLD"), ("d", "Nope (y)")], "denom string, label string")
    ids = denoms.price_id_of(labels, spark.createDataFrame([("c", "agoric"), ("b", "")], "denom string, id string"), spark.createDataFrame([("USDC", "usd-coin")], "symbol string, id string"))
    assert {r.denom: r.price_id for r in ids.collect()} == {"a": "usd-coin", "b": "usd-coin", "c": "agoric", "d": None}
    text = json.dumps([["ubld", {"issuerName": "BLD", "displayInfo": {"decimalPlaces": 6}}], ["ubld", {"issuerName": "Other"}], ["x", {"displayInfo": {"decimalPlaces": 99}}], ["bad"], 5])
    got = {r.denom: (r.name, r.decimals) for r in denoms.registry_entries(spark.createDataFrame([(text,)], "text string")).collect()}
    assert got == {"ubld": ("BLD", 6), "x": (None, None)}
    coins = spark.createDataFrame([("10ubld, 5uist,bad_1,7a_b,1e:x",)], "t string").select(F.inline(events.parse_coins(F.col("t")))).collect()
    assert [(c.denom, int(c.amount)) for c in coins] == [("ubld", 10), ("uist", 5)]
