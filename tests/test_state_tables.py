"""Blocks feed the portfolio, position, flow and offer participant tables."""

import json
from datetime import date

from chainrollup.plans import jobs
from chainrollup.sources.blocks import read_blocks

AT = ["3", "published", "ymax0", "portfolios", "portfolio1"]


def cell(path, *bodies, slots=()):
    value = {"blockHeight": "1", "values": [json.dumps({"body": "#" + json.dumps(b), "slots": list(slots)}) for b in bodies]}
    return {"type": "state_change", "attributes": [{"key": "key", "value": "\0".join(path)}, {"key": "value", "value": json.dumps(value)}]}


def amount(n):
    return {"brand": "$0.Alleged: USDC brand", "value": f"+{n}"}


def test_state_changes_and_wallet_messages_become_rows(spark, tmp_path):
    flow = {"flow1": {"type": "deposit", "amount": amount(50)}}
    portfolio = lambda n, **more: {"accountIdByChain": {"agoric": "cosmos:agoric-3:agoric1x"}, "flowCount": f"+{n}", "policyVersion": 2, **more}
    position = lambda n: {"accountId": "eip155:43114:0xabc", "totalIn": amount(n), "totalOut": amount(1)}
    act = lambda owner, body: {"type_url": "/agoric.swingset.MsgWalletSpendAction", "body": json.dumps({"owner": owner, **body})}
    offer = {"method": "executeOffer", "offer": {"id": "a", "invitationSpec": {"source": "agoricContract", "instancePath": ["ymax0"]}}}
    txs = [{"raw": "AA==", "signers": [], "messages": [act("agoric1a", offer), act("agoric1a", offer), act("", offer)]}, {"raw": "AQ==", "signers": [], "messages": [act("agoric1b", offer)]}]
    results = [{"code": c, "gas_used": "1", "gas_wanted": "1", "events": []} for c in (0, 1)]
    blocks = [
        {"height": 8, "time": "2026-05-31T01:00:00Z", "end_block_events": [cell([*AT, "positions", "Aave_Avalanche"], position(20), position(30), {"x": 1}, slots=["board1"]), cell([*AT, "flows", "flow1"], {"state": "done", "step": 2})]},
        {"height": 7, "time": "2026-05-30T01:00:00Z", "txs": txs, "txs_results": results, "end_block_events": [
            cell(AT, portfolio(1, flowsRunning=flow), portfolio(2, flowsRunning=flow), slots=["board1"]), cell([*AT, "positions", "Aave_Avalanche"], position(90), slots=["board1"]), cell([*AT, "flows", "flow2"], {"state": "run"})]},
    ]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, blocks)))
    got = jobs.rollup_tables(read_blocks(spark, str(tmp_path / "b.json")), brands={"board1": "uusdc"})
    p = got["ymax_portfolio"].collect()
    assert [(r.contract, r.portfolio, r.agoric_account, r.policy_version, r.flow_count, r.height) for r in p] == [("ymax0", "portfolio1", "agoric1x", 2, 2, 7)]
    q = got["ymax_position"].collect()
    assert [(r.position_key, r.protocol, r.chain, r.denom, int(r.total_in), int(r.total_out), r.height) for r in q] == [("Aave_Avalanche", "Aave", "Avalanche", "uusdc", 30, 1, 8)]
    f = {r.flow_id: (r.flow_type, r.denom, r.amount and int(r.amount), r.day, r.first_height, r.last_state, r.last_height) for r in got["ymax_flow"].collect()}
    assert f == {"flow1": ("deposit", "uusdc", 50, date(2026, 5, 30), 7, "done", 8), "flow2": ("unknown", None, None, date(2026, 5, 30), 7, "run", 7)}
    assert [tuple(r) for r in got["offer_participant_day"].collect()] == [(date(2026, 5, 30), "agoric1a", "zoe_offer")]
    assert [tuple(r) for r in got["offer_category_participant_day"].collect()] == [(date(2026, 5, 30), "agoric1a", "ymax")]
