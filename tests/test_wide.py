"""Amounts of more than 38 digits, from blocks to tables, checks and exports."""

import json
import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from chainrollup.functions.numbers import DECIMALS, LIMBS
from chainrollup.operators import extract, kpis, state
from chainrollup.plans import jobs
from chainrollup.sources.blocks import BLOCK
from chainrollup.sources.export import export_long
from chainrollup.sources.store import merge_additive
from chainrollup.streaming import stream

DAY = date(2026, 5, 30)
BIG = 10**45 + 7


def event(kind, **attributes):
    return {"type": kind, "attributes": [{"key": k, "value": v} for k, v in attributes.items()]}


def block(h, amount):
    """A send, a transfer in and a fee of `amount`, and a transfer that the block makes on its own."""
    send = {"type_url": extract.SEND, "body": json.dumps({"fromAddress": "a", "toAddress": "b", "amount": [{"denom": "wei", "amount": str(amount)}]})}
    come = {"type_url": extract.IBC_IN, "body": "{}"}
    events = [event("tx", fee=f"{amount}wei,5ubld", fee_payer="a"), event("coin_received", receiver="b", amount=f"{amount}wei"), event("transfer", recipient="b", amount=f"{amount - 1}wei")]
    out = event("send_packet", packet_src_port="transfer", packet_src_channel="channel-1", packet_data=json.dumps({"denom": "wei", "amount": str(amount), "sender": "a", "receiver": "b"}))
    tx = {"raw": "AA==", "messages": [send, come], "signers": ["a"]}
    return {"height": h, "time": f"2026-05-30T0{h % 3}:10:00Z", "txs": [tx], "txs_results": [{"code": 0, "gas_used": "7", "gas_wanted": "9", "events": events}], "end_block_events": [out]}


def frame(spark, path, amounts):
    path.write_text("\n".join(json.dumps(block(h, a)) for h, a in amounts.items()))
    return spark.read.schema(BLOCK).json(str(path))


WEI = ["transfer_volume", "fee_paid", "bank_credits_volume", "ibc_transfer_amount_in", "ibc_transfer_amount_out_orch"]
AMOUNTS = {1: BIG, 2: 10**78 - 1, 3: 10**78 - 5, 4: 12, 5: 3, 6: 10**38}


def text_of(df, value="value", key=("series", "dimension")):
    return {tuple(r[k] for k in key): int(r["v"]) for r in df.select(*key, LIMBS.text(F.col(value)).alias("v")).collect()}


def test_limbs_are_the_numbers(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(10 ** rng.randrange(1, 80)), rng.randrange(10 ** rng.randrange(1, 80))) for _ in range(300)] + [(0, 0), (10**80 - 1, 1), (10**20 - 1, 1), (10**60, 10**60)]
    rows = spark.createDataFrame([(k % 3, str(a), str(b).zfill(80)) for k, (a, b) in enumerate(pairs)], "g int, a string, b string").select("g", LIMBS.of(F.col("a")).alias("a"), LIMBS.of(F.col("b")).alias("b"))
    got = rows.select(*[LIMBS.text(c).alias(n) for n, c in {"a": F.col("a"), "b": F.col("b"), "s": LIMBS.add(F.col("a"), F.col("b")), "m": F.greatest("a", "b")}.items()], (F.col("a") < F.col("b")).alias("less"), LIMBS.nonzero(F.col("a")).alias("some")).collect()
    assert [tuple(r) for r in got] == [(str(a), str(b), str(a + b), str(max(a, b)), a < b, a > 0) for a, b in pairs]
    sums = {r.g: r.s for r in rows.groupBy("g").agg(LIMBS.sum(F.col("a")).alias("s")).select("g", LIMBS.text(F.col("s")).alias("s")).collect()}
    assert sums == {g: str(sum(a for k, (a, _) in enumerate(pairs) if k % 3 == g)) for g in range(3)}


def test_limbs_of_odd_input(spark):
    rows = spark.createDataFrame([(None,), ("0",), ("0" * 90 + "7",)], "t string")
    assert [r[0] for r in rows.select(LIMBS.text(LIMBS.of(F.col("t")))).collect()] == [None, "0", "7"]
    assert rows.where("t IS NULL").agg(LIMBS.sum(LIMBS.of(F.col("t"))).alias("s")).first().s is None
    long = spark.createDataFrame([("9" * 81,)], "t string")
    assert long.select(LIMBS.try_of(F.col("t")).alias("v")).first().v is None
    with pytest.raises(Exception, match="over 80 digits"):
        long.select(LIMBS.of(F.col("t")).alias("v")).collect()
    edge = spark.createDataFrame([("9" * 38,), ("1" + "0" * 38,)], "t string").select(LIMBS.narrow(LIMBS.of(F.col("t"))).alias("v"))
    assert [r.v if r.v is None else int(r.v) for r in edge.collect()] == [10**38 - 1, None]


def test_rollup_of_amounts_over_38_digits(spark, tmp_path):
    blocks = frame(spark, tmp_path / "b.json", AMOUNTS)
    got = jobs.rollup_tables(blocks, names=["hourly_metrics", "daily_metrics", "address_fee_day", "address_volume_day"], amounts=LIMBS)
    days, total = text_of(got["daily_metrics"]), sum(AMOUNTS.values())
    assert {days[s, "wei"] for s in WEI} == {total} and days["fee_paid", "ubld"] == 30 and days["gas_used", ""] == 42 and days["ibc_transfer_in_count", ""] == 6
    by_hour = Counter()
    for h, a in AMOUNTS.items():
        by_hour[h % 3] += a
    hours = got["hourly_metrics"].where("series = 'transfer_volume'").withColumn("h", F.hour("hour"))
    assert text_of(hours, key=("h",)) == {(h,): a for h, a in by_hour.items()}
    assert text_of(got["address_fee_day"], "fee", ("address", "denom")) == {("a", "wei"): total, ("a", "ubld"): 30}
    assert text_of(got["address_volume_day"], "volume", ("address", "denom")) == {("a", "wei"): total}
    with pytest.raises(Exception):  # noqa: B017 (decimals tell that they overflow)
        jobs.rollup_tables(blocks, names=["daily_metrics"])["daily_metrics"].collect()


def test_limbs_agree_with_decimals_where_both_fit(spark, tmp_path):
    blocks = frame(spark, tmp_path / "b.json", {1: 10**30, 2: 5, 3: 10**20})
    rows = lambda a: kpis.rollup_hours(extract.rollup_deltas(blocks, amounts=a), a)
    wide = rows(LIMBS).withColumn("value", LIMBS.narrow(F.col("value")))
    assert wide.schema == rows(DECIMALS).schema and sorted(wide.collect()) == sorted(rows(DECIMALS).collect())


def test_stream_parity_and_export_of_wide_amounts(spark, tmp_path):
    tables = stream.open_tables(spark, str(tmp_path / "t"), ["hourly_metrics", "daily_metrics", "participant_day", "address_fee_day", "address_volume_day"], amounts=LIMBS)
    for k, part in enumerate(([4, 1, 6], [5, 2], [3, 2])):
        stream.advance(tables, frame(spark, tmp_path / f"{k}.json", {h: AMOUNTS[h] for h in part}), lag=0)
    blocks = frame(spark, tmp_path / "all.json", AMOUNTS)
    want = text_of(jobs.rollup_tables(blocks, names=["daily_metrics"], amounts=LIMBS)["daily_metrics"])
    assert text_of(tables.read("daily_metrics")) == want
    assert state.parity_check(tables.read("hourly_metrics"), tables.read("daily_metrics"), LIMBS).count() == 0

    stored = {n: tables.read(n) for n in jobs.REPLAYED if n in tables.tables}
    assert jobs.replay_parity(stored, jobs.replay_day(blocks, DAY, amounts=LIMBS), DAY, LIMBS).count() == 0
    other = frame(spark, tmp_path / "other.json", AMOUNTS | {2: 10**78 - 2})
    found = jobs.replay_parity(stored, jobs.replay_day(other, DAY, amounts=LIMBS), DAY, LIMBS)
    found = {(r.check, r.key): int(r.s) - int(r.r) for r in found.select("check", "key", LIMBS.text(F.col("stored")).alias("s"), LIMBS.text(F.col("replayed")).alias("r")).collect()}
    assert found == {("daily_metrics", f"{s}/wei"): 1 for s in WEI} | {("address_fee_day", "a/wei"): 1, ("address_volume_day", "a/wei"): 1}

    text = {r.series: r.value for r in export_long(tables.read("daily_metrics"), "day", LIMBS).where("dimension = 'wei'").collect()}
    assert text == {s: str(sum(AMOUNTS.values())) for s in WEI}
    twice = merge_additive(tables.read("daily_metrics"), tables.read("daily_metrics"), ["day", "series", "dimension"], amounts=LIMBS)
    assert text_of(twice) == {k: 2 * v for k, v in want.items()}
