"""Batch, stream and backfill give the same rollups; a backfill that resumes keeps what is stored."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from chainrollup.operators import extract, kpis
from chainrollup.plans import jobs
from chainrollup.sources.blocks import BLOCK, archive_blocks, read_archived_day, read_blocks
from chainrollup.sources.tables import TableSet
from chainrollup.streaming import stream


def outcome_block(h):
    status = {"id": "a", "payouts": {"P": {"brand": "ubld", "value": f"+{h}"}}, "numWantsSatisfied": h % 2}
    value = {"blockHeight": str(h), "values": [json.dumps({"body": "#" + json.dumps({"updated": "offerStatus", "status": status}), "slots": []})]}
    event = {"type": "state_change", "attributes": [{"key": "key", "value": "\0".join(["3", "published", "wallet", "agoric1abc"])}, {"key": "value", "value": json.dumps(value)}]}
    return {"height": h, "time": f"2026-05-30T0{h // 4}:10:00Z", "end_block_events": [event]}


def land(path, heights):
    path.mkdir(exist_ok=True)
    for h in heights:
        (path / f"{h}.json").write_text(json.dumps(outcome_block(h)))
    return str(path)


def rows(df):
    return {(str(r.hour), r.series, r.dimension): int(r.value) for r in df.collect()}


def test_stream_has_the_offer_outcomes_of_the_batch(spark, tmp_path):
    src, got = land(tmp_path / "land", range(1, 4)), stream.open_tables(spark, str(tmp_path / "t"), ["hourly_metrics"])
    stream.stream_rollup(stream.read_block_stream(spark, src, files=3), got, str(tmp_path / "cp"), lag=0).awaitTermination()
    want = rows(jobs.rollup_tables(read_blocks(spark, src), names=["hourly_metrics"])["hourly_metrics"])
    assert {s for _, s, _ in want} == {"offer_outcome", "offer_outcome_category", "offer_payout_volume"}
    assert rows(got.read("hourly_metrics")) == want


def test_backfill_commits_its_rows_and_height_together(spark, tmp_path, monkeypatch):
    series = "offer_outcome_category"
    got = stream.open_tables(spark, str(tmp_path / "t"), ["hourly_metrics", "daily_metrics", "control"])
    make = lambda r: spark.createDataFrame([(h, s, d, str(v)) for h, s, d, v in r], "hour string, series string, dimension string, value string").selectExpr("to_timestamp(hour) AS hour", "series", "dimension", "CAST(value AS decimal(38,0)) AS value")
    stored = make([("2026-05-30 00:10:00", series, "x|y", 5), ("2026-05-30 01:00:00", "tx_success", "", 3)])
    got.commit({"hourly_metrics": stored, "daily_metrics": kpis.rollup_days(stored)})
    series_of = lambda blocks: {k: v for k, v in rows(kpis.rollup_hours(extract.rollup_deltas(blocks))).items() if k[1] == series}
    others = {k: v for k, v in rows(stored).items() if k[1] != series}
    all_ = read_blocks(spark, land(tmp_path / "all", range(1, 7)))

    assert jobs.backfill_series(all_.where("height <= 4"), got, "j", series) is not None  # the first run replaces what there was
    assert rows(got.read("hourly_metrics")) == others | series_of(all_.where("height <= 4"))
    write, before = TableSet._write, rows(got.read("hourly_metrics"))

    def breaking(self, name, *a):
        if name == "control":
            raise RuntimeError("lost")
        return write(self, name, *a)

    monkeypatch.setattr(TableSet, "_write", breaking)
    with pytest.raises(RuntimeError):
        jobs.backfill_series(all_, got, "j", series)
    monkeypatch.undo()
    assert rows(got.read("hourly_metrics")) == before
    for _ in range(2):  # it resumes above 4; once more finds nothing
        jobs.backfill_series(all_, got, "j", series)
        assert rows(got.read("hourly_metrics")) == others | series_of(all_)
        assert [tuple(r) for r in got.read("control").collect()] == [("j", 6)]
    days = {(str(r.day), r.series, r.dimension): int(r.value) for r in kpis.rollup_days(got.read("hourly_metrics")).collect()}
    assert days == {(str(r.day), r.series, r.dimension): int(r.value) for r in got.read("daily_metrics").collect()}


def test_replay_of_a_day_reads_its_files_and_tells_what_differs(spark, tmp_path):
    from test_stream import block

    at = tmp_path / "in.json"
    at.write_text("\n".join(json.dumps(block(h)) for h in range(1, 73)))  # three days
    blocks, path, day = read_blocks(spark, str(at)), str(tmp_path / "archive"), date(2026, 5, 29)
    archive_blocks(blocks, path, span=10)
    mine = read_archived_day(spark, path, day, span=10)
    assert sorted(r.height for r in mine.select("height").collect()) == list(range(24, 48))
    read = {r.f.split("part=")[1].split("/")[0] for r in mine.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {"2", "3", "4"} and "PartitionFilters: [isnotnull(part" in mine._jdf.queryExecution().toString()
    stored = jobs.rollup_tables(blocks, names=jobs.REPLAYED)
    assert jobs.replay_parity(stored, jobs.replay_day(mine, day), day).collect() == []
    changed = [block(h) for h in range(24, 48)]
    changed[5]["txs"][0]["signers"] = ["stranger"]  # height 29
    changed[7]["txs_results"][0]["gas_used"] = "1031"  # 31 before
    archive_blocks(spark.read.schema(BLOCK).json(str(write(tmp_path / "changed.json", changed))), path, span=10)
    got = {(r.check, r.key, int(r.stored), int(r.replayed)) for r in jobs.replay_parity(stored, jobs.replay_day(read_archived_day(spark, path, day, span=10), day), day).collect()}
    paid = [("address_fee_day", "stranger/ubld", 0, 5), ("address_fee_day", "a1/ubld", 30, 25)]  # the first signer pays
    more = [(f"participant_day{t}", k, a, a + 1) for role in ("signer", "fee_payer") for t, k, a in ((" rows", role, 4), ("", f"stranger/{role}", 0))]
    assert got == {("daily_metrics", "gas_used/", sum(range(24, 48)), sum(range(24, 48)) + 1000), *paid, *more}
    assert read_archived_day(spark, path, date(2027, 1, 1), span=10).count() == 0


def write(path, blocks):
    path.write_text("\n".join(map(json.dumps, blocks)))
    return path
