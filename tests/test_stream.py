import json
import os
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainrollup.operators import extract, kpis, offers, participation
from chainrollup.plans import chain_queries, jobs, stream_queries
from chainrollup.sources import store, tables
from chainrollup.sources.blocks import read_blocks
from chainrollup.streaming import heights, stream


def block(h, hour=None):
    offer = {"owner": f"agoric{h % 3}", "method": "executeOffer", "offer": {"id": f"o{h}", "invitationSpec": {"source": "contract", "instancePath": ["ymax0"], "publicInvitationMaker": "M"}}}
    send = {"fromAddress": f"a{h % 4}", "amount": [{"denom": "ubld", "amount": str(h)}]}
    messages = [{"type_url": "/cosmos.bank.v1beta1.MsgSend", "body": json.dumps(send)}, {"type_url": "/agoric.swingset.MsgWalletSpendAction", "body": json.dumps(offer)}]
    events = [{"type": "tx", "attributes": [{"key": "fee", "value": "5ubld"}, {"key": "fee_payer", "value": f"a{h % 4}"}]}]
    return {
        "height": h, "time": f"2026-05-{28 + (h // 24) % 3}T{h % 24 if hour is None else hour:02d}:10:00Z", "max_gas": "10", "txs": [{"raw": "AA==", "signers": [f"a{h % 4}"], "messages": messages}],
        "txs_results": [{"code": int(h % 5 == 0), "gas_used": str(h), "gas_wanted": "1", "events": events}], "end_block_events": [portfolio(h), flow(h)],
    }


def cell(path, body):
    value = {"blockHeight": "1", "values": [json.dumps({"body": "#" + json.dumps(body), "slots": ["b"]})]}
    return {"type": "state_change", "attributes": [{"key": "key", "value": "\0".join(path)}, {"key": "value", "value": json.dumps(value)}]}


def at(h):
    return ["3", "published", "ymax0", "portfolios", f"portfolio{h % 7}"]


def portfolio(h):
    running = {f"flow{h % 2}": {"type": "deposit" if h % 3 else "withdraw", "amount": {"brand": "$0.x", "value": f"+{h}"}}} if h % 4 else {}
    return cell(at(h), {"accountIdByChain": {}, "flowCount": f"+{h}", "policyVersion": 1, "flowsRunning": running})


def flow(h):
    return cell([*at(h), "flows", f"flow{h % 2}"], {"state": ["run", "done", "fail"][h % 3]})


def put(folder, name, hs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(block(h)) for h in hs))


def frame(spark, path, hs):
    path.write_text("\n".join(json.dumps(block(h)) for h in hs))
    return read_blocks(spark, str(path))


def plain(df):
    """Rows with columns in order, so that two sources of the same table can be compared."""
    return sorted((tuple(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect()), key=str)


def same_as_batch(spark, got, blocks, names=None):
    """Every table of the set is what the batch job makes of the blocks."""
    names = names or got.tables.keys() - {"heights", "held", "control"}
    want = jobs.rollup_tables(blocks, names=names)
    for name in names:
        mine = stream.flow_states(got) if name == "ymax_flow" else got.read(name)
        assert plain(mine) == plain(want[name].select(*mine.columns)), name


def test_heights_as_intervals(spark):
    rng = random.Random(4)
    hs = [rng.choice([h, h, h + heights.SPAN - 40]) for h in rng.sample(range(120), 80)] + [0, 0]
    of = lambda df: sorted(tuple(r) for r in df.select("low", "high").collect())
    table = lambda hs: spark.createDataFrame([(h,) for h in hs], "height bigint")
    half = heights.joined(heights.intervals_of(table(hs[:40])))
    done = heights.joined(half.unionByName(heights.intervals_of(table(hs[40:]))))
    low = sorted(h for h in set(hs) if h - 1 not in hs)
    high = sorted(h for h in set(hs) if h + 1 not in hs)
    assert of(done) == list(zip(low, high))
    assert of(heights.gaps(done)) == [(b + 1, a - 1) for b, a in zip(high, low[1:])]
    every = range(max(hs) + 3)
    assert sorted(r.height for r in heights.outside(table(every), done).collect()) == sorted(set(every) - set(hs))
    none = spark.createDataFrame([], "low bigint, high bigint")
    assert of(heights.gaps(none)) == of(heights.joined(none)) == [] and heights.outside(table([1]), none).count() == 1


def test_heights_that_come_late_count_once_and_gaps_are_told(spark, tmp_path):
    got = stream.open_tables(spark, str(tmp_path / "t"), ["address_volume_day"])
    for k, hs in enumerate([[1, 2, 3, 4, 6, 7, 8, 9, 10], [5, 11, 12, 13, 7], [14, 15, 16, 17, 19]]):  # 5 comes late
        stream.advance(got, frame(spark, tmp_path / f"{k}.json", hs))
    of = lambda df: sorted(tuple(r) for r in df.collect())
    assert of(got.read("heights")) == [(1, 16)] and sorted(r.height for r in got.read("held").collect()) == [17, 19]
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 17)))
    stream.advance(got, frame(spark, tmp_path / "3.json", [25]))
    assert of(stream.missing_heights(got)) == [(18, 18)] and stream.done_through(got) == 19
    stream.advance(got, frame(spark, tmp_path / "4.json", [18, 18, 2]))
    assert of(stream.missing_heights(got)) == []
    same_as_batch(spark, got, frame(spark, tmp_path / "all2.json", range(1, 20)))


def test_shuffled_arrival_gives_every_table_of_the_batch(spark, tmp_path):
    land, got = tmp_path / "land", stream.open_tables(spark, str(tmp_path / "t"), parts=3)
    hs = list(range(1, 61))
    random.Random(8).shuffle(hs)
    for k in range(4):
        put(land, f"{k}.json", hs[15 * k : 15 * k + 15] + hs[:2])
    run = lambda cp: stream.stream_rollup(stream.read_block_stream(spark, str(land), files=2), got, str(tmp_path / cp), lag=0).awaitTermination()
    run("cp")
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 61)))
    before, version = {n: plain(got.read(n)) for n in got.tables}, got.commits.version()
    run("another")  # all blocks once more, without the first checkpoint
    assert got.commits.version() > version and {n: plain(got.read(n)) for n in got.tables} == before
    assert got.read("held").count() == 0 and not (tmp_path / "t" / "staged").exists()
    stored = sum(f.stat().st_size for f in (tmp_path / "t" / "held").rglob("*.parquet"))
    assert stored == 0  # blocks that are done are not kept


@pytest.mark.parametrize("at,after", [(1, False), (2, True), (5, False), (8, True)])
def test_a_batch_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch, at, after):
    names = ["participant_day", "ymax_flow", "first_seen"]
    got = stream.open_tables(spark, str(tmp_path / "t"), names, parts=2)
    stream.advance(got, frame(spark, tmp_path / "0.json", range(1, 20)), lag=1)
    before, version = {n: plain(got.read(n)) for n in got.tables}, got.commits.version()
    write, calls = tables.TableSet._write, []

    def breaking(self, *a):
        calls.append(a)
        if len(calls) == at and not after:
            raise RuntimeError("lost")
        out = write(self, *a)
        if len(calls) == at:
            raise RuntimeError("lost after the write")
        return out

    second = frame(spark, tmp_path / "1.json", range(15, 40))
    monkeypatch.setattr(tables.TableSet, "_write", breaking)
    try:
        with pytest.raises(RuntimeError):
            stream.advance(got, second, lag=1)
        assert got.commits.version() == version and {n: plain(got.read(n)) for n in got.tables} == before
    finally:
        monkeypatch.undo()
    stream.advance(got, second, lag=1)
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 39)))


def test_a_commit_without_its_mark_does_not_count(spark, tmp_path):
    got = stream.open_tables(spark, str(tmp_path / "t"), ["participant_day"])
    stream.advance(got, frame(spark, tmp_path / "0.json", range(1, 6)), lag=0)
    stream.advance(got, frame(spark, tmp_path / "1.json", range(6, 9)), lag=0)
    (tmp_path / "t" / "commits" / "v=1" / "_SUCCESS").unlink()
    assert stream.done_through(got) == 5
    stream.advance(got, frame(spark, tmp_path / "1.json", range(6, 9)), lag=0)
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 9)))


def test_a_change_writes_the_buckets_it_touches_only(spark, tmp_path):
    got = stream.open_tables(spark, str(tmp_path / "t"), ["participant_day", "address_fee_day", "ymax_portfolio", "ymax_flow", "first_seen"], parts=8)
    stream.advance(got, frame(spark, tmp_path / "0.json", range(1, 60)), lag=0)
    files = lambda folder: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t" / folder).rglob("*.parquet")}
    old = got.folders()
    kept = {key: files(f) for key, f in old.items()}
    stream.advance(got, frame(spark, tmp_path / "1.json", [60]), lag=0)  # one block: one day, one portfolio
    now = got.folders()
    changed = {key for key in now if now[key] != old.get(key)}
    for name, most in (("address_fee_day", 1), ("participant_day", 1), ("ymax_portfolio", 1), ("ymax_flow", 1), ("first_seen", 1)):
        mine = [key for key in changed if key[0] == name]
        assert len(mine) <= most < len([key for key in now if key[0] == name]), name
    assert all(files(old[key]) == kept[key] for key in old if key not in changed)
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 61)))
    plan = got.read("participant_day", ["2026-05-28"]).inputFiles()
    assert plan and all("2026-05-28" in f for f in plan)
    stream.advance(got, frame(spark, tmp_path / "2.json", [61]), lag=0)
    named = {f for v in got.commits.versions() for f in got.folders(v).values()}
    there = {str(f.parent.relative_to(tmp_path / "t")) for f in (tmp_path / "t").rglob("part-*") if "commits" not in str(f) and not f.name.startswith(".")}
    assert there == named and len(got.commits.versions()) == 2


def test_retention_by_a_first_seen_index(spark):
    people = spark.createDataFrame([(f"2026-05-{1 + (i * 7 + j) % 28:02d}", f"a{i}", "signer") for i in range(40) for j in range(i % 5)], "day string, address string, role string").withColumn("day", F.to_date("day"))
    index = participation.first_seen_index(people.where("day <= '2026-05-15'"))
    index = store.merge_least(index, participation.first_seen_index(people.where("day > '2026-05-15'")), ["address"], "first_day")
    for now, before in ((("2026-05-11", "2026-05-20"), ("2026-05-01", "2026-05-10")), (("2026-05-21", "2026-05-28"), ("2026-05-13", "2026-05-20")), (("2027-01-01", "2027-01-02"), ("2026-12-30", "2026-12-31"))):
        assert participation.retention_by_index(people, index, now, before).collect() == participation.retention_counts(people, now, before).collect()


def test_new_rules_apply_to_stored_actions(spark, tmp_path):
    got = stream.open_tables(spark, str(tmp_path / "t"), ["hourly_metrics", "daily_metrics", "offer_category_participant_day", "action", "outcome"])
    blocks = frame(spark, tmp_path / "0.json", range(1, 50))
    stream.advance(got, blocks, lag=0)
    before = {n: plain(got.read(n)) for n in got.tables}
    jobs.reclassify(got)  # the same rules
    assert {n: plain(got.read(n)) for n in got.tables} == before
    rules = offers.RULES._replace(named=[("^ymax", "vaults")])
    jobs.reclassify(got, rules)
    cats = {r.dimension: int(r.value) for r in got.read("daily_metrics").where("series = 'offer_category'").groupBy("dimension").agg(F.sum("value").alias("value")).collect()}
    assert cats == {"vaults": sum(h % 5 > 0 for h in range(1, 50))}
    assert {r.category for r in got.read("offer_category_participant_day").collect()} == {"vaults"}
    others = lambda rows: [r for r in rows if not any(v in jobs.CLASSED for _, v in r)]
    assert others(plain(got.read("hourly_metrics"))) == others(before["hourly_metrics"])
    assert state_ok(got)


def state_ok(got):
    days = kpis.rollup_days(got.read("hourly_metrics"))
    return plain(days) == plain(got.read("daily_metrics").select(*days.columns))


def test_follow_changes_mode_by_the_lag(spark, tmp_path):
    land, got = tmp_path / "land", stream.open_tables(spark, str(tmp_path / "t"), ["address_fee_day"])
    for k in range(4):
        put(land, f"{k}.json", range(10 * k + 1, 10 * k + 11))
    landed = [40]

    def stop():
        done = stream.done_through(got)
        if done == 40 and landed[0] == 40:  # a jump while the stream is at the tip
            for k in range(4, 8):
                put(tmp_path / "next", f"{k}.json", range(10 * k + 1, 10 * k + 11))
                shutil.move(str(tmp_path / "next" / f"{k}.json"), str(land / f"{k}.json"))
            landed[0] = 80
        return done >= 80

    ran = stream.follow(got, str(land), str(tmp_path / "cp"), lambda: landed[0], stop, threshold=20, far=2, near=1, poll=0.3, every="200 milliseconds", lag=0)
    assert ran[0] == ("far", 41, 0) and ran[-1][2] == 0
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 81)))


def test_tumbling_sums_put_out_each_window_once_and_count_late_rows(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name, hs in (("0", [1, 2]), ("1", [9]), ("2", [2]), ("3", [20])):  # in the third batch an hour that the watermark has passed
        (land / f"{name}.json").write_text("\n".join(json.dumps(block(h)) for h in hs))
        query = stream.write_tumbling(stream.tumbling_sums(stream.read_block_stream(spark, str(land), files=1), "1 hour", "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        late = stream.late_rows(query)
        assert (late > 0) == (name == "2")
    want = kpis.rollup_hours(extract.rollup_deltas(frame(spark, tmp_path / "all.json", [1, 2, 9]))).withColumnRenamed("hour", "start")
    assert plain(spark.read.parquet(str(tmp_path / "out")).select("start", "series", "dimension", "value")) == plain(want)


def test_finality_lag(spark):
    schema = "height bigint, key string, v int"
    b = spark.createDataFrame([(h, "k", h) for h in range(1, 8)], schema)
    ready, held = stream.finality_lag(b, spark.createDataFrame([], schema))
    assert {r.height for r in ready.collect()} == {1, 2, 3, 4} and {r.height for r in held.collect()} == {5, 6, 7}
    ready, _ = stream.finality_lag(spark.createDataFrame([(8, "k", 8), (9, "k", 9)], schema), held)
    assert {r.height for r in ready.collect()} == {5, 6}


def test_dedup_stream_and_partition_swap(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "a.json").write_text(json.dumps(block(1)))
    (land / "b.json").write_text(json.dumps(block(1)) + "\n" + json.dumps(block(2)))
    q = stream.dedup_blocks(stream.read_block_stream(spark, str(land), files=1)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.height for r in spark.table("seen").collect()) == [1, 2]
    path = str(tmp_path / "series")
    mk = lambda s, v: spark.createDataFrame([(s, "d", v)], "series string, dimension string, value int")
    mk("a", 1).unionByName(mk("b", 2)).write.partitionBy("series").parquet(path)
    store.overwrite_series(mk("a", 9), path)
    assert {(r.series, r.value) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_a_reader_never_sees_an_incomplete_version(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert table.read("v int").collect() == [] and table.version() == -1
    table.write(one(1))
    before = table.read("v int")
    one(9).write.parquet(str(tmp_path / "t" / "v=1"))
    (tmp_path / "t" / "v=1" / "_SUCCESS").unlink()  # a writer that stopped in between
    assert table.version() == 0 and [r.v for r in table.read("v int").collect()] == [1]
    assert table.write(one(2)) == 2
    assert [r.v for r in before.collect()] == [1] and [r.v for r in table.read("v int").collect()] == [2]
    with pytest.raises(Exception, match="(?i)exists"):
        one(3).write.mode("errorifexists").parquet(str(tmp_path / "t" / "v=2"))
    table.forget(1)
    assert table.versions() == [2] and [r.v for r in table.read("v int").collect()] == [2]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_landed_blocks_are_small_and_whole(spark):
    sf = "/root/testdata/sf0.001"
    blocks, orders = chain_queries.chain_blocks(spark, sf), spark.read.parquet(f"{sf}/orders.parquet").count()
    for times in (1, 2):
        land = Path(stream_queries._landed(spark, sf, times).removeprefix("file:"))
        files = [f for f in land.iterdir() if f.name.startswith("part-")]
        assert len(files) == 2 * times and sum(f.stat().st_size for f in files) < 200 * times * orders
        got = read_blocks(spark, str(land))
        assert plain(got) == plain(blocks.select(*got.columns).unionByName(blocks.select(*got.columns)) if times == 2 else blocks.select(*got.columns))


def test_heights_alone_are_shuffled_to_find_blocks_that_come_twice(spark, tmp_path, monkeypatch):
    stage, plans = tables.TableSet.stage, {}

    def seen(self, name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(self, name, df)

    monkeypatch.setattr(tables.TableSet, "stage", seen)
    got = stream.open_tables(spark, str(tmp_path / "t"), ["address_volume_day"])
    stream.advance(got, frame(spark, tmp_path / "0.json", range(1, 20)), lag=0)
    assert "Exchange hashpartitioning" not in plans["blocks"] and "unique" not in plans
    stream.advance(got, frame(spark, tmp_path / "1.json", [*range(15, 30), 22, 22, 25]), lag=0)
    assert "Exchange hashpartitioning" not in plans["blocks"] and "unique" in plans
    same_as_batch(spark, got, frame(spark, tmp_path / "all.json", range(1, 30)))
