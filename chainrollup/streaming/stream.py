"""Tailing new blocks. Each batch of blocks changes every table that blocks feed, and the set of heights that are done, in one
commit: a batch that breaks off leaves nothing, and one that is run again finds its heights done."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import DECIMALS, Decimals
from ..operators import extract, kpis, participation
from ..plans import jobs
from ..sources import store
from ..sources.blocks import BLOCK
from ..sources.tables import Table, TableSet
from . import heights

FLOW_KEY = ["contract", "portfolio", "flow_id"]
SEQ = "struct<ev_i: int, val_i: int>"
_AT = lambda kind: f"struct<height: bigint, seq: {SEQ}, value: {kind}>"


def _set(base: DataFrame, delta: DataFrame) -> DataFrame:
    return base.unionByName(delta).distinct()


def _hash(*key: str, parts: int = 16) -> str:
    return f"cast(pmod(xxhash64({', '.join(key)}), {parts}) as string)"


def block_tables(parts: int = 16, amounts: Decimals = DECIMALS) -> dict[str, Table]:
    """The tables that blocks feed. Sums and participants are dealt by day, daily sums by month, latest rows and first sightings into `parts` parts by their key."""
    added = lambda *key: partial(store.merge_additive, key=list(key[:-1]), value=key[-1], amounts=amounts)
    latest = lambda *key: partial(store.merge_latest, key=list(key), order=["height", "seq"])
    day, month = "cast({} as string)", "date_format(day, 'yyyy-MM')"
    return {
        "hourly_metrics": Table(f"hour timestamp, series string, dimension string, value {amounts.type}", day.format("to_date(hour)"), added("hour", "series", "dimension", "value")),
        "daily_metrics": Table(f"day date, series string, dimension string, value {amounts.type}", month, added("day", "series", "dimension", "value")),
        "participant_day": Table("day date, address string, role string", day.format("day"), _set),
        "offer_participant_day": Table("day date, address string, kind string", day.format("day"), _set),
        "offer_category_participant_day": Table("day date, address string, category string", day.format("day"), _set),
        "address_fee_day": Table(f"day date, address string, denom string, fee {amounts.type}", day.format("day"), added("day", "address", "denom", "fee")),
        "address_volume_day": Table(f"day date, address string, denom string, volume {amounts.type}", day.format("day"), added("day", "address", "denom", "volume")),
        "first_seen": Table("address string, first_day date", _hash("address", parts=parts), partial(store.merge_least, key=["address"], value="first_day")),
        "action": Table(extract.ACTION, day.format("to_date(hour)"), DataFrame.unionByName),
        "outcome": Table(extract.OUTCOME, day.format("to_date(hour)"), DataFrame.unionByName),
        "bundle_install": Table("tx_hash string, height bigint, day date, installer string, gas_fee decimal(38,0), storage_fee decimal(38,0)", month, partial(store.merge_set, key=["tx_hash"])),
        "provision_pool_day": Table("day date, wallets bigint, minted decimal(38,0), converted decimal(38,0), height bigint", month, partial(store.merge_latest, key=["day"], order=["height"])),
        "ymax_portfolio": Table(f"contract string, portfolio string, deposit string, agoric_account string, accounts map<string, string>, policy_version bigint, flow_count bigint, height bigint, seq {SEQ}", _hash("contract", "portfolio", parts=parts), latest("contract", "portfolio")),
        "ymax_position": Table(f"contract string, portfolio string, position_key string, protocol string, chain string, account_id string, denom string, total_in decimal(38,0), total_out decimal(38,0), net decimal(38,0), height bigint, seq {SEQ}", _hash("contract", "portfolio", parts=parts), latest("contract", "portfolio", "position_key")),
        "ymax_flow": Table(f"contract string, portfolio string, flow_id string, flow_type {_AT('string')}, denom {_AT('string')}, amount {_AT('decimal(38,0)')}, day date, first_height bigint, last struct<height: bigint, progress: int, seq: {SEQ}, value: string>", _hash("contract", "portfolio", parts=parts), partial(store.merge_folded_flows, key=FLOW_KEY)),
        "control": Table("job string, last_height bigint", "'0'", partial(store.merge_by_key, key=["job"])),
        "heights": Table("low bigint, high bigint", "'0'", DataFrame.unionByName),
        "held": Table(BLOCK, "'0'", DataFrame.unionByName),
    }


def open_tables(spark: SparkSession, path: str, names: list[str] | None = None, parts: int = 16, amounts: Decimals = DECIMALS) -> TableSet:
    """The stored tables under a path. amounts: how the sums in them are held, the same whenever they are opened. names: those to keep, all by default; the set of heights and the blocks that wait always are."""
    return TableSet(spark, path, {k: t for k, t in block_tables(parts, amounts).items() if names is None or k in (*names, "heights", "held")}, amounts)


def read_block_stream(spark: SparkSession, path: str, fmt: str = "json", files: int | None = None) -> DataFrame:
    """`files` bounds a batch; large to catch up, small near the tip."""
    reader = spark.readStream.schema(BLOCK).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def dedup_blocks(blocks: DataFrame, late: str = "1 day") -> DataFrame:
    """A height is processed once, within the watermark. Where no height may be lost or count twice, `advance` keeps the set of heights instead."""
    return blocks.withWatermark("time", late).dropDuplicatesWithinWatermark(["height"])


def advance(tables: TableSet, batch: DataFrame, lag: int = 3, modules: list[str] = (), brands: dict[str, str] | None = None) -> int | None:
    """Adds a batch of blocks to the tables in one commit; returns its number, or None if there was nothing to do.

    Each height counts once, in whatever order and however often blocks come: what is done is a set of intervals, so a height that comes
    after higher ones is still counted. The last `lag` heights below the greatest one that was seen wait for a later batch."""
    done = tables.read("heights")
    fresh = heights.outside(batch.select(*tables.read("held").columns), done)
    rows = _once(tables, tables.stage("blocks", tables.read("held").unionByName(fresh)))
    top = rows.select("height").unionByName(done.select(F.col("high").alias("height"))).agg(F.max("height").alias("h")).first()["h"]
    if top is None:
        return None
    ready, got = rows.where(F.col("height") <= top - lag), {"held": rows.where(F.col("height") > top - lag)}
    if not ready.isEmpty():
        got |= _changes(tables, ready, modules, brands) | {"heights": heights.joined(done.unionByName(heights.intervals_of(ready)))}
    number = tables.commit(got, replace=["heights", "held"], clear={name: ["0"] for name in ("heights", "held") if name in got})
    tables.forget()
    return number


def _once(tables: TableSet, rows: DataFrame) -> DataFrame:
    """Stored blocks, one of each height. Heights alone are shuffled, and blocks only of those heights that come twice."""
    twice = tables.stage("twice", rows.groupBy("height").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("height"))
    n = twice.count()
    if not n:
        return rows
    twice = F.broadcast(twice) if n <= 1_000_000 else twice
    return tables.stage("unique", rows.join(twice, "height", "left_anti").unionByName(rows.join(twice, "height", "left_semi").dropDuplicates(["height"])))


def _changes(tables: TableSet, ready: DataFrame, modules: list[str], brands: dict[str, str] | None) -> dict[str, DataFrame]:
    """What final blocks add to each table of the set. Hours and participants, which two tables are made of, are worked out once."""
    wanted, got = set(tables.tables), {}
    if wanted & {"hourly_metrics", "daily_metrics"}:
        hours = tables.stage("hours", kpis.rollup_hours(extract.rollup_deltas(ready, modules, tables.amounts), tables.amounts))
        got |= {"hourly_metrics": hours, "daily_metrics": kpis.rollup_days(hours, tables.amounts)}
    if wanted & {"participant_day", "first_seen"}:
        people = tables.stage("people", extract.participants(extract.tx_rows(ready)))
        got |= {"participant_day": people, "first_seen": participation.first_seen_index(people)}
    if "ymax_flow" in wanted:
        got["ymax_flow"] = store.fold_flows(extract.flow_rows(extract.state_cells(ready), brands), FLOW_KEY)
    got |= jobs.rollup_tables(ready, modules, brands, wanted - got.keys(), tables.amounts)
    return {name: df for name, df in got.items() if name in wanted}


def done_through(tables: TableSet) -> int:
    """The greatest height that is done, -1 if none is."""
    high = tables.read("heights").agg(F.max("high").alias("h")).first()["h"]
    return -1 if high is None else high


def missing_heights(tables: TableSet) -> DataFrame:
    """low, high of the heights that are missing below the greatest one that is done."""
    return heights.gaps(tables.read("heights"))


def flow_states(tables: TableSet) -> DataFrame:
    """First sighting and last state of every flow."""
    return store.flows_of(tables.read("ymax_flow"), FLOW_KEY)


def stream_rollup(blocks: DataFrame, tables: TableSet, checkpoint: str, lag: int = 3, modules: list[str] = (), brands: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Advances the tables by each batch of new blocks. trigger: of writeStream.trigger; all that is there by default. A new checkpoint folder
    reads all blocks again and changes nothing that was done."""

    def step(batch: DataFrame, number: int) -> None:
        advance(tables, batch, lag, modules, brands)

    return blocks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def catch_up(behind: int, threshold: int = 20_000, far: int = 2000, near: int = 25) -> dict:
    """How to read and trigger, by the number of heights that the stream is behind: many files a batch until all are read, or few as they come."""
    if behind > threshold:
        return {"mode": "far", "files": far, "trigger": {"availableNow": True}}
    return {"mode": "near", "files": near, "trigger": {"processingTime": "20 seconds"}}


def follow(tables: TableSet, land: str, checkpoint: str, tip: Callable[[], int], stop: Callable[[], bool], threshold: int = 20_000, far: int = 2000, near: int = 25, poll: float = 5.0, every: str = "20 seconds", fmt: str = "json", **options) -> list[tuple[str, int, int]]:
    """Keeps the tables at the tip of the chain until stop() holds, and changes between the two modes of catch_up by itself.

    tip() is the greatest height that is published. Far behind, all landed files are read in large batches; at the end the lag is
    measured again. Near the tip, small batches come at intervals, and the lag is measured every `poll` seconds: beyond the threshold, the
    query ends and a far one takes its checkpoint. Returns (mode, lag at its start, lag at its end) of each query that was run."""
    behind = lambda: tip() - done_through(tables)
    ran = []
    while not stop():
        lag = behind()
        how = catch_up(lag, threshold, far, near)
        trigger = how["trigger"] if how["mode"] == "far" else {"processingTime": every}
        query = stream_rollup(read_block_stream(tables.spark, land, fmt, how["files"]), tables, checkpoint, trigger=trigger, **options)
        try:
            while not query.awaitTermination(poll):
                if how["mode"] == "near" and (stop() or behind() > threshold):
                    break
        finally:
            query.stop()
        ran.append((how["mode"], lag, behind()))
        if how["mode"] == "far" and ran[-1][2] > threshold:
            time.sleep(poll)  # what is published has not landed yet
    return ran


def finality_lag(batch: DataFrame, held: DataFrame, lag: int = 3) -> tuple[DataFrame, DataFrame]:
    """(ready, to hold back): of the batch and what was held before, all but the last `lag` heights."""
    rows = held.unionByName(batch).dropDuplicates(["height"])
    top = F.broadcast(rows.agg(F.max("height").alias("__top")))
    marked = rows.crossJoin(top)
    return marked.where(F.col("height") <= F.col("__top") - lag).drop("__top"), marked.where(F.col("height") > F.col("__top") - lag).drop("__top")


def tumbling_sums(blocks: DataFrame, width: str = "1 hour", late: str = "1 hour", modules: list[str] = (), amounts: Decimals = DECIMALS) -> DataFrame:
    """start, series, dimension, value of a stream of blocks by hour or day, in append mode: a window is put out once, when the
    watermark (the latest hour less `late`) has passed its end, and rows that come after are left out (see late_rows)."""
    rows = extract.rollup_deltas(blocks, list(modules), amounts).where(amounts.nonzero(F.col("delta"))).withWatermark("hour", late)
    sums = rows.groupBy(F.window("hour", width), "series", "dimension").agg(amounts.sum(F.col("delta")).alias("value"))
    return sums.select(F.col("window.start").alias("start"), "series", "dimension", F.col("value").cast(amounts.type).alias("value"))


def write_tumbling(sums: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends closed windows to Parquet files, each once."""
    return sums.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Sums within a batch that came too late for their window, over the progress that the query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
