"""End-to-end jobs: compositions of the operators for a range and a grain."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DECIMALS, Decimals
from ..functions.time import context_window, prior_window
from ..operators import buckets, extract, kpis, offers, participation, pricing, state, windows
from ..sources import store
from ..sources.tables import TableSet


def rollup_tables(blocks: DataFrame, modules: list[str] = (), brands: dict[str, str] | None = None, names: Iterable[str] | None = None, amounts: Decimals = DECIMALS) -> dict[str, DataFrame]:
    """Every table that blocks feed, or those named. amounts: how sums are held (those of installs, pool, positions and flows are DECIMAL). brands: board id -> denomination (a curated list); without it brands are kept as published."""
    txs, cells, hours = cache(lambda: extract.tx_rows(blocks, amounts)), cache(lambda: extract.state_cells(blocks)), cache(lambda: kpis.rollup_hours(extract.rollup_deltas(blocks, modules, amounts), amounts))
    acted, people = cache(lambda: extract.offer_actions(txs())), cache(lambda: extract.participants(txs()))
    latest = lambda rows, *key: windows.latest_row(rows, ["contract", "portfolio", *key], ["height", "seq"])
    made: dict[str, Callable[[], DataFrame]] = {  # the expressions are large: only those that are wanted are put together
        "hourly_metrics": hours, "daily_metrics": lambda: kpis.rollup_days(hours(), amounts), "participant_day": people, "first_seen": lambda: participation.first_seen_index(people()),
        "address_fee_day": lambda: extract.address_fees(txs(), amounts), "address_volume_day": lambda: extract.address_volumes(txs(), amounts), "bundle_install": lambda: extract.bundle_installs(txs()), "provision_pool_day": lambda: extract.pool_snapshots(blocks),
        "action": lambda: extract.action_facts(txs()), "outcome": lambda: extract.outcome_facts(blocks),
        "offer_participant_day": lambda: acted().select("day", "address", "kind").distinct(), "offer_category_participant_day": lambda: acted().select("day", "address", "category").distinct(),
        "ymax_portfolio": lambda: latest(extract.portfolio_rows(cells())), "ymax_position": lambda: latest(extract.position_rows(cells(), brands), "position_key"),
        "ymax_flow": lambda: store.merge_flow(extract.flow_rows(cells(), brands), ["contract", "portfolio", "flow_id"]),
    }
    return {name: make() for name, make in made.items() if names is None or name in names}


def metrics(daily: DataFrame, figures: dict[str, Column], floors: DataFrame, start: date, end: date) -> dict[str, DataFrame]:
    """Key figures, dense series and totals of a range. The rows of the range, the window before it and the look-back are read once."""
    before, context = prior_window(start, end), context_window(start, end)
    rows = buckets.range_filter(daily, context[0], end)
    spark = daily.sparkSession
    days = buckets.dense_days(spark, start, end)
    now = buckets.range_filter(rows, start, end)
    scored = windows.trailing_zscore(rows.groupBy("day", "series").agg(F.sum("value").alias("value")), start, end)
    return {"kpis": kpis.kpis(rows, figures, (start, end), before), "series": buckets.densify(now, days, floors), "totals": now.groupBy("series", "dimension").agg(F.sum("value").alias("total")), "anomalies": scored.where("flagged")}


def participation_report(people: DataFrame, priced: DataFrame, start: date, end: date) -> dict[str, DataFrame]:
    before = prior_window(start, end)
    now = buckets.range_filter(people, start, end)
    usd = pricing.address_usd(buckets.range_filter(priced, start, end))
    days = buckets.dense_days(people.sparkSession, start, end)
    return {"accounts": participation.participation_range(now), "daily": participation.dense_distinct(now, days), "retention": participation.retention_counts(people, (start, end), before), "concentration": pricing.hhi(usd, "usd").crossJoin(pricing.top_n_share(usd, "usd", 10)), "trend": pricing.concentration_over_time(buckets.range_filter(priced, start, end), days)}


def value_flow(priced: DataFrame, venues: DataFrame, positions: DataFrame, flows: DataFrame, start: date, end: date, stale_blocks: int = state.STALE_BLOCKS) -> DataFrame:
    """One row for the range: net flow in dollars; the stock: its venues, principal in dollars and the share of the two largest venues; flows and
    net deposits; positions quarantined or stale. priced: legs with prices; venues: principal_by_venue with usd; flows with prices."""
    net = pricing.net_flow_headline(pricing.net_flow_by_asset(buckets.range_filter(priced, start, end))).select(F.col("net_usd").alias("net_flow_usd"), F.col("priced").alias("priced_assets"))
    stock = venues.agg(F.count(F.lit(1)).alias("venues"), F.sum("usd").alias("principal_usd"))
    mine = buckets.range_filter(flows, start, end)
    moved = state.flows_in_range(mine, start, end).agg(F.coalesce(F.sum("flows"), F.lit(0)).alias("flows"))
    held = state.quarantined_positions(positions).agg(F.coalesce(F.sum("positions"), F.lit(0)).alias("quarantined"))
    old = state.stale_rows(positions, stale_blocks).agg(F.count(F.lit(1)).alias("stale"))
    one = [stock, state.top_two_venue_share(venues), moved, state.net_deposits_usd(mine).withColumnRenamed("net_usd", "net_deposits_usd"), held, old]
    for part in one:  # one row each
        net = net.crossJoin(part)
    return net


def base(people: DataFrame, fees: DataFrame, snapshots: DataFrame, landings: DataFrame, start: date, end: date, provision_fee: int) -> DataFrame:
    """One row for the range: the effective number of fee payers, retention, provisioning and installs. fees: day, address, usd."""
    paid = buckets.range_filter(fees, start, end).groupBy("address").agg(F.sum("usd").alias("usd"))
    one = pricing.hhi(paid, "usd").select("effective_n")
    kept = participation.retention_counts(people, (start, end), prior_window(start, end)).select("active", "retained", "new")
    pool = windows.snapshot_diff(state.with_prior_snapshot(snapshots, start, end), provision_fee)
    pool = state.provisioning_summary(buckets.range_filter(pool, start, end)).select("n_new", "n_minted", "wallets")
    mine = state.landings_summary(buckets.range_filter(landings, start, end), 0).select("installs", F.col("storage_fee").alias("install_storage_fee"), "installers")
    return one.crossJoin(kept).crossJoin(pool).crossJoin(mine)


def backfilled(base: DataFrame, blocks: DataFrame, control: DataFrame, job: str, series: str, modules: list[str] = (), amounts: Decimals = DECIMALS) -> DataFrame:
    """The rows that one series has after a backfill of the blocks above the job's committed height: without a committed height the fresh
    rows replace those of `base` (hour, series, dimension, value), else they are added to them."""
    fresh = kpis.rollup_hours(extract.rollup_deltas(store.resume_guard(blocks, control, job), modules, amounts).where(F.col("series") == series), amounts)
    if not control.where((F.col("job") == job) & F.col("last_height").isNotNull()).head(1):
        return fresh
    mine = base.where(F.col("series") == series).select(*fresh.columns)
    return store.merge_additive(mine, fresh, ["hour", *store.ROLLUP_KEY], amounts=amounts)


def backfill_series(blocks: DataFrame, tables: TableSet, job: str, series: str, modules: list[str] = ()) -> int | None:
    """Adds the blocks above the job's committed height to one series, by hour and day, in one commit with the new height; the first run replaces what the
    series had. A run that breaks off leaves nothing, and one that is repeated finds its height. Returns the commit, None without new blocks."""
    control = tables.read("control")
    new = store.resume_guard(blocks, control, job)
    last = new.agg(F.max("height").alias("h")).first()["h"]
    if last is None:
        return None
    hours = tables.stage("hours", kpis.rollup_hours(extract.rollup_deltas(new, modules, tables.amounts).where(F.col("series") == series), tables.amounts))
    changes = {"hourly_metrics": hours, "daily_metrics": kpis.rollup_days(hours, tables.amounts)}
    done = {"control": blocks.sparkSession.createDataFrame([(job, last)], "job string, last_height bigint")}
    if control.where((F.col("job") == job) & F.col("last_height").isNotNull()).head(1):
        number = tables.commit(changes | done)
    else:
        number = _replace_series(tables, [series], changes, done)
    tables.forget()
    return number


def _replace_series(tables: TableSet, series: list[str], changes: dict[str, DataFrame], others: dict[str, DataFrame], replace: list[str] = ()) -> int:
    """One commit with the rows of some series in place of those that they had, the other series as they were."""
    whole = [*changes, *replace]
    full = {name: tables.read(name).where(~F.col("series").isin(series)).unionByName(rows) for name, rows in changes.items()}
    clear = {name: [b for n, b in tables.folders() if n == name] for name in whole}
    return tables.commit(full | others, replace=whole, clear=clear)


CLASSED = ["offer_category", "offer_outcome_category"]


def reclassified(actions: DataFrame, outcomes: DataFrame, rules: offers.Rules = offers.RULES, amounts: Decimals = DECIMALS) -> dict[str, DataFrame]:
    """What rules make of stored facts (extract.ACTION, extract.OUTCOME): the hourly rows of the two series by category, and the participants of each
    category. A change of rules is two sums over facts; no block is read again."""
    acted, settled = offers.classified(actions, rules), extract.outcome_category(outcomes, rules)
    rows = lambda df, series, dim: df.select("hour", F.lit(series).alias("series"), offers.clamp_dim(dim).alias("dimension"), amounts.of(F.lit(1)).alias("delta"))
    both = rows(acted, CLASSED[0], F.col("category")).unionByName(rows(settled, CLASSED[1], offers.outcome_dim(F.col("category"), F.col("outcome"))))
    return {"hourly_metrics": kpis.rollup_hours(both, amounts), "offer_category_participant_day": extract.action_participants(acted).select("day", "address", "category").distinct()}


def reclassify(tables: TableSet, rules: offers.Rules = offers.RULES) -> int:
    """Applies rules to all stored actions and outcomes: both series by hour and day and the participants change in one commit, whose number is returned."""
    got = reclassified(tables.read("action"), tables.read("outcome"), rules, tables.amounts)
    hours = tables.stage("hours", got.pop("hourly_metrics"))
    number = _replace_series(tables, CLASSED, {"hourly_metrics": hours, "daily_metrics": kpis.rollup_days(hours, tables.amounts)}, got, list(got))
    tables.forget()
    return number


def replay_day(blocks: DataFrame, day: date, modules: list[str] = (), brands: dict[str, str] | None = None, amounts: Decimals = DECIMALS) -> dict[str, DataFrame]:
    """What the blocks of a day give in the tables that are kept by day."""
    mine = blocks.where(F.to_date("time") == F.lit(day))
    return rollup_tables(mine, modules, brands, REPLAYED, amounts)


REPLAYED = ["daily_metrics", "participant_day", "offer_participant_day", "offer_category_participant_day", "address_fee_day", "address_volume_day"]


def replay_parity(stored: dict[str, DataFrame], replayed: dict[str, DataFrame], day: date, amounts: Decimals = DECIMALS) -> DataFrame:
    """(check, key, stored, replayed) where the tables of a day and its replay differ: sums by series and dimension; for tables of participants
    the number of rows by role, kind or category and the addresses that one side lacks; for tables of amounts the sums by address and
    denomination. No row is the result wanted."""
    out = None  # of the tables that `stored` has
    sums = {"daily_metrics": (["series", "dimension"], "value"), "address_fee_day": (["address", "denom"], "fee"), "address_volume_day": (["address", "denom"], "volume")}
    people = {"participant_day": "role", "offer_participant_day": "kind", "offer_category_participant_day": "category"}
    for name in [n for n in REPLAYED if n in stored]:
        a, b = stored[name].where(F.col("day") == F.lit(day)), replayed[name].where(F.col("day") == F.lit(day))
        if name in sums:
            key, value = sums[name]
            checks = [(name, key, amounts.or_zero(amounts.sum(F.col(value))))]
        else:
            rows_of = amounts.of(F.count(F.lit(1)))
            checks = [(f"{name} rows", [people[name]], rows_of), (name, ["address", people[name]], rows_of)]
        for check, key, figure in checks:
            both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
            each = both.groupBy("side", *key).agg(figure.cast(amounts.type).alias("n"))
            side = lambda k: amounts.or_zero(amounts.sum(F.when(F.col("side") == k, F.col("n")))).cast(amounts.type)
            rows = each.groupBy(*key).agg(side(0).alias("stored"), side(1).alias("replayed")).where("stored <> replayed")
            rows = rows.select(F.lit(check).alias("check"), F.concat_ws("/", *key).alias("key"), "stored", "replayed")
            out = rows if out is None else out.unionByName(rows)
    return out


def verify(hours: DataFrame, days: DataFrame, replayed: DataFrame, local: DataFrame, chain: DataFrame, actions: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """(check, key, expected, found): sums of stored hours against stored days, of recomputed days against stored days, denominations that differ
    from the chain's, and names that the resolution doesn't know. No row is the result wanted."""
    sums = lambda name, a: state.parity_check(a, days, amounts).select(F.lit(name).alias("check"), F.concat_ws("/", "series", "dimension").alias("key"), amounts.text(F.col("hourly")).alias("expected"), amounts.text(F.col("daily")).alias("found"))
    drift = state.registry_drift(local, chain).where("status <> 'agreed'").select(F.lit("registry").alias("check"), F.col("denom").alias("key"), F.lit("agreed").alias("expected"), F.col("status").alias("found"))
    names = offers.resolution_audit(actions).select(F.concat(F.lit("unresolved "), "problem").alias("check"), "key", F.lit("0").alias("expected"), F.col("times").cast("string").alias("found"))
    return sums("parity", hours).unionByName(sums("replay", replayed)).unionByName(drift).unionByName(names)
