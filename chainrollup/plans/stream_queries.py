"""Queries that stream landed blocks into stored tables, and queries over what the stream keeps: facts, the first-seen index, archived days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, kpis, offers, participation
from ..sources import blocks as B
from ..sources.files import delete, new_folder
from ..sources.tables import TableSet
from ..streaming import stream
from . import jobs
from . import proxy as P
from .chain_queries import _CATEGORY, _LAST, FLOWS_SQL, OUTCOME, SERIES, _sum, chain_blocks
from .people_queries import _RET
from .registry import registry

QUERIES, ORACLES, query = registry()
TOP = "(SELECT max(height) FROM p_c)"


FILE, BATCH = 20_000, 250  # orders in a landing file, and files in a batch, at most (by a hash, so about)


def _parts(spark: SparkSession, d: str) -> int:
    return max(2, -(-P.table(spark, d, "orders").count() // FILE))


def _landed(spark: SparkSession, d: str, times: int = 1) -> str:
    """A folder of landing files, compressed: the blocks dealt out by a hash, so that heights come late, in `times` copies. Orders are dealt, not
    blocks, which are some thirty times as large."""
    path, blocks = new_folder(spark, "landing"), chain_blocks(spark, d, _parts(spark, d))
    for _ in range(times):
        blocks.write.mode("append").json(path, compression="gzip")
    return path


def _streamed(spark: SparkSession, d: str, names: list[str], lag: int, again: bool = False, **options) -> TableSet:
    """The tables after a stream over landed blocks, in two batches or more of bounded size; `again`: all of them once more, by another checkpoint."""
    land, path, files = _landed(spark, d), new_folder(spark, "tables"), min(BATCH, _parts(spark, d) // 2)
    tables = stream.open_tables(spark, path, names)
    for k in range(1 + again):
        stream.stream_rollup(stream.read_block_stream(spark, land, files=files), tables, f"{path}/checkpoint-{k}", lag=lag, **options).awaitTermination()
    delete(spark, land)
    return tables


_ROLLED = SERIES["wallet_action_deltas"][1][:2] + SERIES["offer_outcomes"][1][:2]


@query(" UNION ALL ".join(s.replace(" WHERE ", f" WHERE height <= {TOP} - 3 AND ") for s in _ROLLED))
def stream_rollup(spark, d):
    """Hourly sums of a stream whose heights come in no order, less the last three heights."""
    rows = kpis.rollup_days(_streamed(spark, d, ["hourly_metrics"], 3).read("hourly_metrics"))
    return rows.where(F.col("series").isin("wallet_actions", "offer_category", "offer_outcome", "offer_outcome_category")).withColumn("value", F.col("value").cast("long"))


@query("SELECT 'volume' AS of, day, 'agoric' || c AS address, 'den' || (c % 3) AS key, CAST(sum(m) AS BIGINT) AS n FROM p_c WHERE ok AND k % 4 = 2 GROUP BY ALL UNION ALL SELECT 'seen', min(day), 'agoric' || c, '', CAST(count(DISTINCT day) AS BIGINT) FROM p_c WHERE ok GROUP BY c")
def exactly_once_chunk(spark, d):
    """Sums, first sightings and active days of addresses after all blocks were streamed twice: one commit a batch, and heights that are done change nothing."""
    t = _streamed(spark, d, ["address_volume_day", "participant_day", "first_seen"], 0, True)
    sums = t.read("address_volume_day").select(F.lit("volume").alias("of"), "day", "address", F.col("denom").alias("key"), F.col("volume").cast("long").alias("n"))
    days = t.read("participant_day").groupBy("address").agg(F.countDistinct("day").alias("n"))
    return sums.unionByName(t.read("first_seen").join(days, "address").select(F.lit("seen").alias("of"), F.col("first_day").alias("day"), "address", F.lit("").alias("key"), "n"))


@query(f"SELECT DISTINCT height, CASE WHEN height > {TOP} - 3 THEN 'held' ELSE 'done' END AS status FROM p_c")
def finality_lag(spark, d):
    t = _streamed(spark, d, [], 3)
    done = t.read("heights").select(F.explode(F.sequence("low", "high")).alias("height"), F.lit("done").alias("status"))
    return done.unionByName(t.read("held").select("height", F.lit("held").alias("status")))


@query(f"SELECT 'portfolio' || (c % 100) AS portfolio, CASE WHEN c % 2 = 0 THEN 'Aave_Base' ELSE 'Comp' END AS position_key, CASE c % 3 WHEN 0 THEN 'uusdc' WHEN 1 THEN 'ubld' END AS denom, m AS total_in, k AS total_out, height FROM p_c WHERE k % 5 = 2 {_LAST.format('c % 100, c % 2')}")
def idempotent_latest(spark, d):
    """The last state of positions from blocks that come in no order and twice."""
    t = _streamed(spark, d, ["ymax_position"], 0, True, brands={"board0": "uusdc", "board1": "ubld"})
    return t.read("ymax_position").select("portfolio", "position_key", "denom", F.col("total_in").cast("long").alias("total_in"), F.col("total_out").cast("long").alias("total_out"), "height")


@query("SELECT DISTINCT height, day FROM p_c")
def stream_dedup_blocks(spark, d):
    """Blocks that land twice, within the watermark."""
    land, out = _landed(spark, d, 2), new_folder(spark, "deduplicated")
    rows = stream.dedup_blocks(stream.read_block_stream(spark, land).select("height", "time")).select("height", F.to_date("time").alias("day"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    delete(spark, land)
    return spark.read.schema("height bigint, day date").parquet(f"{out}/rows")


@query("SELECT DISTINCT day, 'agoric' || c AS address, role, 'far' AS mode FROM p_c, (VALUES ('signer'), ('fee_payer')) AS r(role) WHERE ok")
def catchup_trigger(spark, d):
    """Participants after the controller, far behind the tip, has caught up; with the mode that it chose."""
    land, path = _landed(spark, d), new_folder(spark, "tables")
    t, tip = stream.open_tables(spark, path, ["participant_day"]), P.table(spark, d, "orders").agg(F.max(F.expr("o_orderkey div 16")).alias("h")).first()["h"]
    ran = stream.follow(t, land, f"{path}/checkpoint", lambda: tip, lambda: stream.done_through(t) >= tip, threshold=tip // 2, far=BATCH, poll=1.0, lag=0)
    delete(spark, land)
    return t.read("participant_day").withColumn("mode", F.lit(ran[0][0]))


@query(FLOWS_SQL)
def flow_first_seen_stream(spark, d):
    """First sighting and last state of flows from blocks that come in no order."""
    rows = stream.flow_states(_streamed(spark, d, ["ymax_flow"], 0))
    return rows.drop("contract").withColumn("amount", F.col("amount").cast("long"))


# --- what is kept beside the sums

NEW_RULES = offers.RULES._replace(named=[("^ymax", "vaults")], user_targets=["planner"])
_NEW = "CASE WHEN k % 4 = 1 THEN CASE WHEN c % 2 = 0 THEN 'orchestration' ELSE 'ymax' END WHEN k % 4 = 0 AND c % 3 = 0 THEN 'vaults' ELSE 'other' END"


def _by_rules(category: str, named: str) -> str:
    settled = f"CASE WHEN c % 2 = 0 THEN '{named}|' ELSE 'unclassified|' END || {OUTCOME}"
    return " UNION ALL ".join([_sum("offer_category", category, "1", "ok AND k % 4 <> 2"), _sum("offer_outcome_category", settled, "1", "k % 5 = 0"), f"SELECT day, 'wallets', {category}, count(DISTINCT c) FROM p_c WHERE ok AND k % 4 <> 2 GROUP BY ALL"])


def _reclassified(rules):
    def run(spark, d):
        blocks = chain_blocks(spark, d)
        got = jobs.reclassified(extract.action_facts(extract.tx_rows(blocks)), extract.outcome_facts(blocks), rules)
        wallets = got["offer_category_participant_day"].groupBy("day", F.col("category").alias("dimension")).agg(F.count(F.lit(1)).alias("value"))
        sums = kpis.rollup_days(got["hourly_metrics"]).withColumn("value", F.col("value").cast("long"))
        return sums.unionByName(wallets.select("day", F.lit("wallets").alias("series"), "dimension", "value"))

    return run


query(_by_rules(_CATEGORY, "ymax"), "action_facts")(_reclassified(offers.RULES))
query(_by_rules(_NEW, "vaults"), "reclassify_actions")(_reclassified(NEW_RULES))


@query(_RET)
def retention_by_index(spark, d):
    """Retention from the days of both windows and an index of first days."""
    people = P.participant(spark, d)
    return participation.retention_by_index(people, participation.first_seen_index(people), P.NOW, P.BEFORE)


_DAY = "day = DATE '2024-01-11' AND ok"
_LOST = "height % 180 = 10"  # every other block of that day
_ROLES = "(VALUES ('signer'), ('fee_payer')) AS r(role)"


@query(f"""WITH p AS (SELECT DISTINCT c, bool_and({_LOST}) OVER (PARTITION BY c) AS gone FROM p_c WHERE {_DAY}),
v AS (SELECT c, sum(m) AS a, coalesce(sum(m) FILTER (NOT ({_LOST})), 0) AS b FROM p_c WHERE {_DAY} AND k % 4 = 2 GROUP BY c)
SELECT 'participant_day rows' AS check, role AS key, CAST(count(*) AS BIGINT) AS stored, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS replayed FROM p, {_ROLES} GROUP BY role HAVING bool_or(gone)
UNION ALL SELECT 'participant_day', 'agoric' || c || '/' || role, 1, 0 FROM p, {_ROLES} WHERE gone
UNION ALL SELECT 'address_volume_day', 'agoric' || c || '/den' || (c % 3), CAST(a AS BIGINT), CAST(b AS BIGINT) FROM v WHERE a <> b""")
def replay_day_parity(spark, d):
    """The stored tables of a day against a replay of its archived blocks, some of which are missing."""
    path, blocks, day = new_folder(spark, "archive"), chain_blocks(spark, d), date(2024, 1, 11)
    B.archive_blocks(blocks.where(f"NOT {_LOST}"), path, span=64)
    names = ["participant_day", "address_volume_day"]
    stored = jobs.rollup_tables(blocks, names=names)
    replayed = jobs.rollup_tables(B.read_archived_day(spark, path, day, span=64), names=names)
    got = jobs.replay_parity(stored, replayed, day)
    return got.withColumns({c: F.col(c).cast("long") for c in ("stored", "replayed")})


def tumbled(spark: SparkSession, d: str, width: str) -> DataFrame:
    """Closed windows of a stream of blocks in the order of their times, an hour's batch late at most."""
    land, out = new_folder(spark, "landing"), new_folder(spark, "windows")
    chain_blocks(spark, d).write.json(land, compression="gzip")
    rows = stream.tumbling_sums(stream.read_block_stream(spark, land), width, "0 seconds")
    stream.write_tumbling(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    delete(spark, land)
    return spark.read.schema("start timestamp, series string, dimension string, value decimal(38,0)").parquet(f"{out}/rows")


@query(f"SELECT * FROM ({' UNION ALL '.join(_ROLLED[:2])}) WHERE day < (SELECT max(day) FROM p_c)")
def tumbling_stream_day(spark, d):
    """Sums by day in append mode: the last day's window stays open."""
    rows = tumbled(spark, d, "1 day").where(F.col("series").isin("wallet_actions", "offer_category"))
    return rows.select(F.to_date("start").alias("day"), "series", "dimension", F.col("value").cast("long").alias("value"))
