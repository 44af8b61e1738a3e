"""Fields of marshalled bodies, by JSON paths: only those that the rollups use, not a general decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import DECIMALS, Decimals

# Labels of chain ids, and the states that end a flow.
CHAINS = {"eip155:1": "Ethereum", "eip155:10": "Optimism", "eip155:8453": "Base", "eip155:42161": "Arbitrum", "eip155:43114": "Avalanche", "eip155:137": "Polygon", "cosmos:agoric-3": "agoric", "cosmos:noble-1": "noble"}
TERMINAL = ["done", "fail", "failed", "error", "cancelled"]


def capdata_fields(body: Column, slots: Column, paths: dict[str, str]) -> Column:
    """struct of the values at JSON paths of a body `#{...}`: `$0.text` becomes the slot's id, `+12` becomes 12."""
    json = F.regexp_replace(body, "^#", "")

    def value(path: str) -> Column:
        raw = F.get_json_object(json, path)
        slot = F.try_element_at(slots, F.regexp_extract(raw, r"^\$([0-9]+)", 1).try_cast("int") + 1)
        return F.when(raw.rlike(r"^\$[0-9]+"), slot).when(raw.rlike(r"^\+[0-9]+$"), F.substring(raw, 2, 1 << 20)).otherwise(raw)

    return F.struct(*[value(p).alias(n) for n, p in paths.items()])


def nat_of(text: Column, amounts: Decimals = DECIMALS) -> Column:
    """`+123` or `123` as an integer, else null."""
    bare = F.regexp_replace(text, r"^\+", "")
    return F.when(bare.rlike("^[0-9]+$"), amounts.try_of(bare))


def vstorage_path(key: Column) -> Column:
    """Segments of a NUL-separated key from `published` on; null if it isn't there."""
    parts = F.filter(F.split(key, "\u0000"), lambda s: F.length(s) > 0)
    at = F.array_position(parts, "published").cast("int")
    return F.when(at > 0, F.slice(parts, at, F.size(parts)))


def classify_state_path(path: Column) -> Column:
    """wallet, portfolio, position, flow, pool, other."""
    at = lambda k: F.try_element_at(path, F.lit(k))
    ymax = at(2).rlike("^ymax[0-9]+$") & (at(3) == "portfolios")
    n = F.size(path)
    return (
        F.when((at(2) == "wallet") & (n == 3), "wallet").when(ymax & (n == 4), "portfolio").when(ymax & (n == 6) & (at(5) == "positions"), "position")
        .when(ymax & (n == 6) & (at(5) == "flows"), "flow").when((at(2) == "provisionPool") & (at(3) == "metrics") & (n == 3), "pool").otherwise("other")
    )


def stream_values(cell: Column) -> Column:
    """The string entries of `values` in a cell's JSON; null if it is malformed."""
    return F.filter(F.from_json(cell, "values array<string>")["values"], lambda v: v.isNotNull())


def split_account(account: Column) -> Column:
    """struct(chain_id, address) of `ns:chain:address`; the address may hold colons."""
    parts = F.split(account, ":")
    long = F.size(parts) >= 3
    return F.struct(F.when(long, F.concat_ws(":", parts[0], parts[1])).alias("chain_id"), F.when(long, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), ":")).otherwise(F.nullif(account, F.lit(""))).alias("address"))


def position_fields(json: Column, key: Column) -> Column:
    """struct(protocol, chain, total_in, total_out, net) of a position's JSON; null without both totals."""
    get = lambda p: F.get_json_object(json, p)
    tin, tout, net = (nat_of(get(f"$.{n}.value")) for n in ("totalIn", "totalOut", "netTransfers"))
    labels = F.create_map(*[F.lit(x) for kv in CHAINS.items() for x in kv])
    chain_id = split_account(get("$.accountId"))["chain_id"]
    suffixed = key.contains("_")
    last = F.substring_index(key, "_", -1)
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(tin.isNotNull() | tout.isNotNull(), F.struct(
        F.coalesce(get("$.protocol"), F.when(suffixed, F.substring(key, F.lit(1), F.length(key) - F.length(last) - 1))).alias("protocol"),
        F.when(suffixed, last).otherwise(F.coalesce(F.try_element_at(labels, chain_id), chain_id)).alias("chain"),
        F.coalesce(tin, zero).alias("total_in"), F.coalesce(tout, zero).alias("total_out"), F.coalesce(net, zero).alias("net")))


def portfolio_fields(json: Column) -> Column:
    """struct(accounts: chain -> account id, deposit, flow_count, flows: id -> JSON). Two shapes of accounts are merged, the first wins."""
    plain = F.coalesce(F.from_json(F.get_json_object(json, "$.accountIdByChain"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    state = F.coalesce(F.from_json(F.get_json_object(json, "$.accountStateByChain"), "map<string,struct<address: string, chainId: string>>"), F.create_map().cast("map<string,struct<address: string, chainId: string>>"))
    more = F.transform_values(F.map_filter(state, lambda k, v: v["address"].isNotNull() & v["chainId"].isNotNull() & ~F.map_contains_key(plain, k)), lambda _, v: F.concat_ws(":", v["chainId"], v["address"]))
    return F.struct(F.map_concat(plain, more).alias("accounts"), F.get_json_object(json, "$.depositAddress").alias("deposit"), nat_of(F.get_json_object(json, "$.flowCount")).cast("long").alias("flow_count"), F.from_json(F.get_json_object(json, "$.flowsRunning"), "map<string,string>").alias("flows"))


def flow_fields(json: Column) -> Column:
    """struct(how, state, step, terminal)."""
    state = F.get_json_object(json, "$.state")
    return F.struct(F.get_json_object(json, "$.how").alias("how"), state.alias("state"), F.get_json_object(json, "$.step").try_cast("int").alias("step"), F.coalesce(state.isin(TERMINAL), F.lit(False)).alias("terminal"))


LEGS = "map<string,struct<brand: string, value: string>>"
ACTION = f"""method string, message struct<targetName: string, id: string>, offer struct<id: string, invitationSpec: struct<source: string, instance: string,
instancePath: array<string>, publicInvitationMaker: string, invitationMakerName: string, previousOffer: string, callPipe: array<array<string>>>,
proposal: struct<give: {LEGS}, want: {LEGS}>>"""


def parsed_action(json: Column) -> Column:
    """A decoded action as a struct. Put it into a column of its own before action_fields, so that it is parsed once."""
    return F.from_json(json, ACTION)


def action_fields(a: Column) -> Column:
    """struct(kind, source, instance, instance_path, maker, continuing, target, offer_id) of a parsed action."""
    spec = a["offer"]["invitationSpec"]
    kind = F.when(a["method"].isin("executeOffer", "tryExitOffer"), "zoe_offer").when(a["method"] == "invokeEntry", "wallet_invocation").otherwise("unknown")
    source = F.when(spec["source"].isin("contract", "agoricContract", "continuing", "purse"), spec["source"]).otherwise("unknown")
    pipe = F.when(source == "agoricContract", F.try_element_at(F.try_element_at(spec["callPipe"], F.lit(1)), F.lit(1)))
    invoked = kind == "wallet_invocation"
    full = lambda c: F.nullif(c, F.lit(""))
    mine = lambda c: F.when(~invoked, c)
    return F.struct(
        kind.alias("kind"), F.when(invoked, "unknown").otherwise(source).alias("source"), mine(spec["instance"]).alias("instance"), mine(F.when(F.size(spec["instancePath"]) > 0, F.array_join(spec["instancePath"], "."))).alias("instance_path"),
        mine(F.coalesce(full(spec["publicInvitationMaker"]), full(spec["invitationMakerName"]), pipe)).alias("maker"),
        F.coalesce(~invoked & ((source == "continuing") | spec["previousOffer"].isNotNull()), F.lit(False)).alias("continuing"), F.when(invoked, a["message"]["targetName"]).alias("target"), F.when(invoked, a["message"]["id"]).otherwise(a["offer"]["id"]).alias("offer_id"))


def wallet_action_fields(json: Column) -> Column:
    return action_fields(parsed_action(json))


def amount_legs(json: Column, amounts: Decimals = DECIMALS) -> Column:
    """array<struct<keyword, brand, value>> of a map keyword -> {brand, value}; values that are no non-negative integer are left out."""
    return legs_of(F.from_json(json, LEGS), amounts)


def legs_of(legs: Column, amounts: Decimals = DECIMALS) -> Column:
    all_ = F.transform(F.map_entries(legs), lambda e: F.struct(e["key"].alias("keyword"), e["value"]["brand"].alias("brand"), nat_of(e["value"]["value"], amounts).alias("value")))
    return F.coalesce(F.filter(all_, lambda x: x["value"].isNotNull()), F.array().cast(f"array<struct<keyword: string, brand: string, value: {amounts.type}>>"))


def offer_outcome(json: Column) -> Column:
    """errored, wants_unsatisfied or wants_satisfied for a terminal offer status (one with payouts), else null."""
    get = lambda p: F.get_json_object(json, p)
    done = (get("$.updated") == "offerStatus") & F.coalesce(F.array_contains(F.json_object_keys(get("$.status")), "payouts"), F.lit(False))
    wants = get("$.status.numWantsSatisfied")
    bad = F.coalesce(get("$.status.error"), F.lit("")) != ""
    return F.when(done, F.when(bad, "errored").when(F.coalesce(wants.try_cast("double") == 0, F.lit(False)), "wants_unsatisfied").otherwise("wants_satisfied"))
