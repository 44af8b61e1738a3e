"""From blocks to rollup deltas and address facts. Every transaction yields an array of deltas and every message one more, so the many
series of transactions cost one pass; those of block events and of state changes read other columns. What is used more than
once is a column of its own, parsed once. `amounts` tells how amounts are held: numbers.DECIMALS or, for over 38 digits, numbers.LIMBS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capdata, events
from ..functions.denoms import ibc_denom
from ..functions.numbers import DECIMALS, WIDE, Decimals
from ..sources.blocks import block_events, pair_txs, tx_hash
from . import offers

# Message types and the series they count for.
SEND, MULTI_SEND = "/cosmos.bank.v1beta1.MsgSend", "/cosmos.bank.v1beta1.MsgMultiSend"
IBC_OUT, IBC_IN = "/ibc.applications.transfer.v1.MsgTransfer", "/ibc.core.channel.v1.MsgRecvPacket"
INSTALL = "/agoric.swingset.MsgInstallBundle"
WALLET = ["/agoric.swingset.MsgWalletAction", "/agoric.swingset.MsgWalletSpendAction"]
COUNTED = {
    "/cosmos.staking.v1beta1.MsgDelegate": "staking_delegations",
    "/cosmos.staking.v1beta1.MsgUndelegate": "staking_undelegations",
    "/cosmos.staking.v1beta1.MsgBeginRedelegate": "staking_redelegations",
    "/cosmos.gov.v1beta1.MsgVote": "gov_votes",
    "/cosmos.gov.v1.MsgVote": "gov_votes",
    "/cosmos.gov.v1beta1.MsgVoteWeighted": "gov_votes",
    "/cosmos.gov.v1.MsgVoteWeighted": "gov_votes",
    "/cosmos.gov.v1beta1.MsgSubmitProposal": "gov_proposals",
    "/cosmos.gov.v1.MsgSubmitProposal": "gov_proposals",
}
COINS = "array<struct<denom: string, amount: string>>"


def _coin_list(amounts: Decimals) -> str:
    return f"array<struct<denom: string, amount: {amounts.type}>>"


def _delta(series: Column | str, dimension: Column | str, delta: Column | int, amounts: Decimals = DECIMALS) -> Column:
    """delta: an integer or a column of integers."""
    return _amount_delta(series, dimension, amounts.of(F.lit(delta) if isinstance(delta, int) else delta), amounts)


def _amount_delta(series: Column | str, dimension: Column | str, amount: Column, amounts: Decimals = DECIMALS) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(series).alias("series"), offers.clamp_dim(lit(dimension)).alias("dimension"), amounts.stored(amount).alias("delta"))


def _coins(series: str, coins: Column, amounts: Decimals = DECIMALS) -> Column:
    return F.transform(coins, lambda c: _amount_delta(series, c["denom"], c["amount"], amounts))


def _none(amounts: Decimals) -> Column:
    return F.array().cast(f"array<struct<series: string, dimension: string, delta: {amounts.type}>>")


def _when(cond: Column, deltas: Column, amounts: Decimals = DECIMALS) -> Column:
    return F.when(cond, deltas).otherwise(_none(amounts))


def json_coins(text: Column, amounts: Decimals = DECIMALS) -> Column:
    """array<struct<denom, amount>> of a JSON list of coins; amounts that are no integer are left out."""
    got = F.coalesce(F.from_json(text, COINS), F.array().cast(COINS))
    ok = F.filter(got, lambda c: c["denom"].isNotNull() & c["amount"].rlike("^[0-9]+$"))
    return F.transform(ok, lambda c: F.struct(c["denom"].alias("denom"), amounts.of(c["amount"]).alias("amount")))


def with_ibc_in(txs: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """Adds ibc_in: array<struct<denom, amount, from_received, from_transfer, used_filter, used_fallback>> of a transaction: by
    denomination, the larger of both event families' sums, each taken first. Only events of the receiving messages count if any event names a
    message; if that leaves nothing, all of the transaction's do. Each event is parsed once."""
    kinds = F.filter("events", lambda e: e["type"].isin("coin_received", "transfer"))
    parsed = F.transform(kinds, lambda e: F.struct(e["type"].alias("kind"), events.msg_index(e).alias("at"), F.flatten(F.transform(events.attr_values(e, "amount"), lambda v: events.parse_coins(v, amounts))).alias("coins")))
    indices = events.msg_indices_of(F.col("messages"), IBC_IN)
    t = txs.withColumn("__at", indices).withColumn("__all", F.when(F.size("__at") > 0, parsed).otherwise(F.slice(parsed, 1, 0)))
    t = t.withColumn("__mine", F.filter("__all", lambda e: F.coalesce(F.array_contains(F.col("__at"), e["at"]), F.lit(False))))
    t = t.withColumn("__tried", (F.size("__at") > 0) & F.exists("__all", lambda e: e["at"].isNotNull()))
    t = t.withColumn("__used", F.col("__tried") & F.exists("__mine", lambda e: F.size(e["coins"]) > 0))
    t = t.withColumn("__events", F.when(F.col("__used"), F.col("__mine")).otherwise(F.col("__all")))
    coins = lambda kind: F.flatten(F.transform(F.filter("__events", lambda e: e["kind"] == kind), lambda e: e["coins"]))
    t = t.withColumns({"__got": coins("coin_received"), "__moved": coins("transfer")})
    t = t.withColumns({c: events.sum_coins(F.col(c), amounts) for c in ("__got", "__moved")})
    names = F.array_distinct(F.concat(F.transform("__got", lambda c: c["denom"]), F.transform("__moved", lambda c: c["denom"])))
    got, moved = (lambda d: events.amount_of(F.col("__got"), d, amounts)), (lambda d: events.amount_of(F.col("__moved"), d, amounts))
    used, tried = F.col("__used"), F.col("__tried")
    rows = F.transform(names, lambda d: F.struct(
        d.alias("denom"), F.greatest(got(d), moved(d)).alias("amount"), got(d).alias("from_received"), moved(d).alias("from_transfer"),
        used.alias("used_filter"), (tried & ~used).alias("used_fallback")))
    return t.withColumn("ibc_in", rows).drop("__at", "__all", "__mine", "__tried", "__used", "__events", "__got", "__moved")


def flows_in(evs: Column, messages: Column) -> Column:
    """Distinct (port, channel, sequence) of the receive events; without any, the number of receiving messages."""
    n = F.size(events.msg_indices_of(messages, IBC_IN))
    keys = F.array_distinct(F.transform(F.filter(evs, lambda e: e["type"] == "recv_packet"), lambda e: F.concat_ws("/", *[F.coalesce(events.attr_first(e, f"packet_{k}"), F.lit("")) for k in ("dst_port", "dst_channel", "sequence")])))
    return F.when(n > 0, F.when(F.size(keys) > 0, F.size(keys)).otherwise(n)).otherwise(0)


def sent_coins(message: Column, amounts: Decimals = DECIMALS) -> Column:
    """What a message transfers: a send, the outputs of a multi-send, the token of an outbound transfer."""
    url, body = message["type_url"], message["body"]
    outs = F.from_json(F.get_json_object(body, "$.outputs"), f"array<struct<coins: {COINS}>>")
    multi = F.flatten(F.transform(F.coalesce(outs, F.array().cast(f"array<struct<coins: {COINS}>>")), lambda o: json_coins(F.to_json(o["coins"]), amounts)))
    token = json_coins(F.concat(F.lit("["), F.get_json_object(body, "$.token"), F.lit("]")), amounts)
    return F.when(url == SEND, json_coins(F.get_json_object(body, "$.amount"), amounts)).when(url == MULTI_SEND, multi).when(url == IBC_OUT, token).otherwise(F.array().cast(_coin_list(amounts)))


def sender_legs(message: Column, amounts: Decimals = DECIMALS) -> Column:
    """array<struct<address, denom, amount>>: the sending side; of a multi-send, its inputs."""
    url, body = message["type_url"], message["body"]
    at = lambda who, coins: F.transform(coins, lambda c: F.struct(who.alias("address"), c["denom"].alias("denom"), c["amount"].alias("amount")))
    ins_type = f"array<struct<address: string, coins: {COINS}>>"
    ins = F.coalesce(F.from_json(F.get_json_object(body, "$.inputs"), ins_type), F.array().cast(ins_type))
    multi = F.flatten(F.transform(ins, lambda i: at(i["address"], json_coins(F.to_json(i["coins"]), amounts))))
    none = F.array().cast(f"array<struct<address: string, denom: string, amount: {amounts.type}>>")
    return F.when(url == SEND, at(F.get_json_object(body, "$.fromAddress"), sent_coins(message, amounts))).when(url == MULTI_SEND, multi).when(url == IBC_OUT, at(F.get_json_object(body, "$.sender"), sent_coins(message, amounts))).otherwise(none)


def message_deltas(rows: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """Adds m_deltas to rows of messages (m: type_url, body; null for none). Each body is parsed into columns, once for each kind of message."""
    counted = F.create_map(*[F.lit(x) for kv in COUNTED.items() for x in kv])
    url = F.col("m.type_url")
    t = rows.withColumns({"__coins": F.when(url.isin(SEND, MULTI_SEND, IBC_OUT), sent_coins(F.col("m"), amounts)), "__action": F.when(url.isin(WALLET), capdata.parsed_action(F.col("m.body")))})
    t = t.withColumn("__f", F.when(url.isin(WALLET), capdata.action_fields(F.col("__action"))))
    f = lambda name: F.col(f"__f.{name}")
    t = t.withColumn("__category", offers.offer_category(f("kind"), f("instance_path"), f("maker"), f("target")))
    one = lambda series, dim: _delta(series, dim, 1, amounts)
    offer, invoked = f("kind") == "zoe_offer", f("kind") == "wallet_invocation"
    wallet = F.array_compact(F.array(
        one("wallet_actions", f("kind")), one("offer_category", F.col("__category")), F.when(offer, one("offer_source", f("source"))),
        F.when(offer & f("instance").isNotNull(), one("offer_instance", f("instance"))), F.when(offer & f("maker").isNotNull(), one("offer_maker", f("maker"))),
        F.when(invoked & f("target").isNotNull(), one("invoke_target", f("target")))))
    legs = lambda series, side: F.transform(capdata.legs_of(F.col(f"__action.offer.proposal.{side}"), amounts), lambda x: _amount_delta(series, F.coalesce(x["brand"], F.lit("")), x["value"], amounts))
    coins, series = F.coalesce("__coins", F.array().cast(_coin_list(amounts))), F.try_element_at(counted, url)
    deltas = F.concat(
        _coins("transfer_volume", coins, amounts), _when(url == IBC_OUT, F.concat(_coins("ibc_transfer_amount_out", coins, amounts), F.array(one("ibc_transfer_out_count", ""))), amounts),
        _when(series.isNotNull(), F.array(one(series, "")), amounts), _when(url.isin(WALLET), F.concat(wallet, _when(offer, F.concat(legs("offer_give_volume", "give"), legs("offer_want_volume", "want")), amounts)), amounts))
    return t.withColumn("m_deltas", F.when(F.col("m").isNotNull(), deltas).otherwise(_none(amounts))).drop("__coins", "__action", "__f", "__category")


def tx_rows(blocks: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """height, time, tx_i, ok, tx, messages, events, payer, fees."""
    t = pair_txs(blocks).withColumn("ok", F.col("result.code") == 0)
    evs = F.coalesce("result.events", F.array().cast("array<struct<type: string, attributes: array<struct<key: string, value: string>>>>"))
    messages = F.coalesce("tx.messages", F.array().cast("array<struct<type_url: string, body: string>>"))
    t = t.withColumns({"events": evs, "messages": messages})
    t = t.withColumn("__fees", events.fee_coins(F.col("events"), amounts))
    return t.withColumns({"fees": events.sum_coins(F.col("__fees"), amounts), "payer": F.when(F.col("ok"), events.message_payer(F.col("tx"))).otherwise(events.event_payer(F.col("events")))}).drop("__fees")


def tx_deltas(txs: DataFrame, modules: list[str] = (), amounts: Decimals = DECIMALS) -> DataFrame:
    """height, time, deltas: a row for each message, the first of which has the transaction's own deltas as well. txs: tx_rows with the
    same amounts; modules: accounts whose receipts are no credits (a curated list)."""
    ok, evs, msgs = F.col("ok"), F.col("events"), F.col("messages")
    receiver = lambda e: events.attr_first(e, "receiver")
    credits = F.filter(evs, lambda e: (e["type"] == "coin_received") & receiver(e).isNotNull() & ~F.coalesce(receiver(e).isin(list(modules)), F.lit(False)))
    t = with_ibc_in(txs, amounts).withColumn("__credit", F.when(ok, F.flatten(F.transform(credits, lambda e: F.flatten(F.transform(events.attr_values(e, "amount"), lambda v: events.parse_coins(v, amounts)))))))
    t = t.withColumns({"__credit": F.coalesce(events.sum_coins(F.col("__credit"), amounts), F.array().cast(_coin_list(amounts))), "__n_in": F.size(events.msg_indices_of(msgs, IBC_IN))})
    n_in = F.col("__n_in")
    gas = lambda c: F.coalesce(F.col(c).try_cast(WIDE), F.lit(0).cast(WIDE))
    delta = lambda series, n: _delta(series, "", n, amounts)
    every = F.concat(
        F.array(delta(F.when(ok, "tx_success").otherwise("tx_failed"), 1), delta("gas_used", gas("result.gas_used")), delta("gas_wanted", gas("result.gas_wanted"))),
        _coins("fee_paid", F.col("fees"), amounts),
    )
    inbound = _when(n_in > 0, F.concat(F.array(delta("ibc_transfer_in_count", n_in), delta("ibc_transfer_flow_in", flows_in(evs, msgs))), _coins("ibc_transfer_amount_in", F.col("ibc_in"), amounts)), amounts)
    own = F.concat(every, _when(ok, F.concat(_coins("bank_credits_volume", F.col("__credit"), amounts), inbound), amounts))
    rows = t.withColumn("own", own).select("height", "time", "own", F.posexplode_outer(F.when(ok, msgs)).alias("m_i", "m"))
    rows = message_deltas(rows, amounts)
    return rows.select("height", "time", F.concat(_when(F.coalesce(F.col("m_i") == 0, F.lit(True)), F.col("own"), amounts), F.col("m_deltas")).alias("deltas"))


def send_packets(evs: Column, amounts: Decimals = DECIMALS) -> Column:
    """array<struct<denom, amount, sender, receiver, channel>>: the transfers that blocks send on their own: transfer port, no mode or a
    begin/end-block mode, an integer amount above 0."""
    def ok(e: Column) -> Column:
        mode = events.attr_last(e, "mode")
        return (e["type"] == "send_packet") & (events.attr_last(e, "packet_src_port") == "transfer") & (mode.isNull() | mode.isin("EndBlock", "BeginBlock"))

    def of(e: Column) -> Column:
        j = F.from_json(events.packet_json(e), "denom string, amount string, sender string, receiver string")
        return F.struct(ibc_denom(j["denom"]).alias("denom"), F.when(j["amount"].rlike("^[0-9]+$"), amounts.try_of(j["amount"])).alias("amount"), j["sender"].alias("sender"), j["receiver"].alias("receiver"), events.attr_last(e, "packet_src_channel").alias("channel"))

    return F.filter(F.transform(F.filter(F.coalesce(evs, F.array().cast("array<struct<type: string, attributes: array<struct<key: string, value: string>>>>")), ok), of), lambda s: s["denom"].isNotNull() & amounts.nonzero(s["amount"]))


def block_deltas(blocks: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """height, time, deltas at the grain of blocks, before any transaction is exploded."""
    gas, sends = events.max_gas(F.col("max_gas")), F.col("__sends")
    return blocks.select("height", "time", "max_gas", send_packets(block_events(), amounts).alias("__sends")).select("height", "time", F.concat(
        _when(gas.isNotNull(), F.array(_delta("block_gas_limit", "", gas, amounts)), amounts), _coins("ibc_transfer_amount_out_orch", sends, amounts),
        _when(F.size(sends) > 0, F.array(_delta("ibc_transfer_out_count_orch", "", F.size(sends), amounts)), amounts)).alias("deltas"))


def all_deltas(blocks: DataFrame, modules: list[str] = (), amounts: Decimals = DECIMALS) -> DataFrame:
    """height, hour, series, dimension, delta."""
    both = tx_deltas(tx_rows(blocks, amounts), modules, amounts).unionByName(block_deltas(blocks, amounts))
    return both.select("height", F.date_trunc("hour", "time").alias("hour"), F.inline("deltas"))


def participants(txs: DataFrame) -> DataFrame:
    """Distinct (day, address, role) of successful transactions: signers and the fee payer."""
    signer = F.transform(F.coalesce("tx.signers", F.array().cast("array<string>")), lambda s: F.struct(s.alias("address"), F.lit("signer").alias("role")))
    rows = txs.where("ok").select(F.to_date("time").alias("day"), F.inline(F.concat(signer, F.array(F.struct(F.col("payer").alias("address"), F.lit("fee_payer").alias("role"))))))
    return rows.where("coalesce(address, '') <> ''").distinct()


def address_fees(txs: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """(day, address, denom, fee), of failed transactions too."""
    rows = txs.where("payer IS NOT NULL").select(F.to_date("time").alias("day"), F.col("payer").alias("address"), F.inline("fees"))
    return rows.groupBy("day", "address", "denom").agg(amounts.sum(F.col("amount")).alias("fee"))


def address_volumes(txs: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """(day, address, denom, volume) of the sending sides of successful transactions."""
    rows = txs.where("ok").select(F.to_date("time").alias("day"), F.inline(F.flatten(F.transform("messages", lambda m: sender_legs(m, amounts)))))
    return rows.where("address IS NOT NULL").groupBy("day", "address", "denom").agg(amounts.sum(F.col("amount")).alias("volume"))


def bundle_installs(txs: DataFrame, denom: str = "ubld") -> DataFrame:
    """One row per installing transaction: tx_hash, height, day, installer, gas_fee, storage_fee. Storage is what the payer spent beyond
    the gas fee; null if that is nothing, or if other messages may have spent it."""
    evs = F.col("events")
    urls = events.type_urls_from_events(evs)
    spends = F.filter(evs, lambda e: (e["type"] == "coin_spent") & (events.attr_first(e, "spender") == F.col("__payer")))
    payers = F.filter(F.transform(F.filter(evs, lambda e: e["type"] == "tx"), lambda e: events.attr_first(e, "fee_payer")), lambda p: F.coalesce(p, F.lit("")) != "")
    fee = events.amount_of(events.sum_coins(F.flatten(F.transform(F.filter(evs, lambda e: e["type"] == "tx"), lambda e: events.parse_coins(events.attr_first(e, "fee"))))), F.lit(denom))
    rows = txs.where("ok").withColumn("__urls", urls).where(F.array_contains("__urls", INSTALL)).withColumn("__payer", F.try_element_at(payers, F.lit(-1)))
    spent = events.amount_of(events.sum_coins(F.flatten(F.transform(spends, lambda e: events.parse_coins(events.attr_first(e, "amount"))))), F.lit(denom))
    rows = rows.withColumns({"gas_fee": fee, "__more": (spent - fee).cast(WIDE)})
    alone = F.forall("__urls", lambda u: u == INSTALL)
    return rows.select(tx_hash(F.col("tx.raw")).alias("tx_hash"), "height", F.to_date("time").alias("day"), F.col("__payer").alias("installer"), "gas_fee", F.when(alone & (F.col("__more") > 0), F.col("__more")).alias("storage_fee"))


def recv_hits(txs: DataFrame, denoms: list[str]) -> DataFrame:
    """height, tx_hash, denom, amount of transactions that receive packets, for some denominations."""
    rows = txs.where(F.col("ok") & (F.size(events.msg_indices_of(F.col("messages"), IBC_IN)) > 0))
    got = with_ibc_in(rows).select("height", tx_hash(F.col("tx.raw")).alias("tx_hash"), F.inline("ibc_in"))
    return got.where(F.col("denom").isin(denoms)).select("height", "tx_hash", "denom", "amount")


def pool_snapshots(blocks: DataFrame) -> DataFrame:
    """(day, wallets, minted, converted, height): of each day the last reading at the greatest height; both counters are needed."""
    ev = blocks.select("height", "time", F.posexplode(block_events()).alias("ev_i", "e")).where("e.type = 'state_change'")
    path = capdata.vstorage_path(events.attr_last(F.col("e"), "key"))
    rows = ev.where(capdata.classify_state_path(path) == "pool").select("height", F.to_date("time").alias("day"), "ev_i", F.try_element_at(capdata.stream_values(events.attr_last(F.col("e"), "value")), F.lit(-1)).alias("v"))
    body = F.get_json_object("v", "$.body")
    f = capdata.capdata_fields(body, F.from_json(F.get_json_object("v", "$.slots"), "array<string>"), {"wallets": "$.walletsProvisioned", "minted": "$.totalMintedProvided.value", "converted": "$.totalMintedConverted.value"})
    nums = rows.select("day", "height", "ev_i", f.alias("f")).select("day", "height", "ev_i", *[capdata.nat_of(F.col(f"f.{c}")).alias(c) for c in ("wallets", "minted", "converted")])
    return nums.where("wallets IS NOT NULL AND minted IS NOT NULL").groupBy("day").agg(F.max_by(F.struct("wallets", "minted", "converted", "height"), F.struct("height", "ev_i")).alias("r")).select("day", F.col("r.wallets").cast("long").alias("wallets"), "r.minted", "r.converted", "r.height")


def state_cells(blocks: DataFrame) -> DataFrame:
    """height, day, hour, ev_i, val_i, kind, path, json, slots: every published value of the tracked state paths, in block order."""
    ev = blocks.select("height", "time", F.posexplode(block_events()).alias("ev_i", "e")).where("e.type = 'state_change'")
    rows = ev.select("height", F.to_date("time").alias("day"), F.date_trunc("hour", "time").alias("hour"), "ev_i", capdata.vstorage_path(events.attr_last(F.col("e"), "key")).alias("path"), F.posexplode(capdata.stream_values(events.attr_last(F.col("e"), "value"))).alias("val_i", "v"))
    rows = rows.withColumn("kind", capdata.classify_state_path(F.col("path"))).where("kind <> 'other'")
    return rows.select("height", "day", "hour", "ev_i", "val_i", "kind", "path", F.regexp_replace(F.get_json_object("v", "$.body"), "^#", "").alias("json"), F.from_json(F.get_json_object("v", "$.slots"), "array<string>").alias("slots"))


def _ymax(cells: DataFrame, kind: str, *key: str) -> DataFrame:
    """The cells of one kind whose value is an object, with contract, portfolio, further parts of the path and the order within the block."""
    rows = cells.where((F.col("kind") == kind) & F.get_json_object("json", "$").startswith("{"))
    return rows.select(F.col("path")[1].alias("contract"), F.col("path")[3].alias("portfolio"), *[F.col("path")[5].alias(k) for k in key], "day", "height", F.struct("ev_i", "val_i").alias("seq"), "json", "slots")


def _denom(brand: Column, brands: dict[str, str] | None) -> Column:
    """What `brands` (board id -> denomination) has for a brand, null if nothing; without it the brand as published."""
    if brands is None:
        return brand
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in brands.items() for x in kv]).cast("map<string,string>"), brand)


def portfolio_rows(cells: DataFrame) -> DataFrame:
    """contract, portfolio, deposit, agoric_account, accounts, policy_version, flow_count, height, seq from state_cells."""
    rows = _ymax(cells, "portfolio").withColumn("f", capdata.portfolio_fields(F.col("json")))
    agoric = capdata.split_account(F.try_element_at(F.col("f.accounts"), F.lit("agoric")))["address"]
    return rows.select("contract", "portfolio", "f.deposit", agoric.alias("agoric_account"), "f.accounts", capdata.nat_of(F.get_json_object("json", "$.policyVersion")).cast("long").alias("policy_version"), "f.flow_count", "height", "seq")


def position_rows(cells: DataFrame, brands: dict[str, str] | None = None) -> DataFrame:
    """contract, portfolio, position_key, protocol, chain, account_id, denom, total_in, total_out, net, height, seq from state_cells."""
    rows = _ymax(cells, "position", "position_key").withColumn("f", capdata.position_fields(F.col("json"), F.col("position_key"))).where("f IS NOT NULL")
    named = capdata.capdata_fields(F.col("json"), F.col("slots"), {n: f"$.{n}.brand" for n in ("totalIn", "totalOut", "netTransfers")})
    brand = F.coalesce(*[named[n] for n in ("totalIn", "totalOut", "netTransfers")])
    return rows.select("contract", "portfolio", "position_key", "f.protocol", "f.chain", F.get_json_object("json", "$.accountId").alias("account_id"), _denom(brand, brands).alias("denom"), "f.total_in", "f.total_out", "f.net", "height", "seq")


def flow_rows(cells: DataFrame, brands: dict[str, str] | None = None) -> DataFrame:
    """contract, portfolio, flow_id, flow_type, denom, amount, day, height, state, progress, seq: the sightings of flows in state_cells.
    A portfolio's record announces its running flows, a flow's own record has its progress."""
    said = _ymax(cells, "portfolio").select("contract", "portfolio", "day", "height", "seq", "slots", F.explode(capdata.portfolio_fields(F.col("json"))["flows"]).alias("flow_id", "flow")).where(F.get_json_object("flow", "$").startswith("{"))
    amount = capdata.nat_of(F.get_json_object("flow", "$.amount.value"))
    brand = capdata.capdata_fields(F.col("flow"), F.col("slots"), {"brand": "$.amount.brand"})["brand"]
    said = said.select("contract", "portfolio", "flow_id", F.coalesce(F.get_json_object("flow", "$.type"), F.lit("unknown")).alias("flow_type"), F.when(amount.isNotNull(), _denom(brand, brands)).alias("denom"), amount.alias("amount"), "day", "height", F.lit("run").alias("state"), F.lit(0).alias("progress"), "seq")
    none = lambda t: F.lit(None).cast(t)
    own = _ymax(cells, "flow", "flow_id").select("contract", "portfolio", "flow_id", F.lit("unknown").alias("flow_type"), none("string").alias("denom"), none("decimal(38,0)").alias("amount"), "day", "height", capdata.flow_fields(F.col("json"))["state"].alias("state"), F.lit(1).alias("progress"), "seq")
    return said.unionByName(own)


RAW = "kind string, instance_path string, maker string, target string"
ACTION = f"height bigint, hour timestamp, tx_i int, m_i int, address string, source string, instance string, {RAW}"
OUTCOME = f"height bigint, hour timestamp, ev_i int, val_i int, outcome string, named boolean, {RAW}"


def action_facts(txs: DataFrame) -> DataFrame:
    """The columns of ACTION: every wallet message of a successful transaction with its owner and what rules decide by, undecided."""
    rows = txs.where("ok").select("height", F.date_trunc("hour", "time").alias("hour"), "tx_i", F.posexplode("messages").alias("m_i", "m")).where(F.col("m.type_url").isin(WALLET))
    rows = rows.withColumn("a", capdata.parsed_action(F.col("m.body")))
    rows = rows.select("height", "hour", "tx_i", "m_i", F.get_json_object("m.body", "$.owner").alias("address"), capdata.action_fields(F.col("a")).alias("f"))
    return rows.select("height", "hour", "tx_i", "m_i", "address", *[f"f.{c}" for c in ("source", "instance", "kind", "instance_path", "maker", "target")])


def offer_actions(txs: DataFrame) -> DataFrame:
    """day, address, kind, category of the wallet messages of successful transactions, by their owner."""
    return action_participants(offers.classified(action_facts(txs)))


def action_participants(facts: DataFrame) -> DataFrame:
    """day, address, kind, category of classified actions that have an owner."""
    return facts.where("coalesce(address, '') <> ''").select(F.to_date("hour").alias("day"), "address", "kind", "category")


def _outcomes(blocks: DataFrame) -> DataFrame:
    """The terminal offer statuses: state_cells with outcome, named (the status tells its contract) and f, its action fields."""
    cells = state_cells(blocks).where("kind = 'wallet'").withColumn("outcome", capdata.offer_outcome(F.col("json"))).where("outcome IS NOT NULL")
    told = F.concat(F.lit('{"method":"executeOffer","offer":'), F.get_json_object("json", "$.status"), F.lit("}"))
    cells = cells.withColumn("named", F.get_json_object("json", "$.status.invitationSpec").isNotNull()).withColumn("__a", capdata.parsed_action(told))
    return cells.withColumn("f", capdata.action_fields(F.col("__a")))


def outcome_facts(blocks: DataFrame) -> DataFrame:
    """The columns of OUTCOME: every terminal offer status with what rules decide by, undecided."""
    return _outcomes(blocks).select("height", "hour", "ev_i", "val_i", "outcome", "named", *[f"f.{c}" for c in ("kind", "instance_path", "maker", "target")])


def outcome_category(facts: DataFrame, rules: offers.Rules = offers.RULES) -> DataFrame:
    """Facts (named, kind, ...) with their category, `unclassified` where the status doesn't tell the contract."""
    return offers.classified(facts, rules).withColumn("category", F.when(F.col("named"), F.col("category")).otherwise("unclassified"))


def offer_outcome_deltas(blocks: DataFrame, amounts: Decimals = DECIMALS) -> DataFrame:
    """height, hour, series, dimension, delta from terminal offer statuses."""
    cells = outcome_category(_outcomes(blocks).select("height", "hour", "json", "outcome", "named", *[f"f.{c}" for c in ("kind", "instance_path", "maker", "target")]))
    payouts = F.transform(capdata.amount_legs(F.get_json_object("json", "$.status.payouts"), amounts), lambda x: _amount_delta("offer_payout_volume", F.coalesce(x["brand"], F.lit("")), x["value"], amounts))
    deltas = F.concat(F.array(_delta("offer_outcome", F.col("outcome"), 1, amounts), _delta("offer_outcome_category", offers.outcome_dim(F.col("category"), F.col("outcome")), 1, amounts)), payouts)
    return cells.select("height", "hour", F.inline(deltas))


def rollup_deltas(blocks: DataFrame, modules: list[str] = (), amounts: Decimals = DECIMALS) -> DataFrame:
    """height, hour, series, dimension, delta: all that the rollups sum, in batch, stream and backfill alike."""
    return all_deltas(blocks, modules, amounts).unionByName(offer_outcome_deltas(blocks, amounts))
