"""Expressions over events, messages and coin strings. Events keep their attributes as an array: keys repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import DECIMALS, Decimals

COIN = r"^([0-9]+)([a-zA-Z0-9/.-]+)$"


def attr_values(event: Column, key: str) -> Column:
    return F.transform(F.filter(event["attributes"], lambda a: a["key"] == key), lambda a: a["value"])


def attr_first(event: Column, key: str) -> Column:
    return F.try_element_at(attr_values(event, key), F.lit(1))


def attr_last(event: Column, key: str) -> Column:
    return F.try_element_at(attr_values(event, key), F.lit(-1))


def parse_coins(text: Column, amounts: Decimals = DECIMALS) -> Column:
    """array<struct<denom, amount>> of "10ubld,5uist"; parts that are no coin are left out, repeats stay apart."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike(COIN))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, COIN, 2).alias("denom"), amounts.of(F.regexp_extract(x, COIN, 1)).alias("amount")))


def sum_coins(coins: Column, amounts: Decimals = DECIMALS) -> Column:
    """One entry per denomination. For the few coins of a transaction; sums over many rows are groupings."""
    names = F.array_distinct(F.transform(coins, lambda c: c["denom"]))
    zero = amounts.stored(amounts.of(F.lit(0)))
    return F.transform(names, lambda d: F.struct(d.alias("denom"), F.aggregate(F.filter(coins, lambda c: c["denom"] == d), zero, lambda s, c: amounts.stored(amounts.add(s, c["amount"]))).alias("amount")))


def amount_of(coins: Column, denom: Column, amounts: Decimals = DECIMALS) -> Column:
    """The amount of a denomination in summed coins, else 0."""
    return F.coalesce(F.try_element_at(F.transform(F.filter(coins, lambda c: c["denom"] == denom), lambda c: c["amount"]), F.lit(1)), amounts.of(F.lit(0)))


def msg_index(event: Column) -> Column:
    """The first `msg_index` attribute that starts with digits, as an integer."""
    digits = F.filter(F.transform(attr_values(event, "msg_index"), lambda v: F.regexp_extract(v, r"^\s*([0-9]+)", 1)), lambda v: v != "")
    return F.try_element_at(digits, F.lit(1)).try_cast("int")


def msg_indices_of(messages: Column, type_url: str) -> Column:
    """Positions of the messages of a type."""
    at = F.transform(messages, lambda m, i: F.when(m["type_url"] == type_url, i))
    return F.filter(at, lambda i: i.isNotNull())


def max_gas(text: Column) -> Column:
    """A positive integer, else null."""
    v = F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("long"))
    return F.when(v > 0, v)


def fee_coins(events: Column, amounts: Decimals = DECIMALS) -> Column:
    """The last `fee` attribute of every `tx` event."""
    return F.flatten(F.transform(F.filter(events, lambda e: e["type"] == "tx"), lambda e: parse_coins(attr_last(e, "fee"), amounts)))


def event_payer(events: Column) -> Column:
    """The fee payer named on the first `tx` event that carries a fee."""
    paying = F.filter(events, lambda e: (e["type"] == "tx") & (F.coalesce(attr_last(e, "fee"), F.lit("")) != ""))
    return F.nullif(F.try_element_at(F.transform(paying, lambda e: attr_last(e, "fee_payer")), F.lit(1)), F.lit(""))


def message_payer(tx: Column) -> Column:
    """Granter, explicit payer, first signer: the first that isn't blank."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(full(tx["fee_granter"]), full(tx["fee_payer"]), full(F.try_element_at(tx["signers"], F.lit(1))))


def type_urls_from_events(events: Column) -> Column:
    return F.flatten(F.transform(F.filter(events, lambda e: e["type"] == "message"), lambda e: attr_values(e, "action")))


def received_coins(events: Column, kind: str, indices: Column | None = None) -> Column:
    """Amounts of events of a kind, only those of the given messages if `indices` is set."""
    keep = lambda e: (e["type"] == kind) & (F.lit(True) if indices is None else F.coalesce(F.array_contains(indices, msg_index(e)), F.lit(False)))
    return F.flatten(F.transform(F.filter(events, keep), lambda e: F.flatten(F.transform(attr_values(e, "amount"), lambda v: parse_coins(v)))))


def packet_json(event: Column) -> Column:
    """`packet_data`, else the decoded `packet_data_hex`; null if neither is there or the hex is bad."""
    hexed = attr_last(event, "packet_data_hex")
    return F.coalesce(F.nullif(attr_last(event, "packet_data"), F.lit("")), F.decode(F.when(hexed.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(hexed)), "UTF-8"))


