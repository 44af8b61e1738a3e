"""Denominations: traces, labels, price ids, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import small


def ibc_denom(trace: Column) -> Column:
    """`ibc/` and the upper-case SHA-256 of a trace path; a plain denomination as it is."""
    return F.when(trace.contains("/"), F.concat(F.lit("ibc/"), F.upper(F.sha2(trace, 256)))).otherwise(trace)


def disambiguate_labels(df: DataFrame) -> DataFrame:
    """Adds label: the symbol, with its origin behind if more than one asset has it. df: denom, symbol, origin."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("label", F.when((n > 1) & F.col("origin").isNotNull(), F.concat("symbol", F.lit(" ("), "origin", F.lit(")"))).otherwise(F.col("symbol")))


def stripped(label: Column) -> Column:
    """Without the last ` (...)`."""
    return F.regexp_replace(label, r"\s*\([^()]*\)\s*$", "")


def price_id_of(df: DataFrame, overrides: DataFrame, symbols: DataFrame, tries: int = 5) -> DataFrame:
    """Adds price_id to (denom, label): an override that isn't empty, else the symbol's, looked up for the label and with trailing
    groups in brackets taken off one by one. overrides: denom, id; symbols: symbol, id. Both are curated lists."""
    out = df.join(small(overrides.where("id <> ''").select("denom", F.col("id").alias("__o"))), "denom", "left")
    label = F.col("label")
    for k in range(tries):
        out = out.withColumn(f"__l{k}", label).join(small(symbols.where("id <> ''").select(F.col("symbol").alias(f"__l{k}"), F.col("id").alias(f"__s{k}"))), f"__l{k}", "left")
        label = stripped(F.col(f"__l{k}"))
    return out.withColumn("price_id", F.coalesce("__o", *[f"__s{k}" for k in range(tries)])).select(*df.columns, "price_id")


def registry_entries(df: DataFrame, text: str = "text") -> DataFrame:
    """(denom, name, decimals) from a published list of [denom, info] pairs, as JSON text: the first of a denomination wins, decimals only
    if an integer 0..30, malformed pairs dropped."""
    pairs = df.select(F.posexplode(F.from_json(text, "array<string>")).alias("pos", "pair")).withColumn("p", F.from_json("pair", "array<string>")).where(F.size("p") == 2)
    denom, info = F.col("p")[0], F.col("p")[1]
    d = F.get_json_object(info, "$.displayInfo.decimalPlaces")
    rows = pairs.select("pos", denom.alias("denom"), F.get_json_object(info, "$.issuerName").alias("name"), F.when(d.rlike("^[0-9]{1,2}$") & d.try_cast("int").between(0, 30), d.try_cast("int")).alias("decimals"), info.startswith("{").alias("ok"))
    best = rows.where("ok AND coalesce(denom, '') <> ''").groupBy("denom").agg(F.min_by(F.struct("name", "decimals"), "pos").alias("b"))
    return best.select("denom", "b.name", "b.decimals")


def origin_label(base: Column, hop: Column, hops: dict[str, str]) -> Column:
    """Where an asset comes from: bridge prefixes, factory denominations, else the first hop's chain. `hops`: channel -> chain."""
    chains = F.create_map(*[F.lit(x) for kv in hops.items() for x in kv]) if hops else None
    first = chains[hop] if chains is not None else F.lit(None).cast("string")
    return F.when(base.startswith("gravity0x"), "Gravity Bridge").when(base.rlike("^(axl|.*-wei$)"), "Axelar").when(base.startswith("factory/"), F.split(base, "/")[1]).when(base.startswith("peggy0x"), "Injective").otherwise(first)
