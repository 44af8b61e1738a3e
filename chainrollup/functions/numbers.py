"""Percentages, ratios and exact unit conversions."""

from __future__ import annotations

import decimal
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
LIMB_DIGITS = 20


def pct_change(now: Column, before: Column) -> Column:
    """Percent with two decimals, cut towards zero in integer arithmetic; 0 if both are 0, null if only `before` is."""
    n, b = now.cast("decimal(38,0)"), before.cast("decimal(38,0)")
    hundredths = F.call_function("div", (n - b) * F.lit(10000).cast("decimal(5,0)"), F.nullif(b, F.lit(0).cast("decimal(38,0)")))
    return F.when(b == 0, F.when(n == 0, F.lit(0.0))).otherwise(hundredths.cast("double") / 100)


def pct_change_double(now: Column, before: Column) -> Column:
    n, b = now.cast("double"), before.cast("double")
    return F.when(b == 0, F.when(n == 0, F.lit(0.0))).otherwise((n - b) / b * 100)


def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    """a / b * times as a double; null on a zero or null denominator."""
    d = b.cast("double")
    return F.when(d != 0, a.cast("double") / d * times)


def atomic_to_decimal(units: Column, decimals: Column) -> Column:
    """Integer units as an exact decimal string, without trailing zeros. Decimals outside 0..36, or units that are no
    integer, leave the text as it is."""
    text = units.cast("string")
    d = decimals.cast("int")
    sign, digits = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(text, "^-", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), d + 1), "0")
    whole = F.regexp_replace(F.substring(padded, F.lit(1), F.length(padded) - d), "^0+(?=[0-9])", "")
    part = F.rtrim(F.substring(padded, F.length(padded) - d + 1, d), F.lit("0"))
    made = F.concat(sign, whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
    return F.when(text.rlike("^-?[0-9]+$") & d.between(0, 36), made).otherwise(text)


def atomic_to_double(units: Column, decimals: Column) -> Column:
    """0 for what is no integer."""
    text = units.cast("string")
    return F.when(text.rlike("^-?[0-9]+$"), atomic_to_decimal(units, decimals).try_cast("double")).otherwise(F.lit(0.0))


def wide_sum(amount: Column) -> tuple[Column, Column]:
    """Two limb sums (high, low) of integers with more than 38 digits, held as text: value = high * 10^18 + low."""
    text = F.lpad(amount.cast("string"), 78, "0")
    return F.sum(F.substring(text, 25, 36).cast("decimal(38,0)")), F.sum(F.substring(text, 61, 18).cast("decimal(38,0)"))


def wide_join(high: Column, low: Column) -> Column:
    """The text of high * 10^18 + low after carrying."""
    base = F.lit(10**18).cast("decimal(38,0)")
    carry = F.floor(low / base).cast("decimal(38,0)")
    rest = (low - carry * base).cast("decimal(38,0)")
    top = (high + carry).cast("decimal(38,0)")
    return F.when(top == 0, rest.cast("string")).otherwise(F.concat(top.cast("string"), F.lpad(rest.cast("string"), 18, "0")))


class Decimals:
    """How amounts are held and added: non-negative integers as DECIMAL(38,0). What doesn't fit is an error."""

    type = WIDE

    def of(self, value: Column) -> Column:
        """An amount from an integer column or a text of digits."""
        return value.cast(self.type)

    def try_of(self, text: Column) -> Column:
        """Null where a text of digits is too long."""
        return text.try_cast(self.type)

    def add(self, a: Column, b: Column) -> Column:
        return (a + b).cast(self.type)

    def sum(self, amount: Column) -> Column:
        return F.sum(amount)

    def or_zero(self, amount: Column) -> Column:
        return F.coalesce(amount, F.lit(0))

    def nonzero(self, amount: Column) -> Column:
        return amount != 0

    def text(self, amount: Column) -> Column:
        return amount.cast("string")

    def stored(self, amount: Column) -> Column:
        return amount


class Limbs(Decimals):
    """Amounts of up to 80 digits, and sums beyond that, as a struct of four limbs of 20 digits, the greatest first. Structs compare limb by
    limb, so equality, order, min, max and greatest() are those of the numbers. A sum adds each limb and carries once at its end; a limb
    of the sum has room for 10^18 rows. Longer amounts are an error, as with Decimals."""

    type = f"struct<l3: {WIDE}, l2: {WIDE}, l1: {WIDE}, l0: {WIDE}>"

    def of(self, value: Column) -> Column:
        def long(text: Column) -> Column:
            return F.raise_error(F.concat(F.lit("amount of over 80 digits: "), F.substring(text, 1, 100))).cast(self.type)

        return self._bound(value, lambda text: F.when(F.length(text) > 4 * LIMB_DIGITS, long(text)).otherwise(self._limbs(text)))

    def try_of(self, text: Column) -> Column:
        return self._bound(text, lambda t: F.when(F.length(t) <= 4 * LIMB_DIGITS, self._limbs(t)))

    @staticmethod
    def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f of the digits without leading zeros, which stand in the expression once, however often f uses them."""
        return F.transform(F.array(F.regexp_replace(value.cast("string"), "^0+(?=[0-9])", "")), f)[0]

    def _limbs(self, text: Column) -> Column:
        parts = F.transform(F.array(F.lpad(text, 4 * LIMB_DIGITS, "0")), lambda p: F.struct(*[F.substring(p, 1 + LIMB_DIGITS * k, LIMB_DIGITS).cast(WIDE).alias(f"l{3 - k}") for k in range(4)]))
        return F.when(text.isNotNull(), parts[0])

    def _carried(self, limbs: list[Column]) -> Column:
        """limbs: l3 to l0, the lower ones of any size."""
        base, out = F.lit(decimal.Decimal(10**LIMB_DIGITS)), []
        carry = None
        for k, limb in enumerate(reversed(limbs)):
            whole = limb if carry is None else (limb + carry).cast(WIDE)
            out.append((whole if k == 3 else (whole % base).cast(WIDE)).alias(f"l{k}"))
            carry = F.call_function("div", whole, base).cast(WIDE)
        return F.struct(*reversed(out))

    def add(self, a: Column, b: Column) -> Column:
        return self._carried([(a[f"l{k}"] + b[f"l{k}"]).cast(WIDE) for k in (3, 2, 1, 0)])

    def sum(self, amount: Column) -> Column:
        sums = [F.sum(amount[f"l{k}"]) for k in (3, 2, 1, 0)]
        return F.when(sums[3].isNotNull(), self._carried(sums))

    def or_zero(self, amount: Column) -> Column:
        return F.coalesce(self.stored(amount), self.stored(self.of(F.lit(0))))

    def nonzero(self, amount: Column) -> Column:
        return F.greatest(*[amount[f"l{k}"] for k in range(4)]) != 0

    def text(self, amount: Column) -> Column:
        digits = F.concat(*[F.lpad(amount[f"l{k}"].cast("string"), LIMB_DIGITS if k < 3 else 38, "0") for k in (3, 2, 1, 0)])
        return F.regexp_replace(digits, "^0+(?=[0-9])", "")

    def stored(self, amount: Column) -> Column:
        return amount.cast(self.type)

    def narrow(self, amount: Column) -> Column:
        """The amount as DECIMAL(38,0) for what computes with it, null where it doesn't fit (it is no error: text() has it)."""
        digits = self.text(amount)
        return F.when(F.length(digits) <= 38, digits).cast(WIDE)


DECIMALS, LIMBS = Decimals(), Limbs()

SMALL = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Asks for a broadcast if the optimizer's size of the table is at most 64 MB; else the join shuffles."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= SMALL else df
