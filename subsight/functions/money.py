"""Money expressions.

Refunds are price x remaining / duration rounded to cents, half away from
zero. Decimal division would first round to 6 digits, so the maths runs
in integer cents: round_half_up(c*d/n) = (2*c*d + n) div (2*n) for c, d >= 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S

# The en-IN currency format - rupee sign before the number,
# minus sign before the symbol, two decimals, last three digits grouped,
# then groups of two (1,23,45,678.90).
CURRENCY_SYMBOL = "₹"


def prorata(amount: Column, remaining: Column, duration: Column) -> Column:
    """amount x remaining / duration in cents, half away from zero; 0 when
    nothing remains or the duration is not positive."""
    cents = (amount * 100).cast("bigint")
    num = F.lit(2) * cents * remaining + duration
    den = F.lit(2) * duration
    q = (num - F.pmod(num, den)) / den  # exact integer division of whole numbers
    # q is whole cents; dividing a decimal by 100 is exact.
    value = (q.cast("decimal(18,0)") / F.lit(100)).cast(S.TOTAL)
    return F.when((duration > 0) & (remaining > 0), value).otherwise(F.lit(0).cast(S.TOTAL))


def currency_inr(amount: Column) -> Column:
    """Currency text in the en-IN culture: rupee sign, lakh grouping
    (1,23,45,678.90), minus sign before the symbol."""
    text = F.abs(amount).cast(S.TOTAL).cast("string")
    whole = F.substring_index(text, ".", 1)
    frac = F.substring_index(text, ".", -1)
    # a comma after every digit followed by 3, 5, 7, ... digits
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit(CURRENCY_SYMBOL), grouped, F.lit("."), frac)


def percent_text(ratio: Column) -> Column:
    """Ratio as percent with two digits: 0.1234 -> '12.34%'."""
    return F.concat(F.round((ratio * 100).cast("decimal(20,6)"), 2).cast(S.TOTAL).cast("string"), F.lit("%"))


def one_digit_text(x: Column) -> Column:
    """Number with one decimal digit ('0.0' format)."""
    return F.round(x.cast("decimal(20,6)"), 1).cast("decimal(18,1)").cast("string")
