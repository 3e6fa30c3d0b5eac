"""Rounding, money and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom.schemas import MONEY

OVERBOUGHT, OVERSOLD = 70, 30


def to_money(c: Column, saturate: bool = False) -> Column:
    """Text to decimal(18,8); text that is no number gives NULL.

    ``saturate`` clamps to the ends of decimal(15,8), as the price column's own cast does.
    """
    value = c.try_cast(MONEY)
    if not saturate:
        return value
    top = F.lit("9999999.99999999").cast(MONEY)
    return F.when(value > top, top).when(value < -top, -top).otherwise(value)


def round_half_up(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def round_half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def null_to_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def rsi_level(c: Column) -> Column:
    """Both limits are strict: 70 and 30 themselves are neutral."""
    return (
        F.when(c > OVERBOUGHT, "overbought").when(c < OVERSOLD, "oversold").when(c.isNotNull(), "neutral")
    )


def change_class(c: Column) -> Column:
    return F.when(c < 0, "negative").when(c > 0, "positive").when(c == 0, "neutral")


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals. Rounds by the value the double really has; an exact half goes to the even digit."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def change_label(c: Column) -> Column:
    """The change with four decimals; gains carry a plus sign, zero carries none."""
    return F.concat(F.when(c > 0, "+").otherwise(""), fixed(c, 4), F.lit("%"))


def unit_cost(amount: Column, coins: Column) -> Column:
    """amount / coins; NULL when there are no coins."""
    return F.try_divide(amount, coins).cast(MONEY)


def trade_amount(coins: Column, price: Column) -> Column:
    return (coins * price).cast("decimal(30,8)")


def swap_value(quantity: Column, from_price: Column) -> Column:
    return (quantity * from_price).cast("decimal(30,8)")


def swap_quantity(quantity: Column, from_price: Column, to_price: Column) -> Column:
    return F.try_divide(swap_value(quantity, from_price), to_price).cast("decimal(30,8)")
