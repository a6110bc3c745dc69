"""Expressions over the history of a shopper-product pair.

A history is an array of structs, one per week and ascending, with at least `week` and the
counts `purchased`, `received` and `redeemed`. Repeated keys raise the counts, so the
array never outgrows the number of weeks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from couponloom.functions.columns import ratio


def weeks_with(history: Column, count: str) -> Column:
    """Ascending weeks in which the named count is positive."""
    return F.transform(F.filter(history, lambda h: h[count] > 0), lambda h: h["week"])


def total(history: Column, count: str, since: Column | None = None) -> Column:
    """Sum of the named count, from the given week on."""

    def add(acc, h):
        value = h[count]
        return acc + (value if since is None else F.when(h["week"] >= since, value).otherwise(0))

    return F.aggregate(history, F.lit(0).cast("long"), add)


def before(history: Column, week: Column) -> Column:
    return F.filter(history, lambda h: h["week"] < week)


def shortened(history: Column, cut: int) -> Column:
    """The history with its weeks from 0 to before the cut in one entry, which comes first.

    That entry has the sums of their counts and the week of their latest purchase, 0 without one. What
    is asked from a week of the cut or later about a window that starts with week 0 or the
    cut or later is the same as of the whole history.
    """
    counts = ("purchased", "received", "redeemed")
    inside = lambda h: h["week"].between(0, cut - 1)

    def add(acc, h):
        week = F.when(inside(h) & (h["purchased"] > 0), F.greatest(acc["week"], h["week"])).otherwise(acc["week"])
        sums = [(acc[c] + F.when(inside(h), h[c]).otherwise(0)).alias(c) for c in counts]
        return F.struct(week.cast("int").alias("week"), *sums)

    none = F.struct(F.lit(0).alias("week"), *[F.lit(0).cast("long").alias(c) for c in counts])
    rest = F.filter(history, lambda h: F.coalesce(~inside(h), F.lit(True)))
    entry = lambda h: F.struct(*[h[c].alias(c) for c in ("week", *counts)])
    return F.concat(F.array(F.aggregate(history, none, add)), F.transform(rest, entry))


def weeks_since_purchase(past: Column, week: Column, default: Column) -> Column:
    latest = F.aggregate(
        past,
        F.lit(None).cast("int"),
        lambda acc, h: F.greatest(acc, F.when(h["purchased"] > 0, h["week"])),
    )
    return F.coalesce(week - latest, default).cast("int")


def trend(past: Column, week: Column, window: Column) -> Column:
    """Purchases in the window of weeks before this one, per week of the window."""
    return ratio(total(past, "purchased", week - window), window)


def redemption_rate(past: Column) -> Column:
    return F.coalesce(ratio(total(past, "redeemed"), total(past, "received")), F.lit(0.0))


def offers_per_purchase(past: Column) -> Column:
    return F.coalesce(ratio(total(past, "received"), total(past, "purchased")), F.lit(0.0))
