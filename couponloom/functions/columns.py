"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from couponloom.params import PERCENT_DIGITS, Params


def ratio(numerator, denominator) -> Column:
    """Quotient as double, null where the denominator is zero."""
    return F.try_divide(_double(numerator), _double(denominator))


def _double(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("double")


def percent_of(discount) -> Column:
    """Percent of a discount fraction to six digits, so that equality is exact: 29.6 is not 30."""
    return exact_percent(_double(discount) * 100)


def exact_percent(value) -> Column:
    return F.round(_double(value), PERCENT_DIGITS)


def exact_units(fraction) -> Column:
    """A fraction in whole billionths: sums of these do not depend on their order."""
    return F.round(_double(fraction) * 1e9).cast("long")


def exact_fraction(units: Column) -> Column:
    return units / F.lit(1e9)


def shelf_price(price, discount) -> Column:
    """Price before the discount; null when the discount is the whole price."""
    return F.try_divide(_double(price), 1 - _double(discount))


def expected_revenue(probability, price, discount) -> Column:
    return _double(probability) * _double(price) * (1 - _double(discount))


def product_block(params: Params) -> Column:
    return F.floor(F.col("product") / F.lit(params.category_size)).cast("int")


def product_category(params: Params) -> Column:
    """Left-closed bins of the category size; null outside the binned range."""
    binned = F.col("product").between(0, params.n_categories * params.category_size - 1)
    return F.when(binned, product_block(params))


def elasticity(discounted_rate: Column, regular_rate: Column, params: Params) -> Column:
    """Relative change of the purchase rate per unit of discount."""
    return ratio(discounted_rate - regular_rate, F.lit(params.elasticity_discount) * regular_rate)


def in_domain(params: Params, products: int | None = None) -> Column:
    """Shoppers and products the panel covers."""
    top = params.n_products if products is None else products
    return F.col("shopper").between(0, params.n_shoppers - 1) & F.col("product").between(0, top - 1)
