"""Dense week x shopper x product panel.

The panel is far larger than the facts, so it is never shuffled: facts are packed per
(shopper, block of products), joined to the range of such cells, and a cell is opened
into products and weeks inside the task that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.functions import history as H
from couponloom.functions.columns import in_domain, percent_of, product_block
from couponloom.operators.facts import KEY
from couponloom.operators.histories import cells
from couponloom.params import Params

# Panel rows that a task opens. Cells are small beside the rows they are opened to, so the bytes of a
# shuffle of cells do not tell how many tasks these need.
ROWS_PER_TASK = 200_000


def grid(spark: SparkSession, params: Params) -> DataFrame:
    """Every (week, shopper, product) of the panel, computed from one range."""
    weeks, products = len(params.panel_weeks), params.n_products
    key = F.col("id")
    return spark.range(params.n_shoppers * products * weeks).select(
        (key % weeks + params.start_week).cast("int").alias("week"),
        F.expr(f"id div {weeks * products}").cast("int").alias("shopper"),
        (F.expr(f"id div {weeks}") % products).cast("int").alias("product"),
    )


def _prepared(packed: DataFrame, weeks: list[int], cut: int | None) -> DataFrame:
    """Cells with their `offers` of the panel weeks, picked once a cell and not once a row.

    With a `cut` their histories are shortened, once a pair and not once a row.
    """
    inside = F.filter("offers", lambda o: o["week"].between(min(weeks), max(weeks)))
    packed = packed.withColumn("offers", inside)
    if cut is None or cut <= 0:
        return packed
    return packed.withColumn("histories", F.transform_values("histories", lambda _, h: H.shortened(h, cut)))


def panel_tasks(params: Params, weeks: int, products: int) -> int:
    """Tasks that open the whole panel: as many as its rows need."""
    return -(-params.n_shoppers * products * weeks // ROWS_PER_TASK) or 1


def _with_history(rows: DataFrame) -> DataFrame:
    """`history` of the row's pair, looked up in its cell; empty where the pair has no fact."""
    kind = rows.schema["histories"].dataType.valueType
    own = F.coalesce(F.col("histories")[F.col("product")], F.array().cast(kind))
    return rows.withColumn("history", own).drop("histories")


def _open_cells(dense: DataFrame, params: Params, weeks: list[int], products: int) -> DataFrame:
    """One row per product of the block and panel week without a fact."""
    size = params.category_size
    last = F.least(F.col("block") * size + (size - 1), F.lit(products - 1))
    opened = dense.withColumn("product", F.explode(F.sequence(F.col("block") * size, last)))
    wanted = F.array(*[F.lit(w) for w in weeks])
    seen = F.transform("history", lambda h: h["week"])
    return _with_history(opened).withColumn("week", F.explode(F.array_except(wanted, seen)))


def panel(
    data: DataFrame,
    params: Params,
    weeks: list[int] | None = None,
    products: int | None = None,
    by_shopper: DataFrame | None = None,
    with_history: bool = True,
    packed: DataFrame | None = None,
    only: DataFrame | None = None,
    look_back: int | None = None,
) -> DataFrame:
    """Facts of the panel weeks plus a default row for every key without a fact.

    Default rows have no price, no discount and no purchase. With `with_history` each
    row carries the week entries of its pair as `history` and those of its cell with a discount in
    the panel weeks as `offers`; otherwise only the facts of the panel weeks are read. `by_shopper`,
    unique per shopper, is attached before the cells are opened. `packed` are the cells
    of the facts where they are written already. `only` restricts the panel to given
    keys, whose further columns are carried along, without opening the other ones.
    Repeated keys keep all their rows. With `look_back` weeks a history has its entries of so many weeks
    before the panel and later, and older ones as H.shortened joins them.
    """
    spark = data.sparkSession
    weeks = weeks or params.panel_weeks
    products = params.n_products if products is None else products
    block = product_block(params)
    in_weeks = F.col("week").isin(weeks)
    inside = data.filter(in_domain(params, products))
    cut = None if look_back is None else min(weeks) - look_back
    if packed is None:
        packed = cells(inside if with_history else inside.filter(in_weeks), params, cut=cut)
        cut = None
    # Both joins leave out the same cells, so that they share one shuffle.
    packed = packed.filter(F.col("shopper").isNotNull() & F.col("block").isNotNull())
    packed = _prepared(packed, weeks, cut)

    if only is None:
        shoppers = spark.range(params.n_shoppers).select(F.col("id").cast("int").alias("shopper"))
        blocks = -(-products // params.category_size)
    else:
        only = only.filter(in_domain(params, products) & in_weeks)
    observed = inside.filter(in_weeks)
    if only is not None:
        observed = observed.join(only, KEY)
    if with_history:
        observed = _with_history(observed.withColumn("block", block).join(packed, ["shopper", "block"]))

    wanted = shoppers if only is None else only.withColumn("block", block)
    extra = [] if only is None else [c for c in only.columns if c not in KEY]
    if by_shopper is not None:
        wanted, observed = (df.join(by_shopper, "shopper", "left") for df in (wanted, observed))
        extra += [c for c in by_shopper.columns if c != "shopper"]
    if only is None:
        wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = F.array().cast(packed.schema["offers"].dataType)
    wanted = wanted.join(packed, ["shopper", "block"], "left").withColumn("offers", F.coalesce("offers", none))
    if only is None:
        # The join above shares its shuffle of cells with the observed rows; its tasks may be few.
        wanted = wanted.repartition(panel_tasks(params, len(weeks), products), "shopper", "block")
        missing = _open_cells(wanted, params, weeks, products)
    else:
        missing = _with_history(wanted).filter(
            ~F.exists("history", lambda h: h["week"] == F.col("week"))
        )
    missing = missing.withColumns({
        "price": F.lit(None).cast("double"), "discount": F.lit(0.0), "purchased": F.lit(0),
    })
    columns = [*KEY, "price", "discount", "purchased", *extra]
    columns += ["history", "offers"] if with_history else []
    return observed.select(*columns).unionByName(missing.select(*columns))


def dense_counts(
    data: DataFrame, params: Params, by: str, weeks: list[int], products: int | None = None
) -> DataFrame:
    """(by, percent, n_rows, purchases) of the panel without building it.

    `by` is "shopper" or "product". Facts are counted as they are; the default rows of
    a value are the size of its slice of the panel less its keys that have facts.
    """
    products = params.n_products if products is None else products
    inside = data.filter(in_domain(params, products) & F.col("week").isin(weeks))
    values, other = (
        (products, params.n_shoppers) if by == "product" else (params.n_shoppers, products)
    )
    counted = inside.groupBy(by, percent_of("discount").alias("percent")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("purchased").cast("long")).alias("purchases")
    )
    taken = inside.select(*KEY).distinct().groupBy(by).agg(F.count("*").alias("taken"))
    default = (
        data.sparkSession.range(values)
        .select(F.col("id").cast("int").alias(by))
        .join(taken, by, "left")
        .select(
            by,
            F.lit(0.0).alias("percent"),
            (F.lit(other * len(weeks)).cast("long") - F.coalesce("taken", F.lit(0))).alias("n_rows"),
            F.lit(0).cast("long").alias("purchases"),
        )
    )
    return (
        counted.unionByName(default)
        .groupBy(by, "percent")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("purchases").alias("purchases"))
    )
