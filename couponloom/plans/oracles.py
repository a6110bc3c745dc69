"""Reference SQL for the registered queries, written over the dense panel.

Every statement is assembled from the named views below, so the queries are checked
against a direct formulation: the whole grid, plain joins and window functions.
"""

from __future__ import annotations

import re

# Views in order of dependency. Dates, weeks and ids follow sources.star.
VIEWS = {
    "size": "SELECT greatest(1, count(*) // 15)::INT AS s FROM customer",
    "li": """
        SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 26 AS INT) AS week,
               CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 26 AS INT) AS ship_week,
               CAST(o_custkey % (SELECT s FROM size) AS INT) AS shopper,
               CAST(l_partkey % 100 AS INT) AS product,
               CAST(round(l_discount * 100) AS INT) AS disc,
               CAST(round(p_retailprice * 10) AS BIGINT) AS reg10
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "coupons": """
        SELECT week, shopper, product, CAST(max(discount) AS DOUBLE) AS discount FROM (
          SELECT week, shopper, product, (disc - 4) * 5 AS discount FROM li WHERE disc BETWEEN 7 AND 10
          UNION ALL
          SELECT ship_week AS week, shopper, product, (disc + 2) * 5 AS discount FROM li
          WHERE disc BETWEEN 1 AND 4) u
        GROUP BY week, shopper, product""",
    "listed": "SELECT week, shopper, product, min(reg10) AS reg10 FROM li GROUP BY week, shopper, product",
    "baskets": """
        SELECT b.week, b.shopper, b.product,
               b.reg10 * (100 - CAST(coalesce(c.discount, 0) AS INT)) / CAST(1000 AS DOUBLE) AS price
        FROM listed b LEFT JOIN coupons c
          ON b.week = c.week AND b.shopper = c.shopper AND b.product = c.product""",
    "joined": "SELECT week, shopper, product, price, discount FROM baskets FULL JOIN coupons USING (week, shopper, product)",
    "facts": """
        SELECT week, shopper, product,
               price / (1e0 - coalesce(discount, 0e0) / 100e0) AS price,
               coalesce(discount, 0e0) / 100e0 AS discount,
               CAST(price IS NOT NULL AS INT) AS purchased
        FROM joined""",
    "grid": """
        SELECT CAST(w AS INT) AS week, CAST(s AS INT) AS shopper, CAST(p AS INT) AS product
        FROM range(86, 91) weeks(w), range((SELECT s FROM size)) shoppers(s), range(100) products(p)""",
    "panel": """
        SELECT week, shopper, product, price, coalesce(discount, 0e0) AS discount,
               coalesce(purchased, 0) AS purchased
        FROM grid LEFT JOIN facts USING (week, shopper, product)""",
    "priced": """
        SELECT product, week, round(price, 1) AS price, count(*) AS n FROM facts
        WHERE price IS NOT NULL GROUP BY ALL""",
    "mode_prices": """
        SELECT k.product, k.week, m.price AS mode_price
        FROM (SELECT DISTINCT product, week FROM facts) k LEFT JOIN (
          SELECT product, week, price,
                 row_number() OVER (PARTITION BY product, week ORDER BY n DESC, price) AS r
          FROM priced) m ON k.product = m.product AND k.week = m.week AND m.r = 1""",
    "last_prices": "SELECT product, week + 1 AS week, mode_price AS last_week_mode_price FROM mode_prices",
    "dataset": """
        SELECT week, shopper, product, coalesce(price, last_week_mode_price) AS price, discount, purchased
        FROM panel LEFT JOIN last_prices USING (product, week)""",
    "lists": """
        SELECT shopper, product,
               string_agg(week, ',' ORDER BY week) FILTER (purchased = 1) AS week_hist,
               string_agg(week, ',' ORDER BY week) FILTER (discount <> 0) AS discount_received_weeks,
               string_agg(week, ',' ORDER BY week) FILTER (purchased = 1 AND discount <> 0)
                 AS discount_redeemed_weeks,
               count(*) FILTER (purchased = 1) AS n_purchased,
               count(*) FILTER (discount <> 0) AS n_received,
               count(*) FILTER (purchased = 1 AND discount <> 0) AS n_redeemed
        FROM facts GROUP BY shopper, product""",
    "past": """
        SELECT g.week, g.shopper, g.product,
               max(h.week) FILTER (h.purchased = 1) AS last_purchase,
               count(*) FILTER (h.purchased = 1) AS bought,
               count(*) FILTER (h.purchased = 1 AND h.week >= g.week - 1) AS bought_1,
               count(*) FILTER (h.purchased = 1 AND h.week >= g.week - 3) AS bought_3,
               count(*) FILTER (h.purchased = 1 AND h.week >= g.week - 5) AS bought_5,
               count(*) FILTER (h.discount <> 0) AS received,
               count(*) FILTER (h.discount <> 0 AND h.purchased = 1) AS redeemed
        FROM grid g LEFT JOIN facts h
          ON g.shopper = h.shopper AND g.product = h.product AND h.week < g.week
        GROUP BY g.week, g.shopper, g.product""",
    "time_features": """
        SELECT week, shopper, product,
               CAST(coalesce(week - last_purchase, 104) AS INT) AS weeks_since_last_purchase,
               bought_1 / 1e0 AS trend_1, bought_3 / 3e0 AS trend_3, bought_5 / 5e0 AS trend_5,
               bought / CAST(week AS DOUBLE) AS product_freq,
               coalesce(redeemed / CAST(nullif(received, 0) AS DOUBLE), 0e0)
                 AS shopper_product_redemption_rate,
               coalesce(received / CAST(nullif(bought, 0) AS DOUBLE), 0e0) AS discount_buy
        FROM past""",
    "list_sizes": """
        SELECT shopper, product, coalesce(n_received, 0) AS n_received, coalesce(n_redeemed, 0) AS n_redeemed
        FROM grid LEFT JOIN lists USING (shopper, product)""",
    "shopper_rates": """
        SELECT shopper, sum(n_redeemed) / CAST(nullif(sum(n_received), 0) AS DOUBLE) AS shopper_redemption_rate
        FROM list_sizes GROUP BY shopper""",
    "product_rates": """
        SELECT product, sum(n_redeemed) / CAST(nullif(sum(n_received), 0) AS DOUBLE) AS product_redemption_rate
        FROM list_sizes GROUP BY product""",
    "train": "SELECT * FROM dataset WHERE week BETWEEN 86 AND 89",
    "train_counts": """
        SELECT product,
               count(*) FILTER (discount = 0) AS reg_n,
               count(*) FILTER (discount = 0 AND purchased = 1) AS reg_buy,
               count(*) FILTER (discount = 3e-1) AS d30_n,
               count(*) FILTER (discount = 3e-1 AND purchased = 1) AS d30_buy
        FROM train GROUP BY product""",
    "train_rates": """
        SELECT product, reg_buy / CAST(nullif(reg_n, 0) AS DOUBLE) AS reg,
               d30_buy / CAST(nullif(d30_n, 0) AS DOUBLE) AS d30 FROM train_counts""",
    "elasticity": "SELECT product, (d30 - reg) / nullif(3e-1 * reg, 0) AS elasticities FROM train_rates",
    # The labels of params.CATEGORY_CLUSTERS.
    "clusters": """
        SELECT CAST(i - 1 AS INT) AS product_cat, CAST(labels[i] AS INT) AS cat_cluster
        FROM (SELECT [1, 1, 2, 2, 0, 1, 0, 2, 2, 2, 0, 2, 2, 2, 2, 1, 2, 1, 2, 0, 2, 1, 2, 1, 2] AS labels),
             range(1, 26) r(i)""",
    "categorised": """
        SELECT week, shopper, product, price, CASE WHEN product BETWEEN 0 AND 89 THEN product // 10 END AS product_cat
        FROM baskets""",
    "substitutes": """
        SELECT week, shopper, product, discount, product // 10 AS product_cat,
               round(sum(discount) OVER (PARTITION BY week, shopper, product // 10) - discount, 6) + 0e0
                 AS substitute_discount
        FROM panel""",
    "model": """
        SELECT d.product_cat, d.product, week, shopper, price, d.discount, purchased, substitute_discount,
               CAST(cat_cluster = 0 AS INT) AS cluster_0, CAST(cat_cluster = 1 AS INT) AS cluster_1,
               CAST(cat_cluster = 2 AS INT) AS cluster_2,
               weeks_since_last_purchase, trend_1, trend_3, trend_5, product_freq,
               shopper_product_redemption_rate, discount_buy, shopper_redemption_rate,
               product_redemption_rate, elasticities
        FROM (SELECT *, product // 10 AS product_cat FROM dataset) d
        JOIN substitutes s USING (week, shopper, product)
        JOIN time_features USING (week, shopper, product)
        JOIN clusters c ON c.product_cat = d.product_cat
        LEFT JOIN shopper_rates USING (shopper)
        LEFT JOIN product_rates pr ON pr.product = d.product
        LEFT JOIN elasticity e ON e.product = d.product""",
    "totals": "SELECT sum(purchased) AS p, count(*) - sum(purchased) AS n FROM train",
    "woe_s": """
        SELECT shopper, CASE WHEN count(*) > 1 THEN
          ln(((sum(purchased) + 1e0) / ((SELECT p FROM totals) + 2e0))
             / ((count(*) - sum(purchased) + 1e0) / ((SELECT n FROM totals) + 2e0))) ELSE 0e0 END AS shopper_WOE
        FROM train GROUP BY shopper""",
    "woe_p": """
        SELECT product, CASE WHEN count(*) > 1 THEN
          ln(((sum(purchased) + 1e0) / ((SELECT p FROM totals) + 2e0))
             / ((count(*) - sum(purchased) + 1e0) / ((SELECT n FROM totals) + 2e0))) ELSE 0e0 END AS product_WOE
        FROM train GROUP BY product""",
    "scorer": """
        SELECT product, round(discount * 100, 6) AS percent,
               (sum(purchased) + 1e0) / (count(*) + 2e0) AS probability
        FROM train GROUP BY product, percent""",
    "test": "SELECT *, product // 10 AS product_cat FROM dataset WHERE week = 90",
    "what_if": """
        SELECT week, shopper, product, price, purchased, product_cat, 0e0 AS substitute_discount,
               d AS discount
        FROM test, (SELECT unnest([0e0, 15e-2, 2e-1, 25e-2, 3e-1]) AS d)""",
    "scored": """
        SELECT w.week, w.shopper, w.product, w.price, w.product_cat, w.discount,
               coalesce(r.probability, 5e-1) AS probability,
               coalesce(r.probability, 5e-1) * w.price * (1e0 - w.discount) AS exp_revenue
        FROM what_if w LEFT JOIN scorer r
          ON r.product = w.product AND r.percent = round(w.discount * 100, 6)""",
    "deltas": """
        SELECT a.week, a.shopper, a.product, a.price, a.product_cat, a.discount, a.probability,
               a.exp_revenue,
               CASE WHEN a.discount <> 0 THEN a.exp_revenue - z.exp_revenue END AS delta_revenue
        FROM scored a JOIN scored z
          ON a.shopper = z.shopper AND a.product = z.product AND z.discount = 0""",
    "best": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY shopper, product_cat
                     ORDER BY delta_revenue DESC NULLS LAST, product, discount) AS in_category
          FROM deltas WHERE discount <> 0) WHERE in_category = 1""",
    "optimal": """
        SELECT CAST(shopper AS BIGINT) AS shopper, CAST(week AS BIGINT) AS week, r - 1 AS coupon,
               CAST(product AS BIGINT) AS product, discount
        FROM (SELECT *, row_number() OVER (PARTITION BY shopper
                ORDER BY delta_revenue DESC NULLS LAST, product, discount) AS r FROM best)
        WHERE r <= 5""",
    "shoppers": "SELECT CAST(range AS BIGINT) AS shopper FROM range((SELECT s FROM size))",
    "draws": """
        SELECT shopper, j - 95 AS coupon, j,
               CAST('0x' || substr(md5(concat_ws('-', 42, shopper, j)), 1, 8) AS BIGINT) % (j + 1) AS drawn,
               CAST('0x' || substr(md5(concat_ws('-', 43, shopper, j - 95)), 1, 8) AS BIGINT) % 4 AS pick
        FROM shoppers, (SELECT unnest([95, 96, 97, 98, 99]) AS j)""",
    "wide": """
        SELECT shopper, max(drawn) FILTER (coupon = 0) AS d0, max(drawn) FILTER (coupon = 1) AS d1,
               max(drawn) FILTER (coupon = 2) AS d2, max(drawn) FILTER (coupon = 3) AS d3,
               max(drawn) FILTER (coupon = 4) AS d4 FROM draws GROUP BY shopper""",
    "draw_1": "SELECT shopper, d0 AS p0, CASE WHEN d1 = d0 THEN 96 ELSE d1 END AS p1, d2, d3, d4 FROM wide",
    "draw_2": "SELECT *, CASE WHEN d2 IN (p0, p1) THEN 97 ELSE d2 END AS p2 FROM draw_1",
    "draw_3": "SELECT *, CASE WHEN d3 IN (p0, p1, p2) THEN 98 ELSE d3 END AS p3 FROM draw_2",
    "draw_4": "SELECT *, CASE WHEN d4 IN (p0, p1, p2, p3) THEN 99 ELSE d4 END AS p4 FROM draw_3",
    "random_slots": """
        SELECT w.shopper, CAST(90 AS BIGINT) AS week, CAST(d.coupon AS BIGINT) AS coupon,
               CAST([p0, p1, p2, p3, p4][d.coupon + 1] AS BIGINT) AS product,
               [15e-2, 2e-1, 25e-2, 3e-1][pick + 1] AS discount
        FROM draw_4 w JOIN draws d ON w.shopper = d.shopper
        JOIN optimal o ON o.shopper = d.shopper AND o.coupon = d.coupon""",
    "zero_slots": "SELECT shopper, week, coupon, product, 0e0 AS discount FROM random_slots",
    "placed": """
        SELECT 'zero' AS policy, shopper, product, discount FROM zero_slots
        UNION ALL SELECT 'random', shopper, product, discount FROM random_slots
        UNION ALL SELECT 'optimal', shopper, product, discount FROM optimal""",
    "same_placed": """
        SELECT 'zero' AS policy, shopper, o.product, z.discount
        FROM optimal o JOIN zero_slots z USING (shopper, coupon)
        UNION ALL SELECT 'random', shopper, o.product, z.discount
        FROM optimal o JOIN random_slots z USING (shopper, coupon)
        UNION ALL SELECT 'optimal', shopper, product, discount FROM optimal""",
    "members": "SELECT week, shopper, product, count(*) AS n FROM baskets GROUP BY ALL",
    "edges": """
        SELECT a.product AS member_1, b.product AS member_2, CAST(sum(a.n * b.n) AS BIGINT) AS n
        FROM members a JOIN members b ON a.week = b.week AND a.shopper = b.shopper GROUP BY ALL""",
    "cat_members": "SELECT week, shopper, product // 10 AS cat, count(*) AS n FROM baskets GROUP BY ALL",
    "cat_edges": """
        SELECT a.cat AS member_1, b.cat AS member_2, CAST(sum(a.n * b.n) AS BIGINT) AS n
        FROM cat_members a JOIN cat_members b ON a.week = b.week AND a.shopper = b.shopper GROUP BY ALL""",
    "clip": """
        SELECT sum(n) FILTER (member_1 <> member_2) / CAST(count(DISTINCT member_1) ** 2 AS DOUBLE) AS m
        FROM edges""",
    "basket_keys": """
        SELECT week, shopper, row_number() OVER (ORDER BY week, shopper) - 1 AS basket
        FROM (SELECT DISTINCT week, shopper FROM baskets)""",
}


def _statement(select: str, kind: str = "AS") -> str:
    """The select preceded by the views it needs."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        found = [v for v in VIEWS if v in words and v not in needed]
        needed.update(found)
        todo.extend(VIEWS[v] for v in found)
    views = ",\n".join(f"{name} {kind} ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    return f"WITH {views}\n{select}" if views else select


def _policy_totals(placed: str) -> str:
    """Each policy overlaid on all test rows and summed directly."""
    return f"""
        SELECT q.policy, round(sum(coalesce(r.probability, 5e-1) * t.price * (1e0 - coalesce(c.discount, 0e0))), 4)
               AS total_revenue
        FROM test t CROSS JOIN (SELECT unnest(['zero', 'random', 'optimal']) AS policy) q
        LEFT JOIN {placed} c
          ON c.policy = q.policy AND c.shopper = t.shopper AND c.product = t.product
        LEFT JOIN scorer r ON r.product = t.product
          AND r.percent = round(coalesce(c.discount, 0e0) * 100, 6)
        GROUP BY q.policy"""


_MODEL = "SELECT * FROM model"
_PIVOT = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (member_2 = {k}), 0) AS BIGINT) AS with_{k}" for k in range(100)
)

SELECTS = {
    "scan_baskets": "SELECT * FROM baskets",
    "scan_coupons": "SELECT * FROM coupons",
    "duplicate_keys": """
        SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem
        GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
    "cached_dataset": """
        SELECT d.*, coalesce(n_purchased, 0) AS n_purchased, coalesce(n_received, 0) AS n_received,
               coalesce(n_redeemed, 0) AS n_redeemed
        FROM dataset d LEFT JOIN lists USING (shopper, product)""",
    "coupon_sink_roundtrip": "SELECT * FROM optimal",
    "profile_min_max": """
        SELECT unnest(['week', 'shopper', 'product', 'price']) AS column_name,
               unnest([min(week)::DOUBLE, min(shopper)::DOUBLE, min(product)::DOUBLE, min(price)]) AS min_value,
               unnest([max(week)::DOUBLE, max(shopper)::DOUBLE, max(product)::DOUBLE, max(price)]) AS max_value
        FROM baskets""",
    "narrow_types": """
        SELECT week::TINYINT AS week, shopper::TINYINT AS shopper, product::TINYINT AS product,
               price::FLOAT AS price FROM baskets""",
    "narrow_on_read": """
        SELECT week::TINYINT AS week, shopper::TINYINT AS shopper, product::TINYINT AS product,
               price::FLOAT AS price FROM baskets""",
    "filter_shoppers": "SELECT * FROM baskets WHERE shopper < (SELECT s // 2 FROM size)",
    "baskets_coupons": "SELECT * FROM joined",
    "clean": "SELECT * FROM facts",
    "grid_facts": "SELECT * FROM panel",
    "histories": """
        SELECT week, shopper, product, week_hist, discount_received_weeks, discount_redeemed_weeks
        FROM grid LEFT JOIN lists USING (shopper, product)""",
    "week_hist": "SELECT shopper, product, week_hist, n_purchased AS n FROM lists WHERE n_purchased > 0",
    "received_weeks": """
        SELECT shopper, product, discount_received_weeks, n_received AS n FROM lists WHERE n_received > 0""",
    "redeemed_weeks": """
        SELECT shopper, product, discount_redeemed_weeks, n_redeemed AS n FROM lists WHERE n_redeemed > 0""",
    "pair_totals": "SELECT shopper, product, n_purchased, n_received, n_redeemed FROM lists",
    "mode_price": "SELECT * FROM mode_prices",
    "last_week_mode_price": "SELECT * FROM last_prices",
    "impute_price": "SELECT * FROM dataset",
    "product_category": "SELECT * FROM categorised",
    "cat_cluster": """
        SELECT c.product_cat, week, shopper, product, price, cat_cluster
        FROM categorised c JOIN clusters USING (product_cat)""",
    "cluster_dummies": """
        SELECT c.product_cat, week, shopper, product, price, CAST(cat_cluster = 0 AS INT) AS cluster_0,
               CAST(cat_cluster = 1 AS INT) AS cluster_1, CAST(cat_cluster = 2 AS INT) AS cluster_2
        FROM categorised c JOIN clusters USING (product_cat)""",
    "substitute_discount": "SELECT * FROM substitutes",
    "recency_default": "SELECT CAST(ceil(max(week) * 115e-2) AS INT) AS recency_default FROM panel",
    "weeks_since_purchase": "SELECT week, shopper, product, weeks_since_last_purchase FROM time_features",
    "trend_1": "SELECT week, shopper, product, trend_1 FROM time_features",
    "trend_3": "SELECT week, shopper, product, trend_3 FROM time_features",
    "trend_5": "SELECT week, shopper, product, trend_5 FROM time_features",
    "product_freq": "SELECT week, shopper, product, product_freq FROM time_features",
    "sp_redemption_rate": "SELECT week, shopper, product, shopper_product_redemption_rate FROM time_features",
    "discount_buy": "SELECT week, shopper, product, discount_buy FROM time_features",
    "redemption_rate": """
        SELECT product, sum(purchased) / CAST(count(*) AS DOUBLE) AS redemption_rate
        FROM facts WHERE week < 86 AND discount > 0 GROUP BY product""",
    "customer_redemption_rate": """
        SELECT shopper, product, sum(purchased) / CAST(count(*) AS DOUBLE) AS customer_redemption_rate
        FROM facts WHERE week < 86 AND discount > 0 GROUP BY shopper, product""",
    "coupon_rates_discount_buy": """
        SELECT shopper, product, count(*) FILTER (discount > 0) / CAST(count(*) AS DOUBLE) AS discount_buy
        FROM facts WHERE week < 86 GROUP BY shopper, product""",
    "shopper_redemption": "SELECT * FROM shopper_rates",
    "product_redemption": "SELECT * FROM product_rates",
    "redemption_features": """
        SELECT d.week, d.shopper, d.product, shopper_redemption_rate, product_redemption_rate
        FROM dataset d LEFT JOIN shopper_rates s ON s.shopper = d.shopper
        LEFT JOIN product_rates p ON p.product = d.product""",
    "weekly_elasticity": """
        SELECT product, week + 1 AS week, (dr - reg) / nullif(3e-1 * reg, 0) AS elast FROM (
          SELECT w.week, CAST(p AS INT) AS product,
                 count(j.week) FILTER (coalesce(j.discount, 0) = 0)
                   / nullif(CAST((SELECT s FROM size) - count(j.week) FILTER (j.discount > 0) AS DOUBLE), 0) AS reg,
                 count(j.week) FILTER (j.discount = 30 AND coalesce(j.price, 0) <> 0)
                   / nullif(CAST(count(j.week) FILTER (j.discount = 30) AS DOUBLE), 0) AS dr
          FROM (SELECT DISTINCT week FROM joined WHERE week BETWEEN 85 AND 90) w
          CROSS JOIN range(100) r(p)
          LEFT JOIN joined j ON j.week = w.week AND j.product = p
          GROUP BY w.week, p)""",
    "product_elasticity": "SELECT * FROM elasticity",
    "elasticity_feature": """
        SELECT d.week, d.shopper, d.product, elasticities
        FROM dataset d LEFT JOIN elasticity e ON e.product = d.product""",
    "model_data": _MODEL,
    "train_split": _MODEL + " WHERE week BETWEEN 86 AND 89",
    "test_split": _MODEL + " WHERE week = 90",
    "feature_columns": """
        SELECT m.* EXCLUDE (shopper, week, product, purchased, product_cat),
               round(shopper_WOE, 9) AS shopper_WOE, round(product_WOE, 9) AS product_WOE
        FROM model m LEFT JOIN woe_s USING (shopper) LEFT JOIN woe_p w ON w.product = m.product""",
    "woe_shopper": """
        SELECT week, shopper, product, purchased, round(coalesce(shopper_WOE, 0e0), 9) AS shopper_WOE
        FROM dataset LEFT JOIN woe_s USING (shopper)""",
    "woe_product": """
        SELECT week, shopper, product, purchased, round(coalesce(product_WOE, 0e0), 9) AS product_WOE
        FROM dataset LEFT JOIN woe_p USING (product)""",
    "purchase_rates": "SELECT * FROM scorer",
    "log_loss": """
        SELECT round(avg(-(purchased * ln(probability) + (1 - purchased) * ln(1e0 - probability))), 9) AS log_loss
        FROM train t JOIN scorer r
          ON r.product = t.product AND r.percent = round(t.discount * 100, 6)""",
    "scenarios": "SELECT * FROM what_if",
    "delta_revenue": """
        SELECT week, shopper, product, price, product_cat, discount, probability, exp_revenue,
               CASE WHEN discount <> 0 THEN exp_revenue - max(CASE WHEN discount = 0 THEN exp_revenue END)
                 OVER (PARTITION BY shopper, product) END AS delta_revenue
        FROM scored""",
    "top_coupons": "SELECT * FROM optimal",
    "random_coupons": "SELECT * FROM random_slots",
    "zero_coupons": "SELECT * FROM zero_slots",
    "expected_total_revenue": f"SELECT total_revenue FROM ({_policy_totals('placed')}) WHERE policy = 'optimal'",
    "policy_comparison": _policy_totals("placed"),
    "policy_comparison_same_products": _policy_totals("same_placed"),
    "basket_id": "SELECT week, shopper, product, price, basket FROM baskets JOIN basket_keys USING (week, shopper)",
    "basket_lists": """
        SELECT week, shopper, CAST(0 AS BIGINT) AS part, string_agg(product, ',' ORDER BY product) AS items
        FROM baskets GROUP BY week, shopper""",
    "max_basket_size": """
        SELECT max(n) AS max_basket_size FROM (SELECT count(*) AS n FROM baskets GROUP BY week, shopper)""",
    "cooccurrence": "SELECT * FROM edges",
    "cooccurrence_pivot": f"SELECT member_1, {_PIVOT} FROM edges GROUP BY member_1",
    "cooccurrence_blocks": """
        SELECT m.member_1, CAST(m.member_2 // 32 * 32 AS INT) AS first,
               string_agg(CAST(coalesce(e.n, 0) AS VARCHAR), ',' ORDER BY m.member_2) AS counts
        FROM (SELECT member_1, CAST(k AS INT) AS member_2
              FROM (SELECT DISTINCT member_1 FROM edges), range(100) members(k)) m
        LEFT JOIN edges e ON e.member_1 = m.member_1 AND e.member_2 = m.member_2
        GROUP BY m.member_1, m.member_2 // 32""",
    "category_cooccurrence": "SELECT * FROM cat_edges",
    "cooccurrence_clipped": """
        SELECT member_1, member_2,
               CASE WHEN member_1 = member_2 THEN (SELECT m FROM clip) ELSE CAST(n AS DOUBLE) END AS n,
               1e0 - CASE WHEN member_1 = member_2 THEN (SELECT m FROM clip) ELSE CAST(n AS DOUBLE) END AS distance
        FROM edges""",
}


# Statements whose views are to be computed once and as they stand.
MATERIALISED = {"redemption_features", "elasticity_feature", "delta_revenue"}


def statements() -> dict[str, str]:
    return {
        name: _statement(select.strip(), "AS MATERIALIZED" if name in MATERIALISED else "AS")
        for name, select in SELECTS.items()
    }
