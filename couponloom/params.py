"""Parameters of the coupon pipeline."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

# Digits to which percents are compared.
PERCENT_DIGITS = 6
# Cluster label of each category, list position = category.
CATEGORY_CLUSTERS = (
    1, 1, 2, 2, 0, 1, 0, 2, 2, 2, 0, 2, 2, 2, 2, 1, 2, 1, 2, 0, 2, 1, 2, 1, 2,
)


# The defaults of the task.
@dataclass(frozen=True)
class Params:
    test_week: int = 90
    n_shoppers: int = 2000
    n_products: int = 250
    train_window: int = 4
    trend_windows: tuple[int, ...] = (1, 3, 5)
    n_coupons: int = 5
    discounts: tuple[float, ...] = (0.15, 0.2, 0.25, 0.3)
    category_size: int = 10
    category_clusters: tuple[int, ...] = CATEGORY_CLUSTERS
    total_baskets: int = 100_000
    price_scale: int = 2
    recency_factor: float = 1.15
    elasticity_discount: float = 0.3
    # Shopper and product redemption rates count every week by default, the
    # test week included; True counts the weeks before the test week only.
    redemption_before_test_week: bool = False
    seed: int = 42

    @property
    def start_week(self) -> int:
        return self.test_week - self.train_window

    @property
    def train_weeks(self) -> list[int]:
        return list(range(self.start_week, self.test_week))

    @property
    def panel_weeks(self) -> list[int]:
        return self.train_weeks + [self.test_week]

    @property
    def n_categories(self) -> int:
        """Categories that product ids are binned into."""
        return self.n_products // self.category_size

    @property
    def model_products(self) -> int:
        """Products with a category and a cluster; the others leave the model data."""
        return min(self.n_categories, len(self.category_clusters)) * self.category_size

    @property
    def recency_default(self) -> int:
        """Weeks since last purchase for a pair without an earlier purchase."""
        return math.ceil(self.test_week * self.recency_factor)

    @property
    def percents(self) -> list[float]:
        return [percent(d) for d in self.discounts]

    def fingerprint(self, *more: str) -> str:
        text = json.dumps([asdict(self), list(more)], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def percent(discount: float) -> float:
    return round(discount * 100, PERCENT_DIGITS)
