"""Retail coupon targeting and basket affinity as Spark DataFrame jobs."""

from couponloom.params import Params

__all__ = ["Params"]
