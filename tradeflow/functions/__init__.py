from .scalar import (
    binary_decimal,
    bucket_start,
    exact_total,
    interval,
    interval_seconds,
    iso_text,
    price_cents,
    round_price,
    same_clock,
)

__all__ = [
    "binary_decimal",
    "bucket_start",
    "exact_total",
    "interval",
    "interval_seconds",
    "iso_text",
    "price_cents",
    "round_price",
    "same_clock",
]
