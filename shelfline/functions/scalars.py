"""Small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null instead of an error or infinity when b is 0."""
    return F.try_divide(a, b)


def recode(x: Column, mapping: dict) -> Column:
    """Replace by a small literal mapping; anything else becomes null."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), x)


def price_bin(price: Column) -> Column:
    """Six fixed price bands; a missing price is band 0."""
    # Upper bounds of the bands and their codes.
    return (
        F.when(price <= 0.80, 6)
        .when(price <= 1, 5)
        .when(price <= 10, 4)
        .when(price <= 20, 2)
        .when(price <= 40, 3)
        .when(price > 40, 1)
        .otherwise(0)
    )


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A repeatable pseudo-random non-negative whole number from md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
