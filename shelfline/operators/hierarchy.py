"""The twelve roll-up levels of the retail hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The grouping keys of the twelve levels; the first level is the grand total.
LEVELS: list[tuple[str, ...]] = [
    (),
    ("state_id",),
    ("store_id",),
    ("cat_id",),
    ("dept_id",),
    ("item_id",),
    ("state_id", "cat_id"),
    ("state_id", "dept_id"),
    ("store_id", "cat_id"),
    ("store_id", "dept_id"),
    ("item_id", "state_id"),
    ("item_id", "store_id"),
]

KEYS = ["state_id", "store_id", "cat_id", "dept_id", "item_id"]


def level_name(keys: Sequence[str]) -> str:
    return ";".join(keys) if keys else "all_id"


def node_label(keys: Sequence[str]) -> Column:
    return F.concat_ws("--", *keys) if keys else F.lit("all")


def roll_up(leaves: DataFrame, sums: Mapping[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """Sum ``sums`` over every level: (level, node, *by, *sums).

    One pass: the rows are expanded to the grouping sets and summed map-side before the
    shuffle, so even the grand total moves one row per task and ``by`` value. Levels are
    told apart by the grouping id, so a null key stays an ordinary member.
    """
    sets = [[*keys, *by] for keys in LEVELS]
    columns = [*KEYS, *by]
    grouped = leaves.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping_id().alias("_gid"), *[F.sum(c).alias(name) for name, c in sums.items()])
    level, node = F.lit(None).cast("string"), F.lit(None).cast("string")
    for keys in LEVELS:
        present = set(keys) | set(by)
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in present)
        hit = F.col("_gid") == gid
        level = F.when(hit, level_name(keys)).otherwise(level)
        node = F.when(hit, node_label(keys)).otherwise(node)
    return out.select(level.alias("level"), node.alias("node"), *by, *sums)


def membership(products: DataFrame, leaf: str = "id") -> DataFrame:
    """One row per (level, node, leaf)."""
    nodes = [F.struct(F.lit(level_name(k)).alias("level"), node_label(k).alias("node")) for k in LEVELS]
    return products.select(leaf, F.explode(F.array(*nodes)).alias("n")).select("n.level", "n.node", leaf)
