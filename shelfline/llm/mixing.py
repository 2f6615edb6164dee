"""Mixing sources to target weights by hierarchical budgets.

Sources are the leaves of a tree: domain, language, source. A budget of tokens goes down the
tree. Each node shares it among its children in proportion to their weights, but gives no child
more than it can use (all its tokens, as many epochs as allowed): what a child cannot use goes
to its siblings, and only what all of them cannot use is missing at the node itself, where its
own siblings take it. So shortages stay as low in the tree as they can. The level at which a
node's children are filled comes from running sums over the children by capacity per weight.

A leaf's budget is read as whole epochs and a prefix of the next one. Every epoch has its own
order (a hash of seed, epoch and key). The place where the prefix ends is found from totals of
4,096 hash ranges per leaf; only the rows of the one range in which it ends are put in order.
Documents are counted once, and what is shuffled is a few numbers per document; the totals are
summed up before they are shuffled, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.lineage import stage

#: Levels of the tree, from the root.
LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def count_words(text: str) -> Column:
    """Words between white space; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def first_words(text: str, take: str, have: str) -> Column:
    """The first ``take`` words of ``text`` with a space between, or the text as it is where these are all ``have`` of them."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), " ")
    return F.when(F.col(take) < F.col(have), cut).otherwise(F.col(text))


def source_domain(source: str, domains: int = 4) -> Column:
    """A domain name for sources that have none of their own: one of ``domains``, by md5 of the source."""
    return F.concat(F.lit("domain"), F.conv(F.substring(F.md5(F.coalesce(F.col(source), F.lit(NONE))), 1, 4), 16, 10).cast("int") % domains)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out: Column = F.lit(1).cast("bigint")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("bigint")).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """``leaves`` (the levels and tokens) with the column budget.

    ``weights`` maps a level to whole weights by name, 1 where none is given; a weight of 0
    gives nothing. ``budget`` is an aggregate over the leaves. Budgets are rounded down.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    parents: list[str] = []
    above, root = caps, caps.agg(F.least(budget, F.sum("cap")).cast("bigint")).first()[0]
    for level in LEVELS:
        path = [*parents, level]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.join(above, parents) if parents else nodes.withColumn("share", F.lit(root).cast("bigint"))
        node = Window.partitionBy(*parents)
        by = node.orderBy((F.col("w") == 0).cast("int"), F.col("cap") / F.greatest("w", F.lit(1)), level)
        before = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        behind = F.sum("w").over(node) - F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = nodes.withColumn("at", F.row_number().over(by)).withColumn("fill", F.when(F.col("w") > 0, (F.col("share") - before) / behind))
        # Children in order are full up to the first whose share is less than it can use.
        open_ = F.when((F.col("w") > 0) & (F.col("fill") * F.col("w") < F.col("cap")), F.struct("at", "fill"))
        nodes = nodes.withColumn("level", F.min(open_).over(node))
        full = F.col("level").isNull() | (F.col("at") < F.col("level.at"))
        share = F.when(F.col("w") == 0, F.lit(0)).when(full, F.col("cap")).otherwise(F.floor(F.col("level.fill") * F.col("w")))
        above = nodes.select(*path, share.cast("bigint").alias("share"))
        parents = path
    return leaves.join(above.withColumnRenamed("share", "budget"), list(LEVELS))


def _ordered(seed: int, epoch: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(epoch), F.coalesce(F.col("key").cast("string"), F.lit(NONE))))


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    domain: Column | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """A row per document and epoch in which it is used: key, domain, lang, source, epoch, n_tokens, take_tokens.

    With ``keep_text`` the text follows, cut behind its first ``take_tokens`` tokens where they are not all.

    The budget is ``share`` of all tokens (words between white space), rounded down. An epoch
    but the last of a leaf takes whole documents; the last takes the prefix of its order that
    the budget still pays, so one document may give only its first ``take_tokens`` tokens. A
    document is in the prefix if the tokens before it are fewer than what is left.

    Null names of domain, language or source are "(none)", null texts have no tokens. Rows with
    equal keys are rows like others (ties in the order are settled by their number of tokens). Documents without
    tokens count in whole epochs and, in the prefix, where they stand. Other columns are not
    read. An empty table gives no rows; a leaf without tokens has no budget and gives none.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    domain = source_domain("source") if domain is None else domain
    columns = [F.col(key).alias("key"), F.coalesce(domain, F.lit(NONE)).alias("domain"), named("lang").alias("lang"), named("source").alias("source"), count_words(text).alias("n_tokens")]
    if keep_text:
        # The rows are written once with a number; counts are planned with, and texts join the plan at its end.
        docs = stage(docs.select(*columns, F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "mixing-texts")
        rows = docs.drop("text")
    else:
        rows = stage(docs.select(*columns), "mixing-counts")
    marks = ["row"] if keep_text else []
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    leaves = leaf_budgets(leaves, F.floor(F.sum("tokens") * F.lit(share)), weights or {}, max_epochs)
    leaves = leaves.withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    leaves = stage(leaves.where("budget > 0"), "mixing-leaves")

    placed = rows.join(leaves, list(LEVELS)).withColumn("last", F.col("full") + 1)
    placed = placed.withColumn("order", _ordered(seed, "last")).withColumn("range", F.substring("order", 1, 3))
    totals = placed.where("rest > 0").groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("sum"))
    # At most 4,096 rows of a leaf.
    so_far = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("sum").over(so_far), F.lit(0))).where("before < rest")
    totals = totals.select(*LEVELS, "range", "before", (F.col("before") + F.col("sum") > F.col("rest")).alias("ends"))
    front = placed.join(totals, [*LEVELS, "range"])
    columns = [F.col("key").alias(key), *LEVELS, F.col("last").cast("bigint").alias("epoch"), "n_tokens", *marks]
    whole = front.where("NOT ends").select(*columns, F.col("n_tokens").alias("take_tokens"))
    inside = Window.partitionBy(*LEVELS).orderBy("order", "n_tokens", "key").rowsBetween(Window.unboundedPreceding, -1)
    edge = front.where("ends").withColumn("paid", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.where("paid < rest").select(*columns, F.least("n_tokens", F.col("rest") - F.col("paid")).alias("take_tokens"))
    epochs = placed.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))))
    epochs = epochs.select(F.col("key").alias(key), *LEVELS, "epoch", "n_tokens", *marks, F.col("n_tokens").alias("take_tokens"))
    out = whole.unionByName(edge).unionByName(epochs)
    if not keep_text:
        return out
    return out.join(docs.select("row", "text"), "row").drop("row").withColumn("text", first_words("text", "take_tokens", "n_tokens"))
