"""Mixing sources to target weights: budgets flow down a domain-language-source tree, in DataFrame functions only.

A node's budget is split among its children by weight. A child that cannot use its share, all epochs
counted, takes what it has, and its siblings share the rest by weight; as no node gets more than its
subtree holds, shortages are met among siblings before they reach an ancestor. A leaf then takes whole
epochs, and of one more epoch, in the order of a seeded hash, the longest prefix its budget allows.

Prefixes are cut without sorting a leaf: token sums over 256 hash bins find the bin of the cut, sums
over 256 bins inside it find a finer one, and only the rows of that one are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

LEVELS = ("domain", "lang", "source")
#: White-space words of a text, the token count of mixing.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_domain(source: Column, domains: int = 4) -> Column:
    """The domain of a numbered source: its number modulo ``domains``; a source without a number is 'other'."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.coalesce(F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % domains).cast("string"))), F.lit("other"))


def weight_of(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(weights.get("*", 1))
    for k, v in weights.items():
        if k != "*":
            out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def split_budget(children: DataFrame, parents: Sequence[str], name: str, weights: Mapping[str, int]) -> DataFrame:
    """Adds budget to ``children`` (capacity, parent_budget): shares by weight, no child above its capacity.

    In the order of capacity by weight, a child is full while its share of what is left covers its capacity.
    """
    w = Window.partitionBy(*parents)
    order = w.orderBy(F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(F.col("capacity") / F.col("weight")), F.col(name))
    filled = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = wide(filled) * wide(F.col("weight")) + wide(F.col("capacity")) * wide(left) <= wide(F.col("parent_budget")) * wide(F.col("weight"))
    return (
        children.withColumn("weight", weight_of(F.col(name), weights))
        .withColumn("capacity", F.when(F.col("weight") == 0, F.lit(0)).otherwise(F.col("capacity")).cast("long"))
        .withColumn("full", full)
        .withColumn("rest", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(w), F.lit(0)))
        .withColumn("rest_weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(w), F.lit(1)))
        .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(wide(F.col("rest")) * wide(F.col("weight")) / F.col("rest_weight"))).cast("long"))
        .drop("weight", "full", "rest", "rest_weight", "parent_budget")
    )


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """LEVELS, tokens and budget of each leaf. ``leaves``: LEVELS and tokens."""
    held = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    level = held.groupBy("domain").agg(F.sum("capacity").alias("capacity")).crossJoin(total)  # one row
    # the root's budget, at most what it holds
    level = level.withColumn("parent_budget", F.least(F.floor(F.col("t") * F.lit(share)), F.col("t") * max_epochs).cast("long")).drop("t")
    level = split_budget(level.withColumn("root", F.lit(0)), ["root"], "domain", weights.get("domain", {})).drop("root")
    for i in (1, 2):
        above = list(LEVELS[:i])
        below = held.groupBy(*LEVELS[: i + 1]).agg(F.sum("capacity").alias("capacity"))
        level = split_budget(below.join(level.select(*above, F.col("budget").alias("parent_budget")), above), above, LEVELS[i], weights.get(LEVELS[i], {}))
    return level.select(*LEVELS, "budget").join(leaves, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", token_col: str = "n_tokens") -> DataFrame:
    """The rows of ``docs`` a mixture takes, with epoch (0 and up): a row for each epoch that takes it.

    An input column named epoch is replaced. ``docs`` needs LEVELS, ``id_col`` and ``token_col``; null levels form a source of their own ('') and null token
    counts are 0. ``share`` is the mixture's part of all tokens, ``weights`` maps level names to whole weights by node
    ('*' for others, 1 if absent). Rows without tokens are taken with the prefix they fall in; a leaf without tokens is
    not taken. Ties of the hash are broken by id and tokens; repeated rows are taken one by one. Budgets are whole
    tokens; prefixes never pass them.
    """
    if "epoch" in docs.columns:
        docs = docs.drop("epoch")
    keys = [f"__mix_{x}" for x in LEVELS]
    for k, x in zip(keys, LEVELS, strict=True):
        docs = docs.withColumn(k, F.coalesce(F.col(x).cast("string"), F.lit("")))
    docs = docs.withColumn("__mix_tokens", F.coalesce(F.col(token_col).cast("long"), F.lit(0))).withColumn("__mix_id", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    narrow = save(docs.select(*keys, "__mix_tokens", "__mix_id"), "mix-rows")
    leaves = narrow.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, LEVELS, strict=True)]).agg(F.sum("__mix_tokens").alias("tokens"))
    plan = leaf_budgets(save(leaves, "mix-leaves"), weights, share, max_epochs)
    plan = plan.select(
        *[F.col(x).alias(k) for k, x in zip(keys, LEVELS, strict=True)],
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("__mix_whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("__mix_left"), (F.col("tokens") > 0).alias("__mix_any"),
    )
    plan = save(plan, "mix-plan")  # a small table of known size: Spark broadcasts it only below its threshold

    def hashed(df: DataFrame, plan: DataFrame) -> DataFrame:
        df = df.join(plan, keys).withColumn("__mix_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col("__mix_whole"), F.col("__mix_id"))))
        for i in (0, 1):
            df = df.withColumn(f"__mix_bin{i}", F.conv(F.substring("__mix_hash", 1 + 2 * i, 2), 16, 10).cast("int"))
        return df

    for i in (0, 1):  # the bin of the cut, then the finer bin inside it
        rows = hashed(narrow, plan)
        if i:
            rows = rows.where("__mix_bin0 = __mix_cut0")
        kept = [c for c in plan.columns if c not in keys]
        sums = rows.groupBy(*keys, f"__mix_bin{i}").agg(F.sum("__mix_tokens").alias("__mix_sum"), *[F.first(c).alias(c) for c in kept])
        upto = F.sum("__mix_sum").over(Window.partitionBy(*keys).orderBy(f"__mix_bin{i}"))
        cut = sums.withColumn("__mix_upto", upto).where("__mix_upto > __mix_left").groupBy(*keys).agg(F.min_by(F.struct(f"__mix_bin{i}",
            (F.col("__mix_upto") - F.col("__mix_sum")).alias("before")), f"__mix_bin{i}").alias("c"))
        cut = cut.select(*keys, F.col(f"c.__mix_bin{i}").alias(f"__mix_cut{i}"), F.col("c.before").alias("__mix_before"))
        plan = plan.join(cut, keys, "left").withColumn("__mix_left", F.col("__mix_left") - F.coalesce("__mix_before", F.lit(0))).drop("__mix_before")
        plan = save(plan, f"mix-cut{i}")
    rows = hashed(docs, plan).where("__mix_any")
    place = lambda i: F.signum(F.col(f"__mix_bin{i}") - F.coalesce(F.col(f"__mix_cut{i}"), F.lit(256))).cast("int")
    rows = rows.withColumn("__mix_place", F.when(place(0) != 0, place(0)).otherwise(place(1)))
    clear = rows.where("__mix_place <> 0").withColumn("__mix_times", F.col("__mix_whole") + (F.col("__mix_place") < 0).cast("long"))
    order = Window.partitionBy(*keys).orderBy("__mix_hash", "__mix_id", "__mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.where("__mix_place = 0").withColumn("__mix_times", F.col("__mix_whole") + (F.sum("__mix_tokens").over(order) <= F.col("__mix_left")).cast("long"))
    taken = clear.unionByName(inside).where("__mix_times > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("__mix_times") - 1).cast("int")))).select(*[f"`{c}`" for c in docs.columns if not c.startswith("__mix_")], "epoch")
