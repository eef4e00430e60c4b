"""Order inside groups of any size: a group is cut into parts of its order column, and parts are worked on by themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a part, in the order column's unit.
SPAN = 4096


def in_parts(rows: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """Adds __part: where a row lies in its group's order, a whole number that grows with it."""
    return rows.withColumn("__part", F.floor(F.col(order) / span).cast("long"))


#: A key of this many rows is hot, and so is one of a thousandth of all rows; hot keys are at most a thousand of the most frequent.
HOT_ROWS, HOT_KEYS = 1_000_000, 1_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``: one row for each key, with how many of ``rows`` have it in column n, which is dropped.

    Hot keys are joined by broadcast, so their rows stay where they are; they are HOT_KEYS at most, the most frequent
    ones, whatever the input. Null keys meet nothing.
    """
    total = keyed.agg(F.sum("n").alias("__total"))
    bound = F.least(F.lit(HOT_ROWS), F.greatest(F.col("__total") / HOT_KEYS, F.lit(2)))
    known = keyed.dropna(subset=list(keys))
    hot = known.crossJoin(F.broadcast(total)).where(F.col("n") >= bound).orderBy(F.desc("n"), *keys).limit(HOT_KEYS)  # one row
    few = F.broadcast(hot.drop("n", "__total"))
    marks = F.broadcast(hot.select(*keys))
    cold = known.join(marks, list(keys), "left_anti").drop("n")
    return rows.join(few, list(keys)).unionByName(rows.join(marks, list(keys), "left_anti").join(cold, list(keys)))


def ranked(rows: DataFrame, group: str, order: str, span: int = SPAN, then: Sequence[str] = ()) -> DataFrame:
    """Adds __rn (from 1, in order within ``group``, rows of one order by the columns of ``then``) and __n (rows of the group). Null groups form a group."""
    rows = in_parts(rows, order, span)
    counts = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__in"))
    w = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__in").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__g", "__p", before.alias("__before"), F.sum("__in").over(w).alias("__n"))
    local = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order, *then))
    joined = rows.withColumn("__rn", local).join(counts, F.col(group).eqNullSafe(F.col("__g")) & F.col("__part").eqNullSafe(F.col("__p")))
    return joined.withColumn("__rn", F.col("__rn") + F.col("__before")).drop("__g", "__p", "__part", "__before")


def running_count(rows: DataFrame, group: str, order: str, flag: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: how many rows up to this one, itself included, have ``flag``."""
    rows = in_parts(rows.withColumn("__flag", flag.cast("long")), order, span)
    counts = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.sum("__flag").alias("__in"))
    before = F.coalesce(F.sum("__in").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__g", "__p", before.alias("__before"))
    local = F.sum("__flag").over(Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn(name, local).join(counts, F.col(group).eqNullSafe(F.col("__g")) & F.col("__part").eqNullSafe(F.col("__p")))
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("__before")).drop("__flag", "__g", "__p", "__part", "__before")


def previous(rows: DataFrame, group: str, order: str, column: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: ``column`` of the row before in the group's order, null for the first.

    A part's first row takes it from the last row of the part before; one row for each part travels for that.
    """
    rows = in_parts(rows, order, span)
    ends = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.min(order).alias("__first"), F.max_by(column, order).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy("__g").orderBy("__p")))
    local = F.lag(column).over(Window.partitionBy(group, "__part").orderBy(order))
    joined = rows.withColumn(name, local).join(ends, F.col(group).eqNullSafe(F.col("__g")) & F.col("__part").eqNullSafe(F.col("__p")))
    return joined.withColumn(name, F.when(F.col(order) == F.col("__first"), F.col("__end")).otherwise(F.col(name))).drop("__g", "__p", "__part", "__first", "__end")


def previous_two(rows: DataFrame, group: str, order: str, column: str, names: tuple[str, str], span: int = SPAN) -> DataFrame:
    """Adds ``names``: ``column`` of the row before and of the one before that in the group's order, null where there is none.

    The last two values of a part, or of the part before too where it has one row, are carried over its end; a row for
    each part travels for that.
    """
    rows = in_parts(rows, order, span)
    w = Window.partitionBy(group, "__part").orderBy(order)
    rows = rows.withColumn("__at", F.row_number().over(w)).withColumn("__l1", F.lag(column).over(w)).withColumn("__l2", F.lag(column, 2).over(w))
    ends = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(
        F.count("*").alias("__n"), F.max_by(F.struct(F.col(column).alias("last"), F.col("__l1").alias("before")), "__at").alias("__end")
    )
    over = Window.partitionBy("__g").orderBy("__p")
    carried = F.when(F.lag("__n").over(over) > 1, F.lag("__end.before").over(over)).otherwise(F.lag("__end.last", 2).over(over))
    ends = ends.select("__g", "__p", F.lag("__end.last").over(over).alias("__c1"), carried.alias("__c2"))
    joined = rows.join(ends, F.col(group).eqNullSafe(F.col("__g")) & F.col("__part").eqNullSafe(F.col("__p")))
    first, second = F.col("__at") == 1, F.col("__at") == 2
    joined = joined.withColumn(names[0], F.when(first, F.col("__c1")).otherwise(F.col("__l1")))
    joined = joined.withColumn(names[1], F.when(first, F.col("__c2")).when(second, F.col("__c1")).otherwise(F.col("__l2")))
    return joined.drop("__g", "__p", "__part", "__at", "__l1", "__l2", "__c1", "__c2")


def means_in_order(rows: DataFrame, group: str, order: str, values: Mapping[str, Column], span: int = SPAN) -> DataFrame:
    """``group`` and each named mean of doubles, null without a value: added one by one in the group's order, so its last places do not depend on tasks.

    A part is added up by itself, then sums of parts in the parts' order. Null groups form a group.
    """
    total = lambda c, by, at: F.sum(c).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    columns = [f"{f}_{k}" for k in values for f in ("__sum", "__n")]
    given = [x for k, c in values.items() for x in (c.cast("double").alias(f"__sum_{k}"), F.when(c.isNotNull(), 1.0).otherwise(0.0).alias(f"__n_{k}"))]
    rows = in_parts(rows, order, span).select(group, order, "__part", *given)
    rows = rows.select(group, "__part", *[total(c, (group, "__part"), order).alias(c) for c in columns])
    each = rows.groupBy(group, "__part").agg(*[F.max(c).alias(c) for c in columns])
    each = each.select(group, *[total(c, (group,), "__part").alias(c) for c in columns])
    each = each.groupBy(group).agg(*[F.max(c).alias(c) for c in columns])
    return each.select(group, *[F.try_divide(f"__sum_{k}", f"__n_{k}").alias(k) for k in values])
