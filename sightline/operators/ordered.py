"""Ordered functions in two levels: inside a slot of the order, then over one summary row per slot.

Rows are dealt by (key, slot), a slot being a fixed width of the first order column, so neither a key with most of the rows nor a global
order is ever sorted in one task, and the slot of a row is known without looking at any other row: no counting and no quantiles before the query.
What crosses a slot's edge is an associative summary (the last record, a sum), scanned over one row per (key, slot).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SECONDS = 600  # width of a slot of a time
NUMBERS = 1_000_000  # width of a slot of a number


def slot_of(df: DataFrame, col: str, width: float | None = None) -> Column:
    """Number of the slot of a value: seconds of a time, units of a number."""
    if dict(df.dtypes)[col] == "timestamp":
        return F.floor(F.unix_micros(F.col(col)) / F.lit((width or SECONDS) * 1e6))
    return F.floor(F.col(col) / F.lit(width or NUMBERS))


def _dealt(df: DataFrame, keys: Sequence[str], col: str, width: float | None) -> DataFrame:
    """With __key (the keys as one value, so that null keys are keys too) and __slot."""
    key = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({"__key": key, "__slot": slot_of(df, col, width)})


ACROSS = ("__key", "__slot")


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], defaults: dict[str, Column] | None = None,
           width: float | None = None) -> DataFrame:
    """The previous row's values per key in ``order``; ``values`` maps a new name to its source column.

    Only the first row of a slot looks across: it takes the last record of the slot before that has any.
    """
    defaults = defaults or {}
    cut = _dealt(df, keys, order[0], width)
    inside = Window.partitionBy(*ACROSS).orderBy(*order)
    rec = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rows = cut.withColumn("__prev", F.lag(rec).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    tails = cut.groupBy(*ACROSS).agg(F.max_by(rec, F.struct(*order)).alias("__tail"))
    carry = tails.select(*ACROSS, F.lag("__tail").over(Window.partitionBy("__key").orderBy("__slot")).alias("__carry"))
    out = rows.join(carry, list(ACROSS), "left")
    for new in values:
        before = F.when(F.col("__first"), F.col("__carry")[new]).otherwise(F.col("__prev")[new])
        seen = ~F.col("__first") | F.col("__carry").isNotNull()
        out = out.withColumn(new, F.when(seen, before).otherwise(defaults.get(new, F.lit(None))))
    return out.drop(*ACROSS, "__prev", "__first", "__carry")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], peers: bool = False,
            width: float | None = None) -> DataFrame:
    """Inclusive running sums per key; with ``peers`` rows that tie on the (single) order column all see the sum including every tie."""
    cut = _dealt(df, keys, order[0], width).withColumns({f"__v{i}": e for i, e in enumerate(sums.values())})
    totals = cut.groupBy(*ACROSS).agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    before = Window.partitionBy("__key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*ACROSS, *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__c{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*ACROSS).orderBy(*order)
    inside = (inside.rangeBetween if peers else inside.rowsBetween)(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(f"__v{i}").over(inside) for i, n in enumerate(sums)}).join(carry, list(ACROSS), "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__c{i}"), F.lit(0)) for i, n in enumerate(sums)})
    return out.drop(*ACROSS, *[f"__v{i}" for i in range(len(sums))], *[f"__c{i}" for i in range(len(sums))])


def row_at(df: DataFrame, order: Sequence[str], k: int, width: float | None = None) -> DataFrame:
    """The row at zero-based position ``k``: counts per slot say which slot holds it, and only that one is ranked."""
    cut = df.withColumn("__slot", slot_of(df, order[0], width))
    counts = cut.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    target = (counts.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0)))
              .where((F.col("__skip") <= k) & (F.col("__skip") + F.col("__n") > k)).select("__slot", "__skip"))
    inside = Window.partitionBy("__slot").orderBy(*order)
    return (cut.join(target, "__slot").withColumn("__at", F.row_number().over(inside) - 1 + F.col("__skip"))
            .where(F.col("__at") == k).drop("__slot", "__skip", "__at"))
