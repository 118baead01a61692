"""Overlapping ranges flattened into disjoint segments, and points looked up by one ordered pass.

Ranges and points lie on a line of fixed-width hexadecimal keys (one line per ``space``). A sweep with a stack of the ranges that are open
turns ranges into markers: from this key on, that range wins. Ranges are swept in blocks of the line, a range that spans blocks being part of
each, so no task holds all of them. Points and markers are then dealt by slots of the line; inside a slot the last marker before a point is its
range, and what a slot inherits comes from a table with one row per slot. Neither a range that covers everything nor a crowded part of the line
makes a hot key.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

# executors need no copy of the package: the sweep travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLOSE, MARK, POINT = 0, 1, 2


def sweep(table: pa.Table, block_digits: Callable[[int], int]) -> pa.Table:
    """Markers of one block. Rows: space, block, first, last (hex keys), rank (the smallest wins) and other columns, taken along.

    ``pos`` of a marker is where it begins; ``row`` tells whether a range wins there or none does.
    """
    space, block = table.column("space")[0].as_py(), table.column("block")[0].as_py()
    first, last, rank = (table.column(c).to_pylist() for c in ("first", "last", "rank"))
    width = len(first[0])
    size = 16 ** (width - block_digits(space))
    begin = int(block, 16) * size
    end = begin + size - 1
    lo, hi = [max(int(x, 16), begin) for x in first], [min(int(x, 16), end) for x in last]
    order = sorted((i for i in range(len(lo)) if lo[i] <= hi[i]), key=lambda i: lo[i])
    cuts = sorted({begin, *(lo[i] for i in order), *(hi[i] + 1 for i in order if hi[i] < end)})
    # open ranges as a heap by rank; those that have ended are removed when they come to the top
    at, open_, pos, row = 0, [], [], []
    for cut in cuts:
        while at < len(order) and lo[order[at]] <= cut:
            heapq.heappush(open_, (rank[order[at]], order[at]))
            at += 1
        while open_ and hi[open_[0][1]] < cut:
            heapq.heappop(open_)
        best = open_[0][1] if open_ else None
        if not row or row[-1] != best:
            pos.append(cut)
            row.append(best)
    kind = [MARK] * len(pos)
    if end + 1 < 16 ** width:  # nothing of this block reaches the next one
        pos.append(end + 1)
        row.append(None)
        kind.append(CLOSE)
    taken = table.drop_columns(["space", "block", "first", "last", "rank"]).take(pa.array(row, pa.int64()))
    n = len(pos)
    out = pa.table({"space": pa.array([space] * n, pa.int32()), "pos": [f"{p:0{width}x}" for p in pos], "kind": pa.array(kind, pa.int32()),
                    "found": [r is not None for r in row]})
    for name in taken.column_names:
        out = out.append_column(name, taken.column(name))
    return out


def markers(ranges: DataFrame, blocks: Column, block_digits: dict[int, int]) -> DataFrame:
    """``ranges``: space, first, last, rank, other columns. ``blocks``: array of the block names (leading digits) a range lies in."""
    others = [c for c in ranges.columns if c not in ("space", "first", "last", "rank")]
    dealt = ranges.withColumn("block", F.explode(blocks)).select(F.col("space").cast("int"), "block", "first", "last", "rank", *others)
    kinds = dict(dealt.dtypes)
    schema = ", ".join(["space int", "pos string", "kind int", "found boolean", *(f"`{c}` {kinds[c]}" for c in others)])

    def run(table):
        return sweep(table, lambda s: block_digits[s])
    return dealt.groupBy("space", "block").applyInArrow(run, schema)


def looked_up(points: DataFrame, marks: DataFrame, slot_digits: dict[int, int]) -> DataFrame:
    """``points`` (space, pos and other columns; each row once) with the columns of the range that wins there, as struct ``won`` (NULL: none)."""
    carried = [c for c in marks.columns if c not in ("space", "pos", "kind", "found")]
    own = [c for c in points.columns if c not in ("space", "pos")]
    digits = F.lit(None).cast("int")
    for s, d in slot_digits.items():
        digits = F.when(F.col("space") == s, d).otherwise(digits)
    m = marks.select("space", "pos", "kind", F.struct("found", *carried).alias("mark"), *[F.lit(None).alias(f"__p_{c}") for c in own])
    kind = m.schema["mark"].dataType
    p = points.select(F.col("space").cast("int"), "pos", F.lit(POINT).alias("kind"), F.lit(None).cast(kind).alias("mark"), *[F.col(c).alias(f"__p_{c}") for c in own])
    line = m.select(*[m[c] if not c.startswith("__p_") else F.lit(None).cast(dict(p.dtypes)[c]).alias(c) for c in p.columns]).unionByName(p)
    # dealt once: both uses below read this exchange, so they have to ask for the same columns
    line = line.withColumn("slot", F.left("pos", digits)).repartition("space", "slot")
    inside = Window.partitionBy("space", "slot").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = line.withColumn("mark", F.last("mark", ignorenulls=True).over(inside)).where(F.col("kind") == POINT)
    # what each slot inherits: the last marker of the slots before it
    every = [F.count(f"__p_{c}").alias(f"__n_{c}") for c in own]
    ends = line.groupBy("space", "slot").agg(F.max_by("mark", F.when(F.col("kind") != POINT, F.struct("pos", "kind"))).alias("last"), *every)
    for c in own:
        ends = ends.where(F.col(f"__n_{c}") >= 0)
    before = Window.partitionBy("space").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select("space", "slot", F.last("last", ignorenulls=True).over(before).alias("carry"))
    out = filled.join(inherited, ["space", "slot"], "left").withColumn("mark", F.coalesce("mark", "carry"))
    won = F.when(F.col("mark.found"), F.struct(*[F.col(f"mark.{c}").alias(c) for c in carried]))
    return out.select("space", "pos", *[F.col(f"__p_{c}").alias(c) for c in own], won.alias("won"))
