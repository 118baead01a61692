"""Sharding by a keyed permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0 to N-1 in the order of their columns (range shuffle, counts per range, numbers inside a range).
A Feistel network over Z_a x Z_b with a = ceil(sqrt(N)) and b = ceil(N / a) permutes 0 to a*b-1: rounds add a keyed hash of one
half to the other half. Fewer than a values are outside 0 to N-1; from there the permutation is applied again (cycle walking), so
N rows are permuted among themselves. ``shard = p mod n`` and ``slot = p div n``: counts differ by at most one, slots have no gaps,
and place and row can be computed from each other without a table.

Defined results: a null text has size 1 and a null checksum; equal rows are counted before they are shuffled and get consecutive numbers,
so a row that repeats for a third of the table meets in no single task; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.words import stage

ROUNDS, SEED, WALKS = 8, 20240131, 12


def _hash(x: Column, j: int, seed: int) -> Column:
    """52 bits of a keyed digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(j)), x.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permute(df: DataFrame, col: str, n: int, out: str, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """Add ``out``: the place of row number ``col`` (0 to n-1) under the permutation of n numbers.

    More than WALKS steps outside the range have a chance below ``n ** (-WALKS / 2)``; they raise an error, never a wrong place.
    """
    if n <= 0:
        return df.withColumn(out, F.lit(None).cast("long"))
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    df = df.withColumn("__x", F.col(col))
    for _ in range(min(WALKS, a * b - n + 1)):
        first = df.withColumn("__l", F.col("__x") % a).withColumn("__r", F.expr(f"__x div {a}"))
        for j in range(rounds):
            first = (first.withColumn("__l", (F.col("__l") + _hash(F.col("__r"), j, seed)) % a) if j % 2 == 0 else
                     first.withColumn("__r", (F.col("__r") + _hash(F.col("__l"), j, seed)) % b))
        step = F.col("__r") * a + F.col("__l")
        done = F.col("__done") if "__done" in df.columns else F.lit(False)
        df = first.withColumn("__x", F.when(done, F.col("__x")).otherwise(step)).withColumn("__done", F.col("__x") < n).drop("__l", "__r")
    place = F.when(F.col("__done"), F.col("__x")).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    return df.withColumn(out, place).drop("__x", "__done")


def number_rows(df: DataFrame, out: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0 to N-1 in the order of all columns (nulls first), and N."""
    cols = df.columns
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__m"))
    ranged = stage(rows.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.sum("__m").alias("__n"))
    # one row per range: as many as shuffle partitions
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    inside = Window.partitionBy("__p").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranged.withColumn("__upto", F.sum("__m").over(inside)).join(before.select("__p", "__before"), "__p")
              .withColumn("__from", F.col("__before") + F.col("__upto") - F.col("__m")))
    numbered = placed.withColumn(out, F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__m") - 1)))
    return numbered.select(*cols, out), total


def feistel_shards(df: DataFrame, n_shards: int = 16, seed: int = SEED) -> DataFrame:
    """``df`` with the columns row_number, place, shard and slot. Pass the columns that identify and describe rows, not texts."""
    numbered, total = number_rows(df)
    return (permute(numbered, "row_number", total, "place", seed)
            .withColumn("shard", (F.col("place") % n_shards).cast("int")).withColumn("slot", F.expr(f"place div {n_shards}")))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identity, size and checksum of documents, computed where they are read."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
