"""Bounded-space online packing of documents into token sequences.

Each partition keeps at most OPEN windows. A document's full windows are sequences of their own; its rest goes into the open window
where it leaves the least room; if it fits none and all windows are open, the fullest is emitted. Windows still open when a
partition ends are merged in rounds: FAN_IN partitions' leftovers are packed by one task in the same way, until one group is left,
so no task sees more than FAN_IN * OPEN windows.

Defined results: a null or empty text is one piece holding the end id alone; rows that repeat are packed each; a text of any length is cut at
full windows; an empty table gives no rows. Sequences end padded to ``length``; the padding itself is not stored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sightline.llm.words import pieces, stage

LENGTH, OPEN, FAN_IN, END_ID = 2048, 128, 64, 1
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "is_open boolean, part long, fill long")


class Windows:
    """At most ``limit`` open windows; ``place`` returns (window, offset) and the window emitted to make room, if any."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.next = length, limit, 0
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted

    def place(self, size: int) -> tuple[int, int, tuple[int, int] | None]:
        closed = None
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                left, window = self.room.pop(0)
                closed = (window, self.length - left)
            left, window = self.length, self.next
            self.next += 1
        offset = self.length - left
        if left > size:
            insort(self.room, (left - size, window))
        return window, offset, closed


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, end_id: int = END_ID,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces and their places. With ``with_ids`` each piece carries its token ids (little-endian, four bytes each)."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sightline.llm.bpe import units
        enc, part = units(tokenizer), TaskContext.get().partitionId()
        windows, fill, whole = Windows(length, open_windows), {}, 0
        held: dict[int, list[tuple]] = {}  # pieces of open windows
        names = [c.split()[0] for c in schema.split(", ")]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            kinds = {"is_open": pa.bool_(), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols)], names=names)

        for batch in batches:
            ids_of = batch.column("doc_id")
            for p in pieces(batch.column("text"), lower=False):
                ids, first = enc.encode(p)
                out, docs_here = [], ids_of.slice(p.rows.start, p.n).to_pylist()
                for i in range(p.n):
                    own = np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), length):
                        cut = own[start:start + length].tobytes()
                        size = len(cut) // 4
                        row = (docs_here[i], start, size, zlib.crc32(cut), len(own))
                        more = (cut,) if with_ids else ()
                        if size == length:
                            out.append((*row, (part << 33) | (1 << 32) | whole, 0, False, part, length, *more))
                            whole += 1
                            continue
                        window, offset, closed = windows.place(size)
                        held.setdefault(window, []).append((row, offset, more))
                        fill[window] = offset + size
                        if closed or fill[window] == length:
                            for w in {closed[0]} if closed else set():
                                out += [(*r, (part << 33) | w, o, False, part, fill[w], *m) for r, o, m in held.pop(w)]
                                fill.pop(w)
                            if fill[window] == length:
                                out += [(*r, (part << 33) | window, o, False, part, length, *m) for r, o, m in held.pop(window)]
                                fill.pop(window)
                yield rows(out)
        yield rows([(*r, (part << 33) | w, o, True, part, fill[w], *m) for w, got in held.items() for r, o, m in got])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # written once: places depend on the order in which a task met its rows
    placed = stage(src.mapInArrow(place, schema))
    extra = ["ids"] if with_ids else []
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *extra]
    left = merge_leftovers(placed.where("is_open").groupBy("sequence_id").agg(F.max("part").alias("part"), F.max("fill").alias("fill")), length, open_windows)
    moved = (placed.where("is_open").join(left, "sequence_id")
             .withColumn("offset", F.col("offset") + F.col("base")).drop("sequence_id").withColumnRenamed("into", "sequence_id"))
    return placed.where("NOT is_open").select(*columns).unionByName(moved.select(*columns))


def merge_leftovers(open_: DataFrame, length: int, open_windows: int) -> DataFrame:
    """(sequence_id, into, base): the sequence and offset where each leftover window goes."""
    schema = "sequence_id long, into long, base long, fill long, part long, closed boolean"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "into"], ascending=[False, True])
        windows, target, out = Windows(length, open_windows), {}, []
        fill: dict[int, int] = {}
        closed_windows: set[int] = set()
        for seq, size in zip(frame["into"].tolist(), frame["fill"].tolist()):
            w, offset, closed = windows.place(size)
            target.setdefault(w, seq)
            fill[w] = offset + size
            if closed:
                closed_windows.add(closed[0])
            out.append((seq, w, offset))
        return pd.DataFrame([(s, target[w], o, fill[w], w in closed_windows or fill[w] == length) for s, w, o in out],
                            columns=["sequence_id", "into", "base", "fill", "closed"]).assign(part=int(frame["part"].min()) // FAN_IN)[
            ["sequence_id", "into", "base", "fill", "part", "closed"]]

    mapping = open_.select("sequence_id", F.col("sequence_id").alias("into"), F.lit(0).cast("long").alias("base"))
    live = open_.select(F.col("sequence_id").alias("into"), "fill", "part")
    highest = open_.agg(F.max("part")).first()[0]
    if highest is None:
        return mapping
    while True:
        step = stage(live.withColumn("g", F.expr(f"part div {FAN_IN}")).groupBy("g").applyInPandas(merge, schema))
        hop = step.select(F.col("sequence_id").alias("into"), F.col("into").alias("__into"), F.col("base").alias("__base"))
        mapping = (mapping.join(hop, "into", "left")
                   .select("sequence_id", F.coalesce("__into", "into").alias("into"), (F.col("base") + F.coalesce("__base", F.lit(0))).alias("base")))
        highest //= FAN_IN
        if highest == 0:
            return mapping
        live = step.where("NOT closed").groupBy("into").agg(F.max("fill").alias("fill"), F.max("part").alias("part"))
