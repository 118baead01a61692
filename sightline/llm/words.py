"""Words of many texts at once, as NumPy offsets into one byte buffer.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. All separators are one byte
in UTF-8, so words can be found on bytes. Batches are walked in pieces of a few megabytes (one long
text is a piece of its own), which bounds the memory of a task whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
PRIME = np.uint64(0x9E3779B185EBCA87)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    return mix(a * PRIME + b)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, the first being 1."""
    out = np.full(max(n, 1), PRIME, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for each pair; ``buf`` needs eight bytes more than the last end."""
    blocks = np.ndarray((len(buf) - 7,), np.dtype("<u8"), buffer=buf, strides=(1,))
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + PRIME)
    live, at = np.arange(len(start)), start.astype(np.int64)
    left = size
    while True:
        go = left > 0
        if not go.all():
            live, at, left = live[go], at[go], left[go]
        if not len(live):
            return out
        out[live] = pair(out[live], blocks[at] & MASKS[np.minimum(left, 8)])
        at, left = at + 8, left - 8


class Piece:
    """Some consecutive texts of a batch: their bytes and their words.

    ``rows``: slice of the batch. ``off``: first byte of each text and the end. ``ws``, ``we``: bytes
    where words begin and end. ``first``: first word of each text and their number. ``owner``: text of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, rows: slice, lower: bool, separator: np.ndarray = SEPARATOR):
        self.rows, self.off, self.n = rows, off - off[0], len(off) - 1
        self.raw = np.zeros(len(data) + 8, np.uint8)
        self.raw[:len(data)] = data
        self.buf = LOWER[self.raw] if lower else self.raw
        self.size = len(data)
        ink = ~separator[self.raw[:self.size]]
        self.ink = ink
        begins, ends = ink.copy(), np.zeros(self.size + 1, bool)
        begins[1:] &= ~ink[:-1]
        ends[1:] = ink
        ends[:-1] &= ~ink
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < self.size)]  # a text's end ends its word too
        begins[inner] = ink[inner]
        ends[inner] = ink[inner - 1]
        self.ws, self.we = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.ws, self.off)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        return span_hash(self.buf if buf is None else buf, self.ws, self.we)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words_per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of each text."""
        total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]


def pieces(texts: pa.Array | pa.ChunkedArray, lower: bool = True, piece_bytes: int = PIECE_BYTES,
           separator: np.ndarray = SEPARATOR) -> Iterator[Piece]:
    """Walk a column of texts; a null counts as an empty text. ``separator``: which bytes (ASCII only) part words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + piece_bytes, "right")) - 1))
        yield Piece(data[off[i]:off[j]], off[i:j + 1], slice(i, j), lower, separator)
        i = j


def shingles(h: np.ndarray, piece: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, and the index of its first word."""
    at = np.arange(len(h))
    at = at[at + k <= piece.first[1:][piece.owner]] if len(h) else at
    out = h[at]
    for i in range(1, k):
        out = pair(out, h[at + i])
    return out, at


def folder(spark) -> None:
    """Have a checkpoint folder: the session's own, or a scratch one where none is set (one machine only)."""
    from sightline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)


def stage(df):
    """Cut the lineage through the shared checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_by_row(df):
    """As :func:`stage`, for rows of many megabytes: Python functions get them one by one, so neither side of a task holds a batch of them."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")
    try:
        return stage(df)
    finally:
        conf.set(name, before)


def dealt(df, key: str):
    """Cut the lineage with the rows dealt and sorted by ``key``; later joins and groups by it leave them where they are.

    A checkpoint keeps the partitioning of a plan that is not adaptive, so this one job is planned without.
    """
    folder(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).checkpoint(eager=True)
    finally:
        conf.set(name, before)


def written(df):
    """Write to a folder of its own under the shared checkpoint folder, and read from there."""
    import uuid
    folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_names(df, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_null_safe(left, right, keys: list[str], how: str = "left"):
    """Join on keys where a null equals a null; the right side's keys are dropped."""
    import pyspark.sql.functions as F
    from functools import reduce
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    out = left.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])
