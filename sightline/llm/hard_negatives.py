"""Hard negatives by exact integer products, several candidates to one wide multiplication.

Vectors become integer vectors (``floor(scale * x)``). Inside a unit of work (some anchors, some rows) the components of K rows are
biased to be non-negative and put into K separated fields of one wide integer per dimension. An anchor's biased component multiplies that
integer once, the products of all dimensions are added, and the fields, wide enough for the largest possible sum, are cut out again; taking
the biases back gives K exact scores. Wide integers are 64-bit where two fields or more fit, else Python's.

Spark deals the work: anchors and rows are spread evenly (not by value) over a grid of units of bounded size, each row meets the anchors in
units of ROWS rows and ANCHORS anchors, and every unit keeps at most the asked number of rows per anchor. The first pass finds positives (rows of an
anchor's label: the grid is cut by label, a frequent label is only more units), the second negatives, with the limits that positives set.

Defined results: a row with a null label or vector, or a null, non-finite or not representable component, takes no part; vectors of other length
are as if padded with zeros (an empty vector scores 0); a row of the anchor's own id is never its partner, so repeated rows are partners of
others, each counted, and a repeated anchor is answered once per row; a null id comes last among ties and is no anchor unless ``is_anchor`` is
true for it; scores outside 64 bits count as the nearest 64-bit number; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.words import stage

ROWS, ANCHORS = 16384, 1024
BIG_FIELDS = 16  # rows to one Python integer
TILE_A, TILE_R = 32, 2048
LOW64, HIGH64 = -(1 << 63), (1 << 63) - 1

PARTNER = "rank int, id long, score long"
ANSWER = "anchor_no long, anchor_id long, pos int, id long, score long"


def integers(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of ``floor(scale * x)``, whether a row takes part); short vectors are padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    valid = ~np.asarray(vectors.is_null())
    flat = vectors.flatten()  # leaves out what null lists may hide
    size = np.where(valid, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    row = np.repeat(np.arange(n), size)
    missing = np.asarray(flat.is_null())
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.asarray(flat.fill_null(0), np.float64) * scale)
    bad = missing | ~np.isfinite(x)
    valid[row[bad]] = False
    x = np.where(bad, 0.0, x)
    exact = np.abs(x).max(initial=0.0) < 2.0 ** 53
    out = np.zeros((n, int(size.max(initial=0))), np.int64 if exact else object)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, column] = x.astype(np.int64) if exact else [int(v) for v in x]
    return out, valid


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of every anchor with every row, exact; fields of one wide integer hold several rows."""
    d = max(anchors.shape[1], rows.shape[1])
    if not d or not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    a, r = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (anchors, rows))
    a_low, r_low = int(a.min()), int(r.min())
    a_high, r_high = int(a.max()) - a_low, int(r.max()) - r_low
    bits = max(1, (a_high * r_high * d).bit_length())
    fields, kind = (64 // bits, np.uint64) if 64 // bits >= 2 else (BIG_FIELDS, object)
    fields = min(fields, len(rows))
    # every total below, biases included, has to fit the type the scores are made in
    plain = np.int64 if (max(abs(a_low), a_high + abs(a_low)) * max(abs(r_low), r_high + abs(r_low)) * d * 4) < HIGH64 and kind is np.uint64 else object
    a_up, r_up = (a - a_low).astype(kind), (r - r_low).astype(kind)
    n = -(-len(rows) // fields)
    padded = np.zeros((n * fields, d), kind)
    padded[:len(rows)] = r_up
    shift = [kind(k * bits) if kind is np.uint64 else k * bits for k in range(fields)]
    wide = padded[0::fields].copy()
    for k in range(1, fields):
        wide |= padded[k::fields] << shift[k]
    wide = np.ascontiguousarray(wide.T)
    mask = kind((1 << bits) - 1) if kind is np.uint64 else (1 << bits) - 1
    out = np.zeros((len(a), n * fields), plain)
    for i in range(0, len(a), TILE_A):
        left = np.ascontiguousarray(a_up[i:i + TILE_A].T)
        for j in range(0, n, TILE_R):
            some = wide[:, j:j + TILE_R]
            total = left[0][:, None] * some[0][None, :]
            step = np.empty_like(total)
            for c in range(1, d):
                np.multiply(left[c][:, None], some[c][None, :], out=step)
                total += step
            for k in range(fields):
                out[i:i + TILE_A, j * fields + k:(j + some.shape[1]) * fields:fields] = (total >> shift[k]) & mask
    a_sum, r_sum = a_up.astype(plain).sum(axis=1), r.astype(plain).sum(axis=1)
    out = out[:, :len(rows)] + (r_low * a_sum)[:, None] + (a_low * r_sum)[None, :]
    if plain is object:
        out = np.clip(out, LOW64, HIGH64)
        out = np.array([[int(v) for v in line] for line in out], object).astype(np.int64).reshape(out.shape)
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; earlier places first among equal ones."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= floor)
    else:
        among = np.arange(len(scores))
    return among[np.argsort(-scores[among].astype(object) if len(among) and scores[among].min() == LOW64 else -scores[among], kind="stable")][:k]


def by_id(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending")])  # nulls last


def column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = table.column(name).combine_chunks()
    return np.asarray(c.fill_null(0)), np.asarray(c.is_null())


def answers(parts: list[tuple]) -> pa.RecordBatch:
    """One batch of ANSWER rows from (anchor_no, anchor_id, pos, ids, id nulls, scores) each."""
    size = [len(p[3]) for p in parts]
    join = lambda k, t: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t)
    own = pa.array([p[1] for p in parts], pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat([p[0] for p in parts], size).astype(np.int64)), own.take(pa.array(np.repeat(np.arange(len(parts)), size))),
        pa.array(np.repeat([p[2] for p in parts], size).astype(np.int32)),
        pa.array(join(3, np.int64), mask=join(4, bool)), pa.array(join(5, np.int64))], names=["anchor_no", "anchor_id", "pos", "id", "score"])


def unit(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = np.asarray(table.column("is_anchor").combine_chunks())
    return table.filter(pa.array(side)), by_id(table.filter(pa.array(~side)))


def positives_of(k: int):
    """One unit of one label: the k best rows of each anchor that have another id."""
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = unit(table)
        if not len(anchors) or not len(rows):
            return pa.Table.from_batches([answers([])])
        scores = products(integers(anchors.column("x"), 1.0)[0], integers(rows.column("x"), 1.0)[0])
        ids, missing = column(rows, "id")
        own, own_missing = column(anchors, "id")
        number = np.asarray(anchors.column("anchor_no").combine_chunks())
        parts = []
        for i in range(len(anchors)):
            others = np.flatnonzero(missing | (ids != own[i])) if not own_missing[i] else np.flatnonzero(~missing)
            at = others[best(scores[i][others], k)]
            parts.append((number[i], None if own_missing[i] else int(own[i]), 0, ids[at], missing[at], scores[i][at]))
        return pa.Table.from_batches([answers(parts)])
    return run


def negatives_of(k: int, low: int, high: int, per: int):
    """One unit: for each anchor and positive the k best rows of another label whose score lies within the positive's limits."""
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = unit(table)
        if not len(anchors) or not len(rows):
            return pa.Table.from_batches([answers([])])
        scores = products(integers(anchors.column("x"), 1.0)[0], integers(rows.column("x"), 1.0)[0])
        ids, missing = column(rows, "id")
        own, own_missing = column(anchors, "id")
        number = np.asarray(anchors.column("anchor_no").combine_chunks())
        codes = {v: c for c, v in enumerate(set(anchors.column("label").to_pylist()) | set(rows.column("label").to_pylist()))}
        a_label = np.array([codes[v] for v in anchors.column("label").to_pylist()])
        r_label = np.array([codes[v] for v in rows.column("label").to_pylist()])
        parts = []
        for i, positives in enumerate(anchors.column("positives").to_pylist()):
            limits = [(p["rank"], -(-low * p["score"] // per), high * p["score"] // per) for p in positives]
            clip = lambda v: min(max(v, LOW64), HIGH64)
            least, most = clip(min(x[1] for x in limits)), clip(max(x[2] for x in limits))
            near = np.flatnonzero((scores[i] >= least) & (scores[i] <= most) & (r_label != a_label[i]))
            for rank, lowest, highest in limits:
                if lowest > highest:
                    continue
                some = near[(scores[i][near] >= clip(lowest)) & (scores[i][near] <= clip(highest))]
                at = some[best(scores[i][some], k)]
                parts.append((number[i], None if own_missing[i] else int(own[i]), rank, ids[at], missing[at], scores[i][at]))
        return pa.Table.from_batches([answers(parts)])
    return run


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label: Column, is_anchor: Column, scale: float) -> DataFrame:
    """(id, label, anchor, x): rows that take part; x holds whole numbers as doubles."""
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                           F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("x"))
    asked = asked.where("label IS NOT NULL AND x IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3)
            flat, size = x.flatten(), np.asarray(x.value_lengths())
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(np.asarray(flat.fill_null(np.nan), np.float64) * scale)
            keep = np.ones(len(b), bool)
            keep[np.repeat(np.arange(len(b)), size)[~np.isfinite(whole)]] = False
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(whole))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], names=["id", "label", "anchor", "x"]).filter(pa.array(keep))

    return asked.mapInArrow(run, "id long, label string, anchor boolean, x array<double>")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   per: int = 100, unit_rows: int = ROWS, unit_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``is_anchor`` holds.

    A negative of another label is kept if ``low * positive_score <= per * negative_score <= high * positive_score``.
    """
    rows = quantised(vectors, id_col, vec_col, F.col(label_col) if label is None else label, is_anchor, scale)
    rows = stage(rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())))  # fixed, so a repeated task deals alike
    anchors = stage(rows.where("anchor").select(F.monotonically_increasing_id().alias("anchor_no"), "id", "label", "x"))
    # one row per label of an anchor: how many units its rows and anchors make
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / unit_rows).alias("slots"), F.ceil(F.count_if("anchor") / unit_anchors).alias("groups"))
    total = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    slots, groups = max(1, -(-total["n"] // unit_rows)), max(1, -(-total["a"] // unit_anchors))
    no_list = F.lit(None).cast(f"array<struct<{', '.join(c.replace(' ', ':') for c in PARTNER.split(', '))}>>")
    cols = ["slot", "group", "is_anchor", "anchor_no", "id", "label", "x", "positives"]

    def meet(some_rows: DataFrame, some_anchors: DataFrame, keys: list[str], fn) -> DataFrame:
        """Rows and anchors brought together in the units of the grid; slots and groups are spread evenly, whatever the rows hold."""
        r = (some_rows.withColumn("slot", F.expr("pmod(place, slots)"))
             .withColumn("group", F.explode(F.expr("sequence(0L, groups - 1L)")))
             .select("slot", "group", F.lit(False).alias("is_anchor"), F.lit(None).cast("long").alias("anchor_no"), "id", "label", "x", no_list.alias("positives")))
        a = (some_anchors.withColumn("group", F.expr("pmod(anchor_no, groups)"))
             .withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1L)")))
             .select("slot", "group", F.lit(True).alias("is_anchor"), "anchor_no", "id", "label", "x", F.col("positives") if "positives" in some_anchors.columns else no_list.alias("positives")))
        return r.unionByName(a).select(*cols).groupBy(*keys).applyInArrow(fn, ANSWER)

    sizes = sizes.where("groups > 0")
    first = meet(rows.join(sizes, "label"), anchors.join(sizes, "label"),
                 ["label", "slot", "group"], positives_of(positives))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_no").orderBy(*order))).where(F.col("rank") <= positives)
    found = stage(ranked.select("anchor_no", "rank", "id", "score"))
    lists = found.groupBy("anchor_no").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    counts = {"slots": F.lit(slots).cast("long"), "groups": F.lit(groups).cast("long")}
    second = meet(rows.withColumns(counts), anchors.join(lists, "anchor_no").withColumns(counts), ["slot", "group"],
                  negatives_of(negatives, low, high, per))
    taken = second.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_no", "pos").orderBy(*order))).where(F.col("rank") <= negatives)
    named = found.select("anchor_no", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (taken.join(named, ["anchor_no", "pos"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
