"""Hard negatives against brute force, with hot labels, repeated rows, nulls and wide numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.hard_negatives import hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string, rank int"


def brute(rows, is_anchor, k=5, low=80, high=100, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v], str(c)) for i, v, c in rows
          if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b))))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, v, c in ok:
        if a is None or not is_anchor(a):
            continue
        others = [(i, dot(v, w), d) for i, w, d in ok if i != a]
        for p, ps, _ in sorted((o for o in others if o[2] == c), key=order)[:k]:
            fits = [o for o in others if o[2] != c and low * ps <= 100 * o[1] <= high * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (n, ns, _) in enumerate(sorted(fits, key=order)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, "z", "z", 0) for i, v, c in rows], SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


def clustered(rng, n, d=8, labels=4):
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, .3) for c in centre[rng.randrange(3)]], 0 if rng.random() < .4 else rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("unit_rows,unit_anchors", [(16384, 1024), (17, 5)])
def test_equals_brute_force(spark, unit_rows, unit_anchors):
    rng = random.Random(3)
    rows = clustered(rng, 240)
    rows += rows[:6] + [(7, rows[20][1], 1)] * 5  # repeated ids and vectors, ties
    rows += [(1000, None, 1), (1010, [1.0] * 8, None), (1020, [1.0, None] * 4, 1), (1030, [math.nan] * 8, 1), (1040, [math.inf] * 8, 2),
             (None, rows[0][1], 0), (None, rows[0][1], 3), (1050, [], 1), (1060, [2.0, 1.0], 2), (1070, rows[30][1] + [9.0], 2)]
    want = brute(rows, lambda i: i % 10 == 0)
    got = run(spark, rows, unit_rows=unit_rows, unit_anchors=unit_anchors)
    assert len(want) > 200 and got == want


def test_wide_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [c * 3e6 for c in v], l) for i, v, l in clustered(rng, 60)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    huge = [(i, [c * 1e30 for c in v], l) for i, v, l in clustered(rng, 40)]
    assert run(spark, huge) == brute(huge, lambda i: i % 10 == 0)  # scores at the ends of 64 bits


def test_one_label_or_no_rows(spark):
    rng = random.Random(6)
    assert run(spark, [(i, v, 1) for i, v, _ in clustered(rng, 30)]) == []
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0], 1)]) == []


def test_products_of_fields():
    rng = np.random.default_rng(1)
    for span in (3, 200, 30000, 1 << 27, 1 << 40):
        a, r = rng.integers(-span, span, (7, 5)), rng.integers(-span // 2, span * 2, (33, 5))
        want = a.astype(object) @ r.astype(object).T
        want = np.clip(want, -2 ** 63, 2 ** 63 - 1)
        assert (products(a, r).astype(object) == want).all()
