"""Personal data: exact spans against Python's patterns, added spans on planted cases, no Python in the plan."""

import random
import re

from pyspark.sql import functions as F

from sightline.llm.personal_data import FEATURES, KINDS, personal_spans, redact, train

SCHEMA = "doc_id long, text string, kind string, start long, row string"


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    for kind, pattern, ok in rules:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m.group())]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 7, "r") for i, t in enumerate(texts)], SCHEMA)


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@m-1.example.com", "a@b", "@b.c", "a@b.c.d_e@f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "+1 (555) 123-4567", "+49.30.1234567",
             "+1", "+12 34", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "é", "日本", "😀", " ", " ", "\n", ".", "-", "(", ")", "+", "5", "77", "x", ",", "[", "@"]
    texts = [None, "", " ", "+", "1", "((((", "1" * 30000, "a" * 30000 + "@", "a@b." * 3000, "+1 ( " * 4000, "1.1.1.1 " * 3000, "( " * 20000, "a at b dot c " * 500,
             card(rng), " ".join(card(rng) for _ in range(3)), f"+1{card(rng)}"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += texts[20:24]
    got = redact(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_spans == ",".join(want), texts[r.doc_id][:200]
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in KINDS]


def test_boosted_spans_are_added_and_clean_rows_left_alone(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta kilo lima".split())
    phone = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    order = lambda: str(rng.randrange(10 ** 9, 10 ** 10))
    texts = [f"{word()} call +1 {phone()} {word()}" for _ in range(700)] + [f"{word()} order {order()} {word()} +1 {phone()}" for _ in range(600)]
    added = [f"{word()} {word()} call {phone()} {word()}" for _ in range(30)]
    clean = [f"{word()} order {order()} {word()} page {rng.randrange(500)}, {rng.randrange(1900, 2030)}" for _ in range(100)]
    spans = personal_spans(frame(spark, texts + added + clean)).where("kind IS NOT NULL").collect()
    extra = [r for r in spans if not r.base]
    at = range(len(texts), len(texts) + len(added))
    assert {r.doc_id for r in extra} == set(at) and len(extra) == len(added)
    for r in extra:
        text = added[r.doc_id - len(texts)]
        assert KINDS[r.kind] == "phone" and re.fullmatch(r"\(?\d{3}\) \d{3}-\d{4}", text[r.start:r.end]) and r.probability > 0.5
    by_row = {}
    for r in spans:
        by_row.setdefault(r.row, []).append((r.start, r.end))
    assert all(a[1] <= b[0] for v in by_row.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_empty_tables_and_native_plan(spark):
    assert redact(frame(spark, [])).count() == 0
    out = redact(frame(spark, [None, "", "nothing", None]))
    assert {(r.base_spans, r.spans) for r in out.collect()} == {("", "")} and out.count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    twice = frame(spark, ["a@b.c"]).select(F.lit(None).cast("long").alias("doc_id"), "text").unionAll(spark.createDataFrame([(None, "a@b.c")], "doc_id long, text string"))
    assert [r.spans for r in redact(twice).collect()] == ["email:0:5"] * 2


def test_trees_and_thresholds_use_every_candidate(spark):
    """One candidate in 150 is positive: the held-out ones are too few for a threshold unless all candidates count."""
    made = {f: "0" for f in FEATURES} | {"digits": "9 + int(label)", "groups": "int(id % 7)"}
    found = (spark.range(24_000).selectExpr("id AS row", "id AS doc_id", "3 AS kind", "false AS base", "id % 30 AS start", "id % 30 + 9 AS end", "int(id % 150 = 0) AS label", "id")
             .selectExpr("*", *[f"CAST({e} AS TINYINT) AS f_{f}" for f, e in made.items()]))
    score, cutoff = train(found)
    assert list(cutoff) == [3]
    marked = found.selectExpr("label", f"{score} >= {cutoff[3]!r}D AS above").groupBy("label", "above").count().collect()
    assert {(r["label"], r["above"]): r["count"] for r in marked} == {(1, True): 160, (0, False): 23_840}
    assert train(found.repartition(7)) == (score, cutoff)
