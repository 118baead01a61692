"""Confidence against worked examples, and two properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.operators import score

NOW = "2024-01-31 00:00:00"
DDL = ("subject string, source string, reliability string, credibility string, observed_at timestamp, heuristic boolean, "
       "method_factor double, conflict boolean, has_artifact boolean")


def ev(subject, source, rel="B", cred="2", hours=0, conflict=False, artifact=True, heuristic=False):
    at = dt.datetime(2024, 1, 31) - dt.timedelta(hours=hours)
    return (subject, source, rel, cred, at, heuristic, None, conflict, artifact)


def test_worked_examples(spark):
    rows = [ev("two", "a"), ev("two", "b"), ev("one_group", "x/crtsh:a"), ev("one_group", "x/certspotter:b"), ev("one_group", "censys-certs"),
            ev("aged", "a", hours=720), ev("future", "a", hours=-5), ev("bare", "a", "A", "1", artifact=False), ev("odd", "a", "Z", "9"),
            ev("inferred", "a", heuristic=True), ev("split", "a", conflict=True), ev("split", "b")]
    rows += [ev("many", f"s{i}", "A", "1") for i in range(200)]
    got = {r.subject: r.confidence for r in score.confidence(spark.createDataFrame(rows, DDL), NOW).collect()}
    want = {"two": 0.92299375, "one_group": 0.7225, "aged": 0.36125, "future": 0.7225, "bare": 0.5, "odd": 0.2, "inferred": 0.7225 * 0.6,
            "split": 0.92299375 * (1 - 0.25 * 0.5), "many": 0.999}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_strict_groups_keep_full_source_text(spark):
    rows = [ev("g", "x/crtsh:a"), ev("g", "x/certspotter:b")]
    got = score.confidence(spark.createDataFrame(rows, DDL), NOW, score.ScoreConfig(strict_groups=True)).first()
    assert got.confidence == pytest.approx(0.92299375)


def test_more_independent_groups_never_lower_confidence(spark):
    rows = [ev(f"n{n:02d}", f"s{i}", "D", "4") for n in range(1, 12) for i in range(n)]
    got = [r.confidence for r in score.confidence(spark.createDataFrame(rows, DDL), NOW).orderBy("subject").collect()]
    assert got == sorted(got)


def test_relation_confidence(spark):
    ents = spark.createDataFrame([("a", 0.9), ("b", 0.4)], "id string, confidence double")
    rels = spark.createDataFrame([("a", "b", False, 0.0), ("a", "zz", False, 0.0), ("a", "a", True, 0.0), ("a", "b", False, 0.33)],
                                 "from_id string, to_id string, heuristic boolean, confidence double")
    got = sorted(round(r.confidence, 6) for r in score.score_relations(rels, ents).collect())
    assert got == [0.25, 0.33, 0.4, 0.6]


def test_conflicts_flag_every_row(spark):
    obs = spark.createDataFrame([("s", "p", "1"), ("s", "p", "2"), ("s", "q", "1"), ("t", "p", None), ("t", "p", "x")],
                                "subject string, predicate string, object_key string")
    got = {(r.subject, r.predicate): r.conflict for r in score.flag_conflicts(obs).collect()}
    assert got == {("s", "p"): True, ("s", "q"): False, ("t", "p"): True}
    assert score.flag_conflicts(obs).where(F.col("conflict")).count() == 4
