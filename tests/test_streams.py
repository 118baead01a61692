"""State that merges: every step equals the whole history; replays and restarts change nothing; only touched buckets are written."""

import datetime as dt
import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sightline import fixed, schemas
from sightline.operators import score, score_state
from sightline.sources import buckets, sinks
from sightline.streaming import streams

T0 = dt.datetime(2024, 1, 1)
OBS = "event_id long, subject string, source string, reliability string, credibility string, observed_at timestamp, conflict boolean, has_artifact boolean, heuristic boolean"


def observations(spark, n, start=0, hot=0.4):
    import random
    rng = random.Random(start)
    rows = [(start + i, "hot" if rng.random() < hot else f"s{rng.randrange(12)}", rng.choice(["ct-search/crtsh:api", "pdns/otx:api", "whois/iana:text"]), rng.choice("ABCZ"),
             rng.choice("123"), T0 + dt.timedelta(hours=rng.randrange(24 * 40)), rng.random() < .1, rng.random() < .2, rng.random() < .1) for i in range(n)]
    rows += [(start + n, "late", "x/y:z", "A", "1", None, False, False, False)] if not start else []
    return spark.createDataFrame(rows, OBS)


def same(got, want):
    order = lambda df: sorted(map(tuple, df.select("subject", "n_obs", "n_conflicts", "n_groups", "artifact", "confidence").collect()))
    a, b = order(got), order(want)
    assert [r[:5] for r in a] == [r[:5] for r in b] and [r[5] for r in a] == pytest.approx([r[5] for r in b], abs=1e-10)


@pytest.mark.parametrize("horizon", ["2023-12-01", "2024-01-15", "2024-03-01"])
def test_state_equals_scores_over_all_rows_at_any_time(spark, horizon):
    a, b = observations(spark, 200), observations(spark, 150, 1000)
    state = score_state.merged(score_state.state_of(a, horizon), score_state.state_of(b, horizon))
    for now in ("2024-01-20", "2024-02-20", "2025-06-01"):
        if now >= horizon:
            same(score_state.confidence_at(state, now), score.confidence(a.unionByName(b), now))
    later = score_state.settled(state, "2024-01-25" if horizon < "2024-01-25" else horizon)
    same(score_state.confidence_at(later, "2024-03-02"), score.confidence(a.unionByName(b), "2024-03-02"))
    assert later.count() <= state.count()


def test_score_batches_step_by_step_with_replays(spark, tmp_path):
    d, horizon, now = str(tmp_path / "scores"), "2024-01-10", "2024-02-10"
    parts = [observations(spark, 120, s) for s in (0, 500, 900)]
    parts[1] = parts[1].unionByName(parts[0].limit(30))  # rows that have come before
    so_far = None
    for n, part in enumerate(parts):
        for _ in range(2):
            streams.apply_scores(part, n, d, horizon, unique=["event_id"], n_buckets=8)
        so_far = part if so_far is None else so_far.unionByName(part)
        same(streams.scores_at(spark, d, now), score.confidence(so_far.dropDuplicates(["event_id"]), now))
    # a batch that had been merged into some of its buckets only is completed
    more = observations(spark, 80, 2000)
    some = more.where(buckets.bucket_of(["subject"], 8) < 4)
    streams.apply_scores(some, 3, d, horizon, unique=["event_id"], n_buckets=8)
    streams.apply_scores(more, 3, d, horizon, unique=["event_id"], n_buckets=8)
    whole = so_far.unionByName(more).dropDuplicates(["event_id"])
    same(streams.scores_at(spark, d, now), score.confidence(whole, now))


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/bucket=*/*.parquet")}


def test_a_small_batch_touches_few_buckets(spark, tmp_path):
    d = str(tmp_path / "graph")
    rel = lambda ids: spark.createDataFrame([(f"e{i}", "a", "b", "t", 0.1, True, []) for i in ids], schemas.RELATIONS)
    sinks.save_graph({"relations": rel(range(400))}, d, 64)
    before = files(f"{d}/relations")
    assert len(before) > 50
    sinks.save_graph({"relations": rel(range(395, 405))}, d, 64)
    after = files(f"{d}/relations")
    assert len(set(after) - set(before)) <= 10 and len(set(before) & set(after)) >= len(before) - 10
    assert sinks.load_table(spark, d, "relations").count() == 405
    sinks.save_graph({"relations": rel(range(395, 405))}, d, 64)
    assert sinks.load_table(spark, d, "relations").distinct().count() == sinks.load_table(spark, d, "relations").count() == 405


def custody(n, broken=()):
    prev, out = fixed.GENESIS_HASH, []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=i)
        parts = [prev if i not in broken else "f" * 64, "c1", "s", "x" * 64, "1", "", "src", "m", "me", at.strftime("%Y-%m-%dT%H:%M:%SZ"), ""]
        h = hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
        out.append((f"e{i:03d}", "c1", "s", "x" * 64, 1, "", "src", "m", "me", at, None, parts[0], h, "", i))
        prev = h
    return out


def test_chain_heads_are_carried_and_replays_repeat_nothing(spark, tmp_path):
    d = str(tmp_path / "chain")
    rows = custody(30, broken={17})
    parts = [rows[:10], rows[10:20], rows[20:]]
    for n, part in enumerate(parts):
        for _ in range(2):
            streams.verify_chain(spark.createDataFrame(part, schemas.EVIDENCE), n, d, 8)
    got = [(r.id, r.problem) for r in spark.read.parquet(f"{d}/breaks").collect()]
    assert got == [("e017", "link")]
    assert [r.head for r in spark.read.parquet(f"{d}/heads").collect()] == [rows[-1][12]]


def test_saved_relations_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans = []
    write = buckets._write
    monkeypatch.setattr(buckets, "_write", lambda rows, path: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, path)))
    rel = lambda ids, x: spark.createDataFrame([(str(i), "a", f"b{i}", "t", x, False, []) for i in ids], sinks.schemas.RELATIONS)
    for ids, x in ((range(40), 0.2), (range(30, 60), 0.7), (range(40), 0.2)):
        sinks.save_graph({"relations": rel([*ids, *ids], x), "tags": rel(ids, x).selectExpr("id entity_id", "type tag")}, str(tmp_path), 4)
    assert len(plans) == 6 and all(p.count("Exchange") == 1 for p in plans)
    got = {r.id: (r.confidence, r.to_id) for r in sinks.load_table(spark, str(tmp_path), "relations").collect()}
    assert got == {str(i): (0.2 if i < 30 else 0.7, f"b{i}") for i in range(60)}
    assert sinks.load_table(spark, str(tmp_path), "relations").count() == 60 == sinks.load_table(spark, str(tmp_path), "tags").count()
