"""Merges, erasure, chains, files and streams."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions import keys
from sightline.operators import change, graph, integrity, merge
from sightline.sources import captures, ct, logs, sinks

T0 = dt.datetime(2024, 1, 1)


def test_edge_promotion_and_replay(spark):
    edge = lambda c, h: spark.createDataFrame([("e", "a", "b", "t", c, h, [])], schemas.RELATIONS)
    once = merge.merge_relations(edge(0.4, False), edge(0.7, True)).first()
    assert (once.confidence, once.heuristic) == (0.7, False)


def test_saving_a_batch_twice_changes_nothing(spark, tmp_path):
    d = str(tmp_path / "graph")
    ents = spark.createDataFrame([("i", "ip", "1.1.1.1", "", {}, ["x"], 0.2, 0, T0, T0)], schemas.ENTITIES)
    rels = spark.createDataFrame([("e", "a", "b", "t", 0.1, True, [])], schemas.RELATIONS)
    link = spark.createDataFrame([("i", "s1"), ("i", "s1")], schemas.ENTITY_SCANS)
    for _ in range(2):
        sinks.save_graph({"entities": ents, "relations": rels, "entity_scans": link}, d)
    assert [sinks.load_table(spark, d, t).count() for t in ("entities", "relations", "entity_scans", "findings")] == [1, 1, 1, 0]
    page = sinks.load_table(spark, d, "entities")
    sinks.export_json(page, page.agg(F.count(F.lit(1)).alias("total")), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out" / "summary")).first().value) == {"total": 1, "returned": 1}


def test_erasure_by_domain_takes_the_connected_three(spark):
    ents = spark.createDataFrame([("d", "domain", "acme.example"), ("s", "subdomain", "www.acme.example"), ("i", "ip", "1.1.1.1"), ("z", "ip", "9.9.9.9"),
                                  ("m", "email", "jane@acme.example"), ("n", "email", "acme.example@other.test")], "id string, type string, value string")
    rels = spark.createDataFrame([("r1", "s", "d", "x"), ("r2", "s", "i", "x")], "id string, from_id string, to_id string, type string")
    seeds = change.erasure_seeds(ents, subject="acme.example")
    assert {r.id for r in seeds.collect()} == {"d", "m", "n"}
    ids = graph.erasure_closure(rels, ents.where("id = 'd'").select("id")).select("id")
    report, kept = change.erase({"entities": ents, "relations": rels}, ids, dry_run=False)
    assert {r.table_name: r.erased for r in report.collect()} == {"entities": 3, "relations": 2}
    assert {r.id for r in kept["entities"].collect()} == {"z", "m", "n"}
    assert change.erase({"entities": ents}, ids)[1]["entities"].count() == 6
    # a mail subject does not match a local part glued to another host
    assert change.erasure_seeds(ents, subject="jane@acme.example").count() == 1


def audit_rows(n):
    prev, out = "0" * 64, []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=i)
        detail = json.dumps({"i": i}, separators=(",", ":"))
        parts = [prev, str(int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) + "000000", "me", "act", detail]
        h = hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
        out.append((i, at, None, "me", "act", detail, prev, h))
        prev = h
    return out


def test_audit_chain_tampering(spark):
    rows = audit_rows(40)
    ok = integrity.verify_audit(spark.createDataFrame(rows, schemas.AUDIT), width=7).first()
    assert ok.ok and ok.entries == 40 and ok.head_hash == rows[-1][7]
    edited = [r[:5] + ('{"i":99}',) + r[6:] if r[0] == 21 else r for r in rows]
    assert integrity.verify_audit(spark.createDataFrame(edited, schemas.AUDIT), width=7).first().broken_at_seq == 21
    deleted = [r for r in rows if r[0] != 14]
    bad = integrity.verify_audit(spark.createDataFrame(deleted, schemas.AUDIT), width=7).first()
    assert (bad.ok, bad.broken_at_seq, bad.reason) == (False, 15, "prev_hash does not match previous head")
    assert integrity.verify_audit(spark.createDataFrame([], schemas.AUDIT)).first().head_hash == "0" * 64


def test_audit_file_stops_at_first_corrupt_line(spark, tmp_path):
    line = lambda i: json.dumps({"seq": i, "at": "2024-01-01T00:00:00Z", "actor": "a", "action": "x", "detail": {"k": 1}, "prev_hash": "p", "hash": "h"})
    (tmp_path / "a.jsonl").write_text("\n".join([line(1), "", line(2), '{"seq": 3, "at', line(4)]))
    assert sorted(r.seq for r in logs.read_audit(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    assert [r.seq for r in logs.read_audit(spark, str(tmp_path / "a.jsonl"), lo=2).collect()] == [2]


def test_blob_tree(spark, tmp_path):
    data = b"hello"
    sha = hashlib.sha256(data).hexdigest()
    p = tmp_path / sha[:2] / sha[2:4]
    p.mkdir(parents=True)
    (p / sha).write_bytes(data)
    blobs = logs.read_blobs(spark, str(tmp_path))
    ev = spark.createDataFrame([("e1", f"{sha[:2]}/{sha[2:4]}/{sha}", sha), ("e2", "aa/bb/aabb", "aabb"), ("e3", "", "")], "id string, blob_path string, sha256 string")
    assert {r.id: r.blob_state for r in integrity.verify_blobs(ev, blobs).collect()} == {"e1": "present", "e2": "missing", "e3": "none"}


def test_capture_and_certificate_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([["original", "timestamp", "statuscode"], ["http://a.example/", "20200101000000", "200"], ["x"], []]))
    assert [(r.original, r.stamp, r.status) for r in captures.read_cdx(spark, str(tmp_path / "c.json")).collect()] == [
        ("http://a.example/", "20200101000000", 200), ("x", "", 0)]
    (tmp_path / "ct.json").write_text(json.dumps([{"id": 1, "name_value": "A.example\n*.a.example", "issuer_name": "O=CA"}, {"id": 2, "common_name": "b.example"}]))
    assert sorted(r.names for r in ct.read_ct_a(spark, str(tmp_path / "ct.json")).collect()) == [["a.example", "*.a.example"], ["b.example"]]


def test_large_answers_are_read_in_splits(spark, tmp_path):
    rows = [{"id": i, "name_value": f"n{i}.example\n*.n{i}.example", "issuer_name": "O=CA, [x]"} for i in range(400)]
    (tmp_path / "a.json").write_text("[" + ",\n".join(json.dumps(r) for r in rows) + "]")
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    want = sorted(map(tuple, ct.read_ct_a(spark, str(tmp_path / "a.json")).select("names").collect()))
    caps = [["original", "timestamp", "statuscode"], *([f"http://a.example/{i}?x[]=[1]", "20200101000000", "200"] for i in range(400)), ["x"], []]
    (tmp_path / "c.json").write_text("[" + ",\n ".join(json.dumps(r) for r in caps) + "]")
    (tmp_path / "c2.json").write_text("[\n" + ",\n".join(json.dumps(r) for r in [["timestamp", "Original"], ["2", "http://b.example/"]]) + "\n]\n")
    seen = sorted(map(tuple, captures.read_cdx(spark, str(tmp_path / "c.json")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name in ("a.json", "a.jsonl"):
            lines = ct.read_ct_a(spark, str(tmp_path / name), one_per_line=True)
            assert lines.rdd.getNumPartitions() > 3
            assert sorted(map(tuple, lines.select("names").collect())) == want
        assert sorted(map(tuple, captures.read_cdx(spark, str(tmp_path / "c.json"), one_per_line=True).collect())) == seen and len(seen) == 401
        both = captures.read_cdx(spark, str(tmp_path / "c*.json"), one_per_line=True)
        assert both.count() == 402 and both.where("original = 'http://b.example/' AND stamp = '2'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_audit_folders_are_cut_file_by_file(spark, tmp_path):
    line = lambda i: json.dumps({"seq": i, "at": "2024-01-01T00:00:00Z", "actor": "a", "action": "x", "detail": {}, "prev_hash": "p", "hash": "h"})
    (tmp_path / "a.jsonl").write_text("\n".join([line(1), '{"seq"', line(2)]))
    (tmp_path / "b.jsonl").write_text("\n".join([line(3), line(4)]))
    assert sorted(r.seq for r in logs.read_audit(spark, str(tmp_path)).collect()) == [1, 3, 4]


def test_observation_identity_ignores_time_but_not_validity(spark):
    df = spark.createDataFrame([("s", "p", "o", "m", T0, None), ("s", "p", "o", "m", T0 + dt.timedelta(1), None), ("s", "p", "o", "m", T0, T0)],
                               "subject string, predicate string, object_key string, source string, observed_at timestamp, valid_from timestamp")
    ids = [r.id for r in keys.with_ids(df, "observation").collect()]
    want = hashlib.sha256(b"m\0s\0p\0o\0").hexdigest()[:32]
    assert ids[0] == ids[1] == want and ids[2] == hashlib.sha256(b"m\0s\0p\0o\0" + b"2024-01-01T00:00:00Z").hexdigest()[:32]
