"""Scope decisions over a mixed table, and erasure in one call."""

import json

import pytest

from sightline.operators import change, graph, scope
from sightline.sources import ct


def rules(spark, **over):
    table = lambda rows: spark.createDataFrame(rows, "action string, pattern string")
    given = {"domains": table([("allow", "*.Example.COM"), ("allow", "bücher.example"), ("deny", "secret.example.com")]),
             "cidrs": table([("allow", "10.0.0.0/7"), ("deny", " 10.0.0.0/8")]), "asns": table([("allow", "as3")]), "mail_domains": table([("allow", "Example.COM")]),
             "url_prefixes": ["HTTPS://www.example.com/a"], "orgs": ["Acme Ltd", " "], "deny_regex": ["admin"]}
    return scope.ScopeRules(**given | over)


def test_one_decision_for_every_row(spark):
    rows = [("domain", "www.example.com", "allow.domains"), ("subdomain", "secret.example.com", "deny.domains"), ("domain", "admin.example.com", "deny.regex"),
            ("domain", "xn--bcher-kva.example", "allow.domains"), ("domain", "example.com", "no-allow-rule"), ("domain", "", "invalid"),
            ("ip", "10.1.2.3", "deny.cidrs"), ("ip", "11.1.2.3", "allow.cidrs"), ("ip", "nonsense", "invalid"), ("cidr", "11.0.0.0/8", "allow.cidrs"),
            ("cidr", "8.0.0.0/5", "deny.cidrs"), ("cidr", "x/3", "invalid"), ("asn", "AS3", "allow.asns"), ("asn", "AS4", "no-allow-rule"), ("asn", "AS0", "invalid"),
            ("url", "https://www.example.com/a/b", "allow.url_prefixes"), ("url", "https://www.example.com/c", "no-url-prefix"),
            ("url", "https://admin.example.com/a", "allow.domains (via url host)"), ("email", "a@example.com", "allow.email_domains"), ("email", "a@b.example", "no-allow-rule"),
            ("email", "nobody", "invalid"), ("org", "ACME ltd branch", "allow.orgs"), ("org", "other", "no-allow-rule"), ("org", " ", "invalid"),
            ("person", "p", "not-network-target"), ("person", " ", "invalid"), ("weird", "x", "unknown-type"), (None, "x", "unknown-type")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(rows)], "k long, type string, value string")
    got = {r["k"]: r for r in scope.scope_all(df, rules(spark)).collect()}
    assert {i: got[i]["rule"] for i in got} == {i: rule for i, (_, _, rule) in enumerate(rows)}
    assert all(r["allowed"] == (r["rule"].startswith("allow.") and "via" not in r["rule"] or r["rule"] == "not-network-target") for r in got.values())
    assert all(not r["out_of_scope"] for r in got.values() if r["rule"] in ("invalid", "unknown-type"))


@pytest.mark.parametrize("over, value", [({"domains": "a..b"}, ("domain", "x.example")), ({"cidrs": "10.0.0.0"}, ("ip", "10.0.0.1")), ({"asns": "3"}, ("asn", "AS3"))])
def test_a_bad_rule_stops_the_job(spark, over, value):
    bad = {k: spark.createDataFrame([("deny", v)], "action string, pattern string") for k, v in over.items()}
    df = spark.createDataFrame([value], "type string, value string")
    with pytest.raises(Exception, match="not a valid"):
        scope.scope_all(df, rules(spark, **bad)).collect()


def test_purge(spark):
    ents = spark.createDataFrame([("1", "email", "Jane@acme.example"), ("2", "ip", "10.0.0.1"), ("3", "email", "joe@ACME.example"), ("4", "ip", "10.0.0.2")],
                                 "id string, type string, value string")
    g = {"entities": ents, "relations": spark.createDataFrame([("1", "2")], "from_id string, to_id string"),
         "observations": spark.createDataFrame([("o1", "2"), ("o2", "4")], "id string, subject string"),
         "observation_scans": spark.createDataFrame([("o1", "s"), ("o2", "s")], "observation_id string, scan_id string")}
    report, kept = change.purge(g, subject="jane", dry_run=False)
    assert {r["table_name"]: r["erased"] for r in report.collect()} == {"entities": 2, "relations": 1, "observations": 1, "observation_scans": 1}
    assert {r["id"] for r in kept["entities"].collect()} == {"3", "4"}
    assert {r["id"] for r in change.erasure_seeds(ents, subject="acme.EXAMPLE").collect()} == {"1", "3"}


def test_an_entity_is_queued_once(spark):
    ents = spark.createDataFrame([("e", "ip", "p1", 2), ("e", "ip", "p2", 1)], "id string, type string, parent string, hop long")
    collectors = spark.createDataFrame([("geo", "ip")], "collector string, consumes string")
    (row,) = graph.frontier(ents, collectors, spark.createDataFrame([], "id string, collector string")).collect()
    assert (row["parent"], row["hop"]) == ("p2", 1)


def test_a_large_answer_is_read_whole(spark, tmp_path):
    body = [{"id": i, "name_value": f"h{i}.example.com", "issuer_name": "CN=" + "x" * 1000, "serial_number": "1"} for i in range(34_000)]
    (tmp_path / "a.json").write_text(json.dumps(body))
    assert (tmp_path / "a.json").stat().st_size > 34 << 20
    assert ct.read_ct_a(spark, str(tmp_path)).count() == 34_000


def test_orders_are_what_they_say(spark):
    rows = [("b", "s", "2024-01-02"), ("a", "s", "2024-01-02"), ("c", "r", "2024-01-03"), ("d", "t", "2024-01-01")]
    obs = spark.createDataFrame(rows, "id string, subject string, observed_at string").repartition(3)
    assert [r["id"] for r in change.order_observations(obs).collect()] == [i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    diff = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y")], "subject string, field string").repartition(3)
    assert [tuple(r) for r in change.order_diff(diff).collect()] == [("a", "y"), ("a", "z"), ("b", "x")]
