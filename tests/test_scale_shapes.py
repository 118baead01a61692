"""The skew-safe shapes give what the plain ones give, also when forced to split."""

import ipaddress
import random

from pyspark.sql import Window, functions as F

from sightline.operators import metrics, netjoin, ordered, skew


def test_attach_keeps_every_row(spark):
    facts = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    facts = facts.unionByName(spark.createDataFrame([(9999, None)], "id long, k string"))
    dims = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(str, facts.join(dims, "k", how).select("id", "k").collect()))
        got = sorted(map(str, skew.attach(facts, dims, "k", how).select("id", "k").collect()))
        assert got == want, how


def test_slotted_lag_equals_plain_lag(spark):
    rows = spark.range(2000).select((F.col("id") * 37 % 500).alias("t"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(r.id, r.p) for r in rows.withColumn("p", F.lag("id").over(w)).collect()}
    got = {(r.id, r.p) for r in ordered.lagged(rows, ["k"], ["t", "id"], {"p": "id"}, width=15).collect()}
    assert got == want


def test_slotted_running_equals_plain_running_sum(spark):
    rows = spark.range(2000).select((F.col("id") * 37 % 500).alias("t"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    plain = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    for w, order, p in ((plain, ["t", "id"], False), (peers, ["t"], True)):
        want = {(r.id, r.s) for r in rows.withColumn("s", F.sum("id").over(w)).collect()}
        got = {(r.id, r.s) for r in ordered.running(rows, ["k"], order, {"s": F.col("id")}, p, width=15).collect()}
        assert got == want


def test_rate_violations_in_a_burst(spark):
    rows = [("h", i, 1_700_000_000 + (i // 50)) for i in range(500)] + [("g", 1000 + i, 1_700_000_000 + 100 * i) for i in range(20)]
    log = spark.createDataFrame(rows, "host string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.in_period for r in metrics.rate_violations(log, 3, 5, width=4).collect()}
    want = {}
    for host, eid, s in rows:
        n = sum(1 for h2, _, s2 in rows if h2 == host and s - 5 <= s2 <= s)
        if n > 3:
            want[eid] = n
    assert got == want


def test_longest_prefix_both_families(spark):
    rnd = random.Random(3)
    addrs = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(60)] + [str(ipaddress.IPv6Address(0x20010db8 << 96 | rnd.getrandbits(40))) for _ in range(40)]
    nets = {str(ipaddress.ip_network((a, rnd.choice([1, 4, 9, 13, 20, 31, 32])), strict=False)) for a in addrs[:40]}
    nets |= {str(ipaddress.ip_network((a, rnd.choice([1, 32, 63, 64, 65, 90, 128])), strict=False)) for a in addrs[60:85]}
    got = {r.addr: r.prefix for r in netjoin.longest_prefix(
        spark.createDataFrame([(a,) for a in addrs], "addr string"), spark.createDataFrame([(n,) for n in nets], "prefix string")).collect()}
    for a in addrs:
        hits = [n for n in nets if ipaddress.ip_address(a) in ipaddress.ip_network(n)]
        assert got[a] == max(hits, key=lambda n: ipaddress.ip_network(n).prefixlen, default=None), a


def test_interval_lookup_first_wins(spark):
    rnd = random.Random(5)
    ranges = [(i, lo, lo + rnd.choice([0, 1, 7, 1000, 2**31]), f"e{i}") for i, lo in enumerate(rnd.randrange(1, 2**31) for _ in range(60))]
    points = [lo for _, lo, _, _ in ranges] + [hi for _, _, hi, _ in ranges] + [hi + 1 for _, _, hi, _ in ranges]
    got = {r.asn: r.e for r in netjoin.interval_lookup(
        spark.createDataFrame([(p,) for p in points], "asn long"), spark.createDataFrame(ranges, "ord int, lo long, hi long, e string")).collect()}
    for p in points:
        assert got[p] == next((e for _, lo, hi, e in ranges if lo <= p <= hi), None)


def test_nested_prefixes_with_a_rule_for_everything(spark):
    rng = random.Random(12)
    nets = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.0.0.0/8", "255.255.255.255/32", "ff00::/8"]
    nets += [str(ipaddress.ip_network((rng.randrange(2 ** 32) & 0x0F0F0FFF, rng.randrange(1, 33)), strict=False)) for _ in range(60)]
    nets += [str(ipaddress.ip_network((rng.randrange(2 ** 128) >> rng.choice([0, 3, 60]), rng.randrange(1, 129)), strict=False)) for _ in range(60)]
    addrs = [str(ipaddress.ip_address(rng.randrange(2 ** 32) & 0x0F0F0FFF)) for _ in range(300)] + [str(ipaddress.ip_address(rng.randrange(2 ** 128) >> rng.choice([0, 3, 60]))) for _ in range(100)]
    addrs += [str(ipaddress.ip_network(n)[i]) for n in nets for i in (0, -1)] + ["bad", None, "10.0.0.1"]
    for rules in (nets, nets[2:], []):
        table = spark.createDataFrame([(n, i) for i, n in enumerate(rules)], "prefix string, i int")
        got = {r.addr: r.prefix for r in netjoin.longest_prefix(spark.createDataFrame([(a,) for a in addrs], "addr string"), table).collect()}
        for a in addrs:
            ip = None if a in ("bad", None) else ipaddress.ip_address(a)
            ip = getattr(ip, "ipv4_mapped", None) or ip
            fits = [n for n in rules if ip is not None and ipaddress.ip_network(n).version == ip.version and ip in ipaddress.ip_network(n)]
            assert got[a] == max(fits, key=lambda n: (int(n.split("/")[1]), n), default=None), a


def test_overlapping_intervals_and_a_full_one(spark):
    rng = random.Random(13)
    spans = [(0, 2 ** 32 - 1, 900), (5, 5, 1), (5, 5, 0), (7, 3, 0)] + [(lo, lo + rng.randrange(2 ** rng.randrange(1, 31)), i + 10) for i, lo in enumerate(rng.randrange(2 ** 32) for _ in range(80))]
    spans = [(lo, min(hi, 2 ** 32 - 1), o) for lo, hi, o in spans]
    points = [rng.randrange(2 ** 32) for _ in range(200)] + [x for lo, hi, _ in spans for x in (lo, hi, max(0, lo - 1))] + [None, 5]
    for rules in (spans, spans[1:]):
        table = spark.createDataFrame(rules, "lo long, hi long, ord int")
        got = netjoin.interval_lookup(spark.createDataFrame([(p,) for p in points], "asn long"), table).collect()
        assert len(got) == len(points)
        for r in got:
            fits = [o for lo, hi, o in rules if r.asn is not None and lo <= r.asn <= hi]
            assert r.ord == min(fits, default=None)
