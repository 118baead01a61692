"""Canonical forms and keys against stated values."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sightline import fixed
from sightline.functions import keys, names, net, udfs
from sightline.functions.udfs import keccak256
from sightline.operators import suffix
from sightline.operators.canonicalise import canonicalise, infer_type, split_quarantine

PAIRS = [
    ("domain", "HTTPS://Example.COM:443/x", "example.com"), ("domain", "example.com.", "example.com"),
    ("domain", "bücher.example", "xn--bcher-kva.example"), ("domain", "a..b", None), ("domain", "1.2.3.4", "1.2.3.4"),
    ("domain", "[2001:db8::1]:443", "2001:db8::1"), ("ip", "2001:0DB8:0:0:0:0:0:1", "2001:db8::1"),
    ("ip", "fe80::1%eth0", "fe80::1"), ("ip", "::ffff:1.2.3.4", "1.2.3.4"), ("ip", "1.2.3.4:80", "1.2.3.4"),
    ("ip", "01.2.3.4", None), ("ip", "1:0:0:2:0:0:0:3", "1:0:0:2::3"), ("ip", "1::2::3", None), ("ip", "::", "::"),
    ("cidr", "10.1.2.3/15", "10.0.0.0/15"), ("cidr", "2001:db8:ffff::/33", "2001:db8:8000::/33"), ("cidr", "10.0.0.0/33", None),
    ("asn", "as0123", "AS123"), ("asn", "AS0", None), ("asn", "AS4294967296", None),
    ("url", "HTTP://Ex.com:80?utm_source=a&b=1&c=#f", "http://ex.com/?b=1&c"), ("url", "//h/p", "https://h/p"), ("url", "h/p", None),
    ("url", "https://x.example:8443/A?ref=1", "https://x.example:8443/A"), ("email", "Jo.Do@EXample.com", "Jo.Do@example.com"),
    ("email", "a b@x.com", None), ("wallet", "eth:0x5AAEB6053f3e94c9b9a09f33669435e7ef1beaed", "ethereum:0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"),
    ("wallet", "BTC:1ABCdef", "bitcoin:1abcdef"), ("phone", "(+62) 812 3456 789", "+628123456789"), ("phone", "0812", None),
    ("geo", "1.5, -2@3", "1.500000,-2.000000@3"), ("geo", "91,0", None), ("cve", "cve-2024-0123", "CVE-2024-0123"), ("cve", "CVE-1998-1234", None),
    ("hash", "5D41402ABC4B2A76B9719D911017C592", "md5:5d41402abc4b2a76b9719d911017c592"), ("hash", "abc", None),
    ("repo", "https://GitHub.com/A/b.git", "github.com/A/b"), ("package", "Ns@Name", "pkg:generic/ns/name"), ("account", "GitHub:Foo", "github:Foo"),
    ("person", "  A   b ", "A b"), ("tx", "BTC:ABC", "btc:abc"), ("text", "é", "é"), ("nonsense", "1", None), ("domain", "  ", None),
]


def entity_id(kind: str, value: str) -> str:
    digest = hashlib.sha256(kind.encode() + b"\0" + value.encode()).digest()
    return base64.b32encode(digest).decode().rstrip("=").lower()[:26]


def test_canonical_forms_ids_and_quarantine(spark):
    df = canonicalise(spark.createDataFrame([(a, b) for a, b, _ in PAIRS], "type string, value string"))
    rows = {(r.type, r.value): r for r in df.collect()}
    for kind, value, want in PAIRS:
        row = rows[(kind, value)]
        assert row.canonical == want, (kind, value)
        assert row.entity_id == (entity_id(kind, want) if want else None)
        assert (row.reject_reason is None) == (want is not None)
    good, bad = split_quarantine(df)
    assert good.count() + bad.count() == len(PAIRS)


def test_type_inference(spark):
    cases = [("1.2.3.4", "ip"), ("AS5", "asn"), ("10.0.0.0/8", "cidr"), ("btc:xyz12345", "wallet"), ("CVE-2020-1234", "cve"),
             ("a@b.com", "email"), ("+62812345-6789", "phone"), ("www.example.co.uk", "subdomain"), ("example.co.uk", "domain"), ("foo bar", None), ("1.2.3", "subdomain"), ("2.3", "domain"), ("Mail.Example.com.", "subdomain")]
    got = {r.v: r.inferred_type for r in infer_type(spark.createDataFrame([(a,) for a, _ in cases], "v string"), "v",
                                                     suffix.suffix_rules(spark.createDataFrame([("com",), ("co.uk",)], "value string"))).collect()}
    assert got == dict(cases)


def test_keccak_known_answers():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert keccak256(b"a" * 200) != keccak256(b"a" * 201)


@pytest.mark.parametrize("x,text", [(0.0, "0"), (1.0, "1"), (0.5, "0.5"), (-2.25, "-2.25"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"),
                                    (123456.0, "123456"), (1e-4, "0.0001"), (0.00025, "0.00025"), (1.5e-5, "1.5e-05"), (1e21, "1e+21"), (12345678.9, "1.23456789e+07")])
def test_double_text(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(keys.double_text(F.col("x")).alias("t")).first().t == text


RULES = """// a comment
com
co
com.co  // two rules meet
co.uk
uk

*.ck
!www.ck
*.w.example
!a.b.w.example
b\u00fccher
"""


def test_public_suffix_rules(spark):
    rows = [("a.b.example.co.uk", "example.co.uk"), ("co.uk", None), ("localhost", None), ("10.0.0.1", None), ("x.foo.ck", "x.foo.ck"), ("foo.ck", None), ("ck", None),
            ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("a.b.unknown", "b.unknown"), ("Example.COM.", "example.com"), ("a.foo.com.co", "foo.com.co"), ("com.co", None),
            ("w.example", "w.example"), ("v.w.example", None), ("u.v.w.example", "u.v.w.example"), ("x.a.b.w.example", "a.b.w.example"), ("n.xn--bcher-kva", "n.xn--bcher-kva"),
            ("", None), (None, None), ("2001:db8::1", None)]
    rules = suffix.suffix_rules(spark.createDataFrame([(x,) for x in RULES.split("\n")], "value string"))
    df = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(rows)], "n string, suffix int")
    got = suffix.with_registrable(df.drop("suffix").withColumn("i", F.lit(1)), "n", rules).collect()
    assert len(got) == len(rows)
    for r in got:
        want = dict(rows)[r.n]
        assert r.registrable == (want or (r.n.lower().rstrip(".") if r.n else r.n)) and (r.suffix == "") == (want is None), r
    short = [x.split()[0] for x in RULES.split("\n") if x and not x.startswith("//") and x.isascii()]
    names_only = spark.createDataFrame([(a,) for a, _ in rows[:17]], "n string").select("n", names.registrable(F.col("n"), short).alias("r"))
    assert {r.n: r.r for r in names_only.collect()} == dict(rows[:17])
    probe = spark.createDataFrame([("notexample.com",), ("example.com.evil.com",), ("a.example.com",), ("example.com",)], "n string")
    inside = {r.n: r.inside for r in suffix.with_in_domain(probe, "n", "example.com", rules).collect()}
    assert inside == {"notexample.com": False, "example.com.evil.com": False, "a.example.com": True, "example.com": True}
    assert suffix.registrable_names(probe.withColumnRenamed("n", "host"), rules.limit(0)).count() == 4


def test_no_list_of_suffixes_is_built_in():
    assert not hasattr(fixed, "PUBLIC_SUFFIXES")


def test_names_become_ascii_the_same_way_everywhere():
    assert udfs._ascii_name("B\u00dcCHER.Example") == "xn--bcher-kva.example"
    assert udfs._ascii_name("fa\u00df.example") == "xn--fa-hia.example" and udfs._ascii_name("\uff41\u3002example") == "a.example"


def test_ptr_names(spark):
    df = spark.createDataFrame([("192.0.2.1",), ("2001:db8::1",)], "a string").select(net.ptr_name(F.col("a")).alias("p"))
    assert [r.p for r in df.collect()] == ["1.2.0.192.in-addr.arpa", "1." + "0." * 23 + "8.b.d.0.1.0.0.2.ip6.arpa"]


def test_masked_addresses_are_refused(spark):
    vals = ["q#**hidden@example.org", "xxxx@shield.example", "real@example.com", "mail: a@b.com", "a@b.com c@d.com", "data redacted"]
    got = [r.e for r in spark.createDataFrame([(v,) for v in vals], "v string").select(names.extract_email(F.col("v")).alias("e")).collect()]
    assert got == [None, None, "real@example.com", None, None, None]
