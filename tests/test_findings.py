"""Results at the odd rows and larger tables of a review."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_point


def twin(name, folder, *tables):
    """Rows of the query's SQL over the tables in ``folder``."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(entry_point.oracle_sql()[name]).fetchall())


def rows(spark, name, folder):
    return sorted(tuple(r) for r in entry_point.queries()[name](spark, str(folder)).collect())


def lines(spark, tmp_path, keys):
    spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))


def test_equal_prefix_targets_count_once(spark, tmp_path):
    lines(spark, tmp_path, [(7, 3, 5, 9), (7, 3, 5, 9), (7, 3, 5 + 256, 9), (7, 4, 5, 9)])
    got = rows(spark, "p08_scope_cidrs", tmp_path)
    assert len(got) == 2 and got == twin("p08_scope_cidrs", tmp_path, "lineitem")


def test_names_of_many_digits_are_hosts(spark, tmp_path):
    lines(spark, tmp_path, [(k, n, 3, 4) for k in (999_999, 1_000_000, 4_294_967_295) for n in range(1, 8)])
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    assert rows(spark, "c22_infer_type", tmp_path) == twin("c22_infer_type", tmp_path, "lineitem")


def test_a_number_of_many_digits_stays_a_phone(spark):
    from sightline.operators.canonicalise import infer_type
    from sightline.operators.suffix import suffix_rules
    cases = [("812.345.6789", "phone"), ("tel 812 345 6789", "phone"), ("812-345-6789 x", "phone"), ("a1234567.com", "domain"), ("1234567.com", "domain")]
    got = infer_type(spark.createDataFrame([(a,) for a, _ in cases], "v string"), "v", suffix_rules(spark.createDataFrame([("com",)], "value string")))
    assert {r.v: r.inferred_type for r in got.collect()} == dict(cases)


def test_four_places_are_those_of_the_exact_number(spark):
    from sightline.operators.score import four_places
    xs = [1 - 0.25 * k / n for n in (40, 200, 240, 4000) for k in range(n // 2)] + [i / 32 for i in range(33)] + [i / 100000 for i in range(0, 2000)] \
        + [0.0, 1.0, 0.999, 5e-5, 4.9e-5, 5.1e-5, 0.99995, 0.99994999999, 1e-300, 0.1 + 0.2]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", four_places(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != "%.4f" % r.x] == []


def test_explanations_round_as_their_sql(spark, tmp_path):
    base = spark.range(0, 4000).selectExpr(
        "id * 10 + CASE WHEN id % 200 < 29 THEN 0 ELSE 1 END AS event_id", "timestamp_seconds(1704067200 + id * 500) AS ts", "floor(id / 200) * 3 AS user_id",
        "'view' AS event_type", "CAST(id % 250 AS double) AS value", "'{\"k\": 7}' AS props")
    base.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = rows(spark, "a03_explain", tmp_path)
    assert any("of 200 observations contradict -> factor 0.9637" in r[2] for r in got)
    assert got == twin("a03_explain", tmp_path, "events")


def spread_first(df):
    """Whether rows are spread before they are first aggregated."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lowest = max(i for i, line in enumerate(plan.splitlines()) if "Aggregate [" in line)
    return any("RepartitionByExpression" in line for line in plan.splitlines()[lowest:])


def test_votes_of_odd_claims(spark):
    from sightline.operators import consensus
    claims = [("a", "X"), ("a", " X "), ("a", ""), ("b", "X"), ("b", "Y"), ("c", None), ("c", "Z"), ("c", "Z"), (None, "X"), ("d", "")] + [("hot", "H")] * 300 + [("hot", None)] * 299
    df = spark.createDataFrame(claims, "addr string, country string")
    won, lost = consensus.field_consensus(df, ["country"]), consensus.disputed_fields(df, ["country"])
    assert sorted(map(tuple, won.collect())) == [("a", "country", "X", 2, 3, "2"), ("c", "country", "Z", 2, 3, "2"), ("hot", "country", "H", 300, 599, "2")]
    assert {tuple(r) for r in lost.collect()} == {("b", "country"), (None, "country"), ("d", "country")} and lost.count() == 3
    assert spread_first(won) and spread_first(lost)


def test_tags_are_spread_before_they_meet(spark):
    from sightline.operators import media
    tags = spark.createDataFrame([("f", "gps", "GPSLatitude", "10/1"), ("f", "gps", "GPSLongitude", "20/1"), ("f", "gps", "GPSAltitude", None), ("g", "gps", "GPSLatitude", "1/1")],
                                 "file_id string, ifd string, tag string, value string")
    out = media.gps_decimal(tags)
    assert [tuple(r) for r in out.collect()] == [("f", 10.0, 20.0, None)] and spread_first(out)


def test_customers_are_dealt_before_their_texts_are_made(spark):
    for name in ("s06_registration_text", "s07_rdap"):
        plan = entry_point.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "RepartitionByExpression" in plan[-2] or "RepartitionByExpression" in plan[-3], name


def test_other_addresses_are_made_behind_the_join(spark):
    from sightline.operators.netjoin import LISTS, fcrdns
    pointers = [(f"10.0.{i // 200}.{i % 200}", "Hot.example.") for i in range(600)] + [("10.9.9.9", "cold.example"), (None, "hot.example"), ("10.9.9.8", None)]
    answers = [(n and n.rstrip("."), "A", a) for a, n in pointers[::2]] + [("cold.example", "A", "10.9.9.7"), ("cold.example", "TXT", "10.9.9.6")]
    _, others = fcrdns(spark.createDataFrame(pointers, "addr string, name string"), spark.createDataFrame(answers, "name string, type string, data string"))
    fwd = {(n.lower(), a) for n, t, a in answers if n and a and t == "A"}
    want = sorted((n.lower().rstrip("."), p, a) for p, n in set(pointers) if p and n for m, a in fwd if m == n.lower().rstrip(".") and a != p)
    assert sorted((r.name, r.addr, r.fwd) for r in others.collect()) == want
    plan = others._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # the join makes at most LISTS rows for a pointer
    assert LISTS < 300
