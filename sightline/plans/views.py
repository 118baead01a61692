"""Deterministic views that read the given tables as observations, captures, logs and edges.

Every view has a Spark form and an SQL form (a ``WITH`` item) that say the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions import keys
from sightline.plans.catalog import table

NOW = "2024-01-31 00:00:00"
SOURCES = ["ct-search/crtsh:api", "ct-search/certspotter:api", "pdns/virustotal:api", "pdns/otx:api",
           "whois/iana:text", "dns/doh:query"]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return obs_of(table(spark, sf, "events"))


def obs_of(e: DataFrame) -> DataFrame:
    """Events as observations; also of a stream."""
    v, eid, uid = F.col("value"), F.col("event_id"), F.col("user_id")
    k = F.regexp_extract("props", "(\\d+)", 1).cast("int")
    d = e.select(
        "event_id", "user_id", F.concat(F.lit("u"), uid.cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.when(uid % 3 == 0, "same").otherwise((k % 4).cast("string")).alias("object_key"),
        pick(SOURCES, eid % 6).alias("source"),
        F.when(v < 10, "A").when(v < 30, "B").when(v < 60, "C").when(v < 120, "D").when(v < 200, "E").otherwise("Z").alias("reliability"),
        (eid % 7).cast("string").alias("credibility"), F.col("ts").alias("observed_at"),
        (eid % 11 == 0).alias("heuristic"), F.when(eid % 13 == 0, F.lit(0.8)).alias("method_factor"),
        (eid % 10 == 0).alias("conflict"), ((eid % 3 == 0) & (uid % 4 != 0)).alias("has_artifact"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "s1").otherwise("s2").alias("scan_id"), k.alias("k"))
    return d.withColumn("id", keys.observation_id(F.col("source"), F.col("subject"), F.col("predicate"), F.col("object_key")))


OBS = """
obs0 AS (
  SELECT event_id, user_id, 'u' || user_id AS subject, event_type AS predicate,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
         list_extract(['ct-search/crtsh:api','ct-search/certspotter:api','pdns/virustotal:api','pdns/otx:api',
                       'whois/iana:text','dns/doh:query'], CAST(event_id % 6 + 1 AS INTEGER)) AS source,
         CASE WHEN value < 10 THEN 'A' WHEN value < 30 THEN 'B' WHEN value < 60 THEN 'C'
              WHEN value < 120 THEN 'D' WHEN value < 200 THEN 'E' ELSE 'Z' END AS reliability,
         CAST(event_id % 7 AS VARCHAR) AS credibility, ts AS observed_at,
         event_id % 11 = 0 AS heuristic, CASE WHEN event_id % 13 = 0 THEN 0.8 END AS method_factor,
         event_id % 10 = 0 AS conflict, (event_id % 3 = 0 AND user_id % 4 <> 0) AS has_artifact,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 's1' ELSE 's2' END AS scan_id
  FROM events),
obs1 AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'same' ELSE CAST(k % 4 AS VARCHAR) END AS object_key FROM obs0),
obs AS (SELECT *, substr(sha256(source || chr(0) || subject || chr(0) || predicate || chr(0) || object_key || chr(0)), 1, 32) AS id
        FROM obs1)"""

WEIGHT = OBS + """,
weighed AS (
  SELECT *, least(greatest(
           (CASE WHEN r * c = 0 THEN 0.2 ELSE r * c END)
           * (CASE WHEN heuristic THEN 0.6 WHEN method_factor > 0 AND method_factor <= 1 THEN method_factor ELSE 1.0 END)
           * (CASE WHEN age <= 0 THEN 1.0 ELSE pow(0.5, age / 2592000.0) END), 0.0), 0.999) AS w
  FROM (SELECT *,
          CASE reliability WHEN 'A' THEN CAST(0.95 AS DOUBLE) WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.70 WHEN 'D' THEN 0.50
               WHEN 'E' THEN 0.25 WHEN 'F' THEN 0.40 ELSE 0.0 END AS r,
          CASE credibility WHEN '1' THEN CAST(1.00 AS DOUBLE) WHEN '2' THEN 0.85 WHEN '3' THEN 0.65 WHEN '4' THEN 0.40
               WHEN '5' THEN 0.15 WHEN '6' THEN 0.50 ELSE 0.0 END AS c,
          (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(observed_at)) / 1e6 AS age,
          CASE WHEN source LIKE 'ct-search/%' THEN 'ct_logs' WHEN source LIKE 'pdns/%' THEN 'passive_dns' ELSE source END AS grp
        FROM obs)),
per_group AS (
  SELECT subject, grp, max(w) AS w, count(*) AS n, count(*) FILTER (conflict) AS nc, max(CAST(has_artifact AS INTEGER)) AS art
  FROM weighed GROUP BY subject, grp),
scored AS (
  SELECT subject, CAST(sum(n) AS BIGINT) AS n_obs, CAST(sum(nc) AS BIGINT) AS n_conflicts, count(*) AS n_groups,
         max(art) AS art, 1 - product(1 - w) AS raw FROM per_group GROUP BY subject),
conf AS (
  SELECT *, least(CASE WHEN art > 0 THEN pen ELSE least(pen, 0.5) END, 0.999) AS confidence
  FROM (SELECT *, raw * (1 - 0.25 * least(1.0, n_conflicts / n_obs)) AS pen FROM scored))"""


def suffix_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rule lines in the public list's format, made from ``nation``: country-like endings, second-level ones, wildcards and exceptions."""
    n = table(spark, sf, "nation")
    cc = F.concat(F.lower(F.substring("n_name", 1, 2)), F.col("n_nationkey").cast("string"))
    lines = n.select(F.explode(F.array(
        F.concat(F.lit("// "), F.col("n_name")), F.lit(""), cc, F.concat(F.lit("com."), cc), F.concat(F.lit("*.w."), cc, F.lit("  // wildcard")),
        F.concat(F.lit("!city.w."), cc), F.lit("com"), F.lit("net"), F.lit("org"), F.lit("co"), F.lit("com.co"), F.lit("uk"), F.lit("co.uk"))).alias("value"))
    return lines


SUFFIX_RULES = """
cc AS (SELECT lower(substr(n_name, 1, 2)) || n_nationkey AS c FROM nation),
rules(suffix, kind) AS (
  SELECT c, 0 FROM cc UNION ALL SELECT 'com.' || c, 0 FROM cc UNION ALL SELECT 'w.' || c, 1 FROM cc UNION ALL SELECT 'city.w.' || c, 2 FROM cc
  UNION ALL SELECT unnest(['com', 'net', 'org', 'co', 'com.co', 'uk', 'co.uk']), 0)"""


def captures(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    return p.select(
        "page_id", F.col("url").alias("original"),
        pick(["200", "301", "404", "403", "503", "0", "204"], pid % 7).cast("int").alias("status"),
        F.date_format(F.timestamp_seconds(F.lit(1262304000) + (pid * 7919 % 500000) * 1000), "yyyyMMddHHmmss").alias("stamp"))


CAPTURES = """
captures AS (
  SELECT page_id, url AS original,
         list_extract([200, 301, 404, 403, 503, 0, 204], CAST(page_id % 7 + 1 AS INTEGER)) AS status,
         strftime(make_timestamp(CAST((1262304000 + (page_id * 7919 % 500000) * 1000) * 1000000 AS BIGINT)), '%Y%m%d%H%M%S') AS stamp,
         lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host
  FROM pages)"""


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, host of every page."""
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).alias("host"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation -> region and supplier -> nation edges, plus customer -> order."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    n, o = table(spark, sf, "nation"), table(spark, sf, "orders")

    def edge(df: DataFrame, a: str, ac: str, b: str, bc: str, t: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ac)).alias("from_id"), F.concat(F.lit(b), F.col(bc)).alias("to_id"),
                         F.lit(t).alias("type"), (F.col(ac) % 5 == 0).alias("heuristic"),
                         F.when(F.col(ac) % 7 == 0, F.lit(0.9)).otherwise(F.lit(0.0)).alias("confidence"))
    all_ = (edge(c, "c", "c_custkey", "n", "c_nationkey", "located_in")
            .unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "located_in"))
            .unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey", "part_of"))
            .unionByName(edge(o, "o", "o_orderkey", "c", "o_custkey", "owned_by")))
    return all_.withColumn("id", keys.relation_id(F.col("from_id"), F.col("to_id"), F.col("type")))


EDGES = """
edges0 AS (
  SELECT 'c' || c_custkey AS from_id, 'n' || c_nationkey AS to_id, 'located_in' AS type, c_custkey AS k FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', s_suppkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', n_nationkey FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'owned_by', o_orderkey FROM orders),
edges AS (
  SELECT from_id, to_id, type, k % 5 = 0 AS heuristic, CASE WHEN k % 7 = 0 THEN 0.9 ELSE 0.0 END AS confidence,
         substr(sha256(from_id || chr(0) || to_id || chr(0) || type), 1, 32) AS id FROM edges0),
und AS (SELECT from_id AS src, to_id AS dst FROM edges UNION SELECT to_id, from_id FROM edges)"""


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    eid = F.col("event_id")
    return e.select(
        "event_id", "ts", pick(["ct-search", "rdap", "whois"], eid % 3).alias("module"),
        F.concat(F.lit("h"), F.col("user_id") % 20, F.lit(".example.net")).alias("host"),
        F.when(F.col("event_type") == "error", F.when(eid % 2 == 0, 503).otherwise(429)).otherwise(200).alias("status"),
        (eid % 17 != 0).alias("allowed"), (eid % 5 == 0).alias("from_cache"), (eid % 4).cast("int").alias("retries"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.concat(F.lit("s"), F.col("user_id") % 8).alias("scan_id"), (F.col("value") * 100).cast("long").alias("cents"))


REQUEST_LOG = """
request_log AS (
  SELECT event_id, ts, list_extract(['ct-search','rdap','whois'], CAST(event_id % 3 + 1 AS INTEGER)) AS module,
         'h' || (user_id % 20) || '.example.net' AS host,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 429 END ELSE 200 END AS status,
         event_id % 17 <> 0 AS allowed, event_id % 5 = 0 AS from_cache, event_id % 4 AS retries,
         CAST(floor(value * 10) AS BIGINT) AS duration_ms, 's' || (user_id % 8) AS scan_id
  FROM events)"""


def geo_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Three providers' claims per customer."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    base = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .withColumn("provider", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    ck, p, nk = F.col("c_custkey"), F.col("provider"), F.col("c_nationkey")
    return base.select(
        F.concat(F.lit("a"), ck).alias("addr"), F.concat(F.lit("p"), p).alias("provider"),
        F.when((ck % 5 == 0) & (p == 2), "ZZ").when((ck % 11 == 0) & (p == 1), "").otherwise(F.col("n_name")).alias("country"),
        F.when(ck % 3 == p, F.col("r_name")).otherwise(F.col("n_name")).alias("region"),
        F.concat(F.lit("city"), (ck % 4) * (p + 1)).alias("city"), F.col("c_mktsegment").alias("org"),
        F.concat(F.lit("AS"), ck % 100 + p % 2).alias("asn"),
        F.when((ck % 7 == 0) & (p == 0), None).otherwise((nk * 3.0 - 30) + p * 0.25).alias("lat"),
        F.when((ck % 7 == 0) & (p == 0), None).otherwise((nk * 7.0 - 80) + p * 0.5).alias("lon"),
        ((ck % 9 == 0) & (p == 1)).alias("anycast"))


GEO_CLAIMS = """
geo_claims AS (
  SELECT 'a' || c_custkey AS addr, 'p' || p AS provider,
         CASE WHEN c_custkey % 5 = 0 AND p = 2 THEN 'ZZ' WHEN c_custkey % 11 = 0 AND p = 1 THEN '' ELSE n_name END AS country,
         CASE WHEN c_custkey % 3 = p THEN r_name ELSE n_name END AS region,
         'city' || ((c_custkey % 4) * (p + 1)) AS city, c_mktsegment AS org, 'AS' || (c_custkey % 100 + p % 2) AS asn,
         CASE WHEN c_custkey % 7 = 0 AND p = 0 THEN NULL ELSE (c_nationkey * CAST(3.0 AS DOUBLE) - 30) + p * CAST(0.25 AS DOUBLE) END AS lat,
         CASE WHEN c_custkey % 7 = 0 AND p = 0 THEN NULL ELSE (c_nationkey * CAST(7.0 AS DOUBLE) - 80) + p * CAST(0.5 AS DOUBLE) END AS lon,
         (c_custkey % 9 = 0 AND p = 1) AS anycast
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1), (2)) v(p))"""


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """One synthetic v4 address per order line part key and order key."""
    li = table(spark, sf, "lineitem")
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return li.select("l_orderkey", "l_linenumber", F.concat_ws(
        ".", pick(["10", "172", "192", "198", "203", "100", "8", "127"], a % 8), (b % 256).cast("string"),
        (a % 256).cast("string"), (F.col("l_suppkey") % 256).cast("string")).alias("addr"))


ADDRESSES = """
addresses AS (
  SELECT l_orderkey, l_linenumber,
         list_extract(['10','172','192','198','203','100','8','127'], CAST(l_orderkey % 8 + 1 AS INTEGER)) || '.' || (l_partkey % 256)
         || '.' || (l_orderkey % 256) || '.' || (l_suppkey % 256) AS addr,
         CAST(list_extract([10,172,192,198,203,100,8,127], CAST(l_orderkey % 8 + 1 AS INTEGER)) AS BIGINT) * 16777216
         + (l_partkey % 256) * 65536 + (l_orderkey % 256) * 256 + (l_suppkey % 256) AS ipn
  FROM lineitem)"""
