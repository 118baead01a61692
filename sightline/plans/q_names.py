"""Canonicalisation, key and name queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import canon, keys, names, net
from sightline.functions.grades import capture_ok
from sightline.functions.udfs import stable_json
from sightline.operators import canonicalise as cz
from sightline.operators.suffix import suffix_rules, with_in_domain, with_registrable
from sightline.plans import views
from sightline.plans.catalog import query, table


def _branch(df: DataFrame, kind: str, value: Column, key: str) -> DataFrame:
    d = df.select(F.col(key), F.lit(kind).alias("type"), value.alias("value"))
    return cz.canonicalise(d, types=[kind]).select(key, "canonical")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query("c01_domain", f"""
SELECT page_id, CASE page_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '10.1.' || (page_id % 256) || '.7' ELSE {_HOST} END AS canonical FROM pages""")
def c01(spark, sf):
    p = table(spark, sf, "pages")
    h, pid = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1), F.col("page_id")
    v = (F.when(pid % 5 == 0, F.concat(F.lit(" "), F.upper("url"))).when(pid % 5 == 1, F.concat(F.upper(h), F.lit(".:443/x?y")).alias("v"))
         .when(pid % 5 == 2, F.concat(h, F.lit("."))).when(pid % 5 == 3, F.concat(h, F.lit("..x")))
         .otherwise(F.concat(F.lit("https://10.1."), pid % 256, F.lit(".7:8080/"))))
    v = F.when(pid % 5 == 1, F.concat(F.upper(h), F.lit(":443/x?y"))).otherwise(v)
    return _branch(p, "domain", v, "page_id")


@query("c02_ip", "WITH " + views.ADDRESSES + """
SELECT l_orderkey, l_linenumber, addr AS raw, CASE l_linenumber % 4 WHEN 2 THEN NULL
   WHEN 3 THEN '2001:db8::' || format('{:x}', l_orderkey % 60000 + 1) ELSE addr END AS canonical FROM addresses""")
def c02(spark, sf):
    a = views.addresses(spark, sf)
    n = F.col("l_linenumber") % 4
    v6 = F.concat(F.lit("[2001:0DB8:0:0:0:0:0:"), F.hex(F.col("l_orderkey") % 60000 + 1), F.lit("]:443"))
    v = (F.when(n == 0, F.concat("addr", F.lit(":80"))).when(n == 1, F.concat(F.lit("::FFFF:"), F.col("addr")))
         .when(n == 2, F.concat(F.lit("0"), F.col("addr"))).otherwise(v6))
    d = a.select("l_orderkey", "l_linenumber", F.col("addr").alias("raw"), F.lit("ip").alias("type"), v.alias("value"))
    return cz.canonicalise(d, types=["ip"]).select("l_orderkey", "l_linenumber", "raw", "canonical")


@query("c03_cidr", "WITH " + views.ADDRESSES + """,
m AS (SELECT *, 8 + l_linenumber * 3 AS bits FROM addresses),
n AS (SELECT *, (ipn // CAST(pow(2, 32 - bits) AS BIGINT)) * CAST(pow(2, 32 - bits) AS BIGINT) AS net FROM m)
SELECT l_orderkey, l_linenumber, addr, (net // 16777216) || '.' || (net // 65536 % 256) || '.' || (net // 256 % 256) || '.' || (net % 256) || '/' || bits AS canonical FROM n""")
def c03(spark, sf):
    a = views.addresses(spark, sf)
    v = F.concat_ws("/", "addr", (F.col("l_linenumber") * 3 + 8).cast("string"))
    d = a.select("l_orderkey", "l_linenumber", "addr", F.lit("cidr").alias("type"), v.alias("value"))
    return cz.canonicalise(d, types=["cidr"]).select("l_orderkey", "l_linenumber", "addr", "canonical")


@query("c03_widen_to_cidr", "WITH " + views.ADDRESSES + "SELECT l_orderkey, l_linenumber, addr || '/32' AS cidr FROM addresses")
def c03b(spark, sf):
    return views.addresses(spark, sf).select("l_orderkey", "l_linenumber", canon.widen_to_cidr(F.col("addr")).alias("cidr"))


@query("c04_asn", """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 OR o_orderkey = 0 THEN NULL ELSE 'AS' || o_orderkey END AS canonical FROM orders""")
def c04(spark, sf):
    k = F.col("o_custkey") % 4
    v = F.concat(F.when(k == 0, "as").when(k == 1, "asn").when(k == 2, "As00").otherwise("AS"), F.col("o_orderkey"))
    return _branch(table(spark, sf, "orders"), "asn", v, "o_orderkey")


_URL_SQL = """
u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, """ + _HOST + """ AS host,
             regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
u2 AS (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'ref')) AS kept FROM u)"""


@query("c05_url", "WITH " + _URL_SQL + """
SELECT page_id, scheme || '://' || host || CASE WHEN page_id % 3 = 2 THEN ':8443' ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END
       || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical FROM u2""")
def c05(spark, sf):
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    port = F.when(pid % 3 == 0, F.when(F.col("url").startswith("https"), ":443").otherwise(":80")).when(pid % 3 == 2, ":8443").otherwise("")
    scheme, host, rest = (F.regexp_extract("url", "^([a-zA-Z]+)://([^/?#]+)(.*)$", i) for i in (1, 2, 3))
    return _branch(p, "url", F.concat(F.upper(scheme), F.lit("://"), F.upper(host), port, rest), "page_id")


@query("c06_strip_tracking", "WITH " + _URL_SQL + "SELECT page_id, array_to_string(kept, '&') AS query FROM u2")
def c06(spark, sf):
    return table(spark, sf, "pages").select("page_id", canon.strip_tracking(F.regexp_extract("url", "\\?([^#]*)", 1)).alias("query"))


_MENTIONS = "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+'"


@query("c07_email", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {_MENTIONS})) AS raw FROM documents)
SELECT doc_id, raw, regexp_extract(raw, '^(.+)@', 1) || '@' || lower(regexp_extract(raw, '@([^@]+)$', 1)) AS canonical FROM m""")
def c07(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+"), 0)).alias("raw"))
    d = m.select("doc_id", "raw", F.lit("email").alias("type"),
                 F.concat(F.regexp_extract("raw", "^(.+)@", 1), F.lit("@"), F.upper(F.regexp_extract("raw", "@(.*)$", 1)), F.lit(".")).alias("value"))
    return cz.canonicalise(d, types=["email"]).select("doc_id", "raw", "canonical")


@query("c08_username", "SELECT c_custkey, c_name AS canonical FROM customer")
def c08(spark, sf):
    return _branch(table(spark, sf, "customer"), "username", F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")), "c_custkey")


@query("c09_account", """
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lower(c_mktsegment) || ':' || c_name END AS canonical FROM customer""")
def c09(spark, sf):
    v = F.concat(F.when(F.col("c_custkey") % 9 == 0, "-").otherwise(""), F.col("c_mktsegment"), F.lit(" : "), F.col("c_name"))
    return _branch(table(spark, sf, "customer"), "account", v, "c_custkey")


@query("c10_phone", """
SELECT c_custkey, CASE WHEN c_custkey < 100000000 THEN '+62812' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS canonical FROM customer WHERE c_custkey % 3 <> 2
UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 2""")
def c10(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    k = F.col("c_custkey") % 3
    v = (F.when(k == 0, F.concat(F.lit("(+62) 812 "), d)).when(k == 1, F.concat(F.lit("62-812-"), F.substring(d, 1, 4), F.lit(" "), F.substring(d, 5, 4)))
         .otherwise(F.concat(F.lit("0"), d)))
    return _branch(table(spark, sf, "customer"), "phone", v, "c_custkey")


@query("c11_name_text", "SELECT p_partkey, p_name || ' ' || p_brand AS canonical FROM part")
def c11(spark, sf):
    v = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " \t "), F.lit(" \n "), F.col("p_brand"))
    return _branch(table(spark, sf, "part"), "org", v, "p_partkey")


@query("c12_geo", """
SELECT c_custkey, CASE WHEN c_custkey % 200 >= 90 THEN NULL ELSE format('{:.6f}', c_custkey % 200 + 0.5) || ',-' || format('{:.6f}', CAST(c_custkey % 180 AS DOUBLE)) || CASE WHEN c_custkey % 2 = 0 THEN '@5' ELSE '' END END AS canonical
FROM customer""")
def c12(spark, sf):
    k = F.col("c_custkey")
    v = F.concat((k % 200).cast("string"), F.lit(".50, -"), (k % 180).cast("string"), F.when(k % 2 == 0, "@5").otherwise(""))
    return _branch(table(spark, sf, "customer"), "geo", v, "c_custkey")


@query("c13_file_digest", "SELECT doc_id, sha256(text) AS canonical FROM documents")
def c13(spark, sf):
    v = F.concat(F.lit("0x"), F.upper(F.sha2(F.col("text").cast("binary"), 256)))
    return _branch(table(spark, sf, "documents"), "file", v, "doc_id")


@query("c14_hash", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'md5:' || md5(text) WHEN 1 THEN 'sha1:' || sha1(text) WHEN 2 THEN 'sha256:' || sha256(text) END AS canonical FROM documents""")
def c14(spark, sf):
    b, k = F.col("text").cast("binary"), F.col("doc_id") % 4
    v = (F.when(k == 0, F.upper(F.md5(b))).when(k == 1, F.concat(F.lit("SHA1:0x"), F.sha1(b))).when(k == 2, F.sha2(b, 256))
         .otherwise(F.substring(F.md5(b), 1, 31)))
    return _branch(table(spark, sf, "documents"), "hash", v, "doc_id")


@query("c15_cve", """
SELECT o_orderkey, CASE WHEN 1990 + o_orderkey % 40 < 1999 THEN NULL ELSE 'CVE-' || (1990 + o_orderkey % 40) || '-' || CASE WHEN o_custkey < 10000 THEN lpad(CAST(o_custkey AS VARCHAR), 4, '0') ELSE CAST(o_custkey AS VARCHAR) END END AS canonical FROM orders""")
def c15(spark, sf):
    num = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    v = F.concat(F.lit("cve-"), (F.col("o_orderkey") % 40 + 1990).cast("string"), F.lit("-"), num)
    return _branch(table(spark, sf, "orders"), "cve", v, "o_orderkey")


@query("c16_wallet")
def c16(spark, sf):
    h, k = F.substring(F.sha2(F.col("c_name").cast("binary"), 256), 1, 40), F.col("c_custkey") % 3
    v = F.when(k == 0, F.concat(F.lit("ETH:0x"), h)).when(k == 1, F.concat(F.lit("btc:"), F.upper(h))).otherwise(F.concat(F.lit("TRX: "), h))
    return _branch(table(spark, sf, "customer"), "wallet", v, "c_custkey")


#: Addresses in mixed case as the public proposal on address checksums prints them.
_CHECKSUMMED = ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB",
                "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb", "0x52908400098527886E0F7030069857D2E4169EE7", "0xde709f2102306220921060314715629080e2fb77"]


@query("c16_wallet_checksum", f"SELECT c_custkey, 'ethereum:' || list_extract({_CHECKSUMMED}, CAST(c_custkey % 6 + 1 AS INTEGER)) AS canonical FROM customer")
def c16b(spark, sf):
    known, k = views.pick(_CHECKSUMMED, F.col("c_custkey") % 6), F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("eth:"), F.lower(known))).when(k % 4 == 1, F.concat(F.lit(" Ethereum:0x"), F.upper(F.substring(known, 3, 40)))).otherwise(F.concat(F.lit("ETH: "), known))
    return _branch(table(spark, sf, "customer"), "wallet", v, "c_custkey")


@query("c17_transaction", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'btc:' || sha256(CAST(o_orderkey AS VARCHAR)) END AS canonical FROM orders""")
def c17(spark, sf):
    h = F.upper(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))
    return _branch(table(spark, sf, "orders"), "tx", F.when(F.col("o_orderkey") % 5 == 0, h).otherwise(F.concat(F.lit("BTC:"), h)), "o_orderkey")


@query("c18_app_ioc", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE lower(p_name) END AS canonical FROM part")
def c18(spark, sf):
    v = F.when(F.col("p_partkey") % 10 == 0, "   ").otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    return _branch(table(spark, sf, "part"), "ioc", v, "p_partkey")


@query("c19_repository", "SELECT p_partkey, 'forge.example/' || p_brand || '/' || replace(p_name, ' ', '-') AS canonical FROM part")
def c19(spark, sf):
    v = F.concat(F.lit("https://www.Forge.EXAMPLE/"), F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit(".git"))
    return _branch(table(spark, sf, "part"), "repo", v, "p_partkey")


@query("c20_package", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pkg:npm/' || lower(p_brand) WHEN 1 THEN 'pkg:generic/' || lower(p_brand) || '/' || lower(p_name) END AS canonical FROM part""")
def c20(spark, sf):
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.concat(F.lit("pkg:NPM/"), F.col("p_brand"))).when(k == 1, F.concat("p_brand", F.lit("@"), F.upper("p_name"))).otherwise(F.concat(F.lit("@"), F.col("p_name")))
    return _branch(table(spark, sf, "part"), "package", v, "p_partkey")


@query("c21_text", "SELECT doc_id, nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS canonical FROM documents")
def c21(spark, sf):
    return _branch(table(spark, sf, "documents"), "text", F.col("text"), "doc_id")


@query("c22_infer_type", "WITH " + views.ADDRESSES + """
SELECT l_orderkey, l_linenumber, addr, CASE l_linenumber WHEN 1 THEN 'ip' WHEN 2 THEN CASE WHEN l_orderkey = 0 THEN NULL ELSE 'asn' END WHEN 3 THEN 'cidr' WHEN 4 THEN 'cve'
       WHEN 5 THEN 'email' WHEN 6 THEN 'subdomain' ELSE 'domain' END AS inferred_type FROM addresses""")
def c22(spark, sf):
    a = views.addresses(spark, sf)
    n, ok = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    v = (F.when(n == 1, F.concat("addr", F.lit(":8080"))).when(n == 2, F.concat(F.lit(" as"), ok)).when(n == 3, F.concat("addr", F.lit("/24")))
         .when(n == 4, "CVE-2021-44228").when(n == 5, F.concat(F.lit("u"), ok, F.lit("@mail.example.com")))
         .when(n == 6, F.concat(F.lit("h"), ok, F.lit(".shop.example.co.uk"))).otherwise(F.concat(F.lit("Shop"), F.lit("-x.co.uk"))))
    return cz.infer_type(a.withColumn("v", v), "v", suffix_rules(views.suffix_list(spark, sf))).select(
        "l_orderkey", "l_linenumber", "addr", F.when((n == 2) & (F.col("l_orderkey") == 0), None).otherwise(F.col("inferred_type")).alias("inferred_type"))


_B32 = """array_to_string(list_transform(range(0, 26), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + CAST(list_sum(
   list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '')"""


@query("c23_entity_ids", f"""
WITH h AS (SELECT c_custkey, array_to_string(list_transform(string_split(sha256('account' || chr(0) || c_name), ''),
   lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM customer)
SELECT c_custkey, {_B32} AS id FROM h""")
def c23(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.lit("account").alias("type"), F.col("c_name").alias("value"))
    return keys.with_ids(d, "entity").select("c_custkey", "id")


@query("c23_observation_ids", "WITH " + views.OBS + "SELECT event_id, id FROM obs")
def c23b(spark, sf):
    o = views.obs(spark, sf).drop("id")
    src = F.struct(F.regexp_extract("source", "^([^/]*)/", 1).alias("module"), F.regexp_extract("source", "/([^:]*):", 1).alias("provider"),
                   F.regexp_extract("source", ":(.*)$", 1).alias("method"))
    return keys.with_ids(o.withColumn("source", src), "observation").select("event_id", "id")


@query("c23_relation_ids", "WITH " + views.EDGES + "SELECT from_id, to_id, type, id FROM edges")
def c23c(spark, sf):
    return keys.with_ids(views.edges(spark, sf).drop("id"), "relation").select("from_id", "to_id", "type", "id")


@query("c24_object_key", """
SELECT c_custkey, lower(c_mktsegment) || chr(31) || 'zz' || chr(31) || 'zzz' AS list_key, 'a' || chr(28) || c_name || chr(29) || 'b' || chr(28) || c_nationkey AS map_key,
       'true' || chr(30) || c_nationkey || chr(30) || 'x' AS json_key, CAST(c_nationkey AS VARCHAR) AS int_key FROM customer""")
def c24(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.array(F.lit("zzz"), F.lower("c_mktsegment"), F.lit("zz")).alias("l"),
        F.create_map(F.lit("b"), F.col("c_nationkey").cast("string"), F.lit("a"), F.col("c_name")).alias("m"),
        F.concat(F.lit("[true, "), F.col("c_nationkey"), F.lit(', "x"]')).alias("j"), "c_nationkey")
    return c.select("c_custkey", keys.object_key(c, "l").alias("list_key"), keys.object_key(c, "m").alias("map_key"),
                    stable_json("j").alias("json_key"), keys.object_key(c, "c_nationkey").alias("int_key"))


@query("c24_double_key", """
SELECT l_orderkey, l_linenumber, CASE WHEN x < 1000000 THEN CAST(x AS BIGINT)::VARCHAR
  ELSE (SELECT d[1] || CASE WHEN len(rtrim(d, '0')) > 1 THEN '.' || rtrim(d[2:], '0') ELSE '' END || 'e+' || lpad((len(d) - 1)::VARCHAR, 2, '0') FROM (SELECT CAST(x AS BIGINT)::VARCHAR AS d)) END AS key
FROM (SELECT *, round(l_extendedprice * 1000) AS x FROM lineitem)""")
def c24b(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 1000).alias("x"))
    return li.select("l_orderkey", "l_linenumber", keys.object_key(li, "x").alias("key"))


@query("c25_content_entities", f"""
WITH h AS (SELECT doc_id, sha256(text) AS value FROM documents),
b AS (SELECT doc_id, value, array_to_string(list_transform(string_split(sha256('file' || chr(0) || value), ''),
   lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM h)
SELECT doc_id, value, {_B32} AS id FROM b""")
def c25(spark, sf):
    return keys.content_entities(table(spark, sf, "documents").select("doc_id", "text"), "text", "file").select("doc_id", "value", "id")


# --- whole canonicaliser with quarantine --------------------------------------------------------


@query("c00_canonicalise_counts", f"""
WITH e AS (SELECT unnest(regexp_extract_all(text, {_MENTIONS})) AS v FROM documents)
SELECT 'email' AS type, TRUE AS good, count(*) AS n FROM e
UNION ALL SELECT 'url', TRUE, count(*) FROM pages UNION ALL SELECT 'url', FALSE, count(*) FROM part
UNION ALL SELECT 'username', TRUE, count(*) FROM customer""")
def c00(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    mails = docs.select(F.lit("email").alias("type"), F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+"), 0)).alias("value"))
    mixed = (mails.unionByName(pages.select(F.lit("url").alias("type"), F.col("url").alias("value")))
             .unionByName(table(spark, sf, "part").select(F.lit("url").alias("type"), F.col("p_name").alias("value")))
             .unionByName(table(spark, sf, "customer").select(F.lit("username").alias("type"), F.col("c_name").alias("value"))))
    good, bad = cz.split_quarantine(cz.canonicalise(mixed, types=["email", "url", "username"]))
    return (good.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(True))
            .unionByName(bad.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(False))))


# --- F* -------------------------------------------------------------------------------------------


_NAMES_SQL = "WITH " + views.SUFFIX_RULES + """,
n AS (SELECT c_custkey, (CASE WHEN c_custkey % 9 < 5 THEN 'a' || (c_custkey % 50) || '.' WHEN c_custkey % 9 = 5 THEN 'x.y.' ELSE '' END)
        || (CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'city.' ELSE 'foo' || (c_custkey % 40) || '.' END)
        || (CASE c_custkey % 8 WHEN 0 THEN 'com.co' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'w.' || c WHEN 3 THEN 'com.' || c WHEN 4 THEN c WHEN 5 THEN 'unlisted' WHEN 6 THEN 'com' ELSE 'w.' || c END) AS host
      FROM customer JOIN (SELECT n_nationkey, lower(substr(n_name, 1, 2)) || n_nationkey AS c FROM nation) ON n_nationkey = c_nationkey),
l AS (SELECT DISTINCT host, string_split(host, '.') AS w FROM n),
s AS (SELECT host, len(w) AS n, unnest(range(0, len(w))) AS depth, w FROM l),
m AS (SELECT host, n, CASE kind WHEN 2 THEN n - depth - 1 WHEN 0 THEN n - depth WHEN 1 THEN CASE WHEN depth > 0 THEN n - depth + 1 END END AS k, kind = 2 AS spared
      FROM s JOIN rules ON rules.suffix = array_to_string(w[depth + 1:], '.')),
b AS (SELECT l.host, len(w) AS n, w, coalesce(max(k) FILTER (spared), max(k), 1) AS k FROM l LEFT JOIN m ON m.host = l.host GROUP BY l.host, w),
r AS (SELECT host, CASE WHEN n > k THEN array_to_string(w[CAST(n - k AS INTEGER):], '.') END AS reg, CASE WHEN n > k THEN array_to_string(w[CAST(n - k + 1 AS INTEGER):], '.') END AS suffix FROM b)
"""


def _suffix_names(spark, sf) -> DataFrame:
    """Customers with a host below suffixes of every kind."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lower(F.substring("n_name", 1, 2)), F.col("n_nationkey")).alias("cc")), "c_nationkey")
    k = F.col("c_custkey")
    head = F.when(k % 9 < 5, F.concat(F.lit("a"), k % 50, F.lit("."))).when(k % 9 == 5, "x.y.").otherwise("")
    body = F.when(k % 11 == 0, "").when(k % 11 == 1, "city.").otherwise(F.concat(F.lit("foo"), k % 40, F.lit(".")))
    w = F.concat(F.lit("w."), F.col("cc"))
    tail = (F.when(k % 8 == 0, "com.co").when(k % 8 == 1, "co.uk").when(k % 8 == 2, w).when(k % 8 == 3, F.concat(F.lit("com."), F.col("cc")))
            .when(k % 8 == 4, F.col("cc")).when(k % 8 == 5, "unlisted").when(k % 8 == 6, "com").otherwise(w))
    return c.select("c_custkey", F.concat(head, body, tail).alias("host"))


@query("f01_registrable", _NAMES_SQL + """
SELECT c_custkey, coalesce(reg, n.host) AS registrable, coalesce(suffix, '') AS suffix, CASE WHEN reg = n.host THEN 'domain' ELSE 'subdomain' END AS host_class
FROM n JOIN r ON r.host = n.host""")
def f01(spark, sf):
    rules = suffix_rules(views.suffix_list(spark, sf))
    return with_registrable(_suffix_names(spark, sf), "host", rules).select("c_custkey", "registrable", "suffix", "host_class")


@query("f02_in_domain", _NAMES_SQL + """
SELECT c_custkey, coalesce(reg, n.host) = 'foo8.com.co' OR coalesce(reg, n.host) LIKE '%.foo8.com.co' AS inside FROM n JOIN r ON r.host = n.host""")
def f02(spark, sf):
    rules = suffix_rules(views.suffix_list(spark, sf))
    return with_in_domain(_suffix_names(spark, sf), "host", "www.foo8.com.co", rules).select("c_custkey", "inside")


@query("f03_names_under", f"""
SELECT page_id, {_HOST} AS host FROM pages WHERE page_id % 4 IN (0, 1) AND {_HOST} LIKE '%.example.net'""")
def f03(spark, sf):
    h, k = views.hosts(spark, sf), F.col("page_id") % 4
    name = (F.when(k == 0, F.concat(F.upper("host"), F.lit("."))).when(k == 1, F.concat(F.lit(" "), F.col("host")))
            .when(k == 2, F.concat(F.lit("*."), F.col("host"))).otherwise("example.net"))
    return names.names_under(h.select("page_id", name.alias("name")), "example.net").select("page_id", "host")


@query("f04_dn_component", """
SELECT s_suppkey, s_name || ', Inc' AS org, 'CN ' || s_suppkey AS cn,
       CASE s_suppkey % 3 WHEN 0 THEN 'Friendly ' || s_suppkey WHEN 1 THEN s_name || ', Inc' ELSE s_name || ', Inc' END AS label FROM supplier""")
def f04(spark, sf):
    dn = F.concat(F.lit("c=US, O="), F.col("s_name"), F.lit("\\, Inc, CN=CN "), F.col("s_suppkey"))
    friendly = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Friendly "), F.col("s_suppkey"))).otherwise(" ")
    return table(spark, sf, "supplier").select("s_suppkey", names.dn_component(dn, "O").alias("org"), names.dn_component(dn, "cn").alias("cn"),
                                               names.issuer_label(friendly, dn).alias("label"))


@query("f05_serial", "SELECT p_partkey, upper(sha256(p_name)) AS serial FROM part")
def f05(spark, sf):
    h = F.regexp_replace(F.sha2(F.col("p_name").cast("binary"), 256), "(..)(?=.)", "$1:")
    return table(spark, sf, "part").select("p_partkey", names.serial(F.concat(F.lit(" "), F.regexp_replace(h, ":0", " 0"))).alias("serial"))


@query("f06_capture_time", "WITH " + views.CAPTURES + """
SELECT page_id, epoch_us(strptime(stamp, '%Y%m%d%H%M%S')) AS at FROM captures""")
def f06(spark, sf):
    return views.captures(spark, sf).select("page_id", F.unix_micros(names.capture_time(F.col("stamp"))).alias("at"))


_DATE_CASES = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy",
               "dd MMM yyyy", "MMM dd yyyy", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd' (note)'", "dd-MMM-yy"]


@query("f07_parse_reg_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 11 THEN NULL ELSE epoch_us(o_orderdate) END AS at FROM orders""")
def f07(spark, sf):
    d = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 12
    v = F.when(k == 11, "REDACTED FOR PRIVACY")
    for i, f in enumerate(_DATE_CASES):
        v = v.when(k == i, F.date_format("o_orderdate", f))
    return d.select("o_orderkey", F.unix_micros(names.parse_reg_date(v)).alias("at"))


@query("f08_parse_registry_date", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(o_orderdate) - 7200000000 ELSE epoch_us(o_orderdate) END AS at FROM orders""")
def f08(spark, sf):
    k = F.col("o_orderkey") % 4
    v = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+0200'"))
         .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon"))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_micros(names.parse_registry_date(v)).alias("at"))


@query("f09_withheld", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {_MENTIONS})) AS raw FROM documents)
SELECT doc_id, raw, doc_id % 4 = 1 AS hidden, CASE WHEN doc_id % 4 = 0 THEN lower(raw) END AS email FROM m""")
def f09(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+"), 0)).alias("raw"))
    k = F.col("doc_id") % 4
    v = (F.when(k == 0, F.concat(F.lit(" "), F.upper("raw"))).when(k == 1, "Redacted for Privacy").when(k == 2, F.concat(F.lit("xxx"), F.col("raw")))
         .otherwise(F.concat(F.lit("mail: "), F.col("raw"))))
    return m.select("doc_id", "raw", names.withheld(v).alias("hidden"), names.extract_email(v).alias("email"))


@query("f12_expiry_flags", """
SELECT o_orderkey, d < 0 AS expired, d BETWEEN 0 AND 30 AS expiring, CASE WHEN d BETWEEN 0 AND 30 THEN CAST(floor(d) AS INTEGER) END AS days_to_expiry
FROM (SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-15 12:00:00')) / 86400e6 AS d FROM orders)""")
def f12(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "expires")
    return names.expiry_flags(o, "1998-06-15 12:00:00").select("o_orderkey", "expired", "expiring", "days_to_expiry")


@query("f13_hold_severity", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'medium' ELSE 'info' END AS registry, CASE WHEN o_orderstatus = 'P' THEN 'low' WHEN o_orderstatus = 'F' THEN 'low' ELSE 'info' END AS plain FROM orders""")
def f13(spark, sf):
    st = F.array(F.lit("ok"), F.when(F.col("o_orderstatus") == "F", "client Hold").when(F.col("o_orderstatus") == "P", "Expired").otherwise("client transfer prohibited"))
    return table(spark, sf, "orders").select("o_orderkey", names.hold_severity(st).alias("registry"), names.hold_severity(st, False).alias("plain"))


@query("f14_response_class", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'empty' WHEN 2 THEN 'thick' ELSE 'thin' END AS response_class FROM documents""")
def f14(spark, sf):
    k = F.col("doc_id") % 4
    t = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " You have exceeded the query RATE limit").when(k == 1, " No match for domain").otherwise(" Domain Name: x"))
    return table(spark, sf, "documents").select("doc_id", names.response_class(t, k == 2).alias("response_class"))


@query("f15_referral_host", f"""
SELECT page_id, {_HOST} || CASE WHEN page_id % 2 = 0 THEN ':43' ELSE ':4343' END AS referral FROM pages WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 = 0""")
def f15(spark, sf):
    h, pid = views.hosts(spark, sf), F.col("page_id")
    v = F.when(pid % 5 == 0, "whois").when(pid % 2 == 0, F.concat(F.lit("WHOIS://"), F.upper("host"), F.lit("/x"))).otherwise(F.concat("host", F.lit(":4343")))
    return h.select("page_id", names.referral_host(v).alias("referral"))


@query("f16_ptr_name", "WITH " + views.ADDRESSES + """
SELECT l_orderkey, l_linenumber, addr, split_part(addr, '.', 4) || '.' || split_part(addr, '.', 3) || '.' || split_part(addr, '.', 2) || '.' || split_part(addr, '.', 1) || '.in-addr.arpa' AS ptr,
       split_part(addr, '.', 4) || '.' || split_part(addr, '.', 3) || '.' || split_part(addr, '.', 2) || '.' || split_part(addr, '.', 1) AS reversed,
       array_to_string(list_reverse(string_split(lpad(format('{:x}', l_orderkey % 65536), 4, '0'), '')), '.') || '.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.8.b.d.0.1.0.0.2.ip6.arpa' AS ptr6
FROM addresses""")
def f16(spark, sf):
    a = views.addresses(spark, sf)
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("l_orderkey") % 65536)))
    return a.select("l_orderkey", "l_linenumber", "addr", net.ptr_name(F.col("addr")).alias("ptr"), net.reversed_octets(F.col("addr")).alias("reversed"),
                    net.ptr_name(v6).alias("ptr6"))


@query("f17_hosts_in_json", f"""
WITH h AS (SELECT DISTINCT page_id % 5 AS module, {_HOST} AS host FROM pages WHERE page_id % 3 <> 0)
SELECT module, host FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY host) AS rn FROM h) WHERE rn <= 8""")
def f17(spark, sf):
    h = views.hosts(spark, sf)
    raw = F.concat(F.lit('{"a":["'), F.when(F.col("page_id") % 3 == 0, "http").otherwise("HTTPS"), F.lit("://"), F.col("host"),
                   F.lit('/x"],"b":{"c":"https://10.0.0.1/","d":"https://db.internal:8443/q","e":"https://[::1]/"}}'))
    return names.hosts_in_json(h.select((F.col("page_id") % 5).alias("module"), raw.alias("raw")), "raw", "module", 8)


@query("p05_capture_status", "WITH " + views.CAPTURES + "SELECT page_id, status FROM captures WHERE status BETWEEN 200 AND 399 OR status = 403")
def p05(spark, sf):
    return views.captures(spark, sf).where(capture_ok(F.col("status"))).select("page_id", "status")
