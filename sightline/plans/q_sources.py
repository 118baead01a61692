"""Source parsers, media tables and extension points over payloads derived from the given tables.

Each query first writes the raw payload a provider would have sent (JSON, text, HTML)
from table rows, then parses it; the SQL twin states the expected rows directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions import keys
from sightline.functions.keys import rfc3339
from sightline.operators import media
from sightline.operators.skew import spread
from sightline.plans import registry, views
from sightline.plans.catalog import query, table
from sightline.sources import captures as cdx, ct, host_index, logs, network, registration

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


def us(c: str):
    return F.unix_micros(F.col(c))


# --- S1-S5 -----------------------------------------------------------------------------


def _ct_a(spark, sf):
    h, pid = views.hosts(spark, sf), F.col("page_id")
    cert = lambda n: F.struct(
        F.lit(7).alias("issuer_ca_id"), F.concat(F.lit("C=US, O=CA "), pid % 5, F.lit("\\, Ltd, CN=R"), F.lit(n)).alias("issuer_name"),
        F.concat(F.lit("M."), F.col("host")).alias("common_name"),
        F.when(pid % 4 == n, "").otherwise(F.concat(F.upper("host"), F.lit("\r\n*."), F.col("host"), F.lit("\n"), F.col("host"))).alias("name_value"),
        F.concat(F.lit("0a:1b "), F.hex(pid), F.lit(str(n))).alias("serial_number"), F.lit("2024-01-01").alias("not_before"), F.lit("2025-01-01").alias("not_after"))
    return h.select("page_id", F.to_json(F.array(cert(0), cert(1))).alias("raw"))


@query("s01_ct_rows_a", f"""
WITH c AS (SELECT page_id, {_HOST} AS host, unnest([0, 1]) AS n FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = n THEN 'm.' || host ELSE host || '|*.' || host END AS names, 'CA ' || (page_id % 5) || ', Ltd' AS issuer_org,
       '0A1B' || format('{{:X}}', page_id) || n AS serial FROM c""")
def s01(spark, sf):
    return ct.parse_ct_a(_ct_a(spark, sf)).select("page_id", F.array_join("names", "|").alias("names"), "issuer_org", "serial")


@query("s02_ct_issuances_b", f"""
SELECT page_id, {_HOST} || '|*.' || {_HOST} AS names, CASE WHEN page_id % 3 = 0 THEN 'Friendly ' || (page_id % 5) ELSE 'CA ' || (page_id % 5) END AS issuer_org,
       sha256('c' || page_id) AS cert_sha256, page_id % 11 = 0 AS revoked FROM pages""")
def s02(spark, sf):
    h, pid = views.hosts(spark, sf), F.col("page_id")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    both = F.concat(F.col("host"), F.lit('%s*.'), F.col("host"))
    names_ = F.when(pid % 2 == 0, F.concat(F.lit("["), q(F.upper("host")), F.lit(","), q(F.concat(F.lit("*."), F.col("host"))), F.lit("]"))) \
              .otherwise(q(F.concat(F.col("host"), F.lit("\\n*."), F.col("host"))))
    issuer = F.concat(F.lit('{"friendly_name":"'), F.when(pid % 3 == 0, F.concat(F.lit("Friendly "), pid % 5)).otherwise(""), F.lit('","name":"O=CA '), pid % 5, F.lit('"}'))
    raw = F.concat(F.lit('[{"id":"'), pid, F.lit('","cert_sha256":"'), F.upper(F.sha2(F.concat(F.lit("c"), pid).cast("binary"), 256)), F.lit('","dns_names":'), names_,
                   F.lit(',"issuer":'), issuer, F.lit(',"revoked":'), (pid % 11 == 0).cast("string"), F.lit("}]"))
    return ct.parse_ct_b(h.select("page_id", raw.alias("raw"))).select("page_id", F.array_join("names", "|").alias("names"), "issuer_org", "cert_sha256", "revoked")


@query("s03_cdx", "WITH " + views.CAPTURES + "SELECT page_id, original, stamp, status FROM captures WHERE page_id % 6 <> 5")
def s03(spark, sf):
    c = views.captures(spark, sf)
    row = F.to_json(F.array("stamp", "original", F.col("status").cast("string")))
    raw = F.when(F.col("page_id") % 6 == 5, F.concat(F.lit('[["urlkey"],'), row, F.lit("]"))).otherwise(
        F.concat(F.lit('[["timestamp"," Original","statuscode"],'), row, F.lit("]")))
    return cdx.parse_cdx(c.select("page_id", raw.alias("raw")))


@query("s04_host_lines", f"""
WITH l AS (SELECT page_id, page_id % 7 AS source, {_HOST} AS host FROM pages)
SELECT source, host, CASE WHEN page_id % 3 <> 0 THEN '10.0.0.' || (page_id % 250) END AS addr FROM l WHERE source <> 4""")
def s04(spark, sf):
    h, pid = views.hosts(spark, sf), F.col("page_id")
    line = F.concat(F.lit(" "), F.col("host"), F.lit(","), F.when(pid % 3 == 0, "n/a").otherwise(F.concat(F.lit("10.0.0."), pid % 250)), F.lit("\r"))
    lines = h.select((pid % 7).alias("source"), F.explode(F.array(line, F.lit(""), F.when(pid % 7 == 4, "API count exceeded - upgrade your plan"))).alias("line"))
    return host_index.parse_host_lines(lines)[0].select("source", "host", "addr")


@query("s05_host_cells", f"""
SELECT page_id, {_HOST} AS host, '' AS reason FROM pages WHERE page_id % 5 < 3
UNION ALL SELECT page_id, '', CASE page_id % 5 WHEN 3 THEN 'interstitial' ELSE 'no_table' END FROM pages WHERE page_id % 5 >= 3""")
def s05(spark, sf):
    h, pid = views.hosts(spark, sf), F.col("page_id")
    rows = F.concat(F.lit("<table><tr><TD class=x>\n<b>"), F.col("host"), F.lit("</b>\t</TD><td><a href=/>10.9.9.9</a></td><td>a b.c</td></tr></table>"))
    html = F.when(pid % 5 < 3, rows).when(pid % 5 == 3, "<html>Checking your browser</html>").otherwise("<html>nothing</html>")
    hosts, rejected = host_index.extract_host_cells(h.select("page_id", html.alias("html")))
    return hosts.select("page_id", "host", F.lit("").alias("reason")).unionByName(rejected.select("page_id", F.lit("").alias("host"), "reason"))


# --- S6-S8, F10, F11, J13 ------------------------------------------------------------------


def registration_texts(spark, sf) -> DataFrame:  # short rows are dealt before they become long texts
    c, k = spread(table(spark, sf, "customer"), "c_custkey"), F.col("c_custkey")
    seg = F.lower("c_mktsegment")
    lines = F.array(
        F.lit("% comment: ignored"), F.concat(F.lit("   Domain Name: "), F.upper(seg), k, F.lit(".EXAMPLE")),
        F.concat(F.lit("Registrar: Shop "), k % 9, F.lit(" (IANA 292)")), F.lit("Registrar: Second"),
        F.concat(F.lit("Registrar WHOIS Server: https://whois"), k % 3, F.lit(".example.net/q")),
        F.when(k % 4 == 0, "no match for this name").otherwise(F.concat(F.lit("Creation_Date: 2020-0"), k % 9 + 1, F.lit("-15T10:00:00Z"))),
        F.when(k % 4 != 0, F.concat(F.lit("Registry Expiry Date: 15-Mar-20"), k % 60 + 30)),
        F.concat(F.lit("Name Server: NS"), k % 5, F.lit(".EXAMPLE.NET. 192.0.2.1")), F.concat(F.lit("nserver: ns9.example.net, ns"), k % 5, F.lit(".example.net")),
        F.concat(F.lit("Domain Status: clientTransferProhibited")), F.when(k % 6 == 0, "status: clientHold"),
        F.concat(F.lit("Registrant Email: "), F.when(k % 3 == 0, "REDACTED FOR PRIVACY").when(k % 3 == 1, "x***@priv.example").otherwise(F.concat(F.lit("Own"), k, F.lit("@Mail.example")))),
        F.lit("this is a line of prose; not a field"))
    return c.select(F.col("c_custkey").alias("response_id"), F.array_join(lines, "\r\n").alias("text"))


@query("s06_registration_text", """
SELECT c_custkey AS response_id, lower(c_mktsegment) || c_custkey || '.example' AS domain_name, 'Shop ' || (c_custkey % 9) AS registrar, 'whois' || (c_custkey % 3) || '.example.net:43' AS referral,
  CASE WHEN c_custkey % 4 <> 0 THEN epoch_us(make_timestamp(2020, c_custkey % 9 + 1, 15, 10, 0, 0)) END AS created_at,
  CASE WHEN c_custkey % 4 <> 0 THEN epoch_us(make_timestamp(2000 + c_custkey % 60 + 30, 3, 15, 0, 0, 0)) END AS expires_at,
  'ns' || (c_custkey % 5) || '.example.net,ns9.example.net' AS name_servers, CASE WHEN c_custkey % 6 = 0 THEN 'clientHold,' ELSE '' END || 'clientTransferProhibited' AS status,
  CASE WHEN c_custkey % 3 = 2 THEN 'registrant email=own' || c_custkey || '@mail.example' ELSE '' END AS emails, CASE WHEN c_custkey % 3 < 2 THEN 'registrant email' ELSE '' END AS redacted,
  CASE WHEN c_custkey % 4 = 0 THEN 'empty' ELSE 'thick' END AS response_class, CASE WHEN c_custkey % 6 = 0 THEN 'low' ELSE 'info' END AS severity FROM customer""")
def s06(spark, sf):
    r = registration.parse_registration_text(registration_texts(spark, sf))
    return r.select("response_id", "domain_name", "registrar", "referral", us("created_at").alias("created_at"), us("expires_at").alias("expires_at"),
                    F.array_join("name_servers", ",").alias("name_servers"), F.array_join("status", ",").alias("status"),
                    F.array_join(F.transform("emails", lambda e: F.concat_ws("=", e["field"], e["address"])), ",").alias("emails"),
                    F.array_join("redacted", ",").alias("redacted"), "response_class", "severity")


def _card(name, mail, tel):
    return F.concat(F.lit('["vcard",[["version",{},"text","4.0"],["FN",{},"text","'), name, F.lit('"],["email",{},"text","'), mail,
                    F.lit('"],["email",{},"text","REDACTED FOR PRIVACY"],["tel",{"type":"voice"},"uri","tel:'), tel, F.lit('"],["adr",{},"text",["","Street 1","City"]]]]'))


def rdap_docs(spark, sf) -> DataFrame:
    s, k = spread(table(spark, sf, "customer"), "c_custkey"), F.col("c_custkey")  # short rows are dealt before they become long texts
    reg_card = _card(F.concat(F.lit("Registrar "), k % 9), F.concat(F.lit("Reg"), k % 9, F.lit("@r.example")), F.concat(F.lit("+1."), k))
    abuse = _card(F.lit("Abuse"), F.concat(F.lit("abuse"), k % 9, F.lit("@r.example")), F.lit("+1.2"))
    nested = F.concat(F.lit(',"entities":['), F.when(k % 3 == 1, F.concat(F.lit('{"roles":["abuse"],"vcardArray":'), abuse, F.lit("}"))).otherwise(""), F.lit("]"))
    top = F.when(k % 3 == 0, F.concat(F.lit(',{"roles":["technical","ABUSE"],"vcardArray":'), abuse, F.lit("}"))).otherwise("")
    raw = F.concat(
        F.lit('{"objectClassName":"domain","handle":"H-'), k, F.lit('","ldhName":"D'), k, F.lit('.EXAMPLE.","status":[" client hold","active"],'),
        F.lit('"events":[{"eventAction":"Registration","eventDate":"2019-05-0'), k % 9 + 1, F.lit('T00:00:00Z"},{"eventAction":"expiration","eventDate":"2030-01-01"}],'),
        F.lit('"nameservers":[{"ldhName":"NS2.example.net."},{"ldhName":"ns1.EXAMPLE.net"},{"ldhName":"ns1.example.net"}],"secureDNS":{"delegationSigned":'), (k % 2 == 0).cast("string"),
        F.lit('},"entities":[{"handle":"R1","roles":["registrar"],"vcardArray":'), reg_card, nested, F.lit("}"), top,
        F.lit('],"redacted":[{"name":{"type":"Registrant Name"},"method":"removal"},{"name":{"type":"Registrant Email"},"method":"Removal"}],'),
        F.lit('"remarks":[{"title":"Note","description":["held"," "]},{"description":["plain"]}]}'))
    return s.select("c_custkey", raw.alias("raw"))


@query("s07_rdap", """
SELECT c_custkey, 'd' || c_custkey || '.example' AS domain_name, 'active,client hold' AS status, epoch_us(make_timestamp(2019, 5, c_custkey % 9 + 1, 0, 0, 0)) AS created_at,
  epoch_us(TIMESTAMP '2030-01-01') AS expires_at, 'ns1.example.net,ns2.example.net' AS name_servers, c_custkey % 2 = 0 AS signed, 'Registrar ' || (c_custkey % 9) AS registrar,
  CASE WHEN c_custkey % 3 = 2 THEN 'Reg' ELSE 'abuse' END || (c_custkey % 9) || '@r.example' AS abuse, 'registrant email,registrant name' AS redacted, 'removal' AS methods,
  'Note: held' || chr(10) || 'plain' AS remarks, 'medium' AS severity FROM customer""")
def s07(spark, sf):
    r = registration.parse_rdap(rdap_docs(spark, sf))
    j = lambda c, n: F.array_join(c, ",").alias(n)
    return r.select("c_custkey", "domain_name", j("status", "status"), us("created_at").alias("created_at"), us("expires_at").alias("expires_at"), j("name_servers", "name_servers"),
                    "signed", "registrar", j("abuse_emails", "abuse"), j("redacted", "redacted"), j("redaction_methods", "methods"), "remarks", "severity")


@query("f10_vcard", """
SELECT c_custkey, c_name AS card_name, lower(c_mktsegment) || '@x.example' AS emails, '+62.' || c_custkey AS phones FROM customer""")
def f10(spark, sf):
    c = table(spark, sf, "customer")
    card = _card(F.col("c_name"), F.concat(F.lower("c_mktsegment"), F.lit("@x.example")), F.concat(F.lit("+62."), F.col("c_custkey")))
    v = registration.vcard_cols(c.select("c_custkey", card.alias("vcard")))
    return v.select("c_custkey", "card_name", F.array_join("card_emails", ",").alias("emails"), F.array_join("card_phones", ",").alias("phones"))


@query("f11_abuse_contact", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Reg' ELSE 'abuse' END || (c_custkey % 9) || '@r.example' AS abuse FROM customer""")
def f11(spark, sf):
    d = rdap_docs(spark, sf).select("c_custkey", F.from_json("raw", registration.RDAP)["entities"].alias("entities"))
    return registration.abuse_contact(d).select("c_custkey", F.array_join("abuse_emails", ",").alias("abuse"))


def bootstrap_docs(spark, sf) -> DataFrame:
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    entry = F.concat(F.lit('[["T'), k, F.lit('"," u'), k, F.lit(' "],["http://rdap'), k, F.lit('.example/","https://rdap'), k, F.lit('.EXAMPLE/v1","http://plain'), k, F.lit('.example/"]]'))
    return s.select(F.concat(F.lit('{"version":"1.0","services":['), entry, F.lit(",[[],[]]]}")).alias("raw"))


@query("s08_bootstrap", """
SELECT unnest(['t', 'u']) || s_suppkey AS tld, u.url AS url FROM supplier, LATERAL (SELECT unnest(['https://rdap' || s_suppkey || '.EXAMPLE/v1', 'http://plain' || s_suppkey || '.example/']) AS url) u""")
def s08(spark, sf):
    return registration.read_bootstrap(bootstrap_docs(spark, sf), "dns").select("tld", "url")


@query("j13_merge_registration", """
SELECT 'd' || c_custkey AS domain_name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Registry says' ELSE 'Registrar ' || (c_custkey % 7) END AS registrar,
       CASE WHEN c_custkey % 5 = 0 THEN 'a.example' WHEN c_custkey % 3 = 0 THEN 'a.example,b.example' ELSE 'a.example,b' || (c_custkey % 4) || '.example' END AS name_servers FROM customer""")
def j13(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    none, mails = F.array().cast("array<string>"), F.array().cast("array<struct<field:string,address:string>>")
    base = c.select(F.concat(F.lit("d"), k).alias("domain_name"), F.when((k % 2 == 0) & (k % 5 != 0), "Registry says").otherwise(" ").alias("registrar"), F.array(F.lit("a.example")).alias("name_servers"), "c_custkey")
    other = c.where(k % 5 != 0).select(F.concat(F.lit("d"), k).alias("domain_name"), F.concat(F.lit("Registrar "), k % 7).alias("registrar"),
                                       F.array(F.lit("a.example"), F.when(k % 3 == 0, "b.example").otherwise(F.concat(F.lit("b"), k % 4, F.lit(".example")))).alias("name_servers"), "c_custkey")
    fill = lambda d: d.drop("c_custkey").select("*", *[F.lit(None).cast("string").alias(n) for n in ("registrar_host", "created", "expires", "updated")], none.alias("status"), none.alias("redacted"), mails.alias("emails"))
    return registration.merge_registration(fill(base), fill(other)).select("domain_name", "registrar", F.array_join("name_servers", ",").alias("name_servers"))


# --- S9-S13 -------------------------------------------------------------------------------------


@query("s09_normalise_geo", """
WITH c AS (SELECT c_custkey AS k, unnest(['a', 'b', 'c']) AS provider, c_nationkey AS n FROM customer)
SELECT k, provider, 'N' || n AS country, 'city' || n AS city, CASE provider WHEN 'a' THEN CASE WHEN k % 2 = 0 THEN 'Org ' || n ELSE 'Isp ' || n END ELSE 'Org ' || n END AS org,
  CAST(64500 + n AS VARCHAR) AS asn, CASE WHEN provider = 'b' AND k % 3 = 0 THEN NULL ELSE n + CAST(0.5 AS DOUBLE) END AS lat, CASE WHEN provider = 'b' AND k % 3 = 0 THEN NULL ELSE -(n + CAST(0.25 AS DOUBLE)) END AS lon,
  CASE WHEN provider = 'b' AND k % 4 = 0 THEN TRUE END AS anycast
FROM c WHERE NOT (provider = 'a' AND k % 7 = 0) AND NOT (provider = 'b' AND k % 8 = 0 AND FALSE) AND NOT (provider = 'c' AND k % 9 = 0)""")
def s09(spark, sf):
    c = table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    num = lambda x: F.concat(x.cast("string"))
    a = F.concat(F.lit('{"success":'), (k % 7 != 0).cast("string"), F.lit(',"country_code":"n'), n, F.lit('","region":"R","city":" city'), n, F.lit('","latitude":'), num(n + 0.5), F.lit(',"longitude":-'), num(n + 0.25),
                 F.lit(',"connection":{"asn":'), n + 64500, F.lit(',"org":"'), F.when(k % 2 == 0, F.concat(F.lit("Org "), n)).otherwise(" "), F.lit('","isp":"Isp '), n, F.lit('"}}'))
    b = F.concat(F.lit('{"ip":"x","country":"n'), n, F.lit('","region":"R","city":"city'), n, F.lit('","loc":"'), F.when(k % 3 == 0, "200.5,10").otherwise(F.concat(num(n + 0.5), F.lit(", -"), num(n + 0.25))),
                 F.lit('","org":"AS'), n + 64500, F.lit(" Org "), n, F.lit('"'), F.when(k % 4 == 0, ',"anycast":true').otherwise(""), F.lit("}"))
    d = F.concat(F.lit('{"ipAddress":"'), F.when(k % 9 == 0, " ").otherwise("1.1.1.1"), F.lit('","countryCode":"n'), n, F.lit('","regionName":"R","cityName":"city'), n, F.lit('","latitude":'), num(n + 0.5),
                 F.lit(',"longitude":-'), num(n + 0.25), F.lit(',"asn":"AS'), n + 64500, F.lit(', X","asnOrganization":"Org '), n, F.lit('","isProxy":true}'))
    raw = c.select(k.alias("k"), F.explode(F.array(F.struct(F.lit("a").alias("provider"), a.alias("raw")), F.struct(F.lit("b").alias("provider"), b.alias("raw")), F.struct(F.lit("c").alias("provider"), d.alias("raw")))).alias("s")).select("k", "s.*")
    return network.normalise_geo(raw).select("k", "provider", "country", "city", "org", "asn", "lat", "lon", "anycast")


@query("s10_origin_txt", "WITH " + views.ADDRESSES + """
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS asn, addr || '/24' AS prefix, 'US' AS country, 'arin' AS registry, CASE WHEN l_linenumber % 2 = 0 THEN '2001-01-01' ELSE '' END AS allocated
FROM addresses JOIN lineitem USING (l_orderkey, l_linenumber) WHERE FALSE
UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS VARCHAR), '10.0.0.0/' || (o_custkey % 32), 'US', 'arin', CASE WHEN o_orderkey % 2 = 0 THEN '2001-01-01' ELSE '' END FROM orders WHERE o_orderkey % 5 < 3""")
def s10(spark, sf):
    o = table(spark, sf, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat(F.lit('"'), ck, F.lit('" | 10.0.0.0/'), ck % 32, F.lit(' | US |  arin '))
    txt = (F.when(ok % 5 == 3, F.concat(ck.cast("string"), F.lit("|x|US"))).when(ok % 5 == 4, F.concat(F.lit("AS"), ck, F.lit("|10.0.0.0/8|US|arin")))
           .otherwise(F.concat(body, F.when(ok % 2 == 0, "| 2001-01-01").otherwise(""))))
    return network.parse_origin_txt(o.select(ok.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), txt.alias("txt")))


@query("s11_as_overview", """
SELECT s_suppkey, 'AS' || s_suppkey AS asn, s_name AS holder, 'B' || (s_suppkey % 3) AS block, s_suppkey % 2 = 0 AS announced FROM supplier WHERE s_suppkey % 6 < 3""")
def s11(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    head = (F.when(k % 6 == 0, '"status":"ok","status_code":200').when(k % 6 == 1, '"status":"success"').when(k % 6 == 2, '"status_code":200')
            .when(k % 6 == 3, '"status":"error"').when(k % 6 == 4, '"status":"ok","status_code":500').otherwise('"status":"ok"'))
    holder = F.when(k % 6 == 5, " ").otherwise(F.col("s_name"))
    raw = F.concat(F.lit("{"), head, F.lit(',"data":{"resource":"AS'), k, F.lit('","holder":"'), holder, F.lit('","announced":'), (k % 2 == 0).cast("string"), F.lit(',"block":{"resource":"B'), k % 3, F.lit('","desc":"d"}}}'))
    return network.parse_as_overview(s.select("s_suppkey", raw.alias("raw"))).select("s_suppkey", "asn", "holder", "block", "announced")


@query("s12_normalise_dns", """
SELECT o_orderkey, list_extract(['A', 'MX', 'TXT', 'CAA', 'NS', 'A'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS type, CASE WHEN o_orderkey % 6 = 1 THEN 10 ELSE 0 END AS pref,
  CASE o_orderkey % 6 WHEN 0 THEN '10.0.0.' || (o_custkey % 256) WHEN 1 THEN 'mail' || o_custkey || '.example' WHEN 2 THEN 'v=spf1 -all' || o_custkey WHEN 3 THEN 'issue;"ca' || o_custkey || '"' WHEN 4 THEN 'ns' || o_custkey || '.example' END AS data,
  CASE WHEN o_orderkey % 6 = 5 THEN 3 ELSE 0 END AS status FROM orders""")
def s12(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    data = (F.when(k == 0, F.concat(F.lit("10.0.0."), c % 256)).when(k == 1, F.concat(F.lit("10 Mail"), c, F.lit(".Example."))).when(k == 2, F.concat(F.lit('\\"v=spf1 \\" \\"-all'), c, F.lit('\\"')))
            .when(k == 3, F.concat(F.lit('0 issue \\"ca'), c, F.lit('\\"'))).otherwise(F.concat(F.lit("NS"), c, F.lit(".example."))))
    num = F.element_at(F.array(*[F.lit(x) for x in (1, 15, 16, 257, 2, 1)]), (k + 1).cast("int"))
    bad = F.when(k == 0, ',{"name":"x.","type":1,"TTL":5,"data":"not an address"}').otherwise("")
    raw = F.when(k == 5, '{"Status":3}').otherwise(F.concat(F.lit('{"Status":0,"Answer":[{"name":"Q.example.","type":'), num, F.lit(',"TTL":60,"data":"'), data, F.lit('"}'), bad, F.lit("]}")))
    return network.normalise_dns(o.select("o_orderkey", F.lit("a").alias("rrtype"), raw.alias("raw"))).select("o_orderkey", "type", "pref", "data", "status")


@query("s13_audit_lines", """
SELECT event_id AS seq, epoch_us(ts) // 1000 * 1000 AS at, event_type AS action, '{"k":' || regexp_extract(props, '(\\d+)', 1) || '}' AS detail_json FROM events
WHERE event_id >= 100 AND event_id < (SELECT max(event_id) // 2 FROM events)""")
def s13(spark, sf):
    e = table(spark, sf, "events")
    top = e.agg(F.floor(F.max("event_id") / 2)).scalar()
    line = F.concat(F.lit('{"seq":'), F.col("event_id"), F.lit(',"at":"'), rfc3339(F.timestamp_millis(F.unix_millis("ts"))), F.lit('","actor":"u","action":"'), F.col("event_type"), F.lit('","detail":{"k":'),
                    F.regexp_extract("props", "(\\d+)", 1), F.lit('},"prev_hash":"p","hash":"h"}'))
    lines = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") == top, '{"seq": 12, "at":').otherwise(line).alias("line"))
    return logs.parse_audit(lines, lo=100).select("seq", us("at").alias("at"), "action", "detail_json")


# --- X1-X6 -----------------------------------------------------------------------------------------


def tags(spark, sf) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    size = F.col("p_size")
    t = lambda ifd, tag, v: F.struct(F.lit(ifd).alias("ifd"), F.lit(tag).alias("tag"), v.cast("string").alias("value"))
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    all_ = F.array(
        t("gps", "GPSLatitude", F.when(k % 7 == 0, "0/1 0/1 0/1").when(k % 7 == 1, "10/0 0/1 0/1").otherwise(F.concat(k % 80, F.lit("/1 30/1 1800/100")))),
        t("gps", "GPSLatitudeRef", F.when(k % 5 == 0, "S").when(k % 5 == 1, "Q").otherwise("N")), t("gps", "GPSLongitude", F.concat((k % 170 + 1), F.lit("/1 15/1 0/1"))),
        t("gps", "GPSLongitudeRef", F.when(k % 2 == 0, "w").otherwise("E")), t("gps", "GPSAltitude", F.concat(k % 100, F.lit("/2"))), t("gps", "GPSAltitudeRef", (k % 2)),
        t("exif", "DateTimeOriginal", F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("2023:05:"), day, F.lit(" 12:00:00")))), t("exif", "OffsetTimeOriginal", F.when(k % 3 == 1, "+05:30").otherwise("+99:00")),
        t("ifd0", "DateTime", F.concat(F.lit("2023:06:"), day, F.lit(" 01:02:03"))), t("ifd0", "ImageWidth", F.lit(4000)), t("ifd0", "ImageLength", F.lit(3000)), t("ifd1", "ImageWidth", F.lit(160)),
        t("ifd1", "ImageLength", F.when(k % 4 == 0, 90).otherwise(120)), t("ifd0", "Make", F.when(k % 6 != 0, F.col("p_brand"))), t("ifd0", "Model", F.when(k % 6 != 0, F.col("p_type"))),
        t("exif", "LensModel", F.concat(F.lit("L"), size)), t("iptc", "byline", F.col("p_name")), t("iptc", "caption", F.concat(F.lit("cap "), size)), t("iptc", "city", F.lit("x")),
        t("xmp", "packet", F.when(k % 2 == 0, "<x tiff:Make='a' dc:rights='b'/>").otherwise("<x/>")))
    return (p.where(k % 11 != 10).select(k.alias("file_id"), F.explode(all_).alias("t")).select("file_id", "t.*").where(F.col("value").isNotNull()))


@query("x01_gps_decimal", """
SELECT p_partkey AS file_id, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END * (p_partkey % 80 + 0.505) AS DOUBLE) AS latitude, CAST(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_partkey % 170 + 1.25) AS DOUBLE) AS longitude,
  round(CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * (p_partkey % 100) / 2.0, 6) + 0.0 AS altitude FROM part WHERE p_partkey % 11 <> 10 AND p_partkey % 7 > 1 AND p_partkey % 5 <> 1""")
def x01(spark, sf):
    g = media.gps_decimal(tags(spark, sf))
    return g.select("file_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("latitude", "longitude", "altitude")])


@query("x02_capture_instant", """
WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS d FROM part WHERE p_partkey % 11 <> 10)
SELECT k AS file_id, 'capture' AS label, CASE WHEN k % 3 = 0 THEN 'file_modified' ELSE 'capture' END AS tag_used, CASE WHEN k % 3 = 0 THEN '2023:06:' || d || ' 01:02:03' ELSE '2023:05:' || d || ' 12:00:00' END AS local,
   CASE WHEN k % 3 = 1 THEN epoch_us(CAST('2023-05-' || d || ' 06:30:00' AS TIMESTAMP)) END AS utc, k % 3 <> 1 AS ambiguous FROM p
UNION ALL SELECT k, unnest(['digitized', 'file_modified']), 'file_modified', '2023:06:' || d || ' 01:02:03', NULL, TRUE FROM p""")
def x02(spark, sf):
    return media.capture_instant(tags(spark, sf)).select("file_id", "label", "tag_used", "local", us("utc").alias("utc"), "ambiguous")


@query("x03_thumbnail_check", """
SELECT p_partkey AS file_id, CAST(1.3333 AS DOUBLE) AS image_aspect, CAST(CASE WHEN p_partkey % 4 = 0 THEN 1.7778 ELSE 1.3333 END AS DOUBLE) AS thumbnail_aspect, p_partkey % 4 <> 0 AS consistent,
  CASE WHEN p_partkey % 4 = 0 THEN 'low' ELSE 'info' END AS severity FROM part WHERE p_partkey % 11 <> 10""")
def x03(spark, sf):
    return media.thumbnail_check(tags(spark, sf)).select("file_id", "image_aspect", "thumbnail_aspect", "consistent", "severity")


@query("x04_device_facts", """
SELECT p_partkey AS file_id, p_brand AS camera_make, p_type AS camera_model, 'L' || p_size AS lens_model, p_brand || ' ' || p_type AS captured_with FROM part WHERE p_partkey % 11 <> 10 AND p_partkey % 6 <> 0""")
def x04(spark, sf):
    return media.device_facts(tags(spark, sf)).select("file_id", "camera_make", "camera_model", "lens_model", "captured_with")


@query("x05_caption_facts", """
WITH p AS (SELECT * FROM part WHERE p_partkey % 11 <> 10)
SELECT p_partkey AS file_id, 'authored_by' AS predicate, 'byline' AS field, p_name AS value FROM p UNION ALL SELECT p_partkey, 'image_described', 'caption', 'cap ' || p_size FROM p
UNION ALL SELECT p_partkey, 'xmp_present', 'packet', CASE WHEN p_partkey % 2 = 0 THEN 'tiff:Make,dc:rights' ELSE '' END FROM p""")
def x05(spark, sf):
    return media.caption_facts(tags(spark, sf))


@query("x06_no_metadata", "SELECT p_partkey AS file_id, 'exif-no-metadata' AS kind FROM part WHERE p_partkey % 11 = 10")
def x06(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"))
    return media.no_metadata(files, tags(spark, sf)).select("file_id", "kind")


# --- U1, U2, U4 -----------------------------------------------------------------------------------------


@registry.collector("segment-labels", consumes=["org"], produces=["text"], reliability="B", credibility="2")
def _segments(ents: DataFrame) -> DataFrame:
    return ents.select(F.col("id").alias("subject"), F.lit("labelled").alias("predicate"), F.upper("value").alias("object_key"))


@query("u01_collector", "SELECT 'p' || p_partkey AS subject, upper(p_name) AS object_key, 'segment-labels' AS module, 'B' AS reliability FROM part WHERE p_partkey % 2 = 0")
def u01(spark, sf):
    ents = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "org").otherwise("ip").alias("type"), F.col("p_name").alias("value"))
    return registry.run_collector("segment-labels", ents).select("subject", "object_key", "module", "reliability")


registry.register_adapter("lines", lambda d: d.select("provider", F.element_at(F.split("raw", ","), 1).alias("host")), 0.6)
registry.register_adapter("caps", lambda d: d.select("provider", F.lower("raw").alias("host")), 0.4)


@query("u02_adapters", f"""
SELECT CASE WHEN page_id % 2 = 0 THEN 'lines' ELSE 'caps' END AS provider, {_HOST} AS host, CAST(CASE WHEN page_id % 2 = 0 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS weight FROM pages""")
def u02(spark, sf):
    h, even = views.hosts(spark, sf), F.col("page_id") % 2 == 0
    raw = h.select(F.when(even, "lines").otherwise("caps").alias("provider"), F.when(even, F.concat("host", F.lit(",x"))).otherwise(F.upper("host")).alias("raw"))
    return registry.adapt(raw).select("provider", "host", "weight")


def _finding_rows(spark, sf) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rel = F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("to_id"), F.lit("owned_by").alias("type"), (k % 2 == 0).alias("heuristic")))
    return o.select((k % 100).alias("task_id"), F.struct(F.lit("account").alias("type"), F.concat(F.lit("acct"), k % 700).alias("value")).alias("entity"), F.lit(None).cast("string").alias("subject"),
                    F.lit("exists").alias("predicate"), F.concat(F.lit("acct"), k % 700).alias("object_key"), F.col("o_orderpriority").alias("source"), F.lit("B").alias("reliability"), F.lit("2").alias("credibility"),
                    F.col("o_orderdate").alias("observed_at"), rel.alias("relations"))


def _proof(f: DataFrame) -> DataFrame:
    """Artifacts of the first ten tasks."""
    return f.where("task_id < 10").select("task_id", F.concat(F.lit("ev-"), "object_key").alias("id"), F.sha2(F.col("object_key").cast("binary"), 256).alias("sha256"))


@query("u04_evidence_links", """
WITH o AS (SELECT o_orderkey % 100 AS task_id, 'acct' || (o_orderkey % 700) AS acct, o_orderpriority AS source FROM orders),
ids AS (SELECT *, replace(array_to_string(list_transform(string_split(sha256('account' || chr(0) || acct), ''),
   lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), ''), ',', '') AS bits FROM (SELECT DISTINCT acct FROM o)),
ent AS (SELECT acct, array_to_string(list_transform(range(0, 26), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + CAST(list_sum(
   list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS id FROM ids),
ob AS (SELECT DISTINCT task_id, substr(sha256(source || chr(0) || ent.id || chr(0) || 'exists' || chr(0) || o.acct || chr(0)), 1, 32) AS observation_id FROM o JOIN ent USING (acct)),
ev AS (SELECT DISTINCT task_id, 'ev-' || acct AS evidence_id, sha256(acct) AS sha256 FROM o WHERE task_id < 10)
SELECT DISTINCT observation_id, evidence_id, sha256 FROM ob JOIN ev USING (task_id)""")
def u04b(spark, sf):
    f = _finding_rows(spark, sf)
    return registry.fan_out(f, _proof(f))[3]


@query("u04_fan_out", """
SELECT 'entities' AS t, count(DISTINCT o_orderkey % 700) AS n FROM orders UNION ALL SELECT 'observations', count(*) FROM (SELECT DISTINCT o_orderkey % 700, o_orderpriority FROM orders)
UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT o_orderkey % 700, o_custkey FROM orders)
UNION ALL SELECT 'verified', count(*) FROM (SELECT o_orderkey % 700, o_orderpriority FROM orders GROUP BY 1, 2 HAVING bool_or(o_orderkey % 100 < 10))""")
def u04(spark, sf):
    f = _finding_rows(spark, sf)
    ents, obs, rels, _ = registry.fan_out(f, _proof(f))
    c = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n")
    return c(ents, "entities").unionByName(c(obs, "observations")).unionByName(c(rels, "relations")).unionByName(c(obs.where("has_artifact"), "verified"))
