"""Scoring, consensus and aggregation queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import aggregate, consensus, metrics, score
from sightline.operators.suffix import suffix_rules
from sightline.plans import views
from sightline.plans.catalog import query, table


@query("a01_confidence", "WITH " + views.WEIGHT + """
SELECT subject, round(confidence, 6) AS confidence, n_obs, n_conflicts, n_groups FROM conf""")
def a01(spark, sf):
    return score.confidence(views.obs(spark, sf), views.NOW).select(
        "subject", F.round("confidence", 6).alias("confidence"), "n_obs", "n_conflicts", "n_groups")


@query("a02_method_factor", "WITH " + views.OBS + """
SELECT event_id, CASE WHEN heuristic THEN 0.6 WHEN method_factor > 0 AND method_factor <= 1 THEN CAST(method_factor AS DOUBLE)
       ELSE CAST(1.0 AS DOUBLE) END AS factor FROM obs""")
def a02(spark, sf):
    o = views.obs(spark, sf)
    return o.select("event_id", score.method_factor(F.col("heuristic"), F.col("method_factor")).alias("factor"))


@query("a03_explain", "WITH " + views.WEIGHT + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject, grp ORDER BY w DESC, source DESC, observed_at DESC) AS rn,
         count(*) OVER (PARTITION BY subject, grp) AS cnt FROM weighed),
lines AS (
  SELECT subject, '1' || grp AS line_no,
         'group ' || rpad(grp, greatest(24, CAST(length(grp) AS INTEGER)), ' ') || ' w=' || format('{:.4f}', w) || ' from ' || source || ' (age ' ||
         (CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN CAST(floor(age / 60) AS BIGINT) || 'm'
               WHEN age < 86400 THEN CAST(floor(age / 3600) AS BIGINT) || 'h' ELSE CAST(floor(age / 86400) AS BIGINT) || 'd' END)
         || ', ' || cnt || ' observation(s) collapsed)' AS line FROM ranked WHERE rn = 1
  UNION ALL SELECT subject, '2', 'noisy-OR over ' || n_groups || ' independent group(s) = ' || format('{:.4f}', confidence) FROM conf
  UNION ALL SELECT subject, '3', 'conflict penalty: ' || n_conflicts || ' of ' || n_obs || ' observations contradict -> factor '
            || format('{:.4f}', 1 - 0.25 * least(1.0, n_conflicts / n_obs)) FROM conf WHERE n_conflicts > 0
  UNION ALL SELECT subject, '4', 'no retrievable artifact -> capped at 0.50 (unverified)' FROM conf WHERE art = 0
  UNION ALL SELECT subject, '5', 'final confidence ' || format('{:.4f}', confidence) FROM conf)
SELECT subject, line_no, line FROM lines""")
def a03(spark, sf):
    return score.explain(views.obs(spark, sf), views.NOW)


def _entities(spark, sf):
    o = views.obs(spark, sf)
    return o.groupBy(F.col("subject").alias("id")).agg(F.min("observed_at").alias("first_seen"),
                                                       F.max("observed_at").alias("last_seen")) \
            .withColumn("confidence", F.lit(0.0))


_SUBJECT_EDGES = """
sedges AS (
  SELECT DISTINCT 'u' || user_id AS from_id, 'u' || (user_id * 7 % 400) AS to_id, 'owned_by' AS type,
         user_id % 5 = 0 AS heuristic, CASE WHEN user_id % 9 = 0 THEN 0.77 ELSE 0.0 END AS confidence FROM events)"""


def _subject_edges(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), u).alias("from_id"), F.concat(F.lit("u"), u * 7 % 400).alias("to_id"),
        F.lit("owned_by").alias("type"), (u % 5 == 0).alias("heuristic"),
        F.when(u % 9 == 0, F.lit(0.77)).otherwise(F.lit(0.0)).alias("confidence")).distinct()


_EDGE_SCORE = """
edge_score AS (
  SELECT e.from_id, e.to_id,
    CASE WHEN e.confidence > 0 THEN CAST(e.confidence AS DOUBLE)
         WHEN heuristic THEN least(b, 0.6) ELSE b END AS confidence
  FROM (SELECT s.*, CASE WHEN f.confidence IS NULL OR t.confidence IS NULL
                         THEN least(coalesce(f.confidence, 0), coalesce(t.confidence, 0)) * 0.5 + 0.25
                         ELSE least(f.confidence, t.confidence) END AS b
        FROM sedges s LEFT JOIN conf f ON f.subject = s.from_id LEFT JOIN conf t ON t.subject = s.to_id) e)"""


@query("a04_score_batch", "WITH " + views.WEIGHT + "," + _SUBJECT_EDGES + "," + _EDGE_SCORE + """
SELECT 'entity' AS kind, subject AS id, round(confidence, 6) AS confidence FROM conf
UNION ALL SELECT 'edge', from_id || '>' || to_id, round(confidence, 6) FROM edge_score""")
def a04(spark, sf):
    ents, rels = score.score_batch(_entities(spark, sf), views.obs(spark, sf), _subject_edges(spark, sf), views.NOW)
    return (ents.select(F.lit("entity").alias("kind"), "id", F.round("confidence", 6).alias("confidence"))
            .unionByName(rels.select(F.lit("edge").alias("kind"), F.concat_ws(">", "from_id", "to_id").alias("id"),
                                     F.round("confidence", 6).alias("confidence"))))


@query("j09_score_relations", "WITH " + views.WEIGHT + "," + _SUBJECT_EDGES + "," + _EDGE_SCORE + """
SELECT from_id, to_id, round(confidence, 6) AS confidence FROM edge_score""")
def j09(spark, sf):
    ents = score.confidence(views.obs(spark, sf), views.NOW).select(F.col("subject").alias("id"), "confidence")
    return score.score_relations(_subject_edges(spark, sf), ents).select(
        "from_id", "to_id", F.round("confidence", 6).alias("confidence"))


@query("a05_flag_conflicts", "WITH " + views.OBS + """,
c AS (SELECT subject, predicate, count(DISTINCT object_key) > 1 AS c FROM obs GROUP BY 1, 2)
SELECT event_id, c AS conflict FROM obs JOIN c USING (subject, predicate)""")
def a05(spark, sf):
    return score.flag_conflicts(views.obs(spark, sf)).select("event_id", "conflict")


@query("a05_flag_conflicts_single_valued", "WITH " + views.OBS + """,
c AS (SELECT subject, predicate, count(DISTINCT object_key) > 1 AS c FROM obs GROUP BY 1, 2)
SELECT event_id, c AND predicate IN ('error', 'view') AS conflict FROM obs JOIN c USING (subject, predicate)""")
def a05s(spark, sf):
    return score.flag_conflicts(views.obs(spark, sf), ["error", "view"]).select("event_id", "conflict")


_FIELDS = ["country", "region", "city", "org", "asn"]
_LONG = """
long AS (SELECT addr, unnest(['country','region','city','org','asn']) AS field, trim(unnest([country, region, city, org, asn])) AS value FROM geo_claims),
cnt AS (SELECT addr, field, value, count(*) AS n FROM long WHERE value <> '' GROUP BY 1, 2, 3),
tot AS (SELECT addr, count(*) AS total FROM geo_claims GROUP BY 1),
cons AS (
  SELECT addr, field, value, n AS agreeing, total, CASE WHEN n = total THEN '1' ELSE '2' END AS credibility
  FROM (SELECT *, row_number() OVER (PARTITION BY addr, field ORDER BY n DESC, value) AS rn FROM cnt) JOIN tot USING (addr)
  WHERE rn = 1 AND n * 2 > total)"""


@query("a06_field_consensus", "WITH " + views.GEO_CLAIMS + "," + _LONG + "SELECT * FROM cons")
def a06(spark, sf):
    return consensus.field_consensus(views.geo_claims(spark, sf), _FIELDS)


@query("a07_disputed_fields", "WITH " + views.GEO_CLAIMS + "," + _LONG + """
SELECT DISTINCT addr, field FROM long EXCEPT SELECT addr, field FROM cons""")
def a07(spark, sf):
    return consensus.disputed_fields(views.geo_claims(spark, sf), _FIELDS)


@query("a08_centroid_radius", "WITH " + views.GEO_CLAIMS + """,
c AS (SELECT addr, avg(lat) AS clat, avg(lon) AS clon, count(*) AS n_points FROM geo_claims WHERE lat IS NOT NULL GROUP BY 1),
d AS (SELECT addr, radians(lat - clat) AS dl, radians(lon - clon) AS dn, radians(clat) AS a1, radians(lat) AS a2
      FROM geo_claims JOIN c USING (addr) WHERE lat IS NOT NULL),
r AS (SELECT addr, max(12742.0 * atan2(sqrt(h), sqrt(1 - h))) AS radius
      FROM (SELECT addr, pow(sin(dl / 2), 2) + cos(a1) * cos(a2) * pow(sin(dn / 2), 2) AS h FROM d) GROUP BY 1)
SELECT addr, round(clat, 4) AS clat, round(clon, 4) AS clon, n_points, round(radius, 4) AS radius_km FROM c JOIN r USING (addr)""")
def a08(spark, sf):
    d = consensus.centroid_radius(views.geo_claims(spark, sf))
    return d.select("addr", F.round("clat", 4).alias("clat"), F.round("clon", 4).alias("clon"), "n_points",
                    F.round("radius_km", 4).alias("radius_km"))


@query("a09_any_flag", "WITH " + views.GEO_CLAIMS + "SELECT addr, bool_or(anycast) AS anycast FROM geo_claims GROUP BY 1")
def a09(spark, sf):
    return consensus.any_flag(views.geo_claims(spark, sf), "anycast")


_DNS = """
dns AS (
  SELECT l_orderkey AS question, l_linenumber AS resolver,
         CASE WHEN l_orderkey % 29 = 0 THEN 3 WHEN l_partkey % 31 = 0 THEN 2 ELSE 0 END AS status, 'A' AS type, 0 AS pref,
         CASE WHEN l_orderkey % 29 = 0 OR l_partkey % 31 = 0 OR l_suppkey % 13 = 0 THEN NULL ELSE l_returnflag END AS data FROM lineitem)"""


def _dns(spark, sf):
    ok = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        ok.alias("question"), F.col("l_linenumber").alias("resolver"),
        F.when(ok % 29 == 0, 3).when(F.col("l_partkey") % 31 == 0, 2).otherwise(0).alias("status"),
        F.lit("A").alias("type"), F.lit(0).alias("pref"),
        F.when(~((ok % 29 == 0) | (F.col("l_partkey") % 31 == 0) | (F.col("l_suppkey") % 13 == 0)), F.col("l_returnflag")).alias("data"))


@query("u03_replaced_tables", "WITH " + views.OBS + """,
w AS (SELECT *, least(greatest((CASE WHEN r * c = 0 THEN 0.2 ELSE r * c END) * (CASE source WHEN 'pdns/otx:api' THEN CAST(0.5 AS DOUBLE) WHEN 'dns/doh:query' THEN 0.25 ELSE 1.0 END)
        * (CASE WHEN heuristic THEN 0.6 WHEN method_factor > 0 AND method_factor <= 1 THEN method_factor ELSE 1.0 END) * (CASE WHEN age <= 0 THEN 1.0 ELSE pow(0.5, age / 864000.0) END), 0.0), 0.999) AS w
      FROM (SELECT *, CASE reliability WHEN 'A' THEN CAST(0.9 AS DOUBLE) WHEN 'B' THEN 0.6 ELSE 0.0 END AS r, CASE credibility WHEN '1' THEN CAST(1.0 AS DOUBLE) WHEN '2' THEN 0.7 ELSE 0.0 END AS c,
                   (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(observed_at)) / 1e6 AS age, CASE WHEN source LIKE 'whois/%' OR source LIKE 'dns/%' THEN 'own' ELSE source END AS grp FROM obs)),
g AS (SELECT subject, grp, max(w) AS w, count(*) AS n, count(*) FILTER (conflict) AS nc, max(CAST(has_artifact AS INTEGER)) AS art FROM w GROUP BY subject, grp),
s AS (SELECT subject, sum(n) AS n, sum(nc) AS nc, max(art) AS art, 1 - product(1 - w) AS raw FROM g GROUP BY subject)
SELECT subject, round(least(CASE WHEN art > 0 THEN p ELSE least(p, 0.5) END, 0.9), 6) AS confidence FROM (SELECT *, raw * (1 - 0.5 * least(1.0, nc / n)) AS p FROM s)""")
def u03(spark, sf):
    cfg = score.ScoreConfig(reliability={"A": 0.9, "B": 0.6}, credibility={"1": 1.0, "2": 0.7}, groups={"own": ["iana", "doh"]},
                            source_weights={"pdns/otx:api": 0.5, "dns/doh:query": 0.25}, half_life_hours=240, conflict_penalty=0.5, cap=0.9)
    return score.confidence(views.obs(spark, sf), views.NOW, cfg).select("subject", F.round("confidence", 6).alias("confidence"))


@query("a10_resolver_consensus", "WITH " + _DNS + """,
per AS (SELECT question, resolver, max(status) AS status,
               coalesce(string_agg(DISTINCT type || ':' || pref || ':' || data, '|' ORDER BY type || ':' || pref || ':' || data), '') AS answer
        FROM dns GROUP BY 1, 2),
st AS (SELECT question, count(*) FILTER (status NOT IN (0, 3)) AS failed, count(*) FILTER (status = 3) AS nx, count(*) AS resolvers FROM per GROUP BY 1),
v AS (SELECT question, answer, count(*) AS n FROM per WHERE answer <> '' AND status = 0 GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, answer) AS rn FROM v) WHERE rn = 1)
SELECT question, CASE WHEN n >= 2 THEN 'agreed' WHEN n > 0 THEN 'disagreement' WHEN nx > 0 THEN 'nxdomain' WHEN failed > 0 THEN 'failed' ELSE 'no_answer' END AS verdict,
       CASE WHEN n >= 2 THEN answer END AS answer, coalesce(n, 0) AS agreeing, resolvers
FROM st LEFT JOIN b USING (question)""")
def a10(spark, sf):
    return consensus.resolver_consensus(_dns(spark, sf))


@query("a11_host_history", "WITH " + views.CAPTURES + """
SELECT host, min(stamp) AS first_seen, max(stamp) AS last_seen, count(*) AS captures FROM captures
WHERE (status BETWEEN 200 AND 399 OR status = 403) AND (host = 'example.com' OR host LIKE '%.example.com') GROUP BY 1""")
def a11(spark, sf):
    return aggregate.host_history(views.captures(spark, sf), "example.com")


@query("a11_all_host_history", "WITH " + views.CAPTURES + """
SELECT host, min(stamp) AS first_seen, max(stamp) AS last_seen, count(*) AS captures,
       regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS registrable FROM captures
WHERE (status BETWEEN 200 AND 399 OR status = 403) GROUP BY 1""")
def a11b(spark, sf):
    return aggregate.all_host_history(views.captures(spark, sf), suffix_rules(views.suffix_list(spark, sf))).select("host", "first_seen", "last_seen", "captures", "registrable")


_CERTS = """
certs AS (
  SELECT page_id, 'index-' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider,
         lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
         'CA ' || (page_id % 7) AS issuer_org, page_id % 40 AS digest_no, page_id % 11 = 0 AS revoked,
         CASE WHEN page_id % 2 = 0 THEN '' ELSE sha256('d' || (page_id % 40)) END AS cert_sha256 FROM pages)"""


def _certs(spark, sf):
    h = views.hosts(spark, sf)
    pid = F.col("page_id")
    upper = F.upper("host")
    return h.select(
        "page_id", F.when(pid % 2 == 0, "index-a").otherwise("index-b").alias("provider"),
        F.array(F.col("host"), F.concat(upper, F.lit(".")), F.concat(F.lit("*."), F.col("host")),
                F.concat(F.lit("dev-*."), F.col("host")), F.lit("stranger.test"), F.lit("example.com"),
                F.lit("notexample.com")).alias("names"),
        F.concat(F.lit("CA "), pid % 7).alias("issuer_org"),
        F.when(pid % 2 == 0, "").otherwise(F.sha2(F.concat(F.lit("d"), pid % 40).cast("binary"), 256)).alias("cert_sha256"),
        F.concat(F.lit("t"), pid % 5).alias("not_before"), F.lit("z").alias("not_after"),
        F.concat(F.lit("O=CA "), pid % 7).alias("issuer_dn"), (pid % 11 == 0).alias("revoked"))


@query("a12_ct_names", "WITH " + _CERTS + """
SELECT host, count(DISTINCT provider) AS sources_count, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers
FROM certs WHERE host LIKE '%.example.com' GROUP BY 1""")
def a12(spark, sf):
    return aggregate.ct_names(_certs(spark, sf), "example.com")


@query("a12_ct_issuers", "WITH " + _CERTS + "SELECT issuer_org AS issuer, count(*) AS certificates FROM certs GROUP BY 1")
def a12b(spark, sf):
    return aggregate.ct_issuers(_certs(spark, sf))


@query("a12_ct_certificates", "WITH " + _CERTS + """
SELECT cert_sha256, bool_or(revoked) AS revoked, count(*) AS entries, CASE WHEN bool_or(revoked) THEN 'medium' ELSE '' END AS severity,
       min('t' || (page_id % 5)) AS not_before FROM certs WHERE cert_sha256 <> '' GROUP BY 1""")
def a12c(spark, sf):
    return aggregate.ct_certificates(_certs(spark, sf)).select("cert_sha256", "revoked", "entries", "severity", "not_before")


_SIGHT = """
sightings AS (
  SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, 'src' || (page_id % 3) AS source,
         CASE WHEN page_id % 4 = 0 THEN '10.0.' || (page_id % 3) || '.' || (page_id % 200) END AS addr FROM pages)"""
_WEIGHTS = {"src0": 0.4, "src1": 0.6, "src2": 0.5}


def _sightings(spark, sf):
    pid = F.col("page_id")
    return views.hosts(spark, sf).select(
        "host", F.concat(F.lit("src"), pid % 3).alias("source"),
        F.when(pid % 4 == 0, F.concat(F.lit("10.0."), pid % 3, F.lit("."), pid % 200)).alias("addr"))


@query("a13_passive_aggregate", "WITH " + _SIGHT + """,
v AS (SELECT DISTINCT host, source FROM sightings)
SELECT host, count(*) AS source_count,
       round(sum(CASE source WHEN 'src0' THEN CAST(0.4 AS DOUBLE) WHEN 'src1' THEN 0.6 ELSE 0.5 END), 2) AS aggregate_weight,
       string_agg(source, ',' ORDER BY source) AS sources,
       CASE WHEN count(*) = 3 THEN '1' WHEN count(*) = 2 THEN '2' ELSE '3' END AS credibility
FROM v GROUP BY 1""")
def a13(spark, sf):
    return aggregate.passive_aggregate(_sightings(spark, sf), _WEIGHTS)


@query("a13_passive_addresses", "WITH " + _SIGHT + "SELECT DISTINCT host, addr FROM sightings WHERE addr IS NOT NULL")
def a13b(spark, sf):
    return aggregate.passive_addresses(_sightings(spark, sf))


@query("a13_passive_summary", "WITH " + _SIGHT + """,
v AS (SELECT host, count(DISTINCT source) AS n FROM sightings GROUP BY 1),
s AS (SELECT count(DISTINCT source) AS k FROM sightings)
SELECT count(*) AS distinct_names, count(*) FILTER (n = 1) AS uncorrelated_count, max(k) AS sources_succeeded,
       4 - max(k) AS sources_failed, CASE WHEN max(k) = 4 THEN '1' WHEN max(k) > 2 THEN '2' ELSE '3' END AS credibility FROM v, s""")
def a13c(spark, sf):
    s = _sightings(spark, sf)
    return aggregate.passive_summary(s, s, 4)


@query("a14_coverage", """
WITH runs AS (SELECT user_id % 10 AS run_id, event_type AS source, NOT (user_id % 10 = 3 AND event_type = 'error') AS ok,
                     CASE WHEN event_id % 8 <> 0 THEN event_id % 500 END AS item, event_id % 500 < 400 AS emitted FROM events),
s AS (SELECT run_id, source, bool_or(ok) AS ok FROM runs GROUP BY 1, 2),
i AS (SELECT run_id, item, bool_or(emitted) AS e FROM runs WHERE item IS NOT NULL GROUP BY 1, 2),
a AS (SELECT run_id, count(*) FILTER (ok) AS sources_ok, count(*) FILTER (NOT ok) AS sources_failed FROM s GROUP BY 1),
b AS (SELECT run_id, count(*) AS distinct_items, count(*) FILTER (e) AS emitted FROM i GROUP BY 1)
SELECT a.run_id, sources_ok, sources_failed, coalesce(distinct_items, 0) AS distinct_items, coalesce(emitted, 0) AS emitted,
       coalesce(emitted, 0) < coalesce(distinct_items, 0) AS truncated FROM a LEFT JOIN b USING (run_id)""")
def a14(spark, sf):
    e = table(spark, sf, "events")
    eid, run = F.col("event_id"), F.col("user_id") % 10
    return aggregate.coverage(e.select(
        run.alias("run_id"), F.col("event_type").alias("source"), (~((run == 3) & (F.col("event_type") == "error"))).alias("ok"),
        F.when(eid % 8 != 0, eid % 500).alias("item"), (eid % 500 < 400).alias("emitted")))


@query("a15_store_stats", """
SELECT 'observations' AS counter, count(*) AS n FROM events
UNION ALL SELECT 'observations_without_evidence', count(*) FILTER (event_id % 3 <> 0) FROM events
UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'relations', count(*) FROM orders
UNION ALL SELECT 'scans', count(*) FROM nation""")
def a15(spark, sf):
    ev = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.array(F.lit("x"))).otherwise(
        F.array().cast("array<string>")).alias("evidence"))
    return metrics.store_stats({"observations": ev, "entities": table(spark, sf, "customer"),
                                "relations": table(spark, sf, "orders"), "scans": table(spark, sf, "nation")})


@query("a17_merge_entity_batch", """
WITH b AS (SELECT 'u' || user_id AS id, event_type AS tag, ts, props FROM events),
k AS (SELECT id, tag, max_by(v, ts) AS v FROM (SELECT id, tag, ts, regexp_extract(props, '(\\d+)', 1) AS v FROM b) GROUP BY 1, 2)
SELECT id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen,
       (SELECT string_agg(tag || '=' || v, ',' ORDER BY tag) FROM k WHERE k.id = b.id) AS attrs FROM b GROUP BY 1""")
def a17(spark, sf):
    m = aggregate.merge_entity_batch(_entity_batch(spark, sf))
    return m.select("id", F.array_join("tags", ",").alias("tags"), F.unix_micros("first_seen").alias("first_seen"),
                    F.unix_micros("last_seen").alias("last_seen"),
                    F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat_ws(
                        "=", x["key"], x["value"]["value"])), ",").alias("attrs"))


def _entity_batch(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.lit("username").alias("type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("value"), F.lit("").alias("display"),
        F.array("event_type").alias("tags"), F.lit(0.0).alias("confidence"), F.lit(0).alias("sensitivity"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
        F.create_map(F.col("event_type"), F.struct(F.regexp_extract("props", "(\\d+)", 1).alias("value"),
                                                   F.array().cast("array<string>").alias("obs"))).alias("attrs"))


@query("a17_entity_tags", "SELECT DISTINCT 'u' || user_id AS id, event_type AS tag FROM events")
def a17b(spark, sf):
    return aggregate.entity_parts(_entity_batch(spark, sf))[1]


@query("w08_cap_names", """
WITH u AS (SELECT DISTINCT source AS grp, lang || '-' || (n_chars % 50) AS name FROM documents),
c AS (SELECT grp, count(*) AS found FROM u GROUP BY 1)
SELECT grp, name, rn AS rank, found, found > 10 AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY name) AS rn FROM u) JOIN c USING (grp) WHERE rn <= 10""")
def w08(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("grp"), F.concat_ws("-", "lang", (F.col("n_chars") % 50).cast("string")).alias("name"))
    return aggregate.cap_names(d, ["grp"], 10)
