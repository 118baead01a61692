"""Change, merge, erasure, validity and integrity queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from sightline import fixed
from sightline.functions import keys
from sightline.functions.keys import rfc3339
from sightline.operators import change, graph, integrity, listing, merge, metrics
from sightline.operators.integrity import evidence_hash
from sightline.plans import views
from sightline.plans.catalog import query, table
from sightline.session import ensure_checkpoint_dir
from sightline.sources import sinks
from sightline.sources.logs import blob_path


def us(c: str):
    return F.unix_micros(F.col(c))


def _obs_link(o: DataFrame) -> DataFrame:
    return o.select(F.col("id").alias("observation_id"), "scan_id").distinct()


def _ent_link(o: DataFrame) -> DataFrame:
    return o.select(F.col("subject").alias("entity_id"), "scan_id").distinct()


# --- D1, K2, W1, W2 -------------------------------------------------------------------


@query("d01_dedupe", "WITH " + views.OBS + """
SELECT id, min(event_id) AS event_id, epoch_us(min(observed_at)) AS observed_at FROM obs GROUP BY 1""")
def d01(spark, sf):
    return change.dedupe(views.obs(spark, sf)).select("id", "event_id", us("observed_at").alias("observed_at"))


@query("k02_order_observations", "WITH " + views.OBS + """
, d AS (SELECT id, min(observed_at) AS observed_at FROM obs GROUP BY 1)
SELECT id, epoch_us(observed_at) AS observed_at FROM d""")
def k02(spark, sf):
    return change.order_observations(change.dedupe(views.obs(spark, sf))).select("id", us("observed_at").alias("observed_at"))


_FACTS = """
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_at) AS rn0 FROM obs) WHERE rn0 = 1),
link AS (SELECT DISTINCT id, scan_id FROM obs),
facts AS (SELECT * FROM (
  SELECT l.scan_id, dd.subject, dd.predicate, dd.object_key, dd.observed_at, dd.id,
         row_number() OVER (PARTITION BY l.scan_id, dd.subject, dd.predicate ORDER BY dd.observed_at, dd.id) AS rn
  FROM dd JOIN link l ON l.id = dd.id) WHERE rn = 1)"""


@query("w01_first_facts", "WITH " + views.OBS + "," + _FACTS + """
SELECT scan_id, subject, predicate, object_key, epoch_us(observed_at) AS observed_at, id FROM facts""")
def w01(spark, sf):
    o = views.obs(spark, sf)
    return change.first_facts(change.dedupe(o), _obs_link(o)).withColumn("observed_at", us("observed_at"))


@query("w02_history", "WITH " + views.OBS + """
SELECT event_id, subject, rn AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY observed_at DESC, id) AS rn FROM obs) WHERE rn <= 10""")
def w02(spark, sf):
    return change.history(views.obs(spark, sf), 10).select("event_id", "subject", "rank")


# --- D2, D3, K3, J12 --------------------------------------------------------------------


def _ents(o: DataFrame) -> DataFrame:
    return o.groupBy(F.col("subject").alias("id")).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


_PART_LINK = """
plink AS (SELECT DISTINCT l_partkey AS id, CASE WHEN l_shipdate < TIMESTAMP '1995-03-18' THEN 's1' WHEN l_shipdate >= TIMESTAMP '2001-08-20' THEN 's2' ELSE 's3' END AS scan_id
          FROM lineitem)"""


def _part_link(spark, sf):
    shipped = F.col("l_shipdate")
    scan = (F.when(shipped < F.lit("1995-03-18").cast("timestamp"), "s1").when(shipped >= F.lit("2001-08-20").cast("timestamp"), "s2").otherwise("s3"))
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), scan.alias("scan_id")).distinct()


@query("d02_scan_diff", "WITH " + _PART_LINK + """
SELECT 'added' AS change, p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM plink WHERE scan_id = 's2')
   AND p_partkey NOT IN (SELECT id FROM plink WHERE scan_id = 's1')
UNION ALL
SELECT 'removed', p_partkey FROM part WHERE p_partkey IN (SELECT id FROM plink WHERE scan_id = 's1')
   AND p_partkey NOT IN (SELECT id FROM plink WHERE scan_id = 's2')""")
def d02(spark, sf):
    ents = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    added, removed = change.scan_diff(ents, _part_link(spark, sf), "s1", "s2")
    return (added.select(F.lit("added").alias("change"), "id").unionByName(removed.select(F.lit("removed").alias("change"), "id")))


_CHANGES = """
b AS (SELECT * FROM facts WHERE scan_id = 's1'), a AS (SELECT * FROM facts WHERE scan_id = 's2'),
shared AS (SELECT subject FROM obs GROUP BY 1 HAVING count(DISTINCT scan_id) = 2),
changes AS (
  SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.predicate, b.predicate) AS field, b.object_key AS before,
         a.object_key AS after, CASE WHEN coalesce(a.predicate, b.predicate) IN ('resolves_to','ip','asn','ns','mx','registrar','tls_cert','exposes') THEN 'medium'
              WHEN coalesce(a.predicate, b.predicate) IN ('exists','attr','http_status') THEN 'low' ELSE 'info' END AS severity
  FROM b FULL JOIN a ON a.subject = b.subject AND a.predicate = b.predicate
  WHERE b.object_key IS DISTINCT FROM a.object_key AND coalesce(a.subject, b.subject) IN (SELECT subject FROM shared))"""


@query("d03_fact_changes", "WITH " + views.OBS + "," + _FACTS + "," + _CHANGES + "SELECT * FROM changes")
def d03(spark, sf):
    o = views.obs(spark, sf)
    return change.fact_changes(change.dedupe(o), _obs_link(o), _ent_link(o), "s1", "s2")


@query("k03_order_diff", "WITH " + views.OBS + "," + _FACTS + "," + _CHANGES + "SELECT subject, field, severity FROM changes")
def k03(spark, sf):
    return change.order_diff(d03(spark, sf)).select("subject", "field", "severity")


@query("j12_of_scan", "WITH " + _PART_LINK + "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM plink WHERE scan_id = 's1')")
def j12(spark, sf):
    return graph.of_scan(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), _part_link(spark, sf), "s1")


# --- D5-D9 --------------------------------------------------------------------------------

_MAILS = """
mails AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'domain' END AS type,
   CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Jane' ELSE 'jane' END || (c_custkey % 50) || '@' || CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END || '.example'
        ELSE lower(c_mktsegment) || (c_custkey % 5) || '.example' END AS value FROM customer)"""


def _mails(spark, sf):
    ck, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    return table(spark, sf, "customer").select(
        ck.alias("id"), F.when(ck % 3 == 0, "email").otherwise("domain").alias("type"),
        F.when(ck % 3 == 0, F.concat(F.when(ck % 2 == 0, "Jane").otherwise("jane"), ck % 50, F.lit("@"), F.when(ck % 7 == 0, F.col("c_mktsegment")).otherwise(seg), F.lit(".example")))
        .otherwise(F.concat(seg, ck % 5, F.lit(".example"))).alias("value"))


@query("d05_erasure_seeds", "WITH " + _MAILS + """
SELECT 'domain' AS how, id FROM mails WHERE value = 'building.example' OR (type = 'email' AND value ILIKE '%@building.example')
UNION ALL SELECT 'handle', id FROM mails WHERE value = 'jane7' OR (type = 'email' AND value ILIKE 'jane7@%')
UNION ALL SELECT 'case', p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'age', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""")
def d05(spark, sf):
    m = _mails(spark, sf)
    link = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("scan_id"))
    scans = link.select(F.col("scan_id").alias("id")).distinct().withColumn("case_id", F.concat(F.lit("case"), F.col("id")))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_seen"))
    parts = {"domain": change.erasure_seeds(m, subject="building.example"), "handle": change.erasure_seeds(m, subject="jane7"),
             "case": change.erasure_seeds(m, case_id="caseR", entity_scans=link, scans=scans),
             "age": change.erasure_seeds(orders, before="1996-01-01")}
    out = None
    for how, df in parts.items():
        part = df.select(F.lit(how).alias("how"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def _hop(n: int) -> str:
    return f"""
h{n} AS (SELECT DISTINCT dst AS id FROM und WHERE src IN (SELECT id FROM v{n - 1})),
v{n} AS (SELECT id, hop FROM v{n - 1}h UNION ALL SELECT id, {n} FROM h{n} WHERE id NOT IN (SELECT id FROM v{n - 1})),
v{n}h AS (SELECT id, hop FROM v{n})"""


_SEED = "v0 AS (SELECT 's3' AS id, 0 AS hop), v0h AS (SELECT id, hop FROM v0)"


@query("d06_erasure_closure", "WITH " + views.EDGES + "," + _SEED + "," + ",".join(_hop(i) for i in range(1, 5)) + """
SELECT id, CAST(hop AS INTEGER) AS hop FROM v4""")
def d06(spark, sf):
    rels = views.edges(spark, sf)
    return change_closure(rels, spark)


def change_closure(rels: DataFrame, spark) -> DataFrame:
    seeds = rels.where(F.col("from_id") == "s3").select(F.col("from_id").alias("id"))
    return graph.erasure_closure(rels, seeds, 4)


@query("d07_erase_report", "WITH " + views.EDGES + """,
gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'entities' AS table_name, count(*) AS erased FROM customer WHERE 'c' || c_custkey IN (SELECT id FROM gone)
UNION ALL SELECT 'observations', count(*) FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM gone)
UNION ALL SELECT 'relations', count(*) FROM edges WHERE from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone)""")
def d07(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), "c_mktsegment")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("subject"))
    report, _ = change.erase({"entities": c, "observations": o, "relations": views.edges(spark, sf)},
                             c.where("c_mktsegment = 'BUILDING'").select("id"))
    return report


@query("d07_erase_apply", "WITH " + views.EDGES + """,
gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT from_id, to_id FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)""")
def d07b(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    _, kept = change.erase({"relations": views.edges(spark, sf)}, gone, dry_run=False)
    return kept["relations"].select("from_id", "to_id")


@query("d07_purge", "WITH " + views.EDGES + "," + _SEED + "," + ",".join(_hop(i) for i in range(1, 5)) + """
SELECT 'entities' AS table_name, count(*) AS erased FROM v4 UNION ALL SELECT 'relations', count(*) FROM edges WHERE from_id IN (SELECT id FROM v4) OR to_id IN (SELECT id FROM v4)
UNION ALL SELECT 'tags', count(*) FROM customer WHERE 'c' || c_custkey IN (SELECT id FROM v4)""")
def d07c(spark, sf):
    rels = views.edges(spark, sf)
    ids = rels.select(F.col("from_id").alias("id")).unionByName(rels.select(F.col("to_id").alias("id"))).distinct()
    tags = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("entity_id"), F.col("c_mktsegment").alias("tag"))
    graph_ = {"entities": ids.select("id", F.lit("username").alias("type"), F.col("id").alias("value")), "relations": rels, "tags": tags}
    return change.purge(graph_, subject="s3")[0]


@query("d08_retention", """
SELECT 'observations' AS table_name, count(*) AS n FROM lineitem WHERE epoch(l_shipdate) < epoch(TIMESTAMP '2000-01-01') - 86400 * CASE WHEN l_linenumber = 2 THEN 90 ELSE 730 END
UNION ALL SELECT 'evidence', count(*) FROM orders WHERE epoch(o_orderdate) < epoch(TIMESTAMP '2000-01-01') - 86400 * 365
UNION ALL SELECT 'audit', count(*) FROM orders WHERE epoch(o_orderdate) < epoch(TIMESTAMP '2000-01-01') - 86400 * 2555""")
def d08(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("sensitivity"), F.col("l_shipdate").alias("observed_at"))
    o = table(spark, sf, "orders")
    due = change.retention({"observations": li, "evidence": o.select(F.col("o_orderdate").alias("captured_at")),
                            "audit": o.select(F.col("o_orderdate").alias("at"))}, "2000-01-01 00:00:00")
    return metrics.store_stats({n: due[n].withColumn("evidence", F.array(F.lit(1))) for n in ("evidence", "audit")}).unionByName(
        due["observations"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("observations").alias("counter"), "n")
    ).select(F.col("counter").alias("table_name"), "n")


@query("d09_redact", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'redacted' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 3 = 2 THEN 'redacted' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def d09(spark, sf):
    c = table(spark, sf, "customer").withColumn("sensitivity", F.col("c_custkey") % 3)
    return change.redact(c, ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


# --- M1-M4 ------------------------------------------------------------------------------------


def _entity_rows(spark, sf, half: str):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    o = o.where((F.col("o_orderdate") < cut) if half == "old" else (F.col("o_orderdate") >= cut))
    g = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"),
                                   (F.max("o_totalprice") / 1e6).alias("confidence"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("string")
    return g.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("id"), F.lit("account").alias("type"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("value"),
        F.when((F.col("o_custkey") % 2 == 0) & F.lit(half == "new"), "").otherwise(F.concat(F.lit(half), n)).alias("display"),
        F.create_map(F.lit("n"), F.struct(n.alias("value"), F.array().cast("array<string>").alias("obs"))).alias("attrs"),
        F.array(F.lit(half)).alias("tags"), "confidence", F.lit(1 if half == "new" else 0).alias("sensitivity"),
        "first_seen", "last_seen")


@query("m01_merge_entities", """
WITH g AS (SELECT o_custkey AS k, o_orderdate >= TIMESTAMP '1998-01-01' AS new, min(o_orderdate) AS f, max(o_orderdate) AS l,
                  max(o_totalprice) / 1e6 AS c, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT 'c' || k AS id, epoch_us(min(f)) AS first_seen, epoch_us(max(l)) AS last_seen, round(max(c), 6) AS confidence,
       CAST(max(CASE WHEN new THEN 1 ELSE 0 END) AS INTEGER) AS sensitivity,
       CAST(coalesce(max(CASE WHEN new THEN n END), max(n)) AS VARCHAR) AS attr_n,
       coalesce(max(CASE WHEN new AND k % 2 <> 0 THEN 'new' || n END), max(CASE WHEN NOT new THEN 'old' || n END), '') AS display,
       string_agg(CASE WHEN new THEN 'new' ELSE 'old' END, ',' ORDER BY new DESC) AS tags FROM g GROUP BY k""")
def m01(spark, sf):
    m = merge.merge_entities(_entity_rows(spark, sf, "old"), _entity_rows(spark, sf, "new"))
    return m.select("id", us("first_seen").alias("first_seen"), us("last_seen").alias("last_seen"),
                    F.round("confidence", 6).alias("confidence"), "sensitivity",
                    F.col("attrs")["n"]["value"].alias("attr_n"), "display", F.array_join("tags", ",").alias("tags"))


@query("m02_insert_observations", "WITH " + views.OBS + """,
f AS (SELECT id, min(observed_at) FILTER (scan_id = 's1') AS t1, min(observed_at) AS t FROM obs GROUP BY 1)
SELECT 'obs' AS kind, id AS k, epoch_us(coalesce(t1, t)) AS v FROM f
UNION ALL SELECT DISTINCT 'link', id || scan_id, CAST(0 AS BIGINT) FROM obs""")
def m02(spark, sf):
    o = views.obs(spark, sf)
    old = change.dedupe(o.where("scan_id = 's1'"))
    new = o.where("scan_id = 's2'")
    obs, link = merge.insert_observations(old, new, _obs_link(o.where("scan_id = 's1'")), "s2")
    return (obs.select(F.lit("obs").alias("kind"), F.col("id").alias("k"), us("observed_at").alias("v"))
            .unionByName(link.select(F.lit("link").alias("kind"), F.concat("observation_id", "scan_id").alias("k"), F.lit(0).cast("long").alias("v"))))


@query("m03_merge_relations", """
SELECT 'o' || l_orderkey AS from_id, 'p' || l_partkey AS to_id, max(l_discount) AS confidence, bool_and(l_linenumber % 2 = 0) AS heuristic,
       substr(sha256('o' || l_orderkey || chr(0) || 'p' || l_partkey || chr(0) || 'mentions'), 1, 32) AS id
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def m03(spark, sf):
    r = keys.with_ids(table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_id"),
        F.lit("mentions").alias("type"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") % 2 == 0).alias("heuristic"),
        F.array(F.col("l_linestatus")).alias("obs"), "l_linenumber"), "relation")
    m = merge.merge_relations(r.where("l_linenumber <= 3").drop("l_linenumber"), r.where("l_linenumber > 3").drop("l_linenumber"))
    return m.select("id", "from_id", "to_id", "confidence", "heuristic")


@query("s15_saved_graph", """
SELECT 'relation' AS t, substr(sha256('o' || l_orderkey || chr(0) || 'p' || l_partkey || chr(0) || 'mentions'), 1, 32) AS id, max(l_discount) AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT 'tag', 'o' || l_orderkey || '/' || l_returnflag, CAST(0 AS DOUBLE) FROM lineitem""")
def s15(spark, sf):
    li = table(spark, sf, "lineitem")
    rels = keys.with_ids(li.select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_id"), F.lit("mentions").alias("type"),
        F.col("l_discount").alias("confidence"), F.lit(False).alias("heuristic"), F.array().cast("array<string>").alias("obs"), "l_linenumber"), "relation")
    tags = li.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("entity_id"), F.col("l_returnflag").alias("tag"), "l_linenumber")
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/graphs/{uuid.uuid4().hex}"
    for part in ("l_linenumber <= 3", "l_linenumber > 3", "l_linenumber <= 3"):  # the last is a replay
        sinks.save_graph({"relations": rels.where(part).drop("l_linenumber"), "tags": tags.where(part).drop("l_linenumber")}, where, 16)
    return (sinks.load_table(spark, where, "relations").select(F.lit("relation").alias("t"), "id", "confidence")
            .unionByName(sinks.load_table(spark, where, "tags").select(F.lit("tag").alias("t"), F.concat_ws("/", "entity_id", "tag").alias("id"), F.lit(0.0).alias("confidence"))))


@query("m04_insert_findings", """
WITH f AS (SELECT 'u' || user_id AS entity_id, event_type AS kind, CAST(event_id % 5 AS VARCHAR) AS attrs_key, ts, event_id % 2 AS half FROM events)
SELECT substr(sha256('finding' || chr(0) || entity_id || chr(0) || kind || chr(0) || attrs_key || chr(0)), 1, 32) AS id,
       epoch_us(coalesce(min(ts) FILTER (half = 0), min(ts))) AS created_at FROM f GROUP BY 1""")
def m04(spark, sf):
    e = table(spark, sf, "events")
    f = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("entity_id"), F.col("event_type").alias("kind"), F.lit("info").alias("severity"),
                 (F.col("event_id") % 5).cast("string").alias("attrs_key"), F.col("ts").alias("created_at"), (F.col("event_id") % 2).alias("half"))
    none = f.where("half = 2").drop("half", "attrs_key").withColumn("id", F.lit(""))
    first = merge.insert_findings(none, f.where("half = 0").drop("half"))
    return merge.insert_findings(first, f.where("half = 1").drop("half")).select("id", us("created_at").alias("created_at"))


@query("m04_make_findings", """
SELECT DISTINCT 'u' || user_id AS from_id, 'sha256:' || sha256(event_type || chr(0) || 'u' || user_id || chr(0) || 'kind' || chr(28) || event_type) AS value FROM events""")
def m04b(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.lit("low").alias("severity"), F.concat(F.lit("u"), F.col("user_id")).alias("subject"),
        F.concat(F.lit("kind\x1c"), F.col("event_type")).alias("key_attrs"))
    ents, rels = merge.make_findings(e)
    return rels.join(ents.withColumnRenamed("id", "to_id").select("to_id", "value"), "to_id").select("from_id", "value")


# --- T1-T3 ------------------------------------------------------------------------------------------


def _valid(spark, sf):
    o = views.obs(spark, sf)
    return (o.withColumn("valid_from", F.timestamp_micros(us("observed_at") - F.col("k").cast("long") * 3_600_000_000))
            .withColumn("valid_to", F.when(F.col("k") % 3 == 0, F.timestamp_micros(us("observed_at") + F.col("k").cast("long") * 7_200_000_000))))


@query("t01_validity_identity", "WITH " + views.OBS + """,
v AS (SELECT *, make_timestamp(epoch_us(observed_at) - CAST(k AS BIGINT) * 3600000000) AS vf FROM obs)
SELECT event_id, substr(sha256(source || chr(0) || subject || chr(0) || predicate || chr(0) || object_key || chr(0) ||
   strftime(vf, '%Y-%m-%dT%H:%M:%S') || regexp_replace(rtrim(strftime(vf, '.%f'), '0'), '\\.$', '') || 'Z'), 1, 32) AS id FROM v""")
def t01(spark, sf):
    return keys.with_ids(_valid(spark, sf).drop("id"), "observation").select("event_id", "id")


@query("t02_current_facts", "WITH " + views.OBS + """
SELECT subject, predicate, source, object_key, epoch_us(observed_at) AS observed_at FROM
 (SELECT *, row_number() OVER (PARTITION BY subject, predicate, source ORDER BY observed_at DESC, id DESC) AS rn FROM obs) WHERE rn = 1""")
def t02(spark, sf):
    return change.current_facts(views.obs(spark, sf)).select("subject", "predicate", "source", "object_key", us("observed_at").alias("observed_at"))


@query("t03_as_of", "WITH " + views.OBS + """,
v AS (SELECT *, epoch_us(observed_at) - CAST(k AS BIGINT) * 3600000000 AS vf,
             CASE WHEN k % 3 = 0 THEN epoch_us(observed_at) + CAST(k AS BIGINT) * 7200000000 END AS vt FROM obs),
t AS (SELECT epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS t)
SELECT subject, predicate, source, object_key, epoch_us(observed_at) AS observed_at FROM
 (SELECT *, row_number() OVER (PARTITION BY subject, predicate, source ORDER BY observed_at DESC, id DESC) AS rn FROM v, t
  WHERE vf <= t AND (vt IS NULL OR vt > t)) WHERE rn = 1""")
def t03(spark, sf):
    return change.as_of(_valid(spark, sf), "2024-01-15 12:00:00").select(
        "subject", "predicate", "source", "object_key", us("observed_at").alias("observed_at"))


# --- W3-W7 -------------------------------------------------------------------------------------------

BLOCK = 8  # records per case in the derived chain


def custody(spark, sf) -> DataFrame:
    """Custody records of every event, chained inside cases of eight.

    The chain inside a case is walked with an aggregate over its eight rows. Records
    divisible by 97 get another size after hashing; those = 5 mod 101 are then removed.
    """
    e = table(spark, sf, "events")
    row = F.struct("event_id", F.format_string("e%012d", "event_id").alias("id"), F.col("ts").alias("captured_at"),
                   F.sha2(F.col("props").cast("binary"), 256).alias("sha256"), F.length("props").cast("long").alias("size"))
    cases = e.groupBy(F.floor(F.col("event_id") / BLOCK).alias("c")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def fields(prev, r):
        sep = []
        for x in (prev, F.concat(F.lit("case"), F.col("c").cast("string")), F.lit("s1"), r["sha256"], r["size"].cast("string"),
                  F.lit("application/json"), F.lit("feed"), F.lit("pull"), F.lit("collector@1"), rfc3339(r["captured_at"]), blob_path(r["sha256"])):
            sep += [F.octet_length(x).cast("string"), F.lit(":"), x]
        return F.sha2(F.concat(*sep).cast("binary"), 256)

    def step(acc, r):
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(fixed.GENESIS_HASH))
        return F.concat(acc, F.array(fields(prev, r)))
    hashed = cases.withColumn("hs", F.aggregate("rows", F.array().cast("array<string>"), step))
    flat = hashed.select("c", "hs", F.posexplode("rows").alias("i", "r"))
    out = flat.select(
        "r.event_id", "r.id", F.concat(F.lit("case"), F.col("c").cast("string")).alias("case_id"), F.lit("s1").alias("scan_id"),
        "r.sha256", F.when(F.col("r.event_id") % 97 == 0, F.col("r.size") + 1).otherwise(F.col("r.size")).alias("size"),
        F.lit("application/json").alias("media_type"), F.lit("feed").alias("source"), F.lit("pull").alias("method"),
        F.lit("collector@1").alias("collector"), "r.captured_at", rfc3339(F.col("r.captured_at")).alias("captured_raw"),
        F.when(F.col("i") == 0, fixed.GENESIS_HASH).otherwise(F.get("hs", F.col("i") - 1)).alias("prev_hash"),
        F.get("hs", F.col("i")).alias("record_hash"), blob_path(F.col("r.sha256")).alias("blob_path"))
    return out.where(F.col("event_id") % 101 != 5)


_CUSTODY = """
cust AS (
  SELECT event_id, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'case' || (event_id // 8) AS case_id,
         CASE WHEN event_id % 8 = 0 THEN TRUE ELSE (event_id - 1) % 101 <> 5 END AS link_ok, event_id % 97 <> 0 AS hash_ok
  FROM events WHERE event_id % 101 <> 5)"""


@query("w03_evidence_links", "WITH " + _CUSTODY + "SELECT id, case_id, link_ok, hash_ok FROM cust")
def w03(spark, sf):
    return integrity.evidence_links(custody(spark, sf)).select("id", "case_id", "link_ok", "hash_ok")


@query("w03_verify_evidence", "WITH " + _CUSTODY + """
, v AS (SELECT case_id, count(*) AS checked, min(id) FILTER (NOT (link_ok AND hash_ok)) AS first_break,
  arg_min(CASE WHEN NOT link_ok THEN 'prev_hash does not match the previous record' ELSE 'record hash mismatch' END, id) FILTER (NOT (link_ok AND hash_ok)) AS problem FROM cust GROUP BY 1)
SELECT case_id, checked, first_break IS NULL AS ok, first_break, problem,
       (SELECT max(id) FROM cust c WHERE c.case_id = v.case_id AND (first_break IS NULL OR id < first_break)) AS head_id FROM v""")
def w03b(spark, sf):
    ev = custody(spark, sf)
    ids = ev.select(F.col("record_hash").alias("chain_head"), F.col("id").alias("head_id"))
    return (integrity.verify_evidence(ev).join(ids, "chain_head", "left")
            .select("case_id", "checked", "ok", "first_break", "problem", "head_id"))


@query("w04_verify_blobs", """
SELECT event_id, CASE WHEN NOT present THEN 'missing' WHEN altered THEN 'altered' ELSE 'present' END AS blob_state FROM
 (SELECT event_id, props, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 10 <> 3 AS present,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 10 = 4 AS altered FROM events)
WHERE event_id % 101 <> 5""")
def w04(spark, sf):
    ev = custody(spark, sf)
    k = F.regexp_extract("props", "(\\d+)", 1).cast("int") % 10
    blobs = table(spark, sf, "events").select("props").distinct().where(k != 3).select(
        blob_path(F.sha2(F.col("props").cast("binary"), 256)).alias("blob_path"),
        F.when(k == 4, F.concat("props", F.lit(" "))).otherwise(F.col("props")).cast("binary").alias("content"))
    return integrity.verify_blobs(ev, blobs).select("event_id", "blob_state")


@query("w06_chain_heads", "WITH " + _CUSTODY + "SELECT case_id, max(id) AS head_id, count(*) AS records FROM cust GROUP BY 1")
def w06(spark, sf):
    ev = custody(spark, sf)
    heads = integrity.chain_heads(ev)
    return heads.join(ev.select(F.col("record_hash").alias("head"), "id"), "head").select("case_id", F.col("id").alias("head_id"), "records")


@query("w07_record_at", """
SELECT o_orderkey AS id, o_orderpriority AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
WHERE o_orderpriority = '1-URGENT' AND k = 42""")
def w07(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("case_id"), F.col("o_orderdate").alias("captured_at"))
    return integrity.record_at(o, "1-URGENT", 42, width=86400 * 30).select("id", "case_id")


def audit_log(spark, sf) -> DataFrame:
    """Audit entries of every event. The chain restarts from genesis every eight entries,
    which is exactly a break at each restart; entries divisible by 89 were edited."""
    e = table(spark, sf, "events")
    row = F.struct(F.col("event_id").alias("seq"), F.timestamp_millis(F.unix_millis("ts")).alias("at"),
                   F.concat(F.lit("user"), F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("detail_json"))
    cases = e.groupBy(F.floor(F.col("event_id") / BLOCK).alias("c")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(acc, r):
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(fixed.GENESIS_HASH))
        parts = []
        for x in (prev, F.concat(F.unix_millis(r["at"]).cast("string"), F.lit("000000")), r["actor"], r["action"], r["detail_json"]):
            parts += [F.octet_length(x).cast("string"), F.lit(":"), x]
        return F.concat(acc, F.array(F.sha2(F.concat(*parts).cast("binary"), 256)))
    hashed = cases.withColumn("hs", F.aggregate("rows", F.array().cast("array<string>"), step)).select("hs", F.posexplode("rows").alias("i", "r"))
    return hashed.select(
        "r.seq", "r.at", "r.actor", F.when(F.col("r.seq") % 89 == 0, "edited").otherwise(F.col("r.action")).alias("action"), "r.detail_json",
        F.when(F.col("i") == 0, fixed.GENESIS_HASH).otherwise(F.get("hs", F.col("i") - 1)).alias("prev_hash"), F.get("hs", F.col("i")).alias("hash"))


@query("w05_audit_links", "SELECT event_id AS seq, event_id % 8 <> 0 OR event_id = 0 AS link_ok, event_id % 89 <> 0 AS hash_ok FROM events")
def w05(spark, sf):
    return integrity.audit_links(audit_log(spark, sf), width=1500).select("seq", "link_ok", "hash_ok")


@query("w05_verify_audit", "SELECT count(*) AS entries, FALSE AS ok, CAST(0 AS BIGINT) AS broken_at_seq, 'hash mismatch' AS reason FROM events")
def w05b(spark, sf):
    return integrity.verify_audit(audit_log(spark, sf), width=1500).select("entries", "ok", "broken_at_seq", "reason")


# --- P1, K1, P2, A16 --------------------------------------------------------------------------------------

_LISTED = """
ents AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS type, round((c_acctbal + 1000) / 11000, 4) AS confidence,
                CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS t1, CASE WHEN c_custkey % 3 = 0 THEN 'third' ELSE '' END AS t2, c_custkey FROM customer),
seen AS (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY 1),
hits AS (SELECT ents.*, last_seen FROM ents JOIN seen ON o_custkey = c_custkey
         WHERE type IN ('BUILDING', 'MACHINERY') AND confidence >= 0.2 AND t1 = 'even' AND t2 = 'third'
           AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))"""


def _listed(spark, sf):
    ck = F.col("c_custkey")
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    ents = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), ck).alias("id"), F.col("c_mktsegment").alias("type"), F.round((F.col("c_acctbal") + 1000) / 11000, 4).alias("confidence"),
        F.array_compact(F.array(F.when(ck % 2 == 0, "even").otherwise("odd"), F.when(ck % 3 == 0, "third"))).alias("tags"), "c_custkey").join(seen, "c_custkey")
    link = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("entity_id"), F.col("o_orderstatus").alias("scan_id"))
    return listing.list_entities(ents, types=["BUILDING", "MACHINERY"], min_conf=0.2, tags=["even", "third"], scan="F",
                                 entity_scans=link, limit=20, offset=5)


@query("p01_list_entities", "WITH " + _LISTED + """
SELECT id, type, confidence, epoch_us(last_seen) AS last_seen FROM hits ORDER BY confidence DESC, last_seen DESC, id LIMIT 20 OFFSET 5""")
def p01(spark, sf):
    _, page = _listed(spark, sf)
    return page.select("id", "type", "confidence", us("last_seen").alias("last_seen"))


@query("p01_list_total", "WITH " + _LISTED + "SELECT count(*) AS total FROM hits")
def p01b(spark, sf):
    return _listed(spark, sf)[0]


@query("k01_page", """
SELECT 'o' || o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, 'o' || o_orderkey LIMIT 25 OFFSET 50""")
def k01(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("last_seen"))
    return listing.page(o, 25, 50).select("id")


def _audit_rows(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"),
                                             F.concat(F.lit("user"), F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("action"))


@query("p02_query_audit", """
SELECT event_id AS seq, 'user' || (user_id % 7) AS actor, event_type AS action FROM events
WHERE user_id % 7 = 3 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_id >= 100
ORDER BY event_id DESC LIMIT 50""")
def p02(spark, sf):
    return metrics.query_audit(_audit_rows(spark, sf), "user3", "click", "2024-01-05", "2024-01-20", 100, 50).select("seq", "actor", "action")


@query("a16_audit_actions", "SELECT DISTINCT event_type AS action FROM events")
def a16(spark, sf):
    return metrics.audit_actions(_audit_rows(spark, sf))
