"""Network answers: geolocation, route origins, AS overviews, resolver answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import canon, net
from sightline.functions.bind import decimal_number, fenced, let, trim_ws, whole_number

GEO_A = ("success BOOLEAN, country_code STRING, region STRING, city STRING, latitude DOUBLE, longitude DOUBLE, "
         "connection STRUCT<asn: STRING, org: STRING, isp: STRING>")
GEO_B = "ip STRING, city STRING, region STRING, country STRING, loc STRING, org STRING, anycast BOOLEAN"
GEO_C = ("ipAddress STRING, latitude DOUBLE, longitude DOUBLE, countryCode STRING, regionName STRING, "
         "cityName STRING, asn STRING, asnOrganization STRING, isProxy BOOLEAN")


def as_number(s: Column) -> Column:
    """Digits of "15169", "AS15169" or "AS15169 Name"; empty when there are none or too many."""
    first = F.regexp_extract(trim_ws(s), "^([^ ,]+)", 1)
    return let(F.regexp_replace(F.regexp_replace(F.upper(first), "^AS", ""), "[^0-9]", ""),
               lambda d: F.when(F.length(d).between(1, 10), d).otherwise(""))


def _t(c: str) -> Column:
    return trim_ws(F.coalesce(F.col(c), F.lit("")))


def _first(*cols: str) -> Column:
    return F.coalesce(*[F.when(_t(c) != "", _t(c)) for c in cols], F.lit(""))


def normalise_geo(df: DataFrame, provider_col: str = "provider", col: str = "raw",
                  shapes: dict[str, str] | None = None) -> DataFrame:
    """Three provider shapes to one claim row each; failures and placeholders are dropped.

    ``shapes`` maps provider to shape a, b or c. One pass over the table: every row is
    parsed by its own provider's schema only.
    """
    shapes = shapes or {"a": "a", "b": "b", "c": "c"}
    keep = [c for c in df.columns if c != col]
    shape = F.create_map(*[F.lit(x) for kv in shapes.items() for x in kv])[F.col(provider_col)]
    d = df.select(*keep, shape.alias("__s"), F.col(col).alias("__raw"))
    d = (d.withColumn("a", F.when(F.col("__s") == "a", F.from_json("__raw", GEO_A)))
         .withColumn("b", F.when(F.col("__s") == "b", F.from_json("__raw", GEO_B)))
         .withColumn("c", F.when(F.col("__s") == "c", F.from_json("__raw", GEO_C))))
    loc = lambda i: decimal_number(F.regexp_extract(_t("b.loc"), "^\\s*([^,]+?)\\s*,\\s*([^,]+?)\\s*$", i))
    point_b = let(loc(1), loc(2), lambda la, lo: F.when(la.between(-90, 90) & lo.between(-180, 180), F.struct(la.alias("lat"), lo.alias("lon"))))
    pair = lambda la, lo: F.when(F.col(la).isNotNull() & F.col(lo).isNotNull(), F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon")))
    org_b = F.when(_t("b.org").rlike("^(?i)as") & _t("b.org").contains(" "),
                   trim_ws(F.regexp_replace(_t("b.org"), "^\\S+ ", ""))).otherwise(_t("b.org"))

    def claim(country, region, city, org, asn, point, anycast):
        return F.struct(country.alias("country"), region.alias("region"), city.alias("city"), org.alias("org"),
                        asn.alias("asn"), point["lat"].alias("lat"), point["lon"].alias("lon"), anycast.alias("anycast"))
    none = F.lit(None).cast("boolean")
    row = (F.when((F.col("__s") == "a") & F.coalesce("a.success", F.lit(True)) & F.col("a").isNotNull(), claim(
                F.upper(_t("a.country_code")), _t("a.region"), _t("a.city"), _first("a.connection.org", "a.connection.isp"),
                as_number(_t("a.connection.asn")), pair("a.latitude", "a.longitude"), none))
           .when((F.col("__s") == "b") & ((_t("b.ip") != "") | (_t("b.country") != "")), claim(
                F.upper(_t("b.country")), _t("b.region"), _t("b.city"), org_b, as_number(_t("b.org")), point_b, F.col("b.anycast")))
           .when((F.col("__s") == "c") & (_t("c.ipAddress") != ""), claim(
                F.upper(_t("c.countryCode")), _t("c.regionName"), _t("c.cityName"), _t("c.asnOrganization"),
                as_number(_t("c.asn")), pair("c.latitude", "c.longitude"), none)))
    return d.select(*keep, fenced(row).alias("__r")).where(F.col("__r").isNotNull()).select(*keep, "__r.*")


def parse_origin_txt(df: DataFrame, col: str = "txt") -> DataFrame:
    """asn | prefix | country | registry | date records; fewer than four fields or no number drops the row."""
    keep = [c for c in df.columns if c != col]
    p = F.split(trim_ws(col), "\\|")
    f = lambda i: F.regexp_replace(trim_ws(F.get(F.col("__p"), F.lit(i))), '^"+|"+$', "")
    d = df.withColumn("__p", p).where(F.size("__p") >= 4)
    d = d.select(*keep, trim_ws(f(0)).alias("asn"), trim_ws(f(1)).alias("prefix"), trim_ws(f(2)).alias("country"),
                 trim_ws(f(3)).alias("registry"), F.coalesce(trim_ws(F.get("__p", F.lit(4))), F.lit("")).alias("allocated"))
    return d.where(F.col("asn").rlike("^\\d{1,10}$"))


def parse_as_overview(df: DataFrame, col: str = "raw") -> DataFrame:
    """Holder, block and announced flag; error answers and blank holders are dropped."""
    keep = [c for c in df.columns if c != col]
    r = df.select(*keep, fenced(F.from_json(F.col(col), (
        "status STRING, status_code INT, data STRUCT<resource: STRING, holder: STRING, announced: BOOLEAN, "
        "block: STRUCT<resource: STRING, `desc`: STRING, name: STRING>>"))).alias("r"))
    status, code = F.coalesce("r.status", F.lit("")), F.coalesce("r.status_code", F.lit(0))
    ok = status.isin("ok", "success", "") & code.isin(0, 200)
    return (r.where(ok & (_t("r.data.holder") != ""))
            .select(*keep, _t("r.data.resource").alias("asn"), _t("r.data.holder").alias("holder"),
                    _t("r.data.block.resource").alias("block"), _t("r.data.block.desc").alias("block_desc"),
                    F.col("r.data.announced").alias("announced")))


def unquote_txt(data: Column) -> Column:
    """Concatenate quoted strings; blanks count only inside quotes; a backslash keeps the next character."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("quoted"), F.lit(False).alias("esc"))

    def step(acc: Column, ch: Column) -> Column:
        plain = ~acc["esc"]
        quote, slash, space = plain & (ch == '"'), plain & (ch == "\\"), plain & ch.isin(" ", "\t") & ~acc["quoted"]
        return F.struct(
            F.when(quote | slash | space, acc["out"]).otherwise(F.concat(acc["out"], ch)).alias("out"),
            F.when(quote, ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"), slash.alias("esc"))
    walked = F.aggregate(F.split(data, ""), start, step, lambda a: a["out"])
    return F.when(data.contains('"'), walked).otherwise(trim_ws(data))


def normalise_dns(df: DataFrame, col: str = "raw", question_type: str = "rrtype") -> DataFrame:
    """Resolver answer JSON to one row per answer, presentation forms unified.

    Columns kept from ``df`` identify question and resolver. A resolver with an empty
    answer keeps one row with NULL data; unparsable addresses are dropped.
    """
    keep = [c for c in df.columns if c != col]
    r = df.select(*keep, fenced(F.from_json(F.col(col), (
        "Status INT, Answer ARRAY<STRUCT<name: STRING, type: INT, TTL: INT, data: STRING>>"))).alias("r"))
    a = r.select(*keep, F.coalesce("r.Status", F.lit(0)).alias("status"), F.explode_outer("r.Answer").alias("a"))
    known = F.create_map(*[F.lit(x) for kv in fixed.RR_TYPES.items() for x in kv])
    a = a.withColumn("type", F.coalesce(known[F.col("a.type")], F.upper(F.col(question_type))))
    d, t = F.col("a.data"), F.col("type")
    strip = lambda c: F.regexp_replace(F.lower(c), "\\.$", "")
    two = trim_ws(d).rlike("^\\S+\\s+\\S+$")
    data = (F.when(t == "A", canon.ip(d)).when(t == "AAAA", canon.ip(d)).when(t.isin("CNAME", "NS", "PTR"), strip(d))
            .when(t.isin("MX", "SRV"), F.when(two, strip(F.regexp_extract(trim_ws(d), "(\\S+)$", 1))).otherwise(strip(d)))
            .when(t == "TXT", unquote_txt(d))
            .when((t == "CAA") & trim_ws(d).rlike("^\\S+\\s+\\S+\\s+\\S+$"),
                  F.regexp_replace(trim_ws(d), "^\\S+\\s+(\\S+)\\s+(\\S+)$", "$1;$2")).otherwise(d))
    pref = F.when(t.isin("MX", "SRV") & two, F.coalesce(whole_number(F.regexp_extract(trim_ws(d), "^(\\d+)", 1), "int"), F.lit(0))).otherwise(0)
    out = a.select(*keep, "status", F.when(F.col("a").isNotNull(), strip(F.col("a.name"))).alias("name"), "type",
                   F.when(F.col("a.TTL") > 0, F.col("a.TTL")).otherwise(0).alias("ttl"), pref.alias("pref"), fenced(data).alias("data"),
                   F.col("a").isNotNull().alias("answered"))
    return out.where(~F.col("answered") | F.col("data").isNotNull()).drop("answered")
