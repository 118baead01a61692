"""Registration records: free text and registry JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import names, net
from sightline.functions.bind import fenced, let, trim_ws, whole_number


def normal_key(k: Column) -> Column:
    return trim_ws(F.regexp_replace(F.lower(trim_ws(k)), "[_.\\-\\s]+", " "))


def _good_key(k: Column) -> Column:
    return k.rlike("^[A-Za-z0-9 /_.\\-]+$") & k.rlike("[A-Za-z]")


def _field_of(line: Column) -> Column:
    """struct(key, value) of a field line, NULL for prose."""
    def cut(rx: str) -> Column:
        return let(trim_ws(F.regexp_extract(line, rx, 1)), lambda k: F.when(_good_key(k) & (F.octet_length(k) <= 48), F.struct(
            k.alias("key"), trim_ws(F.regexp_extract(line, rx, 2)).alias("value"))))

    # the first form whose key is good decides, also where that key is too long
    colon, tab, blank = "^([^:]+):(.*)$", "^([^\\t]+)\\t(.*)$", "^(\\S+)\\s+(.*)$"
    good = lambda rx: _good_key(trim_ws(F.regexp_extract(line, rx, 1)))
    return F.when(good(colon), cut(colon)).when(good(tab), cut(tab)).when(F.length(F.regexp_extract(line, "^(\\S+)", 1)) <= 48, cut(blank))


def fields_of(text: Column) -> Column:
    """Array of struct(key, value) of a text's field lines, in their order; comments and prose are dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: trim_ws(F.regexp_replace(x, "\\r$", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("^[%#]"))
    return F.filter(F.transform(kept, _field_of), lambda f: f.isNotNull())


def key_values(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, key, value) of every field line; ``line_no`` counts field lines."""
    return df.select(id_col, F.posexplode(fields_of(F.col(text_col))).alias("line_no", "kv")).select(id_col, "line_no", "kv.key", "kv.value")


def _concept(key: Column) -> Column:
    out = None
    for concept, forms in fixed.REGISTRATION_KEYS.items():
        out = F.when(key.isin(forms), concept) if out is None else out.when(key.isin(forms), concept)
    return out


def _clean(v: Column) -> Column:
    return F.regexp_replace(let(trim_ws(v), lambda x: F.when(
        x.rlike("^.+? \\(.*\\)$"), trim_ws(F.regexp_extract(x, "^(.+?) \\(", 1))).otherwise(x)), '^"+|"+$', "")


def _hosts_in(v: Column) -> Column:
    return F.filter(
        F.transform(F.split(F.regexp_replace(v, ",", " "), "\\s+"),
                    lambda h: F.regexp_replace(F.lower(F.regexp_replace(h, "^[\\[\\]]+|[\\[\\]]+$", "")), "\\.$", "")),
        lambda h: h.contains(".") & ~h.rlike(net.V4) & ~h.contains(":"))


def parse_registration_text(df: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """One record per response, in its own row: no line leaves the response it came from.

    The synonym table is fixed and small, so it is a comparison chain. First values are the first that a filter over the fields leaves.
    """
    named = F.transform(fields_of(F.col(text_col)), lambda f: let(normal_key(f["key"]), lambda k: F.struct(
        k.alias("k"), _concept(k).alias("c"), f["value"].alias("v"))))
    rows = df.select(id_col, text_col).withColumn("__named", fenced(F.filter(named, lambda f: f["c"].isNotNull())))
    rows = rows.withColumn("__seen", fenced(F.transform("__named", lambda f: let(names.withheld(f["v"]), lambda hidden: F.struct(
        f["k"].alias("k"), f["c"].alias("c"), f["v"].alias("v"), hidden.alias("hidden"),
        F.when((f["c"] == "email") & ~hidden, names.extract_email(f["v"])).alias("mail"))))))

    def mine(concept: str) -> Column:
        return F.filter("__seen", lambda f: (f["c"] == concept) & ~f["hidden"])

    def first(concept: str, clean: bool = False) -> Column:
        values = F.transform(mine(concept), lambda f: _clean(f["v"]) if clean else f["v"])
        return F.get(F.filter(values, lambda v: v != ""), F.lit(0))

    distinct = lambda xs: F.array_sort(F.array_distinct(xs))
    mails = F.transform(F.filter("__seen", lambda f: f["mail"].isNotNull()), lambda f: F.struct(f["k"].alias("field"), f["mail"].alias("address")))
    masked = F.filter("__seen", lambda f: f["hidden"] | ((f["c"] == "email") & f["mail"].isNull() & names.masked(f["v"])))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = rows.select(
        id_col, text_col, first("registrar", True).alias("registrar"), first("registrar_host", True).alias("registrar_host"),
        F.lower(first("domain_name", True)).alias("domain_name"), first("created").alias("created"), first("expires").alias("expires"), first("updated").alias("updated"),
        none(distinct(F.flatten(F.transform(mine("name_server"), lambda f: _hosts_in(f["v"])))), "array<string>").alias("name_servers"),
        none(distinct(F.filter(F.transform(mine("status"), lambda f: f["v"]), lambda v: v != "")), "array<string>").alias("status"),
        none(distinct(mails), "array<struct<field:string,address:string>>").alias("emails"),
        none(distinct(F.transform(masked, lambda f: f["k"])), "array<string>").alias("redacted"))
    thick = (F.size("name_servers") > 0) | (F.size("emails") > 0) | F.col("created").isNotNull() | F.col("expires").isNotNull()
    return (out.withColumn("response_class", names.response_class(F.col(text_col), thick))
            .withColumn("created_at", names.parse_reg_date(F.col("created")))
            .withColumn("expires_at", names.parse_reg_date(F.col("expires")))
            .withColumn("updated_at", names.parse_reg_date(F.col("updated")))
            .withColumn("referral", names.referral_host(F.col("registrar_host")))
            .withColumn("severity", names.hold_severity(F.col("status"), registry=False))
            .drop(text_col))


def merge_registration(registry: DataFrame, registrar: DataFrame, key: str = "domain_name") -> DataFrame:
    """Registry record completed by the registrar's: the registry wins wherever it spoke."""
    scalars = ["registrar", "registrar_host", "created", "expires", "updated"]
    lists = ["name_servers", "status", "redacted"]
    a, b = registry.alias("a"), registrar.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    text = lambda c: F.when(trim_ws(F.col(c)) != "", F.col(c))
    arr = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    st = "array<struct<field:string,address:string>>"
    known = F.transform(arr("a.emails", st), lambda e: e["address"])
    mails = F.concat(arr("a.emails", st), F.filter(arr("b.emails", st), lambda e: ~F.array_contains(known, e["address"])))
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key),
                    *[F.coalesce(text(f"a.{c}"), text(f"b.{c}")).alias(c) for c in scalars],
                    *[F.array_sort(F.array_union(arr(f"a.{c}", "array<string>"), arr(f"b.{c}", "array<string>"))).alias(c) for c in lists],
                    F.array_sort(mails).alias("emails"))


# --- registry JSON -----------------------------------------------------------------------

_ENTITY1 = "handle: STRING, roles: ARRAY<STRING>, vcardArray: VARIANT"
_ENTITY = f"STRUCT<{_ENTITY1}, entities: ARRAY<STRUCT<{_ENTITY1}>>>"
RDAP = (
    "objectClassName STRING, handle STRING, ldhName STRING, unicodeName STRING, name STRING, country STRING, "
    "startAutnum BIGINT, status ARRAY<STRING>, port43 STRING, "
    "events ARRAY<STRUCT<eventAction: STRING, eventDate: STRING>>, "
    "nameservers ARRAY<STRUCT<ldhName: STRING, unicodeName: STRING>>, secureDNS STRUCT<delegationSigned: BOOLEAN>, "
    f"entities ARRAY<{_ENTITY}>, "
    "redacted ARRAY<STRUCT<name: STRUCT<type: STRING, description: STRING>, method: STRING>>, "
    "remarks ARRAY<STRUCT<title: STRING, description: ARRAY<STRING>>>")


def card_properties(card: Column) -> Column:
    """(name, value) of every complete property of a jCard, given as a VARIANT: parsed once, read by path. Component arrays are joined."""
    def value(p: Column) -> Column:
        parts = F.try_variant_get(p, "$[3]", "array<string>")
        joined = F.array_join(F.filter(F.transform(parts, lambda x: trim_ws(x)), lambda x: x != ""), ", ")
        return F.when(parts.isNotNull(), joined).otherwise(F.coalesce(trim_ws(F.try_variant_get(p, "$[3]", "string")), F.lit("")))

    whole = F.filter(F.try_variant_get(card, "$[1]", "array<variant>"), lambda p: F.try_variant_get(p, "$[3]", "variant").isNotNull())
    named = F.transform(whole, lambda p: F.struct(F.lower(trim_ws(F.try_variant_get(p, "$[0]", "string"))).alias("name"), value(p).alias("value")))
    return F.when(F.try_variant_get(card, "$[0]", "string") == "vcard", named)


def card_values(properties: Column, prop: str) -> Column:
    """Every value of one property, from :func:`card_properties`."""
    mine = F.transform(F.filter(properties, lambda p: p["name"] == prop), lambda p: p["value"])
    return F.coalesce(mine, F.array().cast("array<string>"))


def card_emails(properties: Column) -> Column:
    """Distinct addresses (ignoring case), placeholders left out, first spelling kept."""
    listed = F.filter(F.transform(card_values(properties, "email"), lambda e: trim_ws(e)), lambda e: ~names.placeholder(e) | (F.lower(e) == "privacy redacted"))

    def first_spelling(xs: Column) -> Column:
        low = F.transform(xs, lambda x: F.lower(x))
        return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return let(listed, first_spelling)


def card_name(properties: Column) -> Column:
    pick = lambda p: let(F.get(card_values(properties, p), F.lit(0)), lambda v: F.when(trim_ws(v) != "", trim_ws(v)))
    return F.coalesce(pick("fn"), pick("org"), pick("n"))


def card_phones(properties: Column) -> Column:
    return F.filter(F.transform(card_values(properties, "tel"), lambda p: F.regexp_replace(trim_ws(p), "^tel:", "")), lambda p: p != "")


def vcard_cols(df: DataFrame, col: str = "vcard") -> DataFrame:
    """Name, addresses and numbers of a jCard column (JSON text)."""
    props = F.col("__card")
    df = df.withColumn("__card", fenced(card_properties(F.try_parse_json(F.col(col)))))
    return (df.withColumn("card_name", card_name(props)).withColumn("card_emails", card_emails(props))
            .withColumn("card_phones", card_phones(props)).drop("__card"))


def _with_role(entities: Column, role: str) -> Column:
    return F.filter(entities, lambda e: F.exists(e["roles"], lambda r: F.lower(r) == role))


def abuse_emails(entities: Column) -> Column:
    """Addresses of the abuse contact: abuse role, else nested under the registrar, else the registrar."""
    def some(cards: Column) -> Column:
        found = F.filter(F.transform(cards, lambda e: let(card_properties(e["vcardArray"]), card_emails)), lambda m: F.size(m) > 0)
        return F.get(found, F.lit(0))
    registrar = F.get(_with_role(entities, "registrar"), F.lit(0))
    return F.coalesce(some(_with_role(entities, "abuse")),
                      let(registrar, lambda r: some(_with_role(r["entities"], "abuse"))),
                      let(registrar, lambda r: some(F.array(r))))


def abuse_contact(df: DataFrame, col: str = "entities") -> DataFrame:
    return df.withColumn("abuse_emails", F.coalesce(abuse_emails(F.col(col)), F.array().cast("array<string>")))


def _event(action: str) -> Column:
    mine = F.filter("r.events", lambda e: F.lower(e["eventAction"]) == action)
    return names.parse_registry_date(F.get(mine, F.lit(0))["eventDate"])


def parse_rdap(df: DataFrame, col: str = "raw") -> DataFrame:
    """Registry object JSON to registration columns; documents naming no object are dropped."""
    keep = [c for c in df.columns if c != col]
    r = df.select(*keep, fenced(F.from_json(F.col(col), RDAP)).alias("r"))
    named = F.coalesce("r.objectClassName", "r.handle", "r.ldhName", F.lit("")) != ""
    r = r.where(named | (F.coalesce("r.startAutnum", F.lit(0)) != 0))
    ent = F.coalesce(F.col("r.entities"), F.from_json(F.lit("[]"), f"array<{_ENTITY}>"))
    strip = lambda c: F.regexp_replace(F.lower(c), "\\.$", "")
    registrar = F.get(_with_role(ent, "registrar"), F.lit(0))
    ns = F.transform("r.nameservers", lambda n: F.coalesce(
        F.when(strip(n["ldhName"]) != "", strip(n["ldhName"])), strip(n["unicodeName"]), F.lit("")))
    status = F.array_sort(F.filter(F.transform("r.status", lambda s: trim_ws(s)), lambda s: s != ""))
    low_set = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != "")))
    red = low_set(F.transform("r.redacted", lambda x: F.lower(trim_ws(x["name"]["type"]))))
    how = low_set(F.transform("r.redacted", lambda x: F.lower(trim_ws(x["method"]))))
    remarks = F.flatten(F.transform("r.remarks", lambda m: F.transform(
        F.filter(F.transform(m["description"], lambda d: trim_ws(d)), lambda d: d != ""),
        lambda d: F.when(trim_ws(F.coalesce(m["title"], F.lit(""))) != "", F.concat(trim_ws(m["title"]), F.lit(": "), d)).otherwise(d))))
    none = F.array().cast("array<string>")
    out = r.select(
        *keep, F.col("r.objectClassName").alias("object_class"), F.col("r.handle").alias("handle"),
        strip(F.col("r.ldhName")).alias("domain_name"), F.coalesce(status, none).alias("status"),
        _event("registration").alias("created_at"), _event("expiration").alias("expires_at"),
        _event("last changed").alias("changed_at"), F.coalesce(low_set(ns), none).alias("name_servers"),
        F.coalesce("r.secureDNS.delegationSigned", F.lit(False)).alias("signed"),
        let(registrar, lambda g: F.coalesce(let(card_properties(g["vcardArray"]), card_name), F.when(g["handle"] != "", g["handle"]))).alias("registrar"),
        F.coalesce(abuse_emails(ent), none).alias("abuse_emails"), F.coalesce(red, none).alias("redacted"),
        F.coalesce(how, none).alias("redaction_methods"), F.coalesce(F.array_join(remarks, "\n"), F.lit("")).alias("remarks"))
    return out.withColumn("severity", names.hold_severity(F.col("status"), registry=True))


def read_bootstrap(df: DataFrame, kind: str, col: str = "raw") -> DataFrame:
    """Bootstrap document to rule rows × endpoint; http dropped where the host is also on https.

    ``kind``: dns, ipv4, ipv6 or asn. Columns: key, url, host, ord; plus prefix or lo/hi.
    """
    doc = fenced(F.from_json(F.col(col), "services ARRAY<ARRAY<ARRAY<STRING>>>"))
    svc = df.select(doc.alias("d")).select(F.posexplode("d.services").alias("ord", "e")).where(F.size("e") >= 2)
    clean = lambda xs: F.filter(F.transform(xs, lambda x: trim_ws(x)), lambda x: x != "")
    svc = svc.select("ord", clean(F.col("e")[0]).alias("keys"), clean(F.col("e")[1]).alias("urls"))
    host = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), "^.*?://", ""), "[/?#].*$", "")
    secure = F.transform(F.filter("urls", lambda u: F.lower(u).startswith("https://")), host)
    svc = svc.withColumn("secure", secure)
    svc = svc.withColumn("urls", F.filter("urls", lambda u: F.lower(u).startswith("https://") | ~F.array_contains("secure", host(u))))
    key = F.lower(trim_ws(F.col("k")))
    if kind == "asn":
        key = F.regexp_replace(F.regexp_replace(key, "^asn", ""), "^as", "")
    rows = (svc.select("ord", "urls", F.explode("keys").alias("k")).select("ord", "urls", key.alias("key"))
            .where(F.col("key") != "").select("ord", "key", F.explode("urls").alias("url")))
    rows = rows.withColumn("host", host(F.col("url")))
    if kind in ("ipv4", "ipv6"):
        return rows.withColumn("prefix", F.col("key")).where(net.prefix_struct(F.col("key")).isNotNull())
    if kind == "asn":
        lo = whole_number(trim_ws(F.regexp_extract("key", "^([^-]+)", 1)))
        hi = F.when(F.col("key").contains("-"), whole_number(trim_ws(F.regexp_extract("key", "-(.*)$", 1)))).otherwise(lo)
        return rows.withColumn("lo", lo).withColumn("hi", hi).where(
            (F.col("lo") > 0) & (F.col("hi") >= F.col("lo")) & (F.col("hi") <= 4294967295))
    return rows.withColumnRenamed("key", "tld") if kind == "dns" else rows
