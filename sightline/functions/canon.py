"""Canonical forms as column expressions, one per entity type.

Each branch maps a trimmed text column to its canonical text, or NULL when the value
is not of that type. A branch takes the value and a set of :class:`Aids`: the host
part as an ASCII name, its address form, the NFC form and the mixed-case wallet form. The aids are the
only Arrow-batched Python, computed once per row set in one stage by
:func:`with_aids`. Called without aids a branch stays in the JVM and refuses non-ASCII hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import net
from sightline.functions.bind import decimal_number, let, whole_number
from sightline.functions.udfs import NON_ASCII, evm_checksum_column, idna_column, nfc_column

# ASCII and Unicode white space, as a trim of either side
_WS = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
HOSTED = ["domain", "subdomain", "url", "email"]


@dataclass(frozen=True)
class Aids:
    host: Column
    ip: Column
    nfc: Column
    evm: Column


def trim_text(v: Column) -> Column:
    return F.regexp_replace(v, f"^{_WS}+|{_WS}+$", "")


def _non_empty(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


def strip_url_parts(v: Column) -> Column:
    v = F.regexp_replace(v, "^(?s).*?://", "")
    return F.regexp_replace(v, "(?s)[/?#].*$", "")


def bare_host(v: Column) -> Column:
    """Host text of a name or URL: no scheme, path, port or final root dot."""
    name = F.regexp_replace(strip_url_parts(v), "(?s)^(.+):[0-9]+$", "$1")
    return F.regexp_replace(name, "\\.$", "")


def host_part(kind: Column, v: Column) -> Column:
    """The text that names a host (or is an address) inside a value of each hosted type."""
    whole = F.regexp_replace(v, "^//", "https://")
    named = (F.when(kind.isin("domain", "subdomain"), v)
             .when(kind == "email", F.regexp_extract(strip_url_parts(v), "(?s)@([^@]+)$", 1))
             .when(kind == "url", F.regexp_extract(whole, _URL, 2)))
    text = strip_url_parts(named)
    return F.when(kind == "ip", v).when(text.startswith("["), text).otherwise(bare_host(named))


def with_aids(df: DataFrame, kind: Column, value: Column, kinds: list[str] | None = None) -> tuple[DataFrame, Aids]:
    """Add the aid columns (one Arrow stage; Python sees NULL for ordinary rows).

    Every hosted type shares one address parse. ``kinds`` leaves out what cannot occur.
    """
    kinds = kinds or [*HOSTED, "ip", "wallet", "text"]
    hosted = [k for k in HOSTED if k in kinds]
    none = F.lit(None).cast("string")
    df = df.withColumn("__host_raw", F.when(kind.isin([*hosted, "ip"]), host_part(kind, value)) if hosted or "ip" in kinds else none)
    raw = F.col("__host_raw")
    df = df.withColumn("__host", F.when(kind.isin(hosted), idna_column(raw)) if hosted else none)
    df = df.withColumn("__nfc", nfc_column(value) if set(kinds) - set(PLAIN) else value)
    if "wallet" in kinds:
        is_evm = (kind == "wallet") & value.rlike("^(?i)(ethereum|eth):\\s*(0x)?[0-9a-f]{40}$")
        bare = F.regexp_replace(F.lower(F.regexp_replace(value, "(?s)^[^:]+:\\s*", "")), "^0x", "")
        df = df.withColumn("__evm", evm_checksum_column(bare, is_evm))
    else:
        df = df.withColumn("__evm", none)
    df = df.withColumn("__ip", ip(raw) if hosted or "ip" in kinds else none)
    return df, Aids(F.col("__host"), F.col("__ip"), F.col("__nfc"), F.col("__evm"))


AID_COLUMNS = ["__host_raw", "__host", "__ip", "__nfc", "__evm"]
# types whose canonical form never needs Unicode normalisation
PLAIN = ["domain", "subdomain", "ip", "cidr", "asn", "url", "email", "phone", "geo", "file", "image", "hash", "cert", "cve",
         "wallet", "tx"]


def _first_address(v: Column) -> Column:
    """Bracketed, zoned or ported literal to its canonical text: the text itself, else without its port."""
    inner = F.when(v.startswith("["), F.regexp_extract(v, "^\\[([^\\]]+)\\]", 1)).otherwise(v)

    def of(x: Column) -> Column:
        spellings = F.array(x, F.regexp_extract(x, "^(.+):[0-9]+$", 1))
        found = F.filter(F.transform(spellings, net.ip_key), lambda k: k.isNotNull())
        return let(F.get(found, F.lit(0)), net.key_text)

    return let(F.regexp_replace(inner, "(?<=.)%.*$", ""), of)


def ip(v: Column, aids: Aids | None = None) -> Column:
    if aids is not None:
        return aids.ip
    # plain and ported dotted quads are settled by patterns alone
    return (F.when(net.is_v4(v), v).when(v.rlike(net.V4[:-1] + ":[0-9]+$"), F.substring_index(v, ":", 1))
            .when(v.rlike("[:%\\[]"), _first_address(v)))


def _valid_host(host: Column) -> Column:
    return F.octet_length(host).between(1, 253) & ~host.rlike("(^|\\.)(\\.|$)")


def host_name(host: Column, literal: Column | None = None) -> Column:
    """ASCII lower-case host, or the canonical address when it is one."""
    if literal is None:
        return let(host, lambda h: let(ip(h), lambda a: F.when(a.isNotNull(), a).when(_valid_host(h), h)))
    return F.when(literal.isNotNull(), literal).when(~host.startswith("[") & _valid_host(host), host)


_PLAIN_NAME = "^(?:[A-Za-z0-9_-]++\\.)*+(?=[A-Za-z0-9_-]*[A-Za-z_-])[A-Za-z0-9_-]++\\.?$"


def domain(v: Column, aids: Aids | None = None) -> Column:
    if aids is not None:
        return host_name(aids.host, aids.ip)
    # a plain name, whose last label is no number, needs no parsing
    plain = F.regexp_replace(F.lower(v), "\\.$", "")
    text = strip_url_parts(v)
    host = F.when(text.startswith("["), text).otherwise(bare_host(v))
    parsed = let(host, lambda h: let(ip(h), lambda a: host_name(F.when(~h.rlike(NON_ASCII), F.lower(h)), a)))
    return F.when(v.rlike(_PLAIN_NAME), F.when(F.octet_length(plain) <= 253, plain)).otherwise(parsed)


_V4_CIDR = net.V4[:-1] + "/(3[0-2]|[12]?[0-9])$"


def _v4_cidr(v: Column) -> Column:
    bits = F.substring_index(v, "/", -1).cast("int")
    number = F.conv(net.v4_key(F.substring_index(v, "/", 1)), 16, 10).cast("long").bitwiseAND(
        F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(32) - bits))
    quad = [F.shiftright(number, 8 * i).bitwiseAND(255).cast("string") for i in (3, 2, 1, 0)]
    return F.concat(F.concat_ws(".", *quad), F.lit("/"), bits.cast("string"))


def cidr(v: Column, aids: Aids | None = None) -> Column:
    any_family = let(net.prefix_struct(v), lambda p: F.when(
        p.isNotNull(), F.concat(net.key_text(p["key"]), F.lit("/"), p["bits"].cast("string"))))
    return F.when(v.rlike(_V4_CIDR), _v4_cidr(v)).when(v.contains("/") & v.contains(":"), any_family)


def widen_to_cidr(v: Column) -> Column:
    """A bare address becomes its single-host prefix; a prefix has host bits cleared."""
    return F.coalesce(cidr(v), let(ip(v), lambda a: F.when(a.isNotNull(), F.concat(
        a, F.when(a.contains(":"), "/128").otherwise("/32")))))


def asn(v: Column, aids: Aids | None = None) -> Column:
    n = whole_number(F.regexp_extract(v, "^(?i)as(\\d{1,10})$", 1))
    return F.when(n.between(1, 4294967295), F.concat(F.lit("AS"), n.cast("string")))


def strip_tracking(query: Column) -> Column:
    """Drop tracking parameters by exact key, keep the order of the rest."""
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.element_at(F.split(p, "=", 2), 1).isin(fixed.TRACKING_PARAMS))
    # a pair with an empty value is written as its bare key
    return F.array_join(F.transform(kept, lambda p: F.regexp_replace(p, "^([^=]*)=$", "$1")), "&")


_URL = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)//(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)(?::(\\d*))?(?=[/?#]|$)([^?#]*)(\\?[^#]*)?(#.*)?$"
_USERINFO = "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#@]*@)"


def url(v: Column, aids: Aids | None = None) -> Column:
    whole = F.regexp_replace(v, "^//", "https://")
    if aids is None:
        host = domain(F.regexp_extract(whole, _URL, 2))
    else:
        host = host_name(aids.host, aids.ip)
    # one pass of the pattern, then a split on a byte no URL may hold
    pieces = F.split(F.regexp_replace(whole, _URL, "$1\x01$3\x01$4\x01$5\x01"), "\x01")

    def of(p: Column, host: Column) -> Column:
        scheme = F.lower(p[0])
        default = F.lit(None).cast("string")
        for name, number in fixed.DEFAULT_PORTS.items():
            default = F.when(scheme == name, number).otherwise(default)
        port_part = F.when((p[1] == "") | F.coalesce(default == p[1], F.lit(False)), "").otherwise(F.concat(F.lit(":"), p[1]))
        path = F.when(p[2] == "", "/").otherwise(p[2])
        query = F.when(p[3] == "", "").otherwise(let(strip_tracking(F.regexp_replace(p[3], "^\\?", "")), lambda q: F.when(
            q == "", "").otherwise(F.concat(F.lit("?"), q))))
        return F.when(F.size(p) == 5, F.concat(
            scheme, F.lit("://"), F.regexp_extract(whole, _USERINFO, 1), host, port_part, path, query))

    return F.when(~whole.rlike("[\\x00-\\x20\\x7F]"), let(pieces, host, of))


def email(v: Column, aids: Aids | None = None) -> Column:
    def of(bare: Column) -> Column:
        local = F.regexp_extract(bare, "(?s)^(.+)@([^@]+)$", 1)
        host = domain(F.regexp_extract(bare, "(?s)@([^@]+)$", 1)) if aids is None else host_name(aids.host, aids.ip)
        return F.when((local != "") & ~local.rlike("[ \\t]"), F.concat(local, F.lit("@"), host))

    return F.when(v.contains("@"), let(strip_url_parts(v), of))


def account(v: Column, aids: Aids | None = None) -> Column:
    def of(platform: Column, handle: Column) -> Column:
        ok = platform.rlike("^[a-z0-9][a-z0-9._-]{0,39}$") & (handle != "") & (F.octet_length(handle) <= 128)
        return F.when(ok, F.concat(platform, F.lit(":"), handle))

    t = v if aids is None else aids.nfc
    return let(F.lower(trim_text(F.regexp_extract(t, "(?s)^([^:]*):(.*)$", 1))),
               trim_text(F.regexp_extract(t, "(?s)^([^:]*):(.*)$", 2)), of)


def phone(v: Column, aids: Aids | None = None) -> Column:
    e164 = F.concat(F.lit("+"), F.regexp_replace(v, "\\P{Nd}", ""))
    return F.when(e164.rlike("^\\+[1-9][0-9]{6,14}$"), e164)


def nfc_text(v: Column, aids: Aids | None = None) -> Column:
    return v if aids is None else aids.nfc


def name_text(v: Column, aids: Aids | None = None) -> Column:
    return _non_empty(trim_text(F.regexp_replace(nfc_text(v, aids), f"{_WS}+", " ")))


_GEO = "^(-?\\d{1,3}(?:\\.\\d+)?),\\s*(-?\\d{1,3}(?:\\.\\d+)?)(@\\d+)?$"


def geo(v: Column, aids: Aids | None = None) -> Column:
    def six_places(text: Column, x: Column) -> Column:  # the sign of a negative zero stays
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.format_string("%.6f", F.bround(F.abs(x), 6)))

    def of(a: Column, b: Column) -> Column:
        lat, lon = decimal_number(a), decimal_number(b)
        return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(
            six_places(a, lat), F.lit(","), six_places(b, lon), F.regexp_extract(v, _GEO, 3)))

    return let(F.regexp_extract(v, _GEO, 1), F.regexp_extract(v, _GEO, 2), of)


def hex_text(v: Column, aids: Aids | None = None) -> Column:
    h = F.regexp_replace(F.lower(v), "^0x", "")
    return F.when(h.rlike("^[0-9a-f]+$"), h)


def digest(v: Column, aids: Aids | None = None) -> Column:
    """``alg:hex``; the algorithm of a bare digest follows from its length."""
    def of(alg: Column, h: Column) -> Column:
        named = F.when(alg != "", alg).when(F.length(h) == 32, "md5").when(F.length(h) == 40, "sha1") \
                 .when(F.length(h) == 64, "sha256").when(F.length(h) == 128, "sha512")
        return F.when(h.rlike("^[0-9a-f]+$"), F.concat(named, F.lit(":"), h))

    low = F.lower(v)
    return let(F.regexp_extract(low, "^([^:]+):", 1),
               F.regexp_replace(F.regexp_replace(low, "^[^:]+:", ""), "^0x", ""), of)


_CVE = "^(?i)cve-(\\d{4})-(\\d{4,7})$"


def cve(v: Column, aids: Aids | None = None) -> Column:
    year = whole_number(F.regexp_extract(v, _CVE, 1), "int")
    num = whole_number(F.regexp_extract(v, _CVE, 2), "int")
    return F.when(year.between(1999, 2999), F.format_string("CVE-%04d-%04d", year, num))


def wallet(v: Column, aids: Aids | None = None) -> Column:
    evm = F.lit(None).cast("string") if aids is None else aids.evm

    def of(chain: Column, low: Column) -> Column:
        bitcoin = chain.isin("bitcoin", "btc") | ((chain == "") & low.rlike("^[0-9a-z]{8,128}$"))
        return (F.when(evm.isNotNull(), F.concat(F.lit("ethereum:"), evm))
                .when(bitcoin, F.concat(F.lit("bitcoin:"), low))
                .when(chain != "", F.concat(chain, F.lit(":"), low)))

    return F.when(v.rlike("^[^:]+:|^[0-9A-Za-z]{8,128}$"), let(
        F.lower(F.regexp_extract(v, "(?s)^([^:]+):", 1)), F.lower(trim_text(F.regexp_replace(v, "(?s)^[^:]+:", ""))), of))


def transaction(v: Column, aids: Aids | None = None) -> Column:
    return F.when(v.rlike("(?s)^[^:]+:"), F.lower(v))


def lower_text(v: Column, aids: Aids | None = None) -> Column:
    return _non_empty(F.lower(trim_text(nfc_text(v, aids))))


def repository(v: Column, aids: Aids | None = None) -> Column:
    s = nfc_text(v, aids)
    for prefix in ("https://", "http://", "git://", "ssh://", "www\\."):
        s = F.regexp_replace(s, "^" + prefix, "")
    s = F.regexp_replace(F.regexp_replace(s, "\\.git$", ""), "/$", "")
    return let(F.split(s, "/"), lambda p: F.when(F.size(p) >= 2, F.concat_ws(
        "/", F.lower(F.element_at(p, 1)), F.element_at(p, -2), F.element_at(p, -1))))


def package(v: Column, aids: Aids | None = None) -> Column:
    def of(s: Column) -> Column:
        ns = F.lower(trim_text(F.regexp_extract(s, "(?s)^([^@]+)@(.*)$", 1)))
        name = F.lower(trim_text(F.regexp_extract(s, "(?s)^([^@]+)@(.*)$", 2)))
        short = let(ns, name, lambda a, b: F.when((a != "") & (b != ""),
                                                  F.concat(F.lit("pkg:generic/"), a, F.lit("/"), b)))
        return F.when(s.rlike("^pkg:[a-zA-Z0-9.+-]+/.+"), F.lower(s)).otherwise(short)

    return let(nfc_text(v, aids), of)


BRANCHES = {
    "domain": domain, "subdomain": domain, "ip": ip, "cidr": cidr, "asn": asn, "url": url,
    "email": email, "username": nfc_text, "account": account, "phone": phone,
    "person": name_text, "org": name_text, "location": name_text, "geo": geo,
    "file": hex_text, "image": hex_text, "hash": digest, "cert": digest, "cve": cve,
    "wallet": wallet, "tx": transaction, "app": lower_text, "repo": repository,
    "package": package, "ioc": lower_text, "text": nfc_text, "finding": lower_text,
}

REJECTS = {
    "domain": "not a host name", "ip": "not an IP address", "cidr": "not a prefix",
    "asn": "expected AS<number>", "url": "missing scheme or host", "email": "missing local part or domain",
    "account": "expected platform:handle", "phone": "not E.164", "geo": "expected lat,lon[@precision]",
    "file": "non-hex digest", "hash": "unrecognised digest", "cve": "expected CVE-YYYY-NNNN",
    "wallet": "missing chain prefix", "tx": "expected chain:hash", "repo": "expected host/owner/name",
    "package": "not a package URL",
}
REJECTS.update({"subdomain": REJECTS["domain"], "image": REJECTS["file"], "cert": REJECTS["hash"]})
