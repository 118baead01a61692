"""Host-name expressions: public suffix, scope of a domain, DN parts, stamps, dates, contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import canon, net
from sightline.functions.bind import let, trim_ws, whole_number

# --- F1, F2: public suffixes -----------------------------------------------------


def suffix_length(name: Column, rules: Sequence[str]) -> Column:
    """Number of labels in the public suffix of ``name``.

    For a short list of rules, which sits in the expression as a hash set; a full list is a
    table, see :mod:`sightline.operators.suffix`.
    """
    plain = [r for r in rules if not r.startswith(("*.", "!"))]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    spared = [r[1:] for r in rules if r.startswith("!")]
    def of(labels: Column) -> Column:
        n = F.size(labels)

        def tail(k: Column) -> Column:
            return F.array_join(F.slice(labels, n - k + 1, k), ".")

        def matches(k: Column) -> Column:
            hit = tail(k).isin(plain)
            if wild:
                hit = hit | F.when(k > 1, tail(k - 1)).otherwise("").isin(wild)
            return hit

        span = F.sequence(F.lit(1), n)
        found = [F.array_max(F.filter(span, matches)), F.lit(1)]
        if spared:
            found.insert(0, F.array_max(F.filter(span, lambda k: tail(k).isin(spared))) - 1)
        return F.coalesce(*found)

    return let(F.split(name, "\\."), of)


def _host(name: Column) -> Column:
    return F.regexp_replace(F.lower(trim_ws(name)), "\\.$", "")


def _split(name: Column, rules: Sequence[str]) -> Column:
    """struct(registrable, suffix), NULL for a bare suffix, a single label or an address."""
    def of(host: Column) -> Column:
        def parts(labels: Column, k: Column) -> Column:
            n = F.size(labels)
            return F.when(n > k, F.struct(
                F.array_join(F.slice(labels, n - k, k + 1), ".").alias("registrable"),
                F.array_join(F.slice(labels, n - k + 1, k), ".").alias("suffix")))
        usable = (host != "") & net.ip_key(host).isNull()
        return F.when(usable, let(F.split(host, "\\."), suffix_length(host, rules), parts))

    return let(_host(name), of)


def registrable(name: Column, rules: Sequence[str]) -> Column:
    """Suffix plus one label; NULL for a bare suffix, a single label or an address."""
    return _split(name, rules).getField("registrable")


def public_suffix(name: Column, rules: Sequence[str]) -> Column:
    return _split(name, rules).getField("suffix")


def in_domain(col: Column, root: Column | str, rules: Sequence[str]) -> Column:
    """Same registrable domain as ``root``, or below it, at a label boundary."""
    root_col = F.lit(root) if isinstance(root, str) else root
    return let(F.coalesce(registrable(col, rules), _host(col)),
               F.coalesce(registrable(root_col, rules), _host(root_col)),
               lambda mine, theirs: (mine != "") & (theirs != "") & (
                   (mine == theirs) | mine.endswith(F.concat(F.lit("."), theirs))))


# --- F3: names below one domain ----------------------------------------------------


def name_under(name: Column, domain: Column) -> Column:
    """Lower-case host strictly below ``domain``; NULL for wildcards, the apex and strangers."""
    def of(host: Column) -> Column:
        return F.when((host != "") & ~host.contains("*") & (host != domain)
                      & host.endswith(F.concat(F.lit("."), domain)), host)

    return let(F.regexp_replace(F.lower(canon.trim_text(name)), "\\.$", ""), of)


def names_under(df: DataFrame, domain: str, col: str = "name") -> DataFrame:
    from sightline.operators.canonicalise import with_host
    kept = df.withColumn("__under", name_under(F.col(col), F.lit(domain))).where(F.col("__under").isNotNull())
    return with_host(kept, "__under").where(F.col("host").isNotNull()).drop("__under")


# --- F4, F5: certificate fields ------------------------------------------------------


def dn_component(dn: Column, key: str) -> Column:
    """Value of one distinguished-name key; escaped commas stay inside the value."""
    pieces = F.regexp_extract_all(dn, F.lit("((?:\\\\.|[^,\\\\])+)"), 1)
    pieces = F.transform(pieces, lambda p: trim_ws(F.regexp_replace(p, "(?s)\\\\(.)", "$1")))
    mine = F.filter(pieces, lambda p: F.upper(trim_ws(F.regexp_extract(p, "^([^=]*)=", 1))) == key.upper())
    mine = F.filter(mine, lambda p: p.contains("="))
    return F.array_join(F.transform(mine, lambda p: trim_ws(F.regexp_replace(p, "^[^=]*=", ""))), ", ")


def issuer_label(friendly: Column, dn: Column) -> Column:
    """Published name, else organisation, else common name, else empty."""
    def blank(c: Column) -> Column:
        return let(trim_ws(c), lambda x: F.when(x != "", x))

    return F.coalesce(blank(friendly), blank(dn_component(dn, "O")), blank(dn_component(dn, "CN")), F.lit(""))


def serial(col: Column) -> Column:
    return F.regexp_replace(F.upper(trim_ws(col)), "[: ]", "")


# --- F6, F7, F8: stamps and dates ------------------------------------------------------


def capture_time(stamp: Column) -> Column:
    return F.when(stamp.rlike("^\\d{14}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def _parse(s: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    """First matching shape wins. The shape test keeps lenient parsing out."""
    return F.coalesce(*[F.when(s.rlike(rx), F.try_to_timestamp(s, F.lit(fmt))) for rx, fmt in shapes])


_D, _TM = "\\d{4}-\\d{2}-\\d{2}", "\\d{2}:\\d{2}:\\d{2}"
_ZONE = "(Z|[+-]\\d{2}:\\d{2})"
_FRACTIONS = [(f"^{_D}T{_TM}\\.\\d{{{n}}}{_ZONE}$", "yyyy-MM-dd'T'HH:mm:ss." + "S" * n + "XXX") for n in range(1, 10)]
_REG_SHAPES = [
    (f"^{_D}T{_TM}{_ZONE}$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    *_FRACTIONS,
    (f"^{_D}T{_TM}\\.\\d{{3}}\\+0000$", "yyyy-MM-dd'T'HH:mm:ss.SSSxx"),
    (f"^{_D}T{_TM}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (f"^{_D} {_TM}{_ZONE}$", "yyyy-MM-dd HH:mm:ssXXX"),
    (f"^{_D} {_TM}$", "yyyy-MM-dd HH:mm:ss"),
    (f"^{_D}$", "yyyy-MM-dd"),
    ("^\\d{2}-[A-Z][a-z]{2}-\\d{4}$", "dd-MMM-yyyy"),
    ("^\\d{2} [A-Z][a-z]{2} \\d{4}$", "dd MMM yyyy"),
    ("^[A-Z][a-z]{2} \\d{2} \\d{4}$", "MMM dd yyyy"),
    ("^\\d{4}/\\d{2}/\\d{2}$", "yyyy/MM/dd"),
    ("^\\d{8}$", "yyyyMMdd"),
    (f"^\\d{{2}}-[A-Z][a-z]{{2}}-\\d{{4}} {_TM} [A-Z]{{3,4}}$", "dd-MMM-yyyy HH:mm:ss z"),
    (f"^{_D} \\d{{2}}:\\d{{2}}$", "yyyy-MM-dd HH:mm"),
]


def parse_reg_date(col: Column) -> Column:
    """Registration date in any of the published layouts; NULL when withheld or unreadable."""
    return let(trim_ws(F.regexp_replace(trim_ws(col), "(?<=.)\\(.*$", "")), lambda s: _reg_date(s, col))


def _reg_date(s: Column, col: Column) -> Column:
    # two-digit years: 69-99 are the twentieth century, 00-68 the twenty-first
    yy = whole_number(F.regexp_extract(s, "^(\\d{2}-[A-Za-z]{3}-)(\\d{2})$", 2), "int")
    wide = F.concat(F.regexp_extract(s, "^(\\d{2}-[A-Za-z]{3}-)(\\d{2})$", 1),
                    F.when(yy >= 69, "19").otherwise("20"), F.lpad(yy.cast("string"), 2, "0"))
    return F.when(~withheld(col), F.coalesce(_parse(s, _REG_SHAPES), _parse(wide, [_REG_SHAPES[15]])))


_RDAP_SHAPES = [
    (f"^{_D}T{_TM}{_ZONE}$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    *_FRACTIONS,
    (f"^{_D}T{_TM}[+-]\\d{{4}}$", "yyyy-MM-dd'T'HH:mm:ssxx"),
    (f"^{_D}$", "yyyy-MM-dd"),
]


def parse_registry_date(col: Column) -> Column:
    return _parse(trim_ws(col), _RDAP_SHAPES)


# --- F9: withheld values and addresses ---------------------------------------------------


def _any_of(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def withheld(col: Column) -> Column:
    return F.coalesce(_any_of(F.lower(trim_ws(col)), fixed.REDACTION_MARKERS), F.lit(False))


def masked(col: Column) -> Column:
    low = F.lower(col)
    return F.coalesce(_any_of(low, fixed.MASK_MARKERS) | low.rlike("(^|[.@])[*x]{3,}") | col.contains("*"),
                      F.lit(False))


def extract_email(col: Column) -> Column:
    """The whole value as an address, lower-cased; NULL if masked or decorated in any way."""
    v = trim_ws(col)
    return F.when(~masked(v) & v.rlike("^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}$"), F.lower(v))


def placeholder(col: Column) -> Column:
    low = F.lower(trim_ws(F.coalesce(col, F.lit(""))))
    return (low == "") | low.isin(fixed.CARD_PLACEHOLDERS)


# --- F12-F15 --------------------------------------------------------------------------------


def expiry_flags(df: DataFrame, now: Column | str, col: str = "expires") -> DataFrame:
    """days_to_expiry (whole days toward zero, only 0..30), expired flag, soon flag."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    days = (F.unix_micros(F.col(col)) - F.unix_micros(at)) / F.lit(86400.0 * 1e6)
    return (df.withColumn("days_left", days)
            .withColumn("expired", F.coalesce(days < 0, F.lit(False)))
            .withColumn("expiring", F.coalesce(days.between(0, 30), F.lit(False)))
            .withColumn("days_to_expiry", F.when(days.between(0, 30), F.floor(days).cast("int"))))


def hold_severity(status: Column, registry: bool = True) -> Column:
    """Severity of a status list; spaces inside a status are ignored."""
    words = fixed.REGISTRY_HOLD_STATUSES if registry else fixed.TEXT_HOLD_STATUSES
    flat = F.transform(status, lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "\\s+https?://.*$", ""), "\\s", "")))
    held = F.exists(flat, lambda s: s.isin(words))
    return F.when(F.coalesce(held, F.lit(False)), "medium" if registry else "low").otherwise("info")


def response_class(text: Column, thick: Column) -> Column:
    """blank / rate-limited / empty answer / thick / thin."""
    low = F.lower(text)
    return (F.when(trim_ws(low) == "", "blank")
            .when(_any_of(low, fixed.RATE_LIMIT_MARKERS), "rate_limited")
            .when(_any_of(low, fixed.EMPTY_ANSWER_MARKERS), "empty")
            .when(thick, "thick").otherwise("thin"))


def referral_host(col: Column) -> Column:
    """host:port of a referral; NULL for blank or a label without a dot."""
    h = F.lower(trim_ws(col))
    h = F.regexp_replace(F.regexp_replace(h, "^.*?://", ""), "(?<=.)[/?#].*$", "")
    return let(h, lambda x: let(F.when(x.contains(":"), x).otherwise(F.concat(x, F.lit(":43"))),
                                lambda full: F.when((x != "") & full.contains("."), full)))


# --- F17: https hosts inside any JSON ----------------------------------------------------------


def internal_host(h: Column) -> Column:
    return let(h, net.ip_key(F.regexp_replace(h, "^\\[|\\]$", "")), _internal)


def _internal(h: Column, key: Column) -> Column:
    v4 = F.length(key) == 8
    internal_v4 = v4 & (
        key.startswith("7f") | key.startswith("0a") | key.startswith("c0a8") | key.startswith("a9fe")
        | (key == "00000000") | key.rlike("^ac1[0-9a-f]") | key.rlike("^e[0-9a-f]"))
    internal_v6 = ~v4 & (
        (key == "0" * 31 + "1") | (key == "0" * 32) | key.rlike("^f[cd]") | key.rlike("^fe[89ab]") | key.rlike("^ff"))
    named = h.isin(fixed.INTERNAL_HOSTS)
    for s in fixed.INTERNAL_HOST_SUFFIXES:
        named = named | h.endswith(s)
    return named | F.coalesce(internal_v4 | internal_v6, F.lit(False))


def hosts_in_json(df: DataFrame, col: str, group: str, max_hosts: int | None = None) -> DataFrame:
    """Distinct public https hosts in string values of any JSON text, per ``group``.

    The cap is a feature of the grant being modelled: the first ``max_hosts`` in name
    order. The partial top-n of the window keeps a hot group from reaching one task whole.
    """
    from pyspark.sql import Window
    urls = F.regexp_extract_all(F.col(col), F.lit('(?i)"\\s*https://([^"]+)"'), 1)
    host = F.lower(F.regexp_extract(F.col("__u"), "^(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:\\\\]+)", 1))
    found = (df.select(group, F.explode(urls).alias("__u"))
             .select(group, host.alias("host"))
             .where((F.col("host") != "") & ~internal_host(F.col("host")))
             .distinct())
    if max_hosts is None:
        return found
    order = Window.partitionBy(group).orderBy("host")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_hosts).drop("__n")
