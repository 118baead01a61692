"""IP address and prefix expressions, all in built-ins.

An address is parsed to a fixed-width hex key: 8 digits for v4, 32 for v6. For joins
the key becomes two 64-bit halves and a prefix becomes (family, bits, masked halves),
so containment of an address in a prefix is an equi-join on integers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.functions.bind import let, whole_number

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = f"^{OCTET}(\\.{OCTET}){{3}}$"
V4_LOOSE = "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"


def is_v4(v: Column) -> Column:
    return v.rlike(V4)


def v4_key(v: Column) -> Column:
    """8 hex digits of a valid dotted quad; plain arithmetic, so it stays in generated code."""
    parts = F.split(v, "\\.")
    octet = [F.get(parts, F.lit(i)).cast("long") for i in range(4)]
    number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def v4_text(key: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.substring(key, 1 + 2 * i, 2), 16, 10) for i in range(4)])


def _v6_groups_form(low: Column) -> Column:
    """Lower-cased literal with an embedded dotted quad rewritten as two groups."""
    tail = F.regexp_extract(low, "(?:^|:)(\\d+\\.\\d+\\.\\d+\\.\\d+)$", 1)
    return let(tail, lambda t: F.when(t == "", low).when(is_v4(t), let(v4_key(t), lambda h: F.concat(
        F.regexp_replace(low, "\\d+\\.\\d+\\.\\d+\\.\\d+$", ""),
        F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))))


def _groups(half: Column) -> Column:
    return F.filter(F.split(half, ":"), lambda g: g != "")


def _v6_expand(low: Column) -> Column:
    shaped = (low.rlike("^[0-9a-f:]+$") & low.contains(":") & ~low.contains(":::")
              & ~low.rlike("^:[^:]|[^:]:$|::.*::"))

    def fill(left: Column, right: Column, split: Column) -> Column:
        count = F.size(left) + F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - count), right)
        fits = F.when(split, count <= 7).otherwise(count == 8) & F.forall(
            F.concat(left, right), lambda g: F.length(g) <= 4)
        return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    halves = F.split(low, "::")
    right = F.when(F.size(halves) == 2, _groups(F.element_at(halves, 2))).otherwise(F.array().cast("array<string>"))
    return F.when(shaped, let(_groups(F.element_at(halves, 1)), right, F.size(halves) == 2, fill))


def v6_key(v: Column) -> Column:
    """32 hex digits of a v6 literal, NULL when it is not one."""
    return F.when(v.contains(":"), let(F.lower(v), lambda low: let(_v6_groups_form(low), _v6_expand)))


def v6_text(key: Column) -> Column:
    """Compressed lower-case form; the leftmost longest zero run of two or more is dropped."""
    def shrink(full: Column) -> Column:
        out = None
        for n in range(8, 1, -1):
            pattern = "(^|:)0(:0){%d}(:|$)" % (n - 1)
            hit, cut = full.rlike(pattern), F.regexp_replace(full, "^(.*?)" + pattern + "(.*)$", "$1::$5")
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(full)

    groups = F.regexp_replace(F.regexp_replace(key, "(.{4})(?=.)", "$1:"), "(^|:)0{1,3}(?=[0-9a-f])", "$1")
    return let(groups, shrink)


def ip_key(v: Column) -> Column:
    """Hex key of either family; a v4-mapped v6 literal is keyed as v4.

    Pass a plain column: the common v4 case is then evaluated without any lambda.
    """
    six = let(v, lambda x: let(v6_key(x), lambda k: F.when(
        k.startswith("0" * 20 + "ffff"), F.substring(k, 25, 8)).otherwise(k)))
    return F.when(is_v4(v), v4_key(v)).when(v.contains(":"), six)


def key_text(key: Column) -> Column:
    return F.when(F.length(key) == 8, v4_text(key)).when(F.length(key) == 32, v6_text(key))


def family(key: Column) -> Column:
    return F.when(F.length(key) == 8, 4).when(F.length(key) == 32, 6)


def mask_key(k: Column, n: Column) -> Column:
    """Keep the first ``n`` bits of a hex key, zero the rest, same width. Pass plain columns."""
    whole = F.floor(n / 4).cast("int")
    nibble = F.conv(F.substring(k, whole + 1, F.lit(1)), 16, 10).cast("int")
    keep = F.when(n % 4 == 1, 8).when(n % 4 == 2, 12).when(n % 4 == 3, 14).otherwise(0)
    part = F.when(n % 4 > 0, F.lower(F.hex(nibble.bitwiseAND(keep).cast("long")))).otherwise("")
    return F.rpad(F.concat(F.substring(k, F.lit(1), whole), part), F.length(k), F.lit("0"))


def fill_key(k: Column, n: Column) -> Column:
    """The last key under the first ``n`` bits of ``k``: the rest set to one. Pass plain columns."""
    whole = F.floor(n / 4).cast("int")
    nibble = F.conv(F.substring(k, whole + 1, F.lit(1)), 16, 10).cast("int")
    ones = F.when(n % 4 == 1, 7).when(n % 4 == 2, 3).when(n % 4 == 3, 1).otherwise(0)
    part = F.when(n % 4 > 0, F.lower(F.hex(nibble.bitwiseOR(ones).cast("long")))).otherwise("")
    return F.rpad(F.concat(F.substring(k, F.lit(1), whole), part), F.length(k), F.lit("f"))


def halves(key: Column) -> Column:
    """Hex key as struct(hi, lo) of signed 64-bit integers; v4 sits in ``lo``. Pass a plain column."""
    four = F.length(key) == 8
    hi = F.when(four, F.lit(0).cast("long")).otherwise(F.conv(F.substring(key, 1, 16), 16, -10).cast("long"))
    lo = F.when(four, F.conv(key, 16, 10).cast("long")).otherwise(F.conv(F.substring(key, 17, 16), 16, -10).cast("long"))
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _high_bits(width: Column) -> Column:
    """All ones shifted left by ``width`` (0..63)."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), width.cast("int"))


def mask_halves(family_: Column, hi: Column, lo: Column, bits: Column) -> Column:
    """struct(hi, lo) with only the first ``bits`` bits kept; integer arithmetic in generated code."""
    zero = F.lit(0).cast("long")
    hi6 = F.when(bits == 0, zero).when(bits < 64, hi.bitwiseAND(_high_bits(F.lit(64) - bits))).otherwise(hi)
    lo6 = F.when(bits <= 64, zero).otherwise(lo.bitwiseAND(_high_bits(F.lit(128) - bits)))
    lo4 = lo.bitwiseAND(_high_bits(F.lit(32) - bits))
    four = family_ == 4
    return F.struct(F.when(four, zero).otherwise(hi6).alias("hi"), F.when(four, lo4).otherwise(lo6).alias("lo"))


def prefix_struct(cidr: Column) -> Column:
    """``a.b.c.d/n`` or v6 to struct(family, bits, key); NULL when malformed. Host bits cleared."""
    addr = F.regexp_extract(cidr, "^([^/]+)/\\d{1,3}$", 1)
    bits = whole_number(F.regexp_extract(cidr, "/(\\d{1,3})$", 1), "int")
    raw = let(addr, lambda a: F.when(a.contains(":"), v6_key(a)).when(is_v4(a), v4_key(a)))
    return let(raw, bits, lambda k, n: F.when(
        k.isNotNull() & n.isNotNull() & (n <= F.length(k) * 4),
        F.struct(family(k).alias("family"), n.alias("bits"), mask_key(k, n).alias("key"))))


def ptr_name(v: Column) -> Column:
    """Reverse-tree name of an address of either family."""
    four = F.concat(F.array_join(F.reverse(F.split(v, "\\.")), "."), F.lit(".in-addr.arpa"))
    six = F.concat(F.regexp_replace(F.reverse(v6_key(v)), "(.)(?=.)", "$1."), F.lit(".ip6.arpa"))
    return F.when(is_v4(v), four).when(v.contains(":"), six)


def reversed_octets(v: Column) -> Column:
    return F.when(~v.contains(":") & (F.size(F.split(v, "\\.")) == 4),
                  F.array_join(F.reverse(F.split(v, "\\.")), "."))
