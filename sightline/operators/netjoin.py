"""Suffix, prefix and interval joins.

None of them compares every row with every rule. A name is exploded into its label
suffixes, which meet the rules on equality; prefixes and intervals are flattened into
disjoint segments, in which an address or a number is looked up in one ordered pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import net
from sightline.functions.bind import fenced, let, trim_ws
from sightline.operators import segments
from sightline.operators.skew import attach, spread


NET = ["family", "bits", "net_hi", "net_lo"]
LISTS = 64


def masked(df: DataFrame, hi: str, lo: str) -> DataFrame:
    """Add net_hi / net_lo: the halves masked to ``bits``."""
    m = net.mask_halves(F.col("family"), F.col(hi), F.col(lo), F.col("bits"))
    return df.withColumn("__m", fenced(m)).select("*", F.col("__m.hi").alias("net_hi"), F.col("__m.lo").alias("net_lo")).drop("__m")


def with_prefix(rules: DataFrame, col: str) -> DataFrame:
    """Add family, bits, net_hi, net_lo of a prefix column; malformed rows are dropped."""
    d = rules.withColumn("__p", fenced(net.prefix_struct(F.col(col)))).where(F.col("__p").isNotNull())
    d = d.select("*", F.col("__p.family").alias("family"), F.col("__p.bits").alias("bits"), F.col("__p.key").alias("__k"))
    h = d.withColumn("__h", fenced(net.halves(F.col("__k"))))
    return h.select("*", F.col("__h.hi").alias("net_hi"), F.col("__h.lo").alias("net_lo")).drop("__p", "__k", "__h")


#: Lines of keys: v4 and v6 addresses, whole numbers. Digits that name a block of rules and a slot of addresses.
V4, V6, NUMBER = 4, 6, 0
BLOCK_DIGITS = {V4: 2, V6: 2}
SLOT_DIGITS = {V4: 4, V6: 10}
NUMBER_WIDTH = 16


def _prefix_ranges(rules: DataFrame, col: str, carried: list[str], urgent: Column) -> DataFrame:
    """Prefix rows as ranges of hexadecimal keys with a rank: urgent rules first, then longer ones, then the larger row."""
    d = rules.withColumn("__p", fenced(net.prefix_struct(F.col(col)))).where(F.col("__p").isNotNull())
    width = F.length("__p.key")
    last = net.fill_key(F.col("__k"), F.col("__bits"))
    d = d.withColumns({"__k": F.col("__p.key"), "__bits": F.col("__p.bits"), "__width": width, "__urgent": urgent.cast("int")})
    one = d.groupBy(F.col("__p.family").alias("space"), F.col("__k"), F.col("__bits"), F.col("__urgent")).agg(F.max(F.struct(*carried)).alias("rule"))
    rank = -(F.col("__urgent") * 1000 + F.col("__bits"))
    return one.select("space", F.col("__k").alias("first"), last.alias("last"), rank.alias("rank"), F.col("__bits").alias("bits"), "rule")


def _blocks_of(digits: dict[int, int]) -> Column:
    """Names of all blocks between the first and the last key of a range."""
    n = F.lit(None).cast("int")
    for space, d in digits.items():
        n = F.when(F.col("space") == space, d).otherwise(n)
    number = lambda c: F.conv(F.left(c, n), 16, 10).cast("long")
    return F.transform(F.sequence(number(F.col("first")), number(F.col("last"))), lambda b: F.lower(F.lpad(F.hex(b), n, F.lit("0"))))


def best_prefix(addrs: DataFrame, addr_col: str, rules: DataFrame, prefix_col: str, carried: list[str], urgent: Column | None = None) -> DataFrame:
    """The winning rule per distinct address: urgent rules first, then the longest prefix; of equal rules the largest row.

    Nested prefixes are flattened into disjoint segments of the address line, in which each address is looked up once
    (see :mod:`sightline.operators.segments`). Addresses no rule contains are absent.
    """
    marks = segments.markers(_prefix_ranges(rules, prefix_col, carried, F.lit(False) if urgent is None else urgent), _blocks_of(BLOCK_DIGITS), BLOCK_DIGITS)
    points = (addrs.select(F.col(addr_col).alias("__addr")).where(F.col("__addr").isNotNull()).distinct()
              .withColumn("pos", fenced(net.ip_key(F.col("__addr")))).where(F.col("pos").isNotNull()).withColumn("space", net.family(F.col("pos"))))
    won = segments.looked_up(points.select("space", "pos", "__addr"), marks, SLOT_DIGITS).where("won IS NOT NULL")
    return won.select(F.col("__addr").alias(addr_col), F.col("won.bits").alias("bits"), *[F.col("won.rule")[c].alias(c) for c in carried])


def longest_prefix(addrs: DataFrame, prefixes: DataFrame, addr_col: str = "addr",
                   prefix_col: str = "prefix") -> DataFrame:
    """Each address row with the most specific prefix row that contains it (or NULLs)."""
    carried = prefixes.columns
    best = best_prefix(addrs, addr_col, prefixes, prefix_col, carried).drop("bits")
    return attach(addrs, best, addr_col).select(*addrs.columns, *carried)


def interval_lookup(points: DataFrame, ranges: DataFrame, point: str = "asn", lo: str = "lo", hi: str = "hi",
                    order: str = "ord", bits: int = 32) -> DataFrame:
    """First range (by ``order``) containing each point; NULLs where none does. Points and bounds are numbers of up to ``bits`` bits.

    Ranges are flattened into disjoint segments, so one that covers everything is no hot key. Rules are swept in 256 blocks.
    """
    carried = ranges.columns
    digits = {NUMBER: NUMBER_WIDTH - max(0, bits - 8) // 4}
    key = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("long")), NUMBER_WIDTH, F.lit("0")))
    valid = ranges.where((F.col(hi) >= F.greatest(F.col(lo), F.lit(0))) & F.col(order).isNotNull())
    bounded = valid.withColumn("__lo", F.greatest(F.col(lo), F.lit(0)).cast("long"))
    spans = bounded.select(F.lit(NUMBER).alias("space"), key("__lo").alias("first"), key(hi).alias("last"), F.col(order).alias("rank"), F.struct(*carried).alias("rule"))
    marks = segments.markers(spans, _blocks_of(digits), digits)
    asked = points.select(F.col(point).cast("long").alias("__n")).where("__n >= 0").distinct().select(F.lit(NUMBER).alias("space"), key("__n").alias("pos"), "__n")
    won = segments.looked_up(asked, marks, {NUMBER: digits[NUMBER] + 2}).where("won IS NOT NULL").select("__n", F.col("won.rule").alias("__r"))
    out = attach(points.withColumn("__n", F.col(point).cast("long")), won, "__n")
    return out.select(*points.columns, *[F.col("__r")[c].alias(c) for c in carried])


def tld_lookup(names: DataFrame, tlds: DataFrame, col: str = "name") -> DataFrame:
    """Endpoints of the last label of each name; left join."""
    keyed = names.withColumn("tld", F.lower(F.element_at(F.split(F.regexp_replace(F.col(col), "\\.$", ""), "\\."), -1)))
    return keyed.join(tlds, "tld", "left")


def label_suffixes(name: Column) -> Column:
    """Array of struct(suffix, depth); depth 0 is the whole name."""
    def of(labels: Column) -> Column:
        n = F.size(labels)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.array_join(F.slice(labels, i + 1, n - i), ".").alias("suffix"), i.alias("depth")))
    return let(F.split(name, "\\."), of)


def suffix_pairs(names: DataFrame, col: str, rules: DataFrame, suffix_col: str = "suffix") -> DataFrame:
    """(distinct name, rule) pairs where the rule's suffix ends the name at a label boundary."""
    parts = (names.select(col).where(F.col(col).isNotNull()).distinct()
             .withColumn("__s", F.explode(label_suffixes(F.col(col))))
             .select(col, F.col("__s.suffix").alias(suffix_col), F.col("__s.depth").alias("depth")))
    return parts.join(rules, suffix_col)


def tag_shared(df: DataFrame, col: str = "name", suffixes: dict[str, str] = fixed.SHARED_SUFFIXES) -> DataFrame:
    """Hosting platform named by a strict suffix of the host; the list order decides.

    Twenty-seven fixed suffixes sit in the expression, so no join is planned.
    """
    host = F.regexp_replace(F.lower(F.col(col)), "\\.$", "")

    def pick(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for suffix, provider in reversed(list(suffixes.items())):
            out = F.when(h.endswith("." + suffix), provider).otherwise(out)
        return out
    return (df.withColumn("shared_provider", let(host, pick))
            .withColumn("shared_infrastructure", F.col("shared_provider").isNotNull()))


def classify_address(df: DataFrame, col: str = "addr",
                     classes: list[tuple[str, str]] = fixed.ADDRESS_CLASSES) -> DataFrame:
    """Most specific special-purpose class of an address, ``public`` where none holds."""
    spark = df.sparkSession
    rules = spark.createDataFrame(classes, "cidr string, address_class string")
    best = best_prefix(df, col, rules, "cidr", ["address_class", "cidr"]).select(col, "address_class", F.col("cidr").alias("matched"))
    out = attach(df, best, col)
    valid = net.ip_key(F.col(col)).isNotNull()
    return out.withColumn("address_class", F.when(valid, F.coalesce(F.col("address_class"), F.lit("public")))
                          .otherwise("invalid"))


def origin_of(ips: DataFrame, origins: DataFrame, holders: DataFrame, addr_col: str = "addr") -> tuple[DataFrame, DataFrame]:
    """(addresses with origin ASN, prefix, holder; addresses no route covers)."""
    routed = longest_prefix(ips, origins, addr_col, "prefix")
    found = routed.where(F.col("prefix").isNotNull())
    held = attach(found, holders.groupBy("asn").agg(F.min("holder").alias("holder")), "asn")
    missing = routed.where(F.col("prefix").isNull()).select(*ips.columns)
    return held, missing


def fcrdns(ptr: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward-confirm pointers.

    ``ptr``: (addr, name); ``answers``: (name, type, data). Returns pointers with
    confirmed / kind / severity, and the other addresses each pointer leads to.
    """
    pointers = ptr.select("addr", F.regexp_replace(F.lower(trim_ws("name")), "\\.$", "").alias("name")).distinct()
    forward = (answers.where(F.upper("type").isin("A", "AAAA"))
               .select(F.regexp_replace(F.lower(trim_ws("name")), "\\.$", "").alias("name"),
                       fenced(let(net.ip_key(trim_ws("data")), net.key_text)).alias("fwd"))
               .where(F.col("fwd").isNotNull()).distinct())
    confirmed = pointers.join(forward.withColumnRenamed("fwd", "addr").withColumn("__hit", F.lit(True)),
                              ["name", "addr"], "left")
    resolved = forward.groupBy("name").agg(F.count(F.lit(1)).alias("n_forward"))
    out = attach(confirmed, resolved, "name")
    out = (out.withColumn("confirmed", F.coalesce("__hit", F.lit(False))).drop("__hit")
           .withColumn("n_forward", F.coalesce("n_forward", F.lit(0)))
           .withColumn("kind", F.when(F.col("confirmed"), "reverse-dns-ptr").otherwise("reverse-dns-fcrdns-mismatch"))
           .withColumn("severity", F.when(F.col("confirmed"), "info").otherwise("low")))
    return tag_shared(out, "name"), _others(pointers, forward)


def _others(pointers: DataFrame, forward: DataFrame) -> DataFrame:
    """Each pointer with every other address of its name.

    The addresses of a name meet its pointers as at most ``LISTS`` lists, so the merge join holds that many rows of a name however many
    addresses it has; the rows asked for are made by the explode behind the join, in as many tasks as the session has shuffle partitions.
    """
    lists = forward.groupBy("name", F.pmod(F.xxhash64("fwd"), F.lit(LISTS)).alias("__list")).agg(F.collect_list("fwd").alias("__fwd")).drop("__list")
    both = spread(pointers, "name").join(lists, "name")
    return both.withColumn("fwd", F.explode("__fwd")).drop("__fwd").where(F.col("fwd") != F.col("addr"))
