"""Canonicalisation of a mixed-type indicator table, with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions import canon, keys, net
from sightline.functions.bind import fenced
from sightline.operators.skew import attach


def canonicalise(df: DataFrame, type_col: str = "type", value_col: str = "value",
                 types: list[str] | None = None) -> DataFrame:
    """Add ``canonical``, ``entity_id`` and ``reject_reason``.

    ``types`` names the entity types that can occur; leaving others out keeps their
    branches out of the generated code. The job is one projection, no shuffle.
    """
    wanted = types or fixed.ENTITY_TYPES
    kind, value = F.col(type_col), F.col("__value")
    df, aids = canon.with_aids(df.withColumn("__value", canon.trim_text(F.col(value_col))), kind, value, wanted)
    by_branch: dict = {}
    for t in wanted:
        by_branch.setdefault(canon.BRANCHES[t], []).append(t)
    out: Column | None = None
    for branch, members in by_branch.items():
        cond, expr = kind.isin(members), branch(value, aids)
        out = F.when(cond, expr) if out is None else out.when(cond, expr)
    canonical = fenced(F.when(value != "", out))
    reason = F.when(F.coalesce(value, F.lit("")) == "", "empty") \
              .when(~kind.isin(wanted) | kind.isNull(), "unknown entity type")
    for t in wanted:
        reason = reason.when(kind == t, canon.REJECTS.get(t, "empty after normalisation"))
    return (df.withColumn("canonical", canonical)
            .withColumn("entity_id", F.when(F.col("canonical").isNotNull(),
                                            keys.entity_id(kind, F.col("canonical"))))
            .withColumn("reject_reason", F.when(F.col("canonical").isNull(), reason))
            .drop("__value", *canon.AID_COLUMNS))


def with_host(df: DataFrame, col: str, out: str = "host") -> DataFrame:
    """Canonical host of a name, URL host or address column; NULL where there is none."""
    df = df.withColumn("__host_raw", canon.host_part(F.lit("domain"), canon.trim_text(F.col(col))))
    df = df.withColumn("__host", canon.idna_column(F.col("__host_raw"))).withColumn("__ip", canon.ip(F.col("__host_raw")))
    return df.withColumn(out, fenced(canon.host_name(F.col("__host"), F.col("__ip")))).drop("__host_raw", "__host", "__ip")


def canonical_only(df: DataFrame, type_col: str = "type", value_col: str = "value",
                   types: list[str] | None = None) -> DataFrame:
    """:func:`canonicalise` without its rejects."""
    return canonicalise(df, type_col, value_col, types).where(F.col("canonical").isNotNull()).drop("reject_reason")


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) halves of :func:`canonicalise` output."""
    return (df.where(F.col("canonical").isNotNull()).drop("reject_reason"),
            df.where(F.col("canonical").isNull()).drop("canonical", "entity_id"))


def _host_like(v: Column) -> Column:
    return F.when(v.rlike("^[A-Za-z0-9.-]+$"), canon.domain(v))


#: A dotted name with a letter, as ``h1000000.example.com``; its digits are no telephone number.
_NAMED = "(?=[^.]*[.])[0-9.-]*[A-Za-z][A-Za-z0-9.-]*$"

#: (type, pattern a value needs for it, canonical form), in the order in which they are tried.
_TRIED = (("ip", "[.:]", canon.ip), ("asn", "^(?i)as[0-9]", canon.asn), ("cidr", "/", canon.cidr), ("wallet", "^[^:]+:|^[0-9A-Za-z]{8,128}$", canon.wallet),
          ("cve", "^(?i)cve-", canon.cve), ("email", "@", canon.email), ("phone", f"^(?!{_NAMED})(?:\\P{{Nd}}*\\p{{Nd}}){{7}}", canon.phone), ("host", "[.]", _host_like))


def infer_type(df: DataFrame, col: str, suffixes: DataFrame) -> DataFrame:
    """Type an untyped value: ip, asn, cidr, wallet, cve, email, phone, then host name (a dotted name with a letter is no phone).

    A cheap pattern stands before each form, and type and form are one text, so a value pays for its own branch alone. Host names are
    split into apex and subdomain by the public-suffix rules of ``suffixes`` (see :mod:`sightline.operators.suffix`).
    """
    from sightline.operators.suffix import with_registrable
    v = F.col("__v")
    df = df.withColumn("__v", fenced(F.regexp_replace(F.col(col), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")))
    picked = F.coalesce(*[F.when(v.rlike(shape), F.concat(F.lit(f"{name}\x01"), form(v))) for name, shape, form in _TRIED])
    trimmed = df
    df = df.withColumn("__pick", fenced(F.when(v != "", picked)))
    df = df.withColumns({"__t": F.substring_index("__pick", "\x01", 1), "__c": F.expr("substr(__pick, instr(__pick, '\x01') + 1)")})
    df = df.withColumn("__h", F.when(F.col("__t") == "host", F.col("__c")))
    # names that look like hosts: a few more than those typed so, told without typing every value a second time
    looks = trimmed.select(F.when(v.rlike("[.]") & ~net.is_v4(v), _host_like(v)).alias("__h")).where("__h IS NOT NULL").distinct()
    hosts = with_registrable(looks, "__h", suffixes).select("__h", F.col("host_class").alias("__class"))
    return (attach(df, hosts, "__h").withColumn("inferred_type", F.when(F.col("__t") == "host", F.col("__class")).otherwise(F.col("__t")))
            .withColumn("canonical", F.col("__c")).drop("__v", "__c", "__t", "__h", "__class", "__pick"))
