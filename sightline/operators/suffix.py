"""Registrable names by a table of public-suffix rules, as an equi-join.

A host is cut into its label suffixes, each of which meets the rules of exactly that name. A plain rule makes the suffix itself public, a
wildcard rule one label more, an exception one label less; an exception wins, then the rule with most labels, and a host no rule
speaks of has its last label as suffix. The rules are data: there is no built-in list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions import net
from sightline.functions.bind import trim_ws
from sightline.functions.udfs import idna_column
from sightline.operators.netjoin import label_suffixes
from sightline.operators.skew import attach

PLAIN, WILD, EXCEPTION = 0, 1, 2


def suffix_rules(lines: DataFrame, col: str = "value") -> DataFrame:
    """(suffix, kind) of rules one a line, as the public list is written: ``//`` comments, ``*.`` wildcards, ``!`` exceptions.

    A rule ends at the first white space; names are compared in ASCII form. Lines without a rule are left out.
    """
    rule = F.lower(F.regexp_extract(F.col(col), r"^\s*(\S+)", 1))
    rows = lines.select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind = F.when(F.col("rule").startswith("!"), EXCEPTION).when(F.col("rule").startswith("*."), WILD).otherwise(PLAIN)
    name = F.regexp_replace("rule", r"^(!|\*\.)|\.$", "")
    return rows.select(idna_column(name).alias("suffix"), kind.alias("kind")).where(F.col("suffix") != "").distinct()


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of text files in the public list's format."""
    return suffix_rules(spark.read.text(path))


def host_of(name: Column) -> Column:
    return F.regexp_replace(F.lower(trim_ws(name)), "\\.$", "")


def _last_labels(n: Column) -> Column:
    return F.call_function("substring_index", F.col("host"), F.lit("."), (-n).cast("int"))


def registrable_names(hosts: DataFrame, rules: DataFrame, col: str = "host") -> DataFrame:
    """(host, registrable, suffix) of the distinct hosts; a bare suffix, a single label and an address have NULLs."""
    usable = hosts.select(F.col(col).alias("host")).where(F.col("host") != "").distinct().where(net.ip_key(F.col("host")).isNull())
    parts = usable.withColumn("__s", F.explode(label_suffixes(F.col("host")))).select("host", F.col("__s.suffix").alias("suffix"), F.col("__s.depth").alias("depth"))
    hit = parts.join(rules.select("suffix", "kind"), "suffix", "left")
    own = F.size(F.split("suffix", "\\."))
    length = F.when(F.col("kind") == EXCEPTION, own - 1).when(F.col("kind") == PLAIN, own).when((F.col("kind") == WILD) & (F.col("depth") > 0), own + 1)
    best = hit.groupBy("host").agg(F.max(F.when(length.isNotNull(), F.struct((F.col("kind") == EXCEPTION).alias("spared"), length.alias("n")))).alias("b"))
    k = F.coalesce(F.col("b.n"), F.lit(1))
    return best.select("host", _last_labels(k + 1).alias("__reg"), _last_labels(k).alias("__suffix"),
                       (F.size(F.split("host", "\\.")) > k).alias("__has")).select(
        "host", F.when(F.col("__has"), F.col("__reg")).alias("registrable"), F.when(F.col("__has"), F.col("__suffix")).alias("suffix"))


def with_registrable(df: DataFrame, col: str, rules: DataFrame) -> DataFrame:
    """Add registrable (the host itself where it has none), suffix (empty then) and host_class: domain or subdomain."""
    keyed = df.withColumn("__host", host_of(F.col(col)))
    found = registrable_names(keyed, rules, "__host").withColumnsRenamed({"host": "__host", "registrable": "__reg", "suffix": "__suffix"})
    out = attach(keyed, found, "__host")
    return (out.withColumn("registrable", F.coalesce("__reg", "__host")).withColumn("suffix", F.coalesce("__suffix", F.lit("")))
            .withColumn("host_class", F.when(F.col("__reg") == F.lower(F.col(col)), "domain").otherwise("subdomain"))
            .drop("__host", "__reg", "__suffix"))


def with_in_domain(df: DataFrame, col: str, root: str, rules: DataFrame, out: str = "inside") -> DataFrame:
    """Whether a name has the registrable domain of ``root``, or lies below it, at a label boundary."""
    one = with_registrable(df.sparkSession.createDataFrame([(root,)], "root string"), "root", rules)
    top = one.first()["registrable"]  # one row
    mine = with_registrable(df.withColumn("__name", F.col(col)).drop(*[c for c in ("registrable", "suffix", "host_class") if c in df.columns]), "__name", rules)
    inside = (F.lit(top) != "") & (F.col("registrable") != "") & ((F.col("registrable") == top) | F.col("registrable").endswith(f".{top}"))
    kept = mine.withColumn(out, inside)
    return kept.select(*[kept[c] for c in df.columns if c not in ("registrable", "suffix", "host_class")], out)
