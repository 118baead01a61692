"""Certificate-log rows of both published shapes, to one certificate table.

Both parsers take a DataFrame with a JSON array in a text column, so they run over
files, tables and streams alike; the readers only add the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions.bind import fenced, trim_ws
from sightline.functions import names
from sightline.sources.elements import elements

A_ROW = ("issuer_ca_id LONG, issuer_name STRING, issuer_org STRING, common_name STRING, name_value STRING, "
         "id LONG, cert_id LONG, serial_number STRING, entry_timestamp STRING, not_before STRING, "
         "not_after STRING, result_count LONG")
B_ROW = ("id STRING, cert_sha256 STRING, tbs_sha256 STRING, dns_names STRING, revoked BOOLEAN, "
         "issuer STRUCT<friendly_name: STRING, name: STRING, pubkey_sha256: STRING>, not_before STRING, not_after STRING")


def _split_names(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), "\\r?\\n"), lambda n: trim_ws(n))
    return F.array_distinct(F.filter(parts, lambda n: n != ""))


def parse_ct_a(df: DataFrame, col: str = "raw") -> DataFrame:
    """One row per certificate: newline-separated names, common name as fallback. Bodies of any size are read."""
    rows = df.withColumn("__a", fenced(F.from_json(F.col(col), f"array<struct<{_struct(A_ROW)}>>"))).withColumn("r", F.explode("__a"))
    listed = _split_names(F.coalesce("r.name_value", F.lit("")))
    both = F.when(F.size(listed) > 0, listed).otherwise(_split_names(F.coalesce("r.common_name", F.lit(""))))
    keep = [c for c in df.columns if c != col]
    return (rows.select(*keep, F.lit("index-a").alias("provider"), fenced(both).alias("names"),
                        trim_ws(F.coalesce("r.issuer_name", F.lit(""))).alias("issuer_dn"),
                        names.issuer_label(F.coalesce("r.issuer_org", F.lit("")), F.coalesce("r.issuer_name", F.lit(""))).alias("issuer_org"),
                        F.lit("").alias("cert_sha256"), names.serial(F.coalesce("r.serial_number", F.lit(""))).alias("serial"),
                        F.col("r.not_before").alias("not_before"), F.col("r.not_after").alias("not_after"),
                        F.lit(False).alias("revoked"))
            .where(F.size("names") > 0))


def parse_ct_b(df: DataFrame, col: str = "raw") -> DataFrame:
    """One row per issuance: names as an array or as one text, real digest, revoked flag."""
    rows = df.withColumn("__a", fenced(F.from_json(F.col(col), f"array<struct<{_struct(B_ROW)}>>"))).withColumn("r", F.explode("__a"))
    as_array = F.array_join(F.from_json("r.dns_names", "array<string>"), "\n")
    listed = _split_names(F.coalesce(as_array, F.col("r.dns_names"), F.lit("")))
    keep = [c for c in df.columns if c != col]
    return (rows.select(*keep, F.lit("index-b").alias("provider"), fenced(listed).alias("names"),
                        trim_ws(F.coalesce("r.issuer.name", F.lit(""))).alias("issuer_dn"),
                        names.issuer_label(F.coalesce("r.issuer.friendly_name", F.lit("")),
                                           F.coalesce("r.issuer.name", F.lit(""))).alias("issuer_org"),
                        F.lower(trim_ws(F.coalesce("r.cert_sha256", F.lit("")))).alias("cert_sha256"),
                        F.lit("").alias("serial"), F.col("r.not_before").alias("not_before"),
                        F.col("r.not_after").alias("not_after"), F.coalesce("r.revoked", F.lit(False)).alias("revoked"))
            .where(F.size("names") > 0))


def _struct(ddl: str) -> str:
    """Column list to the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part if depth else part.replace(" ", ": ", 1))
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def _raw(spark: SparkSession, path: str, one_per_line: bool) -> DataFrame:
    """Array texts of files; with ``one_per_line`` every element is an array of its own, so that files are read in splits."""
    if one_per_line:
        return elements(spark, path).select(F.concat(F.lit("["), F.col("element"), F.lit("]")).alias("raw"))
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")


def read_ct_a(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return parse_ct_a(_raw(spark, path, one_per_line))


def read_ct_b(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return parse_ct_b(_raw(spark, path, one_per_line))
