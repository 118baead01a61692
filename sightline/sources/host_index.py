"""Host indexes: comma-separated lines and HTML tables, with refusals told from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline import fixed
from sightline.functions.bind import fenced, let, trim_ws
from sightline.functions.net import V4_LOOSE
from sightline.operators.skew import attach


def _has(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def refusal_line(line: Column) -> Column:
    """Prose instead of data: a known phrase, or words without any dot; a comma means data."""
    return let(F.lower(line), lambda x: ~x.contains(",") & (
        _has(x, fixed.REFUSAL_MARKERS) | (x.contains(" ") & ~x.contains("."))))


def parse_host_lines(lines: DataFrame, source_col: str = "source", col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(host, addr per source; sources that refused). One refusal line fails its source.

    ``lines`` is one row per line, so a source of any size stays split over tasks; only
    the one-row-per-source verdict is joined back.
    """
    rows = lines.withColumn("__l", trim_ws(F.regexp_replace(col, "\\r$", ""))).where(F.col("__l") != "")
    rows = rows.withColumn("__bad", refusal_line(F.col("__l")))
    verdict = rows.groupBy(source_col).agg(F.bool_or("__bad").alias("refused"))
    failed = verdict.where("refused").select(source_col)
    ok = attach(rows, failed, source_col, "left_anti")
    host = trim_ws(F.element_at(F.split("__l", ",", 2), 1))
    addr = trim_ws(F.coalesce(F.get(F.split("__l", ",", 2), F.lit(1)), F.lit("")))
    hosts = ok.select(source_col, host.alias("host"), F.when(addr.rlike(V4_LOOSE), addr).alias("addr"))
    return hosts.where(F.col("host").contains(".")), failed


def read_host_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    return parse_host_lines(lines)


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extract_host_cells(pages: DataFrame, key: str = "page_id", col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(key, host, addr from table cells; rejected pages with the reason)."""
    low = F.lower(F.col(col))
    kind = F.when(low.contains("<td"), "table").when(_has(low, fixed.INTERSTITIAL_MARKERS), "interstitial").otherwise("no_table")
    p = pages.select(key, F.col(col).alias("__h"), fenced(kind).alias("__kind"))
    cells = p.where("__kind = 'table'").select(key, F.explode(
        F.regexp_extract_all("__h", F.lit("(?is)<td[^>]*>(.*?)</td>"), 1)).alias("cell"))

    def text(c: Column) -> Column:
        return trim_ws(_unescape(F.regexp_replace(c, "(?s)<[^>]*>", " ")))
    cells = cells.withColumn("host", fenced(text(F.col("cell")))) \
                 .withColumn("link", text(F.regexp_extract("cell", "(?is)<a[^>]*>(.*?)</a>", 1)))
    h = F.col("host")
    hosts = (cells.where(h.contains(".") & ~h.contains(" ") & ~h.contains("/") & ~h.rlike(V4_LOOSE))
             .select(key, "host", F.when(F.col("link").rlike(V4_LOOSE), F.col("link")).alias("addr")))
    return hosts, p.where("__kind <> 'table'").select(key, F.col("__kind").alias("reason"))
