"""What independent providers and resolvers agree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline import fixed
from sightline.operators.skew import attach, spread


def _votes(claims: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, field, value, n, total) of every answer, empty ones too.

    Equal rows are counted first, so a key with very many claims meets as its distinct rows; from there all of a key is one place's work.
    """
    rows = spread(claims.select(key, *fields), key, *fields).groupBy(key, *fields).agg(F.count(F.lit(1)).alias("__n"))
    rows = spread(rows, key).withColumn("total", F.sum("__n").over(Window.partitionBy(key)))
    long = rows.select(key, "total", "__n", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields])).alias("s"))
    return long.groupBy(key, F.col("s.field").alias("field"), F.col("s.value").alias("value"), "total").agg(F.sum("__n").alias("n"))


def _wins(key: str) -> Column:
    return F.col(key).isNotNull() & (F.coalesce("value", F.lit("")) != "") & (F.col("n") * 2 > F.col("total"))


def agree_credibility(agreeing: Column, total: Column) -> Column:
    return F.when(agreeing == total, "1").when(agreeing * 2 > total, "2").otherwise("3")


def field_consensus(claims: DataFrame, fields: Sequence[str], key: str = "addr") -> DataFrame:
    """Value a strict majority of the answering providers gave, per field; there can be one at most."""
    return (_votes(claims, fields, key).where(_wins(key))
            .select(key, "field", "value", F.col("n").alias("agreeing"), "total")
            .withColumn("credibility", agree_credibility(F.col("agreeing"), F.col("total"))))


def disputed_fields(claims: DataFrame, fields: Sequence[str], key: str = "addr") -> DataFrame:
    """(key, field) pairs without a majority, one row each."""
    return (_votes(claims, fields, key).groupBy(key, "field").agg(F.bool_or(_wins(key)).alias("__won"))
            .where(~F.col("__won")).drop("__won"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return F.lit(fixed.EARTH_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def centroid_radius(claims: DataFrame, key: str = "addr") -> DataFrame:
    """Mean point, number of points and the radius that covers them all.

    Equal points are counted once per distinct pair before the distance step, so that
    step is bounded by the number of different answers.
    """
    points = (claims.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
              .groupBy(key, "lat", "lon").agg(F.count(F.lit(1)).alias("c")))
    center = points.groupBy(key).agg(
        (F.sum(F.col("lat") * F.col("c")) / F.sum("c")).alias("clat"),
        (F.sum(F.col("lon") * F.col("c")) / F.sum("c")).alias("clon"), F.sum("c").alias("n_points"))
    far = attach(points, center.select(key, "clat", "clon"), key, "inner").groupBy(key).agg(
        F.max(haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))).alias("radius_km"))
    return center.join(far, key).select(key, "clat", "clon", "n_points", "radius_km")


def any_flag(claims: DataFrame, col: str, key: str = "addr") -> DataFrame:
    return claims.groupBy(key).agg(F.coalesce(F.bool_or(F.col(col)), F.lit(False)).alias(col))


def resolver_consensus(answers: DataFrame, k: int = 2) -> DataFrame:
    """Best answer set per question and its status.

    ``answers``: (question, resolver, status, type, pref, data); a resolver with no record has one row with NULL data. TTL plays no part.
    An answer set is known by a digest that does not depend on order and merges on the map side (number and exclusive-or of two
    hashes of its distinct records), so no set is gathered to be compared; the text is made for the sets with most votes alone, from
    the records of one resolver each.
    """
    part = F.when(F.col("data").isNotNull(), F.concat_ws(":", F.col("type"), F.coalesce("pref", F.lit(0)).cast("string"), F.col("data")))
    records = answers.select("question", "resolver", "status", part.alias("part")).groupBy("question", "resolver", "part").agg(F.max("status").alias("status"))
    per = records.groupBy("question", "resolver").agg(
        F.max("status").alias("status"), F.count("part").alias("records"), F.bit_xor(F.when(F.col("part").isNotNull(), F.xxhash64("part"))).alias("h1"),
        F.bit_xor(F.when(F.col("part").isNotNull(), F.xxhash64(F.lit("set"), "part"))).alias("h2"))
    status = per.groupBy("question").agg(
        F.count_if((F.col("status") != 0) & (F.col("status") != 3)).alias("failed"),
        F.count_if(F.col("status") == 3).alias("nx"), F.count(F.lit(1)).alias("resolvers"))
    votes = (per.where((F.col("records") > 0) & (F.col("status") == 0)).groupBy("question", "records", "h1", "h2")
             .agg(F.count(F.lit(1)).alias("n"), F.min("resolver").alias("resolver")))
    top = votes.groupBy("question").agg(F.max("n").alias("n"))
    leading = votes.join(top, ["question", "n"]).select("question", "resolver", "n")
    texts = (records.where("part IS NOT NULL").join(leading, ["question", "resolver"]).groupBy("question", "resolver", "n")
             .agg(F.expr("listagg(part, '|') WITHIN GROUP (ORDER BY part)").alias("answer")))
    best = texts.groupBy("question").agg(F.min(F.struct("answer", "n")).alias("b"))
    j = status.join(best, "question", "left")
    n = F.coalesce(F.col("b.n"), F.lit(0))
    verdict = (F.when(n >= k, "agreed").when(n > 0, "disagreement").when(F.col("nx") > 0, "nxdomain")
               .when(F.col("failed") > 0, "failed").otherwise("no_answer"))
    return j.select("question", verdict.alias("verdict"), F.when(n >= k, F.col("b.answer")).alias("answer"),
                    n.alias("agreeing"), "resolvers")
