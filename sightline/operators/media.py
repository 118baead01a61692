"""Image metadata as tables of decoded tags (file_id, ifd, tag, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline import fixed
from sightline.functions.bind import decimal_number, let, trim_ws, whole_number
from sightline.operators.skew import spread


def pivot_tags(tags: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per file, one column per wanted (ifd, tag). Files have a few wanted tags each, so their rows are spread before the aggregate."""
    only = tags.where(F.concat_ws(".", "ifd", "tag").isin([".".join(x) for x in wanted.values()]))
    return spread(only, "file_id").groupBy("file_id").agg(*[
        F.max(F.when((F.col("ifd") == ifd) & (F.col("tag") == tag), F.col("value"))).alias(name)
        for name, (ifd, tag) in wanted.items()])


def _ratio(text: Column) -> Column:
    """``n/d`` or a decimal; zero denominator is NULL."""
    def of(p: Column) -> Column:
        den = decimal_number(F.get(p, F.lit(1)))
        num = decimal_number(F.get(p, F.lit(0)))
        return F.when(F.size(p) == 1, num).when(den != 0, num / den)
    return let(F.split(trim_ws(text), "/"), of)


def _dms(text: Column) -> Column:
    """Degrees, minutes, seconds as ``a b c`` rationals; all-zero is NULL."""
    parts = F.transform(F.split(trim_ws(text), "[ ,]+"), _ratio)

    def of(p: Column) -> Column:
        sum_ = p[0] + F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)) / 3600
        bad = F.exists(p, lambda x: x.isNull())
        return F.when(~bad & ~F.forall(p, lambda x: x == 0), sum_)
    return let(parts, of)


def gps_decimal(tags: DataFrame) -> DataFrame:
    """Signed decimal position and altitude; unknown hemisphere, all-zero or out of range is dropped."""
    g = pivot_tags(tags, {"lat": ("gps", "GPSLatitude"), "lat_ref": ("gps", "GPSLatitudeRef"),
                          "lon": ("gps", "GPSLongitude"), "lon_ref": ("gps", "GPSLongitudeRef"),
                          "alt": ("gps", "GPSAltitude"), "alt_ref": ("gps", "GPSAltitudeRef")})
    ref = lambda c: F.upper(trim_ws(F.coalesce(F.col(c), F.lit(""))))
    ns = F.when(ref("lat_ref") == "S", -1).when(ref("lat_ref").isin("", "N"), 1)
    ew = F.when(ref("lon_ref") == "W", -1).when(ref("lon_ref").isin("", "E"), 1)
    d = g.select("file_id", (ns * _dms(F.col("lat"))).alias("latitude"), (ew * _dms(F.col("lon"))).alias("longitude"),
                 (F.when(F.col("alt_ref") == "1", -1).otherwise(1) * _ratio(F.col("alt"))).alias("altitude"))
    return d.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


_SHAPES = [("^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}$", "yyyy:MM:dd HH:mm:ss"),
           ("^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}\\.\\d{3}$", "yyyy:MM:dd HH:mm:ss.SSS"),
           ("^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd HH:mm:ss"),
           ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
           ("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd")]


def _instant(local: Column, offset: Column) -> Column:
    when = F.coalesce(*[F.when(local.rlike(rx), F.try_to_timestamp(local, F.lit(f))) for rx, f in _SHAPES])

    def of(t: Column, digits: Column) -> Column:
        hh, mm = whole_number(F.substring(digits, 1, 2), "int"), whole_number(F.substring(digits, 3, 2), "int")
        sign = F.when(offset.startswith("-"), -1).otherwise(1)
        ok = (F.length(digits) == 4) & (hh <= 14) & (mm <= 59)
        return F.when(ok, F.timestamp_micros(F.unix_micros(t) - sign * (hh * 3600 + mm * 60).cast("long") * 1_000_000))
    return let(when, F.substring(F.regexp_replace(offset, "[^0-9]", ""), 1, 4), of)


def capture_instant(tags: DataFrame) -> DataFrame:
    """One row per file and clock: local text, UTC instant, ambiguous flag, tag used.

    The file-modified clock stands in for a missing capture clock, and says so.
    """
    p = pivot_tags(tags, {"orig": ("exif", "DateTimeOriginal"), "orig_off": ("exif", "OffsetTimeOriginal"),
                          "digi": ("exif", "DateTimeDigitized"), "digi_off": ("exif", "OffsetTimeDigitized"),
                          "file": ("ifd0", "DateTime")})
    blank = lambda c: F.when(trim_ws(F.col(c)) != "", trim_ws(F.col(c)))

    def clock(label: str, main: str, off: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.coalesce(blank(main), blank("file")).alias("local"),
                        F.when(blank(main).isNotNull(), blank(off)).alias("zone"),
                        F.when(blank(main).isNotNull(), F.lit(label)).otherwise("file_modified").alias("tag_used"))
    rows = p.select("file_id", F.explode(F.array(
        clock("capture", "orig", "orig_off"), clock("digitized", "digi", "digi_off"),
        F.struct(F.lit("file_modified").alias("label"), blank("file").alias("local"),
                 F.lit(None).cast("string").alias("zone"), F.lit("file_modified").alias("tag_used")))).alias("c"))
    rows = rows.select("file_id", "c.*").where(F.col("local").isNotNull())
    return (rows.withColumn("utc", F.when(F.col("zone").isNotNull(), _instant(F.col("local"), F.col("zone"))))
            .withColumn("ambiguous", F.col("utc").isNull()))


def thumbnail_check(tags: DataFrame) -> DataFrame:
    """Thumbnail and image proportions; a difference above 0.01 is a low finding."""
    p = pivot_tags(tags, {"w": ("ifd0", "ImageWidth"), "h": ("ifd0", "ImageLength"),
                          "tw": ("ifd1", "ImageWidth"), "th": ("ifd1", "ImageLength")})
    n = {c: decimal_number(F.col(c)) for c in ("w", "h", "tw", "th")}
    p = p.where((n["h"] > 0) & (n["th"] > 0)).withColumn("image_aspect", n["w"] / n["h"]) \
         .withColumn("thumbnail_aspect", n["tw"] / n["th"])
    bad = F.abs(F.col("image_aspect") - F.col("thumbnail_aspect")) > 0.01
    return p.select("file_id", F.round("image_aspect", 4).alias("image_aspect"),
                    F.round("thumbnail_aspect", 4).alias("thumbnail_aspect"), (~bad).alias("consistent"),
                    F.when(bad, "exif-thumbnail-mismatch").otherwise("exif-thumbnail").alias("kind"),
                    F.when(bad, "low").otherwise("info").alias("severity"))


def device_facts(tags: DataFrame) -> DataFrame:
    """Make, model, software, lens, serials and owner; files naming no device are left out."""
    p = pivot_tags(tags, {
        "camera_make": ("ifd0", "Make"), "camera_model": ("ifd0", "Model"), "software": ("ifd0", "Software"),
        "host_computer": ("ifd0", "HostComputer"), "lens_model": ("exif", "LensModel"),
        "body_serial": ("exif", "BodySerialNumber"), "lens_serial": ("exif", "LensSerialNumber"),
        "owner": ("exif", "CameraOwnerName")})
    shown = F.concat_ws("", *[F.coalesce(c, F.lit("")) for c in ("camera_make", "camera_model", "software")])
    return p.where(shown != "").withColumn("captured_with", trim_ws(F.concat_ws(
        " ", F.coalesce("camera_make", F.lit("")), F.coalesce("camera_model", F.lit("")))))


def caption_facts(tags: DataFrame) -> DataFrame:
    """Author and description facts from caption fields, and which XMP properties a packet holds."""
    iptc = tags.where((F.col("ifd") == "iptc") & F.col("tag").isin(fixed.AUTHOR_FIELDS + fixed.DESCRIPTION_FIELDS))
    facts = iptc.select("file_id", F.when(F.col("tag").isin(fixed.AUTHOR_FIELDS), "authored_by")
                        .otherwise("image_described").alias("predicate"), F.col("tag").alias("field"), "value")
    xmp = tags.where(F.col("ifd") == "xmp")
    names = F.array_compact(F.array(*[F.when(F.col("value").contains(k), F.lit(k)) for k in fixed.XMP_FIELDS]))
    return facts.unionByName(xmp.select("file_id", F.lit("xmp_present").alias("predicate"),
                                        F.lit("packet").alias("field"), F.array_join(names, ",").alias("value")))


def no_metadata(files: DataFrame, tags: DataFrame) -> DataFrame:
    gone = files.join(tags.select("file_id").distinct(), "file_id", "left_anti")
    return gone.withColumn("kind", F.lit("exif-no-metadata")).withColumn("severity", F.lit("info"))
