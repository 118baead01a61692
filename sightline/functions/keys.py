"""Content-derived keys: entity, observation, relation and finding ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUL = "\x00"
_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_LETTERS = "abcdefghijklmnopqrstuvwxyz234567"


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def entity_id(type_: Column, canonical: Column) -> Column:
    """First 26 base32 letters of sha256(type, zero byte, canonical value).

    ``conv`` renders 60-bit slices of the digest in base 32; ``translate`` swaps its
    digit set for the RFC 4648 alphabet, so the whole id stays in generated code.
    """
    h = _sha(type_, F.lit(NUL), canonical)

    def slice32(start: int, nibbles: int, digits: int) -> Column:
        return F.lpad(F.conv(F.substring(h, start, nibbles), 16, 32), digits, "0")

    digits = F.concat(slice32(1, 15, 12), slice32(16, 15, 12), F.substring(slice32(31, 5, 4), 1, 2))
    return F.translate(digits, _BASE32_DIGITS, _BASE32_LETTERS)


def rfc3339(ts: Column) -> Column:
    """UTC instant with trailing fraction zeros dropped."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(base, "0+$", ""), "\\.$", ""), F.lit("Z"))


def observation_id(source: Column, subject: Column, predicate: Column, object_key: Column,
                   valid_from: Column | None = None) -> Column:
    stamp = F.lit("") if valid_from is None else F.coalesce(rfc3339(valid_from), F.lit(""))
    sep = F.lit(NUL)
    return F.substring(
        _sha(_text(source), sep, _text(subject), sep, _text(predicate), sep, _text(object_key), sep, stamp),
        1, 32)


def relation_id(from_id: Column, to_id: Column, type_: Column) -> Column:
    return F.substring(_sha(_text(from_id), F.lit(NUL), _text(to_id), F.lit(NUL), _text(type_)), 1, 32)


def finding_value(kind: Column, subject: Column, key_attrs: Column) -> Column:
    """Canonical value of a finding entity (``key_attrs`` already rendered)."""
    return F.concat(F.lit("sha256:"),
                    _sha(_text(kind), F.lit(NUL), _text(subject), F.lit(NUL), _text(key_attrs)))


def source_text(source: Column) -> Column:
    """``module/provider:method`` with the empty parts left out."""
    provider, method = source.getField("provider"), source.getField("method")
    return F.concat(
        _text(source.getField("module")),
        F.when(_text(provider) != "", F.concat(F.lit("/"), provider)).otherwise(""),
        F.when(_text(method) != "", F.concat(F.lit(":"), method)).otherwise(""))


def with_ids(df: DataFrame, kind: str) -> DataFrame:
    """Add (or fill where blank) the ``id`` column of a graph table."""
    if kind == "entity":
        new = entity_id(F.col("type"), F.col("value"))
    elif kind == "observation":
        src = source_text(F.col("source")) if dict(df.dtypes)["source"].startswith("struct") else F.col("source")
        valid = F.col("valid_from") if "valid_from" in df.columns else None
        new = observation_id(src, F.col("subject"), F.col("predicate"), F.col("object_key"), valid)
    elif kind == "relation":
        new = relation_id(F.col("from_id"), F.col("to_id"), F.col("type"))
    elif kind == "finding":
        new = observation_id(F.lit("finding"), F.col("entity_id"), F.col("kind"), F.col("attrs_key"))
    else:
        raise ValueError(f"unknown key kind {kind!r}")
    if "id" in df.columns:
        new = F.coalesce(F.when(F.col("id") != "", F.col("id")), new)
    return df.withColumn("id", new)


def double_text(x: Column) -> Column:
    """Shortest decimal text of a double: plain between 1e-4 and 1e6, else with an exponent."""
    raw = F.abs(x).cast("string")
    mant = F.regexp_extract(raw, "^([0-9.]+)", 1)
    plain = F.regexp_replace(raw, "\\.0$", "")
    # digits without point; exponent of the leading digit
    digits = F.regexp_replace(F.regexp_replace(F.translate(mant, ".", ""), "^0+", ""), "0+$", "")
    e = F.when(raw.contains("E"), F.regexp_extract(raw, "E(-?\\d+)$", 1).cast("int")) \
         .otherwise(F.length(F.regexp_extract(raw, "^(\\d+)", 1)) - 1)
    sci = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise(""),
        F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    small = F.concat(F.lit("0.000"), digits)
    mag = F.abs(x)
    body = (F.when(mag == 0, "0")
            .when((mag < 1e-4) | (mag >= 1e6), sci)
            .when(raw.contains("E"), small)
            .otherwise(plain))
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def object_key(df: DataFrame, name: str) -> Column:
    """Stable text of a column for hashing, by its Spark type.

    Text arrays are sorted and joined with 0x1f, maps are sorted by key with
    0x1c / 0x1d, scalars use their plain text. JSON text of mixed nesting goes
    through :func:`sightline.functions.udfs.stable_json`.
    """
    dtype, col = dict(df.dtypes)[name], F.col(name)
    if dtype == "array<string>":
        return F.array_join(F.array_sort(col), "\x1f")
    if dtype.startswith("array<"):
        return F.array_join(col.cast("array<string>"), "\x1e")
    if dtype.startswith("map<string,"):
        entries = F.array_sort(F.map_entries(col.cast("map<string,string>")))
        return F.array_join(
            F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x1c"), F.coalesce(e["value"], F.lit("")))),
            "\x1d")
    if dtype in ("double", "float"):
        return double_text(col.cast("double"))
    return _text(col)


def content_entities(df: DataFrame, col: str, kind: str = "file") -> DataFrame:
    """Content-addressed entities: the digest is the value for files and images."""
    if kind in ("file", "image"):
        value = F.sha2(F.col(col).cast("binary"), 256)
    elif kind == "text":
        from sightline.functions.udfs import nfc_column
        value = nfc_column(F.trim(F.col(col)))
    else:
        raise ValueError(kind)
    return df.withColumn("type", F.lit(kind)).withColumn("value", value) \
             .withColumn("id", entity_id(F.lit(kind), F.col("value")))
