"""Personal data by candidate gradient boosting, with DataFrame functions alone.

1. Exact rules (``RULES``) find base spans; they are always redacted. Looser patterns of the same kinds propose more spans that may overlap.
   Patterns run where texts are read, in one pass per group: numeric candidates lie inside zones of digits and separators, so only those short
   zones are searched further. Every pattern is linear (possessive, or tied to the start of a run), whatever the text.
2. A loose candidate that overlaps a base span of its kind is a positive, any other a negative. Features say how it is built (digits, groups,
   separators, check digit) and what stands around it; what only the exact rule tells (a plus sign and its country code, a plain @ or dot) is taken out
   first, so that candidates written otherwise look like the positives they resemble.
3. Boosted trees, one forest per kind, on all candidates, a fifth of them held out: equal feature rows are counted first; each level is one
   histogram aggregate over (kind, node, feature, value) and its best split by window sums. Probabilities are rounded to multiples of 2 ** -20, so
   sums are exact in any order (up to some 2 ** 33 candidates of a kind). Trees become CASE expressions.
4. A kind's threshold is the lowest score above which at least PRECISION of the held-out candidates are positive (of no less than LEAST).
   Candidates above it are taken if no base span overlaps; of candidates that overlap each other the best stays.

Defined results: a null or empty text has no spans; rows that repeat are answered each; a kind without positive or without negative examples adds
nothing; texts of any length are searched whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.words import stage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
TREES, DEPTH, RATE, SHRINK, LEAST_WEIGHT = 8, 3, 0.5, 1.0, 1.0
PRECISION, LEAST = 0.95, 20

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_AT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
#: A match begins at the start of a run, or where the last match ended.
_RUN = r"(?:\G|(?<!{}))"
RULES = {
    "email": _RUN.format(_LOCAL) + rf"{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": _RUN.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _RUN.format(_LOCAL) + rf"{_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "ip": _RUN.format("[0-9]") + r"[0-9]{1,4}+(?:(?:[.,]|\x20?[\[(]\.[\])]\x20?)[0-9]{1,4}+){3}",
    "card": r"[0-9](?:[\x20._/-]{0,2}+[0-9])++",
    "phone": _RUN.format("[0-9+]") + r"\+?\(?[0-9][\x20().0-9/-]+[0-9]",
}
ZONE = r"[0-9+(\[][0-9+\x20().,/_\[\]-]*+"
HAS_AT = r"@|(?i:[\x20\[({]at[\x20\])}])"

#: Words before a candidate that speak for a kind, or for some other number.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|address|host|server|addr|adresse)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|credit|debit|karte|carte|tarjeta|pan)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|fon|contact)\W*(?:\w+\W+)?$",
}
OTHER_CUE = r"(?i)(?:password|token|key|secret|hash|version|v\.|isbn|issn|sku|order|ref|id|no\.|nr\.|#|\$|€|£|=)\W*$"

FEATURES = ("digits", "letters", "groups", "longest", "first", "dots", "dashes", "spaces", "brackets", "slashes", "before", "after", "cue",
            "check", "octets", "tail")


def _hits(text: Column, pattern: str) -> Column:
    """Array of (what lies before, match, what follows) of all matches, left to right without overlap."""
    full = rf"\G(?s:(.*?))({pattern})(?=(?s:(.{{0,{CONTEXT}}})))"
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(full), F.lit(i)) for i in (1, 2, 3)])


def _entries(text: Column, pattern: str, name: str, when: Column | None = None) -> Column:
    """Array of (source, pos, gap, size, left, match, right)."""
    out = F.transform(_hits(text, pattern), lambda z, i: F.struct(
        F.lit(name).alias("source"), i.alias("pos"), F.length(z["0"]).cast("long").alias("gap"), F.length(z["1"]).cast("long").alias("size"),
        F.right(z["0"], F.lit(CONTEXT)).alias("left"), z["1"].alias("match"), z["2"].alias("right")))
    none = F.expr("array()").cast(ENTRIES)
    return out.cast(ENTRIES) if when is None else F.when(when, out.cast(ENTRIES)).otherwise(none)


ENTRIES = "array<struct<source:string,pos:int,gap:bigint,size:bigint,left:string,match:string,right:string>>"


def _digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether 13 to 19 digits pass the check-digit rule."""
    return (f"length({d}) BETWEEN 13 AND 19 AND aggregate(transform(sequence(1, length({d})), i -> int(substr({d}, i, 1)) * (1 + (length({d}) - i) % 2)), "
            "0, (s, v) -> s + v - IF(v > 9, 9, 0)) % 10 = 0")


def _kind_of(source: str) -> str:
    return "CASE " + " ".join(f"WHEN {source} LIKE '{k}%' THEN {i}" for i, k in enumerate(KINDS)) + " END"


def _side(c: str) -> str:
    """0 nothing, 1 white space, 2 letter, 3 digit, 4 equals sign or quote, 5 other."""
    return f"CASE WHEN {c} = '' THEN 0 WHEN {c} RLIKE '\\\\s' THEN 1 WHEN {c} RLIKE '\\\\p{{L}}' THEN 2 WHEN {c} RLIKE '[0-9]' THEN 3 WHEN {c} RLIKE '[=\"\\']' THEN 4 ELSE 5 END"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per base span or loose candidate (kind, base, start, end, label, features), and one with a null kind for a row without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    at, digit = text.rlike(HAS_AT), text.rlike("[0-9]")
    zones = F.concat(_entries(text, RULES["email"], "email_rule", F.contains(text, F.lit("@"))), _entries(text, LOOSE["email"], "email", at),
                     _entries(text, ZONE, "zone", digit))
    cut = docs.select("row", "doc_id", F.explode_outer(zones).alias("z")).select("row", "doc_id", "z.*")
    # what stands around a zone matters only if digits enough for a candidate are in it
    used = F.col("source").isNull() | (F.col("source") != "zone") | (F.length(F.expr(_digits("match"))) >= 4)
    cut = stage(cut.withColumns({c: F.when(used, F.col(c)) for c in ("left", "match", "right")})).repartition("row")
    walked = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "source").orderBy("pos")) - F.col("size")
    cut = cut.withColumn("at", walked)
    inner = F.concat(*[_entries(F.col("match"), p, name) for kind in KINDS[1:] for name, p in ((f"{kind}_rule", RULES[kind]), (kind, LOOSE[kind]))])
    itself = F.array(F.struct("source", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("gap"), "size", F.lit("").alias("left"), "match", F.lit("").alias("right"))).cast(ENTRIES)
    found = F.when(F.col("match").isNull(), F.expr("array()").cast(ENTRIES)).when(F.col("source") == "zone", inner).otherwise(itself)
    each = cut.select("row", "doc_id", "at", F.col("pos").alias("zone"), F.col("source").alias("outer"), F.col("left").alias("zone_left"), F.col("right").alias("zone_right"),
                      F.explode_outer(found).alias("z")).select("row", "doc_id", "at", "zone", "outer", "zone_left", "zone_right", "z.*")
    inside = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "outer", "zone", "source").orderBy("pos")) - F.col("size")
    each = (each.withColumn("start", F.col("at") + inside).withColumn("end", F.col("start") + F.col("size")).withColumn("digits", F.expr(_digits("match")))
            .withColumn("kind", F.expr(_kind_of("source"))).withColumn("base", F.col("source").endswith("_rule"))
            .withColumn("left", F.when(F.col("pos") > 0, F.col("left")).otherwise(F.right(F.concat("zone_left", "left"), F.lit(CONTEXT))))
            .withColumn("right", F.when(F.length("right") < CONTEXT, F.left(F.concat("right", "zone_right"), F.lit(CONTEXT))).otherwise(F.col("right"))))
    small = r"match RLIKE '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'"
    n = "length(digits)"
    each = each.withColumn("octets", F.expr(f"kind = 1 AND {small}")).withColumn("check", F.expr(_luhn("digits")))
    holds = F.expr(f"CASE kind WHEN 0 THEN true WHEN 1 THEN octets OR NOT base WHEN 2 THEN IF(base, {n} BETWEEN 16 AND 19 AND check, {n} BETWEEN 13 AND 19) "
                   f"WHEN 3 THEN {n} BETWEEN IF(base, 8, 7) AND 15 END")
    each = each.withColumns({"kind": F.when(holds, F.col("kind")), "base": F.col("base") & holds})
    by_start = Window.partitionBy("row", "kind").orderBy("start")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("label", F.when(F.col("kind").isNotNull(), (F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))).cast("int")))
    plain = F.regexp_replace(F.regexp_replace("match", F.lit(_AT), F.lit("@")), F.lit(_DOT), F.lit("."))
    local = F.regexp_replace("match", F.lit(r"^\+[0-9]{1,3}(?=[^0-9])[\x20.-]?"), F.lit(""))
    each = each.withColumn("core", F.when(F.col("kind") == 0, plain).when(F.col("kind") == 3, local).otherwise(F.col("match")))
    n = "length(regexp_replace(core, '[^0-9]', ''))"
    count = lambda chars: f"length(regexp_replace(core, '[^{chars}]', ''))"
    cue = "CASE " + f"WHEN left RLIKE r\"{OTHER_CUE}\" THEN 2 " + " ".join(f"WHEN kind = {i} AND left RLIKE r\"{CUES[k]}\" THEN 1" for i, k in enumerate(KINDS)) + " ELSE 0 END"
    made = {
        "digits": n, "letters": f"{count('A-Za-z')}", "groups": "size(regexp_extract_all(core, '[0-9]+', 0))",
        "longest": "coalesce(array_max(transform(regexp_extract_all(core, '[0-9]+', 0), x -> length(x))), 0)",
        "first": "coalesce(length(regexp_extract(core, '[0-9]+', 0)), 0)",
        "dots": count("."), "dashes": count("-"), "spaces": count(" "), "brackets": count("()"), "slashes": count("/_,"),
        "before": _side("right(left, 1)"), "after": _side("left(right, 1)"), "cue": cue, "check": "int(check)", "octets": "int(octets)",
        "tail": "length(regexp_extract(core, '[A-Za-z]+$', 0))",
    }
    named = [F.when(F.col("kind").isNotNull(), F.least(F.lit(31), F.coalesce(F.expr(made[f]), F.lit(0)))).cast("byte").alias(f"f_{f}") for f in FEATURES]
    return stage(each.select("row", "doc_id", "kind", "base", "start", "end", "label", *named))


def _split_tree(rows: DataFrame, kinds: list[int]) -> dict[int, str]:
    """One tree of every kind as a CASE expression; ``rows``: kind, g, h and features."""
    stacked = "stack({}, {}) AS (feature, value)".format(len(FEATURES), ", ".join(f"'f_{f}', f_{f}" for f in FEATURES))
    splits: dict[tuple[int, int], tuple] = {}
    leaves: dict[tuple[int, int], float] = {}
    node = "1"
    for level in range(DEPTH):
        hist = (rows.withColumn("node", F.expr(node)).where(f"node >= {1 << level}").select("kind", "node", "g", "h", F.expr(stacked))
                .groupBy("kind", "node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
        upto, all_ = Window.partitionBy("kind", "node", "feature").orderBy("value"), Window.partitionBy("kind", "node", "feature")
        sums = hist.select("kind", "node", "feature", "value", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                           F.sum("g").over(all_).alias("gt"), F.sum("h").over(all_).alias("ht"))
        gain = F.expr(f"gl * gl / (hl + {SHRINK}) + (gt - gl) * (gt - gl) / (ht - hl + {SHRINK}) - gt * gt / (ht + {SHRINK})")
        sums = sums.withColumn("gain", F.when(F.expr(f"hl >= {LEAST_WEIGHT} AND ht - hl >= {LEAST_WEIGHT}"), F.round(gain, 9)).otherwise(F.lit(-1.0)))
        best = sums.groupBy("kind", "node").agg(F.max_by(F.struct("feature", "value", "gain", "gl", "hl", "gt", "ht"), F.struct("gain", "feature", -F.col("value"))).alias("s"))
        for r in best.select("kind", "node", "s.*").collect():  # at most kinds x nodes rows
            if r.gain > 1e-6:
                splits[r.kind, r.node] = (r.feature, r.value)
                leaves[r.kind, 2 * r.node], leaves[r.kind, 2 * r.node + 1] = r.gl / (r.hl + SHRINK), (r.gt - r.gl) / (r.ht - r.hl + SHRINK)
            elif r.node == 1:
                leaves[r.kind, 1] = r.gt / (r.ht + SHRINK)

        def where(kind: int, at: int) -> str:
            if (kind, at) not in splits:
                return str(at) if at >= 2 << level else "0"
            feature, value = splits[kind, at]
            return f"CASE WHEN {feature} <= {value} THEN {where(kind, 2 * at)} ELSE {where(kind, 2 * at + 1)} END"

        node = "CASE kind " + " ".join(f"WHEN {k} THEN {where(k, 1)}" for k in kinds) + " END"

    def leaf(kind: int, at: int) -> str:
        if (kind, at) not in splits:
            return f"{RATE * leaves.get((kind, at), 0.0)!r}D"
        feature, value = splits[kind, at]
        return f"CASE WHEN {feature} <= {value} THEN {leaf(kind, 2 * at)} ELSE {leaf(kind, 2 * at + 1)} END"

    return {k: leaf(k, 1) for k in kinds}


def _exact(p: Column) -> Column:
    return F.round(p * (1 << 20)) / (1 << 20)


def train(found: DataFrame) -> tuple[str, dict[int, float]]:
    """(score expression over kind and features, threshold of each kind that has one), from the loose candidates of ``candidates``."""
    loose = found.where("kind IS NOT NULL AND NOT base")
    by_kind = {r.kind: r for r in loose.groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}  # one row per kind
    kinds = sorted(k for k, r in by_kind.items() if 0 < r.pos < r.n)
    if not kinds:
        return "0D", {}
    dice = F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(1_000_003))
    names = [f"f_{f}" for f in FEATURES]
    some = (loose.where(F.col("kind").isin(kinds)).withColumn("held_out", F.pmod(F.xxhash64(dice, F.lit("fold")), F.lit(5)) == 0)
            .groupBy("kind", "label", "held_out", *names).agg(F.count("*").alias("w")))
    some = stage(some)
    fit, held = (some.where(c) for c in ("NOT held_out", "held_out"))
    score = {k: "0D" for k in kinds}
    as_case = lambda by: "CASE kind " + " ".join(f"WHEN {k} THEN {e}" for k, e in by.items()) + " ELSE 0D END"
    for _ in range(TREES):
        p = _exact(F.expr(f"1D / (1D + exp(-({as_case(score)})))"))
        rows = fit.withColumn("p", p).select("kind", *names, (F.col("w") * (F.col("label") - F.col("p"))).alias("g"), (F.col("w") * _exact(F.col("p") * (1 - F.col("p")))).alias("h"))
        tree = _split_tree(rows, kinds)
        score = {k: f"{score[k]} + {tree[k]}" for k in kinds}
    expression = as_case(score)
    # calibration: counts per score, from the highest score down
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    level = (held.withColumn("score", F.expr(expression)).groupBy("kind", "score").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("pos"))
             .select("kind", "score", F.sum("n").over(down).alias("n"), F.sum("pos").over(down).alias("pos")))
    cutoff = level.where(F.expr(f"n >= {LEAST} AND pos >= {PRECISION} * n")).groupBy("kind").agg(F.min("score").alias("t"))
    return expression, {r.kind: r.t for r in cutoff.collect()}


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, base, probability): every span to redact; a row without any has one line with a null kind.

    Offsets are code points, the end exclusive; ``row`` tells repeated ids apart.
    """
    found = candidates(docs, id_col, text_col)
    expression, cutoff = train(found)
    above = F.expr("CASE kind " + " ".join(f"WHEN {k} THEN score >= {t!r}D" for k, t in cutoff.items()) + " ELSE false END") if cutoff else F.lit(False)
    chosen = (found.withColumn("score", F.when(~F.col("base"), F.expr(expression)))
              .withColumn("kind", F.when(F.col("base") | ((F.col("label") == 0) & above), F.col("kind"))))
    # spans that overlap form an island; base spans stay, else the best candidate
    before = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    islands = (chosen.where("kind IS NOT NULL").withColumn("new", F.coalesce((F.col("start") >= before), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order)))
    whole = Window.partitionBy("row", "island")
    islands = (islands.withColumn("has_base", F.max(F.col("base")).over(whole))
               .withColumn("r", F.row_number().over(whole.orderBy(F.desc_nulls_last("score"), "start", "kind"))).where("base OR (NOT has_base AND r = 1)"))
    kept = islands.select("row", "doc_id", "kind", "start", "end", "base", F.when(~F.col("base"), F.expr("1D / (1D + exp(-score))")).alias("probability"))
    nothing = found.groupBy("row").agg(F.first("doc_id").alias("doc_id")).select(
        "row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("end", "long"), ("base", "boolean"), ("probability", "double"))])
    return kept.unionByName(nothing)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans): base counts; spans as sorted ``kind:start:end``, joined by commas."""
    spans = personal_spans(docs, id_col, text_col)
    entry = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end"))
    name = "element_at(array({}), x.kind + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    text = lambda c: F.expr(f"array_join(transform(sort_array({c}), x -> concat_ws(':', {name}, x.start, x.end)), ',')")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    lists = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, F.collect_list(F.when(F.col("base"), entry)).alias("of_rules"), F.collect_list(entry).alias("of_all"))
    return lists.select("doc_id", *[f"n_{k}" for k in KINDS], text("of_rules").alias("base_spans"), text("of_all").alias("spans"))
