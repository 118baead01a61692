"""The registered queries of the operators of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.plans.catalog import QUERIES, ORACLES, table


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


# ---------------------------------------------------------------- 1: line frequency
_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_line_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '{_WORD}') AS w FROM l),
lx AS (SELECT doc_id, host, text, line, len(w) AS n, array_to_string(regexp_extract_all({_FOLD.format('line')}, '{_WORD}'), ' ') AS norm
       FROM lw WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lx GROUP BY doc_id),
lim AS (SELECT host, greatest(10.0, count(DISTINCT text) * 0.01) AS m FROM d GROUP BY host),
com AS (SELECT host, norm FROM lx JOIN lim USING (host) GROUP BY host, norm, m HAVING count(DISTINCT text) > m),
gone AS (SELECT doc_id, sum(n) AS n FROM lx JOIN com USING (host, norm) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS left_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND left_words >= 0.3 * n_words AS kept, left_words::BIGINT AS left_words FROM f
""")
def op1_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.line_frequency import line_rules
    return line_rules(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 3: licences
def _license_sql() -> str:
    from sightline.llm.fixed import LICENSE_TEMPLATES
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LICENSE_TEMPLATES.items())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all({_FOLD}, '{pattern}')"
    big = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return rf"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words.format('text')} AS w FROM t),
tb AS (SELECT license, b, count(*) AS n FROM (SELECT license, unnest({big}) AS b FROM tw) GROUP BY ALL),
ts AS (SELECT license, len(w) - 1 AS size FROM tw),
d AS (SELECT doc_id, {words.format('text')} AS w, string_split(text, chr(10)) AS ls FROM documents),
db AS (SELECT doc_id, unnest({big}) AS b, unnest(range(1, len(w))) AS pos FROM d),
dt AS (SELECT db.*, tb.license, tb.n FROM db JOIN tb USING (b)),
l AS (SELECT doc_id, k, len(w) AS n FROM (SELECT doc_id, k, {words.format('line')} AS w
      FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS k FROM d)) WHERE len(w) > 0),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM l),
runs AS (SELECT a.doc_id, a.k AS first_line, b.r - a.r + 1 AS n_lines, a.upto - a.n + 1 AS s, b.upto AS e
         FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.upto - a.upto + a.n - 1 <= (SELECT max(size) * 1.5 FROM ts)),
hit AS (SELECT doc_id, first_line, n_lines, e - s AS size, license, b, least(count(*), n) AS m
        FROM runs JOIN dt USING (doc_id) WHERE pos BETWEEN s AND e - 1
        GROUP BY doc_id, first_line, n_lines, s, e, license, b, n),
dice AS (SELECT doc_id, first_line, n_lines, license, 2.0::DOUBLE * sum(m)::DOUBLE / (hit.size + ts.size)::DOUBLE AS dice
         FROM hit JOIN ts USING (license) GROUP BY doc_id, first_line, n_lines, license, hit.size, ts.size),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, first_line, n_lines) AS r FROM dice WHERE dice >= 0.8)
SELECT doc_id, license, dice, first_line, n_lines FROM best WHERE r = 1
"""


@query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.license_scan import license_scan
    return license_scan(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 9: sharding
def _feistel_sql() -> str:
    from sightline.llm.feistel import ROUNDS, SEED

    def rounds(x: str) -> str:
        lines = [f"SELECT *, {x} % a AS l0, {x} // a AS r0 FROM src"]
        for j in range(ROUNDS):
            side, other, m = ("l", "r", "a") if j % 2 == 0 else ("r", "l", "b")
            h = f"('0x' || substr(md5('{SEED}:{j}:' || {other}{j}::VARCHAR), 1, 13))::BIGINT"
            lines.append(f"SELECT *, ({side}{j} + {h}) % {m} AS {side}{j + 1}, {other}{j} AS {other}{j + 1} FROM ({lines[-1]})")
        return lines[-1]

    walks = "numbered"
    body = ""
    for k in range(4):
        src = f"SELECT doc_id, size, text_crc32, n, a, b, row_number, x AS x{k} FROM {walks}" if k == 0 else ""
        body += f", w{k} AS (SELECT doc_id, size, text_crc32, n, a, b, row_number, "
        inner = rounds("x").replace("FROM src", f"FROM {walks}")
        body += f"CASE WHEN done THEN x ELSE r{ROUNDS} * a + l{ROUNDS} END AS x, done OR r{ROUNDS} * a + l{ROUNDS} < n AS done FROM ({inner}))"
        walks = f"w{k}"
    table_sql = "(SELECT list(c ORDER BY i) FROM crc WHERE k = 8)"
    return rf"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
     SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
bytes AS (SELECT doc_id, strlen(text) AS size, hex(encode(text)) AS h FROM documents),
d AS (SELECT doc_id, coalesce(size, 0) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, size), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, (SELECT {table_sql} AS tab)),
numbered AS (SELECT *, n // a + CASE WHEN n % a > 0 THEN 1 ELSE 0 END AS b, row_number AS x, false AS done
     FROM (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS row_number,
                  count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS a FROM d))
{body}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % 16)::INTEGER AS shard, (x // 16)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard FROM {walks}
"""


@query("op9_feistel_shards", _feistel_sql())
def op9_feistel_shards(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.feistel import describe, feistel_shards
    out = feistel_shards(describe(table(spark, sf, "documents")), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ---------------------------------------------------------------- 10: quality classifier
def fold(mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id is in no fold."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % mod


@query("op10_factorization_quality")
def op10_factorization_quality(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.factorization import score_quality, train_quality
    docs = table(spark, sf, "documents")
    machine = train_quality(docs, table(spark, sf, "labels"), fold(5) != 0)
    scored = score_quality(docs, machine)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 5: packing
@query("op5_bounded_packing")
def op5_bounded_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    from sightline.llm.packing import pack
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- 7: benchmark decontamination
@query("op7_benchmark_leaks")
def op7_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.decontaminate import find_leaks
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# ---------------------------------------------------------------- 4: SimHash
@query("op4_simhash_variants")
def op4_simhash_variants(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.simhash import near_duplicates
    out = near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- 6: language
@query("op6_marginal_unigrams")
def op6_marginal_unigrams(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    from sightline.llm.language_id import identify, train_languages
    docs, vocab = table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    model = train_languages(docs, fold(5) != 0, vocab)
    out = identify(docs, model, vocab)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


# ---------------------------------------------------------------- 2: repeated passages
@query("op2_compact_windows")
def op2_compact_windows(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.compact_windows import repeated_passages
    return repeated_passages(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 8: language model
@query("op8_pitman_yor")
def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.pitman_yor import score_texts
    out = score_texts(table(spark, sf, "documents"), fold(7) != 2)
    return out.select("doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# ---------------------------------------------------------------- 11: hard negatives
@query("op11_kronecker_negatives", """
WITH r AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
      FROM r a JOIN r ON a.vec_id % 100 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11_kronecker_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


# ---------------------------------------------------------------- 13: spelling variants
@query("op13_bloom_variants", r"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
     SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n, a.n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
         UNION SELECT a.word, v.word, v.n, a.n FROM del a JOIN v ON a.d = v.word
         UNION SELECT v.word, a.word, a.n, v.n FROM del a JOIN v ON a.d = v.word),
best AS (SELECT word, other AS form, other_n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near) WHERE r = 1 AND other_n >= 2 * n),
best2 AS (SELECT word, form FROM best),
path(word, reached, k) AS (SELECT word, form, 1 FROM best2 UNION ALL SELECT p.word, b.form, p.k + 1 FROM path p JOIN best2 b ON p.reached = b.word),
root AS (SELECT word, arg_max(reached, k) AS root FROM path GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(c, 0)::BIGINT AS n_near, form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN root USING (word) LEFT JOIN (SELECT word, count(*) AS c FROM near GROUP BY word) USING (word)
""")
def op13_bloom_variants(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 12: personal data
@query("op12_boosted_spans")
def op12_boosted_spans(spark: SparkSession, sf: str) -> DataFrame:
    from sightline.llm.personal_data import redact
    out = redact(table(spark, sf, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")
