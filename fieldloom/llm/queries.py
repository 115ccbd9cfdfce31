"""The queries op1_ to op13_ and pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, outputs=("n_words", "n_removed", "kept_text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, n_words - 48)) AS i FROM n WHERE n_words >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (k) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) AS r(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, n_words + 1)) AS p FROM n),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT n.doc_id, n.n_words, n.n_words - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm import quality_rules as qr

    ledger = qr.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # How many documents the rule that alone rejects this one rejects alone: six rows of the ablation.
    alone = qr.ablate(ledger, "v2").select(F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))
    rows = qr.apply_policy(ledger, "v2").withColumns({"base_failed": qr.rejects("base"), "sole_rule": qr.sole("v2")})
    return rows.join(F.broadcast(alone), "sole_rule", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "sole_rule", "n_sole")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM d),
l AS (SELECT doc_id, x, row_number() OVER () AS r FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
lines AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, x, count(*) AS c FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id, x) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM g JOIN twice USING (doc_id, k), range(0, 3) AS r(j) GROUP BY doc_id),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 12 * n_words)::BIGINT) AS failures FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures,
  CASE failures WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS sole_rule,
  CASE WHEN failures IN (1, 2, 4, 8, 16, 32) THEN count(*) OVER (PARTITION BY failures) END AS n_sole FROM f
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.decontaminate import matches

    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hit_starts") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH lower_az AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_az, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), range(0, 10) AS r(j) WHERE j < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_az LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.sentencepiece_codec import encode

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), keep_text=False)
    # A piece that is not contiguous with the one before, or does not reach the end, would show here.
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.cast("long").alias("bytes_covered"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = """
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS r(i)),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
o AS (SELECT *, (sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS done, (sum(size) OVER ())::BIGINT AS total FROM c),
p AS (SELECT *, (done * 8 // total)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.token_shards import write_shards

    return write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.token_counts import count_lines

    return count_lines(table(spark, sf_dir, "documents"), model_path(), rule="majority")


def held_out():
    """True for the fifth of the documents that no model learns from; rows without an id are among them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.predict(docs, model, keep_text=False).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (k) WHERE x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM shared JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT reach.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; the text of one in ten, by its id, is made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("w")
    a = F.pmod(F.col("g"), n)
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    periodic = F.array_join(F.concat(F.slice("w", 1, a.cast("int")), F.transform(F.sequence(F.lit(0).cast("int"), (n - a - 1).cast("int")), lambda k: F.element_at("w", (a + k % p + 1).cast("int")))), " ")
    own = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    return own.select("doc_id", F.when(F.size("w") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.periodic_runs import find_runs

    out = find_runs(planted(table(spark, sf_dir, "documents")), power=4, least=6)
    each = F.arrays_zip("run_starts", "run_lengths", "run_periods")
    # The longest one first: by length, then by smallest start, then by smallest period.
    best = F.array_max(F.transform(each, lambda x: F.struct(x["run_lengths"].alias("length"), (-x["run_starts"]).alias("start"), (-x["run_periods"]).alias("period"))))
    lines = F.array_join(F.transform(each, lambda x: F.concat_ws(",", x["run_starts"].cast("string"), x["run_lengths"].cast("string"), F.concat(x["run_periods"].cast("string"), F.lit("\n")))), "")
    rows = out.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("run_starts").cast("long").alias("n_runs"),
        (-F.col("best.start")).cast("long").alias("start"), F.col("best.length").cast("long").alias("length"), (-F.col("best.period")).cast("long").alias("period"),
        F.floor(1000 * F.col("best.length").cast("long") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


OP11_SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, {WORDS} AS w, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM d, tab),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
x AS (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
three AS (SELECT doc_id, n, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, u.i AS i, v.i - u.i AS q FROM three AS u JOIN three AS v USING (doc_id, k) WHERE v.i > u.i AND 4 * (v.i - u.i) <= u.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS b FROM m) GROUP BY doc_id, q, b),
run AS (SELECT doc_id, s, l, min(q) AS q FROM stretch WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS r, min(row(-l, s, q)) AS b FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b[2] AS start, -b[1] AS length, b[3] AS period, (-1000 * b[1]) // b[3] AS exponent_milli,
  sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.simhash import hexadecimal, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", hexadecimal(F.col("bits")).alias("fingerprint"), "component_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"), least=30, top=50)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(tot.n), 0)::BIGINT AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) AS tot USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(n)::BIGINT AS n FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * v))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + 1000000000 * (sum(p.n)::BIGINT + 5) // (any_value(l.n) + 5 * any_value(v)))::BIGINT AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f), 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 50
"""


_ALL = (
    (op1_sentencepiece, None),
    (op2_language_id, None),
    (op3_jaccard_join, OP3_SQL),
    (op4_quality_rules, OP4_SQL),
    (op5_sharding, OP5_SQL),
    (op6_substring_dedup, OP6_SQL),
    (op7_toxicity, None),
    (op8_token_shards, None),
    (op9_token_counts, None),
    (op10_decontaminate, OP10_SQL),
    (op11_periodic_runs, OP11_SQL),
    (op12_simhash, None),
    (op13_source_divergence, OP13_SQL),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _ALL if sql}
