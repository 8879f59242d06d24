"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, license_scan, line_dedup, mixing, ngram_join, quality, resample, secrets, substring_dedup, token_align, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_table(spark, sf_dir, "documents"), words=4, threshold="85/100")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations")
    probe = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], told.select("conv_id", "turn", "role", "text").schema)
    return chat_format.read_chat(chat_format.format_chat(told.select(*probe.columns).unionByName(probe)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), drop_emptied=False, count_col="n_removed_lines")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_copy").cast("long").alias("copy"), "text")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_tokens(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_license_scan, op3_chat_format, op4_toxicity, op5_line_dedup, op6_quality_rules, op7_warc_revisits, op8_decontamination, op9_source_mixing, op10_secret_scan, op11_token_alignment, op12_importance_resampling, op13_substring_dedup)}

_SHINGLES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END)) AS s FROM words
), sizes AS (
  SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1) USING (doc_id)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT links.b, root FROM reach JOIN links ON links.a = reach.node
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(min(root) AS BIGINT) AS component_id FROM sizes JOIN reach ON node = doc_id GROUP BY 1, 2
"""

_LICENSES = r"""
WITH templates(label, t, reach) AS (VALUES {templates}),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
places AS (
  SELECT doc_id, len(w) AS n_words,
    list_filter(range(0, len(w)), lambda i: w[i+1:i+4] = ['under', 'the', 'mit', 'license']) AS p1,
    list_filter(range(0, len(w)), lambda i: w[i+1:i+4] = ['apache', 'license', 'version', '2']) AS p2,
    list_filter(range(0, len(w)), lambda i: w[i+1:i+3] = ['cc', 'by', 'nc']) AS p3 FROM w
), every AS (
  SELECT doc_id, n_words, list_concat(list_concat(p1, p2), p3) AS p,
    list_filter([CASE WHEN len(p1) > 0 THEN 'mit' END, CASE WHEN len(p2) > 0 THEN 'apache-2' END, CASE WHEN len(p3) > 0 THEN 'cc-by-nc' END], lambda x: x IS NOT NULL) AS base FROM places
), lines AS (
  SELECT doc_id, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line FROM docs
), line_words AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM lines
), runs AS (
  SELECT doc_id, label, t, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i])), lambda i: list_distinct(w[i:i+reach-1]))) AS b
  FROM w JOIN templates ON 20 * len(list_intersect(w, t)) >= 17 * len(t)
), matches AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(len(list_intersect(b, t)) / len(t)) AS containment FROM (
    SELECT doc_id, label, t, b FROM line_words CROSS JOIN templates UNION ALL SELECT doc_id, label, t, b FROM runs
  ) WHERE 20 * len(list_intersect(b, t)) >= 17 * len(t) GROUP BY 1
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM every LEFT JOIN matches USING (doc_id)
""".replace("{templates}", ", ".join(f"('{label}', {words!r}, {license_scan.run_words(k)})" for k, label, words in license_scan._template_words()))

_CHAT = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) END AS chars FROM told
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

_MIXING = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
c(source, rate, k, p, s) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), s + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), u AS (
  SELECT *, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
), drawn AS (
  SELECT u.doc_id, u.source, u.text, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.s <= u.u GROUP BY ALL
)
SELECT doc_id, source, CAST(unnest(range(0, n)) AS BIGINT) AS copy, text FROM drawn
"""

_RESAMPLING = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS crc FROM bits WHERE k = 8),
words AS (
  SELECT doc_id, true AS ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), each AS (SELECT doc_id, ours, unnest(w) AS w FROM words),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each)),
buckets AS (
  SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM coded, crc
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM each JOIN buckets USING (w) GROUP BY 1
), sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN buckets USING (w) JOIN gains USING (bucket) WHERE ours GROUP BY 1),
scores AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE ours
), able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(s.n_features AS BIGINT) AS n_features, s.weight, s.score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores s LEFT JOIN able USING (doc_id)
"""

_SUBSTRINGS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS s FROM words),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN firsts USING (s) WHERE doc_id > first),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op13_substring_dedup": _SUBSTRINGS, "op12_importance_resampling": _RESAMPLING, "op1_ngram_jaccard_join": _SHINGLES, "op2_license_scan": _LICENSES, "op3_chat_format": _CHAT, "op7_warc_revisits": _WARC, "op9_source_mixing": _MIXING}
