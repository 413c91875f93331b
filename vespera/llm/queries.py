"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.llm import byte_bpe, decontaminate, gated_lm, language_id, license_scan, media, near_dedup, substring_dedup, token_counts, url_filter
from vespera.llm.common import remainder, table

URL_RULES = [
    url_filter.Rule(action, *rule.replace("/", " /", 1).split(" "))
    for action, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = remainder(F.col("doc_id"), 5) != 1
    out = gated_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), learned)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_lines(table(spark, sf_dir, "documents")).withColumn("line_licenses", F.array_join("line_licenses", ","))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = decontaminate.Benchmark(table(spark, sf_dir, "benchmark"))
    return decontaminate.report(table(spark, sf_dir, "documents"), bench)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_payloads(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


OP10_SQL = """
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT c.page_id, c.host, c.path,
         (SELECT max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'action': action}) FROM rules
          WHERE (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)) AS best
  FROM cut c)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""

OP7_SQL = r"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
grams AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
hits AS (
  SELECT d.doc_id, t.i AS start_at, s.size, g.gram
  FROM cut d, (SELECT DISTINCT size FROM grams) s, unnest(range(1, len(d.w) - s.size + 2)) AS t(i),
       (SELECT DISTINCT size, gram FROM grams) g
  WHERE g.size = s.size AND g.gram = array_to_string(d.w[t.i : t.i + s.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(start_at, start_at + size)) AS u(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT h.doc_id, g.item_id::VARCHAR AS item FROM hits h JOIN grams g USING (gram)) GROUP BY doc_id)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


SPLIT = r"list_filter(regexp_split_to_array({}, '[\x09-\x0D\x20]+'), lambda x: x <> '')"

OP3_SQL = f"""
WITH cut AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM cut, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id), unnest(range(i, i + 50)) AS u(p)),
spelled AS (SELECT doc_id, p, w[p] AS word FROM cut, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM spelled ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, {SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM cut, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_gated_lm, op3_substring_dedup, op4_minhash_near_dedup, op5_language_id, op6_license_scan, op7_benchmark_decontamination, op8_byte_bpe, op9_media_columns, op10_url_filter)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op6_license_scan": license_scan.scan_sql(), "op7_benchmark_decontamination": OP7_SQL, "op10_url_filter": OP10_SQL}
