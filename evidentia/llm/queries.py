"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, jaccard, lines, pii, quality, quotes, recompression, shards, winnow


#: Default place of the vocabulary file; the operator takes any path.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.reply_ordered(_table(spark, sf_dir, "conversations"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))
    return found.select("conv_id", "turn", "role", "position", "reply_position", "reply_to", "linked", "quotes", "max_level", formatted.alias("message"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str = VOCABULARY) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary_path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"))
    counts = [(F.size("found") - F.size(F.array_remove("found", kind))).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", (F.size("found") > 0).alias("has_private"), F.size("found").cast("long").alias("n_private"), *counts, "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(b))
), coded AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM coded, crc_table
), waits AS (
  SELECT doc_id, s AS shard, -ln((('0x' || substr(md5(doc_id || '/' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS wait
  FROM documents, range(17) r(s)
), dealt AS (
  SELECT doc_id, arg_min(shard, wait) FILTER (shard < 16)::INT AS shard, arg_min(shard, wait)::INT AS grown_shard FROM waits GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id || '/' || text_crc32), 1, digits), doc_id, text_crc32) - 1 AS slot, grown_shard
FROM summed JOIN dealt USING (doc_id), (SELECT 2 + greatest(0, ceil(ln(count(*) / 268435456.0) / ln(16)))::INT AS digits FROM documents)
"""

OP6_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, regexp_extract_all(LOWERED_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id::VARCHAR, regexp_extract_all(LOWERED_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sized AS (
  SELECT side, id, w, coalesce(len(w), 0) AS n FROM words
), item_windows AS (
  SELECT DISTINCT id, least(n, 10) AS k, array_to_string(w[i : i + least(n, 10) - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM sized WHERE side = 'b' AND n > 0)
), lengths AS (
  SELECT DISTINCT k FROM item_windows
), doc_windows AS (
  SELECT id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, n - k + 2)) AS i FROM sized, lengths WHERE side = 'd' AND n >= k)
), hits AS (
  SELECT d.id AS doc, d.i, d.k, b.id AS item FROM doc_windows d JOIN item_windows b USING (k, g)
), places AS (
  SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc
), items AS (
  SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc, item FROM hits) GROUP BY doc
)
SELECT s.id::BIGINT AS doc_id, s.n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM sized s LEFT JOIN places p ON p.doc = s.id LEFT JOIN items t ON t.doc = s.id WHERE s.side = 'd'
""".replace("LOWERED_text", _LOWER.format("text"))

OP7_SQL = f"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(translate(coalesce(text, ''), {_SPACE}, '')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

OP9_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_SPACE})")} AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), settled AS (
  SELECT key, max(doc_id) AS max_id FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.max_id AS gone FROM lines l LEFT JOIN settled s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT g FROM windows GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (g)) GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p) AS t
  FROM placed p ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op3_sharding": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL}
