"""One query for each training-data operator, with production parameters, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt, decontam, divergence, importance, quality, rlz, secrets, sharding, simhash, templates, token_counts, token_files
from .common import documents, scratch_path


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text in a shard.
SHARD_BYTES = 64 << 20


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4, max_bits=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op3_substring_dedup_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz.drop_repeats(documents(spark, sf_dir), window=20)
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path(PIECE_BPE), limit=4096)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARD_BYTES)


def op6_substring_dedup_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(WORD_BPE)
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "share", "first_word", "end_word")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.tokenize_to_files(documents(spark, sf_dir), tokenizer_path(WORD_BPE), scratch_path(spark, "tokens"), end_id=1)
    return token_files.checksums(written)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), least_docs=3, top=200)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_secret_scan, op3_substring_dedup_rlz, op4_token_counts, op5_sharding, op6_substring_dedup_bwt, op7_quality_rules, op8_bpe_round_trip, op9_decontamination, op10_token_files, op11_importance_resampling, op12_source_divergence, op13_html_extraction)
}
#: The others need hashes, merges or estimates that SQL does not have (or, for 200-byte strings, hours): they are tested by brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_substring_dedup_rlz": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
windows AS (SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS phrase FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_importance_resampling": r"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS l FROM crc WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (SELECT side, id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM texts),
places AS (SELECT side, r, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM w),
next AS (SELECT side, r, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM places),
f AS (SELECT side, r, a AS x FROM next UNION ALL SELECT side, r, a || ' ' || b FROM next WHERE b IS NOT NULL UNION ALL SELECT side, r, a || ' ' || b || ' ' || c FROM next WHERE c IS NOT NULL),
n AS MATERIALIZED (SELECT side, r, x, count(*) AS n FROM f GROUP BY ALL),
hashed AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::BIGINT)),
  lambda h, y: xor(h >> 8, l[(xor(h, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT x FROM n), steps),
sums AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM n JOIN hashed USING (x) GROUP BY 1),
every AS (SELECT bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) k(bucket) LEFT JOIN sums USING (bucket)),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM every),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN hashed USING (x) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT w.id AS doc_id, len(l) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT g.lang, g.source, k.term, k.n AS n_lang, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p, 1 + (1000000000::HUGEINT * (c.n_lang + 1)) // (v.n_lang + v) AS q FROM counts c JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found QUALIFY part = 'pair' OR rank <= 200""",
}
