"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import fm_index, language, licenses, minhash, packing, periods, repetition, substrings, surrogates, templates, token_files, warc, whitening
from rankloom.llm.tokens import vocabulary_path
from rankloom.session import fresh_path

#: The key of the surrogates; production jobs pass their own.
KEY = "registered queries"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = language.train(docs.where(~held_out).select("text", "lang"))
    return language.identify(docs, models).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted"
    )


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_metrics(documents(spark, sf_dir))


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4, percent=80).drop("class_id")


def op5_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, vocabulary_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(documents(spark, sf_dir).select("doc_id", "text"), KEY)


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """From some place on, the words of every tenth document (by the hash of its id) repeat with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(documents(spark, sf_dir), planted_period)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Runs come by start, then period: of the longest the first.
    longest = F.filter("runs", lambda r: r["length"] == F.array_max(F.transform("runs", lambda x: x["length"])))
    best = F.get(longest, 0)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.page_payloads(spark, path).drop("intact")


QUERIES = {
    "op1_compression_language": op1_compression_language,
    "op2_repetition_rules": op2_repetition_rules,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_surrogate_pii": op7_surrogate_pii,
    "op8_license_rules": op8_license_rules,
    "op3_prefix_doubling": op3_prefix_doubling,
    "op4_bbit_minhash": op4_bbit_minhash,
    "op5_bit_packed_tokens": op5_bit_packed_tokens,
    "op9_fm_index": op9_fm_index,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bit_sliced_whitening": op11_bit_sliced_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc_transactions": op13_warc_transactions,
}
_WORDS = r"""regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CHECKS: dict[str, str] = {
    "op4_bbit_minhash": f"""WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM worded, range(1, greatest(len(w) - 2, 2)) t(i)
  WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_ids AS (SELECT a, min(b) AS least_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(least_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ids ON a = d.doc_id""",
    "op9_fm_index": f"""WITH worded AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM worded, range(1, len(w) - 18) t(i)),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM windows, range(20) t(k) WHERE nth > 1),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM worded),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.at) AS words
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at WHERE g.at IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM worded d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op13_warc_transactions": """WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INT), 1)
         FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed""",
}


def queries():
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
