"""The training-data queries: name -> callable(spark, sf_dir) -> DataFrame.

Each applies one operator, with its production parameters, to its whole
table. ``SQL`` holds DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campusflow.llm import (
    alignment,
    decontaminate,
    fingerprints,
    langid,
    licenses,
    neardup,
    packing,
    pii,
    resample,
    secret_scan,
    substrings,
    topk,
    urlfilter,
)
from campusflow.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.contaminated(spark, documents(spark, sf_dir), benchmark)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(spark, documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


# The rules of the task.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return urlfilter.judge(spark, pages, spark.createDataFrame(URL_RULES, "action string, host string, path string"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, documents(spark, sf_dir), words=4, percent=80)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark, documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.report(spark, documents(spark, sf_dir), a, b)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return resample.resample(spark, documents(spark, sf_dir), benchmark, runs=1, buckets=10_000, percent=10)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.top_k(spark, vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_document_fingerprints,
        op3_language_id,
        op4_secret_scan,
        op5_license_scan,
        op6_url_filter,
        op7_suffix_dedup,
        op8_best_fit_packing,
        op9_minhash_near_dedup,
        op10_pii,
        op11_tokenizer_alignment,
        op12_importance_resampling,
        op13_exact_top_k,
    )
}

SQL: dict[str, str] = {
    "op6_url_filter": """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), raw AS (
    SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
), split AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
    FROM raw
), rules(action, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
    FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT split.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
""",
    # crc32 by a table of 256 values over the UTF-8 bytes of each distinct word.
    "op12_importance_resampling": """
WITH RECURSIVE step(k, i, v) AS (
    SELECT 0, i, i::BIGINT FROM range(256) r(i)
    UNION ALL
    SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY i) AS crc_table FROM step WHERE k = 8
), words AS (
    SELECT true AS corpus, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT text, row_number() OVER () AS rid FROM benchmark) b
    UNION ALL
    SELECT false, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM documents
), counted AS (
    SELECT corpus AS target, rid, word, count(*) AS n FROM words GROUP BY ALL
), hexed AS (
    SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)
), bytes AS (
    SELECT word, list_transform(range(length(h) // 2), lambda i:
        ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) AS b FROM hexed
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(crc_table[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket
    FROM bytes, crc
), features AS (
    SELECT target, rid, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (word) GROUP BY ALL
), sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target), 0)::DOUBLE AS t
    FROM features GROUP BY bucket
), total AS (
    SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, total
), weighed AS (
    SELECT rid AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM features JOIN gains USING (bucket) WHERE NOT target GROUP BY rid
), scored AS (
    SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM placed) THEN place END::DOUBLE AS rank -- holds NULLs: a double on both sides in pandas
FROM scored LEFT JOIN placed USING (doc_id)
""",
    "op13_exact_top_k": """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
