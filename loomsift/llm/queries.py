"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomsift.llm import attribution, bpe, dedup, licenses, linededup, packing, secrets, simhash, toxicity, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_documents(spark, sf_dir))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_documents(spark, sf_dir))


SQL["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_documents(spark, sf_dir))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), word_vocabulary())


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), word_vocabulary())


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_documents(spark, sf_dir))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(_documents(spark, sf_dir))


SQL["op2_line_dedup"] = r"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS id, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d
), masked AS (
  SELECT doc_id, id, line_no, line, regexp_replace(regexp_replace(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
         '[ \t\x0B\f\r]+', ' ', 'g'), '[^ ]*[0-9@][^ ]*', '<*>', 'g') AS m
  FROM lines
), tokens AS (
  SELECT *, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n, (len(m) - len(replace(m, '<*>', ''))) // 3 AS wild FROM masked
), able AS (
  SELECT * FROM tokens WHERE replace(replace(m, '<*>', ''), ' ', '') <> '' AND (n >= 5 OR len(m) >= 32 OR regexp_matches(m, '\pL'))
), exact AS (
  SELECT m, min(id) AS first, max(id) AS last, any_value(t) AS t, any_value(n) AS n, any_value(wild) AS wild, count(DISTINCT id) AS documents
  FROM able GROUP BY m
), bands AS (
  SELECT m, first, last, n, wild, list_transform(range(8), lambda k: array_to_string(list_slice(t, n * k // 8 + 1, n * (k + 1) // 8), ' ')) AS b FROM exact WHERE n >= 8
), free AS (
  SELECT a.k AS a, c.k AS c FROM range(1, 8) a(k) JOIN range(1, 8) c(k) ON a.k < c.k
), keyed AS (
  SELECT m, first, last, concat_ws(chr(10), n, a, c, array_to_string(list_transform(range(8), lambda k: CASE WHEN k IN (a, c) THEN chr(11) ELSE b[k + 1] END), chr(10))) AS key
  FROM bands JOIN free ON n - (n * (a + 1) // 8 - n * a // 8) - (n * (c + 1) // 8 - n * c // 8) - wild >= 5
), templates AS (
  SELECT key, min(first) AS first FROM keyed GROUP BY key HAVING count(*) >= 3 AND min(first) < max(last)
), firsts AS (
  SELECT m, min(first) AS first FROM (
    SELECT m, first FROM exact WHERE CASE WHEN n >= 5 OR len(m) >= 32 THEN first < last ELSE documents >= 10 END
    UNION ALL SELECT k.m, t.first FROM keyed k JOIN templates t ON k.key = t.key
  ) GROUP BY m
), marked AS (
  SELECT k.doc_id, k.id, k.line_no, k.line, coalesce(k.id > f.first, false) AS gone FROM tokens k LEFT JOIN firsts f ON k.m = f.m
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id
"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attribution.section_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
