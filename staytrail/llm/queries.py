"""The registered queries of this subpackage: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lines, minhash, mixing, quality, resample, sharding, suffix, tokens, toxicity, urls, vectors, warc
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of documents by minimax contiguous partition, law ``bytes``."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents at a similarity of 0.85 of their five-word shingles."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that repeated strings of 100 bytes cover."""
    return suffix.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every url of pages."""
    return urls.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), apart=True)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a content-addressed archive and read back."""
    path = fresh_path(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_archive(spark, path, with_records=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a template that recurs across texts, dropped."""
    found = lines.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.octet_length("kept").cast("long").alias("kept_bytes"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the production mix takes from every document."""
    return mixing.mix_documents(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json, through a cache that starts empty."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), "byte_bpe_50k.json", limit=512)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the compression bands, fitted to labelled clean documents, for every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score_quality(docs, quality.limits_of(docs, f"{sf_dir}/labels.parquet"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark, with the item and the place."""
    return decontam.find_contamination(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                       _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of embeddings: four parts, codebooks of 256 entries refined in four rounds."""
    return vectors.compress_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of documents drawn by their likeness to benchmark."""
    return resample.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                   _table(spark, sf_dir, "labels", "doc_id", "toxic"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(sk)) - 1 AS r FROM d GROUP BY sk),
w AS (
  SELECT sk, source_size, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
c AS (  -- after capping the j sources with the least room by weight, the level that the rest share
  SELECT *, row_number() OVER o AS j, 2.0 * source_size / w AS room,
         sum(w) OVER () - sum(w) OVER o AS w_left,
         3 * sum(source_size) OVER () - 2 * 2 * sum(source_size) OVER o AS num
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, sk ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT 0 AS j, CAST(3 * sum(source_size) AS DOUBLE) / (2 * sum(w)) AS level FROM w
  UNION ALL SELECT j, CASE WHEN w_left = 0 THEN 'Infinity'::DOUBLE ELSE CAST(num AS DOUBLE) / (2 * w_left) END FROM c),
x AS (
  SELECT min_by(l.level, l.j) AS level FROM l LEFT JOIN c ON c.j = l.j + 1 WHERE c.j IS NULL OR c.room >= l.level),
t AS (
  SELECT sk, source_size, CASE WHEN w * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * level END AS target
  FROM w, x),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (sk))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

#: CRC-32 by the usual byte table, a run's bytes one after the other
OP12_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
f AS MATERIALIZED (
  SELECT side, r, unnest(w) AS f FROM w
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
h AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM f),
y AS (
  SELECT f, generate_subscripts(range(length(h) // 2), 1) AS j, h FROM h),
z AS (
  SELECT f, list(16 * (instr('0123456789ABCDEF', substr(h, CAST(2 * j - 1 AS INTEGER), 1)) - 1)
                 + instr('0123456789ABCDEF', substr(h, CAST(2 * j AS INTEGER), 1)) - 1 ORDER BY j) AS b FROM y GROUP BY f),
c AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS k
  FROM z, tab),
n AS (
  SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN c USING (f) GROUP BY k),
a AS (SELECT sum(s) + 10000 AS s, sum(t) + 10000 AS t FROM n),
g AS (
  SELECT k, CAST(floor(1000 * ln(CAST((n.t + 1) * a.s AS DOUBLE) / CAST((n.s + 1) * a.t AS DOUBLE))) AS BIGINT) AS g FROM n, a),
m AS (
  SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM f JOIN c USING (f) JOIN g USING (k) WHERE side = 'd' GROUP BY r),
e AS (
  SELECT w.r, w.doc_id, len(w.w) AS words, coalesce(m.n, 0) AS n_features,
         CASE WHEN m.n IS NULL THEN 0 ELSE (m.g - ((m.g % m.n) + m.n) % m.n) // m.n END AS weight,
         list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i:
           CAST(instr('0123456789abcdef', substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), 'null')), CAST(i AS INTEGER), 1)) - 1 AS BIGINT))),
           lambda q, x: 16 * q + x) AS h
  FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
o AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM e),
p AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k,
         count(*) FILTER (words >= 20) OVER () AS able FROM o)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN words >= 20 AND k <= 25 * able // 100 THEN k END AS rank
FROM p
"""


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every row against every entry, one chain of tables a round."""
    ctes = [f"""
k AS (
  SELECT vec_id, embedding AS v, label FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (
  SELECT len(v) // {parts} AS w FROM k GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1),
r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS r, vec_id, label, v FROM k, w WHERE len(v) = {parts} * w),
x AS MATERIALIZED (
  SELECT r, p, list_transform(v[p * w + 1:(p + 1) * w], lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM r, w, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, v AS c FROM x WHERE r < {entries})"""]
    nearest = """
a{i} AS MATERIALIZED (
  SELECT r, x.p, any_value(x.v) AS v,
         min({{'d': list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c) + list_dot_product(c, c), 'e': e}}) AS m
  FROM x JOIN b{i} b ON x.p = b.p GROUP BY r, x.p)"""
    for i in range(rounds):
        ctes.append(nearest.format(i=i))
        ctes.append(f"""
s{i} AS (
  SELECT p, m.e AS e, j, CAST(sum(CAST(v[j] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
  FROM a{i}, w, range(1, w + 1) t(j) GROUP BY p, m.e, j),
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS c FROM s{i} GROUP BY p, e) n USING (p, e))""")
    ctes.append(nearest.format(i=rounds))
    return "WITH" + ",".join(ctes) + f""",
f AS (
  SELECT r, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r),
h AS (
  SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h
  FROM b{rounds}, w, range(1, w + 1) t(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM f JOIN r USING (r), h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_warc_archive": op5_warc_archive,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": OP7_SQL, "op11_vector_codes": _op11_sql(), "op12_importance_resampling": OP12_SQL}
