"""The registered queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, lm, matroska, packing, pieces, pii, quality, secrets, topk

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read(spark, sf_dir, "documents")))


def op3_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read(spark, sf_dir, "documents"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(read(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_vector_approximation_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.transcript_lines(read(spark, sf_dir, "conversations"))
    model = chat.trained(lines.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0))
    turns = chat.parsed(lines, model)
    return turns.select("conv_id", "pos", "line", "role", "n_lines", "continues", F.sha2("rendered", 256).alias("rendered_sha256"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.stored(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_co_training_quality, op2_weak_supervision_pii, op3_heavy_light_jaccard, op4_secret_forest, op5_kneser_ney, op6_sentencepiece, op7_vector_approximation_top_k, op8_transcript_roles, op9_harmonic_packing, op10_matroska)}

SQL = {
    "op3_heavy_light_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = s.doc_id""",
    "op7_vector_approximation_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q JOIN e d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
