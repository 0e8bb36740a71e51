"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotable.llm import ann, chat, decontam, langid, lines, neardup, packing, pieces, pii, suffix, variants, whiten
from echotable.llm.jaccard import jaccard_classes


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its ids, and whether decoding them gives the text back."""
    ids = pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = pieces.decode(ids)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size of its 5-word shingle set and its class at Jaccard 0.8."""
    out = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a packed sequence of 2048 ids."""
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packing.digest(pieces).withColumnRenamed("id", "doc_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per maximal conversation: its turns rendered in order."""
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those removed as fuzzy copies, and a digest of what is left."""
    docs = lines.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base spans of personal data counted and digested, all spans listed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pii.digest(docs, pii.fit(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes removed as repeats of a smaller document, and a digest of the rest."""
    out = suffix.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its predicted language and the posterior of it."""
    docs = _learnable(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = langid.fit(docs.where("not held_out and doc_id is not null"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vectors of its label within cosine 0.98, its group, and whether it is kept."""
    out = neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words inside a window of 10 words of a benchmark item, and the items found."""
    found = decontam.decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable vector and component: its whitened value, and its exact deviation from the mean."""
    return whiten.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word: its near words, the form it is a variant of, and the root of its forms."""
    return variants.variant_groups(variants.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_packing": op3_packing,
    "op4_chat_format": op4_chat_format,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns, count(*) AS n
  FROM t GROUP BY conv_id
), d AS (
  SELECT turns, n, min(conv_id) AS conv_id FROM c GROUP BY turns, n
)
SELECT d.conv_id, d.n AS n_turns,
       array_to_string(list_transform(d.turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), '') AS text
FROM d
WHERE NOT EXISTS (
  SELECT 1 FROM d AS e WHERE e.n > d.n AND e.turns[1] = d.turns[1] AND list_slice(e.turns, 1, d.n) = d.turns
)
"""

_OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), tw AS (
  SELECT k, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM t, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), m AS (
  SELECT k, i, tw.size, item_id FROM tw JOIN bw USING (g, size)
), h AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM m) GROUP BY k
), n AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN h USING (k) LEFT JOIN n USING (k)
"""

ORACLES: dict[str, str] = {"op4_chat_format": _OP4, "op11_benchmark_decontamination": _OP11}
