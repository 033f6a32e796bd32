"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact, langid, media, mixing, packing, passages, pii, runs, shards, simhash, topk, toxicity, whitening
from strandline.llm.storage import table


def id_hash(remainder_of: int):
    """crc32 of the id as text, modulo a number: which fold a document is in. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % remainder_of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_hash(5) != 0))
    found = langid.identify(F.col("text"), langid.broadcast_model(spark, model))
    return docs.select("doc_id", (id_hash(5) == 0).alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.audio_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    payload = F.substring("media", media.HEADER.size + 1, (1 << 31) - 1)
    return found.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old shards follow the source, so a large source has made one of them large; new ones are even in bytes.

    All is derived from the shards' files, read back after the move.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = shards.reshard(docs, F.xxhash64("source"))
    text = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc.doc_id", size, crc, law, "shard", "slot", grown, F.col("old").alias("old_shard"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("row")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "text", "copy", "shuffle_key")


#: The rates, the distribution and the draw of ``mixing`` in SQL; each source has as many terms as its rate needs.
OP6_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1)::double AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0 / (SELECT count(*) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate
  FROM sizes),
terms AS (
  SELECT source, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::bigint + 1)) AS k FROM rates)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS total FROM terms),
draws AS (
  SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double AS u
  FROM documents),
times AS (
  SELECT d.doc_id, d.source, d.text, count(c.k) FILTER (WHERE c.total <= d.u) AS times
  FROM draws d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source
  GROUP BY ALL)
SELECT doc_id, source, text, copy::int AS copy,
       md5('mix-1|order|' || coalesce(doc_id::varchar, '') || '|' || copy) AS shuffle_key
FROM (SELECT doc_id, source, text, unnest(range(times)) AS copy FROM times)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    config = toxicity.ToxicityConfig()
    model, counted = toxicity.fit(docs, labels.where(id_hash(3) != 1), config)
    predicted = (F.col("score") >= config.threshold).cast("int").alias("predicted")
    found = toxicity.score(model, counted)
    return found.select("doc_id", (id_hash(3) == 1).alias("held_out"), "score", predicted, "neighbour_ids", "cosines", "neighbour_labels")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.detect(F.col("text")).alias("found")).select("doc_id", "found.*")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def with_repeats(text: Column, doc_id: Column) -> Column:
    """``text``; where crc32 of the id ends in 0, its words from one on become repeats of the first few of them."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", runs.find_runs(with_repeats(F.col("text"), F.col("doc_id"))).alias("found")).select("doc_id", "found.*")
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    top = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicates(spark, f"{sf_dir}/documents.parquet")
    kept = (F.col("place") == F.col("last.place")).alias("kept")
    return found.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept, F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_sharding": op4_sharding,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES = {"op6_source_mixing": OP6_SQL, "op10_exact_topk": OP10_SQL, "op13_exact_dedup": OP13_SQL}
