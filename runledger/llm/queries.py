"""Registered queries of the operators, over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (
    de_bruijn,
    decontamination,
    filter_audit,
    mixing,
    near_dups,
    neighbours,
    phrases,
    quality,
    sharding,
    suffix_buckets,
    token_counts,
    token_files,
    whitening,
)
from runledger.llm.common import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_entropy_mix")
def entropy_mix(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select(
        "row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"),
        "mix.rate", "mix.copies")


@query("op2_token_files")
def token_file_round_trip(spark, sf_dir):
    path = new_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, vocabulary())
    return token_files.digests(spark, path)


@query("op3_external_shuffle")
def external_shuffle(spark, sf_dir):
    sharded = sharding.shuffle_into_shards(documents(spark, sf_dir))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return sharded.select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_token_counts")
def count_tokens(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary())


@query("op6_leaks", """
    WITH words AS (
      SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    spans AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
    items AS (
      SELECT min(item_id) AS item_id, w
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark)
      WHERE len(w) >= 5 GROUP BY w),
    parts AS (
      SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)),
    sizes AS (SELECT item_id, count(*) AS n_shingles FROM parts GROUP BY item_id),
    common AS (SELECT doc_id, item_id, count(*) AS n_common FROM spans JOIN parts USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
    FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= 80 * n_shingles
""")
def leaks(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(documents(spark, sf_dir), items).drop("text_hash")


@query("op8_phrase_fingerprints")
def phrase_fingerprints(spark, sf_dir):
    return phrases.fingerprints(documents(spark, sf_dir))


@query("op10_pu_quality")
def pu_quality(spark, sf_dir):
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_multi_index_near_dups")
def multi_index_near_dups(spark, sf_dir):
    return near_dups.near_duplicates(documents(spark, sf_dir), k=2)


@query("op7_de_bruijn_repeats")
def de_bruijn_repeats(spark, sf_dir):
    return de_bruijn.without_repeats(documents(spark, sf_dir))


@query("op9_suffix_bucket_repeats")
def suffix_bucket_repeats(spark, sf_dir):
    return suffix_buckets.without_repeats(documents(spark, sf_dir))


@query("op13_filter_audit", """
    WITH words AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
    masks AS (
      SELECT doc_id, part,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
      FROM words JOIN firsts USING (t)),
    says AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    counts AS (
      SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM masks LEFT JOIN says USING (doc_id) GROUP BY part, mask),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v (l, b)),
    orders AS (
      SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
    steps AS (
      SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
    SELECT part, filter_order, step,
           CAST(sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
           CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
           CAST(sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
    FROM counts, steps GROUP BY part, filter_order, step
""")
def audit_of_filters(spark, sf_dir):
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op11_spectrum_whitening")
def spectrum_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_nn_descent")
def nn_descent(spark, sf_dir):
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
