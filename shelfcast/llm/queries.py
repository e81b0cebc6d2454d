"""The corpus operators as queries: production parameters over whole tables, digest columns derived from each operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import centroids, codes, decontamination, jaccard, language, licenses, lines, media, media_sql, mixing, secrets, sharding, simhash, toxicity
from shelfcast.llm.common import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    classifier, evidence = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.scored(evidence, classifier).select("kept.doc_id", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    many = [secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *many, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", media.describe_media(F.col("text")).alias("m")).select("doc_id", "m.*")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.scan_licenses(F.col("text")).alias("r")).select("doc_id", "r.*")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, own = F.col("phrases.label"), F.col("spans.label")
    cover = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.first").alias("first_word"), F.array_max("phrases.first").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), cover.alias("score"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("hits.spans"))
    found = found.select("doc.doc_id", "hits.n_words", n_hit.alias("n_hit"), "hits.items")
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = language.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predict_language(docs, profiles).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_errors(found, F.col("kept.label"))
    return found.select("kept.vec_id", codes.code_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, at).select("kept.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES |= {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_secret_scans, op4_media_columns, op5_sharding, op6_license_scans, op7_decontamination, op8_language_id, op9_ngram_jaccard, op10_mixing, op11_vector_codes, op12_simhash, op13_centroid_clustering)}
ORACLES |= {"op1_line_dedup": lines.ORACLE, "op4_media_columns": media_sql.ORACLE, "op5_sharding": sharding.ORACLE, "op7_decontamination": decontamination.ORACLE, "op9_ngram_jaccard": jaccard.ORACLE, "op10_mixing": mixing.ORACLE, "op11_vector_codes": codes.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
