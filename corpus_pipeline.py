"""A corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on every row of docs, which is what the stage before it kept. All but the last return the columns of docs.
Documents travel as a struct beside the columns that a stage needs, so other columns may have any name. Decisions are by row: doc_id may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import decontamination, jaccard, mixing, sharding, toxicity
from shelfcast.llm.common import in_struct, released, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: rows whose crc32(doc_id) mod 5 is 0 are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.5. Null and empty texts stay."""
    packed = in_struct(docs, "doc_id", "text")
    classifier, evidence = toxicity.train(packed, _labels(spark, sf_dir))
    released(evidence)
    return packed.where(toxicity.score(packed, classifier) < 0.5).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of least doc_id; documents without id come last. Documents without words stay."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    found = decontamination.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = decontamination.hit_words(F.col("hits.spans"))
    return found.where(~decontamination.contaminated(F.col("hits.n_words"), n_hit)).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words aren't taken."""
    taken = mixing.mix_documents(in_struct(docs, "doc_id", "text", "source"), keep=("doc",)).where("taken > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("doc.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Trained models, signatures and draws have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
