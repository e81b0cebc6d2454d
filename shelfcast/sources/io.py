"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schemas import RAW, RAW_COLUMNS, STORES
from shelfcast.session import kept


def read_raw_pos(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw transactions with every column as text; nothing is inferred."""
    return spark.read.parquet(path) if fmt == "parquet" else spark.read.schema(RAW).option("header", True).csv(path)


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORES).option("header", True).csv(path)


def validate_schema(raw: DataFrame) -> DataFrame:
    """Raw rows with '' and 'None' as null. Raises if a column is missing; extra columns stay."""
    missing = set(RAW_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return raw.select([F.when(~F.col(c).isin("", "None"), F.col(c)).alias(c) for c in raw.columns])


def write_clean(clean: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each business date; rows are dealt by date first, so a date is a few files."""
    clean.repartition("business_date").sortWithinPartitions("ts_utc").write.mode("overwrite").partitionBy("business_date").format(fmt).save(path)


def write_quarantine(quarantine: DataFrame, path: str) -> bool:
    """One folder for each reason; nothing is written if no row was rejected. The rejected rows are made once, into the shared folder."""
    rejected = kept(quarantine, "quarantine")
    if rejected.isEmpty():
        return False
    rejected.write.mode("overwrite").partitionBy("_reject_reason").parquet(path)
    return True


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("store_id").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_fold_results(folds: DataFrame, path: str) -> None:
    """One row a fold, so one file."""
    folds.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """name, injected from one JSON object; None where there is no ledger."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return None
    wide = spark.read.json(path)
    if not wide.columns:
        return None
    return wide.unpivot([], wide.columns, "name", "injected").select("name", F.col("injected").cast("long"))
