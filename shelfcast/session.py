"""Session settings that the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}


def build_session(app: str = "shelfcast", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution on. On a cluster, leave master out."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()


_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. Where it is unset, a folder of this run on a local master; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


_written: set[tuple[str, str]] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add((spark.sparkContext.applicationId, path))
    return path


_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written to the shared folder and read back, for several uses: no executor's memory holds it, and a lost executor costs no recomputation.

    A table that a later plan may read stays until `released` or, with all others of the session, `release_all`.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard((spark.sparkContext.applicationId, path))


def released(*tables: DataFrame) -> None:
    """Deletes kept tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, _path_of.pop(t))


def release_all(spark: SparkSession) -> None:
    """Deletes everything that this application has written to the shared folder and not released yet. Results that still have to be read must have been written elsewhere."""
    for application, path in sorted(_written):
        if application == spark.sparkContext.applicationId:
            _delete(spark, path)


def prepare(spark: SparkSession) -> SparkSession:
    """The session in UTC, with this package on the path of Python workers (where it isn't installed on them)."""
    spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
