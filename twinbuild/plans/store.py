"""Intermediate tables in the folder that all executors share, so that loops keep a short lineage."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_made: dict[str, list[str]] = {}  # by application: the tables that `stored` wrote


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="twinbuild-"))).rstrip("/")


SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own. What was shuffled for it goes when it is written, or a loop's shuffles would stay until it ends."""
    if df.sparkSession.conf.isModifiable(SHUFFLES_END):
        df.sparkSession.conf.set(SHUFFLES_END, "true")
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Several tables that do not need each other, written at the same time."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda t: stored(*t), tables))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        made = _made.get(spark.sparkContext.applicationId, [])
        for path in {p for p in made for f in df.inputFiles()[:1] if f"/{p.rpartition('/')[2]}/" in f}:
            made.remove(path)
            _delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when nothing reads them any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
