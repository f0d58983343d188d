"""What the operators share: where intermediate tables live and how text reaches a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_made: dict[str, list[str]] = {}  # by application: the tables that `stored` wrote


BATCH_BYTES = 4 << 20  # of a batch that goes to Python, whole rows and one at least


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folder.setdefault(app, tempfile.mkdtemp(prefix="twinbuild-"))
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs nothing made before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when nothing reads them any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs as a stored table (key, row): a key of their own for rows whose ids repeat or are null."""
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "rows")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """True for the documents that are never learnt from (remainder 2); a null id is not held out."""
    return F.coalesce(remainder(doc_id, modulus) == 2, F.lit(False))


def by_bytes(df: DataFrame) -> DataFrame:
    """df, whose batches for Python hold about BATCH_BYTES at most, unless the session has a size of its own."""
    conf, key, default = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if conf.get(key, default) == default:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII blanks, A-Z in lower case if asked) of some texts, in order, and how many each text has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes = np.diff(found.offsets.to_numpy()).astype(np.int64)
    flat = found.flatten()
    whole = pc.greater(pc.binary_length(flat), 0)  # a blank at either end of a text leaves an empty word there
    if not pc.all(whole).as_py() and len(flat):
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~whole.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        flat = flat.filter(whole)
    return flat, sizes


def slices(batches, *columns: str, rows: int = 512) -> Iterator[list[list]]:
    """Python lists of the named columns, a few rows at a time, so that long texts never sit decoded side by side."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def hash_sample(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """`size` rows of a table (all, if it has no more), the same ones in the same order wherever the rows lie; `by` are columns that tell rows apart.

    Equal rows are counted first, and a row that stands m times is drawn floor(m p + u) times, where p is the share that is wanted and
    u, from 0 to 1, a hash of the row. So a row that repeats gets its share, not all or none, and no task hands over more rows than are drawn.
    """
    n = rows.count()
    if n <= size:
        return rows.withColumn("_hash", F.pmod(F.xxhash64(*by), F.lit(1_000_000_007))).orderBy("_hash", *by).drop("_hash")
    counted = rows.groupBy(*(F.col(c) for c in rows.columns)).agg(F.count("*").alias("_m"))
    share = min(1.0, (size + 6 * size**0.5 + 10) / n)  # some more than are needed: so many that hardly ever too few are drawn
    uniform = F.pmod(F.xxhash64(F.lit(7), *by), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    while True:
        times = counted.withColumn("_k", F.floor(F.col("_m") * F.lit(share) + uniform))
        drawn = times.where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least("_k", "_m"))))
        if share >= 1.0 or drawn.count() >= size:
            break
        share = min(1.0, 2 * share)
    return drawn.withColumn("_hash", F.xxhash64(*by, "_k")).orderBy("_hash", *by).limit(size).select(*rows.columns)
