"""Session settings and the shared folder used to cut lineage."""

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cores="*", shuffle_partitions=8, memory="8g"):
    """Session for tests and single-machine runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`.

    Where it is unset, local mode gets a temporary folder; a cluster is refused,
    since a folder on one machine would lose data with that machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpuscope-")
    return _local_dirs[app]


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpuscope/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Fixed value: the setting by which an execution deletes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession):
    """What runs within deletes its shuffle files as it ends. Else they lie on disk until the driver happens to collect
    its garbage. For writes only: a DataFrame that is computed again would have to make them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application staged; DataFrames made from them end here."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


# For tables whose rows may have megabytes: their bytes are counted after each row, else after a hundred at the earliest.
# A task holds a row group while it writes or reads one, and a page twice while it is compressed.
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends at the files,
    so a lost executor costs a re-read, and several consumers share one computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, buckets: int, *columns: str) -> Column:
    """What splits each of `buckets` buckets over tasks, by a hash of `columns`: a bucket alone would be one task. There are
    several values for each shuffle partition, so that few buckets keep all tasks busy and alike."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*columns), F.lit(max(8, -(-8 * partitions // buckets))))


# A table in at most this many pieces (2 GB at the default split size) may be spread.
FEW_PIECES = 16


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; one stored in a few pieces, fewer than there are cores, is spread over
    all cores. A large table is read as it lies."""
    rows = spark.read.parquet(path)
    cores, pieces = spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(cores) if pieces < cores and pieces <= FEW_PIECES else rows


def rows_if_at_most(df: DataFrame, limit: int):
    """The rows of `df` when there are at most `limit` of them, else None.

    Never brings more than `limit + 1` rows to the driver."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
