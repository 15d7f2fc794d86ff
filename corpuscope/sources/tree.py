"""Source-tree scan: distributed listing and distributed reading.

Spark's own file listing leaves out names that start with `_` (so `__init__.py` vanishes),
hence these readers. Paths are local (a folder that all executors mount) or a URI that
`pyarrow.fs` knows."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope.functions.text import is_source_file
from corpuscope.schemas import DEFAULT_SID
from corpuscope.session import scratch_path

LISTING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("real_path", T.StringType()),
])

# A file that no row can hold (2 GB) stays in the result with an error instead of its content.
MAX_FILE_BYTES = (1 << 31) - (1 << 20)
# Bytes of files that one task reads, about.
TASK_BYTES = 128 << 20
# Contents per Arrow batch.
_BATCH_BYTES = 32 << 20


def _file_system(path):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list_folders(batches):
    """The entries of each folder, hidden names left out; folders with the path that links lead to."""
    import itertools
    import os

    import pyarrow as pa
    from pyarrow import fs

    def rows(folder):
        system, inner = _file_system(folder)
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if info.base_name.startswith(".") or info.type == fs.FileType.NotFound:
                continue
            path = f"{folder.rstrip('/')}/{info.base_name}"
            is_dir = info.type == fs.FileType.Directory
            real = (path if "://" in path else os.path.realpath(path)) if is_dir else None
            yield path, is_dir, info.size, int(info.mtime_ns // 10**9) if info.mtime_ns else 0, real

    names = [f.name for f in LISTING]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            entries = rows(folder)
            while some := list(itertools.islice(entries, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)


def _read_files(batches):
    import pyarrow as pa

    def load(path, size, limit):
        if size is not None and size > limit:
            return None, f"larger than {limit} bytes"
        try:
            system, inner = _file_system(path)
            with system.open_input_stream(inner) as stream:
                return stream.read(), None
        except OSError as problem:
            return None, str(problem)

    names = ["file_path", "mtime", "bytes", "read_error"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.string()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        rows, held = [], 0
        for path, size, mtime in zip(*(batch.column(c).to_pylist() for c in ("file_path", "size", "mtime"))):
            content, problem = load(path, size, MAX_FILE_BYTES)
            rows.append((path, mtime, content, problem))
            held += len(content or b"")
            if held >= _BATCH_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)


def list_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All files below `root` as (file_path, size, mtime).

    Goes level by level: the folders of one level are spread over tasks, so one large
    subtree does not become one task. Every level is a table in the shared folder. A folder that
    links reach by several paths, or in a circle, is listed once, under the first (the shortest, then
    the smallest) of its paths."""
    import os

    width = spark.sparkContext.defaultParallelism * 4
    out = scratch_path(spark, "listing")
    start = root.rstrip("/") or "/"
    seen = spark.createDataFrame([(start if "://" in start else os.path.realpath(start),)], "real_path string")
    folders, depth = spark.createDataFrame([(start,)], "file_path string"), 0
    while True:
        level = f"{out}/level={depth}"
        folders.repartition(width).mapInArrow(_list_folders, LISTING).write.parquet(level)
        found = spark.read.schema(LISTING).parquet(level).where("is_dir")
        fresh = found.groupBy("real_path").agg(F.min("file_path").alias("file_path")).join(seen, "real_path", "left_anti")
        fresh.write.parquet(f"{out}-folders/level={depth}")
        fresh = spark.read.schema(fresh.schema).parquet(f"{out}-folders/level={depth}")
        seen, folders, depth = seen.unionAll(fresh.select("real_path")), fresh.select("file_path"), depth + 1
        if not recursive or folders.isEmpty():
            break
    return spark.read.schema(LISTING).parquet(out).where("not is_dir").select("file_path", "size", "mtime")


def read_listed(listing: DataFrame, sid: str = DEFAULT_SID) -> DataFrame:
    """Contents of listed files, as (sid, file_path, mtime, content, read_error).

    `content` keeps the file's bytes, so its sha256 is that of the file. There are as many tasks as the listed
    bytes fill, and at least four per core."""
    total = listing.agg(F.sum("size")).first()[0] or 0
    width = max(listing.sparkSession.sparkContext.defaultParallelism * 4, -(-total // TASK_BYTES))
    schema = "file_path string, mtime bigint, bytes binary, read_error string"
    return listing.repartition(width, "file_path").mapInArrow(_read_files, schema).select(
        F.lit(sid).alias("sid"), "file_path", "mtime", F.col("bytes").cast("string").alias("content"), "read_error")


def _write_files(root):
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            paths = batch.column("file_path").to_pylist()
            for path, content, mtime in zip(paths, batch.column("content").to_pylist(), batch.column("mtime").to_pylist()):
                system, inner = _file_system(f"{root}/{path.lstrip('/')}")
                system.create_dir(os.path.dirname(inner), recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(content)
                if mtime is not None and isinstance(system, fs.LocalFileSystem):
                    os.utime(inner, (mtime, mtime))
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], names=["written"])

    return run


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (file_path below `root`, content, mtime) as a folder tree; returns how many.

    A row without content makes no file; a repeated task writes the same files again. Times are kept where the
    file system can set them."""
    rows = files.where("file_path is not null and content is not null").select(
        "file_path", F.col("content").cast("binary").alias("content"), F.col("mtime").cast("long").alias("mtime"))
    written = rows.mapInArrow(_write_files(root.rstrip("/")), "written long")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("n")).first()["n"]


def read_tree(spark: SparkSession, root: str, sid: str = DEFAULT_SID) -> DataFrame:
    """Every source file below `root`, hidden names left out at any level."""
    return read_listed(list_tree(spark, root).where(is_source_file(F.col("file_path"))), sid)


def read_file(spark: SparkSession, path: str, sid: str = DEFAULT_SID) -> DataFrame:
    """One file, whatever its extension."""
    system, inner = _file_system(path)
    info = system.get_file_info(inner)
    if not info.is_file:
        raise FileNotFoundError(path)
    row = [(path, info.size, int(info.mtime_ns // 10**9))]
    return read_listed(spark.createDataFrame(row, "file_path string, size bigint, mtime bigint"), sid)
