"""Change feed with Structured Streaming."""

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from corpuscope.functions.text import is_hidden, is_source_file
from corpuscope.operators import ledger
from corpuscope.operators.changes import changed_files
from corpuscope.session import staged
from corpuscope.sources.tree import _list_folders, read_listed

SCANS = T.StructType([
    T.StructField("scan_no", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("mtime", T.LongType()),
])

# Fixed value: seconds between two scans.
SCAN_SECONDS = 2


class FolderScans(DataSource):
    """`readStream.format("folder_scans").option("path", "/a,/b")`: every micro-batch lists the
    folders anew. The built-in file source would never show a file modified in place."""

    @classmethod
    def name(cls):
        return "folder_scans"

    def schema(self):
        return SCANS

    def streamReader(self, schema):
        return _FolderScanReader(self.options["path"].split(","), int(self.options.get("parts", "1")))


class _FolderScanReader(DataSourceStreamReader):
    """Each folder is listed by `parts` tasks: all see its names, each asks for the state of its own and
    returns them as Arrow batches."""

    def __init__(self, folders, parts=1):
        self.folders, self.parts = folders, parts

    def initialOffset(self):
        return {"scan_no": 0}

    def latestOffset(self):
        # one scan number per trigger; time keeps it growing across restarts
        return {"scan_no": time.time_ns() // 1_000_000}

    def partitions(self, start, end):
        return [InputPartition((end["scan_no"], folder, part, self.parts)) for folder in self.folders for part in range(self.parts)]

    def read(self, partition):
        import pyarrow as pa

        scan_no, folder, part, parts = partition.value
        names = [f.name for f in SCANS]
        for paths, mtimes in _children(folder, part, parts):
            yield pa.RecordBatch.from_arrays([pa.array([scan_no] * len(paths), pa.int64()), pa.array(paths, pa.string()), pa.array(mtimes, pa.int64())], names)


def _children(folder: str, part: int, parts: int):
    """Paths and times of the files of a folder that fall to one of its parts, up to 50,000 at a time; hidden names are left out."""
    import itertools
    import os
    import zlib

    import pyarrow as pa

    own = lambda name: not name.startswith(".") and zlib.crc32(name.encode("utf-8", "surrogateescape")) % parts == part

    def local():
        with os.scandir(folder) as entries:
            for entry in entries:
                if not own(entry.name):
                    continue
                try:
                    if entry.is_file():
                        yield f"{folder.rstrip('/')}/{entry.name}", int(entry.stat().st_mtime_ns // 10**9)
                except OSError:  # went while it was listed
                    pass

    def remote():
        for batch in _list_folders([pa.RecordBatch.from_pydict({"file_path": [folder]})]):
            for row in batch.to_pylist():
                if not row["is_dir"] and own(row["file_path"].rsplit("/", 1)[-1]):
                    yield row["file_path"], row["mtime"]

    if "://" not in folder and not os.path.isdir(folder):
        return
    found = remote() if "://" in folder else local()
    while some := list(itertools.islice(found, 50_000)):
        yield [p for p, _ in some], [m for _, m in some]


# Changes of so many micro-batches are read side by side; then a batch writes the whole state once.
DELTAS = 16


def _kept(spark: SparkSession, state_dir: str, batch_id: int):
    """(number, whole) of the complete states of earlier micro-batches, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    done = [f.getPath().getName() for f in system.listStatus(folder)
            if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    found = [(int(n.removesuffix("-whole")), n.endswith("-whole")) for n in done]
    return sorted(x for x in found if x[0] < batch_id)


def _state_path(state_dir: str, number: int, whole: bool) -> str:
    return f"{state_dir}/{number}{'-whole' if whole else ''}"


def _forget(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compare_batch(state_dir: str, on_changes, emit_new: bool = False):
    """The `foreachBatch` function of a change feed: `on_changes(changes, batch_id)`.

    State is the last mtime of every path, as tables of what each micro-batch changed; after `DELTAS` of them
    one holds the whole. So what is written follows the changes and not the tree, and the comparison stays in Spark's own
    operators; state in Spark's state store would call Python once per path and scan. A batch reads only
    the state of earlier batches, and state is dropped only when a later whole one was complete before the
    batch began: the same rows give the same changes when a batch is run again. A first scan
    without files is a baseline too."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scans = staged(batch.select(*[F.col(f.name).cast(f.dataType) for f in SCANS]), "scan")
        earlier = _kept(spark, state_dir, batch_id)
        start = max((k for k, (_, whole) in enumerate(earlier) if whole), default=0)
        history = scans
        # the state's rows stand before all scans, in the order of their batches
        for k, (number, whole) in enumerate(earlier[start:]):
            known = spark.read.schema("file_path string, mtime long").parquet(_state_path(state_dir, number, whole))
            history = history.unionByName(known.withColumn("scan_no", F.lit(k - DELTAS * 4).cast("long")))
        # rows of the state are what new rows are compared with, not changes themselves
        seen_now = lambda emit: changed_files(history, emit, baseline_done=bool(earlier)).where("scan_no >= 0")
        on_changes(seen_now(emit_new), batch_id)
        whole = len(earlier) - start >= DELTAS
        new = history if whole or not earlier else seen_now(True)
        last = ledger.latest(new, ["file_path"], ["scan_no"]).select("file_path", "mtime")
        last.write.mode("overwrite").parquet(_state_path(state_dir, batch_id, whole))
        for number, was_whole in earlier[:start]:
            _forget(spark, _state_path(state_dir, number, was_whole))

    return step


def watch(scans: DataFrame, on_changes, checkpoint: str, emit_new: bool = False, **trigger) -> StreamingQuery:
    """Run `on_changes(changes, batch_id)` for every micro-batch of a stream of scan rows.

    The changes are those of `operators.changes.changed_files` over all scans so far: the
    first batch registers, deletions are never emitted. With `emit_new`, paths first seen
    after the first scan count as changed."""
    return (scans.writeStream.foreachBatch(compare_batch(f"{checkpoint}/last-seen", on_changes, emit_new))
            .option("checkpointLocation", f"{checkpoint}/stream").trigger(**trigger).start())


def folder_scans(spark: SparkSession, *folders: str, parts: int = 1) -> DataFrame:
    """Stream of scan rows over direct children of the folders: source files, no hidden names. Folders of very
    many files are listed in `parts`."""
    spark.dataSource.register(FolderScans)
    stream = spark.readStream.format("folder_scans").option("path", ",".join(folders)).option("parts", str(parts)).load()
    name = F.substring_index("file_path", "/", -1)
    return stream.where(is_source_file(F.col("file_path")) & ~is_hidden(name))


def reindex_batch(workspace, rules: DataFrame, sid: str):
    """The `foreachBatch` function of a watch: re-index changed paths and log each change."""
    def write(changes: DataFrame, batch_id: int) -> None:
        from corpuscope.operators.snapshots import snapshot_files

        paths = staged(changes.groupBy("file_path").agg(F.max("mtime").alias("mtime")), "changed")
        if paths.isEmpty():
            return
        files = staged(read_listed(paths.withColumn("size", F.lit(None).cast("long")), sid), "changed-files")
        now = int(time.time())
        workspace.index(files, rules, now)
        workspace.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.change_decisions(snapshot_files(files.where("read_error is null")), now))))

    return write


def start_watch(workspace, rules: DataFrame, sid: str, folders, checkpoint: str, emit_new: bool = False,
                seconds: int = SCAN_SECONDS) -> StreamingQuery:
    """Watch folders: changed files are re-indexed into the workspace every few seconds."""
    return watch(folder_scans(workspace.spark, *folders), reindex_batch(workspace, rules, sid), checkpoint, emit_new,
                 processingTime=f"{seconds} seconds")
