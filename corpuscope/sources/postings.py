"""A stored full-text index: postings in blocks, by token bucket, one generation per write.

A row of the table `blocks` holds all occurrences of one token in `BLOCK_FILES` files that follow
each other (and `SEGMENT` positions of them, so that no row grows with a file): a sorted array of
small whole numbers, which Parquet stores as bit-packed differences. Tokens lie in folders by a hash of the
token; a search opens the folders of its own tokens only, and joins blocks by their number before it
looks into them.

A write is a new generation: nothing is rewritten. Files that it replaces are listed in `dead`. A
generation counts once its table `files`, the last to be written, is complete; a write that fails
half-way leaves the index as it was."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpuscope.functions.text import search_tokens
from corpuscope.schemas import DEFAULT_SID
from corpuscope.session import spread, staged

FIELDS = ("file_path", "content", "sid")
# Files of one block, and positions of one segment: together with the field, 26 bits of an entry.
BLOCK_BITS, SEGMENT_BITS = 10, 14
BLOCK_FILES, SEGMENT = 1 << BLOCK_BITS, 1 << SEGMENT_BITS
# A file's number: generation, task that read it, place in the task.
GENERATION_SHIFT, TASK_SHIFT = 48, 28
# Tokens that are gathered at a time, or those of one file.
GATHERED = 1 << 21
# Differences between sorted numbers, and tokens without their common beginnings.
_WRITE = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}

BLOCKS = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("n_files", T.IntegerType()),
    T.StructField("n_occurrences", T.IntegerType()),
    T.StructField("entries", T.ArrayType(T.IntegerType(), False)),
    T.StructField("generation", T.IntegerType()),
    T.StructField("bucket", T.IntegerType()),
])
FILE_NUMBERS = T.StructType([
    T.StructField("file_no", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("generation", T.IntegerType()),
])
DEAD = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("generation", T.IntegerType())])


def numbered_files(files: DataFrame, generation: int) -> DataFrame:
    """`files` with a number each: those of one task follow each other. Numbers hold for one run only: store them."""
    n = F.monotonically_increasing_id()
    task, place = F.shiftright(n, 33), n.bitwiseAND(F.lit((1 << 33) - 1))
    return files.withColumn("file_no", F.lit(generation << GENERATION_SHIFT).cast("long") + F.shiftleft(task, TASK_SHIFT) + place)


def _gathered(batches):
    """Arrow batches (file_no and the tokens of each field) to pieces of blocks (token, block, segment, n_files, entries)."""
    for batch in batches:
        lengths = [pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy().astype(np.int64) for name in FIELDS]
        so_far, begin = np.cumsum(sum(lengths)), 0
        while begin < len(batch):
            before = so_far[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(so_far, before + GATHERED, "right")))
            if so_far[end - 1] > before:
                yield _pieces(batch.slice(begin, end - begin), [n[begin:end] for n in lengths])
            begin = end


def _pieces(files, lengths):
    numbers = files.column("file_no").to_numpy()
    tokens = pa.chunked_array([files.column(name).flatten() for name in FIELDS]).combine_chunks().dictionary_encode()
    row = np.concatenate([np.repeat(np.arange(len(files)), n) for n in lengths])
    pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths])
    field = np.repeat(np.arange(len(FIELDS)), [n.sum() for n in lengths])
    entry = (((numbers & (BLOCK_FILES - 1)) << (SEGMENT_BITS + 2))[row] + (field << SEGMENT_BITS) + (pos & (SEGMENT - 1))).astype(np.int32)
    blocks, block = np.unique(numbers >> BLOCK_BITS, return_inverse=True)
    segments = int(pos.max() >> SEGMENT_BITS) + 1
    cell = (tokens.indices.to_numpy().astype(np.int64) * len(blocks) + block[row]) * segments + (pos >> SEGMENT_BITS)
    order = np.lexsort((entry, cell))
    cell, entry = cell[order], entry[order]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    new_file = np.diff(entry >> (SEGMENT_BITS + 2), prepend=-1) != 0
    new_file[starts] = True
    cell = cell[starts]
    return pa.RecordBatch.from_arrays(
        [tokens.dictionary.take(pa.array(cell // (len(blocks) * segments))), pa.array(blocks[cell // segments % len(blocks)]),
         pa.array((cell % segments).astype(np.int32)), pa.array(np.add.reduceat(new_file.astype(np.int32), starts, dtype=np.int32)),
         pa.ListArray.from_arrays(pa.array(np.append(starts, len(entry)).astype(np.int32)), pa.array(entry))],
        names=["token", "block", "segment", "n_files", "entries"])


def block_rows(files: DataFrame, dealt_by: dict[str, Column] | None = None) -> DataFrame:
    """Blocks of numbered files (file_no, file_path, sid, content).

    A block's files were read by one task, one after the other, so its rows are gathered from the tokens of whole batches
    of files and only the pieces at borders of batches meet after the shuffle. `dealt_by` are columns made of token and block:
    blocks are dealt to tasks by them and keep them. A group has at most `BLOCK_FILES * SEGMENT` entries, however frequent the token."""
    tokens = files.select("file_no", *[search_tokens(F.col(name)).alias(name) for name in FIELDS])
    pieces = tokens.mapInArrow(_gathered, "token string, block long, segment int, n_files int, entries array<int>")
    by = dealt_by or {}
    if by:
        pieces = pieces.withColumns(by).repartition(*by)
    # the pieces of a row hold different files
    held = pieces.groupBy(*by, "token", "block", "segment").agg(
        F.sum("n_files").cast("int").alias("n_files"), F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"))
    return held.select(*by, "token", "block", "segment", "n_files", F.size("entries").alias("n_occurrences"), "entries")


def _place() -> Column:
    """The place in its block of the file of an entry."""
    return F.shiftright("e", SEGMENT_BITS + 2)


def _field_and_pos():
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.shiftright("e", SEGMENT_BITS).bitwiseAND(F.lit(3)) + 1)
    return name.alias("field"), (F.shiftleft("segment", SEGMENT_BITS) + F.col("e").bitwiseAND(F.lit(SEGMENT - 1))).alias("pos")


def opened(blocks: DataFrame, *keep: str) -> DataFrame:
    """The occurrences of blocks: `keep`, token, file_no, field, pos."""
    rows = blocks.select(*keep, "token", "block", "segment", F.explode("entries").alias("e"))
    return rows.select(*keep, "token", (F.shiftleft("block", BLOCK_BITS) + _place()).alias("file_no"), *_field_and_pos())


class StoredPostings:
    """The index under `root`. The number of token buckets is fixed when it is created."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- generations

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str, complete: bool):
        path, system = self._folder(name)
        if not system.exists(path):
            return []
        inside = lambda f: self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")
        return sorted(int(m[1]) for f in system.listStatus(path) if (m := re.fullmatch(r"generation=(\d+)", f.getPath().getName()))
                      and (not complete or system.exists(inside(f))))

    def generations(self):
        """Numbers of the writes that were completed."""
        return self._numbers("files", True)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of complete generations: other folders are not opened."""
        known = self.generations()
        if not known or not self._folder(name)[1].exists(self._folder(name)[0]):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("generation").isin(known))

    # --- writing

    def bucket_of(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def write(self, files: DataFrame) -> int:
        """Index `files` (file_path, sid, content); files of the same paths in earlier generations are replaced."""
        generation = max([-1, *(n for t in ("blocks", "dead", "files") for n in self._numbers(t, False))]) + 1
        rows = files.select("file_path", F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"), "content")
        rows = staged(numbered_files(rows, generation), "numbered-files")
        folder = lambda name: f"{self.root}/{name}/generation={generation}"
        dealt_by = {"bucket": self.bucket_of(F.col("token")), "spread": spread(self.spark, self.buckets, "token", "block")}
        (block_rows(rows, dealt_by).drop("spread").sortWithinPartitions("bucket", "token", "block", "segment")
         .write.options(**_WRITE).partitionBy("bucket").parquet(folder("blocks")))
        replaced = self.files().join(rows.select("file_path"), "file_path", "left_semi").select("file_no")
        replaced.write.parquet(folder("dead"))
        # from here on the generation counts
        rows.select("file_no", "file_path", "sid").write.parquet(folder("files"))
        return generation

    # --- reading

    def files(self) -> DataFrame:
        """(file_no, file_path, sid) of the files that count."""
        numbers = self._table("files", FILE_NUMBERS).drop("generation")
        return numbers.join(self._table("dead", DEAD).select("file_no"), "file_no", "left_anti")

    def blocks(self, tokens: DataFrame | None = None) -> DataFrame:
        """All blocks, or those of `tokens` (one column, token): only their buckets are opened."""
        rows = self._table("blocks", BLOCKS)
        if tokens is None:
            return rows
        asked = [r["bucket"] for r in tokens.select(self.bucket_of(F.col("token")).alias("bucket")).distinct().collect()]  # at most `buckets`
        return rows.where(F.col("bucket").isin(asked)).join(tokens.distinct(), "token", "left_semi")

    def blocks_of(self, *tokens: str) -> DataFrame:
        """Blocks of a few tokens: buckets and tokens are filters of the scan."""
        asked = self.spark.createDataFrame([(t,) for t in tokens], "token string").select(self.bucket_of(F.col("token")).alias("b"))
        return self._table("blocks", BLOCKS).where(
            F.col("bucket").isin(sorted({r["b"] for r in asked.collect()})) & F.col("token").isin(*tokens))

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """(token, file_path, field, pos, sid): the rows of `search.build_postings`, of all blocks or those given."""
        rows = (self.blocks() if blocks is None else blocks).join(self._files_by_block(), "block")
        rows = rows.select("token", "segment", "files", F.explode("entries").alias("e"))
        rows = rows.select("token", "segment", "e", F.get("files", _place()).alias("file")).where("file is not null")
        return rows.select("token", "file.file_path", *_field_and_pos(), "file.sid")

    def _files_by_block(self) -> DataFrame:
        """(block, files): (file_path, sid) of a block's files at their places, null for those that no longer count.

        At most `BLOCK_FILES` a row; blocks meet these rows, so that no occurrence has to be shuffled to its file."""
        # no join: its size could not be told, and small tables have to be known as small
        file = F.struct("file_path", "sid")
        dead = self._table("dead", DEAD).select("file_no", F.lit(None).cast("struct<file_path:string,sid:string>").alias("file"), F.lit(True).alias("is_dead"))
        numbers = self._table("files", FILE_NUMBERS).select("file_no", file.alias("file"), F.lit(False).alias("is_dead"))
        known = numbers.unionAll(dead).groupBy("file_no").agg(F.max("file").alias("file"), F.bool_or("is_dead").alias("is_dead"))
        rows = known.groupBy(F.shiftright("file_no", BLOCK_BITS).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("file_no", F.when(~F.col("is_dead"), F.col("file")).alias("file")))).alias("files"))
        return rows.select("block", F.transform("files", lambda f: f["file"]).alias("files"))

    def vocabulary(self) -> DataFrame:
        """(token, n_files, n_occurrences) from the sizes of the blocks; replaced files still count. No entry is read."""
        in_files = F.sum(F.when(F.col("segment") == 0, F.col("n_files")).otherwise(0)).alias("n_files")
        return self._table("blocks", BLOCKS).groupBy("token").agg(in_files, F.sum("n_occurrences").alias("n_occurrences"))

    def bytes_per_occurrence(self) -> float:
        """Bytes on disk of the blocks per occurrence."""
        path, system = self._folder("blocks")
        n = self._table("blocks", BLOCKS).agg(F.sum("n_occurrences")).first()[0]
        return system.getContentSummary(path).getLength() / n if n else 0.0
