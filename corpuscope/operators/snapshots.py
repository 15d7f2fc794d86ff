"""File snapshots and the three outputs of indexing a corpus."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import text
from corpuscope.functions.vectors import embed_text
from corpuscope.operators.patterns import extract_patterns
from corpuscope.operators.search import build_postings
from corpuscope.schemas import DEFAULT_SID


def source_files(files: DataFrame, root: str = "") -> DataFrame:
    """Rows whose path is a source file with no hidden part below `root`."""
    relative = F.substring(F.col("file_path"), len(root.rstrip("/")) + 2 if root else 1, 2**31 - 1)
    return files.where(text.is_source_file(F.col("file_path")) & ~text.is_hidden(relative))


def snapshot_files(files: DataFrame) -> DataFrame:
    """One row per file; a narrow map, no shuffle. `last_modified` is the file's own mtime."""
    path, content = F.col("file_path"), F.col("content")
    return files.select(
        "file_path",
        F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"),
        text.language(path).alias("language"),
        F.col("mtime").alias("last_modified"),
        text.newlines(content).cast("long").alias("lines_of_code"),
        F.sha2(content.cast("binary"), 256).alias("content_hash"),
        embed_text(content).alias("embedding"),
    )


def index_corpus(files: DataFrame, rules: DataFrame, now: int):
    """(snapshots, patterns, postings) of a files DataFrame, all lazy; no contents are shuffled.

    `files` is taken as given: `sources.tree` selects source files while it lists; a table of
    files goes through `source_files` first. Each output scans `files` once. Where that scan
    is slow (many small files), pass `staged(files, ...)`: three scans of a columnar copy beat
    holding a corpus in executor memory."""
    return snapshot_files(files), extract_patterns(files, rules, now), build_postings(files)


def language_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("sid", "language").agg(
        F.count("*").alias("files"), F.sum("lines_of_code").alias("lines_of_code"))
