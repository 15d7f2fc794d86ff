"""Changed files between scans (batch)."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.session import staged


def changed_files(scans: DataFrame, emit_new: bool = False, baseline_done: bool = False) -> DataFrame:
    """(scan_no, file_path, mtime, previous_mtime) where the mtime differs from the last one seen.

    The first sight of a path only registers it, unless `emit_new`: then paths first seen after
    the first scan count as changed. `baseline_done` says that the first scan lies before these,
    as in a feed. Deletions are never emitted. One exchange by path; rows are three small columns."""
    rows = scans.select("file_path", "scan_no", "mtime")
    seen = rows.withColumn("previous_mtime", F.lag("mtime").over(Window.partitionBy("file_path").orderBy("scan_no")))
    wanted = F.col("mtime") != F.col("previous_mtime")
    if emit_new:
        new = F.col("previous_mtime").isNull()
        first_scan = None if baseline_done else scans.agg(F.min("scan_no")).first()[0]
        wanted = wanted | (new if first_scan is None else new & (F.col("scan_no") > first_scan))
    return seen.where(wanted).select("scan_no", "file_path", "mtime", "previous_mtime")


def snapshot_diff(old: DataFrame, new: DataFrame, value: str = "content_hash") -> DataFrame:
    """(file_path, change) between two snapshots: added, removed or changed by `value`."""
    before = old.select("file_path", F.col(value).alias("before"), F.lit(True).alias("in_old"))
    after = new.select("file_path", F.col(value).alias("after"), F.lit(True).alias("in_new"))
    change = (F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
              .when(~F.col("before").eqNullSafe(F.col("after")), "changed"))
    return before.join(after, "file_path", "full_outer").select("file_path", change.alias("change")).where(
        F.col("change").isNotNull())


def folder_hashes(snapshot: DataFrame, value: str = "content_hash") -> DataFrame:
    """(folder, n, first, second): of each folder the number of its own files and two sums over their names and values.

    Sums do not depend on any order and are added up before the shuffle. 128 bits tell folders apart."""
    folder = F.regexp_replace("file_path", r"[^/]*\z", "")
    return snapshot.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", value)).alias("first"),
        F.bit_xor(F.xxhash64(F.lit(1), value, "file_path")).alias("second"))


def snapshot_diff_by_folder(old: DataFrame, new: DataFrame, value: str = "content_hash") -> DataFrame:
    """`snapshot_diff` of trees of which most is unchanged: only files of folders with different hashes meet.

    A row per folder is compared first. The folders that differ follow the changes, so the files that
    are shuffled by path do too; with stored hashes the others need not be read at all."""
    before, after = folder_hashes(old, value), folder_hashes(new, value)
    other = after.withColumnsRenamed({c: f"_{c}" for c in after.columns})
    same = F.lit(True)
    for c in ("n", "first", "second"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = staged(before.join(other, F.col("folder") == F.col("_folder"), "full_outer").where(~same)
                    .select(F.coalesce("folder", "_folder").alias("folder")), "changed-folders")
    of = lambda rows: rows.withColumn("folder", F.regexp_replace("file_path", r"[^/]*\z", "")).join(differ, "folder", "left_semi")
    return snapshot_diff(of(old), of(new), value)
