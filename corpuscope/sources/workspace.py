"""A folder of parquet tables with keyed writes."""

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope import schemas
from corpuscope.operators import ledger, log_chunks, logs, packages, reports, search
from corpuscope.session import WIDE_ROWS, spread, staged
from corpuscope.sources.postings import StoredPostings

# table -> (key, order) of its keyed writes
KEYS = {
    "decisions": (["node_id"], ["timestamp", "ordinal"]),
    "snapshots": (["file_path"], ["last_modified"]),
    "sessions": (["session_id"], ["timestamp"]),
    "errors": (logs.ERROR_KEY, ["timestamp", "ordinal"]),
    "packages": (["package_id"], ["timestamp"]),
}

_VECTOR = [T.StructField("embedding", T.ArrayType(T.DoubleType()))]
TABLES = {
    "decisions": T.StructType(schemas.DECISIONS.fields + _VECTOR),
    "snapshots": schemas.SNAPSHOTS,
    "sessions": T.StructType(schemas.SESSIONS.fields + _VECTOR),
    "errors": schemas.ERRORS,
    "packages": schemas.PACKAGES,
    "patterns": schemas.PATTERNS,
    "reports": schemas.REPORTS,
    "skipped": schemas.SKIPPED,
}


# table -> what its kept counts are by, beside the session
COUNT_KEYS = {"patterns": "log_key"}

# table -> how its files are written, where not as usual
WRITE = {"packages": WIDE_ROWS}

# tables in buckets; the others are only appended to
VERSIONED = (*KEYS, "patterns")


class Workspace:
    """Tables under `root`, each in folders by a hash bucket of its key.

    A keyed write reads only the buckets its keys fall into and writes them anew in a folder of its own; a
    small file then says which folder of each bucket counts. A write that fails half-way has changed nothing,
    and of two at a time one is refused. The number
    of buckets is fixed when a workspace is created; choose it so that a bucket fits a few
    tasks (100 TB in 65,536 buckets: 1.6 GB each)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.postings = StoredPostings(spark, f"{self.root}/postings", buckets)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _folder(self, *parts: str):
        """A path below the root and the file system it lies in."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str, *parts: str):
        """Numbers in the names below a folder."""
        path, system = self._folder(*parts)
        if not system.exists(path):
            return []
        return sorted(int(m[1]) for f in system.listStatus(path) if (m := re.fullmatch(pattern, f.getPath().getName())))

    # --- versions: a write makes new folders, and one small file says which folders count

    def _pointer(self, name: str):
        """(number, {bucket: version}) of the last write that was published."""
        numbers = self._names(r"(\d+)\.json", name, "_published")
        if not numbers:
            return 0, {}
        path, system = self._folder(name, "_published", f"{numbers[-1]}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], {int(b): v for b, v in json.loads(text).items()}

    def _publish(self, name: str, number: int, buckets: dict) -> None:
        """Make `buckets` count, if `number` is still the last one published."""
        draft, system = self._folder(name, "_published", f"draft-{uuid.uuid4().hex}")
        final, _ = self._folder(name, "_published", f"{number + 1}.json")
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(buckets).encode()))
        stream.close()
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise RuntimeError(f"{name} was written by someone else meanwhile")

    def vacuum(self) -> int:
        """Delete the folders that no longer count, and those of failed writes; returns how many. DataFrames made
        before a write may still read them: call this when none is in use."""
        gone = 0
        for name in VERSIONED:
            number, buckets = self._pointer(name)
            for version in self._names(r"version=(\d+)", name):
                for bucket in self._names(r"bucket=(\d+)", name, f"version={version}"):
                    if buckets.get(bucket) != version:
                        path, system = self._folder(name, f"version={version}", f"bucket={bucket}")
                        gone += bool(system.delete(path, True))
            for version in self._names(r"version=(\d+)", "counts", name):
                if version not in buckets.values():
                    path, system = self._folder("counts", name, f"version={version}")
                    system.delete(path, True)
            for old in self._names(r"(\d+)\.json", name, "_published"):
                if old < number:
                    path, system = self._folder(name, "_published", f"{old}.json")
                    system.delete(path, False)
        return gone

    def _stored(self, name: str) -> DataFrame:
        schema = TABLES[name]
        if name in VERSIONED:
            schema = T.StructType(schema.fields + [T.StructField("bucket", T.IntegerType())])
            _, buckets = self._pointer(name)
            paths = [f"{self.path(name)}/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
            if paths:
                return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*paths).drop("version")
        else:
            path, system = self._folder(name)
            if system.exists(path):
                return self.spark.read.schema(schema).parquet(self.path(name))
        return self.spark.createDataFrame([], schema)

    def read(self, name: str, sid: str | None = None) -> DataFrame:
        """A table; empty if nothing was written to it yet."""
        rows = self.postings.postings() if name == "postings" else self._stored(name).drop("bucket")
        return rows if sid is None else rows.where(F.col("sid") == sid)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def _bucketed(self, name: str, rows: DataFrame, keys) -> DataFrame:
        return rows.select(*TABLES[name].names).withColumn(
            "bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _buckets_of(rows: DataFrame):
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`

    def _rewrite(self, name: str, rows: DataFrame, touched) -> None:
        """Put `rows` in place of the buckets `touched`. Until the last step, which is one small file, nothing that
        counts has changed."""
        number, buckets = self._pointer(name)
        version = max([number, *self._names(r"version=(\d+)", name)]) + 1
        within = spread(self.spark, self.buckets, *[c for c in rows.columns if c != "bucket"])
        (rows.repartition("bucket", within).sortWithinPartitions("bucket", "sid")
         .write.options(**WRITE.get(name, {})).partitionBy("bucket").parquet(f"{self.path(name)}/version={version}"))
        self._keep_counts(name, version)
        kept = {b: v for b, v in buckets.items() if b not in set(touched)}
        self._publish(name, number, kept | {b: version for b in self._names(r"bucket=(\d+)", name, f"version={version}")})

    def _keep_counts(self, name: str, version: int) -> None:
        """Rows per bucket, session and key of the buckets that a write made: they count when the write does."""
        schema = T.StructType(TABLES[name].fields + [T.StructField("bucket", T.IntegerType())])
        written = self.spark.read.schema(schema).parquet(f"{self.path(name)}/version={version}")
        key = F.col(COUNT_KEYS[name]) if name in COUNT_KEYS else F.lit(None).cast("string")
        (written.groupBy("bucket", "sid", key.alias("key")).agg(F.count("*").alias("n")).withColumn("version", F.lit(version))
         .write.mode("overwrite").parquet(f"{self.root}/counts/{name}/version={version}"))

    def counts(self, name: str) -> DataFrame:
        """(sid, key, n) of a table, from what each write counted in its own buckets; no row of the table is read."""
        _, buckets = self._pointer(name)
        if not buckets:
            return self.spark.createDataFrame([], "sid string, key string, n long")
        # one row per bucket
        pointed = self.spark.createDataFrame(sorted(buckets.items()), "bucket int, version int")
        kept = self.spark.read.schema("bucket int, sid string, key string, n long, version int").parquet(
            *[f"{self.root}/counts/{name}/version={v}" for v in sorted(set(buckets.values()))])
        return kept.join(F.broadcast(pointed), ["bucket", "version"]).groupBy("sid", "key").agg(F.sum("n").alias("n"))

    def write_keyed(self, name: str, incoming: DataFrame, ignore_existing: bool = False) -> None:
        """Insert-or-replace, or insert-or-ignore, by the key of the table."""
        keys, order = KEYS[name]
        pick = ledger.earliest if ignore_existing else ledger.latest
        merge = ledger.insert_ignore if ignore_existing else ledger.replace_into
        new = self._bucketed(name, staged(pick(incoming, keys, order), name, **WRITE.get(name, {})), keys)
        touched = self._buckets_of(new)
        old = self._stored(name).where(F.col("bucket").isin(touched))
        self._rewrite(name, merge(old, new, keys, order), touched)

    def write_errors(self, errors: DataFrame) -> None:
        self.write_keyed("errors", errors, ignore_existing=True)

    def write_derived(self, name: str, rows: DataFrame, changed_paths: DataFrame) -> None:
        """Patterns: rows of re-indexed files replace all earlier rows of those files.

        `rows` is read twice, so it should be a stored table."""
        keys = ["file_path"]
        new = self._bucketed(name, rows, keys)
        paths = changed_paths.select("file_path").distinct().withColumn(
            "bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        touched = self._buckets_of(paths)
        old = self._stored(name).where(F.col("bucket").isin(touched))
        merged = old.join(paths.select("file_path"), "file_path", "left_anti").unionByName(new)
        self._rewrite(name, merged, touched)

    def index(self, files: DataFrame, rules: DataFrame, now: int) -> int:
        """Snapshots, patterns, postings and pattern decisions of `files`.

        Files that could not be read (`read_error`) keep what is stored of them, and are appended to
        the table `skipped` with the reason; returns how many."""
        from corpuscope.operators.snapshots import index_corpus

        problem = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
        read = staged(files.select(*schemas.FILES.names, problem.alias("read_error")), "files")
        skipped = read.where("read_error is not null").select("file_path", "sid", F.col("read_error").alias("reason"),
                                                              F.lit(now).cast("long").alias("timestamp"))
        n_skipped = skipped.count()
        if n_skipped:
            self.append("skipped", skipped)
        files = read.where("read_error is null").drop("read_error")
        snapshots, patterns, _ = index_corpus(files, rules, now)
        paths = snapshots.select("file_path")
        patterns = staged(patterns, "patterns")
        self.write_keyed("snapshots", snapshots)
        self.write_derived("patterns", patterns, paths)
        self.postings.write(files)
        self.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.pattern_decisions(patterns, now))))
        return n_skipped

    def parse(self, log_texts: DataFrame) -> None:
        """Sessions, errors and error decisions of raw logs."""
        sessions, errors = logs.parse_logs(log_texts)
        errors = staged(errors, "errors")
        self.write_keyed("sessions", logs.with_session_embedding(sessions))
        self.write_errors(errors)
        self.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.error_decisions(errors))))

    def parse_chunks(self, chunks: DataFrame) -> None:
        """`parse` for logs of any size, given as chunks; their output is not stored with the sessions."""
        sessions, errors = log_chunks.parse_log_chunks(chunks)
        errors = staged(errors, "errors")
        self.write_keyed("sessions", logs.with_session_embedding(sessions))
        self.write_errors(errors)
        self.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.error_decisions(errors))))

    def log(self, rows: DataFrame) -> None:
        self.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.human_decisions(rows))))

    def clear_errors(self, sid: str) -> int:
        """Delete the errors of one session name; returns how many went."""
        stored = self._stored("errors")
        gone = reports.clear_errors(stored, sid)[1].first()["deleted"]
        if gone:
            touched = self._buckets_of(stored.where(F.col("sid") == sid))
            self._rewrite("errors", reports.clear_errors(stored.where(F.col("bucket").isin(touched)), sid)[0], touched)
        return gone

    def resume(self, now: int, sid: str | None = None) -> DataFrame:
        """Packages of all sessions, or one; stored, and returned."""
        tables = [self.read(t, sid) for t in ("decisions", "errors", "snapshots")]
        built = staged(packages.build_package(*tables, now=now), "packages", **WIDE_ROWS)
        self.write_keyed("packages", built)
        return built

    def import_packages(self, texts: DataFrame, now: int) -> DataFrame:
        """Decisions of package texts (sid, text); returns the texts that are no packages."""
        parsed = staged(packages.parse_package(texts), "parsed", **WIDE_ROWS)
        self.write_keyed("decisions", ledger.with_decision_embedding(ledger.merge_decisions(
            ledger.import_decisions(parsed, now))))
        return parsed.where("problem is not null")

    def search(self, queries: DataFrame, **options) -> DataFrame:
        """Files for queries (query_id, query_text, sid), by vector and by text."""
        return search.similar_files(self.read("snapshots"), self.postings, queries, **options)

    def report(self, now: int) -> DataFrame:
        """Reports of all sessions, from kept counts; stored, and returned."""
        metrics = reports.metrics_of_counts(*(self.counts(t) for t in ("snapshots", "patterns", "errors")))
        rows = staged(reports.report_rows(metrics, now), "reports")
        self.append("reports", rows.select(*schemas.REPORTS.names))
        return rows

    def status(self) -> DataFrame:
        """Rows per table, from kept counts."""
        names = ["snapshots", "patterns", "decisions", "sessions", "errors", "packages"]
        return reports.totals(**{n: self.counts(n).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")) for n in names})
