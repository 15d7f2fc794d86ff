"""Error listings, session reports and table counts."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions.text import epoch_text

# Report metric -> log key of the patterns it counts.
PATTERN_METRICS = {"functions": "function.declared", "queries": "database.query", "api_calls": "api.called"}
METRICS = ["files", *PATTERN_METRICS, "errors"]


def of_sessions(errors: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Errors whose session is among `sessions`; all where none are given.

    An error carries the sid of its session, so no join is needed to know it. A semi-join of two
    plain tables on the id is split by adaptive execution where one session has very many errors."""
    return errors if sessions is None else errors.join(sessions.select("session_id"), "session_id", "left_semi")


def list_errors(errors: DataFrame, sessions: DataFrame | None = None, sid: str | None = None) -> DataFrame:
    rows = errors if sid is None else errors.where(F.col("sid") == sid)
    return of_sessions(rows, sessions).select(
        "sid", "session_id", "error_type", "file_path", "line_number", "column_number", "message",
        "timestamp", epoch_text(F.col("timestamp")).alias("logged_at"), "ordinal",
    ).orderBy("sid", F.desc("timestamp"), "session_id", "ordinal")


def clear_errors(errors: DataFrame, sid: str):
    """(errors left, number deleted as a one-row DataFrame) for one session name."""
    return (errors.where(~F.col("sid").eqNullSafe(F.lit(sid))),
            errors.where(F.col("sid") == sid).agg(F.count("*").alias("deleted")))


def session_metrics(snapshots: DataFrame, patterns: DataFrame, errors: DataFrame) -> DataFrame:
    """Five counts per session.

    Each table is counted by its sid before the shuffle. The union of the small results is
    added up by sid, which takes the place of three outer joins."""
    zero = F.lit(0).cast("long")

    def part(counts, **metrics):
        return counts.select("sid", *[metrics.get(m, zero).alias(m) for m in METRICS])

    parts = [
        part(snapshots.groupBy("sid").agg(F.count("*").alias("n")), files=F.col("n")),
        part(patterns.groupBy("sid").agg(*[
            F.count_if(F.col("log_key") == key).alias(m) for m, key in PATTERN_METRICS.items()]),
            **{m: F.col(m) for m in PATTERN_METRICS}),
        part(errors.groupBy("sid").agg(F.count("*").alias("n")), errors=F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("sid").agg(*[F.sum(m).alias(m) for m in METRICS])


def session_report(snapshots: DataFrame, patterns: DataFrame, errors: DataFrame, now: int) -> DataFrame:
    """Report rows (report_id, sid, generated_at, report_text, metrics as JSON and as columns)."""
    return report_rows(session_metrics(snapshots, patterns, errors), now)


def metrics_of_counts(snapshots: DataFrame, patterns: DataFrame, errors: DataFrame) -> DataFrame:
    """`session_metrics` from kept counts (sid, key, n) of the three tables; the key of patterns is their log key."""
    rows = [snapshots.select("sid", F.lit("files").alias("metric"), "n"), errors.select("sid", F.lit("errors").alias("metric"), "n")]
    names = {key: m for m, key in PATTERN_METRICS.items()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    # a session with other patterns only is reported too
    rows.append(patterns.select("sid", F.coalesce(F.try_element_at(known, F.col("key")), F.lit("other")).alias("metric"), "n"))
    return reduce(DataFrame.unionByName, rows).groupBy("sid").agg(*[
        F.sum(F.when(F.col("metric") == m, F.col("n")).otherwise(0)).alias(m) for m in METRICS])


def report_rows(counts: DataFrame, now: int) -> DataFrame:
    """The report of each session from its five counts."""
    return counts.select(
        F.sha2(F.concat_ws("_", "sid", F.lit(str(now))), 256).alias("report_id"), "sid",
        F.lit(now).cast("long").alias("generated_at"),
        F.format_string(
            "=== Analysis Report (session: %s) ===\nFiles indexed   : %d\nFunctions found : %d\n"
            "DB queries      : %d\nAPI calls       : %d\nErrors logged   : %d\n", "sid", *METRICS,
        ).alias("report_text"),
        F.to_json(F.struct(*METRICS)).alias("metrics"), *METRICS)


def status(**tables: DataFrame) -> DataFrame:
    """(metric, n) per table; each count needs no column but the row number."""
    return totals(**{name: df.agg(F.count("*").alias("n")) for name, df in tables.items()})


def totals(**counts: DataFrame) -> DataFrame:
    """(metric, n) of one-row tables (n)."""
    counts = [df.select(F.lit(name).alias("metric"), "n") for name, df in counts.items()]
    return reduce(DataFrame.unionByName, counts)
