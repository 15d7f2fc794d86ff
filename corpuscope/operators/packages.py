"""Sessions as portable text packages: `SID:<version>:<base64 of JSON>`."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions.text import unwrapped_base64
from corpuscope.operators.numbering import numbered
from corpuscope.operators.reports import of_sessions
from corpuscope.schemas import DEFAULT_SID, PACKAGE_BODY, PACKAGE_VERSION
from corpuscope.session import staged

# Entries of one package text. A session with more is written as several, numbered from 0, so that
# no row grows with a session and nothing is left out.
PART_ENTRIES = 10_000

# What makes two errors of a session the same.
_ERROR = ["error_type", "message", "file_path", "line_number"]

# Headings of the text that stands before a package.
TITLE = "=== SESSION RESUME (v%s) ===\nSession: %s\nDecisions: %d  |  Errors: %d  |  Files: %d\n\n"
ERRORS_HEADING = "--- ERRORS TO FIX ---\n"
DECISIONS_HEADING = "--- KEY DECISIONS ---\n"
BLOB_HEADING = "\n--- BASE64 BLOB (paste to AI) ---\n"


def _numbered(rows: DataFrame, order, limit: int | None) -> DataFrame:
    """Rows with their position in their session; with a limit, the first rows of each (Spark then
    limits each task to `limit` per session before the shuffle)."""
    if limit is None:
        return numbered(rows, ["sid"], order, "position")
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("sid").orderBy(*order)))
    return ranked.where(F.col("position") <= limit)


def _distinct_errors(errors: DataFrame, sessions: DataFrame | None) -> DataFrame:
    return of_sessions(errors, sessions).groupBy("sid", *_ERROR).agg(F.max("timestamp").alias("timestamp"))


def recent_distinct_errors(errors: DataFrame, sessions: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Per session the distinct (type, message, file, line), newest first; all unless limited."""
    return _recent(_distinct_errors(errors, sessions), limit)


def _recent(distinct: DataFrame, limit: int | None) -> DataFrame:
    return _numbered(distinct, [F.desc("timestamp"), *_ERROR], limit)


def _entries(decisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Decisions (kind 0) and files (kind 1) as assumptions without a position."""
    from_decisions = decisions.select(
        "sid", F.lit(0).alias("kind"), (-F.col("timestamp")).alias("age"), F.col("node_id").alias("tie"),
        F.coalesce("key", F.lit("")).alias("name"), F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce("rationale", F.lit("")).alias("constraint"))
    from_files = snapshots.select(
        "sid", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("age"), F.col("file_path").alias("tie"),
        F.concat(F.lit("file."), F.coalesce("file_path", F.lit("?"))).alias("name"),
        F.concat_ws(":", F.coalesce("content_hash", F.lit("?")),
                    F.coalesce("lines_of_code", F.lit(0)).cast("string"),
                    F.coalesce("language", F.lit("?"))).alias("value"),
        F.lit("").alias("constraint"))
    return from_decisions.unionByName(from_files)


def _assumptions(entries: DataFrame, limit: int | None) -> DataFrame:
    return _numbered(entries, ["kind", "age", "tie"], limit).select("sid", "position", "kind", "name", "value", "constraint")


def package_assumptions(decisions: DataFrame, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """(sid, position, name, value, constraint): newest decisions first, then files; all unless limited."""
    return _assumptions(_entries(decisions, snapshots), limit)


def package_invariants(errors: DataFrame, sessions: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(sid, position, name, condition): what has to be fixed."""
    return _invariants(recent_distinct_errors(errors, sessions, limit))


def _invariants(recent: DataFrame) -> DataFrame:
    kind = F.col("error_type")
    return recent.select(
        "sid", "position",
        F.concat(F.lit("fix_"), F.coalesce(kind, F.lit("unknown"))).alias("name"),
        F.concat(F.coalesce(kind, F.lit("?")), F.lit(" at "), F.coalesce("file_path", F.lit("?")), F.lit(":"),
                 F.coalesce("line_number", F.lit(0)).cast("string"), F.lit(" — "),
                 F.coalesce("message", F.lit("?"))).alias("condition"))


def build_package(decisions: DataFrame, errors: DataFrame, snapshots: DataFrame, now: int,
                  version: str = PACKAGE_VERSION, sessions: DataFrame | None = None, limit: int | None = None,
                  shown: int | None = None, part_entries: int = PART_ENTRIES) -> DataFrame:
    """One package per session, or several parts of at most `part_entries` assumptions and as many
    invariants: arrays, preamble, `SID:` text and the full export text.

    Decisions, errors and files are made once and written: numbering reads its rows twice, totals once more.
    Totals count the whole session. The preamble lists the entries of its part, or the first
    `shown` of each kind."""
    part = F.floor((F.col("position") - 1) / part_entries).cast("int").alias("part")

    def collected(rows, fields, name):
        # a part has at most `part_entries` rows
        return rows.groupBy("sid", part).agg(F.transform(
            F.sort_array(F.collect_list(F.struct("position", *fields))),
            lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name))

    entries = staged(_entries(decisions, snapshots), "entries")
    distinct = staged(_distinct_errors(errors, sessions), "distinct-errors")
    assumptions = collected(_assumptions(entries, limit), ["name", "value", "constraint"], "assumptions")
    invariants = _invariants(_recent(distinct, limit))
    body = assumptions.join(collected(invariants, ["name", "condition"], "invariants"), ["sid", "part"], "full_outer")
    totals = entries.groupBy("sid").agg(F.count_if(F.col("kind") == 0).alias("n_decisions"), F.count_if(F.col("kind") == 1).alias("n_files")).join(
        distinct.groupBy("sid").agg(F.count("*").alias("n_errors")), "sid", "full_outer")
    sid = F.col("sid")
    # the first part has no number, so a session of one part reads as it always did
    number = F.when(F.col("part") > 0, F.col("part"))
    metadata = F.struct(
        F.lit(version).alias("version"), sid.alias("sid"), F.lit(now).cast("long").alias("generated_at"),
        F.lit("resume").alias("source"), number.alias("part"))
    rows = body.join(totals, "sid").select(
        sid, F.lit(version).alias("version"), "part",
        *[F.coalesce(F.col(f), F.from_json(F.lit("[]"), PACKAGE_BODY[f].dataType)).alias(f)
          for f in ("assumptions", "invariants")],
        metadata.alias("metadata"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_decisions", "n_files", "n_errors")])

    def lines(items, line):
        return F.array_join(F.transform(items if shown is None else F.slice(items, 1, shown), line), "")

    before = F.col("part") * part_entries
    shown_decisions = F.filter("assumptions", lambda a: ~F.startswith(a["name"], F.lit("file.")))
    preamble = F.concat(
        F.format_string(TITLE, "version", "sid", "n_decisions", "n_errors", "n_files"),
        F.when(F.size("invariants") > 0, F.concat(
            F.lit(ERRORS_HEADING),
            lines(F.col("invariants"), lambda e, i: F.format_string("  [%d] %s\n", before + i + 1, e["condition"])),
            F.lit("\n"))).otherwise(""),
        F.lit(DECISIONS_HEADING),
        lines(shown_decisions, lambda a: F.format_string("  %s = %s\n", a["name"], a["value"])))
    package = F.concat(F.lit("SID:"), "version", F.lit(":"), unwrapped_base64(
        F.to_json(F.struct("assumptions", "invariants", "metadata")).cast("binary")))
    return rows.select(
        F.sha2(F.concat_ws("_", "sid", "version", F.lit(str(now)), number.cast("string")), 256).alias("package_id"),
        "sid", "version", "assumptions", "invariants", "metadata", F.lit(now).cast("long").alias("timestamp"),
        preamble.alias("preamble"), package.alias("package"),
    ).withColumn("export", F.concat("preamble", F.lit(BLOB_HEADING), "package", F.lit("\n")))


def parse_package(texts: DataFrame) -> DataFrame:
    """Texts (sid, text) to (sid, version, assumptions, invariants, metadata, problem).

    The package starts at the first `SID:` of the text. A text that is no package stays as
    a row with its `problem`."""
    start = F.instr("text", F.lit("SID:"))
    blob = F.when(start > 0, F.substring("text", start, 2**31 - 1)).otherwise(F.col("text"))
    parts = F.split(blob, ":", 3)
    rows = texts.select(F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"), parts.alias("parts"),
                        F.startswith(blob, F.lit("SID")).alias("marked"))
    payload = F.regexp_extract(F.get("parts", 2), r"^\s*([A-Za-z0-9+/=]*)", 1)
    decoded = F.try_to_binary(payload, F.lit("base64")).cast("string")
    rows = rows.select("sid", "marked", F.size("parts").alias("n"), F.get("parts", 1).alias("version"),
                       F.from_json(decoded, PACKAGE_BODY).alias("body"), decoded.alias("decoded"))
    valid_json = F.coalesce(F.get_json_object("decoded", "$"), F.lit("")) != ""
    problem = (F.when(~F.coalesce("marked", F.lit(False)), "no SID prefix")
               .when(F.col("n") < 3, "fewer than two colons")
               .when(~valid_json, "payload is not JSON"))
    empty = lambda f: F.from_json(F.lit("[]"), PACKAGE_BODY[f].dataType)
    return rows.select(
        "sid", F.when(problem.isNull(), F.col("version")).alias("version"),
        *[F.when(problem.isNull(), F.coalesce(F.col(f"body.{f}"), empty(f))).alias(f)
          for f in ("assumptions", "invariants")],
        F.col("body.metadata").alias("metadata"), problem.alias("problem"))
