"""Terminal logs to sessions and structured errors.

Blocks and lines of a log are rows from the start, so the parsers are plain columns; which of them
speaks for a log is a flag of the log, so choosing needs no join and the whole step no shuffle."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.functions.text import ERROR_MARKERS, leading_int
from corpuscope.functions.vectors import embed_text
from corpuscope.operators.ledger import earliest, latest
from corpuscope.schemas import DEFAULT_SID, ERRORS, SESSIONS

ERROR_KEY = ["session_id", "file_path", "line_number", "message"]

# The block pattern of a traceback, the wording of its frames, a compiler's line of
# five parts, and the message of a failure that no parser explains.
_TRACEBACK_HEADER = "Traceback (most recent call last):"
_TRACEBACK = r"(?s)Traceback \(most recent call last\):(.*?)(?=\n\n|\z)"
_COMPILER_LINE = r"(?:\A|\n)(?![ \t])(?![0-9]*:)(?:[^:\n]*:){4} *[^ \n]"
GENERIC_FAILURE = "Command failed (non-zero exit)"
_FRAME = '  File "'
_FRAME_LINE = ", line "


def _after(text: Column, mark: Column | str) -> Column:
    """What follows the first `mark`; only used where the mark is present."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.substring(text, F.instr(text, mark) + F.char_length(mark), 2**31 - 1)


def _rows(rows: DataFrame, ordinal, error_type, file_path, line, column, message, command=None, exit_code=None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        "session_id", "sid", error_type.alias("error_type"), file_path.alias("file_path"),
        line.cast("int").alias("line_number"), column.cast("int").alias("column_number"), message.alias("message"),
        (none if command is None else command).cast("string").alias("command"),
        (none if exit_code is None else exit_code).cast("int").alias("exit_code"),
        "timestamp", ordinal.alias("ordinal")).select(*ERRORS.names)


def has_traceback(output: Column) -> Column:
    """Every header begins a block, so this says whether the traceback parser finds anything."""
    return F.contains(output, F.lit(_TRACEBACK_HEADER))


def has_compiler_line(output: Column) -> Column:
    return output.rlike(_COMPILER_LINE)


def parse_tracebacks(sessions: DataFrame) -> DataFrame:
    """One error per traceback block: the last frame's file and line, and the last
    non-blank line split at its first colon. Parts that are missing are NULL."""
    found = sessions.where(has_traceback(F.col("output"))).select(
        "session_id", "sid", "timestamp",
        F.posexplode(F.regexp_extract_all("output", F.lit(_TRACEBACK), F.lit(1))).alias("ordinal", "block"))
    # trailing blanks and line ends go first, so the last line is the last that is not blank
    last = F.substring_index(F.regexp_replace("block", r"(?:\n *)+\z", ""), "\n", -1)
    rest = F.when(F.contains("block", F.lit(_FRAME)), F.substring_index("block", _FRAME, -1))
    frame = F.when(F.contains(rest, F.lit('"')), rest)
    found = found.select("session_id", "sid", "timestamp", "ordinal", last.alias("last"), frame.alias("frame"))
    named = _after(F.col("frame"), '"')
    place = F.when(F.contains(named, F.lit(_FRAME_LINE)), leading_int(_after(named, _FRAME_LINE)))
    has_colon = F.contains("last", F.lit(":"))
    return _rows(found, F.col("ordinal"), F.when(has_colon, F.substring_index("last", ":", 1)),
                 F.substring_index("frame", '"', 1), place, F.lit(None),
                 F.when(has_colon, F.substring(_after(F.col("last"), ":"), 2, 2**31 - 1)))


def parse_compiler_lines(sessions: DataFrame) -> DataFrame:
    """One error per `path:line:column: type: message` line, bounded by the line."""
    lines = sessions.select("session_id", "sid", "timestamp", F.posexplode(F.split("output", "\n")).alias("ordinal", "line"))
    parts = lines.select("session_id", "sid", "timestamp", "ordinal", F.split("line", ":", 5).alias("p")).where(F.size("p") == 5)
    path, kind, message = F.get("p", 0), F.ltrim(F.get("p", 3), F.lit(" ")), F.ltrim(F.get("p", 4), F.lit(" "))
    severity = (F.when(F.startswith(kind, F.lit("error")), "compile_error")
                .when(F.startswith(kind, F.lit("warning")), "compile_warning")
                .when(F.startswith(kind, F.lit("note")), "compile_note")
                .otherwise("compile_info"))
    valid = parts.where((message != "") & ~path.rlike(r"^([ \t]|[0-9]*\z)"))
    return _rows(valid, F.col("ordinal"), severity, path, leading_int(F.get("p", 1)), leading_int(F.get("p", 2)), message)


def generic_failures(sessions: DataFrame) -> DataFrame:
    """Failed sessions in which neither parser finds anything."""
    output = F.col("output")
    failed = sessions.where((F.col("exit_code") != 0) & ~has_traceback(output) & ~has_compiler_line(output))
    none = F.lit(None)
    return _rows(failed, F.lit(0), F.lit("generic_error"), none.cast("string"), none, none,
                 F.lit(GENERIC_FAILURE), F.col("command"), F.col("exit_code"))


def command_of(output: Column) -> Column:
    """The first line after any prompt characters."""
    return F.regexp_extract(output, r"^[$~/ \t]*([^\n]*)", 1)


def exit_code_of(output: Column) -> Column:
    return reduce(Column.__or__, [F.contains(output, F.lit(m)) for m in ERROR_MARKERS]).cast("int")


def session_id_of(sid: Column, command: Column, timestamp: Column, log_id: Column) -> Column:
    """Logs that are read in bulk have a `log_id` (their path), which keeps equal commands of one
    second apart; a log without one is named by the other three."""
    return F.sha2(F.concat_ws("_", sid, command, timestamp.cast("string"), log_id), 256)


def log_sessions(logs: DataFrame) -> DataFrame:
    """Logs (sid, output, timestamp[, cwd][, log_id]) to one session row per log."""
    cwd, log_id = [F.col(c) if c in logs.columns else F.lit(None).cast("string") for c in ("cwd", "log_id")]
    rows = logs.select(
        F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"), "output", "timestamp", cwd.alias("cwd"), log_id.alias("log_id"),
        command_of(F.col("output")).alias("command"), exit_code_of(F.col("output")).alias("exit_code"))
    return rows.withColumn("session_id", session_id_of(
        F.col("sid"), F.col("command"), F.col("timestamp"), F.col("log_id"))).select(*SESSIONS.names)


def session_rows(logs: DataFrame) -> DataFrame:
    """Sessions as stored: one row per session id, later logs replace earlier ones."""
    return latest(log_sessions(logs), ["session_id"], ["timestamp"])


def session_names(logs: DataFrame) -> DataFrame:
    """(session_id, sid) of the same sessions, for reports: no log text is shuffled."""
    return log_sessions(logs).select("session_id", "sid").distinct()


def with_session_embedding(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("embedding", embed_text(F.concat_ws(" ", "command", "output")))


def session_errors(sessions: DataFrame) -> DataFrame:
    """Per session the errors of the first parser that finds any: tracebacks, else
    compiler lines, else one generic failure if the session failed.

    Which one that is, is a flag of the session, so the three are disjoint and add up."""
    without = sessions.where(~has_traceback(F.col("output")))
    return (parse_tracebacks(sessions).unionByName(parse_compiler_lines(without))
            .unionByName(generic_failures(without)))


def distinct_errors(errors: DataFrame) -> DataFrame:
    """First error per (session, file, line, message); pre-aggregated before its shuffle."""
    return earliest(errors, ERROR_KEY, ["timestamp", "ordinal"]).select(*ERRORS.names)


def parse_logs(logs: DataFrame):
    """(sessions, errors) of raw logs, both ready to store."""
    return session_rows(logs), distinct_errors(session_errors(log_sessions(logs)))
