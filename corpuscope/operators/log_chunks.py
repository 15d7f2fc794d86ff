"""Logs of any size: the parsers of `operators.logs` over line-aligned chunks.

A chunk holds whole lines; a log is its chunks in the order of `chunk_no`, a line end between each two.
Whole logs never meet in a row. What reaches over a border is carried by small rows: a flag or two of each
chunk for the command, the exit code and the choice of the parser; the number of empty lines before each
chunk, which says what paragraph a line is in; and of each piece of a paragraph that may hold a traceback
its header, its last frame and its last line. A traceback block is the rest of its paragraph, so the pieces
of a paragraph, however many chunks it fills, add up by minimum and maximum."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuscope.functions.text import leading_int
from corpuscope.operators import logs
from corpuscope.operators.logs import _FRAME, _FRAME_LINE, _TRACEBACK_HEADER, _after, _rows
from corpuscope.schemas import DEFAULT_SID, SESSIONS

CHUNKS = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("text", T.StringType()),
])
_LOG = ["log_id", "sid", "timestamp", "cwd"]
_MAX_INT = (1 << 31) - 1


def _same_log(left: DataFrame, right: DataFrame) -> DataFrame:
    """`left` with the columns of `right` for its log; null parts of the name are equal to each other."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in _LOG})
    at = None
    for c in _LOG:
        equal = F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        at = equal if at is None else at & equal
    return left.join(other, at).drop(*[f"_of_{c}" for c in _LOG])


def chunk_sessions(chunks: DataFrame) -> DataFrame:
    """One row per log: session columns without the output, which stays in the chunks; whether tracebacks and
    compiler lines are found.

    Flags of chunks are added up before the shuffle, so a log of any number of chunks is one row per task."""
    text = F.col("text")
    first_line = F.substring_index("text", "\n", 1)
    found = chunks.withColumn("sid", F.coalesce("sid", F.lit(DEFAULT_SID))).groupBy(*_LOG).agg(
        F.min_by(logs.command_of(first_line), "chunk_no").alias("command"),
        F.max(logs.exit_code_of(text)).alias("exit_code"),
        F.bool_or(logs.has_traceback(text)).alias("has_traceback"),
        F.bool_or(logs.has_compiler_line(text)).alias("has_compiler_line"))
    session = logs.session_id_of(F.col("sid"), F.col("command"), F.col("timestamp"), F.col("log_id"))
    return found.withColumn("session_id", session).withColumn("output", F.lit(None).cast("string")).select(
        *SESSIONS.names, "log_id", "has_traceback", "has_compiler_line")


def _placed(chunks: DataFrame) -> DataFrame:
    """Chunks with the lines and the empty lines of the log before them. The sums run over a row of numbers per chunk."""
    joined = F.concat(F.lit("\n"), "text", F.lit("\n"))
    # each empty line is one place between two line ends
    pieces = F.split(joined, r"(?<=\n)(?=\n)")
    counted = chunks.withColumn("sid", F.coalesce("sid", F.lit(DEFAULT_SID)))
    sizes = counted.select(*_LOG, "chunk_no", F.size(F.split("text", "\n")).cast("long").alias("lines"),
                           (F.size(pieces) - 1).cast("long").alias("empty"))
    before = Window.partitionBy(*_LOG).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(*_LOG, F.col("chunk_no").alias("_chunk_no"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                                                     for c in ("lines", "empty")])
    return _same_log(counted.withColumn("pieces", pieces), sums.withColumnRenamed("_chunk_no", "at_chunk")).where(
        F.col("chunk_no") == F.col("at_chunk")).drop("at_chunk")


def _first(found: Column) -> Column:
    return F.get(found, 0)


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _paragraph_pieces(placed: DataFrame) -> DataFrame:
    """The pieces of paragraphs that may be or go on a traceback block: place and line of the first header, the last
    frame and the last line that is not blank."""
    cut = placed.select(*_LOG, "chunk_no", "empty_before", F.size("pieces").alias("n"), F.posexplode("pieces").alias("j", "piece"))
    border = (F.col("j") == 0) | (F.col("j") == F.col("n") - 1)
    cut = cut.where(border | F.contains("piece", F.lit(_TRACEBACK_HEADER)))
    body = F.regexp_replace("piece", r"\A\n|\n\z", "")
    place = lambda i: F.struct(F.col("chunk_no").alias("chunk"), F.col("j").alias("j"), i.alias("i"))
    lines = F.transform(F.split(body, "\n"), lambda line, i: F.struct(place(i).alias("at"), line.alias("line")))
    cut = cut.where(F.col("piece").rlike(r"[^\n]")).withColumn("lines", lines)
    with_mark = lambda mark: F.filter("lines", lambda x: F.contains(x["line"], F.lit(mark)))
    return cut.select(*_LOG, (F.col("empty_before") + F.col("j")).alias("paragraph"), "chunk_no", "j", "lines",
                      _first(with_mark(_TRACEBACK_HEADER)).alias("head"), _last(with_mark(_FRAME)).alias("frame"),
                      _last(F.filter("lines", lambda x: x["line"].rlike("[^ ]"))).alias("tail"))


def chunk_tracebacks(placed: DataFrame, sessions: DataFrame) -> DataFrame:
    """`logs.parse_tracebacks` over placed chunks: one error per paragraph with a header."""
    pieces = _paragraph_pieces(placed)
    of_paragraph = [*_LOG, "paragraph"]
    blocks = pieces.groupBy(*of_paragraph).agg(F.min("head").alias("head"), F.max("frame").alias("frame"), F.max("tail").alias("tail")).where("head is not null")
    # the line of the header counts from the header on
    after_head = lambda x: F.when(x["at"] == F.col("head.at"), _after(x["line"], _TRACEBACK_HEADER)).otherwise(x["line"])
    blocks = blocks.withColumns({"last": after_head(F.col("tail")), "framed": F.when(F.col("frame.at") >= F.col("head.at"), after_head(F.col("frame")))})
    blocks = blocks.withColumn("rest", F.when(F.contains("framed", F.lit(_FRAME)), F.substring_index("framed", _FRAME, -1)))
    whole = F.contains("rest", F.lit('"')) & F.contains(_after(F.col("rest"), '"'), F.lit(_FRAME_LINE))
    # rarely a frame goes on in later lines of its paragraph: only then are those lines gathered
    odd = blocks.where(F.col("rest").isNotNull() & ~whole).select(*of_paragraph, F.col("frame.at").alias("from"))
    at = lambda c: F.col(c).eqNullSafe(F.col(f"_odd_{c}"))
    named = odd.withColumnsRenamed({c: f"_odd_{c}" for c in of_paragraph})
    match = at("paragraph")
    for c in _LOG:
        match = match & at(c)
    later = pieces.select(*of_paragraph, F.explode("lines").alias("x")).join(named, match).where(F.col("x.at") > F.col("from"))
    more = later.groupBy(*of_paragraph).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("more"))
    more = more.withColumnsRenamed({c: f"_odd_{c}" for c in of_paragraph})
    blocks = blocks.join(more, match, "left").drop(*[f"_odd_{c}" for c in of_paragraph])
    blocks = blocks.withColumn("rest", F.when(F.col("more").isNotNull(), F.concat_ws("\n", "rest", "more")).otherwise(F.col("rest")))
    frame = F.when(F.contains("rest", F.lit('"')), F.col("rest"))
    order = Window.partitionBy(*_LOG).orderBy("paragraph")  # a few short columns per error
    found = blocks.select(*_LOG, F.col("last"), frame.alias("frame"), "paragraph").withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    found = _same_log(found, sessions.select(*_LOG, "session_id"))
    has_colon, name = F.contains("last", F.lit(":")), _after(F.col("frame"), '"')
    place = F.when(F.contains(name, F.lit(_FRAME_LINE)), leading_int(_after(name, _FRAME_LINE)))
    return _rows(found, F.col("ordinal"), F.when(has_colon, F.substring_index("last", ":", 1)),
                 F.substring_index("frame", '"', 1), place, F.lit(None),
                 F.when(has_colon, F.substring(_after(F.col("last"), ":"), 2, 2**31 - 1)))


def chunk_compiler_lines(placed: DataFrame, sessions: DataFrame) -> DataFrame:
    """`logs.parse_compiler_lines` over placed chunks; the ordinal is the number of the line in the log."""
    some = placed.where(logs.has_compiler_line(F.col("text"))).drop("pieces")
    known = _same_log(some, sessions.where("not has_traceback").select(*_LOG, "session_id"))
    lines = known.select("session_id", "sid", "timestamp", F.col("text").alias("output"), "lines_before")
    # the parser numbers the lines of a chunk; the lines before it come on top
    found = logs.parse_compiler_lines(lines.withColumn("timestamp", F.struct("timestamp", "lines_before")))
    ordinal = F.least(F.col("ordinal") + F.col("timestamp.lines_before"), F.lit(_MAX_INT)).cast("int")
    return found.withColumn("ordinal", ordinal).withColumn("timestamp", F.col("timestamp.timestamp"))


def parse_log_chunks(chunks: DataFrame):
    """(sessions, errors) of chunked logs (`CHUNKS`): the rows of `logs.parse_logs`, the output left in the chunks."""
    sessions, placed = chunk_sessions(chunks), _placed(chunks)
    failed = sessions.where("exit_code <> 0 and not has_traceback and not has_compiler_line")
    none = F.lit(None)
    generic = _rows(failed, F.lit(0), F.lit("generic_error"), none.cast("string"), none, none,
                    F.lit(logs.GENERIC_FAILURE), F.col("command"), F.col("exit_code"))
    errors = chunk_tracebacks(placed, sessions).unionByName(chunk_compiler_lines(placed, sessions)).unionByName(generic)
    return logs.latest(sessions.select(*SESSIONS.names), ["session_id"], ["timestamp"]), logs.distinct_errors(errors)
