"""Whole-text sources and sinks: terminal logs, rule files, packages."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuscope.schemas import DEFAULT_SID, RULES

# The default rules (file, text).
DEFAULT_RULE_FILES = {
    "c.template": r"""[pattern:function]
regex = ^[a-zA-Z_][a-zA-Z0-9_]*\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{
action = log
key = function.declared
language = c

[pattern:sql_query]
regex = (mysql_query|sqlite3_exec|PQexec|pg_query)\s*\([^,]*,\s*"([^"]+)"
action = report
key = database.query
language = c

[pattern:api_call]
regex = (curl_easy_init|http_get|fetch|request)\s*\(
action = log
key = api.called
language = c
""",
    "python.template": r"""[pattern:function]
regex = ^def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(
action = log
key = function.declared
language = python

[pattern:sql_query]
regex = (cursor\.execute|db\.query|session\.query)\s*\(
action = report
key = database.query
language = python
""",
}


def _whole_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    # wholetext has to be passed as the argument: the option of that name is overridden
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_logs(spark: SparkSession, path: str, now: int | None = None, sid: str = DEFAULT_SID) -> DataFrame:
    """One row (sid, output, timestamp, cwd, log_id) per log file: when it was last modified (or
    `now`), its folder and its path."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("output"), F.col("_metadata.file_path").alias("log_id"),
        F.unix_seconds("_metadata.file_modification_time").alias("modified"))
    return texts.select(
        F.lit(sid).alias("sid"), "output", (F.col("modified") if now is None else F.lit(now)).cast("long").alias("timestamp"),
        F.regexp_replace("log_id", r"/[^/]*$", "").alias("cwd"), "log_id")


# Characters of one chunk of a log, at least (a longer line is a chunk of its own).
CHUNK_CHARS = 1 << 20


def _chunked(chunk_chars):
    """Arrow batches of lines (log_id, modified, block, line), in order, to chunks of whole lines."""
    def run(batches):
        import pyarrow as pa

        names = ["log_id", "modified", "chunk_no", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        held, size, of, made = [], 0, None, 0
        out = []

        def close():
            # a block has more bytes than lines, so these numbers stay below the next block's
            out.append((of[0], of[1], of[2] + made, "\n".join(held)))

        for batch in batches:
            for log, modified, block, line in zip(*(batch.column(c).to_pylist() for c in ("log_id", "modified", "block", "line"))):
                if held and ((log, modified, block) != of or size >= chunk_chars):
                    close()
                    made = made + 1 if (log, modified, block) == of else 0
                    held, size = [], 0
                of = (log, modified, block)
                held.append(line)
                size += len(line) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def read_log_chunks(spark: SparkSession, path: str, now: int | None = None, sid: str = DEFAULT_SID,
                    chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Log files of any size as chunks of whole lines (`operators.log_chunks.CHUNKS`).

    Spark cuts a large file into blocks at line ends, so one file spreads over tasks; a chunk is numbered by where
    its block starts in the file. A file without any line has no chunk."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("log_id"), F.unix_seconds("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    chunks = lines.mapInArrow(_chunked(chunk_chars), "log_id string, modified long, chunk_no long, text string")
    return chunks.select("log_id", F.lit(sid).alias("sid"), (F.col("modified") if now is None else F.lit(now)).cast("long").alias("timestamp"),
                         F.regexp_replace("log_id", r"/[^/]*$", "").alias("cwd"), "chunk_no", "text")


def rules_from_texts(texts: DataFrame) -> DataFrame:
    """Rules of (file, text) rows: `[section]`, then `name = value` lines; `#` comments.

    One rule per section, also where sections of a file have one name; a value set twice in a
    section keeps the last."""
    line = F.trim(F.col("line"), F.lit(" \t\n\x0b\f\r"))
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "file", "pos", line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    in_order = Window.partitionBy("file").orderBy("pos")
    is_header = F.startswith("line", F.lit("["))
    header = F.when(is_header & F.contains("line", F.lit("]")), F.substring_index(F.substring("line", 2, 2**31 - 1), "]", 1))
    carried = lines.select(
        "file", "pos", "line", is_header.alias("is_header"),
        F.count(header).over(in_order).alias("section"),
        F.coalesce(F.last(header, ignorenulls=True).over(in_order), F.lit("")).alias("pattern_name"))
    pair = F.split("line", "=", 2)
    pairs = carried.where(~F.col("is_header") & F.contains("line", F.lit("="))).select(
        "file", "pos", "section", "pattern_name", F.rtrim(F.get(pair, 0), F.lit(" \t\x0b\f\r")).alias("name"),
        F.ltrim(F.get(pair, 1), F.lit(" \t\x0b\f\r")).alias("value"))

    def value_of(name):
        return F.coalesce(F.max_by(F.when(F.col("name") == name, F.col("value")),
                                   F.when(F.col("name") == name, F.col("pos"))), F.lit(""))

    return pairs.groupBy("file", "section", "pattern_name").agg(
        value_of("language").alias("language"), value_of("action").alias("action"),
        value_of("key").alias("log_key"), value_of("regex").alias("regex")).select(*RULES.names)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return rules_from_texts(_whole_texts(spark, path, "*.template*"))


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_from_texts(spark.createDataFrame(list(DEFAULT_RULE_FILES.items()), "file string, text string"))


def write_default_rules(folder: str) -> None:
    """The default rule files, for users to extend."""
    import os

    os.makedirs(folder, exist_ok=True)
    for name, text in DEFAULT_RULE_FILES.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(text)


def read_packages(spark: SparkSession, path: str, sid: str = DEFAULT_SID, one_per_line: bool = False) -> DataFrame:
    """Rows (sid, text) for `parse_package`: a file may be one export text, or hold a package per line."""
    texts = spark.read.text(path).withColumnRenamed("value", "text") if one_per_line else _whole_texts(spark, path)
    return texts.select(F.lit(sid).alias("sid"), "text")


def write_packages(packages: DataFrame, path: str) -> None:
    """One package per line."""
    packages.select("package").write.text(path)
