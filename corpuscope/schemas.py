"""Table schemas, decision sources and defaults shared by all operators."""

from pyspark.sql import types as T

DEFAULT_SID = "default"
PACKAGE_VERSION = "5.0.0"
EMBEDDING_DIM = 128

# decisions.source (fixed values)
SOURCE_HUMAN = 0
SOURCE_AI = 1
SOURCE_AUTONOMOUS = 2
SOURCE_CONFLICT_RESOLUTION = 3
SOURCE_PLUGIN = 4
SOURCE_TERMINAL_PARSE = 5
SOURCE_IMPORT = 6

FILES = T.StructType([
    T.StructField("sid", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("content", T.StringType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("last_modified", T.LongType()),
    T.StructField("lines_of_code", T.LongType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

PATTERNS = T.StructType([
    T.StructField("sid", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("pattern_name", T.StringType()),
    T.StructField("matched_text", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("log_key", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("match_no", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
])

DECISIONS = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_model", T.StringType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("ordinal", T.LongType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("cwd", T.StringType()),
])

ERRORS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("column_number", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("ordinal", T.IntegerType()),
])

RULES = T.StructType([
    T.StructField("pattern_name", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("log_key", T.StringType()),
    T.StructField("regex", T.StringType()),
])

ASSUMPTION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("constraint", T.StringType()),
])

INVARIANT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("condition", T.StringType()),
])

PACKAGE_BODY = T.StructType([
    T.StructField("assumptions", T.ArrayType(ASSUMPTION)),
    T.StructField("invariants", T.ArrayType(INVARIANT)),
    T.StructField("metadata", T.StructType([
        T.StructField("version", T.StringType()),
        T.StructField("sid", T.StringType()),
        T.StructField("generated_at", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("part", T.IntegerType()),
    ])),
])

PACKAGES = T.StructType([
    T.StructField("package_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("assumptions", T.ArrayType(ASSUMPTION)),
    T.StructField("invariants", T.ArrayType(INVARIANT)),
    T.StructField("metadata", PACKAGE_BODY["metadata"].dataType),
    T.StructField("timestamp", T.LongType()),
    T.StructField("preamble", T.StringType()),
    T.StructField("package", T.StringType()),
    T.StructField("export", T.StringType()),
])

POSTINGS = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("sid", T.StringType()),
])

SKIPPED = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

REPORTS = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("sid", T.StringType()),
    T.StructField("generated_at", T.LongType()),
    T.StructField("report_text", T.StringType()),
    T.StructField("metrics", T.StringType()),
])
