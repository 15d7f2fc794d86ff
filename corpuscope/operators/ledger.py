"""Keyed writes and the decision ledger."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.functions.text import epoch_text
from corpuscope.functions.vectors import embed_text
from corpuscope.schemas import (
    DECISIONS, DEFAULT_SID, SOURCE_AUTONOMOUS, SOURCE_HUMAN, SOURCE_IMPORT, SOURCE_TERMINAL_PARSE)


# The actions of the five producers and the wording of their rationales.
HUMAN, TERMINAL_ERROR, PATTERN, CHANGE, IMPORT = (
    "human_decision", "terminal_error", "pattern_detected", "file_changed", "sid_import")
ERROR_IN, PATTERN_IN, FILE_CHANGED, IMPORTED = "Error in ", "Pattern '", "File ", "Imported from SID: "
# Characters of a value in the short column of a listing; the whole value stands beside it.
VALUE_SHOWN = 63


def _one_per_key(rows: DataFrame, keys, order, pick) -> DataFrame:
    """The row with the greatest / least order per key.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a
    key holding a third of all rows sends one row per task. Columns after the order
    columns break ties, which makes the choice a total order."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("row"))
    return picked.select(*keys, "row.*").select(*rows.columns)


def latest(rows: DataFrame, keys, order) -> DataFrame:
    """Insert-or-replace within one DataFrame: the last row per key."""
    return _one_per_key(rows, keys, order, F.max)


def earliest(rows: DataFrame, keys, order) -> DataFrame:
    """Insert-or-ignore within one DataFrame: the first row per key."""
    return _one_per_key(rows, keys, order, F.min)


def _without_keys_of(rows: DataFrame, other: DataFrame, keys) -> DataFrame:
    # `other` is a projection under new names, so a table can be compared with rows made from it
    other = other.select(*[F.col(k).alias(f"other_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys])
    return rows.join(other, same, "left_anti")


def replace_into(existing: DataFrame, incoming: DataFrame, keys, order) -> DataFrame:
    """`existing` (one row per key) after writing `incoming`: incoming rows win whole.

    The existing rows are only probed (anti-join), and not shuffled when the incoming keys
    prove small enough to broadcast at run time."""
    new = latest(incoming, keys, order)
    return _without_keys_of(existing, new, keys).unionByName(new)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys, order) -> DataFrame:
    """`existing` (one row per key) plus the incoming rows whose key is new."""
    new = earliest(incoming, keys, order)
    return existing.unionByName(_without_keys_of(new, existing, keys))


# --- decisions ---------------------------------------------------------------------------

def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def node_id(key="key", value="value", rationale="rationale") -> Column:
    return F.sha2(F.concat_ws("|", _text(key), _text(value), _text(rationale)), 256)


def _decisions(rows: DataFrame, action, key, value, rationale, confidence, source_model, source,
               timestamp=None, ordinal=None) -> DataFrame:
    return rows.select(
        F.coalesce("sid", F.lit(DEFAULT_SID)).alias("sid"), F.lit(action).alias("action"),
        key.alias("key"), value.alias("value"), rationale.alias("rationale"),
        (F.col("timestamp") if timestamp is None else timestamp).cast("long").alias("timestamp"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(source_model).alias("source_model"), F.lit(source).alias("source"),
        (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"),
    ).withColumn("node_id", node_id()).select(*DECISIONS.names)


def human_decisions(rows: DataFrame) -> DataFrame:
    """Logged by hand: (sid, key, value, rationale, timestamp[, ordinal]); a missing
    rationale is the value itself."""
    ordinal = F.col("ordinal") if "ordinal" in rows.columns else None
    return _decisions(rows, HUMAN, F.col("key"), F.col("value"),
                      F.coalesce("rationale", "value"), 1.0, "human", SOURCE_HUMAN, ordinal=ordinal)


def error_decisions(errors: DataFrame) -> DataFrame:
    place = F.concat(_text("file_path"), F.lit(":"), F.coalesce("line_number", F.lit(0)).cast("string"))
    return _decisions(errors, TERMINAL_ERROR, _text("error_type"), place,
                      F.concat(F.lit(ERROR_IN), place, F.lit(" — "), _text("message")),
                      1.0, "terminal_parser", SOURCE_TERMINAL_PARSE, ordinal=F.col("ordinal"))


def pattern_decisions(patterns: DataFrame, now: int) -> DataFrame:
    """Matches of rules whose action is `log`."""
    why = F.concat(F.lit(PATTERN_IN), "pattern_name", F.lit("' in "), "file_path", F.lit(":"),
                   F.col("line_number").cast("string"))
    return _decisions(patterns.where(F.col("action") == "log"), PATTERN, F.col("log_key"),
                      F.col("matched_text"), why, 0.95, "pattern_engine", SOURCE_AUTONOMOUS,
                      timestamp=F.lit(now), ordinal=F.col("match_no"))


def change_decisions(snapshots: DataFrame, now: int) -> DataFrame:
    """One decision per re-indexed file, named by its last path part."""
    name = F.substring_index("file_path", "/", -1)
    why = F.concat(F.lit(FILE_CHANGED), name, F.lit(" changed ("), F.col("lines_of_code").cast("string"),
                   F.lit(" lines)"))
    return _decisions(snapshots, CHANGE, F.lit("file.modified"), name, why, 1.0,
                      "file_watcher", SOURCE_AUTONOMOUS, timestamp=F.lit(now))


def import_decisions(parsed: DataFrame, now: int) -> DataFrame:
    """Assumptions of parsed packages (`operators.packages.parse_package`) as decisions."""
    rows = parsed.where(F.col("problem").isNull()).select(
        "sid", F.posexplode("assumptions").alias("ordinal", "a"))
    return _decisions(rows, IMPORT, F.coalesce("a.name", F.lit("")), F.coalesce("a.value", F.lit("")),
                      F.concat(F.lit(IMPORTED), F.coalesce("a.constraint", F.lit(""))),
                      0.95, "sid_import", SOURCE_IMPORT, timestamp=F.lit(now), ordinal=F.col("ordinal"))


def decision_key(per_session: bool = False):
    """Equal decisions of two sessions are one decision, unless `per_session`."""
    return ["sid", "node_id"] if per_session else ["node_id"]


def merge_decisions(*producers: DataFrame, per_session: bool = False) -> DataFrame:
    """The ledger after all producers' rows: last writer wins per decision key."""
    rows = reduce(DataFrame.unionByName, producers)
    return latest(rows, decision_key(per_session), ["timestamp", "ordinal"])


def with_decision_embedding(decisions: DataFrame) -> DataFrame:
    """Vectors over "key value rationale"; apply after merging, so survivors only are embedded."""
    return decisions.withColumn("embedding", embed_text(
        F.concat_ws(" ", _text("key"), _text("value"), _text("rationale"))))


def list_decisions(decisions: DataFrame, sid: str | None = None) -> DataFrame:
    """Newest first per session; a full listing is range-partitioned on unique sort keys,
    so a hot session spreads over tasks."""
    rows = decisions if sid is None else decisions.where(F.col("sid") == sid)
    return rows.select(
        "sid", "node_id", "key", "action", "confidence",
        F.round(F.col("confidence") * 100).cast("int").alias("confidence_percent"),
        F.substring(F.coalesce("value", F.lit("?")), 1, VALUE_SHOWN).alias("value_short"), "value",
        "timestamp", epoch_text(F.col("timestamp")).alias("logged_at"),
    ).orderBy("sid", F.desc("timestamp"), "node_id")
