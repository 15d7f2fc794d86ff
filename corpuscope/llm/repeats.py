"""Which windows of documents share a trigger with another place: the first passes that both
substring operators have in common.

Only the trigger hash of every context is shuffled in the first pass; a second pass over the
texts keeps contexts whose trigger occurs again (a fixed-size bitmap skips most others, an exact
join the rest). Everything after works on repeated content alone."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.tables import Staged, bitmap_of, marked

# Bits of the bitmap over trigger hashes: at most 2^18 rows of two numbers.
TRIGGER_BITS = 1 << 24
# Distinct contexts of one trigger that one task may hold.
HOT = 1000


def repeated_contexts(contexts: DataFrame, tables: Staged, *, repeated, bits: int = TRIGGER_BITS) -> DataFrame:
    """The rows of `contexts` (trigger, ...) whose trigger satisfies `repeated`, an aggregate condition."""
    triggers = tables.write(contexts.groupBy("trigger").agg(repeated.alias("again")).filter("again").select("trigger"), "triggers")
    bitmap = tables.write(bitmap_of(triggers, F.col("trigger"), bits), "trigger-bits")
    near = marked(contexts, F.col("trigger"), bitmap, bits).filter("marked").drop("marked")
    return tables.write(near.join(triggers, "trigger", "left_semi"), "contexts")


def with_lists(docs: DataFrame, lists: DataFrame, tables: Staged, name: str):
    """`docs` (with key) split in two: those surely without a row in `lists` (key, ...), and the
    others left-joined with it. Only the texts of the second part are shuffled."""
    bitmap = tables.write(bitmap_of(lists, F.col("key")), f"{name}-bits")
    split = marked(docs, F.col("key"), bitmap)
    return split.filter("not marked").drop("marked"), split.filter("marked").drop("marked").join(lists, "key", "left")


def in_small_groups(rows: DataFrame, tables: Staged, match, *, window: int, unit: int, merged, hot: int = HOT, depth: int = 0) -> DataFrame:
    """What `match` answers for every context, with at most `hot` contexts of one trigger in one group.

    rows: trigger, digest, value, near, far, low, high, context: distinct contexts whose windows begin
    `near` .. `far` symbols (of `unit` bytes) before the trigger, all within the trigger's range `low` .. `high`.
    `match` turns them into rows (trigger, digest, at, ...); `at` counts starts from the context's first one.

    All windows of a range contain the `low` symbols before the trigger and the `window - high` from it
    on. A trigger with more contexts has its range halved: the fixed symbols of each half, longer now,
    are the new trigger, and contexts that are equal within a half become one, their values `merged`.
    Equal windows have equal distances and so stay together. A range of one distance has one context."""
    kinds = rows.groupBy("trigger").agg(F.count("*").alias("kinds"))
    crowded = tables.write(kinds.filter(F.col("kinds") > hot).select("trigger"), f"hot-{depth}")
    if crowded.isEmpty():
        return match(rows)
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
    halves = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
    pieces = (rows.join(crowded, "trigger", "left_semi").withColumn("half", F.explode(halves))
              .withColumn("low", F.col("half.low")).withColumn("high", F.col("half.high"))
              .withColumn("shift", F.greatest(F.col("far") - F.col("high"), F.lit(0).cast("long")))
              .withColumn("near", F.greatest("near", "low")).withColumn("far", F.least("far", "high")).filter("near <= far")
              .withColumn("context", F.expr(f"substring(context, cast(shift * {unit} + 1 as int), cast((far + {window} - near) * {unit} as int))"))
              .withColumn("key", F.xxhash64("trigger", "low", F.expr(
                  f"substring(context, cast((far - low) * {unit} + 1 as int), cast((low + {window} - high) * {unit} as int))")))
              .withColumn("part", F.xxhash64("key", "near", "far", "context")))
    same = ("near", "far", "low", "high", "context")
    distinct = pieces.groupBy("key", "part").agg(merged("value").alias("value"), *[F.first(c).alias(c) for c in same])
    distinct = tables.write(distinct.withColumnsRenamed({"key": "trigger", "part": "digest"}), f"pieces-{depth}")
    found = in_small_groups(distinct, tables, match, window=window, unit=unit, merged=merged, hot=hot, depth=depth + 1)
    found = found.withColumnsRenamed({"trigger": "key", "digest": "part"})
    back = (pieces.select("trigger", "digest", "key", "part", "shift").join(found, ["key", "part"])
            .withColumn("at", F.col("at") + F.col("shift")).drop("key", "part", "shift"))
    return match(rows.join(crowded, "trigger", "left_anti")).unionByName(back)
