"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch is every shingle hash below a fixed fraction of the hash range, whatever the text's
length, and the smallest hash where none is below it. Sketches of two texts are samples of their
shingles by the same rule, so sets can be compared, merged and tested for containment however
unequal the texts are."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.tables import documents

SHINGLE = 5
# One hash in `SCALE` is kept.
SCALE = 4
LARGEST = (1 << 63) - 1
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"


def sketch(text: Column) -> Column:
    """Sorted kept hashes of a text's 5-word shingles; a shorter text is one shingle, one without words none."""
    words = F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+", -1)
    # each step is evaluated once, as the argument of the next
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    each = F.transform(F.array(hashed), lambda h: F.when(
        F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)),
            lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(SHINGLE)]))))
    positive = F.transform(each[0], lambda x: x.bitwiseAND(F.lit(LARGEST)))
    kept = F.transform(F.array(positive), lambda all_: F.transform(
        F.array(F.filter(all_, lambda x: x < F.lit(LARGEST // SCALE))),
        lambda some: F.when(F.size(some) > 0, F.array_sort(F.array_distinct(some))).otherwise(F.array(F.array_min(all_))))[0])[0]
    return F.when(F.btrim(text, F.lit(WHITE)) == "", F.array().cast("array<long>")).otherwise(kept)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(LARGEST // SCALE))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two texts without words."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of `a` that `b` has; 1 for a text without words."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), " ")


def with_next(docs: DataFrame, columns) -> DataFrame:
    """`docs` with `next`: a struct of `columns` of the row of the next doc_id (after the last: the first).

    Rows are dealt to ranges of ids; the next row of a range's last comes from a table of the first
    rows, one per range. Null ids come first, equal ids in the order of their texts' hashes."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)]).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda x: x < F.col("doc_id"))) if bounds else F.lit(0)
    rows = docs.withColumn("part", part).withColumn("tie", F.xxhash64("text"))
    # one row per range: at most 2 * shuffle partitions
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("at")).orderBy("part").collect()
    pairs = [(a["part"], b["at"]["doc_id"], b["at"]["tie"]) for a, b in zip(firsts, firsts[1:] + firsts[:1])]
    follow = spark.createDataFrame(pairs, "before int, id long, first_tie long")
    heads = (rows.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("first_tie")))
             .groupBy("before").agg(F.first(F.struct(*columns)).alias("head")))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    led = rows.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return (led.join(heads, (F.col("part") == F.col("before")) & F.col("next").isNull(), "left")
            .withColumn("next", F.coalesce("next", "head")).drop("part", "tie", "before", "head"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. An only row is its own next. Other columns are not looked at."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", sketch(F.col("text")))
    led = with_next(rows, ["text", "print"]).withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - moved),
                      F.substring(F.col("next.text"), F.lit(1), moved))
    led = led.select("doc_id", "n_chars", "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    led = led.withColumn("edited_print", sketch(F.col("edited")))
    return led.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      printed(F.col("print")).alias("fingerprint"), printed(F.col("edited_print")).alias("edited_fingerprint"),
                      likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                      likeness(F.col("print"), F.col("next_print")).alias("near_next"))


def op8_fingerprints(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))
