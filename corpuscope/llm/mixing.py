"""Mixing sources to target weights: fixed blocks, drawn counts, index permutations.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of
`BLOCK` words. Every output shard draws how many of its slots go to each source; the draws are
multinomial counts conditioned on the totals: all slots of all sources, each source's number
fixed by its target, are dealt to the shards by one pseudorandom permutation, and the table of
counts (shard, source) is what the mix is made from. A source's total is so within one block of its
target. A source's slots are numbered through the shards; slot q takes block perm(q mod blocks) with
a permutation of the source's and round's own, and joins it by index."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.tables import Staged, documents, unused

BLOCK = 32
SHARE = 1.5
LIMIT = 2.0
WEIGHTS = (3, 1, 2)
# Slots of one output shard, and slots that one row stands for before they are spread.
SHARD = 4096
# Parts of each source's order; a running sum never crosses one.
BUCKETS = 1024
ROUNDS = 4
SEED = 20240229
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"


def sized(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source, size and `others`: the number of words; 0 for null or empty texts."""
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    words = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1))
    return docs.select(*others, "doc_id", "source", F.when(text == "", 0).otherwise(words).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: one row per source.

    Shares by weight, each at most `limit` times its source, the excess dealt anew by weight. The
    fixed point has one factor f with target = min(limit * size, f * weight); sources fill up in
    the order of limit * size / weight, so f follows from running sums in that order."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row per source, the only tables here that one task holds
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(limit) / F.col("weight"))
    filling = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    rest = wanted - F.coalesce(F.sum(F.col("source_size") * F.lit(limit)).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    factor = ranked.withColumn("factor", F.try_divide(rest, weight_left))
    # the first source in filling order that is not full sets the factor of all that follow
    open_factor = F.min(F.when(F.col("factor") < F.col("full"), F.struct("full", "factor"))).over(everything)["factor"]
    target = F.when(open_factor.isNull(), F.col("source_size") * F.lit(limit)).otherwise(
        F.least(F.col("source_size") * F.lit(limit), open_factor * F.col("weight")))
    return factor.select("source", "source_size", target.cast("double").alias("target"), F.row_number().over(order).alias("number"))


def permuted(index: Column, size: Column, seed: Column) -> Column:
    """A bijection on 0 .. size - 1 that `seed` chooses. In each round the values below the largest
    power of two that fits are mixed by odd multiplication and a shift (both reversible), then all
    are rotated by half the size."""
    bits = F.floor(F.log2(size.cast("double") + 0.5)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    half = F.greatest(F.lit(1), F.floor((bits + 1) / 2).cast("int"))

    def turn(x, r):
        odd = F.pmod(F.xxhash64(seed, r), F.lit(1 << 20)).bitwiseOR(F.lit(1))
        shift = F.pmod(F.xxhash64(seed, r + ROUNDS), low)
        folded = F.transform(F.array((x * odd).bitwiseAND(low - 1)), lambda m: m.bitwiseXOR(F.call_function("shiftright", m, half)))
        mixed = (folded[0] + shift).bitwiseAND(low - 1)
        return F.pmod(F.when(x < low, mixed).otherwise(x) + F.floor(size / 2).cast("long") + 1, size)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, turn)


def plan(sources: DataFrame) -> DataFrame:
    """The sources with n_blocks, n_slots and first_slot (the slots of all sources before it)."""
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    # in blocks of the source's own mean length, as its last block may be short
    slots = F.coalesce(F.round(F.try_divide(F.col("target") * F.col("n_blocks"), F.col("source_size"))), F.lit(0.0)).cast("long")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (sources.withColumn("n_blocks", blocks).withColumn("n_slots", slots)
            .withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))
            .withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy())))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that each stand for many are dealt to all tasks before they are written out."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shard_counts(planned: DataFrame, shard_slots: int = SHARD) -> DataFrame:
    """shard, number, drawn: how many slots of an output shard go to each source that has any there.

    Every slot of every source is dealt to a place of the output by one permutation, so a shard's
    counts are a multinomial draw given all totals, and each shard but the last has `shard_slots`."""
    parts = (planned.filter("n_slots > 0")
             .select("number", "n_slots", "first_slot", "all_slots",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(shard_slots).cast("long"))).alias("from")))
    dealt = _spread(parts, "number", "from").select("number", "all_slots", F.explode(F.sequence(
        F.col("first_slot") + F.col("from"), F.col("first_slot") + F.least(F.col("from") + shard_slots, F.col("n_slots")) - 1)).alias("slot"))
    place = permuted(F.col("slot"), F.col("all_slots"), F.lit(SEED).cast("long"))
    return (dealt.select("number", F.floor(place / shard_slots).cast("long").alias("shard"))
            .groupBy("shard", "number").agg(F.count("*").alias("drawn")))


def counted_on(counts: DataFrame) -> DataFrame:
    """`counts` with first: the slots of the source in all shards before. Sums within ranges of shards and over the
    ranges, as a source may be in more shards than one task should order."""
    reach = F.floor(F.col("shard") / BUCKETS).alias("reach")
    ranges = counts.groupBy("number", reach).agg(F.sum("drawn").alias("in_reach"))
    before = lambda *keys: Window.partitionBy("number", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("number", "reach", F.coalesce(F.sum("in_reach").over(before("reach")), F.lit(0)).alias("start"))
    within = counts.withColumn("reach", reach).withColumn("within", F.coalesce(F.sum("drawn").over(before("reach", "shard")), F.lit(0)))
    return within.join(starts, ["number", "reach"]).withColumn("first", F.col("start") + F.col("within")).drop("reach", "start", "within")


def slots(planned: DataFrame, counts: DataFrame) -> DataFrame:
    """The mix: one row per slot with shard, number (of the source), and block, from the sources and the counts per shard.

    A source's slots are numbered through the shards; slot q has the block that the permutation of its round gives."""
    known = planned.select(F.col("number").alias("_number"), "n_blocks")
    rows = _spread(counted_on(counts), "shard", "number").join(known, F.col("number") == F.col("_number"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)))
    turn, within = F.floor(F.try_divide("q", "n_blocks")).cast("long"), F.pmod(F.col("q"), F.col("n_blocks"))
    block = permuted(within, F.col("n_blocks"), F.xxhash64(F.lit(SEED), "number", turn))
    return rows.select("shard", "number", block.alias("block"))


def laid_out(sizes: DataFrame, sources: DataFrame, *ties: str) -> DataFrame:
    """`sizes` with number and start: the words of its source before the document. `ties` order equal rows."""
    known = sources.select(F.col("source").alias("_source"), "number", "source_size", "target")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    within = (Window.partitionBy("number", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (placed.join(sums, ["number", "bucket"])
            .withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket", "bucket_start", "before"))


def drawn(placed: DataFrame, planned: DataFrame, counts: DataFrame) -> DataFrame:
    """`placed`, a row for each block that holds words of the document: block, offset (the document's words
    before them), share (their number) and times (the slots of the block)."""
    times = slots(planned, counts).groupBy("number", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("long"), F.floor((end - 1) / BLOCK).cast("long"))))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    pieces = pieces.withColumn("offset", begin - F.col("start")).withColumn("share", F.least(end, (F.col("block") + 1) * BLOCK) - begin)
    # the planner takes `times` for as small as the sources it is made from: it must not be broadcast
    return pieces.join(times.hint("merge"), ["number", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mixed(docs: DataFrame, tables: Staged) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken.

    `taken` counts the words of the document in all slots, repeats included: at most LIMIT times its
    size. Null or empty texts have size 0 and are never taken; null sources are one source, the
    last. Rows that repeat a doc_id stand one after the other. Other columns are not looked at."""
    sizes = tables.write(sized(docs), "sizes")
    planned = tables.write(plan(targets(sizes)), "sources")
    counts = tables.write(shard_counts(planned), "shards")
    placed = laid_out(sizes, planned)
    keys = ["doc_id", "source", "size", "source_size", "target", "number", "start", "draw"]
    taken = drawn(placed, planned, counts).groupBy(*keys).agg(F.sum(F.col("share") * F.col("times")).cast("long").alias("taken"))
    empty = placed.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).drop("number", "start")


def drawn_texts(text: Column, pieces: Column) -> Column:
    """The texts of a document's first, second, ... round: the words that at least so many slots take.

    `pieces` are the blocks' parts of the document (offset, share, times) by offset. Words keep the white space that
    follows them; where words are left out, a line ends. A round that takes every word is the text itself."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    end = lambda p: p["offset"] + p["share"]

    def of_round(words, pieces, number):
        taken = F.filter(pieces, lambda p: p["times"] >= number)

        def joined(taken):
            def part(p, i):
                here = F.array_join(F.slice(words, (p["offset"] + 1).cast("int"), p["share"].cast("int")), "")
                goes_on = F.coalesce(F.get(taken, i + 1)["offset"] == end(p), F.lit(False))
                return F.when(goes_on, here).otherwise(F.concat(F.rtrim(here, F.lit(WHITE)), F.when(i + 1 < F.size(taken), "\n").otherwise("")))

            size = F.aggregate(taken, F.lit(0).cast("long"), lambda s, p: s + p["share"])
            return F.when(size == F.size(words), text).otherwise(F.array_join(F.transform(taken, part), ""))

        return F.transform(F.array(taken), joined)[0]

    rounds = F.sequence(F.lit(1), F.array_max(F.transform(pieces, lambda p: p["times"])).cast("int"))
    # the words are cut once, as the argument of what follows
    return F.transform(F.array(words), lambda w: F.transform(rounds, lambda number: of_round(w, pieces, number)))[0]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` in the mix: the words of all slots, as documents with the columns of `docs`.

    A row stands for each round of a document, LIMIT at most: row r has the words that at least r
    slots take, in the document's order; where words between them are left out, a line ends. So each
    source has its target within a block or two of words, whatever the sizes of its documents. A column n_chars is
    counted anew; other columns are the document's. Rows without drawn words are not in the mix."""
    tables = Staged(docs.sparkSession)
    row, pieces = unused(docs, "_row"), unused(docs, "_pieces")
    # rows may repeat an id: each gets a number that stays
    kept = tables.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    sizes = tables.write(sized(kept, row), "sizes")
    planned = tables.write(plan(targets(sizes)), "sources")
    counts = tables.write(shard_counts(planned), "shards")
    lists = (drawn(laid_out(sizes, planned, row), planned, counts).filter("times > 0")
             .groupBy(row).agg(F.array_sort(F.collect_list(F.struct("offset", "share", "times"))).alias(pieces)))
    out = kept.join(lists, row).withColumn("text", F.explode(drawn_texts(F.col("text"), F.col(pieces))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir), Staged(spark)).select("doc_id", "size", "source_size", "target", "taken")
