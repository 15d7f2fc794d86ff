"""Exact dedup: tree-merge of sorted digest runs.

Rows are dealt to slots by a hash of their id; each slot makes one run of (digest, smallest id,
rows). Runs are then exchanged in rounds: a slot is a number of `rounds` digits in base `FAN`, and
in round r an entry moves to the slot whose r-th digit is the r-th digit of its digest. Each slot
brings the `FAN` runs it receives into one order and reads them through once: the first entry of a
digest has its smallest id and takes the rows of the few others. After the last round every digest has one owner, no slot ever held more than its share,
and a text that a third of all rows repeat is one entry per run from the first level on.
The answers go back the same way: first to the runs, then to the rows of each run."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.tables import Staged, content_order, documents, unused

FAN = 4
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _digit(value: Column, r: int) -> Column:
    return F.pmod(F.shiftright(value, 2 * r), F.lit(FAN))


def tree_merge(runs: DataFrame, rounds: int) -> DataFrame:
    """Runs (slot, head, digest, doc_id, rows) to one entry per digest.

    `head` is 64 bits of the digest: it orders and routes; the whole digest verifies, so two
    texts with equal heads stay apart. The smallest id wins at every level; a null id only if
    there is no other. A digest has at most `FAN` entries in a slot, one of each run, so the
    window over them is never large; shuffles keep no order, so each round sorts what it received."""
    entries = Window.partitionBy("slot", "head", "digest")
    place = F.row_number().over(entries.orderBy(F.col("doc_id").asc_nulls_last()))
    for r in range(rounds):
        slot = F.col("slot") + (_digit(F.col("head"), r) - _digit(F.col("slot"), r)) * (FAN ** r)
        received = runs.withColumn("slot", slot).repartition(FAN ** rounds, "slot")
        runs = (received.withColumn("place", place).withColumn("rows", F.sum("rows").over(entries))
                .filter("place = 1").drop("place"))
    return runs


def exact_groups(docs: DataFrame, tables: Staged) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept.

    Null texts count as empty. Rows that repeat a doc_id and its text are one group's members
    each; one of them is kept. Null ids are kept only where a group has no other id (one of them).
    Other columns, of whatever names, are not looked at."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(parts, 2), FAN)))
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    # the slot must not follow the digest, and must differ between copies: a hash of the id
    rows = tables.write(docs.select("doc_id", sha.alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(FAN ** rounds)).alias("slot"))
                        .groupBy("slot", "digest", "doc_id").agg(F.count("*").alias("rows")), "digests")
    head = F.xxhash64("digest")
    runs = rows.groupBy("slot", "digest").agg(F.min("doc_id").alias("doc_id"), F.sum("rows").alias("rows"))
    owners = tree_merge(runs.select("slot", head.alias("head"), "digest", "doc_id", "rows"), rounds).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
    answers = runs.select("slot", "digest").join(owners, "digest")
    copies = rows.join(answers, ["slot", "digest"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return copies.select("doc_id", "digest", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns: of equal texts the smallest doc_id, once."""
    tables = Staged(docs.sparkSession)
    doc, digest, own, copy = (unused(docs, n) for n in ("_id", "_digest", "_own", "_copy"))
    kept = exact_groups(docs, tables).filter("kept").select(F.col("doc_id").alias(doc), F.col("digest").alias(digest))
    rows = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(digest)))
    order = Window.partitionBy(doc, digest).orderBy(*content_order(docs))
    return stay.withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).drop(doc, digest, own, copy)


def op6_exact_dedup(spark, sf_dir):
    groups = exact_groups(documents(spark, sf_dir), Staged(spark))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
