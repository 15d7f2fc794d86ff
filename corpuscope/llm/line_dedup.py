"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Documents come in batches, largest ids first. Each batch is sorted into a run of its own keys,
which is merge-anti-joined with the runs so far: a key that none of them holds is new, and the
batch's largest document becomes its keeper; a key that one holds has its keeper already, so its
entry has none and only adds to the count. The batch then adds its run. Runs of one level are merged
into one run of the next as soon as there are `FANOUT` of them, so a key is rewritten a logarithmic
number of times. Runs are stored in buckets by key, each bucket sorted, so runs meet without an
exchange."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.tables import Staged, documents

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def hashed(line: Column) -> Column:
    """128 bits of a line's key: stripped, A-Z lower-cased."""
    key = F.translate(stripped(line), UPPER, UPPER.lower())
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, doc_id, key), once per document and key; batches are ranges of ids, largest first."""
    bounds = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("b")).first()["b"]
    batch = sum((F.coalesce(F.col("doc_id") <= b, F.lit(True)).cast("int") for b in bounds or []), F.lit(0))
    lines = docs.select("doc_id", F.explode(lines_of(F.col("text"))).alias("line"))
    long = lines.filter(F.length(stripped(F.col("line"))) >= min_chars)
    return long.select(batch.alias("batch"), "doc_id", hashed(F.col("line")).alias("key")).distinct()


def _merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two runs as one. A key has its keeper in one run only, as the anti-join left it."""
    newer = newer.select("a", "b", F.col("n_docs").alias("more"), F.col("keeper").alias("own"))
    return older.join(newer.hint("merge"), ["a", "b"], "full").select(
        "a", "b", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.coalesce("own", "keeper").alias("keeper"))


def run_of(counts: DataFrame, held: list[DataFrame]) -> DataFrame:
    """The run of a batch from its `counts` (a, b, n_docs, keeper): no keeper where a run of `held` has the key."""
    new = counts.select("a", "b", "keeper")
    for run in held:
        new = new.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    return counts.drop("keeper").join(new.hint("merge"), ["a", "b"], "left") if held else counts


def line_runs(lines: DataFrame, tables: Staged, batches: int = BATCHES) -> DataFrame:
    """(key, n_docs, keeper) of all lines, from levelled runs. Batches share no document, so counts add up."""
    levels: list[list[DataFrame]] = [[]]
    for batch in range(batches):
        counts = tables.write_sorted(
            lines.filter(F.col("batch") == batch).groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b"))
            .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")), f"counts-{batch}", "a", "b")
        held = [run for level in levels for run in level]
        # the first batch's counts are its run
        levels[0].append(tables.write_sorted(run_of(counts, held), f"run-0-{batch}", "a", "b") if held else counts)
        for level in range(len(levels)):
            if len(levels[level]) < FANOUT:
                break
            merged = tables.write_sorted(reduce(_merged, levels[level]), f"run-{level + 1}-{batch}", "a", "b")
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(merged)
    # older runs are on higher levels
    runs = reduce(_merged, [run for level in reversed(levels) for run in level])
    return runs.select(F.struct("a", "b").alias("key"), "n_docs", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_lines, n_dropped, kept: the text without dropped lines.

    A key of at least `min_chars` code points in at least `min_documents` documents loses its lines
    except in the document of the largest id. Null and empty texts are one empty line. Rows that
    repeat a doc_id are one document for the counts and lose the same lines; null ids are one
    document, smaller than all others. Other columns are not looked at."""
    tables = Staged(docs.sparkSession)
    lines = tables.write(line_rows(docs, min_chars, BATCHES), "lines")
    frequent = tables.write(line_runs(lines, tables).filter(F.col("n_docs") >= min_documents).select("key", "keeper"), "frequent")
    drops = (lines.join(frequent, "key")
             .filter(F.coalesce(F.col("doc_id") < F.col("keeper"), F.col("keeper").isNotNull()))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("drops")))
    rows = docs.select("doc_id", "text").join(drops, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    stays = lambda line: (F.length(stripped(line)) < min_chars) | ~F.array_contains("drops", hashed(line))
    split = rows.select("doc_id", "drops", lines_of(F.col("text")).alias("lines"))
    kept = split.withColumn("kept", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                       F.array_join("kept", "\n").alias("kept"))


def op3_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
with l as (select doc_id, i, lines[i] as line,
    translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) r(i)),
k as (select key, max(doc_id) as keeper from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where keeper is not null and doc_id <> keeper) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where keeper is null or doc_id = keeper), '')) as kept_sha256
from l left join k using (key) group by doc_id
"""
