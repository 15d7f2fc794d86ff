"""Documents, staged tables and fixed-size bitmaps."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.session import passing_shuffles, scratch_path

# Bits of a bitmap that lets a scan skip rows early. The size is fixed: on a large corpus it
# fills up and skips fewer rows; what it lets through is joined exactly afterwards.
BITMAP_BITS = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with as many underscores before it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def content_order(df: DataFrame) -> list[Column]:
    """An order of rows by what they hold, for choosing one of several (maps have no hash and are passed over)."""
    return [F.xxhash64(df[f"`{f.name}`"]) for f in df.schema if "map<" not in f.dataType.simpleString()]


class Staged:
    """Tables of one operator in the shared folder; those no longer needed can be dropped.

    Once a table is written, the shuffle files of its making are gone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        with passing_shuffles(self.spark):
            df.write.options(**options).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def write_sorted(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """`df` in buckets by `keys`, each sorted by them: joins of two such tables by `keys` need no exchange.

        Only tables of the catalog know their buckets; the entry is taken out again, the files stay."""
        path = scratch_path(self.spark, name)
        table = path.rsplit("/", 1)[-1].replace("-", "_")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with passing_shuffles(self.spark):
            df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        self.paths[name] = path
        rows = self.spark.table(table)
        self.spark.sql(f"drop table {table}")
        return rows

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key() -> Column:
    """Identity of a row: rows with equal doc_id and text share it and have equal results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _bit(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def bitmap_of(rows: DataFrame, value: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """(word, mask) of a bitmap that holds a hash of `value` of every row: at most bits / 64 rows."""
    bit = _bit(value, bits)
    return (rows.select((F.shiftright(bit, 6)).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))


def marked(rows: DataFrame, value: Column, bitmap: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """`rows` with a column `marked`: false where `value` is certainly not in the bitmap.

    The bitmap is broadcast: it has at most bits / 64 rows of two numbers."""
    bit = _bit(value, bits)
    return (rows.withColumn("word", F.shiftright(bit, 6)).withColumn("bit", bit.bitwiseAND(F.lit(63)).cast("int"))
            .join(F.broadcast(bitmap), "word", "left")
            .withColumn("marked", F.coalesce(F.expr("(shiftright(mask, bit) & 1L) = 1L"), F.lit(False)))
            .drop("word", "bit", "mask"))


def long_column(values) -> pa.Array:
    """A numpy array of 64-bit hashes as an Arrow column of signed longs."""
    return pa.array(values.view("int64"))


def sorted_groups(batches, *keys):
    """Groups of consecutive rows with equal keys, from Arrow batches of a partition sorted by them."""
    held, last = [], None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for row in zip(*columns.values()):
            row = dict(zip(columns, row))
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held
