"""Positions in a group, and running sums, without a group in one task."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.session import staged


def _name(rows: DataFrame, name: str) -> str:
    """`name`, or with underscores before it, so that no column of `rows` has it."""
    while name in rows.columns:
        name = "_" + name
    return name


def numbered(rows: DataFrame, group: list[str], order: list, name: str, total: str | None = None) -> DataFrame:
    """`rows` with `name`: 1, 2, ... in each group by `order`; with `total`, also the number of rows of the group.

    Rows are dealt to ranges of (group, order), so that a group of any size spreads over as many tasks as
    it fills. In a range a row's place is its number; how many rows of the group stand in earlier ranges
    is a sum over one row per range and group. Groups that are null are one group. Rows that are equal in group
    and order go to one range: an order with a unique column splits every group. The ranged rows are
    written once, as bounds are sampled and must not be drawn anew."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, part, first, n, before = (_name(rows, c) for c in ("_place", "_part", "_first", "_n", "_before"))
    ranged = rows.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    # the number of the range in the upper bits, the place in the range in the lower 33
    kept = staged(ranged.withColumn(place, F.monotonically_increasing_id()), "ranged")
    in_range = F.shiftright(place, 33)
    # a row per range and group: a task gathers its own first, and few groups reach over several ranges
    pieces = kept.groupBy(in_range.alias(part), *group).agg(F.min(place).alias(first), F.count("*").alias(n))
    pieces = staged(pieces, "ranges")
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("long")))
    if total:
        pieces = pieces.withColumn(total, F.sum(n).over(Window.partitionBy(*group)))
    own = {g: _name(rows, f"_of_{g}") for g in group}
    pieces = pieces.withColumnsRenamed(own).withColumnRenamed(part, _name(rows, "_range"))
    at = F.col(_name(rows, "_range")) == in_range
    for g, other in own.items():
        at = at & F.col(g).eqNullSafe(F.col(other))
    numbered_rows = kept.join(pieces, at).withColumn(name, (F.col(place) - F.col(first) + F.col(before) + 1).cast("long"))
    return numbered_rows.select(*rows.columns, name, *([total] if total else []))
