"""Distributed numbering against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import packages
from corpuscope.operators.numbering import numbered


def want(rows, down=False):
    groups = defaultdict(list)
    for sid, x, tie in rows:
        groups[sid].append((x, tie))
    order = lambda v: ((-1, 0) if v[0] is None else (0, v[0])) + (v[1],)
    out = {}
    for sid, values in groups.items():
        values.sort(key=order) if not down else values.sort(key=lambda v: ((1, 0) if v[0] is None else (0, -v[0])) + (v[1],))
        out.update({(sid, *v): (i + 1, len(values)) for i, v in enumerate(values)})
    return out


@pytest.mark.parametrize("down", [False, True])
def test_positions(spark, down):
    rng = random.Random(1)
    # one session has more than a third of all rows
    sid = lambda i: "hot" if i % 5 < 2 else None if i % 5 == 2 else f"s{rng.randrange(40)}"
    rows = [(sid(i), None if i % 13 == 0 else rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "sid string, x int, tie long").repartition(7)
    order = [F.desc("x") if down else F.asc("x"), "tie"]
    got = numbered(df, ["sid"], order, "position", "total").collect()
    assert {(r["sid"], r["x"], r["tie"]): (r["position"], r["total"]) for r in got} == want(rows, down)
    everything = numbered(df, [], ["tie"], "n").collect()
    assert [r["n"] for r in sorted(everything, key=lambda r: r["tie"])] == list(range(1, 3001))


def test_no_rows_and_taken_names(spark):
    empty = spark.createDataFrame([], "sid string, _place int, _part int, _first int")
    assert numbered(empty, ["sid"], ["_place"], "position").collect() == []
    one = spark.createDataFrame([("a", 5, 6, 7)], empty.schema)
    assert [tuple(r) for r in numbered(one, ["sid"], ["_place"], "position").collect()] == [("a", 5, 6, 7, 1)]


def test_a_hot_session_spreads_over_tasks(spark):
    """A third of all rows in one session: no task holds it, and no window has a session to itself."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sid"),
                                      F.col("id").alias("timestamp"), F.lit("k").alias("key"), F.lit("v").alias("value"),
                                      F.lit("r").alias("rationale"), F.col("id").cast("string").alias("node_id"))
    files = spark.createDataFrame([], "sid string, file_path string, content_hash string, lines_of_code long, language string")
    found = packages.package_assumptions(rows, files)
    text = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "row_number" not in text
    hot = found.where("sid = 'hot'").select("position", "name", F.spark_partition_id().alias("task"))
    assert hot.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first() == (1, 10_000, 10_000)
    ranged = rows.repartitionByRange(4, "sid", F.col("timestamp")).where("sid = 'hot'")
    assert ranged.select(F.spark_partition_id().alias("p")).distinct().count() >= 2
