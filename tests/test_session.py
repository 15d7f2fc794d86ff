"""The shared folder and staged tables."""

import os

import pytest
from pyspark.sql import functions as F

from corpuscope import session
from corpuscope.llm.tables import Staged


class Stub:
    """A session as far as `shared_dir` looks at it."""

    def __init__(self, configured, master, checkpoint=None):
        self.conf = self.sparkContext = self
        self.configured, self.master, self.checkpoint, self.applicationId = configured, master, checkpoint, "app"

    def get(self, key, default=None):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.checkpoint


def test_shared_dir():
    assert session.shared_dir(Stub("/shared/", "yarn")) == "/shared"
    assert session.shared_dir(Stub(None, "yarn", "hdfs://n/c")) == "hdfs://n/c"
    local = session.shared_dir(Stub(None, "local[2]"))
    assert os.path.isdir(local) and session.shared_dir(Stub(None, "local[2]")) == local
    with pytest.raises(ValueError):
        session.shared_dir(Stub(None, "spark://host:7077"))


def test_staged_and_cleared(spark):
    df = session.staged(spark.range(10).selectExpr("id", "array(id) a"), "numbers")
    assert df.count() == 10 and df.inputFiles()[0].find(spark.sparkContext.applicationId) > 0
    session.clear_scratch(spark)
    assert not os.path.exists(session._scratch_root(spark).removeprefix("file:"))


def test_a_staged_table_leaves_no_shuffle_files(spark):
    def shuffle_files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.size()))

    setting_name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffle_files(), spark.conf.get(setting_name)
    stored, sorted_ = Staged(spark).write(rows, "sevenths"), Staged(spark).write_sorted(rows, "sorted-sevenths", "k")
    assert shuffle_files() <= before and spark.conf.get(setting_name) == setting
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, sorted_.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception):
        Staged(spark).write(spark.range(1).select(F.raise_error(F.lit("no"))), "none")
    assert spark.conf.get(setting_name) == setting


def test_rows_if_at_most(spark):
    assert len(session.rows_if_at_most(spark.range(5), 5)) == 5
    assert session.rows_if_at_most(spark.range(6), 5) is None


def test_read_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    assert session.read_spread(spark, str(tmp_path / "one")).rdd.getNumPartitions() == 4
    assert "Exchange" not in session.read_spread(spark, str(tmp_path / "many"))._jdf.queryExecution().executedPlan().toString()
