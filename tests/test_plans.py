"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import ledger, logs, packages, patterns, search, snapshots
from corpuscope.plans import fixtures
from corpuscope.sources.texts import default_rules
from corpuscope.sources.workspace import Workspace

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Files and logs as tables on disk, so that a plan holds only the operator's own steps."""
    root = str(tmp_path_factory.mktemp("stored"))
    for name in ("files", "logs"):
        getattr(fixtures, name)(spark, SF).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("files", "logs")}


def test_per_row_operators_do_not_shuffle(spark, stored):
    sessions = logs.log_sessions(stored["logs"])
    for df in (snapshots.snapshot_files(stored["files"]), search.build_postings(stored["files"]), sessions,
               logs.session_errors(sessions), logs.parse_tracebacks(sessions), logs.generic_failures(sessions)):
        assert "Exchange" not in plan(df)
    matched = plan(patterns.extract_patterns(stored["files"], default_rules(spark), 1))
    assert "BroadcastHashJoin" in matched and "NestedLoop" not in matched and matched.count("regexp_extract_all") == 1


def test_embedding_runs_once_and_only_when_asked(spark, stored):
    snaps = snapshots.snapshot_files(stored["files"])
    assert "ArrowEvalPython" not in plan(snapshots.language_counts(snaps))
    ranked = plan(search.similar_files_by_vector(snaps, fixtures.passages(spark, SF)))
    assert ranked.count("ArrowEvalPython [") == 1 and "WindowGroupLimit" in ranked and "Cartesian" not in ranked


def test_limits_apply_before_the_shuffle(spark, stored):
    decisions = ledger.merge_decisions(ledger.human_decisions(fixtures.decisions(spark, SF)))
    for df in (packages.package_assumptions(decisions, snapshots.snapshot_files(stored["files"]), limit=5),
               packages.recent_distinct_errors(logs.session_errors(logs.log_sessions(stored["logs"])), limit=5)):
        assert "Partial" in plan(df) and "Final" in plan(df)
    assert "partial_max(struct" in plan(decisions)


def test_filters_and_columns_reach_the_files(spark, stored, tmp_path):
    ws = Workspace(spark, str(tmp_path), buckets=2)
    ws.index(snapshots.source_files(stored["files"], "/src"), default_rules(spark), 1)
    read = plan(ws.read("snapshots", "en").select("file_path"))
    assert "EqualTo(sid,en)" in read and "embedding" not in read.split("ReadSchema")[1]
    assert "In(token, [cursor,the])" in plan(search.match_all(ws.read("postings"), "the", "cursor"))
    assert ws.read("snapshots", "en").where(F.col("embedding").isNull()).count() == 0


def test_string_query_ids(spark, stored):
    queries = spark.createDataFrame([("q1", "the of"), ("q2", "la de")], "query_id string, query_text string")
    snaps = snapshots.snapshot_files(stored["files"])
    broadcast = search.similar_files_by_vector(snaps, queries).collect()
    blocks = search.similar_files_by_vector(snaps, queries, max_broadcast=1).collect()
    assert {r.query_id for r in broadcast} == {"q1", "q2"} and sorted(broadcast) == sorted(blocks)
