"""Published versions of workspace tables: failed and competing writes."""

import os

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import reports
from corpuscope.sources.texts import default_rules
from corpuscope.sources.workspace import Workspace

LOGGED = "sid string, key string, value string, rationale string, timestamp long"


def logged(spark, names, value="v", at=1):
    return spark.createDataFrame([("s", k, value, "r", at) for k in names], LOGGED)


def stored(ws):
    return sorted((r["key"], r["value"], r["timestamp"]) for r in ws.read("decisions").collect())


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    ws = Workspace(spark, str(tmp_path / "ws"), buckets=4)
    ws.log(logged(spark, "abcdefgh"))
    before = stored(ws)

    @F.udf("string")
    def broken(key):
        if key == "q":
            raise ValueError("lost")
        return key

    # some tasks have written their files when another fails
    rewrite = Workspace._rewrite
    monkeypatch.setattr(Workspace, "_rewrite", lambda self, name, rows, touched: rewrite(self, name, rows.withColumn("key", broken("key")), touched))
    with pytest.raises(Exception, match="lost"):
        ws.log(logged(spark, "abcpqr", at=9))
    monkeypatch.undo()
    assert stored(ws) == before
    # or everything was written but not published
    monkeypatch.setattr(Workspace, "_publish", lambda self, *args: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        ws.log(logged(spark, "abcpqr", at=9))
    monkeypatch.undo()
    assert "version=2" in os.listdir(tmp_path / "ws" / "decisions")
    assert stored(ws) == before
    ws.log(logged(spark, "abcpqr", at=9))
    assert stored(ws) == sorted([(k, "v", 9) for k in "abcpqr"] + [(k, "v", 1) for k in "defgh"])


def test_of_two_writes_at_a_time_one_is_refused(spark, tmp_path, monkeypatch):
    ws, other = (Workspace(spark, str(tmp_path / "ws"), buckets=2) for _ in range(2))
    ws.log(logged(spark, "ab"))
    publish = Workspace._publish

    def late(self, name, number, buckets):
        monkeypatch.undo()
        other.log(logged(spark, "cd"))
        publish(self, name, number, buckets)

    monkeypatch.setattr(Workspace, "_publish", late)
    with pytest.raises(RuntimeError, match="meanwhile"):
        ws.log(logged(spark, "xy"))
    assert [k for k, *_ in stored(ws)] == ["a", "b", "c", "d"]


def test_only_touched_buckets_are_written_and_old_ones_can_be_removed(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"), buckets=8)
    ws.log(logged(spark, [f"k{i}" for i in range(60)]))
    _, first = ws._pointer("decisions")
    ws.log(logged(spark, ["k5"], at=7))
    _, second = ws._pointer("decisions")
    assert sum(first[b] != second[b] for b in second) == 1 and len(second) == 8
    opened = ws.read("decisions")
    want = stored(ws)
    assert ws.vacuum() == 1 and stored(ws) == want and opened.count() == 60
    assert ws.vacuum() == 0


def test_buckets_left_empty_vanish(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"), buckets=3)
    ws.parse(spark.createDataFrame([("s", "$ make\na.c:1:2: error: x\n", 5), ("t", "$ make\nb.c:1:2: error: y\n", 5)], "sid string, output string, timestamp long"))
    assert ws.clear_errors("s") == 1 and ws.clear_errors("t") == 1
    assert ws.read("errors").count() == 0 and ws._pointer("errors")[1] == {}


def test_chunked_logs_are_stored_alike(spark, tmp_path):
    from corpuscope.operators.log_chunks import CHUNKS

    text = "$ make\na.c:1:2: error: x\n\nTraceback (most recent call last):\nOSError: y"
    whole, parts = Workspace(spark, str(tmp_path / "a"), buckets=2), Workspace(spark, str(tmp_path / "b"), buckets=2)
    whole.parse(spark.createDataFrame([("s", text, 5)], "sid string, output string, timestamp long"))
    parts.parse_chunks(spark.createDataFrame([(None, "s", 5, None, i, line) for i, line in enumerate(text.split("\n"))], CHUNKS))
    for name in ("errors", "decisions"):
        rows = lambda ws: sorted((tuple(r) for r in ws.read(name).drop("embedding").collect()), key=repr)
        assert rows(whole) == rows(parts)


def recounted(ws):
    names = ["snapshots", "patterns", "decisions", "sessions", "errors", "packages"]
    tables = {n: ws.read(n) for n in names}
    return ({r["metric"]: r["n"] for r in reports.status(**tables).collect()},
            sorted(tuple(r) for r in reports.session_report(tables["snapshots"], tables["patterns"], tables["errors"], 7).collect()))


def kept(ws):
    return {r["metric"]: r["n"] for r in ws.status().collect()}, sorted(tuple(r) for r in ws.report(7).collect())


def test_kept_counts_equal_a_recount(spark, tmp_path):
    """After upsert, takeover by another session, files that lose their matches, deletion and a failed write."""
    ws, rules = Workspace(spark, str(tmp_path / "ws"), buckets=3), default_rules(spark)
    files = lambda rows: spark.createDataFrame([(s, f"/f{i}.c", 1, c) for s, i, c in rows], "sid string, file_path string, mtime long, content string")
    assert kept(ws) == recounted(ws)
    ws.index(files([("a" if i % 3 else "b", i, "int f(int a) {\nfetch(\n" * (i % 4)) for i in range(12)]), rules, 1)
    assert kept(ws) == recounted(ws)
    ws.index(files([("c", i, "int g(int b) {\n") for i in range(4)] + [("a", 7, "")]), rules, 2)
    ws.log(logged(spark, "abc"))
    ws.log(logged(spark, "bcd", at=5))
    logs = [(s, f"$ make {i}\na.c:{i}:2: error: x\n", i) for i, s in enumerate("aabbd")]
    for _ in range(2):
        ws.parse(spark.createDataFrame(logs, "sid string, output string, timestamp long"))
    assert kept(ws) == recounted(ws)
    ws.clear_errors("a")
    ws.resume(3)
    got = kept(ws)
    assert got == recounted(ws) and got[0]["errors"] == 3 and got[0]["snapshots"] == 12
    ws.vacuum()
    assert kept(ws) == got
