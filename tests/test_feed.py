"""State of the change feed: batches run again, whole states, and how much is written."""

import os

from pyspark.sql import functions as F

from corpuscope.streaming import watch as W


def test_what_is_written_follows_the_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "DELTAS", 3)
    state, seen = str(tmp_path / "state"), {}
    step = W.compare_batch(state, lambda found, n: seen.__setitem__(n, sorted((r.file_path, r.mtime, r.previous_mtime) for r in found.collect())), emit_new=True)
    times = {f"/f{i}": 1 for i in range(50)}
    rows = lambda n: spark.createDataFrame([(n, p, t) for p, t in times.items()], W.SCANS)
    stored = lambda name: spark.read.parquet(f"{state}/{name}").count()
    step(rows(0), 0)
    assert seen[0] == [] and stored("0") == 50
    for n in range(1, 9):
        times[f"/f{n}"] = n + 10
        times[f"/new{n}"] = n
        step(rows(n), n)
        want = sorted([(f"/f{n}", n + 10, 1), (f"/new{n}", n, None)], key=lambda x: x[0])
        assert seen[n] == want
        # a batch that is run again shows the same, also after its own state was written
        step(rows(n), n)
        assert seen[n] == want
    names = sorted(os.listdir(state))
    assert any(n.endswith("-whole") for n in names) and len(names) <= 6
    assert all(stored(n) <= 2 for n in names if not n.endswith("-whole"))
    step(rows(9), 9)
    assert seen[9] == [] and stored("9" if "9" in os.listdir(state) else "9-whole") in (0, 58)
