"""Logs in chunks against whole logs."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import log_chunks, logs
from corpuscope.sources.texts import read_log_chunks, read_logs

H = "Traceback (most recent call last):"
LINES = ["", "", "", " ", "   ", "\t", H, H, f"  {H} rest", f"{H} x {H}", f'{H}  File "h.py", line 3, in g', '  File "a.py", line 12, in f', '  File "b.py"',
         '  File "c.py, no quote', 'x", line 7, late', ", line 9", 'ValueError: bad: 5', "KeyError", "error: x", "src/a.c:3:4: error: bad", "a.c:1:2: note: n", " b.c:1:2: warning: w",
         "12:3:4: x: y", "$ make all", "ok", "é🙂: ü", "a:b:c:d:e:f"]


def cut(text, size):
    """Chunks of whole lines of about `size` characters."""
    out, held = [], None
    for line in text.split("\n"):
        held = line if held is None else held + "\n" + line
        if len(held) >= size:
            out.append(held)
            held = None
    return out + ([held] if held is not None else [])


def compared(spark, texts, size):
    whole = [(f"l{i}" if i % 3 else None, "s" if i % 2 else None, 100 + i, None, t) for i, t in enumerate(texts)]
    logs_ = spark.createDataFrame(whole, "log_id string, sid string, timestamp long, cwd string, output string")
    chunks = spark.createDataFrame([(*row[:4], 10 * k, part) for row in whole for k, part in enumerate(cut(row[4], size))], log_chunks.CHUNKS).repartition(5)
    (sessions, errors), (want_sessions, want_errors) = log_chunks.parse_log_chunks(chunks), logs.parse_logs(logs_)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(sessions) == rows(want_sessions.withColumn("output", F.lit(None).cast("string")))
    got, want = rows(errors), rows(want_errors)
    assert got == want
    return want


@pytest.mark.parametrize("size", [1, 64, 10_000])
def test_chunks_give_the_rows_of_whole_logs(spark, size):
    rng = random.Random(size)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += [H, f"{H}\n", f"{H}\n\n", f"\n\n{H}\n  \n \n\nx", f'{H}\n  File "q\nr", \n, line 5\nE: m', "", "\n", " \n", "$~/ make\nerror:"]
    found = compared(spark, texts, size)
    assert {r[2] for r in found} > {"compile_error", "generic_error", "ValueError"}


def test_a_traceback_over_many_chunks(spark):
    """One paragraph of 3,000 lines: its header, its last frame and its last line stand in different chunks."""
    middle = "\n".join(f'  File "m{i}.py", line {i}, in f' for i in range(3000))
    found = compared(spark, [f"run\n{H}\n{middle}\nOSError: the end\n\n{H}\nB: c"], 64)
    assert [r[3] for r in sorted(found, key=lambda r: r[-1])] == ["m2999.py", None]


def test_a_hot_log_spreads_over_tasks(spark):
    chunks = spark.range(8000).repartition(4).select(
        F.lit("one").alias("log_id"), F.lit("s").alias("sid"), F.lit(1).cast("long").alias("timestamp"), F.lit(None).cast("string").alias("cwd"),
        F.col("id").alias("chunk_no"), F.concat(F.lit("f.c:1:2: error: e"), "id").alias("text"))
    sessions, errors = log_chunks.parse_log_chunks(chunks)
    assert sessions.count() == 1 and errors.count() == 8000
    assert errors.agg(F.max("ordinal")).first()[0] == 7999
    plan = log_chunks._placed(chunks)._jdf.queryExecution().optimizedPlan().toString()
    # chunks meet their sums by log and number, not by log alone
    assert "chunk_no" in plan.split("Join Inner")[1].split("\n")[0]


def test_reading_chunks_of_files(spark, tmp_path):
    rng = random.Random(4)
    for i in range(3):
        lines = [rng.choice(LINES) for _ in range(4000)] + ["last"]
        (tmp_path / f"l{i}.log").write_text("\n".join(["$ make " + str(i), *lines]) + ("\n" if i else ""))
    (tmp_path / "crlf.log").write_bytes(b"a\r\nb.c:1:2: error: x\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        chunks = read_log_chunks(spark, str(tmp_path), now=7, sid="s", chunk_chars=500)
        rows = chunks.orderBy("log_id", "chunk_no").collect()
        assert len({r["chunk_no"] for r in rows if r["log_id"].endswith("l1.log")}) > 20
        for i in range(3):
            text = "\n".join(r["text"] for r in rows if r["log_id"].endswith(f"l{i}.log"))
            assert text == (tmp_path / f"l{i}.log").read_text().removesuffix("\n")
        _, errors = log_chunks.parse_log_chunks(chunks)
        _, want = logs.parse_logs(read_logs(spark, str(tmp_path), now=7, sid="s"))
        plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert plain(errors) == plain(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_chunks(spark):
    sessions, errors = log_chunks.parse_log_chunks(spark.createDataFrame([], log_chunks.CHUNKS))
    assert sessions.collect() == [] and errors.collect() == []
