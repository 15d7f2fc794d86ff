"""Sources, keyed tables on disk and the change feed, on real folders."""

import glob
import os
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import packages
from corpuscope.sources import texts, tree
from corpuscope.sources.workspace import Workspace
from corpuscope.streaming.watch import folder_scans, reindex_batch, watch


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "src"
    for name, content in {
        "__init__.py": "def a(\n", "m.c": "int f(int a) {\n}\n", "sub/_x/deep.PY": "cursor.execute (\n", "notes.md": "no",
        ".hidden.py": "x", ".git/y.py": "y", "sub/.cache/z.py": "z", "sub/bin.c": b"\xff\xfe\x00bad\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    os.symlink(root, root / "sub" / "loop")
    os.symlink(tmp_path / "elsewhere", root / "dangling.c")
    (tmp_path / "linked").mkdir()
    (tmp_path / "linked" / "far.go").write_text("x\n")
    os.symlink(tmp_path / "linked", root / "link")
    return str(root)


def relative(rows, root):
    return sorted(os.path.relpath(r.file_path, root) for r in rows)


def test_tree_scan(spark, source):
    files = tree.read_tree(spark, source, "s")
    rows = files.collect()
    assert relative(rows, source) == ["__init__.py", "link/far.go", "m.c", "sub/_x/deep.PY", "sub/bin.c"]
    assert all(r.read_error is None and r.sid == "s" and abs(r.mtime - time.time()) < 1000 for r in rows)
    import hashlib
    hashed = files.where("file_path like '%bin.c'").select(F.sha2(F.col("content").cast("binary"), 256)).first()[0]
    assert hashed == hashlib.sha256(b"\xff\xfe\x00bad\n").hexdigest()
    assert tree.list_tree(spark, source, recursive=False).count() == 3
    assert tree.read_file(spark, f"{source}/notes.md").first().content == "no"
    with pytest.raises(FileNotFoundError):
        tree.read_file(spark, f"{source}/nope")


def test_large_files_are_reported(spark, source, monkeypatch):
    listing = tree.list_tree(spark, source).where("file_path like '%.c'").withColumn("size", F.lit(2 << 30))
    rows = tree.read_listed(listing).collect()
    assert len(rows) == 2 and all(r.content is None and "larger" in r.read_error for r in rows)


def test_folders_that_link_to_each_other(spark, tmp_path):
    for a, b in (("x", "y"), ("y", "x")):
        (tmp_path / "t" / a).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / a / f"{a}.c").write_text("int a;\n")
        (tmp_path / "t" / b).mkdir(parents=True, exist_ok=True)
        os.symlink(tmp_path / "t" / b, tmp_path / "t" / a / "other")
    assert tree.list_tree(spark, str(tmp_path / "t")).count() == 2


def test_bulk_logs_stay_apart(spark, tmp_path):
    from corpuscope.operators import logs

    (tmp_path / "logs").mkdir()
    for i in range(3):
        (tmp_path / "logs" / f"{i}.log").write_text(f"$ make all\na.c:{i + 1}:2: error: x\n")
        os.utime(tmp_path / "logs" / f"{i}.log", (1000, 1000))
    sessions, errors = logs.parse_logs(texts.read_logs(spark, str(tmp_path / "logs"), sid="s"))
    assert sessions.count() == 3 and errors.select("session_id").distinct().count() == 3
    assert {r.timestamp for r in sessions.collect()} == {1000} and {r.line_number for r in errors.collect()} == {1, 2, 3}


def test_sections_of_one_name_are_rules_of_their_own(spark):
    text = "[f]\nregex = a\nlanguage = c\n# [g]\n[f]\nregex = b\nlanguage = python\n"
    rules = texts.rules_from_texts(spark.createDataFrame([("x.template", text)], "file string, text string"))
    assert sorted((r.pattern_name, r.language, r.regex) for r in rules.collect()) == [("f", "c", "a"), ("f", "python", "b")]


def test_rules_and_logs_from_files(spark, tmp_path):
    texts.write_default_rules(str(tmp_path / "rules"))
    (tmp_path / "rules" / "other.txt").write_text("[x]\nregex=y\n")
    assert texts.read_rules(spark, str(tmp_path / "rules")).count() == 5
    (tmp_path / "log").write_text("$ make\na.c:1:2: error: x\n\nend")
    row = texts.read_logs(spark, str(tmp_path / "log"), 5).first()
    assert row.output == "$ make\na.c:1:2: error: x\n\nend" and row.cwd.endswith(str(tmp_path))


def test_workspace(spark, source, tmp_path):
    ws, rules = Workspace(spark, str(tmp_path / "ws"), buckets=4), texts.default_rules(spark)
    files = tree.read_tree(spark, source, "s")
    for _ in range(2):
        ws.index(files, rules, now=100)
    counts = lambda: {r.metric: r.n for r in ws.status().collect()}
    none = {"sessions": 0, "errors": 0, "packages": 0}
    assert counts() == {"snapshots": 5, "patterns": 3, "decisions": 2} | none
    # one file changes, and belongs to another session from then on
    ws.index(spark.createDataFrame([("t", f"{source}/m.c", 9, "int g(int b) {\nint h() {\n")], files.drop("read_error").schema), rules, 200)
    assert counts() == {"snapshots": 5, "patterns": 4, "decisions": 4} | none
    assert ws.read("snapshots", "t").first().file_path == f"{source}/m.c"
    assert {r.matched_text for r in ws.read("patterns", "t").collect()} == {"int g(int b) {", "int h() {"}
    assert ws.read("postings").where("token = 'f'").count() == 0

    # a file without matches any more leaves no old ones behind
    ws.index(spark.createDataFrame([("s", f"{source}/sub/_x/deep.PY", 9, "pass")], files.drop("read_error").schema), rules, 200)
    assert counts()["patterns"] == 3 and ws.read("patterns").where("file_path like '%deep.PY'").count() == 0

    logs = spark.createDataFrame([("s", "$ make\na.c:1:2: error: x\nb.c:3:4: note: y\n", 5)], "sid string, output string, timestamp long")
    for _ in range(2):
        ws.parse(logs)
    assert counts() | {"decisions": 6} == counts() and counts()["errors"] == 2 and counts()["sessions"] == 1
    ws.log(spark.createDataFrame([(None, "k", "v", None, 7)], "sid string, key string, value string, rationale string, timestamp long"))
    assert ws.read("decisions", "default").first().source == 0
    assert ws.read("decisions").where("size(embedding) = 128").count() == 7
    report = {r.sid: (r.files, r.functions, r.queries, r.errors) for r in ws.report(300).collect()}
    assert report == {"s": (4, 1, 0, 2), "t": (1, 2, 0, 0)}
    assert ws.read("reports").count() == 2

    ws.resume(400)
    texts.write_packages(ws.read("packages"), str(tmp_path / "packages"))
    parsed = packages.parse_package(texts.read_packages(spark, str(tmp_path / "packages"), "new", one_per_line=True))
    assert parsed.count() == 3 and parsed.where("problem is not null").count() == 0
    again = texts.read_packages(spark, str(tmp_path / "packages"), "new", one_per_line=True)
    refused = ws.import_packages(again.union(spark.createDataFrame([("new", "no package")], again.schema)), 500)
    assert [r.problem for r in refused.collect()] == ["no SID prefix"]
    asked = spark.createDataFrame([(1, "int", None)], "query_id long, query_text string, sid string")
    assert ws.search(asked).count() > 0
    # a file that cannot be read keeps its snapshot
    before = ws.read("snapshots").where(f"file_path = '{source}/m.c'").first()
    gone = spark.createDataFrame([("t", f"{source}/m.c", 10, None, "no such file")], files.schema)
    assert ws.index(gone, rules, 600) == 1 and ws.read("skipped").first().reason == "no such file"
    assert ws.read("snapshots").where(f"file_path = '{source}/m.c'").first() == before
    assert ws.read("decisions", "new").count() == 7 + 5
    assert (ws.clear_errors("t"), ws.clear_errors("s"), ws.clear_errors("s")) == (0, 2, 0)
    assert ws.read("errors").count() == 0


def test_watch_reindexes_changed_files(spark, source, tmp_path):
    ws, rules = Workspace(spark, str(tmp_path / "ws"), buckets=2), texts.default_rules(spark)
    seen = []

    def note(changes, batch_id):
        seen.extend((os.path.basename(r.file_path), r.previous_mtime is None) for r in changes.collect())
        reindex_batch(ws, rules, "w")(changes, batch_id)

    scans = folder_scans(spark, source)
    run = lambda: watch(scans, note, str(tmp_path / "state"), True, availableNow=True).awaitTermination()
    run()
    assert seen == []
    os.utime(f"{source}/m.c", (1, 1))
    run()
    assert seen == [("m.c", False)]
    open(f"{source}/new.py", "w").write("def new(\n")
    open(f"{source}/.new.py", "w").write("def new(\n")
    open(f"{source}/sub/below.py", "w").write("def new(\n")
    os.remove(f"{source}/__init__.py")
    run()
    assert seen == [("m.c", False), ("new.py", True)]
    assert {os.path.basename(r.file_path) for r in ws.read("snapshots").collect()} == {"m.c", "new.py"}
    changed = ws.read("decisions").where("action = 'file_changed'").collect()
    assert {(r.key, r.value, r.rationale) for r in changed} == {
        ("file.modified", "m.c", "File m.c changed (2 lines)"), ("file.modified", "new.py", "File new.py changed (1 lines)")}


def test_packages_lie_in_small_row_groups(spark, tmp_path):
    """A package may have megabytes: a task holds few at a time, however many it writes."""
    ws, rng = Workspace(spark, str(tmp_path / "ws"), buckets=1), random.Random(8)
    rows = [(f"s{k}", "note", rng.randbytes(600_000).hex(), None, k) for k in range(12)]
    ws.log(spark.createDataFrame(rows, "sid string, key string, value string, rationale string, timestamp long"))
    built = ws.resume(100)
    stored = ws.read("packages").select("sid", "package").collect()
    assert sorted(stored) == sorted(built.select("sid", "package").collect()) and len(stored) == 12
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "ws/packages/version=*/bucket=*/*.parquet"))]
    assert max(f.num_rows for f in files) > 2
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 2
