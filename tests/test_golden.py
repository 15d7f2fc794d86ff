"""Small inputs with results derived by reading the behaviour to match."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.functions.vectors import embed_text
from corpuscope.operators import ledger, logs, packages, patterns, snapshots
from corpuscope.sources.texts import default_rules, rules_from_texts

PATHS = {
    "a.c": "c", "a.h": "c", "a.H": "c", "A.C": "c", "a.cpp": "cpp", "a.cc": "cpp", "a.py": "python", "a.PY": "python",
    "a.js": "javascript", "a.ts": "typescript", "a.java": "java", "a.go": "go", "a.rs": "rust", "a.sh": "bash",
    "__init__.py": "python", "_x.py": "python", "a.md": None, "Makefile": None, "a.c.bak": None, "/a.d/Makefile": None,
    "": None, "a.": None,
}


def test_extension_and_language(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select(
        "p", text.is_source_file(F.col("p")), text.language(F.col("p"))).collect()
    for path, source, language in rows:
        assert source == (PATHS[path] is not None), path
        assert language == (PATHS[path] or "unknown"), path


def test_hidden_below_root_only(spark):
    paths = ["/r/.h/a/x.py", "/r/.h/a/.x.py", "/r/.h/a/.git/x.py", "/r/.h/a/_/x.py", "/r/.h/a/b.c/x.py"]
    files = spark.createDataFrame([("s", p, 0, "") for p in paths], "sid string, file_path string, mtime long, content string")
    kept = {r[0] for r in snapshots.source_files(files, "/r/.h/a").select("file_path").collect()}
    assert kept == {"/r/.h/a/_/x.py", "/r/.h/a/b.c/x.py", "/r/.h/a/x.py"}


@pytest.mark.parametrize("content, lines", [("", 0), ("x", 0), ("x\n", 1), ("x\ny", 1), ("é\n\n", 2)])
def test_line_count_and_hash(spark, content, lines):
    files = spark.createDataFrame([(None, "a.c", 5, content)], "sid string, file_path string, mtime long, content string")
    row = snapshots.snapshot_files(files).first()
    assert (row.lines_of_code, row.sid, row.last_modified) == (lines, "default", 5)
    assert row.content_hash == hashlib.sha256(content.encode()).hexdigest()


def test_embedding(spark):
    texts = ["", " .,;()[]{}", "abc", "abc abc", None, "Abc", "a_b", "a$b", "a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in rows.select("i", embed_text(F.col("t"))).orderBy("i").collect()]
    assert all(len(v) == 128 for v in got)
    assert set(got[0]) == set(got[1]) == set(got[4]) == {0.0}
    assert {i for i, w in enumerate(got[2]) if w} == {63, 106, 94, 35}
    assert {w for w in got[2] if w} == {0.5} and got[3] == got[2]
    assert got[5] != got[2]
    for at, token in ((6, "a_b"), (7, "a$b")):
        slots = {b % 128 for b in hashlib.sha256(token.encode()).digest()[3:16:4]}
        assert {i for i, w in enumerate(got[at]) if w} == slots


def errors_of(spark, output, parser):
    sessions = spark.createDataFrame([("i", "s", "make", output, 1, 5)],
                                     "session_id string, sid string, command string, output string, exit_code int, timestamp long")
    fields = ["error_type", "file_path", "line_number", "column_number", "message"]
    return [tuple(r) for r in parser(sessions).orderBy("ordinal").select(*fields).collect()]


@pytest.mark.parametrize("line, want", [
    ("main.c:5:3: error: x undeclared", ("compile_error", "main.c", 5, 3, "x undeclared")),
    ("main.c:9:1: warning: unused: y", ("compile_warning", "main.c", 9, 1, "unused: y")),
    ("main.c:9:1: note: here", ("compile_note", "main.c", 9, 1, "here")),
    ("f.c:1:2: fatal error: no.h: missing", ("compile_info", "f.c", 1, 2, "no.h: missing")),
    ("a b.c: 7x:-2:error:   m  ", ("compile_error", "a b.c", 7, -2, "m  ")),
    ("x:y:99999999999:e:", None),
    ("x:y:99999999999:e:m:", ("compile_info", "x", 0, 0, "m:")),
    ("  note: foo: bar: z", None), ("\tx:1:2: error: z", None), ("12:3: skip: me: x", None), (":1:2: error: x", None),
    ("a.c:1:2: error: ", None), ("main.c: In function 'main':", None), ("", None),
])
def test_compiler_line(spark, line, want):
    assert errors_of(spark, line, logs.parse_compiler_lines) == ([want] if want else [])
    flag = spark.createDataFrame([(f"first\n{line}\nlast",)], "o string").select(logs.has_compiler_line(F.col("o"))).first()[0]
    assert flag == bool(want)


def test_compiler_lines_do_not_run_together(spark):
    out = "main.c: In function 'main':\nmain.c:5:3: error: x undeclared\n"
    assert errors_of(spark, out, logs.parse_compiler_lines) == [("compile_error", "main.c", 5, 3, "x undeclared")]


TRACEBACK = ('Traceback (most recent call last):\n  File "a.py", line 3, in <module>\n    f()\n'
             '  File "b.py", line 7, in f\n    raise ValueError("x: y")\nValueError: x: y\n')


@pytest.mark.parametrize("output, want", [
    (TRACEBACK + "\nok\n", [("ValueError", "b.py", 7, None, "x: y")]),
    (TRACEBACK, [("ValueError", "b.py", 7, None, "x: y")]),
    (TRACEBACK.rstrip("\n"), [("ValueError", "b.py", 7, None, "x: y")]),
    (TRACEBACK + "\n" + TRACEBACK.replace("b.py", "c.py") + "\n", [("ValueError", f, 7, None, "x: y") for f in ("b.py", "c.py")]),
    (TRACEBACK + TRACEBACK.replace("b.py", "c.py"), [("ValueError", "c.py", 7, None, "x: y")]),
    ("Traceback (most recent call last):\nKeyboardInterrupt\n\nx: y", [(None, None, None, None, None)]),
    ("Traceback (most recent call last):", [(None, None, None, None, None)]),
    ("Traceback (most recent call last):\n  File \"a.py\"\nAssertionError:", [("AssertionError", "a.py", None, None, "")]),
    ("nothing", []),
])
def test_traceback(spark, output, want):
    assert errors_of(spark, output, logs.parse_tracebacks) == want


def parsed(spark, *outputs):
    df = spark.createDataFrame([("s", o, 1000 + i) for i, o in enumerate(outputs)], "sid string, output string, timestamp long")
    return logs.parse_logs(df)


def test_first_parser_that_finds_something_wins(spark):
    gcc = "a.c:1:2: warning: w\n"
    sessions, errors = parsed(spark, "$ run\n" + gcc + TRACEBACK, "$ run\n" + gcc, "$ run\nERROR: x", "$ run\nfine")
    codes = {r.timestamp: (r.exit_code, r.command) for r in sessions.collect()}
    assert codes == {1000: (1, "run"), 1001: (0, "run"), 1002: (1, "run"), 1003: (0, "run")}
    got = sorted((r.timestamp, r.error_type, r.message, r.command, r.exit_code) for r in errors.collect())
    assert got == [(1000, "ValueError", "x: y", None, None), (1001, "compile_warning", "w", None, None),
                   (1002, "generic_error", "Command failed (non-zero exit)", "run", 1)]


@pytest.mark.parametrize("output, command", [
    ("$ make all\nx", "make all"), ("~/$ \tls", "ls"), ("\nfoo", ""), ("x" * 255, "x" * 255), ("x" * 256, "x" * 256), ("", "")])
def test_command(spark, output, command):
    df = spark.createDataFrame([(output,)], "o string")
    assert df.select(logs.command_of(F.col("o"))).first()[0] == command


def test_session_id(spark):
    sessions, _ = parsed(spark, "$ make\n")
    assert sessions.first().session_id == hashlib.sha256(b"s_make_1000").hexdigest()


def test_default_rules_on_code(spark):
    c = "int x;\nint main(void) {\n curl_easy_init();\n}\nint f(int a) {\n}\n"
    files = spark.createDataFrame([("s", "a.c", c), ("s", "a.py", "def a():\n  pass\n"), ("s", "a.js", c)],
                                  "sid string, file_path string, content string")
    found = patterns.extract_patterns(files, default_rules(spark), 1).collect()
    assert sorted((r.file_path, r.log_key, r.line_number, r.matched_text) for r in found) == [
        ("a.c", "api.called", 3, "curl_easy_init("), ("a.c", "function.declared", 2, "int main(void) {"),
        ("a.c", "function.declared", 5, "int f(int a) {"), ("a.py", "function.declared", 1, "def a(")]
    assert {r.action for r in found} == {"log"}


def test_rule_files(spark):
    rules = {(r.pattern_name, r.language): r for r in default_rules(spark).collect()}
    assert set(rules) == {("pattern:function", "c"), ("pattern:sql_query", "c"), ("pattern:api_call", "c"),
                          ("pattern:function", "python"), ("pattern:sql_query", "python")}
    assert rules["pattern:sql_query", "c"].regex == r'(mysql_query|sqlite3_exec|PQexec|pg_query)\s*\([^,]*,\s*"([^"]+)"'
    odd = "# c\nregex = a=b\n [one]  \n  key=k \nregex=x\nregex =  y z\t\njunk\n[broken\nlanguage=c\n[two]x\nregex = q\n"
    got = {r.pattern_name: tuple(r)[1:] for r in rules_from_texts(spark.createDataFrame([("f", odd)], "file string, text string")).collect()}
    assert got == {"": ("", "", "", "a=b"), "one": ("c", "", "k", "y z"), "two": ("", "", "", "q")}


def test_keyed_writes(spark):
    schema = "sid string, key string, value string, rationale string, timestamp long"
    rows = ledger.human_decisions(spark.createDataFrame(
        [("a", "k", "v", None, 1), ("b", "k", "v", "v", 2), ("a", "k", "w", "r", 1)], schema))
    one = {(r.key, r.value): r for r in ledger.merge_decisions(rows).collect()}
    assert len(one) == 2 and one["k", "v"].sid == "b"
    assert one["k", "v"].node_id == hashlib.sha256(b"k|v|v").hexdigest()
    assert ledger.merge_decisions(rows, per_session=True).count() == 3
    errors = spark.createDataFrame(
        [("s", "f", 1, "m", "first", 5, 0), ("s", "f", 1, "m", "second", 5, 1), ("s", None, None, "m", "g", 5, 2),
         ("s", None, None, "m", "h", 5, 3)],
        "session_id string, file_path string, line_number int, message string, error_type string, timestamp long, ordinal int")
    assert {r.error_type for r in ledger.earliest(errors, logs.ERROR_KEY, ["timestamp", "ordinal"]).collect()} == {"first", "g"}


@pytest.mark.parametrize("body, problem", [
    ("no package", "no SID prefix"), ("SIDx", "fewer than two colons"), ("SID:5", "fewer than two colons"),
    ("SID:5:bm90IGpzb24=", "payload is not JSON"), ("SID:5:%%%", "payload is not JSON"), ("SID:5:e30=", None)])
def test_package_rejects(spark, body, problem):
    row = packages.parse_package(spark.createDataFrame([("s", body)], "sid string, text string")).first()
    assert row.problem == problem
    assert (row.assumptions, row.version) == (([], "5") if problem is None else (None, None))
