"""Operators against brute force in plain Python, on inputs with hot keys."""

import random
import re
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.functions import text
from corpuscope.functions.vectors import cosine, embed_text, embed_text_native
from corpuscope.operators import changes, ledger, packages, patterns, reports, search

WORDS = ["the", "of", "a_b", "Été", "x1", "tree", "node", "THE", "ab", "b", "zeta", "naïve"]


def some_files(n, seed=3):
    rng = random.Random(seed)
    hot = lambda i: "hot" if i % 3 == 0 else f"s{i % 7}"
    return [(hot(i), f"/src/f{i}.c", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(some_files(90), "sid string, file_path string, content string").repartition(5)


def test_embedding_equals_native_form(spark, files):
    arrow = {(r[0], r[1]): r[2] for r in files.select(
        "file_path", F.posexplode(embed_text(F.col("content")))).where("col > 0").collect()}
    native = {(r[0], r[1]): r[2] for r in embed_text_native(files, "file_path", "content").collect()}
    assert arrow.keys() == native.keys() and len(native) > 500
    assert max(abs(arrow[k] - native[k]) for k in native) < 1e-12


def brute_matches(rx, content):
    """The documented walk over a text: next search starts at the end of a match, one
    further after an empty one, and stops at the end of the text."""
    # Python lets ^ match after a last newline; the expected dialect does not
    rx = re.sub(r"^\^", r"(?:\\A|^(?!\\Z))", rx)
    out, offset, pattern = [], 0, re.compile(rx, re.M | re.A)
    while (m := pattern.search(content, offset)) is not None:
        out.append((m.group(0), 1 + content.count("\n", 0, m.start())))
        offset = m.end() + (1 if m.end() == m.start() else 0)
        if offset >= len(content):
            break
    return out


@pytest.mark.parametrize("rx", [r"a+", r"x*", r"\n", r"^", r"^b", r"[a-c\n]+", r"$", r"\w+\s", r"(a|b)\n?", "é", r"ab(?=\n)"])
def test_matches_and_lines(spark, rx):
    rng = random.Random(5)
    texts = ["", "a", "\n", "a\n", "\n\na", "ab\nab", "aaa", "é\néa\n", "b"] + [
        "".join(rng.choice("ab\nxé ") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = dict(df.select("i", patterns.matches_with_steps(F.col("content"), F.lit(rx))).collect())
    for i, t in enumerate(texts):
        lines = accumulate((m.step for m in got[i] or []), initial=1)
        assert [(m.matched_text, n) for m, n in zip(got[i] or [], list(lines)[1:])] == brute_matches(rx, t), (rx, t)


def test_many_matches_in_one_file(spark):
    content = "f(\n" * 30_000
    df = spark.createDataFrame([("s", "a.c", content)], "sid string, file_path string, content string")
    rules = spark.createDataFrame([("f", "c", "log", "k", r"f\("), ("bad", "c", "log", "k", "(f")],
                                  "pattern_name string, language string, action string, log_key string, regex string")
    found = patterns.extract_patterns(df, rules, 5).orderBy("match_no").collect()
    assert [r.line_number for r in found] == list(range(1, 30_001)) and {r.timestamp for r in found} == {5}
    usable, refused = patterns.checked_rules(rules)
    assert usable.first().pattern_name == "f" and [(r.pattern_name, bool(r.reason)) for r in refused.collect()] == [("bad", True)]


def fold(s):
    return s.lower().translate(str.maketrans("éï", "ei"))


def tokens(s):
    return [t for t in re.split(r"[\W_]+", fold(s)) if t]


def vector(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", embed_text(F.col("t"))).collect()
    return {i: np.array(v) for i, v in rows}


QUERIES = ["the tree", "A_B", "été", "HOT", "a b", "node OR x1", "tree, node", "zzz", "the the of", "", "_", "naive f7", "S3 zeta", "a_b THE", "x1 x1_x1", "A_b src"]


def brute_hits(rows, query):
    words = query.split()
    if not words or any(not re.fullmatch(r"[A-Za-z0-9_\x80-\U0010ffff]+", w) or w in ("AND", "OR", "NOT") for w in words):
        return set()
    phrases = [p for p in map(tokens, words) if p]
    fields = lambda r: [tokens(x) for x in r]
    has = lambda field, p: any(field[i:i + len(p)] == p for i in range(len(field)))
    return {r[1] for r in rows if phrases and all(any(has(f, p) for f in fields(r)) for p in phrases)}


@pytest.mark.parametrize("plan", [{}, {"max_broadcast": 4}])
def test_similar_files_equals_brute_force(spark, files, plan):
    rows = some_files(90)
    queries = spark.createDataFrame([(i, q, sid) for i, q in enumerate(QUERIES) for sid in ((None,) if i % 4 else ("hot", "s3"))],
                                    "query_id long, query_text string, sid string")
    vectors, asked = vector(spark, [r[2] for r in rows]), vector(spark, QUERIES)
    from corpuscope.operators.snapshots import snapshot_files
    snaps = snapshot_files(files.withColumn("mtime", F.lit(0)))
    got = defaultdict(list)
    found = search.similar_files(snaps, search.build_postings(files), queries, k=6, **plan)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id, r.sid if r.query_id % 4 == 0 else None].append((r.file_path, round(r.score, 6)))
    want = {}
    for q, query in enumerate(QUERIES):
        hits = brute_hits(rows, query)
        per_sid = defaultdict(list)
        for i, (sid, path, _) in enumerate(rows):
            if q % 4 == 0 and sid not in ("hot", "s3"):
                continue
            sid = sid if q % 4 == 0 else None
            norm = np.linalg.norm(vectors[i]) * np.linalg.norm(asked[q]) + 1e-8
            score = float(vectors[i] @ asked[q] / norm)
            if score > 0.01:
                per_sid[sid].append((path, round(score, 6)))
            elif path in hits:
                per_sid[sid].append((path, 0.99))
        for sid, scored in per_sid.items():
            want[q, sid] = sorted(scored, key=lambda x: (-x[1], x[0]))[:6]
    assert dict(got) == want
    assert any(s == 0.99 for scored in want.values() for _, s in scored)


def test_text_matches_equal_brute_force(spark, files):
    rows, postings = some_files(90), search.build_postings(files)
    paths = lambda df: {r[0] for r in df.collect()}
    have = lambda *ts: {r[1] for r in rows if all(any(t in tokens(f) for f in r) for t in ts)}
    assert paths(search.match_all(postings, "the", "ete")) == have("the", "ete")
    assert paths(search.match_any(postings, "zeta", "f7")) == have("zeta") | have("f7")
    assert paths(search.match_not(search.match_all(postings, "the"), search.match_any(postings, "zeta"))) == have("the") - have("zeta")
    assert paths(search.match_phrase(postings, "b", "b")) == brute_hits([("", r[1], r[2]) for r in rows], "b_b")
    assert paths(search.match_prefix(postings, "na")) == have("naive")
    assert paths(search.match_all(search.match_field(postings, "sid"), "hot")) == {r[1] for r in rows if r[0] == "hot"}
    one = spark.createDataFrame([(f"/src/f{i}.c", "s3") for i in range(90) if i % 7 == 3], "file_path string, sid string")
    assert paths(search.in_session(search.match_all(postings, "the"), one, "s3")) == have("the") & {f"/src/f{i}.c" for i in range(90) if i % 7 == 3}


def test_postings_written_and_read(spark, files, tmp_path):
    search.write_postings(search.build_postings(files), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert search.match_all(stored, "the").count() == search.match_all(search.build_postings(files), "the").count()
    assert stored.count() == search.build_postings(files).count()


def test_cosine_of_zero_is_zero(spark):
    row = spark.sql("select array(0d, 0d) a, array(1d, 2d) b").select(cosine(F.col("a"), F.col("b")), cosine(F.col("b"), F.col("b"))).first()
    assert row[0] == 0 and abs(row[1] - 1) < 1e-7


def ledger_rows(spark, n, start=0):
    schema = "sid string, key string, value string, rationale string, timestamp long, ordinal long"
    rows = [("s", "hot" if i % 3 == 0 else f"k{i % 11}", "v", None, (i * 7) % 50, i) for i in range(start, start + n)]
    return ledger.human_decisions(spark.createDataFrame(rows, schema))


def test_upsert_is_idempotent_and_last_wins(spark):
    first, second = ledger_rows(spark, 200), ledger_rows(spark, 150, 500)
    keys, order = ledger.decision_key(), ["timestamp", "ordinal"]
    base = ledger.merge_decisions(first)
    once = ledger.replace_into(base, second, keys, order)
    twice = ledger.replace_into(once, second, keys, order)
    as_set = lambda df: {tuple(r) for r in df.select(*sorted(df.columns)).collect()}
    assert as_set(once) == as_set(twice) and once.count() == base.count() == 12
    newest = {r.key: r for r in ledger.merge_decisions(second).collect()}
    assert {r.ordinal for r in once.collect()} == {r.ordinal for r in newest.values()}
    assert as_set(ledger.insert_ignore(base, second, keys, order)) == as_set(base)


def test_package_round_trip(spark):
    long_text = "naïve — " * 60 + 'quo"te\\ \n:'
    schema = "sid string, key string, value string, rationale string, timestamp long"
    decisions = ledger.merge_decisions(ledger.human_decisions(spark.createDataFrame(
        [("s", "k", long_text, "r", 1), ("t", "file.x", "v", None, 2)] + [("hot", f"k{i}", "v", "", i) for i in range(700)], schema)))
    errors = spark.createDataFrame(
        [("s", "E", None, None, long_text, 5), ("only-errors", None, "f", 3, None, 5)] + [("hot", "E", "f", i % 40, "m", i) for i in range(900)],
        "sid string, error_type string, file_path string, line_number int, message string, timestamp long")
    snaps = spark.createDataFrame([(f"/f{i}", "t", "c", i, "h") for i in range(400)],
                                  "file_path string, sid string, language string, lines_of_code long, content_hash string")
    built = packages.build_package(decisions, errors, snaps, 77)
    made = {r.sid: r for r in built.collect()}
    # a session in parts loses nothing, and every part knows the totals
    parts = packages.build_package(decisions, errors, snaps, 77, part_entries=150).where("sid = 'hot'").orderBy("metadata.part").collect()
    assert len(parts) == 5 and len({p.package_id for p in parts}) == 5
    assert [a for p in parts for a in p.assumptions] == made["hot"].assumptions
    assert all("Decisions: 700  |  Errors: 40  |  Files: 0" in p.preamble for p in parts)
    short = packages.build_package(decisions, errors, snaps, 77, limit=20, shown=2).where("sid = 'hot'").first()
    assert len(short.assumptions) == 20 and short.preamble.count(" = ") == 2 and "Decisions: 700" in short.preamble
    assert set(made) == {"s", "t", "hot", "only-errors"}
    assert len(made["hot"].assumptions) == 700 and made["hot"].assumptions[0].name == "k699"
    assert [i.condition for i in made["hot"].invariants][:2] == ["E at f:19 — m", "E at f:18 — m"] and len(made["hot"].invariants) == 40
    assert made["s"].invariants[0].condition == f"E at ?:0 — {long_text}" and "\n" not in made["s"].package
    assert made["only-errors"].invariants[0] == ("fix_unknown", "? at f:3 — ?") and made["only-errors"].assumptions == []
    assert made["t"].assumptions[0].name == "file.x" and len(made["t"].assumptions) == 401
    assert "--- KEY DECISIONS ---\n" == made["t"].preamble[-len("--- KEY DECISIONS ---\n"):]
    back = {r.sid: r for r in packages.parse_package(built.select("sid", F.col("export").alias("text"))).collect()}
    for sid, row in made.items():
        assert (back[sid].assumptions, back[sid].invariants, back[sid].version) == (row.assumptions, row.invariants, "5.0.0")
        assert back[sid].metadata == row.metadata and back[sid].metadata.generated_at == 77
    imported = ledger.import_decisions(packages.parse_package(built.select("sid", F.col("package").alias("text"))), 9)
    assert imported.where("rationale = 'Imported from SID: r'").first().value == long_text


def test_packages_make_their_inputs_once(spark):
    """Errors and decisions, which may take a whole parse to make, are made once: for positions, parts and totals."""
    made = {"errors": spark.sparkContext.accumulator(0), "decisions": spark.sparkContext.accumulator(0)}

    def counted(rows, name):
        def passed(batches):
            for batch in batches:
                made[name].add(len(batch))
                yield batch
        return rows.mapInArrow(passed, rows.schema)

    errors = spark.createDataFrame([(f"s{i % 3}", "E", f"m{i}", "f", i, i) for i in range(60)],
                                   "sid string, error_type string, message string, file_path string, line_number int, timestamp long")
    decisions = spark.createDataFrame([(f"s{i % 4}", f"n{i}", f"k{i}", "v", "r", i) for i in range(80)],
                                      "sid string, node_id string, key string, value string, rationale string, timestamp long")
    snaps = spark.createDataFrame([("s1", "/a.c", "h", 1, "c")], "sid string, file_path string, content_hash string, lines_of_code int, language string")
    built = packages.build_package(counted(decisions, "decisions"), counted(errors, "errors"), snaps, 5, part_entries=10).collect()
    assert sum(len(p.assumptions) for p in built) == 81 and sum(len(p.invariants) for p in built) == 60
    assert all("Decisions: 20  |  Errors: 20  |  Files: 1" in p.preamble for p in built if p.sid == "s1")
    assert (made["errors"].value, made["decisions"].value) == (60, 80)


def test_hot_session_in_reports(spark):
    errors = spark.createDataFrame([("i1", "a", i) for i in range(500)] + [("i2", "b", 1), ("i3", "a", 1)], "session_id string, sid string, ordinal int")
    snaps = spark.createDataFrame([("a",), ("c",)], "sid string")
    found = spark.createDataFrame([("a", "function.declared"), ("b", "api.called"), ("b", "x")], "sid string, log_key string")
    got = {r.sid: tuple(r)[1:] for r in reports.session_metrics(snaps, found, errors).collect()}
    assert got == {"a": (1, 1, 0, 0, 501), "b": (0, 0, 0, 1, 1), "c": (1, 0, 0, 0, 0)}
    left, deleted = reports.clear_errors(errors, "a")
    assert deleted.first()[0] == 501 and {r.session_id for r in left.collect()} == {"i2"}


@pytest.mark.parametrize("baseline", [False, True])
@pytest.mark.parametrize("emit_new", [False, True])
def test_changed_files_equals_brute_force(spark, baseline, emit_new):
    rng = random.Random(3)
    rows = [(s, f"p{p}", rng.choice([1, 2])) for s in range(1, 30) for p in range(6) if rng.random() < 0.6]
    want, seen = set(), {}
    first = min(s for s, *_ in rows)
    for s, p, m in rows:
        if (p in seen and seen[p] != m) or (p not in seen and emit_new and (baseline or s > first)):
            want.add((s, p, m, seen.get(p)))
        seen[p] = m
    got = changes.changed_files(spark.createDataFrame(rows, "scan_no long, file_path string, mtime long"), emit_new, baseline)
    assert {tuple(r) for r in got.collect()} == want


def test_results_do_not_depend_on_partitions(spark, files):
    runs = [search.build_postings(files.repartition(n)).groupBy("token").count() for n in (1, 7)]
    assert len({frozenset(map(tuple, r.collect())) for r in runs}) == 1


def test_hot_session_join_is_split(spark):
    """A session with a third of all errors is joined by several tasks, and nothing is lost."""
    errors = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 999)).alias("session_id"),
        F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("message"))
    sessions = errors.select("session_id").distinct()
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        joined = reports.of_sessions(errors.repartition(8), sessions)
        sizes = joined.where("session_id <> ''").groupBy(F.spark_partition_id()).agg(F.count_if(F.col("session_id") == "hot").alias("n")).collect()
        assert joined.count() == 300_000 and max(r.n for r in sizes) < 100_000
    finally:
        for name in changed:
            spark.conf.unset(name)


@pytest.mark.parametrize("regex, literal", [
    (r"^def\s+([a-z]+)", "def"), ("abc|def", ""), ("(abc|def)ghi jk", "ghi jk"), ("ab?cde{2,3}fgh", "fgh"), ("[abc]def[^]x]yz1", "def"),
    ("(?i)abc", ""), (r"a\.bcd*", "bc"), ("x(?=abc)qrs", "qrs"), ("[a[bc]]long", "long"), ("a{3}bcd", "bcd"), (r"\Qa\E", ""), ("abc+d", "abc"), (None, "")])
def test_required_literals(regex, literal):
    assert patterns.required_literal(regex) == literal


def test_a_thousand_rules_in_parts(spark):
    """The same matches, however many parts the rules are broadcast in; only files with the literal are searched."""
    rules = spark.createDataFrame([(f"r{i}", "" if i % 2 else "python", "log", "k", f"w{i} [0-9]+" if i % 3 else f"w{i}(?: [0-9]+)?") for i in range(1000)]
                                  + [("bad", "", "log", "k", "("), ("none", "", "log", "k", "")], schemas.RULES)
    files = spark.createDataFrame([("s", f"/f{i}.py" if i % 4 else f"/f{i}.c", " ".join(f"w{j} {i}" for j in range(i, 1000, 97))) for i in range(40)],
                                  "sid string, file_path string, content string")
    got = {(r.file_path, r.pattern_name, r.matched_text) for r in patterns.extract_patterns(files, rules, 1).collect()}
    want = {(f"/f{i}.py" if i % 4 else f"/f{i}.c", f"r{j}", f"w{j} {i}") for i in range(40) for j in range(i, 1000, 97) if j % 2 or i % 4}
    assert want <= got and all(m.startswith("w") for *_, m in got)
    with_language = files.withColumn("language", F.lit("python"))
    usable, refused = patterns.checked_rules(rules)
    assert [r.pattern_name for r in refused.collect()] == ["bad"]
    pairs = [sorted(map(tuple, patterns.applicable_rules(with_language, usable, block=b).select("file_path", "rule_no").collect())) for b in (100, 5000)]
    assert pairs[0] == pairs[1] and len(pairs[0]) < 40 * 1000 / 10
