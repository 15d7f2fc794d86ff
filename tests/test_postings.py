"""The stored full-text index against plain postings."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import search
from corpuscope.session import spread
from corpuscope.sources import postings as P
from corpuscope.sources.postings import StoredPostings

FILES = "sid string, file_path string, content string"
WORDS = ["the", "a", "naïve", "b_b", "x1", "zeta", "Straße", "end.", "select", "1"]


def some_files(n, seed=1, first=0):
    rng = random.Random(seed)
    sid = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}"
    return [(sid(i), f"/src/f{i}.c", None if i % 17 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))) for i in range(first, first + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, FILES).repartition(5)


def rows_of(postings):
    return sorted(map(tuple, postings.select("token", "file_path", "field", "pos", "sid").collect()))


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_blocks_hold_the_rows_of_plain_postings(spark, tmp_path):
    rows = some_files(600)
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=4)
    index.write(frame(spark, rows))
    assert rows_of(index.postings()) == rows_of(search.build_postings(frame(spark, rows)))
    counts = index.vocabulary().collect()
    plain = {r["token"]: (r["documents"], r["occurrences"]) for r in search.token_counts(index.postings()).collect()}
    assert {r["token"]: (r["n_files"], r["n_occurrences"]) for r in counts} == plain


def test_long_files_are_cut_into_segments(spark, tmp_path):
    text = " ".join(["same"] * (P.SEGMENT + 100) + ["other", "tail"])
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=2)
    index.write(frame(spark, [("s", "/a.c", text), ("s", "/b.c", "same other")]))
    largest = index.blocks().agg(F.max("n_occurrences")).first()[0]
    assert largest <= P.SEGMENT + 1
    assert index.postings().where("token = 'same'").count() == P.SEGMENT + 101
    # a phrase over the border of two segments, and one word at each side
    text = " ".join(["x"] * (P.SEGMENT - 1) + ["left", "right"])
    index.write(frame(spark, [("s", "/c.c", text)]))
    asked = spark.createDataFrame([(1, "left_right", None), (2, "same other", None)], "query_id long, query_text string, sid string")
    got = {(r["query_id"], r["file_path"]) for r in search.stored_text_hits(index, asked).collect()}
    assert got == {(1, "/c.c"), (2, "/a.c"), (2, "/b.c")}


def test_a_write_replaces_its_files_and_no_others(spark, tmp_path):
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=3)
    first, second = some_files(120), some_files(50, seed=9, first=100)
    index.write(frame(spark, first))
    index.write(frame(spark, second))
    gone = {p for _, p, _ in second}
    want = [r for r in first if r[1] not in gone] + second
    assert rows_of(index.postings()) == rows_of(search.build_postings(frame(spark, want)))
    assert index.files().count() == len(want) and index.generations() == [0, 1]


def test_a_failed_write_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=3)
    rows = some_files(60)
    index.write(frame(spark, rows))
    before = rows_of(index.postings())
    broken = frame(spark, some_files(60, seed=3))
    whole = P.block_rows
    # blocks and dead files are there, the table that makes the generation count is not
    monkeypatch.setattr(StoredPostings, "files", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.write(broken)
    monkeypatch.undo()
    assert rows_of(index.postings()) == before and P.block_rows is whole
    index.write(broken)
    assert index.generations() == [0, 2]
    assert rows_of(index.postings()) == rows_of(search.build_postings(broken))


def test_a_search_opens_the_buckets_of_its_tokens(spark, tmp_path):
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=16)
    index.write(frame(spark, some_files(80)))
    asked = spark.createDataFrame([("zeta",)], "token string")
    bucket = asked.select(index.bucket_of(F.col("token"))).first()[0]
    for blocks in (index.blocks(asked), index.blocks_of("zeta")):
        text = plan(blocks)
        # Spark writes a list of one as an equality
        assert f"(bucket#" in text and f" = {bucket})" in text.split("PartitionFilters")[1].split("\n")[0]
        assert {r["token"] for r in blocks.collect()} == {"zeta"}
    assert "In(token, [a,zeta])" in plan(index.blocks_of("zeta", "a"))
    opened = {f.split("bucket=")[1].split("/")[0] for f in index.blocks(asked).inputFiles()}
    assert str(bucket) in opened


@pytest.mark.parametrize("n", [0, 150])
def test_stored_hits_equal_plain_hits(spark, tmp_path, n):
    files = frame(spark, some_files(n))
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=4)
    index.write(files)
    texts = ["the zeta", "b_b", "naive", "missing the", "zeta (x)", "", "select 1", "end x1 a", "STRASSE"]
    asked = [(i, t, s) for i, t in enumerate(texts) for s in (None, "hot")] + [(0, "the zeta", "s1")]
    queries = spark.createDataFrame([(i + (100 if s else 0), t, s) for i, t, s in asked], "query_id long, query_text string, sid string")
    got, want = (sorted(map(tuple, h.collect())) for h in (search.stored_text_hits(index, queries), search.text_hits(search.build_postings(files), queries)))
    assert got == want and (n == 0 or want)
    clause = lambda op, tokens, field=None: (op, field, tokens)
    lists = [[clause("all", ["the", "zeta"])], [clause("any", ["zeta", "x1"]), clause("not", ["a"])], [clause("phrase", ["b", "b"], "content")],
             [clause("prefix", ["na", "ze"]), clause("all", ["hot"], "sid")], [clause("not", ["a"])], [clause("prefix", ["qq"])]]
    queries = spark.createDataFrame([(i, s, c) for i, c in enumerate(lists) for s in ((None,) if i % 2 else ("hot", "s1"))],
                                    "query_id long, sid string, clauses array<struct<op string, field string, tokens array<string>>>")
    got, want = (sorted(map(tuple, h.collect())) for h in (search.stored_clause_hits(index, queries), search.clause_hits(search.build_postings(files), queries)))
    assert got == want and (n == 0 or want)


def test_clauses_answer_only_for_asked_sessions(spark):
    files = spark.createDataFrame([("de", "/a/x.py", "zeta"), ("en", "/a/y.py", "zeta")], FILES)
    snapshots = files.select("sid", "file_path", F.array_repeat(F.lit(0.0), 128).alias("embedding"))
    queries = spark.createDataFrame([(1, "q", "de", [("all", None, ["zeta"])]), (2, "q", None, [("all", None, ["zeta"])])],
                                    "query_id long, query_text string, sid string, clauses array<struct<op string, field string, tokens array<string>>>")
    got = search.similar_files(snapshots, search.build_postings(files), queries).collect()
    assert sorted((r["query_id"], r["sid"], r["file_path"], r["rank"]) for r in got) == [
        (1, "de", "/a/x.py", 1), (2, "de", "/a/x.py", 1), (2, "en", "/a/y.py", 2)]


def test_blocks_take_less_room_than_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("lang").alias("sid"), F.concat(F.lit("/src/f"), "doc_id", F.lit(".c")).alias("file_path"), F.col("text").alias("content"))
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=4)
    index.write(docs)
    rows = search.build_postings(docs)
    search.write_postings(rows, str(tmp_path / "rows"))
    size = sum(f.stat().st_size for f in (tmp_path / "rows").rglob("*.parquet")) / rows.count()
    assert index.bytes_per_occurrence() < size, (index.bytes_per_occurrence(), size)


def test_clauses_and_words_keep_the_asked_postings_in_one_pass(spark, monkeypatch):
    kept, stage = {}, search.staged
    monkeypatch.setattr(search, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    files = spark.createDataFrame([(f"/a/f{i}.py", "s", f"alpha alpine w{i} beta" + " gamma" * (i % 2)) for i in range(40)], "file_path string, sid string, content string")
    asked = spark.createDataFrame([(1, [("prefix", None, ["alp"]), ("not", "content", ["gamma"])])],
                                  "query_id long, clauses array<struct<op string, field string, tokens array<string>>>")
    assert search.clause_hits(search.build_postings(files), asked).count() == 20
    assert {r["token"] for r in kept["asked-postings"].select("token").distinct().collect()} == {"alpha", "alpine", "gamma"}
    clauses, tokens = search._stored_clauses(asked)
    plan = search._asked_postings(search.build_postings(files), tokens)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Generate inline(") == 1
    kept.clear()
    words = spark.createDataFrame([(1, "w3 alpha", None)], "query_id long, query_text string, sid string")
    assert [r["file_path"] for r in search.text_hits(search.build_postings(files), words).collect()] == ["/a/f3.py"]
    assert {r["token"] for r in kept["asked-tokens"].select("token").collect()} == {"w3", "alpha"}


def test_pieces_of_blocks_meet_in_one_row(spark, tmp_path, monkeypatch):
    """Files are gathered a few tokens at a time, and what belongs to one block still is one row."""
    rows, whole = some_files(300), P._gathered

    def in_few_tokens(batches):
        P.GATHERED = 40
        return whole(batches)

    monkeypatch.setattr(P, "_gathered", in_few_tokens)
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=2)
    index.write(frame(spark, rows + rows[:3]))
    index.write(frame(spark, some_files(60, seed=4, first=20)))
    assert index.blocks().groupBy("token", "block", "segment").count().where("count > 1").isEmpty()
    gone = {f"/src/f{i}.c" for i in range(20, 80)}
    want = [r for r in rows + rows[:3] if r[1] not in gone] + some_files(60, seed=4, first=20)
    assert rows_of(index.postings()) == rows_of(search.build_postings(frame(spark, want)))


def test_files_are_joined_to_blocks_not_to_occurrences(spark, tmp_path):
    index = StoredPostings(spark, str(tmp_path / "i"), buckets=2)
    index.write(frame(spark, some_files(40)))
    tree = index.postings()._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("explode(entries") < tree.index("Join Inner")  # the tree is printed from its last step down


def test_few_buckets_are_spread_over_all_tasks(spark):
    values = spark.range(5000).select(spread(spark, 1, "id").alias("s")).distinct().count()
    assert values > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
