"""What a Python worker holds at a time."""

import pyarrow as pa
import public_tokenizers

from corpuscope.functions.vectors import _TokenBytes
from corpuscope.llm import alignment, workers
from corpuscope.operators import search


def test_a_worker_remembers_few_tokens_and_still_names_them_right():
    held = _TokenBytes()
    first = held[b"word0"]
    most = 0
    for i in range(150_000):
        held[b"word%d" % i]
        most = max(most, len(held))
    assert most <= 100_000 and held[b"word0"] == first


def test_scores_are_made_for_few_rows_at_a_time(spark, monkeypatch):
    rows = [(f"f{i:03}", "s", [float(i), 1.0, 0.0]) for i in range(50)]
    asked = spark.createDataFrame([(1, None, [1.0, 0.0, 0.0]), (2, "s", [0.0, 1.0, 0.0])], "query_id long, sid string, embedding array<double>")
    corpus = spark.createDataFrame(rows, "file_path string, sid string, embedding array<double>").coalesce(1)
    found = lambda: sorted(map(tuple, search.cosine_top_k(corpus, asked, "file_path", 4, 0.0, width=3).collect()), key=repr)
    whole = found()
    monkeypatch.setattr(search, "SCORED_ROWS", 7)
    assert found() == whole and len(whole) == 8


def test_a_worker_is_small_after_its_tasks():
    """What one operator's tasks keep goes before another's begin, and memory that is free goes back to the system."""
    class Large:
        def __init__(self):
            self.words = [b"%d" % i * 20 for i in range(300_000)]

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    made = []
    def encode(batches):
        held = workers.kept("encoder", lambda: made.append(1) or Large())
        yield from (len(held.words) for _ in batches)

    assert list(workers.tidy(encode, keeps=True)([1, 2])) == list(workers.tidy(encode, keeps=True)([3, 4])) and len(made) == 1
    before = resident()
    assert list(workers.tidy(iter)([1])) == [1] and not workers._kept
    assert resident() < before - 30


def test_an_aligner_knows_no_words_after_a_task(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(alignment.TaskContext, "get", lambda: Task)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "data": [b"some words", b"more words than before"]})
    out = list(alignment._encode(*paths)([batch]))
    assert sum(len(r["doc_ids"] or []) for b in out for r in b.to_pylist()) == 2
    assert not alignment.shared_aligner(*paths).index
