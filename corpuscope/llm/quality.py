"""Quality classifier on random-indexing word vectors.

Every symbol has a fixed sparse random index vector; a word's vector is the sum of the index
vectors of its neighbours over the whole corpus. Symbols are hashed words and word shapes (case,
digits, marks, repetition). A document is the mean of its words' vectors; a two-layer network
turns it into a logit, and a temperature fitted on rows kept apart into a probability."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.rolling import FOLDED_VALUES, Rolling, pieces, word_spans
from corpuscope.llm.tables import documents
from corpuscope.llm.training import SAMPLE, packed, remainder, summed, training_rows, unpacked

THRESHOLD = 0.3
BUCKETS = 1 << 14
SHAPES = 256
SYMBOLS = BUCKETS + SHAPES
WIDTH = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
STEPS, BATCH, RATE = 1500, 256, 0.01
# Words worked on at once, and parts that the matrix of all symbols is sent in.
WORDS = 100_000
CHUNKS = 16


def index_vectors():
    """Sparse ternary vectors, one per symbol; the last row, for places outside a text, is zero."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((SYMBOLS + 1, WIDTH), np.float32)
    for k in range(NONZERO):
        at = rng.integers(0, WIDTH, SYMBOLS)
        out[np.arange(SYMBOLS), at] += rng.choice(np.array([-1, 1], np.float32), SYMBOLS)
    return out


_UPPER, _LOWER, _DIGIT = (np.array([bool(chr(b).isascii() and f(chr(b))) for b in range(256)]) for f in (str.isupper, str.islower, str.isdigit))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def symbols(text):
    """(word bucket, shape) of each word of a text."""
    parts = [_symbols(part) for part in pieces(np.frombuffer(text or b"", np.uint8))]
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 2


def _symbols(data):
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = lambda table: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64))))
    length, upper, lower, digit, mark = ends - starts, count(_UPPER), count(_LOWER), count(_DIGIT), count(_MARK)
    hashes = Rolling(FOLDED_VALUES[data]).spans(starts, ends)
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper >= 0.5 * (upper + lower), 3, 2)))
    marks = np.minimum(mark, 3)
    repeats = np.zeros(len(starts), np.int64)
    repeats[1:] = hashes[1:] == hashes[:-1]
    size = np.minimum(length // 4, 3)
    # 4 cases x 4 marks x repeat x digit x 4 lengths
    shape = (((case * 4 + marks) * 2 + repeats) * 2 + (digit > 0)) * 4 + size
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape


def _accumulate(words, shapes, begin, end, index, sums, counts):
    """Add the contexts of words `begin` to `end` (texts set apart by the row of zeros); neighbours may lie beyond."""
    low, high = max(begin - REACH, 0), min(end + REACH, len(words))
    own = index[words[low:high]] + index[shapes[low:high]]
    context = np.zeros_like(own)
    for step in range(1, REACH + 1):
        context[step:] += own[:-step]
        context[:-step] += own[step:]
    words, shapes, context = words[begin:end], shapes[begin:end], context[begin - low: end - low]
    inside = words < SYMBOLS
    for ids, add in ((words[inside], context[inside] + index[shapes[inside]]), (shapes[inside], context[inside])):
        counts += np.bincount(ids, minlength=SYMBOLS)
        for k in range(WIDTH):
            sums[:, k] += np.bincount(ids, add[:, k], SYMBOLS)


def _vectors(batches):
    index, part = index_vectors(), TaskContext.get().partitionId()
    sums, counts = np.zeros((SYMBOLS, WIDTH)), np.zeros(SYMBOLS)
    held, size, gap = [], 0, np.full(REACH, SYMBOLS)

    def flush():
        words, shapes = (np.concatenate(x) for x in zip(*held))
        for at in range(0, len(words), WORDS):
            _accumulate(words, shapes, at, min(at + WORDS, len(words)), index, sums, counts)

    for batch in batches:
        for text in batch.column("data").to_pylist():
            words, shapes = symbols(text)
            held += [(words, shapes), (gap, gap)]
            size += len(words) + REACH
            if size >= WORDS:
                flush()
                held, size = [], 0
    if held:
        flush()
    table = np.concatenate((sums, counts[:, None]), 1).astype(np.float32)
    for chunk, rows in enumerate(np.array_split(table, CHUNKS)):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int64()), pa.array([packed(rows)], pa.binary())],
                                         names=["chunk", "part", "data"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of every symbol, from all texts: SYMBOLS x WIDTH numbers (2 MB) whatever the corpus."""
    parts = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(_vectors, "chunk int, part long, data binary")
    rows = sorted(summed(parts, np.float32).collect(), key=lambda r: r["chunk"])
    if not rows:
        return np.zeros((SYMBOLS, WIDTH), np.float32)
    table = np.concatenate([unpacked(r["data"], np.float32) for r in rows]).reshape(SYMBOLS, WIDTH + 1).astype(float)
    sums, counts = table[:, :-1], table[:, -1:]
    mean = sums.sum(0) / max(counts.sum(), 1)
    vectors = sums / np.maximum(counts, 1) - mean
    vectors[counts[:, 0] == 0] = 0
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(text, vectors):
    """Mean vectors of the words and of the shapes, and the log length."""
    words, shapes = symbols(text)
    if not len(words):
        return np.zeros(2 * WIDTH + 1, np.float32)
    # a text's symbols counted first: a product of counts and vectors, however long it is
    out = []
    for ids in (words, shapes):
        kinds, times = np.unique(ids, return_counts=True)
        out.append(times @ vectors[kinds] / len(ids))
    return np.concatenate((*out, [np.log1p(len(words)) / 10])).astype(np.float32)


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple
    temperature: float = 1.0

    def logits(self, x):
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x, y, weights, vectors) -> Network:
    """Adam on the weighted logistic loss; a fifth of the rows is kept for the temperature."""
    rng = np.random.Generator(np.random.PCG64(11))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    width = x.shape[1]
    layers = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
    order = rng.permutation(len(x))
    apart, fit = order[: len(x) // 5], order[len(x) // 5:]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    scaled = (x - mean) / spread
    for step in range(1, STEPS + 1 if len(fit) else 1):
        rows = fit[rng.integers(0, len(fit), BATCH)]
        w1, b1, w2, b2 = layers
        hidden = np.maximum(scaled[rows] @ w1 + b1, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -50, 50)))
        error = (p - y[rows]) * weights[rows] / weights[rows].sum()
        back = np.outer(error, w2) * (hidden > 0)
        gradients = [scaled[rows].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, error.sum()]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in enumerate(gradients):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    network = Network(vectors, mean, spread, tuple(layers))
    if len(apart):
        logits, target, w = network.logits(x[apart]), y[apart], weights[apart]
        loss = lambda t: np.average(np.logaddexp(0, logits / t) - target * logits / t, weights=w)
        network.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Network:
    """Word vectors from all of `docs`; the network from at most `sample` labelled rows of each class."""
    vectors = word_vectors(docs)
    rows, weights = training_rows(docs, labels, label, sample)

    def features(batches):
        for batch in batches:
            data = [pooled(t, vectors).tobytes() for t in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(data, pa.binary())], names=["label", "x"])

    table = rows.select(F.col("text").cast("binary").alias("data"), "label").mapInArrow(features, "label int, x binary").toPandas()
    x = np.array([np.frombuffer(b, np.float32) for b in table["x"]], float).reshape(-1, 2 * WIDTH + 1)
    if not len(x):
        x, y = np.zeros((1, 2 * WIDTH + 1)), np.ones(1)
    else:
        y = table["label"].to_numpy(float)
    # rows come in no fixed order from the tasks
    order = np.lexsort(np.column_stack((x, y)).T)
    x, y = x[order], y[order]
    return train(x, y, np.where(y == 1, weights[1], weights[0]), vectors)


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, score. Null and empty texts get the score of a text without
    words. Repeated rows are scored each. Other columns are not looked at."""
    def run(batches):
        for batch in batches:
            x = np.array([pooled(t, network.vectors) for t in batch.column("data").to_pylist()]).reshape(-1, 2 * WIDTH + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.scores(x), pa.float64())], names=["doc_id", "score"])
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(run, "doc_id long, score double")


def op5_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(5) != 0)
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
