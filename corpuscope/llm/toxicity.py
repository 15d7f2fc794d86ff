"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds of standing in a toxic document, with a Dirichlet prior from the pooled counts;
those with a clear z-score are kept, all others cost a little. A linear scan finds every maximal
segment of each text. Scores of segments follow an extreme-value law in texts that are not toxic;
its parameters are fitted on such texts, and a document's score comes from how far its significant
segments stand above what its length explains."""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.rolling import FOLDED_VALUES, word_hashes
from corpuscope.llm.tables import Staged, documents, long_column
from corpuscope.llm.training import SAMPLE, remainder, training_rows
from corpuscope.llm.workers import tidy

THRESHOLD = 0.3
# Pseudo-count of the prior per token, on average and at least; log-odds of a token that is kept, and the
# z-scores among which the least of such a token is chosen.
PRIOR = 0.5
MIN_SCORE = 1.0
BOUNDS = (3.0, 2.5, 2.0)
FOLDS = 4
# The cost of any other token.
OTHER = -0.05
EULER = 0.5772156649
LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(text: bytes):
    """Hashes of the runs of letters and digits, A-Z lower-cased."""
    return word_hashes(text, FOLDED_VALUES, LETTERS)


@dataclass
class Model:
    hashes: np.ndarray          # sorted
    scores: np.ndarray
    scale: float = 1.0          # of the extreme-value law
    size: float = 1.0
    slope: float = 1.0          # of the logistic calibration
    offset: float = 0.0

    def hits(self, words):
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        found = np.flatnonzero(self.hashes[at] == words) if len(self.hashes) else np.zeros(0, int)
        return found, self.scores[at[found]] if len(found) else np.zeros(0)


def maximal_segments(places, scores, other=OTHER):
    """All maximal scoring segments (first, last, score) in one pass.

    `places` are the positions of tokens with scores of their own; every position between costs
    `other`. Each candidate keeps the sums before and after it, and the last candidate before it that
    starts lower: those between start no lower than it, so none is looked at twice."""
    found, total, reached = [], 0.0, 0
    for place, score in zip(places, scores):
        total += other * (place - reached)
        reached = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, last, after = place, place, total
        k = len(found) - 1
        while k >= 0 and found[k][2] >= before:
            k = found[k][4]
        # merged with the last candidate that starts lower and ends lower, as often as that holds
        while k >= 0 and found[k][3] < after:
            first, before = found[k][0], found[k][2]
            lower = found[k][4]
            del found[k:]
            k = lower
        found.append((first, last, before, after, k))
    return [(first, last, after - before) for first, last, before, after, _ in found]


def passages(model: Model, words):
    """(first word, last word, score, p-value) of every segment of a text."""
    places, scores = model.hits(words)
    n = max(len(words), 1)
    out = []
    for first, last, score in maximal_segments(places.tolist(), scores.tolist()):
        expected = model.size * n * math.exp(-model.scale * score)
        out.append((first, last, score, -math.expm1(-expected)))
    return out


def statistic(found) -> float:
    """Evidence of all significant segments: the sum of their log p-values, on a log scale."""
    return math.log1p(sum(-math.log(max(p, 1e-300)) for *_, p in found if p < 0.05))


def _probability(model, found) -> float:
    return 1 / (1 + math.exp(-(model.slope * statistic(found) + model.offset)))


def _count(batches):
    for batch in batches:
        seen, labels = [], []
        for text, label in zip(batch.column("data").to_pylist(), batch.column("label").to_pylist()):
            words = np.unique(tokens(text))
            seen.append(words)
            labels.append(np.full(len(words), label))
        words, labels = np.concatenate(seen), np.concatenate(labels)
        unique, which = np.unique(words, return_inverse=True)
        toxic = np.bincount(which, labels, len(unique)).astype(np.int64)
        both = np.bincount(which, minlength=len(unique))
        yield pa.RecordBatch.from_arrays([long_column(unique), pa.array(toxic), pa.array(both - toxic)], names=["token", "toxic", "clean"])


def token_table(rows: DataFrame, tables: Staged) -> DataFrame:
    """(token, score, z): log-odds of the documents that hold a token, shrunk to a Dirichlet prior."""
    counts = tables.write(rows.mapInArrow(tidy(_count), "token long, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "token-counts")
    whole = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("kinds")).first()
    prior_all = whole["kinds"] * PRIOR
    prior = (F.col("toxic") + F.col("clean")) * (prior_all / max((whole["toxic"] or 0) + (whole["clean"] or 0), 1))
    prior = F.greatest(prior, F.lit(PRIOR))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    rest = lambda seen, x: F.greatest(F.lit((seen or 0) + prior_all) - x, F.lit(1e-9))
    odds = F.log(a / rest(whole["toxic"], a)) - F.log(b / rest(whole["clean"], b))
    return counts.select("token", odds.alias("score"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))


def _models(rows: DataFrame, tables: Staged, bounds) -> list[Model]:
    """A model for each bound of the z-score. Tokens come from the bounded labelled rows only."""
    table = token_table(rows, tables).filter((F.abs("z") >= min(bounds)) & (F.abs("score") >= MIN_SCORE)).toPandas()
    table = table.assign(key=table["token"].to_numpy().view("uint64")).sort_values("key")
    z = table["z"].abs().to_numpy()
    return [Model(table["key"].to_numpy()[z >= b], table["score"].to_numpy(float)[z >= b]) for b in bounds]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, bounds=BOUNDS) -> Model:
    """Fit on at most `sample` labelled rows of each class; equal texts count once.

    The bound of the z-score is the one of `bounds` whose models tell held-apart rows best, by F1 (the larger
    of equals): the rows are dealt to `FOLDS` parts by a hash of their text, and each part is judged by a model of the
    others. The calibration is fitted on the same held-apart statistics."""
    tables = Staged(docs.sparkSession)
    chosen, weights = training_rows(docs, labels, label, sample)
    rows = tables.write(chosen.groupBy("text").agg(F.max("label").alias("label")).select(F.col("text").cast("binary").alias("data"), "label"), "labelled")
    fold = F.pmod(F.crc32("data"), F.lit(FOLDS))
    apart = []
    for part in range(FOLDS):
        models = _models(rows.filter(fold != part), tables, bounds)
        held = rows.filter(fold == part)
        _fit_laws(models, held)
        apart.append(_measured(held, _statistics, models))
    apart = pd.concat(apart)
    judged = [(_best_f1(group["value"], group["label"]), bounds[k], k) for k, group in apart.groupby("model")]
    best = max(judged)[2] if judged else 0
    model = _models(rows, tables, [bounds[best]])[0]
    _fit_laws([model], rows)
    _calibrate(model, apart[apart["model"] == best], weights)
    return model


def _best_f1(scores, labels) -> float:
    """The largest F1 of any threshold above the least score. Rounded, so that near ties are ties."""
    x, y = scores.to_numpy(), labels.to_numpy() == 1
    order = np.argsort(-x, kind="stable")
    taken, right = np.arange(1, len(x) + 1), np.cumsum(y[order])
    last = np.append(x[order][1:] < x[order][:-1], False)  # a threshold takes all of equal scores
    f1 = 2 * right / (taken + max(y.sum(), 1))
    return round(float(f1[last].max()), 2) if last.any() else 0.0


def _segment_scores(model, words):
    return [s for *_, s in maximal_segments(*(x.tolist() for x in model.hits(words)))]


def _bests(model, words):
    """The best segment."""
    return max(_segment_scores(model, words), default=0.0)


def _statistics(model, words):
    return statistic(passages(model, words))


def _measured(rows: DataFrame, measure, models):
    """(model, label, n, value) of each row and model: a few numbers, whatever the length of the texts."""
    def run(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch.column("data").to_pylist(), batch.column("label").to_pylist()):
                words = tokens(text)
                out += [(k, label, len(words), measure(model, words)) for k, model in enumerate(models)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))],
                                             names=["model", "label", "n", "value"])

    return rows.mapInArrow(tidy(run), "model int, label int, n long, value double").toPandas()


def _fit_laws(models, rows):
    """Gumbel law of the best segment of clean texts, by moments, less the logarithm of the length."""
    clean = _measured(rows.filter("label = 0"), _bests, models)
    for k, group in clean[clean["n"] > 0].groupby("model"):
        best, length = group["value"].to_numpy(), np.log(group["n"].to_numpy())
        spread = max(float(best.std()), 0.25)
        models[k].scale = math.pi / (spread * math.sqrt(6))
        models[k].size = math.exp(float(np.mean(models[k].scale * best - length)) - EULER)


def _calibrate(model, apart, weights):
    """Logistic regression of the label on the statistic, rows weighted to the labelled total."""
    if not len(apart):
        model.slope, model.offset = 1.0, -2.0
        return
    x, y = apart["value"].to_numpy(), apart["label"].to_numpy(float)
    w = np.where(y == 1, weights[1], weights[0])
    design, theta = np.stack((x, np.ones(len(x))), 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (w * (y - p)) - 0.01 * theta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(max(theta[0], 0.0)), float(theta[1])


def _score(model):
    def run(batches):
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("data").to_pylist():
                found = passages(model, tokens(text))
                scores.append(_probability(model, found))
                spans.append([{"first": a, "last": b, "score": s, "p": p} for a, b, s, p in found if p < 0.05])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                             names=["doc_id", "score", "passages"])
    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, score, passages (word positions, score and p-value of each
    significant one). Null and empty texts have no passage and the score of a text without any.
    Repeated rows are scored each. Other columns are not looked at."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(
        tidy(_score(model)), "doc_id long, score double, passages array<struct<first:long,last:long,score:double,p:double>>")


def training_model(spark, sf_dir) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(4) != 2)
    return fit(documents(spark, sf_dir), labels)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns.

    Null and empty texts have the score of a text without any passage. Rows that repeat an id or a text are
    judged each; null ids are kept or go like any other. No rows give no rows."""
    def run(batches):
        for batch in batches:
            scores = [_probability(model, passages(model, tokens((t or "").encode()))) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))
    return docs.mapInArrow(tidy(run), docs.schema)


def op4_toxicity(spark, sf_dir):
    scored = score_documents(documents(spark, sf_dir), training_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
