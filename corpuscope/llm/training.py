"""Labelled rows for fitting, and sums of numpy arrays over all tasks of a corpus."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.workers import tidy

# Labelled rows of each class that a classifier is fitted on, chosen by a hash of their id.
SAMPLE = 20_000
SALTS = 16


def remainder(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE):
    """(rows, weights): at most `sample` labelled rows of each class as doc_id, text, label, and
    how many labelled rows each chosen row of a class stands for.

    Rows without id, text or label are left out; a document with two labels counts once, with the
    larger. The chosen ids are at most 2 * `sample` and so can be broadcast; texts are not shuffled."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    weights = {value: max(1.0, totals.get(value, 0) / sample) for value in (0, 1)}
    return rows, weights


def packed(values) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpacked(data: bytes, dtype):
    return np.frombuffer(zlib.decompress(data), dtype)


def _add(dtype):
    def run(frames):
        sums = {}
        for frame in frames:
            for chunk, data in zip(frame["chunk"], frame["data"]):
                values = unpacked(data, dtype)
                if chunk in sums:
                    sums[chunk] += values
                else:
                    sums[chunk] = values.copy()
        yield pd.DataFrame({"chunk": list(sums), "data": [packed(v) for v in sums.values()]})
    return run


def summed(parts: DataFrame, dtype) -> DataFrame:
    """Rows (chunk, part, packed data) to (chunk, packed data): the sum of all arrays of a chunk, added in two steps
    so that no task reads the arrays of all tasks; a task holds one array per chunk."""
    step = lambda rows, *keys: rows.repartition(SALTS * 4 if len(keys) > 1 else SALTS, *keys).select("chunk", "data").mapInPandas(
        tidy(_add(dtype)), "chunk int, data binary")
    return step(step(parts, "chunk", F.pmod(F.col("part"), F.lit(SALTS))), "chunk")
