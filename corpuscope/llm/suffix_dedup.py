"""Substring dedup by anchor-aligned context sorting (no phrases or parse of the corpus are formed).

Equal windows have the same rolling-hash trigger (the smallest `GRAM`-byte hash of a window) at the
same distance. Each distinct context of a trigger is held once, with its number of occurrences; only
contexts whose trigger occurs again are kept, and hot triggers are split. For each trigger the left
parts (read from the trigger backwards) and the right parts are sorted, with their longest common
prefixes; a window is a pair of an interval of each, so equal windows have equal pairs."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.repeats import HOT, in_small_groups, repeated_contexts, with_lists
from corpuscope.llm.rolling import BYTE_VALUES, Rolling, anchored
from corpuscope.llm.tables import Staged, documents, long_column, sorted_groups, text_key

WINDOW = 400
GRAM = 100
# Distances from the trigger that are compared at once in a group of many contexts.
CELLS = 1 << 22


def contexts_of(window: int, gram: int):
    """Arrow batches (key, data) to one row per trigger context of each text."""
    def run(batches):
        for batch in batches:
            parts = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
                if text is not None and len(text) >= window:
                    trigger, digest, first, last = anchored(np.frombuffer(text, np.uint8), window, gram, BYTE_VALUES)
                    parts.append((trigger, digest, np.full(len(first), key), first, last))
            if parts:
                trigger, digest, key, first, last = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [long_column(trigger), long_column(digest), pa.array(key), pa.array(first), pa.array(last)],
                    names=["trigger", "digest", "key", "first", "last"])
    return run


def _common(left: bytes, right: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(left), len(right))
    if left[:n] == right[:n]:
        return n
    differ = np.frombuffer(left, np.uint8, n) != np.frombuffer(right, np.uint8, n)
    return int(differ.argmax())


def _ordered(texts):
    """Suffix array of the texts (as positions) and longest common prefixes of neighbours."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    lcp = np.array([0] + [_common(texts[a], texts[b]) for a, b in zip(order, order[1:])])
    return np.array(order), lcp


def repeated_windows(contexts, window: int):
    """contexts: (bytes, distance of the trigger from the first start, number of starts, occurrences).

    For each context a boolean array over its starts: does the window occur elsewhere among them?"""
    n = len(contexts)
    left, left_lcp = _ordered([c[:at][::-1] for c, at, _, _ in contexts])
    right, right_lcp = _ordered([c[at:] for c, at, _, _ in contexts])
    furthest = np.array([at for _, at, _, _ in contexts])
    nearest = np.array([at - starts + 1 for _, at, starts, _ in contexts])
    times = np.array([t for *_, t in contexts])
    out = [np.zeros(starts, bool) for _, _, starts, _ in contexts]
    step = max(1, CELLS // n)
    for begin in range(int(nearest.min()), int(furthest.max()) + 1, step):
        back = np.arange(begin, min(begin + step, int(furthest.max()) + 1))
        # windows that begin `back` bytes before the trigger: equal left parts are an interval of
        # one suffix array, equal right parts one of the other; numbered along each array
        group = np.empty((2, len(back), n), np.int64)
        group[0][:, left] = np.cumsum(left_lcp < back[:, None], axis=1)
        group[1][:, right] = np.cumsum(right_lcp < (window - back)[:, None], axis=1)
        pair = group[0] * (n + 1) + group[1]
        inside = (back[:, None] <= furthest) & (back[:, None] >= nearest)
        pair = np.where(inside, pair, -1 - np.arange(n))
        order = np.argsort(pair, axis=1, kind="stable")
        ranked = np.take_along_axis(pair, order, 1)
        same = ranked[:, 1:] == ranked[:, :-1]
        again = np.zeros(pair.shape, bool)
        again[:, 1:] |= same
        again[:, :-1] |= same
        found = np.zeros(pair.shape, bool)
        np.put_along_axis(found, order, again, 1)
        found |= times > 1
        for i in range(n):
            have = inside[:, i]
            out[i][furthest[i] - back[have]] = found[have, i]
    return out


def spans_of(flags):
    """Runs of true values as (first, last) pairs."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def match_groups(window: int):
    """Arrow batches sorted by trigger to (trigger, digest, at, more): runs of repeated starts of each context."""
    def run(batches):
        rows = []
        for (trigger,), group in sorted_groups(batches, "trigger"):
            if len(group) == 1:  # its windows have different distances
                r = group[0]
                rows += [(trigger, r["digest"], 0, r["far"] - r["near"])] * (r["value"] > 1)
            else:
                found = repeated_windows([(r["context"], r["far"], r["far"] - r["near"] + 1, r["value"]) for r in group], window)
                for r, flags in zip(group, found):
                    rows += [(trigger, r["digest"], int(a), int(b - a)) for a, b in zip(*spans_of(flags))]
            if len(rows) > 10_000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)
    return run


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["trigger", "digest", "at", "more"])


def cut(window: int):
    """Arrow batches (doc_id, data, los, his) to the result row of each document and its kept bytes."""
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, los, his in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "los", "his"))):
                text = text or b""
                change = np.zeros(len(text) + 1, np.int32)
                if los:
                    np.add.at(change, los, 1)
                    np.add.at(change, np.array(his) + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc, len(text), len(text) - len(kept), len(spans_of(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(), pa.binary()))] if out else
                [pa.array([], t) for t in (pa.int64(),) * 4 + (pa.string(), pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Removes each byte covered by a `window`-byte string that also starts elsewhere in any text,
    its own included. Null texts are empty. Repeated rows are places of their own: each makes the
    other's windows repeated. Other columns are not looked at."""
    tables = Staged(docs.sparkSession)
    keyed = docs.select("doc_id", text_key().alias("key"), F.col("text").cast("binary").alias("data"))
    rows = keyed.select("key", "data").mapInArrow(
        contexts_of(window, gram), "trigger long, digest long, key long, first long, last long")
    hits = repeated_contexts(rows, tables, repeated=F.count("*") > 1)
    # the dictionary: each distinct context once, with the place of one occurrence
    words = tables.write(
        hits.groupBy("trigger", "digest").agg(F.count("*").alias("times"), F.min(F.struct("key", "first", "last")).alias("at")), "dictionary")
    several = words.groupBy("trigger").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("trigger")
    open_words = words.join(several, "trigger", "left_semi")
    wanted = open_words.groupBy(F.col("at.key").alias("key")).agg(
        F.collect_list(F.struct("trigger", "digest", "times", F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("wanted"))
    wanted = tables.write(wanted, "wanted")
    _, texts = with_lists(keyed.select("key", "data"), wanted, tables, "wanted")
    # repeated rows would give a context twice; either will do
    context = (texts.filter("wanted is not null").select("data", F.explode("wanted").alias("w"))
               .select("w.*", F.expr("substring(data, cast(w.first as int) + 1, cast(w.last - w.first as int) + %d)" % window).alias("context"))
               .withColumn("starts", F.col("last") - F.col("first") + 1).drop("first", "last"))
    context = context.groupBy("trigger", "digest").agg(*[F.first(c).alias(c) for c in ("times", "starts", "context")])
    located = context.mapInArrow(locate(gram, window), "trigger long, digest long, value long, near long, far long, context binary")
    located = tables.write(located.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(window - gram).cast("long")), "located")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def match(rows):
        return (rows.select("trigger", "digest", "value", "near", "far", "context").repartition(parts, "trigger").sortWithinPartitions("trigger")
                .mapInArrow(match_groups(window), "trigger long, digest long, at long, more long"))
    matched = in_small_groups(located, tables, match, window=window, unit=1, merged=F.sum, hot=hot)
    matched = matched.select("trigger", "digest", F.col("at").alias("lo"), (F.col("at") + F.col("more")).alias("hi"))
    several_times = words.filter("times > 1").select(
        "trigger", "digest", F.lit(0).cast("long").alias("lo"), (F.col("at.last") - F.col("at.first")).alias("hi"))
    once = words.filter("times = 1").select("trigger", "digest")
    found = tables.write(several_times.unionByName(matched.join(once, ["trigger", "digest"], "left_semi")), "found")
    run = F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    spans = tables.write(hits.join(found, ["trigger", "digest"]).groupBy("key").agg(F.collect_set(run).alias("runs"))
                         .select("key", F.col("runs.lo").alias("los"), F.col("runs.hi").alias("his")), "spans")
    tables.drop(*[n for n in tables.paths if not n.startswith("spans")])
    whole, parted = with_lists(keyed, spans, tables, "spans")
    done = whole.select("doc_id", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                        F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("kept_sha256"), F.coalesce("data", F.lit(b"")).alias("kept"))
    return done.unionByName(parted.select("doc_id", "data", "los", "his").mapInArrow(
        cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def locate(gram: int, window: int):
    """Find the trigger in each context again: the leftmost smallest hash of its first window."""
    def run(batches):
        for batch in batches:
            at = []
            for context in batch.column("context").to_pylist():
                data = np.frombuffer(context, np.uint8, window)
                at.append(trigger_place(data, gram))
            far = np.array(at, np.int64)
            near = far - batch.column("starts").to_numpy() + 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("trigger", "digest", "times")), pa.array(near), pa.array(far), batch.column("context")],
                names=["trigger", "digest", "value", "near", "far", "context"])
    return run


def trigger_place(data, gram):
    grams = Rolling(BYTE_VALUES[data]).grams(gram)
    low = np.uint64((1 << 20) - 1)
    return int(((grams & ~low) | np.arange(len(grams), dtype=np.uint64)).argmin())


def op2_suffix_dedup(spark, sf_dir):
    return dedup_substrings(documents(spark, sf_dir)).drop("kept")

