"""Substring dedup with FM-indexes.

Windows of 13 words are routed by a rolling-hash trigger, so that all places of one word sequence
meet in one shard; triggers of one document alone go no further. Each shard concatenates its
distinct contexts and builds a compressed FM-index: the Burrows-Wheeler transform in a wavelet
matrix of packed bits. The documents' windows are streamed through it by backward search, one
symbol of all of them at a time, and each that reaches the threshold length reports its interval
of suffixes; the smallest document in the interval decides."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.repeats import HOT, in_small_groups, repeated_contexts, with_lists
from corpuscope.llm.rolling import Rolling, anchored, word_hashes, word_spans
from corpuscope.llm.tables import Staged, documents, long_column, text_key

WINDOW = 13
GRAM = 5
# Words after which a shard's index is closed, once its last trigger is whole: that has at most HOT contexts.
SHARD_WORDS = 200_000
NO_ID = (1 << 63) - 1
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"


class WaveletMatrix:
    """Occurrences of symbols before positions of a sequence, from one packed bit row per bit of a symbol."""

    def __init__(self, symbols, alphabet):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.rows, current = [], symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            packed = np.zeros(len(bits) // 64 + 1, np.uint64)
            raw = np.packbits(bits, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            zeros = len(bits) - int(bits.sum())
            self.rows.append((packed, before, zeros))
            current = np.concatenate((current[~bits], current[bits]))
        self.first = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbols, at):
        for row, level in zip(self.rows, range(self.levels - 1, -1, -1)):
            packed, before, zeros = row
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols, at):
        return self._descend(symbols, at) - self.first[symbols]


def suffix_array(symbols, depth):
    """Positions in the order of their suffixes, compared to at least `depth` symbols."""
    rank, length = symbols.astype(np.int64), 1
    while True:
        following = np.zeros_like(rank)
        following[:-length or None] = rank[length:] + 1
        order = np.argsort(rank * (int(rank.max()) + 2) + following, kind="stable")
        if length * 2 >= depth:
            return order
        key = (rank * (int(rank.max()) + 2) + following)[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        length *= 2


class FMIndex:
    """Backward search over a sequence of symbols 0 .. alphabet - 1 that ends with symbol 0; patterns
    have at most `depth` symbols and no 0."""

    def __init__(self, symbols, alphabet, depth):
        # one symbol more than a pattern: the order has to hold for what follows its first symbol
        self.order = suffix_array(symbols, depth + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))[:-1]
        self.matrix = WaveletMatrix(symbols[self.order - 1], alphabet)

    def search(self, columns):
        """columns: the patterns' symbols, last first. Returns each pattern's interval of the suffix order."""
        low, high = np.zeros(len(columns[0]), np.int64), np.full(len(columns[0]), len(self.order))
        for symbol in columns:
            low = self.before[symbol] + self.matrix.rank(symbol, low)
            high = self.before[symbol] + self.matrix.rank(symbol, high)
        return low, high


def smallest_owners(contexts, owners, window):
    """For each context (word hashes) an array: per start, the smallest owner of its window anywhere here."""
    words = np.concatenate(contexts)
    lengths = np.array([len(c) for c in contexts])
    distinct, codes = np.unique(words, return_inverse=True)
    begin = np.cumsum(lengths + 1) - lengths - 1
    place = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(words))
    # contexts end with symbol 0, which no window holds
    symbols = np.zeros(len(words) + len(contexts), np.int64)
    symbols[place] = codes + 1
    owner = np.repeat(np.array(owners), lengths + 1)
    index = FMIndex(symbols, len(distinct) + 1, window)
    counts = lengths - window + 1
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    low, high = index.search([symbols[starts + k] for k in range(window - 1, -1, -1)])
    # equal windows have equal intervals and others disjoint ones
    unique, which = np.unique(low, return_inverse=True)
    end = np.zeros(len(unique), np.int64)
    end[which] = high
    bounds = np.stack((unique, end), 1).ravel()
    sorted_owner = np.append(owner[index.order], NO_ID)
    smallest = np.minimum.reduceat(sorted_owner, bounds)[::2]
    return np.split(smallest[which], np.cumsum(counts)[:-1])


def contexts_of(window, gram):
    """Arrow batches (key, doc, data) to one row per trigger context."""
    def run(batches):
        for batch in batches:
            parts = []
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "data"))):
                trigger, digest, first, last = anchored(word_hashes(text), window, gram)
                if len(first):
                    parts.append((trigger, digest, np.full(len(first), key), np.full(len(first), doc), first, last))
            if parts:
                trigger, digest, *rest = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([long_column(trigger), long_column(digest), *map(pa.array, rest)],
                                                 names=["trigger", "digest", "key", "doc", "first", "last"])
    return run


def trigger_places(words, firsts, window, gram):
    """Where in each window that starts at `firsts` the leftmost smallest hash of `gram` words is, as `anchored` chooses it."""
    within = np.arange(window - gram + 1)
    grams = Rolling(words).grams(gram)[firsts[:, None] + within]
    return (grams & ~np.uint64((1 << 20) - 1) | within.astype(np.uint64)).argmin(axis=1)


def fetch(window, gram):
    """Arrow batches (data, wanted) to (trigger, digest, value, near, far, context): the asked contexts of
    each text, with their document and the distances of their starts before the trigger."""
    def run(batches):
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist()):
                words = word_hashes(text)
                places = trigger_places(words, np.array([w["first"] for w in wanted]), window, gram).tolist()
                for w, far in zip(wanted, places):
                    rows.append((w["trigger"], w["digest"], w["doc"], far - w["last"] + w["first"], far, words[w["first"]: w["last"] + window].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 5 + (pa.binary(),))],
                names=["trigger", "digest", "value", "near", "far", "context"])
    return run


def shards(window, shard_words=SHARD_WORDS):
    """Arrow batches sorted by trigger to (trigger, digest, at, owners): whole triggers, a shard at a time."""
    def solve(rows):
        found = smallest_owners([np.frombuffer(r[3], np.uint64) for r in rows], [r[2] for r in rows], window)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([0] * len(rows), pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))],
            names=["trigger", "digest", "at", "owners"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "digest", "value", "context"))):
                if size >= shard_words and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[3]) // 8
        if held:
            yield solve(held)
    return run


def cut(window):
    """Arrow batches (doc_id, data, starts) to the result row of each document and its kept words."""
    def run(batches):
        types = (pa.int64(),) * 3 + (pa.string(), pa.binary())
        for batch in batches:
            out = []
            for doc, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "starts"))):
                text = text or b""
                begins, ends = word_spans(np.frombuffer(text, np.uint8))
                change = np.zeros(len(begins) + 1, np.int32)
                if starts:
                    np.add.at(change, starts, 1)
                    np.add.at(change, np.array(starts) + window, -1)
                stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                kept = b" ".join([text[a:b] for a, b in zip(begins[stays].tolist(), ends[stays].tolist())])
                out.append((doc, len(begins), len(begins) - len(stays), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_words, n_removed, kept_sha256, kept (binary, words joined by a space).

    Removes each word covered by a `window`-word sequence that also starts in a document of a smaller
    doc_id. Null texts have no words. A null doc_id is larger than all others; rows that repeat a
    doc_id do not remove each other's words. Other columns are not looked at."""
    tables = Staged(docs.sparkSession)
    keyed = docs.select("doc_id", text_key().alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
                        F.col("text").cast("binary").alias("data"))
    rows = keyed.select("key", "doc", "data").mapInArrow(
        contexts_of(window, gram), "trigger long, digest long, key long, doc long, first long, last long")
    hits = repeated_contexts(rows, tables, repeated=F.min("doc") < F.max("doc"))
    dictionary = hits.groupBy("trigger", "digest").agg(F.min(F.struct("doc", "key", "first", "last")).alias("at"))
    wanted = tables.write(dictionary.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct(
        "trigger", "digest", F.col("at.doc").alias("doc"), F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("wanted")), "wanted")
    _, texts = with_lists(keyed.select("key", "data"), wanted, tables, "wanted")
    contexts = texts.filter("wanted is not null").select("data", "wanted").mapInArrow(
        fetch(window, gram), "trigger long, digest long, value long, near long, far long, context binary")
    contexts = tables.write(contexts.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(window - gram).cast("long")), "located")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def match(rows):
        return (rows.select("trigger", "digest", "value", "context").repartition(parts, "trigger").sortWithinPartitions("trigger")
                .mapInArrow(shards(window), "trigger long, digest long, at long, owners array<long>"))
    owners = in_small_groups(contexts, tables, match, window=window, unit=8, merged=F.min, hot=hot)
    # repeated rows fetch a context twice, with the same answer
    owners = tables.write(owners.groupBy("trigger", "digest", "at").agg(F.first("owners").alias("owners")), "owners")
    starts = (hits.join(owners, ["trigger", "digest"])
              .select("key", "doc", (F.col("first") + F.col("at")).alias("first"), F.posexplode("owners").alias("k", "owner")).filter("owner < doc")
              .groupBy("key").agg(F.collect_set(F.col("first") + F.col("k")).alias("starts")))
    starts = tables.write(starts, "starts")
    tables.drop(*[n for n in tables.paths if not n.startswith("starts")])
    whole, parted = with_lists(keyed.drop("doc"), starts, tables, "starts")
    kept = F.regexp_replace(F.btrim(F.coalesce(F.col("data").cast("string"), F.lit("")), F.lit(WHITE)), r"[\x20\x09-\x0D]+", " ")
    done = whole.select("doc_id", kept.alias("kept")).select(
        "doc_id", F.when(F.col("kept") == "", 0).otherwise(F.length("kept") - F.length(F.replace("kept", F.lit(" "), F.lit(""))) + 1)
        .cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.col("kept").cast("binary").alias("kept"))
    return done.unionByName(parted.select("doc_id", "data", "starts").mapInArrow(
        cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"))


def op7_fm_dedup(spark, sf_dir):
    return dedup_passages(documents(spark, sf_dir)).drop("kept")
