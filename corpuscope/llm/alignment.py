"""Cross-tokenizer alignment with an identity map as the fast path.

Two tokenizers cut the same bytes. Where tokens of both end at one byte, a group ends; within a
group every token is linked with those of the other side whose bytes it overlaps. An array from A
ids to the B ids of the same bytes is made beforehand: a group of one A and one B token that the
array maps onto each other is counted in a vector as long as A's vocabulary. Only the pairs of the
other groups are shuffled, once per batch of documents that holds them.

Documents are read once. What a batch needs for its answers is written beside it: the distinct
words, their pairs, and the words of each document by number. The corpus-wide counts of a batch's
pairs come back to it by its number."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.tables import Staged, documents
from corpuscope.llm.training import packed, summed, unpacked
from corpuscope.llm.workers import kept, tidy

# Bytes of text that one batch holds at most (a longer document is a batch of its own).
BATCH_BYTES = 2 << 20
# Words that a Python worker keeps from batch to batch, and their bytes.
CACHED_WORDS, CACHED_BYTES = 150_000, 16 << 20
# Characters of new words that a tokenizer reads at a time.
READ_TOGETHER = 8192
# Vector entries per row while vectors are summed.
CHUNK = 8192
_ANCHOR = "a"
# Fixed value: how byte-level tokenizers cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = " \n\t"


def byte_of_symbol() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as themselves,
    the others as the letters from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _runs(counts):
    """For runs of the given lengths: the number of the run that each element is in."""
    return np.repeat(np.arange(len(counts)), counts)


class _Tokens:
    """The bytes of all ids of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def joined(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    """Aligns texts by their words.

    A word is white space and what follows it. Both tokenizers must end a token before it; this
    is looked up in their files (`_white`): the first cuts text by the pattern of byte-level
    tokenizers, and no piece of the second goes on from another character to that white space.
    Where that does not hold, a whole text is one word."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_of_symbol()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        self.bytes_a = _Tokens(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _Tokens([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                for i, p in enumerate(pieces)])
        self.same = identity_map(self.bytes_a.tokens, self.bytes_b.tokens)
        self.anchor = self.b.piece_to_id("▁" + _ANCHOR)
        spec = json.loads(self.a.to_str())
        self.white = self._white(spec, pieces)
        self.read_many = self._reader(spec) if self.white else self._read_a
        self.render = [[f"{mark}{i}" for i in range(max(len(tokens), len(pieces)))] for mark in "\n;,|"]
        self._clear()

    def _read_a(self, text):
        return self.a.encode(text, add_special_tokens=False).ids

    def _reader(self, spec):
        """A faster reader of the same ids, where the file's merges are numbered in their order."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocabulary, known = spec["model"]["vocab"], len(byte_of_symbol())
        in_order = all(vocabulary.get(x + y) == known + k for k, (x, y) in enumerate(merges))
        if not in_order or len(vocabulary) - len(merges) - known > len(spec["added_tokens"]):
            return self._read_a
        ranks = {self.bytes_a.tokens[i]: i for i in range(known + len(merges))}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _white(self, spec, pieces) -> bytes:
        """White space before which both tokenizers end a token, unless more white space stands before it."""
        cutter = spec.get("pre_tokenizer") or {}
        known = (cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
                 and not spec.get("normalizer") and self._plain() and self.b.id_to_piece(self.anchor) == "▁" + _ANCHOR)
        if not known:
            return b""
        def joined(white):
            mark = "▁" if white == " " else white
            return any(mark in p[1:] and any(q == mark and not p[k].isspace() and p[k] != "▁" for k, q in enumerate(p[1:])) for p in pieces)
        return "".join(w for w in _WHITE if not joined(w)).encode()

    def _plain(self) -> bool:
        """Whether the second tokenizer takes texts as they are, with one space put before."""
        return all(self.b.decode(self.b.encode(t)) == t for t in ("a  b", "ﬁ Ω", " a ", "Á\n\n b\t"))

    def _clear(self):
        self.index, self.held = {}, 0
        self.n_a = self.n_b = self.n_groups = np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)
        self.rendered = []
        self.links, self.link_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def forget(self):
        """Drop what is known of words, at the end of a task: most words of a later one are others."""
        self._clear()

    def words(self, data: np.ndarray, starts: np.ndarray):
        """Offsets of all words; every text begins one."""
        cut = np.zeros(len(data) + 1, bool)
        if self.white and len(data) > 3:
            white = np.isin(data, np.frombuffer(self.white, np.uint8))
            before, second, third = data[2:-1], data[1:-2], data[:-3]
            # no cut after a byte that may end a blank of more bytes than one, so that none is taken for a letter
            blank = (before <= 32) | ((before >= 0x1C) & (before <= 0x1F)) | (before == 0x7F) | (
                (before >= 0x80) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))))
            cut[3:-1] = white[3:] & ~blank
            cut[1:3] = white[1:3] & (data[0:2] > 32) & (data[0:2] < 127)
        cut[starts] = True
        cut[-1] = True
        return np.flatnonzero(cut)

    def _learn(self, fresh: list[bytes]):
        """Pairs and groups of words that are not known yet."""
        texts, many = [w.decode() for w in fresh], len(fresh)
        sizes = np.fromiter(map(len, fresh), np.int64, many)
        ids_a, n_a = self._ids(texts, sizes, self.bytes_a, self.read_many, self._read_a)
        read_b = (lambda t: self.b.encode(_ANCHOR + t)[1:]) if self.white else (lambda t: self.b.encode(t[1:]))
        ids_b, n_b = self._ids(texts, sizes, self.bytes_b, read_b, read_b)
        long_a, long_b = self.bytes_a.lengths[ids_a], self.bytes_b.lengths[ids_b]
        bad = np.zeros(many, bool)
        for ids, long, n, tokens in ((ids_a, long_a, n_a, self.bytes_a), (ids_b, long_b, n_b, self.bytes_b)):
            bad |= np.bincount(_runs(n), long, many).astype(np.int64) != sizes
        for ids, n, tokens in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            good = ~bad
            made = np.frombuffer(tokens.joined(ids[good[_runs(n)]].tolist()), np.uint8)
            given = np.frombuffer(b"".join(w for w, g in zip(fresh, good.tolist()) if g), np.uint8)
            wrong = np.bincount(np.repeat(np.flatnonzero(good), sizes[good]), made != given, many) > 0
            bad |= wrong
        keep_a, keep_b = ~bad[_runs(n_a)], ~bad[_runs(n_b)]
        ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
        n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        ends_a, ends_b = np.cumsum(self.bytes_a.lengths[ids_a]), np.cumsum(self.bytes_b.lengths[ids_b])
        # both are sorted, so a stable sort merges them
        every = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        twice = every[1:] == every[:-1]
        common = every[1:][twice]
        every = every[np.concatenate(([True], ~twice))] if len(every) else every
        word_ends = np.cumsum(np.where(bad, 0, sizes))
        # between two ends that follow each other lie one A and one B token: a link
        a, b = ids_a[np.searchsorted(ends_a, every)], ids_b[np.searchsorted(ends_b, every)]
        whole = np.zeros(len(every), bool)
        whole[np.searchsorted(every, common)] = True
        alone = whole & np.concatenate(([True], whole[:-1])) if len(every) else whole
        fast = alone & (self.same[a] == b)
        links = np.where(fast, -1 - a, (a << 32) | b)
        n_links = np.diff(np.searchsorted(every, word_ends, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(common, word_ends, "right"), prepend=0)

        self.rendered += self._rendered(ids_a, ids_b, ends_a, ends_b, common, n_a, n_b, bad)
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + many)))
        self.held += int(sizes.sum())
        self.n_a, self.n_b = np.concatenate((self.n_a, n_a)), np.concatenate((self.n_b, n_b))
        self.n_groups, self.bad = np.concatenate((self.n_groups, n_groups)), np.concatenate((self.bad, bad))
        self.links = np.concatenate((self.links, links))
        self.link_at = np.concatenate((self.link_at, self.link_at[-1] + np.cumsum(n_links)))

    def _ids(self, words, sizes, tokens, read_many, read_one):
        """The ids of all words, one after the other, and how many each has.

        Words that do not end with white space are read many at a time: between them a token ends, as
        white space follows. Their ids are told apart by their bytes; where a tokenizer changes bytes,
        and for very long words, each is read on its own."""
        plain = [bool(self.white) and len(w) <= READ_TOGETHER and not w[-1].isspace() for w in words]
        ids, counts = [], []
        first = 0
        while first < len(words):
            last, held = first, 0
            while last < len(words) and plain[last] and held < READ_TOGETHER:
                held += len(words[last])
                last += 1
            if last > first:
                found = np.array(read_many("".join(words[first:last])), np.int64)
                ends, wanted = np.cumsum(tokens.lengths[found]), np.cumsum(sizes[first:last])
                after = np.searchsorted(ends, wanted)
                if len(ends) and ends[-1] == wanted[-1] and (ends[after] == wanted).all():
                    ids.append(found)
                    counts.append(np.diff(after + 1, prepend=0))
                    first = last
                    continue
            for word in words[first:max(last, first + 1)]:
                ids.append(np.array(read_one(word), np.int64))
                counts.append(np.array([len(ids[-1])]))
            first = max(last, first + 1)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _rendered(self, ids_a, ids_b, ends_a, ends_b, common, n_a, n_b, bad):
        """`a1,a2|b1;a3|b2` of each word."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_a = np.diff(group_a, prepend=-1) > 0
        first_b = np.diff(group_b, prepend=-1) > 0
        word_a = _runs(n_a)
        word_start = np.diff(word_a, prepend=-1) > 0
        mark_a = np.where(word_start, 0, np.where(first_a, 1, 2))
        mark_b = np.where(first_b, 3, 2)
        order = np.lexsort((np.concatenate((np.arange(len(ids_a)), np.arange(len(ids_b)))),
                            np.concatenate((np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8))),
                            np.concatenate((group_a, group_b))))
        marks = np.concatenate((mark_a, mark_b))[order].tolist()
        ids = np.concatenate((ids_a, ids_b))[order].tolist()
        render = self.render
        good = iter("".join([render[m][i] for m, i in zip(marks, ids)]).split("\n")[1:])
        return [b"" if b else next(good).encode() for b in bad.tolist()]

    def align(self, texts: pa.Array):
        """What the documents of one batch have, and the words that they consist of.

        `texts` are binary, null or empty for none."""
        filled = texts.fill_null(b"")
        has = pc.greater(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False)
        filled = filled.cast(pa.large_binary()).filter(pa.array(has))
        spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), filled, pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]] if len(spaced) else np.zeros(0, np.uint8)
        starts = self.words(data, offsets[:-1]) if len(spaced) else np.zeros(1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        unique, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        if len(self.index) > CACHED_WORDS or self.held > CACHED_BYTES:
            self._clear()
        fresh = [w for w in unique if w not in self.index]
        if fresh:
            self._learn(fresh)
        known = np.fromiter(map(self.index.__getitem__, unique), np.int64, len(unique))
        at = np.searchsorted(starts, offsets)  # words before each text
        return self._batch(has, known, codes, at)

    def _batch(self, has, known, codes, at):
        total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values[known][codes]))) [at]) if len(codes) else np.zeros(len(at) - 1, np.int64)
        good = total(self.bad) == 0
        rendered = [self.rendered[k] for k in known.tolist()]
        listed = codes.tolist()
        digests = [hashlib.sha256(b";".join([rendered[c] for c in listed[s:e]])).hexdigest() if g else ""
                   for s, e, g in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
        groups, a, b = (np.where(good, total(v), 0) for v in (self.n_groups, self.n_a, self.n_b))
        codes = codes[np.repeat(good, np.diff(at))]
        times = np.bincount(codes, minlength=len(known))
        n_words = np.where(good, np.diff(at), 0)
        n_links = self.link_at[known + 1] - self.link_at[known]
        place = np.repeat(self.link_at[known] - np.concatenate(([0], np.cumsum(n_links)[:-1])), n_links) + np.arange(int(n_links.sum()))
        links = self.links[place]
        weight = np.repeat(times, n_links)
        fast = links < 0
        single = np.bincount(-1 - links[fast], weight[fast], len(self.same)).astype(np.int64)
        pairs, which = np.unique(links[~fast], return_inverse=True)
        counts = np.bincount(which, weight[~fast], len(pairs)).astype(np.int64)
        # a link is an A id below 0, or the place of its pair among the batch's pairs
        links = links.copy()
        links[~fast] = which
        many = len(has)
        shas = np.full(many, "", object)
        shas[has] = digests
        return dict(n_a=_spread(a, has, many), n_b=_spread(b, has, many), n_groups=_spread(groups, has, many), sha=shas, n_words=_spread(n_words, has, many), codes=codes,
                    n_links=n_links.astype(np.int32), links=links.astype(np.int32), pairs=pairs, counts=counts, single=single)


def _spread(values, has, many):
    out = np.zeros(many, np.int64)
    out[has] = values
    return out


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes (the smallest that is not a lone byte's, if there is one), else -1."""
    by_bytes = {}
    for i in sorted(range(len(b)), key=lambda i: (len(b[i]) == 1, -i), reverse=False):
        by_bytes.setdefault(b[i], i)
    return np.array([by_bytes.get(t, -1) if t else -1 for t in a], np.int64)


def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, for later tasks of the worker."""
    return kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _slices(batch):
    """Parts of an Arrow batch of at most `BATCH_BYTES` of text, one document at least."""
    sizes = pc.binary_length(batch.column("data")).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - 1) // BATCH_BYTES if len(sizes) else sizes
    edges = np.flatnonzero(np.diff(part, prepend=-2)).tolist() + [batch.num_rows]
    for first, last in zip(edges, edges[1:]):
        yield batch.slice(first, last - first)


_BATCH = ("batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, shas array<string>, "
          "n_words binary, codes binary, n_links binary, links binary, pairs array<long>, counts array<long>, chunk int, data binary")
# A row holds a batch of documents. A row group is read whole, and a writer counts its bytes every hundred rows at the
# earliest, so row groups are ended by their rows.
_ROW_GROUPS = {"parquet.block.row.count.limit": "4"}


def _encode(path_a, path_b):
    def run(batches):
        aligner = shared_aligner(path_a, path_b)
        single, number, task = np.zeros(len(aligner.same), np.int64), 0, TaskContext.get().partitionId()
        schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups")),
                            ("shas", pa.list_(pa.string())), *((n, pa.binary()) for n in ("n_words", "codes", "n_links", "links")),
                            ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("chunk", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for part in _slices(batch):
                found = aligner.align(part.column("data"))
                single += found["single"]
                row = {n: found[n].tolist() for n in ("n_a", "n_b", "n_groups", "pairs", "counts")}
                row |= {n: found[n].tobytes() for n in ("n_words", "codes", "n_links", "links")}
                row |= {"batch": (task << 32) + number, "doc_ids": part.column("doc_id").to_pylist(), "shas": found["sha"].tolist()}
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema)
        aligner.forget()
        if number:  # the task's vector, in parts
            yield pa.RecordBatch.from_pylist([{"chunk": k, "batch": task, "data": packed(single[at: at + CHUNK])}
                                              for k, at in enumerate(range(0, len(single), CHUNK))], schema)
    return run


def _answer(totals, best):
    """Per document the links whose pair is the best of its B id, and the sum of the pairs' counts."""
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        row = batch.to_pylist()[0]
        n_links, links = np.frombuffer(row["n_links"], np.int32), np.frombuffer(row["links"], np.int32).astype(np.int64)
        codes, n_words = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["n_words"], np.int64)
        total, top = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
        place = answers.column("place").to_numpy()
        total[place], top[place] = answers.column("total").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
        fast = links < 0
        value, is_best = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
        value[fast], is_best[fast] = totals[-1 - links[fast]], best[-1 - links[fast]]
        value[~fast], is_best[~fast] = total[links[~fast]], top[links[~fast]]
        ends, at = np.concatenate(([0], np.cumsum(n_links))), np.concatenate(([0], np.cumsum(n_words)))
        def per_document(values):
            per_word = np.diff(np.concatenate(([0], np.cumsum(values)))[ends])
            return np.diff(np.concatenate(([0], np.cumsum(per_word[codes])))[at])
        n_a, n_b, n_groups = (np.array(row[n], np.int64) for n in ("n_a", "n_b", "n_groups"))
        columns = [row["doc_ids"], n_a, n_b, n_groups, n_a + n_b - n_groups, per_document(is_best), per_document(value)]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(row["shas"], pa.string())], names=_RESULT)
    return run


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A (byte-level BPE) reads a space and the text, B (pieces, which puts a space before)
    the text. Null and empty texts, and texts whose bytes either tokenizer changes, have no tokens:
    zeros and an empty groups_sha256; they count nowhere. Rows that repeat an id or a text count and are
    answered each; a null id stays null. Of equal highest counts of a B id every one is best. Other
    columns are not looked at. An empty table gives no rows.

    Collected are vectors as long as a vocabulary; a task holds one batch of documents (`BATCH_BYTES`) and
    its distinct pairs."""
    spark, tables = docs.sparkSession, Staged(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    encoded = tables.write(rows.mapInArrow(tidy(_encode(path_a, path_b), keeps=True), _BATCH), "aligned", **_ROW_GROUPS)
    vectors = summed(encoded.filter("chunk is not null").select("chunk", F.col("batch").alias("part"), "data"), np.int64)
    parts = {r["chunk"]: unpacked(r["data"], np.int64) for r in vectors.collect()}
    aligner = shared_aligner(path_a, path_b)
    same = aligner.same
    single = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(len(same), np.int64)
    ids = np.flatnonzero(single)
    alone = spark.createDataFrame([(int(a << 32 | same[a]), int(single[a])) for a in ids], "pair long, n long")

    batches = encoded.filter("chunk is null")
    held = batches.select("batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select(
        "batch", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = held.select("pair", "n").unionByName(alone).groupBy("pair").agg(F.sum("n").alias("total"))
    counts = tables.write(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    # one row per B id: no larger than its vocabulary
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    counts = counts.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    # the identity pairs: no more than A's vocabulary
    known = counts.join(F.broadcast(alone.select("pair")), "pair").collect()
    totals, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for r in known:
        totals[r["pair"] >> 32], best[r["pair"] >> 32] = r["total"], r["best"]
    answers = held.select(F.col("batch").alias("of_batch"), "place", "pair").join(counts, "pair").select("of_batch", "place", "total", "best")
    result = "doc_id long, " + ", ".join(f"{n} long" for n in _RESULT[1:-1]) + ", groups_sha256 string"
    payload = batches.select("batch", "doc_ids", "n_a", "n_b", "n_groups", "shas", "n_words", "codes", "n_links", "links")
    return payload.groupBy("batch").cogroup(answers.groupBy("of_batch")).applyInArrow(_answer(totals, best), result)


def op13_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
