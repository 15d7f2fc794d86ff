"""Hashed text embedding and cosine similarity."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuscope.functions.text import EMBED_DELIMITERS, embed_tokens
from corpuscope.schemas import EMBEDDING_DIM

# A worker remembers this many tokens (15 MB) before it starts over.
_CACHE_TOKENS = 100_000


class _TokenBytes(dict):
    """token -> the four digest bytes that name its dimensions; a miss hashes the token once."""

    def __missing__(self, token):
        import hashlib

        if not token:
            return b""
        if len(self) >= _CACHE_TOKENS:
            self.clear()
        named = self[token] = hashlib.sha256(token).digest()[3:16:4]
        return named


def _embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import numpy as np

    to_blank = bytes.maketrans(EMBED_DELIMITERS.encode(), b" " * len(EMBED_DELIMITERS))
    digest_bytes = _TokenBytes().__getitem__
    for texts in batches:
        counts = np.empty((len(texts), EMBEDDING_DIM))
        for row, text in enumerate(texts):
            tokens = (text.as_py() or b"").translate(to_blank).split(b" ")
            named = np.frombuffer(b"".join(map(digest_bytes, tokens)), np.uint8)
            counts[row] = np.bincount(named % EMBEDDING_DIM, minlength=EMBEDDING_DIM)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        vectors = counts / np.where(norms > 0, norms, 1.0)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * EMBEDDING_DIM
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))


def embed_text(text: Column) -> Column:
    """128 doubles of length 1 (zeros for a text without tokens).

    Each token adds 1 to the four dimensions given by its sha256: the big-endian
    words of the digest modulo 128, which is bytes 3, 7, 11 and 15 modulo 128."""
    udf = F.arrow_udf(_embed_batches, T.ArrayType(T.DoubleType()))
    return udf(text.cast("binary"))


def embed_text_native(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same numbers as (key, dim, weight) rows from built-in operators only.

    Slower than `embed_text`; it is what the Arrow version is tested against."""
    slots = F.flatten(F.transform(embed_tokens(F.col(text)), lambda t: F.transform(
        F.array(*[F.lit(i) for i in (7, 15, 23, 31)]),
        lambda i: F.conv(F.substring(F.sha2(t, 256), i, 2), 16, 10).cast("int") % EMBEDDING_DIM)))
    counts = df.select(key, F.explode(slots).alias("dim")).groupBy(key, "dim").count()
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("norm"))
    return counts.join(norms, key).select(key, "dim", (F.col("count") / F.col("norm")).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / (norms + 1e-8): the small term keeps zero vectors at 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def has_embedding(embedding: Column, width: int = EMBEDDING_DIM) -> Column:
    return embedding.isNotNull() & (F.size(embedding) == width)
