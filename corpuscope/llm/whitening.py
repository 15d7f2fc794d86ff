"""Embedding whitening by shifted CholeskyQR.

The centred distinct rows Y are brought to orthonormal columns by three distributed passes. Each
sums the Gram matrix of Y R^-1 over all tasks, R being what the passes before have gathered; the
driver factors the small matrix and puts the factor before R. The first Gram matrix is shifted, so that
Cholesky cannot fail however ill-conditioned Y is. The singular value decomposition of R then has
the covariance's eigenvectors and the roots of its eigenvalues, without the squared condition
number that an eigendecomposition of the Gram matrix would have."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.tables import Staged
from corpuscope.llm.training import packed, summed, unpacked

# Numbers per unit: entries are floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
PASSES = 3
# Entries of a matrix in one row while matrices are summed.
CHUNK = 1 << 16
# Eigenvalues up to this share of their sum are rounding errors.
RANK = 1e-13
MAX_LONG = (1 << 63) - 1


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the rows whose vector has neither nulls nor non-finite entries, as whole numbers.

    Rows with empty vectors, and those whose width is not the most frequent one (of equals the
    largest), are left out too: they have no place in a matrix."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    whole = rows.select("vec_id", c.alias("c")).filter(
        "c is not null and size(c) > 0 and forall(c, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    return whole.select("vec_id", F.transform("c", lambda e: F.floor(e * F.lit(float(scale))) + F.lit(0)).alias("x"))


def _matrix(batch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _parts(values, number):
    flat = values.ravel()
    return [{"chunk": k, "part": number, "data": packed(flat[at: at + CHUNK])} for k, at in enumerate(range(0, len(flat), CHUNK))]


_PARTS = pa.schema([("chunk", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _whole(parts: DataFrame, dtype, shape):
    """The sum of all tasks' matrices: as large as one matrix, however many tasks there are."""
    found = {r["chunk"]: unpacked(r["data"], dtype) for r in summed(parts, dtype).collect()}
    flat = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(int(np.prod(shape)), dtype)
    return flat.reshape(shape)


def column_sums(fit: DataFrame):
    """(n, S) of the rows: exact sums. Where they could leave 64 bits they are added as Python numbers."""
    n = F.count("*").alias("n")
    largest = F.max(F.array_max(F.transform("x", lambda e: F.abs(e.cast("decimal(20,0)"))))).alias("largest")
    width = F.max(F.size("x")).alias("width")
    seen = fit.agg(n, largest, width).first()
    if not seen["n"]:
        return 0, np.zeros(0, np.int64)
    if int(seen["largest"]) * seen["n"] > MAX_LONG:
        each = fit.select(F.posexplode("x").alias("dim", "e")).groupBy("dim").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s"))
        return seen["n"], np.array([int(r["s"]) for r in each.orderBy("dim").collect()], object)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                here = _matrix(batch).sum(axis=0)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pylist(_parts(total, _task()), _PARTS)

    return seen["n"], _whole(fit.mapInArrow(run, "chunk int, part long, data binary"), np.int64, (seen["width"],))


def gram(fit: DataFrame, mean: np.ndarray, factor: np.ndarray | None) -> np.ndarray:
    """Q^T Q of Q = (rows - mean) factor^-1, summed over all tasks; a task holds one batch and one matrix."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch) - mean
                if factor is not None:  # the triangular system R^T Q^T = Y^T, not an inverse
                    rows = _solved(factor, rows)
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_pylist(_parts(total, _task()), _PARTS)

    return _whole(fit.mapInArrow(run, "chunk int, part long, data binary"), np.float64, (len(mean), len(mean)))


def _solved(upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows upper^-1 by forward substitution over columns."""
    out = np.empty_like(rows)
    for k in range(len(upper)):
        out[:, k] = (rows[:, k] - out[:, :k] @ upper[:k, k]) / upper[k, k]
    return out


def _cholesky(matrix: np.ndarray, shift: float) -> np.ndarray:
    """Upper R with R^T R = matrix + shift; the shift grows until the factor exists."""
    least = max(float(np.trace(matrix)) * np.finfo(float).eps, np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(len(matrix))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 16, least)


def orthogonal_factor(fit: DataFrame, n: int, mean: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """R with Y = Q R and Q orthonormal.

    The first shift is 11 (m n + n (n + 1)) u |Y|^2, at which Cholesky of the rounded Gram matrix is safe. Where
    columns depend on each other, later passes need a shift of their own size, and Q spans them with columns of
    no length; R still has their zero singular values."""
    width, eps = len(mean), np.finfo(float).eps / 2
    factor = None
    for k in range(passes):
        matrix = gram(fit, mean, factor)
        norm = float(np.linalg.norm(matrix, 2)) if width else 0.0
        if k == 0 and not norm:  # all rows are the mean
            return np.zeros((width, width))
        upper = _cholesky(matrix, 11 * (n * width + width * (width + 1)) * eps * norm if k == 0 else 0.0)
        factor = upper if factor is None else upper @ factor
    return factor


def components(fit: DataFrame, wanted: int = COMPONENTS):
    """(n, S, vectors, eigenvalues, trace): the first components of the covariance, by falling eigenvalue.

    Each vector's entry of largest size is positive. Where the rows have fewer directions, so have the answers."""
    n, sums = column_sums(fit)
    if not n:
        return 0, sums, np.zeros((0, 0)), np.zeros(0), 0.0
    mean = np.array([float(int(s) / n) for s in sums])
    factor = orthogonal_factor(fit, n, mean)
    _, singular, vectors = np.linalg.svd(factor)
    values = singular ** 2 / n
    trace = float(values.sum())
    known = min(wanted, int((values > RANK * max(trace, np.finfo(float).tiny)).sum()))
    vectors = vectors[:known]
    signs = np.sign(vectors[np.arange(known), np.abs(vectors).argmax(axis=1)]) if known else np.ones(0)
    return n, sums, vectors * signs[:, None], values[:known], trace


def _projected(rows, mean, vectors, values):
    return (rows - mean) @ vectors.T / np.sqrt(values)


def identity_error(fit: DataFrame, n, mean, vectors, values) -> float:
    """How far the covariance of the whitened rows is from the identity, at its worst entry."""
    if not len(values):
        return 0.0

    def run(batches):
        total = np.zeros((len(values), len(values) + 1))
        for batch in batches:
            if batch.num_rows:
                white = _projected(_matrix(batch), mean, vectors, values)
                total += np.concatenate((white.T @ white, white.sum(axis=0)[:, None]), axis=1)
        yield pa.RecordBatch.from_pylist(_parts(total, _task()), _PARTS)

    total = _whole(fit.mapInArrow(run, "chunk int, part long, data binary"), np.float64, (len(values), len(values) + 1)) / n
    return float(np.abs(total[:, :-1] - np.outer(total[:, -1], total[:, -1]) - np.eye(len(values))).max())


def _deviations(rows, n, sums):
    """sum (n x - S)^2 per row, exactly; null where it leaves 64 bits."""
    if not len(rows):
        return []
    reach = n * max(abs(int(rows.min())), abs(int(rows.max()))) + max(abs(int(s)) for s in sums)
    if len(sums) * reach ** 2 <= MAX_LONG:
        away = n * rows - np.array([int(s) for s in sums], np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * x - int(s)) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
    return [d if d <= MAX_LONG else None for d in exact]


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """`embeddings` (vec_id, embedding) to one row per kept row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Kept are the rows of `scaled`. Each distinct vector counts once in the fit; rows that repeat a vector or
    an id are answered each, null ids stay null. Where the covariance has fewer than `wanted` directions, the
    rows of the missing components (up to the width) have whitened and explained 0. A deviation beyond 64 bits is null.
    Other columns, of whatever names, are not looked at. No rows give no rows."""
    spark, tables = embeddings.sparkSession, Staged(embeddings.sparkSession)
    rows = tables.write(scaled(embeddings), "vectors")
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = common["width"] if common else 0
    rows = rows.filter(F.size("x") == width)
    # copies go within each task first, so a vector of a third of all rows is one row per task
    fit = tables.write(rows.select("x").distinct(), "distinct")
    n, sums, vectors, values, trace = components(fit, wanted)
    mean = np.array([float(int(s) / n) for s in sums]) if n else np.zeros(width)
    error = identity_error(fit, n, mean, vectors, values)
    shown, known = min(wanted, width), len(values)
    explained = [float(v / trace) for v in values] + [0.0] * (shown - known)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            white = np.zeros((len(x), shown))
            if known:
                white[:, :known] = _projected(x, mean, vectors, values)
            take = pa.array(np.repeat(np.arange(len(x)), shown))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * shown, n, np.int64)), pa.array(_deviations(x, n, sums), pa.int64()).take(take),
                pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * shown, error))], names=names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
