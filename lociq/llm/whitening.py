"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X, the centred rows, stays dealt over the cluster. Each step makes one pass over it: a task multiplies its
rows with the next right vector (Xv) and, while it still has them, with the result (X'u), and adds up what
both vectors must be made orthogonal to. Left vectors have an entry for each row, so they aren't kept:
each is X times a short vector that is, and its entries are made again in the pass. What leaves a task
is a few sums for each dimension. The small bidiagonal matrix's singular values and vectors, on the driver,
give the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, release_memory, stored

COMPONENTS = 32
#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Numbers that one numpy pass looks at, and tasks whose sums are added on the driver; those of more tasks
#: are added in a shuffle first.
CHUNK_NUMBERS, FEW_TASKS = 1 << 20, 1_000
#: A singular triplet is settled when its residual is below this part of the largest singular value.
SETTLED = 1e-15
#: Below this part of the largest, a length is what rounding left.
NOTHING = 1e-13
LONG = 2**62


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d int, x binary): the usable rows, x the d whole numbers as little-endian longs.

    A row is usable if its vector is there and neither null nor infinite nor NaN in any entry. Entries too
    large for a long are taken as the largest that is safe (2 ** 62 in size)."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten()
            at = np.concatenate([[0], np.cumsum(np.where(vectors.is_valid().to_numpy(zero_copy_only=False), sizes, 0))])
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # null is NaN here
            keep = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]))
            # Floats up to 2 ** 52 are exact here, larger ones are whole numbers already.
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.clip(np.floor(values * SCALE), -LONG, LONG - SHIFT)
            x = np.where(np.isfinite(x), x, 0).astype(np.int64) + SHIFT
            rows = [x[at[i] : at[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), pa.array(at[keep + 1] - at[keep], pa.int32()), pa.array(rows, pa.binary())], names=["id", "d", "x"])
        release_memory()

    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return bounded_batches(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, d int, x binary")


def _matrices(batches, d: int):
    """Pieces of the batches with their rows as a matrix of longs."""
    step = max(1, CHUNK_NUMBERS // d)
    for batch in batches:
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            x = part.column("x")
            offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            yield part, np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64).reshape(-1, d)


@dataclass
class Centre:
    """Number of rows, sums of each dimension (exact) and from them n * x - S and x - S / n."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: longs where all of them fit, else Python's whole numbers."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0) < 2**63:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.scaled(x) / self.n, np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions of each row; null if that is too large for a long."""
        off = self.scaled(x)
        if off.dtype == np.int64 and float(np.abs(off.astype(np.float64)).max(initial=0)) ** 2 * max(1, off.shape[1]) < 2**62:
            return (off * off).sum(1).tolist()
        exact = (off.astype(object) ** 2).sum(1).tolist() if off.shape[1] else [0] * len(off)
        return [v if v < 2**63 else None for v in exact]


def added(table: DataFrame, tasks: int, d: int, of: Callable[[np.ndarray], np.ndarray], size: int, dtype=np.float64) -> np.ndarray:
    """Sum over all pieces of the table's rows (read by so many tasks) of of(matrix of longs), `size` numbers."""

    def run(batches):
        total = np.zeros(size, dtype)
        for _, x in _matrices(batches, d):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
        release_memory()

    parts = table.select("x").mapInArrow(run, "sums binary")
    if tasks > FEW_TASKS:

        def add(batches):
            total = np.zeros(size, dtype)
            for batch in batches:
                for raw in batch.column("sums").to_pylist():
                    total += np.frombuffer(raw, dtype)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = parts.repartition(int(tasks**0.5) + 1).mapInArrow(add, "sums binary")
    total = np.zeros(size, dtype)
    for raw in parts.toArrow().column("sums").to_pylist():
        total += np.frombuffer(raw, dtype)
    return total


def centre_of(table: DataFrame, tasks: int, d: int) -> Centre:
    """Exact sums: high and low halves of the longs are added by themselves."""
    half = np.int64(31)
    parts = added(table, tasks, d, lambda x: np.concatenate([[len(x)], (x >> half).sum(0), (x & np.int64(2**31 - 1)).sum(0)]), 2 * d + 1, np.int64)
    return Centre(int(parts[0]), [(int(h) << 31) + int(low) for h, low in zip(parts[1 : d + 1], parts[d + 1 :])])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


@dataclass
class Whitening:
    centre: Centre
    vectors: np.ndarray  # components x dimensions
    values: np.ndarray  # eigenvalues
    trace: float
    steps: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def bidiagonalise(table: DataFrame, tasks: int, d: int, centre: Centre, components: int = COMPONENTS) -> Whitening:
    """The first `components` principal directions of the table's rows (fewer where they have fewer).

    Right vectors are made orthogonal to all before them on the driver (d numbers each), left vectors by
    sums from the same pass. A vector of which nothing is left ends a block (the rows span no more, or
    an eigenvalue is repeated); the next one starts at random, orthogonal to all before."""
    random = np.random.default_rng(13)
    right: list[np.ndarray] = []  # v: d numbers each
    short: list[np.ndarray] = []  # w: the left vector is X w
    images: list[np.ndarray] = []  # X'u
    bidiagonal = np.zeros((d + 1, d + 1))
    beta, largest, trace = 0.0, 0.0, 0.0
    v = random.standard_normal(d)
    v /= np.linalg.norm(v) or 1
    while len(right) < d:
        k = len(right)
        w = v - beta * short[-1] if k and beta else v
        basis = np.array([*short, w]).T

        def products(x, basis=basis, k=k):
            rows = centre.rows(x)
            left = rows @ basis
            u, p = left[:, :k], left[:, k]
            return np.concatenate([u.T @ p, [p @ p, (rows * rows).sum()], rows.T @ p])

        got = added(table, tasks, d, products, k + 2 + d)
        onto, length, trace, image = got[:k], got[k], got[k + 1], got[k + 2 :]
        if k:  # full reorthogonalisation against the left vectors, by their own sums
            w, image = w - np.array(short).T @ onto, image - np.array(images).T @ onto
        alpha = np.sqrt(max(0.0, length - onto @ onto))
        largest = max(largest, alpha)
        right.append(v)
        if alpha <= NOTHING * max(largest, np.sqrt(trace)):
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        short.append(w)
        images.append(image)
        bidiagonal[k, k] = alpha
        q = _orthogonal(image - alpha * v, right)
        beta = float(np.linalg.norm(q))
        if beta <= NOTHING * max(largest, np.sqrt(trace)):
            beta, q = 0.0, _orthogonal(random.standard_normal(d), right)
        if len(right) < d:
            v = q / np.linalg.norm(q)
            bidiagonal[k, k + 1] = beta
        if beta and len(right) > components:
            left, values, _ = np.linalg.svd(bidiagonal[: k + 1, : k + 1])
            if (beta * np.abs(left[-1, :components]) <= SETTLED * values[0]).all():
                break
    k = len(right)
    _, values, back = np.linalg.svd(bidiagonal[:k, :k])
    found = values[:components] > values[:1] * max(d, 8) * 1e-14
    vectors, values = back[:components][found] @ np.array(right).reshape(k, d), values[:components][found]
    return Whitening(centre, vectors, values**2 / max(1, centre.n), trace / max(1, centre.n), k)


def identity_error(table: DataFrame, tasks: int, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    c, n = len(model.values), model.centre.n
    if not c:
        return 0.0

    def products(x):
        y = model.project(x)
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    sums = added(table, tasks, d, products, c + c * c)
    mean = sums[:c] / n
    return float(np.abs(sums[c:].reshape(c, c) / n - np.outer(mean, mean) - np.eye(c)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of `vectors` and each component: id, component (from 1), n, deviation,
    whitened, explained and identity_error.

    Rows whose vector is null or has null, NaN or infinite entries are left out. All vectors should have one
    length; of several, the most frequent one counts (the longest of equally frequent), rows of others are left
    out. Repeated rows and ids count as often as they are there. There are as many components as directions
    in which the rows differ, at most `components`: none, and so no row, for an empty table, a single row, equal
    rows or vectors without entries. Equal eigenvalues have any orthonormal directions. deviation is null
    where it is too large for a long. Other columns are left out.
    """
    rows = stored(whole_rows(vectors, id_col, vector_col), "vectors")
    lengths = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = int(lengths["d"]) if lengths else 0
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    table = rows.where(F.col("d") == d)
    tasks = table.rdd.getNumPartitions()
    model = bidiagonalise(table, tasks, d, centre_of(table, tasks, d), components)
    error, c = identity_error(table, tasks, d, model), len(model.values)
    explained = model.values / model.trace if c else model.values
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        n = model.centre.n
        for part, x in _matrices(batches, d):
            if c:
                times = lambda column: column.take(pa.array(np.repeat(np.arange(len(x)), c)))
                size = len(x) * c
                columns = [
                    times(part.column("id")),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, n, np.int64)),
                    times(pa.array(model.centre.deviations(x), pa.int64())),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release_memory()

    return table.select("id", "x").mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
