"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The vectors, as whole numbers, are a matrix X of distinct rows, held in blocks of rows. Steps alternate the products
Xv and X'u on the centred rows, distributed over the blocks; each new u and v is made orthogonal to all before. The singular
values of the small bidiagonal matrix give the deviations, and its right vectors the components.

A column u has an entry per row of X and is never stored: it is X a for a short vector a that the driver knows, so each task has
its part of u where its rows are. One pass per step therefore gives both products, and what u has in common with all u before,
since u_j'(X p) = a_j'(X'X p). A second pass follows where that was not small. The driver holds vectors as long as an
embedding, at most as many as it has dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import scratch

COMPONENTS = 4
SCALE = 256
#: Singular values below this share of the greatest are zero to the precision of a covariance in doubles.
_ZERO = 1e-7
#: A step is repeated if it left more than this share of a new u along the u before.
_COMMON = 1e-10
#: A triplet has settled when its residual is this share of the greatest singular value.
_SETTLED = 1e-14
_BLOCK_BYTES = 1 << 20
_SEED = 7


def whole(vector: Column) -> Column:
    """floor(256 c) of each entry, as longs (beyond their range: the nearest one)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def is_valid(vector: Column, dims: int | None = None) -> Column:
    """No null, no entry that is null or not finite, and ``dims`` entries if given."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    fits = F.lit(True) if dims is None else F.size(vector) == dims
    return F.coalesce(vector.isNotNull() & finite & fits, F.lit(False))


@dataclass
class Whitening:
    """What was fitted: ``n`` distinct vectors with ``sums`` per dimension, ``components`` (rows, unit length, the entry of
    largest size positive), their eigenvalues, the trace of the covariance, and how far whitened rows are from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int = 0

    @classmethod
    def fit(cls, table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
        """Fit on each distinct vector once. Vectors are left out that are null, hold null or non-finite entries, or have
        another length than most (on a tie, than the longest). Fewer components result where the covariance has a lower
        rank, none from no vectors or a single one."""
        valid = table.filter(is_valid(F.col(vector))).select(F.col(vector).alias("v"))
        sizes = valid.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).head()
        dims = sizes.dims if sizes else 0
        nothing = cls(0, [0] * dims, np.zeros((0, dims)), np.zeros(0), 0.0, 0.0)
        if dims == 0:
            return nothing
        blocks = scratch(_blocks(valid.filter(F.size("v") == dims).select(whole(F.col("v")).alias("x")).distinct(), dims), "vectors")
        n, sums, squares = _sums(blocks, dims)
        spread = n * sum(squares) - sum(s * s for s in sums)  # n^2 times the trace, exact
        if spread == 0:
            return cls(n, sums, nothing.components, nothing.eigenvalues, 0.0, 0.0)
        mean = np.array([s / n for s in sums])
        values, vectors, steps = bidiagonalise(lambda p: _products(blocks, mean, p), dims, spread / n, components)
        kept = values > _ZERO * values[0]
        values, vectors = values[kept], vectors[kept]
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        eigenvalues = values**2 / n
        fitted = cls(n, sums, vectors, eigenvalues, spread / n / n, 0.0, steps)
        fitted.identity_error = _identity_error(blocks, mean, fitted.projection(), n)
        return fitted

    def projection(self) -> np.ndarray:
        """Components over deviations: a centred row times this, transposed, is whitened."""
        return self.components / np.sqrt(self.eigenvalues)[:, None]

    def apply(self, table: DataFrame, vector: str = "embedding") -> DataFrame:
        """Valid rows with two more columns: ``deviation`` (the sum over dimensions of (n x - S)^2; null beyond the range of
        a long) and ``whitened`` (an entry per component). Columns of those names are replaced."""
        n, sums, dims = self.n, self.sums, len(self.sums)
        mean, projection = np.array([s / max(n, 1) for s in sums]), self.projection()
        most = max(map(abs, sums), default=0)

        @F.pandas_udf("deviation bigint, whitened array<double>")
        def whiten(rows: pd.Series) -> pd.DataFrame:
            x = np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, dims), np.int64)
            if (n * int(np.abs(x.astype(float)).max(initial=0)) + most) ** 2 * dims < 1 << 62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
            else:
                exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
                deviation = pd.array([d if d < 1 << 63 else None for d in exact], dtype="Int64")
            return pd.DataFrame({"deviation": deviation, "whitened": list((x - mean) @ projection.T)})

        valid = table.filter(is_valid(F.col(vector), dims)) if dims else table.limit(0)
        others = [F.col(c) for c in table.columns if c not in ("deviation", "whitened")]
        return valid.select(*others, whiten(whole(F.col(vector))).alias("_w")).select(*others, "_w.deviation", "_w.whitened")


def _matrix(block: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dims)


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Vectors as matrices of rows in binary, about a megabyte each."""
    most = max(_BLOCK_BYTES // (8 * dims), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(x), most):
                yield pa.RecordBatch.from_arrays([pa.array([x[at : at + most].astype(np.int64).tobytes()], pa.binary())], ["block"])

    return rows.mapInArrow(pack, "block binary")


def _sums(blocks: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Number of rows, and sums and sums of squares per dimension, as exact whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, s, q = 0, [0] * dims, [0] * dims
        for batch in batches:
            for block in batch.column(0):
                x = _matrix(block, dims)
                rows += len(x)
                if np.abs(x.astype(float)).max() < 1 << 20:  # squares of a block fit in a long
                    part, squares = x.sum(axis=0).tolist(), (x * x).sum(axis=0).tolist()
                else:
                    part, squares = ([sum(c**e for c in column) for column in x.T.tolist()] for e in (1, 2))
                s, q = [a + b for a, b in zip(s, part)], [a + b for a, b in zip(q, squares)]
        yield pa.RecordBatch.from_pydict({"rows": [rows], "s": [list(map(str, s))], "q": [list(map(str, q))]})

    parts = blocks.mapInArrow(add, "rows bigint, s array<string>, q array<string>")
    total = parts.select("rows", F.posexplode(F.arrays_zip("s", "q"))).groupBy("pos").agg(
        F.sum("rows").alias("rows"), *[F.sum(F.col(f"col.{c}").cast("decimal(38,0)")).alias(c) for c in ("s", "q")]
    )
    found = {r.pos: r for r in total.collect()}
    if not found:
        return 0, [0] * dims, [0] * dims
    return found[0].rows, [int(found[i].s) for i in range(dims)], [int(found[i].q) for i in range(dims)]


def _reduced(blocks: DataFrame, task, size: int) -> np.ndarray:
    """The sum over all blocks of what ``task`` makes of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column(0):
                total += task(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

    found = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    return found.sort_values("at")["value"].to_numpy()


def _products(blocks: DataFrame, mean: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """X'(X p) and the squared length of X p, for X with centred rows."""
    dims = len(mean)

    def both(block: pa.Scalar) -> np.ndarray:
        x = _matrix(block, dims) - mean
        u = x @ p
        return np.append(x.T @ u, u @ u)

    found = _reduced(blocks, both, dims + 1)
    return found[:-1], float(found[-1])


def _identity_error(blocks: DataFrame, mean: np.ndarray, projection: np.ndarray, n: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    k, dims = projection.shape

    def moments(block: pa.Scalar) -> np.ndarray:
        w = (_matrix(block, dims) - mean) @ projection.T
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = _reduced(blocks, moments, k * k + k)
    means = found[k * k :] / n
    covariance = found[: k * k].reshape(k, k) / n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def bidiagonalise(products, dims: int, energy: float, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest singular values of X, with their right vectors as rows, and the steps taken.

    ``products(p)`` gives X'(X p) and |X p|^2; ``energy`` is the sum of all squared entries of X. Steps end after as many as
    there are dimensions, or when the wanted triplets have settled and the energy not yet seen is less than the square of the
    last of them, so that nothing greater can be left, not even a second vector of a repeated value.
    """
    rng = np.random.default_rng(_SEED)
    scale = np.sqrt(energy)
    v = _away_from(rng.standard_normal(dims), np.zeros((0, dims)))
    right, a, z = np.zeros((0, dims)), np.zeros((0, dims)), np.zeros((0, dims))
    alphas, betas = [], []
    beta, found = 0.0, None
    while True:
        right = np.vstack([right, v / np.linalg.norm(v)])
        p = right[-1] - beta * a[-1] if beta else right[-1]
        for _ in range(3):
            y, square = products(p)
            common = a @ y
            p, y, square = p - common @ a, y - common @ z, square - common @ common
            if np.linalg.norm(common) <= _COMMON * np.sqrt(max(square, 0.0)):
                break
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= 1e-12 * scale:  # right[-1] has no part in X beyond the u before
            alpha, p, y = 0.0, np.zeros(dims), np.zeros(dims)
        a, z = np.vstack([a, p / (alpha or 1.0)]), np.vstack([z, y / (alpha or 1.0)])
        alphas.append(alpha)
        k = len(alphas)
        rest = _orthogonal(z[-1] - alpha * right[-1], right)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-12 * scale:
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, turned = np.linalg.svd(small)
        found = values[:wanted], turned[:wanted] @ right
        left_over = energy - sum(x * x for x in alphas) - sum(x * x for x in betas)
        settled = k >= wanted and (beta * np.abs(left[-1, :wanted]) <= _SETTLED * values[0]).all()
        if k == dims or settled and left_over <= values[wanted - 1] ** 2 or left_over <= 1e-13 * energy and beta == 0.0:
            return *found, k
        betas.append(beta)
        v = rest if beta else _away_from(rng.standard_normal(dims), right)


def _orthogonal(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - (rows @ x) @ rows
    return x


def _away_from(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = _orthogonal(x, rows)
    return x / np.linalg.norm(x)
