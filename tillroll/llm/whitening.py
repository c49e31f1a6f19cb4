"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become whole numbers (``floor(64 * c) + 1000000``), so counts and sums
are exact.  Spark makes the list of distinct vectors, their sums and the
covariance of the centred vectors; the driver, which holds one matrix of
dimension x dimension, splits it: the unitary polar factor of the shifted
matrix (QDWH iterations) gives the projector on the eigenvalues above the
shift, the range and the complement of the projector are invariant subspaces,
and each is split again until a single component is left.  Tasks then apply
the projection, which is as small as the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import bounded, slices, table
from tillroll.session import write_table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: An entry beyond this size counts as this size, so that whole numbers stay within 64 bits.
LARGEST = float(1 << 45)
#: Eigenvalues up to this share of the trace are rounding, no components.
RANK = 1e-13
EPS = np.finfo(np.float64).eps


# --- the matrix side -----------------------------------------------------------------------
def polar(a: np.ndarray) -> np.ndarray | None:
    """Unitary polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps; None if it is singular."""
    n = len(a)
    size = np.linalg.norm(a)
    if not size:
        return None
    x = a / size
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(np.linalg.qr(x)[1]))
    except np.linalg.LinAlgError:
        return None
    if not least > 8 * n * EPS:
        return None
    low = min(least, 1.0)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square ** 2)
        a0 = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        b0 = (a0 - 1) ** 2 / 4
        c0 = a0 + b0 - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c0) * x, np.eye(n)]))[0]
        after = b0 / c0 * x + (a0 - b0 / c0) / np.sqrt(c0) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x = after
        low = min(1.0, low * (a0 + b0 * square) / (1 + c0 * square))
        if abs(1 - low) < 10 * EPS and moved < 1e-8:      # cubic steps: the next one would move by moved ** 3
            return x
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above a shift, and k; None if ``a`` is a multiple of I.

    A shift without eigenvalues on one of its sides narrows the range to search; one that
    falls on an eigenvalue is moved a little.
    """
    n = len(a)
    centre = np.trace(a) / n
    size = max(np.linalg.norm(a), 1e-300)
    if np.linalg.norm(a - centre * np.eye(n)) <= n * EPS * size:
        return None
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()
    shift, best = float(np.median(np.diag(a))), None
    for _ in range(80):
        if not low < shift < high:
            shift = (low + high) / 2
        u = polar(a - shift * np.eye(n))
        if u is None:
            shift += (high - low) * 0.01 * rng.uniform(-1, 1)
            continue
        projector = (u + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if k == 0:
            high = shift
        elif k == n:
            low = shift
        else:
            # the range of the projector: its image of k random directions, made orthogonal twice
            q = np.linalg.qr(projector @ rng.normal(size=(n, k)))[0]
            q = np.linalg.qr(projector @ q, mode="complete")[0]
            left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
            if best is None or left < best[0]:
                best = left, q, k
            if left <= 4 * n * EPS * size:
                return q, k
            shift += (high - low) * 0.01 * rng.uniform(-1, 1)
            continue
        if high - low <= 4 * n * EPS * size:
            return best and best[1:]
        shift = (low + high) / 2
    return best and best[1:]


def components(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling size, and unit eigenvectors as columns; at most the first ``most``.

    Subspaces are split from the top, so that those below the components asked for stay whole.
    """
    n = len(a)
    most = n if most is None else min(most, n)
    rng = np.random.default_rng(17)
    scale = float(np.abs(a).max()) or 1.0
    values, vectors = [], []
    stack = [(a / scale, np.eye(n))]            # the top of the stack holds the largest eigenvalues
    while stack and len(values) < most:
        block, basis = stack.pop()
        block = (block + block.T) / 2
        found = None if len(block) == 1 else split(block, rng)
        if found is None:
            values += [float(v) for v in np.diag(block)]
            vectors += list(basis.T)
            continue
        q, k = found
        for part in (q[:, k:], q[:, :k]):
            stack.append((part.T @ block @ part, basis @ part))
    if not values:
        return np.zeros(0), np.zeros((n, 0))
    v = np.linalg.qr(np.array(vectors).T)[0]
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")[:most]
    return e[order], v[:, order]


# --- the Spark side --------------------------------------------------------------------------
def whole_numbers(column: str = "embedding") -> Column:
    """``floor(64 * c) + 1000000`` of each entry as a long; null for vectors that are null or hold null or non-finite entries."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    top = F.lit(LARGEST)
    entry = lambda c: F.floor(SCALE * F.greatest(-top, F.least(top, c.cast("double")))).cast("long") + SHIFT     # noqa: E731
    return F.when(F.col(column).isNotNull() & finite, F.transform(column, entry))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    parts = slices(column)
    return np.concatenate(parts).reshape(-1, d) if parts else np.zeros((0, d), np.int64)


def centred_exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` in whole numbers: 64 bits where they hold it, Python's integers otherwise."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < 2.0 ** 62 and max(map(abs, sums), default=0) < 2 ** 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(t: np.ndarray) -> list[int | None]:
    """Row sums of squares of whole numbers; None beyond 64 bits."""
    if float(np.abs(t).max(initial=0)) ** 2 * max(1, t.shape[1]) < 2.0 ** 62:
        return (t.astype(np.int64) ** 2).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in t]
    return [v if v < 1 << 63 else None for v in found]


def _sums(rows: DataFrame, d: int) -> DataFrame:
    """(i, n, s): count and exact sum of each dimension, added up in tasks before Spark adds the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for part in bounded([batch]):        # at most 1,000 rows of numbers below 2 ** 52: 64 bits hold their sum
                n += part.num_rows
                total = [a + b for a, b in zip(total, _matrix(part.column(0), d).sum(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                                              pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "n", "s"])
    return (rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)")
            .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i"))


def _gram(rows: DataFrame, d: int, of, width: int) -> np.ndarray:
    """Sum over the rows of y'y for y = of(x): one matrix a task, added up by Spark entry by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in bounded([batch]):
                y = of(_matrix(part.column(0), d))
                total += y.T @ y
        i, j = np.triu_indices(width)
        keep = total[i, j] != 0
        yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(total[i, j][keep])],
                                         ["i", "j", "v"])
    cells = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j = cells.column("i").to_numpy(), cells.column("j").to_numpy()
    out[i, j] = out[j, i] = cells.column("v").to_numpy()
    return out


class Fit:
    """What the tasks need: counts, sums, projection; each of the size of the covariance matrix at most."""

    def __init__(self, fit: DataFrame, d: int, most: int):
        row = _sums(fit, d).collect()
        self.d, self.n, self.sums = d, row[0].n, [int(r.s) for r in row]
        n, sums = self.n, self.sums
        centre = lambda x: (centred_exact(x, n, sums) / n).astype(np.float64)         # noqa: E731
        v = _gram(fit, d, centre, d) / n
        e, q = components(v, most)
        self.trace = float(np.trace(v))
        keep = e > RANK * max(self.trace, 0)
        self.values, self.vectors = e[keep], q[:, keep]
        self.projection = w = self.vectors / np.sqrt(self.values)
        # the mean of whitened rows over the fit list is 0: S is exact
        unit = _gram(fit, d, lambda x: centre(x) @ w, w.shape[1]) / n if w.shape[1] else np.zeros((0, 0))
        self.identity_error = float(np.abs(unit - np.eye(len(unit))).max(initial=0))


def whiten(rows: DataFrame, most: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row with a vector of finite entries.

    Vectors of unequal length have nothing in common: each length is fitted and whitened
    alone.  A row that occurs twice is returned twice and counts once in the fit; a null
    key stays.  Components of no variance (all rows equal, or fewer rows than
    dimensions) are not returned, neither are empty vectors.  ``deviation`` beyond 64 bits
    is null.  Other columns of ``rows`` are ignored, an empty table gives an empty result.
    """
    spark = rows.sparkSession
    schema = f"{key} {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    numbers = rows.select(F.col(key).alias("id"), whole_numbers(column).alias("x")).where("x is not null and size(x) > 0")
    # equal vectors meet in a partial aggregate before the shuffle, however many copies there are
    fit = write_table(numbers.select("x").distinct().withColumn("d", F.size("x")), "whitening-fit")
    out = None
    for d in sorted(r.d for r in fit.select("d").distinct().collect()):
        model = Fit(fit.where(F.col("d") == d).select("x"), d, most)
        part = numbers.where(F.size("x") == d).mapInArrow(_apply(model, key), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _apply(model: Fit, key: str):
    n, sums, w, d = model.n, model.sums, model.projection, model.d
    explained, error = model.values / (model.trace or 1), model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.shape[1]
        for part in bounded(batches):
            t = centred_exact(_matrix(part.column(1), d), n, sums)
            white = (t / n).astype(np.float64) @ w
            rows = len(t)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                pa.array([v for v in deviations(t) for _ in range(k)], pa.int64()),
                pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
