"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Entries become integers (256ths, rounded down). The covariance is over the distinct vectors: their
per-dimension sums are exact, each task adds up products of centred entries, and Spark adds the
tasks' matrices. Only dimension-sized sums and the d x d matrix reach the driver, whatever the rows.

There the polar factor of ``A - shift`` (QDWH: dynamically weighted Halley steps by QR, so no
inverse is taken) gives the projector on the eigenvectors above the shift. Its range, found by a
pivoted Gram-Schmidt, and the rest split ``A`` into two smaller blocks, and so on down to single
eigenvectors. The d x 4 whitening matrix then goes to every task.

Defined cases. Null vectors and vectors with null or non-finite entries: dropped. Empty vectors have
no component and so no row. Vectors of another length than the most frequent one (ties: the
longest) lie in another space: dropped. Repeated vectors count once in the fit, every row is
returned; null ids too. A component without variance (eigenvalue not above d * eps * the largest)
has null ``whitened`` and stays out of ``identity_error`` (null if no component is left). Equal
eigenvalues: any orthonormal basis, the same for all rows. Fewer than four dimensions: as many
components. A deviation beyond 64 bits is null. Entries beyond 64 bits are held at the largest long.
Empty table: empty result. Extra columns are ignored. There are no texts here, so no long ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm import text as X
from dipscan.session import materialize

EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    scale: int = 256
    components: int = 4


def qdwh(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix."""
    n = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return np.eye(n)
    x = a / size
    # a lower bound of the least singular value; too small a bound costs a step or two only
    low = max(1 / (np.sqrt(n) * np.linalg.cond(x, 1)) if n > 1 else abs(x[0, 0]), EPS)
    for _ in range(60):
        c = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + c)
        wa = root + np.sqrt(8 - 4 * c + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        step = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        step = (step + step.T) / 2
        moved = np.linalg.norm(step - x)
        x = step
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if moved <= (4 * EPS) ** (1 / 3) and 1 - low <= 4 * EPS:
            break
    return x


def _range(p: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest: Gram-Schmidt with pivoting, then a full QR."""
    rest, chosen = p.copy(), []
    for _ in range(rank):
        j = int(np.argmax((rest**2).sum(0)))
        v = rest[:, j] / np.linalg.norm(rest[:, j])
        rest -= np.outer(v, v @ rest)
        chosen.append(p[:, j])
    q, _ = np.linalg.qr(np.column_stack(chosen), mode="complete")
    return q[:, :rank], q[:, rank:]


def divide(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix, by spectral projectors."""
    whole = max(np.linalg.norm(a), np.finfo(float).tiny)

    def split(block: np.ndarray, basis: np.ndarray):
        n = len(block)
        mean = np.trace(block) / n
        spread = np.linalg.norm(block - mean * np.eye(n))
        if n == 1 or spread <= 2 * n * EPS * whole:  # one eigenvalue: any basis of the space will do
            return [(d, basis[:, i]) for i, d in enumerate(np.diag(block))]
        # the mean lies between the least and the greatest eigenvalue; others are tried if it is one itself
        best = None
        for nudge in (0.0, 0.3, -0.3, 0.1, -0.1, 0.03, -0.03):
            p = (qdwh(block - (mean + nudge * spread / np.sqrt(n)) * np.eye(n)) + np.eye(n)) / 2
            rank = int(round(np.trace(p)))
            if not 0 < rank < n:
                continue
            one, two = _range(p, rank)
            error = np.linalg.norm(two.T @ block @ one)
            if best is None or error < best[0]:
                best = error, one, two
            if error <= 10 * n * EPS * np.linalg.norm(block):
                break
        if best is None:
            raise ArithmeticError("the covariance could not be split")
        out = []
        for part in best[1:]:
            inner = part.T @ block @ part
            out += split((inner + inner.T) / 2, basis @ part)
        return out

    pairs = sorted(split(a, np.eye(len(a))), key=lambda x: -x[0])
    vectors = np.column_stack([v for _, v in pairs])
    return np.array([v @ a @ v for v in vectors.T]), vectors


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


def _products(centre: np.ndarray, by: np.ndarray | None = None):
    """Per task: the sums of products of centred entries (times ``by``), a row per line of the matrix."""
    d = len(centre)

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), d) - centre
                x = x if by is None else x @ by
                total = total + x.T @ x
        if np.ndim(total):
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), X.lists(total.reshape(-1), np.arange(k + 1) * k)], ["i", "v"]
            )

    return run


def _summed(fit: DataFrame, centre: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    k = len(centre) if by is None else by.shape[1]
    parts = fit.mapInArrow(_products(centre, by), "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((k, k))
    for r in cells.collect():  # k * k cells
        out[r.i, r.j] = r.x
    return (out + out.T) / 2


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    reach = n * np.abs(x).max(initial=0).astype(float) + np.abs(sums.astype(float)).max(initial=0)
    if len(sums) * reach**2 < 2.0**62:
        return pa.array(((n * x - sums) ** 2).sum(1))
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def _rows(n: int, sums: np.ndarray, centre: np.ndarray, by: np.ndarray, shares: list, error):
    d, k = by.shape
    dead = np.isnan(by).any(0)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d)
            # one sum per row and component, in an order that doesn't depend on the batch
            z = np.stack([((x - centre) * by[:, c]).sum(1) for c in range(k)], axis=1)
            which = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(which), n)), _deviations(x, n, sums).take(pa.array(which)),
                pa.array(z.reshape(-1), mask=np.tile(dead, len(x))), pa.array(shares * len(x), pa.float64()),
                pa.array([error] * len(which), pa.float64()),
            ], schema=schema)

    return run


def whitened(vectors: DataFrame, cfg: Whitening = Whitening()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    entry = F.col("embedding").cast("array<double>")
    far = float(np.finfo(float).max)
    usable = F.coalesce(F.forall(entry, lambda c: c.isNotNull() & c.between(-far, far)), F.lit(False)) & (F.size("embedding") > 0)
    x = F.transform(entry, lambda c: F.floor(c * cfg.scale).cast("long"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], none)
    d, n = lengths
    fit, rows = fit.where(F.size("x") == d), rows.where(F.size("x") == d)
    exact = "decimal(38,0)"
    cells = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast(exact)).alias("s")).collect()  # d rows
    s = [0] * d
    for r in cells:
        s[r.pos] = int(r.s)
    sums = np.array(s, np.int64 if max(map(abs, s)) < 1 << 62 else object)
    centre = np.array([v / n for v in s])
    cov = _summed(fit, centre) / n
    values, axes = divide(cov)
    k = min(cfg.components, d)
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(0), np.arange(k)])
    alive = values[:k] > max(values[0], 0) * d * EPS
    by = axes / np.sqrt(np.where(alive, values[:k], np.nan))
    error = None
    if alive.any():
        error = float(np.abs(_summed(fit, centre, by[:, alive]) / n - np.eye(alive.sum())).max())
    total = float(np.trace(cov))
    shares = [float(v) / total if total > 0 else None for v in values[:k]]
    return rows.mapInArrow(
        _rows(n, sums, centre, by, shares, error),
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
