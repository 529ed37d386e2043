"""Whitening of embeddings by block Lanczos, without ever forming the covariance.

An entry c becomes the integer floor(``scale`` * c) + ``shift``; every distinct vector of integers
counts once in the fit. The covariance V is only ever applied: one pass over the fit list gives
V·B for a block B of columns, from rows that are centred before they are multiplied. The Krylov
basis is reorthogonalised in full, twice, each round. Columns that vanish against the basis are
replaced by seeded random ones (a breakdown restarts that direction), and when the basis reaches
``most`` columns it is folded into its best Ritz vectors. A round ends the search if the residuals
‖Vu - eu‖ of all wanted pairs are at rounding level, or if the basis spans the whole space, where
they are exact. The driver holds the basis, dimensions x ``most`` numbers at most.

Dropped are rows whose vector is null, holds a null or an infinite or undefined entry, has an entry
of 2**46 or more in size (beyond exact doubles after scaling), or is not of the usual length (the
most frequent one; the longest of equally frequent). Repeated rows each get their result. Only
components with a variance above rounding (1e-12 of the largest) exist; without any, as for one
vector or none, the result is empty. A deviation beyond 63 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, trimmed

SEED = 20


def to_integers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """The vector's integers, or null where the row is to be dropped; lengths are not looked at."""
    entries = vector.cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 46)))
    return F.when(usable, F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("long")))


def _matrix(column, d: int) -> np.ndarray:
    """An Arrow list column without nulls as rows x d integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64, copy=False)


@dataclass
class Centre:
    """n vectors with their sums: mean = ``whole`` + ``rest`` / n, exact."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean: integers subtracted exactly, then the fraction, so no digits are lost to a large mean."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)**2, exact."""
        off = x - self.whole
        bound = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            y = off * self.n - self.rest
            return (y * y).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        exact = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off]
        return [v if v < 1 << 63 else None for v in exact]

    def squares(self, x: np.ndarray) -> float:
        """The sum of the deviations over n**2, as a double."""
        y = self.centred(x)
        return float((y * y).sum())


def _summed(fit: DataFrame, d: int, width: int, kind: str, run) -> np.ndarray:
    """The sum over all tasks of the d x width arrays that ``run`` makes of a task's batches.

    Each task gives d rows, which are added by row number, so no task and no driver holds more
    than d x width numbers of each.
    """
    import pyarrow as pa

    names = [f"v{j}" for j in range(width)]

    def task(batches):
        total = run(_matrix(b.column(0), d) for b in batches if b.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(width))], names=["i", *names])

    rows = fit.select("x").mapInArrow(trimmed(task), ", ".join(["i int", *(f"{v} {kind}" for v in names)])).groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).collect()
    out = np.zeros((d, width), dtype=np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r.i] = [r[v] for v in names]
    return out


def _accumulated(make):
    """For ``_summed``: adds what ``make`` gives for each matrix."""

    def run(matrices):
        total = None
        for x in matrices:
            part = make(x)
            total = part if total is None else total + part
        return total

    return run


def covariance_times(fit: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """V·block by one pass."""
    d, width = block.shape

    def make(x):
        y = centre.centred(x)
        return y.T @ (y @ block)

    return _summed(fit, d, width, "double", _accumulated(make)) / centre.n


def _fresh_columns(w: np.ndarray, basis: np.ndarray, room: int, rng) -> np.ndarray:
    """At most ``room`` orthonormal columns: of ``w`` against ``basis``, random ones in place of those that vanish."""
    d = len(w)
    scale = np.linalg.norm(w, axis=0).max(initial=0.0)
    out = np.zeros((d, 0))
    for j in range(min(w.shape[1], room)):
        v = w[:, j]
        for attempt in range(6):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * (scale if attempt == 0 else size) and left > 0:
                v = v / left
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.concatenate([out, (v / np.linalg.norm(v))[:, None]], axis=1)
                break
            v = rng.standard_normal(d)
    return out


def leading_pairs(apply, d: int, k: int, width: int | None = None, most: int = 512, rounds: int = 400, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, rounds) of the ``k`` largest eigenpairs of the symmetric d x d operator ``apply``, by block Lanczos.

    Raises if the residuals have not reached rounding level after ``rounds``.
    """
    k = min(k, d)
    width = min(width or k, d)
    most = max(min(most, d), min(d, 3 * k + width))
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = _fresh_columns(rng.standard_normal((d, width)), basis, width, rng)
    for done in range(1, rounds + 1):
        w = apply(block)
        basis, image = np.concatenate([basis, block], axis=1), np.concatenate([image, w], axis=1)
        t = basis.T @ image
        values, inner = np.linalg.eigh((t + t.T) / 2)
        best = np.argsort(values)[::-1]
        top = inner[:, best[:k]]
        residual = np.linalg.norm(image @ top - basis @ top * values[best[:k]], axis=0)
        if basis.shape[1] >= d or (basis.shape[1] >= k and residual.max() <= 4e-15 * np.sqrt(d) * max(values[best[0]], 0.0)):
            return values[best[:k]], basis @ top, done
        block = _fresh_columns(w, basis, d - basis.shape[1], rng)
        if most < d and basis.shape[1] + width > most:  # fold into the best Ritz vectors; the residuals lie in the next block
            held = inner[:, best[: 2 * k]]
            basis, r = np.linalg.qr(basis @ held)
            image = np.linalg.solve(r.T, (image @ held).T).T
    raise RuntimeError(f"the largest residual is {residual.max()} after {rounds} rounds")


def whiten(rows: DataFrame, vector: str, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``rows`` without their vector, one row for each component from 1, with n, deviation, whitened, explained and identity_error.

    Columns of ``rows`` that have one of these names give way to them.
    """
    spark = rows.sparkSession
    own = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carry = [c for c in rows.columns if c not in (vector, *own)]
    kinds = dict(rows.dtypes)
    empty = spark.createDataFrame([], ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "component int, n long, deviation long, whitened double, explained double, identity_error double"]))
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], to_integers(F.col(f"`{vector}`"), scale, shift).alias("x")).where(F.size("x") > 0)
    usual = plain.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if usual is None:
        return empty
    d = usual.d
    plain = plain.where(F.size("x") == d)
    # equal vectors meet in a partial aggregation, so one that very many rows hold weighs little
    fit = materialize(plain.select("x").distinct(), "fit")
    try:
        sums = _summed(fit, d, 2, "long", _accumulated(lambda x: np.stack([x.sum(axis=0), np.full(d, len(x))], axis=1)))
        centre = Centre(int(sums[0, 1]), [int(s) for s in sums[:, 0]])
        values, vectors, _ = leading_pairs(lambda block: covariance_times(fit, centre, block), d, components)
        held = int((values > 1e-12 * max(values[0], 0.0)).sum())
        if not held or values[0] <= 0:
            return empty
        turn = vectors[:, :held] / np.sqrt(values[:held])

        def moments(x):
            z = centre.centred(x) @ turn
            out = np.zeros((d, held + 2))
            out[:held, :held], out[:held, held], out[0, held + 1] = z.T @ z, z.sum(axis=0), centre.squares(x)
            return out

        sums = _summed(fit, d, held + 2, "double", _accumulated(moments))
        mean = sums[:held, held] / centre.n
        error = float(np.abs(sums[:held, :held] / centre.n - np.outer(mean, mean) - np.eye(held)).max())
        shares = (values[:held] / (sums[0, held + 1] / centre.n)).tolist()
    finally:
        release(fit)

    import pyarrow as pa

    names = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")), d)
            z = centre.centred(x) @ turn
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, held, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(centre.deviations(x), pa.int64()), flat], names=[*names, "deviation", "z"])

    schema = ", ".join([*(f"{c} {kinds[o]}" for c, o in zip(names, carry, strict=True)), "deviation long, z array<double>"])
    done = plain.mapInArrow(trimmed(run), schema).select(*names, "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1)
    return done.select(
        *[F.col(c).alias(o) for c, o in zip(names, carry, strict=True)],
        (F.col("at") + 1).alias("component"),
        F.lit(centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
