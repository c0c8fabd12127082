"""Whitening of embeddings by incremental eigendecomposition.

Vectors are taken in integer steps: x = floor(GRID * c) + SHIFT. Each task keeps the spectrum of what it has read: count,
mean, eigenvalues and eigenvectors of the scatter around the mean, which centred rank-one updates keep up to date. The new
eigenvalues are the roots of the secular equation (found by rational interpolation from both neighbouring poles, all at
once), after directions that an update misses and groups of equal eigenvalues are deflated; eigenvectors are rebuilt from
the roots, with the updating vector recomputed from them so that they stay orthogonal. Single vectors are an update each;
a block of more vectors than dimensions is first condensed (QR) to as many directions of the same scatter, each of which
is an update, and one more for the distance of means. Spectra of tasks are combined in groups of FAN by successive
rank-one updates, one for each direction and one for the means, until one is left. A last pass over all vectors projects
them on its basis and sums the products (Rayleigh-Ritz); the small eigenproblem of that sum gives the components to double
precision. One more pass measures the whitened covariance. Sums of x are exact integers.

Vectors that are null or hold a null or non-finite entry take no part. Vectors of different lengths cannot share a
covariance: each length is a fit of its own, with its own n, and vectors of no entries have no components. Components of no
variance (all vectors equal, or fewer vectors than dimensions) are left out, as nothing can be divided by their root. Steps
beyond EDGE count as EDGE; a deviation that exceeds a long is null. Repeated rows, ties and null keys are rows like others;
equal eigenvalues share a plane, of which some orthogonal axes are given, the same for all rows. An empty table gives no
rows. Other columns are not read.

A task holds one spectrum a length, dims^2 numbers, and at most HELD of them; the driver one basis a length. Models travel
with the tasks, and intermediate sums lie in the shared folder, so a lost executor costs its running tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._spark import cut, schema_of

GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Spectra that one task combines; lengths of vectors of which a task holds a spectrum, or a plan names one, at a time;
#: vectors of a block.
FAN, HELD, BLOCK = 16, 16, 4096
#: Eigenvalues below this share of the greatest are no variance.
NOTHING = 1e-12
EDGE = float(1 << 30)
_EPS = np.finfo(float).eps
_STATE = "dim int, part int, n long, sums array<long>, floats array<double>"
_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("floats", pa.list_(pa.float64()))])
_OUT = [pa.field("component", pa.int32()), pa.field("n", pa.int64()), pa.field("deviation", pa.int64()), *[pa.field(x, pa.float64()) for x in ("whitened", "explained", "identity_error")]]


class Spectrum:
    """Count, mean and eigendecomposition (ascending) of the scatter around the mean, sum of (x - mean)(x - mean)'."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, block: np.ndarray) -> None:
        """Rows of vectors."""
        if len(block) <= len(self.mean):
            for x in block:
                self._fold(1, x, ())
        else:
            mean = block.mean(axis=0)
            self._fold(len(block), mean, np.linalg.qr(block - mean, mode="r"))

    def merge(self, other: Spectrum) -> None:
        self._fold(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def _fold(self, n: int, mean: np.ndarray, directions: np.ndarray | tuple) -> None:
        """Adds n vectors of this mean, whose scatter is the sum of the directions' squares."""
        for direction in directions:
            self.update(direction, 1.0)
        shift = mean - self.mean
        self.update(shift, self.n * n / (self.n + n))
        self.n += n
        self.mean = self.mean + shift * (n / self.n)

    def update(self, direction: np.ndarray, weight: float) -> None:
        """The decomposition of the scatter + weight * direction direction'."""
        norm = float(np.sqrt(direction @ direction))
        rho = weight * norm * norm
        if not rho > 0:
            return
        lam, z = self.values, self.vectors.T @ (direction / norm)
        tiny = 8 * _EPS * max(abs(lam[-1]), rho)
        close = np.diff(lam) <= tiny
        if close.any():
            self._gather(z, close)
        live = rho * np.abs(z) > tiny
        k = int(live.sum())
        if not k:
            return
        whole = k == len(lam)
        own, poles = (z, lam) if whole else (z[live], lam[live])
        basis, values = secular(poles, own, rho)
        vectors = (self.vectors if whole else self.vectors[:, live]) @ basis
        if whole:  # roots interlace with the poles, so they ascend
            self.values, self.vectors = values, vectors
            return
        values, vectors = np.append(values, lam[~live]), np.append(vectors, self.vectors[:, ~live], axis=1)
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def _gather(self, z: np.ndarray, close: np.ndarray) -> None:
        """Turns the basis of each group of equal eigenvalues so that one vector alone holds the group's part of z."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2] + 1):
            part = z[a:b]
            norm = np.sqrt(part @ part)
            if norm == 0:
                continue
            norm = norm if part[-1] >= 0 else -norm
            v = part.copy()
            v[-1] += norm
            v /= np.sqrt(v @ v)
            block = self.vectors[:, a:b]
            self.vectors[:, a:b] = block - 2 * np.outer(block @ v, v)
            z[a:b] = 0
            z[b - 1] = -norm


@cache
def _sides(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For k roots: weights of the poles to their left, of those to their right, and which pole a product skips."""
    left = np.tri(k)
    return left, 1 - left, np.arange(k - 1)[:, None] < np.arange(k)[None, :]


def secular(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and eigenvalues of diag(poles) + rho z z', for ascending poles and no z of 0."""
    k = len(poles)
    z2 = rho * z * z
    if k == 1:
        return np.ones((1, 1)), poles + z2
    left, right, earlier = _sides(k)
    rows = np.arange(k)
    apart = poles[None, :] - poles[:, None]  # [root's left pole, pole]
    gaps = np.append(np.diff(poles), z2.sum())
    # A root is sought as the distance tau from the nearer of its two poles; f rises between them.
    upper = 1 + (z2 / (apart - gaps[:, None] / 2)).sum(axis=1) < 0
    upper[-1] = False
    origin = rows + upper
    delta = apart - np.where(upper, gaps, 0.0)[:, None]
    low, high = np.where(upper, -gaps / 2, 0.0), np.where(upper, 0.0, gaps / 2)
    high[-1] = gaps[-1]
    tau = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(80):
            away = delta - tau[:, None]
            terms = z2 / away
            slopes = terms / away
            psi, phi = np.einsum("jk,jk->j", terms, left), np.einsum("jk,jk->j", terms, right)
            f = 1 + psi + phi
            done = np.abs(f) <= 2 * k * _EPS * (1 - psi + phi)
            if done.all():
                break
            low, high = np.where(f < 0, tau, low), np.where(f > 0, tau, high)
            # Left poles as r + s / (near - t), right ones as u + v / (far - t), of equal value and slope at t = 0.
            near, far = away[rows, rows], np.append(away[rows[:-1], rows[1:]], 1.0)
            dpsi, dphi = np.einsum("jk,jk->j", slopes, left), np.einsum("jk,jk->j", slopes, right)
            c, s, v = 1 + psi - dpsi * near + phi - dphi * far, dpsi * near * near, dphi * far * far
            b, d = c * (near + far) + s + v, c * near * far + s * far + v * near
            root = np.sqrt(np.maximum(b * b - 4 * c * d, 0.0))
            step = np.where(b > 0, 2 * d / (b + root), (b - root) / (2 * c))
            step[-1] = near[-1] + s[-1] / c[-1]  # the last root has no pole beyond it
            new = tau + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            still = done | (np.abs(new - tau) <= _EPS * np.abs(tau))
            tau = np.where(done, tau, new)
            if still.all():
                break
    tau = np.where(tau == 0, np.where(upper, -1.0, 1.0) * np.finfo(float).tiny, tau)
    away = delta - tau[:, None]
    # The z whose update has exactly these roots, by products over poles; with it the eigenvectors are orthogonal.
    ratio = away[:-1] / np.where(earlier, apart[:-1], apart[1:])
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0) * away[-1])), z)
    vectors = (exact / away).T
    vectors /= np.sqrt(np.einsum("ij,ij->j", vectors, vectors))
    return vectors, poles[origin] + tau


def steps_of(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of the vectors that take part, by length, and their integer steps: (lengths, places and rows of each)."""
    n = len(vectors)
    values = vectors.flatten()
    bad = ~np.isfinite(np.asarray(values.to_numpy(zero_copy_only=False), float))
    lengths = np.asarray(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), int)
    at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    spoiled = np.concatenate([[0], np.cumsum(bad)])
    fine = (lengths > 0) & (spoiled[at[1:]] == spoiled[at[:-1]])
    flat = np.asarray(values.to_numpy(zero_copy_only=False), float)
    found = []
    for dim in np.unique(lengths[fine]):
        places = np.flatnonzero(fine & (lengths == dim))
        rows = flat[at[places][:, None] + np.arange(dim)]
        found.append((int(dim), places, np.clip(np.floor(GRID * rows), -EDGE, EDGE).astype(np.int64) + SHIFT))
    return found


@dataclass
class Model:
    """n, exact sums, and of the components kept: axes (dims, components), eigenvalues, shares; see identity_error."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.axes / np.sqrt(self.values)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(dim, steps) of at most BLOCK vectors each."""
    for b in batches:
        for dim, _, x in steps_of(b["_vector"]):
            for at in range(0, len(x), BLOCK):
                yield dim, x[at : at + BLOCK]


def _partial(df: DataFrame, vector: str, run: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[tuple]]) -> DataFrame:
    """Rows of _STATE that run gives for each task: (dim, n, sums, floats)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for dim, n, sums, floats in run(_batches(batches)):
            yield pa.RecordBatch.from_pylist([{"dim": dim, "part": part, "n": n, "sums": sums.tolist(), "floats": floats.ravel().tolist()}], _ARROW)

    return df.select(F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(task, _STATE)


def _combined(parts: DataFrame, merge: Callable[[int, list[np.ndarray], list[int]], np.ndarray]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(n, sums, floats) of each length: groups of FAN tasks' rows are merged by tasks, round by round."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        dim, counts = rows[0]["dim"], [r["n"] for r in rows]
        floats = merge(dim, [np.array(r["floats"]) for r in rows], counts)
        sums = np.sum([r["sums"] for r in rows], axis=0, dtype=np.int64)
        return pa.Table.from_pylist([{"dim": dim, "part": rows[0]["part"] // FAN, "n": sum(counts), "sums": sums.tolist(), "floats": floats.ravel().tolist()}], _ARROW)

    parts = cut(parts, "spectra")
    while (parts.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        grouped = parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("_group"))
        parts = cut(grouped.applyInArrow(one, _STATE), "spectra")
    return {r["dim"]: (r["n"], np.array(r["sums"], np.int64), np.array(r["floats"])) for r in parts.collect()}


def _packed(s: Spectrum) -> np.ndarray:
    return np.concatenate([s.mean, s.values, s.vectors.ravel()])


def _unpacked(dim: int, n: int, floats: np.ndarray) -> Spectrum:
    s = Spectrum(dim)
    s.n, s.mean, s.values, s.vectors = n, floats[:dim], floats[dim : 2 * dim], floats[2 * dim :].reshape(dim, dim).copy()
    return s


def _spectra(batches: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
    held: dict[int, tuple[Spectrum, np.ndarray]] = {}
    for dim, x in batches:
        if dim not in held and len(held) == HELD:
            first = next(iter(held))
            yield first, held[first][0].n, held[first][1], _packed(held[first][0])
            del held[first]
        s, sums = held.pop(dim, None) or (Spectrum(dim), np.zeros(dim, np.int64))
        s.add(x.astype(float))
        held[dim] = s, sums + x.sum(axis=0)
    for dim, (s, sums) in held.items():
        yield dim, s.n, sums, _packed(s)


def _merged(dim: int, floats: list[np.ndarray], counts: list[int]) -> np.ndarray:
    whole = _unpacked(dim, counts[0], floats[0])
    for n, f in zip(counts[1:], floats[1:]):
        whole.merge(_unpacked(dim, n, f))
    return _packed(whole)


def _products(of: Callable[[int, np.ndarray], np.ndarray]) -> Callable:
    """Sums over vectors of the products of what of(dim, steps) gives."""

    def run(batches: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        sums: dict[int, list] = {}
        for dim, x in batches:
            y = of(dim, x)
            own = sums.setdefault(dim, [0, 0.0])
            own[0] += len(x)
            own[1] = own[1] + y.T @ y
        for dim, (n, total) in sums.items():
            yield dim, n, np.zeros(0, np.int64), total

    return run


def _added(dim: int, floats: list[np.ndarray], counts: list[int]) -> np.ndarray:
    return np.sum(floats, axis=0)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors."""
    models = {}
    found = _combined(_partial(df, vector, _spectra), _merged)
    for dims in _some(found):
        own = df.where(F.size(vector).isin(dims))
        start = {d: (Model(found[d][0], found[d][1], np.zeros(0), np.zeros(0), np.zeros(0)), np.linalg.qr(_unpacked(d, found[d][0], found[d][2]).vectors)[0]) for d in dims}
        ritz = _combined(_partial(own, vector, _products(lambda d, x, start=start: start[d][0].centred(x) / start[d][0].n @ start[d][1])), _added)
        for d in dims:
            model, basis = start[d]
            values, turn = np.linalg.eigh(ritz[d][2].reshape(d, d) / model.n)
            order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > NOTHING * max(values[-1], 0)]
            models[d] = Model(model.n, model.sums, basis @ turn[:, order], values[order], values[order] / max(values.sum(), 1e-300))
        measured = _combined(_partial(own, vector, _products(lambda d, x, some={d: models[d] for d in dims}: np.column_stack([np.ones(len(x)), some[d].whiten(x)]))), _added)
        for d in dims:
            k = len(models[d].values)
            moments = measured[d][2].reshape(k + 1, k + 1) / models[d].n
            covariance = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
            models[d].identity_error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    return models


def _some(dims) -> list[list[int]]:
    dims = sorted(dims)
    return [dims[i : i + HELD] for i in range(0, len(dims), HELD)]


def transform(df: DataFrame, models: dict[int, Model], vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """For each vector and component the columns in keep with component, n, deviation, whitened, explained,
    identity_error."""
    keep = keep or []
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_vector"))
    schema = schema_of(df, keep, "component int, n long, deviation long, whitened double, explained double, identity_error double")

    def task(some: dict[int, Model]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, places, x in steps_of(b["_vector"]):
                    m = some[dim]
                    k, count = len(m.values), len(x)
                    apart = m.centred(x)
                    fits = (apart.astype(float) ** 2).sum(axis=1) < 9.2e18
                    deviation = pa.array(np.repeat((apart * apart).sum(axis=1), k), mask=np.repeat(~fits, k))
                    at = pa.array(np.repeat(places, k))
                    yield pa.RecordBatch.from_arrays(
                        [*[b[c].take(at) for c in keep], pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, m.n)), deviation,
                         pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.explained, count)), pa.array(np.full(count * k, m.identity_error))], schema=pa.schema([*[b.schema.field(c) for c in keep], *_OUT]))

        return run

    parts = [rows.where(F.size("_vector").isin(dims)).mapInArrow(task({d: models[d] for d in dims}), schema) for dims in _some(models)]
    return reduce(DataFrame.unionAll, parts) if parts else rows.where("false").mapInArrow(task({}), schema)


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    return transform(df, fit(df, vector), vector, keep)
