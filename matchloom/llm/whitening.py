"""Whitening of embeddings by principal components from FEAST contour integration.

The covariance of the fit list is summed in tasks: one pass for the exact sums, one for products of
centred rows. Its leading eigenpairs come from FEAST (Polizzi 2009): inertia counts of shifted
covariances (Sylvester) find an interval that holds exactly the wanted eigenvalues, a quadrature of
complex shifted solves around it projects a block of vectors onto their space, Rayleigh-Ritz extracts
the pairs, and the inertia of both ends verifies that none is missed. The driver only holds matrices
of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.shared import stored, work_folder
from matchloom.llm.vectors import is_finite, list_array, matrices, vector_column

SCALE = 256
COMPONENTS = 4
#: Quadrature nodes on the upper half of the contour; the lower half is its mirror image.
NODES = 16
#: Eigenvalues up to this part of the trace count as zero: they cannot be divided by.
ZERO = 1e-12


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: positive pivots of its LDL'.

    Pivots are single diagonal entries or two by two blocks, chosen by Bunch and Parlett's rule,
    which keeps the growth of the entries bounded.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        k = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[k] >= 0.6404 * off[i, j]:
            chosen = [k]
        else:
            chosen = [i, j]
        rest = np.setdiff1d(np.arange(len(a)), chosen)
        block = a[np.ix_(chosen, chosen)]
        if len(chosen) == 1:
            positive += block[0, 0] > 0
            if block[0, 0] == 0:  # nothing but zeros is left
                break
        else:  # the larger entry is off the diagonal: one root of each sign
            positive += 1
        side = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(positive)


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix inside (low, high), by falling eigenvalue."""
    d = len(matrix)
    size = min(d, 2 * count + 8)
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - at)
    turn = np.exp(1j * angle)
    norm = np.linalg.norm(matrix)
    block = np.random.default_rng(d).standard_normal((d, size))
    for _ in range(rounds):
        # The projector (2 pi i)^-1 times the integral of (z - V)^-1 over the circle, on the block.
        projected = np.zeros((d, size))
        for z, w in zip(turn, weight, strict=True):
            solved = np.linalg.solve((centre + radius * z) * np.eye(d) - matrix, block.astype(complex))
            projected += w / 2 * (radius * z * solved).real
        basis, _ = np.linalg.qr(projected)
        value, small = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ small
        inside = np.flatnonzero((value > low) & (value < high))[::-1]
        if len(inside) == count:
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * value[inside], axis=0)
            if residual.max() <= 1e-14 * norm * np.sqrt(d):
                break
    if len(inside) != count:
        raise ArithmeticError(f"inertia counts {count} eigenvalues in ({low}, {high}), the projection holds {len(inside)}")
    return value[inside], block[:, inside]


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, above zero, and their unit eigenvectors as columns.

    Of eigenvalues that coincide to about 1e-13 of the trace, any basis of their space will do.
    """
    trace = float(np.trace(matrix))
    if not len(matrix) or trace <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor = ZERO * trace
    count = min(wanted, eigenvalues_above(matrix, floor))
    # Bisection until exactly ``count`` lie above, then on towards the middle of the gap below them.
    low, high = floor, top
    if eigenvalues_above(matrix, low) > count:
        while high - low > 1e-13 * trace:
            middle = (low + high) / 2
            above = eigenvalues_above(matrix, middle)
            if above == count:
                break
            low, high = (middle, high) if above > count else (low, middle)
        else:
            middle = low  # the last wanted one coincides with others: take them all, then the first
        if eigenvalues_above(matrix, middle) == count:
            ends = []
            for want in (True, False):
                a, b = (low, middle) if want else (middle, high)
                for _ in range(30):
                    c = (a + b) / 2
                    same = eigenvalues_above(matrix, c) == count
                    a, b = (a, c) if same == want else (c, b)
                ends.append(b if want else a)
            middle = sum(ends) / 2
        low = middle
    found = [feast(matrix, a, b, held) for a, b, held in _intervals(matrix, low, top)]
    value, vector = np.concatenate([v for v, _ in found]), np.hstack([u for _, u in found])
    if len(value) != eigenvalues_above(matrix, low):
        raise ArithmeticError("an eigenvalue was missed")
    return value[:count], vector[:, :count]


def _intervals(matrix: np.ndarray, low: float, high: float, above: int = 0):
    """(low, high, eigenvalues inside) from the top down, cut until no end is over four times the other.

    A contour much wider than the distance of its ends from the eigenvalues would hardly tell them apart.
    """
    held = eigenvalues_above(matrix, low) - above
    if not held:
        return []
    if high <= 4 * low:
        return [(low, high, held)]
    cut = np.sqrt(low * high)
    upper = _intervals(matrix, cut, high, above)
    return upper + _intervals(matrix, low, cut, above + sum(n for _, _, n in upper))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``count`` distinct vectors with ``sums``, and the components of their covariance."""

    count: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.sums / max(1, self.count)) @ self.vectors) / np.sqrt(self.values)


def _vector_sums(batches):
    count, sums = 0, None
    for batch in batches:
        for _, x in matrices(batch.column("x")):
            part = [sum(c) for c in x.T.tolist()] if len(x) and int(np.abs(x).max()) > (1 << 40) else x.sum(axis=0).tolist()
            count, sums = count + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
    if sums is not None:
        at = [-1, *range(len(sums))]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([str(v) for v in (count, *sums)])], ["at", "part"])


def _products(count: int, sums: np.ndarray):
    mean = sums / count

    def run(batches):
        total = None
        for batch in batches:
            for _, x in matrices(batch.column("x")):
                centred = x - mean
                total = centred.T @ centred if total is None else total + centred.T @ centred
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), list_array(total)], ["at", "part"])

    return run


def _whitened_products(fit: Whitening):
    def run(batches):
        total = np.zeros((len(fit.values),) * 2)
        for batch in batches:
            for _, x in matrices(batch.column("x")):
                w = fit.apply(x)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), list_array(total)], ["at", "part"])

    return run


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The matrix whose rows are summed over tasks; as many numbers as one matrix has."""
    cells = parts.select("at", F.posexplode("part").alias("k", "v")).groupBy("at", "k").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.toLocalIterator():
        out[r["at"], r["k"]] = r["v"]
    return (out + out.T) / 2


def _transformed(fit: Whitening, error: float):
    ones = len(fit.values)
    held = max((abs(v) for v in fit.sums.tolist()), default=0)

    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch.column("x")):
                w = fit.apply(x)
                bound = fit.count * int(np.abs(x).max(initial=0)) + held
                if len(fit.sums) * bound * bound < 1 << 63:
                    part = fit.count * x - np.array(fit.sums, dtype=np.int64)
                    deviation = (part * part).sum(axis=1).tolist()
                else:
                    deviation = [sum((fit.count * a - s) ** 2 for a, s in zip(row, fit.sums.tolist(), strict=True)) for row in x.tolist()]
                again = np.repeat(np.arange(len(rows)), ones)
                exact = pa.array([str(deviation[i]) for i in again])
                short = pa.array([deviation[i] if deviation[i] < 1 << 63 else None for i in again], pa.int64())
                n = len(again)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[again])), pa.array(np.tile(np.arange(1, ones + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(n, fit.count)), short, pa.array(w.ravel()), pa.array(np.tile(fit.values / fit.trace, len(rows))),
                        pa.array(np.full(n, error)), exact,
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

    return run


def _whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and x of the rows that count, all of one length: the most frequent, the longest of such."""
    e = vector_column(rows, "embedding")
    x = F.transform(e, lambda v: F.floor(v.cast("double") * scale))
    whole = rows.where(is_finite(e)).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    length = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("x") == (length["d"] if length else 0))


def fit_whitening(whole: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """The whitening of the distinct x of ``whole``, and the largest entry by which its covariance misses the identity."""
    fit_list = stored(whole.select("x").distinct(), work_folder(whole.sparkSession, "whitening"), "fit_list")
    sums = fit_list.mapInArrow(_vector_sums, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("v"))
    found = {r["at"]: int(r["v"]) for r in sums.toLocalIterator()}
    count, d = found.pop(-1, 0), len(found)
    total = np.array([found[i] for i in range(d)], dtype=object)
    if not count:
        return Whitening(0, total, np.zeros(0), np.zeros((0, 0)), 0.0), 0.0
    covariance = _summed(fit_list.mapInArrow(_products(count, total.astype(float)), "at int, part array<double>"), d) / count
    values, vectors = leading_pairs(covariance, components)
    fit = Whitening(count, total, values, vectors, float(np.trace(covariance)))
    if not len(values):
        return fit, 0.0
    identity = _summed(fit_list.mapInArrow(_whitened_products(_plain(fit)), "at int, part array<double>"), len(values)) / count
    return fit, float(np.abs(identity - np.eye(len(values))).max())


def _plain(fit: Whitening) -> Whitening:
    return Whitening(fit.count, fit.sums.astype(float), fit.values, fit.vectors, fit.trace)


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of ``rows`` that counts.

    Each component c of a vector becomes x = floor(``scale`` * c); the fit list is every distinct x once.
    Rows with a null or empty vector, or a null or non-finite component, are dropped, and so are
    vectors of another length than the most frequent (of lengths as frequent, the longest). A null
    vec_id is kept. Repeated rows give repeated results. Components with an eigenvalue of zero are
    left out: a table of one distinct vector, or an empty table, gives no row. Other columns are not
    read. ``deviation`` is null where no long holds it; ``deviation_digits`` always has it.
    """
    whole = stored(_whole_vectors(rows, scale), work_folder(rows.sparkSession, "whitening"), "rows")
    fit, error = fit_whitening(whole, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    return whole.mapInArrow(_transformed(fit, error), schema)
