"""Eigenpairs of a symmetric matrix by contour integration (FEAST), its independent steps run as Spark tasks.

Inertia counts (the negative pivots of a symmetric elimination of V - s) say how many eigenvalues
lie below s. By them the range is cut, from the top, into intervals of few eigenvalues. For each
interval a random block is projected onto its eigenvectors: the resolvent (z - V)^-1 is integrated along
a circle through the interval's ends by Gauss-Legendre quadrature, one complex solve a node.
Rayleigh-Ritz in the projected space gives the pairs; the block is projected anew until residuals
are at rounding level, and the pairs within an interval must be as many as the inertia
counts say, or it starts anew with a wider block. The integral dampens eigenvalues outside the circle
by their distance only, so a block is as wide as the eigenvalues near the circle are many, by inertia counts too."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: A 1 x 1 pivot serves if it is at least this share of the largest other entry, else a 2 x 2 one.
PIVOT_SHARE = (1 + 17**0.5) / 8
SHIFTS_A_CUT, MOST_CUTS = 16, 40
ROUNDS, STARTS = 12, 4
#: Intervals are not cut below this share of the largest eigenvalue: what lies so close is one cluster.
NARROW = 1e-9
#: Eigenvalues within this multiple of a circle's radius are near it: beyond, eight nodes leave 1.5^-16 of a direction.
NEAR = 1.5


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below `shift`."""
    m, negative = v - shift * np.eye(len(v)), 0
    while len(m):
        size = np.abs(m)
        p = int(size.diagonal().argmax())
        one = size[p, p]
        np.fill_diagonal(size, 0)
        r, s = divmod(int(size.argmax()), len(m))
        if one >= PIVOT_SHARE * size[r, s]:
            if one == 0:
                break  # all that is left is zero
            negative += bool(m[p, p] < 0)
            keep = np.delete(np.arange(len(m)), p)
            column = m[keep, p]
            m = m[np.ix_(keep, keep)] - np.outer(column, column / m[p, p])
        else:
            negative += 1  # such a block has one eigenvalue of each sign
            keep = np.delete(np.arange(len(m)), [r, s])
            columns = m[np.ix_(keep, [r, s])]
            m = m[np.ix_(keep, keep)] - columns @ np.linalg.solve(m[np.ix_([r, s], [r, s])], columns.T)
        m = (m + m.T) / 2
    return negative


@dataclass
class Interval:
    low: float
    high: float
    count: int
    near: int = 0

    def around(self) -> tuple[float, float]:
        """The ends of the circle's wider neighbourhood."""
        middle, radius = (self.low + self.high) / 2, (self.high - self.low) / 2
        return middle - NEAR * radius, middle + NEAR * radius

    def nodes(self, n: int) -> list[tuple[complex, complex]]:
        """(z, weight) of the upper half circle."""
        t, w = np.polynomial.legendre.leggauss(n)
        turn = (self.high - self.low) / 2 * np.exp(1j * np.pi * (1 + t) / 2)
        return list(zip((self.low + self.high) / 2 + turn, w / 2 * turn, strict=True))


class Contour:
    """v: symmetric, not negative definite. Its entries go to the executors: 8 bytes times the square of
    its order, whatever the number of rows it was gathered from."""

    def __init__(self, spark: SparkSession, v: np.ndarray, nodes: int = 8, most_in_interval: int = 16, seed: int = 11):
        self.spark, self.v, self.nodes, self.most_in_interval = spark, v, nodes, most_in_interval
        self.top = float(np.abs(v).sum(1).max())  # no eigenvalue lies above
        self.shared = spark.sparkContext.broadcast(v)
        self.rng = np.random.default_rng(seed)

    def counts(self, shifts: list[float]) -> dict[float, int]:
        """Eigenvalues at or above each shift, each count a task's."""
        shared = self.shared

        def count(batches):
            for b in batches:
                s = b.column("shift").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([len(shared.value) - below(shared.value, x) for x in s], pa.int64())], names=["shift", "n"])

        rows = self.spark.createDataFrame([(float(s),) for s in shifts], "shift double").mapInArrow(count, "shift double, n long").collect()
        return {r.shift: r.n for r in rows}

    def intervals(self, wanted: int, floor: float) -> list[Interval]:
        """Intervals from the top down that hold the `wanted` largest eigenvalues, or all that lie above `floor`."""
        # Cuts are placed at random, so that none falls on an eigenvalue of a regular matrix.
        cuts = lambda lo, hi: [lo + (hi - lo) * (i + float(u)) / SHIFTS_A_CUT for i, u in enumerate(self.rng.uniform(0.25, 0.75, SHIFTS_A_CUT))]
        top = self.top * (1 + 1e-6)
        known = {top: 0} | self.counts([floor, *cuts(floor, top)])
        for _ in range(MOST_CUTS):
            points = sorted(known, reverse=True)
            wide = [(lo, hi) for hi, lo in zip(points, points[1:], strict=False) if known[hi] < wanted and known[lo] - known[hi] > self.most_in_interval and hi - lo > NARROW * self.top]
            if not wide:
                break
            known |= self.counts([s for lo, hi in wide for s in cuts(lo, hi)])
        out: list[Interval] = []  # neighbours are joined, but not over a gap: an outlier would stretch the circle
        for hi, lo in zip(points, points[1:], strict=False):
            held = known[lo] - known[hi]
            if known[hi] >= wanted:
                break
            if not held:
                continue
            if out and out[-1].low == hi and out[-1].count + held <= self.most_in_interval:
                out[-1] = Interval(lo, out[-1].high, out[-1].count + held)
            else:
                out.append(Interval(lo, hi, held))
        at = self.counts([s for i in out for s in i.around()])
        return [Interval(i.low, i.high, i.count, at[low] - at[high]) for i in out for low, high in [i.around()]]

    def projected(self, work: list[tuple[Interval, np.ndarray]]) -> list[np.ndarray]:
        """The part of each block that lies in its interval's eigenspace: a complex solve for each
        interval and node, each a task's."""
        shared, blocks = self.shared, self.spark.sparkContext.broadcast([y for _, y in work])
        steps = [(i, float(z.real), float(z.imag), float(w.real), float(w.imag)) for i, (interval, _) in enumerate(work) for z, w in interval.nodes(self.nodes)]

        def solve(batches):
            for b in batches:
                for i, zr, zi, wr, wi in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    v = shared.value
                    q = np.real(complex(wr, wi) * np.linalg.solve(complex(zr, zi) * np.eye(len(v)) - v, blocks.value[i].astype(complex)))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([q.tobytes()], pa.binary())], names=["i", "q"])

        out = [np.zeros_like(y) for _, y in work]
        for r in self.spark.createDataFrame(steps, "i int, zr double, zi double, wr double, wi double").mapInArrow(solve, "i int, q binary").collect():
            out[r.i] += np.frombuffer(r.q).reshape(out[r.i].shape)
        return out

    def block(self, interval: Interval, start: int) -> np.ndarray:
        width = min(len(self.v), max(interval.count * (3 + 2 * start) // 2, interval.near + start * interval.count) + 4)
        return np.linalg.qr(self.rng.standard_normal((len(self.v), width)))[0]

    def ritz(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors) of V within the span of q."""
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = np.linalg.qr(u[:, s > s.max(initial=0) * 1e-13])[0]
        value, mix = np.linalg.eigh(u.T @ self.v @ u)
        return value, u @ mix

    def largest(self, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(values, unit vectors as columns) of the `wanted` largest eigenvalues that lie above `floor`."""
        found: list[np.ndarray] = []
        open_ = [(i, self.block(i, 0), 0, 0, np.inf) for i in self.intervals(wanted, floor)]
        while open_:
            again = []
            for (interval, _, start, turn, last), q in zip(open_, self.projected([(i, y) for i, y, *_ in open_]), strict=True):
                value, vector = self.ritz(q)
                inside = (value >= interval.low) & (value < interval.high)
                residual = np.sqrt(((self.v @ vector - vector * value) ** 2).sum(0)) / self.top
                worst = float(residual[inside].max(initial=0))
                # At rounding level, or no longer falling near it.
                if inside.sum() == interval.count and (worst < 1e-15 * len(self.v) ** 0.5 or worst < 1e-12 and worst > last / 4):
                    found.append(vector[:, inside])
                elif turn < ROUNDS:
                    again.append((interval, vector, start, turn + 1, worst if inside.sum() == interval.count else np.inf))
                elif start < STARTS:
                    again.append((interval, self.block(interval, start + 1), start + 1, 0, np.inf))
                else:
                    raise RuntimeError(f"{interval.count} eigenvalues counted in an interval, {int(inside.sum())} found")
            open_ = again
        if not found:
            return np.zeros(0), np.zeros((len(self.v), 0))
        value, vector = self.ritz(np.concatenate(found, 1))
        order = np.argsort(-value, kind="stable")[:wanted]
        vector = vector[:, order]
        return value[order], vector * np.where(vector[np.abs(vector).argmax(0), np.arange(len(order))] < 0, -1, 1)
