"""Distances between the rows of two matrices, and cheap bounds that spare most of them.

A ``Screen`` names all pairs of rows that may be as near as a limit: it takes
a lower bound of each distance from single-precision products or from single
bytes, with room for its rounding, so no pair is lost.  What it names is then
measured in full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..errors import require

#: Numbers of an intermediate result: 2 MB of doubles.
CELLS = 1 << 18


def l2_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By one product of matrices; pairs that are near compared with their own lengths are subtracted first."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = a @ (-2.0 * b.T)
    d += aa[:, None]
    d += bb
    close = np.flatnonzero(~(d.ravel() > 1e-5 * (aa.max(initial=0) + bb.max(initial=0))))
    for i in range(0, len(close), CELLS // 16):
        r, c = np.divmod(close[i : i + CELLS // 16], max(1, len(b)))
        e = a[r] - b[c]
        d[r, c] = np.einsum("ij,ij->i", e, e)
    return d


def _power(x: np.ndarray, p: float) -> np.ndarray:
    """Small whole powers by products, which take a tenth of the time."""
    return x * x * x if p == 3 else x * x if p == 2 else x**p


def differences(metric: str, p: float = 2.0) -> Callable[[np.ndarray], np.ndarray]:
    """The distance, from differences along the last axis."""
    kinds = {
        "l2": lambda d: np.sqrt(np.einsum("...k,...k->...", d, d)),
        "l1": lambda d: np.abs(d).sum(axis=-1),
        "linf": lambda d: np.abs(d).max(axis=-1),
        "lp": lambda d: _power(np.abs(d), p).sum(axis=-1) ** (1 / p),
        "wasserstein": lambda d: np.abs(d.cumsum(axis=-1)).sum(axis=-1),
    }
    require(metric in kinds, f"no such distance: {metric}")
    require(metric != "lp" or p >= 1, "p is at least 1")
    return kinds[metric]


def block_distance(metric: str, p: float = 2.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances between all rows of two matrices."""
    f = differences(metric, p)
    if metric == "l2":
        return lambda a, b: np.sqrt(l2_squared(a, b))

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        cols = max(1, min(len(b), CELLS // max(1, a.shape[1])))
        rows = max(1, CELLS // max(1, cols * a.shape[1]))
        for i in range(0, len(a), rows):
            for j in range(0, len(b), cols):
                out[i : i + rows, j : j + cols] = f(a[i : i + rows, None, :] - b[None, j : j + cols, :])
        return out

    return run


class Screen:
    """Pairs that may be as near as a limit, by lower bounds around a common centre.

    ``right`` prepares a block once, ``under`` meets it with prepared left rows.
    """

    def __init__(self, metric: str, p: float, sample: np.ndarray) -> None:
        """``sample``: some rows, to choose the centre and the bytes' range; any will do for right results."""
        self.metric, self.p = metric, p
        x = self._turned(sample)
        x = x[np.isfinite(x).all(axis=1)] if len(x) else x
        self.width = sample.shape[1]
        self.centre = np.median(x, axis=0) if len(x) else np.zeros(self.width)
        self.bytes = metric in ("l1", "linf", "wasserstein")
        if self.bytes:
            # differences fit a signed byte; l1: six bits, so that four of them fit a byte's sum
            self.levels = 127 if metric == "linf" else 63
            spread = np.abs(x - self.centre) if len(x) else np.zeros((1, self.width))
            reach = float(spread.max(initial=0.0)) if metric == "linf" else float(np.quantile(spread, 0.998, axis=0).max())
            self.step = 2 * reach / self.levels if reach > 0 else 1.0

    def _turned(self, x: np.ndarray) -> np.ndarray:
        """Wasserstein distances are l1 distances of running sums."""
        return x.cumsum(axis=1) if self.metric == "wasserstein" else x

    def _as_bytes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns as bytes, and what each row lost by that in all (linf: at most in one column)."""
        z = (self._turned(x) - self.centre) / self.step + self.levels / 2
        with np.errstate(invalid="ignore"):
            q = np.clip(np.rint(z), 0, self.levels)
        lost = np.abs(z - q)
        lost = (lost.max(axis=1) if self.metric == "linf" else lost.sum(axis=1)) * self.step
        q[~np.isfinite(q)] = 0
        lost[~np.isfinite(lost)] = np.inf
        return np.ascontiguousarray(q.T.astype(np.int8)), lost

    def _single(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision rows and their squared lengths; rows whose products could overflow are no numbers."""
        z = (x - self.centre).astype(np.float32)
        zz = np.einsum("ij,ij->i", z, z, dtype=np.float64)
        z[~(zz < 1e36)] = np.nan
        return z, zz

    def left(self, a: np.ndarray) -> tuple:
        if self.bytes:
            return self._as_bytes(a)
        with np.errstate(over="ignore", invalid="ignore"):
            z, zz = self._single(a)
            return np.column_stack([z, np.ones(len(z), np.float32)]), zz

    def right(self, b: np.ndarray) -> tuple:
        if self.bytes:
            q, lost = self._as_bytes(b)
            return q, lost
        with np.errstate(over="ignore", invalid="ignore"):
            z, zz = self._single(b)
            return np.ascontiguousarray(np.column_stack([-2 * z, zz.astype(np.float32)]).T), zz

    def under(self, a: tuple, b: tuple, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of a, row of b) of all pairs whose distance may be the row's limit or less."""
        return self._by_bytes(a, b, limit) if self.bytes else self._by_product(a, b, limit)

    def closer(self, a: tuple, b: tuple, limits: np.ndarray) -> np.ndarray:
        """Rows of b that may be as near to a single row of a as their own limits; by products alone."""
        (x, xx), (y, yy) = a, b
        most = limits * (self.width ** max(0.0, 0.5 - 1 / self.p) if self.metric == "lp" else 1.0)
        with np.errstate(over="ignore", invalid="ignore"):
            room = 4 * (self.width + 8) * 2.0**-24 * (xx[0] + yy + np.sqrt(xx[0] * yy))
            bound = most * most * (1 + 1e-6) + room - xx[0]
            s = (x @ y)[0]
        return np.flatnonzero(~(s > bound) & ~np.isnan(limits))

    def _by_product(self, a: tuple, b: tuple, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, xx), (y, yy) = a, b
        n, m = len(x), y.shape[1]
        if not n or not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # l2 <= width ** (1/2 - 1/p) * lp if p >= 2, l2 <= lp if p <= 2
        most = limit * (self.width ** max(0.0, 0.5 - 1 / self.p) if self.metric == "lp" else 1.0)
        with np.errstate(over="ignore", invalid="ignore"):
            top = yy[yy < 1e36].max(initial=0)
            room = 4 * (self.width + 8) * 2.0**-24 * (xx + top + np.sqrt(xx * top))
            bound = (most * most * (1 + 1e-6) + room - xx).astype(np.float32)
            bound = np.nextafter(bound, np.float32(np.inf))
            s = x @ y
        far = s > bound[:, None]  # what isn't a number stays
        return np.divmod(np.flatnonzero(~far.ravel()), m)

    def _by_bytes(self, a: tuple, b: tuple, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, xl), (y, yl) = a, b
        n, m = x.shape[1], y.shape[1]
        found_r, found_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = max(1, CELLS // max(1, 2 * m))
        apart, four = np.empty((rows, m), np.int8), np.empty((rows, m), np.uint8)
        total = np.empty((rows, m), np.int8 if self.metric == "linf" else np.uint16 if 63 * self.width < 65536 else np.uint32)
        with np.errstate(invalid="ignore"):
            most = (limit + xl) * (1 + 1e-9) / self.step
            slack = yl / self.step
            slack = np.where(np.isfinite(slack), slack, np.inf)
        whole = np.isfinite(slack)
        extra = np.ceil(slack[whole].max(initial=0.0))
        for i in range(0, n, rows):
            k = min(rows, n - i)
            diff, acc, out = apart[:k], four[:k], total[:k]
            size = diff.view(np.uint8)
            out[:] = 0
            for j in range(self.width):  # a maximum of a column and a row isn't vectorised, a difference is
                np.subtract(x[j, i : i + k, None], y[j][None], out=diff)
                np.abs(diff, out=diff)
                if self.metric == "linf":
                    np.maximum(out, diff, out=out)
                    continue
                if j % 4:
                    np.add(acc, size, out=acc)
                else:
                    acc[:] = size
                if j % 4 == 3 or j == self.width - 1:
                    np.add(out, acc, out=out)
            top = np.iinfo(out.dtype).max
            bound = most[i : i + k] + extra
            bound = np.where(bound < top, np.floor(np.where(np.isfinite(bound), bound, 0)) + 1, top)  # NaN and inf: everything
            bound = np.minimum(bound, top).astype(out.dtype)
            near = out <= bound[:, None]
            if not whole.all():
                near[:, ~whole] = True
            r, c = np.divmod(np.flatnonzero(near.ravel()), m)
            kept = ~(out[r, c] > most[i + r] + slack[c] + 1)
            found_r.append(r[kept] + i)
            found_c.append(c[kept])
        return np.concatenate(found_r), np.concatenate(found_c)


def measured(f: Callable[[np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs (a[r], b[c])."""
    step = max(1, CELLS // max(1, a.shape[1]))
    return np.concatenate([np.zeros(0), *[f(a[r[i : i + step]] - b[c[i : i + step]]) for i in range(0, len(r), step)]])


class Nearest:
    """The k nearest right rows of each of some left rows, blocks of right rows coming one after another.

    Ties go to the smaller id.
    """

    def __init__(self, a: np.ndarray, k: int, metric: str, p: float, screen: Screen) -> None:
        self.a, self.k, self.screen = a, k, screen
        self.f = differences(metric, p)
        self.ready = screen.left(a)
        n = len(a)
        self.distance = np.full((n, k), np.inf)
        self.known = np.zeros((n, k), bool)
        self.id: np.ndarray | None = None
        self.seen = 0
        #: Pairs whose distance was computed in full.
        self.measured = 0

    def meet(self, b: np.ndarray, ids: np.ndarray) -> None:
        """In steps that grow with what has been seen, so that the limits are close before most rows come."""
        at = 0
        while at < len(b):
            step = max(64, 4 * self.k, min(4096, 3 * self.seen))
            self._meet(b[at : at + step], ids[at : at + step])
            at += step
            self.seen += step

    def _meet(self, b: np.ndarray, ids: np.ndarray) -> None:
        if self.id is None:
            self.id = np.zeros((len(self.a), self.k), ids.dtype)
        ready = self.screen.right(b)
        for i in range(0, len(self.a), 512):
            part = slice(i, min(i + 512, len(self.a)))
            limit = np.where(self.known[part, -1], self.distance[part, -1], np.inf)
            own = tuple(x[:, part] if self.screen.bytes and x.ndim == 2 else x[part] for x in self.ready)
            r, c = self.screen.under(own, ready, limit)
            if not len(r):
                continue
            d = measured(self.f, self.a[part], b, r, c)
            self.measured += len(d)
            kept = ~(d > limit[r])
            self._merge(r[kept] + i, d[kept], ids[c[kept]])

    def _merge(self, r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(r)
        old = self.known[rows]
        r = np.concatenate([np.repeat(rows, self.k)[old.ravel()], r])
        d = np.concatenate([self.distance[rows][old], d])
        ids = np.concatenate([self.id[rows][old], ids])
        order = np.lexsort((ids, d, r))
        r, d, ids = r[order], d[order], ids[order]
        starts = np.searchsorted(r, rows)
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        top = place < self.k
        self.known[rows] = False
        self.distance[r[top], place[top]], self.id[r[top], place[top]], self.known[r[top], place[top]] = d[top], ids[top], True
