"""Smoothing of one key's path: a filter with its backward smoother, and splines whose knots are put in until they fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


# Pixels, and frames of a 30th of a second.
@dataclass(frozen=True)
class Motion:
    """noise: of a sure observation; accel: of a frame's change of speed; gate: standard deviations of what is still believed;
    unsure: the least confidence counted; place and speed: deviations at the start."""

    noise: float = 4.0
    accel: float = 6.0
    gate: float = 6.0
    unsure: float = 0.15
    place: float = 5.0
    speed: float = 20.0


def filtered(frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray, motion: Motion = Motion()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which observations are believed, and the smoothed x and y on every frame from the first to the last one.

    Speed is constant but for a random push in each frame. As x and y are pushed and observed alike and apart, they share
    one covariance, of a place and its speed: three numbers. An observation's deviation is noise over its
    confidence; one further than `gate` deviations from where it is expected is left out. The way back corrects each frame
    by what the frames after it showed. The first observation is believed.
    """
    return filtered_many([(frame, x, y, conf)], motion)[0]


#: Numbers of one array that hold many paths side by side.
CELLS = 1 << 17


def _side_by_side(lengths: list[int]) -> list[np.ndarray]:
    """Paths of like length, in parts of at most CELLS when all are as long as their longest (or of one path): longest first."""
    order, parts, a = np.argsort(-np.asarray(lengths), kind="stable"), [], 0
    while a < len(order):
        z = a + max(1, CELLS // max(1, lengths[order[a]]))
        parts.append(order[a:z])
        a = z
    return parts


def filtered_many(paths: list[tuple[np.ndarray, ...]], motion: Motion = Motion()) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """filtered() of many paths (frame, x, y, conf), a frame of all of them at a time."""
    out: list = [None] * len(paths)
    lengths = [int(p[0][-1] - p[0][0]) + 1 for p in paths]
    for part in _side_by_side(lengths):
        for i, found in zip(part, _filtered([paths[i] for i in part], np.array([lengths[i] for i in part]), motion), strict=True):
            out[i] = found
    return out


def _filtered(paths: list[tuple[np.ndarray, ...]], n: np.ndarray, motion: Motion) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The longest come first, so that those that still last are always the first ones."""
    most, many = int(n[0]), len(paths)
    seen, told, ok = np.full((most, 3, many), np.nan), np.zeros((most, many), dtype=bool), np.zeros((most, many), dtype=bool)
    own = np.repeat(np.arange(many), [len(p[0]) for p in paths])
    at = np.concatenate([p[0] - p[0][0] for p in paths]).astype(int)
    conf = np.concatenate([np.asarray(p[3], dtype=float) for p in paths])
    for i, v in enumerate((*(np.concatenate([p[c] for p in paths]) for c in (1, 2)), (motion.noise / np.maximum(conf, motion.unsure)) ** 2)):
        seen[at, i, own] = v
    told[at, own] = True
    mean, ahead = np.zeros((most, 4, many)), np.zeros((most, 4, many))  # frame, places and speeds, path
    cov, wide = np.zeros((most, 3, many)), np.zeros((most, 3, many))
    last = np.searchsorted(-n, -np.arange(most))  # paths of more frames than that
    px, py = (np.array([float(p[c][0]) for p in paths]) for c in (1, 2))
    vx, vy, a, b, c = (np.full(many, v) for v in (0.0, 0.0, motion.place**2, 0.0, motion.speed**2))
    push = motion.accel**2
    for t in range(most):
        k = last[t]
        if t:
            px, py, vx, vy, a, b, c = (v[:k] for v in (px, py, vx, vy, a, b, c))
            px, py = px + vx, py + vy
            a, b, c = a + 2 * b + c + push / 4, b + c + push / 2, c + push
        for i, v in enumerate((px, py, vx, vy)):
            ahead[t, i, :k] = v
        for i, v in enumerate((a, b, c)):
            wide[t, i, :k] = v
        ex, ey, s = seen[t, 0, :k] - px, seen[t, 1, :k] - py, a + seen[t, 2, :k]
        fits = told[t, :k] & (ex * ex + ey * ey <= motion.gate**2 * s)
        if fits.any():
            ok[t, :k] = fits
            ex, ey, g, m = (np.where(fits, v, 0.0) for v in (ex, ey, a / s, b / s))
            px, py, vx, vy = px + g * ex, py + g * ey, vx + m * ex, vy + m * ey
            a, b, c = a * (1 - g), b * (1 - g), c - m * b
        for i, v in enumerate((px, py, vx, vy)):
            mean[t, i, :k] = v
        for i, v in enumerate((a, b, c)):
            cov[t, i, :k] = v
    for t in range(most - 2, -1, -1):
        k = last[t + 1]
        a, b, c = cov[t, :, :k]
        p, q, r = wide[t + 1, :, :k]
        det = p * r - q * q
        off = mean[t + 1, :, :k] - ahead[t + 1, :, :k]
        # covariance with the next frame, over what was expected of that
        mean[t, :2, :k] += ((a + b) * r - b * q) / det * off[:2] + (b * p - (a + b) * q) / det * off[2:]
        mean[t, 2:, :k] += ((b + c) * r - c * q) / det * off[:2] + (c * p - (b + c) * q) / det * off[2:]
    believed = ok[at, own]
    # of two observations of a frame the later one counts
    believed[:-1] &= (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    ends = np.cumsum([0, *(len(p[0]) for p in paths)])
    return [(believed[ends[i] : ends[i + 1]], mean[: n[i], 0, i].copy(), mean[: n[i], 1, i].copy()) for i in range(many)]


def _bands_solve(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves symmetric positive systems side by side, each given by its diagonal and the ones above it: diagonal, row, system."""
    k, n = bands.shape[0] - 1, bands.shape[1]
    low, z = np.zeros((k + 1, *right.shape)), np.zeros(right.shape)  # low: how far left of the diagonal, row, system
    for i in range(n):
        for d in range(min(i, k), -1, -1):
            s = bands[d, i - d].copy()
            for e in range(d + 1, min(i, k) + 1):
                s -= low[e, i] * low[e - d, i - d]
            low[d, i] = s / low[0, i - d] if d else np.sqrt(np.maximum(s, 1e-300))
        s = right[i].copy()
        for e in range(min(i, k), 0, -1):
            s -= low[e, i] * z[i - e]
        z[i] = s / low[0, i]
    for i in range(n - 1, -1, -1):
        for e in range(1, min(n - 1 - i, k) + 1):
            z[i] -= low[e, i + e] * z[i + e]
        z[i] /= low[0, i]
    return z


def _values(knots: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The values at each x of the four cubic B-splines that are not 0 after knot number `at`."""
    value = np.zeros((4, len(x)))
    value[0] = 1.0
    for d in range(1, 4):
        for j in range(d, -1, -1):
            left, right = knots[at - d + j], knots[at + j]
            up = np.where(right > left, (x - left) / np.where(right > left, right - left, 1), 0) * value[j - 1] if j else 0.0
            next_left, next_right = knots[at + 1 - d + j], knots[at + 1 + j]
            down = np.where(next_right > next_left, (next_right - x) / np.where(next_right > next_left, next_right - next_left, 1), 0) * value[j] if j < d else 0.0
            value[j] = up + down
    return value.T


def basis(knots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first of the four cubic B-splines that are not 0 at each x, and their values. knots: with the ends four times."""
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, len(knots) - 5)
    return at - 3, _values(knots, at, x)


def _jumps(near: np.ndarray) -> np.ndarray:
    """For inner knots, each with the four before and after it, how much the third derivative of each of the five B-splines about it changes there."""
    out = np.empty((len(near), 5))
    for j in range(5):
        others = np.delete(near[:, j : j + 5], 4 - j, axis=1)
        out[:, j] = 6 * (near[:, j + 4] - near[:, j]) / np.prod(near[:, 4:5] - others, axis=1)
    return out


def _add(bands: np.ndarray, first: np.ndarray, own: np.ndarray, rows: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
    """Adds the products of rows (of neighbouring unknowns, from first on, of a system each) with themselves."""
    for i in range(rows.shape[1]):
        for j in range(i, rows.shape[1]):
            np.add.at(bands[j - i], (first + i, own), weight * rows[:, i] * rows[:, j])


def knotted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots and coefficients of the cubic spline with a sum of squared weighted residuals of `bound`, or less where a cubic will do.

    Knots are put in where the residuals are largest, in the middle point of an interval, as many at a time as the pace
    of the residual so far asks for, until a least squares spline meets the bound. Of all splines with these knots and
    that sum, the one whose third derivative jumps least is taken.
    """
    return knotted_many([(x, y, weight, bound)])[0]


def knotted_many(series: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """knotted() of many series (x, y, weight, bound), a round of all of them at a time."""
    out: list = [None] * len(series)
    for part in _side_by_side([len(s[0]) for s in series]):
        for i, found in zip(part, _Splines([series[i] for i in part]).found(), strict=True):
            out[i] = found
    return out


class _Splines:
    """Series whose points lie one series after the other, and systems that lie side by side."""

    def __init__(self, series: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> None:
        self.x, self.y, weight = (np.concatenate([np.asarray(s[i], dtype=float) for s in series]) for i in range(3))
        self.w2, self.bound = weight**2, np.array([s[3] for s in series], dtype=float)
        self.size = np.array([len(s[0]) for s in series])
        self.own = np.repeat(np.arange(len(series)), self.size)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.end = self.x[self.start + self.size - 1]
        self.cut = np.zeros(len(self.x), dtype=bool)  # points that begin an interval
        self.cut[self.start] = True
        same = np.append(False, (self.x[1:] == self.x[:-1]) & (self.own[1:] == self.own[:-1]))
        self.first_of = np.maximum.accumulate(np.where(same, 0, np.arange(len(self.x))))  # the first of equal points

    def layout(self, which: np.ndarray) -> None:
        """The knots, the B-splines at all points and the systems' sums of the series with these numbers."""
        place = np.full(len(self.size), -1)
        place[which] = np.arange(len(which))
        self.points = np.nonzero(place[self.own] >= 0)[0]
        self.of = place[self.own[self.points]]
        cut = self.points[self.cut[self.points]]
        of = place[self.own[cut]]
        self.inner = np.bincount(of, minlength=len(which)) - 1
        begin = np.concatenate([[0], np.cumsum(self.inner + 8)])
        self.begin = begin
        heads = np.concatenate([[0], np.cumsum(self.inner + 1)])[:-1]
        self.knots = np.empty(begin[-1])
        for i in range(4):
            self.knots[begin[:-1] + i], self.knots[begin[1:] - 1 - i] = self.x[self.start[which]], self.end[which]
        rank = np.arange(len(cut)) - heads[of]
        self.knots[begin[of] + 3 + rank] = self.x[cut]
        self.interval = np.cumsum(self.cut[self.points]) - 1
        self.first = self.interval - heads[self.of]
        self.value = _values(self.knots, begin[self.of] + 3 + self.first, self.x[self.points])
        self.cuts, self.cuts_of = cut, of
        n, w2 = int(self.inner.max()) + 4, self.w2[self.points]
        self.sums, self.right, self.bends = np.zeros((5, n, len(which))), np.zeros((n, len(which))), np.zeros((5, n, len(which)))
        _add(self.sums, self.first, self.of, self.value, w2)
        for i in range(4):
            np.add.at(self.right, (self.first + i, self.of), w2 * self.y[self.points] * self.value[:, i])
        self.blank = np.arange(n)[:, None] >= self.inner + 4  # rows that a system does not have
        self.sides = rank > 0

    def bend(self) -> None:
        """The systems' sums of jumps."""
        at, of = (self.begin[self.cuts_of] + 3 + self.first_rank())[self.sides], self.cuts_of[self.sides]
        _add(self.bends, self.first_rank()[self.sides] - 1, of, _jumps(self.knots[at[:, None] + np.arange(-4, 5)]))

    def first_rank(self) -> np.ndarray:
        heads = np.concatenate([[0], np.cumsum(self.inner + 1)])[:-1]
        return np.arange(len(self.cuts)) - heads[self.cuts_of]

    def fit(self, active: np.ndarray, p: np.ndarray | None) -> np.ndarray:
        n = int(self.inner[active].max()) + 4
        bands, right = self.sums[:, :n, active], self.right[:n, active]
        if p is not None:
            bands, right = p * bands + self.bends[:, :n, active], p * right
        bands[0] += 1e-13 * bands[0].max(axis=0)
        bands[0][self.blank[:n, active]] = 1.0
        return _bands_solve(bands, right)

    def missed(self, coefficients: np.ndarray, of: np.ndarray, points: slice | np.ndarray) -> np.ndarray:
        """Each point's squared weighted residual."""
        near = coefficients[self.first[points][:, None] + np.arange(4), of[:, None]]
        miss = (near * self.value[points]).sum(axis=1) - self.y[self.points[points]]
        return self.w2[self.points[points]] * miss**2

    def told(self, i: int, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.knots[self.begin[i] : self.begin[i + 1]].copy(), coefficients[: self.inner[i] + 4].copy()

    def found(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [None] * len(self.size)
        which, smooth = np.arange(len(self.size)), []
        many, last = np.ones(len(which), dtype=int), np.full(len(which), np.nan)
        rounds = 0
        while len(which):
            self.layout(which)
            coefficients = self.fit(np.arange(len(which)), None)
            missed = self.missed(coefficients, self.of, slice(None))
            total, bound = np.bincount(self.of, missed, minlength=len(which)), self.bound[which]
            worst = np.bincount(self.interval, missed, minlength=len(self.cuts))
            # an interval can be cut at a point strictly within it
            x = self.x[self.points]
            free = (x > self.x[self.cuts][self.interval]) & (x < self.end[which][self.of])
            count = np.bincount(self.interval[free], minlength=len(self.cuts))
            able = count > 0
            done = (total <= bound) | ~np.bincount(self.cuts_of, able, minlength=len(which)).astype(bool) | (self.inner + 4 >= self.size[which])
            for i in np.nonzero(done)[0]:
                if self.inner[i] and not total[i] > bound[i]:
                    smooth.append(which[i])
                else:
                    out[which[i]] = self.told(i, coefficients[:, i])
            if rounds:
                gain = last - total
                steady = gain > 1e-3 * bound
                pace = np.where(steady, many * (total - bound) / np.where(steady, gain, 1.0), 2 * many)
                many = np.minimum(2 * many, np.maximum(np.maximum(pace, many // 2), 1)).astype(int)
            rounds += 1
            able &= ~done[self.cuts_of]
            chosen = np.nonzero(able)[0]
            chosen = chosen[np.lexsort((chosen, -worst[chosen], self.cuts_of[chosen]))]
            of = self.cuts_of[chosen]
            chosen = chosen[np.arange(len(of)) - np.searchsorted(of, of) < many[of]]
            begins = np.concatenate([[0], np.cumsum(count)])
            middle = self.points[np.nonzero(free)[0][begins[chosen] + count[chosen] // 2]]
            self.cut[self.first_of[middle]] = True
            which, many, last = which[~done], many[~done], total[~done]
        if smooth:
            self.smoothed(np.array(smooth), out)
        return out

    def smoothed(self, which: np.ndarray, out: list) -> None:
        """The weight of residuals, as a power of ten, is halved in until they sum to the bound."""
        which = np.sort(which)
        self.layout(which)
        self.bend()
        low, high = np.full(len(which), -12.0), np.full(len(which), 12.0)
        active, points, of = np.arange(len(which)), np.arange(len(self.points)), self.of
        for left in range(59, -1, -1):
            mid = (low[active] + high[active]) / 2
            coefficients = self.fit(active, 10.0**mid)
            total, bound = np.bincount(of, self.missed(coefficients, of, points), minlength=len(active)), self.bound[which[active]]
            done = np.abs(total - bound) <= 1e-4 * bound if left else np.ones(len(active), dtype=bool)
            for i in np.nonzero(done)[0]:
                out[which[active[i]]] = self.told(active[i], coefficients[:, i])
            over = total > bound
            low[active], high[active] = np.where(over, mid, low[active]), np.where(over, high[active], mid)
            if done.all():
                return
            keep = ~done[of]
            points, of = points[keep], (np.cumsum(~done) - 1)[of[keep]]
            active = active[~done]


def spline_at(knots: np.ndarray, coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    first, value = basis(knots, np.asarray(x, dtype=float))
    return (coefficients[first[:, None] + np.arange(4)] * value).sum(axis=1)
