"""Small numpy kernels for one group's rows; Spark partitions and orders what they get."""

from __future__ import annotations

import numpy as np

from .smoothing import Motion, filtered_many, knotted_many, spline_at


def begins(of: np.ndarray) -> np.ndarray:
    """Where each series begins, of those that lie one after the other."""
    return np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1]) if len(of) else np.zeros(0, dtype=np.int64)


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Places of local maxima. A plateau counts once, at its middle (the lower one of two); the ends are never peaks.

    distance: of two peaks nearer than that the lower goes, the earlier of equal ones. prominence: the height above the
    higher of the two lowest points between the peak and higher ground (or the end) on either side. of: where many series
    lie one after the other, the number of each place's series, in order.
    """
    x = np.asarray(x, dtype=float)
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    of = np.zeros(len(x), dtype=np.int64) if of is None else of
    new = np.nonzero((x[1:] != x[:-1]) | (of[1:] != of[:-1]))[0] + 1
    level, own = x[np.append(0, new)], of[np.append(0, new)]
    up = np.nonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]) & (own[2:] == own[:-2]))[0]
    peaks = (new[up] + new[up + 1] - 1) // 2
    if distance > 1 and len(peaks) > 1:
        # peaks of two series are never near each other
        at, keep = (peaks + of[peaks] * (len(x) + distance)).tolist(), [True] * len(peaks)
        for j in np.lexsort((np.arange(len(peaks)), x[peaks]))[::-1].tolist():
            if keep[j]:
                for step in (-1, 1):
                    i = j + step
                    while 0 <= i < len(at) and abs(at[i] - at[j]) < distance:
                        keep[i] = False
                        i += step
        peaks = peaks[np.array(keep, dtype=bool)]
    if prominence is not None:
        peaks = peaks[prominences(x, peaks, of) >= prominence]
    return peaks


def prominences(x: np.ndarray, peaks: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    if not len(peaks):
        return np.zeros(0)
    of = np.zeros(len(x), dtype=np.int64) if of is None else of
    tops = find_peaks(x, of=of)
    among = np.searchsorted(tops, peaks)
    if not np.isnan(x).any() and len(tops) and (tops[np.minimum(among, len(tops) - 1)] == peaks).all():
        # higher ground is a higher top, or falls from the end without a valley between: the lowest points by top are all that is needed
        own = of[tops]
        first = begins(own)
        last = np.append(first[1:], len(tops)) - 1
        a, z = np.concatenate([[0], tops[:-1]]), np.concatenate([tops[1:], [0]])
        a[first], z[last] = np.searchsorted(of, own[first]), np.searchsorted(of, own[last], side="right") - 1
        begin, end = np.zeros((2, len(tops)), dtype=bool)
        begin[first], end[last] = True, True
        edges, padded = np.empty((len(tops), 2), dtype=np.int64), np.concatenate([x, [np.inf]])
        edges[:, 0], edges[:, 1] = a, tops + 1
        level, low = x[tops].tolist(), np.minimum.reduceat(padded, edges.ravel())[::2].tolist()
        left = _valleys(level, low, begin.tolist())
        edges[:, 0], edges[:, 1] = tops, z + 1
        low = np.minimum.reduceat(padded, edges.ravel())[::2][::-1].tolist()
        right = _valleys(level[::-1], low, end[::-1].tolist())[::-1]
        return (x[tops] - np.maximum(left, right))[among]
    out = np.zeros(len(peaks))
    for i, p in enumerate(peaks):
        first, end = np.searchsorted(of, (of[p], of[p] + 1))
        higher = first + np.nonzero(x[first:end] > x[p])[0]
        left, right = higher[higher < p], higher[higher > p]
        a, z = (left[-1] + 1 if len(left) else first), (right[0] if len(right) else end)
        out[i] = x[p] - max(x[a : p + 1].min(), x[p:z].min())
    return out


def _valleys(tops: list[float], lows: list[float], new: list[bool]) -> list[float]:
    """For each top the lowest value since higher ground before it. lows: the lowest since the top before; new: a series begins."""
    out, walls = [], []
    for v, low, first in zip(tops, lows, new, strict=True):
        if first:
            walls = []
        while walls and walls[-1][0] <= v:
            low = min(low, walls.pop()[1])
        walls.append((v, low))
        out.append(low)
    return out


def viterbi(
    frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray, max_skip: int = 15, speed: float = 120.0, slack: float = 40.0,
    gain: float = 6.0, per_conf: float = 8.0, skip_cost: float = 0.8, move_cost: float = 1.0, usual: float = 25.0,
) -> np.ndarray:
    """The most rewarding path through candidates sorted by frame: their places.

    A node earns gain + per_conf * conf. A step costs skip_cost a skipped frame and the square of its speed, in units of
    `usual` pixels a frame, times move_cost; it may not be longer than `speed` a frame and `slack`. The path may begin
    anywhere and ends at the first best node.
    """
    n = len(frame)
    best, back = gain + per_conf * np.asarray(conf, dtype=float), np.full(n, -1)
    own = best.copy()
    lo = 0
    for j in range(n):
        while frame[j] - frame[lo] > max_skip:
            lo += 1
        i = np.arange(lo, j)
        i = i[frame[i] < frame[j]]
        if not len(i):
            continue
        dt = frame[j] - frame[i]
        d = np.hypot(x[j] - x[i], y[j] - y[i])
        total = np.where(d <= speed * dt + slack, best[i] - move_cost * (d / dt / usual) ** 2 - skip_cost * (dt - 1), -np.inf)
        k = int(total.argmax())
        if total[k] > 0:
            best[j], back[j] = own[j] + total[k], i[k]
    path: list[int] = []
    j = int(best.argmax()) if n else -1
    while j >= 0:
        path.append(j)
        j = back[j]
    return np.array(path[::-1], dtype=int)


def track_two(frames: list[tuple[int, list[tuple[float, float, float, float]]]], reach: float = 120.0, forget: int = 5, size: float = 4.0, prior: dict[int, tuple[float, float, int]] | None = None) -> list[tuple[int, int | None, int | None]]:
    """For each frame the candidates (x, y, court y, size) chosen for the far and the near half; distances are in pixels.

    A half's candidate is the nearest to its last place within `reach` times the frames since, or, without a last
    place or after `forget` frames, the largest of at least `size`. prior holds the last place and frame of each half
    (0 and 1) and is brought up to date.
    """
    prior = {} if prior is None else prior
    out = []
    for f, found in frames:
        chosen: list[int | None] = [None, None]
        for half in (0, 1):
            if half in prior and f - prior[half][2] > forget:
                del prior[half]
            best = None
            if half in prior:
                px, py, at = prior[half]
                for i, c in enumerate(found):
                    if (c[2] >= 0.5) == bool(half):
                        d = abs(complex(c[0] - px, c[1] - py))
                        if d <= reach * (f - at) and (best is None or d < best):
                            best, chosen[half] = d, i
            else:
                for i, c in enumerate(found):
                    if (c[2] >= 0.5) == bool(half) and c[3] >= size and (best is None or c[3] > best):
                        best, chosen[half] = c[3], i
            if chosen[half] is not None:
                c = found[chosen[half]]
                prior[half] = (c[0], c[1], f)
        out.append((f, chosen[0], chosen[1]))
    return out


def label_cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected components of occupied cells, by their first cell."""
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(x, y, strict=True))}
    root = np.arange(len(x))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), i in at.items():
        for near in ((a + 1, b), (a, b + 1)):
            if near in at:
                p, q = find(i), find(at[near])
                root[max(p, q)] = min(p, q)
    return np.array([find(i) for i in range(len(x))], dtype=int)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3×3 matrix, its last element 1, that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, dtype=float), np.array(right, dtype=float)), 1.0).reshape(3, 3)


def summed(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running sums, each series on its own, so that they are the same whatever lies before it."""
    out, cuts = np.empty(len(value)), [*begins(of).tolist(), len(value)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        np.cumsum(value[a:z], out=out[a:z])
    return out


def first_rise(frame: np.ndarray, y: np.ndarray, steps: int = 6, gap: int = 3, wobble: float = 2.0, total: float = 60.0) -> int | None:
    """Frame where y (downwards) first falls for `steps` steps, but for a wobble and gaps of up to `gap` frames; the falls alone sum to `total` at least."""
    at = first_rises(np.asarray(frame), np.asarray(y, dtype=float), np.zeros(len(frame), dtype=np.int64), 1, steps, gap, wobble, total)[0]
    return int(frame[at]) if at >= 0 else None


def first_rises(frame: np.ndarray, y: np.ndarray, of: np.ndarray, n: int, steps: int = 6, gap: int = 3, wobble: float = 2.0, total: float = 60.0) -> np.ndarray:
    """first_rise() of n series that lie one after the other: the place of each, -1 for none. of: the number of each place's series, in order."""
    out = np.full(n, -1)
    if len(frame) < 2:
        return out
    step, new = np.diff(y), of[1:] != of[:-1]
    broken = np.append((np.diff(frame) > gap) | (step > wobble) | new, True)
    breaks, at = np.nonzero(broken)[0], np.arange(len(frame))
    end = breaks[np.searchsorted(breaks, at)]  # the last place that each place's run reaches
    fallen = summed(np.append(0.0, np.where(new, 0.0, np.maximum(0.0, -step))), of)
    found = np.nonzero((end - at >= steps) & (fallen[end] - fallen >= total))[0]
    found = found[begins(of[found])]
    out[of[found]] = found
    return out


def trim_shallow_ends(peaks: np.ndarray, y: np.ndarray, least: float, of: np.ndarray | None = None) -> np.ndarray:
    """Of a series' five peaks or more, the first and the last go if they rise less than `least` out of the valley beside them."""
    if len(peaks) < 5:
        return peaks
    first = begins(np.zeros(len(peaks), dtype=np.int64) if of is None else of[peaks])
    many = np.append(first[1:], len(peaks)) - first
    first, many = first[many >= 5], many[many >= 5]
    if not len(first):
        return peaks
    last, drop = first + many - 1, np.zeros(len(peaks), dtype=bool)
    for i, a in ((first, first), (last, last - 1)):
        valley = np.minimum.reduceat(y, np.stack([peaks[a], peaks[a + 1]], axis=1).ravel())[::2]
        drop[i] = y[peaks[i]] - valley < least
    return peaks[~drop]


def turn_degrees(dx1: np.ndarray, dy1: np.ndarray, dx2: np.ndarray, dy2: np.ndarray) -> np.ndarray:
    """Degrees between directions; each angle is cut to a whole number first."""
    a, b = (np.trunc(np.degrees(np.arctan2(dy, dx))) for dx, dy in ((dx1, dy1), (dx2, dy2)))
    out = np.where(a * b >= 0, np.abs(a - b), np.abs(a) + np.abs(b))
    return np.where(out > 180, 360 - out, out)


def contact_candidates(frame: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, n: int, near: int = 5, **knobs: float) -> list[tuple[int, list[str]]]:
    """Frames at which an object seen at (frame, x, y), within frames first..first + n - 1, may have been hit, and the signals about each.

    The signals within `near` frames of each are told; for the others see contact_places.
    """
    frame, x, y = np.asarray(frame), np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if not len(frame):
        return []
    places, fired = contact_places(frame - first, x, y, np.zeros(len(frame), dtype=np.int64), np.array([0, n]), **knobs)
    about: dict[int, list[str]] = {k: [] for k in places.tolist()}
    for name in sorted(fired):
        rows = np.sort(fired[name])
        beside = np.searchsorted(rows, places + near, side="right") > np.searchsorted(rows, places - near)
        for k in places[beside].tolist():
            about[k].append(name)
    return [(first + k, about[k] or ["ypeak"]) for k in about]


def contact_places(
    at: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray, span: np.ndarray, drop: float = 5.0, prominence: float = 5.0, edge: float = 5.0,
    lag: int = 3, clear: int = 5, angle: float = 30.0, speed_ratio: float = 1.5, spacing: int = 10,
    ramp: int = 3, slow: float = 12.0, ramp_ratio: float = 1.8, sideways: float = 2.0, apart: int = 10, rise_steps: int = 6, rise_total: float = 60.0,
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where objects seen at (at, x, y) may have been hit, and where each signal fired, of many objects whose frames lie one after the other.

    of: the number of each point's object, in order; the frames of object i are those from span[i] to span[i + 1] - 1.
    serve: the first steep fall. ypeak: prominent peaks of y after it. accel: a turn with a change of speed between two
    peaks' valley and the second. ramp: slow, then fast, with the sideways speed changed. Signals nearer than `apart`
    are one; the first sustained rise (serve_rise) is added last if no other is near.
    """
    n, places = len(span) - 1, np.arange(len(at))
    begin, end = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), side="right")
    framed = np.repeat(np.arange(n), np.diff(span))
    fired: dict[str, np.ndarray] = {}
    same = of[1:] == of[:-1]
    falls = np.nonzero((-np.diff(y) >= drop * np.diff(at)) & same)[0]
    falls = falls[begins(of[falls])]
    fired["serve"], start = at[falls], span[:-1].copy()
    start[of[falls]] = fired["serve"]
    peaks = trim_shallow_ends(find_peaks(y, prominence=prominence, of=of), y, edge, of)
    fired["ypeak"] = at[peaks][at[peaks] >= start[of[peaks]]]
    turning = np.zeros(span[-1])
    pair = np.nonzero(of[peaks[1:]] == of[peaks[:-1]])[0]
    if len(pair):
        a, z = peaks[pair], peaks[pair + 1]
        valley = np.minimum.reduceat(y, np.stack([a, z], axis=1).ravel())[::2]
        inside = np.searchsorted(a, places, side="right") - 1
        lowest = np.nonzero((inside >= 0) & (places < z[inside]) & (y == valley[inside]))[0]
        lowest = lowest[begins(inside[lowest])]
        lo, hi = np.maximum(lowest + clear + 1, begin[of[a]] + lag), np.minimum(z + 1 - clear, end[of[a]] - lag)
        many = np.maximum(hi - lo, 0)
        j = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        into, out = (x[j] - x[j - lag], y[j] - y[j - lag]), (x[j + lag] - x[j], y[j + lag] - y[j])
        speeds = np.sort([np.hypot(*into), np.hypot(*out)], axis=0)
        turning[at[j[(turn_degrees(*into, *out) > angle) & (speeds[1] >= speed_ratio * speeds[0])]]] = 1
    fired["accel"] = find_peaks(turning, distance=spacing, of=framed)
    j = np.nonzero((places - begin[of] >= ramp) & (places < end[of] - ramp))[0]
    if len(j):
        gone = summed(np.append(0.0, np.where(same, np.hypot(np.diff(x), np.diff(y)), 0.0)), of)
        before, after = (gone[j] - gone[j - ramp]) / ramp, (gone[j + ramp] - gone[j]) / ramp
        bend = np.abs(x[j + ramp] - 2 * x[j] + x[j - ramp]) / ramp
        fired["ramp"] = at[j[(before > 0) & (before < slow) & (after >= ramp_ratio * before) & (bend >= sideways)]]
    signal = np.zeros(span[-1])
    for rows in fired.values():
        signal[rows] = 1
    kept = find_peaks(signal, distance=max(1, apart), of=framed)
    rise = first_rises(at, y, of, n, rise_steps, total=rise_total)
    risen, rise = np.nonzero(rise >= 0)[0], at[rise[rise >= 0]]
    lo, hi = np.maximum(rise - apart, span[risen] - 1), np.minimum(rise + apart, span[risen + 1])
    alone = rise[np.searchsorted(kept, lo, side="right") >= np.searchsorted(kept, hi)]
    if len(alone):
        kept, fired["serve_rise"] = np.sort(np.append(kept, alone)), alone
    return kept, fired


def robust_quadratic(t: np.ndarray, value: np.ndarray, weight: np.ndarray, where: np.ndarray, rounds: int = 4, floor: float = 2.0) -> np.ndarray:
    """A quadratic in t at the places `where`; what it misses weighs less round after round, by Huber's rule.

    Fixed values: four rounds, and a scale of no less than 2 pixels, as residuals under that are the pixels' own rounding.
    """
    centre, w = t.mean(), weight
    for _ in range(rounds):
        fit = np.polyfit(t - centre, value, 2, w=w)
        miss = np.abs(np.polyval(fit, t - centre) - value)
        w = weight / np.maximum(1.0, miss / (2 * max(1.4826 * float(np.median(miss)), floor)))
    return np.polyval(fit, where - centre)


def fill_path(
    frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray, how: str = "spline", slack: float = 9.0, prominence: float = 20.0, least: int = 8, piece: int = 6, motion: Motion = Motion(),
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every frame from the first to the last one seen, with x and y. Observations that the filter believes stay as they are.

    kalman: the smoothed filter. spline: one with knots, of a squared residual of `slack` an observation. pieces: the filter's
    path with a robust quadratic in the gaps between turning points of y. Under `least` observations spline and pieces,
    and under two the filter, are straight lines.
    """
    return fill_paths([(frame, x, y, conf)], how, slack, prominence, least, piece, motion)[0]


def fill_paths(
    paths: list[tuple[np.ndarray, ...]], how: str = "spline", slack: float = 9.0, prominence: float = 20.0, least: int = 8, piece: int = 6, motion: Motion = Motion(),
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """fill_path() of many paths (frame, x, y, conf), which are filtered and fitted side by side."""
    paths = [(np.asarray(f), np.asarray(x, dtype=float), np.asarray(y, dtype=float), np.asarray(c, dtype=float)) for f, x, y, c in paths]
    spans = [np.arange(int(p[0][0]), int(p[0][-1]) + 1) for p in paths]
    long = [i for i, p in enumerate(paths) if len(p[0]) >= (2 if how == "kalman" else least)]
    filled = [[np.interp(span, p[0], v) for v in p[1:3]] for p, span in zip(paths, spans, strict=True)]
    believed = filtered_many([paths[i] for i in long], motion)
    weights = [np.maximum(paths[i][3], motion.unsure) for i in long]
    if how == "spline":
        found = knotted_many([(paths[i][0], v, w, slack * len(w)) for i, w in zip(long, weights, strict=True) for v in paths[i][1:3]])
    for n, (i, weight, (ok, *smooth)) in enumerate(zip(long, weights, believed, strict=True)):
        (frame, x, y, _), span = paths[i], spans[i]
        at = frame - span[0]
        if how == "spline":
            smooth = [spline_at(*found[2 * n + k], span) for k in (0, 1)]
        elif how == "pieces":
            level = smooth[1]
            breaks = sorted({0, len(span) - 1, *find_peaks(level, prominence=prominence).tolist(), *find_peaks(-level, prominence=prominence).tolist()})
            missing = np.ones(len(span), dtype=bool)
            missing[at] = False
            for a, z in zip(breaks[:-1], breaks[1:], strict=True):
                own = (at >= a) & (at <= z)
                gap = a + np.nonzero(missing[a : z + 1])[0]
                if z - a >= piece <= own.sum() and len(gap):
                    for path, v in zip(smooth, (x, y), strict=True):
                        path[gap] = robust_quadratic(at[own].astype(float), v[own], weight[own], gap.astype(float))
        for path, v in zip(smooth, (x, y), strict=True):
            path[at[ok]] = v[ok]
        filled[i] = smooth
    return [(span, *own) for span, own in zip(spans, filled, strict=True)]
