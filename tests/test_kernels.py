import numpy as np
import pytest

from seriesloom.operators import kernels as k


@pytest.mark.parametrize(
    "x, want",
    [
        ([0, 1, 0], [1]),
        ([1, 0, 1], []),  # the ends are no peaks
        ([0, 2, 2, 0], [1]),  # a plateau counts at its lower middle
        ([0, 2, 2, 2, 0], [2]),
        ([0, 2, 2], []),
        ([], []),
        ([3, 3, 3], []),
        ([0, 1, 0, 3, 0, 2, 0], [1, 3, 5]),
    ],
)
def test_peaks(x, want):
    assert k.find_peaks(np.array(x)).tolist() == want


def test_peaks_by_distance_keep_the_later_of_equals():
    assert k.find_peaks(np.array([0, 1, 0, 1, 0]), distance=3).tolist() == [3]
    assert k.find_peaks(np.array([0, 2, 0, 1, 0, 0, 1, 0]), distance=3).tolist() == [1, 6]


def test_prominence():
    x = np.array([0, 5, 3, 4, 0, 9, 0])
    assert k.prominences(x, np.array([1, 3, 5])).tolist() == [5, 1, 9]
    assert k.find_peaks(x, prominence=2).tolist() == [1, 5]


def test_saw_has_its_peaks():
    up, down = np.arange(0, 90, 6), np.arange(90, 0, -9)
    y = np.tile(np.concatenate([up, down]), 4) + np.arange(4 * 25)
    assert k.find_peaks(y, prominence=60).tolist() == [15, 40, 65, 90]


def test_a_path_leaves_out_what_is_too_far():
    """Of two that start together the slower one goes on; the faster is dearer than all it earns."""
    rows = [(0, 50.0, 0.0, 0.9), (1, 55.0, 0.0, 0.4), (1, 165.0, 0.0, 0.9), (2, 60.0, 0.0, 0.4), (2, 300.0, 0.0, 0.9), (9, 62.0, 3.0, 0.1)]
    f, x, y, c = (np.array(v) for v in zip(*rows, strict=True))
    assert k.viterbi(f, x, y, c).tolist() == [0, 1, 3, 5]
    # nothing is too fast or dear: the surest ones
    assert k.viterbi(f, x, y, c, move_cost=0.0, speed=1e6).tolist() == [0, 2, 4, 5]
    # a step of 9 frames costs more than the last one earns, or is not allowed
    assert k.viterbi(f, x, y, c, skip_cost=1.2).tolist() == k.viterbi(f, x, y, c, max_skip=6).tolist() == [0, 1, 3]


def test_viterbi_takes_one_node_of_a_frame_and_handles_none():
    assert k.viterbi(np.array([1, 1]), np.array([0.0, 0.0]), np.array([0.0, 1.0]), np.array([0.5, 0.9])).tolist() == [1]
    assert len(k.viterbi(*(np.zeros(0),) * 4)) == 0


def test_tracker_keeps_to_the_near_one_and_begins_anew():
    frames = [
        (4, [(30.0, 200.0, 0.2, 3.0), (31.0, 400.0, 0.8, 9.0)]),  # the far one is too small to begin with
        (5, [(33.0, 190.0, 0.2, 5.0), (31.0, 560.0, 0.8, 9.0)]),  # up and down counts as much as sideways
        (6, [(50.0, 205.0, 0.3, 9.0), (34.0, 192.0, 0.1, 1.0), (80.0, 380.0, 0.9, 2.0)]),
        (12, [(600.0, 10.0, 0.3, 9.0), (80.0, 380.0, 0.6, 4.5)]),
    ]
    assert k.track_two(frames) == [(4, None, 1), (5, 0, None), (6, 1, 2), (12, 0, 1)]


def test_components_are_four_connected():
    assert k.label_cells(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2])).tolist() == [0, 0, 0, 3]


def test_homography_maps_corners():
    src, dst = np.array([[0, 0], [1, 0], [0, 1], [1, 1]]), np.array([[2, 1], [5, 1.5], [1, 6], [6, 7]])
    h = k.homography(src, dst)
    for (x, y), want in zip(src, dst, strict=True):
        u, v, w = h @ [x, y, 1]
        assert np.allclose([u / w, v / w], want)


def test_a_rise_begins_where_enough_falls_follow():
    y = np.array([300.0, 310, 305, 290, 291, 270, 250, 240, 239, 180, 180])
    assert k.first_rise(np.arange(11), y, steps=4, total=100) == 1  # from 310 on: 5 + 15 + 21 + 20 + 10 + 1 + 59
    assert k.first_rise(np.arange(11), y, steps=4, total=132) is None
    assert k.first_rise(np.arange(11) * 4, y, steps=1, total=1) is None  # frames too far apart
    assert k.first_rise(np.array([7]), np.array([1.0])) is None


def test_rise_counts_falls_only_and_ends_at_gaps():
    y = np.array([100.0, 60, 62, 40, 41, 20, 21, 0])
    assert k.first_rise(np.arange(8), y, steps=6, total=99) == 0
    assert k.first_rise(np.array([0, 1, 2, 3, 9, 10, 11, 12]), y, steps=6, total=10) is None


def test_ends_that_hardly_rise_go():
    y = np.array([7.0, 90, 10, 80, 20, 95, 30, 85, 81, 84.0])
    assert k.trim_shallow_ends(np.array([1, 3, 5, 7, 9]), y, 4).tolist() == [1, 3, 5, 7]
    assert k.trim_shallow_ends(np.array([1, 3, 5, 7, 9]), y, 81).tolist() == [3, 5, 7]
    assert k.trim_shallow_ends(np.array([3, 5, 7, 9]), y, 81).tolist() == [3, 5, 7, 9]


def test_contacts_are_where_the_path_turns():
    """A point that flies from side to side in parabolas of 50 frames: it is lowest, and turns, at each multiple of 50."""
    t = np.arange(300)
    u = t % 50 - 25.0
    x = np.where(t // 50 % 2, 25 - u, 25 + u) * 12 + 300
    found = k.contact_candidates(500 + t, x, 0.4 * u**2 + 200, 500, 300, prominence=80)
    assert {550, 600, 650, 700, 750} <= {f + d for f, _ in found for d in range(-5, 6)}
    assert all(names for _, names in found)
    assert k.contact_candidates(*(np.zeros(0),) * 3, 0, 0) == []


@pytest.mark.parametrize("how", ["spline", "pieces", "kalman"])
def test_fill_follows_a_parabola(how):
    t = np.array([i for i in range(60) if i % 7 and not 20 <= i < 26])
    x, y = 5.0 * t, 400 - 0.5 * (t - 30.0) ** 2
    span, px, py = k.fill_path(t, x, y, np.ones(len(t)), how)
    assert span.tolist() == list(range(1, 60))
    assert np.abs(px - 5 * span).max() < 6 and np.abs(py - (400 - 0.5 * (span - 30.0) ** 2)).max() < 12
    few = k.fill_path(np.array([0, 4]), np.array([0.0, 4.0]), np.zeros(2), np.ones(2), how)
    assert few[0].tolist() == [0, 1, 2, 3, 4] and (how == "kalman" or few[1].tolist() == [0, 1, 2, 3, 4])
    assert k.fill_path(np.array([3]), np.array([1.0]), np.array([2.0]), np.ones(1), how)[1].tolist() == [1.0]


@pytest.mark.parametrize("seed", range(4))
def test_series_side_by_side_are_each_on_its_own(seed):
    r = np.random.default_rng(seed)
    many = [int(n) for n in r.integers(0, 60, 30)]
    ys = [r.uniform(0, 100, n).round(2) if i % 2 else r.integers(0, 4, n) * 30.0 for i, n in enumerate(many)]
    xs = [r.uniform(0, 100, n).round() for n in many]
    at = [np.cumsum(r.integers(1, 3, n)) for n in many]
    cuts, of, y = np.append(0, np.cumsum(many)), np.repeat(np.arange(30), many), np.concatenate(ys)
    for knobs in ({}, {"distance": 4}, {"prominence": 25.0}, {"distance": 3, "prominence": 25.0}):
        assert k.find_peaks(y, of=of, **knobs).tolist() == [a + p for a, v in zip(cuts, ys) for p in k.find_peaks(v, **knobs).tolist()]
    peaks = k.find_peaks(y, of=of)
    assert k.prominences(y, peaks, of).tolist() == [h for v in ys for h in k.prominences(v, k.find_peaks(v)).tolist()]
    rises = k.first_rises(np.concatenate(at), y, of, 30, steps=2, total=20.0).tolist()
    assert [None if i < 0 else int(np.concatenate(at)[i]) for i in rises] == [k.first_rise(f, v, steps=2, total=20.0) for f, v in zip(at, ys)]
    span = np.append(0, np.cumsum([f[-1] + 2 if len(f) else 1 for f in at]))
    got, _ = k.contact_places(np.concatenate([f + s for f, s in zip(at, span)]), np.concatenate(xs), y, of, span, apart=3, spacing=3, clear=0)
    assert got.tolist() == [s + f for s, n, *own in zip(span, np.diff(span), at, xs, ys) for f, _ in k.contact_candidates(*own, 0, n, apart=3, spacing=3, clear=0)]
