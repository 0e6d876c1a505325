"""Numpy kernels against plain definitions."""

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.functions import arrays as ar
from stratavox.operators.aggregates import t_probability

VOLUME = st.integers(0, 2**32 - 1).map(lambda s: np.random.default_rng(s).integers(0, 3, tuple(np.random.default_rng(s).integers(1, 6, 3))))


def flood(labels):
    out, n = np.zeros(labels.shape, int), 0
    for p in map(tuple, np.argwhere(labels != 0)):
        if out[p]:
            continue
        n += 1
        out[p], stack = n, [p]
        while stack:
            q = stack.pop()
            for f in ar.FACES:
                t = tuple(int(a + b) for a, b in zip(q, f))
                if all(0 <= a < b for a, b in zip(t, labels.shape)) and labels[t] == labels[q] and not out[t]:
                    out[t] = n
                    stack.append(t)
    return out


@settings(max_examples=60, deadline=None)
@given(VOLUME)
def test_components(a):
    assert (ar.components(a) == flood(a)).all()


@settings(max_examples=30, deadline=None)
@given(VOLUME, st.sampled_from([0.2, 0.5, 0.9]))
def test_clean(a, threshold):
    got, comp = ar.clean(a, threshold), flood(a)
    sizes = np.bincount(comp.ravel())
    for c in range(1, comp.max() + 1):
        label = a[comp == c][0]
        most = max(sizes[k] for k in range(1, comp.max() + 1) if a[comp == k][0] == label)
        assert (got[comp == c] == (label if sizes[c] > threshold * most else 0)).all()


def test_fill_keeps_compact_objects():
    cube = np.zeros((12, 12, 12), int)
    cube[1:11, 1:11, 1:11] = 1
    cube[5, 5, 5] = 0
    assert ar.fill(cube, 0.1).sum() == 1000
    assert ar.fill_all(cube).sum() == 1000
    open_cube = cube.copy()
    open_cube[5, 5, 5:] = 0
    assert (ar.fill(open_cube, 1.0) == open_cube).all()


def dijkstra(shape, seeds, cost):
    dist = np.full(shape, np.inf)
    heap = []
    for p in map(tuple, np.argwhere(seeds)):
        dist[p] = 0
        heapq.heappush(heap, (0.0, p))
    while heap:
        d, p = heapq.heappop(heap)
        if d > dist[p]:
            continue
        for s in ar.CUBE:
            t = tuple(a + b for a, b in zip(p, s))
            if all(0 <= a < b for a, b in zip(t, shape)):
                n = d + cost(p, t, s)
                if n < dist[t] - 1e-12:
                    dist[t] = n
                    heapq.heappush(heap, (n, t))
    return dist


@pytest.mark.parametrize("seed", range(5))
def test_distances(seed):
    r = np.random.default_rng(seed)
    image, seeds = r.random((4, 5, 6)), r.random((4, 5, 6)) > 0.95
    seeds[0, 0, 0] = True
    step = lambda s: np.sqrt(sum(map(abs, s)))
    assert np.allclose(ar.chamfer(seeds), dijkstra(image.shape, seeds, lambda p, t, s: step(s)))
    got = ar.geodesic(image, seeds, 0.7)
    assert np.allclose(got, dijkstra(image.shape, seeds, lambda p, t, s: 0.3 * step(s) + 0.7 * (image[p] - image[t]) ** 2))


def test_geodesic_segment_splits_at_an_edge():
    image = np.zeros((5, 5, 10))
    image[:, :, 5:] = 10
    seeds = np.zeros(image.shape, int)
    seeds[2, 2, 0], seeds[2, 2, 9] = 4, 7
    got = ar.geodesic_segment(image, seeds, 0.9)
    assert (got[:, :, :5] == 4).all() and (got[:, :, 5:] == 7).all()


def test_walks_are_reproducible_and_stay_inside_edges():
    image = np.zeros((6, 6, 6))
    image[:, :, 3:] = 100
    seeds = np.zeros(image.shape, int)
    seeds[3, 3, 1], seeds[3, 3, 4] = 1, 2
    a = ar.random_walks(image, seeds, 1, 10, 200)
    assert (a == ar.random_walks(image, seeds, 1, 10, 200)).all()
    assert 0 < a.sum() <= 2000
    assert a[:, :, 3:].sum() == 0
    b = ar.random_walks(image, seeds, 2, 10, 200)
    found = np.where(a >= b, 1, 2)
    assert (found[(a + b) > 0] == np.where(image > 50, 2, 1)[(a + b) > 0]).all()


def test_walks_together_are_those_of_a_plain_loop():
    r, jobs = np.random.default_rng(4), []
    for n, shape in enumerate([(4, 4, 4), (3, 5, 2), (1, 4, 6)]):
        jobs.append((r.normal(0, 1, shape), r.integers(0, 3, shape), 1 + n % 2, 7 * n, (n, 2, 3), r.random(shape) < 0.7, n))
    for most in (1 << 20, 40):
        for (image, labels, label, key, origin, chosen, axis), got in zip(jobs, ar.walk_together(jobs, 3, 30, most)):
            want, spread = np.zeros(image.shape, int), ar.seed_spread(image, labels, axis)
            for seed in np.argwhere((labels == label) & chosen):
                for walk in range(3):
                    at = tuple(seed)
                    for step in range(30):
                        to = [tuple(np.add(at, f)) for f in ar.FACES]
                        ok = [all(0 <= c < n for c, n in zip(t, image.shape)) for t in to]
                        level = np.array([image[t if o else (0, 0, 0)] for t, o in zip(to, ok)])
                        total = np.cumsum(np.exp(-((image[tuple(seed)] - level) ** 2) / (2 * spread[tuple(seed)])))
                        pick = min(5, int((total <= ar.uniform(key, *np.add(seed, origin), label, walk, step) * total[-1]).sum()))
                        if ok[pick]:
                            at = to[pick]
                            want[at] += 1
            assert (got == want).all() and want.sum() > 0


def test_rotation_search_finds_a_quarter_turn():
    mask = np.zeros((9, 9, 9), bool)
    mask[2:5, 2:7, 4] = True
    mask[2, 2, 5] = True
    turned = ar.rotate_mask(mask, ar.rotation(np.pi / 2, 0, 0))
    assert ar.search_rotation(mask, turned, 90.0, ())[0] > 0.99


def test_rotation_search_finds_other_turns():
    """Masks turned by 30 degrees are found again, with the Dice of the angles that are given."""
    r = np.random.default_rng(3)
    for _ in range(3):
        a = r.random((4, 4, 4)) < 0.5
        dice, *angles = ar.search_rotation(a, ar.rotate_mask(a, ar.rotation(np.radians(30), 0, 0)))
        assert dice == 1
        b = r.random((4, 4, 4)) < 0.5
        dice, *angles = ar.search_rotation(a, b)
        assert dice == ar.overlap(ar.rotate_mask(a, ar.rotation(*np.radians(angles))), b)
        assert dice >= ar.search_rotation(a, b, 30.0, ())[0]


def test_majority_and_circle():
    votes = [np.zeros((3, 3, 3), int) for _ in range(3)]
    for v in votes[:2]:
        v[1, 1, :] = 1
    votes[2][0, 0, 0] = 1
    assert ar.majority(votes).sum() == 3
    image = np.zeros((60, 60))
    y, x = np.indices(image.shape)
    image[(y - 30) ** 2 + (x - 30) ** 2 <= 20**2] = 1
    cy, cx, r = ar.fit_circle(image, 5, 15)
    assert abs(cy - 30) <= 7 and abs(cx - 30) <= 7 and r <= 20


def test_circle_off_centre():
    """A ring anywhere in a slice is found, and small slices are cut by what they hold."""
    y, x = np.indices((60, 48))
    for cy, cx, r in ((18, 30, 15), (40.5, 17, 13), (30, 24, 20)):
        d = np.sqrt((y - cy) ** 2 + (x - cx) ** 2)
        got = ar.fit_circle(((d <= r) & (d > r - 4)).astype(float), 3, 15)
        assert np.abs(np.subtract(got, (cy, cx, r))).max() <= 1
    small = np.zeros((4, 4))
    small[1:, 1:] = 1
    small[2, 2] = 0
    cy, cx, r = ar.fit_circle(small, 1, 15)
    assert abs(cy - 2) < 0.3 and abs(cx - 2) < 0.3 and 1 <= r <= 1.8
    assert ar.fit_circle(np.ones((4, 4)), 1, 15) == (1.5, 1.5, 2)


def test_resize():
    a = np.arange(64.0).reshape(4, 4, 4)
    assert np.allclose(ar.resize(a, (2, 2, 2)), a.reshape(2, 2, 2, 2, 2, 2).mean((1, 3, 5)))
    assert np.isclose(ar.resize(a, (3, 3, 3)).mean(), a.mean())
    assert np.allclose(ar.resize(np.ones((3, 3, 3)), (5, 6, 7)), 1)


def test_curvature_shrinks_a_bump():
    a = np.zeros((9, 9, 9))
    a[3:6, 3:6, 3:6] = 1
    b = ar.curvature_flow(a, 20, 0.05)
    assert b[4, 4, 4] <= 1 and np.isfinite(b).all()


@pytest.mark.parametrize("t, dof, p", [(2.262157, 9, 0.05), (0.0, 5, 1.0), (12.7062, 1, 0.05), (1.959964, 10**6, 0.05)])
def test_t_probability(t, dof, p):
    assert abs(t_probability(t, dof) - p) < 1e-4


@pytest.mark.parametrize("seed", range(4))
def test_squared_distance(seed):
    mask = np.random.default_rng(seed).random((4, 5, 6)) > 0.9
    mask[1, 2, 3] = True
    points = np.argwhere(mask)
    want = [min(((p - q) ** 2).sum() for q in points) for p in np.argwhere(np.ones(mask.shape, bool))]
    assert (ar.squared_distance(mask).ravel() == want).all()
    assert np.isinf(ar.squared_distance(np.zeros((2, 2, 2)))).all()


def test_transplant_keeps_locked_voxels():
    a, b = np.zeros((3, 3, 3), int), np.zeros((3, 3, 3), int)
    a[1, 1, 0], b[1, 1, 1], b[1, 1, 2] = 1, 1, 1
    assert ar.transplant(a, b, ar.rotation(0, 0, 0)).sum() == 3
    locked = np.zeros_like(a)
    locked[1, 1, 2] = 1
    assert ar.transplant(a, b, ar.rotation(0, 0, 0), locked).sum() == 2
