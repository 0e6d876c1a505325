"""Numpy kernels on one (z, y, x) array; the operators map them over blocks."""

from __future__ import annotations

import numpy as np

FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
CUBE = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def shifted(a: np.ndarray, step: tuple[int, int, int], empty) -> np.ndarray:
    """``out[p] = a[p + step]`` along the last axes, ``empty`` where that is outside."""
    out = np.full_like(a, empty)
    shape = a.shape[a.ndim - len(step) :]
    src = tuple(slice(max(0, s), n + min(0, s)) for s, n in zip(step, shape))
    dst = tuple(slice(max(0, -s), n + min(0, -s)) for s, n in zip(step, shape))
    out[(..., *dst)] = a[(..., *src)]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Face-connected components of equal non-zero values, numbered from 1 in raster order of their first voxel.

    Least linear numbers spread along whole lines by running minima until nothing changes, with
    pointer jumping, so the rounds follow the winding of a component and not its length.
    """
    mask = np.asarray(mask)
    big = mask.size
    lab = np.where(mask != 0, np.arange(big).reshape(mask.shape), big)
    while True:
        old = lab
        for axis in range(3):
            m, v = np.moveaxis(mask, axis, 0), np.moveaxis(lab.copy(), axis, 0)
            for run in (range(1, len(v)), range(len(v) - 2, -1, -1)):
                for i in run:
                    j = i - 1 if run.step > 0 else i + 1
                    same = (m[i] == m[j]) & (m[i] != 0)
                    v[i] = np.where(same, np.minimum(v[i], v[j]), v[i])
            lab = np.moveaxis(v, 0, axis)
        flat = np.append(lab.ravel(), big)
        lab = flat[flat[:-1]].reshape(mask.shape)
        lab = np.where(mask != 0, lab, big)
        if (lab == old).all():
            break
    ids = np.unique(lab[lab < big])
    return np.where(lab < big, np.searchsorted(ids, lab) + 1, 0).astype(np.int64)


def clean(labels: np.ndarray, threshold: float) -> np.ndarray:
    """Per label, components not larger than ``threshold`` times the largest are removed."""
    labels = np.asarray(labels)
    comp = components(labels)
    sizes = np.bincount(comp.ravel())
    out = labels.copy()
    for k in np.unique(labels[labels != 0]):
        own = np.unique(comp[labels == k])
        small = own[sizes[own] <= threshold * sizes[own].max()]
        small = small[sizes[small] < sizes[own].max()] if threshold < 1 else small
        out[np.isin(comp, small)] = 0
    return out


def holes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the complement, and which of them do not touch the padded border."""
    comp = components(np.pad(~mask, 1, constant_values=True).astype(np.int8))
    outside = comp[0, 0, 0]
    inner = comp[1:-1, 1:-1, 1:-1]
    ids = np.unique(inner)
    return inner, ids[(ids != 0) & (ids != outside)]


def fill(labels: np.ndarray, threshold: float) -> np.ndarray:
    """Per label in rising order, holes not larger than ``threshold`` times the label take it, whatever lies there."""
    out = np.asarray(labels).copy()
    for k in np.unique(out[out != 0]):
        mask = out == k
        comp, inside = holes(mask)
        sizes = np.bincount(comp.ravel())
        small = inside[sizes[inside] <= threshold * mask.sum()]
        out[np.isin(comp, small)] = k
    return out


def fill_all(mask: np.ndarray) -> np.ndarray:
    mask = np.asarray(mask) != 0
    comp, inside = holes(mask)
    return (mask | np.isin(comp, inside)).astype(np.int64)


def largest(mask: np.ndarray) -> np.ndarray:
    """Only the largest component, the first of equals."""
    comp = components(np.asarray(mask) != 0)
    if not comp.any():
        return comp
    return (comp == np.bincount(comp.ravel())[1:].argmax() + 1).astype(np.int64)


def at_least(mask: np.ndarray, n: int) -> np.ndarray:
    comp = components(np.asarray(mask) != 0)
    return np.where(np.bincount(comp.ravel())[comp] >= n, np.asarray(mask), 0)


def propagate(seeds: np.ndarray, cost, where: np.ndarray | None = None, rounds: int | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distance, label) from non-zero seeds over the 26 neighbours; ``cost(step)`` is an array of step costs.

    Relaxes all steps at once until nothing changes (or ``rounds`` times); of equal distances the
    smaller label wins, so the result does not depend on any order.  ``start`` gives the seeds distances of
    their own; ``where`` then tells alone which voxels may change.  Axes before the last three are arrays apart.
    """
    lab = np.asarray(seeds).astype(np.int64)
    dist = np.where(lab != 0, 0.0, np.inf) if start is None else np.asarray(start, float)
    allowed = np.ones(lab.shape, bool) if where is None else (np.asarray(where) != 0) | ((lab != 0) & (start is None))
    old = np.seterr(invalid="ignore")  # infinite distances are compared with each other
    while rounds is None or rounds > 0:
        before = dist.copy(), lab.copy()
        for step in CUBE:
            d = shifted(dist, step, np.inf) + cost(step)
            l = shifted(lab, step, 0)
            better = allowed & (l != 0) & ((d < dist - 1e-12) | ((np.abs(d - dist) <= 1e-12) & (l < lab)))
            dist, lab = np.where(better, d, dist), np.where(better, l, lab)
        rounds = rounds - 1 if rounds is not None else None
        if (dist == before[0]).all() and (lab == before[1]).all():
            break
    np.seterr(**old)
    return dist, lab


def step_cost(step: tuple[int, ...], lam: float | None, rise: np.ndarray | None) -> np.ndarray | float:
    """The cost of a step by length, or with ``lam`` and the difference of intensity as in ``geodesic_cost``."""
    length = np.sqrt(sum(map(abs, step)))
    return length if lam is None else (1 - lam) * length + lam * rise**2


def is_better(d: np.ndarray, label: np.ndarray, dist: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Where a way of length ``d`` from ``label`` wins over what is known: it is shorter, or its label is smaller."""
    with np.errstate(invalid="ignore"):  # infinite distances are compared with each other
        return (label != 0) & ((d < dist - 1e-12) | ((np.abs(d - dist) <= 1e-12) & (label < lab)))


def relax_inside(dist: np.ndarray, lab: np.ndarray, where: np.ndarray, image: np.ndarray | None = None, lam: float | None = None) -> None:
    """As ``propagate`` from the given distances, in place, on arrays (row, z, y, x) with a rim of one voxel.

    The rim is read but never relaxed, and a row is left as soon as nothing changes in it.  ``where`` has no rim.
    """
    live, core, shape = np.arange(len(dist)), (slice(None), *[slice(1, -1)] * 3), [n - 2 for n in dist.shape[1:]]
    while len(live):
        d, l, ok, img = dist[live], lab[live], where[live], None if image is None else image[live]
        own, label, moved = d[core], l[core], np.zeros(len(live), bool)
        for step in CUBE:
            at = (slice(None), *(slice(1 + s, 1 + s + n) for s, n in zip(step, shape)))
            new = d[at] + step_cost(step, lam, None if img is None else img[at] - img[core])
            better = ok & is_better(new, l[at], own, label)
            if better.any():
                own[better], label[better] = new[better], l[at][better]
                moved |= better.any((1, 2, 3))
        dist[live], lab[live] = d, l
        live = live[moved]


def chamfer(seeds: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Distance to the nearest seed with steps 1, sqrt 2, sqrt 3."""
    return propagate(np.asarray(seeds) != 0, lambda s: np.sqrt(sum(map(abs, s))), rounds=rounds)[0]


def nearest_label(seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each voxel of the mask takes the label of its nearest seed inside the mask; unreached ones are 0."""
    return propagate(seeds, lambda s: np.sqrt(sum(map(abs, s))), where=mask)[1]


def geodesic_cost(image: np.ndarray, lam: float):
    """Step costs (1 - lam) d + lam (difference of intensity)**2."""
    image = np.asarray(image, float)
    return lambda step: (1 - lam) * np.sqrt(sum(map(abs, step))) + lam * (shifted(image, step, 0.0) - image) ** 2


def geodesic(image: np.ndarray, seeds: np.ndarray, lam: float) -> np.ndarray:
    """Distance with the costs of ``geodesic_cost``."""
    return propagate(np.asarray(seeds) != 0, geodesic_cost(image, lam))[0]


def geodesic_segment(image: np.ndarray, seeds: np.ndarray, lam: float) -> np.ndarray:
    """Each voxel takes the label of least geodesic distance, the first of equals."""
    labels = np.unique(seeds[np.asarray(seeds) != 0])
    if not len(labels):
        return np.zeros_like(np.asarray(seeds, dtype=np.int64))
    return labels[np.argmin([geodesic(image, np.asarray(seeds) == k, lam) for k in labels], axis=0)].astype(np.int64)


def curvature_flow(phi: np.ndarray, steps: int, rate: float = 0.01) -> np.ndarray:
    """``phi += rate * curvature`` with central differences and repeated edges."""
    phi = np.asarray(phi, float)
    for _ in range(steps):
        p = np.pad(phi, 1, mode="edge")
        g = lambda dz, dy, dx: p[1 + dz : p.shape[0] - 1 + dz, 1 + dy : p.shape[1] - 1 + dy, 1 + dx : p.shape[2] - 1 + dx]
        dx, dy, dz = (g(0, 0, 1) - g(0, 0, -1)) / 2, (g(0, 1, 0) - g(0, -1, 0)) / 2, (g(1, 0, 0) - g(-1, 0, 0)) / 2
        dxx, dyy, dzz = (g(*s) - 2 * phi + g(*(-i for i in s)) for s in ((0, 0, 1), (0, 1, 0), (1, 0, 0)))
        dxy = (g(0, 1, 1) - g(0, 1, -1) - g(0, -1, 1) + g(0, -1, -1)) / 4
        dxz = (g(1, 0, 1) - g(1, 0, -1) - g(-1, 0, 1) + g(-1, 0, -1)) / 4
        dyz = (g(1, 1, 0) - g(1, -1, 0) - g(-1, 1, 0) + g(-1, -1, 0)) / 4
        square = dx * dx + dy * dy + dz * dz
        top = dxx * (dy * dy + dz * dz) + dyy * (dx * dx + dz * dz) + dzz * (dx * dx + dy * dy) - 2 * (dx * dy * dxy + dx * dz * dxz + dy * dz * dyz)
        phi = phi + rate * np.divide(top, square, out=np.zeros_like(top), where=square > 1e-12)
    return phi


def evolve(labels: np.ndarray, image: np.ndarray, alpha: float) -> np.ndarray:
    """One step of a contour: a voxel takes the label of its 26 neighbours whose mean is closest, if closer than its own."""
    labels, image = np.asarray(labels).astype(np.int64), np.asarray(image, float)
    ids = np.unique(labels)
    means = np.array([image[labels == k].mean() for k in ids])
    table = lambda l: np.abs(image - means[np.searchsorted(ids, l)]) * np.where(l == 0, alpha, 1.0)
    best, out = table(labels), labels.copy()
    for step in CUBE:
        inside = shifted(np.ones(labels.shape, bool), step, False)
        l = np.where(inside, shifted(labels, step, 0), labels)
        d = table(l)
        out, best = np.where(d < best, l, out), np.minimum(d, best)
    return out


#: The nine planes through a voxel, each by two steps that span it.
PLANES = [((0, 1, 0), (0, 0, 1)), ((1, 0, 0), (0, 0, 1)), ((1, 0, 0), (0, 1, 0)), ((0, 1, 1), (1, 0, 0)), ((0, 1, -1), (1, 0, 0)), ((1, 0, 1), (0, 1, 0)), ((1, 0, -1), (0, 1, 0)), ((1, 1, 0), (0, 0, 1)), ((1, -1, 0), (0, 0, 1))]


def _planes(mask: np.ndarray, erode: bool) -> np.ndarray:
    out = None
    for a, b in PLANES:
        part = None
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                s = shifted(mask, tuple(i * p + j * q for p, q in zip(a, b)), erode)
                part = s if part is None else (part & s if erode else part | s)
        out = part if out is None else (out | part if erode else out & part)
    return out


def smooth_mask(mask: np.ndarray, steps: int) -> np.ndarray:
    """Morphological curvature: in turn the union of plane erosions of dilations and the other way round."""
    out = np.asarray(mask) != 0
    for i in range(steps):
        for erode in (True, False) if i % 2 == 0 else (False, True):
            out = _planes(out, erode)
    return out


def active_contour(labels: np.ndarray, image: np.ndarray, steps: int = 6, smooth: int = 1, alpha: float = 1.0) -> np.ndarray:
    """Evolution and per-label smoothing in turn; later labels overwrite."""
    out = np.asarray(labels).astype(np.int64)
    for _ in range(steps):
        out = evolve(out, image, alpha)
        if smooth:
            new = np.zeros_like(out)
            for k in np.unique(out[out != 0]):
                new[smooth_mask(out == k, smooth)] = k
            out = new
    return out


def mixed(h, *parts):
    """The counter hash ``h`` with further parts mixed in, one after the other."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(31))
            h = h * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(29))
    return h


def fraction(h) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


#: The hash before any part.
START = np.uint64(0x9E3779B97F4A7C15)


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) from counters: the same for equal parts on any machine and partition."""
    return fraction(mixed(START, *parts))


def seed_spread(image: np.ndarray, labels: np.ndarray, axis: int = 0) -> np.ndarray:
    """Mean squared deviation of same-label voxels in the 3 x 3 patch of the seed's plane from the seed; 1 at least."""
    image, total, n = np.asarray(image, float), np.zeros(np.shape(image)), np.zeros(np.shape(image))
    others = [i for i in range(3) if i != axis]
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            step = [0, 0, 0]
            step[others[0]], step[others[1]] = a, b
            same = shifted(np.asarray(labels), tuple(step), -1) == labels
            total += np.where(same, (shifted(image, tuple(step), 0.0) - image) ** 2, 0)
            n += same
    return np.maximum(1.0, total / np.maximum(n, 1))


def random_walks(image: np.ndarray, labels: np.ndarray, label: int, walks: int, steps: int, key: int = 0, origin: tuple[int, int, int] = (0, 0, 0), chosen: np.ndarray | None = None, axis: int = 0) -> np.ndarray:
    """Hits of walks from every seed of ``label``.

    A step goes to a face neighbour with weight exp(-(B - A)**2 / (2 var)), B being the seed's
    intensity and A the neighbour's; a move that would leave the array uses up its step without a hit.
    Random numbers depend on (key, global seed position, walk, step) alone.
    """
    return walk_together([(image, labels, label, key, origin, chosen, axis)], walks, steps)[0]


def neighbours(shape: tuple[int, ...]) -> np.ndarray:
    """Flat position of the six face neighbours of each voxel (6, n), -1 outside."""
    at = np.indices(shape).reshape(3, -1)
    to = at[None] + np.array(FACES)[:, :, None]
    ok = ((to >= 0) & (to < np.array(shape)[:, None])).all(1)
    return np.where(ok, np.ravel_multi_index(tuple(np.where(ok[:, None], to, 0).swapaxes(0, 1)), shape), -1)


def walk_together(jobs: list[tuple], walks: int, steps: int, most: int = 1 << 20) -> list[np.ndarray]:
    """Hits of each job (image, labels, label, key, origin, chosen, axis) of ``random_walks``; all walks take each step at once.

    Weights are summed once for each seed and voxel where those are at most ``most``, else at each step;
    a quarter of that many walks go together.
    """
    fields = [np.asarray(j[0], float) for j in jobs]
    seeds = [np.argwhere((np.asarray(j[1]) == j[2]) & (True if j[5] is None else j[5])) for j in jobs]
    count, sizes = np.array([len(s) for s in seeds]), np.array([f.size for f in fields])
    first = np.cumsum(sizes) - sizes
    hits = np.zeros(sizes.sum(), np.int64)
    if count.sum():
        # per seed: its job, flat position, intensity and spread, and the hash of all that its walks share
        own = np.repeat(np.arange(len(jobs)), count)
        begin = np.concatenate([np.ravel_multi_index(tuple(s.T), f.shape) + o for s, f, o in zip(seeds, fields, first)])
        flat = np.concatenate([f.ravel() for f in fields])
        level = flat[begin]
        var = np.concatenate([seed_spread(f, j[1], j[6])[tuple(s.T)] for s, f, j in zip(seeds, fields, jobs)])
        shared = np.concatenate([mixed(START, j[3], *(s[:, k] + j[4][k] for k in range(3)), j[2]) for s, j in zip(seeds, jobs)])
        shapes = {f.shape: neighbours(f.shape) for f in fields}
        near = np.concatenate([np.where(shapes[f.shape] < 0, -1, shapes[f.shape] + o) for f, o in zip(fields, first)], axis=1)
        corner = np.repeat(first, sizes)

        def sums(at: np.ndarray, seed: np.ndarray) -> np.ndarray:
            to = near[:, at]
            w = np.exp(-((level[seed] - flat[np.where(to < 0, corner[at], to)]) ** 2) / (2 * var[seed]))
            return np.cumsum(w, axis=0)

        width = sizes[own]
        tabled = width.sum() <= most
        if tabled:
            start = np.cumsum(width) - width
            seed = np.repeat(np.arange(len(own)), width)
            table = sums(np.arange(len(seed)) - start[seed] + first[own[seed]], seed)
            shift = start - first[own]
        flow = near.T.ravel()
        size = max(1, most // 4)
        for low in range(0, len(own) * walks, size):
            walk, seed = np.divmod(np.arange(low, min(low + size, len(own) * walks)), len(own))
            at, h = begin[seed], mixed(shared[seed], walk)
            for step in range(steps):
                total = table[:, at + shift[seed]] if tabled else sums(at, seed)
                u = fraction(mixed(h, step)) * total[5]
                to = flow[at * 6 + (total[:5] <= u).sum(0)]
                moved = to >= 0
                at = np.where(moved, to, at)
                np.add.at(hits, at[moved], 1)
    return [hits[o : o + n].reshape(f.shape) for o, n, f in zip(first, sizes, fields)]


def adaptive_seeds(labels: np.ndarray, reach: int = 100) -> np.ndarray:
    """Seeds to walk from on large volumes: a quarter grid, or with another label within ``reach`` in the slice."""
    labels = np.asarray(labels)
    y, x = np.indices(labels.shape)[1:]
    out = (y + x) % 4 == 0
    for z in range(labels.shape[0]):
        ids = np.unique(labels[z][labels[z] > 0])
        for k in ids:
            other = (labels[z] > 0) & (labels[z] != k)
            table = np.pad(other.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            ys, xs = np.indices(other.shape)
            y0, y1 = np.maximum(ys - reach, 0), np.minimum(ys + reach + 1, other.shape[0])
            x0, x1 = np.maximum(xs - reach, 0), np.minimum(xs + reach + 1, other.shape[1])
            near = table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]
            out[z] |= (labels[z] == k) & (near > 0)
    return out & (labels > 0)


def rotation(alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Rotation about z, then y, then x, in radians, acting on (z, y, x)."""
    ca, sa, cb, sb, cg, sg = np.cos(alpha), np.sin(alpha), np.cos(beta), np.sin(beta), np.cos(gamma), np.sin(gamma)
    rz = np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]])
    ry = np.array([[cb, 0, -sb], [0, 1, 0], [sb, 0, cb]])
    rx = np.array([[cg, -sg, 0], [sg, cg, 0], [0, 0, 1]])
    return rx @ ry @ rz


def turned(a: np.ndarray, matrix: np.ndarray, nearest: bool = False) -> np.ndarray:
    """``a`` turned about half its size: a point takes what lies at its place times ``matrix``, between voxels by weights or, for
    labels, from the nearest one; places outside take the edge."""
    top = np.array(a.shape)[:, None] - 1
    centre = np.array(a.shape)[:, None] / 2
    place = matrix @ (np.indices(a.shape).reshape(3, -1) - centre) + centre
    if nearest:
        return a[tuple(np.clip(np.rint(place).astype(int), 0, top))].reshape(a.shape)
    base = np.floor(place)
    part, out = place - base, np.zeros(a.size)
    for corner in np.ndindex(2, 2, 2):
        step = np.array(corner)[:, None]
        out += np.prod(np.where(step, part, 1 - part), axis=0) * a[tuple(np.clip((base + step).astype(int), 0, top))]
    return out.reshape(a.shape)


def rotate_mask(mask: np.ndarray, matrix: np.ndarray, gather: bool = True) -> np.ndarray:
    """The mask turned about its centre, nearest voxel, clamped: gathered by the inverse or scattered forward."""
    mask = np.asarray(mask) != 0
    centre = (np.array(mask.shape) - 1) / 2
    points = np.indices(mask.shape).reshape(3, -1).T if gather else np.argwhere(mask)
    to = np.rint((points - centre) @ (matrix if gather else matrix.T) + centre).astype(int)
    to = np.clip(to, 0, np.array(mask.shape) - 1)
    if gather:
        return mask[tuple(to.T)].reshape(mask.shape)
    out = np.zeros_like(mask)
    out[tuple(to.T)] = True
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    n = a.sum() + b.sum()
    return 2 * (a & b).sum() / n if n else 1.0


def search_rotation(a: np.ndarray, b: np.ndarray, coarse: float = 15.0, fine: tuple[float, ...] = (5.0, 1.0)) -> tuple[float, float, float, float]:
    """(dice, alpha, beta, gamma in degrees) that turns ``a`` best onto ``b``: a coarse grid, then finer ones around the best."""
    a, b = np.asarray(a) != 0, np.asarray(b) != 0
    best = (-1.0, 0.0, 0.0, 0.0)

    def look(*axes):
        nonlocal best
        for angles, index in turns(a.shape, axes):
            turned = a.ravel()[index]
            both, n = (turned & b.ravel()).sum(1), turned.sum(1) + b.sum()
            dice = np.where(n > 0, 2 * both / np.maximum(n, 1), 1.0)
            k = int(dice.argmax())
            if dice[k] > best[0]:
                best = (float(dice[k]), *map(float, angles[k]))

    look(*(np.arange(0, end, coarse) for end in (360, 180, 360)))
    step = coarse
    for f in fine:
        look(*(np.arange(c - step + f, c + step, f) for c in best[1:]))
        step = f
    return best


#: Turned positions of the last whole grids, by shape and angles.
_TURNS: dict[tuple, list] = {}


def turns(shape: tuple[int, ...], axes: tuple[np.ndarray, ...], most: int = 1 << 20):
    """Chunks of (angles in degrees, flat positions that ``rotate_mask`` gathers from) over a grid of angles, first axis slowest.

    A chunk holds about ``most`` positions; a grid that starts at 0 and fits one chunk is kept for the next call.
    """
    whole = (shape, tuple(map(tuple, axes)))
    if whole in _TURNS:
        yield from _TURNS[whole]
        return
    angles = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    centre = (np.array(shape) - 1) / 2
    points = np.indices(shape).reshape(3, -1).T - centre
    size = max(1, most // len(points))
    for at in range(0, len(angles), size):
        some = angles[at : at + size]
        matrices = np.array([rotation(*np.radians(t)) for t in some])
        to = np.clip(np.rint(points @ matrices + centre).astype(np.int64), 0, np.array(shape) - 1)
        out = some, np.ravel_multi_index(tuple(np.moveaxis(to, 2, 0)), shape)
        if len(some) == len(angles) and not angles[0].any():
            _TURNS.clear()
            _TURNS[whole] = [out]
        yield out


def majority(votes: list[np.ndarray], locked: np.ndarray | None = None) -> np.ndarray:
    """Voxels with at least two votes that are not locked; only the largest component."""
    total = sum(np.asarray(v) != 0 for v in votes) >= 2
    if locked is not None:
        total &= np.asarray(locked) == 0
    return largest(total)


def resize_axis(a: np.ndarray, axis: int, n: int, cubic: bool) -> np.ndarray:
    """Area means, or cubic interpolation (a = -0.75) with repeated ends, along one axis."""
    a = np.moveaxis(np.asarray(a, float), axis, 0)
    m = a.shape[0]
    if not cubic:
        total = np.concatenate([np.zeros_like(a[:1]), np.cumsum(a, 0)])
        edge = np.arange(n + 1) * m / n
        low = np.minimum(edge.astype(int), m)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
        at = total[low] * (1 - part) + total[np.minimum(low + 1, m)] * part
        out = np.diff(at, axis=0) * (n / m)
    else:
        x = (np.arange(n) + 0.5) * m / n - 0.5
        base = np.floor(x).astype(int)
        t = x - base
        k = -0.75
        w = [((k * (t + 1) - 5 * k) * (t + 1) + 8 * k) * (t + 1) - 4 * k, ((k + 2) * t - (k + 3)) * t * t + 1]
        w.append(((k + 2) * (1 - t) - (k + 3)) * (1 - t) ** 2 + 1)
        w.append(1 - w[0] - w[1] - w[2])
        out = sum(a[np.clip(base + i - 1, 0, m - 1)] * w[i].reshape(-1, *[1] * (a.ndim - 1)) for i in range(4))
    return np.moveaxis(out, 0, axis)


def resize(a: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Axis by axis; area means if any axis shrinks, else cubic."""
    cubic = all(n >= m for n, m in zip(shape, np.shape(a)))
    for axis, n in enumerate(shape):
        if n != np.shape(a)[axis]:
            a = resize_axis(a, axis, n, cubic)
    return np.asarray(a, float)


def ring_cells(shape: tuple[int, int], ys: np.ndarray, xs: np.ndarray, dr: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres (n, 2) of a grid, and for each centre and pixel the number of ``dr`` wide steps to it, offset by centre; steps a centre."""
    centres = np.stack(np.meshgrid(ys, xs, indexing="ij"), -1).reshape(-1, 2)
    y, x = np.indices(shape).reshape(2, -1)
    d = np.sqrt((y - centres[:, :1]) ** 2 + (x - centres[:, 1:]) ** 2)
    cells = np.ceil(d / dr - 1e-9).astype(np.int64)
    k = int(np.ceil(np.hypot(*shape) / dr)) + 2
    return centres, cells + np.arange(len(centres))[:, None] * k, k


#: Cells of the last whole grids, by what makes them.
_CELLS: dict[tuple, tuple] = {}


def best_rings(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, width: float, parts: int, keep: bool = False) -> tuple[float, ...]:
    """(share of zeros, -radius, distance to the slice's centre, cy, cx, r) of the best circle inside the slice with a centre on the grid."""
    (h, w), dr = image.shape, width / parts
    zero, best = image.ravel() == 0, (np.inf,)
    rows = max(1, (1 << 20) // (image.size * len(xs)))
    for low in range(0, len(ys), rows):
        key = (image.shape, tuple(ys[low : low + rows]), tuple(xs), dr)
        found = _CELLS.get(key) or ring_cells(image.shape, ys[low : low + rows], xs, dr)
        if keep and len(ys) <= rows:
            if key not in _CELLS:
                _CELLS.clear()
            _CELLS[key] = found
        centres, cells, k = found
        count = lambda c: np.bincount(c.ravel(), minlength=len(centres) * k).reshape(-1, k).cumsum(1)
        rings = lambda c: c - np.pad(c, ((0, 0), (parts, 0)))[:, :k]
        zeros, n = rings(count(cells[:, zero])), rings(count(cells))
        r = np.arange(k) * dr
        room = np.minimum(np.minimum(centres[:, 0], h - 1 - centres[:, 0]), np.minimum(centres[:, 1], w - 1 - centres[:, 1])) + 0.5
        c, at = np.nonzero((n > 0) & (r > (width if 2 * width < min(h, w) else 0.5)) & (r <= room[:, None] + 1e-9))
        if len(c):
            share, off = zeros[c, at] / n[c, at], np.hypot(*(centres[c] - [(h - 1) / 2, (w - 1) / 2]).T)
            i = np.lexsort((off, -at, share))[0]
            best = min(best, (float(share[i]), -float(r[at[i]]), float(off[i]), *map(float, centres[c[i]]), float(r[at[i]])))
    return best


def fit_circle(image: np.ndarray, width: int = 10, grid: int = 15) -> tuple[float, float, float]:
    """Centre (y, x) and radius of the ring of ``width`` with the least share of zeros in a slice; of equals the largest, then the most central.

    Circles that lie in the slice and, where it has room, around a hole are tried: centres all over it, ``grid`` an axis and
    half a width apart at most, then ``grid`` an axis between the neighbours of the best, with finer radii.
    """
    h, w = image.shape
    parts = max(1, int(np.ceil(width * grid / (min(h, w) / 2))))
    ys, xs = (np.linspace(0, n - 1, max(grid, int(np.ceil(2 * n / width)))) for n in (h, w))
    best = best_rings(image, ys, xs, width, parts, keep=True)
    if len(best) == 1:
        return (h - 1) / 2, (w - 1) / 2, min(h, w) / 2
    step = [a[1] - a[0] if len(a) > 1 else 0.0 for a in (ys, xs)]
    fine = best_rings(image, *(np.linspace(c - s, c + s, grid) for c, s in zip(best[3:5], step)), width, 4 * parts)
    return min(best, fine)[3:]


def elastic_free_augment(a: np.ndarray, flips: tuple[bool, bool, bool], swap: tuple[int, int, int]) -> np.ndarray:
    """Flips and an axis order, the augmentations that keep voxels whole."""
    for axis, flip in enumerate(flips):
        if flip:
            a = np.flip(a, axis)
    return np.transpose(a, swap)


def transplant(a: np.ndarray, b: np.ndarray, matrix: np.ndarray, locked: np.ndarray | None = None) -> np.ndarray:
    """``a`` with the voxels of ``b`` turned onto it; locked voxels stay as they are, only the largest component is kept."""
    a = np.asarray(a) != 0
    new = a | rotate_mask(b, matrix)
    if locked is not None:
        new = np.where(np.asarray(locked) != 0, a, new)
    return largest(new)


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every voxel to the nearest one of the mask, infinite without any: one axis after the other."""
    out = np.where(np.asarray(mask) != 0, 0.0, np.inf)
    for axis in range(3):
        f = np.moveaxis(out, axis, 0)
        i = np.arange(f.shape[0], dtype=float)
        best = np.full_like(f, np.inf)
        for j in range(f.shape[0]):
            best = np.minimum(best, f[j][None] + ((i - j) ** 2).reshape(-1, *[1] * (f.ndim - 1)))
        out = np.moveaxis(best, 0, axis)
    return out


def surface_mask(mask: np.ndarray) -> np.ndarray:
    """Voxels of the mask where its central differences (one-sided at the ends) are not all 0."""
    a = (np.asarray(mask) != 0).astype(float)
    steep = np.zeros(a.shape, bool)
    for axis, n in enumerate(a.shape):
        if n > 1:
            steep |= np.gradient(a, axis=axis) != 0
    return (a > 0) & steep
