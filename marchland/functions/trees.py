"""Packed bounding-box trees over arrays of points, and the dual descent over two of them (NumPy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EARTH_M = 6371008.8
LEAF = 8
FAN = 4
WHOLESALE = 512


def chord(radius_m: float) -> float:
    """Straight-line length under an arc of the sphere."""
    return 2 * EARTH_M * np.sin(min(radius_m / EARTH_M, np.pi) / 2)


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Degrees to metres in space, one row per axis."""
    la, lo = np.radians(lat), np.radians(lon)
    c = np.cos(la)
    return EARTH_M * np.stack([c * np.cos(lo), c * np.sin(lo), np.sin(la)])


def arc(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    y = np.clip((lat + 90) / 180 * 2**31, 0, 2**31 - 1)
    x = np.clip((lon + 180) / 360 * 2**31, 0, 2**31 - 1)
    return _spread(x) | (_spread(y) << np.uint64(1))


class BoxTree:
    """Boxes over consecutive runs of points that are in space order; level 0 are the leaves."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        self.n, self.lat, self.lon = len(lat), lat, lon
        self.xyz = on_sphere(lat, lon)
        lo, hi = self._pack(self.xyz, self.xyz, LEAF)
        self.lo, self.hi = [lo], [hi]
        while self.lo[-1].shape[1] > FAN:
            self.raise_()

    def raise_(self) -> None:
        lo, hi = self._pack(self.lo[-1], self.hi[-1], FAN)
        self.lo.append(lo)
        self.hi.append(hi)

    @staticmethod
    def _pack(lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, lo.shape[1], width)
        return np.minimum.reduceat(lo, at, axis=1), np.maximum.reduceat(hi, at, axis=1)


def _gaps(one: BoxTree, two: BoxTree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between the boxes of node pairs."""
    near, far = np.zeros(len(i)), np.zeros(len(i))
    for k in range(3):
        a, b = one.lo[level][k][i], one.hi[level][k][i]
        c, d = two.lo[level][k][j], two.hi[level][k][j]
        near += np.maximum(0, np.maximum(c - b, a - d)) ** 2
        far += np.maximum(b - c, d - a) ** 2
    return near, far


def _products(one: BoxTree, two: BoxTree, level: int, i: np.ndarray, j: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All member pairs of disjoint node pairs, in chunks."""
    width = LEAF * FAN**level
    si, sj = i * width, j * width
    ni, nj = np.minimum(width, one.n - si), np.minimum(width, two.n - sj)
    sizes = ni * nj
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)) if len(sizes) else []
    for part in np.split(np.arange(len(sizes)), cuts):
        if not len(part):
            continue
        k = np.repeat(part, sizes[part])
        offset = np.arange(len(k)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        yield si[k] + offset // nj[k], sj[k] + offset % nj[k]


def near_pairs(one: BoxTree, two: BoxTree | None, radius_m: float, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, one of each tree, or of the first alone if there is no second. Dual descent:
    impossible node pairs are discarded, node pairs that are certainly near are taken wholesale, and what stays uncertain is
    refined down to the leaves' points."""
    same = two is None
    two = one if same else two
    while len(one.lo) < len(two.lo):
        one.raise_()
    while len(two.lo) < len(one.lo):
        two.raise_()
    limit = chord(radius_m) ** 2
    sure, maybe = limit * (1 - 1e-6), limit * (1 + 1e-6) + 1e-9
    top = len(one.lo) - 1
    n, m = one.lo[top].shape[1], two.lo[top].shape[1]
    i, j = np.triu_indices(n) if same else (np.repeat(np.arange(n), m), np.tile(np.arange(m), n))
    kids = np.arange(FAN)
    for level in range(top, -1, -1):
        near, far = _gaps(one, two, level, i, j)
        keep = near <= maybe
        whole = keep & (far <= sure) & (LEAF * FAN**level <= WHOLESALE)
        if same:
            whole &= i != j
        yield from _products(one, two, level, i[whole], j[whole])
        rest = keep & ~whole
        i, j = i[rest], j[rest]
        if level:
            ci = np.repeat(i[:, None] * FAN + kids, FAN, axis=1).ravel()
            cj = np.tile(j[:, None] * FAN + kids, (1, FAN)).ravel()
            ok = (ci < one.lo[level - 1].shape[1]) & (cj < two.lo[level - 1].shape[1])
            if same:
                ok &= ci <= cj
            i, j = ci[ok], cj[ok]
    slots = np.arange(LEAF)
    for s in range(0, len(i), chunk):
        a = np.repeat(i[s : s + chunk, None] * LEAF + slots, LEAF, axis=1).ravel()
        b = np.tile(j[s : s + chunk, None] * LEAF + slots, (1, LEAF)).ravel()
        ok = (a < one.n) & (b < two.n)
        if same:
            ok &= a < b
        a, b = a[ok], b[ok]
        d2 = ((one.xyz[:, a] - two.xyz[:, b]) ** 2).sum(axis=0)
        ok = d2 <= maybe
        a, b, d2 = a[ok], b[ok], d2[ok]
        edge = d2 > sure
        if edge.any():
            inside = ~edge
            inside[edge] = arc(one.lat[a[edge]], one.lon[a[edge]], two.lat[b[edge]], two.lon[b[edge]]) <= radius_m
            a, b = a[inside], b[inside]
        yield a, b


class Region:
    """One region's rings (first outer, further holes) with an index of edges by latitude slab."""

    def __init__(self, region_id: int, rings: list[np.ndarray]) -> None:
        self.id = region_id
        x1, y1, x2, y2, ring = [], [], [], [], []
        for k, r in enumerate(rings):
            nxt = np.roll(r, -1, axis=0)
            x1.append(r[:, 0]), y1.append(r[:, 1]), x2.append(nxt[:, 0]), y2.append(nxt[:, 1]), ring.append(np.full(len(r), k))
        self.x1, self.y1, self.x2, self.y2, self.ring = map(np.concatenate, (x1, y1, x2, y2, ring))
        # boxes of all edges, level ones included: those are crossed by no ray but bound the region all the same
        self.lo = np.stack([np.minimum(self.x1, self.x2), np.minimum(self.y1, self.y2)])
        self.hi = np.stack([np.maximum(self.x1, self.x2), np.maximum(self.y1, self.y2)])
        level = self.y1 != self.y2
        self.x1, self.y1, self.x2, self.y2, self.ring = (v[level] for v in (self.x1, self.y1, self.x2, self.y2, self.ring))
        self.rings = len(rings)
        self.box = (min(v.min() for v in (self.x1, self.x2)), min(v.min() for v in (self.y1, self.y2)), max(v.max() for v in (self.x1, self.x2)), max(v.max() for v in (self.y1, self.y2))) if len(self.x1) else None
        if self.box:
            slabs = max(1, min(4096, len(self.x1)))
            self.h = (self.box[3] - self.box[1]) / slabs
            lo = np.clip(((np.minimum(self.y1, self.y2) - self.box[1]) / self.h).astype(int), 0, slabs - 1)
            hi = np.clip(((np.maximum(self.y1, self.y2) - self.box[1]) / self.h).astype(int), 0, slabs - 1)
            reps = hi - lo + 1
            edge = np.repeat(np.arange(len(lo)), reps)
            slab = np.repeat(lo, reps) + np.arange(len(edge)) - np.repeat(np.cumsum(reps) - reps, reps)
            order = np.argsort(slab, kind="stable")
            self.edges, self.slabs = edge[order], slabs
            self.at = np.searchsorted(slab[order], np.arange(slabs + 1))

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Even-odd rule per ring: inside the outer one and in no hole."""
        out = np.zeros(len(x), bool)
        if not self.box:
            return out
        cand = np.flatnonzero((x >= self.box[0]) & (x <= self.box[2]) & (y >= self.box[1]) & (y <= self.box[3]))
        for part in np.array_split(cand, max(1, len(cand) // 50_000)):
            if len(part):
                out[part] = self._holds(x[part], y[part])
        return out

    def _holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slab = np.clip(((y - self.box[1]) / self.h).astype(int), 0, self.slabs - 1)
        reps = self.at[slab + 1] - self.at[slab]
        p = np.repeat(np.arange(len(x)), reps)
        e = self.edges[np.repeat(self.at[slab], reps) + np.arange(len(p)) - np.repeat(np.cumsum(reps) - reps, reps)]
        px, py = x[p], y[p]
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        cross = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1))
        odd = np.bincount(p[cross] * self.rings + self.ring[e[cross]], minlength=len(x) * self.rings).reshape(len(x), self.rings) % 2 == 1
        return odd[:, 0] & ~odd[:, 1:].any(axis=1)

    def crosses(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether an edge's box touches each of the boxes (2 × n: x, y)."""
        out = np.zeros(lo.shape[1], bool)
        (ex0, ey0), (ex1, ey1) = self.lo, self.hi
        for s in range(0, lo.shape[1], 2048):
            a, b = lo[:, s : s + 2048], hi[:, s : s + 2048]
            hit = (ex0 <= b[0][:, None]) & (ex1 >= a[0][:, None]) & (ey0 <= b[1][:, None]) & (ey1 >= a[1][:, None])
            out[s : s + 2048] = hit.any(axis=1)
        return out


class Regions:
    """Regions in order of preference; one is built when points first lie in its box."""

    def __init__(self, ids: np.ndarray, rings: list[list[np.ndarray]]) -> None:
        self.ids, self.rings = ids, rings
        self.boxes = np.array([[r[0][:, 0].min(), r[0][:, 1].min(), r[0][:, 0].max(), r[0][:, 1].max()] for r in rings]).reshape(-1, 4)
        self._built: dict[int, Region] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": {}}

    def region(self, k: int) -> Region:
        if k not in self._built:
            self._built[k] = Region(int(self.ids[k]), self.rings[k])
        return self._built[k]

    def first(self, x: np.ndarray, y: np.ndarray, width: int = LEAF * FAN, chunk: int = 4096) -> np.ndarray:
        """Place of the first region that holds each point, -1 if none does. Points should be in space order: only regions
        whose box meets that of a chunk of them are looked at."""
        found = np.full(len(x), -1)
        for s in range(0, len(x), chunk):
            px, py = x[s : s + chunk], y[s : s + chunk]
            meets = (self.boxes[:, 0] <= px.max()) & (self.boxes[:, 2] >= px.min()) & (self.boxes[:, 1] <= py.max()) & (self.boxes[:, 3] >= py.min())
            at = np.flatnonzero(meets)
            part = first_region(px, py, [self.region(k) for k in at], width)
            found[s : s + chunk] = np.where(part >= 0, at[part] if len(at) else -1, -1)
        return found


def first_region(x: np.ndarray, y: np.ndarray, regions: list[Region], width: int = LEAF * FAN) -> np.ndarray:
    """Position in ``regions`` (ordered by preference) of the first one that holds each point, -1 if none does.

    Runs of ``width`` neighbouring points form nodes: one that no edge touches is decided by one of its points.
    """
    found = np.full(len(x), -1)
    if not len(x):
        return found
    at = np.arange(0, len(x), width)
    lo = np.stack([np.minimum.reduceat(x, at), np.minimum.reduceat(y, at)])
    hi = np.stack([np.maximum.reduceat(x, at), np.maximum.reduceat(y, at)])
    node = np.arange(len(x)) // width
    for k, r in enumerate(regions):
        if not r.box:
            continue
        near = np.flatnonzero((lo[0] <= r.box[2]) & (hi[0] >= r.box[0]) & (lo[1] <= r.box[3]) & (hi[1] >= r.box[1]))
        if not len(near):
            continue
        mixed = r.crosses(lo[:, near], hi[:, near])
        pure = near[~mixed]
        take = np.zeros(len(at), np.int8)
        take[pure[r.holds(x[at[pure]], y[at[pure]])]] = 1
        take[near[mixed]] = 2
        state = take[node]
        open_ = found < 0
        found[open_ & (state == 1)] = k
        test = np.flatnonzero(open_ & (state == 2))
        found[test[r.holds(x[test], y[test])]] = k
    return found
