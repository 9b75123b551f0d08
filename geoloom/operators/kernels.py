"""Sequential algorithms on one path, polygon or field, in numpy: run inside grouped Arrow functions, one group a call."""

from __future__ import annotations

import heapq
import math
from itertools import combinations

import numpy as np

EARTH = 6_371_000.0
DEG_M = math.pi / 180 * EARTH
#: Most nodes of the visibility graphs.
NODES_SINGLE, NODES_MULTI = 64, 256

Point = tuple[float, float]


# --- fields ------------------------------------------------------------------------------------------------------


def fast_march(cost: np.ndarray, src: tuple[int, int]) -> np.ndarray:
    """Arrival times (float32, infinite where unreached) of a front from ``src`` through costs, by upwind updates on the
    four neighbours; cells of equal time are settled in order of their index."""
    rows, cols = cost.shape
    if not (rows and cols and 0 <= src[0] < rows and 0 <= src[1] < cols):
        return np.full((rows, cols), np.inf, np.float32)
    return march(cost.astype(np.float32), src).astype(np.float32)


def march(cost: np.ndarray, src: tuple[int, int] | None, rim: np.ndarray | None = None) -> np.ndarray:
    """Arrival times (double) from ``src``, and from known times on a ``rim`` of one cell round the field (infinite where none
    are). The rim's cells are walls otherwise, so that no neighbour needs a test of bounds; ``settled`` holds times of
    settled cells only, so none needs a flag. A rim's time that comes too late for a cell does not change its update."""
    rows, cols = cost.shape
    inf, wide, root = math.inf, cols + 2, math.sqrt
    padded = np.full((rows + 2, wide), inf)
    padded[1:-1, 1:-1] = cost
    settled, best = [inf] * padded.size if rim is None else rim.ravel().tolist(), [inf] * padded.size
    heap, pop, push = [], heapq.heappop, heapq.heappush
    if src is not None:
        start = (src[0] + 1) * wide + src[1] + 1
        padded.ravel()[start] = 0.0  # the source is settled whatever it costs
        best[start] = 0.0
        heap.append((0.0, start))
    costs = padded.ravel().tolist()

    def update(n: int, w: float) -> float:
        a, b = min(settled[n - wide], settled[n + wide]), min(settled[n - 1], settled[n + 1])
        low, gap = (a, b - a) if a < b else (b, a - b)
        return low + w if gap >= w else low + (gap + root(2 * w * w - gap * gap)) / 2

    if rim is not None:
        edge = np.zeros((rows + 2, wide), bool)
        for there, here in (((0, slice(None)), (1, slice(None))), ((-1, slice(None)), (-2, slice(None))), ((slice(None), 0), (slice(None), 1)), ((slice(None), -1), (slice(None), -2))):
            edge[here] |= np.isfinite(rim[there])
        for n in np.flatnonzero(edge & np.isfinite(padded)).tolist():
            if (new := update(n, costs[n])) < best[n]:
                best[n] = new
                push(heap, (new, n))
    around = (-wide, wide, -1, 1)
    while heap:
        at, i = pop(heap)
        if settled[i] != inf:
            continue
        settled[i] = at
        for step in around:
            n = i + step
            w = costs[n]
            if w == inf or settled[n] != inf:
                continue
            a, x = settled[n - wide], settled[n + wide]
            if x < a:
                a = x
            b, x = settled[n - 1], settled[n + 1]
            if x < b:
                b = x
            low, gap = (a, b - a) if a < b else (b, a - b)
            new = low + w if gap >= w else low + (gap + root(2 * w * w - gap * gap)) / 2
            if new < best[n]:
                best[n] = new
                push(heap, (new, n))
    return np.array(settled).reshape(rows + 2, wide)[1:-1, 1:-1]


def straighten(cells: list[tuple[int, int]], blocked: np.ndarray) -> list[tuple[int, int]]:
    """Those of a trace's cells that straight lines over free cells can join: from each kept one to a far one in sight,
    found by doubling the step and halving it again. Lines are looked at every quarter of a cell."""

    def clear(a: tuple[int, int], b: tuple[int, int]) -> bool:
        t = np.linspace(0, 1, 4 * max(abs(b[0] - a[0]), abs(b[1] - a[1])) + 1)
        at = [np.rint(p + (q - p) * t).astype(int) for p, q in zip(a, b)]
        return not blocked[at[0], at[1]].any()

    kept, i, n = cells[:1], 0, len(cells)
    while i < n - 1:
        step, last = 1, i + 1
        while i + 2 * step < n and clear(cells[i], cells[i + 2 * step]):
            step *= 2
            last = i + step
        while step:
            if last + step < n and clear(cells[i], cells[last + step]):
                last += step
            step //= 2
        kept.append(cells[last])
        i = last
    return kept


def tighten(cells: list[tuple[int, int]], blocked: np.ndarray, rounds: int = 6) -> list[tuple[int, int]]:
    """A trace straightened, then its lines' cells straightened from the other end, and so on; what is shorter stays."""
    best, same = straighten(cells, blocked), 0
    for back in [True, False] * (rounds // 2):
        if same == 2:  # neither direction changed anything, nor would it again
            break
        line = best[:1]
        for a, b in zip(best, best[1:]):
            n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
            line += [(round(a[0] + (b[0] - a[0]) * k / n), round(a[1] + (b[1] - a[1]) * k / n)) for k in range(1, n + 1)]
        found = straighten(line[::-1], blocked)[::-1] if back else straighten(line, blocked)
        same += 1
        if sum(map(math.dist, found, found[1:])) < sum(map(math.dist, best, best[1:])) - 1e-9:
            best, same = found, 0
    return best


def back_trace(times: np.ndarray, dst: tuple[int, int], src: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Cells from ``dst`` down the steepest neighbour to ``src``; None where the front did not get to ``dst``."""
    rows, cols = times.shape
    if not (0 <= dst[0] < rows and 0 <= dst[1] < cols) or not np.isfinite(times[dst]):
        return None
    path = [dst]
    while path[-1] != src:
        r, c = path[-1]
        near = [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
        best = min((p for p in near if 0 <= p[0] < rows and 0 <= p[1] < cols), key=lambda p: times[p], default=None)
        if best is None or not times[best] < times[r, c]:
            return None
        path.append(best)
    return path


def nearest_reached(times: np.ndarray, at: tuple[int, int], most_cells: float) -> tuple[int, int] | None:
    """The reached cell within ``most_cells`` of ``at`` of least time, then distance, then index."""
    r, c = np.nonzero(np.isfinite(times))
    d = np.hypot(r - at[0], c - at[1])
    ok = d <= most_cells
    if not ok.any():
        return None
    order = np.lexsort((c[ok], r[ok], d[ok], times[r[ok], c[ok]]))
    return int(r[ok][order[0]]), int(c[ok][order[0]])


# --- polygons and visibility ------------------------------------------------------------------------------------


def _side(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points) -> list[Point]:
    """Counter-clockwise from the leftmost point, without collinear ones."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) <= 2:
        return pts

    def chain(seq):
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


def offset_convex(poly: list[Point], by: float) -> list[Point]:
    """Each edge moved outwards by ``by``: a vertex goes along the sum of its edges' normals, as far as brings it to both
    moved edges. Empty where edges vanish or run parallel."""
    if len(poly) < 3 or by <= 0:
        return []
    v = np.asarray(poly, float)
    edge = np.roll(v, -1, axis=0) - v
    length = np.hypot(edge[:, 0], edge[:, 1])
    if not length.all():
        return []
    ahead = np.column_stack([edge[:, 1], -edge[:, 0]]) / length[:, None]
    behind = np.roll(ahead, 1, axis=0)
    if (np.abs(behind[:, 0] * ahead[:, 1] - behind[:, 1] * ahead[:, 0]) < 1e-15).any():
        return []
    out = v + by * (behind + ahead) / (1 + (behind * ahead).sum(1, keepdims=True))
    return [(float(x), float(y)) for x, y in out]


def passes_convex(a: Point, b: Point, poly: list[Point], eps: float = 1e-9) -> bool:
    """Whether a segment goes through the interior of a counter-clockwise polygon, by more than ``eps``; the same rule as
    `geometry.segment_through_convex`."""
    if len(poly) < 3:
        return False
    (ax, ay), (bx, by) = a, b
    dx, dy, enters, leaves = bx - ax, by - ay, 0.0, 1.0
    px, py = poly[-1]
    for qx, qy in poly:
        ex, ey = qx - px, qy - py
        depth, gain = ex * (ay - py) - ey * (ax - px), ex * dy - ey * dx
        px, py = qx, qy
        if -1e-15 < gain < 1e-15:
            if depth < eps:
                return False
        elif gain > 0:
            enters = max(enters, (eps - depth) / gain)
        else:
            leaves = min(leaves, (eps - depth) / gain)
    return enters <= leaves + 1e-12


def shortest(n: int, edges: dict[int, list[tuple[int, float]]], src: int, dst: int) -> list[int] | None:
    """Dijkstra; equal distances settle by node number."""
    dist, before, heap = {src: 0.0}, {}, [(0.0, src)]
    done = set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        if u == dst:
            path = [u]
            while path[-1] != src:
                path.append(before[path[-1]])
            return path[::-1]
        done.add(u)
        for v, w in edges.get(u, ()):
            if d + w < dist.get(v, math.inf):
                dist[v], before[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return None


def visibility_path(start: Point, goal: Point, obstacles: list[list[Point]], inflate: float, most_nodes: int | None = None) -> tuple[str, list[Point]]:
    """('path' | 'search_truncated' | 'impossible', points): the shortest way round the convex hulls of the obstacles,
    each moved outwards by ``inflate``."""
    hulls = [h for h in (offset_convex(convex_hull(o), inflate) for o in obstacles) if h]
    nodes = [start, goal, *(p for h in hulls for p in h)]
    if len(nodes) > (most_nodes or (NODES_SINGLE if len(hulls) <= 1 else NODES_MULTI)):
        return "search_truncated", []
    edges: dict[int, list[tuple[int, float]]] = {}
    for i, j in combinations(range(len(nodes)), 2):
        if not any(passes_convex(nodes[i], nodes[j], h) for h in hulls):
            w = math.dist(nodes[i], nodes[j])
            edges.setdefault(i, []).append((j, w))
            edges.setdefault(j, []).append((i, w))
    found = shortest(len(nodes), edges, 0, 1)
    return ("path", [nodes[i] for i in found]) if found else ("impossible", [])


def all_pass_convex(a: np.ndarray, b: np.ndarray, poly: list[Point], eps: float = 1e-9) -> np.ndarray:
    """``passes_convex`` of each of many segments, from the rows of ``a`` to those of ``b``."""
    if len(poly) < 3:
        return np.zeros(len(a), bool)
    v = np.asarray(poly, float)
    edge = np.roll(v, -1, axis=0) - v
    depth = edge[:, 0] * (a[:, 1:] - v[:, 1]) - edge[:, 1] * (a[:, :1] - v[:, 0])
    gain = edge[:, 0] * (b - a)[:, 1:] - edge[:, 1] * (b - a)[:, :1]
    flat = np.abs(gain) < 1e-15
    at = (eps - depth) / np.where(flat, 1.0, gain)
    enters = np.where(~flat & (gain > 0), at, 0.0).max(axis=1)
    leaves = np.where(~flat & (gain < 0), at, 1.0).min(axis=1)
    return ~(flat & (depth < eps)).any(axis=1) & (np.maximum(enters, 0.0) <= np.minimum(leaves, 1.0) + 1e-12)


class Sights:
    """``visibility_path`` of many legs round the same obstacles: hulls, and what sees what among their vertices, are worked
    out once, and all legs' ends are held against each hull together."""

    def __init__(self, obstacles: list[list[Point]], inflate: float, most_nodes: int | None = None):
        self.hulls = [h for h in (offset_convex(convex_hull(o), inflate) for o in obstacles) if h]
        self.nodes = [p for h in self.hulls for p in h]
        self.truncated = 2 + len(self.nodes) > (most_nodes or (NODES_SINGLE if len(self.hulls) <= 1 else NODES_MULTI))
        self.fixed: dict[int, list[tuple[int, float]]] = {}
        for i, j in () if self.truncated else combinations(range(len(self.nodes)), 2):
            if not any(passes_convex(self.nodes[i], self.nodes[j], h) for h in self.hulls):
                w = math.dist(self.nodes[i], self.nodes[j])
                self.fixed.setdefault(i + 2, []).append((j + 2, w))
                self.fixed.setdefault(j + 2, []).append((i + 2, w))

    def _clear(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        blocked = np.zeros(len(a), bool)
        for h in self.hulls:
            blocked |= all_pass_convex(a, b, h)
        return ~blocked

    def paths(self, starts: np.ndarray, goals: np.ndarray) -> list[tuple[str, list[Point]]]:
        if self.truncated:
            return [("search_truncated", [])] * len(starts)
        direct = self._clear(starts, goals).tolist()
        seen = [np.column_stack([self._clear(ends, np.broadcast_to(p, ends.shape)) for p in self.nodes]).tolist() if self.nodes else [[]] * len(ends) for ends in (starts, goals)]
        out = []
        for s, g, open_, *sights in zip(map(tuple, starts.tolist()), map(tuple, goals.tolist()), direct, *seen):
            edges = {k: list(v) for k, v in self.fixed.items()}
            if open_:
                edges[0], edges[1] = [(1, math.dist(s, g))], [(0, math.dist(s, g))]
            for no, (end, sight) in enumerate(zip((s, g), sights)):
                for k in (k for k, v in enumerate(sight) if v):
                    w = math.dist(end, self.nodes[k])
                    edges.setdefault(no, []).append((k + 2, w))
                    edges.setdefault(k + 2, []).append((no, w))
            nodes = [s, g, *self.nodes]
            found = shortest(len(nodes), edges, 0, 1)
            out.append(("path", [nodes[i] for i in found]) if found else ("impossible", []))
        return out


def arc_points(centre: Point, r: float, a0: float, a1: float, step: float) -> list[Point]:
    n = max(1, math.ceil(abs(a1 - a0) / step))
    return [(centre[0] + r * math.cos(a0 + (a1 - a0) * i / n), centre[1] + r * math.sin(a0 + (a1 - a0) * i / n)) for i in range(n + 1)]


# --- Dubins paths ------------------------------------------------------------------------------------------------


def _turn(a: float) -> float:
    return a % (2 * math.pi)


def dubins(start: tuple[float, float, float], goal: tuple[float, float, float], r: float) -> tuple[str, tuple[float, float, float]] | None:
    """The shortest word (such as LSR) and its three lengths in radii, between poses (x, y, angle east to north).

    All six words are tried in the frame where the start is at the origin and the goal on the x axis.
    """
    if r <= 0 or not all(map(math.isfinite, (*start, *goal, r))):
        return None
    dx, dy = (goal[0] - start[0]) / r, (goal[1] - start[1]) / r
    d, theta = math.hypot(dx, dy), math.atan2(dy, dx)
    a, b = _turn(start[2] - theta), _turn(goal[2] - theta)
    sa, sb, ca, cb, cab = math.sin(a), math.sin(b), math.cos(a), math.cos(b), math.cos(a - b)
    found = []

    def add(word: str, t: float, p: float, q: float) -> None:
        found.append((t + p + q, word, (t, p, q)))

    for side, name in ((1, "LSL"), (-1, "RSR")):
        p2 = 2 + d * d - 2 * cab + side * 2 * d * (sa - sb)
        if p2 >= 0:
            heading = math.atan2(side * (cb - ca), d + side * (sa - sb))
            add(name, _turn(side * (heading - a)), math.sqrt(p2), _turn(side * (b - heading)))
    for side, name in ((1, "LSR"), (-1, "RSL")):
        p2 = d * d - 2 + 2 * cab + side * 2 * d * (sa + sb)
        if p2 >= 0:
            p = math.sqrt(p2)
            heading = math.atan2(-side * (ca + cb), d + side * (sa + sb)) - math.atan2(-side * 2.0, p)
            add(name, _turn(side * (heading - a)), p, _turn(side * (heading - b)))
    for side, name in ((1, "LRL"), (-1, "RLR")):
        cos_p = (6 - d * d + 2 * cab + side * 2 * d * (sb - sa)) / 8
        if abs(cos_p) <= 1:
            p = _turn(2 * math.pi - math.acos(cos_p))
            heading = math.atan2(side * (cb - ca), d + side * (sa - sb)) if side == 1 else math.atan2(ca - cb, d - sa + sb)
            t = _turn(side * (heading - a) + p / 2)
            add(name, t, p, _turn(side * (b - a) - t + p))
    return min(found)[1:] if found else None


def dubins_sample(start, word: str, parts, r: float, step: float) -> list[tuple[float, float, float]]:
    """Poses along a path every ``step`` at most, ends included."""
    x, y, a = start
    out = [(x, y, a)]
    for kind, length in zip(word, parts):
        n = max(1, math.ceil(length * r / step))
        x0, y0, a0 = x, y, a
        for i in range(1, n + 1):
            s = length * i / n
            if kind == "S":
                x, y, a = x0 + s * r * math.cos(a0), y0 + s * r * math.sin(a0), a0
            else:
                k = 1 if kind == "L" else -1
                a = a0 + k * s
                x, y = x0 + k * r * (math.sin(a) - math.sin(a0)), y0 - k * r * (math.cos(a) - math.cos(a0))
            out.append((x, y, _turn(a)))
    return out


# --- paths: arrays of (lon, lat, alt) ---------------------------------------------------------------------------


def chord_errors(p: np.ndarray, i: int, j: int) -> np.ndarray:
    """Metres from the points between ``i`` and ``j`` to the segment that joins these."""
    k = max(math.cos(math.radians((p[i, 1] + p[j, 1]) / 2)), 1e-6)
    q = p[:, :2] * (k, 1.0)
    a, v = q[i], q[j] - q[i]
    w, l2 = q[i + 1 : j] - a, float(v @ v)
    t = np.clip(w @ v / l2, 0, 1) if l2 > 0 else np.zeros(len(w))
    return np.hypot(*(w - t[:, None] * v).T) * DEG_M


def _sight(p: np.ndarray, i: int, j: int, tolerance_m: float) -> np.ndarray:
    """Points in (i, j) that may end a chord from ``i``: those in the wedge that the points before leave open, and not
    nearer than these. None is left out that could; chords are judged afterwards."""
    k = np.cos(np.radians(p[i : j + 1, 1]))
    wide = max(float(k.max()), 1e-6) / max(float(k.min()), 1e-6)  # how much the scale of longitudes changes
    v = (p[i + 1 : j + 1, :2] - p[i, :2]) * (max(float(k[0]), 1e-6), 1.0) * DEG_M
    d, slack = np.hypot(v[:, 0], v[:, 1]), tolerance_m * wide + 1e-6
    far = d > 2 * slack
    ok = np.maximum.accumulate(d) <= (d + slack) * wide + 1e-6
    if far.any():
        first = int(np.argmax(far))
        angle = np.arctan2(v[:, 1], v[:, 0])
        angle = (angle - angle[first] + math.pi) % (2 * math.pi) - math.pi
        half = np.where(far, np.arcsin(np.minimum(slack / np.maximum(d, 1e-12), 1.0)) + (wide - 1), math.pi)
        low, high = np.maximum.accumulate(np.where(far, angle - half, -math.pi)), np.minimum.accumulate(np.where(far, angle + half, math.pi))
        sure = (np.abs(angle) < math.pi / 2) | ~far  # beyond that the wedge says nothing
        inside = (angle >= low - half) & (angle <= high + half)
        closed = np.flatnonzero(low > high + 2 * (wide - 1) + 1e-9)
        ok &= inside | ~sure
        if len(closed) and (far[closed[0] :]).all():
            ok[closed[0] :] = False
    return np.flatnonzero(ok) + i + 1


#: Points up to which a path is simplified on floats: small arrays cost more than what they hold.
SHORT = 12


def _chord_passes(x: list[float], y: list[float], i: int, j: int, tolerance_m: float) -> bool:
    """``chord_errors`` within the tolerance, on floats."""
    k = max(math.cos(math.radians((y[i] + y[j]) / 2)), 1e-6)
    ax, ay = x[i] * k, y[i]
    vx, vy = x[j] * k - ax, y[j] - ay
    l2 = vx * vx + vy * vy
    for m in range(i + 1, j):
        wx, wy = x[m] * k - ax, y[m] - ay
        t = min(max((wx * vx + wy * vy) / l2, 0.0), 1.0) if l2 > 0 else 0.0
        if not math.hypot(wx - t * vx, wy - t * vy) * DEG_M <= tolerance_m:
            return False
    return True


def simplify(p: np.ndarray, tolerance_m: float) -> list[int]:
    """Kept points: from each one the furthest whose chord passes all between within the tolerance.

    Ends are looked for in stretches of doubling length and given up once a stretch has none that may be in sight."""
    n = len(p)
    keep = [0] if n else []
    if n <= SHORT:
        x, y = p[:, 0].tolist(), p[:, 1].tolist()
        while keep and keep[-1] < n - 1:
            i = keep[-1]
            keep.append(next(j for j in range(n - 1, i, -1) if j == i + 1 or _chord_passes(x, y, i, j, tolerance_m)))
        return keep
    while keep and keep[-1] < n - 1:
        i = keep[-1]
        best, reach, seen = i + 1, 32, i + 1
        while seen < n - 1:
            end = min(n - 1, i + reach)
            ends = _sight(p, i, end, tolerance_m)
            found = next((j for j in ends[::-1].tolist() if j > seen and chord_errors(p, i, j).max() <= tolerance_m), None)
            best = found or best
            if not (ends > seen).any():
                break
            seen, reach = end, reach * 2
        keep.append(best)
    return keep


def shortcut(p, clear) -> list[int]:
    """Any-angle shortcuts: from each kept point the furthest one in clear sight; ``clear(a, b)`` judges a segment."""
    n = len(p)
    keep = [0] if n else []
    while keep and keep[-1] < n - 1:
        i = keep[-1]
        keep.append(next(j for j in range(n - 1, i, -1) if j == i + 1 or clear(p[i], p[j])))
    return keep


def grade_limit(along: np.ndarray, alt: np.ndarray, floor: np.ndarray, max_climb_deg: float, rounds: int = 64) -> np.ndarray:
    """Altitudes raised until no step climbs or falls steeper than the limit and none is below its floor: the least such
    profile above both, reached by passes forward and back until nothing changes."""
    out, along = np.maximum(alt, floor).tolist(), np.asarray(along, float).tolist()
    slope = math.tan(math.radians(max_climb_deg))
    for _ in range(rounds):
        before = out.copy()
        for i in range(len(out) - 2, -1, -1):
            out[i] = max(out[i], out[i + 1] - slope * (along[i + 1] - along[i]))
        for i in range(1, len(out)):
            out[i] = max(out[i], out[i - 1] - slope * (along[i] - along[i - 1]))
        if before == out:
            break
    return np.array(out, float)


def fillet(a: Point, b: Point, c: Point, r: float, step: float) -> list[Point]:
    """Points that replace corner ``b``: an arc of radius ``r`` (or the largest that fits) tangent to both sides."""
    # On floats, not arrays: a path has many corners of two numbers each. The absolute of a complex number is C's hypot.
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    lu, lv = abs(complex(ux, uy)), abs(complex(vx, vy))
    if lu == 0 or lv == 0:
        return [b]
    ux, uy, vx, vy = ux / lu, uy / lu, vx / lv, vy / lv
    angle = math.acos(max(-1.0, min(1.0, ux * vx + uy * vy)))
    if angle > math.pi - 1e-6 or angle < 1e-6:
        return [b]
    cut = min(r / math.tan(angle / 2), lu / 2, lv / 2)
    r = cut * math.tan(angle / 2)
    mx, my = ux + vx, uy + vy
    lm = abs(complex(mx, my))
    x, y = bx + mx / lm * r / math.sin(angle / 2), by + my / lm * r / math.sin(angle / 2)
    a0, a1 = math.atan2(by + uy * cut - y, bx + ux * cut - x), math.atan2(by + vy * cut - y, bx + vx * cut - x)
    turn = (a1 - a0 + math.pi) % (2 * math.pi) - math.pi
    return arc_points((x, y), r, a0, a0 + turn, max(step / r, 1e-3))


def push_out(p: np.ndarray, polygon: list[Point], by: float, rounds: int = 8) -> np.ndarray:
    """Points inside a polygon moved to its nearest boundary point and ``by`` beyond; repeated while any is inside."""
    out = p.copy()
    e = np.array([(*a, *b) for a, b in zip(polygon, polygon[1:] + polygon[:1])])
    for _ in range(rounds):
        moved = False
        for i, (x, y) in enumerate(out[:, :2]):
            cross = ((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / np.where(e[:, 3] == e[:, 1], 1, e[:, 3] - e[:, 1]) + e[:, 0])
            if cross.sum() % 2 == 0:
                continue
            v = e[:, 2:] - e[:, :2]
            t = np.clip(((x - e[:, 0]) * v[:, 0] + (y - e[:, 1]) * v[:, 1]) / np.maximum((v**2).sum(1), 1e-300), 0, 1)
            q = e[:, :2] + t[:, None] * v
            k = int(np.argmin(np.hypot(q[:, 0] - x, q[:, 1] - y)))
            way = q[k] - (x, y)
            size = float(np.hypot(*way))
            if size < 1e-12:  # on the boundary: straight away from the edge
                way, size = np.array([v[k, 1], -v[k, 0]]), float(np.hypot(*v[k])) or 1.0
            out[i, :2] = q[k] + way / size * by
            moved = True
        if not moved:
            break
    return out


def vincenty_m(lon1, lat1, lon2, lat2, a: float = 6_378_137.0, f: float = 1 / 298.257223563) -> np.ndarray:
    """Ellipsoidal distance by Vincenty's inverse series; near-antipodal pairs that do not settle get the sphere's."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    b = a * (1 - f)
    u1, u2, big = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = big.copy(), np.zeros(big.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sin_alpha = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0)
            cos2 = 1 - sin_alpha**2
            c2m = np.where(cos2 > 1e-15, cs - 2 * s1 * s2 / np.where(cos2 > 1e-15, cos2, 1), 0)
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = big + (1 - k) * f * sin_alpha * (sigma + k * ss * (c2m + k * cs * (2 * c2m**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        w = cos2 * (a * a - b * b) / (b * b)
        A = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
        B = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
        turn = B * ss * (c2m + B / 4 * (cs * (2 * c2m**2 - 1) - B / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        sphere = 2 * EARTH * np.arcsin(np.sqrt(np.clip(np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(big / 2) ** 2, 0, 1)))
        return np.where(settled, np.where(ss == 0, np.where(cs > 0, 0.0, sphere), b * A * (sigma - turn)), sphere)
