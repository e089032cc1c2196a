"""Frames by contour: edge enhancement, outer contours of a mask, and scores of their shapes.

Kernels over one gray picture (float array); ``pictures.measured`` runs them over rows of pictures.
"""

from __future__ import annotations

import numpy as np

from .kernels import bordered, canny, dilate, sobel

#: Steps to the eight neighbours (y, x), clockwise from the right.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]

#: The next step of a walk along a boundary, by the last one and by the neighbours that are there.
NEXT = [[next((k for d in range(8) if bits >> (k := (d + way + 5) % 8) & 1), None) for bits in range(256)] for way in range(8)]


def bilateral(gray: np.ndarray, size: int = 9, tone: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Mean of a disc's pixels, weighted by how near they are in place and in tone."""
    r, (h, w) = size // 2, gray.shape
    p = bordered(gray, r, "reflect" if min(h, w) > r else "edge")
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    levels = np.arange(-255.0, 256.0)
    whole = p.min() >= 0 and p.max() <= 255 and not (p % 1).any()  # differences of bytes: their weights come from a table
    steps, tables = p.astype(np.intp) if whole else p, {}
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if (far := dy * dy + dx * dx) <= r * r:
                there = p[r + dy : r + dy + h, r + dx : r + dx + w]
                if whole:
                    if far not in tables:
                        tables[far] = np.exp(-far / (2 * space**2) - levels**2 / (2 * tone**2))
                    k = tables[far].take(steps[r + dy : r + dy + h, r + dx : r + dx + w] - steps[r : r + h, r : r + w] + 255)
                else:
                    k = np.exp(-far / (2 * space**2) - (there - gray) ** 2 / (2 * tone**2))
                total += k * there
                weight += k
    return np.rint(total / weight)


def local_equalised(gray: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Histogram equalisation by tile with clipped bins, blended between the four nearest tiles."""
    h, w = gray.shape
    p = np.pad(gray, ((0, -h % grid), (0, -w % grid)), mode="reflect" if min(h, w) > grid else "edge").astype(int)
    th, tw = p.shape[0] // grid, p.shape[1] // grid
    tiles = p.reshape(grid, th, grid, tw).transpose(0, 2, 1, 3).reshape(grid * grid, -1)
    hist = np.stack([np.bincount(t, minlength=256) for t in tiles])
    most = max(1, int(clip * tiles.shape[1] / 256))
    over = np.maximum(hist - most, 0).sum(1, keepdims=True)
    table = np.rint(np.minimum(np.cumsum(np.minimum(hist, most) + over / 256, axis=1) * 255 / tiles.shape[1], 255)).reshape(grid, grid, 256)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    ya, yb, xa, xb = (np.clip(v, 0, grid - 1) for v in (y0, y0 + 1, x0, x0 + 1))
    g = gray.astype(int)

    def at(r, c):
        return table[r[:, None], c[None, :], g]

    return np.rint((at(ya, xa) * (1 - fx) + at(ya, xb) * fx) * (1 - fy) + (at(yb, xa) * (1 - fx) + at(yb, xb) * fx) * fy)


def greatest_near(gray: np.ndarray) -> np.ndarray:
    """The largest value of each 3 by 3 neighbourhood."""
    p = bordered(gray, 1, "edge")
    h, w = gray.shape
    return np.max([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)


def enhanced_edges(gray: np.ndarray, block: int = 11, less: float = 2.0) -> np.ndarray:
    """Mask of edges of a smoothed, equalised picture: morphological and Sobel gradient, against their local mean."""
    g = local_equalised(bilateral(gray))
    slope = np.hypot(*sobel(g))
    mixed = np.clip(np.rint(0.7 * (greatest_near(g) + greatest_near(-g)) + 0.3 * np.floor(slope / (slope.max() or 1.0) * 255)), 0, 255)
    r, sigma = block // 2, 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = bordered(mixed, r, "edge")
    (h, w) = gray.shape
    rows = sum(k[i] * p[i : i + h] for i in range(block))
    local = np.rint(sum(k[j] * rows[:, j : j + w] for j in range(block)))
    mask = dilate(mixed > local - less, 3)
    return ~dilate(~mask, 3)


def labelled(mask: np.ndarray, eight: bool) -> np.ndarray:
    """The smallest place of each pixel's component of ``mask`` (eight or four neighbours); -1 outside it.

    Runs of pixels are joined, not pixels: those of the next row that a run reaches follow one another.
    """
    h, w = mask.shape
    ends = np.zeros((h, w + 2), np.int8)
    ends[:, 1:-1] = mask
    turn = np.diff(ends, axis=1).ravel()  # w + 1 places a row: a run's first pixel, and the one after its last
    first, after = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out = np.full(mask.shape, -1)
    if not len(first):
        return out
    row, reach = first // (w + 1), 1 if eight else 0
    # keys that leave room between rows for what reaches over their ends
    key0, key1 = first + 2 * row, after - 1 + 2 * row
    low, high = np.searchsorted(key1, key0 + (w + 3) - reach), np.searchsorted(key0, key1 + (w + 3) + reach, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(first)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(first))
    while (open_ := label[a] != label[b]).any():
        a, b = a[open_], b[open_]
        upper, lower = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        np.minimum.at(label, upper, lower)
        while not np.array_equal(label, near := label[label]):
            label = near
    out[mask] = np.repeat((first - row)[label], after - first)
    return out


def boxes_of(part: np.ndarray, names: np.ndarray) -> np.ndarray:
    """(y0, y1, x0, x1) of each named component, the ends included."""
    y, x = np.nonzero(np.isin(part, names))
    which = np.searchsorted(names, part[y, x])
    out = np.column_stack([np.full(len(names), part.shape[0]), np.zeros(len(names), int), np.full(len(names), part.shape[1]), np.zeros(len(names), int)])
    for k, (f, v) in enumerate(((np.minimum, y), (np.maximum, y), (np.minimum, x), (np.maximum, x))):
        f.at(out[:, k], which, v)
    return out


def traced(mine: np.ndarray, y: int, x: int) -> np.ndarray:
    """The outer boundary of a component, as (x, y), from its first pixel; ``mine`` has a rim without pixels."""
    h, w = mine.shape
    around = np.zeros((h, w), np.uint8)  # which of the eight neighbours are there, a bit each
    for k, (dy, dx) in enumerate(AROUND):
        around[1:-1, 1:-1] |= mine[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx].astype(np.uint8) << k
    bits, steps = around.ravel().tolist(), [dy * w + dx for dy, dx in AROUND]
    at = begin = y * w + x
    points, way, first = [at], 0, None
    while True:
        step = NEXT[way][bits[at]]
        if step is None or (at == begin and step == first):
            places = np.array(points[:-1] or points)
            return np.column_stack([places % w, places // w])
        first = step if first is None else first
        at, way = at + steps[step], step
        points.append(at)


def outer_contours(mask: np.ndarray, enough: float = 0.0, fill: bool = True) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(points, filled) of each component that no other encloses: its outer boundary as (x, y), and its pixels with all it encloses.

    Components whose box has fewer than ``enough`` pixels are left out once a contour of a larger area is known, since a
    contour's area is within its box: the largest contour is always among those found. Without ``fill`` ``filled`` is none.
    """
    m = bordered(mask, 1)
    part, back = labelled(m, True), labelled(~m, False)
    outside = back == 0  # the padding's corner
    beside = np.zeros(m.shape, bool)
    beside[1:-1, 1:-1] = mask & (outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:])
    names = np.unique(part[beside])
    if not len(names):
        return []
    boxes = boxes_of(part, names)
    area = (boxes[:, 1] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 2] + 1)
    found, largest = [], -1.0
    for k in np.argsort(-area, kind="stable"):
        if area[k] < enough and area[k] <= largest:
            break
        y0, y1, x0, x1 = boxes[k].tolist()
        mine = bordered(part[y0 : y1 + 1, x0 : x1 + 1] == names[k], 1)
        y, x = divmod(int(names[k]), m.shape[1])
        points = traced(mine, y - y0 + 1, x - x0 + 1) + np.array([x0 - 2, y0 - 2])
        filled = None
        if fill:
            filled = np.zeros(mask.shape, bool)
            filled[y0 - 1 : y1, x0 - 1 : x1] = (labelled(~mine, False) != 0)[1:-1, 1:-1]
        largest = max(largest, area_of(points)[0])
        found.append((int(names[k]), points, filled))
    return [c[1:] for c in sorted(found, key=lambda c: c[0])]


def area_of(points: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Area of a polygon and its centre."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    twice = cross.sum()
    if not twice:
        return 0.0, (float(x.mean()), float(y.mean()))
    return abs(twice) / 2, (float(((x + nx) * cross).sum() / (3 * twice)), float(((y + ny) * cross).sum() / (3 * twice)))


def length_of(points: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum())


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed line that keep it within ``tolerance``."""

    def between(a: int, b: int) -> list[int]:
        ring, found, open_ = len(points), [], [(a, b)]
        while open_:  # a stack, as a contour may have thousands of points
            a, b = open_.pop()
            line = points[np.arange(a, b + 1) % ring]
            along, rel = (line[-1] - line[0]).astype(float), (line - line[0]).astype(float)
            norm = np.hypot(*along)
            away = np.abs(along[0] * rel[:, 1] - along[1] * rel[:, 0]) / norm if norm else np.hypot(*rel.T)
            k = int(away.argmax())
            if away[k] > tolerance and 0 < k < b - a:
                found.append(a + k)
                open_ += [(a, a + k), (a + k, b)]
        return found

    at = 0
    for _ in range(3):  # two corners that lie far apart
        far = int(np.hypot(*(points - points[at]).T).argmax())
        at, other = far, at
    a, b = sorted((at, other))
    if a == b:
        return points[:1]
    corners = sorted({k % len(points) for k in [a, *between(a, b), b, *between(b, a + len(points))]})
    return points[corners]


def least_rectangle(points: np.ndarray) -> tuple[float, float, float, tuple[float, float]]:
    """Sides, angle in degrees and centre of the smallest rectangle, turned as needed, that holds the points."""
    best = None
    steps = np.roll(points, -1, axis=0) - points
    for angle in np.unique(np.arctan2(steps[:, 1], steps[:, 0]) % (np.pi / 2)):
        c, s = np.cos(angle), np.sin(angle)
        u, v = points[:, 0] * c + points[:, 1] * s, points[:, 1] * c - points[:, 0] * s
        w, h = np.ptp(u), np.ptp(v)
        if best is None or w * h < best[0]:
            mu, mv = (u.max() + u.min()) / 2, (v.max() + v.min()) / 2
            best = w * h, float(w), float(h), float(np.degrees(angle)), (float(mu * c - mv * s), float(mu * s + mv * c))
    return best[1:]


def frame_contour(contours: list[tuple[np.ndarray, np.ndarray]], height: int, width: int, perimeter: np.ndarray | None = None, least: float = 0.1, most: float = 0.9, bar: float = 0.5) -> dict:
    """The best frame among the five largest contours of a fitting size: like a rectangle, along the perimeter, centred.

    ``perimeter``: mask of which a contour's inside must share 60 %; none: everywhere.
    """
    sized = sorted(((area_of(p), p, f) for p, f in contours), key=lambda c: -c[0][0])
    best = 0.0
    for (area, centre), points, filled in [c for c in sized if least * height * width <= c[0][0] <= most * height * width][:5]:
        around = length_of(points)
        corners = len(simplified(points, 0.02 * around))
        overlap = 1.0 if perimeter is None else float((filled & perimeter).sum() / max(1, filled.sum()))
        if overlap < 0.6 or not 4 <= corners <= 12:
            continue
        a, b, _, _ = least_rectangle(points)
        aspect = 1 - min(1.0, abs(np.log(max(a / max(b, 1e-6), 1e-6))) / 2)
        centred = 1 - np.hypot(int(centre[0]) - width / 2, int(centre[1]) - height / 2) / np.hypot(width / 2, height / 2)
        ratio = area / (height * width)
        score = 0.25 * (1 - 4 * np.pi * area / around**2) + 0.25 * overlap + 0.20 * centred + 0.15 * aspect + 0.15 * min(1.0, ratio * 4)
        best = max(best, float(score * (1.1 if 0.15 <= ratio <= 0.85 else 1.0)))
    return {"frame": best > bar, "frame_score": best}


def quadrilateral(points: np.ndarray, height: int, width: int) -> dict:
    """How much a contour's smallest rectangle is like the picture: centred, aligned, of its proportions, filled."""
    a, b, angle, (cx, cy) = least_rectangle(points)
    long_, short = max(a, b), min(a, b)
    centred = 1 - min(1.0, (abs(cx - width / 2) / (width / 2) + abs(cy - height / 2) / (height / 2)) / 2)
    aligned = 1 - min(1.0, min(angle % 90, 90 - angle % 90) / 45)
    alike = 1 - min(1.0, abs((short / long_ if long_ else 0.0) - min(height, width) / max(height, width)) * 5)
    full = min(1.0, area_of(points)[0] / (a * b) * 1.5) if a * b else 0.0
    score = 0.35 * centred + 0.25 * aligned + 0.20 * alike + 0.20 * full
    return {"quad": score > 0.7, "quad_score": float(score)}


def frame_boxes(gray: np.ndarray, edges: np.ndarray | None = None) -> list[dict]:
    """Bounding boxes of edge contours of more than a tenth of the picture that come near its perimeter."""
    h, w = gray.shape
    margin, out = min(w, h) * 0.05, []
    for points, _ in outer_contours(canny(gray) if edges is None else edges, 0.1 * gray.size, fill=False):
        if area_of(points)[0] > h * w * 0.1:
            (x, y), (x1, y1) = points.min(0), points.max(0) + 1
            if x < margin or y < margin or x1 > w - margin or y1 > h - margin:
                out.append({"x": int(x), "y": int(y), "w": int(x1 - x), "h": int(y1 - y)})
    return out


FEATURES = "frame boolean, frame_score double, quad boolean, quad_score double, boxes array<struct<x: int, y: int, w: int, h: int>>, edge_share double"


def features(gray: np.ndarray, lines: np.ndarray | None = None) -> dict:
    """The FEATURES of one picture; under 16 by 16 pixels nulls and no boxes. ``quad`` is that of the largest contour.

    ``lines``: the edges of ``canny``, if they are known.
    """
    if min(gray.shape) < 16:
        return {"frame": None, "frame_score": None, "quad": None, "quad_score": None, "boxes": [], "edge_share": None}
    edges = enhanced_edges(gray)
    found = outer_contours(edges, 0.1 * gray.size, fill=False)
    row = {"quad": None, "quad_score": None} | frame_contour(found, *gray.shape) | {"boxes": frame_boxes(gray, lines), "edge_share": float(edges.mean())}
    return row | quadrilateral(max(found, key=lambda c: area_of(c[0])[0])[0], *gray.shape) if found else row
