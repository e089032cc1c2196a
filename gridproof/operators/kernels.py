"""Numeric picture kernels that DataFrame functions can't express: convolutions, median, Fourier bands.

Each takes one gray picture; ``pictures.measured`` runs them over rows of pictures. Whole numbers stay 32-bit integers and
kernels are taken apart into rows and columns. Edges are mirrored without repeating the edge pixel.
"""

from __future__ import annotations

import numpy as np


def bordered(x: np.ndarray, r: int, way: str = "constant") -> np.ndarray:
    """As ``np.pad`` by ``r`` on every side (constant: zeros; edge; reflect, of sides over ``r``), which takes longer than a small kernel does."""
    h, w = x.shape
    out = np.zeros((h + 2 * r, w + 2 * r), x.dtype)
    out[r : r + h, r : r + w] = x
    if way != "constant":
        for k in range(r):
            far = k + 1 if way == "reflect" else 0
            out[r - 1 - k, r : r + w], out[r + h + k, r : r + w] = x[far if h > 1 else 0], x[h - 1 - far if h > 1 else 0]
        for k in range(r):
            far = k + 1 if way == "reflect" and w > 1 else 0
            out[:, r - 1 - k], out[:, r + w + k] = out[:, r + far], out[:, r + w - 1 - far]
    return out


def padded(gray: np.ndarray, r: int = 1) -> np.ndarray:
    return bordered(gray if gray.dtype.kind == "f" else gray.astype(np.int32, copy=False), r, "reflect")


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = padded(gray)
    step, level = p[:, 2:] - p[:, :-2], p[:, 2:] + p[:, :-2] + 2 * p[:, 1:-1]
    return step[2:] + step[:-2] + 2 * step[1:-1], level[2:] - level[:-2]


def slopes(gray: np.ndarray) -> np.ndarray:
    """The length of the gradient; of whole numbers by one correctly rounded root."""
    gx, gy = sobel(gray)
    return np.sqrt((gx * gx + gy * gy).astype(np.float64))


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = padded(gray)
    return p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * p[1:-1, 1:-1]


def high_pass(gray: np.ndarray) -> np.ndarray:
    """Eight times each pixel less the eight around it."""
    p = padded(gray)
    rows = p[2:] + p[:-2] + p[1:-1]
    return 9 * p[1:-1, 1:-1] - (rows[:, 2:] + rows[:, :-2] + rows[:, 1:-1])


def variance(x: np.ndarray) -> float:
    """Of all values; of whole numbers from their exact sums."""
    if x.dtype.kind == "f":
        return float(x.var())
    n, s, q = x.size, int(x.sum(dtype=np.int64)), int(np.einsum("ij,ij->", x, x, dtype=np.int64, casting="unsafe"))
    return (n * q - s * s) / (n * n)


def canny(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: gradient maxima along the gradient's direction above ``high``, and those above ``low`` joined to them."""
    gx, gy = sobel(gray)
    ax, ay = np.abs(gx), np.abs(gy)
    size = ax + ay
    p = bordered(size, 1)
    h, w = size.shape
    flat, steep = ay <= (np.sqrt(2) - 1) * ax, ay > (np.sqrt(2) + 1) * ax  # within an eighth of a turn of the axes
    rising = ((gx > 0) == (gy > 0)) & ~flat & ~steep
    peak = np.zeros(size.shape, bool)
    for turn, (dy, dx) in ((flat, (0, 1)), (rising, (1, 1)), (steep, (1, 0)), (~(flat | rising | steep), (1, -1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        peak |= turn & (size > behind) & (size >= ahead)
    edge, open_ = bordered(peak & (size > high), 1), bordered(peak & (size > low), 1)
    open_ &= ~edge
    at = np.flatnonzero(edge)
    around = np.array([dy * (w + 2) + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    edge_, open_ = edge.ravel(), open_.ravel()
    while len(at):  # only what was reached last grows on
        near = (at[:, None] + around).ravel()
        at = np.unique(near[open_[near]])
        edge_[at], open_[at] = True, False
    return edge_.reshape(h + 2, w + 2)[1:-1, 1:-1]


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = bordered(mask, r)
    h, w = mask.shape
    rows = np.logical_or.reduce([p[i : i + h] for i in range(size)])
    return np.logical_or.reduce([rows[:, j : j + w] for j in range(size)])


def edge_features(gray: np.ndarray, edges: np.ndarray | None = None) -> dict[str, float]:
    """Laplacian variance, share of edge pixels, deviation of the gradient, variance beside edges, high-pass variance."""
    edges = canny(gray) if edges is None else edges
    near = dilate(edges, 9)  # a square of five about each edge pixel, twice
    return {
        "laplacian_variance": variance(laplacian(gray)),
        "edge_density": float(edges.mean()),
        "edge_contrast": float(slopes(gray).std()),
        "halo_variance": float(gray[near].var()) if near.any() else 0.0,
        "high_freq_energy": variance(high_pass(gray)),
    }


def frequency_features(gray: np.ndarray) -> dict[str, float]:
    """Shares of spectral power in three rings around zero frequency, the variance of its logarithm, and the total.

    A real picture's spectrum is symmetric: half of it is transformed, and what has a mirror image counts twice.
    """
    (h, w), far = gray.shape, min(gray.shape) // 2
    mag = np.abs(np.fft.rfft2(gray))
    twice = np.full(mag.shape[1], 2.0)
    twice[0] = 1
    if w % 2 == 0:
        twice[-1] = 1
    power = mag**2 * twice
    y = np.arange(h)
    r2 = (np.minimum(y, h - y).astype(np.int64) ** 2)[:, None] + np.arange(mag.shape[1], dtype=np.int64) ** 2
    low, mid = r2 <= (0.3 * far) ** 2, r2 <= (0.7 * far) ** 2
    whole, inner, middle = float(power.sum()), float(power[low].sum()), float(power[mid].sum())
    total = whole or 1.0
    logs = np.log(mag + 1)
    n = h * w
    mean = float((logs * twice).sum()) / n
    return {"low_freq": inner / total, "mid_freq": (middle - inner) / total, "high_freq": float(power[~mid].sum()) / total, "frequency_variance": float(((logs - mean) ** 2 * twice).sum()) / n, "total_energy": whole}


#: The exchanges that put the middle one of nine values at the fifth place. Fixed values.
MIDDLE_OF_NINE = [(1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2)]


def median3(gray: np.ndarray) -> np.ndarray:
    """The median of 3 by 3 bytes, edge pixels repeated."""
    p = bordered(gray.astype(np.uint8), 1, "edge")
    h, w = gray.shape
    v = [p[i : i + h, j : j + w] for i in range(3) for j in range(3)]
    for a, b in MIDDLE_OF_NINE:
        v[a], v[b] = np.minimum(v[a], v[b]), np.maximum(v[a], v[b])
    return v[4]


def noise_deviation(gray: np.ndarray) -> float:
    """Deviation of the picture less its 3 by 3 median, in bytes that wrap around."""
    return float(np.sqrt(variance((gray.astype(np.uint8) - median3(gray)).astype(np.int32))))


#: Ratios above this are shown as this: a flat middle has no ratio.
FLAT_RATIO = 1e6


def texture_frame(gray: np.ndarray, share: float = 0.15, least: float = 1.8) -> dict[str, float | bool]:
    """Whether the gradient varies more in the four strips at the sides than in the middle; each is a picture of its own.

    A variance under 1e-9 is what rounding leaves of none; the ratio to a middle without any is FLAT_RATIO at most.
    """
    (h, w), b = gray.shape, int(min(gray.shape) * share)

    def rough(part: np.ndarray) -> float:
        v = float(slopes(part).var()) if min(part.shape) > 1 else 0.0
        return v if v >= 1e-9 else 0.0

    strips = [gray[:b], gray[h - b :], gray[:, :b], gray[:, w - b :]] if b else []
    ratio = float(np.mean([rough(s) for s in strips]) if strips else 0.0) / (rough(gray[b : h - b, b : w - b]) + 1e-10)
    ratio = min(ratio, FLAT_RATIO)
    return {"texture_ratio": ratio, "textured": bool(ratio > least)}


FEATURES = (
    "laplacian_variance double, edge_density double, edge_contrast double, halo_variance double, high_freq_energy double, low_freq double, mid_freq double, high_freq double, "
    "frequency_variance double, total_energy double, noise double, texture_ratio double, textured boolean, adapted_texture_ratio double"
)


def rim_share(shorter: int, share: float = 0.15) -> float:
    """The perimeter's share of the shorter side, adapted to the picture's size as ``tiers.statistic_thresholds`` does."""
    return min(0.25, share * 1.2) if shorter < 500 else max(0.1, share * 0.8) if shorter > 2000 else share


def features(gray: np.ndarray, edges: np.ndarray | None = None) -> dict[str, float | bool]:
    """The FEATURES of one picture of 3 by 3 pixels or more; ``edges``: those of ``canny``, if they are known."""
    texture, adapted = texture_frame(gray), rim_share(min(gray.shape))
    return edge_features(gray, edges) | frequency_features(gray) | {"noise": noise_deviation(gray)} | texture | {"adapted_texture_ratio": texture["texture_ratio"] if adapted == 0.15 else texture_frame(gray, adapted)["texture_ratio"]}
