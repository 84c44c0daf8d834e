"""Pixel kernels in NumPy: colour spaces, blur, edges, circles, and the features of a raster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def to_gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (0 to 179), saturation, value."""
    x = bgr.astype(float)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    v, d = x.max(-1), x.max(-1) - x.min(-1)
    safe = np.where(d > 0, d, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(d > 0, h % 360, 0)
    s = np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0)
    return np.stack([np.rint(h / 2) % 180, np.rint(s), v], -1).astype(np.uint8)


def _slide(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    w = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="reflect"), len(kernel), axis=axis)
    return w @ kernel


def blur(gray: np.ndarray, sigma: float = 2.0, size: int = 9) -> np.ndarray:
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return _slide(_slide(gray.astype(float), k, 0), k, 1)


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    x = gray.astype(float)
    return _slide(_slide(x, smooth, 0), slope, 1), _slide(_slide(x, smooth, 1), slope, 0)


def edges(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Gradient maxima across the edge, strong ones and the weak ones that touch them."""
    gx, gy = gradients(gray)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    at = lambda dy, dx: p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    sector = np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    ahead = np.choose(sector, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(sector, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    peak = (m > behind) & (m >= ahead)
    weak, strong = peak & (m > low), peak & (m > high)
    while True:
        q = np.pad(strong, 1)
        near = sum(q[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) > 0
        grown = weak & near
        if (grown == strong).all():
            return strong
        strong = grown | strong


def find_circle(gray: np.ndarray, least: float = 0.30, most: float = 0.55, votes: float = 0.4) -> tuple[float, float, float] | None:
    """(cx, cy, r) of the best circle whose radius is least to most of the short side, by votes along
    edge gradients; None if under `votes` of its rim is edge."""
    e = edges(blur(gray))
    gx, gy = gradients(blur(gray))
    y, x = np.nonzero(e)
    if not len(x):
        return None
    n = np.hypot(gx[y, x], gy[y, x])
    ux, uy = gx[y, x] / np.maximum(n, 1e-9), gy[y, x] / np.maximum(n, 1e-9)
    h, w = gray.shape
    short, cell = min(h, w), max(1, min(h, w) // 64)
    best = (0.0, None)
    for r in range(max(2, int(least * short)), int(most * short) + 1, max(1, short // 64)):
        acc = np.zeros((h // cell + 1, w // cell + 1))
        for s in (-1, 1):
            cx, cy = x + s * r * ux, y + s * r * uy
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            np.add.at(acc, ((cy[ok] / cell).astype(int), (cx[ok] / cell).astype(int)), 1)
        p = np.pad(acc, 1)  # rounding spreads a centre's votes over neighbouring cells
        acc = sum(p[1 + dy : 1 + dy + acc.shape[0], 1 + dx : 1 + dx + acc.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        top = np.unravel_index(acc.argmax(), acc.shape)
        share = acc[top] / (2 * np.pi * r)
        if share > best[0]:
            best = (share, ((top[1] + 0.5) * cell, (top[0] + 0.5) * cell, float(r)))
    return best[1] if best[0] >= votes else None


def features(bgr: np.ndarray) -> dict:
    """The feature row of one raster, as figures.score takes it."""
    h, w = bgr.shape[:2]
    gray, hsv = to_gray(bgr), to_hsv(bgr).astype(int)
    ring = max(5, int(min(h, w) * 0.05))
    border = np.ones((h, w), bool)
    border[ring : h - ring, ring : w - ring] = False
    hue, vivid, v = hsv[..., 0], hsv[..., 1] > 80, hsv[..., 2]
    bands = [(hue >= 5) & (hue <= 30), (hue >= 42) & (hue <= 65), (hue <= 5) | (hue >= 170)]
    inner = v[h // 8 : 7 * h // 8, w // 8 : 7 * w // 8]
    circle = find_circle(gray)
    centred = circle is not None and w / 4 < circle[0] < 3 * w / 4 and h / 4 < circle[1] < 3 * h / 4
    return {
        "width": w,
        "height": h,
        "border_white": float((v[border] > 240).mean()),
        "border_dark": float((v[border] < 25).mean()),
        "dark": float((v < 20).mean()),
        "circle": circle is not None,
        "centred": centred,
        "radius": circle[2] if circle is not None else None,
        "hue_sum": float(sum((b & vivid).mean() for b in bands)),
        "mean_s": float(hsv[..., 1].mean()),
        "std": float(gray.std()),
        "edge": float(edges(gray).mean()),
        "interior_white": float((inner > 240).mean()) if inner.size else 0.0,
    }


def raster_features(images: DataFrame) -> DataFrame:
    """Rows of the image source (origin, width, height, nChannels, data) -> feature rows by Arrow
    batches; gray and alpha channels become BGR. An image that can't be read keeps its row, with
    readable false and all else null, so that it is rejected and not lost."""

    def run(batches):
        for b in batches:
            rows = []
            for origin, width, height, channels, data in zip(*(b.column(i) for i in range(5))):
                row, w, h, n = {"origin": origin.as_py(), "readable": False}, width.as_py(), height.as_py(), channels.as_py()
                raw = data.as_buffer() if data.is_valid else b""
                if w and w > 0 and len(raw) == w * h * n:
                    x = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                    row |= {"readable": True} | features(np.repeat(x, 3, 2) if n == 1 else x[..., :3])
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return images.select("origin", "width", "height", "nChannels", "data").mapInArrow(run, RASTER)


RASTER = "origin string, readable boolean, width int, height int, border_white double, border_dark double, dark double, circle boolean, centred boolean, radius double, hue_sum double, mean_s double, std double, edge double, interior_white double"
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
_SCHEMA = pa.schema([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in RASTER.split(", ")])
