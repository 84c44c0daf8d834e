"""Rasters without image libraries: FITS images, linear world coordinates, crops, PNG files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BLOCK, CARD = 2880, 80
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


@dataclass
class Raster:
    """A two-dimensional image (row 0 at the bottom, as FITS has it) and its header."""

    data: np.ndarray
    header: dict

    def _axis(self, k: int) -> tuple[float, float, float]:
        h = self.header
        return float(h.get(f"CRPIX{k}", 1.0)), float(h.get(f"CRVAL{k}", 0.0)), float(h.get(f"CDELT{k}", 1.0))

    def world(self, x, y):
        """World coordinates of pixel centres; pixels count from 0."""
        (px, vx, dx), (py, vy, dy) = self._axis(1), self._axis(2)
        return vx + (x + 1 - px) * dx, vy + (y + 1 - py) * dy

    def pixel(self, tx, ty):
        (px, vx, dx), (py, vy, dy) = self._axis(1), self._axis(2)
        return (tx - vx) / dx + px - 1, (ty - vy) / dy + py - 1

    def bounds(self) -> tuple[float, float, float, float]:
        """tx_min, ty_min, tx_max, ty_max of the corner pixels' centres."""
        h, w = self.data.shape
        (x0, y0), (x1, y1) = self.world(0, 0), self.world(w - 1, h - 1)
        return float(x0), float(y0), float(x1), float(y1)

    def crop(self, tx_min: float, ty_min: float, tx_max: float, ty_max: float) -> "Raster":
        """The pixels nearest to the box's corners and all between; the whole raster where that holds
        none of it."""
        (x0, y0), (x1, y1) = self.pixel(tx_min, ty_min), self.pixel(tx_max, ty_max)
        h, w = self.data.shape
        a, b = sorted((int(np.rint(x0)), int(np.rint(x1))))
        c, d = sorted((int(np.rint(y0)), int(np.rint(y1))))
        a, b, c, d = max(a, 0), min(b, w - 1), max(c, 0), min(d, h - 1)
        if a > b or c > d:
            return self
        (px, _, _), (py, _, _) = self._axis(1), self._axis(2)
        return Raster(self.data[c : d + 1, a : b + 1], self.header | {"CRPIX1": px - a, "CRPIX2": py - c})


def _value(text: str):
    text = text.split("/")[0].strip() if not text.strip().startswith("'") else text.strip()[1:].split("'")[0].rstrip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def read_fits(raw: bytes) -> Raster | None:
    """The first image of a FITS file, scaled by BSCALE and BZERO; null without one."""
    at = 0
    try:
        while at < len(raw):
            header = {}
            while True:
                cards = raw[at : at + BLOCK].decode("ascii", "replace")
                at += BLOCK
                lines = [cards[i : i + CARD] for i in range(0, len(cards), CARD)]
                header |= {c[:8].strip(): _value(c[10:]) for c in lines if c[8:10] == "= "}
                if any(c[:8].strip() == "END" for c in lines) or at >= len(raw):
                    break
            axes = [int(header[f"NAXIS{k}"]) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
            size = int(np.prod(axes)) * abs(int(header["BITPIX"])) // 8 if axes else 0
            if len(axes) == 2 and size and "ZIMAGE" not in header:
                data = np.frombuffer(raw[at : at + size], _KINDS[int(header["BITPIX"])]).reshape(axes[::-1])
                return Raster(data * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0)), header)
            at += -(-size // BLOCK) * BLOCK
    except (KeyError, ValueError):
        return None
    return None


def write_fits(data: np.ndarray, header: dict) -> bytes:
    """A FITS file of one 64-bit image."""
    own = {"SIMPLE": True, "BITPIX": -64, "NAXIS": 2, "NAXIS1": data.shape[1], "NAXIS2": data.shape[0]}
    text = lambda v: ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else repr(v).rjust(20)
    cards = [f"{k:<8}= {text(v)}".ljust(CARD) for k, v in (own | {k: v for k, v in header.items() if k not in own}).items()]
    head = "".join([*cards, "END".ljust(CARD)])
    body = data.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode() + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def normalise(data: np.ndarray) -> np.ndarray:
    """|value| from its least to its greatest as 0 to 255, cut to an integer; one value alone is 0."""
    x = np.abs(np.nan_to_num(data.astype(float)))
    low, high = x.min(), x.max()
    return np.zeros(x.shape, np.uint8) if high == low else np.floor((x - low) * 255.0 / (high - low)).astype(np.uint8)


def to_rgb(image: np.ndarray) -> np.ndarray:
    """Gray, RGB or RGBA to RGB."""
    return np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image[..., :3]


def cmyk_to_rgb(image: np.ndarray) -> np.ndarray:
    cmyk = image.astype(float) / 255
    return np.rint(255 * (1 - cmyk[..., :3]) * (1 - cmyk[..., 3:])).astype(np.uint8)


def write_png(image: np.ndarray) -> bytes:
    """A PNG of 8-bit gray (rows x columns) or RGB (rows x columns x 3)."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + image[0].size), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def denoise(gray: np.ndarray, radius: int = 4, colour: float = 75.0, space: float = 75.0) -> np.ndarray:
    """A bilateral filter: each neighbour weighs by its distance and by how alike it is."""
    x = np.pad(gray.astype(float), radius, mode="reflect")
    h, w = gray.shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                y = x[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                k = np.exp(-(dx * dx + dy * dy) / (2 * space**2) - (y - gray) ** 2 / (2 * colour**2))
                total += k * y
                weight += k
    return np.rint(total / weight).astype(np.uint8)


def grid(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Pixel places (x, y) of a box, row by row."""
    y, x = np.mgrid[y0:y1, x0:x1]
    return np.stack([x.ravel(), y.ravel()], 1)
