"""Preparing page images for text recognition, as functions on arrays of pixels (rows, columns, channels).

Decoding needs an image library, which is not bundled; recognition engines and vision models are
interfaces. Pixels between others are found linearly, so results differ by little from those
of a library with other kernels.
"""

from __future__ import annotations

import base64
import math
import struct
import zlib

import numpy as np

from inkwell.config import DEFAULT, Config


def flatten(image: np.ndarray) -> np.ndarray:
    """Colours, with what is transparent on white."""
    if image.ndim == 2:
        return np.repeat(image[:, :, None], 3, axis=2)
    if image.shape[2] == 4:
        share = image[:, :, 3:].astype(np.float64) / 255
        return np.rint(image[:, :, :3] * share + 255 * (1 - share)).astype(np.uint8)
    return image[:, :, :3]


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness as television standards weigh colours."""
    return image if image.ndim == 2 else np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _at(image: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None) -> np.ndarray:
    """Values between pixels; outside, ``fill`` or else the nearest pixel."""
    height, width = image.shape[:2]
    out = 0.0
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            share = np.abs(1 - dy - (y - y0)) * np.abs(1 - dx - (x - x0))
            value = image[np.clip(yy, 0, height - 1), np.clip(xx, 0, width - 1)].astype(np.float64)
            if fill is not None:
                value = np.where((yy >= 0) & (yy < height) & (xx >= 0) & (xx < width), value, fill)
            out = out + share * value
    return out


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    y = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    layers = [image] if image.ndim == 2 else np.moveaxis(image, 2, 0)
    made = [np.rint(_at(layer, *np.broadcast_arrays(y[:, None], x[None]), None)).astype(np.uint8) for layer in layers]
    return made[0] if image.ndim == 2 else np.stack(made, axis=2)


def scale_up(image: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """Narrow images at the width that recognition works with."""
    height, width = image.shape[:2]
    if width >= config.narrow_image:
        return image
    scale = config.widened_image / width
    return resize(image, int(width * scale), int(height * scale))


def blur(image: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur, edges repeated; as fractions."""
    reach = max(1, math.ceil(3 * radius))
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * radius * radius))
    weights /= weights.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)], mode="edge")
        out = sum(w * np.take(wide, np.arange(k, k + out.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return out


def denoise(image: np.ndarray, radius: float = 0.5) -> np.ndarray:
    return np.rint(blur(image, radius)).astype(np.uint8)


def contrast(image: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Distances from the mean brightness, times the factor."""
    middle = int(image.mean() + 0.5)
    return np.clip(np.rint(middle + factor * (image.astype(np.float64) - middle)), 0, 255).astype(np.uint8)


def sharpen(image: np.ndarray, radius: float = 1, percent: int = 120, threshold: int = 2) -> np.ndarray:
    """Adds a share of what a blur takes away, where that is over the threshold."""
    gone = image.astype(np.float64) - np.rint(blur(image, radius))
    return np.clip(np.rint(image + np.where(np.abs(gone) > threshold, gone * percent / 100, 0)), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float, expand: bool = False, fill: int = 255) -> np.ndarray:
    """Counter-clockwise about the middle; ``expand`` makes room for the corners."""
    turn = math.radians(degrees)
    cos, sin = math.cos(turn), math.sin(turn)
    height, width = image.shape
    high, wide = (math.ceil(abs(width * sin) + abs(height * cos) - 1e-9), math.ceil(abs(width * cos) + abs(height * sin) - 1e-9)) if expand else (height, width)
    y, x = np.mgrid[0:high, 0:wide].astype(np.float64)
    y, x = y - (high - 1) / 2, x - (wide - 1) / 2
    return np.rint(_at(image, x * sin + y * cos + (height - 1) / 2, x * cos - y * sin + (width - 1) / 2, fill)).astype(np.uint8)


def row_sum_variance(image: np.ndarray) -> float:
    """High where lines of text lie level."""
    return float(image.sum(axis=1, dtype=np.float64).var())


def skew(image: np.ndarray) -> float:
    """The turn, of those from -10 to 9.5 degrees in halves, that sets lines level; the first of equals."""
    turns = np.arange(-10, 10, 0.5)
    return float(turns[int(np.argmax([row_sum_variance(rotate(image, a)) for a in turns]))])


def deskew(image: np.ndarray, least: float = 0.3) -> np.ndarray:
    turn = skew(image)
    return rotate(image, turn, expand=True) if abs(turn) > least else image


def prepare(image: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """What text recognition is given: wide enough, gray, quiet, in contrast, level and sharp."""
    return sharpen(deskew(contrast(denoise(gray(flatten(scale_up(image, config)))))))


def prepare_for_vision(image: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """What a vision model is given: colours, and no edge over the largest."""
    image = flatten(image)
    height, width = image.shape[:2]
    scale = config.vision_edge / max(height, width)
    return image if scale >= 1 else resize(image, max(1, int(width * scale)), max(1, int(height * scale)))


def png(image: np.ndarray) -> bytes:
    """The image as a PNG file, gray or in colours."""
    height, width = image.shape[:2]
    lines = np.hstack([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)])
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def data_url(image: np.ndarray) -> str:
    return "data:image/png;base64," + base64.b64encode(png(image)).decode()
