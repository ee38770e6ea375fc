from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from inkwell.operators import pixels as P


def lines(width=240, height=120):
    """Dark lines of text on white."""
    image = np.full((height, width), 255, np.uint8)
    for y in range(20, height - 20, 16):
        image[y : y + 6, 30 : width - 30] = 20
    return image


def test_flatten_gray_and_resize():
    seen = np.zeros((2, 2, 4), np.uint8)
    seen[0, 0] = (10, 20, 30, 255)
    flat = P.flatten(seen)
    assert flat[0, 0].tolist() == [10, 20, 30] and flat[1, 1].tolist() == [255, 255, 255]
    assert P.flatten(np.zeros((3, 2), np.uint8)).shape == (3, 2, 3) and P.gray(np.full((1, 1, 3), 100, np.uint8))[0, 0] == 100
    assert P.gray(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 76
    assert P.scale_up(np.zeros((100, 500), np.uint8)).shape == (300, 1500) and P.scale_up(np.zeros((10, 1000), np.uint8)).shape == (10, 1000)
    assert P.prepare_for_vision(np.zeros((3600, 900), np.uint8)).shape == (1800, 450, 3) and P.prepare_for_vision(np.zeros((5, 7), np.uint8)).shape == (5, 7, 3)
    assert (P.resize(np.full((7, 9), 33, np.uint8), 20, 3) == 33).all()


def test_filters():
    flat = np.full((9, 9), 80, np.uint8)
    assert (P.denoise(flat) == 80).all() and (P.sharpen(flat) == 80).all() and (P.contrast(flat) == 80).all()
    step = np.tile(np.repeat([100, 140], 8).astype(np.uint8), (8, 1))
    assert P.contrast(step).min() == 80 and P.contrast(step).max() == 160
    sharp = P.sharpen(step)
    assert sharp[4, 7] < 100 and sharp[4, 8] > 140 and sharp[4, 0] == 100
    assert abs(float(P.blur(step, 1).sum()) - step.sum()) < 1


def test_deskew_finds_the_turn():
    level = lines()
    assert P.skew(level) == 0 and (P.deskew(level) == level).all()
    for turn in (-6, 3.5):
        assert abs(P.skew(P.rotate(level, turn)) + turn) <= 0.5
    set_right = P.deskew(P.rotate(level, 5))
    assert P.row_sum_variance(set_right) > 1.5 * P.row_sum_variance(P.rotate(level, 5)) and set_right.shape[0] > 120
    assert (P.rotate(level, 0) == level).all()


def test_prepare_runs_whole():
    out = P.prepare(np.repeat(lines(300, 60)[:, :, None], 3, axis=2))
    assert out.ndim == 2 and out.dtype == np.uint8 and out.shape[1] >= 1500


def test_png_holds_the_pixels():
    rng = np.random.default_rng(2)
    for image in (rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)):
        url = P.data_url(image)
        data = base64.b64decode(url.removeprefix("data:image/png;base64,"))
        assert data[:8] == b"\x89PNG\r\n\x1a\n"
        at, parts = 8, {}
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
            parts[kind] = body
            at += 12 + n
        assert parts[b"IHDR"][:8] == struct.pack(">II", image.shape[1], image.shape[0])
        lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(image.shape[0], -1)
        assert (lines[:, 0] == 0).all() and (lines[:, 1:].reshape(image.shape) == image).all()
