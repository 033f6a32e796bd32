"""Colours of frames in whole numbers, as common vision libraries work them out for bytes.

Frames are bytes of blue, green and red for each pixel, row by row. All is exact
and alike on any processor.
"""

from __future__ import annotations

import numpy as np

#: Shares of blue, green and red in gray, of 2^15.
GRAY_SHARES = (3735, 19235, 9798)
#: Factors of the conversion from video levels (luma from 16, chroma around 128).
LUMA, BLUE_U, GREEN_U, GREEN_V, RED_V = 1.164, 2.018, -0.391, -0.813, 1.596
HUES = 180


def pixels(bgr: bytes) -> np.ndarray:
    """A row of blue, green, red for each pixel."""
    return np.frombuffer(bgr, np.uint8).reshape(-1, 3).astype(np.int32)


def gray(bgr: bytes) -> bytes:
    return ((pixels(bgr) @ np.array(GRAY_SHARES, np.int32) + (1 << 14)) >> 15).astype(np.uint8).tobytes()


def _quotients(numerator: float) -> np.ndarray:
    """``numerator / i`` for each i of a byte in 12 binary places, to the nearest even; 0 for 0."""
    out = np.zeros(256, np.int64)
    out[1:] = np.rint(numerator * 4096 / np.arange(1, 256))
    return out


_OF_VALUE, _OF_SPREAD = _quotients(255), _quotients(HUES / 6)


def hue_saturation(bgr: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hue (0 to 179, 180 for a full turn that rounding makes) and saturation (0 to 255) of each pixel."""
    b, g, r = pixels(bgr).T.astype(np.int64)
    value = np.maximum(np.maximum(b, g), r)
    spread = value - np.minimum(np.minimum(b, g), r)
    sixths = np.where(value == r, g - b, np.where(value == g, b - r + 2 * spread, r - g + 4 * spread))
    hue = (sixths * _OF_SPREAD[spread] + 2048) >> 12
    return hue + HUES * (hue < 0), (spread * _OF_VALUE[value] + 2048) >> 12


def bgr_of_yuv(luma: np.ndarray, u: np.ndarray, v: np.ndarray) -> bytes:
    """From planes of one size, in video levels."""
    one = 1 << 20
    y = np.maximum(luma.astype(np.int64) - 16, 0) * int(LUMA * one)
    u, v = u.astype(np.int64) - 128, v.astype(np.int64) - 128
    half = 1 << 19
    channels = [
        (y + half + int(BLUE_U * one) * u) >> 20,
        (y + half + int(GREEN_V * one) * v + int(GREEN_U * one) * u) >> 20,
        (y + half + int(RED_V * one) * v) >> 20,
    ]
    return np.clip(np.stack(channels, axis=-1), 0, 255).astype(np.uint8).tobytes()
