"""Pixels of one frame as numpy arrays (height, width, channels): planes for models, crops, letterboxes, redaction."""

from __future__ import annotations

import numpy as np

#: Fixed values of the recogniser's input, and the side of the mosaic's blocks.
FACE_SIDE, FACE_MEAN, FACE_SPREAD = 112, 127.5, 127.5
BLOCK = 15


def frame(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def without_alpha(rgba: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rgba[..., :3])


def planes(rgb: np.ndarray, mean=(0.0, 0.0, 0.0), spread=(255.0, 255.0, 255.0), backwards: bool = False) -> np.ndarray:
    """(channels, height, width) of single precision: (value - mean) / spread; backwards: blue first."""
    out = np.ascontiguousarray(rgb.transpose(2, 0, 1), np.float32)
    mean, spread = (np.asarray(x, np.float32) for x in (mean, spread))
    if mean.any():
        out -= mean[:, None, None]
    if (spread != 1).any():
        out /= spread[:, None, None]
    return np.ascontiguousarray(out[::-1] if backwards else out)


def crop(rgba: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The rectangle; what lies outside the frame is transparent black."""
    out = np.zeros((h, w, rgba.shape[2]), rgba.dtype)
    top, left, bottom, right = max(0, y), max(0, x), min(rgba.shape[0], y + h), min(rgba.shape[1], x + w)
    if bottom > top and right > left:
        out[top - y : bottom - y, left - x : right - x] = rgba[top:bottom, left:right]
    return out


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, samples at pixel centres, edges repeated."""
    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (t, b, v), (le, r, u) = axis(image.shape[0], height), axis(image.shape[1], width)
    u, v = u[None, :, None], v[:, None, None]
    used, at = np.unique(np.concatenate([t, b]), return_inverse=True)  # each row of the image is stretched once
    rows = image[used][:, le] * (1 - u) + image[used][:, r] * u
    return np.floor(rows[at[:height]] * (1 - v) + rows[at[height:]] * v + 0.5).astype(image.dtype)


def letterboxed(rgba: np.ndarray, side: int, fill=(114, 114, 114)) -> np.ndarray:
    """The frame fitted into a square, the rest filled."""
    h, w = rgba.shape[:2]
    scale = min(side / w, side / h)
    new_w, new_h = int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5))
    out = np.full((side, side), np.array([*fill, 255], np.uint8).view(np.uint32)[0]).view(np.uint8).reshape(side, side, 4)
    left, top = (side - new_w) // 2, (side - new_h) // 2
    out[top : top + new_h, left : left + new_w] = resized(rgba, new_w, new_h)
    return out


def face_input(rgba: np.ndarray, x1: float, y1: float, x2: float, y2: float, ratio: float = 0.2, least: int = 10) -> np.ndarray | None:
    """Planes of a face for the recogniser, its box grown by `ratio` on each side; None where the grown box is under `least` pixels."""
    height, width = rgba.shape[:2]
    dx, dy = (x2 - x1) * ratio, (y2 - y1) * ratio
    grow = lambda v: int(np.floor(v + 0.5))
    left, top = max(0, grow(x1 - dx)), max(0, grow(y1 - dy))
    w, h = min(width, grow(x2 + dx)) - left, min(height, grow(y2 + dy)) - top
    if w < least or h < least:
        return None
    own = resized(crop(rgba, left, top, w, h), FACE_SIDE, FACE_SIDE)
    return planes(without_alpha(own), (FACE_MEAN,) * 3, (FACE_SPREAD,) * 3)


def inside_bar(width: int, height: int, x: float, y: float, w: float, h: float, radius: float) -> np.ndarray:
    """Which pixels' centres lie in a rectangle with rounded corners, half-open at its far edges."""
    cx, cy = np.arange(width) + 0.5, np.arange(height) + 0.5
    dx = np.maximum(np.maximum(x + radius - cx, cx - (x + w - radius)), 0)[None, :]
    dy = np.maximum(np.maximum(y + radius - cy, cy - (y + h - radius)), 0)[:, None]
    within = ((cx >= x) & (cx < x + w))[None, :] & ((cy >= y) & (cy < y + h))[:, None]
    return within & (dx * dx + dy * dy <= radius * radius if radius else within)


def redacted(rgba: np.ndarray, style: str, x: float, y: float, w: float, h: float, radius: float = 0.0, block: int = BLOCK) -> np.ndarray:
    """A copy with one region redacted: block means, or black with rounded corners. A region without area changes nothing."""
    out = rgba.copy()
    if w <= 0 or h <= 0:
        return out
    if style != "pixelate":
        out[inside_bar(rgba.shape[1], rgba.shape[0], x, y, w, h, radius), :3] = 0
        return out
    x, y, w, h = int(x), int(y), int(w), int(h)
    part = rgba[y : y + h, x : x + w, :3]
    if not part.size:
        return out
    rows, columns = np.arange(0, part.shape[0], block), np.arange(0, part.shape[1], block)
    tall, wide = np.diff([*rows, part.shape[0]]), np.diff([*columns, part.shape[1]])
    sums = np.add.reduceat(np.add.reduceat(part, rows, axis=0, dtype=np.int64), columns, axis=1)
    means = sums // (tall[:, None] * wide[None, :])[..., None]
    out[y : y + h, x : x + w, :3] = np.repeat(np.repeat(means, tall, axis=0), wide, axis=1)
    return out
