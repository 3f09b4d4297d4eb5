"""Pixel kernels on numpy arrays (height, width, 3), used inside mapInPandas tasks."""

from __future__ import annotations

import functools
import sys

import numpy as np
from pyspark import cloudpickle

from hemline.functions.fixed import TRANSFORMS

GRAY = np.array([0.299, 0.587, 0.114])


def shipped(fn, *args):
    """``fn`` pickled by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return functools.partial(fn, *args) if args else fn


def decode(width: int, height: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB floats from stored bytes (gray, BGR or BGRA rows); None for an unreadable image."""
    if width is None or width <= 0 or channels not in (1, 3, 4):
        return None
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]
    return rgb.astype(np.float64)


def fix(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a + 0.5), 0, 255)


def blend(base, a: np.ndarray, factor: float) -> np.ndarray:
    return fix(base + (a - base) * factor)


def gray(a: np.ndarray) -> np.ndarray:
    return np.floor(a @ GRAY + 0.5)[:, :, None]


def blur(a: np.ndarray, radius: float) -> np.ndarray:
    reach = max(1, int(np.ceil(radius * 3)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(3)]
        p = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return fix(a)


def sample(a: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional positions; outside is white."""
    h, w = a.shape[:2]
    inside = (ys > -0.5) & (ys < h - 0.5) & (xs > -0.5) & (xs < w - 0.5)
    y, x = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    top = a[y0, x0] * (1 - fx) + a[y0, x1] * fx
    low = a[y1, x0] * (1 - fx) + a[y1, x1] * fx
    return np.where(inside[..., None], fix(top * (1 - fy) + low * fy), 255.0)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = a.shape[:2]
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    return sample(a, *np.meshgrid(ys, xs, indexing="ij"))


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    h, w = a.shape[:2]
    t = np.radians(degrees)
    ys, xs = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return sample(
        a, np.sin(t) * xs + np.cos(t) * ys + (h - 1) / 2, np.cos(t) * xs - np.sin(t) * ys + (w - 1) / 2
    )


def crop(a: np.ndarray, share: float) -> np.ndarray:
    h, w = a.shape[:2]
    y, x = int(h * (1 - share) / 2), int(w * (1 - share) / 2)
    inner = a[y : max(int(h * (1 + share) / 2), y + 1), x : max(int(w * (1 + share) / 2), x + 1)]
    return resize(inner, h, w)


def shrink(a: np.ndarray, share: float) -> np.ndarray:
    h, w = a.shape[:2]
    nh, nw = max(int(h * share), 1), max(int(w * share), 1)
    out = np.full_like(a, 255.0)
    y, x = (h - nh) // 2, (w - nw) // 2
    out[y : y + nh, x : x + nw] = resize(a, nh, nw)
    return out


def sharpen(a: np.ndarray, factor: float) -> np.ndarray:
    """Move away from a 3x3 smoothed copy; the border row and column stay as they are."""
    if min(a.shape[:2]) < 3:
        return a
    h, w = a.shape[:2]
    near = sum(a[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3))
    smooth = a.copy()
    smooth[1:-1, 1:-1] = fix((near + 4 * a[1:-1, 1:-1]) / 13)
    return blend(smooth, a, factor)


KERNELS = {
    "flip": lambda a, _: a[:, ::-1],
    "brightness": lambda a, f: blend(0.0, a, f),
    "contrast": lambda a, f: blend(np.floor(gray(a).mean() + 0.5), a, f),
    "color": lambda a, f: blend(gray(a), a, f),
    "channels": lambda a, f: fix(a * np.array(f)),
    "sharpness": sharpen,
    "blur": blur,
    "rotate": rotate,
    "crop": crop,
    "shrink": shrink,
}


def encode(a: np.ndarray | None) -> bytes | None:
    return None if a is None else np.ascontiguousarray(a).astype(np.uint8).tobytes()


def _decoded(row):
    return decode(row.width, row.height, row.n_channels, row.data)


def slices(batches, rows: int = 64):
    """Short pieces of the Arrow batches: results can be far larger than the stored bytes they come from."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def augment_batches(batches):
    for pdf in slices(batches):
        out = []
        for row in pdf.itertuples():
            a = _decoded(row)
            for kernel, value in TRANSFORMS[row.transform] if a is not None else ():
                a = KERNELS[kernel](a, value)
            out.append(encode(a))
        yield pdf.drop(columns="data").assign(pixels=out)


def random_batches(batches):
    steps = [("angle", "rotate"), ("brightness", "brightness"), ("contrast", "contrast")]
    for pdf in slices(batches):
        out = []
        for row in pdf.itertuples():
            a = _decoded(row)
            if a is not None:
                for column, kernel in steps:
                    value = getattr(row, column)
                    if value == value and value is not None:
                        a = KERNELS[kernel](a, value)
                if row.noise_seed == row.noise_seed and row.noise_seed is not None:
                    a = fix(a + np.random.default_rng(int(row.noise_seed)).normal(0, 10, a.shape))
                if row.blur == row.blur and row.blur is not None:
                    a = blur(a, row.blur)
            out.append(encode(a))
        yield pdf.drop(columns="data").assign(pixels=out)


def prepare_batches(size, batches):
    for pdf in slices(batches):
        ok, values = [], []
        for row in pdf.itertuples():
            a = _decoded(row)
            ok.append(a is not None)
            if a is None:
                values.append(np.zeros(3 * size * size, np.float32))
            else:
                planes = resize(a, size, size).transpose(2, 0, 1) / 127.5 - 1
                values.append(planes.astype(np.float32).ravel())
        yield pdf.drop(columns="data").assign(ok=ok, values=values)
