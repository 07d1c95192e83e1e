"""Pixels in NumPy: planes of masks, components, hashes, structural similarity, padding, crops. Used inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in gray, constants of structural similarity, and names of mask conventions.
GRAY = (0.299, 0.587, 0.114)
SSIM_SIDE, SSIM_WINDOW, SSIM_SIGMA, SSIM_C1, SSIM_C2 = 256, 11, 1.5, (0.01 * 255) ** 2, (0.03 * 255) ** 2
CROP_MARGIN = 0.15


def gray(image: np.ndarray) -> np.ndarray:
    """One plane of floats from BGR(A) or gray."""
    if image.ndim == 2:
        return image.astype(float)
    b, g, r = (image[:, :, k].astype(float) for k in range(3))
    return np.rint(r * GRAY[0] + g * GRAY[1] + b * GRAY[2])


def mask_plane(mask: np.ndarray) -> np.ndarray:
    """Channel 0 of four channels, gray of three, and a plane as it is."""
    if mask.ndim == 2:
        return mask
    return mask[:, :, 0] if mask.shape[2] == 4 else gray(mask).astype(mask.dtype)


def convention(values: set[int], most: int) -> str:
    """How a mask with these values marks what it shows; a blank mask counts as 0 and 1."""
    return "binary_0_1" if values <= {0, 1} else "binary_0_255" if values <= {0, 255} else f"multivalue_max_{most}"


def count_components(affected: np.ndarray) -> int:
    """8-connected regions: runs of each row are united with those of the row above that they touch."""
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for row in affected:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            parent.append(len(parent))
            mine = len(parent) - 1
            for b, y, other in above:
                if b <= z and y >= a:
                    parent[find(other)] = find(mine)
            here.append((a, z, mine))
        above = here
    return sum(parent[x] == x for x in range(len(parent)))


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with a support that grows with the reduction, rows and columns apart."""
    for axis, size in ((1, width), (0, height)):
        n = plane.shape[axis]
        scale = n / size
        reach = max(scale, 1.0)
        centre = (np.arange(size) + 0.5) * scale
        weight = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / reach)
        weight /= weight.sum(1, keepdims=True)
        plane = plane @ weight.T if axis else weight @ plane
    return plane


def nearest(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixels, for showing a mask at another size."""
    rows = np.minimum(np.arange(height) * mask.shape[0] // height, mask.shape[0] - 1)
    columns = np.minimum(np.arange(width) * mask.shape[1] // width, mask.shape[1] - 1)
    return mask[rows][:, columns]


def difference_hash(image: np.ndarray, side: int = 16) -> list[int]:
    """Bits right > left of the image at (side + 1) x side, row by row, as signed 64-bit words, first bit highest."""
    small = np.clip(np.rint(resized(gray(image), side + 1, side)), 0, 255)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    bits = np.concatenate([np.zeros(-len(bits) % 64, bool), bits])
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def _blurred(plane: np.ndarray) -> np.ndarray:
    reach = SSIM_WINDOW // 2
    kernel = np.exp(-((np.arange(SSIM_WINDOW) - reach) ** 2) / (2 * SSIM_SIGMA**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.pad(plane, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        plane = sum(k * np.take(wide, np.arange(i, i + plane.shape[axis]), axis) for i, k in enumerate(kernel))
    return plane


def similarity_plane(image: np.ndarray) -> np.ndarray:
    """The gray plane, 256 x 256, of which the structural similarity is taken."""
    return resized(gray(image), SSIM_SIDE, SSIM_SIDE)


def similarity_of_planes(x: np.ndarray, y: np.ndarray) -> float:
    """Mean structural similarity of two planes of one size, clipped to [-1, 1]."""
    mx, my = _blurred(x), _blurred(y)
    vx, vy, cov = _blurred(x * x) - mx * mx, _blurred(y * y) - my * my, _blurred(x * y) - mx * my
    score = ((2 * mx * my + SSIM_C1) * (2 * cov + SSIM_C2)) / ((mx * mx + my * my + SSIM_C1) * (vx + vy + SSIM_C2))
    return float(np.clip(score.mean(), -1, 1))


def structural_similarity(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Mean structural similarity of two images at 256 x 256 in gray; 0 where either is missing."""
    return 0.0 if a is None or b is None else similarity_of_planes(similarity_plane(a), similarity_plane(b))


def padded_to_square(image: np.ndarray) -> np.ndarray:
    """Zeros around the image, an odd pixel more on the right or at the bottom."""
    h, w = image.shape[:2]
    side = max(h, w)
    top, left = (side - h) // 2, (side - w) // 2
    return np.pad(image, [(top, side - h - top), (left, side - w - left), *[(0, 0)] * (image.ndim - 2)])


def crop_box(mask: np.ndarray, margin: float = CROP_MARGIN) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 around what is above 0, with a margin, clamped; the largest index is the (exclusive) end, as in the reference. None for an empty mask."""
    ys, xs = np.nonzero(mask > 0)
    if not len(ys):
        return None
    x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
    dx, dy = int((x1 - x0) * margin), int((y1 - y0) * margin)
    return max(0, x0 - dx), max(0, y0 - dy), min(mask.shape[1], x1 + dx), min(mask.shape[0], y1 + dy)


def plane_similarity(a: Column, b: Column) -> Column:
    """Structural similarity of two stored planes (see ``sources.pixels.planes``); 0 where either is missing. Use it on candidate pairs only."""
    plane = lambda x: np.frombuffer(x, np.float32).astype(float).reshape(SSIM_SIDE, SSIM_SIDE)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([0.0 if p is None or q is None else similarity_of_planes(plane(p), plane(q)) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)
