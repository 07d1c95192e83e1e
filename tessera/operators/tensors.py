"""Images as model inputs: padded or plain, resized, normalised planes of one shape, and the way back.

A tensor column is an ``array<float>`` of 3 x side x side numbers, channel by channel (red, green, blue). All rows have one
shape, so a batch of the column is one matrix, and normalising and its inverse are one vector operation on a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import images

# Means and deviations of red, green and blue that the models were trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class Shape:
    """Side of the square, and whether an image is padded to a square before it is resized."""

    side: int
    padded: bool = False


# What each model takes.
CLASSIFIER, SEGMENTER, REGRESSOR = Shape(224, True), Shape(512), Shape(224)


def pixels_of(image: np.ndarray, shape: Shape) -> np.ndarray:
    """Red, green and blue planes (3 x side x side) from 0 to 255, rounded as 8-bit images are, of gray or BGR(A) pixels."""
    planes = np.stack([image] * 3) if image.ndim == 2 else np.stack([image[:, :, k] for k in (2, 1, 0)])
    if shape.padded:
        planes = np.stack([images.padded_to_square(p) for p in planes])
    return np.clip(np.rint(np.stack([images.resized(p.astype(float), shape.side, shape.side) for p in planes])), 0, 255)


def _rows(values: tuple[float, ...], width: int) -> np.ndarray:
    """A number for each element of a flat tensor, by channel."""
    return np.repeat(np.array(values), width // 3)


def normalised(flat: np.ndarray) -> np.ndarray:
    """Tensors (rows x 3 side^2) from values of 0 to 255."""
    return ((flat / 255 - _rows(MEAN, flat.shape[1])) / _rows(DEVIATION, flat.shape[1])).astype(np.float32)


def restored(flat: np.ndarray) -> np.ndarray:
    """Values from 0 to 255 of normalised tensors, not rounded."""
    return (flat.astype(float) * _rows(DEVIATION, flat.shape[1]) + _rows(MEAN, flat.shape[1])) * 255


def tensor_of(image: np.ndarray, shape: Shape) -> np.ndarray:
    """The flat normalised tensor of one image."""
    return normalised(pixels_of(image, shape).reshape(1, -1))[0]


def restored_pixels(tensors: Column) -> Column:
    """Values from 0 to 255 (cut to whole numbers, as 8-bit images) of a tensor column; null stays null."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.full(len(values), None, object)
        if known.any():
            flat = np.clip(restored(np.stack(values[known])) + 1e-4, 0, 255).astype(np.int32)
            for place, row in zip(np.flatnonzero(known), flat, strict=True):
                out[place] = row
        return pd.Series(out)

    return run(tensors)
