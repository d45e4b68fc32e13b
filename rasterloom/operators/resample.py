"""Filtered resizing: a table of weights for every new place, applied along rows, then along columns.

A new place is the weighted mean of the old ones around its centre.  Downwards
the filter is as much wider as the image gets smaller, so nothing is skipped.
``lanczos`` is the sinc windowed by a sinc of three periods, ``triangle`` the
linear filter.

Defined cases: places outside the image have no weight, the others share it; a
size that stays gives the same values; an empty table gives no rows; images of
any size, with columns and rows numbered from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Half widths of the filters.
SUPPORT = {"lanczos": 3.0, "triangle": 1.0}


def _curve(kind: str, x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3.0) * (np.abs(x) < 3.0) if kind == "lanczos" else np.maximum(0.0, 1.0 - np.abs(x))


def filter_weights(old: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each new place the first old place and the weights from there on."""
    ratio = old / new
    wide = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    reach = SUPPORT[kind] * wide
    first = np.maximum(0, (centre - reach + 0.5).astype(int))
    last = np.minimum(old, (centre + reach + 0.5).astype(int))
    at = first[:, None] + np.arange(int((last - first).max()))
    weights = _curve(kind, (at - centre[:, None] + 0.5) / wide) * (at < last[:, None])
    return first, weights / weights.sum(axis=1, keepdims=True)


def along(values: np.ndarray, new: int, kind: str) -> np.ndarray:
    """Resize the last axis."""
    first, weights = filter_weights(values.shape[-1], new, kind)
    at = np.minimum(first[:, None] + np.arange(weights.shape[1]), values.shape[-1] - 1)
    out = np.zeros((*values.shape[:-1], new))
    for k in range(weights.shape[1]):
        out += values[..., at[:, k]] * weights[:, k]
    return out


def resize(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """An image (height, width) or (height, width, channels) of 0 to 255, in whole steps after each pass."""
    planes = image[..., None] if image.ndim == 2 else image
    planes = np.moveaxis(planes.astype(float), -1, 0)
    step = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    if planes.shape[2] != width:
        planes = step(along(planes, width, kind))
    if planes.shape[1] != height:
        planes = step(along(planes.transpose(0, 2, 1), height, kind)).transpose(0, 2, 1)
    out = np.moveaxis(planes, 0, -1)
    return out[..., 0] if image.ndim == 2 else out


@F.pandas_udf(ArrayType(DoubleType()))
def _line(values: pd.Series, new: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([along(np.asarray(v, float), int(n), k) for v, n, k in zip(values, new, kind)])


def _pass(pixels: DataFrame, value: str, axis: str, across: str, new: int, kind: str) -> DataFrame:
    """One axis, over one array for each line."""
    lines = pixels.groupBy("image_id", across).agg(F.array_sort(F.collect_list(F.struct(axis, F.col(value).cast("double").alias("v")))).alias("line"))
    made = lines.select("image_id", across, _line(F.transform("line", lambda p: p["v"]), F.lit(new), F.lit(kind)).alias("line"))
    return made.select("image_id", across, F.posexplode("line").alias(axis, value))


def resized(pixels: DataFrame, value: str, width: int, height: int, kind: str = "lanczos") -> DataFrame:
    """image_id, x, y and the value of every image at the new size, without steps between the passes."""
    across = _pass(pixels, value, "x", "y", width, kind)
    return _pass(across, value, "y", "x", height, kind).select("image_id", "x", "y", value)
