"""Numeric kernels over array columns: fingerprints, signatures, scores, regions.

All but the pixel kernels are expressions, evaluated inside the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 15


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_range(x: Column, low: float, high: float) -> Column:
    return clamp01((x - low) / (high - low))


def fingerprint_distance(a: Column, b: Column, a_ratio: Column, b_ratio: Column) -> Column:
    """Distance of two cell grids with their foreground ratios; 1 for grids that can't be compared."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != 0) | (p["b"] != 0))
    n = F.size(pairs)
    cells = _sum(F.transform(pairs, lambda p: F.abs(p["a"] - p["b"]) / float(LEVELS)))
    torn = F.size(F.filter(pairs, lambda p: (p["a"] == 0) != (p["b"] == 0)))
    density = F.least(F.lit(1.0), F.abs(a_ratio - b_ratio) * 8)
    found = F.least(F.lit(1.0), F.when(n == 0, 0.0).otherwise(cells / n * 0.65 + torn / n * 0.25) + density * 0.1)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).otherwise(found)


def signature_overlap(before: Column, after: Column) -> Column:
    """Struct of shared, union, retained_before, retained_after, contained, iou of two occupancy grids."""
    both = F.arrays_zip(before.alias("a"), after.alias("b"))
    shared = F.size(F.filter(both, lambda p: (p["a"] > 0) & (p["b"] > 0)))
    union = F.size(F.filter(both, lambda p: (p["a"] > 0) | (p["b"] > 0)))
    first, second = (F.size(F.filter(x, lambda v: v > 0)) for x in (before, after))

    def over(whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(shared / whole)

    return F.struct(
        shared.alias("shared"), union.alias("union"), over(first).alias("retained_before"), over(second).alias("retained_after"),
        over(F.least(first, second)).alias("contained"), over(union).alias("iou"),
    )


def bounds_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height); two missing boxes agree."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    found = F.when(union <= 0, 0.0).otherwise(w * h / union)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(found)


def same_message(fingerprint: Column, overlap: Column, bounds: Column, line_delta: Column, same: float = 0.22, retained: float = 0.65, contained: float = 0.7, least_bounds: float = 0.45) -> Column:
    """Struct of progressive and same: whether the later picture continues the earlier message."""
    structure = (bounds >= least_bounds) & (line_delta <= 1)
    progressive = (overlap["retained_after"] <= overlap["retained_before"]) & (overlap["retained_before"] >= retained) & structure
    faded = (overlap["retained_after"] > overlap["retained_before"]) & (overlap["retained_after"] >= retained) & structure
    held = (overlap["contained"] >= contained) & structure
    return F.struct(progressive.alias("progressive"), ((fingerprint <= same) | progressive | faded | held).alias("same"))


def occupancy_grid(mask: np.ndarray, columns: int = 32, rows: int = 12, least: float = 0.02) -> np.ndarray:
    """Which cells of a mask hold text: at least one pixel and the least share of the cell."""
    y, x = np.linspace(0, mask.shape[0], rows + 1).astype(int), np.linspace(0, mask.shape[1], columns + 1).astype(int)
    sums = np.pad(mask.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    held = sums[np.ix_(y[1:], x[1:])] - sums[np.ix_(y[:-1], x[1:])] - sums[np.ix_(y[1:], x[:-1])] + sums[np.ix_(y[:-1], x[:-1])]
    return (held > 0) & (held >= least * np.maximum(np.outer(np.diff(y), np.diff(x)), 1))


def commit_score(presence: Column, lines: Column, components: Column, dynamic: Column, persistent: Column) -> Column:
    return (
        0.45 * clamp01(presence) + 0.15 * clamp01(lines / 2.0) + 0.15 * clamp01(components / 6.0)
        + 0.15 * clamp01(dynamic) + 0.1 * (1 - clamp01(persistent))
    )


def letterbox(roi: Column, source_width: Column, source_height: Column, shown_width: Column, shown_height: Column) -> Column:
    """Where a normalised region of the source lies in a display that keeps the aspect ratio, in pixels."""
    scale = F.least(shown_width / source_width, shown_height / source_height)
    left, top = (shown_width - source_width * scale) / 2, (shown_height - source_height * scale) / 2
    return F.struct(
        (left + roi["x"] * source_width * scale).alias("x"), (top + roi["y"] * source_height * scale).alias("y"),
        (roi["w"] * source_width * scale).alias("width"), (roi["h"] * source_height * scale).alias("height"),
    )


# How light, grey or yellow a pixel of on-screen text is.
LIGHT, GREY = 168, 72
YELLOW = {"floor": 145, "blue": 150, "red_blue": 55, "green_blue": 45, "red_green": 82, "luminance": 140, "chroma": 48}


def text_mask(pixels: bytes, width: int, height: int, colour: str = "white") -> np.ndarray:
    """Which pixels of an RGBA picture look like on-screen text, white or yellow."""
    rgba = np.frombuffer(pixels, np.uint8).reshape(height, width, 4).astype(np.int16)
    rgb, seen = rgba[:, :, :3], rgba[:, :, 3] > 0
    chroma = rgb.max(axis=2) - rgb.min(axis=2)
    if colour == "white":
        return seen & (rgb.min(axis=2) >= LIGHT) & (chroma <= GREY)
    red, green, blue = (rgb[:, :, k] for k in range(3))
    luminance = red * 0.2126 + green * 0.7152 + blue * 0.0722
    return (
        seen & (np.minimum(red, green) >= YELLOW["floor"]) & (blue <= YELLOW["blue"]) & (red - blue >= YELLOW["red_blue"]) & (green - blue >= YELLOW["green_blue"])
        & (abs(red - green) <= YELLOW["red_green"]) & (luminance >= YELLOW["luminance"]) & (chroma >= YELLOW["chroma"])
    )


@F.pandas_udf(T.StructType([T.StructField("foreground_ratio", T.DoubleType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))
def picture_fingerprint(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Foreground ratio of a picture and its 16 x 8 cells in 16 levels."""
    out = []
    for p, w, h in zip(pixels, width, height, strict=True):
        mask = text_mask(p, int(w), int(h))
        rows = np.linspace(0, mask.shape[0], 9).astype(int)
        columns = np.linspace(0, mask.shape[1], 17).astype(int)
        sums = np.pad(mask.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        cell = sums[np.ix_(rows[1:], columns[1:])] - sums[np.ix_(rows[:-1], columns[1:])] - sums[np.ix_(rows[1:], columns[:-1])] + sums[np.ix_(rows[:-1], columns[:-1])]
        area = np.outer(np.diff(rows), np.diff(columns))
        levels = np.floor(np.minimum(1, 4 * cell / np.maximum(area, 1)) * LEVELS + 0.5).astype(int)
        out.append((float(mask.mean()) if mask.size else 0.0, levels.ravel().tolist()))
    return pd.DataFrame(out, columns=["foreground_ratio", "cells"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def picture_occupancy(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The 32 x 12 occupancy grid of a picture, row by row."""
    return pd.Series([occupancy_grid(text_mask(p, int(w), int(h))).astype(int).ravel().tolist() for p, w, h in zip(pixels, width, height, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("top", T.IntegerType()), T.StructField("bottom", T.IntegerType())])))
def line_bands(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Runs of picture rows that hold text, gaps of up to two rows closed, runs of under three dropped."""
    out = []
    for p, w, h in zip(pixels, width, height, strict=True):
        held = np.flatnonzero(text_mask(p, int(w), int(h)).any(axis=1))
        parts = np.split(held, np.flatnonzero(np.diff(held) > 3) + 1) if len(held) else []
        out.append([{"top": int(b[0]), "bottom": int(b[-1])} for b in parts if b[-1] - b[0] >= 2])
    return pd.Series(out)
