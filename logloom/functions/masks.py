"""Kernels over masks and pictures: components by runs, line bands and their annotations, regions by summed areas.

Each picture is a row of its own; the kernels run in Arrow UDFs, vectorised over the pixels of a picture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grid(cells: object, width: int, kind: type = bool) -> np.ndarray:
    """Cells row by row as a grid; null cells are empty, cells of a last, short row are left out, a missing width is one."""
    flat = np.array([] if cells is None else [0 if c is None else c for c in cells], kind)
    wide = max(0 if pd.isna(width) else int(width), 1)
    return flat[: len(flat) // wide * wide].reshape(-1, wide)


def runs_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column behind the last) of the runs of set cells, row by row."""
    steps = np.diff(np.pad(rows.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(steps == 1)
    return row, first, np.nonzero(steps == -1)[1]


def component_table(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pixels, width and height of each 4-connected component: runs are joined with those of the row above that they touch."""
    row, first, end = runs_of(mask)
    parent = list(range(len(row)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    above = 0
    for k in range(len(row)):
        while above < k and (row[above] < row[k] - 1 or row[above] == row[k] - 1 and end[above] <= first[k]):
            above += 1
        touching = above
        while touching < k and row[touching] == row[k] - 1 and first[touching] < end[k]:
            a, b = root(touching), root(k)
            parent[max(a, b)] = min(a, b)
            touching += 1
    _, of = np.unique(np.array([root(k) for k in range(len(row))], int), return_inverse=True)
    n = int(of.max(initial=-1)) + 1
    pixels = np.bincount(of, end - first, n).astype(int)
    left, right, top, bottom = np.full(n, mask.shape[1]), np.zeros(n, int), np.full(n, mask.shape[0]), np.zeros(n, int)
    np.minimum.at(left, of, first)
    np.maximum.at(right, of, end)
    np.minimum.at(top, of, row)
    np.maximum.at(bottom, of, row)
    return pixels, right - left, bottom - top + 1


COMPONENTS = T.StructType([T.StructField("count", T.IntegerType()), T.StructField("largest", T.IntegerType()), T.StructField("largest_share", T.DoubleType()), T.StructField("text_like", T.IntegerType())])


def component_metrics(mask: np.ndarray) -> tuple[int, int, float, int]:
    """Components, pixels of the largest, its share of all set pixels, and how many look like parts of
    letters: two pixels and columns at least, and not a filled block unless it is tiny."""
    pixels, width, height = component_table(mask)
    if not len(pixels):
        return 0, 0, 0.0, 0
    area = width * height
    text_like = (pixels >= 2) & (width >= 2) & ((area <= 6) | (pixels / area <= 0.92))
    return len(pixels), int(pixels.max()), float(pixels.max() / pixels.sum()), int(text_like.sum())


@F.pandas_udf(COMPONENTS)
def mask_components(cells: pd.Series, width: pd.Series) -> pd.DataFrame:
    """component_metrics of masks given as arrays of booleans, row by row; a null mask has none."""
    return pd.DataFrame([component_metrics(grid(c, w)) for c, w in zip(cells, width, strict=True)], columns=COMPONENTS.names)


# How rows become bands, and when a band is an annotation of the one below it.
ROW_LEAST, ROW_SHARE, MERGE_GAP, PADDING, BAND_HEIGHT, BAND_PIXELS, BAND_SHARE = 2, 0.0025, 2, 2, 2, 6, 0.36


def bands_of(mask: np.ndarray, gap: int = MERGE_GAP, padding: int = PADDING, height: int = BAND_HEIGHT, pixels: int = BAND_PIXELS, share: float = BAND_SHARE) -> pd.DataFrame:
    """Bands of rows that hold text: top, height, pixels, peak (pixels of the fullest row), raw_top, raw_end.

    Active rows at most gap empty rows apart are one band; it is padded, and kept if it is high and full enough, but
    not nearly filled.
    """
    return row_bands_of(mask.sum(axis=1), mask.shape[1], gap, padding, height, pixels, share)


def row_bands_of(rows: np.ndarray, wide: int, gap: int = MERGE_GAP, padding: int = PADDING, height: int = BAND_HEIGHT, pixels: int = BAND_PIXELS, share: float = BAND_SHARE) -> pd.DataFrame:
    """The same from the set cells of each row."""
    active = np.flatnonzero((rows >= max(ROW_LEAST, int(np.ceil(wide * 0.004)))) | (rows >= ROW_SHARE * wide) & (wide > 0) & (rows > 0))
    parts = [p for p in np.split(active, np.flatnonzero(np.diff(active) > gap + 1) + 1) if len(p)]
    out = []
    for part in parts:
        raw_top, raw_end = int(part[0]), int(part[-1]) + 1
        top, end = max(0, raw_top - padding), min(len(rows), raw_end + padding)
        held = int(rows[top:end].sum())
        if end - top >= height and held >= pixels and held <= share * (end - top) * wide:
            out.append((top, end - top, held, int(rows[top:end].max()), raw_top, raw_end))
    return pd.DataFrame(out, columns=["top", "height", "pixels", "peak", "raw_top", "raw_end"])


def annotations(bands: pd.DataFrame, wide: int) -> np.ndarray:
    """Which bands are small, sparse lines close above a line of text, as readings set over words are."""
    low = bands.shift(-1)
    gap = low["top"] - (bands["top"] + bands["height"])
    found = (
        (low["height"] >= 6) & (bands["pixels"] >= 8) & (bands["height"] <= np.maximum(3, low["height"] * 0.62)) & (bands["pixels"] <= low["pixels"] * 0.45)
        & (bands["peak"] >= max(3, int(np.ceil(wide * 0.006)))) & (gap <= np.maximum(4, np.ceil(low["height"] * 0.45)))
    )
    return found.to_numpy(bool)


def merged_bands(mask: np.ndarray, bands: pd.DataFrame, marked: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(top, height, pixels, peak, annotated) of the bands, each annotation in one with the band below it."""
    rows, out, k = mask.sum(axis=1), [], 0
    while k < len(bands):
        last = k + 1 if marked[k] and k + 1 < len(bands) else k
        top = int(bands["top"].iloc[k])
        end = max(int(bands["top"].iloc[j] + bands["height"].iloc[j]) for j in range(k, last + 1))
        if last == k:
            out.append((top, end - top, int(bands["pixels"].iloc[k]), int(bands["peak"].iloc[k]), False))
        else:
            out.append((top, end - top, int(rows[top:end].sum()), int(rows[top:end].max()), True))
        k = last + 1
    return out


def without_annotations(mask: np.ndarray, **options: float) -> np.ndarray:
    """The mask without the rows of its annotations."""
    bands = bands_of(mask, **options)
    out = mask.copy()
    for top, end in bands.loc[annotations(bands, mask.shape[1]), ["raw_top", "raw_end"]].to_numpy():
        out[top:end] = False
    return out


BANDS = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("top", "height", "pixels", "peak")), T.StructField("annotated", T.BooleanType())]))


@F.pandas_udf(BANDS)
def mask_bands(cells: pd.Series, width: pd.Series) -> pd.Series:
    """The bands of masks given as arrays of booleans, annotations merged with the band below."""

    def of(c: object, w: int) -> list[tuple]:
        mask = grid(c, w)
        bands = bands_of(mask)
        return merged_bands(mask, bands, annotations(bands, mask.shape[1]))

    return pd.Series([of(c, w) for c, w in zip(cells, width, strict=True)], dtype=object)


def raw_bands(bands: pd.DataFrame, wide: int) -> list[tuple]:
    return [(*map(int, row), bool(small)) for row, small in zip(bands[["top", "height", "pixels", "peak"]].to_numpy(), annotations(bands, wide), strict=True)]


@F.pandas_udf(BANDS)
def mask_raw_bands(cells: pd.Series, width: pd.Series) -> pd.Series:
    """The bands themselves, annotated where a band is an annotation of the one below."""

    def of(c: object, w: int) -> list[tuple]:
        mask = grid(c, w)
        return raw_bands(bands_of(mask), mask.shape[1])

    return pd.Series([of(c, w) for c, w in zip(cells, width, strict=True)], dtype=object)


@F.pandas_udf(BANDS)
def row_raw_bands(rows: pd.Series, width: pd.Series) -> pd.Series:
    """The same from the set cells of each row of a mask of that width."""
    return pd.Series([raw_bands(row_bands_of(np.asarray(r), int(w)), int(w)) for r, w in zip(rows, width, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def mask_without_annotations(cells: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([without_annotations(grid(c, w)).ravel().tolist() for c, w in zip(cells, width, strict=True)], dtype=object)


def summed_areas(values: np.ndarray) -> np.ndarray:
    """Sums of all cells above and left of each corner: any rectangle's sum is then four look-ups."""
    return np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def area_sum(sums: np.ndarray, top: int, bottom: int, left: int = 0, right: int | None = None) -> float:
    """The sum over rows top to bottom and columns left to right, ends excluded, cut to the grid."""
    high, wide = sums.shape[0] - 1, sums.shape[1] - 1
    top, bottom = (min(max(v, 0), high) for v in (top, bottom))
    left, right = (min(max(v, 0), wide) for v in (left, wide if right is None else right))
    if bottom <= top or right <= left:
        return sums.dtype.type(0)
    return sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]


@F.pandas_udf(T.ArrayType(T.LongType()))
def region_sums(values: pd.Series, width: pd.Series, regions: pd.Series) -> pd.Series:
    """Sums of whole numbers over regions (x, y, w, h, in cells) of a grid; null where there is no grid."""
    out = []
    for v, w, rs in zip(values, width, regions, strict=True):
        sums = None if v is None else summed_areas(grid(v, w, np.int64))
        out.append(None if sums is None or rs is None else [int(area_sum(sums, r["y"], r["y"] + r["h"], r["x"], r["x"] + r["w"])) for r in rs])
    return pd.Series(out, dtype=object)


# Weights and bounds of the detectors of the status panel and of the opening splash.
PANEL = {"visible": 0.52, "plate": 0.38, "frame": 0.12, "dark": 0.12}
SPLASH = {"visible": 0.58, "purple": 0.34, "area": 0.34}


def between(value: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (value - low) / (high - low)))


def colours(pixels: bytes, width: int, height: int) -> tuple[np.ndarray, ...]:
    """Red, green, blue, luminance and saturation of an RGBA picture."""
    rgb = np.frombuffer(pixels, np.uint8).reshape(height, width, 4)[:, :, :3].astype(float)
    most, least = rgb.max(axis=2), rgb.min(axis=2)
    red, green, blue = (rgb[:, :, k] for k in range(3))
    return red, green, blue, 0.2126 * red + 0.7152 * green + 0.0722 * blue, np.where(most > 0, (most - least) / np.maximum(most, 1), 0.0)


def full_rows(mask: np.ndarray, least: float) -> float:
    """Score of the share of rows of which at least that share is set."""
    strong = (mask.sum(axis=1) >= max(2, int(np.ceil(mask.shape[1] * least)))).sum()
    return between(strong / max(1, mask.shape[0]), 0.06, 0.24)


PANEL_OUT = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("score", "plate", "frame", "dark", "bar")), T.StructField("visible", T.BooleanType())])


def panel_signal(pixels: bytes, width: int, height: int, theirs: bool) -> tuple:
    """Whether a picture of a status panel's place shows the panel: a coloured plate above, a light frame, a
    dark ground below and a bar of health. Each region is a few look-ups in the summed areas of its colour."""
    if not width or not height:
        return 0.0, 0.0, 0.0, 0.0, 0.0, False
    red, green, blue, light, vivid = colours(pixels, width, height)
    if theirs:
        plate = (light >= 48) & (vivid >= 0.42) & (red >= 128) & (red >= green + 42) & (blue >= 42)
    else:
        plate = (light >= 38) & (vivid >= 0.38) & (blue >= 102) & (blue >= green + 30) & (blue >= red + 28) & (red >= 42)
    white = (light >= 180) & (vivid <= 0.3) & (np.abs(red - green) <= 46)
    warm = (red >= 145) & (green >= 78) & (red >= blue + 54) | (red >= 150) & (red >= green + 48) & (red >= blue + 48)
    bar = (light >= 70) & (vivid >= 0.46) & ((green >= 128) & (green >= red + 12) & (green >= blue + 28) | warm)
    upper, lower, bars = max(1, int(height * 0.62)), min(height - 1, int(height * 0.32)), min(height - 1, int(height * 0.46))
    share = lambda mask, top, end: float(area_sum(summed_areas(mask.astype(np.int64)), top, end)) / max(1, (end - top) * width)
    plates = min(1.0, full_rows(plate[:upper], 0.2) * 0.68 + between(share(plate, 0, upper), 0.035, 0.28) * 0.32)
    frames = between(share(white, 0, height), 0.008, 0.075)
    darks = between(share(light <= 76, lower, height), 0.16, 0.68)
    health = min(1.0, full_rows(bar[bars:], 0.13) * 0.7 + between(share(bar, bars, height), 0.008, 0.12) * 0.3)
    score = min(1.0, plates * 0.5 + frames * 0.24 + darks * 0.2 + health * 0.06)
    return score, plates, frames, darks, health, bool(score >= PANEL["visible"] and plates >= PANEL["plate"] and frames >= PANEL["frame"] and darks >= PANEL["dark"])


SPLASH_OUT = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("score", "purple", "edges", "area")), T.StructField("visible", T.BooleanType())])


def splash_signal(pixels: bytes, width: int, height: int) -> tuple:
    """Whether a picture shows the opening splash: large purple areas, bright ones and hard edges."""
    if not width or not height:
        return 0.0, 0.0, 0.0, 0.0, False
    red, green, blue, light, vivid = colours(pixels, width, height)
    purple = (light >= 62) & (vivid >= 0.42) & (red >= 105) & (blue >= 120) & (red >= green + 22) & (blue >= green + 26)
    bright = (light >= 138) & (vivid >= 0.3) & (red >= 125) & (blue >= 135)
    edges = between((np.abs(np.diff(light, axis=1)) >= 70).sum() / (width * height), 0.03, 0.18)
    share = float(purple.mean())
    rows = (purple.sum(axis=1) >= max(2, int(np.ceil(width * 0.08)))).mean()
    columns = (purple.sum(axis=0) >= max(2, int(np.ceil(height * 0.08)))).mean()
    area = min(1.0, between(min(rows, columns), 0.18, 0.58) * 0.72 + between(share, 0.08, 0.34) * 0.28)
    purples = between(share, 0.05, 0.27)
    score = min(1.0, purples * 0.42 + area * 0.34 + edges * 0.16 + between(float(bright.mean()), 0.02, 0.16) * 0.08)
    return score, purples, edges, area, bool(score >= SPLASH["visible"] and purples >= SPLASH["purple"] and area >= SPLASH["area"])


@F.pandas_udf(PANEL_OUT)
def panel_signals(pixels: pd.Series, width: pd.Series, height: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([panel_signal(p, int(w), int(h), bool(t)) for p, w, h, t in zip(pixels, width, height, theirs, strict=True)], columns=PANEL_OUT.names)


@F.pandas_udf(SPLASH_OUT)
def splash_signals(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([splash_signal(p, int(w), int(h)) for p, w, h in zip(pixels, width, height, strict=True)], columns=SPLASH_OUT.names)
