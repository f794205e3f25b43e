"""Mask kernels against plain loops over pixels, and the statistics of a pack."""

import random

import duckdb
import numpy as np
import pytest

from logloom.functions import masks
from logloom.plans import replays
from logloom.plans.queries import ORACLES


def flood(mask):
    """(pixels, width, height) of each component, by flood fill."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        ys, xs = zip(*own, strict=True)
        out.append((len(own), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(out)


def pictures():
    rng = np.random.default_rng(4)
    for share in (0.1, 0.4, 0.6, 0.9):
        for shape in ((1, 1), (1, 40), (30, 1), (17, 23), (40, 64)):
            yield rng.random(shape) < share
    spiral = np.ones((9, 9), bool)
    spiral[1, :8] = spiral[1:8, 7] = spiral[7, 1:8] = spiral[3:8, 1] = spiral[3, 1:6] = False
    yield spiral
    yield np.zeros((5, 7), bool)
    yield np.zeros((0, 7), bool)


def test_components_are_those_of_a_flood_fill():
    for mask in pictures():
        found = sorted(zip(*(a.tolist() for a in masks.component_table(mask)), strict=True))
        assert found == flood(mask)
        n, largest, share, text_like = masks.component_metrics(mask)
        assert (n, largest) == (len(found), max((c[0] for c in found), default=0))
        assert share == pytest.approx(largest / max(1, mask.sum()))
        assert text_like == sum(p >= 2 and w >= 2 and (w * h <= 6 or p / (w * h) <= 0.92) for p, w, h in found)


def test_components_of_null_and_short_masks(spark):
    rows = spark.createDataFrame([(1, None, 4), (2, [], 4), (3, [True, None, True, False, True], 2), (4, [True], None)], "id int, cells array<boolean>, width int")
    got = {r["id"]: tuple(r["m"]) for r in rows.select("id", masks.mask_components("cells", "width").alias("m")).collect()}
    assert got == {1: (0, 0, 0.0, 0), 2: (0, 0, 0.0, 0), 3: (1, 2, 1.0, 0), 4: (1, 1, 1.0, 0)}


def plain_bands(mask):
    """Rows to bands, row by row; (top, height, pixels, peak, raw top, raw end)."""
    counts = [sum(map(bool, r)) for r in mask]
    wide = mask.shape[1]
    raw, start, last = [], None, None
    for r, n in enumerate(counts):
        if n >= max(2, -(-wide * 4 // 1000)) or n / wide >= 0.0025:
            start, last = (r if start is None else start), r
        elif start is not None and r - last > 2:
            raw.append((start, last + 1))
            start = None
    if start is not None:
        raw.append((start, last + 1))
    out = []
    for a, b in raw:
        top, end = max(0, a - 2), min(len(counts), b + 2)
        held = sum(counts[top:end])
        if end - top >= 2 and held >= 6 and held / ((end - top) * wide) <= 0.36:
            out.append((top, end - top, held, max(counts[top:end]), a, b))
    return out


def written_page(rng):
    """A page with lines of text, some with small readings above them."""
    page = np.zeros((120, 160), bool)
    at = rng.randrange(3, 12)
    while at < 100:
        if rng.random() < 0.6:
            page[at : at + 3, 20:90:6] = rng.random() < 0.9
            at += rng.choice([5, 6, 9, 14])
        height = rng.choice([4, 8, 12])
        page[at : at + height, 10:150:4] = True
        at += height + rng.choice([1, 3, 7, 15])
    return page


def test_bands_and_their_annotations():
    rng = random.Random(3)
    marked_any = merged_any = 0
    for _ in range(60):
        page = written_page(rng)
        bands = masks.bands_of(page)
        expected = plain_bands(page)
        assert [tuple(map(int, b)) for b in bands.to_numpy()] == expected
        marks = []
        for k, (top, height, pixels, peak, _, _) in enumerate(expected):
            low = expected[k + 1] if k + 1 < len(expected) else None
            marks.append(bool(low) and low[1] >= 6 and pixels >= 8 and height <= max(3, low[1] * 0.62) and pixels <= low[2] * 0.45 and peak >= 3 and low[0] - top - height <= max(4, -(-low[1] * 45 // 100)))
        found = masks.annotations(bands, page.shape[1])
        assert found.tolist() == marks
        merged = masks.merged_bands(page, bands, found)
        assert len(merged) == len(bands) - sum(m and not (k and marks[k - 1]) for k, m in enumerate(marks))
        assert sum(b[4] for b in merged) == len(bands) - len(merged)
        left = page.copy()
        for k, m in enumerate(marks):
            if m:
                left[expected[k][4] : expected[k][5]] = False
        assert (masks.without_annotations(page) == left).all()
        marked_any += sum(marks)
        merged_any += len(merged)
    assert marked_any > 10 and merged_any > 60
    assert masks.bands_of(np.zeros((4, 5), bool)).empty and masks.bands_of(np.zeros((0, 5), bool)).empty


def test_regions_are_direct_sums(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(-9, 9, (7, 11))
    sums = masks.summed_areas(values)
    for _ in range(300):
        top, bottom, left, right = rng.integers(-3, 15, 4).tolist()
        assert masks.area_sum(sums, top, bottom, left, right) == values[max(0, top) : max(0, bottom), max(0, left) : max(0, right)].sum()
    rows = spark.createDataFrame([(1, [1, 2, 3, 4], [(0, 0, 2, 2), (1, 0, 9, 9), (0, 0, 0, 4)]), (2, None, []), (3, [], [(0, 0, 1, 1)])], "id int, v array<long>, r array<struct<x:int,y:int,w:int,h:int>>")
    got = {r["id"]: r["s"] for r in rows.select("id", masks.region_sums("v", masks.F.lit(2), "r").alias("s")).collect()}
    assert got == {1: [10, 6, 0], 2: None, 3: [0]}


def painted(width, height, paint):
    picture = np.zeros((height, width, 4), np.uint8)
    picture[:, :, 3] = 255
    for (top, bottom, left, right), colour in paint:
        picture[top:bottom, left:right, :3] = colour
    return picture.tobytes()


def test_detectors_of_panel_and_splash(spark):
    panel = [((2, 12, 2, 58), (210, 60, 90)), ((12, 14, 0, 60), (240, 240, 240)), ((14, 40, 0, 60), (30, 30, 30)), ((26, 29, 5, 50), (60, 220, 80))]
    splash = [((4, 34, 4, 56), (180, 60, 220)), ((10, 14, 0, 60), (10, 10, 10))] + [((0, 40, x, x + 1), (250, 250, 250)) for x in range(2, 58, 9)]
    rows = [(1, painted(60, 40, panel), True), (2, painted(60, 40, panel), False), (3, painted(60, 40, splash), True), (4, painted(60, 40, []), True)]
    df = spark.createDataFrame(rows, "id int, pixels binary, theirs boolean")
    w, h = masks.F.lit(60), masks.F.lit(40)
    got = {r["id"]: r for r in df.select("id", masks.panel_signals("pixels", w, h, "theirs").alias("p"), masks.splash_signals("pixels", w, h).alias("s")).collect()}
    # The colours of the splash are also those of a plate; the two detectors look at different places.
    assert [got[k]["p"]["visible"] for k in (1, 2, 4)] == [True, False, False]
    assert [got[k]["s"]["visible"] for k in (1, 2, 3, 4)] == [False, False, True, False]
    assert masks.panel_signal(b"", 0, 0, True)[-1] is False and masks.splash_signal(b"", 0, 0)[-1] is False


def test_the_panel_by_plain_counting():
    rng = np.random.default_rng(7)
    for _ in range(20):
        picture = rng.integers(0, 256, (25, 31, 4), np.uint8)
        picture[:10, :20, :3] = (200, 70, 110)
        score, plate, frame, dark, bar, _ = masks.panel_signal(picture.tobytes(), 31, 25, True)
        count = {"plate": 0, "white": 0, "dark": 0}
        rows = [0] * 15
        for y in range(25):
            for x in range(31):
                r, g, b = map(int, picture[y, x, :3])
                light, most = 0.2126 * r + 0.7152 * g + 0.0722 * b, max(r, g, b)
                vivid = (most - min(r, g, b)) / most if most else 0
                if y < 15 and light >= 48 and vivid >= 0.42 and r >= 128 and r >= g + 42 and b >= 42:
                    count["plate"] += 1
                    rows[y] += 1
                count["white"] += light >= 180 and vivid <= 0.3 and abs(r - g) <= 46
                count["dark"] += y >= 8 and light <= 76
        clamp = lambda v, a, b: min(1, max(0, (v - a) / (b - a)))
        assert plate == pytest.approx(min(1, clamp(sum(n >= 7 for n in rows) / 15, 0.06, 0.24) * 0.68 + clamp(count["plate"] / (31 * 15), 0.035, 0.28) * 0.32))
        assert frame == pytest.approx(clamp(count["white"] / 775, 0.008, 0.075)) and dark == pytest.approx(clamp(count["dark"] / (31 * 17), 0.16, 0.68))
        assert score == pytest.approx(min(1, plate * 0.5 + frame * 0.24 + dark * 0.2 + bar * 0.06))


def test_pack_statistics_count_nulls_and_repeats(spark):
    from logloom.sources import rulesets

    rows = [("a", 1, "x", True, "faint"), ("a", 2, "x", True, "faint"), ("b", 1, "x", True, "faint"), ("b", 2, "y", None, "move"), ("b", 3, None, True, None), (None, 4, "x", False, "faint")]
    got = {(r["scope"], r["file"], r["event_type"]): tuple(r)[3:] for r in rulesets.pack_statistics(spark.createDataFrame(rows, "file string, key int, text string, candidate boolean, event_type string")).collect()}
    assert got["all", None, None] == (6, 4, 3, 2, 3)
    assert got["file", "a", None] == (2, 2, 2, 1, 0) and got["file", "b", None] == (3, 2, 1, 1, 2) and got["file", None, None] == (1, 0, 0, 0, 1)
    assert got["type", None, "faint"] == (3, 3, 3, 2, 0) and got["file_type", "b", "faint"] == (1, 1, 1, 1, 0)
    assert rulesets.pack_statistics(spark.createDataFrame([], "file string, key int, text string, candidate boolean, event_type string")).collect() == []


def test_pictures_with_missing_vectors_have_all_their_rows(spark, tmp_path):
    vectors = [(k, [0.2 if (k + i) % 4 == 0 else 0.0 for i in range(64)]) for k in (0, 1, 2, 3, 4, 6, 7, 8)]
    spark.createDataFrame([*vectors, (None, [0.2] * 64), (9, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        expected = sorted(connection.sql(ORACLES["picture_bands"]).fetchall())
    found = sorted(map(tuple, replays.picture_bands(spark, str(tmp_path)).collect()))
    assert {r[0] for r in found} == {0, 1, 2} and found == expected
