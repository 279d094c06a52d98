"""Queries over parts that the small tables do not have."""

import pytest

from rasterloom.operators import pixels
from rasterloom.plans import registry
from tests.oracle import TABLES, compare


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """A folder's tables, where parts have other keys: make(parts) writes them."""
    import os

    def make(parts):
        at = tmp_path_factory.mktemp("parts")
        for t in TABLES:
            if t != "part":
                os.symlink(f"{sf_dir}/{t}.parquet", at / f"{t}.parquet")
        parts.write.parquet(f"{at}/part.parquet")
        return str(at)

    return make


def test_lossy_headers_of_frames_without_pixels(spark, sf_dir, folder):
    keys = spark.createDataFrame([(k * 16384 + d,) for k in range(8) for d in (-1, 0, 1) if k or d >= 0], "p_partkey long")
    at = folder(keys.selectExpr("p_partkey", "cast(1 + p_partkey % 50 as int) as p_size"))
    assert compare(registry.QUERIES["lossy_headers"](spark, at), registry.SQL["lossy_headers"], at) == 23


@pytest.mark.parametrize("name", ["cross_colour_apply", "cross_colour_fit", "cross_colour_round_trip", "rgb_to_yuv420", "yuv_to_rgb", "predictor_residuals", "code_costs"])
def test_no_table_of_pixels_is_broadcast(spark, sf_dir, name):
    """Spark takes pixels for as few as the rows that they were made from."""
    assert "Broadcast" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width,height", [(1, 1), (3, 2), (4, 3), (5, 5)])
def test_planes_of_odd_sizes(spark, width, height):
    """Chroma of cut quads from the nearest pixels, and pixels of the planes, against plain Python."""
    rgb = {(x, y): (40 * x + 9 * y, 200 - 30 * x, 20 + 50 * y) for x in range(width) for y in range(height)}
    rows = spark.createDataFrame([(1, x, y, *c, 255) for (x, y), c in rgb.items()], "img long, x long, y long, r long, g long, b long, a long")
    planes = pixels.yuv420(rows).cache()
    have = {(s.plane, s.x, s.y): s.v for s in planes.collect()}
    clip = lambda v: max(0, min(255, v))
    want = {("y", x, y): (16839 * r + 33059 * g + 6420 * b + 32768 + 1048576) >> 16 for (x, y), (r, g, b) in rgb.items()}
    for x in range((width + 1) // 2):
        for y in range((height + 1) // 2):
            quad = [rgb[min(2 * x + dx, width - 1), min(2 * y + dy, height - 1)] for dx in (0, 1) for dy in (0, 1)]
            r, g, b = map(sum, zip(*quad, strict=True))
            want["u", x, y], want["v", x, y] = clip((28800 * b - 9719 * r - 19081 * g + 131072 + 33554432) >> 18), clip((28800 * r - 24116 * g - 4684 * b + 131072 + 33554432) >> 18)
    assert have == want
    back = {(s.x, s.y): s.r for s in pixels.rgb_of(planes).collect()}
    assert back == {(x, y): clip((((want["y", x, y] * 19077) >> 8) + ((want["v", x // 2, y // 2] * 26149) >> 8) - 14234) >> 6) for x, y in rgb}
    planes.unpersist()
