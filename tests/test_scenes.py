import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysurvey.operators import scenes as C


def frame(spark, grid):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(grid)], "row long, col long, value double")


def test_visibility(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((8, 9)) * 10
    camera = {"x": 4.2, "y": 3.9, "z": 14.0}
    want = set()
    for (i, j), v in np.ndenumerate(grid):
        dx, dy = camera["x"] - (j + 0.5), camera["y"] - (i + 0.5)
        n = math.hypot(dx, dy)
        hidden = False
        for k in range(1, int(n) + 1):
            t = k / n
            r, c = math.floor(i + 0.5 + dy * t), math.floor(j + 0.5 + dx * t)
            if 0 <= r < 8 and 0 <= c < 9 and grid[r, c] > v + (camera["z"] - v) * t:
                hidden = True
        if not hidden:
            want.add((i, j))
    d = frame(spark, grid)
    assert {(r.row, r.col) for r in C.visible(d, d, camera, 1.0).collect()} == want


def test_cheapest_seam(spark):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 4, (6, 7)).astype(float)
    steep = np.zeros_like(grid)
    for (i, j), v in np.ndenumerate(grid):
        steep[i, j] = max(abs(v - grid[q]) for q in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= q[0] < 6 and 0 <= q[1] < 7)
    cost = np.where(steep >= 3, 0.0, 1.0)
    best = {(i, 0): cost[i, 0] for i in range(6)}
    heap = [(v, p) for p, v in best.items()]
    heapq.heapify(heap)
    while heap:
        v, (i, j) = heapq.heappop(heap)
        for q in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)):
            if 0 <= q[0] < 6 and 0 <= q[1] < 7 and v + cost[q] < best.get(q, math.inf):
                best[q] = v + cost[q]
                heapq.heappush(heap, (best[q], q))
    rows = C.cut_lines(frame(spark, grid).withColumn("source", F.lit("a")), "source", 3.0).orderBy("place").collect()
    path = [(r.row, r.col) for r in rows]
    assert path[0][1] == 0 and path[-1][1] == 6 and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in itertools.pairwise(path))
    assert sum(cost[p] for p in path) == min(best[i, 6] for i in range(6))


def test_packing_blocks():
    rng = np.random.default_rng(1)
    blocks = [(f"b{i}", int(w), int(h)) for i, (w, h) in enumerate(rng.integers(3, 60, (25, 2)))]
    places, width, height = C.packed(blocks)
    taken = np.zeros((height, width), int)
    for name, w, h in blocks:
        x, y = places[name]
        assert x + w <= width and y + h <= height
        taken[y : y + h, x : x + w] += 1
    assert taken.max() == 1 and C.packed([]) == ({}, 0, 0)


def test_photos_round_trip(spark, tmp_path):
    photos = spark.createDataFrame([("a.jpg", 1.5), ("b.jpg", None)], "filename string, latitude double")
    C.write_photos(photos, f"{tmp_path}/photos")
    back = {r.filename: r for r in C.read_photos(spark, f"{tmp_path}/photos").collect()}
    assert back["a.jpg"].latitude == 1.5 and back["b.jpg"].band_name == "RGB" and back["b.jpg"].focal_ratio == 0.85


def test_helpers(spark):
    assert C.shell_quoted('a"b') == '"a\\"b"' and C.related_path("/x/a.tif", postfix="_2", ext="png") == "/x/a_2.png" and C.is_url("https://example.org/a") and not C.is_url("a b")
    assert C.radii(0.1, 3) == [0.05, 0.1, 0.2]
    json = spark.createDataFrame([('[{"Raw":"base64:aGk="}]',)], "j string")
    assert bytes(json.select(C.decoded_field(F.col("j"), "Raw").alias("b")).first().b) == b"hi"
    cloud = spark.createDataFrame([(1.0, 300.0)], "x double, scalar_views double")
    assert C.fixed_views(cloud).first().views == 300
    with pytest.raises(ValueError):
        C.fixed_views(cloud.drop("scalar_views"))
    bands = spark.createDataFrame([tuple(range(7))], ", ".join(f"band_{i} int" for i in range(1, 8)))
    assert C.renamed_bands(bands, list("abcdefg")).columns == list("abcdefg") and C.renamed_bands(bands.drop("band_7"), list("abcdefg")).columns[0] == "band_1"
    images = spark.createDataFrame([("a", bytearray(b"xy"))], "path string, content binary")
    assert bytes(C.external_step(images, lambda b: b[::-1]).first().result) == b"yx"


def test_reconstructions_and_listing(spark):
    parts = spark.createDataFrame([("p", "1", 1.0, 2.0, 3.0)], "part string, id string, x double, y double, z double")
    seen = spark.createDataFrame([("p", "1", "a.jpg"), ("p", "2", "a.jpg")], "part string, track string, shot string")
    one = spark.createDataFrame([(1.0, 2.0, 3.0)] * 2, "latitude double, longitude double, altitude double")
    points, kept = C.merged_reconstructions(parts, seen, one)
    assert points.first().id == "p_1" and kept.count() == 1
    photos = spark.createDataFrame([("a.jpg", -85.61322729531112, 44.701151842605441, None)], "filename string, longitude double, latitude double, altitude double")
    assert C.utm_listing(photos, 16).first().x == "609,865.708"
