"""Image measurements on arrays built here, and the jobs that run them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.media import jobs, pixels
from winnow.operators import corpus


def checker(w=64, h=48, cell=3):
    y, x = np.mgrid[0:h, 0:w]
    return np.repeat((((x // cell + y // cell) % 2) * 255).astype(np.uint8)[:, :, None], 3, axis=2)


def noise(w, h, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_constant_images():
    for v in (0, 255):
        flat = np.full((40, 50, 3), v, dtype=np.uint8)
        m = pixels.spatial(flat)
        assert m["sharpness_lap"] == 0 and m["mean"] == v * 1.0 or abs(m["mean"] - v) < 1e-9
        assert pixels.perceptual_hash(flat) == 0 and pixels.high_frequency_ratio(flat) < 1e-6


def test_laplacian_matches_loops():
    img = noise(17, 13)
    g = pixels.gray(img)
    vals = [g[y, x - 1] + g[y, x + 1] + g[y - 1, x] + g[y + 1, x] - 4 * g[y, x] for y in range(1, 12) for x in range(1, 16)]
    assert abs(pixels.spatial(img)["sharpness_lap"] - np.var(vals)) < 1e-6


def test_resize_keeps_size_and_constant():
    img = noise(20, 30)
    assert (pixels.resize(img, 20, 30) == img).all()
    assert (pixels.resize(np.full((9, 7, 3), 77, np.uint8), 32, 32) == 77).all()


def test_hash_is_stable_under_brightness_and_bit_zero_unset():
    img = noise(64, 64)
    dim = (img * 0.5).astype(np.uint8)
    a, b = pixels.perceptual_hash(img), pixels.perceptual_hash(dim)
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4 and a & 1 == 0


def test_regions():
    img = checker(200, 120)
    assert pixels.region(img, -5, -5, 7, 7) is None and pixels.region(img, 0, 0, float("nan"), 5) is None
    assert pixels.region(img, 10, 10, 50, 40)["crop_width"] == 50


def test_naturalness_features_and_distance():
    f = pixels.naturalness_features(pixels.gray(noise(200, 200)))
    assert f.shape == (4, 36) and np.isfinite(f).all()
    assert pixels.naturalness_features(np.zeros((96, 96))) is None
    assert corpus.distance_from(f, f.mean(axis=0), np.cov(f, rowvar=False)) < 1e-6


def test_jobs_isolate_failures(spark):
    img = checker()
    ok = bytearray(img[:, :, ::-1].tobytes())
    rows = [("a", 48, 64, 3, ok), ("b", 48, 64, 3, bytearray(b"short"))]
    df = spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary")
    got = {r["path"]: r for r in jobs.extract_features(df).collect()}
    assert got["a"]["error"] is None and got["a"]["phash"] == pixels.perceptual_hash(img)
    assert got["b"]["error"] and got["b"]["phash"] is None
    boxes = spark.createDataFrame([("a", 1, 0.0, 0.0, 30.0, 30.0), ("a", 2, 0.0, 0.0, 1.0, 1.0)], "path string, box_id long, x double, y double, w double, h double")
    assert [r["box_id"] for r in jobs.measure_regions(df, boxes).collect()] == [1]
    assert jobs.scope_rows(df.filter("path = 'a'")).first()["r"][255] > 0
    made = jobs.render_previews(df.filter("path = 'a'"), edges=(16, 320))
    assert {(r["edge"], r["preview_width"]) for r in made.collect()} == {(16, 16), (320, 64)}
    asked = spark.createDataFrame([("a", 0.0, 0.0, 0.5, 0.5)], "path string, x double, y double, w double, h double")
    first = jobs.measure_details(df, asked)
    assert first.first()["state"] == "measured" and jobs.measure_details(df, asked, done=first).count() == 0


def test_inference_records_row_errors(spark):
    def infer(_, values):
        if any(v < 0 for v in values):
            raise ValueError("negative")
        return [[float(v)] for v in values]

    df = spark.createDataFrame([(1, 2), (2, -1), (3, 4)], "photo_id long, v long").repartition(1)
    out = jobs.batch_infer(df, open_session=lambda: None, infer=infer, inputs="v", schema="photo_id long, vector array<float>, error string")
    assert {r["photo_id"]: r["error"] for r in out.collect()} == {1: None, 2: "negative", 3: None}


def test_occlusion_only_hides(spark):
    df = spark.createDataFrame([(1, "open", 0.9, None), (2, "open", 0.1, None), (3, None, 0.9, "dark"), (4, "open", None, None)], "id int, state string, visible_fraction double, reason string")
    got = {r["id"]: r["state"] for r in jobs.hide_occluded(df, minimum=0.5).collect()}
    assert got == {1: "open", 2: None, 3: None, 4: None}


def test_doubled_sizes_resize_by_matrix_products(monkeypatch):
    """The spectrum's 128 x 128 needs no einsum for a picture of 32 x 32, and is what it gives."""
    rng = np.random.default_rng(5)
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: pytest.fail("einsum"))
    for height, width in ((32, 32), (64, 16)):
        rgb = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
        for size in (64, 128):
            rows = einsum("ts,swc->twc", pixels.triangle_weights(height, size), rgb.astype(np.float64))
            want = np.clip(np.rint(einsum("ts,hsc->htc", pixels.triangle_weights(width, size), rows)), 0, 255).astype(np.uint8)
            assert (pixels.resize(rgb, size, size) == want).all()


def test_pictures_are_dealt_by_their_number(spark):
    """Narrow rows fill few splits: a task would grow with the table."""
    from winnow.session import spread

    rows = spark.range(1000, numPartitions=1).withColumn("v", F.lit(1))
    assert spread(rows, "id", rows=50).rdd.getNumPartitions() == 20
    assert spread(rows, "id", rows=5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
