"""Pairs and matches of boxes: small images are paired as they are, crowded ones through a grid, clusters in many tasks."""

import random

from winnow.operators import evaluate

SCHEMA = "image long, {} long, box struct<x double, y double, w double, h double>"


def sides(spark, images):
    rng = random.Random(5)
    box = lambda: (rng.random(), rng.random(), 0.1 + rng.random() * 0.3, 0.1 + rng.random() * 0.3)
    pred = [(image, image * 1000 + i, box()) for image, n in images.items() for i in range(n)]
    truth = [(image, i, (x + 0.02, y, w, h)) for image, i, (x, y, w, h) in pred if i % 3]
    return pred, truth, spark.createDataFrame(pred, SCHEMA.format("pred_id")), spark.createDataFrame(truth, SCHEMA.format("truth_id"))


def overlap(a, b):
    width = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    height = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    inter = width * height
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def test_small_and_crowded_images_give_all_pairs(spark):
    pred, truth, p, t = sides(spark, {1: 4, 2: 400, 3: 7})
    want = {(i, a, b) for i, a, x in pred for j, b, y in truth if i == j and overlap(x, y) >= 0.3}
    got = [(r.image, r.pred_id, r.truth_id) for r in evaluate.box_edges(p, t, image="image", threshold=0.3).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_box_without_a_place_meets_none(spark):
    rows = [(1, 1, (None, 0.1, 0.2, 0.2)), (1, 2, (0.1, None, 0.2, 0.2)), (1, 3, (0.1, 0.1, None, 0.2)), (1, 4, (0.1, 0.1, 0.2, 0.2))]
    p, t = spark.createDataFrame(rows, SCHEMA.format("pred_id")), spark.createDataFrame(rows, SCHEMA.format("truth_id"))
    assert [(r.pred_id, r.truth_id) for r in evaluate.box_edges(p, t, image="image", threshold=0.3).collect()] == [(4, 4)]


def test_boxes_of_small_images_are_not_copied_into_cells(spark):
    _, _, p, t = sides(spark, {i: 4 for i in range(1, 6)})
    edges = evaluate.box_edges(p, t, image="image", threshold=0.3)
    assert "Generate" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_are_solved_in_many_tasks(spark):
    _, _, p, t = sides(spark, {i: 6 for i in range(1, 40)})
    found = evaluate.match_boxes(p, t, image="image", threshold=0.3)
    rows = found.collect()
    assert len({(r.image, r.pred_id) for r in rows}) == len({(r.image, r.truth_id) for r in rows}) == len(rows) > 39
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
