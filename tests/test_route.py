"""Routes of vectors that lie away from all centroids."""

from __future__ import annotations

from quarry.operators import retrieval


def test_negative_scores(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.1], 0), (2, [-1.0, -0.2], 0), (3, [0.0, 0.0], 0)], "id long, v array<double>, label int").drop("label")
    centers = spark.createDataFrame([(4, [1.0, 0.0]), (5, [0.0, 1.0])], "label int, centroid array<double>")
    assert {r.id: r.route for r in retrieval.route(vectors, centers).collect()} == {1: 4, 2: 5, 3: 4}
    assert {r.id: r.route for r in retrieval.route(vectors, centers, 0.0).collect()} == {1: 4, 2: None, 3: 4}
