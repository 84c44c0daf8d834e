"""Catalogue queries over whole tables."""

import numpy as np
import pytest

from plumbline.operators import archive, matching
from plumbline.plans import catalogue


def test_every_vector_with_an_id_divisible_by_50_is_a_query(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in e])
    x = np.array([r["embedding"] for r in e], float)
    want = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        a, b = [k for k in np.lexsort((ids, d)) if ids[k] != i][:2]
        if i % 50 == 0 and d[a] < 0.95 * d[b]:
            want[i] = ids[a]
    assert {r["q_id"]: r["t_id"] for r in catalogue.QUERIES["q30_knn_ratio"](spark, sf_dir).collect()} == want


def test_every_event_is_streamed_and_matched(spark, sf_dir):
    events = {r["event_id"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    for name, key in (("q34_incremental_runner", "event_id"), ("q25_archive_window_match", "obs_id")):
        assert sorted(r[key] for r in catalogue.QUERIES[name](spark, sf_dir).collect()) == sorted(events), name
    assert sum(r["n"] for r in catalogue.QUERIES["q28_status_counts"](spark, sf_dir).collect()) == len(events)


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_nearest_apart_from_itself(spark, metric):
    r = np.random.default_rng(2)
    x = r.integers(0, 255, (60, 8))
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for row in matching.nearest(d.select(d.id.alias("q_id"), "vec"), d.select(d.id.alias("t_id"), "vec"), k=3, metric=metric, block=16, apart=True).collect():
        got.setdefault(row["q_id"], []).append((row["rank"], row["t_id"]))
    far = np.bitwise_count((x[:, None] ^ x[None]).astype(np.uint8)).sum(2) if metric == "hamming" else ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), far[i])) if j != i][:3]
        assert sorted(got[i]) == [(n + 1, j) for n, j in enumerate(order)]


def test_ransac_leaves_out_a_strayed_point_whose_model_has_more_inliers(spark):
    rows = [(1, float(x), 0.0, 0.8 * x + 12, 0.3 * x - 7) for x in range(0, 800, 20)] + [(1, 1000.0, 0.0, 0.8 * 1000 + 12, 0.3 * 1000 - 7 + 3.5)]
    got = matching.fit_similarity(spark.createDataFrame(rows, "pair_id long, qx double, qy double, tx double, ty double")).collect()
    assert [(r["matches"], r["inliers"], round(r["a"], 9), round(r["b"], 9)) for r in got] == [(41, 40, 0.8, 0.3)]


def test_pixels_behind_an_explode_are_not_broadcast(spark, monkeypatch):
    pixels = spark.range(50).selectExpr("id AS image_id", "explode(sequence(0, 99)) AS x").selectExpr("image_id", "cast((image_id * 7 + x * 13) % 101 AS double) AS value")

    def joined(most):
        monkeypatch.setattr(archive, "MOST_EXTREMES", most)
        d = archive.to_uint8(pixels).select("image_id", "value", "u8")
        plan = d._jdf.queryExecution().executedPlan().toString()
        return plan, sorted(map(tuple, d.collect()))

    few, rows = joined(50)
    assert "BuildRight" in few and "BuildLeft" not in few
    many, again = joined(49)
    assert "SortMergeJoin" in many and "Broadcast" not in many
    assert rows == again and len(rows) == 5000
