"""Descriptor matching: nearest neighbours, ratio test, similarity fits, regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources import shared


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of rows of x and y; hamming counts differing bits of bytes 0 to 255."""
    if metric == "hamming":
        return np.stack([np.bitwise_count(v.astype(np.uint8) ^ y.astype(np.uint8)).sum(1, dtype=float) for v in x]) if len(x) else np.zeros((0, len(y)))
    return np.stack([np.sqrt(((y - v) ** 2).sum(1)) for v in x]) if len(x) else np.zeros((0, len(y)))  # no cancellation, as in |x|^2 + |y|^2 - 2 x y


def nearest(queries: DataFrame, train: DataFrame, k: int = 2, metric: str = "l2", block: int = 1024, apart: bool = False, most_blocks: int = 16) -> DataFrame:
    """Queries (q_id, vec) against all train rows (t_id, vec): the k nearest of each, by (distance,
    t_id): q_id, t_id, distance, rank. metric l2 (arrays of numbers) or hamming (arrays of bytes 0
    to 255). apart leaves out the train row of the query's own id.

    Up to most_blocks blocks of queries meet each part of the train rows once, in one matrix computation a block. More
    queries go through pivots (nearest_by_pivots): each visits the cells that its kth distance leaves open.
    """
    q = _numbers(queries, "q_id")
    if q.count() > most_blocks * block:
        found, _ = nearest_by_pivots(queries, train, k, metric, block, apart)
    else:
        found = _by_blocks(q, _numbers(train, "t_id"), k, metric, block, apart)
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "t_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _numbers(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(n, -1)


def _best(ids: np.ndarray, t_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, train id, distance) of each query's k least finite distances, ties to smaller ids."""
    order = np.lexsort((np.broadcast_to(t_ids, d.shape), d))[:, :k]
    near = np.take_along_axis(d, order, 1).ravel()
    there = near < np.inf
    return np.repeat(ids, order.shape[1])[there], t_ids[order].ravel()[there], near[there]


def _by_blocks(q: DataFrame, t: DataFrame, k: int, metric: str, block: int, apart: bool) -> DataFrame:
    parts = max(1, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packs(key, table):
        return pa.table({
            "pack": [key[0].as_py()],
            "ids": [table.column("q_id").to_numpy().astype("<i8").tobytes()],
            "vecs": [_matrix(table.column("vec"), table.num_rows).astype("<f8").tobytes()],
        })

    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("pack", F.pmod(F.xxhash64("q_id"), F.lit(blocks))).groupBy("pack").applyInArrow(packs, "pack long, ids binary, vecs binary")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1))))
    t = t.withColumn("part", F.pmod(F.xxhash64("t_id"), F.lit(parts)))

    def search(left, right):
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            t_ids, vecs = right.column("t_id").to_numpy(), _matrix(right.column("vec"), right.num_rows)
            for row in left.select(["ids", "vecs"]).to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                d = distances(np.frombuffer(row["vecs"], "<f8").reshape(len(ids), -1), vecs, metric)
                if apart:
                    d[ids[:, None] == t_ids[None]] = np.inf
                for column, values in zip(out, _best(ids, t_ids, d, k)):
                    column.append(values)
        return pa.table(dict(zip(("q_id", "t_id", "distance"), map(np.concatenate, out))))

    return q.groupBy("part").cogroup(t.groupBy("part")).applyInArrow(search, "q_id long, t_id long, distance double")


#: Pivots at most: what is sent to all tasks. Cells beyond cell_rows are dealt on by id.
PIVOTS = 1024
_CELL = ["cell", "sub"]


def nearest_by_pivots(queries: DataFrame, train: DataFrame, k: int = 2, metric: str = "l2", block: int = 1024, apart: bool = False, cell_rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(found, effort): candidates (q_id, t_id, distance) that hold each query's exact k nearest, and the number of
    distances that each round computed (n).

    Train rows belong to the nearest of some pivots (train rows of the least hashes) and know its distance. A query
    first visits its two nearest cells; its kth distance then closes cells by the triangle inequality: the ring of
    distances to the pivot that a cell's rows lie in, and, between two pivots, half the difference of the query's
    distances. Within an open cell only rows of a ring about the query's own distance are compared. Each round visits as
    many cells as all before it, so that later ones know a better kth distance.
    """
    q, t = _numbers(queries, "q_id"), _numbers(train, "t_id")
    spark = q.sparkSession
    n = t.count()
    empty = spark.createDataFrame([], "q_id long, t_id long, distance double")
    if not n:
        return empty, spark.createDataFrame([], "n long")
    wanted = max(1, min(PIVOTS, 2 * n // cell_rows, int(n**0.5)))
    seen = t.orderBy(F.xxhash64("t_id"), "t_id").limit(wanted).collect()
    pivots = np.unique(np.array([r["vec"] for r in seen], float), axis=0)
    sent = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        for b in batches:
            d = np.concatenate([distances(_matrix(b.column(1).slice(c, 4096), len(b.column(1).slice(c, 4096))), sent.value, metric) for c in range(0, max(1, b.num_rows), 4096)])
            home = d.argmin(1) if len(d) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], ["t_id", "vec", "cell", "off"])

    dealt = shared.written(t.mapInArrow(deal, "t_id long, vec array<double>, cell int, off double"), "dealt")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.min("off").alias("low"), F.max("off").alias("high")).orderBy("cell").collect()
    names = np.array([c["cell"] for c in cells])
    ring = np.array([c["low"] for c in cells]), np.array([c["high"] for c in cells])
    subs = np.array([-(-c["rows"] // cell_rows) for c in cells])
    known = spark.sparkContext.broadcast((names, *ring, subs))
    per = F.create_map(*[F.lit(int(x)) for c, m in zip(names, subs) for x in (c, m)])
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("t_id"), per[F.col("cell")]).cast("int"))

    def routes(skip: int, most: int):
        def run(batches):
            names, low, high, subs = known.value
            for b in batches:
                for c in range(0, b.num_rows, 4096):
                    part = b.slice(c, 4096)
                    d = distances(_matrix(part.column(1), part.num_rows), sent.value, metric)
                    kth = part.column(2).to_numpy()
                    own = d[:, names]
                    gap = np.maximum(np.maximum(low - own, own - high), (own - d.min(1)[:, None]) / 2)
                    order = np.lexsort((np.broadcast_to(names, gap.shape), own, gap))[:, skip : skip + most]
                    # Rounding must not close a cell: a little room.
                    good = np.take_along_axis(gap, order, 1) <= (kth * (1 + 1e-9) + 1e-9 * np.abs(own).max(1, initial=0))[:, None]
                    i, j = np.nonzero(good)
                    at = order[i, j]
                    each = np.repeat(np.arange(len(at)), subs[at])
                    sub = np.arange(len(each)) - np.repeat(np.cumsum(subs[at]) - subs[at], subs[at])
                    for s in range(0, len(each), 4096):
                        e = each[s : s + 4096]
                        rows = part.take(pa.array(i[e]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[at[e]].astype(np.int32)), pa.array(sub[s : s + 4096].astype(np.int32)), pa.array(own[i[e], at[e]])], ["q_id", "vec", "kth", "cell", "sub", "off"])

        return run

    def meet(left, right):
        out, computed = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]], 0
        if left.num_rows and right.num_rows:
            right = right.sort_by([("off", "ascending"), ("t_id", "ascending")])
            t_ids, off, vecs = right.column("t_id").to_numpy(), right.column("off").to_numpy(), _matrix(right.column("vec"), right.num_rows)
            left = left.sort_by([("off", "ascending"), ("q_id", "ascending")])  # near queries share a ring
            ids, at, kth = (left.column(c).to_numpy() for c in ("q_id", "off", "kth"))
            x = _matrix(left.column("vec"), left.num_rows)
            for c in range(0, len(ids), 64):
                s = slice(c, c + 64)
                room = kth[s] * (1 + 1e-9) + 1e-9 * (at[s] + off[-1])
                a, b = np.searchsorted(off, (at[s] - room).min()), np.searchsorted(off, (at[s] + room).max(), "right")
                if a < b:
                    d = distances(x[s], vecs[a:b], metric)
                    computed += d.size
                    d[d > kth[s][:, None]] = np.inf  # a query that has k already wants none farther
                    if apart:
                        d[ids[s][:, None] == t_ids[None, a:b]] = np.inf
                    for column, values in zip(out, _best(ids[s], t_ids[a:b], d, k)):
                        column.append(values)
        q_ids, found, far = map(np.concatenate, out)
        whole = np.r_[found, -1]
        return pa.table({
            "q_id": pa.array(np.r_[q_ids, -1], pa.int64()),
            "t_id": pa.array(whole, pa.int64()),
            "distance": pa.array(np.r_[far, 0.0], pa.float64()),
            "n": pa.array(np.r_[np.zeros(len(found), np.int64), computed], pa.int64()),
            "effort": pa.array(np.r_[np.zeros(len(found), bool), True]),
        })

    asked, met, skip, most = q.withColumn("kth", F.lit(float("inf"))), None, 0, 2
    while skip < len(names):
        routed = shared.written(asked.mapInArrow(routes(skip, most), "q_id long, vec array<double>, kth double, cell int, sub int, off double"), "routes")
        chunks = routed.groupBy(*_CELL).agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("chunks"))
        left = routed.join(chunks, _CELL).withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.col("chunks")).cast("int")).drop("chunks")
        right = dealt.join(chunks, _CELL).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        key = [*_CELL, "chunk"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "q_id long, t_id long, distance double, n long, effort boolean")
        found = shared.written(found, "met")
        met = found if met is None else met.unionByName(found)
        skip, most = skip + most, skip + most
        rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "t_id"))
        kth = met.where("not effort").withColumn("_r", rank).where(F.col("_r") == k).select("q_id", F.col("distance").alias("kth"))
        asked = q.join(kth, "q_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    return met.where("not effort").select("q_id", "t_id", "distance"), met.where("effort").select("n")


def ratio_matches(neighbours: DataFrame, ratio: float = 0.65) -> DataFrame:
    """Queries whose nearest is closer than ratio times their second; those with one neighbour go."""
    n = neighbours.groupBy("q_id").agg(F.min_by("t_id", "rank").alias("t_id"), F.min("distance").alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return n.where(F.col("d1") < ratio * F.col("d2"))


def strongest(points: DataFrame, most: int) -> DataFrame:
    """Of each image's keypoints (image_id, point_id, response) the `most` with the highest response, ties to
    the smaller point_id; the limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.col("response").desc(), "point_id"))
    return points.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def gather(matches: DataFrame, q_points: DataFrame, t_points: DataFrame) -> DataFrame:
    q = q_points.select("q_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    t = t_points.select("t_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return matches.join(q, "q_id").join(t, "t_id")


def similarity_params(a: Column, b: Column, tx: Column, ty: Column) -> list[Column]:
    """Scale, angle in degrees and translation of the matrix (a, -b, tx; b, a, ty)."""
    return [F.sqrt(a * a + b * b).alias("scale"), F.degrees(F.atan2(b, a)).alias("angle"), tx.alias("shift_x"), ty.alias("shift_y")]


def fit_similarity(points: DataFrame, tolerance: float = 3.0, rounds: int = 500, seed: int = 1, least_matches: int = 10, least_inliers: int = 15) -> DataFrame:
    """Seeded RANSAC similarity for each pair of images (pair_id, qx, qy, tx, ty): pair_id, matches,
    inliers, a, b, shift_x, shift_y, accepted. Pairs with too few matches have null parameters. One
    image pair's matches are few thousand points, so a group fits a task.

    Of the samples' models the one with the least sum of squared distances, each cut at the tolerance, wins: the number
    of inliers alone would prefer a model through a strayed point that has one more of them by chance.
    """

    def run(key, table):
        p = np.stack([table.column(c).to_numpy(zero_copy_only=False) for c in ("qx", "qy", "tx", "ty")], 1)
        p = p[np.lexsort(p.T)]
        z, w = p[:, 0] + 1j * p[:, 1], p[:, 2] + 1j * p[:, 3]
        best, least, m, t = np.zeros(len(p), bool), np.inf, None, None
        if len(p) > least_matches:
            rng = np.random.default_rng(seed)
            for _ in range(rounds):
                i, j = rng.choice(len(p), 2, replace=False)
                if z[i] == z[j]:
                    continue
                mm = (w[i] - w[j]) / (z[i] - z[j])
                far = np.abs(mm * z + (w[i] - mm * z[i]) - w)
                loss = (np.minimum(far, tolerance) ** 2).sum()
                if loss < least:
                    best, least = far <= tolerance, loss
            if best.sum() >= 2:
                zc, wc = z[best] - z[best].mean(), w[best] - w[best].mean()
                m = (np.conj(zc) * wc).sum() / (np.abs(zc) ** 2).sum()
                t = w[best].mean() - m * z[best].mean()
        n = int(best.sum())
        return pa.table({
            "pair_id": [key[0].as_py()],
            "matches": [len(p)],
            "inliers": [n],
            "a": pa.array([m.real if m is not None else None], pa.float64()),
            "b": pa.array([m.imag if m is not None else None], pa.float64()),
            "shift_x": pa.array([t.real if m is not None else None], pa.float64()),
            "shift_y": pa.array([t.imag if m is not None else None], pa.float64()),
            "accepted": [m is not None and n > least_inliers],
        })

    return points.groupBy("pair_id").applyInArrow(run, "pair_id long, matches long, inliers long, a double, b double, shift_x double, shift_y double, accepted boolean")


def region(a: Column, b: Column, tx: Column, ty: Column, width: Column, height: Column, full_w: Column, full_h: Column) -> list[Column]:
    """The corners of a width x height figure under the transform, cut to integers, as a box clamped to
    the raster: x0, y0, x1, y1."""
    corners = [(F.lit(0), F.lit(0)), (width, F.lit(0)), (width, height), (F.lit(0), height)]
    xs = F.array(*[(a * x - b * y + tx).cast("int") for x, y in corners])
    ys = F.array(*[(b * x + a * y + ty).cast("int") for x, y in corners])
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    return [clamp(F.array_min(xs), full_w).alias("x0"), clamp(F.array_min(ys), full_h).alias("y0"), clamp(F.array_max(xs), full_w).alias("x1"), clamp(F.array_max(ys), full_h).alias("y1")]
