"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square
stopping test.

Vectors of one length whose norms are alike (a band) get one more side that brings each to the band's
largest norm M; the nearest neighbours of a query, scaled to norm M, are then those of the largest inner
product, at the squared distance 2 M (M - s), where s is the product with the unit query. A few Gaussian
(2-stable) projections turn a distance d into a projected one whose square is d * d times a chi-square variable. So a
point at squared projected distance p is worth looking at while

    chi2(sure) * 2 M (M - kth) >= p,    that is,    kth <= M - p / (2 M chi2(sure)) = reach,

kth being the kth best product so far: a neighbour that belongs to the answer passes this test with
probability `sure`. Boxes of the kd-tree have the reach of their nearest corner. Queries take boxes by
descending reach, verify on the original vectors those points whose own reach still holds, and stop at the
first box whose reach is below the kth best.

Vectors are dealt to cells of the upper kd-tree, which are dealt on by id where they are large; each such shard
builds the lower tree in its task. A query visits the few cells of the highest reach, then whichever others
its kth best still allows.
"""

from __future__ import annotations

import math
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import join_checked, materialize
from .top_k import _rows, clean

#: Points of a leaf of the lower tree.
LEAF = 256
#: Queries that a task looks up side by side.
BLOCK = 1024
#: Cells of all upper trees together, and norm bands of a length, at most: what is sent to all executors is
#: bounded by these, whatever the number of vectors. Vectors beyond them are dealt by id and met by every
#: query of their length.
CELLS, BANDS = 8192, 64
#: Bytes of queries that meet a shard in one task.
CHUNK = 32 << 20
#: Margin for the rounding of sums, as a share of M.
SLACK = 1e-9


def chi2_quantile(m: int, p: float) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection of the series of the incomplete gamma."""

    def below(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
        i = 0
        while term > total * 1e-16:
            i += 1
            term *= x / (a + i)
            total += term
        return total

    lo, hi = 1e-9, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@lru_cache(8)
def directions(dim: int, m: int, seed: int) -> np.ndarray:
    """dim + 1 rows of m Gaussian directions: the same wherever they are drawn."""
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, m))


def project(v: np.ndarray, top: np.ndarray | float, m: int, seed: int) -> np.ndarray:
    """Projections of points, brought to norm top by a side of their own."""
    a = directions(v.shape[1], m, seed)
    rest = np.sqrt(np.maximum(0, (top - (n := norms(v))) * (top + n)))
    return v @ a[:-1] + rest[:, None] * a[-1]


def project_queries(unit: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Projections of unit queries, which have nothing in the added side; times M for a band's scale."""
    return unit @ directions(unit.shape[1], m, seed)[:-1]


def norms(v: np.ndarray) -> np.ndarray:
    """Without overflow of the squares."""
    top = np.abs(v).max(1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((v / safe[:, None]) ** 2).sum(1))


def box_reach(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: np.ndarray, chi2: float) -> np.ndarray:
    """Queries' unit projections x boxes -> the kth best up to which each box is worth opening. top: each box's M."""
    p = np.zeros((len(at), len(lo)))
    for i in range(at.shape[1]):
        x = at[:, i, None] * top
        p += np.square(np.maximum(np.maximum(lo[:, i] - x, x - hi[:, i]), 0))
    return top - p / (2 * top * chi2)


# --- one shard ----------------------------------------------------------------------------------


def leaves(at: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Places of the points by median splits along the widest side of each node."""
    out, todo = [], [np.arange(len(at))]
    while todo:
        node = todo.pop()
        p = at[node]
        width = p.max(0) - p.min(0) if len(p) else np.zeros(0)
        if len(node) <= most or not len(width) or not width.max() > 0:
            out.append(node)
            continue
        half = len(node) // 2
        node = node[np.argpartition(p[:, int(width.argmax())], half)]
        todo += [node[half:], node[:half]]
    return out


def bands(v: np.ndarray) -> np.ndarray:
    """Half octaves around powers of two that the norms fall in."""
    return np.floor(np.log2(norms(v)) + 0.5).astype(np.int32)


def search(ids, v, at, tops: np.ndarray, queries: dict[str, np.ndarray], k: int, chi2: float) -> tuple[np.ndarray, ...]:
    """Looks up queries (ids, v, unit projections at, length norm, kth best product with the unit query) in
    one shard; tops: the norm that each point was brought to. Returns (query place, point place, score) of at most
    k candidates a query, all that may belong to its k best here, and how many points each query verified.

    Queries go side by side, each in the order of its own boxes: a step takes every open query's next leaf.
    """
    parts = [own[p] for top in np.unique(tops) for own in [np.flatnonzero(tops == top)] for p in leaves(at[own])]
    low = np.stack([at[p].min(0) for p in parts])
    high = np.stack([at[p].max(0) for p in parts])
    q_v, norm, kth = queries["v"], queries["norm"], queries["kth"].copy()
    reach = box_reach(queries["at"], low, high, tops[[p[0] for p in parts]], chi2)
    order = np.argsort(-reach, axis=1, kind="stable")
    best = np.full((len(q_v), k), -np.inf)  # scores, descending
    who = np.full((len(q_v), k), -1)
    verified = np.zeros(len(q_v), np.int64)
    slack = SLACK * tops.max()
    for step in range(len(parts)):
        leaf = order[:, step]
        open_ = np.flatnonzero(reach[np.arange(len(leaf)), leaf] >= kth - slack)
        if not len(open_):
            break  # reaches descend: the test holds for every query and for all that is left
        for part in np.unique(leaf[open_]).tolist():
            mine, place = open_[leaf[open_] == part], parts[part]
            top = tops[place[0]]
            x = queries["at"][mine] * top
            p = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ at[place].T + (at[place] ** 2).sum(1)) * (1 - 1e-9)
            near = (top - p / (2 * top * chi2) >= kth[mine, None] - slack) & (ids[place][None] != queries["ids"][mine, None])
            verified[mine] += near.sum(1)
            rough = q_v[mine] @ v[place].T
            bar = np.maximum(kth[mine] * norm[mine], best[mine, -1])
            near &= rough >= (bar - np.where(np.isfinite(bar), slack * norm[mine], 0))[:, None]
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            score = np.full((len(some), len(place)), -np.inf)
            a, b = np.nonzero(near[some])
            # The answer's own sums: in one order for all rows, so that equal vectors tie.
            score[a, b] = (q_v[mine[some[a]]] * v[place[b]]).sum(1)
            row = mine[some]
            both = np.concatenate([best[row], score], 1)
            names = np.concatenate([who[row], np.broadcast_to(place, score.shape)], 1)
            first = np.lexsort((np.where(names >= 0, ids[names], np.iinfo(np.int64).max), -both), axis=1)[:, :k]
            best[row], who[row] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
            who[row] = np.where(best[row] == -np.inf, -1, who[row])
            kth[row] = np.maximum(kth[row], best[row, -1] / norm[row])
    q, j = np.nonzero(who >= 0)
    return q, who[q, j], best[q, j], verified


# --- dealing ------------------------------------------------------------------------------------


def split(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of each inner node of a tree of medians; node i's children are 2 i + 1 and 2 i + 2."""
    axis, value, cells = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), [sample]
    for i in range(2**levels - 1):
        p, cells[i] = cells[i], None
        if len(p):
            axis[i] = int(p.std(0).argmax())
            value[i] = np.median(p[:, axis[i]])
        above = p[:, axis[i]] > value[i]
        cells += [p[~above], p[above]]
    return axis, value


def cell(at: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(at), np.int64)
    while len(node) and node[0] < len(axis):
        node = 2 * node + 1 + (at[np.arange(len(node)), axis[node]] > value[node])
    return node - len(axis)


KEY = ["dim", "band", "cell", "sub"]


class Index:
    """Vectors dealt to shards, and the directory of their cells.

    points: (vec_id, v, dim, band, top, cell, sub). cells: (dim, band, cell, subs), one row a cell. Lengths
    with a directory (`known`) have (band, cell, subs, lo, hi, top) arrays there; a query of another length
    visits each of its length's shards.
    """

    def __init__(self, vectors: DataFrame, m: int, sure: float, shard_bytes: int, sample: int, seed: int):
        self.m, self.seed, self.chi2 = m, seed, chi2_quantile(m, sure)
        spark = self.spark = vectors.sparkSession
        v = clean(vectors, F.transform("embedding", lambda x: x.cast("double")))
        v = v.where(F.exists("v", lambda x: x != 0)).transform(self._with_norms)
        per = F.greatest(F.lit(64), F.floor(shard_bytes / (8 * F.col("dim"))))
        self.v = v = materialize(v, "normed")

        # Bands of norms: half octaves around a power of two, the lowest all in one.
        bands = v.groupBy("dim", "band").agg(F.count("*").alias("rows"), F.max("norm").alias("top"))
        lengths = bands.groupBy("dim").agg(F.sum("rows").alias("of_dim"), F.max("band").alias("high"), F.max("top").alias("dim_top"))
        # The largest lengths get a directory, as far as CELLS goes.
        want = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("rows") / per))))
        sizes = materialize(bands.join(lengths, "dim").withColumn("band", F.greatest("band", F.col("high") - BANDS)).groupBy("dim", "band", "of_dim", "dim_top").agg(F.sum("rows").alias("rows"), F.max("top").alias("top")).withColumn("cells", want), "bands")
        ranked = sizes.groupBy("dim", "of_dim").agg(F.count("*").alias("bands"), F.sum("cells").alias("cells")).where(F.col("of_dim") > per).orderBy(F.desc("of_dim"), "dim").limit(CELLS)
        chosen, left = {}, CELLS
        for r in ranked.collect():
            if r["bands"] <= left:
                # What is left is shared in proportion where not all of it can be had.
                share = min(1.0, left / r["cells"])
                chosen[r["dim"]] = share
                left -= max(r["bands"], int(r["cells"] * share))
        shares = F.create_map(*[F.lit(x) for d, s in chosen.items() for x in (d, s)]) if chosen else None
        has = F.col("dim").isin(list(chosen)) if chosen else F.lit(False)
        levels = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("cells") * F.try_element_at(shares, F.col("dim"))))).cast("int") if chosen else F.lit(0)
        sizes = sizes.withColumn("band", F.when(has, F.col("band"))).groupBy("dim", "band").agg(F.sum("rows").alias("rows"), F.max("top").alias("top"), F.min(F.when(has, levels).otherwise(0)).alias("levels"), F.min("band").alias("low"))
        sizes = materialize(sizes, "sizes")
        n_sizes = sizes.count()

        # Every vector's band, M and projections. band is null, and cell 0, where a length has no directory.
        lowest = sizes.where("band is not null").groupBy("dim").agg(F.min("band").alias("floor"))
        v = join_checked(v, lowest, "dim", "left", n_sizes, 16)
        v = v.withColumn("band", F.when(F.col("floor").isNotNull(), F.greatest("band", "floor"))).drop("floor")
        on = (v["dim"] == sizes["dim"]) & v["band"].eqNullSafe(sizes["band"])
        v = join_checked(v, sizes.select("dim", "band", "top", "levels", "rows"), on, "inner", n_sizes, 40).select("vec_id", "v", v["dim"], F.coalesce(v["band"], F.lit(0)).alias("band"), "top", "levels", "rows")
        v = materialize(v.transform(self._projected), "projected")

        # The upper trees, from a sample of projections alone.
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30) * F.col("rows")
        seen = v.where((F.col("levels") > 0) & (share < F.least(F.lit(sample), 64 * F.pow(F.lit(2), F.col("levels")))))

        def grow(key, table):
            axis, value = split(_rows(table.column("at"), table.num_rows), int(table.column("levels")[0].as_py()))
            row = {"dim": key[0].as_py(), "band": key[1].as_py(), "tree": pickle.dumps((axis, value))}
            return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("band", pa.int32()), ("tree", pa.binary())]))

        trees = {(r["dim"], r["band"]): pickle.loads(r["tree"]) for r in seen.groupBy("dim", "band").applyInArrow(grow, "dim int, band int, tree binary").collect()} if chosen else {}
        v = v.transform(self._celled, spark.sparkContext.broadcast(trees))
        self.points = materialize(v, "celled")

        # Cells as they came out: tight boxes, and shards by id where a cell holds too many bytes.
        sides = [f(F.col("at")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(m)]
        cells = self.points.groupBy("dim", "band", "cell").agg(F.count("*").alias("rows"), F.max("top").alias("top"), *sides)
        array = lambda n: F.array(*[F.col(f"{n}{i}") for i in range(m)]).alias(n)
        self.cells = materialize(cells.select("dim", "band", "cell", "top", F.ceil(F.col("rows") / per).cast("int").alias("subs"), array("lo"), array("hi")), "cells")
        self.known: dict[int, tuple[np.ndarray, ...]] = {}
        if chosen:
            own = self.cells.where(F.col("dim").isin(list(chosen))).orderBy("dim", "band", "cell").collect()
            for dim in chosen:
                rows = [r for r in own if r["dim"] == dim]
                kinds = {"band": np.int32, "cell": np.int64, "subs": np.int64, "lo": float, "hi": float, "top": float}
                self.known[dim] = tuple(np.array([r[c] for r in rows], t) for c, t in kinds.items())
        self.sent = spark.sparkContext.broadcast(self.known)
        subs = self.cells.select("dim", "band", "cell", "subs").where("subs > 1")
        self.points = join_checked(self.points.select("vec_id", "v", "dim", "band", "top", "cell"), subs, ["dim", "band", "cell"], "left", subs.count(), 24).withColumn(
            "sub", F.when(F.col("subs") > 1, F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).otherwise(0)
        ).drop("subs")

    def _with_norms(self, v: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                dim = b.column(2).to_numpy()
                norm = np.zeros(b.num_rows)
                for d in np.unique(dim).tolist():
                    at = np.flatnonzero(dim == d)
                    norm[at] = norms(_rows(b.column(1).take(pa.array(at)), len(at)))
                band = np.floor(np.log2(norm) + 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm), pa.array(band)], ["vec_id", "v", "dim", "norm", "band"])

        return v.mapInArrow(run, "vec_id long, v array<double>, dim int, norm double, band int")

    def _projected(self, v: DataFrame) -> DataFrame:
        m, seed = self.m, self.seed

        def run(batches):
            for b in batches:
                dim, top, at = b.column(2).to_numpy(), b.column(4).to_numpy(), np.zeros((b.num_rows, m))
                for d in np.unique(dim).tolist():
                    some = np.flatnonzero(dim == d)
                    at[some] = project(_rows(b.column(1).take(pa.array(some)), len(some)), top[some], m, seed)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(at), pa.list_(pa.float64()))], [*b.schema.names, "at"])

        return v.mapInArrow(run, "vec_id long, v array<double>, dim int, band int, top double, levels int, rows long, at array<double>")

    def _celled(self, v: DataFrame, trees) -> DataFrame:
        def run(batches):
            for b in batches:
                dim, band, found = b.column(2).to_numpy(), b.column(3).to_numpy(), np.zeros(b.num_rows, np.int64)
                for d, n in set(zip(dim.tolist(), band.tolist())) & set(trees.value):
                    some = np.flatnonzero((dim == d) & (band == n))
                    found[some] = cell(_rows(b.column(7).take(pa.array(some)), len(some)), *trees.value[d, n])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(7), pa.array(found)], ["vec_id", "v", "dim", "band", "top", "at", "cell"])

        return v.mapInArrow(run, "vec_id long, v array<double>, dim int, band int, top double, at array<double>, cell long")

    # --- queries --------------------------------------------------------------------------------

    def _routes(self, queries: DataFrame, skip: int, most: int) -> DataFrame:
        """A row for each query and shard to visit: of the cells of rank skip on by the product that they
        promise, most at most, those whose reach its kth best allows."""
        sent, m, seed, chi2 = self.sent, self.m, self.seed, self.chi2
        known = list(self.known)

        def run(batches):
            for b in batches:
                dim = b.column(2).to_numpy()
                for d in np.unique(dim).tolist():
                    rows = np.flatnonzero(dim == d)
                    some = b.take(pa.array(rows))
                    band, name, subs, lo, hi, top = sent.value[d]
                    v = _rows(some.column(1), len(rows))
                    reach = box_reach(project_queries(v / norms(v)[:, None], m, seed), lo, hi, top, chi2)
                    likely = top - (top - reach) * (chi2 / m)  # the product to expect where the box is nearest
                    order = np.argsort(-likely, axis=1, kind="stable")[:, skip : skip + most]
                    good = np.take_along_axis(reach, order, 1) >= some.column(3).to_numpy()[:, None] - SLACK * top[order]
                    q, j = np.nonzero(good)
                    at = order[q, j]
                    each = np.repeat(np.arange(len(at)), subs[at])
                    sub = np.arange(len(each)) - np.repeat(np.cumsum(subs[at]) - subs[at], subs[at])
                    for c in range(0, len(each), 4096):
                        e = each[c : c + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [*some.take(pa.array(q[e])).columns, pa.array(band[at[e]]), pa.array(name[at[e]]), pa.array(sub[c : c + 4096].astype(np.int32))],
                            ["query_id", "v", "dim", "kth", "band", "cell", "sub"],
                        )

        fields = "query_id long, v array<double>, dim int, kth double, band int, cell long, sub int"
        routed = queries.where(F.col("dim").isin(known)).mapInArrow(run, fields) if known else None
        if skip == 0:
            rest = self.cells.where(~F.col("dim").isin(known)) if known else self.cells
            rest = rest.select("dim", "band", "cell", "subs")
            others = join_checked(queries, rest, "dim", "inner", rest.count(), 24).select("query_id", "v", "dim", "kth", "band", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
            routed = others if routed is None else routed.unionByName(others)
        return routed

    def visit(self, queries: DataFrame, k: int, skip: int, most: int) -> DataFrame:
        """queries (query_id, v, dim, kth) -> (query_id, vec_id, score) of candidates, and for each query and
        shard a row without vec_id that has the number of points verified."""
        m, seed, chi2, known = self.m, self.seed, self.chi2, set(self.known)
        asked = materialize(self._routes(queries, skip, most), "routes")
        size = asked.groupBy(*KEY).agg(F.count("*").alias("n")).select(*KEY, F.ceil(F.col("n") * (8 * F.col("dim") + 64) / CHUNK).cast("int").alias("chunks"))
        size = materialize(size, "chunks")
        n = size.count()
        asked = join_checked(asked, size, KEY, "inner", n, 28).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        points = join_checked(self.points, size, KEY, "inner", n, 28).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

        def meet(left, right):
            out = [pa.table([[], [], [], []], schema=met_row)]
            if left.num_rows and right.num_rows:
                ids, v = right.column("vec_id").to_numpy(), _rows(right.column("v"), right.num_rows)
                tops = right.column("top").to_numpy()
                if left.column("dim")[0].as_py() not in known:  # no cell was chosen by these norms, so bands may be the shard's own
                    band = bands(v)
                    for b in np.unique(band):
                        tops = np.where(band == b, norms(v[band == b]).max(), tops)
                at = project(v, tops, m, seed)
                names, wanted, kth = left.column("query_id").to_numpy(), _rows(left.column("v"), left.num_rows), left.column("kth").to_numpy()
                for c in range(0, len(names), BLOCK):
                    s = slice(c, c + BLOCK)
                    norm = norms(wanted[s])
                    block = {"ids": names[s], "v": wanted[s], "norm": norm, "kth": kth[s], "at": project_queries(wanted[s] / norm[:, None], m, seed)}
                    q, p, score, verified = search(ids, v, at, tops, block, k, chi2)
                    out.append(pa.table([names[s][q], ids[p], score, pa.nulls(len(q), pa.int64())], schema=met_row))
                    none = pa.nulls(len(verified), pa.int64()), pa.nulls(len(verified), pa.float64())
                    out.append(pa.table([names[s], *none, verified], schema=met_row))
            return pa.concat_tables(out).combine_chunks()

        met_row = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])
        keys = [*KEY, "chunk"]
        met = asked.drop("chunks").groupBy(*keys).cogroup(points.drop("chunks").groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double, verified long")
        return materialize(met, "met")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to smaller vec_id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.where("vec_id is not null").select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def searched(vectors: DataFrame, k: int, query_every: int, m: int, sure: float, shard_bytes: int, sample: int, first: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score, verified): what the visits found, and rows without vec_id for the points verified."""
    index = Index(vectors, m, sure, shard_bytes, sample, seed)
    queries = index.v.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim", F.lit(-math.inf).alias("kth"))
    found = index.visit(queries, k, 0, first)
    most = max((len(x[0]) for x in index.known.values()), default=0)
    skip = first
    while skip < most:
        # kth is of products with the unit query, as the reach is.
        kth = best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("s"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        again = queries.join(kth, "query_id", "left").select("query_id", "v", "dim", F.coalesce(F.col("s") / length * (1 - SLACK * F.signum("s")), F.lit(-math.inf)).alias("kth"))
        found = found.unionByName(index.visit(again, k, skip, skip))
        skip *= 2  # each round visits as many cells as all before it
    return found


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, m: int = 16, sure: float = 0.97, shard_bytes: int = 8 << 20, sample: int = 1 << 16, first: int = 2, seed: int = 7) -> DataFrame:
    """Vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score.

    Queries are the rows with vec_id divisible by query_every; each gets the k vectors found of the largest
    inner product (double precision, on the original vectors), its own vec_id aside, ties to smaller vec_id; fewer if there
    are fewer. Null, empty and zero vectors, those with a null or non-finite component and rows with a null
    vec_id take no part; a vector meets those of its own length alone; of rows with one vec_id the least
    vector counts. An empty table gives no rows; columns beside vec_id and embedding play no part. Products
    beyond the largest double are infinite.

    sure: the probability, over the drawing of the projections, with which a vector that belongs to the answer
    passes the stopping test. m: projections. shard_bytes: bytes of vectors in a task. sample: vectors that the
    upper tree's medians are learnt from; all are dealt by them. first: cells that a query visits in
    the first round; its kth best closes others before each later round, which has twice as many. No other setting drops candidates.
    """
    return best(searched(vectors, k, query_every, m, sure, shard_bytes, sample, first, seed), k)
