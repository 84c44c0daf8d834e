"""Exact top-k inner-product search with a KD-tree per shard.

Median splits of a sample along its principal axes deal the vectors to shards that are compact in
space. Each shard's tree is built once, by median splits with tight boxes in the principal axes,
and stored. A query first searches its own shard; with the kth score from there it goes to the
shards whose box bound reaches that score, the eight best first, then, with the kth score that
these gave, to whichever others its bounds still allow. Within a tree the search is best-first by box
bounds, and begins with the kth score so far.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_checked, map_arrow, materialize

LEAF = 128
#: Boxes stand in the first so many principal axes; what lies beyond them is bounded by its length.
AXES = 64
#: Bytes of a shard's vectors at most, but for a vector that is longer by itself.
SHARD_BYTES = 128 << 20
#: Bounds are raised by this share of the largest sum they stand for, far above rounding errors.
MARGIN = 1e-9
NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Points in leaf order; node i covers points[lo[i]:hi[i]] and has children left[i], left[i] + 1
    (0: a leaf). Boxes are of the projected points; rest is the largest length beyond the axes."""

    ids: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    box_min: np.ndarray
    box_max: np.ndarray
    rest: np.ndarray


def project(points: np.ndarray, axes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates in the axes, length of what lies beyond them). Without axes, the first AXES
    coordinates themselves."""
    points = points.astype(np.float64)
    if axes is None:
        return points[:, :AXES], np.sqrt((points[:, AXES:] ** 2).sum(1))
    p = points @ axes
    if axes.shape[1] == points.shape[1]:
        return p, np.zeros(len(p))
    return p, np.sqrt(((points - p @ axes.T) ** 2).sum(1))


def build(ids: np.ndarray, points: np.ndarray, axes: np.ndarray | None = None) -> Tree:
    """Median splits along the widest side of each node's box, down to LEAF points."""
    order = np.argsort(ids, kind="stable")
    at, beyond = project(points, axes)
    spans, left, box_min, box_max, rest, i = [(0, len(ids))], [0], [], [], [], 0
    while i < len(spans):
        lo, hi = spans[i]
        p = at[order[lo:hi]]
        low, high = p.min(0), p.max(0)
        box_min.append(low)
        box_max.append(high)
        rest.append(beyond[order[lo:hi]].max())
        width = high - low
        if hi - lo > LEAF and len(width) and width.max() > 0:
            axis, mid = int(width.argmax()), (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(p[:, axis], mid)]
            left[i] = len(spans)
            spans += [(lo, lo + mid), (lo + mid, hi)]
            left += [0, 0]
        i += 1
    span = np.array(spans)
    return Tree(ids[order], points[order], span[:, 0], span[:, 1], np.array(left), np.array(box_min), np.array(box_max), np.array(rest))


def bounds(queries: tuple[np.ndarray, np.ndarray], box_min: np.ndarray, box_max: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Queries x boxes: no inner product with a point of the box is higher. Each side counts with the
    corner that helps the query most."""
    q, beyond = queries
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    top = plus @ box_max.T + minus @ box_min.T
    far = np.maximum(np.abs(box_min), np.abs(box_max))
    past = beyond[:, None] * rest[None]
    return top + past + MARGIN * (np.abs(q) @ far.T + past) + 1e-6


def _clip(score) -> int:
    return max(-(1 << 63) + 1, min((1 << 63) - 1, int(score)))


def search(tree: Tree, axes: np.ndarray | None, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> int:
    """Best-first search of one tree for each query; returns how many points were scored. best holds
    each query's heap of (score, -id), least first; it comes with what other shards gave and so with
    their kth score."""
    exact = _exact(np.concatenate([tree.points, queries]))
    points, vectors, scored = exact[: len(tree.points)], exact[len(tree.points) :], 0
    for c in range(0, len(queries), 1024):
        reach = bounds(project(queries[c : c + 1024], axes), tree.box_min, tree.box_max, tree.rest)
        for own, vector, bound, heap in zip(query_ids[c : c + 1024].tolist(), vectors[c : c + 1024], reach, best[c : c + 1024]):
            todo = [(-bound[0], 0)]
            while todo:
                b, node = heapq.heappop(todo)
                if len(heap) == k and -b < heap[0][0]:
                    break  # all boxes left have lower bounds; one that ties may hold a smaller id
                child = tree.left[node]
                if child:
                    for i in (child, child + 1):
                        if len(heap) < k or bound[i] >= heap[0][0]:
                            heapq.heappush(todo, (-bound[i], i))
                    continue
                lo, hi = tree.lo[node], tree.hi[node]
                score = points[lo:hi] @ vector
                scored += hi - lo
                near = np.arange(hi - lo)
                if len(heap) == k:
                    near = np.flatnonzero(score >= heap[0][0])
                elif hi - lo > 2 * k:
                    near = np.flatnonzero(score >= np.partition(score, hi - lo - k - 1)[hi - lo - k - 1])
                for i in near.tolist():
                    found = (_clip(score[i]), -int(tree.ids[lo + i]))
                    if -found[1] == own:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)
    return int(scored)


def _exact(points: np.ndarray) -> np.ndarray:
    """float64 where all sums of products stay exact, else Python integers."""
    top = float(np.abs(points).max()) if points.size else 0.0
    return points if top * top * max(1, points.shape[-1]) < 2**53 else np.array([[int(x) for x in p] for p in points.tolist()], object).reshape(points.shape)


# --- dealing to shards --------------------------------------------------------------------------


@dataclass
class Plan:
    """How vectors of one length are dealt: axes (None: their own), and the splits of a tree of medians:
    node i splits at value[i] of axis[i]; its children are 2 i + 1 and 2 i + 2."""

    axes: np.ndarray | None
    axis: np.ndarray
    value: np.ndarray
    levels: int

    def shard(self, points: np.ndarray) -> np.ndarray:
        at = project(points, self.axes)[0]
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (at[np.arange(len(node)), self.axis[node]] > self.value[node])
        return node - (2**self.levels - 1)


def plan(sample: np.ndarray, shards: int) -> Plan:
    """Principal axes of the sample and median splits of it along its widest axis, cell by cell."""
    scale = max(1.0, float(np.abs(sample).max()))
    _, axes = np.linalg.eigh((sample / scale).T @ (sample / scale))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    at = project(sample, axes)[0]
    levels = max(0, (shards - 1).bit_length())
    axis, value, cells = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), [at]
    for i in range(2**levels - 1):
        p = cells[i]
        if len(p):
            axis[i] = int((p / scale).std(0).argmax())
            value[i] = np.median(p[:, axis[i]])
        above = p[:, axis[i]] > value[i]
        cells += [p[~above], p[above]]
        cells[i] = None
    return Plan(axes, axis, value, levels)


def _planner(shards: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"plan": pa.array([pickle.dumps(plan(_rows(table.column("v"), table.num_rows), shards))], pa.binary())})

    return run


def clean(vectors: DataFrame, value: Column) -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors that take part: an id, at least one component, none
    null, NaN or infinite. Of rows with one vec_id the least vector counts."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)
    v = materialize(vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long"), value.alias("v")), "vectors")
    again = materialize(v.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"), "repeated")
    n = again.count()
    if n:
        least = join_checked(v, again, "vec_id", "left_semi", n, 16).groupBy("vec_id").agg(F.min("v").alias("v"))
        v = join_checked(v, again, "vec_id", "left_anti", n, 16).unionByName(least)
    return v.withColumn("dim", F.size("v"))


def _rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.empty((0, 0))


_WHERE = "dim int, shard long, sub int"
_KEY = ["dim", "shard", "sub"]


def _state(key: dict, ids: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int, scored: int) -> dict:
    """A shard's queries with what they have found, as one row."""
    heaps = np.full((len(ids), k, 2), NONE)
    for h, heap in zip(heaps, best):
        if heap:
            h[: len(heap)] = heap
    return key | {"ids": ids.astype("<i8").tobytes(), "q": queries.astype("<f8").tobytes(), "heaps": heaps.astype("<i8").tobytes(), "scored": scored}


_STATE = f"{_WHERE}, ids binary, q binary, heaps binary, scored long"


def _open(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["q"], "<f8").reshape(len(ids), row["dim"]), np.frombuffer(row["heaps"], "<i8").reshape(len(ids), k, 2)


def _heap(h: np.ndarray) -> list[tuple[int, int]]:
    out = [tuple(x) for x in h.tolist() if x[0] != NONE]
    heapq.heapify(out)
    return out


def _tables(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
    return pa.Table.from_pylist(rows, schema)


def searched(vectors: DataFrame, k: int, query_every: int, scale: float, shard_rows: int, most_cells: int, sample: int, first: int) -> DataFrame | None:
    """The shards' queries with their heaps and the number of points scored; None without vectors."""
    spark = vectors.sparkSession
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  floor() gives longs
    v = clean(vectors, F.transform("embedding", lambda x: whole(x.cast("double") * scale)))
    n = v.count()
    if not n:
        return None
    # A shard holds shard_rows vectors of usual lengths, and fewer long ones, whatever their number.
    per = shard_rows
    cell_rows = max(per, -(-n // most_cells))

    # Lengths with more rows than a shard holds get a plan, of one cell for cell_rows rows.
    large = [(r["dim"], r["c"]) for r in v.groupBy("dim").agg(F.count("*").alias("c")).where(F.col("c") > per).orderBy(F.col("c").desc(), "dim").collect()]
    plans: dict[int, Plan] = {}
    for dim, c in large:
        if sum(p.axes.nbytes for p in plans.values()) + 8 * dim * min(dim, AXES) > 64 << 20:
            break  # lengths beyond this size are one cell
        rows = max(1024, min(sample, (64 << 20) // (8 * dim)))
        seen = v.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30) * c <= rows)).select("vec_id", "v").orderBy("vec_id").limit(2 * rows)

        found = seen.groupBy(F.lit(0).alias("all")).applyInArrow(_planner(-(-c // cell_rows)), "plan binary").collect()
        if found:
            plans[dim] = pickle.loads(found[0]["plan"])
    sizes = dict(large)
    sent = spark.sparkContext.broadcast(plans)

    def place(batches):
        for b in batches:
            dim, shard = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d in sent.value:
                    some = b.column(1).take(pa.array(at))
                    shard[at] = sent.value[d].shard(_rows(some, len(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], ["vec_id", "v", "dim", "shard"])

    placed = materialize(v.select("vec_id", "v", "dim").transform(map_arrow, place, "vec_id long, v array<double>, dim int, shard long"), "placed")
    # Two levels: cells, which the directory knows by their boxes, and shards of a cell, dealt by id. Equal vectors
    # can't be split by medians, and beyond most_cells cells grow; either way a shard stays at 2 * per rows and, at
    # 8 bytes a component, SHARD_BYTES.
    rows = F.least(F.lit(2.0 * per), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))
    counts = placed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / F.greatest(F.lit(1.0), rows)).cast("int").alias("subs"))
    counts = materialize(counts, "counts")
    placed = join_checked(placed, counts, ["dim", "shard"], "inner", counts.count(), 24).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))

    fields = ["ids", "points", "lo", "hi", "left", "box_min", "box_max", "rest"]
    kinds = ["<i8", "<f8", "<i8", "<i8", "<i8", "<f8", "<f8", "<f8"]
    packed = f"{_WHERE}, ids binary, points binary, lo binary, hi binary, left binary, box_min binary, box_max binary, rest binary"

    def index(key, table):
        dim = key[0].as_py()
        tree = build(table.column("vec_id").to_numpy(), _rows(table.column("v"), table.num_rows), axes_of(dim))
        row = dict(zip(_KEY, (x.as_py() for x in key))) | {f: getattr(tree, f).astype(t).tobytes() for f, t in zip(fields, kinds)}
        return _tables([row], packed)

    def axes_of(dim: int):
        return sent.value[dim].axes if dim in sent.value else None

    def load(row: dict) -> Tree:
        x = {f: np.frombuffer(row[f], t) for f, t in zip(fields, kinds)}
        nodes = len(x["lo"])
        return Tree(**x | {"points": x["points"].reshape(-1, row["dim"]), "box_min": x["box_min"].reshape(nodes, -1), "box_max": x["box_max"].reshape(nodes, -1)})

    trees = materialize(placed.groupBy(*_KEY).applyInArrow(index, packed), "trees")

    def at_home(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                tree = load(row)
                mine = np.flatnonzero(tree.ids % query_every == 0)
                if len(mine):
                    best = [[] for _ in mine]
                    scored = search(tree, axes_of(row["dim"]), tree.ids[mine], tree.points[mine], k, best)
                    yield from _tables([_state({c: row[c] for c in _KEY}, tree.ids[mine], tree.points[mine], best, k, scored)], _STATE).to_batches()

    state = materialize(trees.transform(map_arrow, at_home, _STATE), "state")

    # The cells' boxes, of lengths with more than one: about most_cells rows of 1 kB, however many shards there are.
    width = 8 * AXES
    roots = trees.select(*_KEY, *[F.substring(c, 1, width if c != "rest" else 8).alias(c) for c in ("box_min", "box_max", "rest")])
    cell_row = "dim int, shard long, subs int, box_min binary, box_max binary, rest binary"

    def joined(key, table):
        dim = key[0].as_py()
        box = lambda c: np.stack([np.frombuffer(x, "<f8") for x in table.column(c).to_pylist()])
        low, high, rest = box("box_min")[:, : min(dim, AXES)].min(0), box("box_max")[:, : min(dim, AXES)].max(0), box("rest").max(0)
        row = {"dim": dim, "shard": key[1].as_py(), "subs": table.num_rows, "box_min": low.tobytes(), "box_max": high.tobytes(), "rest": rest.tobytes()}
        return _tables([row], cell_row)

    cells = roots.where(F.col("dim").isin(list(sizes))).groupBy("dim", "shard").applyInArrow(joined, cell_row).collect() if sizes else []
    directory: dict[int, tuple] = {}
    for dim in sizes:
        own = sorted((r.asDict() for r in cells if r["dim"] == dim), key=lambda r: r["shard"])
        box = lambda c: np.stack([np.frombuffer(bytes(r[c]), "<f8") for r in own])  # noqa: E731, B023
        directory[dim] = [(r["shard"], r["subs"]) for r in own], box("box_min"), box("box_max"), box("rest")[:, 0]
    known = spark.sparkContext.broadcast(directory)
    chunks = max(1, n // query_every * 8 * max(sizes, default=0) >> 26)
    route_row = f"{_WHERE}, from_shard long, from_sub int, at binary, {_STATE.split(', ', 3)[3]}"

    def routes(skip: int, most: int):
        """Blocks of queries for each shard that their bounds allow, from rank skip on, most at most."""

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    if row["dim"] not in known.value:
                        continue
                    names, low, high, rest = known.value[row["dim"]]
                    ids, q, heaps = _open(row, k)
                    reach = bounds(project(q, axes_of(row["dim"])), low, high, rest)
                    order = np.argsort(-reach, axis=1, kind="stable")[:, skip : skip + most]
                    kth = heaps[:, :, 0].min(1).astype(float)  # the least float where a heap isn't full
                    want = np.zeros(reach.shape, bool)
                    np.put_along_axis(want, order, True, 1)
                    want &= (reach >= kth[:, None]) & (reach > -np.inf)
                    out, size = [], 0
                    for s, sub in ((s, sub) for s in np.flatnonzero(want.any(0)).tolist() for sub in range(names[s][1])):
                        if (names[s][0], sub) == (row["shard"], row["sub"]):
                            continue  # searched at home
                        at = np.flatnonzero(want[:, s])
                        out.append({
                            "dim": row["dim"],
                            "shard": names[s][0],
                            "sub": sub,
                            "from_shard": row["shard"],
                            "from_sub": row["sub"],
                            "at": at.astype("<i8").tobytes(),
                            "ids": ids[at].tobytes(),
                            "q": q[at].tobytes(),
                            "heaps": heaps[at].tobytes(),
                            "scored": 0,
                        })
                        size += len(at) * (q.shape[1] + 2 * k) * 8
                        if size > SHARD_BYTES // 4:
                            yield from _tables(out, route_row).to_batches()
                            out, size = [], 0
                    yield from _tables(out, route_row).to_batches()

        return run

    def visit(left, right):
        out = []
        if left.num_rows and right.num_rows:
            tree = load(right.slice(0, 1).to_pylist()[0])
            for i in range(left.num_rows):
                row = left.slice(i, 1).to_pylist()[0]
                ids, q, heaps = _open(row, k)
                best = [_heap(h) for h in heaps]
                scored = search(tree, axes_of(row["dim"]), ids, q, k, best)
                found = _state({"dim": row["dim"], "shard": row["from_shard"], "sub": row["from_sub"]}, ids, q, best, k, scored)
                out.append(found | {"at": row["at"]})
        return _tables([{c: x[c] for c in (*_KEY, "at", "heaps", "scored")} for x in out], f"{_WHERE}, at binary, heaps binary, scored long")

    def merge(left, right):
        out = []
        for row in left.to_pylist():
            ids, q, heaps = _open(row, k)
            best, scored = [dict((-i, s) for s, i in h.tolist() if s != NONE) for h in heaps], row["scored"]
            for got in right.to_pylist():
                at = np.frombuffer(got["at"], "<i8")
                for j, h in zip(at.tolist(), np.frombuffer(got["heaps"], "<i8").reshape(len(at), k, 2)):
                    best[j].update((-i, s) for s, i in h.tolist() if s != NONE)
                scored += got["scored"]
            best = [sorted(((s, -i) for i, s in b.items()), reverse=True)[:k] for b in best]
            out.append(_state({c: row[c] for c in _KEY}, ids, q, best, k, scored))
        return _tables(out, _STATE)

    spread = F.pmod(F.xxhash64("from_shard", "from_sub"), F.lit(chunks)).cast("int")
    most = max((len(x[0]) for x in directory.values()), default=0)
    for skip, width in ((0, first), (first, most - first)):
        if width <= 0 or skip >= most:
            break
        asked = materialize(state.transform(map_arrow, routes(skip, width), route_row).withColumn("chunk", spread), "routes")
        wanted = asked.select(*_KEY, F.col("chunk").alias("part")).distinct()
        met = asked.groupBy(*_KEY, "chunk").cogroup(trees.join(wanted, _KEY).groupBy(*_KEY, "part")).applyInArrow(visit, f"{_WHERE}, at binary, heaps binary, scored long")
        state = materialize(state.groupBy(*_KEY).cogroup(met.groupBy(*_KEY)).applyInArrow(merge, _STATE), "state")
    return state


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0, shard_rows: int = 8192, most_cells: int = 4096, sample: int = 1 << 16, first: int = 8) -> DataFrame:
    """Vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Queries are the rows with vec_id divisible by query_every;
    each gets its k highest integer inner products with other vec_ids, ties to smaller vec_id; fewer
    if there are fewer. Null vectors, empty ones, those with a null or non-finite component and rows
    with a null vec_id take no part; a vector meets those of its own length alone; of rows with one
    vec_id the least vector counts. Scores beyond 64 bits are cut to the nearest long. An empty table
    gives no rows; columns beside vec_id and embedding play no part.

    A shard holds shard_rows vectors, twice as many at most, and its queries travel as one block. Beyond most_cells
    cells of the splits, cells grow and are dealt on to shards by id. sample: how many vectors the splits are learnt from; all are dealt by them.
    """
    state = searched(vectors, k, query_every, scale, shard_rows, most_cells, sample, first)
    if state is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def ranked(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, _, heaps = _open(row, k)
                order = np.lexsort((~heaps[:, :, 1], ~heaps[:, :, 0]), axis=1)  # both descend
                heaps = np.take_along_axis(heaps, order[:, :, None], 1)
                there = heaps[:, :, 0] != NONE
                place = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), there.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, there.sum(1))), pa.array(place[there]), pa.array(-heaps[:, :, 1][there]), pa.array(heaps[:, :, 0][there])],
                    ["query_id", "rank", "vec_id", "score"],
                )

    return state.transform(map_arrow, ranked, "query_id long, rank int, vec_id long, score long")
