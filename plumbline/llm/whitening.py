"""Whitening of integer-scaled embeddings from an exact covariance.

Vectors become integers. Each batch's integers are split into 16-bit limbs, every limb is centred on its own
integer mean, and products of limb matrices run as float64 matrix products small enough that no sum rounds.
The limbs are recombined as big integers; sums and products about zero follow exactly and merge
by addition in any order. One task a vector length then divides once and decomposes the covariance.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_checked, materialize

#: Bits of a limb. Centred limbs stay below 2**16, so 2**20 products of two sum exactly in a float64.
LIMB = 16
ROWS = 1 << 20
#: A leading group of eigenvalues that stands out by more than this is refined and removed before the rest is
#: decomposed, as float64 would bury the rest in its rounding.
GAP = 1e8
#: Fractional bits of refined eigenvectors.
BITS = 256
#: Models up to so many bytes go to the executors as one broadcast; beyond it rows carry theirs.
MODELS = 64 << 20
STEP = 16 << 20


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """int64 -> float64 limbs, lowest first: unsigned but for the last, and as few as hold every value."""
    out, x = [], x.copy()
    while len(x) and (x.min() < -(1 << LIMB - 1) or x.max() >= 1 << LIMB - 1):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x >>= LIMB
    return [*out, x.astype(np.float64)]


def big(a: np.ndarray) -> np.ndarray:
    """Whole float64 or int64 numbers as Python integers."""
    return a.astype(np.int64).astype(object)


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, products about zero) of int64 rows, exact, as Python integers."""
    n, d = 0, x.shape[1]
    total, gram = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        rows = len(parts[0])
        centre = [np.floor(p.sum(0) / rows) for p in parts]
        parts = [p - c for p, c in zip(parts, centre)]
        c = sum(big(c) << LIMB * i for i, c in enumerate(centre))
        r = sum(big(p.sum(0)) << LIMB * i for i, p in enumerate(parts))
        g = np.zeros((d, d), object)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                ab = big(a.T @ b) << LIMB * (i + j)
                g = g + (ab if i == j else ab + ab.T)
        n += rows
        total = total + rows * c + r
        cross = np.multiply.outer(c, r)
        gram = gram + g + cross + cross.T + rows * np.multiply.outer(c, c)
    return n, total, gram


def _floats(m: np.ndarray) -> np.ndarray:
    """A matrix of big integers, scaled by a power of two so that its largest entry is about 1."""
    top = max((abs(int(v)) for v in m.flat), default=0)
    one = 1 << max(0, top.bit_length() - 1)
    return np.array([int(v) / one for v in m.flat], np.float64).reshape(m.shape)


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Gram-Schmidt over columns of fixed-point integers, in order; columns of unit length."""
    out = []
    for k in range(z.shape[1]):
        v = z[:, k] << BITS  # room for what subtraction cancels
        for _ in range(2):
            for q in out:
                v = v - (q * (int(v @ q) >> BITS) >> BITS)
        length = isqrt(int(v @ v))
        out.append((v << BITS) // length if length else v)
    return np.array(out, object).T


def components(m: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """The k largest eigenvalues of a positive semidefinite matrix of big integers, each as an integer scaled
    by 2**BITS, with unit eigenvectors in the same scale; fewer where the rest of the matrix is null.

    float64 decomposes; where the leading eigenvalues stand GAP above the others they are refined by
    orthogonal iteration in fixed point, which a gap makes fast, and taken out of the matrix exactly
    enough for the next decomposition to see what is left at its own scale.
    """
    rest, found = m << BITS, []
    # What fixed point leaves of removed parts is far below this, and counts as null.
    null = max((int(m[i, i]) for i in range(len(m))), default=0) << BITS - 160
    while len(found) < k and max((abs(int(v)) for v in rest.flat), default=0) > null:
        value, vector = np.linalg.eigh(_floats(rest))
        value, vector = value[::-1], vector[:, ::-1]
        clear = next((i for i in range(1, len(value)) if value[i] * GAP < value[0]), len(value))
        q = np.array([int(x) for x in np.ldexp(vector[:, :clear], 60).flat], object).reshape(-1, clear) << BITS - 60
        if clear < len(value) and clear + len(found) < k:
            for _ in range(8):
                q = _orthonormal((rest @ q) >> BITS)
        if found:  # what was removed is far larger, so float64's angle to it is not right enough
            q = _orthonormal(np.concatenate([np.array([v for _, v in found], object).T, q], 1))[:, len(found) :]
        values = [int(q[:, i] @ ((rest @ q[:, i]) >> BITS)) >> BITS for i in range(clear)]
        found += [(e, q[:, i]) for i, e in enumerate(values) if e > 0]
        if clear == len(value) or len(found) >= k:
            break
        # Both sides lose the part along q: (I - q q') rest (I - q q').
        along = (q.T @ rest) >> BITS
        once = rest - ((q @ along) >> BITS)
        rest = once - (((once @ q) >> BITS) @ q.T >> BITS)
        rest = (rest + rest.T) >> 1
    found.sort(key=lambda x: -x[0])
    return found[:k]


def fit(n: int, total: np.ndarray, gram: np.ndarray, k: int) -> dict:
    """What whitening needs: n, sums, eigenvectors (float64 and fixed point), eigenvalues of n * n times the
    covariance, and their shares of its trace."""
    m = n * gram - np.multiply.outer(total, total)
    trace = sum(int(m[i, i]) for i in range(len(m)))
    found = components(m, min(k, len(m))) if trace else []
    exact = np.array([v for _, v in found], object).reshape(len(found), len(m))
    value = [e for e, _ in found]
    return {
        "n": n,
        "total": total,
        "vectors": np.array([[int(x) / (1 << BITS) for x in v] for v in exact], np.float64).reshape(exact.shape),
        "exact": exact,
        # x projects as (n x - S) . v / n and divides by sqrt(m's eigenvalue) / n, so n cancels.
        "root": [isqrt(e << BITS) / (1 << BITS) for e in value],
        "share": [e / (trace << BITS) for e in value],
        # Where the spread is wide, float64 projections onto small components would be rounding alone.
        "wide": bool(value) and value[-1] * int(GAP) < value[0],
    }


def centred(x: np.ndarray, model: dict) -> np.ndarray:
    """n * x - S, in int64 where every value and their sums of squares fit, else as Python integers."""
    n, total = model["n"], model["total"]
    top = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(s)) for s in total) if x.size else 0
    if len(total) * top * top < 1 << 63:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def score(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(deviation as int64, cut at its limits; rows x components whitened)."""
    y = centred(x, model)
    if y.dtype == object:
        deviation = np.array([min(int(v), (1 << 63) - 1) for v in (y * y).sum(1)], np.int64) if len(y) else np.empty(0, np.int64)
    else:
        deviation = (y * y).sum(1)
    if model["wide"]:
        one = 1 << BITS
        along = np.array([[int(r @ v) / one for v in model["exact"]] for r in y.astype(object)], np.float64).reshape(len(y), -1)
    else:
        along = y.astype(np.float64) @ model["vectors"].T
    return deviation, along / np.array(model["root"])


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _batches(batches):
    """Tables of about STEP bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > STEP:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _by_length(table: pa.Table):
    """(length, places, int64 rows) of a table's x."""
    x = table.column("x").combine_chunks()
    size = np.diff(x.offsets.to_numpy())
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, _rows(x if len(at) == len(x) else x.take(pa.array(at)), len(at))


_ROW = "dim int, i int, slot int, n string, s string, g array<string>"


def _moment_rows(dim: int, slot: int, n: int, total, gram) -> list[dict]:
    return [{"dim": dim, "i": i, "slot": slot, "n": str(n), "s": str(total[i]), "g": [str(v) for v in gram[i]]} for i in range(dim)]


def _arrow(rows: list[dict]) -> pa.Table:
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("slot", pa.int32()), ("n", pa.string()), ("s", pa.string()), ("g", pa.list_(pa.string()))])
    return pa.Table.from_pylist(rows, schema)


def _partial(batches):
    """A partition's moments, a row for each length and line of the products."""
    from pyspark import TaskContext

    slot, held, size = TaskContext.get().partitionId(), {}, 0
    for table in _batches(batches):
        for d, _, x in _by_length(table):
            got = moments(x)
            if d not in held:
                size += d * d
            held[d] = tuple(a + b for a, b in zip(held[d], got)) if d in held else got
        if size > 1 << 21:  # many lengths: what they hold goes on to the merge
            for d in list(held):
                yield from _arrow(_moment_rows(d, slot, *held.pop(d))).to_batches()
            size = 0
    for d, got in held.items():
        yield from _arrow(_moment_rows(d, slot, *got)).to_batches()


def _merged(key, table):
    """The sum of the rows of one line."""
    n, s, g = 0, 0, 0
    for row in table.to_pylist():
        n, s, g = n + int(row["n"]), s + int(row["s"]), g + np.array([int(v) for v in row["g"]], object)
    return _arrow([{"dim": key[0].as_py(), "i": key[1].as_py(), "slot": key[2].as_py(), "n": str(n), "s": str(s), "g": [str(v) for v in g]}])


def models(fit_list: DataFrame, k: int) -> DataFrame:
    """(x array<long>), distinct, none empty -> (dim, model binary), one row a length."""
    lines = fit_list.select("x").mapInArrow(_partial, _ROW)
    for slots in (64, 1):  # at most a 64th of the partitions' lines meet at once, then 64
        lines = lines.withColumn("slot", F.col("slot") % slots).groupBy("dim", "i", "slot").applyInArrow(_merged, _ROW)

    def solve(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        gram = np.array([[int(v) for v in r["g"]] for r in rows], object)
        found = fit(int(rows[0]["n"]), np.array([int(r["s"]) for r in rows], object), gram, k)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(found)], pa.binary())})

    return materialize(lines.groupBy("dim").applyInArrow(solve, "dim int, model binary"), "models")


def with_models(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[int, bytes]]:
    """rows (with x), and the models to send along: all of them where they are small, else none, and rows
    carry their own."""
    size = found.agg(F.coalesce(F.sum(F.length("model") + 64), F.lit(0))).first()[0]
    if size <= MODELS:
        return rows.withColumn("model", F.lit(None).cast("binary")), {r["dim"]: bytes(r["model"]) for r in found.collect()}
    each = F.size("x") == found["dim"]
    return join_checked(rows, found, each, "inner", 1, MODELS).drop("dim"), {}


def scored(rows: DataFrame, found: DataFrame, keep: list[str], ddl: str) -> DataFrame:
    """rows (keep..., x) -> keep..., deviation, whitened array<double>, dim, n, share array<double>."""
    rows, few = with_models(rows.select(*keep, "x"), found)
    sent = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches):
        opened: dict[int, dict] = {}
        for table in _batches(batches):
            for d, at, x in _by_length(table):
                if d not in opened:
                    if len(opened) > 64:
                        opened.clear()
                    opened[d] = pickle.loads(sent.value[d] if d in sent.value else table.column("model")[int(at[0])].as_py())
                model = opened[d]
                deviation, white = score(x, model)
                some = table.select(keep).take(pa.array(at))
                lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
                out = [*some.columns, pa.array(deviation), lists(white), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), model["n"])), lists([model["share"]] * len(at))]
                yield from pa.table(out, [*keep, "deviation", "whitened", "dim", "n", "share"]).to_batches()

    return rows.mapInArrow(run, ddl + "deviation long, whitened array<double>, dim int, n long, share array<double>")


def whiten(vectors: DataFrame, scale: float = 256.0, k: int = 4) -> DataFrame:
    """Vectors (vec_id, embedding) -> vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error, for each row that takes part and each of up to k components.

    Entries become x = floor(scale * entry), cut at the limits of a long. Rows whose vector is null, empty or
    holds a null or non-finite entry take no part. The fit list is each distinct x once; vectors of each
    length are fitted and whitened apart, with their own n and identity_error. A component whose eigenvalue is
    zero is left out, so fewer rows come where the fit list has fewer dimensions than k, and none where
    all its vectors are equal. Rows that repeat a vec_id, and null ids, each get their rows. deviation is cut
    at the largest long. An empty table gives no rows; other columns play no part.
    """
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = materialize(vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "integers")
    fit_list = materialize(rows.select("x").distinct(), "fit_list")
    found = models(fit_list, k)

    # The covariance of what whitening makes of the fit list, centred before multiplying.
    white = materialize(scored(fit_list, found, [], "").select("dim", "whitened"), "whitened")
    mean = white.groupBy("dim").agg(*[F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in range(k)])
    y = [(F.get("whitened", F.lit(i)) - F.col(f"m{i}")) for i in range(k)]
    far = [F.abs(F.avg(y[i] * y[j]) - float(i == j)) for i in range(k) for j in range(i + 1)]
    error = join_checked(white, mean, "dim", "inner", mean.count(), 8 * k + 8).groupBy("dim").agg(F.array_max(F.array(*far)).alias("identity_error"))
    error = materialize(error, "error")

    each = scored(rows, found, ["vec_id"], "vec_id long, ")
    each = join_checked(each, error, "dim", "inner", error.count(), 16)
    each = each.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "share")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.share").alias("explained"), "identity_error")
