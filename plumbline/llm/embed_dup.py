"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations learnt on a bounded sample turn vectors into binary codes; half of the rotations see centred
vectors (balanced bits), half raw ones (whose flips follow the angle alone). Tables of b bits propose
pairs, a 64-bit code filters them, original vectors decide.

A hot cell, as a group of near copies makes, is not compared pair by pair: members within half
the link angle of the cell's least id form a cone. Members of one cone are all linked, by the
triangle inequality, and a cone goes on as one representative with a radius. Only where the radius
leaves a cone's links open do its members meet the other side, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_checked, map_arrow, materialize, partitions
from .graph import components


class Quantiser:
    """Rotations for one vector length: tables of `bits` bits each, from at most 64 bits a rotation."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, seed: int = 5, rounds: int = 30):
        dim = sample.shape[1]
        self.width, self.tables, self.bits = min(dim, 64), tables, bits
        each = -(-(-(-tables // 2) * bits) // self.width)
        self.mean = sample.mean(0)
        rng = np.random.default_rng(seed)
        self.raw = self._learn(sample, each, rng, rounds)
        self.centred = self._learn(sample - self.mean, each, rng, rounds)

    def _learn(self, x: np.ndarray, each: int, rng, rounds: int) -> list[np.ndarray]:
        """PCA directions times rotations that bring the projections closest to their signs, each from
        a random start (Gong and Lazebnik 2011)."""
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : self.width]
        v, out = x @ axes, []
        for _ in range(each):
            r = np.linalg.qr(rng.standard_normal((self.width, self.width)))[0]
            for _ in range(rounds if len(x) > self.width else 0):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            out.append(axes @ r)
        return out

    @property
    def n_bits(self) -> int:
        """The bits of the code."""
        return min(64, len(self.raw) * self.width)

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the tables, the first bits of the raw rotations as one 64-bit word)."""
        raw = np.concatenate([unit @ r for r in self.raw], 1) > 0
        centred = np.concatenate([(unit - self.mean) @ r for r in self.centred], 1) > 0
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        keys = np.empty((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            side, at = (raw, t // 2) if t % 2 == 0 else (centred, t // 2)
            keys[:, t] = side[:, at * self.bits : (at + 1) * self.bits] @ weight
        code = np.zeros((len(unit), 64), bool)
        code[:, : self.n_bits] = raw[:, : self.n_bits]
        return keys, np.packbits(code, axis=1).view("<u8").ravel()


def flips(angle, n_bits: int):
    """The most bits that may differ at an angle: the mean and four standard deviations."""
    p = np.minimum(angle / math.pi, 0.5)
    return n_bits * p + 4 * np.sqrt(n_bits * p * (1 - p)) + 1


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _floats(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _bytes(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def near_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 0.01, sample: int = 4096, hot: int = 64, pack: int = 2048, few: int = 32) -> DataFrame:
    """Vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept, one row for each row.

    Links: cosine in double precision of at least `cosine`. Vectors that are null, empty, zero or hold
    a null, NaN or infinite component link with nothing: n_links 0, their own component. Vectors
    of different lengths don't link; a length that at most `few` vectors have is compared whole in one
    task, so there may be any number of lengths. Rows that repeat a vec_id are one vector, the least
    counts, and each row gets its result. A null vec_id has n_links 0 and null component. Columns
    beside vec_id and embedding play no part; an empty table gives no rows.
    A pair at the cosine is missed with probability of about `miss`, nearer ones less.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    v = materialize(v, "vectors")
    per = v.groupBy("dim").agg(F.count("*").alias("c"))
    large = [(r["dim"], r["c"]) for r in per.where(F.col("c") > few).orderBy("dim").collect()]  # one in `few` vectors at most
    rest = v.where(~F.col("dim").isin([d for d, _ in large])) if large else v
    out = rest.groupBy("dim").applyInArrow(_whole(cosine), "vec_id long, n_links long, component_id long")
    for dim, n in large:
        out = out.unionByName(materialize(_near(v.where(F.col("dim") == dim).select("vec_id", "v"), dim, n, cosine, miss, sample, hot, pack), "found"))
    own = vectors.select(F.col("vec_id").cast("long"))
    found = own.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _whole(cosine: float):
    """All links of one length's few vectors at once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy()
        unit = _unit(_floats(table.column("v").combine_chunks(), len(ids)))
        link = unit @ unit.T >= cosine
        np.fill_diagonal(link, False)
        root = np.arange(len(ids))
        while True:  # the least place among a vector's own and its neighbours' roots
            new = np.minimum(root, np.where(link, root[None], len(ids)).min(1, initial=len(ids)))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"vec_id": ids, "n_links": link.sum(1).astype(np.int64), "component_id": ids[root]})

    return run


def _near(v: DataFrame, dim: int, n: int, cosine: float, miss: float, sample: int, hot: int, pack: int) -> DataFrame:
    spark = v.sparkSession
    angle = math.acos(cosine)
    bits = max(6, math.ceil(math.log2(max(2, n / 32))))
    tables = 2 * math.ceil(math.log(miss) / math.log(1 - (1 - angle / math.pi) ** bits) / 2)
    seen = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toArrow().combine_chunks()
    seen = _floats(seen.column("v").combine_chunks(), seen.num_rows)
    q = Quantiser(_unit(seen), tables, bits)
    n_bits = q.n_bits
    sent = spark.sparkContext.broadcast(q)

    def encode(batches):
        for b in batches:
            if b.num_rows:
                unit = _unit(_floats(b.column(1), b.num_rows))
                keys, code = sent.value(unit)
                yield pa.RecordBatch.from_arrays([b.column(0), _blobs(unit), pa.array(list(keys), pa.list_(pa.int64())), pa.array(code.view(np.int64))], ["vec_id", "unit", "keys", "code"])

    coded = materialize(v.transform(map_arrow, encode, "vec_id long, unit binary, keys array<long>, code long"), "codes")
    units = coded.select("vec_id", "unit")
    cells = coded.select("vec_id", "code", F.posexplode("keys").alias("t", "key"))

    # Cones: members of hot cells within half the link angle of the cell's least id.
    leaders = cells.groupBy("t", "key").agg(F.min("vec_id").alias("leader"), F.count("*").alias("n")).where(F.col("n") > hot).select("t", "key", "leader")
    leaders = materialize(leaders, "leaders")
    half, limit = math.cos(angle / 2) + 1e-9, int(flips(angle / 2, n_bits))
    near = cells.join(leaders, ["t", "key"]).select("vec_id", "leader", "code").distinct()
    lead_code = coded.select(F.col("vec_id").alias("leader"), F.col("code").alias("other"))
    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("other")))
    near = near.join(lead_code, "leader").where(apart <= limit).select("vec_id", "leader")
    near = near.join(units, "vec_id").join(units.select(F.col("vec_id").alias("leader"), F.col("unit").alias("centre")), "leader")

    def cosines(batches):
        for b in batches:
            if b.num_rows:
                c = np.einsum("ij,ij->i", _bytes(b.column(2), "<f8"), _bytes(b.column(3), "<f8"))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c)], ["a", "b", "cosine"])

    in_cone = near.select("vec_id", "leader", "unit", "centre").transform(map_arrow, cosines, "a long, b long, cosine double").where(F.col("cosine") >= half)
    in_cone = in_cone.groupBy(F.col("a").alias("vec_id")).agg(F.min(F.struct(F.col("b"), F.col("cosine"))).alias("m")).select(
        "vec_id",
        F.col("m.b").alias("rep"),
        F.acos(F.least(F.lit(1.0), "m.cosine")).alias("off"),
    )
    cones = materialize(in_cone, "cones")
    n_coned = cones.count()
    reps = join_checked(coded, cones, "vec_id", "left", n_coned, 48)
    reps = reps.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.col("rep").isNotNull().alias("cone"), F.coalesce("off", F.lit(0.0)).alias("off"), "keys", "code")
    members = materialize(reps.select("vec_id", "rep", "cone", "off"), "members")
    sizes = materialize(members.where("cone").groupBy("rep").agg(F.count("*").alias("size"), (F.max("off") + 1e-9).alias("radius")), "sizes")
    n_cones = sizes.count()

    # A cone stands in every cell of its members, with its centre's code and its radius.
    stand = reps.select("rep", "cone", "code", F.posexplode("keys").alias("t", "key"))
    lone = stand.where("not cone").select("rep", "code", F.lit(0.0).alias("radius"), "cone", "t", "key")
    if n_cones:
        centre = join_checked(lead_code.withColumnRenamed("leader", "rep"), sizes, "rep", "inner", n_cones, 32)
        held = stand.where("cone").select("rep", "t", "key").distinct().join(centre, "rep").select("rep", F.col("other").alias("code"), "radius", F.lit(True).alias("cone"), "t", "key")
        lone = lone.unionByName(held)
    deals = 16 * partitions(spark) + n * tables // 500_000
    lone = lone.withColumn("cell", F.xxhash64("t", "key")).withColumn("deal", F.pmod("cell", F.lit(deals)))

    def propose(table):
        cell, rep = table.column("cell").to_numpy(), table.column("rep").to_numpy()
        code = table.column("code").to_numpy().view(np.uint64)
        radius = table.column("radius").to_numpy()
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        u, w = [], []
        for part in np.split(order, cuts):
            for i in range(0, len(part) if len(part) > 1 else 0, 1024):
                x = part[i : i + 1024]
                for j in range(i, len(part), 1024):
                    y = part[j : j + 1024]
                    diff = np.bitwise_count(code[x][:, None] ^ code[y][None])
                    ok = diff <= flips(angle + radius[x][:, None] + radius[y][None], n_bits)
                    a, b = np.nonzero(np.triu(ok, 1) if i == j else ok)
                    u.append(rep[x[a]])
                    w.append(rep[y[b]])
        u, w = (np.concatenate([np.empty(0, np.int64), *p]) for p in (u, w))
        pairs = np.unique(np.stack([np.minimum(u, w), np.maximum(u, w)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"u": pairs[:, 0], "w": pairs[:, 1]})

    pairs = materialize(lone.groupBy("deal").applyInArrow(propose, "u long, w long").distinct(), "pairs")
    of = lambda c, name: units.select(F.col("vec_id").alias(c), F.col("unit").alias(name))
    scored = pairs.join(of("u", "x"), "u").join(of("w", "y"), "w").select("u", "w", "x", "y").transform(map_arrow, cosines, "a long, b long, cosine double")
    size = lambda c: sizes.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("radius").alias(f"r_{c}"))
    scored = join_checked(join_checked(scored, size("a"), "a", "left", n_cones, 32), size("b"), "b", "left", n_cones, 32)
    lonely = F.col("size_a").isNull() & F.col("size_b").isNull()
    beta, r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))), F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0))
    kind = F.when(lonely, F.when(F.col("cosine") >= cosine, "all").otherwise("none")).when(beta + r <= angle - 1e-7, "all").when(beta - r > angle + 1e-7, "none").otherwise("open")
    scored = materialize(scored.select("a", "b", F.coalesce("size_a", F.lit(1)).alias("size_a"), F.coalesce("size_b", F.lit(1)).alias("size_b"), kind.alias("kind")).where("kind <> 'none'"), "scored")
    full = scored.where("kind = 'all'")
    gained = full.select(F.col("a").alias("rep"), F.col("size_b").alias("c")).unionByName(full.select(
        F.col("b").alias("rep"),
        F.col("size_a").alias("c"),
    )).groupBy("rep").agg(F.sum("c").alias("by_class"))
    edges = full.select(F.col("a").alias("u"), F.col("b").alias("v"))
    single = None
    if n_cones and scored.where("kind = 'open'").limit(1).count():
        open_pairs = scored.where("kind = 'open'").select("a", "b")
        packs = _packs(members, units, open_pairs, pack)
        met = open_pairs.join(packs.toDF("a", "ca", "ids_a", "x"), "a").join(packs.toDF("b", "cb", "ids_b", "y"), "b").repartition(partitions(spark))

        def meet(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    i, j = np.frombuffer(row["ids_a"], "<i8"), np.frombuffer(row["ids_b"], "<i8")
                    ok = np.frombuffer(row["x"], "<f8").reshape(len(i), -1) @ np.frombuffer(row["y"], "<f8").reshape(len(j), -1).T >= cosine
                    ids, c = np.concatenate([i, j]), np.concatenate([ok.sum(1), ok.sum(0)])
                    hit = c > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[hit]), pa.array(c[hit].astype(np.int64)), pa.array(np.full(hit.sum(), row["a"])), pa.array(np.full(hit.sum(), row["b"]))],
                        ["vec_id", "c", "u", "v"],
                    )

        met = materialize(met.transform(map_arrow, meet, "vec_id long, c long, u long, v long"), "met")
        single = met.groupBy("vec_id").agg(F.sum("c").alias("by_member"))
        edges = edges.unionByName(met.select("u", "v").distinct())
    roots = materialize(components(edges), "roots")
    n_roots = roots.count()
    all_ = join_checked(members, roots.select(F.col("node").alias("rep"), "root"), "rep", "left", n_roots, 32).withColumn("root", F.coalesce("root", "rep"))
    all_ = join_checked(all_, sizes.select("rep", "size"), "rep", "left", n_cones, 32)
    all_ = join_checked(all_, gained, "rep", "left", n_roots, 32)
    if single is not None:
        all_ = all_.join(single, "vec_id", "left")
    else:
        all_ = all_.withColumn("by_member", F.lit(0))
    least = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").groupBy(F.coalesce("root", "rep").alias("root")).agg(
        F.min("vec_id").alias("component_id"),
        F.count("*").alias("_n"),
    ).where("_n > 1").drop("_n")
    all_ = all_.join(least, "root", "left")
    links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("by_class", F.lit(0)) + F.coalesce("by_member", F.lit(0))
    return all_.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _packs(members: DataFrame, units: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The members of the representatives in pairs, in packs of about `rows` vectors."""
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    m = members.join(wanted, "rep")
    n = m.groupBy("rep").agg(F.ceil(F.count("*") / rows).alias("packs"))
    m = m.join(n, "rep").withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.col("packs"))).join(units, "vec_id").select("rep", "pack", "vec_id", "unit")

    def run(key, table):
        return pa.table({"rep": [key[0].as_py()], "pack": [key[1].as_py()], "ids": [table.column("vec_id").to_numpy().astype("<i8").tobytes()], "units": [b"".join(table.column("unit").to_pylist())]})

    return materialize(m.groupBy("rep", "pack").applyInArrow(run, "rep long, pack long, ids binary, units binary"), "packs")
