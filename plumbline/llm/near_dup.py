"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find groups.

Copies collapse first: documents with the same shingle set form a class, and only class
representatives go on. A band's bucket is a candidate group. Each member's full shingle set first meets
that of its bucket's hub, the least id; buckets whose members all link with one hub are done, and in
the others every pair is compared exactly. So no link between two that share a band is lost, what shares
none is not compared, and no pair crosses the network.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, join_checked, map_arrow, materialize, mix64, partitions, shingle_set
from .graph import components

_STEP = np.uint64(0xD1342543DE82EF95)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), one row of m for each set; empty sets give rows of inf.

    Each element walks a permutation of the m slots, one place a level, and bids level + uniform.
    Levels run for all sets together; a set stops as soon as every slot holds a bid below the next
    level, since later ones can't win.
    """
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    walk, flat = None, out.reshape(-1)
    live = sizes > 0
    for j in range(m):
        h = mix64(x + np.uint64(int(_STEP) * (j + 1) % (1 << 64)))
        k = (j + (h & np.uint64(0xFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        bid = (h >> np.uint64(24)).astype(np.float64) / float(1 << 40) + j
        if j == 0:
            slot = k
        else:
            e = np.arange(len(x))
            slot = walk[e, k].astype(np.int64)
            walk[e, k] = walk[e, j]
        np.minimum.at(flat, doc * m + slot, bid)
        live &= out.max(1) >= j + 1
        if not live.any():
            break
        keep = live[doc]
        if j == 0:
            x, doc, k = x[keep], doc[keep], k[keep]
            walk = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
            walk[np.arange(len(x)), k] = 0
        elif keep.mean() < 0.8:
            x, doc, walk = x[keep], doc[keep], walk[keep]
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` slots; the band's place is part of it."""
    v = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(v.shape[1], dtype=np.uint64) * _STEP, v.shape[:2])
    for i in range(rows):
        key = mix64(key ^ v[:, :, i]) * _STEP
    return key.view(np.int64)


def sign(docs: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the shingle set), bands (empty for an empty set)."""

    def run(batches):
        def done(ids, sets):
            keys = band_keys(superminhash(sets, m), rows)
            bands = [row.tolist() if len(s) else [] for row, s in zip(keys, sets)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "bands"],
            )

        for b in batches:
            ids, sets, size = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                sets.append(shingle_set(text, k))
                size += len(sets[-1])
                if size > 60_000:
                    yield done(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield done(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


# --- exact links inside a group -----------------------------------------------------------------


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections: rare elements pair by pair, common ones by a product
    of incidence matrices, in slices of bounded size."""
    n = len(sets)
    x, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, doc = x[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    df = np.diff(np.append(first, len(x)))
    out = np.zeros((n, n), np.float32)
    for d in range(2, 9):
        at = first[df == d]
        for c in range(0, len(at), 100_000):
            who = doc[at[c : c + 100_000, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    np.add.at(out, (who[:, i], who[:, j]), 1)
    out += out.T
    common = np.flatnonzero(df > 8)
    for c in range(0, len(common), 1024):
        some = common[c : c + 1024]
        column = np.repeat(np.arange(len(some)), df[some])
        at = np.repeat(first[some] - np.concatenate(([0], np.cumsum(df[some])[:-1])), df[some]) + np.arange(df[some].sum())
        has = np.zeros((n, len(some)), np.float32)
        has[doc[at], column] = 1
        out += has @ has.T
    return out


def linked_roots(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The smallest id that each id reaches by links den * |x & y| >= num * |x | y|."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        inter = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        link = den * inter >= num * (sizes.sum() - inter)
        return np.full(2, ids.min()) if link else ids.copy()
    inter = np.rint(intersections(sets)).astype(np.int64)
    link = den * inter >= num * (sizes[:, None] + sizes[None] - inter)
    link |= ids[:, None] == ids[None]
    root, seen = ids.copy(), np.zeros(n, bool)
    for i in range(n):
        if seen[i]:
            continue
        group = front = np.zeros(n, bool)
        group = group.copy()
        group[i] = True
        front = group.copy()
        while front.any():
            front = link[front].any(0) & ~group
            group |= front
        seen |= group
        root[group] = ids[group].min()
    return root


def _link_groups(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp").to_numpy()
        ids, blobs = table.column("cid").to_numpy(), table.column("shingles").to_pylist()
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        u, v = [], []
        for part in np.split(order, cuts):
            if len(part) > 1:
                u.append(ids[part])
                v.append(linked_roots(ids[part], [np.frombuffer(blobs[i], np.uint64) for i in part], num, den))
        u, v = (np.concatenate([np.empty(0, np.int64), *a]) for a in (u, v))
        out = pa.table({"u": u[u != v], "v": v[u != v]})
        del blobs, table
        give_back()
        return out

    return run


def _link_hubs(num: int, den: int):
    """(u, hub) for each follower that links with its hub. A doc_id may stand in several rows."""

    def run(table: pa.Table) -> pa.Table:
        hub, chunk, cid = (table.column(c).to_numpy() for c in ("hub", "chunk", "cid"))
        blobs = table.column("shingles")
        order = np.lexsort((chunk, hub))
        cuts = np.flatnonzero((np.diff(hub[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
        u, v = [], []
        for part in np.split(order, cuts):
            heads = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in part if cid[i] == hub[i]]
            for i in part:
                if cid[i] != hub[i]:
                    own = np.frombuffer(blobs[int(i)].as_buffer(), np.uint64)
                    for head in heads:
                        small, large = (own, head) if len(own) < len(head) else (head, own)
                        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                        if den * both >= num * (len(own) + len(head) - both):
                            u.append(int(cid[i]))
                            v.append(int(hub[i]))
                            break
        del blobs, table
        give_back()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, m: int = 120, rows: int = 6, block: int = 512, deal_bytes: int = 16 << 20) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_shingles, component_id, kept, one row for each row.

    Links: 100 * |x & y| >= percent * |x | y| over full sets of distinct k-word shingles (fewer
    words: the whole sequence is one shingle). Null texts and texts without words have no shingles
    and link with nothing. Rows with equal doc_id count as one document with links of each. A null
    doc_id links with nothing and has component_id and kept null.
    With m = 120 in bands of 6, a pair at 0.85 shares a band with probability 0.9999. Columns beside
    doc_id and text play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    signed = materialize(sign(docs, k, m, rows), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    in_band = classes.select("cid", F.explode("bands").alias("key"))
    hubs = in_band.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("far")).where("hub <> far").select("key", "hub")
    buckets = materialize(in_band.join(hubs, "key"), "buckets")
    cand = materialize(buckets.select(F.col("cid").alias("node")).distinct(), "candidates")
    n_cand = cand.count()

    def shingles(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = join_checked(texts, cand, "node", "left_semi", n_cand, 16).transform(map_arrow, shingles, "cid long, shingles binary")
    sets = materialize(sets.where(F.length("shingles") > 0), "sets")
    set_bytes = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0

    def deals(rows: int) -> int:
        """So many that one has about deal_bytes of sets."""
        return int(max(16 * partitions(spark), set_bytes * rows // max(1, n_cand) // deal_bytes + 1))

    # First everyone meets the hubs of its buckets, in chunks of a hub's followers.
    star = materialize(buckets.where("cid <> hub").select("cid", "hub").distinct(), "stars")
    n_star = star.count()
    fan = star.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("chunks"))
    asked = star.join(fan, "hub").select("hub", F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("chunk"), "cid")
    heads = fan.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("cid"))
    met = asked.unionByName(heads).join(sets, "cid").withColumn("deal", F.pmod(F.xxhash64("hub", "chunk"), F.lit(deals(n_star))))
    links = materialize(met.groupBy("deal").applyInArrow(_link_hubs(num=percent, den=100), "u long, v long"), "links")
    # Then the members of buckets that don't all follow one hub meet each other. A bucket of the same
    # members as another is left out; a pair that shares no band doesn't meet, so nothing chains.
    follows = materialize(links.groupBy(F.col("u").alias("cid")).agg(F.min("v").alias("root")), "follows")
    n_follows = follows.count()
    for _ in range(2):  # hubs follow others: go on to where they lead, up to four steps
        up = follows.select(F.col("cid").alias("root"), F.col("root").alias("further"))
        follows = join_checked(follows, up, "root", "left", n_follows, 32).select("cid", F.coalesce("further", "root").alias("root"))
        follows = materialize(follows, "follows")
    at = join_checked(buckets, follows, "cid", "left", n_follows, 32).withColumn("linked", F.coalesce("root", "cid")).drop("root")
    mixed = at.groupBy("key").agg(
        F.min("linked").alias("low"),
        F.max("linked").alias("high"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("cid")).alias("same"),
        F.sum(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 31))).alias("sum"),
        F.min("hub").alias("hub"),
    ).where("low <> high and n > 2")
    mixed = materialize(mixed.groupBy("n", "same", "sum", "hub").agg(F.min("key").alias("root")).select("root", "n"), "mixed")
    n_mixed, n_met, n_big = mixed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > block)).first()
    edges = links
    if n_mixed:
        link = _link_groups(num=percent, den=100)
        rest = join_checked(buckets.select(F.col("key").alias("root"), "cid"), mixed, "root", "inner", n_mixed, 32).join(sets, "cid").select("root", "cid", "n", "shingles")
        if n_big:
            rest = materialize(rest, "rest")
            edges = edges.unionByName(_link_big(rest.where(F.col("n") > block), link, block))
        dealt = rest.where(F.col("n") <= block).select(F.col("root").alias("grp"), "cid", "shingles", F.pmod(F.xxhash64("root"), F.lit(deals(n_met))).alias("deal"))
        edges = edges.unionByName(dealt.groupBy("deal").applyInArrow(link, "u long, v long"))
    roots = materialize(components(edges).where("node <> root").select(F.col("node").alias("cid"), "root"), "roots")
    n_roots = roots.count()
    member = classes.select("set_id", "cid")
    member = join_checked(member, roots, "cid", "left", n_roots, 32).select("set_id", F.coalesce("root", "cid").alias("class_root"))
    # Rows of one doc_id may hold several texts: all take the least root.
    own = roots.select(F.col("cid").alias("doc_id"), F.col("root").alias("own_root"))
    out = signed.join(member, "set_id", "left")
    out = join_checked(out, own, "doc_id", "left", n_roots, 32)
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    comp = F.when(linked, F.least("class_root", "own_root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))


def _link_big(sets: DataFrame, link, block: int) -> DataFrame:
    """Candidate groups beyond `block` documents, in blocks of bounded size.

    First every block is linked within itself, with the group's 64 least ids as common members. What
    is then outside the group's largest component is compared with every block. When all are in
    one component, as with copies of one text, nothing is left to compare.
    """
    sets = sets.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    least = sets.groupBy("root").agg(F.array_sort(F.collect_set(F.when(
        F.pmod(F.xxhash64("cid"), F.col("blocks")) == 0,
        F.col("cid"),
    ))).alias("ids")).select("root", F.explode(F.slice("ids", 1, 64)).alias("cid"))
    common = sets.join(least, ["root", "cid"], "left_semi").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = sets.unionByName(common).withColumn("grp", F.xxhash64("root", "b"))
    first = materialize(keyed.groupBy("grp").applyInArrow(link, "u long, v long"), "links")
    roots = components(first)
    at = sets.select("root", F.col("cid").alias("node")).join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = at.groupBy("root", "comp").agg(F.count("*").alias("c"))
    main = per.groupBy("root").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    out = materialize(at.join(main, "root").where("comp <> main").select("root", F.col("node").alias("cid")), "outside")
    chunks = out.groupBy("root").agg(F.ceil(F.count("*") / block).alias("chunks"))
    sets = sets.join(chunks, "root")
    outside = sets.join(out, ["root", "cid"], "left_semi").withColumn("c", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks"))).withColumn(
        "b",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)),
    )
    rest = sets.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    keyed = outside.unionByName(rest).withColumn("grp", F.xxhash64("root", "b", "c"))
    return first.unionByName(keyed.groupBy("grp").applyInArrow(link, "u long, v long"))
