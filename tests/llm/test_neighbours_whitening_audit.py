"""Approximate neighbours, whitening and the filter audit against brute force on small fixtures: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import math
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ann, filter_audit, whitening
from tests.llm.test_operators import WORD, docs, vectors

# --- 11 -----------------------------------------------------------------------------------------


def test_chi2_quantiles():
    r = np.random.default_rng(0)
    for m, p in ((1, 0.5), (3, 0.9), (16, 0.97)):
        drawn = (r.standard_normal((200_000, m)) ** 2).sum(1)
        assert abs((drawn <= ann.chi2_quantile(m, p)).mean() - p) < 0.005


def test_projected_distances_are_chi2():
    """Two points of one norm, brought to a larger one: their projections' squared distance over their own."""
    r = np.random.default_rng(1)
    v = r.standard_normal((2, 40))
    top = 1.5 * ann.norms(v).max()
    q = v[:1] / ann.norms(v[:1])
    d = 2 * top * (top - float(q[0] @ v[1]))
    p = [((ann.project(v[1:], top, 8, s) - top * ann.project_queries(q, 8, s)) ** 2).sum() / d for s in range(3000)]
    assert abs(np.mean(p) - 8) < 0.25 and abs((np.array(p) <= ann.chi2_quantile(8, 0.9)).mean() - 0.9) < 0.02


def brute(rows, k, every):
    """{query: [(score, vec_id), ...]} by every product."""
    out = {}
    for i, v in rows.items():
        if i % every == 0:
            same = sorted((-float((v * w).sum()), j) for j, w in rows.items() if j != i and len(w) == len(v))
            out[i] = [(-s, j) for s, j in same[:k]]
    return out


def found(df):
    out = {}
    for x in df.collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    return {q: [(s, j) for _, s, j in sorted(x)] for q, x in out.items()}


def recall(got, want):
    return sum(len({j for _, j in w} & {j for _, j in got.get(q, [])}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_nearest(spark):
    """Clusters, norms over many octaves, small shards and several rounds; scores are those of the original
    vectors and the search looks at few of them."""
    r = np.random.default_rng(2)
    x = np.concatenate([c + 0.3 * r.standard_normal((60, 24)) for c in 3 * r.standard_normal((40, 24))]) * np.exp(r.standard_normal((2400, 1)))
    rows = dict(enumerate(np.float32(x).astype(float)))
    data = vectors(spark, [(i, v.tolist(), 0) for i, v in rows.items()])
    want = brute(rows, 10, 20)
    for settings in ({"shard_bytes": 24 * 8 * 100, "first": 1}, {"shard_bytes": 1 << 20, "first": 2}):
        got = found(ann.nearest(data, k=10, **settings))
        assert recall(got, want) >= 0.97 and all(len(x) == 10 for x in got.values())
        score = {q: {j: float((rows[q] * w).sum()) for j, w in rows.items()} for q in want}
        assert all(s == score[q][j] for q, x in got.items() for s, j in x)
        seen = ann.searched(data, 10, 20, 16, 0.97, settings["shard_bytes"], 1 << 16, settings["first"], 7)
        assert seen.agg(F.sum("verified")).first()[0] < 0.2 * len(want) * len(rows)


def test_nearest_is_whole_where_the_test_is_sure(spark):
    r = np.random.default_rng(3)
    rows = dict(enumerate(r.standard_normal((700, 12))))
    got = found(ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>"), k=7, sure=1 - 1e-12, shard_bytes=12 * 8 * 64))
    want = brute(rows, 7, 20)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}


def test_nearest_edges(spark, monkeypatch):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same, 0) for i in range(200)]  # equal vectors: no split divides them, ids break the ties
    rows += [(1000, None, 0), (1020, [], 0), (1040, [0.0, 0.0, 0.0], 0), (1060, [1.0, None, 2.0], 0), (1080, [1.0, float("nan"), 0.0], 0), (1100, [float("inf")] * 3, 0), (None, same, 0)]
    rows += [(2000, [1.0, 2.0], 0), (2001, [3.0, -1.0], 0), (2020, [1.0] * 5, 0), (20, same, 0), (2040, [1e38, -1e38], 0), (2060, [1e-40, 1e-41], 0)]
    data = vectors(spark, rows).withColumn("dim", F.lit("x")).withColumn("band", F.lit(0)).withColumn("sub", F.lit(0)).withColumn("at", F.lit(0))
    for _ in range(2):
        got = found(ann.nearest(data, k=4, shard_bytes=1))
        for q in range(0, 200, 20):
            assert got[q] == [(1.3125, j) for j in [j for j in range(200) if j != q][:4]]
        assert [j for _, j in got[2000]] == [2001, 2060, 2040] and 2020 not in got and not {1000, 1020, 1040, 1060, 1080, 1100} & set(got)
        assert len(got[2060]) == 3 and len(got[2040]) == 3
        monkeypatch.setattr(ann, "CELLS", 1)  # no room for a directory: shards by id
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [(0, [1.0], 0)])).count() == 0


# --- 12 -----------------------------------------------------------------------------------------


def test_moments_are_exact():
    r = np.random.default_rng(0)
    for lo, hi in ((-200, 300), (-(2**40), 2**41), (-(2**63), 2**63 - 1), (5, 6), (2**62, 2**62 + 100)):
        x = r.integers(lo, hi, (50, 5))
        n, s, g = whitening.moments(x)
        o = x.astype(object)
        assert n == 50 and (s == o.sum(0)).all() and (g == o.T @ o).all()


def test_components_of_a_wide_spread():
    """Eigenvalues 30 decades apart, against those that the matrix was made of."""
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((5, 5)))
    one = 1 << 400
    q = np.array([Fraction(float(v)) for v in q.flat], object).reshape(5, 5)
    for a in range(5):  # to unit columns, exactly orthogonal enough
        for b in range(a):
            q[:, a] = q[:, a] - q[:, b] * (q[:, a] @ q[:, b]) / (q[:, b] @ q[:, b])
    length = [q[:, a] @ q[:, a] for a in range(5)]
    value = [10**30, 10**29, 10**12, 7, 1]
    m = sum(np.multiply.outer(q[:, a], q[:, a]) * Fraction(value[a]) / length[a] for a in range(5))
    m = np.array([int(v * one) for v in m.flat], object).reshape(5, 5)
    got = [Fraction(e, 1 << whitening.BITS) / one for e, _ in whitening.components(m, 4)]
    assert all(abs(float(g / v) - 1) < 1e-6 for g, v in zip(got, value))


def test_whiten(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 6)) @ r.standard_normal((6, 6)) + 50  # far from zero
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(x))]
    rows += [(500 + i, rows[0][1], 0) for i in range(40)] + [(7, rows[8][1], 0), (None, rows[9][1], 0)]  # repeated vectors and ids
    rows += [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan")] * 6, 0), (903, [float("-inf")] * 6, 0), (904, [], 0)]
    data = vectors(spark, rows).withColumn("x", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("dim", F.lit(0))
    got = whitening.whiten(data).collect()
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows[:342]]
    fit = np.array(sorted({tuple(v) for _, v in good}))
    n, total = len(fit), fit.sum(0)
    y = fit - fit.mean(0)
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 4 * len(good) and {g["n"] for g in got} == {n} and max(g["identity_error"] for g in got) < 1e-9
    for k in range(4):
        part = sorted(((g["vec_id"] is None, g["vec_id"] or 0, g["deviation"], g["whitened"]) for g in got if g["component"] == k + 1))
        want = sorted((i is None, i or 0, int(((n * v - total) ** 2).sum()), float((v - fit.mean(0)) @ vector[:, k] / math.sqrt(value[k]))) for i, v in good)
        sign = 1 if part[0][3] * want[0][3] > 0 else -1
        assert [p[:3] for p in part] == [w[:3] for w in want] and all(abs(sign * p[3] - w[3]) < 1e-8 for p, w in zip(part, want))
        assert {round(g["explained"], 12) for g in got if g["component"] == k + 1} == {round(value[k] / value.sum(), 12)}


def test_whiten_edges(spark, monkeypatch):
    ddl = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], ddl)).count() == 0  # nothing varies
    # Each length apart; two dimensions have two components, a line has one; values beyond a long are cut.
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0]), (4, [1.0, 3.0]), (10, [1.0, 1.0, 1.0]), (11, [2.0, 2.0, 2.0]), (20, [1e300]), (21, [-1e300])]
    for limit in (whitening.MODELS, 0):  # models sent, and models that rows carry
        monkeypatch.setattr(whitening, "MODELS", limit)
        got = whitening.whiten(spark.createDataFrame(rows, ddl)).collect()
        assert sorted((g["vec_id"], g["component"]) for g in got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2), (10, 1), (11, 1), (20, 1), (21, 1)]
        assert all(abs(abs(g["whitened"]) - 1) < 1e-12 and g["identity_error"] < 1e-12 for g in got)
        assert {g["deviation"] for g in got if g["vec_id"] >= 20} == {2**63 - 1}
        assert {round(g["explained"], 9) for g in got if g["vec_id"] < 5} == {0.9, 0.1}


def test_whiten_a_wide_spread(spark):
    """float64 alone would lose the third and fourth component."""
    r = np.random.default_rng(6)
    x = r.standard_normal((200, 4)) * np.array([2.0**50, 2.0**48, 2.0**10, 1.0])
    x[:, 2:] = np.floor(x[:, 2:] * 4) / 4
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 800 and max(g["identity_error"] for g in got) < 1e-6


# --- 13 -----------------------------------------------------------------------------------------


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        out.append({f for f, b in zip("ABCDE", bad) if b})
    return out


def audit_by_hand(rows, good, toxic):
    bad, out = fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        share, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in bad[k]]
                left = [k for k in left if f not in bad[k]]
                share[f] += len(gone)
                lost = [sum(rows[k][0] in s for k in gone) for s in (good, toxic)]
                lines.append((part, "".join(order), step, len(left), len(gone), sum(f in bad[k] for k in mine) - len(gone), sum(bad[k] == {f} for k in mine), *lost, f))
        out += [(*x[:-1], share[x[-1]]) for x in lines]
    return sorted(out)


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " #", long.upper(), "a " * 300, "A a " * 150, "", None, "Ä é 𝔸 B", " \t\x0b ", long, None, "x" * 300_000 + "\x1c $", "word word " * 400, long + " |", "a " * 300]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (3, texts[3], "de"), (None, long, "fr"), (None, long, "fr"), (50, long, "en"), (51, "only here", "it")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit(1)).withColumn("mask", F.lit(1)).withColumn("digest", F.lit("x"))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, 1, None), (50, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int").withColumn("n", F.lit(9))
    want = audit_by_hand(rows, {0, 3, 5}, {0, 50, 5})
    assert sorted(map(tuple, filter_audit.filter_audit(data, labels).collect())) == want
    assert len(want) == 600 * 5
    none = filter_audit.filter_audit(data, labels.where("false")).collect()
    assert sorted((*x[:7], x[9]) for x in map(tuple, none)) == [(*x[:7], x[9]) for x in want] and {(x["good_lost"], x["toxic_lost"]) for x in none} == {(0, 0)}
    assert filter_audit.filter_audit(docs(spark, []), labels).count() == 0


def test_survivors_of_every_subset():
    r = np.random.default_rng(7)
    counts = r.integers(0, 9, (2, 2, 2, 2))
    left = filter_audit.survivors(counts)
    for subset in np.ndindex(2, 2, 2):
        assert left[(0, *subset)] == sum(counts[(0, *m)] for m in np.ndindex(2, 2, 2) if not any(a and b for a, b in zip(subset, m)))
