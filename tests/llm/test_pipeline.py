"""The corpus pipeline: its stages by brute force on a small fixture, edges, and the queries' SQL."""

import base64

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from plumbline.llm import pii, queries
from plumbline.llm.common import DOC_COLUMNS
from tests.llm.test_operators import WORD, docs, groups


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_stages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in d.collect()}
    step = corpus_pipeline.language(spark, d, sf_dir)
    kept = {r["doc_id"]: r for r in step.collect()}
    assert step.columns == DOC_COLUMNS and len(kept) >= 0.99 * len(rows)
    assert sum(r["lang"] == rows[i]["lang"] for i, r in kept.items()) >= 0.98 * len(kept)
    ids = sorted(rows)
    _, root = groups([rows[i]["text"] for i in ids], 80)
    step = corpus_pipeline.near_duplicates(spark, d, sf_dir)
    assert step.columns == DOC_COLUMNS and sorted(r["doc_id"] for r in step.collect()) == [i for k, i in enumerate(ids) if root[k] == k]
    step = corpus_pipeline.personal_data(spark, d, sf_dir)
    assert step.columns == DOC_COLUMNS and {r["doc_id"]: r["text"] for r in step.collect()} == {i: pii.mask_text(r["text"]) for i, r in rows.items()}
    step = corpus_pipeline.mix(spark, d, sf_dir)
    assert step.columns == DOC_COLUMNS
    n = {r["doc_id"]: r["count"] for r in step.groupBy("doc_id").count().collect()}
    assert set(n) <= set(rows) and max(n.values()) == 2
    step = corpus_pipeline.tokens(spark, d, sf_dir).collect()
    assert len(step) == len(rows) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in step)


def targets(size):
    """Words that each source should give, by water filling: weights 5, 2, 1 in order, 150 % of all words,
    at most twice a source's own."""
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), list(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            free.remove(s)
    return target


def plain_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_pipeline_by_brute_force(spark, sf_dir):
    """run() against the stages by plain Python, but for the classifier's own predictions."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id", "lang").collect()}
    rows = sorted((r | {"lang": kept[r["doc_id"]]} for r in rows if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    _, root = groups([r["text"] for r in rows], 80)
    rows = {r["doc_id"]: r | {"text": pii.mask_text(r["text"])} for i, r in enumerate(rows) if root[i] == i}
    size, longest = {}, {}
    for r in rows.values():
        n = len(WORD.findall(r["text"] or ""))
        size[r["source"]] = size.get(r["source"], 0) + n
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    goal = targets(size)
    enc, words, copies = plain_encoder(), dict.fromkeys(goal, 0), {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        want = rows[r["doc_id"]]
        ids = enc.encode_ordinary(want["text"])
        assert (r["lang"], r["source"], r["ids"], r["n_tokens"], r["round_trip"]) == (want["lang"], want["source"], ids, len(ids), True)
        words[r["source"]] += len(WORD.findall(want["text"]))
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    for s, n in goal.items():
        assert abs(words[s] - n) <= longest[s] + 0.02 * n + 60, s


def test_pipeline_edges(spark):
    odd = docs(spark, [None, "", "1 2 3", "the cat sat here today", "the cat sat here today", "x", "the dog ran off now"], ids=[1, 2, 3, 4, 4, None, None]).withColumn("ids", F.lit("clash"))
    seen = []
    step = odd
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
        seen.append(sorted((r["doc_id"] or 0) for r in step.collect()))
        assert name == "byte_bpe" or step.columns == DOC_COLUMNS
    # Texts that are null, empty or without a letter go; of the equal rows one stays, null ids stay.
    assert seen[0] == [0, 0, 4, 4] and seen[1] == seen[2] == [0, 0, 4] and set(seen[3]) <= {0, 4} and seen[4] == seen[3]
    words = sum(len(enc.split()) for enc in (plain_encoder().decode(r["ids"]) for r in step.collect()))
    assert abs(words - 1.5 * 11) <= 5 + 1  # the mix, to the longest document
    step = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
        assert step.count() == 0
    once = corpus_pipeline.near_duplicates(spark, odd, "").where("doc_id = 4")
    assert once.count() == 1
