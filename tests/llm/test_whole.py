"""Whole jobs of the operators, where a cut would keep their tests green."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, token_files
from tests.llm.test_operators import docs


def test_mixing_stage_meets_the_targets_with_long_documents(spark):
    sizes = [("a", 10_000)] * 80 + [("b", 100 + i) for i in range(660)] + [("c", 10_000)] * 50 + [(None, 7)] * 40
    d = docs(spark, ["w " * n for _, n in sizes], source=[s for s, _ in sizes], ids=[None if s is None else i for i, (s, _) in enumerate(sizes)])
    goal = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(d).select("source", "target", "source_size").distinct().collect()}
    step = corpus_pipeline.mix(spark, d, "").collect()
    words = Counter()
    for r in step:
        words[r["source"]] += len(r["text"].split())
    longest = {s: max(n for t, n in sizes if t == s) for s in goal}
    for s, (target, size) in goal.items():
        if s is not None:
            assert abs(words[s] - target) <= longest[s] * math.ceil(size / (1 << 18)) + 256, s
    assert max(Counter(r["doc_id"] for r in step if r["doc_id"] is not None).values()) == 2


def test_token_files_by_the_plain_library_call(spark):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a<|endoftext|>b c.<|endoftext|>. d", "end. <|endoftext|>", "x  <|endoftext|>\n y", "<|endoftext|><|endoftext|> word, <|endoftext|>!", "plain words."]
    got = token_files.token_digests(docs(spark, texts), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    start = 0
    for text, x in zip(texts, got):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rounds_remove_their_own_tables_alone(spark):
    """Two threads of one driver: neither deletes what the other still reads."""
    from concurrent.futures import ThreadPoolExecutor

    from plumbline.llm import common, graph

    def run(k):
        with common.noting() as made:
            kept = common.materialize(spark.range(k, k + 5), f"kept{k}")
            chain = spark.range(k, k + 300).selectExpr("id AS u", "id + 1 AS v").repartition(7)
            found = graph.components(chain)
            again = common.materialize(spark.range(3), f"again{k}")
            return {r["root"] for r in found.collect()}, kept.count(), again.count(), made

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(run, (0, 10_000, 20_000)))
    assert [x[:3] for x in got] == [({k}, 5, 3) for k in (0, 10_000, 20_000)]
    assert all(not set(x[3]) & set(y[3]) for x in got for y in got if x is not y) and not common._NOTED.get()


def test_token_files_in_a_store_that_is_no_disk(spark, tmp_path, monkeypatch):
    """Ranges by offsets through pyarrow's file system, in small blocks; a hot doc_id over several parts."""
    from pyarrow import fs
    from pyspark.sql import functions as F

    texts = [f"some words {i} " * (i % 5) for i in range(60)]
    ids = [None] * 9 + [7] * 31 + list(range(100, 120))
    d = docs(spark, texts, ids=ids)
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for i, t in order:
        enc = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(enc), zlib.crc32(np.array(enc, "<u4").tobytes())))
        start += len(enc)
    folder = str(tmp_path / "tokens")
    manifest = token_files.write(d, folder, P.path("byte_bpe_50k.json"))
    assert manifest.where("docs > 0").count() > 2 and manifest.agg(F.max("docs")).first()[0] < 40

    class Remote(token_files.Store):
        def __init__(self, uri):
            self.local, self.fs, self.path = False, fs.LocalFileSystem(), uri

    for kind, block in ((token_files.Store, 4096), (Remote, 7)):
        store = kind(folder)
        assert store.read("part-00000.bin", manifest.first()["dtype"], 2, 5).tolist() == store.read("part-00000.bin", manifest.first()["dtype"]).tolist()[2:5]
        monkeypatch.setattr(token_files, "Store", kind)
        got = [tuple(r) for r in token_files.read(manifest, folder, block).orderBy("start").collect()]
        assert got == want
    monkeypatch.setattr(token_files, "PART", 1000)
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert token_files.parts_of(data) > 100 and token_files.parts_of(d) == token_files.partitions(spark)
