"""The papers service source against a server of our own, files, providers, pixel kernels, streams."""

import csv
import io
import json
import os
import pickle
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from plumbline.functions import pixels
from plumbline.operators import metadata, papers
from plumbline.sources import files, models, named_files, papers_api, providers
from plumbline.streaming import incremental

DOCS = [{"id": i, "title": f"t{i}", "publication_date": f"{2010 + i % 3}-0{1 + i % 9}-00"} for i in range(25)]


SEEN: list[str] = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        SEEN.append(self.path)
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        body, code = {"message": "ok"}, 200
        if u.path == "/documents":
            some = [d for d in DOCS if d["publication_date"].startswith(q["year"])]
            body = some[int(q["skip"]) : int(q["skip"]) + int(q["limit"])]
        elif u.path.endswith("/pdf"):
            body = "paper"
        elif u.path.startswith("/documents/"):
            found = [d for d in DOCS if d["id"] == int(u.path.split("/")[2])]
            body, code = (found[0], 200) if found else ({}, 404)
        data = json.dumps(body).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_papers_source(spark, server, tmp_path):
    papers_api.register(spark)
    source = lambda **k: spark.read.format("papers_api").option("base_url", server + "/").option("start_year", 2010).option("end_year", 2011).option("page_size", 3).options(**k).load()
    d = source()
    assert sorted(r["id"] for r in d.collect()) == [i for i in range(25) if i % 3 < 2]
    assert [r["title"] for r in source(id=7).collect()] == ["t7"]
    assert source(id=99, missing="ignore").count() == 0
    with pytest.raises(Exception, match="no document 99"):
        source(id=99).count()
    SEEN.clear()
    assert sorted(r["id"] for r in source(start_year=2010, tasks_per_year=3).where("publication_date < '2011'").collect()) == [i for i in range(25) if i % 3 == 0]
    assert source(end_year=2010, tasks_per_year=3).rdd.getNumPartitions() == 3
    pages = [int(x.split("skip=")[1].split("&")[0]) for x in SEEN if "year=2010" in x]
    assert sorted(pages) == [0, 3, 6, 9, 12, 15]  # nine documents, three a page: three tasks, each up to a page that is not full
    # A pushed id asks for one url; a later query of a new frame asks for all.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        SEEN.clear()
        assert [r["title"] for r in source(check="false", push="true").where("id = 7").collect()] == ["t7"] and SEEN == ["/documents/7"]
        assert source(push="true").where("id = 99").count() == 0
        assert source(push="true").where("id > 20").count() == len([i for i in range(21, 25) if i % 3 < 2])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [r["title"] for r in d.where("id = 7").collect()] == ["t7"]
    with pytest.raises(ValueError):
        papers_api.by_id(server, 99)
    with pytest.raises(ConnectionError):
        papers_api.check_health("http://127.0.0.1:9")
    assert open(papers_api.download(server, 1, str(tmp_path / "x.pdf"))).read() == '"paper"'
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    for _ in range(2):
        got = papers_api.download_all(ids, server, str(tmp_path / "pdf")).collect()
        assert sorted((r["id"], r["size"]) for r in got) == [(1, 7), (2, 7)]
    assert papers_api.download_all(ids, "http://127.0.0.1:9", str(tmp_path / "none"), tries=1).where("path is null").count() == 2
    listed = papers.list_papers(d.cache(), "2010-02-00", "2010-12-00")
    assert files.write_csv(listed, str(tmp_path / "p.csv")) == listed.count()
    assert open(tmp_path / "p.csv", "rb").read(3) == b"\xef\xbb\xbf"
    assert files.write_markdown(papers.markdown(d, "2010-01-00", "2011-12-00"), str(tmp_path / "p.md"), "Papers") == 17
    assert open(tmp_path / "p.md", encoding="utf-8").read().count("## t") == 17


def test_csv_and_lines_are_written_in_order(spark, tmp_path):
    rows = [(i, ["plain", 'a "quote"', "a, comma", "two\nlines", "Ünï\r", "", None][i % 7], i / 4) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, `a name` string, x double").repartition(5).orderBy(F.desc("id"))
    assert files.write_csv(d, str(tmp_path / "new" / "t.csv")) == 500
    with open(tmp_path / "new" / "t.csv", newline="", encoding="utf-8-sig") as f:
        got = list(csv.reader(f))
    assert got == [["id", "a name", "x"], *[[str(i), n or "", str(x)] for i, n, x in reversed(rows)]]
    want = io.StringIO()
    csv.writer(want).writerows(got)
    assert (tmp_path / "new" / "t.csv").read_bytes() == b"\xef\xbb\xbf" + want.getvalue().encode()
    assert files.write_csv(d.limit(0), str(tmp_path / "none.csv")) == 0 and (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfid,a name,x\r\n"
    assert os.listdir(tmp_path / "new") == ["t.csv"]


def test_logs_and_copies(spark, tmp_path):
    for name, text in (("b", '{"paper_id": 2, "images": [{"index": 0, "is_solar": true}]}'), ("a", '{"paper_id": 1,\n "images": []}'), ("c", "{broken")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "extraction_log.json").write_text(text)
        (tmp_path / "in" / name / f"paper_{name}.pdf").write_text(name * 3)
    logs = files.extraction_logs(spark, str(tmp_path / "in")).collect()
    assert [(r["folder"], r["paper_id"]) for r in logs] == [("a", 1), ("b", 2)]
    found = files.paper_files(spark, str(tmp_path / "in"))
    listing = found.select("path", F.concat("folder", F.lit("/x.pdf")).alias("name"), "length")
    assert {r["copied"] for r in files.copy_once(listing, str(tmp_path / "out")).collect()} == {True}
    assert {r["copied"] for r in files.copy_once(listing, str(tmp_path / "out")).collect()} == {False}
    files.write_documents(spark.createDataFrame([("a", "{}"), ("b", "[]")], "paper string, body string"), str(tmp_path / "docs"), "paper", "body")
    assert spark.read.text(str(tmp_path / "docs")).count() == 2
    assert files.listing(spark, str(tmp_path / "none")).isEmpty()
    assert sorted(tuple(r) for r in files.listing(spark, str(tmp_path), "*.*").select("folder", "name", "length").collect() if "extraction" not in r["name"]) == [
        ("docs", "a.json", 2),
        ("docs", "b.json", 2),
        *[(f"in/{k}", f"paper_{k}.pdf", 3) for k in "abc"],
        *[(f"out/{k}", "x.pdf", 3) for k in "abc"],
    ]


def test_named_files_come_on_commit_only(spark, tmp_path):
    root = tmp_path / "a b" / "out"
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f "), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content"))
    named_files.write(rows, str(root))
    found = {r["name"]: (r["folder"], r["length"]) for r in files.listing(spark, f"file://{root}").collect()}
    assert len(found) == 40 and found["12.txt"] == ("f 0", 2) and (root / "f 0" / "12.txt").read_text() == "12"
    assert sorted(x.name for x in root.iterdir()) == ["f 0", "f 1", "f 2"]
    # Files of other names stay; one that is there is replaced, by URI too.
    named_files.write(spark.createDataFrame([("f 0/12.txt", "new"), ("g", None)], "name string, content string"), f"file://{root}")
    assert (root / "f 0" / "12.txt").read_text() == "new" and (root / "g").read_bytes() == b"" and (root / "f 0" / "15.txt").exists()
    # A job that fails, by its rows or by a name that leaves the root, leaves nothing.
    late = rows.where("id >= 0").withColumn("content", F.when(F.col("name") == "f 1/37.txt", F.raise_error(F.lit("stop"))).otherwise("x"))
    for bad in (late, rows.withColumn("name", F.concat(F.lit("../"), "name"))):
        with pytest.raises(Exception, match="stop|no name"):
            named_files.write(bad.withColumn("name", F.concat(F.lit(""), "name")), str(root))
        assert sorted(x.name for x in root.iterdir()) == ["f 0", "f 1", "f 2", "g"] and (root / "f 1" / "10.txt").read_text() == "10"


def test_models_are_made_once_a_worker_by_name(spark, tmp_path):
    made = str(tmp_path)

    def maker(kind):
        def make():
            with open(f"{made}/{kind}-{os.getpid()}-{uuid.uuid4().hex}", "w"):
                return lambda chats, **o: [f"{kind} {c[0]['role']} {c[-1]['content']} {o['max_new_tokens']}" for c in chats]

        return make

    prompts = spark.range(40).repartition(8).select(F.when(F.col("id") > 0, F.concat(F.lit("q"), "id")).alias("prompt"))
    a, b = models.Model(f"a {made}", maker("A")), models.Model(f"b {made}", maker("B"), {"max_new_tokens": 9})
    for _ in range(2):
        for m, kind, most in ((a, "A", 512), (b, "B", 9)):
            got = {r["prompt"]: r["raw"] for r in providers.ask(prompts, m, ["x"]).collect()}
            assert len(got) == 40 and got["q7"] == f"{kind} system q7 {most}" and got[None] is None
    names = [x.rsplit("-", 1)[0] for x in os.listdir(made)]
    assert {x[0] for x in names} == {"A", "B"} and len(names) == len(set(names))  # one of a name for each worker process
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    asks = models.Model("c", maker("C"), profile=profile)
    assert providers.ask(prompts, asks, ["x"])._jdf.queryExecution().analyzed().profile().isDefined()
    assert pickle.loads(pickle.dumps(models.Model("d", providers.EchoModel, {"k": 1}, profile))).profile is None
    for k in range(9):  # a worker keeps few
        models.Model(f"e{k}", list).here()
    assert len(models._HERE) <= models.KEPT


def test_answers_are_kept_by_content(spark, tmp_path):
    store, asked = str(tmp_path / "answers"), str(tmp_path / "asked")
    os.makedirs(asked)

    def random_model():
        def answer(chats, **options):
            for c in chats:
                with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
                    f.write(c[-1]["content"])
            return [uuid.uuid4().hex for _ in chats]

        return answer

    model = models.Model(f"random {store}", random_model)
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, prompt string")
    first = {r["id"]: r["raw"] for r in providers.ask_once(prompts, model, ["x"], store).collect()}
    assert first[1] == first[3] != first[2] and first[4] is None and len(os.listdir(asked)) == 2
    more = prompts.union(spark.createDataFrame([(5, "c")], prompts.schema))
    again = providers.ask_once(more, model, ["x"], store)
    for _ in range(2):  # the plan may run again
        assert {k: v for k, v in ((r["id"], r["raw"]) for r in again.collect()) if k < 5} == first
    assert len(os.listdir(asked)) == 3
    other = models.Model(model.name, random_model, {"temperature": 0.7})
    assert {r["id"]: r["raw"] for r in providers.ask_once(prompts, other, ["x"], store).collect()}[1] != first[1]


def test_providers(spark):
    raw = spark.createDataFrame([(1, bytearray(b"Figure 1. A loop\n\nbody Fig. 1\fpage two")), (2, bytearray(b"\xff"))], "paper_id long, content binary")
    blocks = providers.parse_papers(raw, providers.PlainTextParser)
    assert blocks.where("paper_id = 1").count() == 3
    broken = raw.union(spark.createDataFrame([(3, bytearray(b"{"))], raw.schema))
    assert {(r["paper_id"], r["part"], r["error"].split(":")[0]) for r in providers.failures(broken, providers.TextPaper, ("blocks", "images")).collect()} == {(k, part, "UnicodeDecodeError" if k == 2 else "JSONDecodeError") for k in (1, 2, 3) for part in ("blocks", "images")}
    images = spark.createDataFrame([(1, "a flare here"), (2, ""), (3, "a flare here"), (4, "nothing")], "id int, caption_text string")
    got = {r["id"]: (r["structure_label"], r["structure_confidence"]) for r in metadata.classify_captions(images, models.Model("keywords of test", lambda: providers.KeywordClassifier(metadata.STRUCTURES[:-1]))).collect()}
    assert got == {1: ("Flare", 1.0), 2: ("Other", 0.0), 3: ("Flare", 1.0), 4: ("Other", 0.0)}
    answers = providers.ask(spark.createDataFrame([("p",)], "prompt string"), models.Model("echo", providers.EchoModel), ["instrument"])
    assert metadata.parse_answers(answers).select(metadata.field(F.col("parsed"), "instrument").alias("i")).first()["i"] == "AIA"


def test_pixels():
    y, x = np.mgrid[:128, :128]
    disk = np.where((x - 64) ** 2 + (y - 64) ** 2 < 50**2, 200, 5).astype(np.uint8)
    f = pixels.features(np.repeat(disk[..., None], 3, 2))
    assert f["circle"] and f["centred"] and f["border_dark"] == 1.0 and f["mean_s"] == 0
    red = np.zeros((64, 64, 3), np.uint8)
    red[..., 2] = 250
    assert pixels.to_hsv(red)[0, 0].tolist() == [0, 255, 250]
    assert pixels.features(red)["hue_sum"] == 1.0
    assert not pixels.edges(np.full((32, 32), 9, np.uint8)).any()


def test_incremental_takes_new_files_only(spark, tmp_path):
    src = spark.range(5)
    src.write.parquet(str(tmp_path / "in"))
    go = lambda: incremental.run_available(spark, str(tmp_path / "in"), src.schema, lambda s: s.where("id > 0"), str(tmp_path / "out"), str(tmp_path / "cp")).count()
    assert go() == 4
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == 6


def test_batches_run_whole_stages_once(spark, tmp_path):
    """Each batch goes through an aggregate; new files make new batches, and none is taken twice."""
    source, sizes = str(tmp_path / "in"), []
    spark.range(40).selectExpr("id", "id % 2 AS k").repartition(4).write.parquet(source)

    def work(batch):
        sizes.append(batch.count())
        return batch.groupBy("k").agg(F.count("*").alias("n"))

    go = lambda: incremental.run_batches(spark, source, "id long, k long", work, str(tmp_path / "out"), str(tmp_path / "cp"), 1).agg(F.sum("n")).first()[0]
    assert go() == 40 and len(sizes) == 4 and sum(sizes) == 40
    assert go() == 40 and len(sizes) == 4
    spark.range(5).selectExpr("id", "id % 2 AS k").coalesce(1).write.mode("append").parquet(source)
    assert go() == 45 and sizes[-1] == 5
