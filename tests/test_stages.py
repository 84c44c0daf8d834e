"""Stages end to end on stand-ins: providers, rasters, logs and files, the command line."""

import base64
import csv
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from plumbline import __main__ as cli, stages
from plumbline.functions import pixels, rasters, sql, text as X
from plumbline.operators import archive, captions, figures, matching, metadata
from plumbline.sources import files, models, providers
from plumbline.streaming import incremental


def png_pixels(raw):
    """Gray PNG bytes to rows."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, size, body = 8, None, b""
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        data = raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + data) == int.from_bytes(raw[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            size = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
        if kind == b"IDAT":
            body += data
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], -1)
    return rows[:, 1:]


def disk(n=64):
    return rasters.write_fits(np.arange(n * n, dtype=float).reshape(n, n) - 100, {"CRPIX1": n / 2 + 0.5, "CRPIX2": n / 2 + 0.5, "CDELT1": 2400 / n, "CDELT2": 2400 / n, "TELESCOP": "SDO"})


def test_fits_and_world_coordinates():
    r = rasters.read_fits(disk())
    assert r.data.shape == (64, 64) and r.data[1, 2] == 66 - 100 and r.header["TELESCOP"] == "SDO"
    x, y = r.pixel(*r.world(3.25, 60))
    assert (x, y) == pytest.approx((3.25, 60))
    c = r.crop(0, 0, 300, 150)
    assert c.world(*c.pixel(10, 20)) == pytest.approx((10, 20)) and c.data.shape == (5, 9) and c.data[0, 0] == r.data[32, 32]
    assert r.crop(5000, 5000, 6000, 6000) is r
    assert rasters.read_fits(b"no fits") is None and rasters.read_fits(b"") is None
    assert rasters.read_fits(disk()[:3000]) is None  # cut short
    assert rasters.normalise(np.array([[-2.0, 1.0], [np.nan, 4.0]])).tolist() == [[127, 63], [0, 255]]
    assert png_pixels(rasters.write_png(np.arange(6, dtype=np.uint8).reshape(2, 3))).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert rasters.cmyk_to_rgb(np.array([[[0, 255, 0, 0]]], np.uint8)).tolist() == [[[255, 0, 255]]]
    assert rasters.denoise(np.full((12, 12), 9, np.uint8)).tolist() == np.full((12, 12), 9).tolist()
    assert rasters.grid(1, 2, 3, 4).tolist() == [[1, 2], [2, 2], [1, 3], [2, 3]]
    assert rasters.to_rgb(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)


KEYWORDS = models.Model("flare or loop", lambda: providers.KeywordClassifier(["Flare", "Loop"]))
ECHO = models.Model("echo", providers.EchoModel)


def paper(k):
    image = {"rectangle": [50, 30, 400, 90], "width": 300, "height": 300, "colour": 3, "data": base64.b64encode(b"x").decode()}
    text = f"On loops by Y. Song,\n\nFig. 1. The flare {k}\n\nas Fig. 1 shows, loops move\fFig. 2. A loop"
    return json.dumps({
        "text": text,
        "author": None if k == 2 else f"Author {k}",
        "images": [image | {"page": 1, "xref": 7}, image | {"page": 1, "xref": 7}, image | {"page": 2, "xref": 8, "rectangle": None}],
    }).encode()


def fixture(spark):
    papers = spark.createDataFrame(
        [(k, f"Title {k}", " Song, Y.; Doe, J.", "2012-03-00", None, "2012ApJ...1..2D", None, None, None) for k in (1, 2, 3)],
        "id long, title string, authors string, publication_date string, doi string, bibcode string, citation_count long, ads_url string, abstract string",
    )
    content = spark.createDataFrame([(1, paper(1)), (2, paper(2)), (3, b"broken")], "paper_id long, content binary")
    blocks = providers.parse_papers(content, providers.TextPaper)
    values = {"border_white": 0.0, "border_dark": 0.4, "dark": 0.285, "circle": True, "centred": True, "radius": 70.9, "hue_sum": 0.2, "mean_s": 90.0, "std": 30.0, "edge": 0.0, "interior_white": 0.0}
    features = spark.createDataFrame([(k, x) for k in (1, 2) for x in (7, 8)], "paper_id long, xref long").withColumns({c: F.lit(v) for c, v in values.items()})
    return papers, content, blocks, features


def test_extract_label_and_metadata(spark, tmp_path):
    papers, content, blocks, features = fixture(spark)
    sights = providers.scan_images(content, providers.TextPaper)
    assert sights.count() == 6 and blocks.where("paper_id = 3").count() == 0
    p = stages.folders(papers, spark.createDataFrame([(1, "x")], "paper_id long, page_text string"))
    assert {r["folder"] for r in p.collect()} == {"2012-03 - Song, Y"}
    p = p.withColumn("folder", F.concat("folder", F.lit(" "), F.col("id").cast("string")))
    x = stages.extract_figures(p, sights.drop("data"), features)
    signals = ["dark_background", "dark_region_28%", "full_disk_circle_r70", "aia_false_color_20%"]
    assert [(r["index"], r["signals"], r["image_type"]) for r in x.scored.where("paper_id = 1").orderBy("index").collect()] == [(0, signals, "aia_false_color"), (1, signals, "aia_false_color")]
    assert x.kept.count() == 4 and figures.progress(x.scored).where("paper_id = 1").orderBy("index").first()["line"].startswith("    [SOLAR] img-000 p1 300x300 rgb score=1.00 [dark_background, dark_region_28%, full_disk")
    # Logs as written can be read again, as they are; a later run keeps those of other papers.
    logs = x.logs.join(p.select(F.col("id").alias("paper_id"), "folder"), "paper_id")
    for part in ("paper_id < 3", "paper_id = 3"):
        files.write_logs(logs.where(part), str(tmp_path / "in"))
    assert sorted(os.listdir(tmp_path / "in")) == [f"2012-03 - Song, Y {k}" for k in (1, 2, 3)]
    again = files.extraction_logs(spark, str(tmp_path / "in")).drop("folder")
    assert sorted(map(str, again.select(x.logs.columns).collect())) == sorted(map(str, x.logs.collect()))
    assert [(
        r["paper_id"],
        r["total_images_found"],
        r["solar_images_saved"],
        r["first_author"],
    ) for r in x.logs.orderBy("paper_id").collect()] == [(1, 2, 2, "Song, Y"), (2, 2, 2, "Song, Y"), (3, 0, 0, "Song, Y")]
    there = spark.createDataFrame([("2012-03 - Song, Y 1", "solar_001_p1_aia_false_color.png")], "folder string, name string")
    labels = stages.label_figures(x.scored, blocks, p, KEYWORDS, there).orderBy("paper_filename", "figure_label").collect()
    assert [(r["figure_label"], r["caption_match_confidence"], r["structure_label"], bool(r["image_path"])) for r in labels] == [
        ("", "none", "Other", False),
        ("Fig. 1", "same_page", "Flare", True),
        ("", "none", "Other", False),
        ("Fig. 1", "same_page", "Flare", False),
    ]
    assert {(r["paper_id"], r["captions"], r["pages"]) for r in stages.caption_counts(blocks).collect()} == {(1, 2, 2), (2, 2, 2)}
    who = p.select(F.col("id").alias("paper_id"), F.concat("last", F.lit(", "), "initial").alias("first_author")).join(providers.paper_authors(content, providers.TextPaper), "paper_id")
    done = spark.createDataFrame([(2,)], "paper_id long")
    docs = {r["paper_id"]: r for r in stages.extract_metadata(x.scored, blocks, who, KEYWORDS, ECHO, done).collect()}
    assert {k: (r["status"], r["n_observations"], r["paper_authors"]) for k, r in docs.items()} == {1: ("success", 2, "Author 1"), 2: ("skipped", 0, "Song, Y"), 3: ("failed", 0, "Song, Y")}
    one = json.loads(docs[1]["observations"])
    assert one[0]["figure"] == 1 and one[0]["instrument"] == "AIA" and one[0]["phenomenon"] == "Flare" and one[0]["paragraphs"] == ["as Fig. 1 shows, loops move"]
    assert one[0]["wavelength_angstrom"] == 171 and one[0]["fov_arcsec"] is None  # numbers as numbers, what is absent as null
    assert one[1]["confidence"] == 0.0 and one[1]["phenomenon"] == "Other"
    s = stages.summary(spark.createDataFrame([(r["status"],) for r in docs.values()], "status string")).first()
    assert tuple(s) == (1, 1, 1, 3)
    assert providers.messages("q", ["a"])[0]["role"] == "system"


def test_rejections(spark):
    d = spark.createDataFrame([(100, 300, "f", True), (300, 300, "", True), (300, 300, "f", False), (None, None, "f", False)], "width int, height int, file_path string, readable boolean")
    d = d.withColumns({c: F.lit(0.0) for c in (
        "border_white",
        "border_dark",
        "dark",
        "radius",
        "hue_sum",
        "mean_s",
        "std",
        "edge",
        "interior_white",
    )}).withColumns({"circle": F.lit(False), "centred": F.lit(False)})
    got = figures.score(d).collect()
    assert [r["signals"] for r in got] == [["too_small"], ["no_file_path"], ["unreadable"], ["unreadable"]] and all(r["image_type"] == "rejected" and r["score"] == 0 for r in got)
    raw = bytes(range(48))
    images = spark.createDataFrame(
        [("a", 4, 4, 3, raw), ("b", 4, 4, 1, raw[:16]), ("c", -1, -1, -1, b""), ("d", None, None, None, None), ("e", 9, 9, 3, raw)],
        "origin string, width int, height int, nChannels int, data binary",
    )
    assert {r["origin"]: r["readable"] for r in pixels.raster_features(images).collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert figures.score(pixels.raster_features(images)).where("signals[0] = 'unreadable'").count() == 3
    assert pixels.raster_features(images.limit(0)).count() == 0


KEY = ["paper", "event_index"]


def events(spark):
    body = [
        {"timestamp_start": "2012-01-01T00:00:30", "instrument": "AIA", "wavelength_angstrom": 171, "center_tx_arcsec": 100, "center_ty_arcsec": 0, "confidence": "high"},
        {"timestamp_start": "2012-01-01T00:00:30Z", "limb_position": "NW", "confidence": "medium"},
        {"timestamp_start": "2012-02-01", "confidence": "low"},
        {"timestamp_start": None},
    ]
    docs = spark.createDataFrame([("p 1", "success", json.dumps(body)), ("p 2", "failed", "[]")], "paper string, status string, observations string")
    records = spark.createDataFrame(
        [(1, "2012-01-01 00:01:00", "AIA", 171), (2, "2012-01-01 00:00:10", "AIA", 304), (3, "2012-02-01 00:00:00", "HMI", 0), (4, "2012-02-01 00:00:01", "HMI", 0)],
        "record_id long, ts string, instrument string, wavelength int",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    return docs, stages.events_of(docs), records


def test_observations_are_fetched_cut_and_written(spark, tmp_path):
    _, e, records = events(spark)
    m = stages.match_observations(e, records)
    assert [(r["event_index"], r["record_id"], r["status"]) for r in m.orderBy("event_index").collect()] == [(0, 1, "strategy_a"), (1, 2, "strategy_b"), (2, 3, "strategy_c"), (3, None, "failed")]
    root = tmp_path / "archive"
    os.makedirs(root)
    for k in (1, 2):
        (root / f"record-{k}.fits").write_bytes(disk())
    (root / "record-3.fits").write_bytes(b"broken")
    make = lambda: providers.FolderArchive(str(root))
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    got = {r["event_index"]: r for r in stages.fetch_and_render(m, make, cache, out).collect()}
    assert {k: r["status"] for k, r in got.items()} == {0: "strategy_a", 1: "strategy_b", 2: "failed", 3: "failed"}
    assert got[0]["cut"]["tx_min"] == pytest.approx(-50, abs=20) and got[0]["cut"]["ty_max"] == pytest.approx(150, abs=20)
    body = json.loads((tmp_path / "out" / "p_1__000.json").read_text())
    assert body["strategy"] == "strategy_a" and body["fits_file"] == "p_1__000__AIA__171__2012-01-01T00_00_30.fits" and body["bounds_arcsec"] == got[0]["cut"].asDict() and body["observation"]["instrument"] == "AIA"
    assert png_pixels((tmp_path / "out" / "p_1__000.png").read_bytes()).shape == (9, 9)
    # A second run skips what is there; what was fetched is in the cache.
    done = spark.createDataFrame([(x,) for x in os.listdir(out)], "output string")
    cached = spark.createDataFrame([(x, os.path.join(cache, x)) for x in os.listdir(cache)], "cache_key string, path string")
    again = stages.match_observations(e, records, done, cached)
    assert [(r["event_index"], r["record_id"], r["status"]) for r in again.orderBy("event_index").collect()] == [
        (0, None, "skipped"),
        (1, None, "skipped"),
        (2, None, "strategy_c"),
        (3, None, "failed"),
    ]
    assert {r["status"] for r in stages.fetch_and_render(m, make, cache, out).where("event_index < 2").collect()} == {"skipped"}


def test_window_match_by_wavelength_and_distance(spark):
    _, e, records = events(spark)
    one = e.where("event_index = 0").drop("wavelength").withColumn("wavelength", F.lit(None).cast("int"))
    got = [archive.window_match(one, records, seconds, nearest, wavelength=True, key=KEY).first()["record_id"] for seconds, nearest in ((60, False), (60, True), (20, False), (25, False))]
    assert got == [2, 2, 2, 2] and archive.window_match(one, records, 19, key=KEY).first()["record_id"] is None
    assert archive.window_match(e.where("event_index = 0"), records, wavelength=True, key=KEY).first()["record_id"] == 1


def test_window_match_splits_hot_times(spark):
    """Half of both sides in one minute and instrument, many at one instant: the same matches by slots as by
    buckets, in slots of bounded size."""
    t = "timestamp_micros(1704067200000000 + CASE WHEN id % 2 = 0 THEN 1800000000 + CASE WHEN id % 3 = 0 THEN 7 ELSE bigint(hash(id, {0}) % 30000000) END ELSE bigint(pmod(hash(id, {0}), 3600)) * 1000000 END)"
    made = lambda n, salt: spark.range(n).selectExpr("id", t.format(salt) + " AS ts", "CASE WHEN id % 2 = 0 THEN 'AIA' WHEN id % 5 = 1 THEN 'HMI' WHEN id % 5 = 3 THEN '' END AS instrument", "int(CASE WHEN id % 7 < 4 THEN 171 WHEN id % 7 = 4 THEN 304 WHEN id % 7 = 5 THEN 0 END) AS wavelength")
    obs, records = made(900, 1).withColumnRenamed("id", "obs_id").cache(), made(800, 2).withColumnRenamed("id", "record_id").cache()
    for extra, apart in ((True, False), (False, False), (True, True)):
        by = [{tuple(r[c] for c in ("obs_id", "record_id", "record_ts")) for r in archive.window_match(obs, records, wavelength=extra, apart=apart, most_pairs=most, slot_rows=50).collect()} for most in (10**9, 0)]
        assert by[0] == by[1] and len(by[0]) == 900 and sum(x[1] is not None for x in by[0]) > 700
    g = records.select(F.lit("x").alias("g"), F.col("ts").alias("a_ts"), "record_id")
    points = obs.select(F.lit("x").alias("g"), F.col("ts").alias("t"), "obs_id")
    found = archive.first_after(points, g, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    want = sorted((r["a_ts"], r["record_id"]) for r in g.collect())
    for r in found.collect():
        after = [x for x in want if x[0] >= r["t"]]
        # Of one time the two of least id are enough for two.
        assert [tuple(x) for x in r["next"]] == after[:2]
    load = archive.match_load(points, g, 50).agg(F.max("n"), F.count("*")).first()
    assert load[0] <= 4 * 50 and load[1] > 20
    assert archive.window_match(obs.limit(0), records, most_pairs=-1).count() == 0
    assert archive.window_match(obs, records.limit(0), most_pairs=-1).where("record_id is null").count() == 900


def test_command_line(spark, tmp_path, capsys):
    papers, _, blocks, _ = fixture(spark)
    t = {n: str(tmp_path / n) for n in ("papers", "pdf", "blocks", "records", "lists", "figures", "labels", "meta", "fits", "archive", "cut", "answers")}
    papers.write.parquet(t["papers"])
    os.makedirs(t["pdf"])
    y, x = np.mgrid[0:300, 0:300]
    disk_ = np.where((x - 150) ** 2 + (y - 150) ** 2 <= 120**2, 200, 0).astype(np.uint8)
    bgr = np.stack([(disk_ * 0.05).astype(np.uint8), (disk_ * 0.55).astype(np.uint8), disk_], 2).tobytes()  # orange
    for k in (1, 2):
        body = json.loads(paper(k))
        for i in body["images"][:2]:
            i["data"] = base64.b64encode(bgr).decode()
        body["images"][2]["data"] = base64.b64encode(b"\xff" * (300 * 300 * 3)).decode()  # all white
        (tmp_path / "pdf" / f"paper_{k}.pdf").write_text(json.dumps(body))
    (tmp_path / "pdf" / "paper_3.pdf").write_text("broken")
    blocks.write.parquet(t["blocks"])
    assert cli.run(spark, ["list", "--papers", t["papers"], "--start", "2012-01-01", "--end", "2012-12-31", "--output", t["lists"] + "/x"]) == 0
    assert sorted(os.listdir(t["lists"])) == ["x_20120101_20121231.csv", "x_20120101_20121231.md"]
    given = ["--papers", t["papers"], "--files", t["pdf"]]
    for _ in range(2):
        assert cli.run(spark, ["extract", *given, "--output-dir", t["figures"], "--keep-pdf"]) == 0
    folders = {f"2012-03 - Song, Y{k}": i for i, k in enumerate(("", " 2", " 3"), 1)}
    assert sorted(os.listdir(t["figures"])) == sorted(folders)
    solar = "solar_001_p1_aia_false_color.png"
    for f, i in folders.items():
        assert sorted(os.listdir(f"{t['figures']}/{f}")) == ["extraction_log.json", f"paper_{i}.pdf", *([solar] if i < 3 else [])]
    logs = {r["paper_id"]: r for r in files.extraction_logs(spark, t["figures"]).collect()}
    assert {k: (r["total_images_found"], r["solar_images_saved"]) for k, r in logs.items()} == {1: (2, 1), 2: (2, 1), 3: (0, 0)}
    assert png_pixels(open(f"{t['figures']}/2012-03 - Song, Y/{solar}", "rb").read())[150, 450:453].tolist() == [200, 110, 10]
    said = capsys.readouterr().out
    assert "3 papers" in said and "2 of 4 images" in said and "1 papers without blocks\n1 papers without images" in said and "3 files kept" in said and "0 files kept" in said
    os.remove(f"{t['figures']}/2012-03 - Song, Y 2/{solar}")
    assert cli.run(spark, ["label", *given, "--figures-dir", t["figures"], "--output-dir", t["labels"]]) == 0
    with open(t["labels"] + "/labels.csv", encoding="utf-8-sig") as f:
        labels = {r["paper_filename"]: r["image_path"] for r in csv.DictReader(f)}
    assert labels == {"2012-03 - Song, Y.pdf": f"images/2012-03 - Song, Y/{solar}", "2012-03 - Song, Y 2.pdf": ""}
    assert "2 labels; 4 captions on 4 pages" in capsys.readouterr().out
    # A second run skips what is written, and asks nothing again.
    for told in ("2 processed, 0 skipped, 1 failed of 3", "0 processed, 3 skipped, 0 failed of 3"):
        assert cli.run(spark, ["metadata", *given, "--output-dir", t["meta"], "--answers", t["answers"]]) == 0
        assert told in capsys.readouterr().out
    assert sorted(os.listdir(t["meta"])) == sorted(f"{f}.json" for f in folders)
    one = json.loads((tmp_path / "meta" / "2012-03 - Song, Y.json").read_text())
    assert (one["paper_title"], one["paper_authors"], one["status"]) == ("Title 1", "Author 1", "success") and one["observations"][0]["wavelength_angstrom"] == 171
    events(spark)[2].write.parquet(t["records"])
    os.makedirs(t["archive"])
    query = ["query", "--metadata-dir", t["meta"], "--records", t["records"], "--archive-dir", t["archive"], "--fits-dir", t["fits"], "--output-dir", t["cut"]]
    assert cli.run(spark, query) == 0 and "failed: 2" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="no table"):
        cli.run(spark, ["extract", "--papers", t["papers"], "--images", str(tmp_path / "none"), "--output-dir", t["figures"]])
    with pytest.raises(SystemExit, match="no folder"):
        cli.run(spark, [*query[:2], str(tmp_path / "none"), *query[3:]])
    with pytest.raises(SystemExit, match="no no.such:thing"):
        cli.run(spark, ["metadata", *given, "--output-dir", t["meta"], "--model", "no.such:thing"])
    with pytest.raises(SystemExit):
        cli.run(spark, ["list"])


def test_typed_observations_reach_the_query_stage(spark):
    """Numbers, arrays and texts of numbers as the model gave them; what can't be read gives the full map."""
    answers = [
        {"confidence": "high", "center_tx_arcsec": -550, "center_ty_arcsec": -250, "fov_arcsec": [400, 400], "wavelength_angstrom": 171},
        {"confidence": "high", "center_tx_arcsec": "-550", "center_ty_arcsec": "-250.0", "wavelength_angstrom": "304"},
        {"confidence": "high", "center_tx_arcsec": "west", "center_ty_arcsec": 0},
        {"confidence": "high", "center_tx_arcsec": 0, "center_ty_arcsec": 0, "fov_arcsec": "[400, 200]"},
        {"confidence": "high", "center_tx_arcsec": 0, "center_ty_arcsec": 0, "fov_arcsec": []},
        {"confidence": "medium", "limb_position": "NW", "center_tx_arcsec": 1},
        {"confidence": 0, "phenomenon": ""},
    ]
    i = spark.createDataFrame([(1, k, "x", "Fig. 2a", "c", ["p"], "Flare", 0.25, json.dumps(a)) for k, a in enumerate(answers)], "paper_id long, index long, name string, figure_label string, caption_text string, paragraphs array<string>, structure_label string, structure_confidence double, raw string")
    p = spark.createDataFrame([(1, "A, B", None, "T"), (2, "C, D", "E", None)], "paper_id long, first_author string, pdf_author string, paper_title string")
    docs = {r["paper_id"]: r for r in metadata.documents(metadata.observations(metadata.parse_answers(i)), p).collect()}
    assert (docs[1]["paper_title"], docs[2]["paper_title"], docs[2]["paper_authors"], docs[2]["status"]) == ("T", "", "E", "failed")
    written = json.loads(docs[1]["observations"])
    assert written[0]["fov_arcsec"] == [400, 400] and written[0]["center_tx_arcsec"] == -550 and written[1]["center_tx_arcsec"] == "-550" and written[2]["fov_arcsec"] is None
    assert written[6]["confidence"] == 0.25 and written[6]["phenomenon"] == "Flare" and written[0]["figure"] == 2
    e = stages.events_of(spark.createDataFrame([("p", "success", docs[1]["observations"]), ("q", "success", "no json"), ("r", "failed", "[]")], "paper string, status string, observations string"))
    got = e.orderBy("event_index").collect()
    full = (-1200.0, -1200.0, 1200.0, 1200.0)
    assert [(r["strategy"], tuple(r["bounds"][c] for c in ("tx_min", "ty_min", "tx_max", "ty_max"))) for r in got] == [
        ("strategy_a", (-750.0, -450.0, -350.0, -50.0)),
        ("strategy_a", (-700.0, -400.0, -400.0, -100.0)),
        ("strategy_a", full),
        ("strategy_a", full),
        ("strategy_a", (-150.0, -150.0, 150.0, 150.0)),
        ("strategy_b", (-800.0, 200.0, -100.0, 800.0)),
        ("strategy_c", full),
    ]
    assert [r["wavelength"] for r in got[:3]] == [171, 304, None] and "__171__" in got[0]["cache_key"] and "__na__" in got[2]["cache_key"]


def test_small_expressions(spark):
    d = spark.createDataFrame([(" Song, Y. B.; Doe, J.", " K. I. Tian "), ("x", None)], "a string, b string")
    got = d.select(X.author_of_field(F.col("a")).alias("a"), X.author_of_field(F.col("b")).alias("b")).collect()
    assert tuple(got[0]["a"]) == ("Song", "Y") and tuple(got[0]["b"]) == ("Tian", "K") and got[1]["a"] is None
    assert len(spark.range(1).select(metadata.candidates().alias("c")).first()["c"]) == 19
    q = spark.createDataFrame([(1, 2.0, 3.0)], "q_id long, x double, y double")
    t = spark.createDataFrame([(5, 4.0, 6.0)], "t_id long, x double, y double")
    m = spark.createDataFrame([(1, 5)], "q_id long, t_id long")
    assert matching.gather(m, q, t).select("qx", "qy", "tx", "ty").first() == (2.0, 3.0, 4.0, 6.0)
    v = spark.createDataFrame([(0.5, False), (7.0, True)], "v double, whole boolean")
    assert [r[0] for r in v.select(archive.figure_uint8(F.col("v"), F.col("whole"))).collect()] == [127, 7]
    lines = spark.sql("SELECT array(named_struct('spans', array(named_struct('text', 'a'), named_struct('text', 'b'))), named_struct('spans', array(named_struct('text', 'c ')))) AS l")
    assert lines.select(X.block_text(F.col("l"))).first()[0] == "ab c"


def test_figures_are_saved(spark, tmp_path):
    bgr = bytes([1, 2, 3, 4, 5, 6])
    d = spark.createDataFrame(
        [("f", "a", 2, 1, 3, bgr), ("f", "b", 2, 1, 1, b"\x07\x08"), ("g", "c", 1, 1, 4, b"\x00\xff\x00\x00"), ("g", "d", 9, 9, 3, bgr), ("g", "e", None, None, None, None)],
        "folder string, name string, width int, height int, nChannels int, data binary",
    )
    files.save_figures(d, str(tmp_path))
    assert sorted((r["folder"], r["name"]) for r in files.listing(spark, str(tmp_path), "*.png").collect()) == [("f", "a.png"), ("f", "b.png"), ("g", "c.png")]
    assert png_pixels((tmp_path / "f" / "a.png").read_bytes()).tolist() == [[3, 2, 1, 6, 5, 4]]
    assert png_pixels((tmp_path / "f" / "b.png").read_bytes()).tolist() == [[7, 8]]
    assert png_pixels((tmp_path / "g" / "c.png").read_bytes()).tolist() == [[255, 0, 255]]
    assert sorted(os.listdir(tmp_path)) == ["f", "g"] and sorted(os.listdir(tmp_path / "g")) == ["c.png"]


def test_keypoints_records_and_sizes(spark):
    d = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (2, 1, 0.1)], "image_id int, point_id int, response double")
    assert sorted((r["image_id"], r["point_id"]) for r in matching.strongest(d, 2).collect()) == [(1, 1), (1, 2), (2, 1)]
    r = spark.createDataFrame([(1, "intensity"), (2, "LOS_magnetic_field"), (3, None)], "record_id int, physobs string")
    assert [x["record_id"] for x in archive.records_of(r).collect()] == [1]
    assert spark.range(1).select(X.megabytes(F.lit(1_468_006))).first()[0] == 1.4 and X.compact_date("2012-03-04") == "20120304"


def test_images_from_files_to_scores(spark, tmp_path):
    """PNG files through the image source, the pixel kernel and the score; a broken file is rejected."""
    y, x = np.mgrid[0:300, 0:300]
    disk_ = np.where((x - 150) ** 2 + (y - 150) ** 2 <= 120**2, 200, 0).astype(np.uint8)
    rgb = np.stack([disk_, (disk_ * 0.55).astype(np.uint8), (disk_ * 0.05).astype(np.uint8)], 2)  # orange
    (tmp_path / "sun.png").write_bytes(rasters.write_png(rgb))
    (tmp_path / "gray.png").write_bytes(rasters.write_png(disk_))
    (tmp_path / "white.png").write_bytes(rasters.write_png(np.full((300, 300), 255, np.uint8)))
    (tmp_path / "small.png").write_bytes(rasters.write_png(disk_[:50, :50]))
    (tmp_path / "broken.png").write_bytes(b"no image")
    features = pixels.raster_features(files.images(spark, str(tmp_path))).withColumn("name", F.element_at(F.split("origin", "/"), -1))
    got = {r["name"]: r for r in figures.score(features).collect()}
    assert got["sun.png"]["is_solar"] and got["sun.png"]["image_type"] == "aia_false_color" and any(s.startswith("full_disk_circle_r1") for s in got["sun.png"]["signals"])
    assert got["gray.png"]["is_solar"] and any(s.startswith("hmi_grayscale_sat0.0") for s in got["gray.png"]["signals"])
    assert got["white.png"]["raw"] < 0 and not got["white.png"]["is_solar"] and got["white.png"]["score"] == 0
    assert got["small.png"]["signals"] == ["too_small"] and got["broken.png"]["signals"] == ["unreadable"]
    c = spark.createDataFrame([(150.0, 150.0), (10.0, 150.0), (150.0, 225.0)], "cx double, cy double")
    assert [r[0] for r in c.select(figures.centred_circle(F.col("cx"), F.col("cy"), F.lit(300), F.lit(300))).collect()] == [True, False, False]


def test_all_are_kept_but_those_too_small(spark):
    d = spark.createDataFrame([(1, 0, 1, "f", ["too_small"], "rejected"), (1, 1, 1, None, ["x"], "unknown"), (1, 2, 3, "f", [], "unknown")], "paper_id long, index long, page int, file_path string, signals array<string>, image_type string")
    d = d.withColumns({"is_solar": F.lit(False), "score": F.lit(0.0)})
    assert [r["name"] for r in figures.kept_names(d, save_all=True).collect()] == ["img_001_p3_unknown"]
    assert figures.kept_names(d).count() == 0


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")]
    d = spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    counts = incremental.windowed_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "ts", "k")
    counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("windowed").select(F.date_format("window.start", "HH:mm").alias("at"), "k", "n").collect()
    assert sorted(map(tuple, got)) == [("00:00", "a", 2), ("01:00", "b", 1)]


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_neighbours_by_pivots_are_exact(spark, metric):
    """On clusters few distances are computed; ties, equal rows and far queries included, the result is that of all
    distances."""
    r = np.random.default_rng(0)
    train = np.concatenate([c + r.normal(size=(50, 6)) for c in 20 * r.normal(size=(24, 6))]) if metric == "l2" else r.integers(0, 256, (600, 12))
    train[100:140] = train[99]
    asked = np.concatenate([train[::4], train[:1] + 1000]) if metric == "l2" else train[::4]
    rows = lambda x, key, step: spark.createDataFrame([(step * i, [float(v) for v in a]) for i, a in enumerate(x)] + [(10**6, None)], f"{key} long, vec array<double>")
    q, t = rows(asked, "q_id", 4), rows(train, "t_id", 1)
    for apart in (False, True):
        found, effort = matching.nearest_by_pivots(q, t, 3, metric, 32, apart, cell_rows=40)
        d = matching.distances(asked.astype(float), train.astype(float), metric)
        want = set()
        for i, row in enumerate(d):
            near = sorted((x, j) for j, x in enumerate(row.tolist()) if not (apart and j == 4 * i))[:3]
            want |= {(4 * i, j, x, k + 1) for k, (x, j) in enumerate(near)}
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "t_id"))
        assert set(map(tuple, found.withColumn("rank", rank).where("rank <= 3").select("q_id", "t_id", "distance", "rank").collect())) == want
        by_default = matching.nearest(q, t, 3, metric, 32, apart, most_blocks=1)
        assert set(map(tuple, by_default.select("q_id", "t_id", "distance", "rank").collect())) == want
        if metric == "l2":
            assert effort.agg(F.sum("n")).first()[0] < 0.3 * len(asked) * len(train)
    assert matching.nearest_by_pivots(q, t.limit(0))[0].count() == 0


def test_sql_surface(spark):
    sql.register(spark)
    with pytest.raises(Exception, match="binary"):
        spark.sql("SELECT * FROM paper_blocks('text', 'a:b')").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT b.* FROM (SELECT CAST('x' AS BINARY) AS c, 'a:b' AS p) f, LATERAL paper_blocks(f.c, f.p) b").collect()
    got = spark.sql("SELECT first_author(NULL, '2012ApJ...1..2D', 'On loops by Y. Song, a') AS a, clean_caption('Figure 3. A  loop') AS c, figure_label('no caption') AS l").first()
    assert got["a"]["last"] == "Song" and got["c"] == "A loop" and got["l"] is None
    plan = spark.sql("SELECT first_author(authors, NULL, NULL) FROM VALUES ('Song, Y.') t(authors)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan  # expanded in place
    broken = spark.sql("SELECT b.* FROM (SELECT X'FF' AS c) f, LATERAL paper_blocks(f.c, 'plumbline.sources.providers:TextPaper') b")
    assert broken.count() == 0


def test_document_text_stops_early(spark):
    rows = [(1, p, b, 0, f"{p}{b}" * 5) for p in (1, 2, 3) for b in (0, 1)] + [(2, 1, 0, 0, "x" * 50)]
    d = spark.createDataFrame(rows, "paper_id long, page int, block_no int, type int, text string")
    got = {r["paper_id"]: (r["text"], r["pages"]) for r in captions.document_text(d, 30).collect()}
    assert got == {1: (("10" * 5 + "\n" + "11" * 5 + "20" * 5)[:30], 2), 2: ("x" * 30, 1)}
