"""python -m plumbline STAGE ...: the stages over tables on disk (Parquet folders or files of papers)."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import stages
from .functions import pixels, text as X
from .operators import archive, captions, papers as P
from .sources import files, papers_api, providers
from .sources.models import Model


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(dest="stage", required=True)
    s = sub.add_parser("list", help="papers of a range of months")
    s.add_argument("--start", required=True)
    s.add_argument("--end", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--format", choices=["csv", "md", "both"], default="both")
    s.add_argument("--api-url")
    s.add_argument("--papers", help="a Parquet table in place of the service")
    for name, text in (("extract", "figures of papers, scored, saved and logged"), ("label", "captions and structures of solar figures"), ("metadata", "observation metadata of solar figures")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--papers", required=True)
        s.add_argument("--files", help="a folder of paper files, paper_<id>.*, which the parser reads")
        s.add_argument("--parser", default="plumbline.sources.providers:TextPaper", help="module:class of the parser of paper files")
        s.add_argument("--images", help="a Parquet table of image sights with features, in place of the papers' files")
        s.add_argument("--output-dir", required=True)
        if name == "extract":
            s.add_argument("--min-score", type=float, default=0.25)
            s.add_argument("--save-all", action="store_true")
            s.add_argument("--keep-pdf", action="store_true", help="copy the papers' files beside the logs")
        else:
            s.add_argument("--blocks", help="a Parquet table of text blocks, in place of the papers' files")
            s.add_argument("--classifier", help="module:class of the caption classifier")
        if name == "label":
            s.add_argument("--figures-dir", help="where extract saved the figures; without it all count as there")
        if name == "metadata":
            s.add_argument("--model", default="plumbline.sources.providers:EchoModel", help="module:class of the language model")
            s.add_argument("--answers", help="a folder that keeps the model's answers, so that none is asked twice")
    s = sub.add_parser("query", help="observations against the archive")
    s.add_argument("--metadata-dir", required=True)
    s.add_argument("--records", required=True, help="a Parquet table: record_id, ts, instrument, wavelength")
    s.add_argument("--archive-dir", required=True, help="a folder of record-<id>.fits")
    s.add_argument("--fits-dir", required=True)
    s.add_argument("--output-dir", required=True)
    return p


def _input(spark: SparkSession, path: str | None) -> DataFrame:
    """A table that must be there; SystemExit names it else."""
    if path is None:
        raise SystemExit("ERROR: neither a table nor a folder of paper files is given")
    try:
        return spark.read.parquet(path)
    except Exception as e:
        raise SystemExit(f"ERROR: no table at {path}") from e


def _named(path: str):
    """The class or function that module:name stands for."""
    module, _, name = path.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise SystemExit(f"ERROR: no {path}") from e


def _model(path: str) -> Model:
    """A model made where it is used, under its own path; that it can be found is seen at once."""
    _named(path)
    return Model(path, lambda: _named(path)())


def _keywords():
    return providers.KeywordClassifier([s for s in stages.M.STRUCTURES if s != "Other"])


def _paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, path, length, content) of paper_<id>.*; content is read where it is used."""
    try:
        d = spark.read.format("binaryFile").option("pathGlobFilter", "paper_*").load(folder)
    except Exception as e:
        raise SystemExit(f"ERROR: no folder {folder}") from e
    return d.select(F.regexp_extract("path", r"paper_(\d+)\.[^./]*$", 1).try_cast("long").alias("paper_id"), "path", "length", "content").where("paper_id is not null")


def _sights(spark: SparkSession, a) -> DataFrame:
    """Image sights with features, from a table or from the papers' files."""
    if a.images or not a.files:
        return _input(spark, a.images).drop("data")
    sights = providers.scan_images(_paper_files(spark, a.files), _named(a.parser))
    key = F.concat_ws("/", "paper_id", "seq")
    seen = pixels.raster_features(sights.select(key.alias("origin"), "width", "height", F.col("colour").alias("nChannels"), "data")).drop("width", "height")
    return sights.withColumn("origin", key).drop("data").join(seen, "origin", "left").drop("origin")


def _list(spark: SparkSession, a) -> int:
    if a.papers:
        p = _input(spark, a.papers)
    else:
        papers_api.register(spark)
        p = spark.read.format("papers_api").option("base_url", papers_api.base_url(a.api_url)).option("start_year", a.start[:4]).option("end_year", a.end[:4]).load()
    base = f"{a.output}_{X.compact_date(a.start)}_{X.compact_date(a.end)}"
    n = 0
    if a.format in ("csv", "both"):
        n = files.write_csv(stages.list_papers(p, a.start, a.end).orderBy("publication_date", "id"), f"{base}.csv")
    if a.format in ("md", "both"):
        n = files.write_markdown(P.markdown(p, a.start, a.end), f"{base}.md", f"Papers {a.start} to {a.end}")
    print(f"{n} papers")
    return 0


def _extract(spark: SparkSession, a, p: DataFrame) -> int:
    """Saves what is kept, of papers that are given as files, then logs what is there."""
    sights = _sights(spark, a).persist()  # features are dear, and saving and logging both want them
    folders = p.select(F.col("id").alias("paper_id"), "folder")
    if a.files and not a.images:
        kept = stages.extract_figures(p, sights, min_score=a.min_score, save_all=a.save_all).kept
        data = providers.scan_images(_paper_files(spark, a.files), _named(a.parser)).select("paper_id", "seq", "data")
        rasters = kept.join(data, ["paper_id", "seq"]).join(folders, "paper_id")
        files.save_figures(rasters.select("folder", "name", "width", "height", F.col("colour").alias("nChannels"), "data"), a.output_dir)
    x = stages.extract_figures(p, sights, min_score=a.min_score, save_all=a.save_all, files=files.listing(spark, a.output_dir, "*.png"))
    files.write_logs(x.logs.join(folders, "paper_id"), a.output_dir)
    if a.files:
        papers = _paper_files(spark, a.files)
        for r in providers.failures(papers, _named(a.parser), ("blocks", "images")).groupBy("part").count().orderBy("part").collect():
            print(f"{r['count']} papers without {r['part']}")
        if a.keep_pdf:
            copies = papers.join(folders, "paper_id").select("path", "length", F.concat_ws("/", "folder", F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))
            print(f"{files.copy_once(copies, a.output_dir).where('copied').count()} files kept")
    n = files.extraction_logs(spark, a.output_dir).join(folders.select("paper_id"), "paper_id", "left_semi").agg(F.sum("total_images_found"), F.sum("solar_images_saved")).first()
    print(f"{n[1] or 0} of {n[0] or 0} images")
    sights.unpersist()
    return 0


def _label(spark: SparkSession, a, p: DataFrame, scored: DataFrame, blocks: DataFrame, classifier: Model) -> int:
    there = files.listing(spark, a.figures_dir, "*.png") if a.figures_dir else None
    labels = stages.label_figures(scored, blocks, p, classifier, there)
    n = files.write_csv(labels.orderBy("paper_filename", "image_path", "figure_label"), f"{a.output_dir.rstrip('/')}/labels.csv")
    c = captions.captions(blocks).agg(F.count("*"), F.count_distinct("paper_id", "page")).first()
    print(f"{n} labels; {c[0]} captions on {c[1]} pages")
    return 0


def _metadata(spark: SparkSession, a, p: DataFrame, scored: DataFrame, blocks: DataFrame, classifier: Model) -> int:
    """Papers whose document is in the output folder are skipped."""
    p = p.withColumnRenamed("id", "paper_id")
    there = files.listing(spark, a.output_dir, "*.json").where("folder = ''").select(F.regexp_replace("name", r"\.json$", "").alias("folder"))
    done = p.select("paper_id", "folder").join(there, "folder").select("paper_id")
    who = p.select("paper_id", F.concat("last", F.lit(", "), "initial").alias("first_author"), F.col("title").alias("paper_title"))
    if a.files:
        who = who.join(providers.paper_authors(_paper_files(spark, a.files), _named(a.parser)), "paper_id", "left")
    else:
        who = who.withColumn("pdf_author", F.lit(None).cast("string"))
    docs = stages.extract_metadata(scored, blocks, who, classifier, _model(a.model), done, a.answers).join(p.select("paper_id", "folder"), "paper_id")
    docs = docs.persist()  # else the count would ask the model again where no store keeps its answers
    try:
        r = stages.summary(docs).first()
        head = F.to_json(F.struct(F.concat("folder", F.lit(".pdf")).alias("paper"), "paper_authors", "paper_title", "status"), {"ignoreNullFields": "false"})
        body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"observations":'), "observations", F.lit("}"))
        files.write_json_files(docs.where("status <> 'skipped'").select("folder", body.alias("json")), a.output_dir)
    finally:
        docs.unpersist()
    print(f"{r['processed']} processed, {r['skipped']} skipped, {r['failed']} failed of {r['total']}")
    return 0


def _query(spark: SparkSession, a) -> int:
    if files.listing(spark, a.metadata_dir, "*.json").where("folder = ''").isEmpty():
        raise SystemExit(f"ERROR: no folder {a.metadata_dir} with metadata")
    docs = files.metadata_documents(spark, a.metadata_dir, "status string, observations string").withColumnRenamed("stem", "paper")
    events = stages.events_of(docs)
    if events.isEmpty():
        print("no observations")
        return 1
    done = files.listing(spark, a.output_dir, "*.png").select(F.col("name").alias("output"))
    cache = files.listing(spark, a.fits_dir, "*.fits").select(F.col("name").alias("cache_key"), "path")
    m = stages.match_observations(events, _input(spark, a.records), done, cache)
    root = a.archive_dir
    found = stages.fetch_and_render(m, lambda: providers.FolderArchive(root), a.fits_dir, a.output_dir)
    for r in archive.status_counts(found.select("status")).collect():
        print(f"{r['status']}: {r['n']}")
    return 0


def run(spark: SparkSession, argv: list[str]) -> int:
    """Runs one stage; 0 if it had input. Empty input gives a message and no output."""
    a = parser().parse_args(argv)
    if a.stage in ("list", "query"):
        return {"list": _list, "query": _query}[a.stage](spark, a)
    p = stages.apart(stages.folders(_input(spark, a.papers)))
    if p.isEmpty():
        print("no papers")
        return 1
    if a.stage == "extract":
        return _extract(spark, a, p)
    scored = stages.extract_figures(p, _sights(spark, a)).scored
    blocks = _input(spark, a.blocks) if a.blocks or not a.files else providers.parse_papers(_paper_files(spark, a.files), _named(a.parser))
    classifier = _model(a.classifier) if a.classifier else Model("keywords", _keywords)
    return {"label": _label, "metadata": _metadata}[a.stage](spark, a, p, scored, blocks, classifier)


def main() -> None:
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
