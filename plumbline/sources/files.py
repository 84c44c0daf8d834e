"""File sources and sinks: logs, metadata documents, image files, exports of fixed form."""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import rasters, text as X
from . import named_files, shared

IMAGE = "index long, page int, size string, color_space string, encoding string, is_solar boolean, score double, signals array<string>, image_type string"
LOG_SCHEMA = f"paper_id long, title string, publication_date string, bibcode string, doi string, ads_url string, first_author string, total_images_found int, solar_images_saved int, min_score_threshold double, images array<struct<{', '.join(f.replace(
    ' ',
    ':',
    1,
) for f in IMAGE.split(', '))}>>"


def _path():
    """A row's file, as it is named: Spark gives it encoded as in URLs."""
    return F.try_url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def extraction_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row a paper directory with a log, in name order; unreadable logs are dropped."""
    schema = LOG_SCHEMA + ", _corrupt_record string"
    d = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/*/extraction_log.json")
    return d.where("_corrupt_record is null").drop("_corrupt_record").withColumn("folder", F.element_at(F.split(_path(), "/"), -2)).orderBy("folder")


def metadata_documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    d = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/*.json")
    return d.where("_corrupt_record is null").drop("_corrupt_record").withColumn("stem", X.stem(_path())).orderBy("stem")


def paper_files(spark: SparkSession, root: str) -> DataFrame:
    """The first paper file by name of each directory."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "paper_*.pdf").option("recursiveFileLookup", True).load(root).select("path", "length")
    return d.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.min(F.struct("path", "length")).alias("f")).select("folder", "f.path", "f.length")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (BGR bytes); one that can't be read stays, with a null origin's place."""
    return spark.read.format("image").option("dropInvalid", False).load(root).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def write_lines(lines: DataFrame, path: str, head: str = "") -> int:
    """Lines (line; as they stand, in the frame's order) as one file behind a head, written by the executors; returns
    how many there are. path is in a folder that all executors share.

    The order is written down first, with each line's place in its partition. Sums of lengths, within partitions and
    then over them, say where in the file each line begins, so any task writes any lines where they belong, and one
    that runs again writes the same bytes. The driver sees one number a partition.
    """
    d = lines.select("line", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    d = shared.written(d, "lines")
    begin = len(head.encode())
    within = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sizes = d.groupBy("part").agg(F.sum(F.octet_length("line").cast("long")).alias("size"), F.count("*").alias("n"))
    base = sizes.withColumn("base", begin + F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with open(own, "wb") as f:
        f.write(head.encode())
        f.truncate(begin + total[0])

    def run(batches):
        with open(own, "r+b") as f:
            for b in batches:
                for start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if f.tell() != start:
                        f.seek(start)
                    f.write(line.encode())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    placed = d.withColumn("_in", F.coalesce(F.sum(F.octet_length("line").cast("long")).over(within), F.lit(0))).join(F.broadcast(base.select("part", "base")), "part")
    placed.select((F.col("base") + F.col("_in")).alias("start"), "line").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    os.replace(own, path)
    return total[1]


def csv_line(columns: list[Column]) -> Column:
    """One line of CSV: nulls are empty, and a value that holds a comma, a quote or a line's end stands in quotes."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat(F.concat_ws(",", *[F.when(F.regexp_like(t, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]), F.lit("\r\n"))


def write_csv(df: DataFrame, path: str) -> int:
    """One CSV file with a byte order mark, in the frame's order, written by the executors; its folder is made."""
    names = df.sparkSession.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))])
    head = names.select(csv_line([names[c] for c in names.columns])).first()[0]
    return write_lines(df.select(csv_line([F.col(f"`{c}`") for c in df.columns]).alias("line")), path, "\ufeff" + head)


def write_markdown(entries: DataFrame, path: str, heading: str) -> int:
    n = entries.count()
    head = f"# {heading}\n\n**Total:** {n} papers\n\n---\n\n"
    return write_lines(entries.orderBy("publication_date", "id").select(F.col("entry").alias("line")), path, head)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The files under root, folders of folders included: folder (of the file, as it stands below root; empty for root
    itself), name, path, length. A root that isn't there has none. Spark lists folders in parallel, and no
    content is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], "folder string, name string, path string, length long")
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length")
    # A qualified path has one slash behind the scheme, or three: the place of the root's own name counts.
    below = F.expr(f"substr(path, instr(path, {_literal(base.split(':', 1)[-1])}) + {len(base.split(':', 1)[-1])})")
    d = d.withColumn("_below", below)
    return d.select(F.regexp_extract("_below", r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract("_below", r"([^/]*)$", 1).alias("name"), "path", "length")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_documents(docs: DataFrame, root: str, key: str, body: str) -> None:
    """<key>.json a row under root: all of them or none; other files stay."""
    named_files.write(docs.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), F.col(body).alias("content")), root)


def write_json_files(docs: DataFrame, root: str) -> None:
    """<folder>.json a row of (folder, json) under root: all of them or none; other files stay."""
    write_documents(docs, root, "folder", "json")


def write_logs(logs: DataFrame, root: str) -> None:
    """Logs (LOG_SCHEMA and folder) as <folder>/extraction_log.json, where extraction_logs() reads them."""
    body = F.to_json(F.struct(*[c for c in logs.columns if c != "folder"]), {"ignoreNullFields": "false"})
    named_files.write(logs.select(F.concat("folder", F.lit("/extraction_log.json")).alias("name"), body.alias("content")), root)


def encode_figures(figures: DataFrame) -> DataFrame:
    """Figures (folder, name, width, height, nChannels, data: rows of BGR, gray or CMYK bytes) as PNG files: folder,
    name, content, RGB or gray; content is null where data doesn't fit its size."""

    def run(batches):
        for b in batches:
            made = []
            for w, h, n, data in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                good = bool(data) and bool(w) and len(data) == w * h * n and n in (1, 3, 4)
                if good:
                    x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    x = x[..., 0] if n == 1 else x[..., ::-1] if n == 3 else rasters.cmyk_to_rgb(x)
                made.append(rasters.write_png(np.ascontiguousarray(x)) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["folder", "name", "content"])

    return figures.select("folder", "name", "width", "height", "nChannels", "data").mapInArrow(run, "folder string, name string, content binary")


def save_figures(figures: DataFrame, root: str) -> None:
    """encode_figures()' files as root/<folder>/<name>.png: all of them or none. What was saved is in listing()."""
    made = encode_figures(figures).where("content is not null")
    named_files.write(made.select(F.concat_ws("/", "folder", F.concat("name", F.lit(".png"))).alias("name"), "content"), root)


def copy_once(files: DataFrame, root: str) -> DataFrame:
    """Copies (path, name, length) rows whose file is absent or of another size under root, a folder
    all executors share: name, copied."""

    def run(batches):
        for b in batches:
            done = []
            for path, name, length in zip(*(b[c] for c in ("path", "name", "length"))):
                to = os.path.join(root, name)
                need = not (os.path.exists(to) and os.path.getsize(to) == length)
                if need:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    shutil.copyfile(path.removeprefix("file:"), f"{to}.{os.getpid()}.part")
                    os.replace(f"{to}.{os.getpid()}.part", to)
                done.append(need)
            yield b[["name"]].assign(copied=done)

    return files.select("path", "name", "length").mapInPandas(run, "name string, copied boolean")
