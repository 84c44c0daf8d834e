"""A Python data source over a paged papers service: format("papers_api").

Options: base_url, start_year, end_year, page_size, tasks_per_year, id, missing. The pages of a year are dealt to
tasks_per_year tasks, which take every so manyth page until one isn't full: the service doesn't say how many there are,
and a big year is still read by several tasks. With id, one request for one document; one that isn't there is an
error, or no row with missing=ignore.

Filters are Spark's work by default. With push=true (and spark.sql.python.filterPushdown.enabled set) id = n asks for
that document alone. What a reader pushes down stays with the relation in Spark: load a new frame for each such query.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
import uuid

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

SCHEMA = "id long, title string, authors string, publication_date string, doi string, bibcode string, citation_count long, ads_url string, abstract string"
FIELDS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def base_url(option: str | None = None) -> str:
    """The option, else PAPERS_API_URL, else the local default; no slash at the end."""
    return (option or os.environ.get("PAPERS_API_URL") or "http://localhost:8000").rstrip("/")


def _get(url: str, seconds: int):
    with urllib.request.urlopen(url, timeout=seconds) as r:
        return json.load(r)


def check_health(url: str) -> None:
    """Raises ConnectionError unless the service answers with a message within five seconds."""
    try:
        answer = _get(f"{url}/", 5)
    except (OSError, ValueError) as e:
        raise ConnectionError(f"papers service at {url}: {e}") from e
    if not isinstance(answer, dict) or "message" not in answer:
        raise ConnectionError(f"papers service at {url} gave an unknown answer")


def pages_of_year(url: str, year: int, page_size: int, first: int = 0, every: int = 1):
    """The documents of a year's pages first, first + every, ... up to a page that isn't full."""
    skip = first * page_size
    while True:
        page = _get(f"{url}/documents?{urllib.parse.urlencode({'year': year, 'skip': skip, 'limit': page_size})}", 30)
        yield from page
        if len(page) < page_size:
            return
        skip += every * page_size


def by_id(url: str, doc_id: int) -> dict:
    try:
        return _get(f"{url}/documents/{doc_id}", 15)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise ValueError(f"no document {doc_id}") from e
        raise


def download(url: str, doc_id: int, path: str, source: str | None = None, chunk: int = 8192) -> str:
    """Saves a document's file, in chunks, under a temporary name until it is whole."""
    query = f"?{urllib.parse.urlencode({'source': source})}" if source else ""
    try:
        own = f"{path}.{uuid.uuid4().hex}.part"
        with urllib.request.urlopen(f"{url}/documents/{doc_id}/pdf{query}", timeout=60) as r, open(own, "wb") as f:
            while part := r.read(chunk):
                f.write(part)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise RuntimeError(f"no file for document {doc_id}") from e
        raise
    os.replace(own, path)
    return path


def download_all(ids, url: str, root: str, source: str | None = None, tries: int = 3):
    """Documents (id) -> id, path, size: each document's file as root/paper_<id>.pdf, a folder that all
    executors share. A file that is there is not fetched again; one that fails `tries` times has a null path."""
    import pyarrow as pa

    def run(batches):
        os.makedirs(root, exist_ok=True)
        for b in batches:
            paths, sizes = [], []
            for doc_id in b.column(0).to_pylist():
                path = os.path.join(root, f"paper_{doc_id}.pdf")
                for _ in range(0 if os.path.exists(path) else tries):
                    try:
                        download(url, doc_id, path, source)
                        break
                    except (OSError, RuntimeError):
                        continue
                paths.append(path if os.path.exists(path) else None)
                sizes.append(os.path.getsize(path) if os.path.exists(path) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["id", "path", "size"])

    return ids.selectExpr("cast(id as long) AS id").mapInArrow(run, "id long, path string, size long")


class _Part(InputPartition):
    def __init__(self, year: int | None, stripe: int = 0, doc_id: int | None = None):
        self.year, self.stripe, self.doc_id = year, stripe, doc_id


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url = base_url(options.get("base_url"))
        self.years = range(int(options.get("start_year", 2010)), int(options.get("end_year", 2024)) + 1)
        self.size = int(options.get("page_size", 1000))
        self.stripes = max(1, int(options.get("tasks_per_year", 2)))
        self.doc_id = int(options["id"]) if options.get("id") else None
        self.missing = options.get("missing", "error")
        if options.get("check", "true") == "true":
            check_health(self.url)

    def partitions(self):
        if self.doc_id is not None:
            return [_Part(None, doc_id=self.doc_id)]
        return [_Part(y, s) for y in self.years for s in range(self.stripes)]

    def read(self, part):
        if part.doc_id is not None:
            try:
                rows = [by_id(self.url, part.doc_id)]
            except ValueError:
                if self.missing != "ignore":
                    raise
                rows = []
        else:
            rows = pages_of_year(self.url, part.year, self.size, part.stripe, self.stripes)
        for r in rows:
            yield tuple(r.get(c) for c in FIELDS)


class _PushedReader(_Reader):
    def pushFilters(self, filters):
        """Takes id = n where the id isn't an option; Spark applies the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",) and self.doc_id is None and f.value is not None:
                # No document is no row here: the filter asks whether there is one.
                self.doc_id, self.missing = int(f.value), "ignore"
            yield f


class PapersSource(DataSource):
    @classmethod
    def name(cls):
        return "papers_api"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (_PushedReader if self.options.get("push") == "true" else _Reader)(self.options)


def register(spark) -> None:
    spark.dataSource.register(PapersSource)
