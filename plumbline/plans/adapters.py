"""Domain tables derived from the test tables: SQL that reads the same in Spark and DuckDB, but for
how lines and ranges are unnested. Table names stand in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAPERS = """
SELECT o_orderkey AS id,
  concat('Study of ', c_name, ' seen in the ', c_mktsegment, ' channel',
    CASE WHEN o_orderkey % 3 = 0 THEN concat(' with an extended analysis of ', lower(c_mktsegment), ' emission lines') ELSE '' END) AS title,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN concat(last_name, ', ', initial, '. I.; Other, B.') ELSE concat(initial, '. I. ', last_name, ', B. Other') END AS authors,
  CASE WHEN o_orderkey % 12 = 0 THEN concat('', year(o_orderdate), '-00-00')
    ELSE concat('', year(o_orderdate), '-', lpad(concat('', month(o_orderdate)), 2, '0'), '-00') END AS publication_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('10.1000/j.', o_orderkey) END AS doi,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('', year(o_orderdate), 'J..', o_orderkey % 1000, '..', substr('ABcDEfG', CAST(o_orderkey % 7 + 1 AS INT), 1)) END AS bibcode,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey % 500 END AS citation_count,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('https://example.org/abs/', o_orderkey) END AS ads_url,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE concat(' Abstract of ', o_orderkey, '. ') END AS abstract
FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'Song' WHEN 1 THEN 'Tian' WHEN 2 THEN 'Labrosse' WHEN 3 THEN 'Doe' ELSE 'Okamoto' END AS last_name,
        CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'H' ELSE 'N' END AS initial
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey) t
"""
LINES_SPARK = "SELECT doc_id AS paper_id, pos, line FROM {documents} LATERAL VIEW posexplode(split(text, chr(10))) t AS pos, line"
LINES_DUCK = "SELECT doc_id AS paper_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents})"
BLOCKS = """
SELECT paper_id, CAST(floor(pos / 8.0) AS INT) + 1 AS page, CAST(pos AS INT) AS block_no, 0 AS type,
  CASE (paper_id * 7 + pos) % 4 WHEN 0 THEN concat('Fig. ', pos % 9 + 1, '. ', line) WHEN 1 THEN concat(line, ' (see Figs. ', pos % 9 + 1, ' and 3)') ELSE line END AS text,
  CAST(50 AS DOUBLE) AS x0, CAST(12.5 AS DOUBLE) * pos AS y0, CAST(400 AS DOUBLE) AS x1, CAST(12.5 AS DOUBLE) * pos + 10 AS y1
FROM ({lines}) t WHERE trim(line) <> ''
"""
REFS = """
SELECT paper_id, CAST(floor(seq / 2.0) AS INT) + 1 AS page, seq, CASE WHEN seq % 5 = 4 THEN seq - 1 ELSE seq END AS xref,
  CAST(0 AS DOUBLE) AS x0, CAST(100 AS DOUBLE) AS x1, CAST((l_partkey * 17) % 90 AS DOUBLE) AS y0,
  CASE WHEN l_partkey % 11 = 0 THEN CAST((l_partkey * 17) % 90 AS DOUBLE) ELSE CAST((l_partkey * 17) % 90 + 5 + (l_suppkey * 13) % 20 AS DOUBLE) END AS y1,
  CAST(100 + (l_partkey * 37) % 900 AS INT) AS width, CAST(100 + (l_suppkey * 53) % 700 AS INT) AS height,
  CAST(1 + l_suppkey % 5 AS INT) AS colour, l_quantity / 100 AS border_white, l_discount * 4 AS border_dark, l_tax * 2 AS dark,
  l_partkey % 3 = 0 AS circle, l_suppkey % 2 = 0 AS centred, (l_partkey % 40) / 200.0 AS hue_sum, CAST(l_suppkey % 30 AS DOUBLE) AS mean_s,
  CAST(l_partkey % 80 AS DOUBLE) AS std, (l_partkey % 25) / 100.0 AS edge, (l_suppkey % 45) / 100.0 AS interior_white, CAST(20 + l_partkey % 200 AS DOUBLE) + 0.5 AS radius
FROM (SELECT *, l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS seq FROM {lineitem}) t
"""
PIXELS_SPARK = "SELECT p_partkey AS image_id, x, y FROM {part} LATERAL VIEW explode(sequence(0, 23)) a AS x LATERAL VIEW explode(sequence(0, 15)) b AS y"
PIXELS_DUCK = "SELECT p_partkey AS image_id, CAST(a.x AS INT) AS x, CAST(b.y AS INT) AS y FROM {part}, range(24) a(x), range(16) b(y)"
PIXELS = """
SELECT image_id, x, y, CAST((image_id * 13 + x * 5 + y * 3) % 180 AS INT) AS h, CAST((image_id * 7 + x * 11 + y) % 256 AS INT) AS s,
  CAST((image_id * 31 + x * 17 + y * 7 + x * y) % 256 AS INT) AS v, CAST((image_id * 3 + x * 19 + y * 23) % 997 - 400 AS DOUBLE) AS value, 24 AS w, 16 AS hgt
FROM ({grid}) t
"""
ANSWERS = """
SELECT event_id, user_id, ts, event_type,
  CASE event_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Here it is: ', body)
    WHEN 3 THEN concat('[', body, ']') ELSE '{{"instrument": "AI' END AS raw
FROM (SELECT *, concat('{{"instrument": "', event_type, '", "wavelength_angstrom": ', event_id % 400, ', "phenomenon": ',
    CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 7 = 1 THEN '""' ELSE '"Flare"' END, ', "confidence": "',
    CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE '0.42' END, '"}}') AS body FROM {events}) t
"""
OBSERVATIONS = """
SELECT event_id, concat('2012-01 - ', CASE user_id % 3 WHEN 0 THEN 'Labrosse, N' WHEN 1 THEN 'Song, Y' ELSE 'Doe: J' END, ' ', user_id) AS paper, user_id, ts,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS instrument,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id % 400 END AS wavelength,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE '0.42' END AS confidence,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 1000 AS DOUBLE) - 500 END AS tx,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 700 AS DOUBLE) - 350 END AS ty,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE user_id % 10 WHEN 0 THEN 'NW' WHEN 1 THEN 'SW' WHEN 2 THEN 'NE' WHEN 3 THEN 'SE' WHEN 4 THEN 'N' WHEN 5 THEN 'S' WHEN 6 THEN 'E' WHEN 7 THEN 'W' WHEN 8 THEN 'disk' ELSE 'limbo' END END AS limb,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(100 + event_id % 300 AS DOUBLE) END AS fov
FROM {events}
"""


def duck(sql: str, **inner: str) -> str:
    """The adapter for DuckDB, where tables are views by their names."""
    names = {n: n for n in ("orders", "customer", "documents", "lineitem", "part", "events", "embeddings")}
    filled = {k: v.format(**names) for k, v in inner.items()}
    return sql.format(**names, **filled)


def frame(spark: SparkSession, sf_dir: str, sql: str, inner: str | None = None, dealt: dict[str, str] | None = None) -> DataFrame:
    """The adapter over the test tables in Spark. dealt: tables that are dealt by a column first."""
    text = sql if inner is None else sql.replace("{lines}", inner).replace("{grid}", inner)
    names = [n for n in ("orders", "customer", "documents", "lineitem", "part", "events", "embeddings") if "{" + n + "}" in text]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    tables |= {n: tables[n].repartition(c) for n, c in (dealt or {}).items()}
    return spark.sql(text.replace("{{", "{").replace("}}", "}") if not names else text, **tables)


def papers(spark, sf_dir):
    return frame(spark, sf_dir, PAPERS)


def blocks(spark, sf_dir):
    return frame(spark, sf_dir, BLOCKS, LINES_SPARK)


def image_refs(spark, sf_dir):
    # The window's own shuffle is by a column that is renamed below it; this one is known to stand by paper_id as well.
    return frame(spark, sf_dir, REFS, dealt={"lineitem": "l_orderkey"})


def pixels(spark, sf_dir):
    return frame(spark, sf_dir, PIXELS, PIXELS_SPARK)


def answers(spark, sf_dir):
    return frame(spark, sf_dir, ANSWERS)


def observations(spark, sf_dir):
    return frame(spark, sf_dir, OBSERVATIONS)
