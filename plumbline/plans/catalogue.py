"""The query catalogue over the test tables, and the same queries as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..functions import sql, text as X
from ..operators import archive, captions, figures, matching, metadata, papers
from .. import stages
from ..sources import models, shared
from ..streaming import incremental
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


P = f"({A.duck(A.PAPERS)})"
B = f"({A.duck(A.BLOCKS, lines=A.LINES_DUCK)})"
R = f"({A.duck(A.REFS)})"
PX = f"({A.duck(A.PIXELS, grid=A.PIXELS_DUCK)})"
ANS = f"({A.duck(A.ANSWERS)})"
OBS = f"({A.duck(A.OBSERVATIONS)})"
RANGE = "1995-03-00", "1996-02-00"
MONTH = "(CAST(substr(publication_date, 1, 4) AS INT) * 100 + CASE WHEN substr(publication_date, 6, 2) = '00' THEN 1 ELSE CAST(substr(publication_date, 6, 2) AS INT) END)"
DATE = "CASE WHEN substr(publication_date, 6, 2) = '00' THEN substr(publication_date, 1, 4) WHEN substr(publication_date, 9, 2) = '00' THEN substr(publication_date, 1, 7) ELSE publication_date END"


@query(f"""
SELECT id, CASE WHEN length(title) > 80 THEN concat(substr(title, 1, 77), '...') ELSE title END AS title,
  coalesce(nullif(authors, ''), '(see paper)') AS authors, publication_date, coalesce(doi, '') AS doi, coalesce(bibcode, '') AS bibcode,
  coalesce(CAST(nullif(citation_count, 0) AS VARCHAR), '') AS citation_count, coalesce(ads_url, '') AS ads_url
FROM {P} WHERE {MONTH} BETWEEN 199503 AND 199602""")
def q01_list_papers(spark, sf_dir):
    return papers.list_papers(A.papers(spark, sf_dir), *RANGE)


@query(f"SELECT {DATE} AS month, count(*) AS papers FROM {P} GROUP BY 1")
def q02_papers_per_month(spark, sf_dir):
    return papers.per_month(A.papers(spark, sf_dir))


@query(f"""
SELECT id, publication_date, concat('## ', title, chr(10), chr(10), '- **ID:** ', id, chr(10), '- **Authors:** ', coalesce(nullif(authors, ''), '(see paper)'), chr(10),
  '- **Date:** ', publication_date, chr(10), CASE WHEN doi IS NULL THEN '' ELSE concat('- **DOI:** [', doi, '](https://doi.org/', doi, ')', chr(10)) END,
  CASE WHEN bibcode IS NULL THEN '' ELSE concat('- **Bibcode:** `', bibcode, '`', chr(10)) END,
  CASE WHEN citation_count IS NULL THEN '' ELSE concat('- **Citations:** ', citation_count, chr(10)) END,
  CASE WHEN ads_url = '' THEN '' ELSE concat('- **ADS:** [', ads_url, '](', ads_url, ')', chr(10)) END,
  CASE WHEN abstract IS NULL THEN '' ELSE concat(chr(10), '> ', trim(abstract), chr(10)) END, chr(10), '---', chr(10), chr(10)) AS entry
FROM {P} WHERE {MONTH} BETWEEN 199503 AND 199602""")
def q03_markdown_entries(spark, sf_dir):
    return papers.markdown(A.papers(spark, sf_dir), *RANGE)


@query(f"SELECT id, publication_date, {DATE} AS formatted FROM {P}")
def q04_format_publication_date(spark, sf_dir):
    return A.papers(spark, sf_dir).select("id", "publication_date", X.format_publication_date(F.col("publication_date")).alias("formatted"))


FIELD = r"""CASE WHEN regexp_matches(authors, '^[A-Z][a-zA-Z''\-]+,\s+[A-Z]') THEN concat(regexp_extract(authors, '^([A-Z][a-zA-Z''\-]+),\s+([A-Z])', 1), '|', regexp_extract(authors, '^([A-Z][a-zA-Z''\-]+),\s+([A-Z])', 2))
  WHEN regexp_matches(authors, '^[A-Z][.\s]+([A-Z][.\s]+)*[A-Z][a-z]{2,}') THEN concat(regexp_extract(authors, '^([A-Z])[.\s]+(?:[A-Z][.\s]+)*([A-Z][a-z]{2,})', 2), '|', substr(authors, 1, 1)) END"""
BIB = r"concat('Unknown|', CASE WHEN regexp_matches(right(trim(bibcode), 1), '^\p{Lu}$') THEN right(trim(bibcode), 1) ELSE 'X' END)"


@query(f"SELECT id, split_part({FIELD}, '|', 1) AS last_name, split_part({FIELD}, '|', 2) AS initial FROM {P}")
def q05_author_from_field(spark, sf_dir):
    return A.papers(spark, sf_dir).withColumn("a", X.author_of_field(F.col("authors"))).select("id", F.col("a.last").alias("last_name"), F.col("a.initial").alias("initial"))


PAGE1 = "CASE doc_id % 3 WHEN 0 THEN concat('on loops. Y. L. Song1,2 and others. ', text) WHEN 1 THEN concat('letter. Labrosse, N. writes ', text) ELSE text END"


@query(rf"""
WITH t AS (SELECT doc_id, substr({PAGE1}, 1, 3000) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '{{b}}[A-Z]\.(?:\s*[A-Z]\.)?\s+[A-Z][a-z]{{2,}}\s*[\d,\s]') THEN regexp_extract(t, '{{b}}([A-Z])\.(?:\s*[A-Z]\.)?\s+([A-Z][a-z]{{2,}})\s*[\d,\s]', 2)
  WHEN regexp_matches(t, '{{b}}[A-Z][a-z]{{2,}},\s+[A-Z]\.') THEN regexp_extract(t, '{{b}}([A-Z][a-z]{{2,}}),\s+([A-Z])\.', 1)
  WHEN regexp_matches(t, '{{b}}[A-Z][a-z]+\s+[A-Z][a-z]{{2,}}{{e}}') THEN regexp_extract(t, '{{b}}([A-Z][a-z]+)\s+([A-Z][a-z]{{2,}}){{e}}', 2) END AS last_name
FROM t""".replace("{b}", r"(?:^|[^\p{L}\p{N}_])").replace("{e}", r"(?:$|[^\p{L}\p{N}_])").replace("{2,}", "{2,}"))
def q06_author_from_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PAGE1).alias("t"))
    return d.select("doc_id", X.author_of_text(F.col("t"))["last"].alias("last_name"))


#: The text of a paper's first page: some name an author, some don't, some can't be read.
FIRST_PAGE = "CASE id % 4 WHEN 0 THEN concat('on loops. Y. L. Moss1,2 and others, ', title) WHEN 1 THEN '1 2 3' WHEN 2 THEN NULL ELSE 'letter. Ray, K. writes' END"
OF_TEXT = "CASE id % 4 WHEN 0 THEN 'Moss|Y' WHEN 3 THEN 'Ray|K' END"


@query(rf"""
SELECT id, trim(regexp_replace(regexp_replace(concat({DATE}, ' - ', split_part(a, '|', 1), ', ', split_part(a, '|', 2)), '[/\\:*?"<>|]', '_', 'g'), ' {{2,}}', ' ', 'g')) AS folder
FROM (SELECT *, coalesce({FIELD}, {OF_TEXT}, {BIB}) AS a FROM {P})""".replace("{{2,}}", "{2,}"))
def q07_folder_name(spark, sf_dir):
    p = A.papers(spark, sf_dir).withColumn("a", X.first_author(F.col("authors"), F.col("bibcode"), F.expr(FIRST_PAGE)))
    return p.select("id", X.folder_name(F.col("publication_date"), F.col("a.last"), F.col("a.initial")).alias("folder"))


D = f"(SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, seq) - 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, xref ORDER BY page, seq) AS k FROM {R}) WHERE k = 1)"


def _deduped(spark, sf_dir):
    return figures.dedup_images(A.image_refs(spark, sf_dir))


@query(f"SELECT paper_id, xref, page, index FROM {D}")
def q08_dedup_images(spark, sf_dir):
    return _deduped(spark, sf_dir).select("paper_id", "xref", "page", "index")


@query(f"""SELECT paper_id, index, CASE WHEN width < 200 OR height < 200 THEN 'too_small' ELSE 'ok' END AS verdict,
  CASE colour WHEN 1 THEN 'gray' WHEN 3 THEN 'rgb' WHEN 4 THEN 'cmyk' ELSE concat('cs', colour) END AS color_space FROM {D}""")
def q09_prefilter(spark, sf_dir):
    return _deduped(spark, sf_dir).select("paper_id", "index", F.when(figures.too_small(), "too_small").otherwise("ok").alias("verdict"), X.colour_space(F.col("colour")).alias("color_space"))


S = f"""(SELECT *, NOT small AND raw >= 5 AS is_solar, CASE WHEN small THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw / 20.0::DOUBLE)) END AS score,
  CASE WHEN small THEN 'rejected' WHEN hue_sum > 0.05 THEN 'aia_false_color' WHEN mean_s < 15 OR raw >= 5 THEN 'hmi_grayscale' ELSE 'unknown' END AS image_type FROM (
  SELECT *, width < 200 OR height < 200 AS small, CASE WHEN width < 200 OR height < 200 THEN 0 ELSE
    (CASE WHEN border_white > 0.5 THEN -4 WHEN border_dark > 0.2 THEN 2 ELSE 0 END) + (CASE WHEN dark > 0.15 THEN 2 WHEN dark > 0.05 THEN 1 ELSE 0 END)
    + (CASE WHEN circle AND centred THEN 8 WHEN circle THEN 3 ELSE 0 END) + (CASE WHEN hue_sum > 0.15 THEN 8 WHEN hue_sum > 0.05 THEN 4 ELSE 0 END)
    + (CASE WHEN mean_s < 15 AND circle AND centred THEN 4 WHEN mean_s < 15 THEN 3 ELSE 0 END) + (CASE WHEN std > 40 AND NOT (circle AND centred) THEN 2 ELSE 0 END)
    + (CASE WHEN edge > 0.15 AND interior_white > 0.30 THEN -5 WHEN edge > 0.10 AND interior_white > 0.20 THEN -2 ELSE 0 END) END AS raw FROM {D}))"""


def _scored(spark, sf_dir):
    return figures.score(_deduped(spark, sf_dir))


PCT = "concat(CAST(CAST(round_even({}::DOUBLE * 100, 0) AS BIGINT) AS VARCHAR), '%')"
SIGNALS = f"""CASE WHEN small THEN 'too_small' ELSE concat_ws('|', CASE WHEN border_white > 0.5 THEN 'white_background' WHEN border_dark > 0.2 THEN 'dark_background' END,
  CASE WHEN dark > 0.15 THEN 'dark_region_' || {PCT.format('dark')} WHEN dark > 0.05 THEN 'moderate_dark_region' END,
  CASE WHEN circle AND centred THEN 'full_disk_circle_r' || CAST(CAST(floor(radius) AS INT) AS VARCHAR) WHEN circle THEN 'off_center_circle' END,
  CASE WHEN hue_sum > 0.15 THEN 'aia_false_color_' || {PCT.format('hue_sum')} WHEN hue_sum > 0.05 THEN 'aia_weak_color_' || {PCT.format('hue_sum')} END,
  CASE WHEN mean_s < 15 AND circle AND centred THEN 'hmi_grayscale_sat' || printf('%.1f', mean_s) WHEN mean_s < 15 THEN 'hmi_region_sat' || printf('%.1f', mean_s) END,
  CASE WHEN std > 40 AND NOT (circle AND centred) THEN 'high_texture_std' || CAST(CAST(round_even(std, 0) AS BIGINT) AS VARCHAR) END,
  CASE WHEN edge > 0.15 AND interior_white > 0.30 THEN 'scientific_plot_edges' || printf('%.2f', edge::DOUBLE) || '_white' || {PCT.format('interior_white')} WHEN edge > 0.10 AND interior_white > 0.20 THEN 'possible_diagram' END) END"""


@query(f"SELECT paper_id, index, raw, is_solar, score, image_type, {SIGNALS} AS signals FROM {S}")
def q10_score_rules(spark, sf_dir):
    return _scored(spark, sf_dir).select("paper_id", "index", "raw", "is_solar", "score", "image_type", F.array_join("signals", "|").alias("signals"))


@query(f"""WITH p AS (SELECT *, x < 5 OR y < 5 OR x >= 19 OR y >= 11 AS border, x BETWEEN 3 AND 20 AND y BETWEEN 2 AND 13 AS inner_ FROM {PX})
SELECT image_id, round(count(*) FILTER (border AND v > 240) / count(*) FILTER (border), 9) AS border_white, round(count(*) FILTER (border AND v < 25) / count(*) FILTER (border), 9) AS border_dark,
  round(count(*) FILTER (v < 20) / count(*), 9) AS dark, round((count(*) FILTER (s > 80 AND h BETWEEN 5 AND 30) + count(*) FILTER (s > 80 AND h BETWEEN 42 AND 65) + count(*) FILTER (s > 80 AND (h <= 5 OR h >= 170))) / count(*), 9) AS hue_sum,
  round(avg(s), 6) AS mean_s, round(stddev_pop(v), 6) AS std, round(count(*) FILTER (inner_ AND v > 240) / count(*) FILTER (inner_), 9) AS interior_white FROM p GROUP BY image_id""")
def q11_pixel_features(spark, sf_dir):
    f = figures.pixel_features(A.pixels(spark, sf_dir))
    return f.select("image_id", *[F.round(c, 6 if c in ("mean_s", "std") else 9).alias(c) for c in f.columns[1:]])


@query(f"SELECT paper_id, count(*) AS images, count(*) FILTER (is_solar) AS solar, count(*) FILTER (is_solar AND score >= 0.4) AS saved, max(round(score, 3)) AS best FROM {S} GROUP BY paper_id")
def q12_extraction_summary(spark, sf_dir):
    return figures.extraction_summary(_scored(spark, sf_dir), 0.4)


@query(f"""SELECT s.paper_id, s.index, s.name AS solar_name, k.name AS kept_name FROM
  (SELECT *, printf('solar_%03d_p%d_%s', row_number() OVER (PARTITION BY paper_id ORDER BY index), page, image_type) AS name FROM {S} WHERE is_solar) s LEFT JOIN
  (SELECT *, printf('solar_%03d_p%d_%s', row_number() OVER (PARTITION BY paper_id ORDER BY index), page, image_type) AS name FROM {S} WHERE is_solar AND score >= 0.4) k USING (paper_id, index)""")
def q13_solar_rank_names(spark, sf_dir):
    s = _scored(spark, sf_dir)
    k = figures.kept_names(s, 0.4).select("paper_id", "index", F.col("name").alias("kept_name"))
    return figures.solar_names(s).select("paper_id", "index", F.col("name").alias("solar_name")).join(k, ["paper_id", "index"], "left")


START = r"(?i)^(?:Figure|Fig\.)\s*\d+[a-z]?[.:\s]"
SQUEEZE = r"trim(regexp_replace({}, '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
CAP = f"""(SELECT paper_id, page, grp, min(block_no) AS block_no, coalesce(nullif(regexp_extract(arg_min(text, block_no), '(?i)((?:Figure|Fig\\.)\\s*\\d+[a-z]?)', 1), ''), 'Figure ?') AS figure_label,
  {SQUEEZE.format("string_agg(text, ' ' ORDER BY block_no)")} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM (SELECT *, sum(CASE WHEN regexp_matches(text, '{START}') THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS grp FROM {B}) WHERE grp > 0 GROUP BY paper_id, page, grp)"""


def _captions(spark, sf_dir):
    return captions.captions(A.blocks(spark, sf_dir))


@query(f"SELECT paper_id, page, CAST(grp AS BIGINT) AS grp, figure_label, text, x0, y0, x1, y1 FROM {CAP}")
def q14_captions(spark, sf_dir):
    return _captions(spark, sf_dir).select("paper_id", "page", "grp", "figure_label", "text", "x0", "y0", "x1", "y1")


REFSQL = f"""(SELECT paper_id, figure_key, paragraph, min(page * 1000000 + block_no) AS pos FROM (SELECT paper_id, page, block_no, paragraph, unnest(regexp_extract_all(paragraph, '(?i)\\b(?:Figs?\\.?\\s*|Figures?\\s+)(\\d+[a-zA-Z]?)', 1)) AS figure_key
  FROM (SELECT *, {SQUEEZE.format("text")} AS paragraph FROM {B} WHERE NOT regexp_matches(text, '{START}'))) GROUP BY ALL)"""
LISTS = f"(SELECT paper_id, figure_key, string_agg(paragraph, '¶' ORDER BY pos) AS paragraphs FROM {REFSQL} GROUP BY ALL)"


@query(f"SELECT * FROM {LISTS}")
def q15_body_refs(spark, sf_dir):
    return captions.body_lists(A.blocks(spark, sf_dir)).withColumn("paragraphs", F.array_join("paragraphs", "¶"))


@query(f"SELECT c.paper_id, page, CAST(grp AS BIGINT) AS grp, figure_label, coalesce(paragraphs, '') AS paragraphs FROM {CAP} c LEFT JOIN {LISTS} l ON c.paper_id = l.paper_id AND figure_key = regexp_extract(figure_label, '(\\d+[a-zA-Z]?)$', 1)")
def q16_figure_contexts(spark, sf_dir):
    b = A.blocks(spark, sf_dir)
    return captions.figure_contexts(captions.captions(b), captions.body_lists(b)).select("paper_id", "page", "grp", "figure_label", F.array_join("paragraphs", "¶").alias("paragraphs"))


BOX = f"(SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page, seq) - 1 AS ordinal, y0, y1 FROM {D} WHERE x1 > x0 AND y1 > y0)"
MATCHED = f"(SELECT s.* EXCLUDE (y0, y1), b.y0, b.y1 FROM {S} s LEFT JOIN {BOX} b ON s.paper_id = b.paper_id AND s.index = b.ordinal)"


def _boxed(spark, sf_dir):
    return figures.own_rectangles(_scored(spark, sf_dir))


@query(f"SELECT paper_id, index, page, y0, y1 FROM {MATCHED}")
def q17_positional_bbox(spark, sf_dir):
    return _boxed(spark, sf_dir).select("paper_id", "index", "page", "y0", "y1")


NEAR = f"""(SELECT i.*, coalesce(m.figure_label, '') AS figure_label, coalesce(m.text, '') AS caption_text, CASE WHEN m.tier IS NULL THEN 'none' WHEN m.tier = 0 THEN 'same_page' ELSE 'adjacent_page' END AS match FROM {MATCHED} i LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, index ORDER BY tier, gap, c0, block_no) AS k FROM (
    SELECT i.paper_id, i.index, c.figure_label, c.text, c.y0 AS c0, c.block_no, CASE c.page - i.page WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier,
      CASE WHEN c.page = i.page THEN least(abs(c.y0 - i.y1), abs(c.y1 - i.y0)) ELSE 0 END AS gap
    FROM {MATCHED} i JOIN {CAP} c ON i.paper_id = c.paper_id AND c.page BETWEEN i.page - 1 AND i.page + 1 WHERE i.y0 IS NOT NULL)) WHERE k = 1) m ON i.paper_id = m.paper_id AND i.index = m.index)"""


def _near(spark, sf_dir):
    return captions.nearest_caption(_boxed(spark, sf_dir), _captions(spark, sf_dir))


@query(f"SELECT paper_id, index, page, figure_label, caption_text, match FROM {NEAR}")
def q18_nearest_caption(spark, sf_dir):
    return _near(spark, sf_dir).select("paper_id", "index", "page", "figure_label", "caption_text", "match")


@query(f"""SELECT concat('paper ', paper_id, '.pdf') AS paper_filename, concat('papers/paper ', paper_id, '.pdf') AS paper_path,
  CASE WHEN index % 3 > 0 THEN concat('images/paper ', paper_id, '/', printf('solar_%03d_p%d_%s', row_number() OVER (PARTITION BY paper_id ORDER BY index), page, image_type), '.png') ELSE '' END AS image_path,
  figure_label, caption_text, CASE WHEN caption_text = '' THEN 'Other' ELSE 'Flare' END AS structure_label, CASE WHEN caption_text = '' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS structure_confidence,
  match AS caption_match_confidence, image_type, score AS classifier_score FROM {NEAR} WHERE is_solar""")
def q19_label_rows(spark, sf_dir):
    i = figures.solar_names(_near(spark, sf_dir)).withColumn("folder", F.concat(F.lit("paper "), F.col("paper_id").cast("string"))).withColumn("has_file", F.col("index") % 3 > 0)
    label, score = metadata.structure(F.col("caption_text"), F.lit("Flare"), F.lit(0.5))
    return figures.label_rows(i.withColumn("structure_label", label).withColumn("structure_confidence", score))


LABEL_OFF = r"regexp_replace(t, '(?i)^Figure\s+\d+[a-z]?[.:\s]+', '')"
CLEAN = f"substr({SQUEEZE.format(LABEL_OFF)}, 1, 512)"
CAPTION_OF = "concat(CASE doc_id % 4 WHEN 0 THEN 'Figure 2a. ' WHEN 1 THEN 'Fig. 3. ' WHEN 2 THEN 'FIGURE 4: ' ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END)"


@query(f"""SELECT doc_id, cleaned, CASE WHEN cleaned = '' THEN 'Other' WHEN s >= 0.1 THEN 'Sunspot' ELSE 'Other' END AS label, CASE WHEN cleaned = '' THEN 0.0::DOUBLE ELSE s END AS score
FROM (SELECT doc_id, (doc_id % 100)::DOUBLE / 500.0::DOUBLE AS s, {CLEAN} AS cleaned FROM (SELECT doc_id, {CAPTION_OF} AS t FROM documents))""")
def q20_structure_threshold(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(CAPTION_OF).alias("t"), (F.col("doc_id") % 100 / 500.0).alias("s"))
    label, score = metadata.structure(F.col("t"), F.lit("Sunspot"), F.col("s"))
    return d.select("doc_id", X.clean_caption(F.col("t")).alias("cleaned"), label.alias("label"), score.alias("score"))


PARSED = f"(SELECT *, CASE WHEN json_valid(o) THEN o ELSE '{{}}' END AS j FROM (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS o FROM {ANS}))"


@query(f"SELECT event_id, json_extract_string(j, '$.instrument') AS instrument, json_extract_string(j, '$.wavelength_angstrom') AS wavelength, json_extract_string(j, '$.phenomenon') AS phenomenon, json_extract_string(j, '$.confidence') AS confidence FROM {PARSED}")
def q21_parse_llm_json(spark, sf_dir):
    p = metadata.parse_answers(A.answers(spark, sf_dir))
    f = lambda n: metadata.field(F.col("parsed"), n)
    return p.select("event_id", f("instrument").alias("instrument"), f("wavelength_angstrom").alias("wavelength"), f("phenomenon").alias("phenomenon"), f("confidence").alias("confidence"))


@query(f"""SELECT event_id, user_id AS paper_id, printf('solar_%03d', row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS observation_filename, CAST(event_id % 9 + 1 AS INT) AS figure,
  coalesce(nullif(json_extract_string(j, '$.phenomenon'), ''), 'Filament') AS phenomenon, coalesce(json_extract_string(j, '$.confidence'), '0.25') AS confidence,
  concat('Figure: Fig. ', event_id % 9 + 1, chr(10), 'Caption: ', CASE WHEN event_id % 2 = 0 THEN '(none)' ELSE 'A loop' END, chr(10), 'Text:', chr(10), CASE WHEN event_id % 3 = 0 THEN '(none)' ELSE '- first' || chr(10) || '- second' END) AS prompt
FROM {PARSED}""")
def q22_assemble_observations(spark, sf_dir):
    a = metadata.parse_answers(A.answers(spark, sf_dir))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    i = a.select("parsed", F.col("user_id").alias("paper_id"), F.col("event_id").alias("index"), F.format_string("solar_%03d", n).alias("name"), F.concat(F.lit("Fig. "), (F.col("event_id") % 9 + 1).cast("string")).alias("figure_label"), F.when(F.col("event_id") % 2 == 0, "").otherwise("A loop").alias("caption_text"), F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("first"), F.lit("second"))).alias("paragraphs"), F.lit("Filament").alias("structure_label"), F.lit(0.25).alias("structure_confidence"))
    o = metadata.observations(i)
    return o.select(F.col("index").alias("event_id"), "paper_id", "observation_filename", "figure", F.col("phenomenon").cast("string").alias("phenomenon"), F.col("confidence").cast("string").alias("confidence"), metadata.prompt(F.concat(F.lit("Fig. "), F.col("figure").cast("string")), F.col("caption"), F.col("paragraphs")).alias("prompt"))


@query(f"SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY event_id) - 1 AS INT) AS event_index, event_id FROM {OBS} WHERE user_id % 7 <> 0")
def q23_flatten_events(spark, sf_dir):
    o = A.observations(spark, sf_dir)
    docs = o.groupBy("paper").agg(F.array_sort(F.collect_list("event_id")).alias("observations"), F.when(F.min("user_id") % 7 != 0, "success").otherwise("failed").alias("status"))
    return archive.flatten(docs).select("paper", "event_index", F.col("observation").alias("event_id"))


SAFE = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_\-]', '_', 'g')"


@query(f"""SELECT event_id, concat({SAFE.format('paper')}, '__', printf('%03d', event_id), '__', {SAFE.format("coalesce(nullif(instrument, ''), 'unknown')")}, '__', coalesce(CAST(nullif(wavelength, 0) AS VARCHAR), 'na'), '__', {SAFE.format("strftime(ts, '%Y-%m-%dT%H:%M:%S')")}, '.fits') AS cache_key,
  concat({SAFE.format('paper')}, '__', printf('%03d', event_id), '.png') AS output FROM {OBS}""")
def q24_cache_keys(spark, sf_dir):
    o = A.observations(spark, sf_dir)
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("event_id", archive.cache_key(F.col("paper"), F.col("event_id"), F.col("instrument"), F.col("wavelength"), ts).alias("cache_key"), archive.output_name(F.col("paper"), F.col("event_id")).alias("output"))


FOUND = f"""(SELECT obs_id, arg_min(record_id, (a_ts, record_id)) AS record_id FROM (SELECT o.event_id AS obs_id, a.event_id AS record_id, a.ts AS a_ts FROM {OBS} o JOIN events a
  ON a.event_id <> o.event_id AND a.ts BETWEEN o.ts - INTERVAL 60 SECOND AND o.ts + INTERVAL 60 SECOND AND (coalesce(o.instrument, '') = '' OR o.instrument = a.event_type)) GROUP BY obs_id)"""


def _records(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_id"), "ts", F.col("event_type").alias("instrument"), (F.col("event_id") % 4 * 100).alias("wavelength"))


def _matched(spark, sf_dir):
    """Every observation, with all other events as its archive."""
    return archive.window_match(A.observations(spark, sf_dir).withColumnRenamed("event_id", "obs_id"), _records(spark, sf_dir), apart=True)


@query(f"SELECT o.event_id AS obs_id, o.instrument, coalesce(f.record_id, -1) AS record_id FROM {OBS} o LEFT JOIN {FOUND} f ON o.event_id = f.obs_id")
def q25_archive_window_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("obs_id", "instrument", F.coalesce("record_id", F.lit(-1)).alias("record_id"))


CHOSEN = "CASE WHEN confidence = 'high' AND tx IS NOT NULL THEN 'strategy_a' WHEN confidence = 'medium' AND coalesce(limb, '') <> '' THEN 'strategy_b' ELSE 'strategy_c' END"


def _strategy():
    return archive.strategy(F.col("confidence"), F.col("tx").isNotNull(), F.col("limb"))


@query(f"SELECT event_id, {CHOSEN} AS strategy FROM {OBS}")
def q26_strategy(spark, sf_dir):
    return A.observations(spark, sf_dir).select("event_id", _strategy().alias("strategy"))


LIMBS = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (a, b, c, d) in archive.LIMB_BOXES.items()) + ") l(pos, x0, x1, y0, y1)"
_side = lambda a, b, full: f"CASE WHEN strategy = 'strategy_a' AND ty IS NOT NULL THEN {a} WHEN strategy = 'strategy_b' AND pos IS NOT NULL THEN {b} ELSE {full}::DOUBLE END"


@query(f"""SELECT event_id, strategy, {_side("tx - coalesce(fov, 300) / 2", "x0", "-1200")} AS tx_min, {_side("ty - coalesce(fov, 300) / 2", "y0", "-1200")} AS ty_min, {_side("tx + coalesce(fov, 300) / 2", "x1", "1200")} AS tx_max, {_side("ty + coalesce(fov, 300) / 2", "y1", "1200")} AS ty_max
FROM (SELECT *, {CHOSEN} AS strategy FROM {OBS}) LEFT JOIN {LIMBS} ON limb = pos""")
def q27_crop_bounds(spark, sf_dir):
    o = A.observations(spark, sf_dir).withColumn("strategy", _strategy())
    fov = F.when(F.col("fov").isNotNull(), F.array("fov", "fov"))
    return o.withColumn("b", archive.bounds(F.col("strategy"), F.col("tx"), F.col("ty"), fov, F.col("limb"))).select("event_id", "strategy", "b.*")


STATUS = f"(SELECT o.event_id, CASE WHEN o.event_id % 35 = 0 THEN 'skipped' WHEN f.record_id IS NULL THEN 'failed' ELSE {CHOSEN} END AS status FROM {OBS} o LEFT JOIN {FOUND} f ON o.event_id = f.obs_id)"


@query(f"SELECT s.status, count(event_id) AS n FROM (VALUES ('strategy_a'), ('strategy_b'), ('strategy_c'), ('skipped'), ('failed')) s(status) LEFT JOIN {STATUS} t ON s.status = t.status GROUP BY s.status")
def q28_status_counts(spark, sf_dir):
    m = _matched(spark, sf_dir)
    return archive.status_counts(m.select(archive.status(F.col("obs_id") % 35 == 0, F.col("record_id"), _strategy()).alias("status")))


@query(f"SELECT image_id, CAST(sum(u8) AS BIGINT) AS total, min(u8) AS least, max(u8) AS most FROM (SELECT image_id, CAST(floor((abs(value) - lo) * 255.0::DOUBLE / (hi - lo)) AS INT) AS u8 FROM {PX} JOIN (SELECT image_id AS i, min(abs(value)) AS lo, max(abs(value)) AS hi FROM {PX} GROUP BY 1) ON image_id = i) GROUP BY image_id")
def q29_minmax_uint8(spark, sf_dir):
    return archive.to_uint8(A.pixels(spark, sf_dir)).groupBy("image_id").agg(F.sum("u8").alias("total"), F.min("u8").alias("least"), F.max("u8").alias("most"))


KNN = "(SELECT q_id, t_id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, t_id) AS k FROM (SELECT q.vec_id AS q_id, t.vec_id AS t_id, sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id))"


def _neighbours(spark, sf_dir):
    """The two nearest others of every vector whose id is divisible by 50, the stated query set."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"))
    return matching.nearest(q, e.select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("vec")), apart=True)


@query(f"SELECT a.q_id, a.t_id, round(a.d, 6) AS d1, round(b.d, 6) AS d2 FROM {KNN} a JOIN {KNN} b ON a.q_id = b.q_id AND a.k = 1 AND b.k = 2 WHERE a.d < 0.95 * b.d")
def q30_knn_ratio(spark, sf_dir):
    return matching.ratio_matches(_neighbours(spark, sf_dir), 0.95).select("q_id", "t_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("""SELECT event_id, round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 6) AS angle, a * 3 AS shift_x, b * 2 AS shift_y
FROM (SELECT event_id, (event_id % 97 + 1)::DOUBLE / 50 AS a, (event_id % 89 - 44)::DOUBLE / 50 AS b FROM events)""")
def q31_similarity_params(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((F.col("event_id") % 97 + 1).cast("double") / 50).alias("a"), ((F.col("event_id") % 89 - 44).cast("double") / 50).alias("b"))
    scale, angle, x, y = matching.similarity_params(F.col("a"), F.col("b"), F.col("a") * 3, F.col("b") * 2)
    return e.select("event_id", F.round(scale, 6).alias("scale"), F.round(angle, 6).alias("angle"), x, y)


@query("""SELECT event_id, greatest(0, least(list_min(xs), 4096)) AS x0, greatest(0, least(list_min(ys), 4096)) AS y0, greatest(0, least(list_max(xs), 4096)) AS x1, greatest(0, least(list_max(ys), 4096)) AS y1
FROM (SELECT event_id, [trunc(tx)::INT, trunc(a * 300 + tx)::INT, trunc(a * 300 - b * 200 + tx)::INT, trunc(-b * 200 + tx)::INT] AS xs, [trunc(ty)::INT, trunc(b * 300 + ty)::INT, trunc(b * 300 + a * 200 + ty)::INT, trunc(a * 200 + ty)::INT] AS ys
  FROM (SELECT event_id, (event_id % 97 + 1)::DOUBLE / 16 AS a, (event_id % 89 - 44)::DOUBLE / 16 AS b, (event_id % 5000)::DOUBLE - 500 AS tx, (event_id % 4500)::DOUBLE - 300 AS ty FROM events))""")
def q32_region_clamp(spark, sf_dir):
    e = F.col("event_id")
    i = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((e % 97 + 1).cast("double") / 16).alias("a"), ((e % 89 - 44).cast("double") / 16).alias("b"), ((e % 5000).cast("double") - 500).alias("tx"), ((e % 4500).cast("double") - 300).alias("ty"))
    return i.select("event_id", *matching.region(F.col("a"), F.col("b"), F.col("tx"), F.col("ty"), F.lit(300), F.lit(200), F.lit(4096), F.lit(4096)))


@query("""SELECT e.event_id, c.path AS cached FROM (SELECT event_id, concat('k', event_id % 500) AS cache_key FROM events WHERE event_id % 3 <> 0) e
LEFT JOIN (SELECT DISTINCT concat('k', o_orderkey % 250) AS cache_key, concat('/cache/k', o_orderkey % 250) AS path FROM orders) c USING (cache_key)""")
def q33_resume_antijoin(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 500).cast("string")).alias("cache_key"))
    done = e.where("event_id % 3 = 0")
    key = F.concat(F.lit("k"), (F.col("o_orderkey") % 250).cast("string"))
    cache = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("cache_key"), F.concat(F.lit("/cache/"), key).alias("path")).distinct()
    return archive.cached(archive.pending(e, done, "event_id"), cache).select("event_id", "cached")


@query("SELECT event_id, ts, event_type FROM events")
def q34_incremental_runner(spark, sf_dir):
    """All events through an incremental run whose folders are this run's own."""
    root = f"{shared.folder(spark)}/incremental-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return incremental.run_available(spark, f"{sf_dir}/events.parquet*", source.schema, lambda s: s.select("event_id", "ts", "event_type"), f"{root}/sink", f"{root}/checkpoint")


@query("""SELECT user_id AS pair_id, count(*) AS matches, CASE WHEN count(*) > 10 THEN count(*) FILTER (event_id % 4 <> 0 OR 2 * (event_id * 53 % 701) ** 2 <= 9) ELSE 0 END AS inliers,
  CASE WHEN count(*) > 10 THEN 0.8::DOUBLE END AS a, CASE WHEN count(*) > 10 THEN 0.3::DOUBLE END AS b,
  count(*) > 10 AND count(*) FILTER (event_id % 4 <> 0 OR 2 * (event_id * 53 % 701) ** 2 <= 9) > 15 AS accepted FROM events GROUP BY user_id""")
def q35_ransac_similarity(spark, sf_dir):
    """A planted transform (a = 0.8, b = 0.3) behind a quarter of strayed points."""
    e = F.col("event_id")
    x, y = (e * 37 % 1009).cast("double"), (e * 91 % 983).cast("double")
    noise = F.when(e % 4 == 0, (e * 53 % 701).cast("double")).otherwise(0.0)
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pair_id"), x.alias("qx"), y.alias("qy"), (0.8 * x - 0.3 * y + 12 + noise).alias("tx"), (0.3 * x + 0.8 * y - 7 - noise).alias("ty"))
    f = matching.fit_similarity(points, rounds=100)
    return f.select("pair_id", "matches", "inliers", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "accepted")


@query(f"SELECT paper_id, page, substr(string_agg(text, chr(10) ORDER BY block_no), 1, 8000) AS page_text FROM {B} GROUP BY paper_id, page")
def q36_page_text(spark, sf_dir):
    return captions.page_text(A.blocks(spark, sf_dir))


LOGGED = f"""(SELECT paper_id, count(*) AS n, count(*) FILTER (is_solar AND score >= 0.25) AS saved, string_agg(concat_ws(' ', index, page, concat(width, 'x', height), CASE colour WHEN 1 THEN 'gray' WHEN 3 THEN 'rgb' WHEN 4 THEN 'cmyk' ELSE concat('cs', colour) END,
  'png', is_solar, printf('%.3f', score), {SIGNALS}, image_type), chr(10) ORDER BY index) AS entries FROM {S} GROUP BY paper_id)"""


@query(f"""SELECT id AS paper_id, coalesce(title, '') AS title, publication_date, bibcode, doi, ads_url, concat(replace(coalesce({FIELD}, {BIB}), '|', ', ')) AS first_author,
  CAST(coalesce(n, 0) AS INT) AS total_images_found, CAST(coalesce(saved, 0) AS INT) AS solar_images_saved, 0.25::DOUBLE AS min_score_threshold, coalesce(entries, '') AS entries FROM {P} LEFT JOIN {LOGGED} ON id = paper_id""")
def q37_extraction_log(spark, sf_dir):
    p = A.papers(spark, sf_dir).withColumn("a", X.first_author(F.col("authors"), F.col("bibcode"), F.lit(None).cast("string"))).select("*", "a.*")
    i = _scored(spark, sf_dir).withColumns({"color_space": X.colour_space(F.col("colour")), "encoding": F.lit("png")})
    log = figures.extraction_log(i, p)
    line = lambda e: F.concat_ws(" ", e["index"], e["page"], e["size"], e["color_space"], e["encoding"], e["is_solar"], F.format_string("%.3f", e["score"]), F.array_join(e["signals"], "|"), e["image_type"])
    return log.withColumn("entries", F.array_join(F.transform("images", line), "\n")).drop("images")


# --- whole stages, on stand-ins that SQL can follow ---------------------------------------------------

FOLDER = rf"""trim(regexp_replace(regexp_replace(concat({DATE}, ' - ', replace(coalesce({FIELD}, {BIB}), '|', ', ')), '[/\\:*?"<>|]', '_', 'g'), ' {{2,}}', ' ', 'g'))"""
PAPER = f"(SELECT id, concat({FOLDER}, ' ', id) AS folder, replace(coalesce({FIELD}, {BIB}), '|', ', ') AS author FROM {P})"


def _papers(spark, sf_dir):
    """Papers in folders of their own: many of the test papers have one author and date."""
    return stages.folders(A.papers(spark, sf_dir)).withColumn("folder", F.concat_ws(" ", "folder", "id"))


def _halves(texts):
    """A stand-in classifier: texts of even length are flares, others a plage below the threshold."""
    return [("Flare", 0.5) if len(t) % 2 == 0 else ("Plage", 0.05) for t in texts]


class _Even:
    """A stand-in model: sure where the question's length is even, without an object where it is odd."""

    def __call__(self, chats, **options):
        return ['{"instrument": "AIA", "confidence": "high"}' if len(c[-1]["content"]) % 2 == 0 else "no idea" for c in chats]


HALVES = models.Model("halves", lambda: _halves)


@query(f"""SELECT k.paper_id, k.index, k.name, p.folder, k.index % 3 > 0 AS saved FROM
  (SELECT *, printf('solar_%03d_p%d_%s', row_number() OVER (PARTITION BY paper_id ORDER BY index), page, image_type) AS name FROM {S} WHERE is_solar AND score >= 0.4) k JOIN {PAPER} p ON p.id = k.paper_id""")
def q38_extract_stage(spark, sf_dir):
    p, sights = _papers(spark, sf_dir), A.image_refs(spark, sf_dir)
    names = stages.extract_figures(p, sights, min_score=0.4).kept.where("index % 3 > 0").join(p.select(F.col("id").alias("paper_id"), "folder"), "paper_id")
    x = stages.extract_figures(p, sights, min_score=0.4, files=names.select("folder", F.concat("name", F.lit(".png")).alias("name")))
    return x.kept.select("paper_id", "index", "name", "folder", "saved")


BLANK = f"(SELECT *, substr({SQUEEZE.format(LABEL_OFF)}, 1, 512) AS cleaned FROM (SELECT *, caption_text AS t FROM {NEAR}))"
STRUCTURED = f"""(SELECT *, printf('solar_%03d_p%d_%s', row_number() OVER (PARTITION BY paper_id ORDER BY index), page, image_type) AS name,
  CASE WHEN cleaned <> '' AND length(cleaned) % 2 = 0 THEN 'Flare' ELSE 'Other' END AS label, CASE WHEN cleaned = '' THEN 0.0::DOUBLE WHEN length(cleaned) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END AS sure FROM {BLANK} WHERE is_solar)"""


@query(f"""SELECT concat(folder, '.pdf') AS paper_filename, concat('papers/', folder, '.pdf') AS paper_path, concat('images/', folder, '/', name, '.png') AS image_path, figure_label, caption_text,
  label AS structure_label, sure AS structure_confidence, match AS caption_match_confidence, image_type, score AS classifier_score FROM {STRUCTURED} JOIN {PAPER} ON id = paper_id""")
def q39_label_stage(spark, sf_dir):
    return stages.label_figures(_scored(spark, sf_dir), A.blocks(spark, sf_dir), _papers(spark, sf_dir), HALVES)


ASKED = f"""(SELECT i.*, caption_text <> '' OR paragraphs IS NOT NULL AS asked, concat('Figure: ', CASE WHEN figure_label = '' THEN '(unknown)' ELSE figure_label END, chr(10), 'Caption: ', CASE WHEN caption_text = '' THEN '(none)' ELSE caption_text END, chr(10), 'Text:', chr(10),
  CASE WHEN paragraphs IS NULL THEN '(none)' ELSE '- ' || replace(paragraphs, '¶', chr(10) || '- ') END) AS prompt FROM {STRUCTURED} i LEFT JOIN {LISTS} l ON i.paper_id = l.paper_id AND figure_key = regexp_extract(figure_label, '(\\d+[a-zA-Z]?)$', 1))"""


@query(f"""SELECT id AS paper_id, author AS paper_authors, CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_observations, CASE WHEN id % 7 = 0 THEN 'skipped' WHEN n > 0 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(high, 0) END AS n_high, CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(flares, 0) END AS n_flares FROM {PAPER} LEFT JOIN
  (SELECT paper_id, count(*) AS n, count(*) FILTER (asked AND length(prompt) % 2 = 0) AS high, count(*) FILTER (label = 'Flare') AS flares FROM {ASKED} GROUP BY paper_id) ON id = paper_id""")
def q40_metadata_stage(spark, sf_dir):
    p = _papers(spark, sf_dir).select(F.col("id").alias("paper_id"), F.concat("last", F.lit(", "), "initial").alias("first_author"), F.lit(None).cast("string").alias("pdf_author"))
    d = stages.extract_metadata(_scored(spark, sf_dir), A.blocks(spark, sf_dir), p, HALVES, models.Model("even", _Even), p.where("paper_id % 7 = 0"))
    count = lambda x: F.coalesce(F.regexp_count("observations", F.lit(x)), F.lit(0))
    return d.select("paper_id", "paper_authors", "n_observations", "status", count('"confidence":"high"').alias("n_high"), count('"phenomenon":"Flare"').alias("n_flares"))


def _documents(spark, sf_dir):
    """Metadata documents of the test observations, one a paper."""
    o = A.observations(spark, sf_dir)
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    fov = F.when(F.col("fov").isNotNull(), F.array("fov", "fov"))
    one = F.struct("event_id", ts.alias("timestamp_start"), "instrument", F.nullif(F.col("wavelength").cast("string"), F.lit("0")).alias("wavelength_angstrom"), F.col("limb").alias("limb_position"), fov.alias("fov_arcsec"), F.col("tx").alias("center_tx_arcsec"), F.col("ty").alias("center_ty_arcsec"), "confidence")
    return o.groupBy("paper").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("observations")).withColumn("status", F.lit("success"))


def _archive(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_id"), "ts", F.col("event_type").alias("instrument"), (F.col("event_id") % 400).cast("int").alias("wavelength"))


PLACED = f"(SELECT *, row_number() OVER (PARTITION BY paper ORDER BY event_id) - 1 AS place FROM {OBS})"
HIT = f"""(SELECT paper, place, arg_min(record_id, (a_ts, record_id)) AS record_id FROM (SELECT o.paper, o.place, a.event_id AS record_id, a.ts AS a_ts FROM {PLACED} o JOIN events a
  ON a.ts BETWEEN date_trunc('second', o.ts) - INTERVAL 60 SECOND AND date_trunc('second', o.ts) + INTERVAL 60 SECOND AND (coalesce(o.instrument, '') = '' OR o.instrument = a.event_type)
  AND (coalesce(o.wavelength, 0) = 0 OR o.wavelength = a.event_id % 400)) GROUP BY ALL)"""


@query(f"""SELECT paper, event_index, status, CASE WHEN status = 'skipped' OR event_index % 9 = 4 THEN -1 ELSE coalesce(record_id, -1) END AS record_id, cache_key, tx_min, ty_max FROM (
  SELECT o.paper, CAST(o.place AS INT) AS event_index, record_id, CASE WHEN o.place % 35 = 0 THEN 'skipped' WHEN record_id IS NULL AND o.place % 9 <> 4 THEN 'failed' ELSE strategy END AS status,
    concat({SAFE.format('o.paper')}, '__', printf('%03d', o.place), '__', {SAFE.format("coalesce(nullif(instrument, ''), 'unknown')")}, '__', coalesce(CAST(nullif(wavelength, 0) AS VARCHAR), 'na'), '__', {SAFE.format("strftime(ts, '%Y-%m-%dT%H:%M:%S')")}, '.fits') AS cache_key,
    {_side("tx - coalesce(fov, 300) / 2", "x0", "-1200")} AS tx_min, {_side("ty + coalesce(fov, 300) / 2", "y1", "1200")} AS ty_max
  FROM (SELECT *, {CHOSEN} AS strategy FROM {PLACED}) o LEFT JOIN {LIMBS} ON limb = pos LEFT JOIN {HIT} h ON h.paper = o.paper AND h.place = o.place)""")
def q41_query_stage(spark, sf_dir):
    e = stages.events_of(_documents(spark, sf_dir))
    cache = e.where("event_index % 9 = 4").select("cache_key", F.concat(F.lit("/cache/"), "cache_key").alias("path"))
    m = stages.match_observations(e, _archive(spark, sf_dir), e.where("event_index % 35 = 0").select("output"), cache)
    return m.select("paper", F.col("event_index").cast("int").alias("event_index"), "status", F.coalesce("record_id", F.lit(-1)).alias("record_id"), "cache_key", "bounds.tx_min", "bounds.ty_max")


@query(f"""SELECT o.paper, CAST(o.place AS INT) AS event_index, CASE WHEN record_id IS NULL THEN 'failed' ELSE strategy END AS status, coalesce(record_id, -1) AS record_id
  FROM (SELECT *, {CHOSEN} AS strategy FROM {PLACED}) o LEFT JOIN {HIT} h ON h.paper = o.paper AND h.place = o.place""")
def q46_query_stage_by_batches(spark, sf_dir):
    """The query stage over documents that come as a stream of files, a stage run a batch."""
    root = f"{shared.folder(spark)}/batches-{uuid.uuid4().hex}"
    docs, records = _documents(spark, sf_dir), shared.written(_archive(spark, sf_dir), "records")
    docs.repartition(3, "paper").write.parquet(f"{root}/in")
    pick = lambda m: m.select("paper", F.col("event_index").cast("int").alias("event_index"), "status", F.coalesce("record_id", F.lit(-1)).alias("record_id"))
    work = lambda batch: pick(stages.match_observations(stages.events_of(batch), records))
    return incremental.run_batches(spark, f"{root}/in", docs.schema, work, f"{root}/out", f"{root}/checkpoint", files_per_batch=1)


# --- the library in SQL -------------------------------------------------------------------------------

SHOWN = f"(SELECT id, authors, bibcode, title, publication_date, replace(coalesce({FIELD}, {BIB}), '|', ', ') AS author FROM {P})"


@query(f"""SELECT s.id, split_part(author, ', ', 1) AS last_name, split_part(author, ', ', 2) AS initial, folder FROM {SHOWN} s JOIN (SELECT id, {FOLDER} AS folder FROM {P}) f ON s.id = f.id""")
def q43_first_authors_in_sql(spark, sf_dir):
    """First authors and folder names by the registered SQL functions."""
    sql.register(spark)
    return spark.sql(
        "SELECT id, a.last AS last_name, a.initial, paper_folder(publication_date, a.last, a.initial) AS folder FROM (SELECT id, publication_date, first_author(authors, bibcode, CAST(NULL AS STRING)) AS a FROM {papers})",
        papers=A.papers(spark, sf_dir),
    )


PAPER_TEXT = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('Fig. ', doc_id % 9 + 1, '. Loops seen', chr(10), chr(10)) ELSE '' END, replace(text, chr(10), concat(chr(10), chr(10))), CASE WHEN doc_id % 4 = 0 THEN concat(chr(12), 'as Figs. 7 and Fig. 2b show') ELSE '' END)"
EDGE = r"regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


@query(rf"""SELECT doc_id AS paper_id, CAST(page AS INT) AS page, CAST(block_no AS INT) AS block_no, nullif(regexp_extract(t, '(?i)((?:Figure|Fig\.)\s*\d+[a-z]?)', 1), '') AS label, regexp_matches(t, '{START}') AS starts,
  len(t) AS n_chars, len(regexp_extract_all(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:Figs?\.?\s*|Figures?\s+)(\d+[a-zA-Z]?)')) AS citations FROM (
  SELECT doc_id, page, block_no, {EDGE.format("b")} AS t FROM (SELECT doc_id, page, generate_subscripts(bs, 1) - 1 AS block_no, unnest(bs) AS b FROM (
    SELECT doc_id, generate_subscripts(ps, 1) AS page, string_split(unnest(ps), chr(10) || chr(10)) AS bs FROM (SELECT doc_id, string_split({PAPER_TEXT}, chr(12)) AS ps FROM documents))))""")
def q44_papers_scanned_in_sql(spark, sf_dir):
    """Papers' files scanned by the table function in a LATERAL join, their blocks read by SQL functions."""
    sql.register(spark)
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("paper_id"), F.expr(PAPER_TEXT).cast("binary").alias("content"))
    return spark.sql(
        """SELECT f.paper_id, b.page, b.block_no, figure_label(b.text) AS label, is_caption(b.text) AS starts, CAST(length(b.text) AS BIGINT) AS n_chars, CAST(size(figure_citations(b.text)) AS BIGINT) AS citations
        FROM {files} f, LATERAL paper_blocks(f.content, 'plumbline.sources.providers:PlainTextParser') b""",
        files=files,
    )


PAGES = f"(SELECT paper_id, page, substr(string_agg(text, chr(10) ORDER BY block_no), 1, 900) AS page_text FROM {B} GROUP BY paper_id, page)"


@query(f"""SELECT paper_id, substr(string_agg(page_text, '' ORDER BY page), 1, 900) AS text, count(*) AS pages FROM (
  SELECT *, coalesce(sum(length(page_text)) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM {PAGES}) WHERE before_ < 900 GROUP BY paper_id""")
def q45_document_text(spark, sf_dir):
    """The beginning of each paper, over its pages."""
    return captions.document_text(A.blocks(spark, sf_dir), 900)


# --- two stages in a row: what the metadata stage writes is what the query stage reads --------------------


class _Placed:
    """A stand-in model whose answer follows from the question's length alone: by turns sure with a centre and a
    field of view, unsure with a limb, and neither; numbers as numbers, and every seventh as text."""

    def __call__(self, chats, **options):
        import json

        out = []
        for n in (len(c[-1]["content"]) for c in chats):
            said = {"timestamp_start": f"2024-01-{n % 28 + 1:02d}T{n % 24:02d}:{n % 60:02d}:00", "wavelength_angstrom": n % 4 * 100 or None}
            if n % 3 == 0:
                tx = n % 1000 - 500
                said |= {"confidence": "high", "center_tx_arcsec": str(tx) if n % 7 == 0 else tx, "center_ty_arcsec": n % 700 - 350.5}
                said |= {"fov_arcsec": [400, 200 + n % 50]} if n % 2 else {}
            elif n % 3 == 1:
                said |= {"confidence": "medium", "limb_position": ["NW", "SE", "disk"][n % 5 % 3]}
            out.append("```json\n" + json.dumps(said) + "\n```")
        return out


ANSWERED = f"""(SELECT a.*, folder, row_number() OVER (PARTITION BY a.paper_id ORDER BY index) - 1 AS place, length(prompt) AS n FROM {ASKED} a JOIN {PAPER} p ON p.id = a.paper_id)"""
PLACES = f"""(SELECT *, CASE WHEN asked AND n % 3 = 0 THEN 'strategy_a' WHEN asked AND n % 3 = 1 THEN 'strategy_b' ELSE 'strategy_c' END AS strategy,
  CASE WHEN asked THEN make_timestamp(2024, 1, n % 28 + 1, n % 24, n % 60, 0) END AS at_, CASE WHEN asked THEN nullif(n % 4 * 100, 0) END AS wave,
  CAST(n % 1000 - 500 AS DOUBLE) AS tx, CAST(n % 700 AS DOUBLE) - 350.5 AS ty, CASE WHEN n % 2 = 1 THEN 400.0::DOUBLE ELSE 300.0::DOUBLE END AS w, CASE WHEN n % 2 = 1 THEN CAST(200 + n % 50 AS DOUBLE) ELSE 300.0::DOUBLE END AS h, n % 5 % 3 AS limb FROM {ANSWERED})"""
CORNER = "CASE WHEN strategy = 'strategy_a' THEN {a} WHEN strategy = 'strategy_b' AND limb = 0 THEN {nw} WHEN strategy = 'strategy_b' AND limb = 1 THEN {se} ELSE {full} END"


@query(f"""SELECT folder AS paper, CAST(o.place AS INT) AS event_index, strategy, CASE WHEN r IS NULL THEN 'failed' ELSE strategy END AS status, coalesce(r, -1) AS record_id, CAST(wave AS INT) AS wavelength,
  {CORNER.format(a="tx - w / 2", nw="-800.0", se="100.0", full="-1200.0")} AS tx_min, {CORNER.format(a="ty - h / 2", nw="200.0", se="-800.0", full="-1200.0")} AS ty_min,
  {CORNER.format(a="tx + w / 2", nw="-100.0", se="800.0", full="1200.0")} AS tx_max, {CORNER.format(a="ty + h / 2", nw="800.0", se="-200.0", full="1200.0")} AS ty_max
  FROM {PLACES} o LEFT JOIN (SELECT paper_id, place, arg_min(event_id, (ts, event_id)) AS r FROM {PLACES} JOIN events ON ts BETWEEN at_ - INTERVAL 60 SECOND AND at_ + INTERVAL 60 SECOND AND (wave IS NULL OR wave = event_id % 4 * 100) GROUP BY ALL) m
  ON o.paper_id = m.paper_id AND o.place = m.place""")
def q42_metadata_to_query(spark, sf_dir):
    """Every observation of the metadata stage's own documents, through the query stage."""
    papers_ = _papers(spark, sf_dir)
    p = papers_.select(F.col("id").alias("paper_id"), F.concat("last", F.lit(", "), "initial").alias("first_author"), F.lit(None).cast("string").alias("pdf_author"))
    d = stages.extract_metadata(_scored(spark, sf_dir), A.blocks(spark, sf_dir), p, HALVES, models.Model("placed", _Placed))
    d = d.join(papers_.select(F.col("id").alias("paper_id"), F.col("folder").alias("paper")), "paper_id").select("paper", "status", "observations")
    records = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_id"), "ts", F.col("event_type").alias("instrument"), (F.col("event_id") % 4 * 100).cast("int").alias("wavelength"))
    e = stages.events_of(d).drop("observation", "cache_key", "output")  # no files here that they would name
    m = stages.match_observations(e, records)
    return m.select("paper", F.col("event_index").cast("int").alias("event_index"), "strategy", "status", F.coalesce("record_id", F.lit(-1)).alias("record_id"), "wavelength", "bounds.*")
