"""Golden examples and properties of the scalar expressions."""

import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import archive, metadata, papers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "d,out",
    [
        ("2018-06-00", "2018-06"),
        ("2010-00-00", "2010"),
        ("2015-04-23", "2015-04-23"),
        ("2012-07-00", "2012-07"),
        ("", ""),
        ("201", "201"),
        ("2012", "2012"),
        ("2012-7", "2012"),
        ("2012-07", "2012-07"),
    ],
)
def test_dates(spark, d, out):
    assert one(spark, X.format_publication_date(F.col("d")), d=d) == out


@pytest.mark.parametrize(
    "d,out",
    [("2012-07-00", True), ("2012-00-00", True), ("2011-12-00", False), ("2013-03-99", True), ("2013-04-00", False), ("2012-13-00", True), ("abcd", False), ("2012", True)],
)
def test_range(spark, d, out):
    assert one(spark, X.in_date_range(F.col("d"), "2012-01-02", "2013-03-01"), d=d) is out


@pytest.mark.parametrize("a,out", [("Song, Y. L.; Tian, H.", ("Song", "Y")), ("Y. L. Song, H. Tian", ("Song", "Y")), ("O'Neil-Smith, Q", ("O'Neil-Smith", "Q"))])
def test_authors(spark, a, out):
    assert tuple(one(spark, X.author_of_field(F.col("a")), a=a)) == out


def test_bibcode_and_folder(spark):
    assert tuple(one(spark, X.author_of_bibcode(F.col("b")), b="2018A&A...613A..69S")) == ("Unknown", "S")
    assert tuple(one(spark, X.author_of_bibcode(F.col("b")), b=" ")) == ("Unknown", "X")
    assert one(spark, X.folder_name(F.lit("2018-06-00"), F.lit("So:ng"), F.lit("Y"))) == "2018-06 - So_ng, Y"


def test_titles_and_captions(spark):
    assert len(one(spark, X.truncate_title(F.lit("x" * 81)))) == 80
    assert one(spark, X.truncate_title(F.lit("x" * 80))) == "x" * 80
    assert one(spark, X.clean_caption(F.lit("Figure 1. AIA 304 Å  image..."))) == "AIA 304 Å image..."
    assert one(spark, X.clean_caption(F.lit("Fig. 1. x"))) == "Fig. 1. x"
    assert one(spark, X.squeeze(F.lit(" a \n b\t"))) == "a b"
    for text, is_caption in (("Figure 1.", True), ("Figure 2a:", True), ("Fig. 4.", True), ("Fig. 5a ", True), ("Figures 1-3", False), ("Fig 1.", False), ("Figure 1", False)):
        assert one(spark, F.regexp_like(F.lit(text), F.lit(X.CAPTION_START))) is is_caption
    assert one(spark, F.regexp_extract_all(F.lit("see Figs. 2 and 3, Figure 4a"), F.lit(X.CITATION), 1)) == ["2", "4a"]
    assert one(spark, X.figure_key(F.lit("Figure 2a"))) == "2a" and one(spark, X.figure_number(F.lit("Figure 2a"))) == 2


def test_cache_key(spark):
    key = archive.cache_key(F.lit("2012-01 - Labrosse, N"), F.lit(0), F.lit("AIA"), F.lit(304), F.lit("2010-09-19T08:00:00"))
    assert one(spark, key) == "2012-01_-_Labrosse__N__000__AIA__304__2010-09-19T08_00_00.fits"
    assert one(spark, archive.output_name(F.lit("Å b"), F.lit(1234))) == "Å_b__1234.png"


def test_observation_time(spark):
    want = datetime.datetime(2012, 7, 4, 9, 54, 53)
    for t in ("2012-07-04T09:54:53", "2012-07-04T09:54:53.9", "2012-07-04T09:54:53+02:00", "2012-07-04 09:54:53Z"):
        assert one(spark, X.observation_time(F.lit(t))) == want
    assert one(spark, X.observation_time(F.lit("July 4"))) is None


def test_bounds(spark):
    f = lambda **k: tuple(one(spark, archive.bounds(F.lit(k["s"]), F.lit(k.get("tx")), F.lit(k.get("ty")), F.lit(k.get("fov")).cast("array<double>") if k.get("fov") is None else F.array(*[F.lit(float(x)) for x in k["fov"]]), F.lit(k.get("limb")).cast("string"))))
    assert f(s="strategy_a", tx=-550.0, ty=-250.0, fov=[400, 400]) == (-750.0, -450.0, -350.0, -50.0)
    assert f(s="strategy_a", tx=0.0, ty=0.0, fov=[]) == (-150.0, -150.0, 150.0, 150.0)
    assert f(s="strategy_a", tx=0.0, ty=0.0, fov=[300]) == (-1200.0, -1200.0, 1200.0, 1200.0)
    assert f(s="strategy_b", tx=0.0, ty=0.0, limb="NW") == (-800.0, 200.0, -100.0, 800.0)
    assert f(s="strategy_b", tx=0.0, ty=0.0, limb="disk") == (-1200.0, -1200.0, 1200.0, 1200.0)


@pytest.mark.parametrize(
    "raw,out",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('So: {"a": 1} ok', '{"a": 1}'),
        ('[{"a": 1}]', '{"a": 1}'),
        ('[{"a": 1}, {"b": 2}]', "{}"),
        ('{"a": ', "{}"),
        (None, "{}"),
        ('{"a": NaN}', '{"a": null}'),
        ('{"a": 1, "a": 2}', '{"a": 2}'),
        ("{'a': 1}", "{}"),
    ],
)
def test_parse_object(raw, out):
    assert metadata.parse_object(raw) == out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=20))
def test_squeeze_is_python_split(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for r in df.select("v", X.squeeze(F.col("v")).alias("s")).collect():
        assert r["s"] == (None if r["v"] is None else " ".join(r["v"].split()))


def test_arguments():
    papers.check_dates("2012-01-02", "2012-03-00")
    for bad in (("2012-01", "2012-01-01"), ("a-b-c", "2012-01-01"), ("2013-01-01", "2012-01-01")):
        with pytest.raises(ValueError):
            papers.check_dates(*bad)
    with pytest.raises(ValueError):
        papers.check_option("format", "pdf", ("csv", "md", "both"))
