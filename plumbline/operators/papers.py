"""The list stage: papers in a range of partial dates, their table and Markdown forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

COLUMNS = ["id", "title", "authors", "publication_date", "doi", "bibcode", "citation_count", "ads_url"]


def check_dates(start: str, end: str) -> None:
    """Three integer parts each, and years in order; ranges of months aren't checked."""
    for name, d in (("start", start), ("end", end)):
        if len(d.split("-")) != 3 or not all(re.fullmatch(r"\s*[+-]?\d+\s*", p) for p in d.split("-")):
            raise ValueError(f"{name} must be YYYY-MM-DD, not {d!r}")
    if int(start.split("-")[0]) > int(end.split("-")[0]):
        raise ValueError("start year is after end year")


def check_option(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def select_papers(papers: DataFrame, start: str, end: str) -> DataFrame:
    """A null date is in no range."""
    check_dates(start, end)
    return papers.where(X.in_date_range(F.col("publication_date"), start, end))


def list_papers(papers: DataFrame, start: str, end: str) -> DataFrame:
    """The table form: defaults for missing values, titles of at most 80. Its order, by date and id, is the
    sink's: no sort of all papers stands in the plan of who goes on with them."""
    blank = lambda c: X.truthy(F.col(c), F.lit("")).alias(c)
    return select_papers(papers, start, end).select(
        "id",
        X.truncate_title(F.coalesce("title", F.lit(""))).alias("title"),
        X.truthy(F.col("authors"), F.lit("(see paper)")).alias("authors"),
        F.coalesce("publication_date", F.lit("")).alias("publication_date"),
        blank("doi"),
        blank("bibcode"),
        F.coalesce(F.nullif("citation_count", F.lit(0)).cast("string"), F.lit("")).alias("citation_count"),
        blank("ads_url"),
    )


def markdown_entry() -> Column:
    """One paper's entry; lines without a value are left out, a citation count of 0 is not."""
    given = lambda c, line: F.when(F.coalesce(F.col(c), F.lit("")) != "", line)
    c = {x: F.col(x) for x in ("doi", "bibcode", "ads_url")}
    abstract = F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), r"^\s+|\s+$", ""))
    parts = [
        F.concat(F.lit("## "), X.truthy(F.col("title"), F.lit("(no title)")), F.lit("\n\n")),
        F.concat(F.lit("- **ID:** "), F.col("id").cast("string"), F.lit("\n")),
        F.concat(F.lit("- **Authors:** "), X.truthy(F.col("authors"), F.lit("(see paper)")), F.lit("\n")),
        F.concat(F.lit("- **Date:** "), F.coalesce("publication_date", F.lit("")), F.lit("\n")),
        given("doi", F.concat(F.lit("- **DOI:** ["), c["doi"], F.lit("](https://doi.org/"), c["doi"], F.lit(")\n"))),
        given("bibcode", F.concat(F.lit("- **Bibcode:** `"), c["bibcode"], F.lit("`\n"))),
        F.concat(F.lit("- **Citations:** "), F.col("citation_count").cast("string"), F.lit("\n")),
        given("ads_url", F.concat(F.lit("- **ADS:** ["), c["ads_url"], F.lit("]("), c["ads_url"], F.lit(")\n"))),
        F.when(abstract != "", F.concat(F.lit("\n> "), abstract, F.lit("\n"))),
        F.lit("\n---\n\n"),
    ]
    return F.concat_ws("", *parts)


def markdown(papers: DataFrame, start: str, end: str) -> DataFrame:
    return select_papers(papers, start, end).select("id", "publication_date", markdown_entry().alias("entry"))


def per_month(papers: DataFrame) -> DataFrame:
    return papers.groupBy(X.format_publication_date(F.col("publication_date")).alias("month")).agg(F.count("*").alias("papers"))
