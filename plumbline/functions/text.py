"""Scalar expressions over strings, partial dates and JSON-like values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The patterns of captions, citations and authors. Word boundaries are written out, as
# Java's \\b takes other letters than other engines do.
#: White space as Unicode defines it, with the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
CAPTION_START = r"(?i)^(?:Figure|Fig\.)\s*\d+[a-z]?[.:\s]"
CAPTION_LABEL = r"(?i)((?:Figure|Fig\.)\s*\d+[a-z]?)"
CITATION = r"(?i)(?<![\p{L}\p{N}_])(?:Figs?\.?\s*|Figures?\s+)(\d+[a-zA-Z]?)"


def truthy(x: Column, other: Column) -> Column:
    """x unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def format_publication_date(d: Column) -> Column:
    """YYYY-MM-DD with unknown parts left out: by length and by 00."""
    year, month, day = F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2)
    n = F.length(d)
    return F.when(n < 4, d).when((n < 7) | (month == "00"), year).when((n < 10) | (day == "00"), F.concat_ws("-", year, month)).otherwise(F.concat_ws("-", year, month, day))


def month_key(d: Column) -> Column:
    """100 * year + month of a partial date; a missing month or 00 is January; null if unparsable."""
    year, month = F.substring(d, 1, 4).try_cast("int"), F.substring(d, 6, 2)
    m = F.when((F.length(d) < 7) | (month == "00"), F.lit(1)).otherwise(month.try_cast("int"))
    return year * 100 + m


def in_date_range(d: Column, start: str, end: str) -> Column:
    return F.coalesce(month_key(d).between(month_key(F.lit(start)), month_key(F.lit(end))), F.lit(False))


def truncate_title(t: Column, most: int = 80) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


#: How a first author stands in a field and on a first page, in the order in which the forms are
#: tried: (pattern, group of the last name, group of the initial).
_BEGIN, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
FIELD_AUTHORS = [
    (r"^([A-Z][a-zA-Z'\-]+),\s+([A-Z])", 1, 2),
    (r"^([A-Z])[.\s]+(?:[A-Z][.\s]+)*([A-Z][a-z]{2,})", 2, 1),
]
PAGE_AUTHORS = [
    (_BEGIN + r"([A-Z])\.(?:\s*[A-Z]\.)?\s+([A-Z][a-z]{2,})\s*[\d,\s]", 2, 1),
    (_BEGIN + r"([A-Z][a-z]{2,}),\s+([A-Z])\.", 1, 2),
    (_BEGIN + r"([A-Z][a-z]+)\s+([A-Z][a-z]{2,})" + _END, 2, 1),
]


def _author(x: Column, forms: list[tuple[str, int, int]]) -> Column:
    """struct(last, initial) by the first form that x has, else null."""
    out = F.lit(None).cast("struct<last:string,initial:string>")
    for pattern, last, initial in reversed(forms):
        own = F.struct(F.regexp_extract(x, pattern, last).alias("last"), F.substring(F.regexp_extract(x, pattern, initial), 1, 1).alias("initial"))
        out = F.when(F.regexp_like(x, F.lit(pattern)), own).otherwise(out)
    return out


def author_of_field(authors: Column) -> Column:
    """struct(last, initial) from "Last, F. I.; ..." or else "F. I. Last, ...", else null. White space
    around the field doesn't count."""
    return _author(F.regexp_replace(authors, r"(?U)^\s+|\s+$", ""), FIELD_AUTHORS)


def author_of_text(text: Column) -> Column:
    """struct(last, initial) from the first 3000 characters of a first page's text, else null."""
    return _author(F.substring(text, 1, 3000), PAGE_AUTHORS)


def author_of_bibcode(bibcode: Column) -> Column:
    """Unknown, with the last character if it is a capital, else X."""
    last = F.right(F.trim(bibcode), F.lit(1))
    return F.struct(F.lit("Unknown").alias("last"), F.when(last.rlike(r"^\p{Lu}$"), last).otherwise("X").alias("initial"))


def first_author(authors: Column, bibcode: Column, text: Column) -> Column:
    return F.coalesce(author_of_field(authors), author_of_text(text), author_of_bibcode(bibcode))


def folder_name(date: Column, last: Column, initial: Column) -> Column:
    name = F.concat(format_publication_date(date), F.lit(" - "), last, F.lit(", "), initial)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]', "_"), " {2,}", " "))


def megabytes(size: Column) -> Column:
    """Bytes as MB of 1024 * 1024, to two places."""
    return F.round(size / (1024 * 1024), 2)


def compact_date(d: str) -> str:
    """A date as it stands in file names."""
    return d.replace("-", "")


def safe_name(x: Column) -> Column:
    """Everything but letters, digits, _ and - becomes _."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_\-]", "_")


def clean_caption(x: Column) -> Column:
    return F.substring(squeeze(F.regexp_replace(x, r"(?i)^Figure\s+\d+[a-z]?[.:\s]+", "")), 1, 512)


def figure_key(label: Column) -> Column:
    """The number and letter at a label's end; empty without one."""
    return F.regexp_extract(label, r"(\d+[a-zA-Z]?)$", 1)


def figure_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit("")).try_cast("int")


def block_text(lines: Column) -> Column:
    """Text of a block's lines of spans: spans join with nothing, lines with a space."""
    return F.trim(F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), " "))


def colour_space(code: Column) -> Column:
    return F.when(code == 1, "gray").when(code == 3, "rgb").when(code == 4, "cmyk").otherwise(F.concat(F.lit("cs"), code.cast("string")))


def relative_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(p, r"^/+|/+$", "") for p in parts])


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?/*$", 1)


def observation_time(ts: Column) -> Column:
    """An ISO timestamp whose offset is dropped, to the second; null if it has another shape."""
    shape = ts.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2}|Z)?)?$")
    local = F.regexp_replace(ts, r"(Z|[+-]\d{2}:\d{2})$", "")
    whole = F.when(F.length(ts) > 10, local).otherwise(ts)
    return F.date_trunc("second", F.when(shape, whole).try_cast("timestamp_ntz")).cast("timestamp_ntz")
