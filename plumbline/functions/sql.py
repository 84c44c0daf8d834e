"""The library's functions in SQL: scalar ones as SQL functions, which Catalyst expands in place, and the scan of papers
as a table function for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import text as X

#: Name, parameters and expression of each scalar function.
SCALARS: dict[str, tuple[str, object]] = {
    "first_author": ("authors string, bibcode string, page string", lambda authors, bibcode, page: X.first_author(authors, bibcode, page)),
    "paper_folder": ("published string, last string, initial string", lambda published, last, initial: X.folder_name(published, last, initial)),
    "figure_label": ("block string", lambda block: X.found(block, X.CAPTION_LABEL)),
    "is_caption": ("block string", lambda block: F.regexp_like(block, F.lit(X.CAPTION_START))),
    "figure_citations": ("paragraph string", lambda paragraph: F.regexp_extract_all(paragraph, F.lit(X.CITATION), F.lit(1))),
    "clean_caption": ("caption string", lambda caption: X.clean_caption(caption)),
}


def _expanded(spark: SparkSession, parameters: str, make) -> tuple[str, str]:
    """(type, SQL text) of an expression over its parameters, as Spark itself writes it."""
    names = [p.split(" ")[0] for p in parameters.split(", ")]
    columns: list[Column] = [F.col(n) for n in names]
    d = spark.createDataFrame([], parameters).select(make(*columns).alias("out"))
    alias = d._jdf.queryExecution().analyzed().expressions().head()
    return d.schema["out"].dataType.simpleString(), alias.child().sql()


#: A block, as providers.BLOCKS has it behind the paper's id.
BLOCK = StructType()
for _name, _type in (("page", IntegerType()), ("block_no", IntegerType()), ("type", IntegerType()), ("text", StringType()), *((c, DoubleType()) for c in ("x0", "y0", "x1", "y1"))):
    BLOCK.add(_name, _type)


class PaperBlocks:
    """paper_blocks(content, parser): the text blocks of one paper: page, block_no, type, text, x0, y0, x1, y1. parser is
    the constant 'module:class' of a PaperParser; a paper that it can't read has no rows."""

    @staticmethod
    def analyze(content: AnalyzeArgument, parser: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(content.dataType, BinaryType):
            raise ValueError("paper_blocks takes the content of a file, which is binary")
        if not parser.isConstantExpression or not isinstance(parser.dataType, StringType) or ":" not in (parser.value or ""):
            raise ValueError("paper_blocks takes the parser as a constant 'module:class'")
        return AnalyzeResult(schema=BLOCK)

    def eval(self, content: bytes, parser: str):
        import importlib

        if not hasattr(self, "parser"):
            module, _, name = parser.partition(":")
            self.parser = getattr(importlib.import_module(module), name)()
        try:
            rows = self.parser.blocks(bytes(content or b""))
        except Exception:  # noqa: BLE001  providers.failures() says which papers, and why
            return
        yield from rows


def register(spark: SparkSession) -> None:
    """Makes all of them known to a session, under their names."""
    for name, (parameters, make) in SCALARS.items():
        kind, body = _expanded(spark, parameters, make)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("paper_blocks", F.udtf(PaperBlocks))
