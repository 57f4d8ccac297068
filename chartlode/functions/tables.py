"""UDF-05. Parsers as table functions, for LATERAL in SQL: register(spark), then

    SELECT d.id, r.* FROM documents d, LATERAL harvest(d.payload) r
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from chartlode.operators import panels, parse


RESULT = {"ordinal": IntegerType(), "analyte_name": StringType(), "value_raw": StringType(), "unit": StringType(), "ref_raw": StringType()}


def of_text(argument: AnalyzeArgument, columns: dict[str, DataType]) -> AnalyzeResult:
    """The result's columns, once it is clear that the argument is a text."""
    if not isinstance(argument.dataType, StringType):
        raise ValueError(f"a table function of texts got a {argument.dataType.simpleString()}")
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return AnalyzeResult(out)


class Harvest:
    """SC-62 to SC-64: results in any JSON, whole or cut off. A null gives no rows."""

    @staticmethod
    def analyze(payload: AnalyzeArgument) -> AnalyzeResult:
        return of_text(payload, RESULT)

    def eval(self, payload: str) -> Iterator[tuple]:
        for k, r in enumerate(parse.harvested_text(payload)):
            yield k, r["name"], r["value"], r["unit"], r["ref"]


class LabLines:
    """PRS-07: results of a line of a form's text layer."""

    @staticmethod
    def analyze(line: AnalyzeArgument) -> AnalyzeResult:
        return of_text(line, RESULT)

    def eval(self, line: str) -> Iterator[tuple]:
        for k, r in enumerate(parse.line_results(line or "")):
            yield k, *r


class PanelRows:
    """PRS-14: a panel's rows, of a text in reading order."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return of_text(text, {"analyte_name": StringType(), "value_raw": StringType(), "value_num": DoubleType(), "unit": StringType()})

    def eval(self, text: str) -> Iterator[tuple]:
        yield from panels.in_order((text or "").splitlines())


FUNCTIONS = {"harvest": Harvest, "lab_lines": LabLines, "panel_rows": PanelRows}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
