"""UDF-03, UDF-04. Places where a user's own rules go in: normalizers of names and extractors of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlode.functions.text import normalize_name, query_name
from chartlode.operators import fuzzy


@dataclass(frozen=True)
class Normalizer:
    """UDF-03. How raw names become a registry's names; each step can be another.

    build_index: registry -> key, record, order. prepare: raw name -> query. short_circuit: query, raw name -> the key that ends the
    search, or null (an answer that isn't a key leaves the name unverified). matched: what an accepted row must also fulfil."""

    max_edit_ratio: float
    ratio_floor: float
    build_index: Callable[[DataFrame], DataFrame] = lambda registry: fuzzy.key_index(registry, normalize_name)
    prepare: Callable[[Column], Column] = normalize_name
    short_circuit: Callable[[Column, Column], Column] = lambda query, raw: F.lit(None).cast("string")
    matched: Callable[[DataFrame], Column] = lambda found: F.lit(True)
    short: int = 0

    def resolve(self, rows: DataFrame, registry: DataFrame, raw: str = "raw") -> DataFrame:
        """rows with status, key, record, distance and ratio, see fuzzy.match()."""
        index = self.build_index(registry)
        asked = rows.withColumn("query", self.prepare(F.col(raw)))
        answer = self.short_circuit(F.col("query"), F.col(raw))
        asked = asked.withColumn("_told", answer.isNotNull()).withColumn("query", F.coalesce(answer, "query"))
        found = fuzzy.match(asked, index, max_edit_ratio=self.max_edit_ratio, ratio_floor=self.ratio_floor, short=self.short)
        out = asked.join(found, "query", "left")
        ok = (F.col("status") == "matched") & (~F.col("_told") | (F.col("distance") == 0)) & F.coalesce(self.matched(out), F.lit(False))
        return out.select(*rows.columns, F.when(ok, "matched").otherwise("unverified").alias("status"), F.when(ok, F.col("key")).alias("key"), F.when(ok, F.col("record")).alias("record"), "distance", "ratio")


ANALYTES = Normalizer(0.35, 75, prepare=query_name, short=3)
DRUGS = Normalizer(0.40, 70)

Extractor = Callable[[DataFrame], DataFrame]


class Extractors:
    """UDF-04. Extractors by type of document. Each takes the documents of its type and gives rows of the same columns as the others."""

    def __init__(self) -> None:
        self.known: dict[str, Extractor] = {}

    def register(self, doc_type: str) -> Callable[[Extractor], Extractor]:
        """Decorator. A later extractor of a type takes an earlier one's place."""

        def add(extract: Extractor) -> Extractor:
            self.known[doc_type] = extract
            return extract

        return add

    def run(self, documents: DataFrame, type_col: str = "doc_type") -> DataFrame:
        """All rows, with their document's type as doc_type. Documents of an unknown or null type give none; see unknown()."""
        if not self.known:
            raise ValueError("no extractor is registered")
        parts = [extract(documents.where(F.col(type_col) == kind)).withColumn("doc_type", F.lit(kind)) for kind, extract in self.known.items()]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def unknown(self, documents: DataFrame, type_col: str = "doc_type") -> DataFrame:
        """The documents that no extractor takes, null types among them."""
        return documents.where(~F.coalesce(F.col(type_col).isin(*self.known), F.lit(False)))
