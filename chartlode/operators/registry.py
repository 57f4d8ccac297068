"""Registries of analytes and drugs out of source rows. A key's lists are reduced to distinct strings before they are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.functions.text import normalize_name
from chartlode.operators.ordered import first_of


def gathered(rows: DataFrame, column: str) -> DataFrame:
    """key, column: the distinct strings of the lists of all rows of a key, in the order in which they come first. rows: key, ordinal, column."""
    each = rows.select("key", "ordinal", F.posexplode(column).alias("at", "x")).where("x is not null")
    first = each.groupBy("key", "x").agg(F.min(F.struct("ordinal", "at")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "x")))
    return first.groupBy("key").agg(F.transform(ordered, lambda p: p["x"]).alias(column))


def analyte_registry(rows: DataFrame) -> DataFrame:
    """AGG-18. key, name, analyte_group, synonyms, units: a record for each normalized name, the first name and group that aren't null.

    rows: ordinal, name, synonyms, units, analyte_group. Names that hold a semicolon are several at once and left out, as are
    null and blank ones; a key without synonyms or units has null there."""
    keyed = rows.where(~F.contains("name", F.lit(";"))).withColumn("key", normalize_name(F.col("name"))).where("key <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    names = keyed.groupBy("key").agg(first("name"), first("analyte_group"))
    return names.join(gathered(keyed, "synonyms"), "key", "left").join(gathered(keyed, "units"), "key", "left")


def first_records(rows: DataFrame) -> DataFrame:
    """AGG-19. The first row, by ordinal, of each normalized name."""
    return first_of(rows.withColumn("key", normalize_name(F.col("name"))), [F.col("key")], [F.col("ordinal")])


def drug_registry(rows: DataFrame) -> DataFrame:
    """AGG-20. key, name, types, statuses, reg_numbers, mnn: a record for each trade name and each generic name (mnn).

    rows: ordinal, trade, mnn, status, reg_number. The mnn of a trade name is the last that isn't blank; blank names are left out."""
    mnn = F.nullif(F.trim("mnn"), F.lit(""))
    one = lambda name, kind, own: rows.select("ordinal", name.alias("name"), F.lit(kind).alias("type"), own.alias("mnn"), "status", "reg_number")
    both = one(F.col("trade"), "trade", mnn).unionByName(one(mnn, "mnn", F.lit(None).cast("string")))
    both = both.withColumn("key", normalize_name(F.col("name"))).where("key <> ''")
    every = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    last = F.max_by("mnn", F.when(F.col("mnn").isNotNull(), F.col("ordinal")))
    return both.groupBy("key").agg(F.min_by("name", "ordinal").alias("name"), every("type", "types"), every("status", "statuses"), every("reg_number", "reg_numbers"), last.alias("mnn"))
