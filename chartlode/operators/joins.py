"""Joins over the health model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reports_with_clinic(reports: DataFrame, documents: DataFrame, clinic: str | None = None) -> DataFrame:
    """JOIN-01. Reports with their document's clinic; a clinic filter keeps only theirs."""
    out = reports.join(documents.select(F.col("id").alias("document_id"), "clinic"), "document_id", "left")
    return out if clinic is None else out.where(F.col("clinic") == clinic)


def documents_of_doctor(documents: DataFrame, reports: DataFrame, doctor: str) -> DataFrame:
    """JOIN-02. Documents of which the user has a report by the doctor."""
    by = reports.where(F.col("doctor_name") == doctor).select(F.col("document_id").alias("id"), "user_id")
    return documents.join(by, ["id", "user_id"], "left_semi")


def counts_per_user(users: DataFrame, **children: DataFrame) -> DataFrame:
    """JOIN-03. Each user with the number of rows in each child table, 0 where there are none."""
    for name, child in children.items():
        users = users.join(child.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return users


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """JOIN-06. For each document, the lowest other id of its user's extracted documents with the same file, or the same type, title and clinic.

    The OR of two equalities is the union of two grouped lookups: within a group the lowest id serves all others, and the
    second lowest serves the lowest, so no pairs are made."""

    def lowest(keys: list) -> DataFrame:
        rows = documents.select("id", "user_id", "status", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).where(F.forall(F.array(*[F.col(f"k{i}").isNotNull() for i in range(len(keys))]), lambda x: x))
        names = ["user_id", *[f"k{i}" for i in range(len(keys))]]
        done = rows.where("status = 'F'")
        first = done.groupBy(*names).agg(F.min("id").alias("a"))
        second = done.join(first, names).where("id > a").groupBy(*names).agg(F.min("id").alias("b"))
        two = first.join(second, names, "left")
        return rows.join(two, names).select("id", F.when(F.col("a") != F.col("id"), F.col("a")).otherwise(F.col("b")).alias("other"))

    both = lowest([F.col("file_sha256")]).union(lowest([F.col("doc_type"), F.col("title"), F.coalesce("clinic", F.lit(""))]))
    return both.where("other is not null").groupBy("id").agg(F.min("other").alias("duplicate_of"))


def lookup_first(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """JOIN-07. Rows with the record of their key; of records that share a key the one of the lowest ordinal."""
    best = dimension.groupBy(key).agg(F.min_by(F.struct(*[c for c in dimension.columns if c != key]), "ordinal").alias("record"))
    return rows.join(best, key, "left")


def evidence(ids: DataFrame, domains: list[DataFrame]) -> DataFrame:
    """JOIN-11. ids with the record of the last domain that has them. Each domain: evidence_id, record."""
    every = None
    for k, d in enumerate(domains):
        part = d.select("evidence_id", "record", F.lit(k).alias("domain"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("evidence_id").agg(F.max_by("record", "domain").alias("record"), F.max("domain").alias("domain"))
    return ids.join(best, "evidence_id", "left")


def medication_dates(reports: DataFrame) -> DataFrame:
    """JOIN-12. Each medication line with its report's visit date, else the date of the user's latest dated report."""
    latest = reports.groupBy("user_id").agg(F.max("visit_date").alias("latest"))
    lines = reports.select("id", "user_id", "visit_date", F.posexplode("medications").alias("position", "medication"))
    return lines.join(latest, "user_id", "left").select("id", "position", "medication", F.coalesce("visit_date", "latest").alias("dated"))


def pairwise_jaccard(texts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """JOIN-13. Mean Jaccard of the pairs i < j of a group's answers (some seeds of one model, so groups are small). Two empty sets are alike."""
    a = texts.select("grp", F.col("i").alias("i"), F.col(tokens).alias("x"))
    b = texts.select("grp", F.col("i").alias("j"), F.col(tokens).alias("y"))
    union = F.size(F.array_union("x", "y"))
    score = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("x", "y")) / union)
    return a.join(b, "grp").where("i < j").groupBy("grp").agg(F.count("*").alias("pairs"), F.round(F.avg(score), 6).alias("mean_jaccard"))


def missing_citations(cited: DataFrame, valid: DataFrame) -> DataFrame:
    """JOIN-14. Cited ids that aren't valid."""
    return cited.join(valid, "evidence_id", "left_anti")


def impute_birth(people: DataFrame) -> DataFrame:
    """JOIN-15. A missing birth date is the name's only known one, if it has one only. People without a name share none.

    Least and greatest date of a name are summed before the shuffle, so a frequent name is no task's alone; names that know none or two send nothing on."""
    known = people.where(F.col("birth").isNotNull()).groupBy(F.col("name").alias("_name")).agg(F.min("birth").alias("_least"), F.max("birth").alias("_most"))
    only = known.where("_least = _most").drop("_most")
    return people.join(only, F.col("name") == F.col("_name"), "left").withColumn("birth", F.coalesce("birth", "_least")).drop("_name", "_least")


def against_baseline(run: DataFrame, base: DataFrame, seconds: float = 30) -> DataFrame:
    """JOIN-16. Documents whose status changed or whose time moved by more than so many seconds."""
    both = run.select("doc", F.col("status").alias("now_status"), F.col("elapsed").alias("now_s")).join(base.select("doc", F.col("status").alias("was_status"), F.col("elapsed").alias("was_s")), "doc")
    return both.where((F.col("now_status") != F.col("was_status")) | (F.abs(F.col("now_s") - F.col("was_s")) > seconds))
