"""Changes to stored tables: the new rows or table are returned, writing them is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tables that go with a user, each with the column that names the user.
USER_TABLES = ("documents", "lab_results", "doctor_reports", "patient_profile", "patient_complaints", "patient_medications", "health_accounts", "health_metrics", "health_activities", "rag_chunks", "sessions", "users")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """DML-02, STR-01. Old and new rows, one for each key: a new one before an old one, of new ones the last in order."""
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    best = [F.desc("_new"), *([F.desc_nulls_last(order)] if order else []), *[F.desc(c) for c in columns if c not in keys]]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("_n = 1").select(*columns)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML-02 with COALESCE(new, old): a null of the new row keeps the old value."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("o")), new.select(*keys, F.struct(*rest).alias("n"))
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def patch(df: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """DML-03. Rows with the allowed fields that a patch (key, changes map<string,string>) names, a null value included."""
    found = df.join(patches.select(key, "changes"), key, "left")
    value = lambda c: F.when(F.coalesce(F.map_contains_key("changes", c), F.lit(False)), F.col("changes").getItem(c).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return found.select(*[value(c) if c in allowed else F.col(c) for c in df.columns])


def without(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """DML-04. Rows whose key isn't among the gone ones; rows without a key stay."""
    return df.join(gone.select(F.col(gone_key or key).alias(key)).distinct(), key, "left_anti")


def forget_user(tables: dict[str, DataFrame], user: int) -> dict[str, DataFrame]:
    """DML-04. Every table without the user's rows; chunks of the user go as well."""
    return {name: df.where(F.col("user_id").isNull() | (F.col("user_id") != user)) if name in USER_TABLES else df for name, df in tables.items()}


def with_defaults(new: DataFrame, **defaults: Column) -> DataFrame:
    """DML-05. New rows with defaults where a column is absent or null."""
    return new.withColumns({c: F.coalesce(F.col(c), d) if c in new.columns else d for c, d in defaults.items()})


def set_verified(documents: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """DML-06. verified_at of the documents named: a time, or null after an edit."""
    hit = documents.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("verified_at", F.when(F.coalesce("_hit", F.lit(False)), at).otherwise(F.col("verified_at"))).select(*documents.columns)


def placeholders(users: DataFrame, documents: DataFrame, title: str) -> DataFrame:
    """DML-07. (user_id, title) to add: users who have no document of that title yet."""
    return users.select("user_id").join(documents.where(F.col("title") == title).select("user_id").distinct(), "user_id", "left_anti").withColumn("title", F.lit(title))


def enriched(labs: DataFrame, matches: DataFrame, registry: DataFrame) -> DataFrame:
    """DML-08. Results with what their name matched: canonical name, group, expected units, and whether the unit is none of them.

    matches: query, status, record; labs: query; registry: record, canonical, grp, units."""
    from chartlode.functions.lab import unit_mismatch

    joined = labs.join(matches.select("query", "status", "record"), "query", "left").join(registry, "record", "left")
    units = F.coalesce("units", F.array().cast("array<string>"))
    return joined.withColumn("match_status", F.coalesce("status", F.lit("unverified"))).withColumn("unit_mismatch", unit_mismatch(F.col("match_status"), F.col("unit"), units)).drop("status", "units")


def add_missing_columns(df: DataFrame, **columns: str) -> DataFrame:
    """M1. df with the columns that it lacks, as nulls of the types given; the same again for what it has."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def copied(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2. Old rows by the columns that both versions have."""
    both = sorted(set(old.columns) & set(new.columns))
    return new.select(*both).limit(0).unionByName(old.select(*both))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """M5. Rows whose parent is missing."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
