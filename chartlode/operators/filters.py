"""Filters over the health model. All are Column predicates or DataFrame to DataFrame, so Spark pushes them to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.operators.storage import materialize


def tenant(df: DataFrame, user_id: int, column: str = "user_id") -> DataFrame:
    """FLT-01. Rows of one user; ids from 1 on are users."""
    if user_id <= 0:
        raise ValueError("a user id is positive")
    return df.where(F.col(column) == user_id)


def all_of(*predicates: Column | None) -> Column:
    """FLT-02. The conjunction of those that are given; true for none."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def document_filter(*, doc_type: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None, query: str | None = None) -> Column:
    """FLT-02, FLT-03, FLT-05. Each argument that is given adds a predicate; until is a whole day; query is a LIKE pattern in title or clinic."""
    like = None if query is None else F.lower("title").like(f"%{query.lower()}%") | F.lower(F.coalesce("clinic", F.lit(""))).like(f"%{query.lower()}%")
    return all_of(
        None if doc_type is None else F.col("doc_type") == doc_type,
        None if status is None else F.col("status") == status,
        None if since is None else F.col("created_at") >= F.lit(since).cast("timestamp_ntz"),
        None if until is None else F.col("created_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"),
        like,
    )


def between(column: str, since: str | None, until: str | None) -> Column:
    """FLT-04. Closed range; a bound of None is open."""
    return all_of(None if since is None else F.col(column) >= F.lit(since).cast("timestamp_ntz"), None if until is None else F.col(column) <= F.lit(until).cast("timestamp_ntz"))


def lab_key() -> Column:
    """FLT-06. The name that a result is looked up by."""
    return F.lower(F.coalesce("analyte_canonical", "analyte_name"))


def exact_or_like(labs: DataFrame, queries: DataFrame) -> DataFrame:
    """FLT-07. For each query (column q): results whose key equals it; only where there are none, results whose name contains it.

    Keys are met by an equal join. Only queries without one are searched in names, and only in distinct ones, of which a registry
    has some thousand, so the LIKE never meets all rows. These names are written, so labs is made twice: for them and for the results.
    What was found is written, too: Spark knows that it is small, and doesn't deal all results by name to meet it."""
    names = materialize(labs.select(lab_key().alias("key"), F.lower("analyte_name").alias("name")).distinct(), "names")
    wanted = queries.select(F.lower("q").alias("q")).distinct()
    exact = wanted.join(names, F.col("q") == F.col("key"))
    parts = wanted.join(names.select(F.col("key").alias("q")).distinct(), "q", "left_anti").join(names, F.col("name").contains(F.col("q")))
    hits = materialize(exact.unionByName(parts).select("q", "key", "name"), "hits")
    return labs.withColumn("key", lab_key()).withColumn("name", F.lower("analyte_name")).join(hits, ["key", "name"]).drop("key", "name")


def out_of_reference() -> Column:
    """FLT-08. Outside the bounds, an absent one being open; at least one is there."""
    return (F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()) & ((F.col("value_num") < F.coalesce("ref_low", F.lit(-1e18))) | (F.col("value_num") > F.coalesce("ref_high", F.lit(1e18))))


def filled(column: str) -> Column:
    """FLT-09."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def by_prefix(chunks: DataFrame, source: str, prefix: str, limit: int) -> DataFrame:
    """FLT-10. The first chunks of a source, by key, whose key begins with prefix in any case."""
    return chunks.where((F.col("source") == source) & F.lower("ref_key").startswith(prefix.lower())).orderBy("ref_key").limit(limit)


def due(accounts: DataFrame, now: str) -> DataFrame:
    """FLT-12. Accounts with an interval that were never synced or whose interval is over at now."""
    next_at = F.col("last_sync_at") + F.make_dt_interval(hours=F.col("sync_interval_hours"))
    return accounts.where(F.col("sync_interval_hours").isNotNull() & (F.col("last_sync_at").isNull() | (next_at <= F.lit(now).cast("timestamp_ntz"))))


def snippets(docs: DataFrame, terms: DataFrame, length: int, per_term: int, id_col: str = "doc_id", text_col: str = "text", most_terms: int = 1000) -> DataFrame:
    """FLT-14. For each term (a stated list): the first per_term texts by id that contain it, in any case, cut to length.

    Each text is read once and meets all terms, so there may be most_terms of them at most; more are an error. Spark keeps per_term
    rows of a term in each task before it ranks them. Null and empty terms find nothing."""
    wanted = [r["term"] for r in terms.select("term").where("term <> ''").distinct().limit(most_terms + 1).collect()]
    if len(wanted) > most_terms:
        raise ValueError(f"over {most_terms} terms; ask in parts")
    text = F.col(text_col)
    low = F.lower(text)
    hit = F.filter(F.array(*[F.lit(t) for t in sorted(wanted)]).cast("array<string>"), lambda t: F.contains(low, F.lower(t)))
    hits = docs.select(F.col(id_col).alias("id"), F.substring(text, 1, length).alias("snippet"), F.explode(hit).alias("term"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy("id"))
    return hits.select("term", "id", "snippet", rank.alias("place")).where(F.col("place") <= per_term)
