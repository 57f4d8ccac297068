"""Aggregations over the health model. Each is one or two grouped passes with map-side sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.operators import blocks


def daily(metrics: DataFrame, digits: int = 1, *more: str) -> DataFrame:
    """AGG-01, AGG-12. Per metric and day (and more): count, mean rounded, least and most, the least unit, over all providers."""
    return metrics.groupBy("metric", F.to_date("taken_at").alias("day"), *more).agg(F.count("value_num").alias("n"), F.round(F.avg("value_num"), digits).alias("avg_value"), F.min("value_num").alias("min_value"), F.max("value_num").alias("max_value"), F.min("unit").alias("unit"))


def catalogue(metrics: DataFrame) -> DataFrame:
    """AGG-02. Per metric: count, first and last time."""
    return metrics.groupBy("metric").agg(F.count("*").alias("n"), F.min("taken_at").alias("first_at"), F.max("taken_at").alias("last_at"))


def overall(metrics: DataFrame, activities: DataFrame) -> DataFrame:
    """AGG-03. One row of totals."""
    return metrics.agg(F.count("*").alias("points"), F.countDistinct("metric").alias("metrics"), F.min("taken_at").alias("first_at"), F.max("taken_at").alias("last_at")).crossJoin(activities.agg(F.count("*").alias("activities")))


def facets(documents: DataFrame) -> DataFrame:
    """AGG-04. Counts by type, by status and in all, in one pass; null is a value of its own."""
    sets = documents.groupingSets([["doc_type"], ["status"], []], "doc_type", "status").agg(F.count("*").alias("n"), F.grouping("doc_type").alias("gt"), F.grouping("status").alias("gs"))
    facet = F.when(F.col("gt") == 0, "doc_type").when(F.col("gs") == 0, "status").otherwise("total")
    return sets.select(facet.alias("facet"), F.when(F.col("gt") == 0, F.col("doc_type")).when(F.col("gs") == 0, F.col("status")).alias("value"), "n")


def series(labs: DataFrame, key: Column) -> DataFrame:
    """AGG-09. Per analyte: its points in time order, in chunks of CHUNK points, so that no row grows with a frequent analyte."""
    points = F.sort_array(F.collect_list(F.struct("_place", "value_num")))
    rows = chunked(labs.select(key.alias("analyte"), "taken_at", "id", "value_num"), "analyte", ["taken_at", "id", "value_num"])
    return rows.groupBy("analyte", "chunk").agg(F.transform(points, lambda p: p["value_num"]).alias("values_in_order"), F.count("*").alias("n"))


#: Points in a row of a series.
CHUNK = 1000


def chunked(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Rows with their place in the order of their key and the number of the chunk that holds it, both from 0."""
    out = blocks.ranked(rows, [key] if isinstance(key, str) else key, order).withColumnRenamed("_at", "_place").drop("_n")
    return out.withColumn("chunk", F.floor(F.col("_place") / CHUNK).cast("int"))


def weekly(metrics: DataFrame) -> DataFrame:
    """AGG-10. Per metric and ISO week: the mean of the rounded daily means, least of the least, most of the most."""
    days = daily(metrics)
    return days.groupBy("metric", F.extract(F.lit("YEAROFWEEK"), "day").alias("iso_year"), F.weekofyear("day").alias("iso_week")).agg(F.round(F.avg("avg_value"), 2).alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def recent_mean(metrics: DataFrame, today: str, days: int = 14) -> DataFrame:
    """AGG-11. Per metric: the mean of the daily means from so many days before today to today."""
    return daily(metrics).where(F.col("day").between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date"))).groupBy("metric").agg(F.round(F.avg("avg_value"), 2).alias("mean_of_days"), F.count("*").alias("days"))


def overview(metrics: DataFrame, without: str) -> DataFrame:
    """AGG-13. Per metric but one: mean, least, most, count, span and unit, the most frequent first."""
    return metrics.where(F.col("metric") != without).groupBy("metric").agg(F.round(F.avg("value_num"), 1).alias("avg_value"), F.round(F.min("value_num"), 1).alias("min_value"), F.round(F.max("value_num"), 1).alias("max_value"), F.count("*").alias("n"), F.min("taken_at").alias("first_at"), F.max("taken_at").alias("last_at"), F.min("unit").alias("unit")).orderBy(F.desc("n"), "metric")


def activity_overview(activities: DataFrame) -> DataFrame:
    """AGG-14. Per type: mean minutes, kilometres, calories and heart rate."""
    return activities.groupBy("activity_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("duration_s") / 60), 1).alias("minutes"), F.round(F.avg(F.col("distance_m") / 1000), 2).alias("km"), F.round(F.avg("calories"), 1).alias("calories"), F.round(F.avg("avg_hr"), 1).alias("heart_rate"))


def fact_series(labs: DataFrame) -> DataFrame:
    """AGG-15. Per name and unit (null as ''): ordered ids and count, in chunks as in AGG-09."""
    rows = labs.select("analyte_name", F.coalesce("unit", F.lit("")).alias("unit_key"), "taken_at", "id")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_place", "id"))), lambda p: p["id"])
    return chunked(rows, ["analyte_name", "unit_key"], ["taken_at", "id"]).groupBy("analyte_name", "unit_key", "chunk").agg(ids.alias("ids"), F.count("*").alias("n"))


def series_stats(labs: DataFrame) -> DataFrame:
    """AGG-16. Per name and unit: count, dates, mean, least and most with when they were."""
    return labs.groupBy("analyte_name", "unit").agg(F.count("value_num").alias("n"), F.min("taken_at").alias("date_from"), F.max("taken_at").alias("date_to"), F.round(F.avg("value_num"), 2).alias("mean"), F.min("value_num").alias("low"), F.max("value_num").alias("high"))


def activity_totals(activities: DataFrame) -> DataFrame:
    """AGG-17. Per provider: totals with null as 0."""
    total = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))), 2).alias(f"total_{c}")
    return activities.groupBy("provider").agg(F.count("*").alias("n"), total("duration_s"), total("distance_m"), total("calories"))


def mode_first_seen(df: DataFrame, group: str, value: str, ordinal: str) -> DataFrame:
    """AGG-21. Per group: the most frequent value, of equal ones that seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def panels(labs: DataFrame, core: list[str], least: int = 3) -> DataFrame:
    """AGG-22. Documents with so many distinct analytes of a core set."""
    found = labs.groupBy("document_id").agg(F.array_sort(F.collect_set(F.when(F.lower("analyte_name").isin(core), F.lower("analyte_name")))).alias("found"))
    return found.where(F.size("found") >= least)


def completeness(labs: DataFrame) -> DataFrame:
    """AGG-23. Per document: how many results have a value, a unit, a bound."""
    return labs.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("value_num").isNotNull() | F.col("value_text").isNotNull()).alias("with_value"), F.count_if(F.col("unit").isNotNull()).alias("with_unit"), F.count_if(F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()).alias("with_reference"))


def weighted_rate(df: DataFrame, group: str, rate: str, weight: str) -> DataFrame:
    """AGG-24. Weighted mean."""
    return df.groupBy(group).agg(F.round(F.sum(F.col(rate) * F.col(weight)) / F.sum(weight), 6).alias("weighted_rate"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """AGG-25. Per model: accuracy, pass rate, mean precision, mean and upper median time, score = precision * pass rate / mean time."""
    out = runs.groupBy("model").agg(F.count("*").alias("n"), (F.sum("matched") / F.sum("expected")).alias("accuracy"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("precision").alias("macro_precision"), F.avg("seconds").alias("avg_s"))
    median = blocks.value_at(runs, "model", "seconds", lambda n: F.floor(n / 2)).select(F.col("model").alias("_model"), F.col("seconds").alias("median_s"))
    out = out.join(median, F.col("model").eqNullSafe(F.col("_model")), "left").drop("_model")
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "pass_rate", "macro_precision", "avg_s", "median_s")], F.round(F.col("macro_precision") * F.col("pass_rate") / F.col("avg_s"), 6).alias("score"))


def nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """AGG-26. Per sensor: least, mean, most and nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(q * 100)}")
    return df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("high"), p(0.5), p(0.95))


def batch_p95(df: DataFrame, group: str, value: str) -> DataFrame:
    """AGG-28. The value at place int(.95 n) of the sorted list (1 at least): not the nearest rank. Null for a group without values."""
    found = blocks.value_at(df, group, value, lambda n: F.greatest(F.floor(F.lit(0.95) * n), F.lit(1)) - 1).select(F.col(group).alias("_group"), F.col(value).alias("p95"))
    sizes = df.groupBy(group).agg(F.count(value).alias("n"))
    return sizes.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "n", "p95")


def matched_share(labs: DataFrame) -> DataFrame:
    """AGG-29. Per document: results, matched ones, their share."""
    return labs.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("match_status") == "matched").alias("matched"), F.round(F.count_if(F.col("match_status") == "matched") / F.count("*"), 4).alias("share"))


def period_lines(labs: DataFrame) -> DataFrame:
    """AGG-30. Per analyte: its values in time order with arrows between, in chunks as in AGG-09; on each the last unit and bounds and the last point's marker."""
    order = ["taken_at", "id", "value_num", "unit", "ref_low", "ref_high"]
    rows = labs.where("value_num is not null").select("analyte_name", *order)
    ends = rows.groupBy("analyte_name").agg(F.max(F.struct(*order)).alias("last"))
    points = F.sort_array(F.collect_list(F.struct("_place", "value_num")))
    out = chunked(rows, "analyte_name", order).groupBy("analyte_name", "chunk").agg(points.alias("points")).join(ends, "analyte_name")
    last = F.col("last")
    marker = F.when(last["value_num"] < last["ref_low"], "↓").when(last["value_num"] > last["ref_high"], "↑").otherwise("")
    return out.select("analyte_name", "chunk", F.array_join(F.transform("points", lambda p: p["value_num"].cast("int").cast("string")), " → ").alias("line"), last["unit"].alias("unit"), last["ref_low"].alias("ref_low"), last["ref_high"].alias("ref_high"), marker.alias("marker"))
