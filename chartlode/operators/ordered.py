"""Order-dependent operators, sorts, limits and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.operators import blocks


def neighbours(documents: DataFrame) -> DataFrame:
    """WIN-01. Each document's previous and next of its user, by time and id."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    return documents.select("id", "user_id", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


def latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """WIN-02. The n last rows of each key in the given (descending) order, numbered from the oldest of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    return kept.withColumn("place", F.count("*").over(Window.partitionBy(*by)) + 1 - F.col("_back")).drop("_back")


def stage_durations(log: DataFrame, most: float = 3600) -> DataFrame:
    """WIN-03. Seconds from each status to the next of the document, if over 0 and under most."""
    w = Window.partitionBy("document_id").orderBy("entered_at")
    out = log.withColumn("seconds", F.lead("entered_at").over(w) - F.col("entered_at"))
    return out.where((F.col("seconds") > 0) & (F.col("seconds") < most))


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """WIN-04. Exponential moving average over each key's values in order, the first as it is, with their number.

    The average is a weighted sum; a value weighs (1 - alpha) ** (its rank from the end). Once that is under the smallest
    double, earlier values add exactly 0, so only as many rows of a key as weigh something are ranked and summed, which
    Spark picks before it shuffles."""
    rows = df.where(F.col(value).isNotNull())
    weigh = math.ceil(math.log(5e-324) / math.log(1 - alpha)) + 1 if 0 < alpha < 1 else 1
    last = rows.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1).where(F.col("_back") < weigh)
    sizes = rows.groupBy(key).agg(F.count("*").alias("samples"))
    weight = F.pow(F.lit(1 - alpha), F.col("_back")) * F.when(F.col("_back") == F.col("samples") - 1, 1.0).otherwise(alpha)
    return last.join(sizes, key).groupBy(key).agg(F.round(F.sum(F.col(value) * weight), 6).alias("ema"), F.max("samples").cast("int").alias("samples"))


def energy(samples: DataFrame, key: str, time: str, power: str) -> DataFrame:
    """WIN-05. Trapezoid integral over each key's neighbouring samples in joules and watt-hours; null powers and times that don't grow are skipped.

    A block's first sample meets the last one of the block before."""
    rows = blocks.in_blocks(samples.where(F.col(power).isNotNull() & F.col(time).isNotNull()).select(key, time, power), [key], [time, power])
    point = F.struct(F.col(time).alias("t"), F.col(power).alias("p"))
    rows = blocks.with_before(rows, [key], [F.max_by(point, "_place").alias("_last")], lambda w: [F.lag("_last").over(w).alias("_before")])
    last = F.coalesce(F.lag(point).over(blocks.block([key])), F.col("_before"))
    pairs = rows.select(key, time, power, last.alias("_0")).where(F.col(time) > F.col("_0.t"))
    joules = F.sum((F.col(time) - F.col("_0.t")) * (F.col(power) + F.col("_0.p")) / 2)
    return pairs.groupBy(key).agg(F.round(joules, 3).alias("joules"), F.round(joules / 3600, 6).alias("watt_hours"), F.count("*").alias("intervals"))


def seven_day_windows(daily: DataFrame, today: str) -> DataFrame:
    """WIN-06. Days in windows of seven that end today, with the ISO week of the window's end."""
    anchor = F.lit(today).cast("date")
    back = F.floor(F.datediff(anchor, "day") / 7)
    out = daily.where(F.col("day") <= anchor).withColumn("weeks_back", back).withColumn("ends", F.date_sub(anchor, (F.col("weeks_back") * 7).cast("int")))
    ref = F.concat(F.extract(F.lit("YEAROFWEEK"), "ends").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ends").cast("string"), 2, "0"))
    return out.groupBy("metric", "weeks_back", ref.alias("ref_week")).agg(F.round(F.avg("avg_value"), 2).alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.count("*").alias("days"))


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """WIN-07, SET-03, SET-04. The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_passes(rows: DataFrame) -> DataFrame:
    """WIN-08. Rows (doc, pass, ordinal, name_key, value_num, value_text): one for each name of a document. The first stays,
    but the first numeric one replaces a text; it stands where the name stood first."""
    order = F.struct("pass", "ordinal", F.coalesce("value_num", F.lit(float("inf"))))
    first = F.min_by(F.struct("value_num", "value_text"), order)
    numeric = F.min_by(F.when(F.col("value_num").isNotNull(), F.struct("value_num", "value_text")), F.when(F.col("value_num").isNotNull(), order))
    out = rows.groupBy("doc", "name_key").agg(first.alias("f"), numeric.alias("n"), F.min(F.struct("pass", "ordinal")).alias("at"))
    best = F.when(F.col("f.value_num").isNull() & F.col("n").isNotNull(), F.col("n")).otherwise(F.col("f"))
    return out.select("doc", "name_key", best["value_num"].alias("value_num"), best["value_text"].alias("value_text"), F.col("at.pass").alias("pass"), F.col("at.ordinal").alias("ordinal"))


def carry_forward(lines: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """WIN-09. The last value that isn't null, up to each line of the key's file, which may be cut into blocks."""
    rows = blocks.in_blocks(lines.withColumn("_value", value), [key], [order])
    end = F.max_by(F.when(F.col("_value").isNotNull(), F.col("_value")), F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_end")
    rows = blocks.with_before(rows, [key], [end], lambda w: [F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")])
    own = F.last("_value", ignorenulls=True).over(blocks.block([key]).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("carried", F.coalesce(own, "_before")).drop("_value", "_before", "_part", "_place")


def last_point(labs: DataFrame, key: Column) -> DataFrame:
    """WIN-10. Per analyte: count, and value, unit and bounds of the last point."""
    last = F.max_by(F.struct("value_num", "unit", "ref_low", "ref_high"), F.struct("taken_at", "id"))
    return labs.groupBy(key.alias("analyte")).agg(F.count("*").alias("n"), F.max("taken_at").alias("last_at"), last.alias("p")).select("analyte", "n", "last_at", "p.*")


def first_pairs(series: DataFrame) -> DataFrame:
    """WIN-11. The first two ids of each series of two at least. series: name, unit, chunk, ids."""
    return series.where((F.col("chunk") == 0) & (F.size("ids") >= 2)).select("analyte_name", "unit_key", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", 2).alias("second_id"))


def thin_daily(metrics: DataFrame) -> DataFrame:
    """WIN-13. Per metric and user: daily means where some day has several points, else the points."""
    days = metrics.groupBy("user_id", "metric", F.to_date("taken_at").alias("day")).agg(F.count("*").alias("points"), F.avg("value_num").alias("mean"))
    most = F.max("points").over(Window.partitionBy("user_id", "metric"))
    return days.select("user_id", "metric", "day", "points", F.when(most > 1, F.round(F.round("mean", 6), 1)).otherwise(F.col("mean")).alias("value"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """TOP-01, AGG-07. A page in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def facts_in_batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """SC-68. Each key's ids in batches of size, the remainder kept."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    batches = rows.withColumn("place", place).groupBy(by, F.floor(F.col("place") / size).alias("batch"))
    return batches.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda p: p["id"]).alias("ids"))
