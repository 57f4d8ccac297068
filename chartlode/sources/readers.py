"""Readers: files and payloads of devices, registries and logs into rows.

What a vendor's service sends is parsed by Spark's JSON and XML functions with explicit schemas; fetching it is not a part of this
library. A payload that doesn't parse gives no rows and stops nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Record types of a health export and the metrics that they are.
EXPORT_METRICS = {
    "HKQuantityTypeIdentifierHeartRate": "heart_rate",
    "HKQuantityTypeIdentifierRestingHeartRate": "resting_hr",
    "HKQuantityTypeIdentifierStepCount": "steps",
    "HKQuantityTypeIdentifierOxygenSaturation": "spo2",
    "HKQuantityTypeIdentifierBodyMass": "weight",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": "hrv",
    "HKQuantityTypeIdentifierBloodPressureSystolic": "bp_systolic",
    "HKQuantityTypeIdentifierBloodPressureDiastolic": "bp_diastolic",
}


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02. JSON lines without blank ones and without those that hold _meta."""
    return spark.read.schema(f"{schema}, _meta string").json(path).where("_meta is null").drop("_meta").na.drop("all")


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03, STR-08. Record elements of an unpacked XML export, split over tasks by the source."""
    schema = "_type string, _startDate string, _value string"
    return mapped_records(spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path).select(F.col("_type").alias("type"), F.col("_startDate").alias("start"), F.col("_value").alias("value")))


def mapped_records(records: DataFrame) -> DataFrame:
    """SRC-03. Rows of known types with a number: metric, taken_at, value_num; oxygen as a fraction becomes percent."""
    names = F.create_map(*[F.lit(x) for pair in EXPORT_METRICS.items() for x in pair])
    out = records.select(F.try_element_at(names, F.col("type")).alias("metric"), F.try_to_timestamp(F.substring(F.translate("start", "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("taken_at"), F.col("value").try_cast("double").alias("v"))
    percent = F.when((F.col("metric") == "spo2") & (F.col("v") <= 1), F.round(F.col("v") * 100, 1)).otherwise(F.col("v"))
    return out.where("metric is not null and v is not null and taken_at is not null").select("metric", "taken_at", percent.alias("value_num"))


def pushed_metrics(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-04, STR-02. Points of `{data: {metrics: [{name, units, data: [{date, qty, Avg, ..}]}]}}`, sleep hours as seconds, other fields as JSON."""
    point = "map<string,string>"
    parsed = payloads.select(F.from_json(column, f"struct<data:struct<metrics:array<struct<name:string,units:string,data:array<{point}>>>>>").alias("j"))
    m = parsed.select(F.explode("j.data.metrics").alias("m")).select(F.col("m.name").alias("metric"), F.col("m.units").alias("unit"), F.explode("m.data").alias("p"))
    value = F.coalesce(F.col("p")["qty"], F.col("p")["Avg"], F.col("p")["avg"]).try_cast("double")
    rest = F.map_filter("p", lambda k, v: ~k.isin("date", "qty", "Avg", "avg"))
    taken = F.try_to_timestamp(F.substring(F.translate(F.col("p")["date"], "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return m.select("metric", "unit", taken.alias("taken_at"), F.when(F.col("metric") == "sleep_analysis", value * 3600).otherwise(value).alias("value_num"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("value_json")).where("taken_at is not null")


def wearable_day(days: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-05. Metrics of a day's payload: resting rate, rate series, summed steps, sleep seconds, stress over 0, highest body battery, HRV."""
    schema = "struct<day:string,restingHeartRate:double,heartRateValues:array<array<double>>,steps:array<struct<steps:double>>,sleepSeconds:double,stress:double,bodyBattery:array<array<double>>,hrv:double>"
    d = days.select("user_id", F.from_json(column, schema).alias("d")).select("user_id", "d.*")
    noon = F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    one = lambda name, v, at=noon: F.struct(F.lit(name).alias("metric"), at.alias("taken_at"), v.cast("double").alias("value_num"))
    single = F.array(one("resting_hr", F.col("restingHeartRate")), one("steps", F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.coalesce(x["steps"], F.lit(0.0)))), one("sleep", F.col("sleepSeconds")), one("stress", F.when(F.col("stress") > 0, F.col("stress"))), one("body_battery", F.array_max(F.transform("bodyBattery", lambda x: F.get(x, F.lit(1))))), one("hrv", F.col("hrv")))
    series = F.transform(F.coalesce("heartRateValues", F.array().cast("array<array<double>>")), lambda x: one("heart_rate", F.get(x, F.lit(1)), F.timestamp_millis(F.get(x, F.lit(0)).cast("long")).cast("timestamp_ntz")))
    return d.select("user_id", F.inline(F.concat(single, series))).where("value_num is not null and taken_at is not null")


def blood_pressure(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-06. Three metrics of each measurement, at its local time or else GMT."""
    m = "struct<measurementTimestampLocal:string,measurementTimestampGMT:string,systolic:double,diastolic:double,pulse:double>"
    rows = payloads.select("user_id", F.explode(F.flatten(F.transform(F.from_json(column, f"struct<measurementSummaries:array<struct<measurements:array<{m}>>>>")["measurementSummaries"], lambda s: s["measurements"]))).alias("m"))
    at = F.try_to_timestamp(F.substring(F.translate(F.coalesce("m.measurementTimestampLocal", "m.measurementTimestampGMT"), "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    three = F.array(*[F.struct(F.lit(f"bp_{n}").alias("metric"), F.col(f"m.{n}").alias("value_num")) for n in ("systolic", "diastolic", "pulse")])
    return rows.select("user_id", at.alias("taken_at"), F.inline(three)).where("value_num is not null")


def weights(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-07. Grams as kilograms, to ten grams, five of them up."""
    rows = payloads.select("user_id", F.explode(F.from_json(column, "struct<dateWeightList:array<struct<calendarDate:string,weight:double>>>")["dateWeightList"]).alias("w"))
    return rows.select("user_id", F.try_to_timestamp("w.calendarDate", F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("taken_at"), F.round(F.col("w.weight") / 1000, 2).alias("value_num")).where("value_num is not null")


def activity_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-08, SRC-10. Typed activities of a list, of any page."""
    rows = payloads.select("user_id", F.explode(F.from_json(column, "array<struct<activityId:string,activityType:struct<typeKey:string>,startTimeLocal:string,duration:double,distance:double,averageHR:double,calories:double>>")).alias("a"))
    at = F.try_to_timestamp(F.substring(F.translate("a.startTimeLocal", "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return rows.select("user_id", F.col("a.activityId").alias("external_id"), F.col("a.activityType.typeKey").alias("activity_type"), at.alias("started_at"), F.col("a.duration").alias("duration_s"), F.col("a.distance").alias("distance_m"), F.col("a.averageHR").alias("avg_hr"), F.col("a.calories").alias("calories"))


def paged_activities(pages: DataFrame, most: int = 3) -> DataFrame:
    """SRC-10. Activities of the first pages (from 1) of each user, up to the first empty one. pages: user_id, page, payload."""
    before = Window.partitionBy("user_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    empty = F.coalesce(F.json_array_length("payload"), F.lit(0)) == 0
    kept = pages.where(F.col("page") <= most).withColumn("ended", F.max(empty).over(before)).where("not ended")
    return activity_rows(kept)


def publications(xml: DataFrame, column: str = "xml") -> DataFrame:
    """SRC-11. pmid, title, abstract (labelled sections by lines), journal, year of each article."""
    schema = "struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>>>>"
    c = F.from_xml(F.col(column), schema)["MedlineCitation"]
    parts = F.transform(c["Article"]["Abstract"]["AbstractText"], lambda s: F.concat(F.coalesce(F.concat(s["_Label"], F.lit(": ")), F.lit("")), F.coalesce(s["_VALUE"], F.lit(""))))
    return xml.select(c["PMID"].alias("pmid"), c["Article"]["ArticleTitle"].alias("title"), F.array_join(parts, "\n").alias("abstract"), c["Article"]["Journal"]["Title"].alias("journal"), c["Article"]["Journal"]["JournalIssue"]["PubDate"]["Year"].alias("year"))


def links(pages: DataFrame, id_col: str, html_col: str, own: str, first: int, snippet: str = "snippet") -> DataFrame:
    """SRC-12. The first links of a page with title and snippet, each URL once, none whose host has own in its name.

    The k-th link that is left gets the k-th element of the class snippet, '' where there are fewer."""
    from chartlode.functions.text import plain_html

    pattern = r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2)).alias("title"))
    texts = F.regexp_extract_all(html_col, F.lit(rf"""(?s)<(?:td|div|p|span)[^>]*class=['"][^'"]*{snippet}[^'"]*['"][^>]*>(.*?)</(?:td|div|p|span)>"""), F.lit(1))
    host = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), texts.alias("_texts"), F.posexplode(pairs).alias("place", "x")).select("id", "_texts", "place", "x.url", "x.title").where(~F.contains(host, F.lit(own)))
    once = rows.groupBy("id", "url").agg(F.min("place").alias("place"), F.min_by("title", "place").alias("title"), F.first("_texts").alias("_texts"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return once.withColumn("rank", rank).where(F.col("rank") <= first).select("id", "rank", "url", plain_html(F.col("title")).alias("title"), plain_html(F.coalesce(F.get("_texts", F.col("rank") - 1), F.lit(""))).alias("snippet"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13. JSON files of expected results, with their names; person fields aren't read."""
    schema = "doc_type string, clinic string, title string, visit_date string, doctor_name string, diagnosis string, recommendations array<string>, medications array<string>, analytes array<struct<name:string,value:string,value_text:string,unit:string,ref_low:double,ref_high:double,ref_op:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def sheet_status(sheet: Column, statuses: dict[str, str]) -> Column:
    """SRC-14. The status of the first prefix that a sheet's name has."""
    out = F.lit(None).cast("string")
    for prefix, status in reversed(statuses.items()):
        out = F.when(sheet.startswith(prefix), status).otherwise(out)
    return out


def log_lines(lines: DataFrame, *more: Column) -> DataFrame:
    """What each line of a log says (its tokens a second, matched and expected, and more), and doc, the document of the last header `[E2E] name` up to it."""
    # A pattern is only tried where its fixed part stands.
    found = lambda fixed, pattern, k=1: F.when(F.col("line").contains(fixed), F.regexp_extract("line", pattern, k))
    num = lambda *of: found(*of).try_cast("double")
    matched = r"matched=([0-9]+)/([0-9]+)"
    said = lines.select("file", "line_no", F.nullif(found("[E2E]", r"\[E2E\]\s+(\S+)"), F.lit("")).alias("doc"), num("tps=", r"tps=([0-9.]+)").alias("tps"), num("matched=", matched).alias("m"), num("matched=", matched, 2).alias("e"), *more)
    return said.withColumn("doc", F.last("doc", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def log_documents(lines: DataFrame) -> DataFrame:
    """SRC-15 to SRC-17. Per file and document header `[E2E] name`: tokens a second and matched of expected of the lines under it. lines: file, line_no, line."""
    return log_lines(lines).where("doc is not null").groupBy("file", "doc").agg(F.round(F.avg("tps"), 4).alias("tps"), F.sum("m").alias("matched"), F.sum("e").alias("expected"))


#: Fixed values of the benchmark's output: the summary's heading, the heading of what follows it, and the outcomes of a document.
SUMMARY, FAILURES, OUTCOMES = "ИТОГОВАЯ СВОДКА E2E", "ПРОВАЛЫ", ("PASS", "FAIL", "SKIP")


def log_summary(lines: DataFrame) -> DataFrame:
    """SRC-15. Rows of a file's summary table, between its heading and the list of failures: name, status, three times, precision and recall
    (0.0 for what is no number), with the document's rate and matches from the lines above (0 for a document without any).

    A row is eight fields: a name with a dot, an outcome, three seconds `1.5s`, and three more. Lines meet once, by file: where the table begins
    and ends is told by the lines up to each, and rows find their document's measures within the file. Lines without number or text are in no table."""

    def fields(part: Column) -> Column:
        at = lambda k: F.get(part, F.lit(k))
        seconds = lambda k: F.when(at(k).rlike(r"^[0-9.]+s$"), F.rtrim(at(k), F.lit("s")).try_cast("double"))
        share = lambda k: F.coalesce(at(k).try_cast("double"), F.lit(0.0))
        return F.struct(at(0).alias("doc"), at(1).alias("status"), *[seconds(k).alias(c) for k, c in enumerate(("classify_s", "extract_s", "total_s"), 2)], share(5).alias("precision"), share(6).alias("recall"), at(7).isNotNull().alias("ends"))

    looks = reduce(lambda a, b: a | b, [F.col("line").contains(x) for x in OUTCOMES]) & F.col("line").rlike(r"^\s*\S+\.\S+\s+(?:" + "|".join(OUTCOMES) + r")\s")
    said = log_lines(lines, F.col("line").contains(SUMMARY).alias("heads"), F.col("line").startswith(FAILURES).alias("fails"), F.when(looks, F.col("line")).alias("line"))
    so_far = Window.partitionBy("file").orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("_from", F.min(F.when(F.col("heads"), F.col("line_no"))).over(so_far))
    said = said.withColumn("_to", F.min(F.when(F.col("fails") & (F.col("line_no") > F.col("_from")), F.col("line_no"))).over(so_far))
    inside = F.expr("line is not null and file is not null and line_no > _from and _to is null")
    said = said.withColumn("part", F.when(inside, F.split(F.trim("line"), r"\s+"))).withColumn("row", F.when(F.col("part").isNotNull(), fields(F.col("part"))))
    listed = F.expr("row.classify_s is not null and row.extract_s is not null and row.total_s is not null and row.ends")
    measured = F.expr("doc is not null and coalesce(tps, m, e) is not null")
    none = lambda c: F.lit(None).cast(said.schema[c].dataType).alias(c)
    parts = F.array(F.when(measured, F.struct("doc", "tps", "m", "e", none("row"))), F.when(listed, F.struct(F.col("row.doc").alias("doc"), none("tps"), none("m"), none("e"), "row")))
    parts = said.select("file", F.explode(parts).alias("p")).where("p is not null").select("file", "p.*")
    own = Window.partitionBy("file", "doc")
    sums = {"tps": F.round(F.avg("tps").over(own), 4), "matched": F.sum("m").over(own), "expected": F.sum("e").over(own)}
    out = parts.select("file", "doc", "row", *[c.alias(n) for n, c in sums.items()]).where("row is not null")
    rows = [f"row.{c}" for c in ("status", "classify_s", "extract_s", "total_s", "precision", "recall")]
    return out.select("file", "doc", *rows, *sums).na.fill(0, list(sums))


def telemetry(lines: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-18. CSV samples with N/A as null; lines of another number of fields are left out."""
    fields = F.transform(F.split("line", ","), lambda s: F.trim(s))
    ok = lines.where(F.size(F.split("line", ",")) == len(columns))
    return ok.select(*[c for c in lines.columns if c != "line"], *[F.get(fields, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(columns)])


def telemetry_json(lines: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-18. Samples of JSON objects, a line each; what is no number is null, and a line that is no object is an error."""
    one = F.from_json("line", F.lit("map<string,string>"))
    checked = lines.select(*[c for c in lines.columns if c != "line"], F.when(F.col("line").rlike(r"^\s*\{") & one.isNotNull(), one).otherwise(F.raise_error(F.lit("a telemetry line must be a JSON object"))).alias("_sample"))
    return checked.select(*[c for c in checked.columns if c != "_sample"], *[F.try_element_at("_sample", F.lit(c)).try_cast("double").alias(c) for c in columns])


def resolve_extension(name: Column, content: Column, allowed: list[str]) -> Column:
    """SRC-19. The extension of the file's name if it is an allowed one, else that of its first bytes, null if neither is."""
    named = F.concat(F.lit("."), F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]\.([^./]+)$", 1)))
    return F.when(named.isin(*allowed), named).otherwise(F.concat(F.lit("."), sniff(content)))


def sniff(content: Column) -> Column:
    """SRC-19. Kind of a file by its first bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "68656978", "6D696631", "68657663"), "heic")


def write_registry(df: DataFrame, path: str, meta: dict[str, str], key: str) -> None:
    """SNK-01. JSON lines in the key's order, the first of which is the source's description: {"_meta": {..}}.

    Files are named in order; a registry's are few, as a range of keys is at least as large as the session's partitions are."""
    records = df.select(F.lit(1).alias("_o"), F.col(key).alias("_k"), F.to_json(F.struct("*")).alias("value"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("_o"), F.lit(None).cast(df.schema[key].dataType).alias("_k"), F.to_json(F.struct(F.create_map(*[F.lit(x) for pair in meta.items() for x in pair]).alias("_meta"))).alias("value"))
    first.unionByName(records).orderBy("_o", "_k").select("value").write.mode("overwrite").text(path)
