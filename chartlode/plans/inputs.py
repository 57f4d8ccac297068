"""Sources over payloads made of the driver's rows, and streams over its event file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlode.operators import storage
from chartlode.plans.views import Register, Tables
from chartlode.sources import readers
from chartlode.streaming import streams

query = Register()


def scratch(t: Tables, name: str) -> str:
    """A new folder that driver and executors see."""
    return storage.shared_path(t.spark, name)


@query("SRC-01", "", "SELECT p_partkey, p_name FROM part")
def src_01(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", "p_name")


@query("SRC-02", "", "SELECT p_partkey AS ordinal, p_name AS name FROM part")
def src_02(t: Tables) -> DataFrame:
    """With SNK-01: what the writer wrote is read again."""
    path = scratch(t, "registry")
    readers.write_registry(t.read("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name")), path, {"source": "part"}, "ordinal")
    return readers.read_registry(t.spark, path, "ordinal long, name string")


def exported(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An export of a task's records in one root element: a file for each task, not for each user, and none held whole."""
    line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
    yield line("<HealthData>")
    yield from records
    yield line("</HealthData>")


@query("SRC-03", "", """SELECT CASE event_type WHEN 'click' THEN 'steps' WHEN 'view' THEN 'spo2' ELSE 'weight' END AS metric, date_trunc('second', ts)::TIMESTAMP AS taken_at, CASE WHEN event_type = 'view' AND round(value, 1) / 100 <= 1 THEN round(round(round(value, 1) / 100 * 100, 6), 1) WHEN event_type = 'view' THEN round(value, 1) / 100 ELSE value END AS value_num FROM events WHERE event_type IN ('click', 'view', 'signup') AND event_id % 7 > 0""")
def src_03(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "HKQuantityTypeIdentifierStepCount").when(F.col("event_type") == "view", "HKQuantityTypeIdentifierOxygenSaturation").when(F.col("event_type") == "signup", "HKQuantityTypeIdentifierBodyMass").otherwise("other")
    value = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_type") == "view", (F.round("value", 1) / 100).cast("string")).otherwise(F.col("value").cast("string"))
    row = F.concat(F.lit('<Record type="'), kind, F.lit('" startDate="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(' +0300" value="'), value, F.lit('"/>'))
    path = scratch(t, "export")
    t.read("events").repartition("event_id").select(row.alias("value")).mapInArrow(exported, "value string").write.text(path)
    return readers.export_records(t.spark, path)


@query("SRC-04", "", """SELECT event_type AS metric, 'u' AS unit, date_trunc('second', ts)::TIMESTAMP AS taken_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value_num, '{"k":"' || (event_id % 9) || '"}' AS value_json FROM events""")
def src_04(t: Tables) -> DataFrame:
    field = F.when(F.col("event_id") % 2 == 0, "qty").otherwise("Avg")
    point = F.map_filter(F.create_map(F.lit("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("k"), (F.col("event_id") % 9).cast("string"), field, F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string"))), lambda k, v: v.isNotNull())
    by = t.read("events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.collect_list(point).alias("data")).select("user_id", F.struct("name", F.lit("u").alias("units"), "data").alias("m"))
    payload = by.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list("m").alias("metrics")).alias("data"))).alias("payload"))
    return readers.pushed_metrics(payload)


@query("SRC-05", "", """WITH d AS (SELECT user_id, ts::DATE AS day, sum(round(value, 0))::DOUBLE AS steps, max(value) AS top, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, 'steps' AS metric, day::TIMESTAMP AS taken_at, steps AS value_num FROM d UNION ALL SELECT user_id, 'body_battery', day::TIMESTAMP, top FROM d UNION ALL SELECT user_id, 'stress', day::TIMESTAMP, (n - 2)::DOUBLE FROM d WHERE n > 2 UNION ALL SELECT user_id, 'heart_rate', date_trunc('millisecond', ts), value FROM events""")
def src_05(t: Tables) -> DataFrame:
    e = t.read("events").withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    day = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(F.array(F.col("ms").cast("double"), "value")).alias("heartRateValues"), F.collect_list(F.struct(F.round("value", 0).cast("double").alias("steps"))).alias("steps"), F.collect_list(F.array(F.lit(0.0), "value")).alias("bodyBattery"), (F.count("*") - 2).cast("double").alias("stress"))
    return readers.wearable_day(day.select("user_id", F.to_json(F.struct("day", "heartRateValues", "steps", "bodyBattery", "stress")).alias("payload")))


@query("SRC-06", "", """SELECT user_id, date_trunc('second', ts)::TIMESTAMP AS taken_at, 'bp_' || m AS metric, (value + k)::DOUBLE AS value_num FROM events, (VALUES ('systolic', 100), ('diastolic', 60), ('pulse', 0)) v(m, k) WHERE event_type = 'view' AND NOT (m = 'pulse' AND event_id % 2 = 0)""")
def src_06(t: Tables) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.struct(F.when(F.col("event_id") % 3 > 0, at).alias("measurementTimestampLocal"), F.when(F.col("event_id") % 3 == 0, at).alias("measurementTimestampGMT"), (F.col("value") + 100).alias("systolic"), (F.col("value") + 60).alias("diastolic"), F.when(F.col("event_id") % 2 > 0, F.col("value")).alias("pulse"))
    payload = t.read("events").where("event_type = 'view'").select("user_id", F.to_json(F.struct(F.array(F.struct(F.array(m).alias("measurements"))).alias("measurementSummaries"))).alias("payload"))
    return readers.blood_pressure(payload)


@query("SRC-07", "", "SELECT user_id, ts::DATE::TIMESTAMP AS taken_at, ((event_id % 90000 + 40005) // 10)::DOUBLE / 100 AS value_num FROM events")
def src_07(t: Tables) -> DataFrame:
    w = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("calendarDate"), (F.col("event_id") % 90_000 + 40_000).cast("double").alias("weight"))
    return readers.weights(t.read("events").select("user_id", F.to_json(F.struct(F.array(w).alias("dateWeightList"))).alias("payload")))


@query("SRC-08", "activities", "SELECT user_id, external_id, activity_type, date_trunc('second', started_at)::TIMESTAMP AS started_at, duration_s, distance_m, avg_hr, calories FROM activities")
def src_08(t: Tables) -> DataFrame:
    a = F.struct(F.col("external_id").alias("activityId"), F.struct(F.col("activity_type").alias("typeKey")).alias("activityType"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("startTimeLocal"), F.col("duration_s").alias("duration"), F.col("distance_m").alias("distance"), F.col("avg_hr").alias("averageHR"), "calories")
    return readers.activity_rows(t.activities().groupBy("user_id").agg(F.to_json(F.collect_list(a)).alias("payload")))


@query("SRC-09", "", "SELECT user_id, ts::DATE::TIMESTAMP AS taken_at, ((event_id % 90000 + 40005) // 10)::DOUBLE / 100 AS value_num FROM events WHERE event_id % 4 > 0")
def src_09(t: Tables) -> DataFrame:
    """A day that doesn't parse gives no rows and stops nothing."""
    w = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("calendarDate"), (F.col("event_id") % 90_000 + 40_000).cast("double").alias("weight"))
    good = F.to_json(F.struct(F.array(w).alias("dateWeightList")))
    return readers.weights(t.read("events").select("user_id", F.when(F.col("event_id") % 4 > 0, good).otherwise("{broken").alias("payload")))


@query("SRC-11", "", "SELECT p_partkey::VARCHAR AS pmid, p_name AS title, 'AIM: ' || p_type || chr(10) || p_brand AS abstract, 'J' AS journal, (2000 + p_size)::VARCHAR AS year FROM part")
def src_11(t: Tables) -> DataFrame:
    tag = lambda name, *inside: F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))
    abstract = F.concat(F.lit('<Abstract><AbstractText Label="AIM">'), "p_type", F.lit("</AbstractText><AbstractText>"), "p_brand", F.lit("</AbstractText></Abstract>"))
    article = tag("Article", tag("ArticleTitle", F.col("p_name")), abstract, tag("Journal", tag("Title", F.lit("J")), tag("JournalIssue", tag("PubDate", tag("Year", (F.col("p_size") + 2000).cast("string"))))))
    return readers.publications(t.read("part").select(F.concat(F.lit("<PubmedArticle>"), tag("MedlineCitation", tag("PMID", F.col("p_partkey").cast("string")), article), F.lit("</PubmedArticle>")).alias("xml")))


@query("SRC-12", "", r"""WITH p AS (SELECT page_id, '<a class="r" href="' || url || '">Own <b>page</b> ' || page_id || '</a><td class="snippet">About &amp; more ' || page_id || '</td>' || html AS html FROM pages),
a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS us, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS ts FROM p),
r AS (SELECT page_id AS id, k AS place, us[k] AS url, ts[k] AS title FROM (SELECT *, unnest(range(1, len(us) + 1)) AS k FROM a)), f AS (SELECT * FROM r WHERE NOT contains(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), 'own.example') QUALIFY row_number() OVER (PARTITION BY id, url ORDER BY place) = 1)
SELECT id, rank, url, CASE WHEN title LIKE 'Own <b>%' THEN 'Own page ' || id ELSE title END AS title, CASE WHEN rank = 1 THEN 'About & more ' || id ELSE '' END AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS rank FROM f) x WHERE x.rank <= 3""")
def src_12(t: Tables) -> DataFrame:
    """Pages with a result in front of their own links."""
    result = F.concat(F.lit('<a class="r" href="'), "url", F.lit('">Own <b>page</b> '), "page_id", F.lit('</a><td class="snippet">About &amp; more '), "page_id", F.lit("</td>"), "html")
    return readers.links(t.read("pages").select("page_id", result.alias("html")), "page_id", "html", "own.example", 3)


@query("SRC-14", "", "SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'cheap' WHEN p_type LIKE 'S%' THEN 'plain' END AS status FROM part")
def src_14(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", readers.sheet_status(F.col("p_type"), {"ECO": "cheap", "S": "plain"}).alias("status"))


@query("SRC-15", "", """WITH l AS (SELECT l_suppkey AS f, l_orderkey AS o, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT concat('f', f) AS file, concat('doc', o) AS doc, round(avg(q), 4) AS tps, sum(n)::DOUBLE AS matched, (9 * count(*))::DOUBLE AS expected FROM l GROUP BY ALL""")
def src_15(t: Tables) -> DataFrame:
    """With SRC-16 and SRC-17."""
    li = t.read("lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("file"), "l_orderkey", "l_linenumber", "l_quantity")
    body = li.select("file", (F.col("l_orderkey") * 10 + 1).alias("line_no"), F.concat(F.lit("[METRICS] tps="), "l_quantity", F.lit(" matched="), "l_linenumber", F.lit("/9")).alias("line"))
    heads = li.select("file", (F.col("l_orderkey") * 10).alias("line_no"), F.concat(F.lit("[E2E] doc"), "l_orderkey").alias("line")).distinct()
    return readers.log_documents(body.unionByName(heads))


#: A run's log for each supplier: what is measured of each order, then the summary in which orders are rows, then failures that look like rows.
SUMMARY_SQL = """WITH l AS (SELECT DISTINCT l_suppkey AS f, l_orderkey AS o FROM lineitem), m AS (SELECT l_suppkey AS f, l_orderkey AS o, round(avg(l_quantity), 4) AS tps, sum(l_linenumber)::DOUBLE AS matched, (9 * count(*))::DOUBLE AS expected FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL)
SELECT concat('f', l.f) AS file, concat('doc', l.o, '.pdf') AS doc, CASE WHEN l.o % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, (l.o % 90)::DOUBLE / 2 AS classify_s, (l.o % 70)::DOUBLE AS extract_s, (l.o % 90)::DOUBLE / 2 + l.o % 70 AS total_s,
CASE WHEN l.o % 4 > 0 THEN (l.o % 4)::DOUBLE / 4 ELSE 0.0 END AS precision, (l.o % 2)::DOUBLE AS recall, coalesce(tps, 0.0) AS tps, coalesce(matched, 0.0) AS matched, coalesce(expected, 0.0) AS expected FROM l LEFT JOIN m USING (f, o)"""


@query("SRC-15b", "", SUMMARY_SQL)
def src_15b(t: Tables) -> DataFrame:
    """The summary table of the same logs; every fifth order was never measured, and what stands after the failures' heading is no row."""
    li = t.read("lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("file"), F.col("l_orderkey").alias("o"), "l_linenumber", "l_quantity")
    # A log is made where its file's order lines are, so that its text needn't be sent there.
    li = li.repartition(max(t.tasks, t.spark.sparkContext.defaultParallelism), "file")
    in_file = Window.partitionBy("file").orderBy("o")
    li = li.select("*", F.row_number().over(in_file).alias("k"), F.lag("o").over(in_file).alias("last"))
    doc, measured, far = F.concat(F.lit("doc"), "o", F.lit(".pdf")), F.col("o") % 5 > 0, 1 << 40
    text = lambda *parts: F.concat(*[F.lit(p) if p[0] in " [" else F.expr(p).cast("string") for p in parts])
    row = F.concat(doc, text(" ", "if(o % 3 = 0, 'FAIL', 'PASS')", "   ", "o % 90 / 2", "'s'", "   ", "o % 70", "'.0s'", "  ", "o % 90 / 2 + o % 70", "'s'", "     ", "if(o % 4 > 0, string(o % 4 / 4), '—')", "     ", "o % 2", "    ", "o % 3"))
    first, once = F.col("k") == 1, (F.col("k") == 1) | ~F.col("o").eqNullSafe(F.col("last"))
    line = lambda when, n, s: F.when(when, F.struct(n.cast("long").alias("line_no"), s.alias("line")))
    frame = ((far - 1, "=== ИТОГОВАЯ СВОДКА E2E ==="), (far, "-----"), (2 * far, "Документов: 9"), (2 * far + 1, "ПРОВАЛЫ"))
    lines = F.array(
        line(once & measured, F.col("o") * 10, F.concat(F.lit("[E2E] "), doc)),
        line(measured, F.col("o") * 10 + 1, text("[METRICS] tps=", "l_quantity", " matched=", "l_linenumber", "'/9'")),
        line(once, F.col("o") + far, F.col("row")),
        line(once, F.col("o") + 3 * far, F.col("row")),
        *[line(first, F.lit(n), F.lit(s)) for n, s in frame],
    )
    lines = li.withColumn("row", F.when(once, row)).select("file", F.explode(lines).alias("x"))
    return readers.log_summary(lines.where("x is not null").select("file", "x.*"))


@query("SRC-18", "", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS power, (event_id % 70)::DOUBLE AS temp FROM events WHERE event_id % 5 > 0")
def src_18(t: Tables) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "[N/A]").otherwise(F.col("value").cast("string")), F.lit(", "), F.col("event_id") % 70, F.when(F.col("event_id") % 5 == 0, ", 1").otherwise(""))
    return readers.telemetry(t.read("events").select("event_id", line.alias("line")), ["power", "temp"])


@query("SRC-18b", "", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS power, (event_id % 70)::DOUBLE AS temp FROM events")
def src_18b(t: Tables) -> DataFrame:
    """The same samples as JSON lines."""
    line = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("power"), (F.col("event_id") % 70).alias("temp"), F.lit(None).cast("string").alias("fan")))
    return readers.telemetry_json(t.read("events").select("event_id", line.alias("line")), ["power", "temp"])


@query("SRC-19", "", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN '.heic' WHEN p_partkey % 5 < 4 THEN '.' || CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' ELSE 'webp' END END AS extension FROM part")
def src_19(t: Tables) -> DataFrame:
    """The name goes first, if its extension is allowed."""
    k = F.col("p_partkey") % 5
    head = F.unhex(F.when(k == 0, "255044462D312E370A0A0A0A").when(k == 1, "FFD8FFE000104A4649460001").when(k == 2, "89504E470D0A1A0A0000000D").when(k == 3, "524946460000000057454250").otherwise("000000000000000000000000"))
    name = F.when(F.col("p_partkey") % 4 == 0, "a.b/Scan.HEIC").when(F.col("p_partkey") % 4 == 1, "notes.txt").when(F.col("p_partkey") % 4 == 2, ".pdf")
    return t.read("part").select("p_partkey", readers.sniff(head).alias("kind"), readers.resolve_extension(name, head, [".pdf", ".jpg", ".png", ".webp", ".heic"]).alias("extension"))


# Streams


def event_stream(t: Tables) -> DataFrame:
    """The event file as a stream of metrics."""
    schema = t.read("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return rows.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "watch").otherwise("phone").alias("provider"), F.col("event_type").alias("metric"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("taken_at"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("value_num"))


@query("STR-01", "metrics", "SELECT user_id, provider, metric, date_trunc('day', taken_at)::TIMESTAMP AS taken_at, arg_max(value_num, event_id) AS value_num FROM metrics GROUP BY ALL")
def str_01(t: Tables) -> DataFrame:
    path = scratch(t, "upserts")
    stream = event_stream(t)
    streams.run_upserts(stream, path, f"{path}-state", streams.METRIC_KEYS, "event_id")
    streams.compact_upserts(t.spark, path, stream.schema, streams.METRIC_KEYS, 0)
    return streams.read_upserts(t.spark, path, stream.schema, streams.METRIC_KEYS).select("user_id", "provider", "metric", F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), "value_num")


def in_parts(t: Tables, df: DataFrame, name: str, n: int = 3) -> DataFrame:
    """df written in n files and streamed, one file a micro-batch."""
    path = scratch(t, name)
    df.repartition(n).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("STR-03", "metrics", """WITH a AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 > 0 THEN TIMESTAMP '2024-01-04 00:00:00' END AS t0, CASE WHEN user_id % 7 > 0 THEN user_id % 30 END AS hours FROM metrics),
b AS (SELECT *, hours IS NOT NULL AND (t0 IS NULL OR t0 + to_hours(hours) <= TIMESTAMP '2024-01-10 00:00:00') AS first FROM a),
c AS (SELECT *, hours IS NOT NULL AND CASE WHEN first THEN TIMESTAMP '2024-01-10 00:00:00' + to_hours(hours) <= TIMESTAMP '2024-01-10 08:00:00' ELSE t0 IS NULL OR t0 + to_hours(hours) <= TIMESTAMP '2024-01-10 08:00:00' END AS second FROM b)
SELECT event_id, 0::BIGINT AS tick FROM metrics JOIN c USING (user_id) WHERE first AND (t0 IS NULL OR taken_at > t0) AND taken_at <= TIMESTAMP '2024-01-10 00:00:00'
UNION ALL SELECT event_id, 1 FROM metrics JOIN c USING (user_id) WHERE second AND CASE WHEN first THEN taken_at > TIMESTAMP '2024-01-10 00:00:00' ELSE t0 IS NULL OR taken_at > t0 END AND taken_at <= TIMESTAMP '2024-01-10 08:00:00'""")
def str_03(t: Tables) -> DataFrame:
    """Two ticks, eight hours apart; some accounts were never synced, some have no interval."""
    path = scratch(t, "ticks")
    for now in ("2024-01-10 00:00:00", "2024-01-10 08:00:00"):
        t.spark.range(1).select(F.lit(now).cast("timestamp_ntz").alias("now")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    ticks = t.spark.readStream.schema("now timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    users = t.metrics().select("user_id").distinct()
    accounts = users.select("user_id", F.when(F.col("user_id") % 5 != 0, F.lit("2024-01-04").cast("timestamp_ntz")).alias("last_sync_at"), F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 30).cast("int")).alias("sync_interval_hours"))
    points = t.metrics().select("user_id", "taken_at", "event_id")
    streams.sync_ticks(ticks, accounts, points, path, f"{path}-state")
    return streams.synced_points(t.spark, path, points.schema).select("event_id", F.col("_batch").alias("tick"))


@query("STR-05", "metrics", """WITH e AS (SELECT user_id AS document_id, taken_at, event_id, CASE event_id % 5 WHEN 0 THEN 'received' WHEN 1 THEN 'recognizing' WHEN 2 THEN 'normalizing' WHEN 3 THEN 'extracted' ELSE 'failed' END AS status FROM metrics),
r AS (SELECT *, CASE status WHEN 'received' THEN 0 WHEN 'recognizing' THEN 1 WHEN 'normalizing' THEN 2 ELSE 3 END AS stage FROM e) SELECT document_id, arg_max(status, (stage, -epoch_us(taken_at))) AS status, max(stage) AS stage FROM r GROUP BY 1""")
def str_05(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, "received").when(k == 1, "recognizing").when(k == 2, "normalizing").when(k == 3, "extracted").otherwise("failed")
    path = scratch(t, "status")
    events = in_parts(t, t.metrics().select(F.col("user_id").alias("document_id"), F.col("taken_at").alias("at"), status.alias("status")), "events")
    streams.run_status(events, path, f"{path}-state")
    return streams.read_status(t.spark, path, events).select("document_id", "status", "stage")


@query("STR-06", "metrics", "SELECT metric AS queue, event_id AS id, row_number() OVER (PARTITION BY metric ORDER BY taken_at, event_id) AS place FROM metrics WHERE user_id % 4 = 0")
def str_06(t: Tables) -> DataFrame:
    jobs = t.metrics().select(F.col("metric").alias("queue"), F.col("event_id").alias("id"), F.col("taken_at").alias("enqueued_at"), F.when(F.col("user_id") % 4 == 0, "waiting").otherwise("done").alias("state"))
    return streams.queue_places(jobs).select("queue", "id", "place")


@query("STR-09", "docs", """WITH RECURSIVE d AS (SELECT user_id, id, id % 5 AS n, file_sha256 AS s, doc_type || '|' || title || '|' || coalesce(clinic, '') AS f, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k FROM docs),
st AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::STRUCT(id BIGINT, n BIGINT, s VARCHAR, f VARCHAR)[] AS live FROM d
UNION ALL SELECT user_id, k, CASE WHEN old IS NULL THEN list_append(live, me) WHEN me.n >= old.n THEN list_append(list_filter(live, lambda x: x.id <> old.id), me) ELSE live END
FROM (SELECT st.user_id, d.k, live, {'id': d.id, 'n': d.n, 's': d.s, 'f': d.f} AS me, list_sort(list_filter(live, lambda x: x.s = d.s OR x.f = d.f))[1] AS old FROM st JOIN d ON d.user_id = st.user_id AND d.k = st.k + 1)),
l AS (SELECT user_id, unnest(live) AS x FROM (SELECT user_id, arg_max(live, k) AS live FROM st GROUP BY 1)),
r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT user_id, x.id AS id, coalesce(r.n, 0) AS lab_rows FROM l LEFT JOIN r ON r.id = x.id""")
def str_09(t: Tables) -> DataFrame:
    """The documents that are left, with the results that stay with them."""
    path = scratch(t, "survivors")
    documents = t.documents().select("user_id", "id", "doc_type", "title", "clinic", "file_sha256", (F.col("id") % 5).alias("n_rows"))
    streams.run_survivors(in_parts(t, documents, "documents", 1), path, f"{path}-state")
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lab_rows"))
    return streams.read_survivors(t.spark, path).join(rows, "id", "left").select("user_id", "id", F.coalesce("lab_rows", F.lit(0)).alias("lab_rows"))


@query("STR-04", "metrics", """WITH s AS (SELECT metric, value_num AS v, row_number() OVER (PARTITION BY metric ORDER BY event_id) AS k, count(*) OVER (PARTITION BY metric) AS n FROM metrics WHERE value_num IS NOT NULL)
SELECT metric, round(sum(v * pow(0.7::DOUBLE, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.3::DOUBLE END), 6) AS ema, max(n) AS samples FROM s GROUP BY metric""")
def str_04(t: Tables) -> DataFrame:
    path, stream = scratch(t, "ema"), event_stream(t)
    streams.run_ema(stream, path, f"{path}-state", "metric", "value_num", ["event_id"])
    return streams.read_ema(t.spark, path, stream.schema, "metric").withColumn("ema", F.round("ema", 6))


@query("STR-07", "metrics", "SELECT DISTINCT user_id AS document_id FROM metrics")
def str_07(t: Tables) -> DataFrame:
    """Each document is claimed again in later batches."""
    path = scratch(t, "claims")
    claims = in_parts(t, t.metrics().select(F.col("user_id").alias("document_id"), F.col("taken_at").alias("at")), "claimed")
    streams.run_claims(claims, path, f"{path}-state", "document_id", "at")
    return streams.read_claims(t.spark, path, claims.schema).select("document_id")


@query("STR-10", "metrics", "SELECT time_bucket(INTERVAL 1 DAY, taken_at)::TIMESTAMP AS from_at, metric, count(*) AS n FROM metrics GROUP BY ALL")
def str_10(t: Tables) -> DataFrame:
    """Beyond the inventory: daily windows in complete mode, so that no window is left open at the end."""
    path = scratch(t, "windows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:06d}")

    streams.windowed(event_stream(t), "at", "tumbling", "1 day").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{path}/*").withColumn("file", F.input_file_name())
    latest = F.regexp_extract("file", r"/(\d{6})/[^/]*$", 1)
    last = rows.agg(F.max(latest)).first()[0]
    return t.spark.read.parquet(f"{path}/{last}").select(F.col("from_at").cast("timestamp_ntz").alias("from_at"), "metric", "n")
