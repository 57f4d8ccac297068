"""Registries, files that are written and read again, pushed payloads, and lines of forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.functions import tables
from chartlode.operators import extractors, filters, ordered, parse, registry, scoring
from chartlode.plans import inputs, matching, parsing
from chartlode.plans.views import Register, Tables
from chartlode.sources import paged, readers

query = Register()
#: Buckets of a paged export: tasks that read it.
BUCKETS = 96


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as text, apart by bars."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


@query("AGG-18", "", """WITH r AS (SELECT p_partkey AS ordinal, p_name AS name, lower(p_name) AS k, p_type AS s, p_brand AS u FROM part WHERE p_partkey % 11 > 0),
s AS (SELECT k, s, min(ordinal) AS o FROM r GROUP BY ALL), u AS (SELECT k, u, min(ordinal) AS o FROM r GROUP BY ALL)
SELECT k AS key, name, analyte_group, synonyms, units FROM (SELECT k, arg_min(name, ordinal) AS name, arg_min(u, ordinal) AS analyte_group FROM r GROUP BY k)
JOIN (SELECT k, string_agg(s, '|' ORDER BY o, s) AS synonyms FROM s GROUP BY k) USING (k) JOIN (SELECT k, string_agg(u, '|' ORDER BY o, u) AS units FROM u GROUP BY k) USING (k)""")
def agg_18(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 11 == 0, "; other").otherwise(""))
    rows = t.read("part").select(F.col("p_partkey").alias("ordinal"), name.alias("name"), F.array("p_type").alias("synonyms"), F.array("p_brand", "p_brand").alias("units"), F.col("p_brand").alias("analyte_group"))
    return joined(registry.analyte_registry(rows), "synonyms", "units")


@query("AGG-19", "", "SELECT p_name AS name, min(p_partkey) AS ordinal, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def agg_19(t: Tables) -> DataFrame:
    return registry.first_records(t.read("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("brand"))).drop("key")


@query("AGG-20", "", """WITH r AS (SELECT p_partkey AS o, p_name AS name, 'trade' AS type, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS mnn, p_brand AS status, 'R' || (p_partkey % 20) AS reg FROM part
UNION ALL SELECT p_partkey, p_type, 'mnn', NULL, p_brand, 'R' || (p_partkey % 20) FROM part WHERE p_partkey % 3 > 0)
SELECT lower(name) AS key, arg_min(name, o) AS name, string_agg(DISTINCT type, '|' ORDER BY type) AS types, string_agg(DISTINCT status, '|' ORDER BY status) AS statuses, string_agg(DISTINCT reg, '|' ORDER BY reg) AS reg_numbers, arg_max(mnn, o) FILTER (WHERE mnn IS NOT NULL) AS mnn FROM r GROUP BY 1""")
def agg_20(t: Tables) -> DataFrame:
    rows = t.read("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("trade"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_type")).alias("mnn"), F.col("p_brand").alias("status"), F.concat(F.lit("R"), F.col("p_partkey") % 20).alias("reg_number"))
    return joined(registry.drug_registry(rows), "types", "statuses", "reg_numbers")


@query("SNK-01", "", "SELECT row_number() OVER (ORDER BY p_partkey) AS line_no, p_partkey AS ordinal FROM part UNION ALL SELECT 0, NULL")
def snk_01(t: Tables) -> DataFrame:
    """The file's lines as a reader meets them: what _meta says first, then the records in order."""
    path = inputs.scratch(t, "sink")
    readers.write_registry(t.read("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name")), path, {"source": "part"}, "ordinal")
    lines = t.spark.read.schema("ordinal long, _meta map<string,string>").json(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    by_file = ordered.Window.partitionBy(F.lit(0)).orderBy("file", "at")  # a registry is one person's file: some thousand records
    return lines.select((F.row_number().over(by_file) - 1).cast("long").alias("line_no"), "ordinal")


@query("SRC-10", "activities", """WITH n AS (SELECT user_id, external_id, (row_number() OVER (PARTITION BY user_id ORDER BY external_id) - 1) // 2 + 1 AS page FROM activities)
SELECT user_id, external_id FROM n WHERE page <= 3 AND NOT (user_id % 2 = 0 AND page > 1)""")
def src_10(t: Tables) -> DataFrame:
    """Pages of two activities, as a fetcher leaves them; the second page of every other user is empty."""
    path = inputs.scratch(t, "pages")
    place = F.row_number().over(ordered.Window.partitionBy("user_id").orderBy("external_id")) - 1
    page = t.activities().withColumn("page", F.floor(place / 2).cast("int") + 1).where("page <= 3").groupBy("user_id", "page").agg(F.to_json(F.collect_list(F.struct(F.col("external_id").alias("activityId")))).alias("payload"))
    page = page.withColumn("payload", F.when((F.col("user_id") % 2 == 0) & (F.col("page") == 2), "[]").otherwise(F.col("payload")))
    dealt = page.select("*", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "user_id", "page")
    dealt.select(F.to_json(F.struct("user_id", "page", "payload")).alias("value"), "bucket").write.partitionBy("bucket").text(path)
    t.spark.dataSource.register(paged.PagedActivities)
    return t.spark.read.format("paged_activities").option("path", path).load().where("error is null").select("user_id", "external_id")


@query("SRC-13", "", "SELECT 'analysis' AS doc_type, n_name AS clinic, 1 AS analytes FROM nation")
def src_13(t: Tables) -> DataFrame:
    path = inputs.scratch(t, "sidecars")
    analyte = F.struct(F.lit("x").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    body = F.to_json(F.struct(F.lit("analysis").alias("doc_type"), F.col("n_name").alias("clinic"), F.array(analyte).alias("analytes")))
    t.read("nation").select("n_nationkey", body.alias("value")).write.partitionBy("n_nationkey").text(path)
    return readers.sidecars(t.spark, path).select("doc_type", "clinic", F.size("analytes").alias("analytes"))


@query("SRC-16", "", "SELECT concat('f', l_suppkey) AS file, concat('doc', l_orderkey) AS doc, round(avg(l_quantity), 4) AS tps FROM lineitem GROUP BY ALL")
def src_16(t: Tables) -> DataFrame:
    return inputs.src_15(t).select("file", "doc", "tps")


@query("SRC-17", "", "SELECT concat('f', l_suppkey) AS file, concat('doc', l_orderkey) AS doc, sum(l_linenumber)::DOUBLE AS matched, (9 * count(*))::DOUBLE AS expected FROM lineitem GROUP BY ALL")
def src_17(t: Tables) -> DataFrame:
    return inputs.src_15(t).select("file", "doc", "matched", "expected")


@query("STR-02", "", "SELECT event_type AS metric, date_trunc('second', ts)::TIMESTAMP AS taken_at, value AS value_num FROM events")
def str_02(t: Tables) -> DataFrame:
    """Pushed payloads arrive as lines of files; each trigger takes what is new, as STR-03's tick does."""
    path = inputs.scratch(t, "pushed")
    point = F.create_map(F.lit("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("qty"), F.col("value").cast("string"))
    metric = F.struct(F.col("event_type").alias("name"), F.lit("u").alias("units"), F.array(point).alias("data"))
    t.read("events").select(F.to_json(F.struct(F.struct(F.array(metric).alias("metrics")).alias("data"))).alias("value")).write.text(f"{path}/in")
    stream = readers.pushed_metrics(t.spark.readStream.text(f"{path}/in"), "value").select("metric", "taken_at", "value_num")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("STR-08", "", "SELECT CASE event_type WHEN 'click' THEN 'steps' WHEN 'view' THEN 'spo2' ELSE 'weight' END AS metric, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'signup') AND event_id % 7 > 0 GROUP BY 1")
def str_08(t: Tables) -> DataFrame:
    """Counts over the export of SRC-03, whose records the source splits over tasks and never holds whole."""
    return inputs.src_03(t).groupBy("metric").agg(F.count("*").alias("n"))


@query("PRS-07", "raw", "SELECT id AS doc_id, count(*) * CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END AS n FROM raw GROUP BY id")
def prs_07(t: Tables) -> DataFrame:
    from chartlode.plans.parsing import layer

    return parse.text_lines(layer(t)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("PRS-08", "raw", "SELECT id AS doc_id, concat('1', lpad((id % 900)::VARCHAR, 3, '0'), ' - 2', lpad((id % 800)::VARCHAR, 3, '0')) AS ref_raw FROM raw")
def prs_08(t: Tables) -> DataFrame:
    line = "concat('Клетки ', id % 90, ' г/л 1 ', lpad(CAST(id % 900 AS STRING), 3, '0'), ' - 2 ', lpad(CAST(id % 800 AS STRING), 3, '0'))"
    return parse.text_lines(t.raw().select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.expr(line).alias("line"))).select("doc_id", "ref_raw")


@query("PRS-09", "raw", "SELECT id AS doc_id, CASE WHEN id % 3 > 0 THEN 'мг / л' END AS unit, CASE id % 3 WHEN 0 THEN '5-9' WHEN 1 THEN '<7' ELSE concat(id % 30, ' - 40') END AS ref_raw FROM raw")
def prs_09(t: Tables) -> DataFrame:
    tail = "CASE id % 3 WHEN 0 THEN '5-9' WHEN 1 THEN 'мг / л < 7' ELSE concat('мг / л ', id % 30, ' - 40') END"
    return parse.text_lines(t.raw().select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.expr(f"concat('Белок 3,5 ', {tail})").alias("line"))).select("doc_id", "unit", "ref_raw")


@query("SC-63", "", "SELECT p_partkey AS doc_id, 0 AS ordinal, p_name AS analyte_name, p_size::VARCHAR AS value_raw, NULL::VARCHAR AS unit, concat('1 - ', p_size) AS ref_raw FROM part")
def sc_63(t: Tables) -> DataFrame:
    """Keys that tell nothing: the fields are told by their looks."""
    row = F.struct(F.concat(F.lit("1 - "), "p_size").alias("a"), F.col("p_size").cast("string").alias("b"), F.col("p_name").alias("c"))
    return parse.harvest(t.read("part").select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.array(row).alias("z"))).alias("payload")))


TORN = "SELECT p_partkey AS doc_id, 0 AS ordinal, p_name AS analyte_name, '5' AS value_raw FROM part UNION ALL SELECT p_partkey, 1, p_brand, '6' FROM part"


@query("SC-64", "", TORN)
def sc_64(t: Tables) -> DataFrame:
    payload = F.concat(F.lit('{"rows": [{"name": "'), "p_name", F.lit('", "value": "5"}, {"name": "'), "p_brand", F.lit('", "value": "6"'))
    return parse.harvest(t.read("part").select(F.col("p_partkey").alias("doc_id"), payload.alias("payload"))).drop("unit", "ref_raw")


@query("PRS-21", "", TORN)
def prs_21(t: Tables) -> DataFrame:
    """A model's answer that stops in the middle of its third row's name."""
    payload = F.concat(F.lit('[{"name": "'), "p_name", F.lit('", "value": "5"}, {"name": "'), "p_brand", F.lit('", "value": "6"}, {"name": "'))
    return parse.harvest(t.read("part").select(F.col("p_partkey").alias("doc_id"), payload.alias("payload"))).drop("unit", "ref_raw").where("analyte_name <> ''")


@query("MSC-06", "", "SELECT p_partkey AS doc_id, p_name AS analyte_name, p_size::VARCHAR AS value_raw FROM part")
def msc_06(t: Tables) -> DataFrame:
    row = F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("value"))
    payload = F.to_json(F.struct(F.array(row).alias("a"), F.struct(F.array(row, row).alias("c")).alias("b")))
    found = parse.harvest(t.read("part").select(F.col("p_partkey").alias("doc_id"), payload.alias("payload")))
    return ordered.first_of(found, [F.col("doc_id"), F.col("analyte_name"), F.col("value_raw")], [F.col("ordinal")]).select("doc_id", "analyte_name", "value_raw")


@query("EVL-04", "", "SELECT event_id AS evidence_id, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'wrong' ELSE 'ok' END AS verdict FROM events")
def evl_04(t: Tables) -> DataFrame:
    facts = t.read("events").select(F.col("event_id").alias("evidence_id"), F.col("value").alias("v"))
    said = facts.where("evidence_id % 5 > 0").withColumn("v", F.col("v") + F.when(F.col("evidence_id") % 7 == 0, 0.5).otherwise(1e-9))
    return scoring.audited(facts, said, "v")


@query("EVL-10", "labs reports", """SELECT 'labs' AS domain, user_id, id, 0 AS part FROM labs WHERE (ref_low IS NOT NULL OR ref_high IS NOT NULL) AND (value_num < coalesce(ref_low, -1e18) OR value_num > coalesce(ref_high, 1e18)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) <= 20
UNION ALL SELECT 'reports', user_id, id, 0 FROM reports QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) <= 20
UNION ALL SELECT 'medications', user_id, id, part FROM (SELECT user_id, id, unnest(range(0, len(medications)))::INT AS part FROM reports) m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id, part) <= 20""")
def evl_10(t: Tables) -> DataFrame:
    """The first 20 findings of each kind of a user."""
    first = lambda df, name: ordered.latest(df, ["user_id"], [F.asc("id"), F.asc("part")], 20).select(F.lit(name).alias("domain"), "user_id", "id", "part")
    labs = t.labs().where(filters.out_of_reference()).select("user_id", "id", F.lit(0).alias("part"))
    reports = t.reports()
    lists = reports.select("user_id", "id", F.posexplode("medications").alias("part", "line"))
    return first(labs, "labs").unionByName(first(reports.withColumn("part", F.lit(0)), "reports")).unionByName(first(lists, "medications"))


@query("UDF-03", "", f"WITH r AS ({matching.NAMES}), q AS (SELECT DISTINCT lower(raw) AS query FROM ({matching.TYPOS})), m AS ({matching.floored_sql('x', 0.35, 75, 3)}) SELECT id, raw, status, key, record FROM ({matching.TYPOS}) JOIN m ON query = lower(raw)")
def udf_03(t: Tables) -> DataFrame:
    return extractors.ANALYTES.resolve(matching.typos(t), matching.registry(t)).select("id", "raw", "status", "key", "record")


@query("UDF-04", "", "SELECT l_orderkey AS document_id, 'analysis' AS doc_type, l_quantity::VARCHAR AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'doctor_report', o_orderstatus FROM orders WHERE o_orderkey % 3 = 1")
def udf_04(t: Tables) -> DataFrame:
    """Analyses have their results, reports their verdict; a third of the documents is of no known type."""
    known = extractors.Extractors()
    known.register("analysis")(lambda d: d.join(t.read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("document_id"), F.col("l_quantity").cast("string").alias("value")))
    known.register("doctor_report")(lambda d: d.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("value")))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "analysis").when(F.col("o_orderkey") % 3 == 1, "doctor_report").otherwise("letter")
    return known.run(t.read("orders").withColumn("doc_type", kind)).select("document_id", "doc_type", "value")


@query("UDF-05", "", parsing.query.oracles["SC-62"])
def udf_05(t: Tables) -> DataFrame:
    """SC-62 as a table function in SQL."""
    tables.register(t.spark)
    payloads = parse.spread(parsing.payloads(t))
    return t.spark.sql("SELECT doc_id, r.* FROM {docs} d, LATERAL harvest(d.payload) r", docs=payloads)


@query("UDF-05b", "raw", "SELECT id AS doc_id, count(*) * CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END AS n FROM raw GROUP BY id")
def udf_05b(t: Tables) -> DataFrame:
    """PRS-07 as a table function in SQL."""
    tables.register(t.spark)
    return t.spark.sql("SELECT doc_id, count(*) AS n FROM {lines} l, LATERAL lab_lines(l.line) r GROUP BY doc_id", lines=parsing.layer(t))


@query("UDF-05c", "", parsing.query.oracles["PRS-14"])
def udf_05c(t: Tables) -> DataFrame:
    """PRS-14 as a table function in SQL."""
    tables.register(t.spark)
    texts = t.read("part").select("p_partkey", F.expr(parsing.READING).alias("text"))
    return t.spark.sql("SELECT p_partkey, r.analyte_name, r.value_num, r.unit FROM {texts} x, LATERAL panel_rows(x.text) r", texts=texts)
