"""Filters, joins, aggregates, windows, sorts and set operations over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.operators import aggregates, filters, joins, ordered
from chartlode.plans.views import Register, Tables

query = Register()
DAY = "timestamp_ntz"

# Filters


@query("FLT-01", "labs", "SELECT id, analyte_name, value_num FROM labs WHERE user_id = 7")
def flt_01(t: Tables) -> DataFrame:
    return filters.tenant(t.labs(), 7).select("id", "analyte_name", "value_num")


DOCS = "SELECT id, doc_type, status, title, clinic, created_at FROM docs WHERE "


@query("FLT-02", "docs", DOCS + "doc_type = '5-LOW' AND status = 'F' AND created_at >= TIMESTAMP '1997-01-01'")
def flt_02(t: Tables) -> DataFrame:
    return t.documents().where(filters.document_filter(doc_type="5-LOW", status="F", since="1997-01-01")).select("id", "doc_type", "status", "title", "clinic", "created_at")


@query("FLT-03", "docs", DOCS + "created_at < TIMESTAMP '1996-07-01'")
def flt_03(t: Tables) -> DataFrame:
    return t.documents().where(filters.document_filter(until="1996-06-30")).select("id", "doc_type", "status", "title", "clinic", "created_at")


@query("FLT-04", "labs", "SELECT id, taken_at, value_num FROM labs WHERE taken_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31'")
def flt_04(t: Tables) -> DataFrame:
    return t.labs().where(filters.between("taken_at", "1998-01-01", "1998-03-31")).select("id", "taken_at", "value_num")


@query("FLT-05", "docs", DOCS + "lower(title) LIKE '%t 1%' OR lower(coalesce(clinic, '')) LIKE '%t 1%'")
def flt_05(t: Tables) -> DataFrame:
    return t.documents().where(filters.document_filter(query="T 1")).select("id", "doc_type", "status", "title", "clinic", "created_at")


@query("FLT-06", "labs", "SELECT id, analyte_name, taken_at FROM labs WHERE lower(coalesce(analyte_canonical, analyte_name)) = 'red widget'")
def flt_06(t: Tables) -> DataFrame:
    return t.labs().where(filters.lab_key() == "red widget").select("id", "analyte_name", "taken_at")


@query("FLT-07", "labs", """WITH q AS (SELECT unnest(['red widget', 'small', 'nothing']) AS q),
e AS (SELECT q, id, analyte_name FROM labs JOIN q ON lower(coalesce(analyte_canonical, analyte_name)) = q)
SELECT * FROM e UNION ALL SELECT q, id, analyte_name FROM labs JOIN q ON lower(analyte_name) LIKE '%' || q || '%' WHERE q NOT IN (SELECT q FROM e)""")
def flt_07(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([("Red widget",), ("small",), ("nothing",)], "q string")
    return filters.exact_or_like(t.labs(), asked).select("q", "id", "analyte_name")


@query("FLT-08", "labs", "SELECT id, value_num, ref_low, ref_high FROM labs WHERE (ref_low IS NOT NULL OR ref_high IS NOT NULL) AND (value_num < coalesce(ref_low, -1e18) OR value_num > coalesce(ref_high, 1e18))")
def flt_08(t: Tables) -> DataFrame:
    return t.labs().where(filters.out_of_reference()).select("id", "value_num", "ref_low", "ref_high")


@query("FLT-09", "docs", "SELECT DISTINCT user_id, clinic FROM docs WHERE clinic IS NOT NULL AND clinic <> ''")
def flt_09(t: Tables) -> DataFrame:
    return t.documents().where(filters.filled("clinic")).select("user_id", "clinic").distinct()


@query("FLT-10", "chunks", "SELECT chunk_id, ref_key FROM chunks WHERE source = 'drug' AND lower(ref_key) LIKE '1:%' ORDER BY ref_key LIMIT 20")
def flt_10(t: Tables) -> DataFrame:
    return filters.by_prefix(t.chunks(), "drug", "1:", 20).select("chunk_id", "ref_key")


@query("FLT-11", "", r"""WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count_if(trim(line) = '' OR (length(line) > 100 AND NOT regexp_matches(line, '[0-9]'))) AS n_noise FROM n GROUP BY doc_id""")
def flt_11(t: Tables) -> DataFrame:
    from chartlode.functions.lab import is_noise

    lines = t.read("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(is_noise(F.col("line"))).alias("n_noise"))


@query("FLT-12", "metrics", """WITH a AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(taken_at) END AS last_sync_at, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 30 END AS sync_interval_hours FROM metrics GROUP BY user_id)
SELECT user_id FROM a WHERE sync_interval_hours IS NOT NULL AND (last_sync_at IS NULL OR last_sync_at + to_hours(sync_interval_hours::INT) <= TIMESTAMP '2024-01-31 06:00:00')""")
def flt_12(t: Tables) -> DataFrame:
    accounts = t.metrics().groupBy("user_id").agg(F.max("taken_at").alias("m")).select("user_id", F.when(F.col("user_id") % 5 != 0, F.col("m")).alias("last_sync_at"), F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 30).cast("int")).alias("sync_interval_hours"))
    return filters.due(accounts, "2024-01-31 06:00:00").select("user_id")


@query("FLT-13", "labs", "SELECT id, analyte_name, value_num, unit, ref_low, ref_high FROM labs")
def flt_13(t: Tables) -> DataFrame:
    return t.labs().select("id", "analyte_name", "value_num", "unit", "ref_low", "ref_high")


@query("FLT-14", "", """WITH q AS (SELECT unnest(['apache', 'idiot', 'zebra']) AS term), h AS (SELECT term, doc_id AS id, substr(text, 1, 80) AS snippet, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS place FROM documents JOIN q ON contains(lower(text), term))
SELECT * FROM h WHERE place <= 3""")
def flt_14(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("apache",), ("idiot",), ("zebra",)], "term string")
    return filters.snippets(t.read("documents"), terms, 80, 3)


# Joins


@query("JOIN-01", "reports docs", "SELECT r.id, r.doctor_name, clinic FROM reports r LEFT JOIN docs d ON r.document_id = d.id")
def join_01(t: Tables) -> DataFrame:
    return joins.reports_with_clinic(t.reports(), t.documents()).select("id", "doctor_name", "clinic")


@query("JOIN-02", "reports docs", "SELECT id, user_id FROM docs d WHERE EXISTS (SELECT 1 FROM reports r WHERE r.document_id = d.id AND r.user_id = d.user_id AND r.doctor_name = 'Supplier#000000003')")
def join_02(t: Tables) -> DataFrame:
    return joins.documents_of_doctor(t.documents(), t.reports(), "Supplier#000000003").select("id", "user_id")


@query("JOIN-03", "users docs labs metrics", """SELECT user_id, (SELECT count(*) FROM docs d WHERE d.user_id = u.user_id) AS documents, (SELECT count(*) FROM labs d WHERE d.user_id = u.user_id) AS labs,
(SELECT count(*) FROM metrics d WHERE d.user_id = u.user_id) AS metrics FROM users u""")
def join_03(t: Tables) -> DataFrame:
    return joins.counts_per_user(t.users().select("user_id"), documents=t.documents(), labs=t.labs(), metrics=t.metrics())


@query("JOIN-04", "chunks", "SELECT c.chunk_id, source, ref_key FROM chunks c JOIN (SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 10 = 3) h USING (chunk_id)")
def join_04(t: Tables) -> DataFrame:
    hits = t.read("embeddings").where("vec_id % 10 = 3").select(F.col("vec_id").alias("chunk_id"))
    return t.chunks().join(hits, "chunk_id").select("chunk_id", "source", "ref_key")


@query("JOIN-06", "docs", """SELECT a.id, min(b.id) AS duplicate_of FROM docs a JOIN docs b ON a.user_id = b.user_id AND a.id <> b.id AND b.status = 'F'
AND (a.file_sha256 = b.file_sha256 OR (a.doc_type = b.doc_type AND a.title = b.title AND coalesce(a.clinic, '') = coalesce(b.clinic, ''))) GROUP BY a.id""")
def join_06(t: Tables) -> DataFrame:
    return joins.duplicate_documents(t.documents())


@query("JOIN-07", "labs", """WITH d AS (SELECT p_name AS analyte_name, p_type AS kind, p_partkey AS ordinal FROM part), r AS (SELECT analyte_name, kind, ordinal FROM d QUALIFY row_number() OVER (PARTITION BY analyte_name ORDER BY ordinal) = 1)
SELECT id, analyte_name, kind, ordinal FROM labs LEFT JOIN r USING (analyte_name)""")
def join_07(t: Tables) -> DataFrame:
    registry = t.read("part").select(F.col("p_name").alias("analyte_name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ordinal"))
    return joins.lookup_first(t.labs().select("id", "analyte_name"), registry, "analyte_name").select("id", "analyte_name", "record.kind", "record.ordinal")


@query("JOIN-11", "labs reports", """WITH d AS (SELECT 'X:' || document_id AS evidence_id, min(analyte_name) AS record, 0 AS domain FROM labs GROUP BY ALL UNION ALL SELECT 'X:' || document_id, max(diagnosis), 1 FROM reports GROUP BY 1),
b AS (SELECT evidence_id, arg_max(record, domain) AS record, max(domain) AS domain FROM d GROUP BY evidence_id)
SELECT 'X:' || o_orderkey AS evidence_id, record, domain FROM orders LEFT JOIN b ON b.evidence_id = 'X:' || o_orderkey""")
def join_11(t: Tables) -> DataFrame:
    key = F.concat(F.lit("X:"), F.col("document_id")).alias("evidence_id")
    domains = [t.labs().groupBy(key).agg(F.min("analyte_name").alias("record")), t.reports().groupBy(key).agg(F.max("diagnosis").alias("record"))]
    return joins.evidence(t.read("orders").select(F.concat(F.lit("X:"), "o_orderkey").alias("evidence_id")), domains)


@query("JOIN-12", "reports", """WITH l AS (SELECT user_id, max(visit_date) AS latest FROM reports GROUP BY 1)
SELECT id, p::INT AS position, medications[p + 1] AS medication, coalesce(visit_date, latest) AS dated FROM (SELECT *, unnest(range(0, len(medications))) AS p FROM reports) LEFT JOIN l USING (user_id)""")
def join_12(t: Tables) -> DataFrame:
    return joins.medication_dates(t.reports())


@query("JOIN-13", "", r"""WITH t AS (SELECT conv_id AS grp, turn AS i, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM conversations)
SELECT a.grp, count(*) AS pairs, round(avg(CASE WHEN len(a.x) + len(b.x) = 0 THEN 1.0 ELSE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) END), 6) AS mean_jaccard
FROM t a JOIN t b ON a.grp = b.grp AND a.i < b.i GROUP BY a.grp""")
def join_13(t: Tables) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    return joins.pairwise_jaccard(t.read("conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("i"), tokens.alias("tokens")))


@query("JOIN-14", "labs", "SELECT DISTINCT l_suppkey % 2000 AS evidence_id FROM lineitem WHERE l_suppkey % 2000 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def join_14(t: Tables) -> DataFrame:
    cited = t.read("lineitem").select((F.col("l_suppkey") % 2000).alias("evidence_id")).distinct()
    return joins.missing_citations(cited, t.read("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("evidence_id")))


@query("JOIN-15", "", """WITH p AS (SELECT o_orderkey AS id, o_custkey % 400 AS name, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 800) END AS birth FROM orders)
SELECT id, name, coalesce(birth, CASE WHEN count(DISTINCT birth) OVER (PARTITION BY name) = 1 THEN min(birth) OVER (PARTITION BY name) END) AS birth FROM p""")
def join_15(t: Tables) -> DataFrame:
    return joins.impute_birth(t.read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 800).alias("birth")))


@query("JOIN-16", "", """SELECT o_orderkey AS doc, o_orderstatus AS now_status, o_totalprice AS now_s, CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE o_orderstatus END AS was_status, o_totalprice + (o_orderkey % 40) AS was_s FROM orders
WHERE o_orderstatus <> CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE o_orderstatus END OR abs(o_totalprice - (o_totalprice + (o_orderkey % 40))) > 30""")
def join_16(t: Tables) -> DataFrame:
    run = t.read("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("elapsed"))
    base = t.read("orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 9 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") + F.col("o_orderkey") % 40).alias("elapsed"))
    return joins.against_baseline(run, base)


# Aggregates

DAILY = "SELECT metric, taken_at::DATE AS day, count(value_num) AS n, round(avg(value_num), 1) AS avg_value, min(value_num) AS min_value, max(value_num) AS max_value, min(unit) AS unit FROM metrics GROUP BY ALL"


@query("AGG-01", "metrics", DAILY)
def agg_01(t: Tables) -> DataFrame:
    return aggregates.daily(t.metrics())


@query("AGG-02", "metrics", "SELECT metric, count(*) AS n, min(taken_at) AS first_at, max(taken_at) AS last_at FROM metrics GROUP BY metric")
def agg_02(t: Tables) -> DataFrame:
    return aggregates.catalogue(t.metrics())


@query("AGG-03", "metrics activities", "SELECT count(*) AS points, count(DISTINCT metric) AS metrics, min(taken_at) AS first_at, max(taken_at) AS last_at, (SELECT count(*) FROM activities) AS activities FROM metrics")
def agg_03(t: Tables) -> DataFrame:
    return aggregates.overall(t.metrics(), t.activities())


@query("AGG-04", "docs", "SELECT 'doc_type' AS facet, doc_type AS value, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM docs GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM docs")
def agg_04(t: Tables) -> DataFrame:
    return aggregates.facets(t.documents())


@query("AGG-05", "docs", "SELECT user_id, min(created_at) AS first_at, max(created_at) AS last_at FROM docs GROUP BY 1")
def agg_05(t: Tables) -> DataFrame:
    return t.documents().groupBy("user_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("AGG-06", "docs labs reports", "SELECT id, (SELECT count(*) FROM labs WHERE document_id = d.id) AS labs, (SELECT count(*) FROM reports WHERE document_id = d.id) AS reports FROM docs d")
def agg_06(t: Tables) -> DataFrame:
    count = lambda df, name: df.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name))
    out = t.documents().select("id").join(count(t.labs(), "labs"), "id", "left").join(count(t.reports(), "reports"), "id", "left")
    return out.na.fill(0, ["labs", "reports"])


@query("AGG-07", "docs", "SELECT id, created_at, (SELECT count(*) FROM docs WHERE status = 'O') AS total FROM docs WHERE status = 'O' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def agg_07(t: Tables) -> DataFrame:
    found = t.documents().where("status = 'O'")
    page = ordered.page(found, [F.desc("created_at"), F.desc("id")], 40, 20)
    return page.select("id", "created_at").crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("AGG-08", "chunks", "SELECT source, count(*) AS chunks, count(embedding) AS vectors FROM chunks GROUP BY source")
def agg_08(t: Tables) -> DataFrame:
    return t.chunks().groupBy("source").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))


@query("AGG-09", "labs", """WITH p AS (SELECT lower(coalesce(analyte_canonical, analyte_name)) AS analyte, value_num, row_number() OVER (PARTITION BY lower(coalesce(analyte_canonical, analyte_name)) ORDER BY taken_at, id, value_num NULLS FIRST) - 1 AS place FROM labs)
SELECT analyte, (place // 1000)::INT AS chunk, array_to_string(list(value_num ORDER BY place), ',') AS line, count(*) AS n FROM p GROUP BY 1, 2""")
def agg_09(t: Tables) -> DataFrame:
    return aggregates.series(t.labs(), filters.lab_key()).select("analyte", "chunk", F.array_join("values_in_order", ",").alias("line"), "n")


@query("AGG-10", "metrics", f"WITH d AS ({DAILY}) SELECT metric, isoyear(day)::INT AS iso_year, week(day)::INT AS iso_week, round(avg(avg_value), 2) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value FROM d GROUP BY ALL")
def agg_10(t: Tables) -> DataFrame:
    return aggregates.weekly(t.metrics())


@query("AGG-11", "metrics", f"WITH d AS ({DAILY}) SELECT metric, round(avg(avg_value), 2) AS mean_of_days, count(*) AS days FROM d WHERE day BETWEEN DATE '2024-01-11' AND DATE '2024-01-25' GROUP BY metric")
def agg_11(t: Tables) -> DataFrame:
    return aggregates.recent_mean(t.metrics(), "2024-01-25")


@query("AGG-12", "metrics", DAILY.replace("SELECT metric,", "SELECT metric, provider,").replace(", 1)", ", 4)"))
def agg_12(t: Tables) -> DataFrame:
    return aggregates.daily(t.metrics(), 4, "provider")


@query("AGG-13", "metrics", "SELECT metric, round(avg(value_num), 1) AS avg_value, round(min(value_num), 1) AS min_value, round(max(value_num), 1) AS max_value, count(*) AS n, min(taken_at) AS first_at, max(taken_at) AS last_at, min(unit) AS unit FROM metrics WHERE metric <> 'error' GROUP BY metric")
def agg_13(t: Tables) -> DataFrame:
    return aggregates.overview(t.metrics(), "error")


@query("AGG-14", "activities", "SELECT activity_type, count(*) AS n, round(avg(duration_s / 60), 1) AS minutes, round(avg(distance_m / 1000), 2) AS km, round(avg(calories), 1) AS calories, round(avg(avg_hr), 1) AS heart_rate FROM activities GROUP BY 1")
def agg_14(t: Tables) -> DataFrame:
    return aggregates.activity_overview(t.activities())


@query("AGG-15", "labs", """WITH p AS (SELECT analyte_name, coalesce(unit, '') AS unit_key, id, row_number() OVER (PARTITION BY analyte_name, coalesce(unit, '') ORDER BY taken_at, id) - 1 AS place FROM labs)
SELECT analyte_name, unit_key, (place // 1000)::INT AS chunk, array_to_string(list(id ORDER BY place), ',') AS ids, count(*) AS n FROM p GROUP BY ALL""")
def agg_15(t: Tables) -> DataFrame:
    return aggregates.fact_series(t.labs()).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("AGG-16", "labs", "SELECT analyte_name, unit, count(value_num) AS n, min(taken_at) AS date_from, max(taken_at) AS date_to, round(avg(value_num), 2) AS mean, min(value_num) AS low, max(value_num) AS high FROM labs GROUP BY analyte_name, unit")
def agg_16(t: Tables) -> DataFrame:
    return aggregates.series_stats(t.labs())


@query("AGG-17", "activities", "SELECT provider, count(*) AS n, round(sum(coalesce(duration_s, 0)), 2) AS total_duration_s, round(sum(coalesce(distance_m, 0)), 2) AS total_distance_m, round(sum(coalesce(calories, 0)), 2) AS total_calories FROM activities GROUP BY 1")
def agg_17(t: Tables) -> DataFrame:
    return aggregates.activity_totals(t.activities())


@query("AGG-21", "labs", """WITH c AS (SELECT document_id, analyte_group AS v, count(*) AS n, min(id) AS f FROM labs WHERE analyte_group IS NOT NULL GROUP BY ALL)
SELECT document_id, v AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1""")
def agg_21(t: Tables) -> DataFrame:
    return aggregates.mode_first_seen(t.labs(), "document_id", "analyte_group", "id")


CORE = ["red widget", "small ring", "large bolt", "blue widget", "red ring", "small bolt", "red bolt", "blue ring", "large widget", "green widget", "small widget", "green ring"]


@query("AGG-22", "labs", f"SELECT document_id, array_to_string(list_sort(list(DISTINCT lower(analyte_name))), '|') AS found FROM labs WHERE lower(analyte_name) IN {tuple(CORE)} GROUP BY 1 HAVING count(DISTINCT lower(analyte_name)) >= 3")
def agg_22(t: Tables) -> DataFrame:
    return aggregates.panels(t.labs(), CORE).select("document_id", F.array_join("found", "|").alias("found"))


@query("AGG-23", "labs", "SELECT document_id, count(*) AS n, count_if(value_num IS NOT NULL OR value_text IS NOT NULL) AS with_value, count_if(unit IS NOT NULL) AS with_unit, count_if(ref_low IS NOT NULL OR ref_high IS NOT NULL) AS with_reference FROM labs GROUP BY 1")
def agg_23(t: Tables) -> DataFrame:
    return aggregates.completeness(t.labs())


@query("AGG-24", "", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_rate FROM lineitem GROUP BY 1")
def agg_24(t: Tables) -> DataFrame:
    return aggregates.weighted_rate(t.read("lineitem"), "l_returnflag", "l_discount", "l_quantity")


RUNS = """SELECT l_suppkey % 7 AS model, (l_quantity::INT % 9)::DOUBLE AS matched, 9.0::DOUBLE AS expected, l_quantity > 10 AS passed, l_discount * 10 AS precision, l_extendedprice / 1000 AS seconds FROM lineitem"""


@query("AGG-25", "", f"""WITH r AS ({RUNS}), g AS (SELECT model, count(*) AS n, sum(matched) / sum(expected) AS accuracy, avg(passed::INT) AS pass_rate, avg(precision) AS macro_precision, avg(seconds) AS avg_s, list_sort(list(seconds))[(count(*) // 2 + 1)] AS median_s FROM r GROUP BY model)
SELECT model, n, round(accuracy, 6) AS accuracy, round(pass_rate, 6) AS pass_rate, round(macro_precision, 6) AS macro_precision, round(avg_s, 6) AS avg_s, round(median_s, 6) AS median_s, round(round(macro_precision, 6) * round(pass_rate, 6) / round(avg_s, 6), 6) AS score FROM g""")
def agg_25(t: Tables) -> DataFrame:
    runs = t.read("lineitem").selectExpr("l_suppkey % 7 AS model", "CAST(CAST(l_quantity AS INT) % 9 AS DOUBLE) AS matched", "CAST(9 AS DOUBLE) AS expected", "l_quantity > 10 AS passed", "l_discount * 10 AS precision", "l_extendedprice / 1000 AS seconds")
    return aggregates.leaderboard(runs)


@query("AGG-26", "metrics", "SELECT metric, count(value_num) AS n, min(value_num) AS low, round(avg(value_num), 4) AS mean, max(value_num) AS high, quantile_disc(value_num, 0.5) AS p50, quantile_disc(value_num, 0.95) AS p95 FROM metrics GROUP BY 1")
def agg_26(t: Tables) -> DataFrame:
    return aggregates.nearest_rank(t.metrics(), "metric", "value_num")


@query("AGG-27", "", "SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, round(avg((text LIKE '%que%')::INT), 6) AS share FROM conversations GROUP BY role")
def agg_27(t: Tables) -> DataFrame:
    return t.read("conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.round(F.avg(F.col("text").contains("que").cast("int")), 6).alias("share"))


@query("AGG-28", "metrics", "SELECT metric, count(value_num) AS n, list_sort(list(value_num))[greatest(floor(0.95 * count(value_num)), 1)::INT] AS p95 FROM metrics GROUP BY 1")
def agg_28(t: Tables) -> DataFrame:
    return aggregates.batch_p95(t.metrics(), "metric", "value_num")


@query("AGG-29", "labs", "SELECT document_id, count(*) AS n, count_if(match_status = 'matched') AS matched, round(count_if(match_status = 'matched') / count(*), 4) AS share FROM labs GROUP BY 1")
def agg_29(t: Tables) -> DataFrame:
    return aggregates.matched_share(t.labs())


@query("AGG-30", "labs", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY analyte_name ORDER BY taken_at, id, value_num, unit NULLS FIRST, ref_low NULLS FIRST, ref_high NULLS FIRST) - 1 AS place FROM labs WHERE value_num IS NOT NULL),
e AS (SELECT analyte_name, arg_max({'v': value_num, 'u': unit, 'l': ref_low, 'h': ref_high}, place) AS z FROM r GROUP BY 1),
c AS (SELECT analyte_name, (place // 1000)::INT AS chunk, array_to_string(list(value_num::INT::VARCHAR ORDER BY place), ' → ') AS line FROM r GROUP BY 1, 2)
SELECT analyte_name, chunk, line, z.u AS unit, z.l AS ref_low, z.h AS ref_high, CASE WHEN z.v < z.l THEN '↓' WHEN z.v > z.h THEN '↑' ELSE '' END AS marker FROM c JOIN e USING (analyte_name)""")
def agg_30(t: Tables) -> DataFrame:
    return aggregates.period_lines(t.labs())


# Windows


@query("WIN-01", "docs", "SELECT id, user_id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM docs WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)")
def win_01(t: Tables) -> DataFrame:
    return ordered.neighbours(t.documents())


@query("WIN-02", "metrics", """WITH r AS (SELECT user_id, metric, event_id, taken_at, value_num, row_number() OVER (PARTITION BY user_id, metric ORDER BY taken_at DESC, event_id DESC) AS b FROM metrics), k AS (SELECT * FROM r WHERE b <= 5)
SELECT user_id, metric, event_id, taken_at, value_num, count(*) OVER (PARTITION BY user_id, metric) + 1 - b AS place FROM k""")
def win_02(t: Tables) -> DataFrame:
    return ordered.latest(t.metrics().select("user_id", "metric", "event_id", "taken_at", "value_num"), ["user_id", "metric"], [F.desc("taken_at"), F.desc("event_id")], 5)


LOG = "SELECT user_id AS document_id, metric AS status, epoch_us(taken_at) / 1000000.0 AS entered_at FROM metrics"


@query("WIN-03", "metrics", """WITH log AS (SELECT user_id AS document_id, metric AS status, epoch_us(taken_at) AS entered_at FROM metrics), d AS (SELECT *, lead(entered_at) OVER (PARTITION BY document_id ORDER BY entered_at) - entered_at AS seconds FROM log)
SELECT document_id, status, entered_at, seconds FROM d WHERE seconds > 0 AND seconds < 3600000000""")
def win_03(t: Tables) -> DataFrame:
    log = t.metrics().selectExpr("user_id AS document_id", "metric AS status", "unix_micros(CAST(taken_at AS TIMESTAMP)) AS entered_at")
    return ordered.stage_durations(log, 3_600_000_000)


@query("WIN-04", "metrics", """WITH s AS (SELECT metric, value_num AS v, row_number() OVER (PARTITION BY metric ORDER BY taken_at, event_id) AS k, count(*) OVER (PARTITION BY metric) AS n FROM metrics WHERE value_num IS NOT NULL)
SELECT metric, round(sum(v * pow(0.7::DOUBLE, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.3::DOUBLE END), 6) AS ema, max(n)::INT AS samples FROM s GROUP BY metric""")
def win_04(t: Tables) -> DataFrame:
    return ordered.ema(t.metrics(), "metric", ["taken_at", "event_id"], "value_num")


@query("WIN-05", "metrics", """WITH s AS (SELECT metric, epoch_us(taken_at) AS t, value_num AS p FROM metrics WHERE value_num IS NOT NULL), l AS (SELECT metric, t, p, lag(t) OVER w AS t0, lag(p) OVER w AS p0 FROM s WINDOW w AS (PARTITION BY metric ORDER BY t, p))
SELECT metric, round(sum((t - t0) * (p + p0) / 2) / 1e6, 3) AS joules, count(*) AS intervals FROM l WHERE t > t0 GROUP BY metric""")
def win_05(t: Tables) -> DataFrame:
    samples = t.metrics().selectExpr("metric", "unix_micros(CAST(taken_at AS TIMESTAMP)) AS t", "value_num AS p")
    return ordered.energy(samples, "metric", "t", "p").select("metric", F.round(F.col("joules") / 1e6, 3).alias("joules"), "intervals")


@query("WIN-06", "metrics", f"""WITH d AS ({DAILY}), b AS (SELECT *, date_diff('day', day, DATE '2024-01-28') // 7 AS weeks_back FROM d WHERE day <= DATE '2024-01-28'), e AS (SELECT *, DATE '2024-01-28' - (weeks_back * 7)::INT AS ends FROM b)
SELECT metric, weeks_back, isoyear(ends) || '-W' || lpad(week(ends)::VARCHAR, 2, '0') AS ref_week, round(avg(avg_value), 2) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value, count(*) AS days FROM e GROUP BY ALL""")
def win_06(t: Tables) -> DataFrame:
    return ordered.seven_day_windows(aggregates.daily(t.metrics()), "2024-01-28")


@query("WIN-07", "labs", "SELECT document_id, analyte_name, id FROM labs QUALIFY row_number() OVER (PARTITION BY document_id, lower(analyte_name) ORDER BY id, taken_at, value_num) = 1")
def win_07(t: Tables) -> DataFrame:
    first = ordered.first_of(t.labs(), [F.col("document_id"), F.lower("analyte_name")], [F.col("id"), F.col("taken_at"), F.asc_nulls_last("value_num")])
    return first.select("document_id", "analyte_name", "id")


@query("WIN-08", "labs", """WITH r AS (SELECT document_id AS doc, id % 2 AS pass, id AS ordinal, lower(analyte_name) AS name_key, value_num, value_text FROM labs),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, name_key ORDER BY pass, ordinal, value_num) = 1),
n AS (SELECT * FROM r WHERE value_num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, name_key ORDER BY pass, ordinal, value_num) = 1)
SELECT f.doc, f.name_key, coalesce(f.value_num, n.value_num) AS value_num, CASE WHEN f.value_num IS NULL AND n.doc IS NOT NULL THEN n.value_text ELSE f.value_text END AS value_text, f.pass, f.ordinal FROM f LEFT JOIN n USING (doc, name_key)""")
def win_08(t: Tables) -> DataFrame:
    rows = t.labs().select(F.col("document_id").alias("doc"), (F.col("id") % 2).alias("pass"), F.col("id").alias("ordinal"), F.lower("analyte_name").alias("name_key"), "value_num", "value_text")
    return ordered.merge_passes(rows)


@query("WIN-09", "metrics", "SELECT event_id, user_id, last_value(CASE WHEN metric = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM metrics")
def win_09(t: Tables) -> DataFrame:
    return ordered.carry_forward(t.metrics(), "user_id", "event_id", F.when(F.col("metric") == "signup", F.col("event_id"))).select("event_id", "user_id", "carried")


@query("WIN-10", "labs", """WITH k AS (SELECT *, lower(coalesce(analyte_canonical, analyte_name)) AS analyte FROM labs), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY analyte ORDER BY taken_at DESC, id DESC) = 1)
SELECT analyte, (SELECT count(*) FROM k WHERE k.analyte = l.analyte) AS n, taken_at AS last_at, value_num, unit, ref_low, ref_high FROM l""")
def win_10(t: Tables) -> DataFrame:
    return ordered.last_point(t.labs(), filters.lab_key())


@query("WIN-11", "labs", "WITH s AS (SELECT analyte_name, coalesce(unit, '') AS unit_key, list(id ORDER BY taken_at, id) AS ids FROM labs GROUP BY ALL) SELECT analyte_name, unit_key, ids[1] AS first_id, ids[2] AS second_id FROM s WHERE len(ids) >= 2")
def win_11(t: Tables) -> DataFrame:
    return ordered.first_pairs(aggregates.fact_series(t.labs()))


@query("WIN-13", "metrics", """WITH d AS (SELECT user_id, metric, taken_at::DATE AS day, count(*) AS points, avg(value_num) AS mean FROM metrics GROUP BY ALL)
SELECT user_id, metric, day, points, CASE WHEN max(points) OVER (PARTITION BY user_id, metric) > 1 THEN round(round(mean, 6), 1) ELSE mean END AS value FROM d""")
def win_13(t: Tables) -> DataFrame:
    return ordered.thin_daily(t.metrics())


# Sorts, limits, sets


@query("TOP-01", "docs", "SELECT id, created_at FROM docs WHERE user_id = 5 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 2")
def top_01(t: Tables) -> DataFrame:
    return ordered.page(filters.tenant(t.documents(), 5), [F.desc("created_at"), F.desc("id")], 2, 10).select("id", "created_at")


@query("TOP-02", "docs", "SELECT user_id, arg_max(id, (created_at, id)) AS latest_id FROM docs GROUP BY user_id")
def top_02(t: Tables) -> DataFrame:
    return t.documents().groupBy("user_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("latest_id"))


@query("TOP-03", "labs", "SELECT id, analyte_name FROM labs WHERE user_id = 7 ORDER BY id LIMIT 15")
def top_03(t: Tables) -> DataFrame:
    return filters.tenant(t.labs(), 7).orderBy("id").limit(15).select("id", "analyte_name")


@query("TOP-04", "labs", """SELECT id, user_id, taken_at, value_num FROM labs WHERE (ref_low IS NOT NULL OR ref_high IS NOT NULL) AND (value_num < coalesce(ref_low, -1e18) OR value_num > coalesce(ref_high, 1e18))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY taken_at DESC NULLS LAST, id DESC) <= 15""")
def top_04(t: Tables) -> DataFrame:
    found = t.labs().where(filters.out_of_reference()).select("id", "user_id", "taken_at", "value_num")
    return ordered.latest(found, ["user_id"], [F.desc("taken_at"), F.desc("id")], 15).drop("place")


@query("TOP-05", "reports", "SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (visit_date IS NULL) DESC, visit_date DESC NULLS LAST, id DESC) AS place FROM reports")
def top_05(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.col("visit_date").isNull().desc(), F.desc_nulls_last("visit_date"), F.desc("id"))
    return t.reports().select("id", "user_id", F.row_number().over(order).alias("place"))


@query("TOP-07", "labs", "SELECT id, analyte_name, (SELECT count(*) FROM labs WHERE analyte_name LIKE '%ring%') AS total FROM labs WHERE analyte_name LIKE '%ring%' ORDER BY id DESC LIMIT 25 OFFSET 50")
def top_07(t: Tables) -> DataFrame:
    found = t.labs().where(F.col("analyte_name").like("%ring%"))
    return ordered.page(found, [F.desc("id")], 50, 25).select("id", "analyte_name").crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("TOP-08", "labs", "SELECT document_id, arg_max(id, (value_num, -id)) AS best_id, max(value_num) AS best FROM labs WHERE value_num IS NOT NULL GROUP BY 1")
def top_08(t: Tables) -> DataFrame:
    return t.labs().where("value_num IS NOT NULL").groupBy("document_id").agg(F.max_by("id", F.struct("value_num", -F.col("id"))).alias("best_id"), F.max("value_num").alias("best"))


@query("SET-01", "reports", "SELECT DISTINCT doctor_name, department FROM reports WHERE doctor_name IS NOT NULL ORDER BY ALL")
def set_01(t: Tables) -> DataFrame:
    return t.reports().where("doctor_name IS NOT NULL").select("doctor_name", "department").distinct().orderBy("doctor_name", "department")


@query("SET-02", "labs", "SELECT DISTINCT user_id, analyte_name, value_num, unit, taken_at FROM labs WHERE value_num IS NOT NULL")
def set_02(t: Tables) -> DataFrame:
    return t.labs().where("value_num IS NOT NULL").select("user_id", "analyte_name", "value_num", "unit", "taken_at").distinct()


@query("SET-03", "reports", "SELECT id, visit_date, diagnosis FROM reports QUALIFY row_number() OVER (PARTITION BY visit_date, substr(diagnosis, 1, 80) ORDER BY id) = 1")
def set_03(t: Tables) -> DataFrame:
    return ordered.first_of(t.reports(), [F.col("visit_date"), F.substring("diagnosis", 1, 80)], [F.col("id")]).select("id", "visit_date", "diagnosis")


@query("SET-04", "chunks", """WITH u AS (SELECT ref_key, chunk_id, 0 AS source_no FROM chunks WHERE chunk_id % 3 = 0 UNION ALL SELECT ref_key, chunk_id, 1 FROM chunks WHERE chunk_id % 2 = 0)
SELECT ref_key, chunk_id, source_no FROM u QUALIFY row_number() OVER (PARTITION BY ref_key ORDER BY source_no, chunk_id) = 1""")
def set_04(t: Tables) -> DataFrame:
    part = lambda n, k: t.chunks().where(F.col("chunk_id") % n == 0).select("ref_key", "chunk_id", F.lit(k).alias("source_no"))
    return ordered.first_of(part(3, 0).unionByName(part(2, 1)), [F.col("ref_key")], [F.col("source_no"), F.col("chunk_id")])


@query("SET-05", "labs reports docs", "SELECT document_id AS id FROM labs UNION SELECT document_id FROM reports UNION SELECT id FROM docs WHERE id % 10 = 0")
def set_05(t: Tables) -> DataFrame:
    ids = t.labs().select(F.col("document_id").alias("id")).unionByName(t.reports().select(F.col("document_id").alias("id")))
    return ids.unionByName(t.documents().where("id % 10 = 0").select("id")).distinct()


@query("SET-06", "labs", """WITH s AS (SELECT document_id, list(DISTINCT analyte_name) FILTER (WHERE match_status = 'matched') AS a, list(DISTINCT analyte_name) FILTER (WHERE value_num > 20) AS b FROM labs GROUP BY 1), c AS (SELECT document_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT document_id, len(list_intersect(a, b))::INT AS both, (len(a) - len(list_intersect(a, b)))::INT AS only_a, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END::DOUBLE AS jaccard FROM c""")
def set_06(t: Tables) -> DataFrame:
    from chartlode.functions.sets import jaccard

    sets = t.labs().groupBy("document_id").agg(F.collect_set(F.when(F.col("match_status") == "matched", F.col("analyte_name"))).alias("a"), F.collect_set(F.when(F.col("value_num") > 20, F.col("analyte_name"))).alias("b"))
    return sets.select("document_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_a"), F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SET-07", "labs", """WITH p AS (SELECT analyte_group AS topic, document_id AS pmid, min(id) AS ordinal FROM labs GROUP BY ALL), k AS (SELECT topic, pmid FROM p QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY topic, ordinal) = 1)
SELECT topic, count(*) AS found, (SELECT count(*) FROM k WHERE k.topic = p.topic) AS kept FROM p GROUP BY topic""")
def set_07(t: Tables) -> DataFrame:
    found = t.labs().groupBy(F.col("analyte_group").alias("topic"), F.col("document_id").alias("pmid")).agg(F.min("id").alias("ordinal"))
    kept = ordered.first_of(found, [F.col("pmid")], [F.col("topic"), F.col("ordinal")]).groupBy("topic").agg(F.count("*").alias("kept"))
    return found.groupBy("topic").agg(F.count("*").alias("found")).join(kept, "topic", "left").na.fill(0, ["kept"])


@query("SET-08", "reports", "SELECT user_id, array_to_string(list_sort(flatten(list(medications))), '|') AS medications FROM reports GROUP BY 1")
def set_08(t: Tables) -> DataFrame:
    return t.reports().groupBy("user_id").agg(F.array_join(F.sort_array(F.flatten(F.collect_list("medications"))), "|").alias("medications"))
