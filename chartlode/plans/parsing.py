"""Parsers over texts made of line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlode.operators import panels, parse
from chartlode.plans.scalars import FIND, VALUE_NUM, VALUE_TEXT
from chartlode.plans.views import Register, Tables

query = Register()

# Compact rows of forms with some noise; lines of a text layer.
PIPES = "CASE WHEN id % 13 = 0 THEN '--- | --- | ---' WHEN id % 17 = 0 THEN 'Показатель|значение|ед|норма' WHEN id % 5 = 0 THEN concat('| ', name, ' | ', value, ' | ', ref, ' | |') WHEN id % 7 = 0 THEN concat('ГРУППА|', name, '|', value, '|', coalesce(unit, ''), '|', ref) ELSE concat(name, '|', value, '|', coalesce(unit, ''), '|', ref) END"
LAYER = "concat('Показатель-', doc % 50, CASE WHEN id % 4 = 0 THEN ' (в 1 Эр.)' ELSE '' END, 'x ', id % 90, ',', id % 7, ' г/л ', id % 30, ' - ', id % 30 + 9, CASE WHEN id % 6 = 0 THEN ' pH 5.5 < 8' ELSE '' END)"


def pipes(t: Tables) -> DataFrame:
    return t.raw().select(F.col("id").alias("doc_id"), F.expr(PIPES).alias("text"))


def layer(t: Tables) -> DataFrame:
    return t.raw().select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.expr(LAYER).alias("line"))


@query("PRS-01")
def prs_01(t: Tables) -> DataFrame:
    """With PRS-02 and PRS-03; tested against a version of one line at a time."""
    return parse.compact_rows(pipes(t))


@query("PRS-02", "", "SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'name' ELSE 'ГРУППА' END AS first FROM lineitem")
def prs_02(t: Tables) -> DataFrame:
    parts = F.when(F.col("l_linenumber") % 2 == 0, F.array(*[F.lit(x) for x in ("ГРУППА", "name", "12", "g")])).otherwise(F.array(*[F.lit(x) for x in ("ГРУППА", "не обнаружено", "x", "g")]))
    return t.read("lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.get(parse.without_group(parts), F.lit(0)).alias("first"))


REF = r"^-?[0-9]+(?:[.,][0-9]+)?\s*[-–—]\s*-?[0-9]+(?:[.,][0-9]+)?$|^[<≤>≥]\s*-?[0-9]+(?:[.,][0-9]+)?$"


@query("PRS-03", "raw", f"SELECT id, CASE WHEN regexp_matches(trim(ref), '{REF}') THEN nullif(trim(unit), '') ELSE nullif(trim(ref), '') END AS u, CASE WHEN regexp_matches(trim(ref), '{REF}') THEN trim(ref) ELSE nullif(trim(unit), '') END AS r FROM raw")
def prs_03(t: Tables) -> DataFrame:
    fixed = parse.fixed_fields(F.col("ref"), F.col("unit"))
    return t.raw().select("id", fixed["unit"].alias("u"), fixed["ref"].alias("r"))


@query("PRS-04", "raw", f"SELECT id AS doc_id, name AS analyte_name, {VALUE_NUM} AS value_num, {VALUE_TEXT} AS value_text, coalesce({FIND(r'^(-?[0-9]+(?:[.,][0-9]+)?)\s*[-–—]\s*(-?[0-9]+(?:[.,][0-9]+)?)$', 1)}, {FIND(r'^[>≥]\s*(-?[0-9]+(?:[.,][0-9]+)?)$', 1)}) AS ref_low FROM (SELECT DISTINCT id, name, value, ref FROM raw)")
def prs_04(t: Tables) -> DataFrame:
    row = F.struct(F.col("name").alias("parameter"), F.col("value"), F.col("ref").alias("reference_range"))
    other = F.struct(F.col("name").alias("test_name"), F.col("value").alias("result"), F.col("ref").alias("norm"))
    payload = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(row, row).alias("results")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.array(other).alias("results"))).alias("tests"), F.array(other).alias("results"))))
    once = t.raw().select("id", "name", "value", "ref").distinct()
    return parse.flatten_analysis(once.select(F.col("id").alias("doc_id"), payload.alias("payload"))).select("doc_id", "analyte_name", "value_num", "value_text", "ref_low")


@query("PRS-05")
def prs_05(t: Tables) -> DataFrame:
    return parse.clean_rows(parse.results(parse.compact_rows(pipes(t))))


@query("PRS-06", "raw", """SELECT id AS doc_id, 0 AS ordinal, concat('Показатель-', doc % 50, CASE WHEN id % 4 = 0 THEN ' (в 1 Эр.)' ELSE '' END, 'x') AS analyte_name, concat(id % 90, ',', id % 7) AS value_raw, 'г/л' AS unit, concat(id % 30, ' - ', id % 30 + 9) AS ref_raw FROM raw
UNION ALL SELECT id, 1, 'pH', '5.5', NULL, '<8' FROM raw WHERE id % 6 = 0""")
def prs_06(t: Tables) -> DataFrame:
    """With PRS-07 to PRS-09."""
    return parse.text_lines(layer(t)).drop("line_no")


@query("PRS-10", "raw", "SELECT id AS doc_id, id % 5 <> 0 AS kept FROM raw")
def prs_10(t: Tables) -> DataFrame:
    once = t.raw().withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("name")))
    rows = once.select((F.col("id") * 10 + F.col("n")).alias("doc_id"), F.when(F.col("id") % 5 == 0, "98765,4").otherwise(F.concat(F.col("id") % 90, F.lit(",5"))).alias("value_raw"), F.lit("1 - 2").alias("ref_raw"))
    sources = once.select((F.col("id") * 10 + F.col("n")).alias("doc_id"), F.concat(F.lit("numbers "), F.col("id") % 90, F.lit(".5 and 1 2")).alias("text"))
    return parse.verbatim(rows, sources).select(F.floor(F.col("doc_id") / 10).alias("doc_id"), "kept")


@query("PRS-11", "raw", "WITH r AS (SELECT doc, id % 5 <> 0 AND id % 90 <> doc % 4 AS kept FROM raw) SELECT doc AS doc_id, count(*) AS n, avg((NOT kept)::INT) <= 0.3 AS trusted FROM r GROUP BY doc")
def prs_11(t: Tables) -> DataFrame:
    rows = t.raw().select(F.col("doc").alias("doc_id"), F.when((F.col("id") % 5 == 0) | (F.col("id") % 90 == F.col("doc") % 4), "98765").otherwise("1").alias("value_raw"), F.lit("").alias("ref_raw"))
    sources = t.raw().select(F.col("doc").alias("doc_id"), F.lit("1").alias("text")).distinct()
    return parse.verbatim(rows, sources).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("trusted").alias("trusted"))


@query("PRS-12", "raw", """WITH p AS (SELECT DISTINCT doc, concat(id % 90, '.', id % 7) AS k FROM raw UNION SELECT doc, '5.5' FROM raw WHERE id % 6 = 0), c AS (SELECT doc, concat(id % 90, '.', id % 7) AS k FROM raw WHERE id % 3 = 0) SELECT doc AS doc_id, k FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = p.doc AND c.k = p.k)""")
def prs_12(t: Tables) -> DataFrame:
    lines = t.raw().select(F.col("doc").alias("doc_id"), F.col("id").alias("line_no"), F.expr(LAYER).alias("line"))
    covered = t.raw().where("id % 3 = 0").select(F.col("doc").alias("doc_id"), F.concat(F.col("id") % 90, F.lit(","), F.col("id") % 7).alias("value_raw"))
    found = parse.recovered(covered, parse.text_lines(lines.withColumn("line_no", F.pmod("line_no", F.lit(1 << 30)))))
    return found.select("doc_id", F.translate("value_raw", ",", ".").alias("k"))


BREATH = "concat(l_partkey % 5 * 20, ' мин: H2=', l_suppkey % 40, ' ppm, CH4=', l_partkey % 30, ',5* ppm; H2+2CH4=', l_orderkey % 90, ' ppm, O2=17 %')"


@query("PRS-16", "", f"""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 'базовая проба' ELSE (l_partkey % 5 * 20) || ' минут' END AS label FROM lineitem WHERE l_quantity > 5)
SELECT doc_id, line_no, 'СИБР-тест: ' || label || ', водород H2' AS analyte_name, (l_suppkey % 40)::DOUBLE AS value_num, 'ppm' AS unit FROM b UNION ALL SELECT doc_id, line_no, 'СИБР-тест: ' || label || ', метан CH4', l_partkey % 30 + 0.5, 'ppm' FROM b
UNION ALL SELECT doc_id, line_no, 'СИБР-тест: ' || label || ', H2 + 2CH4', (doc_id % 90)::DOUBLE, 'ppm' FROM b UNION ALL SELECT doc_id, line_no, 'СИБР-тест: ' || label || ', кислород O2', 17.0, '% КВМ' FROM b""")
def prs_16(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.expr(f"CASE WHEN l_quantity > 5 THEN {BREATH} ELSE 'прочее' END").alias("line"))
    return parse.breath_test(lines).select("doc_id", "line_no", "analyte_name", "value_num", "unit")


#: A panel's text in single lines (with a colon, without one and with a lost decimal point, as blocks), and in reading order.
SINGLE = r"""CASE p_partkey % 3 WHEN 0 THEN concat('  ', p_name, ': 10 ', p_size % 9, '.', p_partkey % 10, ' -0.', p_partkey % 7, ' (5-7%)', chr(10), p_brand, ': не выявлено')
WHEN 1 THEN concat('Описание', chr(10), chr(10), p_name, ' 10 ', 40 + p_partkey % 10)
ELSE concat('Название показателя: ', p_name, chr(10), 'Количественный результат: 10 ', p_size % 9, ',', p_partkey % 10, chr(10), 'Относительный Lg(X/CBMO): ', CASE WHEN p_partkey % 2 = 0 THEN '—' ELSE '+1.5 (9%)' END, chr(10), chr(10), 'Название показателя: ', p_brand, chr(10), 'Количественный результат: не выявлено') END"""
READING = """concat(p_name, chr(10), '10 ', p_size % 9, '.', p_partkey % 10, chr(10), '10 100', chr(10), p_partkey, chr(10), CASE WHEN p_partkey % 4 < 2 THEN '' ELSE concat('-0.', p_partkey % 7, ' (68-91%)') END, chr(10), p_brand, chr(10), 'не выявлено', chr(10), p_type, chr(10), '10', chr(10), p_size % 9, ',', p_partkey % 10)"""
SINGLE_ROWS = """SELECT p_partkey, p_name AS analyte_name, CASE p_partkey % 3 WHEN 1 THEN (40 + p_partkey % 10)::DOUBLE / 10 ELSE concat(p_size % 9, '.', p_partkey % 10)::DOUBLE END AS value_num, 'Lg' AS unit FROM part
UNION ALL SELECT p_partkey, concat(p_name, ', относительный показатель'), CASE p_partkey % 3 WHEN 0 THEN concat('-0.', p_partkey % 7)::DOUBLE ELSE 1.5::DOUBLE END, 'Lg(X/СВМО)' FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 3 = 2 AND p_partkey % 2 = 1"""
READING_ROWS = """SELECT p_partkey, unnest([p_name, p_type]) AS analyte_name, concat(p_size % 9, '.', p_partkey % 10)::DOUBLE AS value_num, 'Lg' AS unit FROM part
UNION ALL SELECT p_partkey, concat(p_name, ', относительный показатель'), concat('-0.', p_partkey % 7)::DOUBLE, 'Lg(X/СВМО)' FROM part WHERE p_partkey % 4 >= 2"""


def panel_rows(t: Tables, text: str, parsed: Callable[[Column], Column]) -> DataFrame:
    texts = t.read("part").select("p_partkey", F.expr(text).alias("text"))
    return texts.select("p_partkey", F.explode(parsed(F.col("text"))).alias("r")).select("p_partkey", "r.analyte_name", "r.value_num", "r.unit")


@query("PRS-13", "", SINGLE_ROWS)
def prs_13(t: Tables) -> DataFrame:
    return panel_rows(t, SINGLE, panels.single_lines)


@query("PRS-14", "", READING_ROWS)
def prs_14(t: Tables) -> DataFrame:
    return panel_rows(t, READING, panels.reading_order)


@query("PRS-15", "", f"SELECT * FROM ({SINGLE_ROWS}) WHERE p_partkey % 5 < 3 UNION ALL SELECT * FROM ({READING_ROWS}) WHERE p_partkey % 5 >= 3")
def prs_15(t: Tables) -> DataFrame:
    """Texts of both forms."""
    return panel_rows(t, f"CASE WHEN p_partkey % 5 < 3 THEN {SINGLE} ELSE {READING} END", panels.panel)


@query("PRS-18", "", """SELECT p_partkey AS page, CASE WHEN p_partkey % 2 = 1 AND k > 3 THEN k - 2 ELSE k - 1 END AS line_no, [concat('Показатель ', p_name, ' по: объем (RDW) 49.6 fL'), concat('Расчетная ширина ', p_size, '.00 % 11 - 14 эритроцитов, КВ (CV)'), concat(p_size, ' г/л'), concat('PDW ( ширина тромбоцитов ) ', p_partkey, ',4 фл'), concat(p_brand, ' 7')][k] AS line
FROM part, unnest(range(1, 6)) AS u(k) WHERE k <> 3 OR p_partkey % 2 = 0""")
def prs_18(t: Tables) -> DataFrame:
    lines = ["concat('Показатель ', p_name, ' по:')", "'объем (RDW) 49.6 fL'", "'Расчетная ширина'", "concat(p_size, '.00 % 11 - 14')", "'эритроцитов, КВ'", "'(CV)'", "CASE WHEN p_partkey % 2 = 0 THEN '* * *' END", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' г/л') END", "'PDW ( ширина'", "concat(p_partkey, ',4 фл')", "'тромбоцитов )'", "concat(p_brand, ' 7')"]
    pages = t.read("part").select(F.col("p_partkey").alias("page"), panels.unwrap(F.expr(f"array({', '.join(lines)})")).alias("lines"))
    whole = pages.select("page", F.filter("lines", lambda s: s != "* * *").alias("lines"))
    return whole.select("page", F.posexplode("lines").alias("line_no", "line"))


def unit_rows(t: Tables) -> DataFrame:
    """Results with spoilt units and some heads of forms among them."""
    spoilt = F.when(F.col("id") % 4 == 0, "10^9/л (note)").when(F.col("id") % 4 == 1, "| G/L |").when(F.col("id") % 4 == 2, "мг/дл").otherwise(F.lit(None).cast("string"))
    name = F.when(F.col("id") % 11 == 0, "Результат").otherwise(F.col("analyte_name"))
    return t.labs().select("id", F.col("document_id").alias("doc_id"), name.alias("analyte_name"), "value_num", "value_text", spoilt.alias("unit"), F.when(F.col("id") % 8 == 0, "first").alias("unit_raw"), "ref_low", "ref_high")


def unit_registry(t: Tables) -> DataFrame:
    return t.read("part").groupBy(F.col("p_name").alias("name")).agg(F.array(F.lit("×10⁹/л"), F.lit("г/л")).alias("expected_units")).where("length(name) % 2 = 0")


UNIT_ROWS = """rows AS (SELECT id, document_id AS doc_id, CASE WHEN id % 11 = 0 THEN 'Результат' ELSE analyte_name END AS analyte_name, value_num, value_text, CASE id % 4 WHEN 0 THEN '10^9/л (note)' WHEN 1 THEN '| G/L |' WHEN 2 THEN 'мг/дл' END AS unit, CASE WHEN id % 8 = 0 THEN 'first' END AS unit_raw, ref_low, ref_high FROM labs),
fixed AS (SELECT id, doc_id, analyte_name, value_num, value_text, ref_low, ref_high, CASE WHEN unit IS NULL THEN unit_raw ELSE coalesce(unit_raw, unit) END AS unit_raw,
  CASE id % 4 WHEN 0 THEN CASE WHEN known THEN '×10⁹/л' ELSE '10^9/л' END WHEN 1 THEN CASE WHEN known THEN 'г/л' ELSE 'G/L' END WHEN 2 THEN 'мг/дл' END AS unit FROM (SELECT *, analyte_name <> 'Результат' AND length(analyte_name) % 2 = 0 AS known FROM rows))"""


@query("PRS-23", "labs", f"WITH {UNIT_ROWS} SELECT id, analyte_name, unit, unit_raw FROM fixed")
def prs_23(t: Tables) -> DataFrame:
    return parse.correct_units(unit_rows(t), unit_registry(t)).select("id", "analyte_name", "unit", "unit_raw")


@query("PRS-22", "labs", f"""WITH {UNIT_ROWS} SELECT doc_id, count(*) AS total, count(value_num) AS with_value_num, count_if(coalesce(value_text, '') <> '') AS with_value_text, count_if(ref_low IS NOT NULL OR ref_high IS NOT NULL) AS with_ref, count(unit) AS with_unit
FROM fixed WHERE analyte_name <> 'Результат' AND NOT (value_num IS NULL AND value_text IS NULL AND unit IS NULL AND ref_low IS NULL AND ref_high IS NULL) GROUP BY 1""")
def prs_22(t: Tables) -> DataFrame:
    return parse.finished(unit_rows(t), unit_registry(t))[1]


@query("WIN-12", "", """WITH w AS (SELECT l_orderkey AS page, l_linenumber // 3 AS k, concat('w', l_partkey, '-', l_linenumber) AS word, (l_partkey * 8 + l_linenumber) AS x FROM lineitem)
SELECT page, (dense_rank() OVER (PARTITION BY page ORDER BY k) - 1)::INT AS line_no, line FROM (SELECT page, k, string_agg(word, ' ' ORDER BY x) AS line FROM w GROUP BY ALL)""")
def win_12(t: Tables) -> DataFrame:
    """Heights drift by half a point from word to word of a line; lines are twenty apart."""
    y = F.floor(F.col("l_linenumber") / 3) * 20 + F.col("l_linenumber") % 3 * 0.5
    words = t.read("lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("double").alias("x"), y.cast("double").alias("y"), F.concat(F.lit("w"), "l_partkey", F.lit("-"), "l_linenumber").alias("word"))
    return parse.page_lines(words, 3.0)


@query("PRS-17", "", "SELECT conv_id, turn, regexp_matches(lower(concat(text, CASE WHEN conv_id % 3 = 0 THEN ' СИБР' WHEN conv_id % 3 = 1 THEN ' H2 O2' ELSE '' END)), 'сибр|лактулоза') AS breath FROM conversations")
def prs_17(t: Tables) -> DataFrame:
    said = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " СИБР").when(F.col("conv_id") % 3 == 1, " H2 O2").otherwise(""))
    return t.read("conversations").select("conv_id", "turn", parse.is_breath_test(said).alias("breath"))


@query("PRS-19", "", "SELECT doc_id, length(text) / greatest(doc_id % 5, 1) >= 500 AND regexp_matches(text, '[0-9]') AS usable FROM documents")
def prs_19(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", parse.usable_layer(F.col("text"), F.col("doc_id") % 5, 500).alias("usable"))


@query("PRS-20", "", "WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS attempt, count(*) * 7 % 3 + l_linenumber % 2 AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT doc_id, arg_max(attempt, (n_rows, -attempt)) AS attempt, max(n_rows) AS n_rows FROM a GROUP BY 1")
def prs_20(t: Tables) -> DataFrame:
    attempts = t.read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("attempt")).agg((F.count("*") * 7 % 3 + F.col("l_linenumber") % 2).alias("n_rows"))
    return parse.best_attempt(attempts)


@query("PRS-24", "labs", """WITH t AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'норма 5 - 25' ELSE 'до 450' END AS ref_text FROM labs), b AS (SELECT *, CASE WHEN ref_low IS NULL AND ref_high IS NULL THEN CASE WHEN id % 2 = 0 THEN 5.0::DOUBLE END ELSE ref_low END AS low, CASE WHEN ref_low IS NULL AND ref_high IS NULL THEN CASE WHEN id % 2 = 0 THEN 25.0::DOUBLE END ELSE ref_high END AS high FROM t)
SELECT id, analyte_name, value_num, low, high, CASE WHEN value_num IS NULL OR (low IS NULL AND high IS NULL) THEN 'unknown' WHEN value_num < low THEN 'low' WHEN value_num > high THEN 'high' ELSE 'normal' END AS status FROM b""")
def prs_24(t: Tables) -> DataFrame:
    labs = t.labs().withColumn("ref_text", F.when(F.col("id") % 2 == 0, "норма 5 - 25").otherwise("до 450"))
    return parse.facts(labs).drop("shown")


@query("SC-61", "", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'ref' WHEN p_partkey % 4 = 1 THEN 'unit' WHEN p_partkey % 4 = 2 THEN 'name' END AS role FROM part")
def sc_61(t: Tables) -> DataFrame:
    key = F.when(F.col("p_partkey") % 4 == 0, "Reference value").when(F.col("p_partkey") % 4 == 1, "Единицы").when(F.col("p_partkey") % 4 == 2, " Показатель ").otherwise("zzz")
    return t.read("part").select(F.col("p_partkey").alias("id"), parse.role_of(key).alias("role"))


@query("SC-62", "", "SELECT p_partkey AS doc_id, 0 AS ordinal, p_name AS analyte_name, p_size::VARCHAR AS value_raw, 'g' AS unit, concat('1 - ', p_size) AS ref_raw FROM part UNION ALL SELECT p_partkey, 1, p_brand, concat('< ', p_size), NULL, NULL FROM part WHERE p_partkey % 2 = 0")
def sc_62(t: Tables) -> DataFrame:
    """With SC-63 and SC-64: nested tables, one of two cut off."""
    return parse.harvest(payloads(t))


def payloads(t: Tables) -> DataFrame:
    first = F.concat(F.lit('{"показатель": "'), "p_name", F.lit('", "x": "'), "p_size", F.lit('", "unit": "g", "y": "1 - '), "p_size", F.lit('"}'))
    second = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(', {"name": "'), "p_brand", F.lit('", "result": "< '), "p_size", F.lit('"}'))).otherwise("")
    payload = F.concat(F.lit('{"meta": {"a": 1}, "pages": [{"table": ['), first, second, F.when(F.col("p_partkey") % 3 == 0, "]}]}").otherwise(""))
    return t.read("part").select(F.col("p_partkey").alias("doc_id"), payload.alias("payload"))
