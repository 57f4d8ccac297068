"""Scalar functions, each applied to every row of a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.functions import dates, lab, text
from chartlode.operators import ordered
from chartlode.plans.matching import likeness_sql
from chartlode.plans.views import Register, Tables

query = Register()
c = F.col

# Pieces of SQL that several queries share. Column names are written in braces.
NORM = r"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '\s+', ' ', 'g'))"
STRIP = r"trim(trim(regexp_replace(regexp_replace(regexp_replace({x}, '\([^)]*\)', ' ', 'g'), '([\s,]+(%|абс\.?|отн\.?)\s*)+$', ''), '\s+', ' ', 'g')), ' ,')"
ALIASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.UNIT_ALIASES.items()) + "}"
FOLD = "translate(regexp_replace({x}, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)', '^\\1', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
CANON = f"coalesce({ALIASES}[replace(lower(trim({FOLD})), ' ', '')], trim({{x}}))"
NUM = r"-?[0-9]+(?:[.,][0-9]+)?"
FLOAT = "TRY_CAST(translate({x}, ',', '.') AS DOUBLE)"


def of(piece: str, x: str) -> str:
    return piece.replace("{x}", x)


def applied(name: str, sql: str, *columns: str):
    """A query that shows id and the columns that a function of the raw view makes."""

    def add(function):
        @query(name, "raw", f"SELECT id, {sql} FROM raw")
        def run(t: Tables) -> DataFrame:
            return t.raw().select("id", *function())

        return function

    return add


@applied("SC-01", f"{of(NORM, 'name')} AS n")
def sc_01():
    return [text.normalize_name(c("name")).alias("n")]


@applied("SC-02", f"{of(STRIP, of(NORM, 'name'))} AS n")
def sc_02():
    return [text.strip_qualifiers(text.normalize_name(c("name"))).alias("n")]


@applied("SC-03", f"CASE WHEN length({of(STRIP, of(NORM, 'name'))}) > 8 THEN {of(STRIP, of(NORM, 'name'))} ELSE {of(NORM, 'name')} END AS n")
def sc_03():
    return [text.query_name(c("name"), 8).alias("n")]


@applied("SC-04", f"{of(FOLD, 'unit')} AS u")
def sc_04():
    return [text.fold_superscripts(c("unit")).alias("u")]


@applied("SC-05", f"{of(CANON, 'unit')} AS u")
def sc_05():
    return [text.canonical_unit(c("unit")).alias("u")]


NOISE = r"trim(regexp_replace(regexp_replace(trim(unit), '^\s*\|\s*(.+?)\s*\|\s*$', '\1'), '\([^)]*\)', '', 'g'))"
for _ in range(3):
    NOISE = rf"trim(regexp_replace({NOISE}, '^(?:отрицательн[а-яё]*|положительн[а-яё]*|negativ\w*|positiv\w*|не\s+обнаружен[а-яё]*|не\s+обнар\.?)[\s:]+', '', 'i'))"


@applied("SC-06", f"CASE WHEN {NOISE} = '' THEN unit ELSE {NOISE} END AS u")
def sc_06():
    return [text.strip_unit_noise(c("unit")).alias("u")]


MEANT = ("г/л", "ммоль/л", "КП")
#: The likest of what is meant, 85 percent alike at least; of equals the first.
LIKEST = "list_reduce([" + ", ".join(f"{{'score': {likeness_sql(of('lower({x})', of(CANON, 'unit')), repr(e.lower()))}, 'unit': '{e}'}}" for e in MEANT) + "], lambda best, e: CASE WHEN e.score > best.score THEN e ELSE best END)"


@applied("SC-07", f"""CASE WHEN coalesce(unit, '') = '' THEN NULL WHEN {of(CANON, 'unit')} IN {MEANT} THEN {of(CANON, 'unit')}
WHEN {of(CANON, f"(CASE WHEN {NOISE} = '' THEN unit ELSE {NOISE} END)")} IN {MEANT} THEN {of(CANON, f"(CASE WHEN {NOISE} = '' THEN unit ELSE {NOISE} END)")}
WHEN contains(lower(unit), 'г/л') THEN 'г/л' WHEN contains(lower(unit), 'ммоль/л') THEN 'ммоль/л' WHEN contains(lower(unit), 'кп') THEN 'КП' WHEN {LIKEST}.score >= 85 THEN {LIKEST}.unit END AS u""")
def sc_07():
    return [text.correct_unit(c("unit"), F.array(*[F.lit(x) for x in MEANT])).alias("u")]


DIM = r"replace(regexp_replace(regexp_replace(replace(translate(lower(unit), 'ё', 'е'), ' ', ''), '10\^?[0-9]+', '', 'g'), '[0-9]+', '', 'g'), '^', '')"
for words, one in ((text.MASSES, "г"), (text.VOLUMES, "л"), (text.LENGTHS, "м")):
    for word in words:
        DIM = f"replace({DIM}, '{word}', '{one}')"


@applied("SC-08", f"CASE WHEN coalesce(unit, '') <> '' THEN {DIM} END AS d")
def sc_08():
    return [text.unit_dimension(c("unit")).alias("d")]


@applied("SC-09", r"trim(regexp_replace(rtrim(trim(translate(lower(name), 'ё', 'е')), ':'), '\s+', ' ', 'g')) AS k")
def sc_09():
    return [text.name_key(c("name")).alias("k")]


@applied("SC-10", r"trim(regexp_extract(concat(trim(name), ' - ', value), '^([^-–—,(0-9]*)', 1)) AS h")
def sc_10():
    return [text.drug_head(F.concat(F.trim("name"), F.lit(" - "), "value")).alias("h")]


HEAD = "trim(split_part(split_part(medications[{}], ',', 1), '(', 1))"


@query("SC-11", "reports", f"SELECT id, CASE WHEN {HEAD.format(1)} = {HEAD.format(2)} THEN {HEAD.format(1)} ELSE concat({HEAD.format(1)}, '|', {HEAD.format(2)}) END AS heads FROM reports")
def sc_11(t: Tables) -> DataFrame:
    return t.reports().select("id", F.array_join(text.medication_heads(c("medications")), "|").alias("heads"))


@applied("SC-12", r"regexp_matches(lower(name), '(^|[^a-zа-яё0-9_])(елка|ёлка|ring|общ)') AS hit")
def sc_12():
    return [text.starts_word(c("name"), ["елка", "ёлка", "ring", "общ"]).alias("hit")]


@query("SC-13", "raw", "SELECT id, CASE WHEN contains(lower(name), 'общ') THEN 'analysis' WHEN value = '' THEN 'unknown' WHEN contains(value, 'обнаруж') THEN 'report' WHEN contains(lower(name), 'ring') THEN 'report' ELSE 'model' END AS kind FROM raw")
def sc_13(t: Tables) -> DataFrame:
    kind = F.when(F.lower("name").contains("общ"), "analysis").when(c("value") == "", "unknown").when(c("value").contains("обнаруж"), "report").when(F.lower("name").contains("ring"), "report").otherwise("model")
    return t.raw().select("id", kind.alias("kind"))


@applied("SC-14", "contains(ref, '-') OR contains(ref, '<') OR contains(unit, 'г/л') AS is_form")
def sc_14():
    return [(c("ref").contains("-") | c("ref").contains("<") | c("unit").contains("г/л")).alias("is_form")]


@query("SC-15", "", r"""SELECT doc_id, regexp_extract(array_to_string(string_split(text, chr(10))[1:6], chr(10)), '["«]([^"»]+)["»]', 1) AS org FROM documents""")
def sc_15(t: Tables) -> DataFrame:
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 6), "\n")
    return t.read("documents").select("doc_id", F.regexp_extract(head, '["«]([^"»]+)["»]', 1).alias("org"))


CITED = "concat('see [LAB:', doc, ':', id % 10, '] and [REP:', doc % 7, '] or `ACT:', id % 3, '` then [LAB:', doc, ':', id % 10, ']')"


@applied("SC-16", rf"array_to_string(list_sort(list_distinct(regexp_extract_all({CITED}, '\[([A-Z]+:[0-9A-Za-z:_-]+)\]', 1))), ' ') AS strict, array_to_string(list_sort(list_distinct(regexp_extract_all({CITED}, '[\[`]([A-Z]+:[0-9A-Za-z:_-]+)[\]`]', 1))), ' ') AS ticked")
def sc_16():
    return [F.array_join(F.sort_array(text.evidence_ids(F.expr(CITED), ticks)), " ").alias(n) for n, ticks in (("strict", False), ("ticked", True))]


@query("SC-17", "", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-zа-яё]{2,}')))::INT AS words, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda s: translate(s, ',', '.')))), ' ') AS numbers FROM documents")
def sc_17(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.size(text.token_set(c("text"))).alias("words"), F.array_join(F.sort_array(text.number_set(c("text"))), " ").alias("numbers"))


THINK = "concat('<think>', text, '</think> answer ', turn, '.5 ', role)"


@query("SC-18", "", f"SELECT conv_id, turn, regexp_replace({THINK}, '(?is)<think>.*?</think>', '', 'g').trim() AS answer, length(regexp_replace({THINK}, '(?is)<think>.*?</think>', '', 'g').trim()) AS n, regexp_matches(text, '(?i)que|the') AS flagged, len(regexp_extract_all({THINK}, '[0-9]+[.,][0-9]+'))::INT AS decimals FROM conversations")
def sc_18(t: Tables) -> DataFrame:
    answer = text.without_thinking(F.expr(THINK))
    return t.read("conversations").select("conv_id", "turn", answer.alias("answer"), F.length(answer).alias("n"), c("text").rlike("(?i)que|the").alias("flagged"), F.regexp_count(F.expr(THINK), F.lit(r"[0-9]+[.,][0-9]+")).alias("decimals"))


@applied("SC-19", """round(length(regexp_replace(name, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(name, '[^A-Za-zА-Яа-яЁё]', '', 'g')), 0), 6) AS latin,
CASE WHEN length(regexp_replace(name, '[^A-Za-zА-Яа-яЁё]', '', 'g')) = 0 THEN 'none' WHEN length(regexp_replace(name, '[^А-Яа-яЁё]', '', 'g')) >= 0.7 * length(regexp_replace(name, '[^A-Za-zА-Яа-яЁё]', '', 'g')) THEN 'cyrillic'
WHEN length(regexp_replace(name, '[^A-Za-z]', '', 'g')) >= 0.7 * length(regexp_replace(name, '[^A-Za-zА-Яа-яЁё]', '', 'g')) THEN 'latin' ELSE 'mixed' END AS label""")
def sc_19():
    shares = text.script_shares(c("name"))
    return [F.round(shares["latin"], 6).alias("latin"), shares["label"].alias("label")]


@query("SC-20", "", r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s, i: CASE WHEN i % 3 = 1 THEN s || ' [LAB:1]' ELSE s END), lambda s: length(trim(s)) >= 20) AS ls FROM documents) SELECT doc_id, round(CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda s: regexp_matches(s, '\[[A-Z]+:'))) / len(ls) END, 6)::DOUBLE AS ratio FROM l")
def sc_20(t: Tables) -> DataFrame:
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 3 == 0, F.concat(s, F.lit(" [LAB:1]"))).otherwise(s)), "\n")
    return t.read("documents").select("doc_id", F.round(text.citation_ratio(lines), 6).alias("ratio"))


@query("SC-21", "", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-ZÀ-Þ][^.]*\.$'))::INT AS headed, regexp_matches(lower(text), 'licen[sc]e|rights') AS legal FROM documents")
def sc_21(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.regexp_count("text", F.lit(r"(?m)^[A-ZÀ-Þ][^.]*\.$")).alias("headed"), F.lower("text").rlike("licen[sc]e|rights").alias("legal"))


HTML = "regexp_replace(html, '(?s)<.*?>', '', 'g')"
for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{name}', '{char}')"


@query("SC-22", "", f"SELECT page_id, trim({HTML}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS plain FROM pages")
def sc_22(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", text.plain_html(c("html")).alias("plain"))


@applied("SC-23", "replace(string_split(concat('owner/', name, ':8b'), '/')[-1], ':', '-') AS label")
def sc_23():
    return [text.short_label(F.concat(F.lit("owner/"), "name", F.lit(":8b"))).alias("label")]


@query("SC-24", "", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sc_24(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@applied("SC-25", "concat_ws('. ', nullif(trim(name), ''), nullif(trim(unit), ''), nullif(trim(value), '')) AS chunk")
def sc_25():
    return [text.joined(c("name"), c("unit"), c("value")).alias("chunk")]


SHOW = "CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


@applied("SC-26", f"CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN concat({of(SHOW, 'low')}, '–', {of(SHOW, 'high')}) WHEN low IS NOT NULL THEN concat('от ', {of(SHOW, 'low')}) WHEN high IS NOT NULL THEN concat('до ', {of(SHOW, 'high')}) WHEN coalesce(ref, '') <> '' THEN ref ELSE 'не указан' END AS shown")
def sc_26():
    return [text.reference_text(c("low"), c("high"), c("ref")).alias("shown")]


@applied("SC-30", f"{of(FLOAT, 'value')} AS f")
def sc_30():
    return [lab.to_float(c("value")).alias("f")]


VALUE_NUM = f"CASE WHEN NOT regexp_matches(trim(value), '^[<>≤≥]') THEN {of(FLOAT, f"nullif(regexp_extract(trim(value), '^({NUM})', 1), '')")} END"
VALUE_TEXT = f"CASE WHEN trim(value) <> '' AND NOT regexp_matches(trim(value), '^{NUM}') THEN trim(value) END"


@applied("SC-31", f"{VALUE_NUM} AS num, {VALUE_TEXT} AS text")
def sc_31():
    v = lab.lab_value(c("value"))
    return [v["num"].alias("num"), v["text"].alias("text")]


JOINED = r"regexp_replace(regexp_replace(trim(ref), '([0-9])\s+([0-9])', '\1\2', 'g'), '([0-9])\s+([0-9])', '\1\2', 'g')"
SPAN, UP, DOWN = rf"^({NUM})\s*[-–—]\s*({NUM})$", rf"^[<≤]\s*({NUM})$", rf"^[>≥]\s*({NUM})$"
FIND = lambda pattern, k: of(FLOAT, f"nullif(regexp_extract({JOINED}, '{pattern}', {k}), '')")


@applied("SC-32", f"""coalesce({FIND(SPAN, 1)}, {FIND(DOWN, 1)}) AS r_low, coalesce({FIND(SPAN, 2)}, {FIND(UP, 1)}) AS r_high, CASE WHEN regexp_matches({JOINED}, '{UP}') THEN '<' WHEN regexp_matches({JOINED}, '{DOWN}') THEN '>' END AS op,
CASE WHEN {JOINED} <> '' AND NOT regexp_matches({JOINED}, '{SPAN}|{UP}|{DOWN}') THEN {JOINED} END AS r_text""")
def sc_32():
    r = lab.reference(c("ref"))
    return [r["low"].alias("r_low"), r["high"].alias("r_high"), r["op"].alias("op"), r["text"].alias("r_text")]


POS = r"[0-9]+(?:[.,][0-9]+)?"
SEARCH = lambda pattern, k: of(FLOAT, f"nullif(regexp_extract(ref, '{pattern}', {k}), '')")
RANGED = rf"({POS})\s*[-–—]\s*({POS})"


@applied("SC-33", rf"CASE WHEN regexp_matches(ref, '{RANGED}') THEN {SEARCH(RANGED, 1)} WHEN NOT regexp_matches(ref, '[<≤]\s*{POS}') THEN {SEARCH(rf'[>≥]\s*({POS})', 1)} END AS f_low, CASE WHEN regexp_matches(ref, '{RANGED}') THEN {SEARCH(RANGED, 2)} ELSE {SEARCH(rf'[<≤]\s*({POS})', 1)} END AS f_high")
def sc_33():
    r = lab.reference_in_text(c("ref"))
    return [r["low"].alias("f_low"), r["high"].alias("f_high")]


@applied("SC-34", "CASE WHEN num IS NULL OR (low IS NULL AND high IS NULL) THEN 'unknown' WHEN num < low THEN 'low' WHEN num > high THEN 'high' ELSE 'normal' END AS status")
def sc_34():
    return [lab.status(c("num"), c("low"), c("high")).alias("status")]


@applied("SC-35", "CASE WHEN num < low THEN '↓' WHEN num > high THEN '↑' ELSE '' END AS marker")
def sc_35():
    return [lab.marker(c("num"), c("low"), c("high")).alias("marker")]


@applied("SC-36", "CASE WHEN high - low > 0 AND num IS NOT NULL THEN least(100.0, greatest(0.0, 25 + 50 * (num - low) / (high - low))) END::DOUBLE AS place")
def sc_36():
    return [lab.position(c("num"), c("low"), c("high")).alias("place")]


@applied("SC-37", rf"array_to_string(list_transform(regexp_extract_all(concat(ref, ' ; ', value), '{POS}'), lambda s: regexp_replace(translate(s, ',', '.'), '\.0$', '')), ' ') AS tokens")
def sc_37():
    return [F.array_join(lab.number_tokens(F.translate(F.concat("ref", F.lit(" ; "), "value"), "-", " ")), " ").alias("tokens")]


@applied("SC-38", rf"regexp_matches(ref, '^{NUM}\s*[-–—]\s*{NUM}$|^[<≤>≥]\s*{NUM}$') AS is_ref, regexp_matches(trim(value), '^-?[0-9]') AS is_number")
def sc_38():
    return [lab.looks_like_reference(c("ref")).alias("is_ref"), lab.looks_like_number(c("value")).alias("is_number")]


@applied("SC-39", "round(num * 37 / pow(10, greatest(0, ceil(log10(greatest(num * 37, 1e-9) / 15)))), 6) AS v")
def sc_39():
    return [F.round(lab.unmerge(c("num") * 37), 6).alias("v")]


@applied("SC-41", "CASE WHEN num / 60 <= 1 THEN round(num / 60 * 100, 1) ELSE num END AS spo2, round(num * 997 / 1000, 2) AS kg, num * 3600 AS seconds")
def sc_41():
    return [F.when(c("num") / 60 <= 1, F.round(c("num") / 60 * 100, 1)).otherwise(c("num")).alias("spo2"), F.round(c("num") * 997 / 1000, 2).alias("kg"), (c("num") * 3600).alias("seconds")]


@applied("SC-42", f"CASE WHEN doc % 3 > 0 AND unit IS NOT NULL AND doc % 5 > 0 THEN {of(CANON, 'unit')} NOT IN ('г/л', '×10⁹/л') END AS mismatch")
def sc_42():
    expected = F.when(c("doc") % 5 > 0, F.array(F.lit("g/l"), F.lit("10^9/l"))).otherwise(F.array().cast("array<string>"))
    return [lab.unit_mismatch(F.when(c("doc") % 3 > 0, "matched").otherwise("unverified"), c("unit"), expected).alias("mismatch")]


@query("SC-43", "labs", "WITH p AS (SELECT document_id FROM labs WHERE analyte_name IN ('red widget', 'small ring', 'large bolt') GROUP BY 1 HAVING count(DISTINCT analyte_name) >= 2) SELECT id, CASE WHEN document_id IN (SELECT document_id FROM p) AND analyte_name IN ('red widget', 'small ring', 'large bolt') THEN 'Гематология' ELSE analyte_group END AS grp FROM labs")
def sc_43(t: Tables) -> DataFrame:
    from chartlode.operators.aggregates import panels

    core = ["red widget", "small ring", "large bolt"]
    panel = panels(t.labs(), core, 2).select("document_id", F.lit(True).alias("panel"))
    return t.labs().join(panel, "document_id", "left").select("id", F.when(c("panel") & c("analyte_name").isin(core), "Гематология").otherwise(c("analyte_group")).alias("grp"))


@applied("SC-44", "CASE WHEN num > 3 AND doc % 50 > 0 THEN round(round((doc % 50) / num, 6) + 1e-9, 2) END AS rate")
def sc_44():
    return [lab.rate(c("doc") % 50, F.when(c("num") > 3, c("num"))).alias("rate")]


@applied("SC-45", "((doc % 256) << 8 | (id % 256))::BIGINT AS rpm")
def sc_45():
    return [F.shiftleft(c("doc") % 256, 8).bitwiseOR(c("id") % 256).alias("rpm")]


@applied("SC-46", "coalesce(abs(num - (num + CASE WHEN doc % 2 = 0 THEN 1e-7 ELSE 1e-3 END)) <= 1e-6, FALSE) AS same")
def sc_46():
    return [lab.near(c("num"), c("num") + F.when(c("doc") % 2 == 0, F.lit(1e-7)).otherwise(F.lit(1e-3))).alias("same")]


DAY = r"""coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d.%m.%Y'), try_strptime(day, '%d/%m/%Y'),
try_strptime(regexp_replace(replace(replace(replace(day, ' марта ', '-03-'), ' мая ', '-05-'), ' декабря ', '-12-'), ' г\.$', ''), '%d-%m-%Y'))"""


@applied("SC-50", f"{DAY} AS taken_at")
def sc_50():
    return [dates.parse_date(c("day")).alias("taken_at")]


@applied("SC-51", "coalesce(CASE WHEN regexp_matches(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(day, '%Y-%m-%d') END, CASE WHEN regexp_matches(day, '^[0-9]{2}.[0-9]{2}.[0-9]{4}$') THEN coalesce(try_strptime(day, '%d.%m.%Y'), try_strptime(day, '%d/%m/%Y')) END)::DATE AS d")
def sc_51():
    return [dates.strict_date(c("day")).alias("d")]


@query("SC-52", "labs", "SELECT id, (taken_at::DATE - INTERVAL 1 MONTH)::DATE AS month, (taken_at::DATE - INTERVAL 3 MONTH)::DATE AS quarter, (taken_at::DATE - INTERVAL 12 MONTH)::DATE AS year FROM labs")
def sc_52(t: Tables) -> DataFrame:
    day = F.to_date("taken_at")
    return t.labs().select("id", dates.preset("month", day).alias("month"), dates.preset("3m", day).alias("quarter"), dates.preset("year", day).alias("year"))


@query("SC-53", "docs", "SELECT id, date_trunc('month', created_at)::TIMESTAMP AS m_from, (last_day(created_at) + INTERVAL 86399 SECOND)::TIMESTAMP AS m_to, (created_at::DATE + INTERVAL 86399 SECOND)::TIMESTAMP AS d_to FROM docs")
def sc_53(t: Tables) -> DataFrame:
    month, day = dates.period(F.date_format("created_at", "yyyy-MM")), dates.period(F.date_format("created_at", "yyyy-MM-dd"))
    return t.documents().select("id", month["from"].alias("m_from"), month["to"].alias("m_to"), day["to"].alias("d_to"))


@query("SC-54", "docs", "SELECT id, (date_sub('year', created_at::DATE, DATE '2024-02-29'))::INT AS age FROM docs")
def sc_54(t: Tables) -> DataFrame:
    return t.documents().select("id", dates.age(F.to_date("created_at"), F.lit("2024-02-29").cast("date")).alias("age"))


NOTE = "concat(CASE WHEN doc % 3 = 0 THEN 'Дата осмотра: 05.03.2021 ' ELSE '' END, 'Дата рождения 01.02.1980, ', CASE WHEN doc % 2 = 0 THEN 'подписано врачом клиники в городе, протокол номер сорок два от 17/11/2020' ELSE '' END)"


@applied("SC-55", "CASE WHEN doc % 3 = 0 THEN DATE '2021-03-05' WHEN doc % 2 = 0 THEN DATE '2020-11-17' END AS visited")
def sc_55():
    return [dates.visit_date(F.expr(NOTE)).alias("visited")]


@applied("SC-57", "CASE WHEN doc % 7 = 0 THEN DATE '2000-01-01' WHEN doc % 3 = 0 THEN DATE '2021-03-05' WHEN doc % 2 = 0 THEN DATE '2020-11-17' END AS visited")
def sc_57():
    blob = F.array_join(F.concat(F.array(c("name"), c("value")), F.array(F.expr(NOTE))), "\n")
    return [F.coalesce(F.when(c("doc") % 7 == 0, F.lit("2000-01-01").cast("date")), dates.visit_date(blob)).alias("visited")]


@applied("SC-56", "to_same AS same_day".replace("to_same", f"({DAY})::DATE = DATE '2019-05-07'"))
def sc_56():
    return [dates.same_day(dates.parse_date(c("day")), F.lit("2019-05-07").cast("date")).alias("same_day")]


JSON = """CASE id % 4 WHEN 0 THEN concat('["', name, '","b"]') WHEN 1 THEN '[' WHEN 2 THEN NULL ELSE '{"a":1}' END"""


@applied("SC-60", "CASE WHEN id % 4 = 0 THEN concat(name, '|b') ELSE '' END AS items")
def sc_60():
    return [F.array_join(F.coalesce(F.from_json(F.expr(JSON), "array<string>"), F.array().cast("array<string>")), "|").alias("items")]


@query("SC-65", "labs", """SELECT id, sha256(concat('{"id":', id, ',"name":"', analyte_name, '"', CASE WHEN unit IS NULL THEN '' ELSE concat(',"unit":"', unit, '"') END, '}')) AS sha FROM labs""")
def sc_65(t: Tables) -> DataFrame:
    return t.labs().select("id", F.sha2(F.to_json(F.struct("id", F.col("analyte_name").alias("name"), "unit")), 256).alias("sha"))


@applied("SC-66", "CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN value ELSE unit END AS parameter")
def sc_66():
    j = F.when(c("id") % 3 == 0, F.to_json(F.struct(c("name").alias("parameter")))).when(c("id") % 3 == 1, F.to_json(F.struct(c("value").alias("analyte_name")))).otherwise(F.to_json(F.struct(c("unit").alias("test_name"))))
    return [F.coalesce(*[F.get_json_object(j, f"$.{k}") for k in ("parameter", "name", "analyte_name", "test_name")]).alias("parameter")]


@query("SC-67", "reports", "SELECT concat('MED:', id, ':', p) AS fact_id, medications[p + 1] AS line FROM (SELECT id, medications, unnest(range(0, len(medications))) AS p FROM reports)")
def sc_67(t: Tables) -> DataFrame:
    return t.reports().select("id", F.posexplode("medications").alias("p", "line")).select(F.concat_ws(":", F.lit("MED"), c("id").cast("string"), c("p").cast("string")).alias("fact_id"), "line")


@query("SC-68", "labs", "WITH p AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY id, taken_at, value_num) - 1 AS place FROM labs) SELECT document_id, place // 3 AS batch, array_to_string(list(id ORDER BY place), ',') AS ids FROM p GROUP BY ALL")
def sc_68(t: Tables) -> DataFrame:
    out = ordered.facts_in_batches(t.labs(), "document_id", ["id", "taken_at", "value_num"], 3)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
