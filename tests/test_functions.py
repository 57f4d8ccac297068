"""Functions and parsers on the cases that matter."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartlode.functions import dates, lab, text
from chartlode.operators import fuzzy, ordered, parse, scoring, vectors


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_lab_values(spark):
    got = column(spark, ["40.8", " 5,4 ", "44.6*", "9 мм/ч", "< 5", "не обнаружено", "", None, "-3"], lab.lab_value)
    assert [(r["num"], r["text"]) for r in got] == [(40.8, None), (5.4, None), (44.6, None), (9.0, None), (None, "< 5"), (None, "не обнаружено"), (None, None), (None, None), (-3.0, None)]


def test_references(spark):
    got = column(spark, ["35 - 45", "35–45", "1 010 - 1 023", "≤ 5", "> 10,5", "до 450", "", None], lab.reference)
    assert [tuple(r) for r in got] == [(35, 45, None, None), (35, 45, None, None), (1010, 1023, None, None), (None, 5, "<", None), (10.5, None, ">", None), (None, None, None, "до 450"), (None,) * 4, (None,) * 4]
    found = column(spark, ["220 - 450 umol/L", "0,4 - 4,0", "< 5", "≤ 5 мг/л", "> 10", "до 450", "", None], lab.reference_in_text)
    assert [tuple(r) for r in found] == [(220, 450), (0.4, 4.0), (None, 5), (None, 5), (10, None), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize(("value", "low", "high", "want"), [(119.0, 120.0, 150.0, "low"), (151.0, 120.0, 150.0, "high"), (135.0, 120.0, 150.0, "normal"), (120.0, 120.0, 150.0, "normal"), (5.0, None, None, "unknown"), (5.0, None, 4.0, "high"), (5.0, 6.0, None, "low"), (None, 1.0, 2.0, "unknown")])
def test_status(spark, value, low, high, want):
    df = spark.createDataFrame([(value, low, high)], "v double, l double, h double")
    assert df.select(lab.status(F.col("v"), F.col("l"), F.col("h"))).first()[0] == want


def test_names_and_units(spark):
    assert column(spark, ["  Тромбоциты (общ. число), абс., % ", "MCV, %", "Ёлка"], text.query_name) == ["тромбоциты", "mcv, %", "елка"]
    assert column(spark, ["10⁹/л", "X10^9/L", " G/L ", "чего-то", None], text.canonical_unit) == ["×10⁹/л", "×10⁹/л", "г/л", "чего-то", None]
    assert column(spark, ["Отрицательный  Отрицательный КП", "| г/л |", "% (алгоритм)", "(x)"], text.strip_unit_noise) == ["КП", "г/л", "%", "(x)"]
    assert column(spark, ["мкг/дл", "г/л", "10^9/л", "%", None], text.unit_dimension) == ["г/л", "г/л", "/л", "%", None]


def test_dates(spark):
    d = datetime.datetime
    got = column(spark, ["2024-05-01T10:20:30", "2024-05-01", "01.05.2024 10:20", "1/5/2024", "3 марта 2021 г.", "5 мая 2020", "вчера", None], dates.parse_date)
    assert got == [d(2024, 5, 1, 10, 20, 30), d(2024, 5, 1), d(2024, 5, 1, 10, 20), d(2024, 5, 1), d(2021, 3, 3), d(2020, 5, 5), None, None]
    notes = ["Дата рождения 01.02.1980, приём от: 5.3.2021", "д.р. 01.02.1980 " + "x" * 60 + " 17/11/2020 и 01.02.1980", "рождён 01.02.1980", "", None]
    assert column(spark, notes, dates.visit_date) == [datetime.date(2021, 3, 5), datetime.date(2020, 11, 17), None, None, None]
    assert column(spark, ["2024-02", "2024-02-10"], lambda x: dates.period(x)["to"]) == [d(2024, 2, 29, 23, 59, 59), d(2024, 2, 10, 23, 59, 59)]
    assert column(spark, ["2000-02-29", "2000-03-01"], lambda x: dates.age(x.cast("date"), F.lit("2024-02-29").cast("date"))) == [24, 23]


def test_compact_rows(spark):
    form = "| Показатель | Значение |\n|---|---|\n| Лейкоциты | 4.14 | 4 - 8,8 | |\nОАМ|Эритроциты|1|в п/зр.|< 5\nБелок|не обнар.||\nимя|5\n|пусто||\nГемоглобин|140|г/л/|130 - 160"
    got = parse.compact_rows(spark.createDataFrame([(1, form), (2, None), (3, "")], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r.analyte_name, r.value_raw, r.unit, r.ref_raw) for r in got] == [("Лейкоциты", "4.14", None, "4 - 8,8"), ("Эритроциты", "1", "в п/зр.", "< 5"), ("Белок", "не обнар.", None, None), ("Гемоглобин", "140", "г/л", "130 - 160")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Относительная плотность 1017 г/л 1003 - 1035 pH 5.5 5 - 8", [("Относительная плотность", "1017", "г/л", "1003 - 1035"), ("pH", "5.5", None, "5 - 8")]),
        ("Са 125 8.13 Ед/мл < 35", [("Са 125", "8.13", "Ед/мл", "<35")]),
        ("MCH (содержание Hb в 1 Эр.) 30,1 пг 27-34", [("MCH (содержание Hb в 1 Эр.)", "30,1", "пг", "27-34")]),
        ("Глюкоза Cobas 6000 5,1* ммоль/л 3,9 - 6,1", [("Глюкоза Cobas 6000", "5,1*", "ммоль/л", "3,9 - 6,1")]),
        ("Тел. 8 495 123", []),
        ("12 34 - 56", []),
        ("Плотность 1 010 г/л 1 010 - 1 023", []),
    ],
)
def test_text_layer_lines(line, want):
    assert list(parse.line_results(line))[: max(1, len(want))] == want or not want


def test_json_harvest():
    assert parse.repaired('{"a": [1, {"b": "x') == {"a": [1, {"b": "x"}]}
    assert parse.repaired("") is None
    data = {"p": [{"Показатель": "Hb", "Результат": "140", "норма": "130 - 160"}, {"x": "RBC", "y": "4.5", "z": "4 - 5"}], "q": [{"a": 1}, {"name": "not a row"}]}
    assert parse.harvested(data) == [{"name": "Hb", "value": "140", "unit": None, "ref": "130 - 160"}, {"name": "RBC", "value": "4.5", "unit": None, "ref": "4 - 5"}]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distances(a, b):
    import duckdb

    want = duckdb.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchone()[0]
    assert fuzzy.damerau(a, b) == want
    assert fuzzy.common(a, b) == max((len(s) for s in subsequences(a) if s in subsequences(b)), default=0)


def subsequences(s):
    out = {""}
    for c in s:
        out |= {x + c for x in out}
    return out


def test_matching_rules(spark):
    registry = spark.createDataFrame([("Гемоглобин", 1, ["hgb"]), ("Лейкоциты", 2, ["wbc", "гемоглобин"]), ("MCV", 3, None)], "name string, ordinal long, synonyms array<string>")
    index = fuzzy.key_index(registry, text.normalize_name, synonyms="synonyms")
    asked = spark.createDataFrame([(q,) for q in ("гемоглобин", "гемоглобн", "wbc", "mc", "лейкоцыты", "совсем иное", "", None)], "query string")
    got = {r["query"]: (r["status"], r["record"], r["distance"]) for r in fuzzy.match(asked, index, max_edit_ratio=0.35, ratio_floor=75, short=3).collect()}
    assert got == {"гемоглобин": ("matched", 1, 0), "гемоглобн": ("matched", 1, 1), "wbc": ("matched", 2, 0), "mc": ("unverified", None, None), "лейкоцыты": ("matched", 2, 1), "совсем иное": ("unverified", None, None), "": ("unverified", None, None), None: ("unverified", None, None)}
    floor = fuzzy.match(asked.where("query = 'гемоглобн'"), index, max_edit_ratio=0.35, ratio_floor=99).first()
    assert (floor["status"], floor["distance"]) == ("unverified", 1) and 94 < floor["ratio"] < 99


def test_moving_average(spark):
    df = spark.createDataFrame([("a", 1, 40.0), ("a", 2, 100.0), ("b", 1, 7.0), ("b", 2, None)], "k string, t int, v double")
    assert {r.k: (r.ema, r.samples) for r in ordered.ema(df, "k", ["t"], "v").collect()} == {"a": (58.0, 2), "b": (7.0, 1)}


def test_packages_are_the_same_in_any_order(spark):
    rows = [(1, f"n{k}", float(k)) for k in range(9)]
    sha = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        sha.add(scoring.packages(spark.createDataFrame(rows, "user_id long, name string, v double").repartition(3), ["user_id"]).first()["sha256"])
    assert len(sha) == 1


def test_search_filters_after_it_oversamples(spark):
    chunks = spark.createDataFrame([(k, "drug" if k > 9 else "health", 7 if k % 2 else None, f"r{k}", [float(k), 0.0]) for k in range(20)], "chunk_id long, source string, user_id long, ref_key string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert vectors.search(chunks, asked, 2, source="drug").count() == 0
    assert [r.id for r in vectors.search(chunks, asked, 2, source="drug", prefilter=True).orderBy("place").collect()] == [10, 12]
    assert [r.id for r in vectors.search(chunks, asked, 2, user_id=7).orderBy("place").collect()] == [0, 1]
    with pytest.raises(ValueError):
        vectors.nearest(chunks, asked, 1, cell=(0, 8))


def test_any_number_of_queries_is_answered_in_blocks(spark):
    chunks = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(30)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(q, [q + 0.2, 0.0]) for q in range(7)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.place, r.id) for r in vectors.nearest(chunks, asked, 2, cell=(3, 8)).collect()}
    assert got == {(q, place, q + place - 1) for q in range(7) for place in (1, 2)}
    assert vectors.nearest(chunks, asked.limit(0), 2).count() == 0


def test_citations_of_large_keys_are_valid(spark, tmp_path):
    from chartlode.plans.changes import Tables, evl_06

    spark.createDataFrame([(20_000_000,), (20_000_003,), (7,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.id, r.precision) for r in evl_06(Tables(spark, str(tmp_path))).collect()} == {(20_000_000, 0.5), (20_000_003, 0.5), (7, 0.5)}


def test_character_references_are_all_decoded(spark):
    from chartlode.functions.text import plain_html

    rows = [(0, " <p>caf&eacute; &#8217;s&#x2019; &amp;lt; &nbsp;&unknown; </p>\n"), (1, None), (2, "<br>")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, x string").select("i", plain_html(F.col("x")).alias("s")).collect()}
    assert got == {0: "café ’s’ &lt;  &unknown;", 1: None, 2: ""}


def test_references_that_a_tag_cuts_stay(spark):
    from chartlode.functions.text import plain_html

    rows = [(0, "a &amp<script>p</script> &am<b>p;</b> &notit; &amp"), (1, "&ltb &lt;b&gt &#39 &#39;")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, x string").select("i", plain_html(F.col("x")).alias("s")).collect()}
    assert got == {0: "a &ampp & &notit; &amp", 1: "&ltb <b&gt &#39 '"}


def test_summary_table_ends_at_the_failures(spark):
    from chartlode.sources import readers

    log = """[E2E] a.pdf
    [METRICS] tps=10 matched=1/2
    a.pdf  PASS   9.0s   9.0s  9.0s   1  1  0
    ===== ИТОГОВАЯ СВОДКА E2E =====
    a.pdf  PASS   10.5s   38.0s  48.5s      1.00     —        0
    b.v2.pdf  SKIP   0.5s   0.0s  0.5s      0.50     0.25        -
    short.pdf  PASS   10.5s   38.0s
    bad.pdf  PASS   1.5   38.0s  48.5s      1.00     1.00        0
    nodot  PASS   1.5s   38.0s  48.5s      1.00     1.00        0
    Документов: 2""".split("\n") + ["ПРОВАЛЫ", "late.pdf  FAIL   1.0s   1.0s  2.0s   1  1  0"]
    rows = [("x", k, s.strip()) for k, s in enumerate(log)] + [("y", 0, log[4]), ("z", 1, "ПРОВАЛЫ"), ("z", 2, "# ИТОГОВАЯ СВОДКА E2E"), ("z", 3, log[5]), ("z", None, log[5]), ("z", 4, None)]
    got = readers.log_summary(spark.createDataFrame(rows, "file string, line_no long, line string")).orderBy("file", "doc").collect()
    assert [tuple(r) for r in got] == [
        ("x", "a.pdf", "PASS", 10.5, 38.0, 48.5, 1.0, 0.0, 10.0, 1.0, 2.0),
        ("x", "b.v2.pdf", "SKIP", 0.5, 0.0, 0.5, 0.5, 0.25, 0.0, 0.0, 0.0),
        ("z", "b.v2.pdf", "SKIP", 0.5, 0.0, 0.5, 0.5, 0.25, 0.0, 0.0, 0.0),
    ]


def test_birth_dates_of_names_with_one_two_or_none(spark):
    from chartlode.operators import joins

    people = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 5), (4, "b", 6), (5, "b", None), (6, "c", None), (7, None, 9), (8, None, None), (9, "a", 5)], "id long, name string, birth long")
    assert {r.id: r.birth for r in joins.impute_birth(people).collect()} == {1: 5, 2: 5, 3: 5, 4: 6, 5: None, 6: None, 7: 9, 8: None, 9: 5}
    assert joins.impute_birth(people.where("false")).count() == 0


def plan_of(spark, function) -> str:
    """What is computed of a text, after Spark has optimized it."""
    rows = spark.createDataFrame([("x",)], "x string").select(function(F.concat(F.lit("given "), "x")).alias("y"))
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_visit_date_computes_its_text_once(spark):
    plan = plan_of(spark, dates.visit_date)
    assert (plan.count("given "), plan.count("regexp_extract("), plan.count("locate(")) == (1, 1, 1)


def test_units_are_stripped_once(spark):
    plan = plan_of(spark, lambda x: text.correct_unit(x, F.array(F.lit("г/л"), F.lit("КП"))))
    assert plan.count("regexp_extract(") == 2  # a word of quality and the one after it


def test_units_near_an_expected_one_are_meant(spark):
    """The likest expected unit from 85 percent on, the first one of equals, beside their likeness by a plain table."""

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            before, best = best, [0]
            for j, y in enumerate(b):
                best.append(before[j] + 1 if x == y else max(before[j + 1], best[j]))
        return best[-1]

    def plain(unit, expected):
        scores = [200 * common(unit.lower(), e.lower()) / (len(unit) + len(e)) for e in expected]
        best = max(range(len(expected)), key=lambda k: (scores[k], -k))
        return expected[best] if scores[best] >= 85 else None

    assert column(spark, ["мкМЕ/л", "МКМЕ/МЛ.", "фл", "", None], lambda x: text.correct_unit(x, F.array(F.lit("мкМЕ/мл")))) == ["мкМЕ/мл", "мкМЕ/мл", None, None, None]
    assert column(spark, ["нмолл"], lambda x: text.correct_unit(x, F.array(F.lit("г/л"), F.lit("нмоль/л"), F.lit("нмолль")))) == ["нмолль"]  # 83 and 91
    assert column(spark, ["ммолъ/л"], lambda x: text.correct_unit(x, F.array(F.lit("ммоль/л"), F.lit("ммолы/л")))) == ["ммоль/л"]
    rng = random.Random(7)
    expected = ["abcabcab", "abdabcab", "cabcabca", "bbbbbbbbbbbbbbbbbbbb"]
    units = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for e in expected * 12:
        i = rng.randrange(len(e))
        units += [e[:i] + rng.choice("abcd") + e[i + 1 :], e[:i] + e[i + 1 :], e[:i] + "d" + e[i:]]
    units = [u for u in units if not any(e in u for e in expected)]
    got = column(spark, units, lambda x: text.correct_unit(x, F.array(*[F.lit(e) for e in expected])))
    assert got == [plain(u, expected) for u in units] and 20 < sum(g is not None for g in got) < len(got)


def test_bound_text_keeps_results(spark):
    notes = ["Дата рождения 01.02.1980, запись 31.02.2020, затем 3/4/2020", "дата приема 5.6.21", "дата приема 5.6.211 и 07.08.2021", "", None, "1.1.2020 и д.р. 2.2.2000"]
    assert column(spark, notes, dates.visit_date) == [datetime.date(2020, 4, 3), datetime.date(2021, 6, 5), datetime.date(2021, 8, 7), None, None, None]
    expected = F.array(F.lit("г/л"), F.lit("КП"))
    units = ["G/L", "| г/л |", "Не  обнаружено: кп", "не обнаружено", "отрицательный", "в г/л крови", "%", "", None]
    assert column(spark, units, lambda x: text.correct_unit(x, expected)) == ["г/л", "г/л", "КП", None, "КП", "г/л", None, None, None]
    assert column(spark, units, text.strip_unit_noise) == ["G/L", "г/л", "кп", "не обнаружено", "отрицательный", "в г/л крови", "%", "", None]


def test_a_log_is_sent_once(spark):
    """Lines meet by file once, and nothing is written between; a row that stands twice is twice, one at the number of the failures' heading is none."""
    import __spark_entry__
    from chartlode.sources import readers

    row = "{}  PASS   1.5s   2.0s  3.5s   1  0.5  0"
    log = [(1, "[E2E] a.pdf"), (2, "tps=4 matched=1/2"), (2, "tps=5"), (3, "[E2E] b.pdf"), (4, "== ИТОГОВАЯ СВОДКА E2E"), (5, row.format("b.pdf")), (6, row.format("a.pdf")), (6, row.format("a.pdf")), (7, row.format("a.pdf")), (7, "ПРОВАЛЫ"), (7, row.format("c.pdf")), (8, row.format("a.pdf"))]
    found = readers.log_summary(spark.createDataFrame([("x", n, s) for n, s in log] + [(None, n, s) for n, s in log], "file string, line_no long, line string"))
    want = [("x", d, "PASS", 1.5, 2.0, 3.5, 1.0, 0.5, *m) for d, m in (("a.pdf", (4.5, 1.0, 2.0)), ("a.pdf", (4.5, 1.0, 2.0)), ("b.pdf", (0.0, 0.0, 0.0)))]
    assert sorted(tuple(r) for r in found.collect()) == want
    for df in (found, __spark_entry__.queries()["SRC-15b"](spark, "/root/testdata/sf0.001")):
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
