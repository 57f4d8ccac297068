"""Operators on small cases by hand: repeated ids, long lines, refusals."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chartlode.functions import dates
from chartlode.operators import aggregates, ordered, panels, parse, scoring


def test_answers_of_one_id_keep_their_own_rows(spark):
    payload = '{"results": [{"name": "a", "value": "1"}, {"name": "A", "value": "1"}]}'
    rows = parse.flatten_analysis(spark.createDataFrame([(1, payload), (1, payload), (2, payload)], "doc_id int, payload string")).collect()
    assert sorted((r.doc_id, r.analyte_name) for r in rows) == [(1, "a"), (1, "a"), (2, "a")]


def test_fields_far_along_a_line_are_kept(spark):
    line = "|".join(["group"] + ["x"] * 1500 + ["iron", "7,5", "g", "1 - 9"])
    (row,) = parse.compact_rows(spark.createDataFrame([(1, line)], "doc_id int, text string")).collect()
    assert (row.analyte_name, row.value_raw, row.unit, row.ref_raw) == ("iron", "7,5", "g", "1 - 9")


def plain_lines(words, tolerance):
    lines = []
    for y, x, w in sorted(words, key=lambda w: w[:2]):
        if lines and abs(y - sum(v[0] for v in lines[-1]) / len(lines[-1])) <= tolerance:
            lines[-1].append((y, x, w))
        else:
            lines.append([(y, x, w)])
    return [s for own in lines if (s := " ".join(w for _, _, w in sorted(own, key=lambda v: v[1])).strip())]


def test_lines_follow_the_mean_height_of_their_words(spark):
    import random

    rng = random.Random(4)
    pages = {p: [(round(rng.uniform(0, 60), 1), float(k), rng.choice(["a", "b", " ", "cd"]) + str(k) if rng.random() > 0.05 else " ") for k in range(60)] for p in range(5)}
    pages[9] = [(k * 0.9, float(-k), f"w{k}") for k in range(30)]  # drifts off its first word, not off its mean
    rows = [(p, x, y, w) for p, words in pages.items() for y, x, w in words] + [(7, None, 1.0, "x"), (8, 1.0, 1.0, " ")]
    got = parse.page_lines(spark.createDataFrame(rows, "page int, x double, y double, word string"), 2.0).collect()
    assert {p: [r.line for r in sorted(got, key=lambda r: r.line_no) if r.page == p] for p in pages} == {p: plain_lines(w, 2.0) for p, w in pages.items()}
    assert not [r for r in got if r.page in (7, 8)]
    assert parse.page_lines(spark.createDataFrame([], "page int, x double, y double, word string"), 2.0).count() == 0


def test_unit_corrections_keep_what_was_there(spark):
    rows = spark.createDataFrame([("Iron", "мг/л (x)", None), ("iron", "| G/L |", ""), ("Iron", None, None), ("other", "g (note)", "first")], "analyte_name string, unit string, unit_raw string")
    registry = spark.createDataFrame([("IRON", ["мг/л", "г/л"])], "name string, expected_units array<string>")
    got = sorted((r.analyte_name, r.unit or "", r.unit_raw or "") for r in parse.correct_units(rows, registry).collect())
    assert got == sorted([("Iron", "мг/л", "мг/л (x)"), ("iron", "г/л", "| G/L |"), ("Iron", "", ""), ("other", "g", "first")])


def test_averages_equal_a_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(k, i, rng.uniform(-50, 50) if rng.random() > 0.1 else None) for k, n in (("a", 1), ("b", 7), ("c", 4000)) for i in range(n)]
    got = {r.k: (r.ema, r.samples) for r in ordered.ema(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    for k in "abc":
        own = [v for kk, _, v in rows if kk == k and v is not None]
        e = own[0] if own else None
        for v in own[1:]:
            e = e * 0.7 + v * 0.3
        assert not own or (got[k][1] == len(own) and got[k][0] == pytest.approx(e, abs=2e-6))


def test_series_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "CHUNK", 3)
    rows = spark.createDataFrame([("a", i % 4, i, float(i)) for i in range(8)], "analyte_name string, taken_at int, id int, value_num double")
    got = sorted((r.chunk, r.values_in_order) for r in aggregates.series(rows, rows["analyte_name"]).collect())
    assert got == [(0, [0.0, 4.0, 1.0]), (1, [5.0, 2.0, 6.0]), (2, [3.0, 7.0])]


def test_an_unverified_audit_is_refused(spark):
    assertions = spark.createDataFrame([("p", "r2", None), ("p", "r1", "2020-01-02"), ("p", "r3", "2020-01-01")], "patient string, evidence_id string, date string")
    records = spark.createDataFrame([("r1", "x"), ("r2", "y")], "evidence_id string, diagnosis string")
    yes, no = (spark.createDataFrame([("p", ok)], "patient string, passed boolean") for ok in (True, False))
    got = sorted((r.place, r.evidence_id, r.diagnosis) for r in scoring.verified_reports(assertions, records, yes).collect())
    assert got == [(1, "r2", "y"), (2, "r3", None), (3, "r1", "x")]
    for scores in (no, no.where("false")):
        with pytest.raises(PySparkException, match="unverified audit"):
            scoring.verified_reports(assertions, records, scores).collect()


def test_board_takes_times_by_label(spark):
    log = ["ts.py::A::one PASSED", "FAILED [50%] ts.py::A::two", "ts.py::B::three SKIPPED", "[SPEED] one: 3s", "[SPEED] one: 2.5s", "[SPEED] TWO: 1.5s x", "noise"]
    rows = spark.createDataFrame([("m", 1, k, line) for k, line in enumerate(log)] + [("z", 1, 0, "ts.py::A::one ERROR")], "model string, log int, line_no int, line string")
    got = {r.model: r for r in scoring.suite_board(rows, "ts.py").collect()}
    assert (got["m"].tests, got["m"].passed, got["m"].seconds_each, got["m"].score) == (3, 1, 4.0, round(1 / 3 / 4, 6))
    assert (got["z"].passed, got["z"].seconds_each, got["z"].score) == (0, 0.0, 0.0)


def test_every_word_of_a_visit_marks_its_date(spark):
    import datetime

    shown = ["исследования", "исслед.", "приема", "приёма", "осмотра", "визита", "записи", "проведения"]
    notes = [f"Дата рождения 01.02.1980. Дата {w}: 5.3.21" for w in shown] + [f"{w} 5/3/2021" for w in ("Исследование", "прием от", "осмотр от", "приём")]
    df = spark.createDataFrame([(n,) for n in notes], "note string")
    assert {r.d for r in df.select(dates.visit_date(df["note"]).alias("d")).collect()} == {datetime.date(2021, 3, 5)}


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Ср. содержание в эритроците", "(MCH) 30.3 pg 27 - 34"], ["Ср. содержание в эритроците (MCH) 30.3 pg 27 - 34"]),
        (["Ширина распределения по", "Объему (RDW) 49.6"], ["Ширина распределения по Объему (RDW) 49.6"]),
        (["PDW ( ширина", "13.40 фл", "тромбоцитов )", "MCV 90"], ["PDW ( ширина тромбоцитов ) 13.40 фл", "MCV 90"]),
        (["12 g", "объем 3", "", "MCV", "-4,5"], ["12 g", "объем 3", "MCV -4,5"]),
        (["PDW ( a", "1", "2", "b", "Next"], ["PDW ( a b", "1", "2", "Next"]),
        ([], []),
    ],
)
def test_wrapped_names_are_joined(lines, want):
    assert panels.unwrapped(lines) == want


def test_panels_of_any_text(spark):
    texts = {1: None, 2: "", 3: "A: 10 4.7 -0,1 (5%)\nB: не выявлено\nC 10 1047", 4: "A\n10\n5.7\n-0.1 (5%)\nB\n10 48\n10 9", 5: "показатель без полей\nA: 10 3", 6: "проза, 2016 г.\n10 5", 7: ":10 5", 8: "A 10 5\n\nB\n10 6"}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string").select("id", "text", panels.panel(F.col("text")).alias("r")).collect()
    got = {r.id: [(x.analyte_name, x.value_num) for x in r.r] for r in rows}
    share = ", относительный показатель"
    assert got == {1: [], 2: [], 3: [("A", 4.7), ("A" + share, -0.1), ("C", 10.47)], 4: [("A", 5.7), ("A" + share, -0.1), ("B", 4.8)], 5: [("A", 3.0)], 6: [("проза, 2016 г.", 5.0)], 7: [], 8: [("A", 5.0)]}


@pytest.mark.parametrize(
    ("torn", "want"),
    [
        ('{"a": [1, 2', {"a": [1, 2]}),
        ('{"a": "x\\', {"a": "x"}),
        ('{"a": "x\\u04', {"a": "x"}),
        ('[{"a": 12.', [{"a": 12}]),
        ('{"a": 1, "b', {"a": 1}),
        ('{"a": 1, "b": tru', {"a": 1}),
        ('{"a": 1, "b" 2, "c": 3}', {"a": 1}),
        ('{"a": , "b": 1}', {}),
        ("[1] tail", [1]),
        ("", None),
    ],
)
def test_torn_json(torn, want):
    assert parse.repaired(torn) == want


def test_torn_json_takes_time_in_proportion():
    assert len(parse.repaired('[' + '{"a": "b", "c": [1, 2, {"d": null}]}, ' * 50_000 + '{"a": tr')) == 50_001


def plain_greedy(expected, actual):
    """The rule as it is told: expected rows in order, among free rows of the same number rounded to 2 or the same text, the best name."""
    from chartlode.operators.fuzzy import name_likeness

    text = lambda s: " ".join((s or "").lower().split())
    free, out = list(actual), []
    for o, name, value, said in expected:
        if value is None and said is None:
            continue
        same = [a for a in free if (a[2] is not None and round(a[2], 2) == round(value, 2) if value is not None else a[2] is None and text(a[3]) == text(said))]
        best = max(same, key=lambda a: name_likeness(name, a[1]), default=None)
        if best:
            free.remove(best)
        out.append((o, best and best[0]))
    return out


def test_greedy_matches_follow_the_rule(spark):
    import random

    rng = random.Random(6)
    names = ["iron serum", "Iron", "ё ж", "е ж", "СИБР 20 минут h2", "СИБР h2 20 минут", "сибр 40 минут ch4", "total protein", ""]
    values = [1.004, 1.006, 1.0049, 0.9951, 2.675, 2.665, 2.67, -0.001, 0.0, None]
    row = lambda k: (k, rng.choice(names), (v := rng.choice(values)), None if v is not None or rng.random() < 0.3 else rng.choice(["Not  found", "not found ", ""]))
    docs = {d: ([row(k) for k in range(rng.randint(0, 12))], [row(k) for k in range(rng.randint(0, 12))]) for d in range(40)}
    kind = "doc long, ordinal long, name string, value double, text string"
    table = lambda side: spark.createDataFrame([(d, *r) for d, both in docs.items() for r in both[side]], kind)
    got = scoring.match_values(table(0), table(1))
    assert sorted((r.doc, r.expected, r.actual if r.actual is not None else -1) for r in got.collect()) == sorted((d, o, -1 if a is None else a) for d, both in docs.items() for o, a in plain_greedy(*both))
    scores = {r.doc: (r.matched, r.missing, r.extra, r.precision, r.recall) for r in scoring.precision_recall(got, table(1)).collect()}
    for d, (e, a) in docs.items():
        m = plain_greedy(e, a)
        n = sum(x is not None for _, x in m)
        assert scores.get(d, (0, 0, 0, 0.0, 0.0)) == (n, len(m) - n, len(a) - n, round(n / len(a), 6) if a else 0.0, round(n / len(m), 6) if m else 0.0)


def test_an_ordinal_that_occurs_twice_is_taken_once(spark):
    rows = spark.createDataFrame([(1, 7, "iron", 2.0, None)] * 2 + [(1, 8, "iron", 3.0, None)], "doc long, ordinal long, name string, value double, text string")
    got = sorted((r.expected, r.actual or 0) for r in scoring.match_values(rows, rows).collect())
    assert got == [(7, 0), (7, 7), (8, 8)]


def test_audits_of_repeated_ids_equal_their_sql(spark, tmp_path):
    import duckdb

    from chartlode.plans.changes import query as changes

    lines = [(o, p, n, q) for o, p, n in ((1, 100_001, 1), (2, 1, 1), (2, 5, 2), (3, 8, 3)) for q in (1.0, 2.0)]  # the first two lines have one id
    day = "timestamp_ntz'1998-01-01' + make_dt_interval(int({}))"
    wide = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").selectExpr("*", "'A' AS l_returnflag", f"{day.format('l_quantity')} AS l_shipdate")
    wide.repartition(4, "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", "b", 3 if p > 8 else 5) for p in (1, 5, 8, 100_001)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, 1) for o in (1, 2, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("EVL-03b", "JOIN-09", "EVL-01"):
        df = changes.queries[name](spark, str(tmp_path))
        want = con.execute(changes.oracles[name])
        got = df.select([c[0] for c in want.description]).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str), name


def test_audits_equal_a_plain_audit(spark):
    """Ids that nothing knows, kinds that don't meet, several assertions of an id, groups of one and none: beside sets and loops."""
    import random

    rng = random.Random(5)
    fields = "name string, value_num double, unit string, status string, day date, raw string, canonical string, schedule string"
    say = lambda: (rng.choice("aA"), rng.choice([1.0, 2.0, None]), rng.choice(["g", " G "]), "high", None, rng.choice(["x  y", "X y", "z"]), rng.choice([None, "c"]), None)
    kinds = ["lab", "date", "medication"]
    facts = [(p, i, *say()) for p in range(6) for i in range(8) if rng.random() > 0.2]
    required = [(p, rng.choice(kinds), i) for p in range(6) for i in range(8)]
    said = [(p, rng.choice([*kinds, "finding", "finding", "contradiction", "contradiction"]), k, [rng.randrange(9) for _ in range(rng.randint(0, 3))], *say()) for p in range(5) for k in range(30)]
    groups = [(p, g, [rng.randrange(8) for _ in range(rng.randint(1, 2))]) for p in range(6) for g in range(3)]
    needed = [(p, 2 * p) for p in (0, 1, 2, 3, 5, 9)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    df = scoring.audit_scores(frame(required, "patient int, kind string, evidence_id int"), frame(facts, f"patient int, evidence_id int, {fields}"), frame(said, f"patient int, kind string, ordinal int, evidence_ids array<int>, {fields}"), frame(groups, "patient int, group_id int, evidence_ids array<int>"), frame(needed, "patient int, findings int"))
    norm = lambda x: " ".join((x or "").split()).lower()

    def verdict(kind, w, h):
        if w is None or h is None:
            return "missing"
        lab = w[1] == h[1] and norm(w[2]) == norm(h[2]) and w[3] == h[3] and norm(w[0]) == norm(h[0])
        drug = norm(w[5]) == norm(h[5]) and (w[6] is None or norm(w[6]) == norm(h[6]))
        return "ok" if {"lab": lab, "date": False, "medication": drug}[kind] else "wrong"

    want = {}
    for p, least in needed:
        known = {f[1]: f[2:] for f in facts if f[0] == p}
        mine = [s for s in said if s[0] == p]
        row = {"patient": p, "findings": least} | {f"{k}_{v}": 0 for k in kinds for v in ("missing", "wrong")}
        for k, i in [r[1:] for r in required if r[0] == p]:
            v = verdict(k, known.get(i), next((s[4:] for s in mine if s[1] == k and i in s[3]), None))
            if v != "ok":
                row[f"{k}_{v}"] += 1
        row["invalid"] = len({i for s in mine for i in s[3]} - set(known))
        row["findings_found"] = sum(s[1] == "finding" and s[3] != [] and set(s[3]) <= set(known) for s in mine)
        row["contradictions"] = sum(g[0] == p for g in groups)
        row["contradictions_found"] = sum(g[0] == p and any(s[1] == "contradiction" and set(g[2]) <= set(s[3]) for s in mine) for g in groups)
        row["passed"] = row["invalid"] == sum(row[f"{k}_{v}"] for k in kinds for v in ("missing", "wrong")) == 0 and row["contradictions_found"] >= row["contradictions"] and row["findings_found"] >= least
        want[p] = row
    assert {r.patient: r.asDict() for r in df.collect()} == want
    assert sum(r["contradictions_found"] for r in want.values()) and sum(r["findings_found"] for r in want.values()) and want[9]["passed"] is False


def test_audited_rows_are_sent_once(spark):
    """After the results are joined and those of one id are one, nothing of EVL-03b is sent or read again."""
    from chartlode.plans.changes import query as changes

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes.queries["EVL-03b"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 4 and plan.count("FileScan") == 3  # lines and parts, lines and orders


def test_mismatches_of_units_and_bounds(spark):
    kind = "doc long, ordinal long, unit string, ref_low double, ref_high double"
    want = spark.createDataFrame([(1, 1, "г/л", 1.0, 2.0), (1, 2, "г/л", 1.0, None), (1, 3, None, 5.0, 6.0), (1, 4, "10^9/л", 1.0, 1.0)], kind)
    have = spark.createDataFrame([(1, 7, "G/L", 1.005, 2.5), (1, 8, "мг/л", None, 3.0), (1, 9, "x", 5.0, 6.0), (1, 10, "10⁹/л", 1.0, 1.0)], kind)
    pairs = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9), (1, 4, 10), (1, 5, None)], "doc long, expected long, actual long")
    got = sorted((r.expected, r.field, r.want, r.have) for r in scoring.mismatches(pairs, want, have).collect())
    assert [g for g in got if g[1] != "unit"] == [(1, "ref_high", "2.0", "2.5")]
    assert (2, "unit", "г/л", "мг/л") in got
    assert not [g for g in got if g[0] == 4]


def test_closest_names_equal_all_pairs(spark):
    import random

    from chartlode.operators import fuzzy

    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip() or "a"
    keys = list(dict.fromkeys(make(rng.choice([1, 2, 3, 5, 8, 13, 20, 39, 41, 43, 60])) for _ in range(150)))

    def worn(s):
        s = list(s)
        for _ in range(rng.randint(1, 6)):
            i, kind = rng.randrange(len(s) + 1), rng.randrange(4)
            if kind == 0:
                s.insert(i, rng.choice("abcdx"))
            elif i < len(s) and kind == 1:
                del s[i]
            elif i < len(s) and kind == 2:
                s[i] = "y"
            elif i + 1 < len(s):
                s[i], s[i + 1] = s[i + 1], s[i]
        return "".join(s)

    asked = list(dict.fromkeys(["", *[worn(k) for k in keys], *[make(9) for _ in range(20)], *keys[:5]]))
    index = fuzzy.key_index(spark.createDataFrame(list(enumerate(keys)), "ordinal long, name string"), lambda c: c)
    found = fuzzy.match(spark.createDataFrame([(a,) for a in asked], "query string"), index, max_edit_ratio=0.35, ratio_floor=0).collect()
    for r in found:
        cap = max(1, int(len(r.query) * 0.35))
        best = min(((d, o, k) for o, k in enumerate(keys) if (d := fuzzy.damerau(r.query, k)) <= cap), default=(None, None, None)) if r.query else (None,) * 3
        assert (r.distance, r.record, r.key) == best, r
    assert len(found) == len(asked)


def test_panels_by_synonyms_first(spark):
    from chartlode.operators import fuzzy

    index = fuzzy.key_index(spark.createDataFrame([(1, "blood count"), (2, "lipids")], "ordinal long, name string"), lambda c: c)
    synonyms = spark.createDataFrame([("CBC ", "blood count"), ("lipids", "lipid panel")], "synonym string, key string")
    asked = spark.createDataFrame([("cbc",), ("Lipids",), ("blood cuont",), ("zzzzzzzzzzzzzz",)], "query string")
    got = {r.query: r.key for r in fuzzy.match_panel(asked, index, synonyms=synonyms).collect()}
    assert got == {"cbc": "blood count", "lipids": "lipid panel", "blood cuont": "blood count", "zzzzzzzzzzzzzz": None}


def test_names_score_alike_in_both_forms(spark):
    from chartlode.operators.fuzzy import name_likeness, name_score

    names = ["Ёж  белый", "еж", "", " ", "СИБР 20 минут H2", "h2 20", "сибр 120 минут h2+2ch4", "20 минут", "сибр", "b a a"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in rows.withColumn("s", name_score(F.col("a"), F.col("b"))).collect():
        assert r.s == name_likeness(r.a, r.b), r


@pytest.mark.parametrize("cell", [(32_768, 65_536), (7, 20)])
def test_nearest_vectors_equal_all_distances(spark, cell, monkeypatch):
    import numpy as np

    from chartlode.operators import vectors

    rng = np.random.default_rng(3)
    points = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties
    points[50:] *= 1e-3
    points[80:] = points[:10] + 1e6
    rows = [(int(i), p.tolist()) for i, p in enumerate(points)]
    chunks = spark.createDataFrame([*rows, (999, None)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 3 == 0], "query_id long, embedding array<float>")
    stored = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for k in (1, 7, 200):
        got = vectors.nearest(chunks, asked, k, cell=cell).collect()
        for q in range(0, 90, 3):
            want = sorted((float(np.sqrt(((stored[q] - v) ** 2).sum())), i) for i, v in stored.items())[:k]
            assert [(r.distance, r.id) for r in sorted(got, key=lambda r: r.place) if r.query_id == q] == want
    assert vectors.nearest(chunks.where("false"), asked, 3).count() == 0
    assert vectors.nearest(chunks, asked.where("false"), 3).count() == 0


def test_cells_meet_without_coalesced_partitions(spark):
    from chartlode.operators import vectors

    points = spark.range(40).selectExpr("id AS chunk_id", "array(double(id), 0D) AS embedding")
    asked = points.where("chunk_id % 8 = 0").withColumnRenamed("chunk_id", "query_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for cell in ((32_768, 65_536), (2, 9)):
            got = {(r.query_id, r.id) for r in vectors.nearest(points, asked, 2, cell=cell).collect()}
            assert got == {(q, i) for q in range(0, 40, 8) for i in (q, max(q - 1, 0) or 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_blocks_keep_what_single_distances_keep(monkeypatch):
    import numpy as np

    from chartlode.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(40, 8))
    names, ids, far = vectors.best_of(np.arange(40), q, np.arange(200), x, 5)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    assert ids.reshape(40, 5).tolist() == np.argsort(d, axis=1)[:, :5].tolist()
    assert np.allclose(far.reshape(40, 5), np.sort(d, axis=1)[:, :5])


def test_blocks_of_a_hot_key_end_as_one_scan(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), i, rng.choice([None, float(rng.randint(0, 50))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small blocks become one
    try:
        from chartlode.operators import blocks

        assert blocks.in_blocks(df, ["k"], ["i"]).where("k = 'hot'").select("_part").distinct().count() == 4
        got = {(r.k, r.i): (r["_at"], r["_n"]) for r in blocks.ranked(df, ["k"], ["i"]).collect()}
        for k in ("hot", "b", None):
            own = [i for kk, i, _ in rows if kk == k]
            assert [got[k, i] for i in own] == [(at, len(own)) for at in range(len(own))]
        carried = {r.i: r.carried for r in ordered.carry_forward(df, "k", "i", F.col("v")).collect()}
        last = {}
        for k, i, v in rows:
            last[k] = v if v is not None else last.get(k)
            assert carried[i] == last[k]
        p95 = {r.k: (r.n, r.p95) for r in aggregates.batch_p95(df, "k", "v").collect()}
        energy = {r.k: (r.joules, r.intervals) for r in ordered.energy(df, "k", "i", "v").collect()}
        for k in ("hot", "b", None):
            own = sorted(v for kk, _, v in rows if kk == k and v is not None)
            assert p95[k] == (len(own), own[max(int(0.95 * len(own)), 1) - 1])
            points = [(i, v) for kk, i, v in rows if kk == k and v is not None]
            assert energy[k] == (pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))), len(points) - 1)
        assert [tuple(r) for r in aggregates.batch_p95(df.where("false"), "k", "v").collect()] == []
        (none,) = aggregates.batch_p95(spark.createDataFrame([("x", None)], "k string, v double"), "k", "v").collect()
        assert tuple(none) == ("x", 0, None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_differences_of_reports(spark):
    side = "struct<diagnosis:string,doctor_name:string,visit_date:date,anamnesis:string,medications:array<string>,recommendations:array<string>>"
    import datetime

    day, other = datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)
    want = ("Арит­мия лёгкая", "Dr A B", day, "long story", ["aspirin 5 mg", " ", "iron"], ["walk more"])
    rows = [
        (1, want, want),
        (2, want, None),
        (3, want, ("", "dr b a", other, "qqqqq", ["walk more"], ["aspirin  5 MG", "Арит­мия лёгкая"])),
        (4, (None, "", None, None, None, []), None),
        (5, ("x. Заключение: stable angina", None, None, None, None, None), (None, None, None, "stable angina", None, None)),
    ]
    got = {r.id: r for r in scoring.report_differences(spark.createDataFrame(rows, f"id long, expected {side}, got {side}")).collect()}
    assert (got[1].verdict, got[1].recall, got[1].missing, got[1].soft) == ("pass", 1.0, [], [])
    assert got[2].missing == ["diagnosis", "doctor_name", "visit_date", "medications: aspirin 5 mg", "medications: iron"] and got[2].soft == ["recommendations: walk more"]
    assert got[3].matched == ["diagnosis", "doctor_name", "medications: aspirin 5 mg", "recommendations: walk more"]
    assert (got[3].missing, got[3].soft, got[3].verdict) == (["visit_date"], ["medications: iron", "anamnesis"], "fail")
    assert (got[4].matched, got[4].verdict, got[4].recall) == ([], "pass", 0.0)
    assert (got[5].matched, got[5].verdict) == (["diagnosis"], "pass")


def plain_likeness(a, b):
    """Twice the longest common subsequence over both lengths, by recursion over both ends."""
    from functools import cache

    @cache
    def common(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + common(i + 1, j + 1) if a[i] == b[j] else max(common(i + 1, j), common(i, j + 1))

    return 100.0 if not a and not b else 200.0 * common(0, 0) / (len(a) + len(b))


def plain_token_set(a, b):
    x, y = {*a.lower().split()}, {*b.lower().split()}
    if x & y and (x <= y or y <= x):
        return 100.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    full = [f"{shared} {s}".strip() for s in (left, right)]
    return max([plain_likeness(*full)] + ([plain_likeness(shared, s) for s in full] if shared else []))


def test_likeness_equals_a_plain_one(spark):
    import random

    from chartlode.operators import fuzzy

    rng = random.Random(12)
    text = lambda: " ".join(rng.choice(["iron", "Iron", "zinc", "b12", "of", "ferritin"]) for _ in range(rng.randint(0, 4)))
    rows = [(text(), text()) for _ in range(120)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", fuzzy.likeness_udf("a", "b").alias("one"), fuzzy.token_set_udf("a", "b").alias("two")).collect():
        assert r.one == pytest.approx(plain_likeness(r.a, r.b)), r
        assert r.two == pytest.approx(plain_token_set(r.a, r.b)), r


def test_lists_match_in_order_and_once(spark):
    import random

    rng = random.Random(13)
    items = ["aspirin 5 mg", "aspirin 10 mg", "iron tablets", "iron", "zinc drops", "vitamin d3"]
    rows = [(k, rng.choices(items, k=rng.randint(0, 5)), rng.choices(items, k=rng.randint(0, 5))) for k in range(60)]
    got = {r.id: (r.n_expected, r.n_found) for r in scoring.match_lists(spark.createDataFrame(rows, "id long, expected array<string>, actual array<string>"), 80).collect()}
    for k, want, have in rows:
        free, n = list(have), 0
        for w in want:
            scores = [plain_token_set(w, h) for h in free]
            if scores and max(scores) >= 80:
                free.pop(scores.index(max(scores)))
                n += 1
        assert got[k] == (len(want), n)


def test_embeddings_come_in_batches_and_in_order(spark):
    from chartlode.operators import vectors

    def embed(texts):
        if len(texts) > 7:
            raise ValueError("too many at once")
        return [[float(len(t)), float(i == 0)] for i, t in enumerate(texts)]

    df = spark.createDataFrame([(k, "x" * k) for k in range(40)], "id int, text string").coalesce(1)
    rows = vectors.embedded(df, embed, batch=7).collect()
    assert [(r.id, r.embedding) for r in rows] == [(k, [float(k), float(k % 7 == 0)]) for k in range(40)]
    with pytest.raises(PySparkException, match="as many vectors as texts"):
        vectors.embedded(df, lambda texts: [[0.0]], batch=7).collect()


def test_snippets_of_a_stated_list_of_terms(spark):
    from chartlode.operators import filters

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["Iron and zinc", "zinc", None, "ZINC only", "irons"])], "doc_id int, text string")
    terms = spark.createDataFrame([("Zinc",), ("iron",), ("",), (None,), ("absent",), ("iron",)], "term string")
    got = sorted((r.term, r.place, r.id, r.snippet) for r in filters.snippets(docs, terms, 4, 2).collect())
    assert got == [("Zinc", 1, 0, "Iron"), ("Zinc", 2, 1, "zinc"), ("iron", 1, 0, "Iron"), ("iron", 2, 4, "iron")]
    assert filters.snippets(docs, terms.where("false"), 4, 2).count() == 0
    with pytest.raises(ValueError):
        filters.snippets(docs, terms, 4, 2, most_terms=2)


def test_payloads_of_one_small_file_are_parsed_by_all_cores(spark):
    """As a table of one partition gives them; a key's role doesn't depend on what was asked before."""
    payload = '[{"Показатель": "a", "Value": "1"}, {"name": "b", "value": "2"}, {"name": "c'
    docs = spark.range(2_000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(payload).alias("payload"))
    got = parse.harvest(docs)
    used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == 4 * spark.sparkContext.defaultParallelism
    assert {(r.ordinal, r.analyte_name, r.value_raw) for r in got.collect()} == {(0, "a", "1"), (1, "b", "2")} and got.count() == 4_000


def test_a_parse_is_in_one_place_of_the_plan(spark):
    """A filter or an explode above it would have it evaluated once more below."""
    lines = spark.createDataFrame([(1, 1, "20 мин: H2 = 1, ch4=2,5; H2+2CH4=\t3 O2=4, H2=9"), (1, 2, "0 мин: 5=6 H2=1, CH4=2, O2=4"), (1, 3, "x мин: H2=1, CH4=2, H2+2CH4=3, O2=4"), (1, 4, None), (1, 5, "-1 мин: H2=1 CH4=2 H2+2CH4=3 O2=4")], "doc_id long, line_no int, line string")
    got = parse.breath_test(lines)
    assert [(r.line_no, r.ordinal, r.value_num) for r in got.orderBy("ordinal").collect()] == [(1, 0, 1.0), (1, 1, 2.5), (1, 2, 3.0), (1, 3, 4.0)]
    answers = spark.createDataFrame([(1, '{"results": [null, {"name": "a", "value": "1"}, {"test_name": "b", "result": "<2"}], "tests": []}'), (2, "{}"), (3, None), (4, "[")], "doc_id long, payload string")
    rows = parse.flatten_analysis(answers)
    assert sorted((r.doc_id, r.line_no, r.analyte_name) for r in rows.collect()) == [(1, 1, "a"), (1, 2, "b")]
    for df, call in ((got, "regexp_extract_all("), (rows, "from_json(")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(call) == 1
