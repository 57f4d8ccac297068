"""Paged sources, table functions, hooks, and files that are written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from chartlode.functions import tables
from chartlode.operators import extractors, fuzzy
from chartlode.sources import paged, readers

PAGES = {
    (1, 1): '[{"activityId": 11}, {"activityId": 12}]', (1, 2): '[{"activityId": 13}]', (1, 3): "[]",
    (2, 1): "[]", (2, 2): '[{"activityId": 99}]',
    (3, 1): "{torn", (3, 2): '[{"activityId": 31}]', (3, 4): '[{"activityId": 34}]',
    (4, 1): '[{"other": 1}]',
}


@pytest.fixture
def pages(spark, tmp_path):
    spark.dataSource.register(paged.PagedActivities)
    for (user, page), text in PAGES.items():
        folder = tmp_path / "pages" / f"bucket={user % 2}" / f"user_id={user}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(text)
        (folder / "_SUCCESS").write_text("")
    return str(tmp_path / "pages")


def test_pages_until_an_empty_one_and_errors_apart(spark, pages):
    rows = spark.read.format("paged_activities").option("path", pages).load().collect()
    assert sorted((r.user_id, r.external_id) for r in rows if r.error is None) == [(1, "11"), (1, "12"), (1, "13"), (3, "31")]
    assert sorted((r.user_id, r.page, r.error.split(":")[0]) for r in rows if r.error) == [(3, 1, "JSONDecodeError"), (4, 1, "KeyError")]
    assert spark.read.format("paged_activities").option("path", pages).option("max_pages", 1).load().where("error is null").count() == 2
    assert spark.read.format("paged_activities").option("path", pages + "/nothing").load().count() == 0


def test_pages_in_lines_equal_pages_in_folders(spark, pages, tmp_path):
    import json

    for user, page in sorted(PAGES):
        folder = tmp_path / "lines" / f"bucket={user % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        with open(folder / "part-0.txt", "a") as f:
            f.write(json.dumps({"user_id": user, "page": page, "payload": PAGES[user, page] + "\n"}) + "\n")
    read = lambda path, most: sorted(map(str, spark.read.format("paged_activities").option("path", path).option("max_pages", most).load().collect()))
    for most in (1, 3, 4):
        assert read(f"{tmp_path}/lines", most) == read(pages, most)


def test_a_paged_export_has_no_file_for_each_page(spark, tmp_path, monkeypatch):
    import datetime

    from chartlode.plans import inputs, registries
    from chartlode.plans.views import Tables

    monkeypatch.setattr(inputs, "scratch", lambda t, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(registries, "BUCKETS", 3)
    rows = [(i, i % 60, "view", datetime.datetime(2024, 1, 1), float(i)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in registries.src_10(Tables(spark, str(tmp_path))).collect())
    ids = {u: sorted(str(i) for i in range(300) if i % 60 == u) for u in range(60)}
    assert got == sorted((u, i) for u in ids for i in ids[u][: 2 if u % 2 == 0 else 6])
    assert len(list((tmp_path / "pages").rglob("part-*"))) <= 3


def test_pages_as_a_stream_equal_the_batch(spark, pages, tmp_path):
    stream = spark.readStream.format("paged_activities").option("path", pages).load()
    write = lambda b, n: b.write.mode("overwrite").json(f"{tmp_path}/out/{n}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.schema(paged.SCHEMA).json(f"{tmp_path}/out/*")
    key = lambda df: sorted(map(str, df.select("user_id", "page", "external_id").collect()))
    assert key(got) == key(spark.read.format("paged_activities").option("path", pages).load())


def test_exports_are_files_of_tasks_not_of_users(spark, tmp_path, monkeypatch):
    import datetime

    from chartlode.plans import inputs
    from chartlode.plans.views import Tables

    monkeypatch.setattr(inputs, "scratch", lambda t, name: f"{tmp_path}/{name}")
    rows = [(i, i % 60, ("click", "view", "signup", "buy", None)[i % 5], datetime.datetime(2024, 1, 1), float(i)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = inputs.src_03(Tables(spark, str(tmp_path)))
    assert got.groupBy("metric").count().count() == 3 and got.count() == sum(i % 5 < 3 and i % 7 > 0 for i in range(300))
    assert len([p for p in (tmp_path / "export").rglob("part-*")]) <= 4


def test_table_functions_in_sql(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, '{"rows": [{"name": "iron", "value": "7"}, {"name": "b", "value": "8"}]}'), (2, None), (3, '[{"name": "cut", "value": "1"}, {"name": "o')], "id long, payload string")
    got = spark.sql("SELECT id, r.ordinal, r.analyte_name FROM {docs} d, LATERAL harvest(d.payload) r", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "iron"), (1, 1, "b"), (3, 0, "cut")]
    assert spark.sql("SELECT * FROM {docs} d, LATERAL lab_lines(d.payload) r WHERE id = 2", docs=docs).count() == 0
    with pytest.raises(Exception, match="a table function of texts got a bigint"):
        spark.sql("SELECT * FROM {docs} d, LATERAL panel_rows(d.id) r", docs=docs).collect()


def test_hooks_of_a_normalizer(spark):
    registry = spark.createDataFrame([(1, "alanine aminotransferase"), (2, "iron"), (3, "zinc")], "ordinal long, name string")
    rows = spark.createDataFrame([("ALT",), ("irno",), ("Zinc",), ("none",), (None,)], "raw string")
    own = extractors.Normalizer(
        0.3, 80, short_circuit=lambda q, raw: F.when(raw == "ALT", "alanine aminotransferase").when(raw == "none", "no such key"), matched=lambda found: F.col("key") != "zinc"
    )
    got = {r.raw: (r.status, r.key) for r in own.resolve(rows, registry).collect()}
    assert got == {"ALT": ("matched", "alanine aminotransferase"), "irno": ("unverified", None), "Zinc": ("unverified", None), "none": ("unverified", None), None: ("unverified", None)}
    plain = {r.raw: r.key for r in extractors.DRUGS.resolve(rows, registry).collect()}
    assert plain == {"ALT": None, "irno": "iron", "Zinc": "zinc", "none": None, None: None}
    renamed = extractors.Normalizer(0.3, 0, build_index=lambda r: fuzzy.key_index(r.withColumn("name", F.concat(F.lit("x"), "name")), lambda c: c))
    assert {r.raw: r.record for r in renamed.resolve(spark.createDataFrame([("xiron",)], "raw string"), registry).collect()} == {"xiron": 2}


def test_extractors_by_type(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, doc_type string")
    known = extractors.Extractors()
    with pytest.raises(ValueError):
        known.run(docs)
    known.register("a")(lambda d: d.select("id", F.lit("first").alias("what")))
    known.register("b")(lambda d: d.select(F.lit("second").alias("what"), "id"))
    known.register("a")(lambda d: d.select("id", F.lit("later").alias("what")))
    assert sorted((r.id, r.what, r.doc_type) for r in known.run(docs).collect()) == [(1, "later", "a"), (2, "second", "b")]
    assert sorted(r.id for r in known.unknown(docs).collect()) == [3, 4]


def test_a_registry_begins_with_its_description(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(k, f"n{k}") for k in (3, 1, 2)], "ordinal long, name string")
    readers.write_registry(df, path, {"source": "x"}, "ordinal")
    lines = [json.loads(x) for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"_meta": {"source": "x"}}, *[{"ordinal": k, "name": f"n{k}"} for k in (1, 2, 3)]]
    assert sorted(map(tuple, readers.read_registry(spark, path, "ordinal long, name string").collect())) == [(1, "n1"), (2, "n2"), (3, "n3")]


def test_samples_that_are_no_objects_are_refused(spark):
    rows = lambda *x: readers.telemetry_json(spark.createDataFrame([(i, s) for i, s in enumerate(x)], "i int, line string"), ["a", "b"]).collect()
    assert [tuple(r) for r in rows('{"a": 1.5, "b": "x"}', ' {"b": "2"}')] == [(0, 1.5, None), (1, None, 2.0)]
    for bad in ("[1]", "3", "torn"):
        with pytest.raises(Exception, match="must be a JSON object"):
            rows(bad)


def test_links_by_host_with_title_and_snippet(spark):
    html = '<a href="https://own.org/x">Own</a><a href="https://a.org/own.org"><b>A</b> &amp; b</a><a href="https://a.org/own.org">again</a><a href="//www.own.org/y">y</a><a href="/rel">rel</a><td class="result-snippet">first <i>one</i></td>'
    got = readers.links(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", "own.org", 5).orderBy("rank").collect()
    assert [(r["rank"], r.url, r.title, r.snippet) for r in got] == [(1, "https://a.org/own.org", "A & b", "first one"), (2, "/rel", "rel", "")]
