"""Streams cut into batches in several ways, stopped and started again, end as one pass over all rows does."""

import random

import pytest
from pyspark.sql import functions as F

from chartlode.streaming import streams


def feed(spark, path, rows, kind, run):
    """Each list of rows arrives as one file; run() takes what is there and stops, so each file is a restart."""
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(f"{path}/in")
    for own in rows:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(stream())
    run(stream())  # nothing new
    return stream()


def cut(rows, sizes):
    rows, out = list(rows), []
    for n in sizes:
        out.append(rows[:n])
        rows = rows[n:]
    return [own for own in [*out, rows] if own]


def test_upserts_before_and_after_compaction(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(9), i, float(i)) for i in range(60)]
    kind, path = "k long, i long, v double", str(tmp_path)
    stream = feed(spark, path, cut(rows, [10, 1, 20]), kind, lambda s: streams.run_upserts(s, f"{path}/out", f"{path}/state", ["k"], "i"))
    want = {k: (i, v) for k, i, v in rows}
    read = lambda: {r.k: (r.i, r.v) for r in streams.read_upserts(spark, f"{path}/out", stream.schema, ["k"]).collect()}
    assert read() == want
    for upto in (1, 1, 2, 0):
        streams.compact_upserts(spark, f"{path}/out", stream.schema, ["k"], upto, buckets=3)
        assert read() == want
    assert streams.compacted(spark, f"{path}/out") == 2
    files = " ".join(streams.read_upserts(spark, f"{path}/out", stream.schema, ["k"]).inputFiles())
    assert "base-000000000002" in files
    # A batch that runs again after the compaction that took it in writes its folder anew and changes nothing.
    streams.leave(spark.createDataFrame(rows[:10], kind), f"{path}/out", 0)
    assert read() == want
    # A compaction that stopped before its manifest leaves a folder that no one reads.
    spark.createDataFrame([(1, 1, -1.0, 9)], f"{kind}, _batch long").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/out/base-{9:012d}")
    assert read() == want


@pytest.mark.parametrize("sizes", [[], [1, 1, 5], [30]])
def test_averages_equal_a_fold(spark, tmp_path, sizes):
    rng = random.Random(2)
    rows = [(rng.choice("aaaab"), i, rng.uniform(-9, 9) if rng.random() > 0.2 else None) for i in range(400)]
    kind, path = "k string, i long, v double", str(tmp_path)
    stream = feed(spark, path, cut(rows, sizes), kind, lambda s: streams.run_ema(s, f"{path}/out", f"{path}/state", "k", "v", ["i"]))
    got = {r.k: (r.ema, r.samples) for r in streams.read_ema(spark, f"{path}/out", stream.schema, "k").collect()}
    for k in "ab":
        ema, n = None, 0
        for kk, _, v in rows:
            if kk == k and v is not None:
                ema, n = (v if ema is None else ema * 0.7 + v * 0.3), n + 1
        assert got[k] == (pytest.approx(ema), n)


def test_blocks_of_a_hot_key_are_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = streams.ema_blocks(rows, "k", "v", ["i"], 0.3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(blocks) == 4 and max(b.n for b in blocks) < 10_000 and sum(b.n for b in blocks) == 20_000


def test_a_late_repeat_is_no_second_delivery(spark, tmp_path):
    rows = [[(1, "2020-01-01"), (2, "2020-01-02"), (1, "2020-01-03")], [(3, "2020-01-05"), (None, "2020-01-05")], [(1, "2029-01-01"), (2, "2001-01-01"), (4, "2029-01-01")]]
    kind, path = "d long, at string", str(tmp_path)
    stream = feed(spark, path, rows, kind, lambda s: streams.run_claims(s, f"{path}/out", f"{path}/state", "d", "at"))
    got = sorted((r.d, r.at) for r in streams.read_claims(spark, f"{path}/out", stream.schema).collect())
    assert got == [(1, "2020-01-01"), (2, "2020-01-02"), (3, "2020-01-05"), (4, "2029-01-01")]


def plain_status(rows):
    best = {}
    for doc, at, status in rows:
        if status in streams.STAGES:
            new = (streams.STAGES[status], at, status)
            old = best.get(doc)
            if old is None or new[0] > old[0] or new[0] == old[0] == 3 and new[1:] < old[1:]:
                best[doc] = new
    return {d: (s, stage) for d, (stage, _, s) in best.items()}


def test_status_moves_forward_whatever_the_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(12), f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.choice([*streams.STAGES, "unknown"])) for _ in range(40)]
    kind, path = "document_id long, at string, status string", str(tmp_path)
    stream = feed(spark, path, cut(rows, [3, 20]), kind, lambda s: streams.run_status(s, f"{path}/out", f"{path}/state"))
    got = {r.document_id: (r.status, r.stage) for r in streams.read_status(spark, f"{path}/out", stream).collect()}
    assert got == plain_status(rows)


def test_documents_that_stay_in_a_stage_are_reported(spark, tmp_path):
    kind, path = "document_id long, at string, status string", str(tmp_path)
    rows = [[(1, "2024-01-01", "received"), (2, "2024-01-01", "extracted")], [(3, "2024-01-02", "failed")], [(4, "2024-01-02", "received")]]
    stream = feed(spark, path, rows, kind, lambda s: streams.run_status(s, f"{path}/out", f"{path}/state", stuck_after_s=0.001))
    got = {r.document_id: (r.status, r.stuck) for r in streams.read_status(spark, f"{path}/out", stream).collect()}
    assert got[1] == ("received", True) and got[2] == ("extracted", False) and got[3] == ("failed", False)


def plain_survivors(rows):
    live = {}
    for user, doc, kind, title, clinic, file, n in sorted(rows, key=lambda r: r[1]):
        form = (kind, title, clinic or "") if title is not None else None
        twins = [d for d, (u, f, g, _) in live.items() if u == user and (file is not None and f == file or form is not None and g == form)]
        if twins:
            old = min(twins)
            if n < live[old][3]:
                continue
            del live[old]
        live[doc] = (user, file, form, n)
    return {(u, d, n) for d, (u, _, _, n) in live.items()}


@pytest.mark.parametrize("sizes", [[], [5, 40]])
def test_survivors_equal_the_fold(spark, tmp_path, sizes):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.choice("ab"), rng.choice(["t", "u", None]), rng.choice(["", None, "c"]), rng.choice(["f", "g", "h", None]), rng.randrange(4)) for i in range(80)]
    kind, path = "user_id long, id long, doc_type string, title string, clinic string, file_sha256 string, n_rows long", str(tmp_path)
    feed(spark, path, cut(rows, sizes), kind, lambda s: streams.run_survivors(s, f"{path}/out", f"{path}/state"))
    assert {(r.user_id, r.id, r.n_rows) for r in streams.read_survivors(spark, f"{path}/out").collect()} == plain_survivors(rows)


def test_survivors_are_left_by_batches_not_asked_for_one_by_one(spark, tmp_path):
    """No state store, which is asked for each document on its own; users without documents in a batch stay as they are, as does the null user."""
    kind, path = "user_id long, id long, doc_type string, title string, clinic string, file_sha256 string, n_rows long", str(tmp_path)
    rows = [(1, 1, "a", "t", None, "f", 2), (2, 2, "a", "t", None, "f", 2), (None, 3, "a", "t", None, "f", 2), (2, 4, "a", "u", None, "f", 1), (None, 5, "b", "t", None, "f", 3), (2, 6, None, None, None, None, 0)]
    feed(spark, path, cut(rows, [3, 1, 1]), kind, lambda s: streams.run_survivors(s, f"{path}/out", f"{path}/state"))
    assert {(r.user_id, r.id, r.n_rows) for r in streams.read_survivors(spark, f"{path}/out").collect()} == {(1, 1, 2), (2, 2, 2), (None, 5, 3), (2, 6, 0)}
    assert not (tmp_path / "state" / "state").exists()


def test_a_missed_tick_is_made_up_for_once(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    stamp = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})
    accounts = stamp(spark.createDataFrame([(1, at(0), 1), (2, None, 6), (3, at(0), None), (4, at(2), 24)], "user_id long, last_sync_at string, sync_interval_hours int"), "last_sync_at")
    points = stamp(spark.createDataFrame([(u, at(h), 100 * u + h) for u in (1, 2, 3, 4) for h in range(1, 12)], "user_id long, taken_at string, p long"), "taken_at")
    path = str(tmp_path)
    ticks = [[(at(3),)], [(at(4),), (at(6),), (at(5),)], [(at(10),)]]
    feed(spark, path, ticks, "now string", lambda s: streams.sync_ticks(stamp(s, "now"), accounts, points, f"{path}/out", f"{path}/state"))
    got = sorted((r["_batch"], r.p) for r in streams.synced_points(spark, f"{path}/out", points.schema).collect())
    want = [(0, 101), (0, 102), (0, 103), (0, 201), (0, 202), (0, 203), (1, 104), (1, 105), (1, 106), *[(2, 100 + h) for h in range(7, 11)], *[(2, 200 + h) for h in range(4, 11)]]
    assert got == want
