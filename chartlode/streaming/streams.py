"""Structured Streaming forms of what arrives bit by bit.

What a micro-batch leaves is written under its number. A batch that runs again after a failure writes the same folder, and whatever
a batch reads of its own table is what batches before it have left; so each effect happens once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from chartlode.operators import filters

METRIC_KEYS = ["user_id", "provider", "metric", "taken_at"]
#: Stages of a document, which only go forward; the last two are final.
STAGES = {"received": 0, "recognizing": 1, "normalizing": 2, "extracted": 3, "failed": 3}
FINAL = 3


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Take all that is there in micro-batches. A service that goes on gives a processing time as its trigger instead."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def leave(batch: DataFrame, path: str, number: int) -> None:
    batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")


def left(spark: SparkSession, path: str, schema: StructType, after: int = -1, before: int | None = None) -> DataFrame:
    """The rows that batches after one and before another have left, with _batch. Folders of other batches aren't read."""
    rows = spark.read.schema(StructType([*schema.fields]).add("_batch", "long").add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.where((F.col("batch") > after) & (F.col("batch") < before if before is not None else F.lit(True))).drop("batch")


def last_left(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of the last batch that left one."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(*keys, "_row.*")


def latest_in_batch(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """STR-01. One row for each key: the last in order."""
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*").select(*batch.columns)


def run_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> None:
    """STR-01, STR-02. A later row of a key replaces an earlier one. Each batch leaves its own latest rows; see read_upserts() and compact_upserts()."""
    run_batches(stream, lambda batch, number: leave(latest_in_batch(batch, keys, order), path, number), checkpoint)


def compacted(spark: SparkSession, path: str) -> int:
    """The last batch that a finished compaction has taken in, -1 without one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return -1
    last = spark.read.schema("upto long").json(f"{path}/manifest/*").agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def read_upserts(spark: SparkSession, path: str, schema: StructType, keys: list[str], upto: int | None = None) -> DataFrame:
    """The current rows that run_upserts() has left: those of the last compaction and of the batches since."""
    base = compacted(spark, path)
    rows = left(spark, path, schema, base, None if upto is None else upto + 1)
    if base >= 0:
        rows = rows.unionByName(spark.read.schema(StructType([*schema.fields]).add("_batch", "long")).parquet(f"{path}/base-{base:012d}").drop("bucket"))
    return last_left(rows, keys)


def compact_upserts(spark: SparkSession, path: str, schema: StructType, keys: list[str], upto: int, buckets: int = 16) -> None:
    """STR-02. Rewrite the rows as of batch upto in buckets of keys; the manifest names it once it is whole, and reads leave out what it replaces.

    A compaction that stops halfway changes nothing and may be run again; batches that come meanwhile are later than upto."""
    if upto <= compacted(spark, path):
        return
    rows = read_upserts(spark, path, schema, keys, upto).withColumn("_batch", F.lit(upto).cast("long"))
    rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base-{upto:012d}")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("overwrite").json(f"{path}/manifest/{upto:012d}")


def sync_ticks(ticks: DataFrame, accounts: DataFrame, points: DataFrame, path: str, checkpoint: str) -> None:
    """STR-03. At each tick the accounts that are due take their points since their last sync, up to now; see synced_points().

    ticks: now, at any pace (in a service, every 15 minutes). Ticks that were missed come as one batch, and its last one takes the
    whole span at once, since what counts is each account's last sync. accounts: user_id, last_sync_at (at first),
    sync_interval_hours, one row a user; points: user_id, taken_at and more."""
    spark = accounts.sparkSession
    kind = accounts.select("user_id", "last_sync_at").schema

    def tick(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("now").cast("string")).first()[0]
        if now is None:
            return
        state = accounts
        if number:
            seen = last_left(left(spark, f"{path}/synced", kind, before=number), ["user_id"]).withColumnRenamed("last_sync_at", "_at")
            state = accounts.join(seen, "user_id", "left").withColumn("last_sync_at", F.coalesce("_at", "last_sync_at")).drop("_at")
        due = filters.due(state, now).select("user_id", F.col("last_sync_at").alias("_since"))
        at = F.col("taken_at")
        span = (F.col("_since").isNull() | (at > F.col("_since"))) & (at <= F.lit(now).cast(kind["last_sync_at"].dataType))
        leave(points.join(due, "user_id").where(span).drop("_since"), f"{path}/points", number)
        leave(due.select("user_id", F.lit(now).cast(kind["last_sync_at"].dataType).alias("last_sync_at")), f"{path}/synced", number)

    run_batches(ticks, tick, checkpoint)


def synced_points(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What sync_ticks() has taken, with the number of its tick as _batch."""
    return left(spark, f"{path}/points", schema)


def ema_blocks(rows: DataFrame, key: str, value: str, order: list[str], alpha: float) -> DataFrame:
    """key, lo, n, decay, total, first: what each ordered block of a key's values does to an average: decay times it plus total.

    Rows are dealt by ranges of key and order, so a key that has most of them is in many tasks, and a task holds one batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list | None = None
        for f in frames:
            keys, values, lows = f[key].to_numpy(object), f[value].to_numpy(np.float64), f["_lo"].to_numpy(object)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(f)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                decay = (1 - alpha) ** (b - a)
                total = alpha * float((1 - alpha) ** np.arange(b - a - 1, -1, -1.0) @ values[a:b])
                if open_ is not None and open_[0] == keys[a]:
                    open_[2:5] = [open_[2] + b - a, open_[3] * decay, open_[4] * decay + total]
                    continue
                if open_ is not None:
                    yield pd.DataFrame([open_], columns=[key, "lo", "n", "decay", "total", "first"])
                open_ = [keys[a], lows[a], b - a, decay, total, float(values[a])]
        if open_ is not None:
            yield pd.DataFrame([open_], columns=[key, "lo", "n", "decay", "total", "first"])

    ordered = rows.where(F.col(value).isNotNull()).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    slim = ordered.select(key, F.col(value).cast("double").alias(value), F.col(order[0]).alias("_lo"))
    kind = slim.schema
    return slim.mapInPandas(run, f"{key} {kind[key].dataType.simpleString()}, lo {kind['_lo'].dataType.simpleString()}, n long, decay double, total double, first double")


def run_ema(stream: DataFrame, path: str, checkpoint: str, key: str, value: str, order: list[str], alpha: float = 0.3) -> None:
    """STR-04. Each key's running average over its values in order of batch and order, the first as it is; see read_ema().

    A batch is reduced to a block of a key for each task that has some of it; the few blocks, in order, go on from the average
    that the batches before have left. Values without a number are skipped; equal values of the first order column should not span keys' ranges."""
    spark = stream.sparkSession
    state = StructType([stream.schema[key]]).add("ema", "double").add("samples", "long")

    def write(batch: DataFrame, number: int) -> None:
        blocks = F.array_sort(F.collect_list(F.struct("lo", "n", "decay", "total", "first")))
        new = ema_blocks(batch, key, value, order, alpha).groupBy(key).agg(blocks.alias("blocks"))
        if number:
            new = new.join(last_left(left(spark, path, state, before=number), [key]), key, "left")
        else:
            new = new.withColumns({"ema": F.lit(None).cast("double"), "samples": F.lit(None).cast("long")})
        # Without an average before, the first value counts as one.
        start = F.coalesce("ema", F.get("blocks", F.lit(0))["first"])
        ema = F.aggregate("blocks", start, lambda e, b: e * b["decay"] + b["total"])
        n = F.aggregate("blocks", F.coalesce("samples", F.lit(0).cast("long")), lambda k, b: k + b["n"])
        leave(new.select(key, ema.alias("ema"), n.alias("samples")), path, number)

    run_batches(stream, write, checkpoint)


def read_ema(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """key, ema, samples as run_ema() has left them. schema: the stream's."""
    return last_left(left(spark, path, StructType([schema[key]]).add("ema", "double").add("samples", "long")), [key])


class Status(StatefulProcessor):
    """STR-05. The stage of one document, forward only; of final events the earliest holds. Whoever stays long in a stage is reported."""

    def __init__(self, stuck_ms: int | None):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, stage int, at long")

    def row(self, key: tuple, stuck: bool) -> pd.DataFrame:
        status, stage, _ = self.state.get()
        return pd.DataFrame({"document_id": [key[0]], "status": [status], "stage": [stage], "stuck": [stuck]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        before = best
        for f in rows:
            for status, micros in zip(f["status"], f["micros"], strict=True):
                stage = STAGES.get(status)
                if stage is not None and (best is None or stage > best[1] or stage == best[1] == FINAL and (micros, status) < (best[2], best[0])):
                    best = (status, stage, int(micros))
        if best is None or best == before:
            return
        self.state.update(best)
        if self.stuck_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[1] < FINAL:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stuck_ms)
        yield self.row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] < FINAL:
            yield self.row(key, True)

    def close(self) -> None:
        pass


def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STR-09. What becomes of each user's documents: rows of SURVIVOR in, by user, those left from before first, and the changed ones out.

    A task holds the documents of one user that are left at that moment, by id, file and form."""
    user, kept, files, forms, alive = None, {}, {}, {}, {}

    def ended() -> list[tuple]:
        return [(user, doc, n, on, file, form) for doc, (n, on, file, form) in alive.items()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(SURVIVOR)
        return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, SURVIVOR, strict=True)], SURVIVOR.names)

    for batch in batches:
        out = []
        for own, doc, n, old, file, form in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != user:
                out += ended()
                user, kept, files, forms, alive = own, {}, {}, {}, {}
            if doc in kept:
                continue
            twin = None if old else min({*files.get(file, ()), *forms.get(form, ())}, default=None)
            if twin is not None:
                if n < kept[twin][0]:
                    alive[doc] = (n, False, file, form)
                    continue
                gone = kept.pop(twin)
                for index, name in ((files, gone[1]), (forms, gone[2])):
                    if name is not None:
                        index[name].remove(twin)
                alive[twin] = (gone[0], False, *gone[1:])
            kept[doc] = (n, file, form)
            for index, name in ((files, file), (forms, form)):
                if name is not None:
                    index.setdefault(name, []).append(doc)
            if not old:
                alive[doc] = (n, True, file, form)
        yield rows(out)
    yield rows(ended())


def with_keyed_state(spark: SparkSession) -> None:
    """Keyed processors keep their state in RocksDB on disk, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_status(events: DataFrame, path: str, checkpoint: str, stuck_after_s: float | None = None) -> None:
    """STR-05. The state machine of documents over events (document_id, at, status) in any order; see read_status().

    Stages only go forward and the earliest final event holds, so the end doesn't depend on how events are cut into batches.
    stuck_after_s: a document that has gone no further for so long is reported once, with the next batch; it may go on later."""
    spark = events.sparkSession
    with_keyed_state(spark)
    rows = events.select("document_id", "status", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    found = rows.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=Status(None if stuck_after_s is None else int(stuck_after_s * 1000)), outputStructType=status_type(events), outputMode="Update", timeMode="None" if stuck_after_s is None else "ProcessingTime"
    )
    # With timers a run that is to take what is there would wait for the next one without end.
    waits, before = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        spark.conf.set(waits, str(stuck_after_s is None).lower())
        run_batches(found, lambda batch, number: leave(batch, path, number), checkpoint, "update")
    finally:
        spark.conf.set(waits, before)


def status_type(events: DataFrame) -> StructType:
    return StructType([events.schema["document_id"]]).add("status", "string").add("stage", "integer").add("stuck", "boolean")


def read_status(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """document_id, status, stage, stuck of each document."""
    return last_left(left(spark, path, status_type(events)), ["document_id"])


SURVIVOR = StructType().add("user_id", "long").add("id", "long").add("n_rows", "long").add("alive", "boolean").add("file", "string").add("form", "string")


def run_survivors(documents: DataFrame, path: str, checkpoint: str) -> None:
    """STR-09. Of a user's documents that are twins, in order of arrival, a new one wins if it has as many rows at least as the old; see read_survivors().

    Twins have one file, or one type, title (not null) and clinic (null as ''); of several the first by id is the old one. The loser
    is taken back, so later documents don't meet it. documents: user_id, id, doc_type, title, clinic, file_sha256, n_rows; by
    id within a batch. An id that is alive and comes again changes nothing. A batch reads what earlier ones have left of its own users."""
    spark = documents.sparkSession
    form = F.when(F.col("title").isNotNull() & F.col("doc_type").isNotNull(), F.to_json(F.array("doc_type", "title", F.coalesce("clinic", F.lit("")))))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "id", "n_rows", F.lit(False).alias("alive"), F.col("file_sha256").alias("file"), form.alias("form"))
        if number:
            users = rows.select(F.col("user_id").alias("_user")).distinct()
            before = last_left(left(spark, path, SURVIVOR, before=number), ["user_id", "id"]).where("alive")
            rows = rows.unionByName(before.join(users, F.col("user_id").eqNullSafe(F.col("_user")), "left_semi"))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in SURVIVOR])
        ordered = rows.repartition("user_id").sortWithinPartitions("user_id", F.desc("alive"), "id", "n_rows", "file", "form")
        leave(ordered.mapInArrow(survive, SURVIVOR), path, number)

    run_batches(documents, write, checkpoint)


def read_survivors(spark: SparkSession, path: str) -> DataFrame:
    """user_id, id, n_rows of the documents that are left."""
    return last_left(left(spark, path, SURVIVOR), ["user_id", "id"]).where("alive").select("user_id", "id", "n_rows")


def run_claims(claims: DataFrame, path: str, checkpoint: str, key: str, order: str) -> None:
    """STR-07. The first claim of each key, ever, delivers it; see read_claims().

    A batch looks its keys up among all that earlier batches have delivered, of which it reads the key alone. Nothing is
    forgotten, however late a claim is repeated."""
    spark, kind = claims.sparkSession, StructType([claims.schema[key]])

    def write(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("_row")).select(key, "_row.*")
        if number:
            new = new.join(left(spark, path, kind, before=number).select(key), key, "left_anti")
        leave(new, path, number)

    run_batches(claims, write, checkpoint)


def read_claims(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The claims that have delivered. schema: the stream's."""
    return left(spark, path, schema)


def windowed(stream: DataFrame, time: str, kind: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """STR-10, beyond what is asked for: tumbling, sliding or session counts and sums with a watermark. The time is a TIMESTAMP."""
    span = F.session_window(time, size) if kind == "session" else F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(span.alias("span"), "metric").agg(F.count("*").alias("n"), F.sum("value_num").alias("total"))
    return out.select(F.col("span.start").alias("from_at"), F.col("span.end").alias("to_at"), "metric", "n", "total")


def queue_places(jobs: DataFrame) -> DataFrame:
    """STR-06. Place of each waiting job in its queue. jobs: queue, id, enqueued_at, state."""
    return jobs.where("state = 'waiting'").withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("enqueued_at", "id")))
