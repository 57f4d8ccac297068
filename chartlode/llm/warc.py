"""Content-addressed web archive.

An archive is two tables in one folder: payloads (each distinct payload once, under its SHA-256) and headers (the exact WARC
header block of every record, with the digest that leads to its payload). Original records come back through a join. Records
can also be written as, and read from, plain WARC/1.1 files. Everything but the WARC file parser is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlode.llm.common import materialize

#: Digits of Spark's conv() in base 32, and those of RFC 4648.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are four groups of 40, each of eight digits."""
    digest = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0"), CONV32, BASE32) for i in range(4)])


def records_of(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """record_id, url, payload and its length and digests. A null payload is empty."""
    out = df.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    return out.select("record_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"))


def header(date: str) -> Column:
    """The header block of a record, to its empty line."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.lit("<urn:record:"), F.coalesce(F.col("record_id").cast("string"), F.lit("null")), F.lit(">")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write df as an archive in the new folder path.

    Of the records with equal payloads of at least min_revisit_bytes bytes, the one with the smallest id is a response and
    holds the payload; the others are revisits of it. Smaller payloads are responses all, though stored once as well. A null
    payload is empty, a null url leaves its header line out. A null id is larger than any other; records that repeat the
    smallest id are all responses. An empty table makes an empty archive. Other columns of df are not read.

    Payloads cross the network once, keyed by record; digests, lengths and ids are all that meets by digest."""
    spark = df.sparkSession
    records = records_of(df, id_col, url_col, payload_col)
    light = materialize(records.drop("payload"), "digests")
    # Length and SHA-1 must agree under one SHA-256, else two payloads share it and nothing may be stored under it.
    first = light.groupBy("sha256").agg(F.min("record_id").alias("first_id"), F.min(F.struct("payload_bytes", "payload_digest")).alias("low"), F.max(F.struct("payload_bytes", "payload_digest")).alias("high"))
    first = first.select("sha256", "first_id", F.assert_true(F.col("low") == F.col("high"), "two payloads with one SHA-256").alias("_ok"))
    # Written first, both sides of the join are dealt out by it alone, and Spark splits a digest that very many records share.
    first = materialize(first.where("_ok is null").drop("_ok"), "first")
    typed = light.join(first, "sha256").withColumn("record_type", F.when((F.col("payload_bytes") < min_revisit_bytes) | F.col("record_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit"))
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
    typed.select("record_id", header(date).alias("header"), "sha256", "record_type", "refers_to").write.parquet(f"{path}/headers")
    # One holder of each payload: the smallest (id, url) under it.
    holder = light.groupBy("sha256").agg(F.min_by(F.struct("record_id", "url"), F.struct(F.col("record_id").isNull(), "record_id", "url")).alias("h"))
    holder = holder.select(F.col("sha256").alias("h_sha256"), F.col("h.record_id").alias("h_id"), F.col("h.url").alias("h_url"))
    held = records.join(holder, F.col("record_id").eqNullSafe(F.col("h_id")) & F.col("url").eqNullSafe(F.col("h_url")) & (F.col("sha256") == F.col("h_sha256"))).select("sha256", "payload", "payload_bytes")
    (held.dropDuplicates(["sha256"]) if has_repeats(light) else held).write.option("compression", "zstd").parquet(f"{path}/payloads")


def has_repeats(light: DataFrame) -> bool:
    """Whether any (id, url, digest) occurs twice, so that a payload has several holders."""
    return bool(light.groupBy("record_id", "url", "sha256").count().where("count > 1").head(1))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload store, verified: a payload whose bytes don't have the digest that it is stored under fails the job."""
    stored = spark.read.schema("sha256 string, payload binary, payload_bytes long").parquet(f"{path}/payloads")
    payload = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    return stored.select("sha256", payload.alias("payload"))


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"record_id {id_type}, header string, sha256 string, record_type string, refers_to {id_type}").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The original records: record_id, record_type, refers_to, header, payload (of revisits too), verified."""
    headers, payloads = read_headers(spark, path, id_type), read_payloads(spark, path)
    return headers.join(payloads, "sha256").select("record_id", "record_type", "refers_to", "header", "payload")


def digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """For each record: record_id, payload_bytes, payload_digest, record_type, refers_to, from the record that the archive gives back.

    Every record is rebuilt, revisits too: its header block, joined with its payload. Length and digest are those of the rebuilt payload;
    where they aren't what the header block states (the length: of responses), the job fails."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    refers = F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), "<urn:record:(.*)>", 1)
    back = read_archive(spark, path, id_type).select("record_id", field("WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).cast(id_type).alias("refers_to"), field("WARC-Payload-Digest").alias("_stated"), field("Content-Length").cast("long").alias("_length"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    same = (F.col("_stated") == F.concat(F.lit("sha1:"), "payload_digest")) & (F.col("_length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("record_id").cast("string"), F.lit("null")))).cast("string"))
    return back.select("record_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def write_warc_files(spark: SparkSession, path: str, out: str, compression: str = "none", id_type: str = "long") -> None:
    """Write the archive's records as WARC files: a header block, the payload (none for revisits), two line ends."""
    records = read_archive(spark, path, id_type)
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    records.select(F.concat(F.col("header").cast("binary"), body).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(out)


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header block, body) of each record, by Content-Length."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start) + 4
        block = data[start:end].decode()
        length = int(re.search(r"(?mi)^content-length: *(\d+)", block)[1])
        yield block, data[end : end + length]
        at = end + length


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files: header, body. A file is one task's and held whole; write them of a few hundred MB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                records = parse_warc(data.as_py())
                while part := [x for _, x in zip(range(500), records, strict=False)]:
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part]), pa.array([b for _, b in part], pa.binary())], ["header", "body"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, body binary")
