import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from chartlode.llm import warc

PAGES = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "u", None), (3, "u", ""), (4, "v\r\nX: y", "größe\r\n\r\nWARC/1.1\r\nContent-Length: 3"), (7, "w", "z" * 300_000), (8, "w", "small"), (6, "w", "small")]


@pytest.mark.parametrize("least", [0, 6])
def test_archive_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "record_type", "header", "sha256")})
    path = str(tmp_path / "a")
    warc.write_archive(df, path, min_revisit_bytes=least)
    got = {r.record_id: r for r in warc.digests(spark, path).collect()}
    payloads = {k: (h or "").encode() for k, _, h in PAGES}
    assert got.keys() == payloads.keys()
    for k, data in payloads.items():
        first = min(j for j, d in payloads.items() if d == data)
        revisit = len(data) >= least and first != k
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[k].record_type, got[k].refers_to) == (("revisit", first) if revisit else ("response", None))
    assert {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, path).collect()} == payloads
    assert warc.read_payloads(spark, path).count() == len(set(payloads.values()))
    warc.write_warc_files(spark, path, path + "/files")
    records = warc.read_warc_files(spark, path + "/files/part-*").collect()
    assert len(records) == len(PAGES)
    for r in records:
        k = int(r.header.split("<urn:record:")[1].split(">")[0])
        assert bytes(r.body) == (b"" if got[k].record_type == "revisit" else payloads[k])


def test_repeated_rows_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    got = sorted(((r.record_id, r.record_type, r.refers_to) for r in warc.digests(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None)], key=str)


def test_empty_table_and_damage(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.digests(spark, str(tmp_path / "e")).count() == 0
    warc.write_archive(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), str(tmp_path / "d"))
    bad = spark.read.parquet(str(tmp_path / "d/payloads")).withColumn("payload", F.lit(b"b")).collect()
    spark.createDataFrame(bad, "sha256 string, payload binary, payload_bytes long").write.mode("overwrite").parquet(str(tmp_path / "d/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.digests(spark, str(tmp_path / "d")).collect()


def test_a_record_that_is_not_what_its_header_states(spark, tmp_path):
    path = str(tmp_path / "h")
    warc.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string"), path)
    rows = warc.read_headers(spark, path).collect()
    assert warc.digests(spark, path).count() == 2
    for old, new in (("Digest: sha1:", "Digest: sha1:A"), ("Content-Length: ", "Content-Length: 1")):
        bad = [(*r[:1], r.header.replace(old, new), *r[2:]) for r in rows]
        spark.createDataFrame(bad, "record_id long, header string, sha256 string, record_type string, refers_to long").write.mode("overwrite").parquet(f"{path}/headers")
        with pytest.raises(Exception, match="damaged record"):
            warc.digests(spark, path).collect()
