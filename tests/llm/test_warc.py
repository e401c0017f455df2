import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from inkprobe.llm import warc

BIG = "<p>é</p>" * 300
ROWS = [
    (1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, None, BIG), (2, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
    (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (7, "http://a/7", BIG), (None, "n", BIG), (None, "n", None), (12, "long", "long text " * 200_000),
]


def parse(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return fields, rest[:n]


def test_records_come_back_whole(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archive(pages, path)
    got = [(r.page_id, *parse(bytes(r.record))) for r in warc.records(spark, path).collect()]
    assert len(got) == len(ROWS)
    texts = {}
    for i, _, h in ROWS:
        texts.setdefault(i, []).append((h or "").encode())
    big = [(i, f) for i, f, b in got if f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(BIG.encode()).hexdigest()]
    assert sorted(f["WARC-Type"] for _, f in big) == ["response"] + ["revisit"] * 4
    assert [i for i, f in big if f["WARC-Type"] == "response"] == [7]
    for i, f, block in got:
        if f["WARC-Type"] == "response":
            assert block in texts[i] and "sha1:" + hashlib.sha1(block).hexdigest() == f["WARC-Payload-Digest"]
        else:
            assert block == b"" and "WARC-Refers-To" in f
    payloads = spark.read.parquet(f"{path}/payloads").collect()
    assert len(payloads) == len({hashlib.sha256((h or "").encode()).digest() for _, _, h in ROWS})
    full = {(r.page_id, bytes(r.payload)) for r in warc.read_archive(spark, path).collect()}
    assert full == {(i, (h or "").encode()) for i, _, h in ROWS}


def test_columns_come_from_the_rebuilt_records(spark, tmp_path):
    """What the headers say is what is returned, and a header that disagrees with its payload is noticed."""
    path = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    got = warc.described(spark, path).collect()
    assert sorted(r.refers_to for r in got if r.record_type == "revisit" and r.payload_bytes == len(BIG.encode())) == [7] * 4
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in ROWS}
    bad = f"file://{tmp_path}/bad"
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/headers").withColumn("header", F.regexp_replace("header", "Content-Length: 5\r", "Content-Length: 6\r")).write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="does not agree"):
        warc.described(spark, bad).collect()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.records(spark, f"file://{tmp_path}/e").collect() == []


def test_writing_leaves_no_shuffled_payloads(spark, tmp_path):
    """Else they lie on disk beside the archive and what reading it shuffles."""

    def shuffled():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [disk.apply(k) for k in range(disk.size())]
        return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle_")}

    rng = random.Random(5)
    rows = [(i, "u", rng.randbytes(10_000).hex()) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = shuffled()
    warc.write_archive(pages, f"file://{tmp_path}/w")
    end = time.time() + 10
    while (left := sum(n for f, n in shuffled().items() if f not in before)) and time.time() < end:
        time.sleep(0.2)
    assert left < 100_000
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()) == [(i, h) for i, _, h in rows]
