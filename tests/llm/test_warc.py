"""Archives: exact round trip, revisits, byte ranges."""

import gzip
import hashlib

from pyspark.sql import functions as F

from gridsignal.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def write(spark, rows):
    return warc.write_archives(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3))


def test_round_trip_with_revisits(spark):
    long, small = "é" * 600, "s" * 999
    rows = [(1, "http://a/ b\r\nX: y", long), (7, None, long), (5, "http://c", long), (2, "u", small), (3, "u", small), (4, "u", None), (6, "u", ""),
            (8, "u", "x" * 1000), (9, "u", "x" * 1000), (9, "u", "x" * 1000), (None, "u", long)]
    found = {(r["page_id"], r["url"]): r for r in warc.read_records(write(spark, rows)).collect()}
    assert found[7, None]["record_type"] == "response" and found[7, None]["payload"].decode() == long
    for page in ((1, "http://a/%20b%0D%0AX:%20y"), (5, "http://c")):
        r = found[page]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) == ("revisit", 7, 1200, None)
        assert r["payload_digest"] == hashlib.sha1(long.encode()).hexdigest()
    assert {found[i, "u"]["record_type"] for i in (2, 3, 4, 6, 9, None)} == {"response"}
    assert found[8, "u"]["refers_to"] == 9 and found[4, "u"]["payload_bytes"] == 0
    assert warc.read_records(write(spark, rows)).where("page_id = 9").count() == 2


def test_records_are_gzip_members_at_their_offsets(spark):
    index = write(spark, [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)]).collect()
    for r in index[:5]:
        with open(r["path"].removeprefix("file:"), "rb") as file:
            data = file.read()[r["offset"] : r["offset"] + r["length"]]
        text = gzip.decompress(data).decode()
        assert text.startswith("WARC/1.1\r\n") and f"page {r['page_id']} " in text and text.endswith("\r\n\r\n")


def test_selected_records_only(spark):
    index = write(spark, [(i, "u", f"page {i} " * 50) for i in range(60)])
    got = warc.read_records(index.where(F.col("page_id") % 7 == 0))
    assert sorted(r["page_id"] for r in got.collect()) == list(range(0, 60, 7))


def test_archives_are_read_by_as_many_tasks_as_they_need(spark, monkeypatch):
    index = write(spark, [(i, "u", f"page {i} " * 500) for i in range(60)])
    monkeypatch.setattr(warc, "TASK_BYTES", index.agg(F.sum("length")).first()[0] // 6)
    tasks = warc.read_records(index).select(F.spark_partition_id().alias("p")).distinct().count()
    assert 5 <= tasks <= 7


def test_a_very_long_payload(spark):
    long = "é<p>x" * 3_000_000
    got = {r["page_id"]: r for r in warc.read_records(write(spark, [(1, "u", long), (2, "u", long), (3, "u", "short")])).collect()}
    assert got[2]["payload"].decode() == long and got[1]["refers_to"] == 2
    assert got[1]["payload_digest"] == hashlib.sha1(long.encode()).hexdigest()


def test_ranges_join_near_records_only():
    rows = [{"path": p, "offset": o, "length": 10} for p, o in (("a", 0), ("a", 10), ("a", 25), ("a", 500), ("b", 510))]
    joined = [(p, b, e, len(r)) for p, b, e, r in warc.ranges(rows, gap=20, most=1000)]
    assert joined == [("a", 0, 35, 3), ("a", 500, 510, 1), ("b", 510, 520, 1)]
    assert [len(r) for *_, r in warc.ranges(rows[:3], gap=20, most=20)] == [2, 1]


def test_no_pages(spark):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], SCHEMA))).collect() == []
