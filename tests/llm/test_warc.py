import hashlib
import struct

from conftest import FOLDER

from augury.llm import warc
from augury.llm.queries import QUERIES

BIG, OTHER = "é" * 600, "b" * 1000


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", BIG), (2, None, BIG), (9, "http://c", BIG), (4, "u", OTHER), (5, "u", "small"), (6, "u", "small"),
            (7, "u", None), (8, "u", ""), (None, "u", OTHER), (9, "http://c", BIG), (10, "u", "line\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    index = warc.write_bundles(warc.planned(pages), folder=str(tmp_path / "out"), frame_bytes=500)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert [(r["record_type"], r["refers_to"]) for r in by[1] + by[2]] == [("revisit", 9)] * 2
    assert [r["record_type"] for r in by[9]] == ["response"] * 2
    assert by[None][0]["refers_to"] == 4 and by[4][0]["record_type"] == "response"
    assert by[1][0]["url"] == "http://a/%0D%0Ax" and by[2][0]["url"] is None
    for number, _, html in rows:
        for r in by[number]:
            data = (html or "").encode()
            assert r["declared_digest"] == hashlib.sha1(data).hexdigest()
            assert r["record_type"] == "revisit" or r["payload"] == data


def test_bundle_has_a_seek_table_and_plain_frames(spark, tmp_path):
    import zstandard
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    index = warc.write_bundles(warc.planned(pages.coalesce(1)), folder=str(tmp_path / "out"), frame_bytes=2000).collect()
    data = (tmp_path / "out" / index[0]["file"].rpartition("/")[2]).read_bytes()
    count, _, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and count == len({r["frame"] for r in index}) > 3
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 40
    some = [r for r in index if r["record_id"] == 17]
    got = warc.read_records(spark.createDataFrame(some)).collect()
    assert [r["payload"].decode() for r in got] == ["page 17 " * 50]


def test_empty_and_query(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_bundles(warc.planned(pages))).collect() == []
    want = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op4_warc"](spark, FOLDER).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got} == {
        k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in want.items()} and len(got) == len(want)
