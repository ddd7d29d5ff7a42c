import zlib

from augury.llm.sharding import byte_shards

ODD = [(5, None), (None, "null id"), (3, ""), (3, ""), (7, "ä" * 4000), (9, "same"), (8, "same"), (1, "same")]


def test_shards_are_contiguous_balanced_and_gapless(spark, make):
    rows = ODD + [(100 + i, "word " * (i % 37)) for i in range(400)]
    got = sorted(byte_shards(make(rows), 4).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
    assert len(got) == len(rows)
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    total = {s: [r for r in got if r["shard"] == s] for s in range(4)}
    for part in total.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in part) for part in total.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["size"] == 1 and by_id[5]["text_crc32"] == 0
    assert by_id[7]["size"] == 8001 and by_id[7]["text_crc32"] == zlib.crc32(("ä" * 4000).encode())


def test_empty_table(make):
    assert byte_shards(make([(1, "a")]).where("doc_id > 1")).collect() == []
