"""Landed files: digests of files that are not held whole, folders written by many tasks."""

import hashlib
import re
from pathlib import Path

import pytest

from augury.sources import ingest, sinks

CONTENTS = [b"one line", b"one line\n", b"\n", b"\n\n", b"a\r\nb\r\n", b"\xef\xbb\xbfmarked\nagain", b"\xef\xbb\xbfmarked\n",
            b"not \xff utf-8 \x00\n\xfe", b"long " * 5000 + b"\n" + b"x" * 3000, b"".join(b"%d\n" % i for i in range(4000))]


@pytest.mark.parametrize("whole_bytes", [0, 100, 1 << 20])
def test_digests_do_not_depend_on_how_a_file_is_read(spark, tmp_path, whole_bytes):
    (tmp_path / "b").mkdir()
    for i, content in enumerate(CONTENTS):
        (tmp_path / ("b" if i % 2 else ".") / f"f{i}.json").write_bytes(content)
    (tmp_path / "packed.json.gz").write_bytes(b"not really packed" * 100)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in
           ingest.file_manifest(spark, str(tmp_path), whole_bytes).collect()}
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("f*.json")}
    packed = (tmp_path / "packed.json.gz").read_bytes()
    assert got == want | {"packed.json.gz": (len(packed), hashlib.sha256(packed).hexdigest())}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == kept


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('r', id) AS run", "concat('text ', id) AS value").coalesce(1)
    sinks.write_folders(rows, str(tmp_path / "runs"), "run", "value")
    files = list((tmp_path / "runs").rglob("part-*"))
    assert {f.parent.name: f.read_text() for f in files} == {f"run=r{i}": f"text {i}\n" for i in range(40)}
    assert len({re.match(r"part-(\d+)", Path(f).name)[1] for f in files}) > 10
