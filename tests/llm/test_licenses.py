from augury.llm.licenses import scan_licenses


def test_own_nearest_inherited_and_none(spark):
    rows = [("a/LICENSE", "some words\nReleased under the MIT License.", 1), ("a/x.txt", "plain", 2), ("a/b/c/y.txt", "plain", 3),
            ("a/b/top.txt", "Licensed under CC BY-NC 4.0.\nrest", 4), ("a/b/z.txt", "text\nThis is licensed under the Apache License, Version 2.0.", 5),
            ("q/r.txt", "plain", 6), (None, "Released under the MIT License.", 7), ("q/n.txt", None, 8), ("solo", "", 9), ("q/d.txt", "a\nlicense plate", 10),
            ("a/x.txt", "plain", 2)]
    files = spark.createDataFrame([(*r, "w", "s") for r in rows], "path string, text string, score long, license string, term string")
    got = scan_licenses(files).collect()
    assert len(got) == len(rows)
    by = {r["path"]: (r["license"], r["origin"], r["declared_by"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "own", "a/LICENSE") and by["a/x.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert by["a/b/c/y.txt"] == ("CC-BY-NC-4.0", "inherited", "a/b/top.txt") and by["a/b/z.txt"] == ("Apache-2.0", "own", "a/b/z.txt")
    assert by["q/r.txt"] == by[None] == by["q/n.txt"] == by["solo"] == by["q/d.txt"] == (None, None, None)
    assert scan_licenses(files.where("score > 99")).collect() == []
