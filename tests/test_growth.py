"""Plans whose work grows no faster than the rows: dealt tables, one pass, narrow joins, few entries in the store."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from augury.catalog import streams
from augury.operators import asof, graph, matching
from augury.plans import views
from augury.streaming import jobs
from test_rating_stream import FakeHandle, FakeMap, brute, by_id, results


def tables(spark, folder, orders):
    spark.range(orders).selectExpr(
        "id as o_orderkey", "id % 13 as o_custkey", "element_at(array('F', 'O', 'P'), cast(id % 3 as int) + 1) as o_orderstatus",
        "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(cast(id % 90 as int)) as o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.range(orders * 4).selectExpr(
        "id div 4 as l_orderkey", "id % 17 as l_partkey", "id % 11 as l_suppkey", "cast(id % 4 + 1 as int) as l_linenumber",
        "element_at(array('A', 'N', 'R'), cast(id % 3 as int) + 1) as l_returnflag").write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("view, key", [("forecasts", "forecast_id"), ("quotes", "record_id"), ("edges", "contacts")])
def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch, view, key):
    found = []
    for orders in (500, 1000):
        tables(spark, str(tmp_path / str(orders)), orders)
        plain = getattr(views.Tables(spark, str(tmp_path / str(orders))), view)()
        with monkeypatch.context() as m:
            m.setattr(views, "UNDEALT_ROWS", 0)
            m.setattr(views, "TASK_ROWS", 100)
            dealt = getattr(views.Tables(spark, str(tmp_path / str(orders))), view)()
        found.append(dealt.rdd.getNumPartitions())
        assert sorted(map(str, dealt.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    assert found == [20, 40]


def test_arrivals_meet_events_without_sorting_them(spark):
    day = dt.date(2024, 1, 1)
    emissions = [(day, 1, 100), (day, 1, 105), (day, 2, 109), (day, 3, 113), (day, 1, 1435), (None, 1, None), (day, None, 5)]
    edges = [(1, 2, 3, "a"), (1, 3, 1, "b"), (2, 1, 7, "a"), (1, None, 2, None)]
    left = spark.createDataFrame(emissions, "trial date, node long, step int")
    right = spark.createDataFrame(edges, "pre long, post long, contacts long, family string")
    phases = [("early", 0, 110), ("late", 110, 1440)]
    out = graph.edge_arrivals(left, right, phases, 1440)
    want = {}
    for trial, node, step in emissions:
        for pre, post, contacts, family in edges:
            if node is None or pre != node:
                continue
            due = None if step is None else step + 9
            own = [s for t, n, s in emissions if t == trial and n == post and s is not None and due is not None]
            if due is not None and due >= 1440:
                status = "pending"
            elif any(due - 11 < s < due for s in own):
                status = "rejected"
            else:
                status = "same_step" if due in own else "accepted"
            phase = next((p for p, a, b in phases if due is not None and a <= due < b), "beyond")
            n, c = want.get((trial, phase, family, status), (0, 0))
            want[trial, phase, family, status] = (n + 1, c + contacts)
    assert {tuple(r[:4]): tuple(r[4:]) for r in out.collect()} == want and len({k[3] for k in want}) == 4
    assert "Window" not in out._jdf.queryExecution().toString()
    once = graph.mean_over_trials(out, ["family"], "edge_events", {"contacts": "contact_events"})
    assert {r["family"]: r["contacts"] for r in once.collect()} == {
        f: sum(c for k, (_, c) in want.items() if k[2] == f) for f in ("a", "b", None)}


def test_records_meet_candidates_once(spark):
    at = dt.datetime(1998, 5, 1, 20)
    fixtures = [(1, "a", "b", at), (2, "a", "b", at), (3, "a", "b", at + dt.timedelta(hours=1)), (4, "c", "d", at), (4, "c", "e", at)]
    none = (None, None, None, None, None)
    day, zone = dt.date(1998, 5, 1), "America/New_York"
    records = [("id", "c", "d", 4, *none[1:]), ("id", "c", "d", 4, *none[1:]), ("wrong", "a", "d", 4, *none[1:]),
               ("time", "a", "b", None, at, None, None, 2), ("date", "a", "b", None, None, day, zone, 3),
               ("many", "a", "b", None, None, day, zone, None), ("one", "c", "d", None, None, day, zone, 1),
               ("far", "c", "d", None, None, dt.date(1998, 6, 1), zone, None)]
    df = spark.createDataFrame(records, "record_id string, home_key string, away_key string, game_id long, start_time timestamp_ntz, "
                                        "local_date date, zone string, game_number int")
    out = matching.match_records(df, spark.createDataFrame(fixtures, "game_id long, home_key string, away_key string, start_time timestamp_ntz"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("id", 4, "matched", "game_id"), ("id", 4, "matched", "game_id"), ("wrong", None, "unmatched_fixture", None),
        ("time", 2, "matched", "start_time"), ("date", 3, "matched", "date_and_game_number"),
        ("many", None, "ambiguous_fixture", None), ("one", 4, "matched", "date_and_game_number"),
        ("far", None, "unmatched_fixture", None)], key=str)
    assert "hashpartitioning(record_id" not in out._jdf.queryExecution().toString()


def test_deliveries_are_built_with_one_join(spark, tmp_path, monkeypatch):
    tables(spark, str(tmp_path), 50)
    seen = []

    def caught(df, *_):
        seen.append(df)
        raise StopIteration

    monkeypatch.setattr(streams, "deliver", caught)
    with pytest.raises(StopIteration):
        streams.query.__globals__["_QUERIES"]["stream_first"](spark, str(tmp_path))
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {r[0]: r[1] for r in seen[0].groupBy("wave").count().collect()}[0] <= seen[0].select("forecast_key").distinct().count()


def test_only_large_batches_are_laid_down(monkeypatch):
    rows = results(600)
    for held, laid in ((10 ** 6, 0), (100, 1)):
        monkeypatch.setattr(jobs, "HELD_RESULTS", held)
        league, written = jobs.LeagueRatings(), []
        league.init(FakeHandle())

        class Store(FakeMap):
            def updateValue(self, key, value):
                written.append(key)
                super().updateValue(key, value)

        league.waiting = Store()
        pieces = iter([rows.iloc[i: i + 7] for i in range(0, len(rows), 7)])
        frames = list(league.handleInputRows(("baseball", "L"), pieces, None))
        assert by_id(frames) == brute(rows) and not league.waiting and bool(written) == bool(laid)
        assert len(frames) == rows["start_time"].dt.date.nunique() and len(written) <= len(frames) * 6


def test_swept_forms_are_joined_as_numbers(spark, monkeypatch):
    games = spark.createDataFrame(
        [(i, "baseball", "L", "ab"[i % 2], "ba"[i % 2], dt.datetime(1998, 1, 1 + i), "final", i % 5, 2, 2 if i % 5 < 2 else 0) for i in range(20)],
        "game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz, status string, "
        "home_score int, away_score int, outcome int")
    joined, attach = [], asof.attach
    monkeypatch.setattr(asof, "attach", lambda a, b, columns, **k: joined.append((columns, dict(b.dtypes))) or attach(a, b, columns, **k))
    out = {r["game_id"]: r for r in asof.sweep_features(games).collect()}
    assert not any(t.startswith("array") for columns, types in joined for c, t in types.items() if c in columns)
    assert out[0]["home_form_3_pooled"] == 0.5 and out[1]["away_form_40_role"] == 0.5
    seen = [i for i in range(20) if i + 2 <= 10]  # known two days later
    home = [float((2 < i % 5) if i % 2 == 0 else (i % 5 < 2)) if i % 5 != 2 else 0.5 for i in seen]
    assert out[10]["home_form_5_pooled"] == sum(home[-5:]) / 5


def test_texts_are_dealt_once(spark):
    from augury.llm.repeats import remove_repeats

    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=300))
    rows = [(i, text[i:] + str(i) * 120) for i in range(40)] + [(None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = remove_repeats(docs)
        removed = {r["doc_id"]: r["n_removed"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert removed[None] == 0 and removed[3] >= 297 and len(removed) == 41
    final = plan.split("Initial Plan")[0]
    dealt = [line for line in final.splitlines() if "hashpartitioning(name#" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1, dealt
