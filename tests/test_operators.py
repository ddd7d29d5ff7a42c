"""Brute-force, leakage and skew checks of the operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import asof, graph, matching, models, rating, resample, rewire, scoring
from augury.plans.ordered import exact_quantiles, hash_ranked, ranked
from augury.streaming import jobs

GAME = ("game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz, status string, "
        "home_score int, away_score int, outcome int")


def season(n=300, seed=1, hot=True):
    """Random league in which team T0 takes part in about a third of all events."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        home, away = rng.sample(range(8), 2)
        if hot and rng.random() < 0.5 and away != 0:
            home = 0
        start = dt.datetime(2024, 3, 1) + dt.timedelta(hours=rng.randrange(24 * 60))
        final = rng.random() < 0.85
        h, a = rng.randrange(6), rng.randrange(6)
        rows.append((i, rng.choice(["soccer", "baseball"]), "L", f"T{home}", f"T{away}", start, "final" if final else "scheduled",
                     h if final else None, a if final else None, (0 if h > a else 2 if h < a else 1) if final else None))
    return rows


def brute(rows, form=5):
    """Day-by-day loop over the same rules."""
    out, order = {}, sorted(rows, key=lambda r: (r[5], r[0]))
    state, elo, done = {}, {}, []
    for day in sorted({r[5].date() for r in order}):
        midnight = dt.datetime.combine(day, dt.time())
        for r in order:
            if r[0] not in done and r[9] is not None and r[5] + dt.timedelta(hours=48) <= midnight:
                done.append(r[0])
                res = 1.0 if r[7] > r[8] else 0.0 if r[7] < r[8] else 0.5
                hk, ak = (r[1], r[3]), (r[1], r[4])
                eh, ea = elo.get(hk, 1500.0), elo.get(ak, 1500.0)
                move = (16 if r[1] == "baseball" else 24) * (res - 1 / (1 + 10 ** ((ea - eh) / 400)))
                elo[hk], elo[ak] = eh + move, ea - move
                for k, x in ((hk, res), (ak, 1 - res)):
                    s = state.setdefault(k, [0, [], None])
                    s[0] += 1
                    s[1].append(x)
                    s[2] = r[5].date()
        for r in order:
            if r[5].date() == day:
                seen = []
                for k in ((r[1], r[3]), (r[1], r[4])):
                    s = state.get(k, [0, [], None])
                    last = s[1][-form:]
                    seen += [min(s[0], 50) / 50, sum(last) / len(last) if last else 0.5,
                             0.0 if s[2] is None else min(max((day - s[2]).days, 0), 14) / 14, elo.get(k, 1500.0) / 2000]
                out[r[0]] = seen
    return out


COLUMNS = ["home_games_played", "home_form", "home_rest_days", "home_elo", "away_games_played", "away_form", "away_rest_days", "away_elo"]


def features(spark, rows):
    games = spark.createDataFrame(rows, GAME)
    got = asof.pregame_features(games, rating.team_ratings(games)).select("game_id", "label", *COLUMNS).collect()
    return {r.game_id: [r[c] for c in COLUMNS] for r in got}, {r.game_id: r.label for r in got}


def test_features_equal_a_day_by_day_loop(spark):
    rows = season()
    got, labels = features(spark, rows)
    want = brute(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    assert {k for k, v in labels.items() if v == -1} == {r[0] for r in rows if r[9] is None}


def test_future_and_recent_results_cannot_leak(spark):
    rows = season(120, seed=3)
    before, _ = features(spark, rows)
    cut = sorted(r[5] for r in rows)[80]
    flipped = [r[:7] + (r[8], r[7], {0: 2, 2: 0, 1: 1}.get(r[9])) if r[5] >= cut - dt.timedelta(hours=24) else r for r in rows]
    after, _ = features(spark, flipped)
    early = [r[0] for r in rows if r[5] <= cut]
    assert early and all(before[i] == pytest.approx(after[i]) for i in early)


def test_ranked_with_one_hot_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                    (F.col("id") * 7919 % 5003).alias("x"))
    got = ranked(rows, ["g"], [F.col("x"), F.col("id")], "r", {"running": "x"}).collect()
    assert len(got) == 5000
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: (r.x, r.id))
        assert [r.r for r in group] == list(range(1, len(group) + 1))
        assert [r.running for r in group] == list(np.cumsum([r.x for r in group]))


def test_ranked_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, x int")
    assert sorted((r.g or "", r.x, r.r) for r in ranked(rows, ["g"], [F.col("x")], "r").collect()) == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]


def test_hash_ranked(spark):
    rows = spark.range(3000).select("id", F.lit("one").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = sorted(hash_ranked(rows, ["g"], "h", ["id"], "r").collect(), key=lambda r: r.r)
    assert [r.r for r in got] == list(range(1, 3001)) and [r.h for r in got] == sorted(r.h for r in got)


def test_hash_ranked_names_the_next_row_of_a_slice(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, "one").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = hash_ranked(rows, ["g"], "h", ["id"], "r", width=1, following=F.struct("id"), packed=True).collect()
    by = {(r.g, r.r): r for r in got}
    assert len(by) == 300 and {g for g, _ in by} == {None, "one"}
    for (g, n), r in by.items():
        after = by.get((g, n + 1))
        same = after is not None and after.h[0] >> 4 == r.h[0] >> 4
        assert (r._next.id if r._next else None) == (after.id if same else None)
        assert r._opens == ((g, n - 1) not in by or by[g, n - 1].h[0] >> 4 != r.h[0] >> 4)


def test_a_sweep_deals_the_edges_once(spark):
    edges = spark.range(200).selectExpr("id % 20 AS pre", "20 + id % 31 AS post", "1 AS contacts", "1 AS sign", "'s' AS source_role",
                                        "'t' AS target_role").dropDuplicates(["pre", "post"])
    plan = rewire.sweep(rewire.start(edges), 3, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # the ranked order is saved, not worked out by every reader
    after = rewire.rewire(edges, 3, 1)
    assert after.count() == edges.count() and after.select("pre", "post").distinct().count() == edges.count()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": np.round(rng.normal(size=997), 2), "b": np.array([3.0]), "c": rng.normal(size=10)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, v double")
    for r in exact_quantiles(rows, ["g"], "v", [0.0, 0.025, 0.5, 0.9, 1.0]).collect():
        assert r["quantile"] == pytest.approx(np.quantile(values[r.g], r.q))


def fixture(i, home, away, start):
    return (i, home, away, dt.datetime.fromisoformat(start))


def test_match_records_doubleheaders(spark):
    games = spark.createDataFrame([
        fixture(1, "a", "b", "2024-05-01 17:00:00"), fixture(2, "a", "b", "2024-05-01 23:00:00"),
        fixture(3, "a", "b", "2024-05-02 02:00:00"), fixture(4, "c", "d", "2024-05-01 17:00:00"), fixture(5, "c", "d", "2024-05-01 17:00:00"),
    ], "game_id long, home_key string, away_key string, start_time timestamp_ntz")
    day = dt.date(2024, 5, 1)
    ny = "America/New_York"
    rows = [("id", "a", "b", 2, None, None, None, None), ("id-wrong-teams", "c", "d", 2, None, None, None, None),
            ("instant", "a", "b", None, dt.datetime(2024, 5, 1, 17), None, None, None),
            ("instant-two", "c", "d", None, dt.datetime(2024, 5, 1, 17), None, None, None),
            ("date", "a", "b", None, None, day, ny, None), ("date-3", "a", "b", None, None, day, ny, 3), ("date-4", "a", "b", None, None, day, ny, 4),
            ("same-instant-2", "c", "d", None, None, day, ny, 2), ("none", "a", "d", None, None, day, ny, None)]
    rows += [rows[0], ("date-3", "a", "b", 1, None, None, None, None)]
    records = spark.createDataFrame(rows, "record_id string, home_key string, away_key string, game_id long, start_time timestamp_ntz, "
                                          "local_date date, zone string, game_number int")
    out = matching.match_records(records, games).collect()
    assert len(out) == len(rows) and sorted(r.game_id for r in out if r.record_id == "date-3") == [1, 3]
    got = {r.record_id: (r.game_id, r.status) for r in out if r.game_id != 1 or r.record_id != "date-3"}
    assert got == {"id": (2, "matched"), "id-wrong-teams": (None, "unmatched_fixture"), "instant": (1, "matched"),
                   "instant-two": (None, "ambiguous_fixture"), "date": (None, "ambiguous_fixture"), "date-3": (3, "matched"),
                   "date-4": (None, "unmatched_fixture"), "same-instant-2": (5, "matched"), "none": (None, "unmatched_fixture")}


def test_merge_log_moved_and_reused_ids(spark):
    def row(batch, i, home, day):
        return (batch, i, "soccer", "EPL", home, "z", dt.datetime.fromisoformat(f"{day} 15:00:00"))
    rows = [row(1, 1, "a", "2024-08-10"), row(2, 1, "b", "2024-08-11"), row(3, 2, "b", "2024-09-01"),
            row(1, 5, "c", "2024-08-10"), row(2, 6, "c", "2025-05-01"), row(3, 7, "c", "2025-08-01")]
    log = spark.createDataFrame(rows, "batch int, game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz")
    assert sorted(r.game_id for r in matching.merge_log(log, "batch").collect()) == [2, 6, 7]


def test_merge_log_keeps_cup_pairings_and_ignores_row_order(spark):
    schema = ("batch int, game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz, "
              "status string, seen int")
    day = dt.datetime(2024, 8, 10, 15)
    cup = [(1, i, "soccer", "CUP", "a", "b", day + dt.timedelta(days=i), "final", 0) for i in (1, 2)]
    pair = [(1, 9, "soccer", "EPL", "a", "b", day, "scheduled", 1), (1, 9, "soccer", "EPL", "a", "b", day, "final", 2)]
    last = [(1, 9, "soccer", "EPL", "a", "b", day, "postponed", 2)]
    for rows in (cup + pair, pair[::-1] + cup):
        got = matching.merge_log(spark.createDataFrame(rows, schema), "batch", observed="seen").collect()
        assert sorted((r.game_id, r.status) for r in got) == [(1, "final"), (2, "final"), (9, "final")]
    for rows in (pair + last, (pair + last)[::-1]):
        got = matching.merge_log(spark.createDataFrame(rows, schema).repartition(3), "batch", observed="seen").collect()
        assert [(r.game_id, r.status) for r in got] == [(9, "postponed")]


def test_bootstrap_known_difference(spark):
    """Losses that always differ by ln 2 give that mean and a closed interval, with empty weeks counted."""
    day = dt.date(2024, 1, 1)
    rows = [("g", day + dt.timedelta(days=21 * k), -float(np.log(2))) for k in (0, 1)]
    df = spark.createDataFrame(rows, "g string, day date, difference double")
    blocks = resample.week_blocks(df, ["g"], "day", ["difference"], keep_empty=True)
    got = resample.bootstrap(blocks, ["g"], ["difference"], 200, 7).first()
    assert (got.weeks, got.empty_weeks, got["rows"]) == (4, 2, 2)
    assert got.difference_mean == pytest.approx(-np.log(2)) and got.difference_low == pytest.approx(-np.log(2))


def test_logistic_fit_solves_the_stated_objective(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -0.5, 0.2] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b, c), k in zip(x, y)], "a double, b double, c double, y int")
    model = models.fit(rows, models.feature_array(["a", "b", "c"]), F.col("y"), 0.1)
    beta = np.zeros(4)
    design = np.c_[x, np.ones(400)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        penalty = np.diag([1.0, 1, 1, 0])
        grad = 0.1 * design.T @ (p - y) + penalty @ beta
        beta -= np.linalg.solve(0.1 * (design.T * (p * (1 - p))) @ design + penalty, grad)
    assert list(model.coefficients) + [model.intercept] == pytest.approx(list(beta), abs=1e-4)
    p = rows.select(models.positive(model, models.feature_array(["a", "b", "c"])).alias("p")).first().p
    assert p == pytest.approx(1 / (1 + np.exp(-design[0] @ beta)), abs=1e-4)


def test_model_queries_run(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    terms = {r.term: r for r in queries["readout_fit"](spark, "/root/testdata/sf0.01").collect()}
    assert terms["(intercept)"].coefficient == 0.0 and len(terms) == 6
    scores = queries["logistic_grid"](spark, "/root/testdata/sf0.01")
    best = models.select_from_grid(scores).first()
    assert best.log_loss == min(r.log_loss for r in scores.collect() if r.converged)
    sides = queries["quality_interval"](spark, "/root/testdata/sf0.01").agg(
        F.min(F.col("home_q") - F.col("home_low")), F.min(F.col("home_high") - F.col("home_q")), F.count("*")).first()
    assert sides[0] >= 0 and sides[1] >= 0 and sides[2] > 0


def test_rewire_keeps_every_total_and_fixes_self_edges(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(500)}
    nodes = spark.createDataFrame([(i, f"t{i % 3}", f"c{i % 4}", ["gaba", "acetylcholine"][i % 2]) for i in range(40)],
                                  "id long, type string, class string, transmitter string")
    edges = spark.createDataFrame([(a, b, 1 + (a * b) % 2) for a, b in pairs], "pre long, post long, contacts long")
    before = graph.with_strata(edges, nodes, ["c0", "c1"], ["c2"])
    after = rewire.rewire(before, 3, 2)
    report = rewire.invariants(before, after).first().asDict()
    assert report.pop("nodes") == 40 and set(report.values()) == {0}
    moved = after.where("post <> origin").count()
    assert moved > 50 and after.where("fixed AND post <> origin").count() == 0


def test_import_accounting_and_large_ids(spark):
    big = 2**54 + 1
    nodes = spark.createDataFrame([(1, "gaba"), (big, "acetylcholine")], "id long, transmitter string")
    edges = spark.createDataFrame([(1, big, 3), (big, big, 1), (1, big - 1, 5)], "pre long, post long, contacts long")
    got = graph.import_report(edges, nodes).first()
    assert (got.source_edges, got.edges, got.excluded_edges, got.excluded_contacts, got.self_edges, got.weak_edges) == (3, 2, 1, 5, 1, 1)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    ids = spark.range(2000).withColumnRenamed("id", "k")
    first = scoring.fingerprint(ids, "k").first()
    again = scoring.fingerprint(ids.orderBy(F.desc("k")).repartition(7), "k").first()
    other = scoring.fingerprint(ids.where("k <> 77"), "k").first()
    assert first == again and first.fingerprint != other.fingerprint and first.ids == 2000


def test_complete_matrix(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 0), (1, "x", 0), (2, "a", 0), (2, "b", 0)], "unit int, c string, s int")
    got = matching.matrix_complete(rows, "unit", {"c": ["a", "b"], "s": [0]}).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 0, "duplicate"), (1, "x", 0, "unexpected")]
    units = spark.createDataFrame([(1,), (3,)], "unit int")
    got = matching.matrix_complete(rows, "unit", {"c": ["a", "b"], "s": [0]}, units).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, "a", 0, "duplicate"), (1, "x", 0, "unexpected"), (2, "a", 0, "unexpected"), (2, "b", 0, "unexpected"),
        (3, "a", 0, "missing"), (3, "b", 0, "missing")]


def test_stream_resumes_after_the_last_batch(spark, tmp_path):
    source, ledger, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "cp"))
    schema = "k string, saved_at int, month string"
    seen = []

    def run():
        write = jobs.first_write(ledger, "k", "month")

        def each(batch, number):
            seen.append((number, batch.count()))
            write(batch, number)
        jobs.run_available(jobs.read_stream(spark, schema, source), checkpoint, each)

    spark.createDataFrame([("a", 2, "m1"), ("a", 1, "m1")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a", 0, "m1"), ("b", 5, "m2")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert seen == [(0, 2), (1, 2)]
    rows = {r.k: r.saved_at for r in spark.read.parquet(ledger).collect()}
    assert rows == {"a": 1, "b": 5}


def test_compacted_log_gives_the_same_schedule(spark, tmp_path):
    schema = "game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz"
    log, packed = str(tmp_path / "log"), str(tmp_path / "packed")
    for batch, rows in enumerate([[(1, "soccer", "L", "a", "b", dt.datetime(2024, 9, 1))], [(2, "soccer", "L", "a", "b", dt.datetime(2024, 9, 5))],
                                  [(3, "baseball", "L", "a", "b", dt.datetime(2024, 9, 5))]]):
        jobs.append_batch(log)(spark.createDataFrame(rows, schema), batch)
    jobs.compact(spark, log, packed, ["L"])
    want = sorted(r.game_id for r in jobs.merged_schedule(spark, log, ["L"]).collect())
    assert want == [2, 3] == sorted(r.game_id for r in jobs.merged_schedule(spark, packed, ["L"]).collect())


def test_old_result_counts_after_a_future_fixture(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    schema = "sport string, start_time timestamp_ntz, outcome int"
    for row in [("s", dt.datetime(2024, 12, 2), None), ("s", dt.datetime(2024, 6, 3), 1), ("s", dt.datetime(2024, 6, 4), 0)]:
        spark.createDataFrame([row], schema).write.mode("append").parquet(source)
        stream = jobs.weekly_counts(jobs.read_stream(spark, schema, source), "start_time")
        jobs.run_available(stream, checkpoint, jobs.append_batch(log), "update")
    rows = spark.read.parquet(log)
    assert sorted((r.batch, r.games, r.finished) for r in rows.collect()) == [(0, 1, 0), (1, 1, 1), (2, 2, 2)]


def test_scores_follow_the_latest_observation(spark, tmp_path):
    day = dt.datetime(2024, 6, 3)
    forecasts = spark.createDataFrame(
        [("f", 1, "m", "s", "a", "b", day - dt.timedelta(days=9), day, [0.6, 0.4])],
        "forecast_id string, game_id long, model string, sport string, home_key string, away_key string, saved_at timestamp_ntz, "
        "fixture_start timestamp_ntz, p array<double>")

    def game(status, hours, score):
        return (1, "s", "a", "b", day, status, score, score and 0, 0 if score else None, day + dt.timedelta(hours=hours))
    schema = ("game_id long, sport string, home_key string, away_key string, start_time timestamp_ntz, status string, home_score int, "
              "away_score int, outcome int, observed_at timestamp_ntz")
    for n, batches in enumerate([[[game("final", 5, 2), game("scheduled", 1, None)]],
                                 [[game("scheduled", 1, None), game("final", 5, 2)]],
                                 [[game("final", 5, 2)], [game("scheduled", 1, None)]]]):
        log = str(tmp_path / f"log{n}")
        for number, rows in enumerate(batches):
            jobs.rescore(forecasts, log, lambda: F.lit(day + dt.timedelta(days=30)).cast("timestamp_ntz"))(
                spark.createDataFrame(rows, schema), number)
        assert [(r.forecast_id, r.status) for r in jobs.current_scores(spark, log).collect()] == [("f", "complete")]
