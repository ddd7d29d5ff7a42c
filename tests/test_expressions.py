"""Hand-written rows for scalar rules, scans and sinks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from augury.functions import fixtures, odds, probability, text
from augury.operators import checks
from augury.sources import ingest, sinks


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("name, sport, key", [
    ("Manchester United", "soccer", "man-united"), ("Brighton & Hove Albion", "soccer", "brighton"),
    ("Nott'm Forest", "soccer", "nottm-forest"), ("Málaga  CF", "soccer", "malaga-cf"), ("Straße ﬁnal ½", "baseball", "strae-final-12"),
    ("Manchester United", "baseball", "manchester-united"), ("…dots…", "soccer", "dots")])
def test_team_key(spark, name, sport, key):
    assert one(spark, text.team_key(F.col("n"), F.col("s")), n=name, s=sport) == key


@pytest.mark.parametrize("name, key", [(" NYY ", "new-york-yankees"), ("A & B", "a-and-b"), ("--", None), ("Ünïted 9", "ünïted-9")])
def test_book_team_key(spark, name, key):
    assert one(spark, text.book_team_key(F.col("n")), n=name) == key


@pytest.mark.parametrize("value, out", [
    ("2024-01-01T10:00:00.9Z", "2024-01-01T10:00:00Z"), ("2024-01-01T10:00:00+02:00", "2024-01-01T08:00:00Z"),
    ("2024-01-01 10:00", "2024-01-01T10:00:00Z"), ("soon", None),
    ("2024-08-16T19:00Z", "2024-08-16T19:00:00Z"), ("2024-08-16T19:00-05:30", "2024-08-17T00:30:00Z"), ("2024-08-16", "2024-08-16T00:00:00Z")])
def test_iso_utc(spark, value, out):
    assert one(spark, fixtures.iso_utc(F.col("v")), v=value) == out


def test_devig_known_values(spark):
    home, away = odds.devig_two_way(odds.american_to_decimal(F.lit(-150)), odds.american_to_decimal(F.lit(130)))
    got = spark.range(1).select(home.alias("h"), away.alias("a")).first()
    assert got.h == pytest.approx(0.5798319328, abs=1e-9) and got.a == pytest.approx(0.4201680672, abs=1e-9)
    assert one(spark, odds.american_to_decimal(F.lit(99))) is None
    assert one(spark, odds.decimal_price(F.lit(1.0))) is None
    assert one(spark, odds.decimal_price(F.lit(float("nan")))) is None


def test_picks_and_validity(spark):
    p = F.array(F.lit(0.4), F.lit(0.2), F.lit(0.4))
    assert one(spark, probability.argmax(p)) == 0
    assert one(spark, probability.valid_vector(p, F.lit("soccer"))) is True
    assert one(spark, probability.valid_vector(p, F.lit("baseball"))) is False
    assert one(spark, probability.valid_vector(F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5)), F.lit("soccer"))) is False
    assert one(spark, probability.bin_of(F.lit(1.0))) == 9


def test_wilson_of_nothing_is_null(spark):
    low, high = probability.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None and one(spark, high) is None
    low, high = probability.wilson(F.lit(5), F.lit(10))
    assert one(spark, low) == pytest.approx(0.2366, abs=1e-4)


@pytest.mark.parametrize("start, day", [("2024-05-01 00:00:00", "2024-05-03"), ("2024-05-01 00:00:01", "2024-05-04"),
                                        ("2024-05-01 23:00:00", "2024-05-04")])
def test_available_day(spark, start, day):
    got = one(spark, fixtures.available_day(F.col("s").cast("timestamp_ntz")), s=start)
    assert got == dt.date.fromisoformat(day)


def test_token_sign(spark):
    rows = spark.createDataFrame([("gaba",), ("acetylcholine, GABA",), (None,), ("dopamine",), ("acetylcholine",)], "t string")
    sign, uncertain = text.token_sign(F.col("t"))
    assert [tuple(r) for r in rows.select(sign, uncertain).collect()] == [(-1, False), (1, True), (1, True), (1, True), (1, False)]


@pytest.mark.parametrize("cell, safe", [("=1+1", "'=1+1"), ("  -x", "'  -x"), ("plain", "plain"), ("\t@x", "'\t@x")])
def test_spreadsheet_safe(spark, cell, safe):
    assert one(spark, text.spreadsheet_safe(F.col("c")), c=cell) == safe


def test_csv_sink_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=cmd"), (2, "ok")], "id int, name string")
    sinks.write_csv(rows, str(tmp_path / "out"), ["name", "id", "note"])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["name", "id", "note"]
    assert sorted(r.name for r in back.collect()) == ["'=cmd", "ok"]


def test_results_csv_with_mark_bad_bytes_and_missing_columns(spark, tmp_path):
    body = ("﻿Date,HomeTeam,AwayTeam,FTR,FTHG,FTAG\n13/07/2024,Leeds United,Wolves,H,2,1\n"
            "01/01/2024,Ipswich,,D,1,1\n32/01/2024,A,B,H,1,0\n01/01/2024,A,Mál").encode() + b"\xff,x,,\n"
    (tmp_path / "s.csv").write_bytes(body)
    rows = {r.home_key: r for r in ingest.results_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert set(rows) == {"leeds", "a"}
    assert rows["leeds"].start_time == dt.datetime(2024, 7, 13, 14, 0)  # London summer time
    assert rows["leeds"].status == "final" and rows["leeds"].outcome == 0 and rows["leeds"].odds == [None, None, None]
    assert rows["a"].status == "scheduled" and rows["a"].home_score is None


def test_results_csv_reads_every_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,HomeTeam,AwayTeam,FTR,FTHG,FTAG\n13/07/2024,12:30,Leeds,Wolves,H,2,1\n")
    (tmp_path / "b.csv").write_text('\n"Date",AwayTeam,HomeTeam,FTR,FTAG,FTHG,Note\r\n13/07/2001,"Delta, FC",Gamma,A,3,0,x,extra\r\n')
    (tmp_path / "c.csv").write_text("")
    rows = {r.home: r for r in ingest.results_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Leeds", "Gamma"}
    assert rows["Leeds"].start_time == dt.datetime(2024, 7, 13, 11, 30)
    old = rows["Gamma"]
    assert (old.away, old.home_score, old.away_score, old.outcome) == ("Delta, FC", 0, 3, 2)
    assert old.start_time == dt.datetime(2001, 7, 13, 14, 0)


def test_season_items_need_an_offset_and_see_any_resume_mark(spark, tmp_path):
    import json
    side = {"score": 2, "isWinner": True, "team": {"id": 1, "name": "A"}}
    other = {"score": 1, "isWinner": False, "team": {"id": 2, "name": "B"}}

    def game(pk, at, **more):
        return {"gamePk": pk, "gameType": "R", "gameDate": at, "teams": {"home": side, "away": other},
                "status": {"abstractGameState": "Final", "detailedState": "Final"}, **more}
    games = [game(1, "2024-05-01T01:00:00Z"), game(2, "2024-05-01T01:00:00"), game(3, "2024-05-01T01:00:00Z", resumedFrom="x"),
             game(4, "2024-05-01T01:00:00Z", resumeDate=""), game(None, "2024-05-01T01:00:00Z")]
    (tmp_path / "d.json").write_text(json.dumps({"dates": [{"games": games}, {"games": []}, {}]}, indent=1))
    rows = checks.season_rows(ingest.season_items(spark, str(tmp_path / "d.json")), 2024).collect()
    assert {r.pk: (r.reason, r.violation) for r in rows} == {
        1: (None, None), 2: (None, "season_year"), 3: ("resumed_or_suspended", None), 4: (None, None), None: (None, "game_id")}


def test_schedule_json_resumed_and_repeated(spark, tmp_path):
    def game(pk, hour, **more):
        return {"gamePk": pk, "gameDate": f"2024-05-01T{hour:02d}:00:00Z", "status": {"abstractGameState": "Final", "detailedState": "Final"},
                "teams": {"home": {"score": 3, "team": {"name": "A"}}, "away": {"score": 1, "team": {"name": "B"}}}, **more}
    import json
    (tmp_path / "d.json").write_text(json.dumps({"dates": [{"games": [game(1, 1, resumeDate="2024-05-02"), game(2, 1)]},
                                                           {"games": [game(1, 5), game(2, 6)]}]}, indent=1))
    rows = {r.id: r for r in ingest.schedule_json(spark, str(tmp_path / "d.json")).collect()}
    assert rows["baseball:mlb:1"].outcome is None and rows["baseball:mlb:1"].home_score is None
    assert rows["baseball:mlb:2"].outcome == 0 and rows["baseball:mlb:2"].start_time.hour == 6


def test_odds_json_list_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"provider_source_row_id": "1", "sportsbook": "x", "home_price": -110}]')
    (tmp_path / "b.json").write_text('{"source": "s", "records": [{"provider_source_row_id": "2"}, {"provider_source_row_id": "3"}]}')
    rows = ingest.odds_json(spark, str(tmp_path))
    assert sorted(r.record_id for r in rows.collect()) == ["1", "2", "3"]
    assert ingest.file_manifest(spark, str(tmp_path)).count() == 2


def test_first_reason_ignores_unknown(spark):
    reason = checks.first_reason([(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b")])
    assert one(spark, reason) == "b"


def test_losses_are_clipped(spark):
    assert one(spark, probability.log_loss(F.lit(0.0))) == pytest.approx(-math.log(1e-12))
    assert one(spark, probability.binary_loss(F.lit(1), F.lit(0.0))) == pytest.approx(-math.log(1e-12))
