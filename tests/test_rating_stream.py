"""Ratings and form in a stream: pieces of any size, deliveries and restarts give what one pass gives."""

import datetime as dt
import random

import pandas as pd

from augury.operators.rating import advance
from augury.streaming import jobs


class FakeMap(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class FakeHandle:
    def getMapState(self, name, key, value):
        return FakeMap()


def results(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        home, away = rng.sample("abcdefg", 2)
        start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 40), microseconds=rng.randrange(10 ** 6))
        rows.append((i, home, away, start, rng.choice([0.0, 0.5, 1.0])))
    return pd.DataFrame(rows, columns=["game_id", "home_key", "away_key", "start_time", "result"])


def brute(rows):
    rating, recent, out = {}, {}, {}
    for r in rows.sort_values(["start_time", "game_id"]).itertuples():
        new = advance(rating, r.home_key, r.away_key, r.result, 16.0)
        for team, own in ((r.home_key, r.result), (r.away_key, 1 - r.result)):
            recent[team] = [*recent.get(team, []), own][-5:]
        out[r.game_id] = (*new, *(sum(recent[t]) / len(recent[t]) for t in (r.home_key, r.away_key)))
    return out


def by_id(frames):
    table = pd.concat(frames)
    assert list(table["game_id"]) == list(table.drop_duplicates("game_id")["game_id"])
    return {r.game_id: (r.home_rating, r.away_rating, r.home_form, r.away_form) for r in table.itertuples()}


def test_pieces_of_a_batch_are_ordered_in_the_store():
    """A batch ten times as large, in pieces of seven rows, holds one day at a time and gives the same rows."""
    for n in (60, 600):
        rows = results(n)
        league = jobs.LeagueRatings()
        league.init(FakeHandle())
        pieces = iter([rows.iloc[i: i + 7] for i in range(0, n, 7)])
        frames = list(league.handleInputRows(("baseball", "L"), pieces, None))
        assert len(frames) == rows["start_time"].dt.date.nunique() and max(map(len, frames)) < n / 3
        assert by_id(frames) == brute(rows) and not league.waiting
        one = jobs.LeagueRatings()
        one.init(FakeHandle())
        assert by_id(list(one.handleInputRows(("baseball", "L"), iter([rows]), None))) == brute(rows)
        assert one.teams == league.teams and list(one.handleInputRows(("baseball", "L"), iter([]), None)) == []


def test_state_outlives_a_restart(spark, tmp_path):
    rows = results(90)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    table = spark.createDataFrame(rows.assign(sport="baseball", league="L", status="final", outcome=0)).selectExpr(
        "game_id", "sport", "league", "home_key", "away_key", "cast(start_time as timestamp_ntz) start_time", "status",
        "cast(case result when 1 then 2 when 0.5 then 1 else 0 end as int) home_score",
        "cast(case result when 0 then 2 when 0.5 then 1 else 0 end as int) away_score", "cast(outcome as int) outcome")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in ("start_time < '2024-01-20'", "start_time >= '2024-01-20'"):
        table.where(part).coalesce(1).write.mode("append").parquet(source)
        jobs.to_table(jobs.rating_stream(jobs.read_stream(spark, table.schema, source)), out, checkpoint, jobs.ROCKS)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got, want = by_id([spark.read.parquet(out).toPandas()]), brute(rows)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for i in want for a, b in zip(got[i], want[i]))
