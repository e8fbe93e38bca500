import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import logs, weather
from fieldmark.sources import corrections, feeds
from fieldmark.sources.store import Store
from fieldmark.streaming import windows

DAY0 = datetime(2014, 9, 1)


def test_stream_announces_what_the_batch_finds(spark, tmp_path):
    """Replayed hour by hour with a game moved twice and late rows; at every watermark the batch windows say the same."""
    games = {"g1": DAY0 + timedelta(days=6), "g2": DAY0 + timedelta(days=6, hours=3), "g3": DAY0 + timedelta(days=2)}
    moved = {30: ("g2", DAY0 + timedelta(days=5)), 90: ("g2", DAY0 + timedelta(days=7))}
    for hour in range(0, 180, 6):
        rows = [("clock", datetime(2030, 1, 1), DAY0 + timedelta(hours=hour))]
        if hour == 0:
            rows += [(g, k, DAY0) for g, k in games.items()]
        if hour in moved:
            rows += [(*moved[hour], DAY0 + timedelta(hours=hour)), (moved[hour][0], games[moved[hour][0]], DAY0 + timedelta(hours=hour - 5))]  # and an older row, late
        (tmp_path / f"in{hour:04}").write_text("\n".join(json.dumps({"game_id": g, "kickoff_utc": k.isoformat(), "said_at": s.isoformat()}) for g, k, s in rows))
        os.utime(tmp_path / f"in{hour:04}", (1_000_000_000 + hour, 1_000_000_000 + hour))
    told = windows.due_windows_stream(windows.schedule_stream(spark, str(tmp_path / "in*")), "1 second")
    query = told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("told").collect()
    assert len(got) == len({(r.game_id, r.run_type) for r in got})
    seen, start = {}, dict(games)
    for hour in range(0, 180, 6):
        if hour in moved:
            start[moved[hour][0]] = moved[hour][1]
        # rows are read at the watermark of the batch before; then it moves on
        marks = [DAY0 + timedelta(hours=h) - timedelta(seconds=1) for h in ([hour - 6] if hour in moved else []) + [hour]]
        frame = spark.createDataFrame([(*g, m) for g in start.items() for m in marks], "game_id string, kickoff_utc timestamp, at timestamp")
        for r in logs.due_windows(frame, F.col("kickoff_utc"), F.col("at")).filter("run_type is not null").orderBy("at").collect():
            seen.setdefault((r.game_id, r.run_type), r.at)
    due = {(r.game_id, r.run_type): r.told_at for r in got if r.status == "due"}
    assert due == seen and len(due) >= 6
    for r in got:
        assert r.opens <= r.told_at and (r.told_at < r.closes) == (r.status == "due")


def test_corrections_touch_only_their_seasons_and_replay_alike(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(s, f"{s}_{k}", k) for s in (2012, 2013, 2014) for k in range(4)]
    spark.createDataFrame(rows, "season long, game_id string, margin long").write.partitionBy("season").parquet(store.path("games"))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "games" / "season=2012").iterdir()}
    t = lambda h: datetime(2014, 1, 1, h)
    changes = [(2013, "2013_1", 50, t(1), False), (2013, "2013_1", 60, t(2), False), (2013, "2013_1", 10, t(0), False), (2014, "2014_0", None, t(1), True), (2014, "2014_9", 9, t(1), None), (2014, "2014_2", 2, t(1), False)]
    frame = spark.createDataFrame(changes, "season long, game_id string, margin long, corrected_at timestamp, deleted boolean")
    assert corrections.apply_corrections(store, "games", frame, ["season", "game_id"], "b1") == [2013, 2014]
    want = sorted([r for r in rows if r[1] not in ("2013_1", "2014_0")] + [(2013, "2013_1", 60), (2014, "2014_9", 9)])
    read = lambda: sorted((r.season, r.game_id, r.margin) for r in spark.read.parquet(store.path("games")).collect())
    old = lambda: sorted((r.season, r.game_id, r.margin, r.batch) for r in corrections.history(store, "games").collect())
    assert read() == want and old() == [(2013, "2013_1", 1, "b1"), (2014, "2014_0", 0, "b1")]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "games" / "season=2012").iterdir()} == before
    assert corrections.apply_corrections(store, "games", frame, ["season", "game_id"], "b1") == []
    # a failure after the seasons were written and before the commit: the batch runs again
    store.delete("games.commits/b1.json")
    assert corrections.apply_corrections(store, "games", frame, ["season", "game_id"], "b1") == [2013, 2014]
    assert read() == want and old() == [(2013, "2013_1", 1, "b1"), (2014, "2014_0", 0, "b1")]
    gone = spark.createDataFrame([(2013, f"2013_{k}", None, t(3), True) for k in range(4)], frame.schema)
    assert corrections.apply_corrections(store, "games", gone, ["season", "game_id"], "b2") == [2013]
    assert {r[0] for r in read()} == {2012, 2014} and len(old()) == 6
    assert corrections.apply_corrections(store, "games", frame.limit(0), ["season", "game_id"], "b3") == []
    with pytest.raises(ValueError):
        corrections.apply_corrections(store, "games", frame, ["game_id"], "b4")


def test_a_failed_fill_keeps_what_came_before(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = datetime(2014, 9, 7, 17)
    games = spark.createDataFrame([(f"g{v}", f"V{v}", at + timedelta(days=20 * k), 2014, "outdoors") for v in range(4) for k in range(2)], "game_id string, stadium_id string, kickoff_utc timestamp, season long, roof string")
    kept = spark.createDataFrame([("V0", at, 60.0, 1.0, 0.0, "archive")], "stadium_id string, time_utc timestamp, temp_f double, wind_mph double, precip_in double, source string")
    asked, broken = [], ["V2"]

    def fetch(ws):
        rows = ws.collect()
        asked.extend((r.stadium_id, r.first_day) for r in rows)
        if rows[0].stadium_id in broken:
            raise ConnectionError("no answer")
        hours = [(r.stadium_id, datetime.combine(r.first_day, at.time()) + timedelta(hours=h), None if h == 3 and r.stadium_id == "V1" else 50.0 + h, 2.0, 0.0, "archive") for r in rows for h in range(6)]
        return spark.createDataFrame(hours, kept.schema)

    now = datetime(2014, 12, 1)
    with pytest.raises(ConnectionError):
        weather.resume_archive(store, games, kept, now, fetch)
    first = weather.archive(store, kept)
    assert {(r.stadium_id, r.n) for r in first.groupBy("stadium_id").agg(F.count("*").alias("n")).collect()} == {("V0", 8), ("V1", 6)}
    assert first.filter("stadium_id = 'V0' and temp_f = 60").count() == 1
    broken.clear()
    asked.clear()
    done = weather.resume_archive(store, games, kept, now + timedelta(hours=1), fetch)
    assert {v for v, _ in asked} == {"V1", "V2", "V3"}  # V1's hours without a temperature are asked for again
    assert done.groupBy("stadium_id", "time_utc").count().filter("count > 1").count() == 0 and done.count() == 8 + 6 + 8 + 8
    whole = weather.compact_archive(store, kept)
    assert whole.count() == 30 and store.names("weather.parts") == []


def test_a_feed_is_a_table(spark):
    tries = {}

    def fetch(season):
        if season == 2013:
            if random.random() < 0.5:
                raise ConnectionError("again")
        return [(season, f"{season}_{k}", k) for k in range(3)]

    df = feeds.read_feed(spark, "games_feed", "season int, game_id string, margin int", fetch, [2012, 2013, 2014], feeds.Retry(attempts=30, first=0.0))
    assert df.rdd.getNumPartitions() == 3 and sorted(r.game_id for r in df.collect()) == sorted(f"{s}_{k}" for s in (2012, 2013, 2014) for k in range(3))
    assert df.filter("season = 2014").agg(F.sum("margin")).first()[0] == 3 and feeds.read_feed(spark, "none", "a int", fetch, []).collect() == []
    slept = []

    def limited(unit):
        tries[unit] = tries.get(unit, 0) + 1
        if tries[unit] < 4:
            raise feeds.RateLimited if tries[unit] == 2 else ConnectionError
        return [(1,)]

    assert feeds.Retry(attempts=4).call(limited, "u", slept.append) == [(1,)]
    assert [round(s) in (2, 65, 66, 67, 68, 69, 70, 71, 72, 8, 9) for s in slept] == [True] * 3 and slept[1] >= 65
    with pytest.raises(ConnectionError):
        feeds.Retry(attempts=2, first=0.0).call(lambda u: (_ for _ in ()).throw(ConnectionError()), "u", slept.append)


def test_raw_tables_are_shaped(spark):
    raw = spark.createDataFrame([(2014, 1, "OAK", "p1", "WR", "Out", "Did Not Participate In Practice"), (2014, 1, "SEA", "p2", "CB", None, "Limited Participation")], "season int, week int, team string, gsis_id string, position string, report_status string, practice_status string")
    assert sorted((r.team, r.practice_status) for r in feeds.injuries(raw).collect()) == [("LV", "dnp"), ("SEA", "limited")]
    people = spark.createDataFrame([("g", None, "QB", 1, 2010), (None, "x", "QB", 1, 2010)], "gsis_id string, pfr_id string, position string, draft_round int, rookie_season int")
    assert feeds.players(people).count() == 1
    charts = [("SD", "2025-09-01T00:00:00Z", "QB", 1, "b"), ("SD", "2025-09-01T00:00:00Z", "QB", 1, "a"), ("SD", "2025-09-01T00:00:00Z", "QB", 2, "c"), ("SD", "2025-09-02T00:00:00Z", "WR", 1, "d"), ("SEA", "2025-09-02T00:00:00Z", "QB", 1, None)]
    chart = spark.createDataFrame(charts, "team string, dt string, pos_abb string, pos_rank int, gsis_id string")
    assert [(r.team, r.qb_id) for r in feeds.first_passers(chart).collect()] == [("LAC", "a")] and feeds.first_passers(chart.drop("dt")).count() == 0
    whole = [(t, d[:3], d) for d, ts in feeds.DIVISIONS.items() for t in ts if t != "LV"] + [("OAK", "AFC", "AFC West"), ("XXX", "AFC", "AFC West"), ("SEA", "AFC", "AFC West")]
    table = spark.createDataFrame(whole, "team_abbr string, team_conf string, team_division string").coalesce(1)
    got = {r.team: r.division for r in feeds.teams(spark, lambda: table).collect()}
    assert len(got) == 32 and got["LV"] == "AFC West" and got["SEA"] == "NFC West"
    assert feeds.teams(spark, lambda: table.limit(5)).count() == 32 and feeds.teams(spark, lambda: spark.read.parquet("/nowhere")).count() == 32
