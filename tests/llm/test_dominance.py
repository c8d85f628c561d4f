"""Dominance counting against brute force."""

import datetime as dt
import zlib

import numpy as np
import pytest

from palisade.llm import dominance

SCHEMA = "sale_id long, sold_at timestamp_ntz, total double"
START = dt.datetime(2024, 3, 30)


def brute(rows):
    slot = lambda t: None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
    level = lambda x: None if x is None or np.isnan(x) else int(np.floor(np.floor(100 * x + 0.5) / 100))
    points = [(i, slot(t), level(x), 1 if i is None else 1 + zlib.crc32(str(i).encode()) % 2) for i, t, x in rows]
    out = []
    for i, s, v, _ in points:
        above = None if s is None or v is None else [w for _, s2, v2, w in points if s2 is not None and v2 is not None and s2 <= s and v2 > v]
        out.append((i, s, v, None if above is None else len(above), None if above is None else sum(above)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in dominance.count_above(df, **options).collect()), key=str)


def sample(rng, n):
    rows = []
    for i in range(n):
        when = None if rng.random() < 0.05 else START + dt.timedelta(minutes=int(rng.integers(0, 6000)))
        total = None if rng.random() < 0.05 else float(np.round(rng.exponential(40), 3))
        rows.append((None if rng.random() < 0.02 else int(rng.integers(-50, n)), when, total))
    return rows


@pytest.mark.parametrize("chunks", [1, 3, 128])
def test_random_sales(spark, chunks):
    rows = sample(np.random.default_rng(3), 400)
    rows += rows[:40] + [(7, START, 12.0)] * 50  # repeated rows and a hot cell
    assert got(spark.createDataFrame(rows, SCHEMA), chunks=chunks) == brute(rows)


def test_a_cell_with_a_third_of_all_rows_and_odd_totals(spark, monkeypatch):
    monkeypatch.setattr(dominance, "HOT_CELLS", 4)
    rows = [(i, START, 5.0) for i in range(60)] + sample(np.random.default_rng(4), 120)
    rows += [(900, START, float("nan")), (901, START, -3.5), (902, START, 0.994999), (903, START, 0.995), (904, START, 1e18)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS slot", "2 AS level", "'x' AS node", "3 AS weight")  # clashing names
    assert got(df) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, START, 1.0)], [(1, START, 1.0), (2, START, 2.0)], [(None, None, 1.0), (2, START, None)]])
def test_few_rows(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_the_session_zone_plays_no_part(spark):
    rows = [(i, START + dt.timedelta(hours=i), float(50 - i)) for i in range(48)]  # clocks change in these hours
    df = spark.createDataFrame(rows, SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert got(df) == brute(rows)
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert got(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_broadcast_or_single_task_holds_the_cells(spark):
    """Every join and window of a recursion level is by node and chunk."""
    rows = sample(np.random.default_rng(5), 300)
    points = dominance.points(spark.createDataFrame(rows, SCHEMA)).filter("slot is not null and level is not null")
    cells = points.groupBy("slot", "level").agg({"*": "count", "weight": "sum"}).toDF("slot", "level", "n", "w")
    base = cells.selectExpr("slot AS rank", "slot", "level", "cast(level % 3 AS int) AS chunk", "n", "w", "0L AS gain_n", "0L AS gain_w")
    from pyspark.sql import functions as F

    plan = dominance._gains(base, base, F.shiftright("rank", 1), F.col("rank") % 2 == 0, F.col("rank") % 2 == 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "SinglePartition" not in plan
