import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mercato.functions.columns import (
    cut,
    cut_at,
    floor_days,
    growth,
    month_label,
    months_between_labels,
    nps_band,
    percent,
    ratio,
    safe_div,
    total,
    week_label,
    weekday_name,
)
from mercato.operators.trends import pct_change


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_floor_days_rounds_down(spark):
    base = datetime(2018, 5, 1, 12)
    df = spark.createDataFrame(
        [
            (datetime(2018, 4, 30, 18), base),
            (datetime(2018, 5, 2, 0), base),
            (base, base),
            (datetime(2018, 5, 3, 1), datetime(2018, 5, 1, 23)),
            (None, base),
        ],
        "a timestamp, b timestamp",
    )
    assert values(df, floor_days("a", "b")) == [(-1,), (0,), (0,), (1,), (None,)]


def test_calendar_labels(spark):
    df = spark.createDataFrame([(datetime(2018, 1, 7, 23),), (None,)], "t timestamp")
    assert values(df, week_label("t"), month_label("t"))[0] == ("2018-01-01/2018-01-07", "2018-01")
    assert values(df, month_label("t"))[1] == (None,)
    days = spark.range(8).withColumn("d", F.col("id").cast("int"))
    assert [r[0] for r in values(days, weekday_name("d"))] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", None]
    assert values(days.limit(1), weekday_name("d", long=True)) == [("Monday",)]


def test_months_between_labels(spark):
    df = spark.createDataFrame([("2018-02", "2017-11"), ("2018-02", "2018-02")], "a string, b string")
    assert values(df, months_between_labels("a", "b")) == [(3,), (0,)]


def test_division_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 2.0), (5.0, None)], "a double, b double")
    assert values(df, ratio("a", "b")) == [(None,), (1.5,), (None,), (None,)]
    assert values(df, safe_div("a", "b", -1)) == [(-1.0,), (1.5,), (None,), (None,)]
    assert values(df, growth("a", "b")) == [(0.0,), (50.0,), (None,), (None,)]
    assert values(df, percent("a", "b")) == [(0.0,), (150.0,), (None,), (0.0,)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 2.5)], "k int, v double")
    assert sorted(values(df.groupBy("k").agg(total("v").alias("s")), "k", "s")) == [(1, 0.0), (2, 2.5)]


def test_cut_is_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(0.0,), (3.5,), (4.0,), (5.0,), (5.1,), (None,)], "v double")
    edges, labels = (0, 3.5, 4, 4.5, 5), ("Poor", "Fair", "Good", "Excellent")
    assert [r[0] for r in values(df, cut("v", edges, labels))] == [None, "Poor", "Fair", "Excellent", None, None]
    assert values(df.limit(1), cut("v", edges, labels, include_lowest=True)) == [("Poor",)]
    with pytest.raises(ValueError):
        cut("v", edges, labels[:2])


def test_cut_at_equal_edges_fall_low(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in values(df, cut_at("v", [F.lit(1.0), F.lit(1.0)], ["a", "b", "c"]))] == ["a", "c", None]


@pytest.mark.parametrize(
    "score, band",
    [(70, "World Class"), (69.9, "Excellent"), (30, "Great"), (10, "Good"), (0, "Needs Improvement"), (-0.1, "Critical")],
)
def test_nps_band(spark, score, band):
    assert spark.range(1).select(nps_band(F.lit(score))).first()[0] == band


def test_pct_change_carries_values_forward(spark):
    rows = [("1", 1.0), ("2", None), ("3", 3.0), ("4", 0.0), ("5", 5.0)]
    df = spark.createDataFrame(rows, "order_month string, v double").withColumn("g", pct_change("v"))
    assert [r.g for r in df.orderBy("order_month").collect()] == [None, 0.0, 200.0, -100.0, None]


def _totals(spark, rows):
    """The sums of a frame in several orders and partitionings."""
    frames = [spark.createDataFrame([(v,) for v in part], "v double").repartition(n) for part, n in ((rows, 1), (rows[::-1], 5))]
    return {df.agg(total("v").alias("s")).first()["s"] for df in frames}


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7, 1e12, 1e15])
def test_total_is_exact_at_every_size(spark, scale):
    rows = [(0.1 + i % 7 * 0.01) for i in range(2000)] + [scale + 0.002, -scale, scale / 3, scale / 7, -scale / 9]
    assert _totals(spark, rows) == {math.fsum(rows)}


def test_total_of_thirds(spark):
    assert _totals(spark, [500 / 3] * 3) == {500.0}
    assert _totals(spark, [1 / 3, 1 / 3, 1 / 3, None, float("nan")]) == {1.0}
    assert _totals(spark, [None]) == {0.0}
    assert _totals(spark, [-0.1] * 10 + [1.0]) == {math.fsum([-0.1] * 10 + [1.0])}


def test_total_is_the_nearest_double(spark):
    rng = random.Random(3)
    groups = []
    for g in range(400):
        size = 10 ** rng.uniform(-2, 17)
        groups += [(g, rng.choice([-1, 1, 1]) * round(rng.uniform(0, size), rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
    got = spark.createDataFrame(groups, "g int, v double").repartition(3).groupBy("g").agg(total("v").alias("s")).collect()
    want = {g: math.fsum(v for h, v in groups if h == g) for g in range(400)}
    assert {r["g"]: r["s"] for r in got} == want
