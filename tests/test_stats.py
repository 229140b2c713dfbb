import random

import numpy as np
import pandas as pd
import pytest

from mercato.functions.stats import histogram, pct_rank, qcut, quantiles, value_distribution


@pytest.mark.parametrize("levels", [1, 3, 8])
@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
def test_quantiles_equal_numpy(spark, kind, levels):
    rng = random.Random(7)
    data = {
        "spread": [rng.gauss(0, 100) for _ in range(997)],
        "hot": [5.0] * 400 + [rng.uniform(0, 10) for _ in range(601)],
        "few": [1.0, 2.0, 2.0, 9.0],
    }[kind]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = quantiles(df, "v", wanted, levels=levels).first()
    assert got.n == len(data)
    assert [got[n] for n in wanted] == pytest.approx(list(np.quantile(data, list(wanted.values()))))


def test_weights_count_as_repeated_rows(spark):
    pairs = [(3, 4), (7, 1), (9, 6), (2, 0)]
    df = spark.createDataFrame(pairs, "v int, w int")
    repeated = [v for v, w in pairs for _ in range(w)]
    got = quantiles(df, "v", {"m": 0.5, "q": 0.3}, weight="w").first()
    assert (got.n, got.m, got.q) == (11, np.quantile(repeated, 0.5), pytest.approx(np.quantile(repeated, 0.3)))


def test_distribution_is_cumulative(spark):
    df = spark.createDataFrame([(v,) for v in [4, 1, 4, 2, 4, None]], "v int")
    rows = sorted((r.value, r.weight, r.below, r.total) for r in value_distribution(df, "v").collect())
    assert rows == [(1, 1, 0, 5), (2, 1, 1, 5), (4, 3, 2, 5)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles(df, "v", {"m": 0.5}).first().asDict() == {"n": 0, "m": None}
    assert histogram(df, "v", 5).collect() == []


def test_qcut(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 9)], "v int")
    rows = qcut(df, "v", "abcd", "bin", ordinal="level").orderBy("v").collect()
    assert "".join(r.bin for r in rows) == "aabbccdd"
    assert [r.level for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_qcut_matches_pandas_on_ties(spark):
    rng = random.Random(3)
    data = [float(rng.randint(0, 40)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(data)), "i int, v double")
    got = [r.bin for r in qcut(df, "v", list("abcde"), "bin").orderBy("i").collect()]
    assert got == list(pd.qcut(pd.Series(data), 5, labels=list("abcde")).astype(str))


def test_qcut_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 2]], "v int")
    assert [r.bin for r in qcut(df, "v", "abcd", "bin").orderBy("v").collect()] == ["a"] * 4 + ["d"]


def test_pct_rank(spark):
    data = [1.0, 2.0, 2.0, 3.0, None]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got = sorted(((r.v, r.pr) for r in pct_rank(df, "v", "pr").collect()), key=lambda t: (t[0] is None, t[0]))
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (3.0, 1.0), (None, None)]


def test_pct_rank_matches_pandas(spark):
    rng = random.Random(11)
    data = [float(rng.randint(0, 300)) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(data)), "i int, v double")
    got = [r.pr for r in pct_rank(df, "v", "pr").orderBy("i").collect()]
    assert got == pytest.approx(list(pd.Series(data).rank(pct=True)))


def test_histogram(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (9, 1), (10, 5), (11, 7), (-1, 7)], "v int, w int")
    rows = [tuple(r) for r in histogram(df, "v", 5, 0, 10, weight="w").collect()]
    assert rows == [(0, 0.0, 2.0, 3), (4, 8.0, 10.0, 6)]
    seen = [tuple(r) for r in histogram(df, "v", 2).collect()]
    assert seen == [(0, -1.0, 5.0, 3), (1, 5.0, 11.0, 3)]
    flat = spark.createDataFrame([(4,), (4,)], "v int")
    assert [tuple(r) for r in histogram(flat, "v", 3).collect()] == [(0, 4.0, 4.0, 2)]
