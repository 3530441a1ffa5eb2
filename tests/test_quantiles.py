"""Quantiles by narrowing ranks against numpy, with a hot key, heavy values and null keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelens.functions import stats

PROBS = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


def _table():
    draw = random.Random(3)
    rows = [("hot", draw.gauss(0, 1)) for _ in range(6000)]
    rows += [("heavy", 5.0)] * 2500 + [("heavy", draw.random() * 10) for _ in range(2500)] + [("heavy", 7.0)] * 600
    rows += [(None, float(k)) for k in range(900)] + [("one", 2.5), ("few", 1.0), ("few", 4.0), ("few", None), ("few", float("nan")), ("none", None)]
    draw.shuffle(rows)
    return rows


def _numpy(rows):
    held = {}
    for k, v in rows:
        if v is not None and v == v:
            held.setdefault(k, []).append(v)
    return {k: np.quantile(v, PROBS) for k, v in held.items()}


@pytest.mark.parametrize("most", [10, 300, 10**6])
def test_quantiles_equal_numpy_at_every_bound(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "KEY_VALUES", most)
    rows = _table()
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = _numpy(rows)
    got = {r.k: r.q for r in stats.quantiles(df, ["k"], "v", PROBS, "q").collect()}
    assert set(got) == set(want)
    for k, q in got.items():
        assert q == pytest.approx(want[k].tolist(), abs=1e-12)


@pytest.mark.parametrize("most", [10, 10**6])
def test_quantiles_without_keys_and_of_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "KEY_VALUES", most)
    df = spark.createDataFrame([(float(k % 700),) for k in range(5000)], "v double")
    assert stats.quantiles(df, [], "v", (0.5, 0.99), "q").first().q == pytest.approx(np.quantile(np.arange(5000) % 700, (0.5, 0.99)).tolist())
    assert stats.quantiles(df.where("v < 0"), [], "v", (0.5,), "q").first().q == [None]
    assert stats.quantiles(df.where("v < 0").selectExpr("'a' AS k", "v"), ["k"], "v", (0.5,), "q").count() == 0


def test_a_spread_join_deals_a_hot_key_over_tasks(spark):
    df = spark.range(4000).selectExpr("if(id % 4 = 0, id, null) AS k", "id AS v")
    per_key = spark.createDataFrame([(None, 1.0), (4, 2.0)], "k long, w double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stats.spread_join(df, per_key, ["k"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "_slice" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
        got = joined.groupBy("k").agg(F.sum("w"), F.count("v")).orderBy("k").collect()
        assert [tuple(r) for r in got] == [(None, 3000.0, 3000), (4, 2.0, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
