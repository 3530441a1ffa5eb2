"""Small inputs with answers worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelens.functions import stats
from pacelens.operators import annotate, clocks, engine, games, parse, profile, sessions


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_clock_tag(rows):
    df = rows([("{[%clk 0:01:02.3]}",), ("no tag",), (None,)], "c string")
    assert values(df.select(parse.clock_seconds(F.col("c")).alias("s")), "s") == [(62.3,), (None,), (None,)]


def test_time_controls(rows):
    df = rows([("60",), ("180+2",), ("60+0",), ("1/259200",), ("",), ("x",), (None,)], "tc string")
    out = df.select(parse.time_control_base(F.col("tc")).alias("b"), parse.time_control_increment(F.col("tc")).alias("i"))
    assert values(out, "b", "i") == [(60.0, 0.0), (180.0, 2.0), (60.0, 0.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_think_time_skips_missing_clock(rows):
    df = rows(
        [("g", 0, "white", 59.0), ("g", 1, "black", 58.0), ("g", 2, "white", None), ("g", 3, "black", 50.0), ("g", 4, "white", 55.5)],
        "game_id string, ply int, side string, clock_after double",
    ).withColumns({"base_s": F.lit(60.0), "increment_s": F.lit(0.0)})
    out = {r.ply: r for r in parse.think_times(df).collect()}
    assert [out[p].think_time for p in range(5)] == [1.0, 2.0, None, 8.0, 3.5]
    assert out[4].opp_think_time_prev == 8.0 and out[4].opp_clock == 50.0


def test_full_game_text(rows):
    pgn = (
        '[Event "x"]\n[Site "Chess.com"]\n[White "Ann"]\n[Black "bob"]\n[TimeControl "60"]\n[Link "https://g/live/77/"]\n\n'
        "1. e4 {[%clk 0:00:59]} d5 {[%clk 0:00:58.5]} 2. exd5 {good (not Nf3)} {[%clk 0:00:57]} (2. e5 {worse} c5) "
        "2... Qxd5 $1 {[%clk 0:00:50]} 3. O-O-O+ 1-0"
    )
    out = parse.plies(rows([(pgn,)], "pgn string")).orderBy("ply").collect()
    assert [r.move_san for r in out] == ["e4", "d5", "exd5", "Qxd5", "O-O-O+"]
    assert [r.is_recapture for r in out] == [False, False, False, True, False]
    assert out[0].game_id == "77" and out[0].source == "chesscom"
    assert [r.clock_after for r in out] == [59.0, 58.5, 57.0, 50.0, None]
    assert out[4].castle_side == "queenside" and out[4].gives_check


def test_noise_flags(rows):
    df = rows([(-0.5,), (0.12,), (0.13,), (36.0,), (36.1,), (None,)], "think_time double").withColumn("base_s", F.lit(60.0))
    out = values(parse.flag_noise(df), "is_premove", "is_negative", "lag_suspect", "is_suspect")
    assert out == [
        (True, True, False, True), (True, False, False, True), (False, False, False, False),
        (False, False, False, False), (False, False, True, True), (False, False, False, True),
    ]


def test_scores_to_centipawns(rows):
    df = rows([(None, 1), (None, -3), (35.0, None)], "score_cp double, mate_in int")
    assert values(df.select(annotate.score_to_cp(F.col("score_cp"), F.col("mate_in")).alias("c")), "c") == [(9900.0,), (-9700.0,), (35.0,)]


def test_search_instability(rows):
    log = [("f", i, d, 1, m, float(c), None) for i, (d, m, c) in enumerate(zip(range(1, 6), "abbaa", (10, 40, 20, 15, 30)))]
    df = rows(log, "fen_before string, seq bigint, depth int, multipv int, move string, score_cp double, mate_in int")
    out = annotate.reduce_search_log(df, 5).first()
    assert (out.n_best_move_changes, out.search_stable_depth, out.eval_swing_across_depth) == (2, 4, 30.0)
    assert out.gap_1_2 is None and out.best_move == "a"


def test_rating_bins(rows):
    df = rows([(900.0,), (1150.0,), (1151.0,), (1849.0,), (2400.0,)], "r double")
    assert values(df.select(annotate.rating_bin(F.col("r")).alias("b")), "b") == [(1100,), (1100,), (1200,), (1800,), (1900,)]


def test_queue_limit_keeps_first_in_order(rows):
    todo = annotate.todo(rows([("c",), ("a",), ("b",), ("a",), (None,)], "fen_before string"), rows([("b",)], "fen_before string"), limit=1)
    assert values(todo, "fen_before") == [("a",)]


def test_entropy(rows):
    df = rows([([0.0] * 4,), ([0.0, -100.0],), ([5.0],)], "c array<double>")
    got = [r.e for r in df.select(engine.move_value_entropy(F.col("c")).alias("e")).collect()]
    assert got == pytest.approx([2.0, 0.839942, 0.0], abs=1e-6)


def test_plies_since_book(rows):
    data = [("p", g, i, b) for g, flags in (("a", "TTFFTF"), ("b", "FFT")) for i, b in enumerate(c == "T" for c in flags)]
    out = engine.plies_since_book(rows(data, "player string, game_id string, ply int, in_book boolean")).orderBy("game_id", "ply")
    assert [r.plies_since_book for r in out.collect()] == [0, 0, 1, 2, 0, 1, 1, 2, 0]


def test_rolling_spread(rows):
    df = rows([("p", "g", i, float(v)) for i, v in enumerate((10, 12, 15, 11))], "player string, game_id string, ply int, eval_before double")
    got = [r.eval_roll_std_3 for r in clocks.trajectory(df).orderBy("ply").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.414214, 2.516611, 2.081666], abs=1e-6)


def test_loss_modes(rows):
    df = rows([("p", "g", 0, 500.0), ("p", "g", 1, 500.0)], "player string, game_id string, ply int, eval_before double")
    assert [r.cp_loss for r in clocks.cp_loss(df).orderBy("ply").collect()] == [1000.0, None]
    assert [r.cp_loss for r in clocks.cp_loss(df, "mover").orderBy("ply").collect()] == [0.0, None]


def test_sessions(rows):
    data = [("p", f"g{i}", f"2024-01-01 10:{m:02d}:00" if m < 60 else "2024-01-01 11:10:00") for i, m in enumerate((0, 5, 30, 45, 70))]
    df = rows(data, "player string, game_id string, t string").select("player", "game_id", F.to_timestamp("t").alias("game_datetime"))
    out = sessions.sessions(df).orderBy("game_id").collect()
    assert [r.session_id for r in out] == [1, 1, 2, 2, 3]
    assert [r.session_game_index for r in out] == [0, 1, 0, 1, 0]
    assert [r.minutes_since_prev_game for r in out] == [None, 5.0, 25.0, 15.0, 25.0]


def test_quantile_bins(rows):
    ten = rows([(float(i),) for i in range(1, 11)], "v double")
    counts = {r._b: r["count"] for r in stats.qcut(ten, [], "v", 5, "_b").groupBy("_b").count().collect()}
    assert counts == {i: 2 for i in range(5)}
    tied = stats.qcut(rows([(v,) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0)], "v double"), [], "v", 3, "b").orderBy("v")
    assert [r.b for r in tied.collect()] == [0, 0, 0, 0, 1, 1]
    constant = stats.qcut(rows([(4.0,), (4.0,)], "v double"), [], "v", 3, "b")
    assert [r.b for r in constant.collect()] == [None, None]


def one_game(rows, times, **extra):
    df = rows([("p", "g", i, float(t)) for i, t in enumerate(times)], "player string, game_id string, ply int, think_time double")
    return games.positioned(df.withColumns({"is_mistake": F.lit(False), **extra}))


def test_trend_and_rhythm(rows):
    out = one_game(rows, (2, 4, 6, 8, 10)).groupBy("game_id").agg(*games.trends(("think_time",))).first()
    assert out.think_time_trend == 5.0
    rhythm = one_game(rows, (1, 2, 4, 3, 5)).groupBy("game_id").agg(games.rhythm()).first()
    assert rhythm.rhythm_autocorr == pytest.approx(0.4)
    constant = one_game(rows, (3, 3, 3, 3)).groupBy("game_id").agg(games.rhythm()).first()
    assert constant.rhythm_autocorr == 0.0


def test_spearman(rows):
    df = rows([(1.0, 1.0), (2.0, 5.0), (2.0, 2.0), (3.0, 9.0)], "x double, y double")
    assert stats.spearman(df, [], "x", "y", "r").first().r == pytest.approx(0.948683, abs=1e-6)


def test_anchored_scores(rows):
    df = rows([(0.205, 0.06, 0.50)], "recognition double, composure double, high double")
    out = df.select(
        profile.anchored_score(F.col("recognition"), 0.07, 0.34, True).alias("a"),
        profile.anchored_score(F.col("composure"), 0.06, 0.35, False).alias("b"),
        profile.anchored_score(F.col("high"), 0.06, 0.35, False).alias("c"),
    ).first()
    assert tuple(out) == (50, 100, 0)


def test_auc(rows):
    data = [(False, float(v)) for v in (1, 2, 3)] + [(True, float(v)) for v in (2, 4, 5)]
    df = rows(data, "altered boolean, s double")
    assert stats.auc(df, [], "altered", "s").first().auc == pytest.approx(5 / 6)
    assert stats.auc(df.withColumn("s", -F.col("s")), [], "altered", "s").first().auc == pytest.approx(1 / 6)


def test_bad_dates_are_missing(rows):
    df = rows([("2024.01.31", "10:00:01"), ("????.??.??", "10:00:00"), ("2024.02.31", None)], "date string, utc_time string")
    out = sessions.with_dates(df).collect()
    assert [str(r.game_date) for r in out] == ["2024-01-31", "None", "None"]
    assert [r.game_datetime is None for r in out] == [False, True, True]


def test_moved_half_even(rows):
    df = rows([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r.s for r in df.select(F.bround("x", 0).alias("s")).collect()] == [0.0, 2.0, 2.0]
    assert math.isclose(games.FRESH_SESSION_GAP_MINUTES, 1440.0)


def test_side_lines_of_any_depth(spark):
    for depth in (1, 4, 6, 9):
        line = "".join(f"({k}. d4 {{[%clk 0:00:0{k}]}} " for k in range(1, depth + 1)) + ")" * depth
        pgn = f'[White "a"]\n[Black "b"]\n[TimeControl "60"]\n\n1. e4 {{[%clk 0:00:58]}} {line} e5 {{(well) [%clk 0:00:57]}} 2. Nf3 (2. f4 1-0'
        out = parse.plies(spark.createDataFrame([(pgn,)], "pgn string")).orderBy("ply").collect()
        assert [(r.move_san, r.side, r.clock_after) for r in out] == [("e4", "white", 58.0), ("e5", "black", 57.0), ("Nf3", "white", None)]


def test_a_game_read_twice_counts_once(spark):
    pgn = '[Link "http://x/live/7"]\n[White "a"]\n[Black "b"]\n[TimeControl "60+1"]\n\n1. e4 {[%clk 0:00:59]} e5 {[%clk 0:01:00]} 2. Nf3 {[%clk 0:00:52]} *'
    twice = spark.createDataFrame([(pgn, "a"), (pgn, "b")], "pgn string, archive string")
    both = parse.plies(twice)
    assert sorted(r.think_time for r in both.collect()) == [1.0, 1.0, 2.0, 2.0, 8.0, 8.0]
    one = parse.plies(twice, unique=True)
    assert [(r.ply, r.think_time, r.timed_index, r.timed_total) for r in one.orderBy("ply").collect()] == [(0, 2.0, 0, 2), (1, 1.0, 0, 1), (2, 8.0, 1, 2)]
    plan = parse.plies(twice)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def brute_auc(positive, negative):
    rank = lambda x: np.inf if np.isnan(x) else x
    pairs = [(rank(a) > rank(b)) + 0.5 * (rank(a) == rank(b)) for a in positive for b in negative]
    return sum(pairs) / len(pairs) if pairs else None


def test_rank_sums_cross_batches_ranges_and_missing_keys(spark):
    rng = np.random.default_rng(3)
    values = [*map(float, range(7)), 0.5, float("nan"), None]
    rows = [(k, int(c), values[v]) for k in ("a", None, "b") for c, v in zip(rng.integers(-1, 3, 400), rng.integers(0, len(values), 400))]
    rows += [("only clean", -1, 1.0), ("only altered", 2, 1.0)]
    frame = spark.createDataFrame(rows, "key string, _class int, _score double").repartition(5)
    saved = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {r["key"]: r for r in stats.rank_sums(frame, ["key"], 3).collect()}
        aucs = stats.auc(frame.where("_class < 1").withColumn("y", F.col("_class") == 0), ["key"], "y", "_score").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", saved)
    assert set(found) == {"a", None, "b", "only clean", "only altered"}
    for key, r in found.items():
        of = lambda c: [v for k, own, v in rows if k == key and own == c and v is not None]  # noqa: B023, E731
        assert r["_negatives"] == len(of(-1))
        assert list(r["_positives"]) == [len(of(c)) for c in range(3)]
        for c in range(3):
            assert r["_wins"][c] == pytest.approx((brute_auc(of(c), of(-1)) or 0) * len(of(c)) * len(of(-1)))
        if key != "only altered":
            assert [a["auc"] for a in aucs if a["key"] == key] == [pytest.approx(brute_auc(of(0), of(-1)))] if of(0) else [None]


def test_scenarios_are_scored_from_one_row_a_ply(spark):
    from pacelens.operators import anomaly

    rng = np.random.default_rng(5)
    maybe = lambda x, share: None if rng.random() < share else float(x)
    rows = [
        (g % 3 if g else None, g, p, float(rng.integers(1, 20)), 2.0, maybe(rng.integers(0, 4) / 4, 0.2), maybe(rng.integers(0, 5) / 4, 0.3), maybe(rng.integers(0, 50), 0.3), None)
        for g in range(14) for p in range(1 + g % 6)
    ]
    rows += [(1, 99, 0, float("nan"), 2.0, None, float("nan"), 1.0, None), (1, 99, 1, 2.0, 2.0, 0.5, None, 2.0, None)]
    plies = spark.createDataFrame(rows, "player int, game_id int, ply int, think_time double, pred_log_think_time double, maia_prob_best_move double, maia_surprise double, gap_1_2 double, maia_prob_played double")
    plies = plies.withColumn("played_best_move", F.lit(False))
    scenarios = anomaly.scenario_list(ks=(1, 2))
    for reducer, names in (("mean", anomaly.MEAN_SCORES), ("max", anomaly.MAX_SCORES)):
        keys = (*anomaly.GAME, *anomaly.SCENARIO)
        one = anomaly.score_scenarios(plies, scenarios, reducer)
        assert "Generate" not in one._jdf.queryExecution().executedPlan().toString().split("Window")[1]
        rounded = lambda df: sorted(repr(tuple(r)) for r in df.select(*keys, *[F.round(c, 9) for c in names]).collect())  # noqa: B023, E731
        long = anomaly.score(anomaly.perturb_scenarios(plies, scenarios), reducer, keys)
        assert rounded(one) == rounded(long)
        told = lambda df: sorted(repr(tuple(r)) for r in df.select("player", *anomaly.SCENARIO, "score", F.round("auc", 9)).collect())
        assert told(anomaly.separation(one, scenarios, names)) == told(anomaly.scenario_auc(anomaly.against_clean(long, scenarios), names))
