"""Fitted models: agreement with direct solutions and the invariants of evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacelens.operators import anomaly, ident, logistic, models
from pacelens.plans.catalog.ident import scores as class_scores
from pacelens.sources.standins import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = 2 + x @ [0.5, -0.2, 4.0] + rng.normal(size=n) * 0.3
    label = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 + (x[:, 1] - 100) * 0.2)))
    player = np.where(rng.random(n) < 0.5, "a", "b")
    return pd.DataFrame({"player": player, "game_id": np.arange(n), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "flat": 1.0, "y": y, "label": label})


COLUMNS = ["x0", "x1", "x2", "flat"]


def test_ridge_matches_direct_solution(spark, data):
    fitted = {r.player: r for r in models.fit_ridge(spark.createDataFrame(data), COLUMNS, "y", penalty=1.0).collect()}
    for player, part in data.groupby("player"):
        x = part[["x0", "x1", "x2"]].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (part.y - part.y.mean())) / x.std(0)
        assert fitted[player].coef[:3] == pytest.approx(w)
        assert fitted[player].coef[3] == 0.0
        assert fitted[player].intercept == pytest.approx(part.y.mean() - w @ x.mean(0))


def test_logistic_matches_direct_solution(spark, data):
    fitted = {r.player: r.coef for r in logistic.fit_logistic(spark.createDataFrame(data), ["player"], ["x0", "x1"], "label").collect()}
    for player, part in data.groupby("player"):
        x = np.column_stack([np.ones(len(part)), part[["x0", "x1"]]])
        w = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            ridge = np.diag([0, 1, 1])
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (part.label - p) - ridge @ w)
        assert fitted[player] == pytest.approx(w, abs=1e-4)


def test_every_row_is_held_out_once(spark, data):
    df = spark.createDataFrame(data).withColumn("fold", (F.col("game_id") % 3).cast("int"))
    held = logistic.out_of_fold(df, ["player"], ["x0", "x1"], "label", 3).toPandas()
    assert sorted(held.game_id) == sorted(data.game_id)
    assert held.p.between(0, 1).all()


def test_identification_invariants(spark):
    t = Tables(spark, FOLDER)
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(6)]
    vectors = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"), *parts)
    held = ident.out_of_fold(ident.stratified_folds(vectors, 2), [f"e{i}" for i in range(6)], ("logistic",))
    sums = held.groupBy("player", "game_id").agg(F.sum("p").alias("s"), F.count("*").alias("c")).toPandas()
    assert len(sums) == vectors.count() and sums.s.to_numpy() == pytest.approx(1.0)
    assert (sums.c == 10).all()


def test_curves_agree_with_single_games(spark):
    scores = class_scores(Tables(spark, FOLDER))
    ranks = [r.overall_accuracy for r in ident.rank_k(scores).orderBy("k").collect()]
    assert ranks == sorted(ranks) and ranks[-1] == 1.0
    single = ident.accuracy(ident.predictions(scores)).first()
    fused = ident.fuse(scores).where("n_games = 1").first()
    assert fused.overall_accuracy == pytest.approx(single.overall_accuracy)
    assert fused.balanced_accuracy == pytest.approx(single.balanced_accuracy)
    assert ranks[0] == pytest.approx(single.overall_accuracy)


def test_small_players_drop_out_of_large_groups(spark):
    rows = [("a", g, c, 0.6 if c == "a" else 0.4) for g in range(4) for c in "ab"] + [("b", 9, c, 0.5) for c in "ab"]
    curve = ident.fuse(spark.createDataFrame(rows, "player string, game_id int, class string, p double"), sizes=(1, 3, 5)).orderBy("n_games").collect()
    assert [r.n_players_covered for r in curve] == [2, 1, 0]
    assert curve[2].overall_accuracy is None and curve[1].overall_accuracy == 1.0


def test_pairs_are_distinct_and_complete(spark):
    players = spark.createDataFrame([(i,) for i in range(6)], "player int")
    pairs = ident.sample_pairs(players, 40).collect()
    assert len({(r.a, r.b) for r in pairs}) == 15 and all(r.a < r.b for r in pairs)
    assert len(ident.sample_pairs(players, 7).collect()) == 7


def test_detector_tells_shifted_games_apart(spark):
    rng = np.random.default_rng(0)
    rows = [(p, g, bool(a), float(rng.normal() + 3 * a), float(rng.normal())) for p in ("a", "b") for g in range(20) for a in (0, 1)]
    df = spark.createDataFrame(rows, "player string, game_id int, altered boolean, good double, noise double")
    out = anomaly.detector(anomaly.detector_folds(df), {"rich": ("good", "noise"), "thin": ("noise",)}).collect()
    assert all(r.auc_rich > 0.9 and r.auc_rich > r.auc_thin for r in out)


def test_bootstrap_draws_from_all_games_either_way(spark):
    from pacelens.operators import anomaly

    rows = [(p, g, g % 2 == 0, float(g * g % 101)) for p, n in (("a", 120), ("b", 30)) for g in range(n)]
    scores = spark.createDataFrame(rows, "player string, game_id int, altered boolean, score double")
    lists = anomaly.bootstrap_evidence(scores, (1, 3), b=50)
    joined = anomaly.bootstrap_evidence(scores, (1, 3), b=50, listed=20)
    plain = lambda df: sorted((r.player, r.altered, r.n_games, round(r.evidence, 9)) for r in df.collect())
    assert plain(lists) == plain(joined) and len(plain(lists)) == 2 * 2 * 2 * 50
    drawn = {r.evidence for r in lists.where("player = 'a' AND n_games = 1 AND altered").collect()}
    late = {float(g * g % 101) for g in range(80, 120, 2)} - {float(g * g % 101) for g in range(0, 80, 2)}
    assert drawn & late or not late


def test_pairs_are_drawn_from_all_players(spark):
    from pacelens.operators import ident

    players = spark.range(1000).selectExpr("concat('p', id) AS player")
    pairs = ident.sample_pairs(players, 40).collect()
    assert len({(r.a, r.b) for r in pairs}) == 40 and all(r.a < r.b for r in pairs)
    assert len({x for r in pairs for x in (r.a, r.b)}) > 65
    few = ident.sample_pairs(spark.range(4).selectExpr("concat('p', id) AS player"), 40).collect()
    assert len(few) == 6


def test_many_groups_under_a_bounded_task(spark, monkeypatch):
    from pacelens.operators import models

    monkeypatch.setattr(models, "HELD_BYTES", 8 * 9 * 5)
    frame = spark.range(6000).selectExpr("concat('p', id % 300) AS player", "id AS game_id", "CAST(id % 17 AS DOUBLE) AS x", "2.0 * (id % 17) + 1 AS y")
    fitted = models.fit_ridge(frame, ["x"], "y", penalty=0.0, rows_per_slice=7).collect()
    assert len(fitted) == 300 and all(abs(r.coef[0] - 2) < 1e-6 and r.n_rows == 20 for r in fitted)


def test_separable_groups_settle(spark):
    from pacelens.operators import logistic

    frame = spark.range(200).selectExpr("'a' AS player", "id AS game_id", "CAST(id AS DOUBLE) / 100 AS x", "id >= 100 AS y")
    fitted = logistic.fit_logistic(frame, ["player"], ["x"], "y", penalty=1e-4).first()
    assert fitted.moved < logistic.SETTLED


def test_scaling_inside_a_group_equals_scaled_columns(spark):
    import numpy as np

    from pacelens.operators import logistic

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) * (1, 50) + (3, -20)
    y = x[:, 0] + x[:, 1] / 40 + rng.normal(size=300) > 2.5
    z = (x - x.mean(0)) / x.std(0)
    rows = [("a", i, float(a), float(b), float(c), float(d), bool(t)) for i, ((a, b), (c, d), t) in enumerate(zip(x, z, y))]
    frame = spark.createDataFrame(rows, "player string, game_id int, x0 double, x1 double, z0 double, z1 double, y boolean")
    own = logistic.fit_logistic(frame, ["player"], ["x0", "x1"], "y", standardised=True)
    scaled = logistic.fit_logistic(frame, ["player"], ["z0", "z1"], "y")
    p = [[r.p for r in logistic.probability(frame, c, ["player"], n).orderBy("game_id").collect()] for c, n in ((own, ["x0", "x1"]), (scaled, ["z0", "z1"]))]
    assert p[0] == pytest.approx(p[1], abs=1e-6)


def test_registered_tree_models_take_the_whole_job(spark, monkeypatch):
    """Registered fits use the operators' own rounds and depth; boosting sees all classes and components."""
    from pacelens.plans import catalog

    class Seen(Exception):
        pass

    def stop(*args, **kwargs):
        raise Seen(args, kwargs)

    monkeypatch.setattr(models, "fit_trees", stop)
    monkeypatch.setattr(ident, "out_of_fold", stop)
    queries = catalog.load()
    for name in ("tree_think_time_drivers", "tree_move_quality"):
        with pytest.raises(Seen) as seen:
            queries[name].run(spark, FOLDER)
        assert not {"rounds", "depth"} & set(seen.value.args[1]), name
    with pytest.raises(Seen) as seen:
        queries["two_class_boosting"].run(spark, FOLDER)
    vectors, columns, families = seen.value.args[0]
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert "boosting" in families and len(columns) == 64 and vectors.count() == table.count()


def test_full_build_narrates_all_games_and_fits_boosting(spark, monkeypatch):
    """All games of each player reach the narration, and the best of three is taken for ten players or fewer."""
    from pacelens.plans import build

    plies = spark.createDataFrame([(p, g, "c") for p in range(3) for g in range(100 * p, 100 * p + 30)], "player long, game_id long, x string")
    scores = plies.select("player", "game_id", F.col("player").alias("class"), F.lit(1.0).alias("p"))
    seen = {"families": [], "games": []}
    evaluate = lambda v, c, k=5, families=(): seen["families"].append(tuple(families)) or scores
    narrated = lambda members, sample, n: seen["games"].append(sample.count()) or sample
    for name, stub in (("insight_rows", lambda *a: plies), ("profile_panels", lambda *a: {}), ("identification_document", lambda v, s, n, m: plies)):
        monkeypatch.setattr(build, name, stub)
    monkeypatch.setattr(build.models, "baseline", lambda *a, **k: plies)
    monkeypatch.setattr(build.games, "clean_plies", lambda p: p)
    monkeypatch.setattr(build.games, "vectors", lambda p, *a: p)
    monkeypatch.setattr(build.ident, "cohort", lambda *a: plies)
    monkeypatch.setattr(build.ident, "evaluate", evaluate)
    monkeypatch.setattr(build.narrate, "narrate", narrated)
    monkeypatch.setattr(build.gold, "profile_documents", lambda p: plies)
    build.full_build(plies, plies, ["c"], [])
    build.full_build(plies, plies, ["c"], [], narrated=6)
    assert seen["games"] == [90, 6] and all(set(f) == {"logistic", "forest", "boosting"} for f in seen["families"])


def test_combiners_by_scenario_equal_one_at_a_time(spark):
    rng = np.random.default_rng(11)
    rows = [(s, p, g, bool(a), float(rng.normal() + (2 if s == "x" else 0.5) * a), float(rng.normal())) for s in "xy" for p in ("a", "b") for g in range(24) for a in (0, 1)]
    frame = spark.createDataFrame(rows, "scenario string, player string, game_id int, altered boolean, timing_score double, maia_score double").withColumn("combined", F.col("timing_score") + F.col("maia_score"))
    together = {(r.scenario, r.player): r for r in anomaly.combiner(frame, keys=("scenario", "player")).collect()}
    assert len(together) == 4 and all(r.moved < logistic.SETTLED for r in together.values())
    for s in "xy":
        for r in anomaly.combiner(frame.where(F.col("scenario") == s).drop("scenario")).collect():
            other = together[s, r.player]
            assert (r.trained_auc, r.naive_auc) == (other.trained_auc, other.naive_auc)
            assert r.weight_timing_score == pytest.approx(other.weight_timing_score)
