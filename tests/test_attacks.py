"""Attacks on the same games, and narration from one side's plies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.operators import anomaly, narrate


def test_against_attacks_keeps_every_game_once_per_attack(spark):
    rows = [(1, g, a, float(g)) for g in range(5) for a in ("clean", *anomaly.ATTACKS)]
    features = spark.createDataFrame(rows, "player long, game_id long, attack string, resid_max double")
    found = anomaly.against_attacks(features).groupBy("attack", "altered").agg(F.count("*").alias("n"), F.countDistinct("game_id").alias("g")).collect()
    assert {(r["attack"], r["altered"], r["n"], r["g"]) for r in found} == {(a, l, 5, 5) for a in anomaly.ATTACKS for l in (True, False)}


def test_curves_leave_out_players_with_few_games(spark):
    def ply(player, game, ply):
        return (player, game, ply, 3.0 + ply % 4, 1.2, 0.5, 1.0 + ply % 3, 0.8, False, 20.0 if game % 2 else None)

    plies = spark.createDataFrame(
        [ply(p, g, i) for p, n in ((1, 12), (2, 4)) for g in range(n) for i in range(12)],
        "player long, game_id long, ply long, think_time double, pred_log_think_time double, maia_prob_played double, maia_surprise double, maia_prob_best_move double, played_best_move boolean, gap_1_2 double",
    )
    sizes = {(r["player"], r["curve"], r["altered"]): r["count"] for r in anomaly.curve_scores(plies).groupBy("player", "curve", "altered").count().collect()}
    assert sizes == {(1, c, a): n for c, n in (("flat", 12), ("selective", 6)) for a in (True, False)}
    assert anomaly.curve_scores(plies.limit(0)).count() == 0


def test_both_sides_never_shows_a_dropped_own_ply_as_the_opponents(spark):
    own = spark.createDataFrame([(7, 1, 1, 2.0), (7, 1, 5, 3.0), (8, 2, 0, 1.0)], "player long, game_id long, ply long, think_time double")
    record = spark.createDataFrame([(g, i, f"m{i}") for g in (1, 2, 3) for i in range(6)], "game_id long, ply long, move_san string")
    found = narrate.both_sides(own, record)
    others = {(r["player"], r["game_id"], r["ply"], r["move_san"], r["think_time"]) for r in found.where("NOT is_own").collect()}
    assert others == {(7, 1, i, f"m{i}", None) for i in (0, 2, 4)} | {(8, 2, i, f"m{i}", None) for i in (1, 3, 5)}
    assert found.where("is_own").count() == 3
