"""Empty, constant, missing and skewed inputs; results must not depend on row placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacelens.functions import stats
from pacelens.functions.draws import mix
from pacelens.functions.nulls import nan_to_null
from pacelens.functions.ordered import ordered
from pacelens.operators import anomaly, games, ident, insights, models, parse, sessions
from pacelens.sources.standins import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plies(spark):
    return Tables(spark, FOLDER).plies()


def with_session(df):
    return df.withColumns({"session_game_index": F.lit(0.0), "minutes_since_prev_game": F.lit(None).cast("double")})


OPERATORS = {
    "vectors": lambda df: games.vectors(games.clean_plies(with_session(df)), min_plies=1),
    "critical": insights.critical,
    "premove": insights.premove_profile,
    "noise": parse.noise_report,
    "score": anomaly.score,
    "features": anomaly.game_features,
    "split": models.time_split,
    "experience": sessions.experience,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_input_gives_empty_output(plies, name):
    assert OPERATORS[name](plies.where("1 = 0")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_and_constant_groups(plies, name):
    first = plies.where("ply = 0").withColumns({"think_time": F.lit(4.0), "gap_1_2": F.lit(1.0)})
    assert OPERATORS[name](first).count() > 0


@pytest.mark.parametrize("name", ["critical", "premove", "noise", "score"])
def test_missing_measures(plies, name):
    blank = plies.withColumns({c: F.lit(None).cast("double") for c in ("gap_1_2", "maia_surprise", "cp_loss")})
    assert OPERATORS[name](blank).count() > 0


def test_nan_is_missing(rows):
    df = nan_to_null(rows([(float("nan"), 1), (2.0, 2)], "x double, i int"))
    assert [r.x for r in df.orderBy("i").collect()] == [None, 2.0]


def skewed(n=3000, seed=1):
    """One key holds a third of the rows; values repeat."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"k": keys, "id": rng.permutation(n), "t": rng.integers(0, 200, n), "v": rng.integers(0, 25, n).astype(float), "y": rng.random(n) < 0.4})


def test_running_columns_on_a_hot_key(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    out = ordered(df, ["k"], ["t", "id"], number="n", size="of", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, previous={"p": "v"}).toPandas()
    want = pdf.sort_values(["k", "t", "id"])
    g = want.groupby("k")
    want = want.assign(n=g.cumcount() + 1, of=g["v"].transform("size"), s=g["v"].cumsum(), m=g["v"].cummax(), p=g["v"].shift(1))
    both = want.merge(out, on="id", suffixes=("", "_got"))
    for c in ("n", "of", "s", "m"):
        assert (both[c] == both[f"{c}_got"]).all(), c
    assert both["p"].equals(both["p_got"])


def test_quantiles_on_a_hot_key(spark):
    pdf = skewed()
    got = {r.k: r.quantiles for r in stats.quantiles(spark.createDataFrame(pdf), ["k"], "v", (0.0, 0.1, 0.5, 0.77, 1.0)).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(part["v"], (0.0, 0.1, 0.5, 0.77, 1.0)))


def brute_auc(part):
    pos, neg = part.v[part.y].to_numpy(), part.v[~part.y].to_numpy()
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_on_a_hot_key(spark):
    pdf = skewed()
    got = {r.k: r.auc for r in stats.auc(spark.createDataFrame(pdf), ["k"], "y", "v").collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(brute_auc(part))


def test_hash_rank_is_a_permutation(spark):
    pdf = skewed()
    out = stats.hash_rank(spark.createDataFrame(pdf), ["k"], mix("id", 3), ["id"], "r").toPandas()
    for _, part in out.groupby("k"):
        assert sorted(part.r) == list(range(1, len(part) + 1))


def test_rows_may_come_in_any_order_and_partitioning(spark, plies):
    a = ident.stratified_folds(plies.select("player", "game_id").distinct(), 5).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = ident.stratified_folds(plies.select("player", "game_id").distinct().orderBy(F.desc("game_id")), 5).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = ["player", "game_id"]
    assert a.sort_values(key).fold.tolist() == b.sort_values(key).fold.tolist()


def test_player_with_all_games_on_one_date(rows):
    df = rows([("p", f"g{i}") for i in range(10)], "player string, game_id string").withColumn("game_date", F.lit("2024-01-01").cast("date"))
    split = models.time_split(df).collect()
    assert all(r.is_test for r in split)
    guard = models.eligibility(df, min_rows=1).first()
    assert guard.n_live_train == 0 and not guard.live_model


def test_two_players_do_not_mix_sessions(rows):
    data = [("a", "a1", "10:00"), ("b", "b1", "10:05"), ("a", "a2", "10:10"), ("b", "b2", "11:00")]
    df = rows(data, "player string, game_id string, t string").withColumn("game_datetime", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")))
    got = {r.game_id: (r.session_id, r.session_game_index) for r in sessions.sessions(df).collect()}
    assert got == {"a1": (1, 0), "a2": (1, 1), "b1": (1, 0), "b2": (2, 0)}


def test_perturbation_labels_and_sizes(plies):
    out = anomaly.perturb(plies, rate=0.1).groupBy("player", "game_id").agg(F.count_if("is_injected").alias("n"), F.count("*").alias("c"))
    assert out.where("n <> greatest(1, least(c, bround(c * 0.1, 0)))").count() == 0
    few = anomaly.perturb(plies, top_k=2, timing="smart").groupBy("player", "game_id").agg(
        F.count_if("is_injected").alias("n"), F.count("gap_1_2").alias("known")
    )
    assert few.where("n <> least(2, known)").count() == 0
    quick = anomaly.perturb(plies, rate=1.0).agg(F.min("think_time"), F.max("think_time")).first()
    assert 0.2 <= quick[0] and quick[1] <= 1.0


def test_positions_of_large_order_numbers(spark, tmp_path):
    from pacelens.sources import standins

    keys = (7, 47_500_000, 53_999_999, 2_000_000_011, 4_000_000_000_000)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = {r["o"]: r["fen_before"] for r in standins.positions(Tables(spark, str(tmp_path))).collect()}

    def mixed(x, seed):
        return (x % 2**31 * 2654435761 + seed) % 2**32

    for o in keys:
        white = mixed(o * 17 + 3, 5) // 2**26
        black = (white + 9 + mixed(o * 29 + 5, 11) // 2**16 % 46) % 64
        dice = [mixed((o * 64 + i) ** 2 % (2**31 - 1) + (o * 64 + i) * 31, 3) // 2**16 % 100 for i in range(64)]
        steps = ((60, "."), (67, "P"), (74, "p"), (77, "N"), (80, "n"), (83, "B"), (86, "b"), (89, "R"), (92, "r"), (96, "Q"), (100, "q"))
        squares = ""
        for i, d in enumerate(dice):
            piece = next(c for top, c in steps if d < top)
            squares += "K" if i == white else "k" if i == black else "." if piece in "Pp" and (i < 8 or i > 55) else piece
        rows = [squares[at : at + 8] for at in range(0, 64, 8)]
        for n in range(8, 0, -1):
            rows = [r.replace("." * n, str(n)) for r in rows]
        assert found[o].split(" ")[0] == "/".join(rows)


def test_panels_read_their_columns_from_a_stored_table(spark):
    from pacelens.plans import build
    from pacelens.plans.catalog import players

    tables = Tables(spark, FOLDER)
    panels = build.profile_panels(players.pool(tables), players.insight_rows(tables))
    for name in ("summary", "buckets", "premove", "phase_time", "difficulty_curve[]", "clutch", "maia", "skewer", "ratings"):
        read = panels[name].inputFiles()
        assert read and not [f for f in read if "lineitem" in f or "orders" in f], name


def test_full_build_reads_stored_plies(spark, monkeypatch):
    from pacelens.plans import build

    class Seen(Exception):
        pass

    def seen(features, *_, **__):
        raise Seen(features.inputFiles())

    monkeypatch.setattr(build.models, "baseline", seen)
    plies = spark.createDataFrame([(1, 2, "c")], "player long, game_id long, x string")
    with pytest.raises(Seen) as found:
        build.full_build(plies, plies, ["c"], [])
    assert found.value.args[0]  # a stored table, not the plan that made the plies
