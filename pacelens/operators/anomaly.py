"""Injected anomalies: altered plies, per-game scores and how well they separate.

Altering is a labelled table perturbation.  Every scenario (timing mode with a
rate or a number of critical plies) is a row of an exploded dimension, so the
whole evaluation of every player runs in one job.  Scores of many scenarios are
summed up beside each other as a game's plies are read once; only games fan out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.draws import SPAN, normal, uniform, xx
from pacelens.functions.nulls import ratio
from pacelens.functions.ordered import ordered
from pacelens.functions.shipping import ship
from pacelens.functions.stats import auc, hash_rank, join_per_key, quantiles, rank_sums
from pacelens.functions.storage import materialise
from pacelens.operators import logistic

GAME = ("player", "game_id")
SCENARIO = ("mode", "rate", "k")

# Scenario grid, draw ranges, score columns and evaluation sizes.
RATES = (0.1, 0.25, 0.5, 1.0)
CRITICAL_KS = (1, 2, 3)
TIMINGS = ("naive", "smart")
NAIVE_SECONDS = (0.2, 1.0)
DISGUISE_SPREAD = 0.15
LEAST_SECONDS = 0.1
LEAST_PROBABILITY = 1e-6
MEAN_SCORES = ("timing_score", "maia_score", "combined")
MAX_SCORES = ("timing_max", "timing_top3_mean", "maia_max", "maia_top3_mean")
RICH_FEATURES = ("resid_mean", "resid_std", "resid_max", "surprise_mean", "surprise_std", "surprise_max")
SELECTIVE_FEATURES = (
    "resid_mean", "resid_std", "resid_max", "resid_top3_mean",
    "surprise_mean", "surprise_std", "surprise_max", "surprise_top3_mean",
)
THIN_FEATURES = {"flat": ("resid_mean", "surprise_mean"), "selective": ("resid_max", "surprise_max")}
AGREEMENT_FEATURES = ("match_rate_all", "match_rate_informative", "n_informative")
BOOTSTRAP_SIZES = (1, 3, 5, 10, 20)
BOOTSTRAP_RESAMPLES = 400
CURVES = {"flat": (("smart", 1.0, None), "combined"), "selective": (("smart", None, 1), "timing_max")}
CURVE_GAMES = 10
ATTACKS = ("best_move", "alternate_move")
STRONG, WEAK = 0.75, 0.6
SEQUENCE_LENGTH = 60
WIN_CHANCE_SLOPE = 0.004

# A draw maps (channel number) to a hash column; channel 0 orders plies, 1-3 draw times.
Draw = Callable[[int], Column]


def seeded_draw(seed: int = 0) -> Draw:
    return lambda channel: xx("player", "game_id", "ply", seed=seed * 10 + channel)


def scenario_list(timings: Sequence[str] = TIMINGS, rates: Sequence[float] = RATES, ks: Sequence[int] = ()) -> list[tuple]:
    """(mode, rate, k) triples; exactly one of rate and k is set."""
    return [(m, float(r), None) for m in timings for r in rates] + [(m, None, int(k)) for m in timings for k in ks]


def _scenario_array(scenarios: Sequence[tuple]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(m).alias("mode"), F.lit(r).cast("double").alias("rate"), F.lit(k).cast("int").alias("k"))
            for m, r, k in scenarios
        ]
    )


def _quick(draw: Draw) -> Column:
    return uniform(draw(1), *NAIVE_SECONDS)


def _hidden(draw: Draw) -> Column:
    return F.greatest(F.lit(LEAST_SECONDS), F.expm1(F.col("pred_log_think_time") + DISGUISE_SPREAD * normal(draw(2), draw(3))))


def _best_surprise() -> Column:
    best = F.col("maia_prob_best_move")
    return F.when(best.isNotNull(), -F.ln(F.greatest(best, F.lit(LEAST_PROBABILITY))))


def _altered(plies: DataFrame, chosen: Column, mode: Column, draw: Draw) -> DataFrame:
    """Overwrite policy columns and think time of the chosen plies."""
    quick, hidden, best, surprise = _quick(draw), _hidden(draw), F.col("maia_prob_best_move"), _best_surprise()
    swap = lambda new, old: F.when(F.col("is_injected"), new).otherwise(F.col(old))
    return plies.withColumn("is_injected", F.coalesce(chosen, F.lit(False))).withColumns(
        {
            "maia_prob_played": swap(best, "maia_prob_played"),
            "maia_surprise": swap(surprise, "maia_surprise"),
            "played_best_move": swap(F.lit(True), "played_best_move"),
            "think_time": swap(F.when(mode == "naive", quick).when(mode == "smart", hidden).otherwise(F.col("think_time")), "think_time"),
        }
    )


def _ranked(plies: DataFrame, draw: Draw) -> DataFrame:
    """Per game: plies in draw order, plies in order of smallest gap, game length."""
    game = Window.partitionBy(*GAME)
    known = F.col("gap_1_2").isNotNull()
    return plies.withColumns(
        {
            "_by_draw": F.row_number().over(game.orderBy(draw(0), "ply")),
            "_by_gap": F.when(known, F.row_number().over(game.orderBy(F.col("gap_1_2").asc_nulls_last(), "ply"))),
            "_length": F.count(F.lit(1)).over(game),
        }
    )


def _share_of_game(rate: Column) -> Column:
    wanted = F.bround(F.col("_length") * rate, 0)
    return F.when(rate > 0, F.greatest(F.lit(1), F.least(F.col("_length"), wanted))).otherwise(0)


def perturb(plies: DataFrame, rate: float | None = None, top_k: int | None = None, timing: str = "naive", draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """Alter a seeded share of each game's plies, or its ``top_k`` closest decisions."""
    draw = draw or seeded_draw(seed)
    if (rate is None) == (top_k is None):
        raise ValueError("give exactly one of rate and top_k")
    chosen = F.col("_by_draw") <= _share_of_game(F.lit(float(rate))) if rate is not None else F.col("_by_gap") <= top_k
    return _altered(_ranked(plies, draw), chosen, F.lit(timing), draw).drop("_by_draw", "_by_gap", "_length")


def perturb_scenarios(plies: DataFrame, scenarios: Sequence[tuple], draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """Every scenario of every game, plus the untouched games as mode ``clean``.

    The ranks are windows on the game before the scenarios fan out, so the
    fan-out itself moves no data.
    """
    draw = draw or seeded_draw(seed)
    fanned = _ranked(plies.drop(*SCENARIO), draw).withColumn("_s", F.explode(_scenario_array([("clean", 0.0, None), *scenarios]))).select("*", "_s.*")
    by_rate = F.col("rate").isNotNull() & (F.col("_by_draw") <= _share_of_game(F.col("rate")))
    by_gap = F.col("k").isNotNull() & (F.col("_by_gap") <= F.col("k"))
    return _altered(fanned, by_rate | by_gap, F.col("mode"), draw).drop("_by_draw", "_by_gap", "_length", "_s")


def alternate_moves(plies: DataFrame, policy: DataFrame, top_k: int = 1, draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """Alter the ``top_k`` closest decisions to a drawn second-to-fourth choice.

    Its policy probability comes from the lookup table ``policy``
    (position, rating bin); timing is disguised.
    """
    draw = draw or seeded_draw(seed)
    hit = perturb(plies, top_k=top_k, timing="smart", draw=draw)
    moves = F.col("top_moves")
    pool = F.when(F.size(moves) > 1, F.slice(moves, F.lit(2), F.greatest(F.size(moves) - 1, F.lit(1)))).otherwise(moves)
    index = F.floor(draw(4) * F.size(pool) / F.lit(float(SPAN))).cast("int") + 1
    has_pool = F.col("is_injected") & (F.size(pool) > 0)
    looked = hit.withColumn("alternate_move", F.when(has_pool, F.try_element_at(pool, index))).join(
        policy, ["fen_before", "maia_rating_bin"], "left"
    )
    chance = F.when(F.size("maia_moves") > 0, F.try_element_at(F.map_from_arrays("maia_moves", "maia_probs"), F.col("alternate_move")))
    p = F.greatest(F.coalesce(chance, F.lit(LEAST_PROBABILITY)), F.lit(LEAST_PROBABILITY))
    changed = F.col("alternate_move").isNotNull()
    return looked.withColumns(
        {
            "maia_prob_played": F.when(changed, F.coalesce(chance, F.lit(LEAST_PROBABILITY))).otherwise(F.col("maia_prob_played")),
            "maia_surprise": F.when(changed, -F.ln(p)).otherwise(F.col("maia_surprise")),
            "played_best_move": F.when(changed, F.lit(False)).otherwise(F.col("played_best_move")),
        }
    ).drop("maia_moves", "maia_probs")


# --- per-game scores and features ----------------------------------------------------


def residual(think_time: Column | str = "think_time") -> Column:
    """Log think time minus its prediction."""
    seconds = F.col(think_time) if isinstance(think_time, str) else think_time
    return F.log1p(F.greatest(seconds, F.lit(0.0))) - F.col("pred_log_think_time")


def top3_mean(value: Column) -> Column:
    """Mean of a group's three largest values; a group is one game."""
    top = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 3)
    return ratio(F.aggregate(top, F.lit(0.0), lambda a, b: a + b), F.size(top))


def score(plies: DataFrame, reducer: str = "mean", keys: Sequence[str] = GAME) -> DataFrame:
    """Suspicion per game: faster than expected, less surprising than usual."""
    timing, plain = -residual(), -F.col("maia_surprise")
    if reducer == "mean":
        return plies.groupBy(*keys).agg(
            F.avg(timing).alias("timing_score"),
            F.avg(plain).alias("maia_score"),
            (F.avg(timing) + F.avg(plain)).alias("combined"),
        )
    if reducer == "max":
        return plies.groupBy(*keys).agg(
            F.max(timing).alias("timing_max"), top3_mean(timing).alias("timing_top3_mean"),
            F.max(plain).alias("maia_max"), top3_mean(plain).alias("maia_top3_mean"),
        )
    raise ValueError(f"unknown reducer {reducer!r}")


def _worst(values: np.ndarray, there: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(maximum, mean of the three largest) of each game's values; NaN is the largest number, a game without values has null."""
    n = np.add.reduceat(there.astype(np.int64), starts)
    odd = np.logical_or.reduceat(there & np.isnan(values), starts)
    left = np.where(there & ~np.isnan(values), values, -np.inf)
    game = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    first, total = None, np.zeros(len(starts))
    for place in range(3):
        most = np.maximum.reduceat(left, starts)
        first = most if first is None else first
        total = np.where(n > place, total + most, total)
        if place < 2:  # one of the largest goes, the others stay
            at = np.flatnonzero(left == most[game])
            left[at[np.append(True, game[at][1:] != game[at][:-1])]] = -np.inf
    empty = n == 0
    return pa.array(np.where(odd, np.nan, first), mask=empty), pa.array(np.where(odd, np.nan, total) / np.clip(n, 1, 3), mask=empty)


def _worst_scores(names: Sequence[str], versions: Sequence[int]) -> Callable:
    """Scores of every scenario from a game's list of plies: bits of the scenarios that alter a ply, its times, its surprises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(names))
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            bits, *measures = lists.flatten().flatten()
            bits = bits.to_numpy(zero_copy_only=False)
            there = [m.is_valid().to_numpy(zero_copy_only=False) for m in measures]
            values = [m.to_numpy(zero_copy_only=False).astype(float) for m in measures]
            for i, version in enumerate(versions):
                hit = (bits >> i) & 1 == 1
                found = []
                for own, other in ((0, version), (3, 4)):
                    found += _worst(np.where(hit, values[other], values[own]), np.where(hit, there[other], there[own]), starts)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.full(batch.num_rows, i, np.int32)), *found], names=[*names, "_s", *MAX_SCORES])

    return run


def score_scenarios(plies: DataFrame, scenarios: Sequence[tuple], reducer: str = "mean", draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """``score`` of ``perturb_scenarios`` by game and scenario, with mode ``clean``, without a row a ply and scenario.

    A ply has three times and two surprises, whatever the scenarios; a game's plies are read once and every scenario
    takes from each ply the version it sees."""
    if reducer not in ("mean", "max"):
        raise ValueError(f"unknown reducer {reducer!r}")
    draw = draw or seeded_draw(seed)
    every = [("clean", 0.0, None), *scenarios]
    ranked = _ranked(plies.drop(*SCENARIO), draw)
    times = (-residual(), -residual(_quick(draw)), -residual(_hidden(draw)))
    own = ranked.select(
        *GAME, "_by_draw", "_by_gap", "_length",
        *[t.alias(f"_t{i}") for i, t in enumerate(times)], (-F.col("maia_surprise")).alias("_s0"), (-_best_surprise()).alias("_s1"),
    )
    hit = [F.coalesce(F.col("_by_draw") <= _share_of_game(F.lit(r).cast("double")) if r is not None else F.col("_by_gap") <= k, F.lit(False)) for _, r, k in every]
    versions = [{"naive": 1, "smart": 2}.get(m, 0) for m, _, _ in every]
    named = _scenario_array(every)
    if reducer == "mean":
        seen = lambda c, other, own: F.avg(F.when(c, F.col(other)).otherwise(F.col(own)))
        sums = own.groupBy(*GAME).agg(
            *[seen(c, f"_t{v}", "_t0").alias(f"_a{i}") for i, (c, v) in enumerate(zip(hit, versions))], *[seen(c, "_s1", "_s0").alias(f"_b{i}") for i, c in enumerate(hit)]
        )
        rows = F.array(*[
            F.struct(named[i].alias("s"), F.col(f"_a{i}").alias("timing_score"), F.col(f"_b{i}").alias("maia_score"), (F.col(f"_a{i}") + F.col(f"_b{i}")).alias("combined"))
            for i in range(len(every))
        ])
        return sums.select(*GAME, F.inline(rows)).select(*GAME, "s.*", *MEAN_SCORES)
    if len(every) > 63:  # a bit a scenario
        return score_scenarios(plies, scenarios[:60], reducer, draw).unionByName(score_scenarios(plies, scenarios[60:], reducer, draw).where("mode <> 'clean'"))
    ship(plies.sparkSession)
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(hit)), F.lit(0).cast("bigint"))
    double = [F.col(c).cast("double").alias(c) for c in ("_t0", "_t1", "_t2", "_s0", "_s1")]
    lists = own.groupBy(*GAME).agg(F.collect_list(F.struct(bits.alias("bits"), *double)).alias("_p"))
    head = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in GAME]
    scored = lists.mapInArrow(_worst_scores(GAME, versions), ", ".join([*head, "_s int", *[f"{c} double" for c in MAX_SCORES]]))
    return scored.withColumn("_n", F.get(named, F.col("_s"))).select(*GAME, "_n.*", *MAX_SCORES)


def _feature_columns() -> list[Column]:
    r, s = residual(), F.col("maia_surprise")
    return [
        F.avg(r).alias("resid_mean"), F.stddev_pop(r).alias("resid_std"), F.max(F.abs(r)).alias("resid_max"),
        top3_mean(F.abs(r)).alias("resid_top3_mean"),
        F.avg(s).alias("surprise_mean"), F.stddev_pop(s).alias("surprise_std"), F.max(s).alias("surprise_max"),
        top3_mean(s).alias("surprise_top3_mean"),
    ]


def _agreement_columns() -> list[Column]:
    match = F.col("played_best_move").cast("double")
    informative = F.col("n_moves_within_30cp") >= 2
    return [
        F.avg(match).alias("match_rate_all"),
        F.coalesce(F.avg(F.when(informative, match)), F.avg(match)).alias("match_rate_informative"),
        F.count_if(informative).alias("n_informative"),
    ]


def game_features(plies: DataFrame, keys: Sequence[str] = GAME) -> DataFrame:
    """Direction-free summary of residuals and surprises, with the selective extras."""
    return plies.groupBy(*keys).agg(*_feature_columns())


def agreement(plies: DataFrame, keys: Sequence[str] = GAME) -> DataFrame:
    """How often the engine's move was played, over all and over informative plies."""
    return plies.groupBy(*keys).agg(*_agreement_columns())


def game_evidence(plies: DataFrame, keys: Sequence[str] = GAME) -> DataFrame:
    """Detector features and engine agreement together, in one aggregation."""
    return plies.groupBy(*keys).agg(*_feature_columns(), *_agreement_columns())


# --- separation ----------------------------------------------------------------------


def against_clean(scores: DataFrame, scenarios: Sequence[tuple]) -> DataFrame:
    """Each scenario's altered games beside the clean ones, labelled ``altered``.

    A clean game fans out to every scenario, an altered one to its own, in one pass.
    """
    clean = F.col("mode") == "clean"
    own = F.array(F.struct("mode", F.col("rate").cast("double").alias("rate"), F.col("k").cast("int").alias("k")))
    fanned = scores.withColumns({"altered": ~clean, "_s": F.explode(F.when(clean, _scenario_array(scenarios)).otherwise(own))})
    return fanned.drop(*SCENARIO).select("*", "_s.*").drop("_s")


def scenario_auc(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("player", *SCENARIO)) -> DataFrame:
    """AUC of every score column per player and scenario, long form."""
    long = labelled.select(*keys, "altered", *columns).unpivot([*keys, "altered"], list(columns), "score", "value")
    return auc(long, [*keys, "score"], "altered", "value")


def separation(scores: DataFrame, scenarios: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """``scenario_auc`` of scores by game and scenario against the clean ones: a clean score is ranked once, beside all scenarios'."""
    own = lambda m, r, k: F.col("mode").eqNullSafe(F.lit(m)) & F.col("rate").eqNullSafe(F.lit(r).cast("double")) & F.col("k").eqNullSafe(F.lit(k).cast("int"))
    place = F.coalesce(F.when(F.col("mode") == "clean", -1), *[F.when(own(*one), i) for i, one in enumerate(scenarios)])
    values = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_score")) for i, c in enumerate(columns)])
    rows = scores.select("player", place.alias("_class"), F.inline(values)).where("_class IS NOT NULL")
    sums = rank_sums(rows, ["player", "_column"], len(scenarios))
    score = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_column")).alias("score")
    found = sums.select("player", score, "_negatives", F.posexplode(F.arrays_zip("_positives", "_wins"))).where("_negatives > 0 OR col._positives > 0")
    named = found.withColumn("_s", F.get(_scenario_array(scenarios), F.col("pos")))
    return named.select("player", "_s.*", "score", ratio(F.col("col._wins"), F.col("col._positives") * F.col("_negatives")).alias("auc"))


def held_out_games(plies: DataFrame, n_games: int | None, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Plies of a seeded sample of each player's games (None: all); each task forwards at most that many."""
    if n_games is None:
        return plies
    hashed = xx("game_id", seed=seed) if order is None else order
    games = plies.select(*GAME).distinct().withColumn("_hash", hashed)
    drawn = Window.partitionBy("player").orderBy("_hash", "game_id")
    picked = games.withColumn("_rank", F.row_number().over(drawn)).where(F.col("_rank") <= n_games)
    return plies.join(picked.select(*GAME), list(GAME), "left_semi")


def long_games(plies: DataFrame, min_plies: int = 10, min_gaps: int = 0) -> DataFrame:
    """Plies of games long enough to judge, with enough known gaps."""
    sizes = plies.groupBy(*GAME).agg(F.count(F.lit(1)).alias("_n"), F.count("gap_1_2").alias("_g"))
    able = sizes.where((F.col("_n") >= min_plies) & (F.col("_g") >= min_gaps))
    return plies.join(able.select(*GAME), list(GAME), "left_semi")


def half_split(games: DataFrame, seed: int = 1, order: Column | None = None) -> DataFrame:
    """Mark half of each player's games as training, in hash order."""
    ids = games.select(*GAME).distinct()
    hashed = xx("game_id", seed=seed) if order is None else order
    ranked = hash_rank(ids, ["player"], hashed, ["game_id"], "_rank")
    sizes = ids.groupBy("player").agg(F.count(F.lit(1)).alias("_size"))
    marked = ranked.join(sizes, "player").select(*GAME, (F.col("_rank") <= F.floor(F.col("_size") / 2)).alias("is_train"))
    return games.join(marked, list(GAME))


def combiner(labelled: DataFrame, columns: Sequence[str] = ("timing_score", "maia_score"), naive: str = "combined", seed: int = 1, order: Column | None = None, keys: Sequence[str] = ("player",)) -> DataFrame:
    """Trained combination per key against the plain sum, on the games not trained on.

    ``keys`` beyond the player (a scenario's name, never null) get models of their own, all on the same half of the
    player's games."""
    keys = list(keys)
    split = materialise(half_split(materialise(labelled), seed, order))
    able = split.groupBy(*keys).agg(
        *[F.count_if((F.col("is_train") == t) & (F.col("altered") == a)).alias(f"_{int(t)}{int(a)}") for t in (True, False) for a in (True, False)]
    ).where("_11 > 0 AND _10 > 0 AND _01 > 0 AND _00 > 0")
    usable = split.join(able.select(*keys), keys, "left_semi")
    coefs = materialise(logistic.fit_logistic(usable.where("is_train"), keys, columns, "altered"))
    judged = logistic.probability(usable.where("NOT is_train"), coefs, keys, columns, "_p")
    trained = auc(judged, keys, "altered", "_p", "trained_auc")
    plain = auc(judged, keys, "altered", naive, "naive_auc")
    weights = coefs.select(*keys, *[F.col("coef")[i + 1].alias(f"weight_{c}") for i, c in enumerate(columns)], "moved")
    return trained.join(plain, keys).join(weights, keys)


def detector_folds(labelled: DataFrame, min_rows: int = 24, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Stratified folds per player: 5 from 50 rows, 4 from 32, else 3; too small players go."""
    labelled = materialise(labelled)
    sizes = labelled.groupBy("player").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_rows)
    k = F.when(F.col("_size") >= 50, 5).when(F.col("_size") >= 32, 4).otherwise(3)
    hashed = xx("game_id", seed=seed) if order is None else order
    ranked = hash_rank(labelled, ["player", "altered"], hashed, ["game_id"], "_rank")
    return (
        ranked.join(sizes, "player")
        .withColumn("fold", F.pmod(F.col("_rank") - 1, k).cast("int"))
        .drop("_rank", "_size")
    )


def balanced(labelled: DataFrame) -> DataFrame:
    """Weight both labels of a player equally."""
    counts = labelled.groupBy("player").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("altered")).alias("_a"))
    own = F.when(F.col("altered"), F.col("_a")).otherwise(F.col("_n") - F.col("_a"))
    return labelled.join(counts, "player").withColumn("weight", F.col("_n") / (2.0 * own)).drop("_n", "_a")


def detector(labelled: DataFrame, features: dict[str, Sequence[str]]) -> DataFrame:
    """Cross-validated AUC per player for each named feature set; expects ``fold``."""
    weighted = materialise(balanced(labelled))
    out = None
    for name, columns in features.items():
        held = logistic.out_of_fold(weighted, ["player"], columns, "altered", 5, "weight")
        one = auc(held, ["player"], "altered", "p", f"auc_{name}")
        out = one if out is None else out.join(one, "player")
    return out


def combination(labelled: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """AUC of two feature sets alone, joined raw, and stacked on their held-out probabilities."""
    fit = lambda frame, columns, name: materialise(logistic.out_of_fold(frame, ["player"], columns, "altered", 5, "weight", name))
    a = fit(materialise(balanced(labelled)), first, "p_agreement")
    both = fit(a, second, "p_biometric")
    raw = fit(both, [*first, *second], "p_combined_raw")
    stacked = logistic.out_of_fold(raw, ["player"], ["p_agreement", "p_biometric"], "altered", 5, None, "p_combined_stacked")
    names = ["p_agreement", "p_biometric", "p_combined_raw", "p_combined_stacked"]
    long = stacked.select("player", "altered", *names).unpivot(["player", "altered"], names, "model", "p")
    return auc(long, ["player", "model"], "altered", "p")


# --- best moves against alternate moves -------------------------------------------------


def attack_features(plies: DataFrame, policy: DataFrame, top_k: int = 1, min_plies: int = 10, draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """Detector features of every game left ``clean`` and with its ``top_k`` closest decisions altered in two ways.

    ``best_move`` plays the engine's move there, ``alternate_move`` a lesser candidate; both hide their time by the
    same draws, so the three versions of a ply are made in one pass and only their times and surprises fan out."""
    judged = long_games(plies, min_plies, top_k).withColumns({"_time": F.col("think_time"), "_surprise": F.col("maia_surprise")})
    moved = alternate_moves(judged, policy, top_k, draw, seed)
    chance = F.col("maia_prob_best_move")
    best = F.when(F.col("is_injected"), F.when(chance.isNotNull(), -F.ln(F.greatest(chance, F.lit(LEAST_PROBABILITY))))).otherwise(F.col("_surprise"))
    version = lambda name, time, surprise: F.struct(F.lit(name).alias("attack"), F.col(time).alias("think_time"), surprise.alias("maia_surprise"))
    versions = F.array(version("clean", "_time", F.col("_surprise")), version("best_move", "think_time", best), version("alternate_move", "think_time", F.col("maia_surprise")))
    fanned = moved.select(*GAME, "pred_log_think_time", F.explode(versions).alias("_v")).select(*GAME, "pred_log_think_time", "_v.*")
    return game_features(fanned, (*GAME, "attack"))


def against_attacks(features: DataFrame) -> DataFrame:
    """Each attack's games beside the clean ones, labelled ``altered``."""
    clean = F.col("attack") == "clean"
    both = F.array(*[F.lit(a) for a in ATTACKS])
    return features.withColumns({"altered": ~clean, "_a": F.explode(F.when(clean, both).otherwise(F.array("attack")))}).withColumn("attack", F.col("_a")).drop("_a")


def attack_detectors(features: DataFrame, columns: Sequence[str] = SELECTIVE_FEATURES, min_rows: int = 24, seed: int = 0) -> DataFrame:
    """Cross-validated AUC per player against best moves and against alternate moves, on the same games and folds."""
    labelled = materialise(against_attacks(features))
    out = labelled.where((F.col("attack") == ATTACKS[0]) & F.col("altered")).groupBy("player").agg(F.count(F.lit(1)).alias("n_games"))
    for attack in ATTACKS:
        folds = detector_folds(labelled.where(F.col("attack") == attack).drop("attack"), min_rows, seed)
        out = out.join(detector(folds, {attack: columns}), "player")
    return out


# --- evidence over several games --------------------------------------------------------


def curve_scores(plies: DataFrame, min_games: int = CURVE_GAMES, draw: Draw | None = None, seed: int = 0) -> DataFrame:
    """(curve, player, game_id, altered, score) for multi-game curves, both curves from one fan-out.

    ``flat`` alters every ply and scores the mean, ``selective`` alters the closest decision and scores the most
    suspicious time, on games with a known gap.  Players with fewer than ``min_games`` judged games have no curve."""
    timing, plain = -residual(), -F.col("maia_surprise")
    scored = materialise(
        perturb_scenarios(long_games(plies), [one for one, _ in CURVES.values()], draw, seed).groupBy(*GAME, *SCENARIO)
        .agg((F.avg(timing) + F.avg(plain)).alias("combined"), F.max(timing).alias("timing_max"), F.count("gap_1_2").alias("_gaps"))
    )
    row = {curve: F.struct(F.lit(curve).alias("curve"), F.col(value).alias("score")) for curve, (_, value) in CURVES.items()}
    clean = F.col("mode") == "clean"
    own = F.when(clean, F.array(*row.values())).when(F.col("rate").isNotNull(), F.array(row["flat"])).otherwise(F.array(row["selective"]))
    rows = scored.select(*GAME, (~clean).alias("altered"), "_gaps", F.explode(own).alias("_r")).select(*GAME, "altered", "_gaps", "_r.*")
    rows = rows.where("score IS NOT NULL AND (curve = 'flat' OR _gaps >= 1)").drop("_gaps")
    able = rows.where("curve = 'flat' AND NOT altered").groupBy("player").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_games)
    return rows.join(able.select("player"), "player", "left_semi")


def multi_game_curves(scores: DataFrame, sizes: Sequence[int] = BOOTSTRAP_SIZES, b: int = BOOTSTRAP_RESAMPLES, **options) -> DataFrame:
    """Per curve and number of games: median, quartiles and extremes over players of the resampled AUC."""
    return summary(bootstrap_auc(scores, sizes, b, keys=("curve", "player"), **options), ["curve", "n_games"])


def bootstrap_evidence(scores: DataFrame, sizes: Sequence[int] = BOOTSTRAP_SIZES, b: int = BOOTSTRAP_RESAMPLES, listed: int = 10_000, pick: Callable | None = None, keys: Sequence[str] = ("player",), seed: int = 0) -> DataFrame:
    """Mean score of N resampled games, ``b`` times per player, label and N.

    ``scores`` has ``game_id``, ``altered`` and ``score``; all games of a player and
    label are drawn from.  Up to ``listed`` games are indexed as a list inside the
    task; the draws of larger players are joined with numbered games instead.
    """
    pick = pick or (lambda resample, draw, n, altered: xx(*keys, resample, draw, n, altered, seed=seed))
    by = [*keys, "altered"]
    label = F.col("altered").cast("int")
    counts = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_games"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    sized = scores.select(*by, "game_id", "score").join(counts.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_games"), same).select(*by, "game_id", "score", "_games")
    resamples = F.explode(F.array([F.lit(n) for n in sizes]))

    def drawn(resample: Column, j: Column) -> Column:
        return (F.floor(pick(resample, j, F.col("n_games"), label) * F.col("_games") / F.lit(float(SPAN))) + 1).cast("int")

    def mean_of(resample: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.col("n_games")), F.lit(0.0), lambda s, j: s + F.element_at("_scores", drawn(resample, j)))
        return total / F.col("n_games")

    lists = sized.where(F.col("_games") <= listed).groupBy(*by, "_games").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("game_id", "score"))), lambda r: r["score"]).alias("_scores")
    )
    small = (
        lists.withColumn("n_games", resamples).where(F.col("_games") >= F.col("n_games"))
        .select(*by, "n_games", F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), mean_of)).alias("evidence"))
    )
    large = counts.where(F.col("_games") > listed)
    if large.isEmpty():
        return small
    numbered = ordered(sized.where(F.col("_games") > listed).drop("_games"), by, ["game_id"], number="_at")
    asked = (
        large.withColumn("n_games", resamples).where(F.col("_games") >= F.col("n_games"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("n_games"))))
        .withColumn("_at", drawn(F.col("_b"), F.col("_j")))
    )
    found = asked.join(numbered, [*by, "_at"])
    return small.union(found.groupBy(*by, "n_games", "_b").agg((F.sum("score") / F.col("n_games")).alias("evidence")).select(*by, "n_games", "evidence"))


def bootstrap_auc(scores: DataFrame, sizes: Sequence[int] = BOOTSTRAP_SIZES, b: int = BOOTSTRAP_RESAMPLES, keys: Sequence[str] = ("player",), **options) -> DataFrame:
    """AUC per player after aggregating N games, over bootstrap resamples."""
    evidence = bootstrap_evidence(scores, sizes, b, keys=keys, **options)
    return auc(evidence, [*keys, "n_games"], "altered", "evidence").where(F.col("auc").isNotNull())


def summary(aucs: DataFrame, keys: Sequence[str], value: str = "auc") -> DataFrame:
    """Median, quartiles, extremes and count over players, per scenario."""
    known = aucs.where(F.col(value).isNotNull())
    spans = known.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    marks = quantiles(known, keys, value, (0.25, 0.5, 0.75), "_q")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    renamed = marks.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = spans.join(renamed, same) if keys else join_per_key(spans, marks, [])
    return joined.select(*spans.columns, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"))


def strength(aucs: DataFrame, value: str = "auc") -> DataFrame:
    """Separation in whichever direction works: max(auc, 1 - auc), with its band."""
    s = F.greatest(F.col(value), 1 - F.col(value))
    return aucs.withColumn("strength", s).withColumn(
        "band", F.when(F.col("strength") >= STRONG, "strong").when(F.col("strength") < WEAK, "weak").otherwise("moderate")
    )


def strength_counts(strengths: DataFrame) -> DataFrame:
    return strengths.where(F.col("strength").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n_players"))


def wins(aucs: DataFrame, first: str, second: str) -> DataFrame:
    """How many players the first detector serves better."""
    return aucs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(first) > F.col(second)).alias("wins"),
        F.avg(first).alias("mean_first"), F.avg(second).alias("mean_second"),
    )


def roster(plies: DataFrame, n_games: int | None = None, seed: int = 0) -> DataFrame:
    """AUC of every score in every flat and selective scenario, all players in one job.

    ``plies`` are clean held-out plies with ``pred_log_think_time``.
    """
    judged = long_games(held_out_games(plies, n_games, seed))
    flat = scenario_list(ks=())
    few = scenario_list(rates=(), ks=CRITICAL_KS)
    by_mean = score_scenarios(judged, flat, "mean", seed=seed)
    by_max = score_scenarios(long_games(judged, 10, max(CRITICAL_KS)), few, "max", seed=seed)
    a = separation(by_mean, flat, MEAN_SCORES)
    b = separation(by_max, few, MAX_SCORES)
    return a.unionByName(b)


# --- move sequences ------------------------------------------------------------------


def win_chance(cp: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + F.exp(-WIN_CHANCE_SLOPE * cp)), F.lit(0.5))


def sequence_rows(plies: DataFrame, keys: Sequence[str] = GAME, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Ten move features for the first ``length`` own moves of every game.

    The length is the shape of the sequence model's input, not a sample.
    """
    in_game = Window.partitionBy(*keys).orderBy("ply")
    game = Window.partitionBy(*keys)
    cps, moves = F.col("top_cps"), F.col("top_moves")
    n = F.coalesce(F.greatest(F.size(cps), F.lit(0)), F.lit(0))
    found = F.array_position(moves, F.col("move_uci"))
    rank = F.when(found > 0, found.cast("int"))
    emt = F.coalesce(F.col("think_time"), F.lit(0.0))
    best = F.when(n > 0, win_chance(F.try_element_at(cps, F.lit(1)))).otherwise(0.5)
    at = lambda i: win_chance(F.try_element_at(cps, i))
    projected = F.when(n <= 1, 10).otherwise(F.least(F.lit(15), n + 2))
    head = plies.withColumns({"_i": F.row_number().over(in_game) - 1, "_n": n, "_rank": rank, "_emt": emt, "_best": best, "_adv": win_chance(F.col("eval_after"))})
    head = head.where(F.col("_i") < length)
    loss = F.greatest(F.lit(0.0), F.col("_best") - F.col("_adv"))
    head = head.withColumns({"_emt_avg": F.avg("_emt").over(game), "_wcl": loss}).withColumn("_wcl_avg", F.avg("_wcl").over(game))
    r, nn, adv = F.col("_rank"), F.col("_n"), F.col("_adv")
    spread = F.transform(cps, lambda c: F.col("_best") - win_chance(c))
    return head.withColumns(
        {
            "seq": F.col("_i"),
            "rank": F.least(F.lit(15), F.coalesce(r - 1, projected), F.when(nn > 0, nn).otherwise(15)) + 1,
            "ambiguity": F.coalesce(F.greatest(F.size(F.filter(spread, lambda d: F.abs(d) < 0.05)), F.lit(0)), F.lit(0)) + 1,
            "advantage": adv,
            "emt_norm": F.col("_emt") / (F.col("_emt_avg") + 1e-8),
            "emt_var": F.abs(F.col("_emt") - F.col("_emt_avg")) / (F.col("_emt_avg") + 1e-8),
            "to_next_best": F.when(r == 1, 0.0).when(r > 1, at(r - 1) - adv).when(nn > 0, at(nn) - adv).otherwise(0.0),
            "to_next_worst": F.when(r <= nn - 1, at(r + 1) - adv).otherwise(0.0),
            "win_loss": F.col("_wcl"),
            "win_loss_dev": F.col("_wcl") - F.col("_wcl_avg"),
            "win_loss_avg": F.when(nn > 0, F.aggregate(spread, F.lit(0.0), lambda a, b: a + b) / nn).otherwise(0.0),
        }
    ).drop("_i", "_n", "_rank", "_emt", "_best", "_adv", "_emt_avg", "_wcl", "_wcl_avg")


SEQUENCE_FEATURES = (
    "rank", "ambiguity", "advantage", "emt_norm", "emt_var", "to_next_best", "to_next_worst",
    "win_loss", "win_loss_dev", "win_loss_avg",
)


def board_columns(plies: DataFrame) -> DataFrame:
    """Advancement of the move and the piece standing on its target before it."""
    from pacelens.operators.board import piece_on

    rank = F.substring("move_uci", 4, 1).try_cast("int") - 1
    white_first = F.min_by(F.col("ply") % 2 == 0, "ply").over(Window.partitionBy(*GAME))
    target = F.substring("move_uci", 3, 2)
    kind = F.lower(piece_on(F.col("fen_before"), target))
    code = F.lit(0)
    for i, letter in enumerate("pnbrqk"):
        code = F.when(kind == letter, F.lit(i + 1)).otherwise(code)
    return plies.withColumns(
        {"advancement": F.when(white_first, rank).otherwise(7 - rank), "target_piece": code}
    )


def sequences(rows: DataFrame, features: Sequence[str] = SEQUENCE_FEATURES, keys: Sequence[str] = GAME, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One padded matrix per game: ``length`` arrays of the features, zeros at the end."""
    entry = F.struct("seq", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"), F.count(F.lit(1)).alias("true_length"))
    zero = F.array_repeat(F.lit(0.0), len(features))
    padding = F.array_repeat(zero, (F.lit(length) - F.col("true_length")).cast("int"))
    return listed.select(*keys, "true_length", F.concat(F.col("_m.x"), padding).alias("matrix"))
