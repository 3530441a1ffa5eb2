"""Per-game behavioural vectors: one row per (player, game) from its clean plies.

Everything a vector needs from one game is computed in a single shuffle on the
game: a windowed frame (position, previous row) feeds one wide ``groupBy``.
Only the previous game's result looks across games; it runs on the game table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.nulls import flag, ratio, truthy
from pacelens.functions.ordered import ordered
from pacelens.functions.stats import guarded_corr, mean_where

GAME = ("player", "game_id")

# The measures every vector is built from.
CONTINUOUS = ("think_time", "cp_loss", "maia_surprise", "maia_prob_played", "n_captures_available")
RATES = ("low_time", "is_sacrifice", "own_skewers", "opp_skewers")
PHASES = ("opening", "middlegame", "endgame")

# Vector columns that describe what was played, not how long it took.
MOVE_CONTENT = (
    "cp_loss_mean", "cp_loss_std", "cp_loss_trend",
    "maia_surprise_mean", "maia_surprise_std", "maia_surprise_trend",
    "maia_prob_played_mean", "maia_prob_played_std", "maia_prob_played_trend",
    "is_sacrifice", "own_skewers", "opp_skewers",
    "n_captures_available_mean", "n_captures_available_std", "n_captures_available_trend",
)

MIN_PLIES = 15
FRESH_SESSION_GAP_MINUTES = 1440.0


def clean_plies(plies: DataFrame, needed: Sequence[str] = (*CONTINUOUS, *RATES)) -> DataFrame:
    """Plies usable for a vector: not suspect, think time and every measure present."""
    return plies.where(~F.col("is_suspect")).na.drop(subset=["think_time", *needed])


def positioned(plies: DataFrame, keys: Sequence[str] = GAME) -> DataFrame:
    """Add position in game, game length and the previous row's values.

    A game is one source record, so its rows are few; the window is on the game.
    """
    in_game = Window.partitionBy(*keys).orderBy("ply")
    whole = Window.partitionBy(*keys)
    return plies.withColumns(
        {
            "_at": F.row_number().over(in_game) - 1,
            "_length": F.count(F.lit(1)).over(whole),
            "_prev_think": F.lag("think_time").over(in_game),
            "_after_mistake": truthy(F.lag("is_mistake").over(in_game)),
        }
    )


def spread(columns: Sequence[str] = CONTINUOUS) -> list[Column]:
    """Mean and sample standard deviation; one row has no spread, which reads as 0."""
    out = []
    for c in columns:
        out.append(F.avg(c).alias(f"{c}_mean"))
        out.append(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))
    return out


def rates(columns: Sequence[str] = RATES) -> list[Column]:
    return [F.avg(flag(c)).alias(c) for c in columns]


def trends(columns: Sequence[str] = CONTINUOUS) -> list[Column]:
    """Second-half mean minus first-half mean."""
    first = F.col("_at") / F.greatest(F.col("_length") - 1, F.lit(1)) < 0.5
    return [
        F.coalesce(mean_where(~first, F.col(c)) - mean_where(first, F.col(c)), F.lit(0.0)).alias(f"{c}_trend")
        for c in columns
    ]


def phase_shares() -> list[Column]:
    """Share of the thinking time spent in each phase."""
    spent = {p: F.sum(F.when(F.col("game_phase") == p, F.col("think_time")).otherwise(0.0)) for p in PHASES}
    total = F.greatest(spent[PHASES[0]] + spent[PHASES[1]] + spent[PHASES[2]], F.lit(1e-9))
    return [(spent[p] / total).alias(f"{p}_time_share") for p in PHASES]


def pacing() -> list[Column]:
    """Session position and log gap; a fresh session counts as a day's gap."""
    gap = F.coalesce(F.min_by("minutes_since_prev_game", "ply"), F.lit(FRESH_SESSION_GAP_MINUTES))
    return [
        F.min_by("session_game_index", "ply").alias("session_game_index"),
        F.log1p(gap).alias("log_minutes_since_prev_game"),
    ]


def low_time_ratio() -> Column:
    """Mean think time short of time over mean think time otherwise; 1 when unseen."""
    low = mean_where(F.col("low_time"), F.col("think_time"))
    normal = mean_where(~F.col("low_time"), F.col("think_time"))
    return F.coalesce(ratio(low, normal), F.lit(1.0)).alias("low_time_think_ratio")


def _guarded_by_length(value: Column) -> Column:
    return F.coalesce(F.when(F.count(F.lit(1)) >= 3, value), F.lit(0.0))


def rhythm() -> Column:
    """Lag-1 autocorrelation of think time."""
    return _guarded_by_length(guarded_corr(F.col("think_time"), F.col("_prev_think"))).alias("rhythm_autocorr")


def tempo_match() -> Column:
    """Correlation of think time with the opponent's previous think time."""
    value = guarded_corr(F.col("think_time"), F.col("opp_think_time_prev"))
    return _guarded_by_length(value).alias("tempo_match_corr")


def post_mistake() -> Column:
    """Mean think time right after an own mistake minus the game's mean."""
    after = mean_where(F.col("_after_mistake"), F.col("think_time"))
    return F.coalesce(after - F.avg("think_time"), F.lit(0.0)).alias("post_mistake_think_delta")


def start_clock(datetime: Column) -> list[Column]:
    """Hour of day and day of week on the circle."""
    turn = F.lit(6.283185307179586)
    hour = (F.hour(datetime) + F.minute(datetime) / 60.0) / 24.0
    day = F.weekday(datetime) / 7.0
    return [
        F.sin(turn * hour).alias("hour_sin"),
        F.cos(turn * hour).alias("hour_cos"),
        F.sin(turn * day).alias("dow_sin"),
        F.cos(turn * day).alias("dow_cos"),
    ]


def player_result(result: Column, color: Column) -> Column:
    """1 for a win, -1 for a loss, 0 otherwise, from the player's side."""
    white = color == "white"
    won = ((result == "1-0") & white) | ((result == "0-1") & ~white)
    lost = ((result == "1-0") & ~white) | ((result == "0-1") & white)
    return F.when(won, 1).when(lost, -1).otherwise(0)


def with_previous_result(games: DataFrame) -> DataFrame:
    """Add the player's preceding game's ``_result``; 0 for the first game.

    The history of one player is cut into blocks, so a player with most of the
    games is still spread over the cluster.
    """
    lagged = ordered(games, ["player"], ["game_datetime", "game_id"], previous={"_previous": "_result"})
    return lagged.withColumn(
        "prev_game_result", F.coalesce(F.col("_previous"), F.lit(0)).cast("double")
    ).drop("_previous", "_result")


def previous_results(games: DataFrame) -> DataFrame:
    """Result of each game's predecessor, from a table with one row per game."""
    scored = games.select(
        *GAME, "game_datetime", player_result(F.col("result"), F.col("color")).alias("_result")
    )
    return with_previous_result(scored).select(*GAME, "prev_game_result")


def complexity_accuracy(min_rows: int = 3) -> Column:
    """Reverted candidate: correlation of log gap with loss, per game."""
    gap = F.log1p(F.greatest(F.col("gap_1_2"), F.lit(0.0)))
    value = F.when(F.count(F.lit(1)) >= min_rows, guarded_corr(gap, F.col("cp_loss")))
    return F.coalesce(value, F.lit(0.0)).alias("complexity_accuracy_corr")


def recent_games(games: DataFrame, n: int) -> DataFrame:
    """Reverted candidate: keep each player's latest ``n`` games.

    The rank filter is pushed below the shuffle, so each task forwards at most
    ``n`` games per player.
    """
    latest = Window.partitionBy("player").orderBy(F.desc("game_datetime"), F.desc("game_id"))
    return games.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")


def vector_columns(mode: str = "full", extra: Sequence[str] = ()) -> list[str]:
    """Names of the vector's features: 33 in full mode, 18 timing-only ones otherwise."""
    names = [f"{c}_{s}" for c in CONTINUOUS for s in ("mean", "std")]
    names += [*RATES]
    names += [f"{c}_trend" for c in CONTINUOUS]
    names += [f"{p}_time_share" for p in PHASES]
    names += [
        "session_game_index", "log_minutes_since_prev_game", "low_time_think_ratio",
        "rhythm_autocorr", "tempo_match_corr", "post_mistake_think_delta",
        "hour_sin", "hour_cos", "dow_sin", "dow_cos", "prev_game_result",
    ]
    if mode == "biometric":
        names = [c for c in names if c not in MOVE_CONTENT]
    elif mode != "full":
        raise ValueError(f"unknown feature mode {mode!r}")
    return [*names, *extra]


def vectors(
    plies: DataFrame,
    mode: str = "full",
    min_plies: int = MIN_PLIES,
    complexity: bool = False,
    time_control: bool = False,
) -> DataFrame:
    """Assemble the per-game vectors from clean plies.

    Expects the session columns; ``complexity`` and ``time_control`` switch the
    reverted candidates on.
    """
    wide = [*spread(), *rates(), *trends(), *phase_shares(), *pacing(), low_time_ratio(), rhythm(), tempo_match(), post_mistake()]
    extra = []
    if complexity:
        wide.append(complexity_accuracy())
        extra.append("complexity_accuracy_corr")
    if time_control:
        wide += [F.min_by("base_s", "ply").alias("base_s"), F.min_by("increment_s", "ply").alias("increment_s")]
        extra += ["base_s", "increment_s"]
    games = positioned(plies).groupBy(*GAME).agg(
        *wide,
        F.count(F.lit(1)).alias("n_plies"),
        F.min_by("game_datetime", "ply").alias("game_datetime"),
        F.min_by(player_result(F.col("result"), F.col("color")), "ply").alias("_result"),
    )
    timed = games.select("*", *start_clock(F.col("game_datetime")))
    return (
        with_previous_result(timed)
        .where(F.col("n_plies") >= min_plies)
        .select(*GAME, "game_datetime", "n_plies", *vector_columns(mode, extra))
    )
