"""Per-game vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.operators import games
from pacelens.plans.catalog import query
from pacelens.sources.standins import PLIES_SQL

P = f"WITH {PLIES_SQL}"
CLEAN = f"""{P}, clean AS (
  SELECT * FROM plies WHERE NOT is_suspect AND think_time IS NOT NULL AND cp_loss IS NOT NULL
    AND maia_surprise IS NOT NULL AND maia_prob_played IS NOT NULL AND n_captures_available IS NOT NULL
    AND low_time IS NOT NULL AND is_sacrifice IS NOT NULL AND own_skewers IS NOT NULL AND opp_skewers IS NOT NULL),
placed AS (SELECT *, row_number() OVER g - 1 AS pos, count(*) OVER (PARTITION BY player, game_id) AS len,
    lag(think_time) OVER g AS prev_think, coalesce(lag(is_mistake) OVER g, false) AS after_mistake
  FROM clean WINDOW g AS (PARTITION BY player, game_id ORDER BY ply))"""


def corr_sql(x: str, y: str) -> str:
    fx, fy = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {c} END" for c in (x, y))
    return f"covar_pop({fx}, {fy}) / nullif(stddev_pop({fx}) * stddev_pop({fy}), 0)"


FIRST = "pos / greatest(len - 1, 1) < 0.5"


def trend_sql(c: str) -> str:
    return (
        f"coalesce(avg({c}) FILTER (WHERE NOT ({FIRST})) - avg({c}) FILTER (WHERE {FIRST}), 0.0) AS {c}_trend"
    )


@query(
    "game_timing_vector", "G1 G3",
    "player:l game_id:l think_time_mean:d think_time_std:d cp_loss_mean:d cp_loss_std:d think_time_trend:d cp_loss_trend:d",
    f"""{P}, placed AS (SELECT *, row_number() OVER (PARTITION BY player, game_id ORDER BY ply) - 1 AS pos,
      count(*) OVER (PARTITION BY player, game_id) AS len FROM plies)
    SELECT player, game_id, avg(think_time) AS think_time_mean, coalesce(stddev_samp(think_time), 0) AS think_time_std,
      avg(cp_loss) AS cp_loss_mean, coalesce(stddev_samp(cp_loss), 0) AS cp_loss_std,
      {trend_sql("think_time")}, {trend_sql("cp_loss")}
    FROM placed GROUP BY player, game_id""",
)
def game_timing_vector(t):
    measures = ("think_time", "cp_loss")
    return games.positioned(t.plies()).groupBy(*games.GAME).agg(*games.spread(measures), *games.trends(measures))


@query(
    "game_spread", "G1", "player:l game_id:l " + " ".join(f"{c}_{s}:d" for c in games.CONTINUOUS for s in ("mean", "std")),
    f"{P} SELECT player, game_id, "
    + ", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}), 0) AS {c}_std" for c in games.CONTINUOUS)
    + " FROM plies GROUP BY player, game_id",
)
def game_spread(t):
    return t.plies().groupBy(*games.GAME).agg(*games.spread())


@query(
    "game_rates", "G2", "player:l game_id:l low_time:d is_sacrifice:d own_skewers:d opp_skewers:d",
    f"{P} SELECT player, game_id, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in games.RATES)
    + " FROM plies GROUP BY player, game_id",
)
def game_rates(t):
    return t.plies().groupBy(*games.GAME).agg(*games.rates())


@query(
    "game_trend", "G3", "player:l game_id:l " + " ".join(f"{c}_trend:d" for c in games.CONTINUOUS),
    f"{CLEAN} SELECT player, game_id, " + ", ".join(trend_sql(c) for c in games.CONTINUOUS) + " FROM placed GROUP BY player, game_id",
)
def game_trend(t):
    return games.positioned(games.clean_plies(t.plies())).groupBy(*games.GAME).agg(*games.trends())


@query(
    "game_phase_shares", "G4", "player:l game_id:l opening_time_share:d middlegame_time_share:d endgame_time_share:d",
    f"""{P} SELECT player, game_id,
      coalesce(sum(think_time) FILTER (WHERE game_phase = 'opening'), 0) / greatest(sum(think_time), 1e-9) AS opening_time_share,
      coalesce(sum(think_time) FILTER (WHERE game_phase = 'middlegame'), 0) / greatest(sum(think_time), 1e-9) AS middlegame_time_share,
      coalesce(sum(think_time) FILTER (WHERE game_phase = 'endgame'), 0) / greatest(sum(think_time), 1e-9) AS endgame_time_share
    FROM plies GROUP BY player, game_id""",
)
def game_phase_shares(t):
    return t.plies().groupBy(*games.GAME).agg(*games.phase_shares())


def with_session(t):
    """Stand-in session columns, constant in a game; NULL gap for every seventh game."""
    return t.plies().withColumns(
        {
            "session_game_index": (F.col("game_id") % 11).cast("double"),
            "minutes_since_prev_game": F.when(F.col("game_id") % 7 != 0, (F.col("game_id") % 90).cast("double")),
        }
    )


SESSION_SQL = """CAST(game_id % 11 AS DOUBLE) AS session_game_index,
  CASE WHEN game_id % 7 <> 0 THEN CAST(game_id % 90 AS DOUBLE) END AS minutes_since_prev_game"""


@query(
    "game_pacing", "G5", "player:l game_id:l session_game_index:d log_minutes_since_prev_game:d",
    f"""{P}, s AS (SELECT player, game_id, {SESSION_SQL} FROM plies)
    SELECT player, game_id, min(session_game_index) AS session_game_index,
      ln(1 + coalesce(min(minutes_since_prev_game), 1440)) AS log_minutes_since_prev_game FROM s GROUP BY player, game_id""",
)
def game_pacing(t):
    return with_session(t).groupBy(*games.GAME).agg(*games.pacing())


LOW_RATIO_SQL = """coalesce(avg(think_time) FILTER (WHERE low_time)
  / nullif(avg(think_time) FILTER (WHERE NOT low_time), 0), 1.0) AS low_time_think_ratio"""


@query(
    "game_low_time_ratio", "G6", "player:l game_id:l low_time_think_ratio:d",
    f"{P} SELECT player, game_id, {LOW_RATIO_SQL} FROM plies GROUP BY player, game_id",
)
def game_low_time_ratio(t):
    return t.plies().groupBy(*games.GAME).agg(games.low_time_ratio())


RHYTHM_SQL = f"coalesce(CASE WHEN count(*) >= 3 THEN {corr_sql('think_time', 'prev_think')} END, 0) AS rhythm_autocorr"
TEMPO_SQL = f"coalesce(CASE WHEN count(*) >= 3 THEN {corr_sql('think_time', 'opp_think_time_prev')} END, 0) AS tempo_match_corr"
POST_SQL = "coalesce(avg(think_time) FILTER (WHERE after_mistake) - avg(think_time), 0) AS post_mistake_think_delta"


@query(
    "game_rhythm", "G7", "player:l game_id:l rhythm_autocorr:d",
    f"{CLEAN} SELECT player, game_id, {RHYTHM_SQL} FROM placed GROUP BY player, game_id",
)
def game_rhythm(t):
    return games.positioned(games.clean_plies(t.plies())).groupBy(*games.GAME).agg(games.rhythm())


@query(
    "game_tempo_match", "G8", "player:l game_id:l tempo_match_corr:d",
    f"{CLEAN} SELECT player, game_id, {TEMPO_SQL} FROM placed GROUP BY player, game_id",
)
def game_tempo_match(t):
    return games.clean_plies(t.plies()).groupBy(*games.GAME).agg(games.tempo_match())


@query(
    "game_post_mistake", "G9", "player:l game_id:l post_mistake_think_delta:d",
    f"{CLEAN} SELECT player, game_id, {POST_SQL} FROM placed GROUP BY player, game_id",
)
def game_post_mistake(t):
    return games.positioned(games.clean_plies(t.plies())).groupBy(*games.GAME).agg(games.post_mistake())


CLOCK_SQL = """sin(2 * pi() * ((hour(dt) + minute(dt) / 60.0) / 24.0)) AS hour_sin,
  cos(2 * pi() * ((hour(dt) + minute(dt) / 60.0) / 24.0)) AS hour_cos,
  sin(2 * pi() * ((isodow(dt) - 1) / 7.0)) AS dow_sin, cos(2 * pi() * ((isodow(dt) - 1) / 7.0)) AS dow_cos"""


@query(
    "game_start_clock", "G10", "player:l game_id:l hour_sin:d hour_cos:d dow_sin:d dow_cos:d",
    f"""{P}, g AS (SELECT player, game_id, min(game_datetime) AS dt FROM plies GROUP BY player, game_id)
    SELECT player, game_id, {CLOCK_SQL} FROM g""",
)
def game_start_clock(t):
    started = t.plies().groupBy(*games.GAME).agg(F.min("game_datetime").alias("dt"))
    return started.select(*games.GAME, *games.start_clock(F.col("dt")))


RESULT_SQL = """CASE WHEN (result = '1-0') = (color = 'white') AND result <> '1/2-1/2' THEN 1
  WHEN result <> '1/2-1/2' THEN -1 ELSE 0 END"""


@query(
    "previous_game_result", "G11", "player:l game_id:l prev_game_result:d",
    f"""{P}, g AS (SELECT player, game_id, min(game_datetime) AS dt, min(result) AS result, min(color) AS color
      FROM plies GROUP BY player, game_id)
    SELECT player, game_id, coalesce(lag({RESULT_SQL}) OVER (PARTITION BY player ORDER BY dt, game_id), 0) AS prev_game_result FROM g""",
)
def previous_game_result(t):
    one = t.plies().groupBy(*games.GAME).agg(
        F.min("game_datetime").alias("game_datetime"), F.min("result").alias("result"), F.min("color").alias("color")
    )
    return games.previous_results(one)


VECTOR_MIN = 4  # the stand-in's games are short
VECTOR_SQL = f"""{CLEAN}, sess AS (SELECT *, {SESSION_SQL} FROM placed),
wide AS (SELECT player, game_id, count(*) AS n_plies, min(game_datetime) AS dt, min(result) AS result, min(color) AS color,
  {", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}), 0) AS {c}_std" for c in games.CONTINUOUS)},
  {", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in games.RATES)},
  {", ".join(trend_sql(c) for c in games.CONTINUOUS)},
  {", ".join(f"coalesce(sum(think_time) FILTER (WHERE game_phase = '{p}'), 0) / greatest(sum(think_time), 1e-9) AS {p}_time_share" for p in games.PHASES)},
  min(session_game_index) AS session_game_index, ln(1 + coalesce(min(minutes_since_prev_game), 1440)) AS log_minutes_since_prev_game,
  {LOW_RATIO_SQL}, {RHYTHM_SQL}, {TEMPO_SQL}, {POST_SQL},
  coalesce({corr_sql("ln(1 + greatest(gap_1_2, 0))", "cp_loss")}, 0) AS raw_complexity,
  count(*) AS len, min(base_s) AS base_s, min(increment_s) AS increment_s
  FROM sess GROUP BY player, game_id),
told AS (SELECT *, {CLOCK_SQL}, coalesce(lag({RESULT_SQL}) OVER (PARTITION BY player ORDER BY dt, game_id), 0) AS prev_game_result,
  CASE WHEN n_plies >= 3 THEN raw_complexity ELSE 0 END AS complexity_accuracy_corr FROM wide)
SELECT * FROM told WHERE n_plies >= {VECTOR_MIN}"""


def kinds(mode, extra=()):
    return "player:l game_id:l n_plies:l " + " ".join(f"{c}:d" for c in games.vector_columns(mode, extra))


def clean_sessions(t):
    return games.clean_plies(with_session(t))


@query("game_vectors_full", "G12 G13", kinds("full"), VECTOR_SQL)
def game_vectors_full(t):
    return games.vectors(clean_sessions(t), "full", min_plies=VECTOR_MIN)


@query("game_vectors_timing", "G12 G13", kinds("biometric"), VECTOR_SQL)
def game_vectors_timing(t):
    return games.vectors(clean_sessions(t), "biometric", min_plies=VECTOR_MIN)


EXTRA = ("complexity_accuracy_corr", "base_s", "increment_s")


@query("game_vectors_candidates", "G14", kinds("biometric", EXTRA), VECTOR_SQL)
def game_vectors_candidates(t):
    return games.vectors(clean_sessions(t), "biometric", VECTOR_MIN, complexity=True, time_control=True)


@query(
    "recent_games_per_player", "G14", "player:l game_id:l",
    """SELECT player, game_id FROM (SELECT o_custkey AS player, o_orderkey AS game_id,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5""",
)
def recent_games_per_player(t):
    one = t.orders.select(
        F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("game_datetime")
    )
    return games.recent_games(one, 5)
