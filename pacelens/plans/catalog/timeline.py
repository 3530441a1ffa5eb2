"""Clock, trajectory, session and target queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.operators import clocks, parse, sessions
from pacelens.plans.catalog import query
from pacelens.sources.standins import PLIES_SQL

P = f"WITH {PLIES_SQL}"
W = "WINDOW w AS (PARTITION BY player, game_id ORDER BY ply)"


@query(
    "clock_state", "C1",
    "player:l game_id:l ply:l clock_frac_remaining:d clock_diff:d behind_on_clock:b low_time:b game_progress:d",
    f"""{P} SELECT player, game_id, ply, clock_before / base_s AS clock_frac_remaining, clock_before - opp_clock AS clock_diff,
      clock_before < opp_clock AS behind_on_clock, clock_before < 0.15 * base_s AS low_time,
      ply / count(*) OVER (PARTITION BY player, game_id) AS game_progress FROM plies""",
)
def clock_state(t):
    return clocks.clock_state(parse.move_index(t.plies().drop("low_time")))


@query(
    "eval_trajectory", "C2 C3", "player:l game_id:l ply:l eval_delta_1:d eval_roll_std_3:d recently_volatile:b",
    f"""{P} SELECT player, game_id, ply, eval_before - lag(eval_before) OVER w AS eval_delta_1,
      stddev_samp(eval_before) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS eval_roll_std_3,
      coalesce(stddev_samp(eval_before) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 100, false) AS recently_volatile
    FROM plies {W}""",
)
def eval_trajectory(t):
    return clocks.trajectory(t.plies())


LOSS = """SELECT player, game_id, ply, eval_after, cp_loss, coalesce(cp_loss > 50, false) AS is_inaccuracy,
  coalesce(cp_loss > 100, false) AS is_mistake, coalesce(cp_loss > 300, false) AS is_blunder FROM l"""
LOSS_COLUMNS = "player:l game_id:l ply:l eval_after:d cp_loss:d is_inaccuracy:b is_mistake:b is_blunder:b"


@query(
    "move_loss_reference", "C4", LOSS_COLUMNS,
    f"""{P}, n AS (SELECT *, lead(eval_before) OVER w AS nx FROM plies {W}),
    l AS (SELECT player, game_id, ply, -nx AS eval_after,
      CASE WHEN nx IS NOT NULL THEN greatest(eval_before + nx, 0) END AS cp_loss FROM n) {LOSS}""",
)
def move_loss_reference(t):
    return clocks.cp_loss(t.plies())


@query(
    "move_loss_mover", "C4", LOSS_COLUMNS,
    f"""{P}, n AS (SELECT *, lead(eval_before) OVER w AS nx FROM plies {W}),
    l AS (SELECT player, game_id, ply, nx AS eval_after,
      CASE WHEN nx IS NOT NULL THEN greatest(eval_before - nx, 0) END AS cp_loss FROM n) {LOSS}""",
)
def move_loss_mover(t):
    return clocks.cp_loss(t.plies(), mode="mover")


@query(
    "log_think_time", "C5", "player:l game_id:l ply:l log_think_time:d",
    f"{P} SELECT player, game_id, ply, ln(1 + greatest(think_time - 3, 0)) AS log_think_time FROM plies",
)
def log_think_time(t):
    return clocks.log_think_time(t.plies().withColumn("think_time", F.col("think_time") - 3))


@query(
    "game_dates", "X1", "event_id:l game_date:s game_datetime:s",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS game_date,
      CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS game_datetime FROM events""",
)
def game_dates(t):
    text = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "????.??.??").otherwise(F.date_format("ts", "yyyy.MM.dd")).alias("date"),
        F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "HH:mm:ss")).alias("utc_time"),
    )
    return sessions.with_dates(text).withColumn("game_datetime", F.date_format("game_datetime", "yyyy-MM-dd HH:mm:ss"))


def event_games(t):
    return t.events.select(
        F.col("user_id").alias("player"), F.col("event_id").alias("game_id"),
        F.col("ts").cast("date").alias("game_date"), F.col("ts").alias("game_datetime"),
    )


@query(
    "games_played_so_far", "X2", "player:l game_id:l games_played_so_far:l",
    """SELECT user_id AS player, event_id AS game_id,
      row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS games_played_so_far FROM events""",
)
def games_played_so_far(t):
    return sessions.games_played(event_games(t))


@query(
    "recency_weights", "X3", "player:l game_id:l days_since_first:l recency_weight:d",
    """SELECT user_id AS player, event_id AS game_id, CAST(ts AS DATE) - min(CAST(ts AS DATE)) OVER u AS days_since_first,
      pow(0.5, (max(CAST(ts AS DATE)) OVER u - CAST(ts AS DATE)) / 90.0) AS recency_weight
    FROM events WINDOW u AS (PARTITION BY user_id)""",
)
def recency_weights(t):
    return sessions.recency(event_games(t))


@query(
    "play_sessions", "X4", "player:l game_id:l session_id:l session_game_index:l minutes_since_prev_game:e",
    """WITH g AS (SELECT user_id AS player, event_id AS game_id, ts,
        (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 6e7 AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 360 THEN 1 ELSE 0 END) OVER (PARTITION BY player ORDER BY ts, game_id) AS session_id FROM g)
    SELECT player, game_id, session_id, row_number() OVER (PARTITION BY player, session_id ORDER BY ts, game_id) - 1 AS session_game_index,
      gap AS minutes_since_prev_game FROM s""",
)
def play_sessions(t):
    return sessions.sessions(event_games(t), gap_minutes=360)


@query(
    "session_cross_check", "X4", "player:l n_sessions:l n_windows:l longest:l longest_window:l",
    """WITH g AS (SELECT user_id AS player, event_id AS game_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 6e7 AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 360 THEN 1 ELSE 0 END) OVER (PARTITION BY player ORDER BY ts, game_id) AS sid FROM g),
    n AS (SELECT player, sid, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT player, count(*) AS n_sessions, count(*) AS n_windows, max(n) AS longest, max(n) AS longest_window FROM n GROUP BY player""",
)
def session_cross_check(t):
    games = event_games(t)
    own = sessions.sessions(games, gap_minutes=360).groupBy("player", "session_id").agg(F.count(F.lit(1)).alias("n"))
    counted = own.groupBy("player").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))
    windows = sessions.session_windows(games, 360).groupBy("player").agg(F.count(F.lit(1)).alias("n_windows"), F.max("n_games").alias("longest_window"))
    return counted.join(windows, "player", "full")


@query(
    "experience_columns", "X2 X3 X4 X5",
    "player:l game_id:l ply:l games_played_so_far:l days_since_first:l recency_weight:d minutes_since_prev_game:d session_game_index:l",
    f"""{P}, g AS (SELECT player, game_id, min(game_date) AS d, min(game_datetime) AS dt FROM plies GROUP BY player, game_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY d, game_id) AS games_played_so_far,
        d - min(d) OVER (PARTITION BY player) AS days_since_first,
        pow(0.5, (max(d) OVER (PARTITION BY player) - d) / 90.0) AS recency_weight,
        (epoch_us(dt) - lag(epoch_us(dt)) OVER (PARTITION BY player ORDER BY dt, game_id)) / 6e7 AS gap FROM g),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY player ORDER BY dt, game_id) AS sid FROM h),
    i AS (SELECT *, row_number() OVER (PARTITION BY player, sid ORDER BY dt, game_id) - 1 AS session_game_index FROM s)
    SELECT p.player, p.game_id, p.ply, games_played_so_far, days_since_first, recency_weight,
      gap AS minutes_since_prev_game, session_game_index FROM plies p JOIN i ON p.player = i.player AND p.game_id = i.game_id""",
)
def experience_columns(t):
    return sessions.experience(t.plies(), gap_minutes=43200)
