"""Model, insight and profile queries over a pool of ten stand-in players."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.functions.draws import mix
from pacelens.operators import insights, models, profile
from pacelens.plans.catalog import query
from pacelens.plans.catalog.games import corr_sql
from pacelens.sources import rosters
from pacelens.sources.standins import PLIES_SQL

POOL = f"WITH {PLIES_SQL}, pool AS (SELECT * REPLACE (player % 10 AS player) FROM plies)"


def pool(t):
    """Plies of ten large players: customers folded by number."""
    return t.plies().withColumn("player", F.col("player") % 10)


# --- model rows, split, windows ------------------------------------------------------

ROWS = f"""{POOL}, usable AS (SELECT * FROM pool WHERE NOT is_suspect AND think_time IS NOT NULL AND log_think_time IS NOT NULL AND player_rating IS NOT NULL)"""


def split_sql(source: str) -> str:
    return f"""(SELECT player, game_date AS cutoff_date FROM (SELECT player, game_date,
      row_number() OVER (PARTITION BY player ORDER BY game_date, game_id) - 1 AS i, count(*) OVER (PARTITION BY player) AS n
      FROM (SELECT DISTINCT player, game_id, game_date FROM {source})) WHERE i = CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT))"""


@query(
    "model_rows", "M1", "player:l n_rows:l n_games:l",
    f"{ROWS} SELECT player, count(*) AS n_rows, count(DISTINCT game_id) AS n_games FROM usable GROUP BY player",
)
def model_rows(t):
    return models.model_rows(pool(t)).groupBy("player").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("game_id").alias("n_games")
    )


DESIGN = ("gap_1_2", "is_decided", "game_phase", "maia_prob_played", "opp_think_time_prev", "player_rating")
PHASE_CODE = "CASE game_phase WHEN 'opening' THEN 0 WHEN 'middlegame' THEN 1 WHEN 'endgame' THEN 2 END"


@query(
    "design_matrix", "M2", "player:l game_id:l ply:l " + " ".join(f"{c}:d" for c in models.design_columns(DESIGN)),
    "%s SELECT player, game_id, ply, %s FROM usable" % (ROWS, ", ".join(
        f"coalesce(CAST({PHASE_CODE if c == 'game_phase' else c} AS DOUBLE), 0) AS x_{c}, CAST({c} IS NULL AS DOUBLE) AS m_{c}" for c in DESIGN)),
)
def design_matrix(t):
    rows = models.model_rows(pool(t))
    assert set(DESIGN) <= set(models.feature_names(rows))
    return models.design(rows, DESIGN)


@query(
    "time_split_cutoffs", "M3", "player:l cutoff_date:s n_train:l n_test:l",
    f"""{ROWS} SELECT u.player, CAST(cutoff_date AS VARCHAR) AS cutoff_date, count(*) FILTER (WHERE game_date < cutoff_date) AS n_train,
      count(*) FILTER (WHERE game_date >= cutoff_date) AS n_test FROM usable u JOIN {split_sql("usable")} c ON c.player = u.player GROUP BY 1, 2""",
)
def time_split_cutoffs(t):
    split = models.time_split(models.model_rows(pool(t)))
    return split.groupBy("player", "cutoff_date").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test")
    )


LIVE = f"{ROWS}, live AS (SELECT * FROM (SELECT *, max(game_date) OVER (PARTITION BY player) - game_date AS age FROM usable) WHERE age <= 270)"


@query(
    "live_window_rows", "M4", "player:l n_rows:l first_date:s",
    f"{LIVE} SELECT player, count(*) AS n_rows, CAST(min(game_date) AS VARCHAR) AS first_date FROM live GROUP BY player",
)
def live_window_rows(t):
    return models.live_window(models.model_rows(pool(t))).groupBy("player").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("game_date").alias("first_date")
    )


@query(
    "live_eligibility", "M5", "player:l n_rows:l n_live:l n_live_train:l n_live_test:l live_model:b",
    f"""{LIVE}, c AS {split_sql("live")},
    k AS (SELECT l.player, count(*) AS n_live, count(*) FILTER (WHERE game_date < cutoff_date) AS n_live_train,
        count(*) FILTER (WHERE game_date >= cutoff_date) AS n_live_test FROM live l JOIN c ON c.player = l.player GROUP BY 1)
    SELECT u.player, count(*) AS n_rows, any_value(n_live) AS n_live, any_value(n_live_train) AS n_live_train, any_value(n_live_test) AS n_live_test,
      any_value(n_live >= 500 AND n_live_train > 0 AND n_live_test > 0) AS live_model FROM usable u JOIN k ON k.player = u.player GROUP BY 1""",
)
def live_eligibility(t):
    return models.eligibility(models.model_rows(pool(t)))


# --- ridge baseline ------------------------------------------------------------------

X = ("n_captures_available", "clock_before")
RIDGE_SQL = f"""{ROWS}, m AS (SELECT player, count(*) AS n, avg(n_captures_available) AS m1, avg(clock_before) AS m2, avg(log_think_time) AS my,
    stddev_pop(n_captures_available) AS s1, stddev_pop(clock_before) AS s2, covar_pop(n_captures_available, clock_before) AS c12,
    covar_pop(n_captures_available, log_think_time) AS c1y, covar_pop(clock_before, log_think_time) AS c2y FROM usable GROUP BY player),
k AS (SELECT *, c12 / (s1 * s2) AS r, 1 + 1.0 / n AS d, c1y / s1 AS a, c2y / s2 AS b FROM m),
w AS (SELECT *, (d * a - r * b) / (d * d - r * r) / s1 AS w1, (d * b - r * a) / (d * d - r * r) / s2 AS w2 FROM k),
ridge AS (SELECT *, my - w1 * m1 - w2 * m2 AS w0 FROM w)"""


def ridge(t):
    rows = models.model_rows(pool(t))
    return rows, models.fit_ridge(rows, X, "log_think_time")


@query(
    "ridge_coefficients", "M6 M10", "player:l n_rows:l intercept:d w1:d w2:d",
    f"{RIDGE_SQL} SELECT player, n AS n_rows, w0 AS intercept, w1, w2 FROM ridge",
)
def ridge_coefficients(t):
    return ridge(t)[1].withColumns({"w1": F.col("coef")[0], "w2": F.col("coef")[1]})


@query(
    "ridge_predictions", "M12", "player:l game_id:l ply:l pred_log_think_time:d expected_think_time:d",
    f"""{RIDGE_SQL}, p AS (SELECT u.player, game_id, ply, w0 + w1 * n_captures_available + w2 * clock_before AS p FROM usable u JOIN ridge r ON r.player = u.player)
    SELECT player, game_id, ply, p AS pred_log_think_time, exp(p) - 1 AS expected_think_time FROM p""",
)
def ridge_predictions(t):
    rows, fitted = ridge(t)
    return models.expected_think_time(models.predict(rows.drop("pred_log_think_time"), fitted, X))


@query(
    "baseline_errors", "M8", "player:l n_test:l mae:d r2:d",
    f"""{ROWS} SELECT player, count(*) AS n_test, avg(abs(log_think_time - pred_log_think_time)) AS mae,
      1 - sum((log_think_time - pred_log_think_time) ** 2) / (var_pop(log_think_time) * count(*)) AS r2 FROM usable GROUP BY player""",
)
def baseline_errors(t):
    return models.regression_metrics(models.model_rows(pool(t)), "log_think_time", "pred_log_think_time")


@query(
    "baseline_drivers", "M9 R9", "player:l rank:l feature:s importance:d",
    f"""{RIDGE_SQL}, c AS (SELECT u.player, avg(abs(w1 * (n_captures_available - m1))) AS i1, avg(abs(w2 * (clock_before - m2))) AS i2
      FROM usable u JOIN ridge r ON r.player = u.player GROUP BY 1),
    l AS (SELECT player, 'n_captures_available' AS feature, i1 AS importance FROM c UNION ALL SELECT player, 'clock_before', i2 FROM c)
    SELECT player, row_number() OVER (PARTITION BY player ORDER BY importance DESC, feature) AS rank, feature, importance FROM l""",
)
def baseline_drivers(t):
    rows, fitted = ridge(t)
    return models.contributions(rows, fitted, X)


@query(
    "registry_round_trip", "M10 M12", "player:l game_id:l ply:l pred_log_think_time:d expected_think_time:d",
    f"""{RIDGE_SQL}, p AS (SELECT u.player, game_id, ply, w0 + w1 * n_captures_available + w2 * clock_before AS p FROM usable u JOIN ridge r ON r.player = u.player)
    SELECT player, game_id, ply, p AS pred_log_think_time, exp(p) - 1 AS expected_think_time FROM p""",
)
def registry_round_trip(t):
    """The ridge models published twice, the second version read back and scored."""
    import uuid

    from pacelens.functions.storage import shared_folder
    from pacelens.sources import registry

    rows, fitted = ridge(t)
    folder = f"{shared_folder(t.spark)}/registry-{uuid.uuid4().hex}"
    named = models.registry({"thinktime_descriptive": fitted})
    registry.publish(named.withColumn("intercept", F.lit(0.0)), folder)
    registry.publish(named, folder)
    stored = models.preferred(registry.load(t.spark, folder))
    return models.expected_think_time(models.predict(rows.drop("pred_log_think_time"), stored, X))


DEALT_SQL = "((game_id * 64 + ply) % 2147483648 * 2654435761 + 7) % 4294967296"


@query(
    "permutation_drivers", "M9", "player:l feature:s importance:d",
    f"""{RIDGE_SQL}, p AS (SELECT u.player, game_id, ply, log_think_time - (w0 + w1 * n_captures_available + w2 * clock_before) AS e, n_captures_available AS x1, clock_before AS x2,
      w1, w2, {DEALT_SQL} AS h FROM usable u JOIN ridge r ON r.player = u.player),
    d AS (SELECT *, coalesce(lag(x1) OVER o, arg_max(x1, (h, game_id, ply)) OVER (PARTITION BY player)) AS r1,
      coalesce(lag(x2) OVER o, arg_max(x2, (h, game_id, ply)) OVER (PARTITION BY player)) AS r2 FROM p WINDOW o AS (PARTITION BY player ORDER BY h, game_id, ply))
    SELECT player, 'n_captures_available' AS feature, avg((e - w1 * (r1 - x1)) ** 2 - e ** 2) AS importance FROM d GROUP BY player
    UNION ALL SELECT player, 'clock_before', avg((e - w2 * (r2 - x2)) ** 2 - e ** 2) FROM d GROUP BY player""",
)
def permutation_drivers(t):
    rows, fitted = ridge(t)
    return models.permutation_importance(rows.drop("pred_log_think_time"), fitted, X, "log_think_time", order=mix(F.col("game_id") * 64 + F.col("ply"), 7))


WIDE = ("gap_1_2", "is_decided", "game_phase", "n_captures_available", "maia_surprise", "clock_before", "opp_think_time_prev", "low_time", "player_rating")


@query("live_and_full_baselines", "M4 M5 M6 M10", "player:l model:s n_rows:l intercept:d")
def live_and_full_baselines(t):
    from pacelens.operators import sessions

    rows = models.design(sessions.recency(pool(t)), WIDE)
    return models.baseline(rows, models.design_columns(WIDE))


@query("tree_think_time_drivers", "M6 M9", "rank:l feature:s importance:d")
def tree_think_time_drivers(t):
    rows = models.time_split(models.model_rows(pool(t)))
    train = models.design(rows.where(~F.col("is_test")), WIDE)
    columns = models.design_columns(WIDE, indicators=False)
    fitted = models.fit_trees(train, columns, "log_think_time")
    return models.tree_importances(fitted, columns, t.spark)


@query("tree_permutation_drivers", "M9", "feature:s importance:d")
def tree_permutation_drivers(t):
    rows = models.time_split(models.model_rows(pool(t)))
    columns = models.design_columns(WIDE, indicators=False)
    ready = models.design(rows, WIDE)
    fitted = models.fit_trees(ready.where(~F.col("is_test")), columns, "log_think_time")
    return models.tree_permutation_importance(fitted, ready.where("is_test"), columns, "log_think_time")


@query("tree_move_quality", "M7 M8", "player:l n_test:l mae:d r2:d")
def tree_move_quality(t):
    rows = models.time_split(models.model_rows(pool(t)).where(~F.col("is_decided")))
    columns = models.design_columns((*WIDE, "log_think_time"), indicators=False)
    ready = models.design(rows, (*WIDE, "log_think_time"))
    fitted = models.fit_trees(ready.where(~F.col("is_test")), columns, "cp_loss", absolute=True)
    return models.regression_metrics(fitted.transform(ready.where("is_test")), "cp_loss", "prediction")


@query(
    "skill_drift_report", "M11",
    "player:l quartile:l n:l date_min:s date_max:s mean_rating:d corr_time_gap:d mean_cp_loss:d median_think_time:d",
    f"""{POOL}, g AS (SELECT player, game_id, row_number() OVER (PARTITION BY player ORDER BY min(game_date), game_id) AS games_played_so_far FROM pool GROUP BY player, game_id),
    c AS (SELECT p.*, games_played_so_far AS k FROM pool p JOIN g ON g.player = p.player AND g.game_id = p.game_id
      WHERE NOT is_suspect AND gap_1_2 IS NOT NULL AND cp_loss IS NOT NULL),
    q AS (SELECT player, quantile_cont(k, [0.25, 0.5, 0.75]) AS e FROM c GROUP BY player),
    b AS (SELECT c.*, 1 + (k > e[1])::INT + (k > e[2])::INT + (k > e[3])::INT AS quartile FROM c JOIN q ON q.player = c.player)
    SELECT player, quartile, count(*) AS n, min(game_date) AS date_min, max(game_date) AS date_max, avg(player_rating) AS mean_rating,
      {corr_sql("think_time", "gap_1_2")} AS corr_time_gap, avg(cp_loss) AS mean_cp_loss, quantile_cont(think_time, 0.5) AS median_think_time
    FROM b GROUP BY player, quartile""",
)
def skill_drift_report(t):
    from pacelens.operators import sessions

    plies = pool(t)
    numbered = sessions.games_played(sessions.game_table(plies)).select("player", "game_id", "games_played_so_far")
    return models.drift_report(plies.join(numbered, ["player", "game_id"]))


# --- insights ------------------------------------------------------------------------

CLEAN = f"{POOL}, clean AS (SELECT * FROM pool WHERE NOT is_suspect AND think_time IS NOT NULL AND gap_1_2 IS NOT NULL AND cp_loss IS NOT NULL)"


def marked_sql(source: str, out: str) -> str:
    return f"""lim_{out} AS (SELECT player, quantile_cont(gap_1_2, 0.75) AS q75 FROM {source} WHERE NOT (is_recapture OR is_forced) GROUP BY player),
{out} AS (SELECT s.*, coalesce(NOT (is_recapture OR is_forced) AND gap_1_2 >= q75, false) AS is_critical FROM {source} s LEFT JOIN lim_{out} l ON l.player = s.player)"""


SCORED = f"""{CLEAN}, {marked_sql("clean", "marked")}, scored AS (SELECT *, exp(pred_log_think_time) - 1 AS expected, think_time > exp(pred_log_think_time) - 1 AS elevated FROM marked),
ins AS (SELECT *, CASE WHEN elevated AND is_mistake THEN 'panic' WHEN NOT elevated AND is_critical AND is_mistake THEN 'underthought'
  WHEN elevated AND NOT is_critical AND NOT is_mistake THEN 'overthought' WHEN NOT elevated AND is_critical AND NOT is_mistake THEN 'instinctive' ELSE 'clean' END AS bucket FROM scored)"""


def insight_rows(t):
    # The stand-in's whole-second predictions are shifted off the comparison's ties.
    shifted = pool(t).withColumn("pred_log_think_time", F.col("pred_log_think_time") + 0.001)
    return insights.buckets(insights.critical(models.expected_think_time(insights.clean_rows(shifted))))


SCORED = SCORED.replace("exp(pred_log_think_time) - 1", "exp(pred_log_think_time + 0.001) - 1")


@query(
    "critical_positions", "I1", "player:l game_id:l ply:l is_critical:b",
    f"{CLEAN}, {marked_sql('clean', 'marked')} SELECT player, game_id, ply, is_critical FROM marked",
)
def critical_positions(t):
    return insights.critical(insights.clean_rows(pool(t)))


@query("move_buckets", "I2", "player:l game_id:l ply:l bucket:s", f"{SCORED} SELECT player, game_id, ply, bucket FROM ins")
def move_buckets(t):
    return insight_rows(t)


SHARES_SQL = "SELECT player, count(*) AS n, count(*) FILTER (WHERE is_critical) AS n_critical, " + ", ".join(
    f"avg((bucket = '{b}')::INT) AS {b}_share, avg((bucket = '{b}')::INT) FILTER (WHERE is_critical) AS {b}_share_critical" for b in insights.BUCKETS
) + " FROM ins GROUP BY player"


@query(
    "bucket_shares", "I3", "player:l n:l n_critical:l " + " ".join(f"{b}_share:d {b}_share_critical:d" for b in insights.BUCKETS),
    f"{SCORED} {SHARES_SQL}",
)
def bucket_shares(t):
    return insights.bucket_shares(insight_rows(t))


PREMOVE_SQL = """SELECT player, avg(is_premove::INT) AS premove_rate, avg(cp_loss) FILTER (WHERE is_premove) AS premove_cp_loss,
  avg(cp_loss) FILTER (WHERE NOT is_premove) AS non_premove_cp_loss, avg(is_premove::INT) FILTER (WHERE is_recapture OR is_forced) AS premove_rate_on_obvious,
  avg(is_premove::INT) FILTER (WHERE is_critical) AS premove_rate_on_critical, count(*) FILTER (WHERE is_critical AND is_premove) AS n_risky_premoves,
  avg(cp_loss) FILTER (WHERE is_critical AND is_premove) AS risky_premove_cp_loss FROM pmarked GROUP BY player"""
PREMOVE_ROWS = f"""prem AS (SELECT * FROM pool WHERE NOT (is_negative OR lag_suspect OR think_time IS NULL) AND gap_1_2 IS NOT NULL AND cp_loss IS NOT NULL),
{marked_sql("prem", "pmarked")}"""


@query(
    "premove_profile", "I4",
    "player:l premove_rate:d premove_cp_loss:d non_premove_cp_loss:d premove_rate_on_obvious:d premove_rate_on_critical:d n_risky_premoves:l risky_premove_cp_loss:d",
    f"{POOL}, {PREMOVE_ROWS} {PREMOVE_SQL}",
)
def premove_profile(t):
    return insights.premove_profile(insights.premove_rows(pool(t)))


# --- profiles ------------------------------------------------------------------------

PCLEAN = f"{POOL}, clean AS (SELECT * FROM pool WHERE NOT is_suspect AND think_time IS NOT NULL)"


def clean(t):
    return profile.clean_rows(pool(t))


def live_ratings(t):
    """A live rating for the nations' first five numbers."""
    return t.nation.where("n_nationkey < 5").select(
        F.col("n_nationkey").cast("bigint").alias("player"), (1500.0 + F.col("n_nationkey") * 10).alias("rating"),
        (F.lit(1700000000) + F.col("n_nationkey") * 86400).cast("bigint").alias("as_of_unix"),
    )


@query(
    "player_summary", "R1 S8",
    "player:l n_games:l n_plies:l rating_min:d rating_max:d date_min:s date_max:s current_rating:d current_rating_source:s current_rating_as_of:s",
    f"""{POOL}, s AS (SELECT player, count(DISTINCT game_id) AS n_games, count(*) AS n_plies, min(player_rating) AS rating_min, max(player_rating) AS rating_max,
      min(game_date) AS date_min, max(game_date) AS date_max, arg_max(player_rating, (game_date, game_datetime, ply)) AS pre FROM pool GROUP BY player)
    SELECT player, n_games, n_plies, rating_min, rating_max, date_min, date_max, CASE WHEN player < 5 THEN 1500 + player * 10 ELSE pre END AS current_rating,
      CASE WHEN player < 5 THEN 'live' ELSE 'last_game_pregame' END AS current_rating_source,
      CASE WHEN player < 5 THEN strftime(make_timestamp((1700000000 + player * 86400) * 1000000), '%Y-%m-%d') ELSE CAST(date_max AS VARCHAR) END AS current_rating_as_of FROM s""",
)
def player_summary(t):
    return profile.summary(pool(t), live_ratings(t))


@query(
    "phase_time", "R2", "player:l opening_think:d opening_share:d middlegame_think:d middlegame_share:d endgame_think:d endgame_share:d",
    f"{PCLEAN} SELECT player, " + ", ".join(
        f"avg(think_time) FILTER (WHERE game_phase = '{p}') AS {p}_think, avg((game_phase = '{p}')::INT) AS {p}_share" for p in ("opening", "middlegame", "endgame")
    ) + " FROM clean GROUP BY player",
)
def phase_time(t):
    return profile.phase_time(clean(t))


CURVE_SQL = f"""{PCLEAN}, k AS (SELECT * FROM clean WHERE gap_1_2 IS NOT NULL),
e AS (SELECT player, count(*) AS c, list_sort(list_distinct(quantile_cont(gap_1_2, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM k GROUP BY player),
b AS (SELECT k.*, len(list_filter(e[2:len(e) - 1], lambda x: gap_1_2 > x)) + 1 AS quintile FROM k JOIN e ON e.player = k.player WHERE c > 200 AND len(e) >= 2)
SELECT player, quintile, count(*) AS n, avg(played_best_move::INT) AS p_best_move, avg(think_time) AS mean_think_time, avg(cp_loss) AS mean_cp_loss FROM b GROUP BY 1, 2"""


@query("difficulty_curves", "R3 R4", "player:l quintile:l n:l p_best_move:d mean_think_time:d mean_cp_loss:d", CURVE_SQL)
def difficulty_curves(t):
    return profile.curves(clean(t))


CLUTCH_SQL = """SELECT player, avg(low_time::INT) AS low_time_share, avg(cp_loss) FILTER (WHERE low_time) AS cp_loss_low_time,
  avg(cp_loss) FILTER (WHERE NOT low_time) AS cp_loss_normal_time, avg((bucket = 'panic')::INT) FILTER (WHERE low_time) AS panic_rate_low_time,
  avg((bucket = 'panic')::INT) FILTER (WHERE NOT low_time) AS panic_rate_normal_time FROM ins GROUP BY player"""


@query(
    "clutch", "R5", "player:l low_time_share:d cp_loss_low_time:d cp_loss_normal_time:d panic_rate_low_time:d panic_rate_normal_time:d",
    f"{SCORED} {CLUTCH_SQL}",
)
def clutch(t):
    return profile.clutch(insight_rows(t))


@query(
    "sacrifice_profile", "R6", "player:l sacrifice_rate:d mean_think_time_sacrifice:d mean_think_time_non_sacrifice:d",
    f"""{PCLEAN} SELECT player, avg(is_sacrifice::INT) AS sacrifice_rate, avg(think_time) FILTER (WHERE is_sacrifice) AS mean_think_time_sacrifice,
      avg(think_time) FILTER (WHERE NOT is_sacrifice) AS mean_think_time_non_sacrifice FROM clean GROUP BY player""",
)
def sacrifice_profile(t):
    return profile.sacrifices(clean(t))


@query(
    "policy_profile", "R7", "player:l mean_prob_played:d mean_surprise:d top_choice_rate:d overriding_instinct_rate:d",
    f"""{PCLEAN} SELECT player, avg(maia_prob_played) AS mean_prob_played, avg(maia_surprise) AS mean_surprise, avg(maia_is_top_choice::INT) AS top_choice_rate,
      avg(requires_overriding_instinct::INT) AS overriding_instinct_rate FROM clean WHERE maia_prob_played IS NOT NULL GROUP BY player""",
)
def policy_profile(t):
    return profile.policy(clean(t))


def rank_sql(c: str) -> str:
    return f"rank() OVER (PARTITION BY player ORDER BY {c}) + (count(*) OVER (PARTITION BY player, {c}) - 1) / 2.0"


@query(
    "skewer_profile", "R8", "player:l own_skewer_prevalence:d opp_skewer_prevalence:d own_skewer_corr:d opp_skewer_corr:d",
    f"""{PCLEAN}, r AS (SELECT *, {rank_sql("own_skewers")} AS ro, {rank_sql("opp_skewers")} AS rp, {rank_sql("think_time")} AS rt FROM clean)
    SELECT player, avg((own_skewers > 0)::INT) AS own_skewer_prevalence, avg((opp_skewers > 0)::INT) AS opp_skewer_prevalence,
      {corr_sql("ro", "rt")} AS own_skewer_corr, {corr_sql("rp", "rt")} AS opp_skewer_corr FROM r GROUP BY player""",
)
def skewer_profile(t):
    return profile.skewers(clean(t))


RAW_SQL = f"""{SCORED}, shares AS ({SHARES_SQL}), clu AS ({CLUTCH_SQL}), {PREMOVE_ROWS}, pre AS ({PREMOVE_SQL}),
pol AS (SELECT player, avg(maia_is_top_choice::INT) AS intuition FROM pool WHERE NOT is_suspect AND maia_prob_played IS NOT NULL GROUP BY player),
sac AS (SELECT player, avg(is_sacrifice::INT) AS aggression FROM pool WHERE NOT is_suspect GROUP BY player),
raw AS (SELECT shares.player, instinctive_share_critical AS recognition, clean_share AS efficiency, cp_loss_normal_time / nullif(cp_loss_low_time, 0) AS clutch,
    panic_share AS composure, premove_rate_on_critical AS discipline, intuition, aggression
  FROM shares LEFT JOIN clu ON clu.player = shares.player LEFT JOIN pre ON pre.player = shares.player
  LEFT JOIN pol ON pol.player = shares.player LEFT JOIN sac ON sac.player = shares.player)"""


def raw_attributes(t):
    ins, rows = insight_rows(t), clean(t)
    return profile.raw_attributes(
        insights.bucket_shares(ins), profile.clutch(ins), insights.premove_profile(insights.premove_rows(pool(t))),
        profile.policy(rows), profile.sacrifices(rows),
    )


def score_sql(name: str, lo: float, hi: float, up: bool) -> str:
    x = f"greatest(0, least(1, ({name} - {lo}) / ({hi} - {lo}::DOUBLE)))"
    return f"CASE WHEN {name} IS NOT NULL THEN round_even({x if up else f'(1 - {x})'} * 100, 0) END AS {name}_score"


@query(
    "rating_scores", "R10", "player:l " + " ".join(f"{a}:d {a}_score:l" for a in profile.ATTRIBUTES),
    f"{RAW_SQL} SELECT *, " + ", ".join(score_sql(n, lo, hi, up) for _, n, lo, hi, up in profile.ANCHORS) + " FROM raw",
)
def rating_scores(t):
    return profile.scores(raw_attributes(t))


ATTRS = ("think_time", "cp_loss", "maia_surprise")


@query(
    "anchor_calibration", "R11", "attribute:s n:l p5:d p50:d p95:d min:d max:d",
    f"{POOL}, m AS (SELECT game_id, avg(think_time) AS think_time, max(cp_loss) AS cp_loss, min(maia_surprise) AS maia_surprise FROM pool GROUP BY game_id) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, count({a}) AS n, quantile_cont({a}, 0.05) AS p5, quantile_cont({a}, 0.5) AS p50, quantile_cont({a}, 0.95) AS p95, min({a}) AS min, max({a}) AS max FROM m" for a in ATTRS),
)
def anchor_calibration(t):
    per_game = pool(t).groupBy("game_id").agg(
        F.avg("think_time").alias("think_time"), F.max("cp_loss").alias("cp_loss"), F.min("maia_surprise").alias("maia_surprise")
    )
    return profile.calibrate(per_game, ATTRS)


TREND = ", ".join(f"avg((bucket = '{b}')::INT) AS {b}_share" for b in insights.BUCKETS)
TREND_KINDS = "n:l " + " ".join(f"{b}_share:d" for b in insights.BUCKETS)


@query(
    "bucket_segments", "R12", f"player:l strength:s color:s mode:s {TREND_KINDS}",
    f"""{SCORED}, s AS (SELECT *, CASE WHEN opp_rating - player_rating > 100 THEN 'stronger' WHEN opp_rating - player_rating < -100 THEN 'weaker' ELSE 'even' END AS strength FROM ins)
    SELECT player, strength, color, mode, count(*) AS n, {TREND} FROM s GROUP BY player, CUBE (strength, color, mode)""",
)
def bucket_segments(t):
    rows = insight_rows(t).withColumn("strength", profile.strength_band(F.col("player_rating"), F.col("opp_rating")))
    return profile.segment_trend(rows, ("strength", "color", "mode"))


@query(
    "bucket_career", "R12", f"player:l year:l {TREND_KINDS}",
    f"{SCORED} SELECT player, year(game_date) AS year, count(*) AS n, {TREND} FROM ins GROUP BY 1, 2",
)
def bucket_career(t):
    return profile.career_trend(insight_rows(t))


@query(
    "clock_decile_baseline", "R13", "player:l decile:l n:l median_think_time:d",
    f"""{PCLEAN}, e AS (SELECT player, list_sort(list_distinct(quantile_cont(clock_before, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM clean GROUP BY player),
    b AS (SELECT c.*, len(list_filter(e[2:len(e) - 1], lambda x: clock_before > x)) AS decile FROM clean c JOIN e ON e.player = c.player WHERE len(e) >= 2)
    SELECT player, decile, count(*) AS n, quantile_cont(think_time, 0.5) AS median_think_time FROM b GROUP BY 1, 2""",
)
def clock_decile_baseline(t):
    return profile.clock_baseline(clean(t))


# --- rosters -------------------------------------------------------------------------


@query(
    "model_roster", "S7", "player:l path:s is_live:b",
    """SELECT c_custkey AS player, CASE WHEN c_custkey % 3 = 0 THEN 'live/' ELSE 'full/' END || CAST(c_custkey AS VARCHAR) AS path, c_custkey % 3 = 0 AS is_live
    FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)""",
)
def model_roster(t):
    c = t.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("player"))
    p = F.col("player").cast("string")
    live = c.where("player % 3 = 0").select("player", F.lit("thinktime_live").alias("model"), F.concat(F.lit("live/"), p).alias("path"))
    full = c.select("player", F.lit("thinktime_descriptive").alias("model"), F.concat(F.lit("full/"), p).alias("path"))
    return rosters.roster(t.orders.select(F.col("o_custkey").alias("player")), live.unionByName(full))


@query(
    "band_sample", "S9", "username:s rating:l n_games:l band:l rank:l",
    """WITH s AS (SELECT c_name AS username, c_custkey AS id, CAST(floor(c_acctbal / 3 + 500) AS BIGINT) AS rating, count(o_orderkey) AS n_games
      FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2, 3),
    p AS (SELECT * FROM s ORDER BY ((id % 2147483648) * 2654435761 + 7) % 4294967296, username LIMIT 150),
    b AS (SELECT *, CASE WHEN rating < 800 THEN 0 WHEN rating < 1100 THEN 1 WHEN rating < 1400 THEN 2 WHEN rating < 1700 THEN 3
      WHEN rating < 2000 THEN 4 WHEN rating < 2300 THEN 5 WHEN rating < 4000 THEN 6 END AS band FROM p WHERE n_games >= 5 AND rating >= 0)
    SELECT username, rating, n_games, band, row_number() OVER (PARTITION BY band ORDER BY n_games DESC, username) AS rank FROM b WHERE band IS NOT NULL
    QUALIFY rank <= 3""",
)
def band_sample(t):
    from pacelens.functions.draws import mix

    games = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_games"))
    stats = t.customer.join(games, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_name").alias("username"), F.col("c_custkey").alias("id"),
        F.floor(F.col("c_acctbal") / 3 + 500).alias("rating"), "n_games",
    )
    known = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("username"))
    return rosters.band_sample(stats, known, min_games=5, order=mix("id", 7))


@query(
    "mined_opponents", "S10", "username:s",
    """SELECT DISTINCT 'supplier#' || CAST(l_suppkey AS VARCHAR) AS username FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
)
def mined_opponents(t):
    met = t.lineitem.select(F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("opponent"))
    known = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("SUPPLIER#"), F.col("s_suppkey").cast("string")).alias("player"))
    return rosters.opponents(met, known)
