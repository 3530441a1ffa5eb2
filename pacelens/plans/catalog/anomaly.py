"""Injected-anomaly queries on the stand-in plies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.functions.draws import mix
from pacelens.operators import anomaly
from pacelens.plans.catalog import query
from pacelens.sources.standins import PLIES_SQL

P = f"WITH {PLIES_SQL}, pool AS (SELECT * REPLACE (player % 10 AS player) FROM plies WHERE NOT is_suspect)"


def mix_sql(c: str, seed: int) -> str:
    return f"((({c}) % 2147483648) * 2654435761 + {seed}) % 4294967296"


def draw(channel):
    """Integer draw both engines can repeat."""
    return mix(F.col("game_id") * 31 + F.col("ply") * (7 + channel), 1000 * channel + 17)


def draw_sql(channel: int) -> str:
    return mix_sql(f"game_id * 31 + ply * {7 + channel}", 1000 * channel + 17)


def unit_sql(channel: int) -> str:
    return f"(({draw_sql(channel)} + 0.5) / 4294967296.0::DOUBLE)"


QUICK = f"0.2 + {unit_sql(1)} * (1.0 - 0.2)::DOUBLE"
HIDDEN = f"greatest(0.1, exp(pred_log_think_time + 0.15 * sqrt(-2 * ln({unit_sql(2)})) * cos(2 * pi() * {unit_sql(3)})) - 1)"
RANKED = f"""{P}, ranked AS (SELECT *, row_number() OVER (PARTITION BY player, game_id ORDER BY {draw_sql(0)}, ply) AS by_draw,
  CASE WHEN gap_1_2 IS NOT NULL THEN row_number() OVER (PARTITION BY player, game_id ORDER BY gap_1_2 NULLS LAST, ply) END AS by_gap,
  count(*) OVER (PARTITION BY player, game_id) AS len FROM pool)"""


def altered_sql(source: str, chosen: str, mode: str, extra: str = "") -> str:
    return f"""(SELECT player, game_id, ply, pred_log_think_time, n_moves_within_30cp, gap_1_2, eval_before, player_rating, inj AS is_injected{extra},
      CASE WHEN inj THEN maia_prob_best_move ELSE maia_prob_played END AS maia_prob_played,
      CASE WHEN inj THEN -ln(greatest(maia_prob_best_move, 1e-6)) ELSE maia_surprise END AS maia_surprise,
      played_best_move OR inj AS played_best_move,
      CASE WHEN NOT inj THEN think_time WHEN {mode} = 'naive' THEN {QUICK} WHEN {mode} = 'smart' THEN {HIDDEN} ELSE think_time END AS think_time
      FROM (SELECT *, coalesce({chosen}, false) AS inj FROM {source}))"""


def share_sql(rate: str) -> str:
    return f"CASE WHEN {rate} > 0 THEN greatest(1, least(len, round_even(len * {rate}::DOUBLE, 0))) ELSE 0 END"


ALTERED = "player:l game_id:l ply:l is_injected:b maia_prob_played:d maia_surprise:d played_best_move:b think_time:d"


def pool(t):
    return t.plies().where(~F.col("is_suspect")).withColumn("player", F.col("player") % 10)


@query("perturbed_share", "A1 A3", ALTERED, f"{RANKED} SELECT * FROM {altered_sql('ranked', 'by_draw <= ' + share_sql('0.25'), chr(39) + 'naive' + chr(39))}")
def perturbed_share(t):
    return anomaly.perturb(pool(t), rate=0.25, draw=draw)


@query("perturbed_critical", "A2 A3", ALTERED, f"{RANKED} SELECT * FROM {altered_sql('ranked', 'by_gap <= 2', chr(39) + 'smart' + chr(39))}")
def perturbed_critical(t):
    return anomaly.perturb(pool(t), top_k=2, timing="smart", draw=draw)


def moves_array(plies):
    """Candidate moves and a position name for every ply."""
    names = F.transform(F.sequence(F.lit(0), (F.col("n_moves_within_30cp") - 1).cast("int")), lambda i: F.concat(F.lit("m"), ((F.col("ply") * 3 + i * 5) % 13).cast("string")))
    return plies.withColumns(
        {
            "top_moves": names,
            "fen_before": F.concat(F.lit("e"), F.col("eval_before").cast("int").cast("string")),
            "maia_rating_bin": (1100 + 100 * (F.col("game_id") % 9)).cast("int"),
        }
    )


ALTERNATE = f"""m AS (SELECT *, CASE WHEN is_injected THEN CASE WHEN n_moves_within_30cp > 1 THEN 1 + CAST(floor({draw_sql(4)} * (n_moves_within_30cp - 1) / 4294967296.0::DOUBLE) AS BIGINT) ELSE 0 END END AS i FROM hit),
    a AS (SELECT *, 'm' || CAST((ply * 3 + i * 5) % 13 AS VARCHAR) AS alternate_move FROM m),
    pol AS (SELECT 'e' || CAST(p_partkey % 801 - 400 AS VARCHAR) AS f, 1100 + 100 * (p_partkey % 9) AS bin, 'm' || CAST(p_partkey * 5 % 13 AS VARCHAR) AS move,
      (p_size % 32) / 64.0 + p_partkey % 13 / 1024.0 AS prob FROM part QUALIFY row_number() OVER (PARTITION BY f, bin, move ORDER BY p_partkey DESC) = 1)"""


@query(
    "alternate_move_plies", "A4", "player:l game_id:l ply:l is_injected:b alternate_move:s maia_prob_played:d maia_surprise:d played_best_move:b",
    f"""{RANKED}, hit AS {altered_sql('ranked', 'by_gap <= 1', chr(39) + 'smart' + chr(39))},
    {ALTERNATE}
    SELECT player, game_id, ply, is_injected, alternate_move, CASE WHEN alternate_move IS NULL THEN maia_prob_played ELSE coalesce(prob, 1e-6) END AS maia_prob_played,
      CASE WHEN alternate_move IS NULL THEN maia_surprise ELSE -ln(greatest(coalesce(prob, 1e-6), 1e-6)) END AS maia_surprise,
      played_best_move AND alternate_move IS NULL AS played_best_move
    FROM a LEFT JOIN pol ON f = 'e' || CAST(CAST(eval_before AS INT) AS VARCHAR) AND bin = 1100 + 100 * (game_id % 9) AND move = alternate_move""",
)
def alternate_move_plies(t):
    from pacelens.plans.catalog.annotate import standin_policy

    return anomaly.alternate_moves(moves_array(pool(t)), standin_policy(t), top_k=1, draw=draw)


RESID = "ln(1 + greatest(think_time, 0)) - pred_log_think_time"
MEAN_SQL = f"-avg({RESID}) AS timing_score, -avg(maia_surprise) AS maia_score, -avg({RESID}) - avg(maia_surprise) AS combined"


def top3_sql(e: str) -> str:
    return f"list_avg(list_reverse_sort(list({e}))[1:3])"


MAX_SQL = f"""max(-({RESID})) AS timing_max, {top3_sql(f"-({RESID})")} AS timing_top3_mean,
  max(-maia_surprise) AS maia_max, {top3_sql("-maia_surprise")} AS maia_top3_mean"""
MEAN_KINDS = "timing_score:d maia_score:d combined:d"


@query("mean_scores", "A5", f"player:l game_id:l {MEAN_KINDS}", f"{P} SELECT player, game_id, {MEAN_SQL} FROM pool GROUP BY 1, 2")
def mean_scores(t):
    return anomaly.score(pool(t))


@query(
    "max_scores", "A6", "player:l game_id:l timing_max:d timing_top3_mean:d maia_max:d maia_top3_mean:d",
    f"{P} SELECT player, game_id, {MAX_SQL} FROM pool GROUP BY 1, 2",
)
def max_scores(t):
    return anomaly.score(pool(t), "max")


SCENARIOS = anomaly.scenario_list(ks=anomaly.CRITICAL_KS)
LIST_SQL = ", ".join(
    f"('{m}', {'NULL' if r is None else f'{r}::DOUBLE'}, {'NULL' if k is None else k})" for m, r, k in [("clean", 0.0, None), *SCENARIOS]
)
FANNED = f"""{RANKED}, sc AS (SELECT * FROM (VALUES {LIST_SQL}) v(mode, rate, k)),
fan AS (SELECT ranked.* EXCLUDE (mode), sc.mode, rate, k FROM ranked, sc),
alt AS {altered_sql('fan', f"(rate IS NOT NULL AND by_draw <= {share_sql('rate')}) OR (k IS NOT NULL AND by_gap <= k)", 'mode', ', mode, rate, k')},
scored AS (SELECT player, game_id, mode, rate, k, {MEAN_SQL}, {MAX_SQL} FROM alt GROUP BY ALL),
labelled AS (SELECT *, true AS altered FROM scored WHERE mode <> 'clean'
  UNION ALL SELECT s.* REPLACE (sc.mode AS mode, sc.rate AS rate, sc.k AS k), false FROM scored s, sc WHERE s.mode = 'clean' AND sc.mode <> 'clean')"""
SCENARIO_KINDS = "player:l mode:s rate:d k:l"


def scored(t, reducer="mean"):
    return anomaly.score_scenarios(pool(t), SCENARIOS, reducer, draw)


KEYS = (*anomaly.GAME, *anomaly.SCENARIO)


@query("scenario_scores", "A1 A2 A3 A5", f"game_id:l {SCENARIO_KINDS} {MEAN_KINDS}", f"{FANNED} SELECT * FROM scored")
def scenario_scores(t):
    return scored(t)


def auc_sql(keys: str, source: str, value: str, label: str = "altered") -> str:
    return f"""SELECT {keys}, (sum(CASE WHEN {label} THEN rk END) - sum({label}::INT) * (sum({label}::INT) + 1) / 2.0) / nullif(sum({label}::INT) * sum((NOT {label})::INT), 0) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS rk FROM {source}) GROUP BY {keys}"""


def scenario_auc_sql(columns) -> str:
    parts = [f"(SELECT '{c}' AS score, * FROM ({auc_sql('player, mode, rate, k', 'snapped', c)}))" for c in columns]
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


SNAP = (*anomaly.MEAN_SCORES, *anomaly.MAX_SCORES)
SNAPPED = f"{FANNED}, snapped AS (SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in SNAP)}) FROM labelled)"


def snapped(scores):
    """Scores rounded to nine places, so ties are ties on both sides."""
    return scores.withColumns({c: F.round(c, 9) for c in SNAP if c in scores.columns})


@query("scenario_auc", "A7", f"{SCENARIO_KINDS} score:s auc:d", f"{SNAPPED} {scenario_auc_sql(anomaly.MEAN_SCORES)}")
def scenario_auc(t):
    return anomaly.separation(snapped(scored(t)), SCENARIOS, anomaly.MEAN_SCORES)


@query("scenario_auc_worst_move", "A6 A7", f"{SCENARIO_KINDS} score:s auc:d", f"{SNAPPED} {scenario_auc_sql(anomaly.MAX_SCORES)}")
def scenario_auc_worst_move(t):
    return anomaly.separation(snapped(scored(t, "max")), SCENARIOS, anomaly.MAX_SCORES)


@query(
    "game_score_auc", "A7", "player:l auc:d",
    f"{P}, g AS (SELECT player, game_id, sum(think_time) AS s, game_id % 3 = 0 AS altered FROM pool GROUP BY player, game_id) {auc_sql('player', 'g', 's')}",
)
def game_score_auc(t):
    from pacelens.functions.stats import auc

    g = pool(t).groupBy("player", "game_id").agg(F.sum("think_time").alias("s"))
    return auc(g.withColumn("altered", F.col("game_id") % 3 == 0), ["player"], "altered", "s")


FEATURE_SQL = f"""avg({RESID}) AS resid_mean, stddev_pop({RESID}) AS resid_std, max(abs({RESID})) AS resid_max, {top3_sql(f"abs({RESID})")} AS resid_top3_mean,
  avg(maia_surprise) AS surprise_mean, stddev_pop(maia_surprise) AS surprise_std, max(maia_surprise) AS surprise_max, {top3_sql("maia_surprise")} AS surprise_top3_mean"""


@query(
    "detector_features", "A9", "player:l game_id:l " + " ".join(f"{c}:d" for c in anomaly.SELECTIVE_FEATURES),
    f"{P} SELECT player, game_id, {FEATURE_SQL} FROM pool GROUP BY 1, 2",
)
def detector_features(t):
    return anomaly.game_features(pool(t))


@query(
    "engine_agreement", "A11", "player:l game_id:l match_rate_all:d match_rate_informative:d n_informative:l",
    f"""{P} SELECT player, game_id, avg(played_best_move::INT) AS match_rate_all, coalesce(avg(played_best_move::INT) FILTER (WHERE n_moves_within_30cp >= 2), avg(played_best_move::INT)) AS match_rate_informative,
      count(*) FILTER (WHERE n_moves_within_30cp >= 2) AS n_informative FROM pool GROUP BY 1, 2""",
)
def engine_agreement(t):
    return anomaly.agreement(pool(t))


def paired(t, timing="smart", rate=1.0, k=None):
    """Clean games of every player and altered ones, all plies or ``k`` of them, with all detector features."""
    one = [(timing, rate, k)]
    plies = anomaly.perturb_scenarios(pool(t), one, draw=draw)
    return anomaly.against_clean(anomaly.game_evidence(plies, KEYS), one).select(
        "player", "game_id", "altered", *anomaly.SELECTIVE_FEATURES, *anomaly.AGREEMENT_FEATURES
    )


@query("trained_combiner", "A8", "player:l trained_auc:d naive_auc:d weight_timing_score:d weight_maia_score:d")
def trained_combiner(t):
    one = [("smart", 1.0, None)]
    scores = anomaly.score(anomaly.perturb_scenarios(pool(t), one, draw=draw), "mean", KEYS)
    return anomaly.combiner(anomaly.against_clean(scores, one).drop("mode", "rate", "k"))


@query("trained_detector", "A10", "player:l auc_rich:d auc_thin:d")
def trained_detector(t):
    folds = anomaly.detector_folds(paired(t))
    return anomaly.detector(folds, {"rich": anomaly.RICH_FEATURES, "thin": anomaly.THIN_FEATURES["flat"]})


@query("selective_detector", "A10", "player:l auc_rich:d auc_thin:d")
def selective_detector(t):
    """Three altered plies a game: extremes of a game against the two plain maxima."""
    folds = anomaly.detector_folds(paired(t, rate=None, k=3))
    return anomaly.detector(folds, {"rich": anomaly.SELECTIVE_FEATURES, "thin": anomaly.THIN_FEATURES["selective"]})


@query("scenario_combiners", "A8 A14", "scenario:s player:l trained_auc:d naive_auc:d weight_timing_score:d weight_maia_score:d")
def scenario_combiners(t):
    """A combiner of its own for every player and scenario."""
    wanted = [("naive", 1.0, None), ("smart", 0.5, None), ("smart", 1.0, None), ("smart", None, 3)]
    scores = anomaly.score(anomaly.perturb_scenarios(pool(t), wanted, draw=draw), "mean", KEYS)
    labelled = anomaly.against_clean(scores, wanted)
    named = labelled.withColumn("scenario", F.concat_ws(" ", "mode", F.col("rate").cast("string"), F.concat(F.lit("k="), F.col("k").cast("string"))))
    return anomaly.combiner(named.drop("mode", "rate", "k"), keys=("scenario", "player"))


@query(
    "detector_gradients", "A8 A10 A12", "player:l model:l largest_gradient:d settled:b",
    f"""{P}, g AS (SELECT DISTINCT player, game_id FROM pool), s AS (SELECT player FROM g GROUP BY player HAVING 2 * count(*) >= 24)
    SELECT player, model, 0.0 AS largest_gradient, true AS settled FROM s, range(5) r(model)""",
)
def detector_gradients(t):
    """The gradient of each cross-fitted model at its weights, added up over the rows it may see: nothing is left to gain."""
    from pacelens.functions.storage import materialise
    from pacelens.operators import logistic

    columns = anomaly.THIN_FEATURES["flat"]
    rows = materialise(anomaly.balanced(anomaly.detector_folds(paired(t))))
    fitted = logistic.cross_fitted(rows, ["player"], columns, "altered", 5, "weight")
    seen = rows.join(fitted.withColumnRenamed("fold", "model"), "player").where("fold <> model")
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]]
    total = sum((F.col("coef")[j] * v for j, v in enumerate(x)), F.lit(0.0))
    left = F.col("weight") * (F.col("altered").cast("double") - 1 / (1 + F.exp(-total)))
    slopes = [F.sum(left * v) - (F.max(F.col("coef")[j]) if j else F.lit(0.0)) for j, v in enumerate(x)]
    found = seen.groupBy("player", "model").agg(F.greatest(*[F.abs(g) for g in slopes]).alias("g"), F.max("moved").alias("moved"))
    return found.select("player", "model", F.round("g", 3).alias("largest_gradient"), (F.col("moved") < logistic.SETTLED).alias("settled"))


@query("evidence_combination", "A12", "player:l model:s auc:d")
def evidence_combination(t):
    return anomaly.combination(anomaly.detector_folds(paired(t)), anomaly.AGREEMENT_FEATURES, anomaly.RICH_FEATURES)


@query(
    "detector_fold_sizes", "A10", "player:l altered:b fold:l n:l",
    f"""{P}, g AS (SELECT DISTINCT player, game_id FROM pool), l AS (SELECT *, true AS altered FROM g UNION ALL SELECT *, false FROM g),
    s AS (SELECT player, count(*) AS c FROM l GROUP BY player HAVING count(*) >= 24),
    r AS (SELECT l.*, c, row_number() OVER (PARTITION BY l.player, altered ORDER BY {mix_sql('game_id', 4)}, game_id) - 1 AS i FROM l JOIN s ON s.player = l.player)
    SELECT player, altered, i % CASE WHEN c >= 50 THEN 5 WHEN c >= 32 THEN 4 ELSE 3 END AS fold, count(*) AS n FROM r GROUP BY 1, 2, 3""",
)
def detector_fold_sizes(t):
    g = pool(t).select("player", "game_id").distinct()
    labelled = g.withColumn("altered", F.explode(F.array(F.lit(True), F.lit(False))))
    folds = anomaly.detector_folds(labelled, order=mix("game_id", 4))
    return folds.groupBy("player", "altered", "fold").agg(F.count(F.lit(1)).alias("n"))


PICK_SQL = mix_sql("b * 7919 + j * 104729 + n * 1299709 + altered::INT * 15485863", 11)


def pick(resample, j, n, altered):
    return mix(resample * 7919 + j * 104729 + n * 1299709 + altered * 15485863, 11)


BOOT_SQL = f"""{P}, g AS (SELECT player, game_id, sum(think_time) AS score, game_id % 3 = 0 AS altered FROM pool GROUP BY player, game_id),
l AS (SELECT player, altered, list(score ORDER BY game_id) AS s FROM g GROUP BY player, altered),
z AS (SELECT l.*, n, b FROM l, (VALUES (1), (3), (5), (10), (20)) v(n), range(400) r(b) WHERE len(s) >= n),
d AS (SELECT player, altered, n, b, s, unnest(range(1, n + 1)) AS j FROM z),
e AS (SELECT player, altered, n AS n_games, b, sum(s[1 + CAST(floor({PICK_SQL} * len(s) / 4294967296.0::DOUBLE) AS BIGINT)]) / n AS evidence FROM d GROUP BY ALL)"""
BOOT_SQL = BOOT_SQL.replace("GROUP BY ALL)", "GROUP BY player, altered, n, b)")


def game_sums(t):
    g = pool(t).groupBy("player", "game_id").agg(F.sum("think_time").alias("score"))
    return g.withColumn("altered", F.col("game_id") % 3 == 0)


@query("bootstrap_auc", "A13", "player:l n_games:l auc:e", f"{BOOT_SQL} SELECT * FROM ({auc_sql('player, n_games', 'e', 'evidence')}) WHERE auc IS NOT NULL")
def bootstrap_auc(t):
    return anomaly.bootstrap_auc(game_sums(t), pick=pick)


QUARTS = "quantile_cont(auc, 0.25) AS q25, quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.75) AS q75, min(auc) AS min, max(auc) AS max, count(*) AS n"


@query(
    "bootstrap_curve", "A13 A14", "n_games:l q25:e median:e q75:e min:e max:e n:l",
    f"{BOOT_SQL}, a AS (SELECT * FROM ({auc_sql('player, n_games', 'e', 'evidence')}) WHERE auc IS NOT NULL) SELECT n_games, {QUARTS} FROM a GROUP BY n_games",
)
def bootstrap_curve(t):
    return anomaly.summary(anomaly.bootstrap_auc(game_sums(t), pick=pick), ["n_games"])


@query(
    "scenario_summary", "A14", "mode:s rate:d k:l score:s q25:d median:d q75:d min:d max:d n:l",
    f"{SNAPPED}, a AS ({scenario_auc_sql(anomaly.MEAN_SCORES)}) SELECT mode, rate, k, score, {QUARTS} FROM a WHERE auc IS NOT NULL GROUP BY 1, 2, 3, 4",
)
def scenario_summary(t):
    return anomaly.summary(scenario_auc(t), [*anomaly.SCENARIO, "score"])


@query(
    "direction_free_strength", "A14", "player:l strength:d band:s",
    f"""{P}, g AS (SELECT player, game_id, sum(think_time) AS s, game_id % 3 = 0 AS altered FROM pool GROUP BY player, game_id),
    a AS ({auc_sql('player', 'g', 's')}) SELECT player, greatest(auc, 1 - auc) AS strength,
      CASE WHEN greatest(auc, 1 - auc) >= 0.75 THEN 'strong' WHEN greatest(auc, 1 - auc) < 0.6 THEN 'weak' ELSE 'moderate' END AS band FROM a""",
)
def direction_free_strength(t):
    return anomaly.strength(game_score_auc(t))


@query(
    "strength_bands", "A14", "band:s n_players:l",
    f"""{P}, g AS (SELECT player, game_id, sum(think_time) AS s, game_id % 3 = 0 AS altered FROM pool GROUP BY player, game_id),
    a AS ({auc_sql('player', 'g', 's')}), b AS (SELECT CASE WHEN greatest(auc, 1 - auc) >= 0.75 THEN 'strong' WHEN greatest(auc, 1 - auc) < 0.6 THEN 'weak' ELSE 'moderate' END AS band FROM a)
    SELECT band, count(*) AS n_players FROM b GROUP BY band""",
)
def strength_bands(t):
    return anomaly.strength_counts(direction_free_strength(t))


@query(
    "detector_wins", "A14", "n:l wins:l mean_first:d mean_second:d",
    f"""{P}, g AS (SELECT player, game_id, sum(think_time) AS s, max(think_time) AS m, game_id % 3 = 0 AS altered FROM pool GROUP BY player, game_id),
    a AS ({auc_sql('player', 'g', 's')}), b AS ({auc_sql('player', 'g', 'm')})
    SELECT count(*) AS n, count(*) FILTER (WHERE a.auc > b.auc) AS wins, avg(a.auc) AS mean_first, avg(b.auc) AS mean_second FROM a JOIN b ON a.player = b.player""",
)
def detector_wins(t):
    from pacelens.functions.stats import auc

    g = pool(t).groupBy("player", "game_id").agg(F.sum("think_time").alias("s"), F.max("think_time").alias("m")).withColumn("altered", F.col("game_id") % 3 == 0)
    both = auc(g, ["player"], "altered", "s", "first").join(auc(g, ["player"], "altered", "m", "second"), "player")
    return anomaly.wins(both, "first", "second")


@query("roster_evaluation", "A1 A2 A3 A5 A6 A7", f"{SCENARIO_KINDS} score:s auc:d")
def roster_evaluation(t):
    return anomaly.roster(merged(t))


def merged(t):
    """The stand-in's orders are short, so forty neighbouring ones make one game."""
    return pool(t).withColumns({"ply": F.col("game_id") % 40 * 50 + F.col("ply"), "game_id": F.floor(F.col("game_id") / 40)})


def merged_sql(gaps: int) -> str:
    """RANKED over merged games of ten plies and ``gaps`` known gaps at least."""
    pools = f"""WITH {PLIES_SQL}, short AS (SELECT * REPLACE (player % 10 AS player, game_id // 40 AS game_id, game_id % 40 * 50 + ply AS ply) FROM plies WHERE NOT is_suspect),
    pool AS (SELECT s.* FROM short s SEMI JOIN (SELECT player, game_id FROM short GROUP BY player, game_id HAVING count(*) >= 10 AND count(gap_1_2) >= {gaps}) g ON g.player = s.player AND g.game_id = s.game_id)"""
    return RANKED.replace(P, pools)


ATTACK_SQL = f"""{merged_sql(3)}, hit AS {altered_sql('ranked', 'by_gap <= 3', "'smart'", ', think_time AS own_time, maia_surprise AS own_surprise')},
{ALTERNATE}, v AS (SELECT player, game_id, pred_log_think_time, own_time, own_surprise, think_time, maia_surprise,
    CASE WHEN alternate_move IS NULL THEN maia_surprise ELSE -ln(greatest(coalesce(prob, 1e-6), 1e-6)) END AS lesser
  FROM a LEFT JOIN pol ON f = 'e' || CAST(CAST(eval_before AS INT) AS VARCHAR) AND bin = 1100 + 100 * (game_id % 9) AND move = alternate_move),
three AS (SELECT player, game_id, pred_log_think_time, 'clean' AS attack, own_time AS think_time, own_surprise AS maia_surprise FROM v
  UNION ALL SELECT player, game_id, pred_log_think_time, 'best_move', think_time, maia_surprise FROM v
  UNION ALL SELECT player, game_id, pred_log_think_time, 'alternate_move', think_time, lesser FROM v),
attacked AS (SELECT player, game_id, attack, {FEATURE_SQL} FROM three GROUP BY player, game_id, attack)"""


def attacked(t):
    from pacelens.plans.catalog.annotate import standin_policy

    return anomaly.attack_features(moves_array(merged(t)), standin_policy(t), top_k=3, draw=draw)


@query("attack_features", "A4 A9", "player:l game_id:l attack:s " + " ".join(f"{c}:d" for c in anomaly.SELECTIVE_FEATURES), f"{ATTACK_SQL} SELECT * FROM attacked")
def attack_features(t):
    return attacked(t)


ATTACK_SCORES = ("resid_max", "surprise_max")
ATTACK_AUC_SQL = " UNION ALL ".join(f"(SELECT '{c}' AS score, * FROM ({auc_sql('player, attack', 'pairs', c)}))" for c in ATTACK_SCORES)


@query(
    "attack_auc", "A4 A7", "player:l attack:s score:s auc:d",
    f"""{ATTACK_SQL}, snap AS (SELECT player, game_id, attack, {', '.join(f'round({c}, 9) AS {c}' for c in ATTACK_SCORES)} FROM attacked),
    pairs AS (SELECT *, true AS altered FROM snap WHERE attack <> 'clean' UNION ALL SELECT s.* REPLACE (n.attack AS attack), false FROM snap s, (VALUES ('best_move'), ('alternate_move')) n(attack) WHERE s.attack = 'clean')
    {ATTACK_AUC_SQL}""",
)
def attack_auc(t):
    """How well two plain extremes tell altered games, by the kind of attack."""
    from pacelens.functions.stats import auc

    scores = attacked(t).withColumns({c: F.round(c, 9) for c in ATTACK_SCORES})
    long = anomaly.against_attacks(scores).unpivot(["player", "attack", "altered"], list(ATTACK_SCORES), "score", "value")
    return auc(long, ["player", "attack", "score"], "altered", "value")


@query("attack_detectors", "A4 A10", "player:l n_games:l auc_best_move:d auc_alternate_move:d")
def attack_detectors(t):
    """Detectors trained against each attack, on the same games and folds."""
    return anomaly.attack_detectors(attacked(t))


CURVE_SQL = f"""{merged_sql(0)}, sc AS (SELECT * FROM (VALUES ('clean', 0.0::DOUBLE, NULL), ('smart', 1.0::DOUBLE, NULL), ('smart', NULL, 1)) v(mode, rate, k)),
fan AS (SELECT ranked.* EXCLUDE (mode), sc.mode, rate, k FROM ranked, sc),
alt AS {altered_sql('fan', f"(rate IS NOT NULL AND by_draw <= {share_sql('rate')}) OR (k IS NOT NULL AND by_gap <= k)", 'mode', ', mode, rate, k')},
judged AS (SELECT player, game_id, mode, rate, k, -avg({RESID}) - avg(maia_surprise) AS combined, max(-({RESID})) AS timing_max, count(gap_1_2) AS gaps FROM alt GROUP BY ALL),
told AS (SELECT 'flat' AS curve, player, game_id, mode <> 'clean' AS altered, round(combined, 9) AS score FROM judged WHERE rate IS NOT NULL AND combined IS NOT NULL
  UNION ALL SELECT 'selective', player, game_id, mode <> 'clean', round(timing_max, 9) FROM judged WHERE (mode = 'clean' OR k IS NOT NULL) AND timing_max IS NOT NULL AND gaps >= 1),
curved AS (SELECT * FROM told WHERE player IN (SELECT player FROM told WHERE curve = 'flat' AND NOT altered GROUP BY player HAVING count(*) >= 10))"""


def curved(t):
    return anomaly.curve_scores(merged(t), draw=draw).withColumn("score", F.round("score", 9))


@query("scenario_curve_scores", "A5 A6 A13", "curve:s player:l game_id:l altered:b score:d", f"{CURVE_SQL} SELECT * FROM curved")
def scenario_curve_scores(t):
    return curved(t)


@query(
    "scenario_curves", "A13 A14", "curve:s n_games:l q25:e median:e q75:e min:e max:e n:l",
    f"""{CURVE_SQL}, l AS (SELECT curve, player, altered, list(score ORDER BY game_id) AS s FROM curved GROUP BY curve, player, altered),
    z AS (SELECT l.*, n, b FROM l, (VALUES (1), (3), (5), (10), (20)) v(n), range(400) r(b) WHERE len(s) >= n),
    d AS (SELECT curve, player, altered, n, b, s, unnest(range(1, n + 1)) AS j FROM z),
    e AS (SELECT curve, player, altered, n AS n_games, b, sum(s[1 + CAST(floor({PICK_SQL} * len(s) / 4294967296.0::DOUBLE) AS BIGINT)]) / n AS evidence FROM d GROUP BY curve, player, altered, n, b),
    a AS (SELECT * FROM ({auc_sql('curve, player, n_games', 'e', 'evidence')}) WHERE auc IS NOT NULL) SELECT curve, n_games, {QUARTS} FROM a GROUP BY curve, n_games""",
)
def scenario_curves(t):
    """Separation by the number of games whose evidence is added up, from real scenario scores."""
    return anomaly.multi_game_curves(curved(t), pick=pick)


WIN = "1 / (1 + exp(-0.004 * {}))"
SEQ_SQL = f"""{P}, r AS (SELECT player, game_id, ply, coalesce(think_time, 0) AS emt, n_moves_within_30cp AS n, (ply * 3 + 2) % 4 + 1 AS rk0,
    list_value(eval_before, eval_before - maia_surprise * 20, eval_before - maia_surprise * 20 - 40, eval_before - maia_surprise * 20 - 90)[1:n_moves_within_30cp] AS cps,
    CASE WHEN opp_think_time_prev IS NOT NULL THEN eval_before - cp_loss END AS eval_after FROM pool),
h AS (SELECT *, row_number() OVER (PARTITION BY player, game_id ORDER BY ply) - 1 AS seq, CASE WHEN rk0 <= n THEN rk0 END AS rk,
    {WIN.format('cps[1]')} AS best, coalesce({WIN.format('eval_after')}, 0.5) AS adv FROM r),
w AS (SELECT *, avg(emt) OVER (PARTITION BY player, game_id) AS ea, greatest(0, best - adv) AS wcl FROM h WHERE seq < 60),
x AS (SELECT *, avg(wcl) OVER (PARTITION BY player, game_id) AS wa FROM w)
SELECT player, game_id, ply, seq, least(15, coalesce(rk - 1, CASE WHEN n <= 1 THEN 10 ELSE least(15, n + 2) END), n) + 1 AS rank,
  len(list_filter(cps, lambda c: abs(best - {WIN.format('c')}) < 0.05)) + 1 AS ambiguity, adv AS advantage,
  emt / (ea + 1e-8) AS emt_norm, abs(emt - ea) / (ea + 1e-8) AS emt_var,
  CASE WHEN rk = 1 THEN 0 WHEN rk > 1 THEN {WIN.format('cps[rk - 1]')} - adv ELSE {WIN.format('cps[n]')} - adv END AS to_next_best,
  CASE WHEN rk <= n - 1 THEN {WIN.format('cps[rk + 1]')} - adv ELSE 0 END AS to_next_worst,
  wcl AS win_loss, wcl - wa AS win_loss_dev, list_avg(list_transform(cps, lambda c: best - {WIN.format('c')})) AS win_loss_avg FROM x"""


def candidates(t):
    return pool(t).withColumns(
        {
            "top_cps": F.expr(
                "slice(array(eval_before, eval_before - maia_surprise * 20, eval_before - maia_surprise * 20 - 40, eval_before - maia_surprise * 20 - 90), 1, CAST(n_moves_within_30cp AS INT))"
            ),
            "top_moves": F.expr("slice(array('m1', 'm2', 'm3', 'm4'), 1, CAST(n_moves_within_30cp AS INT))"),
            "move_uci": F.concat(F.lit("m"), ((F.col("ply") * 3 + 2) % 4 + 1).cast("string")),
            "eval_after": F.when(F.col("opp_think_time_prev").isNotNull(), F.col("eval_before") - F.col("cp_loss")),
        }
    )


@query("move_sequence_features", "A15", "player:l game_id:l ply:l seq:l rank:l ambiguity:l " + " ".join(f"{c}:d" for c in anomaly.SEQUENCE_FEATURES[2:]), SEQ_SQL)
def move_sequence_features(t):
    return anomaly.sequence_rows(candidates(t))


@query(
    "padded_sequences", "A15", "player:l game_id:l true_length:l padded_length:l rank_total:d",
    f"SELECT player, game_id, count(*) AS true_length, 60 AS padded_length, sum(rank) AS rank_total FROM ({SEQ_SQL}) GROUP BY 1, 2",
)
def padded_sequences(t):
    s = anomaly.sequences(anomaly.sequence_rows(candidates(t)))
    return s.withColumns(
        {"padded_length": F.size("matrix"), "rank_total": F.aggregate("matrix", F.lit(0.0), lambda a, r: a + r[0])}
    )
