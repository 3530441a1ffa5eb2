"""Identification queries: class scores and vectors from the embeddings and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.functions.draws import mix
from pacelens.operators import games, ident, narrate
from pacelens.plans.catalog import query
from pacelens.plans.catalog.games import corr_sql
from pacelens.sources.standins import PLIES_SQL

SCORES_SQL = """raw AS (SELECT label AS player, vec_id AS game_id, c AS class,
    exp(4 * list_sum(list_transform(list_filter(range(len(embedding)), lambda i: i % 10 = c), lambda i: CAST(embedding[i + 1] AS DOUBLE))) + CASE WHEN label = c THEN 0.3 ELSE 0 END) AS e FROM embeddings, range(10) r(c)),
scores AS (SELECT player, game_id, class, e / sum(e) OVER (PARTITION BY game_id) AS p FROM raw)"""
PRED_SQL = """pred AS (SELECT player, game_id, arg_min(class, (-p, class)) AS predicted, max(p) AS confidence,
    arg_min(class, (-p, class)) = player AS correct FROM scores GROUP BY player, game_id)"""
S = f"WITH {SCORES_SQL}"
SP = f"{S}, {PRED_SQL}"


def mix_sql(c: str, seed: int = 0) -> str:
    return f"((({c}) % 2147483648) * 2654435761 + {seed}) % 4294967296"


def scores(t):
    """Softmax scores over ten classes, each from the vector's components of one remainder."""
    places = F.sequence(F.lit(0), F.size("embedding") - 1)
    share = lambda c: F.aggregate(F.filter(places, lambda i: i % 10 == c), F.lit(0.0), lambda a, i: a + F.element_at("embedding", i + 1).cast("double"))
    weight = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda c: F.exp(4 * share(c) + F.when(F.col("label") == c, 0.3).otherwise(0.0)),
    )
    raw = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"), weight.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    return raw.select("player", "game_id", F.col("player").cast("int").alias("label"), F.transform("w", lambda w: w / total).alias("p"))


def judged(t):
    return ident.predictions(scores(t))


@query("class_scores", "D6", "player:l game_id:l class:l p:d", f"{S} SELECT * FROM scores")
def class_scores(t):
    return ident.unpacked(scores(t))


@query("game_predictions", "D6 D18", "player:l game_id:l predicted:l confidence:d correct:b", f"{SP} SELECT * FROM pred")
def game_predictions(t):
    return judged(t)


COHORT = """SELECT c_nationkey AS player, o_orderkey AS game_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"""


@query("cohort_games", "D1", "player:l game_id:l", COHORT)
def cohort_games(t):
    members = t.customer.select(
        F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").alias("identity"), F.col("c_custkey").alias("source_player")
    )
    return ident.cohort(t.orders.select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game_id")), members, "BUILDING")


@query(
    "stratified_folds", "D2", "player:l game_id:l fold:l",
    f"SELECT label AS player, vec_id AS game_id, (row_number() OVER (PARTITION BY label ORDER BY {mix_sql('vec_id', 5)}, vec_id) - 1) % 5 AS fold FROM embeddings",
)
def stratified_folds(t):
    v = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"))
    return ident.stratified_folds(v, 5, order=mix("game_id", 5))


@query(
    "chronological_holdout", "D3", "player:l game_id:l is_test:b",
    """SELECT o_custkey AS player, o_orderkey AS game_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
      > floor(count(*) OVER (PARTITION BY o_custkey) * (1 - 0.2::DOUBLE)) AS is_test FROM orders""",
)
def chronological_holdout(t):
    v = t.orders.select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("game_datetime"))
    return ident.chronological_holdout(v)


GAMES_SQL = f"""{PLIES_SQL}, pool AS (SELECT * REPLACE (player % 10 AS player) FROM plies),
games AS (SELECT player, game_id, count(*) AS n_plies, avg(think_time) AS think_time_mean, coalesce(stddev_samp(think_time), 0) AS think_time_std,
    avg(cp_loss) AS cp_loss_mean, game_id * 7 % 23 AS session_game_index, game_id % 3 - 1 AS prev_game_result,
    game_id % 4 = 0 OR count(*) > 6 AS correct, (player + game_id) % 10 AS predicted FROM pool GROUP BY player, game_id)"""
G = f"WITH {GAMES_SQL}"
MEASURES = ("n_plies", "think_time_mean", "think_time_std", "cp_loss_mean", "session_game_index")


def game_rows(t):
    pool = t.plies().withColumn("player", F.col("player") % 10)
    rows = pool.groupBy("player", "game_id").agg(F.count(F.lit(1)).alias("n_plies"), *games.spread(("think_time", "cp_loss")))
    return rows.withColumns(
        {
            "session_game_index": F.col("game_id") * 7 % 23,
            "prev_game_result": F.col("game_id") % 3 - 1,
            "correct": (F.col("game_id") % 4 == 0) | (F.col("n_plies") > 6),
            "predicted": (F.col("player") + F.col("game_id")) % 10,
        }
    )


@query(
    "standardised_vectors", "D4", "player:l game_id:l " + " ".join(f"{c}:d" for c in MEASURES),
    f"{G}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES) + " FROM games) SELECT player, game_id, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in MEASURES) + " FROM games, m",
)
def standardised_vectors(t):
    return ident.standardise(game_rows(t).select("player", "game_id", *MEASURES), MEASURES)


@query(
    "class_weights", "D5", "player:l n_games:l weight:d",
    "SELECT label AS player, count(*) AS n_games, sum(count(*)) OVER () / count(*) AS weight FROM embeddings GROUP BY label",
)
def class_weights(t):
    return ident.class_weights(t.embeddings.select(F.col("label").alias("player")))


def vectors(t):
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    v = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"), *parts)
    return v, [f"e{i}" for i in range(64)]


@query("identification_families", "D4 D5 D6 D7", "family:s n_games_total:l n_classes:l overall_accuracy:d balanced_accuracy:d")
def identification_families(t):
    v, columns = vectors(t)
    held = ident.out_of_fold(ident.stratified_folds(v, 5), columns, ("logistic", "forest"), compact=True)
    return ident.accuracy(ident.predictions(held, ("family", *ident.GAME)), ("family",))


@query("identification_chronological", "D3 D6 D8", "k:l overall_accuracy:d balanced_accuracy:d")
def identification_chronological(t):
    v, columns = vectors(t)
    return ident.rank_k(ident.evaluate(v.withColumn("game_datetime", F.col("game_id")), columns, split="chronological", families=("logistic",)))


@query("same_band_identification", "D22", "n_games_total:l n_classes:l overall_accuracy:d balanced_accuracy:d chance_baseline:d")
def same_band_identification(t):
    v, columns = vectors(t)
    ratings = v.select("player").distinct().withColumn("rating", 1000.0 + F.col("player") * 100)
    band = ident.rating_band(v, ratings, 1200, 1700)
    return ident.accuracy(ident.predictions(ident.evaluate(band, columns, k=3, families=("logistic",))))


@query("two_class_boosting", "D6 D15", "family:s overall_accuracy:d balanced_accuracy:d")
def two_class_boosting(t):
    v, columns = vectors(t)
    held = ident.out_of_fold(ident.stratified_folds(v, 2), columns, ("logistic", "boosting"), compact=True)
    return ident.accuracy(ident.predictions(held, ("family", *ident.GAME)), ("family",))


def separable(t, players: int):
    """Games whose player shows in one column: every family must tell all of them apart, whatever the folds."""
    columns = [f"f{j}" for j in range(players)]
    own, other = (1 + F.col("o_orderkey") * 7919 % 13 / 16.0), lambda j: F.col("o_orderkey") * (j + 3) % 11 / 16.0
    marks = [F.when(F.col("o_custkey") % players == j, own).otherwise(other(j)).alias(f"f{j}") for j in range(players)]
    return t.orders.select((F.col("o_custkey") % players).alias("player"), F.col("o_orderkey").alias("game_id"), *marks), columns


@query(
    "separable_families", "D6 D7", "family:s n_games_total:l n_classes:l overall_accuracy:d balanced_accuracy:d",
    """SELECT family, count(*) AS n_games_total, count(DISTINCT o_custkey % 12) AS n_classes, 1.0 AS overall_accuracy, 1.0 AS balanced_accuracy
    FROM orders, (VALUES ('logistic'), ('forest'), ('boosting')) v(family) GROUP BY family""",
)
def separable_families(t):
    v, columns = separable(t, 12)
    held = ident.out_of_fold(ident.stratified_folds(v, 3), columns, ident.FAMILIES, compact=True)
    return ident.accuracy(ident.predictions(held, ("family", *ident.GAME)), ("family",))


@query(
    "separable_pairs", "D21", "a:l b:l n_games:l balanced_accuracy:d family:s logistic:d forest:d boosting:d",
    """WITH p AS (SELECT o_custkey % 6 AS player, count(*) AS n FROM orders GROUP BY 1)
    SELECT x.player AS a, y.player AS b, x.n + y.n AS n_games, 1.0 AS balanced_accuracy, 'boosting' AS family, 1.0 AS logistic, 1.0 AS forest, 1.0 AS boosting
    FROM p x JOIN p y ON x.player < y.player""",
)
def separable_pairs(t):
    v, columns = separable(t, 6)
    return ident.pairwise(v, columns)


@query("pairwise_best_summary", "D21", "n_pairs:l min:d max:d mean:d median:d q25:d q75:d")
def pairwise_best_summary(t):
    v, columns = vectors(t)
    return ident.pairwise_summary(ident.pairwise(v, columns))


@query(
    "class_recall", "D7", "player:l n_games:l recall:d",
    f"{SP} SELECT player, count(*) AS n_games, avg(correct::INT) AS recall FROM pred GROUP BY player",
)
def class_recall(t):
    return ident.recall(judged(t))


@query(
    "accuracy_summary", "D7", "n_games_total:l n_classes:l overall_accuracy:d balanced_accuracy:d majority_baseline:d chance_baseline:d",
    f"""{SP}, r AS (SELECT player, count(*) AS n, avg(correct::INT) AS recall FROM pred GROUP BY player)
    SELECT sum(n) AS n_games_total, count(*) AS n_classes, sum(n * recall) / sum(n) AS overall_accuracy, avg(recall) AS balanced_accuracy,
      max(n) / sum(n) AS majority_baseline, 1.0 / count(*) AS chance_baseline FROM r""",
)
def accuracy_summary(t):
    return ident.accuracy(judged(t))


@query(
    "rank_k_curve", "D8", "k:l overall_accuracy:d balanced_accuracy:d",
    f"""{S}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY p DESC, class) AS rk FROM scores),
    h AS (SELECT player, rk FROM r WHERE class = player), p AS (SELECT k, player, avg((rk <= k)::INT) AS a, count(*) AS n FROM h, (VALUES (1), (3), (5), (10)) v(k) GROUP BY 1, 2)
    SELECT k, sum(a * n) / sum(n) AS overall_accuracy, avg(a) AS balanced_accuracy FROM p GROUP BY k""",
)
def rank_k_curve(t):
    return ident.rank_k(scores(t))


def fusion_sql(weight: str) -> str:
    return f"""{S}, g AS (SELECT player, game_id, max(p) AS w, row_number() OVER (PARTITION BY player ORDER BY {mix_sql('game_id', 3)}, game_id) AS rn,
      count(*) OVER (PARTITION BY player) AS n FROM scores GROUP BY player, game_id),
    d AS (SELECT g.*, k, (rn - 1) // k AS grp FROM g, (VALUES (1), (3), (5), (10), (20), (50)) v(k) WHERE ((rn - 1) // k + 1) * k <= n),
    f AS (SELECT d.player, k, grp, class, sum(p * {weight}) / sum({weight}) AS fp FROM d JOIN scores s ON s.player = d.player AND s.game_id = d.game_id GROUP BY 1, 2, 3, 4),
    b AS (SELECT player, k, grp, arg_min(class, (-fp, class)) = player AS hit FROM f GROUP BY 1, 2, 3),
    p AS (SELECT player, k, count(*) AS n, sum(hit::INT) AS h FROM b GROUP BY 1, 2),
    c AS (SELECT k, sum(h) / sum(n) AS overall_accuracy, avg(h / n) AS balanced_accuracy, count(*) AS covered FROM p GROUP BY k)
    SELECT v.k AS n_games, overall_accuracy, balanced_accuracy, coalesce(covered, 0) AS n_players_covered, (SELECT count(DISTINCT player) FROM scores) AS n_players_total
    FROM (VALUES (1), (3), (5), (10), (20), (50)) v(k) LEFT JOIN c ON c.k = v.k"""


CURVE = "n_games:l overall_accuracy:d balanced_accuracy:d n_players_covered:l n_players_total:l"


@query("fusion_curve", "D9", CURVE, fusion_sql("1"))
def fusion_curve(t):
    return ident.fuse(scores(t), order=mix("game_id", 3))


@query("fusion_curve_confidence", "D10", CURVE, fusion_sql("w"))
def fusion_curve_confidence(t):
    return ident.fuse(scores(t), weighting="confidence", order=mix("game_id", 3))


@query(
    "fusion_curve_selected", "D11", CURVE,
    f"""{S}, g AS (SELECT DISTINCT player, game_id, game_id * 7 % 23 AS key FROM scores),
    r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY key DESC, game_id) AS rn, count(*) OVER (PARTITION BY player) AS n FROM g),
    d AS (SELECT r.*, k FROM r, (VALUES (1), (3), (5), (10), (20), (50)) v(k) WHERE rn <= k AND k <= n),
    f AS (SELECT d.player, k, class, avg(p) AS fp FROM d JOIN scores s ON s.player = d.player AND s.game_id = d.game_id GROUP BY 1, 2, 3),
    b AS (SELECT player, k, arg_min(class, (-fp, class)) = player AS hit FROM f GROUP BY 1, 2),
    c AS (SELECT k, avg(hit::INT) AS a, count(*) AS covered FROM b GROUP BY k)
    SELECT v.k AS n_games, a AS overall_accuracy, a AS balanced_accuracy, coalesce(covered, 0) AS n_players_covered, (SELECT count(DISTINCT player) FROM scores) AS n_players_total
    FROM (VALUES (1), (3), (5), (10), (20), (50)) v(k) LEFT JOIN c ON c.k = v.k""",
)
def fusion_curve_selected(t):
    keyed = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"), (F.col("vec_id") * 7 % 23).alias("key"))
    return ident.fuse_selected(scores(t), keyed, "key")


SIGNALS = ("session_game_index", "prev_game_result", "n_plies", "think_time_std")


@query(
    "correctness_signals", "D12", "signal:s within_player_corr_with_correctness:d n_games:l",
    f"{G} " + " UNION ALL ".join(
        f"""SELECT '{s}' AS signal, {corr_sql("z", "hit")} AS within_player_corr_with_correctness, count(*) AS n_games FROM (
          SELECT ({s} - avg({s}) OVER (PARTITION BY player)) / nullif(stddev_samp({s}) OVER (PARTITION BY player), 0) AS z, correct::INT AS hit FROM games) WHERE z IS NOT NULL""" for s in SIGNALS),
)
def correctness_signals(t):
    return ident.correctness_signals(game_rows(t))


@query(
    "tilt_buckets", "D13", "bucket:s accuracy:d n_games:l",
    f"""{G} SELECT CASE WHEN prev_game_result < 0 THEN 'lost previous game' WHEN prev_game_result = 0 THEN 'drew / first game of session' ELSE 'won previous game' END AS bucket,
      avg(correct::INT) AS accuracy, count(*) AS n_games FROM games GROUP BY 1 HAVING count(*) >= 30""",
)
def tilt_buckets(t):
    return ident.tilt_buckets(game_rows(t))


@query(
    "session_buckets", "D13", "bucket:l accuracy:d n_games:l",
    f"""{G}, q AS (SELECT quantile_cont(session_game_index, 1 / 3::DOUBLE) AS a, quantile_cont(session_game_index, 2 / 3::DOUBLE) AS b FROM games)
    SELECT 1 + (session_game_index > a)::INT + (session_game_index > b)::INT AS bucket, avg(correct::INT) AS accuracy, count(*) AS n_games FROM games, q GROUP BY 1 HAVING count(*) >= 30""",
)
def session_buckets(t):
    return ident.session_buckets(game_rows(t))


CELLS = "SELECT player, predicted, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY player) AS share FROM {} GROUP BY 1, 2"


@query("confusion_full", "D14", "player:l predicted:l n:l share:d", f"{SP} {CELLS.format('pred')}")
def confusion_full(t):
    return ident.confusion(judged(t))


@query(
    "confusion_top", "D14", "player:l predicted:l n:l share:d",
    f"""WITH p AS (SELECT o_custkey % 40 AS player, o_orderkey * 3 % 40 AS predicted FROM orders), c AS ({CELLS.format('p')})
    SELECT * FROM c QUALIFY player = predicted OR row_number() OVER (PARTITION BY player, player = predicted ORDER BY n DESC, predicted) <= 8""",
)
def confusion_top(t):
    p = t.orders.select((F.col("o_custkey") % 40).alias("player"), (F.col("o_orderkey") * 3 % 40).alias("predicted"))
    return ident.confusion(p)


FEATURES = ("n_plies", "think_time_mean", "think_time_std", "cp_loss_mean", "session_game_index", "prev_game_result")


def weights(t):
    """Stand-in weights per class and feature, one class per embedding label."""
    classes = t.embeddings.select(F.col("label").cast("bigint").alias("class")).distinct()
    pairs = classes.select("class", F.explode(F.array([F.lit(f) for f in FEATURES])).alias("feature"))
    return pairs.withColumn("weight", ((F.col("class") * 7 + F.length("feature") * 3) % 11 - 5) / 4.0)


WEIGHTS_SQL = f"""weights AS (SELECT class, feature, ((class * 7 + length(feature) * 3) % 11 - 5) / 4.0 AS weight
  FROM (SELECT DISTINCT label AS class FROM embeddings), (SELECT unnest({list(FEATURES)}) AS feature))"""


@query(
    "coefficient_summary", "D15", "feature:s coef:d coef_is_signed:b",
    f"WITH {WEIGHTS_SQL} SELECT feature, avg(abs(weight)) AS coef, false AS coef_is_signed FROM weights GROUP BY feature",
)
def coefficient_summary(t):
    return ident.coefficient_summary(weights(t))


@query("fitted_coefficients", "D15", "feature:s coef:d coef_is_signed:b")
def fitted_coefficients(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v, columns = vectors(t)
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(v.withColumn("y", F.col("player").cast("double")))
    model = LogisticRegression(family="multinomial", featuresCol="x", labelCol="y", regParam=0.01, maxIter=1000).fit(ready)
    if model.summary.totalIterations >= model.getMaxIter():
        raise RuntimeError("the coefficients did not converge")
    return ident.coefficient_summary(ident.coefficient_rows(model, columns, list(range(model.numClasses)), t.spark))


@query(
    "display_sample", "D16", "player:l game_id:l",
    f"SELECT label AS player, vec_id AS game_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {mix_sql('vec_id', 9)}, vec_id) <= 4",
)
def display_sample(t):
    return ident.display_sample(t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id")), order=mix("game_id", 9))


REASONS_SQL = f"""{GAMES_SQL}, {WEIGHTS_SQL}, l AS (""" + " UNION ALL ".join(
    f"""SELECT player, game_id, predicted AS class, '{f}' AS feature, {f}::DOUBLE AS value, avg({f}) OVER () AS pool_mean, stddev_pop({f}) OVER () AS pool_std FROM games""" for f in FEATURES
) + """), r AS (SELECT l.*, weight * (value - pool_mean) / pool_std AS contribution FROM l JOIN weights w ON w.class = l.class AND w.feature = l.feature),
reasons AS (SELECT *, row_number() OVER (PARTITION BY player, game_id ORDER BY round(abs(contribution), 9) DESC, feature) AS rank FROM r QUALIFY rank <= 5)"""


@query(
    "prediction_reasons", "D17", "player:l game_id:l class:l rank:l feature:s contribution:d value:d pool_mean:d pool_std:d",
    f"WITH {REASONS_SQL} SELECT * FROM reasons",
)
def prediction_reasons(t):
    rows = game_rows(t)
    return ident.reasons(rows.drop("predicted"), rows, weights(t), FEATURES)


@query(
    "stored_scores", "D18", "player:l game_id:l class:l p:d rank:l",
    f"{S}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY p DESC, class) AS rank FROM scores) SELECT * FROM r WHERE rank <= 5 OR class = player",
)
def stored_scores(t):
    return ident.stored_scores(scores(t))


NARRATED_SQL = f"""{PLIES_SQL}, two AS (SELECT *, ply % 2 = game_id % 2 AS is_own, clock_before / base_s AS frac FROM plies),
m AS (SELECT *, avg(think_time) FILTER (WHERE is_own) OVER g AS mean, stddev_pop(think_time) FILTER (WHERE is_own) OVER g AS sd FROM two WINDOW g AS (PARTITION BY player, game_id)),
z AS (SELECT *, CASE WHEN is_own AND sd > 0 THEN (think_time - mean) / sd ELSE 0 END AS think_z FROM m),
moments AS (SELECT *, CASE WHEN is_own AND is_mistake THEN 'mistake' WHEN is_own AND think_z > 1.5 THEN 'long_think' END AS key_moment FROM z),
nx AS (SELECT *, lead(ply) OVER o AS nply, lead(think_time) OVER o AS nthink FROM moments WHERE is_own WINDOW o AS (PARTITION BY player, game_id ORDER BY ply)),
links AS (SELECT player, game_id, arg_max(ply, (abs(nthink - mean), -ply)) FILTER (WHERE is_mistake AND nthink IS NOT NULL) AS linked_mistake_ply,
    arg_max(nply, (abs(nthink - mean), -ply)) FILTER (WHERE is_mistake AND nthink IS NOT NULL) AS linked_move_ply,
    arg_max(nthink - mean, (abs(nthink - mean), -ply)) FILTER (WHERE is_mistake AND nthink IS NOT NULL) AS linked_delta,
    arg_min(ply, (frac, ply)) AS lowest_clock_ply FROM nx GROUP BY player, game_id)"""


def two_sided(t):
    return t.plies().withColumns({"is_own": F.col("ply") % 2 == F.col("game_id") % 2, "clock_frac_remaining": F.col("clock_before") / F.col("base_s")})


def told_games(t):
    return t.orders.select(
        F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game_id"), F.lit(0).alias("predicted"),
        F.lit(0.5).alias("confidence"), (F.col("o_orderkey") % 2 == 0).alias("correct"),
    )


NARRATED = (
    "player:l game_id:l ply:l move_number:l is_white:b key_moment:s key_context:s key_amount:d think_z:d correct:b linked_mistake_ply:l linked_move_ply:l linked_delta:d lowest_clock_ply:l",
    f"""WITH {NARRATED_SQL} SELECT m.player, m.game_id, ply, ply // 2 + 1 AS move_number, ply % 2 = 0 AS is_white, key_moment,
      CASE WHEN key_moment = 'long_think' THEN CASE WHEN gap_1_2 < 30 THEN 'close choices' WHEN n_captures_available >= 3 THEN 'many captures' ELSE 'none' END END AS key_context,
      CASE key_moment WHEN 'mistake' THEN floor(cp_loss) WHEN 'long_think' THEN think_time END AS key_amount, think_z, m.game_id % 2 = 0 AS correct,
      linked_mistake_ply, linked_move_ply, linked_delta, lowest_clock_ply FROM moments m JOIN links l ON l.player = m.player AND l.game_id = m.game_id""",
)


@query("narrated_games", "D19", *NARRATED)
def narrated_games(t):
    return narrate.narrate(two_sided(t), told_games(t), n=None)


@query("narrated_both_sides", "D19", *NARRATED)
def narrated_both_sides(t):
    """The same games from the tracked side's plies alone, the opponent's filled in from the records."""
    own = two_sided(t).where("is_own").drop("is_own")
    return narrate.narrate(narrate.both_sides(own, t.plies(), ()), told_games(t), n=None)


@query(
    "confidence_trace", "D20",
    "player:l n_games:l game_id:l running_prob_correct:d top_guess:l top_guess_prob:d correct_so_far:b",
    f"""{SP}, r AS (SELECT player, count(*) AS n, avg(correct::INT) AS a FROM pred GROUP BY player),
    elig AS (SELECT * FROM r WHERE n >= 25 UNION ALL SELECT * FROM (SELECT * FROM r ORDER BY n DESC, player LIMIT 5) WHERE NOT EXISTS (SELECT 1 FROM r WHERE n >= 25)),
    who AS (SELECT arg_min(player, (abs(a - 0.25), player)) AS player FROM elig),
    run AS (SELECT s.player, class, game_id, avg(p) OVER o AS rp, row_number() OVER o AS n_games FROM scores s JOIN who USING (player) WINDOW o AS (PARTITION BY class ORDER BY game_id))
    SELECT player, n_games, game_id, max(rp) FILTER (WHERE class = player) AS running_prob_correct, arg_min(class, (-rp, class)) AS top_guess, max(rp) AS top_guess_prob,
      arg_min(class, (-rp, class)) = player AS correct_so_far FROM run GROUP BY player, n_games, game_id""",
)
def confidence_trace(t):
    order = t.embeddings.select(F.col("label").alias("player"), F.col("vec_id").alias("game_id"), F.col("vec_id").alias("game_date"))
    return ident.confidence_trace(scores(t), order)


@query("pairwise_identification", "D21", "a:l b:l n_games:l balanced_accuracy:d family:s logistic:d forest:d boosting:d")
def pairwise_identification(t):
    v, columns = vectors(t)
    return ident.pairwise(v, columns)


@query(
    "pairwise_summary", "D21", "n_pairs:l min:d max:d mean:d median:d q25:d q75:d",
    f"""{SP}, r AS (SELECT player, avg(correct::INT) AS v FROM pred GROUP BY player)
    SELECT count(*) AS n_pairs, min(v) AS min, max(v) AS max, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM r""",
)
def pairwise_summary(t):
    return ident.pairwise_summary(ident.recall(judged(t)).withColumnRenamed("recall", "balanced_accuracy"))


@query(
    "miss_destinations", "D23", "player:l predicted:l n:l n_misses:l share_of_misses:d",
    f"""{SP} SELECT player, predicted, count(*) AS n, sum(count(*)) OVER (PARTITION BY player) AS n_misses, count(*) / sum(count(*)) OVER (PARTITION BY player) AS share_of_misses
    FROM pred WHERE NOT correct GROUP BY 1, 2""",
)
def miss_destinations(t):
    return ident.misses(judged(t))


CYCLIC = "CASE feature WHEN 'n_plies' THEN 'hour_sin' WHEN 'cp_loss_mean' THEN 'hour_cos' WHEN 'prev_game_result' THEN 'dow_cos' ELSE feature END"


@query(
    "merged_reasons", "D24", "player:l game_id:l feature:s contribution:d value:d verdict:s",
    f"""WITH {REASONS_SQL}, c AS (SELECT * REPLACE ({CYCLIC} AS feature) FROM reasons),
    b AS (SELECT *, CASE WHEN feature IN ('hour_sin', 'hour_cos') THEN 'hour' WHEN feature = 'dow_cos' THEN 'dow' ELSE feature END AS base FROM c),
    m AS (SELECT player, game_id, base AS feature, sum(contribution) AS contribution, max(CASE WHEN base = feature THEN value END) AS value,
      max(CASE WHEN base = feature THEN (value - pool_mean) / pool_std END) AS z FROM b GROUP BY 1, 2, 3)
    SELECT player, game_id, feature, contribution, value, CASE WHEN z > 1.2 THEN 'much higher' WHEN z > 0.4 THEN 'somewhat higher' WHEN z < -1.2 THEN 'much lower'
      WHEN z < -0.4 THEN 'somewhat lower' WHEN z IS NOT NULL THEN 'close' END AS verdict FROM m""",
)
def merged_reasons(t):
    rows = prediction_reasons(t).withColumn("feature", F.expr(CYCLIC))
    merged = ident.merge_cyclic(rows)
    return merged.withColumn("verdict", ident.describe_value(F.col("value"), F.col("pool_mean"), F.col("pool_std")))
