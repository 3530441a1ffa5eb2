"""Per-player baselines: expected think time and expected loss.

Two routes.  ``fit_ridge`` fits every player of the pool in one job from
aggregated normal equations: each task adds up small matrices over its rows, so
only those matrices are shuffled and a hot player's rows never meet in one task.
``fit_trees`` is the boosted-tree counterpart on Spark ML for one data set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.draws import xx
from pacelens.functions.nulls import ratio
from pacelens.functions.ordered import hash_blocks, running, sized_slices
from pacelens.functions.stats import guarded_corr, join_per_key, qcut, quantiles

# Feature names, category codes and guards of the two models.
COMPLEXITY_FEATURES = (
    "gap_1_2", "outcome_changes", "mate_distance_gap", "top_n_spread", "n_moves_within_30cp",
    "n_moves_within_100cp", "abs_eval", "is_decided", "outcome_bucket", "is_recapture", "is_forced",
    "legal_moves", "total_material", "material_diff", "is_endgame", "n_pieces", "halfmove_clock",
    "game_phase", "open_files", "half_open_files", "blocked_pawns", "blocked_pawn_frac", "own_pinned",
    "opp_pinned", "own_passed_pawns", "opp_passed_pawns", "own_bishop_pair", "opp_bishop_pair",
    "own_doubled_pawns", "opp_doubled_pawns", "own_isolated_pawns", "opp_isolated_pawns",
    "own_pawn_islands", "opp_pawn_islands", "own_forking_pieces", "opp_forking_pieces", "own_skewers",
    "opp_skewers", "n_discovered_check_moves", "n_double_check_moves", "opposite_side_castling",
    "move_value_entropy", "in_book", "plies_since_book", "search_stable_depth", "n_best_move_changes",
    "eval_swing_across_depth", "n_checks_available", "n_captures_available", "n_promotions_available",
    "in_check", "loose_own", "loose_opp", "king_attackers_own", "king_attackers_opp",
    "has_castled_rights", "pawn_count", "eval_delta_1", "eval_roll_std_3", "recently_volatile",
    "maia_prob_played", "maia_top1_prob", "maia_is_top_choice", "maia_surprise", "maia_prob_best_move",
    "requires_overriding_instinct", "material_offered",
)
CLOCK_FEATURES = (
    "clock_frac_remaining", "clock_diff", "behind_on_clock", "low_time", "game_progress",
    "opp_think_time_prev", "session_game_index", "minutes_since_prev_game",
)
CATEGORY_VALUES = {
    "outcome_bucket": ("mate_for", "winning", "balanced", "losing", "mate_against"),
    "game_phase": ("opening", "middlegame", "endgame"),
}
MIN_ROWS = 500
LIVE_WINDOW_DAYS = 270
TEST_SHARE = 0.15

HELD_BYTES = 64_000_000  #: matrices a task holds before it sends partial sums


def model_rows(features: DataFrame, needed: Sequence[str] = ("think_time", "log_think_time", "player_rating")) -> DataFrame:
    """Rows a model may use: not suspect and with every needed column."""
    return features.where(~F.col("is_suspect")).na.drop(subset=list(needed))


def feature_names(df: DataFrame, target: str = "log_think_time") -> list[str]:
    """The model's features this table has; absent ones are skipped."""
    wanted = [*COMPLEXITY_FEATURES, *CLOCK_FEATURES, "player_rating"]
    if target == "cp_loss":
        wanted.append("log_think_time")
    return [c for c in wanted if c in df.columns]


def as_number(df: DataFrame, column: str) -> Column:
    """A feature as a double: category code, 0/1 for booleans, NULL for missing."""
    if column in CATEGORY_VALUES:
        code = F.lit(None).cast("double")
        for i, value in reversed(list(enumerate(CATEGORY_VALUES[column]))):
            code = F.when(F.col(column) == value, F.lit(float(i))).otherwise(code)
        return code
    return F.col(column).cast("double")


def design(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric design columns: value with 0 for missing, plus a missing indicator."""
    columns = {}
    for c in features:
        value = as_number(df, c)
        columns[f"x_{c}"] = F.coalesce(value, F.lit(0.0))
        columns[f"m_{c}"] = value.isNull().cast("double")
    return df.withColumns(columns)


def design_columns(features: Sequence[str], indicators: bool = True) -> list[str]:
    """Names ``design`` produces, in model order."""
    return [f"x_{c}" for c in features] + ([f"m_{c}" for c in features] if indicators else [])


def time_split(df: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Add ``is_test``: chronological holdout by game, one cutoff date per player.

    The cutoff is the date of the game at position floor((1 - share) * n), found
    from games per date, so a long history needs no sort of its games.
    """
    per_date = df.select("player", "game_id", "game_date").distinct().groupBy("player", "game_date").agg(
        F.count(F.lit(1)).alias("_games")
    )
    by_date = Window.partitionBy("player").orderBy(F.col("game_date").asc_nulls_last())
    upto = F.sum("_games").over(by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_games").over(Window.partitionBy("player"))
    cutoff = (
        per_date.withColumns({"_upto": upto, "_index": F.floor(total * F.lit(1 - test_share))})
        .where(F.col("_upto") > F.col("_index"))
        .groupBy("player")
        .agg(F.min("game_date").alias("cutoff_date"))
    )
    return df.join(cutoff, "player", "left").withColumn("is_test", F.col("game_date") >= F.col("cutoff_date"))


def live_window(df: DataFrame, days: int = LIVE_WINDOW_DAYS) -> DataFrame:
    """Rows of each player's trailing window before their last game."""
    last = df.groupBy("player").agg(F.max("game_date").alias("_last"))
    return df.join(last, "player").where(F.date_diff("_last", "game_date") <= days).drop("_last")


def eligibility(df: DataFrame, days: int = LIVE_WINDOW_DAYS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Which players get a live model: enough rows, and both sides of the split filled."""
    live = time_split(live_window(df, days)).groupBy("player").agg(
        F.count(F.lit(1)).alias("n_live"),
        F.count_if(~F.col("is_test")).alias("n_live_train"),
        F.count_if(F.col("is_test")).alias("n_live_test"),
    )
    full = df.groupBy("player").agg(F.count(F.lit(1)).alias("n_rows"))
    zero = F.lit(0).cast("bigint")
    counted = full.join(live, "player", "left").na.fill(0, ["n_live", "n_live_train", "n_live_test"])
    return counted.withColumn(
        "live_model",
        (F.col("n_live") >= min_rows) & (F.col("n_live_train") > zero) & (F.col("n_live_test") > zero),
    )


def _moment_schema(keys: T.StructType) -> T.StructType:
    return T.StructType([*keys.fields, T.StructField("moments", T.ArrayType(T.DoubleType()))])


def _add_moments(keys: list[str], columns: list[str], target: str, weight: str | None):
    most = max(1, HELD_BYTES // (8 * (len(columns) + 2) ** 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def sums() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=keys)
            out["moments"] = [m.ravel() for m in held.values()]
            held.clear()
            return out

        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                z = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float), rows[target].to_numpy(float)])
                w = rows[weight].to_numpy(float)[:, None] if weight else 1.0
                m = (z * w).T @ z
                held[key] = held[key] + m if key in held else m
                if len(held) >= most:  # partial sums of a key may come more than once; they are added up later
                    yield sums()
        if held:
            yield sums()

    return run


def _solve(penalty: float, keys: list[str], size: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(parts["moments"].to_list()), axis=0).reshape(size + 2, size + 2)
        n = total[0, 0]
        mean = total[0, 1:] / n
        cov = total[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov)[:size], 0, None))
        live = sd > 1e-9 * np.maximum(1.0, np.abs(mean[:size]))
        coef = np.zeros(size)
        if live.any():
            s = sd[live]
            corr = cov[:size, :size][np.ix_(live, live)] / np.outer(s, s)
            towards = cov[:size, size][live] / s
            coef[live] = np.linalg.solve(corr + penalty / n * np.eye(live.sum()), towards) / s
        intercept = mean[size] - coef @ mean[:size]
        row = {k: parts[k].iloc[0] for k in keys}
        row |= {"n_rows": n, "intercept": intercept, "coef": coef, "x_mean": mean[:size]}
        return pd.DataFrame([row])

    return run


def fit_ridge(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    weight: str | None = None,
    penalty: float = 1.0,
    keys: Sequence[str] = ("player",),
    rows_per_slice: int = 100_000,
    spread_by: str = "game_id",
) -> DataFrame:
    """Ridge regression on standardised columns, one per key, all keys in one job.

    Rows go to (key, slice) partitions of about ``rows_per_slice`` rows of a key; a
    task holds a bounded number of small matrices, and only these are combined.
    """
    keys, columns = list(keys), list(columns)
    needed = [*keys, *columns, target, *([weight] if weight else [])]
    rows = df.na.drop(subset=[target])
    sliced = sized_slices(rows.select(*dict.fromkeys([*needed, spread_by])), keys, [spread_by], rows_per_slice).select(*needed)
    key_types = T.StructType([df.schema[k] for k in keys])
    partial = sliced.mapInPandas(_add_moments(keys, columns, target, weight), _moment_schema(key_types))
    result = T.StructType(
        [
            *key_types.fields,
            T.StructField("n_rows", T.DoubleType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("x_mean", T.ArrayType(T.DoubleType())),
        ]
    )
    return partial.groupBy(*keys).applyInPandas(_solve(penalty, keys, len(columns)), result)


def predict(df: DataFrame, model: DataFrame, columns: Sequence[str], name: str = "pred_log_think_time", keys: Sequence[str] = ("player",)) -> DataFrame:
    """Attach the linear prediction of each row's own model; 0 for missing features."""
    parts = model.select(*keys, "intercept", "coef")
    total = F.col("intercept")
    for i, c in enumerate(columns):
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        total = total + F.col("coef")[i] * value
    return df.join(parts, list(keys)).withColumn(name, total).drop("intercept", "coef")


def expected_think_time(df: DataFrame, predicted: str = "pred_log_think_time") -> DataFrame:
    """Prediction back in seconds."""
    return df.withColumn("expected_think_time", F.expm1(predicted))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ("player",)) -> DataFrame:
    """Mean absolute error and R squared per key."""
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - ratio(F.sum(error * error), F.var_pop(actual) * F.count(actual))).alias("r2"),
    )


def contributions(df: DataFrame, model: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("player",), top: int = 10) -> DataFrame:
    """Mean absolute contribution of each column to the linear prediction, ``top`` per key."""
    joined = df.join(model.select(*keys, "coef", "x_mean"), list(keys))
    sizes = [
        F.avg(F.abs(F.col("coef")[i] * (F.col(c).cast("double") - F.col("x_mean")[i]))).alias(c)
        for i, c in enumerate(columns)
    ]
    wide = joined.groupBy(*keys).agg(*sizes)
    long = wide.unpivot(list(keys), list(columns), "feature", "importance")
    ranked = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return long.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def redealt(df: DataFrame, columns: Sequence[str], keys: Sequence[str], tie: Sequence[str], order: Column | None = None, seed: int = 0) -> DataFrame:
    """Each column's values dealt anew within its key, as ``_r_<column>``: a row gets those of the row before it in seeded hash order.

    The hash is the order, so a key with most of the rows is cut by its leading bits; the first row of a key gets the
    values of its last."""
    at = ["_hash", *tie]
    hashed = df.withColumn("_hash", (xx(*tie, seed=seed) if order is None else order).cast("bigint"))
    values = F.struct(*[F.col(c).alias(f"_r_{c}") for c in columns])
    dealt = running(hash_blocks(hashed.withColumn("_values", values), "_hash"), list(keys), at, previous={"_before": "_values"})
    last = hashed.groupBy(*keys).agg(F.max_by(values, F.struct(*at)).alias("_last"))
    joined = dealt.join(last, list(keys)).withColumn("_dealt", F.coalesce("_before", "_last"))
    return joined.select(*df.columns, "_dealt.*")


def permutation_importance(df: DataFrame, model: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str] = ("player",), tie: Sequence[str] = ("game_id", "ply"), order: Column | None = None, seed: int = 0) -> DataFrame:
    """How much each column's values, dealt anew within a key, raise the squared error of its linear model; all columns in one aggregation."""
    needed = df.select(*keys, *tie, target, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    scored = predict(redealt(needed, columns, keys, tie, order, seed), model, columns, "_p").join(model.select(*keys, F.col("coef").alias("_coef")), list(keys))
    error = F.col(target) - F.col("_p")
    worse = [F.avg((error - F.col("_coef")[i] * (F.col(f"_r_{c}") - F.col(c))) ** 2 - error**2).alias(c) for i, c in enumerate(columns)]
    return scored.groupBy(*keys).agg(*worse).unpivot(list(keys), list(columns), "feature", "importance")


def tree_permutation_importance(fitted, df: DataFrame, columns: Sequence[str], target: str, tie: Sequence[str] = ("game_id", "ply"), seed: int = 0) -> DataFrame:
    """The same for a fitted tree pipeline: rows are scored once as they are and once per column, in one job."""
    rows = df.select(F.lit(0).alias("_all"), *tie, target, *columns)
    dealt = redealt(rows, columns, ["_all"], tie, seed=seed)
    names = F.array(F.lit(""), *[F.lit(c) for c in columns])
    each = dealt.select("*", F.explode(names).alias("feature"))
    swapped = each.select(target, "feature", *[F.when(F.col("feature") == c, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    errors = fitted.transform(swapped).groupBy("feature").agg(F.avg((F.col(target) - F.col("prediction")) ** 2).alias("_e"))
    plain = errors.where("feature = ''").select(F.col("_e").alias("_plain"))
    return join_per_key(errors.where("feature <> ''"), plain, []).select("feature", (F.col("_e") - F.col("_plain")).alias("importance"))


def baseline(features: DataFrame, columns: Sequence[str], target: str = "log_think_time", days: int = LIVE_WINDOW_DAYS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Live and descriptive models of every player as one registry table.

    The live one uses the trailing window with recency weights and exists only
    for eligible players; both are fitted on the earlier part of the split.
    """
    usable = model_rows(features)
    live_rows = time_split(live_window(usable, days)).where(~F.col("is_test"))
    able = eligibility(usable, days, min_rows).where("live_model").select("player")
    live = fit_ridge(live_rows.join(able, "player", "left_semi"), columns, target, "recency_weight")
    full = fit_ridge(time_split(usable).where(~F.col("is_test")), columns, target)
    name = "thinktime" if target == "log_think_time" else "movequality"
    return registry({f"{name}_live": live, f"{name}_descriptive": full})


def registry(models: dict[str, DataFrame]) -> DataFrame:
    """Models under their names in one table."""
    union = None
    for name, model in models.items():
        named = model.withColumn("model", F.lit(name))
        union = named if union is None else union.unionByName(named)
    return union


def preferred(registered: DataFrame, name: str = "thinktime") -> DataFrame:
    """Each player's live model, else the descriptive one."""
    kinds = registered.where(F.col("model").startswith(f"{name}_"))
    fields = [c for c in registered.columns if c != "player"]
    pick = F.max_by(F.struct(*fields), F.col("model").endswith("_live"))
    return kinds.groupBy("player").agg(pick.alias("_m")).select("player", "_m.*")


def fit_trees(train: DataFrame, columns: Sequence[str], target: str, weight: str | None = None, absolute: bool = False, rounds: int = 20, depth: int = 5, seed: int = 0):
    """Boosted regression trees on Spark ML; ``absolute`` minimises absolute loss."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="keep")
    trees = GBTRegressor(
        featuresCol="x", labelCol=target, predictionCol="prediction", maxIter=rounds, maxDepth=depth,
        stepSize=0.1, seed=seed, lossType="absolute" if absolute else "squared", minInstancesPerNode=20,
    )
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[assembler, trees]).fit(train.na.drop(subset=[target]))


def tree_importances(model, columns: Sequence[str], spark, top: int = 10) -> DataFrame:
    """Importances of a fitted tree pipeline, ``top`` rows."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(columns, weights), key=lambda p: (-p[1], p[0]))[:top]
    rows = [(i + 1, c, float(w)) for i, (c, w) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def drift_report(features: DataFrame, n_bins: int = 4) -> DataFrame:
    """Per player and experience bin: size, dates, rating, time-gap correlation, medians."""
    clean = features.where(~F.col("is_suspect")).na.drop(subset=["think_time", "gap_1_2", "cp_loss"])
    binned = qcut(clean, ["player"], "games_played_so_far", n_bins, "_bin").withColumn("quartile", F.col("_bin") + 1)
    keys = ["player", "quartile"]
    moments = binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("game_date").alias("date_min"),
        F.max("game_date").alias("date_max"),
        F.avg("player_rating").alias("mean_rating"),
        guarded_corr(F.col("think_time"), F.col("gap_1_2")).alias("corr_time_gap"),
        F.avg("cp_loss").alias("mean_cp_loss"),
    )
    median = quantiles(binned, keys, "think_time", (0.5,), "_q")
    return join_per_key(moments, median, keys).withColumn("median_think_time", F.col("_q")[0]).drop("_q")
