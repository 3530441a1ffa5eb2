"""Who played this game: folds, scores, rank and fusion curves, confusion, reasons.

Class scores are one row a game: the place of the true class (``label``) and an
array ``p`` with a score for each class in class order.  Ranks and predictions are
read off the array, fusion adds arrays, and class names are joined last from the
games themselves.  Scores laid out as rows (player, game_id, class, p) are accepted
everywhere and packed first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.draws import mix, unit, xx
from pacelens.functions.nulls import ratio
from pacelens.functions.ordered import ordered
from pacelens.functions.stats import bin_of, guarded_corr, hash_rank, join_per_key, quantile_edges
from pacelens.functions.storage import materialise
from pacelens.operators import logistic, trees

GAME = ("player", "game_id")
FAMILIES = ("logistic", "forest", "boosting")

# Evaluation sizes, thresholds and signal names.
RANKS = (1, 3, 5, 10)
GROUP_SIZES = (1, 3, 5, 10, 20, 50)
CONFUSION_FULL_MAX = 12
CONFUSION_TOP = 8
STORED_TOP = 5
DISPLAY_TOTAL = 40
PAIR_BINS = 16
MIN_BUCKET_GAMES = 30
SIGNALS = (
    "session_game_index", "log_minutes_since_prev_game", "prev_game_result",
    "low_time_think_ratio", "rhythm_autocorr", "tempo_match_corr",
    "post_mistake_think_delta", "n_plies", "think_time_std", "cp_loss_trend",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate of a frame as a scalar subquery."""
    return df.select(value).scalar()


# --- cohorts, folds, scaling ---------------------------------------------------------


def cohort(plies: DataFrame, cohort_map: DataFrame, name: str) -> DataFrame:
    """Plies of one cohort's accounts, accounts of one person merged under one identity."""
    members = cohort_map.where(F.col("cohort") == name).select(
        F.col("source_player").alias("player"), F.col("identity").alias("_identity")
    )
    return plies.join(members, "player").withColumn("player", F.col("_identity")).drop("_identity")


def stratified_folds(vectors: DataFrame, k: int = 5, seed: int = 0, order: Column | None = None, keys: Sequence[str] = ("player",)) -> DataFrame:
    """Deal each class's games round-robin over ``k`` folds in seeded hash order."""
    hashed = xx("game_id", seed=seed) if order is None else order
    ranked = hash_rank(vectors, list(keys), hashed, ["game_id"], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def chronological_holdout(vectors: DataFrame, share: float = 0.2, order: str = "game_datetime") -> DataFrame:
    """Mark each player's last ``share`` of games as held out."""
    placed = ordered(vectors, ["player"], [order, "game_id"], number="_n", size="_of")
    return placed.withColumn("is_test", F.col("_n") > F.floor(F.col("_of") * F.lit(1 - share))).drop("_n", "_of")


def standardise(vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus mean over population standard deviation; a constant column stays centred."""
    moments = vectors.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = join_per_key(vectors, moments, [])
    spread = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return scaled.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / spread(c) for c in columns}).select(*vectors.columns)


def class_weights(vectors: DataFrame, label: str = "player") -> DataFrame:
    """Weight of each class: one over its share of the games."""
    sizes = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("n_games"))
    total = scalar(vectors, F.count(F.lit(1)))
    return sizes.withColumn("weight", total / F.col("n_games"))


# --- model scores --------------------------------------------------------------------


def _family(name: str, n_rows: int, seed: int):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    common = {"featuresCol": "_z", "labelCol": "label", "weightCol": "_weight"}
    if name == "logistic":
        return LogisticRegression(family="multinomial", regParam=1.0 / max(n_rows, 1), maxIter=100, tol=1e-4, standardization=False, **common)
    if name == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **common)
    raise ValueError(f"unknown model family {name!r}")


def _boosted(table: DataFrame, columns: Sequence[str], n_folds: int, n_classes: int, seed: int) -> DataFrame:
    """Held-out scores of boosted trees; all folds grow together."""
    keys = [*GAME, "fold", "label"]
    ready = table.select(*keys, F.lit(0).alias("_group"), F.col("fold").alias("_fold"), F.col("label").alias("_label"), (F.col("_weight") / n_classes).alias("_weight"), F.struct(*GAME).alias("_row"), *columns)
    rows = trees.binned(ready, columns, trees.edges(table, columns))
    model = trees.grow(rows, 1, n_classes, n_folds, len(columns), seed=seed)
    return trees.held_out(rows, model, len(columns)).select(F.lit("boosting").alias("family"), *keys, "p")


def out_of_fold(vectors: DataFrame, columns: Sequence[str], families: Sequence[str] = FAMILIES[:2], seed: int = 0, compact: bool = False) -> DataFrame:
    """Held-out class scores of every game from each model family.

    ``vectors`` carries ``fold``; a negative fold only trains.  Scaling is fitted once a
    training part and shared by the families.  Rows (family, player, game_id, fold, class, p),
    or with ``compact`` one row a family and game, as every evaluation here reads them.
    """
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weighted = vectors.join(class_weights(vectors).select("player", F.col("weight").alias("_weight")), "player")
    codes = materialise(ordered(vectors.select("player").distinct(), [], ["player"], number="label").select("player", (F.col("label") - 1).cast("int").alias("label")))
    table = materialise(weighted.join(codes, "player").select(*GAME, "fold", "label", "_weight", *[F.col(c).cast("double").alias(c) for c in columns]))
    folds = sorted(r[0] for r in table.where("fold >= 0").select("fold").distinct().collect())
    n_rows, n_classes = table.count(), codes.count()
    fitted = [name for name in families if name != "boosting"]
    parts = []
    if fitted:
        raw = materialise(VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="keep").transform(table).select(*GAME, "fold", "label", "_weight", "_raw"))
    for fold in folds if fitted else []:
        scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(raw.where(F.col("fold") != fold))
        train = materialise(scaler.transform(raw.where(F.col("fold") != fold)).select("label", "_weight", "_z"))
        held = scaler.transform(raw.where(F.col("fold") == fold))
        for name in fitted:
            scored = _family(name, n_rows, seed).fit(train).transform(held)
            # a stored part at a time: no plan holds the trees of several models
            parts.append(materialise(scored.select(F.lit(name).alias("family"), *GAME, "fold", "label", vector_to_array("probability").alias("p"))))
    if "boosting" in families and folds:
        parts.append(materialise(_boosted(table, columns, max(folds) + 1, n_classes, seed)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union if compact else unpacked(union, codes)


# --- layouts of class scores ---------------------------------------------------------


def packed(scores: DataFrame) -> DataFrame:
    """One row a game: ``label`` and ``p``; rows by class are gathered, a game's classes being one array's length."""
    if "class" not in scores.columns:
        return scores
    keys = [c for c in scores.columns if c not in ("class", "p")]
    held = F.array_sort(F.collect_list(F.struct("class", "p")))
    gathered = scores.groupBy(*keys).agg(held.alias("_h"))
    names = F.transform("_h", lambda h: h["class"])
    label = F.nullif(F.array_position(names, F.col("player")), F.lit(0)) - 1
    return gathered.select(*keys, label.cast("int").alias("label"), F.transform("_h", lambda h: h["p"]).alias("p"), names.alias("classes"))


def class_names(scores: DataFrame) -> DataFrame:
    """(label, class) of every class that has games."""
    return scores.select("label", F.col("player").alias("class")).distinct()


def unpacked(scores: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Rows by class: the other columns, class, p."""
    held = packed(scores)
    keys = [c for c in held.columns if c not in ("label", "p", "classes")]
    if "classes" in held.columns:
        return held.select(*keys, F.inline(F.arrays_zip(F.col("classes").alias("class"), "p")))
    names = class_names(held) if codes is None else codes.select("label", F.col("player").alias("class"))
    return held.select(*keys, F.posexplode("p").alias("label", "p")).join(names, "label").select(*keys, "class", "p")


def best_place(p: str = "p") -> Column:
    """Place of the largest score, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def predictions(scores: DataFrame, keys: Sequence[str] = GAME) -> DataFrame:
    """Best class of each game with its score; equal scores take the first class."""
    held = packed(scores)
    best = held.withColumns({"_best": best_place(), "confidence": F.array_max("p")})
    if "classes" in held.columns:
        named = best.withColumn("predicted", F.get("classes", F.col("_best")))
    else:
        named = best.join(class_names(held).select(F.col("label").alias("_best"), F.col("class").alias("predicted")), "_best", "left")
    return named.select(*keys, "predicted", "confidence", F.coalesce(F.col("_best") == F.col("label"), F.lit(False)).alias("correct"))


def recall(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*keys, "player").agg(
        F.count(F.lit(1)).alias("n_games"), F.avg(F.col("correct").cast("double")).alias("recall")
    )


def accuracy(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall and balanced accuracy beside the majority and chance baselines."""
    per_class = recall(pred, keys)
    n = F.sum("n_games")
    return per_class.groupBy(*keys).agg(
        n.alias("n_games_total"),
        F.count(F.lit(1)).alias("n_classes"),
        (F.sum(F.col("recall") * F.col("n_games")) / n).alias("overall_accuracy"),
        F.avg("recall").alias("balanced_accuracy"),
        (F.max("n_games") / n).alias("majority_baseline"),
        (1.0 / F.count(F.lit(1))).alias("chance_baseline"),
    )


def best_family(scores: DataFrame) -> DataFrame:
    """Scores of the family with the best balanced accuracy."""
    rated = accuracy(predictions(scores, ("family", *GAME)), ("family",))
    best = rated.select(F.max_by("family", F.struct("balanced_accuracy", "family")).alias("family"))
    return scores.join(best, "family", "left_semi")


def evaluate(vectors: DataFrame, columns: Sequence[str], k: int = 5, split: str = "random", families: Sequence[str] = FAMILIES, seed: int = 0) -> DataFrame:
    """Held-out scores of the best family under random folds or a chronological holdout."""
    if split == "random":
        folded = stratified_folds(vectors, k, seed)
    elif split == "chronological":
        folded = chronological_holdout(vectors).withColumn("fold", F.when(F.col("is_test"), 0).otherwise(-1)).drop("is_test")
    else:
        raise ValueError(f"unknown split {split!r}")
    held = out_of_fold(folded, columns, families, seed, compact=True)
    return best_family(held) if len(families) > 1 else held


def rating_band(vectors: DataFrame, ratings: DataFrame, low: float, high: float) -> DataFrame:
    """Games of players whose rating lies in one band, for the same-skill check."""
    inside = ratings.where((F.col("rating") >= low) & (F.col("rating") < high)).select("player")
    return vectors.join(inside, "player", "left_semi")


# --- curves --------------------------------------------------------------------------


def rank_of_true(scores: DataFrame) -> DataFrame:
    """Position of the true class among each game's scores; null where it has none."""
    own, label = F.get("p", F.col("label")), F.col("label")
    ahead = F.filter("p", lambda x, i: (x > own) | ((x == own) & (i < label)))
    return packed(scores).select(*GAME, F.when(own.isNotNull(), F.size(ahead) + 1).alias("true_rank"))


def rank_k(scores: DataFrame, ks: Sequence[int] = RANKS) -> DataFrame:
    """Rank-k accuracy, k capped at the number of classes, repeated k dropped."""
    held = packed(scores)
    n_classes = scalar(held, F.max(F.size("p")))
    per_player = rank_of_true(held).groupBy("player").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("true_rank") <= k).alias(f"hit{k}") for k in ks]
    )
    columns = []
    for k in ks:
        columns.append(F.struct(F.lit(k).alias("k"), ratio(F.sum(f"hit{k}"), F.sum("n")).alias("overall_accuracy"), F.avg(F.col(f"hit{k}") / F.col("n")).alias("balanced_accuracy")))
    points = per_player.agg(F.array(*columns).alias("_points")).select(F.inline("_points"))
    return points.withColumn("k", F.least(F.col("k"), n_classes)).dropDuplicates(["k"])


def _fused(games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean of the score arrays of each group: keys, ``label``, ``p``; a group holds at most its size in games."""
    held = F.array_sort(F.collect_list(F.struct("game_id", "_weight", "p")))
    zero = F.transform(F.col("_h")[0]["p"], lambda _: F.lit(0.0))
    total = F.aggregate("_h", zero, lambda acc, g: F.zip_with(acc, g["p"], lambda a, x: a + x * g["_weight"]))
    weight = F.aggregate("_h", F.lit(0.0), lambda acc, g: acc + g["_weight"])
    summed = games.groupBy(*keys).agg(F.max("label").alias("label"), held.alias("_h")).select(*keys, "label", total.alias("_total"), weight.alias("_sum"))
    return summed.select(*keys, "label", F.transform("_total", lambda x: x / F.col("_sum")).alias("p"))


def _grouped(scores: DataFrame, sizes: Sequence[int], order: Column | None, weighted: bool, seed: int) -> DataFrame:
    games = scores.select(*GAME, F.array_max("p").alias("_w"))
    hashed = xx("game_id", seed=seed) if order is None else order
    ranked = hash_rank(games, ["player"], hashed, ["game_id"], "_rank")
    counts = games.groupBy("player").agg(F.count(F.lit(1)).alias("_games"))
    placed = ranked.join(counts, "player").withColumn("n_games", F.explode(F.array([F.lit(s) for s in sizes])))
    placed = placed.withColumn("_group", F.floor((F.col("_rank") - 1) / F.col("n_games")))
    placed = placed.where((F.col("_group") + 1) * F.col("n_games") <= F.col("_games"))
    weight = F.col("_w") if weighted else F.lit(1.0)
    joined = scores.join(placed.select(*GAME, "n_games", "_group", weight.alias("_weight")), list(GAME))
    return _fused(joined, ("player", "n_games", "_group"))


def _curve(fused: DataFrame, scores: DataFrame, sizes: Sequence[int]) -> DataFrame:
    per_player = fused.groupBy("player", "n_games").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(best_place() == F.col("label")).alias("_hits")
    )
    points = per_player.groupBy("n_games").agg(
        ratio(F.sum("_hits"), F.sum("_n")).alias("overall_accuracy"),
        F.avg(F.col("_hits") / F.col("_n")).alias("balanced_accuracy"),
        F.count(F.lit(1)).alias("n_players_covered"),
    )
    total = scalar(scores, F.count_distinct("player"))
    asked = scores.sparkSession.createDataFrame([(s,) for s in sizes], "n_games int")
    return (
        asked.join(points, "n_games", "left")
        .withColumn("n_players_covered", F.coalesce("n_players_covered", F.lit(0)))
        .withColumn("n_players_total", total)
    )


def fuse(scores: DataFrame, sizes: Sequence[int] = GROUP_SIZES, weighting: str = "uniform", order: Column | None = None, seed: int = 0) -> DataFrame:
    """Accuracy after averaging the scores of N games of one player.

    Games are dealt into groups of N in seeded hash order, an incomplete last
    group is left out.  ``confidence`` weights a game by its best score.
    """
    if weighting not in ("uniform", "confidence"):
        raise ValueError(f"unknown weighting {weighting!r}")
    held = packed(scores)
    return _curve(_grouped(held, sizes, order, weighting == "confidence", seed), held, sizes)


def fuse_selected(scores: DataFrame, keyed: DataFrame, by: str, sizes: Sequence[int] = GROUP_SIZES) -> DataFrame:
    """Like ``fuse`` with one group per player: their N games with the highest ``by``."""
    best = Window.partitionBy("player").orderBy(F.desc(by), "game_id")
    held = packed(scores)
    games = held.select(*GAME).join(keyed.select(*GAME, by), list(GAME))
    top = games.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max(sizes))
    counts = top.groupBy("player").agg(F.count(F.lit(1)).alias("_games"))
    placed = top.join(counts, "player").withColumn("n_games", F.explode(F.array([F.lit(s) for s in sizes])))
    placed = placed.where((F.col("_rank") <= F.col("n_games")) & (F.col("n_games") <= F.col("_games")))
    joined = held.join(placed.select(*GAME, "n_games", F.lit(0).alias("_group"), F.lit(1.0).alias("_weight")), list(GAME))
    return _curve(_fused(joined, ("player", "n_games", "_group")), held, sizes)


# --- diagnostics ---------------------------------------------------------------------


def correctness_signals(games: DataFrame, signals: Sequence[str] = SIGNALS, min_games: int = MIN_BUCKET_GAMES) -> DataFrame:
    """Correlation of correctness with each signal, z-scored within the player.

    ``games`` has one row per held-out game with ``correct`` and the signals.
    """
    present = [s for s in signals if s in games.columns]
    long = games.select("player", "game_id", F.col("correct").cast("double").alias("_hit"), *[F.col(s).cast("double").alias(s) for s in present]).unpivot(
        ["player", "game_id", "_hit"], present, "signal", "_x"
    )
    moments = long.groupBy("player", "signal").agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
    z = ratio(F.col("_x") - F.col("_m"), F.col("_s"))
    scored = long.join(moments, ["player", "signal"]).withColumn("_z", z).where(F.col("_z").isNotNull())
    return (
        scored.groupBy("signal")
        .agg(
            guarded_corr(F.col("_z"), F.col("_hit")).alias("within_player_corr_with_correctness"),
            F.count(F.lit(1)).alias("n_games"),
        )
        .where(F.col("n_games") >= min_games)
    )


def tilt_buckets(games: DataFrame, min_games: int = MIN_BUCKET_GAMES) -> DataFrame:
    """Accuracy after a lost, drawn or won previous game."""
    r = F.col("prev_game_result")
    label = F.when(r < 0, "lost previous game").when(r == 0, "drew / first game of session").when(r > 0, "won previous game")
    return _bucket_accuracy(games.withColumn("bucket", label), min_games)


def session_buckets(games: DataFrame, min_games: int = MIN_BUCKET_GAMES) -> DataFrame:
    """Accuracy by tercile of the position in the session."""
    edges = quantile_edges(games, [], "session_game_index", 3, "_edges")
    marked = join_per_key(games, edges, [])
    code = bin_of(F.col("session_game_index").cast("double"), F.col("_edges"))
    return _bucket_accuracy(marked.withColumn("bucket", code + 1), min_games)


def _bucket_accuracy(games: DataFrame, min_games: int) -> DataFrame:
    return (
        games.where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_games"))
        .where(F.col("n_games") >= min_games)
    )


def confusion(pred: DataFrame, full_max: int = CONFUSION_FULL_MAX, top: int = CONFUSION_TOP) -> DataFrame:
    """Share of each player's games per predicted class.

    Up to ``full_max`` classes every cell that occurs is kept, beyond that the
    diagonal and each row's ``top`` other classes.
    """
    cells = pred.groupBy("player", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sizes = pred.groupBy("player").agg(F.count(F.lit(1)).alias("_size"))
    n_classes = scalar(pred, F.count_distinct("player"))
    off = F.col("predicted") != F.col("player")
    row = Window.partitionBy("player", off).orderBy(F.desc("n"), "predicted")
    rated = cells.join(sizes, "player").withColumn("share", F.col("n") / F.col("_size"))
    kept = rated.withColumn("_rank", F.row_number().over(row)).where(~off | (F.col("_rank") <= top) | (n_classes <= full_max))
    return kept.drop("_size", "_rank")


def misses(pred: DataFrame) -> DataFrame:
    """Where a player's misattributed games go, as shares of the misses."""
    wrong = pred.where(~F.col("correct"))
    cells = wrong.groupBy("player", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sizes = wrong.groupBy("player").agg(F.count(F.lit(1)).alias("n_misses"))
    return cells.join(sizes, "player").withColumn("share_of_misses", F.col("n") / F.col("n_misses"))


def coefficient_rows(model, columns: Sequence[str], classes: Sequence[str], spark) -> DataFrame:
    """Weights of a fitted multinomial model: class, feature, weight."""
    matrix = model.coefficientMatrix.toArray()
    rows = [(str(c), f, float(matrix[i][j])) for i, c in enumerate(classes) for j, f in enumerate(columns)]
    return spark.createDataFrame(rows, "class string, feature string, weight double")


def coefficient_summary(weights: DataFrame) -> DataFrame:
    """Signed weight of the second class when there are two, else mean absolute weight."""
    sizes = weights.select("class").distinct()
    n = scalar(sizes, F.count(F.lit(1)))
    per = weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("_abs"), F.max_by("weight", "class").alias("_signed"))
    return per.select("feature", F.when(n == 2, F.col("_signed")).otherwise(F.col("_abs")).alias("coef"), (n == 2).alias("coef_is_signed"))


def display_sample(pred: DataFrame, total: int = DISPLAY_TOTAL, seed: int = 0, order: Column | None = None) -> DataFrame:
    """The same number of games per class, drawn in seeded hash order."""
    hashed = xx("game_id", seed=seed) if order is None else order
    n_classes = scalar(pred, F.count_distinct("player"))
    per_class = F.greatest(F.lit(1), F.floor(F.lit(total) / n_classes))
    drawn = Window.partitionBy("player").orderBy("_hash", "game_id")
    bounded = pred.withColumn("_hash", hashed).withColumn("_rank", F.row_number().over(drawn)).where(F.col("_rank") <= total)
    return bounded.where(F.col("_rank") <= per_class).drop("_hash", "_rank")


def reasons(vectors: DataFrame, pred: DataFrame, weights: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Largest linear contributions towards each game's predicted class.

    Each comes with the value and the pool's mean and spread, all in natural units.
    """
    pool = vectors.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    wide = join_per_key(vectors.join(pred.select(*GAME, F.col("predicted").alias("class")), list(GAME)), pool, [])
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            F.col(f"_m_{c}").alias("pool_mean"), F.col(f"_s_{c}").alias("pool_std"),
        )
        for c in columns
    ]
    long = wide.select(*GAME, "class", F.inline(F.array(*entries)))
    z = (F.col("value") - F.col("pool_mean")) / F.when(F.col("pool_std") == 0, 1.0).otherwise(F.col("pool_std"))
    weighed = long.join(weights, ["class", "feature"]).withColumn("contribution", F.col("weight") * z)
    largest = Window.partitionBy(*GAME).orderBy(F.desc(F.abs("contribution")), "feature")
    return weighed.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= top).drop("weight")


def stored_scores(scores: DataFrame, top: int = STORED_TOP) -> DataFrame:
    """Scores worth keeping per game: the best few, the true class and the predicted one."""
    held = packed(scores)
    placed = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("np"), i.alias("at"))))
    ranked = F.transform(placed, lambda e, i: F.struct(e["at"].alias("_at"), (-e["np"]).alias("p"), (i + 1).alias("rank")))
    kept = F.filter(ranked, lambda e: (e["rank"] <= top) | (e["_at"] == F.col("label")))
    if "classes" in held.columns:
        rows = held.select(*GAME, "classes", F.inline(kept))
        return rows.select(*GAME, F.get("classes", F.col("_at")).alias("class"), "p", "rank")
    names = class_names(held).withColumnRenamed("label", "_at")
    return held.select(*GAME, F.inline(kept)).join(names, "_at").select(*GAME, "class", "p", "rank")


def merge_cyclic(reason_rows: DataFrame) -> DataFrame:
    """Hour and weekday pairs merged by signed sum; other features pass through."""
    f = F.col("feature")
    base = F.when(f.isin("hour_sin", "hour_cos"), "hour").when(f.isin("dow_sin", "dow_cos"), "dow").otherwise(f)
    cyclic = base != f
    plain = lambda c: F.max(F.when(~cyclic, F.col(c))).alias(c)
    return reason_rows.groupBy(*GAME, base.alias("feature_base")).agg(
        F.sum("contribution").alias("contribution"), plain("value"), plain("pool_mean"), plain("pool_std")
    ).withColumnRenamed("feature_base", "feature")


def describe_value(value: Column, mean: Column, std: Column) -> Column:
    """Verbal comparison of a value with the pool; NULL when there is nothing to compare."""
    z = ratio(value - mean, F.when(std > 0, std))
    return (
        F.when(z > 1.2, "much higher").when(z > 0.4, "somewhat higher")
        .when(z < -1.2, "much lower").when(z < -0.4, "somewhat lower").when(z.isNotNull(), "close")
    )


# --- traces and pairs ----------------------------------------------------------------


def trace_player(scores: DataFrame, min_games: int = 25, target: float = 0.25) -> DataFrame:
    """The player whose single-game accuracy is nearest the target.

    Players with enough games qualify; when none has, the five with most games do.
    """
    rated = recall(predictions(scores))
    enough = rated.where(F.col("n_games") >= min_games)
    none = scalar(enough, F.count(F.lit(1))) == 0
    largest = rated.orderBy(F.desc("n_games"), "player").limit(5).where(none)
    off = F.struct(F.abs(F.col("recall") - target), F.col("player"))
    return enough.unionByName(largest).agg(F.min_by("player", off).alias("player")).where(F.col("player").isNotNull())


def confidence_trace(scores: DataFrame, games: DataFrame, min_games: int = 25, order: str = "game_date") -> DataFrame:
    """Running mean of one player's scores in date order, with the top guess after each game."""
    held = packed(scores)
    # one player's games, by every class that has games
    theirs = held.join(trace_player(held, min_games), "player", "left_semi")
    if "classes" in held.columns:
        rows = unpacked(theirs)
    else:
        rows = theirs.select(*GAME, F.posexplode("p").alias("_at", "p")).join(class_names(held).withColumnRenamed("label", "_at"), "_at")
    mine = rows.join(games.select(*GAME, order), list(GAME))
    run = ordered(mine, ["class"], [order, "game_id"], number="n_games", sums={"_sum": F.col("p")})
    mean = run.withColumn("p", F.col("_sum") / F.col("n_games"))
    best = F.min(F.struct((-F.col("p")).alias("np"), F.col("class").alias("c")))
    return (
        mean.groupBy("player", "n_games", "game_id", order)
        .agg(best.alias("_b"), F.max(F.when(F.col("class") == F.col("player"), F.col("p"))).alias("running_prob_correct"))
        .select(
            "player", "n_games", "game_id", order, "running_prob_correct",
            F.col("_b.c").alias("top_guess"), (-F.col("_b.np")).alias("top_guess_prob"),
            (F.col("_b.c") == F.col("player")).alias("correct_so_far"),
        )
    )


def sample_pairs(players: DataFrame, n_pairs: int = 40, seed: int = 0) -> DataFrame:
    """``n_pairs`` distinct player pairs, every pair of players as likely as any other.

    All players are numbered; pair numbers are drawn from the whole triangle of pairs
    and unranked by arithmetic, so pairs are enumerated only where there are hardly
    more of them than are asked for.
    """
    spark = players.sparkSession
    numbered = ordered(players.select("player").distinct(), [], ["player"], number="_at")
    n = numbered.count()
    total = n * (n - 1) // 2
    if total <= 4 * n_pairs:
        numbers = spark.range(total).select(F.col("id").alias("t"), mix("id", seed).alias("o"))
    else:  # distinct draws; of 4 n draws from more than 4 n numbers far more than n differ
        draws = spark.range(4 * n_pairs).select(F.col("id").alias("o"), F.floor(unit(xx("id", seed=seed)) * F.lit(float(total))).cast("bigint").alias("t"))
        numbers = draws.groupBy("t").agg(F.min("o").alias("o"))
    picked = numbers.orderBy("o", "t").limit(n_pairs)
    # Pair number t belongs to the pair (i, j) with i < j and t = j * (j - 1) / 2 + i.
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("t").cast("double"))) / 2)
    pairs = picked.select(F.col("t").alias("pair"), (F.col("t") - j * (j - 1) / 2).cast("bigint").alias("i"), j.cast("bigint").alias("j"))
    a = numbered.select((F.col("_at") - 1).alias("i"), F.col("player").alias("a"))
    b = numbered.select((F.col("_at") - 1).alias("j"), F.col("player").alias("b"))
    return pairs.join(a, "i").join(b, "j").select("pair", "a", "b")


def pairwise(vectors: DataFrame, columns: Sequence[str], n_pairs: int = 40, k: int = 5, min_games: int = 10, seed: int = 0, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Balanced accuracy of telling two players apart, for sampled pairs: the best family, and each of them.

    All pairs and folds of a family are fitted together; a pair uses k = min(5, smaller class).
    The logistic fit scales columns within the training rows of each pair and fold; trees read them as they are.
    """
    sizes = vectors.groupBy("player").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_games)
    by_number = Window.orderBy("pair")  # at most n_pairs rows
    pairs = materialise(sample_pairs(sizes, n_pairs, seed).withColumn("_group", F.row_number().over(by_number) - 1))
    sides = pairs.select("pair", "_group", "a", "b", F.explode(F.array("a", "b")).alias("player"))
    least = sides.join(sizes, "player").groupBy("pair").agg(F.min("_size").alias("_least"), F.sum("_size").alias("_all"))
    ranked = hash_rank(vectors, ["player"], xx("game_id", seed=seed), ["game_id"], "_rank")
    rows = sides.join(least, "pair").join(ranked, "player").join(sizes, "player")
    rows = rows.withColumns(
        {
            "fold": F.pmod(F.col("_rank") - 1, F.least(F.lit(k), F.col("_least"))).cast("int"),
            "_is_b": F.col("player") == F.col("b"),
            "_weight": F.col("_all") / (2.0 * F.col("_size")),
        }
    )
    keys = ["pair", "a", "b", "player"]
    rows = materialise(rows.select(*keys, "_group", "game_id", "fold", "_is_b", "_weight", *columns))
    held = None
    for name in families:
        if name == "logistic":
            scored = logistic.out_of_fold(rows, ["pair"], columns, "_is_b", k, "_weight", standardised=True)
        else:
            scored = _paired_trees(rows, columns, pairs.count(), k, name, seed).withColumn("p", F.col("p")[1])
        one = scored.select(*keys, F.lit(name).alias("family"), ((F.col("p") > 0.5) == F.col("_is_b")).cast("double").alias("_hit"))
        held = one if held is None else held.unionByName(one)
    per_class = held.groupBy(*keys, "family").agg(F.avg("_hit").alias("_recall"), F.count(F.lit(1)).alias("_n"))
    rated = per_class.groupBy("pair", "a", "b", "family").agg(F.sum("_n").alias("n_games"), F.avg("_recall").alias("_rate"))
    own = [F.max(F.when(F.col("family") == name, F.col("_rate"))).alias(name) for name in families]
    # of equal families the first in the alphabet
    best = F.min(F.struct((-F.col("_rate")).alias("r"), F.col("family").alias("f")))
    found = rated.groupBy("pair", "a", "b").agg(F.max("n_games").alias("n_games"), F.max("_rate").alias("balanced_accuracy"), best.alias("_b"), *own)
    return found.select("pair", "a", "b", "n_games", "balanced_accuracy", F.col("_b.f").alias("family"), *families)


def _paired_trees(rows: DataFrame, columns: Sequence[str], n_pairs: int, k: int, name: str, seed: int) -> DataFrame:
    """Held-out scores of boosted trees or a forest for every pair, all pairs and folds grown together."""
    ready = rows.select("pair", "a", "b", "player", "game_id", "_is_b", "_group", F.col("fold").alias("_fold"), F.col("_is_b").cast("int").alias("_label"), "_weight", F.struct("player", "game_id").alias("_row"), *columns)
    stored = trees.binned(ready, columns, trees.edges(rows, columns, PAIR_BINS))
    shape = {"copies": 16, "depth": 5, "share": 0.25} if name == "forest" else {"rounds": 12, "depth": 3}
    model = trees.grow(stored, n_pairs, 2, k, len(columns), bins=PAIR_BINS, seed=seed, **shape)
    return trees.held_out(stored, model, len(columns))


def pairwise_summary(pairs: DataFrame) -> DataFrame:
    """Median, extremes, mean and quartiles over the (sampled) pairs."""
    v = F.col("balanced_accuracy")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"),
    )
