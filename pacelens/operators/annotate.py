"""Annotation tables: what still has to be analysed, and what the engine logs reduce to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.ordered import ordered

# Mate scores, checkpoint size, rating bins and log formats.
MATE_SCORE_CP = 10000
MATE_STEP_CP = 100
CHUNK_TARGET = 600
LOWEST_BIN, HIGHEST_BIN, BIN_WIDTH = 1100, 1900, 100
UCI_MOVE = r"^[a-h][1-8][a-h][1-8][qrbn]?$"
PROBABILITY = r"\(?\s*P:\s*([\d.]+)\s*%\)?"
EXPECTED_COLUMNS = (
    "fen_before", "eval_before", "best_move", "gap_1_2", "top_n_spread",
    "top_moves", "top_cps", "top_mate_ins", "depth", "search_depth_reached",
    "search_stable_depth", "n_best_move_changes", "eval_swing_across_depth",
)


def todo(plies: DataFrame, done: DataFrame, keys: Sequence[str] = ("fen_before",), limit: int | None = None) -> DataFrame:
    """Distinct keys without a finished annotation; ``limit`` keeps the first in key order."""
    keys = list(keys)
    left = plies.select(*keys).na.drop(subset=keys).distinct()
    queue = left.join(done.select(*keys).distinct(), keys, "left_anti")
    return queue if limit is None else queue.orderBy(*keys).limit(limit)


def chunk_plan(queue: DataFrame, workers: int, target: int = CHUNK_TARGET, key: str = "fen_before") -> DataFrame:
    """Number the queue into equal chunks: at least one per worker, about ``target`` rows each."""
    numbered = ordered(queue, [], [key], number="_n", size="_rows")
    chunks = F.greatest(F.lit(workers), F.floor(F.col("_rows") / target))
    per_chunk = F.greatest(F.lit(1), F.ceil(F.col("_rows") / chunks))
    return numbered.withColumn("chunk", F.floor((F.col("_n") - 1) / per_chunk).cast("bigint")).drop("_n", "_rows")


def merge(parts: Sequence[DataFrame], keys: Sequence[str] = ("fen_before",), sequence: str = "load_seq") -> DataFrame:
    """Union of annotation parts; the last loaded row of a key wins.

    A part without ``sequence`` gets its position in ``parts``.  Columns a part
    lacks are NULL.  Runs as one partial aggregation, so repeated keys cost little.
    """
    stamped = [
        p if sequence in p.columns else p.withColumn(sequence, F.lit(i).cast("bigint")) for i, p in enumerate(parts)
    ]
    union = stamped[0]
    for p in stamped[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys and c != sequence]
    last = F.max_by(F.struct(*rest), F.struct(sequence, *[F.to_json(F.struct(c)) for c in rest]))
    return union.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def schema_gaps(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Expected columns the table lacks, one row each."""
    missing = [(c,) for c in expected if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, T.StructType([T.StructField("missing_column", T.StringType())]))


def column_fill(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Rows, and rows with a value, for every expected column; 0 for an absent one."""
    counts = [(F.count(c) if c in df.columns else F.lit(0)).cast("bigint").alias(c) for c in expected]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return one.unpivot(["n_rows"], list(expected), "column_name", "n_filled").withColumn(
        "present", F.col("column_name").isin([c for c in expected if c in df.columns])
    )


def score_to_cp(score_cp: Column, mate_in: Column) -> Column:
    """Centipawns; a forced mate scores near the ceiling, nearer mates more extreme."""
    mate = F.lit(float(MATE_SCORE_CP)) - F.abs(mate_in) * MATE_STEP_CP
    return F.when(mate_in.isNotNull(), F.when(mate_in > 0, mate).otherwise(-mate)).otherwise(score_cp.cast("double"))


def latest_lines(log: DataFrame) -> DataFrame:
    """Last line of every (position, depth, rank) with its centipawn score."""
    usable = log.where(
        F.col("depth").isNotNull() & F.col("move").isNotNull()
        & (F.col("score_cp").isNotNull() | F.col("mate_in").isNotNull())
    ).withColumn("cp", score_to_cp(F.col("score_cp"), F.col("mate_in")))
    line = F.struct("seq", "move", "cp", "mate_in")
    return (
        usable.groupBy("fen_before", "depth", F.coalesce("multipv", F.lit(1)).alias("rank"))
        .agg(F.max(line).alias("_line"))
        .select("fen_before", "depth", "rank", "_line.*")
    )


def candidates(lines: DataFrame) -> DataFrame:
    """Final candidate arrays per position, best first, with gap and spread.

    ``lines`` comes from ``latest_lines``; a position keeps one line per rank.
    """
    final = lines.groupBy("fen_before", "rank").agg(F.max(F.struct("seq", "move", "cp", "mate_in")).alias("l"))
    entry = F.struct((-F.col("l.cp")).alias("o"), "rank", F.col("l.move").alias("move"), F.col("l.cp").alias("cp"), F.col("l.mate_in").alias("mate_in"))
    ranked = final.groupBy("fen_before").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    cps = F.col("c.cp")
    several = F.size("c") > 1
    return ranked.select(
        "fen_before",
        cps[0].alias("eval_before"),
        F.col("c.move")[0].alias("best_move"),
        F.when(several, cps[0] - F.try_element_at(cps, F.lit(2))).alias("gap_1_2"),
        F.when(several, F.array_max(cps) - F.array_min(cps)).alias("top_n_spread"),
        F.col("c.move").alias("top_moves"),
        cps.alias("top_cps"),
        F.col("c.mate_in").alias("top_mate_ins"),
    )


def instability(lines: DataFrame) -> DataFrame:
    """How the first line changed on the way to the final depth."""
    by_depth = Window.partitionBy("fen_before").orderBy("depth")
    first = lines.where("rank = 1").withColumn("_changed", F.col("move") != F.lag("move").over(by_depth))
    return first.groupBy("fen_before").agg(
        F.max("depth").alias("search_depth_reached"),
        F.coalesce(F.max(F.when(F.col("_changed"), F.col("depth"))), F.min("depth")).alias("search_stable_depth"),
        F.count_if(F.col("_changed")).alias("n_best_move_changes"),
        (F.max("cp") - F.min("cp")).alias("eval_swing_across_depth"),
    )


def reduce_search_log(log: DataFrame, depth: int) -> DataFrame:
    """Annotated positions from the engine's raw search log."""
    lines = latest_lines(log)
    target = F.lit(depth)
    return (
        candidates(lines)
        .join(instability(lines), "fen_before", "left")
        .withColumns(
            {
                "depth": target,
                "search_depth_reached": F.coalesce("search_depth_reached", target),
                "search_stable_depth": F.coalesce("search_stable_depth", target),
                "n_best_move_changes": F.coalesce("n_best_move_changes", F.lit(0)),
                "eval_swing_across_depth": F.coalesce("eval_swing_across_depth", F.lit(0.0)),
            }
        )
    )


def rating_bin(rating: Column) -> Column:
    """Nearest rating bin, clamped to the trained range; ties take the lower bin."""
    nearest = F.ceil((rating - BIN_WIDTH / 2) / BIN_WIDTH) * BIN_WIDTH
    return F.least(F.lit(HIGHEST_BIN), F.greatest(F.lit(LOWEST_BIN), nearest)).cast("int")


def with_rating_bin(plies: DataFrame) -> DataFrame:
    return plies.withColumn(
        "maia_rating_bin", F.when(F.col("player_rating").isNotNull(), rating_bin(F.col("player_rating")))
    )


def policy_todo(plies: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (position, rating bin) pairs without a policy."""
    return todo(with_rating_bin(plies), done, ("fen_before", "maia_rating_bin"), limit)


def bin_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("maia_rating_bin").agg(F.count(F.lit(1)).alias("n_positions"))


def policy_lines(log: DataFrame) -> DataFrame:
    """Move and probability of every per-move line of a policy log."""
    move = F.element_at(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), 1)
    percent = F.nullif(F.regexp_extract("line", PROBABILITY, 1), F.lit("")).try_cast("double")
    return (
        log.withColumns({"move": move, "prob": percent / 100.0})
        .where(F.col("move").rlike(UCI_MOVE) & F.col("prob").isNotNull())
        .drop("line")
    )


def parse_policy_log(log: DataFrame) -> DataFrame:
    """Policies per (position, rating bin); a later line of a move overrides.

    A position has at most a few hundred legal moves, so the arrays stay small.
    """
    moves = (
        policy_lines(log)
        .groupBy("fen_before", "rating_bin", "move")
        .agg(F.max(F.struct("seq", "prob")).alias("l"))
        .select("fen_before", F.col("rating_bin").alias("maia_rating_bin"), "move", F.col("l.prob").alias("prob"))
    )
    listed = moves.groupBy("fen_before", "maia_rating_bin").agg(F.array_sort(F.collect_list(F.struct("move", "prob"))).alias("m"))
    return listed.select(
        "fen_before", "maia_rating_bin", F.col("m.move").alias("maia_moves"), F.col("m.prob").alias("maia_probs")
    )
