"""Scans of game archives and tables, and the sinks for features and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacelens.functions.nulls import nan_to_null

# Archive schema, live time classes and record format.
GAME_SCHEMA = "struct<time_class: string, rated: boolean, rules: string, pgn: string, url: string, end_time: bigint>"
ARCHIVE_SCHEMA = f"games array<{GAME_SCHEMA}>"
LIVE_CLASSES = ("bullet", "blitz", "rapid")
GAME_START = '[Event "'


def read_archives(spark: SparkSession, path: str, schema: str = ARCHIVE_SCHEMA) -> DataFrame:
    """Monthly archive documents, one game per row; folder partitions stay as columns."""
    months = spark.read.schema(schema).option("multiLine", True).json(path)
    kept = [c for c in months.columns if c != "games"]
    return months.select(*kept, F.posexplode("games").alias("position", "_game")).select(*kept, "position", "_game.*")


def _right_kind(time_class: str, rated_only: bool) -> Column:
    ok = (F.col("time_class") == time_class) & F.col("time_class").isin(*LIVE_CLASSES) & (F.col("rules") == "chess")
    if rated_only:
        ok = ok & F.coalesce(F.col("rated"), F.lit(False))
    return ok & (F.coalesce(F.col("pgn"), F.lit("")) != "")


def eligible_games(games: DataFrame, time_class: str = "bullet", rated_only: bool = True, max_games: int | None = None, order: Sequence[str] = (), keys: Sequence[str] = ("player",)) -> DataFrame:
    """Live games of one time class under standard rules that carry clock tags.

    ``max_games`` keeps each player's first games in ``order`` (``keys`` that are no
    columns are passed over; with none left the whole table is one player's archive).
    """
    kept = games.where(_right_kind(time_class, rated_only) & F.col("pgn").contains("[%clk"))
    if max_games is None:
        return kept
    drawn = Window.partitionBy(*[k for k in keys if k in games.columns]).orderBy(*order)
    return kept.withColumn("_rank", F.row_number().over(drawn)).where(F.col("_rank") <= max_games).drop("_rank")


def clockless_count(games: DataFrame, time_class: str = "bullet", rated_only: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """How many otherwise eligible games have and lack clock tags."""
    tagged = F.col("pgn").contains("[%clk")
    return games.where(_right_kind(time_class, rated_only)).groupBy(*keys).agg(
        F.count_if(tagged).alias("n_kept"), F.count_if(~tagged).alias("n_without_clock")
    )


def recent_months(games: DataFrame, n: int, month: str = "month", keys: Sequence[str] = ("player",)) -> DataFrame:
    """Rows of each player's last ``n`` months with games.

    On a table partitioned by month the semi join prunes partitions at run time.
    """
    months = games.select(*keys, month).distinct()
    latest = Window.partitionBy(*keys).orderBy(F.desc(month))
    wanted = months.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")
    return games.join(wanted, [*keys, month], "left_semi")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Game texts from files of concatenated games, split at each game's first header.

    The separator is the start of a line, whether lines end in LF or CRLF, so the scan
    stays splittable; bytes that are no text become replacement characters.  Records
    without players or moves are marked, not lost.
    """
    raw = spark.read.option("lineSep", f"\n{GAME_START}").text(path)
    clean = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r", "")
    text = F.when(clean.startswith(GAME_START), clean).otherwise(F.concat(F.lit(GAME_START), clean))
    return mark_malformed(raw.where(F.trim(clean) != "").select(F.rtrim(F.regexp_replace(text, r"\s+$", "")).alias("pgn")))


def mark_malformed(games: DataFrame, pgn: str = "pgn") -> DataFrame:
    """Add the reason a record cannot be parsed, NULL when it can."""
    c = F.col(pgn)
    return games.withColumn(
        "malformed",
        F.when(~c.contains('[White "') | ~c.contains('[Black "'), "no players").when(~c.rlike(r"\n\s*\n\s*\S"), "no moves"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with NaN normalised to NULL."""
    return nan_to_null(spark.read.parquet(path))


def write_by_player(df: DataFrame, path: str, key: str = "player") -> None:
    """Overwrite only the players present in ``df``.

    The rebalance hint packs small players together and splits a hot one over
    several files, both decided from run-time sizes.
    """
    df.hint("rebalance", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def as_documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON document; NULL fields are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(df: DataFrame, path: str) -> None:
    as_documents(df).write.mode("overwrite").text(path)


def as_script(df: DataFrame, name: str) -> DataFrame:
    """Documents as script statements that assign them to a constant."""
    return as_documents(df).select(F.concat(F.lit(f"const {name} = "), "value", F.lit(";")).alias("value"))


def write_script(df: DataFrame, path: str, name: str) -> None:
    as_script(df, name).write.mode("overwrite").text(path)
