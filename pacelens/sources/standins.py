"""The driver's tables seen as timing data, under the canonical column names.

``orders`` joined with ``lineitem`` plays the wide ply table (an order is a game,
its lines are the plies), ``events`` plays game starts, ``conversations`` plays
two-sided games and ``embeddings`` plays per-game vectors with class scores.

Derived columns are written once as SQL expressions that both Spark and the
oracle engine read, so the two sides start from the same rows.  Measures are
whole numbers or binary fractions: sums are then exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A line has no unique key, so every column that differs takes part in the order.
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]

PLY_COLUMNS = {
    "player": "o_custkey",
    "game_id": "o_orderkey",
    "color": "CASE WHEN o_orderkey % 2 = 0 THEN 'white' ELSE 'black' END",
    "result": "CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END",
    "mode": "CASE WHEN o_orderkey % 3 = 0 THEN 'blitz' ELSE 'bullet' END",
    "player_rating": "CAST(900 + floor(o_totalprice / 400) AS DOUBLE)",
    "opp_rating": "CAST(900 + o_orderkey % 1200 AS DOUBLE)",
    "base_s": "CAST(60 AS DOUBLE)",
    "increment_s": "CAST(o_orderkey % 3 AS DOUBLE)",
    "think_time": "l_quantity",
    "log_think_time": "ln(1 + l_quantity)",
    "opp_think_time_prev": "CASE WHEN l_tax >= 0.07 THEN NULL ELSE CAST(l_suppkey % 40 AS DOUBLE) END",
    "clock_before": "CAST(l_suppkey % 61 AS DOUBLE)",
    "opp_clock": "CAST(l_partkey % 61 AS DOUBLE)",
    "eval_before": "CAST(l_partkey % 801 - 400 AS DOUBLE)",
    "gap_1_2": "CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(floor(l_extendedprice / 100) AS DOUBLE) END",
    "cp_loss": "CAST(floor(l_extendedprice * l_discount / 50) AS DOUBLE)",
    "is_mistake": "l_returnflag = 'R'",
    "is_recapture": "l_suppkey % 6 = 0",
    "is_forced": "l_partkey % 9 = 0",
    "is_decided": "l_partkey % 5 = 0",
    "is_sacrifice": "l_partkey % 11 = 0",
    "played_best_move": "l_linestatus = 'O'",
    "low_time": "l_discount >= 0.08",
    "game_phase": "CASE WHEN l_linenumber <= 2 THEN 'opening' WHEN l_linenumber <= 4 THEN 'middlegame' ELSE 'endgame' END",
    "own_skewers": "CAST(CASE WHEN l_partkey % 7 = 0 THEN 1 + l_partkey % 2 ELSE 0 END AS DOUBLE)",
    "opp_skewers": "CAST(CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "n_captures_available": "CAST(l_suppkey % 5 AS DOUBLE)",
    "n_moves_within_30cp": "1 + l_partkey % 4",
    "maia_prob_played": "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE (l_partkey % 17) / CAST(16 AS DOUBLE) END",
    "maia_prob_best_move": "(l_suppkey % 9) / CAST(8 AS DOUBLE)",
    "maia_surprise": "(l_partkey % 13) / CAST(4 AS DOUBLE)",
    "maia_is_top_choice": "l_suppkey % 3 = 0",
    "requires_overriding_instinct": "l_suppkey % 10 = 0",
    "is_premove": "l_quantity <= 2",
    "is_negative": "l_quantity = 7 AND l_discount = 0.0",
    "lag_suspect": "l_quantity >= 49",
    "is_suspect": "l_quantity <= 2 OR l_quantity >= 49",
    "pred_log_think_time": "ln(1 + CAST(5 + l_suppkey % 40 AS DOUBLE))",
}

_LINE_ORDER_SQL = ", ".join(LINE_ORDER)
_SPARK_TIME = "timestampadd(SECOND, CAST(o_orderkey * 7919 % 86400 AS INT), o_orderdate)"
_ORACLE_TIME = "o_orderdate + to_seconds(o_orderkey * 7919 % 86400)"

# The same table as text, for the oracle: a WITH-clause entry named ``plies``.
PLIES_SQL = (
    "plies AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in PLY_COLUMNS.items())
    + f", CAST(o_orderdate AS DATE) AS game_date, {_ORACLE_TIME} AS game_datetime"
    + f", row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER_SQL}) - 1 AS ply"
    + " FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
)


class Tables:
    """The driver's Parquet tables of one scale factor, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def plies(self) -> DataFrame:
        """Wide ply table from orders and their lines."""
        lines = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        in_game = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        numbered = lines.withColumn("ply", F.row_number().over(in_game).cast("bigint") - 1)
        return numbered.select(
            *[F.expr(f"CAST({e} AS DOUBLE)" if "/ CAST(16 AS DOUBLE)" in e or "/ CAST(8 AS DOUBLE)" in e or "/ CAST(4 AS DOUBLE)" in e else e).alias(c)
              for c, e in PLY_COLUMNS.items()],
            F.col("o_orderdate").cast("date").alias("game_date"),
            F.expr(_SPARK_TIME).alias("game_datetime"),
            "ply",
        )

    def moves(self) -> DataFrame:
        """Two-sided plies from orders and lines, with the move text each line stands for."""
        return self.spark.sql(f"WITH {MOVES_TEXT} SELECT * FROM moves", orders=self.orders, lineitem=self.lineitem)

    def archive(self) -> DataFrame:
        """One game text per order: header lines, then moves with clock comments."""
        moves = self.moves()
        token = F.concat(
            F.when(F.col("ply") % 2 == 0, F.concat((F.col("ply") / 2 + 1).cast("int").cast("string"), F.lit(". "))).otherwise(""),
            "san", F.when(F.col("ply") % 5 == 1, "!?").otherwise(""),
            F.when(F.col("clk").isNotNull(), F.concat(F.lit(" {[%clk "), "clk", F.lit("]}"))).otherwise(""),
            F.when(F.col("ply") % 4 == 2, " {compare Nf3 or Qxd5+} (1. e4 e5 (1... c5 {sharp}) 2. Nf3)").otherwise(""),
        )
        body = moves.groupBy("game_id").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ply", token.alias("t")))), lambda m: m["t"]), " "
            ).alias("body"),
            *[F.first(c).alias(c) for c in HEADER_COLUMNS],
        )
        line = lambda tag, c: F.concat(F.lit(f'[{tag} "'), c, F.lit('"]\n'))
        pgn = F.concat(
            line("Event", F.lit("rated")), F.when(F.col("link") != "", line("Link", F.col("link"))).otherwise(""),
            line("Site", F.col("site")), line("UTCDate", F.col("date")), line("UTCTime", F.col("utc_time")),
            line("White", F.col("white")), line("Black", F.col("black")),
            line("WhiteElo", F.col("white_rating").cast("int").cast("string")),
            line("BlackElo", F.col("black_rating").cast("int").cast("string")),
            line("Result", F.col("result")), line("TimeControl", F.col("time_control")),
            F.lit("\n"), "body", F.lit(" "), "result",
        )
        return body.select(F.col("game_id").alias("order_id"), pgn.alias("pgn"))


HEADER_COLUMNS = (
    "link", "site", "date", "utc_time", "white", "black", "white_rating", "black_rating", "result", "time_control",
)

_MOVES = f"""lines AS (
  SELECT o_orderkey AS game_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://games.example/live/' || CAST(o_orderkey AS STRING) ELSE '' END AS link,
    'https://site.example/' || CAST(o_orderkey AS STRING) AS site,
    replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '.') AS date,
    lpad(CAST(o_orderkey * 7 % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey * 11 % 60 AS STRING), 2, '0')
      || ':' || lpad(CAST(o_orderkey * 13 % 60 AS STRING), 2, '0') AS utc_time,
    'Customer#' || CAST(o_custkey AS STRING) AS white,
    'CUSTOMER#' || CAST((o_custkey * 7 + o_orderkey) % 997 AS STRING) AS black,
    CAST(1000 + o_custkey % 900 AS DOUBLE) AS white_rating, CAST(1000 + o_orderkey % 900 AS DOUBLE) AS black_rating,
    CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
    CASE o_orderkey % 5 WHEN 0 THEN '60' WHEN 1 THEN '120+1' WHEN 2 THEN '1/86400' WHEN 3 THEN '60+0' ELSE '45+2' END AS time_control,
    CASE o_orderkey % 5 WHEN 0 THEN 60.0 WHEN 1 THEN 120.0 WHEN 3 THEN 60.0 WHEN 4 THEN 45.0 END AS base_s,
    CASE o_orderkey % 5 WHEN 1 THEN 1.0 WHEN 4 THEN 2.0 ELSE 0.0 END AS increment_s,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER_SQL}) - 1 AS ply,
    CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'N' WHEN 2 THEN 'B' WHEN 3 THEN 'R' ELSE 'Q' END AS piece,
    CASE WHEN l_partkey % 8 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'O-O' ELSE 'O-O-O' END END AS castle,
    chr(CAST(97 + l_partkey % 8 AS INT)) || CAST(1 + l_suppkey % 8 AS STRING) AS square,
    l_suppkey % 3 = 0 AND l_partkey % 8 <> 0 AS takes, l_suppkey % 8 = 7 AS last_rank,
    chr(CAST(97 + l_suppkey % 8 AS INT)) AS from_file, l_tax = 0.02 AS checks,
    CASE WHEN l_tax < 0.08 THEN l_quantity + l_linenumber / CAST(10 AS DOUBLE) END AS clock_after,
    CASE WHEN l_tax < 0.08 THEN '0:00:' || lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0') || '.' || CAST(l_linenumber AS STRING) END AS clk
  FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey),
moves AS (SELECT *,
    CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS side,
    piece = '' AND castle IS NULL AND last_rank AS promotes,
    CASE WHEN castle IS NOT NULL THEN castle
      ELSE piece || CASE WHEN takes AND piece = '' THEN from_file ELSE '' END || CASE WHEN takes THEN 'x' ELSE '' END
        || square || CASE WHEN piece = '' AND last_rank THEN '=Q' ELSE '' END END
      || CASE WHEN checks THEN '+' ELSE '' END AS san
  FROM lines)"""

MOVES_TEXT = _MOVES
MOVES_SQL = _MOVES.format(orders="orders", lineitem="lineitem")


# --- positions ------------------------------------------------------------------------

def _mixed(x: str, seed: int) -> str:
    return f"((({x}) % 2147483648) * 2654435761 + {seed}) % 4294967296"


_KING_W = f"CAST(floor(({_mixed('o * 17 + 3', 5)}) / 67108864) AS INT)"
_KING_B = f"CAST(({_KING_W} + 9 + CAST(floor(({_mixed('o * 29 + 5', 11)}) / 65536) AS BIGINT) % 46) % 64 AS INT)"
_DIE = f"CAST(floor(({_mixed('(o * 64 + i) * (o * 64 + i) % 2147483647 + (o * 64 + i) * 31', 3)}) / 65536) AS BIGINT) % 100"
# The same numbers; the square is taken of a remainder, as that of a number itself leaves 64 bits beyond 47 million orders.
_SPARK_DIE = _DIE.replace("(o * 64 + i) * (o * 64 + i) %", "((o * 64 + i) % 2147483647) * ((o * 64 + i) % 2147483647) %")
# One square (0 = a8 .. 63 = h1) of the position an order stands for.
SQUARE = f"""CASE WHEN i = {_KING_W} THEN 'K' WHEN i = {_KING_B} THEN 'k'
  WHEN {_DIE} < 60 THEN '.'
  WHEN {_DIE} < 67 THEN CASE WHEN i < 8 OR i > 55 THEN '.' ELSE 'P' END
  WHEN {_DIE} < 74 THEN CASE WHEN i < 8 OR i > 55 THEN '.' ELSE 'p' END
  WHEN {_DIE} < 77 THEN 'N' WHEN {_DIE} < 80 THEN 'n' WHEN {_DIE} < 83 THEN 'B' WHEN {_DIE} < 86 THEN 'b'
  WHEN {_DIE} < 89 THEN 'R' WHEN {_DIE} < 92 THEN 'r' WHEN {_DIE} < 96 THEN 'Q' ELSE 'q' END"""
FEN_TAIL = """CASE WHEN o % 2 = 0 THEN 'w' ELSE 'b' END || ' ' || CASE o % 3 WHEN 0 THEN '-' WHEN 1 THEN 'KQkq' ELSE 'Kq' END
  || ' - ' || CAST(o % 50 AS STRING) || ' ' || CAST(1 + o % 60 AS STRING)"""


def positions(tables: Tables) -> DataFrame:
    """One position per order, as FEN text built square by square from its number."""
    # One small file is one task; building the texts is heavy, so spread it first.
    n = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    ids = tables.orders.select(F.col("o_orderkey").alias("o")).repartition(n, "o")
    kings = ids.selectExpr("o", f"{_KING_W} AS kw", f"{_KING_B} AS kb", f"transform(sequence(0, 63), i -> {_SPARK_DIE}) AS dice")
    piece = SQUARE.replace(_DIE, "d").replace(_KING_B, "kb").replace(_KING_W, "kw")
    placed = kings.selectExpr("o", f"array_join(transform(dice, (d, i) -> {piece}), '') AS _squares")
    text = F.regexp_replace("_squares", "(.{8})(?!$)", "$1/")
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    return placed.select("o", F.concat(text, F.lit(" "), F.expr(FEN_TAIL)).alias("fen_before"))
