"""Parsing queries: texts built from table rows, taken apart again, checked field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.operators import parse
from pacelens.plans.catalog import query
from pacelens.sources.standins import MOVES_SQL, PLIES_SQL

CLOCK_TEXT = """CASE WHEN doc_id % 5 = 0 THEN text ELSE '[%clk ' || CAST(doc_id % 3 AS STRING) || ':' ||
  lpad(CAST(doc_id * 7 % 60 AS STRING), 2, '0') || ':' || lpad(CAST(doc_id * 11 % 60 AS STRING), 2, '0') ||
  CASE WHEN doc_id % 2 = 0 THEN '.5' ELSE '' END || '] ' || text END"""


@query(
    "clock_tag_seconds", "P1", "doc_id:l seconds:d",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 * 3600 + doc_id * 7 % 60 * 60 + doc_id * 11 % 60
      + CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0 END END AS seconds FROM documents""",
)
def clock_tag_seconds(t):
    return t.documents.select("doc_id", parse.clock_seconds(F.expr(CLOCK_TEXT)).alias("seconds"))


CONTROL_TEXT = """CASE doc_id % 8 WHEN 0 THEN '60' WHEN 1 THEN CAST(n_chars AS STRING) || '+2' WHEN 2 THEN '1/259200'
  WHEN 3 THEN '' WHEN 4 THEN lang WHEN 5 THEN '60+0' WHEN 6 THEN '5+x' ELSE '1+2+3' END"""


@query(
    "time_control_parts", "P2", "doc_id:l base_s:d increment_s:d",
    f"""WITH c AS (SELECT doc_id, {CONTROL_TEXT} AS tc FROM documents),
    s AS (SELECT doc_id, tc, string_split(tc, '+') AS p FROM c),
    b AS (SELECT doc_id, CASE WHEN contains(tc, '/') OR len(p) > 2 THEN NULL
        WHEN len(p) = 2 AND TRY_CAST(p[2] AS DOUBLE) IS NULL THEN NULL ELSE TRY_CAST(p[1] AS DOUBLE) END AS base_s,
      TRY_CAST(p[2] AS DOUBLE) AS inc FROM s)
    SELECT doc_id, base_s, CASE WHEN base_s IS NULL THEN 0 ELSE coalesce(inc, 0) END AS increment_s FROM b""",
)
def time_control_parts(t):
    tc = t.documents.select("doc_id", F.expr(CONTROL_TEXT).alias("tc"))
    return tc.select(
        "doc_id",
        parse.time_control_base(F.col("tc")).alias("base_s"),
        parse.time_control_increment(F.col("tc")).alias("increment_s"),
    )


@query(
    "game_identifiers", "P3", "page_id:l game_id:s source:s",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN string_split(rtrim(url, '/'), '/')[-1]
        WHEN 1 THEN string_split(rtrim(url, '/'), '/')[-1] ELSE '2024.01.01_' || '_' || CAST(page_id AS VARCHAR) END AS game_id,
      CASE WHEN page_id % 3 = 0 THEN 'chesscom' ELSE 'lichess' END AS source FROM pages""",
)
def game_identifiers(t):
    p = t.pages.select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("link"),
        F.when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("Chess.com").alias("site"),
    )
    return p.select(
        "page_id",
        parse.game_identifier(
            F.col("link"), F.col("site"), F.lit("2024.01.01"), F.lit(None).cast("string"), F.col("page_id").cast("string")
        ).alias("game_id"),
        parse.source_tag(F.col("link")).alias("source"),
    )


@query(
    "header_fields", "P4", "doc_id:l white:s black:s event:s n_headers:l",
    """SELECT doc_id, source AS white, 'b' || CAST(doc_id AS VARCHAR) AS black, lang AS event, 3 AS n_headers FROM documents""",
)
def header_fields(t):
    tag = lambda name, c: F.concat(F.lit(f'[{name} "'), c, F.lit('"]\n'))
    d = F.col("doc_id").cast("string")
    pgn = F.concat(
        tag("Event", F.lit("first")), tag("White", F.col("source")), tag("Event", F.col("lang")),
        tag("Black", F.concat(F.lit("b"), d)), F.lit("\n"), F.regexp_replace("text", '"', "'"),
    )
    h = t.documents.select("doc_id", parse.header_map(pgn).alias("h"))
    return h.select(
        "doc_id", F.col("h")["White"].alias("white"), F.col("h")["Black"].alias("black"),
        F.col("h")["Event"].alias("event"), F.size("h").alias("n_headers"),
    )


@query(
    "move_tokens", "P5 P6",
    "order_id:l ply:l move_san:s clock_after:d is_capture:b gives_check:b to_square:s castle_side:s promotion:s",
    f"""WITH {MOVES_SQL} SELECT game_id AS order_id, ply, san AS move_san, clock_after, takes AS is_capture, checks AS gives_check,
      CASE WHEN castle IS NULL THEN square END AS to_square,
      CASE castle WHEN 'O-O' THEN 'kingside' WHEN 'O-O-O' THEN 'queenside' END AS castle_side,
      CASE WHEN promotes THEN 'Q' END AS promotion FROM moves""",
)
def move_tokens(t):
    tokens = parse.san_facts(parse.move_tokens(t.archive()))
    return tokens.withColumn("clock_after", parse.clock_seconds(F.col("comment")))


PARSED_SQL = f"""WITH {MOVES_SQL},
w AS (SELECT *, coalesce(last_value(CASE WHEN side = 'white' THEN clock_after END IGNORE NULLS) OVER e, base_s) AS wc,
    coalesce(last_value(CASE WHEN side = 'black' THEN clock_after END IGNORE NULLS) OVER e, base_s) AS bc,
    lag(CASE WHEN takes THEN square END) OVER (PARTITION BY game_id ORDER BY ply) AS taken,
    last_value(CASE WHEN side = 'white' THEN castle END IGNORE NULLS) OVER e AS wcastle,
    last_value(CASE WHEN side = 'black' THEN castle END IGNORE NULLS) OVER e AS bcastle
  FROM moves WINDOW e AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN side = 'white' THEN wc ELSE bc END AS clock_before, CASE WHEN side = 'white' THEN bc ELSE wc END AS opp_clock FROM w),
y AS (SELECT *, clock_before - clock_after + increment_s AS think_time FROM x),
parsed AS (SELECT *, last_value(CASE WHEN side = 'white' THEN think_time END IGNORE NULLS) OVER e AS wt,
    last_value(CASE WHEN side = 'black' THEN think_time END IGNORE NULLS) OVER e AS bt,
    CASE WHEN side = 'white' THEN wcastle ELSE bcastle END AS own_castle, CASE WHEN side = 'white' THEN bcastle ELSE wcastle END AS opp_castle
  FROM y WINDOW e AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
WING = "CASE {} WHEN 'O-O' THEN 'kingside' WHEN 'O-O-O' THEN 'queenside' END"


@query(
    "parsed_plies", "P8 P9 P10 P11",
    "game_id:s ply:l side:s move_number:l clock_before:d think_time:d opp_clock:d opp_think_time_prev:d "
    "is_recapture:b own_castled_side:s opp_castled_side:s opposite_side_castling:b",
    f"""{PARSED_SQL} SELECT game_id, ply, side, ply // 2 + 1 AS move_number, clock_before, think_time, opp_clock,
      CASE WHEN side = 'white' THEN bt ELSE wt END AS opp_think_time_prev,
      coalesce(takes AND square = taken, false) AS is_recapture,
      {WING.format("own_castle")} AS own_castled_side, {WING.format("opp_castle")} AS opp_castled_side,
      coalesce(own_castle <> opp_castle, false) AS opposite_side_castling FROM parsed""",
)
def parsed_plies(t):
    return parse.plies(t.archive())


@query(
    "tracked_player_view", "P7 P12 P14",
    "player:s game_id:s ply:l color:s player_rating:d opp_rating:d think_time:d player_move_index:l player_moves_total:l",
    f"""{PARSED_SQL}, tracked AS (SELECT c_name AS player, 'customer#' || CAST(c_custkey AS VARCHAR) AS n FROM customer WHERE c_acctbal > 0),
    own AS (SELECT t.player, p.*, CASE WHEN side = 'white' THEN white_rating ELSE black_rating END AS player_rating,
        CASE WHEN side = 'white' THEN black_rating ELSE white_rating END AS opp_rating
      FROM parsed p JOIN tracked t ON lower(CASE WHEN side = 'white' THEN white ELSE black END) = t.n
      WHERE clock_after IS NOT NULL)
    SELECT player, game_id, ply, side AS color, player_rating, opp_rating, think_time,
      row_number() OVER (PARTITION BY player, game_id ORDER BY ply) - 1 AS player_move_index,
      count(*) OVER (PARTITION BY player, game_id) AS player_moves_total
    FROM own QUALIFY base_s IS NOT NULL""",
)
def tracked_player_view(t):
    names = t.customer.where("c_acctbal > 0").select(
        F.concat(F.lit("cusTomer#"), F.col("c_custkey").cast("string")).alias("player"), "c_name"
    )
    view = parse.drop_untimed(parse.player_view(parse.plies(t.archive()), names))
    return view.join(names, "player").drop("player").withColumnRenamed("c_name", "player")


@query(
    "tracked_player_games", "P7", "player:s game_id:s color:s player_rating:d opp_rating:d",
    f"""WITH {MOVES_SQL}, g AS (SELECT DISTINCT game_id, white, black, white_rating, black_rating FROM moves),
    tracked AS (SELECT 'customer#' || CAST(c_custkey AS VARCHAR) AS n FROM customer WHERE c_acctbal > 0)
    SELECT n AS player, game_id, 'white' AS color, white_rating AS player_rating, black_rating AS opp_rating FROM g JOIN tracked ON lower(white) = n
    UNION ALL
    SELECT n, game_id, 'black', black_rating, white_rating FROM g JOIN tracked ON lower(black) = n""",
)
def tracked_player_games(t):
    names = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("customer#"), F.col("c_custkey").cast("string")).alias("player"))
    return parse.resolve_players(parse.headers(t.archive()), names)


@query(
    "two_sided_turn_clocks", "P8 P9",
    "conv_id:l turn:l clock_before:d think_time:d opp_clock:d opp_think_time_prev:d",
    """WITH c AS (SELECT conv_id, turn, role = 'assistant' AS b, CASE WHEN role <> 'system' THEN CAST(length(text) % 600 AS DOUBLE) END AS ca FROM conversations),
    w AS (SELECT *, coalesce(last_value(CASE WHEN NOT b THEN ca END IGNORE NULLS) OVER e, 600) AS wc,
        coalesce(last_value(CASE WHEN b THEN ca END IGNORE NULLS) OVER e, 600) AS bc FROM c
      WINDOW e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, CASE WHEN b THEN bc ELSE wc END AS clock_before, CASE WHEN b THEN wc ELSE bc END AS opp_clock FROM w),
    y AS (SELECT *, clock_before - ca + 2 AS think_time FROM x)
    SELECT conv_id, turn, clock_before, think_time, opp_clock, CASE WHEN b THEN
        last_value(CASE WHEN NOT b THEN think_time END IGNORE NULLS) OVER e ELSE
        last_value(CASE WHEN b THEN think_time END IGNORE NULLS) OVER e END AS opp_think_time_prev
    FROM y WINDOW e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def two_sided_turn_clocks(t):
    turns = t.conversations.select(
        "conv_id", F.col("turn").alias("ply"),
        F.when(F.col("role") == "assistant", "black").otherwise("white").alias("side"),
        F.when(F.col("role") != "system", (F.length("text") % 600).cast("double")).alias("clock_after"),
        F.lit(600.0).alias("base_s"), F.lit(2.0).alias("increment_s"),
    )
    return parse.think_times(turns, keys=("conv_id",)).withColumnRenamed("ply", "turn")


NOISE_SQL = f"""WITH {PLIES_SQL}, n AS (SELECT player, game_id, ply, think_time - 3 AS t, base_s + 15 AS base FROM plies),
f AS (SELECT *, coalesce(t <= 0.12, false) AS is_premove, coalesce(t < 0, false) AS is_negative,
  coalesce(t > 0.6 * base, false) AS lag_suspect FROM n),
g AS (SELECT *, is_premove OR is_negative OR lag_suspect OR t IS NULL AS is_suspect FROM f)"""


def noisy(t):
    shifted = t.plies().select(
        "player", "game_id", "ply", (F.col("think_time") - 3).alias("think_time"), (F.col("base_s") + 15).alias("base_s")
    )
    return parse.flag_noise(shifted)


@query(
    "noise_flags", "P13", "player:l game_id:l ply:l is_premove:b is_negative:b lag_suspect:b is_suspect:b",
    f"{NOISE_SQL} SELECT player, game_id, ply, is_premove, is_negative, lag_suspect, is_suspect FROM g",
)
def noise_flags(t):
    return noisy(t)


@query(
    "noise_report", "P15", "player:l n_plies:l premove_rate:d lag_rate:d negative_or_missing_rate:d suspect_rate:d",
    f"""{NOISE_SQL} SELECT player, count(*) AS n_plies, avg(is_premove::INT) AS premove_rate, avg(lag_suspect::INT) AS lag_rate,
      avg((is_negative OR t IS NULL)::INT) AS negative_or_missing_rate, avg(is_suspect::INT) AS suspect_rate FROM g GROUP BY player""",
)
def noise_report(t):
    return parse.noise_report(noisy(t))


@query(
    "think_time_summary", "P15", "player:l n_clean:l mean:d std:d min:d max:d q25:d median:d q75:d",
    f"""{NOISE_SQL} SELECT player, count(t) AS n_clean, avg(t) AS mean, stddev_samp(t) AS std, min(t) AS min, max(t) AS max,
      quantile_cont(t, 0.25) AS q25, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.75) AS q75 FROM g WHERE NOT is_suspect GROUP BY player""",
)
def think_time_summary(t):
    return parse.think_time_summary(noisy(t))


@query(
    "untimed_counts", "P14", "source:s n_dropped:l n_kept:l",
    """SELECT source, count(*) FILTER (WHERE tc IS NULL) AS n_dropped, count(*) FILTER (WHERE tc IS NOT NULL) AS n_kept
    FROM (SELECT source, CASE WHEN doc_id % 8 IN (0, 1, 5) THEN 1 END AS tc FROM documents) GROUP BY source""",
)
def untimed_counts(t):
    rows = t.documents.select("source", parse.time_control_base(F.expr(CONTROL_TEXT)).alias("base_s"))
    return parse.untimed_count(rows, ("source",))


@query(
    "untimed_observed", "P14", "n_dropped:l n_kept:l n_rows:l",
    """SELECT count(*) FILTER (WHERE doc_id % 8 NOT IN (0, 1, 5)) AS n_dropped, count(*) FILTER (WHERE doc_id % 8 IN (0, 1, 5)) AS n_kept,
      count(*) FILTER (WHERE doc_id % 8 IN (0, 1, 5)) AS n_rows FROM documents""",
)
def untimed_observed(t):
    """The counts that fall out of the pass that drops the rows, beside the rows it keeps."""
    from pyspark.sql import Observation

    seen = Observation()
    kept = parse.drop_untimed(t.documents.select(parse.time_control_base(F.expr(CONTROL_TEXT)).alias("base_s")), seen).count()
    return t.spark.createDataFrame([(seen.get["n_dropped"], seen.get["n_kept"], kept)], "n_dropped long, n_kept long, n_rows long")
