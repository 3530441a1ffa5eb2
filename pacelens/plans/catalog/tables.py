"""Source, sink, assembly and gold-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.functions.storage import materialise, shared_folder
from pacelens.operators import games, gold, ident, insights, models, parse
from pacelens.plans import build, features
from pacelens.plans.catalog import players, query
from pacelens.plans.catalog.ident import SP, judged
from pacelens.sources import archive, standins

ARCHIVE_COLUMNS = {
    "order_id": "doc_id",
    "time_class": "CASE doc_id % 4 WHEN 0 THEN 'blitz' WHEN 1 THEN 'daily' ELSE 'bullet' END",
    "rated": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 <> 0 END",
    "rules": "CASE WHEN doc_id % 11 = 0 THEN 'chess960' ELSE 'chess' END",
    "pgn": "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text ELSE text || ' {[%clk 0:01:00]}' END",
    "lang": "lang",
}
A = f"WITH a AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ARCHIVE_COLUMNS.items())} FROM documents)"
KIND = "time_class = 'bullet' AND coalesce(rated, false) AND rules = 'chess' AND pgn <> ''"


def archive_rows(t):
    return t.documents.select(*[F.expr(e).alias(c) for c, e in ARCHIVE_COLUMNS.items()])


@query("eligible_games", "S1", "order_id:l", f"{A} SELECT order_id FROM a WHERE {KIND} AND contains(pgn, '[%clk')")
def eligible_games(t):
    return archive.eligible_games(archive_rows(t))


@query(
    "clockless_counts", "S1", "lang:s n_kept:l n_without_clock:l",
    f"{A} SELECT lang, count(*) FILTER (WHERE contains(pgn, '[%clk')) AS n_kept, count(*) FILTER (WHERE NOT contains(pgn, '[%clk')) AS n_without_clock FROM a WHERE {KIND} GROUP BY lang",
)
def clockless_counts(t):
    return archive.clockless_count(archive_rows(t), keys=("lang",))


@query(
    "recent_months", "S2", "player:l game_id:l month:s",
    """WITH g AS (SELECT o_custkey AS player, o_orderkey AS game_id, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
    SELECT * FROM g QUALIFY dense_rank() OVER (PARTITION BY player ORDER BY month DESC) <= 3""",
)
def recent_months(t):
    g = t.orders.select(
        F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("game_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    return archive.recent_months(g, 3)


@query("scanned_game_texts", "S3 P3", "game_id:s white:s malformed:s", f"WITH {standins.MOVES_SQL} SELECT DISTINCT game_id, white, NULL AS malformed FROM moves")
def scanned_game_texts(t):
    import uuid

    path = f"{shared_folder(t.spark)}/games-{uuid.uuid4().hex}"
    t.archive().select(F.concat("pgn", F.lit("\n")).alias("value")).write.text(path)
    return parse.headers(archive.read_games(t.spark, path))


@query(
    "features_round_trip", "S4 S5", "player:l n_plies:l n_missing:l total:d",
    f"WITH {standins.PLIES_SQL} SELECT player, count(*) AS n_plies, count(*) FILTER (WHERE gap_1_2 IS NULL) AS n_missing, sum(think_time) AS total FROM plies GROUP BY player",
)
def features_round_trip(t):
    import uuid

    path = f"{shared_folder(t.spark)}/features-{uuid.uuid4().hex}"
    nan = F.coalesce(F.col("gap_1_2"), F.lit(float("nan")))
    rows = t.plies().select("player", "game_id", "ply", "think_time", nan.alias("gap_1_2"), (F.col("player") % 16).alias("bucket"))
    archive.write_by_player(rows, path, "bucket")
    return archive.read_table(t.spark, path).groupBy("player").agg(
        F.count(F.lit(1)).alias("n_plies"), F.count_if(F.col("gap_1_2").isNull()).alias("n_missing"), F.sum("think_time").alias("total")
    )


@query(
    "profile_scripts", "S6", "value:s",
    """SELECT 'const PLAYER = {"player":' || c_custkey || ',"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '};' AS value FROM customer""",
)
def profile_scripts(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("player"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment")
    )
    return archive.as_script(rows, "PLAYER")


@query(
    "assembled_features", "X5 E6 B15",
    "player:l game_id:l ply:l eval_before:d n_pieces:l cp_loss:d clock_frac_remaining:d eval_delta_1:d games_played_so_far:l log_think_time:d outcome_bucket:s in_book:b",
    f"""WITH {standins.PLIES_SQL}, e AS (SELECT *, game_id + ply AS o FROM plies),
    pc AS (SELECT o, count(*) AS n_pieces FROM (SELECT o, i, {standins.SQUARE} AS ch FROM (SELECT o_orderkey AS o FROM orders), range(64) s(i)) WHERE ch <> '.' GROUP BY o),
    j AS (SELECT e.* REPLACE (CAST(e.o * 37 % 801 - 400 AS DOUBLE) AS eval_before), n_pieces FROM e JOIN pc ON pc.o = e.o),
    g AS (SELECT player, game_id, row_number() OVER (PARTITION BY player ORDER BY min(game_date), game_id) AS k FROM j GROUP BY player, game_id),
    w AS (SELECT *, lead(eval_before) OVER i AS nx, eval_before - lag(eval_before) OVER i AS delta FROM j WINDOW i AS (PARTITION BY player, game_id ORDER BY ply))
    SELECT w.player, w.game_id, ply, eval_before, n_pieces, CASE WHEN nx IS NOT NULL THEN greatest(eval_before + nx, 0) END AS cp_loss, clock_before / base_s AS clock_frac_remaining,
      delta AS eval_delta_1, k AS games_played_so_far, log_think_time, CASE WHEN eval_before > 300 THEN 'winning' WHEN eval_before < -300 THEN 'losing' ELSE 'balanced' END AS outcome_bucket,
      o % 3 = 0 AS in_book FROM w JOIN g ON g.player = w.player AND g.game_id = w.game_id""",
)
def assembled_features(t):
    # A game's plies stand on the positions of its own and the following orders.
    texts = materialise(standins.positions(t))
    plies = t.plies().drop("eval_before", "gap_1_2", "cp_loss", "is_mistake", "is_decided", "played_best_move", "n_moves_within_30cp", "low_time", "log_think_time")
    numbered = parse.move_index(plies.withColumns({"o": F.col("game_id") + F.col("ply"), "move_uci": F.lit("e2e4")})).join(texts, "o").drop("o")
    value = (F.col("o") * 37 % 801 - 400).cast("double")
    annotated = texts.select(
        "fen_before", value.alias("eval_before"), F.lit("d2d4").alias("best_move"), F.array(value, value - 20).alias("top_cps"),
        F.array(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("top_mate_ins"), F.lit(20.0).alias("gap_1_2"),
    )
    book = texts.where("o % 3 = 0").select("fen_before", F.array(F.lit("e2e4")).alias("book_moves"))
    facts = texts.select("fen_before", (F.col("o") % 4).alias("legal_moves"))
    return features.build(numbered, annotated, book=book, position_facts=facts)


# --- gold ----------------------------------------------------------------------------


def pool_recall(t):
    return ident.recall(judged(t))


def panels(t):
    rows, scored = players.pool(t), players.insight_rows(t)
    return build.profile_panels(rows, scored, players.live_ratings(t))


DIRECTORY_SQL = f"""{players.SCORED}, shares AS ({players.SHARES_SQL}), clu AS ({players.CLUTCH_SQL}), {players.PREMOVE_ROWS}, pre AS ({players.PREMOVE_SQL}),
base AS (SELECT player, count(DISTINCT game_id) AS n_games, min(game_date) AS date_min, max(game_date) AS date_max, arg_max(player_rating, (game_date, game_datetime, ply)) AS pr FROM pool GROUP BY player),
pol AS (SELECT player, avg(maia_is_top_choice::INT) AS top_rate, avg(maia_prob_played) AS mean_p FROM pool WHERE NOT is_suspect AND maia_prob_played IS NOT NULL GROUP BY player),
cl AS (SELECT player, avg(is_sacrifice::INT) AS sacrifice_rate, {", ".join(f"avg(think_time) FILTER (WHERE game_phase = '{p}') AS {p}_think, avg((game_phase = '{p}')::INT) AS {p}_share" for p in games.PHASES)} FROM pool WHERE NOT is_suspect GROUP BY player),
rec AS (SELECT label AS player, avg((vec_id % 3 = 0)::INT) AS recall FROM embeddings GROUP BY label)
SELECT CAST(base.player AS VARCHAR) AS username, CASE WHEN base.player < 5 THEN 1500 + base.player * 10 ELSE pr END AS current_rating, n_games, date_min, date_max, recall, premove_rate,
  {", ".join(f"{p}_think, {p}_share" for p in games.PHASES)}, {", ".join(f"{b}_share AS bucket_{b}" for b in insights.BUCKETS)}, sacrifice_rate,
  top_rate AS maia_top_choice_rate, mean_p AS maia_mean_prob_played, low_time_share, panic_rate_low_time, panic_rate_normal_time
FROM base LEFT JOIN shares USING (player) LEFT JOIN clu USING (player) LEFT JOIN pre USING (player) LEFT JOIN pol USING (player) LEFT JOIN cl USING (player) LEFT JOIN rec USING (player)"""
DIRECTORY_KINDS = " ".join(
    f"{c}:{'s' if c in ('username', 'date_min', 'date_max') else 'l' if c == 'n_games' else 'd'}" for c in gold.DIRECTORY_COLUMNS
)


def directory(t):
    p = panels(t)
    recall = t.embeddings.groupBy(F.col("label").alias("player")).agg(F.avg((F.col("vec_id") % 3 == 0).cast("double")).alias("recall"))
    return gold.directory(p["summary"], recall, p["premove"], p["phase_time"], p["buckets"], p["sacrifice"], p["maia"], p["clutch"])


@query("player_directory", "V1", DIRECTORY_KINDS, DIRECTORY_SQL)
def player_directory(t):
    return directory(t)


@query("player_search", "V2", "c_custkey:l username:s", "SELECT c_custkey, c_name AS username FROM customer WHERE lower(c_name) LIKE '%r#0000001%'")
def player_search(t):
    return gold.search(t.customer.select("c_custkey", F.col("c_name").alias("username")), "R#0000001")


@query(
    "cohort_summary", "V3",
    "n_games_total:l n_classes:l overall_accuracy:d balanced_accuracy:d recall_min:d recall_max:d recall_median:d confused_player:l confused_with:l most_confused_rate:d",
    f"""{SP}, r AS (SELECT player, count(*) AS n, avg(correct::INT) AS recall FROM pred GROUP BY player),
    c AS (SELECT p.player, predicted, count(*) AS m, count(*) / any_value(n) AS rate FROM pred p JOIN r ON r.player = p.player WHERE NOT correct GROUP BY 1, 2),
    w AS (SELECT arg_max(player, (rate, -m, player, predicted)) AS confused_player, arg_max(predicted, (rate, -m, player, predicted)) AS confused_with, max(rate) AS most_confused_rate FROM c)
    SELECT sum(n) AS n_games_total, count(*) AS n_classes, sum(n * recall) / sum(n) AS overall_accuracy, avg(recall) AS balanced_accuracy, min(recall) AS recall_min,
      max(recall) AS recall_max, quantile_cont(recall, 0.5) AS recall_median, any_value(confused_player) AS confused_player, any_value(confused_with) AS confused_with,
      any_value(most_confused_rate) AS most_confused_rate FROM r, w""",
)
def cohort_summary(t):
    return gold.cohort_summary(judged(t))


@query("profile_documents", "V4 S6 R1 R2 R3 R4 R5 R6 R7 R8 R10", "player:l document:s")
def profile_documents(t):
    nested = gold.profile_documents(panels(t))
    return nested.select("player", F.to_json(F.struct(*nested.columns)).alias("document"))


@query("full_build", "V4", "part:s document:s")
def full_build(t):
    from pacelens.operators import sessions

    # The stand-in's orders are short, so forty neighbouring ones make one game.
    merged = players.pool(t).withColumns({"ply": F.col("game_id") % 40 * 50 + F.col("ply"), "game_id": F.floor(F.col("game_id") / 40)})
    rows = sessions.experience(merged)
    ready = models.design(rows.withColumn("clock_frac_remaining", F.col("clock_before") / F.col("base_s")), players.WIDE)
    members = t.nation.where("n_nationkey < 10").select(
        F.lit("pool").alias("cohort"), F.col("n_nationkey").cast("bigint").alias("identity"), F.col("n_nationkey").cast("bigint").alias("source_player")
    )
    parts = build.full_build(ready, members, ["pool"], models.design_columns(players.WIDE), players.live_ratings(t))
    union = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), F.to_json(F.struct(*part.columns)).alias("document"))
        union = one if union is None else union.unionByName(one)
    return union
