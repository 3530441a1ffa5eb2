"""Work-queue, search-log, policy-log and engine-column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.operators import annotate, clocks, engine
from pacelens.plans.catalog import query
from pacelens.sources.standins import LINE_ORDER, PLIES_SQL

FEN = "'pos' || CAST(l_partkey AS STRING)"


def positions(t):
    return t.lineitem.select(F.expr(FEN).alias("fen_before"))


def finished(t):
    return t.part.where("p_size % 2 = 0").select(F.concat(F.lit("pos"), F.col("p_partkey").cast("string")).alias("fen_before"))


TODO_SQL = f"""todo AS (SELECT DISTINCT {FEN} AS fen_before FROM lineitem
  WHERE {FEN} NOT IN (SELECT 'pos' || CAST(p_partkey AS STRING) FROM part WHERE p_size % 2 = 0))"""


@query("annotation_queue", "N1", "fen_before:s", f"WITH {TODO_SQL} SELECT * FROM todo")
def annotation_queue(t):
    return annotate.todo(positions(t), finished(t))


@query(
    "annotation_chunks", "N2", "fen_before:s chunk:l",
    f"""WITH {TODO_SQL}, n AS (SELECT fen_before, row_number() OVER (ORDER BY fen_before) AS i, count(*) OVER () AS rows FROM todo)
    SELECT fen_before, (i - 1) // greatest(1, ceil(rows / greatest(6, rows // 40)))::BIGINT AS chunk FROM n""",
)
def annotation_chunks(t):
    return annotate.chunk_plan(annotate.todo(positions(t), finished(t)), workers=6, target=40)


@query(
    "checkpoint_merge", "N3", "user_id:l event_type:s value:d event_id:l",
    """WITH u AS (SELECT user_id, event_type, value, event_id, event_id AS load_seq FROM events WHERE event_id % 3 <> 0
      UNION ALL SELECT user_id, event_type, NULL, event_id, event_id FROM events WHERE event_id % 3 = 0)
    SELECT user_id, event_type, value, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY load_seq DESC) = 1""",
)
def checkpoint_merge(t):
    e = t.events.withColumn("load_seq", F.col("event_id"))
    old = e.where("event_id % 3 <> 0").select("user_id", "event_type", "value", "event_id", "load_seq")
    new = e.where("event_id % 3 = 0").select("user_id", "event_type", "event_id", "load_seq")
    return annotate.merge([old, new], ("user_id", "event_type"))


@query(
    "schema_fill", "N4", "column_name:s present:b n_rows:l n_filled:l",
    """SELECT unnest(['event_id', 'value', 'depth']) AS column_name, unnest([true, true, false]) AS present,
      count(*) AS n_rows, unnest([count(event_id), count(CASE WHEN event_type <> 'view' THEN value END), 0]) AS n_filled FROM events""",
)
def schema_fill(t):
    e = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return annotate.column_fill(e, ("event_id", "value", "depth"))


SCORE = "CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(floor(l_extendedprice / 10) - 5000 AS DOUBLE) END"
MATE = "CASE WHEN l_tax = 0.0 THEN CAST(CASE WHEN l_discount > 0.05 THEN l_linenumber ELSE -l_linenumber END AS INT) END"
CP_SQL = """CASE WHEN mate_in IS NULL THEN score_cp WHEN mate_in > 0 THEN 10000 - 100 * mate_in ELSE -10000 - 100 * mate_in END"""


@query(
    "score_centipawns", "N5", "l_orderkey:l mate_in:l cp:d",
    f"WITH s AS (SELECT l_orderkey, {SCORE} AS score_cp, {MATE} AS mate_in FROM lineitem) SELECT l_orderkey, mate_in, {CP_SQL} AS cp FROM s",
)
def score_centipawns(t):
    s = t.lineitem.select("l_orderkey", F.expr(SCORE).alias("score_cp"), F.expr(MATE).alias("mate_in"))
    return s.withColumn("cp", annotate.score_to_cp(F.col("score_cp"), F.col("mate_in")))


LOG = {
    "fen_before": FEN,
    "seq": "l_orderkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber",
    "depth": "CAST(1 + l_orderkey % 12 AS INT)",
    "multipv": "CAST(1 + l_suppkey % 4 AS INT)",
    "move": "chr(CAST(97 + l_suppkey % 8 AS INT)) || CAST(l_linenumber AS STRING) || chr(CAST(97 + l_orderkey % 8 AS INT)) || '4'",
    "score_cp": SCORE,
    "mate_in": MATE,
}
LINES_SQL = f"""log AS (SELECT {", ".join(f"{e} AS {c}" for c, e in LOG.items())} FROM lineitem),
scored AS (SELECT *, {CP_SQL} AS cp FROM log),
lines AS (SELECT fen_before, depth, multipv AS rank, seq, move, cp, mate_in FROM scored
  QUALIFY row_number() OVER (PARTITION BY fen_before, depth, multipv ORDER BY seq DESC, move DESC, cp DESC, mate_in DESC NULLS LAST) = 1)"""


def search_log(t):
    return t.lineitem.select(*[F.expr(e).alias(c) for c, e in LOG.items()])


@query(
    "search_log_latest", "N6", "fen_before:s depth:l rank:l seq:l move:s cp:d mate_in:l",
    f"WITH {LINES_SQL} SELECT * FROM lines",
)
def search_log_latest(t):
    return annotate.latest_lines(search_log(t))


FINAL_SQL = f"""{LINES_SQL}, final AS (SELECT * FROM lines
    QUALIFY row_number() OVER (PARTITION BY fen_before, rank ORDER BY seq DESC, move DESC, cp DESC, mate_in DESC NULLS LAST) = 1),
c AS (SELECT fen_before, list(cp ORDER BY cp DESC, rank) AS cps, list(move ORDER BY cp DESC, rank) AS moves,
    list(mate_in ORDER BY cp DESC, rank) AS mates FROM final GROUP BY fen_before)"""
CAND_SQL = """cps[1] AS eval_before, moves[1] AS best_move, cps[1] - cps[2] AS gap_1_2,
  CASE WHEN len(cps) > 1 THEN list_max(cps) - list_min(cps) END AS top_n_spread, array_to_string(moves, ' ') AS top_moves"""


@query(
    "search_candidates", "N7", "fen_before:s eval_before:d best_move:s gap_1_2:d top_n_spread:d top_moves:s",
    f"WITH {FINAL_SQL} SELECT fen_before, {CAND_SQL} FROM c",
)
def search_candidates(t):
    found = annotate.candidates(annotate.latest_lines(search_log(t)))
    return found.withColumn("top_moves", F.array_join("top_moves", " "))


UNSTABLE_SQL = """f AS (SELECT *, move <> lag(move) OVER (PARTITION BY fen_before ORDER BY depth) AS changed FROM lines WHERE rank = 1),
u AS (SELECT fen_before, max(depth) AS search_depth_reached,
    coalesce(max(depth) FILTER (WHERE changed), min(depth)) AS search_stable_depth,
    count(*) FILTER (WHERE changed) AS n_best_move_changes, max(cp) - min(cp) AS eval_swing_across_depth FROM f GROUP BY fen_before)"""
UNSTABLE = "search_depth_reached:l search_stable_depth:l n_best_move_changes:l eval_swing_across_depth:d"


@query("search_instability", "N8", f"fen_before:s {UNSTABLE}", f"WITH {LINES_SQL}, {UNSTABLE_SQL} SELECT * FROM u")
def search_instability(t):
    return annotate.instability(annotate.latest_lines(search_log(t)))


@query(
    "annotated_positions", "N6 N7 N8", f"fen_before:s eval_before:d best_move:s gap_1_2:d {UNSTABLE}",
    f"""WITH {FINAL_SQL}, {UNSTABLE_SQL} SELECT fen_before, {CAND_SQL}, coalesce(search_depth_reached, 12) AS search_depth_reached,
      coalesce(search_stable_depth, 12) AS search_stable_depth, coalesce(n_best_move_changes, 0) AS n_best_move_changes,
      coalesce(eval_swing_across_depth, 0) AS eval_swing_across_depth FROM c LEFT JOIN u USING (fen_before)""",
)
def annotated_positions(t):
    return annotate.reduce_search_log(search_log(t), depth=12)


BIN_SQL = "(SELECT 1100 + 100 * i FROM range(9) r(i) ORDER BY abs(1100 + 100 * i - {}), i LIMIT 1)"


@query(
    "rating_bins", "N9", "o_orderkey:l rating_bin:l",
    """WITH r AS (SELECT o_orderkey, floor(o_totalprice / 100) AS rating FROM orders)
    SELECT o_orderkey, min_by(b, (abs(b - rating), b)) AS rating_bin FROM r, (SELECT 1100 + 100 * i AS b FROM range(9) t(i)) GROUP BY o_orderkey""",
)
def rating_bins(t):
    return t.orders.select("o_orderkey", annotate.rating_bin(F.floor(F.col("o_totalprice") / 100).cast("double")).alias("rating_bin"))


RATED = "CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(900 + l_partkey * 37 % 1200 AS DOUBLE) END"


def rated_positions(t):
    return t.lineitem.select(F.expr(FEN).alias("fen_before"), F.expr(RATED).alias("player_rating"))


def finished_pairs(t):
    return t.part.select(
        F.concat(F.lit("pos"), F.col("p_partkey").cast("string")).alias("fen_before"),
        (1100 + 100 * (F.col("p_partkey") % 9)).cast("int").alias("maia_rating_bin"),
    )


POLICY_TODO_SQL = f"""q AS (SELECT DISTINCT {FEN} AS fen_before, CAST(least(1900, greatest(1100, ceil(({RATED} - 50) / 100) * 100)) AS INT) AS maia_rating_bin
    FROM lineitem WHERE {RATED} IS NOT NULL),
todo AS (SELECT * FROM q EXCEPT SELECT 'pos' || CAST(p_partkey AS STRING), CAST(1100 + 100 * (p_partkey % 9) AS INT) FROM part)"""


@query("policy_queue", "N10", "fen_before:s maia_rating_bin:l", f"WITH {POLICY_TODO_SQL} SELECT * FROM todo")
def policy_queue(t):
    return annotate.policy_todo(rated_positions(t), finished_pairs(t))


@query(
    "policy_queue_counts", "N10", "maia_rating_bin:l n_positions:l",
    f"WITH {POLICY_TODO_SQL} SELECT maia_rating_bin, count(*) AS n_positions FROM todo GROUP BY 1",
)
def policy_queue_counts(t):
    return annotate.bin_counts(annotate.policy_todo(rated_positions(t), finished_pairs(t)))


POLICY_LOG = {
    "fen_before": FEN,
    "rating_bin": "CAST(1100 + 100 * (l_suppkey % 9) AS INT)",
    "seq": LOG["seq"],
    "line": f"""CASE WHEN l_discount = 0.03 THEN 'node  (  20) N: 1 (P: 3.00%)' WHEN l_discount = 0.04 THEN {LOG['move']} || ' (Q: 0.1)'
      ELSE '  ' || {LOG['move']} || '  (  616) N:      1 (+ 0.00%) (P: ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.' || CAST(l_linenumber AS STRING) || '%) (Q: 0.2)' END""",
}
POLICY_SQL = f"""raw AS (SELECT {", ".join(f"{e} AS {c}" for c, e in POLICY_LOG.items())} FROM lineitem),
parsed AS (SELECT fen_before, rating_bin, seq, regexp_extract(trim(line), '^(\\S+)', 1) AS move,
    TRY_CAST(regexp_extract(line, 'P:\\s*([0-9.]+)\\s*%', 1) AS DOUBLE) / 100 AS prob FROM raw
  WHERE regexp_matches(trim(line), '^[a-h][1-8][a-h][1-8][qrbn]?(\\s|$)') AND contains(line, 'P:')),
policy AS (SELECT fen_before, rating_bin AS maia_rating_bin, move, prob FROM parsed
  QUALIFY row_number() OVER (PARTITION BY fen_before, rating_bin, move ORDER BY seq DESC, prob DESC) = 1)"""


def policy_log(t):
    return t.lineitem.select(*[F.expr(e).alias(c) for c, e in POLICY_LOG.items()])


@query("policy_log_moves", "N11", "fen_before:s maia_rating_bin:l move:s prob:d", f"WITH {POLICY_SQL} SELECT * FROM policy")
def policy_log_moves(t):
    p = annotate.parse_policy_log(policy_log(t))
    zipped = F.arrays_zip(F.col("maia_moves").alias("m"), F.col("maia_probs").alias("p"))
    return p.select("fen_before", "maia_rating_bin", F.inline(zipped)).withColumnsRenamed({"m": "move", "p": "prob"})


# --- columns from candidate arrays -------------------------------------------------

CAND = {
    "order_id": "l_orderkey",
    "x": "CAST(l_partkey % 901 - 450 AS DOUBLE)",
    "g1": "CAST(l_suppkey % 60 AS DOUBLE)",
    "g2": "CAST(l_suppkey % 130 AS DOUBLE)",
    "g3": "CAST(l_partkey % 70 AS DOUBLE)",
    "n": "CAST(1 + l_partkey % 4 AS INT)",
    "m1": "CASE WHEN l_tax = 0.0 THEN CAST(l_linenumber - 3 AS INT) END",
    "m2": "CASE WHEN l_tax = 0.0 AND l_discount < 0.05 THEN CAST(3 - l_linenumber + l_suppkey % 5 AS INT) END",
    "move_uci": LOG["move"],
    "best_move": "chr(CAST(97 + l_suppkey % 8 AS INT)) || CAST(l_linenumber AS STRING) || 'd4'",
}
CAND_COLUMNS = (
    "move_value_entropy:d n_moves_within_30cp:l n_moves_within_100cp:l abs_eval:d is_decided:b outcome_bucket:s "
    "outcome_changes:b mate_distance_gap:d played_best_move:b"
)


def bucket_sql(cp: str, mate: str) -> str:
    return (
        f"CASE WHEN {mate} > 0 THEN 'mate_for' WHEN {mate} <= 0 THEN 'mate_against' WHEN {cp} > 300 THEN 'winning' "
        f"WHEN {cp} < -300 THEN 'losing' ELSE 'balanced' END"
    )


CAND_ROWS_SQL = f"""raw AS (SELECT {", ".join(f"{e} AS {c}" for c, e in CAND.items())}, row_number() OVER (ORDER BY l_orderkey, {", ".join(LINE_ORDER)}) AS rid FROM lineitem),
arr AS (SELECT *, list_value(x, x - g1, x - g1 - g2, x - g1 - g2 - g3)[1:n] AS cps FROM raw),
long AS (SELECT rid, unnest(cps) AS c, cps[1] AS best FROM arr),
agg AS (SELECT rid, sum(exp((c - best) / 100)) AS z, count(*) FILTER (WHERE best - c <= 30) AS within30,
    count(*) FILTER (WHERE best - c <= 100) AS within100 FROM long GROUP BY rid),
ent AS (SELECT rid, -sum(exp((c - best) / 100) / z * log2(exp((c - best) / 100) / z)) AS bits FROM long JOIN agg USING (rid) GROUP BY rid),
cand AS (SELECT order_id, CASE WHEN n = 1 THEN 0 ELSE bits END AS move_value_entropy, within30 AS n_moves_within_30cp,
    within100 AS n_moves_within_100cp, abs(x) AS abs_eval, abs(x) > 300 AS is_decided, {bucket_sql("x", "m1")} AS outcome_bucket,
    CASE WHEN n > 1 THEN {bucket_sql("x", "m1")} <> {bucket_sql("x - g1", "m2")} END AS outcome_changes,
    CASE WHEN n > 1 AND (m1 > 0) = (m2 > 0) THEN abs(abs(m1) - abs(m2)) END AS mate_distance_gap, move_uci = best_move AS played_best_move,
    CASE WHEN n > 1 THEN x - list_min(cps) END AS top_n_spread
  FROM arr JOIN agg USING (rid) JOIN ent USING (rid))"""


def candidate_rows(t):
    raw = t.lineitem.select(*[F.expr(e).alias(c) for c, e in CAND.items()])
    values = F.expr("slice(array(x, x - g1, x - g1 - g2, x - g1 - g2 - g3), 1, n)")
    return raw.withColumns({"top_cps": values, "top_mate_ins": F.expr("slice(array(m1, m2, NULL, NULL), 1, n)")})


@query("candidate_features", "E1 E2 E3 E4 E5", f"order_id:l {CAND_COLUMNS}", f"WITH {CAND_ROWS_SQL} SELECT * FROM cand")
def candidate_features(t):
    return engine.candidate_features(candidate_rows(t))


@query(
    "outcome_buckets", "E1", "l_orderkey:l outcome_bucket:s",
    f"WITH s AS (SELECT l_orderkey, {SCORE} / 10 AS cp, {MATE} AS mate_in FROM lineitem) SELECT l_orderkey, {bucket_sql('cp', 'mate_in')} AS outcome_bucket FROM s",
)
def outcome_buckets(t):
    return t.lineitem.select("l_orderkey", engine.outcome_bucket(F.expr(f"{SCORE} / 10"), F.expr(MATE)).alias("outcome_bucket"))


@query("candidate_entropy", "E2", "order_id:l move_value_entropy:d", f"WITH {CAND_ROWS_SQL} SELECT order_id, move_value_entropy FROM cand")
def candidate_entropy(t):
    return candidate_rows(t).withColumn("move_value_entropy", engine.move_value_entropy(F.col("top_cps")))


@query("candidate_spread", "E3", "order_id:l top_n_spread:d", f"WITH {CAND_ROWS_SQL} SELECT order_id, top_n_spread FROM cand")
def candidate_spread(t):
    return candidate_rows(t).withColumn("top_n_spread", engine.candidate_spread(F.col("top_cps")))


@query(
    "annotated_plies", "E6", "l_orderkey:l l_linenumber:l fen_before:s eval_before:d best_move:s",
    f"""WITH {FINAL_SQL} SELECT l_orderkey, l_linenumber, c.fen_before, cps[1] AS eval_before, moves[1] AS best_move
    FROM lineitem JOIN c ON c.fen_before = {FEN}""",
)
def annotated_plies(t):
    plies = t.lineitem.select("l_orderkey", "l_linenumber", F.expr(FEN).alias("fen_before"))
    return engine.join_annotations(plies, annotate.candidates(annotate.latest_lines(search_log(t))))


def booked(t):
    """Plies with a position name and a move; the parts form the book."""
    plies = t.plies().select("player", "game_id", "ply", "eval_before", "maia_surprise", "player_rating")
    return plies.select(
        "player", "game_id", "ply", "player_rating",
        F.concat(F.lit("e"), F.col("eval_before").cast("int").cast("string")).alias("fen_before"),
        F.concat(F.lit("m"), (F.col("maia_surprise") * 4).cast("int").cast("string")).alias("move_uci"),
        F.concat(F.lit("m"), (F.col("ply") % 13).cast("string")).alias("best_move"),
    )


BOOKED_SQL = f"""{PLIES_SQL}, b AS (SELECT player, game_id, ply, player_rating, 'e' || CAST(CAST(eval_before AS INT) AS VARCHAR) AS fen_before,
  'm' || CAST(CAST(maia_surprise * 4 AS INT) AS VARCHAR) AS move_uci, 'm' || CAST(ply % 13 AS VARCHAR) AS best_move FROM plies)"""


def opening_book(t):
    key = (F.col("p_partkey") % 801 - 400).cast("string")
    move = F.concat(F.lit("m"), (F.col("p_partkey") % 13).cast("string"))
    entries = t.part.select(F.concat(F.lit("e"), key).alias("fen_before"), move.alias("m"))
    return entries.groupBy("fen_before").agg(F.collect_set("m").alias("book_moves"))


@query(
    "book_columns", "L1 L2", "player:l game_id:l ply:l in_book:b played_book_move:b plies_since_book:l",
    f"""WITH {BOOKED_SQL}, k AS (SELECT 'e' || CAST(p_partkey % 801 - 400 AS VARCHAR) AS f, list('m' || CAST(p_partkey % 13 AS VARCHAR)) AS ms
      FROM part GROUP BY 1),
    j AS (SELECT b.*, ms IS NOT NULL AS in_book, coalesce(list_contains(ms, move_uci), false) AS played_book_move FROM b LEFT JOIN k ON f = fen_before),
    g AS (SELECT *, sum(in_book::INT) OVER (PARTITION BY player, game_id ORDER BY ply) AS grp FROM j)
    SELECT player, game_id, ply, in_book, played_book_move, row_number() OVER (PARTITION BY player, game_id, grp ORDER BY ply)
      - CASE WHEN grp = 0 THEN 0 ELSE 1 END AS plies_since_book FROM g""",
)
def book_columns(t):
    return engine.book_features(booked(t), opening_book(t))


def standin_policy(t):
    """Policies keyed by position and bin, from parts: six moves with distinct chances."""
    p = t.part.select(
        F.concat(F.lit("e"), (F.col("p_partkey") % 801 - 400).cast("string")).alias("fen_before"),
        (1100 + 100 * (F.col("p_partkey") % 9)).cast("int").alias("rating_bin"), F.col("p_partkey").alias("seq"),
        F.concat(F.lit("m"), (F.col("p_partkey") * 5 % 13).cast("string")).alias("move"),
        ((F.col("p_size") % 32) / 64.0 + F.col("p_partkey") % 13 / 1024.0).alias("prob"),
    )
    moves = p.groupBy("fen_before", "rating_bin", "move").agg(F.max(F.struct("seq", "prob")).alias("l"))
    listed = moves.groupBy("fen_before", F.col("rating_bin").alias("maia_rating_bin")).agg(
        F.array_sort(F.collect_list(F.struct("move", F.col("l.prob").alias("prob")))).alias("m")
    )
    return listed.select("fen_before", "maia_rating_bin", F.col("m.move").alias("maia_moves"), F.col("m.prob").alias("maia_probs"))


@query(
    "policy_columns", "L5",
    "player:l game_id:l ply:l maia_prob_played:d maia_top1_prob:d maia_is_top_choice:b maia_surprise:d maia_prob_best_move:d requires_overriding_instinct:b",
    f"""WITH {BOOKED_SQL}, raw AS (SELECT 'e' || CAST(p_partkey % 801 - 400 AS VARCHAR) AS f, 1100 + 100 * (p_partkey % 9) AS bin,
      'm' || CAST(p_partkey * 5 % 13 AS VARCHAR) AS move, (p_size % 32) / 64.0 + p_partkey % 13 / 1024.0 AS prob, p_partkey FROM part),
    pol AS (SELECT f, bin, move, prob FROM raw QUALIFY row_number() OVER (PARTITION BY f, bin, move ORDER BY p_partkey DESC) = 1),
    top AS (SELECT f, bin, max(prob) AS tp, arg_max(move, (prob, 'z')) AS dummy, count(*) AS c FROM pol GROUP BY f, bin),
    topm AS (SELECT f, bin, min(move) AS tm FROM pol JOIN top USING (f, bin) WHERE prob = tp GROUP BY f, bin),
    r AS (SELECT b.*, CAST(least(1900, greatest(1100, ceil((player_rating - 50) / 100) * 100)) AS INT) AS bin FROM b),
    j AS (SELECT r.*, tp, tm, CASE WHEN tp IS NOT NULL THEN coalesce(p1.prob, 0) END AS pp, CASE WHEN tp IS NOT NULL THEN coalesce(p2.prob, 0) END AS bp
      FROM r LEFT JOIN top ON top.f = fen_before AND top.bin = r.bin LEFT JOIN topm ON topm.f = fen_before AND topm.bin = r.bin
      LEFT JOIN pol p1 ON p1.f = fen_before AND p1.bin = r.bin AND p1.move = move_uci
      LEFT JOIN pol p2 ON p2.f = fen_before AND p2.bin = r.bin AND p2.move = best_move)
    SELECT player, game_id, ply, pp AS maia_prob_played, tp AS maia_top1_prob, move_uci = tm AS maia_is_top_choice,
      CASE WHEN pp IS NOT NULL THEN -ln(greatest(pp, 1e-6)) END AS maia_surprise, bp AS maia_prob_best_move, best_move <> tm AND bp < 0.1 AS requires_overriding_instinct FROM j""",
)
def policy_columns(t):
    return engine.policy_features(annotate.with_rating_bin(booked(t)), standin_policy(t))


@query(
    "sacrifice_flags", "L4", "player:l game_id:l ply:l is_sacrifice:b",
    f"""WITH {PLIES_SQL} SELECT player, game_id, ply, n_captures_available + 1 >= 3 AND NOT (is_recapture OR is_forced) AND cp_loss <= 100 AS is_sacrifice FROM plies""",
)
def sacrifice_flags(t):
    return engine.sacrifice(t.plies().withColumn("material_offered", F.col("n_captures_available") + 1))


@query(
    "endgame_table_columns", "L3", "player:l game_id:l ply:l tb_wdl:l tb_dtz:l tb_move_optimal:b",
    f"""WITH {BOOKED_SQL}, n AS (SELECT *, lead(fen_before) OVER (PARTITION BY player, game_id ORDER BY ply) AS fen_after, 3 + ply % 4 AS n_pieces FROM b),
    k AS (SELECT 'e' || CAST(p_partkey % 801 - 400 AS VARCHAR) AS fen, max(p_size % 5 - 2) AS wdl, max(p_size) AS dtz FROM part GROUP BY 1)
    SELECT player, game_id, ply, CASE WHEN n_pieces <= 5 THEN a.wdl END AS tb_wdl, CASE WHEN n_pieces <= 5 THEN a.dtz END AS tb_dtz,
      -z.wdl >= CASE WHEN n_pieces <= 5 THEN a.wdl END AS tb_move_optimal
    FROM n LEFT JOIN k a ON a.fen = fen_before LEFT JOIN k z ON z.fen = fen_after""",
)
def endgame_table_columns(t):
    from pyspark.sql import Window

    in_game = Window.partitionBy("player", "game_id").orderBy("ply")
    plies = booked(t).withColumns({"fen_after": F.lead("fen_before").over(in_game), "n_pieces": 3 + F.col("ply") % 4})
    probes = (
        t.part.groupBy(F.concat(F.lit("e"), (F.col("p_partkey") % 801 - 400).cast("string")).alias("fen"))
        .agg(F.max(F.col("p_size") % 5 - 2).alias("wdl"), F.max("p_size").alias("dtz"))
    )
    return engine.endgame_features(plies, probes)


@query(
    "loss_grades", "C4", "player:l game_id:l ply:l is_inaccuracy:b is_mistake:b is_blunder:b",
    f"WITH {PLIES_SQL} SELECT player, game_id, ply, cp_loss > 50 AS is_inaccuracy, cp_loss > 100 AS is_mistake, cp_loss > 300 AS is_blunder FROM plies",
)
def loss_grades(t):
    return t.plies().withColumns(clocks.loss_grades(F.col("cp_loss")))
