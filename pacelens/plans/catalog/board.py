"""Board queries: positions built from order numbers, checked by joining pieces in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelens.functions.storage import materialise
from pacelens.operators import board, engine
from pacelens.plans.catalog import query
from pacelens.sources import standins

# The oracle never sees the text: it lists pieces straight from the generator and
# answers every question by joining pieces of a position with each other.
PIECES = f"""sq AS (SELECT o, i, i % 8 AS f, 7 - i // 8 AS r, {standins.SQUARE} AS ch FROM (SELECT o_orderkey AS o FROM orders), range(64) s(i)),
pieces AS (SELECT o, i, f, r, CASE WHEN ch = upper(ch) THEN 'w' ELSE 'b' END AS side, lower(ch) AS t,
    CASE lower(ch) WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END AS v FROM sq WHERE ch <> '.'),
pos AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN 'w' ELSE 'b' END AS mover FROM orders)"""
LINES = """pair AS (SELECT p.o, p.i AS pi, p.side, p.t, p.v, q.i AS qi, q.side AS qside, q.t AS qt, q.v AS qv, q.f - p.f AS x, q.r - p.r AS y FROM pieces p JOIN pieces q ON q.o = p.o AND q.i <> p.i),
aligned AS (SELECT *, sign(x) AS dx, sign(y) AS dy, greatest(abs(x), abs(y)) AS step FROM pair WHERE x = 0 OR y = 0 OR abs(x) = abs(y)),
seen AS (SELECT *, row_number() OVER (PARTITION BY o, pi, dx, dy ORDER BY step) AS nth FROM aligned QUALIFY nth <= 2),
slides AS (SELECT *, CASE WHEN dx = 0 OR dy = 0 THEN t IN ('r', 'q') ELSE t IN ('b', 'q') END AS slider FROM seen)"""
# Attacks on chosen target squares: occupied squares and the squares around kings.
ATTACKS = f"""{LINES}, zone AS (SELECT k.o, k.side AS kside, s.i, s.f, s.r FROM pieces k JOIN sq s ON s.o = k.o AND abs(s.f - k.f) <= 1 AND abs(s.r - k.r) <= 1 WHERE k.t = 'k'),
targets AS (SELECT DISTINCT o, i, f, r FROM zone UNION SELECT o, i, f, r FROM pieces),
reach AS (SELECT p.o, p.i AS pi, p.side, p.t, q.i AS qi, q.f - p.f AS x, q.r - p.r AS y FROM pieces p JOIN targets q ON q.o = p.o AND q.i <> p.i),
blocked AS (SELECT o, pi, dx, dy, step AS first FROM seen WHERE nth = 1),
att AS (SELECT DISTINCT e.o, e.qi AS i, e.side FROM reach e LEFT JOIN blocked b ON b.o = e.o AND b.pi = e.pi AND b.dx = sign(x) AND b.dy = sign(y)
    AND (x = 0 OR y = 0 OR abs(x) = abs(y))
  WHERE (t = 'n' AND abs(x) * abs(y) = 2) OR (t = 'k' AND greatest(abs(x), abs(y)) = 1)
    OR (t = 'p' AND abs(x) = 1 AND y = CASE WHEN side = 'w' THEN 1 ELSE -1 END)
    OR (t IN ('r', 'q') AND (x = 0 OR y = 0) AND greatest(abs(x), abs(y)) <= coalesce(first, 9))
    OR (t IN ('b', 'q') AND abs(x) = abs(y) AND abs(x) <= coalesce(first, 9)))"""


def counts_sql(source: str, own: str, opp: str) -> str:
    return f"""SELECT pos.o AS order_id, count(*) FILTER (WHERE s.side = mover) AS {own}, count(*) FILTER (WHERE s.side <> mover) AS {opp}
      FROM pos LEFT JOIN ({source}) s ON s.o = pos.o GROUP BY pos.o"""


def bits(t):
    return board.bitboards(standins.positions(t)).withColumnRenamed("o", "order_id")


@query(
    "board_material", "B1 B2", "order_id:l total_material:d material_diff:d n_pieces:l pawn_count:l",
    f"""WITH {PIECES} SELECT pos.o AS order_id, sum(v) AS total_material, sum(CASE WHEN side = mover THEN v ELSE -v END) AS material_diff,
      count(*) AS n_pieces, count(*) FILTER (WHERE t = 'p') AS pawn_count FROM pos JOIN pieces USING (o) GROUP BY pos.o""",
)
def board_material(t):
    return board.material(bits(t))


@query(
    "board_phase", "B2 B3", "order_id:l halfmove_clock:l has_castled_rights:b is_endgame:b game_phase:s",
    f"""WITH {PIECES}, m AS (SELECT o, sum(v) AS m FROM pieces GROUP BY o)
    SELECT pos.o AS order_id, pos.o % 50 AS halfmove_clock, pos.o % 3 <> 0 AS has_castled_rights, m <= 20 AS is_endgame,
      CASE WHEN m <= 20 THEN 'endgame' WHEN 1 + pos.o % 60 <= 12 THEN 'opening' ELSE 'middlegame' END AS game_phase FROM pos JOIN m USING (o)""",
)
def board_phase(t):
    return board.phase(board.fen_fields(board.material(bits(t))))


@query(
    "board_pawn_files", "B4", "order_id:l open_files:l half_open_files:l blocked_pawns:l blocked_pawn_frac:d",
    f"""WITH {PIECES}, g AS (SELECT o, f, bool_or(side = 'w') AS w, bool_or(side = 'b') AS b FROM pieces WHERE t = 'p' GROUP BY o, f),
    h AS (SELECT o, count(*) AS used, count(*) FILTER (WHERE w <> b) AS half FROM g GROUP BY o),
    k AS (SELECT a.o, 2 * count(*) AS blocked FROM pieces a JOIN pieces z ON z.o = a.o AND z.f = a.f AND z.r = a.r + 1 WHERE a.t = 'p' AND z.t = 'p' AND a.side = 'w' AND z.side = 'b' GROUP BY a.o),
    c AS (SELECT o, count(*) AS pawns FROM pieces WHERE t = 'p' GROUP BY o)
    SELECT pos.o AS order_id, 8 - coalesce(used, 0) AS open_files, coalesce(half, 0) AS half_open_files, coalesce(blocked, 0) AS blocked_pawns,
      coalesce(coalesce(blocked, 0) / pawns, 0) AS blocked_pawn_frac FROM pos LEFT JOIN h USING (o) LEFT JOIN k USING (o) LEFT JOIN c USING (o)""",
)
def board_pawn_files(t):
    return board.pawn_structure(bits(t))


PASSED = """SELECT p.o, p.side FROM pieces p WHERE p.t = 'p' AND NOT EXISTS (SELECT 1 FROM pieces e WHERE e.o = p.o AND e.t = 'p' AND e.side <> p.side
  AND abs(e.f - p.f) <= 1 AND (e.r - p.r) * CASE WHEN p.side = 'w' THEN 1 ELSE -1 END > 0)"""


@query("board_passed_pawns", "B5", "order_id:l own_passed_pawns:l opp_passed_pawns:l", f"WITH {PIECES} {counts_sql(PASSED, 'own_passed_pawns', 'opp_passed_pawns')}")
def board_passed_pawns(t):
    return board.pawn_structure(bits(t))


@query(
    "board_bishop_pairs", "B6", "order_id:l own_bishop_pair:b opp_bishop_pair:b",
    f"""WITH {PIECES} SELECT pos.o AS order_id, count(*) FILTER (WHERE t = 'b' AND side = mover) >= 2 AS own_bishop_pair,
      count(*) FILTER (WHERE t = 'b' AND side <> mover) >= 2 AS opp_bishop_pair FROM pos JOIN pieces USING (o) GROUP BY pos.o""",
)
def board_bishop_pairs(t):
    return board.pawn_structure(bits(t))


WEAK = ("doubled_pawns", "isolated_pawns", "pawn_islands")


@query(
    "board_pawn_weaknesses", "B7", "order_id:l " + " ".join(f"own_{n}:l opp_{n}:l" for n in WEAK),
    f"""WITH {PIECES}, g AS (SELECT o, side, f, count(*) AS n FROM pieces WHERE t = 'p' GROUP BY o, side, f),
    h AS (SELECT *, lag(f) OVER w AS before, lead(f) OVER w AS after FROM g WINDOW w AS (PARTITION BY o, side ORDER BY f)),
    k AS (SELECT o, side, sum(n - 1) AS doubled_pawns, count(*) FILTER (WHERE coalesce(before, -9) <> f - 1 AND coalesce(after, 99) <> f + 1) AS isolated_pawns,
      count(*) FILTER (WHERE coalesce(before, -9) <> f - 1) AS pawn_islands FROM h GROUP BY o, side)
    SELECT pos.o AS order_id, {", ".join(f"coalesce(a.{n}, 0) AS own_{n}, coalesce(z.{n}, 0) AS opp_{n}" for n in WEAK)}
    FROM pos LEFT JOIN k a ON a.o = pos.o AND a.side = mover LEFT JOIN k z ON z.o = pos.o AND z.side <> mover""",
)
def board_pawn_weaknesses(t):
    return board.pawn_structure(bits(t))


LOOSE = """SELECT p.o, p.side FROM pieces p WHERE t <> 'k' AND EXISTS (SELECT 1 FROM att a WHERE a.o = p.o AND a.i = p.i AND a.side <> p.side)
  AND NOT EXISTS (SELECT 1 FROM att a WHERE a.o = p.o AND a.i = p.i AND a.side = p.side)"""
ZONE = "SELECT z.o, z.kside AS side FROM zone z JOIN att a ON a.o = z.o AND a.i = z.i AND a.side <> z.kside"


@query("board_loose_pieces", "B8", "order_id:l loose_own:l loose_opp:l", f"WITH {PIECES}, {ATTACKS} {counts_sql(LOOSE, 'loose_own', 'loose_opp')}")
def board_loose_pieces(t):
    return board.safety(board.attacks(bits(t)))


@query("board_king_zones", "B9", "order_id:l king_attackers_own:l king_attackers_opp:l", f"WITH {PIECES}, {ATTACKS} {counts_sql(ZONE, 'king_attackers_own', 'king_attackers_opp')}")
def board_king_zones(t):
    return board.safety(board.attacks(bits(t)))


PINNED = """SELECT a.o, a.side FROM seen a JOIN seen b ON b.o = a.o AND b.pi = a.pi AND b.dx = a.dx AND b.dy = a.dy AND a.nth = 1 AND b.nth = 2
  WHERE a.t = 'k' AND a.qside = a.side AND b.qside <> a.side AND CASE WHEN a.dx = 0 OR a.dy = 0 THEN b.qt IN ('r', 'q') ELSE b.qt IN ('b', 'q') END"""


@query("board_pins", "B10", "order_id:l own_pinned:l opp_pinned:l", f"WITH {PIECES}, {LINES} {counts_sql(PINNED, 'own_pinned', 'opp_pinned')}")
def board_pins(t):
    return board.pins(bits(t))


FORKS = """SELECT o, side FROM (
    SELECT o, pi, side, qside, qt FROM slides WHERE slider AND nth = 1
    UNION ALL SELECT o, pi, side, qside, qt FROM pair WHERE (t = 'n' AND abs(x) * abs(y) = 2) OR (t = 'p' AND abs(x) = 1 AND y = CASE WHEN side = 'w' THEN 1 ELSE -1 END))
  WHERE qside <> side AND qt <> 'k' GROUP BY o, pi, side HAVING count(*) >= 2"""


@query("board_forks", "B11", "order_id:l own_forking_pieces:l opp_forking_pieces:l", f"WITH {PIECES}, {LINES} {counts_sql(FORKS, 'own_forking_pieces', 'opp_forking_pieces')}")
def board_forks(t):
    return board.forks(bits(t))


SKEWERED = """SELECT a.o, a.side FROM slides a JOIN slides b ON b.o = a.o AND b.pi = a.pi AND b.dx = a.dx AND b.dy = a.dy AND a.nth = 1 AND b.nth = 2
  WHERE a.slider AND a.qside <> a.side AND b.qside <> a.side AND a.qt <> 'k' AND b.qt <> 'k' AND a.qv > b.qv"""


@query("board_skewers", "B12", "order_id:l own_skewers:l opp_skewers:l", f"WITH {PIECES}, {LINES} {counts_sql(SKEWERED, 'own_skewers', 'opp_skewers')}")
def board_skewers(t):
    return board.skewers(bits(t))


FACTS = """'pos' || CAST(l_partkey AS STRING) AS fen_before, CAST(l_suppkey % 3 AS INT) AS legal_moves, CAST(l_suppkey % 5 AS STRING) AS n_checks_available,
  CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE '2' END AS n_captures_available, l_partkey % 7 = 0 AS in_check"""


@query("forced_positions", "B13", "l_orderkey:l is_forced:b", "SELECT l_orderkey, l_suppkey % 3 = 1 AS is_forced FROM lineitem")
def forced_positions(t):
    return board.forced(t.lineitem.withColumn("legal_moves", F.col("l_suppkey") % 3))


@query(
    "position_fact_gaps", "B14", "fact:s n_positions:l n_missing:l",
    """SELECT unnest(['legal_moves', 'n_checks_available', 'n_captures_available', 'n_promotions_available', 'in_check', 'n_discovered_check_moves', 'n_double_check_moves']) AS fact,
      count(*) AS n_positions, unnest([0, 0, count(*) FILTER (WHERE l_partkey % 4 = 0), count(*), 0, count(*), count(*)]) AS n_missing FROM lineitem""",
)
def position_fact_gaps(t):
    return board.fact_gaps(board.typed_facts(t.lineitem.selectExpr(*[c.strip() for c in _split_columns(FACTS)])))


def _split_columns(text: str) -> list[str]:
    return [c.replace("\n", " ") for c in text.split(", ")] if "(" not in text else _balanced(text)


def _balanced(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


@query(
    "position_features", "B15", "order_id:l total_material:d n_pieces:l pawn_count:l game_phase:s is_forced:b legal_moves:l",
    f"""WITH {PIECES}, m AS (SELECT o, sum(v) AS m, count(*) AS n, count(*) FILTER (WHERE t = 'p') AS pawns FROM pieces GROUP BY o)
    SELECT pos.o AS order_id, m AS total_material, n AS n_pieces, pawns AS pawn_count,
      CASE WHEN m <= 20 THEN 'endgame' WHEN 1 + pos.o % 60 <= 12 THEN 'opening' ELSE 'middlegame' END AS game_phase,
      pos.o % 4 = 1 AS is_forced, pos.o % 4 AS legal_moves FROM pos JOIN m USING (o)""",
)
def position_features(t):
    plies = materialise(standins.positions(t)).withColumnRenamed("o", "order_id")
    facts = plies.select("fen_before", (F.col("order_id") % 4).alias("legal_moves"))
    return board.with_position_features(plies, facts)


HANGING = f"""WITH {PIECES}, {ATTACKS}, l AS (SELECT p.o, p.v FROM pieces p JOIN pos USING (o) WHERE t <> 'k' AND p.side <> mover
    AND EXISTS (SELECT 1 FROM att a WHERE a.o = p.o AND a.i = p.i AND a.side <> p.side) AND NOT EXISTS (SELECT 1 FROM att a WHERE a.o = p.o AND a.i = p.i AND a.side = p.side))"""


@query(
    "material_offered", "L4", "order_id:l material_offered:d is_sacrifice:b",
    f"""{HANGING} SELECT pos.o AS order_id, coalesce(max(v), 0) AS material_offered, coalesce(max(v), 0) >= 3 AND pos.o % 5 <> 0 AND pos.o % 7 <> 0 AND pos.o % 150 <= 100 AS is_sacrifice
    FROM pos LEFT JOIN l USING (o) GROUP BY pos.o""",
)
def material_offered(t):
    o = F.col("o")
    plies = materialise(standins.positions(t)).select(
        o.alias("order_id"), F.col("fen_before").alias("fen_after"), (o % 5 == 0).alias("is_recapture"),
        (o % 7 == 0).alias("is_forced"), (o % 150).cast("double").alias("cp_loss"),
    )
    return engine.sacrifice(board.material_offered(plies))


@query(
    "target_pieces", "A15", "order_id:l target_piece:l advancement:l",
    f"""WITH {PIECES}, q AS (SELECT o, o % 8 AS f, 7 - (o // 8) % 8 AS r FROM pos)
    SELECT q.o AS order_id, CASE p.t WHEN 'p' THEN 1 WHEN 'n' THEN 2 WHEN 'b' THEN 3 WHEN 'r' THEN 4 WHEN 'q' THEN 5 WHEN 'k' THEN 6 ELSE 0 END AS target_piece,
      CASE WHEN q.o % 2 = 0 THEN q.r ELSE 7 - q.r END AS advancement FROM q LEFT JOIN pieces p ON p.o = q.o AND p.f = q.f AND p.r = q.r""",
)
def target_pieces(t):
    from pacelens.operators import anomaly

    o = F.col("o")
    square = F.concat(F.char((97 + o % 8).cast("bigint")), (8 - F.floor(o / 8) % 8).cast("string"))
    plies = standins.positions(t).select(
        o.alias("order_id"), o.alias("player"), o.alias("game_id"), (o % 2).alias("ply"), "fen_before", F.concat(F.lit("a1"), square).alias("move_uci")
    )
    return anomaly.board_columns(plies)
