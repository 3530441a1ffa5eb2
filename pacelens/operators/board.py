"""Position features as narrow column expressions.

A position's placement text becomes twelve 64-bit columns, one per piece kind
(bit ``8 * rank + 7 - file``), and every geometric question becomes shifts and
masks on them.  Nothing is exploded or shuffled: distinct positions are scored
row by row inside generated code and joined back once.

The stages are separate projections on purpose: columns used more than once are
then computed once.  A stage gathers its rays in an array and folds the array in
the next projection; a higher-order function ends a whole-stage span, so each span
holds one stage and its generated method stays far below the JVM's size limits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Piece letters with their worth, and the phase limits.
WORTH = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}
LETTERS = "PNBRQKpnbrqk"
ENDGAME_MATERIAL = 20
OPENING_MOVES = 12

STRAIGHT = ((1, 0), (-1, 0), (0, 1), (0, -1))
DIAGONAL = ((1, 1), (1, -1), (-1, 1), (-1, -1))
STEPS = (*STRAIGHT, *DIAGONAL)
JUMPS = tuple((x, y) for x in (-2, -1, 1, 2) for y in (-2, -1, 1, 2) if abs(x) != abs(y))


def _long(bits: int) -> str:
    signed = bits - (1 << 64) if bits >= 1 << 63 else bits
    return "CAST(-9223372036854775808 AS BIGINT)" if signed == -(1 << 63) else f"{signed}L"


def _files(files: Sequence[int]) -> int:
    return sum(1 << (8 * r + 7 - f) for f in files for r in range(8))


def moved(bits: str, x: int, y: int) -> str:
    """Every set square moved ``x`` files and ``y`` ranks, dropped at the edge."""
    n = 8 * y - x
    out = f"shiftleft({bits}, {n})" if n > 0 else f"shiftrightunsigned({bits}, {-n})"
    if x:
        lost = range(x) if x > 0 else range(8 + x, 8)
        out = f"({out} & {_long(~_files(lost) & (1 << 64) - 1)})"
    return out


def ray(bits: str, empty: str, step: tuple[int, int]) -> str:
    """Squares seen from the set squares in one direction, first occupied one included."""
    seen = moved(bits, *step)
    for _ in range(6):
        seen = moved(f"({bits} | ({seen} & {empty}))", *step)
    return seen


def back(step: tuple[int, int]) -> tuple[int, int]:
    return (-step[0], -step[1])


def any_of(parts: Sequence[str]) -> str:
    return "(" + " | ".join(parts) + ")"


def count(bits: str) -> str:
    return f"bit_count({bits})"


def gathered(parts: Sequence[str], name: str) -> str:
    return f"array({', '.join(parts)}) AS {name}"


def union_of(name: str) -> str:
    return f"aggregate({name}, 0L, (seen, x) -> seen | x)"


def total_of(name: str) -> str:
    """Set squares over all elements, an element at a time."""
    return f"aggregate({name}, 0, (n, x) -> n + bit_count(x))"


def repeated_in(name: str) -> str:
    """Number of squares set in two or more elements."""
    start = "named_struct('once', 0L, 'twice', 0L)"
    step = "named_struct('once', a.once | x, 'twice', a.twice | (a.once & x))"
    return f"aggregate({name}, {start}, (a, x) -> {step}, a -> bit_count(a.twice))"


def placement_text(fen: Column) -> Column:
    """The 64 squares from a8 to h1, dots for empty ones."""
    text = F.regexp_replace(F.split_part(fen, F.lit(" "), F.lit(1)), "/", "")
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit(str(n)), F.lit("." * n))
    return text


def piece_on(fen: Column, square: Column) -> Column:
    """Letter of the piece standing on a square; NULL when empty."""
    file = F.ascii(F.substring(square, 1, 1)) - 97
    rank = F.substring(square, 2, 1).try_cast("int")
    found = F.substring(placement_text(fen), (8 - rank) * 8 + file + 1, F.lit(1))
    return F.when((found != ".") & (found != ""), found)


def bitboards(df: DataFrame, fen: str = "fen_before") -> DataFrame:
    """Add one bit set per piece kind (``w_p`` .. ``b_k``), occupancy and the side to move."""
    placed = df.withColumn("_board", placement_text(F.col(fen)))
    columns = []
    for letter in LETTERS:
        marks = "".join("1" if c == letter else "0" for c in LETTERS) + "0"
        name = ("w_" if letter.isupper() else "b_") + letter.lower()
        columns.append(f"coalesce(CAST(conv(translate(_board, '{LETTERS}.', '{marks}'), 2, -10) AS BIGINT), 0L) AS {name}")
    sets = placed.selectExpr("*", *columns, f"coalesce(split_part({fen}, ' ', 2), 'w') = 'w' AS _white_moves").drop("_board")
    sides = {s: any_of([f"{s}_{k}" for k in "pnbrqk"]) for s in "wb"}
    occupied = sets.selectExpr("*", f"{sides['w']} AS w_all", f"{sides['b']} AS b_all")
    return occupied.selectExpr("*", "~(w_all | b_all) AS _empty")


BITS = [f"{s}_{k}" for s in "wb" for k in ("p", "n", "b", "r", "q", "k", "all")] + ["_empty"]


def _other(side: str) -> str:
    return "b" if side == "w" else "w"


def _forward(side: str) -> int:
    return 1 if side == "w" else -1


def _sliders(side: str, step: tuple[int, int]) -> str:
    return f"({side}_{'r' if step in STRAIGHT else 'b'} | {side}_q)"


def attacks(df: DataFrame) -> DataFrame:
    """Add the squares each side attacks (``w_att``, ``b_att``)."""
    for side in "wb":
        seen = [moved(f"{side}_p", x, _forward(side)) for x in (-1, 1)]
        seen += [moved(f"{side}_n", *j) for j in JUMPS] + [moved(f"{side}_k", *s) for s in STEPS]
        seen += [ray(_sliders(side, s), "_empty", s) for s in STEPS]
        df = df.selectExpr("*", gathered(seen, "_seen")).selectExpr("*", f"{union_of('_seen')} AS {side}_att").drop("_seen")
    return df


def own_opp(df: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Turn ``w_x``/``b_x`` counts into own and opponent columns of the side to move."""
    out = []
    for own, opp in names:
        out.append(f"CASE WHEN _white_moves THEN w_{own} ELSE b_{own} END AS {own}")
        out.append(f"CASE WHEN _white_moves THEN b_{own} ELSE w_{own} END AS {opp}")
    return df.selectExpr("*", *out).drop(*[f"{s}_{own}" for own, _ in names for s in "wb"])


def material(df: DataFrame) -> DataFrame:
    """Material on the board and its difference from the mover's side; piece counts."""
    worth = {s: " + ".join(f"{v} * {count(f'{s}_{k}')}" for k, v in WORTH.items()) for s in "wb"}
    out = df.selectExpr("*", f"{worth['w']} AS _w", f"{worth['b']} AS _b")
    return out.selectExpr(
        "*",
        "CAST(_w + _b AS DOUBLE) AS total_material",
        "CAST(CASE WHEN _white_moves THEN _w - _b ELSE _b - _w END AS DOUBLE) AS material_diff",
        "bit_count(w_all | b_all) AS n_pieces",
        "bit_count(w_p) + bit_count(b_p) AS pawn_count",
    ).drop("_w", "_b")


def fen_fields(df: DataFrame, fen: str = "fen_before") -> DataFrame:
    """Half-move clock, move number and castling rights from the text."""
    return df.selectExpr(
        "*",
        f"try_cast(split_part({fen}, ' ', 5) AS INT) AS halfmove_clock",
        f"try_cast(split_part({fen}, ' ', 6) AS INT) AS fullmove_number",
        f"split_part({fen}, ' ', 3) NOT IN ('-', '') AS has_castled_rights",
    )


def phase(df: DataFrame) -> DataFrame:
    """Endgame flag and game phase from material and move number."""
    small = F.col("total_material") <= ENDGAME_MATERIAL
    return df.withColumns(
        {
            "is_endgame": small,
            "game_phase": F.when(small, "endgame").when(F.col("fullmove_number") <= OPENING_MOVES, "opening").otherwise("middlegame"),
        }
    )


def _file_set(pawns: str) -> str:
    return "(" + any_of([pawns, *[f"shiftrightunsigned({pawns}, {8 * r})" for r in range(1, 8)]]) + " & 255L)"


def pawn_structure(df: DataFrame) -> DataFrame:
    """Open files, blocked, doubled and isolated pawns, islands, passed pawns, bishop pairs."""
    spans = {
        side: any_of([moved(f"{side}_p", 0, _forward(side) * r) for r in range(1, 8)]) for side in "wb"
    }
    staged = df.selectExpr(
        "*",
        *[f"{_file_set(f'{s}_p')} AS _{s}_files" for s in "wb"],
        *[f"{spans[s]} AS _{s}_span" for s in "wb"],
        f"2 * {count(f'({moved('w_p', 0, 1)} & b_p)')} AS blocked_pawns",
    )
    columns = [
        "8 - bit_count(_w_files | _b_files) AS open_files",
        "bit_count(_w_files ^ _b_files) AS half_open_files",
        "coalesce(try_divide(CAST(blocked_pawns AS DOUBLE), bit_count(w_p) + bit_count(b_p)), 0D) AS blocked_pawn_frac",
    ]
    for s in "wb":
        files, foe = f"_{s}_files", f"_{_other(s)}_span"
        wide = any_of([foe, moved(foe, 1, 0), moved(foe, -1, 0)])
        columns += [
            f"{count(f'({s}_p & ~{wide})')} AS {s}_own_passed_pawns",
            f"bit_count({s}_p) - bit_count({files}) AS {s}_own_doubled_pawns",
            f"bit_count({files} & ~(shiftleft({files}, 1) | shiftright({files}, 1))) AS {s}_own_isolated_pawns",
            f"bit_count({files} & ~shiftright({files}, 1)) AS {s}_own_pawn_islands",
            f"bit_count({s}_b) >= 2 AS {s}_own_bishop_pair",
        ]
    out = staged.selectExpr("*", *columns).drop(*[f"_{s}_{n}" for s in "wb" for n in ("files", "span")])
    return own_opp(
        out,
        [(f"own_{n}", f"opp_{n}") for n in ("passed_pawns", "doubled_pawns", "isolated_pawns", "pawn_islands", "bishop_pair")],
    )


def safety(df: DataFrame) -> DataFrame:
    """Loose pieces and attacked squares around each king; needs ``attacks``."""
    columns = []
    for s in "wb":
        foe = _other(s)
        zone = any_of([f"{s}_k", *[moved(f"{s}_k", *d) for d in STEPS]])
        columns.append(f"{count(f'({s}_all & ~{s}_k & {foe}_att & ~{s}_att)')} AS {s}_loose_own")
        columns.append(f"{count(f'({zone} & {foe}_att)')} AS {s}_king_attackers_own")
    return own_opp(df.selectExpr("*", *columns), [("loose_own", "loose_opp"), ("king_attackers_own", "king_attackers_opp")])


def pins(df: DataFrame) -> DataFrame:
    """Pieces that shield their king from a slider on the same line."""
    for s in "wb":
        first = [f"({ray(f'{s}_k', '_empty', d)} & {s}_all) AS _first{i}" for i, d in enumerate(STEPS)]
        behind = [f"({ray(f'_first{i}', '_empty', d)} & {_sliders(_other(s), d)})" for i, d in enumerate(STEPS)]
        df = df.selectExpr("*", *first).selectExpr("*", gathered(behind, "_behind"))
        df = df.selectExpr("*", f"{total_of('_behind')} AS {s}_own_pinned").drop("_behind", *[f"_first{i}" for i in range(8)])
    return own_opp(df, [("own_pinned", "opp_pinned")])


def forks(df: DataFrame) -> DataFrame:
    """Pieces (kings apart) that attack two or more enemy pieces other than the king.

    Seen from the targets: each direction marks the attackers it reaches, and a
    piece marked twice forks.
    """
    for s in "wb":
        foe = _other(s)
        df = df.selectExpr("*", f"({foe}_all & ~{foe}_k) AS _targets")
        marks = [f"({ray('_targets', '_empty', back(d))} & {_sliders(s, d)})" for d in STEPS]
        marks += [f"({moved('_targets', *j)} & {s}_n)" for j in JUMPS]
        marks += [f"({moved('_targets', x, -_forward(s))} & {s}_p)" for x in (-1, 1)]
        df = df.selectExpr("*", gathered(marks, "_marks"))
        df = df.selectExpr("*", f"{repeated_in('_marks')} AS {s}_own_forking_pieces").drop("_targets", "_marks")
    return own_opp(df, [("own_forking_pieces", "opp_forking_pieces")])


def skewers(df: DataFrame) -> DataFrame:
    """Sliders that attack a piece with a less valuable one right behind it, kings apart."""
    behind = {"p": "nbrq", "nb": "rq", "r": "q"}
    for s in "wb":
        group = lambda kinds: any_of([f"{_other(s)}_{k}" for k in kinds])
        for part, steps in (("_straight", STRAIGHT), ("_diagonal", DIAGONAL)):
            fronts = []
            for i, d in enumerate(steps):
                seen = [f"({ray(group(rear), '_empty', back(d))} & {group(front)})" for rear, front in behind.items()]
                fronts.append(f"{any_of(seen)} AS _front{i}")
            hits = [f"({ray(f'_front{i}', '_empty', back(d))} & {_sliders(s, d)})" for i, d in enumerate(steps)]
            df = df.selectExpr("*", *fronts).selectExpr("*", gathered(hits, "_hits"))
            df = df.selectExpr("*", f"{total_of('_hits')} AS {part}").drop("_hits", *[f"_front{i}" for i in range(4)])
        df = df.selectExpr("*", f"_straight + _diagonal AS {s}_own_skewers").drop("_straight", "_diagonal")
    return own_opp(df, [("own_skewers", "opp_skewers")])


BOARD_FEATURES = (
    "total_material", "material_diff", "is_endgame", "n_pieces", "halfmove_clock", "loose_own", "loose_opp",
    "king_attackers_own", "king_attackers_opp", "has_castled_rights", "open_files", "half_open_files",
    "blocked_pawns", "blocked_pawn_frac", "own_pinned", "opp_pinned", "own_passed_pawns", "opp_passed_pawns",
    "own_bishop_pair", "opp_bishop_pair", "own_doubled_pawns", "opp_doubled_pawns", "own_isolated_pawns",
    "opp_isolated_pawns", "own_pawn_islands", "opp_pawn_islands", "own_forking_pieces", "opp_forking_pieces",
    "own_skewers", "opp_skewers", "game_phase", "pawn_count",
)
FACT_FEATURES = {
    "legal_moves": "int", "n_checks_available": "int", "n_captures_available": "int", "n_promotions_available": "int",
    "in_check": "boolean", "n_discovered_check_moves": "int", "n_double_check_moves": "int",
}


def distinct_positions(positions: DataFrame, fen: str) -> DataFrame:
    """Each position once, spread evenly over all tasks.

    Duplicates are combined before the first shuffle, so a position that makes up a
    third of the plies costs nothing.  The second one is there for the work that
    follows: it is heavy per byte, and partitions merged by size would be too few.
    """
    n = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return positions.select(fen).distinct().repartition(n, fen)


def position_features(positions: DataFrame, fen: str = "fen_before") -> DataFrame:
    """Every board feature of each distinct position."""
    df = bitboards(distinct_positions(positions, fen), fen)
    for stage in (material, pawn_structure, attacks, safety, pins, forks, skewers):
        df = stage(df)
    return phase(fen_fields(df, fen)).select(fen, *BOARD_FEATURES)


def typed_facts(facts: DataFrame, fen: str = "fen_before") -> DataFrame:
    """Move-count facts of positions, typed; absent columns are NULL."""
    return facts.select(
        fen, *[(F.col(c) if c in facts.columns else F.lit(None)).try_cast(t).alias(c) for c, t in FACT_FEATURES.items()]
    )


def fact_gaps(facts: DataFrame) -> DataFrame:
    """How many positions lack each fact."""
    counts = facts.agg(F.count(F.lit(1)).alias("n_positions"), *[F.count_if(F.col(c).isNull()).alias(c) for c in FACT_FEATURES])
    return counts.unpivot(["n_positions"], list(FACT_FEATURES), "fact", "n_missing")


def forced(df: DataFrame) -> DataFrame:
    """A position is forced when exactly one legal move exists."""
    return df.withColumn("is_forced", F.coalesce(F.col("legal_moves") == 1, F.lit(False)))


def with_position_features(plies: DataFrame, facts: DataFrame | None = None, fen: str = "fen_before") -> DataFrame:
    """Score distinct positions once and join the features back onto the plies."""
    features = position_features(plies, fen)
    if facts is not None:
        features = forced(features.join(typed_facts(facts, fen), fen, "left"))
    # Parsed facts of the move played keep their names, the position's own win.
    kept = plies.drop(*[c for c in features.columns if c != fen])
    return kept.join(features, fen, "left")


def material_offered(df: DataFrame, fen_after: str = "fen_after") -> DataFrame:
    """Worth of the mover's most valuable piece left hanging after the move; 0 for none."""
    seen = attacks(bitboards(distinct_positions(df, fen_after), fen_after))
    # In the position after the move the mover is the side not to move.
    hanging = [
        f"CASE WHEN _white_moves THEN (b_all & w_att & ~b_att) ELSE (w_all & b_att & ~w_att) END AS _hanging",
    ]
    worth = "CASE " + " ".join(
        f"WHEN (_hanging & ({' | '.join(f'{s}_{k}' for k in kinds for s in 'wb')})) <> 0 THEN {v}D"
        for kinds, v in (("q", 9), ("r", 5), ("bn", 3), ("p", 1))
    ) + " ELSE 0D END AS material_offered"
    valued = seen.selectExpr("*", *hanging).selectExpr(fen_after, worth)
    return df.join(valued, fen_after, "left").withColumn("material_offered", F.coalesce("material_offered", F.lit(0.0)))
