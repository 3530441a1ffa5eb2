"""Board features against a plain square-by-square walker on random positions."""

from __future__ import annotations

import random

import pytest

from pacelens.operators import board

WORTH = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}
STRAIGHT = [(1, 0), (-1, 0), (0, 1), (0, -1)]
DIAGONAL = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def parse(fen):
    cells = {}
    for y, rank in enumerate(fen.split()[0].split("/")):
        x = 0
        for ch in rank:
            if ch.isdigit():
                x += int(ch)
            else:
                cells[(x, 7 - y)] = ch
                x += 1
    return cells, fen.split()[1] == "w"


def steps(kind):
    return {"r": STRAIGHT, "b": DIAGONAL, "q": STRAIGHT + DIAGONAL}.get(kind, [])


def line(cells, at, step):
    x, y = at
    path = []
    while True:
        x, y = x + step[0], y + step[1]
        if not (0 <= x < 8 and 0 <= y < 8):
            return path
        path.append((x, y))


def attacked(cells, at):
    ch = cells[at]
    kind, up = ch.lower(), 1 if ch.isupper() else -1
    if kind == "p":
        out = [(at[0] + d, at[1] + up) for d in (-1, 1)]
    elif kind == "n":
        out = [(at[0] + a, at[1] + b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]
    elif kind == "k":
        out = [(at[0] + a, at[1] + b) for a, b in STRAIGHT + DIAGONAL]
    else:
        out = []
        for s in steps(kind):
            for sq in line(cells, at, s):
                out.append(sq)
                if sq in cells:
                    break
    return {s for s in out if 0 <= s[0] < 8 and 0 <= s[1] < 8}


def walk(fen):
    cells, white = parse(fen)
    mine = lambda ch: ch.isupper() == white
    att = {w: set().union(*[attacked(cells, s) for s, c in cells.items() if c.isupper() == w] or [set()]) for w in (True, False)}
    out = {k: 0 for k in ("loose_own", "loose_opp", "own_pinned", "opp_pinned", "own_forking_pieces", "opp_forking_pieces",
                          "own_skewers", "opp_skewers", "own_passed_pawns", "opp_passed_pawns", "king_attackers_own", "king_attackers_opp")}
    for at, ch in cells.items():
        side, own = ch.isupper(), "own" if mine(ch) else "opp"
        if ch.lower() == "k":
            zone = attacked(cells, at) | {at}
            out[f"king_attackers_{own}"] += len(zone & att[not side])
            for s in STRAIGHT + DIAGONAL:
                hit = [q for q in line(cells, at, s) if q in cells][:2]
                if len(hit) == 2 and cells[hit[0]].isupper() == side and cells[hit[1]].isupper() != side and s in steps(cells[hit[1]].lower()):
                    out[f"{own}_pinned"] += 1
            continue
        if at in att[not side] and at not in att[side]:
            out[f"loose_{own}"] += 1
        prey = [q for q in attacked(cells, at) if q in cells and cells[q].isupper() != side and cells[q].lower() != "k"]
        out[f"{own}_forking_pieces"] += len(prey) >= 2
        for s in steps(ch.lower()):
            hit = [cells[q] for q in line(cells, at, s) if q in cells][:2]
            if len(hit) == 2 and all(h.isupper() != side and h.lower() != "k" for h in hit) and WORTH[hit[0].lower()] > WORTH[hit[1].lower()]:
                out[f"{own}_skewers"] += 1
        if ch.lower() == "p":
            ahead = (lambda r: r > at[1]) if side else (lambda r: r < at[1])
            foes = [q for q, c in cells.items() if c.lower() == "p" and c.isupper() != side]
            out[f"{own}_passed_pawns"] += not any(abs(q[0] - at[0]) <= 1 and ahead(q[1]) for q in foes)
    hanging = [WORTH[c.lower()] for s, c in cells.items() if not mine(c) and c.lower() != "k" and s in att[white] and s not in att[not white]]
    return out, float(max(hanging, default=0))


def random_fen(rng):
    cells = [["."] * 8 for _ in range(8)]
    spots = rng.sample(range(64), rng.randint(4, 30))
    cells[spots[0] // 8][spots[0] % 8], cells[spots[1] // 8][spots[1] % 8] = "K", "k"
    for s in spots[2:]:
        ch = rng.choice("PPPNBRQpppnbrq")
        if ch.lower() != "p" or 8 <= s < 56:
            cells[s // 8][s % 8] = ch
    text = "/".join("".join(r) for r in cells)
    for n in range(8, 0, -1):
        text = text.replace("." * n, str(n))
    return f"{text} {rng.choice('wb')} - - 0 30"


def test_random_positions(spark):
    rng = random.Random(7)
    fens = sorted({random_fen(rng) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fens], "fen_before string")
    features = {r.fen_before: r.asDict() for r in board.position_features(df).collect()}
    offered = {r.fen_after: r.material_offered for r in board.material_offered(df.withColumnRenamed("fen_before", "fen_after")).collect()}
    assert len(features) == len(fens)
    for fen in fens:
        want, hanging = walk(fen)
        assert {k: features[fen][k] for k in want} == want, fen
        assert offered[fen] == hanging, fen


CASES = [
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", {"total_material": 78.0, "material_diff": 0.0, "game_phase": "opening"}),
    ("6k1/8/8/8/R2q3r/8/8/6K1 w - - 0 40", {"own_skewers": 1, "opp_skewers": 0}),
    ("6k1/8/8/8/R2r3q/8/8/6K1 w - - 0 40", {"own_skewers": 0, "opp_skewers": 0}),
    ("6k1/8/8/8/R2P3r/8/8/6K1 w - - 0 40", {"own_skewers": 0, "opp_skewers": 0}),
    ("6k1/8/8/8/7b/8/5N2/4K3 w - - 0 40", {"own_pinned": 1, "opp_pinned": 0}),
    ("6k1/8/8/8/1r3r2/3N4/8/6K1 w - - 0 40", {"own_forking_pieces": 1, "opp_forking_pieces": 0}),
    ("6k1/8/8/8/R6r/8/8/4K3 w - - 0 40", {"loose_own": 1, "loose_opp": 1}),
]


@pytest.fixture(scope="module")
def known(spark):
    df = spark.createDataFrame([(f,) for f, _ in CASES], "fen_before string")
    return {r.fen_before: r.asDict() for r in board.position_features(df).collect()}


@pytest.mark.parametrize("fen,want", CASES)
def test_known_positions(known, fen, want):
    assert {k: known[fen][k] for k in want} == want


def test_bishop_sacrifice_offers_three(spark):
    # The bishop has just taken on h7 with check and nothing defends it.
    after = "rnbq1rk1/ppp2ppB/4p3/3pP3/3P4/2N5/PPP2PPP/R1BQK2R b KQ - 0 8"
    df = spark.createDataFrame([(after,)], "fen_after string")
    assert board.material_offered(df).first().material_offered == 3.0
