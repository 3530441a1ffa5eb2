"""Records of any length: brackets and forward fills against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from pacelens.operators import parse


def test_brackets_against_a_plain_scan():
    draw = random.Random(1)
    lists = [[draw.choice(["(", ")", "a", "b ", "{x}"]) for _ in range(draw.randrange(0, 40))] for _ in range(300)] + [[], [")", ")", "x"], ["(", "x"]]

    def plain(pieces):
        depth, out = 0, []
        for p in pieces:
            if p == "(":
                depth += 1
            elif p == ")":
                depth = max(0, depth - 1)
            elif depth == 0:
                out.append(p)
        return out

    held = pa.array(lists, pa.list_(pa.string()))
    assert parse.outside_brackets(held).to_pylist() == [plain(p) for p in lists]
    assert parse.outside_brackets(held.slice(7, 50)).to_pylist() == [plain(p) for p in lists[7:57]]
    assert parse.outside_brackets(held.slice(0, 0)).to_pylist() == []


def test_fills_against_a_plain_walk():
    draw = random.Random(2)
    games = [[(draw.choice([None, round(draw.random() * 60, 1)]), draw.random() < 0.3, draw.choice([None, "e4", "d5"]), draw.choice([None] * 6 + ["kingside", "queenside"])) for _ in range(draw.choice([0, 1, 2, 30, 200]))] for _ in range(40)]
    base = [draw.choice([None, 60.0]) for _ in games]
    alone = [draw.random() < 0.3 for _ in games]
    want = []
    for moves, b, one in zip(games, base, alone):
        clock, spent, castle, n, taken, rows = [b, b], [None, None], [None, None], [0, 0], None, []
        for i, (after, capture, square, wing) in enumerate(moves):
            s = i % 2
            think = None if clock[s] is None or after is None else clock[s] - after + 1.0
            index = None if after is None else (sum(n) if one else n[s])
            rows.append([i, clock[s], clock[1 - s], think, spent[1 - s], bool(capture and square and square == taken), castle[s], castle[1 - s], bool(castle[s] and castle[1 - s] and castle[s] != castle[1 - s]), index])
            if after is not None:
                clock[s], n[s] = after, n[s] + 1
            if think is not None:
                spent[s] = think
            taken = square if capture else None
            castle[s] = wing or castle[s]
        want += [[*r, sum(n) if one else n[i % 2]] for i, r in enumerate(rows)]
    flat = [m for g in games for m in g]
    number = lambda v: np.array([np.nan if x is None else x for x in v], dtype=float)
    facts = {"clock_after": number([m[0] for m in flat]), "is_capture": np.array([m[1] for m in flat], dtype=bool), "to_square": np.array([m[2] for m in flat], dtype=object), "castle_side": np.array([m[3] for m in flat], dtype=object)}
    got = parse.filled_plies(np.array([len(g) for g in games]), number(base), np.ones(len(games)), np.array(alone), facts)
    names = ["ply", "clock_before", "opp_clock", "think_time", "opp_think_time_prev", "is_recapture", "own_castled_side", "opp_castled_side", "opposite_side_castling", "timed_index", "timed_total"]
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in zip(*(got[c].tolist() for c in names))]
    rows = [[*r[:9], None if r[9] == -1 else r[9], r[10]] for r in rows]
    assert rows == want


def test_empty_and_moveless_records(spark):
    frame = spark.createDataFrame([(1, '[Event "x"]\n\n*'), (2, ""), (3, None)], "order_id long, pgn string")
    assert parse.plies(frame).count() == 0 and parse.move_tokens(frame).count() == 0
    assert parse.plies(frame.where("false")).count() == 0
