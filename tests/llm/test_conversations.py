"""Conversation repair against a plain programme over whole strings of edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from pacelens.llm import conversations
from pacelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest())


def plain(rows):
    """One conversation's result by choosing among whole (cost, audit, lines) from every state."""
    rows = sorted(rows, key=order)
    seen, read, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
    for _, _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "none"
        seen.add((role, text))
        counts[fault] += 1
        read.append((role, text, fault))
    follow = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    tail = {"E": (0, "", ()), "A": (0, "", ()), "U": (3, "I", ("assistant:",)), "S": (6, "II", ("user:", "assistant:"))}
    for role, text, fault in reversed(read):
        best = {}
        extra = 3 if fault == "truncated" else 0
        for q in "ESUA":
            options = [(4 + tail[q][0], "D" + tail[q][1], tail[q][2])]
            if fault not in ("blank", "duplicate"):
                if role[:1] in follow[q]:
                    t = tail[follow[q][role[:1]]]
                    options.append((extra + t[0], "K" + t[1], (f"{role}:{text}", *t[2])))
                for name in ("user", "assistant"):
                    if name[0] in follow[q]:
                        t = tail[follow[q][name[0]]]
                        options.append((3 + extra + t[0], "R" + t[1], (f"{name}:{text}", *t[2])))
            best[q] = min(options)
        for _ in range(4):
            for q in "ESUA":
                for name in ("user", "assistant"):
                    if name[0] in follow[q]:
                        t = best[follow[q][name[0]]]
                        best[q] = min(best[q], (3 + t[0], "I" + t[1], (f"{name}:", *t[2])))
        tail = best
    cost, audit, lines = tail["E"]
    initials = [r[0][:1] for r in read]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def by_conversation(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_query_equals_the_plain_programme(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept = by_conversation(damaged(rows))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, SMALL).collect()}
    assert got == {conv: plain(kept.get(conv, [])) for conv in {r[0] for r in rows}}
    assert any(r[5] for r in got.values()) and any("I" in r[6] for r in got.values())


def some_rows(n: int, convs: list, seed: int):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Yes.", "No", "Why?", " ", "", "Go on!", None, "a\nb. ", "“Ende”"]
    return [(draw.choice(convs), draw.choice([None, *range(n // len(convs) + 2)]), draw.choice(roles), f"{draw.choice(texts)}" if draw.random() < 0.6 else f"t{k} {draw.choice('.?x')}") for k in range(n)]


@pytest.mark.parametrize("block", [4, 1024])
def test_blocks_that_cut_conversations(spark, monkeypatch, block):
    """Long, short, tied, repeated and hot conversations, in blocks smaller than most of them."""
    monkeypatch.setattr(conversations, "LEAST_BLOCK", block)
    rows = some_rows(300, [1, None], 1) + some_rows(60, list(range(2, 30)), 2) + [(99, 1, "user", "same.")] * 40
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "1 AS at", "'x' AS block", "2 AS place", "'y' AS fault")
    got = {r.conv: tuple(r[c] for c in COLUMNS) for r in conversations.repair(frame.repartition(3)).collect()}
    read = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == {conv: plain(own) for conv, own in by_conversation(read).items()}


def test_damage_and_empty_tables(spark):
    rows = some_rows(200, [1, 2, None], 3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversations.damage(frame).collect()), key=repr)
    assert got == sorted(damaged(rows), key=repr)
    empty = frame.where("false")
    assert conversations.repair(conversations.damage(empty)).count() == 0


def test_a_conversation_that_loses_all_rows(spark, tmp_path):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
