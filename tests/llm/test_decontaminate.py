"""Benchmark decontamination against a plain search for every window, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pacelens.llm import decontaminate
from pacelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        q = words(item)
        n = min(width, len(q))
        windows = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def digest(found):
    return found.selectExpr("doc.doc_id AS doc_id", "n_words", "spans", "items")


def test_query_equals_the_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_decontamination"](spark, SMALL).collect()}
    assert got == {i: plain(t, items) for i, t in zip(docs.doc_id, docs.text)}
    assert sum(r[4] for r in got.values()) > 0


def some_tables(seed):
    """A small vocabulary, so that shingles repeat; short items, passages cut short, repeated and null rows."""
    draw = random.Random(seed)
    vocabulary = ["a", "b", "C", "d9", "é", "東京", "x", "y"]
    say = lambda n: draw.choice([" ", ", ", "\n", "-"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, say(draw.choice([1, 2, 3, 5, 9, 10, 11, 14, 25]))) for k in range(40)] + [(3, say(12)), (None, say(6)), (77, None), (78, "!!"), (79, "")]
    docs = [(k, say(draw.choice([0, 1, 2, 9, 10, 40, 200]))) for k in range(60)]
    passage = words(items[-5][1])
    docs += [(100, "q " * 9 + " ".join(passage[:9])), (101, "q " + " ".join(passage).upper().replace("É", "é")), (102, None), (102, None), (None, items[8][1]), (103, items[8][1]), (103, items[8][1])]
    return items, docs


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, monkeypatch, seed):
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 16)
    items, docs = some_tables(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS at", "'x' AS shingle", "3 AS n_words").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS item", "4 AS size").repartition(2)
    found = decontaminate.decontaminate(frame, bench)
    got = [(r.doc.doc_id, r.n_words, sum(b - a for a, b in merged(r.spans)), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(i, *plain(text, items)[:4]) for i, text in docs], key=repr)
    assert found.select("doc.*").columns == [c for c in frame.columns if c != "text"]


def merged(spans):
    out = []
    for s in spans:
        if out and s.start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s.stop)
        else:
            out.append([s.start, s.stop])
    return out


def test_covered_words_count_once(spark):
    frame = spark.createDataFrame([([(0, 10), (5, 15), (5, 12), (20, 30)],), ([],)], "spans array<struct<start: bigint, stop: bigint>>")
    assert [r[0] for r in frame.select(decontaminate.covered(frame.spans)).collect()] == [25, 0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    none = decontaminate.decontaminate(docs, items.where("false")).collect()
    assert sorted((r.doc.doc_id, r.n_words, len(r.spans)) for r in none) == [(1, 3, 0), (2, 0, 0)]
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    assert digest(decontaminate.decontaminate(docs, items)).where("size(spans) > 0").count() == 1


def test_long_texts_are_read_whole(spark):
    """A passage at the end of a text of many pieces."""
    passage = " ".join(f"w{k}" for k in range(12))
    text = " ".join(f"z{k % 977}" for k in range(400_000)) + " " + passage
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, passage)], "item_id long, text string")
    (row,) = decontaminate.decontaminate(docs, items).collect()
    assert row.n_words == 400_012 and [(s.start, s.stop) for s in row.spans][0][0] == 400_000 and row["items"] == ["5"]


def test_hashes_do_not_depend_on_the_neighbours():
    a, b = decontaminate.Text(pa.array(["Foo bar é9 foo"])), decontaminate.Text(pa.array(["x foo", None or "", "BAR é9 foo bar"]))
    assert a.hashes[[0, 1, 2]].tolist() == [b.hashes[1], b.hashes[2], b.hashes[3]] and a.hashes[0] == a.hashes[3]
    assert b.counts.tolist() == [2, 0, 4] and np.unique(a.hashes).size == 3
