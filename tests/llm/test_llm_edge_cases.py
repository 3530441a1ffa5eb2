"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pacelens.llm import bm25, bpe, htmltext, interpolation, langid, licenses, mix, near_dup, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the garden path was open and nobody went in because rain had fallen all night over roofs of every house".split()
PLAIN = " ".join(WORDS[k % 19] + str(k % 7) for k in range(90))
LONG = " ".join(f"{w}{k}" for k in range(3000) for w in ("alpha", "beta", "gamma"))
ROWS = [
    (1, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (3, PLAIN + " coda", None, None, None),
    (4, "", "en", "b", 0), (5, None, "de", "b", None), (None, "null id text All rights reserved.", "en", None, 3), (6, LONG, "de", "c", 9),
    (7, "###", "en", "c", 3), (8, "één zwölf niño 東京 " * 20, "de", "a", 9), (9, "ok", None, "b", 2),
]
CLASH = ("size", "score", "key", "id", "_row", "_key", "_size", "node", "root", "n", "bundle", "shard", "rank", "kept", "text_key", "lang_pred", "_id")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(frame, *keys):
    return sorted((tuple(r[k] for k in keys) for r in frame.collect()), key=repr)


def test_mix(docs, empty):
    got = mix.mix_counts(docs).toPandas()
    assert len(got) == len(ROWS)
    sizes = got.drop_duplicates("source_size").source_size
    assert (got["taken"] <= 2 * got["size"]).all() and got.target.le(2 * got.source_size).all() and len(sizes) == 4
    totals = got.groupby("source_size")[["size", "taken"]].sum()
    assert totals["size"].sum() * 1.5 == pytest.approx(got.drop_duplicates("source_size").target.sum())
    rows = mix.mix(docs)
    assert rows.columns == docs.columns
    assert rows.where("doc_id = 6").count() == (got.loc[got.doc_id == 6, "taken"] // 9000).iloc[0]
    assert mix.mix_counts(empty).count() == 0 and mix.mix(empty).columns == empty.columns
    assert table(mix.mix_counts(docs), "doc_id", "taken") == table(mix.mix_counts(docs.repartition(5)), "doc_id", "taken")


def test_bpe(docs, empty):
    path = bpe.vocabulary_path()
    got = bpe.encode(docs, path)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and by_id[5].n_tokens == by_id[4].n_tokens == 0
    assert by_id[4].ids_sha256 == hashlib.sha256(b"").hexdigest() and by_id[6].n_tokens >= 9000
    decoded = {r.doc_id: r.text for r in bpe.decode(got, path).collect()}
    assert decoded[5] == "" and hashlib.sha256(decoded[8].encode()).hexdigest() == by_id[8].decoded_sha256
    assert bpe.encode(empty, path).count() == 0


def test_automaton_on_a_small_vocabulary():
    """Every string over two letters against plain merging."""
    from itertools import product

    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "ba"), ("aab", "aa"), ("b", "b")]
    vocabulary = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    automaton = bpe.Automaton(vocabulary, merges)
    rank = {m: k for k, m in enumerate(merges)}
    for n in range(1, 11):
        for letters in product("ab", repeat=n):
            parts = list(letters)
            while pairs := [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                _, k = min(pairs)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert [automaton.label[t] for t in automaton.encode("".join(letters))] == parts


def test_toxicity(spark, docs, empty):
    bad = [(100 + k, PLAIN + (" you scumbag" if k % 2 else " thank you"), "en", "a", 1) for k in range(40)]
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(40)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(bad, SCHEMA), labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.select(*SCHEMA.replace(",", "").split()[::2]).union(spark.createDataFrame(bad[:2], SCHEMA)), model).collect()}
    assert scores[101] > 0.7 > scores[100] and scores[4] == scores[5] and 0 <= scores[6] <= 1
    assert toxicity.not_toxic(docs, model).columns == docs.columns and toxicity.not_toxic(docs, model).count() == len(ROWS)
    none = toxicity.train(empty, labels)
    assert toxicity.score(empty, none).count() == 0 and all(r.score < 1e-5 for r in toxicity.score(docs, none).collect())


def test_counterfactual_pairs_spare_group_mentions():
    """A group that only toxic labelled texts mention costs less once swapped copies are held to the same score."""
    import numpy as np

    def row(words):
        return toxicity.counted(toxicity.word_counts(words))

    toxic = ["filthy women nonsense", "filthy women garbage", "filthy idiots", "women filthy liars"] * 20
    clean = ["nice weather today", "men at work", "men read books", "a fine garden"] * 20
    texts, y = toxic + clean, np.array([1.0] * 80 + [0.0] * 80)
    rows = [row(t) for t in texts]
    change = toxicity.swaps()
    pairs = [(*row(t), *row(" ".join(change.get(w, w) for w in t.split()))) for t in texts if set(t.split()) & set(change)]
    slots = sorted({s for r in rows for s in r[0]})
    scale = np.array([max(1e-9, np.sqrt(sum(c * c for r in rows for s, c in zip(*r) if s == slot) / len(rows))) for slot in slots])
    neutral = ["women read books today"]
    plain = toxicity.Scorer(toxicity.fit(y, rows, [], slots, scale, pairing=0.0))(neutral)[0]
    paired = toxicity.Scorer(toxicity.fit(y, rows, pairs, slots, scale, pairing=1.0))(neutral)[0]
    assert paired < 0.5 < toxicity.Scorer(toxicity.fit(y, rows, pairs, slots, scale))(["filthy men"])[0] and paired < plain


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license, r.containment, r.first_word, r.n_windows) for r in got] == [(None, "all-rights-reserved", 1.0, 3, 2)]
    assert licenses.scan(empty).count() == 0


def test_interpolation(docs, empty):
    got = interpolation.score(docs)
    rows = got.collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and by_id[4].n_tokens == by_id[5].n_tokens == 1 and by_id[5].score == by_id[4].score
    assert sum(r.doc_id == 2 for r in rows) == 2 and by_id[6].n_tokens == 9001 and all(r.score < 0 for r in rows)
    assert interpolation.score(empty).count() == 0


def test_interpolation_of_a_repeated_table(spark):
    """A table united with itself has equal bundles: every row is scored twice, counts double."""
    frame = spark.createDataFrame([(k, f"{PLAIN} word{k}", "en", "a", 1) for k in range(40)], SCHEMA).repartition(4, "doc_id").localCheckpoint()
    once = {r.doc_id: r for r in interpolation.score(frame).collect()}
    twice = interpolation.score(frame.union(frame)).collect()
    assert sorted(r.doc_id for r in twice) == sorted([*range(40), *range(40)])
    assert all(r.train_tokens == 2 * once[r.doc_id].train_tokens and r.n_tokens == once[r.doc_id].n_tokens for r in twice)
    one = spark.createDataFrame([(7, PLAIN, "en", "a", 1)] * 12, SCHEMA).repartition(4)
    assert interpolation.score(one).count() == 12


def test_quality(docs, empty):
    rows = quality.judge(docs, quality.train(docs)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and by_id[5].n_words == 0 and by_id[5].base_failed and not by_id[5].kept
    assert by_id[6].n_words == 9000 and by_id[7].n_symbols == 3
    assert quality.judge(empty, quality.train(empty)).count() == 0


def test_quality_tells_all_bytes_apart(spark):
    """Letters whose UTF-8 bytes differ by 32 only: a text in capitals among Cyrillic ones stands out."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("абвгдежзиклмно", k=draw.randrange(3, 9))) for _ in range(150)]
    texts = [" ".join(draw.choices(vocabulary, k=400)) for _ in range(40)]
    frame = spark.createDataFrame([(k, t.upper() if k == 7 else t, "ru", "a", 1) for k, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in quality.judge(frame, quality.train(frame)).collect()}
    assert rows[7].log2_perplexity > max(r.log2_perplexity for k, r in rows.items() if k != 7) + 0.4
    assert [k for k, r in rows.items() if not r.kept] == [7]
    every = np.array([far << 16 | near << 8 | last | 2 << 40 for far in (0, 97, 131, 195) for near in range(256) for last in range(256)])
    assert len(np.unique(quality.codes(every))) == len(every)


def test_language(docs, empty):
    trees = langid.train(docs)
    by_id = {r.doc_id: r for r in langid.identify(docs, trees).collect()}
    assert {by_id[k].lang_pred for k in (4, 5, 7)} == {"und"} and by_id[5].score == 0
    assert by_id[1].lang_pred == "en" and by_id[8].lang_pred == "de"
    kept = langid.known_language(docs, trees)
    assert kept.columns == docs.columns and table(kept, "doc_id") == table(docs.where("coalesce(text, '') not in ('', '###')"), "doc_id")
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(empty, none).count() == 0


def test_search(docs, empty):
    got = bm25.search(docs, docs.where("doc_id in (1, 4, 8)"), k=3).collect()
    lists = {q: [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 4, 8)}
    assert lists[1] == [(1, 1), (2, 2), (3, 2)] and lists[4] == [] and lists[8][0] == (1, 8)
    assert bm25.search(empty, docs).count() == 0 and bm25.search(docs, empty).count() == 0


def test_pages(spark, docs):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>a &amp; b"), (2, "v", "<p>x</p>" * 3000)], "page_id long, url string, html string")
    weights = htmltext.learn(pages)
    got = htmltext.main_text(pages.withColumn("text", F.lit(1)), weights).collect()
    assert sorted(r.text for r in got) == sorted(["", "", "a & b", "\n".join(["x"] * 3000)])
    assert htmltext.main_text(pages.limit(0), htmltext.learn(pages.limit(0))).count() == 0


def test_near_duplicates(docs, empty):
    got = near_dup.class_ids(docs).collect()
    classes = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(ROWS) and classes[1] == classes[2] == classes[3] == 1 and classes[4] == classes[5] == 4
    assert len({classes[k] for k in (1, 4, 6, 7, 8, 9)}) == 6 and classes[None] is None
    kept = near_dup.one_per_class(docs)
    assert kept.columns == docs.columns and [r[0] for r in table(kept, "doc_id")].count(2) == 0 and kept.count() == 7
    assert near_dup.class_ids(empty).count() == 0 and near_dup.one_per_class(empty).count() == 0


def test_a_crowd_of_near_copies_is_one_class(spark):
    """A hundred edited copies and fifty texts that share only a passage with them."""
    words = [f"w{k}" for k in range(200)]
    near = [(k, " ".join([*words[:k], f"edit{k}", *words[k + 1 :]]), "en", "a", 1) for k in range(100)]
    passage = [(1000 + k, " ".join([*words[:60], *[f"o{k}x{j}" for j in range(140)]]), "en", "a", 1) for k in range(50)]
    got = {r.doc_id: r.class_id for r in near_dup.class_ids(spark.createDataFrame(near + passage, SCHEMA)).collect()}
    assert {got[k] for k in range(100)} == {0} and all(got[1000 + k] == 1000 + k for k in range(50))


def _all_pairs(texts):
    """Least member of each text's class by alignment of all pairs."""
    hashes, up = near_dup.WordHashes(), {i: i for i in texts}
    plain = {i: near_dup.shingles(t, hashes) for i, t in texts.items()}

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in texts:
        for j in texts:
            if i < j and top(i) != top(j) and near_dup.aligned(plain[i], plain[j]) > 0:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in texts}


def test_a_crowd_of_copies_near_their_base_only(spark, monkeypatch):
    """Copies that reach the threshold with one base but not with each other, in buckets they all share."""
    monkeypatch.setattr(near_dup, "BLOCK", 100)
    draw, words, texts = random.Random(5), [f"w{k}" for k in range(240)], {0: " ".join(f"w{k}" for k in range(240))}
    for k in range(1, 400):
        at = {10 + 60 * j + draw.randrange(45) for j in range(4)}
        texts[k] = " ".join(f"e{k}x{i}" if i in at else w for i, w in enumerate(words))
    got = {r.doc_id: r.class_id for r in near_dup.class_ids(spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts.items()], SCHEMA)).collect()}
    assert got == _all_pairs(texts) and set(got.values()) == {0}


def test_pairs_in_a_crowd_with_a_long_common_passage(spark, monkeypatch):
    """Pairs of near copies whose texts are for the most part a passage that the whole crowd shares."""
    monkeypatch.setattr(near_dup, "BLOCK", 100)
    texts = {}
    for k in range(200):
        own = [f"o{k}x{j}" for j in range(24)]
        texts[2 * k] = " ".join([*(f"w{j}" for j in range(172)), *own])
        texts[2 * k + 1] = " ".join([*(f"w{j}" for j in range(172)), *own[:10], "edit", *own[11:]])
    got = {r.doc_id: r.class_id for r in near_dup.class_ids(spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts.items()], SCHEMA)).collect()}
    assert got == _all_pairs(texts) and len(set(got.values())) == 200


def test_a_crowd_is_joined_with_its_sketches_once(spark, monkeypatch):
    """The rows that contract crowded buckets are stored: one per member of a mixed bucket, and one per sketch value of its node."""
    seen, plain = [], near_dup.candidates

    def watched(buckets, chained):
        seen.append((chained, buckets))
        return plain(buckets, chained)

    monkeypatch.setattr(near_dup, "candidates", watched)
    near, passage = [f"w{k}" for k in range(200)], [f"p{k}" for k in range(150)]
    texts = {k: " ".join([*near[:k], f"edit{k}", *near[k + 1 :]]) for k in range(0, 200, 5)}
    texts |= {1000 + k: " ".join([*passage, *[f"o{k}x{j}" for j in range(60)]]) for k in range(60)}
    got = {r.doc_id: r.class_id for r in near_dup.class_ids(spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts.items()], SCHEMA)).collect()}
    assert got == _all_pairs(texts) and len(set(got.values())) == 61
    assert [chained for chained, _ in seen] == [False, True]
    crowded = seen[1][1]
    assert "Join" not in crowded._jdf.queryExecution().optimizedPlan().toString()
    of_node = {r.node: r["count"] for r in crowded.groupBy("node").count().collect()}
    assert len(of_node) > near_dup.SMALL and all(near_dup.SKETCHES < n <= 2 * near_dup.SKETCHES for n in of_node.values())


def test_the_stage_of_the_pipeline_joins_a_crowd_once(spark, monkeypatch):
    """In the pipeline too, the crowded buckets that are contracted are read from storage."""
    seen, plain = [], near_dup.candidates
    monkeypatch.setattr(near_dup, "candidates", lambda buckets, chained: seen.append(buckets) or plain(buckets, chained))
    passage = [f"p{k}" for k in range(150)]
    rows = [(k, " ".join([*passage, *[f"o{k // 2}x{j}" for j in range(60)], *["coda"] * (k % 2)]), "en", "a", 1) for k in range(60)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 60, 2))
    assert len(seen) == 2 and "Join" not in seen[1]._jdf.queryExecution().optimizedPlan().toString()


def test_stages_keep_the_columns(spark, docs):
    folder = "/root/testdata/sf0.001"
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialise(stage(spark, frame, folder))
        assert frame.columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, frame, folder)
    assert last.count() == frame.count()
    assert {1, 6, 8} >= {r.doc_id for r in last.collect()} - {None, 9} != set()


def test_stages_on_an_empty_table(spark, empty):
    frame = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialise(stage(spark, frame, "/root/testdata/sf0.001"))
        assert frame.columns == empty.columns and frame.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "/root/testdata/sf0.001").count() == 0


def test_equal_query_rows_have_a_list_each(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "w1 common"), (7, "w1 common"), (8, "w2"), (9, ""), (9, None)], "doc_id long, text string")
    found = bm25.search(docs, asked, k=4)
    rows = [tuple(r) for r in found.where("query_id = 7").orderBy("rank", "doc_id").collect()]
    assert len(rows) == 8 and rows[::2] == rows[1::2]
    assert len({r[2] for r in rows}) == 4
    assert found.where("query_id = 9").count() == 0


def test_search_by_whole_documents_scores_few_exactly(spark):
    """Long queries: rough sums leave few documents to be scored exactly, and the lists stay exact, ties included."""
    rng = np.random.default_rng(7)
    weight = 1 / np.arange(1, 1501)
    texts = [" ".join(f"w{i}" for i in rng.choice(1500, size=rng.integers(60, 160), p=weight / weight.sum())) for _ in range(1300)]
    texts[40:60] = [texts[7]] * 20  # copies tie
    words = [Counter(t.encode().split()) for t in texts]
    df = Counter(w for found in words for w in found)
    lengths = np.array([sum(found.values()) for found in words])
    shard = bm25.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "text", "doc_id").collect()[0].asDict()
    asked = [7, 300, 900, 1299]
    queries = bm25.Queries(asked, [texts[i] for i in asked])
    name = {bm25.xxhash.xxh3_64_intdigest(w): w for w in df}
    queries.idf = np.array([np.log(1 + (len(texts) - df[name[int(h)]] + 0.5) / (df[name[int(h)]] + 0.5)) for h in queries.terms])
    queries.mean = lengths.mean()
    searcher = bm25.Searcher(shard, queries, 10)
    idf = {name[int(h)]: x for h, x in zip(queries.terms, queries.idf)}
    for number, i in enumerate(asked):
        norm = bm25.K1 * (1 - bm25.B + bm25.B * lengths / queries.mean)
        scores = [sum(n * idf[w] * found[w] * (bm25.K1 + 1) / (found[w] + x) for w, n in words[i].items() if w in found) for found, x in zip(words, norm)]
        best = sorted((-round(s, 6), d) for d, s in enumerate(scores) if s > 0)[:10]
        docs, got = searcher.top(number)
        assert [int(d) for d in searcher.ids[docs]] == [d for _, d in best]
        assert got == pytest.approx([-s for s, _ in best])
        docs, got = searcher.top(number, -best[4][0])
        assert [int(d) for d in searcher.ids[docs]][:5] == [d for _, d in best][:5]
        assert len(searcher.top(number, 1e9)[0]) == 0
    assert searcher.entered < searcher.blocks * len(asked)
