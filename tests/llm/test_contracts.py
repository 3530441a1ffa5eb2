"""Each operator's query against a brute-force version on the small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pacelens.llm import bm25, bpe, htmltext, interpolation, langid, licenses, near_dup, quality
from pacelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def medium(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet").toPandas()


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = QUERIES["op2_bpe_tokens"](spark, SMALL).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    for i, text in zip(documents.doc_id, documents.text):
        e = library.encode(text, add_special_tokens=False)
        row = got.loc[i]
        assert row.n_tokens == len(e.ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(e.ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_on_held_out_documents(spark):
    got = QUERIES["op3_toxicity"](spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 3 == 1)).all()
    marked = got[got.held_out].merge(labels, on="doc_id")
    clean, toxic = marked[marked.toxic == 0], marked[marked.toxic == 1]
    assert clean.predicted.mean() < 0.02
    assert (clean.score.median() < toxic.score).mean() > 0.6


def test_licenses_equal_all_windows(spark, medium):
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word, r.n_windows) for r in QUERIES["op4_license_scan"](spark, MEDIUM).collect()}
    scanner, want = licenses.Scanner(), {}
    for i, text in zip(medium.doc_id, medium.text):
        h = scanner.words(text)
        for (width, stride), templates in scanner.classes.items():
            shingles = licenses.rolled(h, width)
            for name, wanted in templates:
                windows = [(len(np.intersect1d(shingles[b : b + 2 * stride], wanted)) / len(wanted), b) for b in range(0, len(shingles), stride)] if np.isin(shingles, wanted).any() else []
                found = [(-share, b) for share, b in windows if share >= licenses.LEAST]
                if found:
                    share, b = min(found)
                    want[i, name] = (round(-share, 9), b + int(np.flatnonzero(np.isin(shingles[b:], wanted))[0]), len(found))
    assert want and got == want


def test_band_settings_keep_the_promised_probability():
    for shortest, stride in ((1, 1), (3, 4), (9, 16), (40, 64)):
        held = math.ceil(licenses.LEAST * shortest)
        jaccard = held / (2 * stride + shortest - held)
        assert (1 - jaccard) ** licenses.bands_for(shortest, stride) <= licenses.MISS


def test_interpolation_counts_and_base_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(interpolation, "BUNDLE_CHARS", 60_000)
    monkeypatch.setattr(interpolation, "SHARD_CHARS", 90_000)
    got = QUERIES["op5_lm_score"](spark, SMALL).toPandas().set_index("doc_id")
    texts = {i: t.encode().translate(interpolation.LOWER).split() + [None] for i, t in zip(documents.doc_id, documents.text)}
    counts = Counter(w for i, t in texts.items() if crc(i) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (crc(i) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_interpolation_is_a_distribution(spark, documents, monkeypatch):
    """Scores recomputed from plain bigram counts, with the weights EM found."""
    seen = {}
    keep = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a, **k: seen.setdefault("w", keep(*a, **k)))
    got = QUERIES["op5_lm_score"](spark, SMALL).toPandas().set_index("doc_id")
    texts = {i: t.encode().translate(interpolation.LOWER).split() + [None] for i, t in zip(documents.doc_id, documents.text)}
    one, two = Counter(), Counter()
    for i, t in texts.items():
        if crc(i) % 7 != 2:
            one.update(t)
            two.update(zip([None, *t], t))
    n, v, weights = sum(one.values()), len(one), seen["w"]
    assert weights.sum(axis=1) == pytest.approx(np.ones(len(weights)))
    for i, t in list(texts.items())[:40]:
        total = 0.0
        for a, b in zip([None, *t], t):
            l2, l1, l0 = weights[interpolation.bucket(np.array([one[a]]))[0]]
            total += math.log10(l2 * two[a, b] / max(one[a], 1) + l1 * one[b] / n + l0 / (v + 1))
        assert got.loc[i].score == pytest.approx(total, rel=1e-9)


def test_quality_counts(spark, documents):
    got = QUERIES["op6_quality_rules"](spark, SMALL).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                duplicates += line in seen
                seen.add(line)
        row = got.loc[i]
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)]
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.kept and row.base_failed)


def test_quality_verdict_follows_the_labels(spark):
    got = QUERIES["op6_quality_rules"](spark, MEDIUM).toPandas().merge(spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas(), on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.5


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 12, (400, 3)) @ np.array([quality.CODES**2, quality.CODES, 1]))
    model = quality.KneserNey(grams, rng.integers(1, 9, len(grams)))
    for context in (0, 5 * quality.CODES + 3, 99 * quality.CODES + 98):
        assert model.probability(context * quality.CODES + np.arange(quality.CODES)).sum() == pytest.approx(1)


def test_language_of_held_out_documents(spark, medium):
    got = QUERIES["op7_language_id"](spark, MEDIUM).toPandas().merge(medium[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 4 == 2)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_partial_matching_code_lengths():
    """The array form against the definition, symbol by symbol."""
    texts = {"aa": ["banana band", "ban"], "bb": ["nab an", "cab"]}
    grams, owners, counts = [], [], []
    for k, (_, lines) in enumerate(sorted(texts.items())):
        packed, _ = langid.frames([w.encode() for line in lines for w in line.split()], langid.ORDER)
        unique, n = np.unique(packed, return_counts=True)
        grams, owners, counts = [*grams, *unique], [*owners, *[k] * len(unique)], [*counts, *n]
    trees = langid.Trees(sorted(texts), np.array(grams), np.array(owners), np.array(counts, dtype=float))
    for k, name in enumerate(sorted(texts)):
        table = defaultdict(Counter)
        for line in texts[name]:
            for w in line.split():
                s = f" {w} ".encode()
                for at in range(1, len(s)):
                    for depth in range(min(at, langid.ORDER) + 1):
                        table[s[at - depth : at]][s[at]] += 1
        for w in ("banda", "xan", "c"):
            s, bits = f" {w} ".encode(), 0.0
            for at in range(1, len(s)):
                for depth in range(min(at, langid.ORDER), -1, -1):
                    seen = table.get(s[at - depth : at])
                    if not seen:
                        continue
                    t, q = sum(seen.values()), len(seen)
                    if s[at] in seen:
                        bits -= math.log2(seen[s[at]] / (t + q))
                        break
                    bits -= math.log2(q / (t + q))
                else:
                    bits += 8
            packed, _ = langid.frames([w.encode()], langid.ORDER)
            assert trees.price(packed)[:, k].sum() == pytest.approx(bits, rel=1e-5)


def test_pruned_search_equals_exhaustive_search(spark, medium):
    """Top lists of one shard against exhaustive scores; blocks are skipped on the way."""
    texts = medium.text.tolist()
    words = [Counter(bm25.tokens(t)) for t in texts]
    df = Counter(w for found in words for w in found)
    lengths = [sum(found.values()) for found in words]
    asked = ["the inesea thouinor", "Ñllñ queóas. of", ""]
    queries = bm25.Queries([0, 1, 2], asked)
    name = {xxhash.xxh3_64_intdigest(w): w for w in df}
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    queries.idf = np.array([idf.get(name.get(int(h)), 0.0) for h in queries.terms])
    queries.mean = sum(lengths) / len(texts)
    shard = bm25.build(spark.createDataFrame(medium[["doc_id", "text"]]).coalesce(1), "text", "doc_id").collect()[0].asDict()
    searcher = bm25.Searcher(shard, queries, 5)
    for number, text in enumerate(asked):
        scores = []
        for i, found, n in zip(medium.doc_id, words, lengths):
            norm = bm25.K1 * (1 - bm25.B + bm25.B * n / queries.mean)
            s = round(sum(k * idf[w] * found[w] * (bm25.K1 + 1) / (found[w] + norm) for w, k in Counter(bm25.tokens(text)).items() if w in found), 6)
            if s > 0:
                scores.append((-s, i))
        docs, got = searcher.top(number)
        assert [(-s, int(searcher.ids[d])) for d, s in zip(docs, got)] == [(pytest.approx(s), i) for s, i in sorted(scores)[:5]]
    assert searcher.entered < 2 * searcher.blocks


def test_html_regions():
    weights = htmltext.Weights({})
    page = (
        '<html><body><header><nav><a>Home</a></nav></header><div class="cookie-notice">We use cookies</div><main><h2>Title</h2>'
        "<p>First words of the &lt;b&gt; text&nbsp;are   here.</p><div class='ad-box'>Buy now</div><p>End.<aside>side</aside><ul><li>one item</ul>"
        "<form><label>Mail</label></form><section class=comments><p>Nice one!</p></section></main><script>if(a<b){}</script><footer>c</footer>"
    )
    assert htmltext.extract(page, weights) == "Title\nFirst words of the <b> text are here.\nEnd.\none item"


def test_main_text_of_declared_articles(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").toPandas().set_index("page_id")
    for row in QUERIES["op9_main_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*)</article>", pages.loc[row.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", article))
        want = "\n".join(b for b in blocks if b)
        assert row.text == want and row.n_chars == len(want) and row.url == pages.loc[row.page_id].url


def test_near_duplicates_equal_all_pairs(spark, medium):
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_duplicates"](spark, MEDIUM).collect()}
    hashes, parent = near_dup.WordHashes(), {i: i for i in medium.doc_id}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    plain, holders = {}, defaultdict(set)
    for i, text in zip(medium.doc_id, medium.text):
        x = near_dup.shingles(text, hashes)
        plain[i] = x[near_dup.occurrence(x) == 0]
        for s in plain[i].tolist():
            holders[s].add(i)
    tried = set()
    for found in holders.values():
        ordered = sorted(found)
        for k, a in enumerate(ordered):
            for b in ordered[k + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    if near_dup.aligned(plain[a], plain[b]):
                        one, two = sorted((find(a), find(b)))
                        parent[two] = one
    same = defaultdict(list)
    for i, t in zip(medium.doc_id, medium.text):
        same[t].append(i)
    for ids in same.values():
        for i in ids[1:]:
            one, two = sorted((find(ids[0]), find(i)))
            parent[two] = one
    assert got == {i: find(i) for i in medium.doc_id}


def test_alignment_equals_plain_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.permutation(60)[: rng.integers(20, 60)].astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 8)):
            at = rng.integers(0, len(b))
            b = np.delete(b, at) if rng.random() < 0.5 else np.insert(b, at, np.uint64(rng.integers(100, 10**6)))
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        length = table[-1, -1]
        want = length / (len(a) + len(b) - length)
        assert near_dup.aligned(a, b) == (pytest.approx(want) if want >= near_dup.LEAST else 0.0)
