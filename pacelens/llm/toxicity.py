"""Toxicity: a counterfactually regularised text classifier.

A logistic model over the words of a text and their beginnings, a repeated word
counting twice.  Besides
the labels it is fitted to *counterfactual pairs*: each labelled text that names a
group is copied with its identity terms swapped for others of their list, and the
squared difference of the two logits is added to the loss (``pairing`` weighs it).
Mentioning a group therefore moves a score little, whatever labels happened to say
about texts that mention it.

Fitting uses a hash sample of at most ``per_class`` labelled documents of either
label; features are hashed, counted by Spark and screened by their association with
the label, fitted with an L1 penalty and refitted without it on the surviving
features.  Only the sample's counts of screened features reach the driver.  Every
document is scored, whole.

Defined cases: null and empty texts score as the intercept alone; a repeated
word counts twice; documents without a label, with a null label or a null identifier are
never trained on; several labels of one document are averaged, ties count as toxic;
without labels of both kinds every score is the share of toxic labels (0 if none);
further columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise
from pacelens.llm.common import Shared, map_batches, remainder, table

WORDS = re.compile(r"[^\W_]+")
SLOTS = 1 << 20
REJECT = 0.7

#: Identity terms; a term is swapped for the next one of its list.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "refugees", "citizens"), ("young", "old"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("ausländer", "deutsche", "türken"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "gitanos"), ("extranjeros", "españoles"),
)


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    return {a: b for group in terms for a, b in zip(group, group[1:] + group[:1])}


def features(word: str) -> tuple[int, ...]:
    """Hashed features of one word: itself and its first four and five letters."""
    slots = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS]
    for n in (4, 5):
        if len(word) >= n:
            slots.append(zlib.crc32(f"{n}^{word[:n]}".encode("utf-8", "surrogatepass")) % SLOTS)
    return tuple(slots)


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall(text.lower())) if text else Counter()


def counted(words: Counter) -> tuple[list[int], list[int]]:
    """(slots, counts) of a text's features; a repeated word counts twice at most."""
    found = Counter()
    for w, n in words.items():
        for f in features(w):
            found[f] += min(n, 2)
    return list(found), list(found.values())


def swapped(words: Counter, change: dict[str, str]) -> Counter:
    """The words with identity terms exchanged."""
    out = Counter()
    for w, n in words.items():
        out[change.get(w, w)] += n
    return out


class Model:
    """Intercept and weights by slot; everything else weighs nothing."""

    def __init__(self, intercept: float, weights: dict[int, float]):
        self.intercept, self.weights = intercept, weights


class Scorer:
    """Scores texts with the weight of each distinct word cached (the cache is emptied when full)."""

    def __init__(self, model: Model, most_words: int = 150_000):
        self.model, self.most, self.known = model, most_words, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        weights, known, logits = self.model.weights, self.known, np.zeros(len(texts))
        for i, text in enumerate(texts):
            total = 0.0
            for w, n in word_counts(text).items():
                value = known.get(w)
                if value is None:
                    value = known[w] = sum(weights.get(f, 0.0) for f in features(w))
                if value:
                    total += value * min(n, 2)
            logits[i] = total + self.model.intercept
            if len(known) > self.most:
                known.clear()
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))


def sparse(rows: list[tuple[list[int], list[int]]], column: dict[int, int], scale: np.ndarray) -> np.ndarray:
    """Dense matrix of (slots, counts) rows over the wanted slots."""
    x = np.zeros((len(rows), len(scale)))
    for i, (slots, counts) in enumerate(rows):
        for s, c in zip(slots, counts):
            if s in column:
                x[i, column[s]] += c
    return x / scale


def fit(y: np.ndarray, rows: list[tuple[list[int], list[int]]], pairs: list[tuple[list[int], list[int], list[int], list[int]]], wanted: list[int], scale: np.ndarray, pairing: float = 1.0, l1: float = 0.01) -> Model:
    """Fit labels ``y`` on rows of (slots, counts) and counterfactual pairs of (slots, counts, slots, counts).

    ``wanted`` are the screened slots and ``scale`` the root mean squares of their counts."""
    n = len(rows)
    if n == 0 or y.min() == y.max():
        share = y.mean() if n else 0.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), {})
    if not len(wanted):
        return Model(float(np.log(y.mean() / (1 - y.mean()))), {})
    wanted = np.asarray(wanted)
    column = {s: i for i, s in enumerate(wanted.tolist())}
    x = sparse(rows, column, scale)
    change = sparse([(s + s2, c + [-v for v in c2]) for s, c, s2, c2 in pairs], column, scale)
    pair_weight = 2.0 * pairing / max(len(pairs), 1)

    def solve(x, change, l1, l2, rounds):
        """Accelerated proximal gradient; the intercept is the last weight and not penalised."""
        x1 = np.hstack([x, np.ones((len(x), 1))])
        d1 = np.hstack([change, np.zeros((len(change), 1))])
        probe = np.ones(x1.shape[1])
        for _ in range(30):
            probe = 0.25 * x1.T @ (x1 @ probe) / n + pair_weight * d1.T @ (d1 @ probe)
            norm = np.linalg.norm(probe)
            probe /= norm
        step = 1.0 / (norm * 1.05 + l2)
        w = np.zeros(x1.shape[1])
        ahead, t = w, 1.0
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ ahead, -500, 500)))
            slope = x1.T @ (p - y) / n + pair_weight * d1.T @ (d1 @ ahead)
            slope[:-1] += l2 * ahead[:-1]
            new = ahead - step * slope
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
            t, past = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead = new + (past - 1) / t * (new - w)
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-5:
                break
        return w

    first = solve(x, change, l1, 0.0, 300)
    kept = np.flatnonzero(first[:-1])
    if not len(kept):
        return Model(float(first[-1]), {})
    last = solve(x[:, kept], change[:, kept], 0.0, 1e-4, 600)
    return Model(float(last[-1]), dict(zip(wanted[kept].tolist(), (last[:-1] / scale[kept]).tolist())))


def screened(sample: DataFrame, share: float, n: int, l1: float, most_features: int, least: int = 5) -> list[tuple[int, float]]:
    """(slot, scale) of the features most strongly linked to the label, counted by Spark over the sample."""

    def count(batches):
        sums = np.zeros((4, SLOTS))
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots, counts = counted(word_counts(t))
                c = np.array(counts, dtype=np.float64)
                sums[:, slots] += (np.ones(len(c)), c, c * c, c * y)
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(s[seen]) for s in sums]], names=["slot", "n", "x", "xx", "xy"])

    sums = map_batches(sample, count, "slot int, n double, x double, xx double, xy double").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")])
    scale = F.sqrt(F.col("xx") / n)
    link = F.abs(F.col("xy") - F.col("x") * share) / n / scale
    best = sums.where(F.col("n") >= least).select("slot", scale.alias("scale"), link.alias("link")).where(F.col("link") > l1)
    return sorted((r["slot"], r["scale"]) for r in best.orderBy(F.desc("link"), "slot").limit(most_features).collect())


def train(docs: DataFrame, labels: DataFrame, text: str = "text", identifier: str = "doc_id", toxic: str = "toxic", per_class: int = 6000, terms=IDENTITY_TERMS, l1: float = 0.01, most_features: int = 1024, **options) -> Model:
    """Fit on documents joined with their labels, at most ``per_class`` documents of either label."""
    marks = labels.where(F.col(toxic).isNotNull() & F.col(identifier).isNotNull()).groupBy(F.col(identifier).cast("bigint").alias("id")).agg((F.avg(toxic) >= 0.5).cast("int").alias("y"))
    drawn = marks.withColumn("h", F.xxhash64("id"))
    cuts = []
    for y in (0, 1):
        last = drawn.where(F.col("y") == y).orderBy("h").limit(per_class).agg(F.max("h").alias("h")).first()["h"]
        cuts.append((F.col("y") == y) & (F.col("h") <= (last if last is not None else -(2**63))))
    # 2 * per_class identifiers at most, whatever the size of the tables
    picked = F.broadcast(drawn.where(cuts[0] | cuts[1]).select("id", "y"))
    sample = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).join(picked, "id")
    sample = materialise(sample.repartition(8, "id").select("text", "y", "id"))
    n, share = sample.agg(F.count(F.lit(1)), F.avg("y")).first()
    wanted = screened(sample, share, n, l1, most_features) if n else []
    slots, change = {s for s, _ in wanted}, swaps(terms)

    def extract(batches):
        for batch in batches:
            out = {"id": [], "y": [], "swapped": [], "s": [], "c": [], "s2": [], "c2": []}
            for t, y, i in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = word_counts(t)
                other = swapped(words, change)
                lists = []
                for found in (words, other if other != words else Counter()):
                    kept = [(s, c) for s, c in zip(*counted(found)) if s in slots]
                    lists += [[s for s, _ in kept], [c for _, c in kept]]
                for k, v in zip(out, (i, y, other != words, *lists)):
                    out[k].append(v)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    lists = map_batches(sample, extract, "id long, y int, swapped boolean, s array<int>, c array<int>, s2 array<int>, c2 array<int>").toArrow().sort_by("id").to_pydict()
    rows = list(zip(lists["s"], lists["c"]))
    pairs = [p for p, swapped in zip(zip(lists["s"], lists["c"], lists["s2"], lists["c2"]), lists["swapped"]) if swapped]
    return fit(np.array(lists["y"], dtype=np.float64), rows, pairs, [s for s, _ in wanted], np.array([v for _, v in wanted]), l1=l1, **options)


def score(docs: DataFrame, model: Model, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """(identifier, score) of every document."""
    shared = Shared(docs.sparkSession, model)

    def run_batches(batches):
        scorer = shared.ready(Scorer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run_batches, "id long, score double").withColumnRenamed("id", identifier)


def not_toxic(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents that score below ``reject``; columns unchanged."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index(text)

    def keep(batches):
        scorer = shared.ready(Scorer)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < reject, pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def learn(docs: DataFrame, spark, folder: str) -> Model:
    """The model of op3: labels of documents whose crc32 mod 3 is not 1."""
    return train(docs.where(remainder("doc_id", 3) != 1), table(spark, folder, "labels"))


def run(spark, folder: str) -> DataFrame:
    """op3: toxicity score of every document."""
    docs = table(spark, folder, "documents")
    scored = score(docs, learn(docs, spark, folder))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
