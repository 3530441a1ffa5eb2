"""Language identification by prediction by partial matching (PPM).

For every language a variable-order tree of byte contexts is kept: how often each
byte followed each context of 0 to ``ORDER`` bytes.  Under these frozen statistics
the code length of a byte is that of method C: in the longest context seen in
training, a byte seen there costs -log2(n / (T + q)), any other byte first pays the
escape -log2(q / (T + q)) and is coded in the next shorter context, and a byte seen
nowhere costs the eight bits of order -1.  A text is its letter runs, lower-cased,
each coded as a word between spaces; the language with the shortest code wins.

Training texts are a hash sample of at most ``per_language`` labelled documents of
each of the ``most_languages`` most frequent languages, which bounds the trees and
so what is sent to the tasks.  Every document is scored, whole.

Defined cases: null text or a text without letters is ``und`` with score 0; equal
code lengths go to the language first in code-point order; with no labelled
document at all everything is ``und``; null identifiers count as empty text where
the training part is chosen; further columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelens.llm.common import Shared, map_batches, remainder, table
from pacelens.llm.wordcost import WordCosts, frames, groups

ORDER = 4
NOT_KNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MASKS = [(1 << (8 * k)) - 1 for k in range(ORDER + 2)]


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters, in lower case; numbers such as a raised two, a half or a Roman eight are no letters."""
    runs = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join([c if c.isalpha() else " " for c in run]).split()]


class Trees:
    """Frozen context statistics of all languages in sorted arrays."""

    def __init__(self, languages: list[str], grams: np.ndarray, owner: np.ndarray, counts: np.ndarray):
        """``grams``: longest packed grams; ``owner``: index of the language of each."""
        self.languages = languages
        depth, symbols = grams >> 40, grams & MASKS[ORDER + 1]
        self.levels = []
        for k in range(ORDER + 1):
            deep = depth >= k
            key = (owner[deep] << 40) | (symbols[deep] & MASKS[k + 1])
            keys, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, weights=counts[deep], minlength=len(keys))
            context = (keys >> 40 << 40) | ((keys & MASKS[ORDER + 1]) >> 8)
            contexts, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, weights=n, minlength=len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            hit = np.log2((total + kinds)[where] / n).astype(np.float32)
            escape = np.log2((total + kinds) / np.maximum(kinds, 1)).astype(np.float32)
            self.levels.append((keys, hit, contexts, escape))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def price(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram's symbol after its context, per language."""
        depth, symbols = grams >> 40, grams & MASKS[ORDER + 1]
        out = np.zeros((len(grams), len(self.languages)), dtype=np.float32)
        for language in range(len(self.languages)):
            cost, open_ = np.zeros(len(grams), dtype=np.float32), np.ones(len(grams), dtype=bool)
            for k in range(ORDER, -1, -1):
                keys, hit, contexts, escape = self.levels[k]
                todo = np.flatnonzero(open_ & (depth >= k))
                base = language << 40
                at, found = self._find(contexts, base | ((symbols[todo] >> 8) & MASKS[k]))
                todo, at = todo[found], at[found]
                if not len(todo):
                    continue
                here, seen = self._find(keys, base | (symbols[todo] & MASKS[k + 1]))
                cost[todo] += np.where(seen, hit[here], escape[at])
                open_[todo[seen]] = False
            out[:, language] = cost + np.where(open_, 8.0, 0.0)
        return out


def gram_counts(rows):
    """(language, longest gram, count) of each batch of (language, text)."""
    for batch in rows:
        words: dict[str, Counter] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(language, Counter()).update(letter_runs(text))
        for language, found in words.items():
            if not found:
                continue
            packed, starts = frames([w.encode() for w in found], ORDER)
            lengths = np.diff(np.append(starts, len(packed)))
            times = np.repeat(np.fromiter(found.values(), dtype=np.int64, count=len(found)), lengths)
            unique, inverse = np.unique(packed, return_inverse=True)
            n = np.bincount(inverse, weights=times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(unique)), pa.array(unique), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", identifier: str = "doc_id", per_language: int = 400, most_languages: int = 64) -> Trees:
    """Fit the trees on a hash sample of labelled documents (see the module's bounds)."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    draw = F.xxhash64(F.col(identifier), F.col(lang))
    ids = labelled.select(F.col(lang).alias("lang"), draw.alias("h"))
    common = [r["lang"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    ranked = ids.where(F.col("lang").isin(common)).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))) if common else ids.withColumn("r", F.lit(1)).where("false")
    cuts = {r["lang"]: r["cut"] for r in ranked.where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("cut")).collect()}
    languages = sorted(cuts, key=lambda x: x.encode())
    if not languages:
        return Trees([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    drawn = F.lit(False)
    for language, cut in cuts.items():
        drawn = drawn | ((F.col(lang) == language) & (draw <= cut))
    sample = labelled.where(drawn).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = map_batches(sample, gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    index = {x: i for i, x in enumerate(languages)}
    return Trees(languages, found["gram"].to_numpy(np.int64), found["lang"].map(index).to_numpy(np.int64), found["n"].to_numpy(np.float64))


class Identifier:
    """Predictions for lists of texts under frozen trees."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.costs = WordCosts(trees.price, len(trees.languages), ORDER)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per letter byte of each text."""
        names, scores, rates = [], np.zeros(len(texts)), np.zeros(len(texts))
        for start, end in groups(texts):
            words = [letter_runs(t) for t in texts[start:end]]
            bits = self.costs.totals(words) if self.trees.languages else None
            for i, found in enumerate(words):
                if not found or bits is None:
                    names.append(NOT_KNOWN)
                    continue
                best = int(np.argmin(bits[i]))
                names.append(self.trees.languages[best])
                scores[start + i] = 1.0 / np.exp2(-np.minimum(bits[i] - bits[i][best], 1000.0)).sum()
                rates[start + i] = bits[i][best] / sum(len(w) + 1 for w in found)
        return names, scores, rates


def identify(docs: DataFrame, trees: Trees, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """(identifier, lang_pred, score, bits_per_char) of every document."""
    shared = Shared(docs.sparkSession, trees)
    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def score(batches):
        predict = shared.ready(Identifier)
        for batch in batches:
            names, scores, rates = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], names=["id", "lang_pred", "score", "bits_per_char"])

    return map_batches(rows, score, "id long, lang_pred string, score double, bits_per_char double").withColumnRenamed("id", identifier)


def known_language(docs: DataFrame, trees: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more; columns unchanged."""
    shared = Shared(docs.sparkSession, trees)
    at = docs.columns.index(text)

    def keep(batches):
        predict = shared.ready(Identifier)
        for batch in batches:
            names, scores, _ = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != NOT_KNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def run(spark, folder: str) -> DataFrame:
    """op7: the language of every document, learned from those whose crc32 mod 4 is not 2."""
    docs = table(spark, folder, "documents")
    held = remainder("doc_id", 4) == 2
    trees = train(docs.where(~held))
    return identify(docs, trees).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_char")
