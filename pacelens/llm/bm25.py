"""Exact top-k search: BM25 over sharded inverted indexes, pruned by scores of bounded error.

Consecutive documents form shards of bounded size.  A shard's index is one stored
row: sorted term hashes, postings (document, term frequency) in document order, and
document lengths.  Queries are handled in blocks of a bounded number of terms, the
only thing broadcast; a block is a pass over the shards.  First every shard reports
the document frequencies of the block's terms, which are summed over all shards;
with these global statistics each shard then finds its own top k, and the shards'
lists are merged.  A document's score is computed in one shard from global
statistics, so the merged list is the exact list over all documents.

Inside a shard a query's score of every document is summed up twice.  First roughly:
the lists of frequent terms are rows of a single-precision matrix, multiplied for a
batch of queries at once, the other lists are added posting by posting.  The error of
that sum has a bound, so only documents that may still reach the current k-th score are
scored exactly, in the blocks of ``BLOCK`` documents that hold one; a query whose lists'
largest contributions together stay below that score does not read the shard's lists.
The k-th score is carried from shard to shard of a task, which hands on k rows a query
whatever the number of its shards.

Tokens are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in
lower case.  score(q, d) = sum over distinct terms of q, times their number in q, of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avglen)),
rounded to six places; ties go to the smaller identifier (null last).

Defined cases: null and empty texts have no tokens, match nothing and ask for
nothing; only documents that share a term with a query are listed, so a list may be
shorter than k; repeated rows are documents of their own; an empty table or no
queries give an empty result; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise
from pacelens.llm.common import Shared, map_batches, ship, table

K1, B = 1.2, 0.75
BLOCK = 64
FREQUENT = 0.04  #: share of a shard's documents from which a term's list is kept dense
BATCH = 256
BATCH_SCORES = 8_000_000  #: rough scores held at once
EXACT = 1_000_000  #: contributions of an exact sum held at once
SHARD_CHARS = 48_000_000
QUERY_TERMS = 2_000_000
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class TermHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(text: str | None, hashes: TermHashes) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


SHARD = "shard long, n long, size long, ids array<long>, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def build(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    """The stored index, one row per shard."""

    def index(batches):
        hashes, press = TermHashes(), zstandard.ZstdCompressor(level=1)
        ids, parts, chars, serial = [], [], 0, 0

        def flush():
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            terms, term_of = np.unique(np.concatenate(parts), return_inverse=True)
            doc_of = np.repeat(np.arange(len(parts)), lengths)
            pairs, tf = np.unique(term_of.astype(np.int64) * len(parts) + doc_of, return_counts=True)
            starts = np.searchsorted(pairs // len(parts), np.arange(len(terms) + 1))
            blobs = [press.compress(x.tobytes()) for x in (lengths.astype(np.int32), terms, starts.astype(np.int32), (pairs % len(parts)).astype(np.int32), tf.astype(np.int32))]
            columns = [pa.array([x], pa.int64()) for x in (serial, len(parts), int(lengths.sum()))] + [pa.array([ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in blobs]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                parts.append(hashed(t, hashes))
                chars += len(t or "") + 1
                if chars >= SHARD_CHARS:
                    yield flush()
                    ids, parts, chars, serial = [], [], 0, serial + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(map_batches(rows, index, SHARD))


def opened(row: dict) -> dict:
    """A shard's arrays."""
    press = zstandard.ZstdDecompressor()
    kinds = {"lengths": np.int32, "terms": np.uint64, "starts": np.int32, "docs": np.int32, "tfs": np.int32}
    return row | {k: np.frombuffer(press.decompress(row[k]), dtype=kind) for k, kind in kinds.items()}


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all positions of the ranges, number of the range each belongs to)."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + np.repeat(starts - np.cumsum(n) + n, n), owner


class Queries:
    """A block of queries: their identifiers, distinct terms and numbers of each."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashes = TermHashes()
        found = [np.unique(hashed(t, hashes), return_counts=True) for t in texts]
        self.ids, self.ends = ids, np.cumsum([len(t) for t, _ in found])
        flat = np.concatenate([t for t, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        self.times = np.concatenate([c for _, c in found]).astype(np.float64) if found else np.zeros(0)
        self.terms, self.which = np.unique(flat, return_inverse=True)
        self.idf = np.zeros(len(self.terms))
        self.mean = 1.0


class Searcher:
    """One opened shard.

    The lists of terms that many of the shard's documents hold are rows of dense
    matrices: rough contributions in single precision, and the terms' numbers for
    exact ones.  A batch of queries multiplies the rows of its own terms only."""

    def __init__(self, shard: dict, queries: Queries, k: int):
        s, self.queries, self.k = opened(shard), queries, k
        self.null = np.array([i is None for i in s["ids"]], dtype=bool)
        self.ids = np.array([0 if i is None else i for i in s["ids"]], dtype=np.int64)
        n = self.n = len(self.ids)
        at = np.minimum(np.searchsorted(s["terms"], queries.terms), max(len(s["terms"]) - 1, 0))
        here = s["terms"][at] == queries.terms if len(s["terms"]) else np.zeros(len(queries.terms), dtype=bool)
        used = at[here]
        starts, ends = s["starts"][used].astype(np.int64), s["starts"][used + 1].astype(np.int64)
        often = ends - starts >= max(FREQUENT * n, 8)
        # places of the block's terms among the dense and among the other lists of this shard
        self.dense_of, self.local = np.full(len(queries.terms), -1), np.full(len(queries.terms), -1)
        self.dense_of[np.flatnonzero(here)[often]] = np.arange(often.sum())
        self.local[np.flatnonzero(here)[~often]] = np.arange((~often).sum())
        self.norm = K1 * (1 - B + B * s["lengths"] / queries.mean)
        idf = queries.idf[here]

        def lists(which):
            place, term = spread(starts[which], ends[which])
            docs, tf = s["docs"][place], s["tfs"][place]
            return docs, term, tf, idf[which][term] * tf * (K1 + 1) / (tf + self.norm[docs])

        docs, term, tf, impact = lists(often)
        self.rough, self.tfs, self.idf = np.zeros((int(often.sum()), n), dtype=np.float32), np.zeros((int(often.sum()), n), dtype=np.int32), idf[often]
        self.rough[term, docs], self.tfs[term, docs] = impact, tf
        self.docs, term, _, self.impact = lists(~often)
        self.list_start = np.searchsorted(term, np.arange((~often).sum() + 1))
        first = self.list_start[:-1]
        # the largest contribution of each of the block's terms in this shard
        self.most = np.zeros(len(queries.terms))
        self.most[self.local >= 0] = np.maximum.reduceat(self.impact, first) if len(first) else 0.0
        self.most[self.dense_of >= 0] = self.rough.max(axis=1) if len(self.rough) else 0.0
        self.blocks, self.rows = -(-n // BLOCK), max(1, min(BATCH, BATCH_SCORES // max(n, 1)))
        self.batch = (-1, None)
        self.entered = self.scored = 0

    def _frequent(self, number: int) -> np.ndarray:
        """Rough scores of all documents from a query's frequent terms."""
        q, which = self.queries, number // self.rows
        if self.batch[0] != which:
            lo, last = which * self.rows, min((which + 1) * self.rows, len(q.ids))
            ends = np.concatenate([[0], q.ends])
            part = slice(ends[lo], ends[last])
            row, column = np.repeat(np.arange(last - lo), np.diff(ends[lo : last + 1])), self.dense_of[q.which[part]]
            there = column >= 0
            asked, place = np.unique(column[there], return_inverse=True)
            weights = np.zeros((last - lo, len(asked)), dtype=np.float32)
            weights[row[there], place] = q.times[part][there]
            self.batch = which, weights @ (self.rough if len(asked) == len(self.rough) else self.rough[asked])
        return self.batch[1][number % self.rows]

    def _exact(self, docs: np.ndarray, dense: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of some documents from a query's frequent terms."""
        out, step = np.zeros(len(docs)), max(1, EXACT // max(len(dense), 1))
        for at in range(0, len(docs), step):
            some = docs[at : at + step]
            tf = self.tfs[np.ix_(dense, some)]
            out[at : at + step] = (self.idf[dense, None] * tf * (K1 + 1) / (tf + self.norm[some]) * times[:, None]).sum(axis=0)
        return out

    def top(self, number: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, rounded scores) of a query's best k in this shard that reach ``least``."""
        q = self.queries
        lo, hi = (q.ends[number - 1] if number else 0), q.ends[number]
        asked, times = q.which[lo:hi], q.times[lo:hi]
        # single precision: a half unit for each contribution, weight, product and sum, twice over
        error = (len(self.rough) + 8) * 1.2e-7
        reach = lambda score: score * (1 - 2 * error) - 1e-6
        bound = (self.most[asked] * times).sum()
        if not bound or bound * (1 + error) < reach(least):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        term, often = self.local[asked], self.dense_of[asked]
        rare = term >= 0
        place, owner = spread(self.list_start[term[rare]], self.list_start[term[rare] + 1])
        rest = np.bincount(self.docs[place], weights=self.impact[place] * times[rare][owner], minlength=self.n)
        rough = rest + self._frequent(number)
        found = np.flatnonzero(rough >= max(reach(least), 1e-300))
        if len(found) > self.k:
            best = np.partition(rough[found], len(found) - self.k)[len(found) - self.k]
            found = found[rough[found] >= max(reach(reach(best)), 1e-300)]
        self.entered, self.scored = self.entered + len(np.unique(found // BLOCK)), self.scored + len(found)
        values = np.round(self._exact(found, often[often >= 0], times[often >= 0]) + rest[found], 6)
        found, values = found[values > 0], values[values > 0]
        order = np.lexsort((self.ids[found], self.null[found], -values))[: self.k]
        return found[order], values[order]


class Best:
    """The best k of every query over the shards of one task."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.kept: list[list[tuple[float, bool, int]]] = [[] for _ in queries.ids]

    def add(self, shard: Searcher) -> None:
        for number, kept in enumerate(self.kept):
            full = len(kept) >= self.k
            docs, scores = shard.top(number, -kept[-1][0] if full else 0.0)
            if len(docs):
                kept += zip((-scores).tolist(), shard.null[docs].tolist(), shard.ids[docs].tolist())
                kept.sort()
                del kept[self.k :]

    def rows(self) -> pa.RecordBatch:
        flat = [(at, q, null, None if null else i, -s) for at, (q, kept) in enumerate(zip(self.queries.ids, self.kept)) for s, null, i in kept]
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], kind) for c, kind in enumerate(kinds)], names=["at", "query_id", "null_last", "doc_id", "score"])


def blocks_of(queries: DataFrame, text: str, identifier: str):
    """Blocks of queries of a bounded number of terms, read through the driver one after another."""
    ids, texts, size = [], [], 0
    for row in queries.select(F.col(identifier).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).orderBy("i").toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"] or "") // 4 + 1
        if size >= QUERY_TERMS:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", identifier: str = "doc_id", query_text: str = "text", query_id: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query row; equal queries have a list each."""
    spark = docs.sparkSession
    ship(spark)
    index = build(docs, text, identifier)
    n, total = (x or 0 for x in index.agg(F.sum("n"), F.sum("size")).first())
    lists = None
    for number, block in enumerate(blocks_of(queries, query_text, query_id)):
        plain = Shared(spark, block.terms)

        def frequencies(batches, plain=plain):
            wanted = plain.ready(lambda x: x)
            for batch in batches:
                for one in range(len(batch)):
                    s = opened(batch.slice(one, 1).to_pylist()[0] | {k: zstandard.compress(b"") for k in ("lengths", "docs", "tfs")})
                    at = np.minimum(np.searchsorted(s["terms"], wanted), max(len(s["terms"]) - 1, 0))
                    here = np.flatnonzero(s["terms"][at] == wanted) if len(s["terms"]) else np.zeros(0, dtype=np.int64)
                    df = s["starts"][at[here] + 1] - s["starts"][at[here]]
                    yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(df.astype(np.int64))], names=["at", "df"])

        found = map_batches(index.select("terms", "starts"), frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block.terms))
        df[found.column("at").to_numpy()] = found.column("df").to_numpy()
        block.idf, block.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(total / max(n, 1), 1e-9)
        shared = Shared(spark, block)

        def best(batches, shared=shared):
            block = shared.ready(lambda x: x)
            task = Best(block, k)
            for batch in batches:
                for one in range(len(batch)):
                    task.add(Searcher(batch.slice(one, 1).to_pylist()[0], block, k))
            yield task.rows()

        found = map_batches(index, best, "at int, query_id long, null_last boolean, doc_id long, score double")
        part = materialise(found.withColumn("block", F.lit(number)))
        lists = part if lists is None else lists.union(part)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    merged = Window.partitionBy("block", "at").orderBy(F.desc("score"), "null_last", "doc_id")
    return lists.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def run(spark, folder: str) -> DataFrame:
    """op8: for every document whose id is divisible by 100, the ten best of all documents."""
    docs = table(spark, folder, "documents")
    return search(docs, docs.where("doc_id % 100 = 0"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*)::DOUBLE AS len FROM words GROUP BY doc_id),
whole AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM words)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (d.tf * (1.2::DOUBLE + 1)
    / (d.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean)))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN lengths l ON l.doc_id = d.doc_id, whole
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""
