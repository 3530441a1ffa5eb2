"""Language-model scoring by deleted interpolation of word bigrams.

    P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

The weights depend on the bucket of the context's frequency (powers of two) and are
learned by expectation-maximisation: counts of nine tenths of the training documents
predict the held-out counts of the last tenth.  Scoring then uses the counts of all
training documents.  A text is its words and one end; an end also starts every text.

How the counts meet the texts: consecutive documents are stored in compressed
*bundles* of bounded size.  A bundle asks for the counts of its distinct words and
bigrams with one packet of hashes and local counts per *shard* of the hash space; a
shard adds up what all bundles sent and answers each packet with counts in the
packet's order.  So a frequent word costs a shard one entry per bundle, nothing is
broadcast, no shard or bundle grows with the corpus, and the number of shards and
bundles does.  Words are told apart by 64-bit hashes, bigrams by their shard and 40
further bits.

Defined cases: null text is empty and has one token, its end; a null identifier
counts as the empty text where folds are drawn; an empty table gives an empty
result; a corpus without training documents scores everything 1 / (V + 1) = 1;
repeated rows are counted and scored as often as they stand there; further columns
are left alone.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise
from pacelens.llm.common import map_batches, ship, table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUNDLE_CHARS = 8_000_000
SHARD_CHARS = 8_000_000  #: text per shard of the hash space
BUCKETS = 48
END_HASH = np.uint64(0x9E3779B97F4A7C15)
LOW40 = np.uint64((1 << 40) - 1)


def fold(identifier: int | None, divisor: int, test: int) -> int:
    """0: not trained on; 1: counted; 2: held-out counts of the training documents."""
    crc = zlib.crc32(b"" if identifier is None else str(identifier).encode())
    return 0 if crc % divisor == test else 2 if crc // divisor % 10 == 0 else 1


def bundled(docs: DataFrame, text: str, identifier: str) -> DataFrame:
    """(bundle, chars, ids, sizes, blob): consecutive documents in compressed bundles, stored.

    A bundle's number is drawn, not computed from its rows: equal bundles are two."""

    def pack(batches):
        ids, texts, chars = [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def flush():
            blob = press.compress(b"".join(texts))
            number = uuid.uuid4().int >> 64  # stored with the bundle, so equal bundles stay two
            return pa.RecordBatch.from_arrays(
                [pa.array([number - (1 << 63)], pa.int64()), pa.array([chars], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([blob], pa.binary())],
                names=["bundle", "chars", "ids", "sizes", "blob"],
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = (t or "").encode()
                ids.append(i)
                texts.append(t)
                chars += len(t) + 1
                if chars >= BUNDLE_CHARS:
                    yield flush()
                    ids, texts, chars = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(map_batches(rows, pack, "bundle long, chars long, ids array<long>, sizes array<int>, blob binary"))


class Tokens:
    """A bundle's token stream over its own vocabulary, and its distinct bigrams."""

    def __init__(self, sizes: list[int], blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=sum(sizes) + 1).translate(LOWER) if sum(sizes) else b""
        local: dict[bytes, int] = {b"": 0}  # the end
        number, parts, at = local.setdefault, [], 0
        self.lengths = np.zeros(len(sizes), dtype=np.int64)
        for k, n in enumerate(sizes):
            words = data[at : at + n].split()
            at += n
            self.lengths[k] = len(words) + 1
            parts.append(np.fromiter((number(w, len(local)) for w in words), dtype=np.int32, count=len(words)))
            parts.append(np.zeros(1, dtype=np.int32))
        self.stream = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        self.words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in local), dtype=np.uint64, count=len(local))
        self.words[0] = END_HASH
        before = np.concatenate([[0], self.stream[:-1]])
        self.pairs, self.pair_of = np.unique(before * len(local) + self.stream, return_inverse=True)
        self.v, self.w = self.pairs // len(local), self.pairs % len(local)
        h = self.words[self.v] * np.uint64(0xBF58476D1CE4E5B9) + (self.words[self.w] ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        self.bigrams = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)

    def counts(self, folds: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Local (word, bigram) counts in documents of one fold."""
        mine = np.repeat(folds == which, self.lengths)
        return np.bincount(self.stream[mine], minlength=len(self.words)), np.bincount(self.pair_of[mine], minlength=len(self.pairs))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def small(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").tobytes(), 1)


def big(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), dtype="<u4").astype(np.int64)


def by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions ordered by shard, start of each shard among them)."""
    s = shard_of(h, shards)
    order = np.argsort(s, kind="stable")
    return order, np.searchsorted(s[order], np.arange(shards + 1))


PACKET = "shard int, bundle long, word binary, word_r binary, word_h binary, pair binary, pair_r binary, pair_h binary"
ANSWER = "bundle long, shard int, word_r binary, word_h binary, pair_r binary, pair_h binary, n_r long, n_h long, v_r long, v_all long"


def requests(bundles: DataFrame, shards: int, divisor: int, test: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for bundle, ids, sizes, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                tokens = Tokens(sizes, blob)
                folds = np.array([fold(i, divisor, test) for i in ids])
                (wr, pr), (wh, ph) = tokens.counts(folds, 1), tokens.counts(folds, 2)
                w_order, w_at = by_shard(tokens.words, shards)
                p_order, p_at = by_shard(tokens.bigrams, shards)
                out = {k: [] for k in ("shard", "bundle", "word", "word_r", "word_h", "pair", "pair_r", "pair_h")}
                for s in range(shards):
                    w, p = w_order[w_at[s] : w_at[s + 1]], p_order[p_at[s] : p_at[s + 1]]
                    if not len(w) and not len(p):
                        continue
                    short = np.ascontiguousarray(tokens.bigrams[p]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    for k, x in zip(out, (s, bundle, tokens.words[w].tobytes(), small(wr[w]), small(wh[w]), short, small(pr[p]), small(ph[p]))):
                        out[k].append(x)
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return map_batches(bundles.select("bundle", "ids", "sizes", "blob"), ask, PACKET)


def totals(keys: list[np.ndarray], r: list[bytes], h: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Summed counts in the order of each packet's keys, and per distinct key."""
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([big(x) for x in c])).astype(np.int64) for c in (r, h)]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    parts = np.split(inverse, cuts)
    return [sums[0][p] for p in parts], [sums[1][p] for p in parts], sums[0], sums[1]


def answer(group: pa.Table) -> pa.Table:
    """A shard's answers to its packets; its own totals stand in a row with a null bundle."""
    c = {n: group.column(n).to_pylist() for n in group.column_names}
    words = [np.frombuffer(x, dtype=np.uint64) for x in c["word"]]
    pairs = []
    for x in c["pair"]:
        wide = np.zeros((len(x) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 5)
        pairs.append(wide.reshape(-1).view(np.uint64))
    wr, wh, all_r, all_h = totals(words, c["word_r"], c["word_h"])
    pr, ph, _, _ = totals(pairs, c["pair_r"], c["pair_h"])
    n, none = len(words), [None]
    own = [int(all_r.sum()), int(all_h.sum()), int((all_r > 0).sum()), int((all_r + all_h > 0).sum())]
    columns = [pa.array(c["bundle"] + none, pa.int64()), pa.array(c["shard"] + [c["shard"][0]], pa.int32())]
    columns += [pa.array([small(x) for x in part] + none, pa.binary()) for part in (wr, wh, pr, ph)]
    columns += [pa.array([None] * n + [x], pa.int64()) for x in own]
    return pa.Table.from_arrays(columns, names=["bundle", "shard", "word_r", "word_h", "pair_r", "pair_h", "n_r", "n_h", "v_r", "v_all"])


def counted(left: pa.Table, right: pa.Table, shards: int):
    """(ids, tokens, [word counts r, h], [bigram counts r, h]) of a bundle and its answers."""
    ids, sizes, blob = (left.column(k)[0].as_py() for k in ("ids", "sizes", "blob"))
    tokens = Tokens(sizes, blob)
    w_order, w_at = by_shard(tokens.words, shards)
    p_order, p_at = by_shard(tokens.bigrams, shards)
    word, pair = np.zeros((2, len(tokens.words)), dtype=np.int64), np.zeros((2, len(tokens.pairs)), dtype=np.int64)
    got = right.to_pydict()
    for i, s in enumerate(got["shard"]):
        for k, part in enumerate(("r", "h")):
            word[k, w_order[w_at[s] : w_at[s + 1]]] = big(got[f"word_{part}"][i])
            pair[k, p_order[p_at[s] : p_at[s + 1]]] = big(got[f"pair_{part}"][i])
    return ids, tokens, word, pair


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def learn_weights(evidence: DataFrame, n: int, v: int, rounds: int = 30, settled: float = 1e-4) -> np.ndarray:
    """EM for the weights (l2, l1, l0) per bucket on (bucket, c2, c1, c0, n) rows of held-out counts."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    weights[0] = [0.0, 0.5, 0.5]
    column = lambda k: F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("bucket") + 1)
    for _ in range(rounds):
        parts = [column(0) * F.when(F.col("c1") > 0, F.col("c2") / F.col("c1")).otherwise(0.0), column(1) * F.col("c0") / max(n, 1), column(2) / (v + 1)]
        whole = parts[0] + parts[1] + parts[2]
        found = evidence.groupBy("bucket").agg(*[F.sum(F.col("n") * p / whole).alias(f"e{k}") for k, p in enumerate(parts)]).collect()
        before = weights.copy()
        for r in found:
            e = np.array([r["e0"], r["e1"], r["e2"]]) + 1e-3
            if r["bucket"] == 0:
                e[0] = 0.0
            weights[r["bucket"]] = e / e.sum()
        if np.abs(weights - before).max() < settled:
            break
    seen = sorted(r["bucket"] for r in found) if rounds else []
    for b in range(1, BUCKETS):  # buckets without evidence take the nearest below, or above
        if seen and b not in seen:
            weights[b] = weights[max([s for s in seen if 0 < s < b], default=min([s for s in seen if s > 0], default=b))]
    return weights


def score(docs: DataFrame, text: str = "text", identifier: str = "doc_id", divisor: int = 7, test: int = 2) -> DataFrame:
    """(identifier, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Trained on documents whose crc32 modulo ``divisor`` is not ``test``."""
    spark = docs.sparkSession
    ship(spark)
    bundles = bundled(docs, text, identifier)
    size = bundles.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))
    answers = materialise(requests(bundles, shards, divisor, test).groupBy("shard").applyInArrow(answer, ANSWER))
    sums = answers.where("bundle is null").agg(*[F.sum(c).alias(c) for c in ("n_r", "n_h", "v_r", "v_all")]).first()
    n_r, n_h, v_r, v = (sums[c] or 0 for c in ("n_r", "n_h", "v_r", "v_all"))
    n = n_r + n_h
    both = lambda: bundles.select("bundle", "ids", "sizes", "blob").groupBy("bundle").cogroup(answers.where("bundle is not null").select("bundle", "shard", "word_r", "word_h", "pair_r", "pair_h").groupBy("bundle"))

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tokens, word, pair = counted(left, right, shards)
        h = tokens.counts(np.array([fold(i, divisor, test) for i in ids]), 2)[1]
        at = np.flatnonzero(h)
        rows = np.stack([bucket(word[0][tokens.v[at]]), pair[0][at], word[0][tokens.v[at]], word[0][tokens.w[at]]])
        order = np.lexsort(rows)
        rows, h = rows[:, order], h[at][order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if len(at) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(h, first) if len(first) else np.zeros(0, dtype=np.int64)
        return pa.Table.from_arrays([pa.array(rows[0][first].astype(np.int32)), *[pa.array(rows[k][first]) for k in (1, 2, 3)], pa.array(sums.astype(np.int64))], names=["bucket", "c2", "c1", "c0", "n"])

    evidence = both().applyInArrow(held_out, "bucket int, c2 long, c1 long, c0 long, n long")
    evidence = materialise(evidence.groupBy("bucket", "c2", "c1", "c0").agg(F.sum("n").alias("n")))
    weights = learn_weights(evidence, n_r, v_r)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tokens, word, pair = counted(left, right, shards)
        c, c2 = word.sum(axis=0), pair.sum(axis=0)
        context = c[tokens.v]
        l2, l1, l0 = weights[bucket(context)].T
        p = l2 * c2 / np.maximum(context, 1) + l1 * c[tokens.w] / max(n, 1) + l0 / (v + 1)
        if n == 0:
            p = np.full(len(p), 1.0 / (v + 1))
        starts = np.concatenate([[0], np.cumsum(tokens.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((c + 1) / (n + v + 1))
        return pa.Table.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(tokens.lengths), pa.array(add((c > 0).astype(np.int64)[tokens.stream])),
                pa.array([n] * len(ids), pa.int64()), pa.array(add(base[tokens.stream])), pa.array(add(np.log10(p)[tokens.pair_of])),
            ],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = both().applyInArrow(scores, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", identifier)


def run(spark, folder: str) -> DataFrame:
    """op5: scores of all documents, learned from those whose crc32 mod 7 is not 2."""
    scored = score(table(spark, folder, "documents"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
