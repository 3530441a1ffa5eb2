"""Near-duplicates by order MinHash with banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it
has occurred before.  A sketch value picks the ``TAKE`` shingles least under one
hash function and hashes them *in text order*, so it is kept only by texts that
share these shingles in the same order: the sketch is sensitive to edits, not just
to the set of shingles.  Half of the sketch values look at first occurrences only,
so a passage that is merely repeated does not hide a copy.

Texts that agree in a sketch value are candidates; a banded alignment of their
first-occurrence shingle sequences (longest common subsequence L, bit-parallel)
accepts a pair iff L / (n_a + n_b - L) reaches the threshold.  Accepted pairs are
links, and the connected components of the links are the classes.

Scale: exact copies are one class from the start, by a 128-bit text hash, and one
node of the link graph, numbered by 64 bits of it.  Texts are read again only for
nodes in a candidate pair; others are passed over in the scan by a bit table of
bounded size.  A
bucket of at most ``SMALL`` nodes tests all its pairs.  Larger ones are contracted
first: each node is tested against the bucket's first node, then, in buckets left
with several classes, against its neighbour by length in salted parts of about
``PART`` nodes and within (bucket, second sketch value).  What is still left with
several classes is exhausted: the bucket is dealt into blocks of at most about
``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles, blocks meet in pairs, and all their
pairs of different classes are tested, each in the first bucket it shares; exact
counts of common shingles, by matrix products, say which need an alignment.  So the
links are those of all pairs in all buckets, up to links inside a class; rows grow
with the square of a bucket's number of blocks, and only in such buckets.

Defined cases: words are runs of letters and digits, lower-cased (a text without
any is split at white space); a text of fewer than five words is one shingle; null
text is the empty text, and empty texts are copies of each other; the class id is
the least identifier of the class (null only if all are null); repeated rows stay
rows of one class; further columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise
from pacelens.llm.common import Shared, forget, map_batches, table, text_key, text_of
from pacelens.llm.components import components

SHINGLE = 5
SKETCHES = 10
TAKE = 2
LEAST = 0.8
SMALL = 16
PART = 500
BLOCK = 1000
BLOCK_SHINGLES = 500_000
CODES = 4096  #: columns of a matrix product
MOST_BITS = 1 << 28  #: bound of the broadcast membership bits (32 MB)
WORDS = re.compile(r"[^\W_]+")

_draw = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _draw.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, SKETCHES, dtype=np.uint64)
POWERS = [pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(max(SHINGLE, TAKE) + 1)]
LABEL = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the word shingles of a text in order."""
    words = WORDS.findall(text.lower()) or text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + len(out)] * np.uint64(POWERS[k])
    return out ^ (out >> np.uint64(29))


def occurrence(x: np.ndarray) -> np.ndarray:
    """How often each element has occurred before its position."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(x))
    label = np.empty(len(x), dtype=np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return label


def sketch(x: np.ndarray) -> tuple[list[int], int]:
    """(order MinHash values, number of distinct shingles)."""
    if not len(x):
        return [], 0
    label = occurrence(x)
    plain = x[label == 0]
    out = []
    for rows, half in ((x + label * LABEL, slice(0, SKETCHES // 2)), (plain, slice(SKETCHES // 2, SKETCHES))):
        h = rows[None, :] * FACTORS[half, None] + SHIFTS[half, None]
        h ^= h >> np.uint64(32)
        take = min(TAKE, h.shape[1])
        at = np.argpartition(h, take - 1, axis=1)[:, :take] if take < h.shape[1] else np.tile(np.arange(take), (h.shape[0], 1))
        at.sort(axis=1)
        value = np.zeros(h.shape[0], dtype=np.uint64)
        for k in range(take):
            value = (value ^ rows[at[:, k]]) * np.uint64(POWERS[k + 1] | 1)
            value ^= value >> np.uint64(31)
        out += value.view(np.int64).tolist()
    return out, len(plain)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Banded alignment similarity of two sequences of distinct shingles, 0 where it is below ``least``.

    A pair at the threshold leaves at most (1 - least) / (1 + least) of both lengths
    together unmatched, which bounds how far matches lie off the diagonal."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    if common < least * (n + m - common):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    where: dict[int, int] = {x: i for i, x in enumerate(a[head : n - tail].tolist())}
    width = n - tail - head
    v = everything = (1 << width) - 1
    for i, x in enumerate(b[head : m - tail].tolist()):
        j = where.get(x)
        if j is None or abs(i - j) > band:
            continue
        u = v & (1 << j)
        v = ((v + u) | (v - u)) & everything
    length = head + tail + width - v.bit_count()
    similarity = length / (n + m - length)
    return similarity if similarity >= least else 0.0


def sketched(docs: DataFrame, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """(id, key, n, sketches) of every row: text key, number of distinct shingles, sketch values."""

    def run_batches(batches):
        forget()
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                found = [sketch(shingles(t, hashes)) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int32()), pa.array([s for s, _ in found], pa.list_(pa.int64()))],
                    names=["id", "key", "n", "sketches"],
                )

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), text_key(text).alias("key"), text_of(text).alias("text"))
    return map_batches(rows, run_batches, "id long, key binary, n int, sketches array<long>")


def candidates(buckets: DataFrame, chained: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs to test, members of buckets too large to test all pairs) of (bucket, node, n, root) rows.

    Pairs of one root are left out.  Members of a large bucket are tested against its
    first node, and if ``chained`` also against their neighbours by length."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n", "root")).alias("first")).where("size > 1")
    members = buckets.join(sizes, "bucket")
    listed = members.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("m"))
    rest = lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    pairs = listed.select(F.explode(F.flatten(F.transform("m", rest))).alias("p")).select("p.x", "p.y")
    large = members.where(F.col("size") > SMALL)
    me = F.struct("node", "n", "root")
    pairs = pairs.union(large.select(F.col("first").alias("x"), me.alias("y")))
    if chained:
        order = F.xxhash64("node", "bucket")
        near = Window.partitionBy("bucket", "part").orderBy("n", "o")
        part = large.withColumn("o", order).withColumn("part", F.pmod("o", F.ceil(F.col("size") / PART)))
        pairs = pairs.union(part.select(F.lag(me).over(near).alias("x"), me.alias("y")).where("x is not null"))
    differ = (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n"))
    pairs = pairs.where(differ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return pairs, large.select("bucket", "node", "n")


def membership(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set at the hashes of all nodes: 16 bits a node, ``MOST_BITS`` at most (then more texts pass than needed)."""
    size = 1 << max(16, min(MOST_BITS.bit_length() - 1, (16 * nodes.count()).bit_length()))

    def pack(group: pa.Table) -> pa.Table:
        slots = group.column("slot").to_numpy()
        bits = np.zeros(1 << 16, dtype=bool)
        bits[slots & 0xFFFF] = True
        return pa.Table.from_arrays([pa.array([int(slots[0]) >> 16], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    slots = nodes.select((F.col("node").bitwiseAND(size - 1)).alias("slot")).distinct().withColumn("part", F.shiftright("slot", 16))
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in slots.groupBy("part").applyInArrow(pack, "part long, bits binary").collect():
        out[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out, size


def texts_of(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, t) of the wanted nodes.  Texts that are not wanted are left out where they are read."""
    shared = Shared(docs.sparkSession, membership(nodes))

    def keep(batches):
        bits, size = shared.ready(lambda x: x)
        for batch in batches:
            slot = batch.column(0).to_numpy() & (size - 1)
            yield batch.filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))

    near = map_batches(docs.select(F.xxhash64(text_key(text)).alias("node"), text_of(text).alias("t")), keep, "node long, t string")
    return materialise(near.groupBy("node").agg(F.first("t").alias("t")).join(nodes, "node", "left_semi"))


def verified(pairs: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """The pairs of nodes whose texts align; texts are fetched only for nodes in a pair."""
    wanted = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    texts = texts_of(wanted, docs, text)
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def test(batches):
        forget()
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                keep, last = [], (None, None)
                for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if last[0] != t:
                        x = shingles(t, hashes)
                        last = (t, x[occurrence(x) == 0])
                    x = shingles(s, hashes)
                    keep.append(aligned(x[occurrence(x) == 0], last[1], least) > 0)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, test, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every left with every right sequence of distinct shingles."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    joint = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for side in (left, right):
        x, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        code = np.minimum(np.searchsorted(joint, x), max(len(joint) - 1, 0))
        both = joint[code] == x if len(joint) else np.zeros(len(x), dtype=bool)
        code, row = code[both], row[both]
        order = np.argsort(code, kind="stable")
        sides.append((code[order], row[order], len(side)))
    for low in range(0, len(joint), CODES):
        parts = []
        for code, row, size in sides:
            at = slice(*np.searchsorted(code, [low, low + CODES]))
            part = np.zeros((size, min(CODES, len(joint) - low)), dtype=np.float32)
            part[row[at], code[at] - low] = 1.0
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def block_links(group: pa.Table, least: float) -> pa.Table:
    """Links (a, b) of two blocks of a bucket: all their pairs of different classes are tested."""
    at, p, q = (group.column(c)[0].as_py() for c in ("at", "p", "q"))
    node, root, block = (group.column(c).to_numpy() for c in ("node", "root", "block"))
    values = np.array(group.column("sketches").to_pylist(), dtype=np.int64)
    x = [np.frombuffer(b, dtype=np.uint64) for b in group.column("x").to_pylist()]
    n = np.array([len(s) for s in x])
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    a, b = [], []
    if len(left) and len(right):
        common = common_counts([x[i] for i in left], [x[j] for j in right]).astype(np.float64)
        test = (common * (1 + least) >= least * (n[left][:, None] + n[right][None, :]) - 1e-6) & (root[left][:, None] != root[right][None, :])
        for k in range(at):  # pairs that share an earlier sketch value are tested in that bucket
            test &= values[left, k][:, None] != values[right, k][None, :]
        if p == q:
            test = np.triu(test, 1)
        i, j = np.nonzero(test)
        order = np.argsort(-common[i, j], kind="stable")
        up = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        for i, j in zip(left[i[order]].tolist(), right[j[order]].tolist()):
            s, t = top(int(root[i])), top(int(root[j]))
            if s != t and aligned(x[i], x[j], least) > 0:
                up[max(s, t)] = min(s, t)
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def exhausted(crowd: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """Links (a, b) among all pairs of different roots in the buckets of (bucket, at, node, n, sketches, root) rows."""
    size = F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("w") / BLOCK_SHINGLES))
    held = crowd.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("bigint")).alias("w"))
    held = held.withColumn("own", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("w") / BLOCK_SHINGLES)))
    shared = held.where("own = 1").groupBy("bucket").agg(size.alias("shared"))
    dealt = held.join(shared, "bucket", "left").select("bucket", "root", "own", "shared")
    large = F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("own")))
    block = F.when(F.col("own") > 1, large).otherwise(F.pmod(F.xxhash64("root", F.lit(2)), F.col("shared")))
    members = materialise(crowd.join(dealt, ["bucket", "root"]).withColumn("block", block).drop("own", "shared"))
    blocks = members.groupBy("bucket", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    p, q = (blocks.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high")]) for k in "pq")
    met = p.join(q, "bucket").where("block_p <= block_q AND least(low_p, low_q) <> greatest(high_p, high_q)")
    met = materialise(met.select("bucket", F.col("block_p").alias("p"), F.col("block_q").alias("q")))
    sides = met.select("bucket", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"), "p", "q")

    def shingled(batches):
        forget()
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                found = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[occurrence(x) == 0].tobytes() for x in found], pa.binary())], names=["node", "x"])

    texts = map_batches(texts_of(materialise(members.select("node").distinct()), docs, text), shingled, "node long, x binary")
    rows = members.join(texts, "node").join(sides, ["bucket", "block"]).select("bucket", "p", "q", "block", "at", "node", "root", "sketches", "x")
    return rows.groupBy("bucket", "p", "q").applyInArrow(lambda group: block_links(group, least), "a long, b long")


def left_mixed(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The (bucket, node, n, root) rows of buckets that hold several roots."""
    rooted = large.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return materialise(rooted.join(mixed, "bucket"))


def classes(docs: DataFrame, text: str = "text", identifier: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(id, key, root) of every row: rows with equal roots are one class."""
    rows = materialise(sketched(docs, text, identifier))
    nodes = rows.groupBy(F.xxhash64("key").alias("node")).agg(F.first("n").alias("n"), F.first("sketches").alias("sketches")).where("n > 0")
    spread = nodes.select("node", "n", F.posexplode("sketches").alias("at", "value"))
    buckets = spread.select(F.xxhash64("at", "value").alias("bucket"), "node", "n", F.col("node").alias("root"))
    pairs, large = candidates(buckets, chained=False)
    tested = materialise(pairs)
    links = materialise(verified(tested, docs, text, least))
    roots = materialise(components(links))
    # crowded buckets that are left with several classes: contract them by few tests, then exhaust what is left
    crowd = left_mixed(large, roots)
    if not crowd.isEmpty():
        # a node takes part through its first mixed bucket alone: what that leaves is exhausted below
        first = crowd.groupBy("node").agg(F.min_by(F.struct("bucket", "n", "root"), "bucket").alias("c")).select("node", "c.*")
        # joined before the sketch values are spread, and stored: the tests below read these rows several times
        again = first.join(nodes.select("node", "sketches"), "node").select("bucket", "node", "n", "root", F.posexplode("sketches").alias("at", "value"))
        again = materialise(again.select(F.xxhash64("bucket", "at", "value").alias("bucket"), "node", "n", "root"))
        more, _ = candidates(again.union(crowd.select("bucket", "node", "n", "root")), chained=True)
        more = materialise(more.join(tested, ["a", "b"], "left_anti"))
        new = materialise(verified(more, docs, text, least))
        if not new.isEmpty():
            links = links.union(new)
            roots = materialise(components(links))
            crowd = left_mixed(crowd.select("bucket", "node", "n"), roots)
    if not crowd.isEmpty():
        numbered = nodes.select("node", "sketches", F.posexplode("sketches").alias("at", "value"))
        numbered = numbered.select("node", "sketches", "at", F.xxhash64("at", "value").alias("bucket"))
        new = materialise(exhausted(materialise(crowd.join(numbered, ["bucket", "node"])), docs, text, least))
        if not new.isEmpty():
            roots = materialise(components(links.union(new)))
    known = rows.select("id", "key", F.xxhash64("key").alias("node")).join(roots, "node", "left")
    return known.select("id", "key", F.coalesce(F.col("root").cast("string").cast("binary"), "key").alias("root"))


def class_ids(docs: DataFrame, text: str = "text", identifier: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(identifier, class_id, class_size) of every row."""
    found = materialise(classes(docs, text, identifier, least))
    named = found.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(named, "root").select(F.col("id").alias(identifier), "class_id", "class_size")


def one_per_class(docs: DataFrame, text: str = "text", identifier: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row of each class: that of the least identifier (of equal ones, of the least text key); columns unchanged."""
    found = materialise(classes(docs, text, identifier, least))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.id").alias("_i"), F.col("k.key").alias("_k"))
    times = found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.join(times, F.col("_i").eqNullSafe(F.col("id")) & (F.col("_k") == F.col("key"))).select("_i", "_k", "_times")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[identifier].cast("bigint").alias("_id"), text_key(text).alias("_key"))
    chosen = row.join(kept, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")))
    single = chosen.where("_times = 1").select("_row")
    repeated = chosen.where("_times > 1").groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row")
    return single.union(repeated).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def run(spark, folder: str) -> DataFrame:
    """op10: the near-duplicate class of every document."""
    return class_ids(table(spark, folder, "documents"))
