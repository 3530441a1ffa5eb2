"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WIDTH`` consecutive words of a benchmark item (a shorter item is one
window) and the set of its ``SHINGLE``-word shingles.  A document contains a window
only if it contains all of its shingles, so one of them, the necessary prefix, is
enough to find it: shingles are counted over all documents, and each window keeps its
rarest.  Documents are read twice.  The first pass counts the benchmark's shingles,
added up in each task.  The second passes on the places of prefix shingles with the
words around them, which meet the benchmark's places of the same shingle in a Spark
join.  A meeting is cut off at once by the length bound (the document side and the
item side must have words enough around the shingle), and verified word by word: the
run of equal words to both sides must be as long as a window.  Every window inside
such a run occurs, so the run's document words are hit.

Tasks look shingles up in a bit table of at most ``MOST_BITS`` bits, which is the only
thing that is broadcast by hand; what passes by chance falls out in the joins.  A
window of one frequent passage costs a row a shingle and document, never a pair of
documents; the document side of a join may be split where one shingle is hot.

Defined cases: words are runs of letters, digits and all characters beyond ASCII,
with A-Z lower-cased; null and empty texts have no words, an item without words has
no window; repeated items with one item_id count once, a null item_id is the empty
string; repeated documents repeat their result; a table without rows gives no rows
(documents) or no hits (benchmark); a text of any length is read whole, the bit table
and the hashes only choose what is compared; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.storage import materialise
from pacelens.llm.common import Shared, map_batches, table

WIDTH = 10
SHINGLE = 3
MOST_BITS = 1 << 28
PIECE_BYTES = 1 << 20
GROUP_BYTES = 1 << 22
ROWS_OUT = 4096

#: The class of every byte: 0 between words, else the lower-cased byte.
KIND = np.arange(256, dtype=np.uint8)
KIND[np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = 0
KIND[0x41:0x5B] += 0x20
ROOT = 0x9E3779B97F4A7C15
MIXER = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of an odd root and of its inverse, as far as a piece reaches."""

    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def reach(cls, length: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < length:
            size = max(length, 1 << 16)
            inverse = pow(ROOT, -1, 2**64)
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, r, dtype=np.uint64)]) for r in (ROOT, inverse))
        return cls.up[:length], cls.down[:length]


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in lower-cased bytes with 0 between words."""
    inside = data != 0
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):  # in pieces, so that the sums stay small beside the text
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE_BYTES)))
        first, last = starts[low], ends[high - 1]
        up, down = Powers.reach(int(last - first) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(data[first:last].astype(np.uint64) * up[:-1])]
        hashes[low:high] = (sums[ends[low:high] - first] - sums[starts[low:high] - first]) * down[starts[low:high] - first]
        low = high
    return starts, ends, mixed(hashes + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words, at the first of them."""
    out = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(ROOT) + hashes[k : k + len(out)] + np.uint64(size))
    return out


class Text:
    """Words of one group of texts, back to back."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
        held = values.buffers()[2]
        raw = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
        bounds = offsets - offsets[0]
        # one separator after each text keeps the words of neighbours apart
        data = np.zeros(len(raw) + len(values), dtype=np.uint8)
        for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            data[low + k : high + k] = KIND[raw[low:high]]
        self.data = data
        self.starts, self.ends, self.hashes = word_places(data)
        borders = bounds + np.arange(len(bounds))
        self.first = np.searchsorted(self.starts, borders)  # of each text's words, and behind the last
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(values)), self.counts)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of the shingles that lie in one text."""
        found = shingles(self.hashes, size)
        at = np.flatnonzero(self.owner[: len(found)] == self.owner[size - 1 :])
        return at, found[at]

    def words(self, low: int, high: int) -> list[bytes]:
        return self.data[self.starts[low] : self.ends[high - 1]].tobytes().replace(b"\0", b" ").split() if high > low else []


def groups(values: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about GROUP_BYTES, with the number of their first row; a null is an empty text."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    upto = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(values):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + GROUP_BYTES, side="right")))
        yield low, values.slice(low, high - low)
        low = high


class Bits:
    """A bit table over hashes with two probes; its size follows the number of hashes up to MOST_BITS."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        table_ = np.zeros(bits // 64, dtype=np.uint64)
        table_[words] = values
        self.bits, self.table = bits, table_

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mask, out = np.uint64(self.bits - 1), np.ones(len(hashes), dtype=bool)
        for probe in (hashes & mask, (hashes >> np.uint64(31)) & mask):
            out &= (self.table[probe >> np.uint64(6)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def of(hashes: DataFrame, column: str = "shingle") -> Bits:
        """Built in Spark; at most MOST_BITS / 64 words come to the driver."""
        bits = 1 << 12
        wanted = 16 * hashes.count()
        while bits < min(wanted, MOST_BITS):
            bits *= 2
        probes = F.array(F.col(column).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(column, 31).bitwiseAND(F.lit(bits - 1)))
        set_ = hashes.select(F.explode(probes).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("value"))
        found = set_.toArrow()
        return Bits(bits, found["word"].to_numpy(), found["value"].to_numpy().astype(np.int64).view(np.uint64))


def item_words(items: DataFrame, text: str, identifier: str, width: int, shingle: int) -> DataFrame:
    """(item, at, size, length, shingle, words) of every shingle of every item: ``at`` its word number, ``length`` the item's words, ``words`` from ``width - size`` before it to as many behind."""
    schema = "item string, at int, size int, length int, shingle long, before array<binary>, after array<binary>"

    def run_batches(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, values in groups(batch.column(1)):
                t = Text(values)
                rows = []
                for k in range(len(values)):
                    first, n = int(t.first[k]), int(t.counts[k])
                    size = min(shingle, n)
                    if not n:
                        continue
                    own = t.words(first, first + n)
                    found = shingles(t.hashes[first : first + n], size).view(np.int64).tolist()
                    around = width - size
                    for at, h in enumerate(found):
                        rows.append((names[low + k], at, size, n, h, own[max(0, at - around) : at][::-1], own[at : at + size + around]))
                        if len(rows) == ROWS_OUT:
                            yield as_batch(rows, ITEM)
                            rows = []
                if rows:
                    yield as_batch(rows, ITEM)

    return map_batches(items.select(F.coalesce(F.col(identifier).cast("string"), F.lit("")), F.col(text).cast("string").cast("binary")), run_batches, schema)


ITEM = pa.schema([("item", pa.string()), ("at", pa.int32()), ("size", pa.int32()), ("length", pa.int32()), ("shingle", pa.int64()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))])
FOUND = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("shingle", pa.int64()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def corpus_counts(docs: DataFrame, known: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """(shingle, seen): how often each known shingle stands in all documents."""
    bits = Shared(docs.sparkSession, Bits.of(known))

    def run_batches(batches):
        for batch in batches:
            held: list[np.ndarray] = []
            for _, values in groups(batch.column(0)):
                t, marks = Text(values), bits.ready(lambda b: b)
                for size in sizes:
                    _, found = t.shingles(size)
                    held.append(found[marks.holds(found)])
            unique, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "seen"])

    found = map_batches(docs.select(F.col(text).cast("string").cast("binary")), run_batches, "shingle long, seen long")
    return found.groupBy("shingle").agg(F.sum("seen").alias("seen"))


def prefixes(places: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(shingle, need, left, before, after, items): the benchmark's places of each window's rarest shingle.

    ``need`` is the window's length in words.  Places with the same words around them are one row with all their items."""
    seen = F.coalesce(F.col("seen"), F.lit(0))
    rated = places.join(counts.withColumnRenamed("shingle", "s"), F.col("shingle") == F.col("s"), "left").drop("s")
    need = F.least("length", F.lit(width))
    # the windows of its item that hold a shingle start from low to high
    low, high = F.greatest(F.col("at") + F.col("size") - need, F.lit(0)), F.least("at", F.col("length") - need)
    inside = rated.select("*", need.alias("need"), F.explode(F.sequence(low, high)).alias("start"))
    content = F.struct("need", F.slice(F.concat(F.reverse("before"), "after"), F.size("before") + 1 - (F.col("at") - F.col("start")), F.col("need")).alias("w"))
    place = F.struct("size", (F.col("at") - F.col("start")).alias("offset"), "before", "after")
    windows = inside.groupBy("item", "start", "need", F.md5(F.to_json(content)).alias("window")).agg(F.min_by(F.struct("shingle", *[place[c].alias(c) for c in ("size", "before", "after")]), F.struct(seen, "shingle", "at")).alias("p"))
    return windows.groupBy("p", "need").agg(F.collect_set("item").alias("items")).select("p.*", "need", "items")


def marked(docs: DataFrame, wanted: DataFrame, text: str, sizes: list[int], width: int) -> DataFrame:
    """Documents with a stored row number, and a further row for each place of a wanted shingle.

    Rows of documents have ``n_words`` and all their columns but the text; rows of places have the shingle, its
    word number and the words around it."""
    bits = Shared(docs.sparkSession, Bits.of(wanted))
    kept = [c for c in docs.columns if c != text]
    spans = [T.StructField(f.name, T.LongType() if f.type == pa.int64() else T.ArrayType(T.BinaryType())) for f in FOUND]
    schema = T.StructType([T.StructField("doc", T.StructType([docs.schema[c] for c in kept])), *spans])

    def run_batches(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            doc, marks = batch.column(0), bits.ready(lambda b: b)
            for low, values in groups(batch.column(1)):
                t, n = Text(values), len(values)
                rows = pa.array(np.arange(number, number + n))
                lists = pa.nulls(n, pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([doc.slice(low, n), rows, pa.array(t.counts.astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), lists, lists], names=["doc", *FOUND.names])
                for size in sizes:
                    at, found = t.shingles(size)
                    pick = marks.holds(found)
                    at, found, around = at[pick], found[pick], width - size
                    for part in range(0, len(at), ROWS_OUT):
                        out = []
                        for w, h in zip(at[part : part + ROWS_OUT].tolist(), found[part : part + ROWS_OUT].view(np.int64).tolist()):
                            k = int(t.owner[w])
                            first, last = int(t.first[k]), int(t.first[k + 1])
                            before, after = t.words(max(first, w - around), w)[::-1], t.words(w, min(last, w + size + around))
                            out.append((number + k, None, w - first, h, before, after))
                        found_rows = as_batch(out, FOUND)
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(out), doc.type), *found_rows.columns], names=["doc", *FOUND.names])
                number += n

    return map_batches(docs.select(F.struct(*kept).alias("doc"), F.col(text).cast("string").cast("binary").alias("text")), run_batches, schema)


def equal_run(a: str, b: str) -> Column:
    """How many of the first words of two lists are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def spans(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, start, stop, items): verified runs of document words that hold an item's window."""
    left = found.where("shingle IS NOT NULL").select("row", "at", "shingle", "before", "after")
    right = wanted.select(F.col("shingle").alias("s"), "size", "need", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "items")
    enough = (F.col("shingle") == F.col("s")) & (F.size("before") + F.size("after") >= F.col("need"))
    met = left.join(right, enough).select("*", equal_run("before", "item_before").alias("l"), equal_run("after", "item_after").alias("r"))
    held = met.where((F.col("r") >= F.col("size")) & (F.col("l") + F.col("r") >= F.col("need")))
    return held.select("row", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("stop"), "items")


def covered(spans_: Column) -> Column:
    """Words under sorted spans, each once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(state, span):
        fresh = F.greatest(span["stop"] - F.greatest(span["start"], state["upto"]), F.lit(0).cast("long"))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["upto"], span["stop"]).alias("upto"))

    return F.aggregate(spans_, zero, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """Each document's columns but its text as ``doc``, with n_words, spans (array of start, stop) and items (sorted ids)."""
    places = materialise(item_words(items, item_text, item_id, width, shingle))
    sizes = sorted(r["size"] for r in places.select("size").distinct().collect())
    counts = corpus_counts(docs, places.select("shingle").distinct(), text, sizes)
    wanted = materialise(prefixes(places, counts, width))
    found = materialise(marked(docs, wanted.select("shingle").distinct(), text, sizes, width))
    hits = spans(found, wanted).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    base = found.where("n_words IS NOT NULL").select("row", "doc", "n_words")
    joined = base.join(hits.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return joined.select("doc", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate(docs, items).select(F.col("doc.doc_id").alias("doc_id"), "n_words", covered(F.col("spans")).alias("n_hit"), "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: A plain nested search over the same words, for the comparison in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS need, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT need FROM windows),
places AS (
  SELECT row, need, s, array_to_string(w[s : s + need - 1], ' ') AS win
  FROM (SELECT row, w, need, unnest(range(1, len(w) - need + 2)) AS s FROM d, lengths WHERE len(w) >= need)),
hits AS (SELECT row, s, p.need, item FROM places AS p JOIN windows AS q ON p.need = q.need AND p.win = q.win),
words AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest(range(s, s + need)) AS k FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
