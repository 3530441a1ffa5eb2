"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

``Automaton`` compiles a merge list by successive merge gadgets.  Start from one
state that every base symbol leaves and re-enters.  The merge (a, b) -> c at rank k
adds, beside every path ``-a-> p -b-> r``, the arc ``-c-> r``, and moves the end of
all a-arcs to a copy of p without its b-arc.  All arcs of one label always end in
one state, so a state is named by the label that leads to it, and the gadget needs
two table entries: the new arc ends where b's ended (``right`` with its birth rank:
the copy is shared until it changes) and the state of a has lost b since k
(``lost``).  An arc c leaves a state iff neither c nor a leading part of c, for as
long as that part was a separate arc, was lost by the state or by a state it was
copied from.  The automaton accepts exactly the token sequences that the merges
produce, one for each string.

The tables are then compiled for walking: for every state the refused arcs of the
copies it stems from, for every arc its leading parts, and for every state and symbol
of the tree of labels the next state.  Encoding walks a pre-split word from left to
right through them, longer arcs first, and steps back from positions that no arc
continues.  Decoding emits arc labels.

Defined cases: null text is the empty text with no tokens; special tokens found in
a text become their own ids; repeated rows repeat their result; further columns are
left alone.  Texts of any length are encoded whole, in memory linear in their length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.llm.common import Shared, map_batches, table

NEVER = 1 << 60
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split for lower-cased texts below U+0180, several times faster: its letters, digits and white space spelt out.
LATIN_SPLIT = re.compile(
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d"
    r"|[^ \t-\r\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
BEYOND_LATIN = re.compile(r"[^\x00-\u017f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Automaton:
    """Transition tables compiled from a vocabulary and its merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.arc, self.end = vocabulary, end
        self.label = {i: t for t, i in vocabulary.items()}
        size = max(self.label, default=-1) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.live = [True] * size
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._compile()

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        path = self.live[a] and self.live[b] and self.leaves(a, b, rank)
        if self.born[c] < 0:
            self.left[c], self.right[c], self.born[c], self.live[c] = a, b, rank, path
        self.lost.setdefault((a, b), rank)

    def _compile(self) -> None:
        """Tables for walking: a state's refused arcs by the copies it stems from, an arc's leading parts, the tree of labels."""
        refused: dict[int, dict[int, int]] = {}
        for (state, part), rank in self.lost.items():
            refused.setdefault(state, {})[part] = rank
        self.refusals, self.parts = [], []
        for label in range(len(self.born)):
            state, until, found = label, NEVER, []
            while state >= 0:
                if state in refused:
                    found.append((refused[state], until))
                until, state = self.born[state], self.right[state]
            self.refusals.append(found)
            part, apart, spine = label, NEVER, []
            while part >= 0:
                spine.append((part, apart))
                apart, part = self.born[part], self.left[part]
            self.parts.append(spine)
        self.root: dict = {}
        for label, i in self.arc.items():
            if self.live[i]:
                node = self.root
                for symbol in self.symbols_of(label):
                    node = node.setdefault(symbol, {})
                node[""] = i

    def symbols_of(self, label: str) -> list[str]:
        """The symbols of a label; the end mark belongs to the last."""
        if self.end and label.endswith(self.end) and len(label) > len(self.end):
            body = label[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(label)

    def leaves(self, state: int, arc: int, before: int = NEVER) -> bool:
        """Whether ``arc`` leaves the state that label ``state`` leads to, after the merges of ranks below ``before``."""
        lost, left, right, born = self.lost, self.left, self.right, self.born
        until = before
        while state >= 0:
            part, apart = arc, before
            while part >= 0:
                rank = lost.get((state, part))
                if rank is not None and rank < until and rank <= apart and rank < before:
                    return False
                apart, part = born[part], left[part]
            until, state = born[state], right[state]
        return True

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one pre-split word given as symbols; the last symbol also carries the end mark.

        One path spells the word, and one path spells each of its prefixes.  A walk
        through the label tree finds the arcs at a position, the longest is tried
        first, and a position that could not be continued is never entered again, so
        the work is linear in the length."""
        spelt = [*symbols[:-1], symbols[-1:] + self.end]
        n, root, refusals, parts_of = len(spelt), self.root, self.refusals, self.parts
        path: list[int] = []
        left: list[list[tuple[int, int]]] = []  # the arcs not yet tried at each position of the path
        starts: list[int] = []
        dead = set()
        at, refused_by = 0, ()
        arcs, node = [], root
        for to, symbol in enumerate(spelt, 1):
            node = node.get(symbol)
            if node is None:
                break
            if "" in node:
                arcs.append((to, node[""]))
        while True:
            while arcs:
                to, t = arcs.pop()
                if to in dead:
                    continue
                for refused, until in refused_by:
                    for part, apart in parts_of[t]:
                        rank = refused.get(part)
                        if rank is not None and rank < until and rank <= apart:
                            break
                    else:
                        continue
                    break
                else:
                    break
            else:
                if not path:
                    raise ValueError(f"the vocabulary cannot spell {symbols!r}")
                dead.add(at)
                path.pop()
                arcs, at = left.pop(), starts.pop()
                refused_by = refusals[path[-1]] if path else ()
                continue
            path.append(t)
            if to == n:
                return path
            left.append(arcs)
            starts.append(at)
            at, refused_by = to, refusals[t]
            arcs, node = [], root
            for far in range(at, n):
                node = node.get(spelt[far])
                if node is None:
                    break
                if "" in node:
                    arcs.append((far + 1, node[""]))


class Words(dict):
    """Encoded pre-split words, made when first asked for; those of the ``older`` generation are carried over when used."""

    def __init__(self, make, older: dict | None = None):
        self.make, self.older = make, dict(older or {})

    def __missing__(self, word: str):
        entry = self[word] = self.older.get(word) or self.make(word)
        return entry


class Tokenizer:
    """Normalising, pre-splitting and encoding texts as one vocabulary file says; words are cached up to a bound, in two generations.

    Characters assigned after Python's Unicode version are classified by the
    tokenizers library's own normaliser and splitter."""

    def __init__(self, spec: dict, most_words: int = 60_000):
        model, self.spec = spec["model"], spec
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_label = {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if [s["type"] for s in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PRE_SPLIT:
            raise ValueError("a vocabulary with another normaliser or splitter")
        self.split = regex.compile(PRE_SPLIT)
        self.symbols = dict(enumerate(byte_symbols()))
        labels = [self.automaton.label.get(i, "") for i in range(len(self.automaton.born))]
        self.id_bytes, self.label_bytes = [i.to_bytes(4, "little") for i in range(len(labels))], [t.encode("utf-8") for t in labels]
        self.most, self.words, self.library = most_words, Words(self.word), None

    def word(self, piece: str) -> tuple[bytes, bytes]:
        if piece.isascii() and piece.isprintable():  # these bytes are their own symbols
            return self.spelt(piece)
        return self.spelt("".join(map(self.symbols.__getitem__, piece.encode("utf-8"))))

    def spelt(self, symbols: str) -> tuple[bytes, bytes]:
        ids = self.automaton.encode(symbols)
        return b"".join([self.id_bytes[i] for i in ids]), b" ".join([self.label_bytes[i] for i in ids])

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        """The encoded words of a text without special tokens."""
        if text.isascii() or not BEYOND_LATIN.search(text := unicodedata.normalize("NFC", text)):
            lower = text.lower()
            if lower.isascii() or not BEYOND_LATIN.search(lower):
                return list(map(self.words.__getitem__, LATIN_SPLIT.findall(lower)))
        elif any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [self.spelt(w) for w in self.library_split(text)]
        # one character at a time where that matters: no final sigma
        lower = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return list(map(self.words.__getitem__, self.split.findall(lower)))

    def library_split(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(json.dumps(self.spec))
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, UTF-8 of the decoded text)."""
        if len(self.words) > self.most:
            self.words = Words(self.words.make, self.words)
        if not text:
            return b"", b""
        found = []
        for part in self.at_special.split(text) if self.at_special and "<|" in text else [text]:
            if part in self.special:
                found.append((np.array([self.special[part]], dtype="<u4").tobytes(), part.encode()))
            else:
                found += self.pieces(part)
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, separated as a vocabulary without a decoder has them: by spaces."""
        labels = self.automaton.label
        return " ".join(self.special_label.get(i) or labels[i] for i in ids)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", identifier: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(identifier, n_tokens, ids_sha256, decoded_sha256[, ids]) of every document.

    ``vocabulary`` is the file's path on the driver; its size is fixed, and it is broadcast."""
    shared = Shared(docs.sparkSession, load(vocabulary))

    def run_batches(batches):
        tokenizer = shared.ready(Tokenizer)
        for whole in batches:
            for at in range(0, len(whole), 500):  # ids of a long batch stay small
                batch = whole.slice(at, 500)
                found = [tokenizer.encode(t) for t in batch.column(1).to_pylist()]
                columns = [
                    batch.column(0),
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in found], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in found]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids for ids, _ in found), dtype="<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(rows, run_batches, schema).withColumnRenamed("id", identifier)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", identifier: str = "doc_id") -> DataFrame:
    """(identifier, text) for rows of token ids; null ids give the empty text."""
    shared = Shared(encoded.sparkSession, load(vocabulary))

    def run_batches(batches):
        tokenizer = shared.ready(Tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(identifier).cast("bigint").alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_batches(rows, run_batches, "id long, text string").withColumnRenamed("id", identifier)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def run(spark, folder: str) -> DataFrame:
    """op2: digests of the token ids and of the decoded text of every document."""
    return encode(table(spark, folder, "documents"), vocabulary_path(), with_ids=False)
