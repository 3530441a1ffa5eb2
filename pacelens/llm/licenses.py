"""License scans: MinHash bands over overlapping windows, verified by shingle containment.

Templates are grouped by their number of word shingles: a class with stride s holds
templates of s/2 < n <= s shingles (s a power of two) and looks at a text through
windows of 2s shingles that start every s shingles, so any stretch of n <= s shingles
lies whole in one window.  A window and a template are compared by one-value MinHash
bands; a class has as many bands as bring the chance of missing a window that
contains the least share of its shortest template below ``MISS``.  Retrieved pairs
are verified exactly: the share of the template's distinct shingles found in the
window must reach ``LEAST``.

Windows are counted from the beginning of each text, so a result does not depend on
how rows are batched; templates are a fixed parameter and go with the code.

Defined cases: words are runs of letters and digits, lower-cased; null and empty
texts match nothing; a template of fewer than five words is one shingle of its own
length; repeated rows repeat their matches; ties between windows go to the first;
further columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.llm.common import map_batches, table
from pacelens.llm.wordcost import groups

SHINGLE = 5
LEAST = 0.8
MISS = 1e-4
WORDS = re.compile(r"[^\W_]+")
NONE = np.uint64(2**64 - 1)

#: Notices looked for by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Shingle hashes of ``width`` consecutive word hashes."""
    out = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        out += h[k : k + len(out)] * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64))
    out ^= out >> np.uint64(29)
    return np.where(out == NONE, np.uint64(0), out)


def bands_for(shortest: int, stride: int, miss: float = MISS, least: float = LEAST) -> int:
    """Bands that find a window holding ``least`` of a template of ``shortest`` shingles with probability 1 - miss."""
    held = max(1, math.ceil(least * shortest - 1e-9))
    jaccard = held / (2 * stride + shortest - held)
    return max(1, math.ceil(math.log(miss) / math.log(1 - jaccard)))


class Scanner:
    """Template classes with their band values, ready for texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        self.least, self.hashes = least, WordHashes()
        self.classes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in templates.items():
            h = self.words(text)
            if not len(h):
                continue
            width = min(SHINGLE, len(h))
            shingles = np.unique(rolled(h, width))
            stride = 1 << (len(shingles) - 1).bit_length()
            self.classes.setdefault((width, stride), []).append((name, shingles))
        most = max((bands_for(min(len(s) for _, s in c), stride) for (_, stride), c in self.classes.items()), default=0)
        draw = np.random.Generator(np.random.PCG64(77))
        self.factors = draw.integers(1, 2**63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 2**63, most, dtype=np.uint64)

    def words(self, text: str) -> np.ndarray:
        found = WORDS.findall(text.lower())
        return np.fromiter(map(self.hashes.__getitem__, found), dtype=np.uint64, count=len(found))

    def band(self, j: int, x: np.ndarray) -> np.ndarray:
        h = x * self.factors[j] + self.shifts[j]
        h ^= h >> np.uint64(32)
        return np.where(x == NONE, NONE, h)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, float, int, int]]:
        """(text number, template, containment, first word, matching windows) of each text and template found."""
        parts = [self.words(t) if t else np.zeros(0, dtype=np.uint64) for t in texts]
        h, lengths = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]), np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        by_width: dict[int, np.ndarray] = {}
        for (width, stride), templates in self.classes.items():
            if width not in by_width:
                by_width[width] = rolled(h, width)
            n = np.maximum(lengths - width + 1, 0)
            blocks = np.where(n > 0, -(-n // stride) + 1, 0)  # one empty block keeps texts apart
            first = np.cumsum(blocks) - blocks
            owner = np.repeat(np.arange(len(n)), n)
            if not len(owner):
                continue
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            laid = np.full(int(blocks.sum()) * stride, NONE)
            laid[first[owner] * stride + inside] = by_width[width][starts[owner] + inside]
            yield from self._class(laid, stride, templates, np.repeat(np.arange(len(n)), blocks), first)

    def _class(self, laid, stride, templates, block_owner, first):
        bands = bands_for(min(len(s) for _, s in templates), stride)
        near = [np.zeros(len(block_owner), dtype=bool) for _ in templates]
        for j in range(bands):
            least = self.band(j, laid).reshape(-1, stride).min(axis=1)
            window = np.minimum(least, np.append(least[1:], NONE))  # blocks b and b + 1
            for hit, (_, shingles) in zip(near, templates):
                hit |= window == self.band(j, shingles).min()
        for hit, (name, shingles) in zip(near, templates):
            best: dict[int, list] = {}
            for b in np.flatnonzero(hit).tolist():
                window = laid[b * stride : (b + 2) * stride]
                at = np.flatnonzero(np.isin(window, shingles))
                share = len(np.unique(window[at])) / len(shingles)
                if share < self.least:
                    continue
                text = int(block_owner[b])
                entry = best.setdefault(text, [0.0, 0, 0])
                entry[2] += 1
                if share > entry[0]:
                    entry[:2] = share, int((b - first[text]) * stride + at[0])
            for text, (share, word, windows) in best.items():
                yield text, name, share, word, windows


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """(identifier, license, containment, first_word, n_windows): a row for each text and template found in it."""

    def run_batches(batches):
        scanner = Scanner(templates)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in groups(texts):
                found = sorted(scanner.scan(texts[start:end]))
                rows = batch.column(0).take(pa.array([start + f[0] for f in found], pa.int64()))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([rows, *[pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds)]], names=["id", "license", "containment", "first_word", "n_windows"])

    rows = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run_batches, "id long, license string, containment double, first_word long, n_windows long").withColumnRenamed("id", identifier)


def run(spark, folder: str) -> DataFrame:
    """op4: the license notices of every document."""
    return scan(table(spark, folder, "documents"))
