"""What counts as a letter."""

from __future__ import annotations

import regex

from pacelens.llm import langid


def test_numbers_that_are_no_digits_are_no_letters():
    assert langid.letter_runs("\u00b2 \u00bd \u2167 12 _ \u2460") == []
    assert langid.letter_runs("Ab\u00b2c\u2167 d1e") == ["ab", "c", "d", "e"]
    assert langid.letter_runs(None) == []


def test_every_letter_is_one():
    known = regex.compile(r"\p{Assigned}")
    for c in map(chr, range(0xD800)):
        if known.match(c) and c.isprintable() and len(c.lower()) == 1:
            assert bool(langid.letter_runs(c)) == c.lower().isalpha(), hex(ord(c))
