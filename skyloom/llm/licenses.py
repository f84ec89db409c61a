r"""Fuzzy search for short licence notices.

A text is lower-cased (A-Z), cut into words and the words are joined by single
blanks. A notice that may have k character edits is split into k + 1 parts; by
the pigeonhole principle every occurrence holds one of them unchanged. Exact
search for these seeds gives candidate places, and the regex library's
bounded-error matching in a window around each verifies the edits and gives the
span. The exact phrases are notices with k = 0: their only seed is the phrase.

Null text counts as empty: no words, no labels, score 0.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.runtime import texts_in

#: Lower-cases A-Z and turns every ASCII character but letters and digits to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int = 0


BASE = (Notice("mit", "mit license"), Notice("apache", "apache license"), Notice("gpl", "general public license"))

#: Short public notices; the labels ending in -notice come from the fuzzy search alone.
FUZZY = (
    Notice("mit-notice", "released under the mit license", 3),
    Notice("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", 5),
    Notice("apache-notice", "licensed under the apache license version 2 0", 4),
    Notice("gpl-notice", "licensed under the gnu general public license version", 4),
    Notice("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms", 5),
    Notice("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted", 5),
    Notice("cc-notice", "licensed under cc by nc 4 0", 2),
    Notice("cc-notice", "licensed under a creative commons attribution", 3),
)

SPAN = "struct<label:string,first_word:bigint,last_word:bigint,errors:bigint>"
SCHEMA = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<{SPAN}>"


def seeds(notice: Notice) -> list[tuple[bytes, int]]:
    """errors + 1 parts of nearly equal length, with their offsets."""
    data, parts = notice.words.encode(), notice.errors + 1
    cuts = [len(data) * i // parts for i in range(parts + 1)]
    return [(data[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeFinder:
    """Finds all notices in one normalised text."""

    def __init__(self, base: Sequence[Notice], fuzzy: Sequence[Notice]):
        self.base = [(n, b" " + n.words.encode() + b" ") for n in base]
        self.fuzzy = [(n, seeds(n), regex.compile(rb"(?b)(?<= )(?:" + regex.escape(n.words.encode()) + rb"){e<=%d}(?= )" % n.errors)) for n in fuzzy]

    def exact(self, text: bytes) -> list[tuple[Notice, int, int]]:
        """(notice, first byte, end) of every place of a base phrase."""
        found = []
        for notice, needle in self.base:
            at = text.find(needle)
            while at >= 0:
                found.append((notice, at + 1, at + len(needle) - 1))
                at = text.find(needle, at + 1)
        return found

    def near(self, text: bytes) -> list[tuple[Notice, int, int, int]]:
        """(notice, first byte, end, errors) of the verified places, none twice; of places that overlap the one with fewest errors.

        Each candidate window is searched by itself and is about as long as its
        notice, so the work grows with the number of seeds found.
        """
        found = []
        for notice, parts, pattern in self.fuzzy:
            size, slack, windows = len(notice.words), notice.errors + 1, set()
            for part, offset in parts:
                at = text.find(part)
                while at >= 0:
                    windows.add(at - offset)
                    at = text.find(part, at + 1)
            places = set()
            for at in windows:
                m = pattern.search(text, max(0, at - slack), at + size + slack + 1)
                if m:
                    places.add((sum(m.fuzzy_counts), m.start(), m.end()))
            taken: list[tuple[int, int]] = []  # apart from each other, in order
            for errors, a, b in sorted(places):
                i = bisect(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.append((notice, a, b, errors))
        return found

    def scan(self, data: bytes) -> dict:
        words = data.translate(FOLD).split()
        text = b" " + b" ".join(words) + b" "
        exact, near = self.exact(text), self.near(text)
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) if exact or near else np.zeros(0, np.int64)
        word_at = lambda byte: int(np.searchsorted(blanks, byte)) - 1
        starts = [word_at(a) for _, a, _ in exact]
        base = {n.label for n, _, _ in exact}
        spans = [(n.label, w, word_at(e - 1), 0) for (n, _, e), w in zip(exact, starts, strict=True)]
        spans += [(n.label, word_at(a), word_at(e - 1), k) for n, a, e, k in near]
        spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[3]))
        most = {n.label: max(x.errors for x in [*(y for y, _, _ in self.fuzzy), n] if x.label == n.label) for n, *_ in near}
        score = 1.0 if exact else max((1 - k / (most[n.label] + 2) for n, _, _, k in near), default=0.0)
        return {
            "n_words": len(words), "n_base": len(exact), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {n.label for n, *_ in near})), "score": score,
            "spans": [dict(zip(("label", "first_word", "last_word", "errors"), s, strict=True)) for s in spans],
        }


ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())])))])


def license_scan(text: Column | str, base: Sequence[Notice] = BASE, fuzzy: Sequence[Notice] = FUZZY) -> Column:
    """A struct of counts, labels, score and spans (words from 0) for each text."""

    @F.arrow_udf(SCHEMA)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = NoticeFinder(base, fuzzy)
        for column in batches:
            yield pa.array([finder.scan(x) for part in texts_in(column) for x in part], ARROW)

    return scanned(text)


def scan_licenses(docs: DataFrame, text: str = "text", base: Sequence[Notice] = BASE, fuzzy: Sequence[Notice] = FUZZY) -> DataFrame:
    """docs with the columns of license_scan; columns of these names are replaced.

    Rows are independent: null ids, repeated rows and other columns pass through.
    """
    found = docs.withColumn("__license", license_scan(F.col(text), base, fuzzy))
    return found.withColumns({c.split()[0]: F.col(f"__license.{c.split()[0]}") for c in SCHEMA.split(", ")}).drop("__license")
