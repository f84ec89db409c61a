"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII characters. A fixed mask picks some positions of a window of words and
ignores the others; the picked words are hashed, and document hashes are joined
with the hashes of the benchmark. Around every hit the two word sequences are
laid side by side and the overlap is verified: the longest stretch that begins
and ends with equal words and whose share of equal words is at least
``similarity``. It counts if it is at least ``shortest`` words long, or covers a
shorter item whole. Words may be substituted, and an inserted or lost word only
cuts an overlap in two.

No overlap is lost at a similarity of 0.8: every stretch of 12 words or more that
reaches it holds one of the masks whole (a test shows it for every length), and
an item shorter than that is cut into one part more than it may have changed
words, of which one stands unchanged in every copy. Other values can lose some.

The benchmark is the broadcast side. Its words are counted first, and a large
one is taken in blocks of at most ``block_words`` (beyond that only by a single
item). Each block is joined with all documents in a pass of its own, whose result
is written before the next block is read, so driver and workers hold one block.

Defined results: null or empty texts and items overlap with nothing; null item
ids are left out; rows with equal ids are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.licenses import FOLD
from skyloom.llm.runtime import cut, offsets_of, texts_in

#: Five picked words each. A test shows that every stretch of 12 words or more, four fifths of them equal, keeps one of these whole.
MASKS = ("11111", "110111", "111011")
#: Seed hits that are spread out to diagonals at a time.
SPREAD = 1 << 20
SIMILARITY, SHORTEST, BLOCK_WORDS = 0.8, 12, 1_000_000
HIT = "struct<item_id:bigint,words:bigint,equal:bigint,doc_start:bigint,item_start:bigint>"
ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "words", "equal", "doc_start", "item_start")]))
MIX = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows whose picked words all have an id over 0."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = ids[picked[0] : picked[0] + n] > 0
    for p in picked[1:]:
        whole &= ids[p : p + n] > 0
    at = np.flatnonzero(whole)
    out = np.full(len(at), len(mask) + int(mask, 2), np.uint64)
    for p in picked:
        out = (out ^ ids[at + p].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return at, out


def longest_overlap(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """(start, length, equal words) of the longest stretch with at least that share of equal words, equal at both ends."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    rank = np.arange(len(at))
    low = rank - similarity * at  # value before the word
    high = rank + 1 - similarity * (at + 1)  # value after it
    # The last end whose value is not below that before a start: behind it all values are.
    after = np.maximum.accumulate(high[::-1])[::-1]
    end = np.searchsorted(-after, -(low - 1e-9), "right") - 1
    best = int((at[end] - at).argmax())
    return int(at[best]), int(at[end[best]] - at[best]) + 1, int(end[best]) - best + 1


def part_borders(n: int, similarity: float) -> list[tuple[int, int]]:
    """An item of n words in one part more than it may have changed words."""
    parts = int((1 - similarity) * n + 1e-9) + 1
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


class Benchmark:
    """Word ids, items and seed tables of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, shortest: int = SHORTEST):
        self.ids, self.names, words, starts = {}, [], [], []
        for name, data in items:
            found = data.translate(FOLD).split()
            starts.append(len(words))
            words += [self.ids.setdefault(w, len(self.ids) + 1) for w in found] + [0]
            self.names.append(name)
        self.words = np.array(words, np.int32)
        self.starts = np.array([*starts, len(words)], np.int64)
        seeds: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {mask: [seed_hashes(self.words, mask)] for mask in masks}
        for start, n in zip(self.starts, np.diff(self.starts) - 1, strict=False):
            for a, b in part_borders(int(n), similarity) if 0 < n < shortest else ():
                at, h = seed_hashes(self.words[start + a : start + b], "1" * (b - a))
                seeds.setdefault("1" * (b - a), []).append((at + start + a, h))
        self.seeds = {}
        for mask, found in seeds.items():
            at, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, h))
            new = np.ones(len(at), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])
            self.seeds[mask] = h[order][new], at[order][new]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (diagonal, item) rows of the seed join.

        Of a repetitive text and item all pairs of places meet, but no more than a
        bounded number at a time, and they leave at most as many rows as there are
        diagonals.
        """
        found = np.zeros((0, 2), np.int64)
        for mask, (h, at) in self.seeds.items():
            pos, mine = seed_hashes(ids, mask)
            a, b = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            hit = np.flatnonzero(b > a)
            rows = np.cumsum(b[hit] - a[hit]) // SPREAD
            for part in np.split(hit, np.flatnonzero(np.diff(rows)) + 1) if len(hit) else ():
                n = (b - a)[part]
                own = np.repeat(pos[part], n)
                other = at[np.repeat(a[part], n) + np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)]
                found = np.unique(np.concatenate([found, np.stack([own - other, np.searchsorted(self.starts, other, "right") - 1], 1)]), axis=0)
        return found


def overlaps_of(texts: list[bytes], bench: Benchmark, similarity: float, shortest: int) -> list[list[dict]]:
    """Verified overlaps of each text, the longest one for each item."""
    get = bench.ids.get
    rows = [[get(w, 0) for w in t.translate(FOLD).split()] + [0] for t in texts]
    starts = offsets_of(np.array([len(r) for r in rows], np.int64))
    ids = np.fromiter((x for r in rows for x in r), np.int32, int(starts[-1]))
    out: list[dict[int, dict]] = [{} for _ in texts]
    seen = set()
    for diagonal, item in bench.hits(ids).tolist():
        a, b = int(bench.starts[item]), int(bench.starts[item + 1]) - 1
        # A diagonal can only cross few documents: the item's length limits its reach.
        first, last = np.searchsorted(starts, [max(0, a + diagonal), b - 1 + diagonal], "right") - 1
        for doc in range(int(first), min(int(last), len(texts) - 1) + 1):
            if (diagonal, item, doc) in seen:
                continue
            seen.add((diagonal, item, doc))
            low, high = max(a, int(starts[doc]) - diagonal), min(b, int(starts[doc + 1]) - 1 - diagonal)
            if high <= low:
                continue
            mine, theirs = ids[low + diagonal : high + diagonal], bench.words[low:high]
            start, size, equal = longest_overlap(mine == theirs, similarity)
            if size >= min(shortest, b - a) and size > out[doc].get(item, {"words": 0})["words"]:
                out[doc][item] = {"item_id": bench.names[item], "words": size, "equal": equal, "doc_start": low + start + diagonal - int(starts[doc]), "item_start": low + start - a}
    return [sorted(x.values(), key=lambda h: (h["item_id"], h["doc_start"])) for x in out]


def block_items(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items of each block in order, block by block."""
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (block_words * 3)))  # a word and its blank are mostly over three characters
    for i in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i)
        rows = sorted((r["item"], r["text"].encode()) for r in part.collect())
        if rows:
            yield rows


def finder(bench, similarity: float, shortest: int):
    """The column function that finds one broadcast block's items."""

    @F.arrow_udf(f"array<{HIT}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([h for texts in texts_in(column) for h in overlaps_of(texts, bench.value, similarity, shortest)], ARROW)

    return found


def add_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shortest: int = SHORTEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with an array ``overlaps`` (a column of this name is replaced): item_id, words, equal, doc_start, item_start of each benchmark item found."""
    out, sent = docs.withColumn("overlaps", F.array().cast(f"array<{HIT}>")), None
    for items in block_items(benchmark, item, item_text, block_words):
        if sent is not None:
            out = cut(out)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items, similarity=similarity, shortest=shortest))
        out = out.withColumn("overlaps", F.concat("overlaps", finder(sent, similarity, shortest)(F.col(text))))
    return out
