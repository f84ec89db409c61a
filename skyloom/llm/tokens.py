r"""Token counts by finite-state transducers.

Two machines are compiled from a byte-level BPE vocabulary file:

* ``PieceSplitter`` is a deterministic transducer over character classes that
  writes a mark before each piece (the unit inside which merges happen). Its
  bounded look-ahead is folded into the classes. A text is cut into chunks, the
  map "state before -> state after" of every chunk is found for all states at
  once, the maps are composed by a parallel prefix scan, and a last pass with
  the now known entry states writes the marks.
* ``PieceCounter`` is a deterministic transducer over bytes whose transitions
  carry the change of the number of emitted tokens. It is determinised lazily:
  a transition is worked out when a piece first needs it and kept from then on.
  The token that ends a prefix is the only vocabulary entry that is a suffix of
  the prefix, follows the token before it without a merge across the seam, and
  so gives each transition's count exactly.

Texts of any length are processed whole; null counts as empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "n_bytes long, n_tokens long"

# Character classes. The first four are looked up by code point; the others
# come from the characters after.
LETTER, DIGIT, OTHER, SPACE, SPACE_LAST, WHITE, WHITE_LAST, SHORT2, SHORT3, END = range(10)
# States: what the machine has just read.
S_START, S_LETTER, S_DIGIT, S_OTHER, S_JOIN, S_WHITE, S_EDGE, S_TAIL1, S_TAIL2 = range(9)
N_STATES, N_CLASSES = 9, 10


@lru_cache(1)
def class_table() -> np.ndarray:
    r"""LETTER for \p{L}, DIGIT for \p{N}, SPACE, WHITE for other \s, else OTHER, by code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[32] = SPACE
    return out


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark before this character) by state and class."""
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.ones((N_STATES, N_CLASSES), np.uint8)
    for c, s in ((LETTER, S_LETTER), (DIGIT, S_DIGIT), (OTHER, S_OTHER)):
        step[:, c] = s
        mark[[s, S_JOIN], c] = 0
    # A contraction's letters belong to the piece of its apostrophe.
    step[S_TAIL2, LETTER], mark[S_TAIL2, LETTER] = S_TAIL1, 0
    step[S_TAIL1, LETTER], mark[S_TAIL1, LETTER] = S_EDGE, 0
    for c, s in ((SHORT2, S_TAIL1), (SHORT3, S_TAIL2)):
        step[:, c] = s
        # Behind a blank or other signs the apostrophe continues their run.
        step[[S_OTHER, S_JOIN], c], mark[[S_OTHER, S_JOIN], c] = S_OTHER, 0
    for c in (SPACE, WHITE):
        step[:, c] = S_WHITE
        mark[S_WHITE, c] = 0
    step[:, SPACE_LAST], step[:, WHITE_LAST], step[:, END] = S_JOIN, S_EDGE, S_START
    return step, mark


STEP, MARK = splitter_tables()


def classes_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the characters of several texts; ends: positions of the separators between them."""
    out = class_table()[codes]
    out[ends] = END
    after = np.empty_like(out)
    after[:-1], after[-1] = out[1:], END
    blank = (out == SPACE) | (out == WHITE)
    last = blank & (after != SPACE) & (after != WHITE) & (after != END)
    spot = np.flatnonzero((codes == 39) & (out == OTHER))
    out[last & (out == SPACE)] = SPACE_LAST
    out[last & (out == WHITE)] = WHITE_LAST
    if len(spot):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[spot + 1], padded[spot + 2]
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[spot[two]] = SHORT2
        out[spot[three]] = SHORT3
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of state maps (row i: rows 0 to i applied in turn), in a logarithmic number of steps."""
    out, gap = maps.copy(), 1
    while gap < len(out):
        out[gap:] = np.take_along_axis(out[gap:], out[:-gap], axis=1)
        gap *= 2
    return out


def piece_marks(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Positions before which a piece begins."""
    n = len(classes)
    rows = -(-n // chunk)
    flat = np.full(rows * chunk, END, np.uint8)
    flat[:n] = classes
    grid = np.ascontiguousarray(flat.reshape(rows, chunk).T)
    flat_step, flat_mark = STEP.reshape(-1), MARK.reshape(-1)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for column in grid:
        maps = flat_step.take(maps * np.uint8(N_CLASSES) + column)
    state = np.zeros(rows, np.uint8)
    state[1:] = scan_maps(np.ascontiguousarray(maps.T))[:-1, S_START]
    marks = np.empty((chunk, rows), np.uint8)
    for j, column in enumerate(grid):
        at = state * np.uint8(N_CLASSES) + column
        marks[j] = flat_mark.take(at)
        state = flat_step.take(at)
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class PieceCounter:
    """Counts the tokens of one piece by walking count-annotated transitions.

    max_states bounds the machine, max_pieces the kept sums over whole pieces;
    what reaches its bound starts afresh. Longer prefixes than deep bytes are
    worked out without being kept.
    """

    def __init__(self, ranks: dict[bytes, int], merges: dict[tuple[bytes, bytes], int], max_states: int = 400_000, max_pieces: int = 1_000_000, deep: int = 64):
        self.ranks, self.merges, self.max_states, self.max_pieces, self.deep = ranks, merges, max_states, max_pieces, deep
        # Lengths of the tokens by their last three bytes, longest first: what can end a prefix.
        self.lengths: dict[bytes, list[int]] = {}
        for token in sorted(ranks, key=len, reverse=True):
            known = self.lengths.setdefault(token[-3:], [])
            if len(token) not in known[-1:]:
                known.append(len(token))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.go: dict[int, int] = {}  # state and byte -> state, count change and length of the last token, packed
        self.states = 1

    def bpe(self, data: bytes) -> list[bytes]:
        """The merges applied in order of rank; used for seams, so only on short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a: encoding both together gives just these two."""
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= self.max_states:
                self.fits.clear()
            known = self.fits[key] = self.bpe(a + b) == [a, b] if a else self.bpe(b) == [b]
        return known

    def last_token(self, data: bytes, end: int, lasts: list[int]) -> int:
        """Length of the token that ends data[:end]; lasts has those of the shorter prefixes."""
        for tail in (3, 2, 1):
            for n in self.lengths.get(data[end - tail : end], ()) if tail <= end else ():
                at = end - n
                if at >= 0 and (token := data[at:end]) in self.ranks and self.fit(data[at - lasts[at] : at], token):
                    return n
        raise ValueError("the vocabulary lacks a byte")

    def count(self, piece: str) -> int:
        if (known := self.pieces.get(piece)) is not None:
            return known
        data = piece.encode()
        state, total, lasts, counts = 0, 0, [0], [0]
        for i, byte in enumerate(data, 1):
            move = self.go.get(state << 8 | byte) if state >= 0 else None
            if move is None:
                n = self.last_token(data, i, lasts)
                change = counts[i - n] + 1 - total
                if state >= 0 and i <= self.deep:
                    if self.states >= self.max_states:
                        self.reset()
                        state = -1
                    else:
                        self.go[state << 8 | byte] = self.states << 24 | (change + 2048) << 12 | n
                        state = self.states
                        self.states += 1
                else:
                    state = -1
            else:
                state, change, n = move >> 24, (move >> 12 & 4095) - 2048, move & 4095
            total += change
            lasts.append(n)
            counts.append(total)
        if len(self.pieces) >= self.max_pieces:
            self.pieces.clear()
        if len(data) <= self.deep:
            self.pieces[piece] = total
        return total


class TokenCounter:
    """Counts tokens of whole texts as the library does for a byte-level BPE .json file, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only plain byte-level BPE files can be compiled")
        shown = byte_alphabet()
        raw = lambda s: bytes(shown[c] for c in s)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take blanks along or stand as words alone cannot be compiled")
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.counter = PieceCounter(ranks, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.firsts = sorted({t[0] for t in special if t})  # a text without any of them holds no special string

    def count_batch(self, texts: list[str], most: int = 2_000_000) -> list[int]:
        """Token counts; texts are put together up to about most characters at a time."""
        out = [0] * len(texts)
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if any(c in text for c in self.firsts) and (found := self.special.findall(text)):
                out[i] += len(found)
                parts = self.special.split(text)
            for part in parts:
                if part:
                    held.append(part)
                    owners.append(i)
                    size += len(part)
            if size >= most:
                self._add(held, owners, out)
                held, owners, size = [], [], 0
        if held:
            self._add(held, owners, out)
        return out

    def _add(self, texts: list[str], owners: list[int], out: list[int]) -> None:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        marks = piece_marks(classes_of(codes, ends))
        cuts = np.searchsorted(marks, ends, "right")
        marks = marks.tolist()
        known, count = self.counter.pieces, self.counter.count
        first = 0
        for owner, end in zip(owners, cuts.tolist(), strict=True):
            # marks[first:end] are the starts of this text's pieces, its separator's mark last
            pieces = [joined[a:b] for a, b in zip(marks[first : end - 1], marks[first + 1 : end], strict=True)]
            first = end
            total = 0
            for p in pieces:
                n = known.get(p)
                total += count(p) if n is None else n
            out[owner] += total


def byte_alphabet() -> dict[str, int]:
    """Byte by the printable character that stands for it in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def counter_for(path: str) -> TokenCounter:
    """One compiled machine for each worker process and file."""
    return TokenCounter(path)


def token_counts(text: Column | str, path: str) -> Column:
    """A struct (n_bytes, n_tokens) for each text; path: the vocabulary file, readable on every executor."""

    @F.arrow_udf(SCHEMA)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = counter_for(path)
        for column in batches:
            sizes, counts = [], []
            for at in range(0, len(column), 1000):  # a second copy of a whole batch would be large
                texts = [x or "" for x in column.slice(at, 1000).to_pylist()]
                sizes += [len(t.encode()) for t in texts]
                counts += machine.count_batch(texts)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["n_bytes", "n_tokens"])

    return counted(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than limit tokens); columns of these names are replaced.

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: null
    ids, repeated rows and other columns pass through.
    """
    found = docs.withColumn("__tokens", token_counts(F.col(text), path))
    return found.withColumns({"n_bytes": F.col("__tokens.n_bytes"), "n_tokens": F.col("__tokens.n_tokens"), "over_limit": F.col("__tokens.n_tokens") > limit}).drop("__tokens")
