"""Toxicity by gradient-boosted trees over dense text features.

Features: densities of a lexicon (words and word beginnings that the labelled
sample ties to toxic texts, with their log odds), how near its hits stand to
second-person words, capitals, punctuation, and signs of obfuscation. A
histogram GBT with logistic loss is trained on the driver, on the features of a
bounded sample of labelled rows, and its raw scores are calibrated by isotonic
regression on rows that neither lexicon nor trees have seen.

Every text is scored whole and by itself; null counts as empty. Without both
labels in the sample every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.licenses import FOLD
from skyloom.llm.runtime import crc_bucket, cut, map_batches, texts_in

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Entries of the lexicon, at most.
LEXICON = 4_000
#: Folds of the sample that lexicon and trees learn from; the other one calibrates.
TAUGHT = (1, 2, 3)

#: Second-person words of the four languages.
SECOND_PERSON = frozenset(x.encode() for x in "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros os tus".split())
#: Digits and signs that stand for letters.
LOOKALIKE = bytes.maketrans(b"013457@$", b"oieastas")

CAPITALS = re.compile(rb"[A-Z]")
SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
REPEATED = re.compile(rb"([A-Za-z!?])\1\1")
MIXED = re.compile(rb"[A-Za-z][0-9@$*#]+[A-Za-z]")
SPACED = re.compile(rb"(?:\b[A-Za-z][ .-]){3,}")
NAMES = ("words", "lexicon_share", "lexicon_hits", "lexicon_kinds", "odds_share", "odds_top", "near_second", "second_share", "capitals", "shouted", "exclaims", "questions", "commas", "repeated", "mixed", "spaced", "folded_hits")


def entries(word: bytes) -> tuple[bytes, ...]:
    """What the lexicon can hold of a word: itself, and its first 4 and 5 bytes, marked."""
    return (word, word[:4] + b"*", word[:5] + b"*") if len(word) > 5 else (word,)


def features(data: bytes, lexicon: dict[bytes, float]) -> list[float]:
    words = data.translate(FOLD).split()
    n, size = len(words) or 1, len(data) or 1
    get, hits, odds, kinds = lexicon.get, [], [], set()
    for i, w in enumerate(words):
        s = get(w)
        if s is None and len(w) > 5:
            s = get(w[:5] + b"*")
            if s is None:
                s = get(w[:4] + b"*")
        if s is not None:
            hits.append(i)
            odds.append(s)
            kinds.add(w)
    near = sum(any(x in SECOND_PERSON for x in words[max(0, i - 3) : i + 4]) for i in hits)
    mixed = MIXED.findall(data)
    folded = sum(w in lexicon for w in data.translate(LOOKALIKE).translate(FOLD).split()) - sum(w in lexicon for w in words) if mixed else 0
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), math.log1p(len(kinds)), sum(odds) / n, max(odds, default=0.0), near / (len(hits) or 1),
        sum(w in SECOND_PERSON for w in words) / n, len(CAPITALS.findall(data)) / size, len(SHOUTED.findall(data)) / n, data.count(b"!") / n, data.count(b"?") / n,
        data.count(b",") / n, len(REPEATED.findall(data)) / n, len(mixed) / n, len(SPACED.findall(data)) / n, folded / n,
    ]


@dataclass
class Trees:
    """Histogram gradient boosting for binary labels; every tree is complete to its depth."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 48
    ridge: float = 2.0
    start: float = 0.0
    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, p = self.binned(x), min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        raw = np.full(len(y), self.start)
        width = self.bins + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            leaf = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, -1.0)
                split = np.zeros((n, 2), np.int64)
                split[:, 1] = width  # all rows go left
                for j in range(x.shape[1]):
                    at = leaf * width + b[:, j]
                    sg = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    sh = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                    gain[(sh < 1) | (th - sh < 1)] = -1.0
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best + 1e-9
                    best[better], split[better] = top[better], np.stack([np.full(n, j), k], 1)[better]
                split[best <= 1e-6] = (0, width)
                tree.append(split)
                leaf = leaf * 2 + (b[np.arange(len(y)), split[leaf, 0]] > split[leaf, 1])
            n = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
            self.nodes.append((tree, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, value in self.nodes:
            leaf = np.zeros(len(x), np.int64)
            for split in tree:
                leaf = leaf * 2 + (b[rows, split[leaf, 0]] > split[leaf, 1])
            out += value[leaf]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising curve from raw score to probability."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of raw scores
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([s / n for _, n, s in blocks]), np.array([v / n for v, n, _ in blocks])


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.trees.raw(x), *self.curve), 0.0, 1.0)


def lexicons_of(sample: DataFrame) -> list[dict[bytes, float]]:
    """Log odds of the words and word beginnings that mark label 1, from the rows of folds 1 to 3; each different text counts once.

    The first lexicon is learnt from all three folds, the others each without one:
    so a row's features can come from a lexicon that has not seen its label.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], Counter] = {(label, fold): Counter() for label in (0, 1) for fold in TAUGHT}
            labels, folds, at = batch.column("label").to_pylist(), batch.column("fold").to_pylist(), 0
            for part in texts_in(batch.column("text")):
                for data in part:
                    seen[labels[at], folds[at]].update({e for w in set(data.translate(FOLD).split()) for e in entries(w)})
                    at += 1
            keys = list(set().union(*seen.values()))
            sums = [pa.array([seen[x][k] for k in keys], pa.int64()) for x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *sums], ["entry", *(f"{'gb'[label]}{fold}" for label, fold in seen)])

    taught = sample.where(F.col("fold").isin(*TAUGHT))
    single = taught.groupBy(F.xxhash64("text").alias("t"), "label", "fold").agg(F.first("text").alias("text")).select("text", "label", "fold")
    sizes = {(r["label"], r["fold"]): r["n"] for r in taught.groupBy("label", "fold").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    names = [f"{k}{fold}" for k in "gb" for fold in TAUGHT]
    table = map_batches(single, counted, "entry binary, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))
    worth = []
    for left in (0, *TAUGHT):
        bad, good = (sum(F.col(f"{k}{fold}") for fold in TAUGHT if fold != left) for k in "bg")
        n_bad, n_good = (max(sum(sizes.get((label, fold), 0) for fold in TAUGHT if fold != left), 1) for label in (1, 0))
        odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
        worth.append(F.when((bad >= 4) & (odds >= 2.5), F.struct((odds * F.sqrt(bad)).alias("rank"), odds.alias("odds"))).alias(f"w{left}"))
    table = cut(table.select("entry", *worth))
    out = []
    for left in (0, *TAUGHT):
        best = table.where(F.col(f"w{left}").isNotNull()).orderBy(F.desc(f"w{left}.rank"), "entry").limit(LEXICON).select("entry", f"w{left}.odds").collect()
        out.append({bytes(r["entry"]): float(r["odds"]) for r in best})
    return out


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, label) of at most limit labelled rows outside the held-out fold, spread by a hash of the id.

    An id with several labels counts as toxic if one of them says so; null ids and labels are left out.
    """
    spark = docs.sparkSession
    train = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_bucket("doc_id", 5) != 0)
    chosen = train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    # At most limit pairs of numbers: small enough to send to every executor.
    ids = spark.createDataFrame([(r["doc_id"], int(r["label"] == 1)) for r in chosen], "__id long, label int")
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "__id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fits lexicon, trees and calibration on a bounded sample of labelled rows.

    Texts fall into four folds by their hash. Folds 1 to 3 teach the lexicon and the
    trees, each row measured by a lexicon learnt from the other two; fold 0, of which
    neither has seen anything, calibrates.
    """
    sample = cut(labelled(docs, labels, limit).withColumn("h", F.xxhash64("text")).withColumn("fold", F.pmod("h", F.lit(4)).cast("int")))
    lexicons = lexicons_of(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, at, rows = batch.column("fold").to_pylist(), 0, []
            for part in texts_in(batch.column("text")):
                rows += [features(t, lexicons[k]) for t, k in zip(part, folds[at : at + len(part)], strict=True)]
                at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label"), batch.column("fold"), batch.column("h")], ["x", "label", "fold", "h"])

    rows = map_batches(sample, measured, "x array<double>, label int, fold int, h long").collect()
    rows.sort(key=lambda r: (r["h"], r["label"]))  # the same model whatever order the tasks end in
    y = np.array([r["label"] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicons[0], None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    x, held = np.array([r["x"] for r in rows]), np.array([r["fold"] == 0 for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:  # too few rows to keep a fold apart
        held = np.zeros(len(y), bool)
    trees = Trees().fit(x[~held], y[~held])
    test = held if held.any() else ~held
    return Model(lexicons[0], trees, isotonic(trees.raw(x[test]), y[test]), float(y.mean()))


def toxicity_score(text: Column | str, model: Model) -> Column:
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([s for part in texts_in(column) for s in model.scores(part)], pa.float64())

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted; columns of these names are replaced.

    held_out marks the ids (null: empty text) that no label was learnt from.
    """
    model = train(docs.select("doc_id", F.col(text).alias("text")), labels, limit)
    return docs.withColumns({"held_out": crc_bucket("doc_id", 5) == 0, "score": toxicity_score(F.col(text), model)}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
