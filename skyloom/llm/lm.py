r"""Scores of a gated recurrent language model with a class-factored softmax.

Text is lower-cased (A-Z) and cut into words `[^\x20\x09-\x0D]+`, then one end
token. Counts of all tokens of the training documents (crc32 of the id as text
mod 10 is not 0; a null id's text is empty) give the base score and order the
words by frequency. The frequent ones form classes of equal size, a word's
probability being that of its class times that within it; all others form one
more class, inside which smoothed counts decide, so that every word, known or
not, has a probability.

The network is a GRU in numpy, trained by back-propagation truncated to
``window`` tokens with the state carried from window to window. Each task trains
a copy on its share of the training documents, copies are averaged by a tree of
tasks, and the next round starts from the average. To score, all documents of a
batch go through the network side by side, in windows, with their states
carried, so that a whole document has one likelihood.

Words beyond the ``head`` most frequent are counted by a shuffle join, so
neither driver nor workers hold the vocabulary.

Defined results: null or empty text is one end token; without training
documents both scores are the base score of zero counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.runtime import crc_bucket, cut, id_of, map_batches, null_id_back, texts_in

#: Words whose counts every worker holds, at most, and the bytes of such a word, at most; a longer one is counted by the join like any rare word.
HEAD, LONGEST = 200_000, 64
#: Steps of the histogram of counts for each doubling.
STEPS = 64
#: Size of the state, and words that the network tells apart, at most; classes and the words in each are about the square root of it.
HIDDEN, FREQUENT = 16, 1024
#: Tokens of a window, and streams side by side, at most; fewer where that leaves under UPDATES windows.
WINDOW, STREAMS, UPDATES = 24, 512, 64
#: Each round trains on the training documents whose id hash falls in its one of so many parts; as many rounds as parts take all.
ROUNDS = PARTS = 4
#: Texts that are held as Python objects at a time.
SIDE = 1000
#: Sums before the softmax above this count as this, so that no exponential overflows.
HIGHEST = 60.0
END = b""  # no word is empty
NAMES = ("x", "u", "uc", "wc", "bc", "wo", "bo")


def grid_of(frequent: int) -> tuple[int, int]:
    """(classes, slots) for that many words."""
    slots = max(1, math.isqrt(max(frequent, 1) - 1) + 1)
    return max(1, -(-frequent // slots)), slots


def shapes(classes: int, slots: int, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    return {"x": (classes * slots + 1, 3 * hidden), "u": (hidden, 2 * hidden), "uc": (hidden, hidden), "wc": (hidden, classes + 1), "bc": (classes + 1,), "wo": (classes, hidden, slots), "bo": (classes, slots)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def summed(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each id from 0 to n - 1."""
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[found] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Network:
    """Parameters and passes; token ids: frequent words by rank, then one id for all others."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.rare = len(params["x"]) - 1
        self.hidden = len(params["uc"])
        self.classes, self.slots = params["bo"].shape

    @classmethod
    def fresh(cls, counts: np.ndarray, rare: float) -> Network:
        """Small random weights from a fixed seed, and biases that give the words' frequencies; counts: of the frequent words."""
        rng = np.random.default_rng(7)
        classes, slots = grid_of(len(counts))
        p = {k: (rng.standard_normal(s) * 0.08).astype(np.float32) for k, s in shapes(classes, slots).items()}
        full = np.full(classes * slots, 1e-6)
        full[: len(counts)] = counts
        grid = full.reshape(classes, slots)
        p["bc"] = np.log(np.append(grid.sum(1), max(rare, 0.1))).astype(np.float32)
        p["bc"] -= p["bc"].max()
        p["bo"] = (np.log(grid) - np.log(grid.sum(1, keepdims=True))).astype(np.float32)
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in NAMES])

    def like(self, flat: np.ndarray) -> Network:
        """A network of the same shape with other parameters."""
        out, at = {}, 0
        for k in NAMES:
            s = self.p[k].shape
            out[k] = flat[at : at + math.prod(s)].reshape(s).astype(np.float32)
            at += math.prod(s)
        return Network(out)

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.gated(h, self.p["x"].take(ids, axis=0))

    def gated(self, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, both gates, the gated state and the candidate; a: the input's part of the sums."""
        n = self.hidden
        zr = h @ self.p["u"]
        zr += a[:, : 2 * n]
        sigmoid(zr)
        z, r = zr[:, :n], zr[:, n:]
        rh = r * h
        c = rh @ self.p["uc"]
        c += a[:, 2 * n :]
        np.tanh(c, out=c)
        out = c - h
        out *= z
        out += h
        return out, z, r, rh, c

    def grouped(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each id, an order by class, and where each class ends in it."""
        group = np.where(ids == self.rare, self.classes, ids // self.slots).astype(np.int16 if self.classes < 1 << 15 else np.int64)
        order = np.argsort(group, kind="stable")
        return group, order, np.searchsorted(group[order], np.arange(self.classes + 1))

    def outputs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each token id after state h; for the others' id that of their class."""
        group, order, ends = self.grouped(ids)
        logits = h @ self.p["wc"]
        logits += self.p["bc"]
        np.minimum(logits, HIGHEST, out=logits)
        out = logits[np.arange(len(ids)), group].astype(np.float64)
        out -= np.log(np.exp(logits, out=logits).sum(1))
        states, slot = h[order], (ids - group.astype(ids.dtype) * self.slots)[order]
        inside = np.zeros(len(ids))
        for k in range(self.classes):
            a, b = ends[k], ends[k + 1]
            if b > a:
                inner = states[a:b] @ self.p["wo"][k]
                inner += self.p["bo"][k]
                np.minimum(inner, HIGHEST, out=inner)
                inside[a:b] = inner[np.arange(b - a), slot[a:b]]
                inside[a:b] -= np.log(np.exp(inner, out=inner).sum(1))
        out[order] += inside
        return out

    def train(self, ids: np.ndarray, rate: float = 0.01) -> None:
        """One pass over a token sequence cut into parallel streams; token 0 ends a document and clears the state."""
        streams = max(1, min(STREAMS, len(ids) // (UPDATES * WINDOW)))
        size = (len(ids) - 1) // streams
        if size < 1:
            return
        x = np.stack([ids[i * size : (i + 1) * size] for i in range(streams)], 1)
        y = np.stack([ids[i * size + 1 : (i + 1) * size + 1] for i in range(streams)], 1)
        h = np.zeros((streams, self.hidden), np.float32)
        for at in range(0, size, WINDOW):
            h, grads = self.window(h, x[at : at + WINDOW], y[at : at + WINDOW])
            self.adam(grads, rate)

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Forward and truncated backward pass; gradients of the mean negative log probability."""
        p, n = self.p, self.hidden
        size, streams = x.shape
        inputs, live = p["x"][x], (x != 0).astype(p["u"].dtype)[:, :, None]
        whole = live.all(axis=(1, 2))
        before, states, gated = (np.empty((size, streams, n), p["u"].dtype) for _ in range(3))
        gates = np.empty((size, streams, 3 * n), p["u"].dtype)  # both gates and the candidate, later their sums' gradients
        for t in range(size):
            before[t] = h if whole[t] else h * live[t]
            h, gates[t, :, :n], gates[t, :, n : 2 * n], gated[t], gates[t, :, 2 * n :] = self.gated(before[t], inputs[t])
            states[t] = h
        g, back = self.output_gradients(states.reshape(-1, n), y.ravel())
        back = back.reshape(size, streams, n)
        dh = np.zeros_like(h)
        turned_u, turned_uc = p["u"].T.copy(), p["uc"].T.copy()
        for t in range(size - 1, -1, -1):
            z, r, c = (gates[t, :, i * n : (i + 1) * n] for i in range(3))
            dh += back[t]
            dc = dh * z
            dz = dh * (c - before[t])
            keep = dh * (1 - z)
            dz *= z * (1 - z)
            dc *= 1 - c * c
            drh = dc @ turned_uc
            keep += drh * r
            drh *= before[t]
            drh *= r * (1 - r)
            gates[t, :, :n], gates[t, :, n : 2 * n], gates[t, :, 2 * n :] = dz, drh, dc
            keep += gates[t, :, : 2 * n] @ turned_u
            dh = keep if whole[t] else keep * live[t]
        rows = gates.reshape(-1, 3 * n)
        g["u"] = before.reshape(-1, n).T @ rows[:, : 2 * n]
        g["uc"] = gated.reshape(-1, n).T @ rows[:, 2 * n :]
        g["x"] = summed(rows, x.ravel(), len(p["x"]))
        return h, {k: g[k] for k in NAMES}

    def output_gradients(self, states: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the two softmax layers, and of the states."""
        p, total = self.p, len(target)
        group, order, ends = self.grouped(target)
        logits = states @ p["wc"]
        logits += p["bc"]
        np.minimum(logits, HIGHEST, out=logits)
        np.exp(logits, out=logits)
        logits *= (1 / (total * logits.sum(1)))[:, None]
        logits[np.arange(total), group] -= 1 / total
        g = {"wc": states.T @ logits, "bc": logits.sum(0), "wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
        back = logits @ p["wc"].T
        # By class, so that every class is one slice.
        sorted_states, slot, inside = states[order], (target - group.astype(target.dtype) * self.slots)[order], np.zeros_like(states)
        for k in range(self.classes):
            a, b = ends[k], ends[k + 1]
            if b > a:
                s = sorted_states[a:b]
                inner = s @ p["wo"][k]
                inner += p["bo"][k]
                np.minimum(inner, HIGHEST, out=inner)
                np.exp(inner, out=inner)
                inner *= (1 / (total * inner.sum(1)))[:, None]
                inner[np.arange(b - a), slot[a:b]] -= 1 / total
                g["wo"][k], g["bo"][k] = s.T @ inner, inner.sum(0)
                inside[a:b] = inner @ p["wo"][k].T
        back[order] += inside
        return g, back

    def adam(self, grads: dict[str, np.ndarray], rate: float) -> None:
        if not hasattr(self, "moments"):
            self.moments, self.steps = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        self.steps += 1
        fix = rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= fix * m / (np.sqrt(v) + 1e-6)

    def score(self, docs: list[np.ndarray], tokens: int = 1 << 15) -> np.ndarray:
        """Natural log probability of each document's ids (the last one its end).

        All documents go side by side, the longest first, in windows of about so many
        tokens, and carry their states from window to window.
        """
        sizes = np.array([len(d) for d in docs], np.int64)
        out = np.zeros(len(docs))
        if not len(docs):
            return out
        order = np.argsort(-sizes, kind="stable")
        size = sizes[order]
        starts = np.zeros(len(docs), np.int64)
        np.cumsum(size[:-1], out=starts[1:])
        flat = np.concatenate([docs[i] for i in order])
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # documents longer than t come first
        h = np.zeros((len(docs), self.hidden), np.float32)
        last = np.zeros(len(docs), flat.dtype)  # the end token opens a text
        at = 0
        while at < size[0]:
            states, targets, rows = [], [], []
            end = min(at + max(1, tokens // int(alive[at])), int(size[0]))
            for t in range(at, end):
                n = int(alive[t])
                now = self.step(h[:n], last[:n])[0]
                h = now if n == len(h) else now.copy()  # a document that has ended is not needed again
                ids = flat[starts[:n] + t]
                states.append(now)
                targets.append(ids)
                rows.append(np.arange(n))
                last = ids
            logs = self.outputs(np.concatenate(states), np.concatenate(targets))
            out[order] += np.bincount(np.concatenate(rows), logs, len(docs))
            at = end
        return out


@dataclass
class Vocabulary:
    """The head of the vocabulary and the totals of the whole."""

    rank: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int

    @property
    def frequent(self) -> int:
        return min(len(self.counts), FREQUENT)

    @property
    def rare_tokens(self) -> int:
        return self.tokens - int(self.counts[: self.frequent].sum())

    def rare_floor(self) -> float:
        """Denominator of the smoothed counts inside the class of all other words."""
        return self.rare_tokens + 0.1 * (self.types - self.frequent + 1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ranks of words, -1 beyond the head."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))


def token_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all tokens; the empty word is the end token."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for part in texts_in(batch.column("text"), SIDE):
                for t in part:
                    found.update(t.lower().split())
            if batch.num_rows:
                found[END] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    return map_batches(train.select("text"), counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, limit: int) -> Vocabulary:
    """The end token first, then words by falling count, limit of them at most.

    A histogram of the counts' logarithms shows from which step on the words above
    fit the limit; they alone are fetched. So no task ever holds more than its own
    part of them, and words of equal count are all in or all out.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    end, step = F.col("word") == F.lit(END), F.floor(F.log2("c") * STEPS).cast("int")
    short = counts.where(~end & (F.octet_length("word") <= LONGEST))
    sizes = sorted(((r["step"], r["n"]) for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, limit - 1
    for k, n in sizes:
        room -= n
        if room < 0:
            break
        least = k
    chosen = counts.where(end) if least is None else counts.where(end | ((F.octet_length("word") <= LONGEST) & (step >= least)))
    found = chosen.toArrow()
    rows = sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda r: (r[0] != END, -r[1], r[0]))
    return Vocabulary({w: i for i, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], np.int64), total["n"] or 0, total["v"] or 0)


def average(rows: DataFrame) -> DataFrame:
    """One row for each partition: the token-weighted mean of its networks."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, None
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("net").to_pylist(), strict=True):
                part = np.frombuffer(data, np.float32).astype(np.float64) * n
                total, held = total + n, part if held is None else held + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(held / total).astype(np.float32).tobytes()], pa.binary())], ["n", "net"])

    return map_batches(rows, mean, "n long, net binary")


def trained(train: DataFrame, vocab: Vocabulary, rounds: int, parts: int) -> Network:
    """Local training and tree averaging, round by round; train: (did, text)."""
    spark = train.sparkSession
    net = Network.fresh(vocab.counts[: vocab.frequent], vocab.rare_tokens)
    ranks = spark.sparkContext.broadcast({w: i for w, i in vocab.rank.items() if i < vocab.frequent})
    for k in range(rounds):
        start = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            mine, seen = start.value.like(start.value.flat()), 0
            get, rare = ranks.value.get, repeat(mine.rare)
            for batch in batches:
                ids = [np.zeros(1, np.int32)]
                for part in texts_in(batch.column("text"), SIDE):
                    words = [w for t in part for w in (*t.lower().split(), END)]
                    ids.append(np.fromiter(map(get, words, rare), np.int32, len(words)))
                tokens = np.concatenate(ids)
                seen += len(tokens) - 1
                mine.train(tokens)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([mine.flat().tobytes()], pa.binary())], ["n", "net"])

        # By id and text, so that rows which share an id are not one block.
        share = train.where(F.pmod(F.xxhash64("did", "text"), F.lit(parts)) == k).select("text")
        copies = cut(map_batches(share, learn, "n long, net binary"))
        few = max(1, math.isqrt(copies.rdd.getNumPartitions()))
        rows = average(average(copies.repartition(few)).repartition(1)).collect()
        if rows:
            net = net.like(np.frombuffer(rows[0]["net"], np.float32))
    return net


def score_documents(docs: DataFrame, text: str = "text", head: int = HEAD, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    rows = docs.select(id_of("doc_id").alias("did"), (crc_bucket("doc_id", 10) == 0).alias("held_out"), F.col(text).alias("text"))
    train = rows.where("NOT held_out").select("did", "text")
    counts = cut(token_counts(train))
    vocab = head_of(counts, head)
    net = trained(train, vocab, rounds, parts) if vocab.tokens else Network.fresh(vocab.counts, 0.0)
    sent = spark.sparkContext.broadcast((vocab, net))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = sent.value
        logs = np.log10(vocab.counts + 0.1)
        floor = math.log10(vocab.rare_floor())
        top = vocab.frequent
        for batch in batches:
            seqs, parts = [], []
            for texts in texts_in(batch.column("text"), SIDE):
                lists = [t.lower().split() for t in texts]
                words = [w for x in lists for w in (*x, END)]
                sizes = np.array([len(x) + 1 for x in lists], np.int64)
                starts = np.cumsum(sizes) - sizes
                ids = vocab.ids(words)
                inside = ids >= 0
                rare = ~inside | (ids >= top)
                each = np.where(inside, logs.take(np.maximum(ids, 0)), 0.0) if len(logs) else np.zeros(len(ids))
                sums, known = np.add.reduceat(each, starts), np.add.reduceat(inside.astype(np.int64), starts)
                # Inside the class of all others: the head's part here, the rest after the join.
                model = np.add.reduceat(np.where(rare, each - floor, 0.0), starts)
                seqs += np.split(np.where(rare, net.rare, ids).astype(np.int32), starts[1:])
                beyond = np.flatnonzero(~inside)
                owners = np.searchsorted(starts, beyond, "right") - 1
                found = Counter(zip(owners.tolist(), (words[i] for i in beyond.tolist()), strict=True))
                order = sorted(found, key=lambda x: x[0])
                offsets = np.searchsorted(np.array([i for i, _ in order], np.int64), np.arange(len(texts) + 1)).astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([w for _, w in order], pa.binary()), pa.array([found[x] for x in order], pa.int64())], ["word", "tf"]))
                parts.append((sizes, known, sums, model, tails))
            # Only numbers are left of the texts, so the whole batch goes through the network side by side.
            net_part = net.score(seqs) / math.log(10) if vocab.tokens else np.zeros(len(seqs))
            at = 0
            for sizes, known, sums, model, tails in parts:
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(at, n), batch.column("held_out").slice(at, n), pa.array(sizes), pa.array(known), pa.array(sums), pa.array(model + net_part[at : at + n]), tails],
                    ["did", "held_out", "n_tokens", "n_head", "head_logs", "model", "tail"],
                )
                at += n

    schema = "did long, held_out boolean, n_tokens long, n_head long, head_logs double, model double, tail array<struct<word:binary,tf:long>>"
    parts_ = cut(map_batches(rows, scored, schema).withColumn("row", F.monotonically_increasing_id()))
    tail = parts_.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"))
    out = parts_.drop("tail").join(tail, "row", "left").withColumns({"logs": F.coalesce("logs", F.lit(0.0)), "known": F.coalesce("known", F.lit(0))})
    base = F.col("head_logs") + F.col("logs") - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + 0.1 * (vocab.types + 1)))
    return out.select(null_id_back("did").alias("doc_id"), "held_out", "n_tokens", (F.col("n_head") + F.col("known")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("logs")).alias("score"))
