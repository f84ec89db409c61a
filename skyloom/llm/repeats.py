"""Removal of byte strings that repeat anywhere, by ranks of sampled positions.

Prefix doubling ranks every byte position over and over, which does not fit the
limits (nine sorts of as many rows as there are bytes). Here positions are sampled
by content: each window of ``length`` bytes belongs to one place in it (see
spans.anchors), and equal windows to equal places. Only the idea of growing ranks
is kept, in two fixed levels and a third for the rest:

1. Places are ranked by the ``seed`` bytes at them. What is unique drops out.
2. The pairs (rank, all bytes of the place's windows) are ranked: this passes the
   threshold. Where a pair repeats, all windows of the place do.
3. What is left shares its seed with other pairs but not all its bytes: at the
   ends of repeats. There each window is ranked, place by place, within its
   seed. Seeds with up to ``crowd`` different pairs are read as a sorted stream;
   for more, the windows' hashes are ranked by a shuffle of their own, so that no
   task holds a common passage's neighbourhoods.

Ranks are 64-bit hashes, which only count as equal together with the seed's; bytes
are not compared. Texts move twice, by document, to meet their places and their
spans. A long text is sampled piece by piece, and spans are merged to runs before
those of a text come together, so that a text that repeats itself at every byte
has as few of them as any.

Defined results: texts are UTF-8 bytes, null is empty; matches stay inside one
row; a null id ranks as an id of its own; rows with equal ids and texts are
repeats of one another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.runtime import cut, ensure_checkpoint_dir, id_of, map_batches, null_id_back, offsets_of, remove_folder, texts_in
from skyloom.llm.spans import Hashes, anchors, mix

LENGTH, SEED, CROWD = 400, 64, 1000
#: A place packs its first window start, and the distances to the sampled position and to the last window start.
SHIFT = 20


#: Bytes of text whose positions are hashed at a time, and of a document's part whose spans are merged in one place.
PIECE, PART = 1 << 20, 1 << 20


def groups(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about that many bytes together."""
    first = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def sampled(texts: list[bytes], length: int, seed: int, most: int = PIECE) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """anchors() of the texts as (first row, rows): small ones together, long ones in pieces that share length - 1 bytes.

    At the border of two pieces a place's windows are parted, which makes two places
    of it; their windows are then ranked singly, as at the end of a repeat.
    """
    for first, end in groups([len(t) for t in texts], most):
        long = texts[end - 1] if len(texts[end - 1]) > most else None
        if end - first > 1 or long is None:
            yield first, anchors(texts[first : end - 1 if long is not None else end], length, seed)
        for at in range(0, len(long) - length + 1, most) if long is not None else ():
            found = anchors([long[at : at + most + length - 1]], length, seed)
            yield end - 1, found | {k: found[k] + at for k in ("x", "lo", "hi")}


def places(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(did, th, place, seed, block) of each sampled position; distances must fit in half of SHIFT bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, start = batch.column("did").to_numpy(), batch.column("th").to_numpy(), 0
            for texts in texts_in(batch.column("text")):
                for first, f in sampled(texts, length, seed):
                    who, half = f["row"] + first + start, SHIFT // 2
                    place = f["lo"] << SHIFT | (f["x"] - f["lo"]) << half | (f["hi"] - f["lo"])
                    yield pa.RecordBatch.from_arrays([pa.array(did[who]), pa.array(th[who]), pa.array(place), pa.array(f["seed"]), pa.array(f["block"])], ["did", "th", "place", "seed", "block"])
                start += len(texts)

    return map_batches(rows, run, "did long, th int, place long, seed long, block long")


def unpack(place: int) -> tuple[int, int, int]:
    """First window start, sampled position and last window start."""
    half = SHIFT // 2
    lo, mask = place >> SHIFT, (1 << half) - 1
    return lo, lo + (place >> half & mask), lo + (place & mask)


def neighbourhoods(docs: DataFrame, length: int) -> DataFrame:
    """One row for each place whose windows must be ranked singly: its bytes, or their windows' hashes where the seed is crowded."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = (t for part in texts_in(batch.column("text")) for t in part)
            for did, th, text, wanted in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), texts, batch.column("wanted").to_pylist(), strict=True):
                seen = set()
                for w in wanted:
                    if (w["seed"], w["block"]) in seen:
                        continue
                    seen.add((w["seed"], w["block"]))
                    lo, x, hi = unpack(w["place"])
                    part = text[lo : hi + length]
                    hashes = Hashes(np.frombuffer(part, np.uint8)).all(length).view(np.int64).tolist() if w["crowded"] else None
                    out.append((did, th, w["place"], w["seed"], w["block"], w["decided"], None if w["crowded"] else part, hashes))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())))], ["did", "th", "place", "seed", "block", "decided", "bytes", "hashes"])

    return map_batches(docs, cut_out, "did long, th int, place long, seed long, block long, decided boolean, bytes binary, hashes array<long>")


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def rank_windows(length: int):
    """Reads neighbourhoods sorted by seed and block; yields the spans of repeated windows."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (seed, block, did, th, place, decided, bytes), whole seeds."""
        rows = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]
        sizes = np.array([len(r[6]) for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        starts, n = offsets_of(sizes)[:-1], sizes - length + 1
        first = offsets_of(n)
        own = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(first[-1]) - first[own]
        seeds = np.array([r[0] for r in rows], np.int64)
        place = np.array([unpack(r[4])[:2] for r in rows], np.int64).reshape(-1, 2)
        offset = (place[:, 1] - place[:, 0])[own] - inside  # of the sampled position in the window
        key = mix(Hashes(data).of(starts[own] + inside, length) ^ mix(seeds[own].view(np.uint64) + offset.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit &= ~np.array([r[5] for r in rows], bool)[own]
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])
        a = at[new]
        b = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        who = own[a]
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i in who], pa.int64()), pa.array([rows[i][3] for i in who], pa.int32()), pa.array(place[who, 0] + inside[a]), pa.array(place[who, 0] + inside[b] + length)], ["did", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("seed", "block", "did", "th", "place", "decided", "bytes")), strict=True)
            if held and len(held) >= 2000:
                last = held[-1][0]  # this seed may go on
                whole = next((i for i in range(len(held), 0, -1) if held[i - 1][0] != last), 0)
                if whole:
                    yield from solve(held[:whole])
                    held = held[whole:]
        if held:
            yield from solve(held)

    return run


def crowded_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among neighbourhoods given by hashes, in Spark functions alone."""
    half = SHIFT // 2
    lo = F.shiftright("place", SHIFT)
    at = F.shiftright("place", half).bitwiseAND(F.lit((1 << half) - 1))
    single = rows.dropDuplicates(["seed", "block"]).select("did", "th", "decided", "seed", lo.alias("lo"), at.alias("at"), F.posexplode("hashes").alias("i", "h"))
    single = single.withColumn("offset", F.col("at") - F.col("i"))
    often = single.groupBy("seed", "offset", "h").agg(F.count("*").alias("n")).where("n > 1").select("seed", "offset", "h")
    return single.where("NOT decided").join(often, ["seed", "offset", "h"]).select("did", "th", (F.col("lo") + F.col("i")).alias("a"), (F.col("lo") + F.col("i") + length).alias("b"))


def repeated_spans(rows: DataFrame, length: int, seed: int, crowd: int) -> DataFrame:
    """(did, th, spans): for each document with repeats, the spans to remove, in any order and overlapping."""
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/repeats-{uuid.uuid4().hex}"
    found = places(rows, length, seed)
    pairs = found.groupBy("seed", "block").agg(F.count("*").alias("n"))
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    many = pairs.groupBy("seed").agg(F.count("*").alias("k"), F.min("n").alias("fewest")).where("k > 1")
    # A pair matters if it repeats, or if its seed has several pairs and some of them are single.
    pairs = pairs.join(many, "seed", "left").withColumn("open", F.coalesce((F.col("k") > 1) & (F.col("fewest") == 1), F.lit(False)))
    pairs = pairs.where("n > 1 OR open").select(F.col("seed").alias("__s"), F.col("block").alias("__b"), (F.col("n") > 1).alias("decided"), "open", F.coalesce(F.col("k") > crowd, F.lit(False)).alias("crowded"))
    known = found.join(pairs, (F.col("seed") == F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")
    known.write.parquet(f"{folder}/known")
    known = spark.read.parquet(f"{folder}/known")
    lo = F.shiftright("place", SHIFT)
    decided = known.where("decided").select("did", "th", lo.alias("a"), (lo + F.col("place").bitwiseAND(F.lit((1 << SHIFT // 2) - 1)) + length).alias("b"))
    # One document shows the bytes of a repeated pair; a single pair has but one.
    shown = known.where("open").groupBy("seed", "block").agg(F.min(F.struct("did", "th", "place", "decided", "crowded")).alias("w")).select("w.did", "w.th", F.struct("w.place", "seed", "block", "w.decided", "w.crowded").alias("w"))
    wanted = shown.groupBy(F.col("did").alias("__d"), F.col("th").alias("__t")).agg(F.collect_list("w").alias("wanted"))
    near = neighbourhoods(rows.join(wanted, (F.col("did") == F.col("__d")) & (F.col("th") == F.col("__t"))).select("did", "th", "text", "wanted"), length)
    near.write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    few = near.where("hashes IS NULL").select("seed", "block", "did", "th", "place", "decided", "bytes").repartition("seed").sortWithinPartitions("seed", "block")
    spans = decided.unionByName(map_batches(few, rank_windows(length), "did long, th int, a long, b long")).unionByName(crowded_spans(near.where("hashes IS NOT NULL"), length))
    runs = map_batches(spans.withColumn("part", F.floor(F.col("a") / PART)).repartition("did", "th", "part").sortWithinPartitions("did", "th", "a"), merged, "did long, th int, a long, b long")
    out = cut(runs.groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    remove_folder(spark, folder)
    return out


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads spans (did, th, a, b) in order; yields the runs that they cover, parted only where batches end."""
    for batch in batches:
        did, th, a, b = (batch.column(c).to_numpy() for c in ("did", "th", "a", "b"))
        if not len(a):
            continue
        new = np.ones(len(a), bool)
        new[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1])
        # The greatest end so far in the same text: ends of later texts are lifted above all earlier ones.
        lift = (np.cumsum(new) - 1) << 44
        end = np.maximum.accumulate(b + lift)
        new[1:] |= a[1:] + lift[1:] > end[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(a)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(th[at]), pa.array(a[at]), pa.array((end - lift)[last])], ["did", "th", "a", "b"])


def joined_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for each row: the maximal removed runs and the bytes that stay.

    length: bytes of a string that counts as repeated, below 1024; seed: bytes
    that are ranked first, fewer than length.
    """
    if not 0 < seed < length < 1 << SHIFT // 2:
        raise ValueError("seed must be below length, and length below 1024")
    rows = docs.select(id_of("doc_id").alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.hash("text"))
    spans = repeated_spans(rows, length, seed, crowd).withColumnRenamed("did", "__d").withColumnRenamed("th", "__t")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            at = 0
            for texts in texts_in(batch.column("text")):
                gone = [joined_spans(x) for x in batch.column("spans").slice(at, len(texts)).to_pylist()]
                kept = []
                for t, runs in zip(texts, gone, strict=True):
                    edges = [0, *(e for r in runs for e in r), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], [len(g) for g in gone])]
                did = batch.column("did").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([did, *sizes, pa.array([[{"start": a, "end": b} for a, b in g] for g in gone], kind), pa.array(kept, pa.binary())], ["did", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    met = rows.join(spans, (F.col("did") == F.col("__d")) & (F.col("th") == F.col("__t")), "left").select("did", "text", "spans")
    out = map_batches(met, removed, "did long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(null_id_back("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")
