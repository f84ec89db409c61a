r"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two bits of each other meet in a value that is at most
one bit from both, so each fingerprint emits all variants within that half of
the radius and a shuffle on variants brings neighbours together. A radius of
three is odd; three masks that each hide one third of the bits make it even: of
up to three differing bits, some third hides at least one, and at most two stay
visible. Colliding fingerprints are verified in full.

Equal fingerprints are one node. Buckets are read as a sorted stream; inside a
bucket a breadth-first walk over the fingerprints not yet reached finds links
enough to connect what is connected, and never writes all pairs.

near_copies links by similarity. SimHash fingerprints of five-word shingles that
meet in a ball propose first. At a similarity of 0.8 fingerprints of 64 bits differ
in ten bits on average, beyond any ball that can be written out, so the rest is
proposed in another way: two texts that share 0.8 of their shingles share one of
the rarest fifth of each, and long fingerprints of 256 bits, read as estimates of
the angle, tell which of those that meet are near (see FAR). What is near is put
together in neighbourhoods, inside which the shares of common shingles of all
pairs, counted in full, decide. Neither pairs that meet nor pairs of a
neighbourhood are ever written: crowded buckets and neighbourhoods are tiled, and
what leaves a tile is a spanning forest.

Defined results: null or wordless text has fingerprint zero, linked like any
other; a null id ranks after every other id; rows with equal ids keep their own
fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.llm.runtime import cut, few, id_of, map_batches, null_id_back, texts_in
from skyloom.llm.spans import mix

RADIUS = 3
#: Bits hidden by each of the three masks.
HIDDEN = ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes, width: int = 3, step: int = 1 << 16) -> int:
    """The SimHash of a text's word shingles; whole texts, step shingles at a time."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, step):
        part = words[at : min(at + step, n) + width - 1]
        shingles = zip(*(part[i:] for i in range(width)), strict=False) if len(words) >= width else [part]
        raw = b"".join([digest(b" ".join(s), 42) for s in shingles])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(did, fp): the id, never null, and the fingerprint as a signed long."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x, width)) for part in texts_in(batch.column("text")) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(found, pa.int64())], ["did", "fp"])

    return map_batches(docs.select(id_of("doc_id").alias("did"), F.col(text).alias("text")), printed, "did long, fp long")


def ball(fp: Column, radius: int = RADIUS) -> Column:
    """All variants that differ in at most one bit; for radius 3, of the bits that each of the three masks leaves."""
    flips = []
    for hidden in HIDDEN if radius > 2 else (0,):
        # The lowest hidden bit tells the masks apart; a chance collision costs one verification.
        mark = hidden & -hidden
        flips += [(~hidden, mark | flip) for flip in (0, *(1 << b for b in range(64) if not hidden >> b & 1))]
    pairs = F.array(*(F.struct(F.lit(signed(a & ALL)).alias("seen"), F.lit(signed(x)).alias("flip")) for a, x in flips))
    return F.transform(pairs, lambda p: fp.bitwiseAND(p["seen"]).bitwiseXOR(p["flip"]))


def linked(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect what is connected by steps of at most radius bits; fps unsigned."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                out += [(int(at), int(i)) for i in rest[near]]
                reached += rest[near].tolist()
                rest = rest[~near]
    return out


def bucket_links(radius: int):
    """Reads rows sorted by key; yields links (a, b) between representatives."""

    def links(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> np.ndarray:
        same = keys[1:] == keys[:-1]
        near = same & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= radius)
        at = np.flatnonzero(near)
        pairs = [np.stack([reps[at], reps[at + 1]], 1)]
        # Buckets whose neighbours in the stream are not all linked need the walk.
        gaps = np.flatnonzero(same & ~near)
        if len(gaps):
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            ends = np.append(starts[1:], len(keys))
            for r in np.unique(np.searchsorted(starts, gaps, "right") - 1):
                a, b = starts[r], ends[r]
                if b - a > 2:
                    found = linked(fps[a:b], radius)
                    if found:
                        pairs.append(reps[a:b][np.array(found)])
        return np.unique(np.concatenate(pairs), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")]
            now[1] = now[1].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last bucket may go on
            if whole:
                found = links(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        if held is not None and len(held[0]):
            found = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def ball_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) between representatives of fingerprints that meet in a ball; nodes: (fp, rep), each fingerprint once."""
    shuffled = nodes.select(F.explode(ball(F.col("fp"), radius)).alias("key"), "fp", "rep").repartition("key").sortWithinPartitions("key")
    return map_batches(shuffled, bucket_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id reachable by links of at most radius (0 to 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the masks are made for radii up to 3")
    prints = cut(fingerprints(docs, text, width))
    nodes = prints.groupBy("fp").agg(F.min("did").alias("rep"))
    roots = components(ball_links(nodes, radius))
    group = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component"))
    out = prints.join(group, F.col("fp") == F.col("__fp"))
    return out.select(null_id_back("did").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), null_id_back("component").alias("component_id"))


#: The share of common five-word shingles from which texts are near copies.
SIMILARITY = 0.8
WIDTH = 5
#: Texts whose shingles are counted to put common ones last, and the count from which one is common. They set the order of
#: the prefixes and so the number of candidates; the result is the same in any order.
ORDERED_BY, COMMON = 5_000, 8
#: Rows of a bucket of which all pairs are written; larger buckets are searched in tiles.
SMALL = 8
#: Rows of a bucket, texts of a neighbourhood and shingles of a neighbourhood in one chunk; a tile has two chunks.
CHUNK, TEXTS, SHINGLES = 4096, 1024, 1_000_000


#: Longs of a long fingerprint. Of two texts with at least LEAST shingles each those pairs are passed over whose
#: fingerprints differ in more bits than pairs at the similarity asked for do, by FAR deviations: at 0.8 they differ in 39
#: on average, with a deviation of 5.7, and over 67 pass for far. So a pair at 0.8 is passed over with a chance of less
#: than one in a million, one above it with less; pairs under 0.3 nearly all are.
LONGS, FAR, LEAST = 4, 5, 64


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles, as signed longs; of fewer words the whole sequence is one."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out + w[i : i + n])
    return np.unique(out).view(np.int64)


def print_of(hashes: np.ndarray, step: int = 1 << 14) -> list[int]:
    """The SimHash of a set of shingle hashes, in LONGS signed longs of which the first is the short fingerprint."""
    ones = np.zeros(64 * LONGS, np.int64)
    salts = np.arange(LONGS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), step):
        spread = mix(hashes[at : at + step].view(np.uint64)[:, None] + salts)
        ones += np.unpackbits(spread.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.int64).tolist()


def node_of(hashes: np.ndarray) -> int:
    """Stands for a whole set of shingles."""
    return signed(xxhash.xxh3_64_intdigest(hashes.tobytes(), 7))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """As many of a text's rarest shingles as hold one of any text that is at least so similar.

    Whoever lacks all of them has too few of the rest: of n shingles, n - ceil(similarity * n) + 1.
    """
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the shingles that many of about ORDERED_BY texts hold."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_in(batch.column("text")):
                found, n = np.unique(np.concatenate([shingle_hashes(x) for x in part]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["hash", "n"])

    every = max(1, texts.count() // ORDERED_BY)
    some = texts.where(F.pmod("th", F.lit(every)) == 0).select("text")
    found = map_batches(some, counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    hashes, counts = found.column("hash").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


PRINTS = [f"f{i}" for i in range(LONGS)]


def sketches(texts: DataFrame) -> DataFrame:
    """(did, th, node, size, f0 ...) of each row: its set of shingles, their number and the long fingerprint."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in texts_in(batch.column("text")):
                found = [shingle_hashes(x) for x in part]
                prints = zip(*(print_of(x) for x in found), strict=True)
                own = [batch.column(c).slice(at, len(part)) for c in ("did", "th")]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own, pa.array([node_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), *(pa.array(x, pa.int64()) for x in prints)], ["did", "th", "node", "size", *PRINTS])

    return map_batches(texts, drawn, "did long, th long, node long, size long, " + ", ".join(f"{c} long" for c in PRINTS))


def dealt_keys(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, rep, size, at) of the prefix of each different set of shingles, at being the place in its order; a task writes a set once."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in texts_in(batch.column("text")):
                rows = []
                for x in part:
                    found = shingle_hashes(x)
                    if (node := node_of(found)) not in seen:
                        seen.add(node)
                        keys = prefix(found, *sent.value, similarity)
                        rows.append((keys, np.full(len(keys), node), np.full(len(keys), len(found), np.int32), np.arange(len(keys), dtype=np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["key", "rep", "size", "at"])

    return map_batches(texts.select("text"), drawn, "key long, rep long, size int, at int")


def alike_bound(similarity: float):
    """may_be_alike() for arrays."""
    share = similarity / (1 + similarity)
    return lambda na, ia, nb, ib: np.minimum(ia, ib) + 1 + np.minimum(na - ia - 1, nb - ib - 1) >= share * (na + nb) - 1e-6


def bucket_pairs(similarity: float, small_up_to: int):
    """Reads rows (key, rep, size, at) sorted by key; yields pairs a > b (b not null) of buckets of up to so many rows, and the rows of larger ones (a is the rep, b null)."""
    may = alike_bound(similarity)

    def pairs(key: np.ndarray, rep: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        big = np.repeat(sizes > small_up_to, sizes)
        found = []
        small = np.flatnonzero(~big)
        k, r, n, i = key[small], rep[small], size[small].astype(np.int64), at[small].astype(np.int64)
        for gap in range(1, min(small_up_to, int(sizes.max()))):
            x = np.flatnonzero((k[gap:] == k[:-gap]) & (r[gap:] != r[:-gap]))
            if len(x):
                y = x + gap
                x, y = (z[may(n[x], i[x], n[y], i[y])] for z in (x, y))
                found.append(np.stack([np.maximum(r[x], r[y]), np.minimum(r[x], r[y])], 1))
        if found and len(rows := np.unique(np.concatenate(found), axis=0)):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), none, none.cast(pa.int32()), none.cast(pa.int32())], ["a", "b", "key", "size", "at"])
        rest = np.flatnonzero(big)
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(rep[rest]), pa.nulls(len(rest), pa.int64()), pa.array(key[rest]), pa.array(size[rest]), pa.array(at[rest])], ["a", "b", "key", "size", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "size", "at")]
            held.append(now)
            rows += batch.num_rows
            if rows >= 200_000 and held[0][0][0] != now[0][-1]:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last bucket may go on
                yield from pairs(*(c[:end] for c in whole))
                held, rows = [[c[end:].copy() for c in whole]], len(whole[0]) - end
        if rows:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


class Forest:
    """Links that keep connected what is connected among the rows of one tile."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def reach(self, x: int, others: np.ndarray) -> None:
        """Joins x with the rows others, by one link to each of the parts that they are in."""
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[x]
        if new.any():
            self.links += [(x, int(i)) for i in others[first[new]]]
            self.label[np.isin(self.label, labels[new])] = self.label[x]

    def done(self, x: int, others: np.ndarray) -> bool:
        return bool((self.label[others] == self.label[x]).all())


def tiled(rows: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """rows (key, rep, ...) dealt to tiles (key, i, j): chunk i of a key's rows beside chunk j; c tells a row's own. chunks: (key, k) of the keys with several."""
    dealt = rows.join(few(chunks), key, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    beside = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    return dealt.withColumn("t", F.explode(beside)).select(*rows.columns, "c", "t.i", "t.j").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def by_tile(key: str, columns: list[str], forest: Callable[..., Forest]):
    """Reads rows sorted by tile; forest(left, right, columns ...) gets the places of the rows of both chunks and the columns, the first of them ids; yields (a, b) of its links."""

    def solved(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        c, i, j, *values = zip(*held, strict=True)
        c = np.array(c)
        found = forest(np.flatnonzero(c == i[0]), np.flatnonzero(c == j[0]), *values).links
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([values[0][x] for x, _ in found], pa.int64()), pa.array([values[0][y] for _, y in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (key, "i", "j", "c", *columns)), strict=True):
                if row[:3] != tile:
                    yield from solved(held)
                    tile, held = row[:3], []
                held.append((row[3], row[1], row[2], *row[4:]))
        yield from solved(held)

    return run


def near_forest(similarity: float):
    """Links of the rows of a bucket that may be alike and are near by their long fingerprints."""
    may, most = alike_bound(similarity), most_apart(similarity)

    def forest(left: np.ndarray, right: np.ndarray, rep, size, at, *prints) -> Forest:
        out = Forest(len(rep))
        size, at, prints = np.array(size, np.int64), np.array(at, np.int64), np.array(prints, np.int64).view(np.uint64)
        for x in left:
            if not out.done(x, right):
                apart = np.bitwise_count(prints[:, right] ^ prints[:, x, None]).sum(0)
                near = ((apart <= most) | (np.minimum(size[right], size[x]) < LEAST)) & may(size[right], at[right], size[x], at[x])
                out.reach(x, right[near])
        return out

    return forest


def alike_forest(similarity: float):
    """Links of the texts of a neighbourhood whose share of common shingles is large enough."""

    def forest(left: np.ndarray, right: np.ndarray, rep, text) -> Forest:
        out, sets = Forest(len(rep)), [shingle_hashes(t) for t in text]
        sizes = np.array([len(s) for s in sets], np.int64)
        # Who of the right holds a shingle, by shingle.
        hashes = np.concatenate([sets[r] for r in right])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(right)), sizes[right])[order]
        for x in left:
            if out.done(x, right):
                continue
            a, b = np.searchsorted(hashes, sets[x], "left"), np.searchsorted(hashes, sets[x], "right")
            n = b - a
            spots = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(owner[spots], minlength=len(right))
            out.reach(x, right[(common > 0) & (common >= similarity * (sizes[x] + sizes[right] - common) - 1e-9)])
        return out

    return forest


def printed_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) between texts whose short fingerprints are equal or meet in a ball. nodes: (node, f0)."""
    prints = nodes.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("rep"))
    equal = nodes.join(prints, F.col("f0") == F.col("fp")).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return equal.unionByName(ball_links(prints, radius).where("a <> b"))


def most_apart(similarity: float) -> float:
    """Bits in which long fingerprints of texts of that similarity differ, at most: sets of one size are farthest apart."""
    bits = 64 * LONGS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * p + FAR * math.sqrt(bits * p * (1 - p))


def not_far(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose long fingerprints leave that similarity possible; nodes: (node, size, f0 ...)."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), *(F.col(c).alias(f"{c}{side}") for c in PRINTS)), side)
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in PRINTS), F.lit(0))
    return pairs.where((F.least("na", "nb") < LEAST) | (apart <= F.lit(most_apart(similarity)))).select("a", "b")


def near_links(texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all texts that share a key and are near, directly or through others."""
    dealt = dealt_keys(texts, similarity).repartition("key").sortWithinPartitions("key", "rep")
    met = cut(map_batches(dealt, bucket_pairs(similarity, SMALL), "a long, b long, key long, size int, at int"))
    pairs = not_far(met.where("b IS NOT NULL").select("a", "b").distinct(), nodes, similarity)
    crowd = met.where("b IS NULL").select("key", F.col("a").alias("rep"), "size", "at").join(nodes.select(F.col("node").alias("rep"), *PRINTS), "rep").select("key", "rep", "size", "at", *PRINTS)
    chunks = crowd.groupBy("key").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("k")).where("k > 1")
    tiles = tiled(crowd, "key", chunks)
    return pairs.unionByName(map_batches(tiles, by_tile("key", ["rep", "size", "at", *PRINTS], near_forest(similarity)), "a long, b long"))


def alike_links(texts: DataFrame, nodes: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all texts of a neighbourhood that are similar enough, directly or through others. near: (node, component)."""
    inside = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    members = cut(nodes.select("node", "did", "th", "size").join(inside, "node"))
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(TEXTS)), F.ceil(F.sum("size") / F.lit(SHINGLES))).cast("int").alias("k")).where("k > 1")
    found = texts.join(few(members.select("did", "th", F.col("node").alias("rep"), "component")), ["did", "th"]).select("component", "rep", F.col("text").cast("binary").alias("text"))
    return map_batches(tiled(found, "component", sizes), by_tile("component", ["rep", "text"], alike_forest(similarity)), "a long, b long")


def near_copy_rows(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, radius: int = 2) -> DataFrame:
    """(did, th, component, stays) for each row: its id (see id_of), a hash of its text, its group's smallest id, and whether it is the row that stays for its group.

    That row has the smallest id, of several texts under it the smallest hash; rows
    equal in both stay or go together.
    """
    texts = docs.select(id_of("doc_id").alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).select("did", "th", "text")
    rows = cut(sketches(texts))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("did", "th")).alias("row"), *(F.min(c).alias(c) for c in ("size", *PRINTS))).select("node", "row.did", "row.th", "size", *PRINTS))
    near = components(printed_links(nodes, radius).unionByName(near_links(texts, nodes, similarity)))
    roots = components(alike_links(texts, nodes, near, similarity))
    found = rows.select("did", "th", "node").join(roots, "node", "left").select("did", "th", F.coalesce("component", "node").alias("root"))
    least = found.groupBy("root").agg(F.min(F.struct("did", "th")).alias("first"))
    return found.join(least, "root").select("did", "th", F.col("first.did").alias("component"), (F.struct("did", "th") == F.col("first")).alias("stays"))


def near_copies(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row: groups linked by texts that share 0.8 or more of their five-word shingles.

    Texts without words are one group; repeated rows as in simhash_groups.
    """
    return near_copy_rows(docs, text, similarity).select(null_id_back("did").alias("doc_id"), null_id_back("component").alias("component_id"))
