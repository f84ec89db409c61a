"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cosine >= c means a squared distance of at most 2 - 2c. Vectors
are turned by a fixed rotation and split into blocks of dimensions; each block
gets a share of that squared distance in proportion to its dimensions, and a
pair within the whole budget is within its share in some block. Every block is a
range join: a grid over the block's leading dimensions, with cells as wide as
twice the range, where each vector also visits the neighbour cells in its reach.
Only the first block that admits a pair verifies it, with the exact cosine in
double precision, so no pair counts twice.

Equal vectors of one label are one node with a weight. Crowded cells are tiled:
rows are dealt to chunks, and each pair of chunks is a task of its own. Pairs
never leave a tile; what leaves it are sums for each vector and a spanning
forest of its links. Vectors travel as 4-byte numbers where these are exact, and
scaled by a power of two, which changes no cosine but keeps squares finite.

Defined results: null labels, and vectors that are null, empty, zero or hold
null or non-finite components, link with nothing. Vectors of different lengths
do not link. A null id ranks after every other id; repeated rows are vectors of
their own that link as others do, and share a component with their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.llm.runtime import cut, id_of, map_batches, null_id_back

COSINE = 0.98
BLOCKS, GRID = 4, 2
#: Rows of a cell that are compared in one tile, at most on average. A row of a crowded cell is sent once for each chunk of
#: the cell, so larger chunks move less; a tile of two chunks of 64 dimensions takes some 30 MB.
CHUNK = 8192
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed rotation of that many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(20240).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def splits(dims: int, blocks: int) -> np.ndarray:
    """Block borders; blocks differ in size by one dimension at most."""
    return np.unique(np.linspace(0, dims, min(blocks, dims) + 1).astype(int))


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def packed(v: np.ndarray) -> bytes:
    """The components, the largest scaled to between a half and one, in 4 bytes each where that is exact, else in 8; a last byte tells which."""
    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
    small = v.astype(np.float32)
    return small.tobytes() + b"\4" if (small == v).all() else v.tobytes() + b"\x08"


def dims_of(data: bytes) -> int:
    return (len(data) - 1) // data[-1]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """Rows of that many components as doubles."""
    out = np.empty((len(rows), dims))
    for size, kind in ((4, np.float32), (8, np.float64)):
        at = [i for i, r in enumerate(rows) if r[-1] == size]
        if at:
            out[at] = np.frombuffer(b"".join(rows[i][:-1] for i in at), kind).reshape(-1, dims)
    return out


def prepared(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """(vid, label, raw): raw has the components of a vector that can link (see packed), else null."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for x, group in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist(), strict=True):
                ok = group is not None and x and None not in x
                v = np.array(x, np.float64) + 0.0 if ok else None
                raws.append(packed(v) if ok and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("label"), pa.array(raws, pa.binary())], ["vid", "label", "raw"])

    return map_batches(rows.select(id_of("vec_id").alias("vid"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")), checked, "vid long, label string, raw binary")


def cells(nodes: DataFrame, cosine: float) -> DataFrame:
    """(label, dims, block, cell, home, rep, n, raw): each node in its own cell of every block and in those it visits."""
    budget = 2 - 2 * cosine

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            sizes = np.array([dims_of(r) for r in raws])
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                turned = unit(unpacked([raws[i] for i in at], int(dims))) @ rotation(int(dims))
                borders = splits(int(dims), BLOCKS)
                for block, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    reach = np.sqrt(budget * (b - a) / dims) + SLACK
                    lead = turned[:, a : min(b, a + GRID)]
                    low, high = np.floor((lead - reach) / (2 * reach)).astype(int), np.floor((lead + reach) / (2 * reach)).astype(int)
                    own = np.floor(lead / (2 * reach)).astype(int)
                    for corner in range(2 ** lead.shape[1]):
                        up = np.array([corner >> k & 1 for k in range(lead.shape[1])], bool)
                        cell = np.where(up, high, low)
                        new = (~up | (high > low)).all(1)  # where low and high are one cell it is listed once
                        who = at[new]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(pa.array(who)), pa.array(np.full(len(who), dims), pa.int32()), pa.array(np.full(len(who), block), pa.int32()), pa.array([",".join(map(str, c)) for c in cell[new].tolist()], pa.string()), pa.array((cell[new] == own[new]).all(1))]
                            + [batch.column(c).take(pa.array(who)) for c in ("rep", "n", "raw")],
                            ["label", "dims", "block", "cell", "home", "rep", "n", "raw"],
                        )

    return map_batches(nodes, spread, "label string, dims int, block int, cell string, home boolean, rep long, n long, raw binary")


KEY = ["label", "dims", "block", "cell"]


def tiles(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows dealt to tiles: (i, j) compares chunk i of a cell's own rows with chunk j of all its rows."""
    crowded = rows.groupBy(*KEY).agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    parts = F.ceil(F.col("size") / chunk).cast("int")
    dealt = rows.join(crowded.select(*KEY, parts.alias("k")), KEY, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("left"), F.lit(True).alias("right")))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    lefts = F.transform(F.when(F.col("home"), every).otherwise(F.array().cast("array<int>")), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    rights = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    return dealt.select(*KEY, F.explode(F.when(F.col("k") == 1, alone).otherwise(F.concat(lefts, rights))).alias("t"), "rep", "n", "raw").select(*KEY, "t.*", "rep", "n", "raw")


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that keep linked ids connected, at most one for each id."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def compare(block: int, dims: int, left: tuple, right: tuple, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weights linked to each left row, forest of links); left and right: (ids, weights, raw vectors)."""
    budget = 2 - 2 * cosine
    borders = splits(dims, BLOCKS)
    shares = budget * np.diff(borders) / dims + SLACK
    turn = rotation(dims)
    (lid, _, lraw), (rid, rn, rraw) = left, right
    lu, ru = unit(lraw), unit(rraw)
    lt, rt = lu @ turn, ru @ turn
    a, b = borders[block], borders[block + 1]
    lb, rb = lt[:, a:b].astype(np.float32), rt[:, a:b].astype(np.float32)
    r2 = (rb * rb).sum(1)
    sums = np.zeros(len(lid), np.int64)
    kept: dict[tuple[int, int], None] = {}
    first: dict[int, int] = {}
    step = max(1, (1 << 22) // max(1, len(rid)))
    for at in range(0, len(lid), step):
        part = lb[at : at + step]
        d2 = (part * part).sum(1)[:, None] + r2 - 2 * (part @ rb.T)
        ii, jj = np.nonzero(d2 <= shares[block] + 1e-5)
        ii += at
        for lo in range(0, len(ii), 1 << 16):
            i, j = ii[lo : lo + (1 << 16)], jj[lo : lo + (1 << 16)]
            gap = lt[i] - rt[j]
            gap *= gap
            each = np.add.reduceat(gap, borders[:-1], axis=1)
            mine = (each[:, block] <= shares[block]) & ~(each[:, :block] <= shares[:block]).any(1)
            i, j = i[mine], j[mine]
            real = ((lraw[i] * rraw[j]).sum(1) / (np.sqrt((lraw[i] ** 2).sum(1)) * np.sqrt((rraw[j] ** 2).sum(1))) >= cosine) & (lid[i] != rid[j])
            i, j = i[real], j[real]
            np.add.at(sums, i, rn[j])
            # Of a right row's links the first is kept, and of the others those between different first partners.
            for x, y in zip(lid[i].tolist(), rid[j].tolist(), strict=True):
                was = first.setdefault(y, x)
                kept[(was, x) if was != x else (x, y)] = None
            if len(kept) > 4 * (len(lid) + len(rid)):
                kept = dict.fromkeys(forest(kept))
    return sums, forest(kept)


def tile_links(cosine: float):
    """Reads rows sorted by tile; yields (a, b, links): sums with b null, and links of the forest with links null."""

    def table(rows: list[tuple]) -> tuple:
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), unpacked([r[2] for r in rows], dims_of(rows[0][2]))

    def solved(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        left, right = [r[2:] for r in rows if r[0]], [r[2:] for r in rows if r[1]]
        if not left or not right or (len(left) == 1 and len(right) == 1 and left[0][0] == right[0][0]):
            return None
        left = table(left)
        sums, links = compare(key[2], key[1], left, table(right), cosine)
        some = np.flatnonzero(sums)
        ids = [*left[0][some].tolist(), *(a for a, _ in links)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([None] * len(some) + [b for _, b in links], pa.int64()), pa.array(sums[some].tolist() + [None] * len(links), pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, "i", "j", "left", "right", "rep", "n", "raw")]
            for row in zip(*columns, strict=True):
                if row[:6] != key:
                    if held and (out := solved(key, held)) is not None:
                        yield out
                    key, held = row[:6], []
                held.append(row[6:])
        if held and (out := solved(key, held)) is not None:
            yield out

    return run


def near_vectors(rows: DataFrame, vector: str = "embedding", label: str = "label", cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; see the module for what links."""
    base = cut(prepared(rows, vector, label))
    nodes = cut(base.where("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("vid").alias("rep"), F.count("*").alias("n")))
    order = [*KEY, "i", "j"]
    dealt = tiles(cells(nodes, cosine), chunk).repartition(*order).sortWithinPartitions(*order)
    found = cut(map_batches(dealt, tile_links(cosine), "a long, b long, links long"))
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    group = nodes.join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    group = group.select(F.col("label").alias("__l"), F.col("raw").alias("__r"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = base.join(group, (F.col("label") == F.col("__l")) & (F.col("raw") == F.col("__r")), "left")
    component = F.coalesce("component", "vid")
    return out.select(null_id_back("vid").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), null_id_back(component).alias("component_id"), (F.col("vid") == component).alias("kept"))
