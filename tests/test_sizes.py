"""Keys and files of sizes that the small tables do not have."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from skyloom.plans import codes
from skyloom.sources import files, layout, packing


def test_products_of_large_keys_wrap(spark):
    keys = [(1, 1), (1_024_000, 7), (1_024_001, 7), (1_199_999, 59_999), (2**63 - 1, 2**63 - 1), (-(2**63), -(2**63)), (None, 1)]
    rows = spark.createDataFrame([(i, 1, p, s) for i, (p, s) in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    found = {r.l_orderkey: (r.i8, r.big) for r in codes.int8_conversion(rows).collect()}
    wrapped = lambda n: (n + 2**63) % 2**64 - 2**63
    assert found == {i: (None, None) if p is None else (wrapped((p * 1000 + s) * 9007199254740993), wrapped(p * 9007199254740)) for i, (p, s) in enumerate(keys)}


@pytest.mark.parametrize("sparse", [0, 2])
def test_packed_blocks_are_unpacked_once(monkeypatch, sparse):
    """Ranges that follow one another take the work of the whole, whatever the packing, also in gaps that the record before fills."""
    x, w = np.random.default_rng(1).normal(size=1000), layout.Writer()
    runs = [(0, 399), (450, 999)] if sparse else [(0, 999)]
    for kind in (1, 2, 3, 5):
        w.variable(f"v{kind}", "REAL8", x[: sum(b - a + 1 for a, b in runs)], compression=kind, sparse=sparse, runs=runs)
    file, calls, unpacked = layout.File(w.build()), [], layout.unpacked
    monkeypatch.setattr(layout, "unpacked", lambda *args: calls.append(args[0]) or unpacked(*args))
    names = list(file.variables)
    parts = list(files.batches_of(file, "p", names, [pa.float64()] * len(names), step=10))
    want = np.concatenate([x[:400], np.full(50, x[399]), x[400:950]]) if sparse else x
    assert sorted(calls) == sorted([1, 2, 3, 5] * len(runs))
    for n in names:
        assert np.array_equal(np.concatenate([p.column(n).to_numpy() for p in parts]), want)


@pytest.mark.parametrize("piece", [600, 1 << 16])
def test_packings_across_pieces(monkeypatch, piece):
    """Codes of over 16 bits, runs and pieces that end inside codes; the bytes of the adaptive tree are those of the plain one that searches its nodes."""
    monkeypatch.setattr(packing, "PIECE", piece)
    r, counts = np.random.default_rng(2), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233] + [254] * 244
    assert max(map(len, packing.codes_of(dict(enumerate(counts)) | {packing.END: 1}).values())) > 16
    rare = r.permutation(np.repeat(np.arange(len(counts), dtype=np.uint8), counts))
    for data in (b"", b"\0", bytes(range(256)), rare.tobytes(), r.normal(size=5000).tobytes(), bytes(70_000)):
        for kind in (1, 2, 3, 5):
            assert packing.unpacked(kind, packing.packed(kind, data)) == data
    with pytest.raises(packing.PackingError):
        packing.unpacked(2, packing.packed(2, rare.tobytes())[:-3])
    with pytest.raises(packing.PackingError):
        packing.unpacked(3, packing.packed(3, rare.tobytes())[:-3])
    assert hashlib.sha256(packing.packed(3, rare.tobytes())).hexdigest() == "83d6018c8f47387ca3660e1c95668e57759a47cd6bee5c10b54d84717eaa2d69"


def test_lists_are_stacked():
    """As numpy makes arrays of them, also in chunks, slices and with gaps."""
    for x in (np.arange(12.0).reshape(6, 2), np.arange(24).reshape(2, 3, 4), np.zeros((3, 0)), np.zeros((0, 2))):
        lists = pa.chunked_array([pa.array(x.tolist(), pa.list_(pa.float32()) if x.ndim == 2 else pa.list_(pa.list_(pa.int64())))])
        found = files.stacked(pa.chunked_array([*lists.chunks, *lists.slice(0, 1).chunks]), "f8")
        want = np.array(x.tolist() + x[:1].tolist(), "f8")
        assert found.shape == want.shape and np.array_equal(found, want)
    sliced = pa.chunked_array([pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0], [9.0, 9.0]])]).slice(1, 2)
    assert files.stacked(sliced, "f4").tolist() == [[1, 2], [3, 4]]
    gaps = files.stacked(pa.chunked_array([pa.array([[1.0, None], [3.0, 4.0]])]), "f8")
    assert np.isnan(gaps[0, 1]) and gaps[1].tolist() == [3, 4]
    with pytest.raises(ValueError):
        files.stacked(pa.chunked_array([pa.array([[1.0], [3.0, 4.0]])]), "f8")
