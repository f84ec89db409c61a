"""Packings, versions, text forms and single opened files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import files, packing, text
from skyloom.sources.layout import File, FormatError, Writer, changed, vax_floats
from skyloom.sources.opened import Opened
from tests.test_sources import sample


@pytest.mark.parametrize("kind", [1, 2, 3, 5])
def test_packings(kind):
    rng = random.Random(kind)
    skewed = bytes(min(255, int(rng.expovariate(0.1))) for _ in range(40_000))
    for data in (b"", b"a", b"\0", bytes(700) + b"abc\0d", bytes(range(256)) * 3, skewed):
        assert packing.unpacked(kind, packing.packed(kind, data)) == data


@pytest.mark.parametrize(("kind", "data"), [(1, b"abc\0"), (2, b"\x05\x09\x01"), (2, b""), (3, b""), (5, b"not gzip"), (9, b"")])
def test_broken_packings(kind, data):
    with pytest.raises(packing.PackingError):
        packing.unpacked(kind, data)


def test_huffman_codes_take_the_lighter_and_older_first():
    # 1 and the end symbol are joined to 3, then 2 and 3 to 5, then 5 and 5, of which the symbol is older.
    assert packing.codes_of({0: 5, 1: 2, 2: 2, packing.END: 1}) == {0: "0", 2: "10", packing.END: "110", 1: "111"}


def test_old_versions_and_variables_of_one_shape():
    w = Writer(row_major=False, little=False, version=2, rdims=(2, 3))
    grid = np.arange(24.0).reshape(4, 2, 3)
    w.variable("grid", "REAL4", grid, is_r=True, compression=2)
    w.variable("line", "INT4", grid[:, :, 0].astype(int), is_r=True, dim_varies=(True, False))
    w.attribute("UNITS", "nT", "CHAR", "line")
    f = File(w.build())
    assert f.version[0] == 2 and f.rdims == (2, 3) and (f.read("grid") == grid).all()
    assert (f.read("line") == grid[:, :, 0]).all() and f.read("line", expand=True).shape == (4, 2, 3)
    assert files.attributes_of(f) == {"line": {"UNITS": "nT"}} and all(fits for *_, fits in f.links())
    with pytest.raises(ValueError):
        w.variable("bad\n", "INT4", [1])


def test_whole_packed_files_have_a_checksum():
    for kind in (1, 2, 3, 5):
        f = File(changed(File(sample()), packing=kind, checksum=True))
        assert f.packing == kind and f.verified() and f.read("gaps").tolist() == [1, -9, -9, 2, 3]


def test_blocks_of_a_size():
    w = Writer()
    w.variable("x", "INT2", np.arange(10), block=4)
    f = File(w.build())
    assert [(a, b) for a, b, _ in f.variables["x"].blocks] == [(0, 3), (4, 7), (8, 9)] and f.read("x", 3, 8).tolist() == [3, 4, 5, 6, 7, 8]


def test_vax_floats():
    one, minus, pi = b"\x80\x40\0\0", b"\x80\xc0\0\0", b"\x49\x41\xdb\x0f"
    assert vax_floats(one + minus + b"\0\0\0\0", 4, False).tolist() == [1.0, -1.0, 0.0]
    assert vax_floats(pi, 4, False)[0] == np.float32(np.pi)
    assert vax_floats(b"\x10\x40" + bytes(6), 8, True).tolist() == [1.0] and vax_floats(b"\x80\x40" + bytes(6), 8, False).tolist() == [1.0]


def test_broken_blocks_name_the_reason(spark, tmp_path):
    data = bytearray(sample(checksum=False))
    f = File(bytes(data))
    at = f.variables["flux"].blocks[0][2]
    data[at + 24 : at + 24 + f.p(at, "CVVR", "size")] = b"a" * (f.p(at, "CVVR", "size") - 1) + b"\0"
    (tmp_path / "a.bin").write_bytes(bytes(data))
    with pytest.raises(FormatError):
        File(bytes(data)).read("flux")
    assert "zeros" in files.validate(spark, str(tmp_path)).where("NOT ok").first()["reason"]


def test_files_that_differ(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(sample())
    w = Writer()
    w.variable("Epoch", "EPOCH", [1.0, 2.0])
    (tmp_path / "b.bin").write_bytes(w.build())
    rows = files.read(spark, str(tmp_path), ["Epoch", "year"]).where("file LIKE '%b.bin'").collect()
    assert [(r["Epoch"], r["year"]) for r in rows] == [(1.0, None), (2.0, None)]
    w = Writer()
    w.variable("year", "INT2", [[1, 2]])
    (tmp_path / "c.bin").write_bytes(w.build())
    with pytest.raises(Exception, match="c.bin"):
        files.read(spark, str(tmp_path), ["year"]).collect()
    assert files.read(spark, str(tmp_path / "a.bin"), exclude=["image"]).columns.count("image") == 0
    assert [r["rec"] for r in files.in_order(files.read(spark, str(tmp_path / "a.bin"), ["Epoch"]))] == [0, 1, 2, 3, 4]


def test_only_one_file_is_read_for_the_schema(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(sample())
    (tmp_path / "b.bin").write_bytes(b"this is no such file")
    assert "year" in files.read(spark, str(tmp_path), ["year"]).columns
    plan = files.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_opened(spark, tmp_path):
    path = str(tmp_path / "one.bin")
    (tmp_path / "one.bin").write_bytes(sample())
    with Opened(spark, path) as f:
        assert f["year"].attrs["FILLVAL"] == 65535 and f["year"][...][0] == 65535 and f["year"][1] == 1
        assert "CDF filename :" in repr(f["year"]) and "CDF variable name: year" in repr(f["year"])
        assert f.data["label"].tolist() == ["ab", "c"] and f.inquire()["num_z_vars"] == 9 and "none" not in f
        with pytest.raises(KeyError):
            f["none"]
        series, meta = f.to_frames()
        assert series.columns[0] == "Epoch" and "flux_end" in series.columns and series.count() == 5
        assert meta.where("variable = 'year'").first()["fill"] == "65535"


def test_skeletons_come_back(spark, tmp_path):
    f = File(sample(checksum=False))
    back = File(text.read_skeleton(text.write_skeleton(f, "x", "all")).build())
    assert {n: (v.type, v.dims, v.record_varies) for n, v in back.variables.items()} == {n: (v.type, v.dims, v.record_varies) for n, v in f.variables.items()}
    assert files.attributes_of(back) == files.attributes_of(f) and back.attributes[0].entries == f.attributes[0].entries
    assert all((back.read(n) == f.read(n)).all() for n in ("image", "flux", "label", "site", "tt", "Epoch"))
    (tmp_path / "a.bin").write_bytes(sample())
    assert "#GLOBALattributes" in files.skeleton(spark, str(tmp_path))


SKELETON = '''
#header
   DATA ENCODING: NETWORK
        MAJORITY: COLUMN
! Variables  G.Attributes  V.Attributes  Records  Dims  Sizes
   1/1  1  2  1/z  2  2 2
#GLOBALattributes
  "TITLE"  1:  CDF_CHAR { "One " -
                          "title" }
           2:  CDF_CHAR { "More" } .
#VARIABLEattributes
  "VALIDMIN"
#variables
  "grid"  CDF_INT4  1  F  T T
    "VALIDMIN" CDF_INT4 { 1, 2 } .
    [1,1] = 5  ! a remark
    [2,2] = 7
#zVariables
  "Epoch" CDF_EPOCH 1 0 T
    "VALIDMIN" CDF_EPOCH { 08-Sep-1992 00:00:00.000 } .
    1:[] = { 01-Jan-2000 00:00:00.500 }
#end
'''


def test_skeleton_text():
    f = File(text.read_skeleton(SKELETON).build())
    assert f.attributes[0].entries == [("g", 0, "CHAR", "One title"), ("g", 1, "CHAR", "More")]
    assert f.read("grid").tolist() == [[[5, 0], [0, 7]]] and files.attributes_of(f)["grid"]["VALIDMIN"] == [1, 2]
    assert f.read("Epoch").tolist() == [63113904000500.0] and not f.row_major
    with pytest.raises(FormatError):
        text.read_skeleton('#zVariables\n "x" CDF_NONE 1 0 T')


XML = '''<CDF name="x"><cdfFileInfo majority="ROW" encoding="IBMPC"/>
<cdfGAttributes><attribute name="TITLE"><entry entryNum="0" cdfDatatype="CDF_CHAR">a title</entry></attribute></cdfGAttributes>
<cdfVariables>
<variable name="a"><cdfVarInfo cdfDatatype="CDF_INT2" dim="1" dimSizes="3" dimVariances="VARY" numElements="1" recVariance="VARY" sparseRecords="PAD" padValue="-7"/>
<cdfVAttributes><attribute name="UNITS"><entry cdfDatatype="CDF_CHAR">nT</entry></attribute></cdfVAttributes>
<cdfVarData><record recNum="0"> 10 20 30</record><record recNum="2"><element index="1">5</element></record></cdfVarData></variable>
<variable name="s"><cdfVarInfo cdfDatatype="CDF_CHAR" dim="1" dimSizes="2" dimVariances="VARY" numElements="5" recVariance="NOVARY"/>
<cdfVarData><record elementDelimiter="@~">@~one@~ @~two@~</record></cdfVarData></variable>
<variable name="Epoch"><cdfVarInfo cdfDatatype="CDF_EPOCH" dim="0" numElements="1" recVariance="VARY" compression="GZIP.5"/>
<cdfVarData><record>01-Jan-2000 00:00:00.000</record></cdfVarData></variable></cdfVariables></CDF>'''


def test_xml():
    f = File(text.read_xml(XML).build())
    assert f.read("a").tolist() == [[10, 20, 30], [-7, -7, -7], [-7, 5, -7]] and files.attributes_of(f)["a"] == {"UNITS": "nT"}
    assert f.read("s").tolist() == [[b"one", b"two"]] and f.read("Epoch").tolist() == [63113904000000.0] and f.variables["Epoch"].compression == 5
    with pytest.raises(FormatError):
        text.read_xml("<CDF>")


def test_files_are_written_by_the_tasks(spark, tmp_path):
    df = spark.range(20).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.col("id").alias("rec"), F.when(F.col("id") != 4, F.col("id") * 1.5).alias("x"), F.lit(None).cast("string").alias("s"))
    out = str(tmp_path / "out")
    files.save_files(files.written(df, {"x": "REAL8", "s": "CHAR"}, compression={"x": 2}), out)
    assert files.file_info(spark, out).count() == 3
    values = [r["x"] for r in files.read(spark, out, ["x"]).collect()]
    assert len(values) == 20 and values.count(-1e30) == 1 and sum(v for v in values if v > -1) == 1.5 * (190 - 4)


def test_time_codes(spark):
    from skyloom.functions import time as T

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = lambda *x: [F.lit(v) for v in x]
    assert one(T.parse_tt2000(F.lit("31-DEC-2008 23:59:60.500000000"))) == one(T.parse_tt2000(F.lit("2008-12-31T23:59:60.500000000")))
    assert one(T.compute_tt2000(*lit(2008, 12, 31, 23, 59, 60))) == one(T.parse_tt2000(F.lit("2008-12-31T23:59:60")))
    assert one(T.compute_tt2000(*lit(2000.0, 1.0, 1.5))) == one(T.compute_tt2000(*lit(2000, 1, 1, 12)))
    assert one(T.compute_tt2000(*lit(2000.5, 1, 1))) == T.ILLEGAL_TT and one(T.compute_tt2000(*lit(2000, 1, 1, -1))) == T.ILLEGAL_TT
    assert one(T.compute_tt2000(*lit(2300, 1, 1))) == T.ILLEGAL_TT
    assert one(T.tt2000_breakdown(T.compute_tt2000(*lit(2016, 12, 31, 23, 59, 60, 1, 2, 3)))).asDict() == {"year": 2016, "month": 12, "day": 31, "hour": 23, "minute": 59, "second": 60, "msec": 1, "usec": 2, "nsec": 3}
    for k, s in enumerate(("31-DEC-9999 23:59:59.999999999", "99991231.9999999999", "99991231235959", "9999-12-31T23:59:59.999999999")):
        assert one(T.parse_tt2000(F.lit(s))) == T.FILL_TT, k
    assert one(T.parse_tt2000(F.lit("0000-01-01T00:00:00.000000000"))) == T.PAD_TT
    leap = T.tt2000_to_epoch16(T.parse_tt2000(F.lit("2016-12-31T23:59:60.25")))
    assert one(T.encode_epoch16(leap, 4)) == "2017-01-01T00:00:00.250000000000"
    assert one(T.encode_epoch16(F.struct(F.lit(-1e31).alias("sec"), F.lit(-1e31).alias("psec")), 1)) == "99991231.999999999999999"
    assert one(T.parse_epoch16(F.lit("99991231.999999999999999"), 1))["sec"] == -1e31
    assert one(T.compute_epoch16(*lit(9999, 12, 31, 23, 59, 59, 999, 999, 999, 999)))["psec"] == -1e31


def test_another_leap_table(spark):
    from skyloom.functions import time as T

    assert T.read_leap_table("; a remark\n2016 1 1 36.0 0.0 0.0\n2017 1 1 37.0") == ((2016, 1, 1, 36.0, 0.0, 0.0), (2017, 1, 1, 37.0, 0.0, 0.0))
    try:
        T.use_leap_table((*T.LEAP_TABLE, (2020, 1, 1, 38.0, 0.0, 0.0)))
        late = F.lit("2021-01-01").cast("timestamp_ntz")
        found = spark.range(1).select(T.leap_seconds(late).alias("a"), T.tt2000_to_timestamp(T.tt2000_of(late)).cast("string").alias("b")).first()
        assert (found["a"], found["b"]) == (38.0, "2021-01-01 00:00:00")
    finally:
        T.use_leap_table()
    assert spark.range(1).select(T.leap_seconds(F.lit("2021-01-01").cast("timestamp_ntz"))).first()[0] == 37.0


def test_master_attributes_and_lists(spark):
    from skyloom.operators import filters, merge, meta

    assert merge.master_attributes('! remark\n"TITLE" 2: CDF_CHAR { "a b" } .\nProject = ISTP\n') == [("TITLE", 2, "a b"), ("Project", 1, "ISTP")]
    assert meta.listed_names('"a", b\n c') == ["a", "b", "c"]
    with pytest.raises(KeyError):
        meta.chosen_variables(["a"], ["b"])
    assert filters.monotonic_range({"MONOTON": "INCREASE"}, 1, None) and not filters.monotonic_range({}, 1, 2)


def test_metadata_is_edited():
    f = File(sample(checksum=False))
    edit = {("year", "FILLVAL"): None, (None, "Title"): ("CHAR", "another"), ("flux", "UNITS"): ("CHAR", "nT")}
    g = File(changed(f, edit=edit, rename={"year": "Year", "RANGE": "SPAN"}, pads={"gaps": -5.0}))
    assert files.attributes_of(g) == {"flux": {"SPAN": [1.0, 2.0], "UNITS": "nT"}} and g.attributes[0].entries == [("g", 0, "CHAR", "another")]
    assert "Year" in g.variables and "year" not in g.variables and g.read("gaps").tolist() == [1, -5, -5, 2, 3]
