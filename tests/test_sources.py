import gzip

import numpy as np
import pytest

from skyloom.operators.meta import time_series
from skyloom.sources import files
from skyloom.sources.layout import CCR, MAGIC, PACKED, File, FormatError, Writer, rle, unrle


def sample(row_major=True, little=True, checksum=True) -> bytes:
    w = Writer(row_major, little, checksum)
    w.variable("Epoch", "EPOCH", np.arange(5) * 1000.0 + 6.3e13)
    w.variable("image", "INT2", np.arange(60).reshape(5, 3, 4), compression=5)
    w.variable("flux", "REAL4", np.arange(10).reshape(5, 2), compression=1)
    w.variable("gaps", "REAL8", [1.0, 2.0, 3.0], sparse=1, runs=[(0, 0), (3, 4)], pad=-9.0)
    w.variable("held", "INT4", [1, 2], sparse=2, runs=[(0, 0), (3, 3)])
    w.variable("year", "UINT2", [65535, 1])
    w.variable("tt", "TIME_TT2000", [0, 1])
    w.variable("label", "CHAR", ["ab", "c "])
    w.variable("site", "CHAR", ["north"], varies=False)
    w.attribute("Title", "a file", "CHAR")
    w.attribute("FILLVAL", 65535, "UINT2", "year")
    w.attribute("RANGE", [1.0, 2.0], "REAL8", "flux")
    return w.build()


@pytest.mark.parametrize("row_major", [True, False])
@pytest.mark.parametrize("little", [True, False])
def test_round_trip(row_major, little):
    f = File(sample(row_major, little))
    assert f.verified()
    assert (f.read("image") == np.arange(60).reshape(5, 3, 4)).all()
    assert f.read("gaps").tolist() == [1, -9, -9, 2, 3]
    assert f.read("held").tolist() == [1, 1, 1, 2]
    assert f.read("held", 1, 2).tolist() == [1, 1]
    assert f.read("image", 2, 3).tolist() == np.arange(60).reshape(5, 3, 4)[2:4].tolist()


def test_rle():
    data = b"\0" * 600 + b"abc" + b"\0" + b"d"
    assert unrle(rle(data)) == data


def test_whole_file_compression():
    plain = sample(checksum=False)
    body = gzip.compress(plain[8:])
    size = 32 + len(body)
    ccr = size.to_bytes(8, "big") + CCR.to_bytes(4, "big") + (8 + size).to_bytes(8, "big") + (len(plain) - 8).to_bytes(8, "big") + bytes(4) + body
    cpr = (28).to_bytes(8, "big") + (11).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes(4) + (1).to_bytes(4, "big") + (6).to_bytes(4, "big")
    assert File(MAGIC + PACKED + ccr + cpr).read("tt").tolist() == [0, 1]


def test_broken_files():
    with pytest.raises(FormatError):
        File(b"nothing")
    data = bytearray(sample())
    data[16:20] = (77).to_bytes(4, "big")
    with pytest.raises(FormatError):
        File(bytes(data))


def test_dataframes(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"f{i}.bin").write_bytes(sample())
    df = files.read(spark, str(tmp_path), ["Epoch", "year", "image", "label", "site"])
    assert df.count() == 10
    row = df.where("rec = 0").first()
    assert (row["year"], row["label"], row["site"], row["image"][1]) == (65535, "ab", "north", [4, 5, 6, 7])
    assert df.where("rec = 4").first()["year"] is None
    assert df.schema["year"].metadata["FILLVAL"] == 65535
    assert files.read(spark, str(tmp_path), ["Epoch"], (1, 2)).count() == 4
    assert time_series(files.read(spark, str(tmp_path / "f0.bin"), ["Epoch", "flux"]).drop("file"), {"flux": 2}).columns == ["Epoch", "flux", "flux_end"]
    with pytest.raises(KeyError):
        files.read(spark, str(tmp_path), ["none"])


def test_tables(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(sample())
    path = str(tmp_path)
    info = files.file_info(spark, path).first()
    assert (info["majority"], info["n_z"], info["max_rec"], info["verified"]) == ("ROW", 9, 4, True)
    assert files.variables(spark, path).where("name = 'image'").first()["dims"] == [3, 4]
    assert files.attributes(spark, path).where("variable = 'year'").first()["value"] == "65535"
    assert files.blocks(spark, path).where("name = 'gaps'").count() == 2
    assert files.validate(spark, path).where("NOT ok").count() == 0
    assert "#variables" in files.skeleton(spark, path)
    (tmp_path / "bad.bin").write_bytes(b"bad")
    assert files.validate(spark, path).where("NOT ok").count() == 1


def test_data_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(sample())
    spark.dataSource.register(files.ScienceFiles)
    df = spark.read.format("scifile").option("variables", "Epoch,held").option("recordRange", "1-3").load(str(tmp_path / "a.bin"))
    assert [r["held"] for r in df.orderBy("rec").collect()] == [1, 1, 2]
