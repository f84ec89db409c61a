import pytest
from pyspark.sql import functions as F

from skyloom.operators import filters, merge, meta, records, stats


def test_group_mask_arrays(spark):
    df = spark.createDataFrame([([1.0, 5.0], [10.0, 20.0])], "a array<double>, b array<double>")
    out = filters.group_mask_arrays(df, {"a": filters.Range(0, 2)}, {"a": -1.0, "b": -2.0}).first()
    assert (out["a"], out["b"]) == ([1.0, -1.0], [10.0, -2.0])


def test_nan_and_fill_in_stats(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (-1e31,), (None,), (5.0,)], "v double")
    r = stats.value_stats(df, "v", low=2.0, fill=-1e31).first()
    assert (r["n_values"], r["min_value"], r["n_low"], r["n_fill"], r["n_nan"]) == (2, 5.0, 1, 1, 1)


@pytest.mark.parametrize(("values", "name"), [([1], "Steady (one value)"), ([1, 1], "Steady (all values the same)"), ([1, 2, 3], "Increase"), ([3, 2], "Decrease"), ([1, 1, 2], "noDecrease"), ([2, 1, 1], "noIncrease"), ([1, 2, 1], "False"), ([], "n/a (all fill values)")])
def test_whole_monotonicity(spark, values, name):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "o long, v double")
    assert stats.monotonicity_whole(df, "v", "o").first()["monoton"] == name


def test_attribute_updates(spark):
    df = spark.createDataFrame([(1.0, 2.0, "Increase")], "min_value double, max_value double, monoton string")
    assert {(r["attribute"], r["value"]) for r in stats.attribute_updates(df, "x").collect()} >= {("VALIDMIN", "1.0"), ("MONOTON", "INCREASE")}


def test_record_errors(spark):
    df = spark.range(3).withColumnRenamed("id", "rec")
    with pytest.raises(ValueError):
        records.insert_records(df, df, "rec", 1, sparse=True)
    with pytest.raises(ValueError):
        records.with_constants(df, df)
    kept = records.delete_records(df, "rec", 1, 1, renumber=False)
    assert sorted(r["rec"] for r in kept.collect()) == [0, 2]


def test_joined_names(spark):
    a = spark.createDataFrame([(0, 1, 5)], "rec long, x int, Epoch int")
    with pytest.raises(ValueError):
        merge.joined([a, a], "rec")
    assert merge.joined([a.select("rec", "Epoch"), a], "rec", ("Epoch",)).columns == ["rec", "Epoch", "x"]


def test_metadata_helpers(spark):
    rows = spark.createDataFrame([("v", "UNITS", "nT", "VARIABLE", 0), ("v", "FILLVAL", "-1", "VARIABLE", 0), (None, "Title", "t", "GLOBAL", 2)], "variable string, attribute string, value string, scope string, entry int")
    assert meta.metadata(rows).select("units", "fill").first() == ("nT", "-1")
    assert meta.attribute_counts(rows).where("attribute = 'Title'").first()["max_entry"] == 2
    other = spark.createDataFrame([("v", "UNITS", "T", "VARIABLE", 0)], rows.schema)
    assert merge.override_attributes(rows, other, ["variable", "attribute"], "value").where("attribute = 'UNITS'").first()["value"] == "T"
    named = merge.rename_pointers(spark.createDataFrame([("time_series>y=flux",)], "value string"), "value", ["flux"], "a")
    assert named.first()["value"] == "time_series>y=a_flux"
    with pytest.raises(ValueError):
        meta.time_name(["a"])
    assert merge.compare_schemas(spark.createDataFrame([("a", "REAL8")], "name string, type string"), spark.createDataFrame([("a", "EPOCH")], "name string, type string")).first()["same_type"]


def test_alignment_and_flags(spark):
    a, b = spark.range(3).select(F.col("id").alias("rec"), F.lit(1).alias("x")), spark.range(2).select(F.col("id").alias("rec"), F.lit(2).alias("y"))
    assert records.aligned(a, b, "rec").where("y IS NULL").count() == 1
    assert spark.range(1).select(filters.flagged(F.lit(3.0), F.lit(1), -1.0)).first()[0] == -1.0
