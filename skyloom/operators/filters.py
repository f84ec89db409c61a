"""Record, range and element filters of an export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.arrays import passes


@dataclass(frozen=True)
class Range:
    """Bounds of a variable; the fill value always passes."""

    low: float | None = None
    high: float | None = None
    fill: float | None = None
    inclusive: bool = True

    def test(self, v: Column) -> Column:
        return passes(v, self.low, self.high, self.fill, self.inclusive)

    @classmethod
    def of_attributes(cls, attributes: dict, use_valid: bool = True, use_fill: bool = True) -> Range:
        """Default bounds from VALIDMIN, VALIDMAX and FILLVAL."""
        get = attributes.get
        return cls(get("VALIDMIN") if use_valid else None, get("VALIDMAX") if use_valid else None, get("FILLVAL") if use_fill else None)


def record_range(df: DataFrame, rec: str, low: int, high: int, inclusive: bool = True) -> DataFrame:
    c = F.col(rec)
    return df.where((c >= low) & (c <= high) if inclusive else (c > low) & (c < high))


def record_stride(df: DataFrame, rec: str, start: int, count: int, interval: int = 1) -> DataFrame:
    """Records start, start + interval, ... (count of them)."""
    c = F.col(rec)
    return df.where((c >= start) & (c < start + count * interval) & ((c - start) % interval == 0))


def where_in_range(df: DataFrame, ranges: dict[str, Range]) -> DataFrame:
    """Drops each record of which a filtered scalar fails; one predicate, so simple bounds reach the scan."""
    for name, r in ranges.items():
        df = df.where(r.test(F.col(name)))
    return df


def epoch_range(df: DataFrame, time: str, first, last) -> DataFrame:
    """Both ends inclusive, every row tested."""
    return df.where(F.col(time).between(first, last))


def group_mask(df: DataFrame, ranges: dict[str, Range], outputs: dict[str, float]) -> DataFrame:
    """Where one filtered variable fails, all output variables show their fill value."""
    ok = F.lit(True)
    for name, r in ranges.items():
        ok = ok & r.test(F.col(name))
    return df.withColumns({name: F.when(ok, F.col(name)).otherwise(F.lit(fill)) for name, fill in outputs.items()})


def group_mask_arrays(df: DataFrame, ranges: dict[str, Range], outputs: dict[str, float]) -> DataFrame:
    """group_mask() element by element, for array variables of one shape."""
    first = next(iter(ranges))
    ok = F.transform(F.col(first), lambda v: ranges[first].test(v))
    for name, r in ranges.items():
        if name != first:
            ok = F.zip_with(ok, F.transform(F.col(name), r.test), lambda a, b: a & b)
    return df.withColumn("__ok", ok).withColumns({name: F.zip_with(F.col(name), F.col("__ok"), _shown(fill)) for name, fill in outputs.items()}).drop("__ok")


def _shown(fill: float):
    return lambda v, a: F.when(a, v).otherwise(F.lit(fill))


def quality_pairs(variables: list[str], attributes: DataFrame) -> dict[str, str]:
    """Variable -> the variable with its flags, by a table (variable, attribute, value).

    X is paired with Xq (else XQ) whose COMPONENT_0 is X; COMPONENT_1 names the flags.
    """
    rows = attributes.where(F.col("attribute").isin("COMPONENT_0", "COMPONENT_1")).select("variable", "attribute", F.trim("value").alias("value")).collect()
    found = {(r["variable"], r["attribute"]): r["value"] for r in rows}
    out = {}
    for v in variables:
        for q in (f"{v}q", f"{v}Q"):
            if q in variables:  # the first of the two names that exists decides
                if found.get((q, "COMPONENT_0")) == v and found.get((q, "COMPONENT_1")) in variables:
                    out[v] = found[q, "COMPONENT_1"]
                break
    return out


def quality_checked(df: DataFrame, attributes: DataFrame, fills: dict[str, float], good=0) -> DataFrame:
    """df with the fill value wherever a variable's paired flag is not good."""
    pairs = quality_pairs(df.columns, attributes)
    return df.withColumns({v: flagged(F.col(v), F.col(flag), fills[v], good) for v, flag in pairs.items() if v in fills})


def compared(a: Column, b: Column, operator: str, kind: str = "REAL8") -> Column:
    """EQ, NE, LT, LE, GT or GE of two values of a type.

    Equality goes by the bytes, so -0.0 is not 0.0; EPOCH16 (structs sec, psec) is
    ordered by seconds, then picoseconds; order with NaN is false.
    """
    if kind == "EPOCH16":
        less = (a["sec"] < b["sec"]) | ((a["sec"] == b["sec"]) & (a["psec"] < b["psec"]))
        same = (a["sec"] == b["sec"]) & (a["psec"] == b["psec"])
        real = F.lit(True)
    elif kind in ("REAL4", "REAL8", "FLOAT", "DOUBLE", "EPOCH"):
        sign = lambda x: F.when(x == 0, x.cast("string") == "-0.0").otherwise(F.lit(False))
        same = (a == b) & (sign(a) == sign(b))
        real = ~F.isnan(a) & ~F.isnan(b)
        less = a < b
        if operator in ("LE", "GE"):
            same = a == b
    else:
        less, same, real = a < b, a == b, F.lit(True)
    tests = {"EQ": same, "NE": ~same, "LT": real & less, "LE": real & (less | same), "GT": real & ~less & ~(a == b if kind != "EPOCH16" else same), "GE": real & ~less}
    return tests[operator]


def monotonic_range(attributes: dict, low, high) -> bool:
    """Whether a MONOTON attribute allows records to be cut at the first and last value in [low, high] (see monotonic_prune)."""
    return str(attributes.get("MONOTON", "")).strip().upper() in ("INCREASE", "DECREASE") and (low is not None or high is not None)


def monotonic_prune(blocks: DataFrame, scalar: str, low, high) -> DataFrame:
    """The blocks (with columns {scalar}_first and {scalar}_last, the values at both ends) of a monotonic scalar that can hold values in [low, high]."""
    first, last = F.col(f"{scalar}_first"), F.col(f"{scalar}_last")
    least, most = F.least(first, last), F.greatest(first, last)
    test = F.lit(True)
    if low is not None:
        test = test & (most >= low)
    if high is not None:
        test = test & (least <= high)
    return blocks.where(test)


def flagged(value: Column, flag: Column, fill: float, good=0) -> Column:
    """A value where its quality flag is good, else fill."""
    return F.when(flag == good, value).otherwise(F.lit(fill))


def first_match(df: DataFrame, rec: str, test: Column) -> DataFrame:
    """The first record that passes."""
    return df.where(test).orderBy(rec).limit(1)


def passing_runs(df: DataFrame, rec: str, test: Column, by: list[str]) -> DataFrame:
    """(by, first_rec, last_rec, n_recs) of each run of passing records with consecutive numbers."""
    hits = df.where(test).select(*by, F.col(rec).alias("r")).withColumn("island", F.col("r") - F.row_number().over(Window.partitionBy(*by).orderBy("r")))
    return hits.groupBy(*by, "island").agg(F.min("r").alias("first_rec"), F.max("r").alias("last_rec"), F.count("*").alias("n_recs")).drop("island")
