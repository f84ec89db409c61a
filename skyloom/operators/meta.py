"""Metadata tables: attributes, variables and the flattened time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.arrays import flattened

#: Labels of the metadata table and the attributes that they come from.
LABELS = {"units": "UNITS", "name": "LABLAXIS", "notes": "VAR_NOTES", "desc": "CATDESC", "plot": "LABL_PTR_1", "axis": "LABLAXIS", "scale": "SCALETYP", "min": "VALIDMIN", "max": "VALIDMAX", "fill": "FILLVAL"}


def attribute_pivot(attributes: DataFrame, key: str, attribute: str, value: str, names: list[str]) -> DataFrame:
    """One row for each variable, a column for each named attribute; the first entry in order of text where there are several."""
    return attributes.groupBy(key).agg(*(F.min(F.when(F.col(attribute) == n, F.col(value))).alias(n) for n in names))


def metadata(attributes: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """The metadata table: variable and one column for each label."""
    found = labels or LABELS
    return attributes.where("variable IS NOT NULL").groupBy("variable").agg(*(F.min(F.when(F.col("attribute") == a, F.col("value"))).alias(label) for label, a in found.items()))


def follow_pointer(attributes: DataFrame, pointer: str, values: DataFrame, name: str) -> DataFrame:
    """Attributes whose value names another variable, beside that variable's row."""
    return attributes.where(F.col("attribute") == pointer).join(values, F.col("value") == F.col(name))


def entries_with_numbers(attributes: DataFrame) -> DataFrame:
    return attributes.where(F.col("entry").isNotNull())


def attribute_counts(attributes: DataFrame) -> DataFrame:
    """(attribute, scope, n_entries, max_entry)."""
    return attributes.groupBy("attribute", "scope").agg(F.count("*").alias("n_entries"), F.max("entry").alias("max_entry"))


def time_name(columns: list[str]) -> str:
    """The variable named epoch in any case."""
    for c in columns:
        if c.strip().lower() == "epoch":
            return c
    raise ValueError("no variable is named epoch")


def epoch_groups(columns: list[str], depends: dict[str, str]) -> list[str]:
    """Columns by groups: each epoch first, then the variables that depend on it in their order; what depends on none comes last."""
    epochs = list(dict.fromkeys(e for c in columns if (e := depends.get(c)) in columns))
    out = [x for e in epochs for x in (e, *(c for c in columns if depends.get(c) == e and c not in epochs))]
    return [*out, *(c for c in columns if c not in out)]


def chosen_variables(columns: list[str], include: list[str] | None = None, exclude: list[str] | None = None, always: tuple[str, ...] = ("file", "rec")) -> list[str]:
    """Columns to keep: those included (all, if none are named) that are not excluded; a name that is missing is an error."""
    for n in (*(include or ()), *(exclude or ())):
        if n not in columns:
            raise KeyError(f"no variable named {n}")
    return [c for c in columns if c in always or ((include is None or c in include) and c not in (exclude or ()))]


def listed_names(text: str) -> list[str]:
    """Names of a list as text: apart by commas or line ends, quoted or not."""
    return [n.strip().strip("\"'") for line in text.splitlines() for n in line.split(",") if n.strip()]


def time_series(df: DataFrame, sizes: dict[str, int] | None = None, flatten: bool = True) -> DataFrame:
    """Epoch first, then all variables; 1-D ones (sizes by name) spread over columns unless flatten is off."""
    t = time_name(df.columns)
    out: list[Column] = [F.col(t).alias("Epoch")]
    for c in df.columns:
        if c in (t, "rec"):
            continue
        array = isinstance(df.schema[c].dataType, T.ArrayType)
        out += flattened(c, (sizes or {})[c]) if array and flatten and c in (sizes or {}) else [F.col(c)]
    return df.select(*out)


def vertical(df: DataFrame, rec: str, variables: list[str]) -> DataFrame:
    """(rec, variable, value) rows: the vertical text layout."""
    return df.select(rec, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables))).alias("x")).select(rec, "x.*")


def enumerated(df: DataFrame, rec: str, variable: str) -> DataFrame:
    """(rec, index, value) of an array variable."""
    return df.select(rec, F.posexplode(variable).alias("index", "value"))
