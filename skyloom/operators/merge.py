"""Merging and comparing files given as DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.values import differs, type_class


def append_records(parts: list[DataFrame], rec: str) -> DataFrame:
    """Records of same-named variables one after another; each part starts where the one before ended, an empty one takes no place."""
    out, base = parts[:1], 0
    # One aggregate over all parts finds where each begins.
    ends = reduce(DataFrame.unionByName, (p.select(F.lit(i).alias("part"), F.col(rec).cast("long").alias("last")) for i, p in enumerate(parts))).groupBy("part").agg(F.max("last").alias("last")).collect()
    last = {r["part"]: r["last"] for r in ends}
    for i, part in enumerate(parts[1:], 1):
        base += 0 if last.get(i - 1) is None else last[i - 1] + 1
        out.append(part.withColumn(rec, F.col(rec) + base))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def prefixed_name(name: str, prefix: str | None, index: int) -> str:
    """prefix_name, or file{index}_name; a name that is fileK_rest already becomes file{index + K - 1}_rest."""
    if prefix is not None:
        return f"{prefix}_{name}"
    if m := re.match(r"file(\d+)_(.*)", name, re.S):
        return f"file{index + int(m[1]) - 1}_{m[2]}"
    return f"file{index}_{name}"


def prefixed(parts: list[DataFrame], rec: str, prefixes: list[str] | None = None) -> DataFrame:
    """Variables of all parts side by side, named by prefixed_name()."""
    named = [p.select(rec, *(F.col(c).alias(prefixed_name(c, prefixes[i] if prefixes else None, i + 1)) for c in p.columns if c != rec)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.join(b, rec, "full"), named)


def joined(parts: list[DataFrame], rec: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Variables side by side under their own names; a repeated name is an error unless allowed (then the first stays)."""
    seen: set[str] = set()
    kept = []
    for p in parts:
        twice = [c for c in p.columns if c != rec and c in seen]
        if bad := [c for c in twice if c not in allowed]:
            raise ValueError(f"variables in several files: {', '.join(bad)}")
        seen |= set(p.columns)
        kept.append(p.drop(*twice))
    return reduce(lambda a, b: a.join(b, rec, "full"), kept)


def merge_attributes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Attribute entries of both; an entry that exists wins."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def override_attributes(base: DataFrame, master: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the values that a master table gives."""
    m = master.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(value).alias("__value"))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{k}") for k in keys))
    return base.join(m, on, "left").withColumn(value, F.coalesce("__value", value)).select(*base.columns)


def rename_pointers(attributes: DataFrame, value: str, names: list[str], prefix: str) -> DataFrame:
    """Variable names inside attribute text, prefixed."""
    pattern = r"(?<![\w])(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?![\w])"
    return attributes.withColumn(value, F.regexp_replace(value, pattern, f"{prefix}_$1"))


def match_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(name, found): whether each name is in the first table only, the second only, or both."""
    a = left.select(F.col(name).alias("a")).distinct()
    b = right.select(F.col(name).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full")
    return both.select(F.coalesce("a", "b").alias(name), F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both").alias("found"))


def compare_values(left: DataFrame, right: DataFrame, keys: list[str], variables: dict[str, float]) -> DataFrame:
    """(variable, n_compared, n_values, n_records): values and records that differ, by variable and tolerance; keys are the record, and the index where it has several values."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(v).alias(f"__{v}") for v in variables))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{k}") for k in keys))
    both = left.join(r, on, "full")
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.coalesce(differs(F.col(v).cast("double"), F.col(f"__{v}").cast("double"), t), F.lit(True)).alias("differs")) for v, t in variables.items()))
    # The first key is the record: its differing values are counted first, so that each record counts once.
    long = both.select(F.coalesce(keys[0], f"__{keys[0]}").alias("rec"), F.explode(cells).alias("x")).select("rec", "x.*")
    by_record = long.groupBy("variable", "rec").agg(F.count("*").alias("n"), F.count_if("differs").alias("d"))
    return by_record.groupBy("variable").agg(F.sum("n").alias("n_compared"), F.sum("d").alias("n_values"), F.count_if(F.col("d") > 0).alias("n_records"))


def master_attributes(text: str) -> list[tuple[str, int, str]]:
    """(attribute, entry, value) of a master text: lines of name, an entry number and { value }, or name = value; # and ! begin remarks."""
    out = []
    for line in text.splitlines():
        if m := re.match(r'\s*"?([^"#!={]+?)"?\s*(?:(\d+)\s*:?\s*(?:\w+\s*)?\{\s*"?(.*?)"?\s*\}|=\s*"?(.*?)"?)\s*\.?\s*$', line):
            out.append((m[1].strip(), int(m[2] or 1), m[3] if m[3] is not None else m[4]))
    return out


def compare_schemas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, found, same_type) of two variables tables (name, type)."""
    a, b = left.select(F.col("name"), F.col("type").alias("t1")), right.select(F.col("name").alias("__n"), F.col("type").alias("t2"))
    both = a.join(b, F.col("name") == F.col("__n"), "full")
    return both.select(F.coalesce("name", "__n").alias("name"), F.when(F.col("__n").isNull(), "first").when(F.col("name").isNull(), "second").otherwise("both").alias("found"), (type_class(F.col("t1")) == type_class(F.col("t2"))).alias("same_type"))


def range_of_times(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """First and last time of each group."""
    return df.groupBy(*by).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def merged_name(attributes: dict[str, str], convention: str = "source_descriptor_date", date: str = "", version: str = "v01") -> str:
    """A file name from naming attributes: the parts that the convention lists, short names before >, lower case."""
    keys = {"source": "Source_name", "descriptor": "Descriptor", "type": "Data_type", "date": ""}
    parts = [date if not keys[p] else attributes.get(keys[p], p).split(">")[0].strip().lower() for p in convention.split("_") if p in keys]
    return "_".join([*(x for x in parts if x), version])
