"""Column functions for numbers, text and codes of science files."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type codes, and by type: bytes, pad value.
TYPES = {1: "INT1", 2: "INT2", 4: "INT4", 8: "INT8", 11: "UINT1", 12: "UINT2", 14: "UINT4", 21: "REAL4", 22: "REAL8", 31: "EPOCH", 32: "EPOCH16", 33: "TIME_TT2000", 41: "BYTE", 44: "FLOAT", 45: "DOUBLE", 51: "CHAR", 52: "UCHAR"}
PADS = {"INT1": -127, "BYTE": -127, "UINT1": 254, "INT2": -32767, "UINT2": 65534, "INT4": -2147483647, "UINT4": 4294967294, "INT8": -9223372036854775807, "REAL4": -1e30, "FLOAT": -1e30, "REAL8": -1e30, "DOUBLE": -1e30, "EPOCH": 0.0, "EPOCH16": 0.0, "TIME_TT2000": -9223372036854775807, "CHAR": " ", "UCHAR": " "}
#: Names of other codes.
TOKENS = {
    "encoding": {1: "NETWORK", 2: "SUN", 3: "VAX", 4: "DECSTATION", 5: "SGi", 6: "IBMPC", 7: "IBMRS", 9: "PPC", 11: "HP", 12: "NeXT", 13: "ALPHAOSF1", 14: "ALPHAVMSd", 15: "ALPHAVMSg", 16: "ALPHAVMSi"},
    "majority": {1: "ROW", 2: "COLUMN"},
    "format": {1: "SINGLE", 2: "MULTI"},
    "scope": {1: "GLOBAL", 2: "VARIABLE"},
    "variance": {-1: "VARY", 0: "NOVARY"},
    "compression": {0: "None", 1: "RLE", 2: "HUFF", 3: "AHUFF", 5: "GZIP"},
    "sparseness": {0: "None", 1: "PAD", 2: "PREV"},
    "checksum": {0: "None", 1: "MD5"},
    "type": TYPES,
}
#: Types that count as equal when schemas are compared, by representative.
SAME_TYPE = {"BYTE": "INT1", "TIME_TT2000": "INT8", "FLOAT": "REAL4", "DOUBLE": "REAL8", "EPOCH": "REAL8", "UCHAR": "CHAR"}


def unsigned(x: Column, bits: int) -> Column:
    """The unsigned value of a number that was read as signed."""
    wide = x.cast({8: "smallint", 16: "int", 32: "bigint"}[bits])
    return F.when(wide < 0, wide + F.lit(1 << bits)).otherwise(wide).cast({8: "smallint", 16: "int", 32: "bigint"}[bits])


def wrapped(x: Column, bits: int, signed: bool = True) -> Column:
    """An integer cut to that many bits as a C cast does, without an overflow error; unsigned 64-bit values are decimals."""
    size, half = (F.lit(Decimal(n)).cast("decimal(38,0)") for n in (1 << bits, 1 << (bits - 1)))
    low = F.pmod(x.cast("decimal(38,0)"), size)
    if signed:
        low = F.when(low >= half, low - size).otherwise(low)
    return low.cast({(8, True): "tinyint", (16, True): "smallint", (32, True): "int", (64, True): "bigint", (8, False): "smallint", (16, False): "int", (32, False): "bigint", (64, False): "decimal(20,0)"}[bits, signed])


def toward_zero(x: Column) -> Column:
    """The whole part of a number, or of text that holds one, without a detour over doubles for whole numbers; else null."""
    read = F.when(F.typeof(x) == "string", x.try_cast("decimal(38,9)")).otherwise(F.lit(None).cast("decimal(38,9)"))
    cut = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("decimal(38,0)")
    number = F.when(F.typeof(x) == "string", F.lit(None)).otherwise(x)
    return F.when(F.typeof(x) == "string", cut(read)).when(F.typeof(x).isin("float", "double"), cut(number.cast("double"))).otherwise(number.try_cast("decimal(38,0)"))


def converted(x: Column, target: str) -> Column:
    """A value as another type: integers wrap, text is read or null."""
    bits = {"INT1": 8, "BYTE": 8, "INT2": 16, "INT4": 32, "INT8": 64, "UINT1": 8, "UINT2": 16, "UINT4": 32}.get(target)
    if bits:
        return wrapped(toward_zero(x), bits, not target.startswith("U"))
    return x.try_cast({"REAL4": "float", "FLOAT": "float", "CHAR": "string", "UCHAR": "string"}.get(target, "double"))


#: Least and largest value of the whole-number types.
LIMITS = {"INT1": (-128, 127), "BYTE": (-128, 127), "UINT1": (0, 255), "INT2": (-32768, 32767), "UINT2": (0, 65535), "INT4": (-2147483648, 2147483647), "UINT4": (0, 4294967295), "INT8": (-9223372036854775808, 9223372036854775807), "TIME_TT2000": (-9223372036854775808, 9223372036854775807)}


def parsed_values(text: Column, target: str) -> Column:
    """Text as an array of values of a type: numbers apart by commas, text between two equal marks; null where it cannot be read or a number does not fit."""
    if target in ("CHAR", "UCHAR"):
        inner = F.regexp_extract(text, r"^\s*(\S)((?s:.*?))\1", 2)
        return F.when(text.rlike(r"^\s*(\S)(?s:.*?)\1"), F.array(inner))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    if target not in LIMITS:
        values = F.transform(parts, lambda p: p.try_cast("double"))
        return F.when(F.forall(values, lambda v: v.isNotNull()), values)
    low, high = LIMITS[target]
    values = F.transform(parts, lambda p: F.regexp_extract(p, r"^[+-]?\d+", 0).try_cast("decimal(38,0)"))
    kind = {"INT1": "tinyint", "BYTE": "tinyint", "UINT1": "smallint", "INT2": "smallint", "UINT2": "int", "INT4": "int", "UINT4": "bigint"}.get(target, "bigint")
    fits = F.forall(values, lambda v: v.isNotNull() & v.between(F.lit(Decimal(low)), F.lit(Decimal(high))))
    return F.when(fits, values).try_cast(f"array<{kind}>")


def valid_name(name: Column) -> Column:
    """Whether text can name a variable or attribute: at least one character, all of them printable ASCII."""
    return name.rlike(r"^[\x20-\x7E]+$")


def valid_code(code: Column, kind: str) -> Column:
    """Whether a number is a known code of that kind (see TOKENS)."""
    return code.isin(*TOKENS[kind])


def plain_zero(x: Column) -> Column:
    """-0.0 as 0.0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """Whether values differ: a positive tolerance is absolute, a negative one relative to the larger value; NaN equals NaN."""
    allowed = F.lit(tolerance) if tolerance >= 0 else F.lit(-tolerance) * F.greatest(F.abs(a), F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b))).otherwise(F.abs(a - b) > allowed)


def padded_equal(a: Column, b: Column) -> Column:
    """Text equality where NULs and trailing blanks count as padding."""
    plain = lambda x: F.rtrim(F.translate(x, "\x00", " "))
    return plain(a) == plain(b)


def attribute_text(raw: Column) -> Column:
    """Text of attribute bytes: each byte that is not ASCII becomes *, blanks at the end go."""
    return F.rtrim(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[^\x00-\x7F]", "*"))


def token(code: Column, kind: str) -> Column:
    """Name of a code, ? where it has none."""
    out = F.lit("?")
    for k, name in TOKENS[kind].items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def type_class(name: Column) -> Column:
    """A type's representative among those that count as equal."""
    out = name
    for k, same in SAME_TYPE.items():
        out = F.when(name == k, F.lit(same)).otherwise(out)
    return out


def name_like(name: Column, pattern: str) -> Column:
    """Wildcard match, whatever the case: * any text, ? one character."""
    return name.rlike("(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def formatted(x: Column, spec: str) -> Column:
    """Text of a number by a Fortran (F8.2, I4, E12.3, D12.3, G12.3, A10) or C format; what is too wide shows as *.

    E and D show a digit before the point, as C's E does, D with a D before the
    exponent; G shows as C's %G: the shorter form, without zeros at the end. A value
    exactly half-way between two texts is rounded away from zero, which C does not.
    """
    m = re.fullmatch(r"\s*([FEDGIAfedgia])(\d+)(?:\.(\d+))?\s*", spec)
    if not m:
        return F.format_string(spec, x)
    kind, width, digits = m[1].upper(), int(m[2]), int(m[3] or 0)
    if kind == "A":
        return F.rpad(x.cast("string"), width, " ")
    # Arguments are doubles for real formats and longs for integers, as the formatter wants.
    if kind == "I":
        text = F.format_string(f"%{width}d", x.cast("bigint"))
    elif kind == "F":
        text = F.format_string(f"%{width}.{digits}f", x.cast("double"))
    elif kind == "G":
        text = F.lpad(general(x.cast("double"), digits or 6), width, " ")
        text = F.when(F.length(general(x.cast("double"), digits or 6)) > width, F.lit("*" * (width + 1))).otherwise(text)
    else:
        text = F.format_string(f"%{width}.{digits}E", x.cast("double"))
        text = F.translate(text, "E", "D") if kind == "D" else text
    return F.when(F.length(text) > width, F.lit("*" * width)).otherwise(text)


def general(x: Column, digits: int) -> Column:
    """C's %.{digits}G: the exponent's form below 1e-4 and from 10^digits on, no zeros at the end."""
    far = F.format_string(f"%.{digits - 1}E", x)
    power = F.regexp_extract(far, r"E([+-]\d+)", 1).try_cast("int")
    plain = lambda t: F.regexp_replace(t, r"(\.\d*?)0+$", "$1")
    bare = lambda t: F.regexp_replace(plain(t), r"\.$", "")
    near = None
    for p in range(-4, digits):
        text = bare(F.format_string(f"%.{digits - 1 - p}f", x))
        near = F.when(power == p, text) if near is None else near.when(power == p, text)
    mantissa = F.regexp_replace(F.regexp_replace(far, r"(\.\d*?)0+E", "$1E"), r"\.E", "E")
    return near.when(power.isNull(), F.format_string("%G", x)).otherwise(mantissa)
