"""Text forms of a file: skeleton tables, both ways, and XML, read.

Both are parsed into a Writer, so what they describe can be built, read and
queried like any other file.
"""

from __future__ import annotations

import datetime as dt
import re
from xml.etree import ElementTree

import numpy as np

from skyloom.functions.values import TOKENS
from skyloom.sources.layout import NUMPY, File, FormatError, Writer
from skyloom.sources.packing import NAMES

#: Fixed value: what type names begin with in both forms.
PREFIX = "CDF_"
#: Milliseconds from year 0 to 1970.
UNIX_MS = 62_167_219_200_000
TOKEN = re.compile(r'!.*?$|"((?:[^"]|"")*)"|\{((?:[^{}"]|"(?:[^"]|"")*")*)\}|(\[[^\]]*\])|([^\s{}"\[\]]+)', re.M)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
SPARSE = {"NONE": 0, "PAD": 1, "PREV": 2}


def type_of(name: str) -> str:
    kind = name.removeprefix(PREFIX)
    if kind not in NUMPY:
        raise FormatError(f"no data type is named {name}")
    return kind


def milliseconds(text: str) -> float:
    """Milliseconds since year 0 of dd-Mmm-yyyy hh:mm:ss.mmm, or of a plain number."""
    m = re.match(r"\s*(\d+)-(\w{3})-(\d{4}) (\d+):(\d+):(\d+)(?:\.(\d+))?", text)
    if not m:
        return float(text)
    if int(m[3]) == 0:  # the calendar of this machine begins with year 1; year 0 is a leap year
        return (dt.datetime(4, MONTHS.index(m[2].title()) + 1, int(m[1]), int(m[4]), int(m[5]), int(m[6])) - dt.datetime(4, 1, 1)).total_seconds() * 1000
    at = dt.datetime(int(m[3]), MONTHS.index(m[2].title()) + 1, int(m[1]), int(m[4]), int(m[5]), int(m[6])) - dt.datetime(1970, 1, 1)
    return (at.days * 86_400 + at.seconds) * 1000 + UNIX_MS + int((m[7] or "0").ljust(3, "0")[:3])


def picoseconds(text: str) -> list[float]:
    """Seconds and picoseconds of dd-Mmm-yyyy hh:mm:ss.mmm.uuu.nnn.ppp, or of two plain numbers."""
    if not re.match(r"\s*\d+-\w{3}-\d{4}", text):
        return [float(x) for x in text.split(",")]
    clock, *parts = text.strip().split(".")
    return [milliseconds(clock) // 1000, float(int("".join(p.rjust(3, "0") for p in parts) or "0"))]


def value_of(kind: str, text: str):
    """One value, or several apart by commas, of a type."""
    if NUMPY[kind] == "S":
        return text
    if kind == "EPOCH16":
        return picoseconds(text)
    if kind == "EPOCH":
        found = [milliseconds(x) for x in text.split(",")]
    else:
        found = [(float if NUMPY[kind][0] == "f" else int)(x) for x in text.replace("\n", " ").split(",")]
    return found[0] if len(found) == 1 else found


def quoted(raw: str) -> str:
    """The text of pieces in quotes, put together."""
    return "".join(x.replace('""', '"') for x in re.findall(r'"((?:[^"]|"")*)"', raw))


class Table:
    """A skeleton table as a stream of words."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        for m in TOKEN.finditer(text):
            if m[1] is not None:
                self.items.append(("name", m[1].replace('""', '"')))
            elif m[2] is not None:
                self.items.append(("value", m[2]))
            elif m[3] is not None:
                self.items.append(("place", m[3][1:-1]))
            elif m[4] is not None:
                self.items.append(("word", m[4]))
        self.at = 0

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    def word(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1][1]

    def typed(self) -> tuple[str, object]:
        kind = type_of(self.take())
        if self.kind() != "value":
            raise FormatError("a value in braces was expected")
        raw = self.take()
        return kind, value_of(kind, quoted(raw) if NUMPY[kind] == "S" else raw)


def read_skeleton(text: str) -> Writer:
    """The file that a skeleton table describes, with the values that it gives."""
    start = re.search(r"^\s*#(?!header)", text, re.M | re.I)
    head, rest = (text[: start.start()], text[start.start() :]) if start else (text, "")
    bare = "\n".join(line.split("!")[0] for line in head.splitlines())
    order = re.search(r"MAJORITY:\s*(\w+)", bare, re.I)
    encoding = re.search(r"DATA ENCODING:\s*(\w+)", bare, re.I)
    counts = re.search(r"(\d+)/(\d+)\s+(\d+)\s+(\d+)\s+\S+\s+(\d+)((?:\s+\d+)*)", bare)
    rdims = tuple(int(x) for x in counts[6].split()[: int(counts[5])]) if counts else ()
    little = {v.upper(): k for k, v in TOKENS["encoding"].items()}.get((encoding[1] if encoding else "NETWORK").upper(), 1) in (4, 6, 13, 16)
    w = Writer((order[1] if order else "ROW").upper() == "ROW", little, rdims=rdims)
    t, section, name = Table(rest), "", ""
    while t.kind() != "end":
        if t.kind() == "word" and t.word().startswith("#"):
            section = t.take().lower()
            if section == "#end":
                break
        elif section == "#globalattributes" and t.kind() == "name":
            name = t.take()
        elif section == "#globalattributes" and t.kind() == "word" and re.fullmatch(r"\d+:", t.word()):
            entry = int(t.take()[:-1])
            kind, value = t.typed()
            w.attribute(name, value, kind, entry=entry - 1)
        elif section in ("#variables", "#zvariables") and t.kind() == "name":
            try:
                read_variable(t, w, section == "#variables", rdims)
            except (IndexError, ValueError) as e:
                raise FormatError(f"broken skeleton table: {e}") from e
        else:
            t.take()
    return w


def read_variable(t: Table, w: Writer, is_r: bool, rdims: tuple[int, ...]) -> None:
    name, kind, elements = t.take(), type_of(t.take()), int(t.take())
    words = []
    while t.kind() == "word" and t.word() != ".":
        words.append(t.take())
    if is_r:
        dims, varies = rdims, [x.upper() == "T" for x in words]
    else:
        n = int(words[0])
        dims, varies = tuple(map(int, words[1 : 1 + n])), [x.upper() == "T" for x in words[1 + n :]]
    if len(varies) != len(dims) + 1:
        raise FormatError(f"{name} needs a record variance and one for each dimension")
    found, attributes = {}, []
    while t.kind() in ("name", "place", "word") and not t.word().startswith("#"):
        if t.kind() == "name":
            if t.items[t.at + 1][0] != "word" or t.items[min(t.at + 2, len(t.items) - 1)][0] != "value":
                break  # the next variable
            attributes.append((t.take(), *t.typed()))
        elif t.kind() == "place" or re.fullmatch(r"\d+:", t.word()):
            rec = int(t.take()[:-1]) - 1 if t.kind() == "word" else 0
            index = tuple(int(x) - 1 for x in t.take().split(",") if x.strip())
            t.take()  # the sign =
            raw = t.take()
            found[rec, index] = value_of(kind, quoted(raw) if NUMPY[kind] == "S" and '"' in raw else raw)
        else:
            t.take()
    shape = tuple(n for n, y in zip(dims, varies[1:], strict=True) if y)
    last = max((r for r, _ in found), default=-1)
    tail = (2,) if kind == "EPOCH16" else ()
    data = np.zeros((last + 1, *shape, *tail), f"S{elements}" if NUMPY[kind] == "S" else NUMPY[kind])
    for (rec, index), value in found.items():
        data[(rec, *(i for i, y in zip(index, varies[1:], strict=False) if y))] = value.encode("ascii", "replace") if isinstance(value, str) else value
    if is_r or all(varies[1:]):
        w.variable(name, kind, data, varies[0], is_r=is_r, dim_varies=tuple(varies[1:]) if is_r else None)
    else:
        w.variable(name, kind, data, varies[0])
    for a, k, value in attributes:
        w.attribute(a, value, k, name)


def shown(kind: str, value) -> str:
    """A value as a skeleton table shows it, in braces."""
    if isinstance(value, (bytes, np.bytes_)):
        value = value.decode("ascii", "replace").rstrip("\0")
    if isinstance(value, str):
        pieces = [value[i : i + 40].replace('"', '""') for i in range(0, max(len(value), 1), 40)]
        return "{ " + " -\n      ".join(f'"{p}"' for p in pieces) + " }"
    return "{ " + ", ".join(repr(x) for x in np.ravel(value).tolist()) + " }"


def write_skeleton(file: File, name: str = "", values: str = "nrv", most: int = 10_000) -> str:
    """A skeleton table; values: "none", "nrv" (of variables that do not vary) or "all", of at most so many records each."""
    if values not in ("none", "nrv", "all"):
        raise ValueError('values is "none", "nrv" or "all"')
    z = [v for v in file.variables.values() if v.is_z]
    r = [v for v in file.variables.values() if not v.is_z]
    n_global = sum(a.scope == "GLOBAL" for a in file.attributes)
    head = ["#header", "", f"    {PREFIX.rstrip('_')} NAME: {name}", f"    DATA ENCODING: {'IBMPC' if file.order() == '<' else 'NETWORK'}", f"    MAJORITY: {'ROW' if file.row_major else 'COLUMN'}", "    FORMAT: SINGLE", "", "! Variables  G.Attributes  V.Attributes  Records  Dims  Sizes"]
    out = [*head, f"  {len(r)}/{len(z)}  {n_global}  {len(file.attributes) - n_global}  {max((v.last_record for v in r), default=-1) + 1}/z  {len(file.rdims)}  {' '.join(map(str, file.rdims))}", "", "#GLOBALattributes", ""]
    by_variable: dict[tuple[bool, int], list] = {}
    for a in file.attributes:
        own = [(n, k, v) for s, n, k, v in a.entries if s == "g"]
        if a.scope == "GLOBAL" and own:
            out += [f'  "{a.name}"', *(f"    {n + 1}: {PREFIX}{k} {shown(k, v)}" for n, k, v in own), "    ."]
        for s, n, k, v in a.entries:
            if s != "g":
                by_variable.setdefault((s == "z", n), []).append((a.name, k, v))
    out += ["", "#VARIABLEattributes", "", *(f'  "{a.name}"' for a in file.attributes if a.scope == "VARIABLE")]
    for title, group in (("#variables", r), ("#zVariables", z)):
        out += ["", title, ""]
        for v in group:
            flags = " ".join("T" if x else "F" for x in (v.record_varies, *v.dim_varies))
            sizes = "" if not v.is_z else f"{len(v.dims)} {' '.join(map(str, v.dims))} "
            out += [f'  "{v.name}"  {PREFIX}{v.type}  {v.elements}  {sizes}{flags}', *(f'    "{a}" {PREFIX}{k} {shown(k, x)}' for a, k, x in by_variable.get((v.is_z, v.number), [])), "    ."]
            if values == "all" or (values == "nrv" and not v.record_varies):
                data = file.read(v.name, 0, min(v.last_record, most - 1))
                whole = data.shape[: 1 + len(v.shape)]
                spots = [i for i, y in enumerate(v.dim_varies) if y]
                for at in np.ndindex(*whole):
                    index = [1] * len(v.dims)
                    for i, x in zip(spots, at[1:], strict=True):
                        index[i] = x + 1
                    out.append(f"    {f'{at[0] + 1}: ' if v.record_varies else ''}[{','.join(map(str, index))}] = {shown(v.type, data[at])}")
    return "\n".join([*out, "", "#end", ""])


def read_xml(text: str) -> Writer:
    """The file that an XML description gives: file information, attributes, variables and their values."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise FormatError(f"broken XML: {e}") from e
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]  # names may carry a namespace
    info = root.find("cdfFileInfo")
    get = (lambda k, other: info.get(k, other)) if info is not None else (lambda _, other: other)
    little = {v.upper(): k for k, v in TOKENS["encoding"].items()}.get(get("encoding", "NETWORK").upper(), 1) in (4, 6, 13, 16)
    w = Writer(get("majority", "ROW") == "ROW", little, packing=packing_of(get("compression", "NONE")))
    for a in root.iterfind("cdfGAttributes/attribute"):
        for i, e in enumerate(a.iterfind("entry")):
            kind = type_of(e.get("cdfDatatype"))
            w.attribute(a.get("name"), value_of(kind, e.text or ""), kind, entry=int(e.get("entryNum", i)))
    for v in root.iterfind("cdfVariables/variable"):
        read_xml_variable(v, w)
    return w


def packing_of(name: str) -> int:
    plain = name.upper().split(".")[0]
    known = {v.upper(): k for k, v in NAMES.items()} | {"NONE": 0}
    if plain not in known:
        raise FormatError(f"no compression is named {name}")
    return known[plain]


def read_xml_variable(node, w: Writer) -> None:
    info, name = node.find("cdfVarInfo"), node.get("name")
    kind, elements, n = type_of(info.get("cdfDatatype")), int(info.get("numElements")), int(info.get("dim"))
    numbers = lambda text: [int(x) for x in re.findall(r"\d+", text or "")]
    dims = tuple(numbers(info.get("dimSizes"))[:n])
    varies = [x.upper() in ("VARY", "TRUE", "T") for x in re.findall(r"\w+", info.get("dimVariances") or "VARY " * n)]
    shape = tuple(d for d, y in zip(dims, varies, strict=True) if y)
    pad = info.get("padValue")
    pad = None if pad is None else value_of(kind, pad)
    sparse = SPARSE[(info.get("sparseRecords") or "NONE").upper().removesuffix("SPARSERECORDS").rstrip("_") or "NONE"]
    size = int(np.prod(shape, dtype=np.int64))
    rows, numbers_of = [], []
    for i, r in enumerate(node.iterfind("cdfVarData/record")):
        numbers_of.append(int(r.get("recNum", i)))
        fill = pad if pad is not None else (" " if NUMPY[kind] == "S" else 0)
        cells = [fill] * size
        mark = r.get("elementDelimiter")
        if r.find("element") is not None:
            given = [(int(e.get("index")), e.text or "") for e in r.iterfind("element")]
        elif mark:
            parts = (r.text or "").split(mark)
            given = list(enumerate(p for i, p in enumerate(parts[1:], 1) if i % 2 == 1)) if NUMPY[kind] == "S" else list(enumerate(x.strip() for x in parts if x.strip()))
        elif NUMPY[kind] == "S":
            given = [(0, r.text or "")]
        elif kind in ("EPOCH", "EPOCH16"):
            given = list(enumerate(re.findall(r"\d+-\w{3}-\d{4} [\d:.]+|[-+\d.eE]+", r.text or "")))
        else:
            given = list(enumerate((r.text or "").split()))
        for k, x in given:
            if not 0 <= k < size:
                raise FormatError(f"{name} has no element {k}")
            cells[k] = value_of(kind, x)
        rows.append([c.encode("ascii", "replace") if isinstance(c, str) else c for c in cells])
    tail = (2,) if kind == "EPOCH16" else ()
    data = np.array(rows, f"S{elements}" if NUMPY[kind] == "S" else NUMPY[kind]).reshape(len(rows), *shape, *tail)
    runs: list[tuple[int, int]] = []
    for at in numbers_of:
        if runs and at == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], at)
        else:
            runs.append((at, at))
    w.variable(name, kind, data, info.get("recVariance") == "VARY", pad, packing_of(info.get("compression") or "NONE"), sparse, runs or None)
    for a in node.iterfind("cdfVAttributes/attribute"):
        for e in a.iterfind("entry"):
            k = type_of(e.get("cdfDatatype"))
            w.attribute(a.get("name"), value_of(k, e.text or ""), k, name)
