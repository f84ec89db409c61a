"""The four byte packings of science files, both ways.

* RLE: a zero byte is followed by the number of further zeros.
* Huffman: counts from 1 to 255 of the bytes in runs (first, last, counts; a
  first of 0 ends them), then the codes, highest bit first, with an end symbol.
* Adaptive Huffman: no counts; both sides grow the same tree, a new byte follows
  an escape symbol in eight bits.
* GZIP: RFC 1952.
"""

from __future__ import annotations

import gzip
import heapq
import zlib
from collections.abc import Iterable

import numpy as np

NAMES = {0: "None", 1: "RLE", 2: "HUFF", 3: "AHUFF", 5: "GZIP"}
END, ESCAPE = 256, 257
#: Fixed value: the weight of all at which an adaptive tree is halved.
HEAVY = 0x8000
#: Bytes that are turned into codes, or codes into bytes, at once.
PIECE = 1 << 16


class PackingError(OSError):
    """Packed bytes that end early or make no sense."""


def unrle(data: bytes) -> bytes:
    out, at = [], 0
    while (zero := data.find(0, at)) >= 0:
        if zero + 1 >= len(data):
            raise PackingError("a run of zeros without its length")
        out.append(data[at:zero] + bytes(data[zero + 1] + 1))
        at = zero + 2
    return b"".join([*out, data[at:]])


def rle(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[1], (x != 0).astype(np.int8), [1]])))
    out, at = [], 0
    for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(data[at:first])
        whole, rest = divmod(end - first, 256)
        out.append(b"\0\xff" * whole + (bytes((0, rest - 1)) if rest else b""))
        at = end
    return b"".join([*out, data[at:]])


class Bits:
    """Codes as text, joined to bytes a piece at a time, highest bit first."""

    def __init__(self):
        self.out, self.rest = bytearray(), ""

    def put(self, codes: Iterable[str]) -> None:
        text = "".join([self.rest, *codes])
        whole = len(text) & ~7
        if whole:
            self.out += int(text[:whole], 2).to_bytes(whole // 8, "big")
        self.rest = text[whole:]

    def end(self) -> bytes:
        self.put(["0" * (-len(self.rest) % 8)])
        return bytes(self.out)


def codes_of(weights: dict[int, int]) -> dict[int, str]:
    """The code of each symbol: the two lightest nodes are joined until one is left, of equal ones the older first."""
    queue = [(w, symbol) for symbol, w in sorted(weights.items())]
    heapq.heapify(queue)
    children: dict[int, tuple[int, int]] = {}
    fresh = END + 1
    while len(queue) > 1:
        (a, left), (b, right) = heapq.heappop(queue), heapq.heappop(queue)
        children[fresh] = left, right
        heapq.heappush(queue, (a + b, fresh))
        fresh += 1
    out, todo = {}, [(queue[0][1], "")]
    while todo:
        node, code = todo.pop()
        if node in children:
            todo += [(children[node][0], code + "0"), (children[node][1], code + "1")]
        else:
            out[node] = code
    return out


def huffman(data: bytes) -> bytes:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    if not data:
        counts[0] = 1
    small = np.where(counts > 0, np.maximum(counts // (counts.max() // 255 + 1), 1), 0)
    head, used = bytearray(), np.flatnonzero(small)
    # Runs go over gaps of up to two bytes without a count.
    for run in np.split(used, np.flatnonzero(np.diff(used) > 3) + 1):
        head += bytes((run[0], run[-1])) + bytes(small[run[0] : run[-1] + 1].tolist())
    codes = codes_of({i: int(small[i]) for i in used} | {END: 1})
    bits, table = Bits(), [codes.get(i) for i in range(END)]
    for at in range(0, len(data), PIECE):
        bits.put(map(table.__getitem__, data[at : at + PIECE]))
    bits.put([codes[END]])
    return bytes(head) + b"\0" + bits.end()


def unhuffman(data: bytes) -> bytes:
    try:
        at, weights = 0, {END: 1}
        while True:
            first, last = data[at], data[at + 1]
            weights |= {i: n for i, n in zip(range(first, last + 1), data[at + 2 : at + 3 + last - first], strict=True) if n}
            at += 3 + last - first
            if not data[at]:
                break
    except (IndexError, ValueError) as e:
        raise PackingError("counts end early") from e
    symbols = {code: symbol for symbol, code in codes_of(weights).items()}
    out, begin, place = [], at + 1, 0
    # What 16 bits begin with, worked out when first met: the bytes of whole codes, and the bits that these take.
    found: list[tuple[bytes, int] | None] = [None] * (1 << 16)
    while True:
        # All 16-bit windows of a piece; the last three bytes of a piece come again in the next.
        x = np.frombuffer(data[begin : begin + PIECE] + bytes(3), np.uint8).astype(np.uint32)
        wide = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        windows = memoryview((wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).astype(np.uint16).ravel())
        last = begin + PIECE >= len(data)
        stop = 8 * (len(data) - begin) if last else 8 * (PIECE - 3)
        while place < stop:
            known = found[windows[place]]
            if known is None:
                known = found[windows[place]] = whole_codes(f"{windows[place]:016b}", symbols)
            if not known[1] or place + known[1] > stop and last:
                break
            out.append(known[0])
            place += known[1]
        else:
            if last:
                raise PackingError("codes end early")
            begin, place = begin + place // 8, place % 8
            continue
        # The end symbol, a code of over 16 bits or the last codes stand here.
        ahead = data[begin + place // 8 : begin + place // 8 + 64]
        text, n = f"{int.from_bytes(ahead, 'big'):0{8 * len(ahead)}b}"[place % 8 :], 1
        while n <= len(text) and text[:n] not in symbols:
            n += 1
        if n > len(text):
            raise PackingError("codes end early")
        if symbols[text[:n]] == END:
            return b"".join(out)
        out.append(bytes((symbols[text[:n]],)))
        begin, place = begin + (place + n) // 8, (place + n) % 8


def whole_codes(bits: str, symbols: dict[str, int]) -> tuple[bytes, int]:
    """The bytes whose codes stand at the front of bits one after another, up to an end symbol, and the bits that they take."""
    out, first, n = bytearray(), 0, 1
    while first + n <= len(bits):
        symbol = symbols.get(bits[first : first + n])
        if symbol == END:
            break
        if symbol is None:
            n += 1
        else:
            out.append(symbol)
            first, n = first + n, 1
    return bytes(out), first


class Growing:
    """A Huffman tree that learns: nodes in falling order of weight, each pair of children side by side.

    kids[i] is the first child of node i, or minus one minus its symbol. The path to a
    symbol says 1 for a child with an even number, its pair's second. lead[w] is the
    first node of weight w, where there is one; the root, heavier than all, has none.
    """

    def __init__(self):
        self.weight, self.kids, self.parent = [2, 1, 1], [1, -1 - END, -1 - ESCAPE], [-1, 0, 0]
        self.leaf = [0] * (ESCAPE + 1)
        self.leaf[END], self.leaf[ESCAPE] = 1, 2
        self.lead = [0] * (HEAVY + 2)
        self.lead[1] = 1
        self.lists = self.weight, self.kids, self.parent, self.leaf, self.lead

    def place(self, i: int) -> None:
        """Tells what hangs on node i where it is."""
        k = self.kids[i]
        if k < 0:
            self.leaf[-1 - k] = i
        else:
            self.parent[k] = self.parent[k + 1] = i

    def add(self, symbol: int) -> None:
        """The lightest leaf makes room: it becomes the parent of itself and of the new symbol."""
        old = len(self.kids) - 1
        self.weight += [self.weight[old], 0]
        self.kids += [self.kids[old], -1 - symbol]
        self.parent += [old, old]
        self.kids[old] = old + 1
        self.lead[0] = old + 2
        self.place(old + 1)
        self.place(old + 2)

    def learn(self, symbol: int) -> None:
        weight, kids, parent, leaf, lead = self.lists
        if weight[0] == HEAVY:
            self.halve()
        weight[0] += 1
        i = leaf[symbol]
        while i:
            # The first of the nodes of this weight takes the place's content and one more.
            w = weight[i]
            j = lead[w]
            if i != j:
                kids[i], kids[j] = b, a = kids[j], kids[i]
                if b < 0:
                    leaf[-1 - b] = i
                else:
                    parent[b] = parent[b + 1] = i
                if a < 0:
                    leaf[-1 - a] = j
                else:
                    parent[a] = parent[a + 1] = j
            lead[w] = j + 1
            w += 1
            weight[j] = w
            if weight[j - 1] != w:
                lead[w] = j
            i = parent[j]

    def halve(self) -> None:
        """Leaves keep their order with half their weight, rounded up; pairs are joined anew from the lightest on."""
        rows = [((w + 1) // 2, k) for w, k in zip(self.weight, self.kids, strict=True) if k < 0]
        size = len(self.kids)
        table = [None] * (size - len(rows)) + rows
        free, pair = size - len(rows) - 1, size - 2
        while free >= 0:
            weight = table[pair][0] + table[pair + 1][0]
            # The new node stands behind all that are heavier.
            to = free + 1
            while weight < table[to][0]:
                to += 1
            table[free : to - 1] = table[free + 1 : to]
            table[to - 1] = weight, pair
            free, pair = free - 1, pair - 2
        self.weight[:], self.kids[:] = [w for w, _ in table], [k for _, k in table]
        for i in range(size - 1, -1, -1):
            self.place(i)
            self.lead[self.weight[i]] = i

    def code(self, symbol: int) -> str:
        i, parent, out = self.leaf[symbol], self.parent, ""
        while i:
            out = ("1", "0")[i & 1] + out
            i = parent[i]
        return out


def adaptive(data: bytes) -> bytes:
    tree, bits = Growing(), Bits()
    leaf, code, learn = tree.leaf, tree.code, tree.learn
    for at in range(0, len(data), PIECE):
        codes = []
        for symbol in data[at : at + PIECE]:
            if leaf[symbol]:
                codes.append(code(symbol))
            else:
                codes += [code(ESCAPE), f"{symbol:08b}"]
                tree.add(symbol)
            learn(symbol)
        bits.put(codes)
    bits.put([code(END)])
    return bits.end()


def unadaptive(data: bytes) -> bytes:
    tree, out, at = Growing(), bytearray(), 0
    kids, learn, add = tree.kids, tree.learn, out.append
    begin, bits, last = 0, b"", not data
    try:
        while True:
            # A symbol takes less than 64 bytes.
            if not last and at + 512 > len(bits):
                begin, at = begin + at // 8, at % 8
                bits, last = np.unpackbits(np.frombuffer(data[begin : begin + PIECE], np.uint8)).tobytes(), begin + PIECE >= len(data)
            k = kids[0]
            while k >= 0:
                k = kids[k + bits[at]]
                at += 1
            symbol = -1 - k
            if symbol >= END:
                if symbol == END:
                    return bytes(out)
                if at + 8 > len(bits):
                    raise PackingError("codes end early")
                symbol = int.from_bytes(np.packbits(np.frombuffer(bits[at : at + 8], np.uint8)).tobytes())
                at += 8
                tree.add(symbol)
            add(symbol)
            learn(symbol)
    except IndexError as e:
        raise PackingError("codes end early") from e


def packed(kind: int, data: bytes, level: int = 6) -> bytes:
    if kind == 0:
        return data
    if kind == 5:
        return gzip.compress(data, level, mtime=0)
    try:
        return {1: rle, 2: huffman, 3: adaptive}[kind](data)
    except KeyError:
        raise PackingError(f"no packing has the number {kind}") from None


def unpacked(kind: int, data: bytes) -> bytes:
    if kind == 0:
        return bytes(data)
    if kind == 5:
        try:
            return zlib.decompress(data, 31)
        except zlib.error as e:
            raise PackingError(f"broken gzip data: {e}") from e
    try:
        way = {1: unrle, 2: unhuffman, 3: unadaptive}[kind]
    except KeyError:
        raise PackingError(f"no packing has the number {kind}") from None
    return way(bytes(data))
