"""Progressive JPEG in numpy: many images at once, scan by scan.

Decoding accumulates the scans of an image (spectral selection and successive approximation) into
arrays of quantised coefficients, then dequantises, inverse-transforms, repeats subsampled chroma
and converts to RGB at full resolution. Entropy-coded data is read in lockstep: each restart
interval of each image is a stream, and one step reads one symbol (or refines one coefficient) of
every stream, so the work per symbol is a few vector operations.

The encoder writes coefficients without loss: three components without subsampling, tables of
ones, restart intervals of `RESTART` units, and this script of scans: DC without its last bit; AC
1-5 without the last bit; AC 6-63 whole; the last bit of AC 1-5; the last bit of DC.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

RESTART = 4
RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")
#: (components, first and last coefficient, bits done before, bits left)
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), *((((c,), 1, 5, 0, 1)) for c in range(3)), *((((c,), 6, 63, 0, 0)) for c in range(3)), *((((c,), 1, 5, 1, 0)) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0))


def zigzag() -> np.ndarray:
    """Raster index of each coefficient in zigzag order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))])


ZIGZAG = zigzag()
#: Huffman tables by rule: lengths in order of the symbols. DC: 12 sizes of 4 bits. AC: run 0 in 4 bits, all else in 9.
DC_SYMBOLS = {4: list(range(12))}
AC_SYMBOLS = {4: list(range(1, 9)), 9: [16 * r + s for r in range(16) for s in range(11) if not (r == 0 and 1 <= s <= 8)]}


@dataclass(frozen=True)
class Huffman:
    lengths: bytes  # 16 counts
    symbols: bytes

    @classmethod
    def of(cls, by_length: dict[int, list[int]]) -> Huffman:
        return cls(bytes(len(by_length.get(n, ())) for n in range(1, 17)), bytes(s for n in sorted(by_length) for s in by_length[n]))

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """By symbol: code and length."""
        code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        at = k = 0
        for n, count in enumerate(self.lengths, 1):
            for s in self.symbols[k : k + count]:
                code[s], size[s] = at, n
                at += 1
            k += count
            at <<= 1
        return code, size

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next 16 bits: symbol and length (0: no such code)."""
        symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, size = self.codes()
        for s in self.symbols:
            a, w = int(code[s]) << (16 - int(size[s])), 1 << (16 - int(size[s]))
            symbol[a : a + w], length[a : a + w] = s, size[s]
        return symbol, length


DC, AC = Huffman.of(DC_SYMBOLS), Huffman.of(AC_SYMBOLS)
_lookups: dict[Huffman, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = table.lookup()
    return _lookups[table]


# ---- writing -----------------------------------------------------------------------------------


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _raw_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v).astype(np.uint64)


def pack(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes of up to 32 bits, one after another, as bytes; all sizes together must be whole bytes."""
    keep = size > 0
    code, size = code[keep].astype(np.int64), size[keep]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    begins = ends - size
    word, room = begins >> 5, 64 - (begins & 31) - size
    wide = code << np.minimum(room, 62)  # 64-bit window whose upper half is this word
    wide = np.where(room > 62, code << 31 << (room - 31), wide).view(np.uint64)
    n = (total >> 5) + 2
    words = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n) + np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return words.astype(np.uint32).byteswap().view(np.uint8)[: total // 8]


class _Stream:
    """Codes of one scan over all images, by unit (block or group of blocks) and place within it."""

    def __init__(self, units: int, interval: np.ndarray):
        self.interval, self.units = interval, units  # interval: number of each unit's restart interval
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.place = 0

    def add(self, code: np.ndarray, size: np.ndarray, unit: np.ndarray | None = None) -> None:
        """One code for every unit, or for those given, behind all that was added before."""
        unit = np.arange(self.units) if unit is None else unit
        self.parts.append((code, size, unit))

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Stuffed bytes with a restart marker's room after each interval, and where each interval ends before it."""
        code, size, unit = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.argsort(unit, kind="stable")
        return _close(code[order], size[order], self.interval[unit[order]], int(self.interval[-1]) + 1)


def _close(code: np.ndarray, size: np.ndarray, interval: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.bincount(interval, weights=size, minlength=intervals).astype(np.int64)
    fill = -bits % 8
    at = np.searchsorted(interval, np.arange(intervals), "right")
    code = np.insert(code.astype(np.int64), at, (1 << fill) - 1)
    size = np.insert(size, at, fill)
    data = pack(code, size)
    ends = np.cumsum((bits + fill) // 8)
    full = data == 0xFF
    extra = np.cumsum(full)
    ends_stuffed = ends + np.concatenate([[0], extra])[ends]
    place = np.arange(len(data)) + extra - full + 2 * np.searchsorted(ends, np.arange(len(data)), "right")
    out = np.zeros(int(ends_stuffed[-1]) + 2 * intervals, np.uint8)
    out[place] = data
    return out, ends_stuffed + 2 * np.arange(intervals)


def _ac_first(stream_units: int, interval: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v: blocks x coefficients of one band."""
    code_of, size_of = AC.codes()
    unit, k = np.nonzero(v)
    value = v[unit, k]
    before = np.concatenate([[-1], k[:-1]])
    before[np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))] = -1
    run = k - before - 1
    size = _bit_length(np.abs(value))
    symbol = 16 * (run & 15) + size
    code = (code_of[symbol] << size.astype(np.uint64)) | _raw_bits(value, size)
    length = size_of[symbol] + size
    skips = run >> 4
    if skips.any():
        at = np.repeat(np.arange(len(unit)), skips)
        code = np.insert(code, at, code_of[0xF0])
        length = np.insert(length, at, size_of[0xF0])
        unit = np.insert(unit, at, unit[at])
    open_ = np.flatnonzero(v[:, -1] == 0)
    at = np.searchsorted(unit, open_, "right")
    code, length, unit = np.insert(code, at, code_of[0]), np.insert(length, at, size_of[0]), np.insert(unit, at, open_)
    return _close(code, length, interval[unit], int(interval[-1]) + 1)


def _ac_refine(v: np.ndarray, low: int, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit `low` of a band of at most 15 coefficients."""
    code_of, size_of = AC.codes()
    out = _Stream(len(v), interval)
    now, was = np.abs(v) >> low, np.abs(v) >> (low + 1)
    n = len(v)
    run, held, held_n = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(v.shape[1]):
        old, new = was[:, k] > 0, (was[:, k] == 0) & (now[:, k] == 1)
        held = np.where(old, held << 1 | (now[:, k] & 1), held)
        held_n += old
        symbol = 16 * run + 1
        code = ((code_of[symbol].astype(np.int64) << 1) | (v[:, k] > 0)) << held_n | held
        out.add(code, np.where(new, size_of[symbol] + 1 + held_n, 0))
        run = np.where(new, 0, run + (~old & ~new))
        held, held_n = np.where(new, 0, held), np.where(new, 0, held_n)
    rest = (run > 0) | (held_n > 0)
    out.add(int(code_of[0]) << held_n | held, np.where(rest, size_of[0] + held_n, 0))
    return out.bytes()


def _shift(v: np.ndarray, low: int) -> np.ndarray:
    return np.sign(v) * (np.abs(v) >> low)


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def shape_of(units: int) -> tuple[int, int]:
    """Blocks a row and rows for so many blocks."""
    wide = min(8191, max(64, -(-units // 8191)))
    return (min(units, wide), -(-units // wide)) if units <= 8191 * 8191 else (0, 0)


def encode(images: list[np.ndarray], notes: list[bytes]) -> list[bytes]:
    """Each image: rows x columns x 3 components x 64 quantised coefficients in zigzag order, from -1023 to 1023."""
    if not images:
        return []
    counts = np.array([im.shape[0] * im.shape[1] for im in images])
    every = np.concatenate([im.reshape(-1, 3, 64) for im in images]).astype(np.int64)
    within = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = within % RESTART == 0
    interval = np.cumsum(starts) - 1
    per_image = -(-counts // RESTART)
    last = np.cumsum(per_image) - 1
    number = np.arange(int(per_image.sum())) - np.repeat(last + 1 - per_image, per_image)
    dc_code, dc_size = DC.codes()
    scans = []
    for components, first, end, high, low in SCRIPT:
        if first == 0 and high == 0:
            v = every[:, :, 0] >> low
            diff = v - np.where(starts[:, None], 0, np.concatenate([np.zeros((1, 3), np.int64), v[:-1]]))
            size = _bit_length(np.abs(diff))
            code = (dc_code[size] << size.astype(np.uint64)) | _raw_bits(diff, size)
            got = _close(code.reshape(-1), (dc_size[size] + size).reshape(-1), np.repeat(interval, 3), len(number))
        elif first == 0:
            got = _close((every[:, :, 0] >> low & 1).reshape(-1), np.ones(3 * len(every), np.int64), np.repeat(interval, 3), len(number))
        elif high == 0:
            got = _ac_first(len(every), interval, _shift(every[:, components[0], first : end + 1], low))
        else:
            got = _ac_refine(every[:, components[0], first : end + 1], low, interval)
        data, ends = got
        data[ends], data[ends + 1] = 0xFF, 0xD0 + number % 8
        head = _marker(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), first, end, 16 * high + low]))
        begin = np.concatenate([[0], ends[last[:-1]] + 2])
        scans.append((head, data.tobytes(), begin.tolist(), ends[last].tolist()))
    quant = _marker(0xDB, bytes([0]) + bytes([1] * 64))
    tables = _marker(0xC4, bytes([0x00]) + DC.lengths + DC.symbols) + _marker(0xC4, bytes([0x10]) + AC.lengths + AC.symbols)
    restart = _marker(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, (im, note) in enumerate(zip(images, notes, strict=True)):
        size = _marker(0xC2, struct.pack(">BHHB", 8, 8 * im.shape[0], 8 * im.shape[1], 3) + bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0)))
        body = [head + data[a[i] : b[i]] for head, data, a, b in scans]
        out.append(b"".join([b"\xff\xd8", _marker(0xFE, note), quant, size, tables, restart, *body, b"\xff\xd9"]))
    return out


# ---- reading -----------------------------------------------------------------------------------


@dataclass
class Image:
    height: int = 0
    width: int = 0
    note: bytes = b""
    progressive: bool = True
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical factor, table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    coefficients: list[np.ndarray] = field(default_factory=list)  # of each component: rows x columns x 64, zigzag order

    def grid(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks that the component itself fills."""
        h, v = max(x[1] for x in self.components), max(x[2] for x in self.components)
        _, ch, cv, _ = self.components[c]
        return -(-(-(-self.height * cv // v)) // 8), -(-(-(-self.width * ch // h)) // 8)

    def units(self) -> tuple[int, int]:
        h, v = max(x[1] for x in self.components), max(x[2] for x in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


@dataclass
class _Scan:
    image: int
    components: tuple[int, ...]
    tables: tuple[tuple[Huffman | None, Huffman | None], ...]
    band: tuple[int, int, int, int]
    restart: int
    data: bytes


def _parse(number: int, data: bytes) -> tuple[Image, list[_Scan]]:
    im, scans, tables, restart, at = Image(), [], {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            break
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xFE:
            im.note = body
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                im.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                count = sum(body[k + 1 : k + 17])
                tables[body[k]] = Huffman(body[k + 1 : k + 17], body[k + 17 : k + 17 + count])
                k += 17 + count
        elif kind == 0xC2:
            im.height, im.width = struct.unpack_from(">HH", body, 1)
            im.components = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
            rows, cols = im.units()
            im.coefficients = [np.zeros((rows * v, cols * h, 64), np.int32) for _, h, v, _ in im.components]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman-coded images are read")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            chosen = [(next(i for i, c in enumerate(im.components) if c[0] == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(body[0])]
            first, end, bits = body[-3:]
            stop = at
            while True:
                stop = data.index(b"\xff", stop)
                if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                    continue
                break
            scans.append(_Scan(number, tuple(c for c, _ in chosen), tuple((tables.get(t >> 4), tables.get(16 + (t & 15))) for _, t in chosen), (first, end, bits >> 4, bits & 15), restart, data[at:stop]))
            at = stop
    return im, scans


def _blocks_of(height: int, width: int, shape: tuple[tuple[int, int, int, int], ...], components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a scan, in order: block (from the image's first one) and place in `components`; blocks a unit."""
    im = Image(height, width, components=list(shape))
    rows, cols = im.units()
    sizes = [rows * v * cols * h for _, h, v, _ in shape]
    offsets = [sum(sizes[:c]) for c in range(len(shape))]
    if len(components) == 1:
        c = components[0]
        high, wide = im.grid(c)
        at = offsets[c] + (np.arange(high)[:, None] * (cols * shape[c][1]) + np.arange(wide)[None, :]).reshape(-1)
        return at, np.zeros(len(at), np.int64), 1
    parts, place = [], []
    for j, c in enumerate(components):
        _, h, v, _ = shape[c]
        y = np.arange(rows)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
        x = np.arange(cols)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
        parts.append((offsets[c] + y * (cols * h) + x).reshape(rows * cols, h * v))
        place += [j] * (h * v)
    at = np.concatenate(parts, axis=1)
    return at.reshape(-1), np.tile(np.array(place), rows * cols), len(place)


_known_blocks = lru_cache(2048)(_blocks_of)


class _Reader:
    """Streams over one buffer: each has a bit position."""

    def __init__(self, data: bytes, begin: np.ndarray):
        wide = np.frombuffer(data + b"\xff" * 16, np.uint8).astype(np.uint64)
        window = np.zeros(len(wide) - 8, np.uint64)
        for j in range(8):
            window |= wide[j : j + len(window)] << np.uint64(56 - 8 * j)
        self.window, self.at = window, begin * 8

    def peek(self, who: np.ndarray) -> np.ndarray:
        """The next 57 bits, uppermost."""
        at = self.at[who]
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def bits(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        got = self.peek(who) >> np.uint64(1) >> (63 - n).astype(np.uint64)
        self.at[who] += n
        return got.astype(np.int64)

    def symbol(self, who: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        next_ = (self.peek(who) >> np.uint64(48)).astype(np.int64)
        length = table[1][next_]
        if not length.all():
            raise ValueError("damaged data: no such code")
        self.at[who] += length
        return table[0][next_]

    def number(self, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = self.bits(who, size)
        return np.where(raw < (np.int64(1) << size >> 1), raw - (np.int64(1) << size) + 1, raw)


def _split(scan: _Scan) -> list[bytes]:
    """The restart intervals of a scan, without stuffing."""
    return [p.replace(b"\xff\x00", b"\xff") for p in RESTARTS.split(scan.data)]


def _run_scans(scans: list[_Scan], images: list[Image], store: np.ndarray, offsets: list[int]) -> None:
    """Scans of one kind, each of another image."""
    parts, blocks, places, firsts, counts = [], [], [], [], []
    total = 0
    for s in scans:
        im = images[s.image]
        known = _known_blocks if im.height * im.width < 1 << 18 else _blocks_of  # small images often have the same size
        at, place, unit = known(im.height, im.width, tuple(im.components), s.components)
        step = s.restart * unit if s.restart else len(at)
        pieces = _split(s)
        begin = np.arange(0, len(at), step)
        if len(pieces) != len(begin):
            raise ValueError("damaged data: intervals are missing")
        parts += pieces
        firsts.append(begin + total)
        counts.append(np.minimum(step, len(at) - begin))
        blocks.append(at + offsets[s.image])
        places.append(place)
        total += len(at)
    lengths = np.array([len(p) for p in parts])
    reader = _Reader(b"".join(p + b"\xff\xff\xff\xff" for p in parts), np.cumsum(lengths + 4) - lengths - 4)
    block, place, first, count = (np.concatenate(x) for x in (blocks, places, firsts, counts))
    low_end, high_end, high, low = scans[0].band
    if low_end == 0:
        _dc(reader, store, block, place, first, count, [_lookup(t[0]) if t[0] else None for t in scans[0].tables], high, low)
    elif high == 0:
        _ac(reader, store, block, first, count, _lookup(scans[0].tables[0][1]), low_end, high_end, low)
    else:
        _refine(reader, store, block, first, count, _lookup(scans[0].tables[0][1]), low_end, high_end, low)


def _dc(reader, store, block, place, first, count, tables, high, low) -> None:
    before = np.zeros((len(first), len(tables)), np.int64)
    for j in range(int(count.max(initial=0))):
        who = np.flatnonzero(count > j)
        row = block[first[who] + j]
        if high:
            store[row, 0] |= reader.bits(who, np.ones(len(who), np.int64)).astype(np.int32) << low
            continue
        for c in range(len(tables)):
            here = place[first[who] + j] == c
            some = who if here.all() else who[here]
            if len(some):
                before[some, c] += reader.number(some, reader.symbol(some, tables[c]))
                store[row if here.all() else row[here], 0] = before[some, c] << low


def _ac(reader, store, block, first, count, table, start, end, low) -> None:
    at, stop = first.copy(), first + count
    k = np.full(len(first), start)
    who = np.flatnonzero(at < stop)
    while len(who):
        symbol = reader.symbol(who, table)
        run, size = symbol >> 4, symbol & 15
        new = size > 0
        over = ~new & (run < 15)
        if over.any():
            ended = who[over]
            at[ended] += (1 << run[over]) + reader.bits(ended, run[over])
            k[ended] = start
            some = new | (run == 15)
            who_, run, size, new = who[some], run[some], size[some], new[some]
        else:
            who_ = who
        k[who_] += run + ~new
        if not new.all():
            who_, size = who_[new], size[new]
        if len(who_):
            value = reader.number(who_, size)
            place = k[who_]
            if (place > end).any():
                raise ValueError("damaged data: beyond the band")
            store[block[at[who_]], place] = value << low
            k[who_] = place + 1
        full = who[k[who] > end]
        at[full] += 1
        k[full] = start
        who = who[at[who] < stop[who]]


def _refine(reader, store, block, first, count, table, start, end, low) -> None:
    n = len(first)
    at, stop, k = first.copy(), first + count, np.full(len(first), start)
    run, value, blocks_left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)  # run -1: a symbol is due
    who = np.flatnonzero(at < stop)
    while len(who):
        due = who[(run[who] < 0) & (blocks_left[who] == 0)]
        if len(due):
            symbol = reader.symbol(due, table)
            r, s = symbol >> 4, symbol & 15
            new = s > 0
            value[due] = 0
            if new.any():
                value[due[new]] = np.where(reader.bits(due[new], np.ones(int(new.sum()), np.int64)) > 0, 1, -1) << low
            over = ~new & (r < 15)
            if over.any():
                blocks_left[due[over]] = (1 << r[over]) + reader.bits(due[over], r[over])
            run[due] = np.where(over, -1, r)
        row, place = block[at[who]], k[who]
        held = store[row, place]
        old = held != 0
        if old.any():
            bit = reader.bits(who[old], np.ones(int(old.sum()), np.int64))
            store[row[old], place[old]] += (np.sign(held[old]) * (bit << low)).astype(np.int32)
        zero = ~old & (blocks_left[who] == 0)
        put = zero & (run[who] == 0)
        store[row[put], place[put]] = value[who[put]]
        run[who[zero]] -= 1
        k[who] += 1
        full = who[k[who] > end]
        at[full] += 1
        k[full] = start
        run[full] = -1
        blocks_left[full] = np.maximum(0, blocks_left[full] - 1)
        who = who[at[who] < stop[who]]


def decode(files: list[bytes]) -> list[Image]:
    """Images with all their scans accumulated."""
    parsed = [_parse(i, f) for i, f in enumerate(files)]
    images = [im for im, _ in parsed]
    counts = [sum(c.shape[0] * c.shape[1] for c in im.coefficients) for im in images]
    offsets = np.cumsum([0, *counts])[:-1].tolist()
    store = np.zeros((sum(counts), 64), np.int32)
    for step in range(max((len(s) for _, s in parsed), default=0)):
        alike = defaultdict(list)
        for _, scans in parsed:
            if step < len(scans):
                s = scans[step]
                alike[len(s.components), s.tables, s.band].append(s)
        for group in alike.values():
            _run_scans(group, images, store, offsets)
    for im, at in zip(images, offsets, strict=True):
        planes = []
        for c in im.coefficients:
            n = c.shape[0] * c.shape[1]
            planes.append(store[at : at + n].reshape(c.shape))
            at += n
        im.coefficients = planes
    return images


def inverse_basis() -> np.ndarray:
    """64 x 64: from coefficients in zigzag order to samples in raster order."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ay,bx->abyx", one, one).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


INVERSE = inverse_basis()


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (0 to 255, not rounded) of blocks, in raster order."""
    return np.clip((blocks * quant).astype(np.float32) @ INVERSE + np.float32(128), 0, 255)


def _plane(im: Image, c: int) -> np.ndarray:
    blocks = im.coefficients[c]
    rows, cols = blocks.shape[:2]
    plane = samples(blocks.reshape(-1, 64), im.quant[im.components[c][3]]).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
    h, v = max(x[1] for x in im.components), max(x[2] for x in im.components)
    _, ch, cv, _ = im.components[c]
    return plane.repeat(v // cv, axis=0).repeat(h // ch, axis=1)[: im.height, : im.width]


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - np.float32(128), cr - np.float32(128)
    rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def rgb(im: Image) -> np.ndarray:
    """height x width x 3, whole resolution; a grey image has three equal channels."""
    planes = [_plane(im, c) for c in range(len(im.components))]
    return to_rgb(*planes) if len(planes) == 3 else np.repeat(np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
