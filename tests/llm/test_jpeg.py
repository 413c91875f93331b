"""The image codec against a plain decoder that reads bit by bit, and images with subsampled chroma."""

import struct

import numpy as np
import pytest

from vespera.llm import progressive_jpeg as jpeg


class Bits:
    def __init__(self, data):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def number(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table):
        code, n = 0, 0
        while (n, code) not in table:
            code, n = code << 1 | self.take(1), n + 1
        return table[n, code]


def tables_of(body):
    out, k = {}, 0
    while k < len(body):
        counts, s, code, table = body[k + 1 : k + 17], k + 17, 0, {}
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                table[n, code] = body[s]
                s, code = s + 1, code + 1
            code <<= 1
        out[body[k]] = table
        k = s
    return out


def plain(data):
    """Coefficients of each component as {(row, column): [64]}, one sequential pass after another."""
    at, tables, restart, comps, coef = 2, {}, 0, [], {}
    while data[at + 1] != 0xD9:
        kind, (n,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC4:
            tables |= tables_of(body)
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xC2:
            high, wide = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(body[5])]
            hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
        elif kind == 0xDA:
            mine = [([c[0] for c in comps].index(body[1 + 2 * j]), body[2 + 2 * j]) for j in range(body[0])]
            first, end, hl = body[-3:]
            stop = at
            while data[stop] != 0xFF or data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                stop += 1
            raw, pieces, i = data[at:stop], [bytearray()], 0
            while i < len(raw):
                if raw[i] == 0xFF:
                    if raw[i + 1]:
                        pieces.append(bytearray())
                    else:
                        pieces[-1].append(0xFF)
                    i += 2
                else:
                    pieces[-1].append(raw[i])
                    i += 1
            at = stop
            if len(mine) == 1:
                c = mine[0][0]
                rows, cols = (-(-(-(-s * f // m)) // 8) for s, f, m in ((high, comps[c][2], vm), (wide, comps[c][1], hm)))
                units = [[(0, y, x)] for y in range(rows) for x in range(cols)]
            else:
                units = [[(j, y * comps[c][2] + v, x * comps[c][1] + h) for j, (c, _) in enumerate(mine) for v in range(comps[c][2]) for h in range(comps[c][1])] for y in range(-(-high // (8 * vm))) for x in range(-(-wide // (8 * hm)))]
            step = restart or len(units)
            for piece, start in zip(pieces, range(0, len(units), step), strict=True):
                scan(Bits(bytes(piece)), units[start : start + step], mine, tables, first, end, hl >> 4, hl & 15, coef)
    return coef


def scan(bits, units, mine, tables, first, end, high, low, coef):
    before, run = [0] * len(mine), 0
    for unit in units:
        for j, y, x in unit:
            c, t = mine[j]
            block = coef.setdefault((c, y, x), [0] * 64)
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    before[j] += bits.number(bits.symbol(tables[t >> 4]))
                    block[0] = before[j] << low
                continue
            table, k = tables[16 + (t & 15)], first
            if not high:
                if run:
                    run -= 1
                    continue
                while k <= end:
                    r, s = divmod(bits.symbol(table), 16)
                    if s:
                        k += r
                        block[k] = bits.number(s) << low
                        k += 1
                    elif r == 15:
                        k += 16
                    else:
                        run = (1 << r) + bits.take(r) - 1
                        break
                continue
            while k <= end and not run:
                r, s = divmod(bits.symbol(table), 16)
                value = 0
                if s:
                    value = (1 if bits.take(1) else -1) << low
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= end:
                    if block[k]:
                        if bits.take(1):
                            block[k] += (1 if block[k] > 0 else -1) << low
                    elif r == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            if run:
                while k <= end:
                    if block[k] and bits.take(1):
                        block[k] += (1 if block[k] > 0 else -1) << low
                    k += 1
                run -= 1


def images(seed, n=12):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        wide, high = jpeg.shape_of(int(rng.integers(1, 90)))
        shape = (high, wide, 3, 64)
        dense, small = rng.integers(-128, 128, shape), rng.integers(-2, 3, shape)
        sparse = (rng.random(shape) < 0.03) * rng.integers(-1023, 1024, shape)
        out.append((dense, small, sparse, np.zeros(shape, int))[i % 4])
    return out


def test_round_trip_and_plain_decoder():
    ims = images(1)
    files = jpeg.encode(ims, [b"%d" % i for i in range(len(ims))])
    for i, (im, out, f) in enumerate(zip(ims, jpeg.decode(files), files, strict=True)):
        assert (np.stack(out.coefficients, axis=2) == im).all() and out.note == b"%d" % i
        other = plain(f)
        assert all((np.array(other[c, y, x]) == im[y, x, c]).all() for c in range(3) for y in range(im.shape[0]) for x in range(im.shape[1]))


def assemble(high, wide, factors, scans, restart=0):
    quant = jpeg._marker(0xDB, bytes([0]) + bytes([2] * 64))
    frame = jpeg._marker(0xC2, struct.pack(">BHHB", 8, high, wide, len(factors)) + bytes(x for i, (h, v) in enumerate(factors) for x in (i + 1, 16 * h + v, 0)))
    tables = jpeg._marker(0xC4, bytes([0]) + jpeg.DC.lengths + jpeg.DC.symbols) + jpeg._marker(0xC4, bytes([16]) + AC_RUNS.lengths + AC_RUNS.symbols)
    parts = [jpeg._marker(0xDA, bytes([len(cs), *(x for c in cs for x in (c + 1, 0)), a, b, 16 * h + low]) ) + data for cs, a, b, h, low, data in scans]
    return b"\xff\xd8" + quant + frame + tables + b"".join(parts) + b"\xff\xd9"


AC_RUNS = jpeg.Huffman.of({8: [16 * r for r in range(15)] + [0xF0], 9: [16 * r + s for r in range(16) for s in range(1, 11)]})


def coded(items):
    """(code and size) pairs and raw bits as stuffed bytes."""
    bits = "".join(f"{int(c):0{n}b}" if n else "" for c, n in items)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def dc_items(values):
    code, size = jpeg.DC.codes()
    out, before = [], {}
    for c, v in values:
        d = v - before.get(c, 0)
        before[c] = v
        n = abs(d).bit_length()
        out += [(code[n], size[n]), (d if d >= 0 else d + (1 << n) - 1, n)]
    return out


def test_subsampled_chroma_and_runs_of_empty_blocks():
    code, size = AC_RUNS.codes()
    sym = lambda s: (code[s], size[s])
    high, wide = 20, 40  # 2 x 3 units of 16 x 16; luma fills 3 x 5 blocks of 4 x 6
    luma = {(y, x): 10 * y + x for y in range(4) for x in range(6)}
    order = [(0, luma[2 * uy + v, 2 * ux + h]) if j == 0 else (j, 7 * j + uy + ux) for uy in range(2) for ux in range(3) for j, v, h in [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0)]]
    blocks = 15
    # AC of luma: the first block has coefficient 20 = 3 << 1 (by a run of 16 and 3), then 14 blocks in one run of empty blocks
    ac = [sym(0xF0), sym(16 * 3 + 2), (3, 2), sym(16 * 3), (blocks - 8 - 0, 3)]
    # its last bit: coefficient 20 becomes 7, coefficient 2 of the second block becomes -1, the rest stays empty
    refine = [sym(0x00), (1, 1), sym(16 * 1 + 1), (0, 1), sym(16 * 3), (14 - 8, 3)]
    scans = [((0, 1, 2), 0, 0, 0, 0, coded(dc_items(order))), ((0,), 1, 63, 0, 1, coded([*ac])), ((0,), 1, 63, 1, 0, coded(refine))]
    data = assemble(high, wide, [(2, 2), (1, 1), (1, 1)], scans)
    im, other = jpeg.decode([data])[0], plain(data)
    for (c, y, x), block in other.items():
        assert (im.coefficients[c][y, x] == block).all(), (c, y, x)
    assert im.coefficients[0][0, 0, 20] == 7 and im.coefficients[0][0, 1, 2] == -1
    tensor = jpeg.rgb(im)
    assert tensor.shape == (20, 40, 3)
    cb = np.clip(jpeg.samples(im.coefficients[1].reshape(-1, 64), im.quant[0]).reshape(2, 3, 8, 8).transpose(0, 2, 1, 3).reshape(16, 24), 0, 255)
    assert (cb.repeat(2, axis=0).repeat(2, axis=1)[:20, :40] == jpeg._plane(im, 1)).all()


def test_inverse_transform():
    rng = np.random.default_rng(2)
    block = np.zeros(64)
    block[rng.integers(0, 64, 6)] = rng.integers(-60, 60, 6)
    raster = np.zeros((8, 8))
    raster.reshape(-1)[jpeg.ZIGZAG] = block
    k = lambda u: np.sqrt(1 / 8) if u == 0 else 0.5
    want = [[128 + sum(k(u) * k(v) * raster[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(jpeg.samples(block[None], np.ones(64)).reshape(8, 8), np.clip(want, 0, 255), atol=1e-3)


def test_faults():
    good = jpeg.encode(images(3, 1), [b""])[0]
    for bad in (b"GIF8", good.replace(b"\xff\xc2", b"\xff\xc0"), good[:400] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError, KeyError, struct.error)):
            jpeg.decode([bad])
