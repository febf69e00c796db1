"""Progressive JPEG: coefficients in scans, RGB tensors out, and payloads stored without loss.

``decode`` reads a progressive file (Huffman, 8 bits, baseline frame layout):
scans by spectral selection and successive approximation accumulate into one
coefficient array a component, which is then dequantised, inverse-transformed
in numpy with an integer-scaled basis (sums are exact, so a result does not
depend on what is computed beside it), upsampled by repetition and converted
to an RGB tensor at full resolution. Scans whose restart interval is one unit
are decoded for all units of many files at once, symbol by symbol in lockstep;
any other scan is decoded by a plain bit reader.

``encode_payloads`` stores bytes in the format's own unit, the quantised
coefficient: 64 bytes make a block, byte minus 96 its coefficients in zigzag
order, six blocks a 4:2:0 unit (four luma, two chroma; missing ones are zero),
all quantisers 1. The script is DC with one bit held back, its refinement,
luma 1-5 with one bit held back, its refinement, luma 6-63, and both chroma
bands. A comment holds the payload's length. A payload of more than PICTURE bytes
becomes several pictures, one file after the other in one value, which are
written and read one at a time: memory does not grow with a text's pixels.

Null text is empty; every payload is padded with zero bytes to a positive
multiple of 64. Ids may be null or repeat; extra columns are ignored; equal
texts give equal files and values.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import lean, small_batches, table, text_chunks, text_or_empty

#: Fixed values of the format: zigzag position -> row-major position.
ZIGZAG = np.array([i * 8 + j for s in range(15) for i, j in ([(k, s - k) for k in range(8) if 0 <= s - k < 8] if s % 2 else [(s - k, k) for k in range(8) if 0 <= s - k < 8])])
SHIFT = 96
#: Bytes of texts or files worked on at once.
CHUNK = 384 << 10
#: Most payload bytes of one picture (whole 4:2:0 units).
PICTURE = 384 << 10
#: (components, first, last, high, low) of each scan written.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 0, 1), ((0,), 1, 5, 1, 0), ((0,), 6, 63, 0, 0), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0)]
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_BASIS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)
#: Inverse transform of zigzag coefficients to row-major samples, times 8192, in whole numbers.
INVERSE = np.round(np.kron(_BASIS, _BASIS) * 8192)[:, ZIGZAG].T.copy()


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths of the tables written: DC categories, AC run/size symbols."""
    ac = {0x00: 5, 0xF0: 8}
    for run in range(16):
        for size in range(1, 11):
            ac[run << 4 | size] = 4 if run == 0 and size <= 8 else 6 if run == 1 and size <= 8 else 9
    return {size: 4 for size in range(12)}, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as the file has it, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    return bytes(counts) + bytes(order), _codes(counts, order)


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    code, out, at = 0, {}, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


_DC_LEN, _AC_LEN = _code_lengths()
_DC_TABLE, _DC = _canonical(_DC_LEN)
_AC_TABLE, _AC = _canonical(_AC_LEN)


def _arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], size[s] = c, n
    return code, size


_DC_CODE, _DC_SIZE = _arrays(_DC)
_AC_CODE, _AC_SIZE = _arrays(_AC)
_CATEGORY = np.array([int(v).bit_length() for v in range(2048)])


def _lookup(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits; length 0 is no code."""
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes(counts, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        size[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, size


# --- writing -----------------------------------------------------------------


def _segment(h: list[tuple]) -> bytes:
    return b"".join(b"\xff" + bytes([m]) + (struct.pack(">H", len(d) + 2) + d if d is not None else b"") for m, d in h)


def _pack(value: np.ndarray, bits: np.ndarray, unit: np.ndarray, units: int, last_of_scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all units, restart markers after each but a scan's last; and the end of each unit.

    Tokens (value, bits) are in the order of units. ``last_of_scan`` marks units, and gives markers their numbers.
    """
    total = np.bincount(unit, weights=bits, minlength=units).astype(np.int64)
    pad = -total % 8
    size = (total + pad) // 8
    begin = np.cumsum(size) - size
    inside = np.cumsum(bits) - bits
    first = np.searchsorted(unit, np.arange(units))
    at = begin[unit] * 8 + inside - np.append(inside, 0)[first][unit]
    value = np.concatenate((value, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)))
    at = np.concatenate((at, begin * 8 + total))
    bits = np.concatenate((bits, pad))
    word, off = at >> 6, at & 63
    room = 64 - off - bits
    words = np.zeros(int(size.sum()) // 8 + 3, np.uint64)
    fits = room >= 0
    high = np.where(fits, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    n = len(unit)  # two ordered runs: tokens, then pads
    for a, b in ((0, n), (n, len(at))):
        if b > a:
            start = np.flatnonzero(np.concatenate(([True], word[a + 1 : b] != word[a : b - 1])))
            words[word[a:b][start]] += np.add.reduceat(high[a:b], start)
    over = ~fits
    words[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    raw = words.astype(">u8").view(np.uint8)[: int(size.sum())]
    ff = raw == 255
    extra = np.zeros(len(raw), np.int64)
    ends = begin + size - 1
    marked = ~last_of_scan
    extra[ends[marked]] = 2
    place = np.cumsum(1 + ff + extra) - 1 - ff - extra
    out = np.zeros(len(raw) + int(ff.sum()) + 2 * int(marked.sum()), np.uint8)
    out[place] = raw
    stop = place[ends] + 1 + ff[ends]
    number = np.arange(units) - np.maximum.accumulate(np.where(np.concatenate(([True], last_of_scan[:-1])), np.arange(units), 0))
    out[stop[marked]] = 255
    out[stop[marked] + 1] = 0xD0 + number[marked] % 8
    return out, stop + 2 * marked


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and appended bits of signed values."""
    size = _CATEGORY[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _write_first(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a first AC scan over a band (unit, coefficient)."""
    n, band = blocks.shape
    unit, k = np.nonzero(blocks)
    v = blocks[unit, k].astype(np.int64)
    before = np.full(len(k), -1)
    same = unit[1:] == unit[:-1]
    before[1:][same] = k[:-1][same]
    run = k - before - 1
    size, extra = _magnitude(v)
    symbol = (run % 16) << 4 | size
    value, bits = _AC_CODE[symbol] << size.astype(np.uint64) | extra, _AC_SIZE[symbol] + size
    for more in (1, 2, 3):
        far = run >= 16 * more
        value[far] |= _AC_CODE[0xF0] << bits[far].astype(np.uint64)
        bits[far] += _AC_SIZE[0xF0]
    last = np.full(n, -1)
    last[unit] = k  # positions ascend within a unit
    end = np.flatnonzero(last < band - 1)
    value = np.concatenate((value, np.full(len(end), _AC_CODE[0], np.uint64)))
    bits = np.concatenate((bits, np.full(len(end), _AC_SIZE[0])))
    unit = np.concatenate((unit, end))
    order = np.argsort(unit, kind="stable")
    return value[order], bits[order], unit[order]


def _write_refined(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of an AC refinement by the last bit, over a band of fewer than 16 coefficients."""
    n, band = blocks.shape
    size = np.abs(blocks).astype(np.int64)
    held, held_bits, run = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    tokens = []
    units = np.arange(n)
    for k in range(band):
        old, new = size[:, k] > 1, size[:, k] == 1
        held[old] = held[old] << np.uint64(1) | (size[old, k] & 1).astype(np.uint64)
        held_bits[old] += 1
        symbol = run[new] << 4 | 1
        sign = (blocks[new, k] > 0).astype(np.uint64)
        hb = held_bits[new].astype(np.uint64)
        tokens.append(((_AC_CODE[symbol] << np.uint64(1) | sign) << hb | held[new], _AC_SIZE[symbol] + 1 + held_bits[new], units[new]))
        run[~old & ~new] += 1
        run[new], held[new], held_bits[new] = 0, 0, 0
    rest = (run > 0) | (held_bits > 0)
    tokens.append((_AC_CODE[0] << held_bits[rest].astype(np.uint64) | held[rest], _AC_SIZE[0] + held_bits[rest], units[rest]))
    value, bits, unit = (np.concatenate(x) for x in zip(*tokens))
    order = np.argsort(unit, kind="stable")
    return value[order], bits[order], unit[order]


def _layout(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 16-pixel units."""
    units = -(-n_blocks // 6)
    across = min(units, max(64, -(-units // 4000)))
    return across, -(-units // across)


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive file for each payload (each a positive multiple of 64 bytes)."""
    shapes = [_layout(len(p) // 64) for p in payloads]
    units = np.array([a * b for a, b in shapes])
    flat = np.zeros((int(units.sum()), 6, 64), np.int16)
    at = np.cumsum(units) - units
    for p, a, n in zip(payloads, at, units):
        flat[a : a + n].reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - SHIFT
    luma = np.concatenate([flat[a : a + n, :4].reshape(r, c, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for a, n, (c, r) in zip(at, units, shapes)])
    planes = [luma, np.ascontiguousarray(flat[:, 4]), np.ascontiguousarray(flat[:, 5])]
    bodies = []
    for comps, first, last, high, low in SCRIPT:
        if first == 0:
            dc = flat[:, :, 0].astype(np.int64)
            many = len(flat)
            if high:
                value, bits, unit = (dc & 1).reshape(-1).astype(np.uint64), np.ones(6 * many, np.int64), np.repeat(np.arange(many), 6)
            else:
                dc = dc >> low
                diff = dc.copy()
                diff[:, 1:4] -= dc[:, :3]
                size, extra = _magnitude(diff.reshape(-1))
                value, bits, unit = _DC_CODE[size] << size.astype(np.uint64) | extra, _DC_SIZE[size] + size, np.repeat(np.arange(many), 6)
            per = units
        else:
            plane = planes[comps[0]][:, first : last + 1]
            many = len(plane)
            per = units * (4 if comps[0] == 0 else 1)
            value, bits, unit = _write_refined(plane) if high else _write_first(np.sign(plane) * (np.abs(plane) >> low) if low else plane)
        ends = np.cumsum(per)
        lasts = np.zeros(many, bool)
        lasts[ends - 1] = True
        data, stop = _pack(value, bits, unit, many, lasts)
        cuts = np.concatenate(([0], stop[ends - 1]))
        data = data.tobytes()
        head = _segment([(0xDD, struct.pack(">H", 1)), (0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), first, last, high << 4 | low]))])
        bodies.append([head + data[a:b] for a, b in zip(cuts, cuts[1:])])
    tables = _segment([(0xDB, b"\0" + bytes([1]) * 64), (0xC4, b"\x00" + _DC_TABLE), (0xC4, b"\x10" + _AC_TABLE)])
    files = []
    for i, (p, (c, r)) in enumerate(zip(payloads, shapes)):
        frame = struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        files.append(_segment([(0xD8, None), (0xFE, b"payload %d" % len(p))]) + tables + _segment([(0xC2, frame)]) + b"".join(b[i] for b in bodies) + b"\xff\xd9")
    return files


# --- reading -----------------------------------------------------------------


class Picture:
    """A parsed file: frame, quantisers, comments and scans; coefficients once decoded."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[dict] = []
        self.comments: list[bytes] = []
        tables: dict[int, tuple] = {}
        at, interval = 2, 0
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            size = data[at] << 8 | data[at + 1]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide, body = body[0] >> 4, body
                    n = 129 if wide else 65
                    self.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[n:]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xC2:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.coef = [np.zeros((self.down * v, self.across * h, 64), np.int16) for _, h, v, _ in self.parts]
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
                raise ValueError("only progressive Huffman frames are read")
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                ids = [p[0] for p in self.parts]
                comps = tuple(ids.index(body[1 + 2 * i]) for i in range(body[0]))
                first, last, bits = body[-3:]
                used = tuple(tables.get(0x10 | body[2 + 2 * i] & 15 if first else body[2 + 2 * i] >> 4, b"") for i in range(body[0]))
                end = _END.search(data, at).start()
                self.scans.append({"comps": comps, "band": (first, last), "high": bits >> 4, "low": bits & 15, "tables": used, "interval": interval, "data": data[at:end]})
                at = end

    def order(self, scan: dict) -> tuple[list[np.ndarray], int]:
        """(per slot of a unit: component, rows, columns of its block in each unit), units."""
        if len(scan["comps"]) == 1:
            _, h, v, _ = self.parts[scan["comps"][0]]
            rows = -(-(-(-self.height * v // self.vmax)) // 8)
            cols = -(-(-(-self.width * h // self.hmax)) // 8)
            r, c = np.divmod(np.arange(rows * cols), cols)
            return [(scan["comps"][0], r, c)], rows * cols
        r, c = np.divmod(np.arange(self.down * self.across), self.across)
        return [(i, r * self.parts[i][2] + y, c * self.parts[i][1] + x) for i in scan["comps"] for y in range(self.parts[i][2]) for x in range(self.parts[i][1])], len(r)

    def planes(self) -> list[np.ndarray]:
        """8-bit samples of each component at full resolution."""
        out = []
        for coef, (_, h, v, q) in zip(self.coef, self.parts):
            rows, cols, _ = coef.shape
            x = (coef.reshape(-1, 64) * self.quant[q]).astype(np.float64) @ INVERSE
            x = np.clip(np.floor(x / 8192 + 0.5) + 128, 0, 255).astype(np.uint8)
            x = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            if h < self.hmax or v < self.vmax:
                x = x.repeat(self.vmax // v, axis=0).repeat(self.hmax // h, axis=1)
            out.append(x[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = (p.astype(np.int32) for p in planes)
        cb -= 128
        cr -= 128
        half = 1 << 15
        out = np.empty((*y.shape, 3), np.uint8)
        out[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        out[:, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        return out


def _units(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers, and where each restart unit begins in them."""
    raw = np.frombuffer(b"".join(datas), np.uint8)
    ff = np.concatenate((raw[:-1] == 255, [False]))
    after = np.concatenate((raw[1:], [0]))
    marker = ff & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(raw), bool)
    drop[1:] = (ff & (after == 0))[:-1] | marker[:-1]
    drop |= marker
    start = np.zeros(len(raw) + 2, bool)
    start[np.flatnonzero(marker) + 2] = True
    start[np.cumsum([0] + [len(d) for d in datas[:-1]])] = True
    kept = np.cumsum(~drop)
    begin = np.flatnonzero(start[: len(raw)])
    return raw[~drop], np.where(begin > 0, kept[begin - 1], 0)


class _Bits:
    """Reads of many units in lockstep: 40-bit words at every byte."""

    def __init__(self, data: np.ndarray):
        x = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.int64)
        n = len(data) + 3
        self.word = x[:n] << 32 | x[1 : n + 1] << 24 | x[2 : n + 2] << 16 | x[3 : n + 3] << 8 | x[4 : n + 4]

    def symbol(self, pos: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, bits left in the word, word)."""
        word, left = self.word[pos >> 3], 40 - (pos & 7)
        peek = (word >> (left - 16)) & 0xFFFF
        return table[0][peek], left - table[1][peek], word

    def bit(self, pos: np.ndarray) -> np.ndarray:
        return (self.word[pos >> 3] >> (39 - (pos & 7))) & 1


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def _lockstep(scan: dict, data: np.ndarray, begin: np.ndarray, coef: np.ndarray, slots: list[int]) -> None:
    """Decode all units of one scan script into coef (unit, slot, 64); every unit is a restart interval."""
    bits, pos = _Bits(data), begin * 8
    (first, last), high, low = scan["band"], scan["high"], scan["low"]
    tables = [_lookup(list(t[:16]), list(t[16:])) if t else None for t in scan["tables"]]
    if first == 0 and high:
        for s in range(len(slots)):
            coef[:, s, 0] |= (bits.bit(pos) << low).astype(np.int16)
            pos = pos + 1
    elif first == 0:
        pred = {i: np.zeros(len(pos), np.int64) for i in set(slots)}
        for s, i in enumerate(slots):
            size, left, word = bits.symbol(pos, tables[scan["comps"].index(i)])
            value = (word >> (left - size)) & ((1 << size) - 1)
            pred[i] = pred[i] + np.where(size > 0, _extend(value, size), 0)
            coef[:, s, 0] = pred[i] << low
            pos = (pos & ~7) + 40 - (left - size)
    elif not high:
        k, own = np.full(len(pos), first), np.arange(len(pos))
        while len(own):
            symbol, left, word = bits.symbol(pos, tables[0])
            run, size = symbol >> 4, symbol & 15
            if (end := (size == 0) & (run < 15)).any():
                if (run[end] > 0).any():
                    raise ValueError("runs of ends in a restart interval of one block")
                go = ~end
                own, k, pos, left, word, run, size = own[go], k[go], pos[go], left[go], word[go], run[go], size[go]
            left = left - size
            value = _extend((word >> left) & ((1 << size) - 1), size)
            k = k + run
            zero = size == 0
            if zero.any():
                coef[own[~zero], 0, k[~zero]] = value[~zero] << low
            else:
                coef[own, 0, k] = value << low
            k = k + 1
            pos = (pos & ~7) + 40 - left
            if (done := k > last).any():
                go = ~done
                own, k, pos = own[go], k[go], pos[go]
    else:
        n, one = len(pos), 1 << low
        run, value, end = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(first, last + 1):
            ask = np.flatnonzero(~end & (run < 0))
            symbol, left, word = bits.symbol(pos[ask], tables[0])
            r, size = symbol >> 4, symbol & 15
            sign = (word >> (left - 1)) & 1
            value[ask] = np.where(size > 0, np.where(sign > 0, one, -one), 0)
            end[ask] = (size == 0) & (r < 15)
            run[ask] = np.where(end[ask], -1, r)
            pos[ask] = (pos[ask] & ~7) + 40 - left + (size > 0)
            old = coef[:, 0, k] != 0
            at = np.flatnonzero(old)
            fix = bits.bit(pos[at])
            coef[at, 0, k] += (np.sign(coef[at, 0, k]) * (fix << low)).astype(np.int16)
            pos[at] += 1
            here = ~old & ~end & (run == 0)
            coef[here, 0, k] = value[here]
            run[~old & ~end] -= 1


def _plain(picture: Picture, scan: dict) -> None:
    """Decode one scan with any restart interval and end runs, bit by bit."""
    slots, units = picture.order(scan)
    (first, last), high, low = scan["band"], scan["high"], scan["low"]
    codes = [{(n, c): s for s, (c, n) in _codes(list(t[:16]), list(t[16:])).items()} if t else {} for t in scan["tables"]]
    pieces = re.split(rb"\xff[\xd0-\xd7]", scan["data"])
    state: dict = {}

    def restart(piece: bytes) -> None:
        clean = piece.replace(b"\xff\x00", b"\xff")
        state.update(bits=np.unpackbits(np.frombuffer(clean, np.uint8)).tolist() + [0] * 64, at=0, ends=0, pred=[0] * len(picture.parts))

    def take(n: int = 1) -> int:
        value = 0
        for b in state["bits"][state["at"] : state["at"] + n]:
            value = value << 1 | b
        state["at"] += n
        return value

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(size: int) -> int:
        value = take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    for unit in range(units):
        if unit == 0 or scan["interval"] and unit % scan["interval"] == 0:
            restart(pieces[unit // scan["interval"] if scan["interval"] else 0])
        for i, rows, cols in slots:
            block = picture.coef[i][rows[unit], cols[unit]]
            table = codes[scan["comps"].index(i)]
            if first == 0:
                if high:
                    block[0] |= take() << low
                else:
                    state["pred"][i] += signed(symbol(table))
                    block[0] = state["pred"][i] << low
                continue
            k = first
            while k <= last and not state["ends"]:
                s = symbol(table)
                run, size = s >> 4, s & 15
                if size == 0 and run < 15:
                    state["ends"] = (1 << run) + take(run)
                    break
                if not high:
                    value = signed(size)
                    k += run
                    if size:
                        block[k] = value << low
                    k += 1
                    continue
                value = ((1 << low) if take() else -(1 << low)) if size else 0
                while k <= last:
                    if block[k]:
                        block[k] += (1 if block[k] > 0 else -1) * (take() << low)
                    elif run == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            if state["ends"]:
                if high:
                    for k in range(k, last + 1):
                        if block[k]:
                            block[k] += (1 if block[k] > 0 else -1) * (take() << low)
                state["ends"] -= 1


def decode(files: list[bytes], lockstep: bool = True) -> list[Picture]:
    """Pictures with their coefficients; scans of one script are decoded together, in the order of each file."""
    pictures = [Picture(f) for f in files]
    for step in range(max((len(p.scans) for p in pictures), default=0)):
        together: dict[tuple, list] = {}
        for p in pictures:
            if step < len(p.scans):
                s = p.scans[step]
                slots = [i for i, _, _ in p.order(s)[0]]
                key = (s["comps"], s["band"], s["high"], s["low"], s["tables"], tuple(slots))
                if lockstep and s["interval"] == 1:
                    together.setdefault(key, []).append((p, s))
                else:
                    _plain(p, s)
        for (*_, slots), own in together.items():
            data, begin = _units([s["data"] for _, s in own])
            orders = [p.order(s) for p, s in own]
            coef = np.concatenate([np.stack([p.coef[i][r, c] for i, r, c in o], axis=1) for (p, _), (o, _) in zip(own, orders)])
            if len(begin) != len(coef):
                raise ValueError("restart markers do not fit the frame")
            _lockstep(own[0][1], data, begin, coef, list(slots))
            at = 0
            for (p, _), (o, n) in zip(own, orders):
                for s, (i, r, c) in enumerate(o):
                    p.coef[i][r, c] = coef[at : at + n, s]
                at += n
    return pictures


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode_payloads stored."""
    size = int(picture.comments[0].split()[1])
    rows, cols = picture.down, picture.across
    luma = picture.coef[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    units = np.concatenate((luma, picture.coef[1].reshape(-1, 1, 64), picture.coef[2].reshape(-1, 1, 64)), axis=1)
    return (units.reshape(-1)[:size] + SHIFT).astype(np.uint8).tobytes()


def encode_long(data: bytes) -> bytes:
    """The files of one payload of any length, one after the other."""
    return b"".join(encode_payloads([data[a : a + PICTURE]])[0] for a in range(0, len(data), PICTURE))


def pictures(media: bytes) -> list[bytes]:
    """The files of one value: the end marker of one is followed by the start marker of the next."""
    cuts = [m.start() + 2 for m in re.finditer(rb"\xff\xd9\xff\xd8", media)]
    return [media[a:b] for a, b in zip([0, *cuts], [*cuts, len(media)])]


class Reading:
    """What is known of a payload after each of its pictures: digests, sizes and sums; the tensors' bytes if asked for."""

    def __init__(self, tensors: bool):
        self.sha, self.size, self.tail = hashlib.sha256(), 0, b""
        self.height, self.width, self.pixels, self.sums, self.crc = 0, 0, 0, np.zeros(3, np.int64), 0
        self.rgb = [] if tensors else None

    def add(self, picture: Picture) -> "Reading":
        payload, rgb = payload_of(picture), picture.rgb()
        self.sha.update(payload)
        self.size, self.tail = self.size + len(payload), (self.tail + payload[-64:])[-64:]
        h, w, _ = rgb.shape
        self.height, self.width, self.pixels = self.height + h, max(self.width, w), self.pixels + h * w
        self.sums += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        data = rgb.tobytes()
        self.crc = zlib.crc32(data, self.crc)
        if self.rgb is not None:
            self.rgb.append(data)
        return self

    def feature(self) -> str:
        """Height (of all pictures), greatest width, whole-number channel means times 1000, and a checksum of the tensors."""
        means = self.sums * 1000 // self.pixels
        return f"{self.height}x{self.width}:{means[0]}:{means[1]}:{means[2]}:{self.crc:08x}"


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file, or files), of every text."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    @lean
    def write(batches):
        for batch, texts in text_chunks(batches, CHUNK):
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            whole = [padded(d) for d in data]
            files = [encode_long(whole[0])] if len(whole) == 1 else encode_payloads(whole)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


def load(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Reads stored files back: payload digests, the feature and, if asked for, height, width and the RGB tensor's bytes (of several pictures one after the other)."""
    small_batches(stored.sparkSession)
    kind = stored.schema["doc_id"].dataType.simpleString()

    @lean
    def read(batches):
        for batch, files in text_chunks(batches, CHUNK, "media"):
            split = [pictures(f) for f in files]
            if max(map(len, split)) == 1:
                found = [Reading(tensors).add(p) for p in decode(files)]
            else:
                found = [Reading(tensors) for _ in files]
                for r, own in zip(found, split):
                    for one in own:
                        r.add(decode([one])[0])
            rows = [(r.size, r.sha.hexdigest(), zlib.crc32(r.tail), len(f), hashlib.sha256(f).hexdigest(), r.feature(), *((r.height, r.width, b"".join(r.rgb)) if tensors else ())) for r, f in zip(found, files)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["height", "width", "rgb"] if tensors else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.int32(), pa.int32(), pa.binary()] if tensors else [])]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", height int, width int, rgb binary" if tensors else "")
    return stored.mapInArrow(read, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(store(table(spark, sf_dir, "documents")))
