"""Lossless WebP (VP8L): a complete decoder to pixel arrays, and encoders to store samples.

``decode`` reads prefix codes (simple and normal), meta prefix groups, back-references with the
two-dimensional distance map, the colour cache, and inverts the predictor, cross-colour, subtract-green
and colour-indexing transforms. Images of one group without cache are read by array operations: what a code
would give at every bit of a stretch is looked up at once, and from it the places one, two, four and eight symbols on; these are
followed. Images with groups or a cache are read symbol by symbol.

``encode`` stores samples (three to a pixel, red, green, blue, or one to a pixel, as grey) with prefix codes of several lengths (Huffman, 15 bits at most),
whose lengths are written run-length coded. Stretches of ``RUN`` pixels or more that occur earlier in the image become
back-references; green is subtracted where that lowers the channels' entropy; images of up to 16 colours are stored through the
colour-indexing transform, several pixels bundled in one. The colour cache, groups, predictors and cross-colour are read but
not written.

The operator keeps text as media: a text's UTF-8 bytes, padded by byte 32 to a positive multiple of
``UNIT``, a grey picture of one byte a pixel (of three, where such a picture would be too large for the format). With green subtracted,
a grey picture needs one code, and repeats of bytes are found at any offset. Defined results: null text counts as empty (one unit of padding); equal texts give equal media
and features; repeated rows and null ids stay, one result row each; other columns pass by. ``encode`` and ``decode``
raise ValueError for a payload beyond 16384 x 16384 pixels and for bytes that are not valid media; such a row of the
operator has null media, or null digests and feature.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

UNIT = 192
RUN = 24  # pixels of the shortest back-reference
FEW = 16  # colours up to which a palette is stored
MOST = 1 << 14
STRETCH = 1 << 17  # bits that are looked up at once
# Fixed values of the format: the order of code length codes, the hash of the colour cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
#: Near pixels by distance code: by distance, then by horizontal offset.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.have = data, 0, 0, 0

    def read(self, n: int) -> int:
        while self.have < n:
            if self.at >= len(self.data) + 8:
                raise ValueError("media ends early")
            chunk = self.data[self.at : self.at + 8].ljust(8, b"\0")
            self.bits |= int.from_bytes(chunk, "little") << self.have
            self.have += 64
            self.at += 8
        value = self.bits & ((1 << n) - 1)
        self.bits >>= n
        self.have -= n
        return value

    def position(self) -> int:
        return self.at * 8 - self.have

    def go(self, position: int) -> None:
        self.at, self.bits, self.have = position // 8, 0, 0
        self.read(position % 8)


class PrefixCode:
    """A canonical prefix code: first code and first index of each length."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((n, s) for s, n in lengths.items() if n)
        if not used:
            raise ValueError("empty prefix code")
        self.symbols = [s for _, s in used]
        self.only = used[0][1] if len(used) == 1 else None
        counts = [0] * 16
        for n, _ in used:
            counts[n] += 1
        self.rows, code, index = [], 0, 0
        for n in range(1, 16):
            code <<= 1
            self.rows.append((code, counts[n], index))
            code += counts[n]
            index += counts[n]
        if self.only is None and code != 1 << 15:
            raise ValueError("prefix code is not complete")
        self.lengths = np.array([n for n, _ in used])
        self.width = 0 if self.only is not None else used[0][0] if used[0][0] == used[-1][0] else None

    def read(self, r: BitReader) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for first, count, index in self.rows:
            code = code << 1 | r.read(1)
            if code - first < count:
                return self.symbols[index + code - first]
        raise ValueError("no such code")


def _table(code: PrefixCode) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length by the next bits, first bit highest, and the number of these bits."""
    if code.only is not None:
        return np.array([code.only]), np.zeros(1, np.int64), 0
    wide = int(code.lengths[-1])
    times = 1 << wide - code.lengths
    return np.repeat(np.array(code.symbols), times), np.repeat(code.lengths, times), wide


@lru_cache(maxsize=1024)
def _simple(one: int, two: int) -> PrefixCode:
    return PrefixCode({one: 1, two: 1})


@lru_cache
def _turned(wide: int) -> list[int]:
    """The numbers of so many bits, their bits in reverse order."""
    return [int(f"{i:0{wide}b}"[::-1], 2) for i in range(1 << wide)] if wide else [0]


def _read_code(r: BitReader, size: int) -> PrefixCode:
    if r.read(1):
        two = r.read(1)
        symbol = r.read(8 if r.read(1) else 1)
        return _simple(symbol, r.read(8) if two else symbol)
    of = {LENGTH_ORDER[i]: r.read(3) for i in range(4 + r.read(4))}
    code = PrefixCode(of)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    lengths, at, before = {}, 0, 8
    if code.width == 1 and code.symbols[1] < 16:  # two plain lengths, a bit each
        pattern = bin(r.read(min(left, size)) | 1 << min(left, size))[:2:-1]
        return PrefixCode({i: code.symbols[b == "1"] for i, b in enumerate(pattern)})
    symbols, bits, wide = _table(code)
    turned = _turned(wide)
    symbols, bits = symbols[turned].tolist(), bits[turned].tolist()
    place = r.position()
    ahead, read, mask = int.from_bytes(r.data[place // 8 : place // 8 + 2 * size + 8], "little") >> place % 8, 0, (1 << wide) - 1
    while at < size and left > 0:
        left -= 1
        n, k = symbols[ahead & mask], bits[ahead & mask]
        ahead >>= k
        read += k
        if n < 16:
            if n:
                lengths[at] = before = n
            at += 1
        else:
            more, least = (2, 3) if n == 16 else (3, 3) if n == 17 else (7, 11)
            times = least + (ahead & (1 << more) - 1)
            ahead >>= more
            read += more
            if at + times > size:
                raise ValueError("too many code lengths")
            if n == 16:
                lengths.update(dict.fromkeys(range(at, at + times), before))
            at += times
    if place + read > 8 * len(r.data):
        raise ValueError("media ends early")
    r.go(place + read)
    return PrefixCode(lengths)


def _amount(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache is too large")
    group_bits, group_of, groups = 0, None, 1
    if main and r.read(1):
        group_bits = 2 + r.read(3)
        group_of = (_image(r, _up(width, group_bits), _up(height, group_bits), False) >> 8) & 0xFFFF
        groups = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(r, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    widths = [c.width for c in (green, red, blue, alpha)]
    if groups == 1 and not cache_bits:
        if None not in widths and max(widths) <= 8 and max(green.symbols) < 256:
            return _fixed_stride(r, total, [green, red, blue, alpha], widths)
        return _followed(r, total, width, codes[0])
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits)
    shift, at, cached = 32 - cache_bits, 0, 0
    across = _up(width, group_bits)
    while at < total:
        if group_of is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[group_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = green.read(r)
        if s < 256:
            rd = red.read(r)
            bl = blue.read(r)
            out[at] = alpha.read(r) << 24 | rd << 16 | s << 8 | bl
            at += 1
        elif s < 280:
            length = _amount(r, s - 256)
            back = _amount(r, far.read(r))
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR[back - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > total:
                raise ValueError("back-reference leaves the image")
            for at in range(at, at + length):  # noqa: B020
                out[at] = out[at - back]
            at += 1
        else:
            for cached in range(cached, at):  # noqa: B020
                cache[(CACHE_HASH * int(out[cached]) & 0xFFFFFFFF) >> shift] = int(out[cached])
            cached = at
            out[at] = cache[s - 280]
            at += 1
    return out


def _fixed_stride(r: BitReader, total: int, codes: list[PrefixCode], widths: list[int]) -> np.ndarray:
    start, stride = r.position(), sum(widths)
    end = start + total * stride
    if end > 8 * len(r.data):
        raise ValueError("media ends early")
    raw = np.frombuffer(r.data, np.uint8, (end + 7) // 8 - start // 8, start // 8)
    bits = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + total * stride].reshape(total, stride)
    out, at = np.zeros(total, np.uint32), 0
    for code, n, shift in zip(codes, widths, (8, 16, 0, 24), strict=True):
        if n:
            index = np.packbits(bits[:, at : at + n], axis=1)[:, 0] >> (8 - n)
            out |= np.array(code.symbols, np.uint32)[index] << np.uint32(shift)
        else:
            out |= np.uint32(code.only << shift)
        at += n
    r.go(end)
    return out


def _reversed(bits: int) -> np.ndarray:
    """The numbers of so many bits, their bits in reverse order."""
    out = np.zeros(1, np.uint32)
    for _ in range(bits):
        out = np.concatenate([out << np.uint32(1), out << np.uint32(1) | np.uint32(1)])
    return out


_REVERSED_8, _REVERSED_16 = _reversed(8), _reversed(16)
_SHIFTS = np.arange(9, 1, -1)


def _followed(r: BitReader, total: int, width: int, codes: list[PrefixCode]) -> np.ndarray:
    """Codes of any lengths: all bits of a stretch are looked up at once, then symbols are followed from place to place, eight a step where no back-reference lies."""
    start = r.position()
    base = start // 8 * 8
    raw = np.frombuffer(r.data, np.uint8, offset=start // 8)
    end, at, filled = 8 * len(raw), start % 8, 0
    tables = [_table(c) for c in codes]
    out, copies, found = np.empty(total, np.uint32), [], []
    moves = np.where(tables[0][0] < 256, tables[0][1], 0)  # the length of a literal's green
    with_tokens = max(codes[0].symbols) > 255

    def prefixed(symbol: int, at: int) -> tuple[int, int]:
        """A length or distance, whose further bits stand here, and the place after them."""
        if symbol < 4:
            return symbol + 1, at
        more = symbol - 2 >> 1
        ahead = int.from_bytes(raw[at // 8 : at // 8 + 5].tobytes(), "little") >> at % 8
        return ((2 + (symbol & 1)) << more) + (ahead & (1 << more) - 1) + 1, at + more

    while filled < total:
        low = at // 8 * 8
        size = min(STRETCH, end - low)
        mirrored = np.zeros((size >> 3) + 18, np.int64)
        some = raw[low // 8 : low // 8 + len(mirrored)]
        mirrored[: len(some)] = _REVERSED_8[some]
        three = mirrored[:-2] << 16 | mirrored[1:-1] << 8 | mirrored[2:]
        window = (three[:, None] >> _SHIFTS & 0x7FFF).ravel()  # the next 15 bits at each bit
        next_ = np.arange(len(window))
        stop = next_[:size] + moves.take(window[:size] >> 15 - tables[0][2], mode="wrap")
        tokens = stop == next_[:size] if with_tokens else None
        for _, own, wide in tables[1:4]:
            if wide:
                stop += own[window[stop] >> 15 - wide]
        if tokens is not None:  # they and the stretch's end stay
            stop[tokens] = np.flatnonzero(tokens)
        next_[:size] = stop
        two = next_.take(next_, mode="wrap")  # no place lies outside, and so goes unchecked
        four = two.take(two, mode="wrap")
        one, eight = memoryview(next_), memoryview(four.take(four, mode="wrap"))
        steps, singles, p = [], [], at - low
        step, single = steps.append, singles.append
        while p < size and filled < total:
            left = total - filled
            q = eight[p]
            while left >= 8:
                then = eight[q]
                if then == q:  # a place that stays
                    break
                step(p)
                p, q = q, then
                left -= 8
            while left:
                q = one[p]
                if q == p:
                    break
                single(p)
                p = q
                left -= 1
            filled = total - left
            if not left or p >= size:
                break
            green, own, wide = tables[0]
            ahead = window[p] >> 15 - wide
            length, p = prefixed(int(green[ahead]) - 256, low + p + int(own[ahead]))
            far, own, wide = tables[4]
            ahead = window[p - low] >> 15 - wide
            back, p = prefixed(int(far[ahead]), p + int(own[ahead]))
            p -= low
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR[back - 1]
                back = max(1, dx + dy * width)
            if back > filled or filled + length > total:
                raise ValueError("back-reference leaves the image")
            copies.append((filled, back, length))
            filled += length
        at = low + p
        if at > end or (filled < total and at >= end):
            raise ValueError("media ends early")
        here = np.array(steps, np.int64)[:, None]
        for then in (next_, two, four):
            here = np.concatenate([here, then[here]], axis=1)
        here = np.sort(np.append(here.ravel(), np.array(singles, np.int64)))
        pixel = np.zeros(len(here), np.uint32)
        for (symbols, own, wide), shift in zip(tables[:4], (8, 16, 0, 24), strict=True):
            if wide:
                ahead = window[here] >> 15 - wide
                pixel |= symbols[ahead].astype(np.uint32) << np.uint32(shift)
                here = here + own[ahead]
            else:
                pixel |= np.uint32(int(symbols[0]) << shift)
        found.append(pixel)
    literals, used, done = np.concatenate(found) if len(found) > 1 else found[0], 0, 0
    for place, back, length in copies:
        out[done:place] = literals[used : used + place - done]
        used += place - done
        out[place : place + length] = np.resize(out[place - back : place], length) if back < length else out[place - back : place - back + length]
        done = place + length
    out[done:] = literals[used:]
    r.go(base + at)
    return out


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _whole(parts) -> int:
    a, r, g, b = (min(255, max(0, x)) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """A pixel's prediction from its left, top, top-right and top-left neighbours."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        return (_half(_half(left, right), top), _half(left, corner), _half(left, top), _half(corner, top), _half(top, right), _half(_half(left, corner), _half(top, right)))[mode - 5]
    ls, ts, cs = _parts(left), _parts(top), _parts(corner)
    if mode == 11:  # the gradient lies at a distance |top - corner| from left and |left - corner| from top
        return left if sum(abs(t - c) for t, c in zip(ts, cs, strict=True)) < sum(abs(x - c) for x, c in zip(ls, cs, strict=True)) else top
    if mode == 12:
        return _whole(x + t - c for x, t, c in zip(ls, ts, cs, strict=True))
    mean = _parts(_half(left, top))
    return _whole(m + int((m - c) / 2) for m, c in zip(mean, cs, strict=True))


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _prediction(px: list[int], at: int, x: int, y: int, width: int, modes: np.ndarray, bits: int, across: int) -> int:
    if y == 0:
        return px[at - 1] if x else 0xFF000000
    if x == 0:
        return px[at - width]
    mode = int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15
    return predicted(mode, px[at - 1], px[at - width], px[at - width + 1], px[at - width - 1])


def _undo_predictor(image: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    px, across = image.tolist(), _up(width, bits)
    for at in range(len(px)):
        y, x = divmod(at, width)
        px[at] = _add(px[at], _prediction(px, at, x, y, width, modes, bits, across))
    return np.array(px, np.uint32)


def _cross(image: np.ndarray, width: int, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (sign -1) what green says of red and blue, and red of blue."""
    y, x = np.divmod(np.arange(len(image)), width)
    f = factors[(y >> bits) * _up(width, bits) + (x >> bits)]
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    green, red, blue = signed(image >> 8), (image >> 16 & 255).astype(np.int32), (image & 255).astype(np.int32)
    changed = red + sign * (signed(f) * green >> 5) & 255
    true_red = changed if sign > 0 else red
    blue = blue + sign * ((signed(f >> 8) * green >> 5) + (signed(f >> 16) * signed(true_red) >> 5)) & 255
    return image & np.uint32(0xFF00FF00) | changed.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    g = (image >> np.uint32(8) & np.uint32(255)) * np.uint32(0x10001)
    if sign < 0:
        return image & np.uint32(0xFF00FF00) | (image | np.uint32(0xFF00FF00)) - g & np.uint32(0xFF00FF)
    return image & np.uint32(0xFF00FF00) | (image & np.uint32(0xFF00FF)) + g & np.uint32(0xFF00FF)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(image: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    index = (image >> 8 & 255).astype(np.uint8)
    bits = _bundle(len(table))
    if bits:
        each = 8 >> bits
        index = (index[:, None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def _palette_deltas(table: np.ndarray, sign: int) -> np.ndarray:
    b = table.astype("<u4").view(np.uint8).reshape(-1, 4)
    b = np.cumsum(b, 0, dtype=np.uint8) if sign > 0 else np.diff(b, axis=0, prepend=np.zeros((1, 4), np.uint8))
    return np.ascontiguousarray(b).view("<u4").ravel().astype(np.uint32)


def decode(media: bytes) -> np.ndarray:
    """A lossless WebP file as a (height, width) array of ARGB numbers."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not lossless WebP")
    r = BitReader(media[20 : 20 + int.from_bytes(media[16:20], "little")])
    if r.read(8) != 0x2F:
        raise ValueError("no signature")
    width, height = 1 + r.read(14), 1 + r.read(14)
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, coded, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            bits = 2 + r.read(3)
            part = _image(r, _up(coded, bits), _up(height, bits), False)
            undo.append((_undo_predictor, (coded, part, bits)) if kind == 0 else (_cross, (coded, part, bits, 1)))
        elif kind == 2:
            undo.append((_green, (1,)))
        else:
            table = _palette_deltas(_image(r, 1 + r.read(8), 1, False), 1)
            undo.append((_undo_palette, (coded, height, table)))
            coded = _up(coded, _bundle(len(table)))
    image = _image(r, coded, height, True)
    for f, args in reversed(undo):
        image = f(image, *args)
    return image.reshape(height, width)


class BitWriter:
    def __init__(self):
        self.bits, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.bits.to_bytes((self.n + 7) // 8, "little")


def _write_simple(w: BitWriter, symbols: list[int]) -> None:
    w.write(1, 1)
    w.write(len(symbols) - 1, 1)
    w.write(1, 1)
    for s in symbols:
        w.write(s, 8)


def _huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most so many bits; rare symbols count for more where the code would be too long."""
    used, least, out = counts.nonzero()[0], 1, np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    while True:
        raised = np.maximum(counts[used], least)
        order = np.argsort(raised, kind="stable")
        weights, above, leaf, node = raised[order].tolist(), [0] * (2 * n - 1), 0, n
        weights[n:] = [math.inf] * n  # of nodes not made yet, and past the leaves' end
        leaves = [*weights[:n], math.inf]
        for k in range(n, 2 * n - 1):
            if leaves[leaf] <= weights[node]:
                one, leaf = leaves[leaf], leaf + 1
                above[leaf - 1] = k
            else:
                one, node = weights[node], node + 1
                above[node - 1] = k
            if leaves[leaf] <= weights[node]:
                weights[k], leaf = one + leaves[leaf], leaf + 1
                above[leaf - 1] = k
            else:
                weights[k], node = one + weights[node], node + 1
                above[node - 1] = k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= most:
            out[used[order]] = depth[:n]
            return out
        least *= 2


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, their first bits the lowest."""
    used = lengths.nonzero()[0]
    used = used[lengths[used].argsort(kind="stable")]
    size, out = 1 << 16 - lengths[used], np.zeros(len(lengths), np.uint64)
    out[used] = _REVERSED_16[np.cumsum(size) - size]
    return out


def _write_code(w: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code of symbols that occur so often; each symbol's code and its length."""
    used = counts.nonzero()[0]
    lengths = _huffman(counts, 15)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        _write_simple(w, used.tolist() or [0])
    else:
        cuts = [0, *((lengths[1:] != lengths[:-1]).nonzero()[0] + 1).tolist()]
        said, plain = [], [(x, 0, 0) for x in range(16)]  # symbol, number of further bits, their value
        for x, a, b in zip(lengths[cuts].tolist(), cuts, [*cuts[1:], len(lengths)], strict=True):
            n = b - a
            if x:
                said.append(plain[x])
                n -= 1
            while n >= 3:
                m = min(n, 6 if x else 138)
                said.append((16, 2, m - 3) if x else (17, 3, m - 3) if m < 11 else (18, 7, m - 11))
                n -= m
            if n:
                said += [plain[x]] * n
        kinds = _huffman(np.bincount([k for k, _, _ in said], minlength=19), 7)
        order = kinds[list(LENGTH_ORDER)].tolist()
        while len(order) > 4 and not order[-1]:
            order.pop()
        w.write(0, 1)
        w.write(len(order) - 4, 4)
        for x in order:
            w.write(x, 3)
        w.write(0, 1)  # lengths of all symbols
        codes = {k: (c, n) for k, (c, n) in enumerate(zip(_codes(kinds).tolist(), kinds.tolist(), strict=True)) if n} if np.count_nonzero(kinds) > 1 else {}
        bits = size = 0
        for k, more, value in said:
            code, n = codes.get(k, (0, 0))
            bits |= (code | value << n) << size
            size += n + more
        w.write(bits, size)
    if len(used) < 2:
        lengths[:] = 0  # a single symbol takes no bits
    return _codes(lengths), lengths


def riff(data: bytes) -> bytes:
    body = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def _header(width: int, height: int, alpha: bool) -> BitWriter:
    if not (0 < width <= MOST and 0 < height <= MOST):
        raise ValueError("too large for the format")
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int(alpha), 1)
    w.write(0, 3)
    return w


def shape(payload_bytes: int) -> tuple[int, int]:
    """Width and height for a payload: 64 pixels wide, or as many times that as the height needs."""
    rows = payload_bytes // UNIT
    wide = -(-rows // MOST)
    return 64 * wide, -(-rows // wide)


def _prefix(v: int) -> tuple[int, int, int]:
    """Symbol, number of further bits and their value, of a length or distance."""
    x = v - 1
    if x < 4:
        return x, 0, 0
    high = x.bit_length() - 1
    return 2 * high + (x >> high - 1 & 1), high - 1, x & (1 << high - 1) - 1


_MULTIPLIER = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.append(np.uint64(1), np.cumprod(np.full(size - 1, x, np.uint64))) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
    return up, down * _SPREAD  # so that a first pixel's difference reaches a hash's high bits, too


def repeats(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of stretches that occur earlier, from left to right, none overlapping another."""
    n = len(px) - RUN + 1
    if n <= RUN:
        return []
    up, down = _powers(1 << max(15, (len(px) - 1).bit_length()))
    sums = np.zeros(len(px) + 1, np.uint64)
    np.cumsum((px.astype(np.uint64) + np.uint64(1)) * up[: len(px)], out=sums[1:])
    h = (sums[RUN:] - sums[:-RUN]) * down[:n]
    low = np.uint64(n.bit_length())  # these bits of a hash give way to its place; stretches are compared below
    h = np.sort(h >> low << low | np.arange(n, dtype=np.uint64))
    value = h >> low
    later = (value[1:] == value[:-1]).nonzero()[0] + 1
    if not len(later):
        return []
    lead = np.append(True, later[1:] != later[:-1] + 1).nonzero()[0]
    first = np.repeat(later[lead] - 1, np.diff(np.append(lead, len(later))))
    place = (np.uint64(1) << low) - np.uint64(1)
    at, first = (h[later] & place).astype(np.int64), (h[first] & place).astype(np.int64)
    order = np.argsort(at)
    at, back = at[order], (at - first)[order]
    cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (back[1:] != back[:-1])) + 1  # between them, one stretch is followed
    out, done, data, each = [], 0, px.tobytes(), px.itemsize
    for a, b, d in zip(at[np.append(0, cuts)].tolist(), at[np.append(cuts, len(at)) - 1].tolist(), back[np.append(0, cuts)].tolist(), strict=True):
        a, b = max(a, done), b + RUN
        if b - a >= RUN and data[a * each : b * each] == data[(a - d) * each : (b - d) * each]:
            step = 1  # the stretch may go on where its next part occurs still earlier, too
            while step:
                if b + step <= len(px) and data[b * each : (b + step) * each] == data[(b - d) * each : (b - d + step) * each]:
                    b, step = b + step, 2 * step
                else:
                    step >>= 1
            out.append((a, d, b - a))
            done = b
    return out


def _channels(px: np.ndarray) -> list[np.ndarray]:
    """Green, red, blue and alpha of ARGB numbers."""
    return [(px >> np.uint32(shift) & np.uint32(255)) for shift in (8, 16, 0, 24)]


def _write_image(w: BitWriter, channels: list[np.ndarray | int], main: bool, copies: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Writes an image's header and codes; gives its pixels as values of so many bits. A channel of one value is a number."""
    w.write(0, 2 if main else 1)  # no cache, one group
    if copies:
        literal = np.ones(len(channels[0]), bool)
        for place, _, length in copies:
            literal[place : place + length] = False
        channels = [x if isinstance(x, int) else x[literal] for x in channels]
    tokens = [(place, _prefix(min(4096, length - k)), _prefix(distance + 120)) for place, distance, length in copies for k in range(0, length, 4096)]
    values, sizes, codes = [], [], []
    for k, (x, n) in enumerate(zip(channels, (280, 256, 256, 256), strict=True)):
        if isinstance(x, int):
            _write_simple(w, [x])
            continue
        x = x.astype(np.int64)
        counts = np.bincount(x, minlength=n)
        if k == 0:
            np.add.at(counts, [256 + t[0] for _, t, _ in tokens], 1)
        codes.append(_write_code(w, counts))
        code, own = codes[-1]
        if own.any():
            values.append(code[x])
            sizes.append(own[x])
    far = _write_code(w, np.bincount([d[0] for _, _, d in tokens], minlength=40))
    value = np.stack(values, 1).ravel() if len(values) > 1 else values[0] if values else np.zeros(0, np.uint64)
    size = np.stack(sizes, 1).ravel() if len(values) > 1 else sizes[0] if values else np.zeros(0, np.int64)
    if tokens:
        before, more_values, more_sizes, filled, used = [], [], [], 0, 0
        for place, length, distance in tokens:
            used += max(0, place - filled)
            before += [used * len(values)] * 4
            for (code, own), symbol, (_, more, rest) in ((codes[0], 256 + length[0], length), (far, distance[0], distance)):
                more_values += [int(code[symbol]), rest]
                more_sizes += [int(own[symbol]), more]
            filled = max(filled, place) + (length[2] + ((2 + (length[0] & 1)) << length[1]) + 1 if length[0] >= 4 else length[0] + 1)
        at = np.array(before) + np.arange(len(before))
        both = np.empty((2, len(value) + len(at)), np.uint64)
        pixels = np.ones(both.shape[1], bool)
        pixels[at] = False
        both[:, at], both[:, pixels] = (np.array(more_values, np.uint64), more_sizes), (value, size)
        value, size = both[0], both[1].astype(np.int64)
    return value, size


def _entropy(px: np.ndarray) -> float:
    """Bits of red and blue at their channels' entropy."""
    counts = [np.bincount(px >> np.uint32(shift) & np.uint32(255)) for shift in (16, 0)]
    return -sum(float((c[c > 0] * np.log2(c[c > 0] / len(px))).sum()) for c in counts)


def _finish(w: BitWriter, *values: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What was written, then values of so many bits."""
    head = np.frombuffer(w.bits.to_bytes((w.n + 31) // 32 * 4, "little"), "<u4").astype(np.uint64)
    size = np.full(len(head), 32)
    size[w.n // 32 :] = w.n % 32
    return np.concatenate([head, *(v for v, _ in values)]), np.concatenate([size, *(n for _, n in values)])


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Values of so many bits, 32 at most, in turn, lowest bits first."""
    ends = np.cumsum(size)
    at, total = ends - size, int(ends[-1])
    word = at >> 5
    moved = value << (at & 31).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((total >> 5) + 2, np.uint64)
    out[word[starts]] = np.add.reduceat(moved & np.uint64(0xFFFFFFFF), starts)  # bits of different values never meet
    out[word[starts] + 1] += np.add.reduceat(moved >> np.uint64(32), starts)
    return out.astype("<u4").tobytes()[: total + 7 >> 3]


def encode(samples: np.ndarray, width: int, height: int) -> bytes:
    """8-bit samples, three to a pixel or, where they are no more than the pixels, one to a grey pixel, filled up by zeros, as lossless WebP."""
    total = width * height
    grey = len(samples) <= total
    wanted = total if grey else 3 * total
    if len(samples) < wanted:
        samples = np.concatenate([samples, np.zeros(wanted - len(samples), np.uint8)])
    w = _header(width, height, False)
    if grey:
        shades = np.flatnonzero(np.bincount(samples, minlength=256)).astype(np.uint32)
        table = np.uint32(0xFF000000) | shades * np.uint32(0x10101)
    else:
        rgb = samples.reshape(total, 3)
        px = np.uint32(0xFF000000) | rgb[:, 0].astype(np.uint32) << np.uint32(16) | rgb[:, 1].astype(np.uint32) << np.uint32(8) | rgb[:, 2]
        colours = np.unique(px[:: max(1, total // 64)])
        table = np.unique(px) if len(colours) <= FEW else colours
    if len(table) <= FEW:
        w.write(1 | 3 << 1 | len(table) - 1 << 3, 11)  # a transform, colour indexing, its size
        first = _finish(w, _write_image(w, _channels(_palette_deltas(table, -1)), False, []))
        per = _bundle(len(table))
        index = np.zeros((height, _up(width, per) << per), np.uint32)
        index[:, :width] = (np.searchsorted(shades, samples) if grey else np.searchsorted(table, px)).reshape(height, width)
        each = 8 >> per
        packed = (index.reshape(height, -1, 1 << per) << (np.arange(1 << per, dtype=np.uint32) * np.uint32(each))).sum(2, dtype=np.int64).ravel()
        rest = BitWriter()
        rest.write(0, 1)  # no further transform
        image = _write_image(rest, [packed, 0, 0, 255], True, repeats(packed))
        value, size = (np.concatenate(x) for x in zip(first, _finish(rest, image), strict=True))
    else:
        less = None if grey else _green(px, -1)
        if grey or _entropy(less) < _entropy(px):
            w.write(1 | 2 << 1, 3)  # a transform, subtract green
            px = less
        w.write(0, 1)  # no further transform
        image = _write_image(w, [samples, 0, 0, 255], True, repeats(samples)) if grey else _write_image(w, _channels(px), True, repeats(px))
        value, size = _finish(w, image)
    return riff(_packed(value, size))


def stored(payload: np.ndarray) -> bytes:
    """A payload of a multiple of UNIT bytes as a grey picture, or as one of three bytes a pixel where it is too large for that."""
    rows = len(payload) // UNIT
    wide = -(-rows // MOST)
    return encode(payload, *((UNIT * wide, -(-rows // wide)) if UNIT * wide <= MOST else shape(len(payload))))


def read_back(media: bytes, size: int) -> np.ndarray:
    """The payload of so many bytes that ``stored`` has stored."""
    image = decode(media).ravel()
    return ((image >> np.uint32(8)).astype(np.uint8) if image.size >= size else samples_of(image))[:size]


def samples_of(image: np.ndarray) -> np.ndarray:
    """Red, green and blue of each pixel, in turn."""
    b = np.ascontiguousarray(image.ravel(), "<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(b[:, 2::-1]).ravel()


def feature(payload: np.ndarray) -> str:
    """Means of every third sample from the first, second and third, and an 8 x 8 average hash over the samples in order."""
    means = [payload[k::3].sum(dtype=np.int64) * 3 / len(payload) for k in range(3)]
    cuts = np.arange(64) * len(payload) // 64
    sums = np.add.reduceat(payload, cuts, dtype=np.int64) / np.diff(np.append(cuts, len(payload)))
    return ";".join(f"{m:.3f}" for m in means) + ";" + np.packbits(sums > sums.mean()).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_bytes, payload_bytes, media: the stored bytes."""

    def run(batches):
        for b in batches:
            n, sizes, media = [], [], []
            for t in b.column(1).to_pylist():
                own, payload = payload_of(t)
                n.append(own)
                sizes.append(len(payload))
                try:
                    media.append(stored(np.frombuffer(payload, np.uint8)))
                except ValueError:
                    media.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def load(kept: DataFrame) -> DataFrame:
    """Stored rows to digests and features of what the media hold."""

    def run(batches):
        for b in batches:
            out = []
            for size, media in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                try:
                    payload = read_back(media or b"", size)
                except ValueError:
                    out.append((None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None))
                    continue
                raw = payload.tobytes()
                out.append((hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            sha, tail, length, own, feat = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(length, pa.int64()), pa.array(own, pa.string()), pa.array(feat, pa.string())], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return kept.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return load(store(documents(spark, sf_dir)))
