"""Lossless WebP (VP8L): a whole decoder, and an encoder for 8-bit samples.

The decoder reads prefix codes (simple and normal, with groups by block),
back-references, the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms.  Pixels are written to arrays.  Streams
whose codes have one length each are read without a loop over pixels, and so are
those where only green takes bits: every bit is taken as the start of a symbol, and
the true starts are followed sixteen symbols at a stride.

The encoder stores samples in the green channel.  Few values go through a palette,
with codes of one length.  Others are written with back-references to what repeats,
prefix codes by how often symbols occur, and a predictor where it saves bits.
"""

from __future__ import annotations

import heapq
import struct
from itertools import groupby

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format.
SIGNATURE, LARGEST_SIDE, CACHE_FACTOR = 0x2F, 1 << 14, 0x1E35A7BD
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Near distances: by length, then |x|, then right before left.
NEAR = sorted([(x, y) for y in range(8) for x in range(-7 if y else 1, 9)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the stream ends early")
        return value


class Code:
    """A prefix code from its symbols' lengths; a lone symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((length, symbol) for symbol, length in lengths.items() if length)
        self.only = used[0][1] if len(used) == 1 else 0 if not used else None
        self.same, self.symbols, self.table, self.longest = None, None, None, 0
        if self.only is not None:
            self.same, self.symbols = 0, np.array([self.only])
            return
        if sum(1 << (15 - length) for length, _ in used) != 1 << 15:
            raise ValueError("the prefix code is not complete")
        self.longest = used[-1][0]
        if used[0][0] == self.longest:
            self.same, self.symbols = self.longest, np.array([symbol for _, symbol in used])
        self.used = used

    def turned(self) -> list[tuple[int, int, int]]:
        """(code as it is read, first bit lowest, its length, symbol)."""
        out, code, before = [], 0, 0
        for length, symbol in self.used:
            code <<= length - before
            out.append((int(f"{code:0{length}b}"[::-1], 2), length, symbol))
            code, before = code + 1, length
        return out

    def _lookup(self) -> list:
        table = [None] * (1 << self.longest)
        for turned, length, symbol in self.turned():
            table[turned :: 1 << length] = [(symbol, length)] * (1 << (self.longest - length))
        return table

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self._lookup()
        symbol, length = self.table[bits.peek() & ((1 << self.longest) - 1)]
        bits.at += length
        return symbol


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        return Code(dict.fromkeys(symbols, 1))
    own = Code({LENGTH_ORDER[i]: bits.read(3) for i in range(4 + bits.read(4))})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if left > alphabet:
        raise ValueError("too many code lengths")
    if own.only is not None and own.only < 16:
        return Code(dict.fromkeys(range(left), own.only))
    lengths, symbol, before = [0] * alphabet, 0, 8
    while symbol < alphabet and left:
        left -= 1
        token = own.next(bits)
        if token < 16:
            lengths[symbol] = token
            before = token or before
            symbol += 1
            continue
        value, times = {16: (before, 3 + bits.read(2)), 17: (0, 3 + bits.read(3)), 18: (0, 11 + bits.read(7))}[token] if token == 16 else (0, 3 + bits.read(3) if token == 17 else 11 + bits.read(7))
        if symbol + times > alphabet:
            raise ValueError("a repeat runs past the alphabet")
        if value:
            lengths[symbol : symbol + times] = [value] * times
        symbol += times
    return Code({symbol: length for symbol, length in enumerate(lengths) if length})


def _prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, groups_at, count = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_at = ((_read_image(bits, _blocks(width, block), _blocks(height, block), False) >> 8) & 0xFFFF).tolist()
        count = max(groups_at) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(count)]
    if count == 1 and not cache and all(c.same is not None for c in groups[0][:4]) and groups[0][0].symbols.max() < 256:
        return _read_even(bits, groups[0], width * height)
    if count == 1 and not cache and all(c.only is not None for c in groups[0][1:4]) and groups[0][0].longest + groups[0][4].longest <= 26:
        return _read_green(bits, groups[0], width, width * height)
    return _read_symbols(bits, width, width * height, groups, groups_at, block, cache, cache_bits)


def _read_even(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """Literals only and one length a channel: all pixels at once."""
    each = [c.same for c in codes[:4]]
    total = sum(each)
    if bits.at + n * total > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    pixels = np.zeros(n, np.uint32)
    first, skip = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8)[first : (bits.at + n * total + 7) >> 3]
    spread = np.unpackbits(raw, bitorder="little")[skip : skip + n * total].reshape(n, total) if total else None
    at = 0
    for code, length, shift in zip(codes, each, (8, 16, 0, 24)):
        index = np.zeros(n, np.intp) if not length else np.zeros(n, np.uint16)
        for k in range(at, at + length):
            index = (index << 1) | spread[:, k]
        pixels |= code.symbols.astype(np.uint32)[index] << np.uint32(shift)
        at += length
    bits.at += n * total
    return pixels


#: Bits that are looked at together; a symbol never takes more than REST.
STRETCH, REST = 1 << 18, 64


def _arrays(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) for every window of ``code.longest`` bits."""
    if code.only is not None:
        return np.array([code.only], np.int16), np.zeros(1, np.int8)
    symbols, sizes = np.empty(1 << code.longest, np.int16), np.empty(1 << code.longest, np.int8)
    for turned, length, symbol in code.turned():
        symbols[turned :: 1 << length] = symbol
        sizes[turned :: 1 << length] = length
    return symbols, sizes


def _extra(prefix: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of extra bits, what they and the prefix stand for); ``value`` begins with the extra bits."""
    more = np.maximum(0, (prefix - 2) >> 1)
    own = (value & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return more, np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << more) + own + 1)


def _symbols(bits: Bits, codes: list[Code], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, pixels it makes, distance code) of the green symbols that make n pixels."""
    (symbol_of, bits_of), (far_of, far_bits) = _arrays(codes[0]), _arrays(codes[4])
    if codes[0].only is not None and codes[0].only < 256:
        return np.full(n, codes[0].only), np.ones(n, np.int64), np.zeros(n, np.int64)
    mask, far_mask = (1 << codes[0].longest) - 1, np.uint64((1 << codes[4].longest) - 1)
    out, made = [], 0
    while made < n:
        first, at = bits.at >> 3, bits.at & 7
        raw = np.frombuffer(bits.data, np.uint8, count=max(0, min(len(bits.data) - first, STRETCH // 8 + REST // 8)), offset=min(first, len(bits.data)))
        if not len(raw) or bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        size = min(8 * len(raw), STRETCH)
        raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        whole = -(-size // 8)
        wide = raw[: whole + 2].astype(np.int64)
        words = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        window = ((words[:, None] >> np.arange(8)) & mask).reshape(-1)[:size]
        symbol = symbol_of.take(window)
        step = bits_of.take(window).astype(np.int64)
        length, far = np.ones(size, np.int64), np.zeros(size, np.int64)
        refer = np.flatnonzero(symbol >= 256)
        if len(refer):
            eight = np.zeros(len(refer), np.uint64)
            for k in range(8):
                eight |= raw[(refer >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
            value = eight >> ((refer & 7) + step[refer]).astype(np.uint64)
            more, length[refer] = _extra(symbol[refer].astype(np.int64) - 256, value)
            value >>= more.astype(np.uint64)
            place = (value & far_mask).astype(np.intp)
            own, code = far_bits[place].astype(np.int64), far_of[place].astype(np.int64)
            again, far[refer] = _extra(code, value >> own.astype(np.uint64))
            step[refer] += more + own + again
        jump = np.append(np.minimum(np.arange(size) + step, size), size)
        strides = [jump]
        for _ in range(4):
            strides.append(strides[-1].take(strides[-1], mode="clip"))
        anchors, p, sixteen = [], at, strides[4]
        while p < size:
            anchors.append(p)
            p = int(sixteen[p])
        starts = np.array(anchors)
        for stride in reversed(strides[:4]):
            starts = np.stack([starts, stride[starts]], axis=1).reshape(-1)
        starts = starts[starts < size]
        ends = made + np.cumsum(length[starts])
        starts = starts[: int(np.searchsorted(ends, n)) + 1]
        out.append((symbol[starts], length[starts], far[starts]))
        made += int(length[starts].sum())
        bits.at = 8 * first + int(starts[-1] + step[starts[-1]])
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return tuple(np.concatenate(x) for x in zip(*out))


def _read_green(bits: Bits, codes: list[Code], width: int, n: int) -> np.ndarray:
    """Only green takes bits: symbols at once, then each back-reference as a slice."""
    symbol, length, far = _symbols(bits, codes, n)
    ends = np.cumsum(length)
    if n and ends[-1] != n:
        raise ValueError("a back-reference leaves the image")
    starts, literal, green = ends - length, symbol < 256, np.empty(n, np.uint8)
    green[starts[literal]] = symbol[literal]
    for at, size, code in zip(*(x[~literal].tolist() for x in (starts, length, far))):
        distance = code - len(NEAR) if code > len(NEAR) else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
        if distance > at:
            raise ValueError("a back-reference leaves the image")
        if distance >= size:
            green[at : at + size] = green[at - distance : at - distance + size]
        else:
            green[at : at + size] = np.resize(green[at - distance : at], size)
    red, blue, alpha = (c.only for c in codes[1:4])
    return green.astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)


def _read_symbols(bits, width, n, groups, groups_at, block, cache, cache_bits) -> np.ndarray:
    out, wide = [], _blocks(width, block)
    codes, shift = groups[0], 32 - cache_bits
    while len(out) < n:
        at = len(out)
        if groups_at is not None:
            codes = groups[groups_at[(at // width >> block) * wide + (at % width >> block)]]
        symbol = codes[0].next(bits)
        if symbol < 256:
            red, blue, alpha = (c.next(bits) for c in codes[1:4])
            new = [alpha << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < 280:
            length = _prefixed(bits, symbol - 256)
            far = _prefixed(bits, codes[4].next(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            chunk = out[at - far :] if far < length else out[at - far : at - far + length]
            new = (chunk * (length // len(chunk) + 1))[:length]
        else:
            new = [cache[symbol - 280]]
        out += new
        if cache:
            for argb in new:
                cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
    return np.array(out, np.uint32)


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _mean(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left, top, corner):
    to_left = sum(abs(t - c) for t, c in zip(top, corner))
    to_top = sum(abs(x - c) for x, c in zip(left, corner))
    return left if to_left < to_top else top


def _predict(mode: int, left, top, right, corner):
    """left, top, right (above and right) and corner (above and left) are channel lists."""
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return [_clamp(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        return [_clamp(m + int((m - c) / 2)) for m, c in zip(_mean(left, top), corner)]
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner), 7: lambda: _mean(left, top),
        8: lambda: _mean(corner, top), 9: lambda: _mean(top, right), 10: lambda: _mean(_mean(left, corner), _mean(top, right)),
    }.get(mode, lambda: [0, 0, 0, 255])()


def _undo_predictor(pixels, width, height, size, data):
    kinds = np.unique((data >> 8) & 15)
    if len(kinds) == 1 and kinds[0] in (1, 2):  # left or top everywhere: sums along rows or columns
        own = pixels.view(np.uint8).reshape(height, width, 4).copy()
        own[0, 0, 3] = (int(own[0, 0, 3]) + 255) & 255
        own[0] = np.cumsum(own[0], axis=0, dtype=np.uint8)
        if kinds[0] == 1:
            own[:, 0] = np.cumsum(own[:, 0], axis=0, dtype=np.uint8)
            own[1:] = np.cumsum(own[1:], axis=1, dtype=np.uint8)
        else:
            own = np.cumsum(own, axis=0, dtype=np.uint8)
        return np.ascontiguousarray(own).reshape(-1).view(np.uint32)
    own = pixels.view(np.uint8).reshape(-1, 4).tolist()
    modes, wide = ((data >> 8) & 15).tolist(), _blocks(width, size)
    for i, p in enumerate(own):
        y, x = divmod(i, width)
        if not y:
            guess = own[i - 1] if x else [0, 0, 0, 255]
        elif not x:
            guess = own[i - width]
        else:
            guess = _predict(modes[(y >> size) * wide + (x >> size)], own[i - 1], own[i - width], own[i - width + 1], own[i - width - 1])
        own[i] = [(a + b) & 255 for a, b in zip(p, guess)]
    return np.array(own, np.uint8).reshape(-1).view(np.uint32)


def _undo_cross_colour(pixels, width, height, size, data):
    y, x = np.divmod(np.arange(width * height), width)
    factors = data[(y >> size) * _blocks(width, size) + (x >> size)].view(np.uint8).reshape(-1, 4).view(np.int8).astype(np.int32)
    own = pixels.view(np.uint8).reshape(-1, 4).copy()
    green = own[:, 1].view(np.int8).astype(np.int32)
    red = (own[:, 2] + (factors[:, 0] * green >> 5)).astype(np.uint8)
    blue = own[:, 0] + (factors[:, 1] * green >> 5) + (factors[:, 2] * red.view(np.int8).astype(np.int32) >> 5)
    own[:, 2], own[:, 0] = red, blue.astype(np.uint8)
    return own.reshape(-1).view(np.uint32)


def _undo_subtract_green(pixels):
    own = pixels.view(np.uint8).reshape(-1, 4).copy()
    own[:, 0] += own[:, 1]
    own[:, 2] += own[:, 1]
    return own.reshape(-1).view(np.uint32)


def _undo_palette(pixels, width, height, packing, colours):
    index = (pixels >> 8) & 255
    if packing:
        each = 8 >> packing
        x = np.arange(width)
        index = (index.reshape(height, -1)[:, x >> packing] >> (each * (x & ((1 << packing) - 1))).astype(np.uint32)) & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index.reshape(-1)]


def decode_stream(data: bytes) -> np.ndarray:
    """The payload of a VP8L chunk as (height, width) uint32 ARGB."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    now, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            undo.append((kind, now, size, _read_image(bits, _blocks(now, size), _blocks(height, size), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            steps = _read_image(bits, n, 1, False).view(np.uint8).reshape(-1, 4)
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, packing, np.cumsum(steps, 0, dtype=np.uint8).reshape(-1).view(np.uint32)))
            now = _blocks(now, packing)
    pixels = _read_image(bits, now, height, True)
    for kind, wide, size, extra in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, height, size, extra)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, height, size, extra)
        elif kind == SUBTRACT_GREEN:
            pixels = _undo_subtract_green(pixels)
        else:
            pixels = _undo_palette(pixels, wide, height, size, extra)
    return pixels.reshape(height, width)


def decode(data: bytes) -> np.ndarray:
    """A WebP file with a lossless chunk as (height, width) uint32 ARGB."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless chunk")


def _even_code(length: int) -> list[tuple[int, int]]:
    """(value, bits) that declare codes of ``length`` bits for the first 2^length symbols: one length, taken for free."""
    places = LENGTH_ORDER.index(length) + 1
    lengths = [(int(LENGTH_ORDER[i] == length), 3) for i in range(max(4, places))]
    rest = (1 << length) - 2
    wide = next(k for k in range(8) if rest < 1 << (2 + 2 * k))
    return [(0, 1), (len(lengths) - 4, 4), *lengths, (1, 1), (wide, 3), (rest, 2 + 2 * wide)]


def _one_symbol(symbol: int) -> list[tuple[int, int]]:
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def _pack(fields: list[tuple[int, int]]) -> tuple[int, int]:
    value = at = 0
    for x, n in fields:
        value |= x << at
        at += n
    return value, at


def _spread(values: np.ndarray, length: int) -> np.ndarray:
    """Bits of each value, greatest first."""
    return ((values[:, None] >> np.arange(length - 1, -1, -1, dtype=values.dtype)) & 1).astype(np.uint8)


#: Bits a sample from which predictors are tried.
WORTH = 5.5
GRAM, LONGEST_COPY, FARTHEST, LONGEST_CODE = 16, 4096, (1 << 20) - 120, 12
_ROLL, _BYTE = np.uint64(0x9E3779B97F4A7C15), np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)


def _copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that occurred before, in order and apart; what is found begins at a multiple of GRAM once."""
    n = len(flat)
    if n < 4 * GRAM:
        return []
    h = _BYTE[flat]
    for k in (1, 2, 4, 8):
        h = h[:-k] * (_ROLL ** np.uint64(k)) + h[k:]
    own = h[::GRAM]
    order = np.argsort(own, kind="stable")
    ranked, there = own[order], np.zeros(1 << 16, bool)
    there[(own >> np.uint64(48)).astype(np.intp)] = True
    maybe = np.flatnonzero(there.take((h >> np.uint64(48)).astype(np.intp)))
    place = np.minimum(np.searchsorted(ranked, h[maybe]), len(ranked) - 1)
    source = order[place] * GRAM
    real = (ranked[place] == h[maybe]) & (source < maybe) & (maybe - source <= FARTHEST)
    out, free = [], 0
    for p, q in zip(maybe[real].tolist(), source[real].tolist()):
        if p < free:
            continue
        most = min(LONGEST_COPY, n - p)
        differ = flat[q : q + most] != flat[p : p + most]
        length = int(differ.argmax()) if differ.any() else most
        back = 0
        while q - back > 0 and p - back > free and back < GRAM and length < LONGEST_COPY and flat[q - back - 1] == flat[p - back - 1]:
            back, length = back + 1, length + 1
        if length >= GRAM:
            out.append((p - back, length, p - q))
            free = p - back + length
    return out


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths by how often symbols occur, none over ``most``; where one symbol occurs alone, it has length 1."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    while True:
        heap = list(zip(counts[used].tolist(), range(len(used))))
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        for new in range(len(used), len(above)):  # node 2n - 2 is the root
            n, x = heapq.heappop(heap)
            m, y = heap[0]
            above[x] = above[y] = new
            heapq.heapreplace(heap, (n + m, new))
        for x in range(len(above) - 2, -1, -1):
            above[x] = above[above[x]] + 1 if above[x] < len(above) - 1 else 1
        lengths[used] = above[: len(used)]
        if lengths.max() <= most:
            return lengths
        counts[used] = (counts[used] + 1) >> 1


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order in which they are read, first bit lowest."""
    codes, code, before = np.zeros(len(lengths), np.int64), 0, 0
    for length, symbol in sorted((int(lengths[x]), int(x)) for x in np.flatnonzero(lengths)):
        code <<= length - before
        codes[symbol] = int(f"{code:0{length}b}"[::-1], 2)
        code, before = code + 1, length
    return codes


def _declared(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) that declare a code; a symbol that is alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        return _one_symbol(int(used[0]))
    tokens = []
    for length, run in groupby(lengths.tolist()):
        n = sum(1 for _ in run)
        while n and not length:
            part = min(n, 138)
            tokens += [(18, part - 11, 7)] if part >= 11 else [(17, part - 3, 3)] if part >= 3 else [(0, 0, 0)] * part
            n -= part
        tokens += [(length, 0, 0)] * n
    inner = _lengths(np.bincount([t for t, _, _ in tokens] + [0, 18], minlength=19), 7)  # two kinds at least
    codes, places = _codes(inner), [int(inner[x]) for x in LENGTH_ORDER]
    while len(places) > 4 and not places[-1]:
        places.pop()
    fields = [(0, 1), (len(places) - 4, 4), *((x, 3) for x in places), (0, 1)]
    for token, value, more in tokens:
        fields += [(int(codes[token]), int(inner[token])), (value, more)]
    return fields


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    more = v.bit_length() - 2
    return 2 * more + (v >> more), v & ((1 << more) - 1), more


def _bits(value: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]


def _coded(flat: np.ndarray, alpha: int) -> np.ndarray:
    """The bits of an entropy-coded image with samples in green, red and blue 0, and one alpha."""
    copies, literal = _copies(flat), np.ones(len(flat), bool)
    parts = []
    for at, length, distance in copies:
        literal[at : at + length] = False
        parts.append((at, _prefix(length), _prefix(distance + len(NEAR))))
    counts = np.bincount(flat[literal], minlength=280)
    far = np.zeros(40, np.int64)
    for _, size, distance in parts:
        counts[256 + size[0]] += 1
        far[distance[0]] += 1
    lengths = _lengths(counts, LONGEST_CODE)
    alone = np.count_nonzero(lengths) == 1 and not parts
    codes, far_lengths = _codes(lengths), _lengths(far, LONGEST_CODE) if parts else np.bincount([0], minlength=40)
    far_codes, taken = _codes(far_lengths), 0 if np.count_nonzero(far_lengths) == 1 else 1
    head = _pack([(0, 1), (0, 1), *_declared(lengths), *_one_symbol(0), *_one_symbol(0), *_one_symbol(alpha), *_declared(far_lengths)])
    values, sizes = codes[flat], lengths[flat] * (0 if alone else 1)
    if parts:
        pieces, before = [], 0
        for (at, size, distance), (_, length, _) in zip(parts, copies):
            pieces += [(values[before:at], sizes[before:at])]
            symbol = 256 + size[0]
            pieces.append((np.array([codes[symbol], size[1], far_codes[distance[0]], distance[1]]), np.array([lengths[symbol], size[2], far_lengths[distance[0]] * taken, distance[2]])))
            before = at + length
        pieces.append((values[before:], sizes[before:]))
        values, sizes = (np.concatenate(x) for x in zip(*pieces))
    ends = np.cumsum(sizes)
    inside = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) - np.repeat((ends - sizes).astype(np.int32), sizes)
    return np.concatenate([_bits(*head), ((np.repeat(values.astype(np.int32), sizes) >> inside) & 1).astype(np.uint8)])


def _entropy(flat: np.ndarray) -> float:
    """Bits of all samples by how often each value occurs."""
    counts = np.bincount(flat)
    counts = counts[counts > 0]
    return float(counts @ np.log2(len(flat) / counts))


def _residual(samples: np.ndarray, mode: int) -> np.ndarray:
    """Samples less those to the left (1) or above (2); the first row and column take what there is."""
    left, top = np.diff(samples, axis=1, prepend=np.uint8(0)), np.diff(samples, axis=0, prepend=np.uint8(0))
    out = left.copy() if mode == 1 else top.copy()
    out[0] = left[0]
    out[1:, 0] = top[1:, 0]
    return out


def _file(bits: np.ndarray) -> bytes:
    stream = np.packbits(bits, bitorder="little").tobytes()
    stream += b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(stream) + 12) + b"WEBP" + b"VP8L" + struct.pack("<I", len(stream)) + stream


def encode_samples(samples: np.ndarray) -> bytes:
    """A WebP file of a (height, width) uint8 array: samples in green, red and blue 0, alpha 255."""
    if np.count_nonzero(np.bincount(samples.reshape(-1), minlength=256)) <= 16:
        return _with_palette(samples)
    height, width = samples.shape
    mode, plain = 0, _entropy(samples.reshape(-1))
    if plain > WORTH * samples.size:
        cost = {0: 0.9 * plain} | {m: _entropy(_residual(samples, m).reshape(-1)) for m in (1, 2)}
        mode = min(cost, key=cost.get)
    head = [(SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]
    if mode:  # blocks of the largest side, all with one mode
        head += [(1, 1), (PREDICTOR, 2), (7, 3), (0, 1), *_one_symbol(mode), *_one_symbol(0) * 4]
        samples = _residual(samples, mode)
    first = _pack([*head, (0, 1)])
    return _file(np.concatenate([_bits(*first), _coded(np.ascontiguousarray(samples).reshape(-1), 0 if mode else 255)]))


def _with_palette(samples: np.ndarray) -> bytes:
    """A palette of the values that occur; indices have codes of one length."""
    height, width = samples.shape
    flat = samples.reshape(-1)
    values = np.flatnonzero(np.bincount(flat, minlength=256)).astype(np.uint8)
    n = len(values)
    packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    place = np.zeros(256, np.uint8)
    place[values] = np.arange(n)
    index = place[flat]
    if packing:
        each, wide = 8 >> packing, _blocks(width, packing)
        padded = np.zeros((height, wide << packing), np.uint8)
        padded[:, :width] = index.reshape(height, width)
        index = np.bitwise_or.reduce(padded.reshape(height, wide, -1) << (each * np.arange(1 << packing)).astype(np.uint8), axis=2).reshape(-1)
        length = 8
    else:
        length = (n - 1).bit_length()
    steps = np.diff(values, prepend=np.uint8(0))
    head = [(SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (1, 1), (PALETTE, 2), (n - 1, 8)]
    # the palette: green and (for its first colour alone) alpha differ from the colour before
    head += [(0, 1), *_even_code(8), *_one_symbol(0), *_one_symbol(0), (1, 1), (1, 1), (1, 1), (0, 8), (255, 8), *_one_symbol(0)]
    first, size = _pack(head)
    palette = np.concatenate([_spread(steps, 8), (np.arange(n) == 0).astype(np.uint8)[:, None]], axis=1).reshape(-1)
    second, more = _pack([(0, 1), (0, 1), (0, 1), *_even_code(length), *_one_symbol(0), *_one_symbol(0), *_one_symbol(255), *_one_symbol(0)])

    return _file(np.concatenate([_bits(first, size), palette, _bits(second, more), _spread(index, length).reshape(-1)]))
