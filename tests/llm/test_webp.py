"""The WebP decoder on streams written by hand: every feature against what it must give."""

import numpy as np
import pytest

from inkspect.llm import webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]
        return self

    def code(self, lengths):
        """A normal code with all lengths written as they are; returns the writers of its symbols."""
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.put(0, 1).put(15, 4)
        for symbol in webp.LENGTH_ORDER:
            self.put(4 if symbol < 16 else 0, 3)  # sixteen codes of four bits
        self.put(0, 1)
        for n in lengths:
            self.symbol(n, 4)
        if len(used) == 1:
            return {used[0][1]: (0, 0)}
        out, code, before = {}, 0, 0
        for n, s in used:
            code <<= n - before
            out[s] = (code, n)
            code, before = code + 1, n
        return out

    def symbol(self, code, n):
        self.bits += [(code >> i) & 1 for i in range(n - 1, -1, -1)]
        return self

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def header(w, width, height):
    return w.put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)


def image(w, pixels, main=True, uneven=True):
    """An entropy-coded image of literal ARGB pixels, in codes of two lengths."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    codes = []
    for shift in (8, 16, 0, 24):
        values = sorted({p >> shift & 255 for p in pixels} | {0, 1, 2})
        size = 280 if shift == 8 else 256
        n = len(values)
        k = (n - 1).bit_length()
        short = (1 << k) - n
        lengths = [0] * size
        for i, v in enumerate(values):
            lengths[v] = k - 1 if i < short else k
        codes.append(w.code(lengths))
    w.put(1, 1).put(0, 1).put(0, 1).put(0, 1)
    for p in pixels:
        for code, shift in zip(codes, (8, 16, 0, 24)):
            w.symbol(*code[p >> shift & 255])


def rng_pixels(n, seed=0):
    r = np.random.default_rng(seed)
    return [int(x) for x in r.integers(0, 1 << 32, n)]


def test_literals():
    pixels = rng_pixels(35)
    w = header(Writer(), 7, 5).put(0, 1)
    image(w, pixels)
    assert webp.decode_stream(w.bytes()).reshape(-1).tolist() == pixels


def test_back_references_and_cache():
    w = header(Writer(), 10, 4).put(0, 1)
    w.put(1, 1).put(2, 4).put(0, 1)  # a cache of four colours
    green = [0] * 284
    for s, n in ((7, 2), (9, 2), (256 + 4, 2), (280, 4), (281, 4), (282, 4), (283, 4)):
        green[s] = n
    g = w.code(green)
    for value in (3, 5, 255):
        w.put(1, 1).put(0, 1).put(1, 1).put(value, 8)
    distance = [0] * 40
    distance[1] = distance[0] = 1
    d = w.code(distance)
    a, b = 255 << 24 | 3 << 16 | 7 << 8 | 5, 255 << 24 | 3 << 16 | 9 << 8 | 5
    slot = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> 30
    assert slot(a) != slot(b)
    w.symbol(*g[7]).symbol(*g[9]).symbol(*g[280 + slot(a)])
    w.symbol(*g[256 + 4]).put(1, 1).symbol(*d[1])  # length 6, distance code 2: one to the left
    w.symbol(*g[280 + slot(b)]).symbol(*g[256 + 4]).put(1, 1).symbol(*d[0])  # distance code 1: one row up
    expected = [a, b, a] + [a] * 6 + [b]
    for _ in range(6):
        expected.append(expected[-10])
    while len(expected) < 40:
        expected.append(b)
        w.symbol(*g[9])
    assert webp.decode_stream(w.bytes()).reshape(-1).tolist() == expected


def test_subtract_green_and_groups():
    w = header(Writer(), 8, 8).put(1, 1).put(webp.SUBTRACT_GREEN, 2).put(0, 1)
    w.put(0, 1).put(1, 1).put(0, 3)  # blocks of four by four
    image(w, [0 << 8, 1 << 8, 1 << 8, 0 << 8], main=False)
    for g in (10, 250):
        for value in (g, 200, 100, 255, 0):
            w.put(1, 1).put(0, 1).put(1, 1).put(value, 8)
    out = webp.decode_stream(w.bytes())
    for y in range(8):
        for x in range(8):
            g = 250 if (y >= 4) != (x >= 4) else 10
            assert out[y, x] == 255 << 24 | (200 + g & 255) << 16 | g << 8 | (100 + g & 255)


def predicted(mode, L, T, TR, TL):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [x + t - c for x, t, c in zip(L, T, TL)]
        return L if sum(abs(a - b) for a, b in zip(p, L)) < sum(abs(a - b) for a, b in zip(p, T)) else T
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(L, T, TL)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(L, T), TL)]
    return [[0, 0, 0, 255], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 6, 5
    pixels = np.array(rng_pixels(width * height, mode), np.uint32)
    own = pixels.view(np.uint8).reshape(height, width, 4).astype(int)
    residual = np.zeros_like(own)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = own[0, x - 1].tolist() if x else [0, 0, 0, 255]
            elif x == 0:
                guess = own[y - 1, 0].tolist()
            else:
                right = own[y - 1, x + 1] if x + 1 < width else own[y, 0]
                guess = predicted(mode, *(v.tolist() for v in (own[y, x - 1], own[y - 1, x], right, own[y - 1, x - 1])))
            residual[y, x] = (own[y, x] - guess) & 255
    w = header(Writer(), width, height).put(1, 1).put(webp.PREDICTOR, 2).put(1, 3)
    image(w, [mode << 8], main=False)
    w.put(0, 1)
    image(w, residual.astype(np.uint8).reshape(-1).view(np.uint32).tolist())
    assert (webp.decode_stream(w.bytes()).reshape(-1) == pixels).all()


def test_cross_colour():
    width, height = 5, 4
    pixels, factors = rng_pixels(20, 3), (200, 7, 130)  # green to red, green to blue, red to blue
    signed = lambda v: v - 256 if v > 127 else v
    coded = []
    for p in pixels:
        a, red, green, blue = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        new_red = red - (signed(factors[0]) * signed(green) >> 5) & 255
        new_blue = blue - (signed(factors[1]) * signed(green) >> 5) - (signed(factors[2]) * signed(red) >> 5) & 255
        coded.append(a << 24 | new_red << 16 | green << 8 | new_blue)
    w = header(Writer(), width, height).put(1, 1).put(webp.CROSS_COLOUR, 2).put(1, 3)
    image(w, [255 << 24 | factors[2] << 16 | factors[1] << 8 | factors[0]], main=False)
    w.put(0, 1)
    image(w, coded)
    assert webp.decode_stream(w.bytes()).reshape(-1).tolist() == pixels


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 255, 256])
@pytest.mark.parametrize("width", [1, 3, 192])
def test_palettes(n, width):
    r = np.random.default_rng(n)
    samples = r.choice(256, n, replace=False)[r.integers(0, n, (4, width))].astype(np.uint8)
    assert ((webp.decode(webp.encode_samples(samples)) >> 8 & 255) == samples).all()


def test_broken_streams():
    good = webp.encode_samples(np.arange(192, dtype=np.uint8).reshape(1, -1))
    for data in (b"", good[:30], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(data)


def images():
    r = np.random.default_rng(21)
    for k in range(180):
        w, h = int(r.integers(1, 220)), int(r.integers(1, 40))
        yield [
            lambda: r.integers(0, 256, (h, w)),
            lambda: r.integers(0, int(r.integers(1, 40)), (h, w)),
            lambda: np.cumsum(r.integers(0, 3, (h, w)), 1),
            lambda: np.tile(r.integers(0, 256, (1, w)), (h, 1)) + r.integers(0, 2, (h, w)),
            lambda: np.resize(r.integers(0, 100, int(r.integers(1, 300))), (h, w)),
            lambda: np.minimum(255, r.geometric(0.05, (h, w))),
        ][k % 6]().astype(np.uint8)


def test_encoder_round_trips_and_symbols_equal_one_by_one(monkeypatch):
    stored = [(x, webp.encode_samples(x)) for x in images()]
    fast = [webp.decode(data) for _, data in stored]
    used = set()
    for (x, data), found in zip(stored, fast):
        assert (((found >> 8) & 255) == x).all() and ((found & 0xFFFF00FF) == 0xFF000000).all()
    monkeypatch.setattr(webp, "_read_green", lambda bits, codes, width, n: used.add(len({length for length, _ in getattr(codes[0], "used", [])}) > 2) or webp._read_symbols(bits, width, n, [codes], None, 0, [], 0))
    assert all((webp.decode(data) == found).all() for (_, data), found in zip(stored, fast)) and True in used


def test_encoder_uses_predictors_and_references(monkeypatch):
    undone, referred = [], []
    undo, symbols = webp._undo_predictor, webp._symbols
    monkeypatch.setattr(webp, "_undo_predictor", lambda *a: undone.append(int(a[4][0] >> 8) & 15) or undo(*a))
    monkeypatch.setattr(webp, "_symbols", lambda *a: _counted(symbols, referred, *a))
    slope = (np.arange(192)[None, :] * 3 + np.arange(30)[:, None] * 7).astype(np.uint8)
    rows = np.tile(np.random.default_rng(2).integers(0, 256, (1, 192)), (40, 1)).astype(np.uint8)
    text = np.frombuffer((b"a line that comes again and again in this text; " * 3 + bytes(range(97, 123))) * 12, np.uint8)[: 192 * 8].reshape(8, 192)
    for x in (slope, rows, text):
        assert (((webp.decode(webp.encode_samples(x)) >> 8) & 255) == x).all()
    assert set(undone) <= {1, 2} and undone and max(referred) >= 1


def _counted(symbols, referred, *arguments):
    out = symbols(*arguments)
    referred.append(int((out[0] >= 256).sum()))
    return out


def test_predictor_sums_equal_one_by_one():
    r = np.random.default_rng(4)
    for mode in (1, 2):
        pixels, data = r.integers(0, 1 << 32, 12 * 7, dtype=np.uint32), np.full(1, mode << 8, np.uint32)
        mixed = np.array([mode << 8, 3 << 8], np.uint32)  # the second block is beyond the image
        assert (webp._undo_predictor(pixels, 12, 7, 9, data) == webp._undo_predictor(pixels, 12, 7, 9, mixed)).all()


def test_streams_that_end_early():
    data = webp.encode_samples(np.random.default_rng(3).geometric(0.05, (20, 192)).astype(np.uint8))
    size = 20
    for cut in (len(data) // 2, 40, 25):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_stream(data[size:cut])
