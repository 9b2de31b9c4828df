"""Media columns in lossless WebP (VP8L): a decoder for the whole format, and two encoders.

``decode`` reads prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. ``encode`` can write all of these as told.
``encode_payloads`` stores many byte strings at once and chooses the features of each by its estimated size:

* *grey*: a byte is the green of a pixel; back-references (``GREY_MATCH`` bytes or more),
* the same after the left predictor, where differences are cheaper than bytes,
* *palette*: at most 16 byte values, two or more to a pixel of the packed image; back-references,
* *words*: four bytes are a pixel (green, red, blue, alpha); back-references and a colour cache.

Every file has prefix codes of its own. All are read back by one decoder: ``_opened`` reads what comes before
the pixels, ``_pixels`` the pixels, or ``_greens`` those of an image whose other channels are constant and that has no
cache, and ``_inverted`` undoes the transforms.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from covarium.llm import shared

# Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
BLACK = 0xFF000000


class Reader:
    """Bits, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 8]
        self.at += 8
        self.held |= int.from_bytes(more, "little") << self.have
        self.have += 64  # past the end all bits are 0

    def read(self, n: int) -> int:
        while self.have < n:
            self._fill()
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.have -= n
        return out

    def peek(self, n: int) -> int:
        while self.have < n:
            self._fill()
        return self.held & ((1 << n) - 1)

    def position(self) -> int:
        return self.at * 8 - self.have


class Writer:
    def __init__(self) -> None:
        self.bits, self.n = 0, 0
        self.done: list[bytes] = []

    def write(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n
        if self.n >= 4096:
            k = self.n // 8
            self.done.append((self.bits & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
            self.bits >>= 8 * k
            self.n -= 8 * k

    def bytes(self) -> bytes:
        return b"".join([*self.done, self.bits.to_bytes((self.n + 7) // 8, "little")])

    def length(self) -> int:
        return 8 * sum(map(len, self.done)) + self.n


@functools.cache
def _reversals(n: int) -> np.ndarray:
    """The n-bit numbers with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out + (1 << (n - 1 - k))])
    return out


class PrefixCode:
    """A canonical prefix code from code lengths; ``table[next bits]`` is (length, symbol), ``bits`` the code of each symbol."""

    def __init__(self, lengths) -> None:
        self.lengths = np.asarray(lengths, np.int64)
        self.bits = np.zeros(len(self.lengths), np.int64)
        used = np.flatnonzero(self.lengths)
        if len(used) <= 1:  # a lone symbol takes no bits
            self.most = 0
            self.takes, self.gives = np.zeros(1, np.int64), used[:1] if len(used) else np.zeros(1, np.int64)
            self.lengths = np.zeros(len(self.lengths), np.int64)
            return
        n = self.lengths[used]
        order = np.argsort(n, kind="stable")
        used, n = used[order], n[order]
        self.most = int(n[-1])
        span = 1 << (self.most - n)
        first = np.cumsum(span)
        if first[-1] != 1 << self.most:
            raise ValueError("code lengths are not a complete prefix code")
        back = _reversals(self.most)
        self.takes, self.gives = np.repeat(n, span)[back], np.repeat(used, span)[back]
        self.bits[used] = back[first - span]

    @functools.cached_property
    def table(self) -> list[int]:
        """For the next ``most`` bits: the symbol times 16 plus the length of its code."""
        return (self.gives << 4 | self.takes).tolist()

    def read(self, r: Reader) -> int:
        if r.have < self.most:
            r._fill()
        found = self.table[r.held & ((1 << self.most) - 1)]
        n = found & 15
        r.held >>= n
        r.have -= n
        return found >> 4


@functools.lru_cache(maxsize=2048)
def _lone(symbol: int, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    lengths[symbol] = 1
    return PrefixCode(lengths)


def _read_code(r: Reader, alphabet: int) -> PrefixCode:
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        if not two:
            return _lone(first, alphabet)
        lengths = [0] * alphabet
        lengths[first] = lengths[r.read(8)] = 1
        return PrefixCode(lengths)
    lengths = [0] * alphabet
    inner = [0] * 19
    for k in range(r.read(4) + 4):
        inner[LENGTH_ORDER[k]] = r.read(3)
    most = alphabet
    if r.read(1):
        most = 2 + r.read(2 + 2 * r.read(3))
        if most > alphabet:
            raise ValueError("too many code lengths")
    code, s, last = PrefixCode(inner), 0, 8
    read = code.read
    while s < alphabet and most:
        most -= 1
        n = read(r)
        if n < 16:
            lengths[s] = n
            s += 1
            last = n or last
            continue
        times, value = (3 + r.read(2), last) if n == 16 else (3 + r.read(3), 0) if n == 17 else (11 + r.read(7), 0)
        if s + times > alphabet:
            raise ValueError("code lengths overrun")
        if value:
            lengths[s : s + times] = [value] * times
        s += times
    return PrefixCode(lengths)


def _write_code(w: Writer, lengths: list[int]) -> PrefixCode:
    code = PrefixCode(lengths)
    used = [s for s, n in enumerate(lengths) if n] or [0]  # without symbols any one does, for it takes no bits
    if len(used) <= 2 and used[-1] < 256 and all(lengths[s] in (0, 1) for s in used):
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(1, 1)
        for s in used:
            w.write(s, 8)
        return code
    w.write(0, 1)
    parts: list[tuple[int, int, int]] = []  # symbol, extra bits and their number
    after = 0
    for s in [*used, len(lengths)]:
        gap = s - after
        while gap >= 11:
            now = min(gap, 138)
            parts.append((18, now - 11, 7))
            gap -= now
        if gap >= 3:
            parts.append((17, gap - 3, 3))
            gap = 0
        parts += [(0, 0, 0)] * gap
        if s < len(lengths):
            parts.append((lengths[s], 0, 0))
        after = s + 1
    count = [0] * 19
    for s, _, _ in parts:
        count[s] += 1
    own = _code_lengths(count, 7)
    inner = PrefixCode(own)
    w.write(15, 4)
    for k in LENGTH_ORDER:
        w.write(own[k], 3)
    w.write(0, 1)
    bits, size = inner.bits.tolist(), inner.lengths.tolist()
    for s, extra, k in parts:
        w.write(bits[s] | extra << size[s], size[s] + k)
    return code


def _code_lengths(count: list[int], limit: int) -> list[int]:
    """Huffman code lengths, flattened until none is above the limit. Of equal weights symbols come before pairs."""
    used = [s for s, c in enumerate(count) if c]
    lengths = [0] * len(count)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        order = sorted((max(count[s], floor), s) for s in used)
        n = len(order)
        weight = [c for c, _ in order]
        above = [0] * (2 * n - 1)
        leaf, pair = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (pair >= new or weight[leaf] <= weight[pair]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, pair = pair, pair + 1
                total += weight[at]
                above[at] = new
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= limit:
            for (_, s), k in zip(order, depth, strict=False):
                lengths[s] = k
            return lengths
        floor = max(2 * floor, min(c for c, _ in order))


def _write_lone(w: Writer, symbol: int) -> None:
    w.write(0b101 | symbol << 3, 11)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance of at least 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def _value(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _cells(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@dataclass
class Image:
    """An entropy-coded image: its size, the colour cache's bits, and the prefix codes of each group of tiles."""

    width: int
    height: int
    cache_bits: int
    group_bits: int
    groups_of: list[int] | None
    groups: list[list[PrefixCode]]


def _image(r: Reader, width: int, height: int, main: bool) -> Image:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups_of, bits = None, 0
    if main and r.read(1):
        bits = r.read(3) + 2
        groups_of = [(p >> 8) & 0xFFFF for p in _pixels(r, _image(r, _cells(width, bits), _cells(height, bits), False))]
    groups = [[_read_code(r, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(max(groups_of or [0]) + 1)]
    return Image(width, height, cache_bits, bits, groups_of, groups)


def _distance(d: int, width: int) -> int:
    if d > 120:
        return d - 120
    dx, dy = NEAR[d - 1]
    return max(dx + dy * width, 1)


def _pixels(r: Reader, image: Image) -> list[int]:
    """The pixels as ARGB numbers."""
    width, cache_bits, groups_of, bits = image.width, image.cache_bits, image.groups_of, image.group_bits
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    total, row_cells, group = width * image.height, _cells(width, bits), image.groups[0]
    while len(out) < total:
        if groups_of:
            y, x = divmod(len(out), width)
            group = image.groups[groups_of[(y >> bits) * row_cells + (x >> bits)]]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
            new = 1
        elif s < 280:
            new = _value(s - 256, r)
            d = _distance(_value(group[4].read(r), r), width)
            if d > len(out) or len(out) + new > total:
                raise ValueError("back-reference out of the image")
            for _ in range(new):
                out.append(out[-d])
        else:
            out.append(cache[s - 280])
            new = 1
        if cache_bits:
            for p in out[-new:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(a: int, r: int, g: int, b: int) -> int:
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def _average(p: int, q: int) -> int:
    return (p & q) + (((p ^ q) & 0xFEFEFEFE) >> 1)


def _predicted(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode in (0, 14, 15):
        return BLACK
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    lefts, tops, corner = _split(left), _split(top), _split(top_left)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(tops, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(lefts, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda v: min(max(v, 0), 255)
    if mode == 12:
        return _join(*(clamp(x + t - c) for x, t, c in zip(lefts, tops, corner, strict=True)))
    middle = _split(_average(left, top))
    return _join(*(clamp(m + int((m - c) / 2)) for m, c in zip(middle, corner, strict=True)))


def _predictions(pixels: list[int], width: int, i: int, modes: list[int], bits: int) -> int:
    """The prediction of pixel i from those before it."""
    y, x = divmod(i, width)
    if not y:
        return pixels[i - 1] if x else BLACK
    if not x:
        return pixels[i - width]
    mode = (modes[(y >> bits) * _cells(width, bits) + (x >> bits)] >> 8) & 15
    return _predicted(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def _plus(p: int, q: int, sign: int = 1) -> int:
    return _join(*(a + sign * b for a, b in zip(_split(p), _split(q), strict=True)))


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _crossed(p: int, element: int, inverse: bool) -> int:
    a, r, g, b = _split(p)
    _, red_to_blue, green_to_blue, green_to_red = _split(element)
    delta = lambda t, c: (_signed(t) * _signed(c)) >> 5
    sign = 1 if inverse else -1
    new_red = (r + sign * delta(green_to_red, g)) & 255
    red = new_red if inverse else r
    return _join(a, new_red, g, b + sign * (delta(green_to_blue, g) + delta(red_to_blue, red)))


def _green(p: int, sign: int) -> int:
    a, r, g, b = _split(p)
    return _join(a, r + sign * g, g, b + sign * g)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def _file(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


@dataclass
class Opened:
    """A file read up to its pixels."""

    reader: Reader
    width: int
    height: int
    alpha: int
    transforms: list[tuple]
    image: Image


def _opened(data: bytes) -> Opened:
    r = Reader(_chunk(data))
    if r.read(8) != SIGNATURE:
        raise ValueError("no signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    alpha = r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    full, transforms = width, []
    while r.read(1):
        kind = r.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            transforms.append((kind, bits, _pixels(r, _image(r, _cells(width, bits), _cells(height, bits), False)), width))
        elif kind == PALETTE:
            size = r.read(8) + 1
            colours = _pixels(r, _image(r, size, 1, False))
            for k in range(1, size):
                colours[k] = _plus(colours[k], colours[k - 1])
            transforms.append((kind, _palette_bits(size), colours, width))
            width = _cells(width, _palette_bits(size))
        else:
            transforms.append((kind, 0, [], width))
    return Opened(r, full, height, alpha, transforms, _image(r, width, height, True))


def _inverted(argb: np.ndarray, opened: Opened) -> np.ndarray:
    """The pixels (uint32) after all transforms are undone, last one first."""
    height = opened.height
    for kind, bits, extra, wide in reversed(opened.transforms):
        if kind == PREDICTOR and all((p >> 8) & 15 == 1 for p in extra):  # all from the left: sums along the lines
            channels = argb.reshape(height, wide).view(np.uint8).reshape(height, wide, 4).copy()
            channels[0, 0, 3] = (int(channels[0, 0, 3]) + 255) & 255
            channels[:, 0] = np.cumsum(channels[:, 0], axis=0, dtype=np.uint8)
            argb = np.ascontiguousarray(np.cumsum(channels, axis=1, dtype=np.uint8)).view(np.uint32).ravel()
        elif kind == PREDICTOR:
            pixels = argb.tolist()
            for i in range(len(pixels)):
                pixels[i] = _plus(pixels[i], _predictions(pixels, wide, i, extra, bits))
            argb = np.array(pixels, np.uint32)
        elif kind == CROSS_COLOUR:
            argb = np.array([_crossed(p, extra[(i // wide >> bits) * _cells(wide, bits) + (i % wide >> bits)], True) for i, p in enumerate(argb.tolist())], np.uint32)
        elif kind == SUBTRACT_GREEN:
            green = (argb >> 8) & 255
            argb = argb & 0xFF00FF00 | (argb + (green << 16)) & 0xFF0000 | (argb + green) & 255
        else:
            narrow, each = _cells(wide, bits), 8 >> bits
            x = np.arange(wide)
            packed = ((argb.reshape(height, narrow) >> 8) & 255)[:, x >> bits]
            colours = np.array(extra + [0] * (256 - len(extra)), np.uint32)
            argb = colours[(packed >> (each * (x & ((1 << bits) - 1))).astype(np.uint32)) & ((1 << each) - 1)].ravel()
    return argb


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file to an array (height, width, 4) of red, green, blue, alpha."""
    opened = _opened(data)
    argb = _inverted(np.array(_pixels(opened.reader, opened.image), np.uint32), opened).reshape(opened.height, opened.width)
    return np.stack([(argb >> 16) & 255, (argb >> 8) & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8)


def features_of(data: bytes) -> set[str]:
    """The features of the format that a file uses."""
    opened = _opened(data)
    out = {("predictor", "cross-colour", "subtract-green", "palette")[t[0]] for t in opened.transforms}
    if any(c[0].lengths[256:280].any() for c in opened.image.groups):
        out.add("references")
    return out | ({"cache"} if opened.image.cache_bits else set())


def _tokens(pixels: list[int], width: int, cache_bits: int, references: bool):
    """Pixels as ("literal", p), ("cache", index) and ("copy", length, distance)."""
    cache, seen, i = [None] * (1 << cache_bits), {}, 0
    out = []
    while i < len(pixels):
        key, n = tuple(pixels[i : i + 3]), 0
        if references and len(key) == 3 and key in seen:
            j = seen[key]
            while i + n < len(pixels) and n < 4096 and pixels[j + n] == pixels[i + n]:
                n += 1
            out.append((n, i - j))
        elif cache_bits and cache[slot := (CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits)] == pixels[i]:
            out.append((0, slot))
            n = 1
        else:
            out.append((-1, pixels[i]))
            n = 1
        for k in range(i, i + n):
            seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        i += n
    return out


def _write_pixels(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> None:
    near = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width >= 1}
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    cell = lambda i: 0
    if main:
        w.write(int(group_bits > 0), 1)
        if group_bits:
            w.write(group_bits - 2, 3)
            height = len(pixels) // width
            cell = lambda i: ((i // width >> group_bits) + (i % width >> group_bits)) & 1
            _write_pixels(w, [BLACK | ((x + y) & 1) << 8 for y in range(_cells(height, group_bits)) for x in range(_cells(width, group_bits))], _cells(width, group_bits), False)
    symbols, i = [], 0  # (group, [(which code, symbol, extra, bits)])
    for n, v in _tokens(pixels, width, cache_bits, references):
        if n < 0:
            a, r, g, b = _split(v)
            symbols.append((cell(i), [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]))
        elif n == 0:
            symbols.append((cell(i), [(0, 280 + v, 0, 0)]))
        else:
            s, e, k = _prefix(n)
            s2, e2, k2 = _prefix(near.get(v, v + 120))
            symbols.append((cell(i), [(0, 256 + s, e, k), (4, s2, e2, k2)]))
        i += max(n, 1)
    codes = []
    for g in range(2 if group_bits and main else 1):
        counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
        for own, parts in symbols:
            for which, s, _, _ in parts if own == g else ():
                counts[which][s] += 1
        codes.append([_write_code(w, _code_lengths(c, 15)) for c in counts])
    for own, parts in symbols:
        for which, s, e, k in parts:
            w.write(int(codes[own][which].bits[s]), int(codes[own][which].lengths[s]))
            w.write(e, k)


def encode(rgba: np.ndarray, transforms: tuple[int, ...] = (), mode: int | None = None, bits: int = 2, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> bytes:
    """A small encoder that can use every feature: ``transforms`` in order; ``mode`` fixes the predictor, else each tile has another."""
    height, width = rgba.shape[:2]
    v = rgba.astype(np.uint32)
    pixels = (v[..., 3] << 24 | v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]).ravel().tolist()
    w = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(value, n)
    for kind in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.write(bits - 2, 3)
            tiles = _cells(width, bits) * _cells(height, bits)
            if kind == PREDICTOR:
                extra = [BLACK | (t % 14 if mode is None else mode) << 8 for t in range(tiles)]
                pixels = [_plus(p, _predictions(pixels, width, i, extra, bits), -1) for i, p in enumerate(pixels)]
            else:
                extra = [_join(255, 37 * t + 11, 91 * t + 200, 53 * t + 90) for t in range(tiles)]
                pixels = [_crossed(p, extra[(i // width >> bits) * _cells(width, bits) + (i % width >> bits)], False) for i, p in enumerate(pixels)]
            _write_pixels(w, extra, _cells(width, bits), False)
        elif kind == SUBTRACT_GREEN:
            pixels = [_green(p, -1) for p in pixels]
        else:
            colours = sorted(set(pixels))
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.write(len(colours) - 1, 8)
            _write_pixels(w, colours[:1] + [_plus(b, a, -1) for a, b in zip(colours[:-1], colours[1:], strict=True)], len(colours), False)
            place, packed = {c: k for k, c in enumerate(colours)}, _palette_bits(len(colours))
            each, narrow = 8 >> packed, _cells(width, packed)
            rows = []
            for y in range(height):
                line = [0] * narrow
                for x in range(width):
                    line[x >> packed] |= place[pixels[y * width + x]] << (each * (x & ((1 << packed) - 1)))
                rows += [BLACK | k << 8 for k in line]
            pixels, width = rows, narrow
    w.write(0, 1)
    _write_pixels(w, pixels, width, True, cache_bits, references, group_bits)
    return _file(w.bytes())


# --- many payloads at once -------------------------------------------------------------------------

UNIT = 64
GREY_MATCH, WORD_MATCH = 6, 2
CACHE_BITS = 6
REPEATING = 0.4
GREEN_LIMIT = 12
MOST_COPY = 4_096


def sides(pixels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and height: ``least`` wide, or wider by powers of two where the height would pass 2**14."""
    width = np.full(len(pixels), least, np.int64)
    while (tall := -(-pixels // width) > 1 << 14).any():
        width[tall] *= 2
    if (width > 1 << 14).any():
        raise ValueError("a payload has more than 2**28 pixels")
    return width, -(-pixels // width)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of many values."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    more = np.maximum(high - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * high + ((v >> more) & 1)), np.where(small, 0, v & ((1 << more) - 1)), np.where(small, 0, more)


@functools.lru_cache(maxsize=32)
def _near_codes(width: int) -> np.ndarray:
    """Distance code of each distance up to eight lines."""
    out = np.arange(8 * width + 9) + 120
    for k, (dx, dy) in reversed(list(enumerate(NEAR))):
        if dx + dy * width >= 1:
            out[dx + dy * width] = k + 1
    return out


class Streams:
    """Symbols of many images of ARGB pixels: greedy back-references of ``least`` pixels or more, a colour cache, literals."""

    def __init__(self, px: np.ndarray, at: np.ndarray, width: np.ndarray, least: int, cache_bits: int = 0) -> None:
        self.px, self.at, self.cache_bits = px, at, cache_bits
        self.rows, self.width = len(at) - 1, width
        self.image = np.repeat(np.arange(self.rows), np.diff(at))
        self.q, self.n, self.d = self._copies(least)
        total = len(px)
        inside = np.cumsum(np.bincount(self.q, minlength=total + 1) - np.bincount(self.q + self.n, minlength=total + 1))[:total]
        self.literal = inside == 0
        self.main = ((px >> 8) & 255).astype(np.int64)
        self.start = self.literal.copy()
        self.start[self.q] = True
        if cache_bits:
            slot = (px * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)
            order = np.argsort(self.image << cache_bits | slot, kind="stable")
            key, own = (self.image << cache_bits | slot)[order], px[order]
            hit = np.zeros(total, bool)
            hit[order[1:]] = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
            hit &= self.literal
            self.main[hit] = 280 + slot[hit]
            self.literal &= ~hit
        length, self.n_extra, self.n_bits = _prefixes(self.n)
        self.main[self.q] = 256 + length
        far = self.d + 120
        for w in np.unique(width).tolist():
            near = _near_codes(w)
            own = np.flatnonzero((width[self.image[self.q]] == w) & (self.d < len(near)))
            far[own] = near[self.d[own]]
        self.far, self.d_extra, self.d_bits = _prefixes(far)
        size = 280 + (1 << cache_bits if cache_bits else 0)
        lit = np.flatnonzero(self.literal)
        count = lambda who, s, k: np.bincount(self.image[who] * k + s, minlength=self.rows * k).reshape(self.rows, k)
        self.lit = lit
        self.counts = [count(np.flatnonzero(self.start), self.main[self.start], size)]
        self.counts += [count(lit, ((px[lit] >> shift) & 255).astype(np.int64), 256) for shift in (16, 0, 24)] + [count(self.q, self.far, 40)]

    def _copies(self, least: int):
        """Places, lengths and distances: a pixel run goes back to where its first pixels stood last."""
        px, at, total = self.px, self.at, len(self.px)
        place = np.arange(total)
        first = np.flatnonzero(place + least <= at[1:][self.image])
        if not self.cache_bits:  # an image has one red, blue and alpha: runs of greens as numbers, straight from the bytes
            greens = np.zeros(total + 8, np.uint8)
            greens[:total] = px >> 8
            bits, runs = 8, np.ndarray((total,), "<u8", greens, strides=(1,)) & np.uint64((1 << 8 * least) - 1)
            key = runs.astype(np.int64)[first]
        else:
            seen, value = np.unique(px, return_inverse=True)
            bits = max(len(seen) - 1, 1).bit_length()
            key = value[first]
            for k in range(1, least):
                key = key << bits | value[first + k]
        if not self.cache_bits and total <= 1 << 20 and self.rows <= 1 << 13:  # one sort of image, hash and place; hashes of an image meet the same way in any batch
            mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            joined = self.image[first].astype(np.uint64) << np.uint64(51) | mixed << np.uint64(20) | np.arange(len(first), dtype=np.uint64)
            joined.sort()
            order = (joined & np.uint64((1 << 20) - 1)).astype(np.int64)
        else:
            key |= self.image[first] << bits * least
            order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (self.image[first[order[1:]]] == self.image[first[order[:-1]]])
        distance = np.zeros(total + 1, np.int64)
        distance[first[order[1:][same]]] = first[order[1:][same]] - first[order[:-1][same]]
        change = np.where(distance[1:] != distance[:-1], place, total)
        length = np.minimum.accumulate(change[::-1])[::-1] - place + least
        following = np.append(np.minimum.accumulate(np.where(distance[:-1] > 0, place, total)[::-1])[::-1], total)
        lane, now, found = np.arange(self.rows), at[:-1], []
        while len(lane):
            q = following[now]
            some = q < at[1:][lane]
            lane, q = lane[some], q[some]
            n = np.minimum(length[q], MOST_COPY) if len(q) else q
            found.append((q, n))
            now = q + n
        q, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(q)
        return q[order], n[order], distance[q[order]]

    def cost(self) -> np.ndarray:
        """Estimated bits of each image: entropies, extra bits, and some for each code length."""
        out = np.bincount(self.image[self.q], weights=self.n_bits + self.d_bits, minlength=self.rows)
        for c in self.counts:
            total = c.sum(axis=1)
            out = out + total * np.log2(np.maximum(total, 1)) - (c * np.log2(np.maximum(c, 1))).sum(axis=1) + 5 * (c > 0).sum(axis=1)
        return out

    def write(self, chosen: np.ndarray, heads: dict[int, Writer]) -> dict[int, bytes]:
        """The bits of the chosen images, each after its head."""
        if not chosen.any():
            return {}
        tables = [np.zeros(c.shape, np.int32) for c in self.counts]  # code times 16 plus its length
        several = [(c > 0).sum(axis=1) > 1 for c in self.counts]
        lone = [c.argmax(axis=1).tolist() for c in self.counts]
        lead = np.zeros(self.rows, np.int64)
        for i in np.flatnonzero(chosen).tolist():
            w = heads[i]
            w.write(int(self.cache_bits > 0), 1)
            if self.cache_bits:
                w.write(self.cache_bits, 4)
            w.write(0, 1)  # one group of prefix codes
            for k, c in enumerate(self.counts):
                if several[k][i] or lone[k][i] > 255:
                    code = _write_code(w, _code_lengths(c[i].tolist(), GREEN_LIMIT))
                    tables[k][i] = code.bits << 4 | code.lengths
                else:
                    _write_lone(w, lone[k][i])
            lead[i] = w.length()
        take = chosen[self.image]
        s = np.flatnonzero(self.start if chosen.all() else self.start & take)
        code = tables[0].ravel().take(self.image[s] * tables[0].shape[1] + self.main[s])
        each = np.zeros(len(self.px) + 1, np.int64)
        each[s] = code & 15
        units = [(s, code)]  # pixel, and what it writes, in order
        own = self.lit[take[self.lit]] if any(x.any() for x in several[1:4]) else np.zeros(0, np.int64)
        for k, shift in enumerate((16, 0, 24)):
            if len(own) and several[k + 1].any():
                units.append((own, tables[k + 1].ravel().take(self.image[own] << 8 | ((self.px[own] >> shift) & 255).astype(np.int64))))
        mine = take[self.q]
        q = self.q[mine]
        if len(q):
            far = tables[4].ravel().take(self.image[q] * 40 + self.far[mine])
            units += [(q, self.n_extra[mine] << 4 | self.n_bits[mine]), (q, far), (q, self.d_extra[mine] << 5 | self.d_bits[mine])]
        fields = [4] * len(units)
        if len(q):
            fields[-1] = 5  # a distance has up to 18 extra bits
        for (who, unit), field in zip(units[1:], fields[1:], strict=True):
            each[who] += unit & ((1 << field) - 1)
        run = np.cumsum(each) - each
        at = self.at
        n_bytes = np.where(chosen, (run[at[1:]] - run[at[:-1]] + lead + 7) // 8, 0)
        base = np.cumsum(n_bytes) - n_bytes
        where = run[:-1] + (8 * base + lead - run[at[:-1]])[self.image]
        total = int(n_bytes.sum()) + 8
        low, high = np.zeros(total // 4 + 2, np.uint64), np.zeros(total // 4 + 2, np.uint64)
        for (who, unit), field in zip(units, fields, strict=True):
            place = where[who]
            size = unit & ((1 << field) - 1)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            place = place[some]
            word = (unit[some] >> field).astype(np.uint64) << (place & 31).astype(np.uint64)
            slot = place >> 5
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            slot = slot[first]
            low[slot] += np.add.reduceat(word & np.uint64(0xFFFFFFFF), first)
            high[slot + 1] += np.add.reduceat(word >> np.uint64(32), first)
            where[who] += size
        raw = (low + high).astype("<u4").view(np.uint8)
        out = {}
        for i in np.flatnonzero(chosen).tolist():
            head = np.frombuffer(heads[i].bytes(), np.uint8)
            own_bytes = raw[base[i] : base[i] + n_bytes[i]]
            own_bytes[: len(head)] |= head
            out[i] = _file(own_bytes.tobytes())
        return out


def _head(width: int, height: int, alpha: int) -> Writer:
    w = Writer()
    w.write(SIGNATURE | (width - 1) << 8 | (height - 1) << 22 | alpha << 36, 40)
    return w


def _filled(data: np.ndarray, offsets: np.ndarray, size: np.ndarray):
    """Each row's bytes, with zeros up to ``size``."""
    have = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(size)])
    if (have == size).all():
        return data, at
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], have)] = data
    return out, at


def _repeating(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each row's four-byte words that a cache of two to the CACHE_BITS of them would hold."""
    word = data.view(np.uint32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at) // 4)
    slot = row << CACHE_BITS | (word * np.uint32(CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = (slot[order][1:] == slot[order][:-1]) & (word[order][1:] == word[order][:-1])
    return np.bincount(row[order][1:][hit], minlength=len(at) - 1) / np.maximum(np.diff(at) // 4, 1)


def _left(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Differences to the byte on the left, at the start of a line to the one above."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    p = np.arange(len(data)) - at[:-1][row]
    back = np.where(p % width[row] == 0, width[row], 1)
    return data - np.where(p >= back, data[np.arange(len(data)) - np.minimum(back, p)], 0).astype(np.uint8)


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Files that hold each row's bytes, each with the features that make it smallest; rows have a positive multiple of UNIT bytes.

    Files of four bytes a pixel are marked as such by the format's bit for alpha. Where an image is wider than UNIT bytes,
    its last line is filled with bytes 0.
    """
    rows = len(offsets) - 1
    width, height = sides(np.diff(offsets), UNIT)
    grey, at = _filled(data, offsets, width * height)
    row = np.repeat(np.arange(rows), np.diff(at))
    level = lambda x: x.astype(np.uint32) << np.uint32(8)
    histogram = np.bincount(row << 8 | grey, minlength=rows << 8).reshape(rows, 256)
    differ = _left(grey, at, width)
    entropy = lambda c: c.sum(axis=1) * np.log2(c.sum(axis=1)) - (c * np.log2(np.maximum(c, 1))).sum(axis=1)
    smooth = entropy(np.bincount(row << 8 | differ, minlength=rows << 8).reshape(rows, 256)) + 256 < entropy(histogram)
    few = ((histogram > 0).sum(axis=1) <= 16) & ~smooth
    px = level(np.where(smooth[row], differ, grey))
    px |= np.where(smooth[row], 0, BLACK).astype(np.uint32)
    plain = Streams(px, at, width, GREY_MATCH)
    as_words = np.zeros(rows, bool)
    may = np.flatnonzero(~few & ~smooth & (_repeating(grey, at) > REPEATING))
    out: dict[int, bytes] = {}
    if len(may):
        wide, tall = sides(np.diff(at)[may] // 4, UNIT // 4)
        took = np.concatenate([grey[at[i] : at[i + 1]] for i in may.tolist()])
        packed, at4 = _filled(took, np.concatenate([[0], np.cumsum(np.diff(at)[may])]), 4 * wide * tall)
        four = packed.reshape(-1, 4).astype(np.uint32)
        words = Streams(four[:, 3] << 24 | four[:, 1] << 16 | four[:, 0] << 8 | four[:, 2], at4 // 4, wide, WORD_MATCH, CACHE_BITS)
        cheaper = words.cost() < plain.cost()[may] + 32
        as_words[may[cheaper]] = True
        heads = {}
        for k in np.flatnonzero(cheaper).tolist():
            heads[k] = _head(int(wide[k]), int(tall[k]), 1)
            heads[k].write(0, 1)
        out = {int(may[k]): f for k, f in words.write(cheaper, heads).items()}
    heads = {}
    for i in np.flatnonzero(~few & ~as_words).tolist():
        heads[i] = w = _head(int(width[i]), int(height[i]), 0)
        if smooth[i]:
            w.write(1, 1)
            w.write(PREDICTOR, 2)
            w.write(7, 3)
            tiles = _cells(int(width[i]), 9), _cells(int(height[i]), 9)
            _write_pixels(w, [BLACK | 1 << 8] * (tiles[0] * tiles[1]), tiles[0], False)
        w.write(0, 1)
    out |= plain.write(~few & ~as_words, heads)
    if few.any():
        out |= _palettes(grey, at, width, height, histogram, np.flatnonzero(few))
    return [out[i] for i in range(rows)]


def _palettes(grey, at, width, height, histogram, few) -> dict[int, bytes]:
    """Files of the rows ``few``, with a palette and several bytes in a pixel of the packed image."""
    heads, parts, narrow = {}, [], []
    for k, i in enumerate(few.tolist()):
        colours = np.flatnonzero(histogram[i])
        bits = _palette_bits(len(colours))
        each, line = 8 >> bits, _cells(int(width[i]), bits)
        place = np.zeros(256, np.int64)
        place[colours] = np.arange(len(colours))
        image = place[grey[at[i] : at[i + 1]]].reshape(int(height[i]), line, 1 << bits)
        parts.append((image << (each * np.arange(1 << bits))).sum(axis=2).ravel())
        narrow.append(line)
        heads[k] = w = _head(int(width[i]), int(height[i]), 0)
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        _write_pixels(w, [BLACK | int(colours[0]) << 8, *(int(c) << 8 for c in np.diff(colours))], len(colours), False)
        w.write(0, 1)
    px = np.uint32(BLACK) | np.concatenate(parts).astype(np.uint32) << np.uint32(8)
    streams = Streams(px, np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.array(narrow), GREY_MATCH)
    return {int(few[k]): f for k, f in streams.write(np.ones(len(few), bool), heads).items()}


def decode_payloads(files: list[bytes]) -> list[bytes]:
    """The bytes that each file holds: the greens, or where the format's bit for alpha is set green, red, blue and alpha."""
    out = []
    for f in files:
        o = _opened(f)
        if o.image.cache_bits or o.image.groups_of or any(c.most for c in o.image.groups[0][1:4]):
            argb = np.array(_pixels(o.reader, o.image), np.uint32)
        else:
            greens = _greens(o)
            if not o.transforms and not o.alpha:
                out.append(greens)
                continue
            red, blue, alpha = (int(c.gives[0]) for c in o.image.groups[0][1:4])
            argb = np.frombuffer(greens, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
        argb = _inverted(argb, o)
        if o.alpha:
            out.append(np.stack([(argb >> 8) & 255, (argb >> 16) & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8).tobytes())
        else:
            out.append(((argb >> 8) & 255).astype(np.uint8).tobytes())
    return out


def _greens(opened: Opened) -> bytes:
    """The pixels' greens, of an image whose other channels are constant, so that their codes take no bits."""
    r, image = opened.reader, opened.image
    green, far, width = image.groups[0][0], image.groups[0][4], image.width
    table, mask, total, data = green.table, (1 << green.most) - 1, image.width * image.height, r.data
    far_table, far_mask, spread = far.table, (1 << far.most) - 1, _extras()
    out = bytearray()
    literal = out.append
    held, have, at, n = r.held, r.have, r.at, 0
    while n < total:
        if have < 64:  # enough for a whole back-reference
            held |= int.from_bytes(data[at : at + 24], "little") << have
            at += 24
            have += 192
        found = table[held & mask]
        held >>= found & 15
        have -= found & 15
        if found < 4096:
            literal(found >> 4)
            n += 1
            continue
        least, extra = spread[(found >> 4) - 256]
        length = least + (held & ((1 << extra) - 1))
        held >>= extra
        found = far_table[held & far_mask]
        held >>= found & 15
        least, more = spread[found >> 4]
        d = least + (held & ((1 << more) - 1))
        held >>= more
        have -= extra + (found & 15) + more
        d = d - 120 if d > 120 else _distance(d, width)
        if d > n or n + length > total:
            raise ValueError("back-reference out of the image")
        if d >= length:
            out += out[n - d : n - d + length]
        else:
            piece = bytes(out[n - d :])
            out += (piece * (length // d + 1))[:length]
        n += length
    return bytes(out)


@functools.cache
def _extras() -> list[tuple[int, int]]:
    """Least value and number of extra bits of each length or distance symbol."""
    return [(s + 1, 0) if s < 4 else (((2 + (s & 1)) << ((s - 2) >> 1)) + 1, (s - 2) >> 1) for s in range(40)]


def _media_batches(batches):
    for batch in batches:
        data, offsets = shared.utf8(batch.column(1))
        for a, b in shared.row_chunks(offsets, 16 << 20, 6_000):
            size = np.diff(offsets[a : b + 1])
            padded = np.maximum(-(-size // UNIT), 1) * UNIT
            at = np.concatenate([[0], np.cumsum(padded)])
            payload = np.zeros(int(at[-1]), np.uint8)
            part = data[offsets[a] : offsets[b]]
            payload[np.arange(len(part)) + np.repeat(at[:-1] - (offsets[a:b] - offsets[a]), size)] = part
            files: list[bytes] = []
            for x, y in shared.row_chunks(at):
                files += encode_payloads(payload[at[x] : at[y]], at[x : y + 1] - at[x])
            back = [raw[:n] for raw, n in zip(decode_payloads(files), padded.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(size),
                    pa.array(files, pa.binary()),
                    pa.array(padded),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
                    pa.array([feature(np.frombuffer(x, np.uint8)) for x in back]),
                ],
                ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"],
            )


def feature(samples: np.ndarray) -> str:
    """A coarse description of the samples: how many, their mean (in hundredths) and the counts in four bands of 64."""
    mean = int(samples.sum(dtype=np.int64)) * 100 // max(len(samples), 1)
    return f"n={len(samples)};mean={mean};bands=" + "/".join(map(str, np.bincount(samples >> 6, minlength=4).tolist()))


def store(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, feature)``.

    ``media`` is a lossless WebP file of the text's UTF-8 bytes, filled with bytes 0 to a positive
    multiple of 64; the other columns come from the samples read back from it. Null and empty
    texts have n_bytes 0 and one unit of zeros. Equal texts give equal values: what a file holds depends on its
    text alone. Texts above 1 MiB get wider images. Repeated rows give repeated results, ties cannot come up; extra columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    return shared.only(docs, "doc_id", "text").mapInArrow(_media_batches, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def read_images(media: DataFrame) -> DataFrame:
    """``media(id, media)`` to ``(id, width, height, pixels)``: any lossless WebP file to RGBA bytes, row by row; broken or null files give nulls."""

    def run(batches):
        for batch in batches:
            rows = []
            for f in batch.column(1).to_pylist():
                try:
                    a = decode(f)
                    rows.append((a.shape[1], a.shape[0], a.tobytes()))
                except (ValueError, TypeError, IndexError):
                    rows.append((None, None, None))
            w, h, p = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.binary())], ["id", "width", "height", "pixels"])

    return shared.only(media, "id", "media").mapInArrow(run, "id long, width int, height int, pixels binary")
