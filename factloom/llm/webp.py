"""Lossless WebP images: an encoder and a decoder of the VP8L bit stream, on pixel arrays of uint32 (0xAARRGGBB).

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where only green varies, as in images of bytes, greens are read by
a loop of their own. encode() applies what it is told to; byte_stream() finds back-references in an image of bytes and
lays codes and bits out with numpy.
"""

from __future__ import annotations

import heapq
import struct
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format.
LENGTH_CODES, DISTANCE_CODES = 24, 40
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_CODE = 15
#: Neighbours of short distance codes, nearest first.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """A bit stream, least significant bit first."""

    def __init__(self, data: bytes = b""):
        self.data, self.size, self.at = data + b"\0" * 8, 8 * len(data), 0
        self.parts: list[tuple[int, int]] = []

    def look(self) -> int:
        """The next 32 bits or more."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        out = self.look() & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return out

    def write(self, value: int, n: int) -> None:
        self.parts.append((value, n))

    def joined(self) -> tuple[int, int]:
        value = size = 0
        for v, n in self.parts:
            value |= v << size
            size += n
        return value, size

    def bytes(self) -> bytes:
        value, size = self.joined()
        return value.to_bytes((size + 7) // 8, "little")


# ---- prefix codes


def code_lengths(weights: dict[int, float], most: int = MAX_CODE) -> dict[int, int]:
    """Huffman code lengths of the symbols of positive weight, at most `most`; a lone symbol has length 0."""
    live = {s: w for s, w in weights.items() if w > 0}
    if len(live) < 2:
        return dict.fromkeys(live, 0)
    floor = 0.0
    while True:
        # nodes by number: symbols first, then the nodes that two others make
        symbols = sorted(live)
        heap = [(max(live[s], floor), k) for k, s in enumerate(symbols)]
        heapq.heapify(heap)
        up, new = [0] * (2 * len(symbols) - 1), len(symbols)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heapreplace(heap, (heap[0][0] + a[0], new))
            up[a[1]] = up[b[1]] = new
            new += 1
        depth = [0] * new
        for k in range(new - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        lengths = {s: depth[k] for k, s in enumerate(symbols)}
        if max(lengths.values()) <= most:
            return lengths
        floor = floor * 2 if floor else sum(live.values()) / (1 << most)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits as they stand in the stream, number of bits) of each symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)
        code += 1
    return out


def write_code(bits: Bits, lengths: dict[int, int], size: int) -> None:
    """A prefix code of an alphabet of `size` symbols."""
    used = sorted(lengths)
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        bits.write(1, 1)
        bits.write(len(used) - 1, 1)
        bits.write(int(used[0] > 1), 1)
        bits.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            bits.write(used[1], 8)
        return
    row = [lengths.get(s, 0) or (1 if s in lengths and len(lengths) == 1 else 0) for s in range(size)]
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    k, before = 0, 8
    while k < size:
        run = 1
        while k + run < size and row[k + run] == row[k]:
            run += 1
        take = run
        if row[k] == 0 and run >= 3:
            take = min(run, 138)
            tokens.append((18, take - 11, 7) if take > 10 else (17, take - 3, 3))
        elif row[k] and row[k] == before and run >= 3:
            take = min(run, 6)
            tokens.append((16, take - 3, 2))
        else:
            take = 1
            tokens.append((row[k], 0, 0))
            before = row[k] or before
        k += take
    counts: dict[int, float] = {}
    for s, _, _ in tokens:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    codes = canonical(own)
    shown = {s: n or 1 for s, n in own.items()}
    upto = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if s in shown) + 1
    bits.write(0, 1)
    bits.write(max(upto, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(upto, 4)]:
        bits.write(shown.get(s, 0), 3)
    bits.write(0, 1)
    for s, extra, n in tokens:
        bits.write(*codes[s])
        bits.write(extra, n)


def read_code(bits: Bits, size: int) -> dict[int, int]:
    """Code lengths by symbol; a lone symbol has length 0."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        used = [bits.read(8 if wide else 1)]
        if two:
            used.append(bits.read(8))
        return dict.fromkeys(used, 1 if len(set(used)) > 1 else 0)
    own = {}
    for s in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        if n := bits.read(3):
            own[s] = n
    table = Table(own if len(own) > 1 else dict.fromkeys(own, 0))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: dict[int, int] = {}
    k, before = 0, 8
    while k < size and left:
        left -= 1
        s = table.read(bits)
        if s < 16:
            if s:
                lengths[k] = before = s
            k += 1
        elif s == 16:
            for _ in range(3 + bits.read(2)):
                lengths[k] = before
                k += 1
        else:
            k += 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
    return lengths if len(lengths) > 1 else dict.fromkeys(lengths, 0)


class Table:
    """A look-up of the next bits, as many as the longest code has: symbol, and number of bits."""

    def __init__(self, lengths: dict[int, int]):
        if len(lengths) > 1 and sum(1 << (MAX_CODE - n) for n in lengths.values()) != 1 << MAX_CODE:
            raise ValueError("not a complete prefix code")
        self.top = max(lengths.values(), default=0)
        self.symbols = np.zeros(1 << self.top, dtype=np.int32)
        self.sizes = np.zeros(1 << self.top, dtype=np.int32)
        for s, (code, n) in canonical(lengths).items():
            self.symbols[code :: 1 << n] = s
            self.sizes[code :: 1 << n] = n
        self.greatest = max(lengths, default=0)

    @cached_property
    def symbol_list(self) -> list[int]:
        return self.symbols.tolist()

    @cached_property
    def size_list(self) -> list[int]:
        return self.sizes.tolist()

    def read(self, bits: Bits) -> int:
        look = bits.look() & ((1 << self.top) - 1)
        bits.at += self.size_list[look]
        if bits.at > bits.size:
            raise ValueError("the stream ends early")
        return self.symbol_list[look]


@lru_cache(maxsize=64)
def table_of(lengths: tuple[tuple[int, int], ...]) -> Table:
    return Table(dict(lengths))


# ---- numbers with extra bits


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix, extra value and extra bits of a length or distance (from 1)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def value_of(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


# ---- transforms on pixels


def channels(pixels: np.ndarray) -> np.ndarray:
    """alpha, red, green, blue as int32, in front."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)]).astype(np.int32)


def pixels_of(parts: np.ndarray) -> np.ndarray:
    a, r, g, b = (x.astype(np.uint32) & np.uint32(255) for x in parts)
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predicted(mode: int, left, top, right, corner):
    """The prediction of one pixel, or of many, from its left, top, top-right and top-left neighbours (four channels each)."""
    half = lambda a, b: (a + b) // 2
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]).reshape((4,) + (1,) * (top.ndim - 1)), top.shape)
    if mode == 11:
        toward_left = np.abs(top - corner).sum(axis=0) < np.abs(left - corner).sum(axis=0)
        return np.where(toward_left, left, top)
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        diff = mean - corner
        return np.clip(mean + np.sign(diff) * (np.abs(diff) // 2), 0, 255)
    return {
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top), 8: lambda: half(corner, top),
        9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }[mode]()


def along(parts: np.ndarray, axis: int, restore: bool) -> np.ndarray:
    """predict_all() where all pixels are predicted by the left one (axis 2) or the upper one (axis 1): sums or differences along rows or columns."""
    black = np.array([255, 0, 0, 0])
    out = parts.copy()
    # the first column goes by the upper pixel, the first row by the left one, whatever the mode
    border, rest = (slice(None), slice(None), 0) if axis == 2 else (slice(None), 0, slice(None)), slice(1, None)
    if restore:
        out[:, 0, 0] += black
        out[border] = np.cumsum(out[border], axis=1) & 255
        return np.cumsum(out, axis=axis) & 255
    inner = (slice(None), slice(None), rest) if axis == 2 else (slice(None), rest, slice(None))
    out[inner] = np.diff(parts, axis=axis)
    out[border][:, 1:] = np.diff(parts[border], axis=1)
    out[:, 0, 0] = parts[:, 0, 0] - black
    return out & 255


def predict_all(parts: np.ndarray, modes: np.ndarray, bits: int, restore: bool) -> np.ndarray:
    """Residuals of an image (channels, rows, columns), or with restore the image of its residuals."""
    _, h, w = parts.shape
    if (modes == modes.flat[0]).all() and modes.flat[0] in (1, 2):
        return along(parts, 2 if modes.flat[0] == 1 else 1, restore)
    out = parts.copy()
    image = out if restore else parts
    black = np.array([255, 0, 0, 0])
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = black if x == 0 else image[:, 0, x - 1]
            elif x == 0:
                p = image[:, y - 1, 0]
            else:
                right = image[:, y - 1, x + 1] if x + 1 < w else image[:, y, 0]
                p = predicted(int(modes[y >> bits, x >> bits]), image[:, y, x - 1], image[:, y - 1, x], right, image[:, y - 1, x - 1])
            out[:, y, x] = (parts[:, y, x] + (p if restore else -p)) & 255
    return out


def signed(x):
    return (x ^ 128) - 128


def cross_colour(parts: np.ndarray, elements: np.ndarray, bits: int, restore: bool) -> np.ndarray:
    """elements: per block green-to-red, green-to-blue and red-to-blue as they stand in blue, green and red."""
    _, h, w = parts.shape
    e = channels(elements)
    rows, cols = np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits
    to_red, to_blue, red_to_blue = signed(e[3][rows, cols]), signed(e[2][rows, cols]), signed(e[1][rows, cols])
    a, r, g, b = parts
    delta = lambda t, c: (t * signed(c)) >> 5
    if restore:
        r = (r + delta(to_red, g)) & 255
        b = (b + delta(to_blue, g) + delta(red_to_blue, r)) & 255
    else:
        b = (b - delta(to_blue, g) - delta(red_to_blue, r)) & 255
        r = (r - delta(to_red, g)) & 255
    return np.stack([a, r, g, b])


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


# ---- encoder


@lru_cache(maxsize=16)
def near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS))) if x + y * width > 0}


@lru_cache(maxsize=16)
def near_table(width: int) -> np.ndarray:
    """The codes of all distances up to the largest one that has a short code."""
    near = near_codes(width)
    return np.array([near.get(d, d + len(NEIGHBOURS)) for d in range(max(near) + 1)], dtype=np.int64)


@lru_cache(maxsize=16)
def near_distances(width: int) -> list[int]:
    """The distance of each short code, from code 1 on."""
    return [max(1, x + y * width) for x, y in NEIGHBOURS]


def tokens_of(pixels: np.ndarray, width: int, cache_bits: int, references: bool):
    """Literals (the pixel), cache hits ("c", index) and references ("r", length, distance code), first to last."""
    flat = pixels.tolist()
    cache = [None] * (1 << cache_bits) if cache_bits else None
    seen: dict[tuple, int] = {}
    near = near_codes(width)
    k, n = 0, len(flat)

    def note(upto):
        nonlocal k
        while k < upto:
            if references and k + 3 <= n:
                seen[flat[k], flat[k + 1], flat[k + 2]] = k
            if cache is not None:
                cache[((CACHE_MULTIPLIER * flat[k]) & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            k += 1

    while k < n:
        if references and k + 3 <= n and (at := seen.get((flat[k], flat[k + 1], flat[k + 2]))) is not None:
            long = 3
            while k + long < n and long < 4096 and flat[at + long] == flat[k + long]:
                long += 1
            yield "r", long, near.get(k - at, k - at + len(NEIGHBOURS))
            note(k + long)
            continue
        slot = ((CACHE_MULTIPLIER * flat[k]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache is not None else 0
        if cache is not None and cache[slot] == flat[k]:
            yield "c", slot
        else:
            yield flat[k]
        note(k + 1)


def write_pixels(bits: Bits, pixels: np.ndarray, width: int, cache_bits: int = 0, references: bool = False, main: bool = False) -> None:
    """An entropy-coded image: cache, (for the main image) no meta codes, five prefix codes, the pixels."""
    bits.write(int(cache_bits > 0), 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    if main:
        bits.write(0, 1)
    tokens = list(tokens_of(pixels, width, cache_bits, references))
    weights: list[dict[int, float]] = [{} for _ in range(5)]
    symbols = []  # (code, symbol) or (None, (value, bits))
    for t in tokens:
        if isinstance(t, int):
            symbols += [(0, t >> 8 & 255), (1, t >> 16 & 255), (2, t & 255), (3, t >> 24)]
        elif t[0] == "c":
            symbols.append((0, 256 + LENGTH_CODES + t[1]))
        else:
            for code, base, value in ((0, 256, t[1]), (4, 0, t[2])):
                prefix, extra, n = prefix_of(value)
                symbols += [(code, base + prefix), (None, (extra, n))]
    for code, s in symbols:
        if code is not None:
            weights[code][s] = weights[code].get(s, 0) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = []
    for w, size in zip(weights, sizes, strict=True):
        lengths = code_lengths(w)
        write_code(bits, lengths, size)
        codes.append(canonical(lengths))
    for code, s in symbols:
        bits.write(*(s if code is None else codes[code][s]))


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, block_bits: int = 3, modes=None, elements=None) -> bytes:
    """A WebP file of a pixel array; transforms in the order in which they are applied."""
    h, w = pixels.shape
    bits = Bits()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        bits.write(value, n)
    work = pixels
    for t in transforms:
        bits.write(1, 1)
        bits.write(t, 2)
        if t == SUBTRACT_GREEN:
            a, r, g, b = channels(work)
            work = pixels_of(np.stack([a, r - g, g, b - g]))
            continue
        if t == PALETTE:
            table, index = np.unique(work, return_inverse=True)
            index = index.reshape(work.shape)
            bits.write(len(table) - 1, 8)
            steps = pixels_of(np.diff(channels(table), axis=1, prepend=0))
            write_pixels(bits, steps, len(table))
            pack = palette_bits(len(table))
            per = 1 << pack
            wide = -(-work.shape[1] // per)
            full = np.zeros((h, wide * per), dtype=np.uint32)
            full[:, : work.shape[1]] = index
            bundles = sum(full[:, k::per] << np.uint32(k * (8 >> pack)) for k in range(per))
            work = np.uint32(0xFF000000) | bundles.astype(np.uint32) << np.uint32(8)
            continue
        bits.write(block_bits - 2, 3)
        shape = tuple(-(-n // (1 << block_bits)) for n in work.shape)
        if t == PREDICTOR:
            m = np.full(shape, 11) if modes is None else modes
            write_pixels(bits, (np.uint32(0xFF000000) | m.astype(np.uint32) << np.uint32(8)).ravel(), shape[1])
            work = pixels_of(predict_all(channels(work), m, block_bits, False))
        else:
            e = np.full(shape, 0xFF000000, dtype=np.uint32) if elements is None else elements
            write_pixels(bits, e.ravel(), shape[1])
            work = pixels_of(cross_colour(channels(work), e, block_bits, False))
    bits.write(0, 1)
    write_pixels(bits, work.ravel(), work.shape[1], cache_bits, references, main=True)
    return riff(bits.bytes())


#: Bytes that a reference is found by, the longest code of byte_stream() (whose tables are small), and the longest reference.
MATCH, SHORT_CODE, LONGEST = 5, 11, 4096


def references(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of references that a text of bytes is cut into, first to last; what lies between is literal.

    Of each position the last earlier one with the same MATCH bytes is looked at, and the longest stretch taken.
    """
    n = len(data)
    if n < 2 * MATCH:
        return []
    raw = data.tobytes()
    key = np.ndarray(shape=(n - MATCH + 1,), dtype="<u8", buffer=raw + b"\0" * 8, strides=(1,)) & np.uint64((1 << 8 * MATCH) - 1)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    before = np.full(len(key) + 1, -1, dtype=np.int64)
    before[order[same + 1]] = order[same]
    following = np.where(before >= 0, np.arange(len(before)), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    last, at, out = int(order[same + 1].max()), 0, []
    before, following = before.tolist(), following.tolist()
    while at <= last:
        at = following[at]
        was, long = before[at], MATCH
        while raw[was + long : was + long + 16] == raw[at + long : at + long + 16] and at + long < n:
            long += 16
        if at + long < n:
            odd = int.from_bytes(raw[was + long : was + long + 16], "little") ^ int.from_bytes(raw[at + long : at + long + 16], "little")
            long += ((odd & -odd).bit_length() - 1) >> 3 if odd else 16
        long = min(long, n - at, LONGEST)
        out.append((at, long, at - was))
        at += long
    return out


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix_of() of many lengths or distances."""
    v = values.astype(np.int64) - 1
    top = np.where(v > 1, np.floor(np.log2(np.maximum(v, 2))).astype(np.int64), 1)
    second = (v >> (top - 1)) & 1
    large = v >= 4
    return np.where(large, 2 * top + second, v), np.where(large, v - ((2 + second) << (top - 1)), 0), np.where(large, top - 1, 0)


def packed(values: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[int, int]:
    """Rows of a few values of so many bits each (at most 64 a row), one after another: as a number, and how many bits."""
    value, used = np.zeros(len(values[0]), dtype=np.uint64), np.zeros(len(values[0]), dtype=np.uint64)
    for v, n in zip(values, sizes, strict=True):
        value |= v.astype(np.uint64) << used
        used += n.astype(np.uint64)
    ends = np.cumsum(used)
    if not len(ends) or not ends[-1]:
        return 0, 0
    begin = ends - used
    words = np.zeros(int(ends[-1]) // 64 + 2, dtype=np.uint64)
    word, shift = (begin >> np.uint64(6)).astype(np.int64), begin & np.uint64(63)
    group = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[group]] += np.add.reduceat(value << shift, group)
    over = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    words[word[group] + 1] += np.add.reduceat(over, group)
    return int.from_bytes(words.tobytes(), "little"), int(ends[-1])


@lru_cache(maxsize=1)
def still_channels() -> tuple[int, int]:
    """The codes of red, blue (zero) and alpha (full) that do not vary: bits, and how many."""
    bits = Bits()
    for channel in (0, 0, 255):
        write_code(bits, {channel: 0}, 256)
    return bits.joined()


def code_arrays(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    codes, bits = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for s, (code, n) in canonical(lengths).items():
        codes[s], bits[s] = code, n
    return codes, bits


def byte_stream(data: np.ndarray, width: int) -> bytes:
    """The VP8L stream of an image of bytes (as green; alpha is full): back-references, and codes of its own."""
    height, found = len(data) // width, references(data)
    at, long, away = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    # a position is a literal where no reference covers it
    covered = np.zeros(len(data) + 1, dtype=np.int64)
    covered[at] += 1
    np.add.at(covered, at + long, -1)
    free = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    place = np.concatenate([free, at])
    order = np.argsort(place, kind="stable")
    near = near_table(width)
    away = np.where(away < len(near), near[np.minimum(away, len(near) - 1)], away + len(NEIGHBOURS))
    (lp, lx, ln), (dp, dx, dn) = prefixes(long), prefixes(away)
    none = np.zeros(len(free), dtype=np.int64)
    join = lambda a, b: np.concatenate([a, b])[order]
    green, distance = join(data[free].astype(np.int64), 256 + lp), join(none - 1, dp)
    bits = Bits()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    sizes = (256 + LENGTH_CODES, DISTANCE_CODES)
    lengths = [code_lengths({int(s): float(c) for s, c in zip(*np.unique(x[x >= 0], return_counts=True), strict=True)}, SHORT_CODE) for x in (green, distance)]
    write_code(bits, lengths[0], sizes[0])
    bits.write(*still_channels())
    write_code(bits, lengths[1], sizes[1])
    (gc, gb), (dc, db) = (code_arrays(x, n) for x, n in zip(lengths, sizes, strict=True))
    there = distance >= 0
    d = np.where(there, distance, 0)
    body, n = packed([gc[green], join(none, lx), np.where(there, dc[d], 0), join(none, dx)], [gb[green], join(none, ln), np.where(there, db[d], 0), join(none, dn)])
    head, size = bits.joined()
    return (head | body << size).to_bytes((size + n + 7) // 8, "little")


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# ---- decoder


def stream_of(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L stream of the file that begins at `at`, and where the file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    n = struct.unpack_from("<I", data, at + 16)[0]
    if end > len(data) or at + 20 + n > end:
        raise ValueError("the file ends early")
    return data[at + 20 : at + 20 + n], end


def read_codes(bits: Bits, cache_bits: int) -> list[Table]:
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    return [table_of(tuple(sorted(read_code(bits, size).items()))) for size in sizes]


def read_pixels(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits)
    meta, meta_bits = None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        shape = tuple(-(-n // (1 << meta_bits)) for n in (height, width))
        meta = (read_pixels(bits, shape[1], shape[0]) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(shape)
    groups = [read_codes(bits, cache_bits) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    codes = groups[0]
    n = width * height
    if meta is None and not cache_bits and not any(t.top for t in codes[1:4]):
        r, b, a = (t.symbol_list[0] for t in codes[1:4])
        greens = read_greens(bits, n, width, codes[0], codes[4])
        return greens.astype(np.uint32) << np.uint32(8) | np.uint32(a << 24 | r << 16 | b)
    out = [0] * n
    k = 0
    while k < n:
        if meta is not None:
            codes = groups[int(meta[k // width >> meta_bits, k % width >> meta_bits])]
        s = codes[0].read(bits)
        begun = k
        if s < 256:
            r, b, a = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out[k] = a << 24 | r << 16 | s << 8 | b
            k += 1
        elif s < 256 + LENGTH_CODES:
            long = value_of(s - 256, bits)
            distance = value_of(codes[4].read(bits), bits)
            if distance > len(NEIGHBOURS):
                distance -= len(NEIGHBOURS)
            else:
                x, y = NEIGHBOURS[distance - 1]
                distance = max(1, x + y * width)
            if distance > k or k + long > n:
                raise ValueError("a reference leaves the image")
            for _ in range(long):
                out[k] = out[k - distance]
                k += 1
        else:
            out[k] = cache[s - 256 - LENGTH_CODES]
            k += 1
        if cache_bits:
            for p in out[begun:k]:
                cache[((CACHE_MULTIPLIER * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, dtype=np.uint32)


def decode_stream(stream: bytes) -> np.ndarray:
    """The pixel array of a VP8L stream."""
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    done, width = [], w
    while bits.read(1):
        t = bits.read(2)
        if t == SUBTRACT_GREEN:
            done.append((t, 0, None, width))
        elif t == PALETTE:
            size = bits.read(8) + 1
            table = pixels_of(np.cumsum(channels(read_pixels(bits, size, 1)), axis=1))
            done.append((t, palette_bits(size), table, width))
            width = -(-width // (1 << palette_bits(size)))
        else:
            block = bits.read(3) + 2
            shape = tuple(-(-n // (1 << block)) for n in (h, width))
            done.append((t, block, read_pixels(bits, shape[1], shape[0]).reshape(shape), width))
    work = read_pixels(bits, width, h, main=True).reshape(h, width)
    for t, block, data, wide in reversed(done):
        if t == SUBTRACT_GREEN:
            a, r, g, b = channels(work)
            work = pixels_of(np.stack([a, r + g, g, b + g]))
        elif t == PALETTE:
            green = work >> np.uint32(8) & np.uint32(255)
            per, each = 1 << block, 8 >> block
            index = np.stack([green >> np.uint32(k * each) & np.uint32((1 << each) - 1) for k in range(per)], axis=2).reshape(h, -1)[:, :wide]
            work = np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0).astype(np.uint32)
        elif t == PREDICTOR:
            work = pixels_of(predict_all(channels(work), (data >> np.uint32(8) & np.uint32(255)).astype(np.int64), block, True))
        else:
            work = pixels_of(cross_colour(channels(work), data, block, True))
    return work


def read_greens(bits: Bits, n: int, width: int, greens: Table, distances: Table) -> np.ndarray:
    """The greens of n pixels of which nothing else varies."""
    data, size = bits.data, bits.size
    at, held, have = bits.at >> 3, 0, 0
    held = int.from_bytes(data[at : at + 8], "little") >> (bits.at & 7)
    have = 64 - (bits.at & 7)
    at += 8
    sym, cut, mask = greens.symbol_list, greens.size_list, (1 << greens.top) - 1
    dsym, dcut, dmask = distances.symbol_list, distances.size_list, (1 << distances.top) - 1
    near, short, out = near_distances(width), len(NEIGHBOURS), bytearray()
    put, made = out.append, 0
    while made < n:
        if have < 64:
            held |= int.from_bytes(data[at : at + 8], "little") << have
            at, have = at + 8, have + 64
            if at > size // 8 + 32:
                raise ValueError("the stream ends early")
        look = held & mask
        s, c = sym[look], cut[look]
        held >>= c
        have -= c
        if s < 256:
            put(s)
            made += 1
            continue
        p = s - 256
        if p >= LENGTH_CODES:
            raise ValueError("a cache hit without a cache")
        if p < 4:
            long = p + 1
        else:
            e = (p - 2) >> 1
            long = ((2 + (p & 1)) << e) + 1 + (held & ((1 << e) - 1))
            held >>= e
            have -= e
        look = held & dmask
        p, c = dsym[look], dcut[look]
        held >>= c
        have -= c
        if p < 4:
            away = p + 1
        else:
            e = (p - 2) >> 1
            away = ((2 + (p & 1)) << e) + 1 + (held & ((1 << e) - 1))
            held >>= e
            have -= e
        away = near[away - 1] if away <= short else away - short
        if away > made or made + long > n:
            raise ValueError("a reference leaves the image")
        if away >= long:
            begin = made - away
            out += out[begin : begin + long]
        else:
            out += (bytes(out[-away:]) * (long // away + 1))[:long]
        made += long
    bits.at = at * 8 - have
    if bits.at > size:
        raise ValueError("the stream ends early")
    return np.frombuffer(bytes(out), dtype=np.uint8)


class Runs:
    """Of a code of literals only, what the next 16 bits hold: the symbols that end within them, as bytes, and their bits."""

    def __init__(self, table: Table):
        sym, cut, mask = table.symbol_list, table.size_list, (1 << table.top) - 1
        self.rows, self.sizes = [], dict(zip(sym, cut, strict=True))
        for look in range(1 << 16):
            used, found = 0, []
            while used + (c := cut[look >> used & mask]) <= 16:
                found.append(sym[look >> used & mask])
                used += c
            self.rows.append((bytes(found), used))

    def read(self, data: bytes, begin: int, n: int) -> bytes:
        """n symbols of data from the bit `begin` on."""
        rows, parts, made, at = self.rows, [], 0, begin >> 3
        held, have = int.from_bytes(data[at : at + 8], "little") >> (begin & 7), 64 - (begin & 7)
        at += 8
        while made < n:
            if have < 16:
                held |= int.from_bytes(data[at : at + 8], "little") << have
                at, have = at + 8, have + 64
                if at > len(data) + 32:
                    raise ValueError("the stream ends early")
            found, used = rows[held & 0xFFFF]
            parts.append(found)
            made += len(found)
            held >>= used
            have -= used
        whole = b"".join(parts)
        if at * 8 - have - sum(self.sizes[s] for s in whole[n:]) > 8 * len(data):
            raise ValueError("the stream ends early")
        return whole[:n]


@lru_cache(maxsize=4)
def runs_of(table: Table) -> Runs:
    return Runs(table)


def decode_literals(stream: bytes, begin: int, table: Table) -> np.ndarray:
    """An image of bytes whose greens are literals of a known code, from the bit `begin` on."""
    size = int.from_bytes(stream[1:5], "little")
    w, h = (size & 0x3FFF) + 1, ((size >> 14) & 0x3FFF) + 1
    greens = np.frombuffer(runs_of(table).read(stream, begin, w * h), dtype=np.uint8)
    return (greens.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(h, w)
