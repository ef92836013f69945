"""Operator 6: lossless WebP media columns.

The decoder reads prefix codes (simple and normal, one group or many), back-references, the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms; it writes arrays of ARGB pixels. Many images are
decoded in step: each image of a batch is a lane, and each round gives every lane its next pixel by numpy, so that no
Python code runs for a pixel. Heads are read in step as well (the images within them are lanes, too), and transforms are
inverted for all images of a batch together.

The encoder writes the same format from RGB samples. An image of at most 256 colours gets a palette; others are written with
green subtracted, a predictor and cross-colour factors, whose tiles choose among all modes and some factors by the bits that their
pixels take. Pixels become literals, back-references to the pixel on the left or above, and cache entries, under fixed
prefix codes; fitted codes are an option.

A document's bytes are padded with spaces to rows of 64 RGB pixels (192 bytes); a medium is one image (beyond the format's 16,384
rows, 3 MB, several one after the other). Images of more than SEGMENT stored pixels carry a chunk SEEK with the bit where each
further segment begins. References and cache entries stay within a segment, so segments are lanes of their own and memory
is bounded; other readers skip the chunk and see one plain image. Null and empty texts are one row of spaces. Repeated rows
give equal media. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Generator, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Pixels of a row, and rows that the format allows.
WIDTH, ROWS = 64, 1 << 14
#: Stored pixels that are decoded by one lane.
SEGMENT = 1024
#: Tiles of modes or factors that an image has at most; sides are powers of two, from 4.
TILES = 512
#: Factors that a tile chooses from (of 32, signed bytes): green in red, and green and red in blue. Text wants its green back: -32.
RED_FACTORS = (0, 224, 240, 32)
BLUE_FACTORS = ((0, 0), (224, 0), (240, 0), (32, 0), (0, 224), (224, 16))
CACHE_BITS = 8
ROW_BYTES = 3 * WIDTH
#: Bytes of payload that are encoded or decoded together.
BATCH_BYTES = 4 << 20
#: Numbers of the container and bit stream (fixed values).
SIGNATURE, LITERALS, LENGTHS, DISTANCES, MAX_BITS = 0x2F, 256, 24, 40, 15
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
#: Chunk with the bits where further segments begin.
SEEK = b"SEEK"
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x to the left, y up) of the first 120 distance codes (fixed values).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads a stream's bits, lowest first; bits beyond its end are zeros."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def __call__(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)


class Out:
    """Collects bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += int(n)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


# Prefix codes


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words as they lie in the stream (first bit lowest)."""
    words, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        for s in np.flatnonzero(lengths == n):
            words[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return words


def lookup(lengths: np.ndarray) -> np.ndarray:
    """Table by the next bits: symbol * 16 + bits taken. A code of a single symbol takes none."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.array([int(used[0]) << 4 if len(used) else 0], np.uint32)
    if (1.0 / (1 << lengths[used].astype(np.int64))).sum() != 1:
        raise ValueError("incomplete prefix code")
    most, words = int(lengths.max()), code_words(lengths)
    table = np.zeros(1 << most, np.uint32)
    for s in used:
        table[words[s] :: 1 << int(lengths[s])] = int(s) << 4 | int(lengths[s])
    return table


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Lengths of a prefix code of so many symbols."""
    lengths = np.zeros(size, np.int64)
    if bits(1):
        two, wide = bits(1), bits(1)
        lengths[bits(8 if wide else 1)] = 1
        if two:
            lengths[bits(8)] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits(4)]:
        own[k] = bits(3)
    left = 2 + bits(2 + 2 * bits(3)) if bits(1) else size
    table, at, before = lookup(own).tolist(), 0, 8
    mask = len(table) - 1
    while at < size and left > 0:
        left -= 1
        x = table[bits(7) & mask] if mask else table[0]
        bits.at += (x & 15) - (7 if mask else 0)
        x >>= 4
        if x < 16:
            lengths[at] = x
            at += 1
            before = x or before
        else:
            n = 3 + bits(2) if x == 16 else 3 + bits(3) if x == 17 else 11 + bits(7)
            lengths[at : at + n] = before if x == 16 else 0
            at += n
    return lengths


def fit_lengths(weights: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Code lengths for weights, none above most; small weights are raised until that holds."""
    weights = np.asarray(weights, np.float64)
    used = np.flatnonzero(weights)
    lengths = np.zeros(len(weights), np.int64)
    floor = weights[used].sum() / (1 << most) if len(used) else 0
    while len(used):
        heap = [(max(weights[s], floor), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        lengths[:] = 0
        lengths[used[0]] = 1 if len(used) == 1 else 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if lengths.max() <= most:
            break
        floor *= 2
    return lengths


def write_code(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1), out.put(len(symbols) - 1, 1), out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    runs, at, values = [], 0, lengths.tolist()
    while at < len(values):
        n = 1
        while at + n < len(values) and values[at + n] == values[at]:
            n += 1
        if values[at]:
            runs.append((values[at], 0, 0))
            left = n - 1
            while left >= 3:
                runs.append((16, min(left, 6) - 3, 2))
                left -= min(left, 6)
            runs += [(values[at], 0, 0)] * left
        else:
            left = n
            while left >= 3:
                runs.append((18, min(left, 138) - 11, 7) if left >= 11 else (17, left - 3, 3))
                left -= min(left, 138)
            runs += [(0, 0, 0)] * max(left, 0)
        at += n
    own = fit_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    if np.count_nonzero(own) == 1:  # a second symbol makes the code complete
        own[np.flatnonzero(own)[0]] = 1
    words = code_words(own)
    out.put(0, 1), out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(own[k], 3)
    out.put(0, 1)
    alone = np.count_nonzero(own) == 1
    for s, extra, n in runs:
        out.put(words[s], 0 if alone else own[s])
        out.put(extra, n)


def prefix_value(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, their number) of values from 1."""
    v = np.asarray(value, np.int64) - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 1)
    second = v >> (top - 1) & 1
    n = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + second), np.where(v < 4, 0, v & ((1 << n) - 1)), n


# Decoding in step


#: Sets of five tables by their size and first bits; equal bits need no second reading.
_TABLES: dict[tuple, list[tuple[int, int, list[np.ndarray]]]] = {}


def read_tables(bits: Bits, sizes: tuple[int, ...]) -> list[np.ndarray]:
    first, by = bits.at >> 3, bits.at & 7
    peek = lambda n: int.from_bytes(bits.data[first : first + (n + by + 7) // 8], "little") >> by & ((1 << n) - 1)
    key = (sizes, peek(32))
    for n, value, tables in _TABLES.get(key, ()):
        if peek(n) == value:
            bits.at += n
            return tables
    start = bits.at
    tables = [lookup(read_code(bits, n)) for n in sizes]
    if len(_TABLES) < 64 and len(_TABLES.get(key, ())) < 8:
        _TABLES.setdefault(key, []).append((bits.at - start, peek(bits.at - start), tables))
    return tables


class Entropy:
    """What stands before the pixels of an entropy-coded image: cache bits, groups of five tables, tiles of groups."""

    def __init__(self, width: int, height: int) -> None:
        self.width, self.height = width, height
        self.tile_bits, self.tiles = 0, None

    def read(self, bits: Bits, main: bool) -> Generator:
        self.cache = bits(4) if bits(1) else 0
        if main and bits(1):
            self.tile_bits = bits(3) + 2
            self.tiles = ((yield from sub_image(bits, self.width, self.height, self.tile_bits)) >> 8 & 0xFFFF).astype(np.int64)
        groups = 1 if self.tiles is None else int(self.tiles.max()) + 1
        sizes = (LITERALS + LENGTHS + (1 << self.cache if self.cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        self.tables = [read_tables(bits, sizes) for _ in range(groups)]
        self.at = bits.at


def sub_image(bits: Bits, width: int, height: int, tile_bits: int) -> Generator:
    """Asks for the pixels of an image within a head: yields what read_heads decodes together with other heads' images."""
    head = Entropy((width + (1 << tile_bits) - 1) >> tile_bits, (height + (1 << tile_bits) - 1) >> tile_bits)
    yield from head.read(bits, False)
    return (yield bits, head)


class _Pool:
    """Tables of all lanes end to end; a set of codes that lanes share is held once."""

    def __init__(self, heads: list[Entropy]) -> None:
        parts, place, size = [], {}, 0
        self.first = np.zeros(len(heads), np.int64)
        rows: list[list[tuple[int, int]]] = []
        groups = 0
        known: dict[tuple, int] = {}
        for lane, head in enumerate(heads):
            own = tuple(map(id, head.tables))
            if own not in known:
                known[own] = groups
                for tables in head.tables:
                    row = []
                    for t in tables:
                        place.setdefault(id(t), size)
                        if place[id(t)] == size:
                            parts.append(t)
                            size += len(t)
                        row.append((place[id(t)], len(t) - 1))
                    rows.append(row)
                    groups += 1
            self.first[lane] = known[own]
        self.table = np.concatenate(parts)
        self.place = np.array([[c[0] for c in r] for r in rows], np.int64).T.copy()
        self.mask = np.array([[c[1] for c in r] for r in rows], np.int64).T.copy()


def decode_lanes(streams: list[bytes], heads: list[Entropy], bits: list[int], counts: list[int], firsts: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """ARGB pixels of each lane and the bit where each ends. Every round gives each lane that is not done one pixel.

    A lane is `counts` pixels of an image from pixel `firsts` on, which begin at the stream's bit `bits`.
    """
    count = np.array(counts, np.int64)
    order = np.argsort(-count, kind="stable")
    pool = _Pool([heads[k] for k in order])
    starts, total = [], 0
    for k in order:
        starts.append(total)
        total += len(streams[k])
    raw = np.frombuffer(b"".join(streams[k] for k in order) + bytes(16), np.uint8)
    words = np.zeros(len(raw) - 8, np.uint64)
    for j in range(8):
        words |= raw[j : len(raw) - 8 + j].astype(np.uint64) << np.uint64(8 * j)
    n = count[order]
    pos = np.array(starts, np.int64) * 8 + np.array([bits[k] for k in order], np.int64)
    width = np.array([heads[k].width for k in order], np.int64)
    cache_bits = np.array([heads[k].cache for k in order], np.int64)
    caches, shift = np.zeros((len(order), 1 << int(cache_bits.max())), np.uint32) if cache_bits.any() else None, np.minimum(32 - cache_bits, 31).astype(np.uint32)
    all_cached = bool(cache_bits.all())
    out = np.zeros((int(n[0]) if len(n) else 0, len(order)), np.uint32)
    copy, reach = np.zeros(len(order), np.int64), np.ones(len(order), np.int64)
    tiled = [(lane, heads[k], firsts[k]) for lane, k in enumerate(order) if heads[k].tiles is not None]
    lanes, near = np.arange(len(order)), np.array(NEAR, np.int64)
    table, place, mask = pool.table, pool.place, pool.mask
    last = np.array(len(words) - 1)

    def window(p: np.ndarray) -> np.ndarray:
        return (words[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)).astype(np.int64)

    one = place.shape[1] == 1  # all lanes read by one set of codes: no need to look theirs up
    places, masks = [int(x[0]) for x in place], [int(x[0]) for x in mask]
    four, low = np.uint32(4), np.uint32(15)

    def symbol(code: int, group: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = table[places[code] + (w & masks[code])] if one else table[place[code][group] + (w & mask[code][group])]
        return x >> four, x & low

    def extra(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of a prefix symbol and its extra bits at p, and where they end."""
        x = x.astype(np.int64)
        k = np.where(x < 4, 0, x - 2 >> 1)
        return np.where(x < 4, x + 1, (2 + (x & 1) << k) + (window(p) & ((1 << k) - 1)) + 1), p + k

    alpha_coded = bool((mask[3] > 0).any())
    for i in range(len(out)):
        k = int(np.searchsorted(-n, -i, side="left"))  # lanes with more than i pixels
        now = lanes[:k] if not copy[:k].any() else np.flatnonzero(copy[:k] == 0)
        if len(now):
            group = pool.first[now]
            if tiled:
                for lane, head, before in tiled:
                    at = np.searchsorted(now, lane)
                    if at < len(now) and now[at] == lane:
                        y, x = divmod(before + i, head.width)
                        group[at] += head.tiles[(y >> head.tile_bits) * ((head.width + (1 << head.tile_bits) - 1) >> head.tile_bits) + (x >> head.tile_bits)]
            p = pos[now]
            w = window(p)
            green, used = symbol(0, group, w)
            plain = green < LITERALS
            every = bool(plain.all())
            lit = slice(None) if every else np.flatnonzero(plain)
            g, w, q = group[lit], w[lit], used[lit]
            red, a = symbol(1, g, w >> q)
            q = q + a
            blue, a = symbol(2, g, w >> q)
            p_lit = p[lit] + (q + a)
            if alpha_coded:
                alpha, a = symbol(3, g, window(p_lit))
                p_lit += a
            else:
                alpha = table[places[3] if one else place[3][g]] >> four
            who = now[lit]
            out[i, who] = alpha << np.uint32(24) | red << np.uint32(16) | green[lit] << np.uint32(8) | blue
            pos[who] = p_lit
            if not every:
                hit = np.flatnonzero(green >= LITERALS + LENGTHS)
                if len(hit):
                    who = now[hit]
                    out[i, who] = caches[who, green[hit] - np.uint32(LITERALS + LENGTHS)]
                    pos[who] = p[hit] + used[hit]
                ref = np.flatnonzero((green >= LITERALS) & (green < LITERALS + LENGTHS))
                if len(ref):
                    who = now[ref]
                    length, q = extra(green[ref] - np.uint32(LITERALS), p[ref] + used[ref])
                    far, a = symbol(4, group[ref], window(q))
                    code, q = extra(far, q + a)
                    by = near[np.minimum(code, len(near)) - 1]
                    reach[who] = np.where(code > len(near), code - len(near), np.maximum(1, by[:, 0] + by[:, 1] * width[who]))
                    copy[who], pos[who] = length, q
        if copy[:k].any():
            who = np.flatnonzero(copy[:k])
            back = i - reach[who]
            if (back < 0).any():
                raise ValueError("back-reference before the first pixel")
            out[i, who] = out[back, who]
            copy[who] -= 1
        if caches is not None:
            px = out[i, :k]
            slot = px * np.uint32(CACHE_FACTOR) >> shift[:k]
            caches[lanes[:k], slot if all_cached else np.where(cache_bits[:k] > 0, slot, 0)] = px
    pixels: list[np.ndarray] = [None] * len(order)  # type: ignore[list-item]
    ends = np.zeros(len(order), np.int64)
    by_lane = np.ascontiguousarray(out.T)
    for lane, k in enumerate(order):
        pixels[k] = by_lane[lane, : n[lane]]
        ends[k] = pos[lane] - 8 * starts[lane]
    return pixels, ends


# Transforms


def channels(argb: np.ndarray) -> np.ndarray:
    """Signed channels of pixels: alpha, red, green, blue in a last axis."""
    return np.stack([(argb >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)], -1)


def argb_of(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Channels that predictor `mode` foretells from the neighbours (right: above right, corner: above left)."""
    mean = lambda a, b: a + b >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = mean(left, top)
        return np.clip(half + ((half - corner) / 2).astype(np.int32), 0, 255)
    simple = (
        lambda: np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape), lambda: left, lambda: top, lambda: right, lambda: corner, lambda: mean(mean(left, right), top), lambda: mean(left, corner),
        lambda: mean(left, top), lambda: mean(corner, top), lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
    )
    return simple[mode]() if mode < len(simple) else simple[0]()


def modes_at(tiles: np.ndarray, width: int, height: int, tile_bits: int) -> np.ndarray:
    """The tile's pixel for each pixel of the image, row by row."""
    across = (width + (1 << tile_bits) - 1) >> tile_bits
    y, x = np.divmod(np.arange(width * height), width)
    return tiles[(y >> tile_bits) * across + (x >> tile_bits)]


def _bytes(argb: np.ndarray) -> np.ndarray:
    """A copy's channels as bytes: blue, green, red, alpha in a last axis."""
    return argb.astype("<u4", copy=True).view(np.uint8).reshape(-1, 4)


def _joined(c: np.ndarray) -> np.ndarray:
    return c.reshape(-1).view("<u4").astype(np.uint32, copy=False)


def _within(first: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums from the start of each stretch on, modulo 256; first marks where stretches start."""
    starts = np.flatnonzero(first)
    total = np.cumsum(c, axis=0, dtype=np.uint8)
    before = np.concatenate([np.zeros((1, 4), np.uint8), total])[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(c))), axis=0)


def undo_predictor(residual: np.ndarray, places: Places, modes: np.ndarray) -> np.ndarray:
    """Pixels of images that lie end to end, from residuals and each pixel's mode.

    First rows and columns are sums. Others go along anti-diagonals: all pixels of x + 2y = d depend only on earlier ones.
    """
    c, x, y = _bytes(residual), places.x, places.y
    row, column = np.flatnonzero(y == 0), np.flatnonzero(x == 0)
    at = np.flatnonzero((modes > 0) & (modes < 14))
    at = at[(x[at] > 0) & (y[at] > 0)]
    begins = x[row] == 0
    top, side = c[row], c[column]
    top[begins, 3] += 255
    top = _within(begins, top)
    side[y[column] == 0] = top[begins]
    c[at, 3] += 1
    c[:, 3] += 255
    c[row], c[column] = top, _within(y[column] == 0, side)
    step = (x[at] + 2 * y[at]) * 16 + modes[at]
    order = np.argsort(step, kind="stable")
    at, step = at[order], step[order]
    cuts = [*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(at)]
    above = at - places.widths[places.image[at]]
    for first, end in pairwise(cuts):
        k, up = at[first:end], above[first:end]
        # Above right of the last column is the first pixel of the row itself.
        c[k] += predict(int(step[first] & 15), *(c[n].astype(np.int32) for n in (k - 1, up, up + 1, up - 1))).astype(np.uint8)
    return _joined(c)


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """What a colour (bytes) foretells of another by a factor, modulo 256."""
    return (factor.view(np.int8).astype(np.int16) * colour.view(np.int8) >> 5).astype(np.uint8)


def cross_colour(argb: np.ndarray, factors: np.ndarray, undo: bool = True) -> np.ndarray:
    """Add (or take away) what green foretells of red, and green and red of blue."""
    c, f = _bytes(argb), _bytes(factors)
    blue, green, red = c[:, 0], c[:, 1], c[:, 2]
    to_red = _delta(f[:, 0], green)
    if undo:
        red += to_red
        blue += _delta(f[:, 1], green) + _delta(f[:, 2], red)
    else:
        blue -= _delta(f[:, 1], green) + _delta(f[:, 2], red)
        red -= to_red
    return _joined(c)


def green_shift(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _bytes(argb)
    for k in (0, 2):
        c[:, k] += c[:, 1] if sign > 0 else -c[:, 1]
    return _joined(c)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


class Places:
    """Places of the pixels of images that lie end to end."""

    def __init__(self, widths: list[int], heights: list[int]) -> None:
        self.widths, self.heights = np.array(widths, np.int32), np.array(heights, np.int32)
        self.sizes = self.widths.astype(np.int64) * self.heights
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.image = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.inside = (np.arange(len(self.image)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.y, self.x = np.divmod(self.inside, self.widths[0] if len(set(widths)) == 1 else self.widths[self.image])

    def tiles(self, tile_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pixel's tile among the tiles of all images end to end, and the number of each image's."""
        side = 1 << tile_bits
        across = self.widths + side - 1 >> tile_bits
        n = across * (self.heights + side - 1 >> tile_bits)
        bits = tile_bits.astype(np.int32)[self.image]
        return (np.cumsum(n) - n)[self.image] + (self.y >> bits) * across.astype(np.int32)[self.image] + (self.x >> bits), n


def undo_palette(packed: np.ndarray, places: Places, palettes: list[np.ndarray]) -> np.ndarray:
    """Pixels from packed indices; places are those of the pixels."""
    bits = np.array([bundle_bits(len(p)) for p in palettes])
    stored = places.widths + (1 << bits) - 1 >> bits
    n = stored * places.heights
    b = bits[places.image]
    green = packed[(np.cumsum(n) - n)[places.image] + places.y * stored[places.image] + (places.x >> b)] >> np.uint32(8) & np.uint32(255)
    depth = 8 >> b
    index = green.astype(np.int64) >> (places.x & ((1 << b) - 1)) * depth & ((1 << depth) - 1)
    table = np.zeros((len(palettes), 256), np.uint32)
    for row, p in zip(table, palettes, strict=True):
        row[: len(p)] = p
    return table[places.image, index]


class Head:
    """A parsed image up to its pixels."""

    def read(self, body: bytes) -> Generator:
        if body[0] != SIGNATURE:
            raise ValueError("not a lossless image")
        bits = Bits(body, 8)
        self.width, self.height = bits(14) + 1, bits(14) + 1
        bits(1)
        if bits(3):
            raise ValueError("unknown version")
        self.transforms: list[tuple] = []
        width = self.width
        while bits(1):
            kind = bits(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile_bits = bits(3) + 2
                self.transforms.append((kind, width, tile_bits, (yield from sub_image(bits, width, self.height, tile_bits))))
            elif kind == PALETTE:
                n = bits(8) + 1
                deltas = channels((yield from sub_image(bits, n, 1, 0)))
                self.transforms.append((kind, width, argb_of(np.cumsum(deltas, axis=0))))
                width = (width + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
            else:
                self.transforms.append((kind, width))
        self.entropy = Entropy(width, self.height)
        yield from self.entropy.read(bits, True)


def read_heads(bodies: list[bytes]) -> list[Head]:
    """Heads of images, read in step: the images within them are decoded together."""
    heads = [Head() for _ in bodies]
    asked = []
    for head, body in zip(heads, bodies, strict=True):
        run = head.read(body)
        asked += [(run, *ask) for ask in [next(run, None)] if ask]
    while asked:
        n = [e.width * e.height for *_, e in asked]
        # A pixel takes 14 bytes at most.
        streams = [b.data[e.at >> 3 : (e.at >> 3) + 16 + 14 * k] for (_, b, e), k in zip(asked, n, strict=True)]
        pixels, ends = decode_lanes(streams, [e for *_, e in asked], [e.at & 7 for *_, e in asked], n, [0] * len(n))
        further = []
        for (run, bits, e), px, end in zip(asked, pixels, ends.tolist(), strict=True):
            bits.at = (e.at & ~7) + end
            try:
                further.append((run, *run.send(px)))
            except StopIteration:
                pass
        asked = further
    return heads


def finish(heads: list[Head], pixels: list[np.ndarray]) -> list[np.ndarray]:
    """Invert transforms, the last of an image first; images whose next one is of a kind go together."""
    pixels, left = list(pixels), [list(h.transforms) for h in heads]
    before, places, tile = None, None, (None, None)
    while any(left):
        for kind in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE):
            own = [k for k, t in enumerate(left) if t and t[-1][0] == kind]
            if not own:
                continue
            steps = [left[k].pop() for k in own]
            argb = np.concatenate([pixels[k] for k in own])
            widths = [t[1] for t in steps]
            if (own, widths) != before:
                before, places, tile = (own, widths), Places(widths, [heads[k].height for k in own]), (None, None)
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile_bits, values = [t[2] for t in steps], np.concatenate([t[3] for t in steps])
                if tile[0] != tile_bits:
                    tile = tile_bits, places.tiles(np.array(tile_bits))[0]
                argb = undo_predictor(argb, places, (values >> np.uint32(8) & np.uint32(15)).astype(np.uint8)[tile[1]]) if kind == PREDICTOR else cross_colour(argb, values[tile[1]])
            elif kind == SUBTRACT_GREEN:
                argb = green_shift(argb, 1)
            else:
                argb = undo_palette(argb, places, [t[2] for t in steps])
            for k, first, n in zip(own, places.starts.tolist(), places.sizes.tolist(), strict=True):
                pixels[k] = argb[first : first + n]
    return pixels


def parts_of(media: bytes) -> list[tuple[bytes, tuple[int, ...]]]:
    """(body, bits where further segments begin) of the lossless images in one or several containers."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP container")
        end, chunk = at + 8 + struct.unpack_from("<I", media, at + 4)[0], at + 12
        while chunk < end:
            size = struct.unpack_from("<I", media, chunk + 4)[0]
            if media[chunk : chunk + 4] == b"VP8L":
                out.append((media[chunk + 8 : chunk + 8 + size], ()))
            elif media[chunk : chunk + 4] == SEEK and out:
                out[-1] = (out[-1][0], struct.unpack_from(f"<{size // 4}I", media, chunk + 8))
            chunk += 8 + size + (size & 1)
        at = end + (end & 1)
    return out


def images_of(media: bytes) -> list[bytes]:
    """Bodies of the lossless images in one or several containers."""
    return [body for body, _ in parts_of(media)]


def decode(bodies: list[bytes], entries: list[tuple[int, ...]] | None = None) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB pixels) of each image, decoded in step; entries: bits where further segments begin."""
    heads = read_heads(bodies)
    lanes = []
    for k, (body, head) in enumerate(zip(bodies, heads, strict=True)):
        e = head.entropy
        n, bits = e.width * e.height, [e.at, *(entries[k] if entries else ())]
        if len(bits) > 1 and len(bits) != -(-n // SEGMENT):
            raise ValueError("entries do not fit the image")
        for j, (bit, end) in enumerate(zip(bits, [*bits[1:], 8 * len(body)], strict=True)):
            lanes.append((k, e, body[bit >> 3 : (end + 7) >> 3], bit & 7, min(n - j * SEGMENT, SEGMENT) if len(bits) > 1 else n, j * SEGMENT, end - (bit & ~7) if j + 1 < len(bits) else None))
    # Lanes under one set of codes are faster by themselves; many sets go together.
    sets = {}
    for lane in lanes:
        sets.setdefault(tuple(map(id, lane[1].tables)), []).append(lane)
    pixels: list[list[np.ndarray]] = [[] for _ in bodies]
    for group in sets.values() if len(sets) <= 6 else [lanes]:
        got, ends = decode_lanes([x[2] for x in group], [x[1] for x in group], [x[3] for x in group], [x[4] for x in group], [x[5] for x in group])
        for (k, *_, expected), px, end in zip(group, got, ends.tolist(), strict=True):
            if expected not in (None, end):
                raise ValueError("a segment does not end where the next begins")
            pixels[k].append(px)
    whole = finish(heads, [np.concatenate(p) if len(p) > 1 else p[0] for p in pixels])
    return [(h.width, h.height, p) for h, p in zip(heads, whole, strict=True)]


# Encoding


class Codes:
    """Five prefix codes, their stream form and code words."""

    def __init__(self, lengths: list[np.ndarray]) -> None:
        self.lengths = [np.where(np.count_nonzero(x) > 1, x, 0) for x in lengths]  # one symbol: no bits
        self.words = [code_words(x) for x in self.lengths]
        out = Out()
        for x in lengths:
            write_code(out, x)
        self.head = out


def _codes(green: np.ndarray, red: np.ndarray, blue: np.ndarray, alpha: int | np.ndarray, cache_bits: int = 0) -> Codes:
    """Codes by weights of the channels (alpha: its only value); lengths and cache slots alike, distances to the left and above."""
    parts = [green, np.full(LENGTHS, 4.0), *([np.full(1 << cache_bits, 20.0)] if cache_bits else [])]
    distance = np.zeros(DISTANCES)
    distance[:2] = 1
    return Codes([fit_lengths(x, 14) for x in (np.concatenate(parts), red, blue, np.eye(1, 256, alpha)[0] if isinstance(alpha, int) else alpha, distance)])


@lru_cache(maxsize=1)
def shared_codes() -> Codes:
    """Fixed codes for residuals of text, most of which are bytes as they are: by a rough rank of their frequency in prose."""
    weight = np.full(256, 2.0)
    weight[128:192] = 12
    weight[[0xC3, 0xE2]] = 120
    weight[[*range(1, 9), *range(248, 256)]] = 10
    weight[0] = 300
    for rank, c in enumerate(b" etaoinshrdlucmfwygpbvkqjxz"):
        weight[c] = 4000 / (rank + 2)
    weight[list(b".,\n")] = 100
    weight[list(b"ETAOINSHRDLUCMFWYGPBVKQJXZ0123456789'-")] = 20
    return _codes(weight * 3, weight, weight, 0, CACHE_BITS)


@lru_cache(maxsize=1)
def inner_codes() -> tuple[Codes, Codes, Codes, Codes]:
    """Fixed codes for tiles of modes, tiles of factors, differences of palettes, and indices into them."""
    zero, one = np.eye(1, 256, 0)[0], np.ones(256)
    modes, factors = np.zeros(256), np.zeros(256)
    modes[:14], modes[0] = 4, 60
    factors[[*RED_FACTORS, 16]], factors[224] = 8, 60
    alpha = np.eye(1, 256, 0)[0] + np.eye(1, 256, 255)[0]
    near = 1 / (1 + np.arange(256.0))
    return _codes(modes, zero, zero, 255), _codes(factors, factors, factors, 255), _codes(4 * one, one + 300 * near, one, alpha), _codes(200 * near + 1, zero, zero, 255)


def _tokens(argb: np.ndarray, image: np.ndarray, width: int, cache_bits: int):
    """Split pixels of several images (image: their numbers, rising) into tokens.

    Returns places of the tokens, their kind (0 literal, 1 cache, 2 reference), slots, lengths and distance values.
    """
    n = len(argb)
    cuts = np.flatnonzero(np.diff(image, prepend=-1))
    inside = np.arange(n) - np.repeat(cuts, np.diff(np.append(cuts, n)))
    kind, length, value = np.zeros(n, np.int8), np.ones(n, np.int64), np.zeros(n, np.int64)
    covered = np.zeros(n, bool)
    for step, code in ((1, 2), (width, 1)):
        same = np.zeros(n, bool)
        same[step:] = (argb[step:] == argb[:-step]) & (inside[step:] >= step)
        same &= ~covered
        new = same & ~np.concatenate([[False], same[:-1] & (image[1:] == image[:-1])])
        first = np.flatnonzero(new)
        run = np.cumsum(new)
        sizes = np.bincount(run[same], minlength=len(first) + 1)[1:]
        good = (sizes >= 3) & (sizes <= 4096)
        kind[first[good]], length[first[good]], value[first[good]] = 2, sizes[good], code
        covered |= np.concatenate([[False], good])[run] & same
    token = ~covered | (kind == 2)
    slot = ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64) if cache_bits else np.zeros(n, np.int64)
    if cache_bits:
        key = image << cache_bits | slot
        order = np.argsort(key, kind="stable")
        alike = np.diff(key[order]) == 0
        before, after = order[:-1][alike], order[1:][alike]
        hit = after[argb[before] == argb[after]]
        kind[hit[kind[hit] == 0]] = 1
    places = np.flatnonzero(token)
    return places, kind[places], slot[places], length[places], value[places]


def encode(argb: np.ndarray, image: np.ndarray, width: int, cache_bits: int = CACHE_BITS, codes: Codes | None = None, transforms: Out | list[Out] | None = None, main: bool = True) -> list[tuple[bytes, int]]:
    """(bytes, number of bits) of each image's entropy-coded part; codes None fits them to these pixels."""
    return encode_segments(argb, image, image, width, cache_bits, codes, transforms, main)[0]


def encode_segments(argb: np.ndarray, image: np.ndarray, segment: np.ndarray, width: int, cache_bits: int, codes: Codes | None, transforms: Out | list[Out] | None, main: bool = True) -> tuple[list[tuple[bytes, int]], list[list[int]]]:
    """encode's parts, and for each image the bits where its segments after the first begin; tokens stay within segments (numbers that rise)."""
    places, kind, slot, length, value = _tokens(argb, segment, width, cache_bits)
    lit, ref = np.flatnonzero(kind == 0), np.flatnonzero(kind == 2)
    px = argb[places[lit]]
    alpha, red, green, blue = ((px >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0))
    l_symbol, l_extra, l_bits = prefix_value(length[ref])
    d_symbol, d_extra, d_bits = prefix_value(value[ref])
    first = slot + (LITERALS + LENGTHS)
    first[lit], first[ref] = green, LITERALS + l_symbol
    if codes is None:
        sizes = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
        counts = [np.bincount(first, minlength=sizes), *(np.bincount(x, minlength=256) for x in (red, blue, alpha)), np.bincount(d_symbol, minlength=DISTANCES)]
        codes = Codes([fit_lengths(x) for x in counts])
    (w0, n0), (w1, n1), (w2, n2), (w3, n3), (w4, n4) = zip(codes.words, codes.lengths, strict=True)
    bits, n = w0[first], n0[first]
    for at, parts in ((lit, ((w1[red], n1[red]), (w2[blue], n2[blue]), (w3[alpha], n3[alpha]))), (ref, ((l_extra, l_bits), (w4[d_symbol], n4[d_symbol]), (d_extra, d_bits)))):
        v, m = bits[at], n[at]
        for word, size in parts:
            v |= word << m
            m += size
        bits[at], n[at] = v, m
    head = Out()
    if main:
        head.put(0, 1)
    head.put(bool(cache_bits), 1)
    if cache_bits:
        head.put(cache_bits, 4)
    if main:
        head.put(0, 1)
    head.put(codes.head.value, codes.head.n)
    # Each image starts at a whole byte of the pool, which is put together in words of 64 bits.
    own = image[places]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    before_pixels = transforms if isinstance(transforms, list) else [transforms or Out()] * len(starts)
    front_bits = np.array([t.n + head.n for t in before_pixels], np.int64)
    ends = np.cumsum(n)
    before = np.concatenate([[0], ends])[starts]
    sizes = np.add.reduceat(n, starts) + front_bits
    room = (sizes + 7) // 8
    base = np.concatenate([[0], np.cumsum(room)[:-1]])
    pos = ends - n + np.repeat(base * 8 + front_bits - before, np.diff(np.append(starts, len(own))))
    word, by = pos >> 6, (pos & 63).astype(np.uint64)
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    bits = bits.astype(np.uint64)
    pool = np.zeros(int(room.sum()) // 8 + 2, np.uint64)
    pool[word[cuts]] = np.bitwise_or.reduceat(bits << by, cuts)
    # What a word cannot hold goes to the next; the double shift is one by 64 where nothing is left over.
    pool[word[cuts] + 1] |= np.bitwise_or.reduceat(bits >> (np.uint64(63) - by) >> np.uint64(1), cuts)
    pool = pool.view(np.uint8)
    for first, t in zip(base.tolist(), before_pixels, strict=True):
        front = np.frombuffer((t.value | head.value << t.n).to_bytes((t.n + head.n + 7) // 8, "little"), np.uint8)
        pool[first : first + len(front)] |= front
    raw = pool.tobytes()
    further = np.flatnonzero(np.diff(segment[places], prepend=-1))
    further = further[~np.isin(further, starts)]
    which = np.searchsorted(starts, further, side="right") - 1
    entries: list[list[int]] = [[] for _ in before_pixels]
    for k, bit in zip(which.tolist(), (pos[further] - 8 * base[which]).tolist(), strict=True):
        entries[k].append(bit)
    return [(raw[b : b + r], int(s)) for b, r, s in zip(base.tolist(), room.tolist(), sizes.tolist(), strict=True)], entries


def container(width: int, height: int, body: bytes, entries: list[int] | tuple[int, ...] = ()) -> bytes:
    """A file of one image; entries: bits of body where further segments begin."""
    body = bytes([SIGNATURE]) + (width - 1 | height - 1 << 14 | 1 << 28).to_bytes(4, "little") + body
    chunks = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    if entries:  # other chunks need the extended form
        canvas = bytes(4) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
        chunks = b"VP8X" + struct.pack("<I", len(canvas)) + canvas + chunks + SEEK + struct.pack(f"<{1 + len(entries)}I", 4 * len(entries), *(40 + e for e in entries))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks


def _inner(pixels: np.ndarray, n: np.ndarray, codes: Codes) -> list[tuple[int, int]]:
    """(bits, their number) of the images within heads, n pixels of each; no token refers to the row above."""
    return [(int.from_bytes(raw, "little") & ((1 << size) - 1), size) for raw, size in encode(pixels, np.repeat(np.arange(len(n)), n), len(pixels) + 1, 0, codes, main=False)]


def subtract_predicted(argb: np.ndarray, places: Places, tile: np.ndarray, n_tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, modes of tiles): a tile takes the mode whose residuals take the fewest bits once green is added back."""
    lengths = [x.astype(np.float32) for x in shared_codes().lengths[:3]]
    # A channel lies end to end, the array is seen the other way round.
    c = np.ascontiguousarray(_bytes(argb)[:, 2::-1].T).astype(np.int16).T
    shifted = lambda k: np.concatenate([np.zeros((3, min(k, len(c))), np.int16), c.T[:, : max(len(c) - k, 0)]], 1).T
    near = left, top, right, corner = shifted(1), shifted(WIDTH), shifted(WIDTH - 1), shifted(WIDTH + 1)
    inner = np.flatnonzero((places.x > 0) & (places.y > 0))
    best, modes = np.full(n_tiles, np.inf), np.zeros(n_tiles, np.int64)
    of, own, around = tile[inner], c.T[:, inner].T, [v.T[:, inner].T for v in near]
    for mode in range(14):
        rest = own - predict(mode, *around).astype(np.int16) if mode else own
        green = rest[:, 1]
        bits = lengths[0][green & 255] + lengths[1][rest[:, 0] + green & 255] + lengths[2][rest[:, 2] + green & 255]
        cost = np.bincount(of, bits, n_tiles)
        modes, best = np.where(cost < best, mode, modes), np.minimum(cost, best)
    out = c.copy()
    edge = np.flatnonzero(places.y == 0)
    out[edge[places.x[edge] > 0]] -= left[edge[places.x[edge] > 0]]
    edge = np.flatnonzero((places.x == 0) & (places.y > 0))
    out[edge] -= top[edge]
    chosen = modes[of]
    for mode in np.unique(chosen[chosen > 0]).tolist():
        k = inner[chosen == mode]
        out[k] = c[k] - predict(mode, left[k], top[k], right[k], corner[k])
    rest = np.zeros((len(c), 4), np.uint8)
    rest[:, 2::-1] = out & 255
    return _joined(rest), modes


def subtract_colours(argb: np.ndarray, tile: np.ndarray, n_tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """(pixels, factors of tiles): a tile takes the factors whose pixels take the fewest bits."""
    _, reds, blues, *_ = (x.astype(np.float32) for x in shared_codes().lengths)
    blue, green, red = np.ascontiguousarray(_bytes(argb)[:, :3].T)
    cost = lambda lengths, left: np.bincount(tile, lengths[left], n_tiles)
    from_green, from_red = ({f: _delta(np.array([f], np.uint8), x) for f in known} for x, known in ((green, {*RED_FACTORS, *(f for f, _ in BLUE_FACTORS)}), (red, {f for _, f in BLUE_FACTORS})))
    to_red = np.array(RED_FACTORS)[np.argmin([cost(reds, red - from_green[f]) for f in RED_FACTORS], axis=0)]
    to_blue = np.array(BLUE_FACTORS)[np.argmin([cost(blues, blue - from_green[f] - from_red[h]) for f, h in BLUE_FACTORS], axis=0)]
    factors = (OPAQUE | to_blue[:, 1] << 16 | to_blue[:, 0] << 8 | to_red).astype(np.uint32)
    return cross_colour(argb, factors[tile], undo=False), factors


def _segments(places: Places) -> np.ndarray:
    n = -(-places.sizes // SEGMENT)
    return (np.cumsum(n) - n)[places.image] + places.inside // SEGMENT


def _spatial(argb: np.ndarray, heights: list[int]) -> list[bytes]:
    """Files of images with green subtracted, predictor and cross-colour."""
    places = Places([WIDTH] * len(heights), heights)
    tile_bits = np.full(len(heights), 2)
    while (many := places.tiles(tile_bits)[1] > TILES).any():
        tile_bits = tile_bits + many
    tile, n = places.tiles(tile_bits)
    mode_codes, factor_codes, *_ = inner_codes()
    rest, modes = subtract_predicted(green_shift(argb, -1), places, tile, int(n.sum()))
    rest, factors = subtract_colours(rest, tile, int(n.sum()))
    heads = []
    for m, f, side in zip(_inner(modes.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE), n, mode_codes), _inner(factors, n, factor_codes), (tile_bits - 2).tolist(), strict=True):
        head = Out()
        head.put(1, 1), head.put(SUBTRACT_GREEN, 2)
        head.put(1, 1), head.put(PREDICTOR, 2), head.put(side, 3), head.put(*m)
        head.put(1, 1), head.put(CROSS_COLOUR, 2), head.put(side, 3), head.put(*f)
        heads.append(head)
    coded, entries = encode_segments(rest, places.image, _segments(places), WIDTH, CACHE_BITS, shared_codes(), heads)
    return [container(WIDTH, h, body, e) for h, (body, _), e in zip(heights, coded, entries, strict=True)]


def _indexed(index: np.ndarray, heights: list[int], palettes: list[np.ndarray], bits: int) -> list[bytes]:
    """Files of images by their palettes, whose indices take 8 >> bits bits."""
    side = 1 << bits
    *_, palette_codes, index_codes = inner_codes()
    packed = np.zeros(len(index) // side, np.int64)
    for k in range(side):
        packed |= index[k::side] << k * (8 >> bits)
    deltas = [argb_of(np.diff(channels(p), axis=0, prepend=np.zeros((1, 4), np.int32))) for p in palettes]
    n = np.array([len(p) for p in palettes])
    heads = []
    for part, k in zip(_inner(np.concatenate(deltas), n, palette_codes), n.tolist(), strict=True):
        head = Out()
        head.put(1, 1), head.put(PALETTE, 2), head.put(k - 1, 8), head.put(*part)
        heads.append(head)
    places = Places([WIDTH >> bits] * len(heights), heights)
    coded, entries = encode_segments((packed << 8 | OPAQUE).astype(np.uint32), places.image, _segments(places), WIDTH >> bits, 0, index_codes, heads)
    return [container(WIDTH, h, body, e) for h, (body, _), e in zip(heights, coded, entries, strict=True)]


def pack_payloads(payloads: list[bytes]) -> list[bytes]:
    """The medium of each payload (a positive multiple of ROW_BYTES)."""
    most = ROWS * ROW_BYTES
    parts = [p[k : k + most] for p in payloads for k in range(0, len(p), most)]
    heights = np.array([len(p) // ROW_BYTES for p in parts])
    places = Places([WIDTH] * len(parts), heights.tolist())
    rgb = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3).astype(np.uint32)
    argb = np.uint32(OPAQUE) | rgb[:, 0] << np.uint32(16) | rgb[:, 1] << np.uint32(8) | rgb[:, 2]
    colours, index = np.unique(places.image.astype(np.int64) << 24 | (argb & np.uint32(0xFFFFFF)).astype(np.int64), return_inverse=True)
    n = np.bincount(colours >> 24, minlength=len(parts))
    first = np.cumsum(n) - n
    files: list[bytes] = [b""] * len(parts)
    # Kinds: bits by which indices are bundled, or none of them.
    kinds = np.array([bundle_bits(k) if k <= 256 else -1 for k in n.tolist()])
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        px = kinds[places.image] == kind
        if kind < 0:
            made = _spatial(argb[px], heights[own].tolist())
        else:
            palettes = [(OPAQUE | colours[first[k] : first[k] + n[k]] & 0xFFFFFF).astype(np.uint32) for k in own.tolist()]
            made = _indexed(index[px] - first[places.image[px]], heights[own].tolist(), palettes, kind)
        for k, file in zip(own.tolist(), made, strict=True):
            files[k] = file
    file = iter(files)
    return [b"".join(next(file) for _ in range(0, len(p), most)) for p in payloads]


def unpack_payloads(media: list[bytes]) -> list[bytes]:
    """RGB samples of each medium's images, end to end."""
    bodies = [parts_of(m) for m in media]
    pixels = iter(decode([b for part in bodies for b, _ in part], [e for part in bodies for _, e in part]))
    out = []
    for part in bodies:
        samples = [next(pixels)[2].astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes() for _ in part]
        out.append(b"".join(samples))
    return out


# DataFrames


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES), len(raw)


def _spans(sizes: list[int]) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to about BATCH_BYTES."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def _lengths(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def store(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media), one per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for s in _spans(_lengths(texts)):
                made = [payload(t) for t in texts[s.start : s.stop].to_pylist()]
                media = pack_payloads([p for p, _ in made])
                yield pa.record_batch([batch.column("doc_id")[s.start : s.stop], pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pixels(media: DataFrame) -> DataFrame:
    """Rows (doc_id, image, width, height, argb) of every image in the column media; argb: little-endian 32-bit pixels, row by row."""
    schema = pa.schema([("doc_id", pa.int64()), ("image", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _spans(_lengths(batch.column("media"))):
                ids, files = (batch.column(c)[s.start : s.stop].to_pylist() for c in ("doc_id", "media"))
                bodies = [(i, k, *part) for i, f in zip(ids, files, strict=True) for k, part in enumerate(parts_of(f or b""))]
                pixels = decode([b for *_, b, _ in bodies], [e for *_, e in bodies])
                rows = [(i, k, w, h, p.astype("<u4").tobytes()) for (i, k, *_), (w, h, p) in zip(bodies, pixels, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema.types, strict=True)], schema=schema)

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, "doc_id long, image int, width int, height int, argb binary")


def read(media: DataFrame) -> DataFrame:
    """Digest columns and features of the samples that the media decode to."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def row(doc_id, n, file: bytes, got: bytes) -> tuple:
        share = np.bincount(np.frombuffer(got, np.uint8), minlength=256) / len(got)
        mean = float(share @ np.arange(256))
        entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
        return doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(file), hashlib.sha256(file).hexdigest(), f"mean={mean:.4f};entropy={entropy:.4f};ratio={len(file) / len(got):.4f}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _spans(_lengths(batch.column("media"))):
                ids, sizes, files = (batch.column(c)[s.start : s.stop].to_pylist() for c in ("doc_id", "n_bytes", "media"))
                rows = [row(*x) for x in zip(ids, sizes, files, unpack_payloads(files), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(documents(spark, sf_dir)))
