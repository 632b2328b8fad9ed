"""Lossless WebP (VP8L): decoder to pixel arrays, and two writers.

``decode`` reads any VP8L image: simple and normal prefix codes, meta prefix codes, colour cache,
back-references, and the predictor, cross-colour, subtract-green and palette transforms, which it
inverts on whole rows or images where the transform allows. Images with one group of codes take a
vectorised route: where the token that would start at *every* bit ends is looked up at once, the chain
of real starts is followed, and pixels of copies and of the cache are found by pointers to literals.
``decode_many`` reads small images of one group of codes side by side, a token of every piece at a time.

``encode_payload`` stores bytes as RGB samples, 64 pixels (192 bytes) to a row, under prefix codes made
from each image's own counts, with back-references, colour cache and subtract-green where these save
bits (images of SMALL pixels at most have literals only); more than 16,384 rows become several images one after another. ``encode_payloads`` makes the images of
many texts together: their counts, codes and bits stand in arrays with a row or a key for each image.
``encode_pixels`` writes one image with any of the format's tools; it is plain and slow.

``read`` is the operator over a column of files; ``store`` turns texts to images and reads them back.

Defined cases of ``store``: null or empty text is stored as 192 spaces; equal texts give equal
values; ids may repeat or be null; extra columns are carried unless named like a result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .components import in_batches

ROW, MOST_ROWS, OPAQUE = 192, 16384, 0xFF000000

# Fixed values of the format: the order in which the lengths of the code-length code stand, and
# the (x, y) offsets of the 120 short distance codes.
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


_NEAR = np.array(NEAR)
#: Of each prefix symbol of lengths and distances: the least value, and how many bits follow.
_MORE = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)])
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)])
#: Images of fewer pixels are read token by token.
MANY = 16
#: Images of so many pixels at most are written without back-references, cache and subtract-green.
SMALL = 512
#: Bits of a stream that are looked up at a time (8 bytes each in several arrays); a multiple of 8.
SPAN = 1 << 15
_EIGHT = np.arange(8)
#: Images of so many bytes and pixels at most are read side by side; bits of a piece; steps between two looks at the chains.
LARGE, PIECE, STEPS = 1 << 18, 2048, 32
#: Texts or files of so many bytes are written or read together.
TOGETHER = 1 << 19


@lru_cache(1)
def _all_numbers(size: int) -> np.ndarray:
    return np.arange(size)


def _numbers(n: int) -> np.ndarray:
    """0 to n - 1; not to be written to."""
    return _all_numbers(SPAN + 128)[:n]


# ---- prefix codes -------------------------------------------------------------------------


@lru_cache(512)
def codes(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes, bits reversed (as they stand in the stream), and their lengths."""
    size = np.frombuffer(lengths, np.uint8).astype(np.int64)
    out, code, used = np.zeros(len(size), np.int64), 0, np.flatnonzero(size)
    if len(used) < 2:
        return out, np.zeros(len(size), np.int64)
    order = used[np.argsort(size[used], kind="stable")]
    wide = size[order]
    most = int(wide[-1])
    room = np.int64(1) << (most - wide)  # in codes of the longest length
    end = np.cumsum(room)
    if int(end[-1]) != 1 << most:
        raise ValueError("prefix code is not complete")
    out[order] = _reversed(most)[end - room]
    return out, size


@lru_cache(16)
def _reversed(bits: int) -> np.ndarray:
    """All numbers of so many bits, their bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


@lru_cache(512)
def joint(lengths: bytes) -> tuple[np.ndarray, int]:
    """For each value of the next ``bits`` bits, 16 times the symbol that they start with plus its length; and ``bits``."""
    size = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(size)
    if len(used) < 2:
        return used << 4 if len(used) else np.zeros(1, np.int64), 0
    order = used[np.argsort(size[used], kind="stable")]
    wide = size[order].astype(np.int64)
    bits = int(wide[-1])
    room = np.int64(1) << (bits - wide)
    if int(room.sum()) != 1 << bits:
        raise ValueError("prefix code is not complete")
    return np.repeat(order << 4 | wide, room)[_reversed(bits)], bits


@lru_cache(4096)
def _short_codes(lengths: bytes) -> tuple[list[int], int]:
    """``codes`` of a few short lengths, as a list, and the longest length."""
    out, code, most = [0] * len(lengths), 0, max(lengths)
    if len(lengths) - lengths.count(0) < 2:
        return out, 0
    for k in range(1, most + 1):
        code <<= 1
        at = lengths.find(k)
        while at >= 0:
            out[at] = _TURNED[code << 8 - k & 255]
            code += 1
            at = lengths.find(k, at + 1)
    if code != 1 << most:
        raise ValueError("prefix code is not complete")
    return out, most


_TURNED = [int(f"{k:08b}"[::-1], 2) for k in range(256)]


@lru_cache(4096)
def _short_joint(lengths: bytes) -> tuple[list[int], int]:
    """``joint`` of a few lengths up to 7, as a list, and the mask of its bits."""
    code, most = _short_codes(lengths)
    if not most:
        return [max((k << 4 for k, n in enumerate(lengths) if n), default=0)], 0
    out = [0] * (1 << most)
    for k, n in enumerate(lengths):
        if n:
            out[code[k] :: 1 << n] = [k << 4 | n] * (1 << most - n)
    return out, (1 << most) - 1


def table(lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next ``bits`` bits, the symbol that they start with and its length."""
    both, bits = joint(lengths)
    return both >> 4, both & 15, bits


def huffman(weights: list[int], most: int = 15) -> bytes:
    """Code lengths for the weights, none above ``most``: small weights are raised until it holds."""
    size, used = bytearray(len(weights)), [i for i, w in enumerate(weights) if w]
    weights, n = [weights[i] for i in used], len(used)
    if n == 1:
        size[used[0]] = 1
        return bytes(size)
    while True:
        # the two least of two queues are joined: symbols by weight, and sums, which come in order
        order = sorted(range(n), key=weights.__getitem__)
        never = sum(weights) + 1
        leaf, sums = [*map(weights.__getitem__, order), never, never], [never] * (n + 1)
        i = j = 0
        above, over = [], []  # of symbols and of sums, in their order
        for made in range(n - 1):
            a, b = leaf[i], sums[j]
            if a <= b:
                above.append(made)
                i += 1
                c = leaf[i]
                if c <= b:
                    above.append(made)
                    i += 1
                    sums[made] = a + c
                else:
                    over.append(made)
                    j += 1
                    sums[made] = a + b
            else:
                over.append(made)
                j += 1
                c = sums[j]
                if a <= c:
                    above.append(made)
                    i += 1
                    sums[made] = a + b
                else:
                    over.append(made)
                    j += 1
                    sums[made] = b + c
        deep = [1] * max(n - 1, 0)
        for k in range(n - 3, -1, -1):  # from the root down
            deep[k] = deep[over[k]] + 1
        if not n or deep[above[0]] <= most:
            for k, made in zip(order, above, strict=True):
                size[used[k]] = deep[made]
            return bytes(size)
        floor = sum(weights) >> (most - 2)
        weights = [max(w, floor) for w in weights]


# ---- reading ------------------------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        lo = self.at >> 3
        v = int.from_bytes(self.data[lo : lo + 5 + (n >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("image ends early")
        return v

    def symbol(self, t: tuple[np.ndarray, np.ndarray, int]) -> int:
        symbol, length, bits = t
        lo = self.at >> 3
        v = int.from_bytes(self.data[lo : lo + 4], "little") >> (self.at & 7) & ((1 << bits) - 1)
        self.at += int(length[v])
        if self.at > 8 * len(self.data):
            raise ValueError("image ends early")
        return int(symbol[v])


def _read_code(bits: Bits, alphabet: int) -> bytes:
    size = bytearray(alphabet)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        size[bits.read(8 if wide else 1)] = 1
        if two:
            size[bits.read(8)] = 1
        return bytes(size)
    own, many = bytearray(19), 4 + bits.read(4)
    raw = bits.read(3 * many)
    for k in LENGTH_ORDER[:many]:
        own[k] = raw & 7
        raw >>= 3
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    both, mask = _short_joint(bytes(own))
    at, last, here, raw, held = 0, 8, bits.at, 0, 0
    while at < alphabet and left:
        left -= 1
        if held < 16:
            raw, held = int.from_bytes(bits.data[here >> 3 : (here >> 3) + 16], "little") >> (here & 7), 120
        k = both[raw & mask]
        n = k & 15
        raw >>= n
        k >>= 4
        if k < 16:
            size[at] = k
            last, at = k or last, at + 1
        else:
            more, least = (2, 3) if k == 16 else (3, 3) if k == 17 else (7, 11)
            many = least + (raw & ((1 << more) - 1))
            raw >>= more
            n += more
            if at + many > alphabet:
                raise ValueError("code lengths run over")
            if k == 16:
                size[at : at + many] = bytes([last]) * many
            at += many
        here += n
        held -= n
    bits.at = here
    if here > 8 * len(bits.data):
        raise ValueError("image ends early")
    return bytes(size)


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[bytes]:
    """Code lengths of a group. A code whose bits are those of the one before it is the same code."""
    out: list[bytes] = []
    raw = many = 0
    for k, n in enumerate(sizes):
        began = bits.at
        if k and n == sizes[k - 1] and began + many <= 8 * len(bits.data):
            if bits.read(many) == raw:
                out.append(out[-1])
                continue
            bits.at = began
        out.append(_read_code(bits, n))
        many, bits.at = bits.at - began, began
        raw = bits.read(many)
    return out


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_pixels(bits: Bits, w: int, h: int, top: bool) -> np.ndarray:
    """One entropy-coded image as ARGB values."""
    found = _begin_pixels(bits, w, h, top)
    return _read_tokens(*found) if isinstance(found, tuple) else found


def _begin_pixels(bits: Bits, w: int, h: int, top: bool) -> np.ndarray | tuple:
    """As ``_read_pixels``, or the arguments of ``_read_tokens`` where that would read the pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, shift = 1, None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        mw, mh = -(-w >> shift), -(-h >> shift)
        meta = (_read_pixels(bits, mw, mh, False) >> 8 & 0xFFFF).reshape(mh, mw)
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    lengths = [_read_codes(bits, sizes) for _ in range(groups)]
    n = w * h
    if groups == 1 and n >= MANY:
        return bits, lengths[0], w, n, cache_bits
    tables = [[table(x) for x in group] for group in lengths]
    out, cache = [0] * n, [0] * (1 << cache_bits)
    at, group = 0, tables[0]
    while at < n:
        if meta is not None:
            group = tables[meta[at // w >> shift, at % w >> shift]]
        s = bits.symbol(group[0])
        if s < 256:
            r, b, a = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            run = (a << 24 | r << 16 | s << 8 | b,)
        elif s < 280:
            length, far = _value(bits, s - 256), _value(bits, bits.symbol(group[4]))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * w)
            if far > at or at + length > n:
                raise ValueError("back-reference leaves the image")
            run = (out[at - far : at] * (length // far + 1))[:length]
        else:
            run = (cache[s - 280],)
        out[at : at + len(run)] = run
        at += len(run)
        if cache_bits:
            for v in run:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
    return np.array(out, np.uint32)


def _read_tokens(bits: Bits, lengths: list[bytes], w: int, n: int, cache_bits: int) -> np.ndarray:
    """All pixels of an image with one group of codes. Where a token that starts at a bit ends is found
    for every bit at once, SPAN bits at a time; the chain of real starts is then followed, and copies and
    cache are done."""
    # zeros at the end change no code, and equal codes are looked up once
    joints = [joint(x.rstrip(b"\0")) for x in lengths]
    (head, wide), far = joints[0], joints[4]
    base, bits.at = bits.at & ~7, bits.at & 7
    data = np.frombuffer(bits.data[base >> 3 :] + bytes(24), np.uint8)
    most = 8 * (len(data) - 24)
    p, total, found = bits.at, 0, []
    while total < n:
        lo = p & ~7
        limit = min(SPAN, most - lo)
        if limit <= 0 and (wide or p > most):
            raise ValueError("image ends early")
        part = data[lo >> 3 : (max(limit, 0) >> 3) + (lo >> 3) + 12]
        word = part[:-2].astype(np.int64)
        word |= part[1:-1].astype(np.int64) << 8
        word |= part[2:].astype(np.int64) << 16
        window = (word[:, None] >> _EIGHT).ravel()  # 17 bits from each bit on
        start = _numbers(len(window))
        looked = head.take(window & (1 << wide) - 1)
        size = looked & 15
        ends = after = start + size
        known, steps = {id(head): (looked, after)}, []
        for values, width in joints[1:4]:
            if width and id(values) not in known:  # channels often share a code
                x = values.take(window & (1 << width) - 1)
                known[id(values)] = x, start + (x & 15)
            steps.append(known[id(values)] if width else (values, None))
            if width:
                ends = steps[-1][1].take(ends, mode="clip")
        span = None
        if cache_bits or len(lengths[0].rstrip(b"\0")) > 256:
            if ends is after:
                ends = after.copy()
            span = np.ones(len(window), np.int64)
            other = np.flatnonzero(looked > 4095)
            kind, then = (looked[other] >> 4) - 256, after[other]
            ends[other] = then  # of the cache
            copy = np.flatnonzero(kind < 24)
            if len(copy):
                other, kind, then = other[copy], kind[copy], then[copy]
                more = _MORE[kind]
                span[other] = _LEAST[kind] + (window.take(then, mode="clip") & (1 << more) - 1)
                then += more
                x = far[0].take(window.take(then, mode="clip") & (1 << far[1]) - 1)
                ends[other] = then + (x & 15) + _MORE[x >> 4]
        starts, here, jump = [], p - lo, memoryview(ends)  # few of its items are looked at
        if wide:
            push = starts.append
            while here < limit:
                push(here)
                here = jump[here]
        else:  # tokens may have no bits at all
            spans = memoryview(span if span is not None else np.ones(len(window), np.int64))
            many = total
            while many < n and here < max(limit, 1):
                starts.append(here)
                many += spans[here]
                here = jump[here]
        at = np.array(starts, np.int64)
        if span is None:
            at = at[: n - total]
            long = np.ones(len(at), np.int64)
            total += len(at)
        else:
            long = span[at]
            sums = np.cumsum(long)
            last = int(np.searchsorted(sums, n - total))
            at, long, total = at[: last + 1], long[: last + 1], total + int(sums[min(last, len(sums) - 1)])
        if total > n:
            raise ValueError("back-reference leaves the image")
        p = lo + int(ends[at[-1]])
        kind = looked[at] >> 4
        plain = np.flatnonzero(kind < 256) if span is not None else None
        literal, value = (at, kind << 8) if plain is None else (at[plain], kind[plain] << 8)
        literal = after[literal]
        for (x, then), place in zip(steps, (16, 0, 24), strict=True):
            if then is None:
                value |= int(x[0]) >> 4 << place
            else:
                value |= x[literal] >> 4 << place
                literal = then[literal]
        found.append((at + lo, kind, value, long))
    bits.at = base + p
    if p > most:
        raise ValueError("image ends early")
    at, kind, value, long = found[0] if len(found) == 1 else map(np.concatenate, zip(*found, strict=True))
    if len(value) == len(at):
        return value.astype(np.uint32)
    return _play(at, kind, value, long, data, joints, w, n, cache_bits)


def _read_many(jobs: list[tuple]) -> list[np.ndarray]:
    """``_read_tokens`` of many images at once. Their bits are cut into pieces, and a token of every piece
    is read at a time. A piece may start within a token; two chains that meet in a bit are one from there
    on, so each is followed past its piece until it meets another, and the chain from an image's first
    bit on is joined from these."""
    out: list = [None] * len(jobs)
    chosen, offset, flat, parts, rows, room, at = [], {}, [], [], [], 0, 0
    for i, (bits, lengths, w, n, cache_bits) in enumerate(jobs):
        joints = [joint(x.rstrip(b"\0")) for x in lengths]
        lo, size = bits.at >> 3, len(bits.data) - (bits.at >> 3)
        if not joints[0][1] or sum(x[1] for x in joints[:4]) > 57 or max(size, n) > LARGE or size <= 0:
            out[i] = _read_tokens(*jobs[i])
            continue
        places = []
        for values, width in joints:
            if id(values) not in offset:
                offset[id(values)] = room
                flat.append(values)
                room += len(values)
            places += [offset[id(values)], (1 << width) - 1]
        alpha = int(joints[3][0][0]) >> 4 if not joints[3][1] else -1
        rows.append((8 * at + (bits.at & 7), 8 * (at + size), w, n, cache_bits, alpha, *places))
        chosen.append(i)
        parts += [bits.data[lo:], bytes(24)]
        at += size + 24
    if not chosen:
        return out
    data = np.frombuffer(b"".join(parts) + bytes(8 * STEPS + 64), np.uint8)
    words = np.ndarray((len(data) - 7,), "<i8", data, 0, (1,)).copy()
    flat = np.concatenate(flat).astype(np.uint16)
    jobs_at = np.array(rows, np.int64)
    begin, end, width, pixels, cache, alphas = jobs_at[:, :6].T
    cuts = np.maximum(-(-(end - begin) // PIECE), 1)
    owner = np.repeat(np.arange(len(chosen)), cuts)
    first = np.cumsum(cuts) - cuts
    step = -(-(end - begin) // cuts)
    start = begin[owner] + (np.arange(len(owner)) - first[owner]) * step[owner]
    stop = np.minimum(start + step[owner], end[owner])
    mark = np.zeros(8 * len(data), np.int32)  # of a bit that a token starts at: its number (block, piece, step), plus 1
    live, pos, blocks, made = np.arange(len(owner)), start, [], 1
    enter, leave, into = np.full(len(owner), -1), np.full(len(owner), -1), np.full(len(owner), -1)
    see_alpha = (alphas < 0).any()
    bases: list[int] = []
    while len(live):
        o0, m0, o1, m1, o2, m2, o3, m3, o4, m4 = jobs_at[owner[live], 6:].T.copy()
        where = np.empty((STEPS, len(live)), np.int64)
        seen = np.empty((4 if see_alpha else 3, STEPS, len(live)), np.uint16)
        spans = np.ones((STEPS, len(live)), np.int16)
        for k in range(STEPS):
            where[k] = pos
            w = words.take(pos >> 3)
            w >>= pos & 7
            x = flat.take((w & m0) + o0)
            seen[0, k] = x
            size = x & 15
            w >>= size
            y = flat.take((w & m1) + o1)
            seen[1, k] = y
            y &= 15
            w >>= y
            z = flat.take((w & m2) + o2)
            seen[2, k] = z
            z &= 15
            y += z
            if see_alpha:
                w >>= z
                z = flat.take((w & m3) + o3)
                seen[3, k] = z
                y += z & 15
            pos = pos + size
            other = np.flatnonzero(x > 4095)
            if len(other):
                y[other] = 0
                kind = x.take(other)
                copy = other[kind < 4480]
                if len(copy):
                    kind = (kind[kind < 4480] >> 4) - 256
                    then = pos.take(copy)
                    more = _MORE.take(kind)
                    spans[k, copy] = _LEAST.take(kind) + (words.take(then >> 3) >> (then & 7) & (1 << more) - 1)
                    then += more
                    z = flat.take((words.take(then >> 3) >> (then & 7) & m4.take(copy)) + o4.take(copy))
                    pos[copy] = then + (z & 15) + _MORE.take(z >> 4)
            pos += y
        # where each chain leaves its piece, and where it meets a token that is known
        ends = end[owner[live]]
        met = mark[where]
        met[where < stop[live]] = 0
        inside = where < ends
        last = inside.sum(0)  # positions grow, so these are the first ones
        meets = (met != 0).argmax(0)
        meeting = met[meets, np.arange(len(live))]
        hits = (meeting > 0) & (meets < last)
        last = np.where(hits, meets, last)
        inside &= np.arange(STEPS)[:, None] < last
        numbers = made + np.arange(where.size).reshape(where.shape)
        mark[where[inside]] = numbers[inside]
        done = hits | (last < STEPS)
        leave[live[done]] = STEPS * len(blocks) + last[done]
        into[live[hits]] = meeting[hits]
        blocks.append((live, where, seen, spans))
        bases.append(made)
        made += where.size
        keep = ~done
        live, pos = live[keep], pos[keep]
    # the chain of each image goes from piece to piece
    goes, targets = into.tolist(), np.array(bases)
    block = np.searchsorted(targets, into, "right") - 1
    met_piece, met_step = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for b, (alive, *_) in enumerate(blocks):
        these = np.flatnonzero((block == b) & (into > 0))
        inner = into[these] - bases[b]
        met_piece[these] = alive[inner % len(alive)]
        met_step[these] = STEPS * b + inner // len(alive)
    met_piece, met_step = met_piece.tolist(), met_step.tolist()
    for k in first.tolist():
        enter[k] = 0
        while goes[k] > 0:
            k, at = met_piece[k], met_step[k]
            enter[k] = at
    found = []
    for b, (alive, where, seen, spans) in enumerate(blocks):
        here = np.arange(STEPS * b, STEPS * b + STEPS)[:, None]
        true = (here >= enter[alive]) & (here < leave[alive]) & (enter[alive] >= 0)
        found.append((where[true], spans[true], *(x[true] for x in seen)))
    at, span, *looked = (np.concatenate(x) for x in zip(*found, strict=True))
    mark[at] = np.arange(len(at))
    flags = np.zeros(len(mark), bool)
    flags[at] = True
    at = np.flatnonzero(flags)
    order = mark[at]
    span, looked = span[order].astype(np.int64), [x[order] for x in looked]
    # tokens of each image up to its last pixel
    bound = np.searchsorted(at, np.append(begin, 8 * len(data)))
    job = np.repeat(np.arange(len(chosen)), np.diff(bound))
    sums = np.append(0, np.cumsum(span))
    local = sums[:-1] - sums[bound[:-1]][job]
    used = np.flatnonzero(local < pixels[job])
    at, span, job, local, looked = at[used], span[used], job[used], local[used], [x[used] for x in looked]
    many = np.bincount(job, minlength=len(chosen))
    final = np.cumsum(many) - 1
    wrong = (many == 0) | (local[final] + span[final] != pixels)
    kind = looked[0] >> 4
    plain = np.flatnonzero(kind < 256)
    g, r, b = (x[plain].astype(np.uint32) >> 4 for x in looked[:3])
    a = looked[3][plain] >> 4 if see_alpha else alphas[job[plain]]
    # nor may the last token pass the end of the file
    q = at[final] + (looked[0][final] & 15)
    after = kind[final]
    copy = (after > 255) & (after < 280)
    q[copy] += _MORE[after[copy] - 256]
    far = flat[(words[q >> 3] >> (q & 7) & jobs_at[job[final], 15]) + jobs_at[job[final], 14]].astype(np.int64)
    wrong |= q + np.where(copy, (far & 15) + _MORE[np.where(copy, far >> 4, 0)], np.where(after < 256, sum((x[final] & 15).astype(np.int64) for x in looked[1:]), 0)) > end
    base = np.cumsum(pixels) - pixels
    full = np.zeros(int(pixels.sum()), np.uint32)
    if wrong.any():  # read alone, which says what is wrong
        for i in np.flatnonzero(wrong).tolist():
            out[chosen[i]] = _read_tokens(*jobs[chosen[i]])
        right = np.flatnonzero(~wrong)
        for i, px in zip(right.tolist(), _read_many([jobs[chosen[i]] for i in right.tolist()]), strict=True):
            out[chosen[i]] = px
        return out
    place = base[job] + local
    full[place[plain]] = g << 8 | r << 16 | b | a.astype(np.uint32) << 24
    if len(plain) < len(kind):
        copy = np.flatnonzero((kind > 255) & (kind < 280))
        long, whose = span[copy], job[copy]
        q = at[copy] + (looked[0][copy] & 15) + _MORE[kind[copy] - 256]
        far = flat[(words[q >> 3] >> (q & 7) & jobs_at[whose, 15]) + jobs_at[whose, 14]]
        more = _MORE[far >> 4]
        q += far & 15
        code = _LEAST[far >> 4] + (words[q >> 3] >> (q & 7) & (1 << more) - 1)
        near = _NEAR[np.minimum(code, 120) - 1]
        back = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[whose]))
        slow = np.zeros(len(chosen), bool)
        slow[whose[back > local[copy]]] = True
        back = np.minimum(back, local[copy])
        point = np.arange(len(full))
        covered = np.repeat(place[copy] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        point[covered] -= np.repeat(back, long)
        hit = np.flatnonzero(kind > 279)
        if len(hit):
            # a place of the cache belongs to one image, and only images with hits are looked at
            using = np.zeros(len(chosen), bool)
            using[job[hit]] = True
            those = np.flatnonzero(np.repeat(using, pixels))
            whose = np.repeat(np.flatnonzero(using), pixels[using])
            slot = (full * np.uint32(0x1E35A7BD)) >> np.repeat(32 - np.maximum(cache, 1), pixels).astype(np.uint32)
            slot[place[hit]] = kind[hit] - 280
            point = _roots(point)
            before = np.full(len(full), -1)
            before[those] = _before(whose << 11 | slot[point[those]], 11 + len(chosen).bit_length())
            before = before[place[hit]]
            point[place[hit]] = np.maximum(those[before], 0)
            slow[job[hit[before < 0]]] = True
        full = full[_roots(point)]
        for i in np.flatnonzero(slow).tolist():
            full[base[i] : base[i] + pixels[i]] = _read_tokens(*jobs[chosen[i]])
    for i, px in zip(chosen, np.split(full, base[1:]), strict=True):
        out[i] = px
    return out


def _play(at: np.ndarray, kind: np.ndarray, value: np.ndarray, span: np.ndarray, data: np.ndarray, joints: list, w: int, n: int, cache_bits: int) -> np.ndarray:
    """Pixels of tokens: literals as they are, copies and pixels of the cache from what stands before."""
    begin = np.cumsum(span) - span
    out = np.zeros(n, np.uint32)
    out[begin[kind < 256]] = value
    copy = np.flatnonzero((kind > 255) & (kind < 280))
    if len(copy):
        (head, wide), (far, width) = joints[0], joints[4]
        q = at[copy] + (head[_peek(data, at[copy], wide)] & 15) + _MORE[kind[copy] - 256]
        far = far[_peek(data, q, width)]
        more = _MORE[far >> 4]
        code = _LEAST[far >> 4] + (_peek(data, q + (far & 15), 25) & ((1 << more) - 1))
        near = _NEAR[np.minimum(code, 120) - 1]
        back = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * w))
        if (back > begin[copy]).any():
            raise ValueError("back-reference leaves the image")
    else:
        back = copy
    # every pixel points to the one that it repeats, and in the end to a literal
    point, long = np.arange(n), span[copy]
    place = np.repeat(begin[copy] - (np.cumsum(long) - long), long) + np.arange(long.sum())
    point[place] -= np.repeat(back, long)
    hit = np.flatnonzero(kind > 279)
    if len(hit):
        slot = _slots(out, cache_bits)
        slot[begin[hit]] = kind[hit] - 280
        before = _before(slot[_roots(point)])[begin[hit]]
        point[begin[hit]] = np.maximum(before, 0)
        if (before < 0).any():  # of an empty place of the cache: a pixel of zeros, which has a place of its own
            return _play_slowly(begin, kind, out, long, back, cache_bits)
    return out[_roots(point)]


def _roots(point: np.ndarray) -> np.ndarray:
    """For every place the one that its pointers lead to in the end."""
    left = point
    while 4 * len(left) > len(point):  # while many still change, all are looked up
        further = point.take(point)
        left = np.flatnonzero(further != point)
        point = further
    while len(left):
        one = point[left]
        two = point[one]
        point[left] = two
        left = left[one != two]
    return point


def _play_slowly(begin: np.ndarray, kind: np.ndarray, out: np.ndarray, long: np.ndarray, back: np.ndarray, cache_bits: int) -> np.ndarray:
    px, copies, cache = out.tolist(), zip(long.tolist(), back.tolist(), strict=True), [0] * (1 << cache_bits)
    for a, k in zip(begin.tolist(), kind.tolist(), strict=True):
        many, far = next(copies) if 255 < k < 280 else (1, 0)
        if k > 279:
            px[a] = cache[k - 280]
        for i in range(a, a + many):
            px[i] = px[i - far]
            cache[(0x1E35A7BD * px[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[i]
    return np.array(px, np.uint32)


def _peek(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` bits, up to 25, from each of some bits on."""
    lo = np.minimum(at >> 3, len(data) - 4)
    word = sum(data[lo + k].astype(np.int64) << 8 * k for k in range(4))
    return word >> (at & 7) & ((1 << width) - 1)


def decode(data: bytes) -> np.ndarray:
    """The image's pixels, an array of height x width ARGB values."""
    found, *rest = _open(data)
    return _close(_read_tokens(*found) if isinstance(found, tuple) else found, *rest)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each image; those of up to LARGE bytes and pixels are read side by side."""
    if len(files) == 1:
        return [decode(files[0])]
    opened = [_open(data) for data in files]
    many = [i for i, x in enumerate(opened) if isinstance(x[0], tuple)]
    read = dict(zip(many, _read_many([opened[i][0] for i in many]), strict=True))
    return [_close(read.get(i, found), *rest) for i, (found, *rest) in enumerate(opened)]


def _open(data: bytes) -> tuple:
    """Pixels before the transforms are inverted (or how to read them), their shape, and the transforms."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    inverse, wide, seen = [], w, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind < 2:
            shift = bits.read(3) + 2
            bw, bh = -(-wide >> shift), -(-h >> shift)
            inverse.append((kind, wide, (shift, _read_pixels(bits, bw, bh, False).reshape(bh, bw))))
        elif kind == 2:
            inverse.append((kind, wide, None))
        else:
            n = bits.read(8) + 1
            colours = _bytes(_read_pixels(bits, n, 1, False)).astype(np.int64).cumsum(0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            inverse.append((kind, wide, (pack, _argb(colours.astype(np.uint8)))))
            wide = -(-wide >> pack)
    return _begin_pixels(bits, wide, h, True), (h, wide), inverse


def _close(px: np.ndarray, shape: tuple[int, int], inverse: list) -> np.ndarray:
    out = px.reshape(shape)
    for kind, width, given in reversed(inverse):
        out = (_unpredict, _uncross, _ungreen, _unpalette)[kind](out, width, given)
    return out


def _bytes(argb: np.ndarray) -> np.ndarray:
    """Channels B, G, R, A in a last axis."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(channels.shape[:-1])


def _spread(blocks: np.ndarray, shift: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << shift, 0), 1 << shift, 1)[:h, :w]


def _ungreen(px: np.ndarray, width: int, _: None) -> np.ndarray:
    c = _bytes(px).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return _argb(c)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((t.view(np.int8).astype(np.int32) * c.view(np.int8).astype(np.int32)) >> 5).astype(np.uint8)


def _uncross(px: np.ndarray, width: int, given: tuple) -> np.ndarray:
    shift, blocks = given
    c = _bytes(px).copy()
    b, g, r = (c[..., i].copy() for i in range(3))
    t = _bytes(_spread(blocks, shift, *px.shape))
    g2r, g2b, r2b = (np.ascontiguousarray(t[..., i]) for i in range(3))
    r = r + _delta(g2r, g)
    c[..., 0] = b + _delta(g2b, g) + _delta(r2b, r)
    c[..., 2] = r
    return _argb(c)


def _unpalette(px: np.ndarray, width: int, given: tuple) -> np.ndarray:
    pack, colours = given
    index = (px >> 8 & 255).astype(np.int64)
    if pack:
        size = 8 >> pack
        index = (index[..., None] >> (np.arange(1 << pack) * size) & ((1 << size) - 1)).reshape(len(px), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:
    """Predicted channels; the arguments are integer channels of the neighbours."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 11:
        p = left + top - tl
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    if mode == 13:
        a = avg(left, top)
        return np.clip(a + np.fix((a - tl) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: tr, 4: lambda: tl,
        5: lambda: avg(avg(left, tr), top), 6: lambda: avg(left, tl), 7: lambda: avg(left, top), 8: lambda: avg(tl, top),
        9: lambda: avg(top, tr), 10: lambda: avg(avg(left, tl), avg(top, tr)),
    }.get(mode, lambda: np.array([0, 0, 0, 255]))()


#: Predictors that do not look left, so a row is inverted at once.
_NO_LEFT = {0, 2, 3, 4, 8, 9, 14, 15}


def _unpredict(px: np.ndarray, width: int, given: tuple) -> np.ndarray:
    shift, blocks = given
    h, w = px.shape
    c = _bytes(px).astype(np.int64)
    c[0, 0] += (0, 0, 0, 255)
    c[0] = np.cumsum(c[0], 0) & 255
    for y in range(1, h):
        modes = np.repeat(blocks[y >> shift] >> 8 & 15, 1 << shift)[:w]
        above, row = c[y - 1], c[y]
        row[0] = (row[0] + above[0]) & 255
        if w == 1:
            continue
        right = np.concatenate([above[1:], row[:1]])
        if set(modes[1:].tolist()) <= _NO_LEFT:
            known = {0: np.array([0, 0, 0, 255]), 2: above[1:], 3: right[1:], 4: above[:-1], 8: (above[:-1] + above[1:]) >> 1, 9: (above[1:] + right[1:]) >> 1}
            for m in set(modes[1:].tolist()):
                at = modes[1:] == m
                row[1:][at] += known.get(m, known[0])[at] if known.get(m, known[0]).ndim == 2 else known.get(m, known[0])
            row[1:] &= 255
        elif set(modes[1:].tolist()) == {1}:
            c[y] = np.cumsum(row, 0) & 255
        else:
            for x in range(1, w):
                row[x] = (row[x] + _predict(int(modes[x]), row[x - 1], above[x], right[x], above[x - 1])) & 255
    return _argb(c.astype(np.uint8))


# ---- writing ------------------------------------------------------------------------------


class Out:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= int(v) << self.n
        self.n += int(n)

    def array(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes(-(-self.n // 8) or 1, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def _write_code(out: Out, lengths: bytes) -> None:
    used = len(lengths) - lengths.count(0)
    if used <= 2:
        first = [i for i, x in enumerate(lengths) if x] or [0]
        if first[-1] < 256:
            out.put(1 | len(first) - 1 << 1 | 4, 3)
            for s in first:
                out.put(s, 8)
            return
    steps = _runs(lengths)
    count = [0] * 19
    for k, _, _ in steps:
        count[k] += 1
    own = huffman(count, 7)
    if sum(map(bool, own)) == 1:  # a code of one symbol has no bits, which only simple codes may say
        own = bytes(x or (1 if i == (0 if not own[0] else 1) else 0) for i, x in enumerate(own))
    value, at = 15 << 1, 5
    for k in LENGTH_ORDER:
        value |= own[k] << at
        at += 3
    at += 1
    code, size = _short_codes(own)[0], own
    for k, extra, n in steps:
        value |= (code[k] | extra << size[k]) << at
        at += size[k] + n
    out.put(value, at)


_SAME = re.compile(b"|".join(re.escape(bytes([k])) + b"+" for k in range(16)))


def _runs(lengths: bytes) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra value, extra bits): zeros in runs of up to 138, others repeated up to 6 times."""
    steps, last = [], 8
    for run in _SAME.findall(lengths):
        x = run[0]
        steps += _run_steps(run, x != last)
        last = x or last
    return steps


@lru_cache(4096)
def _run_steps(run: bytes, new: bool) -> tuple[tuple[int, int, int], ...]:
    steps, x, n = [], run[0], len(run)
    if x and (n == 1 or new):
        steps.append((x, 0, 0))
        n -= 1
    while n >= 3:
        most = min(n, 138 if not x else 6)
        steps.append((18, most - 11, 7) if most > 10 else (17, most - 3, 3) if not x else (16, most - 3, 2))
        n -= most
    return (*steps, *[(x, 0, 0)] * n)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, top - 1, v - ((2 + second) << (top - 1))


def _write_pixels(out: Out, px: np.ndarray, top: bool, cache_bits: int = 0, matches: bool = False) -> None:
    h, w = px.shape
    flat = px.ravel().tolist()
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    cache, seen, tokens, at = {}, {}, [], 0
    while at < len(flat):
        length = far = 0
        if matches and (k := tuple(flat[at : at + 3])) in seen:
            far = at - seen[k]
            while at + length < len(flat) and length < 4096 and flat[at + length] == flat[at + length - far]:
                length += 1
        slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
        if length >= 3:
            tokens.append(("copy", length, far))
        elif cache_bits and cache.get(slot(flat[at])) == flat[at]:
            tokens.append(("cache", slot(flat[at]), 0))
            length = 1
        else:
            tokens.append(("pixel", flat[at], 0))
            length = 1
        for i in range(at, at + length):
            seen[tuple(flat[i : i + 3])] = i
            if cache_bits:
                cache[slot(flat[i])] = flat[i]
        at += length
    counts = [[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    steps: list[list[tuple[int, int]]] = []
    for kind, a, b in tokens:
        if kind == "pixel":
            steps.append([(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)])
        elif kind == "cache":
            steps.append([(0, 280 + a)])
        else:
            p, n, v = _prefix(a)
            q, m, u = _prefix(b + 120)
            steps.append([(0, 256 + p), (-n, v), (4, q), (-m, u)])
        for k, s in steps[-1]:
            if k > 0 or k == 0 and (s or kind != "copy"):
                counts[k][s] += 1
    lengths = [huffman(x if any(x) else [1]) + bytes(len(x) - (len(x) if any(x) else 1)) for x in counts]
    for x in lengths:
        _write_code(out, x)
    for kind_steps in steps:
        for i, (k, s) in enumerate(kind_steps):
            extra = len(kind_steps) == 4 and kind_steps[0][1] >= 256 and i in (1, 3)
            if extra:
                out.put(s, -k)
            else:
                code, size = codes(lengths[k])
                out.put(code[s], size[s])


def encode_pixels(px: np.ndarray, transforms: tuple[str, ...] = (), mode: int = 11, cache_bits: int = 0, matches: bool = False) -> bytes:
    """One image of height x width ARGB values. ``transforms``: predict, cross, green, palette."""
    h, w = px.shape
    px, out = px.astype(np.uint32), Out()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    for name in transforms:
        out.put(1, 1)
        out.put({"predict": 0, "cross": 1, "green": 2, "palette": 3}[name], 2)
        h, w = px.shape
        c = _bytes(px)
        if name == "predict":
            out.put(1, 3)
            _write_pixels(out, np.full((-(-h >> 3), -(-w >> 3)), mode << 8 | OPAQUE, np.uint32), False)
            full, left = c.astype(np.int64), c.astype(np.int64)
            for y in range(h):
                for x in range(w):
                    if not y:
                        p = full[0, x - 1] if x else np.array([0, 0, 0, 255])
                    elif not x:
                        p = full[y - 1, 0]
                    else:
                        p = _predict(mode, full[y, x - 1], full[y - 1, x], full[y - 1, x + 1] if x + 1 < w else full[y, 0], full[y - 1, x - 1])
                    left[y, x] = (full[y, x] - p) & 255
            px = _argb(left.astype(np.uint8))
        elif name == "cross":
            out.put(1, 3)
            t = np.array([7, 250, 11], np.uint8)
            value = OPAQUE | int(t[2]) << 16 | int(t[1]) << 8 | int(t[0])
            _write_pixels(out, np.full((-(-h >> 3), -(-w >> 3)), value, np.uint32), False)
            c = c.copy()
            b, g, r = (c[..., i].copy() for i in range(3))
            whole = lambda i: np.full(g.shape, t[i], np.uint8)
            c[..., 2] = r - _delta(whole(0), g)
            c[..., 0] = b - _delta(whole(1), g) - _delta(whole(2), r)
            px = _argb(c)
        elif name == "green":
            c = c.copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            px = _argb(c)
        else:
            colours, index = np.unique(px, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(colours) - 1, 8)
            _write_pixels(out, _argb(np.diff(_bytes(colours).astype(np.int64), axis=0, prepend=0).astype(np.uint8))[None, :], False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = index.reshape(h, w)
            index = np.pad(index, ((0, 0), (0, -w % (1 << pack)))).reshape(h, -1, 1 << pack)
            green = (index << (np.arange(1 << pack) * (8 >> pack))).sum(-1)
            px = (OPAQUE | green << 8).astype(np.uint32)
    out.put(0, 1)
    _write_pixels(out, px, True, cache_bits, matches)
    return _riff(np.packbits(out.array(), bitorder="little").tobytes())


def _riff(image: bytes) -> bytes:
    pad = len(image) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(image) + pad) + b"WEBPVP8L" + struct.pack("<I", len(image)) + image + bytes(pad)


def _huffmans(counts: np.ndarray, most: int) -> np.ndarray:
    """``huffman`` of each row."""
    rows, width = counts.shape
    out = np.zeros(counts.size, np.uint8)
    used = np.flatnonzero(counts)
    row = used // width
    n = np.bincount(row, minlength=rows)
    slow = np.flatnonzero(n) if rows < 32 else np.zeros(0, np.int64)
    if rows >= 32:
        # rows with most symbols stand first, so those still at work are always the first ones
        order = np.argsort(-n, kind="stable")
        rank = np.empty(rows, np.int64)
        rank[order] = np.arange(rows)
        n = n[order]
        weight = counts.ravel()[used]
        wide, bits = int(weight.max()).bit_length(), width.bit_length()
        key = np.sort((rank[row] << wide | weight) << bits | used - row * width)
        symbol, row = key & (1 << bits) - 1, key >> (bits + wide)
        weight = key >> bits & (1 << wide) - 1
        deepest = int(n[0])
        # the two least of two queues are joined, as there: each row has its symbols, then its sums
        line = 2 * deepest + 2
        leaf = row * line + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        queue, above = np.full(rows * line, 1 << 62), np.zeros(rows * line, np.int64)
        queue[leaf] = weight
        i = np.arange(rows) * line
        j = i + deepest + 1
        sums = j.copy()
        working = np.searchsorted(-n, -np.arange(1, deepest + 1), "left").tolist()  # rows of more symbols
        for made in range(deepest - 1):
            at, over = i[: working[made]], j[: working[made]]
            total = 0
            for _ in range(2):
                a, b = queue.take(at), queue.take(over)
                first = a <= b
                above[np.where(first, at, over)] = made
                total = np.minimum(a, b) + total
                at += first
                over += ~first
            queue[sums[: len(at)] + made] = total
        deep = np.ones(rows * line, np.int64)
        for k in range(deepest - 3, -1, -1):  # from the root down
            at = sums[: working[k + 1]]
            deep[at + k] = deep.take(at + above.take(at + k)) + 1
        size = deep.take(sums[row] + above[leaf])
        out[order[row] * width + symbol] = size
        slow = order[np.unique(row[size > most])]
    out = out.reshape(rows, width)
    for k in slow.tolist():
        out[k] = np.frombuffer(huffman(counts[k].tolist(), most), np.uint8)
    return out


def _codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` of each row."""
    rows, width = lengths.shape
    code, size = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
    used = np.flatnonzero(lengths)
    row = used // width
    used = used[(np.bincount(row, minlength=rows) > 1)[row]]
    if len(used):
        bits = width.bit_length()
        row = used // width
        key = np.sort((row << 4 | lengths.ravel()[used]) << bits | used - row * width)
        row, wide = key >> (bits + 4), key >> bits & 15
        first = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
        many = np.diff(np.append(first, len(row)))
        most = np.repeat(wide[first + many - 1], many)
        room = 1 << (most - wide)  # in codes of the longest length
        before = np.cumsum(room) - room
        before -= np.repeat(before[first], many)
        used = row * width + (key & (1 << bits) - 1)
        code[used], size[used] = _reversed(15)[before] >> (15 - most), wide
    return code.reshape(rows, width), size.reshape(rows, width)


def _code_tokens(lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_write_code`` writes for the first ``alphabet`` lengths of each row: numbers, their bits, and each one's row."""
    rows, width = lengths.shape
    used = np.flatnonzero(lengths)
    row, symbol = used // width, used % width
    n = np.bincount(row, minlength=rows)
    end = np.cumsum(n)
    last = np.where(n > 0, np.append(symbol, 0)[end - 1], 0)
    start = np.where(n > 0, np.append(symbol, 0)[end - n], 0)
    simple = (n <= 2) & (last < 256)
    value = np.where(n == 2, 7 | start << 3 | last << 11, 5 | last << 3)
    size = np.where(n == 2, 19, 11)
    long = np.flatnonzero(~simple)
    if not len(long):
        return value, size, np.arange(rows)
    # runs of equal lengths
    cells = np.arange(width) < alphabet[long][:, None]
    x, row = lengths[long][cells].astype(np.int64), np.repeat(np.arange(len(long)), alphabet[long])
    start = np.append(0, np.flatnonzero((x[1:] != x[:-1]) | (row[1:] != row[:-1])) + 1)
    n = np.diff(np.append(start, len(x)))
    x, row = x[start], row[start]
    back = lambda k: np.append(np.full(k, -1), np.where(row[k:] == row[:-k], x[:-k], -1))[: len(x)]
    before = np.where(back(1) == 0, back(2), back(1))
    new = (x != np.where(before < 0, 8, before)) | (n == 1)
    # of each run: a length as it is, whole repeats, a part of one, and further lengths as they are
    lead = (x > 0) & new
    most = np.where(x > 0, 6, 138)
    whole, rest = np.divmod(n - lead, most)
    many = np.stack([lead, whole, rest >= 3, np.where(rest < 3, rest, 0)], 1).ravel()
    far = rest > 10
    kind = np.stack([x, np.where(x > 0, 16, 18), np.where(x > 0, 16, np.where(far, 18, 17)), x], 1)
    none = np.zeros(len(x), np.int64)
    extra = np.stack([none, np.where(x > 0, 3, 127), rest - np.where(far, 11, 3), none], 1)
    more = np.stack([none, np.where(x > 0, 2, 7), np.where(x > 0, 2, np.where(far, 7, 3)), none], 1)
    kind, extra, more = (np.repeat(t.ravel(), many) for t in (kind, extra, more))
    row = np.repeat(row, many.reshape(-1, 4).sum(1))
    own = _huffmans(np.bincount(row * 19 + kind, minlength=19 * len(long)).reshape(-1, 19), 7)
    single = np.flatnonzero((own > 0).sum(1) == 1)  # a code of one symbol has no bits, which only simple codes may say
    own[single, np.where(own[single, 0] > 0, 1, 0)] = 1
    code, wide = _codes_of(own)
    value[long] = 15 << 1 | (own[:, LENGTH_ORDER].astype(np.int64) << 5 + 3 * np.arange(19)).sum(1)
    size[long] = 63
    step = row * 19 + kind
    code, wide = code.ravel()[step], wide.ravel()[step]
    return _merged([(np.arange(rows), value, size), (long[row], code | extra << wide, wide + more)], rows)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and bits of all parts by their rows, those of an earlier part first; rows of a part grow."""
    counts = np.stack([np.bincount(row, minlength=rows) for row, _, _ in parts], 1)
    at = (np.cumsum(counts) - counts.ravel()).reshape(counts.shape)
    n = int(counts.sum())
    values, sizes = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, (row, value, size) in enumerate(parts):
        place = (at[:, k] - (np.cumsum(counts[:, k]) - counts[:, k])).take(row)
        place += np.arange(len(row))
        values[place] = value
        sizes[place] = size
    return values, sizes, np.repeat(np.arange(rows), counts.sum(1))


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Bits that an ideal code takes for all of the samples that each row counts; rows have equal sums."""
    x = counts.astype(float)
    total = x[0].sum()
    return total * np.log2(total) - (x * np.log2(np.maximum(x, 1))).sum(1)


def _slots(px: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((px * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)).astype(np.uint16)


def _before(keys: np.ndarray, width: int = 64) -> np.ndarray:
    """Of each place, the last one before it that has the same key (of ``width`` bits), or -1."""
    n = len(keys)
    room = n.bit_length()
    if width + room < 64:  # keys and places are sorted as one number
        order = np.sort(keys << room | np.arange(n))
        keys = order >> room
        order &= (1 << room) - 1
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    out = np.full(n, -1, np.int64)
    out[order[same + 1]] = order[same]
    return out


def _copies(px: np.ndarray, bound: np.ndarray, local: np.ndarray, each: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Rows of (place, length, distance): back-references that take less than their pixels do at ``each``
    bits, in those images (which begin at ``bound``) that are open."""
    n = len(px)
    pairs = np.append((px[:-1] & 0xFFFFFF).astype(np.int64) << 24 | px[1:] & 0xFFFFFF, 0)
    far = np.zeros(n, np.int64)
    spans = [(lo, hi - 1) for lo, hi, use in zip(bound[:-1].tolist(), bound[1:].tolist(), open_.tolist(), strict=True) if use]
    short = [(lo, hi) for lo, hi in spans if hi - lo < 1 << 15]
    if short:  # pairs and places are sorted as one number, image by image
        where = np.concatenate([np.arange(lo, hi) for lo, hi in short])
        keys = pairs[where] << 15 | local[where]
        at = 0
        for lo, hi in short:
            keys[at : at + hi - lo].sort()
            at += hi - lo
        first = where - local[where]
        order = (keys & (1 << 15) - 1) + first
        keys >>= 15
        same = np.flatnonzero((keys[1:] == keys[:-1]) & (first[1:] == first[:-1]))
        far[order[same + 1]] = order[same + 1] - order[same]
    for lo, hi in spans:
        if hi - lo >= 1 << 15:
            before = _before(pairs[lo:hi], 48)
            far[lo:hi] = np.where(before < 0, 0, np.arange(hi - lo) - before)
    far[far > (1 << 20) - 200] = 0
    far[bound[1:] - 1] = -1  # no pair starts at an image's last pixel
    # runs of pairs at one distance; the later a copy starts in its run, the less it saves
    first = np.append(0, np.flatnonzero(far[1:] != far[:-1]) + 1)
    last = np.append(first[1:], n) - 1
    good = np.flatnonzero(far[first] > 0)
    first, last = first[good], last[good]
    far = far[first]
    saved, least = np.repeat(each, np.diff(bound))[first], 10 + np.log2(far + 120)
    worth = np.minimum(last - first + 2, 4096) * saved > least
    out, at = [], 0
    for p, end, d, bits, cost in zip(*(x[worth].tolist() for x in (first, last, far, saved, least)), strict=True):
        if p < at:
            p = at
        while p <= end:
            m = end - p + 2
            if m > 4096:
                m = 4096
            if m * bits <= cost:
                break
            out.append((p, m, d))
            p = at = p + m
    return np.array(out, np.int64).reshape(-1, 3)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, their further bits, and how many these are."""
    symbol = np.searchsorted(_LEAST, values, "right") - 1
    return symbol, values - _LEAST[symbol], _MORE[symbol]


def _payload_images(files: list[bytes]) -> list[bytes]:
    """Images of 64 pixels a row: subtract-green, back-references and colour cache are used where the
    counts of an image's samples say that they save bits. Images of SMALL pixels at most have literals
    under one code for all channels."""
    sizes = np.array([len(x) // 3 for x in files])
    bound = np.append(0, np.cumsum(sizes))
    many, n = len(files), int(bound[-1])
    job = np.repeat(np.arange(many), sizes)
    local = np.arange(n) - bound[:-1][job]
    small = sizes <= SMALL
    r, g, b = np.frombuffer(b"".join(files), np.uint8).reshape(n, 3).T.copy()
    of = job << 8
    less = r - g, b - g
    counts = np.stack([np.bincount(of | x, minlength=256 * many).reshape(many, 256) for x in (r, g, b, *less)], 1)
    bits = np.stack([_entropies(x) for x in counts])
    bits, fewer_bits = bits[:, :3].sum(1), bits[:, 3] + bits[:, 1] + bits[:, 4]
    green = (fewer_bits + 200 < bits) & ~small
    if green.any():
        r, b = np.where(green[job], (less[0], less[1]), (r, b))
    px = np.uint32(OPAQUE) | r.astype(np.uint32) << 16 | g.astype(np.uint32) << 8 | b
    each = np.minimum(bits, fewer_bits) / sizes
    at, long, far = _copies(px, bound, local, each, ~small & (each > 0)).T
    cover = np.zeros(n + 1, np.int8)
    cover[at] = 1
    cover[at + long] -= 1
    literal = np.cumsum(cover[:n], dtype=np.int8) == 0
    cache_bits = np.array([min(10, max(1, x.bit_length() - 5)) for x in sizes.tolist()])
    using = ~small & (each > cache_bits + 1)
    hit = np.zeros(0, np.int64)
    if using.any():
        those = np.flatnonzero(using[job])
        slot = (px[those] * np.uint32(0x1E35A7BD)) >> (32 - cache_bits[job[those]]).astype(np.uint32)
        before = _before(job[those] << 10 | slot, 10 + many.bit_length())
        found = np.flatnonzero(literal[those] & (before >= 0) & (px[those[before]] == px[those]))
        hit, slot = those[found], slot[found].astype(np.int64)
        using &= np.bincount(job[hit], minlength=many) * (each - cache_bits) >= 300
        hit, slot = hit[using[job[hit]]], slot[using[job[hit]]]
    cache_bits[~using] = 0
    # what is written, token by token: up to five codes, or bits as they are; a token's are one number
    literal[hit] = False
    whole = np.flatnonzero(literal)
    r, g, b, of = r[whole], g[whole], b[whole], job[whole]
    wide = 280 + 1024
    hits = job[hit] * wide + 280 + (slot if len(hit) else hit)
    k, extra, more = _prefixes(long)
    d, extra_d, more_d = _prefixes(far + 120)
    k += job[at] * wide + 256
    d += job[at] * 40
    g = of * wide + g
    r, b = of << 8 | r, of << 8 | b
    counts = np.zeros((3, many, wide), np.int64)
    counts[0] = np.bincount(np.concatenate([g, hits, k]), minlength=wide * many).reshape(many, wide)
    counts[1, :, :256] = (np.bincount(r, minlength=256 * many) + np.bincount(b, minlength=256 * many)).reshape(many, 256)
    counts[2, :, :40] = np.bincount(d, minlength=40 * many).reshape(many, 40)
    counts[:2, small] = counts[:2, small].sum(0)
    counts[1:, :, 0] |= ~counts[1:].any(2)  # a code that nothing uses
    counts = counts.reshape(3 * many, wide)
    lengths = _huffmans(counts, 12)
    alphabet = np.repeat((280, 256, 40), many)
    alphabet[:many] += np.where(cache_bits, 1 << cache_bits, 0)
    heads = _payload_heads(sizes, green, cache_bits, *_code_tokens(lengths, alphabet))
    code, wide_of = (x.reshape(3, many, wide) for x in _codes_of(lengths))
    code = [(x.ravel(), y.ravel()) for x, y in ((code[0], wide_of[0]), (code[1, :, :256], wide_of[1, :, :256]), (code[2, :, :40], wide_of[2, :, :40]))]
    value, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    (code, wide), (shade, breadth), (code_d, wide_d) = code
    value[whole], size[whole] = _pixel_bits(*(x.take(y) for y, z in ((g, (code, wide)), (r, (shade, breadth)), (b, (shade, breadth))) for x in z))
    value[hit], size[hit] = code[hits], wide[hits]
    if len(at):
        v, m = code[k], wide[k]
        for x, width in ((extra, more), (code_d[d], wide_d[d]), (extra_d, more_d)):
            v |= x << m
            m += width
        value[at], size[at] = v, m
    written = np.flatnonzero(size)
    return [_riff(x) for x in _joined(*_merged([heads, (job[written], value[written], size[written])], many))]


def _pixel_bits(g: np.ndarray, g_size: np.ndarray, r: np.ndarray, r_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three codes of each pixel as one number, and how many bits it has."""
    two = g_size + r_size
    return g | r << g_size | b << two, two + b_size


def _payload_heads(sizes: np.ndarray, green: np.ndarray, cache_bits: np.ndarray, value: np.ndarray, size: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that stands before the pixels, as each number's image, the numbers, and their bits. Given are the
    numbers of the codes for green, for red and blue, and for distances, of all images one after another."""
    many = len(sizes)
    before = 0x2F | 63 << 8 | (sizes // 64 - 1) << 22
    at = np.full(many, 40)
    before |= np.where(green, 5 << at, 0)  # subtract-green
    at += np.where(green, 4, 1)
    before |= np.where(cache_bits, (1 | cache_bits << 1) << at, 0)
    at += np.where(cache_bits, 6, 2)
    images = np.arange(many)
    solid = 5 | 255 << 3  # the code of alpha
    parts = [(images, before, at)]
    for k in (0, 1, 1, 2):
        these = slice(*np.searchsorted(row, (k * many, k * many + many)))
        parts.append((row[these] - k * many, value[these], size[these]))
    parts.insert(4, (images, np.full(many, solid), np.full(many, 11)))
    value, size, row = _merged(parts, many)
    return row, value, size


def _joined(value: np.ndarray, size: np.ndarray, row: np.ndarray) -> list[bytes]:
    """The bits of each row's values, of ``size`` bits (under 64) each, one after another."""
    end = np.cumsum(size)
    bound = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    own = np.diff(end[bound], prepend=0)
    words = np.cumsum((own >> 6) + 2)
    first = words - (own >> 6) - 2
    end += (64 * first - (end[bound] - own))[row]
    start = end - size
    word, within = start >> 6, start & 63
    cut = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
    out = np.zeros(int(words[-1]), "<i8")
    out[word[cut]] = np.bitwise_or.reduceat(value << within, cut)
    over = np.flatnonzero(within + size > 64)  # at most one in each word
    out[word[over] + 1] |= value[over] >> (64 - within[over])
    raw = out.tobytes()
    return [raw[lo : lo - (-bits // 8)] for lo, bits in zip((8 * first).tolist(), own.tolist(), strict=True)]


def pad(text: bytes) -> bytes:
    """``text`` with spaces to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def encode_payload(payload: bytes) -> bytes:
    """Bytes, a multiple of 192 of them, as one image or several."""
    return encode_payloads([payload])[0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """``encode_payload`` of each; their images are made together."""
    most = ROW * MOST_ROWS
    pieces = [[x[lo : lo + most] for lo in range(0, len(x), most)] if len(x) > most else [x] * bool(x) for x in payloads]
    images: list[bytes] = []
    for group in _groups([x for y in pieces for x in y]):
        images += _payload_images(group)
    made = iter(images)
    return [b"".join(islice(made, len(x))) for x in pieces]


def _groups(files: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The files in their order, in groups of about TOGETHER bytes; one that is larger is alone or last."""
    group, size = [], 0
    for x in files:
        if group and size + len(x) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def decode_payload(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The bytes that ``encode_payload`` stored, and the pixels of its images."""
    return decode_payloads([media])[0]


def decode_payloads(medias: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """``decode_payload`` of each; their images are read together."""
    files, many = [], []
    for media in medias:
        at, before = 0, len(files)
        while at < len(media):
            size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
            files.append(media[at : at + size])
            at += size
        many.append(len(files) - before)
    read = chain.from_iterable(map(decode_many, _groups(files)))
    found = []
    for n in many:
        images = list(islice(read, n))
        found.append((b"".join(_bytes(px)[..., 2::-1].tobytes() for px in images), images))
    return found


def feature(images: list[np.ndarray]) -> str:
    """Size, mean of the channels, and mean step from pixel to pixel in a row, as one string."""
    rows, total, steps, n, m = 0, np.zeros(3), 0.0, 0, 0
    for px in images:
        c = _bytes(px)[..., 2::-1]
        rows += px.shape[0]
        total += c.reshape(-1, 3).sum(0)
        step = np.abs(np.diff(c[..., 1].astype(np.int16), axis=1))
        steps, n, m = steps + float(step.sum()), n + px.size, m + step.size
    r, g, b = total / n
    return f"{images[0].shape[1]}x{rows} r{r:.3f} g{g:.3f} b{b:.3f} step{steps / max(m, 1):.3f}"


RESULT = {
    "n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(),
    "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(),
}


def store(documents: DataFrame, media: bool = False) -> DataFrame:
    """Carried columns (not the text) and what reading the stored image back gives; with
    ``media`` also the stored form itself."""
    carried = [c for c in documents.columns if c not in ("text", "media", *RESULT)]

    def some(raws: list[bytes]) -> Iterator[tuple]:
        stored = encode_payloads([pad(x) for x in raws])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for raw, file, (back, images) in zip(raws, stored, decode_payloads(stored), strict=True):
            yield len(raw), len(back), sha(back), zlib.crc32(back[-16:]), len(file), sha(file), feature(images), file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                raws = ((text or "").encode() for text in batch["text"].to_pylist())
                found = list(zip(*chain.from_iterable(map(some, _groups(raws))), strict=True)) or [()] * 8
                columns = [pa.array(x, pa.int64() if isinstance(t, T.LongType) else pa.string()) for x, t in zip(found, RESULT.values(), strict=False)]
                if media:
                    columns.append(pa.array(found[7], pa.binary()))
                yield pa.record_batch([*(batch[c] for c in carried), *columns], [*carried, *RESULT, *(["media"] if media else [])])

    kinds = RESULT | ({"media": T.BinaryType()} if media else {})
    schema = T.StructType([*documents.select(*carried).schema.fields, *(T.StructField(c, t) for c, t in kinds.items())])
    return in_batches(documents).select(*carried, "text").mapInArrow(run, schema)


PIXELS = {"width": T.IntegerType(), "height": T.IntegerType(), "pixels": T.BinaryType(), "error": T.StringType()}


def read(files: DataFrame, column: str = "media") -> DataFrame:
    """Carried columns and, of the VP8L files in ``column``, width, height and pixels (R, G, B and A of
    each, row by row). A file that cannot be read has nulls and says why in ``error``; a null one has
    nulls alone."""
    carried = [c for c in files.columns if c not in PIXELS]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None, None
        try:
            px = decode(raw)
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, str(e) or type(e).__name__
        return px.shape[1], px.shape[0], _bytes(px)[..., [2, 1, 0, 3]].tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 50):
                batch = whole.slice(lo, 50)
                found = list(zip(*map(one, batch[column].to_pylist()), strict=True))
                yield pa.record_batch([*(batch[c] for c in carried), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], [*carried, *PIXELS])

    schema = T.StructType([*files.select(*carried).schema.fields, *(T.StructField(c, t) for c, t in PIXELS.items())])
    return in_batches(files).select(*carried).mapInArrow(run, schema)
