"""Lossless WebP (VP8L) in numpy: a decoder for the whole format and an encoder for 8-bit samples.

The encoder writes prefix codes, back-references, and the palette or the predictor transform where they make a file smaller. It writes no colour
cache and no cross-colour transform: gray samples after the subtract-green transform have one symbol a pixel and no other channel, so neither can save a bit.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_ALPHABETS = (256 + 24, 256, 256, 256, 40)
_CACHE_MULT = 0x1E35A7BD
_MAX_SIDE = 1 << 14
# The 120 near distances: (x, y) by length, then by the width of |x|, right before left.
_NEAR = sorted(
    [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0],
    key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), p[0] < 0),
)
#: Bits that are looked at together where all positions of a stream are decoded at once.
_SPAN = 1 << 20


class WebPError(ValueError):
    """The bytes aren't a lossless WebP image."""


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        self.end = len(data) * 8

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.end:
            raise WebPError("truncated")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & ((1 << n) - 1)


def _turned() -> np.ndarray:
    """The 15-bit numbers with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(15):
        out = np.append(out * 2, out * 2 + 1)
    return out


_TURNED = _turned()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest, as streams hold them."""
    lengths = lengths.astype(np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        # the codes of one length follow each other; a longer one goes on from twice the next
        size = lengths[order]
        codes[order] = np.append(0, np.cumsum(1 << (15 - size))[:-1]) >> (15 - size)
    return _TURNED[codes] >> (15 - lengths)


class _Code:
    """A prefix code as a table over its longest length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if len(used) <= 1:
            self.single = self.single or 0
            self.bits, self.symbols, self.sizes = 0, np.zeros(1, np.uint16) + np.uint16(self.single), np.zeros(1, np.uint8)
        else:
            self.bits = int(lengths.max())
            if int(np.sum(1 << (15 - lengths[used].astype(np.int64)))) != 1 << 15:
                raise WebPError("an incomplete prefix code")
            # in the order of the codes each symbol has a run of the table; the table is read by reversed bits
            order = used[np.argsort(lengths[used], kind="stable")]
            turned = _TURNED[: 1 << self.bits] >> (15 - self.bits)
            self.symbols = np.repeat(order.astype(np.uint16), 1 << (self.bits - lengths[order].astype(np.int64)))[turned]
            self.sizes = lengths.take(self.symbols)
        self._symbols, self._sizes, self._mask = None, b"", (1 << self.bits) - 1

    def lists(self) -> tuple[list[int], bytes, int]:
        """Symbols and sizes by the next bits, and the mask of these."""
        if self._symbols is None:
            self._symbols, self._sizes = self.symbols.tolist(), self.sizes.tobytes()
        return self._symbols, self._sizes, self._mask

    def read(self, bits: _Bits) -> int:
        if self.bits == 0:
            return self.single
        self.lists()
        at = bits.at
        v = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & self._mask
        bits.at = at = at + self._sizes[v]
        if at > bits.end:
            raise WebPError("truncated")
        return self._symbols[v]


@lru_cache(256)
def _small(lengths: bytes) -> _Code:
    return _Code(np.frombuffer(lengths, np.uint8))


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise WebPError("a symbol beyond its alphabet")
            lengths[s] = 1
        return _small(lengths.tobytes())
    # the rest is read from one number: lengths are many short fields
    begin = bits.at
    v = int.from_bytes(bits.data[begin >> 3 : (begin >> 3) + 1024], "little") >> (begin & 7)
    at = 4
    own = bytearray(19)
    for i in _LENGTH_ORDER[: 4 + (v & 15)]:
        own[i] = v >> at & 7
        at += 3
    code = _small(bytes(own))
    symbols, sizes, mask = code.lists()
    left, limited = size, v >> at & 1
    at += 1
    if limited:
        n = 2 + 2 * (v >> at & 7)
        left = 2 + (v >> at + 3 & ((1 << n) - 1))
        at += 3 + n
    v >>= at
    done, last = 0, 8
    lengths = bytearray(size)
    while done < size and left:
        left -= 1
        s, n = symbols[v & mask], sizes[v & mask]
        v >>= n
        at += n
        if s < 16:
            lengths[done] = s
            done += 1
            last = s or last
            continue
        extra = (2, 3, 7)[s - 16]
        n = (3, 3, 11)[s - 16] + (v & ((1 << extra) - 1))
        v >>= extra
        at += extra
        if done + n > size:
            raise WebPError("code lengths beyond their alphabet")
        if s == 16:
            lengths[done : done + n] = bytes([last]) * n
        done += n
    bits.at = begin + at
    if bits.at > bits.end:
        raise WebPError("truncated")
    return _Code(np.frombuffer(lengths, np.uint8))


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of lengths or distances (from 1 on)."""
    u = values.astype(np.int64) - 1
    high = np.frexp(np.maximum(u, 1).astype(np.float64))[1] - 1
    extra = np.maximum(high - 1, 0)
    half = u >> extra
    return np.where(u < 4, u, 2 * high + (half & 1)), np.where(u < 4, 0, extra), np.where(u < 4, 0, u - (half << extra))


def _extended(bits: _Bits, prefix: int) -> int:
    return int(_BASE[prefix]) + bits.read(int(_EXTRA[prefix]))


#: Extra bits by prefix, and the least value of each.
_EXTRA = np.maximum((np.arange(40) - 2) >> 1, 0)
_BASE = np.where(np.arange(40) < 4, np.arange(40), (2 + (np.arange(40) & 1)) << _EXTRA) + 1


def _distances(codes: np.ndarray, width: int) -> np.ndarray:
    """Pixels back, from distance codes: the first 120 name places near by."""
    x, y = np.array(_NEAR).T
    near = np.maximum(1, x + y * width)
    return np.where(codes > 120, codes - 120, near[np.minimum(codes, 120) - 1])


def _symbols(bits: _Bits, codes: list[_Code], count: int, width: int) -> np.ndarray:
    """Pixels of a stream of literals and references in one group of codes.

    Every bit position is decoded at once, as if a symbol began there; then the chain of those that do begin one is walked.
    """
    data = np.frombuffer(bits.data, np.uint8).astype(np.uint32)
    green, red, blue, alpha, far = codes
    others = [c for c in (red, blue, alpha) if c.bits]
    refers = int(green.symbols.max()) >= 256
    reach = max(sum(c.bits for c in codes[:4]), refers * (green.bits + 10 + far.bits + 18))
    rest = red.symbols[0].astype(np.uint32) << 16 | blue.symbols[0].astype(np.uint32) | alpha.symbols[0].astype(np.uint32) << 24
    # bits up to and with the extra ones of a length, by the table's entries, and those of a distance
    is_ref = green.symbols >= 256
    first = green.sizes + np.where(is_ref, _EXTRA[np.clip(green.symbols.astype(np.int64) - 256, 0, 23)], 0).astype(np.uint8)
    second = far.sizes + _EXTRA[far.symbols].astype(np.uint8)
    plain = bytearray()  # green samples, where the others are constant
    out = np.empty(count if others else 0, np.uint32)
    done, at = 0, bits.at
    while done < count:
        low = at >> 3
        high = min(len(data) - 2, low + (_SPAN >> 3) + (reach >> 3) + 2)
        d = data[low : high + 2]
        if len(d) < 3:
            raise WebPError("truncated")
        word = d[:-2] | d[1:-1] << 8 | d[2:] << 16
        window = (word[:, None] >> np.arange(8, dtype=np.uint32)[None, :]).astype(np.uint16).ravel()
        end = len(window)
        look = (window & np.uint16((1 << green.bits) - 1)).astype(np.intp)
        step = first.take(look)
        for c in others:
            step = step + c.sizes.take(window.take(np.arange(end) + step, mode="clip") & np.uint16((1 << c.bits) - 1))
        if refers:
            refs = np.flatnonzero(is_ref.take(look))
            size = step.take(refs)
            step[refs] = size + second.take(window.take(refs + size, mode="clip") & np.uint16((1 << far.bits) - 1))
        limit = min(_SPAN, end - reach) if end > reach else end
        # where the pixel after the next, and the fourth, begins; the walk then takes four at a time
        here = np.arange(end, dtype=np.int32)
        two = step + step.take(here + step, mode="clip")
        four = two + two.take(here + two, mode="clip")
        stop = limit if high < len(data) - 2 else end
        jumps, p, starts, left = four.tobytes(), at - (low << 3), [], (count - done) // 4
        add = starts.append
        last = stop - 4 * reach
        while left and p < last:
            add(p)
            p += jumps[p]
            left -= 1
        s = np.array(starts, np.int64)
        t = s + two[s]
        s = np.stack([s, s + step[s], t, t + step[t]], axis=1).ravel()
        tail, left = [], count - done - len(s)
        while left and p < stop and (left < 4 or p >= last):
            tail.append(p)
            p += int(step[p])
            left -= 1
        s = np.append(s, np.array(tail, np.int64))
        if not len(s):
            raise WebPError("truncated")
        value = green.symbols[look[s]].astype(np.int64)
        size = np.ones(len(s), np.int64)
        ref = np.flatnonzero(value >= 256)
        if len(ref):
            wide = lambda at, n: (window[np.minimum(at, end - 1)].astype(np.int64) | window[np.minimum(at + 16, end - 1)].astype(np.int64) << 16) & ((1 << n) - 1)
            kind, q = value[ref] - 256, s[ref] + green.sizes[look[s[ref]]]
            if int(kind.max()) > 23:
                raise WebPError("a colour without a cache")
            size[ref] = _BASE[kind] + wide(q, _EXTRA[kind])
            q = q + _EXTRA[kind]
            code = wide(q, np.full(len(q), far.bits))
            kind, q = far.symbols[code].astype(np.int64), q + far.sizes[code]
            back = _distances(_BASE[kind] + wide(q, _EXTRA[kind]), width)
        ends = np.cumsum(size)
        if ends[-1] >= count - done:
            n = int(np.searchsorted(ends, count - done)) + 1
            if ends[n - 1] != count - done:
                raise WebPError("a reference outside the image")
            s, value, size, ends = s[:n], value[:n], size[:n], ends[:n]
            p = int(s[-1] + step[s[-1]])
        ref = ref[ref < len(s)]
        if not others:
            lit = value < 256
            samples, cut = value[lit].astype(np.uint8).tobytes(), 0
            if len(ref):
                back, n, z = back[: len(ref)], size[ref], done + (ends - size)[ref]
                if (back > z).any():
                    raise WebPError("a reference outside the image")
                for c, n, b, z in zip((ref - np.arange(len(ref))).tolist(), n.tolist(), back.tolist(), (z - back).tolist(), strict=True):
                    if c > cut:
                        plain += samples[cut:c]
                        cut = c
                    plain += plain[z : z + n] if b >= n else (plain[z:] * (n // b + 1))[:n]
            plain += samples[cut:] if cut else samples
        else:
            begin, lit = done + ends - size, value < 256
            q, pixel = s[lit] + green.sizes[look[s[lit]]], value[lit].astype(np.uint32) << 8
            for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
                w = window[np.minimum(q, end - 1)] & np.uint16((1 << c.bits) - 1)
                pixel |= c.symbols[w].astype(np.uint32) << shift
                q = q + c.sizes[w]
            out[begin[lit]] = pixel
            for r, b in zip(ref.tolist(), back[: len(ref)].tolist() if len(ref) else [], strict=True):
                z, n = int(begin[r]), int(size[r])
                if b > z:
                    raise WebPError("a reference outside the image")
                out[z : z + n] = np.resize(out[z - b : z], n)
        done += int(ends[-1])
        at = (low << 3) + p
    bits.at = at
    if at > bits.end:
        raise WebPError("truncated")
    return out if others else np.frombuffer(bytes(plain), np.uint8).astype(np.uint32) << 8 | rest


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("a colour cache that is too large")
    groups, which, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = _pixels(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        which = (which >> 8 & 0xFFFF).astype(np.int64)
        groups = int(which.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n + (cached if i == 0 else 0)) for i, n in enumerate(_ALPHABETS)] for _ in range(groups)]
    count = width * height
    if groups == 1 and not cached:
        return _symbols(bits, codes[0], count, width)
    out = [0] * count
    cache = [0] * cached
    shift, filled, at = 32 - cache_bits, 0, 0
    across = (width + (1 << block) - 1) >> block
    picked = which.tolist() if which is not None else None
    now = codes[0]
    while at < count:
        if picked is not None:
            y, x = divmod(at, width)
            now = codes[picked[(y >> block) * across + (x >> block)]]
        s = now[0].read(bits)
        if s < 256:
            r = now[1].read(bits)
            b = now[2].read(bits)
            out[at] = now[3].read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _extended(bits, s - 256)
            far = _extended(bits, now[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = _NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > count:
                raise WebPError("a reference outside the image")
            for _ in range(length):
                out[at] = out[at - far]
                at += 1
        else:
            for p in out[filled:at]:
                cache[(_CACHE_MULT * p & 0xFFFFFFFF) >> shift] = p
            filled = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(a: int, b: int, c: int, f) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        out |= f(a >> s & 255, b >> s & 255, c >> s & 255) << s
    return out


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for s in (0, 8, 16, 24):
        guess = (left >> s & 255) + (top >> s & 255) - (corner >> s & 255)
        to_left += abs(guess - (left >> s & 255))
        to_top += abs(guess - (top >> s & 255))
    return left if to_left < to_top else top


def _half(a: int, b: int) -> int:
    """Half of a difference, towards zero."""
    return int((a - b) / 2)


#: Fixed values of the format: the predictors by mode, from left, top, top left and top right.
_PREDICT = (
    lambda lf, t, tl, tr: 0xFF000000,
    lambda lf, t, tl, tr: lf,
    lambda lf, t, tl, tr: t,
    lambda lf, t, tl, tr: tr,
    lambda lf, t, tl, tr: tl,
    lambda lf, t, tl, tr: _average(_average(lf, tr), t),
    lambda lf, t, tl, tr: _average(lf, tl),
    lambda lf, t, tl, tr: _average(lf, t),
    lambda lf, t, tl, tr: _average(tl, t),
    lambda lf, t, tl, tr: _average(t, tr),
    lambda lf, t, tl, tr: _average(_average(lf, tl), _average(t, tr)),
    lambda lf, t, tl, tr: _select(lf, t, tl),
    lambda lf, t, tl, tr: _each(lf, t, tl, lambda a, b, c: _clamp(a + b - c)),
    lambda lf, t, tl, tr: _each(_average(lf, t), tl, 0, lambda a, b, _: _clamp(a + _half(a, b))),
)


def predict(pixels: list[int], at: int, width: int, modes: list[int], block: int) -> int:
    """The prediction of pixel ``at`` from those before it."""
    y, x = divmod(at, width)
    if not at:
        return 0xFF000000
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    mode = modes[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
    return _PREDICT[mode](pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _unpredict(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    modes = (modes >> 8 & 0xF).tolist()
    if len(set(modes)) == 1 and modes[0] in (1, 2):  # from the left or from above everywhere: running sums
        out = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, width, 4).copy()
        out[0, 0, 3:] += np.uint8(255)
        if modes[0] == 1:
            out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        else:
            out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=2 - modes[0], dtype=np.uint8).view("<u4").ravel()
    if any(m > 13 for m in modes):
        modes = [m if m <= 13 else 0 for m in modes]
    out = pixels.tolist()
    for at in range(len(out)):
        out[at] = _add(out[at], predict(out, at, width, modes, block))
    return np.array(out, np.uint32)


def _delta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8).view(np.int8).astype(np.int32) * b.astype(np.uint8).view(np.int8).astype(np.int32) >> 5


def _uncross(pixels: np.ndarray, width: int, multipliers: np.ndarray, block: int) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    m = multipliers[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
    green = pixels >> 8 & 255
    red = (pixels >> 16 & 255).astype(np.int32) + _delta(m & 255, green) & 255
    blue = (pixels & 255).astype(np.int32) + _delta(m >> 8 & 255, green) + _delta(m >> 16 & 255, red) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _ungreen(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + green & 255) << 16 | ((pixels & 255) + green & 255)


def _unindex(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    each = 8 >> pack
    index = (pixels >> 8 & 255).reshape(height, -1)
    if pack:
        index = (index[:, :, None] >> (np.arange(1 << pack) * each)[None, None, :].astype(np.uint32) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index.ravel()]


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 samples (red, green, blue, alpha) of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("no lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    if 20 + size > len(data) or data[20] != 0x2F:
        raise WebPError("truncated or without signature")
    bits = _Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("an unknown version")
    inverse, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform that is given twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            grid = _pixels(bits, (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            inverse.append((_unpredict if kind == 0 else _uncross, (wide, grid, block)))
        elif kind == 2:
            inverse.append((_ungreen, ()))
        else:
            n = bits.read(8) + 1
            steps = _pixels(bits, n, 1, False)
            palette = np.zeros(n, np.uint32)
            for s in (0, 8, 16, 24):
                palette |= (np.cumsum(steps >> s & 255) & 255).astype(np.uint32) << s
            inverse.append((_unindex, (wide, height, palette)))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            wide = (wide + (1 << pack) - 1) >> pack
    pixels = _pixels(bits, wide, height, True)
    for step, args in reversed(inverse):
        pixels = step(pixels, *args)
    argb = pixels.reshape(height, width)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8)


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code, made flatter until none exceeds ``most``."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].tolist()
    while True:
        # the two lightest of the leaves and of the joints, both of which rise, make the next joint
        joints: list[int] = []
        parent = [0] * (2 * n - 1)
        i = j = 0
        for node in range(n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j >= node or weights[i] <= joints[j]):
                    total += weights[i]
                    parent[i] = n + node
                    i += 1
                else:
                    total += joints[j]
                    parent[n + j] = n + node
                    j += 1
            joints.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            lengths[used] = depth[:n]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


#: The lengths of the code that code lengths are written in: 0 to 15, then runs (16: the last one, 17 and 18: zeros). Text has lengths from 4 to 12.
_OWN = np.array([3, 6, 6, 6, 5, 4, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 4, 4])
_OWN_CODES = canonical(_OWN).tolist()
_OWN_SIZES = _OWN.tolist()


class Writer:
    """Bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_symbol(self, symbol: int) -> None:
        """The code of a symbol that is alone."""
        self.put(0b101 | symbol << 3, 11)

    def put_code(self, lengths: np.ndarray) -> None:
        """A prefix code by its lengths."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            self.put(1, 1)  # simple: one or two symbols, of eight bits
            self.put(len(used) == 2, 1)
            self.put(1, 1)
            self.put(int(used[0]) if len(used) else 0, 8)
            if len(used) == 2:
                self.put(int(used[1]), 8)
            return
        self.put(0, 1)
        self.put(15, 4)
        for i in _LENGTH_ORDER:
            self.put(_OWN_SIZES[i], 3)
        lengths = lengths[: int(used[-1]) + 1]
        ends = np.append(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1, len(lengths))
        tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
        at = 0
        for end in ends.tolist():
            v, n = int(lengths[at]), end - at
            at = end
            if v:
                tokens.append((v, 0, 0))
                n -= 1
                while n >= 3:
                    k = min(n, 6)
                    tokens.append((16, k - 3, 2))
                    n -= k
                tokens += [(v, 0, 0)] * n
                continue
            while n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
            tokens += [(0, 0, 0)] * n
        self.put(1, 1)
        self.put(4, 3)  # the number of tokens in ten bits
        self.put(max(2, len(tokens)) - 2, 10)
        for symbol, extra, n in tokens:
            self.put(_OWN_CODES[symbol] | extra << _OWN_SIZES[symbol], _OWN_SIZES[symbol] + n)
        if len(tokens) < 2:
            self.put(_OWN_CODES[0], _OWN_SIZES[0])

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def riff(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    body, size = body + b"\0" * (len(body) & 1), len(body)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", size) + body


def pack_fields(fields: np.ndarray, sizes: np.ndarray, lead: int) -> bytes:
    """Fields of so many bits (32 at most) one after the other, beginning at bit ``lead`` (below 32) of the result."""
    ends = np.cumsum(sizes) + lead
    at = ends - sizes
    wide = fields.astype(np.uint64) << (at & 31).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    out[word[first] + 1] += np.add.reduceat(wide >> np.uint64(32), first)
    return out.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


_LOGS = np.arange(1 << 16) * np.log2(np.maximum(np.arange(1 << 16), 1))


def _cost(counts: np.ndarray) -> float:
    """Bits that symbols with such counts take at least: one each, unless all are the same."""
    n = int(counts.sum())
    if n < len(_LOGS):
        cost = float(_LOGS[n] - _LOGS.take(counts).sum())
    else:
        some = counts[counts > 0].astype(np.float64)
        cost = float(n * np.log2(n) - (some * np.log2(some)).sum())
    return max(cost, float(n)) if cost > 0 else cost


#: Bits a sample from which the predictors are tried: text has fewer.
_PICTURE = 5.5
#: Samples of a reference at least, of which the first ones are looked up; and the longest reference.
_SAME, _LONGEST = 6, 4096


def _references(values: np.ndarray, each: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of parts that repeat earlier ones and cost less than their samples at ``each`` bits.

    A sample's candidate is the last earlier place with the same ``_SAME`` samples. Where candidates of consecutive samples lie
    equally far back, they are one repetition.
    """
    n = len(values) - _SAME + 1
    if n < 2 or each <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    raw = values.tobytes() + b"\0\0"
    key = np.ndarray(n, "<u8", raw, strides=(1,)) & np.uint64((1 << 8 * _SAME) - 1)
    slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    order = np.sort(slot << np.uint64(20) | np.arange(n, dtype=np.uint64))
    at = (order & np.uint64(0xFFFFF)).astype(np.int64)
    same = key[at[1:]] == key[at[:-1]]
    back = np.zeros(n, np.int64)
    back[at[1:][same]] = (at[1:] - at[:-1])[same]
    cut = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
    far = back[cut]
    last = np.append(cut[1:], n) - 1
    need = np.ceil((13 + np.log2(np.maximum(far, 1))) / each).astype(np.int64)
    use = (far > 0) & (last - cut + _SAME >= need)
    p, starts, sizes, backs = 0, [], [], []
    for a, z, d, least in zip(cut[use].tolist(), last[use].tolist(), far[use].tolist(), need[use].tolist(), strict=True):
        if a < p:
            if z < p:
                continue
            a = p
        size = z - a + _SAME
        if size >= least:
            starts.append(a)
            sizes.append(size)
            backs.append(d)
            p = a + size
    start, size, back = (np.array(x, np.int64) for x in (starts, sizes, backs))
    if len(size) and int(size.max()) > _LONGEST:
        many = -(-size // _LONGEST)
        k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start, size, back = np.repeat(start, many) + k * _LONGEST, np.minimum(_LONGEST, np.repeat(size, many) - k * _LONGEST), np.repeat(back, many)
    return start, size, back


def _codes_for(width: int) -> np.ndarray:
    """The least distance code of each distance up to the farthest near one, else 0."""
    back = _distances(np.arange(1, 121), width)
    out = np.zeros(int(back.max()) + 1, np.int64)
    out[back[::-1]] = np.arange(120, 0, -1)
    return out


_WIDTHS: dict[int, np.ndarray] = {}


def _put_image(w: Writer, values: np.ndarray, width: int, alpha: int) -> bytes:
    """The stream after ``w`` of an image with the green samples ``values``, no red and blue, and one ``alpha``."""
    w.put(0, 2)  # no colour cache, one group of codes
    counts = np.bincount(values, minlength=280)
    refs = _references(values, _cost(counts) / len(values))
    symbols, ref = values, np.zeros(0, np.int64)
    dist = np.zeros(40, np.int64)
    if len(refs[0]):
        start, size, back = refs
        if width not in _WIDTHS:
            _WIDTHS[width] = _codes_for(width)
        near = _WIDTHS[width]
        code = near.take(back, mode="clip")
        code = np.where((back < len(near)) & (code > 0), code, back + 120)
        (a, a_bits, a_extra), (b, b_bits, b_extra) = _prefixed(size), _prefixed(code)
        edge = np.zeros(len(values) + 1, np.int8)
        edge[start + 1] = 1
        edge[start + size] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        referred = values.astype(np.int16)
        referred[start] = 256 + a
        referred = referred[keep]
        with_refs, far_counts = np.bincount(referred, minlength=280), np.bincount(b, minlength=40)
        if _cost(with_refs) + _cost(far_counts) + float((a_bits + b_bits).sum()) + 150 < _cost(counts):
            symbols, counts, dist, ref = referred, with_refs, far_counts, np.flatnonzero(referred >= 256)
    lengths, far = code_lengths(counts), code_lengths(dist)
    w.put_code(lengths)
    for symbol in (0, 0, alpha):
        w.put_symbol(symbol)
    w.put_code(far)
    codes, far_codes = canonical(lengths), canonical(far)
    if np.count_nonzero(counts) == 1:
        lengths = np.zeros_like(lengths)
    if np.count_nonzero(dist) == 1:
        far = np.zeros_like(far)
    parts, sizes = codes.take(symbols), lengths.take(symbols)
    if len(ref):  # three fields more after each reference
        where = np.ones(len(symbols), np.int64)
        where[ref] = 4
        where = np.cumsum(where) - where
        fields, widths = np.zeros(len(symbols) + 3 * len(ref), np.int64), np.zeros(len(symbols) + 3 * len(ref), np.int64)
        fields[where], widths[where] = parts, sizes
        at = where[ref]
        for k, (field, width_) in enumerate(((a_extra, a_bits), (far_codes.take(b), far.take(b)), (b_extra, b_bits)), 1):
            fields[at + k], widths[at + k] = field, width_
        parts, sizes = fields, widths
    if not sizes.any():
        return w.bytes()
    cut = w.n // 32 * 4
    head = w.value.to_bytes(cut + 4, "little")
    body = pack_fields(parts, sizes, w.n & 31)
    joint = int.from_bytes(head[cut:], "little") | int.from_bytes(body[:4].ljust(4, b"\0"), "little")
    return head[:cut] + joint.to_bytes(4, "little")[: len(body)] + body[4:]


def _predicted(samples: np.ndarray, mode: int) -> np.ndarray:
    """What is left of the samples when each is predicted from the left (1) or from above (2)."""
    left = samples.copy()
    if mode == 1:
        left[:, 1:] -= samples[:, :-1]
        left[1:, 0] -= samples[:-1, 0]
    else:
        left[1:] -= samples[:-1]
        left[0, 1:] -= samples[0, :-1]
    return left


def encode_gray(samples: np.ndarray) -> bytes:
    """A lossless WebP file of height x width 8-bit samples, as an opaque image with equal red, green and blue."""
    height, width = samples.shape
    if not (0 < height <= _MAX_SIDE and 0 < width <= _MAX_SIDE):
        raise ValueError("a side is 1 to 16384 samples long")
    samples = np.ascontiguousarray(samples, np.uint8)
    counts = np.bincount(samples.ravel(), minlength=256)
    used = np.flatnonzero(counts)
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    w.put(0b101, 3)  # subtract green: red and blue become 0
    if 2 <= len(used) <= 16 and samples.size > 256:
        pack = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        w.put(0b111, 3)  # a palette: the values' places in it, several to a byte
        w.put(len(used) - 1, 8)
        alpha = np.zeros(len(used), np.int64)
        alpha[0] = 255
        _put_palette(w, np.diff(used, prepend=0).astype(np.uint8), alpha)
        place = np.zeros(256, np.uint8)
        place[used] = np.arange(len(used))
        wide = (width + (1 << pack) - 1) >> pack
        index = np.zeros((height, wide << pack), np.uint8)
        index[:, :width] = place[samples]
        shift = (np.arange(1 << pack) * (8 >> pack)).astype(np.uint8)
        values = np.bitwise_or.reduce(index.reshape(height, wide, -1) << shift, axis=2).astype(np.uint8)
        w.put(0, 1)  # no further transform
        return riff(_put_image(w, values.ravel(), wide, 255))
    values, alpha = samples, 255
    plain = _cost(counts)
    if height > 1 and plain > _PICTURE * samples.size:
        cost, mode = min((_cost(np.bincount(_predicted(samples, m).ravel(), minlength=256)), m) for m in (1, 2))
        if cost < 0.7 * plain:  # references take a text to three quarters or so
            values, alpha = _predicted(samples, mode), 0
            w.put(0b001, 3)
            w.put(7, 3)  # blocks of 512, all with the same mode
            w.put(0, 1)
            for symbol in (mode, 0, 0, 255, 0):
                w.put_symbol(symbol)
    w.put(0, 1)  # no further transform
    return riff(_put_image(w, values.ravel(), width, alpha))


def _put_palette(w: Writer, steps: np.ndarray, alpha: np.ndarray) -> None:
    """The palette image: differences of the green samples, alpha 255 in the first."""
    w.put(0, 1)
    counts, shown = np.bincount(steps, minlength=280), np.bincount(alpha, minlength=256)
    lengths, seen = code_lengths(counts), code_lengths(shown)
    zero = np.zeros(256, np.int64)
    zero[0] = 1
    for code in (lengths, zero, zero, seen, zero):
        w.put_code(code)
    codes, marks = canonical(lengths).tolist(), canonical(seen).tolist()
    many = np.count_nonzero(counts) > 1
    for v, a in zip(steps.tolist(), alpha.tolist(), strict=True):
        if many:
            w.put(codes[v], int(lengths[v]))
        w.put(marks[a], int(seen[a]))
