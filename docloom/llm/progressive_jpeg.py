"""Progressive JPEG (ITU-T T.81, annex G) in numpy: many images at once.

The reader accumulates spectral-selection and successive-approximation scans into coefficient
arrays, transforms back, upsamples chroma and converts to RGB. The writer is given coefficients, so
what it stores is lossless. Entropy-coded segments between restart markers are independent; all
segments of all images of a batch are coded in step, one symbol of each at a time.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from functools import cache

import numpy as np

#: Fixed values of the format: markers.
SOI, EOI, SOS, DQT, DHT, DRI, SOF2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC2


@cache
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position: along the antidiagonals, turning at each."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


#: Code lengths of the writer's Huffman tables; coefficients of bytes of text mostly have sizes 3 to 7.
AC_SHORT = {0x04: 2, 0x05: 2, 0x06: 2, 0x07: 3, 0x03: 4, 0x02: 7, 0x01: 7, 0x08: 7, 0x00: 7}
DC_LENGTHS = {s: 3 for s in range(3, 8)} | {8: 4, 9: 4, 0: 5, 1: 5, 2: 5, 10: 6, 11: 6}


@cache
def ac_lengths() -> dict[int, int]:
    rest = [r << 4 | s for r in range(1, 16) for s in range(0, 11)]
    return AC_SHORT | {x: 13 for x in [*rest, 0x09, 0x0A]}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Counts by length, symbols in order, and the code and length of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    return counts, order, code, size


def lookup(counts, symbols) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code matches."""
    out, at, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, m in enumerate(counts, 1):
        for _ in range(m):
            span = 1 << (16 - n)
            out[at : at + span] = n << 8 | symbols[k]
            at, k = at + span, k + 1
    return out


def magnitude(x: np.ndarray) -> np.ndarray:
    """Bits of |x|."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


# ---- layout -----------------------------------------------------------------------------------


class Layout:
    """Where the blocks of a batch of images lie; blocks are numbered by image, then component, then raster."""

    def __init__(self, shapes):
        """shapes: for each image (height, width, ((h, v), ...))."""
        self.shapes = shapes
        self.grid, at = [], 0
        for height, width, factors in shapes:
            hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
            wide, high = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            parts = []
            for h, v in factors:
                own = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
                parts.append((at, wide * h, high * v, *own, h, v))
                at += wide * h * high * v
            self.grid.append((wide, high, parts))
        self.blocks = at
        self.orders: dict = {}

    def order(self, image: int, components: tuple[int, ...]) -> tuple[np.ndarray, int]:
        """Blocks of a scan in coded order, and how many make an MCU."""
        wide, high, parts = self.grid[image]
        key = (wide, high, self.shapes[image], components)
        if key not in self.orders:
            base = parts[0][0]
            if len(components) == 1:
                at, across, _, own_w, own_h, _, _ = parts[components[0]]
                found = (at - base + np.arange(own_h)[:, None] * across + np.arange(own_w)[None, :]).ravel(), 1
            else:
                cells = []
                for c in components:
                    at, across, _, _, _, h, v = parts[c]
                    my, mx, y, x = np.ogrid[:high, :wide, :v, :h]
                    cells.append((at - base + (my * v + y) * across + mx * h + x).reshape(high * wide, v * h))
                both = np.concatenate(cells, 1)
                found = both.ravel(), both.shape[1]
            if len(self.orders) > 4096:
                self.orders.clear()
            self.orders[key] = found
        order, n = self.orders[key]
        return order + parts[0][0], n


# ---- writing ----------------------------------------------------------------------------------


def pack(value: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values as a run of bits, filled up with ones to whole bytes: bytes and their number."""
    while value.shape[1] > 2:
        odd = value.shape[1] % 2
        both = bits[:, 0 : value.shape[1] - odd : 2] + bits[:, 1::2]
        if both.max(initial=0) > 56:
            break
        joined = (value[:, 0 : value.shape[1] - odd : 2] << bits[:, 1::2]) | value[:, 1::2]
        if odd:
            both, joined = np.concatenate([both, bits[:, -1:]], 1), np.concatenate([joined, value[:, -1:]], 1)
        value, bits = joined, both
    ends = np.cumsum(bits, 1)
    total = ends[:, -1]
    fill = -total % 8
    size = (total + 7) // 8
    across = int(size.max(initial=0)) + 9
    out = np.zeros(len(value) * across, np.uint8)
    base = np.arange(len(value)) * across
    for k in range(value.shape[1] + 1):
        n, v, start = (bits[:, k], value[:, k], ends[:, k] - bits[:, k]) if k < value.shape[1] else (fill, (1 << fill) - 1, total)
        at = base + (start >> 3)
        room = n + (start & 7)
        x = v.astype(np.uint64) << np.minimum(64 - room, 63).astype(np.uint64)
        for j in range(int(room.max(initial=0) + 7) // 8):
            out[at + j] |= ((x >> np.uint64(56 - 8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.reshape(len(value), across), size


def first_ac(v: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a first AC scan of one block a segment."""
    n, w = v.shape
    value, bits = np.zeros((n, w + 1), np.int64), np.zeros((n, w + 1), np.int64)
    s = magnitude(v)
    extra = np.where(v > 0, v, v + (1 << s) - 1)
    value[:, :w], bits[:, :w] = code[s] << s | extra, size[s] + s
    odd = np.flatnonzero((v == 0).any(1))
    if len(odd):
        z, k = v[odd] != 0, np.arange(w)
        last = np.maximum.accumulate(np.where(z, k, -1), 1)
        run = k - np.concatenate([np.full((len(odd), 1), -1), last[:, :-1]], 1) - 1
        sym = (run & 15) << 4 | s[odd]
        part, length = code[sym] << s[odd] | extra[odd], size[sym] + s[odd]
        for _ in range(3):
            run = run - 16
            more = run >= 0
            part = np.where(more, part | code[0xF0] << length, part)
            length = np.where(more, length + size[0xF0], length)
        value[odd, :w], bits[odd, :w] = np.where(z, part, 0), np.where(z, length, 0)
        end = last[:, -1] < w - 1
        value[odd, w], bits[odd, w] = np.where(end, code[0], 0), np.where(end, size[0], 0)
    return value, bits


def refined_ac(v: np.ndarray, low: int, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and correction bits of a refining AC scan of one block a segment."""
    n, w = v.shape
    a = np.abs(v) >> low
    old, new, bit = a > 1, a == 1, a & 1
    plain = ~new.any(1)
    value, bits = np.zeros((n, w + 1), np.int64), np.zeros((n, w + 1), np.int64)
    value[:, 0], bits[:, 0] = code[0], size[0]
    value[:, 1:], bits[:, 1:] = np.where(old, bit, 0), old
    rows = np.flatnonzero(~plain)
    if not len(rows):
        return value, bits
    old, new, bit, k = old[rows], new[rows], bit[rows], np.arange(w)
    zero = ~old & ~new
    count = np.cumsum(zero, 1)
    before = np.maximum.accumulate(np.where(new, count, 0), 1)
    since = count - np.concatenate([np.zeros((len(rows), 1), np.int64), before[:, :-1]], 1)  # zeros since the last new one
    ends = w - 1 - new[:, ::-1].argmax(1)
    long_run = zero & (since % 16 == 0) & (k < ends[:, None])
    event = new | long_run
    symbol = np.where(long_run, 0xF0, (since % 16) << 4 | 1)
    # a symbol, the sign of what is new, then the bits of old ones since the symbol before; what remains belongs to the end of the block
    after = np.minimum.accumulate(np.where(event, k, w)[:, ::-1], 1)[:, ::-1]
    rest = (ends < w - 1)[:, None]
    values = np.concatenate([np.where(event, code[symbol], 0), np.where(rest, code[0], 0), v[rows] > 0, bit], 1)
    lengths = np.concatenate([np.where(event, size[symbol], 0), np.where(rest, size[0], 0), new, old], 1)
    place = np.concatenate([np.broadcast_to(k * 256, event.shape), np.full(rest.shape, w * 256), np.broadcast_to(k * 256 + 1, event.shape), after * 256 + 2 + k], 1)
    order = np.argsort(np.where(lengths > 0, place, 1 << 20), axis=1, kind="stable")
    wide = max(w + 1, int((lengths > 0).sum(1).max()))
    value, bits = (np.pad(x, ((0, 0), (0, wide - w - 1))) for x in (value, bits))
    order = order[:, :wide]
    value[rows, : order.shape[1]] = np.where(np.take_along_axis(lengths, order, 1) > 0, np.take_along_axis(values, order, 1), 0)
    bits[rows, : order.shape[1]] = np.take_along_axis(lengths, order, 1)
    return value, bits


def first_dc(v: np.ndarray, component: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a first DC scan; v: MCUs by blocks. A restart after each MCU, so differences run within it."""
    d = v.copy()
    for k in range(1, v.shape[1]):
        if component[k] == component[k - 1]:
            d[:, k] = v[:, k] - v[:, k - 1]
    s = magnitude(d)
    return code[s] << s | np.where(d > 0, d, d + (1 << s) - 1) * (s > 0), size[s] + s


#: The writer's scans: (components, first and last coefficient, high bit, low bit).
SCRIPT = [((0, 1, 2), 0, 0, 0, 1)]
SCRIPT += [((c,), 1, 5, 0, 0) for c in range(3)]
SCRIPT += [((c,), 6, 63, 0, 1) for c in range(3)]
SCRIPT += [((0, 1, 2), 0, 0, 1, 0)]
SCRIPT += [((c,), 6, 63, 1, 0) for c in range(3)]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(shapes, coefficients: np.ndarray, script=SCRIPT) -> list[bytes]:
    """Images of three components from coefficients (blocks of Layout(shapes), zigzag), quantised by 1."""
    layout = Layout(shapes)
    coefficients = coefficients.astype(np.int64)
    ac, dc = canonical(ac_lengths()), canonical(DC_LENGTHS)
    tables = segment(DQT, bytes([0, *[1] * 64])) + b"".join(segment(DHT, bytes([kind << 4, *t[0], *t[1]])) for kind, t in ((0, dc), (1, ac))) + segment(DRI, struct.pack(">H", 1))
    parts = []
    for height, width, factors in shapes:
        frame = struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors))
        parts.append([b"\xff\xd8" + tables + segment(SOF2, frame)])
    for components, first, last, high, low in script:
        orders = [layout.order(i, components) for i in range(len(shapes))]
        per = orders[0][1]
        rows = np.concatenate([o for o, _ in orders]).reshape(-1, per)
        if first:
            v = coefficients[rows[:, 0], first : last + 1]
            value, bits = first_ac(np.sign(v) * (np.abs(v) >> low), *ac[2:]) if not high else refined_ac(v, low, *ac[2:])
        else:
            v = coefficients[rows, 0]
            of = np.repeat(np.arange(len(components)), [h * w for c in components for h, w in [shapes[0][2][c]]])
            value, bits = first_dc(v >> low, of, *dc[2:]) if not high else ((v >> low) & 1, np.ones_like(v))
        body, size = pack(value, bits)
        count = np.array([len(o) // per for o, _ in orders])
        ends = np.cumsum(count)
        number = np.arange(len(rows)) - np.repeat(ends - count, count)
        body[np.arange(len(rows)), size] = 0xFF
        body[np.arange(len(rows)), size + 1] = 0xD0 + number % 8
        size[ends - 1] -= 2  # no restart marker after the last
        inside = np.arange(body.shape[1]) < (size + 2)[:, None]
        flat = body[inside]
        stuffed = flat == 0xFF
        starts = np.cumsum(size + 2)
        marked = np.ones(len(rows), bool)
        marked[ends - 1] = False
        stuffed[(starts - 2)[marked]] = False
        whole = np.repeat(flat, 1 + stuffed)
        where = np.cumsum(1 + stuffed)
        whole[where[stuffed] - 1] = 0
        cut = where[starts[ends - 1] - 1]
        head = segment(SOS, bytes([len(components), *[x for c in components for x in (c + 1, 0)], first, last, high << 4 | low]))
        data, at = whole.tobytes(), 0
        for part, to in zip(parts, cut.tolist()):
            part += [head, data[at:to]]
            at = to
    return [b"".join(p) + b"\xff\xd9" for p in parts]


# ---- reading ----------------------------------------------------------------------------------


def parse(data: bytes) -> dict:
    """Frame, tables and scans of a progressive image; scans hold spans of entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, restart, frame, scans = 2, {}, {}, 0, None, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            restart = body[0] << 8 | body[1]
        elif marker == SOF2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only 8-bit images of one or three components")
            frame = height, width, tuple((body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(n)), [body[6 + 3 * c] for c in range(n)], [body[8 + 3 * c] for c in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == SOS:
            n = body[0]
            components = tuple(frame[3].index(body[1 + 2 * k]) for k in range(n))
            tables = tuple(body[2 + 2 * k] for k in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            used = tuple(huff.get((16 if first else 0) | (t & 15 if first else t >> 4), b"") for t in tables)
            scans.append(((first, last, approx >> 4, approx & 15), components, used, restart, at, end))
            at = end
    if frame is None:
        raise ValueError("no frame")
    return {"shape": frame[:3], "quant": [quant.get(q, np.ones(64, np.int64)) for q in frame[4]], "scans": scans}


class Bits:
    """Segments of entropy-coded bytes, each read at a place of its own."""

    def __init__(self, raw: np.ndarray, span: np.ndarray):
        """raw: bytes of the scans one after another; span: the number of bytes of each."""
        after = np.append(raw[1:], 0)
        ff = raw == 0xFF
        mark = ff & (after >= 0xD0) & (after <= 0xD7)
        scan_end = np.cumsum(span)
        mark[scan_end - 1] = False
        gone = np.zeros(len(raw), bool)
        gone[1:] = (ff & ((after == 0) | mark))[:-1]
        gone |= mark
        kept = np.cumsum(~gone)
        at = np.flatnonzero(mark)
        begin = np.sort(np.concatenate([scan_end - span, at + 2]))
        self.start = np.where(begin > 0, kept[np.maximum(begin - 1, 0)], 0).astype(np.int64) * 8
        self.first = np.searchsorted(begin, scan_end - span)  # each scan's first segment
        self.count = np.diff(np.append(self.first, len(begin)))
        self.body = np.concatenate([raw[~gone], np.zeros(16, np.uint8)])
        self.words = np.ndarray(len(self.body) - 8, ">u8", self.body, strides=(1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place on, at the top of 64."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)


def extend(raw: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(raw < (1 << s) >> 1, raw - (1 << s) + 1, raw)


def take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after skip bits from the top; n may be 0."""
    return ((word << skip.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - n)


def read_dc(bits, blocks, first, count, per, component, table, low, high, out):
    """DC scans; per: blocks of an MCU; component: of each block of an MCU."""
    at = bits.start.copy()
    predicted = np.zeros((len(at), int(component.max()) + 1), np.int64)
    lanes = np.arange(len(at))
    for k in range(int(count.max(initial=0))):
        lanes = lanes[count[lanes] > k]
        rows = blocks[first[lanes] + k]
        word = bits.peek(at[lanes])
        if high:
            out[rows, 0] |= ((word >> np.uint64(63)).astype(np.int64) << low).astype(out.dtype)
            at[lanes] += 1
            continue
        c = component[k % per]
        found = table[c][(word >> np.uint64(48)).astype(np.int64)]
        n, s = found >> 8, found & 255
        if not n.all():
            raise ValueError("no such code")
        value = predicted[lanes, c] + extend(take(word, n, s), s)
        predicted[lanes, c] = value
        out[rows, 0] = value << low
        at[lanes] += n + s


def read_first_ac(bits, blocks, first, count, table, begin, end, low, out):
    at, k, block, lanes = bits.start.copy(), np.full(len(count), begin), first.copy(), np.flatnonzero(count > 0)
    stop, flat = first + count, out.reshape(-1)
    at, k, block, stop = (x[lanes] for x in (at, k, block, stop))
    while len(at):
        word = bits.peek(at)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        n, r, s = found >> 8, (found >> 4) & 15, found & 15
        if not n.all():
            raise ValueError("no such code")
        coded = s > 0
        if coded.all():
            k = k + r
            if (k > end).any():
                raise ValueError("too many coefficients")
            flat[blocks[block] * 64 + k] = extend(take(word, n, s), s) << low
            at = at + n + s
            k = k + 1
        else:
            more = np.where(coded, s, np.where(r < 15, r, 0))
            raw = take(word, n, more)
            to = np.where(coded, k + r, 0)
            if (to > end).any():
                raise ValueError("too many coefficients")
            flat[(blocks[block] * 64 + to)[coded]] = (extend(raw, s) << low)[coded]
            at = at + n + more
            ends = ~coded & (r < 15)
            k = np.where(ends, end + 1, k + r + 1)
            block = block + np.where(ends, (1 << np.where(ends, r, 0)) + raw - 1, 0)
        done = k > end
        if done.any():
            block = block + done
            k = np.where(done, begin, k)
            going = block < stop
            if not going.all():
                at, k, block, stop = (x[going] for x in (at, k, block, stop))


def read_refined_ac(bits, blocks, first, count, table, begin, end, low, out):
    lanes = np.flatnonzero(count > 0)
    at, block, stop = bits.start[lanes].copy(), first[lanes].copy(), (first + count)[lanes]
    k, skip = np.full(len(lanes), begin), np.zeros(len(lanes), np.int64)
    ks = np.arange(begin, end + 1)
    while len(at):
        rows = blocks[block]
        band = out[rows, begin : end + 1]
        old = band != 0
        word = bits.peek(at)
        found = np.where(skip > 0, 0, table[(word >> np.uint64(48)).astype(np.int64)])
        n, r, s = found >> 8, (found >> 4) & 15, found & 15
        if ((n == 0) & (skip == 0)).any() or (s > 1).any():
            raise ValueError("no such code")
        ends = (skip > 0) | ((s == 0) & (r < 15))
        starts = ends & (skip == 0)
        more = np.where(s > 0, 1, np.where(starts, r, 0))
        raw = take(word, n, more)
        skip = np.where(starts, (1 << np.where(starts, r, 0)) + raw, skip)
        at = at + n + more
        ahead = ks >= k[:, None]
        if ends.all():
            to = np.full(len(at), end + 1)
        else:
            zeros = np.cumsum(~old & ahead, 1)
            past = zeros > r[:, None]
            to = np.where(ends | ~past.any(1), end + 1, begin + past.argmax(1))
        passed = old & ahead & (ks < to[:, None])
        place = at[:, None] + np.cumsum(passed, 1) - 1
        p = place[passed]
        bit = (bits.body[np.minimum(p >> 3, len(bits.body) - 1)] >> (7 - (p & 7)).astype(np.uint8)) & 1
        grown = band[passed]
        band[passed] = grown + np.sign(grown) * (bit.astype(band.dtype) << low)
        at = at + passed.sum(1)
        new = np.flatnonzero((s > 0) & (to <= end))
        band[new, to[new] - begin] = np.where(raw[new] > 0, 1, -1) << low
        out[rows, begin : end + 1] = band
        k = np.where(ends, end + 1, to + 1)
        done = k > end
        skip = np.where(ends, skip - 1, skip)
        block = block + done
        k = np.where(done, begin, k)
        going = block < stop
        if not going.all():
            at, block, stop, k, skip = (x[going] for x in (at, block, stop, k, skip))


@cache
def reading_table(spec: bytes) -> np.ndarray:
    return lookup(spec[:16], spec[16:])


def read_coefficients(images: list[bytes]) -> tuple[Layout, np.ndarray, list[dict]]:
    """Coefficients of the images, zigzag, by the blocks of the layout."""
    parsed = [parse(x) for x in images]
    layout = Layout([p["shape"] for p in parsed])
    out = np.zeros((layout.blocks, 64), np.int16)
    for step in range(max((len(p["scans"]) for p in parsed), default=0)):
        groups = defaultdict(list)
        for i, p in enumerate(parsed):
            if step < len(p["scans"]):
                params, components, used, *_ = p["scans"][step]
                groups[params, components, used, p["shape"][2]].append(i)
        for ((begin, end, high, low), components, used, factors), members in groups.items():
            spans, orders, whole = [], [], []
            for i in members:
                *_, restart, a, b = parsed[i]["scans"][step]
                spans.append(images[i][a:b])
                order, per = layout.order(i, components)
                orders.append(order)
                whole.append(restart * per)
            bits = Bits(np.frombuffer(b"".join(spans), np.uint8), np.array([len(x) for x in spans]))
            blocks = np.concatenate(orders)
            total = np.array([len(o) for o in orders])
            scan_of = np.repeat(np.arange(len(members)), bits.count)
            inside = np.arange(len(scan_of)) - bits.first[scan_of]
            step_blocks = np.where(np.array(whole) > 0, whole, total)[scan_of]
            first = (np.cumsum(total) - total)[scan_of] + inside * step_blocks
            count = np.clip(np.cumsum(total)[scan_of] - first, 0, step_blocks)
            if begin == 0:
                of = np.repeat(np.arange(len(components)), [factors[c][0] * factors[c][1] if len(components) > 1 else 1 for c in components])
                tables = [reading_table(u) for u in used] if not high else []
                read_dc(bits, blocks, first, count, per, of, tables, low, high, out)
            elif not high:
                read_first_ac(bits, blocks, first, count, reading_table(used[0]), begin, end, low, out)
            else:
                read_refined_ac(bits, blocks, first, count, reading_table(used[0]), begin, end, low, out)
    return layout, out, parsed


# ---- pixels -----------------------------------------------------------------------------------

SCALE = 12


@cache
def basis() -> np.ndarray:
    """Inverse transform from zigzag coefficients to samples, in whole numbers of 2**-SCALE: sums stay exact in doubles."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("yv,xu->vuyx", d, d).reshape(64, 64)
    return np.rint(both * (1 << SCALE))[zigzag()]


def rgb_tensors(layout: Layout, coefficients: np.ndarray, parsed: list[dict]) -> list[np.ndarray]:
    """Full-resolution uint8 tensors of height, width and RGB; chroma samples are repeated."""
    out = []
    ones = all((q == 1).all() for p in parsed for q in p["quant"])
    if ones:
        samples = coefficients.astype(np.float64) @ basis()
        samples = np.clip(np.floor(samples / (1 << SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)
    for (height, width, factors), (_, _, parts), p in zip(layout.shapes, layout.grid, parsed):
        hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
        planes = []
        for (at, across, down, _, _, h, v), q in zip(parts, p["quant"]):
            if ones:
                own = samples[at : at + across * down]
            else:
                own = (coefficients[at : at + across * down].astype(np.int64) * q).astype(np.float64) @ basis()
                own = np.clip(np.floor(own / (1 << SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)
            plane = own.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
            y, x = vmax // v, hmax // h
            if y > 1 or x > 1:
                plane = np.repeat(np.repeat(plane, y, 0), x, 1)
            planes.append(plane[:height, :width])
        if len(planes) == 1:
            out.append(np.repeat(planes[0][:, :, None], 3, 2))
            continue
        y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        rgb = np.empty((height, width, 3), np.uint8)
        half = 1 << 15  # fixed values of JFIF: 1.402, 0.344136, 0.714136 and 1.772, times 2**16
        rgb[:, :, 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
        rgb[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
        rgb[:, :, 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
        out.append(rgb)
    return out
