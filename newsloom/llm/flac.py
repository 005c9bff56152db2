"""Media columns: FLAC streams, decoded to PCM blocks with seekable sample offsets, and a lossless writer for 8-bit samples.

Decoding (``decode_flac``): metadata, then frames by their sync codes; each frame's header CRC-8 and whole CRC-16 are verified. Constant,
verbatim, fixed and linear predictors of any order, Rice residuals of both kinds with partitions and escapes, wasted
bits and the three stereo decorrelations are read. Frames of a stream that look alike (mono, one Rice partition, predictors of one order, equal
length: what the writer makes) are decoded together, one residual of every frame at a step, with numpy; others one by one.

Writing (``encode_flac``): mono, 8 bits, blocks of 192 samples, each with the cheapest of the five fixed predictors and a linear one (Levinson-Durbin
on the block's autocorrelation) with its Rice parameter, or verbatim where Rice would be longer.

Defined results: null or empty text is one block of spaces in ``text_media``; a broken stream gives its error and no blocks in ``pcm_blocks``.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_bytes

BLOCK = 192
RATE = 8000
#: Fixed predictors: the weights of the samples before, nearest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: The format's block sizes and sample sizes by code; 0 for those that are coded otherwise.
BLOCK_SIZES = [0, 192, *(576 << k for k in range(4)), 0, 0, *(256 << k for k in range(8))]
SAMPLE_BITS = [0, 8, 12, 0, 16, 20, 24, 32]
SAMPLE_RATE_BYTES = {12: 1, 13: 2, 14: 2}


#: The writer's linear predictor: its order, the bits of a weight, and of its fraction.
ORDER, PRECISION, SHIFT = 4, 7, 5


class Broken(ValueError):
    """The stream isn't what the format or its checksums say."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1), (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
    return c.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST, _CRC16_LIST = CRC8.tolist(), CRC16.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans at once."""
    order = np.argsort(-length, kind="stable")
    b, n = begin[order], -length[order]
    c = np.zeros(len(order), np.uint16)
    for t in range(int(-n[0]) if len(n) else 0):
        k = int(np.searchsorted(n, -t, side="left"))
        head = c[:k]
        c[:k] = (head << np.uint16(8)) ^ CRC16[(head >> np.uint16(8)) ^ data[b[:k] + t]]
    out = np.empty_like(c)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame number, in the way of UTF-8 but up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF00 >> size) & 0xFF
    return bytes([lead | n >> 6 * (size - 1), *(0x80 | (n >> 6 * k) & 0x3F for k in range(size - 2, -1, -1))])


_HEADERS: list[bytes] = []


def _header(k: int) -> bytes:
    """Frame k: 192 samples, the stream's rate, mono, 8 bits, and the header's CRC-8. They are the same for every stream."""
    while len(_HEADERS) <= k:
        h = b"\xff\xf8\x10\x02" + coded_number(len(_HEADERS))
        _HEADERS.append(h + bytes([crc8(h)]))
    return _HEADERS[k]


# --- writer ----------------------------------------------------------------------------------------------------------


def linear_weights(samples: np.ndarray) -> np.ndarray:
    """The quantised weights of a linear predictor for each row, nearest sample first, by Levinson-Durbin on the row's autocorrelation."""
    x = samples.astype(np.float64)
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(axis=1) for k in range(ORDER + 1)])
    error, w = np.maximum(r[0], 1e-9), np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[i + 1] - sum((w[:, j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / error
        before = w[:, :i].copy()
        w[:, i] = k
        w[:, :i] -= k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    low = 1 << (PRECISION - 1)
    return np.clip(np.round(w * (1 << SHIFT)), -low, low - 1).astype(np.int32)


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of rows of 192 signed 8-bit samples with those frame numbers, end to end, and their lengths in bytes."""
    rows = len(samples)
    d = [samples.astype(np.int16)]
    for _ in range(4):
        d.append(np.diff(d[-1], axis=1))
    weights, wide = linear_weights(samples), samples.astype(np.int32)
    predicted = sum(weights[:, j : j + 1] * wide[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    d.append((wide[:, ORDER:] - predicted).astype(np.int16))
    folded = [((x << 1) ^ (x >> 15)).astype(np.uint16) for x in d]  # signed to unsigned, small ones first
    first = [0, 1, 2, 3, 4, ORDER]  # samples that stand before the residuals, of the fixed predictors and the linear one
    extra = [0, 0, 0, 0, 0, 9 + PRECISION * ORDER]  # bits of the predictor
    bits = np.empty((6, 8, rows), np.int64)
    for kind, x in enumerate(folded):
        for k in range(8):
            bits[kind, k] = (x >> np.uint16(k)).sum(axis=1, dtype=np.int64) + x.shape[1] * (k + 1) + 8 * first[kind] + extra[kind]
    flat = bits.reshape(48, rows)
    best = flat.argmin(axis=0)
    order, rice = best // 8, best % 8
    coded = flat[best, np.arange(rows)] + 10 < BLOCK * 8  # else verbatim
    headers = [_header(int(k)) for k in number]
    head = np.array([len(h) for h in headers])
    total = head + 1 + np.where(coded, -(-(flat[best, np.arange(rows)] + 10) // 8), BLOCK) + 2
    at = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(int(at[-1]), np.uint8)
    begin = at[:-1]
    for size in np.unique(head):
        pick = np.flatnonzero(head == size)
        h = np.frombuffer(b"".join(headers[i] for i in pick), np.uint8).reshape(-1, size)
        out[begin[pick][:, None] + np.arange(size)] = h
    # subframe header: a zero bit, six bits of type, a zero bit
    out[begin + head] = np.where(coded, np.where(order < 5, 8 + order, 31 + ORDER) << 1, 1 << 1)
    body = begin + head + 1
    v = np.flatnonzero(~coded)
    out[body[v][:, None] + np.arange(BLOCK)] = samples[v].view(np.uint8)
    for o in range(6):
        pick = np.flatnonzero(coded & (order == o))
        if not len(pick):
            continue
        out[body[pick][:, None] + np.arange(first[o])] = samples[pick, : first[o]].view(np.uint8)
        # two bits of method and four of partition order (0), four of the parameter
        k = rice[pick].astype(np.uint16)[:, None]
        start = (body[pick] + first[o]) * 8
        predictor = [(4, np.full(len(pick), PRECISION - 1)), (5, np.full(len(pick), SHIFT)), *((PRECISION, weights[pick, j] & ((1 << PRECISION) - 1)) for j in range(ORDER))] if o == 5 else []
        words = folded[o][pick]
        high = (words >> k).astype(np.int64)
        ends = extra[o] + 10 + np.cumsum(high + 1 + k.astype(np.int64), axis=1)  # after each codeword
        low = (words & ((np.uint16(1) << k) - np.uint16(1))).astype(np.int64)
        # each codeword's stop bit and remainder: at most 8 bits, put down as two bytes
        value = (np.int64(1) << k.astype(np.int64)) | low
        width = 1 + k.astype(np.int64)
        position = start[:, None] + ends - width
        predictor.append((10, k[:, 0].astype(np.int64)))  # the parameter is the last four of the ten bits
        before = np.cumsum([0, *(n for n, _ in predictor)])[:-1] + np.where(np.array([n for n, _ in predictor]) == 10, 6, 0)
        position = np.concatenate([start[:, None] + before, position], axis=1).ravel()
        value = np.concatenate([np.stack([v for _, v in predictor], axis=1).astype(np.int64), value], axis=1).ravel()
        narrow = np.array([4 if n == 10 else n for n, _ in predictor])
        width = np.concatenate([np.broadcast_to(narrow, (len(pick), len(narrow))), np.broadcast_to(width, words.shape)], axis=1).ravel()
        shifted = value << (16 - (position & 7) - width)
        byte = position >> 3
        # bits never overlap, so sums are unions
        out += np.bincount(byte, weights=shifted >> 8, minlength=len(out))[: len(out)].astype(np.uint8)
        out += np.bincount(byte + 1, weights=shifted & 255, minlength=len(out) + 1)[: len(out)].astype(np.uint8)
    crc = crc16(out, begin, total - 2)
    out[at[1:] - 2], out[at[1:] - 1] = crc >> np.uint16(8), crc & np.uint16(255)
    return out, total


def stream_head(samples: int, shortest: int, longest: int, md5: bytes) -> bytes:
    """The marker and STREAMINFO of a mono 8-bit stream."""
    info = BLOCK.to_bytes(2, "big") * 2 + shortest.to_bytes(3, "big") + longest.to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | samples).to_bytes(8, "big") + md5
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, a positive multiple of 192 bytes, taken as 8-bit samples around 128."""
    blocks = np.array([len(p) // BLOCK for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(128)
    number = np.arange(int(blocks.sum())) - np.repeat(np.concatenate(([0], np.cumsum(blocks)[:-1])), blocks)
    data, length = encode_frames(flat.view(np.int8).reshape(-1, BLOCK), number)
    at, edge, frame, out = np.concatenate(([0], np.cumsum(length))), 0, 0, []
    for n in blocks:
        size = length[frame : frame + n]
        part = flat[edge : edge + n * BLOCK]
        out.append(stream_head(int(n) * BLOCK, int(size.min()), int(size.max()), hashlib.md5(part).digest()) + data[at[frame] : at[frame + n]].tobytes())
        frame, edge = frame + n, edge + n * BLOCK
    return out


def encode_flac(payload: bytes) -> bytes:
    return encode_many([payload])[0]


# --- reader ----------------------------------------------------------------------------------------------------------


class Info(NamedTuple):
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    block: int
    frames: int  #: where the first frame begins


def read_head(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise Broken("no fLaC marker")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise Broken("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 34:
            x = int.from_bytes(body[10:18], "big")
            info = (x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34], int.from_bytes(body[:2], "big"))
        at += 4 + size
        if last:
            break
    if info is None:
        raise Broken("no STREAMINFO")
    return Info(*info, at)


class Header(NamedTuple):
    at: int
    size: int
    block: int
    channels: int  #: the code
    bits: int
    number: int
    variable: bool


def read_frame_header(data: bytes, at: int, info: Info) -> Header | None:
    """The header at a sync code, None if it isn't one by its fields or CRC-8."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        return None
    block, rate, channels, bits = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    if not block or rate == 15 or channels > 10 or bits == 3 or h[3] & 1:
        return None
    lead = h[4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead & (0x40 >> k) == 0), 7) if lead >= 0xC0 else 7
    if more == 7 or len(h) < 6 + more:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for b in h[5 : 5 + more]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    i = 5 + more
    n = BLOCK_SIZES[block]
    if block in (6, 7):
        n, i = int.from_bytes(h[i : i + block - 5], "big") + 1, i + block - 5
    i += SAMPLE_RATE_BYTES.get(rate, 0)
    if i >= len(h) or crc8(h[:i]) != h[i]:
        return None
    return Header(at, i + 1, n, channels, SAMPLE_BITS[bits] or info.bits, number, bool(h[1] & 1))


def frame_heads(data: bytes, info: Info) -> list[Header]:
    """What looks like a frame's header, by its fields and CRC-8."""
    view = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((view[info.frames : -1] == 0xFF) & (view[info.frames + 1 :] & 0xFE == 0xF8)) + info.frames
    heads = [h for h in (read_frame_header(data, at, info) for at in sync.tolist()) if h]
    if info.frames < len(data) and (not heads or heads[0].at != info.frames):
        raise Broken(f"no frame header at byte {info.frames}")
    return heads


def frame_spans(data: bytes, info: Info, heads: list[Header], fine: bool) -> list[tuple[Header, int]]:
    """The frames' headers and ends: each ends at a later header where its CRC-16 comes out as zero. fine: that is so at the next one for all."""
    ends = [h.at for h in heads[1:]] + [len(data)]
    if fine:
        return list(zip(heads, ends, strict=True))
    # a sync code within a frame: take the first end that the CRC-16 confirms
    view, spans, at, k = np.frombuffer(data, np.uint8), [], info.frames, 0
    while at < len(data):
        while k < len(heads) and heads[k].at < at:
            k += 1
        if k == len(heads) or heads[k].at != at:
            raise Broken(f"no frame header at byte {at}")
        for j in range(k, len(heads)):
            if crc16(view, np.array([at]), np.array([ends[j] - at]))[0] == 0:
                spans.append((heads[k], ends[j]))
                at, k = ends[j], j + 1
                break
        else:
            raise Broken(f"frame at byte {at} fails its CRC-16")
    return spans


class Bits:
    """Reads one frame's bits in turn."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise Broken("frame ends early")
        x = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return x & (1 << n) - 1

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: Bits, block: int, order: int) -> list[int]:
    width = {0: 4, 1: 5}.get(bits.take(2))
    if width is None:
        raise Broken("unknown residual coding")
    parts = bits.take(4)
    out: list[int] = []
    for part in range(1 << parts):
        n = (block >> parts) - (order if part == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                x = bits.unary() << k | bits.take(k)
                out.append(x >> 1 ^ -(x & 1))
    return out


def _subframe(bits: Bits, block: int, size: int) -> np.ndarray:
    if bits.take(1):
        raise Broken("subframe padding")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        size -= wasted
    if kind == 0:
        out = [bits.signed(size)] * block
    elif kind == 1:
        out = [bits.signed(size) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(size) for _ in range(order)]
        weights, shift = FIXED[order] if kind <= 12 else [], 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, block, order):
            out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise Broken("reserved subframe type")
    return np.array(out, np.int64) << wasted


def _frame(data: bytes, head: Header) -> np.ndarray:
    """channels x samples of one frame of any kind."""
    bits, code = Bits(data, head.at + head.size), head.channels
    if code < 8:
        return np.stack([_subframe(bits, head.block, head.bits) for _ in range(code + 1)])
    a = _subframe(bits, head.block, head.bits + (code == 9))
    b = _subframe(bits, head.block, head.bits + (code != 9))
    if code == 8:
        return np.stack([a, a - b])
    if code == 9:
        return np.stack([a + b, b])
    mid = a << 1 | b & 1
    return np.stack([mid + b >> 1, mid - b >> 1])


def _frames_alike(data: np.ndarray, at: np.ndarray, order: int, block: int, precision: int) -> np.ndarray:
    """Frames x samples: 8-bit mono subframes with predictors of one order and one Rice partition, their bodies at those bytes; a residual of every
    frame at each step. precision: the bits of a linear predictor's weights, 0 for the fixed ones."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    n = len(at)
    out = np.zeros((n, block), np.int32)
    out[:, :order] = padded[at[:, None] + np.arange(order)].view(np.int8)
    # every 32 bits from a byte on, for windows at any bit
    wide = padded[:-8].astype(np.uint64)
    wide = (wide << np.uint64(32)) | (padded[1:-7].astype(np.uint64) << np.uint64(24)) | (padded[2:-6].astype(np.uint64) << np.uint64(16)) | (padded[3:-5].astype(np.uint64) << np.uint64(8)) | padded[4:-4]
    position = (at + order) * 8

    def field(position: np.ndarray, n: int) -> np.ndarray:
        return ((wide[position >> 3] >> (np.uint64(40 - n) - (position & 7).astype(np.uint64))) & np.uint64((1 << n) - 1)).astype(np.int64)

    weights, shift = np.tile(np.array(FIXED[order] if not precision else [0] * order, np.int64), (n, 1)), np.zeros(n, np.int64)
    if precision:
        shift = field(position + 4, 5)
        for j in range(order):
            w = field(position + 9 + precision * j, precision)
            weights[:, j] = w - ((w >> (precision - 1)) << precision)
        position = position + 9 + precision * order
    first = (wide[position >> 3] >> (np.uint64(30) - (position & 7).astype(np.uint64))) & np.uint64(1023)
    k = (first & np.uint64(15)).astype(np.int64)
    position = position + 10
    high_bit = np.zeros(1 << 16, np.int64)
    for b in range(16):
        high_bit[1 << b : 2 << b] = 15 - b
    high_bit[0] = 16
    for i in range(order, block):
        zeros = np.zeros(n, np.int64)
        todo = None
        while True:  # 16 bits of the unary part at a time; few frames need more
            p = position if todo is None else position[todo]
            window = ((wide[p >> 3] >> (np.uint64(24) - (p & 7).astype(np.uint64))) & np.uint64(0xFFFF)).astype(np.int64)
            z = high_bit[window]
            if todo is None:
                zeros += z
                position = position + z
                todo = np.flatnonzero(z == 16)
            else:
                zeros[todo] += z
                position[todo] += z
                todo = todo[z == 16]
            if not len(todo):
                break
            if int(position.max()) > 8 * len(data):
                raise Broken("residual runs over the end")
        p = position + 1
        low = ((wide[p >> 3] >> (40 - (p & 7) - k).astype(np.uint64)).astype(np.int64)) & ((1 << k) - 1)
        position = p + k
        x = zeros << k | low
        out[:, i] = x >> 1 ^ -(x & 1)
    for i in range(order, block):
        if order:
            out[:, i] += (weights * out[:, i - order : i][:, ::-1]).sum(axis=1) >> shift
    return out


def _alike(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """The order and precision of a subframe's predictor, if frames like it are decoded together: 8 bits, one partition of plain Rice residuals."""
    kind = data[at] >> 1
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if data[at] & 1 or order < 0 or end - at <= 3 + order + (order * 2 + 3 if kind >= 32 else 0):
        return None
    bits, precision = Bits(data, at + 1 + order), 0
    if kind >= 32:
        precision = bits.take(4) + 1
        if bits.take(5) > 15:
            return None
        bits.at += precision * order
    return (order, precision) if bits.take(6) == 0 and bits.take(4) < 12 else None


class Decoded(NamedTuple):
    info: Info
    offsets: list[int]  #: each block's first sample
    blocks: list[np.ndarray]  #: channels x samples each


def decode_many(streams: list[bytes]) -> list[Decoded | Broken]:
    """Every stream's blocks of PCM, or what is wrong with it."""
    out: list[Decoded | Broken] = []
    alike: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    whole = np.frombuffer(b"".join(streams), np.uint8)
    heads: list[tuple[Info, list[Header]] | Broken] = []
    begin, length, base = [], [], 0
    for data in streams:
        try:
            info = read_head(data)
            heads.append((info, found := frame_heads(data, info)))
            begin += [base + h.at for h in found]
            length += [e - h.at for h, e in zip(found, [*(h.at for h in found[1:]), len(data)], strict=True)]
        except Broken as e:
            heads.append(e)
        base += len(data)
    fine = crc16(whole, np.array(begin, np.int64), np.array(length, np.int64)) == 0
    base = seen = 0
    for s, data in enumerate(streams):
        try:
            if isinstance(heads[s], Broken):
                raise heads[s]
            info, found = heads[s]
            seen += len(found)
            spans = frame_spans(data, info, found, bool(fine[seen - len(found) : seen].all()))
            offsets, blocks, n = [], [], 0
            for k, (head, end) in enumerate(spans):
                at = head.at + head.size
                offsets.append(head.number if head.variable else n)
                n = offsets[-1] + head.block
                blocks.append(None)
                kind = data[at]
                if head.channels == 0 and head.bits == 8 and kind == 2:
                    blocks[-1] = np.frombuffer(data, np.int8, head.block, at + 1).astype(np.int32)[None]
                elif head.channels == 0 and head.bits == 8 and (like := _alike(data, at, end)):
                    alike.setdefault((like[0], head.block, like[1]), []).append((s, k, base + at + 1))
                else:
                    blocks[-1] = _frame(data, head)
            out.append(Decoded(info, offsets, blocks))
        except Broken as e:
            out.append(e)
        base += len(data)
    for (order, block, precision), found in alike.items():
        found = [x for x in found if isinstance(out[x[0]], Decoded)]
        for low in range(0, len(found), 20_000):
            part = found[low : low + 20_000]
            for (s, k, _), x in zip(part, _frames_alike(whole, np.array([x[2] for x in part]), order, block, precision), strict=True):
                out[s].blocks[k] = x[None]
    for s, x in enumerate(out):
        if isinstance(x, Decoded) and any(x.info.md5):
            size = -(-x.info.bits // 8)
            pcm = np.concatenate(x.blocks, axis=1).T.astype("<i4") if x.blocks else np.zeros((0, 1), "<i4")
            raw = np.ascontiguousarray(pcm).view(np.uint8).reshape(*pcm.shape, 4)[:, :, :size].tobytes()
            if hashlib.md5(raw).digest() != x.info.md5:
                out[s] = Broken("samples fail the stream's MD5")
    return out


def decode_flac(data: bytes) -> Decoded:
    x = decode_many([data])[0]
    if isinstance(x, Broken):
        raise x
    return x


# --- jobs ------------------------------------------------------------------------------------------------------------


def pcm_blocks(media: DataFrame, key: str, column: str) -> DataFrame:
    """key, block, sample_offset, n_samples, pcm (little-endian, interleaved), error: the blocks of every FLAC stream in a column; a null or broken
    stream is one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: list[tuple] = []
                for k, x in zip(part.column(0).to_pylist(), decode_many([m or b"" for m in part.column(1).to_pylist()]), strict=True):
                    if isinstance(x, Broken):
                        rows.append((k, None, None, None, None, str(x)))
                        continue
                    size = -(-x.info.bits // 8)
                    for i, (offset, b) in enumerate(zip(x.offsets, x.blocks, strict=True)):
                        raw = np.ascontiguousarray(b.T.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
                        rows.append((k, i, offset, b.shape[1], raw, None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (part.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["key", "block", "sample_offset", "n_samples", "pcm", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(run, f"key {kind}, block long, sample_offset long, n_samples long, pcm binary, error string")


def feature(samples: np.ndarray) -> str:
    """Loudness and zero crossings of 8-bit samples, in fixed digits."""
    rms = float(np.sqrt(np.mean(samples.astype(np.float64) ** 2)))
    crossed = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"samples={len(samples)};peak={int(np.abs(samples).max())};rms={rms:.4f};crossings={crossed}"


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of the block."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the FLAC stream of the padded text), payload (decoded from it) and feature of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            streams = encode_many([payload(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            back, said = [], []
            for x in decode_many(streams):
                if isinstance(x, Broken):
                    raise x
                samples = np.concatenate([b[0] for b in x.blocks])
                back.append((samples + 128).astype(np.uint8).tobytes())
                said.append(feature(samples))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(streams, pa.binary()), pa.array(back, pa.binary()), pa.array(said, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """What text_media stores, in digests."""
    tail = F.expr("substring(payload, greatest(length(payload) - 15, 1), 16)")
    return text_media(docs).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


