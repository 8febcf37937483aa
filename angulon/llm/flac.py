"""FLAC: mono 8-bit streams written from bytes, and read back frame by frame in step.

A payload's bytes become signed samples (byte - 128). Writing cuts them into frames of BLOCK samples; each frame is
constant, Rice-coded after a linear predictor, or verbatim, whichever is least. The predictor is a fixed one of order 0
to 2 or one of order LPC fitted to the frame (autocorrelation, Levinson recursion, TAP_BITS a coefficient). A stream has a
STREAMINFO block (with the MD5 of the samples), a SEEKTABLE with a point for every frame, and the frames with CRC-8
and CRC-16. Reading parses headers, verifies both checksums of every frame and the MD5, decodes constant, verbatim,
fixed and LPC subframes with partitioned Rice residuals (both parameter sizes, and escaped raw ones), and yields PCM
blocks with the offset of their first sample. All frames of a group advance together, one sample a step, so that the
work is numpy's; where there is no seek point the frames are walked one after the other. Other channel counts, sample
sizes, wasted bits and blocks of various sizes raise ValueError, as damaged streams do. Memory is bounded by GROUP frames
besides the stream itself.

Null counts as the empty text; bytes 0 are appended up to a positive multiple of 64. Equal texts, in whatever rows, give
equal streams; texts may be of any length. Ids may be null or repeated; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import releasing
from .textio import chunks

BLOCK, GROUP, RATE, LPC, TAP_BITS = 512, 2048, 8000, 4, 12
#: Block sizes by code (0: reserved; 6 and 7: in the header's own bytes).
BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, -1, -2, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
#: Coefficients of the fixed predictors by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.int64)
    for i in range(int(size.max(initial=0))):
        on = size > i
        out[on] = _CRC8[out[on] ^ data[start[on] + i]]
    return out


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    start, longest = start[order], size[order]
    live = np.searchsorted(-longest, -np.arange(int(size.max(initial=0))), "left")  # how many frames are longer than i
    c = np.zeros(len(start), np.int64)
    for i, n in enumerate(live):
        h = c[:n]
        c[:n] = ((h << 8) & 0xFFFF) ^ _CRC16[(h >> 8) ^ data[start[:n] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    more = []
    lead = 0x3F
    while n > lead:
        more.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(more)])


def _frame_head(number: int, size: int) -> bytes:
    code, extra = (9, b"") if size == BLOCK else (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    return bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + extra


def _predictors(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each frame (a row): LPC quantised taps, their shift, and the residual after the first LPC samples."""
    x = s.astype(np.float64)
    r = np.column_stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(axis=1) for k in range(LPC + 1)])
    taps, left = np.zeros((len(x), LPC)), np.maximum(r[:, 0], 1e-9) * (1 + 1e-9)
    for m in range(LPC):  # Levinson recursion, all frames at once
        turn = (r[:, m + 1] - (taps[:, :m] * r[:, m:0:-1]).sum(axis=1)) / left
        taps[:, :m] -= turn[:, None] * taps[:, :m][:, ::-1]
        taps[:, m] = turn
        left = np.maximum(left * (1 - turn * turn), 1e-9)
    shift = np.clip(TAP_BITS - 2 - np.ceil(np.log2(np.abs(taps).max(axis=1) + 1e-9)), 0, 15).astype(np.int64)
    most = (1 << (TAP_BITS - 1)) - 1
    whole = np.clip(np.rint(taps * (1 << shift)[:, None]), -most, most).astype(np.int32)
    guess = sum(whole[:, j, None] * s[:, LPC - 1 - j : s.shape[1] - 1 - j] for j in range(LPC))
    return whole, shift, s[:, LPC:] - (guess >> shift[:, None].astype(np.int32))


def _rice_bits(u: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row's folded residuals under the best parameter, and that parameter."""
    bits = np.column_stack([count * (k + 1) + (u >> k).sum(axis=1) for k in range(8)])
    k = np.argmin(bits, axis=1)
    return bits[np.arange(len(u)), k], k


def _encode_group(samples: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of up to GROUP frames of ``samples`` (int8)."""
    n = len(start)
    inside = np.arange(BLOCK) < size[:, None]
    s = np.zeros((n, BLOCK), np.int32)
    s[inside] = samples[(start[:, None] + np.arange(BLOCK))[inside]]
    folded, total, residual = [], [], s
    for order in range(3):
        if order:
            residual = np.diff(residual, axis=1)
        u = np.where(inside[:, order:], (residual << 1) ^ (residual >> 31), 0)
        folded.append(u)
        total.append(u.sum(axis=1) + 8 * order)
    order = np.argmin(np.column_stack(total), axis=1)
    order[size <= 2] = 0
    u = np.zeros((n, BLOCK), np.int32)
    for o in range(3):
        pick = order == o
        u[pick, o:] = folded[o][pick]
    bits, k = _rice_bits(u, size - order)
    taps, shift, residual = _predictors(s)
    u_lpc = np.where(inside[:, LPC:], (residual << 1) ^ (residual >> 31), 0)
    bits_lpc, k_lpc = _rice_bits(u_lpc, size - LPC)
    extra = np.int64(9 + LPC * TAP_BITS)  # bits that describe the taps
    fitted = (size > 2 * LPC) & (extra + bits_lpc + 8 * LPC < bits + 8 * order)
    u[fitted, :LPC], u[fitted, LPC:] = 0, u_lpc[fitted]
    order, bits, k = np.where(fitted, LPC, order), np.where(fitted, extra + bits_lpc, bits), np.where(fitted, k_lpc, k)
    constant = (np.where(inside, s, s[:, :1]) == s[:, :1]).all(axis=1)
    verbatim = ~constant & (10 + bits + 8 * order >= 8 * size)
    fitted &= ~constant & ~verbatim
    rice = ~constant & ~verbatim
    heads = [_frame_head(int(a), int(b)) for a, b in zip(number, size, strict=True)]
    head_size = np.array([len(h) for h in heads]) + 1
    body = np.where(constant, 1, np.where(verbatim, size, order + (10 + bits + 7) // 8))
    whole = head_size + 1 + body + 2
    at = np.concatenate([[0], np.cumsum(whole)])
    written = np.zeros(at[-1] * 8, np.uint8)
    code_at = (at[:-1] + head_size + 1 + order) * 8
    packed = np.int64(TAP_BITS - 1) << 5 | shift
    for j in range(LPC):
        packed = packed << TAP_BITS | (taps[:, j] & ((1 << TAP_BITS) - 1))
    for j in range(extra):
        written[code_at[fitted] + j] = (packed[fitted] >> (extra - 1 - j)) & 1
    code_at += extra * fitted
    for j in range(4):
        written[code_at[rice] + 2 + 4 + j] = (k[rice] >> (3 - j)) & 1
    valid = inside & (np.arange(BLOCK) >= order[:, None])
    for kk in range(8):
        pick = np.flatnonzero(rice & (k == kk))
        if not len(pick):
            continue
        v = valid[pick]
        value = u[pick]
        length = np.where(v, (value >> kk) + kk + 1, 0)
        last = (np.cumsum(length, axis=1) + (code_at[pick] + 10)[:, None] - 1)[v]
        code = ((value & ((1 << kk) - 1)) | (1 << kk))[v]
        for j in range(kk + 1):
            written[last - j] = (code >> j) & 1
    out = np.packbits(written)
    head = np.frombuffer(b"".join(heads), np.uint8)
    where = np.repeat(at[:-1], head_size - 1) + np.arange(len(head)) - np.repeat(np.cumsum(head_size - 1) - (head_size - 1), head_size - 1)
    out[where] = head
    out[at[:-1] + head_size - 1] = crc8(out, at[:-1], head_size - 1)
    first = at[:-1] + head_size
    out[first] = np.where(constant, 0, np.where(verbatim, 2, np.where(fitted, 31 + order, 8 + order) << 1))
    byte = s.astype(np.int8).view(np.uint8)
    out[first[constant] + 1] = byte[constant, 0]
    for o in range(LPC):
        pick = rice & (order > o)
        out[first[pick] + 1 + o] = byte[pick, o]
    if verbatim.any():
        v = inside[verbatim]
        out[(first[verbatim, None] + 1 + np.arange(BLOCK))[v]] = byte[verbatim][v]
    check = crc16(out, at[:-1], whole - 2)
    out[at[1:] - 2], out[at[1:] - 1] = check >> 8, check & 0xFF
    return out, whole


def _metadata(samples: np.ndarray, sizes: np.ndarray) -> bytes:
    points, n = len(sizes), len(samples)
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | n).to_bytes(8, "big") + md5(samples.tobytes()).digest()
    table = np.zeros((points, 18), np.uint8)
    first = np.arange(points, dtype=np.int64) * BLOCK
    table[:, :8] = first.astype(">i8")[:, None].view(np.uint8)
    table[:, 8:16] = (np.cumsum(sizes) - sizes).astype(">i8")[:, None].view(np.uint8)
    table[:, 16:] = np.minimum(BLOCK, n - first).astype(">u2")[:, None].view(np.uint8)
    most = 900_000  # a block's length has 24 bits
    tables = b"".join(bytes([(3 if k == 0 else 2) | (0x80 if k + most >= points else 0)]) + (table[k : k + most].size + 4 * (k > 0)).to_bytes(3, "big") + (b"seek" if k else b"") + table[k : k + most].tobytes() for k in range(0, points, most))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + tables


def payload(text: bytes) -> bytes:
    """The bytes with 0 appended up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, none of which may be empty."""
    data = np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(0x80)
    samples = data.view(np.int8)
    length = np.array([len(p) for p in payloads], np.int64)
    frames = -(-length // BLOCK)
    base = np.repeat(np.cumsum(length) - length, frames)
    number = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    start = base + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(length, frames) - number * BLOCK)
    parts, sizes = [], []
    for g in range(0, len(start), GROUP):
        part, whole = _encode_group(samples, start[g : g + GROUP], size[g : g + GROUP], number[g : g + GROUP])
        parts.append(part.tobytes())
        sizes.append(whole)
    coded, sizes = memoryview(b"".join(parts)), np.concatenate([np.zeros(0, np.int64), *sizes])
    at = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(frames)
    out = []
    for i, p in enumerate(payloads):
        lo, hi = ends[i] - frames[i], ends[i]
        first = int(length[:i].sum()) if i == 0 else first + len(payloads[i - 1])
        out.append(_metadata(samples[first : first + len(p)], sizes[lo:hi]) + bytes(coded[at[lo] : at[hi]]))
    return out


@dataclass
class Stream:
    """What the metadata of a stream says. block: samples a frame; frames: where the frames begin; points: bytes after
    that, ascending, and firsts: the samples there."""

    samples: int
    block: int
    digest: bytes
    frames: int
    points: np.ndarray
    firsts: np.ndarray


def _need(ok, what: str) -> None:
    if not np.all(ok):
        raise ValueError(f"not a stream that can be read: {what}")


def parse(stream: bytes) -> Stream:
    _need(stream[:4] == b"fLaC", "marker")
    at, last, info, points = 4, False, None, [np.zeros((0, 18), np.uint8)]
    while not last:
        _need(at + 4 <= len(stream), "metadata cut short")
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(stream[at] & 0x80), stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3 or (kind == 2 and body[:4] == b"seek"):
            points.append(np.frombuffer(body[4 * (kind == 2) :], np.uint8).reshape(-1, 18))
        at += 4 + size
    _need(info is not None and len(info) == 34, "no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    _need((packed >> 41) & 7 == 0 and (packed >> 36) & 31 == 7, "more than one channel, or not 8 bits")
    block = int.from_bytes(info[0:2], "big")
    _need(block == int.from_bytes(info[2:4], "big"), "blocks of various sizes")
    table = np.concatenate(points)
    first, offset = (np.ascontiguousarray(table[:, a : a + 8]).view(">i8").ravel().astype(np.int64) for a in (0, 8))
    real = first >= 0  # placeholders have all bits set
    return Stream(packed & ((1 << 36) - 1), block, info[18:34], at, offset[real], first[real])


class _Bits:
    """Random access to the bits of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        bits = np.unpackbits(padded)
        ones = np.flatnonzero(bits)
        end = len(bits)
        self.next_one = np.full(end + 1, end, np.int32)
        self.next_one[ones] = ones
        self.next_one = np.minimum.accumulate(self.next_one[::-1])[::-1]
        p = padded.astype(np.uint32)
        self.window = ((p[:-3] << 24) | (p[1:-2] << 16) | (p[2:-1] << 8) | p[3:]).astype(np.int64)
        self.end = len(self.window) * 8 - 1

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n (at most 25) bits from each place."""
        at = np.minimum(at, self.end)
        return (self.window[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1 if isinstance(n, int) else (np.int64(1) << n) - 1)


def _sign(value: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    half = np.left_shift(np.int64(1), n) >> 1
    return (value ^ half) - half


def _decode_group(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames that begin at the given bytes: number, size, samples (a row each) and end."""
    bits = _Bits(data)
    byte = lambda where: bits.window[np.minimum(where, len(bits.window) - 1)] >> 24
    _need((byte(at) == 0xFF) & (byte(at + 1) == 0xF8), "frame sync, or blocks of various sizes")
    code, rate, kind = byte(at + 2) >> 4, byte(at + 2) & 15, byte(at + 3)
    _need((code > 0) & (rate < 15) & ((kind & 0xFE) == 2) | (kind == 0), "frame header")
    pos, lead = at + 4, byte(at + 4)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 99, 1, 2, 3, 4], 5)
    _need(more < 6, "frame number")
    number = np.where(more == 0, lead, lead & ((0x40 >> np.minimum(more, 6)) - 1))
    for j in range(1, int(more.max(initial=0)) + 1):
        number = np.where(more >= j, (number << 6) | (byte(pos + j) & 0x3F), number)
    pos = pos + 1 + more
    size = BLOCK_SIZES[code]
    size = np.where(code == 6, byte(pos) + 1, np.where(code == 7, (byte(pos) << 8 | byte(pos + 1)) + 1, size))
    pos = pos + (code == 6) + 2 * (code == 7) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    _need(byte(pos) == crc8(data, at, pos - at), "CRC-8 of a frame header")
    first = byte(pos + 1)
    kind = first >> 1
    _need((first & 0x81) == 0, "wasted bits")
    is_lpc, is_fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    _need(is_lpc | is_fixed | (kind <= 1), "subframe type")
    coded = is_lpc | is_fixed
    order = np.where(is_lpc, kind - 31, np.where(is_fixed, kind - 8, 0))
    _need(order <= size, "order")
    bit, n, most = (pos + 2) * 8, len(at), int(size.max(initial=0))
    width = max(1, int(order.max(initial=0)))
    out = np.zeros((most + width, n), np.int64)  # rows before ``width`` stand for samples before the first
    for j in range(int(order.max(initial=0))):
        on = coded & (order > j)
        out[width + j, on] = _sign(bits.read(bit[on] + 8 * j, 8), 8)
    bit = bit + 8 * order * coded
    taps, shift = np.zeros((width, n), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        for j, c in enumerate(FIXED[o][:width]):
            taps[j, is_fixed & (order == o)] = c
    if is_lpc.any():
        precision = bits.read(bit, 4) + 1
        shift = np.where(is_lpc, _sign(bits.read(bit + 4, 5), 5), 0)
        _need((shift >= 0) & ((precision < 16) | ~is_lpc), "predictor")
        for j in range(width):
            on = is_lpc & (order > j)
            taps[j, on] = _sign(bits.read(bit + 9 + j * precision, precision), precision)[on]
        bit = bit + np.where(is_lpc, 9 + order * precision, 0)
    for value, pick in ((0, kind == 0), (1, kind == 1)):
        for i in range(most if pick.any() else 0):
            on = pick & (size > i)
            out[width + i, on] = _sign(bits.read(bit[on] + 8 * i * value, 8), 8)
    bit = bit + 8 * np.where(kind == 0, 1, np.where(kind == 1, size, 0))
    method, parts = bits.read(bit, 2), bits.read(bit + 2, 4)
    _need((method < 2) | ~coded, "residual coding")
    part_size = np.where(coded, size >> parts, 1)
    _need(~coded | (((part_size << parts) == size) & (part_size >= order)), "partitions")
    bit = bit + 6 * coded
    width_k = 4 + method
    live = np.flatnonzero(coded)
    live = live[np.argsort(-size[live], kind="stable")]
    k, raw = np.zeros(n, np.int64), np.full(n, -1)
    at_bit, k_of, raw_of = bit[live], k[live], raw[live]
    o_of, part_of, wk_of, taps_of, shift_of, size_of = order[live], part_size[live], width_k[live], taps[:, live], shift[live], size[live]
    depth = int(order.max(initial=0))
    history = out[:, live]
    for i in range(most):
        m = int(np.searchsorted(-size_of, -i, "left"))
        if m < len(at_bit):
            bit[live[m : len(at_bit)]] = at_bit[m:]
            at_bit, k_of, raw_of = at_bit[:m], k_of[:m], raw_of[:m]
        new = (i == o_of[:m]) | ((i > o_of[:m]) & (i % part_of[:m] == 0))
        if new.any():
            w = wk_of[:m][new]
            got = bits.read(at_bit[new], w)
            at_bit[new] += w
            escape = got == (1 << w) - 1
            k_of[new] = np.where(escape, 0, got)
            width_raw = bits.read(at_bit[new], 5)
            raw_of[new] = np.where(escape, width_raw, -1)
            at_bit[new] += 5 * escape
        run = bits.next_one[np.minimum(at_bit, bits.end)].astype(np.int64)
        value = ((run - at_bit) << k_of) | bits.read(run + 1, k_of)
        value = (value >> 1) ^ -(value & 1)
        after = run + 1 + k_of
        if (raw_of >= 0).any():
            is_raw = raw_of >= 0
            width_raw = np.maximum(raw_of, 0)
            value = np.where(is_raw, np.where(width_raw > 0, _sign(bits.read(at_bit, width_raw), width_raw), 0), value)
            after = np.where(is_raw, at_bit + width_raw, after)
        guess = 0
        for j in range(depth):
            guess = guess + taps_of[j, :m] * history[width + i - 1 - j, :m]
        if i >= depth:
            history[width + i, :m] = value + (guess >> shift_of[:m])
            at_bit = after
        else:
            on = i >= o_of[:m]
            history[width + i, :m] = np.where(on, value + (guess >> shift_of[:m]), history[width + i, :m])
            at_bit = np.where(on, after, at_bit)
    bit[live[: len(at_bit)]] = at_bit
    out[:, live] = history
    end = -(-bit // 8)
    _need(end + 2 <= len(data), "frame cut short")
    _need((byte(end) << 8 | byte(end + 1)) == crc16(data, at, end - at), "CRC-16 of a frame")
    return number, size, out[width:].T, end + 2


def _walk(data: np.ndarray, whose: np.ndarray, at: np.ndarray, ends: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stream, number and samples of the frames from each place on: up to the next place, the stream's end or the frame
    number ``last`` of the stream, which is left out."""
    stops = set(at.tolist())
    while len(at):
        order = np.argsort(at)
        whose, at, later_whose, later_at = whose[order], at[order], [], []
        for g in range(0, len(at), GROUP):
            pick, mine = at[g : g + GROUP], whose[g : g + GROUP]
            lo = int(pick[0])
            hi = int(min(ends[mine[-1]], pick[-1] + (1 << 17)))  # no frame is longer
            number, size, samples, end = _decode_group(data[lo:hi], pick - lo)
            for j, i in enumerate(mine):
                yield int(i), int(number[j]), samples[j, : size[j]].astype(np.int8)
            end = end + lo
            go = [j for j in range(len(pick)) if end[j] < ends[mine[j]] and int(end[j]) not in stops and number[j] + 1 < last[mine[j]]]
            later_whose += [mine[j] for j in go]
            later_at += [end[j] for j in go]
        whose, at = np.array(later_whose, np.int64), np.array(later_at, np.int64)


def pcm_blocks(streams: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Stream, block number, offset of the block's first sample, and its samples (int8), in no given order."""
    parsed = [parse(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    data = np.frombuffer(b"".join(streams), np.uint8)
    at = [np.unique(np.append(s.points, 0)) + s.frames + base[i] if s.frames < len(streams[i]) else np.zeros(0, np.int64) for i, s in enumerate(parsed)]
    whose = np.repeat(np.arange(len(streams)), [len(x) for x in at])
    never = np.full(len(streams), np.iinfo(np.int64).max)
    for i, number, samples in _walk(data, whose, np.concatenate([np.zeros(0, np.int64), *at]), base[1:], never):
        yield i, number, number * parsed[i].block, samples


def decode(streams: list[bytes]) -> list[tuple[bytes, int]]:
    """Payload and number of frames of each stream. The count of samples and their MD5 must be right."""
    blocks: list[list] = [[] for _ in streams]
    for i, number, _, samples in pcm_blocks(streams):
        blocks[i].append((number, samples))
    out = []
    for stream, own in zip(streams, blocks, strict=True):
        samples = np.concatenate([np.zeros(0, np.int8), *(s for _, s in sorted(own, key=lambda x: x[0]))])
        info = parse(stream)
        _need(len(samples) == info.samples and (md5(samples.tobytes()).digest() == info.digest or not any(info.digest)), "samples or MD5")
        out.append(((samples.view(np.uint8) ^ np.uint8(0x80)).tobytes(), len(own)))
    return out


def read_samples(stream: bytes, lo: int, hi: int) -> np.ndarray:
    """Samples lo..hi: only frames from the last seek point before them on are decoded, or from the first frame."""
    info = parse(stream)
    lo, hi = max(lo, 0), min(hi, info.samples)
    if lo >= hi:
        return np.zeros(0, np.int8)
    firsts, points = np.append(info.firsts, 0), np.append(info.points, 0)
    begin = firsts[firsts <= lo].max()
    at = np.unique(points[(firsts >= begin) & (firsts < hi)])
    data = np.frombuffer(stream, np.uint8)[info.frames :]
    last = np.array([-(-hi // info.block)])
    got = sorted(((number, samples) for _, number, samples in _walk(data, np.zeros(len(at), np.int64), at, np.array([len(data)]), last)), key=lambda x: x[0])
    first = got[0][0] * info.block
    return np.concatenate([samples for _, samples in got])[lo - first : hi - first]


def encode_column(text: Column) -> Column:
    """The stream of each text's payload, as binary."""

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([s for part in _payloads(b) for s in encode([p for _, p in part])], pa.binary())

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(encoded), "binary")(text)


def _payloads(texts: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """Unpadded size and payload of each text, a chunk at a time."""
    for lo, hi, data, offsets in chunks(texts):
        yield [(int(offsets[i + 1] - offsets[i]), payload(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(hi - lo)]


def pcm_table(media: DataFrame, id_column: str = "doc_id", stream: str = "media") -> DataFrame:
    """The PCM blocks of streams: id, block, sample_offset, n_samples, pcm (signed bytes). A null stream has none."""
    kind = media.schema[id_column].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, streams = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = [i for i, s in enumerate(streams) if s is not None]
            for some in (keep[k : k + 64] for k in range(0, len(keep), 64)):
                rows = [(ids[some[i]], n, at, len(pcm), pcm.tobytes()) for i, n, at, pcm in pcm_blocks([streams[i] for i in some])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.types[0]), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.binary())))], [id_column, "block", "sample_offset", "n_samples", "pcm"])

    return media.select(id_column, stream).mapInArrow(blocks, f"{id_column} {kind}, block bigint, sample_offset bigint, n_samples int, pcm binary")


FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def feature(payload: bytes, frames: int) -> str:
    """Frames, extremes, sum, sum of squares and sign changes of the samples."""
    s = (np.frombuffer(payload, np.uint8) ^ np.uint8(0x80)).view(np.int8).astype(np.int64)
    return f"frames={frames};min={s.min()};max={s.max()};sum={s.sum()};squares={(s * s).sum()};crossings={np.count_nonzero((s[1:] < 0) != (s[:-1] < 0))}"


def digest_column(text: Column) -> Column:
    """Sizes, digests and features of each text's payload after writing its stream and reading that back."""

    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = []
            for part in _payloads(b):
                streams = encode([p for _, p in part])
                for (n, _), stream, (back, frames) in zip(part, streams, decode(streams), strict=True):
                    rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stream), sha256(stream).hexdigest(), feature(back, frames)))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(FIELDS.values())], names=list(FIELDS))

    digested.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(digested), "struct<" + ",".join(f"{k}:{'string' if t == pa.string() else 'bigint'}" for k, t in FIELDS.items()) + ">")(text)
