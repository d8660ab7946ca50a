"""FLAC columns: payloads stored as 8-bit mono FLAC, and PCM blocks read back from it.

A payload is a text's UTF-8 bytes, filled with bytes 255 up to a positive
multiple of 576; a sample is a byte minus 128. `store` writes one FLAC stream a
row: STREAMINFO with the samples' MD5, a seek table with a point every
``SEEK_FRAMES`` frames, and frames of 576 samples, each the cheapest of a
constant, a verbatim, a fixed-predictor (order 0 to 4) or a linear-predictor
subframe with partitioned Rice residuals.

Reading back (`read_back`, `pcm_blocks`) verifies the CRC-8 of every frame
header, the CRC-16 of every frame and the MD5 of the whole, decodes Rice
residuals and predictors, and gives PCM blocks with their sample and byte
offsets. A damaged stream raises `ValueError` that names what is wrong.

Frames of many rows are worked on together in numpy arrays of at most
``SLAB`` frames, so memory is bounded by the slab and the row in hand. Null
texts count as empty: one frame of filling. Equal texts give equal bytes, repeated
rows and null ids rows of their own. A very long text is a slab of its own. Empty
tables give empty ones; extra columns, whatever their names, are ignored.
Subframes with wasted bits, several channels or other sample sizes are not
written, and are refused when read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw_texts

BLOCK = 576
RATE = 8000
SEEK_FRAMES = 16
#: Frames worked on together: 1.2 MB of samples.
SLAB = 2048
PARTITION_ORDER = 2
LPC_ORDER = 4
_MAX_RICE = 12
#: Coefficients of the format's fixed predictors of order 0 to 4.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        table.append(crc)
    return np.array(table, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(_CRC8[crc ^ b])
    return crc


def _crc16_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for many spans at once; leading zeros leave a CRC that starts at 0 as it is."""
    longest = int((end - start).max(initial=0))
    at = end[None, :] - longest + np.arange(longest)[:, None]
    rows = np.where(at >= start[None, :], data[np.maximum(at, 0)], 0)
    crc = np.zeros(len(start), np.int64)
    for row in rows:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ row]
    return crc


@lru_cache(maxsize=1 << 16)
def frame_header(number: int) -> bytes:
    """Sync, fixed block size 576, 8 kHz, mono, 8 bits, the coded frame number, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        lead = (0xFF << (8 - n)) & 0xFF
        coded = bytes([lead | number >> (6 * (n - 1)), *(0x80 | (number >> (6 * j)) & 0x3F for j in range(n - 2, -1, -1))])
    head = b"\xff\xf8\x24\x02" + coded
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (values >> (width - 1 - j)) & 1


def _linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (8 bits) and shifts of each row, by Levinson-Durbin over its autocorrelation."""
    f = x.astype(np.float64)
    n = f.shape[1]
    r = np.stack([(f[:, : n - lag] * f[:, lag:]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1)
    a = np.zeros((len(x), LPC_ORDER))
    err = np.maximum(r[:, 0], 1e-9)
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(6 - np.ceil(np.log2(most)).astype(np.int64), 0, 14)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -128, 127).astype(np.int64), shift


def encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """The frames of sample rows ``x`` (frames x 576, int), as bytes."""
    f = len(x)
    x = x.astype(np.int32)
    diffs = [x]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    cost = np.stack([np.abs(d[:, LPC_ORDER - o :]).sum(axis=1, dtype=np.int64) for o, d in enumerate(diffs)], axis=1)
    q, shift = _linear_predictors(x)
    predicted = sum(q[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    lpc_rest = x[:, LPC_ORDER:] - predicted
    lpc_cost = np.abs(lpc_rest).sum(axis=1) + 2 * BLOCK // 16
    order = cost.argmin(axis=1)
    lpc = lpc_cost < cost.min(axis=1)
    order[lpc] = LPC_ORDER
    rest = np.zeros((f, BLOCK), np.int32)
    for o in range(5):
        at = (order == o) & ~lpc
        rest[at, o:] = diffs[o][at]
    rest[lpc, LPC_ORDER:] = lpc_rest[lpc]
    u = (rest << 1) ^ (rest >> 31)
    parts = 1 << PARTITION_ORDER
    size = BLOCK // parts
    n = np.full((f, parts), size)
    n[:, 0] -= order
    grouped = u.reshape(f, parts, size)
    guess = np.log2(grouped.mean(axis=2) * 0.7 + 1).astype(np.int64)  # the best parameter is one of three around it
    tried = np.clip(np.stack([guess - 1, guess, guess + 1], axis=2), 0, _MAX_RICE)
    by_k = np.stack([(grouped >> tried[:, :, j : j + 1].astype(np.int32)).sum(axis=2, dtype=np.int64) + n * (tried[:, :, j] + 1) for j in range(3)], axis=2)
    k = np.take_along_axis(tried, by_k.argmin(axis=2)[:, :, None], axis=2)[:, :, 0]
    rice_bits = by_k.min(axis=2).sum(axis=1) + 4 * parts
    length = 8 + 8 * order + np.where(lpc, 9 + 8 * LPC_ORDER, 0) + 6 + rice_bits
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (length >= 8 + 8 * BLOCK)
    coded = ~constant & ~verbatim
    length = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, length))
    n_bytes = (length + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    bits = np.zeros(int(n_bytes.sum()) * 8, np.uint8)
    at = base * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + LPC_ORDER - 1, 8 + order)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    byte = (x & 0xFF).astype(np.int64)
    _put(bits, at[constant], byte[constant, 0], 8)
    _put(bits, (at[verbatim, None] + 8 * np.arange(BLOCK)).ravel(), byte[verbatim].ravel(), 8)
    for j in range(LPC_ORDER):
        warm = coded & (order > j)
        _put(bits, at[warm] + 8 * j, byte[warm, j], 8)
    at = at + 8 * order
    lpc &= coded
    _put(bits, at[lpc], np.full(int(lpc.sum()), 7), 4)
    _put(bits, at[lpc] + 4, shift[lpc], 5)
    for j in range(LPC_ORDER):
        _put(bits, at[lpc] + 9 + 8 * j, q[lpc, j] & 0xFF, 8)
    at = at + np.where(lpc, 9 + 8 * LPC_ORDER, 0)
    _put(bits, at[coded], np.full(int(coded.sum()), PARTITION_ORDER), 6)
    at = (at + 6)[coded]
    u, k, order = u[coded], k[coded], order[coded]
    k_each = np.repeat(k, size, axis=1)
    high = u >> k_each
    width = high + 1 + k_each
    valid = np.arange(BLOCK)[None, :] >= order[:, None]
    width[~valid] = 0
    lead = np.zeros((1, BLOCK), np.int64)
    lead[0, ::size] = 4
    start = at[:, None] + np.cumsum(width + lead, axis=1) - width
    _put(bits, (start[:, ::size] - 4).ravel(), k.ravel(), 4)
    start, high, k_each, u = start[valid], high[valid], k_each[valid], u[valid]
    stop = start + high
    bits[stop] = 1
    end = stop + k_each
    for j in range(int(k_each.max(initial=0))):
        one = (k_each > j) & ((u >> j) & 1 == 1)
        bits[end[one] - j] = 1
    packed = np.packbits(bits)
    heads = [frame_header(i) for i in numbers]
    raw = packed.tobytes()
    bodies = [h + raw[a : a + m] for h, a, m in zip(heads, base.tolist(), n_bytes.tolist(), strict=True)]
    whole = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64)
    ends = np.cumsum([len(b) for b in bodies])
    crc = _crc16_rows(whole, ends - np.array([len(b) for b in bodies]), ends)
    return [b + struct.pack(">H", c) for b, c in zip(bodies, crc.tolist(), strict=True)]


def payload(raw: bytes | None) -> bytes:
    raw = raw or b""
    n = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return raw + b"\xff" * (n - len(raw))


def _stream(data: bytes, frames: list[bytes]) -> bytes:
    """A FLAC stream: marker, STREAMINFO, seek table, frames."""
    samples = np.frombuffer(data, np.uint8) ^ 0x80
    sizes = [len(x) for x in frames]
    n = len(data)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    offsets = np.cumsum([0, *sizes[:-1]])
    seek = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, len(frames), SEEK_FRAMES))
    head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
    return head + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The FLAC streams of several payloads, their frames worked on together."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    jobs = [(p, i) for p, data in enumerate(payloads) for i in range(0, len(data) // BLOCK, SLAB)]
    held: list[tuple[int, int, int]] = []

    def flush() -> None:
        if held:
            x = np.concatenate([np.frombuffer(payloads[p], np.uint8, m * BLOCK, i * BLOCK) for p, i, m in held])
            x = x.reshape(-1, BLOCK).astype(np.int32) - 128
            done = iter(encode_frames(x, [j for _, i, m in held for j in range(i, i + m)]))
            for p, _, m in held:
                frames[p].extend(next(done) for _ in range(m))
            held.clear()

    for p, i in jobs:
        m = min(SLAB, len(payloads[p]) // BLOCK - i)
        if sum(x[2] for x in held) + m > SLAB:
            flush()
        held.append((p, i, m))
    flush()
    return [_stream(data, f) for data, f in zip(payloads, frames, strict=True)]


def parse_stream(media: bytes) -> dict:
    """STREAMINFO, seek points and the place of the first frame; raises if it isn't such a stream."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, out = 4, False, {"seek": []}
    while not last:
        kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        last, body = bool(media[at] & 0x80), media[at + 4 : at + 4 + size]
        if kind == 0:
            rest = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">HH", body[:4]), "channels": (rest >> 41 & 7) + 1, "bits": (rest >> 36 & 31) + 1, "samples": rest & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack(">QQH", body[j : j + 18]) for j in range(0, size, 18)]
        at += 4 + size
    if out.get("block") != (BLOCK, BLOCK) or out["channels"] != 1 or out["bits"] != 8:
        raise ValueError("only mono 8-bit streams with blocks of 576 are read")
    return out | {"first": at}


def frame_spans(media: bytes, first: int, samples: int, careful: bool = False) -> list[tuple[int, int]]:
    """Where each frame begins and ends: headers, with their CRC-8, in the order of their numbers.

    ``careful`` also holds each frame against its CRC-16 at once, and so passes
    over a header's bytes inside a frame.
    """
    spans, at, n = [], first, samples // BLOCK
    for i in range(n):
        if not media.startswith(frame_header(i), at):
            raise ValueError(f"frame {i}: no header with a right CRC-8")
        end = media.find(frame_header(i + 1), at + 8) if i + 1 < n else len(media)
        while careful and 0 <= end < len(media) and _crc16_rows(np.frombuffer(media, np.uint8, end - at, at), np.array([0]), np.array([end - at]))[0]:
            end = media.find(frame_header(i + 1), end + 1)
        if end < 0:
            raise ValueError(f"frame {i}: no frame behind it")
        spans.append((at, end))
        at = end
    return spans


class _Bits:
    """Bits of a byte array, read at many places at once."""

    def __init__(self, data: np.ndarray):
        d = np.r_[data, np.zeros(8, np.uint8)].astype(np.int64)
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
        ones = np.unpackbits(np.r_[data, np.uint8(255)])
        place = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(len(ones)))
        self.next_one = np.minimum.accumulate(place[::-1])[::-1]

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """``width`` (at most 24) bits at each place."""
        return (self.words[at >> 3] >> (32 - (at & 7) - width)) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.read(at, width)
        return np.where(v >> (width - 1), v - (1 << width), v)


def decode_frames(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames x 576) and subframe kinds of subframe bytes (without header and CRC-16)."""
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    bits = _Bits(data)
    at = (np.cumsum(sizes) - sizes) * 8
    head = bits.read(at, 8)
    kind = head >> 1
    if (head & 0x81).any():
        raise ValueError("padding or wasted bits in a subframe header")
    at = at + 8
    x = np.zeros((len(bodies), BLOCK), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("reserved subframe type")
    x[constant] = bits.signed(at[constant], 8)[:, None]
    if verbatim.any():
        x[verbatim] = bits.signed((at[verbatim, None] + 8 * np.arange(BLOCK)), 8)
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        x[rows] = _decode_predicted(bits, at[rows], np.where(lpc[rows], kind[rows] - 31, kind[rows] - 8), lpc[rows])
    return x, kind


def _decode_predicted(bits: _Bits, at: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> np.ndarray:
    most = int(order.max(initial=1)) or 1
    x = np.zeros((most + BLOCK, len(at)), np.int64)  # a column a frame, ``most`` zeros in front
    for j in range(most):
        warm = np.flatnonzero(order > j)
        x[most + j, warm] = bits.signed(at[warm] + 8 * j, 8)
    at = at + 8 * order
    coef, shift = np.zeros((len(at), most), np.int64), np.zeros(len(at), np.int64)
    width = min(4, most)
    plain = np.flatnonzero(~lpc)
    coef[plain, :width] = FIXED[order[plain]][:, :width]
    for row in [np.flatnonzero(lpc & (order == o)) for o in np.unique(order[lpc])]:
        precision = bits.read(at[row], 4) + 1
        shift[row] = bits.read(at[row] + 4, 5)
        for j in range(int(order[row[0]])):
            v = bits.read(at[row] + 9 + precision * j, precision)
            coef[row, j] = np.where(v >> (precision - 1), v - (1 << precision), v)
        at[row] += 9 + precision * order[row]
    method = bits.read(at, 2)
    parts = 1 << bits.read(at + 2, 4)
    if (method > 1).any() or (shift > 15).any() or (BLOCK % parts).any():
        raise ValueError("reserved residual coding or negative shift")
    at = at + 6
    wide = 4 + method
    size = BLOCK // parts
    k = np.zeros(len(at), np.int64)
    raw, width_of = np.zeros(len(at), bool), np.zeros(len(at), np.int64)

    def residuals(row: np.ndarray | slice, own: np.ndarray) -> np.ndarray:
        """The next residual of the frames ``row``, which moves their places ``at`` on."""
        k_own, start = k[row], at[row].copy()
        stop = bits.next_one[start].astype(np.int64)
        v = (stop - start) << k_own | bits.read(stop + 1, k_own)
        found, behind = v >> 1 ^ -(v & 1), stop + 1 + k_own
        if raw.any() and (plain := np.flatnonzero(raw[row])).size:
            w = width_of[own[plain]]
            value = bits.read(start[plain], w)
            found[plain] = np.where((w > 0) & (value >> np.maximum(w - 1, 0) > 0), value - (1 << w), value)
            behind[plain] = start[plain] + w
        at[row] = behind
        return found

    every = np.arange(len(at))
    coef, deepest = np.ascontiguousarray(coef.T), [j for j in range(most) if coef[:, j].any()]
    edges = {i for s in np.unique(size).tolist() for i in range(0, BLOCK, s)}
    for i in range(BLOCK):
        if i in edges:
            opens = np.flatnonzero(i % size == 0)
            k[opens] = bits.read(at[opens], wide[opens])
            at[opens] += wide[opens]
            raw[opens] = k[opens] == (1 << wide[opens]) - 1
            if (escaped := opens[raw[opens]]).size:  # residuals of such a partition are plain numbers of the width that follows
                k[escaped], width_of[escaped] = 0, bits.read(at[escaped], 5)
                at[escaped] += 5
        if i >= most:
            found = residuals(slice(None), every)
            x[most + i] = found + (sum((coef[j] * x[most + i - 1 - j] for j in deepest), np.zeros_like(found)) >> shift)
        elif len(row := np.flatnonzero(order <= i)):
            found = residuals(row, row)
            x[most + i, row] = found + (sum((coef[j, row] * x[most + i - 1 - j, row] for j in deepest), np.zeros_like(found)) >> shift[row])
    return x[most:].T


class _WrongFrame(ValueError):
    pass


def decode(streams: list[bytes], careful: bool = False) -> list[tuple[bytes, list[tuple[int, int]], list[int]]]:
    """Of each stream: its payload, its frames' spans, its subframe kinds; all checksums verified."""
    infos = [parse_stream(m) for m in streams]
    spans = [frame_spans(m, i["first"], i["samples"], careful) for m, i in zip(streams, infos, strict=True)]
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    kinds: list[list[int]] = [[] for _ in streams]
    held: list[tuple[int, int, int, int]] = []

    def flush() -> None:
        if not held:
            return
        frames = [streams[s][a:b] for s, _, a, b in held]
        ends = np.cumsum([len(x) for x in frames])
        whole = np.frombuffer(b"".join(frames), np.uint8).astype(np.int64)
        if (wrong := np.flatnonzero(_crc16_rows(whole, ends - np.array([len(x) for x in frames]), ends))).size:
            raise _WrongFrame(f"frame {held[wrong[0]][1]}: wrong CRC-16")
        x, kind = decode_frames([x[len(frame_header(i)) : -2] for x, (_, i, _, _) in zip(frames, held, strict=True)])
        if np.abs(x).max(initial=0) > 128:
            raise ValueError("a sample beyond 8 bits")
        x = (x + 128).astype(np.uint8)
        for row, (s, *_), t in zip(x, held, kind.tolist(), strict=True):
            parts[s].append(row)
            kinds[s].append(t)
        held.clear()

    try:
        for s, own in enumerate(spans):
            for i, (a, b) in enumerate(own):
                held.append((s, i, a, b))
                if len(held) == SLAB:
                    flush()
        flush()
    except _WrongFrame:
        if careful:
            raise
        return decode(streams, careful=True)
    out = []
    for p, info, own, t in zip(parts, infos, spans, kinds, strict=True):
        data = np.concatenate(p).tobytes()
        if len(data) != info["samples"] or hashlib.md5((np.frombuffer(data, np.uint8) ^ 0x80).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples' MD5 is not that of STREAMINFO")
        out.append((data, own, t))
    return out


def _slabs(values: Iterator, size) -> Iterator[list]:
    """Lists of consecutive values of about one slab of samples."""
    held, total = [], 0
    for value in values:
        held.append(value)
        total += size(value)
        if total >= SLAB * BLOCK:
            yield held
            held, total = [], 0
    if held:
        yield held


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text's payload as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True)
            for held in _slabs(rows, lambda r: len(r[1] or b"") + BLOCK):
                media = encode([payload(t) for _, t in held])
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([len(t or b"") for _, t in held], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _feature(data: bytes, kinds: list[int]) -> str:
    """Whole-number features of the samples: sum, energy, sign changes, peak, and subframes by kind."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    signs = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))
    count = [sum(t == 0 for t in kinds), sum(t == 1 for t in kinds), sum(8 <= t < 32 for t in kinds), sum(t >= 32 for t in kinds)]
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={signs};peak={int(np.abs(x).max())};subframes={'/'.join(map(str, count))}"


def _seek_points(media: bytes, spans: list[tuple[int, int]]) -> int:
    """The number of points of a stream's seek table; raises if one does not lead to the block of its sample."""
    info = parse_stream(media)
    for sample, offset, *_ in info["seek"]:
        if sample % BLOCK or sample // BLOCK >= len(spans) or spans[sample // BLOCK][0] != info["first"] + offset:
            raise ValueError(f"the seek point of sample {sample} leads to no block")
    return len(info["seek"])


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of streams ``(doc_id, n_bytes, media)``, from their decoded samples.

    ``blocks`` is the number of PCM blocks, ``seek_points`` that of the stream's seek
    table, each of which must lead to the block of its sample, and ``last_block_at``
    the byte offset of the last block.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks long, seek_points long, last_block_at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (m.as_py() for m in batch.column(2)), strict=True)
            for held in _slabs(rows, lambda r: len(r[2])):
                out = []
                for (doc, n, media), (data, spans, kinds) in zip(held, decode([r[2] for r in held]), strict=True):
                    points = _seek_points(media, spans)
                    out.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), _feature(data, kinds), len(spans), points, spans[-1][0]))
                kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """``(doc_id, block, first_sample, byte_offset, n_samples, pcm)``: decoded blocks with their offsets in samples and in the stream."""
    schema = "doc_id long, block long, first_sample long, byte_offset long, n_samples long, pcm binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), (m.as_py() for m in batch.column(1)), strict=True)
            for held in _slabs(rows, lambda r: len(r[1])):
                for (doc, _), (data, spans, _) in zip(held, decode([r[1] for r in held]), strict=True):
                    out = [(doc, i, i * BLOCK, a, BLOCK, (np.frombuffer(data, np.uint8, BLOCK, i * BLOCK) ^ 0x80).tobytes()) for i, (a, _) in enumerate(spans)]
                    kinds = (*[pa.int64()] * 5, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return stored.select("doc_id", "media").mapInArrow(run, schema)


def seek(media: bytes, sample: int) -> tuple[int, int]:
    """The seek point at or before ``sample``: its first sample and its byte offset in the stream."""
    info = parse_stream(media)
    point = max((p for p in info["seek"] if p[0] <= sample), default=(0, 0, 0))
    return point[0], info["first"] + point[1]
