"""Media columns: lossless FLAC streams of 8-bit mono samples.

Encoding writes STREAMINFO (with the MD5 of the samples), a seek table with one
point per frame, and frames of ``BLOCK`` samples whose subframes are constant,
verbatim, fixed-predictor or linear-predictor (LPC), whichever is shorter, with
Rice-coded residuals. Decoding checks CRC-8 of each header, CRC-16 of each frame
and the MD5, and gives PCM blocks with their sample offsets.

Residuals of many frames are decoded side by side: one NumPy step reads the next
Rice code of every frame that still has one, and one more adds the linear
prediction, so the Python cost is per step, not per sample. Frames of any other
layout (several Rice partitions, escape codes, streams without a seek table) go
through a plain bit reader.

A text becomes its UTF-8 bytes, padded with zero bytes to a positive multiple of
64; a byte is a sample less 128. Null text is the empty text. Equal texts, and so
repeated rows, give equal streams; an empty table gives no rows; other columns are
left alone. A stream that is cut off or otherwise corrupt gives null PCM and says
why in ``error``; one whose samples have another MD5 than it claims gives them
with ``md5_ok`` false. A null stream gives null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

BLOCK = 4096
RATE = 8000
PAD = 64
#: Frames decoded side by side; bounds a worker's memory.
LANES = 256
#: Order of the linear predictor that is tried beside the fixed ones.
LPC_ORDER = 4
#: Streams are decoded together up to this many bytes of PCM; a longer one goes alone.
TOGETHER = 16 << 20
BLOCKS = ArrayType(StructType([StructField("sample_offset", LongType()), StructField("byte_offset", LongType()), StructField("samples", IntegerType())]))
DECODED = StructType([StructField("pcm", BinaryType()), StructField("blocks", BLOCKS), StructField("md5_ok", BooleanType()), StructField("feature", StringType()), StructField("error", StringType())])
_FRAME_MAX = BLOCK + 64


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD if raw else PAD)


@lru_cache(maxsize=2)
def _crc_table(width: int, poly: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        v = b << (width - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return out


def crc8(data: bytes) -> int:
    table, v = _crc_table(8, 0x07), 0
    for b in data:
        v = table[v ^ b]
    return v


@lru_cache(maxsize=1)
def _crc16_by_distance() -> np.ndarray:
    """CRC-16 of a byte by its distance from the end; with start value 0 the parts just add up (xor)."""
    table = np.array(_crc_table(16, 0x8005), np.uint16)
    out = np.empty((_FRAME_MAX, 256), np.uint16)
    out[0] = table
    for d in range(1, _FRAME_MAX):
        out[d] = (out[d - 1] << 8) ^ table[out[d - 1] >> 8]
    return out


def crc16(data: bytes) -> int:
    if len(data) > _FRAME_MAX:
        table, v = _crc_table(16, 0x8005), 0
        for b in data:
            v = (v << 8 & 0xFFFF) ^ table[v >> 8 ^ b]
        return v
    at = np.arange(len(data) - 1, -1, -1, dtype=np.int32) << 8
    return int(np.bitwise_xor.reduce(_crc16_by_distance().ravel()[at + np.frombuffer(data, np.uint8)])) if data else 0


def _coded_number(n: int) -> bytes:
    """Frame number in the UTF-8-like form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF | n
    return bytes([lead, *reversed(tail)])


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (np.asarray(values).reshape(-1, 1) >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()


def _rice(residual: np.ndarray) -> tuple[int, np.ndarray]:
    """Parameter and bits of the shortest Rice code."""
    u = (residual << 1) ^ (residual >> 31)
    guess = int(np.log2(max(float(u.mean()), 1.0)))
    k = min(range(max(guess - 1, 0), min(guess + 2, 14) + 1), key=lambda k: int((u >> k).sum()) + (k + 1) * len(u))
    ends = np.cumsum((u >> k) + (k + 1))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1 - k] = 1
    for j in range(k):
        out[ends - 1 - j] = u >> j & 1
    return k, out


def _lpc(samples: np.ndarray, order: int, precision: int = 10) -> tuple[np.ndarray, int] | None:
    """Quantised coefficients by autocorrelation, and their shift."""
    if len(samples) <= 2 * order:
        return None
    x = samples.astype(float)
    r = np.array([x[k:] @ x[: len(x) - k] for k in range(order + 1)])
    lag = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    c = np.linalg.solve(r[lag] + np.eye(order) * (1e-9 * r[0] + 1e-9), r[1:])
    shift = int(np.clip(precision - 2 - np.ceil(np.log2(max(np.abs(c).max(), 1e-9))), 0, 15))
    return np.clip(np.rint(c * (1 << shift)), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64), shift


def _rice_bits(residual: np.ndarray) -> int:
    """Length of the Rice code with the parameter that the mean suggests."""
    u = (residual << 1) ^ (residual >> 31)
    k = min(int(np.log2(max(float(u.mean()), 1.0))), 14)
    return int((u >> k).sum()) + (k + 1) * len(u)


def _subframe(samples: np.ndarray, lpc_order: int) -> bytes:
    n = len(samples)
    if (samples == samples[0]).all():
        return bytes([0, samples[0] & 0xFF])
    best, d, order = None, samples, 0
    for o in range(min(5, n)):
        d = samples if o == 0 else np.diff(d)
        cost = int(np.abs(d[4 - o :] if n > 8 else d).sum())
        if best is None or cost < best:
            best, order, residual = cost, o, d
    head, extra = 0x10 | order << 1, np.empty(0, np.uint8)
    if lpc_order and (found := _lpc(samples, lpc_order)):
        c, shift = found
        x = np.convolve(samples, c)[lpc_order - 1 : n - 1] >> shift
        predicted = (samples[lpc_order:] - x).astype(np.int32)
        if _rice_bits(predicted) + 9 + 18 * lpc_order < _rice_bits(residual) + 8 * order:
            head, order, residual = 0x40 | (lpc_order - 1) << 1, lpc_order, predicted
            extra = np.concatenate([_bits([9], 4), _bits([shift], 5), _bits(c & 0x3FF, 10)])
    k, coded = _rice(residual)
    bits = np.concatenate([_bits(samples[:order] & 0xFF, 8), extra, _bits([k], 10), coded])  # method 0, partition order 0, parameter
    if len(bits) >= 8 * n:
        return bytes([2]) + (samples & 0xFF).astype(np.uint8).tobytes()
    return bytes([head]) + np.packbits(bits).tobytes()


def encode(pcm: bytes, lpc_order: int = LPC_ORDER, rate: int = RATE) -> bytes:
    """FLAC stream of unsigned 8-bit mono samples."""
    samples = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    frames, points, at = [], [], 0
    for number, start in enumerate(range(0, len(samples), BLOCK)):
        part = samples[start : start + BLOCK]
        full = len(part) == BLOCK
        head = bytes([0xFF, 0xF8, 0xC0 if full else 0x70, 0x02]) + _coded_number(number) + (b"" if full else (len(part) - 1).to_bytes(2, "big"))
        frame = head + bytes([crc8(head)]) + _subframe(part, lpc_order)
        frame += crc16(frame).to_bytes(2, "big")
        points.append(start.to_bytes(8, "big") + at.to_bytes(8, "big") + len(part).to_bytes(2, "big"))
        frames.append(frame)
        at += len(frame)
    sizes = [len(f) for f in frames] or [0]
    packed = rate << 44 | 0 << 41 | 7 << 36 | len(samples)
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples.astype(np.int8).tobytes()).digest()
    table = b"".join(points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(frames)


class Reader:
    """Plain bit reader over a byte string."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        first, last = self.at >> 3, self.at + n + 7 >> 3
        if last > len(self.data):
            raise ValueError("the stream ends within a frame")
        v = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return v & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def parse_stream(data: bytes) -> dict:
    """Metadata of a stream: sizes, MD5, seek points and where frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, out = 4, False, {"points": []}
    while not last:
        if at + 4 > len(data):
            raise ValueError("the stream ends within its metadata")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the stream ends within its metadata")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            rows = [body[i : i + 18] for i in range(0, size, 18)]
            out["points"] = [(int.from_bytes(r[:8], "big"), int.from_bytes(r[8:16], "big"), int.from_bytes(r[16:], "big")) for r in rows]
        at += 4 + size
    if "channels" not in out:
        raise ValueError("no STREAMINFO")
    if out["channels"] != 1 or out["bits"] != 8:
        raise ValueError("only 8-bit mono streams are supported")
    return out | {"begin": at}


def frame_header(data: bytes, at: int) -> tuple[int, int]:
    """``(block size, first byte of the subframe)``; checks sync code and CRC-8."""
    if at + 16 > len(data) and len(data) - at < 8:
        raise ValueError("the stream ends within a frame header")
    if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError("no frame")
    code, p = data[at + 2] >> 4, at + 4
    lead, p = data[p], p + 1
    while lead & 0xC0 == 0xC0:
        lead, p = lead << 1 & 0xFF, p + 1
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("wrong CRC-8 of a frame header")
    return n, p + 1


def decode_frame(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Samples of one frame of any layout, and the position after it."""
    n, p = frame_header(data, at)
    bits = Reader(data, p)
    kind = bits.read(8) >> 1
    if kind == 0:
        out = [bits.signed(8)] * n
    elif kind == 1:
        out = [bits.signed(8) for _ in range(n)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        out = [bits.signed(8) for _ in range(order)]
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            c = [bits.signed(precision) for _ in range(order)]
        else:
            shift, c = 0, ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order]
        wide, parts = 4 + bits.read(2), 1 << bits.read(4)
        for part in range(parts):
            k = bits.read(wide)
            raw = bits.read(5) if k == (1 << wide) - 1 else None
            for _ in range(n // parts - (order if part == 0 else 0)):
                if raw is None:
                    u = bits.unary() << k | bits.read(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(raw)
                out.append(r + (sum(a * out[-1 - i] for i, a in enumerate(c)) >> shift))
    end = bits.at + 7 >> 3
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("wrong CRC-16 of a frame")
    return np.array(out, np.int32), end + 2


def _layout(data: bytes, p: int) -> tuple[int, list[int], int, int, int] | None:
    """``(order, coefficients, shift, Rice parameter, first bit of the residual)`` of a subframe with one Rice partition; fixed predictors have no coefficients."""
    bits = Reader(data, p)
    kind = bits.read(8) >> 1
    order, c, shift = (kind - 31, [], 0) if kind >= 32 else (kind - 8, [], 0)
    bits.at += 8 * order
    if kind >= 32:
        precision, shift = bits.read(4) + 1, bits.signed(5)
        c = [bits.signed(precision) for _ in range(order)]
    one, k = bits.read(6) == 0, bits.read(4)
    return (order, c, shift, k, bits.at - 8 * p) if one and k < 15 and shift >= 0 else None


def _predicted(residual: np.ndarray, sizes: np.ndarray, warm: np.ndarray, c: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Samples of lanes with linear predictors of one order; lanes stand in order of falling size."""
    order, longest = warm.shape[0], int(sizes.max())
    x = np.zeros((order + longest, warm.shape[1]), np.int64)
    x[:order] = warm
    back = c[::-1]  # the coefficient of the oldest sample first
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for t in range(longest):
        a = active[t]
        x[order + t, :a] = residual[t, :a] + ((back[:, :a] * x[t : t + order, :a]).sum(0) >> shifts[:a])
    return x


def _side_by_side(frames: list[tuple[bytes, int, int, int, tuple]]) -> list[np.ndarray]:
    """Samples of frames ``(data, subframe position, end, block size, layout)`` with one Rice partition."""
    order = sorted(range(len(frames)), key=lambda i: frames[i][4][0] - frames[i][3])  # most residuals first
    raw, begin, k, n, at = [], [], [], [], 0
    for i in order:
        data, p, end, size, (o, _, _, rice, skip) = frames[i]
        raw.append(data[p:end])
        begin.append(at * 8 + skip)
        k.append(rice)
        n.append(size - o)
        at += end - p
    bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8))
    places = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    following = np.minimum.accumulate(places[::-1])[::-1]  # position of the next 1
    k_, n_, pos = np.array(k, np.int32), np.array(n), np.array(begin, np.int32)
    longest = int(n_.max())
    first = np.zeros((longest, len(order)), np.int32)
    stop = np.zeros((longest, len(order)), np.int32)
    active = np.searchsorted(-n_, -np.arange(longest), side="left")
    step, limit = k_ + 1, np.int32(len(bits) - 1)
    for i in range(longest):
        a = active[i]
        first[i, :a] = pos[:a]
        s = following[np.minimum(pos[:a], limit)]
        stop[i, :a] = s
        pos[:a] = s + step[:a]
    u = stop - first
    np.minimum(stop, limit, out=stop)
    for j in range(int(k_.max()) if len(k_) else 0):
        u = np.where(j < k_, u << 1 | bits[np.minimum(stop + (1 + j), limit)], u)
    residual = (u >> 1) ^ -(u & 1)
    out: list = [None] * len(frames)
    linear: dict[int, list[int]] = {}
    for lane, i in enumerate(order):
        data, p, _, _, (o, c, *_) = frames[i]
        if c:
            linear.setdefault(o, []).append(lane)
            continue
        x = residual[: n_[lane], lane]
        warm = np.frombuffer(data[p + 1 : p + 1 + o], np.int8).astype(np.int32)
        for level in range(o - 1, -1, -1):
            x = np.cumsum(np.concatenate([np.diff(warm, n=level)[:1], x]), dtype=np.int32)
        out[i] = x
    for o, lanes in linear.items():
        own = [frames[order[lane]] for lane in lanes]
        warm = np.array([np.frombuffer(f[0][f[1] + 1 : f[1] + 1 + o], np.int8) for f in own], np.int64).T
        x = _predicted(residual[:, lanes], n_[lanes], warm, np.array([f[4][1] for f in own]).T, np.array([f[4][2] for f in own]))
        for column, lane in enumerate(lanes):
            out[order[lane]] = x[: o + n_[lane], column].astype(np.int32)
    return out


def decode_streams(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]], bool]]:
    """Of each stream: PCM (unsigned), blocks ``(sample offset, byte offset, samples)``, and whether the MD5 holds."""
    infos = [parse_stream(s) for s in streams]
    parts: list[list] = [[] for _ in streams]
    blocks: list[list] = [[] for _ in streams]
    waiting: list[tuple[int, int, tuple]] = []

    def settle():
        for (w, slot, _), x in zip(waiting, _side_by_side([f for *_, f in waiting]) if waiting else [], strict=True):
            parts[w][slot] = x
        waiting.clear()

    for w, (data, info) in enumerate(zip(streams, infos, strict=True)):
        offsets = [info["begin"] + p[1] for p in info["points"]]
        if not offsets or sum(p[2] for p in info["points"]) != info["samples"]:
            at, offset = info["begin"], 0
            while at < len(data):
                x, end = decode_frame(data, at)
                parts[w].append(x)
                blocks[w].append((offset, at, len(x)))
                at, offset = end, offset + len(x)
            continue
        for (sample, _, _), at, end in zip(info["points"], offsets, [*offsets[1:], len(data)], strict=True):
            n, p = frame_header(data, at)
            if crc16(data[at : end - 2]) != int.from_bytes(data[end - 2 : end], "big"):
                raise ValueError("wrong CRC-16 of a frame")
            blocks[w].append((sample, at, n))
            kind = data[p] >> 1
            if kind == 0:
                x = np.full(n, int.from_bytes(data[p + 1 : p + 2], "big", signed=True), np.int32)
            elif kind == 1:
                x = np.frombuffer(data[p + 1 : p + 1 + n], np.int8).astype(np.int32)
            elif (8 <= kind <= 12 or kind >= 32) and (layout := _layout(data, p)):
                x = None
                waiting.append((w, len(parts[w]), (data, p, end - 2, n, layout)))
            else:
                x = decode_frame(data, at)[0]
            parts[w].append(x)
            if len(waiting) >= LANES:
                settle()
    settle()
    out = []
    for info, got, index in zip(infos, parts, blocks, strict=True):
        signed = (np.concatenate(got) if got else np.empty(0, np.int32)).astype(np.int8)
        if info["samples"] and len(signed) != info["samples"]:
            raise ValueError("the stream holds another number of samples than it says")
        out.append(((signed.view(np.uint8) ^ 0x80).tobytes(), index, hashlib.md5(signed.tobytes()).digest() == info["md5"]))
    return out


def read_samples(data: bytes, start: int, count: int) -> bytes:
    """PCM of ``count`` samples from ``start``; frames are decoded from the last seek point at or before it, or from the first frame."""
    info, out = parse_stream(data), []
    base, at = max(((s, o) for s, o, _ in info["points"] if s <= start), default=(0, 0))
    at, upto = at + info["begin"], base
    while at < len(data) and upto < start + count:
        samples, at = decode_frame(data, at)
        upto += len(samples)
        out.append(samples)
    pcm = (np.concatenate(out) + 128).astype(np.uint8).tobytes() if out else b""
    return pcm[start - base : start - base + count]


def feature_of(pcm: bytes) -> str:
    """Root mean square, zero-crossing share, lag-1 correlation and peak of the samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.float32) - 128
    if not len(x):
        return "rms=0;zcr=0;lag1=0;peak=0"
    energy = float(np.dot(x, x)) or 1.0
    crossings = np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1]))
    return f"rms={(energy / len(x)) ** 0.5:.2f};zcr={crossings / len(x):.4f};lag1={float(np.dot(x[1:], x[:-1])) / energy:.4f};peak={int(np.abs(x).max())}"


def flac_of_text(text: Column, lpc_order: int = LPC_ORDER) -> Column:
    """Binary column: the FLAC stream of each whole text's payload."""

    @F.arrow_udf(BinaryType())
    def flac_stream(texts):
        import pyarrow as pa

        return pa.array([encode(payload(t), lpc_order) for t in texts.to_pylist()], pa.binary())

    # not deterministic for the optimiser: it must not run the encoder again for each use of the stream
    return flac_stream.asNondeterministic()(text)


def _decoded_rows(streams: list[bytes | None]) -> list[tuple | None]:
    """Of each stream ``(PCM, blocks, MD5 holds, error)``; streams are decoded together until they hold ``TOGETHER`` bytes."""
    out: list[tuple | None] = [None] * len(streams)
    held: list[int] = []

    def settle():
        try:
            for i, found in zip(held, decode_streams([streams[i] for i in held]), strict=True):
                out[i] = (*found, None)
        except (ValueError, IndexError):  # some stream is corrupt: take them one by one
            for i in held:
                try:
                    out[i] = (*decode_streams([streams[i]])[0], None)
                except (ValueError, IndexError) as e:
                    out[i] = (None, [], False, str(e))
        held.clear()

    size = 0
    for i, stream in enumerate(streams):
        if stream is not None:
            held.append(i)
            size += len(stream)
            if size > TOGETHER:
                settle()
                size = 0
    settle()
    return out


def decoded(stream: Column) -> Column:
    """Struct column with PCM, block index, MD5 check, feature and error of each stream; null streams give null."""

    @F.arrow_udf(DECODED)
    def flac_decoded(streams):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for row in _decoded_rows(streams.to_pylist()):
            if row is None:
                out.append(None)
                continue
            pcm, index, ok, error = row
            blocks = [{"sample_offset": s, "byte_offset": b, "samples": n} for s, b, n in index]
            out.append({"pcm": pcm, "blocks": blocks, "md5_ok": ok, "feature": None if pcm is None else feature_of(pcm), "error": error})
        return pa.array(out, to_arrow_type(DECODED))

    return flac_decoded.asNondeterministic()(stream)


def pcm_blocks(df: DataFrame, stream_col: str, id_col: str = "doc_id") -> DataFrame:
    """One row per PCM block: id, ``sample_offset``, ``samples`` and the block's ``pcm``."""
    whole = df.select(F.col(id_col), decoded(F.col(stream_col)).alias("d"))
    return whole.select(id_col, F.col("d.pcm").alias("p"), F.explode("d.blocks").alias("b")).select(
        id_col, "b.sample_offset", "b.samples", F.expr("substring(p, cast(b.sample_offset + 1 as int), b.samples)").alias("pcm")
    )
