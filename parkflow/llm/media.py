"""Texts kept as silent motion-JPEG video in AVI files, read back and cut into shots.

The samples are the bytes of the payload, eight bits each, in grey frames 64 samples wide. Frames are lossless JPEG
(ITU-T T.81, process 14, predictor 1), so the payload comes back bit for bit. Their Huffman table gives category s a
code of 9 - s bits, so that with its s further bits every sample takes 9 bits, which can be packed and read by whole
arrays; frames of other writers (any Huffman tables, predictor and precision, or a sequential DCT) are read bit by bit.
The length of the payload, before the last frame was filled up, stands in the stream's `strd` chunk.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.llm.common import task

WIDTH, HEIGHT, FPS, CATEGORIES = 64, 64, 25, 9


def _codes() -> np.ndarray:
    """9-bit word of each difference from -255 to 255."""
    words = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (8 - s)) - 1 << 1  # category 8: 0, category 7: 10, ... category 0: 111111110
        words[d + 255] = prefix << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)
    return words


CODES = _codes()
DIFFS = np.zeros(512, np.int16)
DIFFS[CODES] = np.arange(-255, 256)


def _header(height: int) -> bytes:
    table = bytes([0, *[1] * CATEGORIES, *[0] * (16 - CATEGORIES), *range(CATEGORIES - 1, -1, -1)])
    frame = struct.pack(">BHHBBBB", 8, height, WIDTH, 1, 1, 0x11, 0)
    scan = bytes([1, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(x) + 2) + x for m, x in ((0xC3, frame), (0xC4, table), (0xDA, scan)))


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each of frames[n, height, 64]."""
    n, height, _ = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = CODES[d.reshape(-1, 8) + 255].astype(np.uint32)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] << (8 - k) | c[:, k] >> (k + 1)) & 0xFF
    out[:, 8] = c[:, 7] & 0xFF
    header, size = _header(height), height * WIDTH // 8 * 9
    data = out.tobytes()
    return [header + data[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, n * size, size)]


@dataclass
class Frame:
    """What the markers of a JPEG frame say, and its entropy-coded bytes, cut where decoding restarts."""

    process: int = 0
    precision: int = 8
    height: int = 0
    width: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # id: samples across, samples down, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # counts of codes by length, then their symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, its DC and AC table
    predictor: int = 0
    shift: int = 0
    restart: int = 0
    parts: list[bytes] = field(default_factory=list)


def parse_frame(jpeg: bytes) -> Frame:
    f, at = Frame(), 2
    while True:
        while jpeg[at + 1] == 0xFF:
            at += 1
        marker, n = struct.unpack_from(">xBH", jpeg, at)
        x = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker in (0xC0, 0xC1, 0xC3):
            f.process, (f.precision, f.height, f.width) = marker, struct.unpack_from(">BHH", x)
            f.components = {x[i]: (x[i + 1] >> 4, x[i + 1] & 15, x[i + 2]) for i in range(6, len(x), 3)}
        elif 0xC0 < marker < 0xD0 and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker - 0xC0} isn't one of intra frames")
        elif marker == 0xC4:
            while x:
                size = 17 + sum(x[1:17])
                f.tables[x[0]], x = x[1:size], x[size:]
        elif marker == 0xDB:
            while x:
                size = 129 if x[0] >> 4 else 65
                f.quantisers[x[0] & 15], x = np.frombuffer(x[1:size], ">u2" if size == 129 else np.uint8).astype(float), x[size:]
        elif marker == 0xDD:
            f.restart = struct.unpack(">H", x)[0]
        elif marker == 0xDA:
            f.scan = [(x[i], x[i + 1] >> 4, x[i + 1] & 15) for i in range(1, 1 + 2 * x[0], 2)]
            f.predictor, f.shift = x[-3], x[-1] & 15
            if set(c for c, _, _ in f.scan) != set(f.components):
                raise ValueError("a frame in several scans")
            end = jpeg.rfind(b"\xff\xd9")
            f.parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", jpeg[at : end if end >= at else len(jpeg)])]
            return f


@lru_cache(64)
def _lookup(table: bytes) -> list[int]:
    """256 * length + symbol of the code that 16 bits begin with; 0 for none."""
    out, code, at = [0] * 65536, 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
            code += 1
        at += table[length - 1]
        code <<= 1
    return out


class _Bits:
    """Symbols and signed values from entropy-coded bytes, bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, 8 * len(data)

    def _next(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def symbol(self, lookup: list[int]) -> int:
        found = lookup[self._next(16)]
        self.at += found >> 8
        if not found or self.at > self.end:
            raise ValueError("broken frame")
        return found & 255

    def value(self, n: int) -> int:
        """n further bits; those of negative values begin with 0."""
        if not n:
            return 0
        x = self._next(n)
        self.at += n
        return x if x >> (n - 1) else x - (1 << n) + 1


def _lossless(f: Frame) -> np.ndarray:
    """The first component of a lossless frame whose components are sampled alike."""
    if any(c[:2] != (1, 1) for c in f.components.values()) and len(f.components) > 1:
        raise ValueError("components of a lossless frame that are sampled apart")
    if f.restart % f.width:
        raise ValueError("restarts within a line")
    n, least = f.height * f.width, 1 << (f.precision - f.shift - 1)
    lookups = [_lookup(f.tables[dc]) for _, dc, _ in f.scan]
    diffs, step = np.zeros(n, np.int64), f.restart or n
    for k, part in enumerate(f.parts[: -(-n // step)]):
        bits = _Bits(part)
        for i in range(k * step, min(n, (k + 1) * step)):
            for j, lookup in enumerate(lookups):
                s = bits.symbol(lookup)
                d = 32768 if s == 16 else bits.value(s)
                if j == 0:
                    diffs[i] = d
    x = diffs.reshape(f.height, f.width)
    fresh = range(0, f.height, f.restart // f.width or f.height)
    for y in range(f.height):
        row = x[y]
        row[0] = row[0] + (least if y in fresh else x[y - 1, 0]) & 0xFFFF
        if f.predictor == 1 or y in fresh:
            x[y] = np.cumsum(row)
        elif f.predictor == 2:
            row[1:] += x[y - 1, 1:]
        else:
            up = x[y - 1].tolist()
            own = row.tolist()
            for i in range(1, f.width):
                a, b, c = own[i - 1], up[i], up[i - 1]
                own[i] = own[i] + (c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[f.predictor - 3] & 0xFFFF
            x[y] = own
        x[y] &= 0xFFFF
    return (x << f.shift).astype(np.uint8 if f.precision <= 8 else np.uint16)


def _zigzag() -> np.ndarray:
    """Place in the block of each coefficient in the order of its diagonals."""
    at = [(y, x) for y in range(8) for x in range(8)]
    at.sort(key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in at])


ZIGZAG = _zigzag()
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _baseline(f: Frame) -> np.ndarray:
    """The first component (luminance) of a sequential DCT frame."""
    if f.precision != 8:
        raise ValueError("a DCT frame of more than 8 bits")
    first = f.scan[0][0]
    wide, high = (max(c[k] for c in f.components.values()) for k in (0, 1))
    across, down, quantiser = f.components[first]
    if len(f.components) == 1:
        wide = high = across = down = 1
    if (across, down) != (wide, high):
        raise ValueError("luminance that is sampled less than the rest")
    m_x, m_y = -(-f.width // (8 * wide)), -(-f.height // (8 * high))
    out = np.zeros((m_y * high, m_x * wide, 64))
    step = f.restart or m_x * m_y
    plan = [(c == first, *(f.components[c][:2] if len(f.components) > 1 else (1, 1)), _lookup(f.tables[dc]), _lookup(f.tables[0x10 | ac])) for c, dc, ac in f.scan]
    for k, part in enumerate(f.parts[: -(-m_x * m_y // step)]):
        bits, last = _Bits(part), [0] * len(plan)
        for m in range(k * step, min(m_x * m_y, (k + 1) * step)):
            for j, (own, h, v, dc, ac) in enumerate(plan):
                for y in range(v):
                    for x in range(h):
                        last[j] += bits.value(bits.symbol(dc))
                        block = out[m // m_x * v + y, m % m_x * h + x] if own else np.zeros(64)
                        block[0], i = last[j], 1
                        while i < 64:
                            run, s = divmod(bits.symbol(ac), 16)
                            if not s and run < 15:
                                break
                            i += run
                            if i < 64:
                                block[ZIGZAG[i]] = bits.value(s)
                            i += 1
    scale = np.zeros(64)
    scale[ZIGZAG] = f.quantisers[quantiser]
    blocks = COSINES.T @ (out * scale).reshape(*out.shape[:2], 8, 8) @ COSINES + 128
    return np.clip(np.rint(blocks), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * m_y * high, 8 * m_x * wide)[: f.height, : f.width]


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples of the first component of an intra frame: lossless, or a sequential DCT with Huffman codes. The frame
    brings its own tables. Other frames, and broken ones, are a ValueError."""
    f = parse_frame(jpeg)
    if not f.process:
        raise ValueError("no frame header")
    return (_lossless if f.process == 0xC3 else _baseline)(f)


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Frames of one size. Those whose samples all take 9 bits, as in stored texts, are decoded as whole arrays."""
    header = jpegs[0][: len(_header(0))]
    height = struct.unpack_from(">H", header, 7)[0] if len(header) > 8 else 0
    if header != _header(height) or not all(j.startswith(header) for j in jpegs):
        return np.stack([decode_frame(j) for j in jpegs])
    data = b"".join(j[len(header) : -2].replace(b"\xff\x00", b"\xff") for j in jpegs)
    b = np.frombuffer(data, np.uint8).reshape(-1, 9).astype(np.uint32)
    c = np.empty((len(b), 8), np.uint32)
    for k in range(8):
        c[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 0x1FF
    d = DIFFS[c].reshape(len(jpegs), height, WIDTH).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)  # the first sample of a row is predicted from the one above
    return np.cumsum(d, axis=2).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload; its length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    n = -(-rows // HEIGHT)
    height = -(-rows // n)
    samples = np.zeros((n, height, WIDTH), np.uint8)
    samples.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    jpegs = encode_frames(samples)
    most = max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    chunks = [_chunk(b"00dc", j) for j in jpegs]
    index, at = [], 4
    for j, c in zip(jpegs, chunks):
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(j)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[np.ndarray, int, float]:
    """Frames by way of the file's index, the length of the payload and the frames a second. Files of other writers may
    count their index from the file's beginning, or have none, or no length: then it is that of all samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found, sizes, lists = {}, {}, [(12, len(data))]
    while lists:
        at, end = lists.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                found[kind], sizes[kind] = at + 8, n
                if kind != b"movi":
                    lists.append((at + 12, at + 8 + n))
            elif name != b"strh" or data[at + 8 : at + 12] == b"vids":
                found[name], sizes[name] = at + 8, n
            at += 8 + n + n % 2
    base, video = found[b"movi"], (b"dc", b"db")
    jpegs = []
    if b"idx1" in found:
        for name, _, offset, size in struct.iter_unpack("<4sIII", data[found[b"idx1"] : found[b"idx1"] + sizes[b"idx1"] // 16 * 16]):
            at = base + offset if data[base + offset : base + offset + 4] == name else offset
            if name[2:] in video:
                jpegs.append(data[at + 8 : at + 8 + size])
    else:
        at = base + 4
        while at + 8 <= base + sizes[b"movi"]:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in video:
                jpegs.append(data[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    jpegs = [j if j else jpegs[i - 1] for i, j in enumerate(jpegs)]  # an empty chunk repeats the frame before
    frames = decode_frames(jpegs)
    scale, rate = struct.unpack_from("<II", data, found[b"strh"] + 20)
    return frames, struct.unpack_from("<Q", data, found[b"strd"])[0] if b"strd" in found else frames.nbytes, rate / scale


def detect_shots(frames: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.05) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the difference of each frame's histogram from the one before.

    A shot begins where the difference exceeds the mean of the last `window` differences by `factor` of their
    standard deviation, and `least` in any case.
    """
    n = len(frames)
    bins = (frames.reshape(n, -1) >> (8 * frames.itemsize - 4)).astype(np.int64) + 16 * np.arange(n)[:, None]
    histograms = np.bincount(bins.reshape(-1), minlength=16 * n).reshape(n, 16)
    diffs = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2.0 * frames[0].size)
    starts, since = [0], 0
    for i, d in enumerate(diffs):
        past = diffs[max(since, i - window) : i]
        if len(past) >= 2 and d > max(least, past.mean() + factor * past.std()):
            starts.append(i + 1)
            since = i + 1
    return starts, diffs


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            media = [write_avi(t + b"\0" * (-len(t) % WIDTH or WIDTH * (not t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")}
        for m in batch.column("media"):
            data = m.as_py()
            frames, size, fps = read_avi(data)
            payload = frames.tobytes()[:size]
            starts, diffs = detect_shots(frames)
            ends = [*starts[1:], len(frames)]
            rows["payload_bytes"].append(size)
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-64:]))
            rows["media_bytes"].append(len(data))
            rows["media_sha256"].append(hashlib.sha256(data).hexdigest())
            rows["feature"].append(f"frames={len(frames)};shots={len(starts)};change={diffs.mean() if len(diffs) else 0:.4f};level={frames.mean():.2f}")
            rows["clips"].append([{"first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for a, b in zip(starts, ends)])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, t) for v, t in zip(rows.values(), kinds)]], ["doc_id", "n_bytes", *rows])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) for every row of docs(doc_id, text). A null text is an empty one, and an
    empty one is 64 zero bytes. Repeated rows are stored each; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task("parkflow.llm.media", "encode_batches"), f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored files hold when read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and clips (the shots)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(task("parkflow.llm.media", "feature_batches"), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,end_frame:int,start_s:double,end_s:double>>")


def clips(features: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip, first_frame, end_frame, start_s, end_s."""
    return features.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
