"""Frames and files of other writers, and the features of a text, against plain versions."""

import math
import struct

import numpy as np
import pytest

from parkflow.llm import media

LENGTHS = {**{s: 6 for s in range(17)}, 3: 2, 0: 3}
DC, AC = {s: 4 for s in range(12)}, {s: 8 for s in [0, 0xF0, *[r << 4 | k for r in range(16) for k in range(1, 11)]]}


def huffman(lengths):
    """Counts and symbols as a file states them, and each symbol's code as text."""
    order = sorted(lengths, key=lambda s: (lengths[s], -s))
    codes, code, size = {}, 0, 0
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s] = format(code, f"0{size}b")
        code += 1
    return bytes([sum(n == k for n in lengths.values()) for k in range(1, 17)]) + bytes(order), codes


def signed(d):
    s = abs(d).bit_length()
    return s, "" if not s or s == 16 else format(d if d > 0 else d + (1 << s) - 1, f"0{s}b")


def segment(marker, data):
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def lossless(x, predictor, precision, shift=0, restart_rows=0):
    height, width = x.shape
    table, codes = huffman(LENGTHS)
    x, parts, bits = (x >> shift).astype(int), [], ""
    for i in range(height):
        first = i == 0 or restart_rows and i % restart_rows == 0
        if first and i:
            parts.append(packed(bits))
            bits = ""
        for j in range(width):
            a, b, c = (x[i, j - 1] if j else 0), (x[i - 1, j] if i else 0), (x[i - 1, j - 1] if i and j else 0)
            guess = (1 << (precision - shift - 1) if j == 0 else a) if first else b if j == 0 else [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
            d = int(x[i, j] - guess) & 0xFFFF
            s, value = signed(d if d <= 32768 else d - 65536)
            bits += codes[s] + value
    data = packed(bits)
    for k, part in reversed(list(enumerate(parts))):
        data = part + bytes([0xFF, 0xD0 + k % 8]) + data
    head = segment(0xE0, b"any") + (segment(0xDD, struct.pack(">H", restart_rows * width)) if restart_rows else b"")
    return b"\xff\xd8" + head + segment(0xC4, b"\x02" + table) + segment(0xC3, struct.pack(">BHHBBBB", precision, height, width, 1, 7, 0x11, 0)) + segment(0xDA, bytes([1, 7, 0x20, predictor, 0, shift])) + data + b"\xff\xd9"


def dct(x, planes, sampling, quantiser):
    """A sequential frame of planes, each as large as its sampling says."""
    (dc, dc_codes), (ac, ac_codes) = huffman(DC), huffman(AC)
    height, width = x.shape
    across, down = sampling[0]
    basis = np.array([[math.cos((2 * i + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for i in range(8)] for u in range(8)])
    zigzag, up, y, i = [], True, 0, 0
    while len(zigzag) < 64:  # along the diagonals, turning at the borders
        zigzag.append((y, i))
        if up:
            up, y, i = (False, y + 1, i) if i == 7 else (False, y, i + 1) if y == 0 else (True, y - 1, i + 1)
        else:
            up, y, i = (True, y, i + 1) if y == 7 else (True, y + 1, i) if i == 0 else (False, y + 1, i - 1)
    bits, last = "", [0] * len(planes)
    for m_y in range(-(-height // (8 * down))):
        for m_x in range(-(-width // (8 * across))):
            for k, (plane, (h, v)) in enumerate(zip(planes, sampling)):
                for b_y in range(v):
                    for b_x in range(h):
                        at_y, at_x = 8 * (m_y * v + b_y), 8 * (m_x * h + b_x)
                        rows, columns = (np.minimum(np.arange(at, at + 8), n - 1) for at, n in ((at_y, plane.shape[0]), (at_x, plane.shape[1])))
                        block = np.rint(basis @ (plane[np.ix_(rows, columns)].astype(float) - 128) @ basis.T / quantiser).astype(int)
                        values = [int(block[p]) for p in zigzag]
                        s, value = signed(values[0] - last[k])
                        bits, last[k], run = bits + dc_codes[s] + value, values[0], 0
                        end = max([i for i in range(1, 64) if values[i]], default=0)
                        for x_ in values[1 : end + 1]:
                            if x_ == 0:
                                run += 1
                                continue
                            bits += ac_codes[0xF0] * (run // 16)
                            s, value = signed(x_)
                            bits, run = bits + ac_codes[run % 16 << 4 | s] + value, 0
                        bits += ac_codes[0] if end < 63 else ""
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    scan = bytes([len(planes)]) + b"".join(bytes([k + 1, 0x00]) for k in range(len(planes))) + bytes([0, 63, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[quantiser] * 64])) + segment(0xC0, frame) + segment(0xC4, b"\x00" + dc + b"\x10" + ac) + segment(0xDA, scan) + packed(bits) + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize(("precision", "shift", "restart_rows"), [(8, 0, 0), (12, 0, 2), (16, 0, 0), (8, 2, 3)])
def test_lossless_frames_of_other_writers(predictor, precision, shift, restart_rows):
    x = np.random.default_rng(predictor).integers(0, 1 << precision, (7, 11))
    x[3] = (1 << precision) - 1
    got = media.decode_frame(lossless(x, predictor, precision, shift, restart_rows))
    assert got.dtype == (np.uint8 if precision <= 8 else np.uint16)
    assert (got == x >> shift << shift).all()


def picture(height, width):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:height, :width]
    return np.clip(120 + 80 * np.sin(y / 5) + 40 * np.cos(x / 3) + rng.normal(0, 4, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("color", [False, True])
def test_sequential_frames(color):
    x = picture(21, 34)
    planes, sampling = ([x, picture(11, 17), np.full((11, 17), 90)], [(2, 2), (1, 1), (1, 1)]) if color else ([x], [(1, 1)])
    got = media.decode_frame(dct(x, planes, sampling, 2))
    assert got.shape == x.shape and np.abs(got.astype(int) - x).max() <= 4


def test_broken_frames():
    whole = lossless(np.arange(77).reshape(7, 11), 1, 8)
    for bad in (whole[:-20], whole.replace(b"\xff\xc3", b"\xff\xc2")):
        with pytest.raises(ValueError):
            media.decode_frame(bad)


@pytest.mark.parametrize("index", ["absolute", "relative", "none"])
def test_files_of_other_writers(index):
    frames = [np.full((5, 9), v) for v in (3, 9, 200)]
    jpegs = [lossless(f, 4, 8) for f in frames]
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1001, 30000, 0, 3, 0, 0, 0, 0, 0, 9, 5)
    sound = media._chunk(b"LIST", b"strl" + media._chunk(b"strh", b"auds" + bytes(52)))
    head = media._chunk(b"LIST", b"hdrl" + media._chunk(b"LIST", b"strl" + media._chunk(b"strh", strh)) + sound)
    chunks, entries = b"", b""
    for j in (jpegs[0], b"", jpegs[1], jpegs[2]):  # an empty chunk repeats a frame
        at = 4 + len(chunks) + (12 + len(head) + 8 if index == "absolute" else 0)
        entries += b"00dc" + struct.pack("<III", 16, at, len(j))
        chunks += media._chunk(b"00dc", j) + media._chunk(b"01wb", b"sound")
    body = b"AVI " + head + media._chunk(b"LIST", b"movi" + chunks) + (b"" if index == "none" else media._chunk(b"idx1", entries))
    got, size, fps = media.read_avi(media._chunk(b"RIFF", body))
    assert [f[0, 0] for f in got] == [3, 3, 9, 200] and size == 4 * 45 and round(fps, 2) == 29.97


def plain_feature(text):
    """Frames of at most 64 rows of 64 bytes, and where their histograms jump."""
    data = text.encode()
    data += b"\0" * (-len(data) % 64 or 64 * (not data))
    rows = [data[i : i + 64] for i in range(0, len(data), 64)]
    n = math.ceil(len(rows) / 64)
    height = math.ceil(len(rows) / n)
    frames = [b"".join(rows[i * height : (i + 1) * height]).ljust(64 * height, b"\0") for i in range(n)]
    counts = [[sum(b >> 4 == k for b in f) for k in range(16)] for f in frames]
    change = [sum(abs(p - q) for p, q in zip(a, b)) / (2 * 64 * height) for a, b in zip(counts, counts[1:])]
    shots, since = 1, 0
    for i, d in enumerate(change):
        past = change[max(since, i - 12) : i]
        mean = sum(past) / len(past) if past else 0
        if len(past) >= 2 and d > max(0.05, mean + 3 * math.sqrt(sum((x - mean) ** 2 for x in past) / len(past))):
            shots, since = shots + 1, i + 1
    level = sum(map(sum, frames)) / (n * 64 * height)
    return f"frames={n};shots={shots};change={sum(change) / len(change) if change else 0:.4f};level={level:.2f}"


def test_features(spark, docs_of):
    rows = ["", "a", "word " * 300, "plain words " * 4000 + "ÿ" * 30000 + "0123456789" * 3000, "x" * 70000]
    got = {r.doc_id: r for r in media.media_features(media.store_media(docs_of(rows))).collect()}
    assert [got[i].feature for i in range(len(rows))] == [plain_feature(t) for t in rows]
    assert len(got[3].clips) > 1 and got[3].clips[1].start_s == got[3].clips[1].first_frame / 25
