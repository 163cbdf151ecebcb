"""Media columns: motion JPEG in AVI (RIFF) containers.

Any bytes can be stored as 8-bit grey samples: frames are lossless JPEG (process 14, left predictor), so that they read
back bit for bit. The Huffman table gives the code of difference category s exactly 9 - s bits, so that code and extra
bits always take 9 bits together; such scans are packed and unpacked as arrays. Reading handles any table, and baseline
DCT frames (the usual motion JPEG) as well. Shots are cut where the difference of neighbouring frames' histograms stands
out from those around it.
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

from trackmotif.session import ship_package

WIDTH, MAX_ROWS, FPS = 64, 64, 25
#: Histogram bins; neighbours on each side that set the adaptive threshold; deviations above their mean; least difference.
BINS, AROUND, DEVIATIONS, LEAST = 16, 8, 3.0, 0.15

# Fixed values of the JPEG standard: zigzag order, and the tables that frames without DHT use (Annex K).
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_DC = bytes(range(12))
_AC_LUMA = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
_AC_CHROMA = bytes.fromhex(
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
)
DEFAULT_TABLES = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), _DC),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), _DC),
    (1, 0): (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _AC_LUMA),
    (1, 1): (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _AC_CHROMA),
}
# One code of each length 1 to 9, for categories 8 down to 0.
_UNIFORM = (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Code of each difference -255..255 (at +255), and the difference of each 9-bit code."""
    codes = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = (1 << (9 - size)) - 2
        codes[diff + 255] = (prefix << size) | (diff if diff >= 0 else diff + (1 << size) - 1)
    back = np.zeros(512, np.int32)
    back[codes.astype(np.int64)] = np.arange(-255, 256)
    return codes, back


_CODES, _DIFFS = _code_table()
_SHIFTS = np.array([55, 46, 37, 28, 19, 10, 1], np.uint64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG frames of (frames, rows, columns) bytes; rows x columns must be a multiple of 8."""
    count, rows, columns = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODES[d.reshape(-1, 8) + 255]
    packed = np.empty((len(c), 9), np.uint8)
    high = np.bitwise_or.reduce(c[:, :7] << _SHIFTS, axis=1) | (c[:, 7] >> np.uint64(8))
    packed[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8] = c[:, 7] & np.uint64(255)
    data, step = packed.tobytes(), rows * columns // 8 * 9
    head = (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + _UNIFORM[0] + _UNIFORM[1])
        + _segment(0xC3, struct.pack(">BHHB", 8, rows, columns, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )
    return [head + data[i * step : (i + 1) * step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(count)]


class _Bits:
    """Most significant bit first; past the end come zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.value = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            self.value = (self.value << 64) | int.from_bytes(part.ljust(8, b"\0"), "big")
            self.at += 8
            self.have += 64

    def take(self, n: int) -> int:
        self._fill(n)
        self.have -= n
        out = self.value >> self.have
        self.value &= (1 << self.have) - 1
        return out

    def symbol(self, table: list[int]) -> int:
        """By the next 16 bits: the table has length << 8 | value, 0 where no code begins so."""
        self._fill(16)
        entry = table[self.value >> (self.have - 16)]
        if not entry:
            raise ValueError("no such Huffman code")
        self.have -= entry >> 8
        self.value &= (1 << self.have) - 1
        return entry & 255

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


@lru_cache(maxsize=32)
def _huffman(counts: bytes, values: bytes) -> list[int]:
    table, code, k = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first, span = code << (16 - length), 1 << (16 - length)
            table[first : first + span] = [length << 8 | values[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _parse(frame: bytes) -> dict:
    """Marker segments of a frame, and where its entropy-coded data lie."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    out = {"huffman": dict(DEFAULT_TABLES), "quant": {}, "restart": 0, "process": None}
    at = 2
    while True:
        while frame[at] == 0xFF and frame[at + 1] == 0xFF:
            at += 1
        if frame[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                out["huffman"][body[k] >> 4, body[k] & 15] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out["quant"][body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            out["process"] = marker
            out["rows"], out["columns"], n = struct.unpack_from(">HHB", body, 1)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDA:
            n = body[0]
            out["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
            out["predictor"] = body[1 + 2 * n]
            end = frame.rfind(b"\xff\xd9")
            out["data"] = frame[at : end if end >= at else len(frame)]
            return out


def _undo_left_predictor(d: np.ndarray) -> np.ndarray:
    """(frames, rows, columns) differences to samples."""
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2).astype(np.uint8)


def _lossless_scalar(p: dict) -> np.ndarray:
    """One frame with any Huffman table, by predictor 1."""
    table, bits = _huffman(*p["huffman"][0, p["tables"][p["parts"][0][0]][0]]), _Bits(p["data"].replace(b"\xff\x00", b"\xff"))
    d = [bits.signed(bits.symbol(table)) for _ in range(p["rows"] * p["columns"])]
    return _undo_left_predictor(np.array(d, np.int32).reshape(1, p["rows"], p["columns"]))[0]


def _baseline(p: dict) -> np.ndarray:
    """Luma samples of one baseline DCT frame."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    across, down = max(h for _, h, _, _ in p["parts"]), max(v for _, _, v, _ in p["parts"])
    wide, high = -(-p["columns"] // (8 * across)), -(-p["rows"] // (8 * down))
    name, h0, v0, q0 = p["parts"][0]
    plane = np.zeros((high * v0 * 8, wide * h0 * 8))
    dc = {i: _huffman(*p["huffman"][0, t[0]]) for i, t in p["tables"].items()}
    ac = {i: _huffman(*p["huffman"][1, t[1]]) for i, t in p["tables"].items()}
    pieces, start, at, data = [], 0, 0, p["data"]
    while (at := data.find(b"\xff", at)) >= 0:
        if 0xD0 <= (data[at + 1] if at + 1 < len(data) else 0) <= 0xD7:
            pieces.append(data[start:at])
            start = at + 2
        at += 2
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in [*pieces, data[start:]]]
    bits, last = _Bits(pieces[0]), dict.fromkeys(dc, 0)
    for unit in range(wide * high):
        if p["restart"] and unit and unit % p["restart"] == 0:
            bits, last = _Bits(pieces[unit // p["restart"]]), dict.fromkeys(dc, 0)
        for part, h, v, _ in p["parts"]:
            for by in range(v):
                for bx in range(h):
                    block = np.zeros(64)
                    last[part] += bits.signed(bits.symbol(dc[part]))
                    block[0] = last[part]
                    i = 1
                    while i < 64:
                        run = bits.symbol(ac[part])
                        if run == 0:
                            break
                        i += run >> 4
                        if run & 15:
                            block[ZIGZAG[i]] = bits.signed(run & 15) * p["quant"][q0][i] if part == name else bits.signed(run & 15)
                        i += 1
                    if part == name:
                        block[0] *= p["quant"][q0][0]
                        y, x = (unit // wide * v + by) * 8, (unit % wide * h + bx) * 8
                        plane[y : y + 8, x : x + 8] = basis @ block.reshape(8, 8) @ basis.T
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: p["rows"], : p["columns"]]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, rows, columns) grey samples of intra frames of one size."""
    parsed = [_parse(f) for f in frames]
    if not parsed:
        return np.zeros((0, 0, 0), np.uint8)
    first = parsed[0]
    rows, columns = first["rows"], first["columns"]
    if all(p["process"] == 0xC3 and p["huffman"].get((0, 0)) == _UNIFORM and p["predictor"] == 1 and (p["rows"], p["columns"]) == (rows, columns) and rows * columns % 8 == 0 for p in parsed):
        step = rows * columns // 8 * 9
        packed = np.frombuffer(b"".join(p["data"].replace(b"\xff\x00", b"\xff")[:step] for p in parsed), np.uint8).reshape(-1, 9)
        high = np.ascontiguousarray(packed[:, :8]).view(">u8").astype(np.uint64)
        codes = np.empty((len(packed), 8), np.uint64)
        codes[:, :7] = (high >> _SHIFTS) & np.uint64(511)
        codes[:, 7] = ((high[:, 0] & np.uint64(1)) << np.uint64(8)) | packed[:, 8]
        return _undo_left_predictor(_DIFFS[codes.view(np.int64)].reshape(-1, rows, columns))
    out = []
    for p in parsed:
        if p["process"] == 0xC3 and (len(p["parts"]) > 1 or p["predictor"] != 1):
            raise ValueError("lossless frames need one component and predictor 1")
        out.append(_lossless_scalar(p) if p["process"] == 0xC3 else _baseline(p))
    return np.stack(out)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, rows: int, fps: int = FPS, private: bytes = b"") -> bytes:
    """A RIFF AVI with one motion-JPEG stream and an idx1 index; ``private`` goes to the stream's strd chunk."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, -1, 0, 0, 0, width, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, rows, 1, 8, b"MJPG", width * rows, 0, 0, 0, 0)
    stream = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", private) if private else b"")
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", stream))
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, body's start and size of each chunk; of a list, its type and where its first chunk is."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name in (b"LIST", b"RIFF"):
            yield name + data[at + 8 : at + 12], at + 12, max(0, min(size, end - at - 8) - 4)
        else:
            yield name, at + 8, size
        at += 8 + size + size % 2


def _standard_index(data: bytes, at: int) -> list[tuple[int, int]]:
    """(start, size) of the frames that an OpenDML index chunk's body names."""
    longs, _, kind, used, _, base = struct.unpack_from("<HBBI4sQ", data, at)
    if longs != 2 or kind != 1:
        raise ValueError("an OpenDML index of another kind")
    pairs = struct.iter_unpack("<II", data[at + 24 : at + 24 + 8 * used])
    return [(base + offset, size & 0x7FFFFFFF) for offset, size in pairs]


def read_avi(data: bytes) -> dict:
    """Frame rate and strd bytes of the first video stream, and (start, size) of its frames.

    An OpenDML index decides where there is one, else idx1, whose offsets may count from the movi list or from the file's
    start, else the order of chunks in the movi lists, with those in rec lists and in further RIFF parts. Frames without
    bytes repeat the one before and are left out.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, private, stream, streams = float(FPS), b"", None, 0
    indexes, movi = {"indx": None, "idx1": None}, []
    for part, at, size in _chunks(data, 0, len(data)):
        if not part.startswith(b"RIFF"):
            continue
        for name, a, n in _chunks(data, at, at + size):
            if name == b"LISTmovi":
                movi.append((a, a + n))
            elif name == b"idx1" and indexes["idx1"] is None:
                indexes["idx1"] = list(struct.iter_unpack("<4sIII", data[a : a + n - n % 16]))
            elif name == b"LISThdrl":
                for sub, b, m in _chunks(data, a, a + n):
                    if sub != b"LISTstrl":
                        continue
                    inner = {k: (x, y) for k, x, y in _chunks(data, b, b + m)}
                    head = inner.get(b"strh", (0, 0))[0]
                    if stream is None and data[head : head + 4] == b"vids":
                        stream = b"%02d" % streams
                        scale, rate = struct.unpack_from("<II", data, head + 20)
                        fps = rate / max(scale, 1)
                        x, y = inner.get(b"strd", (0, 0))
                        private = data[x : x + y]
                        if b"indx" in inner:
                            indexes["indx"] = inner[b"indx"][0]
                    streams += 1
    wanted = lambda name: name[:2] == stream and name[2:] in (b"dc", b"db")
    frames: list[tuple[int, int]] = []
    if stream is None or not movi:
        pass
    elif (at := indexes["indx"]) is not None:
        longs, _, kind, used = struct.unpack_from("<HBBI", data, at)
        if kind == 0:
            for place, _, _ in struct.iter_unpack("<QII", data[at + 24 : at + 24 + 16 * used]):
                frames += _standard_index(data, place + 8)
        else:
            frames = _standard_index(data, at)
    elif indexes["idx1"] is not None:
        own = [(name, offset, size) for name, _, offset, size in indexes["idx1"] if wanted(name)]
        base = movi[0][0] - 4
        if own and data[base + own[0][1] : base + own[0][1] + 4] != own[0][0]:
            base = 0
            if data[own[0][1] : own[0][1] + 4] != own[0][0]:
                raise ValueError("idx1 names no frame")
        frames = [(base + offset + 8, size) for _, offset, size in own]
    else:
        waiting = list(reversed(movi))
        while waiting:
            at, end = waiting.pop()
            lists = []
            for name, a, n in _chunks(data, at, end):
                if name == b"LISTrec ":
                    lists.append((a, a + n))
                    frames += [(x, y) for k, x, y in _chunks(data, a, a + n) if wanted(k)]
                elif wanted(name):
                    frames.append((a, n))
    return {"fps": fps, "private": private, "frames": [f for f in frames if f[1]]}


def frames_of(data: bytes, places: list[tuple[int, int]], together: int = 64) -> Iterator[np.ndarray]:
    """Samples of some frames at a time."""
    for k in range(0, len(places), together):
        yield decode_frames([data[a : a + n] for a, n in places[k : k + together]])


def histograms(samples: np.ndarray) -> np.ndarray:
    """Share of each of ``BINS`` levels, and the mean level, of each frame."""
    count = len(samples)
    bins = (samples.reshape(count, -1) >> 4).astype(np.int64) + BINS * np.arange(count)[:, None]
    hist = np.bincount(bins.ravel(), minlength=BINS * count).reshape(count, BINS) / max(1, samples[0].size)
    return np.concatenate([hist, samples.reshape(count, -1).mean(axis=1)[:, None]], axis=1)


def shots(measured: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) frame numbers of each shot, from ``histograms``: a cut is a histogram difference above its
    surroundings' mean plus ``DEVIATIONS`` standard deviations, ``LEAST`` at least."""
    count = len(measured)
    if count == 0:
        return []
    jump = np.abs(np.diff(measured[:, :BINS], axis=0)).sum(axis=1) / 2
    cuts = [0]
    for t in np.flatnonzero(jump > LEAST):
        near = np.delete(jump[max(0, t - AROUND) : t + AROUND + 1], min(t, AROUND))
        if len(near) == 0 or jump[t] > near.mean() + DEVIATIONS * near.std():
            cuts.append(int(t) + 1)
    return list(zip(cuts, [*cuts[1:], count], strict=True))


def measure(data: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """``histograms`` of all frames, which are decoded some at a time."""
    return np.concatenate([np.zeros((0, BINS + 1)), *(histograms(x) for x in frames_of(data, places))])


def store(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as an AVI file."""
    lines = len(payload) // WIDTH
    rows = min(MAX_ROWS, lines)
    frames = -(-lines // rows)
    samples = np.frombuffer(payload.ljust(frames * rows * WIDTH, b"\0"), np.uint8).reshape(frames, rows, WIDTH)
    return write_avi(encode_frames(samples), WIDTH, rows, private=struct.pack("<Q", len(payload)))


def load(media: bytes) -> tuple[bytes, np.ndarray, tuple[int, int], float]:
    """The payload stored in an AVI file, its frames' measures, their rows and columns, and the frame rate."""
    avi = read_avi(media)
    parts, measured, shape = [], [np.zeros((0, BINS + 1))], (0, 0)
    for samples in frames_of(media, avi["frames"]):
        parts.append(samples.tobytes())
        measured.append(histograms(samples))
        shape = samples.shape[1:]
    payload = b"".join(parts)
    size = struct.unpack("<Q", avi["private"])[0] if len(avi["private"]) == 8 else len(payload)
    return payload[:size], np.concatenate(measured), shape, avi["fps"]


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def describe(measured: np.ndarray, shape: tuple[int, int], fps: float) -> str:
    """frames, and the timed shots in milliseconds with their mean level."""
    found = ";".join(f"{round(1000 * a / fps)}-{round(1000 * b / fps)}:{measured[a:b, BINS].mean():.3f}" for a, b in shots(measured))
    return f"{len(measured)}x{'x'.join(map(str, shape))}|{found}"


def clips(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """Timed clip rows of a binary column of AVI files: id, clip, start_ms, end_ms, n_frames, mean_level, error. A file's
    frames are decoded some at a time, so that a task holds the file and a few frames.

    Null media give no row; media that can't be read give one row whose ``error`` says why. Other columns are left out.
    """
    ship_package(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, media in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if media is None:
                    continue
                try:
                    avi = read_avi(media)
                    measured = measure(media, avi["frames"])
                    for k, (a, b) in enumerate(shots(measured)):
                        rows.append((key.as_py(), k, round(1000 * a / avi["fps"]), round(1000 * b / avi["fps"]), b - a, float(measured[a:b, BINS].mean()), None))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((key.as_py(), None, None, None, None, None, f"{type(e).__name__}: {e}"))
            schema = pa.schema([batch.schema.field(0), ("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_frames", pa.int32()), ("mean_level", pa.float64()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return df.select(id_column, media_column).mapInArrow(read, f"`{id_column}` {kind}, clip int, start_ms long, end_ms long, n_frames int, mean_level double, error string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(df: DataFrame) -> DataFrame:
    """Store every row's ``text`` as AVI media, read the media back and describe them: one row of ``DIGEST`` a row.

    Null text counts as empty (64 zero bytes); a null doc_id stays null; repeated rows give repeated rows; other columns
    are left out. Rows are handled one by one, so memory holds one Arrow batch and one document's media.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = store(pad(raw))
                payload, measured, shape, fps = load(media)
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(measured, shape, fps))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, DIGEST)
