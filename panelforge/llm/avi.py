"""Media columns: AVI motion-JPEG with RIFF index parsing, intra-frame decoding and shot detection.

Bytes are kept as 8-bit grey samples of small frames. Each frame is a lossless JPEG (process 14 of
ITU-T T.81, SOF3, predictor 1). The code table gives difference category c a code of 9 - c bits, so
that every sample takes nine bits and whole batches of frames are coded by array operations; a bit
reader for any other table is kept beside it. Clips are also found in ordinary films of baseline DCT
frames, grey or colour, whose brightness is decoded. Frames lie in a ``movi`` list, found through ``idx1``;
a ``strd`` chunk holds the payload's length, since the last frame may be padded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, map_arrow

WIDTH, HEIGHT, UNIT, FPS = 16, 12, 192, 25
#: Samples coded at once; a text longer than this is coded alone, in memory of some tens of times its length.
CHUNK = 2 << 20
#: A shot starts where the histogram difference is over mean + SHOT_SIGMAS deviations of those before it.
SHOT_SIGMAS, SHOT_FLOOR, SHOT_WINDOW, BINS = 3.0, 0.35, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The nine-bit code of each difference (from -255), and its inverse modulo 256."""
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.uint8)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1 if c < 9 else 0
        extra = diff if diff >= 0 else diff + (1 << c) - 1
        word = (0b111111110 if c == 0 else (prefix << c) | extra)
        code[diff + 255], back[word] = word, diff & 255
    return code, back


CODE, BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: SOI, SOF3, DHT and SOS of every frame written here: categories 8 to 0 have codes of 1 to 9 bits.
HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of ``samples`` (frames x UNIT, uint8)."""
    grid = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    words = CODE[diff.reshape(-1, 8) + 255]
    out = np.zeros((len(words), 9), np.uint8)
    for k in range(8):
        shifted = words[:, k] << np.uint16(7 - k)
        out[:, k] |= (shifted >> 8).astype(np.uint8)
        out[:, k + 1] |= (shifted & 255).astype(np.uint8)
    data, size = out.tobytes(), UNIT * 9 // 8
    return [HEAD + data[i : i + size].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for i in range(0, len(data), size)]


def write_avi(frames: list[bytes], length: int) -> bytes:
    """A RIFF AVI of ``frames`` with header lists, ``movi`` and ``idx1``."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + chunk(b"strd", struct.pack("<Q", length))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl))
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    starts = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))[:-1]]) if frames else np.zeros(0, np.int64)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2], index[:, 3] = starts, sizes
    pack = struct.Struct("<4sI").pack
    movi = b"movi" + b"".join([x for f in frames for x in (pack(b"00dc", len(f)), f, b"\0" * (len(f) & 1))])
    body = b"AVI " + head + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_chunks(data: bytes, at: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    """Chunks between two places: tag (LIST: its kind) to (start, size) of the bodies."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    while at + 8 <= end:
        tag, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk reaches beyond its list")
        if tag == b"LIST":
            found.setdefault(data[at + 8 : at + 12], []).append((at + 12, size - 4))
        else:
            found.setdefault(tag, []).append((at + 8, size))
        at += 8 + size + (size & 1)
    return found


@dataclass(frozen=True)
class Video:
    fps: float
    frames: list[bytes]
    length: int | None  # of the payload, where the file says it


def read_avi(data: bytes) -> Video:
    """Parse the header lists and fetch the video frames through ``idx1`` (offsets from ``movi`` or the file's start)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    top = riff_chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0])
    (head, head_size), (movi, movi_size) = top[b"hdrl"][0], top[b"movi"][0]
    lists = riff_chunks(data, head, head + head_size)
    (strl, strl_size) = lists[b"strl"][0]
    stream = riff_chunks(data, strl, strl + strl_size)
    scale, rate = struct.unpack_from("<II", data, stream[b"strh"][0][0] + 20)
    length = struct.unpack_from("<Q", data, stream[b"strd"][0][0])[0] if b"strd" in stream else None
    if b"idx1" in top:
        at, size = top[b"idx1"][0]
        index = np.frombuffer(data, "<u4", size // 16 * 4, at).reshape(-1, 4)
        index = index[np.isin(index[:, 0] & 0xFFFF0000, [int.from_bytes(b"\0\0dc", "little"), int.from_bytes(b"\0\0db", "little")])]
        base = movi - 4 if len(index) and index[0, 2] < movi - 4 else 0
        places = [(base + int(o) + 8, int(n)) for o, n in index[:, 2:].tolist()]
    else:
        places = [p for tag, ps in riff_chunks(data, movi, movi + movi_size).items() if tag[2:] in (b"dc", b"db") for p in ps]
    return Video(rate / scale if scale else FPS, [data[a : a + n] for a, n in places], length)


@dataclass(frozen=True)
class Frame:
    """What a frame's markers say up to and with SOS."""

    sof: int
    height: int
    width: int
    parts: tuple[tuple[int, int, int, int], ...]  # id, sampling across and down, quantisation table
    scan: tuple[tuple[int, int, int], ...]  # id, DC table (or the lossless one), AC table
    predictor: int
    tables: dict[int, dict[tuple[int, int], int]]  # by class * 16 + number: (bits, code) to value
    steps: dict[int, tuple[int, ...]]
    restart: int
    at: int  # where the coded data begins


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for bits, count in enumerate(counts, 1):
        for _ in range(count):
            codes[bits, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


@lru_cache(maxsize=256)
def frame_head(head: bytes) -> Frame:
    """Markers of a frame up to and with SOS."""
    at, sof, size, parts, tables, steps, restart = 2, 0, (0, 0), (), {}, {}, 0
    while at + 4 <= len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker in (0xC0, 0xC1, 0xC3):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            sof, size = marker, struct.unpack_from(">HH", body, 1)
            parts = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3))
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("progressive and arithmetic frames are not read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                many = sum(body[k + 1 : k + 17])
                tables[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + many])
                k += 17 + many
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                steps[body[k] & 15] = struct.unpack_from(">64H" if wide else "64B", body, k + 1)
                k += 65 + 64 * wide
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if not sof:
                raise ValueError("a scan without a frame")
            scan = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2))
            return Frame(sof, *size, parts, scan, body[1 + 2 * body[0]], tables, steps, restart, at + 2 + n)
        at += 2 + n
    raise ValueError("a frame has no scan")


class Bits:
    """Reads codes and numbers from coded data, some bytes at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.word, self.held = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.held < n:
            more = self.data[self.at : self.at + 8] or b"\xff" * 8  # beyond the end: ones, as decoders pad
            self.at += 8
            self.word = (self.word << 8 * len(more)) | int.from_bytes(more, "big")
            self.held += 8 * len(more)
        self.held -= n
        out = self.word >> self.held
        self.word &= (1 << self.held) - 1
        return out

    def value(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((bits, code))) is not None:
                return found
        raise ValueError("a code is not in the table")

    def number(self, c: int) -> int:
        """The signed number of category ``c`` that follows."""
        if not c:
            return 0
        extra = self.take(c)
        return extra if extra >> (c - 1) else extra - (1 << c) + 1


def _any_table(frame: Frame, data: bytes) -> np.ndarray:
    """Differences of one lossless frame under any Huffman table, code by code."""
    bits, codes = Bits(data), frame.tables.get(frame.scan[0][1])
    if codes is None:
        raise ValueError("a frame without its Huffman table")
    out = [bits.number(bits.value(codes)) for _ in range(frame.height * frame.width)]
    return np.array(out, np.int64).astype(np.uint8)


def _zigzag() -> np.ndarray:
    """Places (8 * row + column) of the coefficients in the order in which they are coded."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
#: Rows of the discrete cosine transform.
COSINE = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def baseline_grey(frame: Frame, data: bytes) -> np.ndarray:
    """The brightness of a baseline DCT frame (height x width, uint8); colour is read over.

    ``data``: the coded data, stuffed bytes and restart markers still in it.
    """
    across, down = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    if len(frame.scan) != len(frame.parts):
        raise ValueError("only frames of one scan are read")
    if len(frame.parts) == 1:
        across = down = 1
    rows, cols = -(-frame.height // (8 * down)), -(-frame.width // (8 * across))
    coded = []
    for part, (_, dc, ac) in zip(frame.parts, frame.scan):
        try:
            coded.append((part, frame.tables[dc], frame.tables[16 + ac], frame.steps[part[3]]))
        except KeyError:
            raise ValueError("a frame without its tables") from None
    h, v = (1, 1) if len(coded) == 1 else coded[0][0][1:3]
    light = np.zeros((rows * v, cols * h, 64))
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if frame.restart else [data]
    bits, unit = None, 0
    for at in range(rows * cols):
        if at % (frame.restart or rows * cols) == 0:
            piece = pieces[unit] if unit < len(pieces) else b""
            bits, unit, last = Bits(piece.replace(b"\xff\0", b"\xff")), unit + 1, [0] * len(coded)
        for k, (part, dc, ac, steps) in enumerate(coded):
            ph, pv = (1, 1) if len(coded) == 1 else part[1:3]
            for block in range(ph * pv):
                last[k] += bits.number(bits.value(dc))
                found = {0: last[k]}
                place = 1
                while place < 64:
                    run, c = divmod(bits.value(ac), 16)
                    if not c and run < 15:
                        break
                    place += run
                    if c:
                        if place > 63:
                            raise ValueError("a block has too many coefficients")
                        found[place] = bits.number(c)
                    place += 1
                if k == 0:
                    own = light[at // cols * v + block // ph, at % cols * h + block % ph]
                    for z, x in found.items():
                        own[ZIGZAG[z]] = x * steps[z]
    cells = COSINE.T @ light.reshape(-1, 8, 8) @ COSINE
    grid = np.clip(np.rint(cells + 128), 0, 255).astype(np.uint8).reshape(rows * v, cols * h, 8, 8)
    return grid.transpose(0, 2, 1, 3).reshape(rows * v * 8, cols * h * 8)[: frame.height, : frame.width]


def grey_frames(frames: list[bytes]) -> np.ndarray:
    """Brightness samples (frames x samples, uint8) of motion-JPEG frames, lossless or baseline."""
    out = []
    for f in frames:
        at = f.index(b"\xff\xda")
        at += 2 + struct.unpack_from(">H", f, at + 2)[0]
        head = frame_head(f[:at])
        if head.sof == 0xC3:
            return decode_frames(frames)
        end = f.rfind(b"\xff\xd9")
        out.append(baseline_grey(head, f[at : end if end > 0 else len(f)]).reshape(-1))
    if len({len(x) for x in out}) > 1:
        raise ValueError("frames of several sizes")
    return np.stack(out) if out else np.zeros((0, UNIT), np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of lossless frames of one size (frames x samples, uint8)."""
    heads, coded = [], []
    for f in frames:
        at = len(HEAD)
        if f[:at] != HEAD:
            at = f.index(b"\xff\xda")
            at = frame_head(f[: at + 2 + struct.unpack_from(">H", f, at + 2)[0]]).at
        heads.append(f[:at])
        coded.append(f[at:-2].replace(b"\xff\0", b"\xff"))
    if not frames:
        return np.zeros((0, UNIT), np.uint8)
    first = frame_head(heads[0])
    if first.sof != 0xC3 or len(first.parts) != 1:
        raise ValueError("only grey lossless frames hold samples exactly")
    if first.predictor != 1:
        raise ValueError("only predictor 1 is read")
    shape = (len(frames), first.height, first.width)
    if all(h == HEAD for h in heads):
        packed = np.frombuffer(b"".join(coded), np.uint8).reshape(-1, 9)
        words = np.empty((len(packed), 8), np.uint16)
        for k in range(8):
            words[:, k] = ((packed[:, k].astype(np.uint16) << 8 | packed[:, k + 1]) >> (7 - k)) & 511
        diff = BACK[words].reshape(shape)
    else:
        diff = np.stack([_any_table(frame_head(h), c) for h, c in zip(heads, coded)]).reshape(shape)
    diff = diff.copy()
    diff[:, 0, 0] += np.uint8(128)
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(diff, axis=2, dtype=np.uint8).reshape(len(frames), -1)


def shots(samples: np.ndarray, videos: np.ndarray) -> np.ndarray:
    """True where a frame starts a shot. ``videos``: the video of each frame, in order.

    The difference of a frame is half the L1 distance of its grey histogram to the one before it. A
    cut needs more than the floor and more than the mean plus SHOT_SIGMAS deviations of the last
    SHOT_WINDOW differences of its video: the threshold follows how lively the video is.
    """
    n = len(samples)
    new = np.ones(n, bool)
    if n < 2:
        return new
    new[1:] = videos[1:] != videos[:-1]
    keys = np.arange(n, dtype=np.int64)[:, None] * BINS + (samples >> 4)
    hist = np.bincount(keys.ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.zeros(n, np.int64)  # whole numbers: a frame's sums do not depend on what lies before its video
    d[1:] = np.abs(hist[1:] - hist[:-1]).sum(1)
    d[new] = 0
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0))
    low = np.minimum(np.maximum(first + 1, at - SHOT_WINDOW), at)
    total, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    count = np.maximum(at - low, 1)
    mean = (total[at] - total[low]) / count
    var = np.maximum((squares[at] - squares[low]) / count - mean * mean, 0)
    return new | (d > np.maximum(SHOT_FLOOR * 2 * samples.shape[1], mean + SHOT_SIGMAS * np.sqrt(var)))


def clips(video: Video) -> list[tuple[int, float, float, int]]:
    """Timed clip rows of a video: clip, start second, end second, frames."""
    samples = grey_frames(video.frames)
    starts = np.flatnonzero(shots(samples, np.zeros(len(samples), np.int8)))
    ends = np.append(starts[1:], len(samples))
    return [(k, a / video.fps, b / video.fps, int(b - a)) for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))]


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def encode_bytes(data: bytes) -> bytes:
    """The AVI file of some bytes (a positive multiple of UNIT)."""
    return write_avi(encode_frames(np.frombuffer(data, np.uint8).reshape(-1, UNIT)), len(data))


def avi_features(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store each whole text as an AVI file, read it back and compute features; no shuffle.

    Per input row: id_col, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read
    back), media_bytes, media_sha256, feature ("frames:clips:crc32 of the clip starts"). A null text
    counts as empty (one frame of spaces); very long texts are stored whole; equal texts have equal
    values; repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        part: list[bytes] = []
        size = 0
        texts = batch.column(1)
        for k, t in enumerate(texts):
            part.append((t.as_py() or "").encode())
            size += len(part[-1])
            if size >= CHUNK or k + 1 == len(texts):
                rows += _features(part)
                part, size = [], 0
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *NAMES])

    return map_arrow(docs.select(id_col, text), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _features(texts: list[bytes]) -> list[tuple]:
    payloads = [padded(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    media, at = [], 0
    for p in payloads:
        n = len(p) // UNIT
        media.append(write_avi(frames[at : at + n], len(p)))
        at += n
    videos = [read_avi(m) for m in media]
    counts = np.array([len(v.frames) for v in videos])
    samples = decode_frames([f for v in videos for f in v.frames])
    cut = shots(samples, np.repeat(np.arange(len(videos)), counts))
    rows, at = [], 0
    for t, m, v, n in zip(texts, media, videos, counts.tolist()):
        back = samples[at : at + n].tobytes()[: v.length]
        starts = np.flatnonzero(cut[at : at + n]).astype("<u4")
        feature = f"{n}:{len(starts)}:{zlib.crc32(starts.tobytes()):08x}"
        rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        at += n
    return rows


def avi_clips(media: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """Timed clip rows (id_col, clip, start_s, end_s, frames, status) of a column of AVI files.

    A file that cannot be read (null, empty, cut off, not an AVI, of a kind that is not decoded) gives one
    row with nulls and the reason as its status, else the status is "ok"; a film without frames gives
    none. Repeated rows and null ids stay; other columns are ignored.
    """
    kind = dict(media.dtypes)[id_col]

    def of(m: bytes | None) -> list[tuple]:
        try:
            return [(*c, "ok") for c in clips(read_avi(m or b""))]
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return [(None, None, None, None, f"{type(e).__name__}: {e}"[:200])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *c) for k, m in enumerate(batch.column(1)) for c in of(m.as_py())]
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types))], [id_col, "clip", "start_s", "end_s", "frames", "status"])

    return map_arrow(media.select(id_col, content), run, f"`{id_col}` {kind}, clip long, start_s double, end_s double, frames long, status string")


def avi_encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, content): each text's AVI file."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [encode_bytes(padded((t.as_py() or "").encode())) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [id_col, "content"])

    return map_arrow(docs.select(id_col, F.col(text)), run, f"`{id_col}` {kind}, content binary")


def op3_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_features(documents(spark, sf_dir))
