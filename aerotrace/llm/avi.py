"""AVI motion-JPEG: RIFF indexes, intra frames, shots by adaptive histogram differences, timed clip rows.

`encode_payload` stores bytes without loss as a picture stream: each byte is one 8x8 block of one grey level. With a
DC quantiser of 8 a block's DC coefficient is the level itself, so the frames are baseline JPEG that any decoder
shows as flat squares. The Huffman table gives the category of c bits a code of 9 - c bits, so that every block
takes 9 bits and a one-bit end mark; four blocks are five bytes, which is what makes it fast here.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, ROWS, FPS = 64, 64, 25
BINS = 16
#: A shot starts where the histogram difference exceeds the mean of the last WINDOW ones by SPREAD deviations, and FLOOR.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.08

# The zigzag order of JPEG.
ZIGZAG = np.array([x[2] for x in sorted(((r + c, (r if (r + c) % 2 else c), 8 * r + c) for r in range(8) for c in range(8)))])


def _segment(mark: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63),
    _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))) + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + b"\x00") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
)


def _codes() -> np.ndarray:
    """For each difference from -255 to 255 its ten bits: category, value, end mark."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2 if c else 0b111111110
        out[d + 255] = ((code << c | (d if d >= 0 else d + (1 << c) - 1)) << 1) & 1023
    return out


_CODES = _codes()
_VALUES = np.zeros(1024, np.int16)
_VALUES[_CODES.astype(np.int64)] = np.arange(-255, 256)


def encode_frame(levels: np.ndarray, rows: int) -> bytes:
    """rows x 64 levels as one JPEG picture."""
    diff = np.diff(levels.astype(np.int16), prepend=np.int16(128))
    ten = _CODES[diff + 255].reshape(-1, 4)
    forty = ten[:, 0] << np.uint64(30) | ten[:, 1] << np.uint64(20) | ten[:, 2] << np.uint64(10) | ten[:, 3]
    data = forty.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size = struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0])
    return _HEAD[0] + _segment(0xC0, size) + _HEAD[1] + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, extra: bytes = b"") -> bytes:
    """A RIFF AVI file of JPEG frames with an idx1 index; extra chunks go before the frames."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + head + extra + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> dict:
    """Frames (start, length), fps, size and other chunks. Without an idx1 index the movi list is walked.

    Raises ValueError for what is not an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"frames": [], "fps": FPS, "width": 0, "height": 0, "chunks": {}}
    index, movi = None, None

    def walk(at: int, end: int) -> None:
        nonlocal index, movi
        while at + 8 <= end:
            kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, min(end, at + 8 + n))
                else:
                    walk(at + 12, min(end, at + 8 + n))
            elif kind == b"avih":
                micro = struct.unpack_from("<I", data, at + 8)[0]
                out["fps"] = 1_000_000 / micro if micro else FPS
                out["width"], out["height"] = struct.unpack_from("<II", data, at + 8 + 32)
            elif kind == b"idx1":
                index = (at + 8, n)
            else:
                out["chunks"][kind] = data[at + 8 : at + 8 + n]
            at += 8 + n + n % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi and index:
        for kind, _, offset, n in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]):
            if kind[2:] in (b"dc", b"db"):
                base = movi[0] + offset if data[movi[0] + offset : movi[0] + offset + 4] == kind else offset
                out["frames"].append((base + 8, n))
    elif movi:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind[2:] in (b"dc", b"db"):
                out["frames"].append((at + 8, n))
            at += 8 + n + n % 2
    return out


def _tables(data: bytes) -> dict:
    """Segments of a JPEG picture up to its scan."""
    out, at = {"quant": {}, "huff": {}, "restart": 0}, 2
    while at + 4 <= len(data):
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                out["quant"][k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif mark in (0xC0, 0xC1):
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["parts"] = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only sequential JPEG frames are read")
        elif mark == 0xC4:
            while body:
                counts, k = body[1:17], body[0]
                symbols, code, table, i = body[17 : 17 + sum(counts)], 0, {}, 0
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = symbols[i]
                        code, i = code + 1, i + 1
                    code <<= 1
                out["huff"][k] = table
                body = body[17 + i :]
        elif mark == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            out["scan"] = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            out["at"] = at + 2 + n
            return out
        at += 2 + n
    raise ValueError("a JPEG frame without a scan")


def _flat(data: bytes) -> np.ndarray | None:
    """Levels of a frame of encode_frame, or None for any other."""
    start = len(_HEAD[0]) + 15 - 2 + len(_HEAD[1])
    if not data.startswith(_HEAD[0]) or data[start - len(_HEAD[1]) : start] != _HEAD[1]:
        return None
    five = np.frombuffer(data[start:-2].replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 5).astype(np.uint64)
    forty = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
    ten = np.stack([forty >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).reshape(-1)
    return (np.cumsum(_VALUES[ten.astype(np.int64)], dtype=np.int64) + 128).astype(np.uint8)


_BASIS = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def decode_frame(data: bytes) -> np.ndarray:
    """The luma plane of a sequential JPEG picture, any tables and sampling, restarts included."""
    t = _tables(data)
    end = data.rfind(b"\xff\xd9")
    scan = data[t["at"] : end if end > 0 else len(data)]
    pieces, at = [], 0
    while at < len(scan):  # restart marks cut the scan
        nxt = next((i for i in range(at, len(scan) - 1) if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7), len(scan))
        pieces.append(scan[at:nxt].replace(b"\xff\x00", b"\xff"))
        at = nxt + 2
    hmax, vmax = max(p[1] for p in t["parts"]), max(p[2] for p in t["parts"])
    across, down = -(-t["width"] // (8 * hmax)), -(-t["height"] // (8 * vmax))
    cid, lh, lv, lq = t["parts"][0]
    coefficients = np.zeros((down * lv, across * lh, 64), np.int32)
    mcu, total = 0, across * down
    for piece in pieces:
        bits, n, pos = int.from_bytes(piece, "big"), 8 * len(piece), 0
        before = dict.fromkeys((p[0] for p in t["parts"]), 0)

        def take(count: int) -> int:
            nonlocal pos
            if pos + count > n:
                raise ValueError("a JPEG scan ends early")
            pos += count
            return bits >> (n - pos) & ((1 << count) - 1)

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code that the table lacks")

        def value(count: int) -> int:
            v = take(count)
            return v if not count or v >> (count - 1) else v - (1 << count) + 1

        last = min(total, mcu + t["restart"]) if t["restart"] else total
        while mcu < last:
            for part, h, v, _ in t["parts"]:
                dc, ac = t["huff"][t["scan"][part] >> 4], t["huff"][0x10 | t["scan"][part] & 15]
                for block in range(h * v):
                    out = np.zeros(64, np.int32)
                    before[part] += value(symbol(dc))
                    out[0], k = before[part], 1
                    while k < 64 and (s := symbol(ac)):
                        k += s >> 4
                        if s & 15:
                            out[ZIGZAG[k]] = value(s & 15)
                        k += 1
                    if part == cid:
                        coefficients[mcu // across * v + block // h, mcu % across * h + block % h] = out
            mcu += 1
    quant = np.zeros(64, np.int32)
    quant[ZIGZAG] = t["quant"][lq]
    blocks = (coefficients * quant).reshape(*coefficients.shape[:2], 8, 8)
    pixels = np.clip(np.rint(np.einsum("xu,abuv,yv->abxy", _BASIS, blocks, _BASIS)) + 128, 0, 255).astype(np.uint8)
    plane = pixels.swapaxes(1, 2).reshape(coefficients.shape[0] * 8, -1)
    return plane[: -(-t["height"] * lv // vmax), : -(-t["width"] * lh // hmax)]


def encode_payload(payload: bytes) -> bytes:
    """An AVI file that holds the payload, a positive multiple of 64 bytes, without loss."""
    rows = len(payload) // UNIT
    frames = -(-rows // ROWS)
    each = -(-rows // frames)
    levels = np.frombuffer(payload, np.uint8)
    levels = np.concatenate((levels, np.zeros(frames * each * UNIT - len(levels), np.uint8))).reshape(frames, -1)
    return write_avi([encode_frame(x, each) for x in levels], UNIT * 8, each * 8, extra=_chunk(b"plen", struct.pack("<Q", len(payload))))


def decode_levels(avi: bytes) -> tuple[dict, list[np.ndarray]]:
    """Header and the samples of each frame: block levels where frames are flat, else luma pixels."""
    head = read_avi(avi)
    out = []
    for at, n in head["frames"]:
        frame = avi[at : at + n]
        flat = _flat(frame)
        out.append(decode_frame(frame).reshape(-1) if flat is None else flat)
    return head, out


def decode_payload(avi: bytes) -> bytes:
    head, frames = decode_levels(avi)
    return b"".join(x.tobytes() for x in frames)[: struct.unpack("<Q", head["chunks"][b"plen"])[0]]


def shots(frames: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[float]]:
    """Frame ranges (first, last) between cuts, and the histogram differences between neighbours."""
    if not frames:
        return [], []
    h = np.stack([np.bincount(x >> 4, minlength=BINS) / max(1, len(x)) for x in frames])
    diff = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(diff):
        past = diff[max(cuts[-1], i - WINDOW) : i]
        mean, dev = (past.mean(), past.std()) if len(past) else (0.0, 0.0)
        if d > max(FLOOR, mean + SPREAD * dev):
            cuts.append(i + 1)
    return list(zip(cuts, [*(c - 1 for c in cuts[1:]), len(frames) - 1], strict=True)), diff.tolist()


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, clip, first_frame, last_frame, start_ms, end_ms) of every AVI file; none for nulls and other bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("media"), strict=True):
                try:
                    head, frames = decode_levels(data.as_py() or b"")
                except (ValueError, KeyError, struct.error):
                    continue
                rows += [(key, i, a, b, round(a * 1000 / head["fps"]), round((b + 1) * 1000 / head["fps"])) for i, (a, b) in enumerate(shots(frames)[0])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()), strict=True)], ["id", "clip", "first_frame", "last_frame", "start_ms", "end_ms"])

    rows = media.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "id bigint, clip int, first_frame int, last_frame int, start_ms bigint, end_ms bigint")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = 256, most: int = 1 << 24) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an AVI file.

    Null counts as empty; repeated rows stay; other columns are ignored; an empty table gives an empty one. Batches hold
    at_once files of `most` bytes together at most, or one file of any size that RIFF can have (texts of some 3 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        ids, sizes, media, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                one = encode_payload(raw + b"\0" * ((-len(raw)) % UNIT if raw else UNIT))
                if ids and (len(ids) == at_once or held + len(one) > most):
                    yield done()
                    ids, sizes, media, held = [], [], [], 0
                ids.append(key)
                sizes.append(len(raw))
                media.append(one)
                held += len(one)
        if ids:
            yield done()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What the stored media hold, read back: payload and media digests and a feature string of the shots."""

    def row(avi: bytes) -> tuple:
        head, frames = decode_levels(avi)
        payload = b"".join(x.tobytes() for x in frames)[: struct.unpack("<Q", head["chunks"][b"plen"])[0]]
        cut, diff = shots(frames)
        feature = f"avi {head['width']}x{head['height']} frames={len(frames)} ms={round(len(frames) * 1000 / head['fps'])} shots={','.join(f'{a}-{b}' for a, b in cut)} diff={round(1e6 * sum(diff))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(avi), hashlib.sha256(avi).hexdigest(), feature

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column("media")]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every row's stored text. Null counts as empty; equal texts have equal values; repeated rows stay."""
    return digests(media_column(docs, id_col, text_col))
