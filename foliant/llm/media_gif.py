"""Operator 2: GIF media columns.

``encode_gif`` stores 8-bit samples losslessly as timed grey frames, 192 samples a
row; ``decode_gif`` reads any GIF: LZW code streams, global and local palettes,
interlace, transparency and disposal, giving the canvas after each frame.

``payload_rows`` turns texts into stored GIFs and their features; ``frame_rows``
turns a column of GIFs into one row a frame, with its time and colour histogram.

Null text counts as empty and is stored as one row of spaces.  Equal texts give
equal bytes.  Very long texts become frames of at most 786 432 samples each, one after the
other.  A stored form that is null or no GIF, or whose canvas or frame has more than
``MOST_SAMPLES`` samples, gives a reason in place of frames.  Repeated rows are kept, empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text

ROW, ROWS_PER_FRAME, DELAY = 192, 4096, 10
#: Samples of a canvas or frame; a larger one is refused, as it would not fit a worker.
MOST_SAMPLES = 1 << 25
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


class GifError(ValueError):
    """The bytes are no GIF that can be read."""


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of each of n codes after a clear code, for a reader's growing table."""
    known = np.minimum((1 << least) + 1 + np.arange(n), 4095)  # entries after the k-th code (the first adds none)
    return np.minimum(np.maximum(np.floor(np.log2(known + 1e-9)).astype(np.int64) + 1, least + 1), 12)


_WIDTHS_8 = _widths(4096, 8)


def lzw_encode(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples: clear, codes, ..., end; the table is cleared when full."""
    codes, widths, start = [], [], 0
    table: dict[int, int] = {}
    out, get, free, current = [], table.get, 258, -1

    def flush() -> None:
        codes.append(np.array([256, *out], np.int64))
        widths.append(np.concatenate([[9 if len(widths) == 0 else start], _WIDTHS_8[: len(out)]]))

    for sample in samples:
        if current < 0:
            current = sample
            continue
        key = current << 8 | sample
        known = get(key)
        if known is not None:
            current = known
            continue
        out.append(current)
        table[key] = free
        free += 1
        current = sample
        if free == 4096:
            out.append(current)
            flush()
            start = int(_WIDTHS_8[len(out)])
            out, free, current = [], 258, -1
            table.clear()
    if current >= 0:
        out.append(current)
    flush()
    codes.append(np.array([257], np.int64))
    widths.append(np.array([int(_WIDTHS_8[len(out)])]))
    return _bits(np.concatenate(codes), np.concatenate(widths))


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes packed from the least bit on."""
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1]) // 8 + 4, np.int64)
    shifted = codes << (starts & 7)
    at = starts >> 3
    for k in range(3):  # a code of 12 bits touches three bytes at most
        out += np.bincount(at + k, weights=(shifted >> (8 * k)) & 255, minlength=len(out))[: len(out)].astype(np.int64)
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """Samples of a code stream; at most ``most`` of them."""
    if not 1 < least < 9:
        raise GifError(f"code size {least}")
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    words = bits[:-2] | bits[1:-1] << 8 | bits[2:] << 16
    total, clear, at, out, size = 8 * len(data), 1 << least, 0, [], 0
    singles = [bytes((k,)) for k in range(clear)]
    schedule = _WIDTHS_8 if least == 8 else _widths(4096, least)
    full = int(schedule[-1])
    while at < total and size < most:
        # all codes up to the next clear or end code, whose widths depend on their number alone
        n = min(4096, (total - at) // (least + 1) + 1)
        ends = at + np.cumsum(schedule[:n])
        n = int(np.searchsorted(ends, total, "right"))
        if n == 0:
            break
        widths = schedule[:n]
        starts = ends[:n] - widths
        codes = (words[starts >> 3] >> (starts & 7)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else -1
        part = codes[:stop] if stop >= 0 else codes
        table, last = [*singles, b"", b""], b""
        add = table.append
        for code in part.tolist():
            if last:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise GifError(f"code {code} is not known yet")
                if len(table) < 4096:
                    add(last + entry[:1])
            elif code < clear:
                entry = table[code]
            else:
                raise GifError(f"code {code} comes first")
            out.append(entry)
            size += len(entry)
            last = entry
        at = int(ends[stop]) if stop >= 0 else int(ends[n - 1])
        if stop >= 0 and codes[stop] == clear + 1:
            break
        if stop < 0 and n == 4096:  # a full table that goes on without a clear code
            rest, size = _after_full(words, at, total, full, clear, table, last, most - size), size
            out.append(rest)
            break
    return b"".join(out)[:most]


def _after_full(words, at, total, width, clear, table, last, most) -> bytes:
    out, size = [], 0
    while at + width <= total and size < most:
        code = int(words[at >> 3] >> (at & 7)) & ((1 << width) - 1)
        at += width
        if code == clear:
            out.append(lzw_decode_tail(words, at, total, clear, most - size))
            break
        if code == clear + 1:
            break
        out.append(table[code])
        size += len(table[code])
    return b"".join(out)


def lzw_decode_tail(words, at, total, clear, most) -> bytes:
    """What follows a late clear code, from the middle of the stream."""
    raw = (words & 255).astype(np.uint8)[at >> 3 :]
    shift = at & 7
    moved = (raw.astype(np.int64) | np.append(raw[1:], 0).astype(np.int64) << 8) >> shift & 255
    n = (total - at + 7) // 8
    return lzw_decode(moved[:n].astype(np.uint8).tobytes(), clear.bit_length() - 1, most)


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes, then the empty one."""
    whole = len(data) // 255
    head = np.empty((whole, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8)[: whole * 255].reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes((len(rest),)) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes, delay: int = DELAY) -> bytes:
    """Grey frames of up to 4096 rows of 192 samples, kept on the canvas, ``delay``
    hundredths of a second each.  The payload is a positive multiple of 192 bytes."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, ROWS_PER_FRAME), 0xF7, 0, 0), _GREY]
    for first in range(0, rows, ROWS_PER_FRAME):
        n = min(ROWS_PER_FRAME, rows - first)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, n, 0), b"\x08"]
        out.append(_blocks(lzw_encode(payload[first * ROW : (first + n) * ROW])))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    index: int
    left: int
    top: int
    width: int
    height: int
    #: Hundredths of a second.
    delay: int
    start: int
    disposal: int
    transparent: int | None
    #: The canvas while this frame shows: height x width x 4 (the last is 0 where nothing was drawn).
    canvas: np.ndarray


def decode_gif(data: bytes, most_samples: int = MOST_SAMPLES) -> Iterator[Frame]:
    """The frames in order.  Raises GifError for what can't be read; a stream that
    ends early gives what it has, the rest of its frame undrawn."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_samples:
        raise GifError("canvas too large")
    at, palette = 13, None

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("palette cut off")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        out = []
        while at < len(data) and (n := data[at]):
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(out), at + 1

    if flags & 0x80:
        palette, at = colours(at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = start = index = 0
    transparent = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, colour = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, colour if bits & 1 else None
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise GifError(f"block {kind} at {at}")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at, own = at + 10, palette
        if bits & 0x80:
            own, at = colours(at, bits)
        if own is None:
            raise GifError("no palette")
        if w * h > most_samples or at >= len(data):
            raise GifError("frame too large or cut off")
        least, (stream, at) = data[at], sub_blocks(at + 1)
        samples = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
        drawn = np.zeros(w * h, bool)
        drawn[: len(samples)] = True
        indices = np.zeros(w * h, np.uint8)
        indices[: len(samples)] = samples
        indices, drawn = indices.reshape(h, w), drawn.reshape(h, w)
        if bits & 0x40:  # rows come as every 8th, 8th from 4, 4th from 2, 2nd from 1
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            back = np.empty(h, int)
            back[order] = np.arange(h)
            indices, drawn = indices[back], drawn[back]
        if transparent is not None:
            drawn = drawn & (indices != transparent)
        if len(samples) and int(samples.max()) >= len(own):
            raise GifError("sample beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        area = (slice(top, min(top + h, height)), slice(left, min(left + w, width)))
        seen = (slice(0, max(0, min(h, height - top))), slice(0, max(0, min(w, width - left))))
        patch = canvas[area]
        mask = drawn[seen]
        patch[mask, :3] = own[indices[seen][mask]]
        patch[mask, 3] = 255
        yield Frame(index, left, top, w, h, delay, start, disposal, transparent, canvas.copy())
        if disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before
        start, index = start + delay, index + 1
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame) -> list[int]:
    """Samples by colour, 4 levels of red, green and blue (64 bins), then undrawn ones."""
    pixels = frame.canvas.reshape(-1, 4)
    shown = pixels[pixels[:, 3] > 0, :3] >> 6
    bins = np.bincount((shown[:, 0].astype(np.int64) << 4 | shown[:, 1].astype(np.int64) << 2 | shown[:, 2]), minlength=64)
    return [*bins.tolist(), len(pixels) - len(shown)]


def read_payload(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """Payload, grey histogram, frames and hundredths of a second of a stored payload."""
    parts, total, frames = [], 0, 0
    for frame in decode_gif(media):
        parts.append(frame.canvas[: frame.height, : frame.width, 0].tobytes())
        total, frames = frame.start + frame.delay, frames + 1
    payload = b"".join(parts)
    return payload, np.bincount(np.frombuffer(payload, np.uint8), minlength=256), frames, total


_ROWS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _payload_rows(keep_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                media = encode_gif(raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)))
                payload, grey, frames, total = read_payload(media)
                # 16 bins of grey, in thousandths, and how the frames are timed
                feature = f"frames={frames};cs={total};grey=" + ",".join(str(int(x) * 1000 // len(payload)) for x in grey.reshape(16, 16).sum(1))
                row = {"doc_id": doc_id, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}
                rows.append(row | {"media": media} if keep_media else row)
            names = [x.split()[0] for x in _ROWS.split(", ")]
            kinds = [pa.int64() if " long" in x else pa.string() for x in _ROWS.split(", ")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*zip(names, kinds, strict=True), *([("media", pa.binary())] if keep_media else [])]))

    return run


def payload_rows(docs: DataFrame, keep_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its stored form, read back; with ``keep_media`` its bytes too."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_payload_rows(keep_media), _ROWS + ", media binary" * keep_media)


_FRAMES = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int32()), ("delay_cs", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64())), ("canvas_sha256", pa.string()), ("reason", pa.string())])


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for media_id, media in zip(batch.column("media_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            rows = []
            try:
                for f in decode_gif(media or b""):
                    rows.append({"media_id": media_id, "frame": f.index, "start_cs": f.start, "delay_cs": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f), "canvas_sha256": hashlib.sha256(f.canvas.tobytes()).hexdigest()})
            except GifError as bad:
                rows.append({"media_id": media_id, "reason": str(bad)})
            yield pa.RecordBatch.from_pylist(rows, _FRAMES)


def frame_rows(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a frame; media that can't be read give a row with a reason (after the
    frames before the damage)."""
    source = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media"))
    ddl = "media_id long, frame int, start_cs int, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, canvas_sha256 string, reason string"
    return source.mapInArrow(_frame_rows, ddl)
