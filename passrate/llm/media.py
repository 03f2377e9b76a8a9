"""Baseline JPEG media columns: marker parsing, Huffman decoding, DC-only luminance thumbnails, thumbnail hashes.

The decoder reads what baseline JPEG allows: any number of components and
sampling factors, several scans, restart intervals, stuffed bytes.  A scan's
restart intervals are decoded side by side, one lane each, in numpy; images
with equal tables and layout share the lanes.  Only DC terms are kept: a block
gives one pixel of the thumbnail, its mean luminance.

The encoder stores bytes losslessly: one flat 8 by 8 block a byte, with a DC
quantiser of 8, so that the quantised DC term is the byte less 128 and the
DC-only thumbnail is the payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import CHUNK_BYTES, by_batch, unused

UNIT = 576
#: Blocks between restart markers: divides UNIT, so an interval never spans two payloads.
INTERVAL = 96
NARROW, WIDE, ROWS = 24, 576, 1820
#: Payload bytes of one image; longer payloads are several images, one after the other.
IMAGE_BYTES = WIDE * ROWS
_DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_DC_SYMBOLS = bytes(range(12))
_AC_COUNTS = bytes([1] + [0] * 15)
_AC_SYMBOLS = b"\0"
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class JpegError(ValueError):
    """What a file breaks of baseline JPEG."""


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """For every 16 bits ahead: the code's length (0: none) and symbol; and each symbol's code and length."""
    lengths, values, codes = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), {}
    code, at = 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            if at >= len(symbols) or code >= 1 << size:
                raise JpegError("a Huffman table has too many codes")
            low = code << (16 - size)
            lengths[low : low + (1 << (16 - size))] = size
            values[low : low + (1 << (16 - size))] = symbols[at]
            codes[symbols[at]] = (code, size)
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, values, codes


# -- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _header(wide: int, high: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([8] + [16] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS),
        _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


@lru_cache(maxsize=1)
def _encoder_tables():
    """Per difference + 255: the bits of category, difference and end of block, and their number."""
    codes = huffman(_DC_COUNTS, _DC_SYMBOLS)[2]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, size = codes[category]
        bits[d + 255] = ((code << category) | (d if d >= 0 else d + (1 << category) - 1)) << 1
        sizes[d + 255] = size + category + 1
    return bits, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of UNIT, at most IMAGE_BYTES) as a grey baseline JPEG."""
    raw = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, INTERVAL) - 128
    difference = raw.copy()
    difference[:, 1:] -= raw[:, :-1]
    bit_of, size_of = _encoder_tables()
    bits, sizes = bit_of[difference + 255], size_of[difference + 255]
    ends = np.cumsum(sizes, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(n_bytes) - n_bytes
    at = 8 * starts[:, None] + ends - sizes
    word = (bits << (24 - (at & 7) - sizes)).ravel()
    byte = (at >> 3).ravel()
    total = int(n_bytes.sum())
    out = np.bincount(byte, word >> 16, total + 2) + np.bincount(byte + 1, word >> 8 & 255, total + 2) + np.bincount(byte + 2, word & 255, total + 2)
    out = out[:total].astype(np.uint8)
    out[starts + n_bytes - 1] |= ((1 << (8 * n_bytes - ends[:, -1])) - 1).astype(np.uint8)
    stuffed = out == 255
    shift = np.cumsum(stuffed) - stuffed
    interval = np.repeat(np.arange(len(starts)), n_bytes)
    place = np.arange(total) + shift + 2 * interval
    counts = np.array([len(p) // INTERVAL for p in payloads])
    first = np.cumsum(counts) - counts
    stream = np.zeros(total + int(stuffed.sum()) + 2 * len(starts), np.uint8)
    stream[place] = out
    end = place[starts + n_bytes - 1] + 1 + stuffed[starts + n_bytes - 1]
    stream[end] = 255
    stream[end + 1] = 0xD0 + (np.arange(len(starts)) - np.repeat(first, counts)) % 8
    images, begin = [], place[starts]
    for p, f, c in zip(payloads, first.tolist(), counts.tolist(), strict=True):
        wide = NARROW if len(p) <= NARROW * 8190 else WIDE
        images.append(_header(wide, len(p) // wide) + stream[begin[f] : end[f + c - 1]].tobytes() + b"\xff\xd9")
    return images


# -- decoding


@dataclass
class Scan:
    parts: list[tuple[int, int, int, bytes, bytes]]  # component, blocks across and down in a unit, DC and AC table
    units: int
    interval: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quantiser: dict[int, int] = field(default_factory=dict)  # DC terms
    scans: list[Scan] = field(default_factory=list)
    end: int = 0

    def size(self, component: int) -> tuple[int, int]:
        """Blocks of a component across and down, to whole units."""
        _, across, down, _ = self.components[component]
        most_across, most_down = (max(c[k] for c in self.components) for k in (1, 2))
        return -(-self.width // (8 * most_across)) * across, -(-self.height // (8 * most_down)) * down


def parse(data: bytes, start: int = 0) -> Image:
    """The markers of one image, from its SOI to its EOI."""
    if data[start : start + 2] != b"\xff\xd8":
        raise JpegError("no SOI")
    image, tables, interval, at = Image(), {}, 0, start + 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            image.end = at + 2
            break
        if at + 4 > len(data):
            raise JpegError("the file ends in a marker")
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise JpegError("the file ends in a segment")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                if len(body) < wide + 1:
                    raise JpegError("a quantiser is short")
                image.quantiser[body[0] & 15] = body[1] << 8 | body[2] if wide == 128 else body[1]
                body = body[wide + 1 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not image.height or not image.width or len(body) < 6 + 3 * n:
                raise JpegError("not an 8-bit frame")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("not baseline")
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker == 0xDA:
            at = _read_scan(data, at, body, image, tables, interval)
    if not image.scans:
        raise JpegError("no scan")
    return image


def _read_scan(data: bytes, at: int, body: bytes, image: Image, tables: dict, interval: int) -> int:
    ids = [c[0] for c in image.components]
    parts = []
    for k in range(body[0]):
        which = ids.index(body[1 + 2 * k]) if body[1 + 2 * k] in ids else -1
        dc, ac = body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)
        if which < 0 or dc not in tables or ac not in tables:
            raise JpegError("a scan names a missing component or table")
        _, across, down, _ = image.components[which]
        parts.append((which, *((across, down) if body[0] > 1 else (1, 1)), tables[dc], tables[ac]))
    if len(parts) > 1:
        across, down = image.size(parts[0][0])
        units = across // parts[0][1] * (down // parts[0][2])
    else:  # blocks of a lone component stop at the picture's edge
        across, down = _own_size(image, parts[0][0])
        units = across * down
    found = _SCAN_END.search(data, at)
    if not found:
        raise JpegError("a scan has no end")
    image.scans.append(Scan(parts, units, interval, data[at : found.start()]))
    return found.start()


def _own_size(image: Image, component: int) -> tuple[int, int]:
    _, across, down, _ = image.components[component]
    most_across, most_down = (max(c[k] for c in image.components) for k in (1, 2))
    return -(-(-(-image.width * across // most_across)) // 8), -(-(-(-image.height * down // most_down)) // 8)


def _lanes(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scans' bytes without stuffing and restart markers; each interval's first bit and units."""
    raw = np.frombuffer(b"".join(s.data for s in scans), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(s.data) for s in scans])))
    mark = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
    following = raw[mark + 1] if len(mark) else np.zeros(0, np.uint8)
    keep = np.ones(len(raw), bool)
    keep[mark[following == 0] + 1] = False
    restart = mark[(following >= 0xD0) & (following <= 0xD7)]
    keep[restart] = keep[restart + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    starts, units = [], []
    for k, scan in enumerate(scans):
        own = restart[(restart >= edges[k]) & (restart < edges[k + 1])] if len(scans) < 8 else restart[np.searchsorted(restart, edges[k]) : np.searchsorted(restart, edges[k + 1])]
        step = scan.interval or scan.units
        if len(own) + 1 != -(-scan.units // step):
            raise JpegError("restart markers do not fit the picture")
        starts.append(np.concatenate(([edges[k]], own + 2)))
        size = np.full(len(own) + 1, step)
        size[-1] = scan.units - step * len(own)
        units.append(size)
    return np.concatenate([raw[keep], np.zeros(8, np.uint8)]), 8 * place[np.concatenate(starts)], np.concatenate(units)


def _dc_terms(scans: list[Scan]) -> list[dict[int, np.ndarray]]:
    """Quantised DC terms of scans of one layout: per scan and component, units by blocks of a unit."""
    data, position, units = _lanes(scans)
    word = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    limit = len(word) - 1
    parts, steps, n = scans[0].parts, int(units.max()), len(units)
    if (units != units[0]).any():
        order = np.argsort(-units, kind="stable")
    else:
        order = np.arange(n)
    position, left = position[order].astype(np.int64), units[order]
    dc = [np.zeros(n, np.int64) for _ in parts]
    out = [np.zeros((n, steps, p[1] * p[2]), np.int32) for p in parts]

    def peek(pos):
        return word[np.minimum(pos >> 3, limit)] >> (16 - (pos & 7)).astype(np.uint32) & 0xFFFF

    for step in range(steps):
        live = int(np.searchsorted(-left, -step, side="left"))  # lanes with a unit left
        pos = position[:live]
        for k, part in enumerate(parts):
            dc_length, dc_value, _ = huffman(*part[3])
            ac_length, ac_value, _ = huffman(*part[4])
            for block in range(part[1] * part[2]):
                ahead = peek(pos)
                size, category = dc_length[ahead], dc_value[ahead].astype(np.int64)
                if not size.all():
                    raise JpegError("a code is in no table")
                pos = pos + size
                got = (peek(pos) >> (16 - np.minimum(category, 16)).astype(np.uint32)).astype(np.int64)
                pos += category
                low = (1 << category) >> 1
                dc[k][:live] += got - np.where(got < low, (1 << category) - 1, 0)
                out[k][:live, step, block] = dc[k][:live]
                where, term = None, None
                while True:  # AC terms are passed over
                    ahead = peek(pos if where is None else pos[where])
                    size, value = ac_length[ahead], ac_value[ahead]
                    if not size.all():
                        raise JpegError("a code is in no table")
                    if where is None:
                        pos += size
                        if not value.any():
                            break
                        where, term = np.arange(live), np.ones(live, np.int64)
                    else:
                        pos[where] += size
                    extra, run = (value & 15).astype(np.int64), (value >> 4).astype(np.int64)
                    pos[where] += extra
                    term[where] += run + 1
                    more = ((extra > 0) | (run == 15)) & (term[where] < 64)
                    where = where[more]
                    if not len(where):
                        break
        position[:live] = pos
    if (position > 8 * len(data)).any():
        raise JpegError("a scan is short")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    result, at = [], 0
    for scan in scans:
        step = scan.interval or scan.units
        count = -(-scan.units // step)
        lanes = back[at : at + count]
        result.append({p[0]: out[k][lanes].reshape(-1, p[1] * p[2])[: scan.units] for k, p in enumerate(parts)})
        at += count
    return result


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The mean of each luminance block, 0 to 255, as a picture an eighth of the size."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, image in enumerate(images):
        for scan in image.scans:
            if any(p[0] == 0 for p in scan.parts):
                groups.setdefault((tuple(scan.parts), scan.interval), []).append((i, scan))
    for members in groups.values():
        for (i, scan), terms in zip(members, _dc_terms([s for _, s in members]), strict=True):
            image, part = images[i], next(p for p in scan.parts if p[0] == 0)
            across, down = part[1], part[2]
            wide, high = image.size(0) if len(scan.parts) > 1 else _own_size(image, 0)
            grid = terms[0].reshape(high // down, wide // across, down, across).transpose(0, 2, 1, 3).reshape(high, wide)
            wide, high = _own_size(image, 0)
            mean = grid[:high, :wide] * (image.quantiser[image.components[0][3]] / 8) + 128
            out[i] = np.clip(np.rint(mean), 0, 255).astype(np.uint8)
    if any(o is None for o in out):
        raise JpegError("no luminance scan")
    return out


def thumbnail_hash(picture: np.ndarray) -> str:
    """64 bits: is each of 8 rows of 9 cells darker than its right neighbour?  Small pictures repeat cells."""
    rows, columns = (np.arange(k + 1) * n // k for k, n in ((8, picture.shape[0]), (9, picture.shape[1])))
    table = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1))
    table[1:, 1:] = np.cumsum(np.cumsum(picture, axis=0, dtype=np.int64), axis=1)
    r0, r1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    c0, c1 = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    cell = (table[np.ix_(r1, c1)] - table[np.ix_(r0, c1)] - table[np.ix_(r1, c0)] + table[np.ix_(r0, c0)]) / area
    return np.packbits(cell[:, :-1] < cell[:, 1:]).tobytes().hex()


def decode_all(data: bytes) -> list[Image]:
    """The images of a file that holds one or more, one after the other."""
    out, at = [], 0
    while at < len(data):
        image = parse(data, at)
        out.append(image)
        at = image.end
    return out


# -- columns


def _padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def _groups(sizes: list[int], limit: int = CHUNK_BYTES):
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def stored_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text as JPEG, read it back and describe it.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (and media with `keep_media`).  The payload is the
    text's UTF-8 with bytes 255 up to a positive multiple of 576; all payload
    columns come from the bytes read back.  The feature is each image's
    dimensions and thumbnail hash.  A null text is empty; a null doc_id stays
    null; repeated rows each get a row; other columns are ignored; an empty
    table gives an empty result.  No shuffle.
    """

    def run(batch: pa.RecordBatch):
        texts = [(v.as_py() or "").encode() for v in batch.column("text")]
        padded = [_padded(t) for t in texts]
        for a, b in _groups([len(p) for p in padded]):
            pieces = [(k, p[i : i + IMAGE_BYTES]) for k, p in enumerate(padded[a:b]) for i in range(0, len(p), IMAGE_BYTES)]
            media = [b""] * (b - a)
            for x, y in _groups([len(p) for _, p in pieces]):
                for (k, _), image in zip(pieces[x:y], encode([p for _, p in pieces[x:y]]), strict=True):
                    media[k] += image
            found = [(k, image) for k, m in enumerate(media) for image in decode_all(m)]
            payload, feature = [[] for _ in media], [[] for _ in media]
            for x, y in _groups([i.width * i.height // 64 for _, i in found]):
                for (k, image), picture in zip(found[x:y], thumbnails([i for _, i in found[x:y]]), strict=True):
                    payload[k].append(picture.tobytes())
                    feature[k].append(f"{image.width}x{image.height}:{thumbnail_hash(picture)}")
            read = [b"".join(p) for p in payload]
            columns = [
                batch.column("doc_id").slice(a, b - a),
                pa.array([len(t) for t in texts[a:b]], pa.int64()),
                pa.array([len(p) for p in read], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in read]),
                pa.array([zlib.crc32(p[-32:]) for p in read], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array([",".join(f) for f in feature]),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if keep_media:
                columns, names = [*columns, pa.array(media, pa.binary())], [*names, "media"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run), schema)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """Add width, height, thumbnail (its bytes, by rows), thumbnail_hash and error to a table with a JPEG column.

    A null or broken file has an error and nulls; of several images the first
    counts.  Where the table has a column of such a name already, the new one's
    name ends in as many underscores as make it new.  Repeated rows each get
    their columns; an empty table gives an empty result.
    """
    names = media.columns
    added: list[str] = []
    for name in ("width", "height", "thumbnail", "thumbnail_hash", "error"):
        added.append(unused(name, [*names, *added]))

    def one(data: bytes | None):
        try:
            if data is None:
                raise JpegError("null")
            image = parse(data)
            picture = thumbnails([image])[0]
            return image.width, image.height, picture.tobytes(), thumbnail_hash(picture), None
        except (JpegError, KeyError, IndexError, struct.error, ZeroDivisionError) as error:
            return None, None, None, None, str(error)

    def run(batch: pa.RecordBatch):
        rows = [one(v.as_py()) for v in batch.column(names.index(column))]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*names, *added])

    from pyspark.sql.types import StructType

    more = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in zip(added, ("int", "int", "binary", "string", "string"), strict=True)))
    return media.mapInArrow(by_batch(run), StructType([*media.schema.fields, *more.fields]))
