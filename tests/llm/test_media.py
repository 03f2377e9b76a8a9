"""JPEG storage: exact round trip, a plain bit-by-bit decoder, broken files."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from passrate.llm import media
from tests.llm.conftest import odd_rows, table_of


def bits_of(scan: bytes) -> str:
    return "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))


def plain_dc(data: bytes) -> list[int]:
    """The samples of one of our images, one bit at a time."""
    start = data.index(b"\xff\xda") + 10
    body = data[start:-2]
    parts, at, last = [], 0, 0
    while at < len(body) - 1:
        if body[at] == 255 and 0xD0 <= body[at + 1] <= 0xD7:
            parts.append(body[last:at])
            last = at + 2
            at += 2
        else:
            at += 2 if body[at] == 255 else 1
    parts.append(body[last:])
    codes = {format(c, f"0{s}b"): v for v, (c, s) in media.huffman(media._DC_COUNTS, media._DC_SYMBOLS)[2].items()}
    out = []
    for part in parts:
        bits, value = bits_of(part), 0
        at = 0
        for _ in range(media.INTERVAL):
            end = at + 1
            while bits[at:end] not in codes:
                end += 1
            n = codes[bits[at:end]]
            raw = int(bits[end : end + n] or "0", 2)
            value += raw if not n or raw >> (n - 1) else raw - (1 << n) + 1
            out.append(value + 128)
            assert bits[end + n] == "0"
            at = end + n + 1
        assert set(bits[at:]) <= {"1"}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stored_bytes_by_a_plain_decoder(seed):
    rng = random.Random(seed)
    payload = bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(576 * (1 + 2 * seed)))
    (image,) = media.encode([payload])
    assert bytes(plain_dc(image)) == payload
    assert media.thumbnails([media.parse(image)])[0].tobytes() == payload


def test_rows(spark):
    rows = odd_rows() + [(None, "no id"), (None, None), (100, "é" * 4000), (100, "é" * 4000)]
    got = sorted((tuple(r[:8]) for r in media.stored_texts(table_of(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        (image,) = media.encode([payload])
        picture = media.thumbnails([media.parse(image)])[0]
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), f"{8 * picture.shape[1]}x{8 * picture.shape[0]}:{media.thumbnail_hash(picture)}"))
    assert got == sorted(want, key=str)
    assert media.stored_texts(table_of(spark, rows).where("doc_id < 0")).count() == 0


def test_payloads_of_several_images(monkeypatch, spark):
    monkeypatch.setattr(media, "IMAGE_BYTES", 1152)
    text = "".join(map(chr, range(40, 120))) * 40
    pieces = [media._padded(text.encode())[i : i + 1152] for i in range(0, len(media._padded(text.encode())), 1152)]
    joined = b"".join(media.encode(pieces))
    assert b"".join(p.tobytes() for p in media.thumbnails(media.decode_all(joined))) == media._padded(text.encode())


def test_described_files_and_broken_ones(spark):
    image = media.encode([bytes(range(192)) * 3])[0]
    files = [(1, image, "x"), (2, None, None), (3, image[:40], "y"), (4, b"no picture", "z"), (5, image + b"rest", "w")]
    out = {r["id"]: r for r in media.describe(spark.createDataFrame(files, "id int, media binary, path string")).collect()}
    assert (out[1]["width"], out[1]["height"], out[1]["error"]) == (192, 192, None) and bytes(out[1]["thumbnail"]) == bytes(range(192)) * 3
    assert out[5]["thumbnail_hash"] == out[1]["thumbnail_hash"]
    assert all(out[i]["error"] and out[i]["thumbnail"] is None for i in (2, 3, 4))


def test_subsampled_colour_with_ac_terms_keeps_block_means():
    """4:2:0 colour written by hand: two by two luminance blocks a unit, AC terms passed over."""
    dc, ac = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12))), (bytes([0, 2] + [0] * 14), bytes([0x00, 0x01]))
    dc_codes, ac_codes = (media.huffman(*t)[2] for t in (dc, ac))
    bits = ""

    def put(value, term):
        nonlocal bits
        n = abs(value).bit_length()
        code, size = dc_codes[n]
        bits += format(code, f"0{size}b") + (format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else "")
        if term:
            code, size = ac_codes[0x01]
            bits += format(code, f"0{size}b") + "1"
        code, size = ac_codes[0x00]
        bits += format(code, f"0{size}b")

    values, last = [10, -20, 30, 5], 0
    for i, v in enumerate(values):
        put(v - last, i % 2)
        last = v
    put(3, 0)
    put(-3, 1)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, frame) + media._segment(0xC4, b"\0" + dc[0] + dc[1]) + media._segment(0xC4, b"\x10" + ac[0] + ac[1]) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    picture = media.thumbnails([media.parse(data)])[0]
    assert np.array_equal(picture, (np.array(values).reshape(2, 2) * 2 + 128).astype(np.uint8))
