import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from evenspan.llm import media
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .conftest import EDGES


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.data())
def test_all_filters_come_back(width, height, data):
    raw = data.draw(st.binary(min_size=width * height, max_size=width * height))
    kinds = bytes(data.draw(st.lists(st.integers(0, 4), min_size=height, max_size=height)))
    assert media.png_decode(media.png_encode(raw, width, kinds)).tobytes() == raw


def test_damage_is_found():
    good = media.png_encode(bytes(range(64)) * 4)
    for at in (0, 20, 40, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.png_decode(bytes(bad))
    for bad in (None, b"", good[:-12], good[:30]):
        with pytest.raises(media.MediaError):
            media.png_decode(bad)


def test_hash_is_robust_and_tells_apart():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    c = rng.integers(0, 256, (64, 64)).astype(np.uint8)

    def bits(x):
        return bin(int(media.cosine_hash(x), 16))

    def apart(x, y):
        return bin(int(media.cosine_hash(x), 16) ^ int(media.cosine_hash(y), 16)).count("1")

    assert apart(a, b) < 10 < apart(a, c) and bits(a) != bits(c)


def test_query_round_trip(edges):
    got = media.digests(media.from_media(media.to_media(edges))).collect()
    want = sorted(((i, (t or "").encode()) for i, t in EDGES), key=str)
    assert len(got) == len(want)
    for r in got:
        raw = next(b for i, b in want if i == r["doc_id"])
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_empty_and_damaged(spark, table):
    assert media.digests(media.from_media(media.to_media(table([])))).collect() == []
    rows = spark.createDataFrame([(1, 1, None), (2, 1, bytearray(b"x"))], "id long, n_bytes long, media binary")
    assert media.from_media(rows).where(F.col("payload").isNull() & F.col("error").isNotNull()).count() == 2


def image(head, lines, packed=None):
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", packed or zlib.compress(lines)) + media._chunk(b"IEND", b"")


def header(width, height, depth=8, colour=0, compression=0, method=0, interlaced=0):
    return struct.pack(">IIBBBBB", width, height, depth, colour, compression, method, interlaced)


def test_damaged_headers_are_faults(spark):
    good = image(header(3, 2), bytes(8))
    assert media.png_decode(good).shape == (2, 3)
    bad = [image(header(3, 2)[:-1], bytes(8)), image(header(3, 2) + b"x", bytes(8)), image(header(0, 2), bytes(2)), image(header(3, 0), b""), image(header(3, 2, depth=16), bytes(8)), image(header(3, 2, compression=1), bytes(8)), image(header(3, 2, method=1), bytes(8))]
    bad += [image(header(3, 2), bytes(9)), image(header(3, 2), bytes(7)), image(header(2**31, 2**31), bytes(8)), image(header(64, 1000), bytes(10**8)), image(header(3, 2), bytes([5] * 8)), image(header(3, 2), b"", b"no zlib"), image(header(3, 2), b"", zlib.compress(bytes(8))[:-3])]
    parts = [media._chunk(b"IDAT", zlib.compress(bytes(8))), media._chunk(b"IHDR", header(3, 2)), media._chunk(b"IEND", b"")]
    bad += [media.SIGNATURE + b"".join(parts), media.SIGNATURE + parts[1] + parts[1] + parts[0] + parts[2], media.SIGNATURE + parts[2], good[:40], good[:9]]
    rows = spark.createDataFrame([(i, 1, bytearray(b)) for i, b in enumerate([good, *bad])], "id long, n_bytes long, media binary")
    got = {r["id"]: (r["payload"], r["error"]) for r in media.from_media(rows).collect()}
    assert got[0] == (bytearray(6), None) and all(got[i][0] is None and got[i][1] for i in range(1, len(bad) + 1))


def test_images_of_many_sizes_at_once():
    rng = np.random.default_rng(3)
    raws = [(w, rng.integers(0, 256, (h, w)).astype(np.uint8)) for w in (1, 3, 64) for h in (1, 2, 7, 300)] * 2
    stored = [media.png_encode(r.tobytes(), w, bytes(rng.integers(0, 5, len(r)).tolist())) for w, r in raws]
    got = media.decoded([None, *stored, b"x"])
    assert isinstance(got[0], media.MediaError) and isinstance(got[-1], media.MediaError)
    assert all((a == r).all() for a, (_, r) in zip(got[1:-1], raws))


def test_written_rows_use_the_filter_that_fits():
    rows = np.vstack([np.arange(64), np.arange(64), np.full(64, 9), (np.arange(64) * 37) % 251]).astype(np.uint8)
    stored = media.png_encode(rows.tobytes())
    lines = zlib.decompress(stored[8 + 25 + 8 : -16])
    kinds = [lines[i * 65] for i in range(4)]
    assert kinds[0] in (1, 4) and kinds[1] in (2, 4) and len(set(kinds)) > 1 and (media.png_decode(stored) == rows).all()


def test_feature_equals_the_plain_transform():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (96, 64)).astype(np.uint8)
    small = [[np.mean(a[3 * i : 3 * i + 3, 2 * j : 2 * j + 2]) for j in range(32)] for i in range(32)]
    low = [[sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = [round(x, 6) for row in low for x in row]
    middle = sorted(flat[1:])[31]
    want = int("".join("1" if x > middle else "0" for x in flat), 2)
    assert media.cosine_hash(a) == f"{want:016x}"
