import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import tiff
from tests.llm import edge

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(kind, predictor, order):
    images = [RNG.integers(0, 4, (37, 21), dtype=np.uint8), RNG.integers(0, 256, (5, 70, 3), dtype=np.uint8), RNG.integers(0, 60000, (9, 11)).astype(np.uint16)]
    for how in ({"rows_per_strip": 8}, {"tile": (16, 16)}, {}):
        pages = tiff.read_pages(tiff.write_pages(images, kind, predictor, order=order, **how))
        assert len(pages) == 3
        for i, (p, img) in enumerate(zip(pages, images, strict=True)):
            assert (p.index, p.height, p.width) == (i, *img.shape[:2])
            assert np.array_equal(p.pixels.reshape(img.shape), img)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"a", b"bb", b"ccccc" * 40]), max_size=30).map(b"".join)))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_over_full_tables():
    data = RNG.integers(0, 256, 40_000, dtype=np.uint8).tobytes() + b"ab" * 9000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_packbits_golden():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    want = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(packed, len(want)) == want


def test_bilevel_and_float_predictor():
    raw = tiff.write_pages([np.array([[0b10110000], [0b01000000]], np.uint8)], tiff.NONE)
    one_bit = bytearray(raw)
    for k in range(len(one_bit) - 12):  # one bit a sample, four a line
        tag = int.from_bytes(one_bit[k : k + 2], "little")
        if tag == tiff.BITS and one_bit[k + 2 : k + 8] == b"\x03\x00\x01\x00\x00\x00":
            one_bit[k + 8] = 1
        if tag == tiff.WIDTH and one_bit[k + 2 : k + 8] == b"\x04\x00\x01\x00\x00\x00":
            one_bit[k + 8] = 4
    assert tiff.read_pages(bytes(one_bit))[0].pixels[..., 0].tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    values = RNG.random((3, 5)).astype(">f4")
    planes = np.frombuffer(values.tobytes(), np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    block = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).tobytes()
    r = tiff.Reader.__new__(tiff.Reader)
    r.o = "<"
    got = r._block(block, tiff.NONE, 3, 3, 5, 1, 32, np.dtype("<f4"))
    assert np.array_equal(got[..., 0], values.astype("f4"))


def test_bad_bytes():
    good = tiff.write_pages([np.zeros((4, 4), np.uint8)], tiff.DEFLATE)
    loop = bytearray(good)
    first = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[first : first + 2], "little")
    loop[first + 2 + 12 * n : first + 6 + 12 * n] = good[4:8]
    for bad in (b"", b"II", b"II*\0\xff\xff\xff\xff", bytes(loop), good[:-20], good.replace(b"\x78", b"\x00", 1), b"\x89PNG....."):
        assert len(tiff.page_rows(bad)) == 1 and tiff.page_rows(bad)[0][12]
    assert tiff.page_rows(None)[0][12] == "null"


def test_query_columns(spark):
    got = tiff.tiff_pages(tiff.texts_as_tiff(edge.table(spark)), keep=["doc_id", "n_bytes_text", "media_sha256"]).collect()
    want = []
    for i, t, *_ in edge.rows():
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes_text, r.n_bytes, r.pixels_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert all(r.error is None and r.page == 0 for r in got)
    assert len({(r.compression, r.predictor, r.tiled) for r in got}) > 1


@pytest.mark.parametrize("size", [64, 256, 320, 1024, 1088, 70_016, 300_032])
def test_stored_forms_do_not_depend_on_the_length(size):
    seen = set()
    for k in range(200 if size < 2000 else 24):
        payload = bytes([65 + k % 26]) * (size // 2) + np.random.default_rng(k).integers(0, 256, size - size // 2, dtype=np.uint8).tobytes()
        (p,) = tiff.read_pages(tiff.store_bytes(payload))
        assert p.pixels.tobytes() == payload
        seen.add((p.compression, p.predictor, p.tiled))
    if size < 2000:
        assert seen == {(c, d, t) for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE) for d in (1, 2) for t in (False, True)}


@pytest.mark.parametrize("kind", [tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
@pytest.mark.parametrize("tiled", [False, True])
def test_long_texts_in_every_codec(kind, tiled):
    text = " ".join(f"word{i * 7919 % 5000}" for i in range(90_000))
    payload, _ = tiff.payload_of(text)
    (p,) = tiff.read_pages(tiff.store_bytes(payload, compression=kind, tiled=tiled))
    assert p.pixels.tobytes() == payload and (p.compression, p.tiled) == (kind, tiled)


def test_lzw_by_the_book():
    """A plain encoder and decoder, one bit at a time, beside the ones under test."""

    def plain(data):
        bits, table, width = [], {bytes([i]): i for i in range(256)}, 9
        put = lambda c: bits.extend(int(x) for x in format(c, f"0{width}b"))
        put(256)
        nxt, w = 258, b""
        for c in data:
            c = bytes([c])
            if w + c in table:
                w += c
                continue
            put(table[w])
            table[w + c] = nxt
            nxt += 1
            if nxt >= 4094:
                put(256)
                table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
            else:
                width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
            w = c
        if w:
            put(table[w])
            nxt += 1
            width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        put(257)
        bits += [0] * (-len(bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 253, 254, 255, 256, 765, 766, 767, 1790, 3835, 3836, 3837, 9000):
        for top in (2, 256):
            data = rng.integers(0, top, n, dtype=np.int64).astype(np.uint8).tobytes()
            assert tiff.lzw_encode(data) == plain(data)
            assert tiff.lzw_decode(plain(data), n) == data


def test_registered_query(spark, sf):
    from strandlake.llm import queries

    got = {r.doc_id: r for r in queries.op5_tiff(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        payload, n = tiff.payload_of(d.text)
        media = tiff.store_bytes(payload)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_operator_edges(spark):
    two = tiff.write_pages([np.ones((2, 3), np.uint8), np.zeros((4, 5), np.uint8)], tiff.LZW)
    df = spark.createDataFrame([(1, bytearray(two), "p"), (2, None, "q"), (3, bytearray(b"nothing"), None)], "id int, content binary, page string")
    got = tiff.tiff_pages(df).collect()
    assert sorted((r.id, r.src_page or "", r.page if r.page is not None else -1, r.error is None) for r in got) == [(1, "p", 0, True), (1, "p", 1, True), (2, "q", -1, False), (3, "", -1, False)]
    assert tiff.tiff_pages(df.limit(0)).count() == 0
