"""Media columns: TIFF.

The decoder walks the chain of image directories (classic and BigTIFF, either byte
order), decodes strips or tiles stored plain or with PackBits, LZW or deflate, undoes
predictors 2 and 3, and gives one row per page. The encoder writes what the decoder
reads; it serves tests and :func:`store_bytes`.
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
from pyspark.sql import types as T

from strandlake.plans.session import ship_package

#: Tags, compressions and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


class TiffError(ValueError):
    """The bytes are not a readable TIFF."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height, width, samples


# --- compressions -----------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: n < 128 copies n + 1 bytes, n > 128 repeats one byte 257 - n times."""
    out, i, n = [], 0, len(data)
    got = 0
    while i < n and got < size:
        c = data[i]
        if c < 128:
            piece = data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            piece = data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
            continue
        out.append(piece)
        got += len(piece)
    return b"".join(out)[:size]


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more become repeats, everything else literals."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edge = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
    begin = np.append(0, edge[:-1])
    out, lit = [], 0

    def literal(end: int) -> None:
        for k in range(lit, end, 128):
            out.append(bytes([min(end, k + 128) - k - 1]) + data[k : min(end, k + 128)])

    long = np.flatnonzero(edge - begin >= 3)
    for i, j in zip(begin[long].tolist(), edge[long].tolist(), strict=True):
        literal(i)
        while j - i >= 2:
            n = min(128, j - i)
            out.append(bytes([257 - n, data[i]]))
            i += n
        lit = i
    literal(len(data))
    return b"".join(out)


#: Codes between two clear codes: 258 to 4093 and the one that fills the table.
_LZW_RUN = 4094 - 258


def _code_widths(n: int) -> np.ndarray:
    """Bits of each of ``n`` codes after a clear code: 9 to 12, changed one code early."""
    size = np.arange(258, 258 + n)
    return 9 + (size >= 512).astype(np.int64) + (size >= 1024) + (size >= 2048)


_WIDTHS = _code_widths(_LZW_RUN + 260)
_WIDTHS_AT = np.append(0, np.cumsum(_WIDTHS))


def _bits_at(buf: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of ``width`` bits (17 at most) from bit ``at``; ``buf`` ends in three spare bytes."""
    i = at >> 3
    v = (buf[i].astype(np.int64) << 16) | (buf[i + 1].astype(np.int64) << 8) | buf[i + 2]
    return (v >> (24 - width - (at & 7))) & ((1 << width) - 1)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Most significant bit first, 9 to 12 bits a code, widths change one code early.

    The widths between two clear codes are known ahead, so the codes of a run are read at
    once and only the table is built one by one.
    """
    buf = np.frombuffer(data + b"\0\0\0", np.uint8)
    bits = 8 * len(data)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out, got, at = [], 0, 0
    while got < size:
        n = int(np.searchsorted(_WIDTHS_AT, bits - at, "right")) - 1
        n = min(n, len(_WIDTHS))
        if n <= 0:
            break
        codes = _bits_at(buf, at + _WIDTHS_AT[:n], _WIDTHS[:n])
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        run = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        table = base[:]
        prev = b""
        for code in run:
            if not prev:
                if code > 255:
                    raise TiffError("lzw: the first code is not a byte")
                prev = table[code]
                out.append(prev)
                got += 1
                continue
            if code < len(table):
                entry = table[code]
                table.append(prev + entry[:1])
            elif code == len(table):
                entry = prev + prev[:1]
                table.append(entry)
            else:
                raise TiffError("lzw: a code is ahead of the table")
            out.append(entry)
            got += len(entry)
            prev = entry
            if got >= size or len(table) > 4096:
                break
        if not len(stop) or codes[stop[0]] == 257:
            break
        at += int(_WIDTHS_AT[stop[0] + 1])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Codes are found one by one; their bits are put together at once."""
    runs: list[list[int]] = []
    codes: list[int] = [256]
    table: dict[int, int] = {}
    get, nxt, w = table.get, 258, -1
    for c in data:
        if w < 0:
            w = c
            continue
        key = (w << 8) | c
        known = get(key)
        if known is not None:
            w = known
            continue
        codes.append(w)
        table[key] = nxt
        nxt += 1
        if nxt >= 4094:
            codes.append(256)
            runs.append(codes)
            codes = []
            table.clear()
            nxt = 258
        w = c
    if w >= 0:
        codes.append(w)
    codes.append(257)
    runs.append(codes)
    # The first run begins with a clear code of 9 bits, after which widths start anew.
    flat = np.array([c for r in runs for c in r], np.int64)
    widths = np.concatenate([np.append(9, _WIDTHS[: len(r) - 1]) if i == 0 else _WIDTHS[: len(r)] for i, r in enumerate(runs)])
    at = np.append(0, np.cumsum(widths))
    total = int(at[-1])
    v, i = flat << (24 - widths - (at[:-1] & 7)), at[:-1] >> 3
    n = -(-total // 8) + 3
    out = sum(np.bincount(i + k, weights=(v >> (16 - 8 * k)) & 255, minlength=n) for k in range(3))
    return out[: -(-total // 8)].astype(np.uint8).tobytes()


def _decode(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind == PACKBITS:
        return unpack_bits(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if NAMES.get(kind) == "deflate":
        return zlib.decompressobj().decompress(data, size)
    raise TiffError(f"compression {kind} is not supported")


def _encode(data: bytes, kind: int, level: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, level)}[kind](data)


# --- directories ------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or len(data) < 8:
            raise TiffError("no byte order mark")
        self.o = order
        magic = self._get("H", 2)
        if magic == 42:
            self.first, self.big = self._get("I", 4), False
        elif magic == 43:
            self.first, self.big = self._get("Q", 8), True
        else:
            raise TiffError("no magic number")

    def _get(self, fmt: str, at: int):
        try:
            return struct.unpack_from(self.o + fmt, self.data, at)[0]
        except struct.error as e:
            raise TiffError("the data end early") from e

    def directories(self) -> Iterator[dict[int, tuple]]:
        """Tag values of each directory; a chain that returns to an earlier one is an error."""
        at, seen = self.first, set()
        count, step, off = ("Q", 20, 8) if self.big else ("H", 12, 2)
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            n = self._get(count, at)
            if at + off + n * step > len(self.data):
                raise TiffError("a directory is cut off")
            tags = {}
            for i in range(n):
                e = at + off + i * step
                tag, kind = self._get("H", e), self._get("H", e + 2)
                m = self._get("Q" if self.big else "I", e + 4)
                fmt, width = TYPES.get(kind, (None, 0))
                if fmt is None:
                    continue
                room = 8 if self.big else 4
                where = e + (12 if self.big else 8)
                if m * width > room:
                    where = self._get("Q" if self.big else "I", where)
                if where + m * width > len(self.data):
                    raise TiffError("a tag points outside the data")
                tags[tag] = struct.unpack_from(f"{self.o}{m}{fmt}", self.data, where)
            yield tags
            at = self._get("Q" if self.big else "I", at + off + n * step)

    def pages(self) -> Iterator[Page]:
        for i, tags in enumerate(self.directories()):
            yield self._page(i, tags)

    def _page(self, index: int, t: dict[int, tuple]) -> Page:
        one = lambda tag, default=None: t[tag][0] if t.get(tag) else default
        w, h = one(WIDTH), one(HEIGHT)
        if not w or not h:
            raise TiffError("a page has no size")
        samples, kind, predictor, planar = one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        bits = set(t.get(BITS, (1,)))
        if len(bits) > 1:
            raise TiffError("samples differ in bits")
        bits = bits.pop()
        tiled = TILE_OFFSETS in t
        offsets, counts = (t.get(TILE_OFFSETS, ()), t.get(TILE_COUNTS, ())) if tiled else (t.get(STRIP_OFFSETS, ()), t.get(STRIP_COUNTS, ()))
        bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
        if not bw or not bh or len(offsets) != len(counts):
            raise TiffError("strips or tiles are not described")
        across, down, planes = -(-w // bw), -(-h // bh), samples if planar == 2 else 1
        if len(offsets) < across * down * planes:
            raise TiffError("strips or tiles are missing")
        per = samples if planar == 1 else 1
        dtype = self._dtype(bits, one(FORMAT, 1))
        out = np.zeros((h, w, samples), dtype.newbyteorder("="))
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * bh, cell % across * bw
            rows = bh if tiled else min(bh, h - y)
            raw = self.data[offsets[k] : offsets[k] + counts[k]]
            block = self._block(raw, kind, predictor, rows, bw, per, bits, dtype)
            rows, cols = min(rows, h - y), min(bw, w - x)
            target = out[y : y + rows, x : x + cols]
            if planar == 1:
                target[...] = block[:rows, :cols]
            else:
                target[..., plane] = block[:rows, :cols, 0]
        return Page(index, w, h, samples, bits, kind, predictor, tiled, out)

    def _dtype(self, bits: int, form: int) -> np.dtype:
        if bits <= 8:
            return np.dtype("u1")
        if bits not in (16, 32, 64):
            raise TiffError(f"{bits} bits a sample are not supported")
        return np.dtype(f"{self.o}{ {1: 'u', 2: 'i', 3: 'f'}.get(form, 'u') }{bits // 8}")

    def _block(self, raw: bytes, kind: int, predictor: int, rows: int, cols: int, per: int, bits: int, dtype: np.dtype) -> np.ndarray:
        line = -(-cols * per * bits // 8)
        data = _decode(raw, kind, rows * line)
        if len(data) < rows * line:
            raise TiffError("a strip or tile is cut off")
        if bits < 8:
            if bits not in (1, 2, 4):
                raise TiffError(f"{bits} bits a sample are not supported")
            b = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, line), axis=1)[:, : cols * per * bits]
            b = b.reshape(rows, cols * per, bits)
            return (b @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8).reshape(rows, cols, per)
        if predictor == 3:
            width = bits // 8
            b = np.frombuffer(data, np.uint8).reshape(rows, cols * width, per)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, width, cols * per)
            return np.ascontiguousarray(b.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, cols, per).astype(dtype.newbyteorder("="))
        a = np.frombuffer(data, dtype).reshape(rows, cols, per)
        if predictor == 2:
            native = a.astype(dtype.newbyteorder("="))
            return np.cumsum(native, axis=1, dtype=native.dtype)
        if predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported")
        return a


def read_pages(data: bytes) -> list[Page]:
    """All pages; raises :class:`TiffError`."""
    try:
        return list(Reader(bytes(data)).pages())
    except (zlib.error, ValueError, IndexError, MemoryError, OverflowError) as e:
        raise e if isinstance(e, TiffError) else TiffError(str(e)) from e


def write_pages(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 0, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF with one page per array (height, width[, samples]) of 8- or 16-bit unsigned samples."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for img in images:
        a = img if img.ndim == 3 else img[..., None]
        h, w, s = a.shape
        bits = a.dtype.itemsize * 8
        bw, bh = tile or (w, rows_per_strip or h)
        offsets, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = a[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != (bh, bw):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = _encode(block.astype(block.dtype.newbyteorder(order)).tobytes(), compression, level)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [bits] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [bw]), TILE_HEIGHT: (4, [bh]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [bh]), STRIP_COUNTS: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            fmt, width = TYPES[kind]
            body = struct.pack(f"{order}{len(values)}{fmt}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, at = struct.pack(order + "I", len(out)), body
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- columns ----------------------------------------------------------------------


def features(pixels: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits and mean horizontal step of 8-bit samples."""
    h, w = pixels.shape[:2]
    flat = pixels.reshape(-1)
    if pixels.dtype != np.uint8:
        return f"{w}x{h} mean={float(flat.mean()):.4f} dev={float(flat.std()):.4f}"
    n = np.bincount(flat, minlength=256)
    p = n[n > 0] / max(1, flat.size)
    level = np.arange(256)
    mean = float((n * level).sum() / max(1, flat.size))
    dev = float(np.sqrt(max(0.0, (n * level * level).sum() / max(1, flat.size) - mean * mean)))
    line = pixels.reshape(h, -1).astype(np.int16)
    step = float(np.abs(np.diff(line, axis=1)).mean()) if line.shape[1] > 1 else 0.0
    return f"{w}x{h} mean={mean:.4f} dev={dev:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f} step={step:.4f}"


_PAGE = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, n_bytes long, pixels_sha256 string, tail_crc32 long, feature string, error string"
_TYPES = [pa.int32()] * 5 + [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
_FIELDS = [x.split()[0] for x in _PAGE.split(", ")]


def page_rows(data: bytes | None) -> list[tuple]:
    """One tuple per page as in the schema of :func:`tiff_pages`."""
    if data is None:
        return [(None,) * 12 + ("null",)]
    rows = []
    try:
        for p in read_pages(data):
            raw = p.pixels.tobytes()
            rows.append((p.index, p.width, p.height, p.samples, p.bits, NAMES[p.compression], p.predictor, p.tiled, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), features(p.pixels), None))
    except TiffError as e:
        return [(None,) * 12 + (str(e)[:200],)]
    return rows or [(None,) * 12 + ("no directory",)]


def tiff_pages(df: DataFrame, content_col: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per page of every TIFF in ``content_col``, beside the columns ``keep`` (all others by default).

    Adds page, width, height, samples, bits, compression, predictor, tiled, n_bytes,
    pixels_sha256, tail_crc32 (of the last 64 bytes), feature and error. A null or
    unreadable content gives one row with ``error`` set and nulls elsewhere. Kept columns
    must not have the names of added ones: such columns are returned with ``src_`` before
    their name. Rows that repeat are read each; a page of any size is one row, and a task
    holds one file. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != content_col] if keep is None else keep
    safe = [f"src_{c}" if c in _FIELDS else c for c in keep]
    d = df.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(keep, safe, strict=True)], F.col(f"`{content_col}`").alias("__content"))
    schema = T.StructType([*d.schema.fields[:-1], *T.StructType.fromDDL(_PAGE).fields])
    n = len(safe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_rows(c.as_py()) for c in b.column(n)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            cols = list(zip(*[r for x in found for r in x], strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(n)), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=[*safe, *_FIELDS])

    return d.mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    b = (text or "").encode("utf-8", "replace")
    return b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b)), len(b)


def store_bytes(payload: bytes, width: int = 64, compression: int | None = None, predictor: int | None = None, tiled: bool | None = None) -> bytes:
    """A one-page TIFF with the payload as 8-bit samples, ``width`` a row.

    What is not given is chosen by the crc32 of the payload, whatever its length: LZW,
    PackBits or deflate; with horizontal differencing or without; strips of 1024 rows or
    tiles of 64 by 64.
    """
    a = np.frombuffer(payload, np.uint8).reshape(-1, width)
    h = zlib.crc32(payload)
    compression = (LZW, PACKBITS, DEFLATE)[h % 3] if compression is None else compression
    predictor = 1 + h // 3 % 2 if predictor is None else predictor
    tiled = bool(h // 6 % 2) if tiled is None else tiled
    return write_pages([a], compression, predictor, rows_per_strip=1024, tile=(64, 64) if tiled else None)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            made = [(store_bytes(p), n) for p, n in (payload_of(t.as_py()) for t in part.column(1))]
            yield pa.record_batch([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary()), pa.array([len(m) for m, _ in made], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m, _ in made], pa.string())], names=["doc_id", "n_bytes_text", "content", "media_bytes", "media_sha256"])


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id (under its own name), n_bytes_text, content (the TIFF), media_bytes, media_sha256.

    A null text is empty; a null id stays null; rows that repeat are stored each; other
    columns are not read. A text of any length is one page, in strips or tiles of bounded
    size. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    stored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored.mapInArrow(_stored, "doc_id long, n_bytes_text long, content binary, media_bytes long, media_sha256 string").withColumnRenamed("doc_id", id_col)
