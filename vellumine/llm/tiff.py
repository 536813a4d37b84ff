"""TIFF columns: one row per page of each stored file, and a writer for lossless 8-bit pages.

The reader walks the chain of image directories (classic and 64-bit files, either byte order), decodes
strips or tiles stored plain, as PackBits, LZW or deflate, undoes horizontal and floating-point
predictors and joins the parts to whole pages.

A null or empty file, or one that is broken before its first directory, gives one row with ``page`` -1
and the reason in ``error``; a page that cannot be decoded has null ``pixels`` and an ``error``, and the
pages after it are still read. A directory chain that returns to itself ends there. Repeated rows give
equal rows, empty tables none. Only the columns named by ``keep`` pass through.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.store import slices

#: Fixed values of the format: tags, bytes of each field type, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST_FREE = 256, 257, 258


# ---- codecs -------------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += head + 2
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(start: int, end: int) -> None:
        for i in range(start, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(bytes((len(part) - 1,)) + part)

    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.append(bytes((257 - (run.end() - run.start()), data[run.start()])))
        at = run.end()
    literal(at, len(data))
    return b"".join(out)


def _lzw_layout() -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and where each starts: the width follows from the count alone."""
    widths = np.empty(4096, np.int64)
    for i in range(4096):
        size = FIRST_FREE + i
        widths[i] = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return widths, np.concatenate(([0], np.cumsum(widths)[:-1]))


_WIDTHS, _STARTS = _lzw_layout()


def lzw_decode(data: bytes) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total_bits = len(data) * 8
    out: list[bytes] = []
    origin = 0
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    while origin + 9 <= total_bits:
        starts = _STARTS + origin
        fits = int(np.searchsorted(starts + _WIDTHS, total_bits, "right"))
        if not fits:
            break
        starts, widths = starts[:fits], _WIDTHS[:fits]
        at = starts >> 3
        word = (raw[at] << 24) | (raw[at + 1] << 16) | (raw[at + 2] << 8) | raw[at + 3]
        codes = (((word << (starts & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)) >> (32 - widths).astype(np.uint32)).astype(np.int64)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else fits
        table = singles[:]
        add, emit = table.append, out.append
        before = b""
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            emit(entry)
            if before:
                add(before + entry[:1])
            before = entry
        if stop == fits or codes[stop] == END:
            break
        origin = int(starts[stop] + widths[stop])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = []
    segments: list[int] = []  # code counts between clear codes
    emit = codes.append
    table: dict[int, int] = {}  # (code of the prefix, next byte) -> code
    known, following, prefix = table.get, FIRST_FREE, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        emit(prefix)
        table[key] = following
        following += 1
        prefix = byte
        if following == 4094:
            emit(prefix)
            emit(CLEAR)
            segments.append(len(codes) - sum(segments))
            table.clear()
            following, prefix = FIRST_FREE, -1
    if prefix >= 0:
        emit(prefix)
    emit(END)
    segments.append(len(codes) - sum(segments))
    widths = np.concatenate([np.array([9]), *[_WIDTHS[:n] for n in segments]])
    values = np.array([CLEAR, *codes], np.int64)
    bits = np.zeros(int(widths.sum()), np.uint8)
    ends = np.cumsum(widths)
    for bit in range(12):
        some = widths > bit
        bits[ends[some] - 1 - bit] = (values[some] >> bit) & 1
    return np.packbits(bits).tobytes()


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _decompress(data: bytes, how: int) -> bytes:
    if how == PLAIN:
        return data
    if how == PACKBITS:
        return packbits_decode(data)
    if how == LZW:
        return lzw_decode(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    raise ValueError(f"compression {how} is not supported")


def _compress(data: bytes, how: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[how](data)


# ---- reading ------------------------------------------------------------------------------------


class Broken(ValueError):
    pass


def directories(blob: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and the tags of each image directory, along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or len(blob) < 8:
        raise Broken("not a TIFF file")
    magic = struct.unpack_from(order + "H", blob, 2)[0]
    if magic not in (42, 43):
        raise Broken("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), blob, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            count = struct.unpack_from(order + ("Q" if big else "H"), blob, at)[0]
            at += 8 if big else 2
            tags = {}
            for _ in range(count):
                tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), blob, at)
                room, where = (8, at + 12) if big else (4, at + 8)
                length = n * TYPE_BYTES.get(kind, 1)
                if length > room:
                    where = struct.unpack_from(order + ("Q" if big else "I"), blob, where)[0]
                    if where + length > len(blob):
                        raise Broken("a field lies outside the file")
                if kind in TYPE_CODE:
                    tags[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODE[kind]}", blob, where)
                at += 20 if big else 12
            at = struct.unpack_from(order + ("Q" if big else "I"), blob, at)[0]
        except struct.error as e:
            raise Broken("a directory lies outside the file") from e
        yield order, tags


def _unpredict(rows: np.ndarray, predictor: int, bits: int, samples: int, order: str) -> np.ndarray:
    """``rows``: bytes as (rows, bytes of a row); the same with the predictor undone, samples in file order."""
    if predictor == 1:
        return rows
    height = rows.shape[0]
    if predictor == 2:
        if bits not in (8, 16, 32, 64):
            raise ValueError("the horizontal predictor needs whole bytes")
        kind = np.dtype(f"{order}u{bits // 8}") if bits > 8 else np.dtype(np.uint8)
        values = rows.view(kind).reshape(height, -1, samples)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(height, -1).view(np.uint8)
    if predictor == 3:
        size = bits // 8
        summed = np.cumsum(rows.reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, size, -1)
        planes = summed if order == ">" else summed[:, ::-1]
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(height, -1)
    raise ValueError(f"predictor {predictor} is not supported")


def page(blob: bytes, order: str, tags: dict[int, tuple]) -> dict:
    """One page: its size, how it was stored, and its samples, row by row, in the file's byte order."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height = one(WIDTH, 0), one(LENGTH, 0)
    samples, bits, how, predictor, planar = one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1)
    if len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError("samples of different sizes are not supported")
    tiled = TILE_OFFSETS in tags
    if tiled:
        part_width, part_height = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)
        offsets, lengths = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        part_width, part_height = width, min(one(STRIP_ROWS, height), height)
        offsets, lengths = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
    planes = samples if planar == 2 else 1
    each = samples // planes
    row_bytes = (width * each * bits + 7) // 8
    part_bytes = (part_width * each * bits + 7) // 8
    across = -(-width // part_width) if part_width else 0
    down = -(-height // part_height) if part_height else 0
    if len(offsets) < across * down * planes or len(lengths) < across * down * planes:
        raise ValueError("parts are missing")
    whole = np.zeros((planes, height, row_bytes), np.uint8)
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        if offsets[k] + lengths[k] > len(blob):
            raise ValueError("a part lies outside the file")
        data = blob[offsets[k] : offsets[k] + lengths[k]]
        if one(FILL_ORDER, 1) == 2:
            data = data.translate(_REVERSED)
        rows = part_height if tiled else min(part_height, height - y * part_height)
        data = _decompress(data, how)
        if len(data) < rows * part_bytes:
            raise ValueError("a part is too short")
        part = _unpredict(np.frombuffer(data, np.uint8, rows * part_bytes).reshape(rows, part_bytes), predictor, bits, each, order)
        top, left = y * part_height, x * part_bytes
        kept = part[: height - top, : row_bytes - left]
        whole[plane, top : top + kept.shape[0], left : left + kept.shape[1]] = kept
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled, "parts": across * down * planes, "pixels": whole.tobytes()}


def pages(blob: bytes | None) -> Iterator[dict]:
    """Each page of a file, or rows that say what is wrong with it."""
    number = 0
    try:
        for order, tags in directories(blob or b""):
            try:
                yield {"page": number, "error": None} | page(blob, order, tags)
            except (ValueError, KeyError, zlib.error, struct.error) as e:
                yield {"page": number, "error": str(e)}
            number += 1
    except Broken as e:
        yield {"page": -1 if number == 0 else number, "error": str(e)}


PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()),
    T.StructField("predictor", T.IntegerType()), T.StructField("tiled", T.BooleanType()), T.StructField("parts", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
]
_ARROW = [pa.int32()] * 7 + [pa.bool_(), pa.int32(), pa.binary(), pa.string()]


def read_pages(df: DataFrame, blob_col: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of each file in ``blob_col``, with the ``keep`` columns of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                origin, rows = [], []
                for i, blob in enumerate(part.column("__blob")):
                    for found in pages(blob.as_py()):
                        origin.append(i)
                        rows.append(found)
                kept = part.select(list(keep)).take(pa.array(origin, pa.int64()))
                columns = [pa.array([r.get(f.name) for r in rows], kind) for f, kind in zip(PAGE_FIELDS, _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*keep, *(f.name for f in PAGE_FIELDS)])

    slim = df.select(*keep, F.col(blob_col).alias("__blob"))
    return slim.mapInArrow(run, T.StructType([*slim.select(*keep).schema.fields, *PAGE_FIELDS]))


# ---- writing ------------------------------------------------------------------------------------


def write_page(payload: bytes, width: int, how: int, predictor: int = 1, tile: int = 0, strip_rows: int = 64) -> bytes:
    """A little-endian file with one grey 8-bit page; the payload's length is a multiple of ``width``."""
    height = len(payload) // width
    image = np.frombuffer(payload, np.uint8).reshape(height, width)
    if tile:
        padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
        padded[:height, :width] = image
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
    else:
        parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros((p.shape[0], 1), np.uint8)) for p in parts]
    stored = [_compress(p.tobytes(), how) for p in parts]
    offsets = np.cumsum([8, *map(len, stored)])[:-1].tolist()
    body = b"".join(stored)
    body += b"\0" * (len(body) % 2)
    entries = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
    if tile:
        entries += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, [len(s) for s in stored])]
    else:
        entries += [(STRIP_OFFSETS, 4, offsets), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, [len(s) for s in stored])]
    entries += [(PREDICTOR, 3, [predictor])]
    start = 8 + len(body)
    after = start + 2 + 12 * len(entries) + 4
    directory, extra = struct.pack("<H", len(entries)), b""
    for tag, kind, values in sorted(entries):
        packed = struct.pack(f"<{len(values)}{TYPE_CODE[kind]}", *values)
        if len(packed) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            directory += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", start) + body + directory + struct.pack("<I", 0) + extra


#: Ways to store a page: compression, predictor, tile size (0: strips). The payload's checksum picks one.
WAYS = ((PACKBITS, 1, 0), (LZW, 1, 0), (DEFLATE, 2, 64), (DEFLATE, 1, 0), (PACKBITS, 2, 0))


def write_files(df: DataFrame, payload_col: str, *, width: int, keep: tuple[str, ...] = ("doc_id",), blob_col: str = "blob") -> DataFrame:
    """``keep`` columns plus a one-page file that holds each payload (whole rows of ``width`` bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                blobs = []
                for payload in part.column("__payload"):
                    payload = payload.as_py() or b""
                    how, predictor, tile = WAYS[zlib.crc32(payload) % len(WAYS)]
                    blobs.append(write_page(payload, width, how, predictor, tile))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(blobs, pa.binary())], [*keep, blob_col])

    slim = df.select(*keep, F.col(payload_col).alias("__payload"))
    return slim.mapInArrow(run, T.StructType([*slim.select(*keep).schema.fields, T.StructField(blob_col, T.BinaryType())]))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 192) -> DataFrame:
    """Texts as pages of ``width`` samples a row, stored, read back and described by digests of both forms."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col), raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / width)) * width
    payload = F.concat("raw", F.repeat(F.lit(" "), (padded - F.col("n_bytes")).cast("int")).cast("binary"))
    files = write_files(sized.withColumn("payload", payload), "payload", width=width, keep=(id_col, "n_bytes"))
    stored = files.select(id_col, "n_bytes", F.octet_length("blob").cast("long").alias("media_bytes"), F.sha2("blob", 256).alias("media_sha256"), "blob")
    back = read_pages(stored, "blob", keep=(id_col, "n_bytes", "media_bytes", "media_sha256"))
    length = F.octet_length("pixels")
    feature = F.concat_ws(":", F.lit("page"), "width", "height", "compression", "predictor", F.when(F.col("tiled"), "tiles").otherwise("strips"), "parts", F.crc32("pixels"))
    return back.select(
        id_col, "n_bytes", length.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("pixels"), -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), "page",
    )
