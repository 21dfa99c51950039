"""Media columns: Netpbm and BMP images decoded to arrays, resized by areas, cut into NPY tiles, with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, read_table, stored, trimmed
from .spelling import CRC_SQL

#: Samples in a row of a text's image; payloads are padded to a multiple of it.
ROW = 64
#: Rows of an image that are summed at a time.
STRIP = 4096
#: Rows and columns of the image that a difference hash compares.
HASHED = (8, 9)
SPACE = rb"(?:[ \t\n\x0b\x0c\r]|#[^\n\r]*[\n\r])+"


class Unreadable(ValueError):
    """Not a whole image of a known form."""


def payload(text: str | None, multiple: int = ROW) -> bytes:
    """The text's UTF-8 bytes and bytes 0 up to a positive multiple."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\0" * (-len(raw) % multiple if raw else multiple)


def to_pgm(samples: bytes, width: int = ROW) -> bytes:
    """A grey image, a byte for each sample."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def to_bmp(pixels: np.ndarray) -> bytes:
    """height x width (grey, 8 bits with a palette) or height x width x 3 (24 bits), the last row first."""
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = (pixels if grey else pixels[:, :, ::-1])[::-1].reshape(height, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    at = 54 + palette.size
    numbers = lambda size, *n: b"".join(x.to_bytes(size, "little", signed=True) for x in n)
    head = b"BM" + numbers(4, at + rows.size, 0, at, 40, width, height) + numbers(2, 1, 8 if grey else 24) + numbers(4, 0, rows.size, 0, 0, 256 if grey else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def from_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: height x width, or height x width x 3; bitmaps as 255 for white and 0 for black, wide samples as 16 bits."""
    kind = data[1] - ord("0")
    fields = 2 if kind in (1, 4) else 3
    head = re.compile(rb"P[1-6]" + (SPACE + rb"(\d{1,9})") * fields).match(data)
    if not head:
        raise Unreadable("header")
    width, height, *most = map(int, head.groups())
    most = most[0] if most else 1
    if not width or not height or not 0 < most < 65536:
        raise Unreadable("size")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n, at = int(np.prod(shape)), head.end()
    if kind <= 3:
        plain = re.sub(rb"#[^\n\r]*", b"", data[at:])
        if not re.fullmatch(rb"[\s0-9]*", plain):
            raise Unreadable("samples")
        values = np.frombuffer(re.sub(rb"[^01]", b"", plain), np.uint8) - ord("0") if kind == 1 else np.array(plain.split()[:n], dtype=np.int64)
    else:
        if not re.match(rb"[ \t\n\x0b\x0c\r]", data[at : at + 1]):
            raise Unreadable("header")
        raw = memoryview(data)[at + 1 :]
        if kind == 4:
            line = -(-width // 8)
            if len(raw) < line * height:
                raise Unreadable("too short")
            values = np.unpackbits(np.frombuffer(raw[: line * height], np.uint8).reshape(height, line), axis=1)[:, :width]
        else:
            wide = 1 + (most > 255)
            if len(raw) < n * wide:
                raise Unreadable("too short")
            values = np.frombuffer(raw[: n * wide], np.uint8 if wide == 1 else ">u2")
    if values.size < n or values.size and kind != 4 and values.max() > most:
        raise Unreadable("samples")
    values = values.reshape(-1)[:n].reshape(shape)
    return (255 * (1 - values)).astype(np.uint8) if kind in (1, 4) else values.astype(np.uint8 if most < 256 else np.uint16)


def from_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: height x width where all colours are grey, else height x width x 3."""
    if len(data) < 54:
        raise Unreadable("too short")
    number = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=True)
    at, head, width, height, bits, form, used = number(10), number(14), number(18), number(22), number(28, 2), number(30), number(46)
    if head < 40 or form != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or at < 14 + head:
        raise Unreadable("form")
    line = -(-width * bits // 32) * 4
    if len(data) < at + line * abs(height):
        raise Unreadable("too short")
    rows = np.frombuffer(data, np.uint8, line * abs(height), at).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows  # the last row comes first
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(len(rows), width, bits // 8)[:, :, 2::-1])
    colours = used or 1 << bits
    if not 0 < colours <= 256 or 14 + head + 4 * colours > at:
        raise Unreadable("palette")
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    places = rows if bits == 8 else np.stack([rows >> s & ((1 << bits) - 1) for s in range(8 - bits, -1, -bits)], 2).reshape(len(rows), -1)
    places = places[:, :width]
    if places.max() >= colours:
        raise Unreadable("palette")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][places] if grey else palette[places]


def decode(data: bytes) -> np.ndarray:
    """An image of any known form, its samples in rows; raises Unreadable."""
    if data[:2] == b"BM":
        return from_bmp(data)
    if re.match(rb"P[1-6]", data):
        return from_netpbm(data)
    raise Unreadable("form")


def grey(pixels: np.ndarray) -> np.ndarray:
    """The mean of the colours, rounded to the nearest, halves up."""
    if pixels.ndim == 2:
        return pixels
    n = pixels.shape[2]
    return ((2 * pixels.sum(2, dtype=np.int64) + n) // (2 * n)).astype(pixels.dtype)


def _bounds(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where parts equal cells of `size` samples begin and end: whole samples and the rest, in parts-ths."""
    at = np.arange(parts + 1, dtype=np.int64) * size
    return at // parts, at % parts


def _integral(x: np.ndarray, parts: int) -> np.ndarray:
    """parts * the integral of x along its first axis, at the bounds of `parts` equal cells; between samples it is linear."""
    whole, rest = _bounds(len(x), parts)
    held = np.zeros((parts + 1, *x.shape[1:]), np.int64)
    before = np.zeros((1, *x.shape[1:]), np.int64)
    for a in range(0, len(x), STRIP):
        sums = np.concatenate([before, before + np.cumsum(x[a : a + STRIP], 0, dtype=np.int64)])
        mine = (whole >= a) & (whole < a + len(sums) - 1)
        held[mine] = sums[whole[mine] - a]
        before = sums[-1:]
    held[whole == len(x)] = before
    inner = whole < len(x)
    held *= parts
    rest = rest.reshape(-1, *[1] * (x.ndim - 1))
    held[inner] += rest[inner] * x[whole[inner]].astype(np.int64)
    return held


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new sample is the mean of the area that it covers, in whole numbers, rounded to the nearest, halves up."""
    down = _integral(pixels, height)
    both = _integral(np.moveaxis(down, 1, 0), width)
    cells = np.moveaxis(np.diff(np.diff(both, axis=0), axis=1), 0, 1)
    area = pixels.shape[0] * pixels.shape[1]
    return ((2 * cells + area) // (2 * area)).astype(pixels.dtype)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 cells of the grey image is darker than the one to its right."""
    small = resize(grey(pixels), *HASHED)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


FIELDS = {"status": pa.string(), "height": pa.int64(), "width": pa.int64(), "channels": pa.int64(), "samples": pa.int64(), "sha256": pa.string(), "tail_crc32": pa.int64(), "dhash": pa.string(), "tiles": pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("npy", pa.binary())]))}
DDL = "status string, height long, width long, channels long, samples long, sha256 string, tail_crc32 long, dhash string, tiles array<struct<y int, x int, npy binary>>"


def _described(data: bytes | None, size: tuple[int, int], tile: int) -> dict:
    if data is None:
        return {"status": "missing"}
    try:
        pixels = decode(data)
    except Unreadable as e:
        return {"status": f"unreadable: {e}"}
    raw = memoryview(np.ascontiguousarray(pixels)).cast("B")
    small = resize(pixels, *size)
    cut = [{"y": y // tile, "x": x // tile, "npy": npy(small[y : y + tile, x : x + tile])} for y in range(0, size[0], tile) for x in range(0, size[1], tile)]
    return {
        "status": "ok", "height": pixels.shape[0], "width": pixels.shape[1], "channels": 1 if pixels.ndim == 2 else pixels.shape[2], "samples": len(raw),
        "sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-64:]), "dhash": difference_hash(pixels), "tiles": cut,
    }


def _describe(at: int, size: tuple[int, int], tile: int, batches):
    kind = pa.struct(list(FIELDS.items()))
    for batch in batches:
        made = pa.array([_described(x.as_py(), size, tile) for x in batch.column(at)], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, OWN + "media"])


def media_tiles(media: DataFrame, media_col: str = "media", size: tuple[int, int] = (32, 32), tile: int = 32) -> DataFrame:
    """media with a struct column __tr_media of what each image holds.

    status is ok, missing (null) or unreadable with the reason; the other fields are then null. height, width, channels
    and samples (in bytes) are those of the decoded image, sha256 is that of its samples and tail_crc32 that of the last
    64 of them. dhash is the difference hash of the grey image; tiles are the pieces (y, x, a NPY file), of at most
    tile x tile samples, of the image as resized to size. Netpbm (P1 to P6) and uncompressed BMP are read.

    Each row is judged for itself; all columns stay, rows that repeat too, and an empty table stays empty. Memory is a
    few times that of the batch's largest image: sums are held for a strip of rows at a time."""
    run = partial(_describe, media.columns.index(media_col), size, tile)
    schema = media.withColumn(OWN + "media", F.lit(None).cast(f"struct<{DDL}>")).schema
    return media.mapInArrow(trimmed(run, media.sparkSession), schema)


def _drawn(batches):
    for batch in batches:
        raw = [payload(x.as_py()) for x in batch.column("text")]
        sizes = pa.array([len((x.as_py() or "").encode("utf-8", "replace")) for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array([to_pgm(x) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media), stored: each whole text's UTF-8 bytes as a grey image (PGM) of 64 columns, the last row filled up with 0.

    Null and empty texts are one row of 0. Rows that repeat, or lack an id, have an image each; equal texts have equal ones."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(trimmed(_drawn, docs.sparkSession), f"doc_id {kind}, n_bytes long, media binary"), "media-images", "zstd")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all texts go to the shared folder, are read back and decoded; their tiles and hashes go there too, and are read back."""
    images = text_media(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = media_tiles(images).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}).drop("media")
    m = stored(held, "media-tiles", "zstd")
    part = lambda f: F.col(OWN + "media").getField(f)
    return m.select("doc_id", "n_bytes", part("samples").alias("payload_bytes"), part("sha256").alias("payload_sha256"), part("tail_crc32").alias("tail_crc32"), "media_bytes", "media_sha256", part("dhash").alias("feature"))


SQL = rf"""
WITH {CRC_SQL},
n AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, n_bytes, h, raw || unhex(repeat('00', CAST(64 * h - n_bytes AS INT))) AS b FROM (SELECT *, greatest(1, (n_bytes + 63) // 64) AS h FROM n)),
m AS (SELECT *, encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || b AS media, hex(b) AS x FROM p),
r AS (SELECT doc_id, h, unnest(range(h)) AS y, unnest(regexp_extract_all(x, '.{{128}}')) AS line FROM m),
q AS (SELECT doc_id, h, y, unnest(range(64)) AS c, unnest(list_transform(regexp_extract_all(line, '..'), lambda d: CAST('0x' || d AS BIGINT))) AS s FROM r),
ox AS (SELECT c, j, least(9 * c + 9, 64 * j + 64) - greatest(9 * c, 64 * j) AS o FROM (SELECT unnest(range(64)) AS c), (SELECT unnest(range(9)) AS j) WHERE least(9 * c + 9, 64 * j + 64) > greatest(9 * c, 64 * j)),
a AS (SELECT doc_id, h, y, j, sum(s * o) AS s FROM q JOIN ox ON q.c = ox.c GROUP BY doc_id, h, y, j),
e AS (SELECT doc_id, h, i, j, sum(s * (least(8 * y + 8, h * (i + 1)) - greatest(8 * y, h * i))) AS s FROM a, (SELECT unnest(range(8)) AS i) WHERE least(8 * y + 8, h * (i + 1)) > greatest(8 * y, h * i) GROUP BY doc_id, h, i, j),
g AS (SELECT doc_id, i, j, (2 * s + 64 * h) // (128 * h) AS s FROM e),
f AS (SELECT k.doc_id, CAST(sum(CASE WHEN k.s < l.s AND k.i < 4 THEN CAST(1 AS BIGINT) << CAST(31 - 8 * k.i - k.j AS INT) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN k.s < l.s AND k.i >= 4 THEN CAST(1 AS BIGINT) << CAST(63 - 8 * k.i - k.j AS INT) ELSE 0 END) AS BIGINT) AS lo
  FROM g AS k JOIN g AS l ON k.doc_id = l.doc_id AND k.i = l.i AND l.j = k.j + 1 GROUP BY k.doc_id)
SELECT m.doc_id, n_bytes, 64 * h AS payload_bytes, sha256(b) AS payload_sha256,
  xor(list_reduce(list_transform(range(64), lambda k: CAST('0x' || substr(x, CAST(128 * (h - 1) + 2 * k + 1 AS INT), 2) AS BIGINT)), lambda c, d: xor(c // 256, tab[xor(c % 256, d) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS tail_crc32,
  octet_length(media) AS media_bytes, sha256(media) AS media_sha256, printf('%08x%08x', hi, lo) AS feature
FROM m JOIN f ON f.doc_id = m.doc_id, crc_table
"""
