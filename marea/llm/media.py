"""Media columns: content-addressed payloads in tar shards, addressed by digest, offset and length.

Each task appends the media files of its rows to a tar shard in the shared folder, one member per distinct digest in the
shard, named by the digest. Rows keep only the address. Metadata columns come from range reads of the headers alone;
payloads are read back by range for whoever needs them. Text payloads are stored as 8-bit greyscale PNG images, 64
samples a row, which is lossless and compressed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_dir

WIDTH = 64
#: Bytes from the start of a PNG file that hold its size and sample format.
HEADER = 33
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: Bytes of a shard after which a task starts the next one.
SHARD = 256 << 20


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG of 64 samples a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each with filter type 0
    lines[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first 33 bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return (*struct.unpack(">II", head[16:24]), head[24])


def from_png(data: bytes) -> bytes:
    """The samples of a file of to_png's kind."""
    width, height, bits = png_header(data[:HEADER])
    at, body = HEADER, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only 8-bit samples without filters are read")
    return lines[:, 1:].tobytes()


def text_file(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), to_png(padded(raw))


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block of a plain file."""
    head = bytearray(512)
    fields = ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000"))
    for at, value in fields:
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class Shard:
    """A tar file under construction; each distinct member is stored once."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        store, path = filesystem(self.uri)
        self.file, self.size, self.at = store.open_output_stream(path), 0, {}

    def add(self, media: bytes) -> tuple[str, int, int]:
        """(digest, offset, length) of the member."""
        digest = hashlib.sha256(media).hexdigest()
        if digest not in self.at:
            self.file.write(tar_header(digest, len(media)) + media + bytes(-len(media) % 512))
            self.at[digest] = self.size + 512
            self.size += 512 + len(media) + -len(media) % 512
        return digest, self.at[digest], len(media)

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def store(rows: DataFrame, media: Callable[[object], tuple[int, bytes]], folder: str, id_col: str, value_col: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row, as a written table; payloads stay in the shards.

    media gives a value's size and its file (None: of null). A shard's name is new in each attempt of a task, so a task that runs
    again leaves rows that point only to its own, complete shard.
    """
    spark = rows.sparkSession
    store_, path = filesystem(f"{folder}/shards")
    store_.create_dir(path, recursive=True)
    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard is None:
                    shard = Shard(f"{folder}/shards")
                n_bytes, file = media(value.as_py())
                digest, offset, length = shard.add(file)
                out.append((i, n_bytes, digest, shard.uri, offset, length))
                if shard.size > SHARD:
                    shard.close()
                    shard = None
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)], schema=ARROW)
        if shard is not None:
            shard.close()

    rows.select(F.col(id_col).cast("long"), F.col(value_col)).mapInArrow(run, schema).write.parquet(f"{folder}/rows")
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def read_ranges(rows: DataFrame, made: Callable[[bytes], dict], schema: str, head: int | None = None) -> DataFrame:
    """rows with the columns of schema, made from each member's bytes, or from its first head bytes only."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, last = None, None, (None, None)
        for batch in batches:
            out = []
            for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
                if shard != name:
                    s, path = filesystem(shard)
                    name, file = shard, s.open_input_file(path)
                if last[0] != (shard, offset):
                    last = (shard, offset), made(file.read_at(min(length, head or length), offset))
                out.append(last[1])
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=fields)], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{own}, {schema}")


def payload_features(media: bytes) -> dict:
    """Digests of a stored payload and features of its samples: rows, mean, spread, share of zero, most frequent sample."""
    samples = from_png(media)
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    feature = f"rows={len(x) // WIDTH};sum={total};squares={squares};zeros={counts[0]};mode={counts.argmax()};distinct={np.count_nonzero(counts)}"
    return {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-WIDTH:]), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text (null: empty) stored as an image and read back; one row per input row, whatever its id.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; then width, height
    and bits from header-only reads, and the address: digest, shard, offset, length.
    """
    folder = new_dir(docs.sparkSession, "media")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = store(texts, text_file, folder, "doc_id", "text")
    n_shards = rows.select("shard").distinct().count()
    rows = rows.repartition(max(1, n_shards), "shard").sortWithinPartitions("shard", "offset")  # a shard's size is bounded
    headers = read_ranges(rows, lambda b: dict(zip(("width", "height", "bits"), png_header(b), strict=True)), "width int, height int, bits int", HEADER)
    full = read_ranges(headers, payload_features, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")
    return full.withColumn("media_bytes", F.col("length"))
