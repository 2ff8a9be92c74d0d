"""Media columns: payloads in tar shards, addressed by content.

Each distinct payload is stored as a member of a tar file in the shared folder; a row carries
the payload's digest, and the manifest gives the shard, offset and length of its bytes. A task
writes each payload once; payloads that other tasks have stored too get one place, the first in
the order of the places, so every digest leads to one stored form. Metadata columns come from
range reads of the media's header alone; only who needs the samples reads the rest.

The media here are grey PNG images of 64 samples a row, a lossless form for any bytes.

Defined results: a null text is the empty one, whose payload is 64 zero bytes; equal texts share
digest, stored form and values; repeated rows keep their own rows; further columns are carried
along unless they have the name of an output column; an empty table stores nothing. A task that
is run again writes shards under new names, and only those of the attempt that Spark accepts are
in the manifest.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, slices, whole_text, written

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk, all that the metadata columns need.
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20


def payload_column(text_col: str = "text"):
    """The text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64."""
    raw = F.encode(whole_text(text_col), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(float(ROW))).cast("int")) * ROW
    return F.call_function("rpad", raw, size, F.lit(b"\0"))


def encode_png(payload: bytes) -> bytes:
    """8-bit grey PNG of 64 samples a row, no filter."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """Width, height, bit depth and colour kind from a PNG's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that encode_png has made."""
    head, at, packed = read_header(data), 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head["height"], head["width"] + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean, spread and an 8 x 8 average hash of the image."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int64)
    edges = np.linspace(0, len(x), 9).astype(int)
    cells = np.array([[x[a : max(b, a + 1), j : j + 8].mean() if a < len(x) else 0.0 for j in range(0, ROW, 8)] for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = "".join("1" if c else "0" for c in (cells > cells.mean()).ravel())
    return f"{ROW}x{len(x)} mean={x.mean():.4f} std={x.std():.4f} ahash={int(bits, 2):016x}"


class ShardWriter:
    """Tar files of about shard_bytes in a folder that any pyarrow file system reaches."""

    def __init__(self, folder: str, shard_bytes: int = SHARD_BYTES):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.most, self.out, self.at = folder, shard_bytes, None, 0
        self.places: list[tuple[str, str, int, int]] = []

    def add(self, digest: str, data: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        self.places.append((digest, f"{self.uri}/{self.name}", self.at + len(head), len(data)))
        self.at += len(head) + len(data) + -len(data) % 512

    def full(self) -> bool:
        return self.at >= self.most

    def close(self) -> list[tuple[str, str, int, int]]:
        """Ends the shard; the places of its members."""
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
        done, self.places, self.out, self.at = self.places, [], None, 0
        return done


def store(docs: DataFrame, folder: str | None = None, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes each distinct payload; the manifest: digest (of the payload), shard, offset, length, a row a digest."""
    folder = folder or fresh_path(docs.sparkSession, "media")

    def run(batches):
        writer, seen = ShardWriter(folder, shard_bytes), set()

        def rows(places):
            cols = list(zip(*places, strict=True)) if places else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["digest", "shard", "offset", "length"])

        for batch in slices(batches, "payload"):
            for payload in batch.column(0).to_pylist():
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    writer.add(digest, encode_png(payload))
                    if writer.full():
                        yield rows(writer.close())
        yield rows(writer.close())

    placed = docs.select(payload_column(text_col).alias("payload")).mapInArrow(run, "digest string, shard string, offset long, length long")
    stored = written(placed, "media-places")
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(batches, size):
    """(batch, bytes of each row): of each row's media the first `size` bytes, or all; a shard is opened once a run of rows."""
    opened: tuple = (None, None)
    for batch in slices(batches, "length"):
        out = []
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if opened[0] != shard:
                if opened[1] is not None:
                    opened[1].close()
                fs, path = pafs.FileSystem.from_uri(shard)
                opened = (shard, fs.open_input_file(path))
            opened[1].seek(offset)
            out.append(opened[1].read(min(size or length, length)))
        yield batch, out


def by_shard(manifest: DataFrame) -> DataFrame:
    """The manifest with the rows of a stretch of a shard together and in order, so that reads go forward."""
    stretch = F.floor(F.col("offset") / F.lit(64 << 20))
    return manifest.repartition("shard", stretch).sortWithinPartitions("shard", "offset")


def metadata(manifest: DataFrame) -> DataFrame:
    """The manifest plus width, height, bit_depth, colour, from range reads of the headers alone."""

    def run(batches):
        for batch, heads in _ranges(batches, HEADER_BYTES):
            found = [read_header(h) for h in heads]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[c] for x in found], pa.int64()) for c in ("width", "height", "bit_depth", "colour"))], names=[*batch.schema.names, "width", "height", "bit_depth", "colour"])

    return by_shard(manifest).mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bit_depth long, colour long")


def features(manifest: DataFrame) -> DataFrame:
    """What the stored bytes, read back, hold: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for batch, media in _ranges(batches, None):
            payloads = [decode_png(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest"),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-ROW:]) for p in payloads], pa.int64()),
                    pa.array(map(len, media), pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(map(feature_of, payloads)),
                ],
                names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kinds = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return by_shard(manifest).select("digest", "shard", "offset", "length").mapInArrow(run, kinds)


def references(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, plus n_bytes (unfilled) and digest (of the payload)."""
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "digest")]
    return docs.select(*kept, F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"), F.sha2(payload_column(text_col), 256).alias("digest"))
