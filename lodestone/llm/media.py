"""Media columns: a data source over archives of media members, written and read by Arrow batches.

``media_archive`` is a Python data source. Writing stores payloads as members of ZIP archives
in a folder, one archive per task, under a name of the attempt; only the archives that the
driver commits are listed in a manifest of the commit, so a lost executor leaves nothing behind
that is ever read. Reading plans byte ranges over the archives by the manifests alone, which
also mark where in the directory the entries of each stretch lie; a task reads those of its
range, takes the members whose offset falls into it, and streams their payloads in Arrow
batches of bounded size. A member that can't be read or
whose checksum is wrong is tried again by its own offset, alone and through a newly opened
file; after ``retries`` the task fails, as results have to be whole.

Payloads are grey-scale PNG images of 8 bits a sample, ``ROW`` samples a row. Files are opened
through Arrow's file systems, so the folder may be in any store they know.

Defined results: a null or empty text becomes one padded block; equal texts give equal
members; a member keeps its row's key as its name. An
empty table writes an empty manifest and reads as no rows. Payloads are whole texts; a batch
holds one payload at least.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestone.llm.common import fresh_dir, read, tidied

#: Samples of a row, and the multiple that payloads are padded to.
ROW = 576
PAD = b"\xff"
#: Bytes of an archive that a partition covers, payload bytes of a batch, and tries of a member.
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 4
#: Seconds before the first retry.
WAIT = 0.05
#: Begins the name of a commit's list of archives.
MANIFEST = "_manifest-"
#: Bytes of members between two marks, which tell where in the directory their entries begin.
MARK_BYTES = 1 << 20
LEVEL = 1
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes) -> bytes:
    """data, padded, as a grey-scale image of 8 bits; the unpadded length is in a text chunk."""
    body = padded(data)
    rows = np.frombuffer(body, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"".join([_PNG, _chunk(b"IHDR", head), _chunk(b"tEXt", b"bytes\0%d" % len(data)), _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)), _chunk(b"IEND", b"")])


def decode_png(stored: bytes) -> tuple[bytes, int]:
    """(samples, unpadded length) of an image that encode_png made; checksums are verified."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, width, n, idat = 8, 0, None, []
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey-scale")
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """A difference hash: the samples in reading order are averaged on 8 rows of 9 cells; 64 bits in hex."""
    samples = np.frombuffer(payload, np.uint8)
    cuts = np.arange(73) * len(samples) // 72
    grid = (np.add.reduceat(samples, cuts[:-1], dtype=np.int64) / np.diff(cuts)).reshape(8, 9)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


# --- the archive format: ZIP without compression, its directory at the end ---

_LOCAL = struct.Struct("<IHHHHHIIIHH")
_CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
_END64 = struct.Struct("<IQHHIIQQQQ")
_LOCATOR = struct.Struct("<IIQI")
_END = struct.Struct("<IHHHHIIH")
_FULL = 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int
    crc: int


def local_header(name: bytes, size: int, crc: int) -> bytes:
    if size >= _FULL:
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        return _LOCAL.pack(0x04034B50, 45, 0x800, 0, 0, 0x21, crc, _FULL, _FULL, len(name), len(extra)) + name + extra
    return _LOCAL.pack(0x04034B50, 20, 0x800, 0, 0, 0x21, crc, size, size, len(name), 0) + name


def entry(m: Member) -> bytes:
    """A member's entry in the directory."""
    name, extra = m.name.encode(), b""
    size, offset = m.size, m.offset
    if size >= _FULL or offset >= _FULL:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
        size = offset = _FULL
    return _CENTRAL.pack(0x02014B50, 45, 45, 0x800, 0, 0, 0x21, m.crc, size, size, len(name), len(extra), 0, 0, 0, 0, offset) + name + extra


def directory(members: list[Member], at: int) -> bytes:
    """The archive's directory and its end records, to be written at offset at."""
    body = b"".join(map(entry, members))
    end64 = _END64.pack(0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(body), at)
    locator = _LOCATOR.pack(0x07064B50, 0, at + len(body), 1)
    few = min(len(members), 0xFFFF)
    return body + end64 + locator + _END.pack(0x06054B50, 0, 0, few, few, min(len(body), _FULL), min(at, _FULL), 0)


def read_directory(f) -> list[Member]:
    """The members of an open archive, from the directory at its end."""
    size = f.size()
    tail_size = _END.size + _LOCATOR.size + _END64.size
    f.seek(max(0, size - tail_size))
    tail = f.read()
    if tail[: 4] != struct.pack("<I", 0x06064B50):
        raise ValueError("not an archive of this source")
    fields = _END64.unpack_from(tail)
    length, at = fields[8], fields[9]
    return entries(f, at, at + length)


def entries(f, begin: int, end: int) -> list[Member]:
    """The members whose entries lie between two offsets of the directory."""
    f.seek(begin)
    body, members, i = f.read(end - begin), [], 0
    if len(body) < end - begin:
        raise OSError("the directory is cut off")
    while i < len(body):
        h = _CENTRAL.unpack_from(body, i)
        n, x, c = h[10], h[11], h[12]
        name = body[i + _CENTRAL.size : i + _CENTRAL.size + n].decode()
        size, offset = h[9], h[16]
        if size == _FULL and offset == _FULL:
            _, _, size, _, offset = struct.unpack_from("<HHQQQ", body, i + _CENTRAL.size + n)
        members.append(Member(name, offset, size, h[7]))
        i += _CENTRAL.size + n + x + c
    return members


def read_member(f, m: Member) -> bytes:
    """The bytes of one member by its own offset, checked."""
    f.seek(m.offset)
    head = f.read(_LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != struct.pack("<I", 0x04034B50):
        raise OSError(f"no member at {m.offset}")
    h = _LOCAL.unpack(head)
    name = f.read(h[9] + h[10])[: h[9]].decode()
    data = f.read(m.size)
    if name != m.name or len(data) != m.size or zlib.crc32(data) != m.crc:
        raise OSError(f"member {m.name} at {m.offset} is damaged")
    return data


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


# --- the data source ---


class MediaArchive(DataSource):
    """Format ``media_archive``. Options: path, range_bytes, batch_bytes, retries, wait (seconds before the first retry, doubled for each).

    Every commit adds a manifest of its own, so appended archives join the earlier ones; a write
    in mode overwrite removes the manifests before it, and the archives that they list.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, archive string, offset bigint, stored binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST))


@dataclass
class _Range(InputPartition):
    archive: str
    begin: int
    end: int
    first: int  # where the directory's entries of the range lie, with some of its neighbours
    last: int


@dataclass
class _Written(WriterCommitMessage):
    archive: str
    members: int
    bytes: int
    marks: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.wait = float(options.get("wait", WAIT))

    def partitions(self) -> list[_Range]:
        fs, root = filesystem(self.path)
        archives = []
        for place in _manifests(fs, root):
            with fs.open_input_stream(place) as f:
                archives += json.loads(f.read())
        found = []
        for a in archives:
            offsets, places = zip(*a["marks"], strict=True)
            # members lie before the directory; a mark at it ends them
            for b in range(0, offsets[-1], self.range_bytes):
                e = min(b + self.range_bytes, offsets[-1])
                found.append(_Range(a["archive"], b, e, places[bisect_right(offsets, b) - 1], places[bisect_left(offsets, e)]))
        return found or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = filesystem(self.path)
        place = f"{root}/{partition.archive}"
        f = fs.open_input_file(place)
        try:
            members = [m for m in self._try(lambda g: entries(g, partition.first, partition.last), f, fs, place) if partition.begin <= m.offset < partition.end]
            held: list[tuple[Member, bytes]] = []
            size = 0
            for m in members:
                held.append((m, self._try(lambda g, m=m: read_member(g, m), f, fs, place)))
                size += m.size
                if size >= self.batch_bytes:
                    yield self._batch(partition.archive, held)
                    held, size = [], 0
            if held:
                yield self._batch(partition.archive, held)
        finally:
            f.close()

    def _try(self, what, f, fs, place):
        """what(f); if it fails, again through a newly opened file, up to retries times."""
        try:
            return what(f)
        except (OSError, ValueError) as first:
            error = first
        for k in range(self.retries):
            time.sleep(self.wait * 2**k)
            try:
                with fs.open_input_file(place) as g:
                    return what(g)
            except (OSError, ValueError) as again:
                error = again
        raise error

    @staticmethod
    def _batch(archive: str, held: list[tuple[Member, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([m.name for m, _ in held], pa.string()), pa.array([archive] * len(held), pa.string()), pa.array([m.offset for m, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())],
            names=["name", "archive", "offset", "stored"],
        )


class _Writer(DataSourceArrowWriter):
    """Rows (name string, payload binary) become members; the payload is encoded as an image."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        archive, members, at = f"part-{uuid.uuid4().hex}.zip", [], 0
        marks, listed = [(0, 0)], 0
        with fs.open_output_stream(f"{root}/{archive}") as out:
            for batch in iterator:
                for name, payload in zip(batch.column("name"), batch.column("payload"), strict=True):
                    stored = encode_png(payload.as_py() or b"")
                    m = Member(name.as_py() or "", at, len(stored), zlib.crc32(stored))
                    head = local_header(m.name.encode(), m.size, m.crc)
                    out.write(head)
                    out.write(stored)
                    members.append(m)
                    at += len(head) + len(stored)
                    listed += len(entry(m))
                    if at - marks[-1][0] >= MARK_BYTES:
                        marks.append((at, listed))
            end = directory(members, at)
            out.write(end)
        if marks[-1][0] < at:
            marks.append((at, listed))
        return _Written(archive, len(members), at + len(end), [(offset, at + place) for offset, place in marks])

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed = [{"archive": m.archive, "members": m.members, "bytes": m.bytes, "marks": m.marks} for m in messages if m is not None and m.members]
        before = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(listed).encode())
        for place in before:
            with fs.open_input_stream(place) as f:
                old = json.loads(f.read())
            fs.delete_file(place)
            for a in old:
                fs.delete_file(f"{root}/{a['archive']}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.archive}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the texts of docs as members of archives in path, named by key ('' for null)."""
    register(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")).alias("payload"))
    rows.write.format("media_archive").mode("append").option("path", path).save()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The members in path: name, archive, offset, stored."""
    register(spark)
    return spark.read.format("media_archive").option("path", path).options(**options).load()


def described(members: DataFrame) -> DataFrame:
    """Per member: name, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for s in batch.column(1):
                stored = s.as_py()
                payload, n = decode_png(stored)
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["name", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return members.select("name", "stored").mapInArrow(tidied("media", run), "name string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op2_media(spark, sf_dir) -> DataFrame:
    path = fresh_dir(spark, "media")
    store(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    out = described(load(spark, path))
    return out.withColumn("doc_id", F.when(F.col("name") != "", F.col("name")).cast("bigint")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op2_media": op2_media}
