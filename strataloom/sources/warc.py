"""WARC files as a Spark data source whose partitions are ranges of members' offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: All columns; a schema with fewer spares the work for the others.
SCHEMA = "file string, offset long, record int, warc_type string, record_id string, target_uri string, date string, content_type string, headers map<string,string>, length long, payload binary, payload_digest string, error string"
#: Bytes of a file that a partition begins members in, and bytes read at once.
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_MOST_HEADER = 1 << 20
_NAMES = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Damaged(ValueError):
    """What is wrong with a member."""


class RecordParser:
    """Records from decompressed bytes, however they are cut; keeps a payload only if it is asked for."""

    def __init__(self, keep_payload: bool, digest: bool):
        self.keep, self.digest = keep_payload, digest
        self.rest = bytearray()
        self.headers: dict[str, str] | None = None
        self.left = self.tail = 0

    def feed(self, data: bytes) -> Iterator[dict]:
        self.rest += data
        while True:
            if self.tail:  # the two line ends after a block
                while self.tail and self.rest[:2] == b"\r\n":
                    del self.rest[:2]
                    self.tail -= 1
                if self.tail and len(self.rest) < 2:
                    return
                if self.tail:
                    raise Damaged("a block is longer than its Content-Length")
            if self.headers is None:
                end = self.rest.find(b"\r\n\r\n")
                if end < 0:
                    if len(self.rest) > _MOST_HEADER or (len(self.rest) >= 5 and not self.rest.startswith(b"WARC/")):
                        raise Damaged("no WARC header")
                    return
                self._begin(bytes(self.rest[:end]))
                del self.rest[: end + 4]
            taken = self.rest[: self.left]
            if self.hash is not None:
                self.hash.update(taken)
            if self.keep:
                self.payload += taken
            del self.rest[: len(taken)]
            self.left -= len(taken)
            if self.left:
                return
            yield {"headers": self.headers, "length": self.length, "payload": bytes(self.payload) if self.keep else None, "payload_digest": f"sha256:{self.hash.hexdigest()}" if self.hash else None}
            self.headers, self.tail = None, 2

    def _begin(self, header: bytes) -> None:
        lines = header.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Damaged("no WARC header")
        fields = (line.partition(":") for line in lines[1:] if line.strip())
        self.headers = {name.strip(): value.strip() for name, _, value in fields}
        length = self.headers.get("Content-Length", "")
        if not length.isdigit():
            raise Damaged(f"no length: {length!r}")
        self.left = self.length = int(length)
        self.payload = bytearray()
        self.hash = hashlib.sha256() if self.digest else None

    def finish(self) -> None:
        if self.headers is not None or self.rest:
            raise Damaged("the file or member ends within a record")


class _Source:
    """A file read forward, a window of it at a time."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        self.data = b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _members(file, start: int, end: int, keep: bool, digest: bool) -> Iterator[dict]:
    """Records, or errors, of the gzip members that begin from ``start`` to before ``end``.

    A range begins at the first offset that looks like a member and decompresses to a WARC header.  After damage the next such is looked for.
    """
    source = _Source(file, start)
    seeking = True
    while True:
        if seeking:
            found = source.data.find(_MAGIC)
            if found < 0:
                keep_tail = min(len(source.data), len(_MAGIC) - 1)
                source.skip(len(source.data) - keep_tail)
                if source.at >= end or not source.more():
                    return
                continue
            source.skip(found)
            if source.at >= end:
                return
            if not _is_member(source):
                source.skip(1)
                continue
            seeking = False
        if source.at >= end:
            return
        if not source.data and not source.more():
            return
        offset, parser, number = source.at, RecordParser(keep, digest), 0
        inflate = zlib.decompressobj(31)
        # until the member is whole its bytes are not let go of: where it is damaged, the next one is looked for right behind its start
        try:
            fed = 0
            while not inflate.eof:
                if fed == len(source.data) and not source.more():
                    raise Damaged("the file or member ends within a record")
                part = source.data[fed : fed + READ_BYTES]
                fed += len(part)
                for record in parser.feed(inflate.decompress(part)):
                    yield {"offset": offset, "record": number, **record}
                    number += 1
                if fed > 4 * READ_BYTES and not inflate.eof:
                    source.skip(fed)
                    fed = 0
            source.skip(fed - len(inflate.unused_data))
            parser.finish()
        except (zlib.error, Damaged) as error:
            yield {"offset": offset, "record": number, "error": str(error)}
            source.skip(1 if source.at == offset and source.data else 0)
            seeking = True


def _is_member(source: _Source) -> bool:
    if len(source.data) < 1024:
        source.more()
    try:
        return zlib.decompressobj(31).decompress(source.data[:4096], 5) == b"WARC/"
    except zlib.error:
        return False


def _plain(file, keep: bool, digest: bool) -> Iterator[dict]:
    parser, number = RecordParser(keep, digest), 0
    try:
        while data := file.read(READ_BYTES):
            for record in parser.feed(data):
                yield {"offset": 0, "record": number, **record}
                number += 1
        parser.finish()
    except Damaged as error:
        yield {"offset": 0, "record": number, "error": str(error)}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        """Ranges of the compressed files, however long their members are; a file that is not compressed is one range."""
        from pyarrow import fs

        store, inner = _filesystem(self.path)
        found = store.get_file_info(inner)
        files = [found] if found.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            if x.path.endswith(".gz"):
                out += [Range(x.path, at, min(at + self.split, x.size)) for at in range(0, x.size, self.split)]
            elif x.path.endswith(".warc"):
                out.append(Range(x.path, 0, x.size))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _filesystem(self.path)
        keep, digest = "payload" in self.columns, "payload_digest" in self.columns
        with store.open_input_file(partition.path) as file:
            rows = _members(file, partition.start, partition.end, keep, digest) if partition.path.endswith(".gz") else _plain(file, keep, digest)
            for row in rows:
                headers = row.get("headers") or {}
                row |= {name: headers.get(header) for name, header in _NAMES.items()} | {"file": partition.path}
                yield tuple(row.get(name) for name in self.columns)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").schema(...).load(path)``: a row for each record, and for each damaged member one with ``error``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the WARC files (.warc, .warc.gz) at ``path``, a file or folder; only the named columns are made."""
    spark.dataSource.register(WarcDataSource)
    kinds = dict(field.split(" ", 1) for field in SCHEMA.split(", "))
    shape = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(shape).option("splitBytes", split_bytes).load(path)


def record_bytes(uri: str, body: bytes, kind: str = "resource", content_type: str = "text/html", date: datetime | None = None) -> bytes:
    """One record, compressed to a member of its own."""
    stamp = (date or datetime(1970, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = hashlib.sha256(uri.encode() + b"\x00" + body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:sha256:{name}>\r\nWARC-Date: {stamp}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + body + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, path: str, uri: str = "url", body: str = "html") -> None:
    """A file of members for each partition of ``pages``, written under the name of its task and renamed when whole.

    ``path`` is a folder that all executors share.  A task that runs twice writes the same file again.
    """

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, inner = _filesystem(path)
        store.create_dir(inner, recursive=True)
        part = f"{inner}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary = f"{part}.{TaskContext.get().taskAttemptId()}"
        n = 0
        with store.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for address, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.write(record_bytes(address or "", (text or "").encode()))
                    n += 1
        store.move(temporary, part)
        yield pa.record_batch([pa.array([part]), pa.array([n])], ["file", "records"])

    pages.select(uri, body).mapInArrow(put, "file string, records long").collect()  # a row for each task
