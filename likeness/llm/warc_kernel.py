"""WARC records and archive files, written and read inside Spark tasks.

Pickled by value: executors need pyarrow only. Files are opened through
``pyarrow.fs``, so the folder may be any shared store it knows.
"""

from __future__ import annotations

import hashlib
import io
import sys
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_ID = "-"

FILES = pa.schema(
    [
        ("partition", pa.int64()),
        ("number", pa.int64()),
        ("temporary", pa.string()),
        ("records", pa.int64()),
        ("bytes", pa.int64()),
        ("sha256", pa.string()),
    ]
)
READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def store(folder: str):
    """File system and path of a folder given as URI or plain path."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The same for the same page and payload, whenever it is written."""
    name = f"{EMPTY_ID if page_id is None else page_id}/{payload_digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def header_text(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record with fresh headers; a revisit has HTTP headers and no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_text(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", EMPTY_ID if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + "\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, without a time of writing."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roller:
    """Writes records to temporary files, a new one when one is full."""

    def __init__(self, folder: str, roll_bytes: int, partition: int, attempt: str):
        self.fs, self.root = store(folder)
        self.roll_bytes, self.partition = roll_bytes, partition
        self.prefix = f"_temporary/{partition:06d}-{attempt}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.number, self.out = -1, None
        self.done: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.number += 1
            self.name = f"{self.prefix}-{self.number:06d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append(
                (self.partition, self.number, self.name, self.records, self.size, self.digest.hexdigest())
            )


def write_batches(batches, folder: str, roll_bytes: int, date: str):
    """Write the sorted rows of a partition; one row comes back for each file."""
    context = TaskContext.get()
    roller = Roller(folder, roll_bytes, context.partitionId(), uuid.uuid4().hex)
    note = None
    for batch in batches:
        for page_id, digest, kind, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                note = (page_id, digest, refers_to)
                continue
            response = note[2] if note and note[:2] == (page_id, digest) else None
            roller.add(member(record(page_id, url, html.encode(), digest, response, date)))
    roller.close()
    columns = list(zip(*roller.done)) or [[]] * len(FILES)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, FILES)], schema=FILES
    )


def commit_batches(batches, folder: str):
    """Give files their final names. A file already there under its name is done."""
    fs, root = store(folder)
    for batch in batches:
        for temporary, final in zip(*(c.to_pylist() for c in batch.columns)):
            if fs.get_file_info(f"{root}/{temporary}").type == pafs.FileType.File:
                fs.move(f"{root}/{temporary}", f"{root}/{final}")
            elif fs.get_file_info(f"{root}/{final}").type != pafs.FileType.File:
                raise FileNotFoundError(f"{root}/{temporary}")
        yield batch


def stream_members(source):
    """The records of an archive, one gzip member at a time."""
    held = b""
    while True:
        unpacker = zlib.decompressobj(31)
        out = []
        while not unpacker.eof:
            data = held or source.read(1 << 20)
            held = b""
            if not data:
                if out:
                    raise ValueError("an archive ends inside a record")
                return
            out.append(unpacker.decompress(data))
        held = unpacker.unused_data
        yield b"".join(out)


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(
        int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")
    )
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its headers")
    number = lambda text: None if text in (None, EMPTY_ID) else int(text)
    return {
        "page_id": number(fields["X-Page-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("X-Refers-To-Page-ID")),
        "url": fields["WARC-Target-URI"],
    }


def read_batches(batches, folder: str, rows: int = 10_000):
    """Parse and verify the records of the named files."""
    fs, root = store(folder)
    for batch in batches:
        for name, digest in zip(*(c.to_pylist() for c in batch.columns)):
            found, seen = [], hashlib.sha256()
            with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                for data in stream_members(Digested(raw, seen)):
                    found.append(parse(data))
                    if len(found) == rows:
                        yield pa.RecordBatch.from_pylist(found, READ)
                        found = []
            if seen.hexdigest() != digest:
                raise ValueError(f"{name} differs from its manifest")
            yield pa.RecordBatch.from_pylist(found, READ)


class Digested(io.RawIOBase):
    def __init__(self, raw, digest):
        self.raw, self.digest = raw, digest

    def read(self, size=-1):
        data = self.raw.read(size)
        self.digest.update(data)
        return data
