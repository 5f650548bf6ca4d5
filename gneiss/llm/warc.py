"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; each bundle ends with the seek table of the public
seekable format (a skippable frame), and an index maps record identifiers to (bundle, frame, offset in the frame). Tasks
write whole bundles to the shared folder under names that follow from their content's place, through a temporary name and
a rename, so that a repeated task replaces its own file. Reading opens a bundle's footer first and then single frames.

Equal payloads of at least REVISIT_BYTES are stored once: the record with the largest page id is the response, the
others are revisits of it. Null payloads count as empty. Rows of one page id are records of their own, each with its own
payload; of equal payloads all rows with the largest id are responses. A row whose id is null is a response, also where rows
with ids share its payload, for it has no place in their order. Nothing is written for an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import column, lean, pieces, save, scratch_path, ship

FRAME_BYTES, BUNDLE_BYTES, REVISIT_BYTES = 1 << 18, 16 << 20, 1000
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries headers only."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: headers, body, and the offset after it."""
    raw = bytes(data[at : at + 65536])
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:  # a very long header
        raw = bytes(data[at:])
        cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = at + cut + 4
    end = begin + int(head["Content-Length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    return head, bytes(data[begin:end]), end + 4


class BundleWriter:
    """Collects records into frames; finish() gives the bundle's bytes and the index rows."""

    def __init__(self, level: int = 3):
        import zstandard

        self.z = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.out, self.open, self.size = [], [], 0
        self.index: list[tuple[int, int, int, int]] = []
        self.total = 0

    def add(self, page_id: int, raw: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.size, len(raw)))
        self.open.append(raw)
        self.size += len(raw)
        self.total += len(raw)
        if self.size >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.z.compress(b"".join(self.open))
            self.frames.append((len(packed), self.size))
            self.out.append(packed)
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self._close()
        body = b"".join(struct.pack("<II", c, d) for c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE, len(body)) + body


class BundleReader:
    """Random access to a bundle's frames through a readable file of known size."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the bundle's end")
        width = 12 if flags & 128 else 8
        file.seek(size - 9 - n * width)
        table = file.read(n * width)
        self.frames = [struct.unpack_from("<II", table, i * width) for i in range(n)]
        self.at = np.concatenate([[0], np.cumsum([c for c, _ in self.frames])]).astype(np.int64)

    def frame(self, k: int) -> memoryview:
        import zstandard

        self.file.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(self.frames[k][0]), max_output_size=self.frames[k][1])
        if len(data) != self.frames[k][1]:
            raise ValueError("a frame's size differs from the seek table")
        return memoryview(data)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def store(uri: str, data: bytes, tag: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.{tag}.tmp") as f:
        f.write(data)
    fs.move(f"{path}.{tag}.tmp", path)


INDEX = "page_id long, bundle string, frame int, offset long, length long"


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all records under folder; returns the index (lazy: bundles are written when it is computed)."""
    spark = pages.sparkSession
    ship(spark)
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("body"))
    large = p.select("id", F.sha2("body", 256).alias("sha2"), F.octet_length("body").alias("n")).filter(F.col("n") >= REVISIT_BYTES).select("id", "sha2")
    # written, so that both sides of the join come from files and a payload with very many copies can be split
    last = save(large.groupBy("sha2").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "payloads")
    # only copies get a row here, told apart by id and payload: an id may stand for several payloads
    again = save(large.join(last.hint("merge"), "sha2").filter("id <> keeper").select(F.col("id").alias("copy"), F.col("sha2").alias("payload"), "keeper").distinct(), "copies")
    own = F.when(F.octet_length("body") >= REVISIT_BYTES, F.sha2("body", 256))
    rows = p.join(again.hint("merge"), (F.col("id") == F.col("copy")) & (own == F.col("payload")), "left").select("id", "url", "body", "keeper", F.sha1("body").alias("sha1"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, w, k = TaskContext.get(), BundleWriter(), 0

        def done() -> pa.RecordBatch:
            nonlocal w, k
            name = f"part-{t.partitionId():05d}-{k:04d}.warc.zst"
            store(f"{folder}/{name}", w.finish(), str(t.taskAttemptId()))
            i = w.index
            w, k = BundleWriter(), k + 1
            return pa.record_batch([pa.array([r[0] for r in i], pa.int64()), pa.array([name] * len(i), pa.string()), pa.array([r[1] for r in i], pa.int32()), pa.array([r[2] for r in i], pa.int64()), pa.array([r[3] for r in i], pa.int64())], names=[f.split()[0] for f in INDEX.split(", ")])

        for b in pieces(batches, "body"):
            for i, url, body, keeper, sha1 in zip(*(column(b, c).to_pylist() for c in ("id", "url", "body", "keeper", "sha1")), strict=True):
                w.add(i, record(i, url, body, sha1, keeper))
                if w.total >= BUNDLE_BYTES:
                    yield done()
        if w.index:
            yield done()

    return rows.mapInArrow(lean(write), INDEX)


def read_index(index: DataFrame, folder: str) -> DataFrame:
    """Reads each indexed record back by its frame and offset: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ship(index.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            rows, name, reader, kept = [], None, None, (-1, None)
            for i, bundle, frame, offset in zip(*(column(b, c).to_pylist() for c in ("page_id", "bundle", "frame", "offset")), strict=True):
                if bundle != name:
                    path = f"{root}/{bundle}"
                    name, reader, kept = bundle, BundleReader(fs.open_input_file(path), fs.get_file_info(path).size), (-1, None)
                if kept[0] != frame:
                    kept = (frame, reader.frame(frame))
                head, body, _ = parse(kept[1], offset)
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = head["WARC-Type"]
                if head["WARC-Record-ID"] != f"<urn:page:{i}>" or kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"record {i} differs from its index or digest")
                ref = head.get("WARC-Refers-To")
                rows.append((i, int(head["X-Payload-Length"]), digest, kind, int(ref[10:-1]) if ref else None, head["WARC-Target-URI"]))
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=[f.split()[0] for f in schema.split(", ")])

    return index.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(lean(read), schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads the records back."""
    spark = pages.sparkSession
    folder, at = scratch_path(spark, "warc"), scratch_path(spark, "warc-index")
    write_bundles(pages, folder).write.parquet(at)
    return read_index(spark.read.schema(INDEX).parquet(at), folder)
