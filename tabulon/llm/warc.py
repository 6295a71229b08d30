"""WARC archives compressed with Zstandard, one frame for each record.

An archive begins with a skippable frame that holds the dictionary of all its
other frames (as it is, or compressed itself); each further frame is one
record.  The reader walks from frame to frame by their block headers, decodes
every frame by itself with the dictionary, and validates the record: version
line, header lines, the mandatory headers, Content-Length against the block,
and the two line ends after it.

Scale: one task streams one archive and holds one frame; archives are made of
about ``ARCHIVE`` bytes, so their number follows the data.  No shuffle.  The
writer lists its archives in a table in the shared folder; files of lost or
repeated attempts aren't listed and are never read.

Defined results: a frame that can't be decoded or validated is a row with
valid = false, an error and what could be read; after a place where no frame
begins the rest of the archive is one such row.  An archive without a
dictionary, and an empty one, are read as well; skippable frames elsewhere are
passed over.  The writer keeps null html, null url and null page_id (left out
of the headers; null html is marked), empty and long html, and repeated rows;
line ends, blanks at the ends and per cent signs before hexadecimal digits of
a url are written per cent encoded and come back as they were.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Scratch, ship

FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
ARCHIVE, DICT_SIZE, SAMPLES, LEVEL = 16 << 20, 64 << 10, 400, 3
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD = "archive string, offset long, frame_bytes long, type string, record_id string, date string, uri string, content_type string, content_length long, headers map<string,string>, content binary, valid boolean, error string"
_KIND = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("frame_bytes", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary()), ("valid", pa.bool_()), ("error", pa.string())])


class Damaged(ValueError):
    """The stream doesn't go on with a frame."""


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise Damaged("the frame is cut off")
    return got


def frames(f) -> Iterator[tuple[int, int, bytes]]:
    """(offset, magic number, bytes) of each frame of a stream: of a skippable
    frame its content, of another all its bytes."""
    at = 0
    while head := f.read(4):
        if len(head) < 4:
            raise Damaged("the frame is cut off")
        magic = struct.unpack("<I", head)[0]
        if magic in SKIPPABLE:
            size = struct.unpack("<I", _exactly(f, 4))[0]
            yield at, magic, _exactly(f, size)
            at += 8 + size
            continue
        if magic != FRAME:
            raise Damaged(f"no frame begins here: {head.hex()}")
        parts = [head, _exactly(f, 1)]
        flags = parts[1][0]
        single = flags >> 5 & 1
        size = (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        parts.append(_exactly(f, size))
        last = False
        while not last:
            block = _exactly(f, 3)
            word = int.from_bytes(block, "little")
            last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
            if kind == 3:
                raise Damaged("the frame has a block of a reserved kind")
            parts += [block, _exactly(f, 1 if kind == 1 else size)]
        if flags >> 2 & 1:
            parts.append(_exactly(f, 4))
        frame = b"".join(parts)
        yield at, magic, frame
        at += len(frame)


def parse(record: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """(headers by lower-case name, block, error or None) of a record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    headers: dict[str, str] = {}
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return headers, None, "the version line is missing"
    if not found:
        return headers, None, "the headers don't end"
    name = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not re.fullmatch(r"[!#-'*+.0-9A-Z^-z|~-]+", name):
            return headers, None, f"not a header: {text[:60]}"
        if name in headers and name != "warc-concurrent-to":
            return headers, None, f"the header {name} is repeated"
        headers[name] = value.strip()
    for name in NEEDED:
        if not headers.get(name):
            return headers, None, f"the header {name} is missing"
    if not re.fullmatch(r"\d+", headers["content-length"]):
        return headers, None, "Content-Length isn't a number"
    size = int(headers["content-length"])
    if len(rest) < size + 4:
        return headers, rest[:size], f"Content-Length is {size}, but {max(0, len(rest) - 4)} bytes are there"
    if rest[size : size + 4] != b"\r\n\r\n":
        return headers, rest[:size], "the block isn't followed by two line ends"
    if len(rest) > size + 4:
        return headers, rest[:size], "the frame goes on after its record"
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(rest[:size]).hexdigest():
        return headers, rest[:size], "the block digest differs"
    return headers, rest[:size], None


def records(f, archive: str) -> Iterator[tuple]:
    """The rows of one archive, in the order of ``RECORD``."""
    import zstandard

    decoder = zstandard.ZstdDecompressor()
    walk, first, at = frames(f), True, 0
    while True:
        try:
            at, magic, frame = next(walk)
        except StopIteration:
            return
        except Damaged as x:
            yield (archive, f.tell(), None, *[None] * 6, [], None, False, str(x))
            return
        if magic != FRAME:
            if first and magic == DICTIONARY:
                try:
                    if frame[:4] == struct.pack("<I", FRAME):
                        frame = zstandard.ZstdDecompressor().decompressobj().decompress(frame)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frame))
                except zstandard.ZstdError as x:
                    yield (archive, at, len(frame) + 8, *[None] * 6, [], None, False, f"the dictionary can't be loaded: {x}")
            first = False
            continue
        first = False
        try:
            one = decoder.decompressobj()
            data = one.decompress(frame)
            if not one.eof:
                raise zstandard.ZstdError("it doesn't end")
        except zstandard.ZstdError as x:
            yield (archive, at, len(frame), *[None] * 6, [], None, False, f"the frame can't be decoded: {x}")
            continue
        h, block, error = parse(data)
        size = h.get("content-length", "")
        yield (archive, at, len(frame), h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), h.get("content-type"), int(size) if re.fullmatch(r"\d{1,18}", size) else None, list(h.items()), block, error is None, error)


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(at, buffer_size=1 << 20)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _KIND)], schema=_KIND)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            with _open(path) as f:
                held, size = [], 0
                for row in records(f, path):
                    held.append(row)
                    size += len(row[10] or b"")
                    if size > 4 << 20 or len(held) >= 1000:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)


def read(paths: DataFrame) -> DataFrame:
    """Every record of the archives in the column ``path`` (see ``RECORD``).
    Null paths are left out; a path that is there twice is read twice."""
    spark = paths.sparkSession
    ship(spark)
    each = paths.where("path is not null").select("path")
    return each.mapInArrow(_read, RECORD)


# ---- writing ----------------------------------------------------------------


def _escaped(url: str) -> str:
    url = re.sub(r"%(?=[0-9A-Fa-f]{2})", "%25", url)
    return re.sub(r"[\r\n]|^\s|\s$", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url)


def unescaped(uri: str) -> str:
    """The url that the writer was given."""
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), uri)


def record(page_id: int | None, url: str | None, html: bytes | None) -> bytes:
    block = html or b""
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((page_id, url)).encode() + block).digest()[:16])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if html is None:
        head.append("X-Content: null")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(rows: list[bytes], size: int = DICT_SIZE, level: int = LEVEL) -> bytes:
    """An archive of the records, with a dictionary trained on some of them
    where there are enough."""
    import zstandard

    out, how = [], {}
    some = rows[:: max(1, len(rows) // SAMPLES)]
    if len(some) >= 16:
        try:
            d = zstandard.train_dictionary(size, [x[:8192] for x in some], k=512, d=8)
            packed = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
            out.append(struct.pack("<II", DICTIONARY, len(packed)) + packed)
            how = {"dict_data": d}
        except zstandard.ZstdError:  # too little to learn from: an archive without a dictionary is valid
            pass
    c = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **how)
    return b"".join(out + [c.compress(x) for x in rows])


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done = 0

        def flush():
            nonlocal done
            path = f"{folder}/part-{name}-{done}.warc.zst"
            fs, at = pafs.FileSystem.from_uri(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            data = archive(held)
            with fs.open_output_stream(at) as f:
                f.write(data)
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([len(held)], pa.int64())], ["path", "bytes", "records"])

        for b in batches:
            for page_id, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist()):
                held.append(record(page_id, url, html))
                size += len(held[-1])
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write(pages: DataFrame, folder: str, limit: int = ARCHIVE) -> DataFrame:
    """Lazily (path, bytes, records): pages (page_id, url, html) as archives
    of about ``limit`` bytes before compression.  Keep the table: each time it
    is computed new archives are written."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_write(folder, limit), "path string, bytes long, records long")


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, urls, html = [], [], []
        for h, uri, block in zip(b.column("headers").to_pylist(), b.column("uri").to_pylist(), b.column("content").to_pylist()):
            h = dict(h or [])
            ids.append(int(h["x-page-id"]) if "x-page-id" in h else None)
            urls.append(None if uri is None else unescaped(uri))
            html.append(None if h.get("x-content") == "null" or block is None else block.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(html, pa.string()), b.column("content_length"), b.column("valid")], ["page_id", "url", "html", "content_length", "valid"])


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, url, html, content_length, valid) of records by the writer."""
    return found.select("headers", "uri", "content", "content_length", "valid").mapInArrow(_page, "page_id long, url string, html string, content_length long, valid boolean")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of an archive of ``pages``, written and read again."""
    s = Scratch(spark)
    listed = s.keep(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), s.path("archives")), "listed")
    # tasks of few archives each; their number follows that of the archives
    n = max(1, listed.count())
    return pages_of(read(listed.repartition(n, "path")))


QUERIES = {"op1_warc": op1_warc}
ORACLE = {"op1_warc": "SELECT page_id, url, html, CAST(coalesce(strlen(html), 0) AS BIGINT) AS content_length, true AS valid FROM pages"}
