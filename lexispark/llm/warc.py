"""WARC archives: a writer with payload revisits, and a salvage reader.

Archives are gzip files of one member per record (or plain files). The reader
checks each member's CRC and each record's structure and digests; after a
failed check it searches for the next valid member or version line, goes on
there, and reports the bytes in between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Payload bytes after which a writer task starts its next archive. It bounds what a reading task holds.
ARCHIVE_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after the HTTP headers, if it has such."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)

    def lost(self, start: int, end: int, reason: str) -> None:
        if end > start:
            self.gaps.append(Gap(start, end, reason))


def _long(value: str) -> int | None:
    """A 64-bit number, or None."""
    if not re.fullmatch(r"-?0*[0-9]{1,19}", value):
        return None
    sign, digits = (-1, value[1:]) if value.startswith("-") else (1, value)
    number = sign * int(digits.lstrip("0") or "0")
    return number if -1 << 63 <= number < 1 << 63 else None


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {_clean(v)}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at ``at`` and where it ends, or why there is none."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    headers: dict[str, str] = {}
    pos = version.end()
    # line by line, so that a try ends at the first line that is no header, however long the headers are
    while (end := data.find(b"\r\n", pos)) != pos:
        if end < 0:
            return "headers do not end"
        name, colon, value = data[pos:end].decode("utf-8", "replace").partition(":")
        if not colon:
            return "malformed header"
        headers.setdefault(name.strip().lower(), value.strip())
        pos = end + 2
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return "no content length"
    start, stop = end + 2, end + 2 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "block is cut or its length is wrong"
    record = Record(at, headers, data[start:stop])
    for name, value in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload)):
        claim = headers.get(name, "")
        if claim.startswith("sha1:") and (name[5] == "b" or headers.get("warc-type") != "revisit") and claim[5:] != digest(value):
            return f"{name[5:]} does not match"
    return record, stop + 4


def _plain(data: bytes, base: int, out: Salvage) -> None:
    """Records of uncompressed bytes, with failures skipped to the next version line that parses."""
    at = 0
    while at < len(data):
        got = _parse(data, at)
        if not isinstance(got, str):
            got[0].offset = base + at
            out.records.append(got[0])
            at = got[1]
            continue
        nxt = next((m.start() for m in _VERSION.finditer(data, at + 1) if not isinstance(_parse(data, m.start()), str)),
                   len(data))
        out.lost(base + at, base + nxt, got)
        at = nxt


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member at ``at``, its CRC checked, and where it ends; or why there is none."""
    if data[at:at + 3] != _MAGIC:
        return "no gzip member"
    inflate, body, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and pos < len(data):
            body.append(inflate.decompress(data[pos:pos + 65536]))
            pos += 65536
    except zlib.error as e:
        return f"damaged member: {e}"
    if not inflate.eof:
        return "member is cut"
    return b"".join(body), min(pos, len(data)) - len(inflate.unused_data)


def _at(data: bytes, at: int) -> tuple[Salvage, int] | str:
    """What a member or plain record at ``at`` holds and where it ends, or why there is neither."""
    found = Salvage()
    if data[at:at + 3] == _MAGIC:
        member = _member(data, at)
        if isinstance(member, str):
            return member
        body, end = member
        inner = Salvage()
        _plain(body, 0, inner)
        for r in inner.records:  # the offset of a record in a file is its member's
            r.offset = at
        found.records = inner.records
        if inner.gaps or not body:
            found.lost(at, end, inner.gaps[0].reason if inner.gaps else "empty member")
        return found, end
    record = _parse(data, at)
    if isinstance(record, str):
        return "neither a gzip member nor a version line" if record == "no version line" else record
    found.records.append(record[0])
    return found, record[1]


def salvage(data: bytes) -> Salvage:
    """All records that can be read from an archive's bytes, and the gaps, both by offset.

    Members and plain records may follow each other in any order. After a
    failed check the search goes on at the nearest member that holds a valid
    record or version line that begins one, whatever came before.
    """
    out, at = Salvage(), 0
    while at < len(data):
        got, start = _at(data, at), at
        if isinstance(got, str):
            reason, got = got, (Salvage(), len(data))
            for m in _START.finditer(data, at + 1):
                tried = _at(data, m.start())
                if not isinstance(tried, str) and tried[0].records:
                    start, got = m.start(), tried
                    break
            else:
                start = len(data)
            out.lost(at, start, reason)
        out.records += got[0].records
        out.gaps += got[0].gaps
        at = got[1]
    return out


# ---- writing and reading with Spark

def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id of the same payload, null for the one that stays."""
    size = F.octet_length(text_of(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.sha2(text_of(html_col), 256).alias("key"),
                        size.alias("size"))
    first = rows.where(F.col("size") >= least).groupBy("key").agg(F.min("page_id").alias("first"))
    # the groups carry no payloads; pages meet them by key, and adaptive skew handling splits a hot one
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _page_record(page_id, url, html, refers_to) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_urn(page_id)),
               ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url or "about:blank"),
               ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload if refers_to is None else head
    if refers_to is not None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", "sha1:" + digest(block))]
    return record_bytes(headers, block)


def write_archives(rows: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives into ``folder``, a URI that executors share; path, bytes and records of each.

    A task writes under a name of its own attempt, and only the archives that
    the returned manifest lists count, so a task that is run again after a
    lost executor adds no record twice.
    """
    end = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        prefix = folder.removesuffix("/")[:-len(root)] if folder.removesuffix("/").endswith(root) else ""
        store.create_dir(root, recursive=True)
        out, path, raw, size, count = None, "", 0, 0, 0
        made: list[tuple[str, int, int]] = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = _page_record(*row)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}{end}"
                    out, raw, size, count = store.open_output_stream(path, compression=None), 0, 0, 0
                if compress:
                    raw += len(data)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                else:
                    raw += len(data)
                out.write(data)
                size, count = size + len(data), count + 1
                if raw >= ARCHIVE_BYTES:
                    out.close()
                    made.append((prefix + path, size, count))
                    out = None
        if out is not None:
            out.close()
            made.append((prefix + path, size, count))
        cols = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                         ["path", "bytes", "records"])

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc")


_RECORD = ("offset long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, "
           "page_id long, refers_to long, payload binary, gap_end long, reason string")


def read_archives(files: DataFrame, payloads: bool = True, whole_only: bool = False) -> DataFrame:
    """(path[, content]) -> path and one row per record or gap.

    With ``content``, as Spark's binaryFile reader gives it, any store that
    Spark reads will do; with ``path`` alone the task opens the file itself. A
    gap's row has offset, gap_end and reason; its other columns are null. With
    ``whole_only`` a gap fails the job instead. A
    null or empty content gives no rows. A payload's length is that of the
    whole payload, also for a revisit, which carries none. One archive at a
    time is in a task's memory.
    """
    schema = "path string, " + _RECORD
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]
    given = "content" in files.columns

    def rows(path: str, data: bytes) -> Iterator[dict]:
        got = salvage(data)
        if whole_only and got.gaps:
            raise ValueError(f"{path}: {got.gaps[0].reason}, bytes {got.gaps[0].start} to {got.gaps[0].end}")
        for r in got.records:
            h = r.headers
            whole = h.get("warc-type") != "revisit"
            number = {k: _long(h.get(k, "")) for k in ("x-page-id", "x-refers-to-page", "x-payload-length")}
            payload = r.payload
            yield {"path": path, "offset": r.offset, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"),
                   "target_uri": h.get("warc-target-uri"),
                   "payload_digest": digest(payload) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:"),
                   "payload_bytes": len(payload) if whole else number["x-payload-length"], "page_id": number["x-page-id"],
                   "refers_to": number["x-refers-to-page"], "payload": payload if whole and payloads else None}
        for g in got.gaps:
            yield {"path": path, "offset": g.start, "gap_end": g.end, "reason": g.reason}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                if given:
                    data = b.column("content")[i].as_py() or b""
                else:
                    store, at = pafs.FileSystem.from_uri(path)
                    with store.open_input_file(at) as f:
                        data = f.read()
                out = list(rows(path, data))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)],
                                                 names)

    return files.select("path", *["content"] * given).mapInArrow(run, schema)


def page_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 0, payloads: bool = True) -> DataFrame:
    """Write a record per page into ``folder`` and read the archives back; the rows of ``read_archives``.

    No page is left out: an archive that cannot be read back whole fails the job.
    Of pages with equal payloads of at least ``least`` bytes the smallest id
    is the response, the others revisit it. A null html is an empty payload;
    a page with a null id revisits, unless its whole group has none. Rows that
    repeat an id are one page and share its record type. An empty table gives
    an empty result. Other columns are not read.
    """
    manifest = write_archives(with_revisits(pages, id_col, url_col, html_col, least), folder)
    total = manifest.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    parts = max(1, min(total[1], -(-(total[0] or 0) // (ARCHIVE_BYTES // 8))))
    return read_archives(manifest.select("path").repartition(parts), payloads, whole_only=True)
