"""Token ids in files of directly addressable codes (Brisaboa, Ladra, Navarro: "DACs", 2013).

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of
every id; a bitmap says which ids go on, and the next level holds the next
chunk of these only. How many ids before a place go on (the rank) is the place
in the next level; a directory holds that count for every 512 bits. So the id
at any place is found from a byte and a 64-byte bitmap block a level, and
nothing around it is decoded.

A file is a row of segments of ``SEGMENT`` ids, each a code of its own, so
that a writer holds one segment at a time and the segment of a place follows
from a division. Its footer lists the segments and the documents:

    "DACTOK01" | segments | documents: ids, validity, starts | segments: offset, crc32 | counts | "DACTOK01"

Documents lie in ascending id order, over all files of a manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .packing import encoder

#: Ids of a segment.
SEGMENT = 1 << 20
#: A file ends with the document that reaches either bound.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20
#: Most tasks that read files; beyond it a task reads several.
READ_TASKS = 100_000
#: Writing tasks whose files lie together in the manifest.
LISTED = 64
#: Bits that one entry of a rank directory covers.
BLOCK = 512
#: Words and chunks that a writer remembers, beside a segment and the sorted texts' share of memory.
CACHE = 500_000
_MAGIC, _TAIL = b"DACTOK01", struct.Struct("<QQQQ8s")
_LEVELS = 4


# ---- one segment

def encode_segment(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as levels: the counts of all four, then chunks, bitmap and directory of each."""
    counts, parts, rest = [], [], ids.astype("<u4")
    for _ in range(_LEVELS):
        counts.append(len(rest))
        more = rest > 255
        bits = np.zeros(-(-len(rest) // BLOCK) * (BLOCK // 8), np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[:len(packed)] = packed
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        parts += [rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[more] >> 8
    return struct.pack(f"<{_LEVELS}I", *counts) + b"".join(parts)


def _layout(head: bytes) -> list[tuple[int, int, int, int]]:
    """(count, place of the chunks, of the bitmap, of the directory) of each level, from a segment's start."""
    at, out = 4 * _LEVELS, []
    for n in struct.unpack(f"<{_LEVELS}I", head):
        blocks = -(-n // BLOCK)
        out.append((n, at, at + n, at + n + blocks * (BLOCK // 8)))
        at += n + blocks * (BLOCK // 8 + 4)
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """All ids of a segment."""
    out, here = None, None
    for level, (n, chunks, bits, _) in enumerate(_layout(data[:4 * _LEVELS])):
        part = np.frombuffer(data, np.uint8, n, chunks).astype(np.uint32)
        if out is None:
            out, here = part, np.arange(n)
        else:
            out[here] |= part << np.uint32(8 * level)
        more = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), bits), count=n, bitorder="little").astype(bool)
        here = here[more]
    return out


def access(read: Callable[[int, int], bytes], start: int, head: bytes, place: int) -> int:
    """The id at ``place`` of the segment at ``start``; ``read(at, size)`` gives bytes of the file."""
    value = 0
    for level, (_, chunks, bits, ranks) in enumerate(_layout(head)):
        value |= read(start + chunks + place, 1)[0] << (8 * level)
        block, bit = divmod(place, BLOCK)
        window = int.from_bytes(read(start + bits + block * (BLOCK // 8), BLOCK // 8), "little")
        if not window >> bit & 1:
            break
        below = int.from_bytes(read(start + ranks + 4 * block, 4), "little")
        place = below + (window & ((1 << bit) - 1)).bit_count()
    return value


# ---- one file

class Writer:
    """Streams documents into one file."""

    def __init__(self, out):
        self.out, self.at = out, len(_MAGIC)
        self.held: list[bytes] = []
        self.waiting = self.ids = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.segments: list[tuple[int, int]] = []
        out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit bytes."""
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= SEGMENT:
            self._segments(last=False)

    def _segments(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // SEGMENT * SEGMENT
        for at in range(0, whole, SEGMENT):
            data = encode_segment(ids[at:min(at + SEGMENT, whole)])
            self.segments.append((self.at, zlib.crc32(data)))
            self.out.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._segments(last=True)
        parts = (np.array([d or 0 for d in self.docs], "<i8"), np.array([d is not None for d in self.docs], np.uint8),
                 np.array(self.starts, "<u8"), np.array([s for s, _ in self.segments], "<u8"),
                 np.array([c for _, c in self.segments], "<u4"))
        for p in parts:
            self.out.write(p.tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.docs), len(self.segments), self.ids, _MAGIC))


class Reader:
    """A file: single ids by direct access, whole documents segment by segment."""

    def __init__(self, path: str):
        store, at = pafs.FileSystem.from_uri(path)
        self.path, self.file = path, store.open_input_file(at)
        size = self.file.size()
        tail = self.read(size - _TAIL.size, _TAIL.size) if size >= _TAIL.size + len(_MAGIC) else b""
        if not tail.endswith(_MAGIC):
            raise ValueError(f"{path}: no file of token codes")
        self.end, self.n_docs, n_segments, self.n_ids, _ = _TAIL.unpack(tail)
        rest, n = self.read(self.end, size - _TAIL.size - self.end), self.n_docs
        self.doc_ids = np.frombuffer(rest, "<i8", n)
        self.valid = np.frombuffer(rest, np.uint8, n, 8 * n).astype(bool)
        self.starts = np.frombuffer(rest, "<u8", n, 9 * n).astype(np.int64)
        self.segments = np.frombuffer(rest, "<u8", n_segments, 17 * n).astype(np.int64)
        self.crcs = np.frombuffer(rest, "<u4", n_segments, 17 * n + 8 * n_segments)
        self.heads: dict[int, bytes] = {}

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()

    def token(self, place: int) -> int:
        """The id at a place of the file."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        k, inside = divmod(place, SEGMENT)
        start = int(self.segments[k])
        if k not in self.heads:
            self.heads[k] = self.read(start, 4 * _LEVELS)
        return access(self.read, start, self.heads[k], inside)

    def segment(self, k: int) -> np.ndarray:
        """All ids of a segment, its checksum compared."""
        start = int(self.segments[k])
        end = int(self.segments[k + 1]) if k + 1 < len(self.segments) else self.end
        data = self.read(start, end - start)
        if zlib.crc32(data) != self.crcs[k]:
            raise ValueError(f"{self.path}: segment {k} is damaged")
        return decode_segment(data)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, start, its ids in parts), in order; each document's parts must be taken before the next one."""
        ends = np.append(self.starts[1:], self.n_ids)
        now, ids = -1, np.empty(0, np.uint32)

        def parts(at: int, end: int) -> Iterator[np.ndarray]:
            nonlocal now, ids
            while at < end:
                k, inside = divmod(at, SEGMENT)
                if k != now:
                    now, ids = k, self.segment(k)
                part = ids[inside:inside + end - at]
                yield part
                at += len(part)

        for i in range(self.n_docs):
            yield int(self.doc_ids[i]) if self.valid[i] else None, int(self.starts[i]), parts(int(self.starts[i]), int(ends[i]))


# ---- tables

def write_token_files(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 1) -> DataFrame:
    """Encode ``df``'s texts and write them, ``end_id`` after each, into ``folder``, a URI that executors share.

    Returns the manifest, a row per file: path, start (ids of all files
    before), n_ids, n_docs. Rows are dealt by ranges of (id, text hash, row),
    so rows that repeat an id a million times still spread over tasks. A task
    holds one segment. It writes under names of its own, and
    only files that the manifest lists count, so that a task run again after a
    lost executor adds nothing twice. Null and empty texts are ``end_id``
    alone; rows with a null id come first; each of repeated rows is written.
    Other columns are not read. An empty table gives an empty manifest.
    """
    end = struct.pack("<I", end_id)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ("doc_id", "tie", "row")
    dealt = (rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, CACHE)
        store, root = pafs.FileSystem.from_uri(folder)
        prefix = folder.removesuffix("/")[:-len(root)] if folder.removesuffix("/").endswith(root) else ""
        store.create_dir(root, recursive=True)
        part, now, path = TaskContext.get().partitionId(), None, ""
        made: list[tuple] = []

        def finish() -> None:
            now.close()
            now.out.close()
            made.append((part, len(made), prefix + path, now.ids, len(now.docs)))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if now is None:
                    path = f"{root}/{uuid.uuid4().hex}.dac"
                    now = Writer(store.open_output_stream(path, compression=None))
                now.add(doc_id, encode(text or "") + end)
                if now.ids >= FILE_IDS or len(now.docs) >= FILE_DOCS:
                    finish()
                    now = None
        if now is not None:
            finish()
        names = ["part", "seq", "path", "n_ids", "n_docs"]
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        cols = list(zip(*made, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    written = dealt.mapInArrow(run, "part int, seq int, path string, n_ids long, n_docs long")
    # few Parquet files: each costs processes (Hadoop's chmod); dealt by part, as a part's rows must be of one attempt
    files = stored(written.repartition(F.floor(F.col("part") / LISTED)), "tokens")
    # one row per file: the running sum moves the manifest, never ids
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("start"), "n_ids", "n_docs")


def read_token_files(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with ``ids``, ids (array<long>) from the files.

    The checksum is the unsigned crc32 of the ids as little-endian unsigned
    32-bit integers. Without ``ids`` a task holds one segment of a file. Files
    are dealt evenly, to a task for each ``SEGMENT`` ids or, if these are fewer, each file.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids

    def rows(path: str, first: int) -> Iterator[tuple]:
        file = Reader(path)
        for doc_id, start, parts in file.documents():
            crc, n, kept = 0, 0, []
            for part in parts:
                crc, n = zlib.crc32(part.astype("<u4").tobytes(), crc), n + len(part)
                if ids:
                    kept.append(part.astype(np.int64))
            yield (doc_id, first + start, n, crc, *([np.concatenate(kept)] if ids else []))
        file.close()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                out: list[tuple] = []
                for row in rows(path, first):
                    out.append(row)
                    if len(out) >= (64 if ids else 8192):
                        yield batch(out)
                        out = []
                yield batch(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    files, n_ids = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    # a number keeps small rows from meeting in one task
    tasks = max(1, min(files, -(-n_ids // SEGMENT), READ_TASKS))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, schema)


def tokens_at(manifest: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """place, token: the id at each place of the whole corpus, by direct access; places outside it and nulls give no row.

    Places meet their file by an equality join on stretches of ``SEGMENT``
    places, and go to tasks by file and stretch, so a much asked file spreads.
    Repeated places are looked up once each.
    """
    spans = manifest.where("n_ids > 0").withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n_ids") - 1) / SEGMENT))))
    asked = (places.select(F.col(place_col).cast("long").alias("place")).where("place >= 0")
             .withColumn("stretch", F.floor(F.col("place") / SEGMENT)))
    met = (asked.join(spans, "stretch").where("place >= start AND place < start + n_ids")
           .select("path", "stretch", "place", (F.col("place") - F.col("start")).alias("inside")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: Reader | None = None
        for b in batches:
            out = []
            for path, inside in zip(b.column("path").to_pylist(), b.column("inside").to_pylist(), strict=True):
                if file is None or file.path != path:
                    if file is not None:
                        file.close()
                    file = Reader(path)
                out.append(file.token(inside))
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(out, pa.int64())], ["place", "token"])

    return met.repartition("path", "stretch").sortWithinPartitions("path", "place").mapInArrow(run, "place long, token long")
