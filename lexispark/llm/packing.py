"""Best-fit packing by a linear grouping scheme.

Spark tokenises, cuts, counts and places; the driver sees only histograms of
at most ``capacity`` rows, whatever the corpus size:

1. lengths above ``small`` are split into groups of equal cardinality and
   rounded up to their group's largest length;
2. column generation finds a fractional optimum over configurations of these
   few sizes (knapsack pricing); it is rounded down and the rest packed
   first-fit;
3. actual pieces replace the rounded ones, rank by rank;
4. small pieces go best-fit, longest first, into what the actual lengths left.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, map_texts, stored

CAPACITY = 2048
#: Pieces up to this length are the scheme's small ones.
SMALL = 256
#: Groups of equal cardinality, hence distinct rounded sizes.
GROUPS = 96
#: Distinct chunks and words whose ids a worker keeps before it starts over.
_CACHE = 800_000

_VISIBLE = re.compile("[\x21-\x7e\xa1-\xac\xae-įı-ɏ]+")


class Encoder:
    """Ids of a whole text, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its white-space separated chunks in order. Chunks are
    remembered. Chunks of plain Latin letters and marks skip the tokenizer's
    normaliser and pre-tokenizer; all others go through it whole.
    """

    def __init__(self, path: str, cache: int = _CACHE):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = self.whole.model
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        words = regex.compile(split)
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        letters = {b: b if b in shown else next(others) for b in range(256)}
        pack = struct.Struct("<I").pack

        class Word(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= cache:
                    self.clear()
                text = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                value = self[word] = b"".join([pack(t.id) for t in model.tokenize(text)])
                return value

        known, whole = Word(), self.whole

        class Chunk(dict):
            def __missing__(self, chunk: bytes) -> bytes:
                if len(self) >= cache:
                    self.clear()
                text = chunk.decode("utf-8", "replace")
                if _VISIBLE.fullmatch(text) and "<|" not in text:
                    text = text.lower()
                    value = known[text] if text.isalpha() else b"".join(map(known.__getitem__, words.findall(text)))
                else:
                    value = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                if len(chunk) <= 64:
                    self[chunk] = value
                return value

        self.chunks = Chunk()

    def __call__(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        chunks = raw.split() if b"<|" in raw else raw.lower().split()  # special tokens are matched by case
        return b"".join(map(self.chunks.__getitem__, chunks))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = _CACHE) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids with ``end_id`` after
    them, cut every ``capacity`` ids. Null and empty texts are the one id ``end_id``."""
    end = struct.pack("<I", end_id)
    step = 4 * capacity

    def run(texts: list[str | None]) -> dict:
        encode = encoder(tokenizer)
        out: dict = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
        for i, text in enumerate(texts):
            ids = encode(text or "") + end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at:at + step]
                for name, value in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                    out[name].append(value)
                if keep_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_texts(df, id_col, text_col, run, fields)


# ---- the plan over histograms (driver; bounded by capacity, not by rows)

def group_lengths(hist: dict[int, int], small: int, groups: int) -> list[tuple[int, list[int], int]]:
    """(rounded size, its lengths, pieces) of groups of about equal cardinality; a length is never split."""
    large = sorted((n, c) for n, c in hist.items() if n > small)
    total, out, members, count = sum(c for _, c in large), [], [], 0
    for n, c in large:
        members.append(n)
        count += c
        if count * groups >= total:
            out.append((n, members, count))
            members, count = [], 0
    if members:
        out.append((members[-1], members, count))
    return out


def _best_config(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of the highest price within capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    step = int(sizes.min())  # within this many capacities no value depends on another
    for lo in range(step, capacity + 1, step):
        c = np.arange(lo, min(lo + step, capacity + 1))
        rest = c[None, :] - sizes[:, None]
        value = np.where(rest >= 0, best[np.maximum(rest, 0)] + price[:, None], -1.0)
        k = value.argmax(axis=0)
        top = value[k, np.arange(len(c))]
        best[c], last[c] = np.maximum(top, 0), np.where(top > 1e-12, k, -1)
        carried = np.maximum.accumulate(np.concatenate([best[lo - 1:lo], best[c]]))
        worse = best[c] < carried[1:]
        best[c], last[c] = carried[1:], np.where(worse, -1, last[c])
    made, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            made[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), made


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) covering ``counts`` pieces of each of ``sizes``, by column generation and rounding down.

    The simplex basis has one column per size; it starts with as many of one
    size as fit. It ends when no configuration prices above one, or after
    twenty rounds a size, when the basis at hand is used: any basis packs every piece.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(20 * k):
        inverse = np.linalg.inv(basis)
        value, config = _best_config(sizes, np.ones(k) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        direction, amount = inverse @ config, inverse @ counts
        ratio = np.where(direction > 1e-9, np.maximum(amount, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = config
    amount = np.maximum(np.linalg.solve(basis, counts.astype(float)), 0)
    left, out = counts.astype(np.int64).copy(), []
    for j in np.argsort(-amount):
        config = basis[:, j].round().astype(np.int64)
        times = min([int(amount[j] + 1e-9), *(int(left[i] // config[i]) for i in np.flatnonzero(config))])
        if times > 0:
            out.append((config, times))
            left -= times * config
    while left.any():  # first fit, longest first, the same configuration as often as it goes
        config, room = np.zeros(k, np.int64), capacity
        for i in range(k - 1, -1, -1):
            config[i] = min(left[i], room // sizes[i])
            room -= config[i] * sizes[i]
        times = min(int(left[i] // config[i]) for i in np.flatnonzero(config))
        out.append((config, times))
        left -= times * config
    return out


def plan_large(hist: dict[int, int], capacity: int, small: int, groups: int) -> tuple[pd.DataFrame, int]:
    """Where the r-th piece of each large length goes, as ranges, and the number of sequences.

    Rows: length, lo, hi (ranks), shift (rank of its group's first piece in the
    range's slots), base (first sequence), per (pieces of the group in a sequence), slot.
    """
    made = group_lengths(hist, small, groups)
    rows: list[tuple[int, ...]] = []
    if not made:
        return pd.DataFrame(rows, columns=["length", "lo", "hi", "shift", "base", "per", "slot"]), 0
    sizes, counts = np.array([g[0] for g in made]), np.array([g[2] for g in made])
    bases, seq = [], 0
    for config, times in configurations(sizes, counts, capacity):
        bases.append((seq, config, times))
        seq += times
    for g, (_, lengths, _) in enumerate(made):
        slots, at = [], 0  # slot ranges of the group, in order of its pieces
        for base, config, times in bases:
            if config[g]:
                slots.append((at, at + times * int(config[g]), base, int(config[g])))
                at += times * int(config[g])
        start, s = 0, 0
        for n in lengths:
            end = start + hist[n]
            while s < len(slots) and slots[s][1] <= start:
                s += 1
            t = s
            while t < len(slots) and slots[t][0] < end:
                lo, hi, base, per = slots[t]
                rows.append((n, max(lo, start) - start, min(hi, end) - start, start - lo, base, per, g * capacity))
                t += 1
            start = end
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "shift", "base", "per", "slot"]), seq


def plan_small(hist: dict[int, int], room: dict[int, int], capacity: int, small: int) -> tuple[pd.DataFrame, int]:
    """Best fit, longest first: rank ranges of each small length into rank ranges of the sequences with a given room.

    Rows: length, lo, hi, room (-1: a new sequence), first (rank of its first
    sequence), per (pieces in a sequence), slot. Returns the number of new sequences.
    """
    # by room left: runs of sequences (room at first, first rank, count)
    free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, c)] for r, c in room.items() if r > 0}
    rows, fresh, step = [], 0, 0
    for n in sorted((n for n in hist if n <= small), reverse=True):
        done, need = 0, hist[n]
        for r in sorted(x for x in free if x >= n):
            runs = free.pop(r)
            per = r // n
            while runs and need:
                origin, first, count = runs.pop()
                full = min(count, need // per)
                if full:
                    rows.append((n, done, done + full * per, origin, first, per, step))
                    free.setdefault(r - per * n, []).append((origin, first, full))
                    done, need, first, count = done + full * per, need - full * per, first + full, count - full
                if count and need and need < per:
                    rows.append((n, done, done + need, origin, first, need, step))
                    free.setdefault(r - need * n, []).append((origin, first, 1))
                    done, need, first, count = done + need, 0, first + 1, count - 1
                if count:
                    runs.append((origin, first, count))
            if runs:
                free.setdefault(r, []).extend(runs)
            if not need:
                break
        if need:
            per = capacity // n
            full, rest = divmod(need, per)
            for count, each in ((full, per), (1, rest)):
                if count and each:
                    rows.append((n, done, done + count * each, -1, fresh, each, step))
                    free.setdefault(capacity - each * n, []).append((-1, fresh, count))
                    done, fresh = done + count * each, fresh + count
        step += 1
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "room", "first", "per", "slot"]), fresh


# ---- placing, distributed

def ranked(df: DataFrame, key: str, by: list[str], buckets: int) -> DataFrame:
    """A dense rank from 0 within each ``key``, with a hot key split over ``buckets`` hash buckets."""
    df = df.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    sizes = df.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(key, "__b", (F.sum("__n").over(Window.partitionBy(key).orderBy("__b")) - F.col("__n")).alias("__o"))
    inner = Window.partitionBy(key, "__b").orderBy(*by)
    return (df.withColumn("__r", F.row_number().over(inner) - 1).join(before, [key, "__b"])
            .withColumn("rank", F.col("__r") + F.col("__o")).drop("__b", "__r", "__o"))


def _placed(df: DataFrame, ranges: pd.DataFrame, names: list[str]) -> DataFrame:
    """Each (length, rank) with the columns of its range; the ranges are bounded by the plan, not by rows."""
    ranges = ranges.sort_values(["length", "lo"])
    wide = np.int64(1) << 48
    starts = ranges["length"].to_numpy(np.int64) * wide + ranges["lo"].to_numpy(np.int64)
    cols = {n: ranges[n].to_numpy(np.int64) for n in ["lo", *names]}

    def run(b: pa.RecordBatch) -> dict:
        key = b.column("length").to_numpy(zero_copy_only=False) * wide + b.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(starts, key, "right") - 1
        return {n: c[at] for n, c in cols.items()}

    return map_columns(df, df.columns, run, ", ".join(f"{n} long" for n in cols))


def _histogram(df: DataFrame, col: str) -> dict[int, int]:
    """At most ``capacity`` rows come to the driver."""
    return {int(r[0]): int(r[1]) for r in df.groupBy(col).count().collect()}


def pack(pieces: DataFrame, by: list[str], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """The rows of ``pieces`` (a length from 1 to capacity each) with sequence_id and offset.

    ``by`` orders pieces of one length; rows that agree in all of ``by`` are
    interchangeable. Each sequence is gapless from 0 and holds at most
    ``capacity``. An empty table gives an empty result.
    """
    hist = _histogram(pieces, "length")
    if not hist:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = max(16, sum(hist.values()) // 200_000)
    rows = stored(ranked(pieces, "length", by, buckets), "pack")
    ranges, used = plan_large(hist, capacity, small, groups)
    at = F.col("rank") + F.col("shift")
    large = _placed(rows.where(F.col("length") > small), ranges, ["shift", "base", "per", "slot"]).select(
        *rows.columns, (F.col("base") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot") + at % F.col("per")).alias("__slot"))
    large = stored(large, "pack")
    bins = (large.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room")).where("room > 0"))
    room = _histogram(bins, "room")
    ranges, _ = plan_small(hist, room, capacity, small)
    lo_slot = 1 << 40
    little = _placed(rows.where(F.col("length") <= small), ranges, ["room", "first", "per", "slot"])
    turn = F.col("rank") - F.col("lo")
    little = little.withColumns({"__bin": F.col("first") + F.floor(turn / F.col("per")).cast("long"),
                                 "__slot": lo_slot + F.col("slot") * capacity + turn % F.col("per")})
    open_bins = ranked(bins, "room", ["sequence_id"], buckets).select(
        F.col("room"), F.col("rank").alias("__bin"), F.col("sequence_id").alias("__seq"))
    little = little.join(open_bins, ["room", "__bin"], "left").select(
        *rows.columns, F.when(F.col("room") < 0, F.col("__bin") + used).otherwise(F.col("__seq")).alias("sequence_id"),
        "__slot")
    order = Window.partitionBy("sequence_id").orderBy("__slot")
    return (large.unionByName(little)
            .withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long"))
            .drop("rank", "__slot"))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): all documents, cut and packed.

    Null texts are empty; an empty text is one end id. Very long texts are cut,
    nothing is dropped. Repeated rows are packed each. Other columns of ``df``
    are not read, so their names cannot clash.
    """
    pieces = stored(token_pieces(df, tokenizer, id_col, text_col, capacity, keep_ids=keep_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
