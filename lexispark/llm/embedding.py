"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction on the sphere; a vector passes those whose inner
product with it is at least ``t``. The directions are a product code: after a
fixed random rotation the space is cut in two halves, each half has K random
unit vectors, and each pair of them is one of K*K directions. A vector finds
all its filters by list decoding: of both halves' K products only those that can reach
``t`` with the other half's best are looked at. Vectors join on (label, filter);
bucket mates are verified in double precision. (Becker, Ducas, Gama,
Laarhoven, "New directions in nearest neighbor searching", 2016.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, matrix, sorted_groups, stored
from .graph import connected_components

_SEED = 11
#: Filters that a vector passes on average, in how many codes, and bucket mates that mere chance gives it in each.
FILTERS, TABLES, CHANCE = 64, 16, 0.1
#: Vectors in a block of a large bucket.
BLOCK = 512


def cap_height(share: float, dim: int) -> float:
    """The t for which a cap {x: <x, f> >= t} holds ``share`` of the unit sphere."""
    u = np.linspace(0, 1, 200_001)
    density = np.maximum(1 - u * u, 0) ** ((dim - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1] / (2 * density.sum())
    return float(u[min(int(np.searchsorted(-tail, -share)), len(u) - 1)])


class Filters:
    """The product codes of one dimension, the same wherever they are built.

    How many filters of one code a vector passes varies much from place to
    place on the sphere, and near vectors share that luck. So the filters come
    from ``TABLES`` independent codes, each under its own rotation.
    """

    def __init__(self, dim: int, per_half: int):
        rng = np.random.default_rng(_SEED)
        self.half, self.k, self.tables = dim // 2, per_half, []
        for _ in range(TABLES):
            rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            codes = []
            for width in (self.half, dim - self.half):
                c = rng.normal(size=(per_half, width))
                codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2))
            self.tables.append((rotation[:, :self.half] @ codes[0].T, rotation[:, self.half:] @ codes[1].T))
        self.t = cap_height(min(0.4, FILTERS / TABLES / per_half**2), dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all its filters."""
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for n, (one, two) in enumerate(self.tables):
            for found, a, b in zip(out, unit @ one, unit @ two, strict=True):
                i = np.flatnonzero(a >= self.t - b.max())
                j = np.flatnonzero(b >= self.t - a.max())
                hit = np.argwhere(a[i][:, None] + b[j][None, :] >= self.t)
                found.append(np.sort(n * np.int64(self.k) ** 2 + i[hit[:, 0]] * np.int64(self.k) + j[hit[:, 1]]))
        return [np.concatenate(f) for f in out]


_CODES: dict[tuple[int, int], Filters] = {}


def _filters(dim: int, per_half: int) -> Filters:
    if (dim, per_half) not in _CODES:
        _CODES[dim, per_half] = Filters(dim, per_half)
    return _CODES[dim, per_half]


def _units(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vec: str) -> Column:
    """Neither null, empty nor zero, and all components present and finite."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda v: v != 0)


class _Found:
    """Links of the groups of one task: per vector their number, and edges that connect what is linked."""

    def __init__(self, least: float):
        self.least, self.a, self.b, self.n = least, [], [], []

    def links(self, a: int, n: int) -> None:
        self.a.append(a)
        self.b.append(None)
        self.n.append(n)

    def edge(self, a: int, b: int) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n.append(None)

    def group(self, key: int, ids: np.ndarray, copies: np.ndarray, block: np.ndarray, across: bool,
              keys: list[np.ndarray], x: np.ndarray) -> None:
        """All pairs of one block (or across two) that this filter is the first to bring together."""
        near = np.triu(x @ x.T >= self.least, 1)
        if across:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return
        live = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
        near = near[np.ix_(live, live)]
        before = [keys[i][keys[i] < key] for i in live]
        known, place = np.unique(np.concatenate(before), return_inverse=True)
        if len(known):
            member = np.zeros((len(live), len(known)), np.float32)
            member[np.repeat(np.arange(len(live)), [len(x) for x in before]), place] = 1
            fresh = near & (member @ member.T == 0)
        else:
            fresh = near
        w = copies[live]
        count = fresh @ w + fresh.T @ w
        for i in np.flatnonzero(count):
            self.links(ids[live[i]], int(count[i]))
        root = np.arange(len(live))  # smallest place reachable in this group, and a forest of edges to it
        for i, j in np.argwhere(fresh):
            p, q = i, j
            while root[p] != p:
                root[p] = p = root[root[p]]
            while root[q] != q:
                root[q] = q = root[root[q]]
            if p != q:
                root[max(p, q)] = min(p, q)
                self.edge(ids[live[i]], ids[live[j]])

    def batch(self, size: int = 0) -> pa.RecordBatch | None:
        if len(self.a) <= size:
            return None
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.a, self.b, self.n)], ["a", "b", "n"])
        self.a, self.b, self.n = [], [], []
        return out


def _verify(least: float):
    """Rows sorted by (label, dim, key, t1, t2): one bucket or pair of blocks after the other."""
    heads = ["label", "dim", "key", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(least)
        for t, bounds in sorted_groups(batches, heads):
            key, t1, t2, ids, block, copies = (t[c].to_numpy() for c in ("key", "t1", "t2", "rep", "block", "copies"))
            vec, lists = t["vec"].combine_chunks(), t["keys"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in bounds:
                if hi - lo > 1:
                    found.group(key[lo], ids[lo:hi], copies[lo:hi], block[lo:hi], t1[lo] != t2[lo],
                                [flat[at[i]:at[i + 1]] for i in range(lo, hi)], _units(matrix(vec[lo:hi])))
            if (out := found.batch(5000)) is not None:
                yield out
        if (out := found.batch()) is not None:
            yield out

    return run


def vector_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 min_cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least ``min_cosine``. Null, zero and empty vectors
    and vectors with null or non-finite components link with nothing, and
    vectors link with those of their own dimension only. Equal vectors of one label stand for each
    other: one of them is compared, and its copies count as links. Rows with a
    null id keep a null component and no links. An empty table gives an empty
    result. A pair is found when some filter holds both; tests measure
    this against brute force.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = rows.where(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.withColumn("vec", F.transform("vec", lambda v: v.cast("double") + 0.0)).withColumn("h", F.xxhash64("vec"))
    reps = stored(good.groupBy("label", "h", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("dim", F.size("vec")), "caps")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    per_half = max(16, math.ceil(math.sqrt(FILTERS / TABLES * most / CHANCE)))

    def decode(b: pa.RecordBatch) -> dict:
        dims = b.column("dim").to_numpy()
        vecs, keys = b.column("vec").to_pylist(), [None] * b.num_rows
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = np.pad(_units([vecs[i] for i in at]), ((0, 0), (0, max(0, 4 - int(d)))))
            for i, k in zip(at, _filters(x.shape[1], per_half).decode(x), strict=True):
                keys[i] = k
        return {"keys": keys}

    listed = stored(map_columns(reps, ["rep", "label", "dim", "copies", "vec"], decode, "keys array<long>"), "caps")
    slim = listed.select("label", "dim", "rep", F.explode("keys").alias("key"))
    shared = (slim.groupBy("label", "dim", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = (slim.join(shared, ["label", "dim", "key"]).withColumn("block", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("label", "dim", "key", "rep", "block", F.least("block", "other").alias("t1"),
                      F.greatest("block", "other").alias("t2"))
              .join(listed.select("label", "rep", "copies", "vec", "keys"), ["label", "rep"]))
    heads = ["label", "dim", "key", "t1", "t2"]
    kind = dict(df.dtypes)[id_col]
    found = stored(placed.select(*heads, "rep", "block", "copies", "vec", "keys").repartition(*heads)
                   .sortWithinPartitions(*heads).mapInArrow(_verify(min_cosine), "a long, b long, n long"), "caps")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = (reps.select("label", "h", "vec", "rep", "copies").join(counts, "rep", "left")
             .join(comps, F.col("rep") == F.col("node"), "left")
             .select("label", "h", "vec", "copies", "links", F.coalesce("component", "rep").alias("component")))
    linked = good.join(named, ["label", "h", "vec"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("component").cast(kind).alias("component_id"))
    rest = rows.where(~(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
