"""Near-duplicate documents: universal hash minima, banding, signature check, full-set check, components.

1. Every whole text becomes its set of word n-gram hashes (64 bit), a signature
   of ``rows * bands`` minima under universal hashes ``a*x + b``, and one
   64-bit key per band. Only these leave the Python workers.
2. Documents with one word sequence have one set; their smallest id stands
   for all of them from here on.
3. Star round: each document is compared with the smallest id of its buckets.
   Buckets with many documents outside their largest component get further
   rounds from the smallest of these, as long as that shrinks them.
4. Buckets that still hold several components are worked on in pairs of blocks, where
   all pairs of different components whose signatures come near the threshold
   are confirmed on the full sets, each pair at its first common band.
5. Large-star / small-star joins the confirmed links. No bucket is ever
   expanded into rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, matrix, parted, sorted_groups, stored, without_ids
from .graph import connected_components

_SEED = 20240229
#: Word hashes that a worker keeps before it starts over.
_CACHE_WORDS = 200_000
#: Documents of a bucket that one block holds.
BLOCK = 256
#: How far below the threshold a signature's estimate may be; over four standard errors at 144 minima.
MARGIN = 0.13


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHash()


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: what bytes.lower() and bytes.split() do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(tokens: list[bytes], ngram: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams; of a shorter text its whole sequence is the one n-gram."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    n = min(ngram, len(tokens))
    odd = np.random.default_rng(_SEED + n).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        acc += h[j:len(h) - n + 1 + j] * odd[j]
    return np.unique(_mixed(acc))


def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, count, dtype=np.uint64))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of a*x + b over the set, for each (a, b)."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(low, (s[at:at + 256, None] * a + b).min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    parts = sig.reshape(-1, rows)
    odd = np.random.default_rng(_SEED + 1).integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed((parts * odd).sum(axis=1, dtype=np.uint64) + np.arange(len(parts), dtype=np.uint64)).view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, ngram: int, rows: int, bands: int) -> DataFrame:
    """doc_id, seq_hash (128 bit of the word sequence), n_shingles, bands, sig (16 bits of each minimum)."""
    a, b = _universal(rows * bands)

    def run(texts: list[str | None]) -> dict:
        out: dict = {"seq_hash": [], "n_shingles": [], "bands": [], "sig": []}
        for text in texts:
            tokens = words(text)
            s = shingles(tokens, ngram)
            sig = signature(s, a, b)
            out["seq_hash"].append(xxhash.xxh3_128_digest(b" ".join(tokens)) if len(s) else None)
            out["n_shingles"].append(len(s))
            out["bands"].append(band_keys(sig, rows) if len(s) else [])
            out["sig"].append(_mixed(sig).astype("<u2").tobytes() if len(s) else None)
        return out

    return map_texts(df, id_col, text_col, run, "seq_hash binary, n_shingles long, bands array<long>, sig binary")


def shingle_sets(df: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, shingles): the full set of each text as sorted 64-bit hashes."""
    return map_texts(df, "doc_id", "text", lambda texts: {"shingles": [shingles(words(t), ngram).view(np.int64) for t in texts]},
                     "shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The (src, dst) of ``pairs`` with 100 * |intersection| >= pct * |union| on the full sets."""
    left = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("s1"))
    right = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2")).cast("long")
    return (pairs.join(left, "src").join(right, "dst")
            .withColumn("both", both)
            .where(100 * F.col("both") >= pct * (F.size("s1") + F.size("s2") - F.col("both")))
            .select("src", "dst"))


#: A group of rows: a bucket and two of its blocks.
_HEADS = ["key", "t1", "t2"]


class _Block:
    """The columns of sorted block rows, and a group's near pairs of different components at their first common band."""

    def __init__(self, t: pa.Table, minima: int, least: int):
        self.key, self.t1, self.t2, self.ids, self.comp, self.own = (t[c].to_numpy() for c in (*_HEADS, "doc_id", "comp", "block"))
        self.bands, self.least = matrix(t["bands"]), least
        self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(self.ids), minima)

    def pairs(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """The place of each document of the second block and those of its partners, all in the first block."""
        s = slice(lo, hi)
        first, across = self.own[s] == self.t1[lo], self.t1[lo] != self.t2[lo]
        for i in (lo + np.flatnonzero(self.own[s] == self.t2[lo])).tolist():
            fit = first & (self.comp[s] != self.comp[i])
            if not across:
                fit &= self.ids[s] > self.ids[i]
            j = lo + np.flatnonzero(fit)
            j = j[(self.sig[j] == self.sig[i]).sum(axis=1) >= self.least]
            if len(j):
                j = j[self.bands[i][(self.bands[j] == self.bands[i]).argmax(axis=1)] == self.key[i]]
            if len(j):
                yield i, j


def _involved(minima: int, least: int):
    """Of each group the rows that some near pair needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in sorted_groups(batches, _HEADS):
            block, used = _Block(t, minima, least), np.zeros(t.num_rows, bool)
            for lo, hi in bounds:
                for i, j in block.pairs(lo, hi):
                    used[i] = used[j] = True
            yield from t.filter(pa.array(used)).to_batches()

    return run


def _links(minima: int, least: int, pct: int):
    """The near pairs of each group that full sets confirm; of those that join what is joined already, none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in sorted_groups(batches, _HEADS):
            block = _Block(t, minima, least)
            lists = t["shingles"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            size = np.diff(at)
            src, dst = [], []
            for lo, hi in bounds:
                root = {c: c for c in block.comp[lo:hi].tolist()}

                def find(c: int, root: dict = root) -> int:
                    while root[c] != c:
                        c = root[c]
                    return c

                for i, j in block.pairs(lo, hi):
                    own = flat[at[i]:at[i + 1]]
                    both = np.array([_common(own, flat[at[k]:at[k + 1]]) for k in j.tolist()])
                    for k in j[100 * both >= pct * (size[i] + size[j] - both)].tolist():
                        p, q = find(int(block.comp[i])), find(int(block.comp[k]))
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            src.append(block.ids[i])
                            dst.append(block.ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, t.schema.field("doc_id").type) for x in (src, dst)], ["src", "dst"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _open_buckets(multi: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets with several components: minor outside the bucket's largest one, and how many of either kind it has."""
    named = multi.join(comps, multi.doc_id == comps.node, "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    major = (sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
             .where("k > 1").select("key", F.col("m.comp").alias("major"), F.col("m.c").alias("n_major"),
                                    (F.col("n") - F.col("m.c")).alias("n_minor")))
    return named.join(major, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each row of ``_open_buckets`` at each pair of blocks (t1, t2) that it takes part in, t1 <= t2.

    The largest component has blocks of its own, numbered before the others'.
    Its rows meet the others' blocks only; the others' rows meet all. So t2 is
    never a block of the largest component, and a group holds two blocks at most.
    """
    major, minor = (F.ceil(F.col(n) / BLOCK).cast("long") for n in ("n_major", "n_minor"))
    at = F.xxhash64("doc_id")
    own = F.when(F.col("minor"), major + F.pmod(at, minor)).otherwise(F.pmod(at, major))
    first = F.when(F.col("minor"), F.lit(0).cast("long")).otherwise(major)
    return (rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(first, major + minor - 1)))
            .select("key", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "doc_id", "comp", "block"))


def _near_size(pairs: DataFrame, sized: DataFrame, pct: int) -> DataFrame:
    """The (src, dst) of ``pairs`` whose sets' sizes allow a link."""
    return (pairs.join(sized.toDF("src", "n1"), "src").join(sized.toDF("dst", "n2"), "dst")
            .where(100 * F.least("n1", "n2") >= pct * F.greatest("n1", "n2")).select("src", "dst"))


def _further_stars(multi: DataFrame, comps: DataFrame, sized: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """``comps`` after star rounds in the buckets with more than a block outside their largest component.

    A round compares each such document with one centre. The rounds go on
    while each leaves a tenth fewer; the pair step does the rest.
    """
    before = None
    while True:
        crowd = stored(_open_buckets(multi, comps).where(F.col("minor") & (F.col("n_minor") > BLOCK))
                       .select("key", "doc_id", "comp"), "minhash")
        left = crowd.count()
        if not left or before is not None and 10 * left > 9 * before:
            return comps
        before = left
        centre = crowd.groupBy("key").agg(F.min(F.struct("doc_id", "comp")).alias("c"))
        star = (crowd.join(centre, "key").where(F.col("comp") != F.col("c.comp"))
                .groupBy(F.col("doc_id").alias("src")).agg(F.min("c.doc_id").alias("dst")))
        comps = _merged(comps, _confirmed(_near_size(star, sized, pct), sets, pct))


def _open_links(multi: DataFrame, comps: DataFrame, reps: DataFrame, sets: DataFrame, pct: int, minima: int) -> DataFrame:
    """Links between components that share a bucket.

    A bucket of m near copies and a few strangers costs about m rows, one of m
    strangers m * m / BLOCK; a task holds two blocks of either at a time.
    Signatures first tell which rows some near pair needs; only these
    get their full sets, and the pairs are confirmed in place.
    """
    least = int(minima * max(0.0, pct / 100 - MARGIN))
    kind = dict(multi.dtypes)["doc_id"]
    placed = (_block_pairs(_open_buckets(multi, comps)).join(reps.select("doc_id", "sig", "bands"), "doc_id")
              .select(*_HEADS, "doc_id", "comp", "block", "sig", "bands").repartition(*_HEADS).sortWithinPartitions(*_HEADS))
    needed = stored(placed.mapInArrow(_involved(minima, least), placed.schema), "minhash")
    return (needed.join(sets, "doc_id").repartition(*_HEADS).sortWithinPartitions(*_HEADS)
            .mapInArrow(_links(minima, least, pct), f"src {kind}, dst {kind}"))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, component) after further links between its components and documents outside them."""
    label = comps.toDF("id", "c")
    edges = (links.join(label.toDF("src", "c1"), "src", "left").join(label.toDF("dst", "c2"), "dst", "left")
             .select(F.coalesce("c1", "src").alias("src"), F.coalesce("c2", "dst").alias("dst")))
    last = stored(connected_components(edges), "minhash").toDF("c", "final")
    old = label.join(last, "c", "left").select(F.col("id").alias("node"), F.coalesce("final", "c").alias("component"))
    new = last.join(comps, last["c"] == comps["node"], "left_anti").toDF("node", "component")
    return stored(old.unionByName(new), "minhash")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that ``near_components`` keeps, columns as they were.

    Ids of dropped documents set bits of a bitmap; rows without theirs stay
    without a shuffle, only the others meet the ids.
    """
    gone = stored(near_components(df, id_col, text_col, **how).where("NOT kept AND doc_id IS NOT NULL").select("doc_id"), "minhash")
    return without_ids(df, id_col, gone)


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = 5, pct: int = 80,
                    rows: int = 5, bands: int = 32) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts link when 100 * |intersection| >= pct * |union| of their n-gram
    sets. With 5 rows and 32 bands a pair at 0.8 is missed with probability
    3e-6, nearer pairs far more seldom. Null, empty and white-space texts have
    an empty set and link with nothing; a shorter text than ``ngram`` words is
    one n-gram. Rows with a null id are their own component (null) and are
    kept. Rows that repeat an id are one document. An empty table gives an
    empty result.
    """
    minima = rows * bands
    sigs = stored(signatures(df, id_col, text_col, ngram, rows, bands), "minhash")
    live = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    rep_of = live.groupBy("seq_hash").agg(F.min("doc_id").alias("rep"))
    reps = live.join(rep_of.select(F.col("rep").alias("doc_id"), "seq_hash"), ["doc_id", "seq_hash"], "left_semi")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = (keyed.groupBy("key").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    multi = stored(keyed.join(shared, "key"), "minhash")
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    in_play, _ = parted(texts, "doc_id", multi.select("doc_id"))  # texts are not shuffled; some sets more do no harm
    sets = stored(shingle_sets(in_play.where("doc_id IS NOT NULL"), ngram), "minhash")
    sized = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"))
    star = multi.where("doc_id <> center").groupBy(F.col("doc_id").alias("src")).agg(F.min("center").alias("dst"))
    comps = stored(connected_components(_confirmed(_near_size(star, sized, pct), sets, pct)), "minhash")
    comps = _further_stars(multi, comps, sized, sets, pct)
    comps = _merged(comps, _open_links(multi, comps, reps, sets, pct, minima))
    label = comps.toDF("rep", "c")
    named = rep_of.join(label, "rep", "left").select("seq_hash", F.coalesce("c", "rep").alias("component"))
    out = sigs.join(named, "seq_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
