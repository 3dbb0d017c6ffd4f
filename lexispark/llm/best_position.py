"""Ranked lexical search by the Best Position Algorithm (Akbarinia, Pacitti, Valduriez: "Best Position Algorithms", 2007).

1. One pass over the texts keeps of each document its length and the counts
   of those terms that some query may hold; a bitmap of fixed size says which.
2. Lengths give N and L, a count by term gives the document frequencies.
3. The documents are searched in shards, each a run of rows of one partition.
   A shard has one impact list a term: its documents by falling impact. The
   lists of a query are read in parallel from the top. Each new document is
   looked up in all lists (direct access), which gives its whole score and its
   position in every list. A list's best position is the last of the unbroken
   run of seen positions from its top, whether read or looked up. A document
   not seen yet lies beyond all best positions, so the impacts just there
   bound its score; when that bound is strictly below the kth score, no
   unseen document can enter or tie, and the search stops.
4. The shards' best documents are ranked once more for each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import map_texts, stored

#: Bits of the query terms' bitmap: a megabyte, whatever the number of queries.
BITS = 1 << 23
#: Queries, and bytes of their texts, that one run over the shards serves.
BLOCK_QUERIES, BLOCK_BYTES = 256, 4 << 20
#: Postings of a shard.
SHARD_POSTINGS = 2_000_000
#: Positions that the first round reads from each list; later rounds double it.
FIRST_READ = 32

#: Of each UTF-8 byte: A-Z lower-cased, other ASCII but letters and digits a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Bits that a row of Spark's bitmap functions holds.
_BITMAP_BITS = 32768


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of characters that are no ASCII control, space or punctuation, in UTF-8; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _bit(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % BITS


def _bitmap(queries: DataFrame) -> np.ndarray:
    """Which bits the queries' terms set; ``BITS / 32768`` rows come to the driver, whatever the queries."""
    found = map_texts(queries, "item_id", "text", lambda texts: {"bits": [sorted({_bit(t) + 1 for t in terms(x)}) for x in texts]},
                      "bits array<long>")
    at = F.col("bit")  # from 1: bucket b holds the bits from (b - 1) * 32768 + 1 on
    rows = (found.select(F.explode("bits").alias("bit")).groupBy(F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
    out = np.zeros((BITS // _BITMAP_BITS, _BITMAP_BITS // 8), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


@dataclass(frozen=True)
class Corpus:
    """N, the documents with a term, and L, all their terms."""

    documents: int
    terms: int


def weight(n_docs: int, df: int) -> int:
    """A term's weight: floor(1000 * ln((2N + 2) / (2df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """A term's impact in a document, before its weight; 64-bit integers, rounded down."""
    m = 100 - 25 + (25 * n * corpus.documents) // max(1, corpus.terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """The impact lists of some documents and, for direct access, each document's postings."""

    def __init__(self, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        """``starts``: where each document's postings begin, one more at the end; ``term`` and ``impact`` of each posting."""
        self.starts, self.term, self.impact = starts, term, impact
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((doc, -impact, term))
        self.list_at = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.position = np.empty(len(term), np.int64)  # of a posting in its list
        self.position[order] = np.arange(len(term)) - self.list_at[term[order]]
        self.read = self.accesses = 0  # positions read and documents looked up, over all searches

    def search(self, wanted: list[tuple[int, int]], k: int, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents by (score, id); ``wanted``: (term, weight times occurrences)."""
        lists = [(t, w) for t, w in wanted if w > 0 and self.list_at[t + 1] > self.list_at[t]]
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo = np.array([self.list_at[t] for t, _ in lists])
        size = np.array([self.list_at[t + 1] for t, _ in lists]) - lo
        factor = np.array([w for _, w in lists], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        slot = np.full(len(self.list_at), -1)
        slot[[t for t, _ in lists]] = np.arange(len(lists))
        seen = np.zeros(base[-1], bool)
        known = np.zeros(len(self.starts) - 1, bool)
        best = np.zeros(len(lists), np.int64)  # positions of each list's unbroken seen run
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, FIRST_READ
        while True:
            fresh = [self.list_doc[a + depth:a + min(depth + step, s)] for a, s in zip(lo, size, strict=True) if depth < s]
            new = np.unique(np.concatenate(fresh)) if fresh else np.empty(0, np.int64)
            self.read += sum(map(len, fresh))
            new = new[~known[new]]
            if len(new):
                known[new] = True
                self.accesses += len(new)
                count = self.starts[new + 1] - self.starts[new]
                ends = np.cumsum(count)
                at = np.arange(ends[-1]) + np.repeat(self.starts[new] - (ends - count), count)
                place = slot[self.term[at]]
                worth = np.where(place >= 0, self.impact[at] * factor[place], 0)
                hit = place >= 0
                seen[base[place[hit]] + self.position[at[hit]]] = True
                docs = np.concatenate([docs, new])
                scores = np.concatenate([scores, np.add.reduceat(worth, ends - count)])
                if len(docs) > 4 * k:  # ties of the kth stay: an id decides among them
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[scores >= least], scores[scores >= least]
            depth, step = depth + step, 2 * step
            bound = 0
            for i in range(len(lists)):
                if best[i] < size[i]:
                    run = seen[base[i] + best[i]:base[i + 1]]
                    gap = run.argmin()
                    best[i] += len(run) if run[gap] else gap
                if best[i] < size[i]:
                    bound += int(factor[i]) * int(self.list_impact[lo[i] + best[i]])
            if bound == 0 or len(docs) >= k and bound < np.partition(scores, len(scores) - k)[len(scores) - k]:
                break
        docs, scores = docs[scores > 0], scores[scores > 0]
        top = np.lexsort((doc_ids[docs], -scores))[:k]
        return docs[top], scores[top]


def document_terms(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all its terms), terms, tf: the counts of terms whose bit some query sets; stored."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(queries))

    class Asked(dict):
        def __missing__(self, term: bytes) -> str | None:
            if len(self) >= 500_000:
                self.clear()
            bit = _bit(term)
            value = self[term] = term.decode("utf-8", "replace") if bits.value[bit >> 3] >> (bit & 7) & 1 else None
            return value

    asked = Asked()  # of a task

    def run(texts: list[str | None]) -> dict:
        out: dict = {"n": [], "terms": [], "tf": []}
        for text in texts:
            found = terms(text)
            counts = {a: c for t, c in Counter(found).items() if (a := asked[t]) is not None}
            out["n"].append(len(found))
            out["terms"].append(list(counts))
            out["tf"].append(list(counts.values()))
        return out

    return stored(map_texts(docs, id_col, text_col, run, "n long, terms array<string>, tf array<int>"), "search")


def _blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """The queries in blocks of bounded number and bytes; one partition at a time is on the driver."""
    block: list[Row] = []
    size = 0
    for r in queries.select("item_id", "text").toLocalIterator():
        n = len(r["text"] or "")
        if block and (len(block) >= BLOCK_QUERIES or size + n > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield block


def _found(rows: DataFrame, corpus: Corpus, wanted: list[list[tuple[int, int]]], index: dict[str, int], k: int) -> DataFrame:
    """query (its place in the block), doc_id, score: the k best of each shard."""
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield answers(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if held:
            yield answers(pa.Table.from_batches(held).combine_chunks())

    def answers(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([("doc_id", "ascending")])  # places then order as ids do; null ids come last
        lists = t["terms"].combine_chunks()
        names = lists.flatten().dictionary_encode()
        number = np.array([index.get(x, -1) for x in names.dictionary.to_pylist()], np.int64)
        term = number[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
        tf = t["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        count = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(t.num_rows), count)
        known = term >= 0  # the bitmap lets some other terms through
        doc, term, tf = doc[known], term[known], tf[known]
        impact = impacts(tf, t["n"].to_numpy().astype(np.int64)[doc], corpus)
        shard = Shard(np.searchsorted(doc, np.arange(t.num_rows + 1)), term, impact, len(index))
        order = np.arange(t.num_rows)
        got = [shard.search(w, k, order) for w in wanted]
        places = np.concatenate([p for p, _ in got] or [np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(got)), [len(p) for p, _ in got]), pa.int32()),
             t["doc_id"].combine_chunks().take(pa.array(places)), pa.array(np.concatenate([s for _, s in got]), pa.int64())],
            ["query", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(run, f"query int, doc_id {kind.simpleString()}, score long")


def best_documents(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents with a score above 0, equal scores by ascending id.

    Weights and impacts are those of the module's ``weight`` and ``impacts``;
    a term that a query repeats counts as often. Null and empty texts have no
    term, so they are never found, and such queries find nothing. Each row is
    a document and each query row a query, also where ids repeat; a null id
    ranks after others of its score. Empty tables give an empty result; other
    columns are not read. Queries are served in blocks; the documents' texts
    are read once, whatever the number of blocks.
    """
    queries = queries.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    rows = document_terms(docs, queries, id_col, text_col)
    total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    corpus = Corpus(total[0], total[1] or 0)
    item, kind = dict(queries.dtypes)["item_id"], dict(rows.dtypes)["doc_id"]
    out = docs.sparkSession.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
    for block in _blocks(queries):
        asked = [Counter(t.decode("utf-8", "replace") for t in terms(r["text"])) for r in block]
        index = {t: i for i, t in enumerate(dict.fromkeys(t for c in asked for t in c))}
        if not index:
            continue
        # document frequencies of this block's terms: at most as many rows as it has terms
        held = docs.sparkSession.createDataFrame([(t,) for t in index], "term string")
        counts = (rows.select(F.explode("terms").alias("term")).join(F.broadcast(held), "term", "left_semi")
                  .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        freq = {r["term"]: r["df"] for r in counts.collect()}
        wanted = [[(index[t], q * weight(corpus.documents, freq[t])) for t, q in c.items() if t in freq] for c in asked]
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"query int, item_id {item}")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = (_found(rows, corpus, wanted, index, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                  .join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        out = out.unionByName(stored(ranked, "found"))
    return out
