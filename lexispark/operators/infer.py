"""Candidate generation, prediction and fixed-length encoding.

The model is a pluggable scorer. Two kinds:

* a **lexicon** scorer: a table ``(source, target, cand_rank)``, with
  ``src_lang`` / ``tgt_lang`` where targets depend on them; generation is
  then a plain Spark join + top-k window (no Python at all);
* a **batch function** ``fn(sources, src_lang, tgt_lang) -> list[list[str]]``
  run in a pandas UDF: ``batch_size`` rows of one language pair a call, the
  function loaded once per worker, language passed as columns.

Predictions are always attached by key, never by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import clean, rank

GenerateFn = Callable[[list[str], str, str], list[list[str]]]


def _lexicon_keys(lexicon: DataFrame) -> list[str]:
    """What a lexicon is looked up by: the source, and the languages it names."""
    return ["source"] + [c for c in ("src_lang", "tgt_lang") if c in lexicon.columns]


def lexicon_topk(lexicon: DataFrame, k: int) -> DataFrame:
    """First k lexicon candidates per source and language (WindowGroupLimit, skew-safe)."""
    return rank.topk_per_key(lexicon, _lexicon_keys(lexicon), [F.col("cand_rank"), F.col("target")], k)


def _queries(queries: DataFrame) -> DataFrame:
    """F4-F6, and only queries whose languages are known; repeated queries stay."""
    return clean.clean_queries(queries, "source").dropna(subset=["src_lang", "tgt_lang"])


def nbest(queries: DataFrame, lexicon: DataFrame, k: int = 5) -> DataFrame:
    """T1 with a lexicon scorer: clean queries, take each key's k candidates,
    strip, drop empty, keep the first of repeats (W2), one row per query row
    and candidate. Candidates are made unique before the join, so equal query
    rows each get theirs."""
    q, keys = _queries(queries), _lexicon_keys(lexicon)
    named = lexicon_topk(lexicon, k).withColumn("target", T.py_strip("target")).where("target <> ''")
    cands = named.groupBy(*keys, "target").agg(F.min("cand_rank").alias("cand_rank"))
    return q.join(cands, keys).select(*q.columns, "target", "cand_rank")


def nbest_with(queries: DataFrame, fn: GenerateFn, k: int = 5, batch_size: int = 32) -> DataFrame:
    """T1 with a batch function (e.g. a seq2seq model) in an Arrow pandas UDF.

    Python returns each row's raw candidates only; stripping, dropping empty
    ones and repeats, and ranks are Spark expressions. Output rows are
    (source, src_lang, target, tgt_lang, volume, cand_rank).
    """
    @F.pandas_udf("array<string>")
    def beams(source: pd.Series, src_lang: pd.Series, tgt_lang: pd.Series) -> pd.Series:
        codes, pairs = pd.MultiIndex.from_arrays([src_lang, tgt_lang]).factorize()
        out = np.empty(len(source), object)
        for code, pair in enumerate(pairs):
            at = np.flatnonzero(codes == code)
            for part in np.array_split(at, -(-len(at) // batch_size)):
                for i, found in zip(part, fn(source.iloc[part].tolist(), *pair), strict=True):
                    out[i] = list(found)
        return pd.Series(out)

    d = _queries(queries).withColumn("_beams", beams("source", "src_lang", "tgt_lang"))
    d = d.withColumn("_names", F.transform(F.slice("_beams", 1, k), T.py_strip))
    d = d.withColumn("target", F.explode(clean.nbest_distinct("_names")))
    return d.select("source", "src_lang", "target", "tgt_lang", F.col("volume").cast("double").alias("volume"),
                    F.array_position("_names", F.col("target")).cast("int").alias("cand_rank"))


def predict(df: DataFrame, lexicon: DataFrame, key: str = "source") -> DataFrame:
    """T2 with a lexicon scorer: 1-best candidate of the row's source and
    languages, stripped; a source the lexicon lacks is copied through (the
    identity fallback)."""
    keys = _lexicon_keys(lexicon)
    clean.require_columns(df, keys[1:])
    best = lexicon_topk(lexicon, 1).select(*[F.col(c).alias(f"_k_{c}") for c in keys], T.py_strip("target").alias("_pred"))
    on = [df[key if c == "source" else c] == best[f"_k_{c}"] for c in keys]
    j = df.join(best, on, "left")
    return j.withColumn("prediction", F.coalesce(F.col("_pred"), F.col(key))).drop("_pred", *[f"_k_{c}" for c in keys])


def predict_with(df: DataFrame, fn: Callable[[list[str]], list[str]], col: str = "source",
                 batch_size: int = 16) -> DataFrame:
    """T2 with a batch function through an Arrow pandas UDF (T6: batches of
    ``batch_size`` inside each Arrow batch); the result stays on its row."""
    @F.pandas_udf("string")
    def _pred(s: pd.Series) -> pd.Series:
        vals = s.fillna("nan").astype(str).tolist()
        out = []
        for i in range(0, len(vals), batch_size):
            out.extend(p.strip() for p in fn(vals[i:i + batch_size]))
        return pd.Series(out)
    return df.withColumn("prediction", _pred(F.col(col)))


# ---- T3 / T4: vocabulary and fixed-length encoding ----------------------------

# Special token ids of the word-level vocabulary.
PAD_ID, UNK_ID, EOS_ID, N_SPECIAL = 0, 1, 2, 3


def vocab_build(texts: DataFrame, cols: Sequence[str] = ("input", "target")) -> DataFrame:
    """T4: word counts over whitespace tokens, ids by (count desc, word).

    Counting is a map-side-combined aggregate; the ranking uses the
    distributed positional index (no single-task window).
    """
    from ..sources.io import positional_id
    toks = None
    for c in cols:
        t = texts.select(F.explode(T.ws_tokens(c)).alias("word"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    v = positional_id(counts, [F.col("count").desc(), F.col("word")], "rank")
    return v.withColumn("token_id", (F.col("rank") + N_SPECIAL).cast("int"))


#: Words that are looked up by broadcast, and counters of the sketch that finds them: a word outside has at most about
#: one in ``SKETCH_COUNTERS`` of all tokens.
HEAVY_WORDS, SKETCH_COUNTERS = 4096, 16384


def heavy_words(tokens: DataFrame, words: int = HEAVY_WORDS, counters: int = SKETCH_COUNTERS) -> DataFrame:
    """word: the most frequent words by a frequent-items sketch, ``words`` rows at most.

    A task keeps ``counters`` counters whatever it reads, and they are merged,
    so a word of a third of all tokens is one counter a task.
    """
    top = tokens.where(F.col("word").isNotNull()).agg(F.expr(f"approx_top_k(word, {words}, {counters})").alias("top"))
    return top.select(F.explode(F.transform("top", lambda x: x["item"])).alias("word"))


def word_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens`` (word, any others) with ``token_id``: heavy words by broadcast, the rest by a shuffle; unknown words get UNK_ID.

    In the shuffle a heavy word's rows have no key but a salt, so they spread
    evenly and stay where they fall. Null words get a null id.
    """
    ids = vocab.select(F.col("word").alias("_w"), "token_id")
    heavy = heavy_words(tokens).join(ids, F.col("word") == F.col("_w"), "left").select(
        F.col("word").alias("_heavy"), F.coalesce("token_id", F.lit(UNK_ID)).alias("_heavy_id"))
    met = tokens.join(F.broadcast(heavy), F.col("word") == F.col("_heavy"), "left")
    rare = F.col("_heavy").isNull() & F.col("word").isNotNull()
    salt = F.when(rare, 0).otherwise(F.pmod(F.xxhash64(*[c for c in tokens.columns if c != "word"]), F.lit(1 << 20)).cast("int"))
    met = met.withColumn("_key", F.when(rare, F.col("word"))).withColumn("_salt", salt)
    zero = F.coalesce(F.pmod(F.col("token_id"), F.lit(1)), F.lit(0))  # a literal would be folded away and the salt with it
    out = met.join(ids.withColumn("_zero", zero), (F.col("_key") == F.col("_w")) & (F.col("_salt") == F.col("_zero")), "left")
    found = F.when(F.col("word").isNotNull(), F.coalesce("_heavy_id", "token_id", F.lit(UNK_ID)))
    return out.select(*tokens.columns, found.cast("int").alias("token_id"))


def encode_fixed_length(df: DataFrame, vocab: DataFrame, key: str = "id", max_src_len: int = 64,
                        max_tgt_len: int = 32, label_pad: int | None = None) -> DataFrame:
    """input_ids / attention_mask (max_src_len) and labels (max_tgt_len).

    Labels are padded with the pad id by default; ``label_pad=-100`` gives
    the loss-masked form. ``key`` is unique per row. Both columns' tokens,
    truncated first, go through one lookup (``word_ids``) and one aggregate,
    which gathers ``max_src_len + max_tgt_len`` ids a row at most.
    """
    sides = (("input", max_src_len, PAD_ID), ("target", max_tgt_len, PAD_ID if label_pad is None else label_pad))
    null = F.lit(None).cast("string")
    # a row without words still has the null word of each side
    def words(i: int, c: str, n: int) -> Column:
        kept = F.slice(F.coalesce(T.ws_tokens(c), F.array().cast("array<string>")), 1, n - 1)
        return F.concat(F.array(F.struct(F.lit(i).alias("_side"), F.lit(-1).alias("_pos"), null.alias("word"))),
                        F.transform(kept, lambda w, at: F.struct(F.lit(i).alias("_side"), at.alias("_pos"), w.alias("word"))))

    ids = word_ids(df.select(key, F.inline(F.concat(*[words(i, c, n) for i, (c, n, _) in enumerate(sides)]))), vocab)
    rows = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_side", "_pos", "token_id"))).alias("_t"))

    def body(i: int) -> Column:
        mine = F.filter("_t", lambda x: (x["_side"] == i) & (x["_pos"] >= 0))
        return F.concat(F.transform(mine, lambda x: x["token_id"]), F.array(F.lit(EOS_ID)))

    def padded(c: Column, n: int, pad: int) -> Column:
        return F.concat(c, F.array_repeat(F.lit(pad), F.lit(n) - F.size(c)))

    (_, n, pad), (_, m, label) = sides
    return rows.select(key, padded(body(0), n, pad).alias("input_ids"),
                       padded(F.transform(body(0), lambda x: F.lit(1)), n, 0).alias("attention_mask"),
                       padded(body(1), m, label).alias("labels_ids"))
