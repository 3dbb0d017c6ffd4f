"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model gets the
earlier categories' probabilities as inputs. While training, those are
out-of-fold: a row's probabilities come from models that its fold did not
fit. Each model is ridge least squares from partition-summed normal equations
over word and word-beginning features, with isotonic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_texts, stored
from .linear import binned, calibrated, isotonic, normal_equations, ridge
from .minhash import words

#: Labelled rows that are used for fitting at most: those of the smallest id hashes.
FIT_ROWS = 30_000
FOLDS, FEATURES, PENALTY, THRESHOLD = 3, 400, 3.0, 0.5
#: Documents of the sample in which a feature must occur.
LEAST_DOCS = 4
_STRIP = b".,;:!?\"'()[]{}*#$%&|"

# Word lists that split the label's positives into weak categories.
INSULT = ("idiot", "moron", "clown", "loser", "stupid", "fool", "dumb")
CONTEMPT = ("worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "vermin")
CATEGORIES = ("insult", "contempt", "coded", "toxic")


def categories(text: Column, toxic: Column) -> list[Column]:
    """Weak labels of the chain's links from the label and the word lists; the last link is the label itself."""
    low = F.lower(F.coalesce(text, F.lit("")))
    insult, contempt = (low.rlike(rf"\b(?:{'|'.join(w)})\b") for w in (INSULT, CONTEMPT))
    bad = toxic == 1
    return [F.when(c, 1).otherwise(0).alias(n) for n, c in zip(
        CATEGORIES, (bad & insult, bad & contempt, bad & ~insult & ~contempt, bad), strict=True)]


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 to 6 bytes, the latter with a star."""
    word = word.strip(_STRIP)
    return [word, *[word[:k] + b"*" for k in (4, 5, 6) if len(word) > k]] if word else []


def _feature_counts(rows: DataFrame) -> DataFrame:
    """feature, positives and negatives: documents that hold it, summed in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()),
                                               pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "n1", "n0"])

        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for f in {f for w in set(words(text)) for f in features_of(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
            if len(counts) > 500_000:
                yield out()
                counts = {}
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "feature binary, n1 long, n0 long").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class Chain:
    """Features, and per link the weights of each fold's complement, of all rows, and the calibration."""

    def __init__(self, features: list[bytes]):
        self.place = {f: i for i, f in enumerate(features)}
        self.width = len(features)
        self.by_fold: list[dict[int, np.ndarray]] = []
        self.full: list[np.ndarray] = []
        self.curves: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: dict[bytes, tuple[int, ...]] = {}

    def active(self, text: str | None) -> list[int]:
        """The numbers of the features that occur in a whole text."""
        found: set[int] = set()
        known, place = self.known, self.place
        for w in set(words(text)):
            hit = known.get(w)
            if hit is None:
                if len(known) > 500_000:
                    known.clear()
                hit = known[w] = tuple([place[f] for f in features_of(w) if f in place])
            if hit:
                found.update(hit)
        return sorted(found)

    def dense(self, active) -> np.ndarray:
        x = np.zeros((len(active), self.width + 1))
        for i, a in enumerate(active):
            x[i, np.asarray(a, np.int64)] = 1
        x[:, -1] = 1
        return x

    def inputs(self, x: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        """Words, earlier links' probabilities, the constant; out-of-fold where ``fold`` is given."""
        z = x
        for j in range(len(self.curves)):
            z = np.hstack([z[:, :-1], self.probability(j, z, fold)[:, None], z[:, -1:]])
        return z

    def raw(self, j: int, z: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        if fold is None:
            return z @ self.full[j]
        out = np.zeros(len(z))
        for f in np.unique(fold):
            own = fold == f
            out[own] = z[own] @ self.by_fold[j].get(int(f), self.full[j])
        return out

    def probability(self, j: int, z: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        return calibrated(self.raw(j, z, fold), *self.curves[j])

    def predict(self, x: np.ndarray) -> list[np.ndarray]:
        z, out = x, []
        for j in range(len(self.curves)):
            out.append(self.probability(j, z, None))
            z = np.hstack([z[:, :-1], out[-1][:, None], z[:, -1:]])
        return out


def fit_chain(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Chain | None:
    """A chain from at most ``fit_rows`` labelled documents; None without any label.

    A document that several label rows name counts once, with its largest
    label, and one that several rows hold counts once, with its smallest text. The chosen ids are broadcast; ``fit_rows`` bounds their size.
    """
    chosen = (labels.where(f"doc_id IS NOT NULL AND {label_col} IN (0, 1)").groupBy("doc_id")
              .agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("part")
    rows = stored(rows.select("doc_id", "text", fold, *categories(F.col("text"), F.col("y"))), "toxicity")
    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not totals[1]:
        return None
    n1, n = float(totals[0]), float(totals[1])
    gap = F.col("n1") * n - (F.col("n1") + F.col("n0")) * n1  # chi-squared up to a constant
    chi = gap * gap / ((F.col("n1") + F.col("n0")) * (n + 1 - F.col("n1") - F.col("n0")))
    top = (_feature_counts(rows).where(F.col("n1") + F.col("n0") >= LEAST_DOCS)
           .orderBy(chi.desc(), "feature").limit(FEATURES).select("feature").collect())
    chain = Chain([bytes(r[0]) for r in top])
    held = stored(map_columns(rows, ["doc_id", "part", *CATEGORIES], lambda b: {
        "active": [chain.active(x) for x in b.column("text").to_pylist()]}, "active array<int>"), "toxicity")
    for j, name in enumerate(CATEGORIES):
        def z_of(p: pd.DataFrame) -> np.ndarray:
            return chain.inputs(chain.dense(p["active"].to_numpy()), p["part"].to_numpy())

        sums = normal_equations(held, z_of, [name], chain.width + 1 + j)
        gram, moment = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())[:, 0]
        by_fold = {f: ridge(gram - s[0], moment - s[1][:, 0], PENALTY) for f, s in sums.items()}
        chain.full.append(ridge(gram, moment, PENALTY))
        chain.by_fold.append(by_fold)

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame({"bin": binned(chain.raw(j, z_of(p), p["part"].to_numpy())), "y": p[name].astype("int64")})

        made = held.mapInPandas(bins, "bin long, y long").groupBy("bin").agg(F.sum("y"), F.count(F.lit(1))).collect()
        chain.curves.append(isotonic(*(np.array([r[i] for r in made], float) for i in range(3))))
    chain.known.clear()
    return chain


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> per link, predicted (1 if the last is at least ``threshold``).

    Every whole text is scored. Null and empty texts get the models' constants.
    Without a usable label all probabilities are 0. Repeated rows get equal
    scores; an empty table gives an empty result; extra columns are not read.
    """
    chain = fit_chain(df, labels, id_col, text_col, fit_rows=fit_rows)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(texts: list[str | None]) -> dict:
        if chain is None:
            return {n: np.zeros(len(texts)) for n in names}
        return dict(zip(names, chain.predict(chain.dense([chain.active(t) for t in texts])), strict=True))

    scored = map_texts(df, id_col, text_col, run, ", ".join(f"{n} double" for n in names))
    return scored.withColumn("predicted", (F.col(names[-1]) >= threshold).cast("int"))
