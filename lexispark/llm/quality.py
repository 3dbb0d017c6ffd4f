"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, map_texts, matrix, stored
from .linear import binned, calibrated, isotonic, normal_equations, ridge

#: Random Fourier features, the Gaussian kernel's width in standard deviations, and the ridge penalty.
FEATURES, WIDTH, PENALTY = 384, 4.0, 1.0
_SEED = 7
_KINDS = np.zeros(256, np.int64)  # classes of bytes
for _k, _bytes in enumerate((b" ", b"\n", b"\t\r\x0b\x0c", range(97, 123), range(65, 91), b"0123456789", b".", b",;:", b"!?",
                             b"\"'()-", b"|", b"#$%&*+/<=>@[\\]^_`{}~", range(128, 256)), start=1):
    for _b in _bytes:
        _KINDS[_b] = _k
STATS = ["log_bytes", "log_words", "mean_word", "std_word", "log_longest", "distinct", "repeat", "upper_words", "tail_marks",
         "lines", "distinct_lines", "mean_line", "packed", "entropy"] + [f"byte_{k}" for k in range(int(_KINDS.max()) + 1)]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; of an empty one all are 0."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATS)
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256)
    shares = hist[hist > 0] / len(b)
    by_kind = np.bincount(_KINDS, weights=hist, minlength=int(_KINDS.max()) + 1) / len(b)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    ends = np.flatnonzero(space[1:] & ~space[:-1])  # last bytes of words that white space follows
    last = _KINDS[b[ends]]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [np.log1p(len(b)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
            len(set(words)) / n, same / n, sum(map(bytes.isupper, words)) / n,
            float((last >= 9).sum() - (last == 13).sum()) / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
            np.log1p(len(b) / len(lines)), len(zlib.compress(raw, 1)) / (len(b) + 20),
            float(-(shares * np.log2(shares)).sum()), *by_kind]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics of the whole text as array<double>."""
    return map_texts(df, id_col, text_col, lambda texts: {"stats": [statistics(t) for t in texts]}, "stats array<double>")


class Model:
    """Scaling, Fourier directions, weights and calibration; small, sent to the tasks with the code."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(_SEED)
        self.mean, self.std = mean, std
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.centres = self.values = np.empty(0)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.std).clip(-8, 8) @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(x), self.centres, self.values)


def bucket_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out, 1 calibrates, the others fit."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    """A model from the labelled rows that are not held out; None without any.

    A document that several label rows name counts once, with its smallest
    label; null labels and ids are left out. Buckets 2 to 4 give the normal
    equations and bucket 1 the calibration; afterwards all four give the
    weights, so calibration sees scores of rows that its weights never saw.
    """
    known = (labels.where(f"doc_id IS NOT NULL AND {label_col} IN (0, 1)").groupBy("doc_id")
             .agg(F.min(label_col).cast("int").alias("y")))
    rows = stored(stats.join(known, "doc_id").withColumn("part", bucket_of()).where("part > 0"), "quality")
    n = len(STATS)
    cols = [F.col("stats")[i] for i in range(n)]
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not moments[0]:
        return None
    model = Model(np.array(moments[1:1 + n], float), np.maximum(np.array(moments[1 + n:], float), 1e-6))
    sums = normal_equations(rows, lambda p: model.features(np.stack(p["stats"])), ["y"], FEATURES + 1)
    fitting = [s for f, s in sums.items() if f > 1] or list(sums.values())
    model.weights = ridge(sum(s[0] for s in fitting), sum(s[1] for s in fitting)[:, 0], PENALTY)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"bin": binned(model.raw(np.stack(p["stats"]))), "y": p["y"].astype("int64")})

    held = rows.where("part = 1") if 1 in sums else rows
    made = held.mapInPandas(bins, "bin long, y long").groupBy("bin").agg(F.sum("y"), F.count(F.lit(1))).collect()
    model.centres, model.values = isotonic(*(np.array([r[i] for r in made], float) for i in range(3)))
    model.weights = ridge(sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())[:, 0], PENALTY)
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    The score is the calibrated probability of label 1 from the whole text's
    statistics alone. Null and empty texts have statistics 0 and a score like
    any other. Without a usable label every score is 0.5. Repeated rows get
    equal scores; an empty table gives an empty result.
    """
    stats = stored(document_statistics(df, id_col, text_col), "quality")
    model = fit(stats, labels)

    def run(b: pa.RecordBatch) -> dict:
        return {"score": model.score(matrix(b.column("stats"))) if model else np.full(b.num_rows, 0.5)}

    scored = map_columns(stats, ["doc_id"], run, "score double")
    return scored.select("doc_id", (bucket_of() == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more, columns as they were; all of them without a usable label.

    A row's statistics are stored beside it and scored there, so no text is
    shuffled. Each row is judged by its own text, also where ids repeat.
    """
    name = fresh(df, "__stats")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    rows = stored(df.withColumn(name, measured(F.col(text_col).cast("string"))), "quality")
    model = fit(rows.select(F.col(id_col).alias("doc_id"), F.col(name).alias("stats")), labels)
    if model is None:
        return rows.drop(name)

    @F.pandas_udf("boolean")
    def accepted(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats)) >= threshold) if len(stats) else pd.Series([], dtype=bool)

    return rows.where(accepted(F.col(name))).drop(name)
