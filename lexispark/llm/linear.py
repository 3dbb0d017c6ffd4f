"""Partition-summed least squares and isotonic calibration, shared by the classifiers.

Each Python task sums its own normal equations; the sums are added in a fixed
number of groups and these once more, so the driver gets one matrix of features
squared a part, whatever the number of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GROUPS = 8
#: Score bins of the calibration; the driver sees one row per bin.
BINS = 2048


def normal_equations(rows: DataFrame, features: Callable[[pd.DataFrame], np.ndarray], targets: list[str],
                     width: int, part_col: str = "part") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """part -> (Z'Z, Z'Y) over the rows of each part; ``features`` turns a batch into its rows of Z."""
    k = len(targets)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for p in batches:
            z, y, part = features(p), p[targets].to_numpy(float), p[part_col].to_numpy()
            for f in np.unique(part):
                own = z[part == f]
                sums.setdefault(int(f), np.zeros((width, width + k)))
                sums[int(f)] += own.T @ np.hstack([own, y[part == f]])
        group = TaskContext.get().partitionId() % GROUPS
        yield pd.DataFrame([(f, group, s.tobytes()) for f, s in sums.items()], columns=["part", "g", "m"])

    def added(p: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m) for m in p["m"])
        return pd.DataFrame([(p["part"].iloc[0], total.tobytes())], columns=["part", "m"])

    grouped = rows.mapInPandas(partial, "part int, g int, m binary").groupBy("part", "g").applyInPandas(added, "part int, m binary")
    out = {r["part"]: np.frombuffer(r["m"]).reshape(width, width + k)
           for r in grouped.groupBy("part").applyInPandas(added, "part int, m binary").collect()}
    return {f: (m[:, :width], m[:, width:]) for f, m in out.items()}


def ridge(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """Weights; the last feature is the constant and is not penalised."""
    shrink = np.full(len(gram), penalty)
    shrink[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(shrink), moment)


def binned(score: np.ndarray) -> np.ndarray:
    """The calibration bin of raw scores, which lie around 0 and 1; the outer bins take the rest."""
    return np.clip(((score + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def isotonic(bins: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over score bins: block centres (raw scores) and calibrated values, both rising."""
    blocks: list[list[float]] = []  # positives, count, centre times count
    for b, p, n in sorted(zip(bins, positives, counts, strict=True)):
        blocks.append([float(p), float(n), ((b + 0.5) * 2 / BINS - 0.5) * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    made = np.array(blocks).reshape(-1, 3)
    return made[:, 2] / made[:, 1], made[:, 0] / made[:, 1]


def calibrated(raw: np.ndarray, centres: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear between block centres, so that raw scores keep their order; outside them the ends are
    stretched a little by the raw score, within 0 and 1."""
    if not len(centres):
        return np.clip(raw, 0.0, 1.0)
    tilt = 1e-6 * (np.clip(raw, -1, 2) - 0.5)
    return np.clip(np.interp(raw, centres, values) * (1 - 1e-5) + 5e-6 + tilt, 0.0, 1.0)
