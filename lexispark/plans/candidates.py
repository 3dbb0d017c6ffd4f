"""L2: keyword queries -> n-best candidates -> trimmed candidates.

Trim (W4) per file: normalise, keep-first dedup on (source, target_norm),
top-k per (file, source) by ``sort_by`` desc, optional global row cap,
fixed 5-column projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, rank

OUT_COLS = ["source", "src_lang", "target", "tgt_lang", "volume"]


def trim_candidates(df: DataFrame, top_per_source: int = 5, max_kws: int | None = None,
                    sort_by: str = "volume", group_cols: Sequence[str] = (),
                    order_col: str = "ord", keep: Sequence[str] = OUT_COLS) -> DataFrame:
    """W1 + W4 + O2 + O4 + P1 (``group_cols=['file']`` keeps files independent)."""
    d = df.withColumn("target_norm", T.normalize_text("target"))
    d = clean.dedup_keep_first(d, [*group_cols, "source", "target_norm"], order_col)
    t = rank.candidate_trim(d, top_per_source, sort_by, "source", group_cols, [order_col])
    if max_kws is not None:
        # the cap counts rows per file, in the sorted order
        t = rank.topk_per_key(t, list(group_cols), [F.col(sort_by).desc_nulls_last(),
                                                    F.col(order_col)], max_kws) \
            if group_cols else rank.global_limit(t, max_kws, [F.col(sort_by).desc_nulls_last(),
                                                               F.col(order_col)])
    return t.select(*group_cols, *keep)
