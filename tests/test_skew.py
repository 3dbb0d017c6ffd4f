"""A hot key holding a third of all rows: results equal a brute-force
run, and the plan reduces the hot key map-side before each shuffle."""

import heapq
import math
from collections import defaultdict

from lexispark.plans import prepare as P


def test_hot_source_l1_matches_brute_force(spark):
    n = 6000
    rows = []
    for i in range(n):
        src = "hot source" if i % 3 == 0 else f"src {i % 500}"
        tgt = f"tgt {(i * 7) % 40}" + ("." if i % 5 == 0 else "")
        vol = None if i % 13 == 0 else (i * 7919) % 5000
        rows.append((i, src, "en_XX", tgt, "de_DE", vol))
    schema = "ord long, source string, src_lang string, target string, tgt_lang string, actual_volume long"
    df = spark.createDataFrame(rows, schema).repartition(8)
    cfg = P.PrepConfig(topk_per_source=3)
    out = P.clean_full(df, cfg)

    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "WindowGroupLimit" in plan

    first = {}
    for i, src, _, tgt, _, vol in rows:
        if vol:
            first.setdefault((src, tgt.removesuffix(".")), (-vol, i))
    by_source = defaultdict(list)
    for (src, _), best in first.items():
        by_source[src].append(best)
    want = sorted(i for found in by_source.values() for _, i in heapq.nsmallest(3, found))
    assert sorted(r.ord for r in out.collect()) == want

    lab = P.with_split(out, cfg)
    n_src = len(by_source)
    train = lab.where("split = 'train'").select("source").distinct().count()
    assert train == math.floor(n_src * 0.9)
