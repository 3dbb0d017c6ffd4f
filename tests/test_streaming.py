from lexispark.plans import prepare
from lexispark.session import scratch_path
from lexispark.sources import io
from lexispark.streaming.incremental import start_csv_stream

SCHEMA = "ord long, source string, src_lang string, target string, tgt_lang string, actual_volume long"


def test_stream_matches_batch_filters(spark):
    rows = [(0, "s1", "en_XX", "Alpha", "de_DE", 10), (1, "s1", "en_XX", "alpha.", "de_DE", 500),
            (2, "s1", "en_XX", "webs", "de_DE", 50), (3, "s2", "en_XX", "fine", "nl_XX", 7),
            (4, "s2", "en_XX", "x", "nl_XX", 7)]
    d = spark.createDataFrame(rows, SCHEMA)
    src = scratch_path(spark, "stream-in")
    io.write_table(d.coalesce(1), src, fmt="csv")
    out = scratch_path(spark, "stream-out")
    q = start_csv_stream(spark, src, SCHEMA, out)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    got_ords = sorted(r.ord for r in got.collect())
    assert len(got_ords) == 2 and got_ords[0] in (0, 1) and got_ords[1] == 3
    assert set(got.columns) >= {"source", "target_norm", "split"}
    batch = prepare.filtered(d).select("ord").collect()
    assert sorted(r.ord for r in batch) == [0, 1, 3]   # batch keeps both before dedup
