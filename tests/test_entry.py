import __spark_entry__ as E

from conftest import SF
from lexispark.plans import catalog

R_ONLY = {"corpus_ter", "mean_meteor"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_norm" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    """The catalog's own queries; those of the llm subpackage, where it is installed, have their own tests."""
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == R_ONLY
    assert set(catalog.QUERIES) <= set(q) and set(o) <= set(q)
    assert len(q) >= 80


def test_sample_queries_run(spark):
    q = E.queries()
    for name in ["topk_per_source", "corpus_bleu", "volume_summary", "nbest_candidates",
                 "group_split", "utf16_export_scan", "result_ledger"]:
        assert q[name](spark, SF).count() >= 0
