import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexispark.operators import bitext, rank, split
from lexispark.plans import prepare as P
from lexispark.session import scratch_path
from lexispark.sources import fixtures as fx
from lexispark.sources import io, positions

from conftest import SF

SPLITS, CORES = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture
def confs(spark):
    def put(**values):
        for k, v in values.items():
            spark.conf.set({"split": SPLITS, "cores": CORES, "cost": "spark.sql.files.openCostInBytes"}[k], v)
    yield put
    for k in (SPLITS, CORES, "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def files(folder, sizes=(3, 4000, 1, 900)):
    """Quoted commas, doubled quotes and empty fields, in files of very different size."""
    at = 0
    for name, size in zip("badc", sizes):
        with open(folder / f"{name}.csv", "w") as f:
            f.write("n,t\n")
            for i in range(size):
                f.write(f'{name}{i},"x, ""{"y" * (i % 50)}"\n' if i % 3 else f"{name}{i},\n")
        at += size
    return [f"{n}{i}" for n, size in sorted(zip("badc", sizes)) for i in range(size)]


def placed(spark, folder):
    return io.read_csv(spark, f"{folder}/*.csv", "n string, t string")


CUTS = [dict(split="128m"), dict(split="10k", cost="1"), dict(split="700", cost="1"), dict(split="128m", cores="1", cost="1"),
        dict(split="128m", cores="8", cost="1"), dict(split="3k", cost="64m")]


def test_positions_do_not_depend_on_the_cut(spark, tmp_path, confs):
    want = list(enumerate(files(tmp_path)))
    for cut in CUTS:
        confs(**cut)
        assert sorted((r.ord, r.n) for r in placed(spark, tmp_path).select("ord", "n").collect()) == want, cut


def test_split_and_sample_do_not_depend_on_cut_or_folder(spark, tmp_path, confs):
    (tmp_path / "one").mkdir()
    files(tmp_path / "one")
    shutil.copytree(tmp_path / "one", tmp_path / "two")

    def both(folder):
        d = placed(spark, folder)
        return (sorted(map(tuple, split.three_way_split(d).select("n", "split").collect())),
                [r.n for r in rank.hash_sample(d).collect()])

    confs(**CUTS[0])
    want = both(tmp_path / "one")
    for cut in CUTS[1:4]:
        confs(**cut)
        assert both(tmp_path / "one") == want and both(tmp_path / "two") == want


def test_split_is_the_same_at_one_and_eight_cores(tmp_path):
    files(tmp_path)
    code = """
import sys; sys.path.insert(0, {root!r})
from lexispark.session import local_session
from lexispark.sources import io
from lexispark.operators import split
spark = local_session(cores={cores}); spark.conf.set("spark.sql.files.openCostInBytes", "1")
d = io.read_csv(spark, "{folder}/*.csv", "n string, t string")
print("ROWS", d.rdd.getNumPartitions(), hash(tuple(sorted(map(tuple, split.three_way_split(d).select("n", "ord", "split").collect())))))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = []
    for cores in (1, 8):
        out = subprocess.run([sys.executable, "-c", code.format(root=root, cores=cores, folder=tmp_path)], capture_output=True, text=True,
                             env=os.environ | {"PYTHONHASHSEED": "0"}, timeout=300)
        seen.append(next(x for x in out.stdout.splitlines() if x.startswith("ROWS")).split()[1:])
    assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1]


def test_positions_without_broadcast_and_from_other_readers(spark, tmp_path, monkeypatch):
    names = files(tmp_path)
    assert positions.most_blocks(spark.read.text(str(tmp_path))) >= 4
    monkeypatch.setattr(positions, "BROADCAST_BLOCKS", 0)
    assert sorted((r.ord, r.n) for r in placed(spark, tmp_path).collect()) == list(enumerate(names))
    lines = positions.with_positions(spark.read.option("header", False).text(f"{tmp_path}/d.csv"), "at").orderBy("at").collect()
    assert [r.value.split(",")[0] for r in lines] == ["n", "d0"]


def test_no_sort_and_no_checkpoint_for_positions(spark, tmp_path):
    files(tmp_path)
    plan = placed(spark, tmp_path)._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("BroadcastExchange")[0]  # what stands above the blocks' sums
    assert "Sort" not in rows and "Exchange" not in rows and "BroadcastHashJoin" in plan


def test_changed_cut_between_the_scans_is_an_error(spark, tmp_path):
    files(tmp_path)
    d = placed(spark, tmp_path)
    spark.conf.set(SPLITS, "128m")
    d._jdf.queryExecution().executedPlan()
    assert d.count() == 4904
    marked = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(Exception):
        positions.with_positions(marked).count()  # no file scan, so no blocks


def test_empty_files_and_only_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("n,t\nx,1\n")
    assert [tuple(r) for r in placed(spark, tmp_path).collect()] == [("x", "1", 0)]


EXPORT = "ID long, Keyword string, Volume long, `SERP Features` string, Intents string, ord long"


def exports(spark):
    src = spark.createDataFrame([(i, f"k{i}", i, "s", None, i) for i in range(50)], EXPORT)
    tgt = spark.createDataFrame([(i, f"t{i}", i, "s", None, 49 - i) for i in range(50)], EXPORT)
    return src, tgt


def test_pairs_by_place_or_by_key(spark):
    src, tgt = exports(spark)
    by_place = {r.input.split(" ")[1]: r.target for r in bitext.build_parallel(src, tgt, include_intents=False).collect()}
    by_key = {r.input.split(" ")[1]: r.target for r in bitext.build_parallel(src, tgt, include_intents=False, by="ID").collect()}
    assert by_place == {f"k{i}": f"t{49 - i}" for i in range(50)} and by_key == {f"k{i}": f"t{i}" for i in range(50)}


def test_rows_without_partner_and_repeated_keys_are_errors(spark):
    src, tgt = exports(spark)
    for a, b in ((src, tgt.where("ID < 40")), (src.where("ID > 3"), tgt)):
        with pytest.raises(Exception, match="no partner"):
            bitext.build_parallel(a, b).collect()
    with pytest.raises(Exception, match="ID repeats"):
        bitext.build_parallel(src.union(src.where("ID = 7")), tgt, by="ID").collect()
    with pytest.raises(KeyError, match="no column"):
        bitext.build_parallel(src, tgt, by="key")


def test_pairing_sorts_no_rows(spark):
    plan = bitext.build_parallel(*exports(spark))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_csv_to_csv(spark, tmp_path):
    import pandas as pd
    kw = fx.kw(spark, SF)
    cfg, base = P.PrepConfig(topk_per_source=2), scratch_path(spark, "csv")
    io.write_table(kw.orderBy("ord").drop("ord"), f"{base}/in", fmt="csv")
    schema = ", ".join(f"{n} {t}" for n, t in kw.drop("ord").dtypes)
    P.write_outputs(io.read_csv(spark, f"{base}/in", schema), f"{base}/out", cfg, make_upweighted=True)
    folder = f"{base}/out/clean_full".removeprefix("file:")
    got = pd.concat([pd.read_csv(f"{folder}/{f}") for f in sorted(os.listdir(folder)) if f.endswith(".csv")], ignore_index=True)
    assert list(got.columns) == [*kw.drop("ord").columns, "target_norm"]
    want = P.clean_full(kw, cfg).toPandas().sort_values(["source", "actual_volume", "ord"], ascending=[True, False, True])
    assert got["source"].tolist() == want["source"].tolist() and got["target"].tolist() == want["target"].tolist()
    train = spark.read.option("header", True).csv(f"{base}/out/pairs").where("split = 'train'")
    assert spark.read.option("header", True).csv(f"{base}/out/train_upweighted").count() >= train.count() > 0
