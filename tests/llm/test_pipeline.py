"""The five stages of the pipeline against plain Python, and the helpers that keep texts out of shuffles."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import common, exact_dedup, queries

GOOD = "the river runs past old mills and quiet gardens while people walk home in evening light after long days of work".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(GOOD)
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return " ".join(out)


def junk(rng, n):
    return "".join(rng.choice("#$%|~^&*{}<>=@0123456789") for _ in range(n))


def corpus():
    rng = random.Random(6)
    texts = {i: prose(rng, rng.randrange(60, 300)) for i in range(0, 120)}
    texts |= {i: junk(rng, rng.randrange(200, 900)) for i in range(200, 300)}
    texts[400] = "  ".join(texts[5].split(" "))  # equal up to white space
    texts[401] = texts[5]
    words = texts[9].split(" ")
    texts[402] = " ".join([*words[:-1], "elsewhere"])  # near
    texts[403] = texts[11] + " Write to jane@example.org or call +49 30 1234567 now."
    texts[404] = prose(rng, 5000)
    return texts


def near(a, b):
    s, t = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return 100 * len(s & t) >= 80 * len(s | t)


def test_run_against_plain_python(spark, tmp_path):
    texts = corpus()
    labels = [(i, int(i < 200 or i >= 400), 0) for i in texts if i % 2 == 0 or i < 20]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in texts.items() if not 200 <= i < 300}  # what a reader would reject
    seen = {}
    for i in sorted(kept):
        seen.setdefault(" ".join(kept[i].split()), i)
    kept = {i: kept[i] for i in seen.values()}
    comp = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and comp[a] != comp[b] and near(kept[a], kept[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert 400 not in kept and 402 not in kept and 5 in kept and 9 in kept
    for i in kept:
        kept[i] = re.sub(r"\S+@example\.org", "<EMAIL>", kept[i]).replace("+49 30 1234567", "<PHONE>")

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary(queries.WORD_TOKENIZER))
    want = set()
    for i, t in kept.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.add((i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces} == want and len(pieces) == len(want)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.1 * sum(r.length for r in pieces) / 2048 + 1


def test_stages_keep_the_columns(spark):
    """Clashing names, null ids, repeated rows and null texts go through all stages but the last."""
    rows = [(1, "a b c d e f", "x", 1, "m"), (1, "a b c d e f", "x", 1, "m"), (2, None, "x", 2, "m"), (None, "a b c d e f", "x", 3, "m"), (None, "z", "x", 4, "m"),
            (3, "", "x", 5, "m"), (4, "mail me: q@r.st " * 20_000, "x", 6, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h string, __row long, __stats string")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), "test") if name != "quality classifier" else docs
        assert docs.columns == ["doc_id", "text", "__h", "__row", "__stats"], name
    assert sorted(r["__row"] for r in docs.collect()) == [1, 1, 2, 4, 6]
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).columns == docs.columns


def test_parted_and_without_ids(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "n")], "id long, t string")
    ids = spark.createDataFrame([(i,) for i in (3, 7, 7, 499, 1000)] + [(None,)], "x long")
    for bits in (1 << 26, 64):  # a full bitmap sends more rows through the join, no others
        monkeypatch.setattr(common, "ID_BITS", bits)
        maybe, rest = common.parted(df, "id", ids)
        held = {r.id for r in maybe.collect()}
        assert held >= {3, 7, 499, None} and not held & {r.id for r in rest.collect()} and maybe.count() + rest.count() == 501
        left = {r.id for r in common.without_ids(df, "id", ids).collect()}
        assert left == {*range(500), None} - {3, 7, 499}
    assert common.without_ids(df, "id", ids.limit(0)).count() == 501
    text = df.select(F.col("id").cast("string").alias("id"), "t")
    assert common.without_ids(text, "id", ids.select(F.col("x").cast("string"))).count() == 498


def test_only_ids_of_copies_are_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
    got = exact_dedup.drop_exact(df)
    assert sorted(r.doc_id for r in got.collect()) == list(range(90))


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "b")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.drop_exact(df).count() == len(rows)
