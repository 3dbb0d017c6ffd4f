"""Directly addressable codes: exact round trips, single accesses, edge cases."""

import struct
import zlib

import numpy as np
import pytest

from lexispark.llm import queries, token_codes
from lexispark.session import scratch_path

DOCS = "doc_id long, text string, start string"


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary(queries.WORD_TOKENIZER)


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [200, 49408, 2**32 - 1])
def test_segment_round_trip_and_access(size, top):
    rng = np.random.default_rng(size)
    ids = (rng.integers(0, top, size, endpoint=True) >> rng.integers(0, 32, size)).astype(np.uint32)
    data = token_codes.encode_segment(ids)
    assert (token_codes.decode_segment(data) == ids).all()
    asked = []

    def read(at, n):
        asked.append(n)
        return data[3 + at - 3:][:n]

    for i in rng.permutation(size)[:50].tolist():
        asked.clear()
        assert token_codes.access(read, 0, data[:16], i) == ids[i]
        assert sum(asked) <= 4 * (1 + 64 + 4)  # whatever the size of the segment


def test_small_ids_take_about_a_byte():
    data = token_codes.encode_segment(np.arange(100_000) % 256)
    assert len(data) < 1.25 * 100_000


def test_writer_and_reader_over_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT", 1000)
    rng = np.random.default_rng(3)
    docs = [(i if i else None, rng.integers(0, 70000, n, dtype=np.uint32)) for i, n in enumerate([5, 0, 2500, 999, 1, 1000, 7000])]
    path = str(tmp_path / "x.dac")
    with open(path, "wb") as f:
        w = token_codes.Writer(f)
        for i, ids in docs:
            w.add(i, ids.tobytes())
        assert w.waiting < 1000
        w.close()
    r = token_codes.Reader(path)
    got = [(i, at, np.concatenate([*p, np.empty(0, np.uint32)])) for i, at, p in r.documents()]
    flat = np.concatenate([ids for _, ids in docs])
    assert [i for i, _, _ in got] == [i for i, _ in docs]
    assert [at for _, at, _ in got] == np.cumsum([0, *[len(ids) for _, ids in docs]])[:-1].tolist()
    assert all((a == b[1]).all() for (_, _, a), b in zip(got, docs, strict=True))
    assert all(r.token(i) == flat[i] for i in rng.integers(0, len(flat), 300).tolist())
    with pytest.raises(IndexError):
        r.token(len(flat))
    raw = bytearray(open(path, "rb").read())
    raw[2000] ^= 1
    (tmp_path / "y.dac").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        for _, _, p in token_codes.Reader(str(tmp_path / "y.dac")).documents():
            list(p)
    (tmp_path / "z.dac").write_bytes(b"no file")
    with pytest.raises(ValueError, match="no file of token codes"):
        token_codes.Reader(str(tmp_path / "z.dac"))


def test_an_empty_file(tmp_path):
    with open(tmp_path / "e.dac", "wb") as f:
        token_codes.Writer(f).close()
    assert list(token_codes.Reader(str(tmp_path / "e.dac")).documents()) == []


def whole(vocab, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocab)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_tables_against_the_tokenizer(spark, vocab):
    rows = [(5, "one two", "x"), (3, None, "x"), (5, "one two", "x"), (9, "", "x"), (None, "null id", "x"), (4, "Grüße 漢字 \n" * 4000, "x"),
            (-7, "negative", "x"), (5, "another", "x")]
    manifest = token_codes.write_token_files(spark.createDataFrame(rows, DOCS).repartition(3), vocab, scratch_path(spark, "t"))
    got = sorted(token_codes.read_token_files(manifest, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -7, 3, 4, 5, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    by_text = sorted((r.doc_id or 0, list(r.ids)) for r in got)
    assert by_text == sorted((i or 0, ids) for (i, _, _), ids in zip(rows, whole(vocab, [t for _, t, _ in rows]), strict=True))
    assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in got)
    flat = [x for r in got for x in r.ids]
    places = spark.createDataFrame([(p,) for p in [0, 1, 1, 7, len(flat) - 1, len(flat), -1, None]], "place long")
    found = sorted(map(tuple, token_codes.tokens_at(manifest, places).collect()))
    assert found == sorted((p, flat[p]) for p in [0, 1, 1, 7, len(flat) - 1])


def test_files_end_at_their_bounds(spark, vocab, monkeypatch):
    df = spark.createDataFrame([(i, "a b c d " * (i % 5)) for i in range(200)], "doc_id long, text string")
    one = token_codes.write_token_files(df, vocab, scratch_path(spark, "t"))
    monkeypatch.setattr(token_codes, "FILE_DOCS", 7)
    many = token_codes.write_token_files(df, vocab, scratch_path(spark, "t"))
    assert many.count() > one.count()
    assert sorted(token_codes.read_token_files(one).collect()) == sorted(token_codes.read_token_files(many).collect())


def test_no_rows(spark, vocab):
    manifest = token_codes.write_token_files(spark.createDataFrame([], DOCS), vocab, scratch_path(spark, "t"))
    assert token_codes.read_token_files(manifest).count() == 0
    assert token_codes.tokens_at(manifest, spark.range(3).toDF("place")).count() == 0


def test_query_against_the_tokenizer(spark, vocab):
    sf = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    want, at = [], 0
    for (i, _), ids in zip(docs, whole(vocab, [t for _, t in docs]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, queries.op11_token_codes(spark, sf).collect())) == want


def test_small_files_are_listed_and_read_together(spark, vocab, monkeypatch):
    df = spark.createDataFrame([(i, "a b c d " * (i % 5)) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(token_codes, "FILE_DOCS", 7)
    manifest = token_codes.write_token_files(df, vocab, scratch_path(spark, "t"))
    assert manifest.count() > 57 and len(manifest.inputFiles()) == 1
    few = token_codes.read_token_files(manifest)
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(token_codes, "SEGMENT", 200)
    some = token_codes.read_token_files(manifest)
    n_ids = manifest.agg({"n_ids": "sum"}).first()[0]
    sizes = manifest.repartition(some.rdd.getNumPartitions()).rdd.glom().map(len).collect()
    assert some.rdd.getNumPartitions() == -(-n_ids // 200) and max(sizes) - min(sizes) <= 1
    monkeypatch.setattr(token_codes, "SEGMENT", 1)
    assert token_codes.read_token_files(manifest).rdd.getNumPartitions() == manifest.count()
    monkeypatch.undo()
    want = [(i, len(ids)) for i, ids in enumerate(whole(vocab, ["a b c d " * (i % 5) for i in range(400)]))]
    got = sorted(few.collect())
    assert [(r.doc_id, r.n_tokens) for r in got] == want and got == sorted(some.collect())
    assert [r.start for r in got] == np.cumsum([0, *[n for _, n in want]])[:-1].tolist()
