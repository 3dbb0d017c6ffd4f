from pyspark.sql import functions as F

from lexispark.operators import infer


def test_nbest_with_batch_function(spark):
    def fake_model(sources, src_lang, tgt_lang):
        # 5 "beams": padded, repeated and empty outputs exercise strip/dedup/drop-empty
        return [[f" {s.upper()} ", s.upper(), "", f"{s}-{tgt_lang}", f"{s}-{tgt_lang}"] for s in sources]

    q = spark.createDataFrame(
        [("apple", "en_XX", "de_DE", 10.0), ("source", "en_XX", "de_DE", 1.0), ("  ", "en_XX", "de_DE", 1.0),
         (None, "en_XX", "de_DE", 1.0), ("pear", "en_XX", "nl_XX", 5.0)],
        "source string, src_lang string, tgt_lang string, volume double")
    out = infer.nbest_with(q, fake_model, k=5, batch_size=1)
    got = sorted((r.source, r.target, r.cand_rank, r.volume) for r in out.collect())
    assert got == [("apple", "APPLE", 1, 10.0), ("apple", "apple-de_DE", 4, 10.0),
                   ("pear", "PEAR", 1, 5.0), ("pear", "pear-nl_XX", 4, 5.0)]


def test_predict_with_batch_function(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, source string")
    out = infer.predict_with(d, lambda xs: [f" {x[::-1]} " for x in xs], batch_size=1)
    assert sorted((r.id, r.prediction) for r in out.collect()) == [(1, "b a"), (2, "c")]


def test_lexicon_predict_falls_back_to_source(spark):
    lex = spark.createDataFrame([("a", " x ", 2), ("a", "y", 1)], "source string, target string, cand_rank long")
    d = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r.source: r.prediction for r in infer.predict(d, lex).collect()}
    assert got == {"a": "y", "b": "b"}


def test_encode_fixed_length_pads_and_masks(spark):
    d = spark.createDataFrame([(0, "a b c d e", "x"), (1, "", "y y")], "id long, input string, target string")
    vocab = infer.vocab_build(d)
    e = {r.id: r for r in infer.encode_fixed_length(d, vocab, "id", 4, 3, label_pad=-100).collect()}
    assert len(e[0].input_ids) == 4 and e[0].input_ids[-1] == infer.EOS_ID
    assert e[0].attention_mask == [1, 1, 1, 1]
    assert e[1].input_ids == [infer.EOS_ID, 0, 0, 0] and e[1].attention_mask == [1, 0, 0, 0]
    assert e[0].labels_ids[1:] == [infer.EOS_ID, -100]


def test_equal_queries_each_get_their_candidates_and_null_languages_go(spark):
    q = spark.createDataFrame(
        [("a", "en_XX", "de_DE", 1), ("a", "en_XX", "de_DE", 1), ("a", "en_XX", "nl_XX", 1), ("a", "en_XX", None, 1)],
        "source string, src_lang string, tgt_lang string, volume long")
    lex = spark.createDataFrame(
        [("a", "en_XX", "de_DE", " x ", 1), ("a", "en_XX", "de_DE", "y", 2), ("a", "en_XX", "de_DE", "x", 3),
         ("a", "en_XX", "nl_XX", "z", 1)], "source string, src_lang string, tgt_lang string, target string, cand_rank long")
    got = sorted((r.tgt_lang, r.target, r.cand_rank) for r in infer.nbest(q, lex).collect())
    assert got == [("de_DE", "x", 1), ("de_DE", "x", 1), ("de_DE", "y", 2), ("de_DE", "y", 2), ("nl_XX", "z", 1)]
    best = sorted((r.tgt_lang or "", r.prediction) for r in infer.predict(q, lex).collect())
    assert best == [("", "a"), ("de_DE", "x"), ("de_DE", "x"), ("nl_XX", "z")]


def test_encode_cuts_long_rows_before_the_join(spark):
    d = spark.createDataFrame([(0, "w " * 20_000, "x")], "id long, input string, target string")
    vocab = infer.vocab_build(d)
    e = infer.encode_fixed_length(d, vocab, "id", 16, 8).first()
    assert e.input_ids == [infer.N_SPECIAL] * 15 + [infer.EOS_ID]


def test_word_ids_by_sketch_and_shuffle(spark, monkeypatch):
    import random
    rng = random.Random(2)
    words = ["the"] * 700 + [f"w{rng.randrange(300)}" for _ in range(1300)] + ["unseen"] * 50 + [None] * 20
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word string").repartition(6)
    vocab = spark.createDataFrame([("the", 3), *[(f"w{i}", 4 + i) for i in range(290)]], "word string, token_id int")
    ids = {r["word"]: r.token_id for r in vocab.collect()}
    for few in (1, 2, 4096):
        monkeypatch.setattr(infer.heavy_words, "__defaults__", (few, 8192))
        found = [r["word"] for r in infer.heavy_words(d).collect()]
        assert len(found) <= few and found[0] == "the"
        got = {r.id: r.token_id for r in infer.word_ids(d, vocab).collect()}
        assert got == {i: None if w is None else ids.get(w, infer.UNK_ID) for i, w in enumerate(words)}


def test_a_word_of_most_tokens_is_in_no_single_task(spark):
    d = spark.range(4000).select("id", F.lit("hot").alias("word")).union(spark.range(100).select("id", F.col("id").cast("string")))
    vocab = spark.createDataFrame([("hot", 3)], "word string, token_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in infer.word_ids(d, vocab).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 4100 / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_encode_null_texts(spark):
    d = spark.createDataFrame([(0, None, "x"), (1, "x", None)], "id long, input string, target string")
    e = {r.id: r for r in infer.encode_fixed_length(d, infer.vocab_build(d), "id", 3, 2).collect()}
    assert e[0].input_ids == [infer.EOS_ID, 0, 0] and e[1].labels_ids == [infer.EOS_ID, 0] and e[0].labels_ids == [3, infer.EOS_ID]
