import pytest
from pyspark.sql import functions as F

from lexispark.operators import metrics as M
from lexispark.operators.meteor import meteor_stats, porter_stem
from lexispark.operators.ter import ter_counts

SCHEMA = "system string, id long, prediction string, target string"


def bleu(spark, pairs, engine="arrow"):
    rows = [("s", i, h, r) for i, (h, r) in enumerate(pairs)]
    return M.corpus_bleu(spark.createDataFrame(rows, SCHEMA), engine=engine).first()


def test_bleu_identical_is_100(spark):
    r = bleu(spark, [("the cat sat on the mat", "the cat sat on the mat")])
    assert r.bleu == pytest.approx(100.0)


def test_bleu_no_shared_word_is_zero(spark):
    assert bleu(spark, [("a b c d e", "v w x y z")]).bleu == 0.0


def test_bleu_short_hypothesis_is_zero(spark):
    assert bleu(spark, [("the cat", "the cat sat on the mat")]).bleu == 0.0


def test_bleu_known_value(spark):
    # 4 of 5 unigrams, 3/4, 2/3, 1/2; bp = 1 (equal length)
    r = bleu(spark, [("the cat sat on a", "the cat sat on the")])
    import math
    want = math.exp((math.log(80) + math.log(75) + math.log(200 / 3) + math.log(50)) / 4)
    assert r.bleu == pytest.approx(want)


def test_bleu_smoothing_and_brevity(spark):
    r = bleu(spark, [("a b c x", "a b c d e f")])
    import math
    # c = 3,2,1,0 ; t = 4,3,2,1 ; p4 smoothed 100/(2*1); bp = exp(1-6/4)
    p = [75.0, 200 / 3, 50.0, 50.0]
    want = math.exp(1 - 6 / 4) * math.exp(sum(math.log(x) for x in p) / 4)
    assert r.bleu == pytest.approx(want)


def test_bleu_engines_agree(spark):
    pairs = [("Hello, world. It's 3-4 o'clock!", "Hello world, it's 3-4 o'clock."),
             ("a a a a b", "a a b b b a"), ("x", "")]
    a, b = bleu(spark, pairs, "arrow"), bleu(spark, pairs, "native")
    assert [a[f"c{n}"] for n in range(1, 5)] == [b[f"c{n}"] for n in range(1, 5)]
    assert a.bleu == pytest.approx(b.bleu)


def test_bleu_all_systems_equal_per_system(spark):
    rows = [("A", 0, "a b c d", "a b c d"), ("A", 1, "e f g h", "e f x h"),
            ("B", 0, "a b", "a b c d"), ("B", 1, "p q r s t", "p q r s t")]
    d = spark.createDataFrame(rows, SCHEMA)
    together = {r.system: r.bleu for r in M.corpus_bleu(d).collect()}
    for s in ("A", "B"):
        alone = M.corpus_bleu(d.where(F.col("system") == s)).first().bleu
        assert together[s] == pytest.approx(alone)


def test_ter_kernel():
    assert ter_counts("a b c d e".split(), "a b c d e".split()) == (0, 5)
    assert ter_counts("d e a b c".split(), "a b c d e".split()) == (1, 5)
    assert ter_counts("x y".split(), []) == (2, 0)
    assert ter_counts([], "a b".split()) == (2, 2)
    assert ter_counts("a x c".split(), "a b c".split()) == (1, 3)


def test_corpus_ter(spark):
    rows = [("s", 0, "D E a b c", "a b c d e"), ("s", 1, "x y", "x z")]
    r = M.corpus_ter(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.edits, r.ref_words) == (2, 7)
    assert r.ter == pytest.approx(200 / 7)


def test_meteor_kernel():
    m, h, r, ch, s = meteor_stats("the cat sat".split(), "the cat sat".split())
    assert (m, ch) == (3, 1) and s == pytest.approx(1 - 0.5 * (1 / 3) ** 3)
    m, h, r, ch, s = meteor_stats("sat the cat".split(), "the cat sat".split())
    assert (m, ch) == (3, 2)
    assert meteor_stats("a b".split(), "c d".split())[4] == 0.0
    # stem stage: 'cats' ~ 'cat'
    assert meteor_stats("cats".split(), "cat".split())[0] == 1


def test_porter_examples():
    words = "caresses ponies ties caress cats feed agreed plastered motoring sing conflated " \
            "hopping falling relational conditional triplicate electrical adjustment".split()
    want = "caress poni ti caress cat feed agre plaster motor sing conflat " \
           "hop fall relat condit triplic electr adjust".split()
    assert [porter_stem(w) for w in words] == want


def test_mean_meteor_empty_group(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert M.mean_meteor(d).count() == 0


def test_comet_rollup(spark):
    rows = [("A", 0, 0.5), ("A", 1, 1.0), ("B", 0, 0.25)]
    d = spark.createDataFrame(rows, "system string, id long, comet_score_segment double")
    got = {(r.system, r.id): r.comet_score_system for r in M.comet_rollup(d).collect()}
    assert got == {("A", 0): 0.75, ("A", 1): 0.75, ("B", 0): 0.25}


def test_ter_of_a_long_shuffled_segment_ends_soon():
    import random
    import time

    from lexispark.operators.ter import ter_counts

    r = random.Random(3)
    ref = [f"w{i}" for i in range(200)]
    hyp = r.sample(ref, len(ref))
    start = time.monotonic()
    edits, n = ter_counts(hyp, ref)
    assert n == 200 and 0 < edits < 200 and time.monotonic() - start < 6
    moved = ref[50:58] + ref[:50] + ref[58:]
    assert ter_counts(moved, ref) == (1, 200)


def test_edit_distance_against_the_plain_recurrence():
    import random
    from lexispark.operators.ter import edit_distance
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        assert edit_distance(a, b) == row[-1]


def test_meteor_stages(spark):
    d = spark.createDataFrame([("s", 1, "a", "big dogs", "large dog", 0.1)], "system string, id long, source string, prediction string, target string, x double")
    sets = {"big": frozenset({"size"}), "large": frozenset({"size"})}
    assert M.meteor_segments(d, stages="exact").first().matches == 0
    assert M.meteor_segments(d).first().matches == 1
    assert M.meteor_segments(d, synonyms=sets).first().matches == 2
    assert M.mean_meteor(d, synonyms=sets).first().meteor_variant == "exact+stem+synonym"


def test_rollup_keeps_repeated_rows_and_null_systems(spark):
    rows = [("a", 1.0)] * 50 + [("a", 3.0)] * 50 + [(None, 2.0)] * 5
    out = M.comet_rollup(spark.createDataFrame(rows, "system string, comet_score_segment double")).collect()
    assert len(out) == 105 and all(r.comet_score_system == (2.0 if r.system else None) for r in out)


def plain_alignment(hyp, ref):
    """Distance and alignment from the whole table, diagonal moves first, then hypothesis words without partner."""
    n, m = len(hyp), len(ref)
    d = [[i + j if not i or not j else 0 for i in range(m + 1)] for j in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(1, m + 1):
            d[j][i] = min(d[j - 1][i] + 1, d[j][i - 1] + 1, d[j - 1][i - 1] + (hyp[j - 1] != ref[i - 1]))
    pairs, j, i = {}, n, m
    while j or i:
        if j and i and d[j][i] == d[j - 1][i - 1] + (hyp[j - 1] != ref[i - 1]):
            pairs[i - 1] = j - 1
            j, i = j - 1, i - 1
        elif j and d[j][i] == d[j - 1][i] + 1:
            j -= 1
        else:
            i -= 1
    return d[n][m], pairs


def test_ter_alignment_and_columns_against_the_whole_table():
    import random

    from lexispark.operators import ter
    rng = random.Random(8)
    for _ in range(300):
        hyp, ref = ([rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        lev = ter._Levenshtein(ref)
        states = lev.prefix_states(hyp)
        want, pairs = plain_alignment(hyp, ref)
        align, hyp_err, ref_err = ter._alignment(hyp, ref, lev, states)
        assert states[-1][2] == want and align == pairs
        assert hyp_err == [int(not any(q == j and hyp[j] == ref[p] for p, q in pairs.items())) for j in range(len(hyp))]
        for j in (0, len(hyp) // 2, len(hyp)):
            assert lev.column(states[j], j).tolist() == [lev.cell(states, i, j) for i in range(len(ref) + 1)]


def test_ter_by_suffix_columns_is_that_of_stepping_through(monkeypatch):
    import random

    from lexispark.operators import ter
    rng = random.Random(5)
    for _ in range(40):
        ref = rng.choices([f"w{i}" for i in range(rng.choice([4, 40]))], k=rng.randrange(1, 60))
        hyp = [w for w in rng.sample(ref, len(ref)) if rng.random() > 0.1]
        monkeypatch.setattr(ter, "FEW_WORDS", 0)
        a = ter.ter_counts(hyp, ref)
        monkeypatch.setattr(ter, "FEW_WORDS", 10**9)
        assert ter.ter_counts(hyp, ref) == a


def test_ter_of_a_very_long_segment_needs_little_memory():
    import tracemalloc

    from lexispark.operators.ter import ter_counts
    ref = [f"w{i}" for i in range(6000)]
    hyp = [f"x{i}" if i % 500 == 7 else w for i, w in enumerate(ref)]
    tracemalloc.start()
    assert ter_counts(hyp, ref) == (12, 6000)
    assert tracemalloc.get_traced_memory()[1] < 6000 * 6000 // 2
    tracemalloc.stop()
