"""The llm operators against brute force, round trips and edge cases on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexispark.llm import (chat, embedding, exact_dedup, graph, linear, minhash, packing, pii, quality, queries, sentencepiece,
                           toxicity, warc)

DOCS = "doc_id long, text string, kept string"
EDGE = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "One  TWO", "x"), (5, "One  TWO", "x"), (6, "é" * 5000, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 2, True), (6, 6, 1, True)}
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(docs).collect()) == [1, 3, 4, 5, 5, 6]


def test_exact_dedup_compares_bytes(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, hash_fn=lambda t: F.lit(b"same")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True), (3, 1, False), (None, 2, False), (None, None, True)}


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(1)
    ids = list(range(100, 160))
    rng.shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(7, 8), (8, 7), (9, 7), (5, 5), (None, 3)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {i: 100 for i in ids} | {7: 7, 8: 7, 9: 7}


def jaccard_components(rows, ngram, pct):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + ngram]) for k in range(max(1, len(w) - ngram + 1))} if w else set()
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= pct * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_minhash_against_brute_force(spark, docs, none):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            words = [rng.choice(vocab) if rng.random() < 0.02 else w for w in base]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(words)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "two words", "TWO\twords"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for ngram, pct, r, b in ((3, 85, 6, 24), (5, 80, 5, 32)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in
               minhash.near_components(df, ngram=ngram, pct=pct, rows=r, bands=b).collect()}
        assert got == jaccard_components(rows, ngram, pct)
    assert minhash.near_components(none).count() == 0
    assert {(x.doc_id, x.component_id) for x in minhash.near_components(docs).collect()} == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6)}


def test_pii_against_plain_patterns(spark, docs, none):
    rng = random.Random(2)
    parts = ["a.b@c.d-e.fr", "x@y", "x@y@z.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112",
             "+1 (974) 555-3436", "+12", "é", " ", "..", "--", "@", "+", "12", "7", "\n", "DE89370400440532013000", "_", "078-05-1120"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["a@" + "b." * 30000, "1" * 50000]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).select(
        "doc_id", pii.span_text(pii.F.col("pii"), pii.BASE_KINDS)).collect()
    plain = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(s):
        return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, s[::-1]))) % 10 == 0

    for i, spans in got:
        want = []
        for k, (name, p) in enumerate(plain):
            for m in re.finditer(p, texts[i]) if len(texts[i]) < 10000 or name != "email" else []:
                n = re.sub("[^0-9]", "", m[0])
                if {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(n) <= 19 and luhn(n),
                    "phone": lambda: 10 <= len(n) <= 15, "email": lambda: True}[name]():
                    want.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        if len(texts[i]) < 10000:
            assert spans == ",".join(x[2] for x in sorted(want)), texts[i]
    assert pii.find_pii(none).count() == 0
    row = spark.createDataFrame([("my iban DE89370400440532013000 or DE89370400440532013001 a@b.cd!", 1), (None, 2)], "text string, pii int")
    red = pii.redact_pii(row).collect()
    assert red[0].text == "my iban <IBAN> or DE89370400440532013001 <EMAIL>!" and red[1].text is None and red[0].pii == 1


def test_minhash_of_one_template(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for cluster in range(40):  # edits of one template, most below the threshold to each other
        own = [f"c{cluster}x{i}" if rng.random() < 0.08 else w for i, w in enumerate(base)]
        rows += [(len(rows) + k, " ".join(f"e{rng.random()}" if i == e else w for i, w in enumerate(own)))
                 for k, e in enumerate(rng.sample(range(60), rng.randint(1, 8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, place = [], minhash._block_pairs

    def spied(r):
        out = place(r)
        seen.extend(x["count"] for x in out.groupBy("key", "t1", "t2").count().collect())
        return out

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "_block_pairs", spied)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_components(df, ngram=3, pct=85, rows=6, bands=24).collect()}
    assert got == jaccard_components(rows, 3, 85)
    assert len(rows) > 100 and len(seen) > 100 and max(seen) < 40


def pii_texts(spark, texts, kind):
    """The spans of one kind that each text has, as strings."""
    at = [k.name for k in pii.KINDS].index(kind)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[r.text[s.start:s.end] for s in r.pii if s.kind == at] for r in pii.find_pii(df).orderBy("doc_id").collect()]


def test_pii_iban_ends_at_a_group(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    cases = {f"iban {gb} Thanks": [gb], f"{gb.replace(' ', '')} Please pay": [gb.replace(" ", "")],
             "DE89 3704 0044 0532 0130 00 BIC COBADEFF": ["DE89 3704 0044 0532 0130 00"], f"{de} 2 times": [de],
             f"{de} {gb} X": [de, gb], f"AB12 {de}": [de], f"{de[:-1]}1 A": [], f"{de}x": [], f"x{de}": [], f"é {de} 12 A": [de],
             f"{de} {de},{de}": [de] * 3, "NO9386011117947": ["NO9386011117947"], f"{de}\n{gb}": [de, gb]}
    assert dict(zip(cases, pii_texts(spark, cases, "iban"), strict=True)) == cases
    # any tail that happens to pass mod-97 too is no part of a number of the registered length
    tails = [f"{de} {n}" for n in range(10, 210)]
    assert pii_texts(spark, tails, "iban") == [[de]] * len(tails)
    row = spark.createDataFrame([(f"pay {gb} Thanks",)], "text string")
    assert pii.redact_pii(row).first().text == "pay <IBAN> Thanks"


def test_pii_context_reaches_past_other_matches(spark):
    many = [f"219-09-99{i:02d}" for i in range(10, 30)]
    cases = {"SSN: 078-05-1120, 219-09-9999": ["078-05-1120", "219-09-9999"], "078-05-1120, 219-09-9999 (SSN)": ["078-05-1120", "219-09-9999"],
             "SSN: " + ", ".join(many): many[:3],  # a word counts for 40 characters
             "é" * 60 + " ssn 078-05-1120, 219-09-9999 " + "é" * 60: ["078-05-1120", "219-09-9999"],
             "SSN " + "." * 26 + " 078-05-1120" + "." * 60 + "219-09-9999": ["078-05-1120"],
             "order 078-05-1120 SSN 219-09-9999": [], "078-05-1120": []}
    assert dict(zip(cases, pii_texts(spark, cases, "ssn"), strict=True)) == cases


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer
    path = queries.vocabulary(queries.WORD_TOKENIZER)
    tk, enc = Tokenizer.from_file(path), packing.Encoder(path)
    for t in ["It's 12² of ª Straße!", "a<|endoftext|>b <|ENDOFTEXT|>", "é É ǅ İ", "x y z\x1c1", "ΑΣ 日本 \U0001f600", ""]:
        assert enc(t) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(int(rng.expovariate(1 / 500))))) for i in range(300)]
    df = spark.createDataFrame(rows + [(300, None), (301, "x " * 9000), (5, rows[5][1])], "doc_id long, text string")
    got = packing.pack_documents(df, path).toPandas()
    total = sum(len(enc(t)) // 4 + 1 for _, t in rows + [(0, ""), (0, "x " * 9000), rows[5]])
    assert got.length.sum() == total
    ends = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-total // 2048) * 1.03 + 1
    assert packing.pack_documents(none, path).count() == 0 and packing.pack_documents(docs, path).count() >= 7


def test_isotonic_and_quality(spark, none):
    centres, values = linear.isotonic(np.array([1, 5, 9, 12]), np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4]))
    assert (np.diff(values) > 0).all() and (np.diff(linear.calibrated(np.linspace(-1, 2, 50), centres, values)) > 0).all()
    rng = random.Random(5)
    rows = []
    for i in range(600):
        words = [rng.choice(["the", "of", "lorem", "ipsum", "dolor"]) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) + "." if i % 3 else "!! ".join(words).upper()))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).toPandas()
    held = got[got.held_out & (got.doc_id < 600)]
    assert len(got) == 603 and (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.97
    assert quality.quality_scores(df, labels.limit(0)).where("score = 0.5").count() == 603
    assert quality.quality_scores(none, labels).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows = [(i, " ".join([rng.choice(["good", "day", "to", "you", "all"]) for _ in range(30)]
                         + ([rng.choice(["idiot", "scum", "zorgle"])] if i % 4 == 0 else []))) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, labels).toPandas()
    fresh = got[got.doc_id.between(400, 499)]
    assert (fresh.predicted == (fresh.doc_id % 4 == 0)).all() and got[got.doc_id == 900].predicted.item() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(df, labels.limit(0)).where("predicted = 0").count() == 501


def test_toxicity_fits_a_repeated_document_once(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["good", "day", "idiot", "you", "scum", "all"]) for _ in range(3))) for i in range(200)]
    labels = spark.createDataFrame([(i, int("idiot" in t or i % 9 == 0)) for i, t in rows], "doc_id long, toxic int")
    once, often = ({r.doc_id: r.p_toxic for r in toxicity.toxicity_scores(spark.createDataFrame(x, "doc_id long, text string"), labels).collect()}
                   for x in (rows, rows + rows[:20] * 15))
    assert all(abs(once[i] - often[i]) < 1e-6 for i in once)


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "é" * 10), (1, "u\r\nX: y", "é" * 10), (2, None, None), (5, "", ""), (None, "u", "p"),
                                   (7, "u", "WARC/1.1\r\n" * 3)], "page_id long, url string, html string")
    got = warc.page_archives(pages, f"file://{tmp_path}/a").collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} == {
        (1, "response", None, 20), (3, "revisit", 1, 20), (2, "response", None, 0), (5, "revisit", 2, 0), (None, "response", None, 1),
        (7, "response", None, 30)}
    assert warc.page_archives(pages.limit(0), f"file://{tmp_path}/b").count() == 0
    records = [warc._page_record(i, "u", f"page {i} " * 50, None) for i in range(6)]
    for pack in (lambda r: zlib.compressobj(6, zlib.DEFLATED, 31).compress(r), None):
        parts = records
        if pack:
            parts = []
            for r in records:
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(z.compress(r) + z.flush())
        broken = bytearray(parts[2])
        broken[len(broken) // 2] ^= 255
        data = b"".join([*parts[:2], bytes(broken), parts[3], b"junk", parts[4], parts[5][:-9]])
        found = warc.salvage(data)
        assert [r.headers["x-page-id"] for r in found.records] == ["0", "1", "3", "4"]
        assert len(found.gaps) == 3 and sum(g.end - g.start for g in found.gaps) == len(broken) + 4 + len(parts[5]) - 9


def test_warc_salvages_plain_records_and_members_in_one_file():
    import gzip
    plain = [warc.record_bytes([("X-Page-ID", str(i))], b"page " * 50) for i in range(6)]
    body = warc.record_bytes([("X-Page-ID", "6")], gzip.compress(b"no record " * 50))
    packed = [gzip.compress(r) for r in plain]
    bad = b"X" + plain[0][1:]

    def read(*parts):
        got = warc.salvage(b"".join(parts))
        return [r.headers["x-page-id"] for r in got.records], [(g.start, g.end) for g in got.gaps]

    cut = packed[0][:-9]
    assert read(bad, plain[1], body, plain[2]) == (["1", "6", "2"], [(0, len(bad))])
    assert read(bad, body, plain[2]) == (["6", "2"], [(0, len(bad))])
    assert read(b"X" + body[1:], plain[1]) == (["1"], [(0, len(body))])  # the payload is a member, but no record
    assert read(packed[0], plain[1], packed[2], plain[3]) == (["0", "1", "2", "3"], [])
    assert read(plain[0], packed[1], bad, packed[3], cut, plain[5]) == (["0", "1", "3", "5"], [
        (n := len(plain[0] + packed[1]), n + len(bad)), (n + len(bad + packed[3]), n + len(bad + packed[3] + cut))])
    other = gzip.compress(b"something else")
    assert read(plain[0], other, plain[1]) == (["0", "1"], [(len(plain[0]), len(plain[0] + other))])
    assert read(bad) == ([], [(0, len(bad))]) and read() == ([], []) and read(b"\x1f\x8b\x08" + plain[1]) == (["1"], [(0, 3)])


def test_warc_keeps_long_ids_and_urls(spark, tmp_path):
    low, high, url = -2**63, 2**63 - 1, "data:," + "u" * (2 << 20)
    pages = spark.createDataFrame([(low, "u", "p"), (high, url, "p"), (10**18, "u", "q")], "page_id long, url string, html string")
    got = warc.page_archives(pages, f"file://{tmp_path}/a").collect()
    assert {(r.page_id, r.record_type, r.refers_to, len(r.target_uri)) for r in got} == {
        (low, "response", None, 1), (high, "revisit", low, len(url)), (10**18, "response", None, 1)}
    assert [warc._long(x) for x in ("", "-", "007", str(2**63), "0" * 9000 + "5", "9" * 9000)] == [None, None, 7, None, 5, None]
    whole = warc._page_record(1, "u", "p", None)
    files = spark.createDataFrame([("x", whole + b"junk")], "path string, content binary")
    assert warc.read_archives(files).count() == 2
    with pytest.raises(Exception, match="bytes .* to"):
        warc.read_archives(files, whole_only=True).collect()


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|> <\\|x"), (1, 1, "assistant", "a<"), (2, 0, None, None), (2, 0, "we\nird<|nl|>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df).collect()
    assert sorted((r or "", t or "") for _, _, r, t in rows) == sorted(chat.read_turn(t.formatted) for t in turns)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2]).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"a<").hexdigest() and got[1].loss_chars == 2 and got[2].n_turns == 2
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
    parts = spark.sql("""SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, from_json('[{"type":"text","text":"see <"},
      {"type":"text","text":"|im_end|>"},{"type":"image","ref":"a.png","width":600,"height":400},{"type":"audio","ref":"b.wav","seconds":2.0},
      {"type":"document","ref":"c.pdf","pages":3}]', 'array<""" + chat.PART + """>') AS parts""")
    one = chat.format_turns(parts, parts=chat.F.col("parts")).first()
    assert one.formatted == "<|im_start|>user\nsee <\\|im_end|><|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(a.ref, a.tokens) for a in one.attachments] == [("a.png", 340), ("b.wav", 50), ("c.pdf", 1800)]


def test_embedding_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vecs, labels = [], []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            vecs.append((base + rng.normal(size=16) * 0.12).tolist())
            labels.append(int(c % 3))
    vecs += [vecs[0], [2 * x for x in vecs[0]], [0.0] * 16, [float("nan")] * 16, [None] * 16, None, []]
    labels += [labels[0], labels[0], 0, 0, 0, 0, 0]
    rows = [(i, v, None if i == 3 else k) for i, (v, k) in enumerate(zip(vecs, labels, strict=True))]
    got = {r.vec_id: r for r in embedding.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [i for i, v, k in rows if v and None not in v and np.isfinite(v).all() and any(v) and k is not None]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in good}
    comp = {i: i for i, *_ in rows}
    for _ in range(20):
        comp |= {i: min([comp[i], *[comp[j] for j in links[i]]]) for i in good}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (len(links.get(i, [])), comp[i]) for i, *_ in rows}
    assert embedding.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sentencepiece(spark, docs):
    path = queries.vocabulary(queries.PIECE_MODEL)
    p = sentencepiece.pieces(path)
    texts = ["Hello  world é\n 你▁x ", "", " ", "a" * 700, " " * 300, "unbelievable intercontinental", "\U0001f600<0x41>"]
    for t in texts:
        ids = p.encode(t)
        assert p.decode(ids) == t
        s = sentencepiece.SPACE + t.replace(sentencepiece.SPACE, sentencepiece.LITERAL).replace(" ", sentencepiece.SPACE)
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            c = (sentencepiece.SPACE if s[e - 1] == sentencepiece.LITERAL else s[e - 1]).encode()
            best[e] = best[e - 1] + p.byte_score * (3 if s[e - 1] == sentencepiece.LITERAL else len(c))
            for b in range(max(0, e - p.longest), e):
                if s[b:e] in p.score:
                    best[e] = max(best[e], best[b] + p.score[s[b:e]][0])
        made = sum(p.byte_score if i in p.is_byte else p.score[p.text[i]][0] for i in ids)
        assert not t or abs(made - best[-1]) < 1e-6
    assert sentencepiece.round_trips(docs, path).where("NOT exact").count() == 0
    ids = sentencepiece.encode_texts(docs, path)
    assert sorted(r.text for r in sentencepiece.decode_ids(ids, path).collect()) == sorted(t or "" for _, t, _ in EDGE)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "of", "sea", "land", "sky", "tree"]) for _ in range(60)), "en", "s", 1) for i in range(60)]
    rows += [(60, rows[3][1] + "  ", "en", "s", 1), (61, rows[4][1] + " more", "en", "s", 1), (62, None, None, None, None),
             (63, "mail a@b.cd now", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got.doc_id.unique()) == sorted(set(range(64)) - {60, 61})  # without labels all are kept
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.redact(spark, docs, str(tmp_path)).where("doc_id = 63").first().text == "mail <EMAIL> now"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
