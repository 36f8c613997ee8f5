"""The ten operators and the pipeline against libraries, brute force and held-out labels, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import hmm, langid, lattice, minhash, multi_index, packing, quality, queries, substrings, token_counts, wfst
from flowloom.llm.common import components

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, "en", None), (2, "", None, "s"), (3, " \n\t ", "en", "s"), (4, "word", "en", "s"), (4, "word", "en", "s"), (None, "It's 'save <|endoftext|> é 日本 12³", None, None), (7, "ab " * 30_000, "de", "s"), (8, "x▁y  z", "fr", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(1)).withColumn("id", F.lit("x")).withColumn("piece", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def mixed(n=300):
    rng = random.Random(1)
    parts = ["'", "s", "ll", " ", "  ", "\n", "a", "Z", "1", "!", "é", "日", "'ve", "<|endoftext|>", "\t", " the", "ing", "😀", "▁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_sentencepiece(docs, odd):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), wfst.piece_model(path)
    some = [*mixed(), *texts_of(docs).values(), *[r[1] or "" for r in ODD]]
    want = library.encode(some, num_threads=1)
    assert [x.tolist() for x in ours.encode(some)] == want
    assert [ours.decode(x) for x in want] == [ours.decode_array(np.array(x, np.int32)) for x in want] == [library.decode(x) for x in want]
    assert wfst.round_trip(odd, path).count() == len(ODD)
    assert wfst.decoded(wfst.encoded(odd.where("doc_id = 4"), path), path).first().text == "word"
    assert wfst.encoded(odd.limit(0), path).count() == 0


def test_token_counts(docs, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    some = [*mixed(), *texts_of(docs).values(), *[r[1] or "" for r in ODD]]
    assert token_counts.count_tokens(token_counts.transducer(path), some).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    rows = token_counts.token_counts(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def test_quality(spark, odd):
    rows = queries.op2_quality(spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows.collect() if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y, _ in held]) > 0.9
    net = quality.ByteCnn()
    assert quality.quality_scores(odd, net).where("score between 0 and 1").count() == len(ODD)
    assert quality.quality_scores(odd.limit(0), net).count() == 0


def test_language(spark, odd):
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>der die und</p>'), (2, None, None), (None, "junk", ""), (2, None, None)], "page_id long, url string, html string")
    rows = langid.page_languages(pages, spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert len(rows) == 4 and [r.lang for r in rows if r.page_id == 1] == ["de"]
    assert langid.document_languages(odd).count() == len(ODD)
    real = langid.document_languages(spark.read.parquet(f"{DATA}/documents.parquet"), keep=("lang",))
    assert real.where("found = lang").count() > 0.98 * real.count()
    assert langid.page_languages(pages.limit(0), odd.limit(0)).count() == 0


def test_near_duplicates(docs, odd):
    sets = {i: frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if (w := words(t)) else frozenset() for i, t in texts_of(docs).items()}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and top(a) != top(b):
                group[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, size=4).collect()}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].component_id == top(i) and got[i].kept == (top(i) == i) for i in ids)
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and [r.n_shingles for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_blocks_of_buckets(spark):
    """Chains of texts that only their neighbours link, in small blocks; an id of two texts; ids and texts that repeat."""
    rng = random.Random(2)
    rows = []
    for f in range(3):
        text = [f"f{f}w{i}" for i in range(60)]
        for k in range(40):
            text[rng.randrange(60)] = f"n{f}x{k}"
            text[rng.randrange(60)] = f"m{f}x{k}"
            rows.append((1000 * f + 7 * k % 41, " ".join(text)))
    rows += [(1, rows[3][1] + " more"), (5, "quite another text"), (9, "QUITE another  text"), (9, "QUITE another  text"), (None, "quite another text")]
    sets = [frozenset(words(t)) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(i for (i, _), h in zip(rows, group) if h == g and i is not None) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1))
    got = minhash.near_duplicates(df, size=1, block=300).collect()
    want = Counter((i, least[g], i == least[g]) for (i, _), g in zip(rows, group))
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == want
    assert len({(r.doc_id, r.mark) for r in got if r.stays and r.doc_id is not None}) == len(set(group))


def test_long_runs_are_read_in_linear_time():
    import time

    begin = time.time()
    substrings.Parts(["." * 1_000_000, "a b. " * 100_000], "part", 4)
    for page in ("<!--" * 200_000, "<script " * 100_000, "<" * 1_000_000):
        langid.HIDDEN.sub(" ", page)
    assert time.time() - begin < 20


def test_repeated_lines(spark):
    rows = spark.createDataFrame([(1, "one\ntwo\n\nthree"), (2, "two\nfour\ntwo\nFour"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup_substrings(rows, least_words=1, unit="line", short=1).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["one\ntwo\n\nthree", "four\n", None]
    assert [(s.start, s.length) for s in got[2].removed] == [(0, 4), (9, 8)]


def test_rounds_of_unequal_shares():
    """Every token against a queue by queue simulation, and shares of 1e9 to 1."""
    for tokens, credits in (([1000, 300, 7], [40000, 12000, 100]), ([500, 900], [300000, 65536]), ([20, 5000], [1, 4096 << 16])):
        rounds, out, served, r = packing.Rounds(tokens, credits, 16), [], [0] * len(tokens), 0
        while len(out) < sum(tokens):
            r += 1
            for k, n in enumerate(tokens):
                to = min(n, (r * credits[k]) >> 16)
                out += [(k, x) for x in range(served[k], to)]
                served[k] = to
        place = {z: i for i, z in enumerate(out)}
        for k, n in enumerate(tokens):
            for x in range(0, n, 37):
                many = min(37, n - x)
                doc, start, size, sequence, offset = rounds.pieces(np.array([k]), np.array([x]), np.array([many]))
                assert size.sum() == many and start.tolist() == [0, *np.cumsum(size)[:-1].tolist()]
                assert [place[k, x + i] for i in range(many)] == [s * 16 + o + i for n_, s, o in zip(size, sequence, offset) for i in range(n_)]
    wide = packing.Rounds([10**9, 3000], [4096 << 16, 1], 4096)
    assert wide.pieces(np.array([1]), np.array([0]), np.array([3000]))[2].sum() == 3000


def test_classes_are_the_library_s():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    some = [f"x{chr(c)}'ll {chr(c)}1 {chr(c)}!" for c in (0x142C8, 0x13BB2, 0x16D4C, 0x105D7, 0x1CCF0, 0x378)]
    assert token_counts.count_tokens(token_counts.transducer(path), some).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(some)]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {2: 1, 3: 1, 9: 1, 21: 20}


def test_substrings(spark, odd):
    passage = " ".join(f"word{i}" for i in range(30)) + "."
    rows = spark.createDataFrame([(1, f"first line.\n{passage}\nend one"), (2, f"some other text.\n{passage.upper()}\nend two"), (3, f"a common line.\nmine {passage}")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup_substrings(rows).collect()}
    assert got[1].n_removed == 0 and got[2].text == "some other text.\nend two"
    span = got[2].removed[0]
    assert rows.where("doc_id = 2").first().text[span.start : span.start + span.length].strip() == passage.upper()
    rows = substrings.dedup_substrings(odd).collect()
    assert len(rows) == len(ODD) and {r.text for r in rows if r.doc_id == 1} == {None}
    assert substrings.dedup_substrings(odd.limit(0)).count() == 0


def test_passages_inside_sentences(spark):
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passages = [some(60) for _ in range(40)]
    rows = [(i, f"{some(9)} {passages[i % 40]} {some(9)}") for i in range(80)] + [(100 + i, some(80)) for i in range(20)]
    got = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows if i < 40 or i >= 100)
    for i, text in rows[40:80]:
        span = got[i].removed[0]
        assert len(got[i].removed) == 1 and text[span.start : span.start + span.length].strip() in passages[i - 40] and span.words >= 20
        assert got[i].text.startswith(" ".join(text.split()[:9])) and got[i].text.endswith(" ".join(text.split()[-9:]))


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 16))
    x[30:50] = x[:20] + rng.standard_normal((20, 16)) * 0.08
    x[50:] = x[5]
    label = [i % 2 for i in range(30)] + [i % 2 for i in range(20)] + [1] * 10
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [None] + [1.0] * 15, 1), (103, [float("nan")] * 16, 1), (104, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.98 - 1e-12) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(60, dtype=bool)
    got = lattice.near_vectors(df, block=8).collect()
    assert len(got) == len(rows) and all(r.n_links == (links[r.vec_id].sum() if r.vec_id is not None and r.vec_id < 60 else 0) for r in got)
    group = list(range(60))
    for _ in range(60):  # the smallest vector reachable
        group = [min([group[i], *(group[j] for j in np.flatnonzero(links[i]))]) for i in range(60)]
    for r in got:
        if r.vec_id is not None:
            assert r.component_id == (group[r.vec_id] if r.vec_id < 60 else r.vec_id) and r.kept == (r.component_id == r.vec_id)
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_probes_miss_none():
    rng = np.random.default_rng(3)
    for n, bits in ((1, 8), (37, 20), (500, 64), (300, 256)):
        codes = np.packbits(rng.random((n, bits)) < 0.5, axis=1)
        codes[: n // 3] = codes[0]
        index = multi_index.MultiIndex(codes)
        for query in (codes[0], codes[-1], ~codes[n // 2], np.zeros_like(codes[0])):
            far = np.unpackbits(query ^ codes, axis=1).sum(1)
            for radius in (0, 1, 3, 7, bits // 4, bits // 2 - 1, bits // 2, bits - 1, bits + 9):
                assert index.within(query, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 32), (1040, [None] * 32), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, df.where("vec_id % 20 = 0"), k=10, block=300, query_block=20).collect()
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) == 10 and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hit += len({r.vec_id for r in mine} & set(np.argsort(-s)[:10].tolist()))
    assert hit / 450 >= 0.9 and len(got) == 450
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0
    mixed_ = spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 1.0]), (22, [2.0, 0.0]), (40, [1.0, 0.0, 1.0]), (41, [0.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    for at_once in (16, 1):  # more lengths than are searched at once
        monkeypatch.setattr(multi_index, "AT_ONCE", at_once)
        got = multi_index.nearest(mixed_, mixed_.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 21, 3.0), (20, 22, 2.0), (40, 41, 1.0)]


def test_scores(docs, odd):
    tokens = {i: [*words(t), None] for i, t in texts_of(docs).items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = hmm.lm_scores(docs).collect()
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.lm_scores(odd).count() == len(ODD) and hmm.lm_scores(odd.limit(0)).count() == 0


def test_scores_do_not_depend_on_pieces(docs):
    one, many = ({r.doc_id: r.score for r in hmm.lm_scores(docs.repartition(n, "doc_id")).collect()} for n in (1, 8))
    assert all(many[i] == pytest.approx(one[i], rel=1e-3, abs=0.01) for i in one)


def test_scores_of_rare_words(spark):
    """Texts of two vocabularies of 30,000 words: words of one text tell the state of the other words there."""
    rng, rows = random.Random(3), []
    for i in range(600):
        rows.append((i, " ".join(f"{'ab'[i % 2]}{rng.randrange(30_000)}" for _ in range(300))))
    got = hmm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    known = sum(r.n_known for r in got)
    assert (sum(r.score for r in got) - sum(r.base_score for r in got)) / known > 0.12


def test_forward_recursion():
    model = hmm.Hmm(3, 6)
    flow, sizes = np.array([0, 2, 4, 1, 3]), np.array([2, 3])
    for k, (a, b) in enumerate(((0, 2), (2, 5))):
        alpha = model.start * model.emit[flow[a]]
        for s in flow[a + 1 : b]:
            alpha = (alpha @ model.move) * model.emit[s]
        assert model.walk(flow, sizes)[k] == pytest.approx(math.log10(alpha.sum()), rel=1e-5)


def packed(rows, whole):
    place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for a, b in zip(place, place[1:]):
        assert (b.offset == 0 and a.offset + a.length == 4096) if b.sequence_id != a.sequence_id else b.offset == a.offset + a.length
    by = {}
    for r in sorted(rows, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in whole.items():
        assert b"".join(bytes(r.ids) for r in by[i]) == ids and sum(r.length for r in by[i]) == by[i][0].doc_tokens


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    packed(packing.pack(docs, path).collect(), {i: ids(t) for i, t in texts_of(docs).items()})
    packed(packing.pack(odd.where("doc_id <> 4 or doc_id is null"), path).collect(), {r[0]: ids(r[1]) for r in ODD if r[0] != 4})
    assert packing.pack(odd.limit(0), path).count() == 0


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == corpus_pipeline.COLUMNS
        assert 0 < after.count() <= docs.count()
        assert stage(spark, odd, DATA).count() <= len(ODD)
    assert corpus_pipeline.run(spark, DATA).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_baum_welch_against_enumeration():
    """Expected counts of all state paths, one by one."""
    import itertools

    model = hmm.Hmm(2, 4, seed=3)
    flow, sizes = np.array([0, 2, 3, 1, 3, 2, 2, 0]), np.array([3, 1, 4])
    start, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    score = model.walk(flow, sizes, (start, moves, emits))
    want, at = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))], 0
    for k, n in enumerate(sizes.tolist()):
        seen, paths = flow[at : at + n], list(itertools.product(range(2), repeat=n))
        at += n
        p = [model.start[s[0]] * math.prod(model.emit[x, i] for x, i in zip(seen, s)) * math.prod(model.move[i, j] for i, j in zip(s, s[1:])) for s in paths]
        assert score[k] == pytest.approx(math.log10(sum(p)))
        for s, q in zip(paths, np.array(p) / sum(p)):
            want[0][s[0]] += q
            for i, j in zip(s, s[1:]):
                want[1][i, j] += q
            for x, i in zip(seen, s):
                want[2][x, i] += q
    for a, b in zip((start, moves, emits), want):
        assert a == pytest.approx(b)
