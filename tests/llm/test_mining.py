"""Toxicity, collocations and source divergence against plain Python, SQL and held-out labels, and on odd rows."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import collocations, divergence, queries, toxicity

DATA = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string"
ODD = [(1, None, "en", None), (2, "", None, "s"), (3, " \n\t .,;", "en", "s"), (4, "word", "en", "s"), (4, "word", "en", "s"), (None, "It's 'save é 日本 12³ a", None, None), (7, "ab a b " * 20_000, "de", "s"), (8, "x▁y  z\x1cq", "fr", "t"), (9, "b b b b! b b\x0bb", "en", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, COLUMNS)
    return rows.withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).withColumn("block", F.lit(2)).withColumn("score", F.lit("y")).withColumn("words", F.lit(None).cast("string"))


def made(n=120):
    rng = random.Random(4)
    few = ["a", "b", "A", "c.", "d,", "é", "日本", "it's", "b!b", "\n", "x-y", "f\tg", "12"]
    text = lambda: " ".join(rng.choice(few) for _ in range(rng.randint(0, 30)))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["s", "s", "s", "t", "u", None, ""])) for i in range(n)]
    return rows + rows[:20] + [(n + 1, None, "en", "only"), (n + 2, "...", "xx", "none")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, longest=5, most=2000):
    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        some = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(f[lang, q] >= a for q in some if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, most", [(3, 2000), (5, 7)])
def test_collocations_by_brute_force(spark, odd, least, most):
    rows = made()
    for df, plain in ((spark.createDataFrame(rows, COLUMNS), rows), (odd, ODD)):
        got = collocations.collocations(df, least, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(got.dtypes)["rank"] == "bigint"
        assert sorted(map(tuple, got.collect())) == plain_collocations(plain, least, most=most)
    assert collocations.collocations(odd.limit(0), least).count() == 0


def test_collocations_in_small_blocks(spark, monkeypatch):
    rows = made(60)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(map(tuple, collocations.collocations(df, 3, longest=3).collect())) == plain_collocations(rows, 3, 3)


def test_numbers_are_exact():
    words, tokens = collocations.numbered(["a b.a", None, "", "B\tc\x0cé"])
    assert [words[i].as_py() if i >= 0 else None for i in tokens.tolist()] == ["a", "b", None, "a", None, None, None, "b", "c", None, "é"]
    assert [x.tolist() for x in collocations.merged(np.array([1, 3, 9]), 2, np.array([2, 3, 5, 7]))] == [[0, 1], [1, 2]]


def plain_divergence(rows, least, most=50):
    terms, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        terms[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        keep = [t for t, k in docs[lang].items() if k >= least]
        v, count = len(keep), {s: terms[lang, s] for s in sources} | {None: sum((terms[lang, s] for s in sources), Counter())}
        total = {s: sum(c[t] for t in keep) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (total[s] + 5 * v) for t in keep} for s, c in count.items()}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in keep), o.encode()) for o in sources - {s})
            term = sorted((p[None][t] - p[s][t], t.encode()) for t in keep if count[s][t] and p[s][t] > p[None][t])[:most]
            out += [(lang, s, part, item.decode(), -x, i) for part, found in (("pair", pair), ("term", term)) for i, (x, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_divergence_by_brute_force(spark, odd, least):
    rows = made()
    for df, plain in ((spark.createDataFrame(rows, COLUMNS), rows), (odd, ODD)):
        got = divergence.divergence(df, least, most_terms=5)
        assert sorted(map(tuple, got.collect())) == plain_divergence(plain, least, 5)
    assert divergence.divergence(odd.limit(0), least).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def plain_features(text):
    words = re.findall(r"[a-z\u0080-\U0010ffff]+", lower(text))
    stems = {(n, w.encode()[:n]) for w in words for n in toxicity.STEMS if len(w.encode()) > n}
    pairs = {(w, x, g) for g in toxicity.GAPS for w, x in zip(words, words[g:])}
    return set(words) | stems | pairs


def test_features_and_stretches(monkeypatch):
    texts = ["You are an IDIOT, idiotic é日本 you", None, "", "a b", "x", " ".join(random.Random(2).choice(["ab", "cde", "fghijk", "é"]) for _ in range(3000))]
    cells = lambda some: [len(set(np.unique(toxicity.features([r])[1]).tolist())) for _, r in toxicity.stretches(some)]
    assert cells(texts[:5]) == [len(plain_features(t)) for t in texts[:5]]
    whole = set(toxicity.features([r for _, r in toxicity.stretches([texts[5]])])[1].tolist())
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    parts = [r for _, r in toxicity.stretches([texts[5]])]
    assert len(parts) > 50 and set().union(*(toxicity.features([p])[1].tolist() for p in parts)) == whole


def test_ftrl_by_plain_steps():
    rng = np.random.default_rng(1)
    rows, y = [np.unique(rng.integers(0, 30, rng.integers(0, 6))) for _ in range(40)], rng.integers(0, 2, 40).astype(float)
    ours = toxicity.Ftrl(0.3, 1.0, 0.2, 0.5).learn(rows, y, np.ones(40), 2, 7)
    z, n, bias, order = defaultdict(float), defaultdict(float), 1 << toxicity.BITS, np.random.default_rng(7)

    def weight(c):
        l1 = 0.0 if c == bias else 0.2
        return 0.0 if abs(z[c]) <= l1 else -(z[c] - math.copysign(l1, z[c])) / ((1.0 + math.sqrt(n[c])) / 0.3 + 0.5)

    for _ in range(2):
        for i in order.permutation(40):
            cells = [*rows[i].tolist(), bias]
            w = {c: weight(c) for c in cells}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for c in cells:
                sigma = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / 0.3
                z[c] += g - sigma * w[c]
                n[c] += g * g
    assert all(ours.weight(np.array([c]))[0] == pytest.approx(weight(c)) for c in [*range(30), bias])
    model = ours.model()
    assert set(model.cells.tolist()) == {c for c in range(30) if weight(c)} and model.bias == pytest.approx(weight(bias))


def test_toxicity_on_held_out_rows(spark, odd):
    rows = queries.op12_toxicity(spark, DATA).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.92
    assert all(y for p, y in held if p)

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    found = toxicity.toxicity_scores(odd, model, keep=("score", "lang")).collect()
    base = 1 / (1 + math.exp(-model.bias))
    assert len(found) == len(ODD) and all(r[2] == pytest.approx(base) for r in found if r.doc_id in (1, 2, 3))
    assert toxicity.toxicity_scores(odd.limit(0), model).count() == 0
    one = toxicity.trained(odd, spark.createDataFrame([(4, 0), (8, 0)], "doc_id long, toxic int"))
    assert not len(one.cells) and toxicity.toxicity_scores(odd, one).where("predicted = 1").count() == 0
