"""The fusion of text, declaration, suffix and host against plain Python, on rows whose evidence conflicts."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm.langid import answer, fused

LANGUAGES = ["de", "en", "es"]
K = len(LANGUAGES)


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain(rows, host_weight=5.0, strength=2.0):
    own = [softmax(r[1]) for r in rows]
    add = lambda which: [sum(own[i][k] for i in which) for k in range(K)]
    whole = [x + 1 for x in add(range(len(rows)))]
    overall = [x / sum(whole) for x in whole]
    having = defaultdict(list)
    for i, (_, _, declared, suffix, host, domain) in enumerate(rows):
        for key in (("declared", declared), ("suffix", suffix), ("host", host), ("domain", domain)):
            if key[1] is not None:
                having[key].append(i)
    out = {}
    for i, (id_, ll, declared, suffix, host, domain) in enumerate(rows):
        logs = list(ll)
        for key in (("declared", declared), ("suffix", suffix)):
            if key[1] is not None:
                logs = [x + math.log((n + 0.5) / (w + 0.5 * K)) for x, n, w in zip(logs, add(having[key]), whole)]
        prior = overall
        if host is not None:
            dn = add(having["domain", domain]) if domain is not None else None
            dp = [(n + strength * p) / (sum(dn) + strength) for n, p in zip(dn, overall)] if dn else overall
            less = [max(n - o, 0.0) for n, o in zip(add(having["host", host]), own[i])]
            prior = [(n + host_weight * p) / (sum(less) + host_weight) for n, p in zip(less, dp)]
        out[id_] = softmax([x + math.log(p) for x, p in zip(logs, prior)])
    return out


def made():
    rng = random.Random(3)
    ll = lambda k, sure: [0.0 if i == k else -sure for i in range(K)]
    rows = [(i, ll(0, 9.0), "de", "de", "a.x.de", "x.de") for i in range(12)]
    rows += [(20 + i, ll(1, 9.0), "en", "org", "b.y.org", "y.org") for i in range(12)]
    rows += [(40 + i, ll(2, 9.0), rng.choice(["es", None]), "org", f"c{i}.y.org", "y.org") for i in range(6)]
    rows += [
        (60, [0.0] * K, None, None, "a.x.de", "x.de"),  # nothing but the host
        (61, ll(1, 1.0), None, None, "a.x.de", "x.de"),  # weak text against the host
        (62, ll(1, 9.0), "de", "de", "a.x.de", "x.de"),  # clear text against all else
        (63, [0.0] * K, "es", "org", "b.y.org", "y.org"),  # declaration against host and suffix
        (64, [0.0] * K, None, None, "new.x.de", "x.de"),  # a new host of a known domain
        (65, [0.0] * K, None, None, None, None),
        (67, [0.0] * K, None, "org", "b.y.org", "y.org"),  # the same without declaration
        (66, ll(2, 2.0), "zz", "de", None, None),  # a declaration that only this row has
    ]
    return rows


def test_fusion_by_plain_sums(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id long, ll array<double>, declared string, suffix string, host string, domain string")
    got = {r.id: r.posterior for r in fused(df, LANGUAGES).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9)
    best = {i: LANGUAGES[p.index(max(p))] for i, p in got.items()}
    assert [best[i] for i in (60, 61, 62, 64, 67)] == ["de", "de", "en", "de", "en"]  # host and domain decide where the text doesn't
    assert got[63][2] > 3 * got[67][2]  # and a declaration weighs against them


def test_ties_take_the_first_language(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([1 / 3] * 3,)], "p array<double>")
    lang, p = answer(F.col("p"), LANGUAGES)
    assert [r.lang for r in df.select(lang.alias("lang"), p.alias("x")).collect()] == ["en", "de"]
