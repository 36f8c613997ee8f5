"""Substring dedup against a plain version over all rows, ids with several texts included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.llm.substrings import Parts, dedup_substrings

WORDS = r"[^\x20\x09-\x0D]+"


def units_of(text, unit, short):
    """(begin, end, words) of the text's units in characters, in order."""
    if unit == "part":  # where cuts are is a matter of hashes; what follows from them is not
        p = Parts([text], unit, short)
        raw = text.encode()
        ends = [*p.begin[1:].tolist(), len(raw)]
        return [(len(raw[:a].decode()), len(raw[:b].decode()), re.findall(WORDS, raw[a:b].decode())) for a, b in zip(p.begin.tolist(), ends)]
    breaks = r"\n" if unit == "line" else r"\n[\x20\x09-\x0D]*\n"
    found = list(re.finditer(WORDS, text))
    groups = []
    for m in found:
        if groups and not re.search(breaks, text[groups[-1][-1].end() : m.start()]):
            groups[-1].append(m)
        else:
            groups.append([m])
    begins = [g[0].start() for g in groups]
    return [(b, e, [m[0] for m in g]) for g, b, e in zip(groups, begins, [*begins[1:], len(text)])]


def plain(rows, least_words, unit, short):
    key = lambda words: tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words)
    first, times = {}, {}
    for i, t in rows:
        for b, _, w in units_of(t, unit, short) if i is not None and t else []:
            if len(w) >= short:
                first[key(w)] = min(first.get(key(w), i), i)
    for i, t in rows:
        seen, out, spans = set(), [], []
        units = units_of(t, unit, short) if i is not None and t else []
        run = between = 0
        for b, e, w in [*units, (0, 0, ["."] * short)]:
            again = len(w) >= short and (b, e) != (0, 0) and (key(w) in seen or first[key(w)] < i)
            if again:
                start = start if run else b
                end, run, between = e, run + between + len(w), 0
            elif len(w) < short:
                between += len(w)
            else:
                if run >= least_words:
                    spans.append((start, end - start))
                run = between = 0
            seen.add(key(w))
        at = 0
        for b, n in spans:
            out.append(t[at:b])
            at = b + n
        yield i, None if t is None else "".join([*out, t[at:]]), spans


def made(n=80):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("aa Bb cé dd e. ff 日本 gg!".split()) for _ in range(rng.randint(1, 9)))
    lines = [line() for _ in range(25)]
    text = lambda: "".join(rng.choice(lines) + rng.choice([" ", "\n", "\n\n", "\n \n"]) for _ in range(rng.randint(0, 12)))
    rows = [(rng.randint(1, 50), text()) for _ in range(n)]
    return [*rows, *rows[:9], (None, rows[0][1]), (7, None), (8, "")]


@pytest.mark.parametrize("unit, least_words, short", [("line", 1, 1), ("line", 6, 3), ("paragraph", 4, 2), ("part", 8, 4)])
def test_by_brute_force(spark, unit, least_words, short):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit("x"))
    got = dedup_substrings(df, least_words, unit, short).collect()
    want = list(plain(rows, least_words, unit, short))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r.doc_id, r.text, [(s.start, s.length) for s in r.removed]) for r in got), key=order) == sorted(want, key=order)


def test_new_text_of_a_repeated_id_stays(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(1, p), (5, p), (5, q)]
    got = {(r.doc_id, r.n_removed, r.text) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (5, 0, q) in got and (1, 0, p) in got and all(n == 1 for i, n, t in got if i == 5 and t != q)
