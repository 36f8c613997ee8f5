"""The hidden Markov model against plain rounds in which every word has its own expected counts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import hmm


def plain_scores(texts: dict[int, str], states: int = 8, rounds: int = 3) -> dict[int, float]:
    """All texts in one piece, all words of training texts in one dictionary, in double precision."""
    words = {i: [*t.split(), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in words[i])
    number = {w: k for k, w in enumerate(count)}
    hashes = np.array([hmm.END if w is None else hmm.hashed_words([w])[0][0] for w in count])
    c, n, v = np.array(list(count.values())), sum(count.values()), len(count)
    n1, n2 = (c == 1).sum(), (c == 2).sum()
    cut = n1 / (n1 + 2 * n2)
    unknown, left = v * cut / n, (c - cut) / (c + 1)
    model = hmm.Hmm(states)
    model.move = np.full((states, states), 0.01 / states) + np.eye(states) * 0.99
    known = hmm.first_emissions(hashes & np.uint64(0xFFFFFFFF), c, states, 1) / n
    flow = {i: np.array([number.get(w, v) for w in ws]) for i, ws in words.items()}
    walk = lambda which, counts=None: model.walk(np.concatenate([flow[i] for i in which]), np.array([len(flow[i]) for i in which]), counts)
    for _ in range(rounds):
        model.emit = np.concatenate([known * (1 - unknown), np.full((1, states), unknown)])
        start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((v + 1, states))
        walk(train, (start, moves, emits))
        model.move, model.start = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), (start + 0.1) / (start + 0.1).sum()
        found = emits[:v]
        share = found.sum(0) / found.sum()
        known = (found + share) * left[:, None] / (left @ found + share * left.sum())
    model.emit = np.concatenate([known * (1 - unknown), np.full((1, states), unknown)])
    return dict(zip(texts, walk(list(texts))))


@pytest.mark.parametrize("bucket", [500_000, 700])
def test_every_word_has_its_own_counts(spark, monkeypatch, bucket):
    """Most words are seen once or twice, in texts of two kinds."""
    monkeypatch.setattr(hmm, "BUCKET", bucket)
    rng, texts = random.Random(5), {}
    for i in range(300):
        kind = "ab"[i % 2]
        texts[i] = " ".join(f"{kind}{rng.randrange(40)}" if rng.random() < 0.6 else f"{kind}rare{rng.randrange(9000)}" for _ in range(rng.randrange(1, 80)))
    want = plain_scores(texts)
    got = hmm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-3)
