"""The quality network's scores against plain loops, and its first training step against numeric gradients."""

import numpy as np

from flowloom.llm.quality import BLOCK, SPAN, ByteCnn


def plain_score(p, width, text):
    n = max(1, -(-len(text) // BLOCK)) * BLOCK
    x = list(text) + [0] * (n - len(text) + width - 1)
    dims = p["emb"].shape[1]
    act = np.array([sum(p["emb"][x[i + o]] @ p["conv"][o * dims : (o + 1) * dims] for o in range(width)) for i in range(n)])
    blocks = n // BLOCK
    chunks = [act[b * BLOCK : min(b + SPAN, blocks) * BLOCK].max(0) for b in range(0, max(1, blocks - 1), SPAN - 1)]
    h = np.tanh(np.array(chunks) + p["bias"])
    a = np.tanh(np.concatenate([h.mean(0), h.min(0), h.max(0)]) @ p["w1"] + p["b1"])
    return 1 / (1 + np.exp(-(a @ p["w2"] + p["b2"])[0]))


TEXTS = [b"", b"a", b"plain words, and more of them. " * 3, bytes(range(256)) * 2, b"x" * 64, b"yz " * 100, "é日本 ".encode() * 40]


def test_scores_by_plain_loops():
    net = ByteCnn(filters=4, width=3, dims=3, hidden=5, seed=2)
    assert np.allclose(net.score(TEXTS), [plain_score(net.p, 3, t) for t in TEXTS], atol=1e-5)


def test_first_step_goes_against_the_gradient():
    y, weight = np.array([0, 1, 0, 1, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 1, 1, 3.0])

    def loss(p):
        s = np.array([plain_score(p, 3, t) for t in TEXTS])
        return -np.mean(weight * np.log(np.where(y == 1, s, 1 - s)))

    start = {k: v.astype(np.float64) for k, v in ByteCnn(filters=3, width=3, dims=2, hidden=4, seed=2).p.items()}
    net = ByteCnn(filters=3, width=3, dims=2, hidden=4, seed=2).fit(TEXTS, y, weight, epochs=1, batch=len(TEXTS))
    rng, seen = np.random.default_rng(0), 0
    for k, v in start.items():
        for i in rng.permutation(v.size)[:40]:
            at = np.unravel_index(i, v.shape)
            sides = []
            for step in (1e-5, -1e-5):
                moved = {n: x.copy() for n, x in start.items()}
                moved[k][at] += step
                sides.append(loss(moved))
            g = (sides[0] - sides[1]) / 2e-5
            if abs(g) > 1e-4:  # the first step of Adam has the gradient's sign and one size
                seen += 1
                assert np.sign(start[k][at] - net.p[k][at]) == np.sign(g), (k, at)
    assert seen > 40
