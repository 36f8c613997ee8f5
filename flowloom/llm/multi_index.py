"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

SUB = 8  # bits of a substring
AT_ONCE = 16  # lengths of vectors whose indexes stand in one plan


def rotations(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """n learned rotations: each turns the sample so that its coordinates lie near a corner of the cube."""
    rng, dim, out = np.random.default_rng(seed), sample.shape[1], []
    for _ in range(n):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(sample @ r).T @ sample)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, 1)


def codes_of(x: np.ndarray, turn: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ turn > 0, axis=1)


def as_words(codes: np.ndarray) -> np.ndarray:
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of each code of a to each of b."""
    a, b = as_words(a), as_words(b)
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


class MultiIndex:
    """For every substring of the codes, a table from its value to the rows that have it, as a row of bits."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.words = codes, as_words(codes)
        n, subs = codes.shape
        has = np.empty((subs, 256, -(-n // 8)), np.uint8)
        for j in range(subs):
            one = np.zeros((256, n), bool)
            one[codes[:, j], np.arange(n)] = True
            has[j] = np.packbits(one, axis=1)
        self.near = [has]  # near[t][j, value]: the rows whose substring j is at most t bits from value

    def probes(self, bits: int) -> np.ndarray:
        while len(self.near) <= bits:
            last = self.near[-1]
            wider = last.copy()
            for b in range(SUB):
                wider |= last[:, np.arange(256) ^ (1 << b)]
            self.near.append(wider)
        return self.near[bits]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is at most radius bits from the query's.

        With radius = m * t + a for m substrings, the first a + 1 are probed to
        t bits and the others to t - 1: a row beyond that in every substring
        differs in (a + 1)(t + 1) + (m - a - 1) t = radius + 1 bits at least, so
        the probes miss none.
        """
        m = self.codes.shape[1]
        t, a = divmod(min(radius, m * SUB), m)
        at = np.arange(m)
        hit = np.bitwise_or.reduce(self.probes(t)[at[: a + 1], query[: a + 1]], axis=0)
        if t:
            hit |= np.bitwise_or.reduce(self.probes(t - 1)[at[a + 1 :], query[a + 1 :]], axis=0)
        rows = np.flatnonzero(np.unpackbits(hit, count=len(self.codes)))
        far = np.bitwise_count(self.words[rows] ^ as_words(query[None])).sum(1, dtype=np.int64)
        return rows[far <= radius]


def search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, radius: int, turn: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float]]:
    """The k best of a block for each query, by inner product of those within the radius (widened until there are k)."""
    index, out = MultiIndex(codes_of(x, turn, mean)), []
    for v, i, code in zip(q, qid, codes_of(q, turn, mean)):
        reach = radius
        while True:
            rows = index.within(code, reach)
            rows = rows[xid[rows] != i]
            if len(rows) >= min(k, len(x) - int((xid == i).sum())):
                break
            reach += SUB
        score = (x[rows] * v).sum(1)
        best = np.lexsort((xid[rows], -score))[:k]
        out += zip([int(i)] * len(best), xid[rows][best].tolist(), score[best].tolist())
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, turns: int = 4, fit_rows: int = 4096, recall: float = 0.97, block: int = 4096, query_block: int = 1024, seed: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products found, ties to the smaller id.

    The rotations, and the radius that holds `recall` of the sample's own
    nearest neighbours, are fitted on at most fit_rows rows (those of smallest
    id hash); all rows are indexed, in blocks, and each block of queries meets
    each of them.  Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do null ids.  Vectors of each
    length have an index of their own and meet only their like; of more than 16
    lengths, 16 at a time are searched and written.  Of rows that repeat an id, the one of smallest vector counts.
    Fewer than k candidates are all returned; an empty table gives no rows.
    """

    def sound(df):
        df = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return df.where("id is not null and size(v) > 0").where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))

    rows, asked = kept(sound(vectors)), sound(queries)
    lengths = [r.dim for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(lengths) > AT_ONCE:
        asked = kept(asked)
    parts = []
    for at in range(0, len(lengths), AT_ONCE):
        some = [candidates(rows.where(F.size("v") == dim), asked.where(F.size("v") == dim), k, turns, fit_rows, recall, block, query_block, seed) for dim in lengths[at : at + AT_ONCE]]
        found = reduce(DataFrame.unionByName, some)
        parts.append(found if len(lengths) <= AT_ONCE else kept(found))
    found = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidates(rows: DataFrame, asked: DataFrame, k: int, turns: int, fit_rows: int, recall: float, block: int, query_block: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every block for each query, for vectors (id, v) of one length."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows).collect()
    x = np.array([r.v for r in sample])
    mean = x.mean(0)
    turn = rotations(x - mean, turns, seed=seed)
    some = x[:256]
    inner = some @ x.T
    inner[np.arange(len(some)), np.arange(len(some))] = -np.inf
    n, m = rows.count(), asked.count()
    top = np.argsort(-inner, 1)[:, : max(1, min(k, -(-k * len(x) // n)))]  # about as near as the k nearest of all n rows are
    code = codes_of(x, turn, mean)
    radius = int(np.quantile(np.take_along_axis(distances(code[:256], code), top, 1), recall)) if len(x) > 1 else turn.shape[1]
    rb, qb = max(1, -(-n // block)), max(1, -(-m // query_block))
    left = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    right = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))

    def block_search(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        return pd.DataFrame(search(np.stack(a["v"]), a["id"].to_numpy(), np.stack(b["v"]), b["id"].to_numpy(), k, radius, turn, mean), columns=["query_id", "vec_id", "score"])

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(block_search, "query_id long, vec_id long, score double")
