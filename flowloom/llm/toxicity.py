"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, scramble, word_table
from .divergence import LETTERS

BITS = 20  # features fall into 2^BITS cells
STEMS = (4, 5, 6)  # a word also counts by its first letters
GAPS = (1, 2, 3)  # pairs of neighbours, and with one or two words left out between
STRETCH = 1_000_000  # bytes of a text whose features are made at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(texts: list[str | None]):
    """(text's number, bytes): letters in lower case and blanks; long texts in parts that share the words pairs reach over."""
    for i, t in enumerate(texts):
        raw = (t or "").encode().translate(LETTERS)
        at = 0
        while len(raw) - at > STRETCH:
            end = raw.find(b" ", at + STRETCH)
            if end < 0:
                break
            yield i, raw[at:end]
            at = end - len(b" ".join(raw[at:end].split()[-max(GAPS) :]))
            while at > 0 and raw[at - 1] != 32:
                at -= 1
        yield i, raw[at:]


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, cell) of all words, their stems, pairs of neighbours and skip-grams, in no order and with repeats."""
    data, first, size, h, bounds = word_table(raw)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
    who, keys = [text], [h]
    for n in STEMS:
        long_ = np.flatnonzero(size > n)
        start = first[long_]
        stem = np.zeros(len(long_), np.uint64)
        for k in range(n):
            stem = stem * np.uint64(257) + data[start + k]
        who.append(text[long_]), keys.append(scramble(stem ^ (_MIX >> np.uint64(n))))
    for gap in GAPS:
        same = np.flatnonzero(text[gap:] == text[:-gap]) if len(h) > gap else np.zeros(0, np.int64)
        who.append(text[same]), keys.append(scramble(h[same] * _MIX + h[same + gap] + np.uint64(gap)))
    return np.concatenate(who), (np.concatenate(keys) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Ftrl:
    """Sparse weights learned row by row: every coordinate has its own rate, and L1 keeps those at 0 that little speaks for."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias

    def weight(self, cells: np.ndarray) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        l1 = np.where(cells == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> "Ftrl":
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                cells = np.append(rows[i], 1 << BITS)
                w = self.weight(cells)
                g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]) * weight[i]
                n = self.n[cells]
                sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
                self.z[cells] += g - sigma * w
                self.n[cells] = n + g * g
        return self

    def model(self) -> "Weights":
        w = self.weight(np.arange((1 << BITS) + 1))
        cells = np.flatnonzero(w[:-1])
        return Weights(cells.astype(np.int32), w[cells].astype(np.float32), float(w[-1]))


class Weights:
    """The weights that are not 0 (at most 2^BITS) and the bias: what tasks get."""

    def __init__(self, cells: np.ndarray, values: np.ndarray, bias: float):
        self.cells, self.values, self.bias = cells, values, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text by the features that it has, each counted once."""
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.cells] = self.values
        total = np.full(len(texts), self.bias)
        for lo, hi in groups_of(texts):
            pairs = []
            some, raw = [], []
            for i, r in [*stretches(texts[lo:hi]), (None, b"")]:
                if raw and (i is None or sum(map(len, raw)) + len(r) > STRETCH):
                    who, cell = features(raw)
                    heavy = dense[cell] != 0
                    pairs.append(np.unique(np.array(some)[who[heavy]] << BITS | cell[heavy]))
                    some, raw = [], []
                some.append(i), raw.append(r)
            each = np.unique(np.concatenate(pairs))
            total[lo:hi] += np.bincount(each >> BITS, dense[each & ((1 << BITS) - 1)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, folds: int = 4, skip: int = 2, per_class: int = 4000, most_bytes: int = 20_000, epochs: int = 6, seed: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Weights:
    """Weights learned from at most per_class labelled texts of each class, none over most_bytes.

    Texts whose crc32(id as text) mod folds is skip are never learned from.
    The sample is the smallest hashes of ids, so it doesn't depend on
    partitions; features are made by tasks, and rows of cells come to the
    driver.  Classes are weighted back to their share of the labelled rows.
    An id with both labels counts as the greater one.
    """
    marked = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y")).where(f"id is not null and y in (0, 1) and crc32(cast(id as string)) % {folds} <> {skip}").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    ids = [marked.where(f"y = {y}").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(f"octet_length(text) <= {most_bytes}")
    chosen = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def work(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            who, cell = features([r for _, r in stretches(texts)])
            each = np.unique(who << BITS | cell)
            parts = np.split((each & ((1 << BITS) - 1)).astype("<i4"), np.searchsorted(each >> BITS, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "y", "cells"])

    rows = sorted(chosen.mapInArrow(work, "id long, y int, cells binary").collect(), key=lambda r: r.id)
    y = np.array([r.y for r in rows], np.float64)
    if len(set(y)) < 2:  # nothing to tell apart: the share of label 1
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    total = sum(counts.values())
    weight = np.where(y == 1, counts[1] / total / (y == 1).mean(), counts[0] / total / (y == 0).mean())
    return Ftrl().learn([np.frombuffer(r.cells, "<i4").astype(np.int64) for r in rows], y, weight, epochs, seed).model()


def toxicity_scores(docs: DataFrame, model: Weights, threshold: float = 0.3, folds: int = 4, skip: int = 2, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted) and the columns in keep, a row for each row of docs.

    Scores read nothing but the text: whether it has a feature, not how often.
    Words are runs of letters and of characters beyond ASCII, A-Z in lower
    case.  Null, empty and wordless texts score the bias alone; repeated rows
    and null ids give rows of their own (a null id is not held out); ties don't
    arise; an empty table gives no rows.  Long texts are read whole, in
    stretches that share the words which pairs reach over.
    """

    def work(batches):
        for b in batches:
            for i in range(0, max(1, b.num_rows), 512):
                part = b.slice(i, 512)
                s = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in (0, *range(2, part.num_columns))), pa.array(s, pa.float64())], names=["_id", *[f"_k{j}" for j in range(len(keep))], "score"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"_k{j}") for j, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", score double"
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % folds == skip, F.lit(False))
    out = rows.mapInArrow(work, schema)
    return out.select(F.col("_id").alias(id_column), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_k{j}").alias(c) for j, c in enumerate(keep)])
