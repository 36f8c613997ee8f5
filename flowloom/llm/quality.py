"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SPAN = 64, 5  # a chunk is SPAN blocks and the next one begins SPAN - 1 blocks on, so neighbours overlap by a block


class ByteCnn:
    """Filters over byte windows, max-pooled by chunk; chunk maxima pooled over the document by mean, least and most."""

    def __init__(self, filters: int = 16, width: int = 5, dims: int = 8, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.width = width
        self.p = {"emb": rng.standard_normal((256, dims)).astype(np.float32), "conv": put(width * dims, filters), "bias": np.zeros(filters, np.float32), "w1": put(3 * filters, hidden), "b1": np.zeros(hidden, np.float32), "w2": put(hidden, 1), "b2": np.zeros(1, np.float32)}

    def tables(self) -> np.ndarray:
        """One row of filter sums for each place in the window and each byte."""
        dims = self.p["emb"].shape[1]
        return np.stack([self.p["emb"] @ self.p["conv"][o * dims : (o + 1) * dims] for o in range(self.width)])

    def pad(self, data: bytes) -> np.ndarray:
        """The bytes between zeros: whole blocks, and room for the last window."""
        n = max(1, -(-len(data) // BLOCK)) * BLOCK
        out = np.zeros(n + self.width - 1, np.uint8)
        out[: len(data)] = np.frombuffer(data, np.uint8)
        return out

    def blocks(self, x: np.ndarray, tables: np.ndarray, where: bool = False):
        """The filters' maxima in each block of one text, and where they are."""
        n, found, places = len(x) - self.width + 1, [], []
        for i in range(0, n, 256 * BLOCK):  # a long text goes by in pieces
            m = min(256 * BLOCK, n - i)
            act = tables[0][x[i : i + m]]
            for o in range(1, self.width):
                act += tables[o][x[i + o : i + o + m]]
            act = act.reshape(m // BLOCK, BLOCK, -1)
            found.append(act.max(1))
            if where:
                places.append(act.argmax(1) + i + np.arange(m // BLOCK)[:, None] * BLOCK)
        return np.concatenate(found), np.concatenate(places) if where else None

    def chunks(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that holds each chunk's maximum, and that maximum after the rectifier's bias."""
        n, hop = len(blocks), SPAN - 1
        begin = np.arange(0, max(1, n - 1), hop)
        at = np.minimum(begin[:, None] + np.arange(SPAN), n - 1)
        best = blocks[at].argmax(1)
        block = np.take_along_axis(at, best, 1)
        return block, np.tanh(np.take_along_axis(blocks, block, 0) + self.p["bias"])

    def pooled(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = h.argmin(0), h.argmax(0)
        f = np.arange(h.shape[1])
        return np.concatenate([h.mean(0), h[low, f], h[high, f]]), low, high

    def head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(z @ self.p["w1"] + self.p["b1"])
        return a, 1 / (1 + np.exp(-np.clip((a @ self.p["w2"] + self.p["b2"])[:, 0].astype(np.float64), -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        tables = self.tables()
        return self.head(np.stack([self.pooled(self.chunks(self.blocks(self.pad(t), tables)[0])[1])[0] for t in texts]))[1]

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> "ByteCnn":
        """Adam on the weighted log loss; the gradient of a maximum goes to the window that has it."""
        rng, x = np.random.default_rng(seed), [self.pad(t) for t in texts]
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        dims, nf = self.p["emb"].shape[1], self.p["bias"].shape[0]
        f = np.arange(nf)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                some, tables, seen = order[i : i + batch], self.tables(), []
                for d in some:
                    blocks, places = self.blocks(x[d], tables, True)
                    block, h = self.chunks(blocks)
                    z, low, high = self.pooled(h)
                    seen.append((x[d], np.take_along_axis(places, block, 0), h, z, low, high))
                z = np.stack([s[3] for s in seen])
                a, p = self.head(z)
                err = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)[:, None]
                da = err @ self.p["w2"].T * (1 - a * a)
                g = {"w2": a.T @ err, "b2": err.sum(0), "w1": z.T @ da, "b1": da.sum(0)}
                dz = da @ self.p["w1"].T
                gt, gb = np.zeros_like(tables), np.zeros(nf, np.float32)
                for (xd, place, h, _, low, high), d in zip(seen, dz):
                    dh = np.tile(d[:nf] / len(h), (len(h), 1))
                    dh[low, f] += d[nf : 2 * nf]
                    dh[high, f] += d[2 * nf :]
                    dh *= 1 - h * h
                    gb += dh.sum(0)
                    for o in range(self.width):
                        np.add.at(gt[o], (xd[place + o], np.broadcast_to(f, place.shape)), dh)
                g["bias"] = gb
                g["emb"] = sum(gt[o] @ self.p["conv"][o * dims : (o + 1) * dims].T for o in range(self.width))
                g["conv"] = np.concatenate([self.p["emb"].T @ gt[o] for o in range(self.width)])
                t += 1
                lr = rate * min(1, t / 20) * (1 - 0.9 * epoch / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = self.p[k] - (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def with_short(texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts, and the first words of each with its label: that a text is short says nothing."""
    rng = np.random.default_rng(seed)
    some = [t[:n] for t, n in zip(texts, rng.integers(8, 200, len(texts)))]
    cut = [t.rpartition(b" ")[0] or t for t in some]
    return texts + cut, np.r_[y, y], np.r_[weight, weight * 0.5]


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 900, most_bytes: int = 20_000, seed: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> ByteCnn:
    """A network learned from at most per_class labelled texts of each class, none over most_bytes.

    Texts whose crc32(id as text) mod folds is 0 are never learned from.  The
    sample is the smallest hashes of ids, so it doesn't depend on partitions;
    classes are weighted back to their share of the labelled rows.
    """
    marked = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y")).where(f"id is not null and y in (0, 1) and crc32(cast(id as string)) % {folds} <> 0").groupBy("id").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    ids = [marked.where(f"y = {y}").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(per_class) for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(f"octet_length(text) <= {most_bytes}").join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").collect()
    net = ByteCnn(seed=seed)
    if len({r.y for r in rows}) < 2:  # nothing to tell apart: the share of label 1, or 1 where nothing is labelled
        net.p["w2"][:] = 0
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
        net.p["b2"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    y = np.array([r.y for r in rows], np.float64)
    mean = {k: (y == k).mean() for k in (0, 1)}
    total = sum(counts.values())
    weight = np.where(y == 1, counts[1] / total / mean[1], counts[0] / total / mean[0])
    return net.fit(*with_short([r.text.encode() for r in rows], y, weight))


def quality_scores(docs: DataFrame, model: ByteCnn, threshold: float = 0.3, folds: int = 5, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted) and the columns in keep, a row for each row of docs.

    Scores read nothing but the text.  Null and empty texts are scored as a
    block of zero bytes; repeated rows and null ids give rows of their own (a
    null id is not held out).  Long texts are read whole, piece by piece.
    """

    def work(batches):
        for b in batches:
            for i in range(0, max(1, b.num_rows), 512):
                part = b.slice(i, 512)
                s = model.score([(t or "").encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in (0, *range(2, part.num_columns))), pa.array(s, pa.float64())], names=["_id", *[f"_k{j}" for j in range(len(keep))], "score"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"_k{j}") for j, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", score double"
    out = rows.mapInArrow(work, schema)
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % folds == 0, F.lit(False))
    return out.select(F.col("_id").alias(id_column), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_k{j}").alias(c) for j, c in enumerate(keep)])
