"""Embedding near-duplicates by lattice hashing: projections decoded to E8 points."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells_of, components, kept, scramble


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, and halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out, float)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum: where the rounded sum is odd, the worst-rounded place goes the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    off = (x - r)[odd]
    worst = np.abs(off).argmax(1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: of the integer points of even sum and of those moved by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class LatticeKeys:
    """Keys of the home cell and the nearest neighbouring cells, in several tables."""

    def __init__(self, dim: int, tables: int, cells: int, scale: float, seed: int):
        rng, self.cells, self.scale = np.random.default_rng(seed), cells, scale
        self.maps, self.near = [], minimal_vectors()
        for _ in range(tables):
            q = np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))[0][:dim, :8]
            self.maps.append((q * np.sqrt(max(dim, 8) / 8), rng.random(8)))
        self.odd = rng.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        keys = []
        for t, (q, shift) in enumerate(self.maps):
            x = unit @ q / self.scale + shift
            home = nearest_point(x)
            off = x - home
            far = (self.near**2).sum(1) - 2 * off @ self.near.T  # how much farther each neighbouring point is
            next_ = np.argpartition(far, self.cells - 1, 1)[:, : self.cells - 1] if self.cells > 1 else np.zeros((len(x), 0), int)
            points = np.concatenate([home[:, None], home[:, None] + self.near[next_]], 1)
            twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
            h = scramble((twice * self.odd).sum(2) + scramble(np.array([t], np.uint64)))
            keys.append(scramble(h ^ scramble(label.astype(np.int64).view(np.uint64))[:, None]))
        return np.concatenate(keys, 1).view(np.int64)


def compare(rows: pa.Table, threshold: float, key: int, blocks: tuple[int, int]) -> tuple[dict, list]:
    """Counts of links by vector, and a forest of them, for the pairs of two blocks of one cell whose smallest shared key this is."""
    vec = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(rows.num_rows, -1)
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(rows.num_rows, -1)
    ids, block, many = (rows.column(c).to_numpy() for c in ("id", "block", "copies"))
    one = np.flatnonzero(block == blocks[0])
    two = one if blocks[0] == blocks[1] else np.flatnonzero(block == blocks[1])
    count, parent, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for begin in range(0, len(one), 256):
        some = one[begin : begin + 256]
        i, j = np.nonzero(vec[some] @ vec[two].T >= threshold)
        i, j = some[i], two[j]
        if blocks[0] == blocks[1]:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            smallest = np.where((keys[a][:, :, None] == keys[b][:, None, :]).any(2), keys[a], np.iinfo(np.int64).max).min(1)
            a, b = a[smallest == key], b[smallest == key]
            np.add.at(count, a, many[b])
            np.add.at(count, b, many[a])
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    forest.append((max(x, y), min(x, y)))
    hit = np.flatnonzero(count)
    return dict(zip(ids[hit].tolist(), count[hit].tolist())), [(int(ids[a]), int(ids[b])) for a, b in forest]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = 5, cells: int = 4, scale: float = 0.3, block: int = 512, seed: int = 9, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Two vectors link when their labels are equal and not null and their cosine,
    in double precision, is at least threshold.  Candidates share a cell of a
    table: each vector is in its nearest E8 point's cell and in those of the
    cells - 1 next ones.  Null vectors, zero ones, empty ones and those with
    null or non-finite components link with nothing.  Equal vectors of a label
    are one class that counts its copies, and a cell of more than `block`
    classes is dealt out as pairs of blocks, whose tasks give back counts and a
    forest, never the pairs; a pair of several cells counts in one of them.
    Equal vectors are told by 128 bits of hashes.  Repeated rows are copies and give a row each; a null id's row has a null
    component and is never kept.  Only the three named columns are read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.col(label_column).cast("long").alias("label"))
    sound = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))  # 128 bits know a vector
    classes = kept(rows.where(sound).groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")))

    def keyed(batches):
        made = {}
        for b in batches:
            if not b.num_rows:
                continue
            lists, label = b.column(1), b.column(0).to_numpy()
            values, at = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                pick = np.flatnonzero(dims == dim)
                x = values[at[pick][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in made:
                    made[dim] = LatticeKeys(dim, tables, cells, scale, seed)
                keys = made[dim].of(x, label[pick] * 1_000_003 + dim)
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(pick)), b.column(3).take(pa.array(pick)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "copies", "unit", "keys", "cells"])

    found = kept(classes.select("label", "v", "rep", "copies").mapInArrow(keyed, "id long, copies long, unit binary, keys binary, cells array<long>"))
    member = found.select("id", F.explode("cells").alias("key"))
    crowd = member.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = member.join(crowd, "key").join(found.drop("cells"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def linked(batches):
        for part in cells_of(batches):
            found = []
            for (key, lo, hi), pdf in part:
                counts, forest = compare(pdf, threshold, key, (lo, hi))
                found += [(i, None, n) for i, n in counts.items()] + [(a, b, 0) for a, b in forest]
            a, b, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    dealt = placed.select("key", "lo", "hi", "id", "copies", "unit", "keys", "block").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    links = kept(dealt.mapInArrow(linked, "a long, b long, n long"))
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    about = classes.join(counts, "rep", "left").join(group, "rep", "left").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("v").join(kept(about), ["label", "h1", "h2"], "left")  # written, so that Spark can split the join at a vector of many copies
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
