"""What the operators share: reading tables, tables written in the shared folder, linked groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scramble(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z are lower-cased
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_NEXT_GAP = re.compile(rb"[ \t-\r]").search


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64)])


LONG = 4_000_000  # bytes hashed at once


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all the texts' words in order, and where each text's words begin (one more than texts).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z
    lower-cased.  A hash sums a random number for each byte times a power of
    its place; it depends on nothing but the word.  A text of more than LONG
    bytes goes by in stretches cut between words.
    """
    raw = [t.encode() if t else b"" for t in texts]
    if len(raw) == 1 and len(raw[0]) > LONG:
        parts, at = [], 0
        while at < len(raw[0]):
            gap = _NEXT_GAP(raw[0], at + LONG)
            end = gap.start() if gap else len(raw[0])
            parts.append(_hashed([raw[0][at:end]])[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    return _hashed(raw)


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, hashes, bounds = word_table(raw)
    return hashes, bounds


def word_table(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(data, first, size, hashes, bounds): the texts' bytes with a line end after each, and their words: where each begins and how long it is."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = _GAP[data]
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    bounds = np.searchsorted(first, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])
    if not len(first):
        return data, first, first, np.zeros(0, np.uint64), bounds
    inside = np.flatnonzero(~gap)
    size = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1 - first
    begin = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(begin, size)
    terms = _BYTE[data[inside]] * _powers(1 << int(size.max() - 1).bit_length())[place]
    return data, first, size, scramble(np.add.reduceat(terms, begin) + size.astype(np.uint64)), bounds


def groups_of(texts: list[str | None], most: int = 1_000_000):
    """(begin, end) of runs of texts whose lengths add up to at most `most`; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def cells_of(batches):
    """For each batch of rows sorted by cell, the cells that end in it: one that goes on is held for the next batch."""
    held = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key, lo, hi = (rows.column(i).to_numpy() for i in range(3))
        cuts = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1]
        yield [((int(key[a]), int(lo[a]), int(hi[a])), rows.slice(a, z - a)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        held = rows.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield [(tuple(int(held.column(i)[0].as_py()) for i in range(3)), held)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, as in tests, one of our own where none is set."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_ = found.get() if found.isDefined() else None
    if not set_:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return set_.rstrip("/")


#: Spark's setting by which a job's shuffle files go when the job is over.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of rows that go to Python at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From here on the session hands rows to Python in batches of so many bytes, unless it has a bound of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, most)


def kept(df: DataFrame, codec: str = "zstd", batch: str | None = None) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends here and survives lost executors.

    As the rows are safe then, the job's shuffle files are freed at once.
    batch bounds the bytes of rows that go to Python at once while writing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    now = {FREE: "true"} | ({BATCH: batch} if batch else {})
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes kept tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable by links, for all linked nodes but the smallest themselves.

    Alternates large-star and small-star steps on the table of links, so no
    group of nodes is ever collected.  Each step's table is written out and the
    one before removed; the sides of the joins are written too, so that Spark
    can split the join at a node of very many links.
    """
    two = lambda df, x, y: df.select(F.col(x).alias("u"), F.col(y).alias("v"))
    edges = kept(two(links, a, b).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        # large star: greater neighbours move to the smallest of the neighbourhood
        low = kept(two(edges, "u", "v").unionByName(two(edges, "v", "u")).groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
        large = kept(two(edges, "v", "u").join(low, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(edges, low, large, least)
        edges = after
    else:
        raise RuntimeError("the linked groups have not settled")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.kept_at = edges.kept_at
    return out
