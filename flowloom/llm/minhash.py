"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells_of, components, dropped, groups_of, hashed_words, kept, scramble

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], size: int):
    """The set of 64-bit shingle hashes of each text, sorted."""
    for begin, end in groups_of(texts):
        words, bounds = hashed_words(texts[begin:end])
        whole = np.full(max(0, len(words) - size + 1), size, np.uint64)
        for i in range(size):
            whole = scramble(whole * MIX + words[i : i + len(whole)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
                continue
            short = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(a, b):
                short = scramble(short * MIX + words[i])
            yield short


def signatures(docs: DataFrame, size: int, bands: int, rows: int, bits: int, seed: int, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, n_shingles, digest, sig, bands): a hash of the text, the set's digest, the packed low bits of its minima, a key for each band."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, np.uint64)

    def work(batches):
        for b in batches:
            n, digest, sigs, keys = [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist(), size):
                n.append(len(s))
                if not len(s):
                    digest.append(None), sigs.append(None), keys.append(None)
                    continue
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = np.full(bands * rows, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 1000):
                    low = np.minimum(low, (odd[:, None] * s[i : i + 1000] + add[:, None]).min(1))
                mixed = scramble(low)
                sigs.append(np.packbits(((mixed[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()).tobytes())
                band = np.arange(bands, dtype=np.uint64)
                for j in range(rows):
                    band = scramble(band * MIX + low.reshape(bands, rows)[:, j])
                keys.append(band.view(np.int64))
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n_shingles", "digest", "sig", "bands"])

    return marked(docs, id_column, text_column).mapInArrow(work, "id long, mark long, n_shingles long, digest binary, sig binary, bands array<long>")


def marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, text): mark tells the texts of one id apart."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def low_bits(sigs: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The low bits of every minimum, a row for each signature."""
    flat = np.unpackbits(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1), axis=1)[:, : hashes * bits]
    return np.packbits(flat.reshape(len(sigs), hashes, bits), axis=2)[:, :, 0]


def least_equal(bits: int, hashes: int, threshold: float, spare: float) -> float:
    """How many equal b-bit minima a pair has at least whose similarity is not below the threshold by more than spare deviations.

    Two unequal minima agree on b low bits with chance 2**-b, so of m equal
    ones among k the similarity is (m/k - 2**-b) / (1 - 2**-b).
    """
    chance = 0.5**bits
    expect = chance + (1 - chance) * threshold
    return hashes * (expect - spare * np.sqrt(expect * (1 - expect) / hashes))


def likely(pairs: DataFrame, bits: int, hashes: int, threshold: float, spare: float) -> DataFrame:
    """The pairs (a, b, na, nb, sa, sb) whose packed signatures and set sizes leave the threshold possible."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            same = (low_bits(b.column(4).to_pylist(), bits, hashes) == low_bits(b.column(5).to_pylist(), bits, hashes)).sum(1)
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            keep = pa.array((same >= least_equal(bits, hashes, threshold, spare)) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(work, "a binary, b binary")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, share: int = 256) -> DataFrame:
    """The pairs (lead, digest) whose whole shingle sets have 100 * intersection >= percent * union, as (a, b).

    A lead's partners are dealt out in shares of about `share`, and the lead's
    text goes to each, so no task holds all that one lead is held against.
    """

    def check(batches):
        lead, own = None, None
        for rows in batches:
            for i in range(0, rows.num_rows, 200):
                b = rows.slice(i, 200)
                found = []
                for x, y, first, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), shingle_sets(b.column(4).to_pylist(), size)):
                    if first:  # the lead's own row comes before its partners
                        lead, own = x, s
                        continue
                    if x != lead:
                        raise ValueError("a partner without its lead")
                    at = np.searchsorted(own, s)
                    both = int((own[np.minimum(at, len(own) - 1)] == s).sum()) if len(own) else 0
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((x, y))
                a, c = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["a", "b"])

    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    partners = pairs.join(shares, "a").select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), "shares").cast("int").alias("salt"), F.col("b").alias("digest"), F.lit(False).alias("first"))
    leads = shares.select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.col("a").alias("digest"), F.lit(True).alias("first"))
    dealt = partners.unionByName(leads).join(texts, "digest").select("lead", "salt", "digest", "first", "text")
    return dealt.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("first")).mapInArrow(check, "a binary, b binary")


def cells(rest: DataFrame, block: int) -> DataFrame:
    """(key, lo, hi, block, digest, component): each bucket's classes (key, digest, component, n) dealt out as pairs of blocks.

    A block has about `block` shingles.  A group of more than that has blocks
    of its own, whose classes need no comparison with one another; the smaller
    ones share blocks.  Together the cells hold every pair of classes that are
    in one bucket and in different groups.
    """
    crowd = rest.groupBy("key", "component").agg(F.sum("n").alias("all"))
    own = F.col("all") >= block
    few = F.ceil(F.sum(F.when(~own, F.col("all"))).over(Window.partitionBy("key")) / block)
    crowd = kept(crowd.withColumn("alone", own).withColumn("blocks", F.when(own, F.ceil(F.col("all") / block)).otherwise(few)).drop("all"))
    placed = rest.join(crowd, ["key", "component"])
    spot = F.when(F.col("alone"), F.xxhash64("component", F.pmod(F.xxhash64("digest"), "blocks"))).otherwise(F.pmod(F.xxhash64("component"), "blocks"))
    placed = kept(placed.select("key", "digest", "component", spot.alias("block"), F.when(F.col("alone"), F.col("component")).alias("group")))
    blocks = placed.select("key", "block", "group").distinct()
    other = blocks.select("key", F.col("block").alias("to"), F.col("group").alias("other"))
    met = blocks.join(other, "key").where("not (group <=> other) or group is null").select("key", "block", F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi"))
    return placed.drop("group").join(met, ["key", "block"]).select("key", "lo", "hi", "block", "digest", "component")


CELL = "key long, lo long, hi long, block long, digest binary, component binary, n long, sig binary"


def mates(rows: pa.Table, cell: tuple[int, int], bits: int, hashes: int, threshold: float, spare: float, at_once: int = 64):
    """Pairs (i, several j) of the two blocks of a cell that are in different groups and may reach the threshold by signature and size."""
    block, n = rows.column("block").to_numpy(), rows.column("n").to_numpy()
    group = np.unique(np.array(rows.column("component").to_pylist(), dtype=object).astype("S16"), return_inverse=True)[1]
    low = low_bits(rows.column("sig").to_pylist(), bits, hashes)
    one, two = np.flatnonzero(block == cell[0]), np.flatnonzero(block == cell[1])
    least = least_equal(bits, hashes, threshold, spare)
    for begin in range(0, len(one), at_once):
        some = one[begin : begin + at_once]
        fits = (group[some][:, None] != group[two]) & (np.minimum(n[some][:, None], n[two]) >= threshold * np.maximum(n[some][:, None], n[two]) - 1e-9)
        if cell[0] == cell[1]:
            fits &= some[:, None] < two
        for i, row in zip(some.tolist(), fits):
            j = two[row]
            if len(j) and len(j := j[(low[j] == low[i]).sum(1) >= least]):
                yield i, j


def screened(dealt: DataFrame, bits: int, hashes: int, threshold: float, spare: float) -> DataFrame:
    """The rows of cells that have a mate in the cell, which no smaller key that both share would show too."""

    def work(batches):
        for part in cells_of(batches):
            for (key, lo, hi), rows in part:
                keys, need = None, set()
                for i, j in mates(rows, (lo, hi), bits, hashes, threshold, spare):
                    if keys is None:
                        keys = np.array(rows.column("bands").to_pylist(), np.int64)
                    smallest = np.where(keys[j] == keys[i], keys[j], np.iinfo(np.int64).max).min(1)
                    j = j[smallest == key]
                    if len(j):
                        need.update([i, *j.tolist()])
                if need:
                    yield from rows.drop_columns(["bands"]).take(pa.array(sorted(need))).to_batches()

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(work, CELL)


def compared(needed: DataFrame, texts: DataFrame, size: int, percent: int, bits: int, hashes: int, spare: float) -> DataFrame:
    """Links (a, b) between groups, by the whole sets of the classes that were left; of each cell a forest only."""

    def linked(rows, cell):
        sets, root, forest = list(shingle_sets(rows.column("text").to_pylist(), size)), {}, []
        group = rows.column("component").to_pylist()
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        end = np.cumsum([len(s) for s in sets])
        begin, has = end - [len(s) for s in sets], np.zeros(int(column.max()) + 1, bool)

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in mates(rows, cell, bits, hashes, percent / 100, spare):
            j = [k for k in j.tolist() if top(group[k]) != top(group[i])]
            if not j:
                continue
            mine = column[begin[i] : end[i]]
            has[mine] = True
            both = np.array([np.count_nonzero(has[column[begin[k] : end[k]]]) for k in j])
            has[mine] = False
            union = len(sets[i]) + (end - begin)[j] - both
            for k in np.array(j)[100 * both >= percent * union].tolist():
                x, y = top(group[i]), top(group[k])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    forest.append((group[i], group[k]))
        return forest

    def work(batches):
        for part in cells_of(batches):
            forest = [x for (_, lo, hi), rows in part for x in linked(rows, (lo, hi))]
            a, b = zip(*forest) if forest else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = needed.join(texts, "digest").select("key", "lo", "hi", "block", "digest", "component", "n", "sig", "text")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(work, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, bits: int = 4, spare: float = 4.0, block: int = 400_000, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mark, n_shingles, component_id, kept, stays) for each row of docs.

    A text's set is its distinct shingles of `size` words (lower-cased A-Z,
    split at ASCII white space); with fewer words the whole sequence is one
    shingle; null, empty and blank texts have none and link with nothing.
    Texts link when 100 * intersection >= percent * union, confirmed on whole
    sets.  component_id is the smallest id reachable by links.  Texts of equal
    sets are one class, known by its digest, so copies are never paired.  In
    each band bucket every class is first held against one leader.  Classes of
    a bucket that are then still in different groups are screened by their
    packed signatures, in pairs of blocks inside tasks; only those that have a
    likely mate there are compared whole, and a task gives back a forest of
    links.  So no pair of a bucket is left out and none of a large group is
    written out.  A long text is one row of a task and is hashed in stretches.

    Repeated rows give repeated results; where an id repeats with other texts,
    each text is in the group of its own copies, and mark, a hash of the text,
    tells them apart; stays marks the smallest (id, mark) of a group, all texts
    without words and all rows of null id.  Rows of null id take their class's group and are never
    kept; a class without any id has a null group.  Sets that are equal though
    their texts are not are copies.  Only the two named columns are read.
    """
    base = kept(signatures(docs, size, bands, rows, bits, seed, id_column, text_column))
    about = F.first(F.struct("n_shingles", "sig", "bands")).alias("x")
    classes = kept(base.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("rep"), about).select("digest", "rep.*", F.col("x.n_shingles").alias("n"), "x.sig", "x.bands"))
    # two orders of classes for all buckets, so that classes that share buckets share leaders
    member = classes.select("digest", F.explode("bands").alias("key")).withColumn("o", F.xxhash64(F.pmod("key", F.lit(2)), "digest"))
    crowded = kept(member.groupBy("key").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "first"))
    buckets = kept(member.join(crowded, "key").select("key", "digest", (F.col("o") == F.col("first")).alias("leads")))
    held = kept(classes.join(buckets.select("digest").distinct(), "digest", "left_semi"))
    wanted = held.select("id", "mark", "digest")
    texts = kept(marked(docs, id_column, text_column).join(wanted, ["id", "mark"]).groupBy("id", "mark", "digest").agg(F.min("text").alias("text")).select("digest", "text"))
    leaders = buckets.where("leads").groupBy("key").agg(F.min("digest").alias("a"))
    stars = buckets.join(leaders, "key").where("digest <> a").select("a", F.col("digest").alias("b")).distinct()
    one, two = (held.select(F.col("digest").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    tried = kept(likely(stars.join(one, "a").join(two, "b"), bits, bands * rows, percent / 100, spare))
    links = kept(confirmed(tried, texts, size, percent))
    group = components(links)
    # what is still apart in a bucket
    placed = buckets.join(group, buckets["digest"] == group["node"], "left").select("key", "digest", F.coalesce("component", "digest").alias("component"))
    apart = kept(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    rest = kept(placed.join(apart, "key").join(held.select("digest", "n"), "digest"))
    dealt = cells(rest, block).join(held.select("digest", "n", "sig", "bands"), "digest")
    needed = kept(screened(dealt.select("key", "lo", "hi", "block", "digest", "component", "n", "sig", "bands"), bits, bands * rows, percent / 100, spare))
    joined = components(compared(needed, texts, size, percent, bits, bands * rows, spare))
    one = group.select(F.col("node").alias("digest"), F.col("component").alias("one"))
    two = joined.select(F.col("node").alias("component"), F.col("component").alias("two"))
    ids = classes.select("digest", F.struct("id", "mark").alias("rep")).join(one, "digest", "left").withColumn("component", F.coalesce("one", "digest"))
    ids = kept(ids.join(two, "component", "left").select("digest", "rep", F.coalesce("two", "component").alias("component")))
    smallest = kept(ids.groupBy("component").agg(F.min("rep").alias("lead")))
    named = kept(ids.join(smallest, "component").select("digest", "lead"))
    dropped(classes, crowded, buckets, held, texts, tried, links, apart, rest, needed, group, joined, ids, smallest)
    out = base.select("id", "mark", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("lead.id", "id")
    stays = F.col("id").isNull() | F.col("digest").isNull() | (F.struct("id", "mark") == F.col("lead"))
    return out.select(F.col("id").alias(id_column), "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), stays.alias("stays"))
