"""Phrase collocation mining: vertical lists of positions, extended word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, groups_of, kept, scramble
from .hmm import packed, unpacked

BLOCK = 6_000_000  # characters of a block of texts of one language; a longer text is a block of its own
#: Bytes between words are spaces, bytes between pieces are line ends.
GAPS = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
BITS = 25  # of a filter by hash
PARTS = 256  # ranges of hashes whose counts are added up together
HELD = 4_000_000  # hashes that wait to be added up
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A block: its words and their hashes; how long the lists of its phrases are, and all lists one after the other; which words are where.
STATE = "block long, lang string, sizes binary, lists binary, words array<string>, codes array<long>, posted binary, posts binary"
NAMES = ("block", "lang", "sizes", "lists", "words", "codes", "posted", "posts")


def steps(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.int32(0)))


def unstepped(x) -> np.ndarray:
    return np.cumsum(unpacked(x, np.int32), dtype=np.int32)


def numbered(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The texts' distinct words, and the number of the word at each position; -1 stands between pieces."""
    data = b"\n".join((t or "").encode() for t in texts).lower().translate(GAPS).replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
    real = ~np.isin(names.to_numpy(zero_copy_only=False), ["", "\n"])
    number = np.where(real, np.cumsum(real) - 1, -1)
    empty = pc.index(names, "").as_py()
    return names.filter(pa.array(real)).cast(pa.string()), number[code[code != empty]].astype(np.int32)


def lists_of(key: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, list lengths, positions key by key) from positions in ascending order: each key's list ascends too."""
    order = np.argsort(key, kind="stable")
    distinct, n = np.unique(key, return_counts=True)
    return distinct, n, position[order]


def merged(position: np.ndarray, ahead: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two ascending lists: which of position have position + ahead in other, and where it is there."""
    at = np.searchsorted(other, position + ahead)
    hit = np.flatnonzero(at < len(other))
    hit = hit[other[at[hit]] == position[hit] + ahead]
    return hit, at[hit]


def blocks(docs: DataFrame) -> DataFrame:
    """The texts of one language in a batch as a block: its words, their counts n and each one's list of positions."""

    def work(batches):
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in groups_of(own, BLOCK):
                    words, tokens = numbered(own[lo:hi])
                    some = np.flatnonzero(tokens >= 0)
                    _, n, lists = lists_of(tokens[some], some.astype(np.int32))
                    columns = [pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (packed(n.astype(np.int32)), steps(lists)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "n", "sizes", "lists"])

    none = F.lit(None).cast("binary")
    rows = docs.mapInArrow(work, "lang string, words array<string>, n array<int>, sizes binary, lists binary")
    return rows.withColumns({"block": F.monotonically_increasing_id(), "codes": F.transform("words", lambda w: F.xxhash64(w)), "posted": none, "posts": none})


class Block:
    """A block's phrases of `length` words: their lists, hashes, and the words and postings to spell them with."""

    def __init__(self, b: pa.RecordBatch, i: int, length: int):
        self.length, self.lang = length, b.column("lang").slice(i, 1)
        self.n = unpacked(b.column("sizes")[i], np.int32).astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.lists = unstepped(b.column("lists")[i])
        self.codes = b.column("codes")[i].values.to_numpy().view(np.uint64)
        if length > 1:
            self.posts, self.posted = unstepped(b.column("posts")[i]), unpacked(b.column("posted")[i], np.int32)

    def word(self, k: int, which=slice(None)) -> np.ndarray:
        """The k-th word of each phrase, read where the phrase comes first."""
        return self.posted[np.searchsorted(self.posts, self.lists[self.begin[which]] + k)]

    def hashes(self) -> np.ndarray:
        """40 bits for each phrase, which depend on nothing but its words."""
        h = self.codes if self.length == 1 else self.codes[self.word(0)]
        for k in range(1, self.length):
            h = scramble(h * MIX + self.codes[self.word(k)])
        return h >> np.uint64(24)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def through(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    cell = cell_of(h)
    return np.flatnonzero(bits[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1))


def gathered(cells: DataFrame) -> np.ndarray:
    """A filter of 2^BITS bits as words of 64, from cells (h): a table of bounded size, whatever the corpus."""
    found = cells.groupBy(F.expr("h div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("mask")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return out.view(np.uint64)


def extended(state: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """The phrases of `length` words of blocks, from those of one word less.

    A phrase that the filter of frequent ones lets through has its list
    merge-joined with the postings of words at the position after it; only
    positions where the phrase without its first word is let through too are
    looked at.  Phrases let through wrongly do no harm: what they are extended
    to is rarer still, and its own count drops it.
    """

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i, length - 1)
                which = through(bits, x.hashes())
                own = x.n[which]
                phrase = np.repeat(np.arange(len(which)), own)
                position = x.lists[np.arange(len(phrase)) + np.repeat(x.begin[which] - np.cumsum(own) + own, own)]
                order = np.argsort(position)
                position, phrase = position[order], phrase[order]
                words, codes = b.column("words")[i].values, x.codes
                if length == 2:  # lists of single words are the postings
                    words, codes, posts, posted = words.take(pa.array(which)), codes[which], position, phrase.astype(np.int32)
                else:
                    posts, posted = x.posts, x.posted
                going, _ = merged(position, 1, position)
                hit, at = merged(position[going], length - 1, posts)
                hit = going[hit]
                _, n, lists = lists_of(phrase[hit] * np.int64(len(words) + 1) + posted[at], position[hit])
                blobs = [pa.array([x], pa.binary()) for x in (packed(n.astype(np.int32)), steps(lists), packed(posted), steps(posts))]
                columns = [b.column("block").slice(i, 1), x.lang, *blobs[:2], pa.array([words], pa.list_(pa.string())), pa.array([codes.view(np.int64)], pa.list_(pa.int64())), *blobs[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=list(NAMES))

    return state.select(*NAMES).mapInArrow(work, STATE)


def promising(state: DataFrame, length: int, least: int) -> np.ndarray:
    """A filter that lets all phrases through whose hash comes `least` times or more over all blocks.

    Blocks send sorted hashes and counts in PARTS packed rows, a few bytes a
    phrase; a task adds a range up with at most HELD hashes waiting.
    """

    def split(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i, length)
                h = x.hashes()
                order = np.argsort(h)
                h, n = h[order], x.n[order]
                cuts = np.searchsorted(h, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(32))
                rows = [(k, steps_of(p), packed(q.astype(np.uint32))) for k, (p, q) in enumerate(zip(np.split(h.astype(np.uint32), cuts), np.split(n, cuts))) if len(p)]
                part, hashes, counts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["part", "hashes", "counts"])

    def enough(held):
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([n for _, n in held]), len(h))

    def add(batches):
        now, held, size = None, [], 0
        for b in batches:
            for part, hashes, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if held and part != now:
                    yield found(held)
                    held, size = [], 0
                elif size > HELD:
                    held = [enough(held)]
                    size = 0
                now = part
                held.append((np.cumsum(unpacked(hashes, np.uint32), dtype=np.uint32), unpacked(counts, np.uint32)))
                size += len(held[-1][0])
        if held:
            yield found(held)

    def found(held):
        h, total = enough(held)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(cell_of(h[total >= least].astype(np.uint64))), pa.int64())], names=["h"])

    rows = state.select(*NAMES).mapInArrow(split, "part int, hashes binary, counts binary")
    return gathered(rows.repartition("part").sortWithinPartitions("part").mapInArrow(add, "h long"))


def steps_of(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint32(0)))


def spelled(state: DataFrame, length: int, bits: np.ndarray, least: int) -> DataFrame:
    """(lang, phrase, a, h): the phrases that come `least` times or more over all blocks, counted by their text.

    As in promising(), blocks send what the filter lets through in PARTS packed
    rows, and a task adds up one range of hashes after the other.
    """

    def split(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i, length)
                h = x.hashes()
                which = through(bits, h)
                which = which[np.argsort(h[which] >> np.uint64(32), kind="stable")]
                words = b.column("words")[i].values
                phrases = pc.binary_join_element_wise(*(words.take(pa.array(x.word(k, which))) for k in range(length)), " ")
                n, cells, part = x.n[which], cell_of(h[which]), (h[which] >> np.uint64(32)).astype(np.int32)
                at = np.searchsorted(part, np.arange(PARTS + 1))
                some = np.flatnonzero(np.diff(at))
                lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.r_[at[some], len(part)].astype(np.int32)), pa.array(v, kind))
                columns = [pa.array(some.astype(np.int32)), pa.array(x.lang.to_pylist() * len(some), pa.string()), lists(phrases, pa.string()), lists(n, pa.int64()), lists(cells, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "lang", "phrases", "n", "cells"])

    def added(held):
        return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("a", "sum"), ("h", "max")]).rename_columns(["lang", "phrase", "a", "h"])

    def enough(held):
        return added(held).filter(pc.field("a") >= least).combine_chunks().to_batches()

    def add(batches):
        now, held, size = None, [], 0
        for b in batches:
            for i, part in enumerate(b.column("part").to_pylist()):
                if held and part != now:
                    yield from enough(held)
                    held, size = [], 0
                elif size > HELD:
                    held, size = [added(held)], 0
                now = part
                phrases = b.column("phrases")[i].values
                held.append(pa.table([pa.repeat(b.column("lang")[i], len(phrases)), phrases, b.column("n")[i].values, b.column("cells")[i].values], names=["lang", "phrase", "a", "h"]))
                size += len(phrases)
        if held:
            yield from enough(held)

    rows = state.select(*NAMES).mapInArrow(split, "part int, lang string, phrases array<string>, n array<long>, cells array<long>")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(add, "lang string, phrase string, a long, h long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, k) of all phrases of at most `longest` words that come `least` times or more in a language, and (lang, n).

    Both are kept tables.  Counts are over all documents: each block of texts
    sends a count for every phrase, and the text of those whose hash is
    frequent, not every occurrence.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    levels, state = [], kept(blocks(rows), batch="24m")
    whole = kept(state.select("lang", F.expr("aggregate(n, 0L, (s, x) -> s + x)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    single = state.select("lang", F.inline(F.arrays_zip("words", "codes", "n"))).select("lang", F.col("words").alias("phrase"), F.expr(f"pmod(shiftrightunsigned(codes, 24), {1 << BITS})").alias("h"), F.col("n").cast("long").alias("n"))
    for length in range(1, longest + 1):
        if length > 1:
            after = kept(extended(state, length, gathered(levels[-1])), batch="24m")
            dropped(state)
            state = after
        of_words = single.groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.max("h").alias("h")).where(F.col("a") >= least)
        levels.append(kept(of_words if length == 1 else spelled(state, length, promising(state, length, least), least)))
    found = None
    for k, level in enumerate(levels, 1):
        rows = level.select("lang", "phrase", "a", F.lit(k).alias("k"))
        found = rows if found is None else found.unionByName(rows)
    out = kept(found)
    dropped(state, *levels)
    return out, whole


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, text_column: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose words belong together most.

    Texts, A-Z in lower case, are split into pieces at . , ; : ! ? and line
    ends, and pieces into words at blanks and tabs.  Candidates have 2 to
    `longest` words and come `least` times or more inside pieces, overlaps
    included.  Of the ways to cut one in two, the one of least score
    floor(1000 a n / (l r)) counts (ties: the first), where a, l and r are the
    counts of the whole and of both parts and n all words of the language.
    Products are exact below 10^38.  A candidate goes if one of a word more
    has it and comes as often; the first `most` by score, count and bytes stay.

    A null language is "und"; null and empty texts have no words; repeated rows
    count as often as they come; an empty table gives no rows.  A text is
    numbered whole by one task (about 60 bytes a byte of text).  Only the named
    columns are read.
    """
    found, whole = frequent_phrases(docs, least, longest, text_column)
    candidates = found.where("k >= 2")
    cuts = candidates.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).withColumn("left", F.expr("substring_index(phrase, ' ', at)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(whole, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", big("a") * big("n") * F.lit(1000).cast("decimal(4,0)"), big("l") * big("r"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "at", "a", "l", "r", "n")).alias("x"))
    longer = candidates.where("k >= 3").select("lang", F.col("a").alias("b"), F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("b").alias("inside"))
    left = best.join(inside, ["lang", "phrase"], "left").where("inside is null or inside < x.a").select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", place).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH d AS (SELECT row_number() OVER () i, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) p FROM d)),
 whole AS (SELECT lang, sum(len(w))::HUGEINT n FROM w GROUP BY 1),
 runs AS (SELECT lang, k, array_to_string(w[j : j + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) j FROM w, range(1, 6) t(k))),
 f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT a FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 100),
 c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') w FROM f WHERE k >= 2),
 cut AS (SELECT c.lang, c.phrase, c.a, place, x.a l, y.a r, n, 1000 * c.a * n // (x.a * y.a) score FROM (SELECT *, unnest(range(1, k)) AS place FROM c) c JOIN whole USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : place], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[place + 1 :], ' ')),
 best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
 inside AS (SELECT DISTINCT lang, phrase, b FROM (SELECT lang, a b, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) s FROM (SELECT *, unnest(range(2, k)) m FROM c)))),
 kept_ones AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = best.lang AND inside.phrase = best.phrase AND 100 * b >= 100 * best.a))
 SELECT lang, rank, phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n::BIGINT n, score::BIGINT score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept_ones) WHERE rank <= 2000"""
