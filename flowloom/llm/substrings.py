"""Substring dedup: parts of lines and sentences, grouped by digest over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, dropped, groups_of, kept, scramble, word_table

NEAR = 4  # a cut inside a sentence is the least of the places up to so many words away
MIX = np.uint64(0x9E3779B97F4A7C15)
SPAN = "array<struct<start:int,length:int,words:int>>"
UNITS = ("part", "line", "paragraph")
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def cuts(h: np.ndarray, begin: np.ndarray, size: np.ndarray, short: int) -> np.ndarray:
    """Words of units (first word, words) before which they are cut: where the hash of the words around is less than at all places near.

    Cuts depend on the words near them alone, so a passage has the same ones
    wherever it starts, and stay `short` words from the unit's ends.
    """
    most = np.iinfo(np.uint64).max
    place = np.full(len(h) + 2 * NEAR, most)
    inner = place[NEAR : NEAR + len(h)]
    inner[1:-1] = scramble((h[:-2] * MIX + h[1:-1]) * MIX + h[2:])
    at = np.arange(len(h)) - np.repeat(begin, size)
    inner[(at < short) | (np.repeat(size, size) - at < short)] = most
    least = inner < most
    for d in range(1, NEAR + 1):
        least &= (inner < place[NEAR - d : len(place) - NEAR - d]) & (inner < place[NEAR + d : NEAR + d + len(h)])
    return np.flatnonzero(least)


class Parts:
    """The units of several texts: whose they are, how many words they have, two hashes of them, and their bytes."""

    def __init__(self, texts: list[str | None], unit: str, short: int):
        raw = [t.encode() if t else b"" for t in texts]
        self.data, first, size, h, bounds = word_table(raw)
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.text_begin = ends - [len(r) + 1 for r in raw]
        if not len(h):
            self.text = self.words = self.begin = self.end = np.zeros(0, np.int64)
            self.one = self.two = np.zeros(0, np.int64)
            return
        breaks = np.cumsum(self.data == 10)
        after = breaks[np.r_[first[1:], len(self.data)] - 1] - breaks[first + size - 1]  # line ends between a word and the next
        last = after >= (2 if unit == "paragraph" else 1)
        if unit == "part":
            last |= _STOP[self.data[first + size - 1]]
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        begin = np.r_[0, np.flatnonzero(last)[:-1] + 1]
        if unit == "part":
            begin = np.union1d(begin, cuts(h, begin, np.diff(begin, append=len(h)), short))
        self.words = np.diff(begin, append=len(h))
        self.text = np.searchsorted(bounds, begin, "right") - 1
        self.begin = first[begin]
        own = ends[self.text] - 1
        self.end = np.minimum(np.r_[self.begin[1:], len(self.data)], own)
        power = _powers(1 << int(self.words.max() - 1).bit_length())[np.arange(len(h)) - np.repeat(begin, self.words)]
        n = self.words.astype(np.uint64)
        self.one = scramble(np.add.reduceat(h * power, begin) + n).view(np.int64)
        self.two = scramble(np.add.reduceat(scramble(h ^ MIX) * power, begin) ^ n).view(np.int64)

    def places(self) -> np.ndarray:
        """Each unit's number within its text."""
        return np.arange(len(self.text)) - np.searchsorted(self.text, self.text)


def runs(words: list[int], repeated: set[int], least: int, short: int) -> list[tuple[int, int, int]]:
    """(first, last, words) of the runs of neighbouring repeated units with `least` words or more.

    Units of fewer than `short` words go with a run that goes on after them.
    """
    out, begin, end, size, between = [], 0, 0, 0, 0
    for k, n in enumerate([*words, short]):
        if k in repeated:
            begin, end, size, between = (begin if size else k), k, size + between + n, 0
        elif n < short:
            between += n
        else:
            if size >= least:
                out.append((begin, end, size))
            size = between = 0
    return out


def dedup_substrings(docs: DataFrame, least_words: int = 20, unit: str = "part", short: int = 4, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_repeated, n_removed, removed) and the columns in keep, for each row of docs.

    Units are runs of words (split at ASCII white space, A-Z lower-cased): with
    unit="line" those of a line, with "paragraph" those between blank lines;
    with "part" sentences within lines, cut further at places that the words
    around them alone decide, so that passages that begin or end inside a
    sentence have units in common.  Those of fewer than `short` words are not
    compared.  Of the units of one digest (128 bits) those of the smallest id
    stay, and in its text the first.  The others are repeated, and go where a
    run of neighbouring repeated units has least_words words or more, so a
    common short line in otherwise new text stays; unit="line", least_words=1
    and short=1 remove every repeated line.

    removed holds each run's start and length in characters of the original
    text, and its words; text is the text without them.  Null texts stay null;
    empty ones have no units.  Rows with a null id take no part and come back
    as they are.  Rows of one id are not held against one another, so repeated
    rows come back alike; of an id with several texts each has its own units
    (a row is known by its id and the hash of its text).  A text is taken whole by one task, which needs about
    100 bytes for each of its bytes.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def digests(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in groups_of(texts):
                p = Parts(texts[lo:hi], unit, short)
                full = np.flatnonzero(p.words >= short)
                text, one, two = p.text[full], p.one[full], p.two[full]
                later = np.ones(len(full), bool)
                later[np.unique(np.stack([text, one, two]), axis=1, return_index=True)[1] if len(full) else []] = False
                at = pa.array(text + lo)
                columns = [b.column(0).take(at), b.column(2).take(at), pa.array(p.places()[full].astype(np.int32)), pa.array(one), pa.array(two), pa.array(later)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "unit", "one", "two", "later"])

    def cut(batches):
        for b in batches:
            for lo, hi in groups_of(b.column(1).to_pylist()):
                part = b.slice(lo, hi - lo)
                texts, marks = part.column(1).to_pylist(), part.column(2).to_pylist()
                some = [i for i, m in enumerate(marks) if m]
                p = Parts([texts[i] for i in some], unit, short)
                at = np.searchsorted(p.text, np.arange(len(some) + 1))
                chars = np.cumsum(np.r_[0, (p.data & 0xC0) != 0x80])  # characters before each byte
                out, spans = list(texts), [[] for _ in texts]
                for k, i in enumerate(some):
                    a, z = at[k], at[k + 1]
                    found = runs(p.words[a:z].tolist(), set(marks[i]), least_words, short)
                    begin = chars[p.text_begin[k]]
                    left, done = [], 0
                    for x, y, n in found:
                        start, end = int(chars[p.begin[a + x]] - begin), int(chars[p.end[a + y]] - begin)
                        left.append(texts[i][done:start])
                        spans[i].append({"start": start, "length": end - start, "words": n})
                        done = end
                    out[i] = "".join([*left, texts[i][done:]])
                span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("words", pa.int32())]))
                counts = [pa.array([len(x or ()) for x in c], pa.int32()) for c in (marks, spans)]
                columns = [part.column(0), *(part.column(j) for j in range(3, part.num_columns)), pa.array(out, pa.string()), *counts, pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *[f"_k{j}" for j in range(len(keep))], "_text", "n_repeated", "n_removed", "removed"])

    kept_columns = [F.col(c).alias(f"_k{j}") for j, c in enumerate(keep)]
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"), *kept_columns).withColumn("_mark", F.xxhash64("_text"))
    units = kept(rows.where("_id is not null").select("_id", "_text", "_mark").mapInArrow(digests, "id long, mark long, unit int, one long, two long, later boolean"))
    firsts = kept(units.groupBy("one", "two").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = units.join(firsts, ["one", "two"]).where("later or id > least").groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("unit").alias("_units"))
    again = kept(again)
    dropped(units, firsts)
    whole = rows.join(again, ["_id", "_mark"], "left").select("_id", "_text", "_units", *[f"_k{j}" for j in range(len(keep))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_text", "_mark"))
    out = whole.mapInArrow(cut, f"{schema}, _text string, n_repeated int, n_removed int, removed {SPAN}")
    return out.select(F.col("_id").alias(id_column), F.col("_text").alias(text_column), "n_repeated", "n_removed", "removed", *[F.col(f"_k{j}").alias(c) for j, c in enumerate(keep)])
