"""Mixture-controlled packing: deficit round-robin over source queues.

A round gives every source a credit in proportion to its target share of a
window.  What a source may have been served after r rounds is the whole part
of r credits, so the fraction left over, its deficit, is carried from round to
round exactly.  As this is a closed formula of r, any partition can tell where
its own tokens go: deficits cross windows and partitions without a driver loop.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, _BYTE, _powers, dropped, groups_of, kept, scramble

#: The splitting pattern's endings and the end of the code points that need no normal form.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
PLAIN = 0x100
SHIFT = 16
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind of every code point below PLAIN."""
    lower, kind = np.arange(PLAIN, dtype=np.uint8), np.full(PLAIN, OTHER, np.uint8)
    for c in range(PLAIN):
        small = chr(c).lower()
        lower[c] = ord(small) if len(small) == 1 and ord(small) < PLAIN else c
        kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kind[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    return lower, kind


LOWER, KIND = byte_tables()
_BLANK = re.compile(rb"[ \n]").search


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in words, and which begin one: runs of letters, endings after an apostrophe, single numbers, runs of the rest."""
    kind = KIND[data]
    before = np.r_[np.uint8(SPACE), kind[:-1]]
    start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    quote = np.flatnonzero((data == 39) & start)
    for ending in ENDINGS:
        hit = quote[quote + len(ending) < len(data)]
        for i, c in enumerate(ending, 1):
            hit = hit[data[hit + i] == ord(c)]
        for i in range(1, len(ending) + 1):
            start[hit + i] = False
        rest = hit + len(ending) + 1
        rest = rest[rest < len(data)]
        start[rest] = kind[rest] != SPACE
    return kind != SPACE, start


class WordIds:
    """Token ids of texts; the ids of up to most_words words seen before are kept in flat arrays, by 64-bit hash."""

    def __init__(self, path: str, most_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def odd(text: str) -> bool:
        """Texts whose normal form or special strings the library itself has to see to."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return any(x in text for x in ("<|", "\x1c", "\x1d", "\x1e", "\x1f"))

    def learn(self, hashes: np.ndarray, words: list[bytes], places: np.ndarray) -> None:
        """Adds words to those known."""
        sizes, flats = [], [self.flat]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode("latin-1"), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word was not encoded by itself")
            sizes.append(np.diff(ends, prepend=0))
            flats.append(ids)
        size = np.concatenate(sizes)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(flats)
        self.hash, self.at, self.size = (np.insert(a, places, b) for a, b in ((self.hash, hashes), (self.at, at), (self.size, size)))

    def of_plain(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        inside, start = word_places(data)
        first = np.flatnonzero(start)
        if not len(first):
            return np.zeros(0, "<u4"), np.zeros(len(raw), np.int64)
        bounds = np.searchsorted(first, np.cumsum([0, *[len(r) + 1 for r in raw]]))
        inside = np.flatnonzero(inside)
        begin = np.flatnonzero(start[inside])
        size = np.diff(begin, append=len(inside))
        place = np.arange(len(inside)) - np.repeat(begin, size)
        terms = _BYTE[data[inside]] * _powers(1 << int(size.max() - 1).bit_length())[place]
        h = scramble(np.add.reduceat(terms, begin) + size.astype(np.uint64))
        h, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(h) > self.most:
            self.clear()
        at = np.searchsorted(self.hash, h)
        new = np.flatnonzero(at == len(self.hash)) if not len(self.hash) else np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != h)
        if len(new):
            flow, a, n = data.tobytes(), first[where[new]].tolist(), size[where[new]].tolist()
            self.learn(h[new], [flow[x : x + k] for x, k in zip(a, n)], at[new])
            at = np.searchsorted(self.hash, h)
        n, at = self.size[at][back], self.at[at][back]
        end = np.cumsum(n)
        ids = self.flat[np.repeat(at - end + n, n) + np.arange(end[-1])]
        return ids, np.diff(np.r_[0, end][bounds])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (unsigned 32-bit) in order, and how many each text has."""
        counts, plain, owner, parts = np.zeros(len(texts), np.int64), [], [], {}
        for i, t in enumerate(texts):
            if self.odd(t):
                parts[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
                counts[i] = len(parts[i])
                continue
            raw = t.encode("latin-1")
            while len(raw) > LONG and (gap := _BLANK(raw, LONG)):  # a long text goes by in stretches cut between words
                plain.append(raw[: gap.start()])
                owner.append(i)
                raw = raw[gap.start() :]
            plain.append(raw)
            owner.append(i)
        flows, begin = [], 0
        for lo, hi in groups_of(plain, LONG):
            ids, n = self.of_plain(plain[lo:hi])
            flows.append(ids)
            np.add.at(counts, owner[lo:hi], n)
        flow = np.concatenate([np.zeros(0, "<u4"), *flows])
        if not parts:
            return flow, counts
        out = []
        for i, n in enumerate(counts.tolist()):
            out.append(parts[i] if i in parts else flow[begin : begin + n])
            begin += 0 if i in parts else n
        return np.concatenate(out), counts


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def slices(data: pa.Buffer, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values of 4 * sizes bytes follow one another in data."""
    ends = np.cumsum(np.r_[0, sizes * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(id, source, part, start, n, ids): each text's tokens and its place in its source's queue within the task that wrote it."""

    def work(batches):
        words, part, queue = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                texts, sources = b.column(1).slice(i, 1000).to_pylist(), b.column(2).slice(i, 1000).to_pylist()
                for lo, hi in groups_of(texts, LONG):
                    ids, n = words.of([t or "" for t in texts[lo:hi]])
                    ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
                    start = []
                    for s, k in zip(sources[lo:hi], n.tolist()):
                        start.append(queue.get(s, 0))
                        queue[s] = start[-1] + k
                    columns = [b.column(0).slice(i + lo, hi - lo), pa.array(sources[lo:hi], pa.string()), pa.array(np.full(len(n), part)), pa.array(start, pa.int64()), pa.array(n), slices(pa.py_buffer(ids), n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "part", "start", "n", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(source_column).cast("string").alias("source"))
    return rows.mapInArrow(work, "id long, source string, part long, start long, n long, ids binary")


class Rounds:
    """Where tokens go: queues by number with how many tokens they have and their credits a round."""

    def __init__(self, tokens: list[int], credits: list[int], length: int):
        self.n, self.w, self.length = np.array(tokens, np.int64), np.array(credits, np.int64), length
        self.dry = self.round_of(self.n - 1, self.w)  # the round in which a queue runs dry

    @staticmethod
    def round_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (((x + 1) << SHIFT) + w - 1) // w

    def served(self, k, r: np.ndarray) -> np.ndarray:
        """Tokens of queue k that are out after round r."""
        return np.where(r >= self.dry[k], self.n[k], (np.minimum(r, self.dry[k]) * self.w[k]) >> SHIFT)

    def pieces(self, k: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of each piece of documents of n tokens from place x of queue k on.

        Only rounds that serve the queue are looked at; a document's
        neighbouring pieces are one where they follow one another.
        """
        w = self.w[k]
        dense = w >= 1 << SHIFT  # some of the queue in every round; else at most one token in a round
        first = self.round_of(x, w)
        many = np.where(dense, self.round_of(x + n - 1, w) - first + 1, n)
        doc = np.repeat(np.arange(len(x)), many)
        i = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        r = np.where(dense[doc], first[doc] + i, self.round_of(x[doc] + i, w[doc]))
        mine = k[doc]
        low = np.maximum(x[doc], self.served(mine, r - 1))
        size = np.minimum(x[doc] + n[doc], self.served(mine, r)) - low
        at = low.copy()
        for j in range(len(self.n)):
            at += np.where(mine == j, 0, self.served(j, r - (mine < j)))
        full = size > 0
        doc, low, size, at = doc[full], low[full], size[full], at[full]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1])][: len(doc)])
        if not len(new):
            return (np.zeros(0, np.int64),) * 5
        doc, low, at, size = doc[new], low[new], at[new], np.add.reduceat(size, new)
        sequence = at // self.length
        many = (at + size - 1) // self.length - sequence + 1
        row = np.repeat(np.arange(len(at)), many)
        sequence = sequence[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.maximum(at[row], sequence * self.length)
        end = np.minimum(at[row] + size[row], (sequence + 1) * self.length)
        return doc[row], low[row] - x[doc[row]] + begin - at[row], end - begin, sequence, begin - sequence * self.length


def queue_base(parts: DataFrame) -> DataFrame:
    """parts (queue, part, k, tokens) with base: the tokens of queue k before those of this source and task."""
    by_part = parts.groupBy("k", "part").agg(F.sum("tokens").alias("all"))
    before = by_part.withColumn("before", F.sum("all").over(Window.partitionBy("k").orderBy("part")) - F.col("all")).drop("all")
    inside = F.sum("tokens").over(Window.partitionBy("k", "part").orderBy("queue")) - F.col("tokens")
    return parts.withColumn("inside", inside).join(before, ["k", "part"]).select("queue", "part", "k", (F.col("before") + F.col("inside")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, shares: dict | None = None, most_broadcast: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per piece: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its text's ids and then end_id; a null or empty text is
    end_id alone, and a null source is a source like others.  Every row of docs
    is packed, repeated ids too; an empty table gives no pieces.  Sequences are
    full but for the last one.  shares maps a source to its target share; the
    default is its part of all tokens, so that all queues run dry together.
    When a queue is empty its credit goes unused and the others go on.

    Sources that shares doesn't name, or by default those with less than one
    token a window, form one further queue: so there are never more than
    `length` + 1 queues by default, whatever the number of sources.  Long
    texts are tokenized in stretches cut between words.  Ids stay in the files
    that the tokenizing tasks wrote: the queues' bases go to them, as long as
    there are no more than most_broadcast, and are joined beyond that.  Only
    the three named columns are read.
    """
    rows = kept(tokenized(docs, tokenizer, end_id, id_column, text_column, source_column))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    parts = kept(rows.groupBy(key.alias("queue"), "part").agg(F.sum("n").alias("tokens")))
    totals = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    everything = parts.agg(F.sum("tokens")).first()[0] or 0
    if shares is None:
        named = totals.where(F.col("tokens") * length >= everything).orderBy("queue").collect()
        credit = [r.tokens * (length << SHIFT) // everything for r in named]
    else:
        names = [f"s{s}" if s is not None else "n" for s, x in shares.items() if x > 0]
        named = totals.where(F.col("queue").isin(names)).orderBy("queue").collect()
        whole = sum(x for x in shares.values() if x > 0)
        credit = [int(shares[r.queue[1:] if r.queue[0] == "s" else None] * (length << SHIFT) / whole) for r in named]
    rest = everything - sum(r.tokens for r in named)
    credit.append(rest * (length << SHIFT) // everything if shares is None and everything else 1)
    rounds = Rounds([*[r.tokens for r in named], rest], [max(1, c) for c in credit], length)
    numbers = docs.sparkSession.createDataFrame([(r.queue, k) for k, r in enumerate(named)], "queue string, k long")
    base = kept(queue_base(parts.join(F.broadcast(numbers), "queue", "left").withColumn("k", F.coalesce("k", F.lit(len(named)).cast("long")))))
    dropped(parts)
    base = F.broadcast(base) if base.count() <= most_broadcast else base

    def place(batches):
        for b in batches:
            x, n, k = (b.column(i).to_numpy() for i in (2, 3, 4))
            for lo, hi in runs_of(np.maximum(n, 64), 400_000):
                part = b.slice(lo, hi - lo)
                doc, start, size, sequence, offset = rounds.pieces(k[lo:hi], x[lo:hi], n[lo:hi])
                buffers, ends = part.column(5).buffers(), n[lo:hi].cumsum() * 4
                skip = int(np.frombuffer(buffers[1], np.int32)[part.column(5).offset])
                flow = buffers[2].slice(skip, int(ends[-1]))  # a document's pieces come in its own order, so the bytes stay where they are
                take = pa.array(doc)
                columns = [part.column(0).take(take), part.column(1).take(take), pa.array(start), pa.array(size), pa.array(n[lo:hi][doc]), pa.array(sequence), pa.array(offset), slices(flow, size)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = rows.withColumn("queue", key).join(base, ["queue", "part"]).select("id", "source", (F.col("base") + F.col("start")).alias("x"), "n", "k", "ids")
    return placed.mapInArrow(place, f"{id_column} long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def runs_of(sizes: np.ndarray, most: int):
    """(begin, end) of runs whose sizes add up to at most `most`; a larger one stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
