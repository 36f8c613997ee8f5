"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser maps blanks to the piece mark and puts one in front; the pieces
form a trie over characters; a character without a piece goes through the byte
pieces.  Composed with an input this is a lattice of pieces.  Its arcs weigh
nothing where two pieces may stand side by side and infinity where a merge
across their border would have come first, so the tropical shortest path is the
one path of finite weight.  The composition is carried out state by state, as
in `bpe_fst`: each state keeps the back pointer (the last piece) of its best
path, and the path is read off backwards from the end.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import Merges, Transducer

MARK = "▁"
#: The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""

    def number(i):
        out = shift = 0
        while True:
            byte, i = data[i], i + 1
            out, shift = out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """The pieces, scores and normaliser settings of a model file, compiled."""

    def __init__(self, path: str, most_words: int = 700_000):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.squeeze, self.most = True, True, most_words
        rules = b""
        for field, value in fields(open(path, "rb").read()):
            if field == 1:
                entry = dict(fields(value))
                self.pieces.append(entry[1].decode())
                self.scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(entry.get(3, NORMAL))
            elif field == 3:
                spec = dict(fields(value))
                rules, self.prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if rules:
            raise ValueError("normaliser rules other than identity are not compiled")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        usable = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        chars = sorted({c for p in usable for c in p})
        self.symbol = {c: k for k, c in enumerate(chars)}
        self.lone = {c: usable.get(c) for c in chars}
        # characters that stand only inside pieces are pieces of their own here; alone they fall back to bytes
        self.extra, made, tokens = {}, {}, {}
        for c in chars:
            if c not in usable:
                self.extra[len(self.pieces) + len(self.extra)] = c
        everything = {**usable, **{c: i for i, c in self.extra.items()}}
        rank = {i: (-self.scores[i] if i < len(self.scores) else 0.0) for i in everything.values()}
        for p, i in everything.items():
            tokens[i] = tuple(self.symbol[c] for c in p)
            for k in range(1, len(p)):
                a, b = everything.get(p[:k]), everything.get(p[k:])
                if a is not None and b is not None:
                    made[a, b] = (rank[i], i)
        merges = Merges(tokens, made)
        for p, i in sorted(usable.items(), key=lambda x: len(x[0])):  # the merge that comes last in each piece, or none: then no text has it
            if len(p) > 1:
                parts = self.merged(p, everything, rank, whole=True)
                if parts is None:
                    tokens.pop(i)
                    for key in [k for k, v in made.items() if v[1] == i]:
                        made.pop(key)
                    merges.made.pop(i, None)
                else:
                    merges.made[i] = (rank[i], *parts)
        self.merges, self.fst = merges, None
        self.fst = Transducer(merges, len(chars))
        self.size = {i: len(t) for i, t in tokens.items()}
        self.words: dict[str, bytes] = {}
        self.special = np.array([k != NORMAL for k in self.kinds])
        self.written = [p.replace(MARK, " ") for p in self.pieces]
        self.code = np.zeros(0x110000, np.int16)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.odd = re.compile("[^" + re.escape("".join(chars)) + "]").search
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    @staticmethod
    def merged(piece: str, everything: dict, rank: dict, whole: bool = False):
        """The two parts of the last merge that makes a piece of its characters; None where they don't all merge."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(((rank[everything[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in everything), default=None)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return everything[parts[0]], everything[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def paths(self, words: list[str]) -> None:
        """Shortest paths of words that have none yet, walked side by side."""
        if self.fst.full:
            self.fst.clear()
        spans, plan = [], []
        for w in words:  # runs of characters that have symbols; the others go through their bytes
            if not self.odd(w):
                plan.append([len(spans)])
                spans.append(w)
                continue
            row, run = [], ""
            for c in [*w, None]:
                if c is not None and c in self.symbol:
                    run += c
                    continue
                if run:
                    row.append(len(spans))
                    spans.append(run)
                    run = ""
                if c is not None:
                    row.append(c)
            plan.append(row)
        order = sorted(range(len(spans)), key=lambda i: -len(spans[i]))
        found: list[list[int]] = [[] for _ in spans]
        for lo in range(0, len(order), 50_000):
            some = order[lo : lo + 50_000]
            size = np.array([len(spans[i]) for i in some])
            begin = np.cumsum(size) - size
            flow = self.code[np.frombuffer("".join([spans[i] for i in some]).encode("utf-32-le"), np.uint32)]
            last, state = np.empty(len(flow), np.int32), np.zeros(len(some), np.int64)
            for t in range(int(size[0]) if len(size) else 0):
                n = int(np.searchsorted(-size, -t, "left"))
                state[:n] = self.fst.step(state[:n], flow[begin[:n] + t])[0]
                last[begin[:n] + t] = self.fst.last[state[:n]]
            last = last.tolist()
            for i, b, n in zip(some, begin.tolist(), size.tolist()):
                at, path = n, []
                while at:
                    t = last[b + at - 1]
                    path += self.fallback(self.extra[t])[::-1] if t in self.extra else [t]
                    at -= self.size[t]
                found[i] = path[::-1]
        for w, row in zip(words, plan):
            self.words[w] = np.array([x for part in row for x in (found[part] if isinstance(part, int) else self.fallback(part))], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self.words.clear()
        split = [self.cut(self.normal(t)) if t else [] for t in texts]
        self.paths([w for w in set().union(*split) if w not in self.words])
        look = self.words.__getitem__
        return [np.frombuffer(b"".join(map(look, ws)), np.int32) for ws in split]

    def decode_array(self, ids: np.ndarray) -> str:
        """decode() of many ids: runs of plain pieces are joined at once."""
        if not len(ids):
            return ""
        odd = self.special[ids]
        edge = np.flatnonzero(odd[1:] != odd[:-1]) + 1
        out = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
            part = ids[a:b].tolist()
            out.append(self.decode(part) if odd[a] else "".join(map(self.written.__getitem__, part)))
        text = "".join(out)
        return text[1:] if self.prefix and text[:1] == " " and not odd[0] else text

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces written out, marks as blanks, byte pieces gathered, the blank in front taken off."""
        out, held, first = [], bytearray(), True
        for i in [*ids, None]:
            kind = None if i is None else self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if kind is not None and kind != CONTROL:
                piece = " ⁇ " if kind == UNKNOWN else self.pieces[i].replace(MARK, " ")
                out.append(piece[1:] if first and self.prefix and piece[:1] == " " and kind != UNKNOWN else piece)
            first = False
        return "".join(out)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, pieces) for each row of docs: the piece numbers of its whole text.

    Null and empty texts have none.  Repeated rows and null ids give rows of
    their own.  Only the two named columns are read.
    """

    def work(batches):
        m = piece_model(model)
        for b in batches:
            for i in range(0, max(1, b.num_rows), 500):
                part = b.slice(i, 500)
                ids = m.encode(part.column(1).to_pylist()) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "pieces"])

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(work, f"{id_column} long, pieces array<int>")


def decoded(rows: DataFrame, model: str, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """(id, text) for each row of piece numbers; null and empty ones give an empty text."""

    def work(batches):
        m = piece_model(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return rows.select(id_column, F.col(pieces_column).cast("array<int>").alias("pieces")).mapInArrow(work, f"{id_column} long, text string")


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_pieces, pieces_crc32, decoded_chars, same) for each row: encoded, decoded again and held against the text.

    A mark that stands in the text itself comes back as a blank, so same
    compares with those read as blanks; null texts count as empty.
    """

    def work(batches):
        m = piece_model(model)
        for b in batches:
            for i in range(0, max(1, b.num_rows), 500):
                part = b.slice(i, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = m.encode(texts) if texts else []
                back = [m.decode_array(x) for x in ids]
                same = [t.replace(MARK, " ") == x for t, x in zip(texts, back)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array(same, pa.bool_())], names=[id_column, "n_pieces", "pieces_crc32", "decoded_chars", "same"])

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(work, f"{id_column} long, n_pieces long, pieces_crc32 long, decoded_chars long, same boolean")
