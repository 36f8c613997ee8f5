"""Token counts by a finite-state tokenizer whose transitions carry emitted-token counts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import Merges, Transducer

CHUNK = 1024
#: Code points of white space, the special string, and the endings split off after an apostrophe.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPECIAL = "<|endoftext|>"
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, white space; UNSURE for those that this Python's tables don't assign."""
    kind = {"L": LETTER, "N": NUMBER}
    of = (unicodedata.category(chr(c)) for c in range(0x110000))
    out = np.fromiter((UNSURE if k == "Cn" else kind.get(k[0], OTHER) for k in of), np.uint8, 0x110000)
    out[SPACES] = SPACE
    return out


def settle(chars: np.ndarray, split) -> None:
    """Asks the library's splitter, by what they stay together with, for the classes of code points that this Python doesn't know."""
    for c in np.unique(chars[classes()[chars] == UNSURE]).tolist():
        alone = [k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + chr(c))) == 1]
        classes()[c] = alone[0] if alone else SPACE


def word_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a word; first marks the first of each text.

    The splitting pattern is a local automaton: whether a word begins depends
    on the class of the neighbours and on an apostrophe up to three back.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, bool)
    kind, space = (k := classes()[chars]), k == SPACE
    before, gap = np.r_[np.uint8(9), k[:-1]], np.r_[False, space[:-1]]
    after_blank = np.r_[False, chars[:-1] == 32]
    ends = np.r_[first[1:], True]
    goes_on = ~ends & ~np.r_[space[1:], True]  # a visible character of the same text follows
    start = np.where(space, ~gap | goes_on, np.where(gap, ~after_blank, before != kind)) | first
    quote = np.flatnonzero((chars == 39) & (first | gap & ~after_blank | (before == LETTER) | (before == NUMBER)))
    if quote.size:
        at = np.arange(n)
        end_of = at[ends][np.searchsorted(at[ends], quote)]  # the last character of the quote's text
        for ending in ENDINGS:
            size = len(ending)
            hit = quote[quote + size <= end_of]
            for i, c in enumerate(ending, 1):
                hit = hit[chars[hit + i] == ord(c)]
            for i in range(1, size + 1):
                start[hit + i] = False
            rest = hit[hit + size + 1 < n] + size + 1
            start[rest] = True
    return start


def run(fst: Transducer, data: np.ndarray, flags: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks many byte ranges side by side, from one state each: the states reached and the tokens put out."""
    order = np.argsort(-size, kind="stable")
    at, size, state, out = at[order], size[order], state[order].astype(np.int64), np.zeros(len(at), np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for i, n in enumerate(live):
        here = at[:n] + i
        s = state[:n]
        if (new := flags[here]).any():
            out[:n] += np.where(new, fst.ends[s], 0)
            s = np.where(new, 0, s)
        state[:n], put = fst.step(s, data[here])
        out[:n] += put
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return state[back], out[back]


def compose(fst, data, flags, maps: dict, left: np.ndarray, right: np.ndarray) -> None:
    """The map of two neighbouring ranges from theirs, into the left one.

    A map takes any entry state: its head is walked from that state; where the
    range holds the start of a word, the rest is a fixed exit state and count.
    """
    fixed = maps["fixed"][left]
    a, b = left[fixed], right[fixed]
    state, put = run(fst, data, flags, maps["at"][b], maps["head"][b], maps["exit"][a])
    through = maps["fixed"][b]
    maps["count"][a] += put + np.where(through, fst.ends[state] + maps["count"][b], 0)
    maps["exit"][a] = np.where(through, maps["exit"][b], state)
    a, b = left[~fixed], right[~fixed]  # the head goes on into the next range
    maps["head"][a] += maps["head"][b]
    for k in ("fixed", "exit", "count"):
        maps[k][a] = maps[k][b]


def count_tokens(fst: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text, special strings inside counting one each."""
    parts, owner, counts = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = text.split(SPECIAL) if SPECIAL in text else [text]
        counts[i] = len(pieces) - 1
        for p in filter(None, pieces):
            parts.append(p)
            owner.append(i)
    if not parts:
        return counts
    if fst.full:
        fst.clear()
    joined, owner = "".join(parts), np.array(owner)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    settle(chars, fst.split)
    begin = np.cumsum([0, *map(len, parts)])
    first = np.zeros(len(chars), bool)
    first[begin[:-1]] = True
    data = np.frombuffer(joined.encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    flags = np.zeros(len(data), bool)
    flags[lead[word_starts(chars, first)]] = True
    edges = np.r_[lead, len(data)][begin]
    sizes = np.diff(edges)
    # the maps of the chunks of every part
    per = -(-sizes // CHUNK)
    part = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(part)) - np.repeat(np.cumsum(per) - per, per)
    at = edges[part] + k * CHUNK
    size = np.minimum(CHUNK, edges[part + 1] - at)
    marks = np.flatnonzero(flags)
    sync = np.r_[marks, len(data)][np.searchsorted(marks, at)]
    fixed = sync < at + size
    head = np.where(fixed, sync - at, size)
    exit_, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    exit_[fixed], count[fixed] = run(fst, data, flags, (at + head)[fixed], (size - head)[fixed], exit_[fixed])
    maps = {"at": at, "head": head, "fixed": fixed, "exit": exit_, "count": count}
    step = 1
    while step < (per.max() if len(per) else 0):  # the up-sweep of a prefix scan over each part's chunks
        left = np.flatnonzero((k % (2 * step) == 0) & (k + step < per[part]))
        compose(fst, data, flags, maps, left, left + step)
        step *= 2
    whole = np.flatnonzero(k == 0)
    np.add.at(counts, owner, maps["count"][whole] + fst.ends[maps["exit"][whole]])
    return counts


@lru_cache(2)
def transducer(path: str) -> Transducer:
    from tokenizers import Tokenizer

    fst = Transducer(Merges.of_json(path), 256)
    fst.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return fst


def pieces(texts: list[str], most: int = 4_000_000):
    """Runs of texts of bounded total length (a longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    yield texts[begin:]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    Null and empty texts have no bytes and no tokens.  Each row of docs gives
    one row, repeated ids and null ids too.  Only the two named columns are
    read, so further columns may have any name.  Texts of any length are
    counted whole, in chunks; texts never leave their partition.
    """

    def work(batches):
        fst = transducer(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.concatenate([count_tokens(fst, p) for p in pieces(texts)]) if texts else np.zeros(0, np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(work, f"{id_column} long, n_bytes long, n_tokens long, over_limit boolean")
