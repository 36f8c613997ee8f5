"""Language-model scoring by a hidden Markov model over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, groups_of, hashed_words, kept, scramble

END = np.uint64(0x0DD0E57)  # the end symbol's number among word hashes
STEP = 300_000  # tokens walked side by side
PIECE = 12_000_000  # characters of a piece, which also has no more rows than an Arrow batch
BUCKET = 500_000  # words of pieces, counted once a piece, that a bucket of words has about


class Hmm:
    """States with emissions over numbered symbols; tasks set emit to the rows of the symbols that their piece has."""

    def __init__(self, states: int, symbols: int = 0, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
        self.emit = rng.gamma(5.0, 1.0, (symbols, states))
        self.emit /= self.emit.sum(0) if symbols else 1

    def walk(self, symbols: np.ndarray, sizes: np.ndarray, counts: tuple | None = None, kind: type = np.float64) -> np.ndarray:
        """Log10 likelihood of each sequence by the scaled forward recursion; adds expected counts if given.

        Sequences of like length go side by side, so that long ones don't hold up short ones.
        """
        order = np.argsort(sizes, kind="stable")
        begin, out, lo = np.cumsum(sizes) - sizes, np.empty(len(sizes)), 0
        while lo < len(order):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[order[lo:]]), STEP, "right")))
            some = order[lo:hi][::-1]
            out[some] = self.walk_some(symbols, begin[some], sizes[some], counts, kind)
            lo = hi
        return out

    def walk_some(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, counts: tuple | None, kind: type) -> np.ndarray:
        """walk() of sequences from the longest on: arrays hold the tokens place by place, so that a place of all sequences is a slice."""
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        at = np.r_[0, np.cumsum(live)]
        who = np.arange(at[-1]) - np.repeat(at[:-1], live)
        here = symbols[begin[who] + np.repeat(np.arange(len(live)), live)]
        e, move = self.emit.astype(kind, copy=False)[here], self.move.astype(kind)
        alpha, scale, edges = np.empty_like(e), np.empty(len(e), kind), at.tolist()
        for t, (x, y) in enumerate(zip(edges, edges[1:])):
            now = alpha[x:y]
            if t:
                np.matmul(alpha[edges[t - 1] : edges[t - 1] + y - x], move, out=now)
            else:
                now[:] = self.start.astype(kind)
            now *= e[x:y]
            np.add.reduce(now, 1, out=scale[x:y])
            now /= scale[x:y, None]
        score = np.bincount(who, np.log10(scale), len(size))
        if counts is None:
            return score
        start, moves, emits = counts
        beta, back, back_move = np.ones_like(e), np.empty_like(e), np.ascontiguousarray(move.T)
        e /= scale[:, None]
        for t in range(len(live) - 1, 0, -1):
            x, y, before = edges[t], edges[t + 1], edges[t - 1]
            np.multiply(beta[x:y], e[x:y], out=back[x:y])
            np.matmul(back[x:y], back_move, out=beta[before : before + y - x])
        one = edges[1]
        if len(live) > 1:
            moves += (alpha[np.repeat(at[:-2], live[1:]) + who[one:]].T @ back[one:]) * self.move
        alpha *= beta
        alpha /= alpha.sum(1, keepdims=True)
        start += alpha[:one].sum(0)
        for k in range(alpha.shape[1]):
            emits[:, k] += np.bincount(here, alpha[:, k], len(emits))
        return score


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(x, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), kind)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers packed by place of their bytes: small numbers leave the higher ones empty."""
    return packed(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def flat(x) -> np.ndarray:
    return np.ascontiguousarray(unpacked(x, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def first_emissions(keys: np.ndarray, count: np.ndarray, states: int, seed: int) -> np.ndarray:
    """Each word's count times a number between 0.5 and 1.5 for each state, which depends on nothing but the word's key, state and seed."""
    salt = np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return count[:, None] * (0.5 + (scramble(keys.astype(np.uint64)[:, None] + salt) >> np.uint64(11)) / 2**53)


def numbered(docs: DataFrame, folds: int, skip: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces of documents as word numbers: (piece, ids, held, sizes, tokens, words, seen, different).

    tokens numbers the piece's own words, the most frequent first; words has
    their hashes, seen how often training texts of the piece have them, and
    different how many they are.
    """

    def work(batches):
        for b in batches:
            texts, hold = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            for first, last in groups_of(texts, PIECE):
                all_words, sizes, held = [], [], hold[first:last]
                for lo, hi in groups_of(texts[first:last]):
                    w, bounds = hashed_words(texts[first + lo : first + hi])
                    sizes.append(np.diff(bounds) + 1)
                    all_words.append(np.insert(w, bounds[1:], END))
                flow, size = np.concatenate(all_words), np.concatenate(sizes)
                words, tokens = np.unique(flow, return_inverse=True)
                order = np.argsort(-np.bincount(tokens), kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                words, tokens = words[order], place[tokens]
                seen = np.bincount(tokens[~np.repeat(held, size)], minlength=len(words))
                columns = [pa.array([b.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (packed(held), packed(size.astype(np.int32)), planes(tokens), packed(words), packed(seen.astype(np.int32)))), pa.array([len(words)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "held", "sizes", "tokens", "words", "seen", "different"])

    held = F.coalesce(F.crc32(F.col(id_column).cast("long").cast("string")) % folds == skip, F.lit(False))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), held.alias("held"))
    return rows.mapInArrow(work, "ids array<long>, held binary, sizes binary, tokens binary, words binary, seen binary, different long").withColumn("piece", F.monotonically_increasing_id())


def by_bucket(bucket: np.ndarray):
    """(bucket, places) for each bucket that the words of a piece have, places in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)] if len(order) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[order[lo]]), order[lo:hi]


def rows_of(lists: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lists[k], t) for k, t in types.items()], names=list(types))


def dealt(raw: DataFrame, many: int) -> DataFrame:
    """(bucket, piece, words, seen): a row for each bucket of words and piece."""
    types = {"bucket": pa.int32(), "piece": pa.int64(), "words": pa.binary(), "seen": pa.binary()}

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, seen = unpacked(b.column(1)[i], np.uint64), unpacked(b.column(2)[i], np.int32)
                out = [(k, b.column(0)[i].as_py(), packed(words[at]), packed(seen[at])) for k, at in by_bucket(bucket_of(words, many))]
                yield rows_of(dict(zip(types, zip(*out))), types)

    return raw.select("piece", "words", "seen").mapInArrow(work, "bucket int, piece long, words binary, seen binary")


def bucket_of(words: np.ndarray, many: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int32)


def vocabulary(words: DataFrame) -> DataFrame:
    """(piece, bucket, index, count, sums): for the words of a piece their number in their bucket, -1 if training texts lack them, and their count in all training texts.

    A row without a piece has a bucket's sums: training tokens, different words,
    words seen once, seen twice, and the sums of count / (count + 1) and 1 / (count + 1).
    """
    types = {"piece": pa.int64(), "bucket": pa.int32(), "index": pa.binary(), "count": pa.binary(), "sums": pa.list_(pa.float64())}

    def work(t: pa.Table) -> pa.Table:
        words, seen = [unpacked(x, np.uint64) for x in t.column("words")], np.concatenate([unpacked(x, np.int32) for x in t.column("seen")])
        different, at = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(at, seen, len(different)).astype(np.int64)
        index, known = np.where(count > 0, np.cumsum(count > 0) - 1, -1).astype(np.int32), count[count > 0]
        parts = np.split(at, np.cumsum([len(w) for w in words])[:-1])
        sums = [known.sum(), len(known), (known == 1).sum(), (known == 2).sum(), (known / (known + 1)).sum(), (1 / (known + 1)).sum()]
        bucket = t.column("bucket")[0].as_py()
        out = {"piece": [*t.column("piece").to_pylist(), None], "bucket": [bucket] * (len(parts) + 1), "index": [*(packed(index[p]) for p in parts), None], "count": [*(packed(count[p]) for p in parts), None], "sums": [*[None] * len(parts), [float(x) for x in sums]]}
        return pa.Table.from_batches([rows_of(out, types)])

    return words.groupBy("bucket").applyInArrow(work, "piece long, bucket int, index binary, count binary, sums array<double>")


def placed(b, column: str, places: dict, kind: type, out: np.ndarray) -> np.ndarray:
    """A piece's values by word, from the rows of its buckets."""
    for k, x in zip(b.column("bucket").to_pylist(), b.column(column)):
        out[places[k]] = unpacked(x, kind).reshape(-1, *out.shape[1:])
    return out


def counted(raw: DataFrame, found: DataFrame, many: int, n: int, v: int) -> DataFrame:
    """The pieces with symbols for tokens: a number for each word of training texts, the last for all others.

    keys, bucket, index, counts and seen have a row for each such word, known
    and base each document's words that training texts have and its base score.
    """
    blobs = ["held", "sizes", "tokens", "keys", "bucket", "index", "counts", "seen", "known", "base"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        size, tokens, words, seen = (unpacked(left.column("sizes")[0], np.int32), flat(left.column("tokens")[0]), unpacked(left.column("words")[0], np.uint64), unpacked(left.column("seen")[0], np.int32))
        bucket = bucket_of(words, many)
        places = dict(by_bucket(bucket))
        index, count = placed(right, "index", places, np.int32, np.empty(len(words), np.int32)), placed(right, "count", places, np.int64, np.empty(len(words), np.int64))
        own = count > 0
        symbol = np.where(own, np.cumsum(own) - 1, own.sum()).astype(np.int32)
        begin = np.cumsum(size) - size
        sums = lambda x: np.add.reduceat(x[tokens], begin)
        made = (planes(symbol[tokens]), *(packed(x) for x in ((words[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket[own], index[own], count[own], seen[own], sums(own.astype(np.int64)), sums(np.log10((count + 1) / (n + v + 1))))))
        return pa.table([left.column("piece"), left.column("ids"), left.column("held"), left.column("sizes"), *(pa.array([x], pa.binary()) for x in made)], names=["piece", "ids", *blobs])

    return raw.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(work, "piece long, ids array<long>, " + ", ".join(f"{c} binary" for c in blobs))


class Emissions:
    """What all tasks need to make emissions of a word's count and expected counts: sums by state, nothing by word."""

    def __init__(self, states: int, seed: int, cut: float, spread: float, n: int, unknown: float):
        self.states, self.seed, self.cut, self.spread, self.n, self.unknown = states, seed, cut, spread, n, unknown
        self.share, self.total = None, None

    def left(self, count: np.ndarray) -> np.ndarray:
        """What is left of each word's count by the discount, for each of its counts and the one that smooths them."""
        return (count - self.cut) / (count + 1)

    def of(self, keys: np.ndarray, count: np.ndarray, found: np.ndarray | None) -> np.ndarray:
        """Rows for the words and for unseen words."""
        out = np.empty((len(count) + 1, self.states))
        out[-1], known = self.unknown, out[:-1]
        if found is None:
            known[:] = first_emissions(keys, count, self.states, self.seed)
            known *= (1 - self.unknown) / max(1, self.n)
        else:  # one count more, spread as the words are over all states
            np.add(found, self.share, out=known)
            known *= self.left(count)[:, None]
            known *= (1 - self.unknown) / (self.total + self.share * self.spread)
        return out


class Piece:
    """A row of pieces: held, size, tokens and, for its words, keys, count, seen, their places by bucket and the expected counts found."""

    def __init__(self, b, answers, states: int):
        has = {c: b.column(c)[0] for c in b.schema.names}
        self.held, self.size, self.tokens = unpacked(has["held"], bool), unpacked(has["sizes"], np.int32).astype(np.int64), flat(has["tokens"])
        self.count, self.bucket, self.found = unpacked(has["counts"], np.int64), unpacked(has["bucket"], np.int32), None
        self.keys = unpacked(has["keys"], np.uint32) if "keys" in has else None
        if answers is not None:
            self.found = placed(answers, "share", dict(by_bucket(self.bucket)), np.float16, np.zeros((len(self.count), states)))
            self.found *= (self.count / np.maximum(self.found.sum(1), 1e-30))[:, None]


def over(pieces: DataFrame, answers: DataFrame | None, f, schema: str, *columns: str) -> DataFrame:
    """f(a piece's row, the answers to it or None) gives record batches, for all pieces."""
    columns = ["piece", "held", "sizes", "tokens", "counts", "bucket", *columns]
    if answers is None:  # the first round makes emissions of the words' keys
        return pieces.select(*columns, "keys").mapInArrow(lambda batches: (x for b in batches for i in range(b.num_rows) for x in f(b.slice(i, 1), None)), schema)
    both = lambda left, right: pa.Table.from_batches(list(f(left, right)))
    return pieces.select(*columns).groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(both, schema)


def expected(pieces: DataFrame, answers: DataFrame | None, model: Hmm, emissions: Emissions) -> DataFrame:
    """Baum-Welch: (bucket, piece, index, seen, counts, sums): expected counts of the words of a piece and bucket in all states but the last.

    A word's expected counts add up to what the piece's training texts have of
    it (seen).  A row without a bucket has the piece's sums by state: moves,
    starts, all counts and all counts times what the discount leaves.
    """
    states = len(model.start)
    types = {"bucket": pa.int32(), "piece": pa.int64(), "index": pa.binary(), "seen": pa.binary(), "counts": pa.binary(), "sums": pa.list_(pa.float64())}

    def work(b, answers):
        p, piece = Piece(b, answers, states), b.column("piece")[0].as_py()
        model.emit, emits = emissions.of(p.keys, p.count, p.found).astype(np.float32), np.zeros((len(p.count) + 1, states))
        p.found, start, moves = None, np.zeros(states), np.zeros((states, states))
        model.walk(p.tokens[np.repeat(~p.held, p.size)], p.size[~p.held], (start, moves, emits), np.float32)
        emits = emits[:-1]
        sums = np.concatenate([moves.ravel(), start, emits.sum(0), emissions.left(p.count) @ emits])
        yield rows_of({"bucket": [None], "piece": [piece], "index": [None], "seen": [None], "counts": [None], "sums": [sums]}, types)
        index, seen = unpacked(b.column("index")[0], np.int32), unpacked(b.column("seen")[0], np.int32)
        out = [(k, piece, packed(index[at]), packed(seen[at]), packed(emits[at, :-1].astype(np.float32)), None) for k, at in by_bucket(p.bucket)]
        if out:
            yield rows_of(dict(zip(types, zip(*out))), types)

    return over(pieces, answers, work, "bucket int, piece long, index binary, seen binary, counts binary, sums array<double>", "index", "seen")


def shares_of(parts: DataFrame, states: int) -> DataFrame:
    """(piece, bucket, share): for the words of each piece how their expected counts over all pieces are shared by the states, as half-precision numbers."""

    def work(t: pa.Table) -> pa.Table:
        index = [unpacked(x, np.int32) for x in t.column("index")]
        total = np.zeros((1 + max(int(i.max()) for i in index), states))
        for i, seen, counts in zip(index, t.column("seen"), t.column("counts")):  # a piece has an index once
            x = unpacked(counts, np.float32).reshape(-1, states - 1)
            total[i, :-1] += x
            total[i, -1] += np.maximum(unpacked(seen, np.int32) - x.sum(1, dtype=np.float64), 0)
        total /= np.maximum(total.sum(1, keepdims=True), 1e-30)
        total = total.astype(np.float16)
        return pa.table([t.column("piece"), t.column("bucket"), pa.array([packed(total[i]) for i in index], pa.binary())], names=["piece", "bucket", "share"])

    return parts.where("bucket is not null").select("bucket", "piece", "index", "seen", "counts").groupBy("bucket").applyInArrow(work, "piece long, bucket int, share binary")


def lm_scores(docs: DataFrame, states: int = 8, rounds: int = 3, folds: int = 7, skip: int = 2, seed: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Words are lower-cased A-Z runs between ASCII white space, then one end for
    each text; a null or empty text is its end alone.  Training texts are those
    whose crc32(id as text) mod folds is not skip (a null id trains).  All
    words training texts lack are one further symbol.  The model starts
    from random emissions; every round sums expected counts over every training
    text, whole.  Every word of training texts, however rare, has its own
    expected count in each state.  One count more is spread over the states as
    all words are; of a count, n1 / (n1 + 2 n2) is discounted and goes to the
    further symbol.

    Scores are forward recursions in double precision; rounds run in single.
    The order of sums alone depends on partitions.  Long texts are hashed in
    stretches, and a walk holds a text's states at every word (about 100 bytes
    a word).  Repeated rows train and are scored as often as they come, ties
    don't arise, and an empty table gives no rows; without training texts N and
    V are 0.  Only the two named columns are read.  A bucket holds the words
    of a range of hashes, and there are more of them as pieces have more words:
    pieces send each bucket their counts in one row, and the bucket answers
    each piece in one; the driver gets sums by state only.
    """
    raw = kept(numbered(docs, folds, skip, id_column, text_column), batch="64m")  # pieces are made inside batches
    many = 1 + (raw.agg(F.sum("different")).first()[0] or 0) // BUCKET
    vocab = kept(vocabulary(dealt(raw, many)))
    n, v, n1, n2, a, b = (x or 0 for x in vocab.where("piece is null").agg(*[F.sum(F.col("sums")[k]) for k in range(6)]).first())
    n, v = int(n), int(v)
    cut = n1 / (n1 + 2 * n2) if n1 else 0.5
    unknown = max(1, v) * cut / max(1, n) if n else 1.0
    model, emissions = Hmm(states), Emissions(states, seed, cut, a - cut * b or 1.0, n, unknown)
    model.move = np.full((states, states), 0.01 / states) + np.eye(states) * 0.99
    pieces = kept(counted(raw, vocab.where("piece is not null").drop("sums"), many, n, v))
    dropped(raw, vocab)

    answers = None
    for _ in range(rounds if n else 0):
        parts = kept(expected(pieces, answers, model, emissions))
        if answers is not None:
            dropped(answers)
        sums = parts.where("bucket is null").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect()
        rows = np.array([x for _, x in sorted(sums)]).reshape(-1, states)
        model.move = (rows[:states] + 0.1) / (rows[:states] + 0.1).sum(1, keepdims=True)
        model.start = (rows[states] + 0.1) / (rows[states] + 0.1).sum()
        emissions.share, emissions.total = rows[states + 1] / rows[states + 1].sum(), rows[states + 2]
        answers = kept(shares_of(parts, states))
        dropped(parts)

    def score(b, answers):
        p = Piece(b, answers, states)
        model.emit, p.found = emissions.of(p.keys, p.count, p.found), None
        known, base = unpacked(b.column("known")[0], np.int64), unpacked(b.column("base")[0], np.float64)
        ids = b.column("ids")[0].values
        yield pa.RecordBatch.from_arrays([ids, pa.array(p.held), pa.array(p.size), pa.array(known), pa.array(np.full(len(ids), n), pa.int64()), pa.array(base), pa.array(model.walk(p.tokens, p.size), pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return over(pieces, answers, score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "ids", "known", "base").withColumnRenamed("id", id_column)
