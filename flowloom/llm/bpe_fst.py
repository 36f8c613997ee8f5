"""Byte-pair encoding compiled into a deterministic finite-state transducer.

A token sequence is the encoding of its text exactly when every two adjacent
tokens are *compatible*: encoding their concatenation gives the two back.  A
state therefore only remembers, for each position at which the token covering
the next symbol may begin, the trie node of the symbols since, the token that
ended there and how many tokens came before.  Counts are kept relative to the
smallest one, and the shift goes out on the transition, so the states are
finitely many.  States are compiled on first use and kept up to a fixed size.
"""

from __future__ import annotations

import json

import numpy as np

ROOT = 0
MISSING = -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens, the merge that makes each of them, and which pairs may stand side by side."""

    def __init__(self, tokens: dict[int, tuple[int, ...]], pairs: dict[tuple[int, int], tuple[int, int]]):
        """tokens: id -> symbols; pairs: (left id, right id) -> (rank, id)."""
        self.tokens, self.pairs = tokens, pairs
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in pairs.items():
            if t not in self.made or rank < self.made[t][0]:
                self.made[t] = (rank, a, b)
        self.known: dict[tuple[int, int], bool] = {}

    @classmethod
    def of_json(cls, path: str) -> "Merges":
        """A byte-level vocabulary in the tokenizers library's format."""
        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        tokens = {i: tuple(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        return cls(tokens, pairs)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a merge across the border of a and b never comes before the merges inside them."""
        key, limit = (a, b), None
        if (known := self.known.get(key)) is not None:
            return known
        while True:
            across = self.pairs.get((a, b))
            if across is not None and (limit is None or across[0] < limit):
                answer = False
                break
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                answer = True
                break
            if right is None or left is not None and left[0] > right[0]:
                limit, a = left[0], left[2]
            else:  # of equal merges the left one comes first, so a pair of the same rank to the left counts
                limit, b = right[0] + 1, right[1]
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[key] = answer
        return answer


class Transducer:
    """Lazily compiled states over the symbols 0 .. n_symbols - 1; state 0 is the start of a word."""

    def __init__(self, merges: Merges, n_symbols: int, most_cells: int = 24_000_000, narrow: int = 20):
        self.merges, self.n, self.most, self.narrow = merges, n_symbols, most_cells, narrow
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [MISSING], [False]
        for t, symbols in merges.tokens.items():
            node = ROOT
            for s in symbols:
                self.inner[node] = True
                if (to := self.child.get(node * n_symbols + s)) is None:
                    to = self.child[node * n_symbols + s] = len(self.token_at)
                    self.token_at.append(MISSING)
                    self.inner.append(False)
                node = to
            self.token_at[node] = t
        parent = [ROOT] * len(self.token_at)
        for key, to in self.child.items():
            parent[to] = key // n_symbols
        self.beyond: list[list[int]] = [[] for _ in self.token_at]  # tokens that go on from a node; a child's number is the larger
        for node in range(len(parent) - 1, ROOT, -1):
            if parent[node] != ROOT:
                self.beyond[parent[node]] += self.beyond[node] + ([self.token_at[node]] if self.token_at[node] >= 0 else [])
        self.like: dict[tuple[int, int], int] = {}
        self.first: dict[tuple, int] = {}
        self.clear()

    def stand_in(self, node: int, last: int) -> int:
        """The first token seen that allows the same tokens beyond this node as last does; -2 where it allows none."""
        if (known := self.like.get((node, last))) is None:
            if len(self.beyond[node]) > self.narrow:
                return last
            allowed = tuple(t for t in self.beyond[node] if last < 0 or self.merges.compatible(last, t))
            known = self.like[node, last] = self.first.setdefault((node, allowed), last) if allowed else -2
        return known

    def clear(self) -> None:
        """Back to the start state alone; memory is bounded because a full table starts anew."""
        self.states = [((ROOT, MISSING, 0),)]
        self.index = {self.states[0]: 0}
        self.column, self.symbols, self.stride = np.full(self.n, MISSING, np.int64), [], 64  # a column for each symbol that has come up
        self.move = np.full((1024, self.stride), MISSING, np.int32)  # state to * 64 + tokens put out
        self.last = np.full(1024, MISSING, np.int32)  # the token that ends at a state
        self.ends = np.zeros(1024, np.int32)  # tokens not yet put out, if the word ends here

    @property
    def full(self) -> bool:
        return len(self.states) * self.stride > self.most

    def compile(self, state: int, symbol: int) -> None:
        found, alive = None, []
        for node, last, count in self.states[state]:
            if (to := self.child.get(node * self.n + symbol)) is None:
                continue
            t = self.token_at[to]
            if found is None and t >= 0 and (last < 0 or self.merges.compatible(last, t)):
                found = (ROOT, t, count + 1)
            if self.inner[to] and (same := self.stand_in(to, last)) != -2:
                alive.append((to, same, count))
        if found is None:
            raise ValueError(f"no token ends after symbol {symbol}")
        alive.append(found)
        shift = min(x[2] for x in alive)
        key = tuple((a, b, c - shift) for a, b, c in alive)
        if (to := self.index.get(key)) is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.last):
                self.move = np.concatenate([self.move, np.full_like(self.move, MISSING)])
                self.last = np.concatenate([self.last, np.full(len(self.last), MISSING, np.int32)])
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int32)])
            self.last[to], self.ends[to] = key[-1][1], key[-1][2]
        self.move[state, self.column[symbol]] = to * 64 + shift

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition from each of many states: where they lead, and the counts put out."""
        column = self.column[symbol]
        if column.size and column.min() < 0:
            for k in np.unique(symbol[column < 0]).tolist():
                self.column[k] = len(self.symbols)
                self.symbols.append(k)
            if len(self.symbols) > self.stride:
                more = max(self.stride, len(self.symbols) - self.stride)
                self.move = np.concatenate([self.move, np.full((len(self.move), more), MISSING, np.int32)], 1)
                self.stride += more
            column = self.column[symbol]
        at = state * self.stride + column
        go = self.move.ravel()[at]
        if go.size and go.min() < 0:
            for k in np.unique(at[go < 0]).tolist():
                self.compile(k // self.stride, self.symbols[k % self.stride])
            go = self.move.ravel()[at]
        return go >> 6, go & 63
