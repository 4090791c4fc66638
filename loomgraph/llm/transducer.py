"""A BPE vocabulary compiled, on demand, into a deterministic finite-state transducer over bytes.

A merge sequence ends in the one segmentation whose neighbouring tokens are each
stable: merging the two tokens' bytes from scratch gives these two tokens again.
So the last token of every prefix follows from the last tokens of shorter
prefixes, and of those only the ones matter from which a vocabulary entry may
still be growing. A state holds exactly that: the longest suffix that begins a
vocabulary entry, and for each such suffix the last token before it with the
tokens emitted since. Their number is finite, as suffixes are shorter than the
longest entry. Transitions carry the change of the emitted-token count; the last
byte of a word takes a final transition, as it is another symbol there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from loomgraph.llm import wordbpe

ROOT = -1


class Transducer:
    """``states_limit`` bounds memory: a call that finds more states than that starts compilation afresh."""

    def __init__(self, bpe: wordbpe.WordBpe, states_limit: int = 400_000):
        self.bpe, self.states_limit = bpe, states_limit
        plain = {c: b for b, c in bpe.symbol.items()}
        self.inner, self.final_tokens, self.text = {}, {}, {}
        special = set(bpe.special)
        for token, i in bpe.vocab.items():
            if token in special:
                continue
            ends = bool(bpe.suffix) and token.endswith(bpe.suffix)
            raw = bytes(plain[c] for c in (token[: -len(bpe.suffix)] if ends else token))
            (self.final_tokens if ends else self.inner)[raw] = i
            self.text[i] = (raw, ends)
        self.prefixes = {raw[:k] for raw in (*self.inner, *self.final_tokens) for k in range(1, len(raw))}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for key, (rank, made) in bpe.merges.items():
            if made not in self.made_from or rank < self.made_from[made][2]:
                self.made_from[made] = (key >> 20, key & 0xFFFFF, rank)
        self.reset()

    def reset(self) -> None:
        # a state: (suffix bytes, ((length, token before, emitted since), ...) longest first)
        self.keys = [(b"", ((0, ROOT, 0),))]
        self.number = {self.keys[0]: 0}
        self.inner_table, self.final_table = Table(final=False), Table(final=True)
        self.last: list[tuple[int, int]] = [(ROOT, 0)]
        self.last_seen = np.zeros((0, 2), np.int64)
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.ends: dict[tuple[int, int], int] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a`` (or begin a word)."""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            if a == ROOT:
                raw, ends = self.text[b]
                ok = self._merged(raw, ends) == [b]
            else:
                ok = self.stable(ROOT, b) and self._apart(a, b)
            self.pair_ok[a, b] = ok
        return ok

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(part, rank that makes it, rank that merges it away) of the parts that touch one side of a token, whole token first."""
        out, gone = [], 1 << 30
        while True:
            made = self.made_from.get(token)
            rank = made[2] if made else -1
            out.append((token, rank, gone))
            if not made:
                return out
            token, gone = made[side], rank

    def _apart(self, a: int, b: int) -> bool:
        """No merge across the border of ``a`` and ``b`` comes up while both of its parts exist; the left one of two equal merges comes first."""
        merges, right = self.bpe.merges, self._edge(b, 0)
        for x, x_made, x_gone in self._edge(a, 1):
            for y, y_made, y_gone in right:
                found = merges.get(x << 20 | y)
                if found and max(x_made, y_made) < found[0] and found[0] < x_gone and found[0] <= y_gone:
                    return False
        return True

    def _merged(self, raw: bytes, ends: bool) -> list[int]:
        bpe = self.bpe
        ids = [int(bpe.inner[b]) for b in raw]
        if ends:
            ids[-1] = int(bpe.final[raw[-1]])
        while len(ids) > 1:
            best = min(((bpe.merges.get(ids[i] << 20 | ids[i + 1], (1 << 30, 0)), i) for i in range(len(ids) - 1)))
            if best[0][0] == 1 << 30:
                break
            ids[best[1] : best[1] + 2] = [best[0][1]]
        return ids

    def _choose(self, state: int, byte: int, tokens: dict[bytes, int]) -> tuple[int, int, int]:
        suffix, open_ = self.keys[state]
        grown = suffix + bytes([byte])
        for k, before, since in open_:
            raw = grown[len(suffix) - k :]
            token = tokens.get(raw)
            if token is not None and self.stable(before, token):
                return token, k + 1, 1 - since
        raise ValueError("the vocabulary lacks a byte symbol")

    def step(self, state: int, byte: int) -> tuple[int, int, int]:
        """Compile a transition inside a word: (next state, change of the count, 0)."""
        suffix, open_ = self.keys[state]
        token, size, delta = self._choose(state, byte, self.inner)
        grown = suffix + bytes([byte])
        kept = [(k + 1, before, since + delta) for k, before, since in open_ if grown[len(suffix) - k :] in self.prefixes]
        key = (grown[len(grown) - kept[0][0] :] if kept else b"", (*kept, (0, token, 0)))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.last.append((token, size))
        return to, delta, 0

    def finish(self, state: int, byte: int) -> tuple[int, int, int]:
        """Compile a final transition: (last token, change of the count, its length)."""
        token, size, delta = self._choose(state, byte, self.final_tokens)
        return token, delta, size

    # --------------------------------------------------- one byte at a time

    def through(self, state: int, data: bytes) -> tuple[int, int]:
        """(state, change of the count) after bytes inside a word."""
        total = 0
        for byte in data:
            found = self.steps.get((state, byte))
            if found is None:
                found = self.steps[state, byte] = self.step(state, byte)[:2]
            state = found[0]
            total += found[1]
        return state, total

    def over(self, state: int, byte: int) -> int:
        """Change of the count by the last byte of a word."""
        found = self.ends.get((state, byte))
        if found is None:
            found = self.ends[state, byte] = self.finish(state, byte)[1]
        return found

    # ------------------------------------------------- many words at a time

    def _walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Run all words side by side: (sizes, last state before each byte, token, size and count at the end)."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-size, kind="stable")
        flat, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        size, first = size[order], first[order]
        width = int(size[0]) if n else 0
        path = np.zeros((width, n), np.int32)
        total, state = np.zeros(n, np.int64), np.zeros(n, np.int32)
        live = np.searchsorted(-size, -np.arange(1, width + 1), "left")  # words longer than k + 1 bytes
        for k in range(width - 1):
            m = live[k]
            if m == 0:
                break
            to, delta, _ = self.inner_table.find(self, state[:m], flat[first[:m] + k])
            total[:m] += delta
            state[:m] = to
            path[k + 1, :m] = to
        token, change, last = self.final_table.find(self, state, flat[first + size - 1]) if n else (state, state, state)
        total += change
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return size[back], path[:, back], token[back], last[back], total[back]

    def trim(self) -> None:
        """Only between calls: within one, states that are kept aside must keep their numbers."""
        if len(self.keys) > self.states_limit:
            self.reset()

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word: the sum of the counts on its transitions."""
        self.trim()
        out = np.zeros(len(words), np.int64)
        for at in self._groups(words):
            out[at] = self._walk([words[i] for i in at.tolist()])[4]
        return out

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat token ids, index of each word's first): the last token of each prefix, read backwards from the end."""
        self.trim()
        groups, counts = [], np.zeros(len(words), np.int64)
        for at in self._groups(words):
            found = self._walk([words[i] for i in at.tolist()])
            counts[at] = found[4]
            groups.append((at, *found))
        first = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        flat = np.zeros(first[-1], np.uint32)
        if len(self.last_seen) != len(self.last):
            self.last_seen = np.array(self.last, np.int64)
        last_token, last_size = self.last_seen.T
        for at, size, path, token, step, _ in groups:
            place, left, row = first[at + 1] - 1, size - step, np.arange(len(at))
            flat[place] = token
            while True:
                on = left > 0
                if not on.all():
                    left, row, place = left[on], row[on], place[on]
                if not len(row):
                    break
                state = path[left, row]
                place = place - 1
                flat[place] = last_token[state]
                left = left - last_size[state]
        return flat, first

    @staticmethod
    def _groups(words: list[bytes], cells: int = 1 << 24) -> list[np.ndarray]:
        """Word numbers in groups whose paths fit in ``cells``; a longer word has a group of its own."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(size <= 64), np.flatnonzero(size > 64)
        step = cells // 64
        return [short[i : i + step] for i in range(0, len(short), step)] + [long[i : i + 1] for i in range(len(long))]


class Table:
    """Compiled transitions (state, byte) -> three numbers, in open addressing; a missing one is compiled when asked for."""

    def __init__(self, final: bool):
        self.final, self.used = final, 0
        self._allocate(1 << 16)

    def _allocate(self, size: int) -> None:
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros((size, 3), np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _put(self, key: int, value: tuple[int, int, int]) -> None:
        if 2 * self.used > self.mask:
            keys, values = self.keys, self.values
            self._allocate(2 * (self.mask + 1))
            self.used = 0
            for i in np.flatnonzero(keys >= 0).tolist():
                self._put(int(keys[i]), tuple(values[i].tolist()))
        at = (((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 40) & self.mask
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.values[at] = key, value
        self.used += 1

    def find(self, owner: Transducer, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = state.astype(np.int64) << 8 | byte
        while True:
            at = self._slot(key)
            open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
            while len(open_):
                at[open_] = (at[open_] + 1) & self.mask
                found = self.keys[at[open_]]
                open_ = open_[(found != key[open_]) & (found >= 0)]
            missing = np.flatnonzero(self.keys[at] != key)
            if not len(missing):
                got = self.values[at]
                return got[:, 0], got[:, 1], got[:, 2]
            for k in np.unique(key[missing]).tolist():
                self._put(k, owner.finish(k >> 8, k & 255) if self.final else owner.step(k >> 8, k & 255))


def gather(flat: np.ndarray, begin: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts one after another, and where each text's begin, from those of distinct words."""
    k = np.diff(begin)[code]
    ends = np.cumsum(k)
    place = np.repeat(begin[:-1][code] - (ends - k), k) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[place], np.concatenate([[0], ends])[first]


def encode(machine: Transducer, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, equal to ``encode(text, add_special_tokens=False).ids`` of the library."""
    cut = [machine.bpe.parts(t) for t in texts]
    words, code, first = machine.bpe.distinct([p for parts, _ in cut for p in parts])
    ids, edge = gather(*machine.tokens(words), code, first)
    out, at = [], 0
    for parts, specials in cut:
        row = [ids[edge[at] : edge[at + 1]]]
        for i, special in enumerate(specials, 1):
            row += [np.array([special], np.uint32), ids[edge[at + i] : edge[at + i + 1]]]
        out.append(np.concatenate(row) if specials else row[0])
        at += len(parts)
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """One copy for each Python worker."""
    return Transducer(wordbpe.load(path))
