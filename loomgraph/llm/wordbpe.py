"""Word-wise byte-level BPE from a ``tokenizers`` JSON file, in batches.

The library's steps are kept (special strings, NFC, white space, lower case,
splitting, byte symbols, merges), but a batch is split as one numpy array and
each of its distinct words is looked at once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from loomgraph.llm import textkit

SPACE, LETTER, NUMBER, APOSTROPHE, OTHER, UNKNOWN = range(6)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        symbol = byte_symbols()
        self.vocab, self.suffix, self.symbol = vocab, suffix, symbol
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[symbol[b] + suffix] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.merges = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made, strict=True))}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        self.values = textkit.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(textkit.BASE)) | np.uint64(1)

    # ------------------------------------------------------------- splitting

    def _lower(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # the library lower-cases character by character

    def normalise(self, text: str) -> str:
        """As the library does; by Python's own tables where these say the same of all characters of the text.

        The two may follow different versions of Unicode. Composition of characters that Python's version knows is the
        same in all later ones, so only case can differ among these.
        """
        if text.isascii():
            return text.lower()
        for c in set(text) - self.alike - self.unlike:
            same = unicodedata.category(c) != "Cn" and (c.isspace() or self.library.normalizer.normalize_str(c) == self._lower(c))
            (self.alike if same else self.unlike).add(c)
        if self.unlike and not self.unlike.isdisjoint(text):
            return self.library.normalizer.normalize_str(text)
        return self._lower(text)

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Normalised parts between special strings, and the ids of those strings: one fewer."""
        if "<|" not in text:
            return [self.normalise(text)], []
        cut = self.special_pattern.split(text)
        return [self.normalise(x) for x in cut[::2]], [self.special[x] for x in cut[1::2]]

    def _classify(self, points: np.ndarray) -> None:
        """Ask the library itself for the class of characters not met before."""
        pre = self.library.pre_tokenizer
        for p in points.tolist():
            c = chr(p)
            if p == 39:
                kind = APOSTROPHE
            elif 0xD800 <= p < 0xE000:
                kind = OTHER
            elif len(pre.pre_tokenize_str(f"!{c}!")) == 1:
                kind = OTHER
            elif len(pre.pre_tokenize_str(f"a{c}a")) == 1:
                kind = LETTER
            elif len(pre.pre_tokenize_str(f"a{c}a")) == 2:
                kind = SPACE
            else:
                kind = NUMBER
            self.classes[p] = kind

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The class of each character."""
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self._classify(np.unique(points[kind == UNKNOWN]))
            kind = self.classes[points]
        return kind

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined text, code points, starts, ends, index of each text's first piece) of the pre-tokens of normalised texts."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds(points)
        n = len(kind)
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        other, other_before = kind >= APOSTROPHE, before >= APOSTROPHE
        start = (kind == NUMBER) | ((kind == LETTER) & (before != LETTER)) | (other & ~other_before)
        quote = np.flatnonzero((kind == APOSTROPHE) & ~other_before)
        if len(quote):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            c1, c2 = padded[quote + 1], padded[quote + 2]
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
            for hit, size in ((quote[one], 2), (quote[two & ~one], 3)):
                start[hit + 1] = False
                after = hit + size
                after = after[after < n]
                start[after[kind[after] != SPACE]] = True
        bounds = np.flatnonzero(start | (kind == SPACE))
        follows = np.append(bounds[1:], n)
        is_start = start[bounds]
        s, e = bounds[is_start], follows[is_start]
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offs[1:])
        return joined, points, s, e, np.searchsorted(s, offs)

    def distinct(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct words as bytes, word number of each piece, index of each text's first piece)."""
        joined, points, s, e, first = self.pieces(texts)
        prefix = textkit.prefix_hash(self.values[points])
        key = textkit.mix(textkit.span_hash(prefix, s, e))
        code, uniq = pd.factorize(key)
        at = np.zeros(len(uniq), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        words = [joined[a:b].encode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
        return words, code, first

    # --------------------------------------------------------------- merging

    def merge_word(self, word: bytes) -> list[int]:
        """Tokens of one word, by a heap of mergeable pairs: for words of any length."""
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        n = len(ids)
        nxt, prv, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (m := self.merges.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = made, -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One copy for each Python worker."""
    return WordBpe(path)
