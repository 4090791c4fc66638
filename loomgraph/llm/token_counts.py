"""Token counts by a compiled finite-state tokenizer.

A text is cut into chunks. The map of a chunk says what it does to a run of the
transducer (:mod:`loomgraph.llm.transducer`, whose transitions carry counts) that
enters it in any state: the state it leaves in and the tokens emitted on the way.
Only the word that is open at the entry depends on the entry's state; all words
after it are counted for good, and the state at the end is then the same whatever
came before. Such maps compose associatively, so a prefix scan joins the chunks
of a text in any bracketing. Chunks end where the splitting of words can't depend
on what follows.

Null and empty texts have 0 tokens. A text of any length is read whole, chunk by
chunk. Repeated rows give repeated results; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import shared, textkit, transducer, wordbpe

CHUNK = 1 << 16


@dataclass(frozen=True)
class Run:
    """Where a run is: inside no word, or after all bytes but ``last`` of a word in ``state``. The last byte waits, as it is another symbol at the end of a word."""

    state: int = 0
    last: int = -1


OUTSIDE = Run()


@dataclass(frozen=True)
class ChunkMap:
    """From the state at the entry to the state at the exit and the tokens emitted.

    ``head``: bytes that go on with the word open at the entry. ``leaves``: the state
    at the exit; None: that word is still open there, so it depends on the entry's.
    ``count``: tokens of the words after it.
    """

    head: bytes
    leaves: Run | None
    count: int

    def __call__(self, machine: transducer.Transducer, run: Run) -> tuple[Run, int]:
        if self.head:
            data = bytes([run.last]) + self.head if run.last >= 0 else self.head
            state, n = machine.through(run.state, data[:-1])
            run = Run(state, data[-1])
        else:
            n = 0
        if self.leaves is None:
            return run, n
        return self.leaves, n + self.count + (machine.over(run.state, run.last) if run.last >= 0 else 0)

    def then(self, other: ChunkMap, machine: transducer.Transducer) -> ChunkMap:
        if self.leaves is None:
            return ChunkMap(self.head + other.head, other.leaves, other.count)
        leaves, n = other(machine, self.leaves)
        return ChunkMap(self.head, leaves, self.count + n)


def cuts(bpe: wordbpe.WordBpe, text: str, size: int) -> list[tuple[int, bool]]:
    """(place, whether a word is open there) of the chunks' beginnings: at ``size`` characters or the next place where no later character decides how words split."""
    kind = bpe.kinds(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(kind)
    before = kind[:-1]
    after = kind[1:]
    apart = (before == wordbpe.SPACE) | (after == wordbpe.SPACE) | (before == wordbpe.NUMBER) | (after == wordbpe.NUMBER)
    quote = np.concatenate([[False] * 3, kind == wordbpe.APOSTROPHE])
    near = quote[3 : n + 2] | quote[2 : n + 1] | quote[1:n]  # among the three characters before the cut
    within = (before == wordbpe.LETTER) & (after == wordbpe.LETTER) & ~near
    within |= (before == wordbpe.OTHER) & (after == wordbpe.OTHER)
    places = np.flatnonzero(apart | within) + 1
    out, at = [(0, False)], 0
    while (k := int(np.searchsorted(places, at + size))) < len(places):
        at = int(places[k])
        out.append((at, bool(within[at - 1])))
    return out


def chunk_maps(machine: transducer.Transducer, text: str, size: int) -> list[ChunkMap]:
    """The maps of the chunks of a normalised text, all from their own characters alone."""
    begins = cuts(machine.bpe, text, size)
    edges = [*begins, (len(text), False)]
    chunks = [text[a:b] for (a, _), (b, _) in zip(edges, edges[1:], strict=False)]
    joined, _, s, e, first = machine.bpe.pieces(chunks)
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in chunks])])
    words = [joined[a:b].encode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    closed, plan = [], []
    for k, ((_, opens), (_, stays)) in enumerate(zip(edges, edges[1:], strict=False)):
        a, b = int(first[k]), int(first[k + 1])
        head = words[a] if opens else b""
        a += opens
        if opens and stays and a == b and e[a - 1] == base[k + 1] - 1:
            plan.append((head, None, a, a))
            continue
        tail = words[b - 1] if stays else b""
        b -= stays
        plan.append((head, tail, a, b))
        closed += words[a:b]
    n = np.concatenate([[0], np.cumsum(machine.counts(closed))])
    out, at = [], 0
    for head, tail, a, b in plan:
        if tail is None:
            out.append(ChunkMap(head, None, 0))
            continue
        leaves, more = OUTSIDE, 0
        if tail:
            state, more = machine.through(0, tail[:-1])
            leaves = Run(state, tail[-1])
        out.append(ChunkMap(head, leaves, int(n[at + b - a] - n[at]) + more))
        at += b - a
    return out


def scan(maps: list[ChunkMap], machine: transducer.Transducer) -> ChunkMap:
    """Composition of all maps, in rounds of neighbouring pairs."""
    while len(maps) > 1:
        paired = [a.then(b, machine) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = paired + maps[len(paired) * 2 :]
    return maps[0]


def count_long(machine: transducer.Transducer, text: str, chunk: int) -> int:
    """Tokens of one normalised text by its chunks' maps."""
    leaves, n = scan(chunk_maps(machine, text, chunk), machine)(machine, OUTSIDE)
    return n + (machine.over(leaves.state, leaves.last) if leaves.last >= 0 else 0)


def count_texts(machine: transducer.Transducer, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text. Texts of one chunk are counted together: their maps are applied to the state outside of words."""
    short, owner, total = [], [], np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        parts, specials = machine.bpe.parts(text)
        total[row] = len(specials)
        for part in parts:
            if len(part) > chunk:
                total[row] += count_long(machine, part, chunk)
            else:
                short.append(part)
                owner.append(row)
    words, code, first = machine.bpe.distinct(short)
    np.add.at(total, np.array(owner, np.int64), textkit.sums(machine.counts(words)[code], first))
    return total


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer.load(tokenizer_path)
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(1), 1 << 22):
                raw = data.tobytes()
                edge = offs.tolist()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(edge, edge[1:], strict=False)]
                n = count_texts(machine, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(shared.thrifty(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
