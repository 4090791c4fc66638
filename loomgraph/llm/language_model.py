"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class after the tokens before it, times
that of the token within its class. Classes are the most frequent words (one
each), the end of a text, and groups of other words by their last two bytes. A
softmax predicts the class; within a group another one predicts the slot: the
group's most frequent words have one each, all others share some. Both see n-gram
features (the word before; the classes before) and skip features (the word before
that; the classes further back), hashed into weight tables whose rows grow with the
training tokens, up to a bound that keeps a table in a task's memory. Words that
share a slot go by their smoothed counts.

Weights are learnt by gradient updates in synchronous rounds. The gradient of a
weight is how often the model expects its feature and class together minus how
often they occur, summed over all training documents by all tasks; the step for
each weight is set by the ratio of the two. So the model is a function of the rows
alone, however they are split. In the first round all weights are 0 and what is
expected follows from the counts.

Counts are exact, over all training documents: the ``HEAD`` most frequent words are
a table of bounded size in every task; all other words, rare by construction, meet
their counts by a shuffle.

Null text is empty: one end token. Rows without id are learnt from. Repeated rows
count as often as they occur and get equal scores. Without any training document
every token is unknown. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, textkit
from loomgraph.llm.ranking import remainder

#: Words with their counts in every task; words with a class of their own; groups of the other words.
HEAD, SINGLES, FORMS = 524_288, 40, 23
END_CLASS = SINGLES
CLASSES = SINGLES + 1 + FORMS
#: Slots of a group: words that have one each, and slots that the others share.
OWN_SLOTS, SHARED_SLOTS = 48, 16
PAIR_ROWS = CLASSES * CLASSES
#: Rows for the word before, half as many for the one before that: one for so many training tokens, within bounds.
TOKENS_A_ROW, LEAST_WORD_ROWS, MOST_WORD_ROWS = 1024, 1024, 65_536
#: How much of the whole step each round of updates takes, and how much of the prior expectation is added to both sides of every ratio.
STEPS, PRIOR, STEEPEST = (0.5, 0.25), 20.0, 10.0
#: Tokens whose outcomes are worked out together: arrays of up to half a MB, which stay in a processor's cache.
BATCH, SMOOTH = 1024, 0.1
ROWS_A_BLOCK = 2048
#: Bytes of text that a task looks at together, and that it cuts into words at a time: arrays of up to 2 MB, which the C library reuses; larger ones are mapped anew each time.
SLICE, PIECE = 1 << 18, 1 << 17
#: Every task sends its sums of the whole table: files are learnt from together, up to about so many tokens.
TOKENS_A_TASK = 32_000_000
#: Word counts that a task holds before it sends them on.
HELD = 600_000


def layout(tokens: int) -> np.ndarray:
    """Where the parts of the weight tables begin and end, for so many training tokens: four of the classes' table, three of the slots'."""
    rows = 1 << max(tokens // TOKENS_A_ROW, 1).bit_length() - 1
    rows = min(max(rows, LEAST_WORD_ROWS), MOST_WORD_ROWS)
    return np.cumsum([0, rows, PAIR_ROWS, rows // 2, PAIR_ROWS, rows, PAIR_ROWS, rows // 2])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, forms, index of each text's first word)."""
    found, first, a = [], [np.zeros(1, np.int64)], 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + PIECE, "right")) - 1)
        *words, begin = _tokens(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        found.append(words)
        first.append(begin[1:] + first[-1][-1])
        a = b
    word, form = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return word, form, np.concatenate(first)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = textkit.word_spans(data, offs)
    prefix = textkit.prefix_hash(textkit.FOLDED_VALUES[data])
    word = textkit.mix(textkit.span_hash(prefix, s, e) + (e - s).astype(np.uint64))
    tail = textkit.mix(textkit.span_hash(prefix, np.maximum(s, e - 2), e))
    return word, (tail % np.uint64(FORMS)).astype(np.int64), first


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the head
    log_count: np.ndarray  # log10(count + SMOOTH)
    met: np.ndarray  # whether it occurs in training documents
    place: np.ndarray  # class of its own below END_CLASS, or slot of its own above it, or -1
    total: int
    distinct: int
    ends: int
    log_total: np.ndarray  # log10 of each class's, and then each group's slots', smoothed total
    class_share: np.ndarray
    slot_share: np.ndarray  # groups x slots

    @property
    def offsets(self) -> np.ndarray:
        return layout(self.total)

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head, whether it is there)."""
        if not len(self.words):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return at, self.words[at] == word

    def __post_init__(self) -> None:
        own = np.flatnonzero(self.place >= 0)  # a small table, which stays in the processor's cache
        self.placed, self.their_place = np.append(self.words[own], np.uint64(0)), np.append(self.place[own], -1)

    def outcomes(self, word: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, slot or -1) of each word."""
        at = np.searchsorted(self.placed[:-1], word)  # beyond the end is the last one, which has no place
        place = np.where(self.placed[at] == word, self.their_place[at], -1)
        slot = np.where(place > END_CLASS, place - END_CLASS - 1, OWN_SLOTS + (word % np.uint64(SHARED_SLOTS)).astype(np.int64))
        single = (place >= 0) & (place < END_CLASS)
        return np.where(single, place, END_CLASS + 1 + form), np.where(single, -1, slot)

    def classes(self, word: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, slot or -1, place in the head, whether it is there) of each word."""
        code, uniq = pd.factorize(word)  # far fewer look-ups
        at, found = self.look_up(uniq.astype(np.uint64))
        return *self.outcomes(word, form), at[code], found[code]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, form, n, everywhere) over rows (held_out, text): how often each word occurs in training documents, and in all."""

    def batch_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        code, uniq = pd.factorize(np.concatenate([h[0] for h in held]))
        form, n = np.zeros(len(uniq), np.int32), np.zeros((2, len(uniq)), np.int64)
        form[code] = np.concatenate([h[1] for h in held])
        for k in (0, 1):
            np.add.at(n[k], code, np.concatenate([h[2 + k] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(uniq.astype(np.uint64).view(np.int64)), pa.array(form), pa.array(n[0]), pa.array(n[1])], names=["word", "form", "n", "everywhere"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            learnt = ~batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offs in textkit.slices(batch.column(1), SLICE):
                word, form, first = tokens(data, offs)
                code, uniq = pd.factorize(word)
                of = np.zeros(len(uniq), np.int32)
                of[code] = form
                n = np.bincount(code[learnt[a:b][textkit.owner(first)]], minlength=len(uniq))
                held.append((uniq.astype(np.uint64), of, n, np.bincount(code, minlength=len(uniq))))
                size += len(uniq)
                if size > HELD:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    found = docs.select("held_out", "text").mapInArrow(shared.thrifty(run), "word long, form int, n long, everywhere long")
    return found.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: all that are more frequent than a bar, and of those at the bar as many as there is room for, by a hash."""
    step = F.when(F.col("everywhere") < 1024, F.col("everywhere")).otherwise(1024 + F.floor(F.log2("everywhere") * 16))
    room, bar, share = most, 0, 1.0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["step"]):  # at most some 2,000 steps
        bar = r["step"]
        if r["v"] > room:
            share = max(0.0, (room - 4 * np.sqrt(room)) / r["v"])
            break
        room -= r["v"]
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return counts.where((step > bar) | ((step == bar) & chosen))


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD) -> Vocabulary:
    """From exact counts: what every task needs, of bounded size."""
    slot = F.pmod(F.col("word"), F.lit(SHARED_SLOTS)).cast("int")  # the same for signed and unsigned numbers, as 16 divides 2**64
    cells = counts.where("n > 0").groupBy("form", slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # FORMS * SHARED_SLOTS rows at most
    top = most_frequent(counts, head).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True])
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    n, form = top["n"].to_numpy(np.int64), top["form"].to_numpy(np.int64)
    slots = OWN_SLOTS + SHARED_SLOTS
    total, distinct = np.zeros((FORMS, slots)), np.zeros((FORMS, slots))
    for r in cells:
        total[r["form"], OWN_SLOTS + r["slot"]], distinct[r["form"], OWN_SLOTS + r["slot"]] = r["n"], r["v"]
    single = (np.arange(len(top)) < SINGLES) & (n > 0)
    rank = pd.Series(np.where(single, -1, form)).groupby(np.where(single, -1, form)).cumcount().to_numpy() if len(top) else np.zeros(0, np.int64)
    own = ~single & (rank < OWN_SLOTS) & (n > 0)
    place = np.where(single, np.arange(len(top)), np.where(own, END_CLASS + 1 + rank, -1))
    alone = np.zeros(SINGLES)
    alone[: single.sum()] = n[single]
    for moved in (single, own):
        np.subtract.at(total, (form[moved], OWN_SLOTS + (words[moved] % np.uint64(SHARED_SLOTS)).astype(np.int64)), n[moved])
        np.subtract.at(distinct, (form[moved], OWN_SLOTS + (words[moved] % np.uint64(SHARED_SLOTS)).astype(np.int64)), 1)
    total[form[own], rank[own]], distinct[form[own], rank[own]] = n[own], 1
    order = np.argsort(words)
    whole = np.concatenate([alone, [ends], total.sum(1)])
    slot_total = total + SMOOTH * distinct
    slot_total[:, OWN_SLOTS:] += SMOOTH  # room for words not met
    log_total = np.log10(np.concatenate([alone + SMOOTH, [ends + SMOOTH], np.maximum(slot_total, SMOOTH).ravel()]))
    slot_share = total + 0.5
    return Vocabulary(
        words[order],
        np.log10(n[order] + SMOOTH),
        n[order] > 0,
        place[order],
        int(whole.sum()),
        int(sum(r["v"] for r in cells)) + int(ends > 0),
        ends,
        log_total,
        (whole + 1) / (whole.sum() + CLASSES),
        slot_share / slot_share.sum(1, keepdims=True),
    )


@dataclass
class Features:
    """Of the tokens of some texts; every text ends with an end token."""

    rows: np.ndarray  # tokens x 4: rows of the classes' table
    kind: np.ndarray  # class of each token
    within: np.ndarray  # tokens that belong to a group
    slot_rows: np.ndarray  # those x 3: rows of the slots' table
    slot: np.ndarray  # their slots
    begin: np.ndarray  # index of each text's first token


def features(word: np.ndarray, kind: np.ndarray, slot: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> Features:
    n_texts, count = len(first) - 1, np.diff(first)
    begin = first[:-1] + np.arange(n_texts)  # an end token more for each text before
    size = int(first[-1]) + n_texts
    place = np.arange(len(word)) + np.repeat(np.arange(n_texts), count)
    w, c, own = np.zeros(size, np.uint64), np.full(size, END_CLASS, np.int64), np.full(size, -1, np.int64)
    w[place], c[place], own[place] = word, kind, slot
    at = np.arange(size) - np.repeat(begin, count + 1)

    def back(x: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(size, none, x.dtype)
        out[k:] = x[:-k] if k < size else x[:0]
        out[at < k] = none
        return out

    def hashed(key: np.ndarray, part: int) -> np.ndarray:
        return offsets[part] + (textkit.mix(key) % np.uint64(offsets[part + 1] - offsets[part])).astype(np.int64)

    w1, w2, c1 = back(w, 1, 0), back(w, 2, 0) + np.uint64(textkit.BASE), back(c, 1, END_CLASS)
    rows = np.empty((size, 4), np.int64)
    rows[:, 0] = hashed(w1, 0)
    rows[:, 1] = offsets[1] + c1 * CLASSES + back(c, 2, END_CLASS)
    rows[:, 2] = hashed(w2, 2)
    rows[:, 3] = offsets[3] + back(c, 3, END_CLASS) * CLASSES + back(c, 4, END_CLASS)
    within = np.flatnonzero(own >= 0)
    group = c[within].astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47)
    slot_rows = np.empty((len(within), 3), np.int64)
    slot_rows[:, 0] = hashed(w1[within] ^ group, 4)
    slot_rows[:, 1] = offsets[5] + c[within] * CLASSES + c1[within]
    slot_rows[:, 2] = hashed(w2[within] ^ group, 6)
    return Features(rows, c, within, slot_rows - offsets[4], own[within], np.append(begin, size))


def folded(voc: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """Weights with the biases in the rows of class pairs, of which each token has one in either table."""
    out, offsets = weights.copy(), voc.offsets
    out[offsets[1] : offsets[2]] += np.log(voc.class_share).astype(np.float32)
    groups = out[offsets[5] : offsets[6]].reshape(CLASSES, CLASSES, -1)[END_CLASS + 1 :]
    groups += np.log(voc.slot_share).astype(np.float32)[:, None, :]
    return out


def outcomes(table: np.ndarray, rows: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sums of the rows of each token, in the first part of ``room``: unnormalised log probabilities (base e). Weights are at most STEEPEST, so no exponential overflows."""
    z, more = room[:, : len(rows)]
    np.take(table, rows[:, 0], axis=0, mode="clip", out=z)
    for k in range(1, rows.shape[1]):
        z += np.take(table, rows[:, k], axis=0, mode="clip", out=more)
    return z


@dataclass
class Sums:
    """Of one task: rows of both tables, the slots' rows after the classes', x columns."""

    offsets: np.ndarray
    width: int

    def __post_init__(self) -> None:
        # counts of what occurs are whole numbers
        self.places, self.values = np.empty((BATCH, CLASSES // 2), np.int64), np.empty((BATCH, CLASSES))
        self.exact = np.zeros((int(self.offsets[-1]), self.width), np.float64 if self.width == CLASSES else np.uint32)

    @property
    def table(self) -> np.ndarray:
        return self.rows(0, len(self.exact))

    def rows(self, a: int, b: int) -> np.ndarray:
        """As they are sent."""
        return self.exact[a:b].astype(np.float32)

    def observed(self, x: Features) -> None:
        """How often each feature goes with each outcome, and how often the slots' features go with each group."""
        flat, size, one = self.exact.reshape(-1), self.exact.shape[1], self.exact.dtype.type(1)
        for k in range(x.rows.shape[1]):
            np.add.at(flat, x.rows[:, k] * size + x.kind, one)
        group = x.kind[x.within] - END_CLASS - 1 + CLASSES
        for k in range(x.slot_rows.shape[1]):
            row = (self.offsets[4] + x.slot_rows[:, k]) * size
            np.add.at(flat, row + x.slot, one)
            np.add.at(flat, row + group, one)

    def expected(self, rows: np.ndarray, chances: np.ndarray, part: int) -> None:
        """How often the model expects it, for rows of one table; ``part`` is its first part in the layout."""
        half = CLASSES // 2
        flat, column = self.exact.reshape(-1).view(np.complex128), np.arange(half)  # two columns go as one complex number: half as many places to name
        for a in range(0, len(rows), BATCH):
            mine = rows[a : a + BATCH]
            values, places = self.values[: len(mine)], self.places[: len(mine)]
            values[:] = chances[a : a + BATCH]
            for k in range(mine.shape[1]):
                np.add(((mine[:, k] + self.offsets[part]) * half)[:, None], column, out=places)
                np.add.at(flat, places.reshape(-1), values.reshape(-1).view(np.complex128))


@dataclass
class Model:
    voc: Vocabulary
    table: np.ndarray  # weights of both tables, with the biases

    def blocks(self, x: Features) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first part of the table, tokens, rows, unnormalised log probabilities) of the classes of all tokens and then of the slots of those in groups; tokens with one word before come together, so few rows are in use at a time. The last array is written over by the next block."""
        split, room = self.voc.offsets[4], np.empty((2, BATCH, CLASSES), np.float32)
        for part, rows, table in ((0, x.rows, self.table[:split]), (4, x.slot_rows, self.table[split:])):
            order = np.argsort(rows[:, 0].astype(np.uint16), kind="stable")  # no more than MOST_WORD_ROWS: short keys sort by radix
            for a in range(0, len(rows), BATCH):
                at = order[a : a + BATCH]
                mine = np.take(rows, at, axis=0)
                yield part, at, mine, outcomes(table, mine, room)

    def token_logs(self, x: Features) -> np.ndarray:
        """Of each token: log10 probability of its class and slot, less the log10 of what the slot's words share."""
        out, within, ones = np.empty(len(x.rows)), np.empty(len(x.slot)), np.ones(CLASSES, np.float32)
        for part, at, _, z in self.blocks(x):
            mine = z[np.arange(len(z)), (x.slot if part else x.kind)[at]]
            (within if part else out)[at] = mine - np.log(np.exp(z, out=z) @ ones)
        out[x.within] += within
        cell = np.where(x.kind <= END_CLASS, x.kind, 0)
        cell[x.within] = END_CLASS + 1 + (x.kind[x.within] - END_CLASS - 1) * (OWN_SLOTS + SHARED_SLOTS) + x.slot
        return out / np.log(10) - self.voc.log_total[cell]


def _sums(docs: DataFrame, voc: Vocabulary, model: Model | None) -> DataFrame:
    """(block, sums) of every task's rows (text): of what occurs or, with a model, of what it expects."""
    offsets, width = voc.offsets, CLASSES + (FORMS if model is None else 0)
    context = docs.sparkSession.sparkContext
    # of bounded size; apart from the function, so that a worker has it once
    sent = context.broadcast((voc, None if model is None else model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, table = sent.value
        sums, learnt = Sums(offsets, width), None if table is None else Model(voc, table)
        ones = np.ones(CLASSES, np.float32)
        for batch in batches:
            for _, _, data, offs in textkit.slices(batch.column(0), SLICE):
                word, form, first = tokens(data, offs)
                x = features(word, *voc.outcomes(word, form), first, offsets)
                if learnt is None:
                    sums.observed(x)
                else:
                    for part, _, rows, z in learnt.blocks(x):
                        chances = np.exp(z, out=z)
                        chances *= (1 / (chances @ ones))[:, None]
                        sums.expected(rows, chances, part)
        for b in range(-(-int(offsets[-1]) // ROWS_A_BLOCK)):
            part = sums.rows(b * ROWS_A_BLOCK, (b + 1) * ROWS_A_BLOCK)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "sums"])

    tasks = max(context.defaultParallelism, -(-voc.total // TOKENS_A_TASK))
    return docs.select("text").coalesce(tasks).mapInArrow(shared.thrifty(run), "block int, sums binary")


def _update(sums: DataFrame, voc: Vocabulary, state: DataFrame | None, step: float) -> DataFrame:
    """(block, occurs, weights) after one round: blocks of rows are summed and updated each by itself."""
    split, size = int(voc.offsets[4]), int(voc.offsets[-1])
    blocks = -(-size // ROWS_A_BLOCK)
    class_share, slot_share = voc.class_share, voc.slot_share

    def finish(b: int, sums: np.ndarray, occurs: np.ndarray | None, weights: np.ndarray | None) -> pa.RecordBatch:
        sums = sums.reshape(min(ROWS_A_BLOCK, size - b * ROWS_A_BLOCK), -1)
        of_class = (np.arange(len(sums)) + b * ROWS_A_BLOCK < split)[:, None]
        share = np.where(of_class, class_share, 1 / CLASSES)
        if occurs is None:  # weights of 0: the bias is all that says what to expect
            occurs = sums[:, :CLASSES]
            weights = np.zeros_like(occurs)
            expects = np.where(of_class, occurs.sum(1, keepdims=True) * share, sums[:, CLASSES:] @ slot_share)
        else:
            expects = sums
        # against the gradient (expects - occurs): this is the step that meets it where a weight alone decides
        change = np.log((occurs + PRIOR * share) / (expects + PRIOR * share))
        weights = np.clip(weights + step * change, -STEEPEST, STEEPEST)
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (occurs, weights))], names=["block", "occurs", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        before: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, sums, *old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is None:
                    before[b] = [np.frombuffer(x, np.float32).reshape(-1, CLASSES).astype(np.float64) for x in old]
                elif b in total:
                    total[b] += np.frombuffer(sums, np.float32)
                else:
                    total[b] = np.frombuffer(sums, np.float32).astype(np.float64)
        for b, sums in total.items():
            yield finish(b, sums, *(before.get(b) or (None, None)))

    none = F.lit(None).cast("binary")
    rows = sums.select("block", "sums", none.alias("occurs"), none.alias("weights"))
    if state is not None:
        rows = rows.unionByName(state.select("block", none.alias("sums"), "occurs", "weights"))
    return rows.repartition(blocks, "block").mapInArrow(shared.thrifty(run), "block int, occurs binary, weights binary")


def learn(docs: DataFrame, voc: Vocabulary, steps: tuple[float, ...] = STEPS) -> Model:
    """Rounds of updates from weights of 0; every round sees all rows. What comes to the driver is the weights, a table of bounded size."""
    weights = np.zeros((int(voc.offsets[-1]), CLASSES), np.float32)
    model, state = None, None
    for step in steps if voc.total else ():
        before, state = state, shared.materialize(_update(_sums(docs, voc, model), voc, state, step), "weights")
        if before is not None:
            shared.discard(before)
        shared.release(docs.sparkSession)
        found = state.select("block", "weights").toArrow()
        for b, rows in zip(found["block"].to_pylist(), found["weights"], strict=True):
            part = np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, CLASSES)
            weights[b * ROWS_A_BLOCK : b * ROWS_A_BLOCK + len(part)] = part
        model = Model(voc, folded(voc, weights))
    if state is not None:
        shared.discard(state)
    return model or Model(voc, folded(voc, weights))


def _score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(row, id, held_out, n_tokens, n_known, head_log, class_log, rare): all but what rare words add; ``rare`` are their hashes."""
    sent = docs.sparkSession.sparkContext.broadcast((model.voc, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        voc = model.voc
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(2), SLICE):
                word, form, first = tokens(data, offs)
                kind, slot, at, found = voc.classes(word, form)
                x = features(word, kind, slot, first, voc.offsets)
                head = np.where(found, voc.log_count[at] if len(voc.words) else 0.0, 0.0)
                known = found & (voc.met[at] if len(voc.words) else False)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[first].astype(np.int32)), pa.array(word[~found].view(np.int64)))
                cols = [pa.array(np.diff(x.begin)), pa.array(textkit.sums(known.astype(np.int64), first) + int(voc.ends > 0)), pa.array(textkit.sums(head, first) + np.log10(voc.ends + SMOOTH)), pa.array(textkit.sums(model.token_logs(x), x.begin))]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(b - a)), *(batch.column(i)[a:b] for i in range(2)), *cols, rare], names=["row", "id", "held_out", "n_tokens", "n_known", "head_log", "class_log", "rare"])
                row += b - a

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(shared.thrifty(run), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, head_log double, class_log double, rare array<long>")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 10, fold: int = 0, head: int = HEAD, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt without the rows of one fold."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(remainder(id_col, divisor) == fold, F.lit(False)).alias("held_out"))
    training = docs.where("not held_out")
    counts = shared.materialize(count_words(docs), "words")
    model = learn(training, vocabulary(counts, training.count(), head), steps)
    voc = model.voc

    scored = shared.materialize(_score_texts(docs, model), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + SMOOTH)).alias("rare_log"), F.count_if(F.col("n") > 0).alias("rare_known"))
    out = scored.drop("rare").join(rare, "row", "left")
    counted = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    whole = float(np.log10(voc.total + SMOOTH * (voc.distinct + 1)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (counted + F.col("class_log")).alias("score"),
    )
