"""Exact repeats of long byte strings across and within documents, removed but for their first occurrence.

A byte goes if some string of ``length`` bytes that covers it also starts earlier
(smaller id, or the same document further left). All windows of that length are
judged on the input.

1. Each window is filed under its smallest gram (``GRAM`` bytes, by hash; the
   leftmost of equals). That depends on the window's bytes alone, so equal windows
   are filed alike. Neighbouring windows mostly share their gram: they make one
   context. Contexts of a slice of a task that are equal, byte for byte, are merged
   before the shuffle, so strings that very many documents share are few rows.
   Grams that very many *different* contexts share, anywhere in the corpus, would
   bring these to one task: their windows are filed singly, each under its own bytes.
2. Contexts meet by gram. All that are not alone with theirs ask for their bytes.
3. These come together by gram. Of equal ones only the first one's windows can be
   first occurrences; the others are marked whole. Those that differ are
   concatenated, their suffixes sorted in two stages
   (:mod:`loomgraph.llm.suffix_array`), and where neighbours in that order share
   ``length`` bytes, all windows but the earliest are marked.
4. Marks meet the texts.

Hashes only bring windows together: no byte goes that was not compared.

Null text is empty. Rows that repeat an id with the same text are one document and
get the same result; with other texts they are told apart by 64 bits of a hash and
follow each other in its order.
Ids are integers; a null id comes last. A document of any length is cut into
segments that overlap by one window. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, suffix_array, textkit

LENGTH, GRAM = 100, 40
#: Windows of one segment, whose numbers fit in a processor's cache; a position in a segment and 40 bits of a hash share a 64-bit number.
SEGMENT = 1 << 16
#: A gram is common if about so many different contexts share it, or this share of all contexts if that is more.
COMMON, COMMON_SHARE = 100, 1e-6
#: A task reports grams that it meets in so many different contexts; it holds so many contexts at a time.
REPORTED, HELD = 3, 4_000_000
#: Bytes of contexts that are sorted at a time.
SORTED_AT_ONCE = 1 << 22
NO_ID = (1 << 63) - 1


def contexts(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, text, first window in the text, number of windows) of all contexts."""
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        n = len(part) - length + 1
        prefix = textkit.prefix_hash(textkit.BYTE_VALUES[part])
        _, inverse = textkit.powers(len(part) + 1)
        key = textkit.mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(part) - gram + 1])
        low_bits = np.uint64((1 << 24) - 1)
        least = (key & ~low_bits) | np.arange(len(key), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchor = (least[:n] & low_bits).astype(np.int64)
        start = low + np.arange(n)
        from_, to = np.searchsorted(offs, (low, low + n - 1), "right") - 1
        own = np.repeat(np.arange(from_, to + 1), np.diff(np.concatenate([[low], offs[from_ + 1 : to + 1], [low + n]])))
        inside = start + length <= offs[own + 1]
        first = inside.copy()
        first[1:] &= ~(inside[:-1] & (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1]))
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        context = textkit.mix(textkit.span_hash(prefix, s, e + length) + (e - s).astype(np.uint64) * np.uint64(textkit.BASE))
        found.append((key[anchor[s]].view(np.int64), context.view(np.int64), own[s], start[s] - offs[own[s]], e - s + 1))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaders(gram: np.ndarray, context: np.ndarray, n: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """For each row the first one, by ``place``, of those with its gram, context and size."""
    key = textkit.mix(gram.view(np.uint64) ^ textkit.mix(context.view(np.uint64) + n.astype(np.uint64)))
    order = np.lexsort((*place[::-1], key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return out


def runs(own: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, windows) of runs of rows that follow each other in one text."""
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return at, np.add.reduceat(n, at) if len(at) else n


def _numbers(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def common_grams(docs: DataFrame, length: int) -> np.ndarray:
    """Grams that very many different contexts share, sorted, from all documents.

    This only decides how windows are filed, for all tasks alike, not what the
    result is. A gram that no task meets in ``REPORTED`` contexts is not counted: it
    has fewer than ``REPORTED`` times the number of tasks. At most one gram in
    ``COMMON_SHARE`` of the contexts is common, which bounds what is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at = np.unique(textkit.mix(gram.view(np.uint64) ^ textkit.mix(context.view(np.uint64))), return_index=True)
            many, k = np.unique(gram[at], return_counts=True)
            on = k >= REPORTED
            # the number of all contexts goes without a gram
            return pa.RecordBatch.from_arrays([pa.array([*many[on].tolist(), None], pa.int64()), pa.array(np.append(k[on], len(at)))], names=["gram", "k"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offs in textkit.slices(batch.column(0), 1 << 20):
                gram, context, *_ = contexts(data, offs, length)
                held.append((gram, context))
                size += len(gram)
                if size > HELD:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)

    many = docs.select("text").mapInArrow(shared.thrifty(run), "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k")).where(F.col("gram").isNull() | (F.col("k") >= COMMON))
    many = shared.materialize(many, "grams")
    total = many.where("gram is null").first()
    bar = max(COMMON, (total["k"] if total else 0) * COMMON_SHARE)
    common = np.sort(np.array([r["gram"] for r in many.where(F.col("gram").isNotNull() & (F.col("k") >= bar)).select("gram").collect()], np.int64))
    shared.discard(many)
    return common


def _single_windows(data: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number within the row, hash) of each window of runs that begin at ``start``."""
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = start[row] + k
    prefix = textkit.prefix_hash(textkit.BYTE_VALUES[data])
    return row, k, textkit.mix(textkit.span_hash(prefix, at, at + length) ^ np.uint64(textkit.BASE)).view(np.int64)


def _contexts(docs: DataFrame, length: int, common: np.ndarray) -> DataFrame:
    """(gram, id, tag, place, n): n < 0 for runs of windows already known to be repeats.

    Windows of ``common`` grams are filed one by one, under their own hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tag = _numbers(batch, 0), _numbers(batch, 1)
            for a, _, data, offs in textkit.slices(batch.column(2), 1 << 22):
                gram, context, own, start, n = contexts(data, offs, length)
                split = np.isin(gram, common) if len(common) else np.zeros(len(gram), bool)
                if split.any():
                    row, k, window = _single_windows(data, (offs[own] + start)[split], n[split], length)
                    single = (window, window, own[split][row], start[split][row] + k, np.ones(len(row), np.int64))
                    cols = [np.concatenate([c[~split], x]) for c, x in zip((gram, context, own, start, n), single, strict=True)]
                    by = np.lexsort((cols[3], cols[2]))
                    gram, context, own, start, n = (c[by] for c in cols)
                doc, text = ids[a + own], tag[a + own]
                first = leaders(gram, context, n, doc, text, start)
                later = (doc != doc[first]) | (text != text[first]) | (start != start[first])
                # what is merged here is compared here
                at, raw = np.flatnonzero(later), data.tobytes()
                mine, its, size = (offs[own] + start)[at].tolist(), (offs[own] + start)[first[at]].tolist(), (n[at] + length - 1).tolist()
                later[at] = [raw[x : x + z] == raw[y : y + z] for x, y, z in zip(mine, its, size, strict=True)]
                at = np.flatnonzero(later)
                begin, windows = runs(own[at], start[at], n[at])
                begin = at[begin]
                # what is marked already needs no meeting with its gram, however common: it goes anywhere
                spread = textkit.mix(doc[begin].view(np.uint64) ^ textkit.mix(text[begin].view(np.uint64) ^ textkit.mix(start[begin].view(np.uint64))))
                cols = [np.concatenate([x[~later], y]) for x, y in ((gram, spread.view(np.int64)), (doc, doc[begin]), (text, text[begin]), (start, start[begin]), (n, -windows))]
                cols[4] = cols[4].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["gram", "id", "tag", "place", "n"])

    return docs.select("id", "tag", "text").mapInArrow(shared.thrifty(run), "gram long, id long, tag long, place long, n int")


def _meet(rows: DataFrame) -> DataFrame:
    """(ask, gram, id, tag, place, n): marks (ask false), and contexts that are not alone with their gram (ask true)."""
    names = ["ask", "gram", "id", "tag", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_meets = None, False
        for batch in batches:
            cols = [_numbers(batch, i) for i in range(5)]
            mark = cols[4] < 0
            if mark.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(mark.sum()), bool)), *(pa.array(c[mark]) for c in cols[:4]), pa.array(-cols[4][mark])], names=names)
            cols = [c[~mark] for c in cols]
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            if not len(cols[0]):
                continue
            same = cols[0][1:] == cols[0][:-1]
            meets = np.append(False, same) | np.append(same, False)
            meets[0] |= last_meets
            on = meets[:-1]
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(on.sum()), bool)), *(pa.array(c[:-1][on]) for c in cols)], names=names)
            last, last_meets = [c[-1:] for c in cols], bool(meets[-1])
        if last is not None and last_meets:
            yield pa.RecordBatch.from_arrays([pa.array([True]), *(pa.array(c) for c in last)], names=names)

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(shared.thrifty(run), "ask boolean, gram long, id long, tag long, place long, n int")


def _cut_out(asked: DataFrame, length: int) -> DataFrame:
    """(gram, id, tag, place, bytes): texts of the contexts that are asked for."""

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], names=["gram", "id", "tag", "place", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total = [[], [], [], [], []], 0
        for batch in batches:
            for i in range(len(batch)):
                doc, tag, text, asks = (batch.column(k)[i] for k in range(4))
                doc, tag, raw = doc.as_py(), tag.as_py(), zlib.decompress(text.as_buffer())
                asks = asks.values
                grams, places, sizes = (asks.field(k).to_pylist() for k in range(3))
                out[0] += grams
                out[1] += [doc] * len(grams)
                out[2] += [tag] * len(grams)
                out[3] += places
                out[4] += [raw[s : s + n + length - 1] for s, n in zip(places, sizes, strict=True)]
                total += len(grams)
                if total > 50_000:
                    yield batch_of(out)
                    out, total = [[], [], [], [], []], 0
        if total:
            yield batch_of(out)

    return asked.mapInArrow(shared.thrifty(run), "gram long, id long, tag long, place long, bytes binary")


def sorted_marks(texts: list[bytes], doc: np.ndarray, tag: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of runs of windows that also start earlier in some context."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    begin = np.cumsum(size + 1) - size - 1
    raw[begin + size] = 0
    words = suffix_array.packed(raw)
    order = suffix_array.suffix_array(raw, length, words)
    own = np.repeat(np.arange(len(texts)), size + 1)
    at = order[order - begin[own[order]] + length <= size[own[order]]]
    alike = suffix_array.common_at_least(words, at[:-1], at[1:], length)
    group = np.concatenate([[0], np.cumsum(~alike)])
    context = own[at]
    offset = at - begin[context]
    by = np.lexsort((place[context] + offset, tag[context], doc[context], group))
    group, context, offset = group[by], context[by], offset[by]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else np.zeros(0, np.int64)
    later = (doc[context] != doc[context[head]]) | (tag[context] != tag[context[head]]) | (place[context] + offset != place[context[head]] + offset[head])
    context, offset = context[later], offset[later]
    by = np.lexsort((offset, context))
    context, offset = context[by], offset[by]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
    start = np.flatnonzero(new)
    return context[start], offset[start], np.diff(np.append(start, len(context)))


def _sort(cut: DataFrame, length: int) -> DataFrame:
    """(id, tag, place, n): marks. Contexts of a gram come together, first ones first: equal ones are told by their bytes, different ones go into sorted suffixes."""
    names = ["id", "tag", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[bytes, tuple[int, int, int]]]) -> pa.RecordBatch:
            doc, tag, place = (np.array([h[1][i] for h in held], np.int64) for i in range(3))
            context, offset, n = sorted_marks([h[0] for h in held], doc, tag, place, length)
            return pa.RecordBatch.from_arrays([pa.array(doc[context]), pa.array(tag[context]), pa.array(place[context] + offset), pa.array(n.astype(np.int32))], names=names)

        held: list[tuple[bytes, tuple[int, int, int]]] = []
        kinds: dict[bytes, tuple[int, int, int]] = {}
        total, last = 0, None
        for batch in batches:
            marks: list[list[int]] = [[], [], [], []]
            for gram, *place, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram != last:
                    if len(kinds) > 1:
                        held += kinds.items()
                        total += sum(map(len, kinds))
                        if total > SORTED_AT_ONCE:
                            yield flush(held)
                            held, total = [], 0
                    kinds, last = {}, gram
                where = tuple(place)
                if kinds.setdefault(raw, where) != where:
                    for column, value in zip(marks, (*where, len(raw) - length + 1), strict=True):
                        column.append(value)
            if marks[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in marks[:3]), pa.array(marks[3], pa.int32())], names=names)
        if len(kinds) > 1:
            held += kinds.items()
        if held:
            yield flush(held)

    return cut.repartition("gram").sortWithinPartitions("gram", "id", "tag", "place").mapInArrow(shared.thrifty(run), "id long, tag long, place long, n int")


def covered(n_bytes: int, marks: list[dict] | None, length: int) -> np.ndarray:
    """Per byte: whether a marked window covers it."""
    change = np.zeros(n_bytes + 1, np.int32)
    if marks:
        place = np.array([m["place"] for m in marks], np.int64)
        n = np.array([m["n"] for m in marks], np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + n + length - 1, -1)
    return np.cumsum(change)[:-1] > 0


def _apply(joined: DataFrame, length: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, digest, kept_text = [], [], [], [], []
            for text, marks in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = zlib.decompress(text.as_buffer())
                gone = covered(len(raw), marks, length)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if marks else raw
                n_bytes.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(digest, pa.string()), pa.array(kept_text, pa.string()), *(batch.column(i) for i in range(4, batch.num_columns))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *batch.schema.names[4:]])

    extra = "".join(f", `{c}` {t}" for c, t in joined.dtypes[4:])
    return joined.mapInArrow(shared.thrifty(run), f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string{extra}")


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_columns: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept_text; with ``keep_columns`` also ``row``, all of the row's columns but the text.

    kept_text is there with ``keep_columns`` only: what is left, without the bytes of characters cut in two.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    row = [F.struct(*rest).alias("row")] if keep_columns else [F.col(id_col).alias("row")]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    # where no id repeats, ids alone tell texts apart, and what is sent is shorter
    repeated = not docs.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    docs = docs.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    parts = shared.shuffle_partitions(df.sparkSession)
    compared = shared.materialize(_meet(_contexts(docs, length, common_grams(docs, length))), "contexts")
    shared.release(df.sparkSession)
    asks = compared.where("ask").groupBy("id", "tag").agg(F.collect_list(F.struct("gram", "place", "n")).alias("asks"))
    cut = _cut_out(_packed(docs.select("id", "tag", "text"), parts).join(asks, ["id", "tag"]).select("id", "tag", "text", "asks"), length)
    marks = shared.materialize(_sort(cut, length), "marks")
    del asks, cut
    shared.release(df.sparkSession)
    marks = compared.where("not ask").select("id", "tag", "place", "n").unionByName(marks)
    marks = marks.groupBy("id", "tag").agg(F.collect_list(F.struct("place", "n")).alias("marks"))
    joined = _packed(docs, parts).join(marks, ["id", "tag"], "left").select("id", "tag", "text", "marks", "row")
    return _apply(joined, length, keep_columns)


def _packed(docs: DataFrame, parts: int) -> DataFrame:
    """The documents by (id, tag), with texts compressed for the way there."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([zlib.compress(t.as_buffer(), 1) for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    fields = ", ".join(f"`{c}` {'binary' if c == 'text' else t}" for c, t in docs.dtypes)
    return docs.mapInArrow(shared.thrifty(run), fields).repartition(parts, "id", "tag")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    return find_repeats(df, id_col, text_col, length).select(F.col("row").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``df`` with repeats taken out of their texts; other columns as they were."""
    found = find_repeats(df, id_col, text_col, length, keep_columns=True)
    return found.select(*(F.col("kept_text").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))
