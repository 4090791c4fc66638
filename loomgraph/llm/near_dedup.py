"""MinHash near-duplicates of whole texts, with verified links and exact components.

A document is the set of its distinct ``width``-word shingles (fewer words: all
of them as one; no words: the empty set, linked with nothing). Two documents are
linked if 100 * intersection >= percent * union.

1. Documents with equal sets are one class, kept by its smallest id.
2. Each class gets a SuperMinHash signature: every shingle draws a random
   permutation of the components, and its rank in it plus a random fraction is
   its value there; a component keeps the smallest value. Going through the
   ranks in step, a document is done as soon as all components have a value, as
   later ranks are larger: few steps for all but tiny sets.
3. Bands of the signature meet in buckets; each member is tied to the smallest
   one of its bucket. That gives candidate groups, a superset of the components.
4. Within groups, links are verified on full sets. A task holds a block of a
   group (bounded by ``BLOCK`` shingles). Documents follow leaders they link to;
   then members of all but the largest cluster are held against everybody who is
   not yet connected with them, so no link between different texts is lost, but
   within a cluster nothing more is compared. Groups of several blocks are joined
   by delegates of their clusters first; then the members outside the largest
   cluster are the query set that all other blocks answer.
5. Union-find labels give each document the smallest id reachable.

No pairs of documents are emitted, only labels and ties. Null text is empty. Rows
that repeat an id are one node, linked with whatever one of their texts links with
(and kept or not together); rows without id are linked with nothing and kept. Of
equally good representatives the smallest id stays. Texts of any length are read
whole; an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, statistics, textkit
from loomgraph.llm.components import components

WIDTH, PERCENT = 5, 85
#: At 85 % similarity the chance that a pair meets in no band is below 1e-8, at 80 % below 1e-5.
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
#: Shingles of a block: bounds the memory of a verifying task.
BLOCK = 1_000_000
#: Signatures that agree on this much less than the similarity asked for are not compared further; over 6 standard deviations.
MARGIN = 0.22
DELEGATES = 4


def shingles(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, index of each text's first)."""
    s, e, first = textkit.word_spans(data, offs)
    own, n = textkit.owner(first), len(offs) - 1
    prefix = textkit.prefix_hash(textkit.FOLDED_VALUES[data])
    words = textkit.mix(textkit.span_hash(prefix, s, e) + (e - s).astype(np.uint64))
    at, key = statistics.window_keys(words, own, width)
    text = own[at]
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):  # the whole sequence as one
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            more = count[few] > k
            whole[more] = whole[more] * np.uint64(textkit.BASE) + words[first[few[more]] + k]
        key, text = np.concatenate([key, textkit.mix(whole ^ count[few].astype(np.uint64))]), np.concatenate([text, few])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    if len(key):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        key, text = key[fresh], text[fresh]
    return key, np.searchsorted(text, np.arange(n + 1))


def signatures(key: np.ndarray, first: np.ndarray, m: int = COMPONENTS, chunk: int = 32_768) -> np.ndarray:
    """Texts x m; a value's highest byte is the rank, the rest the random fraction."""
    n = len(first) - 1
    out = np.full((n, m), np.uint64(0xFFFFFFFFFFFFFFFF))
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    total = np.cumsum(size[order])
    begin = 0
    while begin < len(order):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + chunk, "right")))
        docs = order[begin:end]
        begin = end
        k = size[docs]
        at = np.repeat(first[docs] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        _rank_step(out, docs, np.repeat(np.arange(len(docs)), k), key[at], m)
    return out


def _rank_step(out: np.ndarray, docs: np.ndarray, own: np.ndarray, element: np.ndarray, m: int) -> None:
    values = np.full(len(docs) * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    places: np.ndarray | None = None
    for rank in range(m):
        draw = textkit.mix(element + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = rank + ((draw & np.uint64(0xFFFF)) * np.uint64(m - rank) >> np.uint64(16)).astype(np.int64)
        rows = np.arange(len(element))
        if places is None:
            component = swap
        else:  # the next step of a Fisher-Yates shuffle for each element
            component = places[rows, swap].astype(np.int64)
            places[rows, swap] = places[:, rank]
        np.minimum.at(values, own * m + component, (draw >> np.uint64(8)) | np.uint64(rank << 56))
        open_ = (values.reshape(len(docs), m) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        if not open_.any():
            break
        on = open_[own]
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8), (int(on.sum()), 1))
            places[np.arange(len(places)), swap[on]] = 0
        elif not on.all():
            places = places[on]
        if not on.all():
            element, own = element[on], own[on]
    out[docs] = values.reshape(len(docs), m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = textkit.mix(key * np.uint64(textkit.BASE) + parts[:, :, r])
    return key


def _sketch(docs: DataFrame, kind: str) -> DataFrame:
    """(id, n, h1, h2, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(1)):
                key, first = shingles(data, offs)
                size = np.diff(first)
                h1 = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(key), dtype=np.uint64)])
                h2 = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(key ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                keys = band_keys(signatures(key, first)).astype("<u8")
                bands = [row.tobytes() for row in keys]
                sums = [pa.array((h[first[1:]] - h[first[:-1]]).view(np.int64)) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(size), *sums, pa.array(bands, pa.binary())], names=["id", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(shared.thrifty(run), f"id {kind}, n long, h1 long, h2 long, bands binary")


def _explode_bands(reps: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), BANDS))), pa.array(keys)], names=["rep", "band"])

    return reps.select("rep", "bands").mapInArrow(shared.thrifty(run), f"rep {kind}, band long")


class Block:
    """Members with their sets and signatures; links are found, clusters joined."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], signs: np.ndarray, percent: int):
        self.ids, self.signs, self.percent = ids, signs, percent
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        code, uniq = pd.factorize(np.concatenate(sets)) if sets else (np.zeros(0, np.int64), [])
        self.code, self.mark, self.size = code, np.zeros(len(uniq), bool), np.diff(self.first)
        self.root = np.arange(len(ids))

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with ``x``, by full sets."""
        n = self.size[others]
        small, big = np.minimum(n, self.size[x]), np.maximum(n, self.size[x])
        others = others[100 * small >= self.percent * big]
        if len(others) > 8:
            alike = (self.signs[others] == self.signs[x]).mean(axis=1)
            others = others[alike >= self.percent / 100 - MARGIN]
        if not len(others):
            return others
        own = self.code[self.first[x] : self.first[x + 1]]
        self.mark[own] = True
        k = self.size[others]
        at = np.repeat(self.first[others] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        both = textkit.sums(self.mark[self.code[at]].astype(np.int64), np.concatenate([[0], np.cumsum(k)]))
        self.mark[own] = False
        union = self.size[x] + k - both
        return others[100 * both >= self.percent * union]

    def join(self, x: int, found: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[found], self.root[x]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def cluster(self) -> None:
        left = np.arange(len(self.ids))
        asked = np.zeros(len(self.ids), bool)
        while len(left):  # leaders take along who links to them and has no leader yet
            x, left = int(left[0]), left[1:]
            asked[x] = True
            rest = np.flatnonzero(self.root != self.root[x])
            self.join(x, self.linked(x, rest))
            left = left[self.root[left] != self.root[x]]
        while True:  # members of all clusters but the largest are held against the others
            roots, count = np.unique(self.root, return_counts=True)
            todo = np.flatnonzero(~asked & (self.root != roots[count.argmax()]))
            if not len(todo):
                return
            x = int(todo[0])
            asked[x] = True
            self.join(x, self.linked(x, np.flatnonzero(self.root != self.root[x])))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _load(rows: pa.Table, percent: int) -> Block:
    sets = [np.frombuffer(x, "<u8") for x in rows["set"].to_pylist()]
    signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), "<u2").reshape(len(sets), -1)
    return Block(np.array(rows["rep"].to_pylist(), object), sets, signs, percent)


def _label(rows: DataFrame, key: str, kind: str, percent: int) -> DataFrame:
    """(grp, rep, label): clusters within each (grp, ``key``), labelled by their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            block = _load(table, percent)
            block.cluster()
            least: dict[int, object] = {}
            for r, i in zip(block.root.tolist(), block.ids.tolist(), strict=True):
                least[r] = min(least.get(r, i), i)
            yield pa.RecordBatch.from_arrays([table["grp"].combine_chunks(), table["rep"].combine_chunks(), pa.array([least[r] for r in block.root.tolist()], table["rep"].type)], names=["grp", "rep", "label"])

    return rows.select("grp", key, "rep", "set", "sign").repartition("grp", key).sortWithinPartitions("grp", key).mapInArrow(shared.thrifty(run), f"grp {kind}, rep {kind}, label {kind}")


def _answer(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """(a, b) labels that link: rows (grp, cell, part, rep, label, set, sign) hold askers (part 0) and answerers (part 1) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            part, label = np.array(table["part"].to_pylist()), np.array(table["label"].to_pylist(), object)
            block = _load(table, percent)
            known = pd.factorize(label)[0]
            ties = set()
            for x in np.flatnonzero(part == 0).tolist():
                for y in block.linked(x, np.flatnonzero((part == 1) & (known != known[x]))).tolist():
                    ties.add((label[x], label[y]))
            if ties:
                a, b = zip(*sorted(ties), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, table["rep"].type), pa.array(b, table["rep"].type)], names=["a", "b"])

    return rows.select("grp", "cell", "part", "rep", "label", "set", "sign").repartition("grp", "cell").sortWithinPartitions("grp", "cell").mapInArrow(shared.thrifty(run), f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = shared.materialize(_sketch(docs, kind), "sketch")
    classes = sketch.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "bands")).alias("x")).select("h1", "h2", "n", F.col("x.id").alias("rep"), F.col("x.bands").alias("bands"))
    classes = shared.materialize(classes, "classes")

    bands = _explode_bands(classes, kind)
    leaders = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).where("leader < most").select("band", "leader")
    ties = bands.join(leaders, "band").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    groups = components(ties)

    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    member = groups.join(sizes, groups["node"] == sizes["rep"]).select("rep", F.col("component").alias("grp"), "n")
    blocks = member.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("n_blocks"))
    member = member.join(blocks, "grp").select("grp", "rep", "n_blocks", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block"))

    def load_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(4)):
                key, first = shingles(data, offs)
                signs = (signatures(key, first) & np.uint64(0xFFFF)).astype("<u2")
                edge = first.tolist()
                sets = [key[x:y].astype("<u8").tobytes() for x, y in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(4)), pa.array(sets, pa.binary()), pa.array([r.tobytes() for r in signs], pa.binary())], names=["grp", "rep", "n_blocks", "block", "set", "sign"])

    texts = docs.join(member, docs["id"] == member["rep"]).select("grp", "rep", "n_blocks", "block", "text")
    full = texts.mapInArrow(shared.thrifty(load_sets), f"grp {kind}, rep {kind}, n_blocks int, block int, set binary, sign binary")
    full = shared.materialize(full, "sets")
    labels = shared.materialize(_label(full, "block", kind, percent), "labels")
    labels = _join_blocks(full, labels, kind, percent, block)
    shared.discard(full)

    mine = labels.groupBy("rep").agg(F.min("label").alias("label"))
    node = classes.select("h1", "h2", "n", "rep").join(mine, "rep", "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("component_id"))
    found = sketch.select("id", "n", "h1", "h2").join(node, ["h1", "h2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    found = shared.materialize(found, "found")
    for table in (sketch, classes, labels):
        shared.discard(table)
    found = _repeated_ids(found)
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _repeated_ids(found: DataFrame) -> DataFrame:
    """Components of rows that share an id, and all components tied by such ids, are one."""
    several = found.where("id is not null").groupBy("id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least < most")
    several = shared.materialize(several.select("id", "least"), "several")
    if several.isEmpty():
        return found
    # an id's own number is a node too, so that texts without shingles follow the others
    ties = found.join(several, "id").select(F.col("component_id").alias("a"), F.col("least").alias("b"))
    joined = components(ties).select(F.col("node").alias("component_id"), F.col("component").alias("whole"))
    own = several.join(joined, several["least"] == joined["component_id"]).select("id", F.col("whole").alias("of_id"))
    out = found.join(joined, "component_id", "left").join(own, "id", "left")
    return out.select("id", "n", F.least("component_id", "whole", "of_id").alias("component_id"))


def _join_blocks(full: DataFrame, labels: DataFrame, kind: str, percent: int, block: int) -> DataFrame:
    """Labels across the blocks of groups that have several."""
    several = full.where("n_blocks > 1")
    if not several.limit(1).count():
        return labels
    own = several.join(labels.select("rep", "label").distinct(), "rep")
    own = shared.materialize(own.withColumn("draw", F.xxhash64("rep", F.lit(7))), "several")
    # a few delegates of each cluster, in blocks of their own, join most clusters at little cost
    least = own.groupBy("grp", "label").agg(*(F.min(F.when(F.pmod(F.col("draw"), F.lit(DELEGATES)) == k, F.struct("draw", "rep"))).alias(f"d{k}") for k in range(DELEGATES)))
    chosen = least.select(F.explode(F.array(*(F.col(f"d{k}.rep") for k in range(DELEGATES)))).alias("rep")).where("rep is not null").distinct()
    sent = own.join(chosen, "rep", "left_semi")
    sent_blocks = sent.groupBy("grp").agg(F.ceil(F.sum(F.length("set") / 8) / F.lit(block)).cast("int").alias("n_cells"))
    sent = sent.join(sent_blocks, "grp").withColumn("cell", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n_cells")).cast("int"))
    met = _label(sent, "cell", kind, percent).withColumnRenamed("label", "met")
    ties = sent.select("rep", "label").join(met, "rep").select(F.col("label").alias("a"), F.col("met").alias("b"))
    ties = ties.unionByName(labels.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    before, labels = labels, _relabel(labels, components(ties))
    shared.discard(before)
    # who is not in the largest cluster of its group asks all others of the group
    own = own.drop("label").join(labels.select("rep", "label").distinct(), "rep")
    largest = own.groupBy("grp", "label").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("largest"))
    own = shared.materialize(own.join(largest, "grp"), "asking")
    askers = own.where("label <> largest")
    chunks = askers.groupBy("grp").agg(F.ceil(F.sum(F.length("set") / 8) / F.lit(block)).cast("int").alias("n_chunks"))
    cell = F.struct("block", F.col("chunk"))
    columns = ["grp", cell.alias("cell"), "part", "rep", "label", "set", "sign"]
    asking = askers.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("n_chunks")).cast("int")).withColumn("part", F.lit(0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(*columns)
    answering = own.join(chunks, "grp").withColumn("part", F.lit(1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).select(*columns)
    found = _answer(asking.unionByName(answering).withColumn("cell", F.to_json("cell")), kind, percent)
    out = _relabel(labels, components(found))
    shared.discard(labels)
    shared.discard(own)
    return out


def _relabel(labels: DataFrame, joined: DataFrame) -> DataFrame:
    out = labels.join(joined, labels["label"] == joined["node"], "left").select("grp", "rep", F.coalesce("component", "label").alias("label"))
    return shared.materialize(out, "labels")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns: of each group the one with the smallest id."""
    gone = near_duplicates(df, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("gone_id")).distinct()
    return df.join(gone, df[id_col] == gone["gone_id"], "left_anti")
