"""Line dedup: lines that many documents share go from all of them.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased. Rows (128-bit hash of the key, document, position) are
range-partitioned by hash and document and sorted by hash, document and position,
so a line that a third of all documents hold is spread over many partitions. Each
partition is streamed once: the first occurrences in new documents are counted,
rows of a key are held back only until ``min_docs`` documents are seen (at most
``min_docs`` - 1 documents' rows). The first and the last key of a partition may
go on in its neighbours: their rows are marked as open, and the counts of these
keys, two a partition at most, are added up. What comes back is a compressed bitmap of
lines to keep for each document that loses some, never text.

Null or empty texts are one empty line. Empty keys (under ``min_chars`` code points)
are never dropped. Documents are told apart by id and text: rows that repeat both
count as one document, rows that repeat only the id, or have none, as documents of
their own. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared

MIN_DOCS, MIN_CHARS = 10, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"
KEY, DOCUMENT = ["h1", "h2"], ["id_hash", "text_hash"]
DROP, OPEN, COUNT = 0, 1, 2
MARKS = "kind int, h1 long, h2 long, id_hash long, text_hash long, pos int"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def document_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """A document's name in joins: 128 bits of its id and text."""
    return [F.xxhash64(F.lit(0), F.col(id_col), F.col(text_col)).alias("id_hash"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("text_hash")]


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, id_hash, text_hash, pos): every line whose key is long enough."""
    lines = docs.select(*document_key(docs, id_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select(*DOCUMENT, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= max(min_chars, 1))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *DOCUMENT, "pos")


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row's answer is for the caller."""
    out = np.ones(len(rows), bool)
    out[1:] = (rows[1:] != rows[:-1]).any(1)
    return out


def _marker(min_docs: int):  # noqa: ANN202
    """Streams one sorted partition into rows of ``MARKS``."""
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in KEY + DOCUMENT], ("pos", pa.int32())])

    def batch_of(kind: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *[pa.array(keys[:, i]) for i in range(4)], pa.array(pos.astype(np.int32))], schema=schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = doc = None  # of the last row so far
        docs, first_run = 0, True  # documents of the current run; whether it is the partition's first
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the current run, while undecided
        edges: list[tuple[np.ndarray, int]] = []  # the first and the last run with their counts

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in KEY + DOCUMENT], 1)
            pos = batch.column("pos").to_numpy()
            new_key, new_doc = _runs(keys[:, :2]), _runs(keys)
            new_key[0] = key is None or (keys[0, :2] != key).any()
            new_doc[0] = new_key[0] or (keys[0] != doc).any()
            starts = np.flatnonzero(new_key)
            bounds = np.unique(np.concatenate([[0], starts, [len(keys)]]))
            counts = np.add.reduceat(new_doc.astype(np.int64), bounds[:-1])
            kinds = np.repeat(np.where(counts >= min_docs, DROP, -1), np.diff(bounds))
            for i in sorted({0, len(counts) - 1}):  # runs between these lie within the batch and are decided
                a, b = bounds[i], bounds[i + 1]
                if new_key[a]:
                    if key is not None and first_run:
                        edges.append((key, docs))
                        first_run = False
                    held, docs = [], 0
                key = keys[a, :2]
                docs += int(counts[i])
                if first_run:
                    kinds[a:b] = OPEN
                elif docs >= min_docs:
                    kinds[a:b] = DROP  # also where most of its documents came in earlier batches
                    for rows, places in held:
                        yield batch_of(np.full(len(rows), DROP), rows, places)
                    held = []
                elif b == len(keys):
                    held.append((keys[a:b], pos[a:b]))
            doc = keys[-1]
            if (out := np.flatnonzero(kinds >= 0)).size:
                yield batch_of(kinds[out], keys[out], pos[out])
        if key is None:
            return
        edges.append((key, docs))
        for rows, places in held:
            yield batch_of(np.full(len(rows), OPEN), rows, places)
        # a count row has its number of documents in place of a position
        yield batch_of(np.full(len(edges), COUNT), np.array([[*k, 0, 0] for k, _ in edges], np.int64), np.array([n for _, n in edges]))

    return mark


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_hash, text_hash, pos): the lines that go."""
    spark = docs.sparkSession
    rows = line_rows(docs, id_col, text_col, min_chars)
    dealt = rows.repartitionByRange(shared.shuffle_partitions(spark), *KEY, *DOCUMENT).sortWithinPartitions(*KEY, *DOCUMENT, "pos")
    marks = shared.materialize(dealt.mapInArrow(_marker(min_docs), MARKS), "line-marks")
    open_keys = marks.where(F.col("kind") == COUNT).groupBy(*KEY).agg(F.sum("pos").alias("n")).where(F.col("n") >= min_docs).select(*KEY)
    # two keys a partition at most
    closed = marks.where(F.col("kind") == OPEN).join(F.broadcast(open_keys), KEY, "left_semi")
    return marks.where(F.col("kind") == DROP).select(*DOCUMENT, "pos").unionByName(closed.select(*DOCUMENT, "pos"))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column("places"):
            gone = places.values.to_numpy()
            bits = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)  # lines after the last one dropped stay
            bits[gone] = False
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("id_hash"), batch.column("text_hash"), pa.array(out, pa.binary())], names=[*DOCUMENT, "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_hash, text_hash, keep): zlib-compressed bits, 1 for a line to keep, up to the last line dropped; documents that lose nothing have no row."""
    gone = dropped(docs, id_col, text_col, min_docs, min_chars).groupBy(*DOCUMENT).agg(F.collect_list("pos").alias("places"))
    return gone.mapInArrow(_compress, "id_hash long, text_hash long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, lines dropped, the other lines joined by newlines)."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return len(lines), len(gone), b"\n".join([x for i, x in enumerate(lines) if i not in gone])


def _apply(with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines((t.as_buffer().to_pybytes() if t.is_valid else b""), k.as_py()) for t, k in zip(batch.column("text").cast(pa.binary()), batch.column("keep"), strict=True)]
            columns = [batch.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            last = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()) if with_text else pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, last], names=["id", "n_lines", "n_dropped", "kept"])

    return run


def _joined(docs: DataFrame, with_text: bool, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    own = docs.select(*document_key(docs, id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are streamed past the bitmaps of their partition, not sorted
    met = own.join(bitmaps.hint("shuffle_hash"), DOCUMENT, "left").select("id", "text", "keep")
    kind = docs.schema[id_col].dataType.simpleString()
    return met.mapInArrow(_apply(with_text), f"id {kind}, n_lines long, n_dropped long, kept string")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, n_lines, n_dropped, text): a row for each row of ``docs``, with the lines that stay."""
    return _joined(docs, True, id_col, text_col, min_docs, min_chars).select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").alias(text_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256): as :func:`without_common_lines`, with the text's digest."""
    return _joined(docs, False, id_col, text_col, min_docs, min_chars).select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, text, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT r, doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
common AS (SELECT k FROM (SELECT DISTINCT k, doc_id, text FROM l WHERE length(k) >= {MIN_CHARS}) GROUP BY k HAVING count(*) >= {MIN_DOCS})
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM
 (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '') AS kept
  FROM l LEFT JOIN common c ON l.k = c.k GROUP BY r)
"""
