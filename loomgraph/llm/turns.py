"""Conversation repair: the cheapest edits that give alternating turns.

Rows of a conversation, in order of turn (nulls first; rows of one turn by role and
MD5 of the text), are kept, re-roled to user or assistant (1), or deleted (2, a must for blank and
duplicate rows); empty user or assistant messages are inserted (5); a truncated row
that stays costs 5. The roles' initials must then read ``(s?(ua)+)?``. Positions
and states of that pattern make a graph with small integer costs: distances to the end are
found with a bucket queue (Dial), and the audit, the least of the cheapest edit strings
in ASCII order, by walking tight arcs, the least letter first.

Rows are range-partitioned by conversation and order and packed, as they stream by,
into fragments of at most ``FRAGMENT`` rows, so a conversation of any length is
spread over tasks. For each fragment, a queue run from each state at its end gives a
matrix of distances; matrices of a conversation's fragments are folded from its end
(a small row each); with the distances at its end each fragment is walked from every
state, and the folded walks say where each one begins. Only the text of a conversation
in several fragments moves again: its digest is taken as its rows stream by.

Null roles and texts are one space; a null conversation is one conversation; a null turn
comes first and counts in no gap. An initial is a role's first character. A row is a
duplicate if role and text were seen earlier, also where rows are repeated. A
conversation without rows has zeros, an empty audit and the digest of an empty string.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared

FRAGMENT, FRAGMENT_BYTES = 4096, 1 << 22
BLANK = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FINE, GONE, TRUNCATED = 0, 1, 2
#: States: nothing yet, after a system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEPT_TO = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a message of the role that fits leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 60
#: What is left to pay at the end of a conversation.
ENDS = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that a checksum of conversation and turn picks."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20)).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("fault", "copy")


def _told(text: Column) -> Column:
    """The last character that is no white space, or an empty string."""
    return F.substring(F.rtrim(F.translate(text, "\t\n\x0b\f\r", "     ")), -1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with row (a number of its own), blank, duplicate, truncated: the first that holds."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    rows = numbered = shared.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    said = rows.select("conv_id", "role", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "turn", "row")
    firsts = said.groupBy("conv_id", "role", "t1", "t2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "row")).alias("first"))
    again = said.select("row").join(firsts.select(F.col("first.row").alias("row")), "row", "left_anti").withColumn("again", F.lit(True))
    last = _told(F.col("text"))
    rows = rows.join(again, "row", "left").withColumn("again", F.coalesce("again", F.lit(False))).withColumn("last", last)
    blank = F.col("last") == ""
    found = rows.select("conv_id", "turn", "role", "text", "row", blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"), (~blank & ~F.col("again") & ~F.col("last").isin(".", "!", "?")).alias("truncated"))
    # read three times: to find the ranges, to deal the rows out, and to count
    found = shared.materialize(found, "faults")
    shared.discard(numbered)
    return found


def _arcs(initial: str, fault: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, state after the row) of the edits of one row, letters in order."""
    out = [(DELETE, "D", state)]
    if fault != GONE:
        extra = CUT if fault == TRUNCATED else 0
        if (state, initial) in KEPT_TO:
            out.append((KEEP + extra, "K", KEPT_TO[state, initial]))
        out.append((REROLE + extra, "R", NEXT[state]))
    return out


def distances(initials: list[str], kinds: list[int], ends: list[int]) -> list[list[int]]:
    """The least cost from every position and state to the end, where a state has ``ends`` still to pay; by a bucket queue.

    An insertion belongs to the row that it comes before.
    """
    n = len(initials)
    into: list[list[list[tuple[int, int, int]]]] = [[[] for _ in STATES] for _ in range(n + 1)]  # (cost, position, state) of arcs that lead there
    for i in range(n):
        for q in STATES:
            for cost, _, to in _arcs(initials[i], kinds[i], q):
                into[i + 1][to].append((cost, i, q))
            into[i][NEXT[q]].append((INSERT, i, q))
    found = [[FAR] * 4 for _ in range(n + 1)]
    base = min(ends)
    buckets: list[list[tuple[int, int]]] = [[]]

    def put(d: int, i: int, q: int) -> None:
        if d < found[i][q]:
            found[i][q] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append((i, q))

    for q in STATES:
        if ends[q] < FAR:
            put(ends[q], n, q)
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # arcs without cost add to the bucket that is being read
            if found[i][q] == at + base:
                for cost, j, p in into[i][q]:
                    put(found[i][q] + cost, j, p)
        buckets[at] = []
        at += 1
    return found


def walk(initials: list[str], kinds: list[int], found: list[list[int]], state: int) -> tuple[str, int]:
    """(letters, state at the end): from ``state`` along tight arcs, always by the least letter."""
    out, i = [], 0
    while i < len(initials):
        here = found[i][state]
        arcs = [(letter, cost, i + 1, to) for cost, letter, to in _arcs(initials[i], kinds[i], state)]
        arcs.append(("I", INSERT, i, NEXT[state]))
        letter, i, state = min((letter, j, to) for letter, cost, j, to in arcs if cost + found[j][to] == here)
        out.append(letter)
    return "".join(out), state


def close(state: int) -> str:
    """Insertions that end a conversation."""
    return "I" * (ENDS[state] // INSERT)


def edited(audit: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The rows that come of it, as ``role:text``."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
        elif letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = KEPT_TO[state, roles[i][:1]]
            i += 1
        else:
            state = NEXT[state]
            out.append(f"{'user' if state == USER else 'assistant'}:{texts[i] if letter == 'R' else ''}")
            i += letter == "R"
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition into fragments, a row each."""
    conv, rows, size, no = None, [], 0, 0
    schema = None

    def fragment() -> pa.RecordBatch:
        part, roles, texts, kinds = rows[0][1], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
        columns = [[conv], [part], [no], [[r[:1] for r in roles]], [kinds], [roles], [texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("no", pa.int32()), ("initials", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "kind")), strict=True):
            if rows and (row[0] != conv or len(rows) >= FRAGMENT or size >= FRAGMENT_BYTES):
                yield fragment()
                no, rows, size = no + 1, [], 0
            conv, size = row[0], size + len(row[3])
            rows.append(row)
    if rows:
        yield fragment()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment: 16 distances, from every state at its beginning to every one at its end."""
    for batch in batches:
        out = []
        for initials, kinds in zip(batch.column("initials").to_pylist(), batch.column("kinds").to_pylist(), strict=True):
            to = [distances(initials, kinds, [0 if q == end else FAR for q in STATES])[0] for end in STATES]
            out.append([to[q][p] for p in STATES for q in STATES])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "no")), pa.array(out, pa.list_(pa.int64()))], names=["part", "no", "costs"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation: what is left to pay at the end of each of its fragments."""
    for batch in batches:
        out = []
        for fragments in batch.column("fragments").to_pylist():
            ends, done = [ENDS[q] for q in STATES], []
            for f in reversed(fragments):
                done.append({"part": f["part"], "no": f["no"], "ends": ends})
                ends = [min(min(f["costs"][4 * p + q] + ends[q] for q in STATES), FAR) for p in STATES]
            out.append((done[::-1], ends[START]))
        kind = pa.list_(pa.struct([("part", pa.int32()), ("no", pa.int32()), ("ends", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([d for d, _ in out], kind), pa.array([c for _, c in out], pa.int64())], names=["conv_id", "fragments", "cost"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment: letters and last state from every state at its beginning."""
    for batch in batches:
        letters, last = [], []
        for initials, kinds, ends in zip(*(batch.column(c).to_pylist() for c in ("initials", "kinds", "ends")), strict=True):
            found = distances(initials, kinds, ends)
            walks = [walk(initials, kinds, found, q) if found[0][q] < FAR else ("", q) for q in STATES]
            letters.append([w for w, _ in walks])
            last.append([q for _, q in walks])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "no")), pa.array(letters, pa.list_(pa.string())), pa.array(last, pa.list_(pa.int32()))], names=["part", "no", "letters", "last"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation: its audit, and of each fragment its own letters and first state."""
    for batch in batches:
        audits, parts = [], []
        for fragments in batch.column("fragments").to_pylist():
            state, pieces, own = START, [], []
            for i, f in enumerate(fragments):
                first, piece = state, f["letters"][state]
                state = f["last"][state]
                if i == len(fragments) - 1:
                    piece += close(state)
                pieces.append(piece)
                own.append({"part": f["part"], "no": f["no"], "letters": piece, "first": first, "place": i})
            audits.append("".join(pieces))
            parts.append(own)
        kind = pa.list_(pa.struct([("part", pa.int32()), ("no", pa.int32()), ("letters", pa.string()), ("first", pa.int32()), ("place", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(audits, pa.string()), pa.array(parts, kind)], names=["conv_id", "audit", "fragments"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments after their edits: rows as ``role:text``."""
    for batch in batches:
        out = [edited(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("letters", "roles", "texts", "first")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "several", "place")), pa.array(out, pa.list_(pa.string()))], names=["conv_id", "several", "place", "rows"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations that follow each other into one digest for each conversation, as they stream by."""
    conv = digest = kind = None
    any_row = False
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        convs, digests = [], []
        for c, rows in zip(batch.column("conv_id").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    convs.append(conv)
                    digests.append(digest.hexdigest())
                conv, digest, any_row = c, hashlib.sha256(), False
            for row in rows:
                digest.update(("\n" if any_row else "").encode() + row.encode())
                any_row = True
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def _counts(fragments: DataFrame, marked: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal."""
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    # by turn first, so that a long conversation is summed up in many tasks
    by_turn = marked.groupBy("conv_id", "turn").agg(total("blank"), total("duplicate"), total("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    rows = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("initials")), lambda i: F.when(i < F.size("initials"), F.concat(F.get("initials", i - 1), F.get("initials", i))))
    within = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    edges = fragments.select("conv_id", F.struct("part", "no", F.get("initials", F.lit(0)).alias("a"), F.get("initials", F.size("initials") - 1).alias("b")).alias("e"), within.alias("within"))
    edges = edges.groupBy("conv_id").agg(F.sum("within").alias("within"), F.sort_array(F.collect_list("e")).alias("e"))
    between = F.transform(F.sequence(F.lit(1), F.size("e")), lambda i: F.when(i < F.size("e"), F.concat(F.get("e", i - 1)["b"], F.get("e", i)["a"])))
    illegal = edges.select(F.col("conv_id").alias("of"), (F.col("within") + F.size(F.filter(between, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))).cast("long").alias("illegal"))
    return rows.join(illegal, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def _of(fragments: DataFrame, *columns: str) -> DataFrame:
    """One row a conversation: its fragments in order, with these columns."""
    return fragments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "no", *columns))).alias("fragments"))


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``conversations`` (conv_id) names those to be returned, also without rows; by default those of ``rows``.
    """
    spark = rows.sparkSession
    conversations = rows.select("conv_id").distinct() if conversations is None else conversations
    conv = rows.schema["conv_id"].dataType.simpleString()
    marked = faults(rows)
    kind = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", F.md5(F.col("text").cast("binary")), "row"]
    dealt = marked.select("conv_id", "turn", "role", "text", "row", kind.alias("kind")).repartitionByRange(shared.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    packed = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_pack, f"conv_id {conv}, part int, no int, initials array<string>, kinds array<int>, roles array<string>, texts array<string>")
    fragments = shared.materialize(packed, "fragments")

    place = ["part", "no"]
    codes = fragments.select("conv_id", *place, "initials", "kinds")
    costs = codes.select(*place, "initials", "kinds").mapInArrow(_matrices, "part int, no int, costs array<long>")
    with_costs = fragments.select("conv_id", *place).join(costs, place)
    folded = shared.materialize(_of(with_costs, "costs").mapInArrow(_fold, f"conv_id {conv}, fragments array<struct<part:int,no:int,ends:array<bigint>>>, cost long"), "folded")
    ends = folded.select(F.explode("fragments").alias("f")).select("f.*")
    walks = codes.join(ends, place).select(*place, "initials", "kinds", "ends").mapInArrow(_walks, "part int, no int, letters array<string>, last array<int>")
    with_walks = fragments.select("conv_id", *place).join(walks, place)
    chained = shared.materialize(_of(with_walks, "letters", "last").mapInArrow(_chain, f"conv_id {conv}, audit string, fragments array<struct<part:int,no:int,letters:string,first:int,place:int>>"), "chained")

    steps = chained.select((F.size("fragments") > 1).alias("several"), F.explode("fragments").alias("f")).select("several", "f.*")
    texts = fragments.select("conv_id", *place, "roles", "texts").join(steps, place)
    rewritten = texts.select("conv_id", "several", "place", "letters", "roles", "texts", "first").mapInArrow(_rewrite, f"conv_id {conv}, several boolean, place int, rows array<string>")
    rewritten = shared.materialize(rewritten, "repaired")
    one = rewritten.where("not several").select("conv_id", F.sha2(F.array_join("rows", "\n"), 256).alias("repaired_sha256"))
    long = rewritten.where("several").repartition(shared.shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "rows")
    digests = one.unionByName(long.mapInArrow(_digest, f"conv_id {conv}, repaired_sha256 string"))

    out = conversations.select("conv_id").distinct()
    for part in (_counts(fragments, marked), folded.select("conv_id", "cost"), chained.select("conv_id", "audit"), digests):
        part = part.withColumnRenamed("conv_id", "of")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CRC = """list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))"""
ORACLE_SQL = f"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, 4294967295) % 20 AS f FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM b WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, right(rtrim(text, {_STRIP}), 1) AS last FROM c),
r AS (SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT again AS truncated
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o)),
ins(q, q1, letters, paid, added) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
      (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:']),
      (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 2, 'II', 10, ['assistant:', 'user:']), (3, 3, 'II', 10, ['user:', 'assistant:'])),
e(letter) AS (VALUES ('D'), ('K'), ('R')),
moves AS (SELECT conv_id, i, q, q2, paid + CASE letter WHEN 'D' THEN 2 ELSE CASE letter WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN truncated THEN 5 ELSE 0 END END AS paid, letters || letter AS letters,
             list_concat(added, CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE q2 WHEN 3 THEN 'assistant:' ELSE 'user:' END || text] END) AS added
      FROM (SELECT *, CASE letter WHEN 'D' THEN q1 WHEN 'R' THEN CASE q1 WHEN 2 THEN 3 ELSE 2 END
                      ELSE CASE WHEN q1 = 0 AND left(role, 1) = 's' THEN 1 WHEN q1 <> 2 AND left(role, 1) = 'u' THEN 2 WHEN q1 = 2 AND left(role, 1) = 'a' THEN 3 END END AS q2
            FROM r, ins, e WHERE letter = 'D' OR NOT (blank OR duplicate)) WHERE q2 IS NOT NULL),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
      UNION ALL
      SELECT conv_id, any_value(i), q2, arg_min(cost, least_of), arg_min(audit, least_of), arg_min(said, least_of)
      FROM (SELECT s.conv_id, m.i, m.q2, s.cost + m.paid AS cost, s.audit || m.letters AS audit, list_concat(s.said, m.added) AS said, row(s.cost + m.paid, s.audit || m.letters) AS least_of
            FROM s JOIN moves m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = s.i + 1 AND m.q = s.q) GROUP BY conv_id, q2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
             count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM r) GROUP BY conv_id),
ends AS (SELECT s.conv_id, min(row(cost + paid, audit || letters)) AS best, arg_min(list_concat(said, added), row(cost + paid, audit || letters)) AS said
      FROM s JOIN ins USING (q) LEFT JOIN n ON s.conv_id IS NOT DISTINCT FROM n.conv_id WHERE i = coalesce(n, 0) AND q1 IN (0, 3) GROUP BY s.conv_id)
SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best[1]::BIGINT AS cost, best[2] AS audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN n ON ends.conv_id IS NOT DISTINCT FROM n.conv_id
"""
