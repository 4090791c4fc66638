"""Line dedup, hard negatives and conversation repair against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import hard_negatives, lines, turns

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines


def plain_line_dedup(rows, min_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key := line.strip(SPACE).translate(LOWER):
                holders[key].add((i, t))
    out = []
    for i, t in rows:
        have = (t or "").split("\n")
        stay = [x for x in have if len(holders.get(x.strip(SPACE).translate(LOWER), ())) < min_docs]
        out.append((i, len(have), len(have) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_corpus(n=150, seed=5):
    rng = random.Random(seed)
    common = ["  Terms of use ", "TERMS OF USE", "terms of use\t", "Share", "ÉÈ Neu", "éè neu", "x", "   "]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "terms of use"), (3, "terms of use"), (3, "Terms of use\nown"), (None, "Share\nalone"), (None, "Share"), (None, None), (4, "x\n" * 3000)]
    for i in range(5, n):
        some = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(some)))
    return rows


@pytest.mark.parametrize(("partitions", "min_docs"), [(1, 10), (7, 10), (40, 10), (7, 1), (7, 3)])
def test_lines_that_documents_share_go(spark, partitions, min_docs):
    rows = line_corpus()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h1", "pos", "keep", "kind", "id", "text_hash")}).repartition(5)
        got = lines.without_common_lines(docs, min_docs=min_docs).collect()
        digests = lines.digests(docs, min_docs=min_docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = plain_line_dedup(rows, min_docs)
    assert sorted(map(tuple, got), key=repr) == want
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in digests if r["doc_id"] is not None) == sorted((a, b, c, sha(d)) for a, b, c, d in want if a is not None)


def test_a_line_of_all_documents_is_spread_and_counted_over_partitions(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("All rights reserved\nbody "), F.col("id")).alias("text"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = lines.line_rows(docs).repartitionByRange(16, *lines.KEY, *lines.DOCUMENT)
        assert max(r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 1500
        bitmaps = lines.keep_bitmaps(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(bitmaps) == 4000
    assert all(np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8)).tolist() == [0, 1, 1, 1, 1, 1, 1, 1] for r in bitmaps)


def test_line_dedup_of_an_empty_table(spark):
    assert lines.digests(spark.createDataFrame([], "doc_id string, text string")).collect() == []


# --- hard negatives


def plain_mining(rows, anchors, positives=5, negatives=5):
    ok = [(i, lab, np.floor(256 * np.array(v, float))) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, lab, np.pad(v, (0, width - len(v)))) for i, lab, v in ok]
    out = []
    for n, (a, lab, v) in enumerate(ok):
        if not anchors(a):
            continue
        scored = sorted((-int(v @ w), i, other) for m, (i, other, w) in enumerate(ok) if m != n)
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [(t, j) for t, j, other in scored if other != lab and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out)


def vectors(n=400, d=6, seed=2, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        scale = rng.lognormal(0, spread)
        rows.append((i, int(rng.integers(4)), [float(x) for x in scale * (centre[rng.integers(4)] + 0.5 * rng.normal(size=d))]))
    rows += [(n + 1, 1, None), (n + 2, None, [1.0] * d), (n + 3, 2, [1.0] * (d - 1) + [None]), (n + 4, 2, [float("nan")] * d), (n + 5, 2, [float("inf")] * d), (n + 6, 3, []), (n + 7, 3, [0.5]), (None, 1, [1.0] * d), (n + 8, 0, [3e38] * d)]
    rows += [(20, 1, rows[20][2]), rows[40], rows[40], (60, rows[60][1], rows[61][2])]  # ids that repeat, with the same row and with another
    rows += [(i, 2, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0]) for i in range(1000, 1100)] + [(i, 3, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0]) for i in range(1100, 1150)]  # ties
    return rows


@pytest.mark.parametrize(("block", "piece"), [(4096, 1024), (3, 7)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLICE", piece)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "bucket", "norm2", "score")}).repartition(5)
    got = hard_negatives.mine(table, F.col("id") % 20 == 0)
    usable = [r for r in rows if not (r[2] and r[2][0] == 3e38)]
    want = plain_mining(usable, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100


def test_large_components_are_scored_without_rounding(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [float(rng.randrange(-(1 << 21), 1 << 21)) + rng.random() for _ in range(3)]) for i in range(120)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("id") % 10 == 0)
    exact = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    out = []
    for a, lab, v in exact:
        if a % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in exact if i != a)
            for s, i, _ in [x for x in scored if x[2] == lab][:5]:
                out += [(a, i, r, j, -s, -t) for r, (t, j) in enumerate([(t, j) for t, j, other in scored if other != lab and -80 * s <= -100 * t <= -100 * s][:5], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(out)


def test_short_buckets_are_not_searched(spark):
    """The bar of long rows of the anchor's own label leaves out most buckets."""
    rows = [(i, 0 if i < 40 else i % 3, [10.0, 1.0 + i / 100] if i < 40 else [0.01, 0.01 * (i % 7)]) for i in range(2000)]
    table, longest = hard_negatives.bucketed(hard_negatives.rows_of(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "embedding", "label"))
    assert longest == sorted(longest, reverse=True)
    few = hard_negatives.Searches(_anchor_batches(spark, table), same=True, k=3)
    long = table.where("id < 40").orderBy("id").toPandas()
    import pyarrow as pa

    met = lambda x: few.meet(x["id"].to_numpy(), x["label"].to_numpy(), np.sqrt(x["norm2"].to_numpy()), pa.array([list(v) for v in x["vector"]], pa.list_(pa.float64())))
    assert met(long.sort_values("norm2", ascending=False))
    assert not met(table.where("id >= 40").orderBy(F.desc("norm2")).limit(50).toPandas())


def _anchor_batches(spark, table):
    none = F.array().cast("array<long>")
    some = table.where("id % 10 = 0 and id < 40").select(F.col("id").alias("anchor_key"), "id", "label", F.sqrt("norm2").alias("norm"), "vector", F.array(F.lit(hard_negatives.NONE)).alias("low"), F.array(F.lit((1 << 63) - 1)).alias("high"), F.array(F.lit(hard_negatives.NONE)).alias("bar"), none.alias("positive_id"), none.alias("positive_score"))
    return some.toArrow().to_batches()


@pytest.mark.parametrize("rows", [[], [(100, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(0, 1, None)]])
def test_hard_negatives_of_little(spark, rows):
    assert hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), F.col("id") % 100 == 0).collect() == []


# --- conversations


def plain_repair(initials, kinds):
    """The least (cost, letters) by going through all states with whole strings."""
    best = {turns.START: (0, "")}

    def with_insertions(states):
        for _ in range(3):
            for q, (c, w) in list(states.items()):
                if (new := (c + 5, w + "I")) < states.get(turns.NEXT[q], (1 << 30, "")):
                    states[turns.NEXT[q]] = new
        return states

    for c, k in zip(initials, kinds, strict=True):
        after = {}
        for q, (cost, w) in with_insertions(best).items():
            moves = [(2, "D", q)]
            if k != turns.GONE:
                extra = 5 * (k == turns.TRUNCATED)
                if (to := {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c, q))) is not None:
                    moves.append((extra, "K", to))
                moves.append((1 + extra, "R", 3 if q == 2 else 2))
            for m, letter, to in moves:
                after[to] = min(after.get(to, (1 << 30, "")), (cost + m, w + letter))
        best = after
    ends = with_insertions(best)
    return min(ends[q] for q in (turns.START, turns.ASSISTANT) if q in ends)


def whole(initials, kinds):
    found = turns.distances(initials, kinds, [turns.ENDS[q] for q in turns.STATES])
    letters, state = turns.walk(initials, kinds, found, turns.START)
    return found[0][turns.START], letters + turns.close(state)


def test_every_short_conversation_costs_the_least():
    for n in range(5):
        for initials in itertools.product("suax"[: 4 if n < 4 else 3], repeat=n):
            for kinds in itertools.product(range(3), repeat=n):
                assert whole(list(initials), list(kinds)) == plain_repair(initials, kinds)


def test_edits_by_going_through_all_strings():
    """Independent of states: all strings of letters up to a length, priced and checked against the pattern."""
    import re

    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(4)
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2])) for _ in range(n)]
        best = None
        for length in range(n, n + 3):
            for letters in itertools.product("DIKR", repeat=length):
                if sum(x != "I" for x in letters) != n:
                    continue
                for roles in itertools.product("ua", repeat=sum(x in "IR" for x in letters)):
                    cost, said, i, free = 0, "", 0, iter(roles)
                    for x in letters:
                        if x == "I":
                            cost, said = cost + 5, said + next(free)
                            continue
                        c, k = rows[i]
                        i += 1
                        if x == "D":
                            cost += 2
                        elif k == 1:
                            cost = 1 << 30
                        else:
                            cost, said = cost + 5 * (k == 2) + (x == "R"), said + (c if x == "K" else next(free))
                    if cost < 1 << 30 and re.fullmatch("(s?(ua)+)?", said):
                        best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
        assert whole([c for c, _ in rows], [k for _, k in rows]) == best


def conversations(n=60, seed=8):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", " \t", "", None, f"Text {t}?", "Text 1? ", "wait!\n", "Ää."])))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Hello."), (7, None, "user", "Null turn."), (8, 0, "user", "Same."), (8, 0, "user", "Same."), (9, 1, "assistant", "b."), (9, 1, "assistant", "a.")]
    return rows


def plain_conversations(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c]
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        if fault:
            by[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for c, said in by.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, kinds, names = set(), [], []
        for _, role, text in said:
            left = text.strip(SPACE)
            name = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            names.append(name)
            kinds.append({"blank": 1, "duplicate": 1, "truncated": 2, "": 0}[name])
        known = [t for t, _, _ in said if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in said]
        cost, audit = plain_repair(initials, kinds)
        text = turns.edited(audit, [r for _, r, _ in said], [t for _, _, t in said], turns.START)
        out.append((c, gaps, *(names.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha("\n".join(text))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fragment", [4096, 2])
def test_conversations_are_repaired_as_by_brute_force(spark, monkeypatch, fragment):
    monkeypatch.setattr(turns, "FRAGMENT", fragment)
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("row", "part", "fault", "blank", "of")}).repartition(5)
    got = turns.repair(turns.damaged(table), table.select("conv_id"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_conversations(rows)


def test_one_long_conversation_lies_in_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(turns, "FRAGMENT", 100)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"Message {rng.randrange(2500)}{rng.choice(['.', ''])}") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns.repair(turns.damaged(table), table.select("conv_id"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_conversations(rows)


def test_repair_of_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turns.repair(turns.damaged(empty), empty.select("conv_id")).collect() == []
    lost = turns.repair(empty, spark.createDataFrame([("c",)], "conv_id string")).collect()
    assert [tuple(r) for r in lost] == [("c", 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_faults_are_found_once(spark):
    """What comes after reads them from a table instead of joining the rows with their repetitions again."""
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "a."), (1, 2, "assistant", "b")], "conv_id long, turn int, role string, text string")
    found = turns.faults(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["turn"], r["blank"], r["duplicate"], r["truncated"]) for r in found.collect()) == [(0, False, False, False), (1, False, True, False), (2, False, False, True)]
