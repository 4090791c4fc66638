"""Each operator against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import binascii
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import chat, components, contamination, isolation, language_model, main_text, near_dedup, packing, ranking, registry, repeats, statistics, suffix_array, textkit, token_counts, transducer, wordbpe

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the an er on tion ing ou st re ment eau ß ö ción ÉÈ中 ' !! 12".split()


def corpus(n=120, seed=3, long_words=3000):
    """Random texts with copies, near copies, shared passages, nulls and empties."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    texts: list[str | None] = [None, "", " \n\t ", "one two", "One  TWO", passage]
    while len(texts) < n:
        kind, text = rng.random(), " ".join(word() for _ in range(rng.choice([3, 12, 80, 300])))
        if kind < 0.15 and len(texts) > 10:
            text = rng.choice([t for t in texts if t])
        elif kind < 0.35 and len(texts) > 10:
            w = rng.choice([t for t in texts if t]).split() or ["x"]
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.5:
            text = f"{text}\n{passage}\n{word()}"
        texts.append(text)
    texts.append(" ".join(word() for _ in range(long_words)))
    return texts


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def machine():
    return transducer.load(registry.tokenizer())


def rows_of(df):
    return {r[0]: r for r in df.collect()}


# ------------------------------------------------------------- tokenizing


def odd_texts(n=3000, seed=5):
    rng = random.Random(seed)
    bits = ["'s", "'t", "'re", "'LL", "'", "''s", "!", "12", "½", "Σ", "ΑΣ ", "İ", "é", "ß", "中文", "​", "\x1c", "\x85", "😀", "<|endoftext|>", "<|startoftext|>", "<|end", "The", "don't", "\n\n", "\xa0", "ﬁ", "a" * 90, "the" * 40, "x\0y"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_ids_and_counts_equal_the_library(machine, texts):
    every = odd_texts() + [t or "" for t in texts]
    want = [e.ids for e in machine.bpe.library.encode_batch(every, add_special_tokens=False)]
    assert [x.tolist() for x in transducer.encode(machine, every)] == want
    assert token_counts.count_texts(machine, every).tolist() == [len(x) for x in want]
    assert token_counts.count_texts(machine, every[:300], chunk=7).tolist() == [len(x) for x in want[:300]]


def test_transducer_agrees_with_merging(machine):
    words = [w.encode() for w in {"".join(random.Random(i).choices("abcdetshion", k=1 + i % 30)) for i in range(500)}]
    flat, first = machine.tokens(words)
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [machine.bpe.merge_word(w) for w in words]
    small = transducer.Transducer(wordbpe.load(registry.tokenizer()), states_limit=50)
    assert small.counts(words[:40]).tolist() == machine.counts(words[:40]).tolist() == small.counts(words[:40]).tolist()


def test_states_that_are_forgotten(machine):
    """Compilation may start afresh between calls, never within one: long words are walked in groups of their own."""
    rng = random.Random(7)
    make = lambda k: "".join(rng.choice("abcdefghilmnorstuéß") for _ in range(k)).encode()
    batches = [[make(rng.randint(2, 14)) for _ in range(300)] + [make(rng.randint(65, 90)) for _ in range(10)] for _ in range(5)]
    for limit in (50, 2000):
        small = transducer.Transducer(machine.bpe, states_limit=limit)
        for words in batches:
            want = [machine.bpe.merge_word(w) for w in words]
            flat, first = small.tokens(words)
            assert [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want
            assert small.counts(words).tolist() == list(map(len, want))


def test_characters_of_any_version(machine):
    """Case and composition are the library's, whatever version of Unicode Python follows."""
    every = [f"a{chr(p)}b{chr(p)}" for p in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]]
    some = every[::37] + [t for t in every if machine.bpe.library.normalizer.normalize_str(t) != t.lower()]
    some += ["\u1c89x", "\ua7cb \ua7dc", "\U00010d50\U00016ea0", "e\u0301 \u1c89", "\u212b\u03a3"]
    want = [e.ids for e in machine.bpe.library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in transducer.encode(machine, some)] == want


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9])
def test_chunk_maps_compose(machine, size):
    for text in ["ab cd\n efg hi j", "thethethetheth", "x'll y'r ''s 12ab!'!? don't''t", "ééé" * 9, "a1b2", "!!!!''!!", "it'sthe", *(t for t in odd_texts(150, 8) if "<|" not in t)]:
        text = machine.bpe.normalise(text)
        want = len(machine.bpe.library.encode(text, add_special_tokens=False).ids)
        assert token_counts.count_long(machine, text, size) == want
        maps = token_counts.chunk_maps(machine, text, size)
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m, machine)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = m.then(right, machine)
        assert left == right == token_counts.scan(maps, machine)
        run, total = token_counts.OUTSIDE, 0
        for m in maps:  # a run through all chunks one after another
            run, n = m(machine, run)
            total += n
        assert (run, total) == left(machine, token_counts.OUTSIDE)


def test_token_counts(spark, docs, texts, machine):
    got = rows_of(token_counts.count_tokens(docs, registry.tokenizer(), limit=100))
    for i, t in enumerate(texts):
        n = len(machine.bpe.library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs.where("false"), registry.tokenizer()).count() == 0


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_round_trip(spark, docs, texts, machine, capacity):
    ids = {i: [*machine.bpe.library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pack_documents(docs, registry.tokenizer(), capacity=capacity).orderBy("sequence_id", "offset").collect()
    covered, filled = defaultdict(list), defaultdict(int)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4")) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    assert max(filled.values()) <= capacity and sorted(filled) == list(range(len(filled)))
    assert len(filled) <= 1.1 * sum(map(len, ids.values())) / capacity + 2


def test_packing_of_nothing(docs):
    assert packing.pack_documents(docs.where("false"), registry.tokenizer()).count() == 0


def test_patterns_meet_the_demand():
    rng = np.random.default_rng(0)
    sizes = np.unique(rng.integers(1, 100, 40)) * 4  # small against the capacity: hardly any room need be lost
    demand = rng.integers(1, 900, len(sizes))
    patterns = packing.solve(sizes, demand, 1024)
    assert (sum(p * n for p, n in patterns) == demand).all() and all((p * sizes).sum() <= 1024 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.02 * (sizes * demand).sum() / 1024 + 3


# ---------------------------------------------------------- near-duplicates


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(sets, percent):
    label = list(range(len(sets)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize(("percent", "block"), [(85, 1_000_000), (80, 700)])
def test_near_duplicates(docs, texts, percent, block):
    sets = shingle_sets(texts)
    want = brute_components(sets, percent)
    got = rows_of(near_dedup.near_duplicates(docs, percent=percent, block=block))
    assert [tuple(got[i]) for i in range(len(texts))] == [(i, len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]


def test_one_of_each_group_stays(docs, texts):
    want = brute_components(shingle_sets(texts), 80)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i in range(len(texts)) if want[i] == i}


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b C d e f"), (None, "a b c d e f"), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = ("x1 x2 x3 x4 x5 x6 x7", "y1 y2 y3 y4 y5 y6 y7", "z1 z2 z3 z4 z5 z6")
    rows = [(1, a), (2, b), (5, a), (5, b), (7, c), (8, c), (8, None), (9, ""), (9, b), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    label = {}
    for r in got:
        label.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert label == {1: {1}, 2: {1}, 5: {1}, 7: {7}, 8: {7}, 9: {1}, None: {None}}
    assert {r["doc_id"] for r in got if r["kept"]} == {1, 7, None}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(none).count() == 0 == near_dedup.keep_one(none).count()
    assert repeats.repeats(none).count() == 0 == repeats.without_repeats(none).count()
    assert isolation.apply_rules(none, labels).count() == 0 == isolation.apply_rules(none, labels.where("false")).count()
    assert ranking.held_out_scores(none, labels).count() == 0 == ranking.held_out_scores(none, labels.where("false")).count()
    assert ranking.held_out_scores(docs, labels.where("false")).where("score <> 0.5").count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chats).count() == 0
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, shared in ((400, 300), (40, 36), (6, 5)):
        a = rng.integers(1, 1 << 62, 2 * size - shared).astype(np.uint64)
        key = np.concatenate([a[:size], a[size - shared :]])
        s = near_dedup.signatures(key, np.array([0, size, 2 * size]))
        assert abs((s[0] == s[1]).mean() - shared / (2 * size - shared)) < 0.16
        assert (s == near_dedup.signatures(key, np.array([0, size, 2 * size]), chunk=3)).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    pairs += [(i, 500) for i in range(501, 700)] + [(700, i) for i in range(650, 690)]  # stars
    label = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: v for x, v in label.items() if x in got} and all(label[x] == x for x in label.keys() - got.keys())


# ------------------------------------------------------------ exact repeats


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, texts):
    got = rows_of(repeats.repeats(docs))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_repeats(texts, 100)


def test_common_grams_change_nothing(monkeypatch, docs, texts):
    monkeypatch.setattr(repeats, "COMMON", 2)
    monkeypatch.setattr(repeats, "REPORTED", 1)
    seen = docs.selectExpr("doc_id as id", "coalesce(text, '') as text", "0 as tag")
    assert len(repeats.common_grams(seen, 100)) >= 3
    got = rows_of(repeats.repeats(docs))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_repeats(texts, 100)


def test_repeats_within_runs(spark):
    odd = ["a" * 700, "ab" * 300, "x" + "a" * 350 + "\0" + "b" * 120, None, "a" * 99, "é" * 120, "zé" + "é" * 119]
    got = rows_of(repeats.repeats(frame(spark, odd)))
    assert [tuple(got[i])[1:] for i in range(len(odd))] == brute_repeats(odd, 100)
    left = repeats.without_repeats(frame(spark, odd))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and left.count() == len(odd)


def test_segments_do_not_matter(monkeypatch, texts):
    data = pa.array(texts)
    a, b, raw, offs = next(textkit.slices(data, 1 << 30))
    whole = repeats.contexts(raw, offs)
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    cut = repeats.contexts(raw, offs)
    windows = lambda x: {(int(g), int(o), int(s) + k) for g, _, o, s, n in zip(*x, strict=True) for k in range(int(n))}
    assert windows(whole) == windows(cut)


@pytest.mark.parametrize("alphabet", [2, 3, 40])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 50, 3000):
        text = rng.integers(0, alphabet, n).astype(np.uint16)
        text[n // 3 : n // 2] = 1
        order = suffix_array.suffix_array(text, 64)
        whole = text.astype(">u2").tobytes()
        key = [whole[2 * i : 2 * i + 128] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(n)) and key == sorted(key)


# ------------------------------------------------------------------ rules


def brute_statistics(text):
    t = text or ""
    w, seen, later = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    grams, hit = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            hit.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), later, len(hit)


def test_rule_statistics(spark, texts):
    more = [*texts, "a b\na b\n\na b", "\n\n", "x\n x\nx\n", "# * |", "p q r s t p q r s t p", "ends\n", "\nbegins"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    got = rows_of(isolation.apply_rules(frame(spark, more), labels))
    for i, t in enumerate(more):
        want = brute_statistics(t)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert tuple(got[i])[1:7] == (*want, failed) and got[i]["kept"] == (not failed)  # labels of one kind: no forest


def good_and_bad(spark, n=400, seed=9):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(15, 200))]
        bad = i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "###" for x in w]
        rows.append((i, " ".join(w), 0 if bad else 1))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return both.select("doc_id", "text"), both.select("doc_id", "quality")


def test_forest_finds_the_odd_ones(spark):
    docs, labels = good_and_bad(spark)
    kept = {r["doc_id"]: r["kept"] for r in isolation.apply_rules(docs, labels).collect()}
    assert sum(k == (i % 5 != 0) for i, k in kept.items()) >= 396 and sum(kept.values()) >= 317


def test_paths_of_a_forest():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[30.0, 0, 0], [0, -25.0, 0]]])
    odd = isolation.grow(x).oddness(x)
    assert set(np.argsort(-odd)[:2]) == {500, 501} and ((odd > 0) & (odd <= 1)).all()
    assert {t.feature[0] for t in isolation.grow(x).trees} == {0, 1, 2}  # statistics are drawn at random


def brute_path(part, point, rng, depth, level=0):
    """Splits until a point is alone, by splitting the sample together with it."""
    low, high = part.min(0), part.max(0)
    wide = np.maximum(high, point) - np.minimum(low, point)
    if level == depth or not wide.sum() > 0:
        return level + float(isolation.usual_path(len(part)))
    k = rng.choice(len(wide), p=wide / wide.sum())
    at = rng.uniform(min(low[k], point[k]), max(high[k], point[k]))
    if not low[k] <= at < high[k]:
        return level + 1
    right = part[:, k] >= at
    if len(part) == 1:
        return level + float(isolation.usual_path(1))
    return brute_path(part[right == (point[k] >= at)], point, rng, depth, level + 1)


def test_expected_paths_are_those_of_random_splits():
    """Many trees that are split with the point in the sample have the same mean path as the trees grown without it."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (24, 2))
    for point in ([0.1, 0.2], [4.0, 0.0], [-9.0, 9.0], [1.5, -2.0]):
        trees = [isolation.grow_tree(x, rng, 8).path(np.array([point]))[0] for _ in range(1500)]
        brute = [brute_path(x, np.array(point), rng, 8) for _ in range(1500)]
        assert abs(np.mean(trees) - np.mean(brute)) < 0.25


def test_ranking(spark):
    docs, labels = good_and_bad(spark)
    got = ranking.held_out_scores(docs.unionAll(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 0) for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    again = {r["doc_id"]: r["score"] for r in ranking.held_out_scores(docs, turned).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got if r["doc_id"] < 1000)  # held-out labels change nothing
    one_kind = ranking.held_out_scores(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r[0] for r in one_kind] == [0.5]


# --------------------------------------------------------- decontamination


def brute_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    wins = {(i, tuple(w[k : k + 13])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 12))}
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most_broadcast", [contamination.MOST_BROADCAST, 0])
def test_contamination(spark, docs, texts, most_broadcast):
    some = [t for t in texts if t]
    items = [(i, " ".join(some[i].split()[:20])) for i in range(0, 40, 4)] + [(100, None), (101, "!!"), (102, "the"), (9, "same twice"), (10, "same twice")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(contamination.judge(docs, bench, most_broadcast=most_broadcast))
    want = brute_contamination(texts, items)
    assert [tuple(got[i])[1:] for i in range(len(texts))] == want
    clean = contamination.remove_documents(docs, bench)
    assert clean.columns == docs.columns and {r[0] for r in clean.collect()} == {i for i, w in enumerate(want) if not w[4]}
    spans = rows_of(contamination.remove_spans(docs, bench))
    assert all(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (spans[i]["text"] or "").translate(LOWER))) == w[0] - w[1] for i, w in enumerate(want))
    assert all(spans[i]["text"] == texts[i] for i, w in enumerate(want) if not w[1])


def test_no_benchmark(docs, texts):
    empty = docs.where("false").select(docs.doc_id.alias("item_id"), "text")
    assert contamination.judge(docs, empty).where("n_hit > 0 or contaminated").count() == 0
    assert contamination.judge(docs.where("false"), empty).count() == 0


def test_repeated_rows_stay(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "other words"), (None, "alpha beta gamma"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in contamination.judge(rows, bench).collect()) == [0, 0, 2, 2, 2]


# ------------------------------------------------------------------- chats


def test_chats(spark):
    rows = [
        (1, 0, "user", "Hello there\nWhat is X?"),
        (1, 1, "a", "X is a thing.\nIt is big."),
        (1, 2, "user", "On Monday, A wrote:\n> X is a thing.\n>> what is  X?\n\nI see."),
        (1, 3, "user", "> Hello there\nhi"),
        (1, 4, "a", "> I see.\nok"),
        (1, 5, "a", "> never said\nno"),
        (None, 1, "u", "> a\nb"),
        (2, 0, "u", None),
        (2, None, "u", "x"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "thread", "turn").collect()}
    assert {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None} == {(1, 2): 1, (1, 3): 0, (1, 4): 2}
    assert [k[1] for k in got if k[0] == 1] == [0, 3, 1, 2, 4, 5]  # what answers turn 0, then what answers turn 1
    assert got[1, 2]["content"] == "I see." and got[1, 2]["quote_depth"] == 2 and got[1, 2]["n_quoted"] == 2 and got[2, 0]["content"] == ""
    assert len(got) == len(rows)


def test_quotations_and_their_sql(spark, tmp_path):
    """Nested, wrapped anew, cut short, repeated, unknown: links and results by plain loops where few, by SQL for all."""
    import duckdb

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows, want = [], {}
    for conv in range(40):
        texts: list[str] = []
        for turn in range(rng.randint(2, 9)):
            own = "\n".join(" ".join(word() for _ in range(rng.randint(3, 9))) + rng.choice(["", ".", "!", "?"]) for _ in range(rng.randint(1, 5)))
            text = own
            if texts and rng.random() < 0.7:
                at = rng.randrange(len(texts))
                lines = texts[at].split("\n")
                kind = rng.choice(["lines", "wrapped", "shouted", "unknown", "nested"])
                if kind == "wrapped":  # the same words on lines of other lengths
                    words = " ".join(lines).split()
                    lines = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
                elif kind == "shouted":
                    lines = [f"  {x.upper()} " for x in lines]
                elif kind == "unknown":
                    lines = ["nobody said this"]
                mark = rng.choice(["> ", ">"]) if kind != "nested" else "> > "
                text = (f"On Monday, A wrote:\n" if rng.random() < 0.5 else "") + "\n".join(mark + x for x in lines) + "\n\n" + own
                if kind != "unknown":
                    want[conv, turn] = at
            rows.append((conv, turn, "user", text))
            texts.append(own)
    rows += [(90, 0, "u", None), (90, 1, "u", "> x\n"), (None, 2, "u", "> y"), (91, None, "u", "z"), (92, 0, "u", "one. two"), (92, 1, "u", ">> one.\n> TWO\nthree")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in got if r["reply_to"] is not None and r["conv_id"] < 90} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    result = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in result.description]
    plain = lambda rows: sorted(str([r[n] for n in sorted(names)]) for r in rows)
    assert plain([dict(zip(names, r, strict=True)) for r in result.fetchall()]) == plain([r.asDict() for r in got])


# ------------------------------------------------------------------- pages


@pytest.mark.parametrize(("page", "want"), [
    ('<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div id="sidebar">side</div><main><h1>T</h1><p>foo<b>bar</b> &amp; &lt;x&gt;</p><div class="cookie-notice">We use</div><form>name</form><p>end.</p></main><section id="comments"><p>c</p></section><footer>f</footer></body></html>', "T foobar & <x> end."),
    ("<nav><a>x</a><article><p>Hello", "Hello"),
    ("", ""),
    (None, ""),
    ("plain text", "plain text"),
    ("<p>a<br>b</p>", "a b"),
    ("<div>" + "long text here " * 20 + '</div><div><a href=x>link one</a></div><div class="ad">buy</div>', ("long text here " * 20).strip()),
    ('<article><p>one</p><article class="comment"><p>two</p></article><p>three</p></article>', "one three"),
    ('<article><p>x</p><script>var a="<p>no</p>";</script><!-- <p>c</p> --><p>y</p><style>p{}</style>', "x y"),
    ('<div class="page-with-sidebar"><div class="sidebar">s</div><article><div class="article-header"><h1>T</h1></div><p>x</p></article></div>', "T x"),
    ("<article>a < b and \n c&nbsp;d &copy; &#8364; &am", "<never>"),
])
def test_main_text(page, want):
    assert main_text.main_text(page) == ("a < b and c d © € &am" if want == "<never>" else want)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é x", 5), (2, None, None, 6)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in main_text.extract(df).orderBy("page_id").collect()] == [(1, "u", "é x", 3), (2, None, "", 0)]


# ---------------------------------------------------------- language model


def test_language_model(docs, texts):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    held = {i: binascii.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, scale = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    got = rows_of(language_model.score_documents(docs))
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / scale) for w in t), rel_tol=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(19, "a b"), (19, None)], "doc_id long, text string")
    got = language_model.score_documents(df.where("doc_id = 19")).collect()
    assert len(got) == 2 and all(np.isfinite(r["score"]) for r in got)
    assert language_model.score_documents(df.where("false")).count() == 0


# ------------------------------------------------------------------ kernel


def test_word_spans(texts):
    for size in (50, 1 << 20):
        got = []
        for _, _, data, offs in textkit.slices(pa.array(texts), size):
            s, e, first = textkit.word_spans(data, offs)
            words = [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
            got += [words[a:b] for a, b in zip(first, first[1:], strict=False)]
        assert got == [WORD.findall(t or "") for t in texts]


def test_statistics_of_nothing():
    empty = statistics.statistics(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert all((v == 0).all() and len(v) == 2 for v in empty.values())
