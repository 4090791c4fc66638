"""Texts without an id are told apart, however many there are."""

from hashlib import sha256

from loomgraph.llm import repeats

SHARED = sha256(b"a").hexdigest() + sha256(b"b").hexdigest()


def test_many_texts_without_id(spark):
    # about 90 pairs of these share 16 bits of a hash
    texts = [sha256(b"x%d" % i).hexdigest() + sha256(b"y%d" % i).hexdigest() + (SHARED if i % 2 else "") for i in range(3500)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"]) for r in repeats.repeats(df).collect()]
    assert sorted(n for n, _ in got) == sorted(map(len, texts))
    assert {g for n, g in got if n == 128} == {0}
    # one keeps the passage; the others lose it, and characters before it that another has too
    removed = sorted(g for n, g in got if n == 256)
    assert removed[0] == 0 and removed[1] >= 128 and removed[-1] < 140
