"""What a task holds at a time, as Python counts it."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from loomgraph.llm import near_dedup, textkit


def test_sketches_hold_little_at_a_time():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    column = pa.array([" ".join(rng.choices(words, k=500)) for _ in range(1500)])
    textkit.powers(1)
    tracemalloc.start()
    try:
        rows = 0
        for a, b, data, offs in textkit.slices(column):
            rows += b - a
            near_dedup.signatures(*near_dedup.shingles(data, offs))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1500 and peak < 60 << 20, peak >> 20
