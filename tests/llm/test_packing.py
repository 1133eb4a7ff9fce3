"""Packing: everything placed once, nothing over capacity, near the least number of sequences."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docskein.llm import packing


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 100), min_size=0, max_size=40), st.integers(100, 300))
def test_windows(sizes, capacity):
    found = packing.windows(sizes, capacity)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in found)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(("train", "test")), "x" * rng.choice((1, 50, 300, 700, 2500))) for i in range(600)]
    rows += [(1000, "train", None), (1001, "train", ""), (1002, "other", "x"), (1003, None, "x"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    limits = spark.createDataFrame([("train", 1000), ("test", 400), ("none", 0), (None, 5)], "split string, max_chars int")
    got = packing.pack(df, "id", "text", "split", limits, "split", "max_chars", shard_records=100).collect()
    length = {i: len(t) for i, s, t in rows if t and s in ("train", "test")}
    pieces, fill = {}, {}
    for r in got:
        pieces.setdefault(r.id, []).append((r.start, r.length))
        fill.setdefault((r.group, r.sequence), []).append((r.place, r.length))
    assert set(pieces) == set(length)
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == length[i]
    for (group, _), p in fill.items():
        assert sum(n for _, n in p) <= {"train": 1000, "test": 400}[group]
        assert sorted(x for x, _ in p) == list(range(len(p)))
    for group in ("train", "test"):
        numbers = sorted(s for g, s in fill if g == group)
        assert numbers == list(range(len(numbers)))
    report = {r.group: r for r in packing.fill_report(packing.pack(df, "id", "text", "split", limits, "split", "max_chars"), limits, "split", "max_chars").collect()}
    assert all(r.sequences <= 1.1 * r.least + 2 for r in report.values())
    assert packing.pack(df.limit(0), "id", "text", "split", limits, "split", "max_chars").count() == 0
