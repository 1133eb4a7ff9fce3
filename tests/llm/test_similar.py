"""Overlaps across splits and near-duplicate groups, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docskein.llm import ballhash, neardup, overlap
from docskein.llm.components import connected_components


def words(t):
    return set(re.findall(r"\w+", (t or "").lower()))


def brute(rows, threshold, least=1, sides=None):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a == b or sides and sides[a] == sides[b]:
                continue
            u, v = words(x), words(y)
            if min(len(u), len(v)) >= least and len(u & v) >= threshold * len(u | v):
                out.add((min(a, b), max(a, b)))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(20)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.choice((0, 1, 2, 4))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                rng.shuffle(base)
            rows.append((f"id{i:04}", " ".join(base)))
        else:
            rows.append((f"id{i:04}", " ".join(rng.sample(vocabulary, 20) + rng.sample(common, 12))))
    return rows


@pytest.mark.parametrize("crowd", [64, 2])
def test_pairs_match_brute_force(spark, crowd):
    rows = corpus(300, 3)
    df = spark.createDataFrame(rows, "id string, text string")
    members, links = ballhash.similar_texts(df, "id", "text", min_words=20, crowd=crowd)
    assert {tuple(r) for r in neardup.expand(members, links).collect()} == brute(rows, 0.7, 20)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 5000}" for i in range(200_000))
    text = " ".join(f"t{i}" for i in range(25))
    rows = [("a", None), ("b", ""), ("c", " \n"), ("d", text), ("d", text), ("e", text.upper()), ("f", text + " more"), ("g", long), ("h", long + " z"), ("i", "short text")]
    df = spark.createDataFrame(rows, "chunk_id string, doc string").withColumns({"code_snippet": F.lit(None).cast("string"), "id": F.lit(1), "text": F.lit("clash"), "class": F.lit(2)})
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "chunk_id", ["doc", "code_snippet"]).collect()}
    assert got == {("d", "e"), ("d", "f"), ("e", "f"), ("g", "h")}
    groups = {r.id: r.group for r in neardup.near_duplicate_groups(df, "chunk_id", ["doc", "code_snippet"]).collect()}
    assert groups == {"d": "d", "e": "d", "f": "d", "g": "g", "h": "g"}
    assert neardup.near_duplicate_pairs(df.limit(0), "chunk_id", ["doc", "code_snippet"]).count() == 0


def test_copies_in_one_group_are_one_class(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit(text).alias("text"))
    members, links = ballhash.similar_texts(df, "id", "text")
    assert members.select("class").distinct().count() == 1 and members.count() == 3000 and links.count() == 0


def test_splits(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, "train", "s", base), (2, "train", "s", base + " lambda"), (3, "test", "s", base.upper().replace(" ", ", ")), (4, "validation", None, base), (5, "test", "s", "other words here"),
        (6, "test", "s", None), (7, "train", "s", ""), (8, "other", "s", base), (9, None, "s", base), (3, "test", "s", base), (10, "test", "t", " ".join(base.split()[::-1])),
    ]
    df = spark.createDataFrame(rows, "id int, split string, source string, text string")
    got = sorted((r.eval_id, r.train_id, r.way) for r in overlap.split_overlap_pairs(df, "id", "text", "split", ["train"], ["validation", "test"]).collect())
    assert got == [(3, 1, 1), (3, 2, 3), (4, 1, 1), (4, 2, 3), (10, 1, 2), (10, 2, 3)]
    report = {(r.split, r.source): (r.records, r.overlapping, r.exact, r.pairs) for r in overlap.overlap_report(df.dropDuplicates(["id"]), "id", "text", "split", "source", ["train"], ["validation", "test"]).collect()}
    assert report == {("test", "s"): (3, 1, 1, 2), ("validation", None): (1, 1, 1, 2), ("test", "t"): (1, 1, 0, 2)}
    assert overlap.split_overlap_pairs(df.limit(0), "id", "text", "split", ["train"], ["test"]).count() == 0


def test_splits_match_brute_force(spark):
    rows = corpus(250, 5)
    sides = {a: i % 4 == 0 for i, (a, _) in enumerate(rows)}
    df = spark.createDataFrame([(a, "test" if sides[a] else "train", t) for a, t in rows], "id string, split string, text string")
    got = {(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in overlap.split_overlap_pairs(df, "id", "text", "split", ["train"], ["test"]).collect()}
    assert got == brute(rows, 0.7, 1, sides)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (10, 9), (9, 8), (8, 6)], "a long, b long")
    assert {tuple(r) for r in connected_components(links, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (8, 6), (9, 6), (10, 6)}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def test_near_copies_of_a_frequent_text(spark):
    """Nearly all rows are copies of one text, so that all its words are common and only the edits are rare."""
    base = [f"t{i}" for i in range(84)]
    near = [(f"near{k}", " ".join(f"e{k}x{i}" if k <= i < k + 14 else w for i, w in enumerate(base))) for k in range(0, 70, 10)]
    df = spark.createDataFrame([(f"copy{i}", " ".join(base)) for i in range(3000)] + near, "id string, text string")
    members, links = ballhash.similar_texts(df, "id", "text", min_words=20)
    assert members.count() == 3007 and sorted((r.shared, r.total) for r in links.collect()) == [(70, 98)] * 7


def test_short_texts(spark):
    rows = [("a", "one"), ("b", "One!"), ("c", "one two"), ("d", "two one"), ("e", "one two three"), ("f", "one two three four"), ("g", "..."), ("h", "other")]
    df = spark.createDataFrame(rows, "id string, text string")
    for threshold in (0.7, 0.5):
        members, links = ballhash.similar_texts(df, "id", "text", threshold=threshold, crowd=2)
        assert {tuple(r) for r in neardup.expand(members, links).collect()} == brute([r for r in rows if words(r[1])], threshold)
