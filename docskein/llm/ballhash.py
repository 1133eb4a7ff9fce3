"""Pairs of texts with similar word sets, by meet-in-the-middle ball hashing that misses no pair.

The overlap of two texts is the number of distinct words they share divided by the number of distinct words in either.

1. Word counts over all texts are kept in a table of fixed size (2^18 buckets of word hashes). They only set the order of
   the words, rare ones first, and so the cost; no result depends on them.
2. A text of n words that keeps the overlap with another has at most e = n - ceil(threshold * n) words which the other lacks. So
   the first k words they share are among its first e + k. Its fingerprint is these words, and its ball all sets of k of them.
   With a text that isn't smaller it shares at least 2 * threshold / (1 + threshold) * n words, so that fewer of its words need to
   be looked at from that side (as in the PPJoin of Xiao et al., 2008); in the others it is only a probe for smaller texts.
3. Two balls meet in a common variant, the set of the first k shared words; an equality shuffle on variants brings the
   texts together. k begins at 1. A variant with more than ``crowd`` classes that aren't probes isn't paired out: each member passes
   it on with one more of its words (k + 1), and so on up to ``DEPTH`` words, where all are paired out.
4. Texts with equal word sets are one class before anything is emitted, so a group of copies costs one fingerprint.
5. Where two texts meet, their sizes and the places of the variant's last word bound the words they can share, and a parity
   sketch of 128 bits bounds the number of differing words from below. Pairs that cannot reach the threshold stay out (never one
   that can); the others are deduplicated and verified on their whole texts.

Null or empty texts have no words and are in no pair. Repeated rows of one id count once. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.llm.arrays import U64, mix, slices, word_sets
from docskein.session import release, stage

BUCKETS = 1 << 18
#: The most words in a variant.
DEPTH = 8


def bucket_counts(texts: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """In how many texts the words of each bucket occur, and the number of texts. All texts count.

    Brings at most 2^18 rows to the driver, whatever the size of the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            values = batch.column(0).to_pylist()
            n += len(values)
            for a, b in slices(values):
                total += np.bincount((word_sets(values[a:b])[1] & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["bucket", "n"])

    rows = texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    known = rows[rows.bucket >= 0]
    out[known.bucket.to_numpy(np.int64)] = known.n.to_numpy(np.int64)
    return out, int(rows.n[rows.bucket < 0].sum())


def fingerprints(texts: list, counts: np.ndarray, min_words: int, threshold: float) -> list[tuple]:
    """(place in texts, class, words, parity1, parity2, first words) of each text with at least min_words words."""
    owner, hashes = word_sets(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    least = max(min_words, 1)
    kept = np.flatnonzero(sizes >= least)
    if not len(kept):
        return []
    inside = sizes[owner] >= least
    owner, hashes = np.searchsorted(kept, owner[inside]), hashes[inside]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    mixed = mix(hashes, 1)
    with np.errstate(over="ignore"):
        classes = mix(np.add.reduceat(mixed, starts), 2)
    bits = U64(1) << (mixed >> U64(58))
    half = (mixed >> U64(57)) & U64(1)
    parity = [np.bitwise_xor.reduceat(np.where(half == i, bits, U64(0)), starts) for i in (U64(0), U64(1))]
    n = sizes[kept]
    order = np.lexsort((hashes, counts[(hashes & U64(BUCKETS - 1)).astype(np.int64)], owner))
    first = np.arange(len(owner)) - starts[owner] < (n - _least_shared(n, threshold) + DEPTH)[owner]
    words = np.split(hashes[order][first].astype(np.int64), np.cumsum(np.bincount(owner[first]))[:-1])
    return [(int(k), c, int(m), p, q, w) for k, c, m, p, q, w in zip(kept, classes.view(np.int64), n, parity[0].view(np.int64), parity[1].view(np.int64), words)]


def _least_shared(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its n words a text shares at least with one that has the overlap."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def fingerprint_table(df: DataFrame, id_col: str, text_col: str, side_col: str, counts: np.ndarray, min_words: int, threshold: float) -> DataFrame:
    """A row for each input row with enough words: id, side, class, number of words, parities and first words, rare ones first."""
    schema = df.select(id_col, side_col).schema
    out = f"id {schema[0].dataType.simpleString()}, side {schema[1].dataType.simpleString()}, class long, n int, p1 long, p2 long, words array<long>"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    shared = df.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in slices(values):
                rows = fingerprints(values[a:b], shared.value, min_words, threshold)
                if rows:
                    place, *rest, words = zip(*rows)
                    at = pa.array([a + k for k in place])
                    flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(w) for w in words]), pa.int32()), pa.array(np.concatenate(words)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(2).take(at), *(pa.array(np.array(x), t) for x, t in zip(rest, types)), flat],
                        ["id", "side", "class", "n", "p1", "p2", "words"],
                    )

    return df.select(id_col, text_col, side_col).mapInArrow(run, out)


def _met(crowd: int | None, k: int, threshold: float):
    """What meets under equal variants of k words, of rows sorted by variant and tag: variant, class, tag, p1, p2.

    Yields (a, b, null, null) for a pair of classes that can have the overlap and has different marks, and (a, null, variant, tag)
    for each member of a crowded variant. A tag is probe << 62 | size << 32 | place << 2 | marks; place is that of the variant's last
    word in the text. marks: bit 1 for a class found on side 0, bit 2 for one on side 1, or 3 where sides don't matter. Of two
    similar texts the smaller one is never a probe, so only pairs with a row that isn't one are looked at, and these come first in
    their variant: at most crowd of them are held, while any number of probes goes past in batches.
    """

    def passed(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(len(rows[1]), pa.int64()), pa.array(rows[0]), pa.array(rows[2])], ["a", "b", "hot", "tag"])

    def pairs(x, y) -> Iterator[pa.RecordBatch]:
        """x, y: rows next to each other that meet."""
        nx, ny = ((z[2] >> 32) & 0x3FFFFFFF for z in (x, y))
        most = [k + n - ((z[2] >> 2) & 0x3FFFFFFF) - 1 for n, z in ((nx, x), (ny, y))]  # words it can share if these are the first k
        mx, my = x[2] & 3, y[2] & 3
        ok = np.minimum(*most) >= threshold / (1 + threshold) * (nx + ny) - 1e-6
        ok &= np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-6
        ok &= (x[1] != y[1]) & (((mx & (my >> 1)) | ((mx >> 1) & my)) > 0)
        at = np.flatnonzero(ok)
        differing = sum(np.bitwise_count((x[c][at] ^ y[c][at]).view(np.uint64)).astype(np.int64) for c in (3, 4))
        at = at[differing <= (1 - threshold) / (1 + threshold) * (nx + ny)[at] + 1e-6]
        if len(at):
            i, j = x[1][at], y[1][at]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), *[pa.nulls(len(i), pa.int64())] * 2], ["a", "b", "hot", "tag"])

    def meet(rows, first, many) -> Iterator[pa.RecordBatch]:
        """Each row with the many rows from place first on, in parts of a bounded number of pairs."""
        total = np.cumsum(many)
        begin = 0
        while begin < len(many):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 1_000_000, side="right")))
            n = many[begin:end]
            y = np.repeat(np.arange(begin, end), n)
            x = np.repeat(first[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(x):
                yield from pairs([c[x] for c in rows], [c[y] for c in rows])
            begin = end

    def finished(rows) -> Iterator[pa.RecordBatch]:
        """Whole variants."""
        new = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        size = np.diff(np.append(new, len(rows[0])))
        held = np.add.reduceat((rows[2] >> 62 == 0).astype(np.int64), new)
        first, rank = np.repeat(new, size), np.arange(len(rows[0])) - np.repeat(new, size)
        held = np.repeat(held, size)
        if crowd is not None and (held > crowd).any():
            yield passed([c[held > crowd] for c in rows])
            held = np.where(held > crowd, 0, held)
        yield from meet(rows, first, np.minimum(held, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, dtype=np.int64)] * 5
        held, key, probing, hot = none, None, False, False  # the rows of the last variant that aren't probes

        def more(rows) -> Iterator[pa.RecordBatch]:
            """Further rows of the last variant."""
            nonlocal held, probing, hot
            at = int(np.searchsorted(rows[2] >> 62, 1))
            if at and not hot:
                held = [np.concatenate([h, c[:at]]) for h, c in zip(held, rows)]
                if crowd is not None and len(held[0]) > crowd:
                    hot = True
                    yield passed(held)
                    held = none
            elif at:
                yield passed([c[:at] for c in rows])
            if at < len(rows[0]):
                rest = [c[at:] for c in rows]
                if hot:
                    yield passed(rest)
                    return
                yield from closed()
                probing = True
                m = len(held[0])
                both = [np.concatenate([h, c]) for h, c in zip(held, rest)]
                count = np.concatenate([np.zeros(m, dtype=np.int64), np.full(len(rest[0]), m)])
                yield from meet(both, np.zeros(len(count), dtype=np.int64), count)

        def closed() -> Iterator[pa.RecordBatch]:
            """The held rows with one another, once."""
            if not probing and not hot and len(held[0]) > 1:
                yield from meet(held, np.zeros(len(held[0]), dtype=np.int64), np.arange(len(held[0])))

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if not len(rows[0]):
                continue
            if key is not None:
                n = int(np.searchsorted(rows[0], key, side="right"))
                if n:
                    yield from more([c[:n] for c in rows])
                if n == len(rows[0]):
                    continue
                yield from closed()
                rows = [c[n:] for c in rows]
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if last:
                yield from finished([c[:last] for c in rows])
            held, key, probing, hot = none, rows[0][-1], False, False
            yield from more([c[last:] for c in rows])
        yield from closed()

    return run


def _tag(place: Column, k: int, threshold: float, end: Column | None = None) -> Column:
    """The tag of a class in a variant of k words with its last word at a place; see _met."""
    n = F.col("n").cast("long")
    shared = F.ceil(2 * threshold / (1 + threshold) * F.col("n") - 1e-9)  # with a text that isn't smaller
    probe = place >= F.col("n") - shared + k
    if end is not None:
        probe = probe & ~end
    return F.shiftleft(probe.cast("long"), 62) + F.shiftleft(n, 32) + F.shiftleft(place.cast("long"), 2) + F.col("marks")


def _candidates(carried: DataFrame, threshold: float, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b: the pairs of classes (class, n, words, marks, p1, p2) that meet in a variant and can have the overlap by sizes, places
    and parities, the staged tables they are read from)."""
    carried = carried.withColumn("least", F.ceil(threshold * F.col("n") - 1e-9).cast("int"))
    emitted = carried.select(F.posexplode(F.slice("words", 1, F.col("n") - F.col("least") + 1)).alias("place", "variant"), "class", "n", "marks", "p1", "p2")
    emitted = emitted.select("variant", "class", _tag(F.col("place"), 1, threshold).alias("tag"), "p1", "p2")
    found, used = None, []
    for k in range(1, DEPTH + 1):
        met = emitted.repartition("variant").sortWithinPartitions("variant", "tag").mapInArrow(_met(crowd if k < DEPTH else None, k, threshold), "a long, b long, hot long, tag long")
        met = stage(met, "met")
        used.append(met)
        pairs = met.where("hot IS NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        hot = met.where("hot IS NOT NULL").select(F.col("a").alias("class"), "hot", "tag")
        if not hot.limit(1).count():
            break
        # Each member adds one of its next words, or an end mark if the words so far may be all it shares.
        place = F.shiftright(F.col("tag"), 2).bitwiseAND(0x3FFFFFFF).cast("int")
        further = F.transform(
            F.sequence(place + 1, F.col("n") - F.col("least") + k),
            lambda i: F.struct(i.alias("place"), F.get("words", i).alias("word")),
        )
        further = F.when(place + 1 <= F.least(F.col("n") - F.col("least") + k, F.col("n") - 1), further).otherwise(F.array().cast("array<struct<place:int,word:bigint>>"))
        end = F.when(F.col("least") <= k, F.array(F.struct(F.col("n").alias("place"), F.lit(-1).cast("long").alias("word")))).otherwise(F.array().cast("array<struct<place:int,word:bigint>>"))
        more = hot.join(carried, "class").select("class", "hot", "n", "marks", "p1", "p2", F.explode(F.concat(further, end)).alias("next")).where("next.word IS NOT NULL")
        emitted = more.select(F.xxhash64("hot", "next.word").alias("variant"), "class", _tag(F.col("next.place"), k + 1, threshold, F.col("next.word") == -1).alias("tag"), "p1", "p2")
    return found.distinct(), used


def _overlaps(text_x: list, text_y: list) -> tuple[np.ndarray, np.ndarray]:
    """The number of shared words and of words in either, of each pair of texts."""
    shared, either = np.zeros(len(text_x), dtype=np.int64), np.zeros(len(text_x), dtype=np.int64)
    for a, b in slices([(x or "") + (y or "") for x, y in zip(text_x, text_y)]):
        for begin in range(a, b, 30_000):
            end = min(b, begin + 30_000)
            n = end - begin
            owner, hashes = word_sets(text_x[begin:end] + text_y[begin:end])
            both, copies = np.unique((owner % n).astype(U64) << U64(48) | hashes, return_counts=True)
            pair = (both >> U64(48)).astype(np.int64)
            either[begin:end] = np.bincount(pair, minlength=n)
            shared[begin:end] = np.bincount(pair[copies > 1], minlength=n)
    return shared, either


def similar_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    side_col: str | None = None,
    threshold: float = 0.7,
    min_words: int = 1,
    crowd: int = 512,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of texts with equal word sets, and the pairs of classes that overlap.

    members: id, side, class, n (distinct words); a row for each id with at least min_words words.
    links: class_1, class_2, shared, total; pairs of classes with shared / total >= threshold, class_1 < class_2. With a
    side_col (0 or 1), only pairs of classes of which one has members on side 0 and the other on side 1.
    """
    side = F.lit(0) if side_col is None else F.col(side_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), side.cast("int").alias("side"))
    counts, _ = bucket_counts(rows, "text")
    prints = stage(fingerprint_table(rows, "id", "text", "side", counts, min_words, threshold), "fingerprints")
    members = stage(prints.groupBy("id", "class").agg(F.min("side").alias("side"), F.min("n").alias("n")), "members")
    # One row of each class carries its words: copies are reduced on the map side, and the classes are shuffled once for all levels.
    marks = F.lit(3) if side_col is None else F.bit_or(F.col("side") + 1)
    classes = prints.groupBy("class").agg(F.first("n").alias("n"), F.first("words").alias("words"), marks.alias("marks"), F.min("id").alias("id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    classes = stage(classes, "classes")
    release(prints)
    found, used = _candidates(classes.drop("id"), threshold, crowd)
    names = classes.select("class", "id")
    pairs = found.join(names.toDF("a", "id_x"), "a").join(names.toDF("b", "id_y"), "b").select("a", "b", "id_x", "id_y")
    pairs = stage(pairs, "reachable")
    release(*used, classes)
    wanted = pairs.select(F.col("id_x").alias("id")).union(pairs.select("id_y")).distinct()
    texts = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    both = pairs.join(texts.select(F.col("id").alias("id_x"), F.col("text").alias("text_x")), "id_x").join(texts.select(F.col("id").alias("id_y"), F.col("text").alias("text_y")), "id_y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, either = _overlaps(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(either)], ["class_1", "class_2", "shared", "total"])

    links = both.select("a", "b", "text_x", "text_y").mapInArrow(verify, "class_1 long, class_2 long, shared long, total long")
    return members, links.where(F.col("shared") >= threshold * F.col("total") - 1e-9)
