"""Evaluation texts leaking into training text (problem 7).

Texts are normalised to their lower-case words joined by single blanks. A passage that an item field and a document share, with
at most edit_budget edits of characters, lies within edit_budget diagonals (place in the document minus place in the item) of
its start. By the q-gram lemma a passage of length m with e edits shares at least m - q + 1 - e*q of its q-grams. So:

1. Items are taken in blocks of bounded size (block_chars); the q-grams of a block are a sorted array that is broadcast. m is
   the shortest passage of min_words words that a field has, and q the greatest of SIZES with q <= m / (e + 1), so that the bound is
   positive for each field.
2. Each document's q-grams, computed for whole batches at once, are looked up in it. Places with too few hits around them for
   any field are left out; the others are counted in overlapping bands of diagonals, without gaps that e edits can't explain.
   Bands with enough shared q-grams for the field remain as regions. Items that share their q-grams with many others are
   expanded in ranges, so that one batch never holds more than EXPANDED hits and those of one field.
3. Each region is verified by a banded alignment: furthest reaching points (Landau and Vishkin, 1989) on the diagonals of the
   band, from all word starts at once, with up to e insertions, deletions and substitutions.

The documents are scanned in place and never shuffled; only verified hits leave the tasks. With several blocks each is run and
staged before the next is sent, so one block is held at a time. Null, empty and short texts give no hits; repeated documents are
each reported; an item field with fewer words than min_words can't leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docskein.llm.arrays import U64, code_points, hash_runs, mix, slices, word_table
from docskein.session import stage

#: Lengths of q-grams, the longest first.
SIZES = (16, 12, 10, 8, 6, 5, 4, 3, 2, 1)
#: Hits of one batch that are held at once.
EXPANDED = 4_000_000
PREFILTER_BITS = 22
GAP = 32


def normalised(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): the words of each text joined and ended by single blanks; text i is points[bounds[i]:bounds[i+1]]."""
    lowered = [(t or "").lower() for t in texts]
    points = code_points("\n".join(lowered) + "\n")
    inside = word_table()[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first character after a word becomes the blank that ends it
    ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(keep)])
    return np.where(inside, points, GAP)[keep], count[np.concatenate([[0], ends])]


def _qgrams(points: np.ndarray, q: int) -> np.ndarray:
    begins = np.arange(max(0, len(points) - q + 1))
    return hash_runs(points, begins, begins + q)


class Index:
    """The q-grams of the fields of a block that have the same q."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray, fields: np.ndarray, shortest: np.ndarray, q: int, edits: int):
        self.q, self.bounds = q, bounds
        grams = _qgrams(points, q)
        at = np.arange(len(grams))
        field = np.searchsorted(bounds, at, side="right") - 1
        mine = np.zeros(len(bounds), dtype=bool)
        mine[fields] = True
        ok = mine[field] & (at + q <= bounds[np.minimum(field + 1, len(bounds) - 1)])
        self.grams, rank = np.unique(grams[ok], return_inverse=True)
        self.keys = np.sort((rank.astype(np.int64) << 32) | at[ok])  # by q-gram, then by place
        self.filter = np.zeros(1 << PREFILTER_BITS, dtype=bool)
        self.filter[(self.grams >> U64(64 - PREFILTER_BITS)).astype(np.int64)] = True
        self.least = np.zeros(len(bounds), dtype=np.int64)
        self.least[fields] = np.maximum(1, shortest[fields] - q + 1 - edits * q)
        self.fewest = int(self.least[fields].min())
        self.window = int(shortest[fields].min()) - q + 1 + edits

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the q-grams that occur in the index, where enough of them lie close together."""
        grams = _qgrams(points, self.q)
        at = np.flatnonzero(self.filter[(grams >> U64(64 - PREFILTER_BITS)).astype(np.int64)])
        rank = np.searchsorted(self.grams, grams[at])
        ok = self.grams[np.minimum(rank, len(self.grams) - 1)] == grams[at]
        at, rank = at[ok], rank[ok]
        n = self.fewest
        if len(at) < n:
            return at[:0], rank[:0]
        begins = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] < self.window)
        near = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(near, begins, 1)
        np.add.at(near, begins + n, -1)
        ok = np.cumsum(near)[:-1] > 0
        return at[ok], rank[ok]

    def expanded(self, at: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the documents, places in the items) of all hits, in ranges of item fields."""
        low, high = np.searchsorted(self.keys, rank.astype(np.int64) << 32), np.searchsorted(self.keys, (rank.astype(np.int64) + 1) << 32)
        total = int((high - low).sum())
        parts = max(1, -(-total // EXPANDED))
        cuts = np.unique(np.searchsorted(self.bounds, np.linspace(0, self.bounds[-1], parts + 1)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts > 1:
                low = np.searchsorted(self.keys, (rank.astype(np.int64) << 32) | self.bounds[a])
                high = np.searchsorted(self.keys, (rank.astype(np.int64) << 32) | self.bounds[b])
            many = high - low
            place = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(at, many), self.keys[place] & 0xFFFFFFFF


class Block:
    """A block of item fields, in the form that is broadcast."""

    def __init__(self, keys: list[tuple], texts: list, min_words: int, edits: int, min_chars: int = 0):
        self.keys, self.min_words, self.edits = keys, min_words, edits
        self.points, self.bounds = normalised(texts)
        self.gaps = np.concatenate([[0], np.cumsum(self.points == GAP)])
        ends = np.flatnonzero(self.points == GAP)
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
        shortest = np.zeros(len(self.bounds), dtype=np.int64)
        first = np.searchsorted(starts, self.bounds[:-1])
        for f, (i, j) in enumerate(zip(first, np.append(first[1:], len(starts)))):
            if j - i >= min_words:  # the shortest passage of min_words words, without the blank behind it
                shortest[f] = max(min_chars, int((ends[i + min_words - 1 : j] - starts[i : j - min_words + 1]).min()))
        sizes = np.array(SIZES)
        fitting = sizes[np.argmax(sizes[None, :] * (edits + 1) <= np.maximum(shortest, 1)[:, None], axis=1)]
        self.indexes = []
        for q in SIZES:
            fields = np.flatnonzero((fitting == q) & (shortest > 0))
            if len(fields):
                self.indexes.append(Index(self.points, self.bounds, fields, shortest, q, edits))

    def find(self, texts: list) -> list[tuple[int, int, int, int]]:
        """(text index, field index, words, equal words) of every text and field that share a passage; see leaked_passages."""
        points, bounds = normalised(texts)
        gaps = None
        found: dict[tuple[int, int], tuple[int, int]] = {}
        width = self.edits + 1
        for index in self.indexes:
            at, rank = index.hits(points)
            if not len(at):
                continue
            if gaps is None:
                gaps = np.concatenate([[0], np.cumsum(points == GAP)])
            for doc_at, item_at in index.expanded(at, rank):
                if not len(doc_at):
                    continue
                text = np.searchsorted(bounds, doc_at, side="right") - 1
                field = np.searchsorted(self.bounds, item_at, side="right") - 1
                diagonal = doc_at - item_at
                # Bands of 2 * width diagonals that overlap by width; without edits a band is one diagonal.
                for shift in (0,) if self.edits == 0 else (0, width):
                    band = (diagonal + shift) // (1 if self.edits == 0 else 2 * width)
                    order = np.lexsort((doc_at, band, field, text))
                    t, f, b, p = text[order], field[order], band[order], doc_at[order]
                    new = np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (b[1:] != b[:-1]) | (np.diff(p) > self.edits * (index.q + 1) + 1)])
                    begin = np.flatnonzero(new)
                    size = np.diff(np.append(begin, len(order)))
                    enough = size >= index.least[f[begin]]
                    for i, n in zip(begin[enough], size[enough]):
                        pair = int(t[i]), int(f[i])
                        have = found.get(pair, (0, 0))
                        if have[1] < self.min_words:
                            got = self._align(points, gaps, bounds[pair[0]], bounds[pair[0] + 1], pair[1], int(p[i]), int(p[i + n - 1]) + index.q, diagonal[order[i : i + n]], index.q)
                            found[pair] = max(have[0], got[0]), max(have[1], got[1])
        return [(t, f, *n) for (t, f), n in found.items() if n[0] >= self.min_words]

    def _align(self, points: np.ndarray, gaps: np.ndarray, begin: int, end: int, field: int, first: int, last: int, diagonals: np.ndarray, q: int) -> tuple[int, int]:
        """(words aligned with at most the budget of edits, words that are equal) from the best word start of a region.

        Rows are diagonals of the band, columns places of the document; stop is the next place where a diagonal differs. Before
        the first and behind the last shared q-gram of a passage lie at most e * (q + 1) characters of it, so it is in reach.
        """
        e = self.edits
        a, b = int(self.bounds[field]), int(self.bounds[field + 1])
        lo, hi = max(begin, first - (e + 1) * (q + 1)), min(end, last + (e + 1) * (q + 1))
        d = np.arange(int(diagonals.min()) - e, int(diagonals.max()) + e + 1)
        stop = self._stops(points, lo, hi, d, a, b)
        at = np.arange(lo, hi)
        item = at[None, :] - d[:, None]
        inside = (item >= a) & (item < b)
        doc_start = (at == begin) | (points[np.maximum(at - 1, 0)] == GAP)
        item_start = inside & ((item == a) | (self.points[np.clip(item - 1, 0, len(self.points) - 1)] == GAP))
        row, column = np.nonzero(item_start & doc_start[None, :])
        if not len(row):
            return 0, 0
        start = at[column]

        def words(reach: np.ndarray, of_row: np.ndarray) -> np.ndarray:
            item_from, item_to = start - d[row], np.clip(reach - d[of_row], a, b)
            return np.minimum(gaps[np.clip(reach, begin, end)] - gaps[start], self.gaps[item_to] - self.gaps[item_from])

        exact_reach = stop[row, column]
        exact = int(words(exact_reach, row).max())
        if e == 0:
            return exact, exact
        none = -1
        reach = np.full((len(d), len(start)), none, dtype=np.int64)
        reach[row, np.arange(len(start))] = exact_reach
        best = exact
        size = hi - lo
        for _ in range(e):
            step = np.where(reach >= 0, reach + 1, none)  # a character replaced
            step[1:] = np.maximum(step[1:], np.where(reach[:-1] >= 0, reach[:-1] + 1, none))  # one inserted in the document
            step[:-1] = np.maximum(step[:-1], reach[1:])  # one left out of it
            step = np.maximum(step, reach)
            ok = (step >= 0) & (step - d[:, None] <= b)
            slid = np.where(step < hi, stop[np.arange(len(d))[:, None], np.clip(step - lo, 0, size - 1)], hi)
            reach = np.where(ok, np.minimum(np.maximum(step, slid), hi), none)
            for k in range(len(d)):
                on = reach[k] >= 0
                if on.any():
                    best = max(best, int(np.where(on, words(np.maximum(reach[k], start), np.full(len(start), k)), 0).max()))
        return best, exact

    def _stops(self, points: np.ndarray, lo: int, hi: int, d: np.ndarray, a: int, b: int) -> np.ndarray:
        """For each diagonal and each place from lo to hi the next place at which the document and the field differ."""
        at = np.arange(lo, hi)
        item = at[None, :] - d[:, None]
        equal = (item >= a) & (item < b) & (points[lo:hi][None, :] == self.points[np.clip(item, 0, len(self.points) - 1)])
        stop = np.where(equal, hi, at[None, :])
        return np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]


def leaked_passages(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], min_words: int = 12, edit_budget: int = 1, min_chars: int = 0, block_chars: int = 4_000_000
) -> DataFrame:
    """item_id, doc_id, field, words, equal: documents with a passage of min_words words of an item's field, once for each field.

    The passage has at least min_chars characters and at most edit_budget edits of characters. words is the length of a passage
    found (at least min_words; not always the longest one), equal that of a run of consecutive equal words in it.
    """
    spark = documents.sparkSession
    flat = items.select(F.col(item_id).alias("item_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select("item_id", "x.*").where(F.length("text") >= 2 * min_words - 1)
    chars = flat.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    doc_kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for k in range(blocks):
        rows = flat.where(F.pmod(F.xxhash64("item_id", "field"), F.lit(blocks)) == k).orderBy("item_id", "field").collect()
        block = spark.sparkContext.broadcast(Block([(r.item_id, r.field) for r in rows], [r.text for r in rows], min_words, edit_budget, min_chars))

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices(texts):
                    hits = own.find(texts[a:b])
                    if hits:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([own.keys[f][0] for _, f, _, _ in hits], item_type),
                                batch.column(0).take(pa.array([a + t for t, _, _, _ in hits])),
                                pa.array([own.keys[f][1] for _, f, _, _ in hits]),
                                pa.array([n for _, _, n, _ in hits], pa.int32()),
                                pa.array([n for _, _, _, n in hits], pa.int32()),
                            ],
                            ["item_id", "doc_id", "field", "words", "equal"],
                        )

        part = documents.select(doc_id, text).mapInArrow(scan, f"item_id {item_kind}, doc_id {doc_kind}, field string, words int, equal int")
        if blocks > 1:
            part = stage(part, "leaks")
            block.destroy()
        out = part if out is None else out.union(part)
    return out


def leaking_documents(*args, min_words: int = 12, **kwargs) -> DataFrame:
    """item_id, doc_id: each item and document that share min_words consecutive words, once; edited passages need as many equal words."""
    return leaked_passages(*args, min_words=min_words, **kwargs).where(F.col("equal") >= min_words).select("item_id", "doc_id").distinct()
