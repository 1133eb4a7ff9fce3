"""Text garbled by a wrong character encoding (problem 8).

1. Adjacent character pairs are counted over all texts, in a table of fixed size (pairs hashed to 2^20 buckets), beside the
   counts of single characters. Runs that can't be right text (valid UTF-8 once encoded again, or replacement and control
   characters) aren't counted, so that garbled rows don't vouch for themselves, however many they are.
2. A pair is scored by its corpus mutual information, in the cubic form that doesn't favour rare pairs (Daille, 1994):
   log2 of c(ab)^3 / (c(a) c(b)); its improbability is a threshold minus that. The threshold is calibrated on all pairs with a
   character outside ASCII: the share ``ordinary`` of their occurrences scores negative. A pair that occurs in few sources
   only counts less. ASCII pairs cost a fixed amount. Maximum scoring segments of these scores are the improbable runs of a text.
3. Inverse mappings (encode with the wrong encoding, decode with the right one, as often as that works) are tested only on
   these segments, widened to whole runs outside ASCII and those next to them. One is accepted if it makes the place likelier
   under the corpus pairs; a swap of single-byte encodings must gain much, and its result must be probable by step 2.

A replacement character or a control character of the C1 range in a segment marks a place that can't be restored as it stands.
Null, empty, blank and ASCII texts are never garbled; each row is judged for itself, so repeated rows all come out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.arrays import U64, code_points, mix, slices

#: Buckets of sources.
SOURCES = 16
PAIR_BUCKETS = 1 << 20
CHAR_BUCKETS = 1 << 16
#: Encodings in which UTF-8 bytes are wrongly read, in the order in which they are tried.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "iso8859_15", "iso8859_2", "cp1257", "cp1253", "koi8_r")
#: (right, wrong) single-byte encodings that are mistaken for each other.
SWAPPED = (
    ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859_7"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "koi8_r"), ("cp1252", "cp1253"), ("cp1252", "iso8859_5"),
)
NO_BREAK = "\u00a0"
OUTSIDE = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")  # U+0085 is a line end


def pair_buckets_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bucket of each pair of characters."""
    return (mix((first.astype(U64) << U64(21)) | second.astype(U64), 5) >> U64(44)).astype(np.int64)


def pair_buckets(points: np.ndarray) -> np.ndarray:
    """The bucket of each pair of neighbours."""
    return pair_buckets_of(points[:-1], points[1:])


def char_buckets(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x8000, points, 0x8000 + (mix(points.astype(U64), 6) >> U64(49)).astype(np.int64)).astype(np.int64)


class Model:
    """Counts of characters and pairs, and what follows from them."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, spread: np.ndarray | None = None, shift: float = 0.0):
        """spread: by how much the count of each pair is discounted (1 for none); shift: the threshold of improbability."""
        self.pairs = pairs.astype(np.float32) if spread is None else (pairs * spread).astype(np.float32)
        self.chars, self.shift = chars, shift
        self.known: dict[str, tuple[float, float]] = {}
        self.total = max(1, int(chars.sum()))

    def pair_information(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The cubic mutual information of each pair of characters, in bits."""
        c = [np.log2(self.chars[char_buckets(x)] + 1.0) for x in (first, second)]
        return 3 * np.log2(self.pairs[pair_buckets_of(first, second)] + 0.5) - c[0] - c[1]

    def rarity(self, text: str) -> float:
        """The mean cost of the characters outside ASCII by themselves, in bits."""
        points = code_points(text)
        points = points[points > 127] if (points > 127).any() else points
        return float(-np.log2((self.chars[char_buckets(points)] + 0.1) / self.total).mean())

    def pair(self, pair: str) -> tuple[float, float]:
        """(cost of the second character given the first, in bits; improbability of the pair, 0 inside ASCII); remembered."""
        if pair not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            points = code_points(pair)
            before, after = (float(x) for x in self.chars[char_buckets(points)])
            ab = min(float(self.pairs[pair_buckets(points)][0]), before, after)  # no more than either character, whatever shares the bucket
            # absolute discounting towards the frequency of the single character
            p = max(ab - 0.5, 0) / max(before, 1) + (0.5 + 1e-3 * before) / (before + 1) * (after + 0.1) / (self.total + 1e5)
            improbable = 0.0 if pair.isascii() else self.shift - float(self.pair_information(points[:1], points[1:])[0])
            self.known[pair] = -math.log2(min(p, 1)), improbable
        return self.known[pair]

    def bits(self, text: str) -> float:
        """The cost of a text after its first character, in bits, with each character given the one before."""
        return sum(self.pair(text[i : i + 2])[0] for i in range(len(text) - 1))

    def probable(self, text: str) -> bool:
        """Whether the pairs of a text with a character outside ASCII are ordinary, taken together."""
        return text.isascii() or sum(self.pair(text[i : i + 2])[1] for i in range(len(text) - 1)) < 0


def segments(at: np.ndarray, score: np.ndarray, calm: float) -> list[tuple[int, int]]:
    """Maximum scoring segments of pairs, from the places and scores of pairs outside ASCII; each pair between costs calm.

    A segment starts at a positive score and ends at the peak of its running sum before that falls to zero; the search goes on
    right behind the peak. Returns (first pair, last pair). Only places with a positive score are visited one by one.
    """
    out, done, n = [], 0, len(at)
    for i in np.flatnonzero(score > 0).tolist():
        if i < done:
            continue
        peak = i
        running = best = float(score[i])
        for j in range(i + 1, n):
            running -= calm * int(at[j] - at[j - 1] - 1)
            if running <= 0:
                break
            running += float(score[j])
            if running > best:
                best, peak = running, j
            elif running <= 0:
                break
        out.append((int(at[i]), int(at[peak])))
        done = peak + 1
    return out


def _encode(text: str, wrong: str) -> bytes | None:
    """The bytes of a text in an encoding; undefined bytes, which lenient decoders pass through as C1 controls, come back too."""
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(wrong)
            except UnicodeEncodeError:
                if not 0x80 <= ord(ch) <= 0x9F:
                    return None
                out.append(ord(ch))
        return bytes(out)


def utf8_readings(run: str) -> Iterator[str]:
    """The run encoded with a wrong encoding and decoded as UTF-8, for each that allows it."""
    for wrong in UTF8_READ_AS:
        raw = _encode(run, wrong)
        if raw is not None:
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError:
                continue


def swapped_readings(run: str) -> Iterator[str]:
    """The run encoded with one single-byte encoding and decoded with another."""
    for right, wrong in SWAPPED:
        raw = _encode(run, wrong)
        if raw is None:
            continue
        try:
            text = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if not any(0x80 <= ord(ch) <= 0x9F for ch in text):
            yield text


def suspect(run: str) -> bool:
    """Whether a run of characters outside ASCII can't vouch for itself."""
    return LOST.search(run) is not None or any(text != run for text in utf8_readings(run))


class Restorer:
    """Judges places of a text in their surroundings; remembers what it has judged."""

    def __init__(self, model: Model, swap_gain: float):
        self.model, self.swap_gain = model, swap_gain
        self.known: dict[tuple, str] = {}
        self.read: dict[str, list] = {}

    def restore(self, before: str, place: str, after: str, swaps: bool = True) -> str:
        """The restored place, or the place itself where no inverse mapping is accepted."""
        key = (before, place, after, swaps)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._best(before, place, after, swaps)
        return self.known[key]

    def better(self, before: str, place: str, restored: str, after: str) -> bool:
        """Whether a restored place is probable, and gains as much as a swap must."""
        gain = self.model.bits(before + place + after) - self.model.bits(before + restored + after)
        return gain > self.swap_gain and self.model.probable(before + restored + after)

    def _best(self, before: str, place: str, after: str, swaps: bool) -> str:
        """The likeliest text that inverse mappings in a row lead to."""
        cost = self.model.bits(before + place + after)
        best, most = place, 0.0
        for better, utf8 in self.readings(place):
            if not utf8 and not (swaps and self.model.probable(before + better + after)):
                continue
            won = cost - self.model.bits(before + better + after) - (0.0 if utf8 else self.swap_gain)
            if won > most:
                best, most = better, won
        return best

    def readings(self, place: str) -> list[tuple[str, bool]]:
        """(reading, whether by UTF-8) of a place; only UTF-8 readings, each of them shorter, are undone further."""
        if place not in self.read:
            if len(self.read) > 50_000:
                self.read.clear()
            out, seen, now = [], {place}, [place]
            rare = self.model.rarity(place)
            while now:
                shorter = []
                for text in now:
                    for utf8, readings in ((True, utf8_readings(text)), (False, swapped_readings(text))):
                        for better in readings:
                            if better in seen or better.lower() == place.lower():  # no wrong decoding changes only the case
                                continue
                            seen.add(better)
                            if utf8:
                                shorter.append(better)
                            if utf8 or self.model.rarity(better) <= rare + 3:  # frequent letters aren't what a rare one was misread as
                                out.append((better, utf8))
                now = shorter
            self.read[place] = out
        return self.read[place]


def _places(text: str, found: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, runs in segments): segments widened to whole runs outside ASCII, and to those at most reach characters away."""
    runs = [m.span() for m in OUTSIDE.finditer(text, max(0, found[0][0] - 200))] if found else []
    begins = [a for a, _ in runs]
    done = 0
    for first, last in found:
        i = bisect_left(begins, first)
        if i and runs[i - 1][1] > first:
            i -= 1
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] <= last + 1:
            j += 1
        if i >= len(runs) or runs[i][0] > last + 1 or i < done:
            continue
        inside = runs[i : j + 1]
        while i > done and runs[i][0] - runs[i - 1][1] <= reach:
            i -= 1
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= reach:
            j += 1
        done = j + 1
        inside += [r for r in runs[i : j + 1] if r not in inside and any(a <= r[1] - 1 and r[0] <= b + 1 for a, b in found)]
        yield runs[i][0], runs[j][1], sorted(inside)


def judge(text: str, found: list[tuple[int, int]], restorer: Restorer, reach: int = 2) -> tuple[list[tuple[int, str, str]], str]:
    """(places, restored text): each place is (offset, garbled, restored), with an empty restored where it is lost.

    found: the improbable segments of the text, as (first pair, last pair).
    """
    places, out, last = [], [], 0
    for begin, end, runs in _places(text, found, reach):
        whole = text[begin:end]
        better = restorer.restore(text[max(0, begin - 2) : begin], whole, text[end : end + 2])
        tried = [(begin, end, better)]
        if better == whole:
            # Not as a whole: the runs in segments by themselves, if they are valid UTF-8, also with a blank that was a no-break space.
            tried = []
            for a, b in runs:
                alone = text[a:b]
                better = restorer.restore(text[max(0, a - 2) : a], alone, text[b : b + 2], swaps=len(runs) == 1 and (a, b) == (begin, end))
                if better == alone and text[b : b + 1] == " ":
                    blank = "" if text[b + 1 : b + 2] == " " else " "  # a blank that belongs between the words
                    around = text[max(0, a - 2) : a], blank + text[b + 1 : b + 3]
                    spaced = restorer.restore(around[0], alone + NO_BREAK, around[1], swaps=False)
                    if spaced != alone + NO_BREAK and restorer.better(around[0], alone, spaced, around[1]):
                        better, b = spaced + blank, b + 1
                tried.append((a, b, better))
        for a, b, better in tried:
            run = text[a:b]
            if better != run or LOST.search(run):
                places.append((a, run, "" if LOST.search(better) else better))
                out += [text[last:a], better]
                last = b
    return places, "".join([*out, text[last:]])


def judge_all(texts: list[str], restorer: Restorer, calm: float) -> Iterator[tuple[int, list, str]]:
    """(index, places, restored) of each garbled text; the scores of all texts are computed together."""
    model = restorer.model
    points = code_points("\n".join(texts) + "\n")
    outside = points > 127
    at = np.flatnonzero(outside[:-1] | outside[1:])
    if not len(at):
        return
    score = model.shift - model.pair_information(points[at], points[at + 1])
    begin = 0
    for k, text in enumerate(texts):
        a, b = np.searchsorted(at, [begin, begin + len(text) - 1])
        own = score[a:b]
        if (own > 0).any():
            places, restored = judge(text, segments(at[a:b] - begin, own, calm), restorer)
            if places:
                yield k, places, restored
        begin += len(text) + 1


def corpus_counts(df: DataFrame, text_col: str, source_col: str | None, ordinary: float) -> Model:
    """Counts of characters and adjacent pairs over all texts; at most 2^20 + 2^16 rows come to the driver at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(PAIR_BUCKETS, dtype=np.int64), np.zeros(CHAR_BUCKETS, dtype=np.int64)
        one = np.zeros(PAIR_BUCKETS, dtype=np.int64)  # a pair of the bucket
        where = np.zeros((PAIR_BUCKETS, SOURCES), dtype=bool)
        known: dict[str, bool] = {}
        for batch in batches:
            values, sources = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(values):
                text = "\n".join(t or "" for t in values[a:b]) + "\n"
                points = code_points(text)
                right = np.ones(len(points), dtype=bool)
                for m in OUTSIDE.finditer(text):
                    run = m.group()
                    if run not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[run] = suspect(run)
                    if known[run]:
                        right[m.start() : m.end()] = False
                chars += np.bincount(char_buckets(points[right]), minlength=CHAR_BUCKETS)
                if len(points) < 2:
                    continue
                both = np.flatnonzero(right[:-1] & right[1:])
                bucket = pair_buckets_of(points[both], points[both + 1])
                pairs += np.bincount(bucket, minlength=PAIR_BUCKETS)
                wide = np.flatnonzero((points[both] > 127) | (points[both + 1] > 127))
                at, bucket = both[wide], bucket[wide]
                one[bucket] = (points[at].astype(np.int64) << 21) | points[at + 1]
                row = np.searchsorted(np.cumsum([len(t or "") + 1 for t in values[a:b]]), at, side="right")
                where[bucket, sources[a:b][row]] = True
        at, of = np.flatnonzero(pairs), np.flatnonzero(chars)
        mask = where[at] @ (1 << np.arange(SOURCES))
        none = np.zeros(len(of), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((at, -1 - of), (pairs[at], chars[of]), (one[at], none), (mask, none))], ["bucket", "n", "pair", "mask"]
        )

    source = F.lit(0) if source_col is None else F.pmod(F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))), F.lit(SOURCES)).cast("int")
    counted = df.select(F.col(text_col), source).mapInArrow(count, "bucket long, n long, pair long, mask long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("pair").alias("pair"), F.bit_or("mask").alias("mask")).toPandas()
    bucket, n = rows.bucket.to_numpy(np.int64), rows.n.to_numpy(np.int64)
    pairs, chars = np.zeros(PAIR_BUCKETS, dtype=np.int64), np.zeros(CHAR_BUCKETS, dtype=np.int64)
    of_pair = bucket >= 0
    pairs[bucket[of_pair]] = n[of_pair]
    chars[-1 - bucket[~of_pair]] = n[~of_pair]
    wide = of_pair & (rows.pair.to_numpy(np.int64) > 0)
    mask = rows["mask"].to_numpy(np.int64)
    spread = np.ones(PAIR_BUCKETS)
    sources = int(np.bitwise_or.reduce(mask[wide])).bit_count() if wide.any() else 0
    if sources >= 4:  # among fewer, where a pair occurs says nothing
        spread[bucket[wide]] = (np.bitwise_count(mask[wide].astype(np.uint64)) / sources) ** 2
    model = Model(pairs, chars, spread)
    if wide.any():
        pair = rows.pair.to_numpy(np.int64)[wide]
        information = model.pair_information((pair >> 21).astype(np.uint32), (pair & 0x1FFFFF).astype(np.uint32))
        order = np.argsort(-information)
        share = np.cumsum(n[wide][order]) / n[wide].sum()
        model.shift = float(information[order][min(int(np.searchsorted(share, ordinary)), len(order) - 1)])
    return model


def restored_texts(df: DataFrame, id_col: str, text_col: str, source_col: str | None = None, ordinary: float = 0.98, calm: float = 4.0, swap_gain: float = 4.5) -> DataFrame:
    """id, places (offset, garbled, restored), restored (the whole text), complete: one row for each garbled text.

    complete is false where a place is lost; restored then keeps that place as it is. source_col, if given, tells in how many
    sources a pair of characters occurs.
    """
    model = df.sparkSession.sparkContext.broadcast(corpus_counts(df, text_col, source_col, ordinary))
    kind = df.schema[id_col].dataType.simpleString()
    place = pa.struct([("offset", pa.int32()), ("garbled", pa.string()), ("restored", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value, swap_gain)
        for batch in batches:
            values = batch.column(1).to_pylist()
            wide = [k for k, t in enumerate(values) if t and not t.isascii()]
            at, places, texts, complete = [], [], [], []
            for a, b in slices([values[k] for k in wide]):
                for k, found, restored in judge_all([values[k] for k in wide[a:b]], restorer, calm):
                    at.append(wide[a + k])
                    places.append([{"offset": o, "garbled": g, "restored": r} for o, g, r in found])
                    texts.append(restored)
                    complete.append(all(r for _, _, r in found))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(places, pa.list_(place)), pa.array(texts, pa.string()), pa.array(complete)], ["id", "places", "restored", "complete"])

    return df.select(id_col, text_col).mapInArrow(scan, f"id {kind}, places array<struct<offset:int,garbled:string,restored:string>>, restored string, complete boolean")
