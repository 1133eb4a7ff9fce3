"""Text expressions: words, terms, n-grams, overlaps, cleaning. All are columns; nothing here runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits, marks and underscores of any script, spelt so that every engine reads it the same way.
WORD = r"[\p{L}\p{N}\p{M}_]+"
IDENTIFIER = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"
OVERVIEW_WORDS = ("overview", "introduction", "purpose")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case words in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def terms(text: Column | str, longer_than: int = 0) -> Column:
    """Distinct lower-case words."""
    w = F.array_distinct(words(text))
    return F.filter(w, lambda x: F.length(x) > longer_than) if longer_than else w


def identifiers(text: Column | str) -> Column:
    """Distinct upper-case names with underscores."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(f"({IDENTIFIER})"), F.lit(1))), F.array().cast("array<string>"))


def blank(text: Column | str) -> Column:
    """Whether a text is null or nothing but white space."""
    return F.coalesce(F.regexp_replace(_col(text), r"\s+", ""), F.lit("")) == ""


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, each joined by one blank. tokens should be a column of its own: it is read n times."""
    out = tokens
    for i in range(1, n):
        rest = F.greatest(F.size(tokens) - i, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), rest), F.slice(tokens, F.lit(i + 1), rest), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def contains_any(text: Column, needles) -> Column:
    """Whether a text holds one of the needles as a substring; false for null."""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return F.coalesce(found, F.lit(False))


def count_contained(text: Column, needles: Column) -> Column:
    """How many elements of an array occur in a text as substrings."""
    return F.size(F.filter(needles, lambda x: F.contains(text, x)))


def ratio(a: Column, b: Column, empty: Column | float = 0.0) -> Column:
    """a / b as a double, and empty where b is zero."""
    return F.when(b == 0, empty if isinstance(empty, Column) else F.lit(empty)).otherwise(a.cast("double") / b)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def set_overlap(reference: Column, candidate: Column) -> Column:
    """struct(coverage, precision, f1) of two arrays as sets: all 1 if both are empty, all 0 if one is."""
    both = F.size(F.array_intersect(reference, candidate))
    r, c = F.size(F.array_distinct(reference)), F.size(F.array_distinct(candidate))
    both_empty = (r == 0) & (c == 0)
    coverage = F.when(both_empty, 1.0).otherwise(ratio(both, r))
    precision = F.when(both_empty, 1.0).otherwise(ratio(both, c))
    return F.struct(coverage.alias("coverage"), precision.alias("precision"), f1(precision, coverage).alias("f1"))


def truncation(text: Column | str, max_tokens: int) -> Column:
    """struct(text, original_tokens, truncated_tokens, was_truncated): four characters count as a token; a cut goes back to the
    last line break if that lies in the last fifth."""
    t = F.coalesce(_col(text), F.lit(""))
    tokens = F.floor(F.length(t) / 4).cast("int")
    cut = F.substring(t, 1, max_tokens * 4)
    last = F.length(cut) - F.instr(F.reverse(cut), "\n")
    snapped = F.when((F.instr(cut, "\n") > 0) & (last > 0.8 * max_tokens * 4), F.substring(cut, F.lit(1), last)).otherwise(cut)
    out = F.when(tokens > max_tokens, snapped).otherwise(t)
    return F.struct(out.alias("text"), tokens.alias("original_tokens"), F.floor(F.length(out) / 4).cast("int").alias("truncated_tokens"), (tokens > max_tokens).alias("was_truncated"))


def clean_context(text: Column | str) -> Column:
    """Escapes undone, double underscores made single, blanks collapsed in lines, at most one empty line in a row, trimmed."""
    t = F.coalesce(_col(text), F.lit(""))
    t = F.regexp_replace(t, r"\\_", "_")
    t = F.regexp_replace(t, "__+", "_")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n\s*\n+", "\n\n")
    return F.trim(t)


def clean_code(code: Column | str, lines: int = 35) -> Column:
    """Fences, blank lines and comment lines dropped; the first lines kept, as a listing shows them."""
    all_lines = F.split(F.regexp_replace(F.coalesce(_col(code), F.lit("")), r"```[a-z]*", ""), "\n")
    kept = F.filter(all_lines, lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("*")))
    return F.array_join(F.slice(kept, 1, lines), "\n")


def relevance(query: Column | str, text: Column | str) -> Column:
    """Share of distinct query words that a text contains as substrings, kept within 0.4 and 0.95; 0.5 without words."""
    q = terms(query)
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    share = count_contained(t, q).cast("double") / F.size(q)
    return F.when(F.size(q) == 0, 0.5).otherwise(F.least(F.greatest(share, F.lit(0.4)), F.lit(0.95)))


def bleu_overlap(reference: Column, candidate: Column, n: int) -> Column:
    """Precision of the candidate's distinct n-grams in the reference's, times the ratio of lengths (at most 1); 0 if one is empty. Of word arrays."""
    rn, cn = F.array_distinct(ngrams(reference, n)), F.array_distinct(ngrams(candidate, n))
    share = ratio(F.size(F.array_intersect(rn, cn)), F.size(cn))
    return share * F.least(F.lit(1.0), ratio(F.size(candidate), F.size(reference)))


def rouge_sets(reference: Column, candidate: Column, n: int) -> Column:
    """F measure over distinct n-grams of word arrays."""
    r, c = F.array_distinct(ngrams(reference, n)), F.array_distinct(ngrams(candidate, n))
    both = F.size(F.array_intersect(r, c))
    return f1(ratio(both, F.size(c)), ratio(both, F.size(r)))


def trigram_ratio(a: Column, b: Column) -> Column:
    """Twice the shared distinct character trigrams over those of both texts, in lower case; 1 if both have none, else 0 if one has."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    x, y = (grams(F.lower(F.coalesce(c, F.lit("")))) for c in (a, b))
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def coverage_only(reference: Column, candidate: Column, most: int = 12) -> Column:
    """struct(coverage, precision) of the first keywords of two arrays: coverage 1 for an empty reference, precision 0 for an empty candidate."""
    r, c = F.slice(F.array_sort(F.array_distinct(reference)), 1, most), F.array_distinct(candidate)
    both = F.size(F.array_intersect(r, c))
    return F.struct(ratio(both, F.size(r), 1.0).alias("coverage"), ratio(both, F.size(c)).alias("precision"))
