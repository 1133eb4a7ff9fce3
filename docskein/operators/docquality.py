"""How good documentation is, measured against its code and by its form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import text as tx


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def code_facts(code: Column | str) -> Column:
    """struct(methods, tables, classes): distinct names in upper-cased code."""
    c = F.upper(_text(code))
    return F.struct(
        _all(c, r"\bMETHOD\s+([A-Z0-9_~]+)").alias("methods"), _all(c, r"\b(Z[TX]_[A-Z0-9_]+)").alias("tables"), _all(c, r"\b(Z(?:CL|IF|CX)_[A-Z0-9_]+)").alias("classes")
    )


def doc_claims(doc: Column | str) -> Column:
    """struct(methods, tables, classes): names that documentation mentions; level 4 headers and two-part names count as methods."""
    d = F.upper(_text(doc))
    return F.struct(
        F.array_distinct(F.concat(_all(d, r"(?m)^####\s+([A-Z0-9_~]+)"), _all(d, r"\b((?:READ|GET|SET|CHECK|BUILD|SAVE|LOAD|POST|SEND|INIT|FILL|MAP|MERGE|SORT|SPLIT|PARSE|LOCK|COUNT)_[A-Z0-9_]+)"))).alias("methods"),
        _all(d, r"\b(Z[TX]_[A-Z0-9_]+)").alias("tables"),
        _all(d, r"\b(Z(?:CL|IF|CX)_[A-Z0-9_]+)").alias("classes"),
    )


def factual_accuracy(f: Column, c: Column) -> Column:
    """struct(method_recall, hallucination_rate, construct_recall, accuracy) of the columns code_facts and doc_claims make."""
    n = F.size(f["methods"])
    recall = F.when(n == 0, 1.0).otherwise(tx.ratio(F.size(F.array_intersect(f["methods"], c["methods"])), n))
    claimed = F.size(c["methods"])
    invented = F.when(claimed == 0, 0.0).otherwise(tx.ratio(F.size(F.array_except(c["methods"], f["methods"])), claimed))
    things, named = F.array_union(f["tables"], f["classes"]), F.array_union(c["tables"], c["classes"])
    constructs = F.when(F.size(things) == 0, 1.0).otherwise(tx.ratio(F.size(F.array_intersect(things, named)), F.size(things)))
    return F.struct(F.round(recall, 4).alias("method_recall"), F.round(invented, 4).alias("hallucination_rate"), F.round(constructs, 4).alias("construct_recall"), F.round((recall + constructs) / 2, 4).alias("accuracy"))


def construct_validity(doc: Column | str, keywords: Column) -> Column:
    """Share of the words of documentation (two plain letters or more, in any case) that are keywords, in upper case; 0 without such words."""
    words = F.filter(tx.words(doc), lambda w: F.rlike(w, F.lit("^[a-z_]{2,}$")))
    return F.round(tx.ratio(F.size(F.filter(words, lambda w: F.array_contains(keywords, F.upper(w)))), F.size(words)), 4)


def section_map(df: DataFrame, key: str, doc: str) -> DataFrame:
    """key, section, body: the sections of documentation by their lower-case header; of equal headers the last one counts. Empty bodies stay."""
    cut = F.filter(F.split(_text(doc), r"(?m)(?=^#{1,6}[ \t])"), lambda x: F.rlike(x, F.lit(r"^#{1,6}[ \t]")))
    parts = df.select(key, F.posexplode(cut).alias("pos", "part"))
    header = F.lower(F.trim(F.regexp_extract("part", r"^#{1,6}[ \t]+([^\n]*)", 1)))
    body = F.trim(F.regexp_replace("part", r"^#{1,6}[^\n]*\n?", ""))
    return parts.groupBy(key, header.alias("section")).agg(F.max_by(body, "pos").alias("body"))


def sample_metrics(df: DataFrame, key: str, metrics: dict[str, Column], enhanced: list[str]) -> DataFrame:
    """key, metric, value: the metrics of each sample in long form, those in enhanced also under the name enhanced_..."""
    named = {**metrics, **{f"enhanced_{m}": metrics[m] for m in enhanced}}
    return df.select(key, *[c.cast("double").alias(n) for n, c in named.items()]).unpivot([key], list(named), "metric", "value")


def header_levels(doc: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_text(doc), F.lit(r"(?m)^(#{1,6})[ \t]"), F.lit(1)), F.length)


def header_jumps(doc: Column | str, levels: Column | None = None) -> Column:
    """How often a header is more than one level below the one before."""
    levels = header_levels(doc) if levels is None else levels
    pairs = F.zip_with(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b - a)
    return F.when(F.size(levels) < 2, 0).otherwise(F.size(F.filter(pairs, lambda d: d > 1)))


def markdown_score(doc: Column | str) -> Column:
    """1 less a third for each fault: jumping headers, an odd number of fences, mixed bullets."""
    d = _text(doc)
    fences = F.regexp_count(d, F.lit("```")) % 2 != 0
    bullets = F.rlike(d, F.lit(r"(?m)^\s*-\s")).cast("int") + F.rlike(d, F.lit(r"(?m)^\s*\*\s")).cast("int") + F.rlike(d, F.lit(r"(?m)^\s*\+\s")).cast("int")
    return F.round(1 - ((header_jumps(doc) > 0).cast("int") + fences.cast("int") + (bullets > 1).cast("int")) / 3.0, 4)


def table_score(doc: Column | str) -> Column:
    """1 without pipe lines, else 1 if there is a separator line."""
    d = _text(doc)
    pipes, separators = F.regexp_count(d, F.lit(r"(?m)^.*\|.*$")), F.regexp_count(d, F.lit(r"(?m)^\s*\|?[\s:-]*---[\s|:-]*$"))
    return F.when(pipes == 0, 1.0).otherwise(F.least(F.lit(1.0), separators.cast("double")))


def sentence_list(doc: Column | str) -> Column:
    return F.filter(F.transform(F.split(_text(doc), r"[.!?]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def clarity(doc: Column | str, levels: Column | None = None, sentences: Column | None = None) -> Column:
    """Length of sentences (10 to 20 words is best) and number of headers, halved."""
    s, levels = sentence_list(doc) if sentences is None else sentences, header_levels(doc) if levels is None else levels
    mean = F.when(F.size(s) > 0, F.aggregate(s, F.lit(0), lambda a, x: a + _word_count(x)) / F.size(s))
    length = F.when(mean.isNull(), 0.7).when(mean.between(10, 20), 1.0).when(mean > 25, 0.6).otherwise(0.8)
    return F.round((length + F.when(F.size(levels) >= 3, 1.0).otherwise(0.6)) / 2, 4)


def conciseness(doc: Column | str, sentences: Column | None = None) -> Column:
    """Words in all (200 to 800 is best), less a tenth for each repeated sentence of more than three words, at least 0."""
    n = _word_count(_text(doc))
    base = F.when(n.between(200, 800), 1.0).when(n > 1200, 0.6).when(n < 100, 0.5).otherwise(0.8)
    long = F.filter(F.transform(sentence_list(doc) if sentences is None else sentences, F.lower), lambda x: _word_count(x) > 3)
    return F.round(F.greatest(F.lit(0.0), base - 0.1 * (F.size(long) - F.size(F.array_distinct(long)))), 4)


def organization(doc: Column | str, levels: Column | None = None) -> Column:
    d = F.lower(_text(doc))
    return F.round((F.when(header_jumps(doc, levels) > 0, 0.5).otherwise(1.0) + F.when(F.contains(F.substring(d, 1, 500), F.lit("overview")), 1.0).otherwise(0.5)) / 2, 4)


def usefulness(doc: Column | str) -> Column:
    n = tx.count_contained(F.lower(_text(doc)), F.array(*map(F.lit, ("example", "error", "depend", "parameter", "return", "note", "use", "when", "if "))))
    return F.when(n >= 6, 1.0).when(n >= 4, 0.8).when(n >= 2, 0.6).otherwise(0.4)


def omissions(f: Column, c: Column, code: Column | str, doc: Column | str) -> Column:
    """Share of the code's methods that are documented, halved if exceptions are raised but errors aren't mentioned."""
    n = F.size(f["methods"])
    base = F.when(n == 0, 1.0).otherwise(1 - tx.ratio(F.size(F.array_except(f["methods"], c["methods"])), n))
    raised = F.contains(F.upper(_text(code)), F.lit("RAISE EXCEPTION")) & ~F.rlike(F.lower(_text(doc)), F.lit("error|exception|raise"))
    return F.round(base * F.when(raised, 0.5).otherwise(1.0), 4)


def coherence(doc: Column | str, levels: Column | None = None) -> Column:
    d = F.lower(_text(doc))
    levels = header_levels(doc) if levels is None else levels
    linked = F.rlike(d, F.lit("see |refer|therefore|because|so |which"))
    return F.round((F.when(F.size(levels) >= 3, 1.0).otherwise(0.6) + F.when(linked, 1.0).otherwise(0.7)) / 2, 4)


#: Weights of the nine scores in the overall one.
WEIGHTS = {"accuracy": 1.5, "hallucination": 1.5, "completeness": 1.5, "clarity": 1.0, "organization": 1.0, "usefulness": 1.0, "omissions": 1.2, "coherence": 0.8, "conciseness": 0.8}


def nine_scores(df: DataFrame, key: str, code: str, doc: str) -> DataFrame:
    """key, the nine scores from 0 to 5 and their weighted mean. Facts, claims, header levels and sentences are columns first, each found once."""
    facts = df.select(key, code, doc, code_facts(code).alias("f_"), doc_claims(doc).alias("c_"), header_levels(doc).alias("l_"), sentence_list(doc).alias("s_"))
    f, c = F.col("f_"), F.col("c_")
    known = facts.select(key, factual_accuracy(f, c).alias("fact_"), omissions(f, c, code, doc).alias("omissions"), clarity(doc, F.col("l_"), F.col("s_")).alias("clarity"), conciseness(doc, F.col("s_")).alias("conciseness"),
                         organization(doc, F.col("l_")).alias("organization"), usefulness(doc).alias("usefulness"), coherence(doc, F.col("l_")).alias("coherence"))
    fact = F.col("fact_")
    part = {"accuracy": fact["accuracy"], "hallucination": 1 - fact["hallucination_rate"], "completeness": fact["method_recall"]} | {k: F.col(k) for k in list(WEIGHTS)[3:]}
    total = sum((part[k] * w for k, w in list(WEIGHTS.items())[1:]), part["accuracy"] * WEIGHTS["accuracy"])
    return known.select(key, *[F.round(v * 5, 4).alias(k) for k, v in part.items()], F.round(total * 5 / sum(WEIGHTS.values()), 4).alias("overall"))


def file_kind(code: Column | str) -> Column:
    """test_class, class, report, function or unknown by ordered patterns."""
    c = F.lower(_text(code))
    return (
        F.when(F.rlike(c, F.lit(r"for testing|ltcl_|risk level")), "test_class").when(F.rlike(c, F.lit(r"\bclass\s+\w+\s+definition|\bmethod\s+\w+")), "class")
        .when(F.rlike(c, F.lit(r"^\s*report\s|start-of-selection")), "report").when(F.rlike(c, F.lit(r"\bfunction\s+\w+")), "function").otherwise("unknown")
    )
