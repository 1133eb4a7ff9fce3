"""Cleaning, extraction and parsing of answers, questions and contexts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docskein.functions import text as tx

#: Fixed markers and prefixes of answers and questions.
MARKERS = r"</?s>|\[/?INST\]|<\|[a-z_]+\|>"
QUESTION_PREFIXES = r"^(?:(?:Simple|Complex|Situational|Double|Distracting|Conversational) )?Question:\s*|^Q:\s*|^\d+\.\s+"


def _t(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def question(text: Column | str) -> Column:
    """A question without prefixes and parentheses, up to its first question mark, with single blanks."""
    t = F.regexp_replace(F.trim(_t(text)), QUESTION_PREFIXES, "")
    t = F.regexp_replace(t, r"\s*\([^)]*\)", "")
    end = F.instr(t, "?")
    return F.trim(F.regexp_replace(F.when(end > 0, F.substring(t, F.lit(1), end)).otherwise(t), r"\s+", " "))


def response(text: Column | str, mode: str = "basic") -> Column:
    """minimal: markers removed and trimmed; basic: blank runs squeezed too; enhanced: also leading answer labels and trailing spaces of lines."""
    t = F.regexp_replace(_t(text), MARKERS, "")
    if mode != "minimal":
        t = F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
        t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    if mode == "enhanced":
        t = F.regexp_replace(t, r"^\s*(?:Answer|Response):\s*", "")
        t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return F.trim(t)


def confidence(text: Column | str) -> Column:
    """The level that a text states in a line "Confidence: ...", in upper case; null without one."""
    return F.nullif(F.upper(F.regexp_extract(_t(text), r"(?im)^Confidence:\s*(HIGH|MEDIUM|LOW)", 1)), F.lit(""))


def json_block(text: Column | str) -> Column:
    """The fenced JSON block of a text, else all from its first to its last brace; null without braces."""
    t = _t(text)
    fenced = F.nullif(F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.trim(F.regexp_extract(t, r"(?s)(\{.*\})", 1)), F.lit("")))


def rubric_score(text: Column | str, name: str, default: int = 3) -> Column:
    """A score from 1 to 5 of a JSON block; default where it is missing, no number or out of range."""
    v = F.get_json_object(json_block(text), f"$.{name}").try_cast("int")
    return F.when(v.between(1, 5), v).otherwise(default)


def first_score(text: Column | str) -> Column:
    """The first decimal of a text, else its first whole number (tenths from 1 to 10 on), else 0.5; never more than 1."""
    t = _t(text)
    decimal = F.nullif(F.regexp_extract(t, r"(\d+\.\d+)", 1), F.lit("")).cast("double")
    whole = F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).cast("double")
    return F.least(F.lit(1.0), F.coalesce(decimal, F.when(whole <= 10, whole / 10).otherwise(F.when(whole.isNotNull(), 1.0)), F.lit(0.5)))


def tables(text: Column | str) -> Column:
    """Markdown tables with a separator line, and runs of two bullets or more; an array of their texts."""
    t = _t(text)
    md = F.regexp_extract_all(t, F.lit(r"(?m)((?:^[ \t]*\|.*\|[ \t]*\n)+(?:^[ \t]*\|[ \t:|-]+\|[ \t]*\n)(?:^[ \t]*\|.*\|[ \t]*\n?)*)"), F.lit(1))
    bullets = F.regexp_extract_all(t, F.lit(r"(?m)((?:^[ \t]*[-*] .*(?:\n|\z)){2,})"), F.lit(1))
    return F.concat(md, bullets)


def display_text(text: Column | str) -> Column:
    """Markers and header signs removed, fragments of five characters or fewer dropped, sentences capitalised and joined again."""
    t = F.regexp_replace(F.regexp_replace(_t(text), MARKERS, ""), "#+", "")
    parts = F.filter(F.transform(F.split(t, r"\."), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) > 5)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), ". ")


def display_code(code: Column | str) -> Column:
    """Code without fences, trailing blanks and runs of empty lines; null if under ten characters or a word for none."""
    t = F.regexp_replace(_t(code), r"```[a-z]*", "")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when((F.length(t) >= 10) & ~F.lower(F.trim(t)).isin("none", "n/a"), t)


def token_estimate(text: Column | str, least: int = 0) -> Column:
    """A quarter of the characters, at least least."""
    return F.greatest(F.floor(F.length(_t(text)) / 4).cast("int"), F.lit(least))


def metric_text(text: Column | str) -> Column:
    """struct(name, value, level) of texts such as "Clarity: 90% (Good)"."""
    t = _t(text)
    pattern = r"^\s*([^:]+):\s*([\d.]+)%?\s*(?:\(([^)]*)\))?"
    return F.struct(F.trim(F.regexp_extract(t, pattern, 1)).alias("name"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).cast("double").alias("value"), F.regexp_extract(t, pattern, 3).alias("level"))


def tier(question_: Column, context: Column) -> Column:
    """How well a context serves a simple question: 0.95 overview, 0.9 the same identifier, 0.7 and 0.05 for each shared term, else 0."""
    low = F.lower(F.coalesce(context, F.lit("")))
    asked = F.filter(tx.terms(question_), lambda x: F.length(x) > 3)
    n = tx.count_contained(low, asked)
    same = F.size(F.array_intersect(tx.identifiers(question_), tx.identifiers(context))) > 0
    return F.when(tx.contains_any(F.substring(low, 1, 200), tx.OVERVIEW_WORDS), 0.95).when(same, 0.9).when(n >= 1, F.least(F.lit(0.9), 0.7 + 0.05 * n)).otherwise(0.0)


def relevant_lines(question_: Column, context: Column, k: int = 4) -> Column:
    """The lines of a context (over 15 characters) with most question terms, at most k, in their order; the first three if none has any."""
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), "\n|(?<=[.!?]) "), lambda x: F.length(F.trim(x)) > 15)
    asked = F.filter(tx.terms(question_), lambda x: F.length(x) > 3)
    scored = F.transform(lines, lambda x, i: F.struct((-tx.count_contained(F.lower(x), asked)).alias("n"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["n"] < 0)), 1, k)
    ordered = F.transform(F.array_sort(F.transform(best, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
    return F.when(F.size(ordered) > 0, ordered).otherwise(F.slice(lines, 1, 3))


def first_response(df, names: tuple[str, ...] = ("response", "answer", "generated_answer")) -> Column:
    """The first of the named columns that a table has and that isn't blank, else any string column with response in its name; null without one."""
    strings = [c for c, t in df.dtypes if t == "string"]
    chosen = [c for n in names for c in strings if c.lower() == n] or sorted(c for c in strings if "response" in c.lower())
    return F.coalesce(*[F.when(~tx.blank(c), F.col(c)) for c in chosen], F.lit(None).cast("string"))


def judge_verdict(answer: Column | str) -> Column:
    """struct(winner, confidence, parsed) of a judge's JSON answer, fenced or not; without one Tie and 0.5."""
    block = json_block(answer)
    winner = F.initcap(F.trim(F.get_json_object(block, "$.winner")))
    ok = F.coalesce(winner.isin("A", "B", "Tie"), F.lit(False))
    value = F.get_json_object(block, "$.confidence").try_cast("double")
    return F.struct(F.when(ok, winner).otherwise("Tie").alias("winner"), F.when(ok & value.between(0, 1), value).otherwise(0.5).alias("confidence"), ok.alias("parsed"))


def provider_text(answer: Column | str) -> Column:
    """The text of a model provider's JSON answer, in any of the shapes these have; the answer itself if it is no JSON."""
    t = _t(answer)
    shapes = ("$.choices[0].message.content", "$.choices[0].text", "$.content[0].text", "$.candidates[0].content.parts[0].text", "$.output_text", "$.response", "$.text", "$.content")
    return F.coalesce(*[F.get_json_object(t, s) for s in shapes], F.when(~F.rlike(t, F.lit(r"^\s*[{\[]")), t))


def filtered_contexts(contexts, verdicts: Column, simple: Column):
    """Contexts with the verdicts of a filtering model applied: qid, context_id, score, text, code, best first by place.

    contexts: qid, context_id, score, text, code, and verdicts, a JSON array of context_id, relevance (0 to 1), text and keep_code. A
    judged context's score is weighted by 0.2 + 0.8 * relevance; for simple questions it is then raised by a fifth, to 1 at most.
    A text in the verdict replaces that of the context; contexts that aren't judged stay as they are.
    """
    from pyspark.sql import Window

    kind = "array<struct<context_id:string,relevance:double,text:string,keep_code:boolean>>"
    said = contexts.withColumn("said", F.filter(F.coalesce(F.from_json(verdicts, kind), F.array().cast(kind)), lambda v: v["context_id"] == F.col("context_id").cast("string"))).withColumn("v", F.try_element_at("said", F.lit(1)))
    weighted = F.when(F.col("v").isNull(), F.col("score")).otherwise(F.col("score") * (0.2 + 0.8 * F.coalesce("v.relevance", F.lit(0.0))))
    score = F.round(F.when(simple, F.least(F.lit(1.0), weighted * 1.2)).otherwise(weighted), 6)
    out = said.select("qid", "context_id", score.alias("score"), F.coalesce(F.nullif(F.trim("v.text"), F.lit("")), F.col("text")).alias("text"), F.when(F.coalesce("v.keep_code", F.lit(True)), F.col("code")).alias("code"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "context_id")))


def bounded_contexts(text: Column, code: Column, title: Column) -> Column:
    """One context of an answer's prompt, with its text and code cleaned, between lines of signs."""
    return F.concat(F.lit("=" * 50 + "\n"), F.coalesce(title, F.lit("")), F.lit("\n"), tx.clean_context(text), F.lit("\n"), tx.clean_code(code))


def without_repeats(text: Column | str, title: Column | str) -> Column:
    """A document without a first line that repeats itself or its title, and without more than one empty line in a row."""
    t = F.trim(_t(text))
    lines = F.split(t, "\n")
    first = F.trim(F.get(lines, F.lit(0)))
    again = (F.size(lines) > 1) & (first == F.trim(F.get(lines, F.lit(1))))
    same = F.lower(F.regexp_replace(first, r"^#+\s*", "")) == F.lower(F.trim(_t(title)))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.trim(F.regexp_replace(F.when(again | (same & (F.size(lines) > 1)), rest).otherwise(t), r"\n\s*\n\s*\n+", "\n\n"))


def method_sections(text: Column | str) -> Column:
    """Sections of a text about methods of interfaces: from a header line with a ~ in it to the next header, in order."""
    return F.transform(F.regexp_extract_all(_t(text), F.lit(r"(?ms)(^#{2,6}[ \t][^\n]*~[^\n]*(?:\n(?!#{1,6}[ \t])[^\n]*)*)"), F.lit(1)), lambda x: F.trim(x))
