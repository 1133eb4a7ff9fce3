"""What a question asks for, and whether a response can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import text as tx

#: Fixed word lists of the question types and the scope check.
SIMPLE_WORDS = ("what", "when", "is", "does", "which")
NOT_SIMPLE = ("how", "why", "scenario", "implement", "handle")
COMPLEX_WORDS = ("explain", "relationship", "interact", "compare", "analyze", "why", "how")
SITUATIONAL_WORDS = ("as part of", "scenario", "situation", "suppose", "i was")
DISTRACTING_WORDS = ("but i need", "unrelated", "by the way")
DOMAIN_WORDS = ("abap", "class", "method", "interface", "table", "report", "function", "exception", "parameter", "field", "structure")
PERSONAL = r"\b(my (?:name|age|friend|family)|your (?:name|opinion)|weather|joke|recipe)\b"
UNSAFE = r"\b(?:drop\s+table|delete\s+from|rm\s+-rf|password|exploit)\b|<script|javascript:"
INJECTION = r"ignore (?:all |the )?previous instructions|system prompt|jailbreak|act as\b"


def question_type(question: Column | str) -> Column:
    """The kind of a question by ordered rules; words are looked up as substrings, as in "this" for "is"."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    n = F.size(F.filter(F.split(q, r"\s+"), lambda x: x != ""))
    return (
        F.when((n < 10) & tx.contains_any(q, SIMPLE_WORDS) & ~tx.contains_any(q, NOT_SIMPLE), "simple")
        .when(tx.contains_any(q, COMPLEX_WORDS) & ((n > 15) | F.contains(q, F.lit("in what way"))), "complex")
        .when(tx.contains_any(q, SITUATIONAL_WORDS), "situational")
        .when(tx.contains_any(q, DISTRACTING_WORDS), "distracting")
        .when(F.regexp_count(q, F.lit(r"\?")) > 1, "double")
        .otherwise("general")
    )


def flags(question: Column | str) -> Column:
    """struct of what a question is about."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    return F.struct(
        tx.contains_any(q, ("interface", "zif_", "if_")).alias("interface"),
        tx.contains_any(q, ("method", "function", "routine", "call")).alias("method"),
        tx.contains_any(q, ("table", "structure", "field", "column")).alias("structure"),
        tx.contains_any(q, ("exception", "error", "raise", "fail")).alias("exception"),
    )


def is_complex(question: Column | str) -> Column:
    """Several questions, more than 15 words, or a comma with "and"."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    n = F.size(F.filter(F.split(q, r"\s+"), lambda x: x != ""))
    return (F.contains(q, F.lit(",")) & F.contains(q, F.lit(" and "))) | (F.regexp_count(q, F.lit(r"\?")) > 1) | (n > 15)


def out_of_scope(question: Column | str) -> Column:
    """Personal, or without any word or identifier of the domain."""
    raw = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    q = F.lower(raw)
    return F.rlike(q, F.lit(PERSONAL)) | ~(tx.contains_any(q, DOMAIN_WORDS) | F.rlike(raw, F.lit(tx.IDENTIFIER)))


def safety(question: Column | str) -> Column:
    """struct(safe, risk): unsafe content is HIGH, an attempt to change instructions is at least MEDIUM but safe."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    unsafe, injected = F.rlike(q, F.lit(UNSAFE)), F.rlike(q, F.lit(INJECTION))
    return F.struct((~unsafe).alias("safe"), F.when(unsafe, "HIGH").when(injected, "MEDIUM").otherwise("LOW").alias("risk"))


def rewrite(question: Column | str, mode: str = "conservative") -> Column:
    """A question with its surroundings named: identifiers are spelt out by kind; disabled leaves it."""
    q = F.trim(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    if mode == "disabled":
        return q
    out = F.regexp_replace(q, r"\b(ZCL_[A-Z0-9_]+)", "class $1")
    out = F.regexp_replace(out, r"\b(ZIF_[A-Z0-9_]+)", "interface $1")
    if mode == "aggressive":
        out = F.regexp_replace(out, r"\b(Z[TX]_[A-Z0-9_]+)", "table $1")
        out = F.concat(out, F.lit(" Give parameters and exceptions."))
    return out


def sub_questions(question: Column | str) -> Column:
    """The parts of a question: between question marks, and the two sides of ", and "."""
    q = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(q, r"\?\s*", "?\u0001"), r", and (?=what|how|why|when|where|which|who)", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def numbered_list(text: Column | str) -> Column:
    """The items of a numbered list, else the lines that aren't blank."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    items = F.regexp_extract_all(t, F.lit(r"(?m)^\s*\d+\.\s*(.+)$"), F.lit(1))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(lines)


def unsupported(response: Column | str, context: Column | str) -> Column:
    """struct(named, unknown, risk): identifiers of a response that its context doesn't have; HIGH from five unknown on, MEDIUM from two."""
    named = tx.identifiers(response)
    unknown = F.array_except(named, tx.identifiers(context))
    n = F.size(unknown)
    return F.struct(F.size(named).alias("named"), n.alias("unknown"), F.when(n >= 5, "HIGH").when(n >= 2, "MEDIUM").otherwise("LOW").alias("risk"))


def downgraded(confidence: Column, risk: Column) -> Column:
    """A confidence level lowered by the risk of invention."""
    return F.when(risk == "HIGH", "LOW").when((risk == "MEDIUM") & (confidence == "HIGH"), "MEDIUM").otherwise(confidence)


def history(turns: Column) -> Column:
    """A conversation as lines of role and content; empty for null."""
    return F.coalesce(F.array_join(F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.coalesce(t["content"], F.lit("")))), "\n"), F.lit(""))


def type_report(df: DataFrame, question: str) -> DataFrame:
    return df.groupBy(question_type(question).alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(is_complex(question), 1)).alias("complex"), F.count(F.when(out_of_scope(question), 1)).alias("out_of_scope"))
