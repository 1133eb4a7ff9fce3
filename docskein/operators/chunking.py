"""Cutting documentation into linked, titled chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import text as tx


def sections(df: DataFrame, key: str, text: str, least_level: int = 4, greatest_level: int = 4) -> DataFrame:
    """key, seq, header, body: a section for each header line of the given levels; what comes before has the header "".

    A text without such a header is one section. Null and blank texts have none; the header line stays in the body, once.
    """
    marks = "#" * least_level if least_level == greatest_level else f"#{{{least_level},{greatest_level}}}"
    cut = F.split(F.col(text), rf"(?m)(?=^{marks}[ \t])")
    parts = df.where(~tx.blank(text)).select(key, F.posexplode(F.filter(cut, lambda x: F.trim(x) != "")).alias("seq", "body"))
    header = F.trim(F.regexp_extract("body", rf"^{marks}[ \t]+([^\n]*)", 1))
    return parts.select(key, "seq", header.alias("header"), F.trim("body").alias("body"))


def pack_paragraphs(text: Column | str, longest: int = 2000, overlap: int = 200) -> Column:
    """An array of chunks of whole paragraphs; each new chunk begins with the tail of the one before, from its last blank line on.

    A paragraph longer than a chunk stays whole. Null and blank texts give an empty array.
    """
    t = F.col(text) if isinstance(text, str) else text
    paragraphs = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(state, p):
        cur = state["cur"]
        full = (cur != "") & (F.length(cur) + F.length(p) > longest)
        tail = F.substring(cur, F.greatest(F.length(cur) - overlap + 1, F.lit(1)), F.lit(overlap))
        back = F.instr(F.reverse(tail), "\n\n")
        tail = F.when(back > 0, F.substring(tail, F.length(tail) - back + 2, F.lit(overlap))).otherwise(tail) if overlap else F.lit("")
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        begun = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        return F.struct(F.when(full, begun).otherwise(joined).alias("cur"), F.when(full, F.array_append(state["out"], cur)).otherwise(state["out"]).alias("out"))

    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def greedy_merge(pieces: Column, longest: int = 5000) -> Column:
    """Neighbouring pieces joined by a blank while they stay shorter than longest."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(state, p):
        cur = state["cur"]
        fits = (cur == "") | (F.length(cur) + F.length(p) + 1 < longest)
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit(" "), p))
        return F.struct(F.when(fits, joined).otherwise(p).alias("cur"), F.when(fits, state["out"]).otherwise(F.array_append(state["out"], cur)).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def split_at(text: Column, points: Column) -> Column:
    """The stripped pieces between split points (those inside the text, in order); an empty piece is dropped."""
    inside = F.array_sort(F.array_distinct(F.filter(points, lambda p: (p > 0) & (p < F.length(text)))))
    bounds = F.concat(F.array(F.lit(0)), inside, F.array(F.length(text)))
    pieces = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.trim(F.substring(text, a + 1, b - a)))
    return F.filter(pieces, lambda x: x != "")


def needs_splitter(text: Column | str) -> Column:
    """Whether a text is long or has many headers, so that a model should choose its split points."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.length(t) > 3000) | ((F.length(t) - F.length(F.replace(t, F.lit("##"), F.lit("")))) / 2 > 3) | F.contains(t, F.lit("Method Dependencies"))


def methods(df: DataFrame, key: str, code: str) -> DataFrame:
    """key, method, body: each METHOD block of a source; the last of equal names wins (the first ENDMETHOD closes)."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(r"(?is)(\bMETHOD\s+[\w~/]+.*?\bENDMETHOD\b)"), F.lit(1))
    found = df.select(key, F.posexplode(blocks).alias("pos", "body"))
    name = F.lower(F.regexp_extract("body", r"(?i)^METHOD\s+([\w~/]+)", 1))
    return found.groupBy(key, name.alias("method")).agg(F.max_by("body", "pos").alias("body"))


def match_methods(headers: DataFrame, code: DataFrame, key: str) -> DataFrame:
    """key, seq, header, method: the first rule that fits wins: same name, same without separators, ending, containment of 5 characters or more.

    headers: key, seq, header; code: key, method. Joined within the key only.
    """
    h = F.lower(F.trim("header"))
    bare = lambda c: F.regexp_replace(c, "[_~-]", "")
    m = F.col("method")
    rank = (
        F.when(h == m, 1)
        .when(bare(h) == bare(m), 2)
        .when(F.endswith(m, h), 3)
        .when((F.length(h) >= 5) & (F.length(m) >= 5) & (F.contains(m, h) | F.contains(h, m)), 4)
    )
    pairs = headers.where(~tx.blank("header")).join(code.select(key, "method"), key).withColumn("rule", rank).where("rule IS NOT NULL")
    best = Window.partitionBy(key, "seq").orderBy("rule", "method")
    return pairs.withColumn("place", F.row_number().over(best)).where("place = 1").select(key, "seq", "header", "method", "rule")


def title(text: Column | str) -> Column:
    """A chunk's title: its first header of level 4, 2 or 3 (without pipes, cut at " - "), else its first line cut to 30, else Unknown."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    header = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(t, rf"(?m)^#{{{n}}}[ \t]+([^\n|]+)", 1), " - .*$", "")), F.lit(""))
    first = F.nullif(F.trim(F.substring(F.regexp_extract(t, r"^\s*([^\n]+)", 1), 1, 30)), F.lit(""))
    return F.coalesce(header(4), header(2), header(3), first, F.lit("Unknown"))


def numbered_parts(df: DataFrame, keys: list[str], chunks: str, title_col: str) -> DataFrame:
    """Explodes an array of chunks; titles of several parts are numbered from 1."""
    parts = F.size(chunks)
    return df.select(*keys, title_col, parts.alias("parts"), F.posexplode(chunks).alias("part", "doc")).withColumn(title_col, F.when(F.col("parts") > 1, F.format_string("%s (part %d)", F.col(title_col), F.col("part") + 1)).otherwise(F.col(title_col)))


def _blocks(df: DataFrame, file: str, seq: str, width: int) -> DataFrame:
    """Rows with the block of their position, so that a file of any length is spread over tasks; rows without a position come first."""
    return df.withColumn("block_", F.coalesce(F.floor(F.col(seq) / width), F.lit(-1)))


def _edges(blocks: DataFrame, file: str, aggregates: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """One row for each block of a file: aggregates of its rows, and from these what the neighbouring blocks carry over."""
    order = Window.partitionBy(file).orderBy("block_")
    edges = blocks.groupBy(file, "block_").agg(*[c.alias(n) for n, c in aggregates.items()])
    return edges.select(F.col(file).alias("file_"), F.col("block_").alias("of_"), *[c(order).alias(n) for n, c in carried.items()])


def _with_edges(blocks: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    return blocks.join(edges, F.col(file).eqNullSafe(F.col("file_")) & (F.col("block_") == F.col("of_")), "left").drop("file_", "of_", "block_")


def linked(df: DataFrame, file: str, seq: str, key: str, width: int = 1000) -> DataFrame:
    """Previous and next chunk ids within a file, by blocks of width positions and one boundary row for each block."""
    blocks = _blocks(df, file, seq, width)
    at = F.struct(seq, key)
    edges = _edges(
        blocks, file, {"first_": F.min_by(key, at), "last_": F.max_by(key, at)}, {"before_": lambda w: F.lag("last_").over(w), "after_": lambda w: F.lead("first_").over(w)}
    )
    order = Window.partitionBy(file, "block_").orderBy(seq, key)
    inside = blocks.withColumn("previous_id", F.lag(key).over(order)).withColumn("next_id", F.lead(key).over(order))
    return _with_edges(inside, edges, file).withColumn("previous_id", F.coalesce("previous_id", "before_")).withColumn("next_id", F.coalesce("next_id", "after_")).drop("before_", "after_")


def merge_small(df: DataFrame, file: str, seq: str, doc: str, code: str, least: int = 100, longest: int = 2000, width: int = 1000) -> DataFrame:
    """file, seq, doc, code: chunks that are short or only a header take in the next one while the sum stays within longest.

    A chunk that is neither short nor only a header ends a run, since whatever it is merged into is neither; so the fold goes over
    runs of small chunks up to such a chunk, not over whole files. The first code that isn't blank is kept.
    """
    text = F.coalesce(F.col(doc), F.lit(""))
    is_small = lambda d: (F.length(d) < least) | (F.length(F.regexp_replace(d, "[^\n]", "")) <= 1)
    rows = _blocks(df.select(file, F.col(seq).alias("at_"), text.alias("doc_"), F.col(code).alias("code_")), file, "at_", width).withColumn("ends_", (~is_small(F.col("doc_"))).cast("long"))
    everything = F.struct("at_", "doc_", "code_")
    edges = _edges(rows, file, {"n_": F.sum("ends_")}, {"before_": lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    order = Window.partitionBy(file, "block_").orderBy(everything).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("ends_").over(order), F.lit(0))
    runs = _with_edges(rows.withColumn("run_", run), edges, file).withColumn("run_", F.col("run_") + F.col("before_"))
    folded_rows = runs.groupBy(file, "run_").agg(F.sort_array(F.collect_list(everything)).alias("items"))
    kind = "array<struct<at:int,doc:string,code:string>>"

    def step(out, x):
        last = F.element_at(out, -1)
        merge = (F.size(out) > 0) & is_small(last["doc"]) & (F.length(last["doc"]) + F.length(x["doc_"]) + 2 <= longest)
        joined = F.struct(last["at"].alias("at"), F.concat(last["doc"], F.lit("\n\n"), x["doc_"]).alias("doc"), F.coalesce(F.nullif(F.trim(last["code"]), F.lit("")), x["code_"]).alias("code"))
        own = F.struct(x["at_"].cast("int").alias("at"), x["doc_"].alias("doc"), x["code_"].alias("code"))
        return F.when(merge, F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), joined)).otherwise(F.array_append(out, own))

    return folded_rows.select(file, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("x")).select(file, F.col("x.at").alias("seq"), "x.doc", "x.code")


def overlapping(df: DataFrame, file: str, seq: str, doc: str, title_col: str, width: int = 1000) -> DataFrame:
    """Chunks of one split section begin with the last paragraph of the one before, if that is shorter than 200 characters.

    By blocks of width positions; only such short paragraphs and titles cross from block to block, never whole texts.
    """
    base = F.trim(F.split(F.col(title_col), r"\(").getItem(0))
    tail = F.element_at(F.split(F.col(doc), r"\n\s*\n"), -1)
    rows = _blocks(df, file, seq, width).withColumn("own_", F.struct(F.when(F.length(tail) < 200, tail).alias("tail"), base.alias("base")))
    edges = _edges(rows, file, {"last_": F.max_by("own_", seq)}, {"before_": lambda w: F.lag("last_").over(w)})
    inside = rows.withColumn("lag_", F.lag("own_").over(Window.partitionBy(file, "block_").orderBy(seq)))
    both = _with_edges(inside, edges, file).withColumn("lag_", F.coalesce("lag_", "before_"))
    carry = (F.col("lag_.base") == F.col("own_.base")) & ~F.rlike(F.col(doc), F.lit(r"^(##|[A-Za-z])")) & F.col("lag_.tail").isNotNull()
    return both.withColumn(doc, F.when(carry, F.concat("lag_.tail", F.lit("\n\n"), doc)).otherwise(F.col(doc))).drop("own_", "lag_", "before_")


def header_packed(df: DataFrame, key: str, text: str, longest: int = 2000, overlap: int = 200) -> DataFrame:
    """key, seq, body: sections packed by their headers.

    A header of level 2 always begins a chunk. One of level 4 begins a chunk if the open one would grow beyond longest with its
    section, or if there was no header of level 2 yet. A chunk still longer than longest is cut into paragraphs. Null and blank texts give none.
    """
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^##(?:##)?[ \t])"), lambda x: F.trim(x) != "")
    start = F.struct(F.lit("").alias("cur"), F.lit(False).alias("two"), F.array().cast("array<string>").alias("out"))

    def step(state, x):
        two = F.rlike(x, F.lit(r"^##[ \t]"))
        four = F.rlike(x, F.lit(r"^####[ \t]"))
        close = (state["cur"] != "") & (two | (four & (~state["two"] | (F.length(state["cur"]) + F.length(x) > longest))))
        out = F.when(close, F.array_append(state["out"], state["cur"])).otherwise(state["out"])
        return F.struct(F.when(close, x).otherwise(F.concat(state["cur"], x)).alias("cur"), (state["two"] | two).alias("two"), out.alias("out"))

    packed = F.aggregate(parts, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))
    cut = F.flatten(F.transform(packed, lambda x: F.when(F.length(x) > longest, pack_paragraphs(x, longest, overlap)).otherwise(F.array(F.trim(x)))))
    return df.where(~tx.blank(text)).select(key, F.posexplode(F.filter(cut, lambda x: x != "")).alias("seq", "body"))


def overview_chunk(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, doc: the overview and the class definition of a text as one chunk; texts without either have none."""
    part = lambda name: F.regexp_replace(F.regexp_extract(F.col(text), rf"(?ims)^##[ \t]+[^\n]*{name}[^\n]*\n(.*?)(?=^##[ \t]|\z)", 1), r"^\s+|\s+$", "")
    doc = F.concat_ws("\n\n", F.nullif(part("overview"), F.lit("")), F.nullif(part("class definition"), F.lit("")))
    return df.select(key, doc.alias("doc")).where("doc <> ''")


def marked_lines(text: Column | str, least: int = 10) -> Column:
    """The lines of a context longer than least, each marked DEFINITION (it names something with "is", "are" or a colon) or DETAIL."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    mark = lambda x: F.when(F.rlike(F.lower(x), F.lit(r"^[^.]{0,60}(?: is | are |: )")), "DEFINITION: ").otherwise("DETAIL: ")
    return F.array_join(F.transform(lines, lambda x: F.concat(mark(x), x)), "\n")


def paragraphs(text: Column | str, most: int = 12) -> Column:
    """The first paragraphs of a text, the lines of each joined by a blank."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")
    return F.slice(parts, 1, most)


def code_coverage(df: DataFrame, code: str) -> DataFrame:
    """Chunks, those with code, and their share."""
    return df.agg(F.count("*").alias("chunks"), F.count(F.when(~tx.blank(code), 1)).alias("with_code"), F.round(F.avg((~tx.blank(code)).cast("int")), 4).alias("coverage"))


def sentences_about(query: Column, text: Column) -> Column:
    """The sentences of a text (15 characters or more) that hold a query term or an overview word; the first always stays."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    asked = F.filter(tx.terms(query), lambda x: F.length(x) > 3)
    words = F.concat(asked, F.array(*map(F.lit, tx.OVERVIEW_WORDS)))
    kept = F.filter(parts, lambda s, i: (i == 0) | ((F.length(s) >= 15) & F.exists(words, lambda w: F.contains(F.lower(s), w))))
    return F.array_join(kept, " ")
