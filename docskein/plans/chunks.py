"""Queries over chunking: sections, packing, titles, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.operators import chunking as ck
from docskein.operators import evaluation as ev
from docskein.plans.registry import query, table
from docskein.plans.retrieval import LATEST, WORD


def current(spark, folder):
    return ev.latest(table(spark, folder, "combined_all_chunks"), "chunk_id", "ingested_at")


@query(
    r"""WITH l AS (SELECT sample_id, unnest(string_split(documentation, chr(10))) AS line, unnest(range(1, len(string_split(documentation, chr(10))) + 1)) AS i FROM dataset WHERE trim(regexp_replace(documentation, '\s+', '', 'g')) <> ''),
 g AS (SELECT *, sum(regexp_matches(line, '^####[ \t]')::INT) OVER (PARTITION BY sample_id ORDER BY i) AS s FROM l), b AS (SELECT sample_id, s, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2)
 SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY s) - 1)::INT AS seq, trim(regexp_extract(body, '^####[ \t]+([^\n]*)', 1), ' ') AS header, md5(trim(regexp_replace(body, '\s+', ' ', 'g'), ' ')) AS body_md5 FROM b WHERE regexp_replace(body, '\s+', '', 'g') <> ''"""
)
def a_sections(spark, folder):
    s = ck.sections(table(spark, folder, "dataset"), "sample_id", "documentation")
    return s.select("sample_id", "seq", "header", F.md5(F.trim(F.regexp_replace("body", r"\s+", " "))).alias("body_md5"))


@query()
def a_packed_paragraphs(spark, folder):
    """Documents cut into chunks of whole paragraphs with overlap, titled and numbered (an ordered fold)."""
    d = table(spark, folder, "documents").select("doc_id", ck.title("text").alias("title"), ck.pack_paragraphs("text", 400, 80).alias("chunks"))
    return ck.numbered_parts(d, ["doc_id"], "chunks", "title").select("doc_id", "part", "parts", "title", "doc")


@query()
def a_merge_small(spark, folder):
    """Small chunks of each file merged in order (an ordered fold)."""
    c = current(spark, folder).withColumn("seq", F.regexp_extract("chunk_id", r"_c(\d+)$", 1).cast("int"))
    return ck.merge_small(c, "filename", "seq", "doc", "code_snippet", 300, 2000)


@query(f"WITH c AS ({LATEST}), s AS (SELECT chunk_id, filename, regexp_extract(chunk_id, '_c(\\d+)$', 1)::INT AS seq FROM c) SELECT chunk_id, filename, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM s WINDOW w AS (PARTITION BY filename ORDER BY seq, chunk_id)")
def a_links(spark, folder):
    c = current(spark, folder).select("chunk_id", "filename", F.regexp_extract("chunk_id", r"_c(\d+)$", 1).cast("int").alias("seq"))
    return ck.linked(c, "filename", "seq", "chunk_id").drop("seq")


@query(
    rf"""WITH c AS ({LATEST}), t AS (SELECT chunk_id, coalesce(doc, '') AS d FROM c) SELECT chunk_id, coalesce(nullif(trim(regexp_replace(regexp_extract(d, '(?m)^#{{4}}[ \t]+([^\n|]+)', 1), ' - .*$', ''), ' '), ''), nullif(trim(regexp_replace(regexp_extract(d, '(?m)^#{{2}}[ \t]+([^\n|]+)', 1), ' - .*$', ''), ' '), ''),
 nullif(trim(regexp_replace(regexp_extract(d, '(?m)^#{{3}}[ \t]+([^\n|]+)', 1), ' - .*$', ''), ' '), ''), nullif(trim(substr(regexp_extract(d, '^\s*([^\n]+)', 1), 1, 30), ' '), ''), 'Unknown') AS found FROM t"""
)
def a_titles(spark, folder):
    return current(spark, folder).select("chunk_id", ck.title("doc").alias("found"))


@query(
    """SELECT doc_id, length(t) > 3000 OR (length(t) - length(replace(t, '##', ''))) / 2 > 3 OR contains(t, 'Method Dependencies') AS needs_splitter FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def a_router(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ck.needs_splitter("text").alias("needs_splitter"))


@query(
    r"""WITH b AS (SELECT chunk_id, unnest(x) AS body, unnest(range(len(x))) AS pos FROM (SELECT DISTINCT chunk_id, regexp_extract_all(coalesce(code_snippet, ''), '(?is)(\bMETHOD\s+[\w~/]+.*?\bENDMETHOD\b)', 1) AS x FROM combined_all_chunks))
 SELECT chunk_id, lower(regexp_extract(body, '(?i)^METHOD\s+([\w~/]+)', 1)) AS method, md5(arg_max(body, pos)) AS body_md5 FROM b GROUP BY 1, 2"""
)
def a_methods(spark, folder):
    m = ck.methods(current(spark, folder), "chunk_id", "code_snippet")
    return m.select("chunk_id", "method", F.md5("body").alias("body_md5"))


@query(
    r"""WITH l AS (SELECT sample_id, unnest(string_split(documentation, chr(10))) AS line, unnest(range(1, len(string_split(documentation, chr(10))) + 1)) AS i FROM dataset WHERE trim(regexp_replace(documentation, '\s+', '', 'g')) <> ''),
 g AS (SELECT *, sum(regexp_matches(line, '^####[ \t]')::INT) OVER (PARTITION BY sample_id ORDER BY i) AS s FROM l), b AS (SELECT sample_id, s, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2),
 h AS (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY s) - 1)::INT AS seq, trim(regexp_extract(body, '^####[ \t]+([^\n]*)', 1), ' ') AS header FROM b WHERE regexp_replace(body, '\s+', '', 'g') <> ''),
 c AS (SELECT sample_id, unnest(regexp_extract_all(coalesce(code, ''), '(?is)(\bMETHOD\s+[\w~/]+.*?\bENDMETHOD\b)', 1)) AS body FROM dataset), m AS (SELECT DISTINCT sample_id, lower(regexp_extract(body, '(?i)^METHOD\s+([\w~/]+)', 1)) AS method FROM c),
 p AS (SELECT sample_id, seq, header, lower(trim(header, ' ')) AS h, method, regexp_replace(method, '[_~-]', '', 'g') AS bm, regexp_replace(lower(trim(header, ' ')), '[_~-]', '', 'g') AS bh FROM h JOIN m USING (sample_id) WHERE regexp_replace(header, '\s+', '', 'g') <> ''),
 r AS (SELECT *, CASE WHEN h = method THEN 1 WHEN bh = bm THEN 2 WHEN ends_with(method, h) THEN 3 WHEN length(h) >= 5 AND length(method) >= 5 AND (contains(method, h) OR contains(h, method)) THEN 4 END::INT AS rule FROM p)
 SELECT sample_id, seq, header, method, rule FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, seq ORDER BY rule, method) AS place FROM r WHERE rule IS NOT NULL) WHERE place = 1"""
)
def a_match_methods(spark, folder):
    """Headers of documentation with the methods of their code, by the first rule that fits."""
    d = table(spark, folder, "dataset")
    return ck.match_methods(ck.sections(d, "sample_id", "documentation"), ck.methods(d, "sample_id", "code"), "sample_id")


@query("WITH c AS (" + LATEST + ") SELECT count(*) AS chunks, count(*) FILTER (regexp_replace(coalesce(code_snippet, ''), '\\s+', '', 'g') <> '') AS with_code, round(avg((regexp_replace(coalesce(code_snippet, ''), '\\s+', '', 'g') <> '')::INT), 4) AS coverage FROM c")
def a_code_coverage(spark, folder):
    return ck.code_coverage(current(spark, folder), "code_snippet")


@query(
    rf"""WITH c AS ({LATEST}), s AS (SELECT chunk_id, filename, doc, regexp_extract(chunk_id, '_c(\d+)$', 1)::INT AS seq, trim(split_part(title, '(', 1), ' ') AS base, regexp_split_to_array(doc, '\n\s*\n')[-1] AS tail FROM c),
 o AS (SELECT *, lag(CASE WHEN length(tail) < 200 THEN tail END) OVER w AS before, lag(base) OVER w AS last_base FROM s WINDOW w AS (PARTITION BY filename ORDER BY seq))
 SELECT chunk_id, CASE WHEN before IS NOT NULL AND last_base = base AND NOT regexp_matches(doc, '^(##|[A-Za-z])') THEN before || chr(10) || chr(10) || doc ELSE doc END AS doc FROM o"""
)
def a_overlapping(spark, folder):
    """Parts of a section that continue it begin with its last short paragraph."""
    c = current(spark, folder).withColumn("seq", F.regexp_extract("chunk_id", r"_c(\d+)$", 1).cast("int"))
    return ck.overlapping(c, "filename", "seq", "doc", "title").select("chunk_id", "doc")


@query(
    rf"""WITH g AS (SELECT item_id, string_split(regexp_replace(coalesce(reference_context, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts,
 list_concat(list_filter(list_distinct(coalesce(regexp_extract_all(lower(question), '{WORD}'), [])), lambda x: length(x) > 3), {list(tx.OVERVIEW_WORDS)}) AS words FROM golden_dataset)
 SELECT item_id, list_aggregate(list_filter(parts, lambda s, i: i = 1 OR (length(s) >= 15 AND len(list_filter(words, lambda w: contains(lower(s), w))) > 0)), 'string_agg', ' ') AS kept FROM g"""
)
def a_sentences_about(spark, folder):
    """The sentences of each golden context that concern its question."""
    return table(spark, folder, "golden_dataset").select("item_id", ck.sentences_about(F.col("question"), F.col("reference_context")).alias("kept"))


@query(
    """WITH p AS (SELECT doc_id, i, trim(substr(text, i * 500 + 1, 500), ' ') AS piece FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 500.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0))
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS part, piece FROM p WHERE piece <> ''"""
)
def a_split_points(spark, folder):
    """Documents cut at given points (here every 500 characters, as a model might say)."""
    d = table(spark, folder, "documents").where("length(text) > 0")
    points = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.length("text") / 500), F.lit(1)).cast("int")), lambda i: i * 500)
    return d.select("doc_id", F.posexplode(ck.split_at(F.col("text"), points)).alias("part", "piece"))
