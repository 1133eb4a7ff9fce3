"""Queries over metric cells, parsed answers, sections and repeated questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import cleaning as cl
from docskein.functions import text as tx
from docskein.operators import chunking as ck
from docskein.operators import docquality as dq
from docskein.operators import evaluation as ev
from docskein.operators import hooks
from docskein.operators import ngrams as ng
from docskein.operators import understanding as un
from docskein.plans.answers import BLANK, ROWS, rows
from docskein.plans import texts  # noqa: F401  (registers the SQL used below)
from docskein.plans.registry import SQL, query, table
from docskein.plans.retrieval import BM25, LATEST, WORD, bm25_run, chunk_texts

#: Each score of a judgement with the least that its metric asks for.
LEAST = {"technical_accuracy": 6, "sap_domain_knowledge": 5, "completeness": 6, "clarity": 7, "practical_value": 5}
CASES = " ".join(f"WHEN '{m}' THEN {n}" for m, n in LEAST.items())
GRADED = f"""{ROWS}, s AS (SELECT evaluation_id, question_id, lower(trim(judge_model)) AS model, judge_choice, unnest(map_keys(scores_a)) AS metric, unnest(map_values(scores_a)) AS score FROM e),
 graded AS (SELECT *, CASE metric {CASES} END AS threshold FROM s)"""


def graded(spark, folder):
    least = F.coalesce(*[F.when(F.col("metric") == m, F.lit(n)) for m, n in LEAST.items()])
    cells = rows(spark, folder).select("evaluation_id", "question_id", F.lower(F.trim("judge_model")).alias("model"), "judge_choice", F.explode("scores_a").alias("metric", "score"))
    return cells.withColumn("threshold", least)


@query(
    f"""WITH {GRADED} SELECT evaluation_id, count(score) AS valid, round(avg(score) + 1e-9, 4) AS mean, count(*) FILTER (CASE WHEN metric = 'clarity' THEN score <= threshold ELSE score >= threshold END) AS passed FROM graded GROUP BY 1"""
)
def g_row_results(spark, folder):
    """Mean and passed metrics of each judgement; clarity stands for a metric whose low values are good."""
    return ev.row_results(graded(spark, folder), ["evaluation_id"], ("clarity",))


@query(
    f"""WITH {GRADED}, m AS (SELECT round(avg(score) + 1e-9, 4) AS overall, round(avg(score) FILTER (metric = 'completeness') + 1e-9, 4) AS focus FROM graded)
 SELECT overall, focus, round(focus - 6.5::DOUBLE, 4) AS above, focus >= 6.5 AS met FROM m"""
)
def g_focus_metric(spark, folder):
    return ev.focus_report(graded(spark, folder), "completeness", 6.5)


@query(
    f"""WITH {GRADED}, q AS (SELECT question_id, min(trim(question)) AS question FROM e GROUP BY 1), v AS (SELECT question_id, avg(score) AS mean, count(*) AS cells FROM graded WHERE score BETWEEN 4 AND 10 GROUP BY 1)
 SELECT question_id, question, coalesce(cells, 0) AS cells, round(mean + 1e-9, 4) AS mean FROM q LEFT JOIN v USING (question_id)"""
)
def j_question_cells(spark, folder):
    """Questions with the mean of their valid metric cells; those out of range are dropped, and questions without any stay."""
    questions = rows(spark, folder).groupBy("question_id").agg(F.min(F.trim("question")).alias("question"))
    valid = graded(spark, folder).where("score BETWEEN 4 AND 10").groupBy("question_id").agg(F.avg("score").alias("mean"), F.count("*").alias("cells"))
    return questions.join(valid, "question_id", "left").select("question_id", "question", F.coalesce("cells", F.lit(0)).alias("cells"), F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query(
    f"""WITH {GRADED}, v AS (SELECT *, CASE WHEN lower(trim(judge_choice)) = 'a' THEN 'yes' WHEN lower(trim(judge_choice)) = 'b' THEN 'no' ELSE judge_choice END AS verdict FROM graded),
 y AS (SELECT metric, score, lower(trim(verdict)) AS verdict FROM v)
 SELECT metric, count(score) AS n, round(avg(score) + 1e-9, 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS least, max(score) AS greatest,
 round(count(*) FILTER (verdict = 'yes') / nullif(count(*) FILTER (verdict IN ('yes', 'no')), 0) + 1e-9, 4) AS yes_rate FROM y GROUP BY 1"""
)
def g_rubric_summary(spark, folder):
    """Scores of each criterion and how often its verdict is yes among those that could be determined."""
    choice = F.lower(F.trim("judge_choice"))
    return ev.rubric_summary(graded(spark, folder).withColumn("verdict", F.when(choice == "a", "yes").when(choice == "b", "no").otherwise(F.col("judge_choice"))))


@query(
    f"""WITH {GRADED}, m AS (SELECT model, metric, round(avg(score) + 1e-9, 4) AS value FROM graded GROUP BY 1, 2)
 SELECT metric, arg_min(model, struct_pack(v := -value, m := model)) AS model, max(value) AS value FROM m GROUP BY 1"""
)
def g_best_models(spark, folder):
    """The judge with the highest mean of each metric."""
    means = graded(spark, folder).groupBy("model").pivot("metric", list(LEAST)).agg(F.round(F.avg("score") + 1e-9, 4))
    return ev.best_models(means, list(LEAST))


@query(
    f"""WITH {ROWS}, f AS (SELECT 'first' AS side, unnest(map_keys(scores_a)) AS field FROM e UNION ALL SELECT 'second', unnest(map_keys(position_mapping)) FROM e UNION ALL SELECT 'second', unnest(map_keys(scores_b)) FROM e),
 n AS (SELECT field, count(*) FILTER (side = 'first') AS in_first, count(*) FILTER (side = 'second') AS in_second FROM f GROUP BY 1)
 SELECT *, CASE WHEN in_first > 0 AND in_second > 0 THEN 'common' WHEN in_first > 0 THEN 'first only' ELSE 'second only' END AS "where" FROM n"""
)
def p_field_inventory(spark, folder):
    """The fields in the maps of one side of the judgements against those of the other."""
    e = rows(spark, folder)
    part = lambda side, c: e.select(F.lit(side).alias("side"), F.explode(F.map_keys(c)).alias("field"))
    return ev.field_inventory(part("first", "scores_a").unionAll(part("second", "position_mapping")).unionAll(part("second", "scores_b")))


@query(
    "SELECT evaluation_id, coalesce("
    + ", ".join(f"CASE WHEN NOT ({BLANK.format(c)}) THEN {c} END" for c in ("closed_source_response", "open_source_response", "response_a", "response_b"))
    + f") AS response FROM (WITH {ROWS} SELECT * FROM e)"
)
def p_first_response(spark, folder):
    """The first response that isn't blank, whatever the table calls it."""
    e = rows(spark, folder)
    return e.select("evaluation_id", cl.first_response(e).alias("response"))


@query(
    f"""WITH {ROWS}, j AS (SELECT evaluation_id, CASE WHEN switch_round = 0 THEN 'Here it is: ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) ELSE '' END || '{{"winner": "' || coalesce(judge_choice, '') || '", "confidence": ' || coalesce(confidence::VARCHAR, 'null') || '}}' || CASE WHEN switch_round = 0 THEN chr(10) || chr(96) || chr(96) || chr(96) ELSE '' END AS answer, judge_choice, confidence FROM e),
 w AS (SELECT *, upper(substr(trim(judge_choice), 1, 1)) || lower(substr(trim(judge_choice), 2)) AS winner FROM j),
 k AS (SELECT *, coalesce(winner IN ('A', 'B', 'Tie') AND judge_choice NOT LIKE '%"%', false) AS ok FROM w)
 SELECT evaluation_id, CASE WHEN ok THEN winner ELSE 'Tie' END AS winner, CASE WHEN ok AND confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.5 END AS confidence, ok AS parsed FROM k"""
)
def f_judge_verdicts(spark, folder):
    """Judges' answers as JSON text, half of them fenced, parsed again; what can't be read is a tie."""
    fence = F.col("switch_round") == 0
    answer = F.concat(
        F.when(fence, "Here it is: ```json\n").otherwise(""), F.lit('{"winner": "'), F.coalesce("judge_choice", F.lit("")), F.lit('", "confidence": '), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit("}"),
        F.when(fence, "\n```").otherwise(""),
    )
    return rows(spark, folder).select("evaluation_id", cl.judge_verdict(answer).alias("v")).select("evaluation_id", "v.*")


@query("""SELECT event_id, event_type || ':' || (value * 100)::BIGINT AS answer FROM events""")
def f_provider_texts(spark, folder):
    """Texts out of the answers of four kinds of model providers."""
    e = table(spark, folder, "events").select("event_id", F.concat_ws(":", "event_type", F.round(F.col("value") * 100).cast("long")).alias("t"))
    shaped = (
        F.when(F.col("event_id") % 4 == 0, F.format_string('{"choices": [{"message": {"content": "%s"}}]}', "t"))
        .when(F.col("event_id") % 4 == 1, F.format_string('{"content": [{"text": "%s"}]}', "t"))
        .when(F.col("event_id") % 4 == 2, F.format_string('{"candidates": [{"content": {"parts": [{"text": "%s"}]}}]}', "t"))
        .otherwise(F.col("t"))
    )
    return e.select("event_id", cl.provider_text(shaped).alias("answer"))


@query(
    f"""{BM25}, v AS (SELECT *, CASE WHEN rank % 3 = 0 THEN NULL ELSE (10 - rank) / 10.0::DOUBLE END AS rel FROM hits),
 w AS (SELECT qid, doc_id, rank, CASE WHEN rel IS NULL THEN score / 50 ELSE score / 50 * (0.2::DOUBLE + 0.8::DOUBLE * rel) END AS s FROM v), f AS (SELECT qid, doc_id, round(CASE WHEN qid % 2 = 0 THEN least(1.0::DOUBLE, s * 1.2::DOUBLE) ELSE s END, 6) AS score FROM w)
 SELECT qid, doc_id::VARCHAR AS context_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id::VARCHAR)::INT AS place FROM f"""
)
def f_filtered_contexts(spark, folder):
    """Hits weighted by a filter's verdicts, given as JSON (here by rank; each third isn't judged)."""
    hits = bm25_run(spark, folder).select("qid", F.col("doc_id").cast("string").alias("context_id"), (F.col("score") / 50).alias("score"), F.lit("").alias("text"), F.lit("").alias("code"), "rank")
    said = F.when(F.col("rank") % 3 != 0, F.format_string('[{"context_id": "%s", "relevance": %s, "keep_code": false}]', "context_id", ((10 - F.col("rank")) / 10.0).cast("string")))
    return cl.filtered_contexts(hits, said, F.col("qid") % 2 == 0).select("qid", "context_id", "score", "place")


@query(
    f"""WITH c AS ({LATEST}) SELECT chunk_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Content: ' || substr(coalesce(doc, ''), 1, 2000) || chr(10) || 'Code: ' || substr(coalesce(code_snippet, ''), 1, 1500) AS pair_text FROM c"""
)
def r_pair_text(spark, folder):
    """What a reranker reads of each chunk."""
    return chunk_texts(spark, folder).select(F.col("doc_id").alias("chunk_id"), hooks.pair_text(F.col("title"), F.col("text"), F.col("code_snippet")).alias("pair_text"))


@query()
def r_bounded_contexts(spark, folder):
    """The first six hits of each question as bounded contexts."""
    docs = chunk_texts(spark, folder)
    from docskein.operators import retrieval as rt
    from docskein.plans.retrieval import golden

    hits = rt.bm25_top_k(docs, golden(spark, folder), 6).join(docs, "doc_id")
    return hits.select("qid", "rank", cl.bounded_contexts(F.col("text"), F.col("code_snippet"), F.col("title")).alias("context"))


KEYWORDS = ("METHOD", "CLASS", "TABLE", "FIELD", "LOOP", "SELECT", "CALL", "IF", "EACH", "ROWS", "OVERVIEW")


@query(
    rf"""WITH w AS (SELECT sample_id, list_filter(regexp_extract_all(lower(coalesce(documentation, '')), '{WORD}'), lambda x: regexp_matches(x, '^[a-z_]{{2,}}$')) AS w FROM dataset)
 SELECT sample_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: list_contains({list(KEYWORDS)}, upper(x))))::DOUBLE / len(w) END, 4) AS validity FROM w"""
)
def d_construct_validity(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", dq.construct_validity("documentation", F.array(*map(F.lit, KEYWORDS))).alias("validity"))


@query(
    r"""WITH l AS (SELECT chunk_id, unnest(string_split(coalesce(doc, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(doc, ''), chr(10))) + 1)) AS i FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn_ FROM combined_all_chunks) WHERE rn_ = 1)),
 g AS (SELECT *, sum(regexp_matches(line, '^#{1,6}[ \t]')::INT) OVER (PARTITION BY chunk_id ORDER BY i) AS s FROM l),
 p AS (SELECT chunk_id, s, arg_min(line, i) AS header, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '^#{1,6}[ \t]')), ''), ' ') AS body FROM g WHERE s > 0 GROUP BY 1, 2)
 SELECT chunk_id, lower(trim(regexp_extract(header, '^#{1,6}[ \t]+(.*)$', 1), ' ')) AS section, md5(regexp_replace(arg_max(body, s), '\s', '', 'g')) AS body_md5 FROM p GROUP BY 1, 2"""
)
def d_section_map(spark, folder):
    s = dq.section_map(chunk_texts(spark, folder), "doc_id", "text")
    return s.select(F.col("doc_id").alias("chunk_id"), "section", F.md5(F.regexp_replace("body", r"\s", "")).alias("body_md5"))


@query(
    f"""WITH w AS (SELECT sample_id, coalesce(len(regexp_extract_all(lower(documentation), '{WORD}')), 0) AS words, coalesce(len(regexp_extract_all(lower(code), '{WORD}')), 0) AS code_words FROM dataset)
 SELECT sample_id, metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT sample_id, words::DOUBLE AS words, code_words::DOUBLE AS code_words, words::DOUBLE AS enhanced_words FROM w) ON words, code_words, enhanced_words INTO NAME metric VALUE value)"""
)
def d_sample_metrics(spark, folder):
    counted = {"words": F.size(tx.words("documentation")), "code_words": F.size(tx.words("code"))}
    return dq.sample_metrics(table(spark, folder, "dataset"), "sample_id", counted, ["words"])


def _grams(side: str, n: int) -> str:
    return f"SELECT question_id, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: list_aggregate({side}[i:i+{n - 1}], 'string_agg', ' '))) AS gram, {int(side == 'r')} AS r, {int(side == 'c')} AS c FROM w WHERE len({side}) >= {n}"


def _at(n: int, c: str) -> str:
    return f"coalesce(max({c}) FILTER (n = {n}), 0) AS {c}{n}"


def _bleu(longest: int) -> str:
    logs = " + ".join(f"ln((CASE WHEN clipped{n} = 0 THEN 0.1::DOUBLE ELSE clipped{n} END) / candidates{n})" for n in range(1, longest + 1))
    return f"CASE WHEN candidates{longest} = 0 OR clipped1 = 0 THEN 0 ELSE round((CASE WHEN candidates1 >= references1 THEN 1.0 ELSE exp(1 - references1 / candidates1) END) * exp(({logs}) / {longest}), 6) END AS bleu_{longest}"


def _rouge(n: int) -> str:
    return f"CASE WHEN clipped{n} = 0 THEN 0 ELSE round(2.0::DOUBLE * clipped{n} / (candidates{n} + references{n}), 6) END AS rouge_{n}"


@query(
    f"""WITH w AS (SELECT question_id, coalesce(regexp_extract_all(lower(max(closed_source_response)), '{WORD}'), []) AS r, coalesce(regexp_extract_all(lower(max(open_source_response)), '{WORD}'), []) AS c FROM evaluation_result GROUP BY 1),
 g AS ({' UNION ALL '.join(_grams(s, n) for s in 'rc' for n in (1, 2, 3, 4))}), b AS (SELECT question_id, n, gram, sum(r) AS r, sum(c) AS c FROM g GROUP BY 1, 2, 3),
 k AS (SELECT question_id, n, sum(least(r, c))::DOUBLE AS clipped, sum(c)::DOUBLE AS candidates, sum(r)::DOUBLE AS "references" FROM b GROUP BY 1, 2),
 x AS (SELECT question_id, {', '.join(_at(n, c).replace('max(references)', 'max("references")') for n in (1, 2, 3, 4) for c in ('clipped', 'candidates', 'references'))} FROM k GROUP BY 1),
 s AS (SELECT question_id, {_bleu(1)}, {_bleu(2)}, {_bleu(4)}, {_rouge(1)}, {_rouge(2)} FROM x)
 SELECT question_id, {', '.join(f'coalesce({m}, 0)::DOUBLE AS {m}' for m in ('bleu_1', 'bleu_2', 'bleu_4', 'rouge_1', 'rouge_2'))} FROM w LEFT JOIN s USING (question_id)"""
)
def f_clipped_scores(spark, folder):
    """Clipped BLEU and ROUGE of open answers against closed ones."""
    pairs = table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("closed_source_response").alias("r"), F.max("open_source_response").alias("c"))
    return ng.clipped_scores(pairs, "question_id", "r", "c")


@query(
    f"""WITH w AS (SELECT question_id, list_sort(list_distinct(coalesce(regexp_extract_all(lower(max(closed_source_response)), '{WORD}'), [])))[1:12] AS r, list_distinct(coalesce(regexp_extract_all(lower(max(open_source_response)), '{WORD}'), [])) AS c FROM evaluation_result GROUP BY 1),
 n AS (SELECT question_id, len(r) AS lr, len(c) AS lc, len(list_intersect(r, c)) AS b FROM w)
 SELECT question_id, round(CASE WHEN lr = 0 THEN 1 ELSE b::DOUBLE / lr END, 6) AS coverage, round(CASE WHEN lc = 0 THEN 0 ELSE b::DOUBLE / lc END, 6) AS precision FROM n"""
)
def m_keyword_coverage(spark, folder):
    """Twelve keywords of closed answers against open ones."""
    pairs = table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("closed_source_response").alias("r"), F.max("open_source_response").alias("c"))
    s = pairs.select("question_id", tx.coverage_only(tx.words("r"), tx.words("c")).alias("s"))
    return s.select("question_id", F.round("s.coverage", 6).alias("coverage"), F.round("s.precision", 6).alias("precision"))


SIMILAR = f"""w AS (SELECT item_id, list_distinct(coalesce(regexp_extract_all(lower(question), '{WORD}'), [])) AS w FROM golden_dataset),
 pairs AS (SELECT a.item_id AS a, b.item_id AS b FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.5::DOUBLE * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9)"""


@query(
    f"""WITH RECURSIVE {SIMILAR}, near AS (SELECT b AS item_id, list(a) AS earlier FROM pairs GROUP BY 1), o AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn, earlier FROM golden_dataset LEFT JOIN near USING (item_id)),
 r(rn, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.rn, CASE WHEN o.earlier IS NOT NULL AND list_has_any(taken, o.earlier) THEN taken ELSE list_append(taken, o.item_id) END FROM r JOIN o ON o.rn = r.rn + 1)
 SELECT item_id, list_contains((SELECT taken FROM r ORDER BY rn DESC LIMIT 1), item_id) AS accepted FROM golden_dataset"""
)
def f_new_questions(spark, folder):
    """Golden questions taken one after the other unless they are too similar to one that was taken."""
    return ng.accepted_in_order(table(spark, folder, "golden_dataset").select("item_id", "question"), "item_id", "question", 0.5)


@query(f"WITH {SIMILAR} SELECT a, b FROM pairs")
def f_similar_questions(spark, folder):
    """Pairs of golden questions that share half of their words, by a join on rare words."""
    return ng.similar_word_sets(table(spark, folder, "golden_dataset").select("item_id", "question"), "item_id", "question", 0.5)


@query()
def a_header_packed(spark, folder):
    """Documentation packed by its headers of level 2 and 4 (an ordered fold)."""
    return ck.header_packed(table(spark, folder, "dataset"), "sample_id", "documentation", 600, 100)


@query(
    r"""WITH l AS (SELECT sample_id, unnest(string_split(documentation, chr(10))) AS line, unnest(range(1, len(string_split(documentation, chr(10))) + 1)) AS i FROM dataset WHERE trim(regexp_replace(documentation, '\s+', '', 'g')) <> ''),
 g AS (SELECT *, sum(regexp_matches(line, '^#{2,4}[ \t]')::INT) OVER (PARTITION BY sample_id ORDER BY i) AS s FROM l), b AS (SELECT sample_id, s, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2)
 SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY s) - 1)::INT AS seq, trim(regexp_extract(body, '^#{2,4}[ \t]+([^\n]*)', 1), ' ') AS header, md5(regexp_replace(body, '\s+', '', 'g')) AS body_md5 FROM b WHERE regexp_replace(body, '\s+', '', 'g') <> ''"""
)
def a_header_sections(spark, folder):
    """Sections at headers of level 2 to 4."""
    s = ck.sections(table(spark, folder, "dataset"), "sample_id", "documentation", 2, 4)
    return s.select("sample_id", "seq", "header", F.md5(F.regexp_replace("body", r"\s+", "")).alias("body_md5"))


@query(
    r"""SELECT item_id, coalesce(list_aggregate(list_transform(list_filter(list_transform(string_split(coalesce(reference_context, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 10), lambda x: CASE WHEN regexp_matches(lower(x), '^[^.]{0,60}(?: is | are |: )') THEN 'DEFINITION: ' ELSE 'DETAIL: ' END || x), 'string_agg', chr(10)), '') AS marked FROM golden_dataset"""
)
def a_marked_lines(spark, folder):
    return table(spark, folder, "golden_dataset").select("item_id", ck.marked_lines("reference_context").alias("marked"))


@query()
def a_overview_chunks(spark, folder):
    """Overview and class definition of documentation as one chunk."""
    return ck.overview_chunk(table(spark, folder, "dataset"), "sample_id", "documentation")


@query(
    r"""WITH p AS (SELECT doc_id, unnest(x)  AS p, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\n\s*\n', chr(1), 'g'), chr(1)) AS x FROM documents)),
 c AS (SELECT doc_id, i, trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'), ' ') AS p FROM p), k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM c WHERE p <> '')
 SELECT doc_id, (place - 1)::INT AS place, md5(p) AS paragraph_md5 FROM k WHERE place <= 12"""
)
def f_paragraphs(spark, folder):
    """The first twelve paragraphs of each document, as the listing shows them."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(ck.paragraphs("text")).alias("place", "p")).select("doc_id", "place", F.md5("p").alias("paragraph_md5"))


@query()
def f_display(spark, folder):
    """Chunks as they are shown: text and code cleaned, repeated titles left out, method sections."""
    c = chunk_texts(spark, folder)
    return c.select(
        F.col("doc_id").alias("chunk_id"), cl.display_text("text").alias("shown"), cl.display_code("code_snippet").alias("code"), cl.without_repeats("text", "title").alias("document"), F.size(cl.method_sections("text")).alias("method_sections"),
    )


@query(
    r"""SELECT evaluation_id, coalesce(TRY_CAST(nullif(regexp_extract(reasoning || ' ' || coalesce(confidence, 0)::VARCHAR, '(\d+\.\d+)', 1), '') AS DOUBLE), 0.5) AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY loaded_at DESC) AS rn_ FROM evaluation_result) WHERE rn_ = 1) WHERE confidence IS NOT NULL AND confidence < 1 AND NOT regexp_matches(coalesce(reasoning, ''), '\d') AND reasoning IS NOT NULL"""
)
def f_first_scores(spark, folder):
    """The first decimal in judges' reasons with their confidence written behind."""
    e = rows(spark, folder).where("confidence IS NOT NULL AND confidence < 1 AND reasoning IS NOT NULL").where(~F.rlike(F.coalesce("reasoning", F.lit("")), F.lit(r"\d")))
    return e.select("evaluation_id", cl.first_score(F.concat_ws(" ", "reasoning", F.col("confidence").cast("string"))).alias("score"))


@query(
    f"""WITH {ROWS} SELECT evaluation_id, 'Clarity' AS name, round(confidence * 100, 2) AS value, upper(CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END) AS stated, coalesce(CASE WHEN map_extract_value(scores_a, 'clarity') BETWEEN 1 AND 5 THEN map_extract_value(scores_a, 'clarity') END, 3) AS rubric FROM e WHERE confidence IS NOT NULL"""
)
def f_metric_texts(spark, folder):
    """Metric lines, stated confidence levels and rubric scores, written as text and read again."""
    e = rows(spark, folder).where("confidence IS NOT NULL")
    level = F.when(F.col("confidence") > 0.8, "High").when(F.col("confidence") >= 0.6, "Medium").otherwise("Low")
    line = F.concat(F.lit("Clarity: "), F.round(F.col("confidence") * 100, 2).cast("string"), F.lit("% ("), level, F.lit(")"))
    stated = F.concat(F.lit("Because of this.\nConfidence: "), level)
    scores = F.concat(F.lit("Scores:\n```json\n"), F.to_json("scores_a"), F.lit("\n```"))
    m = e.select("evaluation_id", cl.metric_text(line).alias("m"), cl.confidence(stated).alias("stated"), cl.rubric_score(scores, "clarity").alias("rubric"))
    return m.select("evaluation_id", "m.name", "m.value", "stated", "rubric")


@query(
    r"""WITH t AS (SELECT sample_id, coalesce(documentation, '') AS d FROM dataset) SELECT sample_id, CASE WHEN len(regexp_extract_all(d, '(?m)^.*\|.*$')) = 0 THEN 1.0 ELSE least(1.0, len(regexp_extract_all(d, '(?m)^\s*\|?[\s:-]*---[\s|:-]*$'))) END::DOUBLE AS tables FROM t"""
)
def d_table_score(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", dq.table_score("documentation").alias("tables"))


@query(
    f"""WITH k AS ({SQL["q_question_types"]}) SELECT kind, count(*) AS n, count(*) FILTER (complex) AS complex, count(*) FILTER (out_of_scope) AS out_of_scope FROM k GROUP BY 1"""
)
def q_type_report(spark, folder):
    """Kinds of golden questions, how many are complex and how many are out of scope."""
    return un.type_report(table(spark, folder, "golden_dataset"), "question")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s_missing_keys(spark, folder):
    """Documents that have no vector yet, so that an upload can resume."""
    return ev.missing_keys(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(
    "SELECT d.doc_id, least(length(coalesce(text, '')), 65535)::INT AS kept, len(embedding)::INT AS dimensions, (row_number() OVER (ORDER BY d.doc_id))::BIGINT AS position FROM documents d JOIN embeddings e ON vec_id = doc_id"
)
def s_upload_rows(spark, folder):
    """Documents joined with their vectors for an upload: texts capped as the store asks, rows without a vector left out, positions from 1."""
    vecs = table(spark, folder, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimensions"))
    rows_ = table(spark, folder, "documents").select("doc_id", F.length(F.substring(F.coalesce("text", F.lit("")), 1, 65535)).alias("kept")).join(vecs, "doc_id")
    return ev.numbered(rows_, "doc_id", "position")
