"""Queries over text measures, questions and documentation quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.operators import docquality as dq
from docskein.operators import hooks
from docskein.operators import understanding as un
from docskein.plans.registry import query, table

WORD = r"[\pL\pN\pM_]+"
NAME = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"


def golden(spark, folder):
    return table(spark, folder, "golden_dataset")


def chunks(spark, folder):
    return table(spark, folder, "combined_all_chunks")


def any_of(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


Q = "q AS (SELECT item_id, lower(coalesce(question, '')) AS q, coalesce(question, '') AS raw, len(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '\\s+'), lambda x: x <> '')) AS n FROM golden_dataset)"


@query(
    f"""WITH {Q} SELECT item_id, CASE WHEN n < 10 AND {any_of('q', un.SIMPLE_WORDS)} AND NOT {any_of('q', un.NOT_SIMPLE)} THEN 'simple' WHEN {any_of('q', un.COMPLEX_WORDS)} AND (n > 15 OR contains(q, 'in what way')) THEN 'complex'
 WHEN {any_of('q', un.SITUATIONAL_WORDS)} THEN 'situational' WHEN {any_of('q', un.DISTRACTING_WORDS)} THEN 'distracting' WHEN length(q) - length(replace(q, '?', '')) > 1 THEN 'double' ELSE 'general' END AS kind,
 (contains(q, ',') AND contains(q, ' and ')) OR length(q) - length(replace(q, '?', '')) > 1 OR n > 15 AS complex,
 regexp_matches(q, '\\b(my (?:name|age|friend|family)|your (?:name|opinion)|weather|joke|recipe)\\b') OR NOT ({any_of('q', un.DOMAIN_WORDS)} OR regexp_matches(raw, '{NAME}')) AS out_of_scope FROM q"""
)
def q_question_types(spark, folder):
    return golden(spark, folder).select("item_id", un.question_type("question").alias("kind"), un.is_complex("question").alias("complex"), un.out_of_scope("question").alias("out_of_scope"))


@query(
    f"""WITH {Q} SELECT item_id, {any_of('q', ('interface', 'zif_', 'if_'))} AS interface, {any_of('q', ('method', 'function', 'routine', 'call'))} AS method, {any_of('q', ('table', 'structure', 'field', 'column'))} AS structure,
 {any_of('q', ('exception', 'error', 'raise', 'fail'))} AS exception FROM q"""
)
def q_flags(spark, folder):
    return golden(spark, folder).select("item_id", un.flags("question").alias("f")).select("item_id", "f.*")


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS q FROM documents), r AS (SELECT doc_id, regexp_matches(q, '\\b(?:drop\\s+table|delete\\s+from|rm\\s+-rf|password|exploit)\\b|<script|javascript:') AS u,
 regexp_matches(q, 'ignore (?:all |the )?previous instructions|system prompt|jailbreak|act as\\b') AS i FROM d) SELECT doc_id, NOT u AS safe, CASE WHEN u THEN 'HIGH' WHEN i THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r"""
)
def q_safety(spark, folder):
    return table(spark, folder, "documents").select("doc_id", un.safety("text").alias("s")).select("doc_id", "s.*")


@query(
    r"""SELECT item_id, regexp_replace(regexp_replace(trim(coalesce(question, '')), '\b(ZCL_[A-Z0-9_]+)', 'class \1', 'g'), '\b(ZIF_[A-Z0-9_]+)', 'interface \1', 'g') AS conservative,
 regexp_replace(regexp_replace(regexp_replace(trim(coalesce(question, '')), '\b(ZCL_[A-Z0-9_]+)', 'class \1', 'g'), '\b(ZIF_[A-Z0-9_]+)', 'interface \1', 'g'), '\b(Z[TX]_[A-Z0-9_]+)', 'table \1', 'g') || ' Give parameters and exceptions.' AS aggressive FROM golden_dataset"""
)
def q_rewrite(spark, folder):
    return golden(spark, folder).select("item_id", un.rewrite("question").alias("conservative"), un.rewrite("question", "aggressive").alias("aggressive"))


@query(
    r"""WITH m AS (SELECT item_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(question, ''), '\?\s*', '?' || chr(1), 'g'), ', and (what|how|why|when|where|which|who)', chr(1) || '\1', 'g'), chr(1))) AS p FROM golden_dataset)
 SELECT item_id, trim(p) AS part FROM m WHERE trim(p) <> ''"""
)
def q_sub_questions(spark, folder):
    return golden(spark, folder).select("item_id", F.explode(un.sub_questions("question")).alias("part"))


@query(
    f"""WITH e AS (SELECT question_id, max(open_source_response) AS a, max(closed_source_response) AS c FROM evaluation_result GROUP BY 1),
 n AS (SELECT question_id, coalesce(list_distinct(regexp_extract_all(a, '{NAME}')), []) AS x, coalesce(list_distinct(regexp_extract_all(c, '{NAME}')), []) AS y FROM e),
 u AS (SELECT question_id, len(x) AS named, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS unknown FROM n)
 SELECT question_id, named::INT AS named, unknown::INT AS unknown, CASE WHEN unknown >= 5 THEN 'HIGH' WHEN unknown >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN unknown >= 5 THEN 'LOW' WHEN unknown >= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM u"""
)
def q_unsupported(spark, folder):
    """Names of the open answer that the closed one, taken as its context, doesn't have."""
    e = table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("open_source_response").alias("a"), F.max("closed_source_response").alias("c"))
    r = e.select("question_id", un.unsupported("a", "c").alias("u")).select("question_id", "u.*")
    return r.withColumn("level", un.downgraded(F.lit("HIGH"), F.col("risk")))


@query(
    r"""WITH e AS (SELECT question_id, coalesce(max(open_source_response), '') AS a FROM evaluation_result GROUP BY 1),
 m AS (SELECT question_id, regexp_extract_all(a, '(?m)^\s*\d+\.\s*(.+)$', 1) AS items, list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM e)
 SELECT question_id, trim(x, ' ') AS item FROM (SELECT question_id, unnest(CASE WHEN len(items) > 0 THEN items ELSE lines END) AS x FROM m)"""
)
def f_numbered_items(spark, folder):
    """Items of the numbered lists in open answers, the lines of answers without one."""
    e = table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("open_source_response").alias("a"))
    return e.select("question_id", F.explode(un.numbered_list("a")).alias("item")).select("question_id", F.trim("item").alias("item"))


def _ngram_sql(name: str, words: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - {n - 1} + 1, 1)), lambda i: list_aggregate({words}[i:i+{n - 1}], 'string_agg', ' '))) AS {name}"


PAIR = f"""e AS (SELECT question_id, max(closed_source_response) AS r, max(open_source_response) AS c FROM evaluation_result GROUP BY 1),
 w AS (SELECT question_id, coalesce(regexp_extract_all(lower(r), '{WORD}'), []) AS r, coalesce(regexp_extract_all(lower(c), '{WORD}'), []) AS c FROM e)"""


def answer_pairs(spark, folder):
    return table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("closed_source_response").alias("r"), F.max("open_source_response").alias("c"))


@query(
    f"""WITH {PAIR}, g AS (SELECT question_id, len(r) AS lr, len(c) AS lc, {_ngram_sql('r1', 'r', 1)}, {_ngram_sql('c1', 'c', 1)}, {_ngram_sql('r2', 'r', 2)}, {_ngram_sql('c2', 'c', 2)} FROM w),
 h AS (SELECT *, len(list_intersect(r1, c1)) AS b1, len(list_intersect(r2, c2)) AS b2, CASE WHEN lr = 0 THEN 0 ELSE least(1.0, lc::DOUBLE / lr) END AS bp FROM g),
 p AS (SELECT *, CASE WHEN len(c1) = 0 THEN 0 ELSE b1::DOUBLE / len(c1) END AS p1, CASE WHEN len(c2) = 0 THEN 0 ELSE b2::DOUBLE / len(c2) END AS p2, CASE WHEN len(r1) = 0 THEN 0 ELSE b1::DOUBLE / len(r1) END AS q1, CASE WHEN len(r2) = 0 THEN 0 ELSE b2::DOUBLE / len(r2) END AS q2 FROM h)
 SELECT question_id, round(p1 * bp, 6) AS bleu_1, round(p2 * bp, 6) AS bleu_2, round(CASE WHEN p1 + q1 = 0 THEN 0 ELSE 2 * p1 * q1 / (p1 + q1) END, 6) AS rouge_1, round(CASE WHEN p2 + q2 = 0 THEN 0 ELSE 2 * p2 * q2 / (p2 + q2) END, 6) AS rouge_2 FROM p"""
)
def f_overlap_scores(spark, folder):
    """Open answers measured against closed ones."""
    e = answer_pairs(spark, folder).select("question_id", tx.words("r").alias("r"), tx.words("c").alias("c"))
    r, c = F.col("r"), F.col("c")
    return e.select("question_id", *[F.round(tx.bleu_overlap(r, c, n), 6).alias(f"bleu_{n}") for n in (1, 2)], *[F.round(tx.rouge_sets(r, c, n), 6).alias(f"rouge_{n}") for n in (1, 2)])


@query(
    f"""WITH {PAIR}, s AS (SELECT question_id, list_distinct(r) AS r, list_distinct(c) AS c FROM w), n AS (SELECT question_id, len(r) AS lr, len(c) AS lc, len(list_intersect(r, c)) AS b FROM s),
 x AS (SELECT question_id, CASE WHEN lr = 0 AND lc = 0 THEN 1 WHEN lr = 0 THEN 0 ELSE b::DOUBLE / lr END AS coverage, CASE WHEN lr = 0 AND lc = 0 THEN 1 WHEN lc = 0 THEN 0 ELSE b::DOUBLE / lc END AS precision FROM n)
 SELECT question_id, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(CASE WHEN coverage + precision = 0 THEN 0 ELSE 2 * coverage * precision / (coverage + precision) END, 6) AS f1 FROM x"""
)
def m_set_overlap(spark, folder):
    t = answer_pairs(spark, folder).select("question_id", tx.terms("r").alias("r"), tx.terms("c").alias("c"))
    s = t.select("question_id", tx.set_overlap(F.col("r"), F.col("c")).alias("s"))
    return s.select("question_id", *[F.round(F.col("s")[k], 6).alias(k) for k in ("coverage", "precision", "f1")])


@query()
def f_rouge_l(spark, folder):
    """Longest common subsequence of words, in Arrow batches (SQL has no such function)."""
    return answer_pairs(spark, folder).select("question_id", F.round(hooks.rouge_l("r", "c"), 6).alias("rouge_l"))


def _trigram_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - 2, 1) + 1), lambda i: substr({c}, i, 3)))"


@query(
    f"""WITH e AS (SELECT question_id, lower(coalesce(max(question), '')) AS q, lower(coalesce(max(closed_source_response), '')) AS c FROM evaluation_result GROUP BY 1),
 g AS (SELECT question_id, {_trigram_sql('q')} AS x, {_trigram_sql('c')} AS y FROM e) SELECT question_id, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS ratio FROM g"""
)
def f_similarity_ratio(spark, folder):
    """How much of its characters' trigrams a question shares with its answer."""
    e = table(spark, folder, "evaluation_result").groupBy("question_id").agg(F.max("question").alias("q"), F.max("closed_source_response").alias("c"))
    return e.select("question_id", F.round(tx.trigram_ratio(F.col("q"), F.col("c")), 6).alias("ratio"))


@query(
    f"""WITH g AS (SELECT item_id, list_distinct(coalesce(regexp_extract_all(lower(question), '{WORD}'), [])) AS w, lower(coalesce(reference_context, '')) AS t FROM golden_dataset)
 SELECT item_id, round(CASE WHEN len(w) = 0 THEN 0.5 ELSE least(greatest(len(list_filter(w, lambda x: contains(t, x)))::DOUBLE / len(w), 0.4), 0.95) END, 6) AS relevance FROM g"""
)
def f_relevance(spark, folder):
    return golden(spark, folder).select("item_id", F.round(tx.relevance("question", "reference_context"), 6).alias("relevance"))


@query(
    """SELECT chunk_id, max(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(doc, ''), '\\\\_', '_', 'g'), '__+', '_', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM combined_all_chunks GROUP BY 1"""
)
def f_clean_context(spark, folder):
    return chunks(spark, folder).groupBy("chunk_id").agg(F.max(tx.clean_context("doc")).alias("cleaned"))


@query(
    """SELECT DISTINCT chunk_id, coalesce(list_aggregate(list_filter(string_split(regexp_replace(coalesce(code_snippet, ''), '```[a-z]*', '', 'g'), chr(10)), lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '*'))[1:35], 'string_agg', chr(10)), '') AS listing FROM combined_all_chunks"""
)
def f_clean_code(spark, folder):
    return chunks(spark, folder).select("chunk_id", tx.clean_code("code_snippet").alias("listing")).distinct()


@query(
    """WITH t AS (SELECT sample_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, 1000) AS c FROM dataset), s AS (SELECT *, length(c) - strpos(reverse(c), chr(10)) AS last FROM t),
 o AS (SELECT sample_id, t, CASE WHEN length(t) // 4 > 250 THEN CASE WHEN contains(c, chr(10)) AND last > 800 THEN substr(c, 1, last) ELSE c END ELSE t END AS o FROM s)
 SELECT sample_id, (length(t) // 4)::INT AS original_tokens, (length(o) // 4)::INT AS truncated_tokens, length(t) // 4 > 250 AS was_truncated, md5(o) AS digest FROM o"""
)
def f_truncation(spark, folder):
    t = table(spark, folder, "dataset").select("sample_id", tx.truncation("text", 250).alias("x"))
    return t.select("sample_id", "x.original_tokens", "x.truncated_tokens", "x.was_truncated", F.md5("x.text").alias("digest"))


FACTS = r"""f AS (SELECT sample_id, upper(coalesce(code, '')) AS c, upper(coalesce(documentation, '')) AS d FROM dataset),
 s AS (SELECT sample_id, list_distinct(regexp_extract_all(c, '\bMETHOD\s+([A-Z0-9_~]+)', 1)) AS m, list_distinct(regexp_extract_all(c, '\b(Z[TX]_[A-Z0-9_]+)', 1)) AS t, list_distinct(regexp_extract_all(c, '\b(Z(?:CL|IF|CX)_[A-Z0-9_]+)', 1)) AS k,
  list_distinct(list_concat(regexp_extract_all(d, '(?m)^####\s+([A-Z0-9_~]+)', 1), regexp_extract_all(d, '\b((?:READ|GET|SET|CHECK|BUILD|SAVE|LOAD|POST|SEND|INIT|FILL|MAP|MERGE|SORT|SPLIT|PARSE|LOCK|COUNT)_[A-Z0-9_]+)', 1))) AS dm,
  list_distinct(regexp_extract_all(d, '\b(Z[TX]_[A-Z0-9_]+)', 1)) AS dt, list_distinct(regexp_extract_all(d, '\b(Z(?:CL|IF|CX)_[A-Z0-9_]+)', 1)) AS dk FROM f),
 n AS (SELECT sample_id, CASE WHEN len(m) = 0 THEN 1 ELSE len(list_intersect(m, dm))::DOUBLE / len(m) END AS recall, CASE WHEN len(dm) = 0 THEN 0 ELSE len(list_filter(dm, lambda x: NOT list_contains(m, x)))::DOUBLE / len(dm) END AS invented,
  CASE WHEN len(t) + len(k) = 0 THEN 1 ELSE len(list_intersect(list_distinct(list_concat(t, k)), list_concat(dt, dk)))::DOUBLE / len(list_distinct(list_concat(t, k))) END AS constructs FROM s)"""


@query(f"WITH {FACTS} SELECT sample_id, round(recall, 4) AS method_recall, round(invented, 4) AS hallucination_rate, round(constructs, 4) AS construct_recall, round((recall + constructs) / 2, 4) AS accuracy FROM n")
def d_factual_accuracy(spark, folder):
    known = table(spark, folder, "dataset").select("sample_id", dq.code_facts("code").alias("f"), dq.doc_claims("documentation").alias("c"))
    return known.select("sample_id", dq.factual_accuracy(F.col("f"), F.col("c")).alias("x")).select("sample_id", "x.*")


LEVELS = r"""l AS (SELECT sample_id, coalesce(documentation, '') AS d, list_transform(regexp_extract_all(coalesce(documentation, ''), '(?m)^(#{1,6})[ \t]', 1), lambda x: length(x)) AS v FROM dataset)"""

#: The sentences of documentation, their number of words, and those of more than three words.
CLEAR = r"""cs AS (SELECT sample_id, coalesce(documentation, '') AS d, list_filter(list_transform(regexp_split_to_array(coalesce(documentation, ''), '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS s,
  len(regexp_extract_all(coalesce(documentation, ''), '(?m)^(#{1,6})[ \t]', 1)) AS h FROM dataset),
 cm AS (SELECT *, len(list_filter(regexp_split_to_array(d, '\s+'), lambda x: x <> '')) AS n, CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda x: len(string_split(x, ' ')))) / len(s) END AS mean, list_filter(list_transform(s, lambda x: lower(x)), lambda x: len(string_split(x, ' ')) > 3) AS long FROM cs),
 clear AS (SELECT sample_id, d, h, round((CASE WHEN mean IS NULL THEN 0.7 WHEN mean BETWEEN 10 AND 20 THEN 1 WHEN mean > 25 THEN 0.6 ELSE 0.8 END + CASE WHEN h >= 3 THEN 1 ELSE 0.6 END)::DOUBLE / 2, 4) AS clarity,
  round(greatest(0, CASE WHEN n BETWEEN 200 AND 800 THEN 1 WHEN n > 1200 THEN 0.6 WHEN n < 100 THEN 0.5 ELSE 0.8 END::DOUBLE - 0.1 * (len(long) - len(list_distinct(long)))), 4) AS conciseness FROM cm)"""
USEFUL = ("example", "error", "depend", "parameter", "return", "note", "use", "when", "if ")
_WEIGHED = " + ".join(f"{name} * {weight}::DOUBLE" for name, weight in dq.WEIGHTS.items())


@query(
    f"""WITH {FACTS}, {LEVELS}, {CLEAR}, j AS (SELECT sample_id, len(list_filter(range(2, len(v) + 1), lambda i: v[i] - v[i - 1] > 1)) AS jumps FROM l),
 u AS (SELECT sample_id, d, {" + ".join(f"contains(lower(d), '{w}')::INT" for w in USEFUL)} AS hits FROM clear),
 p AS (SELECT sample_id, round((recall + constructs) / 2, 4) AS accuracy, 1 - round(invented, 4) AS hallucination, round(recall, 4) AS completeness, clarity,
  round((CASE WHEN jumps > 0 THEN 0.5 ELSE 1.0 END + CASE WHEN contains(substr(lower(clear.d), 1, 500), 'overview') THEN 1.0 ELSE 0.5 END)::DOUBLE / 2, 4) AS organization,
  CASE WHEN hits >= 6 THEN 1.0 WHEN hits >= 4 THEN 0.8 WHEN hits >= 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS usefulness,
  round(CASE WHEN len(m) = 0 THEN 1 ELSE 1 - len(list_filter(m, lambda x: NOT list_contains(dm, x)))::DOUBLE / len(m) END * CASE WHEN contains(c, 'RAISE EXCEPTION') AND NOT regexp_matches(lower(clear.d), 'error|exception|raise') THEN 0.5 ELSE 1.0 END::DOUBLE, 4) AS omissions,
  round((CASE WHEN h >= 3 THEN 1.0 ELSE 0.6 END + CASE WHEN regexp_matches(lower(clear.d), 'see |refer|therefore|because|so |which') THEN 1.0 ELSE 0.7 END)::DOUBLE / 2, 4) AS coherence, conciseness
  FROM n JOIN s USING (sample_id) JOIN f USING (sample_id) JOIN clear USING (sample_id) JOIN j USING (sample_id) JOIN u USING (sample_id))
 SELECT sample_id, {", ".join(f"round({name} * 5, 4) AS {name}" for name in dq.WEIGHTS)}, round(({_WEIGHED}) * 5 / {sum(dq.WEIGHTS.values())}::DOUBLE, 4) AS overall FROM p"""
)
def d_nine_scores(spark, folder):
    """The nine documentation scores and the overall one."""
    return dq.nine_scores(table(spark, folder, "dataset"), "sample_id", "code", "documentation")


@query(
    rf"""WITH {LEVELS}, j AS (SELECT sample_id, d, len(list_filter(range(2, len(v) + 1), lambda i: v[i] - v[i - 1] > 1)) AS jumps, ((length(d) - length(replace(d, '```', ''))) // 3) % 2 AS odd,
 regexp_matches(d, '(?m)^\s*-\s')::INT + regexp_matches(d, '(?m)^\s*\*\s')::INT + regexp_matches(d, '(?m)^\s*\+\s')::INT AS b FROM l)
 SELECT sample_id, jumps::INT AS jumps, round(1 - ((jumps > 0)::INT + odd + (b > 1)::INT) / 3, 4) AS markdown FROM j"""
)
def d_markdown(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", dq.header_jumps("documentation").cast("int").alias("jumps"), dq.markdown_score("documentation").alias("markdown"))


@query(f"WITH {CLEAR} SELECT sample_id, clarity, conciseness FROM clear")
def d_clarity(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", dq.clarity("documentation").alias("clarity"), dq.conciseness("documentation").alias("conciseness"))


@query(
    r"""SELECT sample_id, CASE WHEN regexp_matches(c, 'for testing|ltcl_|risk level') THEN 'test_class' WHEN regexp_matches(c, '\bclass\s+\w+\s+definition|\bmethod\s+\w+') THEN 'class' WHEN regexp_matches(c, '^\s*report\s|start-of-selection') THEN 'report'
 WHEN regexp_matches(c, '\bfunction\s+\w+') THEN 'function' ELSE 'unknown' END AS kind FROM (SELECT sample_id, lower(coalesce(code, '')) AS c FROM dataset)"""
)
def f_file_kind(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", dq.file_kind("code").alias("kind"))


@query("SELECT split, sample_id, '<s>[INST] ' || coalesce(instruction, '') || chr(10) || chr(10) || '```abap' || chr(10) || code || chr(10) || '```[/INST] ' || coalesce(documentation, '') || '</s>' AS prompt FROM dataset WHERE coalesce(code, '') <> ''")
def f_prompts(spark, folder):
    """Training prompts built from instruction, code and documentation."""
    d = table(spark, folder, "dataset").where("coalesce(code, '') <> ''")
    return d.select("split", "sample_id", F.format_string("<s>[INST] %s\n\n```abap\n%s\n```[/INST] %s</s>", F.coalesce("instruction", F.lit("")), "code", F.coalesce("documentation", F.lit(""))).alias("prompt"))
