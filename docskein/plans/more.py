"""Queries over filters, fan-out, parsing and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docskein.functions import cleaning as cl
from docskein.functions import text as tx
from docskein.operators import chunking as ck
from docskein.operators import evaluation as ev
from docskein.operators import retrieval as rt
from docskein.operators import understanding as un
from docskein.plans.answers import ROWS, rows
from docskein.plans.registry import query, table
from docskein.plans.retrieval import BM25, LATEST, bm25_run, bm25_sql, chunk_texts, documents, golden, top_sql

WORD = r"[\pL\pN\pM_]+"
NAME = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"


@query("SELECT item_id, question FROM golden_dataset WHERE question_type = 'Simple'")
def p_simple_questions(spark, folder):
    return table(spark, folder, "golden_dataset").where("question_type = 'Simple'").select("item_id", "question")


@query(
    f"""WITH c AS ({LATEST}), n AS (SELECT filename, count(*) FILTER (length(doc) > 200) AS n200, count(*) FILTER (length(doc) > 100) AS n100, count(*) FILTER (length(doc) > 50) AS n50 FROM c WHERE title IS NOT NULL GROUP BY 1)
 SELECT filename, CASE WHEN n200 >= 5 THEN 200 WHEN n100 >= 5 THEN 100 ELSE 50 END AS threshold, CASE WHEN n200 >= 5 THEN n200 WHEN n100 >= 5 THEN n100 ELSE n50 END AS pool FROM n"""
)
def p_quality_ladder(spark, folder):
    """The highest length threshold that leaves a file five titled chunks, found in one pass."""
    c = ev.latest(table(spark, folder, "combined_all_chunks"), "chunk_id", "ingested_at").where("title IS NOT NULL")
    n = c.groupBy("filename").agg(*[F.count(F.when(F.length("doc") > t, 1)).alias(f"n{t}") for t in (200, 100, 50)])
    rung = lambda a, b, c: F.when(F.col("n200") >= 5, a).when(F.col("n100") >= 5, b).otherwise(c)
    return n.select("filename", rung(F.lit(200), F.lit(100), F.lit(50)).alias("threshold"), rung(F.col("n200"), F.col("n100"), F.col("n50")).alias("pool"))


@query(
    "SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing, min(len(embedding)) AS least_size, max(len(embedding)) AS greatest_size, count(*) FILTER (abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) < 0.001) AS units FROM embeddings"
)
def p_vector_sanity(spark, folder):
    v = table(spark, folder, "embeddings")
    norm = rt.dot(F.col("embedding"), F.col("embedding"))
    return v.agg(
        F.count("*").alias("vectors"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("missing"), F.min(F.size("embedding")).cast("long").alias("least_size"), F.max(F.size("embedding")).cast("long").alias("greatest_size"),
        F.count(F.when(F.abs(norm - 1) < 0.001, 1)).alias("units"),
    )


@query(f"{BM25} SELECT qid, count(*) FILTER (score > 10) AS above, count(*) AS hits, max(score) AS best FROM hits GROUP BY 1")
def p_positive_hits(spark, folder):
    return bm25_run(spark, folder).groupBy("qid").agg(F.count(F.when(F.col("score") > 10, 1)).alias("above"), F.count("*").alias("hits"), F.max("score").alias("best"))


@query(
    f"""WITH {bm25_sql("SELECT doc_id, text FROM documents WHERE doc_type = 'code'", "SELECT item_id AS qid, question AS text FROM golden_dataset")}, {top_sql('scored', '5', 'hits')} SELECT * FROM hits"""
)
def r_by_collection(spark, folder):
    """Only documents of one collection, a filter that reaches the scan."""
    code = table(spark, folder, "documents").where("doc_type = 'code'").select("doc_id", "text")
    return rt.bm25_top_k(code, golden(spark, folder), 5)


PARTS = r"""parts AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS part, trim(p) AS text FROM (SELECT item_id, unnest(x) AS p, unnest(range(len(x))) AS i FROM
 (SELECT item_id, string_split(regexp_replace(regexp_replace(coalesce(question, ''), '\?\s*', '?' || chr(1), 'g'), ', and (what|how|why|when|where|which|who)', chr(1) || '\1', 'g'), chr(1)) AS x FROM golden_dataset)) WHERE trim(p) <> '')"""


@query(
    f"""WITH {PARTS}, {bm25_sql('SELECT doc_id, text FROM documents', "SELECT item_id || ':' || part AS qid, text FROM parts")}, {top_sql('scored', '2', 'hits')},
 b AS (SELECT split_part(qid, ':', 1)::BIGINT AS item_id, doc_id, max(score) AS score FROM hits GROUP BY 1, 2) SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS place FROM b"""
)
def r_sub_query_fanout(spark, folder):
    """Each part of a question is a query of its own; a document counts with its best part."""
    parts = table(spark, folder, "golden_dataset").select("item_id", F.posexplode(un.sub_questions("question")).alias("part", "text"))
    hits = rt.bm25_top_k(documents(spark, folder), parts.select(F.concat_ws(":", "item_id", "part").alias("qid"), "text"), 2)
    best = hits.groupBy(F.split("qid", ":")[0].cast("long").alias("item_id"), "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))


@query(f"{BM25} SELECT qid, max(rank)::INT AS k FROM hits WHERE score >= 8 GROUP BY 1")
def r_widening(spark, folder):
    """How far down hits are good enough: what retries with a growing k would find, from one retrieval."""
    return bm25_run(spark, folder).where("score >= 8").groupBy("qid").agg(F.max("rank").alias("k"))


@query(
    f"""{BM25}, n AS (SELECT h.*, len(list_intersect(regexp_extract_all(coalesce(g.question, ''), '{NAME}'), regexp_extract_all(coalesce(d.text, ''), '{NAME}'))) > 0 AS same FROM hits h JOIN golden_dataset g ON item_id = qid JOIN documents d USING (doc_id))
 SELECT qid, doc_id, rank, same, row_number() OVER (PARTITION BY qid ORDER BY same DESC, rank)::INT AS place FROM n"""
)
def r_priority_order(spark, folder):
    """Hits that mention an identifier of the question first, else in their order."""
    hits = bm25_run(spark, folder).join(documents(spark, folder), "doc_id").join(golden(spark, folder).withColumnRenamed("text", "question"), "qid")
    same = hits.withColumn("same", F.size(F.array_intersect(tx.identifiers("question"), tx.identifiers("text"))) > 0)
    return same.select("qid", "doc_id", "rank", "same", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("same").desc(), "rank")).alias("place"))


@query(
    """WITH a AS (SELECT item_id, question, row_number() OVER (PARTITION BY question_type ORDER BY item_id) AS i, question_type FROM golden_dataset WHERE item_id % 2 = 0),
 b AS (SELECT item_id, row_number() OVER (PARTITION BY question_type ORDER BY item_id) AS i, question_type FROM golden_dataset WHERE item_id % 2 = 1) SELECT a.item_id AS left_id, b.item_id AS right_id, a.i::INT AS position FROM a JOIN b ON a.i = b.i AND a.question_type = b.question_type"""
)
def j_positional(spark, folder):
    """Two lists joined by their position in each question type."""
    g = table(spark, folder, "golden_dataset").select("item_id", "question_type", F.row_number().over(Window.partitionBy("question_type", F.col("item_id") % 2).orderBy("item_id")).alias("position"))
    a, b = (g.where(F.col("item_id") % 2 == m).withColumnRenamed("item_id", n) for m, n in ((0, "left_id"), (1, "right_id")))
    return a.join(b, ["question_type", "position"]).select("left_id", "right_id", "position")


@query("SELECT item_id, t AS temperature, k FROM golden_dataset, (SELECT unnest([0.0, 0.3, 0.7])::DOUBLE AS t), (SELECT unnest([5, 10])::INT AS k)")
def j_parameters(spark, folder):
    """Every question with every setting, by exploding the settings."""
    g = table(spark, folder, "golden_dataset").select("item_id", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.7))).alias("temperature"))
    return g.select("item_id", "temperature", F.explode(F.array(F.lit(5), F.lit(10))).alias("k"))


@query(
    f"""WITH c AS ({LATEST}), n AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(doc, '{NAME}')) AS name FROM c),
 t AS (SELECT name, count(*) AS mentions, min(chunk_id) AS first_chunk FROM n GROUP BY 1) SELECT * FROM t WHERE mentions > 1"""
)
def j_entity_lookup(spark, folder):
    """Names that several chunks mention, with the first of these."""
    n = chunk_texts(spark, folder).select("doc_id", F.explode(tx.identifiers("text")).alias("name"))
    return n.groupBy("name").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first_chunk")).where("mentions > 1")


@query(f"WITH c AS ({LATEST}) SELECT filename, title, count(*) AS chunks, min(chunk_id) AS first_chunk FROM c WHERE title IS NOT NULL GROUP BY 1, 2")
def g_grouped_titles(spark, folder):
    """The distinct titles of each file, a row each."""
    return chunk_texts(spark, folder).where("title IS NOT NULL").groupBy("filename", "title").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_chunk"))


@query(
    """WITH n AS (SELECT coalesce(question_type, 'unknown') AS t, count(*) AS n FROM golden_dataset GROUP BY 1), k AS (SELECT unnest([3, 5, 10, 50])::INT AS each)
 SELECT each, sum(least(n, each))::BIGINT AS total, count(*) FILTER (n < each) AS short FROM n, k GROUP BY 1"""
)
def g_balance_ladder(spark, folder):
    """How large balanced samples of several sizes would be."""
    n = table(spark, folder, "golden_dataset").groupBy(F.coalesce("question_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"))
    each = n.select("n", F.explode(F.array(*map(F.lit, (3, 5, 10, 50)))).alias("each"))
    return each.groupBy("each").agg(F.sum(F.least("n", "each")).alias("total"), F.count(F.when(F.col("n") < F.col("each"), 1)).alias("short"))


@query(
    f"""WITH {ROWS} SELECT lower(trim(judge_model)) AS judge, count(*) AS calls, count(*) FILTER (actual_winner IS NOT NULL) AS decided, count(*) FILTER (regexp_replace(coalesce(judge_choice, ''), '\\s+', '', 'g') = '') AS empty,
 round(avg(date_diff('millisecond', judged_at, loaded_at) / 1000.0::DOUBLE) FILTER (loaded_at > judged_at), 3) AS mean_delay FROM e GROUP BY 1"""
)
def g_run_report(spark, folder):
    """Calls of each judge, what came of them, and the mean delay of late deliveries."""
    delay = (F.unix_millis(F.col("loaded_at").cast("timestamp")) - F.unix_millis(F.col("judged_at").cast("timestamp"))) / 1000.0
    return rows(spark, folder).groupBy(F.lower(F.trim("judge_model")).alias("judge")).agg(
        F.count("*").alias("calls"), F.count("actual_winner").alias("decided"), F.count(F.when(tx.blank("judge_choice"), 1)).alias("empty"), F.round(F.avg(F.when(F.col("loaded_at") > F.col("judged_at"), delay)), 3).alias("mean_delay")
    )


@query(
    f"""WITH c AS ({LATEST}), w AS (SELECT chunk_id, trim(split_part(title, ' ', 1)) AS topic FROM c WHERE title IS NOT NULL), t AS (SELECT list(topic ORDER BY n DESC, topic)[1:3] AS top FROM (SELECT topic, count(*) AS n FROM w WHERE topic <> '' GROUP BY 1))
 SELECT chunk_id, CASE WHEN list_contains(top, topic) THEN topic ELSE top[(('0x' || substr(md5(chunk_id), 1, 6))::INT % len(top) + 1)::INT] END AS assigned FROM w, t"""
)
def g_topic_assignment(spark, folder):
    """Each chunk's own topic if it is among the three most frequent, else one of these by hash."""
    w = chunk_texts(spark, folder).where("title IS NOT NULL").select("doc_id", F.trim(F.split_part("title", F.lit(" "), F.lit(1))).alias("topic"))
    top = w.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(3)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic"))), lambda x: x["topic"]).alias("top"))
    place = F.conv(F.substring(F.md5("doc_id"), 1, 6), 16, 10).cast("int") % F.size("top") + 1
    return w.join(F.broadcast(listed)).select(F.col("doc_id").alias("chunk_id"), F.when(F.array_contains("top", F.col("topic")), F.col("topic")).otherwise(F.element_at("top", place)).alias("assigned"))


@query(f"WITH c AS ({LATEST}) SELECT instance_id, count(*) AS chunks, count(DISTINCT filename) AS files, sum(coalesce(length, 0))::BIGINT AS chars, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM c GROUP BY 1")
def a_progress(spark, folder):
    """What each instance has done so far."""
    c = ev.latest(table(spark, folder, "combined_all_chunks"), "chunk_id", "ingested_at")
    each = c.groupBy("instance_id").agg(F.count("*").alias("chunks"), F.count_distinct("filename").alias("files"), F.sum(F.coalesce("length", F.lit(0))).alias("chars"))
    total = each.agg(F.sum("chunks").alias("all"))
    return each.join(F.broadcast(total)).select("instance_id", "chunks", "files", "chars", F.round(100.0 * F.col("chunks") / F.col("all"), 2).alias("percent"))


@query()
def a_context_chunks(spark, folder):
    """Golden contexts cut for evaluation: whole paragraphs up to 2000 characters; simple questions get 1500 of whole sentences."""
    g = table(spark, folder, "golden_dataset")
    sentences = F.split(F.coalesce("reference_context", F.lit("")), r"(?<=[.!?])\s+")
    cut = F.when(F.col("question_type") == "Simple", ck.greedy_merge(sentences, 1500)).otherwise(ck.pack_paragraphs("reference_context", 2000, 0))
    return g.select("item_id", F.posexplode(F.filter(cut, lambda x: x != "")).alias("part", "text"))


@query(
    r"""WITH t AS (SELECT item_id, trim(coalesce(question, '')) AS q FROM golden_dataset), r AS (SELECT item_id, regexp_replace(regexp_replace(q, '^(?:(?:Simple|Complex|Situational|Double|Distracting|Conversational) )?Question:\s*|^Q:\s*|^\d+\.\s+', ''), '\s*\([^)]*\)', '', 'g') AS q FROM t)
 SELECT item_id, trim(regexp_replace(CASE WHEN strpos(q, '?') > 0 THEN substr(q, 1, strpos(q, '?')) ELSE q END, '\s+', ' ', 'g')) AS question FROM r"""
)
def f_question_cleanup(spark, folder):
    return table(spark, folder, "golden_dataset").select("item_id", cl.question("question").alias("question"))


@query(
    r"""SELECT sample_id, md5(trim(regexp_replace(coalesce(text, ''), '</?s>|\[/?INST\]|<\|[a-z_]+\|>', '', 'g'), ' ')) AS minimal,
 md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '</?s>|\[/?INST\]|<\|[a-z_]+\|>', '', 'g'), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ')) AS basic FROM dataset"""
)
def f_response_clean(spark, folder):
    d = table(spark, folder, "dataset")
    return d.select("sample_id", F.md5(cl.response("text", "minimal")).alias("minimal"), F.md5(cl.response("text")).alias("basic"))


@query(
    """SELECT sample_id, greatest(length(coalesce(text, '')) // 4, 500)::INT AS prompt_tokens, greatest(length(coalesce(documentation, '')) // 4, 100)::INT AS answer_tokens FROM dataset"""
)
def f_token_estimate(spark, folder):
    return table(spark, folder, "dataset").select("sample_id", cl.token_estimate("text", 500).alias("prompt_tokens"), cl.token_estimate("documentation", 100).alias("answer_tokens"))


@query(r"""SELECT sample_id, regexp_extract_all(coalesce(code, ''), '\b(?:zcl|zif|zcx)_[a-z0-9_]+') AS names, regexp_extract(coalesce(documentation, ''), '\b(Z[TX]_[A-Z0-9_]+)', 1) AS first_table FROM dataset""")
def f_entities(spark, folder):
    """Classes and interfaces of code in order, and the first table its documentation names."""
    return table(spark, folder, "dataset").select(
        "sample_id", F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"(\b(?:zcl|zif|zcx)_[a-z0-9_]+)"), F.lit(1)).alias("names"), F.regexp_extract(F.coalesce("documentation", F.lit("")), r"\b(Z[TX]_[A-Z0-9_]+)", 1).alias("first_table")
    )


@query()
def f_bullet_tables(spark, folder):
    """Tables and bullet lists inside the documentation of records."""
    return table(spark, folder, "dataset").select("sample_id", F.posexplode(cl.tables("documentation")).alias("place", "block"))


@query()
def f_context_tiers(spark, folder):
    """Chunks found for golden questions ordered by how well they serve a simple question, the best five, with their relevant lines."""
    docs = chunk_texts(spark, folder)
    hits = rt.bm25_top_k(docs, golden(spark, folder), 10).join(docs.select("doc_id", "text"), "doc_id").join(golden(spark, folder).withColumnRenamed("text", "question"), "qid")
    tiers = hits.withColumn("tier", F.round(cl.tier(F.col("question"), F.col("text")), 4))
    order = Window.partitionBy("qid").orderBy(F.col("tier").desc(), "rank")
    return tiers.withColumn("place", F.row_number().over(order)).where("place <= 5").select("qid", "doc_id", "tier", "place", cl.relevant_lines(F.col("question"), F.col("text")).alias("lines"))


@query(
    f"""WITH {ROWS}, s AS (SELECT question_id, lower(trim(judge_model)) AS judge, coalesce(question_type, 'unknown') AS t, confidence FROM e WHERE confidence IS NOT NULL),
 f AS (SELECT *, confidence >= CASE t WHEN 'Simple' THEN 0.6 WHEN 'Complex' THEN 0.75 ELSE 0.7 END AS ok, max(confidence) OVER (PARTITION BY question_id) AS best FROM s)
 SELECT question_id, t AS question_type, count(*) FILTER (ok) AS passed, CASE WHEN bool_or(ok) THEN 'threshold' ELSE 'best' END AS kept_by, max(best) AS best FROM f GROUP BY 1, 2"""
)
def f_threshold_filter(spark, folder):
    """Judgements over a threshold that depends on the question's type; the best one where none passes."""
    s = rows(spark, folder).where("confidence IS NOT NULL").withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    ok = F.col("confidence") >= F.when(F.col("question_type") == "Simple", 0.6).when(F.col("question_type") == "Complex", 0.75).otherwise(0.7)
    best = F.max("confidence").over(Window.partitionBy("question_id"))
    return s.withColumn("ok", ok).withColumn("best", best).groupBy("question_id", "question_type").agg(F.count(F.when(F.col("ok"), 1)).alias("passed"), F.when(F.bool_or("ok"), "threshold").otherwise("best").alias("kept_by"), F.max("best").alias("best"))


@query(
    """SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS items, count(*) FILTER (coalesce(reference_context, '') <> '') AS with_context, count(*) FILTER (len(conversation_history) > 0) AS with_history, count(*) >= 60 AS enough FROM golden_dataset GROUP BY 1"""
)
def g_golden_counts(spark, folder):
    """Items of each type, what they have, and whether there are enough."""
    g = table(spark, folder, "golden_dataset")
    return g.groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(
        F.count("*").alias("items"), F.count(F.when(F.coalesce("reference_context", F.lit("")) != "", 1)).alias("with_context"), F.count(F.when(F.size("conversation_history") > 0, 1)).alias("with_history"), (F.count("*") >= 60).alias("enough")
    )


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40")
def g_paging(spark, folder):
    """The third page of the slowest calls."""
    return table(spark, folder, "events").orderBy(F.col("value").desc(), "event_id").select("event_id", "event_type", "value").offset(40).limit(20)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def g_rollup_orders(spark, folder):
    """Subtotals at size, as in the reports that fold several levels into one."""
    o = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("price").cast("double"), 2).alias("total"))
