"""Retrieval queries: golden questions over documents and chunks, vectors over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.operators import evaluation as ev
from docskein.operators import irmetrics as ir
from docskein.operators import retrieval as rt
from docskein.plans.registry import query, table
from docskein.session import stage

WORD = r"[\pL\pN\pM_]+"
#: An identifier in DuckDB's spelling.
NAME = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"


def bm25_sql(docs: str, queries: str, name: str = "scored") -> str:
    return f"""
 {name}_d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '{WORD}'), []) AS w FROM ({docs})),
 {name}_s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM {name}_d),
 {name}_q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM ({queries})),
 {name}_t AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM {name}_d),
 {name}_p AS (SELECT term, doc_id, l, count(*) AS tf FROM {name}_t WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
 {name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
 {name} AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))), 6) AS score
   FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term), {name}_s GROUP BY 1, 2)"""


def top_sql(source: str, k: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM {source}) WHERE rank <= {k})"


DOCS = "SELECT doc_id, text FROM documents"
QUESTIONS = "SELECT item_id AS qid, question AS text FROM golden_dataset"
BM25 = f"WITH {bm25_sql(DOCS, QUESTIONS)}, {top_sql('scored', '10', 'hits')}"
#: Vectors stand for the documents and golden items of the same id.
DENSE = "v AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN golden_dataset ON q.vec_id = item_id, embeddings d)"
TWO = f"WITH {DENSE}, {top_sql('v', '20', 'ra')}, {bm25_sql(DOCS, QUESTIONS, 'b')}, {top_sql('b', '20', 'rb')}"
#: A document is relevant for a golden item whose identifiers it has.
QRELS = f"""qrels AS (SELECT DISTINCT qid, doc_id, 1 AS rel FROM (SELECT item_id AS qid, unnest(regexp_extract_all(question, '{NAME}')) AS name FROM golden_dataset)
   JOIN (SELECT doc_id, unnest(regexp_extract_all(text, '{NAME}')) AS name FROM documents) USING (name))"""


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def golden(spark, folder, column="question"):
    return table(spark, folder, "golden_dataset").select(F.col("item_id").alias("qid"), F.col(column).alias("text"))


def bm25_run(spark, folder, k=10, column="question"):
    return rt.bm25_top_k(documents(spark, folder), golden(spark, folder, column), k)


def qrels(spark, folder):
    """Golden items and the documents that share an identifier with their question."""
    asked = table(spark, folder, "golden_dataset").select(F.col("item_id").alias("qid"), F.explode(tx.identifiers("question")).alias("name"))
    held = documents(spark, folder).select("doc_id", F.explode(tx.identifiers("text")).alias("name"))
    return asked.join(held, "name").select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))


def chunk_texts(spark, folder):
    rows = ev.latest(table(spark, folder, "combined_all_chunks"), "chunk_id", "ingested_at")
    return rows.select(F.col("chunk_id").alias("doc_id"), F.col("doc").alias("text"), "title", "filename", "code_snippet")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def asked_vectors(spark, folder):
    return vectors(spark, folder).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "vec")


@query(f"{BM25} SELECT qid, doc_id, score, rank FROM hits")
def r_bm25_top10(spark, folder):
    return bm25_run(spark, folder)


@query(
    f"""{BM25}, {QRELS},
 need AS (SELECT qid, count(*) AS total, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS i FROM qrels) GROUP BY 1),
 got AS (SELECT qid, count(*) AS h, max(1.0::DOUBLE / rank) AS m, sum(1 / log2(rank + 1)) AS dcg FROM hits JOIN qrels USING (qid, doc_id) GROUP BY 1)
 SELECT 'bm25' AS run, qid, round(coalesce(h, 0) / 10, 6) AS precision, round(coalesce(h, 0) / total, 6) AS recall, round(coalesce(m, 0), 6) AS mrr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM need LEFT JOIN got USING (qid)"""
)
def m_metrics(spark, folder):
    runs = bm25_run(spark, folder).withColumn("run", F.lit("bm25"))
    return ir.metrics_at(runs, qrels(spark, folder)).select("run", "qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def dense_run(spark, folder, k=20):
    """Vectors of the golden items' ids against all vectors."""
    asked = golden(spark, folder).select("qid").join(vectors(spark, folder).select(F.col("doc_id").alias("qid"), "vec"), "qid")
    return rt.dense_hits(vectors(spark, folder), asked, k)


def two_runs(spark, folder):
    """A dense and a sparse run over the same ids, each written once."""
    return stage(dense_run(spark, folder), "dense"), stage(bm25_run(spark, folder, 20), "sparse")


def _runs(spark, folder):
    dense, sparse = two_runs(spark, folder)
    fused = rt.reciprocal_rank_fusion([dense, sparse], 10)
    return dense.withColumn("run", F.lit("dense")).unionByName(sparse.withColumn("run", F.lit("bm25"))).unionByName(fused.withColumn("run", F.lit("rrf")))


COMPARED = f"""{TWO}, {QRELS},
 fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY 1, 2), {top_sql('fused', '10', 'rf')},
 runs AS (SELECT 'dense' AS run, * FROM ra UNION ALL SELECT 'bm25', * FROM rb UNION ALL SELECT 'rrf', * FROM rf),
 need AS (SELECT qid, count(*) AS total, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS i FROM qrels) GROUP BY 1),
 got AS (SELECT run, qid, count(*) AS h, max(1.0::DOUBLE / rank) AS m, sum(1 / log2(rank + 1)) AS dcg FROM runs JOIN qrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY 1, 2),
 each AS (SELECT r.run, coalesce(h, 0) / 10 AS p, coalesce(h, 0) / total AS r, coalesce(m, 0) AS m, coalesce(dcg, 0) / idcg AS g FROM (SELECT DISTINCT run FROM runs) r CROSS JOIN need LEFT JOIN got ON got.run = r.run AND got.qid = need.qid),
 means AS (SELECT run, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(m), 6) AS mrr, round(avg(g), 6) AS ndcg, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM each GROUP BY 1),
 table_ AS (SELECT *, round(0.25 * (precision + recall + mrr + ndcg), 6) AS overall FROM means)"""


@query(f"{COMPARED} SELECT *, rank() OVER (ORDER BY overall DESC, run)::INT AS place, CASE WHEN run = 'rrf' THEN 'fusion' WHEN run = 'bm25' THEN 'sparse' ELSE 'dense' END AS category FROM table_")
def m_compare_runs(spark, folder):
    table_ = ir.compare_runs(ir.metrics_at(_runs(spark, folder), qrels(spark, folder)))
    return table_.withColumn("category", ir.run_category(F.col("run")))


@query(f"{COMPARED} SELECT run, metric, value FROM (UNPIVOT table_ ON precision, recall, mrr, ndcg INTO NAME metric VALUE value)")
def g_unpivot_metrics(spark, folder):
    return ir.unpivot_metrics(ir.compare_runs(ir.metrics_at(_runs(spark, folder), qrels(spark, folder))), ["precision", "recall", "mrr", "ndcg"])


@query(f"{TWO}, fused AS (SELECT qid, doc_id, round(coalesce(ra.score, 0) * 0.4::DOUBLE + coalesce(rb.score, 0) * 0.6::DOUBLE, 6) AS score FROM ra FULL JOIN rb USING (qid, doc_id)), {top_sql('fused', '10', 'h')} SELECT * FROM h")
def r_linear_fusion(spark, folder):
    return rt.linear_fusion(*two_runs(spark, folder), 10)


@query(f"{TWO}, fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY 1, 2), {top_sql('fused', '10', 'h')} SELECT * FROM h")
def r_rank_fusion(spark, folder):
    return rt.reciprocal_rank_fusion(list(two_runs(spark, folder)), 10)


@query(
    f"""{TWO}, sp AS (SELECT rb.* FROM rb JOIN golden_dataset ON qid = item_id WHERE question_type = 'Simple'),
 fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM ra WHERE qid IN (SELECT qid FROM sp) UNION ALL SELECT * FROM sp) GROUP BY 1, 2), {top_sql('fused', '10', 'h')}
 SELECT * FROM h UNION ALL SELECT * FROM ra WHERE rank <= 10 AND qid NOT IN (SELECT qid FROM sp)"""
)
def r_hybrid_fallback(spark, folder):
    """Only simple questions have sparse hits here; the others fall back to their dense ones."""
    simple = table(spark, folder, "golden_dataset").where("question_type = 'Simple'").select(F.col("item_id").alias("qid"))
    dense, sparse = two_runs(spark, folder)
    return rt.hybrid(dense, sparse.join(simple, "qid"), 10)


LATE = """l AS (SELECT qid, doc_id, round(sum(best), 6) AS score FROM (SELECT q.item_id AS qid, q.tok, d.vec_id // 4 AS doc_id, max(list_cosine_similarity(q.vec, d.embedding::DOUBLE[])) AS best
   FROM (SELECT item_id, t AS tok, e.embedding::DOUBLE[] AS vec FROM golden_dataset, (SELECT unnest([0, 1, 2])::INT AS t), embeddings e WHERE e.vec_id = item_id + t) q, embeddings d GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(
    f"""{TWO}, {LATE}, {top_sql('l', '20', 'rl')},
 fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rl) GROUP BY 1, 2), {top_sql('fused', '10', 'h')} SELECT * FROM h"""
)
def r_three_way_fusion(spark, folder):
    """Reciprocal ranks over a dense, a sparse and a late-interaction run; four vectors are the tokens of a document, three those of a query."""
    dense, sparse = two_runs(spark, folder)
    vecs = vectors(spark, folder).select("doc_id", "vec")
    asked = golden(spark, folder).select("qid", F.explode(F.array(*map(F.lit, range(3)))).alias("tok")).withColumn("doc_id", F.col("qid") + F.col("tok")).join(vecs, "doc_id").select("qid", "tok", "vec")
    late = rt.top_k(rt.max_sim(vecs.select(F.floor(F.col("doc_id") / 4).alias("doc_id"), "vec"), asked), 20)
    return rt.reciprocal_rank_fusion([dense, sparse, late], 10)


@query(
    f"""WITH p AS (SELECT item_id * 3 + i AS qid, item_id, name, text || ' ' || coalesce(question, '') AS text FROM golden_dataset, (SELECT * FROM (VALUES (0, 'plain', ''), (1, 'table', 'which table and field'), (2, 'call', 'which method is called')) t(i, name, text))),
 {bm25_sql(DOCS, 'SELECT qid, text FROM p')}, {top_sql('scored', '10', 'hits')}, {QRELS},
 m AS (SELECT name, p.item_id, count(r.doc_id) AS h FROM p LEFT JOIN hits USING (qid) LEFT JOIN qrels r ON r.qid = p.item_id AND r.doc_id = hits.doc_id GROUP BY 1, 2)
 SELECT name AS run, count(*) AS queries, round(avg(h / 10.0::DOUBLE), 6) AS precision FROM m WHERE item_id IN (SELECT qid FROM qrels) GROUP BY 1"""
)
def r_prompt_variants(spark, folder):
    """The same questions under several instructions, each a run of its own with its precision."""
    prompts = spark.createDataFrame([(0, "plain", ""), (1, "table", "which table and field"), (2, "call", "which method is called")], "i int, run string, instruction string")
    asked = golden(spark, folder).crossJoin(F.broadcast(prompts)).select(F.struct("run", "qid").alias("key"), F.concat("instruction", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    hits = rt.bm25_top_k(documents(spark, folder), asked.select(F.concat_ws(":", "key.run", "key.qid").alias("qid"), "text"), 10)
    rel = stage(qrels(spark, folder), "qrels")
    met = hits.select(F.split("qid", ":")[0].alias("run"), F.split("qid", ":")[1].cast("long").alias("qid"), "doc_id").join(rel, ["qid", "doc_id"]).groupBy("run", "qid").agg(F.count("*").alias("h"))
    judged = asked.select("key.run", "key.qid").join(rel.select("qid").distinct(), "qid", "left_semi")
    return judged.join(met, ["run", "qid"], "left").groupBy("run").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("h", F.lit(0)) / 10.0), 6).alias("precision"))


@query(
    f"""WITH scored AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
   FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings d), {top_sql('scored', '10', 'h')} SELECT * FROM h"""
)
def r_dense_top10(spark, folder):
    return rt.dense_hits(vectors(spark, folder), asked_vectors(spark, folder), 10)


@query(
    """WITH best AS (SELECT q.vec_id // 1000 AS qid, q.vec_id AS tok, d.label AS doc_id, max(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[])) AS best
   FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings d GROUP BY 1, 2, 3) SELECT qid, doc_id, round(sum(best), 6) AS score FROM best GROUP BY 1, 2"""
)
def r_max_sim(spark, folder):
    """Vectors of one label as the tokens of a document, asked vectors of one thousand as those of a query."""
    asked = asked_vectors(spark, folder).select(F.floor(F.col("qid") / 1000).alias("qid"), F.col("qid").alias("tok"), "vec")
    return rt.max_sim(vectors(spark, folder).select(F.col("label").alias("doc_id"), "vec"), asked)


@query(
    """WITH u AS (SELECT unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
 s AS (SELECT pos, sum(x) AS s, count(*) AS n FROM u GROUP BY 1) SELECT max(n) AS vectors, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s"""
)
def r_average_similarity(spark, folder):
    return rt.average_similarity(vectors(spark, folder))


@query(
    """SELECT item_id, CASE WHEN contains(q, 'method') OR contains(q, 'function') THEN 30 WHEN contains(q, 'interface') OR contains(q, 'zif_') THEN 20 WHEN contains(q, 'structure') OR contains(q, 'table') THEN 15 ELSE 10 END AS closed_limit,
 CASE WHEN contains(q, 'parameter') OR contains(q, 'specific') THEN 35 WHEN contains(q, 'situation') OR contains(q, 'scenario') OR contains(q, 'complex') THEN 45 WHEN contains(q, 'difference') OR contains(q, 'compare') OR contains(q, 'implement') THEN 30 ELSE 25 END AS open_limit
 FROM (SELECT item_id, lower(coalesce(question, '')) AS q FROM golden_dataset)"""
)
def r_limits(spark, folder):
    return table(spark, folder, "golden_dataset").select("item_id", rt.retrieval_limit("question", 5).alias("closed_limit"), rt.retrieval_limit("question", 5, "open").alias("open_limit"))


@query(
    f"""WITH {bm25_sql(DOCS, QUESTIONS)}, lim AS (SELECT item_id AS qid, CASE WHEN contains(q, 'method') OR contains(q, 'function') THEN 30 WHEN contains(q, 'interface') OR contains(q, 'zif_') THEN 20 WHEN contains(q, 'structure') OR contains(q, 'table') THEN 15 ELSE 10 END AS k FROM (SELECT item_id, lower(coalesce(question, '')) AS q FROM golden_dataset)),
 r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM scored) SELECT r.* FROM r JOIN lim USING (qid) WHERE rank <= k"""
)
def r_limit_by_question(spark, folder):
    """As many hits as each question's kind asks for."""
    limits = table(spark, folder, "golden_dataset").select(F.col("item_id").alias("qid"), rt.retrieval_limit("question", 5).alias("k"))
    return rt.bm25_top_k(documents(spark, folder), golden(spark, folder), 30).join(limits, "qid").where("rank <= k").drop("k")


@query(
    f"""WITH {bm25_sql(DOCS, QUESTIONS)}, {top_sql('scored', '20', 'first')},
 t AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '{WORD}')) AS w FROM golden_dataset),
 again AS (SELECT qid, doc_id, round(CASE WHEN len(w) = 0 THEN 0.5 ELSE least(greatest(len(list_filter(w, lambda x: contains(lower(coalesce(text, '')), x)))::DOUBLE / len(w), 0.4), 0.95) END, 6) AS score FROM first JOIN t USING (qid) JOIN documents USING (doc_id)),
 {top_sql('again', '5', 'h')} SELECT * FROM h"""
)
def r_rerank(spark, folder):
    """The first hits ordered again by the share of question words they contain (the scorer that needs no model)."""
    hits = bm25_run(spark, folder, 20).join(documents(spark, folder), "doc_id").join(golden(spark, folder).withColumnRenamed("text", "question"), "qid")
    return rt.rerank(hits, tx.relevance("question", "text"), 5, 20).select("qid", "doc_id", "score", "rank")


@query(f"{BM25}, good AS (SELECT qid, doc_id, score FROM hits WHERE score >= 12), {top_sql('good', '8', 'h')} SELECT * FROM h")
def r_relevant_hits(spark, folder):
    return rt.relevant_hits(bm25_run(spark, folder), 12.0, 8)


@query(
    f"""{BM25}, s AS (SELECT qid, avg(abs(score)) AS m, count(*) AS n, max(abs(score)) AS top FROM hits GROUP BY 1),
 b AS (SELECT item_id AS qid, len(list_filter(regexp_split_to_array(coalesce(question, ''), '\\s+'), lambda x: x <> '')) AS n_words FROM golden_dataset),
 v AS (SELECT qid, n, top, round(0.4 * m + 0.3 * least(1.0, n / 3.0) + 0.3 * (CASE WHEN n_words = 0 THEN 1.0 ELSE least(1.0, greatest(0.3, 15.0::DOUBLE / n_words)) END), 6) AS c FROM b LEFT JOIN s USING (qid))
 SELECT qid, coalesce(c, 0)::DOUBLE AS confidence, CASE WHEN n IS NULL THEN 'LOW' WHEN c >= 0.48 AND top >= 0.5 THEN 'HIGH' WHEN c >= 0.21 AND top >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM v"""
)
def r_confidence(spark, folder):
    return rt.retrieval_confidence(bm25_run(spark, folder), golden(spark, folder))


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn_ FROM combined_all_chunks) WHERE rn_ = 1"
CONTEXTS = f"""WITH c AS ({LATEST}), {bm25_sql('SELECT chunk_id AS doc_id, doc AS text FROM c', QUESTIONS)}, {top_sql('scored', '6', 'hits')},
 ctx AS (SELECT qid, rank, doc_id, score, coalesce(title, '') AS title, coalesce(filename, '') AS filename, score >= 0.1 AS relevant, regexp_replace(coalesce(code_snippet, ''), '\\s+', '', 'g') <> '' AS has_code, coalesce(length(doc), 0) AS content_length FROM hits JOIN c ON doc_id = chunk_id)"""


@query(f"{CONTEXTS} SELECT *, CASE WHEN has_code THEN 'code' ELSE 'documentation' END AS source_type FROM ctx")
def r_contexts(spark, folder):
    docs = chunk_texts(spark, folder)
    return rt.contexts(rt.bm25_top_k(docs, golden(spark, folder), 6), docs)


@query(
    f"""{CONTEXTS} SELECT qid, string_agg(printf('[Document %d: %s (Score: %.4f)]', rank, title, floor(score * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE), chr(10) ORDER BY rank) AS context,
 list_aggregate((SELECT list(f ORDER BY r) FROM (SELECT filename AS f, min(rank) AS r FROM ctx x WHERE x.qid = ctx.qid AND filename <> '' GROUP BY 1)), 'string_agg', ', ') AS files FROM ctx GROUP BY qid"""
)
def r_context_string(spark, folder):
    docs = chunk_texts(spark, folder)
    return rt.context_string(rt.contexts(rt.bm25_top_k(docs, golden(spark, folder), 6), docs))


@query(
    """WITH l AS (SELECT question_id AS qid, CASE WHEN confidence > 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM evaluation_result WHERE confidence IS NOT NULL)
 SELECT qid, CASE WHEN bool_and(level = 'HIGH') THEN 'HIGH' WHEN bool_or(level = 'HIGH') AND NOT bool_or(level = 'LOW') THEN 'MEDIUM' WHEN bool_and(level = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS level FROM l GROUP BY 1"""
)
def r_combined_confidence(spark, folder):
    level = F.when(F.col("confidence") > 0.8, "HIGH").when(F.col("confidence") >= 0.6, "MEDIUM").otherwise("LOW")
    return rt.combined_confidence(table(spark, folder, "evaluation_result").where("confidence IS NOT NULL").select(F.col("question_id").alias("qid"), level.alias("level")))
