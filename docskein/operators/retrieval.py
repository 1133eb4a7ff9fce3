"""Batched retrieval: every query of a table at once, sparse, dense, late-interaction and fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docskein.functions import text as tx
from docskein.session import release, stage


def top_k(hits: DataFrame, k: int | Column, query: str = "qid", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best hits of each query with their rank; ties go to the smaller document id. k may be a column."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, doc_id, score of every pair that shares a word. docs: doc_id, text; queries: qid, text.

    Only words of the queries are kept right behind the scan, so the postings that are shuffled follow the queries and not
    the vocabulary. They are dealt by document once: term counts, the sum of a pair's weights and the first part of a top-k
    then happen in place, and only the best hits are shuffled again. Null and empty texts count as documents of no words; repeated rows of a document id count once each.
    """
    tokens = docs.select("doc_id", tx.words("text").alias("words"))
    stats = tokens.agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("mean_length"))
    asked = queries.select("qid", F.explode(tx.terms("text")).alias("term"))
    vocabulary = asked.select("term").distinct()
    postings = (
        tokens.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term"))
        .join(vocabulary, "term", "left_semi")
        .repartition("doc_id")
        .groupBy("doc_id", "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    tf, rel = F.col("tf"), F.col("length") / F.col("mean_length")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = postings.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc_id", (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * rel))).alias("weight"))  # stats is one row
    return weighted.join(asked, "term").groupBy("qid", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def in_blocks(blocks: int, make) -> DataFrame:
    """The union of make(i) for each block i; make returns (result, broadcasts and staged tables to let go).

    With several blocks each result is staged before the next block is sent, so that one block is held at a time.
    """
    out = None
    for i in range(blocks):
        part, held = make(i)
        if blocks > 1:
            part = stage(part, "block")
            for x in held:
                release(x) if isinstance(x, DataFrame) else x.destroy()
        out = part if out is None else out.union(part)
    return out


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, block: int = 2048, block_terms: int = 500_000) -> DataFrame:
    """The k best of bm25 for a stated set of queries, with their rank, without ever forming the pairs of queries and documents.

    The queries go in blocks of about block queries and block_terms terms, which bounds what is broadcast: the terms, and for each
    term its queries. For each block the documents are read and split into words once; what is left of them, the counts of the
    block's terms, is staged. Document frequencies and lengths come from that table, and a second narrow pass over it adds up the
    scores of a batch (frequent terms as a dense product, the others by their lists of queries) and passes on the k best of the
    batch for each query, and what ties with the last of them. Nulls and repeated rows are treated as in bm25.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    tokens = docs.select("doc_id", tx.words("text").alias("words"))
    asked = stage(queries.select("qid", tx.terms("text").alias("terms")).where(F.size("terms") > 0), "asked")
    count, total = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-count // block), -(-total // block_terms))
    qid_type = to_arrow_type(queries.schema["qid"].dataType)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def make(i: int):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect()
        terms = sorted({t for r in rows for t in r.terms})
        place = {t: j for j, t in enumerate(terms)}
        words = spark.sparkContext.broadcast(terms)

        def keep(batches):
            known = pa.array(words.value, pa.string())
            for batch in batches:
                lists = batch.column(1)
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                cell, tf = np.unique((np.repeat(np.arange(len(length)), length) * len(known) + at)[at >= 0], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cell // max(1, len(known)), minlength=len(length)))]), pa.int32())
                kept = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cell % max(1, len(known)), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int32()), *kept], ["doc_id", "length", "terms", "tf"])

        held = stage(tokens.mapInArrow(keep, f"doc_id {doc_kind}, length int, terms array<int>, tf array<int>"), "postings")
        n, mean = held.agg(F.count("*"), F.avg("length")).first()
        counts = np.zeros(len(terms))
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more than the block's terms
            counts[r[0]] = r[1]
        # the queries of each term, in one array
        of = [[] for _ in terms]
        for column, r in enumerate(rows):
            for t in r.terms:
                of[place[t]].append(column)
        many = np.array([len(x) for x in of], dtype=np.int64)
        frequent = np.flatnonzero(many * 8 > len(rows))  # at most 8 times the mean number of terms of a query
        dense = np.zeros((len(frequent), len(rows)))
        for j, t in enumerate(frequent):
            dense[j, of[t]] = 1
        lists = np.array([q for x in of for q in x], dtype=np.int32)
        shared = spark.sparkContext.broadcast(([r.qid for r in rows], np.log(1 + (n - counts + 0.5) / (counts + 0.5)), many, lists, frequent, dense))

        def scan(batches):
            qids, idf, many, lists, frequent, dense = shared.value
            begin_of, width = np.cumsum(many) - many, len(qids)
            column_of = np.full(len(many), -1)
            column_of[frequent] = np.arange(len(frequent))
            for whole in batches:
                for begin in range(0, whole.num_rows, 512):
                    batch = whole.slice(begin, 512)
                    length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                    size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                    term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                    if not len(term):
                        continue
                    doc = np.repeat(np.arange(len(size)), size)
                    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
                    often = column_of[term] >= 0
                    some = np.zeros((len(size), len(frequent)))
                    some[doc[often], column_of[term[often]]] = weight[often]
                    score = some @ dense
                    term, doc, weight = term[~often], doc[~often], weight[~often]
                    each = many[term]
                    at = np.repeat(begin_of[term], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    score += np.bincount(np.repeat(doc, each) * width + lists[at], np.repeat(weight, each), len(size) * width).reshape(len(size), width)
                    score = np.round(score, 6).T
                    keep_ = min(k, score.shape[1])
                    floor = -np.partition(-score, keep_ - 1, axis=1)[:, keep_ - 1 : keep_]
                    q, d = np.nonzero((score >= floor) & (score > 0))
                    yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in q], qid_type), batch.column(0).take(pa.array(d)), pa.array(score[q, d])], ["qid", "doc_id", "score"])

        hits = held.mapInArrow(scan, f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {doc_kind}, score double")
        return top_k(hits, k), [words, shared, held]

    return in_blocks(blocks, make)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_hits(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Exact cosine top-k of a stated set of query vectors against all vectors. vectors: doc_id, vec; queries: qid, vec.

    The queries go through the corpus in blocks of bounded size: each is one pass in which every task keeps the k best of its
    own batch for each query, so that k rows a batch and query are shuffled and not every pair. Vectors that are null, empty or of another length aren't
    compared; zero vectors score 0.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    asked = queries.where("vec IS NOT NULL AND size(vec) > 0").select("qid", "vec")
    blocks = max(1, -(-asked.count() // block))
    qid_type = to_arrow_type(queries.schema["qid"].dataType)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"

    def make(i: int):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect()
        sizes = sorted({len(r.vec) for r in rows})
        data = [(n, [r.qid for r in rows if len(r.vec) == n], np.array([r.vec for r in rows if len(r.vec) == n], dtype=np.float64)) for n in sizes]
        shared = spark.sparkContext.broadcast(data)

        def scan(batches):
            for batch in batches:
                ids, vecs = batch.column(0), batch.column(1)
                length = np.array([len(v) if v is not None else 0 for v in vecs.to_pylist()])
                for n, qids, matrix in shared.value:
                    at = np.flatnonzero(length == n)
                    if not len(at):
                        continue
                    own = np.array(vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), n)
                    norm = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(own, axis=1)[None, :]
                    score = np.round(np.divide(matrix @ own.T, norm, out=np.zeros(norm.shape), where=norm > 0), 6)
                    keep = min(k, len(at))
                    # everything that ties with the k-th best is passed on, so that the tie-break by id stays exact
                    floor = -np.partition(-score, keep - 1, axis=1)[:, keep - 1 : keep]
                    q, d = np.nonzero(score >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in q], qid_type), ids.take(pa.array(at[d])), pa.array(score[q, d])], ["qid", "doc_id", "score"])

        return top_k(vectors.select("doc_id", "vec").mapInArrow(scan, kinds), k), [shared]

    return in_blocks(blocks, make)


def max_sim(doc_tokens: DataFrame, query_tokens: DataFrame, block_tokens: int = 20_000) -> DataFrame:
    """Late interaction: for each query token the best cosine in a document, summed. doc_tokens: doc_id, vec; query_tokens: qid, tok, vec.

    query_tokens is a stated query set, sent in blocks of about block_tokens tokens. Each task reduces its own document tokens to
    one best score for each document and query token before anything is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = doc_tokens.sparkSession
    asked = query_tokens.select("qid", "tok", "vec").where("size(vec) > 0")
    blocks = max(1, -(-asked.count() // block_tokens))
    qid_type, tok_type = (to_arrow_type(query_tokens.schema[c].dataType) for c in ("qid", "tok"))
    schema = f"qid {query_tokens.schema['qid'].dataType.simpleString()}, tok {query_tokens.schema['tok'].dataType.simpleString()}, doc_id {doc_tokens.schema['doc_id'].dataType.simpleString()}, best double"

    def make(i: int):
        rows = asked.where(F.pmod(F.xxhash64("qid", "tok"), F.lit(blocks)) == i).orderBy("qid", "tok").collect()
        shared = spark.sparkContext.broadcast(([r.qid for r in rows], [r.tok for r in rows], np.array([r.vec for r in rows], dtype=np.float64)))

        def scan(batches):
            qids, toks, matrix = shared.value
            if not len(qids):
                return
            unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                vecs = batch.column(1).to_pylist()
                ok = [i for i, v in enumerate(vecs) if v is not None and len(v) == matrix.shape[1]]
                if not ok:
                    continue
                ids, inverse = np.unique(np.array(batch.column(0).take(pa.array(ok)).to_pylist()), return_inverse=True)
                own = np.array([vecs[i] for i in ok], dtype=np.float64)
                order = np.argsort(inverse, kind="stable")
                score = unit @ (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T[:, order]
                best = np.maximum.reduceat(score, np.flatnonzero(np.diff(inverse[order], prepend=-1)), axis=1)
                q, d = np.divmod(np.arange(best.size), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([qids[x] for x in q], qid_type), pa.array([toks[x] for x in q], tok_type), pa.array(ids[d]).cast(batch.schema.field(0).type), pa.array(best.ravel())], ["qid", "tok", "doc_id", "best"])

        best = doc_tokens.where("doc_id IS NOT NULL").select("doc_id", "vec").mapInArrow(scan, schema).groupBy("qid", "tok", "doc_id").agg(F.max("best").alias("best"))
        return best.groupBy("qid", "doc_id").agg(F.sum("best").alias("score")), [shared]

    # a query's tokens may lie in several blocks
    return in_blocks(blocks, make).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def linear_fusion(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.4, sparse_weight: float = 0.6) -> DataFrame:
    """Weighted sum of two hit lists, a missing side counting 0; the k best of each query."""
    both = dense.select("qid", "doc_id", F.col("score").alias("d")).join(sparse.select("qid", "doc_id", F.col("score").alias("s")), ["qid", "doc_id"], "full")
    score = F.round(F.coalesce("d", F.lit(0.0)) * dense_weight + F.coalesce("s", F.lit(0.0)) * sparse_weight, 6)
    return top_k(both.select("qid", "doc_id", score.alias("score")), k)


def reciprocal_rank_fusion(runs: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over any number of ranked lists; the k best of each query."""
    every = runs[0].select("qid", "doc_id", "rank")
    for r in runs[1:]:
        every = every.unionByName(r.select("qid", "doc_id", "rank"))
    fused = every.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return top_k(fused, k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Fused where a query has sparse hits, its dense hits where it has none. Both hit lists are read twice: stage them if they are costly."""
    asked = sparse.select("qid").distinct()
    fused = reciprocal_rank_fusion([dense.join(asked, "qid", "left_semi"), sparse], k, constant)
    alone = dense.join(asked, "qid", "left_anti").where(F.col("rank") <= k)
    return fused.unionByName(alone.select("qid", "doc_id", "score", "rank"))


def retrieval_limit(query: Column | str, k: int, variant: str = "closed") -> Column:
    """How many hits to fetch before reranking, by the kind of question."""
    q = F.lower(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))
    has = lambda *n: tx.contains_any(q, n)
    if variant == "closed":
        return F.when(has("method", "function"), max(30, 3 * k)).when(has("interface", "zif_"), max(20, 2 * k)).when(has("structure", "table"), max(15, int(1.5 * k))).otherwise(max(10, 2 * k))
    return (
        F.when(has("parameter", "specific"), max(35, 7 * k))
        .when(has("situation", "scenario", "complex"), max(45, 9 * k))
        .when(has("difference", "compare", "implement"), max(30, 6 * k))
        .otherwise(max(25, 5 * k))
    )


def rerank(hits: DataFrame, score: Column, k: int, window: int | None = None) -> DataFrame:
    """Orders the first hits (max(4 k, 20) by default) by another score and keeps k; a null score leaves the old one."""
    first = hits.where(F.col("rank") <= (window or max(4 * k, 20)))
    return top_k(first.withColumn("score", F.round(F.coalesce(score, F.col("score")), 6)).drop("rank"), k)


def relevant_hits(hits: DataFrame, least: float = 0.01, k: int = 8, mode: str = "raw") -> DataFrame:
    """Hits with a score of at least least, the first k of each query. mode abs takes the amount of the score."""
    value = F.abs("score") if mode == "abs" else F.col("score")
    return top_k(hits.where(value >= least).drop("rank"), k)


def retrieval_confidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, confidence, level: 0.4 mean amount of scores + 0.3 of up to three hits + 0.3 of brevity (15 words or fewer); LOW without hits."""
    sums = hits.groupBy("qid").agg(F.avg(F.abs("score")).alias("mean"), F.count("*").alias("n"), F.max(F.abs("score")).alias("top"))
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    brief = F.when(n_words == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.lit(15.0) / n_words)))
    joined = queries.select("qid", brief.alias("brief")).join(sums, "qid", "left")
    value = F.round(0.4 * F.col("mean") + 0.3 * F.least(F.lit(1.0), F.col("n") / 3.0) + 0.3 * F.col("brief"), 6)
    level = F.when(F.col("n").isNull(), "LOW").when((value >= 0.48) & (F.col("top") >= 0.5), "HIGH").when((value >= 0.21) & (F.col("top") >= 0.2), "MEDIUM").otherwise("LOW")
    return joined.select("qid", F.coalesce(value, F.lit(0.0)).alias("confidence"), level.alias("level"))


def contexts(hits: DataFrame, docs: DataFrame, least: float = 0.1) -> DataFrame:
    """Context rows: hits with title, file, text, code, and flags relevant, has_code and source_type."""
    rows = hits.join(docs, "doc_id")
    return rows.select(
        "qid", "rank", "doc_id", "score",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("filename", F.lit("")).alias("filename"),
        (F.col("score") >= least).alias("relevant"), (~tx.blank("code_snippet")).alias("has_code"), F.coalesce(F.length("text"), F.lit(0)).alias("content_length"),
        F.when(~tx.blank("code_snippet"), "code").otherwise("documentation").alias("source_type"),
    )


def context_string(rows: DataFrame) -> DataFrame:
    """qid, context, files: numbered references in rank order, and the distinct files in the order of their first mention."""
    line = F.format_string("[Document %d: %s (Score: %.4f)]", F.col("rank"), F.col("title"), F.floor(F.col("score") * 10000.0 + 0.5) / 10000.0)
    packed = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"), "filename"))).alias("all"))
    return packed.select("qid", F.array_join(F.col("all.line"), "\n").alias("context"), F.array_join(F.array_distinct(F.filter(F.col("all.filename"), lambda x: x != "")), ", ").alias("files"))


def combined_confidence(levels: DataFrame) -> DataFrame:
    """qid, level over sub-queries: all HIGH is HIGH; some HIGH and no LOW, or all MEDIUM, is MEDIUM; else LOW."""
    high, low, medium = (F.col("level") == x for x in ("HIGH", "LOW", "MEDIUM"))
    return levels.groupBy("qid").agg(F.when(F.bool_and(high), "HIGH").when(F.bool_or(high) & ~F.bool_or(low), "MEDIUM").when(F.bool_and(medium), "MEDIUM").otherwise("LOW").alias("level"))


def average_similarity(vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine over all pairs of vectors, from the sum of the unit vectors: no pair is ever formed.

    The sum over pairs is (|sum of units|^2 - n) / 2.
    """
    normed = vectors.where("size(vec) > 0").select("vec", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("norm")).where("norm > 0")
    unit = normed.select("norm", F.posexplode("vec")).select("pos", (F.col("col").cast("double") / F.col("norm")).alias("col"))
    sums = unit.groupBy("pos").agg(F.sum("col").alias("s"), F.count("*").alias("n"))
    return sums.agg(F.max("n").alias("vectors"), F.round((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1)), 6).alias("mean_cosine"))
