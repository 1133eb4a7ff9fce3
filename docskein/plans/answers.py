"""Queries over golden items, answers and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.operators import evaluation as ev
from docskein.operators import judging as jd
from docskein.plans.registry import query, table

LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn_ FROM combined_all_chunks) WHERE rn_ = 1"
#: Evaluation rows once each, the latest delivery.
ROWS = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY loaded_at DESC) AS rn_ FROM evaluation_result) WHERE rn_ = 1)"
JUDGED = f"""{ROWS}, j AS (SELECT evaluation_id, question_id, lower(trim(judge_model)) AS judge, coalesce(question_type, 'unknown') AS question_type, actual_winner AS winner, confidence, scores_a, scores_b FROM e WHERE actual_winner IS NOT NULL)"""
RATES = """count(*) AS judgements, count(DISTINCT question_id) AS questions,
 count(*) FILTER (winner = 'open_source') AS open_wins, round(count(*) FILTER (winner = 'open_source') / count(*) + 1e-9, 4) AS open_rate,
 count(*) FILTER (winner = 'closed_source') AS closed_wins, round(count(*) FILTER (winner = 'closed_source') / count(*) + 1e-9, 4) AS closed_rate,
 count(*) FILTER (winner = 'tie') AS tie_wins, round(count(*) FILTER (winner = 'tie') / count(*) + 1e-9, 4) AS tie_rate, round(avg(confidence) + 1e-9, 4) AS confidence"""
BLANK = "regexp_replace(coalesce({0}, ''), '\\s+', '', 'g') = ''"


def rows(spark, folder):
    return ev.latest(table(spark, folder, "evaluation_result"), "evaluation_id", "loaded_at")


def judged(spark, folder):
    return rows(spark, folder).where("actual_winner IS NOT NULL").select(
        "evaluation_id", "question_id", F.lower(F.trim("judge_model")).alias("judge"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
        F.col("actual_winner").alias("winner"), "confidence", "scores_a", "scores_b",
    )


@query(f"WITH {JUDGED} SELECT {RATES} FROM j")
def g_win_rates(spark, folder):
    return jd.win_rates(judged(spark, folder))


@query(f"WITH {JUDGED} SELECT judge, {RATES} FROM j GROUP BY 1")
def g_win_rates_by_judge(spark, folder):
    return jd.win_rates(judged(spark, folder), "judge")


@query(f"WITH {JUDGED} SELECT question_type, judge, grouping(question_type, judge)::INT AS level, {RATES} FROM j GROUP BY CUBE (question_type, judge)")
def g_win_cube(spark, folder):
    return jd.win_cube(judged(spark, folder))


@query(
    f"""WITH {JUDGED}, c AS (SELECT question_type, judge, count(*) FILTER (winner = 'open_source') AS open_wins, count(*) FILTER (winner = 'closed_source') AS closed_wins, count(*) FILTER (winner = 'tie') AS ties FROM j GROUP BY 1, 2)
 SELECT *, CASE WHEN open_wins > closed_wins AND open_wins > ties THEN 'open_source' WHEN closed_wins > open_wins AND closed_wins > ties THEN 'closed_source' ELSE 'tie' END AS leader FROM c"""
)
def g_type_judge_matrix(spark, folder):
    return jd.type_judge_matrix(judged(spark, folder))


@query(f"WITH {JUDGED} SELECT winner, count(*) FILTER (confidence > 0.8) AS high, count(*) FILTER (confidence BETWEEN 0.6 AND 0.8) AS middle, count(*) FILTER (confidence < 0.6) AS low, round(avg(confidence) + 1e-9, 4) AS mean FROM j GROUP BY 1")
def g_confidence_bands(spark, folder):
    return jd.confidence_bands(judged(spark, folder))


@query(
    f"""WITH {JUDGED}, t AS (SELECT avg((winner = 'open_source')::INT) AS o, avg((winner = 'closed_source')::INT) AS c FROM j), b AS (SELECT judge, round(avg(confidence) + 1e-9, 6) AS c FROM j GROUP BY 1)
 SELECT round(o, 4) AS open_rate, round(t.c, 4) AS closed_rate, round(abs(o - t.c), 4) AS gap, CASE WHEN abs(o - t.c) > 0.15 THEN 'clear' WHEN abs(o - t.c) > 0.05 THEN 'slight' ELSE 'none' END AS difference,
 (SELECT judge FROM b ORDER BY c DESC NULLS LAST, judge DESC LIMIT 1) AS most_confident FROM t"""
)
def g_verdict(spark, folder):
    return jd.verdict(judged(spark, folder))


@query(
    f"""WITH {JUDGED}, m AS (SELECT evaluation_id, confidence, list_avg(map_values(scores_a)::DOUBLE[]) AS a, list_avg(map_values(scores_b)::DOUBLE[]) AS b FROM j)
 SELECT evaluation_id, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(a - b, 4) AS difference, confidence > 0.8 AS high_confidence FROM m"""
)
def g_score_columns(spark, folder):
    return jd.score_columns(judged(spark, folder))


@query(
    f"""WITH {ROWS}, c AS (SELECT lower(trim(judge_model)) AS judge, upper(regexp_replace(judge_choice, '[^A-Za-z]', '', 'g')) AS choice FROM e)
 SELECT judge, count(*) AS judgements, round(avg((choice = 'A')::INT) + 1e-9, 4) AS first_share FROM c WHERE choice IN ('A', 'B') GROUP BY 1"""
)
def g_position_bias(spark, folder):
    e = rows(spark, folder).select(F.lower(F.trim("judge_model")).alias("judge"), F.upper(F.regexp_replace("judge_choice", "[^A-Za-z]", "")).alias("choice"))
    return jd.position_bias(e)


@query(
    """SELECT question_id, judge, round, CASE WHEN round % 2 = 0 THEN 'open_source' ELSE 'closed_source' END AS a_is FROM (SELECT DISTINCT question_id FROM evaluation_result),
 (SELECT unnest(['first', 'second', 'third']) AS judge), (SELECT unnest([0, 1, 2])::INT AS round)"""
)
def j_assignments(spark, folder):
    return jd.assignments(table(spark, folder, "evaluation_result").select("question_id").distinct(), ["first", "second", "third"], 3)


ANSWERED = f"""{ROWS}, a AS (SELECT trim(question) AS key, loaded_at AS at_, open_source_response AS answer, switch_round AS n FROM e WHERE NOT ({BLANK.format('question')})),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ DESC, answer DESC NULLS LAST, n DESC) AS rn_ FROM a) WHERE rn_ = 1)"""


@query(
    f"""WITH {ANSWERED}, g AS (SELECT question_id, min(trim(question)) AS question, max(closed_source_response) AS reference_answer, max(question_type) AS question_type FROM e GROUP BY 1)
 SELECT question_id AS item_id, g.question, reference_answer, upper(question_type[1]) || lower(question_type[2:]) AS question_type, answer, coalesce(n, 0) AS n_chunks FROM g LEFT JOIN l ON trim(g.question) = key"""
)
def j_merge_answers(spark, folder):
    """Items take the latest open answer to the same trimmed question."""
    e = rows(spark, folder)
    items = e.groupBy(F.col("question_id").alias("item_id")).agg(F.min(F.trim("question")).alias("question"), F.max("closed_source_response").alias("reference_answer"), F.max("question_type").alias("question_type"))
    answers = e.select("question", F.col("open_source_response").alias("answer"), F.col("loaded_at").alias("at"), F.col("switch_round").alias("n_chunks"))
    return ev.merge_answers(items, answers)


@query(f"SELECT sample_id, split FROM dataset WHERE NOT ({BLANK.format('code')}) AND NOT ({BLANK.format('documentation')}) AND NOT ({BLANK.format('source')})")
def p_valid_rows(spark, folder):
    return ev.valid_rows(table(spark, folder, "dataset"), ["code", "documentation", "source"]).select("sample_id", "split")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NOT NULL AND {BLANK.format(c)}) AS blank FROM dataset" for c in ("instruction", "code", "documentation", "source", "text")
    )
)
def p_validation_report(spark, folder):
    return ev.validation_report(table(spark, folder, "dataset"), ["instruction", "code", "documentation", "source", "text"])


@query(
    f"""WITH {ROWS}, o AS (SELECT question_id, max(open_source_response) AS o, max(closed_source_response) AS c FROM e GROUP BY 1)
 SELECT ({BLANK.format('o')}) AS open_missing, ({BLANK.format('c')}) AS closed_missing, count(*) AS questions, min(question_id) AS first_question FROM o GROUP BY 1, 2"""
)
def p_pair_validation(spark, folder):
    """Questions by which of their answers is missing."""
    each = rows(spark, folder).groupBy("question_id").agg(F.max("open_source_response").alias("o"), F.max("closed_source_response").alias("c"))
    return each.groupBy(tx.blank("o").alias("open_missing"), tx.blank("c").alias("closed_missing")).agg(F.count("*").alias("questions"), F.min("question_id").alias("first_question"))


@query(f"WITH {ROWS} SELECT question_type, count(confidence) AS n, round(avg(confidence) + 1e-9, 4) AS mean, round(stddev_pop(confidence), 4) AS std, min(confidence) AS least, max(confidence) AS greatest, round(median(confidence) + 1e-9, 4) AS median FROM e GROUP BY 1")
def g_statistics(spark, folder):
    return ev.statistics(rows(spark, folder), ["question_type"], "confidence")


#: Each score of either side as a row; the component that a criterion measures.
CELLS = f"""{ROWS}, s AS (SELECT coalesce(question_type, 'unknown') AS question_type, 'a' AS model, unnest(map_keys(scores_a)) AS metric, unnest(map_values(scores_a)) AS score FROM e
 UNION ALL SELECT coalesce(question_type, 'unknown'), 'b', unnest(map_keys(scores_b)), unnest(map_values(scores_b)) FROM e),
 cells AS (SELECT *, CASE WHEN metric IN ('technical_accuracy', 'sap_domain_knowledge') THEN 'retriever' ELSE 'generator' END AS component FROM s)"""


def cells(spark, folder):
    e = rows(spark, folder).withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    part = lambda c, m: e.select("question_type", F.lit(m).alias("model"), F.explode(c).alias("metric", "score"))
    component = F.when(F.col("metric").isin("technical_accuracy", "sap_domain_knowledge"), "retriever").otherwise("generator")
    return part("scores_a", "a").unionByName(part("scores_b", "b")).withColumn("component", component)


@query(f"WITH {CELLS} SELECT question_type, component, metric, grouping(question_type)::INT AS all_types, count(score) AS n, round(avg(score) + 1e-9, 4) AS mean FROM cells GROUP BY GROUPING SETS ((component, metric), (question_type, component, metric))")
def g_component_statistics(spark, folder):
    return ev.component_statistics(cells(spark, folder))


@query(f"WITH {CELLS} SELECT metric, round(avg(score) FILTER (model = 'a') + 1e-9, 4) AS a_mean, round(stddev_pop(score) FILTER (model = 'a'), 4) AS a_std, round(avg(score) FILTER (model = 'b') + 1e-9, 4) AS b_mean, round(stddev_pop(score) FILTER (model = 'b'), 4) AS b_std FROM cells GROUP BY 1")
def g_comparison_table(spark, folder):
    return ev.comparison_table(cells(spark, folder), ["a", "b"])


@query(
    f"""WITH {CELLS}, m AS (SELECT round(avg(score) FILTER (component = 'retriever') + 1e-9, 4) AS retriever, round(avg(score) FILTER (component = 'generator') + 1e-9, 4) AS generator FROM cells)
 SELECT retriever, generator, round(abs(retriever - generator), 4) AS gap, CASE WHEN abs(retriever - generator) <= 0.1 THEN 'excellent' WHEN abs(retriever - generator) <= 0.2 THEN 'good' WHEN abs(retriever - generator) <= 0.3 THEN 'fair' ELSE 'unbalanced' END AS rating FROM m"""
)
def g_component_gap(spark, folder):
    c = cells(spark, folder)
    mean = lambda x: F.round(F.avg(F.when(F.col("component") == x, F.col("score"))) + 1e-9, 4).alias(x)
    gap = F.abs(F.col("retriever") - F.col("generator"))
    return c.agg(mean("retriever"), mean("generator")).select("retriever", "generator", F.round(gap, 4).alias("gap"), F.when(gap <= 0.1, "excellent").when(gap <= 0.2, "good").when(gap <= 0.3, "fair").otherwise("unbalanced").alias("rating"))


@query(
    f"""WITH {CELLS}, b AS (SELECT model, metric, avg(score) / 2 AS s FROM cells GROUP BY 1, 2)
 SELECT model, metric, round(s, 4) AS score, CASE WHEN s >= 4.5 THEN 'excellent' WHEN s >= 3.5 THEN 'good' WHEN s >= 2.5 THEN 'fair' WHEN s >= 1.5 THEN 'poor' ELSE 'very poor' END AS band FROM b"""
)
def g_quality_bands(spark, folder):
    s = cells(spark, folder).groupBy("model", "metric").agg((F.avg("score") / 2).alias("s"))
    return s.select("model", "metric", F.round("s", 4).alias("score"), ev.quality_band(F.col("s")).alias("band"))


@query(
    f"""WITH {CELLS}, w AS (SELECT model, metric, avg(score) AS s FROM cells GROUP BY 1, 2),
 t AS (SELECT model, round(sum(s * CASE metric WHEN 'technical_accuracy' THEN 0.3::DOUBLE WHEN 'completeness' THEN 0.3::DOUBLE WHEN 'clarity' THEN 0.2::DOUBLE WHEN 'practical_value' THEN 0.2::DOUBLE ELSE 0 END), 4) AS composite FROM w GROUP BY 1)
 SELECT model, composite, rank() OVER (ORDER BY composite DESC)::INT AS place FROM t"""
)
def g_composite_ranking(spark, folder):
    from pyspark.sql import Window

    weight = F.coalesce(*[F.when(F.col("metric") == m, F.lit(w)) for m, w in (("technical_accuracy", 0.3), ("completeness", 0.3), ("clarity", 0.2), ("practical_value", 0.2))], F.lit(0.0))
    means = cells(spark, folder).groupBy("model", "metric").agg(F.avg("score").alias("s")).groupBy("model").agg(F.round(F.sum(F.col("s") * weight), 4).alias("composite"))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.col("composite").desc())))


@query("WITH c AS (SELECT question_type, count(*) AS n FROM golden_dataset GROUP BY 1) SELECT count(*) AS kinds, min(n) AS least, max(n) AS greatest, round(min(n) / max(n), 4) AS balance, sum(n)::BIGINT AS total, sum(least(n, 3))::BIGINT AS three_each FROM c")
def g_balance(spark, folder):
    return ev.balance(table(spark, folder, "golden_dataset"), "question_type")


@query("SELECT sample_id, source, place FROM (SELECT sample_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(sample_id::VARCHAR || ':42'), sample_id)::INT AS place FROM dataset) WHERE place <= 5")
def g_stratified_sample(spark, folder):
    return ev.stratified_sample(table(spark, folder, "dataset").select("sample_id", "source"), "source", "sample_id", 5)


@query("SELECT source AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM dataset GROUP BY 1")
def g_value_counts(spark, folder):
    return ev.value_counts(table(spark, folder, "dataset"), "source")


@query("SELECT sample_id, CASE WHEN ('0x' || substr(md5(sample_id::VARCHAR || ':42'), 1, 6))::INT % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM dataset")
def g_hash_split(spark, folder):
    return ev.hash_split(table(spark, folder, "dataset"), "sample_id", 20).select("sample_id", "part")


@query(
    f"""WITH c AS ({LATEST}), t AS (SELECT trim(split_part(title, ' ', 1)) AS topic FROM c WHERE title IS NOT NULL) SELECT topic, count(*) AS n FROM t WHERE topic <> '' GROUP BY 1 ORDER BY n DESC, topic LIMIT 10"""
)
def g_top_topics(spark, folder):
    """The ten most frequent first words of titles."""
    t = ev.latest(table(spark, folder, "combined_all_chunks"), "chunk_id", "ingested_at").where("title IS NOT NULL").select(F.trim(F.split_part("title", F.lit(" "), F.lit(1))).alias("topic"))
    return t.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(10)


@query("SELECT item_id, coalesce(list_aggregate(list_transform(conversation_history, lambda t: upper(t.role[1]) || lower(t.role[2:]) || ': ' || coalesce(t.content, '')), 'string_agg', chr(10)), '') AS history FROM golden_dataset")
def q_history(spark, folder):
    from docskein.operators import understanding as un

    return table(spark, folder, "golden_dataset").select("item_id", un.history(F.col("conversation_history")).alias("history"))


@query("SELECT sample_id FROM dataset d WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM dataset x WHERE x.split <> 'train' AND x.source = d.source)")
def j_anti_join(spark, folder):
    """Train records whose source has no evaluation records."""
    d = table(spark, folder, "dataset")
    return d.where("split = 'train'").join(d.where("split <> 'train'").select("source"), "source", "left_anti").select("sample_id")


@query(f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS rn_ FROM combined_all_chunks) SELECT chunk_id, filename, ingested_at FROM c WHERE rn_ = 1")
def s_upsert(spark, folder):
    """Re-ingested chunks replace earlier ones: rows delivered first make the table, all others are upserted into it."""
    c = table(spark, folder, "combined_all_chunks").select("chunk_id", "filename", "ingested_at")
    first = c.groupBy("chunk_id").agg(F.min_by(F.struct("filename", "ingested_at"), F.coalesce("ingested_at", F.to_timestamp(F.lit("1970-01-01")))).alias("x")).select("chunk_id", "x.*")
    return ev.upsert(first, c, "chunk_id", "ingested_at")
