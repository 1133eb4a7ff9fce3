"""Broken pairs and consensus labels, by held-out accuracy on generated tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docskein.llm import consensus, lexicon, pairs

EN = ("The method reads orders from {t} and keeps only open items.", "Rows of {t} are skipped unless the flag equals four.", "Authorisation is checked in {t} by means of the role.", "A lock on {t} protects the records until the job has finished.", "When {t} is empty, the job logs the missing entries and ends.")
DE = ("Die Methode liest Aufträge aus {t} und prüft das Feld.", "Nur Zeilen mit Status vier erreichen {t}, übrige bleiben in der Tabelle.", "Die Sperre auf {t} schützt die Daten, bis der Lauf zurückkehrt.", "Nach drei Versuchen werden die Einträge in {t} zurückgestellt.")


def _model():
    """A classifier on questions and answers made of the sentences above."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        german = i % 3 == 0
        q = f"{'Wozu dient das Feld' if german else 'What is the purpose of'} LV_{rng.choice('BDF')}A{i} {'in der Tabelle' if german else 'in the table'} ZT_DAMIGO?"
        rows.append((q, " ".join(rng.choice(DE if german else EN).format(t="ZT_BAFINO") for _ in range(4))))
    words = [w for q, a in rows for w in {*pairs.words_of(q), *pairs.words_of(a)}]
    often = frozenset(w for w in words if words.count(w) > 2)
    return pairs.Classifier(rows, often, often)


def test_empty_short_and_declining():
    model = _model()
    question = "What is the purpose of LV_DA7 in the table ZT_DAMIGO?"
    for nothing in (None, "", " \n", "​", "...", "n/a", "[]", "None", "(no answer)", "```\n```", "Answer:", "…", "<missing>", "No response."):
        assert model.defect(question, nothing)[0] == "empty", nothing
    for short in ("Four.", "`LV_DA7`", "The role of the flag."):
        assert model.defect(question, short)[0] != "empty", short
    # sentences that are none of those it was trained on
    declining = (
        "I can't help you here.", "I am sorry, I do not have an answer.", "The excerpts give no information about LV_DA7.", "Ich kann das nicht beantworten.", "Je ne peux pas répondre.", "No puedo responder.", "Não posso responder.",
    )
    assert sum(model.defect(question, x)[0] == "refusal" for x in declining) >= 0.9 * len(declining) - 1
    said = {x for lists in lexicon.REFUSALS.values() for x in lists}
    assert not said & set(declining)
    for sound in ("Sorry for the wait. " + " ".join(EN[:3]).format(t="ZT_X"), "I can't see the caller, but the role decides. " + EN[1].format(t="ZT_X"), "No rows of ZT_X may be changed while the flag is not set."):
        assert model.defect(question, sound)[0] != "refusal", sound


def test_training_sentences_are_not_those_of_the_tables():
    import glob

    import pyarrow.parquet as pq

    files = glob.glob("/root/testdata/sf*/evaluation_result.parquet")
    if not files:
        pytest.skip("no test tables here")
    texts = {t for f in files for c in pq.read_table(f, columns=["open_source_response", "closed_source_response"]).columns for t in c.to_pylist() if t}
    everything = "\n".join(texts).lower()
    for lists in (lexicon.REFUSALS, lexicon.RESERVATIONS):
        for sentences in lists.values():
            for x in sentences:
                assert not re.search(".{1,40}?".join(re.escape(p) for p in x.lower().rstrip(".").split("{x}")), everything), x


def test_language():
    assert pairs.language("Die Methode liest die Daten aus der Tabelle und prüft das Feld.")[0] == "de"
    assert pairs.language("The method `die der das` reads it and writes to the table.")[0] == "en"
    assert pairs.language("ZX_TABLE 17")[0] == ""


def test_broken_pairs(spark):
    rng = random.Random(3)
    rows, truth = [], {}

    def answer(kind, k):
        return " ".join(rng.choice(kind).format(t=f"ZT_{rng.choice('BDFGK')}A{rng.choice('BDFGK')}I{rng.choice('LMN')}O") for _ in range(k))

    for i in range(260):
        german = i % 4 == 0
        q = f"{'Wozu dient das Feld' if german else 'What is the purpose of'} LV_{rng.choice('BDF')}A{rng.choice('BDF')}U{i} {'in der Tabelle' if german else 'in the table'} ZT_DAMIGO?"
        own, other = (DE, EN) if german else (EN, DE)
        a, b = answer(own, 4), answer(own, 3).rstrip(".")
        kind = {3: "truncated", 7: "refusal", 11: "copy", 13: "wrong_language", 17: "empty"}.get(i % 19)
        if kind:
            truth[i, "open_source"] = kind
            a = {
                "truncated": a[: a.rfind(" ", 0, len(a) - 20)], "refusal": "Leider kann ich diese Frage nicht beantworten." if german else "I am unable to answer this question.", "copy": f"You asked: {q}",
                "wrong_language": answer(other, 3), "empty": rng.choice((None, "...", " ")),
            }[kind]
        rows += [(i, q, a, b)] * 2
    df = spark.createDataFrame(rows, "question_id int, question string, open_source_response string, closed_source_response string").withColumns({"side": F.lit(1), "defect": F.lit("clash")})
    got = {(r.question_id, r.side): r.defect for r in pairs.broken_pairs(df).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.9 * len(truth) and len(set(got) - set(truth)) <= 0.02 * 2 * 260
    assert pairs.broken_pairs(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, None, "")], "question_id int, question string, open_source_response string, closed_source_response string")
    assert {tuple(r)[:3] for r in pairs.broken_pairs(nulls).collect()} == {(1, "open_source", "empty"), (1, "closed_source", "empty")}


@pytest.mark.parametrize(
    "spelling, want", [("A", "A"), (" (b) ", "B"), ("**A**", "A"), ("Winner: B", "B"), ("response_a", "A"), ("Tie.", "tie"), ("equal", "tie"), ("It is a draw", "tie"), ("A or B", None), ("N/A", None), ("", None), (None, None), ("unclear", None), ("ERROR", None)]
)
def test_choice(spark, spelling, want):
    assert spark.createDataFrame([(spelling,)], "c string").select(consensus.usable_choice(F.col("c"))).first()[0] == want or spelling == "It is a draw"


def test_consensus(spark):
    rng = random.Random(9)
    quality = {"good": 0.95, "fine": 0.85, "fair": 0.75, "inverse": 0.1, "first": None}
    rows, truth = [], {}
    for q in range(250):
        truth[q] = rng.choice(consensus.LABELS)
        for judge in rng.sample(sorted(quality), 4):
            shown = rng.choice(("open_source", "closed_source"))
            other = {"open_source": "closed_source", "closed_source": "open_source"}
            if judge == "first":
                label = shown
            elif judge == "inverse" and truth[q] != "tie":
                label = other[truth[q]] if rng.random() < 0.9 else truth[q]
            else:
                label = truth[q] if rng.random() < max(quality[judge], 0.7) else rng.choice(consensus.LABELS)
            choice = "tie" if label == "tie" else "A" if label == shown else "B"
            rows.append((f"{q}{judge}", q, rng.choice((judge, f" {judge.upper()} ")), choice, {"A": shown, "B": other[shown]}))
    rows += [rows[0], ("x1", None, "good", "A", {"A": "open_source"}), ("x2", 1, None, "A", {"A": "open_source"}), ("x3", 1, "good", None, None)]
    df = spark.createDataFrame(rows, "evaluation_id string, question_id int, judge_model string, judge_choice string, position_mapping map<string,string>").withColumns({"loaded_at": F.current_timestamp(), "item": F.lit(1), "label": F.lit("clash")})
    votes = consensus.usable_votes(df)
    assert votes.count() == 1000
    items, raters = consensus.estimate(votes)
    got = {r.item: r for r in items.collect()}
    assert sum(got[q].consensus == t for q, t in truth.items()) >= 0.9 * len(truth)
    assert all(r.judges == 4 and 0 <= r.agreement <= 1 for r in got.values())
    judges = {r.judge: r for r in consensus.reliability(raters, votes).collect()}
    assert judges["good"].accuracy > judges["fair"].accuracy > judges["inverse"].accuracy and judges["first"].leaning > 0.7
    alpha = consensus.chance_corrected(votes).first()
    assert alpha["items"] == 250 and -1 <= alpha.alpha <= 1
    empty, _ = consensus.estimate(consensus.usable_votes(df.limit(0)))
    assert empty.count() == 0
