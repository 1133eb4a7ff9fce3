"""Tokens, leaks and encodings on small cases, against other implementations or brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docskein.llm import encoding, leakage, tokenizer

ODD = ["", " ", "\n\n \t", "<|endoftext|> x", "<unk>", "ä́🚀👍🏽 Größe", "aaaaaaaaaaaaaaaa" * 40, "it's I'LL 12345678901234567890", "▁a ▁", "x\r\ny", "合計 件のデータ"]


def test_encode_like_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abc ABC_1.é\n") for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "k int, t string").withColumns({"id": F.lit("clash"), "ids": F.lit(0)})
    got = {r.id: r.ids for r in tokenizer.encode_corpus(df, "k", "t", batch=7).collect()}
    assert got.pop(999) == []
    assert got == {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.id: r.text for r in tokenizer.decode_corpus(tokenizer.encode_corpus(df, "k", "t"), "id", "ids").collect()}
    assert back == {**dict(enumerate(texts)), 999: ""}
    assert tokenizer.encode_corpus(df.limit(0), "k", "t").count() == 0


def brute_leaks(items, docs, n):
    w = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda t: {tuple(w(t)[i : i + n]) for i in range(len(w(t)) - n + 1)}
    return {(i, d) for i, fields in items for d, t in docs if any(grams(f) & grams(t) for f in fields)}


@pytest.mark.parametrize("block_chars", [4_000_000, 200])
def test_leaks(spark, block_chars):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["a", "b", "é"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, [" ".join(make(20)), None if i % 3 else " ".join(make(30))]) for i in range(12)]
    docs = [(100, None), (101, ""), (102, "a b")]
    for d in range(60):
        text = make(rng.choice((5, 40, 80)))
        if d % 2:
            words = rng.choice(items)[1][0].split()
            size = rng.choice((8, 11, 12, 13, 20))
            start = rng.randrange(0, max(1, len(words) - size + 1))
            text[3:3] = words[start : start + size]
        docs.append((d, rng.choice((" ", ", ", " - \n")).join(text)))
    docs.append((103, docs[-1][1]))
    docs.append((104, "b " * 30))
    items.append((50, ["b " * 14, None]))
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumns({"item_id": F.lit("clash"), "words": F.lit(1)})
    it = spark.createDataFrame([(i, f[0], f[1]) for i, f in items], "item_id int, q string, c string")
    got = {tuple(r) for r in leakage.leaking_documents(df, "doc_id", "text", it, "item_id", ["q", "c"], block_chars=block_chars).collect()}
    assert got == brute_leaks(items, docs, 12)
    assert leakage.leaking_documents(df.limit(0), "doc_id", "text", it, "item_id", ["q", "c"]).count() == 0
    assert leakage.leaking_documents(df, "doc_id", "text", it.limit(0), "item_id", ["q", "c"]).count() == 0


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


@pytest.mark.parametrize("block_chars", [4_000_000, 300])
def test_leak_with_edits(spark, block_chars):
    """Passages too short to be found by a half: 20 words of which 12 must be aligned at once, with an edit in their middle."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    passage = [words[20 * i : 20 * i + 16] for i in range(16)]
    letter = lambda w: w[:1] + ("x" if w[1] != "x" else "y") + w[2:]
    edited = {
        0: passage[0], 1: [*passage[1][:8], letter(passage[1][8]), *passage[1][9:]], 2: [*passage[2][:8], "xyxyx", *passage[2][9:]], 3: [*passage[3][:8], "xyx", *passage[3][8:]],
        4: [*passage[4][:8], *passage[4][9:]], 5: [w if i % 3 else "zz" + w[::-1] for i, w in enumerate(passage[5])], 6: passage[6][:9],
    }
    filler = [words[330 + i] for i in range(60)]
    rows = [(i, " ".join(filler[:30] + x + filler[30:])) for i, x in edited.items()] + [(100, None), (101, ""), (102, " ".join(filler))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    it = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(passage[:7])] + [(90, None)], "item_id int, q string")
    find = lambda **k: {(r.item_id, r.doc_id): r for r in leakage.leaked_passages(df, "doc_id", "text", it, "item_id", ["q"], block_chars=block_chars, **k).collect()}
    assert set(find(edit_budget=0)) == {(0, 0)}
    assert set(find(edit_budget=1)) == {(0, 0), (1, 1)}
    ten = find(edit_budget=10, min_chars=60)
    assert set(ten) == {(i, i) for i in range(5)}  # one letter, a word replaced, inserted, left out
    assert all(r.words >= 12 for r in ten.values()) and ten[2, 2].equal < 12
    assert edit_distance(" ".join(passage[2]), " ".join(edited[2])) <= 10
    only = leakage.leaking_documents(df, "doc_id", "text", it, "item_id", ["q"], edit_budget=10, block_chars=block_chars)
    assert {tuple(r) for r in only.collect()} == {(0, 0)}


def test_leaks_of_boilerplate_are_expanded_in_ranges(spark, monkeypatch):
    text = " ".join(f"common{i}" for i in range(14))
    items = [(i, f"{text} own{i} tail{i}") for i in range(60)]
    monkeypatch.setattr(leakage, "EXPANDED", 500)
    block = leakage.Block([(i, "q") for i, _ in items], [t for _, t in items], 12, 1)
    found = block.find(["nothing here", f"before {text} after", None])
    assert {(t, f) for t, f, _, n in found if n >= 12} == {(1, i) for i in range(60)}


SENTENCES = [
    "Für Größen und Übersichten müssen Prüfungen täglich geändert werden.", "La fonction vérifie les données déjà créées à la clôture de l'opération.", "La validación de la operación rechaza los números más pequeños del año.",
    "A seleção não grava as operações até o fim da execução.", "Plain ASCII text without anything else.", "Σ = 34 ± 19 µm², ½ × 43 °C, § 90, £51", "Status: 🚀 ok 👍🏽 ✓", "Итог: 173 записей в таблице", "合計 344 件のデータ", "&eacute; and \\u00e9 are escapes",
]


def test_restore(spark):
    clean = [(i, SENTENCES[i % len(SENTENCES)] + f" {i}") for i in range(600)]
    wrong = {
        1000: SENTENCES[0].encode().decode("cp1252"), 1001: SENTENCES[1].encode().decode("latin-1"), 1002: SENTENCES[2].encode().decode("cp1252").encode().decode("cp1252"),
        1003: SENTENCES[1].encode("cp1252").decode("mac_roman"), 1004: SENTENCES[0].encode().decode("cp437"), 1006: SENTENCES[2].encode("cp1252").decode("cp850"),
    }
    truth = {1000: SENTENCES[0], 1001: SENTENCES[1], 1002: SENTENCES[2], 1003: SENTENCES[1], 1004: SENTENCES[0], 1006: SENTENCES[2]}
    rows = clean + list(wrong.items()) + [(2000, None), (2001, ""), (2002, "  "), (2003, "lib�re"), (1000, wrong[1000])]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"id": F.lit("clash"), "places": F.lit(1)})
    got = {r.id: r for r in encoding.restored_texts(df, "doc_id", "text").collect()}
    assert set(got) == {*truth, 2003}
    assert {i: got[i].restored for i in truth} == truth and all(got[i].complete for i in truth)
    assert not got[2003].complete
    assert encoding.restored_texts(df.limit(0), "doc_id", "text").count() == 0
    assert encoding.restored_texts(df.where("doc_id = 4"), "doc_id", "text").count() == 0


def test_a_wholly_garbled_source_does_not_vouch_for_itself(spark):
    rows = [(i, SENTENCES[i % 6] + f" {i}", f"s{i % 12}") for i in range(1200)] + [(i, "Итог: 12 записей в таблице", f"s{i % 12}") for i in range(1200, 1230)]
    wrong = {i: t.encode("utf-8").decode("cp1252", "ignore") if i % 2 else t.encode("mac_roman", "ignore").decode("cp1252", "ignore") for i, t, s in rows if s == "s5" and i % 6 < 4}
    df = spark.createDataFrame([(i, wrong.get(i, t), s) for i, t, s in rows], "doc_id int, text string, source string")
    garbled = {i for i, t, _ in rows if wrong.get(i, t) != t}
    got = {r.id for r in encoding.restored_texts(df, "doc_id", "text", "source").select("id").collect()}
    assert len(got & garbled) >= 0.95 * len(garbled) and not got - garbled
    # ordinary runs of correct text are in no segment
    model = encoding.corpus_counts(df.where("source <> 's5'"), "text", "source", 0.98)
    points = encoding.code_points(SENTENCES[0])
    assert (encoding.np.diff(points) != 0).any() and model.probable(SENTENCES[0])


def test_a_blank_that_was_a_no_break_space(spark):
    rows = [(i, f"Elle passe à jour les données à partir de là {i}.") for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, "Elle passe Ã jour les donnÃ©es Ã partir de lÃ  17.")], "doc_id int, text string")
    got = {r.id: r.restored for r in encoding.restored_texts(df, "doc_id", "text").collect()}
    assert got == {1000: "Elle passe à jour les données à partir de là 17."}
