"""Text operators: exact encodings, balanced mixes, held-out accuracy of languages."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from helixaudit.llm import languages, mixing, tokenizer

needs_vocabulary = pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.load_vocabulary(tokenizer.VOCABULARY))


def strange_texts():
    rng = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "é", "日本", "́", "²", "½", "٣", "😀", "'s", "'ll", "'", "''", '"', "<|endoftext|>", "_", "==", "0", "123", "\x00", "aaaaaaaa", "    ", "᠎", "​", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return texts + ["".join(rng.choice("abcXYZ/+019") for _ in range(3000)) for _ in range(20)] + ["", " ", "\n", "z" * 100_000, "ab" * 30_000]


@needs_vocabulary
def test_encoding_equals_the_public_library(encoder):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(tokenizer.VOCABULARY)
    public.encode_special_tokens = True
    texts = strange_texts()
    ids, sizes = encoder.encode_block(texts)
    ours = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    want = [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]
    assert ours == want
    back = {v: k for k, v in encoder.ids.items()}
    for text, own in zip(texts[:300], ours):
        assert "".join(back[i] for i in own).encode("latin-1").decode() == text


@needs_vocabulary
def test_encoded_rows_of_null_and_empty_texts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "x"), (None, "y")]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id bigint, text string, ids int")
    got = tokenizer.encoded(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    assert [r["ids"] for r in got if r["doc_id"] in (2, 3)] == [[], []]
    assert next(r["ids"] for r in got if r["doc_id"] == 1) == [31373, 995]
    assert {r["tokens"] for r in tokenizer.encoded(df, counts_only=True).collect() if r["doc_id"] == 1} == {2}
    assert tokenizer.encoded(df.limit(0)).count() == 0


def test_flight_keeps_count_and_size():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 700):
        size, p = rng.integers(1, 3000, n), np.full(n, 0.37)
        q = mixing.fly(p, size, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-2
        done = mixing.land(q, size, rng)
        assert set(done.tolist()) <= {0.0, 1.0} and abs(done.sum() - p.sum()) <= 1


def test_inclusion_is_fair():
    size = np.array([10, 200, 30, 500, 70, 90, 20, 400, 300, 60])
    total = sum(mixing.land(mixing.fly(np.full(10, 0.3), size, np.random.default_rng(s)), size, np.random.default_rng(s + 10**6)) for s in range(3000))
    assert np.abs(total / 3000 - 0.3).max() < 0.05


def mix_rows(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(("big", "big", "mid", "small") if i % 9 else (None, "unlisted")), rng.randint(1, 400)) for i in range(4000)] + [(9000, "empty", 0), (9001, "big", 0)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.4, 3), ("empty", 0.2, 4), (None, 0.1, 1), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    return sizes, targets


def test_mix_reaches_its_shares(spark):
    sizes, targets = mix_rows(spark)
    got = mixing.mix(sizes, targets, sizes=sizes).collect()
    total = Counter()
    for r in got:
        total[r["source"]] += r["tokens"] * r["copies"]
    whole = sum(total.values())
    assert {k: round(v / whole, 2) for k, v in total.items()} == {"big": 0.3, "mid": 0.3, "small": 0.4}
    most = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(sizes, targets, sizes=sizes).collect()))
    assert mixing.mix(sizes, targets.limit(0), sizes=sizes).count() == 0
    assert mixing.mix(sizes.limit(0), targets, sizes=sizes.limit(0)).count() == 0


def test_plan_gives_no_document_more_than_its_cap():
    plan = mixing.plan_mix([dict(source="a", share=0.5, repeats=1, tokens=100), dict(source="b", share=0.5, repeats=2, tokens=30), dict(source="c", share=None, repeats=1, tokens=5), dict(source="d", share=0.1, repeats=1, tokens=None)])
    assert plan == {"a": 0.6, "b": 2.0}


SENTENCES = {
    "en": ["The water in the old house was cold and nobody wanted to stay there.", "She asked whether the children would come back before the evening."],
    "de": ["Das Wasser im alten Haus war kalt und niemand wollte dort bleiben.", "Sie fragte, ob die Kinder vor dem Abend wieder nach Hause kommen würden."],
    "fr": ["L'eau de la vieille maison était froide et personne ne voulait y rester.", "Elle demanda si les enfants reviendraient avant la fin de la soirée."],
    "ru": ["Вода в старом доме была холодной, и никто не хотел там оставаться.", "Она спросила, вернутся ли дети домой до наступления вечера."],
}


def notebook(*cells):
    return "\n\n".join(f"# %% [{kind}]\n{text}" for kind, text in cells)


def language_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        lang = rng.choice(list(SENTENCES))
        words = [w for s in SENTENCES[lang] for w in s.split()]
        cells = [("markdown", " ".join(rng.choice(words) for _ in range(25))) for _ in range(3)]
        rows.append((i, notebook(("code] In[1", "print(1)"), *cells), lang if i % 10 else "de_AT"))
    strange = [("markdown", SENTENCES["fr"][0] + " " + SENTENCES["fr"][1])]
    body = [("markdown", " ".join(SENTENCES["en"])), ("output] Out[1", SENTENCES["ru"][0])] * 3
    rows += [(500, notebook(*body, *strange), "English"), (501, notebook(*body), None), (502, notebook(*body), "??"), (503, notebook(*body), " EN-us ")]
    rows += [(600, None, "en"), (601, "", "en"), (602, "  \n", None), (603, notebook(("code] In[1", "x = 1")), "en"), (604, notebook(("markdown", "")), "en"), (605, "no cells at all", "en")]
    return spark.createDataFrame([(d, t, n, 1) for d, t, n in rows], "doc_id bigint, text string, lang string, named int"), rows


def test_languages_of_documents_and_cells(spark):
    df, _ = language_rows(spark)
    got = {(r["doc_id"], r["cell_no"]): r["lang"] for r in languages.corrections(df).collect() if r["doc_id"] >= 500}
    assert got == {(500, 7): "fr", (501, 0): "en", (502, 0): "en"}
    main = {r["doc_id"]: r for r in languages.main_languages(df).collect()}
    assert main[604]["lang"] is None and not {600, 601, 602, 603, 605} & set(main)
    assert all(0.6 <= r["confidence"] <= 1 for r in main.values() if r["lang"])


def test_every_document_and_cell_has_a_confidence(spark):
    df, _ = language_rows(spark)
    rows = languages.all_languages(df).collect()
    found = {(r["doc_id"], r["cell_no"]): (r["lang"], r["confidence"]) for r in rows}
    assert {d for d, c in found if c == 0} == {r["doc_id"] for r in df.select("doc_id").collect()}
    # Null, empty, blank and code-only documents; a document whose cells are all rejected keeps its confidence.
    assert all(found[d, 0] == (None, None) and not any(x == d and c for x, c in found) for d in (600, 601, 602, 603, 605))
    assert found[604, 0] == (None, 0.0)
    assert found[500, 7][0] == "fr" and 0.6 <= found[500, 7][1] <= 1 and all(v[1] is not None for (_, c), v in found.items() if c)
    alone = languages.all_languages(df.where("doc_id < 160 or doc_id = 603").repartition(40)).collect()
    assert [tuple(r)[1:] for r in alone if r["doc_id"] == 603] == [(0, None, None)]


def test_held_out_accuracy(spark):
    df, rows = language_rows(spark)
    models = languages.train(df.where("doc_id % 2 = 0"))
    held = [(t, n) for d, t, n in rows if d < 160 and d % 2 and n in SENTENCES]
    scores, characters = languages.Scorer(models).score(["\n".join(c for _, c in languages.markdown_cells(t)) for t, _ in held])
    lang, _ = languages.decide(scores, characters, models)
    right = sum(languages.LANGUAGES[k] == n for k, (_, n) in zip(lang, held))
    assert right >= 0.97 * len(held)


def test_foreign_script_is_rejected(spark):
    models = languages.train(language_rows(spark)[0])
    scores, characters = languages.Scorer(models).score(["これは日本語の文章です", "", "12 34 !!"])
    assert languages.decide(scores, characters, models)[0].tolist() == [-1, -1, -1]


def test_model_is_a_distribution(spark):
    models = languages.train(language_rows(spark)[0])
    every = sorted({c for w in SENTENCES["en"] for c in w.lower() if c.isalpha()}) + ["q"]
    p = np.exp(models.score(["th" + c for c in every]) - 0)[:, 0]
    assert (p > 0).all() and p.sum() < 1


def test_labels_with_regions_names_and_noise(spark):
    labels = ["en", "EN", "eng", "English", "en-US", "de_AT", " fr ", "python", "", None, "-", "und", "xx", "ger", "Dutch"]
    rows = spark.createDataFrame([(x,) for x in labels], "lang string").select(languages.named_language(__import__("pyspark").sql.functions.col("lang"))).collect()
    assert [r[0] for r in rows] == ["en"] * 5 + ["de", "fr", None, None, None, None, None, None, "de", "nl"]


def test_pieces_of_equal_hash_are_told_apart():
    """Five pieces, of which the hash took the second and the fourth for the first one's like."""
    points = np.array([7, 8, 7, 9, 7, 8, 7, 8, 8, 3], np.uint32)
    start, size = np.array([0, 2, 4, 6, 9]), np.array([2, 2, 2, 3, 1])
    place = np.arange(len(points)) - np.repeat(start, size)
    kind, first = tokenizer.told_apart(points, start, size, place, np.array([0, 0, 0, 0, 1]), np.array([0, 4]))
    assert kind[0] == kind[2] == 0 and len(set(kind.tolist())) == 4
    assert [first[k] for k in kind] == [0, 1, 0, 3, 4]


@needs_vocabulary
def test_targets_listed_twice_count_by_the_least(spark):
    documents = spark.createDataFrame([(i, "word " * 20, s) for i, s in enumerate("ab" * 40)], "doc_id bigint, text string, source string")
    rows = [("a", 0.7, 1), ("a", 0.5, 1), ("b", 0.5, 1)]
    for order in (rows, rows[::-1]):
        got = {r["source"]: r for r in mixing.shares(documents, spark.createDataFrame(order, "source string, target_share double, max_repeats int")).collect()}
        assert got["a"]["target_share"] == 0.5 and abs(got["a"]["actual_share"] - 0.5) < 0.02
