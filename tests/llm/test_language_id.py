import base64
import random
import zlib

import numpy as np
import pytest
from conftest import SF

from pairlab.llm import language_id

WORDS = {
    "en": "the of and that with from this there which would about people water".split(),
    "de": "der die und nicht eine sich auch werden schön über straße können zwischen".split(),
    "fr": "les des une être pour dans avec était même nous vous après élève".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, text(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(list(WORDS) * 60)]


def brute_counts(value):
    """Letter n-grams as strings, one blank for each run of other characters and at the start."""
    padded = " "
    for ch in value.lower():
        if ch.isalpha():
            padded += ch
        elif padded[-1] != " ":
            padded += " "
    return padded


def test_gram_counts_are_those_of_the_letters():
    a = language_id.gram_counts("Über  DAS, 12 meer!")
    assert (a == language_id.gram_counts("über das meer.")).all()
    padded = brute_counts("Über  DAS, 12 meer!")
    assert a.sum() == sum(len(padded) - n + 1 for n in language_id.GRAMS)
    assert language_id.gram_counts(None).sum() == language_id.gram_counts("").sum()


@pytest.mark.parametrize("piece", [2, 3, 7, 64])
def test_long_texts_are_counted_whole(monkeypatch, piece):
    value = "The quick, brown fox -- jumps over   the lazy dog 42 times; straße über é" * 3
    whole = language_id.gram_counts(value)
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert (language_id.gram_counts(value) == whole).all()


def test_held_out_accuracy_and_contract(spark, corpus):
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 !?", "fr"), (None, "the of and", None), (903, "the people", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in corpus + odd], "doc_id bigint, text string, lang string, score double")
    rows = language_id.identify(df).collect()
    assert len(rows) == len(corpus) + len(odd)
    by = {r.doc_id: r for r in rows}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[903].lang_pred == by[None].lang_pred == "en" and by[None].held_out is False
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    known = [r for r in held if r.lang and r.lang_pred != "und"]
    assert len(known) > 40 and np.mean([r.lang_pred == r.lang for r in known]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    spoiled = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in corpus]
    a, b = (
        sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(x, "doc_id bigint, text string, lang string")).collect())
        for x in (corpus, spoiled)
    )
    assert a == b


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id bigint, text string, lang string")
    assert language_id.identify(df).first().lang_pred == "und"
    assert language_id.identify(df.limit(0)).count() == 0


def test_far_texts_are_rejected():
    idf = np.ones(language_id.DIMENSIONS)
    vector = language_id._vector(language_id.gram_counts("the people there"), idf)
    model = language_id.Model(idf, vector[None, :], ["en"], np.array([0.3, 0.3, 0.3]))
    assert language_id.classify("the people there", model)[2] is False
    assert language_id.classify("щука", model)[2] is True


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    return docs, language_id.fit(docs.where(~language_id._held_out("doc_id")))


def test_a_fitted_model_rejects_what_is_no_language_of_its_own(fitted):
    _, model = fitted
    assert model.reach[2] < 0.78
    rng = random.Random(1)
    far = [
        base64.b64encode(rng.randbytes(600)).decode(),
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(120)),
        " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(120)),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki "
        "ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
    ]
    assert all(language_id.classify(t, model)[2] for t in far)
    for text in ("½ 12", "²", "Ⅷ", "12 !?", ""):
        assert language_id.classify(text, model) == ("und", 0.0, True)


def test_a_fitted_model_keeps_held_out_prose(fitted):
    docs, model = fitted
    rows = language_id.predict(docs, model).where("held_out AND length(text) >= 60 AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and sum(r.rejected for r in rows) <= len(rows) // 200
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_ties_and_clashing_names(spark):
    vector = np.zeros(language_id.DIMENSIONS)
    vector[:2] = 0.5**0.5
    model = language_id.Model(np.ones(language_id.DIMENSIONS), np.stack([vector, vector]), ["aa", "bb"], np.ones(3))
    df = spark.createDataFrame([(1, "the", 5, "x")], "doc_id bigint, text string, _found int, rejected string")
    row = language_id.predict(df, model).first()
    assert (row.lang_pred, row._found, row.doc_id) == ("aa", 5, 1)
