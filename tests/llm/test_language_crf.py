"""The chain against enumeration, and the languages against held-out documents."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tutorspark.llm import language_crf
from tutorspark.llm.arrow_text import utf8
from tutorspark.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("lengths", [[1], [3, 1, 0, 5], [6, 0]])
def test_posteriors_by_enumeration(lengths):
    rng = np.random.default_rng(1)
    labels, n = 3, sum(lengths)
    scores, transitions = rng.normal(size=(n, labels)) * 3, rng.normal(size=(labels, labels))
    first = np.r_[0, np.cumsum(lengths)]
    got = language_crf.posteriors(scores, transitions, first)
    for a, b in zip(first[:-1], first[1:]):
        want = np.zeros((b - a, labels))
        for path in itertools.product(range(labels), repeat=b - a):
            # The state before the first word is any, with equal weight.
            weight = np.exp(transitions)[:, path[0]].sum() if path else 0
            weight *= np.exp(sum(scores[a + k, label] for k, label in enumerate(path)))
            weight *= np.exp(sum(transitions[i, j] for i, j in zip(path, path[1:])))
            for k, label in enumerate(path):
                want[k, label] += weight
        if b > a:
            np.testing.assert_allclose(got[a:b], want / want.sum(axis=1, keepdims=True), rtol=1e-9)


def test_posteriors_of_long_chains_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    first = np.r_[0, np.cumsum([700, 1, 0, 65, 32, 33])]
    scores, transitions = rng.normal(size=(first[-1], 4)) * 5, rng.normal(size=(4, 4)) * 3
    got = language_crf.posteriors(scores, transitions, first)
    monkeypatch.setattr(language_crf, "BLOCK", 7)
    np.testing.assert_allclose(got, language_crf.posteriors(scores, transitions, first), atol=1e-9)


def test_expected_transitions_are_the_gradient():
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 4])
    got = language_crf._expected_transitions(scores, transitions, language_crf.posteriors(scores, transitions, first), first)
    want, total = np.zeros((2, 2)), 0
    for path in itertools.product(range(2), repeat=4):
        weight = np.exp(transitions)[:, path[0]].sum() * np.exp(sum(scores[k, label] for k, label in enumerate(path)))
        weight *= np.exp(sum(transitions[i, j] for i, j in zip(path, path[1:])))
        total += weight
        for i, j in zip(path, path[1:]):
            want[i, j] += weight
    np.testing.assert_allclose(got, want / total, rtol=1e-9)


def test_lower_case():
    data, _ = utf8(pa.array(["ÀÉÞ×ß ABCé中"]))
    assert language_crf._lowered(data).tobytes().decode() == "àéþ×ß abcé中"


def test_query(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = llm_queries()["op5_language_crf"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_the_answer_does_not_use_the_row_itself(spark):
    """Held-out rows with wrong ids, languages and sources are labelled as before."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(400)
    field = language_crf.fit_on(docs)
    again = language_crf.fit_on(docs.repartition(5).withColumn("source", language_crf.F.lit("x")))
    assert np.array_equal(field.weights, again.weights) and field.languages == again.languages
    changed = docs.withColumn("lang", language_crf.F.when(language_crf.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    assert np.array_equal(language_crf.fit_on(changed).transitions, field.transitions)


def test_odd_rows(spark, documents):
    df, rows = documents
    got = language_crf.identify(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by_id = {r.doc_id: r for r in got}
    for n in (10_001, 10_002, 10_003):
        assert (by_id[n].lang_pred, by_id[n].score) == ("und", 0.0)
    assert by_id[10_005].lang_pred in {"en", "de", "fr", "es"}
    assert by_id[None].held_out is False
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 10_006}) == 1


def test_texts_without_letters(spark):
    texts = ["123 – 456", "—", "\U0001f600", "1a", "中"]
    df = spark.createDataFrame([(n, t, "en") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    field = language_crf.fit([("en", "the cat and the dog"), ("fr", "le chat et le chien")])
    got = {r.doc_id: r.lang_pred for r in language_crf.label_languages(df, field).collect()}
    assert [got[n] == "und" for n in range(5)] == [True, True, True, False, False]


def test_nothing_to_learn(spark, no_documents):
    assert language_crf.identify(no_documents).collect() == []
    df = spark.createDataFrame([(1, "some text", None, 3.5)], "doc_id long, text string, lang string, SCORE double")
    (row,) = language_crf.identify(df).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    (row,) = language_crf.label_languages(df, None).collect()
    assert row.asDict()["lang_pred"] == "und" and "SCORE" not in row.asDict()


def test_code_switching(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    field = language_crf.fit_on(docs)
    held = docs.filter(language_crf.held_out(docs["doc_id"])).collect()
    english = [w for r in held if r.lang == "en" for w in r.text.split() if w.isalpha()][:60]
    german = [w for r in held if r.lang == "de" for w in r.text.split() if w.isalpha()][:40]
    df = spark.createDataFrame([(1, " ".join(english + german))], "doc_id long, text string")
    (row,) = language_crf.label_languages(df, field).collect()
    assert row.lang_pred == "en" and 0.5 < row.score < 0.7 and row.n_letter_words == 100
    words = {lang: sum(r.words for r in row.lang_runs if r.lang == lang) for lang in ("en", "de")}
    assert words["en"] >= 55 and words["de"] >= 35
    assert len(row.lang_runs) == row.n_switches + 1


@pytest.mark.parametrize("ids", [[n] for n in range(9)] + [list(range(9))])
def test_rows_of_one_id_are_drawn_one_by_one(spark, ids):
    """Whatever the id, a language gets its share of the sample."""
    fine = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"mot {n} un deux", "fr", 1) for n in range(2900 // len(ids)) for i in ids] + [(n, f"word {n}", "en", 1) for n in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    sample = language_crf.training_sample(df, "doc_id", "text", "lang")
    found = Counter(lang for lang, _ in sample)
    assert found["fr"] == (min(language_crf.SAMPLE_DOCS, 2900 // len(ids) * len(fine)) if fine else 0)
    assert found["en"] == sum(zlib.crc32(str(n).encode()) % 5 != 0 for n in range(100, 130))


def test_equal_rows_are_learned(spark):
    rows = [(1, "le même texte", "fr")] * 3000 + [(n, f"word {n}", "en") for n in range(100, 130)]
    sample = language_crf.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert Counter(lang for lang, _ in sample)["fr"] == language_crf.SAMPLE_DOCS
